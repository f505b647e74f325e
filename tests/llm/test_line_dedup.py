from logloom.llm.line_dedup import dedup_lines


def result(df):
    return sorted((r.doc_id, r.n_lines, r.n_dropped, r.kept_text) for r in df.collect())


def test_frequent_keys_lose_every_line(docs):
    got = result(dedup_lines(docs("Menu \nown a", "\tMENU\nown b\nmenu", "own c", None, ""), min_docs=2))
    assert got == [(0, 2, 1, "own a"), (1, 3, 2, "own b"), (2, 1, 0, "own c"), (3, 1, 0, ""), (4, 1, 0, "")]


def test_blank_lines_and_non_ascii_case_stay(docs):
    got = result(dedup_lines(docs("\n É \nx", "\n é \ny", "\n\x85\n"), min_docs=2))
    assert [r[2] for r in got] == [0, 0, 0]
    assert got[0][3] == "\n É \nx"


def test_a_line_repeated_in_one_document_is_one_document(docs):
    assert result(dedup_lines(docs("a\na\na", "b"), min_docs=2))[0][2] == 0


def test_repeated_rows_null_ids_and_empty_table(spark, docs):
    got = result(dedup_lines(docs((7, "a\nb"), (7, "a\nb"), (8, "a")), min_docs=2))
    assert got == [(7, 2, 1, "b"), (7, 2, 1, "b"), (8, 1, 1, "")]
    got = dedup_lines(docs((None, "a\nb"), (None, "a"), (3, "b")), min_docs=2).collect()
    assert {(r.doc_id, r.n_dropped, r.kept_text) for r in got} == {(None, 2, ""), (None, 1, ""), (3, 1, "")}
    assert dedup_lines(docs((1, "a")).limit(0)).count() == 0


def test_long_document(docs):
    got = result(dedup_lines(docs("x\n" * 50_000 + "tail", "x"), min_docs=2))
    assert got[0] == (0, 50_001, 50_000, "tail")
