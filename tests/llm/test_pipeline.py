from collections import Counter

import corpus_pipeline as cp
from conftest import SMALL
from logloom.llm import toxicity
from test_decontam import brute as brute_decontam
from test_packing import verify
from test_simhash import brute_components, brute_fingerprint

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, rid string"


def lines_left(texts, least=10):
    key = lambda x: "".join(c.lower() if "A" <= c <= "Z" else c for c in x.strip(" \t\n\x0b\x0c\r"))
    n = Counter(k for t in texts for k in {key(x) for x in (t or "").split("\n")} if k)
    return ["\n".join(x for x in (t or "").split("\n") if n[key(x)] < least) for t in texts]


def stages(spark, docs, sf_dir, tmp_path):
    out = []
    for i, (name, f) in enumerate(cp.STAGES):
        f(spark, docs, sf_dir).write.parquet(str(tmp_path / str(i)))
        docs = spark.read.parquet(str(tmp_path / str(i)))
        out.append(docs)
        if i < len(cp.STAGES) - 1:
            assert docs.columns == cp.COLUMNS
    return out


def rows_of(df):
    return {r.doc_id: r for r in df.collect()}


def test_every_stage_matches_brute_force_on_its_own_input(spark, small, tmp_path):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    a, b, c, d, e = stages(spark, docs, SMALL, tmp_path)
    bad = {r.doc_id for r in toxicity.score_documents(docs, spark.read.parquet(f"{SMALL}/labels.parquet")).collect() if r.predicted}
    all_docs, one = rows_of(docs), rows_of(a)
    assert one == {i: r for i, r in all_docs.items() if i not in bad}

    two, ids = rows_of(b), sorted(one)
    assert [two[i].text for i in ids] == lines_left([one[i].text for i in ids])
    assert all(two[i].n_chars == (one[i].n_chars if two[i].text == one[i].text else len(two[i].text)) for i in ids)

    three = rows_of(c)
    groups = brute_components([(i, brute_fingerprint(two[i].text)) for i in ids], 4)
    assert three == {i: two[i] for i in ids if groups[i] == i}

    four, ids = rows_of(d), sorted(three)
    bench = small("benchmark")
    hits = brute_decontam([three[i].text for i in ids], list(zip(bench.item_id, bench.text)), 10)
    assert four == {i: three[i] for i, h in zip(ids, hits) if not h[1]}
    assert 0 < len(four) < len(three) < len(all_docs)
    verify(e.collect(), [(i, r.text) for i, r in four.items()], 4096)


def test_odd_rows_pass_all_stages(spark, tmp_path):
    docs = spark.createDataFrame(
        [(1, None, None, None, None, "x"), (None, "unique words of a row without an id", "en", "s", 3, "x"),
         (2, "twice the same row of words", "en", "s", 27, "x"), (2, "twice the same row of words", "en", "t", 27, "x"),
         (3, "w " * 20_000, None, "s", 40_000, "x")], SCHEMA)
    out = stages(spark, docs, SMALL, tmp_path)
    assert [len(x.collect()) for x in out[:4]] == [5, 5, 4, 4]
    assert {r.doc_id for r in out[4].collect()} == {1, None, 2, 3}


def test_empty_documents(spark, tmp_path):
    assert [x.count() for x in stages(spark, spark.createDataFrame([], SCHEMA), SMALL, tmp_path)] == [0] * 5
