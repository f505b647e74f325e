import itertools
import zlib

import numpy as np

from conftest import SMALL
from logloom.llm import toxicity as tox


def test_marginals_match_enumeration():
    rng = np.random.default_rng(1)
    u, a = rng.normal(size=(4, 6)), rng.normal(size=(2, 2))
    for row, got, pairs in zip(u, tox.marginals(u, a), tox.pair_marginals(u, a, *tox._messages(u, a))):
        total, single, double = 0.0, np.zeros(6), np.zeros((5, 2, 2))
        for y in itertools.product((0, 1), repeat=6):
            p = np.exp(sum(v * s for v, s in zip(row, y)) + sum(a[i, j] for i, j in zip(y, y[1:])))
            total += p
            single += p * np.array(y)
            for t, (i, j) in enumerate(zip(y, y[1:])):
                double[t, i, j] += p
        assert np.allclose(got, single / total)
        assert np.allclose(pairs, double / total)


def corpus(n=600, seed=0):
    rng = np.random.default_rng(seed)
    vocabulary = [f"w{i}x" for i in range(400)]
    texts, labels = [], []
    for i in range(n):
        words = [vocabulary[j] for j in rng.zipf(1.3, 40) % 400]
        if i % 5 == 0:
            words[3] = rng.choice(["Slur", "gronkish", "gronker", "gronkel"])
            words[20] = "slur,"
        texts.append(" ".join(words))
        labels.append(int(i % 5 == 0))
    return texts, np.array(labels)


def test_held_out_accuracy_and_offsets():
    texts, labels = corpus()
    model = tox.fit(texts[:400], labels[:400])
    held = texts[400:]
    probs = model.token_marginals([tox.tokens(t) for t in held])
    assert np.mean((model.score(probs) >= 0.5) == labels[400:]) > 0.97
    text = "Één w1x GRONKISH thing \x00 slur, slur! w2x"
    [p] = model.token_marginals([tox.tokens(text)])
    assert [text[s:e] for s, e in tox.toxic_spans(text, p)] == ["GRONKISH", "slur, slur"]
    # pieces are cut at a fixed length, whatever stands after them
    long = "w1x " * 1000 + "slur " + "w2x " * 1000
    [p] = model.token_marginals([tox.tokens(long)])
    assert len(p) == 2001 and p[1000] > 0.5 and model.score([p])[0] > model.score([p[:1000]])[0]


def test_copies_of_one_toxic_text_do_not_make_its_words_toxic():
    texts, labels = corpus()
    texts += ["w1x slur rareone raretwo rarethree w5x w6x"] * 60
    labels = np.append(labels, [1] * 60)
    model = tox.fit(texts, labels)
    [p] = model.token_marginals([tox.tokens("rareone raretwo w5x")])
    assert p.max() < 0.5


def test_the_cut_does_not_move_with_the_bounds_of_the_sample(spark, docs, monkeypatch):
    rng = np.random.default_rng(5)
    # "maybe" stands in 40 % of the toxic and 4 % of the clean documents
    texts, labels = corpus(3000)
    texts = [t + " maybe" * int(rng.random() < (0.4 if v else 0.04)) for t, v in zip(texts, labels)]
    whole = tox.fit(texts, labels)
    clean = np.flatnonzero(labels == 0)[:150]
    some = np.sort(np.concatenate([np.flatnonzero(labels), clean]))
    part = [texts[i] for i in some]
    few = tox.fit(part, labels[some], (int((labels == 0).sum()), int(labels.sum())))
    odds = lambda m: float(m.layer @ tox.aggregate([np.full(40, 0.03)])[0])
    assert abs(np.mean(few.score(few.token_marginals([tox.tokens(t) for t in texts]))) - 0.2) < 0.02
    assert abs(np.mean(whole.score(whole.token_marginals([tox.tokens(t) for t in texts]))) - 0.2) < 0.02
    assert odds(few) < 0 and np.allclose(tox.class_weights(np.array([0, 1, 1]), (90, 10)), [2.7, 0.15])
    monkeypatch.setattr(tox, "TRAIN_TOXIC", 10)
    marks = spark.createDataFrame([(i, 1, int(i % 3 == 0)) for i in range(90)], "doc_id long, quality int, toxic int")
    rows = tox.with_row_key(docs(*[(i, f"head{i} " + "x " * 30_000 if i < 3 else f"t{i}") for i in range(90)]))
    sample, marked, sizes = tox.training_sample(rows, marks)
    usable = [i for i in range(90) if zlib.crc32(str(i).encode()) % 5]
    assert sizes == (sum(i % 3 > 0 for i in usable), sum(i % 3 == 0 for i in usable)) and marked.sum() == 10
    assert max(map(len, sample)) == 20_009


def run(spark, docs, labels):
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    return tox.score_documents(docs, marks)


def test_edge_cases(spark, docs):
    texts, labels = corpus(400)
    odd = [(-1, None), (-2, ""), (-3, " \n."), (-4, "slur " * 30_000), (None, "slur"), (7, texts[7]), (7, texts[7])]
    marks = [(i, 1, int(v)) for i, v in enumerate(labels)] + [(None, 1, 1), (3, None, None), (5, 0, 0), (-50, 1, 1)]
    rows = run(spark, docs(*enumerate(texts), *odd), marks).collect()
    assert len(rows) == len(texts) + len(odd)
    by = {r.doc_id: r for r in rows}
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in rows)
    assert by[-1].predicted == by[-2].predicted == by[-3].predicted == 0 and by[-1].score == by[-2].score
    assert by[-4].predicted == 1 and by[None].predicted == 1 and not by[None].held_out
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows if r.doc_id is not None)
    assert len({r.score for r in rows if r.doc_id == 7}) == 1
    held = [r for r in rows if r.held_out and r.doc_id is not None and r.doc_id >= 0]
    assert np.mean([r.predicted == labels[r.doc_id] for r in held]) > 0.9


def test_no_usable_labels_and_empty_tables(spark, docs):
    assert [r.score for r in run(spark, docs("a b"), []).collect()] == [0.0]
    assert [r.score for r in run(spark, docs("a b", "c"), [(0, 1, 1), (1, 1, 1)]).collect()] in ([1.0, 1.0], [0.0, 0.0])
    assert run(spark, docs("a").limit(0), [(0, 1, 1)]).count() == 0


def test_query_on_the_small_table(spark):
    from logloom.llm.catalog import op2_toxicity

    rows = op2_toxicity(spark, SMALL).collect()
    assert len(rows) == 200 and all(0 <= r.score <= 1 for r in rows)
