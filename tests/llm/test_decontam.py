import random
import re

import pytest

from logloom.llm.decontam import contaminated_words

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(texts, items, window):
    out = []
    for t in texts:
        w, hit, found = words(t), set(), set()
        for name, item in items:
            v = words(item)
            n = min(window, len(v))
            grams = {tuple(v[i:i + n]) for i in range(len(v) - n + 1)} if n else set()
            for i in range(len(w) - n + 1):
                if tuple(w[i:i + n]) in grams:
                    hit.update(range(i, i + n))
                    found.add(str(name))
        out.append((len(w), len(hit), sorted(found)))
    return out


def run(spark, docs, texts, items, window=10, k=6):
    bench = spark.createDataFrame(items, "item_id long, text string")
    rows = contaminated_words(docs(*texts), bench, window, k).collect()
    return [(r.n_words, r.n_hit, list(r["items"])) for r in sorted(rows, key=lambda r: r.doc_id)]


def test_shared_window_of_exactly_ten_words_is_found(spark, docs):
    item = " ".join(f"w{i}" for i in range(30))
    texts = ["x " + " ".join(f"W{i}" for i in range(a, a + 10)) + ", y" for a in range(21)]
    texts += ["x " + " ".join(f"w{i}" for i in range(a, a + 9)) + " y" for a in range(3)]
    assert run(spark, docs, texts, [(1, item)]) == brute(texts, [(1, item)], 10)


def test_short_items_nulls_and_ties(spark, docs):
    items = [(1, "only three words"), (2, None), (3, ""), (4, "a " * 14), (5, "only three words"), (6, "one")]
    texts = ["say only THREE words. only three", "a " * 40, None, "", "b a a a a a a a a a b", "one"]
    assert run(spark, docs, texts, items) == brute(texts, items, 10)


@pytest.mark.parametrize("seed", range(2))
def test_random_texts_with_few_words(spark, docs, seed):
    rnd = random.Random(seed)
    make = lambda n: " ".join(rnd.choice("abc") for _ in range(n))
    texts = [make(rnd.randrange(80)) for _ in range(60)]
    items = [(i, make(rnd.randrange(1, 25))) for i in range(8)]
    assert run(spark, docs, texts, items, window=7, k=4) == brute(texts, items, 7)


def test_empty_tables(spark, docs):
    empty = spark.createDataFrame([], "item_id long, text string")
    assert [r.n_hit for r in contaminated_words(docs("a b c"), empty).collect()] == [0]
    some = spark.createDataFrame([(1, "a b c")], "item_id long, text string")
    assert contaminated_words(docs("a").limit(0), some).count() == 0


def test_frequent_words_and_long_texts(spark, docs):
    """A short item's first word met 100,000 times, and a long text with hits at its end."""
    item = " ".join(f"w{i}" for i in range(30))
    texts = ["the " * 100_000, "the " * 60_000 + "other " + item, "the other"]
    assert run(spark, docs, texts, [(1, "the other"), (2, item), (3, "w" * 50_000)]) == [
        (100_000, 0, []), (60_031, 32, ["1", "2"]), (2, 2, ["1"])]


def test_broadcast_or_shuffle(spark, docs, monkeypatch):
    items = [(1, "only three words"), (2, " ".join(f"w{i}" for i in range(30)))]
    texts = ["say only three words", "y " + " ".join(f"w{i}" for i in range(4, 30))]
    monkeypatch.setattr("logloom.llm.decontam.BROADCAST_BYTES", 0)
    monkeypatch.setattr("logloom.llm.decontam.BROADCAST_ROWS", 0)
    assert run(spark, docs, texts, items) == brute(texts, items, 10)
