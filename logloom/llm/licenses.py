"""Licence scans with a positional rare-token index.

Every licence statement of ``TEMPLATES`` is indexed word by word: (word,
template, place). The words' document frequencies over the whole corpus give
their IDF; every licence word of a file is looked up, however many it has, and
postings that agree on the template's place in the file are intersected. A
placement with ``MIN_WORDS`` agreeing words (or all the
template has) stands if the template's mandatory key phrase is found there
word for word. Base phrases are reported wherever they stand.

Words are lower-cased letters, digits and all non-ASCII. The score is the best
placement's share of its template's IDF; a file with base phrases only scores
``BASE_SCORE``, one without labels 0.

Defined results: a null or empty text has no words, labels or places; ties in
IDF go by word; repeated rows count once in document frequencies and get equal
rows; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logloom.llm.common import materialise, with_row_key, words_array

MIN_WORDS, BASE_SCORE = 2, 0.5

# Base phrases with their labels and their rarest word
BASE = {
    "cc by": ("cc-by", "cc"),
    "general public license": ("gpl", "license"),
    "all rights reserved": ("reserved", "reserved"),
}
# Label, statement, mandatory key phrase
TEMPLATES = [
    ("agpl-3.0", "gnu affero general public license version 3", "affero general public license"),
    ("apache-2.0", "licensed under the apache license version 2 0", "apache license version 2 0"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted",
     "redistribution and use in source and binary forms"),
    ("bsd-3-clause", "licensed under the bsd 3 clause license", "bsd 3 clause"),
    ("cc-by-4.0", "creative commons attribution 4 0 international license", "creative commons attribution 4 0"),
    ("cc-by-nc-4.0", "licensed under cc by nc 4 0", "cc by nc 4 0"),
    ("cc-by-sa-4.0", "licensed under cc by sa 4 0", "cc by sa 4 0"),
    ("cc0-1.0", "cc0 1 0 universal public domain dedication", "cc0 1 0 universal"),
    ("epl-2.0", "eclipse public license version 2 0", "eclipse public license"),
    ("gpl-2.0", "licensed under the gnu general public license version 2", "gnu general public license version 2"),
    ("gpl-3.0", "licensed under the gnu general public license version 3", "gnu general public license version 3"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose", "permission to use copy modify"),
    ("lgpl-3.0", "gnu lesser general public license version 3", "lesser general public license"),
    ("mit", "released under the mit license", "the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software",
     "permission is hereby granted free of charge"),
    ("mpl-2.0", "mozilla public license version 2 0", "mozilla public license"),
    ("unlicense", "this is free and unencumbered software released into the public domain",
     "free and unencumbered software"),
]
# Words of the statements too common to be looked up
COMMON = "a and any are copy for forms free in into is of or person public software source the this to under use with".split()


def postings() -> list[tuple[str, int, int]]:
    """(word, template number, place) of the index."""
    return [(w, t, i) for t, (_, text, _) in enumerate(TEMPLATES)
            for i, w in enumerate(text.split()) if w not in COMMON and not w.isdigit()]


def places(words: str, phrase: str, rarest: str) -> Column:
    """Starts of a phrase in an array of words."""
    parts = phrase.split()
    last = F.size(words) - len(parts)

    def at(i: Column) -> Column:
        test = F.get(F.col(words), i) == parts[0]
        for n, w in enumerate(parts[1:], 1):
            test = test & (F.get(F.col(words), i + n) == w)
        return test

    return F.when(F.array_contains(words, rarest) & (last >= 0), F.filter(F.sequence(F.lit(0), last), at)).otherwise(
        F.array().cast("array<int>"))


def scanned(docs: DataFrame) -> DataFrame:
    """One row per document, without its text: doc_id, rid, n_words, the base
    phrases' places, the licence words' places (hits) and the key phrases'
    (keys, by template)."""
    rows = with_row_key(docs).select("doc_id", "rid", words_array(F.col("text")).alias("words"))
    vocabulary = sorted({w for w, _, _ in postings()})
    lists = F.array(*map(F.lit, vocabulary))
    met = F.arrays_overlap("words", lists)
    hits = F.filter(F.transform("words", lambda w, i: F.struct(w.alias("word"), i.alias("pos"))),
                    lambda h: F.array_contains(lists, h["word"]))
    hits = F.when(F.col("met"), hits).otherwise(F.array().cast("array<struct<word:string,pos:int>>"))
    rare = {key: max(key.split(), key=lambda w: (w not in COMMON and not w.isdigit(), len(w))) for _, _, key in TEMPLATES}
    keys = F.array(*[F.when(F.col("met"), places("words", key, rare[key])).otherwise(F.array().cast("array<int>"))
                     for _, _, key in TEMPLATES])
    base = F.array(*[F.struct(F.lit(label).alias("label"), places("words", p, r).alias("at")) for p, (label, r) in BASE.items()])
    return (rows.withColumn("met", met)
            .select("doc_id", "rid", F.size("words").cast("long").alias("n_words"),
                    F.filter(base, lambda b: F.size(b["at"]) > 0).alias("base"), hits.alias("hits"), keys.alias("keys")))


def placements(files: DataFrame) -> DataFrame:
    """(rid, label, share): verified placements of templates in files."""
    spark = files.sparkSession
    found = files.where(F.size("hits") > 0).dropDuplicates(["rid"]).select("rid", "keys", F.explode("hits").alias("h"))
    found = found.select("rid", "keys", "h.word", "h.pos")
    counts = found.groupBy("word").agg(F.count_distinct("rid").alias("df"))
    n = files.count()
    index = spark.createDataFrame(postings(), "word string, template int, place int")
    idf = F.log((F.lit(n) + 1.0) / (F.coalesce("df", F.lit(0)) + 1.0)) + 1e-9
    # the index has as many rows as the templates have words, whatever the corpus
    index = materialise(index.join(counts, "word", "left").withColumn("idf", idf).drop("df"), "licence_index")
    whole = index.groupBy("template").agg(F.sum("idf").alias("all_idf"), F.count_distinct("word").alias("all_words"))
    index = index.join(whole, "template")

    known = F.array(*[F.lit(_place(text, key)) for _, text, key in TEMPLATES])
    labels = F.array(*[F.lit(label) for label, _, _ in TEMPLATES])
    stands = F.array_contains(F.get(F.col("keys"), F.col("template")), F.col("at") + F.get(known, F.col("template")))
    # a placement without its key phrase never stands, so it need not be counted
    looked_up = found.join(F.broadcast(index), "word").withColumn("at", F.col("pos") - F.col("place")).where(stands)
    agreed = (looked_up.groupBy("rid", "template", "at")
              .agg(F.count_distinct("word").alias("n"), F.sum("idf").alias("idf"), F.first("all_idf").alias("all_idf"),
                   F.first("all_words").alias("all_words")))
    agreed = agreed.where(F.col("n") >= F.least(F.lit(MIN_WORDS), F.col("all_words")))
    return (agreed.select("rid", F.get(labels, F.col("template")).alias("label"),
                          F.least(F.col("idf") / F.col("all_idf"), F.lit(1.0)).alias("share"))
            .groupBy("rid", "label").agg(F.max("share").alias("share")))


def _place(text: str, key: str) -> int:
    words, part = text.split(), key.split()
    return next(i for i in range(len(words)) if words[i:i + len(part)] == part)


def scan_licenses(docs: DataFrame) -> DataFrame:
    """doc_id, rid, n_words, n_base, first_word, last_word, base_labels, labels
    (sorted arrays) and score of every document."""
    files = materialise(scanned(docs), "scanned_files")
    per_file = placements(files).groupBy("rid").agg(F.collect_set("label").alias("found"), F.max("share").alias("share"))
    starts = F.flatten(F.transform("base", lambda b: b["at"]))
    base_labels = F.array_sort(F.array_distinct(F.transform("base", lambda b: b["label"])))
    out = files.join(per_file, "rid", "left").withColumn("starts", starts).withColumn("base_labels", base_labels)
    nothing = F.array().cast("array<string>")
    score = F.greatest(F.coalesce("share", F.lit(0.0)), F.when(F.size("base") > 0, BASE_SCORE).otherwise(0.0))
    return out.select(
        "doc_id", "rid", "n_words", F.size("starts").cast("long").alias("n_base"),
        F.array_min("starts").cast("long").alias("first_word"), F.array_max("starts").cast("long").alias("last_word"),
        "base_labels", F.array_sort(F.array_union("base_labels", F.coalesce("found", nothing))).alias("labels"),
        score.alias("score"))
