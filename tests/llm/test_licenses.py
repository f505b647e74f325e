import re

from conftest import SMALL
from logloom.llm.catalog import op4_licenses
from logloom.llm.licenses import TEMPLATES, _place, scan_licenses

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}


def brute(text):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    at = {p: [i for i in range(len(w)) if w[i:i + len(p.split())] == p.split()] for p in BASE}
    starts = sorted(i for x in at.values() for i in x)
    labels = {BASE[p] for p, x in at.items() if x}
    # every template whose key phrase stands, with any two rare words in place, is one of these
    keyed = {label for label, _, key in TEMPLATES if f" {key} " in f" {' '.join(w)} "}
    return (len(w), len(starts), starts[0] if starts else None, starts[-1] if starts else None,
            ",".join(sorted(labels))), labels, keyed


def check(rows, texts):
    assert len(rows) == len(texts)
    for r in rows:
        want, base, keyed = brute(texts[r.doc_id])
        got = (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels)
        assert got == want, (r.doc_id, got, want)
        labels = {x for x in r.labels.split(",") if x}
        assert base <= labels and labels <= base | keyed
        assert 0 <= r.score <= 1 and (r.score > 0) == bool(labels)
        assert r.labels == ",".join(sorted(labels))


def test_whole_table(spark, small):
    d = small("documents")
    check(op4_licenses(spark, SMALL).collect(), dict(zip(d.doc_id, d.text)))


def test_templates_and_edges(spark, docs):
    texts = [
        "Intro. Licensed under the Apache License, Version 2.0. Bye", "Released under the MIT License.",
        "GNU General Public License, version 3 and general public license general public license",
        "cc by cc by cc-by-nc 4.0; Licensed under CC BY-NC 4.0", "the apache helicopter has a driving license",
        "All rights, reserved ALL RIGHTS RESERVED", None, "", "?!", "É general public\nlicense", "all rights",
        "word " * 30_000 + "all rights reserved " * 300, "mit license",
    ]
    df = scan_licenses(docs(*texts))
    rows = sorted(df.collect(), key=lambda r: r.doc_id)
    for r, t in zip(rows, texts):
        want, base, keyed = brute(t)
        assert (r.n_words, r.n_base, r.first_word, r.last_word, ",".join(r.base_labels)) == want
        assert base <= set(r.labels) <= base | keyed
    assert rows[0].labels == ["apache-2.0"] and rows[1].labels == ["mit"] and rows[2].labels == ["gpl", "gpl-3.0"]
    assert rows[3].labels == ["cc-by", "cc-by-nc-4.0"] and rows[4].labels == [] and rows[0].score > rows[5].score == 0.5


def test_every_whole_statement_gets_its_label(docs):
    statements = ". ".join(text for _, text, _ in TEMPLATES)
    notice = ". ".join(text for label, text, _ in TEMPLATES if label in ("apache-2.0", "bsd", "isc", "mit"))
    texts = [statements, notice, "license software gnu public " * 5_000 + statements] + ["mozilla creative plain words"] * 20
    rows = sorted(scan_licenses(docs(*texts)).collect(), key=lambda r: r.doc_id)
    every = {label for label, _, _ in TEMPLATES}
    assert every <= set(rows[0].labels) and every <= set(rows[2].labels)
    assert rows[1].labels == ["apache-2.0", "bsd", "isc", "mit"] and abs(rows[1].score - 1) < 1e-9


def test_repeated_null_and_empty(docs):
    rows = scan_licenses(docs((1, "all rights reserved"), (1, "all rights reserved"), (None, "the MIT License"))).collect()
    assert sorted((r.doc_id or 0, r.n_base) for r in rows) == [(0, 0), (1, 1), (1, 1)]
    assert scan_licenses(docs("a").limit(0)).count() == 0


def test_key_phrases_stand_in_their_templates():
    assert all(_place(text, key) >= 0 for _, text, key in TEMPLATES)
