import hashlib
import re

from conftest import SMALL
from logloom.llm import pii
from logloom.llm.catalog import op9_pii

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def valid(kind, v):
    d = re.sub("[^0-9]", "", v)
    if kind == "ip":
        return all(int(p) <= 255 for p in v.split("."))
    if kind == "card":
        total = sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(d)))
        return 16 <= len(d) <= 19 and total % 10 == 0
    return 8 <= len(d) <= 15 if kind == "phone" else True


def brute(text):
    return [(k, m.start(), m.end()) for k, p in PLAIN.items() for m in re.finditer(p, text or "") if valid(k, m.group())]


def base_of(row):
    return [(s.kind, s.start, s.end) for s in row.spans if s.kind != "term"]


TRICKY = [
    "a@b.c_d@e.f, x@@y.z a@b a@.b a@b..c é.ü@mail.example.com+z@q.r",
    "1.2.3.4.5 256.1.1.1 001.002.000255.4 1.2.3 1.2.3.4 9.9.9.9.9.9.9.9 10.0.0.1x.1.2.3.4",
    "4111 1111 1111 1111 and 4111-1111-1111-1111-1 4111111111111112 1 2 3  5500 0000 0000 0004",
    "6011000990139424 3x 4222222222222 4000 0000 0000 0000 006",
    "+1 (415) 555-2671. +12 +1234567 +12345678 ++44 20 7946 0958- +1-2-3-4-5-6-7-8-9-0-1-2-3-4-5-6",
    "😀 a@b.co 😀 10.0.0.1 é +49 30 901820 ",
    None, "", " ", "no data at all",
]


def test_base_matches_equal_plain_patterns(docs):
    rows = sorted(pii.find_personal_data(docs(*TRICKY)).collect(), key=lambda r: r.doc_id)
    assert [base_of(r) for r in rows] == [brute(t) for t in TRICKY]
    assert sum(len(brute(t)) for t in TRICKY) > 15


def test_long_runs_are_linear(docs):
    texts = ["a" * 200_000, "1" * 100_000, "1." * 60_000, "x@" + "a." * 60_000, "+" + "1" * 50_000, "a@b.c" * 5_000]
    rows = sorted(pii.find_personal_data(docs(*texts)).collect(), key=lambda r: r.doc_id)
    assert [len(base_of(r)) for r in rows[:5]] == [0, 0, 15_000, 1, 0]
    assert base_of(rows[3]) == brute(texts[3])
    assert len(base_of(rows[5])) == len(brute(texts[5]))


def test_whole_table_and_digest(spark, small):
    d = small("documents")
    rows = {r.doc_id: r for r in op9_pii(spark, SMALL).collect()}
    assert len(rows) == len(d)
    for i, t in zip(d.doc_id, d.text):
        want, r = brute(t), rows[i]
        joined = ",".join(f"{k}:{s}:{e}" for k, s, e in want)
        assert r.base_sha256 == hashlib.sha256(joined.encode()).hexdigest()
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(w[0] == k for w in want) for k in PLAIN)
        assert (r.spans + ",").startswith(joined)


def test_terms_that_give_an_entity_away(docs):
    texts = [f"filler{i} common write to Zebulon at z@mail.example.com soon common" for i in range(4)]
    texts += [f"common write to people at soon q{i}@mail.example.com common" for i in range(30)]
    texts += ["common write at soon to people"] * 30
    found = pii.find_personal_data(docs(*texts))
    rows = sorted(found.collect(), key=lambda r: r.doc_id)
    terms = [[texts[r.doc_id][s.start:s.end] for s in r.spans if s.kind == "term"] for r in rows]
    assert all("Zebulon" in t and "common" not in t and "write" not in t for t in terms[:4])
    assert not any(terms[4:])
    clean = {r.doc_id: r.text for r in pii.sanitise(docs(*texts), found).collect()}
    assert "Zebulon" not in clean[0] and "[EMAIL]" in clean[0] and clean[40] == texts[40]


def test_terms_far_from_the_entity_and_in_other_documents(docs):
    far = "and so on with much in between " * 10
    texts = [f"Dear Zebulon, {far} {n} z@mail.example.com {far} ZEBULON's \ue000Zebulon\ue001" for n in ("one", "two", "three")]
    texts += [f"😀 {far} Zebulon called {far}", f"dear {far} people", None, f"{far} zebulons called and so"]
    texts += [f"dear {far} q{i}@mail.example.com one two three called" for i in range(40)]
    found = pii.find_personal_data(docs(*texts))
    rows = {r.doc_id: r for r in found.collect()}
    for i, t in enumerate(texts):
        want = [("term", m.start(), m.end()) for m in re.finditer(r"(?i)\bzebulon\b", t or "")]
        assert [(s.kind, s.start, s.end) for s in rows[i].spans if s.kind == "term"] == want
        assert base_of(rows[i]) == brute(t)
    clean = {r.doc_id: r.text for r in pii.sanitise(docs(*texts), found).collect()}
    assert not any("zebulon" in clean[i].lower() for i in range(4)) and clean[4] == texts[4] and clean[6] == texts[6]


def test_words_of_an_email_are_not_terms(docs):
    texts = [f"{w} zebulon.q@mail.example.com" for w in ("one", "two", "three")] + [f"one two three plain {i}" for i in range(40)]
    rows = pii.find_personal_data(docs(*texts)).collect()
    assert not [s for r in rows for s in r.spans if s.kind == "term"]


def test_repeated_rows_and_empty_table(docs):
    rows = pii.find_personal_data(docs((1, "a@b.co"), (1, "a@b.co"), (None, "a@b.co"), (1, "x"))).collect()
    assert sorted(len(base_of(r)) for r in rows) == [0, 1, 1, 1]
    assert pii.find_personal_data(docs("a").limit(0)).count() == 0
