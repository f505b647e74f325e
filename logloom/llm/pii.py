"""PII: personal data, and the terms that give it away.

Base matches (e-mail, IP, card and phone numbers) are found by pattern and
checked (parts, Luhn, digits). Terms are runs of letters outside e-mails. From
the whole corpus, wherever in a document a term and an entity stand:

    P(entity | term) = documents with both / documents with the term
    disclosure(term, entity) = log2(P(entity | term) / P(entity)), in bits

A term that meets an entity in ``MIN_DOCS`` documents or more, with a
disclosure of ``BITS`` or more and a P(entity | term) of ``GENERALISE`` or
more, is generalised wherever it stands, in all documents, and removed from
``REMOVE`` on. Pairs that cannot pass are left out before they are counted: an
entity in fewer than ``MIN_DOCS`` documents or in too many for ``BITS``, a term
in too many for ``GENERALISE``. Everything is DataFrame code; spans are code
points, end exclusive.

Defined results: a null or empty text has no spans; matches of one kind never
overlap, kinds may; repeated rows count as documents of their own and get equal
rows; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logloom.llm.common import materialise, with_row_key

KINDS = ["email", "ip", "card", "phone", "term"]
MIN_DOCS, BITS, GENERALISE, REMOVE = 2, 3.0, 0.5, 0.9
MIN_TERM = 3
# terms that may be broadcast, and their bytes
BROADCAST_TERMS, BROADCAST_BYTES = 500_000, 16_000_000
# rids (one number each) that may be broadcast
BROADCAST_RIDS = 2_000_000

# The kinds' patterns, written so that a failing run of characters is tried
# once (possessive repeats; a match starts at a run's start or where the last
# match ended): linear in the text and free of recursion.
_LOCAL = "A-Za-z0-9._%+-"
PATTERNS = {
    "email": rf"(?:\G|(?<![{_LOCAL}]))[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])[0-9](?:[ -]?[0-9])++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
# what a text must have for its kind's pattern to be tried
_HINTS = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9](?:[ -]?[0-9]){15}", "phone": r"\+[0-9]"}
TERM = r"\p{L}+"
# marks around a found term; where a text has them itself, they count as spaces
_OPEN, _CLOSE = "\ue000", "\ue001"


def _valid(kind: Column, value: Column) -> Column:
    """Whether a match passes its kind's check."""
    digits = F.regexp_replace(value, "[^0-9]", "")
    n = F.length(digits)
    parts = F.transform(F.split(value, r"\."), lambda p: F.ltrim(p, F.lit("0")))
    small = F.forall(parts, lambda p: (F.length(p) <= 3) & (F.coalesce(p.try_cast("int"), F.lit(0)) <= 255))
    backwards = F.split(F.reverse(digits), "")
    doubled = F.transform(backwards, lambda d, i: F.when(i % 2 == 0, d.try_cast("int")).otherwise(
        F.pmod(2 * d.try_cast("int"), F.lit(10)) + F.floor(d.try_cast("int") / 5).cast("int")))
    luhn = F.aggregate(F.filter(doubled, lambda d: d.isNotNull()), F.lit(0), lambda a, d: a + d) % 10 == 0
    return (F.when(kind == "ip", small).when(kind == "card", n.between(16, 19) & luhn)
            .when(kind == "phone", n.between(8, 15)).otherwise(F.lit(True)))


def _matches(kind: str) -> Column:
    """Array of (kind, gap, value): the matches of a kind in ``text`` and the
    length of the text between them."""
    pattern = PATTERNS[kind]
    hint = F.contains(F.col("text"), F.lit("@")) if kind == "email" else F.col("text").rlike(_HINTS[kind])
    between = F.split("text", pattern, -1)
    found = F.regexp_extract_all("text", F.lit(pattern), F.lit(0))
    pairs = F.zip_with(found, F.slice(between, 1, F.size(found)), lambda v, p: F.struct(
        F.lit(kind).alias("kind"), F.char_length(p).alias("gap"), v.alias("value")))
    return F.when(hint, pairs).otherwise(F.array().cast("array<struct<kind:string,gap:int,value:string>>"))


def base_matches(docs: DataFrame) -> DataFrame:
    """(rid, copies, kind, start, end, value) of the base kinds; copies: how
    often the row is there."""
    rows = with_row_key(docs).select("rid", F.concat(*[_matches(k) for k in PATTERNS]).alias("found"))
    rows = rows.where(F.size("found") > 0).groupBy("rid").agg(F.count("*").alias("copies"), F.first("found").alias("found"))
    rows = rows.select("rid", "copies", F.posexplode("found").alias("i", "m")).select("rid", "copies", "i", "m.*")
    upto = Window.partitionBy("rid", "kind").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    size = F.char_length("value")
    end = F.sum(F.col("gap") + size).over(upto)
    rows = rows.withColumn("end", end.cast("long")).withColumn("start", F.col("end") - size)
    rows = rows.where(_valid(F.col("kind"), F.col("value")))
    return rows.select("rid", "copies", "kind", "start", "end", "value")


def _prose() -> Column:
    """``text`` with its e-mails blanked, every character in its place."""
    between = F.split("text", PATTERNS["email"], -1)
    found = F.regexp_extract_all("text", F.lit(PATTERNS["email"]), F.lit(0))
    blank = F.array_join(F.zip_with(between, found, lambda b, v: F.concat(
        b, F.repeat(F.lit(" "), F.char_length(F.coalesce(v, F.lit("")))))), "")
    return F.when(F.contains(F.col("text"), F.lit("@")), blank).otherwise(F.col("text"))


def _distinct_terms() -> Column:
    found = F.array_distinct(F.transform(F.split(_prose(), r"\P{L}+", -1), F.lower))
    return F.filter(found, lambda t: F.char_length(t) >= MIN_TERM)


def _sized(terms: DataFrame) -> DataFrame:
    """Broadcast a written table of terms only if its rows and bytes are few."""
    n, size = terms.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("term")), F.lit(0))).first()
    return F.broadcast(terms) if n <= BROADCAST_TERMS and size <= BROADCAST_BYTES else terms


def _texts_of(docs: DataFrame, found: DataFrame) -> DataFrame:
    """The texts of the rids of a written table, with its columns: the few that
    are in it are kept before the join, so that no others are shuffled."""
    rows = with_row_key(docs).select("rid", "text")
    if found.count() <= BROADCAST_RIDS:
        rows = rows.join(F.broadcast(found.select("rid")), "rid", "left_semi")
    return rows.join(found.hint("merge"), "rid")


def term_documents(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """(term, docs): in how many documents of the corpus each of ``terms`` is."""
    found = with_row_key(docs).select(F.explode(_distinct_terms()).alias("term"))
    return found.join(_sized(terms), "term").groupBy("term").agg(F.count("*").alias("docs"))


def shared_entities(base: DataFrame, n_docs: int) -> DataFrame:
    """(rid, entities, most): the entities of a document that a term can
    disclose, with their documents, and the most documents one has."""
    entities = base.select("rid", "copies", F.concat_ws(":", "kind", "value").alias("entity")).distinct()
    counts = entities.groupBy("entity").agg(F.sum("copies").alias("entity_docs"))
    counts = counts.where((F.col("entity_docs") >= MIN_DOCS) & (F.col("entity_docs") * 2.0 ** BITS <= F.lit(n_docs)))
    return (entities.join(counts, "entity").groupBy("rid")
            .agg(F.collect_list(F.struct("entity", "entity_docs")).alias("entities"), F.max("entity_docs").alias("most")))


def disclosing_terms(docs: DataFrame, base: DataFrame) -> DataFrame:
    """(term, disclosure, share): the terms whose disclosure of an entity is
    above the thresholds, with the highest of each."""
    n_docs = docs.count()
    shared = materialise(shared_entities(base, n_docs), "shared_entities")
    met = _texts_of(docs, shared).select("entities", "most", F.explode(_distinct_terms()).alias("term"))
    terms = materialise(met.groupBy("term").agg(F.count("*").alias("n"), F.max("most").alias("most"))
                        .where(F.col("n") >= MIN_DOCS).select("term", "most"), "candidate_terms")
    in_docs = term_documents(docs, terms.select("term")).join(terms, "term")
    in_docs = materialise(in_docs.where(F.col("docs") * GENERALISE <= F.col("most")).select("term", "docs"), "term_documents")
    pairs = met.select("entities", "term").join(_sized(in_docs), "term")
    pairs = pairs.select("term", "docs", F.explode("entities").alias("e")).where(
        F.col("docs") * GENERALISE <= F.col("e.entity_docs"))
    together = pairs.groupBy("term", "e.entity").agg(
        F.count("*").alias("both"), F.first("docs").alias("docs"), F.first("e.entity_docs").alias("entity_docs"))
    scored = (together.where(F.col("both") >= MIN_DOCS)
              .withColumn("share", F.col("both") / F.col("docs"))
              .withColumn("disclosure", F.log2(F.col("share") * F.lit(n_docs) / F.col("entity_docs")))
              .where((F.col("share") >= GENERALISE) & (F.col("disclosure") >= BITS)))
    return scored.groupBy("term").agg(F.max("disclosure").alias("disclosure"), F.max("share").alias("share"))


def term_matches(docs: DataFrame, chosen: DataFrame) -> DataFrame:
    """(rid, start, end, disclosure, share): every occurrence of the terms."""
    rows, known = with_row_key(docs), _sized(chosen)
    having = rows.select("rid", F.explode(_distinct_terms()).alias("term")).join(known, "term")
    having = materialise(having.groupBy("rid").agg(F.collect_set("term").alias("terms")), "documents_with_terms")
    text = F.translate(_prose(), _OPEN + _CLOSE, "  ")
    texts = _texts_of(docs, having).select("rid", "terms", text.alias("text"))
    found, gaps = F.regexp_extract_all("text", F.lit(TERM), F.lit(0)), F.split("text", TERM, -1)
    token = lambda t: F.when(
        F.array_contains("terms", F.lower(t)), F.concat(F.lit(_OPEN), t, F.lit(_CLOSE))).otherwise(t)
    marked = texts.select("rid", F.array_join(F.zip_with(
        gaps, found, lambda g, t: F.concat(g, F.when(t.isNull(), "").otherwise(token(t)))), "").alias("text"))
    mark = f"{_OPEN}[^{_CLOSE}]*+{_CLOSE}"
    between, hits = F.split("text", mark, -1), F.regexp_extract_all("text", F.lit(mark), F.lit(0))
    places = F.zip_with(hits, F.slice(between, 1, F.size(hits)), lambda h, p: F.struct(
        F.char_length(p).alias("gap"), F.translate(h, _OPEN + _CLOSE, "").alias("value")))
    placed = marked.select("rid", places.alias("found")).groupBy("rid").agg(F.first("found").alias("found"))
    placed = placed.select("rid", F.posexplode("found").alias("i", "m")).select("rid", "i", "m.*")
    size = F.char_length("value")
    upto = Window.partitionBy("rid").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    placed = placed.withColumn("end", F.sum(F.col("gap") + size).over(upto).cast("long"))
    placed = placed.select("rid", (F.col("end") - size).alias("start"), "end", F.lower("value").alias("term"))
    return placed.join(known, "term").select("rid", "start", "end", "disclosure", "share")


def find_personal_data(docs: DataFrame) -> DataFrame:
    """(doc_id, rid, spans) of every document; spans are (kind, start, end,
    removed), sorted by kind as in ``KINDS``, then start."""
    base = materialise(base_matches(docs), "base_matches")
    terms = term_matches(docs, materialise(disclosing_terms(docs, base), "disclosing_terms"))
    hidden = base.select("rid", "start", "end", "kind", F.lit(False).alias("removed")).unionByName(
        terms.select("rid", "start", "end", F.lit("term").alias("kind"), (F.col("share") >= REMOVE).alias("removed")))
    order = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind")).cast("int")
    span = F.struct(order.alias("order"), "start", "end", "kind", "removed")
    per_doc = hidden.groupBy("rid").agg(F.sort_array(F.collect_list(span)).alias("spans"))
    kept = F.transform(F.coalesce("spans", F.array()), lambda s: F.struct(
        s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["removed"].alias("removed")))
    return with_row_key(docs).select("doc_id", "rid").join(per_doc, "rid", "left").select("doc_id", "rid", kept.alias("spans"))


def sanitise(docs: DataFrame, found: DataFrame) -> DataFrame:
    """(doc_id, rid, text): entities and generalised terms replaced by their
    kind in brackets, removed terms cut out; of overlapping spans the one that
    starts first (the longer, if both do) stands for the rest."""
    spans = F.sort_array(F.transform("spans", lambda s: F.struct(
        s["start"].alias("start"), (-s["end"]).alias("before"), s["kind"].alias("kind"), s["removed"].alias("removed"))))
    rows = with_row_key(docs).join(found.select("rid", spans.alias("spans")).dropDuplicates(["rid"]), "rid", "left")
    step = lambda acc, s: F.when(s["start"] < acc["at"], acc).otherwise(F.struct(
        (-s["before"]).alias("at"),
        F.concat(acc["out"], F.substring(F.col("text"), (acc["at"] + 1).cast("int"), (s["start"] - acc["at"]).cast("int")),
                 F.when(s["removed"], "").otherwise(F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]")))).alias("out")))
    start = F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("out"))
    done = F.aggregate(F.coalesce("spans", F.array()), start, step)
    rows = rows.withColumn("done", done)
    tail = F.substring(F.col("text"), (F.col("done.at") + 1).cast("int"), F.char_length("text"))
    return rows.select("doc_id", "rid", F.concat("done.out", tail).alias("text"))


def count_of(kind: str) -> Column:
    return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")


def joined(base_only: bool) -> Column:
    """kind:start:end of the spans, comma-joined."""
    chosen = F.filter("spans", lambda s: s["kind"] != "term") if base_only else F.col("spans")
    return F.array_join(F.transform(chosen, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
