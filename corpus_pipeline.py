"""The corpus pipeline: five stages over ``documents``.

Each stage takes (spark, docs, sf_dir), works on everything its predecessor
kept and returns a DataFrame, which is written as Parquet and reread as the
next stage's docs. All but the last return the columns of ``documents``:

1. toxicity: documents scored toxic (0.5 or more) go;
2. line dedup: lines found in 10 documents or more go, ``text`` and
   ``n_chars`` are what is left;
3. SimHash near-dedup: of each group the document with the smallest doc_id stays;
4. benchmark decontamination: documents with a hit word go;
5. best-fit packing: what is left as packed pieces.

Documents that no stage objects to keep their text and columns. A row whose
doc_id is null is kept or dropped like any other: in near-dedup a group member
that has a doc_id goes before it. Rows that repeat doc_id and text get the same
decisions; near-dedup keeps one row of each group. An empty table passes every
stage as an empty table.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from logloom.llm import decontam, line_dedup, packing, simhash, toxicity
from logloom.llm.catalog import table, tokenizer_path
from logloom.llm.common import with_row_key
from logloom.session import ensure_checkpoint_dir

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
# no SQL expresses a conditional random field
ORACLE_SQL = None


def keyed(docs: DataFrame) -> DataFrame:
    """The columns of documents and their row key, as the operators make it."""
    rows = docs.select(*COLUMNS)
    body = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return rows.withColumn("rid", F.xxhash64("doc_id", body))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    scored = toxicity.score_documents(docs, table(spark, sf_dir, "labels"))
    toxic = scored.where("predicted = 1").select("rid").distinct()
    return keyed(docs).join(toxic, "rid", "left_anti").select(*COLUMNS)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    bitmaps = line_dedup.keep_bitmaps(docs, min_docs=10, min_chars=1)
    lines = F.split("text", "\n", -1)
    kept = F.array_join(F.flatten(F.transform("keep_runs", lambda r: F.slice(lines, r["start"] + 1, r["length"]))), "\n")
    rows = keyed(docs).join(bitmaps, "rid", "left").withColumn("kept", kept)
    return rows.select("doc_id", F.coalesce("kept", "text").alias("text"), "lang", "source",
                       F.coalesce(F.char_length("kept").cast("long"), "n_chars").alias("n_chars"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    groups = simhash.near_dedup(docs, shingle=4, radius=4)
    kept = groups.where(F.col("doc_id").eqNullSafe(F.col("component_id")))
    chosen = kept.groupBy("group").agg(F.min("rid").alias("rid")).select("rid")
    rows = keyed(docs).join(chosen, "rid")
    again = Window.partitionBy("rid").orderBy("lang", "source", "n_chars")
    return rows.withColumn("nth", F.row_number().over(again)).where("nth = 1").select(*COLUMNS)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = decontam.contaminated_words(docs, table(spark, sf_dir, "benchmark"), window=10)
    hit = found.where("n_hit > 0").select("rid").distinct()
    return keyed(docs).join(hit, "rid", "left_anti").select(*COLUMNS)


def pack_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = packing.pack(docs, tokenizer_path(), 4096, 1, with_ids=False)
    return out.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", drop_lines),
    ("simhash near-dedup", drop_near_copies),
    ("benchmark decontamination", drop_contaminated),
    ("best-fit packing", pack_documents),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written into the shared folder."""
    docs = table(spark, sf_dir, "documents")
    base = f"{ensure_checkpoint_dir(spark).rstrip('/')}/corpus-pipeline-{uuid.uuid4().hex[:12]}"
    for number, (_, stage) in enumerate(STAGES):
        path = f"{base}/{number}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs


def all_queries() -> dict:
    return {"pipeline": run}


def all_oracles() -> dict[str, str]:
    return {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}
