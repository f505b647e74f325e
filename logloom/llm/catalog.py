"""Registered queries of the training-data operators, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logloom.llm import bpe, collocations, decontam, licenses, line_dedup, packing, periodic, pii, pivots, simhash, suffix_array, suffix_tree, toxicity


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffix_array.remove_repeats(table(spark, sf_dir, "documents"), length=400, keep="none")
    return out.select("doc_id", "n_bytes", suffix_array.removed().alias("n_removed"),
                      F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = toxicity.score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return out.select("doc_id", "held_out", "score", "predicted", F.size("spans").cast("long").alias("n_spans"))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.dedup_lines(table(spark, sf_dir, "documents"), min_docs=10, min_chars=1)
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


def op4_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = licenses.scan_licenses(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_base", "first_word", "last_word",
                      F.array_join("base_labels", ",").alias("base_labels"), F.array_join("labels", ",").alias("labels"), "score")


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash.near_dedup(table(spark, sf_dir, "documents"), shingle=4, radius=4)
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = packing.pack(table(spark, sf_dir, "documents"), tokenizer_path(), 4096, 1, with_ids=False)
    return out.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op7_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pivots.near_dedup(table(spark, sf_dir, "embeddings"), threshold=0.98)


def op8_suffix_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffix_tree.remove_repeats(table(spark, sf_dir, "documents"), length=50)
    return out.select("doc_id", "n_words", suffix_array.removed().alias("n_removed"),
                      F.sha2("kept", 256).alias("kept_sha256"))


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pii.find_personal_data(table(spark, sf_dir, "documents"))
    return out.select("doc_id", *[pii.count_of(k).alias(f"n_{k}") for k in ("email", "ip", "card", "phone")],
                      F.sha2(pii.joined(True), 256).alias("base_sha256"), pii.joined(False).alias("spans"))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontam.contaminated_words(
        table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), window=10)
    return out.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def with_planted_runs(docs: DataFrame) -> DataFrame:
    """(doc_id, text): in every tenth document by crc32 of the doc_id the words
    from word a on repeat the p words that begin there. A null doc_id has none."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    g = F.floor(h / 10)
    words = F.filter(F.split(F.coalesce(F.col("text"), F.lit("")), r"[\x20\x09-\x0D]+", -1), lambda w: w != "")
    rows = docs.select("doc_id", "text", g.alias("g"), F.when(h % 10 == 0, words).alias("words"))
    rows = rows.withColumn("n", F.size("words").cast("long")).withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n")))
    rows = rows.withColumn("p", 1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8)))
    n, a, p = F.col("n"), F.col("a"), F.col("p")
    tail = F.flatten(F.array_repeat(F.slice("words", (a + 1).cast("int"), p.cast("int")), F.ceil((n - a) / p).cast("int")))
    planted = F.concat(F.slice("words", F.lit(1), a.cast("int")), F.slice(tail, F.lit(1), (n - a).cast("int")))
    return rows.select("doc_id", F.when(a.isNotNull(), F.array_join(planted, " ")).otherwise(F.col("text")).alias("text"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = periodic.find_runs(with_planted_runs(table(spark, sf_dir, "documents")), min_length=6, min_exponent=4)
    out = out.withColumn("best", periodic.strongest())
    listed = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    return out.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(F.array_join(F.transform(listed, lambda r: F.concat(r, F.lit("\n"))), ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"))


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = collocations.collocations(table(spark, sf_dir, "documents"), max_words=4, min_count=30, cover_percent=80, top=2000)
    return out.select(F.col("grp").alias("lang"), "rank", "phrase", "a", "l", "r", "n", "score")


def op13_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = bpe.decode(bpe.encode(table(spark, sf_dir, "documents"), tokenizer_path()), tokenizer_path())
    return out.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def all_queries() -> dict:
    return {f.__name__: f for f in (
        op1_suffix_array, op2_toxicity, op3_line_dedup, op4_licenses, op5_simhash, op6_packing, op7_embeddings, op8_suffix_tree, op9_pii,
        op10_decontamination, op11_periodic_runs, op12_collocations, op13_bpe)}


def all_oracles() -> dict[str, str]:
    from logloom.llm.oracle import ORACLES

    return dict(ORACLES)
