"""A corpus pipeline: language, near-duplicates, repeated passages, benchmark leaks, tokens."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sectorlens.llm import bpe, dart_minhash, decontam, langid, substring_dedup
from sectorlens.llm.common import ensure_checkpoint_dir, read, ready, tables_dropped
from sectorlens.llm.queries import tokenizer
from sectorlens.llm.superkmers import row_key

#: Of the texts of a learnt language that many at most, as a share, are rejected: the least evidence of a language is this quantile of the evidence of its labelled rows kept from learning.
REJECTED = 0.001
#: The least evidence where no labelled row was kept from learning.
LEAST_EVIDENCE = 0.6


def evidence() -> Column:
    """The score and its greatest possible standard error, twice: a text of few n-grams tells little against its language. One rule for all lengths."""
    return F.col("_score") + 1 / F.sqrt(F.greatest("_n", F.lit(1)))


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a letter and those that speak less for any learnt language than its own texts do; sets no column. Labels only teach."""
    ready(spark)
    model = langid.learn(docs.where(~langid.held_out()))
    found = langid.identify(docs, model, lang_pred="_lang_pred", score="_score", n_grams="_n")
    right = langid.identify(docs.where(langid.held_out() & F.col("lang").isNotNull()).select("text", "lang"), model, lang_pred="_lang_pred", score="_score", n_grams="_n").where("lang = _lang_pred")
    known = {r.lang: r.least for r in right.groupBy("lang").agg(F.percentile_approx(evidence(), REJECTED, 100_000).alias("least")).collect()}
    least = F.lit(LEAST_EVIDENCE)
    for name in model.languages:
        least = F.when(F.col("_lang_pred") == name, known.get(name, LEAST_EVIDENCE)).otherwise(least)
    return found.where((F.col("_lang_pred") != langid.UNKNOWN) & (evidence() >= least)).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the first document of each group, by id and text hash; rows without an id stay. Rows equal in id and text become one."""
    ready(spark)
    found = dart_minhash.near_duplicates(docs, class_id="_class", first="_first").where("doc_id is null or _first")
    k1, k2 = row_key(found, "doc_id", "text")
    first = found.where("doc_id is not null").select(*docs.columns, k1.alias("_k1"), k2.alias("_k2")).dropDuplicates(["_k1", "_k2"])
    return first.select(*docs.columns).unionByName(found.where("doc_id is null").select(*docs.columns))


def substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts repeated passages out of the texts; a document of which nothing is left goes."""
    ready(spark)
    cut = substring_dedup.remove_repeats(docs, out="_kept", n_words="_words", n_removed="_removed")
    cut = cut.withColumn("text", F.when(F.col("_removed") > 0, F.col("_kept")).otherwise(F.col("text")))
    cut = cut.withColumn("n_chars", F.when(F.col("_removed") > 0, F.char_length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return cut.where("_removed = 0 or _removed < _words").select(*docs.columns)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a window of a benchmark item."""
    found = decontam.contamination(docs, read(spark, sf_dir, "benchmark"))
    return found.where("n_hit = 0").select(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids and their number beside the document's columns; the text gives way to what the ids decode to."""
    ready(spark)
    coded = bpe.encode(docs, tokenizer("word_bpe_49k.json"), ids="ids", decoded="decoded")
    return coded.withColumn("n_tokens", F.size("ids").cast("long")).drop("text")


STAGES = [("language_id", language), ("near_duplicates", near_duplicates), ("substring_dedup", substrings), ("decontamination", decontaminate), ("bpe_encoding", encode)]

#: Near-duplicate classes and Bloom filters have no SQL form; tests/llm/test_pipeline.py compares run() with a plain version on planted documents.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder and read again."""
    import uuid

    ensure_checkpoint_dir(spark)
    folder = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/pipeline-{uuid.uuid4().hex}"
    docs = read(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        with tables_dropped():
            stage(spark, docs, sf_dir).write.parquet(f"{folder}/{i}-{name}")
        docs = spark.read.parquet(f"{folder}/{i}-{name}")
    return docs
