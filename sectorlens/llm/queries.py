"""Registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, dart_minhash, decontam, imatch, langid, prefix_counts, substring_dedup, suffix_dedup, tag_paths, url_filter
from .common import read, ready

TOKENIZERS: str | None = None  # a folder of tokenizer files; None: the installed public_tokenizers
RULES = (
    url_filter.Rule("com", "/en/", "block"),
    url_filter.Rule("example.com", "/en/7", "allow"),
    url_filter.Rule("net", "/de/", "block"),
    url_filter.Rule("example.net", "/de/8", "block"),
    url_filter.Rule("org", "/es/", "block"),
)


def tokenizer(name: str) -> str:
    if TOKENIZERS:
        return f"{TOKENIZERS}/{name}"
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = bpe.encode(read(spark, sf_dir, "documents").select("doc_id", "text"), tokenizer("word_bpe_49k.json"), decoded="decoded")
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join("ids", " "), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = langid.learn(docs.where(~langid.held_out()))
    return langid.identify(docs.select("doc_id", "text", langid.held_out().alias("held_out")), model, keep_text=False)


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.contamination(read(spark, sf_dir, "documents").select("doc_id", "text"), read(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = substring_dedup.remove_repeats(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op5_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dart_minhash.near_duplicates(read(spark, sf_dir, "documents").select("doc_id", "text"), first="is_first").select("doc_id", "class_id", "is_first")


def op6_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return imatch.with_next(docs, imatch.lexicon(docs))


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = suffix_dedup.remove_repeats(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op8_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tag_paths.extract(read(spark, sf_dir, "pages").select("page_id", "url", "html")).withColumn("n_chars", F.char_length("text").cast("long"))


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = url_filter.judge(read(spark, sf_dir, "pages").select("page_id", "url"), RULES, url_filter.learn(spark))
    return judged.select("page_id", "host", "path", "rule", "verdict", "score")


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = prefix_counts.token_counts(read(spark, sf_dir, "documents").select("doc_id", "text"), tokenizer("piece_bpe_32k.model"), budget=4096)
    return counted.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), "n_tokens", (F.col("n_tokens") > 4096).alias("over_limit"), "cut_chars")


def shipped(query: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ready(spark)
        return query(spark, sf_dir)

    return run


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: shipped(f)
    for f in (op1_bpe_codec, op2_language_id, op3_decontamination, op4_substring_dedup, op5_near_duplicates, op6_fingerprints, op7_suffix_dedup, op8_html_extraction, op9_url_filter, op10_token_counts)
}

WORDS_SQL = r"list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '')"

ORACLE_SQL: dict[str, str] = {
    "op3_decontamination": f"""
WITH d AS (SELECT doc_id, {WORDS_SQL} AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, {WORDS_SQL} AS w FROM benchmark),
bw AS (SELECT DISTINCT item, least(10, len(w)) AS n, array_to_string(w[s + 1:s + least(10, len(w))], ' ') AS g
       FROM (SELECT item, w, unnest(range(len(w) - least(10, len(w)) + 1)) AS s FROM b WHERE len(w) > 0)),
ns AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT doc_id, n, s, array_to_string(w[s + 1:s + n], ' ') AS g
       FROM (SELECT doc_id, w, n, unnest(range(len(w) - n + 1)) AS s FROM d, ns WHERE len(w) >= n)),
h AS (SELECT dw.doc_id, dw.s, dw.n, bw.item FROM dw JOIN bw ON dw.n = bw.n AND dw.g = bw.g),
p AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + n)) AS q FROM h) GROUP BY doc_id),
i AS (SELECT doc_id, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM h GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(p.n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(i.n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(i.items, '')) AS items_sha256, coalesce(p.n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN p USING (doc_id) LEFT JOIN i USING (doc_id)""",
    "op4_substring_dedup": r"""
WITH d AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents),
x AS (SELECT doc_id, s, sha256(array_to_string(w[s + 1:s + 35], ' ')) AS g FROM (SELECT doc_id, w, unnest(range(len(w) - 34)) AS s FROM d WHERE len(w) >= 35)),
r AS (SELECT g FROM x GROUP BY g HAVING count(*) > 1),
p AS (SELECT DISTINCT doc_id, unnest(range(s, s + 35)) AS q FROM x JOIN r USING (g)),
c AS (SELECT d.doc_id, u.q, d.w[u.q + 1] AS word FROM d, (SELECT doc_id, unnest(range(len(w))) AS q FROM d) u WHERE u.doc_id = d.doc_id),
k AS (SELECT c.doc_id, string_agg(c.word, ' ' ORDER BY c.q) AS t, count(*) AS n FROM c ANTI JOIN p ON c.doc_id = p.doc_id AND c.q = p.q GROUP BY c.doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(len(d.w) - coalesce(k.n, 0) AS BIGINT) AS n_removed, sha256(coalesce(k.t, '')) AS kept_sha256
FROM d LEFT JOIN k USING (doc_id)""",
}
