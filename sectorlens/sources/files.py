"""File sources and sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schema import source_schema


def party_csv(spark: SparkSession, path: str, payloads: int = 1, quoted: bool = False) -> DataFrame:
    """id and payload columns p1..pW of a headerless CSV; a row of another width raises."""
    schema = T.StructType([T.StructField(c, T.StringType()) for c in ("id", *(f"p{i + 1}" for i in range(payloads)))])
    return spark.read.schema(schema).csv(path, header=False, quote='"' if quoted else "", mode="FAILFAST", ignoreLeadingWhiteSpace=False)


def source_csv(spark: SparkSession, path: str, attributes: dict[str, int], header: bool = True) -> DataFrame:
    return spark.read.schema(source_schema(attributes)).csv(path, header=header, mode="FAILFAST")


def binary_blocks(spark: SparkSession, path: str, width: int = 16) -> DataFrame:
    """Fixed-width records of binary files as hex; a file whose size width doesn't divide raises."""
    files = spark.read.format("binaryFile").load(path)
    size = F.when(F.col("length") % width == 0, F.col("length") / width).otherwise(F.raise_error(F.lit("file size is not a multiple of the record width"))).cast("int")
    at = F.explode(F.when(size > 0, F.sequence(F.lit(0), size - 1)).otherwise(F.array().cast("array<int>")))
    return files.select("path", "content", at.alias("i")).select("path", "i", F.lower(F.hex(F.substring("content", F.col("i") * width + 1, F.lit(width)))).alias("id"))


def block_id(raw: Column) -> Column:
    """32 hex digits as they are; other text right-aligned in 16 bytes as hex."""
    text = F.lower(F.hex(raw.cast("binary")))
    return F.when(raw.rlike("^[0-9A-Fa-f]{32}$"), F.lower(raw)).otherwise(F.lpad(text, 32, "0"))


def write_pairs_csv(joined: DataFrame, path: str) -> None:
    """Payload columns only; ids are not written."""
    joined.select(*(c for c in joined.columns if c != "id")).write.mode("overwrite").csv(path)


def write_release_json(released: DataFrame, path: str) -> None:
    released.select(F.to_json(F.struct(*released.columns)).alias("value")).write.mode("overwrite").text(path)


def hex_blocks(payload: Column, blocks: int) -> list[Column]:
    """A payload's bytes as so many 16-byte blocks in hex, filled up with zeros; a longer payload raises."""
    digits = F.lower(F.hex(payload.cast("binary")))
    checked = F.when(F.length(digits) <= 32 * blocks, F.rpad(digits, 32 * blocks, "0")).otherwise(F.raise_error(F.lit("a payload is longer than its blocks")))
    return [F.substring(checked, 32 * i + 1, 32) for i in range(blocks)]


def write_blocks_csv(joined: DataFrame, path: str, blocks: int = 1) -> None:
    """Payload columns as hex blocks, party by party; ids are not written."""
    joined.select(*(b.alias(f"{c}_b{i}") for c in joined.columns if c != "id" for i, b in enumerate(hex_blocks(F.col(c).cast("string"), blocks)))).write.mode("overwrite").csv(path)
