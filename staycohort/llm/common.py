"""Helpers shared by the operators of this folder."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows that one Arrow batch holds at most, so that a batch of long texts fits a Python worker.
ROWS_PER_BATCH = 1000


def small_batches(spark: SparkSession) -> None:
    """Bound the Arrow batches of the session that is about to run Python on texts."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ROWS_PER_BATCH))


def shared_folder(session: SparkSession) -> str:
    """The folder for checkpoints and written tables, which all executors share.

    It lies in the session's spark.checkpoint.dir. Only where all runs on one machine, as in
    tests, a temporary folder is made if that is unset; on a cluster that is an error.
    """
    context = session.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        shared = session.conf.get("spark.checkpoint.dir", None)
        if not shared and not re.fullmatch(r"local(\[[^\]]*\])?", context.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(shared or tempfile.mkdtemp(prefix="staycohort-"))
    return context._jsc.sc().getCheckpointDir().get()


def materialised(df: DataFrame) -> DataFrame:
    """`df` written to the shared folder, so that it is computed once."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def if_small(df: DataFrame, most_rows: int) -> DataFrame:
    """`df` with a broadcast hint if it has at most `most_rows` rows, else as it is.

    For a table of short rows that has been materialised or is cheap to count.
    """
    return F.broadcast(df) if df.limit(most_rows + 1).count() <= most_rows else df


def join_spread(left: DataFrame, right: DataFrame, key: str, by: list[str], parts: int = 64) -> DataFrame:
    """Inner join of `left` with a table that has one row per `key`, in up to `parts` parts a key.

    Rows of `left` go to parts by the columns `by`. The parts that a key has are listed first,
    reduced where the rows are, and the other side is repeated for these parts alone.
    """
    spread = left.withColumn("__part", F.pmod(F.xxhash64(*by), F.lit(parts)).cast("int"))
    present = spread.select(key, "__part").distinct().join(right, key)
    return spread.join(present, [key, "__part"]).drop("__part")


def words_of(text: str | None) -> list[bytes]:
    """The words `[^\\x20\\x09-\\x0D]+` of a text, as UTF-8 (null: none)."""
    return text.encode("utf-8", "surrogatepass").split() if text else []


def crc_of_id(column: str = "doc_id") -> Column:
    """crc32 of the id written as text; null for a null id."""
    return F.crc32(F.col(column).cast("string"))


def row_key() -> list[Column]:
    """Two columns that tell rows of different id or text apart; equal rows share them."""
    return [
        F.coalesce(F.col("doc_id"), F.lit(0).cast("bigint")).alias("key_id"),
        F.xxhash64(F.col("text"), F.col("doc_id").isNull(), F.col("text").isNull()).alias("key_text"),
    ]
