"""Selecting cultures and linking them to stays."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from staycohort import vocabulary as v
from staycohort.functions import (
    all_known,
    antibiotic_class,
    contains_any,
    interpretation_rank,
    lower_in,
    quoted_list,
)
from staycohort.operators.lookup import join_lookup

# Ids of one time are numbered in blocks of 2^12.
_ID_BLOCK_BITS = 12


def stay_cultures(stays: DataFrame, cultures: DataFrame) -> DataFrame:
    """Every culture of an admission, once for every stay of that admission.

    Cultures without an admission match nothing. The result is the full N:M detail:
    reduce the culture side first where the detail itself is not wanted.
    """
    return stays.drop("subject_id").join(cultures, "hadm_id")


def admissions_of(cultures: DataFrame) -> DataFrame:
    """Distinct admissions; deduplicated in each task before anything is shuffled."""
    return cultures.where(all_known("hadm_id")).select("hadm_id").distinct()


def stays_with(stays: DataFrame, cultures: DataFrame, spread: str | None = None) -> DataFrame:
    """Stays of the admissions that have at least one of the cultures."""
    return join_lookup(stays, admissions_of(cultures), ["hadm_id"], "left_semi", spread)


def stays_per_admission(stays: DataFrame) -> DataFrame:
    """Number of stays of each admission.

    A stay has one admission, so these numbers add up to a distinct count of stays. They
    are counted from (admission, stay) pairs: no task sees all stays of an admission.
    """
    return stays.groupBy("hadm_id").agg(F.count_distinct("stay_id").alias("stays"))


def first_stays(stays: DataFrame, count: int) -> DataFrame:
    """The `count` lowest stay_ids of each admission; cut in every task before the shuffle."""
    by_id = Window.partitionBy("hadm_id").orderBy("stay_id")
    places = stays.select("stay_id", "hadm_id").withColumn("_place", F.dense_rank().over(by_id))
    return places.where(f"_place <= {count}").drop("_place")


def target_organisms(
    df: DataFrame, mode: str = "contains", organisms=v.TARGET_ORGANISMS
) -> DataFrame:
    """Rows whose organism is a target: by part of the name, or by the exact name."""
    if mode not in ("contains", "exact"):
        raise ValueError(f"mode must be 'contains' or 'exact', not {mode!r}")
    matches = contains_any if mode == "contains" else lower_in
    return df.where(matches("org_name", organisms))


def exclude_specimens(df: DataFrame, specimens=v.EXCLUDED_SPECIMENS) -> DataFrame:
    """Drop the listed specimen types, and rows without a specimen type."""
    return df.where(all_known("spec_type_desc") & ~lower_in("spec_type_desc", specimens))


def tested_cultures(df: DataFrame, interpretations=v.INTERPRETATIONS) -> DataFrame:
    """Rows with a susceptibility result, a time, an admission and an organism."""
    return df.where(
        F.expr(f"interpretation IN ({quoted_list(interpretations)})")
        & all_known("charttime", "hadm_id", "org_name")
    )


def with_antibiotic_class(df: DataFrame) -> DataFrame:
    """Add antibiotic_class."""
    return df.withColumn("antibiotic_class", antibiotic_class("ab_name"))


def representative_culture(df: DataFrame, keys=("stay_id", "org_name")) -> DataFrame:
    """One culture per key: best result, then earliest, then lowest microevent_id.

    Spark keeps only the first row of each key in every task before the shuffle, so a
    hot key arrives as one row per task.
    """
    preference = Window.partitionBy(*keys).orderBy(
        interpretation_rank("interpretation"), "charttime", "microevent_id"
    )
    place = F.row_number().over(preference)
    return df.withColumn("_place", place).where("_place = 1").drop("_place")


def numbered_cultures(df: DataFrame, keys=("stay_id", "org_name")) -> DataFrame:
    """Add row_num, the place of each culture in the order of `representative_culture`.

    Rows are numbered inside buckets of one key, result, time and block of ids, which may
    be small even where a key is charted at a single instant. A bucket starts after the
    earlier ones of its hour, an hour after the earlier hours; only one count per bucket
    or hour meets in these sums. The bucket is one column, so the rows are dealt out once.
    """
    bucket = F.struct(
        *keys,
        interpretation_rank("interpretation").alias("_rank"),
        F.date_trunc("hour", F.col("charttime")).cast("timestamp_ntz").alias("_hour"),
        F.col("charttime").alias("_time"),
        F.shiftright("microevent_id", _ID_BLOCK_BITS).alias("_block"),
    )
    split = df.withColumn("_bucket", bucket)
    buckets = split.groupBy("_bucket").agg(F.count(F.lit(1)).alias("_rows")).select("*", "_bucket.*")
    hour = Window.partitionBy(*keys, "_rank", "_hour").orderBy("_time", "_block")
    key = Window.partitionBy(*keys).orderBy("_rank", "_hour")

    def earlier(window):
        rows = F.sum("_rows").over(window.rowsBetween(Window.unboundedPreceding, -1))
        return F.coalesce(rows, F.lit(0))

    hours = (
        buckets.groupBy(*keys, "_rank", "_hour")
        .agg(F.sum("_rows").alias("_rows"))
        .select(F.struct(*keys, "_rank", "_hour").alias("_of"), earlier(key).alias("_hour_offset"))
    )
    offsets = (
        buckets.select("_bucket", F.struct(*keys, "_rank", "_hour").alias("_of"), earlier(hour).alias("_offset"))
        .join(hours, "_of")
        .select("_bucket", (F.col("_offset") + F.col("_hour_offset")).alias("_before"))
    )
    in_bucket = Window.partitionBy("_bucket").orderBy("charttime", "microevent_id")
    place = (F.col("_in_bucket") + F.col("_before")).alias("row_num")
    return (
        split.withColumn("_in_bucket", F.row_number().over(in_bucket))
        # merged, so that the numbered rows keep their buckets' partitions: broadcast, either
        # side would leave them dealt out by the few (key, hour) pairs
        .join(offsets.hint("merge"), "_bucket")
        .select(*df.columns, place)
    )


def single_organism_stays(df: DataFrame, keys=("stay_id",)) -> DataFrame:
    """Keys whose rows name exactly one organism."""
    return (
        df.groupBy(*keys)
        .agg(F.count_distinct("org_name").alias("_organisms"))
        .where("_organisms = 1")
        .select(*keys)
    )


def distinct_cultures(
    df: DataFrame,
    keys=("stay_id", "hadm_id", "charttime", "org_name", "antibiotic_class", "interpretation"),
) -> DataFrame:
    """Distinct cultures; a stay with several organisms keeps one row for each."""
    return df.select(*keys).distinct()
