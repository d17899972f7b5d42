"""Flagging drug starts before and after a point in time.

No admission's drug starts are paired with its cultures. Starts are cut into bins as
wide as the window, and each (admission, bin) keeps four times. A window that ends at a
time t can only reach the bin of t and the bin before it, so those four times decide
exactly whether a start lies inside:

- in the bin before, the last start is the one nearest to t;
- in the bin of t, any start before t is less than one window away;
- the same holds mirrored for the window after t.

The drug side of the join is therefore one row per key, with minima and maxima combined
in each task before the shuffle, and a hot admission spreads over its bins.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from staycohort import vocabulary as v
from staycohort.functions import all_known, bin_start, lower_in
from staycohort.operators.lookup import join_lookup


def listed_starts(prescriptions: DataFrame, drugs=v.TREATMENT_DRUGS) -> DataFrame:
    """Admission and start time of every listed drug."""
    listed = lower_in("drug", drugs) & all_known("hadm_id", "starttime")
    return prescriptions.where(listed).select("hadm_id", "starttime")


def treated_ever_before(
    df: DataFrame,
    prescriptions: DataFrame,
    at: str = "charttime",
    flag: str = "has_prior_treatment",
    drugs=v.TREATMENT_DRUGS,
    spread: str | None = None,
) -> DataFrame:
    """Add a boolean flag: some listed drug of the admission started before `at`.

    The earliest start of the admission answers that; no range join is needed.
    """
    earliest = (
        listed_starts(prescriptions, drugs)
        .groupBy("hadm_id")
        .agg(F.min("starttime").alias("_earliest"))
    )
    return (
        join_lookup(df, earliest, ["hadm_id"], "left", spread)
        .withColumn(flag, F.expr(f"coalesce(_earliest < {at}, false)"))
        .drop("_earliest")
    )


def treatment_exposure(
    df: DataFrame,
    prescriptions: DataFrame,
    before: int | None = v.WINDOW_HOURS,
    after: int | None = v.WINDOW_HOURS,
    at: str = "charttime",
    prior_flag: str = "has_prior_treatment",
    post_flag: str = "has_post_treatment",
    drugs=v.TREATMENT_DRUGS,
    spread: str | None = None,
) -> DataFrame:
    """Add boolean flags for listed drugs started around `at`.

    prior: start in [at - before, at). post: start in [at, at + after]. Widths are in whole
    hours: None leaves that flag out, 0 makes prior false and post a start at `at` itself,
    a negative one raises ValueError. Equal widths share one join. A column of `df` that is
    named like a flag to be added is replaced.
    """
    if any(width is not None and width < 0 for width in (before, after)):
        raise ValueError("a width must not be negative")
    added = [flag for flag, width in ((prior_flag, before), (post_flag, after)) if width is not None]
    starts, df = listed_starts(prescriptions, drugs), df.drop(*added)
    if before == 0:
        df = df.withColumn(prior_flag, F.lit(False))
    columns = df.columns
    for hours in dict.fromkeys(width for width in (before, after) if width):
        width = f"INTERVAL '{hours}' HOUR"
        flags = []
        if hours == before:
            near = f"_first < {at} OR _last_before >= {at} - {width}"
            flags.append((prior_flag, near))
        if hours == after:
            near = f"_last >= {at} OR _first_after <= {at} + {width}"
            flags.append((post_flag, near))
        df = join_lookup(
            df.withColumn("_bin", bin_start(at, hours)),
            _starts_around_bin(starts, hours),
            ["hadm_id", "_bin"],
            "left",
            spread,
        ).selectExpr(*columns, *[f"coalesce({near}, false) AS {flag}" for flag, near in flags])
        columns = df.columns
    if after == 0:
        exact = starts.selectExpr("hadm_id", "starttime AS _at", "true AS _hit").distinct()
        df = join_lookup(
            df.withColumn("_at", F.expr(at)), exact, ["hadm_id", "_at"], "left", spread
        ).selectExpr(*columns, f"coalesce(_hit, false) AS {post_flag}")
    return df


def _starts_around_bin(starts: DataFrame, hours: int) -> DataFrame:
    """Per (admission, bin): first and last start in it, last before, first after."""
    return (
        starts.selectExpr("*", f"explode(array(-{hours}, 0, {hours})) AS _shift")
        .groupBy("hadm_id", bin_start("starttime", hours, "_shift").alias("_bin"))
        .agg(
            F.expr("min(CASE WHEN _shift = 0 THEN starttime END) AS _first"),
            F.expr("max(CASE WHEN _shift = 0 THEN starttime END) AS _last"),
            F.expr("max(CASE WHEN _shift > 0 THEN starttime END) AS _last_before"),
            F.expr("min(CASE WHEN _shift < 0 THEN starttime END) AS _first_after"),
        )
    )


def untreated_then_treated(df: DataFrame) -> DataFrame:
    """Rows without prior treatment and with treatment afterwards."""
    return df.where("NOT has_prior_treatment AND has_post_treatment")
