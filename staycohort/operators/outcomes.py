"""Resistance blocks, per-stay outcomes and the report per block."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from staycohort import vocabulary as v
from staycohort.functions import all_known, days_between, hours_between, resistance_block
from staycohort.operators.exposure import treatment_exposure
from staycohort.operators.lookup import join_lookup


def with_resistance_block(df: DataFrame) -> DataFrame:
    """Add bloque from org_name and antibiotic_class."""
    return df.withColumn("bloque", resistance_block("org_name", "antibiotic_class"))


def stay_windows(df: DataFrame, stays: DataFrame, spread: str | None = None) -> DataFrame:
    """Add intime and outtime of the row's stay; NULL where the stay is unknown.

    `spread` as in `join_lookup`; repeated stay rows repeat the row.
    """
    windows = stays.select("hadm_id", "stay_id", "intime", "outtime")
    return join_lookup(df, windows, ["hadm_id", "stay_id"], "left", spread)


_OUTCOME_KEYS = [
    "bloque",
    "stay_id",
    "hadm_id",
    "subject_id",
    "gender",
    "intime",
    "outtime",
    "deathtime",
]


def stay_outcomes(
    cases: DataFrame,
    patients: DataFrame,
    admissions: DataFrame,
    prescriptions: DataFrame,
) -> DataFrame:
    """One row of outcomes per block and stay.

    `cases` needs bloque, stay_id, hadm_id, subject_id, intime and outtime (see
    `stay_windows`).
    """
    complete = prescriptions.where(all_known("starttime", "stoptime"))
    people = cases.select("bloque", "stay_id", "hadm_id", "subject_id", "intime", "outtime")
    deaths, genders = admissions.select("hadm_id", "deathtime"), patients.select("subject_id", "gender")
    people = join_lookup(people, deaths, ["hadm_id"], "inner", "stay_id")
    people = join_lookup(people, genders, ["subject_id"], "inner", "stay_id")
    people = treatment_exposure(people, complete, after=None, at="intime", prior_flag="_prior")

    known = all_known("intime", "outtime")
    timed = _with_treatment_hours(people.where(known), complete).withColumn(
        "_days", days_between("intime", "outtime")
    )
    return _outcome_columns(
        timed,
        length="_days",
        hours="_hours",
        died="deathtime BETWEEN intime AND outtime",
        improved=f"deathtime IS NULL AND _days <= {v.IMPROVEMENT_MAX_DAYS}",
    ).unionByName(_untimed_outcomes(people.where(~known)))


def _outcome_columns(
    df: DataFrame, length: str, hours: str, died: str, improved: str
) -> DataFrame:
    return df.selectExpr(
        "bloque",
        "stay_id",
        "hadm_id",
        "subject_id",
        "gender",
        f"CAST({length} AS BIGINT) AS estancia_dias",
        f"CAST({hours} AS DOUBLE) AS duracion_tratamiento",
        "CAST(_prior AS INT) AS tratamiento_previo",
        f"IF({died}, 1, 0) AS fallecio_en_uci",
        f"IF({improved}, 1, 0) AS mejoria",
    )


def _untimed_outcomes(people: DataFrame) -> DataFrame:
    """Stays without a complete window have no length, hours, death in it or improvement.

    The length is a literal NULL, so a report that asks for a known length never runs this.
    """
    grouped = people.groupBy(*_OUTCOME_KEYS).agg(F.expr("bool_or(_prior) AS _prior"))
    return _outcome_columns(grouped, length="NULL", hours="NULL", died="false", improved="false")


# Days are counted from here, so that every timestamp's day is positive.
_DAY_ZERO = "DATE'0001-01-01'"
# Aligned ranges are 8^level days long; eight levels reach past the year 9999.
_LEVELS = "sequence(0, 21, 3)"


def _around(day: str, kind: int) -> str:
    """SQL for the aligned ranges around a day, one of each level."""
    return f"transform({_LEVELS}, b -> struct({kind} AS kind, b, shiftright({day}, b) AS place))"


def _tiles(first: str, last: str, kind: int) -> str:
    """SQL for aligned ranges that tile first to last: of each level those that fit, but
    not into one of the next level that fits. At most 14 a level."""
    low, high = f"shiftright({first} + shiftleft(1, b) - 1, b)", f"(shiftright({last} + 1, b) - 1)"
    up_low = f"shiftleft(shiftright({first} + shiftleft(8, b) - 1, b + 3), 3)"
    up_high = f"(shiftleft(shiftright({last} + 1, b + 3), 3) - 1)"
    none = "CAST(array() AS array<int>)"
    whole = f"IF({low} <= {high}, sequence({low}, {high}), {none})"
    left = f"IF({low} < {up_low}, sequence({low}, {up_low} - 1), {none})"
    right = f"IF({up_high} < {high}, sequence({up_high} + 1, {high}), {none})"
    places = f"IF({up_low} <= {up_high}, concat({left}, {right}), {whole})"
    return (
        f"flatten(transform({_LEVELS}, b -> "
        f"transform({places}, place -> struct({kind} AS kind, b, place))))"
    )


def _with_treatment_hours(people: DataFrame, complete: DataFrame) -> DataFrame:
    """Mean whole hours of the prescriptions that lie inside each stay, to one decimal.

    A stay lists the few aligned day ranges that tile it, a prescription the ranges around
    the day it starts, one of each level; a pair meets once, and a long stay costs few
    rows. A prescription that stops before it starts may begin before the stay and cover
    its first day; those two meet the other way round. Only prescriptions of the stays'
    admissions take part, equal ones counted together. No stay meets another stay: those
    without prescriptions are added after the join.
    """
    cases = people.groupBy(*_OUTCOME_KEYS).agg(F.expr("bool_or(_prior) AS _prior"))

    def day(time: str) -> str:
        return f"datediff({time}, {_DAY_ZERO})"

    begins, ends = day("least(starttime, stoptime)"), day("starttime")
    backward = f"IF(stoptime < starttime, {_tiles(f'({begins} + 1)', ends, 1)}, array())"
    orders = (
        complete.join(cases.select("hadm_id").distinct(), "hadm_id", "left_semi")
        .groupBy("hadm_id", "starttime", "stoptime")
        .agg(F.count(F.lit(1)).alias("_times"))
        .withColumn("_node", F.explode(F.expr(f"concat({_around(begins, 0)}, {backward})")))
    )
    enters, leaves = day("least(intime, outtime)"), day("greatest(intime, outtime)")
    nodes = F.expr(f"concat({_tiles(enters, leaves, 0)}, {_around(enters, 1)})")
    treated = (
        cases.withColumn("_node", F.explode(nodes))
        .join(orders, ["hadm_id", "_node"])
        .where("starttime >= intime AND stoptime <= outtime")
        .select(*cases.columns, hours_between("starttime", "stoptime").alias("_each"), "_times")
    )
    untreated = cases.withColumns({"_each": F.lit(0).cast("bigint"), "_times": F.lit(0).cast("bigint")})
    return (
        treated.unionByName(untreated)
        .groupBy(*_OUTCOME_KEYS)
        .agg(
            F.expr("bool_or(_prior) AS _prior"),
            F.expr("round(try_divide(sum(_each * _times), sum(_times)), 1) AS _hours"),
        )
    )


def block_report(outcomes: DataFrame) -> DataFrame:
    """Nine measures per block over the stays with a known length, in block order.

    Treatment hours are summed as decimals, so their mean does not depend on row order.
    """

    def percent(condition: str, name: str):
        return F.expr(f"round(sum(IF({condition}, 1, 0)) / count(*) * 100, 1) AS {name}")

    return (
        outcomes.where(f"estancia_dias IS NOT NULL AND bloque <> '{v.OTHER_BLOCK}'")
        .groupBy("bloque")
        .agg(
            F.expr("count(DISTINCT stay_id) AS num_pacientes"),
            percent("gender = 'M'", "porcentaje_hombres"),
            percent("estancia_dias IS NOT NULL", "porcentaje_uci"),
            F.expr("round(avg(estancia_dias), 1) AS estancia_media"),
            F.expr("round(stddev_samp(estancia_dias), 1) AS desviacion_estancia"),
            F.expr(
                "round(try_divide("
                "CAST(sum(CAST(duracion_tratamiento AS DECIMAL(18, 1))) AS DOUBLE), "
                "count(duracion_tratamiento)), 1) AS duracion_tratamiento_horas"
            ),
            percent("fallecio_en_uci = 1", "mortalidad_pct"),
            percent("mejoria = 1", "proporcion_mejora_pct"),
        )
        .orderBy("bloque")
    )
