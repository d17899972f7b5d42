"""One query per operator, over whole clinical tables.

A query is a function of the tables; its name is its key. Where raw rows meet a table
with one row per admission, hot admissions are spread (see `join_lookup`).
"""

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from staycohort import operators as op
from staycohort.functions import (
    all_known,
    antibiotic_class,
    days_between,
    hours_between,
    interpretation_rank,
    lower_in,
)
from staycohort.sources.tables import ClinicalTables
from staycohort.vocabulary import TARGET_ORGANISMS

OPERATOR_QUERIES: dict[str, Callable[[ClinicalTables], DataFrame]] = {}


def _query(function):
    OPERATOR_QUERIES[function.__name__] = function
    return function


# Scans


@_query
def op_scan_stays(t):
    return t.stays.select("subject_id", "hadm_id", "stay_id", "intime", "outtime")


@_query
def op_scan_cultures(t):
    return t.cultures.select(
        "microevent_id",
        "subject_id",
        "hadm_id",
        "charttime",
        "spec_type_desc",
        "org_name",
        "ab_name",
        "interpretation",
    )


@_query
def op_scan_diagnoses(t):
    return t.diagnoses.select("subject_id", "hadm_id", "icd_code")


@_query
def op_scan_prescriptions(t):
    return t.prescriptions.select("subject_id", "hadm_id", "starttime", "stoptime", "drug")


@_query
def op_scan_patients(t):
    return t.patients.select("subject_id", "gender")


@_query
def op_scan_admissions(t):
    return t.admissions.select("subject_id", "hadm_id", "deathtime")


# Projections, filters, CASE


@_query
def op_project(t):
    return t.cultures.select(
        F.col("microevent_id").alias("culture_id"),
        F.col("org_name").alias("organism"),
        F.col("charttime").alias("taken_at"),
    )


@_query
def op_project_star(t):
    return t.stays.select("*", (F.col("outtime") > F.col("intime")).alias("has_length"))


@_query
def op_filter_notnull(t):
    return t.cultures.where(
        all_known("charttime", "org_name") & F.col("interpretation").isNull()
    ).select("microevent_id", "charttime", "org_name")


@_query
def op_filter_in(t):
    return t.cultures.where(
        F.col("interpretation").isin("R", "S", "I")
        & lower_in("org_name", TARGET_ORGANISMS)
    ).select("microevent_id", "interpretation", "org_name")


@_query
def op_filter_not_in(t):
    return op.exclude_specimens(t.cultures).select("microevent_id", "spec_type_desc")


@_query
def op_filter_contains_any(t):
    return op.target_organisms(t.cultures, "contains").select("microevent_id", "org_name")


@_query
def op_filter_prefix_any(t):
    return op.comorbid_admissions(t.diagnoses)


@_query
def op_like_multi(t):
    matches = F.lower("ab_name").like("%trimeth%prim%sulfa%")
    return t.cultures.where(matches).select("microevent_id", "ab_name")


@_query
def op_filter_compare(t):
    start, stop = F.col("starttime"), F.col("stoptime")
    day = F.expr("INTERVAL '24' HOUR")
    return t.prescriptions.where(
        (start < stop) & ((stop >= start + day) | (F.col("drug") != "Heparin"))
    ).select("hadm_id", "starttime", "stoptime", "drug")


@_query
def op_case_searched(t):
    return op.with_antibiotic_class(t.cultures).select("microevent_id", "antibiotic_class")


@_query
def op_case_simple(t):
    return t.cultures.select(
        "microevent_id", interpretation_rank("interpretation").alias("result_rank")
    )


@_query
def op_case_null(t):
    start, stop = F.col("starttime"), F.col("stoptime")
    hours = F.when(stop >= start, hours_between("starttime", "stoptime")).alias("hours")
    return t.prescriptions.select("hadm_id", "starttime", hours)


# Joins


@_query
def op_join_inner(t):
    return op.stay_cultures(t.stays, t.cultures).select("stay_id", "microevent_id")


@_query
def op_join_anti(t):
    kept = op.exclude_comorbidities(t.stays, t.diagnoses, spread="stay_id")
    return kept.select("stay_id", "hadm_id")


@_query
def op_join_range_prior(t):
    cultures = op.tested_cultures(t.cultures)
    flagged = op.treated_ever_before(cultures, t.prescriptions, spread="microevent_id")
    return flagged.select("microevent_id", "has_prior_treatment")


@_query
def op_join_interval_before(t):
    cultures = op.tested_cultures(t.cultures)
    flagged = op.treatment_exposure(
        cultures, t.prescriptions, after=None, spread="microevent_id"
    )
    return flagged.select("microevent_id", "has_prior_treatment")


@_query
def op_join_interval_after(t):
    cultures = op.tested_cultures(t.cultures)
    flagged = op.treatment_exposure(
        cultures, t.prescriptions, before=None, spread="microevent_id"
    )
    return flagged.select("microevent_id", "has_post_treatment")


@_query
def op_join_dims(t):
    deaths = t.admissions.select("hadm_id", "deathtime")
    with_gender = op.join_lookup(t.stays, t.patients, ["subject_id"], "inner", "stay_id")
    with_death = op.join_lookup(with_gender, deaths, ["hadm_id"], "inner", "stay_id")
    return with_death.select("stay_id", "gender", "deathtime")


@_query
def op_join_left_multi(t):
    """Only every fourth admission has a second stay, so some rows find no stay."""
    stay = (F.col("hadm_id") * 10 + F.col("microevent_id") % 2).alias("stay_id")
    cases = t.cultures.where(F.col("hadm_id").isNotNull()).select("microevent_id", "hadm_id", stay)
    return op.stay_windows(cases, t.stays, spread="microevent_id").select("microevent_id", "stay_id", "intime", "outtime")


@_query
def op_join_left_filtered(t):
    """Prescriptions are counted per admission before they meet its stays."""
    complete = (
        t.prescriptions.where(all_known("starttime", "stoptime"))
        .groupBy("hadm_id")
        .agg(F.count(F.lit(1)).alias("n"), F.max("stoptime").alias("last_stop"))
    )
    joined = op.join_lookup(t.stays, complete, ["hadm_id"], "left", "stay_id")
    return joined.select(
        "stay_id", F.coalesce("n", F.lit(0)).alias("prescriptions"), "last_stop"
    )


# Aggregations


@_query
def op_count_distinct(t):
    stays = op.stays_with(t.stays, t.cultures, spread="stay_id")
    return stays.agg(F.count_distinct("stay_id").alias("stays"))


@_query
def op_group_count_distinct(t):
    organisms = t.cultures.select("hadm_id", "org_name").distinct()
    return (
        op.stay_cultures(t.stays, organisms)
        .groupBy("org_name")
        .agg(F.count_distinct("stay_id").alias("stays"))
    )


@_query
def op_having_single(t):
    return op.single_organism_stays(op.tested_cultures(t.cultures), ("hadm_id",))


@_query
def op_group_distinct(t):
    return op.distinct_cultures(
        op.tested_cultures(t.cultures), ["hadm_id", "org_name", "interpretation"]
    )


@_query
def op_distinct(t):
    return t.prescriptions.select("hadm_id", "drug").distinct()


def _stays_with_listed_count(t):
    starts = op.listed_starts(t.prescriptions).groupBy("hadm_id")
    counts = starts.agg(F.count("starttime").alias("n"))
    return op.join_lookup(t.stays, counts, ["hadm_id"], "left", "stay_id")


@_query
def op_flag_int(t):
    flag = F.when(F.col("n") > 0, 1).otherwise(0).alias("treated")
    return _stays_with_listed_count(t).select("stay_id", flag)


@_query
def op_flag_bool(t):
    flag = (F.coalesce("n", F.lit(0)) > 0).alias("treated")
    return _stays_with_listed_count(t).select("stay_id", flag)


@_query
def op_percentages(t):
    resistant = F.sum(F.when(F.col("interpretation") == "R", 1).otherwise(0))
    return t.cultures.groupBy("spec_type_desc").agg(
        F.count(F.lit(1)).alias("cultures"),
        F.round(resistant / F.count(F.lit(1)) * 100, 1).alias("resistant_pct"),
    )


@_query
def op_conditional_sum(t):
    return t.cultures.groupBy("ab_name").agg(
        F.sum(F.when(F.col("interpretation") == "R", 1).otherwise(0)).alias("resistant"),
        F.sum(F.when(F.col("interpretation") == "S", 1).otherwise(0)).alias("susceptible"),
    )


@_query
def op_count_distinct_if(t):
    resistant = F.when(F.col("interpretation") == "R", F.col("hadm_id"))
    return t.cultures.groupBy("org_name").agg(
        F.count_distinct(resistant).alias("resistant_admissions")
    )


def _rx_hours(t):
    hours = hours_between("starttime", "stoptime")
    return t.prescriptions.select("hadm_id", "starttime", "drug", hours.alias("hours"))


@_query
def op_avg_if(t):
    """Hours that are negative or unknown stay out of the mean."""
    mean = F.avg(F.when(F.col("hours") >= 0, F.col("hours")))
    return _rx_hours(t).groupBy("drug").agg(F.round(mean, 1).alias("mean_hours"))


@_query
def op_max_flag(t):
    resistant = F.when(F.col("interpretation") == "R", 1).otherwise(0)
    return t.cultures.groupBy("hadm_id").agg(F.max(resistant).alias("any_resistant"))


@_query
def op_stddev(t):
    days = days_between("intime", "outtime")
    return t.stays.groupBy("subject_id").agg(
        F.count(F.lit(1)).alias("stays"), F.round(F.stddev_samp(days), 3).alias("days_stddev")
    )


@_query
def op_mixed_distinct(t):
    return t.cultures.groupBy("org_name").agg(
        F.count(F.lit(1)).alias("cultures"),
        F.count_distinct("hadm_id").alias("admissions"),
        F.count_distinct("spec_type_desc").alias("specimens"),
        F.sum(F.when(F.col("interpretation") == "R", 1).otherwise(0)).alias("resistant"),
    )


# Windows, order, limit


@_query
def op_row_number(t):
    numbered = op.numbered_cultures(op.tested_cultures(t.cultures), ("hadm_id", "org_name"))
    return numbered.select("hadm_id", "org_name", "microevent_id", "row_num")


@_query
def op_top1_per_group(t):
    """The first of an admission's first cultures: cut before the join with its stays."""
    cultures = op.representative_culture(op.tested_cultures(t.cultures), ("hadm_id", "org_name"))
    first = op.representative_culture(op.stay_cultures(t.stays, cultures))
    return first.select("stay_id", "org_name", "microevent_id")


@_query
def op_order_by(t):
    counts = t.diagnoses.groupBy("icd_code").agg(F.count(F.lit(1)).alias("admissions"))
    return counts.orderBy("icd_code")


@_query
def op_limit(t):
    return t.stays.orderBy("stay_id").limit(10).select("stay_id", "hadm_id", "intime")


# Scalar functions


@_query
def op_lower(t):
    """The class labels hold accents."""
    label = F.lower(antibiotic_class("ab_name")).alias("label")
    return t.cultures.groupBy(label, F.lower("ab_name").alias("antibiotic")).agg(
        F.count(F.lit(1)).alias("cultures")
    )


@_query
def op_diff_days(t):
    days = days_between("intime", "outtime").alias("days")
    return t.stays.select("stay_id", days)


@_query
def op_diff_hours(t):
    return _rx_hours(t).select("hadm_id", "starttime", "hours")


@_query
def op_round(t):
    minutes = F.sum(F.minute("starttime").cast("long"))
    return t.prescriptions.groupBy("drug").agg(
        F.round(minutes / F.count("starttime"), 1).alias("mean_minute")
    )


# Domain operators


@_query
def op_stay_cultures(t):
    return op.stay_cultures(t.stays, t.cultures).select(
        "stay_id", "hadm_id", "microevent_id", "org_name", "charttime"
    )


@_query
def op_target_organisms(t):
    counts = [
        op.target_organisms(t.cultures, mode)
        .groupBy("org_name")
        .agg(F.count(F.lit(1)).alias("cultures"))
        .withColumn("mode", F.lit(mode))
        for mode in ("contains", "exact")
    ]
    return counts[0].unionByName(counts[1])


@_query
def op_exclude_specimens(t):
    kept = op.exclude_specimens(t.cultures)
    return kept.groupBy("spec_type_desc").agg(F.count(F.lit(1)).alias("cultures"))


@_query
def op_tested_cultures(t):
    return op.tested_cultures(t.cultures).select("microevent_id", "hadm_id", "interpretation")


@_query
def op_antibiotic_class(t):
    return (
        op.with_antibiotic_class(t.cultures)
        .groupBy("ab_name", "antibiotic_class")
        .agg(F.count(F.lit(1)).alias("cultures"))
    )


def _representatives(t, mode="contains"):
    cultures = op.exclude_specimens(op.target_organisms(op.tested_cultures(t.cultures), mode))
    return op.with_antibiotic_class(op.representative_culture(cultures, ("hadm_id", "org_name")))


@_query
def op_representative(t):
    return _representatives(t).select(
        "hadm_id", "org_name", "microevent_id", "antibiotic_class", "interpretation"
    )


@_query
def op_single_organism(t):
    cultures = op.target_organisms(op.tested_cultures(t.cultures))
    organisms = cultures.select("hadm_id", "org_name").distinct()
    return op.single_organism_stays(op.stay_cultures(t.stays, organisms))


@_query
def op_distinct_cultures(t):
    return op.distinct_cultures(op.stay_cultures(t.stays, _representatives(t)))


@_query
def op_exclude_comorb(t):
    kept = op.exclude_comorbidities(_representatives(t), t.diagnoses)
    return kept.select("hadm_id", "org_name", "microevent_id")


@_query
def op_treatment_exposure(t):
    cultures = op.tested_cultures(t.cultures)
    flagged = op.treatment_exposure(cultures, t.prescriptions, spread="microevent_id")
    return flagged.select("microevent_id", "has_prior_treatment", "has_post_treatment")


@_query
def op_untreated_then_treated(t):
    cultures = op.tested_cultures(t.cultures)
    flagged = op.treatment_exposure(cultures, t.prescriptions, spread="microevent_id")
    return op.untreated_then_treated(flagged).select("microevent_id", "hadm_id")


@_query
def op_resistance_block(t):
    blocks = op.with_resistance_block(op.with_antibiotic_class(t.cultures))
    return blocks.groupBy("bloque").agg(F.count(F.lit(1)).alias("cultures"))


@_query
def op_stay_outcomes(t):
    """Outcomes of every block case, those of the block `Otros` too."""
    cases = op.with_resistance_block(_representatives(t, "exact"))
    windows = t.stays.select("stay_id", "hadm_id", "intime", "outtime")
    return op.stay_outcomes(
        op.stay_cultures(windows, cases), t.patients, t.admissions, t.prescriptions
    )
