"""Thirteen reports over the clinical tables, each a lazy DataFrame.

Cultures are filtered and reduced per admission first: what a report asks of a culture
(organism, class, comorbidity, exposure) depends on the admission only. Stays are joined
last, counted per admission wherever only their number is asked for, so that neither
many cultures nor many stays of one admission meet in one task.
"""

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from staycohort import vocabulary as v
from staycohort.functions import all_known
from staycohort.operators import (
    admissions_of,
    block_report,
    distinct_cultures,
    exclude_comorbidities,
    exclude_specimens,
    first_stays,
    representative_culture,
    single_organism_stays,
    stay_cultures,
    stay_outcomes,
    stays_per_admission,
    stays_with,
    target_organisms,
    tested_cultures,
    treated_ever_before,
    treatment_exposure,
    untreated_then_treated,
    with_antibiotic_class,
    with_resistance_block,
)
from staycohort.sources.tables import ClinicalTables


def _count_stays(tables: ClinicalTables, admissions: DataFrame, name: str) -> DataFrame:
    """Distinct stays of the admissions; both sides hold one row per admission."""
    return (
        stays_per_admission(tables.stays)
        .join(admissions, "hadm_id", "left_semi")
        .agg(F.expr(f"coalesce(sum(stays), 0) AS {name}"))
    )


def _first_details(tables: ClinicalTables, cultures: DataFrame, rows: int) -> DataFrame:
    """The first `rows` culture details by stay_id and microevent_id.

    Each of the first `rows` stays with a culture fills at least one line, so no other
    stay can appear. That is at most `rows` rows to broadcast; the culture scan then
    needs no shuffle.
    """
    stays = (
        stays_with(first_stays(tables.stays, rows), cultures)
        .orderBy("stay_id", "hadm_id")
        .limit(rows)
    )
    return (
        stay_cultures(F.broadcast(stays), cultures)
        .orderBy("stay_id", "microevent_id")
        .limit(rows)
        .select("stay_id", "hadm_id", "org_name", "charttime", "ab_name", "interpretation")
    )


def _positive(tables: ClinicalTables) -> DataFrame:
    dated = tables.cultures.where(all_known("hadm_id", "charttime", "org_name"))
    return target_organisms(dated, "contains")


def _tested(tables: ClinicalTables, mode: str) -> DataFrame:
    return target_organisms(tested_cultures(tables.cultures), mode)


def _representatives(tables: ClinicalTables, mode: str) -> DataFrame:
    """The culture that stands for each admission and organism, with its class."""
    cultures = exclude_specimens(_tested(tables, mode))
    return with_antibiotic_class(representative_culture(cultures, ("hadm_id", "org_name")))


def p01_stays_with_culture(tables: ClinicalTables) -> DataFrame:
    """Stays with any culture."""
    return _count_stays(tables, admissions_of(tables.cultures), "total_estancias_uci")


def p02_culture_detail(tables: ClinicalTables) -> DataFrame:
    """First culture details."""
    return _first_details(tables, tables.cultures, v.CULTURE_DETAIL_ROWS)


def p03_stays_positive(tables: ClinicalTables) -> DataFrame:
    """Stays with a target organism, tested or not."""
    admissions = admissions_of(_positive(tables))
    return _count_stays(tables, admissions, "total_estancias_uci_cultivos_positivos")


def p04_positive_detail(tables: ClinicalTables) -> DataFrame:
    """First details of cultures with a target organism."""
    return _first_details(tables, _positive(tables), v.POSITIVE_DETAIL_ROWS)


def p05_stays_tested(tables: ClinicalTables) -> DataFrame:
    """Stays with a tested culture of a target organism."""
    admissions = admissions_of(_tested(tables, "contains"))
    return _count_stays(tables, admissions, "total_estancias_uci_cultivos")


def _single_organism(tables: ClinicalTables, admissions: DataFrame) -> DataFrame:
    return _count_stays(tables, admissions, "total_estancias_uci_cultivos_monoinfeccion")


def p06_single_organism(tables: ClinicalTables) -> DataFrame:
    """Stays whose tested cultures name one organism.

    All stays of an admission share its cultures, so the admission is what is tested.
    """
    cultures = _tested(tables, "contains")
    return _single_organism(tables, single_organism_stays(cultures, ("hadm_id",)))


def p07_single_organism_specimen(tables: ClinicalTables) -> DataFrame:
    """As p06, without the excluded specimens."""
    cultures = exclude_specimens(_tested(tables, "contains"))
    return _single_organism(tables, single_organism_stays(cultures, ("hadm_id",)))


def p08_single_organism_no_comorb(tables: ClinicalTables) -> DataFrame:
    """As p07 per stay and admission, without comorbid admissions."""
    cultures = exclude_specimens(_tested(tables, "contains"))
    single = single_organism_stays(cultures, ("hadm_id",))
    return _single_organism(tables, exclude_comorbidities(single, tables.diagnoses))


def _cases_with_prior_treatment(tables: ClinicalTables, mode: str) -> DataFrame:
    cases = exclude_comorbidities(_representatives(tables, mode), tables.diagnoses)
    return treated_ever_before(cases, tables.prescriptions).withColumn(
        "has_prior_treatment", F.expr("CAST(has_prior_treatment AS INT)")
    )


def p09_prior_treatment_detail(tables: ClinicalTables) -> DataFrame:
    """First cases by stay_id, charttime and organism, with any earlier treatment."""
    columns = [
        "stay_id",
        "hadm_id",
        "charttime",
        "org_name",
        "antibiotic_class",
        "interpretation",
        "has_prior_treatment",
    ]
    cultures = exclude_specimens(_tested(tables, "contains"))
    eligible = exclude_comorbidities(admissions_of(cultures), tables.diagnoses)
    # Every stay of an eligible admission fills a line, so ten stays are enough.
    stays = (
        tables.stays.select("stay_id", "hadm_id")
        .join(eligible, "hadm_id", "left_semi")
        .distinct()
        .orderBy("stay_id")
        .limit(v.PRIOR_TREATMENT_ROWS)
    )
    few = F.broadcast(stays)
    near = cultures.join(few.select("hadm_id"), "hadm_id", "left_semi")
    drugs = tables.prescriptions.join(few.select("hadm_id"), "hadm_id", "left_semi")
    cases = with_antibiotic_class(representative_culture(near, ("hadm_id", "org_name")))
    flagged = treated_ever_before(cases, drugs).withColumn(
        "has_prior_treatment", F.expr("CAST(has_prior_treatment AS INT)")
    )
    return (
        distinct_cultures(stay_cultures(few, flagged), columns)
        .orderBy("stay_id", "charttime", "org_name")
        .limit(v.PRIOR_TREATMENT_ROWS)
    )


def p10_prior_treatment_counts(tables: ClinicalTables) -> DataFrame:
    """Stays, treated cultures and treated stays, by exact organism name.

    Every case counts once for each stay of its admission, so the cases of an admission
    are counted first and multiplied by its stays.
    """
    treated = (
        _cases_with_prior_treatment(tables, "exact")
        .groupBy("hadm_id")
        .agg(F.sum("has_prior_treatment").alias("treated"))
    )
    return (
        stays_per_admission(tables.stays)
        .join(treated, "hadm_id")
        .agg(
            F.expr("coalesce(sum(stays), 0) AS total_estancias_uci_monoinfeccion"),
            F.expr("sum(stays * treated) AS total_con_tratamiento_previo"),
            F.expr(
                "coalesce(sum(IF(treated > 0, stays, 0)), 0) AS estancias_distintas_con_tratamiento"
            ),
        )
    )


def p11_untreated_then_treated_48h(tables: ClinicalTables) -> DataFrame:
    """Stays treated within 48 h after a culture and not within 48 h before it."""
    cases = treatment_exposure(_representatives(tables, "contains"), tables.prescriptions)
    kept = exclude_comorbidities(untreated_then_treated(cases), tables.diagnoses)
    return _count_stays(
        tables,
        admissions_of(kept),
        "estancias_distintas_sin_tratamiento_previo_y_posterior_48h",
    )


def _block_cases(tables: ClinicalTables) -> DataFrame:
    """Cases of a block, untreated before and treated after; comorbid ones stay in."""
    cases = with_resistance_block(_representatives(tables, "exact"))
    blocks = cases.where(f"bloque <> '{v.OTHER_BLOCK}'")
    return untreated_then_treated(treatment_exposure(blocks, tables.prescriptions))


def p12_blocks(tables: ClinicalTables) -> DataFrame:
    """Stays per resistance block."""
    cases = _block_cases(tables).select("hadm_id", "bloque").distinct()
    return (
        stays_per_admission(tables.stays)
        .join(cases, "hadm_id")
        .groupBy("bloque")
        .agg(F.sum("stays").alias("estancias_unicas"))
        .orderBy("bloque")
    )


def p13_clinical_metrics(tables: ClinicalTables) -> DataFrame:
    """Length of stay, treatment, mortality and improvement per resistance block."""
    windows = tables.stays.select("stay_id", "hadm_id", "intime", "outtime")
    return block_report(
        stay_outcomes(
            stay_cultures(windows, _block_cases(tables)),
            tables.patients,
            tables.admissions,
            tables.prescriptions,
        )
    )


REPORTS: dict[str, Callable[[ClinicalTables], DataFrame]] = {
    plan.__name__: plan
    for plan in (
        p01_stays_with_culture,
        p02_culture_detail,
        p03_stays_positive,
        p04_positive_detail,
        p05_stays_tested,
        p06_single_organism,
        p07_single_organism_specimen,
        p08_single_organism_no_comorb,
        p09_prior_treatment_detail,
        p10_prior_treatment_counts,
        p11_untreated_then_treated_48h,
        p12_blocks,
        p13_clinical_metrics,
    )
}


def report(name: str, tables: ClinicalTables) -> DataFrame:
    """The named report; an unknown name raises KeyError."""
    if name not in REPORTS:
        raise KeyError(f"no report named {name!r}; known: {', '.join(REPORTS)}")
    return REPORTS[name](tables)
