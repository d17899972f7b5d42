"""Cohort operators: each takes and returns lazy DataFrames."""

from staycohort.operators.comorbidities import (
    comorbid_admissions,
    exclude_comorbidities,
)
from staycohort.operators.cultures import (
    admissions_of,
    distinct_cultures,
    exclude_specimens,
    first_stays,
    numbered_cultures,
    representative_culture,
    single_organism_stays,
    stay_cultures,
    stays_per_admission,
    stays_with,
    target_organisms,
    tested_cultures,
    with_antibiotic_class,
)
from staycohort.operators.exposure import (
    listed_starts,
    treated_ever_before,
    treatment_exposure,
    untreated_then_treated,
)
from staycohort.operators.lookup import join_lookup
from staycohort.operators.outcomes import (
    block_report,
    stay_outcomes,
    stay_windows,
    with_resistance_block,
)

__all__ = [
    "admissions_of",
    "block_report",
    "comorbid_admissions",
    "distinct_cultures",
    "exclude_comorbidities",
    "exclude_specimens",
    "first_stays",
    "join_lookup",
    "listed_starts",
    "numbered_cultures",
    "representative_culture",
    "single_organism_stays",
    "stay_cultures",
    "stay_outcomes",
    "stay_windows",
    "stays_per_admission",
    "stays_with",
    "target_organisms",
    "tested_cultures",
    "treated_ever_before",
    "treatment_exposure",
    "untreated_then_treated",
    "with_antibiotic_class",
    "with_resistance_block",
]
