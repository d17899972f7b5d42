"""Excluding admissions by diagnosis code."""

from pyspark.sql import DataFrame

from staycohort import vocabulary as v
from staycohort.functions import starts_with_any
from staycohort.operators.lookup import join_lookup


def comorbid_admissions(diagnoses: DataFrame, prefixes=v.COMORBIDITY_PREFIXES) -> DataFrame:
    """Distinct admissions with a listed diagnosis; the prefixes reach the scan."""
    return (
        diagnoses.where(starts_with_any("icd_code", prefixes)).select("hadm_id").distinct()
    )


def exclude_comorbidities(
    df: DataFrame,
    diagnoses: DataFrame,
    prefixes=v.COMORBIDITY_PREFIXES,
    spread: str | None = None,
) -> DataFrame:
    """Rows whose admission has no listed diagnosis."""
    comorbid = comorbid_admissions(diagnoses, prefixes)
    return join_lookup(df, comorbid, ["hadm_id"], "left_anti", spread)
