"""Schemas of the six clinical tables.

Timestamps carry no zone. One admission belongs to one subject and one stay to
one admission; the plans rely on that and on nothing else about keys.
"""

from pyspark.sql.types import (
    LongType,
    StringType,
    StructField,
    StructType,
    TimestampNTZType,
)


def _struct(**columns):
    return StructType([StructField(name, kind(), True) for name, kind in columns.items()])


STAYS = _struct(
    subject_id=LongType,
    hadm_id=LongType,
    stay_id=LongType,
    intime=TimestampNTZType,
    outtime=TimestampNTZType,
)

CULTURES = _struct(
    microevent_id=LongType,
    subject_id=LongType,
    hadm_id=LongType,
    charttime=TimestampNTZType,
    spec_type_desc=StringType,
    org_name=StringType,
    ab_name=StringType,
    interpretation=StringType,
)

PRESCRIPTIONS = _struct(
    subject_id=LongType,
    hadm_id=LongType,
    starttime=TimestampNTZType,
    stoptime=TimestampNTZType,
    drug=StringType,
)

DIAGNOSES = _struct(subject_id=LongType, hadm_id=LongType, icd_code=StringType)

PATIENTS = _struct(subject_id=LongType, gender=StringType)

ADMISSIONS = _struct(subject_id=LongType, hadm_id=LongType, deathtime=TimestampNTZType)

# Warehouse table name of each role.
TABLE_NAMES = {
    "stays": "icustays",
    "cultures": "microbiologyevents",
    "prescriptions": "prescriptions",
    "diagnoses": "diagnoses_icd",
    "patients": "patients",
    "admissions": "admissions",
}

SCHEMAS = {
    "stays": STAYS,
    "cultures": CULTURES,
    "prescriptions": PRESCRIPTIONS,
    "diagnoses": DIAGNOSES,
    "patients": PATIENTS,
    "admissions": ADMISSIONS,
}
