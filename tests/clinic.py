"""Small clinical tables for tests."""

from datetime import datetime, timedelta

from staycohort import ClinicalTables
from staycohort.schemas import SCHEMAS

T0 = datetime(2024, 3, 10, 12, 0)


def at(hours=0, **delta):
    """A time `hours` (and other timedelta parts) after T0."""
    return T0 + timedelta(hours=hours, **delta)


def table(spark, role, rows):
    """Rows are dicts; columns left out are NULL."""
    schema = SCHEMAS[role]
    values = [tuple(row.get(name) for name in schema.names) for row in rows]
    return spark.createDataFrame(values, schema)


def clinic(spark, **rows):
    return ClinicalTables(**{role: table(spark, role, rows.get(role, [])) for role in SCHEMAS})


_DEFAULT_CULTURE = {
    "microevent_id": 1,
    "subject_id": 1,
    "hadm_id": 10,
    "charttime": T0,
    "spec_type_desc": "URINE",
    "org_name": "ESCHERICHIA COLI",
    "ab_name": "MEROPENEM",
    "interpretation": "R",
}


def culture(**changes):
    return {**_DEFAULT_CULTURE, **changes}


def stay(stay_id=100, hadm_id=10, intime=None, outtime=None):
    return {"stay_id": stay_id, "hadm_id": hadm_id, "intime": intime, "outtime": outtime}


def order(start, stop=None, drug="Vancomycin", hadm_id=10):
    return {"hadm_id": hadm_id, "starttime": start, "stoptime": stop, "drug": drug}


def values(df, *columns):
    """Sorted tuples of the columns."""
    rows = df.select(*columns).collect()
    return sorted((tuple(row) for row in rows), key=repr)


def only(df, column):
    """The single value of a single row."""
    (row,) = df.collect()
    return row[column]
