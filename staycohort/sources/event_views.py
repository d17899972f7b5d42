"""Clinical tables derived from an `events` table (event_id, ts, user_id, event_type).

One admission per user and week, stays inside it, one culture row per 'error' event
and antibiotic, one prescription per 'purchase', one diagnosis per 'view'. Used where
no clinical warehouse is at hand; every row of events takes part.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from staycohort.functions import quoted_list
from staycohort.sources.tables import ClinicalTables

# Names picked by index; an index past the end gives NULL.
ORGANISMS = (
    "ESCHERICHIA COLI",
    "KLEBSIELLA PNEUMONIAE",
    "KLEBSIELLA AEROGENES",
    "ENTEROBACTER CLOACAE",
    "ENTEROBACTER AEROGENES",
    "PSEUDOMONAS AERUGINOSA",
    "ACINETOBACTER BAUMANNII",
    "STENOTROPHOMONAS MALTOPHILIA",
    "ENTEROCOCCUS FAECIUM",
    "STAPHYLOCOCCUS AUREUS",
    "ACINETOBACTER BAUMANNII COMPLEX",
    "CANDIDA ALBICANS",
)
ANTIBIOTICS = (
    "CEFTRIAXONE",
    "CEFEPIME",
    "CEFTAZIDIME",
    "MEROPENEM",
    "IMIPENEM",
    "TRIMETHOPRIM/SULFA",
    "LINEZOLID",
    "DAPTOMYCIN",
    "OXACILLIN",
    "VANCOMYCIN",
    "GENTAMICIN",
)
SPECIMENS = ("BLOOD CULTURE", "URINE", "SPUTUM", "SWAB", "EYE", "BLOOD CULTURE", "URINE")
DRUGS = (
    "Ceftriaxone",
    "CefePIME",
    "CefTAZidime",
    "Meropenem",
    "Imipenem",
    "Trimethoprim-Sulfamethoxazole",
    "Linezolid",
    "Daptomycin",
    "Oxacillin",
    "Vancomycin",
    "Acetaminophen",
    "Heparin",
    "Insulin",
)
ICD_CODES = (
    "N186",
    "E119",
    "I509",
    "J189",
    "4019",
    "A419",
    "R6521",
    "K7200",
    "Z9911",
    "5859",
)
RESULTS = ("R", "S", "R", "I")


# Only the columns the views use; a declared schema saves reading file footers first.
_EVENTS = "event_id BIGINT, ts TIMESTAMP_NTZ, user_id BIGINT, event_type STRING"


def _pick(names, index: str) -> str:
    return f"get(array({quoted_list(names)}), CAST({index} AS INT))"


def tables_from_events(spark: SparkSession, sf_dir: str) -> ClinicalTables:
    """Derive the six tables from `sf_dir/events.parquet`."""
    events = (
        spark.read.schema(_EVENTS)
        .parquet(f"{sf_dir}/events.parquet")
        .selectExpr(
            "event_id",
            "ts",
            "event_type",
            "user_id AS subject_id",
            "user_id * 100 + floor((day(ts) - 1) / 7) AS hadm_id",
        )
    )
    return ClinicalTables(
        stays=_stays(events),
        cultures=_cultures(events),
        prescriptions=_prescriptions(events),
        diagnoses=_diagnoses(events),
        patients=_patients(events),
        admissions=_admissions(events),
    )


def _stays(events: DataFrame) -> DataFrame:
    stay_id = "hadm_id * 10 + IF(hadm_id % 4 = 0, event_id % 2, 0) AS stay_id"
    return (
        events.selectExpr("subject_id", "hadm_id", stay_id, "ts")
        .groupBy("subject_id", "hadm_id", "stay_id")
        .agg(F.min("ts").alias("intime"), F.max("ts").alias("outtime"))
    )


def _cultures(events: DataFrame) -> DataFrame:
    organism = "(hadm_id + IF(event_id % 4 = 0, 1, 0)) % 13"
    antibiotic = "(hadm_id * 7 + event_id % 5 + k) % 12"
    result = _pick(RESULTS, "(event_id + k) % 5")
    return (
        events.where("event_type = 'error'")
        .selectExpr("*", "explode(array(0, 1, 2)) AS k")
        .selectExpr(
            "event_id * 3 + k AS microevent_id",
            "subject_id",
            "IF(event_id % 47 = 0, NULL, hadm_id) AS hadm_id",
            "IF(event_id % 53 = 0, NULL, ts) AS charttime",
            f"{_pick(SPECIMENS, 'event_id % 8')} AS spec_type_desc",
            f"{_pick(ORGANISMS, organism)} AS org_name",
            f"{_pick(ANTIBIOTICS, antibiotic)} AS ab_name",
            f"IF(event_id % 4 = 1, NULL, {result}) AS interpretation",
        )
    )


def _prescriptions(events: DataFrame) -> DataFrame:
    length = "make_dt_interval(0, CAST(event_id % 90 - 3 AS INT), 25)"
    return events.where("event_type = 'purchase'").selectExpr(
        "subject_id",
        "hadm_id",
        "IF(event_id % 41 = 0, NULL, ts) AS starttime",
        f"IF(event_id % 43 = 0, NULL, ts + {length}) AS stoptime",
        f"{_pick(DRUGS, 'event_id % 13')} AS drug",
    )


def _diagnoses(events: DataFrame) -> DataFrame:
    code = _pick(ICD_CODES, "(hadm_id + event_id % 2) % 10")
    return (
        events.where("event_type = 'view'")
        .selectExpr("subject_id", "hadm_id", f"{code} AS icd_code")
        .distinct()
    )


def _patients(events: DataFrame) -> DataFrame:
    gender = "IF(subject_id % 3 = 0, 'F', 'M') AS gender"
    return events.select("subject_id").distinct().selectExpr("subject_id", gender)


def _admissions(events: DataFrame) -> DataFrame:
    death = (
        "CASE WHEN hadm_id % 7 = 0 THEN last_seen"
        " WHEN hadm_id % 11 = 0 THEN last_seen + INTERVAL '48' HOUR END AS deathtime"
    )
    return (
        events.groupBy("subject_id", "hadm_id")
        .agg(F.max("ts").alias("last_seen"))
        .selectExpr("subject_id", "hadm_id", death)
    )
