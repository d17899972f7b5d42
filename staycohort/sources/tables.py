"""The six input tables of every plan."""

from dataclasses import dataclass, fields

from pyspark.sql import DataFrame, SparkSession

from staycohort.schemas import SCHEMAS, TABLE_NAMES


@dataclass(frozen=True)
class ClinicalTables:
    """Lazy DataFrames, one per table role."""

    stays: DataFrame
    cultures: DataFrame
    prescriptions: DataFrame
    diagnoses: DataFrame
    patients: DataFrame
    admissions: DataFrame

    @classmethod
    def from_files(
        cls, spark: SparkSession, root: str, file_format: str = "parquet", names=TABLE_NAMES
    ) -> "ClinicalTables":
        """Tables stored as `root/<table name>`, read with the declared schemas."""
        return cls(
            **{
                role: spark.read.schema(SCHEMAS[role])
                .format(file_format)
                .load(f"{root.rstrip('/')}/{names[role]}")
                for role in _roles()
            }
        )

    @classmethod
    def from_catalog(
        cls, spark: SparkSession, database: str | None = None, names=TABLE_NAMES
    ) -> "ClinicalTables":
        """Tables registered in the session catalog (bucketed or partitioned as stored)."""
        prefix = f"{database}." if database else ""
        return cls(**{role: spark.table(prefix + names[role]) for role in _roles()})


def _roles():
    return [field.name for field in fields(ClinicalTables)]
