"""Cohort analytics for intensive-care stays and laboratory cultures on Spark."""

from staycohort.plans import REPORTS, report
from staycohort.sources import ClinicalTables, apply_runtime_settings, tables_from_events

__all__ = ["REPORTS", "ClinicalTables", "apply_runtime_settings", "report", "tables_from_events"]
