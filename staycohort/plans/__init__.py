"""The thirteen cohort reports."""

from staycohort.plans.reports import REPORTS, report

__all__ = ["REPORTS", "report"]
