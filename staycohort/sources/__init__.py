"""Where the clinical tables come from."""

from staycohort.sources.event_views import tables_from_events
from staycohort.sources.session import RUNTIME_SETTINGS, apply_runtime_settings
from staycohort.sources.tables import ClinicalTables

__all__ = [
    "RUNTIME_SETTINGS",
    "ClinicalTables",
    "apply_runtime_settings",
    "tables_from_events",
]
