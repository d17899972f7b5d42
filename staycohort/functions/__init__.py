"""Column expressions; all of them stay inside the JVM."""

from staycohort.functions.labels import (
    antibiotic_class,
    interpretation_rank,
    resistance_block,
)
from staycohort.functions.matching import (
    all_known,
    contains_any,
    lower_in,
    starts_with_any,
)
from staycohort.functions.text import quoted_list
from staycohort.functions.times import bin_start, days_between, hours_between

__all__ = [
    "all_known",
    "antibiotic_class",
    "bin_start",
    "contains_any",
    "days_between",
    "hours_between",
    "interpretation_rank",
    "lower_in",
    "quoted_list",
    "resistance_block",
    "starts_with_any",
]
