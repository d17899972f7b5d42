"""Labels computed from organism, antibiotic and susceptibility result."""

from itertools import product

from pyspark.sql import Column
from pyspark.sql import functions as F

from staycohort import vocabulary as v
from staycohort.functions.text import quoted, quoted_list


def interpretation_rank(column: str, order=v.INTERPRETATIONS) -> Column:
    """1 for the preferred result, then 2, 3; NULL for anything else."""
    places = " ".join(f"WHEN {quoted(result)} THEN {i}" for i, result in enumerate(order, 1))
    return F.expr(f"CASE {column} {places} END")


def antibiotic_class(
    column: str, patterns=v.ANTIBIOTIC_CLASS_PATTERNS, otherwise=v.OTHER_CLASS
) -> Column:
    """Class of the first pattern the name matches; a missing name is `otherwise`."""
    branches = " ".join(
        f"WHEN lower({column}) LIKE {quoted(pattern)} THEN {quoted(label)}"
        for pattern, label in patterns
    )
    return F.expr(f"CASE {branches} ELSE {quoted(otherwise)} END")


def resistance_block(
    organism: str, drug_class: str, blocks=v.RESISTANCE_BLOCKS, otherwise=v.OTHER_BLOCK
) -> Column:
    """Block of an organism and an antibiotic class; the first block that lists both.

    One look-up in a constant map: a chain of conditions would repeat the class expression
    in every branch once a filter on the block is pushed down.
    """
    found = {}
    for block, organisms, classes in blocks:
        for pair in product(organisms, classes):
            found.setdefault("|".join(pair), block)
    entries = quoted_list(text for entry in found.items() for text in entry)
    key = f"concat(lower({organism}), '|', {drug_class})"
    return F.expr(f"coalesce(try_element_at(map({entries}), {key}), {quoted(otherwise)})")
