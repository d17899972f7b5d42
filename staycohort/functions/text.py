"""SQL text for literals.

Long conditions are written as SQL text and parsed once; built from single Column calls,
each literal costs several round trips to the driver JVM.
"""

from collections.abc import Iterable


def quoted(value: str) -> str:
    """The value as a SQL string literal."""
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def quoted_list(values: Iterable[str]) -> str:
    """The values as SQL string literals, separated by commas."""
    return ", ".join(quoted(value) for value in values)
