"""Joining many rows with a table that holds one row per key."""

from pyspark.sql import DataFrame

# Session setting: the parts a key is split into where the left side may hold very many
# rows of it. On a large cluster, raise it towards the number of cores.
PARTS_SETTING, DEFAULT_PARTS = "staycohort.lookup.parts", 8


def join_lookup(
    df: DataFrame,
    table: DataFrame,
    keys: list[str],
    how: str,
    spread: str | None = None,
    parts: int | None = None,
) -> DataFrame:
    """Join `df` with `table`, which has few rows per key, mostly one.

    `spread` names a column of `df` that differs between the rows of a key, such as an
    event id. Each key is then split into parts: a row goes to the part of that column's
    hash, the rows of the table to every part; `parts` is the session setting
    staycohort.lookup.parts if not given. The exchange this puts on both sides
    also lets adaptive execution split a part that is still too large, which it cannot do
    right above an aggregate. Leave it out where `df` is already reduced per key.
    """
    if spread is None:
        return df.join(table, keys, how)
    parts = parts or int(df.sparkSession.conf.get(PARTS_SETTING, str(DEFAULT_PARTS)))
    part = f"CAST(pmod(xxhash64({spread}), {parts}) AS INT) AS _part"
    every = ", ".join(str(i) for i in range(parts))
    return (
        df.selectExpr("*", part)
        .join(table.selectExpr("*", f"explode(array({every})) AS _part"), [*keys, "_part"], how)
        .drop("_part")
    )
