"""Joining a large table to per-group rows derived from it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import checkpointed

# A group row is a key and a few numbers; this many stay far below a broadcast's limits.
BROADCAST_ROWS = 100_000
SALTS = 64


def if_small(written: DataFrame, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame | None:
    """A checkpointed frame marked for broadcast when it is counted to be small, else None."""
    return F.broadcast(written) if written.count() <= broadcast_rows else None


def join_group_rows(rows: DataFrame, groups: DataFrame, keys: list[str],
                    broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Attach each row's group row.

    The group rows are written to the checkpoint folder once and counted there. Up to
    ``broadcast_rows`` they are broadcast and the large side is not moved at all; beyond that
    both sides are spread over ``SALTS`` sub-keys, so that a key holding a third of the rows
    still goes to many tasks. That join must not become a broadcast: Spark takes the group rows for as few as they were before the sub-keys.
    """
    groups = checkpointed(groups)
    small = if_small(groups, broadcast_rows)
    if small is not None:
        return rows.join(small, keys, "inner")
    salted_rows = rows.withColumn("_salt", F.pmod(F.xxhash64(*rows.columns), F.lit(SALTS)).cast("int"))
    salted_groups = groups.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return salted_rows.join(salted_groups.hint("merge"), [*keys, "_salt"], "inner").drop("_salt")
