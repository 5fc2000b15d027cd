"""Look-up join that stays even when one key holds a large share of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

# Look-up tables up to this many rows are broadcast.
BROADCAST_ROWS = 50_000


def look_up(rows: DataFrame, table: DataFrame, on: list[str], n_table: int | None = None, salts: int = 16) -> DataFrame:
    """Inner join of ``rows`` with ``table``, which is unique on ``on``.

    A table known to be small (``n_table``) is broadcast. Otherwise the rows of one key are spread over ``salts`` tasks
    and the narrow table is repeated that often, so a key in a third of all rows is no bottleneck. The repeated rows are merged,
    never broadcast: their estimated size leaves out the repeats.
    """
    if n_table is not None and n_table <= BROADCAST_ROWS:
        return rows.join(F.broadcast(table), on)
    spread = [c for c in rows.columns if c not in on]
    salted = rows.withColumn("salt", F.pmod(F.xxhash64(*spread), F.lit(salts)))
    copies = table.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))))
    return salted.join(copies.hint("merge"), [*on, "salt"]).drop("salt")
