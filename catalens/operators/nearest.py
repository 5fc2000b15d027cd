"""Exact k nearest neighbours in a low-dimensional mixed space, by boxes.

Distance between two rows: squared differences of the numeric columns, plus per categorical column 0 when equal, 1 when
one side is the reference category (whose one-hot code is all zero), else 2. That is the squared Euclidean distance of
the one-hot encoded rows, without building them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from catalens.operators.blocks import meet, with_long
from catalens.operators.joins import look_up
from catalens.operators.sampling import shuffle_key
from catalens.operators.similar import top_per
from catalens.session import materialize

# Distinct rows per block, rows bounded at a time, rows in a sample for cuts, and the most cells of the first cut.
BLOCK_ROWS = 2048
SLICE_ROWS = 1024
SAMPLE_ROWS = 16_384
MAX_CELLS = 1024


def _cuts(sample: np.ndarray, depth: int) -> list[tuple[int, float]]:
    """Balanced binary cuts of the sample in heap order: (column, threshold) per inner node."""
    nodes: list[tuple[int, float]] = [(0, np.inf)] * (2**depth - 1)
    todo = [(0, sample)]
    while todo:
        at, rows = todo.pop()
        if at >= len(nodes):
            continue
        if len(rows):
            column = int(np.argmax(rows.max(axis=0) - rows.min(axis=0)))
            cut = float(np.median(rows[:, column]))
            if cut == rows[:, column].max():  # keep the right side non-empty where values repeat
                below = rows[:, column][rows[:, column] < cut]
                cut = float(below.max()) if len(below) else cut
            nodes[at] = (column, cut)
            left = rows[:, column] <= cut
            todo += [(2 * at + 1, rows[left]), (2 * at + 2, rows[~left])]
        else:
            todo += [(2 * at + 1, rows), (2 * at + 2, rows)]
    return nodes


def _leaf(values: np.ndarray, nodes: list[tuple[int, float]]) -> np.ndarray:
    """Box number of every row: walk down all levels at once."""
    at = np.zeros(len(values), dtype=np.int64)
    columns = np.array([c for c, _ in nodes], dtype=np.int64)
    cuts = np.array([t for _, t in nodes])
    for _ in range(int(np.log2(len(nodes) + 1))):
        right = values[np.arange(len(values)), columns[at]] > cuts[at]
        at = 2 * at + 1 + right
    return at - len(nodes)


def _distances(left: pd.DataFrame, right: pd.DataFrame, numeric, categorical, reference) -> np.ndarray:
    total = np.zeros((len(left), len(right)))
    for c in numeric:
        gap = left[c].to_numpy(dtype=np.float64)[:, None] - right[c].to_numpy(dtype=np.float64)[None, :]
        total += gap * gap
    mismatch = np.zeros(total.shape, dtype=np.int8)
    for c in categorical:
        codes, values = pd.factorize(pd.concat([left[c], right[c]], ignore_index=True))
        a, b = codes[: len(left)][:, None], codes[len(left):][None, :]
        base = np.flatnonzero(values == reference[c])
        base = base[0] if len(base) else -2
        mismatch += np.where(a == b, 0, np.where((a == base) | (b == base), 1, 2)).astype(np.int8)
    return total + mismatch


def _nearest_of_block(left, right, numeric, categorical, reference, k) -> pd.DataFrame:
    right = right.sort_values("first", ignore_index=True)
    dist = _distances(left, right, numeric, categorical, reference)
    take = min(k, len(right))
    bar = np.partition(dist, take - 1, axis=1)[:, take - 1]
    row, col = np.nonzero(dist <= bar[:, None])
    order = np.lexsort((col, dist[row, col], row))
    row, col = row[order], col[order]
    inside = np.arange(len(row)) - np.searchsorted(row, row) < k
    row, col = row[inside], col[inside]
    return pd.DataFrame({
        "query": left["first"].to_numpy()[row], "near": right["first"].to_numpy()[col], "dist": dist[row, col],
    })


def _classes(df: DataFrame, key: str, columns: list[str], keep: int, value: str) -> DataFrame:
    """One row per distinct feature row: its ``keep`` smallest keys with values as ``members``, and their number."""
    members = F.array_sort(F.collect_list(F.struct(F.col(key).alias("key"), F.col(value).alias("value"))))
    kept = top_per(df.select(key, *columns, value), columns, [key], keep)
    classes = kept.groupBy(*columns).agg(members.alias("members"))
    return materialize(
        classes.withColumns({"first": F.get("members", 0)["key"], "rows": F.size("members")}), "classes"
    )


def nearest_mean(
    train: DataFrame, queries: DataFrame, key: str, numeric: list[str], categorical: list[str], label: str, k: int = 3,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """``queries`` with ``prediction``: mean label of the ``k`` nearest training rows, ties to the smaller key. Exact.

    Both tables need the ``numeric`` and ``categorical`` columns; rows with a null among them take no part.

    1. Equal rows are merged on both sides; a class carries its ``k`` smallest keys, enough for any top-k.
    2. The training classes are cut by medians: first into at most MAX_CELLS cells by a bounded sample on the driver, then
       every cell with more than ``block_rows`` rows by a bounded sample of its own, in a task of its own. So boxes grow in number
       with the rows. A full box is dealt into blocks of about ``block_rows``.
    3. A query takes the smallest upper bound, of all cells and of the boxes in its own cell, as the radius that surely holds
       ``k`` rows, and visits only the cells, and in these the boxes, whose lower bound is inside it. All bounds are safe, so
       pruning never changes the answer. Only the bounds of cells go to the workers; those of boxes are joined by cell.
    4. Each (query block, training block) pair is one task that returns k rows per query; those are ranked at the end.
    """
    columns = [*numeric, *categorical]
    trained = _classes(train.dropna("any", subset=columns), key, columns, k, label)
    asked = queries.select(*columns).dropna("any").distinct()
    asked = materialize(asked.withColumns({"first": F.monotonically_increasing_id(), "rows": F.lit(1)}), "classes")
    reference = trained.agg(*[F.min(c).alias(c) for c in categorical]).first().asDict()
    n = trained.count()
    sample = _numbers(trained.orderBy(shuffle_key(1, "first"), "first").limit(SAMPLE_ROWS), numeric)
    nodes = _cuts(sample, min(int(np.log2(MAX_CELLS)), _depth(n, block_rows)))

    def celled(df: DataFrame, name: str) -> DataFrame:
        def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for rows in batches:
                yield rows.assign(cell=_leaf(rows[numeric].to_numpy(dtype=np.float64), nodes))

        return materialize(df.mapInPandas(assign, schema=with_long(df, "cell")), f"celled-{name}")

    right = _boxed(celled(trained.drop("members"), "train"), numeric, block_rows)
    sides = [f(F.col(c).cast("double")).alias(f"{c}_{end}") for c in numeric for f, end in ((F.min, "lo"), (F.max, "hi"))]
    bounds = materialize(right.groupBy("cell", "box").agg(F.sum("rows").alias("held"), *sides, F.count("*").alias("size")), "bounds")
    parts = bounds.select("box", F.ceil(F.col("size") / block_rows).alias("parts"))
    right = right.join(parts, "box").withColumn("block", F.xxhash64("box", F.pmod(F.xxhash64("first"), F.col("parts")))).drop("parts")
    right = materialize(right, "dealt")
    slack = 2.0 * len(categorical)

    ends = [f(f"{c}_{end}").alias(f"{c}_{end}") for c in numeric for f, end in ((F.min, "lo"), (F.max, "hi"))]
    cells = bounds.groupBy("cell").agg(F.sum("held").alias("held"), *ends).orderBy("cell").toPandas()  # at most MAX_CELLS rows
    low, high = (cells[[f"{c}_{end}" for c in numeric]].to_numpy() for end in ("lo", "hi"))
    enough, numbers = cells["held"].to_numpy() >= k, cells["cell"].to_numpy()

    left = celled(asked, "queries")
    nearest, farthest = _box_distances(numeric)
    own = left.join(bounds.where(F.col("held") >= k), "cell").groupBy("first").agg(F.min(farthest + slack).alias("radius"))
    left = left.join(own, "first", "left")

    def visits(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), SLICE_ROWS):
                rows = batch.iloc[at : at + SLICE_ROWS]
                x = rows[numeric].to_numpy(dtype=np.float64)
                near, far = np.zeros((len(x), len(numbers))), np.zeros((len(x), len(numbers)))
                for j in range(x.shape[1]):
                    below, above = low[None, :, j] - x[:, None, j], x[:, None, j] - high[None, :, j]
                    near += np.maximum(np.maximum(below, above), 0.0) ** 2
                    far += np.maximum(-below, -above) ** 2
                radius = rows["radius"].fillna(np.inf).to_numpy(dtype=np.float64)
                if enough.any():
                    radius = np.minimum(radius, (far[:, enough] + slack).min(axis=1))
                radius = radius * (1 + 1e-9) + 1e-9
                row, cell = np.nonzero(near <= radius[:, None])
                yield rows.iloc[row].assign(radius=radius[row], visit=numbers[cell])

    left = left.mapInPandas(visits, schema=with_long(left, "visit")).drop("cell").withColumnRenamed("visit", "cell")
    inside = left.join(bounds.drop("held", "size"), "cell").where(nearest <= F.col("radius"))
    inside = inside.select("first", "rows", *columns, "box", F.pmod(F.xxhash64("first"), F.lit(-(-asked.count() // block_rows) or 1)).alias("block"))
    blocks = right.select("box", F.col("block").alias("target")).distinct()
    found = meet(
        inside.join(blocks, "box").drop("box"),
        right.drop("box", "cell"),
        lambda a, b: _nearest_of_block(a, b, numeric, categorical, reference, k),
        "query long, near long, dist double",
    )
    best = top_per(found, ["query"], ["dist", "near"], k).drop("rank")
    opened = look_up(best, trained.select(F.col("first").alias("near"), "members"), ["near"], n).select(
        "query", "dist", F.explode("members").alias("m")
    ).select("query", "dist", F.col("m.key").alias("train_key"), F.col("m.value").alias("value"))
    answer = top_per(opened, ["query"], ["dist", "train_key"], k).groupBy("query").agg(F.avg("value").alias("prediction"))
    by_class = asked.select(*columns, F.col("first").alias("query")).join(answer, "query").drop("query")
    return look_up(queries, by_class, columns).select(*queries.columns, "prediction")


def _numbers(rows: DataFrame, numeric: list[str]) -> np.ndarray:
    return rows.select(*[F.col(c).cast("double").alias(c) for c in numeric]).toPandas().to_numpy()


def _depth(n: int, block_rows: int) -> int:
    return max(0, int(np.ceil(np.log2(max(1, n / block_rows)))))


def _box_distances(numeric: list[str]):
    """Squared distances of a row to the nearest and to the farthest point of a box, numeric columns alone."""
    near, far = F.lit(0.0), F.lit(0.0)
    for c in numeric:
        below, above = F.col(f"{c}_lo") - F.col(c).cast("double"), F.col(c).cast("double") - F.col(f"{c}_hi")
        near = near + F.pow(F.greatest(below, above, F.lit(0.0)), 2)
        far = far + F.pow(F.greatest(-below, -above), 2)
    return near, far


def _boxed(rows: DataFrame, numeric: list[str], block_rows: int) -> DataFrame:
    """Add ``box``: every crowded cell is cut again, by a tree that its own task fits to a sample of its rows."""
    sizes = rows.groupBy("cell").agg(F.count("*").alias("size")).where(F.col("size") > block_rows)
    picked = rows.join(sizes, "cell").select("cell", "size", "first", *[F.col(c).cast("double").alias(c) for c in numeric])
    picked = top_per(picked, ["cell"], [shuffle_key(2, "first"), "first"], SAMPLE_ROWS)

    def fit(part: pd.DataFrame) -> pd.DataFrame:
        nodes = _cuts(part[numeric].to_numpy(), _depth(int(part["size"].iloc[0]), block_rows))
        return pd.DataFrame({"cell": part["cell"].iloc[:1], "columns": [[c for c, _ in nodes]], "cuts": [[t for _, t in nodes]]})

    trees = materialize(picked.groupBy("cell").applyInPandas(fit, "cell long, columns array<int>, cuts array<double>"), "trees")
    values = F.array(*[F.col(c).cast("double") for c in numeric])
    levels = F.sequence(F.lit(1), F.round(F.log2(F.size("cuts") + 1)).cast("int"))

    def down(at, _):
        return 2 * at + 1 + (F.get(values, F.get("columns", at)) > F.get("cuts", at)).cast("int")

    leaf = F.when(F.size("cuts") > 0, F.aggregate(levels, F.lit(0), down) - F.size("cuts"))
    found = rows.join(trees, "cell", "left").withColumn("box", F.col("cell") * (1 << 32) + F.coalesce(leaf, F.lit(0)))
    return materialize(found.drop("columns", "cuts"), "boxed")
