"""The data behind each chart; drawing is left to the caller.

Each operator shuffles a fixed number of cells (categories, bins, grid points, replicates), never the rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

# Ranks that the quantile sketch tells apart, and the quantiles that binning needs.
ACCURACY = 20_000
QUARTILES = (0.25, 0.75)


def mean_by_category(df: DataFrame, category: str, value: str, digits: int = 4) -> DataFrame:
    return df.groupBy(category).agg(
        F.round(F.avg(value), digits).alias("mean_value"), F.count("*").alias("n")
    )


# The prime modulus of the replicate hash.
HASH_PRIME = 268435399
#: Cumulative Poisson(1) probabilities, as far as draws of 28 bits can tell them from one.
POISSON_CDF = [sum(math.exp(-1) / math.factorial(i) for i in range(n + 1)) for n in range(13)]
#: Rows whose replicates are drawn at once.
DRAW_ROWS = 2048


def _hash28(c: Column, at: int) -> Column:
    return F.conv(F.substring(F.md5(c), at, 7), 16, 10).cast("long")


def bootstrap_interval(
    df: DataFrame, category: str, value: str, key: str, replicates: int = 1000, units: int | None = None, seed: int = 0,
    digits: int = 4,
) -> DataFrame:
    """95 % interval of the mean per category, by Poisson bootstrap over rows.

    Replicate b weights a row with a Poisson(1) draw from two 28-bit hashes of its key and of b, so draws do not depend on
    partitioning. Each task adds up categories x replicates sums and shuffles only these. With ``units`` the rows of a
    category are first summed into that many random units, which are resampled instead: cheaper and coarser.
    """
    known = df.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double")))
    text = F.concat_ws("|", F.col(key).cast("string"), F.lit(str(seed)))
    rows = known.select(category, _hash28(text, 1).alias("h"), _hash28(text, 8).alias("g"),
                        F.col(value).cast("double").alias("s"), F.lit(1).cast("long").alias("n"))
    if units is not None:
        unit = F.pmod(F.col("h"), F.lit(units)).cast("string")
        rows = rows.groupBy(category, unit.alias("unit")).agg(F.sum("s").alias("s"), F.sum("n").alias("n")).select(
            category, _hash28(F.concat(F.lit("u"), "unit"), 1).alias("h"), _hash28(F.concat(F.lit("u"), "unit"), 8).alias("g"), "s", "n")
    cdf = np.array(POISSON_CDF)
    b = np.arange(1, replicates + 1, dtype=np.int64)
    first, second, shift = (x % HASH_PRIME for x in (b**3 * 7919 + b * 104729 + 12345, b * b * 7477 + b * 3571 + 99991, b * b * 15485863 + 32452843))

    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict = {}
        for batch in batches:
            for at in range(0, len(batch), DRAW_ROWS):
                part = batch.iloc[at : at + DRAW_ROWS]
                u = (np.outer(part["h"], first) + np.outer(part["g"], second) + shift) % HASH_PRIME / float(HASH_PRIME)
                weight = np.searchsorted(cdf, u, "right").astype(float)
                for name, own in part.reset_index(drop=True).groupby(category, dropna=False):
                    total = sums.setdefault(None if pd.isna(name) else name, np.zeros((2, replicates)))
                    total += np.stack([own["s"], own["n"]]).astype(float) @ weight[own.index]
        for name, total in sums.items():
            yield pd.DataFrame({category: name, "b": b, "ws": total[0], "wn": total[1]})

    kind = df.schema[category].dataType.simpleString()
    return _interval(rows.mapInPandas(draw, f"{category} {kind}, b long, ws double, wn double"), category, digits)


def bootstrap_by_value(df: DataFrame, category: str, value: str, replicates: int = 1000, seed: int = 0, digits: int = 4) -> DataFrame:
    """The same interval with one draw for all equal rows, so that the work grows with distinct values and needs no key.

    The weights of m equal rows add up to a Poisson(m) draw. It is drawn from a generator that (category, value) seeds, which
    depends on nothing else; a value that a third of all rows share costs as much as any other.
    """
    v = F.col(value).cast("double")
    known = df.where(v.isNotNull() & ~F.isnan(v)).groupBy(category, v.alias("v")).agg(F.count("*").alias("m"))
    rows = known.select(category, "v", "m", F.xxhash64(F.col(category).cast("string"), "v").alias("h"))
    b = np.arange(1, replicates + 1, dtype=np.int64)

    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict = {}
        for batch in batches:
            for name, x, m, h in batch.itertuples(index=False):
                weight = np.random.default_rng([seed, h & (2**64 - 1)]).poisson(m, replicates).astype(float)
                total = sums.setdefault(None if pd.isna(name) else name, np.zeros((2, replicates)))
                total += np.stack([x * weight, weight])
        for name, total in sums.items():
            yield pd.DataFrame({category: name, "b": b, "ws": total[0], "wn": total[1]})

    kind = df.schema[category].dataType.simpleString()
    return _interval(rows.mapInPandas(draw, f"{category} {kind}, b long, ws double, wn double"), category, digits)


def _interval(drawn: DataFrame, category: str, digits: int) -> DataFrame:
    """From sums of weighted values and of weights, per task and replicate, to the bounds per category."""
    means = drawn.groupBy(category, "b").agg(F.try_divide(F.sum("ws"), F.sum("wn")).alias("m"))
    bounds = means.groupBy(category).agg(F.percentile("m", F.array(F.lit(0.025), F.lit(0.975))).alias("q"))
    return bounds.select(
        category, F.round(F.get("q", 0), digits).alias("low"), F.round(F.get("q", 1), digits).alias("high")
    )


def summarize(df: DataFrame, value: str):
    """n, lo, hi and ``near``: values around both quartiles, from one mergeable quantile sketch, all in one scan.

    The sketch is off by at most 1 / ACCURACY of all ranks, so each quartile lies between its two values.
    """
    off = 2.0 / ACCURACY
    near = F.percentile_approx(value, F.array(*[F.lit(q + d) for q in QUARTILES for d in (-off, off)]), F.lit(ACCURACY))
    return df.agg(F.count(value).alias("n"), F.min(value).alias("lo"), F.max(value).alias("hi"), near.alias("near")).first()


def quartiles(df: DataFrame, value: str, summary=None) -> tuple[float, float]:
    """Exact first and third quartile with linear interpolation; missing values and NaN left out.

    One scan brackets them (``summarize``), a second one counts: rows between the brackets by stretch, rows inside by value. Of
    those there are a few of ACCURACY (all, if the table has hardly more rows than that), and they alone are put in order.
    """
    if summary is None:
        df = df.where(~F.isnan(value))
        summary = summarize(df, value)
    places = [q * (summary["n"] - 1) for q in QUARTILES]
    ranks = sorted({f(at) for at in places for f in (math.floor, math.ceil)})
    low1, high1, low2, high2 = summary["near"] if summary["n"] > 4 * ACCURACY else (summary["lo"], summary["hi"]) * 2
    v = F.col(value)
    inside = v.between(low1, high1) | v.between(low2, high2)
    stretch = F.when(v < low1, 0).when(v <= high1, 1).when(v < low2, 2).when(v <= high2, 3).otherwise(4)
    counted = df.where(v.isNotNull()).groupBy(stretch.alias("stretch"), F.when(inside, v).alias("v")).agg(F.count("*").alias("n"))
    upto = F.sum("n").over(Window.orderBy("stretch", "v"))
    ordered = counted.withColumn("upto", upto).where(
        F.exists(F.array(*map(F.lit, ranks)), lambda r: (r < F.col("upto")) & (r >= F.col("upto") - F.col("n"))))
    found = {}
    for row in ordered.collect():  # a row for each of at most four ranks
        found |= {rank: row["v"] for rank in ranks if row["upto"] - row["n"] <= rank < row["upto"]}
    out = []
    for at in places:
        lower, upper = found[math.floor(at)], found[math.ceil(at)]
        out.append((math.ceil(at) - at) * lower + (at - math.floor(at)) * upper if upper != lower else lower)
    return tuple(out)


def _numbers(df: DataFrame, value: str) -> DataFrame:
    """The values as ``v``, without null and NaN."""
    return df.select(F.col(value).cast("double").alias("v")).where("v IS NOT NULL AND NOT isnan(v)")


def bin_count(n: int, low: float, high: float, q1: float, q3: float) -> int:
    """Automatic number of bins: the narrower of the Freedman-Diaconis and the Sturges width."""
    if n == 0 or high == low:
        return 1
    sturges = (high - low) / (math.log2(n) + 1.0)
    freedman = 2.0 * (q3 - q1) / n ** (1.0 / 3.0)
    return math.ceil((high - low) / (min(sturges, freedman) if freedman > 0 else sturges))


def histogram(df: DataFrame, value: str) -> DataFrame:
    """(bin, bin_start, bin_end, n) for the non-empty bins of the automatic binning; null and NaN are left out."""
    df = _numbers(df, value)
    s = summarize(df, "v")
    if s["n"] == 0:
        return df.selectExpr("CAST(0 AS BIGINT) AS bin", "v AS bin_start", "v AS bin_end", "CAST(0 AS BIGINT) AS n")
    q1, q3 = quartiles(df, "v", s)
    lo, hi, k = s["lo"], s["hi"], bin_count(s["n"], s["lo"], s["hi"], q1, q3)
    width = F.lit(hi) - F.lit(lo)
    spot = F.least(F.floor((F.col("v") - lo) * k / width), F.lit(k - 1)) if hi > lo else F.lit(0)
    return (
        df.groupBy(spot.cast("long").alias("bin"))
        .agg(F.count("*").alias("n"))
        .select(
            "bin",
            (F.lit(lo) + F.col("bin") * width / k).alias("bin_start"),
            (F.lit(lo) + (F.col("bin") + 1) * width / k).alias("bin_end"),
            "n",
        )
    )


def density(df: DataFrame, value: str, points: int = 200, digits: int = 9) -> DataFrame:
    """Gaussian kernel density on an even grid from minimum to maximum, Scott bandwidth; null and NaN are left out.

    Equal values are counted first; then every task adds its values to a grid of its own, and only grids are shuffled.
    """
    df = _numbers(df, value)
    stats = df.agg(
        F.count("v").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"), F.stddev_samp("v").alias("s")
    ).first()
    n, lo, hi = stats["n"], stats["lo"], stats["hi"]
    h = (stats["s"] or 0.0) * n**-0.2 if n else 0.0
    if h == 0.0:  # fewer than two different values: no density
        return df.selectExpr("CAST(0 AS BIGINT) AS point", "v AS x", "v AS density").limit(0)
    grid = lo + np.arange(points) * (hi - lo) / (points - 1)

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(points)
        for batch in batches:
            for at in range(0, len(batch), DRAW_ROWS):
                part = batch.iloc[at : at + DRAW_ROWS]
                z = (part["v"].to_numpy()[:, None] - grid) / h
                total += part["times"].to_numpy() @ np.exp(-z * z / 2)
        yield pd.DataFrame({"point": np.arange(points), "x": grid, "k": total})

    grids = df.groupBy("v").agg(F.count("*").alias("times")).mapInPandas(add, "point long, x double, k double")
    return grids.groupBy("point", "x").agg(F.sum("k").alias("k")).select(
        "point",
        F.round("x", 6).alias("x"),
        F.round(F.col("k") / (n * h * math.sqrt(2 * math.pi)), digits).alias("density"),
    )


def scatter_grid(df: DataFrame, x: str, y: str, bins: int = 50) -> DataFrame:
    """Counts on a bins x bins grid over the value ranges: a scatter plot of any number of points, NaN left out."""
    df = df.select(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")).dropna("any").where(
        "NOT isnan(x) AND NOT isnan(y)")
    s = df.agg(F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1")).first()

    def spot(name: str, lo, hi) -> Column:
        if lo is None or hi == lo:
            return F.lit(0).cast("long")
        return F.least(F.floor((F.col(name) - lo) * bins / (F.lit(hi) - F.lit(lo))), F.lit(bins - 1)).cast("long")

    return df.groupBy(spot("x", s["x0"], s["x1"]).alias("bin_x"), spot("y", s["y0"], s["y1"]).alias("bin_y")).agg(
        F.count("*").alias("n")
    )
