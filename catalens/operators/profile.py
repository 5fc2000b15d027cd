"""Table profiling. Every operator is one pass with map-side partial aggregation, or a bounded top-n."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, functions as F
from pyspark.sql.types import NumericType


def _stacked(wide: DataFrame, label: str, names: list[str], value: str) -> DataFrame:
    """Turn a one-row frame with a column per name into (label, value) rows."""
    pairs = [F.struct(F.lit(n).alias(label), F.col(f"`{n}`").alias(value)) for n in names]
    return wide.select(F.explode(F.array(*pairs)).alias("p")).select(f"p.{label}", f"p.{value}")


def shape(df: DataFrame) -> DataFrame:
    return df.agg(F.count("*").alias("n_rows")).withColumn("n_columns", F.lit(len(df.columns)).cast("long"))


def info(df: DataFrame) -> DataFrame:
    """Position, name, type and non-null count of every column."""
    counted = df.agg(*[F.count(F.col(f"`{c}`")).alias(c) for c in df.columns])
    rows = [
        F.struct(
            F.lit(i).cast("long").alias("position"),
            F.lit(f.name).alias("column_name"),
            F.lit(f.dataType.simpleString()).alias("column_type"),
            F.col(f"`{f.name}`").alias("non_null"),
        )
        for i, f in enumerate(df.schema)
    ]
    return counted.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def null_counts(df: DataFrame) -> DataFrame:
    sums = [F.coalesce(F.sum(F.col(f"`{c}`").isNull().cast("long")), F.lit(0)).alias(c) for c in df.columns]
    return _stacked(df.agg(*sums), "column_name", df.columns, "n_nulls")


def duplicate_rows(df: DataFrame) -> DataFrame:
    """Rows equal to an earlier row over all columns; nulls count as equal.

    Rows are compared by a 256-bit digest of their JSON form, so wide text columns are not shuffled.
    """
    digest = F.sha2(F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns])), 256)
    groups = df.groupBy(digest.alias("digest")).agg(F.count("*").alias("copies"))
    return groups.agg(F.coalesce(F.sum(F.col("copies") - 1), F.lit(0)).alias("n_duplicates"))


def head(df: DataFrame, order: list[Column | str], n: int = 5) -> DataFrame:
    return df.orderBy(*order).limit(n)


def sample_rows(df: DataFrame, key: str, n: int, seed: int) -> DataFrame:
    """``n`` rows without replacement. The draw depends on key and seed only, not on partitioning."""
    return df.orderBy(F.md5(F.concat_ws("|", F.col(key).cast("string"), F.lit(str(seed)))), key).limit(n)


def value_counts(df: DataFrame, column: str) -> DataFrame:
    return (
        df.where(F.col(column).isNotNull())
        .groupBy(column)
        .agg(F.count("*").alias("n"))
        .orderBy(F.desc("n"), column)
    )


def unique_in_order(df: DataFrame, column: str, position: str) -> DataFrame:
    """Distinct values in the order of first appearance."""
    return df.groupBy(column).agg(F.min(position).alias("first_position")).orderBy("first_position")


def distinct_value_counts(df: DataFrame, column: str) -> DataFrame:
    """Frequency of the distinct values (always 1) beside how often each really occurs."""
    return (
        df.groupBy(column)
        .agg(F.count("*").alias("n_rows"))
        .groupBy(column)
        .agg(F.count("*").alias("n_distinct"), F.sum("n_rows").alias("n_rows"))
    )


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, NumericType)]


def correlation_with(df: DataFrame, target: str, digits: int = 6) -> DataFrame:
    """Pearson correlation of every numeric column with ``target`` in one pass; pairs with a null are skipped."""
    names = numeric_columns(df)
    wide = df.agg(*[F.corr(F.col(c).cast("double"), F.col(target).cast("double")).alias(c) for c in names])
    return _stacked(wide, "column_name", names, "r").withColumn("r", F.round("r", digits))


def rejects(df: DataFrame, checks: dict[str, tuple[Column, Column]]) -> DataFrame:
    """Per check, the rows whose source is present while the parsed value is not."""
    sums = [
        F.coalesce(F.sum((source.isNotNull() & parsed.isNull()).cast("long")), F.lit(0)).alias(name)
        for name, (source, parsed) in checks.items()
    ]
    return _stacked(df.agg(*sums), "check_name", list(checks), "n_rejects")




def reject_rows(df: DataFrame, key: str, checks: dict[str, tuple[Column, Column, str]]) -> DataFrame:
    """(key, check_name, raw_text, reason): a row for every value that is present while its parsed form is not.

    ``checks`` has (source, parsed, reason) by name. One projection: rows without a reject give none, others one for each.
    """
    marks = [
        F.when(source.isNotNull() & parsed.isNull(), F.struct(
            F.lit(name).alias("check_name"), source.cast("string").alias("raw_text"), F.lit(reason).alias("reason")))
        for name, (source, parsed, reason) in checks.items()
    ]
    found = F.filter(F.array(*marks), lambda x: x.isNotNull())
    return df.select(key, F.explode(found).alias("r")).select(key, "r.*")


def write_rejects(df: DataFrame, key: str, checks: dict[str, tuple[Column, Column, str]], path: str) -> dict[str, int]:
    """Write ``reject_rows`` to ``path``, one folder per check, and return the rows read and the rejects of each check.

    The counts are observed while the table is written, so ``df`` is read once.
    """
    seen = Observation()
    counts = [F.count_if(source.isNotNull() & parsed.isNull()).alias(name) for name, (source, parsed, _) in checks.items()]
    watched = df.observe(seen, F.count(F.lit(1)).alias("n_rows"), *counts)
    reject_rows(watched, key, checks).write.mode("overwrite").partitionBy("check_name").parquet(path)
    return {name: int(n or 0) for name, n in seen.get.items()}


def distinct_sketches(df: DataFrame, columns: list[str], by: list[str], lg_k: int = 12) -> DataFrame:
    """One row per group with a HyperLogLog sketch of every column: partial counts to store and to unite later.

    A sketch has about 2^lg_k / 2 bytes whatever the group holds; nulls are not counted. Groups are combined map-side.
    """
    return df.groupBy(*by).agg(*[F.hll_sketch_agg(F.col(c).cast("string"), F.lit(lg_k)).alias(c) for c in columns])


def distinct_estimates(sketches: DataFrame, columns: list[str], by: list[str]) -> DataFrame:
    """(by, column_name, estimate): the distinct values of the union of all sketches that agree in ``by``."""
    united = sketches.groupBy(*by).agg(*[F.hll_sketch_estimate(F.hll_union_agg(c)).alias(c) for c in columns])
    pairs = [F.struct(F.lit(c).alias("column_name"), F.col(c).alias("estimate")) for c in columns]
    return united.select(*by, F.explode(F.array(*pairs)).alias("p")).select(*by, "p.*")


def sketch_error(lg_k: int = 12) -> float:
    """Three standard errors of an estimate, as a share of the true number."""
    return 3 * 1.04 / 2 ** (lg_k / 2)
