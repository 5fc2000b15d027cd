"""Laptop listings: from raw text columns to the typed feature table, and the checks on scoring requests.

Everything up to the feature table is one projection over the scan: no shuffle, no Python worker.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from catalens.functions import scalars as S

CATEGORICAL = ["company", "type_name", "cpu_brand", "gpu_brand", "os"]
NUMERIC = ["ram", "weight", "touchscreen", "ips", "ppi", "hdd", "ssd"]
# The column order of the feature table.
FEATURES = [
    "company", "type_name", "ram", "weight", "touchscreen", "ips", "ppi", "cpu_brand", "hdd", "ssd", "gpu_brand", "os",
]
# What a scoring request may hold.
RAM_CHOICES = [2, 4, 6, 8, 12, 16, 24, 32, 64]
YES_NO = ["No", "Yes"]
INCH_RANGE = (10.0, 18.0)
RESOLUTIONS = [
    "1920x1080", "1366x768", "1600x900", "3840x2160", "3200x1800", "2880x1800", "2560x1600", "2560x1440", "2304x1440",
]
HDD_CHOICES = [0, 128, 256, 512, 1024, 2048]
SSD_CHOICES = [0, 8, 128, 256, 512, 1024]


def ram_gb(strict: bool = True) -> Column:
    text = S.strip_literal(F.col("ram"), "GB")
    return text.cast("int") if strict else text.try_cast("int")


def weight_kg(strict: bool = True) -> Column:
    text = S.strip_literal(F.col("weight"), "kg")
    return text.cast("float") if strict else text.try_cast("float")


def screen(strict: bool = True) -> Column:
    """Pixel rows of the screen; with ``strict`` off null where the resolution is unreadable."""
    x, y = S.resolution(F.col("screen_resolution"), strict)
    return F.when(x.isNotNull(), y)


def storage(strict: bool = True) -> Column:
    """Both storage sizes added up; null where either is unreadable."""
    return sum((S.digits(part, strict) for part in S.storage_parts(F.col("memory"))), F.lit(0))


# Output column and the storage kind it sums.
STORAGE_KINDS = {"hdd": "HDD", "ssd": "SSD", "hybrid": "Hybrid", "flash_storage": "Flash Storage"}


def parsed(raw: DataFrame, strict: bool = True) -> DataFrame:
    """All derived columns of a raw listing. Malformed numbers raise when ``strict``, else they become null.

    Three projections, so that a split or pattern match used by several columns is evaluated once per row.
    """
    x, y = S.resolution(F.col("screen_resolution"), strict)
    first, second = S.storage_parts(F.col("memory"))
    cut = raw.select(
        "unnamed_0", "company", "type_name", "inches", "screen_resolution", "op_sys", "price",
        ram_gb(strict).alias("ram"),
        weight_kg(strict).alias("weight"),
        x.alias("x_res"), y.alias("y_res"),
        S.first_words(F.col("cpu"), 3).alias("cpu_name"),
        S.first_word(F.col("gpu")).alias("gpu_brand"),
        first.alias("first_part"), second.alias("second_part"),
    )
    sized = cut.select(
        *cut.columns, S.digits(F.col("first_part"), strict).alias("first_size"),
        S.digits(F.col("second_part"), strict).alias("second_size")
    )
    parts = [F.col(c) for c in ("first_size", "second_size")]
    return sized.select(
        "unnamed_0", "company", "type_name", "inches", "ram", "weight",
        S.flag(F.col("screen_resolution"), "Touchscreen").alias("touchscreen"),
        S.flag(F.col("screen_resolution"), "IPS").alias("ips"),
        "x_res", "y_res",
        S.pixel_density(F.col("x_res"), F.col("y_res"), F.col("inches")).alias("ppi"),
        "cpu_name",
        S.cpu_brand(F.col("cpu_name")).alias("cpu_brand"),
        *[
            S.storage_of_kind(F.col("first_part"), F.col("second_part"), kind, *parts).alias(name)
            for name, kind in STORAGE_KINDS.items()
        ],
        "gpu_brand",
        S.os_category(F.col("op_sys")).alias("os"),
        "price",
    )


def without_arm(df: DataFrame) -> DataFrame:
    """Drop ARM graphics; a missing brand is not ARM and stays."""
    return df.where(~F.col("gpu_brand").eqNullSafe("ARM"))


def feature_table(raw: DataFrame) -> DataFrame:
    """Key, the twelve features in their fixed order, price and the log-price label."""
    return without_arm(parsed(raw)).select("unnamed_0", *FEATURES, "price", F.log("price").alias("label"))


def request_features(requests: DataFrame) -> DataFrame:
    """Requests as typed feature rows: Yes/No to 1/0, resolution and size to pixel density."""
    x, y = S.split_once(F.col("resolution"), "x")
    made = {
        "touchscreen": F.when(F.col("touchscreen") == "Yes", 1).otherwise(0),
        "ips": F.when(F.col("ips") == "Yes", 1).otherwise(0),
        "ppi": S.pixel_density(x, y, F.col("inches")),
        "weight": F.col("weight").cast("float"),
    }
    return requests.select("request_id", *[made[c].alias(c) if c in made else F.col(c) for c in FEATURES])


def rejected_requests(requests: DataFrame, training: DataFrame) -> DataFrame:
    """(request_id, reject_reason), one row per broken rule.

    The categorical domains come from the training rows. Both sides are unpivoted to (field, value), so one scan of the
    training table and one anti join cover all five columns; the domain side is distinct values, built with map-side
    partial aggregation, and the join type is left to the optimizer, which sees its size.
    """
    rules = {
        "ram": F.col("ram").isin(RAM_CHOICES),
        "touchscreen": F.col("touchscreen").isin(YES_NO),
        "ips": F.col("ips").isin(YES_NO),
        "inches": F.col("inches").between(*INCH_RANGE),
        "resolution": F.col("resolution").isin(RESOLUTIONS),
        "hdd": F.col("hdd").isin(HDD_CHOICES),
        "ssd": F.col("ssd").isin(SSD_CHOICES),
    }
    broken = F.array_compact(
        F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items()])
    )
    by_rule = requests.select("request_id", F.explode(broken).alias("reject_reason"))

    def fields(df: DataFrame, *keep: str) -> DataFrame:
        pairs = F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).alias("value")) for c in CATEGORICAL])
        return df.select(*keep, F.explode(pairs).alias("f")).select(*keep, "f.field", "f.value")

    by_domain = (
        fields(requests, "request_id")
        .join(fields(training).distinct(), ["field", "value"], "left_anti")
        .select("request_id", F.col("field").alias("reject_reason"))
    )
    return by_rule.unionByName(by_domain)
