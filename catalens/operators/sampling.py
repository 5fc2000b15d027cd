"""Random choice of related rows, for chosen seeds or for all rows, by one definition."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from catalens.operators.joins import look_up
from catalens.operators.positions import positions


def shuffle_key(salt: int, *parts: str) -> Column:
    """A reproducible random order: it depends on the row's key and the salt, not on partitioning."""
    return F.md5(F.concat_ws("|", *[F.col(p).cast("string") for p in parts], F.lit(str(salt))))


def related_to(seeds: DataFrame, members: DataFrame, keys: list[str]) -> DataFrame:
    """(seed_title, keys, title): all members that share the seed's ``person`` under another title.

    ``seeds`` has (seed_title, person), any number of rows; how they meet the members is left to the optimizer.
    """
    return members.join(seeds, "person").where(F.col("title") != F.col("seed_title")).select("seed_title", *keys, "title")


def drawn(n: Column, k: int, salt: int, *parts: str) -> Column:
    """min(k, n) different whole numbers below ``n``, every set of them equally likely, in an order that is random too.

    Floyd's method: for j = n - k, ..., n - 1 draw a number up to j; if it is taken already, take j. Draws come from 60 bits
    of a hash of the key, the salt and j.
    """
    first = F.greatest(n - k, F.lit(0).cast("long"))

    def take(taken: Column, j: Column) -> Column:
        h = F.md5(F.concat_ws("|", *[F.col(p).cast("string") for p in parts], F.lit(str(salt)), j.cast("string")))
        t = F.pmod(F.conv(F.substring(h, 1, 15), 16, 10).cast("long"), j + 1)
        return F.concat(taken, F.array(F.when(F.array_contains(taken, t), j).otherwise(t)))

    return F.aggregate(F.sequence(first, n - 1), F.array().cast("array<long>"), take)


def related_to_all(seeds: DataFrame, members: DataFrame, keys: list[str], k: int = 5, salt: int = 0) -> DataFrame:
    """(seed keys, keys, title, rank): for every seed row up to ``k`` random members of its person under other titles.

    No pair within a person's group is formed. All members of a person stand in one random ring, equal titles side by
    side; a seed draws ``k`` places outside its own title's block, every choice of places equally likely, and reads them by
    (person, place), which are unique and so spread evenly whatever the group sizes. What a seed gets depends on its key
    alone, not on which other seeds are asked for.

    ``seeds``: (seed keys named ``seed_*``, person, title); ``members``: (person, keys, title).
    """
    ring = positions(
        members.select(
            "person", *keys, "title",
            shuffle_key(salt, "title").alias("title_order"), shuffle_key(salt, *keys).alias("row_order"),
        ),
        "person",
        ["title_order", "title", "row_order", *keys],
    )
    blocks = ring.groupBy("person", "title").agg(
        F.min("pos").alias("low"), F.count("*").alias("same"), F.max("total").alias("total")
    )
    seed_keys = [f"seed_{c}" for c in keys]
    others = F.col("total") - F.col("same")
    wanted = (
        look_up(seeds, blocks, ["person", "title"])
        .where(others > 0)
        .select(*seed_keys, "person", "low", "same", "total", F.posexplode(drawn(others, k, salt, *seed_keys)).alias("j", "at"))
        .select(
            *seed_keys, "person", F.pmod(F.col("low") + F.col("same") + F.col("at"), F.col("total")).alias("pos"),
            (F.col("j") + 1).cast("int").alias("rank"),
        )
    )
    return wanted.join(ring.select("person", "pos", *keys, "title"), ["person", "pos"]).drop("pos", "person")
