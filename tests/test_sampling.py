from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from catalens.operators.positions import positions
from catalens.operators.sampling import drawn, related_to, related_to_all

# One person in most rows, one title in most of theirs.
ROWS = (
    [("hot", i, f"T{i}" if i % 3 else "Same") for i in range(120)]
    + [("pair", 200, "A"), ("pair", 201, "B")]
    + [("alone", 300, "Only"), ("alone", 301, "Only")]
    + [("few", 400 + i, f"F{i}") for i in range(4)]
)


def members(spark, parts):
    return spark.createDataFrame(ROWS, "person string, id long, title string").repartition(parts)


def test_positions(spark):
    got = positions(members(spark, 7), "person", ["id"]).collect()
    by_person = defaultdict(list)
    for r in got:
        by_person[r["person"]].append((r["id"], r["pos"], r["total"]))
    for rows in by_person.values():
        assert [p for _, p, _ in sorted(rows)] == list(range(len(rows)))
        assert {t for _, _, t in rows} == {len(rows)}
    whole = positions(members(spark, 5), None, ["id"]).orderBy("id").collect()
    assert [r["pos"] for r in whole] == list(range(len(ROWS)))


@pytest.mark.parametrize("parts", [1, 7])
def test_all_seeds(spark, parts):
    m = members(spark, parts)
    seeds = m.select(F.col("id").alias("seed_id"), "title", "person")
    got = related_to_all(seeds, m, ["id"], 5).collect()
    info = {i: (p, t) for p, i, t in ROWS}
    chosen = defaultdict(list)
    for r in got:
        assert r["title"] == info[r["id"]][1]
        chosen[r["seed_id"]].append(r["id"])
    for person, seed, title in ROWS:
        eligible = {i for p, i, t in ROWS if p == person and t != title}
        picked = chosen.get(seed, [])
        assert len(picked) == len(set(picked)) == min(5, len(eligible))
        assert set(picked) <= eligible
    # every eligible row is about equally likely to be chosen
    times = defaultdict(int)
    for picked in chosen.values():
        for i in picked:
            times[i] += 1
    assert len([i for i in range(120) if times[i] > 0]) > 100


def test_all_seeds_do_not_depend_on_partitions(spark):
    runs = []
    for parts in (1, 16):
        m = members(spark, parts)
        seeds = m.select(F.col("id").alias("seed_id"), "title", "person")
        runs.append(sorted(map(tuple, related_to_all(seeds, m, ["id"], 5).collect())))
    assert runs[0] == runs[1]


def test_every_match(spark):
    seeds = spark.createDataFrame([("Same", "hot"), ("A", "pair"), ("Only", "alone")], "seed_title string, person string")
    every = related_to(seeds, members(spark, 3), ["id"]).collect()
    count = defaultdict(int)
    for r in every:
        count[r["seed_title"]] += 1
    assert count == {"Same": 80, "A": 1}


def test_few_seeds_get_what_all_seeds_get(spark):
    m = members(spark, 3)
    seeds = m.select(F.col("id").alias("seed_id"), "title", "person")
    every = {tuple(r) for r in related_to_all(seeds, m, ["id"], 5).select("seed_id", "rank", "id").collect()}
    few = related_to_all(seeds.where("seed_id IN (7, 200)"), m, ["id"], 5).select("seed_id", "rank", "id").collect()
    assert {tuple(r) for r in few} == {x for x in every if x[0] in (7, 200)}


def test_every_set_is_equally_likely(spark):
    got = spark.range(6000).select(F.sort_array(drawn(F.lit(5).cast("long"), 2, 1, "id")).alias("s")).groupBy("s").count().collect()
    assert len(got) == 10 and all(abs(r["count"] - 600) < 120 for r in got)
    assert [list(r[0]) for r in spark.range(3).select(F.sort_array(drawn(F.lit(3).cast("long"), 5, 0, "id"))).collect()] == [[0, 1, 2]] * 3
