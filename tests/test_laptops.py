import pytest

from catalens.operators import profile
from catalens.plans import laptops
from catalens.sources.tables import LAPTOPS
from pyspark.sql import functions as F

GOOD = (1, "Acer", "Notebook", 15.6, "Full HD 1920x1080", "Intel Core i5 2.3GHz", "8GB", "256GB SSD", "Intel HD 620",
        "Windows 10", "1.37kg", 1000.0)


def raw(spark, *changes):
    names = [f.split()[0] for f in LAPTOPS.split(", ")]
    rows = [tuple(change.get(n, v) for n, v in zip(names, GOOD)) for change in changes]
    return spark.createDataFrame(rows, LAPTOPS)


def test_features(spark):
    r = laptops.feature_table(raw(spark, {})).first().asDict()
    assert list(r) == ["unnamed_0", *laptops.FEATURES, "price", "label"]
    assert (r["ram"], round(r["weight"], 2), r["touchscreen"], r["ips"], r["hdd"], r["ssd"]) == (8, 1.37, 0, 0, 0, 256)
    assert r["ppi"] == pytest.approx(141.2, abs=0.1)
    assert r["label"] == pytest.approx(6.907755)


def test_only_arm_is_dropped(spark):
    df = raw(spark, {"gpu": "ARM Mali"}, {"gpu": None}, {"gpu": "Armory X"}, {"gpu": "Nvidia GTX"})
    got = [r["gpu_brand"] for r in laptops.without_arm(laptops.parsed(df)).collect()]
    assert sorted(got, key=str) == ["Armory", None, "Nvidia"] or set(got) == {"Armory", None, "Nvidia"}


def test_malformed_numbers_raise_or_are_counted(spark):
    df = raw(spark, {}, {"ram": "lots"}, {"weight": "?kg"}, {"ram": None})
    with pytest.raises(Exception):
        laptops.parsed(df).select("ram").collect()
    lenient = laptops.parsed(df, strict=False).select("ram", "weight").collect()
    assert [r["ram"] for r in lenient] == [8, None, 8, None]
    counts = profile.rejects(df, {"ram": (F.col("ram"), laptops.ram_gb(False)), "weight": (F.col("weight"), laptops.weight_kg(False))})
    assert dict(map(tuple, counts.collect())) == {"ram": 1, "weight": 1}


def test_nulls_pass_through(spark):
    names = [f.split()[0] for f in LAPTOPS.split(", ")]
    empty = laptops.parsed(raw(spark, {n: None for n in names})).first()
    assert all(v is None for v in empty)


REQUEST = (1, "Acer", "Notebook", 8, 1.5, "Yes", "No", 15.6, "1920x1080", "Intel Core i5", 0, 256, "Intel", "Windows")
REQUEST_SCHEMA = (
    "request_id long, company string, type_name string, ram int, weight double, touchscreen string, ips string, "
    "inches double, resolution string, cpu_brand string, hdd int, ssd int, gpu_brand string, os string"
)


def test_request_rules(spark):
    training = laptops.feature_table(raw(spark, {}))
    names = [f.split()[0] for f in REQUEST_SCHEMA.split(", ")]
    changes = [{}, {"ram": 7}, {"touchscreen": "Maybe"}, {"inches": 18.5}, {"inches": 18.0}, {"resolution": "800x600"},
               {"hdd": 1}, {"ssd": None}, {"company": "Nobody"}, {"os": None, "gpu_brand": "Matrox"}]
    rows = [tuple({**dict(zip(names, REQUEST)), **c, "request_id": i}[n] for n in names) for i, c in enumerate(changes)]
    got = laptops.rejected_requests(spark.createDataFrame(rows, REQUEST_SCHEMA), training).collect()
    assert sorted(map(tuple, got)) == [
        (1, "ram"), (2, "touchscreen"), (3, "inches"), (5, "resolution"), (6, "hdd"), (7, "ssd"), (8, "company"),
        (9, "gpu_brand"), (9, "os"),
    ]


def test_request_features(spark):
    r = laptops.request_features(spark.createDataFrame([REQUEST], REQUEST_SCHEMA)).first()
    assert list(r.asDict()) == ["request_id", *laptops.FEATURES]
    assert (r["touchscreen"], r["ips"]) == (1, 0)
    assert r["ppi"] == pytest.approx(141.2, abs=0.1)
