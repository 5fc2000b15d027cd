import numpy as np
import pytest
from pyspark.ml import Pipeline
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array

from catalens.fixtures import view
from catalens.plans import laptops, price_models as P
from catalens.plans.kernel import KernelRegressor, gaussian
from catalens.sources import tables

SF_DIR = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def sides(spark):
    return P.split(P.model_rows(laptops.feature_table(view(spark, SF_DIR, "laptop_raw"))))


@pytest.fixture(scope="module")
def encoder(sides):
    return P.fit_encoder(sides[0])


def matrix(encoder, rows):
    data = encoder.transform(rows).select(vector_to_array("features"), "label").collect()
    return np.array([r[0] for r in data]), np.array([r[1] for r in data])


def scores(predicted, name="m"):
    return P.metrics(predicted, name).first()


def test_split_is_disjoint_and_complete(sides):
    train, test = sides
    assert train.join(test, P.KEY, "left_semi").count() == 0
    assert 0.12 < test.count() / (train.count() + test.count()) < 0.18


def test_one_hot_drops_the_first_category(encoder, sides):
    names = P.encoded_names(encoder)
    assert "company_Acer" not in names and "company_Apple" in names
    rows = P.encoded_columns(encoder, sides[1]).collect()
    for prefix in ("company_", "os_"):
        cells = [[v for c, v in r.asDict().items() if c.startswith(prefix)] for r in rows]
        assert all(sum(c) in (0.0, 1.0) for c in cells)


def test_unseen_category_is_an_error(encoder, sides):
    from pyspark.sql import functions as F

    with pytest.raises(Exception):
        encoder.transform(sides[1].withColumn("os", F.lit("Plan 9"))).select("features").collect()


def test_least_squares_like_numpy(encoder, sides):
    train, test = sides
    x, y = matrix(encoder, train)
    beta, *_ = np.linalg.lstsq(np.column_stack([np.ones(len(x)), x]), y, rcond=None)
    x_test, y_test = matrix(encoder, test)
    expected = np.column_stack([np.ones(len(x_test)), x_test]) @ beta
    got = P.fit(P.least_squares(), encoder, train).transform(test).select("prediction", "label").collect()
    assert np.allclose(sorted(r[0] for r in got), sorted(expected), atol=1e-6)
    r2 = 1 - ((y_test - expected) ** 2).sum() / ((y_test - y_test.mean()) ** 2).sum()
    assert scores(P.fit(P.least_squares(), encoder, train).transform(test))["r2"] == pytest.approx(r2, abs=1e-5)


@pytest.fixture(scope="module")
def models(sides):
    return P.fit_all(sides[0])


FLOORS = {"least_squares": 0.75, "nearest": 0.75, "tree": 0.95, "forest": 0.9, "kernel": 0.75}


def test_leaderboard(models, sides):
    assert scores(P.mean_prediction(*sides))["r2"] < 0.01
    board = {r["model"]: r for r in P.leaderboard(models, sides[1]).collect()}
    assert board.keys() == FLOORS.keys() and len({r["n"] for r in board.values()}) == 1
    assert all(board[name]["r2"] >= floor for name, floor in FLOORS.items()), board


def test_nearest_rows_are_saved(spark, models, sides, tmp_path):
    models["nearest"].save(str(tmp_path / "m"))
    rows = lambda m: sorted(map(tuple, m.transform(sides[1]).select(P.KEY, "prediction").collect()))
    first, again = rows(models["nearest"]), rows(P.NearestModel.load(spark, str(tmp_path / "m")))
    assert len(first) > 100 and all(a == pytest.approx(b) for a, b in zip(first, again))


def requests(spark, train):
    raw = view(spark, SF_DIR, "requests_raw")
    bad = laptops.rejected_requests(raw, train).select("request_id").distinct()
    return laptops.request_features(raw.join(bad, "request_id", "left_anti"))


@pytest.mark.parametrize("name", ["nearest", "kernel", "forest"])
def test_requests_are_priced(spark, models, sides, tmp_path, name):
    """Every model prices requests, which have neither label nor listing number, and a stored pipeline prices them alike."""
    asked = requests(spark, sides[0])
    prices = dict(map(tuple, P.score_requests(models[name], asked).collect()))
    low, high = sides[0].selectExpr("min(price)", "max(price)").first()
    assert len(prices) == asked.count() > 100 and all(p > 0 for p in prices.values())
    if name != "kernel":  # averages of training prices
        assert all(low - 1 <= p <= high for p in prices.values())
    if name != "nearest":
        tables.save_model(models[name], str(tmp_path / name))
        assert dict(map(tuple, P.score_requests(tables.load_model(str(tmp_path / name)), asked).collect())) == prices


def test_forest_prices_by_its_nodes(spark, models, sides, tmp_path):
    """Every price is the mean of the leaves that the stored nodes lead to."""
    tables.save_model(models["forest"], str(tmp_path / "f"))
    nodes = {}
    stored = next((tmp_path / "f" / "stages").glob("*RandomForest*")) / "data"
    for r in spark.read.parquet(str(stored)).collect():
        nodes[r["treeID"], r["nodeData"]["id"]] = r["nodeData"]

    def leaf(tree, x):
        node = nodes[tree, 0]
        while node["leftChild"] >= 0:
            split = node["split"]
            left = x[split["featureIndex"]] <= split["leftCategoriesOrThreshold"][0] if split["numCategories"] < 0 else (
                x[split["featureIndex"]] in split["leftCategoriesOrThreshold"])
            node = nodes[tree, node["leftChild"] if left else node["rightChild"]]
        return node["prediction"]

    asked = requests(spark, sides[0]).where("request_id % 5 = 0")
    rows = models["forest"].transform(asked).select("request_id", vector_to_array("features").alias("x"), "prediction").collect()
    prices = dict(map(tuple, P.score_requests(models["forest"], asked).collect()))
    trees = {t for t, _ in nodes}
    assert len(trees) == 100 and len(rows) > 100
    for r in rows:
        mean = np.mean([leaf(t, r["x"]) for t in trees])
        assert r["prediction"] == pytest.approx(mean) and prices[r["request_id"]] == int(np.exp(r["prediction"]))


def exact_kernel(x, y, gamma, c=10000.0, epsilon=0.1, rounds=30):
    """The same loss with the kernel of all rows: reweighted least squares on one coefficient per row and an offset."""
    k, n = gaussian(x, x, gamma), len(x)
    weight, goal = np.ones(n), y
    for _ in range(rounds):
        used = weight > 0
        m = int(used.sum())
        system = np.block([[k[np.ix_(used, used)] + np.diag(1.0 / (c * weight[used])), np.ones((m, 1))], [np.ones((1, m)), np.zeros((1, 1))]])
        solved = np.linalg.solve(system, np.append(goal[used], 0.0))
        fitted = k[:, used] @ solved[:-1] + solved[-1]
        over = np.abs(y - fitted) - epsilon
        alpha = np.zeros(n)
        alpha[used] = solved[:-1]
        weight, goal = np.where(over > 0, 1.0 / np.maximum(over, 1e-3), 0.0), y - np.sign(y - fitted) * epsilon
        if not weight.any():
            break
    return alpha, solved[-1]


def test_kernel_is_close_to_the_exact_one(encoder, sides):
    train, test = sides
    sample = train.orderBy("unnamed_0").limit(700)
    x, y = matrix(encoder, sample)
    x_test, y_test = matrix(encoder, test)
    gamma = 1.0 / (x.shape[1] * x.var())
    alpha, offset = exact_kernel(x, y, gamma)
    r2 = lambda p: 1 - ((y_test - p) ** 2).sum() / ((y_test - y_test.mean()) ** 2).sum()
    exact = r2(gaussian(x_test, x, gamma) @ alpha + offset)
    model = P.fit(KernelRegressor(), encoder, sample)
    assert model.stages[-1].gamma == pytest.approx(gamma)
    got = scores(model.transform(test))["r2"]
    print(exact, got)
    assert abs(got - exact) < 0.02


def test_kernel_regressor_in_a_pipeline(spark, sides, tmp_path):
    """An unfitted pipeline with the regressor is saved, loaded and fitted; constant rows and few rows do no harm."""
    pipeline = Pipeline(stages=[*P.encoder_stages(), KernelRegressor(size=20, rounds=3)])
    pipeline.write().overwrite().save(str(tmp_path / "p"))
    fitted = Pipeline.load(str(tmp_path / "p")).fit(sides[0])
    assert fitted.stages[-1].landmarks.shape[0] == 20 and fitted.transform(sides[1]).count() == sides[1].count()
    flat = VectorAssembler(inputCols=["a", "b"], outputCol="features").transform(spark.range(5).selectExpr("1.0D a", "1.0D b", "3.0D label"))
    assert [r["prediction"] for r in KernelRegressor().fit(flat).transform(flat).collect()] == pytest.approx([3.0] * 5, abs=0.2)


def test_saved_model_scores_requests_alike(spark, encoder, sides, tmp_path):
    train, _ = sides
    model = P.fit(P.tree(), encoder, train)
    tables.save_model(model, str(tmp_path / "model"))
    asked = requests(spark, train)
    first = sorted(map(tuple, P.score_requests(model, asked).collect()))
    again = sorted(map(tuple, P.score_requests(tables.load_model(str(tmp_path / "model")), asked).collect()))
    assert first == again and len(first) > 100
    assert all(isinstance(p, int) and p > 0 for _, p in first)
