import numpy as np
import pytest
from pyspark.ml.regression import RandomForestRegressor

from catalens.fixtures import view
from catalens.plans import forest, laptops, price_models as P

SF_DIR = "/root/testdata/sf0.001"


def test_trees_grow_in_groups(spark, monkeypatch):
    """No fit grows more nodes at once than asked for, all trees are stored, they differ, and they are scored like MLlib scores them."""
    train, test = P.split(P.model_rows(laptops.feature_table(view(spark, SF_DIR, "laptop_raw"))))
    encoder, n = P.fit_encoder(train), train.count()
    fits, kept = [], RandomForestRegressor.fit
    monkeypatch.setattr(RandomForestRegressor, "fit", lambda self, rows: fits.append((kept(self, rows), self.getSeed())) or fits[-1][0])
    asked = P.forest()
    model = P.fit(asked._set(numTrees=7, groupNodes=3 * 2 * n), encoder, train)
    assert [m.getNumTrees for m, _ in fits] == [3, 3, 1] and len({s for _, s in fits}) == 3
    nodes = model.stages[-1].nodes
    assert [r["treeID"] for r in nodes.select("treeID").distinct().orderBy("treeID").collect()] == list(range(7))
    assert len({t.tobytes() for t in model.stages[-1].trees()}) == 7
    x = encoder.transform(test)
    means = [sum(t.predict(r["features"]) for m, _ in fits for t in m.trees) / 7 for r in x.select("features").collect()]
    assert [r["prediction"] for r in model.stages[-1].transform(x).select("prediction").collect()] == pytest.approx(means)


def test_categories_go_left_by_their_bits():
    tree = np.array([(0, 1, 1, 2, 5.0), (-1, 0, -1, -1, 1.5), (1, 0, 3, 4, 1024.0), (-1, 0, -1, -1, 2.5), (-1, 0, -1, -1, 3.5)], forest.NODE)
    x = np.array([[0.0, 0.0], [1.0, 5000.0], [2.0, 5000.0], [3.0, 1024.0]])  # categories 0 and 2 go left
    assert forest.leaf_values(tree, x).tolist() == [1.5, 3.5, 1.5, 2.5]
