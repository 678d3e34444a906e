"""Personal data is learned from all candidates, also from more than one task takes."""

from __future__ import annotations

import numpy as np
import pytest

from feedloom.llm import pii


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")


def test_training_sees_more_candidates_than_one_task_takes(spark, docs):
    one = pii.train(docs, pii.Settings(trees=6))
    many = pii.train(docs, pii.Settings(trees=6, train_rows=40))
    assert many.features.shape == one.features.shape and many.thresholds.keys() == one.thresholds.keys()
    assert abs(many.prior - one.prior) < 0.2
    rows = [x for r in docs.collect() for x in pii.weak_labels(r.text or "")]
    x, y = np.array([r[1] for r in rows], float), np.array([r[2] for r in rows])
    wrong = [np.mean((f.predict(x) >= 0.5) != y) for f in (one, many)]
    assert wrong[1] <= wrong[0] + 0.02, wrong


def test_distributed_trees_are_those_of_one_task(spark):
    rng = np.random.default_rng(2)
    x = rng.integers(0, 4, size=(1500, len(pii.FEATURES))).astype(float)
    y = ((x[:, 1] > 1) ^ (rng.random(1500) < 0.05)).astype(int)
    settings = pii.Settings(trees=4)
    table = spark.createDataFrame(list(zip(x.tolist(), y.tolist())), "x array<double>, y int").repartition(3)
    one, many = pii.fit_forest(x, y, settings), pii.fit_forest_whole(table, settings)
    assert np.allclose(one.predict(x), many.predict(x), atol=1e-6)
