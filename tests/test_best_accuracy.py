"""Accuracy of the most frequent label, without a join of predictions to pairs."""

from corpusgauge.operators import accuracy, ngram


def test_best_accuracy_is_that_of_joined_predictions(spark):
    pairs = [(1, 2, 3), (1, 5, 3), (1, 7, 1), (2, 2, 4), (3, 1, 1), (None, 1, 2)]
    counts = spark.createDataFrame(pairs, "token int, label int, n long").where("token IS NOT NULL")
    best = ngram.best_next(counts.selectExpr("token AS prev", "label AS token", "n"), "pred").withColumnRenamed("prev", "token")
    old = accuracy.token_accuracy(counts.join(best, "token"), weight="n").first()
    new = accuracy.best_accuracy(counts)
    assert tuple(new.first()) == tuple(old) == (12, 8 / 12)
    assert "Join" not in new._jdf.queryExecution().executedPlan().toString()
    assert tuple(accuracy.best_accuracy(counts.limit(0)).first()) == (None, None)
