"""Distributed walk-forward models against plain ones on small frames."""

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from edgeprobe.operators import audit, models


def plain_fit(x, y, weight, l2=1.0, rounds=25):
    mean, scale = x.mean(axis=0), x.std(axis=0)
    scale = np.where(scale > 0, scale, 1.0)
    a = np.hstack([(x - mean) / scale, np.ones((len(x), 1))])
    penalty, b = np.diag([l2] * x.shape[1] + [1e-9]), np.zeros(x.shape[1] + 1)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a @ b, -30, 30)))
        step = np.linalg.solve((a * (weight * p * (1 - p))[:, None]).T @ a + penalty, a.T @ (weight * (y - p)) - penalty @ b)
        b = b + step
        if np.abs(step).max() < 1e-8:
            break
    return mean, scale, b


def plain_auc(p, y):
    up, down = p[y == 1], p[y == 0]
    return float(((up[:, None] > down).sum() + 0.5 * (up[:, None] == down).sum()) / (len(up) * len(down)))


@pytest.fixture(scope="module")
def table():
    rng = np.random.default_rng(7)
    rows = []
    for symbol, n in (("a", 400), ("b", 300)):
        x = rng.normal(size=(n, 3)) * [1, 20, 0.01] + [0, 5, 1]
        y = (rng.random(n) < 1 / (1 + np.exp(-(x[:, 0] - 0.05 * x[:, 1])))).astype(float)
        rows += [(symbol, k % 2 + 1, k, *map(float, x[k]), 7.0, float(y[k]), float(rng.random() + 0.2)) for k in range(n)]
    return rows


def frame(spark, rows):
    return spark.createDataFrame(rows, "symbol string, fold int, pos bigint, f0 double, f1 double, f2 double, f3 double, y double, weight double").repartition(6)


def test_newton_finds_the_same_coefficients(spark, table):
    names = ["f0", "f1", "f2", "f3"]
    found = models.newton(frame(spark, table), names, ["symbol", "fold"])
    assert len(found) == 4
    for (symbol, fold), (n, mean, scale, b) in found.items():
        mine = np.array([r[3:] for r in table if r[:2] == (symbol, fold)])
        want = plain_fit(mine[:, :4], mine[:, 4], mine[:, 5])
        assert n == len(mine)
        np.testing.assert_allclose(mean, want[0], rtol=1e-12)
        np.testing.assert_allclose(scale, want[1], rtol=1e-9)
        np.testing.assert_allclose(b, want[2], rtol=1e-7, atol=1e-9)


def test_scores_and_missing_features(spark, table):
    names = ["f0", "f1"]
    found = models.newton(frame(spark, table), names, ["fold"])
    rows = frame(spark, [(*table[0][:3], None, *table[0][4:]), (*table[1][:3], float("nan"), 0.5, *table[1][5:]), table[2]])
    got = {r.pos: r.z for r in models._scored(rows, names, ["fold"], found).collect()}
    for r in (table[0], table[1], table[2]):
        _, mean, scale, b = found[(r[1],)]
        x = np.array([np.nan, r[4]]) if r[2] == 0 else np.array([np.nan, 0.5]) if r[2] == 1 else np.array(r[3:5])
        assert got[r[2]] == pytest.approx(np.nan_to_num((x - mean) / scale) @ b[:2] + b[2])
    assert models._scored(rows, names, ["fold"], {}).where("z is not null").count() == 0


def test_permutations_keep_values_and_sql_says_them(spark, table):
    rows = frame(spark, table).select("symbol", "pos", "f0", "f1")
    got = models.permuted(rows, ["f0", "f1"], ["symbol"], ["symbol", "pos"], repeats=2, seed=3).toPandas()
    for _, g in got.groupby(["symbol", "feature", "repeat"]):
        assert sorted(g.value) == sorted(g.other) and (g.value != g.other).mean() > 0.9
    t = rows.toPandas()  # noqa: F841  (read by the SQL)
    want = duckdb.sql(
        """WITH l AS (SELECT symbol, pos, feature, repeat, value FROM (UNPIVOT t ON f0, f1 INTO NAME feature VALUE value), (SELECT unnest([0, 1]) AS repeat)),
        a AS (SELECT *, row_number() OVER (PARTITION BY symbol, feature, repeat ORDER BY pos) AS k, row_number() OVER (PARTITION BY symbol, feature, repeat ORDER BY md5('3|' || feature || '|' || repeat || '|' || symbol || '|' || pos), pos) AS j FROM l)
        SELECT a.symbol, a.pos, a.feature, a.repeat, a.value, b.value AS other FROM a JOIN a b ON a.symbol = b.symbol AND a.feature = b.feature AND a.repeat = b.repeat AND a.k = b.j"""
    ).df()
    key = ["symbol", "pos", "feature", "repeat"]
    a, b = (x.sort_values(key).reset_index(drop=True)[[*key, "value", "other"]] for x in (got, want))
    assert (a.value == b.value).all() and (a.other == b.other).all()


def test_importance_is_the_fall_of_the_auc(spark, table):
    """The drop of each feature from permuted copies, computed one by one."""
    rows = frame(spark, [(s, f, k, *x) for s, f, k, *x in table]).where("symbol = 'a'").withColumn("t_end", F.col("pos")).withColumn("ts", F.timestamp_seconds("pos"))
    split = models.Split(n_folds=2, min_train=200, embargo=0, least=20)
    got = {r.feature: r["drop"] for r in models.importance(rows.drop("fold", "weight"), ["f0", "f1"], split, repeats=2).collect()}
    a = models._assigned(rows.drop("fold", "weight"), ["f0", "f1"], split).where("fold = 2").toPandas()
    train, test = a[a.part == "train"], a[a.part == "test"].sort_values("pos").reset_index(drop=True)
    mean, scale, b = plain_fit(train[["f0", "f1"]].to_numpy(), train.y.to_numpy(), train.weight.to_numpy())
    score = lambda x: plain_auc(((x - mean) / scale) @ b[:2] + b[2], test.y.to_numpy())
    x = test[["f0", "f1"]].to_numpy()
    frame_ = spark.createDataFrame(test[["symbol", "fold", "pos", "f0", "f1"]])
    mixed = models.permuted(frame_, ["f0", "f1"], ["fold"], ["symbol", "pos"], 2).toPandas().sort_values("pos")
    for k, name in enumerate(("f0", "f1")):
        aucs = []
        for repeat in (0, 1):
            other = x.copy()
            other[:, k] = mixed[(mixed.feature == name) & (mixed.repeat == repeat)].other
            aucs.append(score(other))
        assert got[name] == pytest.approx(score(x) - np.mean(aucs), abs=1e-12)
    assert got["f0"] > 0.05


def test_scores_agree_with_the_ranks(spark, table):
    p = frame(spark, table).withColumn("p", F.col("f0"))
    got = {r.symbol: r.auc for r in audit.auc(p, "p", "y", ["symbol"]).collect()}
    for s in "ab":
        mine = np.array([(r[3], r[7]) for r in table if r[0] == s])
        assert got[s] == pytest.approx(plain_auc(mine[:, 0], mine[:, 1]))
