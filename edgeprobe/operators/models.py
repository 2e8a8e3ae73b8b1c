"""Walk-forward models.

``logistic``: regression by Newton steps for all folds (of all symbols) at once; a step is one aggregation of gradients and Hessians over the rows,
wherever they are, and the driver holds a few numbers for each model.  Rows with a missing feature or label are not learnt
from; missing features are scored as 0 (the mean).  ``hgb`` (boosted trees) and every fit over a panel are trained by
Spark's own library, distributed over rows, a fold after the other.  Trees learn at each split on which side missing values belong; a line over
a panel takes a missing rank as 0.5, with a flag beside it.

Folds over several symbols are cut by time, and each label's weight is its uniqueness.
"""

import functools
import hashlib
import json

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..errors import ConfigError, InsufficientDataError
from ..sources.shared import materialised, removed, shared_dir
from . import audit
from .validation import Split, assign, assign_each, by_time, fold_bounds, uniqueness

#: Models whose numbers are broadcast; more are joined by a shuffle.
SENT_MODELS = 20_000
DEFAULT_FEATURES = ["ret_1", "ret_6", "ret_24", "vol_24", "z_24", "z_72", "donch_24", "body", "vol_z"]


def with_label(rows: DataFrame, label) -> DataFrame:
    """Features with y, pos and t_end of their bars."""
    return label(rows.drop("lc", "r"))


def _assigned(rows: DataFrame, features: list[str], split: Split, each: bool = False) -> DataFrame:
    kept = rows.select("symbol", "ts", "pos", "t_end", "y", *features)
    kept = kept.join(uniqueness(kept.where("y is not null")), ["symbol", "pos"], "left").na.fill(1.0, ["weight"])
    if each:
        last = kept.groupBy("symbol").agg(F.max("pos")).collect()  # one number for each symbol, as below
        return assign_each(kept, {symbol: fold_bounds(n + 1, split) for symbol, n in last})
    n, symbols = kept.agg(F.count_distinct("ts"), F.count_distinct("symbol")).first()  # two numbers: fold bounds are literals of the plan
    if symbols > 1:
        return assign(by_time(kept), fold_bounds(n, split), "time_end", "time_pos")
    return assign(kept, fold_bounds(n, split))


def estimator(kind: str = "hgb", rounds: int = 300, depth: int = 4, step: float = 0.05, least: int = 200, l2: float = 1.0, seed: int = 0, weight: str | None = None):
    """A classifier of Spark's library over the columns ``x`` and ``y``."""
    from pyspark.ml.classification import GBTClassifier, LogisticRegression

    if kind == "hgb":
        out = GBTClassifier(featuresCol="x", labelCol="y", maxIter=rounds, maxDepth=depth, stepSize=step, minInstancesPerNode=least, maxBins=255, seed=seed)
    elif kind == "logistic":
        out = LogisticRegression(featuresCol="x", labelCol="y", regParam=l2 * 1e-4, standardization=True, maxIter=rounds)
    else:
        raise ConfigError(f"unknown model {kind!r}")
    return out.setWeightCol(weight) if weight else out


#: Stands below, or above, every value of a feature.
BEYOND = 1e30


def _assembled(rows: DataFrame, features: list[str], kind: str, fill: float = 0.0) -> DataFrame:
    """Add ``x``.

    For trees every feature comes twice, its missing values once below and once above all others: a split of the one sends them to the left, of
    the other to the right, so each split learns where they belong.  For a line it is ``fill`` where missing, and a flag that says so.
    """
    from pyspark.ml.feature import VectorAssembler

    value = lambda f: F.when(~F.isnan(F.col(f).cast("double")), F.col(f).cast("double"))
    if kind == "hgb":
        columns = {f"_{c}{k}": F.coalesce(value(f), F.lit(x)) for k, f in enumerate(features) for c, x in (("l", -BEYOND), ("h", BEYOND))}
    else:
        columns = {f"_x{k}": F.coalesce(value(f), F.lit(fill)) for k, f in enumerate(features)} | {f"_m{k}": value(f).isNull().cast("double") for k, f in enumerate(features)}
    return VectorAssembler(inputCols=list(columns), outputCol="x").transform(rows.withColumns(columns)).drop(*columns)


def _fitted(train: DataFrame, test: DataFrame, model) -> DataFrame:
    """The test rows with ``p``."""
    from pyspark.ml.functions import vector_to_array

    out = model.fit(train).transform(test)
    return out.withColumn("p", vector_to_array("probability")[1]).drop("x", "rawPrediction", "probability", "prediction")


def boosted_walk_forward(rows: DataFrame, features: list[str], split: Split, **params) -> DataFrame:
    """(fold, symbol, pos, y, p) of every test row, by boosted trees; at most ``n_folds`` fits, each over all executors."""
    a = _assembled(materialised(_assigned(rows, features, split), "folds"), features, "hgb")
    parts = []
    for k in range(1, split.n_folds + 1):
        mine = a.where(F.col("fold") == k)
        test = mine.where("part = 'test'").select("fold", "symbol", "pos", "y", "x")
        parts.append(_fitted(mine.where("part = 'train' and y is not null"), test, estimator("hgb", weight="weight", **params)))
    return functools.reduce(DataFrame.unionByName, parts)


def fit_predict_panel(panel: DataFrame, features: list[str], split: Split, horizon: int, kind: str = "logistic", least_train: int = 500, least_test: int = 100, **params) -> tuple[DataFrame, DataFrame]:
    """((ts, symbol, time_pos, fold, y, p), (fold, train, test, auc)): each fold of times scored by a model of earlier ones.

    ``panel``: ts, symbol, time_pos, y and ranked features.  Folds with too few rows are skipped.
    """
    panel = materialised(panel.where("y is not null").select("ts", "symbol", "time_pos", F.col("y").cast("double").alias("y"), *features), "panel")
    last = panel.agg(F.max("time_pos")).first()[0]
    bounds = fold_bounds((last or 0) + 1, split, horizon) if last is not None else []
    part = lambda lo, hi: (F.col("time_pos") >= lo) & (F.col("time_pos") < hi)
    sizes = panel.agg(*[F.count_if(part(lo, hi)).alias(f"{name}{k}") for k, a, b, c, d in bounds for name, lo, hi in (("train", a, b), ("test", c, d))]).first() if bounds else None
    ready, parts = _assembled(panel, features, kind, 0.5), []
    for k, a, b, c, d in bounds:
        if sizes[f"train{k}"] >= least_train and sizes[f"test{k}"] >= least_test:
            parts.append(_fitted(ready.where(part(a, b)), ready.where(part(c, d)), estimator(kind, **params)).select("ts", "symbol", "time_pos", F.lit(k).alias("fold"), "y", "p"))
    if not parts:
        raise InsufficientDataError("no fold has enough rows")
    p = materialised(functools.reduce(DataFrame.unionByName, parts), "predictions")
    listed = panel.sparkSession.createDataFrame([(k, sizes[f"train{k}"], sizes[f"test{k}"]) for k, *_ in bounds], "fold int, train bigint, test bigint")
    return p, listed.join(audit.auc(p, "p", "y", ["fold"]).drop("n"), "fold")


def remembered(spark, key: dict, compute) -> DataFrame:
    """Predictions kept in the shared folder under what they depend on, computed only once.

    ``key`` says all of that: settings, and the :func:`fingerprint` of the rows that are learnt from, so that other data are other predictions.
    """
    name = hashlib.sha256(json.dumps(key, sort_keys=True, default=str).encode()).hexdigest()[:16]
    path = f"{shared_dir(spark)}/edgeprobe/predictions-{name}"
    try:
        return spark.read.parquet(path)
    except AnalysisException:  # not there yet
        compute().write.mode("overwrite").parquet(path)
        return spark.read.parquet(path)


def _models(spark, by: list[str], kinds: list[str], rows: list[tuple], columns: list[str]) -> DataFrame:
    """A row of numbers for each fold (of each symbol): a few numbers each, broadcast while there are not very many."""
    out = spark.createDataFrame(rows, ", ".join([*(f"`{c}` {k}" for c, k in zip(by, kinds, strict=True)), *(f"`{c}` double" for c in columns)]))
    return F.broadcast(out) if len(rows) <= SENT_MODELS else out


def _held(x) -> Column:
    return F.least(F.greatest(x, F.lit(-30.0)), F.lit(30.0))


def _chance(z) -> Column:
    return 1 / (1 + F.exp(-_held(z)))


def newton(train: DataFrame, features: list[str], by: list[str], l2: float = 1.0, rounds: int = 25, tolerance: float = 1e-8) -> dict[tuple, tuple]:
    """{key: (rows, means, scales, coefficients with the intercept last)} of L2-penalised logistic regressions, all at once.

    ``train``: the columns of ``by``, complete features, y and weight.  A round is one aggregation over all folds: each task adds up, for each key,
    the gradient and the upper half of the Hessian of its rows, and the driver solves one small system for each key.  It ends when no
    coefficient of any model moves, or after ``rounds``.
    """
    import numpy as np

    spark, d = train.sparkSession, len(features)
    kinds = [train.schema[c].dataType.simpleString() for c in by]
    moments = [f(F.col(c).cast("double")).alias(f"_{n}{k}") for k, c in enumerate(features) for n, f in (("m", F.avg), ("s", F.stddev_pop))]
    first = {tuple(r[c] for c in by): r for r in train.groupBy(*by).agg(F.count("*").alias("_rows"), *moments).collect()}
    if not first:
        return {}
    mean = {key: np.array([r[f"_m{k}"] for k in range(d)]) for key, r in first.items()}
    scale = {key: np.array([r[f"_s{k}"] or 1.0 for k in range(d)]) for key, r in first.items()}
    centred = _models(spark, by, kinds, [(*key, *map(float, mean[key]), *map(float, scale[key])) for key in first], [f"_{n}{k}" for n in "ms" for k in range(d)])
    a = train.join(centred, by).select(*by, "y", "weight", *[((F.col(c).cast("double") - F.col(f"_m{k}")) / F.col(f"_s{k}")).alias(f"_a{k}") for k, c in enumerate(features)])
    a = materialised(a.withColumn(f"_a{d}", F.lit(1.0)), "train", paths := [])
    penalty, b, moving = np.diag([l2] * d + [1e-9]), {key: np.zeros(d + 1) for key in first}, set(first)
    upper = [(i, j) for i in range(d + 1) for j in range(i, d + 1)]
    w = F.col("weight") * F.col("_p") * (1 - F.col("_p"))
    sums = [F.sum(w * F.col(f"_a{i}") * F.col(f"_a{j}")).alias(f"h{i}_{j}") for i, j in upper] + [F.sum(F.col("weight") * (F.col("y") - F.col("_p")) * F.col(f"_a{i}")).alias(f"g{i}") for i in range(d + 1)]
    for _ in range(rounds):
        if not moving:
            break
        now = _models(spark, by, kinds, [(*key, *map(float, b[key])) for key in moving], [f"_b{k}" for k in range(d + 1)])
        z = sum((F.col(f"_b{k}") * F.col(f"_a{k}") for k in range(d)), F.col(f"_b{d}"))
        for r in a.join(now, by).withColumn("_p", _chance(z)).groupBy(*by).agg(*sums).collect():
            key, h = tuple(r[c] for c in by), np.empty((d + 1, d + 1))
            for i, j in upper:
                h[i, j] = h[j, i] = r[f"h{i}_{j}"]
            step = np.linalg.solve(h + penalty, np.array([r[f"g{i}"] for i in range(d + 1)]) - penalty @ b[key])
            b[key] = b[key] + step
            if np.abs(step).max() < tolerance:
                moving.discard(key)
    removed(spark, paths)
    return {key: (first[key]["_rows"], mean[key], scale[key], b[key]) for key in first}


def _complete(features: list[str]) -> Column:
    ok = F.col("y").isNotNull() & ~F.isnan("y")
    for c in features:
        ok = ok & F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double"))
    return ok


def _scored(rows: DataFrame, features: list[str], by: list[str], found: dict[tuple, tuple]) -> DataFrame:
    """The rows with ``z`` (the logit) and ``_t0``, ... (what each feature adds to it); null without a model, a missing feature adds nothing."""
    spark, d = rows.sparkSession, len(features)
    kinds = [rows.schema[c].dataType.simpleString() for c in by]
    numbers = [(*key, *map(float, m), *map(float, s), *map(float, b)) for key, (_, m, s, b) in found.items()]
    known = _models(spark, by, kinds, numbers, [f"_{n}{k}" for n in "ms" for k in range(d)] + [f"_b{k}" for k in range(d + 1)])
    out = rows.join(known, by, "left")
    part = lambda k, x: F.when(x.isNull() | F.isnan(x), 0.0).otherwise((x - F.col(f"_m{k}")) / F.col(f"_s{k}") * F.col(f"_b{k}"))
    out = out.withColumns({f"_t{k}": part(k, F.col(c).cast("double")) for k, c in enumerate(features)})
    z = F.when(F.col(f"_b{d}").isNotNull(), sum((F.col(f"_t{k}") for k in range(d)), F.col(f"_b{d}")))
    return out.withColumn("z", z).drop(*(f"_{n}{k}" for n in "ms" for k in range(d)), *(f"_b{k}" for k in range(d + 1)))


def _trained(rows: DataFrame, features: list[str], split: Split, each: bool, l2: float = 1.0, rounds: int = 25, only: int | None = None) -> tuple[DataFrame, list[str], dict[tuple, tuple]]:
    """The rows of each fold (or of one), the columns that tell models apart, and the models."""
    by = ["symbol", "fold"] if each else ["fold"]
    a = _assigned(rows, features, split, each)
    a = materialised(a.where(F.col("fold") == only) if only is not None else a, "folds")
    train = a.where((F.col("part") == "train") & _complete(features)).select(*by, *features, "y", "weight")
    return a, by, newton(train, features, by, l2, rounds)


def walk_forward(rows: DataFrame, features: list[str], split: Split, kind: str = "logistic", l2: float = 1.0, rounds: int = 25, **params) -> DataFrame:
    """(fold, symbol, pos, y, p) of every test row; p is null where a fold has fewer than 30 complete training rows."""
    if kind == "hgb":
        return boosted_walk_forward(rows, features, split, rounds=rounds, **params)
    if kind != "logistic":
        raise ConfigError(f"unknown model {kind!r}")
    a, by, found = _trained(rows, features, split, False, l2, rounds)
    test = _scored(a.where("part = 'test'"), features, by, {key: m for key, m in found.items() if m[0] >= 30})
    return test.select("fold", "symbol", "pos", "y", _chance(F.col("z")).alias("p"))


def walk_forward_scores(rows: DataFrame, features: list[str], split: Split, each: bool = False) -> DataFrame:
    """Sizes, accuracy and AUC of each fold; with ``each``, of each symbol's own folds."""
    a, by, found = _trained(rows, features, split, each)
    test = _scored(a.where("part = 'test' and y is not null"), features, by, found).select(*by, "y", _chance(F.col("z")).alias("p"))
    right = ((F.col("p") >= 0.5).cast("int") == F.col("y").cast("int")).cast("double")
    sizes = test.groupBy(*by).agg(F.count("*").alias("test"), F.avg(right).alias("accuracy"))
    kinds = [a.schema[c].dataType.simpleString() for c in by]
    train = a.sparkSession.createDataFrame([(*key, m[0]) for key, m in found.items()], ", ".join([*(f"`{c}` {k}" for c, k in zip(by, kinds, strict=True)), "train bigint"]))
    return F.broadcast(train).join(sizes, by).join(audit.auc(test, "p", "y", by).drop("n"), by).select(*by, "train", "test", "accuracy", "auc")


def permuted(rows: DataFrame, columns: list[str], within: list[str], order: list[str], repeats: int = 1, seed: int = 0) -> DataFrame:
    """(within, order, other columns, feature, repeat, value, other): each column's values, and those of another row that a permutation gives.

    For every column and repeat the rows are numbered twice, by ``order`` and by a hash of it, and numbers are joined: the same on every run, however
    rows are dealt, and all copies in one plan.
    """
    pair = F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).alias("value")) for c in columns])).alias("x")
    rest = [c for c in rows.columns if c not in columns]
    long = rows.select(*rest, pair).select(*rest, "x.*").withColumn("repeat", F.explode(F.array(*[F.lit(k) for k in range(repeats)])))
    key = [*within, "feature", "repeat"]
    at = Window.partitionBy(*key)
    mixed = F.md5(F.concat_ws("|", F.lit(str(seed)), "feature", F.col("repeat").cast("string"), *[F.col(c).cast("string") for c in order]).cast("binary"))
    own = long.withColumn("_k", F.row_number().over(at.orderBy(*order)))
    other = long.select(*key, F.row_number().over(at.orderBy(mixed, *order)).alias("_k"), F.col("value").alias("other"))
    return own.join(other, [*key, "_k"]).drop("_k")


def importance(rows: DataFrame, features: list[str], split: Split, repeats: int = 3, seed: int = 0, each: bool = False) -> DataFrame:
    """(feature, drop): how much the last fold's AUC falls when a feature is permuted; with ``each``, of each symbol.

    A permuted copy changes only what its feature adds to the logit, so copies carry two numbers a row and are scored by one grouped AUC.
    """
    a, by, found = _trained(rows, features, split, each, only=split.n_folds)
    own = ["symbol"] if each else []
    terms = {f"_t{k}": c for k, c in enumerate(features)}
    test = _scored(a.where("part = 'test' and y is not null"), features, by, found)
    test = test.select("symbol", "fold", "pos", "y", "z", *terms).withColumnsRenamed(terms)
    within = list(dict.fromkeys([*own, "fold"]))
    copies = permuted(test, features, within, ["symbol", "pos"], repeats, seed)
    copies = copies.withColumn("p", _chance(F.col("z") - F.col("value") + F.col("other")))
    whole = audit.auc(test.withColumn("p", _chance(F.col("z"))), "p", "y", within).select(*within, F.col("auc").alias("_whole"))
    mean = audit.auc(copies, "p", "y", [*within, "feature", "repeat"]).groupBy(*within, "feature").agg(F.avg("auc").alias("_mean"))
    return mean.join(whole, within).select(*own, "feature", (F.col("_whole") - F.col("_mean")).alias("drop"))
