"""Purged walk-forward folds, positions after filtering, and label uniqueness."""

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..errors import ConfigError, InsufficientDataError


@dataclass(frozen=True)
class Split:
    n_folds: int = 6
    scheme: str = "expanding"
    min_train: int = 5000
    train_window: int = 20_000
    embargo: int = 0
    least: int = 100


def fold_bounds(n: int, split: Split, horizon: int | None = None) -> list[tuple[int, int, int, int, int]]:
    """(fold, train from, train before, test from, test before), in positions; at most ``n_folds`` of them.

    With ``horizon`` (folds over times rather than labels) the training side ends that much earlier too.
    """
    if split.scheme not in ("expanding", "rolling"):
        raise ConfigError(f"unknown split scheme {split.scheme!r}")
    if n <= split.min_train:
        raise InsufficientDataError(f"{n} rows, but min_train is {split.min_train}")
    size = (n - split.min_train) // split.n_folds
    if size < split.least:
        raise InsufficientDataError(f"folds of {size} rows are too small")
    out = []
    for k in range(split.n_folds):
        start = split.min_train + k * size
        end = start - split.embargo - (horizon or 0)
        low = max(0, (end if horizon is not None else start) - split.train_window) if split.scheme == "rolling" else 0
        out.append((k + 1, low, end, start, min(start + size, n)))
    return out


def folds(spark: SparkSession, bounds) -> DataFrame:
    return spark.createDataFrame(bounds, "fold int, train_lo bigint, train_hi bigint, test_lo bigint, test_hi bigint")


def assign(rows: DataFrame, bounds, known_at: str = "t_end", pos: str = "pos") -> DataFrame:
    """(row, fold, part): each row once for every fold in which it trains or is tested.

    A training row's label is known before the fold's training side ends.
    """
    f = F.broadcast(folds(rows.sparkSession, bounds))  # at most n_folds rows
    return _parts(rows, f, F.lit(True), known_at, pos)


def assign_each(rows: DataFrame, bounds: dict[str, list], known_at: str = "t_end", pos: str = "pos") -> DataFrame:
    """The same with the bounds of each symbol."""
    listed = [(symbol, *b) for symbol, own in bounds.items() for b in own]
    f = rows.sparkSession.createDataFrame(listed, "_symbol string, fold int, train_lo bigint, train_hi bigint, test_lo bigint, test_hi bigint")
    return _parts(rows, f, F.col("symbol").eqNullSafe(F.col("_symbol")), known_at, pos).drop("_symbol")


def _parts(rows: DataFrame, f: DataFrame, own, known_at: str, pos: str) -> DataFrame:
    test = (F.col(pos) >= F.col("test_lo")) & (F.col(pos) < F.col("test_hi"))
    train = (F.col(pos) >= F.col("train_lo")) & (F.col(pos) < F.col("test_lo")) & (F.col(known_at) < F.col("train_hi"))
    return rows.join(f, own & (test | train)).withColumn("part", F.when(test, "test").otherwise("train"))


def describe(assigned: DataFrame) -> DataFrame:
    """Sizes of each fold and how many rows were purged."""
    g = assigned.groupBy("fold", "train_lo", "test_lo").agg(F.count_if(F.col("part") == "train").alias("train"), F.count_if(F.col("part") == "test").alias("test"))
    return g.select("fold", "train", "test", (F.col("test_lo") - F.col("train_lo") - F.col("train")).alias("purged"))


def after_filter(rows: DataFrame, keep: str, t_end: str = "t_end", pos: str = "pos") -> DataFrame:
    """Kept rows with new positions; t_end becomes the first kept row at or after it, within the kept rows."""
    w = Window.partitionBy("symbol")
    before = F.sum(F.col(keep).cast("bigint")).over(w.orderBy(pos).rowsBetween(Window.unboundedPreceding, -1))
    numbered = rows.withColumn("new_pos", F.coalesce(before, F.lit(0))).withColumn("n_kept", F.sum(F.col(keep).cast("bigint")).over(w))
    at = numbered.select(F.col("symbol"), F.col(pos).alias(t_end), F.col("new_pos").alias("new_end"))
    out = numbered.where(keep).join(at, ["symbol", t_end], "left")
    end = F.greatest(F.least(F.coalesce("new_end", F.col("n_kept") - 1), F.col("n_kept") - 1), F.col("new_pos"))
    return out.withColumn("new_end", end)


def uniqueness(rows: DataFrame, t_end: str = "t_end", pos: str = "pos") -> DataFrame:
    """Add the mean of 1/concurrency over each label's span: starts and ends as a difference array, then prefix sums."""
    w = Window.partitionBy("symbol").orderBy("at")
    end = F.greatest(F.least(F.col(t_end), F.max(pos).over(Window.partitionBy("symbol"))), F.col(pos))
    spans = rows.select("symbol", F.col(pos).alias("pos"), end.alias("end"))
    steps = spans.select("symbol", F.col("pos").alias("at"), F.lit(1).alias("d"), F.lit(1).alias("row")).unionByName(
        spans.select("symbol", (F.col("end") + 1).alias("at"), F.lit(-1).alias("d"), F.lit(0).alias("row"))
    )
    # A span that ends before the symbol's next row ends there all the same, as rows are the only places counted.
    conc = steps.groupBy("symbol", "at").agg(F.sum("d").alias("d"), F.max("row").alias("row"))
    conc = conc.withColumn("c", F.greatest(F.sum("d").over(w.rowsBetween(Window.unboundedPreceding, 0)), F.lit(1))).where("row = 1")
    prefix = conc.withColumn("p", F.sum(1 / F.col("c")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    prefix = prefix.select("symbol", "at", "p", (F.col("p") - 1 / F.col("c")).alias("p_before"))
    a = prefix.select("symbol", F.col("at").alias("end"), F.col("p").alias("upto"))
    b = prefix.select("symbol", F.col("at").alias("pos"), F.col("p_before").alias("before"))
    found = spans.join(a, ["symbol", "end"]).join(b, ["symbol", "pos"])
    return found.select("symbol", "pos", ((F.col("upto") - F.col("before")) / (F.col("end") - F.col("pos") + 1)).alias("weight"))


def by_time(rows: DataFrame, t_end: str = "t_end", pos: str = "pos") -> DataFrame:
    """Add ``time_pos`` and ``time_end``: places of a bar and of its label's end among the times of all symbols.

    Symbols whose histories begin at different times have different bars at one ``pos``; folds over several symbols are
    cut by time, or a training row would be later than another symbol's test row.  Times are numbered over one row each.
    """
    times = rows.select("ts").distinct().withColumn("time_pos", F.row_number().over(Window.orderBy("ts")) - 1)
    placed = rows.join(times, "ts")
    ends = placed.select("symbol", F.col(pos).alias(t_end), F.col("time_pos").alias("time_end"))
    # A label whose last bar isn't among the rows ends, for all that is known, after every time.
    return placed.join(ends, ["symbol", t_end], "left").withColumn("time_end", F.coalesce("time_end", F.lit(2**62)))


def complete(rows: DataFrame, columns: list[str], least: int = 1000) -> DataFrame:
    """The rows in which none of the columns is missing; fewer than ``least`` are an error."""
    kept = rows.na.drop(subset=columns)
    n = kept.limit(least).count()
    if n < least:
        raise InsufficientDataError(f"{n} complete rows, but {least} are needed")
    return kept
