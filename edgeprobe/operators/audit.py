"""Checks that try to catch a leak, and attribution of a book's results."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.nulls import finite, safe_div
from .lookahead import LookaheadError, lint_lookahead  # noqa: F401  (part of the audit)


#: Slices of a binade of scores; each is summed by itself.
SLICES = 1024
_TOP = 2**22


def _slice(x: Column) -> Column:
    """A number that rises with a score, shared by scores that agree in sign, exponent and the first ten binary digits.

    It needs no look at the data, and scores over many sizes are parted as well as even ones.  A logarithm that is rounded over a power of two
    changes exponent and digits so that the number stays the same.
    """
    size = F.abs(x)
    exponent = F.floor(F.log2(size))
    number = (exponent + 1100) * SLICES + F.floor(size / F.pow(F.lit(2.0), exponent) * SLICES) - SLICES + 1
    return F.when(F.isnan(x), F.lit(_TOP + 1)).when(size == float("inf"), F.when(x > 0, F.lit(_TOP)).otherwise(-_TOP)).when(x == 0, F.lit(0)).otherwise(F.signum(x) * number).cast("int")


def auc(rows: DataFrame, score: str, y: str, by: list[str]) -> DataFrame:
    """(by, n, auc): the probability that a positive scores above a negative, ties half; NULL with one class only.

    Positives and negatives are counted for each distinct score, map-side; a score's negatives below are those of
    lower slices and those below it in its own slice.  So no key's rows meet in one task,
    however few keys there are.
    """
    ok = rows.where(F.col(score).isNotNull() & F.col(y).isNotNull()).select(*by, F.col(score).cast("double").alias("_x"), F.col(y).alias("_y"))
    g = ok.groupBy(*by, "_x").agg(F.count_if(F.col("_y") == 1).alias("_up"), F.count_if(F.col("_y") == 0).alias("_down"), F.count("*").alias("_n"))
    g = g.withColumn("_slice", _slice(F.col("_x")))
    before = lambda w: F.coalesce(F.sum("_down").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    slices = g.groupBy(*by, "_slice").agg(F.sum("_down").alias("_down")).withColumn("_lower", before(Window.partitionBy(*by).orderBy("_slice"))).drop("_down")
    own = g.withColumn("_own", before(Window.partitionBy(*by, "_slice").orderBy("_x")))
    same = F.lit(True)
    for c in by:
        same = same & own[c].eqNullSafe(slices[c])
    both = own.join(slices, same & (own["_slice"] == slices["_slice"])).select(*[own[c] for c in by], own["_up"], own["_down"], own["_n"], "_own", "_lower")
    won = F.sum(F.col("_up") * (F.col("_own") + F.col("_lower") + F.col("_down") / 2.0))
    out = both.groupBy(*by).agg(F.sum("_n").alias("n"), safe_div(won, (F.sum("_up") * F.sum("_down")).cast("double")).alias("auc"))
    return out.select(*by, "n", "auc")


def single_feature_auc(rows: DataFrame, features: list[str], y: str, least: int = 100, limit: float = 0.65) -> DataFrame:
    """Each feature's own AUC, whichever way round, and whether it is too good: all features in one pass."""
    long = rows.unpivot([y], features, "feature", "value")
    g = auc(long, "value", y, ["feature"]).where(F.col("n") >= least)
    best = F.greatest("auc", 1 - F.col("auc"))
    return g.select("feature", "n", best.alias("auc"), (best > limit).alias("leak"))


def per_symbol(rows: DataFrame, p: str, y: str) -> DataFrame:
    """AUC, accuracy, base rate and lift of each symbol."""
    hit = ((F.col(p) >= 0.5).cast("int") == F.col(y).cast("int")).cast("double")
    ok = rows.where(F.col(p).isNotNull() & F.col(y).isNotNull())
    g = ok.groupBy("symbol").agg(F.avg(hit).alias("accuracy"), F.greatest(F.avg(y), 1 - F.avg(y)).alias("base_rate"))
    return auc(ok, p, y, ["symbol"]).join(g, "symbol").withColumn("lift", F.col("accuracy") - F.col("base_rate"))


def best_and_worst(per_symbol: DataFrame, measure: str = "auc", least: int = 100) -> DataFrame:
    """One row: the symbols with the highest and the lowest measure among those with ``least`` observations; ties to the first by name."""
    ok = per_symbol.where((F.col("n") >= least) & F.col(measure).isNotNull())
    return ok.agg(
        F.min_by("symbol", F.struct(-F.col(measure), "symbol")).alias("best"), F.max(measure).alias("highest"),
        F.min_by("symbol", F.struct(measure, "symbol")).alias("worst"), F.min(measure).alias("lowest"), F.count("*").alias("symbols"),
    )


def pnl(book: DataFrame) -> DataFrame:
    """What each symbol contributed."""
    return book.groupBy("symbol").agg(F.sum(F.col("w") * F.coalesce("ret_next", F.lit(0.0))).alias("pnl"))


def share_of(pnl_rows: DataFrame, dead: Column) -> DataFrame:
    """The share of some symbols in the absolute results, gains and losses not netted."""
    total, part = F.sum(F.abs("pnl")), F.sum(F.when(dead, F.abs("pnl")).otherwise(0.0))
    return pnl_rows.agg(F.when(total > 0, part / total).otherwise(0.0).alias("share"), F.count_if(dead).alias("n_dead"))


def tail_census(book: DataFrame, threshold: float) -> DataFrame:
    """Extreme gains, how many hit a short position, how many would by chance, and the worst bar of the book."""
    jump = F.expm1("ret_next") > threshold
    a = book.agg(F.count("ret_next").alias("n"), F.count_if(jump).alias("extreme"), F.count_if((F.col("w") < 0) & F.col("ret_next").isNotNull()).alias("short_bars"), F.count_if(jump & (F.col("w") < 0)).alias("hits"))
    worst = book.groupBy("time_pos").agg(F.expm1(F.sum(F.col("w") * F.coalesce("ret_next", F.lit(0.0)))).alias("r")).agg(F.min("r").alias("worst_bar"))
    return a.crossJoin(worst).withColumn("expected", safe_div(F.col("extreme") * F.col("short_bars").cast("double"), F.col("n").cast("double")))


def tail_curve(book: DataFrame, levels: list[float]) -> DataFrame:
    """For each level of loss: how often it was seen, an upper rate where it never was, the cost of one. One pass for all levels."""
    short = F.max(F.when(F.col("w") < 0, -F.col("w")).otherwise(0.0))
    aggs = [F.count_if(F.expm1("ret_next") > x).alias(f"c{k}") for k, x in enumerate(levels)]
    one = book.agg(F.count("ret_next").alias("n"), short.alias("most_short"), F.count_if((F.col("w") < 0) & F.col("ret_next").isNotNull()).alias("short_bars"), *aggs)
    each = F.explode(F.array(*[F.struct(F.lit(x).alias("level"), F.col(f"c{k}").alias("seen")) for k, x in enumerate(levels)])).alias("x")
    rows = one.select("n", "most_short", "short_bars", each).select("n", "most_short", "short_bars", "x.*")
    rate = F.when(F.col("seen") > 0, F.col("seen") / F.col("n")).otherwise(F.lit(3.0) / F.col("n"))
    loss = F.col("level") * F.col("most_short")
    return rows.select("level", "seen", (F.col("seen") > 0).alias("estimated"), (rate * F.col("short_bars")).alias("expected"), loss.alias("cost_of_one"), (loss >= 1).alias("ruinous"))


def concentration(book: DataFrame, nominal: float) -> DataFrame:
    """How often a single short weight is above its nominal size, and the longest run of such bars (gaps and islands)."""
    at = book.groupBy("time_pos").agg(F.max(F.when(F.col("w") < 0, -F.col("w")).otherwise(0.0)).alias("most"))
    w = Window.partitionBy("_over").orderBy("time_pos")
    # A row for each time, not for each symbol.
    flags = at.withColumn("_over", F.col("most") > nominal + 1e-9)
    island = flags.withColumn("_run", F.col("time_pos") - F.row_number().over(w)).where("_over").groupBy("_run").count()
    a = at.agg(F.max("most").alias("max_short"), F.count_if(F.col("most") > nominal + 1e-9).alias("bars"), F.count("*").alias("n"))
    return a.crossJoin(island.agg(F.coalesce(F.max("count"), F.lit(0)).alias("longest"))).withColumn("share", F.col("bars") / F.col("n"))


def shuffled(rows: DataFrame, y: str, within: str, seed: int = 0) -> DataFrame:
    """Labels permuted within each time, by a hash: the same on every run."""
    known = rows.where(F.col(y).isNotNull())
    at = Window.partitionBy(within)
    a = known.withColumn("_k", F.row_number().over(at.orderBy("symbol")))
    b = known.select(F.col(within), F.row_number().over(at.orderBy(F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(within).cast("string"), F.col("symbol")).cast("binary")), "symbol")).alias("_k"), F.col(y).alias("y_shuffled"))
    return a.join(b, [within, "_k"]).drop("_k")


def point_in_time(bars: DataFrame, build, columns: list[str] | None, probes: list[int] | int, tolerance: float = 1e-9) -> DataFrame:
    """(feature, probe, differs): features of the last row when history ends there, against those of the whole; all probes in one plan.

    A number of probes is spread over each symbol's own length; without ``columns``, all that ``build`` adds are compared.
    """
    w = Window.partitionBy("symbol").orderBy("ts")
    b = bars.withColumn("pos", F.row_number().over(w) - 1)
    columns = columns or [c for c in build(b).columns if c not in b.columns]
    if isinstance(probes, int):
        n = F.count("*").over(Window.partitionBy("symbol"))
        at = F.array_distinct(F.array(*[F.floor(n * (k + 1) / (probes + 1)).cast("int") for k in range(probes)]))
    else:
        at = F.array(*[F.lit(p) for p in probes])
    whole = build(b).select("symbol", "pos", *columns)
    cut = b.withColumn("_at", at).withColumn("probe", F.explode("_at")).drop("_at").where("pos <= probe")
    cut = cut.withColumn("symbol", F.concat_ws("\x1f", "symbol", F.col("probe").cast("string")))
    part = build(cut).where("pos = probe").withColumn("symbol", F.split("symbol", "\x1f")[0]).select("symbol", "pos", *[F.col(c).alias(f"p_{c}") for c in columns])
    both = whole.join(part, ["symbol", "pos"])
    off = lambda c: F.when(F.col(c).isNull() & F.col(f"p_{c}").isNull(), False).otherwise(F.coalesce(F.abs(F.col(c) - F.col(f"p_{c}")) > tolerance * F.greatest(F.abs(c), F.lit(1.0)), F.lit(True)))
    return both.agg(*[F.count_if(off(c)).alias(c) for c in columns]).unpivot([], columns, "feature", "differs")
