"""Quality by weak supervision, with DataFrame functions only.

Rules look at counts of a text and vote good (+1), bad (-1) or abstain (0).  Documents are
grouped by their vector of votes (at most 3 ** len(RULES) of them, whatever the corpus), and
expectation-maximisation over those counts estimates each rule's accuracy and the share of good
documents.  The posterior probability of "good" then decides, instead of an all-must-pass filter.

Cases: null and empty texts have no words and fail the base test; very long texts are counted whole, within their row; ties of the posterior at the
threshold are kept; repeated rows get equal results; an empty table gives an empty result; other
columns are carried along (those named like an output are replaced).
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, cut, text_of

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: A word of letters, perhaps hyphenated, with the usual marks around it.
TIDY = r"""^["'(]?\p{L}+(?:[-'’]\p{L}+)*[.,;:!?]?["')]?$"""
MORE = ("q_lines", "q_upper", "q_distinct", "q_bangs", "q_tidy")


def text_counts(df: DataFrame, column: str = "text") -> DataFrame:
    """Add the counts of :data:`COUNTS` and :data:`MORE` for each row's whole text.

    No shuffle: everything happens within the row.  Repeated three-word windows are found by
    hashing; only rows where two hashes are equal go on to sort the windows themselves, so the
    count is exact and the cost is O(n log n) in the words of a text.
    """
    base = df.drop(*COUNTS, *MORE)
    t = base.withColumn("_t", text_of(base, column))
    t = t.withColumn("_w", F.array_remove(F.split("_t", f"[{SPACE}]+"), ""))
    t = t.withColumn("_l", F.filter(F.split("_t", "\n"), lambda x: x.rlike(f"[^{SPACE}]")))
    t = t.withColumn("n_words", F.size("_w").cast("long"))
    t = t.withColumn("_n", F.greatest(F.size("_w") - 2, F.lit(0)))
    three = lambda i: (F.get("_w", i), F.get("_w", i + 1), F.get("_w", i + 2))
    t = t.withColumn("_h", F.transform(F.slice("_w", F.lit(1), F.col("_n")), lambda w, i: F.xxhash64(w, F.get("_w", i + 1), F.get("_w", i + 2))))
    t = t.withColumn("_same", F.size(F.array_distinct("_h")) < F.size("_h"))
    windows = F.transform(F.sequence(F.lit(0), F.col("_n") - 1), lambda i: F.struct(F.concat_ws(" ", *three(i)).alias("g"), i.alias("i")))
    t = t.withColumn("_s", F.when(F.col("_same"), F.array_sort(windows)))
    twice = F.filter(
        F.transform("_s", lambda x, j: F.when((F.get("_s", j - 1)["g"] == x["g"]) | (F.get("_s", j + 1)["g"] == x["g"]), x["i"])),
        lambda p: p.isNotNull(),
    )
    t = t.withColumn("_p", twice)
    covered = F.size(F.array_distinct(F.flatten(F.transform("_p", lambda p: F.array(p, p + 1, p + 2)))))
    gone = lambda pattern: F.char_length(F.regexp_replace("_t", pattern, "")).cast("long")
    return t.select(
        *[t[c] for c in base.columns],
        "n_words",
        F.char_length(F.array_join("_w", "")).cast("long").alias("word_chars"),
        gone(r"[^#*$%&|<>]+").alias("n_symbols"),
        (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"),
        F.when(F.col("_same"), covered).otherwise(0).cast("long").alias("n_repeat_words"),
        F.size("_l").cast("long").alias("q_lines"),
        gone(r"[^\p{Lu}]+").alias("q_upper"),
        F.size(F.array_distinct("_w")).cast("long").alias("q_distinct"),
        gone(r"[^!?]+").alias("q_bangs"),
        F.size(F.filter("_w", lambda w: w.rlike(TIDY))).cast("long").alias("q_tidy"),
    )


def _share(a: str, b: str) -> Column:
    return F.col(a) / F.greatest(F.col(b), F.lit(1))


@dataclass(frozen=True)
class Rule:
    """Votes bad above ``bad`` and good below ``good``, else abstains; ``None``: never votes that way.

    With ``reverse`` bad is below ``bad`` and good above ``good``.
    """

    name: str
    over: str
    under: str
    bad: float
    good: float | None = None
    reverse: bool = False

    def vote(self) -> Column:
        x = _share(self.over, self.under)
        out = F.when(x < self.bad if self.reverse else x > self.bad, -1)
        if self.good is not None:
            out = out.when(x > self.good if self.reverse else x < self.good, 1)
        return out.otherwise(0).cast("int").alias(f"v_{self.name}")


#: Most rules see one kind of junk and have nothing to say of other texts, so they only vote bad.
RULES = (
    Rule("repeat", "n_repeat_words", "n_words", 0.30),
    Rule("symbols", "n_symbols", "n_words", 0.10),
    Rule("dup_lines", "n_dup_lines", "q_lines", 0.30),
    Rule("upper", "q_upper", "word_chars", 0.30),
    Rule("distinct", "q_distinct", "n_words", 0.15, reverse=True),
    Rule("bangs", "q_bangs", "n_words", 0.20),
    Rule("tidy", "q_tidy", "n_words", 0.70, 0.85, reverse=True),
)


OUTCOMES = (-1, 0, 1)


@dataclass(frozen=True)
class VoteModel:
    """Share of good documents and, for each rule, P(-1, 0 or 1 | good) and P(-1, 0 or 1 | bad)."""

    prior: float
    good: tuple[dict[int, float], ...]
    bad: tuple[dict[int, float], ...]

    def weight(self, k: int, vote: int) -> float:
        return math.log(self.good[k][vote] / self.bad[k][vote])

    def base(self) -> float:
        return math.log(self.prior / (1 - self.prior))

    def posterior(self, votes: tuple[int, ...]) -> float:
        return 1 / (1 + math.exp(-max(-500.0, min(500.0, self.base() + sum(self.weight(k, v) for k, v in enumerate(votes))))))

    def accuracy(self, k: int) -> float:
        """How often rule ``k`` is right when it votes."""
        right = self.prior * self.good[k][1] + (1 - self.prior) * self.bad[k][-1]
        return right / (right + self.prior * self.good[k][-1] + (1 - self.prior) * self.bad[k][1])

    def column(self, rules=RULES) -> Column:
        """Posterior probability of good, from the columns of the votes."""
        total = F.lit(self.base())
        for k, r in enumerate(rules):
            v = F.col(f"v_{r.name}")
            total = total + F.when(v == 1, self.weight(k, 1)).when(v == -1, self.weight(k, -1)).otherwise(self.weight(k, 0))
        return (1 / (1 + F.exp(-total))).alias("p_good")


def fit_votes(patterns: list[tuple[tuple[int, ...], int]], both: list[bool], prior: float = 0.8, rounds: int = 200, smooth: float = 1.0) -> VoteModel:
    """Expectation-maximisation over (votes, how many documents).

    Rules are taken as independent given the class; ``both`` tells for each whether it can vote good.  At
    the start a rule votes bad for a tenth as many good documents as bad ones and, if it can, good for
    four times as many.  ``smooth`` imagined documents for each outcome keep the estimates positive; with no
    documents the starting model is returned.
    """
    n_rules = len(both)
    model = VoteModel(
        prior,
        tuple({-1: 0.03, 0: 0.17, 1: 0.8} if x else {-1: 0.03, 0: 0.96, 1: 0.01} for x in both),
        tuple({-1: 0.3, 0: 0.5, 1: 0.2} if x else {-1: 0.3, 0: 0.69, 1: 0.01} for x in both),
    )
    total = sum(n for _, n in patterns)
    for _ in range(rounds if total else 0):
        good = [dict.fromkeys(OUTCOMES, smooth) for _ in range(n_rules)]
        bad = [dict.fromkeys(OUTCOMES, smooth) for _ in range(n_rules)]
        mass = 0.0
        for v, n in patterns:
            p = model.posterior(v)
            mass += p * n
            for k in range(n_rules):
                good[k][v[k]] += p * n
                bad[k][v[k]] += (1 - p) * n
        share = lambda d: {x: y / sum(d.values()) for x, y in d.items()}
        new = VoteModel((mass + smooth) / (total + 2 * smooth), tuple(map(share, good)), tuple(map(share, bad)))
        moved = abs(new.prior - model.prior) + sum(abs(x[o] - y[o]) for x, y in zip(new.bad, model.bad, strict=True) for o in OUTCOMES)
        model = new
        if moved < 1e-9:
            break
    return model


def votes(counts: DataFrame, rules=RULES) -> DataFrame:
    """Add one column of votes for each rule."""
    return counts.withColumns({f"v_{r.name}": r.vote() for r in rules})


def learn(voted: DataFrame, rules=RULES) -> VoteModel:
    """The model of all rows' votes: one aggregation, at most 3 ** len(rules) rows to the driver."""
    names = [f"v_{r.name}" for r in rules]
    rows = voted.groupBy(*names).count().collect()
    return fit_votes(sorted((tuple(r[n] for n in names), r["count"]) for r in rows), [r.good is not None for r in rules])


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def judge(voted: DataFrame, model: VoteModel, threshold: float = 0.5, rules=RULES) -> DataFrame:
    """Add ``base_failed``, ``p_good`` and ``kept``."""
    out = voted.withColumn("base_failed", base_failed()).withColumn("p_good", model.column(rules))
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("p_good") >= threshold))


def score_quality(docs: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """One row for each document: id, counts, votes, ``base_failed``, ``p_good``, ``kept``.

    The counts are made once and cut off (a few numbers for each document), as the votes are read
    twice: to learn and to judge.
    """
    narrow = votes(text_counts(docs.select(id_column, "text")).drop("text"))
    narrow = cut(narrow)
    return judge(narrow, learn(narrow))


def keep_good(docs: DataFrame) -> DataFrame:
    """The documents that are kept, with their own columns.

    The counts are made twice, once to learn and once beside the text, rather than joining by an
    id that may be null or repeated.
    """
    own = docs.columns
    clash = {c: f"own_{c}" for c in own if c != "text"}
    renamed = docs.withColumnsRenamed(clash)
    model = learn(votes(text_counts(docs.select("text"))))
    judged = judge(votes(text_counts(renamed)), model)
    # The row's number, always at least 0, keeps the filter above the counts: pushed below them it would hold
    # every expression over the text as often as it is used.
    kept = judged.withColumn("_row", F.monotonically_increasing_id()).where(F.col("kept") & (F.col("_row") >= 0))
    return kept.select(*[F.col(clash.get(c, c)).alias(c) for c in own])
