"""Benchmark decontamination with one Aho-Corasick automaton over normalised benchmark items.

Texts are normalised to lower-case words (runs of ASCII letters, digits and all non-ASCII
characters) joined by single spaces.  What is looked for are windows of ``window`` consecutive item words (the
whole item if it has fewer).  Each window has a whole piece of ``window // 2`` words that begins at a multiple of
that in its item, so these pieces, which don't overlap, are the patterns, about as long together as the items.  A text
is scanned once; where a piece occurs, the words before and after are compared with the item's, and a run of equal words that is
long enough consists of hits.  Runs are mapped back to words and to code points of the original text.

The items of a benchmark are broadcast.  That is bounded by ``block_chars``: only a benchmark of more text is
split into blocks, scanned one after the other.

Cases: null and empty texts have no words; an item without words has no window; a null item id counts as the empty
text; equal windows of several items count for each of them; very long texts are scanned whole, in memory that
grows with them; repeated rows get equal results; an empty table or benchmark gives no hits.  Other columns of the documents are kept by ``mark`` and ``clean``; one that is called like a
column that ``mark`` adds (``bm_...``) is replaced by it.  Other columns of the benchmark are not read.
"""

from __future__ import annotations

import hashlib
import re

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import few_at_a_time, small_batches, text_of, written

WINDOW = 10
#: Most characters of items in one automaton (about 100 bytes of a worker's memory each).
BLOCK_CHARS = 4_000_000
#: A word of an original text, capitals included.
WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words(text: str | None) -> list[bytes]:
    """Lower-case words, as UTF-8; only ASCII capitals change."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_BYTES).split()


class Machine:
    """The automaton over the items' pieces; its values are the places (item, word) where a piece begins."""

    def __init__(self, items: list[tuple[str | None, str | None]], window: int = WINDOW):
        step = max(1, window // 2)
        self.window, self.names, self.items = window, [], []
        places: dict[str, list[tuple[int, int]]] = {}
        for name, text in items:
            w = words(text)
            if not w:
                continue
            for at in range(0, max(1, len(w) - step + 1), step):
                piece = w[at : at + step]
                places.setdefault(f" {b' '.join(piece).decode('utf-8', 'surrogatepass')} ", []).append((len(self.items), at))
            self.names.append(name or "")
            self.items.append(w)
        self.automaton = ahocorasick.Automaton()
        for piece, where in places.items():
            self.automaton.add_word(piece, (piece.count(" ") - 1, where))
        if places:
            self.automaton.make_automaton()

    def scan(self, text: str | None) -> tuple[int, list[tuple[int, int, str]]]:
        """The number of words, and the runs (first word, word after the last, item) that consist of hits."""
        w = words(text)
        if not self.items or not w:
            return len(w), []
        plain = f" {b' '.join(w).decode('utf-8', 'surrogatepass')} "
        found = list(self.automaton.iter(plain))
        if not found:
            return len(w), []
        spaces = np.flatnonzero(np.frombuffer(plain.encode("utf-32-le", "surrogatepass"), np.uint32) == 32)
        after = np.searchsorted(spaces, [e for e, _ in found])
        out, done = [], {}  # done: where the last run of an item ended, by item and what its words are ahead
        for end, (_, (n, where)) in zip(after.tolist(), found, strict=True):
            for item, at in where:
                of, ahead = self.items[item], end - n - at
                if done.get((item, ahead), 0) >= end:
                    continue
                a, b = end - n, end
                while a > max(0, ahead) and w[a - 1] == of[a - 1 - ahead]:
                    a -= 1
                most = min(len(w), len(of) + ahead)
                while b < most and w[b] == of[b - ahead]:
                    b += 1
                done[item, ahead] = b
                if b - a >= min(self.window, len(of)):
                    out.append((a, b, self.names[item]))
        return len(w), out


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Sorted runs that cover the same places."""
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def in_text(text: str, runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Code points of runs of words in the original text."""
    if not runs:
        return []
    places = [m.span() for m in WORD.finditer(text)]
    return [(places[a][0], places[b - 1][1]) for a, b in runs]


_PAIR = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
_PAIR_SQL = "array<struct<start:bigint,end:bigint>>"
_ADDED = ("bm_n_words", "bm_runs", "bm_items", "bm_places")
_ADDED_SQL = f"bm_n_words bigint, bm_runs {_PAIR_SQL}, bm_items array<string>, bm_places {_PAIR_SQL}"


def _blocks(benchmark: DataFrame, block_chars: int) -> list[DataFrame]:
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), text_of(benchmark).alias("text"))
    size = items.agg(F.sum(F.char_length("text"))).first()[0] or 0
    n = -(-size // block_chars) or 1
    return [items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k) if n > 1 else items for k in range(n)]


_built: dict[str, Machine] = {}


def mark(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """Add the number of words, the hit runs of words, the items hit and the runs' places in the text to each row.

    No shuffle; the texts pass a worker once for each block of the benchmark (one, unless it is large).
    """
    small_batches(docs.sparkSession)
    names = [c for c in docs.columns if c not in _ADDED]
    out = docs.select(*names)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in out.schema)
    at = names.index("text")
    blocks = _blocks(benchmark, block_chars)
    for k, block in enumerate(blocks):
        rows = [(r["item_id"], r["text"]) for r in block.collect()]
        sent = docs.sparkSession.sparkContext.broadcast(rows)
        key = hashlib.sha256(repr((rows, window)).encode("utf-8", "surrogatepass")).hexdigest()

        def run(batches, sent=sent, key=key, more=k > 0):
            if key not in _built:
                _built.clear()
                _built[key] = Machine(sent.value, window)
            machine = _built[key]
            pairs = lambda spans: [{"start": x, "end": y} for x, y in spans]
            for b in few_at_a_time(batches, at):
                counts, runs, items, places = [], [], [], []
                for i, text in enumerate(b.column(at).to_pylist()):
                    n, hits = machine.scan(text)
                    spans, owners = [(x, y) for x, y, _ in hits], {item for *_, item in hits}
                    if more:
                        spans += [(p["start"], p["end"]) for p in b.column(len(names) + 1)[i].as_py()]
                        owners |= set(b.column(len(names) + 2)[i].as_py())
                    counts.append(n)
                    runs.append(pairs(merged(spans)))
                    items.append(sorted(owners))
                    places.append(pairs(in_text(text, merged(spans))))
                yield pa.RecordBatch.from_arrays([*b.columns[: len(names)], pa.array(counts, pa.int64()), pa.array(runs, _PAIR), pa.array(items, pa.list_(pa.string())), pa.array(places, _PAIR)], names=[*names, *_ADDED])

        out = out.mapInArrow(run, f"{fields}, {_ADDED_SQL}")
        if k + 1 < len(blocks):
            out = written(out, "benchmark")
    return out


def report(marked: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """One row for each document: words, hit words, items and their digest, and the hits' places in the text (code points)."""
    hit = F.aggregate("bm_runs", F.lit(0).cast("long"), lambda n, r: n + r["end"] - r["start"])
    return marked.select(
        id_column,
        F.col("bm_n_words").alias("n_words"),
        hit.alias("n_hit"),
        F.size("bm_items").cast("long").alias("n_items"),
        F.sha2(F.array_join("bm_items", ","), 256).alias("items_sha256"),
        (F.size("bm_runs") > 0).alias("contaminated"),
        F.array_join(F.transform("bm_places", lambda p: F.concat_ws(":", p["start"], p["end"])), ",").alias("places"),
    )


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents without any hit, with their own columns."""
    clash = {c: f"own_{c}" for c in docs.columns if c in _ADDED}
    marked = mark(docs.withColumnsRenamed(clash), benchmark).where(F.size("bm_runs") == 0)
    return marked.select(*[F.col(clash.get(c, c)).alias(c) for c in docs.columns])
