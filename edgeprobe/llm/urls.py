"""URL filter: rules first, then naive Bayes over the words of host and path.

A host such as ``cheappillsonline.example`` is split into words by a unigram Viterbi search: of all ways to
split a run of letters the most probable one.  Its last label, the suffix, stays whole.  Word frequencies come from the text of all pages (entities decoded; names of hosts
and addresses in it aren't words, or every host that is named somewhere would be a word of its own), from the paths of all URLs, and
from hosts: a part of a label counts once for each host that has it, less one unless hyphens part it somewhere, so ``example``
and ``free`` (of ``free-bets``) are words, and a name that only its own host has isn't.  A piece that no word is costs as one rarer than any, by the lengths
that words have and by the letter; pieces of under ``LEAST`` letters aren't parted off.
Multinomial naive Bayes then scores the words of the host and of the path.  Its labels are the verdicts of the
rules on the URLs that they fit, so nothing but rules and pages is needed.

Every word and token counts, however rare, and no model is collected: URLs are written once in chunks; a chunk asks for the
counts of the pieces that its own runs of letters have, then for those of its tokens, each once, and the answers come by
shuffles.  Words and tokens are told by 64-bit hashes.

Other columns of the pages are not read and don't come back, whatever their names.

Cases: a null URL or one without "://" has an empty host and path, fits no rule and gets the verdict of
the classes' shares; without any URL that fits a rule every verdict of the method is allow, as are ties; very long URLs and
pages are read whole, a long run of letters in time that grows with its length and the number of lengths that words have, its pieces being sent on as they are
made; repeated rows get
equal results; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import re
import string
import uuid
from collections import Counter
from collections.abc import Iterable
from dataclasses import dataclass
from html import unescape

import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bucketed, by_chunk, cut, discard, few_at_a_time, freed, shared_path, small_batches, written

#: Fixed values: (verdict, host and the start of the path).
RULES = (
    ("block", "com/en/"),
    ("allow", "example.com/en/7"),
    ("allow", "net/de/"),
    ("block", "example.net/de/8"),
    ("block", "org/es/"),
)
#: Pages and bytes of URLs of a chunk, at least a page each.
CHUNK_PAGES, CHUNK_BYTES = 5_000, 1 << 19
#: Letters of a word inside a longer run, at least.
LEAST = 3
_PIECE, _TOKEN = 0, 1
_URL = re.compile(r"://([^/?#]*)([^?#]*)")
_LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)
_WORD = re.compile(r"[^\W\d_]+")
_SPLIT = re.compile(r"[^\W\d_]+|\d+")
# What has a dot or a colon between letters or digits, or an "@", is a name of a host, an address or a file.
_NAME = re.compile(r"(?<!\S)\S*(?:[^\W_][.:@/]+[^\W_]|://)\S*")
_TAGS = re.compile(r"<script\b.*?</script\s*>|<style\b.*?</style\s*>|<!--.*?-->|<[^<>]*>", re.S | re.I)


def parts(url: str | None) -> tuple[str, str]:
    """Host (ASCII capitals lowered) and path."""
    m = _URL.search(url or "")
    return (m[1].translate(_LOWER), m[2]) if m else ("", "")


@dataclass(frozen=True)
class Rules:
    """Rules by host, found by walking a host's parent domains: cost by labels, not by rules."""

    by_host: dict[str, list[tuple[str, str, str]]]

    @classmethod
    def of(cls, rules) -> Rules:
        out: dict[str, list[tuple[str, str, str]]] = {}
        for verdict, rule in rules:
            host, slash, path = rule.partition("/")
            out.setdefault(host.translate(_LOWER), []).append((slash + path, rule, verdict))
        return cls(out)

    def find(self, host: str, path: str) -> tuple[str, str] | None:
        """(rule, verdict) of the longest rule that fits."""
        best, rest = None, host
        while rest:
            for start, rule, verdict in self.by_host.get(rest, ()):
                if path.startswith(start) and (best is None or len(rule) > len(best[0])):
                    best = (rule, verdict)
            rest = rest.partition(".")[2]
        return best


class Splitter:
    """Unigram Viterbi over word log-probabilities.

    A piece that is no word costs as a word rarer than any seen, times the chance of its length (geometric, with the mean length of the
    different words) and of just these letters.
    """

    def __init__(self, words: dict[str, int], total: int, mean: float = 8.0):
        total, mean = max(total, 1), max(mean, 1.1)
        self.cost = {w: math.log(total / c) for w, c in words.items()}
        self.lengths = sorted({len(w) for w in words if len(w) >= LEAST})
        self.unknown = math.log(total) + 1.0 + math.log(mean)
        self.letter = math.log(26) + math.log(mean / (mean - 1))
        self.seen: dict[str, tuple[str, ...]] = {}

    def split(self, run: str) -> tuple[str, ...]:
        found = self.seen.get(run)
        if found is None:
            if len(self.seen) > 50_000:
                self.seen.clear()
            found = self.seen[run] = self._search(run)
        return found

    def _search(self, run: str) -> tuple[str, ...]:
        if len(run) < LEAST:
            return (run,) if run else ()
        # For each place the least cost up to it and where the last piece begins, and the same if that piece is unknown.
        cost, back, open_cost, open_back = [0.0], [0], [math.inf], [0]
        get, unknown, letter = self.cost.get, self.unknown, self.letter
        for end in range(1, len(run) + 1):
            fresh, longer = cost[-1] + unknown, open_cost[-1]
            at, best = (end - 1, fresh + letter) if fresh <= longer else (open_back[-1], longer + letter)
            open_cost.append(best)
            open_back.append(at)
            for n in self.lengths:
                if n > end:
                    break
                start = end - n
                c = get(run[start:end])
                if c is not None and cost[start] + c <= best:
                    best, at = cost[start] + c, start
            cost.append(best)
            back.append(at)
        out, end = [], len(run)
        while end:
            out.append(run[back[end] : end])
            end = back[end]
        return tuple(reversed(out))


def _apart(host: str) -> tuple[str, str]:
    """A host's name and its suffix (the last label)."""
    name, _, suffix = host.rpartition(".")
    return name, suffix


def tokens(host: str, path: str, splitter: Splitter) -> list[str]:
    """Words of host and path, marked by where they are; numbers by their length."""
    out, (name, suffix) = [], _apart(host)
    for place, s in (("h", name), ("p", path.lower())):
        for run in _SPLIT.findall(s):
            out += [f"{place}:#{len(run)}"] if run[0].isdigit() else [f"{place}:{w}" for w in splitter.split(run.lower())]
    out += [f"h:{suffix}"] if suffix else []
    labels = host.rsplit(".", 2)
    return [*out, f"t:{labels[-1]}", f"d:{'.'.join(labels[-2:])}"]


def _count_words(batches):
    seen: Counter = Counter()
    for b in few_at_a_time(batches, 0):
        for page in b.column(0).to_pylist():
            seen.update(_WORD.findall(_NAME.sub(" ", unescape(_TAGS.sub(" ", page or "")).lower())))
            if len(seen) > 200_000:
                yield _counted(seen)
                seen.clear()
    if seen:
        yield _counted(seen)


def _counted(seen: Counter) -> pa.RecordBatch:
    columns = [pa.array([_hash(w) for w in seen], pa.int64()), pa.array([len(w) for w in seen], pa.int32()), pa.array(list(seen.values()), pa.int64())]
    return pa.RecordBatch.from_arrays(columns, names=["h", "n", "c"])


def _url_words(batches):
    """From URLs: (h, n, c, host) of the words of paths, and of the parts of hosts with the host's hash, where c is 1 for parts between hyphens."""
    for b in few_at_a_time(batches, 0):
        paths: Counter = Counter()
        hosts: set[tuple[str, str, bool]] = set()
        for url in b.column(0).to_pylist():
            host, path = parts(url)
            paths.update(x for x in _SPLIT.findall(path.lower()) if not x[0].isdigit())
            hosts.update((x, host, "-" in label) for label in _apart(host)[0].split(".") for x in _SPLIT.findall(label) if not x[0].isdigit())
        rows = [(_hash(w), len(w), c, None) for w, c in paths.items()] + [(_hash(w), len(w), int(parted), _hash(host)) for w, host, parted in hosts]
        kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names=["h", "n", "c", "host"])


def word_counts(pages: DataFrame) -> DataFrame:
    """(h, n, c): the hash, the length and the weight of each word of pages, paths and hosts."""
    text = pages.select("html").mapInArrow(_count_words, "h bigint, n int, c bigint")
    urls = pages.select("url").mapInArrow(_url_words, "h bigint, n int, c bigint, host bigint")
    paths = urls.where("host is null").select("h", "n", "c")
    named = urls.where("host is not null").groupBy("h", "n", "host").agg(F.max("c").alias("parted"))
    shared = named.groupBy("h", "n").agg((F.count("*") - 1 + F.max("parted")).alias("c"))
    return text.unionByName(paths).unionByName(shared).groupBy("h").agg(F.first("n").alias("n"), F.sum("c").alias("c")).where("c > 0")


def _hash(word: str) -> int:
    return xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass")) - 2**63


def _chunks(batches):
    """From (page_id, url): chunks of pages."""
    task, made, held, rows, size = TaskContext.get().partitionId(), 0, [], 0, 0

    def chunk():
        ids, urls = (pa.concat_arrays([b.column(k) for b in held]) for k in (0, 1))
        ends = pa.array([0, rows], pa.int32())
        return pa.RecordBatch.from_arrays([pa.array([(task << 33) + made], pa.int64()), pa.ListArray.from_arrays(ends, ids), pa.ListArray.from_arrays(ends, urls)], names=["chunk", "ids", "urls"])

    for b in few_at_a_time(batches, 1):
        held.append(b)
        rows, size = rows + b.num_rows, size + b.column(1).nbytes
        if rows >= CHUNK_PAGES or size >= CHUNK_BYTES:
            yield chunk()
            made, held, rows, size = made + 1, [], 0, 0
    if held:
        yield chunk()


def _runs(urls: Iterable[str | None]) -> set[str]:
    """The runs of letters that ``tokens`` has split."""
    out: set[str] = set()
    for host, path in map(parts, urls):
        out.update(x.lower() for s in (_apart(host)[0], path.lower()) for x in _SPLIT.findall(s) if not x[0].isdigit())
    return out


def _pieces(run: str, lengths: list[int]):
    """What may be a word inside a run; a run of fewer letters stays whole without being asked for."""
    for n in lengths:
        if n > len(run):
            return
        if n < LEAST:
            continue
        for at in range(len(run) - n + 1):
            yield run[at : at + n]


def _ask_pieces(batches, lengths: list[int]):
    for b in batches:
        for chunk, urls in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            asked: set[int] = set()
            for run in _runs(urls):
                for x in _pieces(run, lengths):
                    asked.add(_hash(x))
                    if len(asked) >= 100_000:
                        yield _asked(chunk, asked)
                        asked.clear()
            if asked:
                yield _asked(chunk, asked)


def _asked(chunk: int, hashes: set[int]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([chunk] * len(hashes), pa.int64()), pa.array(list(hashes), pa.int64())], names=["chunk", "h"])


def _told(answers: pa.Table, kind: int) -> dict[int, tuple[int, int]]:
    rows = zip(*(answers[x].to_pylist() for x in ("kind", "h", "a", "b")), strict=True)
    return {h: (a, b) for k, h, a, b in rows if k == kind}


def _splitter(urls: list[str | None], answers: pa.Table, kinds: dict[int, int], total: int) -> Splitter:
    """One that knows those words that a chunk's runs have as pieces."""
    found, words = _told(answers, _PIECE), {}
    for run in _runs(urls) if found else ():
        for x in _pieces(run, sorted(kinds)):
            if (c := found.get(_hash(x))) is not None:
                words[x] = c[0]
    return Splitter(words, total, sum(n * c for n, c in kinds.items()) / max(1, sum(kinds.values())))


def _count_tokens(rules: Rules, kinds: dict[int, int], total: int):
    def run(chunk: pa.Table, answers: pa.Table) -> pa.Table:
        """Each token of a chunk with its counts in URLs that a rule allows and blocks; the empty one counts URLs."""
        urls = chunk["urls"][0].as_py()
        splitter = _splitter(urls, answers, kinds, total)
        seen: dict[str, list[int]] = {}
        for url in urls:
            host, path = parts(url)
            found = rules.find(host, path)
            for t in ("", *tokens(host, path, splitter)):
                c = seen.setdefault(t, [0, 0])
                if found is not None:
                    c[found[1] == "block"] += 1
        columns = [[chunk["chunk"][0].as_py()] * len(seen), [_hash(t) for t in seen], [c[0] for c in seen.values()], [c[1] for c in seen.values()]]
        return pa.table([pa.array(x, pa.int64()) for x in columns], names=["chunk", "h", "a", "b"])

    return run


@dataclass(frozen=True)
class Bayes:
    """Multinomial naive Bayes from what all tokens together have: URLs and occurrences of each class, and how many tokens are known."""

    urls: tuple[int, int]
    occurrences: tuple[int, int]
    known: int
    smooth: float = 1.0

    def odds(self, allowed: int, blocked: int) -> float:
        """Log-odds of block of a token with these counts."""
        total = [n + self.smooth * (self.known + 1) for n in self.occurrences]
        return math.log((blocked + self.smooth) / total[1]) - math.log((allowed + self.smooth) / total[0])

    def block(self, found: list[str], odds: dict[int, float]) -> bool:
        if not sum(self.urls):
            return False
        unknown = self.odds(0, 0)
        base = math.log((self.urls[1] + self.smooth) / (self.urls[0] + self.smooth))
        return base + sum(odds.get(_hash(t), unknown) for t in found) > 0


def _judge(rules: Rules, model: Bayes, kinds: dict[int, int], total: int):
    def run(chunk: pa.Table, answers: pa.Table) -> pa.Table:
        urls = chunk["urls"][0].as_py()
        splitter = _splitter(urls, answers, kinds, total)
        odds = {h: model.odds(*c) for h, c in _told(answers, _TOKEN).items()}
        rows = []
        for url in urls:
            host, path = parts(url)
            found = rules.find(host, path)
            words = tokens(host, path, splitter)
            rule, verdict = found or (None, "block" if model.block(words, odds) else "allow")
            rows.append((host, path, rule, verdict, " ".join(w[2:] for w in words if w[0] == "h")))
        return pa.table([chunk["ids"][0].values, *(pa.array([r[k] for r in rows], pa.string()) for k in range(5))], names=["page_id", "host", "path", "rule", "verdict", "words"])

    return run


def judge(pages: DataFrame, rules=RULES) -> DataFrame:
    """One row for each page: page_id, host, path, rule, verdict, words (of the host)."""
    spark, ready = small_batches(pages.sparkSession), Rules.of(rules)
    kind, buckets = pages.schema["page_id"].dataType.simpleString(), int(spark.conf.get("spark.sql.shuffle.partitions"))
    names = [f"edgeprobe_{x}_{uuid.uuid4().hex}" for x in ("urls", "answers")]
    paths = [shared_path(spark, x) for x in ("urls", "answers")]
    counts = cut(word_counts(pages))
    total = counts.agg(F.sum("c")).first()[0] or 0
    kinds = {r["n"]: r["count"] for r in counts.groupBy("n").count().collect()}  # a number for each length of a word
    lengths = sorted(kinds)
    try:
        chunks = bucketed(pages.select("page_id", "url").mapInArrow(_chunks, f"chunk bigint, ids array<{kind}>, urls array<string>"), names[0], paths[0], buckets)
        asked = chunks.select("chunk", "urls").mapInArrow(lambda batches: _ask_pieces(batches, lengths), "chunk bigint, h bigint")
        answer = lambda df, of, a, b: df.select("chunk", F.lit(of).alias("kind"), "h", a.alias("a"), b.alias("b")).repartition(buckets, "chunk")
        answers = bucketed(answer(asked.join(counts, "h"), _PIECE, F.col("c"), F.lit(0).cast("long")), names[1], paths[1], buckets)
        uses = cut(by_chunk(chunks, answers, _count_tokens(ready, kinds, total), "chunk bigint, h bigint, a bigint, b bigint"))
        seen = cut(uses.groupBy("h").agg(F.sum("a").alias("a"), F.sum("b").alias("b")).where("a + b > 0"))
        first = F.col("h") == _hash("")
        sums = seen.agg(*(F.sum(F.when(c, F.col(x))) for c in (first, ~first) for x in ("a", "b")), F.count(F.when(~first, 1))).first()
        model = Bayes(*((sums[k] or 0, sums[k + 1] or 0) for k in (0, 2)), sums[4])
        told = uses.select("chunk", "h").join(seen, "h")
        answers = bucketed(answer(told, _TOKEN, F.col("a"), F.col("b")), names[1], paths[1], buckets)
        schema = f"page_id {kind}, host string, path string, rule string, verdict string, words string"
        return written(by_chunk(chunks, answers, _judge(ready, model, kinds, total), schema), "verdicts")
    finally:
        for name in names:
            spark.sql(f"DROP TABLE IF EXISTS {name}")
        discard(spark, paths)
        asked = told = uses = seen = None
        freed(spark)
