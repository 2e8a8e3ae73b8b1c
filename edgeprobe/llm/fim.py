"""Fill-in-middle: each document is cut in two places, chosen by its id, and its parts are put into another order.

*Units.*  A unit is a word with the white space before it; white space at the end of a text is one, too.  A text of n
units has n + 1 places to cut (its beginning and the end of every unit).

*Distinct-text index.*  Identical texts are grouped once: by their SHA-256, and verified by their content (the texts of
a group are compared as a set, and a second one is an error).  Each text comes to one task and keeps the ends of its units as one
Elias-Fano list, from which any end is selected without unpacking it.  Documents are joined to it by their digest alone, so
that texts are shuffled once for each distinct one and map task, and never by document.

*Hot texts.*  A text of more than ``HOT_ROWS`` documents has its list made before the join and is then dealt out as a copy for each
``HOT_ROWS`` of them, so that no task gets all documents of one text.  Other texts have their list made where they meet their
documents: a sort-merge join brings all rows of a digest one after another.

Cases: null and empty texts stay plain; so does any text that has one of the markers itself, which makes every output
restorable.  Very long texts are cut whole, in memory that grows with them.  Repeated rows and ids are cut alike, each row by
itself; a null id counts as the empty text.  Other columns are kept; one that is called like a new column (``fim_form``, ``fim_units``,
``fim_prefix_chars``, ``fim_middle_chars``, ``fim_output``) comes back with ``own_`` before its name.  An empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, shared_dir, small_batches, written

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Documents of one text that are cut by one task.
HOT_ROWS = 500
#: Most digests (32 bytes each) that are broadcast; more are joined by a shuffle.
SENT_DIGESTS = 200_000
NEW = ["fim_form", "fim_units", "fim_prefix_chars", "fim_middle_chars", "fim_output"]
_NEW_SQL = "fim_form string, fim_units bigint, fim_prefix_chars bigint, fim_middle_chars bigint, fim_output string"


def unit_ends(text: str) -> np.ndarray:
    """The ends of a text's units, in code points, rising."""
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    if not len(c):
        return np.empty(0, np.int64)
    space = (c == 32) | ((c >= 9) & (c <= 13))
    ends = np.flatnonzero(~space & np.append(space[1:], True)) + 1
    return np.append(ends, len(c)) if space[-1] else ends


class EliasFano:
    """A rising list of numbers up to ``most``: their low bits packed, their high bits as gaps in unary."""

    def __init__(self, n: int, most: int, low: np.ndarray, high: np.ndarray):
        self.n, self.most, self.low, self.high = n, most, low, high
        self.width = _width(n, most)
        self.before = np.cumsum(np.bitwise_count(high), dtype=np.int64)

    @classmethod
    def of(cls, numbers: np.ndarray, most: int) -> EliasFano:
        n = len(numbers)
        width = _width(n, most)
        low = np.packbits(((numbers[:, None] >> np.arange(width)) & 1).astype(np.uint8).ravel(), bitorder="little")
        bits = np.zeros((n + (most >> width) + 1) if n else 0, np.uint8)
        bits[(numbers >> width) + np.arange(n)] = 1
        return cls(n, most, low, np.packbits(bits, bitorder="little"))

    def __getitem__(self, k: int) -> int:
        """The number at place k, from 0."""
        at = int(np.searchsorted(self.before, k, "right"))
        left, byte = k - (int(self.before[at - 1]) if at else 0), int(self.high[at])
        for _ in range(left):
            byte &= byte - 1
        high = 8 * at + (byte & -byte).bit_length() - 1 - k
        first = k * self.width
        low = int.from_bytes(self.low[first // 8 : (first + self.width + 7) // 8].tobytes(), "little") >> first % 8
        return high << self.width | low & ((1 << self.width) - 1)

    def to_bytes(self) -> bytes:
        return np.array([self.n, self.most, len(self.low)], "<i8").tobytes() + self.low.tobytes() + self.high.tobytes()

    @classmethod
    def from_bytes(cls, data: bytes) -> EliasFano:
        n, most, size = (int(x) for x in np.frombuffer(data, "<i8", 3))
        rest = np.frombuffer(data, np.uint8, offset=24)
        return cls(n, most, rest[:size], rest[size:])


def _width(n: int, most: int) -> int:
    return max(0, (most // n).bit_length() - 1) if n else 0


def boundaries(text: str) -> EliasFano:
    return EliasFano.of(unit_ends(text), len(text))


def arranged(text: str, ends: EliasFano, h1: int, h2: int, psm: bool) -> tuple[int, int, str]:
    """The code points of prefix and middle, and the text in its new order."""
    first, second = sorted((h1 % (ends.n + 1), h2 % (ends.n + 1)))
    a, b = (ends[k - 1] if k else 0 for k in (first, second))
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    out = [PREFIX, prefix, SUFFIX, suffix, MIDDLE, middle] if psm else [SUFFIX, suffix, PREFIX, prefix, MIDDLE, middle]
    return a, b - a, "".join(out)


def restored(output: Column, form: Column) -> Column:
    """The original text from an output and its form."""
    parts = F.split(output, "<[PSM]>", -1)  # nothing, then the three parts in the order of the form
    of = lambda k: F.get(parts, F.lit(k))
    return F.when(form == "psm", F.concat(of(1), of(3), of(2))).when(form == "spm", F.concat(of(2), of(3), of(1))).otherwise(output)


def _lists(batches):
    """The index rows (digest, text, copies) with their Elias-Fano lists."""
    for b in batches:
        lists = [boundaries(t.as_py()).to_bytes() for t in b.column(1)]
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(lists, pa.binary())], names=["digest", "text", "copies", "ends"])


def _cuts(rate: int, spm: int):
    """From rows (own, h1 to h4, digest, text, ends) the documents with their outputs; a list that isn't given is made once for rows that follow one another."""

    def run(batches):
        digest = text = ends = None
        plain = True
        for b in batches:
            hashes = [b.column(i).to_pylist() for i in range(1, 5)]
            digests, given = b.column(5), b.column(7)
            rows = []
            for i in range(b.num_rows):
                if (d := digests[i].as_py()) != digest:
                    digest, text = d, b.column(6)[i].as_py()
                    ends = EliasFano.from_bytes(given[i].as_py()) if given[i].is_valid else boundaries(text)
                    plain = not text or any(m in text for m in (PREFIX, SUFFIX, MIDDLE))
                h1, h2, h3, h4 = (h[i] for h in hashes)
                if plain or h3 % 100 >= rate:
                    rows.append(("plain", ends.n, None, None, text))
                else:
                    psm = h4 % 100 >= spm
                    rows.append(("psm" if psm else "spm", ends.n, *arranged(text, ends, h1, h2, psm)))
            kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string()]
            new = [pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([b.column(0), *new], names=["own", *NEW])

    return run


def _digest(text: Column) -> Column:
    return F.unhex(F.sha2(text.cast("binary"), 256))


def distinct_texts(texts: DataFrame) -> DataFrame:
    """(digest, text, copies) of frames (digest, text): a row for each distinct text, verified by its content."""
    grouped = texts.groupBy("digest").agg(F.collect_set("text").alias("same"), F.count("*").alias("copies"))
    one = F.when(F.size("same") == 1, F.element_at("same", 1)).otherwise(F.raise_error(F.lit("two texts have one SHA-256")))
    return grouped.select("digest", one.cast("string").alias("text"), "copies")


def fill_in_middle(docs: DataFrame, seed: int = 42, rate: int = 50, spm: int = 80, hot_rows: int = HOT_ROWS, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The documents with ``fim_form`` (plain, psm or spm), ``fim_units``, ``fim_prefix_chars``, ``fim_middle_chars`` and ``fim_output``.

    ``rate`` of a hundred documents are cut, ``spm`` of a hundred of these put the suffix first; all choices come from the
    SHA-256 of ``seed`` and the id.
    """
    spark = small_batches(docs.sparkSession)
    shared_dir(spark)
    text = F.coalesce(F.col(text_column).cast("string"), F.lit(""))
    h = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_column).cast("string"), F.lit(""))).cast("binary"), 256)
    hashes = [F.conv(F.substring(h, 8 * k + 1, 8), 16, 10).cast("bigint").alias(f"h{k + 1}") for k in range(4)]
    rest = [c for c in docs.columns if c != text_column]
    keys = written(docs.select(F.struct(*rest).alias("own"), *hashes, _digest(text).alias("digest")), "fim-keys")
    texts = docs.select(_digest(text).alias("digest"), text.alias("text"))
    often = cut(keys.groupBy("digest").agg(F.count("*").alias("copies")).where(F.col("copies") > hot_rows).select("digest", F.ceil(F.col("copies") / hot_rows).cast("int").alias("salts")))
    few = often.count() <= SENT_DIGESTS
    hot = F.broadcast(often) if few else often

    index = distinct_texts(texts.join(hot, "digest", "left_anti")).hint("merge")
    cold = keys.join(hot, "digest", "left_anti").join(index, "digest").withColumn("ends", F.lit(None).cast("binary"))
    listed = distinct_texts(texts.join(hot, "digest", "left_semi")).mapInArrow(_lists, "digest binary, text string, copies bigint, ends binary")
    dealt = listed.join(hot, "digest").withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).drop("salts").hint("merge")
    salt = F.pmod(F.xxhash64(*(F.col(f"h{k}") for k in range(1, 5)), F.rand(seed)), F.col("salts")).cast("int").alias("salt")
    many = keys.join(hot, "digest").select(*keys.columns, salt).join(dealt, ["digest", "salt"])

    columns = ["own", "h1", "h2", "h3", "h4", "digest", "text", "ends"]
    own = keys.schema["own"].dataType.simpleString()
    found = [x.select(columns).mapInArrow(_cuts(rate, spm), f"own {own}, {_NEW_SQL}") for x in (cold, many)]
    kept = [F.col("own")[c].alias(f"own_{c}" if c in NEW else c) for c in rest]
    out = found[0].unionByName(found[1])
    return out.select(*kept, *NEW)


def digests(cuts: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """The documents' cuts with the SHA-256 of the outputs and of the texts that are restored from them."""
    back = restored(F.col("fim_output"), F.col("fim_form"))
    chars = [F.col(f"fim_{c}_chars").alias(f"{c}_chars") for c in ("prefix", "middle")]
    sums = [F.sha2(x.cast("binary"), 256).alias(name) for name, x in (("output_sha256", F.col("fim_output")), ("restored_sha256", back))]
    return cuts.select(id_column, F.col("fim_units").alias("n"), F.col("fim_form").alias("form"), *chars, *sums)
