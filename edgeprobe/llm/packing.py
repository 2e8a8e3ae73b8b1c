"""Best-fit packing of token sequences, online with a bounded number of open bins.

Documents are tokenised, ended by one id and cut into pieces of at most ``capacity`` tokens.  The
pieces are dealt into groups of about ``group_tokens`` tokens (by a hash of id and piece, so a long
document spreads out too).  Each group is packed by itself, its pieces in the order of that hash, one pass without
looking ahead, with ``open_bins`` bins open: a piece goes to the fullest bin that still has room, found in a bitset
keyed by free space; when none has room and all bins are in use, the fullest closes.

The bound is far below a group's sequences, so it binds.  What is lost is what closed bins had left and a group's
last open bins: on the 64,866 pieces of check_s (63,477,957 tokens, at least 30,996 sequences) four groups take
31,263 sequences, against 31,258 without a bound; the longest first, which isn't online, would take 30,999.

Cases: a null or empty text is one piece, the end id alone; very long texts are tokenised whole and cut; repeated
rows are packed once each; ties in free space go to the bin that reached it last; an empty table gives an empty result.
Other columns are not read and don't come back, whatever their names.
"""

from __future__ import annotations

import json
import re
import zlib

import numpy as np
import pyarrow as pa
import tokenizers
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, few_at_a_time, small_batches, text_of

CAPACITY = 2048
OPEN_BINS = 256
GROUP_TOKENS = 16_000_000
END_ID = 0

# Characters for which the fast path below equals the tokenizer: printable ASCII, the usual white
# space, and the precomposed letters of Latin-1 and Latin Extended-A that lower to one character.
_ODD = re.compile("[^\t\n\r -~À-ÖØ-öø-įĲ-ňŊ-ŷź-ž]")
_LETTER = "a-zß-öø-ÿĀ-ž"
_PIECES = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTER}]+|[0-9]|[^\s{_LETTER}0-9]+")


class _Known(dict):
    """Ids of stretches between white space, as bytes; a new one is split into words, and those are kept too."""

    def __init__(self, model, old: dict, to_unicode: list[str]):
        super().__init__()
        self.model, self.old, self.to_unicode = model, old, to_unicode

    def __missing__(self, stretch: str) -> bytes:
        out = self.old.get(stretch)
        if out is None:
            parts = _PIECES.findall(stretch)
            if len(parts) == 1:
                w = stretch if stretch.isascii() else "".join([self.to_unicode[b] for b in stretch.encode()])
                out = np.array([t.id for t in self.model.tokenize(w)], "<u4").tobytes()
            else:
                out = b"".join([self[w] for w in parts])
        self[stretch] = out
        return out


def _byte_letters() -> list[str]:
    """The character that stands for each byte in a byte-level vocabulary: itself if it prints, else from U+0100 on."""
    prints = {*range(33, 127), *range(161, 173), *range(174, 256)}
    out, more = [], 256
    for b in range(256):
        out.append(chr(b if b in prints else more))
        more += b not in prints
    return out


# What a vocabulary's file says if it lower-cases a text, makes its white space single spaces, takes the
# words of _PIECES and encodes each by itself.
_NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]}
_SPLIT = {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True}


def splits_first(path: str) -> bool:
    """Whether a vocabulary's file says what the fast path of :class:`Encoder` relies on."""
    with open(path, encoding="utf-8") as f:
        said = json.load(f)
    steps = (said.get("pre_tokenizer") or {}).get("pretokenizers") or [{}]
    byte_level = len(steps) == 2 and (steps[1].get("type"), steps[1].get("add_prefix_space"), steps[1].get("use_regex")) == ("ByteLevel", False, False)
    special = all(t["content"].startswith("<|") for t in said.get("added_tokens") or [])
    return said.get("normalizer") == _NORMALIZER and steps[0] == _SPLIT and byte_level and special


class Encoder:
    """Token ids as little-endian uint32 bytes, with a bounded memory of what came before.

    A vocabulary of which :func:`splits_first` is true splits a text at white space and further into words before anything
    else and encodes each word by itself, so the ids of a stretch between white space can be kept and joined.  Texts with
    characters outside a plain set, or with "<|", which may begin a special token, go to the tokenizer whole, and so does every
    text if the vocabulary is another.
    """

    def __init__(self, path: str, remembered: int = 140_000):
        self.tokenizer = tokenizers.Tokenizer.from_file(path)
        self.fast = splits_first(path)
        self.remembered = remembered
        self.letters = _byte_letters()
        self.known = _Known(self.tokenizer.model, {}, self.letters)

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def ids(self, text: str) -> bytes:
        if not self.fast or "<|" in text or _ODD.search(text):
            return self.whole(text)
        out = b"".join(map(self.known.__getitem__, text.lower().split()))
        if len(self.known) > self.remembered:
            known = dict(self.known)
            self.known = _Known(self.tokenizer.model, known, self.letters)
        return out


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """This worker's encoder."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, id_column: str = "doc_id", with_ids: bool = False) -> DataFrame:
    """One row for each piece: id, piece, start, length, ids_crc32 and, if asked for, the ids."""
    small_batches(docs.sparkSession)
    df = docs.select(F.col(id_column), text_of(docs).alias("text"))
    kind = df.schema[id_column].dataType.simpleString()
    end = np.array([END_ID], "<u4").tobytes()

    def run(batches):
        enc = encoder(path)
        for part in few_at_a_time(batches, 1):
            index, number, start, length, crc, ids = [], [], [], [], [], []
            for i, text in enumerate(part.column(1).to_pylist()):
                raw = memoryview(enc.ids(text) + end)
                for k, at in enumerate(range(0, len(raw), 4 * capacity)):
                    own = raw[at : at + 4 * capacity]
                    index.append(i)
                    number.append(k)
                    start.append(at // 4)
                    length.append(len(own) // 4)
                    crc.append(zlib.crc32(own))
                    if with_ids:
                        ids.append(np.frombuffer(own, "<u4").astype(np.int32))
            cols = [part.column(0).take(pa.array(index, pa.int64())), pa.array(number, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))]
            names = [id_column, "piece", "start", "length", "ids_crc32"]
            if with_ids:
                cols.append(pa.array(ids, pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(cols, names=names)

    more = ", ids array<int>" if with_ids else ""
    return df.mapInArrow(run, f"`{id_column}` {kind}, piece int, start bigint, length bigint, ids_crc32 bigint{more}")


class BestFit:
    """Bins of one capacity, at most ``open_bins`` open.

    ``place`` gives (bin, offset).  ``bits`` has bit f set while an open bin has f tokens free.
    """

    def __init__(self, capacity: int = CAPACITY, open_bins: int = OPEN_BINS):
        self.capacity, self.open_bins = capacity, open_bins
        self.by_free: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.bits = 0
        self.open = 0
        self.made = 0

    def _take(self, free: int) -> int:
        stack = self.by_free[free]
        out = stack.pop()
        if not stack:
            self.bits &= ~(1 << free)
        return out

    def place(self, length: int) -> tuple[int, int]:
        fits = self.bits >> length
        if fits:
            free = length + (fits & -fits).bit_length() - 1
            which = self._take(free)
        else:
            if self.open == self.open_bins:
                self._take((self.bits & -self.bits).bit_length() - 1)
                self.open -= 1
            which, free = self.made, self.capacity
            self.made += 1
            self.open += 1
        left = free - length
        if left:
            self.by_free[left].append(which)
            self.bits |= 1 << left
        else:
            self.open -= 1
        return which, self.capacity - free


def pack(found: DataFrame, capacity: int = CAPACITY, open_bins: int = OPEN_BINS, group_tokens: int = GROUP_TOKENS, id_column: str = "doc_id") -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to the rows of :func:`pieces`.

    ``found`` is read twice, so cut it off first.  Full pieces are sequences by themselves.
    """
    names = found.columns
    tokens = found.agg(F.sum("length")).first()[0] or 0
    groups = max(1, -(-tokens // group_tokens))
    order = F.xxhash64(id_column, "piece", "ids_crc32")
    dealt = found.withColumn("_order", order).repartition(groups, "_order").sortWithinPartitions("_order", id_column, "piece", "ids_crc32")
    dealt = dealt.withColumn("_group", F.spark_partition_id()).drop("_order")
    length_at = names.index("length")

    def run(batches):
        bins = BestFit(capacity, open_bins)
        for b in batches:
            where, offset = [], []
            for n in b.column(length_at).to_pylist():
                w, o = bins.place(n)
                where.append(w)
                offset.append(o)
            base = np.left_shift(b.column(len(names)).to_numpy().astype(np.int64), 40)
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(base + np.array(where, np.int64)), pa.array(offset, pa.int64())], names=[*names, "sequence_id", "offset"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in found.schema)
    return dealt.mapInArrow(run, f"{fields}, sequence_id bigint, offset bigint")


def pack_documents(docs: DataFrame, path: str, capacity: int = CAPACITY, id_column: str = "doc_id") -> DataFrame:
    """Tokenise and pack.  The pieces, a few numbers each, are cut off between the two."""
    return pack(cut(pieces(docs, path, capacity, id_column)), capacity, id_column=id_column)
