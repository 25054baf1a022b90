"""Substring dedup by hashing of lines and the sentences in them.

Units are the sentences of each line (a line without inner sentence ends is one
unit), normalised to lower-case words; a long sentence is cut further after words
that their own hash chooses, so that the cuts of equal passages agree.  A unit of
few words is looked up with those after it that make up enough, and so is each
whole text.  Digests are grouped globally; the earliest occurrence by doc_id and
position is kept.  Runs of later occurrences are removed where they have at least
``min_words`` words, so that a short phrase which happens to recur is left alone;
removed spans keep their offsets in the original text.

The kernels work on arrays over a text's words.  The digest of any run of words is
a difference of prefix sums of a polynomial in the words' hashes, so looking up
units with what follows them costs no second pass over the text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spindrift.llm.common import materialize, table, text_or_empty

#: A sentence of more words is cut after words whose own hash is a multiple of CUT.
LONG, CUT = 12, 4
#: Least words that are looked up as one.
SHORT = 4
#: Least words of a removed run: a passage of 50 words less what may be lost at its edges.
MIN_WORDS = 22
#: A longer word with a character beyond ASCII, as in scripts without spaces, counts a word for each two characters.
LONG_WORD = 24
_SPACE, _ENDER, _CLOSER, _FULL, _LINE, _WIDE = (1 << k for k in range(6))
_BASE, _SCRAMBLE = 0x9E3779B97F4A7C15, np.uint64(0xBF58476D1CE4E5B9)


def _classes() -> np.ndarray:
    """Bits of a code point's classes; those above the last entry are like it."""
    out = np.full(1 << 16, _WIDE, np.uint8)
    out[:128] = 0
    for bit, chars in ((_SPACE, [chr(c) for c in range(0x3001) if chr(c).isspace()]), (_ENDER, ".!?…"), (_CLOSER, "\"')]"), (_FULL, "。！？"), (_LINE, "\n")):
        out[[ord(c) for c in chars]] |= bit
    return out


_CLASSES = _classes()


def word_hash(word: str) -> int:
    return xxhash.xxh3_64_intdigest(word)


@lru_cache(maxsize=2)
def _powers(bits: int) -> tuple[np.ndarray, np.ndarray]:
    """First 2**bits powers of the polynomial's base and of its inverse, modulo 2**64."""
    n, inverse = 1 << bits, pow(_BASE, -1, 1 << 64)
    return tuple(np.concatenate((np.ones(1, np.uint64), np.cumprod(np.full(n - 1, b, np.uint64)))) for b in (_BASE, inverse))  # type: ignore[return-value]


@dataclass
class Units:
    """Word offsets of a text, first and last word of its units, and the last unit of each unit's key."""

    starts: np.ndarray
    stops: np.ndarray
    weights: np.ndarray
    first: np.ndarray
    last: np.ndarray
    to: np.ndarray
    digests: np.ndarray


def units(text: str) -> Units | None:
    """Units and keys of ``text``; None without a word.  The first digest is the whole text's, then one a unit."""
    # a lone surrogate cannot be hashed; it counts as a replacement character
    text = text if text.isascii() else text.encode("utf-8", "replace").decode()
    code = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    kind = np.full(len(code) + 2, _SPACE, np.uint8)
    kind[1:-1] = _CLASSES[np.minimum(code, len(_CLASSES) - 1)]
    # a word also ends after a full stop of a script without spaces
    space, part = kind & _SPACE > 0, kind & (_SPACE | _FULL) > 0
    starts = np.flatnonzero(~space[1:-1] & part[:-2])
    stops = np.flatnonzero(~space[1:-1] & (space[2:] | (kind[1:-1] & _FULL > 0))) + 1
    n = len(starts)
    if not n:
        return None
    words = text.lower().split()
    if len(words) != n:
        words = [text[a:b].lower() for a, b in zip(starts.tolist(), stops.tolist(), strict=True)]
    hashes = np.array([*map(word_hash, words)], np.uint64)
    # sentence ends: a full stop with closing marks before a blank, the end of a line
    tail = stops.copy()
    while (closing := (kind[tail] & _CLOSER > 0) & (tail > starts + 1)).any():
        tail -= closing
    blank = np.zeros(n, bool)
    blank[stops < len(code)] = np.isin(code[stops[stops < len(code)]], (9, 32))
    ends = (kind[tail] & _ENDER > 0) & blank | (kind[stops] & _FULL > 0)
    line = np.searchsorted(np.flatnonzero(kind & _LINE), starts + 1)
    ends[:-1] |= line[1:] != line[:-1]
    ends[-1] = True
    sizes = np.diff(np.flatnonzero(ends), prepend=-1)
    ends |= (np.repeat(sizes, sizes) > LONG) & (hashes % np.uint64(CUT) == 0)
    last = np.flatnonzero(ends)
    first = np.concatenate(([0], last[:-1] + 1))
    weights = np.arange(n + 1)
    if not text.isascii():
        lengths, wide = stops - starts, np.concatenate(([0], np.cumsum(kind[1:-1] & _WIDE > 0)))
        weights[1:] = np.cumsum(np.where((lengths > LONG_WORD) & (wide[stops] > wide[starts]), lengths // 2, 1))
    to = np.minimum(np.searchsorted(weights[last + 1], weights[first] + SHORT), len(last) - 1)
    power, inverse = _powers(max(12, int(n).bit_length()))
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(hashes * power[:n], dtype=np.uint64)))
    a, b = np.concatenate(([0], first)), np.concatenate(([n], last[to] + 1))
    mixed = (sums[b] - sums[a]) * inverse[a] + (b - a).astype(np.uint64)
    mixed[:1] += np.uint64(1 << 63)
    for _ in range(2):
        mixed = (mixed ^ (mixed >> np.uint64(31))) * _SCRAMBLE
    return Units(starts, stops, weights, first, last, to, mixed.view(np.int64))


def _keys(found: Units) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the keys to look up, and which of them the text has before; key 0 is the whole text, key k unit k - 1's."""
    number = np.arange(len(found.first))
    _, at, back = np.unique(found.digests[1:], return_index=True, return_inverse=True)
    own = at[back] == number
    # an occurrence that overlaps the text's first one is part of it
    again = ~own & (found.to[at[back]] < number)
    asked = np.flatnonzero(own | again)
    return np.concatenate(([0], asked + 1)), np.concatenate(([False], again[asked]))


def _looked_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            count, order, again, digests = [], [np.zeros(0, np.int64)], [np.zeros(0, bool)], [np.zeros(0, np.int64)]
            for t in part.column(2):
                found = units(t.as_py())
                if found is None:
                    count.append(0)
                    continue
                numbers, repeated = _keys(found)
                order.append(numbers)
                again.append(repeated)
                digests.append(found.digests[numbers])
                count.append(len(numbers))
            take = pa.array(np.repeat(np.arange(part.num_rows), count))
            columns = [pa.array(np.concatenate(digests)), part.column(0).take(take), part.column(1).take(take), pa.array(np.concatenate(order), pa.int32()), pa.array(np.concatenate(again))]
            yield pa.RecordBatch.from_arrays(columns, names=["digest", "doc_id", "doc_digest", "n", "again"])


def removed_spans(text: str, gone: list[int], min_words: int) -> tuple[list[dict], int]:
    """Spans of ``text`` to remove, and their words, where the keys numbered ``gone`` are repeated."""
    found = units(text)
    if found is None:
        return [], 0
    if 0 in gone:
        return [{"start": int(found.starts[0]), "end": int(found.stops[-1])}], len(found.starts)
    unit = np.asarray(gone) - 1
    edge = np.bincount(unit, minlength=len(found.first) + 1) - np.bincount(found.to[unit] + 1, minlength=len(found.first) + 1)
    edges = np.flatnonzero(np.diff(np.concatenate(([0], np.cumsum(edge) > 0)).astype(np.int8)))
    out, total = [], 0
    for a, b in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
        one, end = found.first[a], found.last[b - 1] + 1
        if found.weights[end] - found.weights[one] >= min_words:
            out.append({"start": int(found.starts[one]), "end": int(found.stops[end - 1])})
            total += int(end - one)
    return out, total


def _cut(min_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts, removed, words = [], [], []
                for text, gone in zip(part.column(1).to_pylist(), part.column(2).to_pylist(), strict=True):
                    found, n = removed_spans(text, gone, min_words) if gone else ([], 0)
                    ends = [0, *(x["end"] for x in found)]
                    starts = [*(x["start"] for x in found), len(text)]
                    texts.append("".join(text[a:b] for a, b in zip(ends, starts, strict=True)) if found else text)
                    removed.append(found)
                    words.append(n)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(texts, pa.string()), pa.array(removed, kind), pa.array(words, pa.int64())], names=["doc_id", "text", "removed", "n_removed_words"])

    return run


def later_units(docs: DataFrame) -> DataFrame:
    """(doc_id, doc_digest, gone): numbers of a document's keys that an earlier document, or the document before, has.

    Only digests with ranks travel, no texts.  A digest is combined with its least
    and greatest doc_id before the shuffle; the repeated ones are written, so that
    the look-up joins two plain exchanges, of which adaptive execution splits a
    line of a third of all documents.  ``doc_digest`` tells rows of one doc_id apart.
    """
    once = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")).select("doc_id", F.hash("text").alias("doc_digest"), "text")
    found, _ = materialize(once.mapInArrow(_looked_up, "digest long, doc_id long, doc_digest int, n int, again boolean"), "substring-units")
    fresh = found.where("NOT again").select("digest", "doc_id", "doc_digest", "n")
    one = fresh.groupBy("digest").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"), F.max(F.col("doc_id").isNull()).alias("nameless"))
    # where only rows without doc_id have a digest, all stay
    repeated, _ = materialize(one.where("first <> last OR (nameless AND first IS NOT NULL)").select(F.col("digest").alias("key"), "first"), "substring-first")
    later = fresh.join(repeated, F.col("digest") == F.col("key")).where(~F.col("doc_id").eqNullSafe(F.col("first"))).select("doc_id", "doc_digest", "n")
    both = later.unionByName(found.where("again").select("doc_id", "doc_digest", "n"))
    return both.groupBy("doc_id", "doc_digest").agg(F.collect_set("n").alias("gone"))


def dedup_substrings(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """(doc_id, text, removed, n_removed_words) of every row of ``docs`` (doc_id, text).

    ``removed`` holds the spans' offsets in the original text, in code points
    (empty: none), and ``text`` what is left.  A copy of a whole text goes whatever
    its length.  A null text counts as empty.  Rows of one doc_id rank alike: what
    only they share stays in each, and each row is returned; null ids rank last.  An
    empty table gives no rows; other columns are ignored.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    gone = later_units(docs).select(F.col("doc_id").alias("__id"), F.col("doc_digest").alias("__digest"), "gone")
    joined = rows.join(gone, rows["doc_id"].eqNullSafe(gone["__id"]) & (F.hash(rows["text"]) == gone["__digest"]), "left")
    schema = "doc_id long, text string, removed array<struct<start:int,end:int>>, n_removed_words long"
    return joined.select("doc_id", "text", "gone").mapInArrow(_cut(min_words), schema)


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_substrings(table(spark, sf_dir, "documents"))
