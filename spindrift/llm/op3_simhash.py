"""SimHash near-dedup by a byte-position inverted index with count filtering.

Two 64-bit fingerprints at most 4 bits apart agree in at least 8 - 4 = 4 of their
8 positional bytes.  Posting lists of single (position, byte) pairs would have
1/256 of all fingerprints each, so the index keys are triples of positions with
their byte values: 20 triples (a Turan system) are enough for any 4 agreeing
positions to contain one.  Inside a posting list the operator tallies agreeing
positional bytes of each pair, retains pairs that reach the guaranteed 4 and
verifies their Hamming distance.

Copies collapse to one fingerprint before indexing.  A posting list longer than
``block`` is cut into blocks by hash and each pair of blocks is a group of its
own, so no list has to fit one task.  A group emits a star forest, not its pairs:
its links stay reachable, which is all that components need.

For near copies of a lower similarity, whose short fingerprints differ in more bits
than an index can guarantee matches for, ``near_components`` takes fingerprints of
512 bits over sets of five-word shingles, the same index with keys of two of 64
positional bytes, the same tally, and a verification of what the bits leave open on
the shingle sets.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spindrift.llm.common import materialize, table
from spindrift.llm.graph import connected_components
from spindrift.llm.simhash_kernels import NEAREST, SMALL, bucket_forest, fingerprint, large_bucket_links, shingle_set, small_bucket_links, spanning, verified_links, wide_fingerprint


#: Parts in which a component's members meet its smallest id.
SALTS = 16


def index_triples() -> list[tuple[int, int, int]]:
    """20 triples of byte positions such that any 4 of the 8 positions contain one.

    Positions fall in groups of 3, 3 and 2; taken are triples within a group and
    those of two from one group and one from the next in a cycle.
    """
    group = lambda p: min(p // 3, 2)
    took = []
    for t in combinations(range(8), 3):
        n = [sum(group(p) == g for p in t) for g in range(3)]
        if 3 in n or any(n[g] == 2 and n[(g + 1) % 3] == 1 for g in range(3)):
            took.append(t)
    return took


def _byte(print_col: Column, position: int) -> Column:
    return F.shiftrightunsigned(print_col, 8 * position).bitwiseAND(F.lit(255).cast("long"))


def fingerprints(docs: DataFrame, k: int = 4, seed: int = 42, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp long) of every row; a null text counts as empty (fingerprint 0)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = np.array([fingerprint(t.as_py(), k, seed) for t in batch.column(1)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints, pa.int64())], names=["doc_id", "fp"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id long, fp long")


def _streamed_forest(at_least: int, max_bits: int):
    """mapInArrow function over rows sorted by (key, lo, hi): links of each group, groups may span batches."""

    def solve(group: np.ndarray, prints: np.ndarray, side: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
        a, b = [], []
        cut = np.flatnonzero(np.diff(group)) + 1
        starts, ends = np.concatenate(([0], cut)), np.concatenate((cut, [len(group)]))
        size = ends - starts
        two = starts[size == 2]
        if len(two):
            x, y = prints[two], prints[two + 1]
            equal = (x ^ y).view(np.uint8).reshape(-1, 8) == 0
            near = (equal.sum(axis=1) >= at_least) & (np.bitwise_count(x ^ y) <= max_bits)
            a.append(np.maximum(x, y)[near])
            b.append(np.minimum(x, y)[near])
        for s, e in zip(starts[size > 2].tolist(), ends[size > 2].tolist(), strict=True):
            x, y = bucket_forest(prints[s:e], side[s:e], at_least, max_bits)
            a.append(x)
            b.append(y)
        return a, b

    def out(a: list[np.ndarray], b: list[np.ndarray]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(v).view(np.int64) if v else [], pa.int64()) for v in (a, b)], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        seen, last = 0, None
        for batch in batches:
            if not batch.num_rows:
                continue
            key, lo, hi, fp, block = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(5))
            new = np.ones(len(key), bool)
            new[1:] = (key[1:] != key[:-1]) | (lo[1:] != lo[:-1]) | (hi[1:] != hi[:-1])
            new[0] = last != (key[0], lo[0], hi[0])
            last = (key[-1], lo[-1], hi[-1])
            group = seen + np.cumsum(new)
            seen = int(group[-1])
            held.append((group, fp.view(np.uint64), (block != lo).astype(np.uint8)))
            if new.any():
                g, f, s = (np.concatenate(c) for c in zip(*held, strict=True))
                done = int(np.searchsorted(g, seen))
                held = [(g[done:], f[done:], s[done:])]
                if done:
                    yield out(*solve(g[:done], f[:done], s[:done]))
        if held:
            yield out(*solve(*(np.concatenate(c) for c in zip(*held, strict=True))))

    return run


def fingerprint_links(prints: DataFrame, max_bits: int = 4, block: int = 8192) -> DataFrame:
    """Spanning links (a, b) of distinct fingerprints ``fp`` at most ``max_bits`` (up to 4) bits apart."""
    if not 0 <= max_bits <= 4:
        raise ValueError("the index guarantees matches for max_bits from 0 to 4")
    fp = F.col("fp")
    keys = []
    for slot, triple in enumerate(index_triples()):
        key = F.lit(slot).cast("long")
        for position in triple:
            key = F.shiftleft(key, 8).bitwiseOR(_byte(fp, position))
        keys.append(key)
    postings = prints.select("fp", F.explode(F.array(*keys)).alias("key"))
    # written, so that the join is one of plain exchanges and adaptive execution can split a long list before it is cut
    lengths, _ = materialize(postings.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "simhash-lengths")
    blocks = F.ceil(F.col("n") / F.lit(float(block))).cast("int")
    cut = postings.join(lengths, "key").select("key", "fp", blocks.alias("nb")).select("key", "fp", "nb", F.pmod(F.xxhash64("fp"), F.col("nb").cast("long")).cast("int").alias("block"))
    other = F.explode(F.sequence(F.lit(0), F.col("nb") - 1))
    dealt = cut.select("key", "fp", "block", other.alias("other")).select("key", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), "fp", "block")
    grouped = dealt.repartition("key", "lo", "hi").sortWithinPartitions("key", "lo", "hi")
    return grouped.mapInArrow(_streamed_forest(8 - max_bits, max_bits), "a long, b long")


def simhash_components(docs: DataFrame, k: int = 4, seed: int = 42, max_bits: int = 4, block: int = 8192) -> DataFrame:
    """(doc_id, fp, component_id) of every row of ``docs`` (doc_id, text).

    component_id is the smallest doc_id reachable over links of at most
    ``max_bits`` differing bits, the row's own included.  Null or word-less texts
    have fingerprint 0 and link like any other; repeated rows are kept and share
    a component; a null doc_id never becomes a component id unless its component
    has no other; an empty table gives no rows.  Other columns are ignored.
    """
    marked, _ = materialize(fingerprints(docs, k, seed), "simhash-fp")
    # bounded buffers come from groupBy: a hot fingerprint is combined before the shuffle
    distinct, _ = materialize(marked.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "simhash-distinct")
    roots, _ = connected_components(fingerprint_links(distinct, max_bits, block))
    linked = distinct.join(roots.withColumnRenamed("node", "fp"), "fp").select("fp", "first_id", "root", F.pmod(F.xxhash64("fp"), F.lit(SALTS)).alias("salt"))
    # a component may hold a large share of all fingerprints: its smallest id meets them in salted parts
    smallest = linked.groupBy("root").agg(F.min("first_id").alias("component_id"))
    spread = smallest.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    joined = linked.join(spread, ["root", "salt"]).select("fp", "component_id", F.lit(True).alias("linked"))
    found = distinct.join(joined, "fp", "left")
    # written, so that both sides of the last join are plain exchanges, which adaptive execution splits for hot fingerprints
    classes, _ = materialize(found.select("fp", F.when(F.col("linked"), F.col("component_id")).otherwise(F.col("first_id")).alias("component_id")), "simhash-classes")
    return marked.join(classes, "fp").select("doc_id", "fp", "component_id")


#: Of the wide search: 64-bit lanes, tables of index keys and positional bytes of a key.
LANES, TABLES, KEY_BYTES = 8, 48, 2
#: Tables of the first pass, which joins most of a large group, so that the others need not name its links again.
FIRST = 6
#: Agreeing positional bytes, of 64, that a candidate pair needs; at similarity 0.8 seventeen are expected.
TALLY = 6
#: Fingerprints of a block of a list whose open pairs are all verified; bounds the sets that a task holds.
REST_BLOCK = 512


def bit_limits(similarity: float, lanes: int = LANES) -> tuple[int, int]:
    """Differing bits of wide fingerprints up to which sets are surely, and may be, of ``similarity`` or more.

    Sets of Jaccard similarity J have an angle of acos(2 J / (1 + J)), of which each bit
    differs with a probability of angle / pi; the limits lie three standard deviations
    below and two and a half above what ``similarity`` itself makes.
    """
    share = math.acos(2 * similarity / (1 + similarity)) / math.pi
    middle, deviation = 64 * lanes * share, math.sqrt(64 * lanes * share * (1 - share))
    return max(0, int(middle - 3 * deviation)), int(middle + 2.5 * deviation)


def _wide_keys() -> list[list[int]]:
    """Distinct byte positions of each table's key."""
    rng = np.random.default_rng(7)
    return [sorted(rng.choice(8 * LANES, KEY_BYTES, replace=False).tolist()) for _ in range(TABLES)]


def _wide_postings(tables: range):
    at = np.array([_wide_keys()[t] for t in tables])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 1024):
                part = batch.slice(k, 1024)
                prints = np.frombuffer(b"".join(part.column(2).to_pylist()), np.uint8).reshape(-1, 8 * LANES)
                key = np.broadcast_to(np.array(tables, np.int64), (len(prints), len(at))).copy()
                for j in range(at.shape[1]):
                    key = key << 8 | prints[:, at[:, j]]
                take = pa.array(np.repeat(np.arange(len(prints)), len(at)))
                yield pa.RecordBatch.from_arrays([pa.array(key.ravel()), *(c.take(take) for c in part.columns)], names=["key", "node", "root", "fp"])

    return run


def _wide_links(sure_bits: int, max_bits: int, most: int = NEAREST, small: int = SMALL):
    """mapInArrow function over rows sorted by (key, lo, hi): links (a, b, sure) of each group, groups may span batches.

    A row (key, NULL, NULL) says that a bucket of over ``small`` may hold uncertain links beyond each row's nearest ``most``.
    """

    def solved(group: np.ndarray, key: np.ndarray, node: np.ndarray, root: np.ndarray, fp: np.ndarray, side: np.ndarray) -> pa.RecordBatch:
        starts = np.flatnonzero(np.diff(group, prepend=group[0] - 1))
        sizes = np.diff(np.append(starts, len(group)))
        found, unfinished = [], set()
        little = np.flatnonzero(np.repeat((sizes > 1) & (sizes <= small), sizes))
        if len(little):
            dense = np.cumsum(np.diff(group[little], prepend=group[little[0]]) > 0)
            x, y, bits = small_bucket_links(dense, fp[little], side[little], TALLY, max_bits)
            found.append((little[x], little[y], bits))
        large = sizes > max(small, 1)
        for s, n in zip(starts[large].tolist(), sizes[large].tolist(), strict=True):
            x, y, bits = large_bucket_links(fp[s : s + n], side[s : s + n], TALLY, sure_bits, max_bits, most, root[s : s + n])
            found.append((s + x, s + y, bits))
            if np.bincount(x[bits > sure_bits], minlength=1).max() >= most:
                unfinished.add(int(key[s]))
        x, y, bits = (np.concatenate(c) for c in zip(*found, (np.zeros(0, np.int64),) * 3, strict=True))
        new = root[x] != root[y]
        x, y, sure = x[new], y[new], bits[new] <= sure_bits
        a, b, sure = (pa.array(c) for c in spanning(node[x], node[y], root[x], root[y], sure))
        marks, nothing = pa.array(sorted(unfinished), pa.int64()), pa.nulls(len(unfinished))
        return pa.RecordBatch.from_arrays([pa.concat_arrays([a, marks]), pa.concat_arrays([b, nothing.cast(b.type)]), pa.concat_arrays([sure, nothing.cast(sure.type)])], names=["a", "b", "sure"])

    return _by_group(solved)


def _settled_links(sure_bits: int, max_bits: int, similarity: float):
    """mapInArrow function over rows sorted by (key, lo, hi) with their sets: links (a, b) of each group that join different roots."""

    def solved(group: np.ndarray, key: np.ndarray, node: np.ndarray, root: np.ndarray, fp: np.ndarray, side: np.ndarray, sets: np.ndarray) -> pa.RecordBatch:
        starts = np.flatnonzero(np.diff(group, prepend=group[0] - 1))
        found = [(np.zeros(0, np.int64),) * 2]
        for s, e in zip(starts.tolist(), [*starts[1:].tolist(), len(group)], strict=True):
            x, y = verified_links(fp[s:e], side[s:e], root[s:e], list(sets[s:e]), TALLY, sure_bits, max_bits, similarity)
            found.append((node[s + x], node[s + y]))
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*found, strict=True)], names=["a", "b"])

    return _by_group(solved)


def _by_group(solved: Callable[..., pa.RecordBatch]):
    """mapInArrow function that hands whole groups of rows sorted by (key, lo, hi) to ``solved``; groups may span batches."""

    def sets_of(batch: pa.RecordBatch) -> np.ndarray:
        lists = batch.column("held")
        n = lists.value_lengths()
        values, ends, out = lists.flatten().to_numpy(), np.cumsum(n.fill_null(0).to_numpy()), np.empty(len(lists), object)
        for i, (e, m) in enumerate(zip(ends.tolist(), n.to_pylist(), strict=True)):
            out[i] = None if m is None else values[e - m : e]
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        seen, last = 0, None
        for batch in batches:
            if not batch.num_rows:
                continue
            key, lo, hi, node, root, block = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("key", "lo", "hi", "node", "root", "block"))
            fp = np.frombuffer(b"".join(batch.column("fp").to_pylist()), np.uint64).reshape(-1, LANES)
            new = np.ones(len(key), bool)
            new[1:] = (key[1:] != key[:-1]) | (lo[1:] != lo[:-1]) | (hi[1:] != hi[:-1])
            new[0] = last != (key[0], lo[0], hi[0])
            last = (key[-1], lo[-1], hi[-1])
            group = seen + np.cumsum(new)
            seen = int(group[-1])
            extra = (sets_of(batch),) if "held" in batch.schema.names else ()
            held.append((group, key, node, root, fp, (block != lo).astype(np.uint8), *extra))
            if new.any():
                columns = [np.concatenate(c) for c in zip(*held, strict=True)]
                done = int(np.searchsorted(columns[0], seen))
                held = [tuple(c[done:] for c in columns)]
                if done:
                    yield solved(*(c[:done] for c in columns))
        if held:
            yield solved(*(np.concatenate(c) for c in zip(*held, strict=True)))

    return run


KINDS = "key long, node long, root long, fp binary"


def _dealt(postings: DataFrame, lists: DataFrame, block: int) -> DataFrame:
    """``postings`` sorted by (key, lo, hi), a group for each pair of blocks of a list; ``lists`` are their lengths (key, n)."""
    # only lists that are cut: at most one for each ``block`` postings
    long, _ = materialize(lists.where(F.col("n") > block).select(F.col("key").alias("long_key"), F.ceil(F.col("n") / F.lit(float(block))).cast("int").alias("parts")), "near-long")
    nb = F.coalesce("parts", F.lit(1))
    kept = [c for c in postings.columns if c != "key"]
    cut = postings.join(long, F.col("key") == F.col("long_key"), "left").select("key", *kept, nb.alias("nb"), F.pmod(F.xxhash64("node"), nb.cast("long")).cast("int").alias("block"))
    dealt = cut.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("nb") - 1))).select("key", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), "block", *kept)
    return dealt.repartition("key", "lo", "hi").sortWithinPartitions("key", "lo", "hi")


def _pass(nodes: DataFrame, tables: range, similarity: float, block: int, most: int = NEAREST, small: int = SMALL) -> DataFrame:
    """Links (a, b, sure) over some tables of the index between ``nodes`` (node, root, fp) of different roots, and marks (key, NULL, NULL) of unfinished lists."""
    postings = nodes.mapInArrow(_wide_postings(tables), KINDS)
    lists = nodes.mapInArrow(_wide_postings(tables), KINDS).groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    found = _dealt(postings, lists, block).mapInArrow(_wide_links(*bit_limits(similarity), most, small), "a long, b long, sure boolean")
    return found.groupBy("a", "b").agg(F.max("sure").alias("sure"))


def _settled(nodes: DataFrame, keys: DataFrame, rows: DataFrame, classes: DataFrame, k: int, similarity: float, block: int) -> DataFrame:
    """Links (a, b) of the lists ``keys`` (key) between ``nodes`` of different roots: all open pairs are verified where they meet, only links leave."""
    postings, _ = materialize(nodes.mapInArrow(_wide_postings(range(TABLES)), KINDS).join(keys, "key", "left_semi"), "near-rest")
    # lists of one component by now have nothing left
    lists, _ = materialize(postings.groupBy("key").agg(F.count(F.lit(1)).alias("n"), (F.min("root") < F.max("root")).alias("apart")).where("apart").select("key", "n"), "near-rest-lists")
    held = postings.join(lists, "key", "left_semi")
    sets = _shingle_sets(held.select("node").distinct(), rows, classes.where("first_id IS NOT NULL"), k)
    return _dealt(held.join(sets, "node", "left"), lists, block).mapInArrow(_settled_links(*bit_limits(similarity), similarity), "a long, b long").distinct()


def _rooted(nodes: DataFrame, roots: DataFrame) -> DataFrame:
    """``nodes`` (node, root, fp) with the roots of a written table of components (node, root), their own where it has none."""
    placed = nodes.drop("root").join(roots, "node", "left").select("node", F.coalesce("root", "node").alias("root"), "fp")
    return materialize(placed, "near-rooted")[0]


def _shingle_sets(involved: DataFrame, rows: DataFrame, classes: DataFrame, k: int) -> DataFrame:
    """(node, held): sets of word ``k``-shingles of the nodes ``involved`` (node), as hashes in a written table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                sets = [np.unique(shingle_set(t.as_py(), k).astype(np.uint32)).view(np.int32) for t in part.column(1)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sets, pa.list_(pa.int32()))], names=["node", "held"])

    named = classes.join(involved, "node").select("node", F.col("first_id").alias("doc_id"), "text_hash")
    texts = rows.withColumn("text_hash", F.xxhash64("text")).join(named, ["doc_id", "text_hash"]).select("node", "text")
    return materialize(texts.mapInArrow(run, "node long, held array<int>").dropDuplicates(["node"]), "near-sets")[0]


def _verified(uncertain: DataFrame, rows: DataFrame, classes: DataFrame, k: int, similarity: float) -> DataFrame:
    """The pairs (a, b) of ``uncertain``, a written table, whose shingle sets are of ``similarity`` or more."""
    sets = _shingle_sets(uncertain.select(F.explode(F.array("a", "b")).alias("node")).distinct(), rows, classes, k)
    one = uncertain.join(sets.select(F.col("node").alias("a"), F.col("held").alias("x")), "a")
    both = one.join(sets.select(F.col("node").alias("b"), F.col("held").alias("y")), "b")
    shared = F.size(F.array_intersect("x", "y"))
    return both.where(shared >= similarity * (F.size("x") + F.size("y") - shared)).select("a", "b")


def near_components(docs: DataFrame, k: int = 5, similarity: float = 0.8, block: int = 8192, nearest: int = NEAREST, small: int = SMALL) -> DataFrame:
    """(doc_id, fp binary, component_id) of every row of ``docs`` (doc_id, text): near copies by wide fingerprints.

    Links are pairs whose sets of word ``k``-shingles have a Jaccard similarity of
    ``similarity`` or more.  The index takes keys of positional bytes: a pair at 0.8
    shares one of the 48 with a probability of 0.97.  Pairs whose fingerprints leave it
    open are verified on the sets themselves.  In lists of over ``small`` fingerprints a
    row first names its ``nearest`` open pairs; once these are verified, lists where a row
    may have more are searched again for all links between different components.  Rows without
    doc_id are linked by their fingerprints alone; other odd rows as in
    ``simhash_components``.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([wide_fingerprint(t.as_py(), k, LANES) for t in batch.column(1)], pa.binary()), batch.column(2)], names=["doc_id", "fp", "text_hash"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    marked, _ = materialize(rows.withColumn("text_hash", F.xxhash64("text")).mapInArrow(run, "doc_id long, fp binary, text_hash long"), "near-fp")
    # classes of equal fingerprints are numbered in a written table, so the numbers stay
    least = F.min(F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "text_hash")).alias("l")
    classes, _ = materialize(marked.groupBy("fp").agg(least).select("fp", F.col("l.doc_id").alias("first_id"), F.col("l.text_hash").alias("text_hash"), F.monotonically_increasing_id().alias("node")), "near-classes")
    nodes = classes.select("node", F.col("node").alias("root"), "fp")
    first, _ = materialize(_pass(nodes, range(FIRST), similarity, block, nearest, small), "near-links")
    joined_up, _ = connected_components(first.where("sure").select("a", "b"))
    second, _ = materialize(_pass(_rooted(nodes, joined_up), range(FIRST, TABLES), similarity, block, nearest, small), "near-links")
    links = first.unionByName(second)
    nameless = classes.where("first_id IS NULL").select("node")
    open_pairs, _ = materialize(links.where("NOT sure").select("a", "b").distinct(), "near-open")
    # a pair with a nameless end cannot be looked up; its fingerprints decide
    unnamed = open_pairs.join(nameless, F.col("a") == F.col("node"), "left_semi").unionByName(open_pairs.join(nameless, F.col("b") == F.col("node"), "left_semi"))
    verified = _verified(open_pairs, rows, classes, k, similarity)
    roots, _ = connected_components(links.where("sure").select("a", "b").unionByName(verified).unionByName(unnamed))
    unfinished, _ = materialize(links.where("b IS NULL").select(F.col("a").alias("key")).distinct(), "near-unfinished")
    if not unfinished.isEmpty():
        rest = _settled(_rooted(nodes, roots), unfinished, rows, classes, k, similarity, min(block, REST_BLOCK))
        roots, _ = connected_components(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(rest))
    linked = classes.join(roots, "node").select("fp", "first_id", "root", F.pmod("node", F.lit(SALTS)).alias("salt"))
    smallest = linked.groupBy("root").agg(F.min("first_id").alias("component_id"))
    spread = smallest.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    joined = linked.join(spread, ["root", "salt"]).select("fp", "component_id", F.lit(True).alias("linked"))
    held = classes.join(joined, "fp", "left")
    named, _ = materialize(held.select("fp", F.when(F.col("linked"), F.col("component_id")).otherwise(F.col("first_id")).alias("component_id")), "near-components")
    return marked.join(named, "fp").select("doc_id", "fp", "component_id")


def keep_one_of_each(docs: DataFrame, components: Callable[..., DataFrame] = simhash_components, **options) -> DataFrame:
    """``docs`` with one document of each near-duplicate component: that of the smallest doc_id.

    ``components`` is ``simhash_components`` or ``near_components``.  Columns are those of ``docs``; of rows that share this doc_id one stays.  A row
    with a null doc_id stays only if its component has no other id.
    """
    found = components(docs, **options)
    keep = found.where("doc_id <=> component_id").select(F.struct("doc_id").alias("kept_id")).distinct()
    # the key is a struct, which equals another with a null id; one exchange of the documents serves both steps.
    # packed, so that no column of docs can clash with one of the join
    packed = docs.select(F.struct(F.col("doc_id").cast("long").alias("doc_id")).alias("key"), F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("doc"))
    held = packed.join(keep, packed["key"] == keep["kept_id"], "left_semi")
    return held.dropDuplicates(["key"]).select("doc.*")


def op3_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash_components(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
