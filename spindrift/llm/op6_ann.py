"""Approximate nearest neighbours by randomly rotated one-bit codes.

A unit vector o is rotated by a random orthogonal matrix and kept as the signs of
its coordinates, packed, with one correction scalar, the inner product of o and its
own code.  For a unit query q the estimate is <code, q> / <code, o>; its error is
below sqrt((1 - <code, o>^2) / <code, o>^2) * eps / sqrt(d - 1) with a probability
that ``eps`` sets.  A block's codes are unpacked once and meet many queries in one
matrix product.  Vectors whose upper bound reaches the k-th best exact score that
the task has seen so far, in any block, are reranked on the original vectors.

The query set meets all vectors in blocks of bounded size.  Blocks and query blocks
are written once and paired by a product of their files, so nothing is shuffled for
each pair.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from spindrift.llm.common import materialize, table

#: Rows, in multiples of k, whose exact scores set a query's first threshold; rows among which they are looked for.
PROBES, FIRST = 16, 2048
#: Queries and vectors of one matrix product; pairs whose exact scores are taken at once.
TILE, CHUNK, EXACT = 256, 4096, 4096
#: Single precision of estimates and first scores.
SLACK = 1e-5
#: Most queries of a block, most numbers of a block of vectors, blocks that a table gives at least if they hold LEAST rows.
ASKED, NUMBERS, BLOCKS, LEAST = 1 << 14, 1 << 22, 24, 8192


def rotation(d: int, seed: int) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(seed + d).normal(size=(d, d)))
    return q * np.sign(np.diag(r))


def _words(bits: np.ndarray) -> np.ndarray:
    """Bits of each row packed in 64-bit words, zero-padded."""
    n, d = bits.shape
    padded = np.zeros((n, -(-d // 64) * 64), np.uint8)
    padded[:, :d] = bits
    return np.packbits(padded, axis=1).view(np.uint64)


def encode(vectors: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(packed sign words, <code, o>) of the rows of ``vectors`` in double precision."""
    unit = vectors / np.sqrt((vectors * vectors).sum(axis=1))[:, None]
    turned = unit @ turn
    return _words((turned >= 0).astype(np.uint8)), np.abs(turned).sum(axis=1) / math.sqrt(vectors.shape[1])


def signs(codes: np.ndarray, scale: np.ndarray, d: int, eps: float) -> np.ndarray:
    """Rows of (code / <code, o>, error bound, 1) in single precision, to be multiplied with (query, 1, -threshold)."""
    out = np.empty((len(codes), d + 2), np.float32)
    bits = np.unpackbits(codes.view(np.uint8).reshape(len(codes), -1), axis=1, count=d)
    out[:, :d] = (bits * np.float32(2) - np.float32(1)) / (scale * math.sqrt(d))[:, None]
    out[:, d] = np.sqrt(np.maximum(1 - scale * scale, 0)) / scale * eps / math.sqrt(max(d - 1, 1))
    out[:, d + 1] = 1
    return out


def _first_k(row: np.ndarray, ids: np.ndarray, score: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(order, rank) of each row's best k entries, ties to smaller ids."""
    order = np.lexsort((ids, -score, row))
    row = row[order]
    fresh = np.ones(len(row), bool)
    fresh[1:] = row[1:] != row[:-1]
    rank = np.arange(len(row)) - np.maximum.accumulate(np.where(fresh, np.arange(len(row)), 0))
    return order[rank < k], rank[rank < k]


class Best:
    """The best k scores and ids of each query so far."""

    def __init__(self, n: int, k: int) -> None:
        self.score, self.ids = np.full((n, k), -np.inf), np.full((n, k), np.iinfo(np.int64).max)

    def take(self, row: np.ndarray, ids: np.ndarray, score: np.ndarray) -> None:
        k = self.score.shape[1]
        asked = np.unique(row)
        row = np.concatenate([row, np.repeat(asked, k)])
        ids, score = np.concatenate([ids, self.ids[asked].ravel()]), np.concatenate([score, self.score[asked].ravel()])
        # a vector may come twice, as one that looks best and by its bound
        order = np.lexsort((ids, row))
        once = np.ones(len(order), bool)
        once[1:] = (np.diff(row[order]) != 0) | (np.diff(ids[order]) != 0)
        order = order[once]
        row, ids, score = row[order], ids[order], score[order]
        order, rank = _first_k(row, ids, score, k)
        self.score[asked], self.ids[asked] = -np.inf, np.iinfo(np.int64).max
        self.score[row[order], rank], self.ids[row[order], rank] = score[order], ids[order]

    def rows(self, qids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        held = self.score > -np.inf
        return np.repeat(qids, held.sum(axis=1)), self.ids[held], self.score[held]


def meet(ids: np.ndarray, vectors: np.ndarray, coded: np.ndarray, qids: np.ndarray, queries: np.ndarray, turn: np.ndarray, best: Best, tile: int = TILE) -> None:
    """Enter one block's vectors among the best of ``queries``; a query's own id is left out.  ``coded`` is ``signs`` of the block."""
    (n, d), k = vectors.shape, best.score.shape[1]
    length = lambda v: np.sqrt((v * v).sum(axis=1))
    norms = np.concatenate([length(vectors[at : at + CHUNK].astype(np.float64)) for at in range(0, n, CHUNK)] or [np.zeros(0)])
    look = min(PROBES * k, n, FIRST)

    def rerank(o: np.ndarray, i: np.ndarray, least: np.ndarray | None) -> None:
        """Exact scores of pairs; where a threshold holds, single precision thins them out before."""
        kept = []
        for at in range(0, len(o), EXACT):
            a, b = o[at : at + EXACT], i[at : at + EXACT]
            if least is not None:
                near = np.einsum("ij,ij->i", unit32[a], turned32[b]) >= least[b]
                a, b = a[near], b[near]
            other = ids[a] != qids[first + b]
            kept.append((a[other], b[other]))
        a, b = (np.concatenate(c) for c in zip(*kept, strict=True)) if kept else (np.zeros(0, np.int64),) * 2
        if len(a):
            score = np.concatenate([(vectors[a[s : s + EXACT]].astype(np.float64) * asked[b[s : s + EXACT]]).sum(axis=1) for s in range(0, len(a), EXACT)]) / (norms[a] * lengths[b])
            best.take(first + b, ids[a], score)

    unit32 = np.empty((n, d), np.float32)
    for at in range(0, n, CHUNK):
        unit32[at : at + CHUNK] = vectors[at : at + CHUNK] / norms[at : at + CHUNK, None]
    for first in range(0, len(queries), tile):
        asked = queries[first : first + tile].astype(np.float64)
        lengths = length(asked)
        m = len(asked)
        turned32 = (asked / lengths[:, None]).astype(np.float32)
        against = np.ones((m, d + 2), np.float32)
        against[:, :d] = (asked / lengths[:, None]) @ turn
        fresh = np.flatnonzero(best.score[first : first + m, -1] == -np.inf)
        if len(fresh) and look:
            # the rows that look best set the first threshold
            estimate = against[fresh, :d] @ coded[:FIRST, :d].T
            top = np.argpartition(-estimate, look - 1, axis=1)[:, :look]
            rerank(top.ravel(), np.repeat(fresh, look), None)
        for at in range(0, n, CHUNK):
            least = (best.score[first : first + m, -1] - SLACK).astype(np.float32)
            against[:, d + 1] = -np.maximum(least, np.float32(-4))
            bound = coded[at : at + CHUNK] @ against.T
            hit = np.flatnonzero(bound.ravel() >= 0)
            o, i = hit // m + at, hit % m
            rerank(o, i, least)


def search(ids: np.ndarray, vectors: np.ndarray, codes: np.ndarray, scale: np.ndarray, qids: np.ndarray, queries: np.ndarray, turn: np.ndarray, k: int, eps: float, tile: int = TILE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query id, vector id, cosine) of each query's best k of one block, itself left out; ties to smaller ids."""
    best = Best(len(qids), k)
    meet(ids, vectors, signs(codes, scale, vectors.shape[1], eps), qids, queries, turn, best, tile)
    return best.rows(qids)


def _fewest_copies(ids: np.ndarray, vectors: np.ndarray, most: int) -> np.ndarray:
    """Rows to keep: of equal vectors those with the ``most`` smallest ids; others never rank."""
    order = np.lexsort((ids, *vectors.T[::-1]))
    fresh = np.ones(len(ids), bool)
    fresh[1:] = (vectors[order][1:] != vectors[order][:-1]).any(axis=1)
    start = np.maximum.accumulate(np.where(fresh, np.arange(len(ids)), 0))
    return np.sort(order[np.arange(len(ids)) - start < most])


def _blocks(batches: Iterator[pa.RecordBatch], kind: type) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(d, g, ids, vectors) of rows (d, g, vec_id, embedding) that are sorted by (d, g)."""
    last: tuple[int, int] | None = None
    held: list[tuple[np.ndarray, np.ndarray]] = []
    for batch in batches:
        d, g, ids = (batch.column(c).to_numpy() for c in ("d", "g", "vec_id"))
        rows = batch.column("embedding")
        cut = np.flatnonzero((d[1:] != d[:-1]) | (g[1:] != g[:-1])) + 1
        for s, e in zip([0, *cut.tolist()], [*cut.tolist(), len(d)], strict=True) if len(d) else ():
            if (key := (int(d[s]), int(g[s]))) != last:
                if held:
                    yield (*last, *(np.concatenate(c) for c in zip(*held, strict=True)))  # type: ignore[misc]
                last, held = key, []
            held.append((ids[s:e].copy(), rows.slice(s, e - s).flatten().to_numpy(zero_copy_only=False).astype(kind).reshape(-1, key[0])))
    if held:
        yield (*last, *(np.concatenate(c) for c in zip(*held, strict=True)))  # type: ignore[misc]


def _packed(d: int, g: int, arrays: dict[str, np.ndarray], key: str) -> pa.RecordBatch:
    raw = [pa.array([x.tobytes()], pa.binary()) for x in arrays.values()]
    return pa.RecordBatch.from_arrays([pa.array([d], pa.int32()), pa.array([g], pa.int64()), *raw], names=["d", key, *arrays])


def _indexed(seed: int, most: int, kind: type):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for d, g, ids, vectors in _blocks(batches, kind):
            keep = _fewest_copies(ids, vectors, most)
            ids, vectors = ids[keep], np.ascontiguousarray(vectors[keep])
            codes, scale = encode(vectors.astype(np.float64), rotation(d, seed))
            yield _packed(d, g, {"ids": ids, "vectors": vectors, "codes": codes, "scale": scale}, "g")

    return run


def _asking(kind: type):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for d, slot, ids, vectors in _blocks(batches, kind):
            yield _packed(d, slot, {"qids": ids, "queries": vectors}, "slot")

    return run


def _searched(seed: int, k: int, eps: float, kind: type):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[tuple[int, int], tuple[np.ndarray, Best]] = {}
        last, block = None, None
        for batch in batches:
            for i in range(batch.num_rows):
                d, g, slot = (batch.column(c)[i].as_py() for c in ("d", "g", "slot"))
                of = lambda c, t: np.frombuffer(batch.column(c)[i].as_buffer(), t)  # noqa: B023, E731
                turn = rotation(d, seed)
                if (d, g) != last:
                    ids = of("ids", np.int64).copy()
                    coded = signs(of("codes", np.uint64).reshape(len(ids), -1), of("scale", np.float64), d, eps)
                    last, block = (d, g), (ids, of("vectors", kind).reshape(-1, d).copy(), coded)
                qids, queries = of("qids", np.int64), of("queries", kind).reshape(-1, d)
                if (d, slot) not in best:
                    best[d, slot] = qids.copy(), Best(len(qids), k)
                meet(*block, qids, queries, turn, best[d, slot][1])  # type: ignore[misc]
        for qids, b in best.values():
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in b.rows(qids)], names=["query_id", "vec_id", "score"])

    return run


def nearest(vectors: DataFrame, divisor: int = 50, k: int = 5, eps: float = 1.9, seed: int = 7, block: int = 1 << 16) -> DataFrame:
    """(query_id, rank, vec_id, score): ``k`` nearest by cosine of each row of ``vectors`` (vec_id, embedding) whose id ``divisor`` divides.

    Rows with a null id, and vectors null, empty, zero or holding null or non-finite
    components, take no part.  Vectors are compared with those of their own length.
    Of rows that share a vec_id the smallest vector counts.  Fewer candidates than
    ``k`` are all returned; an empty table gives no rows; other columns are ignored.
    A block has ``block`` rows at most, but for the spread of hashes.
    """
    sound = "embedding IS NOT NULL AND size(embedding) > 0 AND forall(embedding, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('Infinity')) AND exists(embedding, x -> x <> 0)"
    # single precision stays as it is: scores are made of it in double precision
    kind, name = (np.float32, "array<float>") if dict(vectors.dtypes)["embedding"] == "array<float>" else (np.float64, "array<double>")
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast(name).alias("embedding")).where("vec_id IS NOT NULL").where(sound)
    rows, _ = materialize(rows.groupBy("vec_id").agg(F.min("embedding").alias("embedding")), "ann-vectors")
    asks = F.pmod("vec_id", F.lit(divisor)) == 0
    total, asked, widest = rows.agg(F.count(F.lit(1)), F.count(F.when(asks, 1)), F.max(F.size("embedding"))).first()
    most = max(1, min(block, NUMBERS // (widest or 1), max(LEAST, math.ceil(total / BLOCKS))))
    groups, slots = max(1, math.ceil(total / most)), max(1, math.ceil(asked / min(ASKED, max(1, NUMBERS // (widest or 1)))))
    dealt = lambda df, n, key: df.select(F.size("embedding").alias("d"), F.pmod(F.xxhash64("vec_id"), F.lit(n)).alias(key), "vec_id", "embedding").repartition(n, "d", key).sortWithinPartitions("d", key)
    index, _ = materialize(dealt(rows, groups, "g").mapInArrow(_indexed(seed, k + 1, kind), "d int, g long, ids binary, vectors binary, codes binary, scale binary"), "ann-index")
    queries, _ = materialize(dealt(rows.where(asks), slots, "g").mapInArrow(_asking(kind), "d int, slot long, qids binary, queries binary"), "ann-queries")
    # each pair of blocks meets in the task that reads both: no exchange, and no key that all rows share
    pairs = index.join(queries.hint("shuffle_replicate_nl"), "d")
    found = pairs.mapInArrow(_searched(seed, k, eps, kind), "query_id long, vec_id long, score double")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op6_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"))
