"""Byte-level BPE encoding and decoding with overlapping chunks.

A text of more than ``chunk`` code points is cut into chunks that overlap by
``overlap``.  Every chunk is pre-tokenised on its own, in parallel, from its
arbitrary start.  Pre-token matching has no memory: once two neighbours agree on
one boundary in their overlap they agree on all later ones, so the text is cut at
the first common boundary and the pieces between cuts are encoded in parallel.
Neighbours that never agree in their overlap (a long run of one class) stay in one
piece.  Shorter texts are one piece and move to no other task.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, LongType, StringType, StructField, StructType

from spindrift.llm.common import materialize, table, text_or_empty

VOCABULARY = "byte_bpe_multi_50k.tiktoken"
#: Code points past a boundary that decide the match that ends there ("'re" is the longest look).
_LOOK = 3
_DIGESTS = ("n_tokens", "ids_sha256", "decoded_sha256")


@lru_cache(maxsize=4)
def tokenizer(path: str, pattern: str):
    """tiktoken encoding of a rank file, without special tokens; one for each worker process."""
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
    return tiktoken.Encoding("spindrift", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def boundaries(text: str, start: int, pattern: str) -> np.ndarray:
    """Ends of the pre-tokens of ``text``, plus ``start``, that no later text can change."""
    import regex

    ends = np.fromiter((m.end() for m in regex.compile(pattern).finditer(text)), np.int64)
    return ends[ends <= len(text) - _LOOK] + start


def _public_tokenizer() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN


#: Code points whose tokens a worker holds at a time, a longer piece excepted.
_SLICE = 2_000_000


@lru_cache(maxsize=4)
def _vocabulary(path: str) -> tuple[list[bytes], list[str]]:
    """Raw bytes and decimal form of each token id."""
    with open(path, "rb") as f:
        ranks = {int(rank): base64.b64decode(token) for token, rank in map(bytes.split, f)}
    size = max(ranks, default=-1) + 1
    return [ranks.get(i, b"") for i in range(size)], [str(i) for i in range(size)]


def _slices(batch: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Rows of ``batch`` a few texts (its last column) at a time, since some texts are very long."""
    texts, at = batch.column(batch.num_columns - 1), 0
    while at < batch.num_rows:
        held, size = [], 0
        while at + len(held) < batch.num_rows and (not held or size < _SLICE):
            held.append(texts[at + len(held)].as_py() or "")
            size += len(held[-1])
        yield batch.slice(at, len(held)), held
        at += len(held)


def _encoder(path: str, pattern: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = tokenizer(path, pattern)
        for batch in batches:
            keep = batch.schema.names[:-1]
            for part, texts in _slices(batch):
                ids = [np.asarray(enc.encode_to_numpy(t, disallowed_special=()), np.int32) for t in texts]
                offsets = np.concatenate(([0], np.cumsum([len(x) for x in ids]))).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(ids), pa.int32()))
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], lists], names=[*keep, "ids"])

    return run


def _round_trip(path: str, pattern: str):
    """Encodes and decodes in one pass, so that neither ids nor decoded bytes leave the worker."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, (raw, named) = tokenizer(path, pattern), _vocabulary(path)
        for batch in batches:
            keep = batch.schema.names[:-1]
            for part, texts in _slices(batch):
                size, ids_sha, raw_sha = [], [], []
                for t in texts:
                    ids = enc.encode_to_numpy(t, disallowed_special=()).tolist()
                    size.append(len(ids))
                    ids_sha.append(hashlib.sha256(",".join(map(named.__getitem__, ids)).encode()).hexdigest())
                    raw_sha.append(hashlib.sha256(b"".join(map(raw.__getitem__, ids))).hexdigest())
                columns = [pa.array(size, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(raw_sha, pa.string())]
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], *columns], names=[*keep, *_DIGESTS])

    return run


def _edges(pattern: str, chunk: int, overlap: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            heads, tails = [], []
            for k, part in zip(batch.column("k").to_pylist(), batch.column("part").to_pylist(), strict=True):
                found = boundaries(part, k * chunk, pattern)
                heads.append(found[found < k * chunk + overlap].tolist())
                tails.append(found[found >= (k + 1) * chunk].tolist())
            kind = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("digest"), batch.column("k"), pa.array(heads, kind), pa.array(tails, kind)], names=["doc_id", "digest", "k", "head", "tail"])

    return run


def _chunks(chunk: int, overlap: int):
    """Rows (doc_id, digest, k, part) of the overlapping chunks of long texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                text = batch.column(2)[i].as_py()
                for k in range((len(text) - overlap - 1) // chunk + 1):
                    part = text[k * chunk : (k + 1) * chunk + overlap]
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, 1), batch.column(1).slice(i, 1), pa.array([k], pa.int32()), pa.array([part], pa.string())], names=["doc_id", "digest", "k", "part"])

    return run


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (doc_id, digest, n, piece) of long texts between their cuts."""
    for batch in batches:
        for i in range(batch.num_rows):
            text, cuts = batch.column(2)[i].as_py(), batch.column(3)[i].as_py()
            for n, (a, b) in enumerate(zip(cuts, [*cuts[1:], len(text)], strict=True)):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, 1), batch.column(1).slice(i, 1), pa.array([n], pa.int32()), pa.array([text[a:b]], pa.string())], names=["doc_id", "digest", "n", "piece"])


def _split(docs: DataFrame, chunk: int, overlap: int, keep: tuple[str, ...]) -> tuple[DataFrame, DataFrame]:
    """(rows of one piece, rows of longer texts); the latter are written, since three steps read them."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *(F.col(f"`{c}`").alias(f"keep_{i}") for i, c in enumerate(keep)), text_or_empty().alias("text"))
    long, _ = materialize(rows.where(F.length("text") > chunk + overlap).withColumn("digest", F.sha2("text", 256)), "bpe-long")
    return rows.where(F.length("text") <= chunk + overlap), long


def _long_ids(long: DataFrame, path: str, pattern: str, chunk: int, overlap: int) -> DataFrame:
    """Rows of ``long`` with ids in place of the text: chunks pre-tokenised in parallel, stitched, pieces encoded in parallel."""
    once = long.select("doc_id", "digest", "text").dropDuplicates(["doc_id", "digest"])
    cut = once.mapInArrow(_chunks(chunk, overlap), "doc_id long, digest string, k int, part string")
    edges = cut.repartition("doc_id", "digest", "k").mapInArrow(_edges(pattern, chunk, overlap), "doc_id long, digest string, k int, head array<long>, tail array<long>")
    # a chunk's row holds at most two overlaps of boundaries, so a text's list is a small share of the text
    chain = edges.groupBy("doc_id", "digest").agg(F.array_sort(F.collect_list(F.struct("k", "head", "tail"))).alias("c"))
    synced = "filter(transform(sequence(1, size(c) - 1), j -> array_min(array_intersect(c[j - 1].tail, c[j].head))), p -> p IS NOT NULL)"
    cuts = chain.select(F.col("doc_id").alias("c_id"), F.col("digest").alias("c_digest"), F.expr(f"CASE WHEN size(c) > 1 THEN concat(array(0L), {synced}) ELSE array(0L) END").alias("cuts"))
    pieces = once.join(cuts, F.col("doc_id").eqNullSafe(F.col("c_id")) & (F.col("digest") == F.col("c_digest"))).select("doc_id", "digest", "text", "cuts").mapInArrow(_pieces, "doc_id long, digest string, n int, piece string")
    coded = pieces.repartition("doc_id", "digest", "n").mapInArrow(_encoder(path, pattern), "doc_id long, digest string, n int, ids array<int>")
    joined = coded.groupBy(F.col("doc_id").alias("c_id"), F.col("digest").alias("c_digest")).agg(F.expr("flatten(transform(array_sort(collect_list(struct(n, ids))), x -> x.ids))").alias("ids"))
    return long.drop("text").join(joined, F.col("doc_id").eqNullSafe(F.col("c_id")) & (F.col("digest") == F.col("c_digest"))).drop("c_id", "c_digest", "digest")


def _files(path: str | None, pattern: str | None) -> tuple[str, str]:
    return path or _public_tokenizer()[0], pattern or _public_tokenizer()[1]


def encode(docs: DataFrame, path: str | None = None, pattern: str | None = None, chunk: int = 65536, overlap: int = 1024, keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, ids array<int>) of every row of ``docs`` (doc_id, text), as the tiktoken library encodes the whole text.

    A null text counts as empty and has no ids.  Rows equal in doc_id and text get
    equal ids, each row its own; a null doc_id is kept; an empty table gives no
    rows.  Of other columns those in ``keep`` follow doc_id, whatever their names
    but doc_id and ids; the rest are ignored.
    """
    path, pattern = _files(path, pattern)
    short, long = _split(docs, chunk, overlap, keep)
    fields = StructType([*short.drop("text").schema.fields, StructField("ids", ArrayType(IntegerType()))])
    whole = short.mapInArrow(_encoder(path, pattern), fields)
    return _named(whole.unionByName(_long_ids(long, path, pattern, chunk, overlap)), keep)


def _named(coded: DataFrame, keep: tuple[str, ...]) -> DataFrame:
    kept = [f"keep_{i}" for i in range(len(keep))]
    return coded.select("doc_id", *(F.col(k).alias(c) for k, c in zip(kept, keep, strict=True)), *(c for c in coded.columns if c != "doc_id" and c not in kept))


def decode(coded: DataFrame, path: str | None = None) -> DataFrame:
    """``coded`` (its last column ids) with ``decoded`` binary, the tokens' raw bytes in sequence; no ids give no bytes."""
    path = path or _public_tokenizer()[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw, _ = _vocabulary(path)
        for batch in batches:
            ids, at = batch.column(batch.num_columns - 1), 0
            while at < batch.num_rows:
                held, size = [], 0
                while at + len(held) < batch.num_rows and (not held or size < _SLICE):
                    tokens = ids[at + len(held)].as_py() or ()
                    size += len(tokens)
                    held.append(b"".join(map(raw.__getitem__, tokens)))
                yield pa.RecordBatch.from_arrays([*batch.slice(at, len(held)).columns, pa.array(held, pa.binary())], names=[*batch.schema.names, "decoded"])
                at += len(held)

    return coded.mapInArrow(run, StructType([*coded.schema.fields, StructField("decoded", BinaryType())]))


def digests(coded: DataFrame) -> DataFrame:
    """``coded`` (with ids and decoded) with n_tokens and SHA-256 digests in their place."""
    return coded.select(
        *(c for c in coded.columns if c not in ("ids", "decoded")),
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def round_trip(docs: DataFrame, path: str | None = None, pattern: str | None = None, chunk: int = 65536, overlap: int = 1024, keep: tuple[str, ...] = ()) -> DataFrame:
    """``digests(decode(encode(docs)))`` with one pass of a worker over each text of one piece; odd rows as in ``encode``."""
    path, pattern = _files(path, pattern)
    short, long = _split(docs, chunk, overlap, keep)
    fields = StructType([*short.drop("text").schema.fields, StructField("n_tokens", LongType()), StructField("ids_sha256", StringType()), StructField("decoded_sha256", StringType())])
    whole = short.mapInArrow(_round_trip(path, pattern), fields)
    return _named(whole.unionByName(digests(decode(_long_ids(long, path, pattern, chunk, overlap), path))), keep)


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(table(spark, sf_dir, "documents"))
