"""Main text of HTML pages by nearest-URL page differencing.

Pages of a host are ordered by URL path; each is paired with the neighbour whose
path has the longer common prefix with its own.  Text lines of both are aligned by
longest common subsequence and shared lines deleted; inside a declared article, and
between copies, only those that many pages of the host share.  Elements that are no
article by their tag, role or name (menus, notices, forms, comments, ...) go as
well, shared or not, since such lines may differ between pages.

The order over a host comes from one range partitioning of (host, path, row) and
the first and last rows of its partitions, so a host with a third of all pages is
paired by many tasks.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from spindrift.llm.common import materialize, table
from spindrift.llm.html_kernels import article, blocks

_PAGE = "page_id long, url string, row long"
#: Parts in which a host's pages meet its frequent lines.
SALTS = 16


def _digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [[x.digest for x in blocks(h.as_py())] for h in batch.column(2)]
        yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(found, pa.list_(pa.int64()))], names=["url", "row", "digests"])


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of each page, compressed: the pages' texts are shuffled once, to meet their partners' digests."""
    press = zstandard.ZstdCompressor(level=3)
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            packs = []
            for h in part.column(3):
                found = blocks(h.as_py())
                packs.append(press.compress(json.dumps([[x.text for x in found], [x.digest for x in found], [x.skipped for x in found], [x.root for x in found]]).encode()))
            yield pa.RecordBatch.from_arrays([*part.columns[:3], pa.array(packs, pa.binary())], names=["page_id", "url", "row", "pack"])


def _articles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    loosen = zstandard.ZstdDecompressor()
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            rows = zip(*(part.column(c).to_pylist() for c in ("pack", "partner", "common")), strict=True)
            texts = ["\n\n".join(article(*json.loads(loosen.decompress(pack)), partner, common)) for pack, partner, common in rows]
            yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), pa.array(texts, pa.string())], names=["page_id", "url", "text"])


def _shared(a: str, b: str) -> tuple[int, int]:
    """Number of leading '/'-parts that two paths share, and of leading characters."""
    parts, other = a.split("/"), b.split("/")
    same = next((i for i, (x, y) in enumerate(zip(parts, other)) if x != y), min(len(parts), len(other)))
    return same, len(os.path.commonprefix((a, b)))


def _nearer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(row, partner, host) from rows with the path and the neighbours before and after; the one before wins ties."""
    for batch in batches:
        rows = zip(*(batch.column(c).to_pylist() for c in ("path", "p_row", "p_path", "n_row", "n_path")), strict=True)
        chosen = [n if p is None else p if n is None or _shared(path, before) >= _shared(path, after) else n for path, p, before, n, after in rows]
        yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(chosen, pa.int64()), batch.column("host")], names=["row", "partner", "host"])


def neighbours(pages: DataFrame) -> DataFrame:
    """(row, partner, host) for ``pages`` (row, url): the row nearest by path in the same host.

    ``pages`` must be a written table, since it is read more than once.  Rows
    without a host, or alone in theirs, are left out.
    """
    url = F.regexp_replace(F.trim("url"), "[?#].*$", "")
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@]*@)?([^/:]+)", 1))
    path = F.regexp_replace(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/]*(.*)$", 1), "/+$", "")
    named = pages.where("url IS NOT NULL").select("row", host.alias("host"), path.alias("path")).where("host <> ''")
    ranged = named.repartitionByRange("host", "path", "row").withColumn("part", F.spark_partition_id())
    keys, _ = materialize(ranged, "html-keys")
    order = ["host", "path", "row"]
    me = F.struct(*order)
    ends = keys.groupBy("part").agg(F.min(me).alias("first"), F.max(me).alias("last"))
    line = Window.partitionBy().orderBy("part")  # a row for each partition
    ends = ends.select("part", F.lag("last").over(line).alias("before"), F.lead("first").over(line).alias("after"))
    here = Window.partitionBy("part").orderBy(*order)
    beside = keys.select("part", *order, F.lag(me).over(here).alias("p"), F.lead(me).over(here).alias("n"))
    both = beside.join(ends, "part").select(*order, F.coalesce("p", "before").alias("p"), F.coalesce("n", "after").alias("n"))
    p, n = F.col("p.host") == F.col("host"), F.col("n.host") == F.col("host")
    mine = both.where(p | n).select("row", "host", "path", *(F.when(here, F.col(f"{side}.{c}")).alias(f"{side}_{c}") for side, here in (("p", p), ("n", n)) for c in ("row", "path")))
    return mine.mapInArrow(_nearer, "row long, partner long, host string")


def with_common(paired: DataFrame, least: int = 4, share: int = 4) -> DataFrame:
    """(row, partner, common) for ``paired`` (row, host, partner, shared): lines of ``shared`` that at least ``least`` pages and one of ``share`` pages of the host share.

    ``paired`` must be a written table.  A host has at most ``share`` times the lines
    of a page of such lines; they meet its pages in salted parts.
    """
    sizes = paired.groupBy("host").agg(F.count(F.lit(1)).alias("pages"))
    lines = paired.select("host", F.explode("shared").alias("line")).groupBy("host", "line").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)
    often = lines.join(sizes, "host").where(F.col("n") * share >= F.col("pages")).groupBy("host").agg(F.collect_list("line").alias("often"))
    spread = often.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    salted = paired.withColumn("salt", F.pmod("row", F.lit(SALTS).cast("long")))
    return salted.join(spread, ["host", "salt"], "left").select("row", "partner", F.array_intersect("shared", "often").alias("common"))


def main_text(pages: DataFrame) -> DataFrame:
    """(page_id, url, text) of every row of ``pages`` (page_id, url, html).

    A null or empty html has an empty text; an empty table gives no rows; a page of
    any length is one row of one task.  A page without a host, or the only one
    of its host, is extracted by elements alone; repeated rows each get a row, and a
    copy as neighbour deletes nothing.  Other columns are ignored.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    # a row is known by what it holds, so that both passes over the pages agree
    rows = rows.select("page_id", "url", F.xxhash64("page_id", "url", "html").alias("row"), "html")
    narrow = rows.select("url", "row", "html").mapInArrow(_digested, "url string, row long, digests array<long>")
    lines, _ = materialize(narrow.dropDuplicates(["row"]), "html-lines")
    pairs = neighbours(lines.select("row", "url"))
    other = lines.select(F.col("row").alias("partner_row"), F.col("digests").alias("partner"))
    met = pairs.join(other, pairs["partner"] == other["partner_row"]).select("row", "host", other["partner"])
    paired, _ = materialize(met.join(lines.select("row", "digests"), "row").select("row", "host", "partner", F.array_intersect("digests", "partner").alias("shared")), "html-pairs")
    partners = with_common(paired)
    packed = rows.mapInArrow(_packed, f"{_PAGE}, pack binary")
    return packed.join(partners, "row", "left").select("page_id", "url", "pack", "partner", "common").mapInArrow(_articles, "page_id long, url string, text string")


def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(table(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))
