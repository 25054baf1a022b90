"""Mixing sources to target weights by Pfair scheduling.

The rows of each source are cut into blocks.  In the fluid ideal every active
source is served at its weight's share of the active weights, so the fluid clock
at virtual time v is sum over sources of min(weight * v, blocks).  Block j of a
source has its release where the fluid begins it, v = j / weight, and its deadline
where the fluid ends it.  Earliest-deadline-first over released blocks fills one
slot after another; a source is then less than one block from its fluid share at
any slot.  Once a source is used up the others go on at renewed shares, so every
row gets a place.

The number of blocks is a parameter (``slots``), not a property of the data: block
size follows the corpus, so the schedule stays one small table, walked once for each
slot and source.  Ranks inside a
source come from counts of hash buckets, so that a source with a third of all rows
is ranked by many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from spindrift.llm.common import materialize, table

#: Rows of a bucket, on average, where there are more than the least number of buckets.
BUCKET_ROWS, LEAST_BUCKETS = 8192, 512
#: Weights and virtual times are whole numbers on this grid, so that ties and releases are exact.
GRID = 1_000_000


def _bind(value: str, name: str, body: str) -> str:
    return f"transform(array({value}), {name} -> {body})[0]"


def schedule(sources: DataFrame) -> DataFrame:
    """(source, block, slot) from ``sources`` (source, weight double, blocks int), one row a source.

    ``sources`` meets in one row: it has a row for each source, never for each
    document, and its blocks sum to the number of slots.  Ties of deadlines go to the
    smaller source name, null first.  Sources with no blocks have no slot.
    """
    w = "struct(source, cast(weight AS double) AS w, cast(blocks AS int) AS n)"
    one = sources.where("blocks > 0").agg(F.expr(f"array_sort(collect_list({w}))").alias("s"))
    # fluid slots served when each source has had v units of service for a unit of weight
    clock = "aggregate(s, 0D, (a, x) -> a + least(x.w * ({v}), cast(x.n AS double)))"
    window = f"struct({clock.format(v='j / s[i].w')} AS r, {clock.format(v='(j + 1) / s[i].w')} AS d)"
    windows = f"transform(s, (x, i) -> transform(sequence(0, x.n - 1), j -> {window}))"
    # rounding of the fluid clock must not make a block late: a release is floored and a deadline raised to whole slots
    candidate = "CASE WHEN c[i] < x.n AND floor(z[i][c[i]].r + 1e-9) <= t THEN struct(ceil(z[i][c[i]].d - 1e-9) AS d, z[i][c[i]].d AS f, i AS i) END"
    first = f"array_min(transform(s, (x, i) -> {candidate})).i"
    # with fluid shares summing to one block a slot some block is always released
    step = f"(a, t) -> {_bind('a.c', 'c', _bind(first, 'p', 'struct(transform(c, (n, i) -> n + CASE WHEN i = p THEN 1 ELSE 0 END) AS c, array_append(a.o, struct(p AS p, c[p] AS block, t AS slot)) AS o)'))}"
    total = "cast(aggregate(s, 0L, (a, x) -> a + x.n) AS int)"
    walk = f"aggregate(sequence(0, {total} - 1), struct(transform(s, x -> 0) AS c, cast(array() AS array<struct<p:int,block:int,slot:int>>) AS o), {step}, a -> a.o)"
    placed = one.where("size(s) > 0").select("s", F.explode(F.expr(_bind(windows, "z", walk))).alias("x"))
    return placed.select(F.expr("s[x.p].source").alias("source"), "x.block", "x.slot")


def _ranked(rows: DataFrame, order: list[Column], buckets: int) -> tuple[DataFrame, DataFrame]:
    """(rows with __bucket, __in, bucket starts) such that start + __in is a row's rank in its source."""
    keyed = rows.withColumn("__bucket", F.pmod(F.xxhash64(*order), F.lit(buckets)).cast("int"))
    counts = keyed.groupBy("__source", "__bucket").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("__source").orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("__source", "__bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__start"), "n")
    inside = keyed.withColumn("__in", F.row_number().over(Window.partitionBy("__source", "__bucket").orderBy(*order)) - 1)
    return inside, starts


def mix(docs: DataFrame, weights: DataFrame | None = None, temperature: float = 0.5, slots: int = 1024, buckets: int | None = None, source_col: str = "source", id_col: str = "doc_id") -> DataFrame:
    """``docs`` with __block and __slot of their source block and __place, the row's rank in its slot.

    ``weights`` has (source, weight); sources it lacks, or with a weight not above
    zero, get the smallest listed weight, so that no row is dropped.  Without it,
    weights are row counts to the power ``temperature``.  A null source is a source.
    Rows are dealt to the blocks of their source by a hash of id and the other columns
    (but for those that hold maps, which have no hash), so equal rows keep apart only
    by rank; an empty table gives no rows.  Rows are ranked in ``buckets``, by default
    LEAST_BUCKETS, or as many as make BUCKET_ROWS rows each.
    """
    names = docs.columns
    buckets = buckets or max(LEAST_BUCKETS, -(-docs.count() // BUCKET_ROWS))
    packed = docs.select(F.struct(*(F.col(f"`{c}`") for c in names)).alias("__doc"))
    rows = packed.select("__doc", F.coalesce(F.col(f"__doc.`{source_col}`").cast("string"), F.lit("\x00")).alias("__source"))
    keys = [F.col(f"__doc.`{id_col}`"), F.xxhash64(*(F.col(f"__doc.`{c}`") for c, t in docs.dtypes if "map<" not in t))]
    keys = [keys[0].cast("string"), keys[1]]
    inside, starts = _ranked(rows, keys, buckets)
    small, path = materialize(starts, "mix-starts")
    sizes = small.groupBy("__source").agg(F.sum("n").alias("rows"))
    total = F.sum("rows").over(Window.partitionBy())
    if weights is None:
        target = sizes.withColumn("weight", F.pow("rows", F.lit(float(temperature)))).withColumn("total", total)
    else:
        listed = weights.select(F.coalesce(F.col("source").cast("string"), F.lit("\x00")).alias("__source"), F.col("weight").cast("double").alias("w")).where("w > 0").groupBy("__source").agg(F.max("w").alias("w"))
        least = F.coalesce(F.min("w").over(Window.partitionBy()), F.lit(1.0))
        target = sizes.join(listed, "__source", "left").withColumn("weight", F.coalesce("w", least)).withColumn("total", total)
    # a block holds total / slots rows in any source; a source's last block may be short
    target = target.withColumn("size", F.greatest(F.ceil(F.col("total") / F.lit(slots)), F.lit(1)))
    target = target.select("__source", "size", F.col("__source").alias("source"), F.greatest(F.round(F.col("weight") * GRID / F.sum("weight").over(Window.partitionBy())), F.lit(1.0)).alias("weight"), F.ceil(F.col("rows") / F.col("size")).cast("int").alias("blocks"))
    plan, plan_path = materialize(target, "mix-target")
    slot, slot_path = materialize(schedule(plan).select(F.col("source").alias("__source"), F.col("block").alias("__block"), F.col("slot").alias("__slot")), "mix-slots")
    # bounded: at most one row for each source and bucket, and for each slot
    offset = small.join(plan.select("__source", "size"), "__source").select("__source", "__bucket", "__start", "size")
    ranked = inside.join(offset, ["__source", "__bucket"]).withColumn("__rank", F.col("__start") + F.col("__in"))
    blocked = ranked.select("__doc", "__source", F.floor(F.col("__rank") / F.col("size")).cast("int").alias("__block"), F.pmod("__rank", "size").alias("__place"), F.col("size").alias("__size"))
    return blocked.join(slot, ["__source", "__block"]).select("__doc", "__block", "__slot", "__place", "__size")


def in_training_order(docs: DataFrame, partitions: int | None = None, **options) -> DataFrame:
    """All rows of ``docs``, with its columns, dealt to ``partitions`` by slot and sorted by slot and place.

    The files that a writer makes of it, read by name, are the mixed sequence.
    Slots hold equal numbers of rows, a source's last excepted, so partition
    bounds need no sampling; a slot is cut by place where there are more partitions.
    """
    mixed = mix(docs, **options)
    parts = partitions or max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    last = options.get("slots", 1024)
    # sources round their blocks up, so a few slots come after ``last``
    at = F.col("__slot") + F.col("__place") / F.col("__size")
    to = F.least(F.floor(at * parts / F.lit(last)), F.lit(parts - 1)).cast("int")
    return mixed.repartitionById(parts, to).sortWithinPartitions("__slot", "__place").select("__doc.*")


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix(table(spark, sf_dir, "documents").select("doc_id", "source"))
    return mixed.select("__doc.doc_id", "__doc.source", F.col("__block").alias("block"), F.col("__slot").alias("slot"), F.col("__place").alias("place"))
