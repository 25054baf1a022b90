"""Sharding by a permutation-filled lookup table (Maglev hashing).

Every shard has a preference order over the slots of a prime-sized table: the
arithmetic progression offset + k * skip from two hashes of its name.  Shards take
turns; each claims the first slot of its order that is still free.  The table is a
function of the shard names alone and has ``size`` rows, which is the proven bound
of the broadcast; a row's place is then one hash and one lookup.
"""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spindrift.llm.common import table

#: Production table: prime, and over 100 times the shards, for even shares.
TABLE_SIZE = 16381
SHARDS = 64
#: Tables of more slots, some tens of megabytes, are joined without being broadcast.
MOST_BROADCAST = 1 << 20


def _is_prime(n: int) -> bool:
    return n > 1 and all(n % k for k in range(2, int(n**0.5) + 1))


def _number(text: str) -> int:
    """First 60 bits of the MD5 of ``text``, as ``key_number`` has them in SQL."""
    return int(hashlib.md5(text.encode()).hexdigest()[:15], 16)


def fill(shards: list[str], size: int) -> list[int]:
    """Index of the shard that owns each slot; plain control code over ``size`` numbers, no data."""
    if not _is_prime(size):
        raise ValueError("the table's size must be prime, so that every order reaches every slot")
    if not shards or len(shards) > size or len(set(shards)) < len(shards):
        raise ValueError("one to size shards with distinct names are needed")
    offset = [_number(f"offset:{s}") % size for s in shards]
    skip = [_number(f"skip:{s}") % (size - 1) + 1 if size > 2 else 1 for s in shards]
    at, owner, left = list(offset), [-1] * size, size
    while left:
        for i in range(len(shards)):
            while owner[at[i]] >= 0:
                at[i] = (at[i] + skip[i]) % size
            owner[at[i]] = i
            left -= 1
            if not left:
                break
    return owner


def lookup_table(spark: SparkSession, shards: list[str], size: int = TABLE_SIZE) -> DataFrame:
    """(slot int, shard string) with ``size`` rows."""
    owners = F.from_json(F.lit(json.dumps(fill(shards, size))), "array<int>")
    names = F.array(*(F.lit(s) for s in shards))
    one = spark.range(1, numPartitions=1)
    return one.select(F.posexplode(owners).alias("slot", "owner"), names.alias("names")).select("slot", F.expr("names[owner]").alias("shard"))


def key_number(key: Column) -> Column:
    """First 60 bits of the MD5 of the key's text; a null key hashes as the empty text."""
    return F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), 1, 15), 16, 10).cast("long")


def shard(rows: DataFrame, key_col: str, shards: list[str], size: int = TABLE_SIZE, salt_cols: tuple[str, ...] = ()) -> DataFrame:
    """``rows`` with ``slot`` and ``shard``; nothing is shuffled for tables of up to MOST_BROADCAST slots.

    Equal keys have equal shards.  A key that may hold a large share of all rows can
    be spread by ``salt_cols``, whose texts then join the key.  Null keys are one
    key, repeated rows one place, an empty table gives no rows; columns named slot
    or shard are replaced.
    """
    key = F.col(f"`{key_col}`")
    if salt_cols:
        key = F.concat_ws("\x1f", key.cast("string"), *(F.col(f"`{c}`").cast("string") for c in salt_cols))
    kept = [F.col(f"`{c}`") for c in rows.columns if c not in ("slot", "shard") or c == key_col]
    placed = rows.select(F.pmod(key_number(key), F.lit(size)).cast("int").alias("__slot"), *kept)
    found = lookup_table(rows.sparkSession, shards, size)
    found = F.broadcast(found) if size <= MOST_BROADCAST else found
    return placed.join(found, placed["__slot"] == found["slot"]).select(*(F.col(f"`{c}`") for c in rows.columns if c not in ("slot", "shard")), "slot", "shard")


def shard_names(n: int = SHARDS) -> list[str]:
    return [f"shard-{i:04d}" for i in range(n)]


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars")
    return shard(docs, "doc_id", shard_names())


def oracle_sql() -> str:
    """DuckDB SQL of the hash and the lookup; the fill itself is tested against brute force."""
    owners = ",".join(map(str, fill(shard_names(), TABLE_SIZE)))
    return f"""
WITH t AS (SELECT unnest(range({TABLE_SIZE})) AS slot, unnest([{owners}]) AS owner),
d AS (SELECT doc_id, source, n_chars, CAST(CAST('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 15) AS BIGINT) % {TABLE_SIZE} AS INTEGER) AS slot FROM documents)
SELECT doc_id, source, n_chars, d.slot AS slot, 'shard-' || lpad(CAST(owner AS VARCHAR), 4, '0') AS shard FROM d JOIN t ON d.slot = t.slot"""
