"""Sharding by a permutation-filled lookup table (consistent hashing with even shares).

Every shard has a permutation of the slots of a prime-sized table: it starts at an offset and goes on
by a skip, both from its name's md5. Shards take turns; at its turn a shard claims the next slot of its
permutation that is free, until none is. A row's key hashes to a slot, and one lookup gives its shard.
Adding or dropping a shard moves few slots besides its own.

The table has `size` rows, which is a parameter, so it is broadcast whatever the input's size: placement
is one map-side hash lookup, without a shuffle, and a key with a third of all rows costs nothing special.
Only built-in functions are used on rows.

Nulls: a null key is placed as the empty text. Very long keys are hashed as a whole where they are. Ties and repeated rows: equal keys get equal shards, each
row is returned once. An empty table gives no rows. Other columns of the input are kept unless they are
named slot or shard; those are replaced.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import table

SHARDS, SIZE = 64, 8191


def _number(text: str) -> int:
    return int(hashlib.md5(text.encode()).hexdigest()[:8], 16)


def fill_table(shards: list[str], size: int) -> list[int]:
    """The index of the shard that owns each slot. size: a prime, a hundred times the shards or more for even shares."""
    if size < 2 or any(size % k == 0 for k in range(2, int(size**0.5) + 1)):
        raise ValueError(f"size must be a prime, not {size}")
    if not 0 < len(shards) <= size:
        raise ValueError(f"{len(shards)} shards don't fit {size} slots")
    at = [_number(f"offset|{s}") % size for s in shards]
    skip = [_number(f"skip|{s}") % (size - 1) + 1 for s in shards]
    owner = [-1] * size
    left = size
    while left:
        for k in range(min(len(shards), left)):
            while owner[at[k]] >= 0:
                at[k] = (at[k] + skip[k]) % size
            owner[at[k]] = k
            left -= 1
    return owner


def lookup(spark: SparkSession, shards: list[str], size: int) -> DataFrame:
    """Rows slot, shard (its index)."""
    owners = F.split(F.lit(",".join(map(str, fill_table(shards, size)))), ",")
    return spark.range(size).select(F.col("id").cast("int").alias("slot"), F.element_at(owners, (F.col("id") + 1).cast("int")).cast("int").alias("shard"))


def slot_of(key: Column, size: int) -> Column:
    text = F.coalesce(key.cast("string"), F.lit(""))
    return F.pmod(F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("long"), F.lit(size)).cast("int")


def place(df: DataFrame, key: str, shards: list[str] | None = None, size: int = SIZE) -> DataFrame:
    """df with slot and shard."""
    shards = shards or [f"shard-{k:03d}" for k in range(SHARDS)]
    rows = df.drop("slot", "shard").withColumn("slot", slot_of(F.col(key), size))
    return rows.join(F.broadcast(lookup(df.sparkSession, shards, size)), "slot")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return place(table(spark, sf_dir, "documents").select("doc_id"), "doc_id").select("doc_id", "slot", "shard")


#: The same table by a recursion of one turn a step.
ORACLE = f"""
WITH RECURSIVE shards AS (
  SELECT list(('0x' || substr(md5('offset|shard-' || lpad(k::VARCHAR, 3, '0')), 1, 8))::BIGINT % {SIZE} ORDER BY k) AS home,
         list(('0x' || substr(md5('skip|shard-' || lpad(k::VARCHAR, 3, '0')), 1, 8))::BIGINT % {SIZE - 1} + 1 ORDER BY k) AS skip
  FROM range({SHARDS}) r(k)),
turns AS (
  SELECT -1 AS turn, -1::BIGINT AS slot, list_resize([false], {SIZE}, false) AS taken FROM shards
  UNION ALL
  SELECT turn, slot, list_concat(list_concat(taken[1:slot], [true]), taken[slot + 2:]) FROM (
    SELECT turn + 1 AS turn, taken,
      list_filter(list_transform(range(0, {SIZE}), lambda j: (home[(turn + 1) % {SHARDS} + 1] + j * skip[(turn + 1) % {SHARDS} + 1]) % {SIZE}), lambda s: NOT taken[s + 1])[1] AS slot
    FROM turns, shards WHERE turn + 1 < {SIZE}))
SELECT d.doc_id, t.slot::INTEGER AS slot, (t.turn % {SHARDS})::INTEGER AS shard
FROM (SELECT doc_id, ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT % {SIZE} AS slot FROM documents) d JOIN turns t USING (slot)
"""
