"""Integrity: hash chains, gaps, reports, manifests, Merkle roots.

A record's previous hash is the hash of the record before it, so checking needs one neighbour. Within segments that is a lag in a
window by segment; across segments the first record of each meets the last of the segment before it that is there, by a lag over one row a
segment (a log of 100 TB has some million segments of 64 MB, so that is one small task). No window runs over the records of a whole log.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from auditarium.functions.model import NO_HASH


def hashed(ev: DataFrame) -> DataFrame:
    return ev.withColumn("hash", F.sha2(F.col("event_data").cast("binary"), 256))


def _before(ev: DataFrame, column: str) -> DataFrame:
    """segment, boundary: the column of the last record in the segment before it, whatever that one's number is."""
    ends = ev.groupBy("segment").agg(F.max_by(column, "sequence").alias("last"))
    return ends.withColumn("boundary", F.lag("last").over(Window.orderBy("segment"))).select("segment", "boundary")


def chained(ev: DataFrame) -> DataFrame:
    """ev with hash and prev_hash, as a writer would chain it: through all segments in order."""
    ev = hashed(ev)
    inner = F.lag("hash").over(Window.partitionBy("segment").orderBy("sequence"))
    before = _before(ev, "hash")
    return ev.withColumn("inner", inner).join(before, "segment", "left").withColumn("prev_hash", F.coalesce("inner", "boundary", F.lit(NO_HASH))).drop("inner", "boundary")


def check_chain(ev: DataFrame) -> DataFrame:
    """ev (with prev_hash as stored) with linked: whether the stored hash is that of the record before. The first record must be a log's first one,
    without a hash before it; so what is missing breaks the chain, be it a record, a segment, or the first ones."""
    actual = chained(ev.withColumnRenamed("prev_hash", "stored"))
    return actual.withColumn("linked", F.col("stored").eqNullSafe(F.col("prev_hash"))).drop("prev_hash").withColumnRenamed("stored", "prev_hash")


def check_gaps(ev: DataFrame) -> DataFrame:
    """Where sequences don't go on by one: the record behind each gap, and how many are missing. Segments may be missing, too."""
    inner = F.lag("sequence").over(Window.partitionBy("segment").orderBy("sequence"))
    rows = ev.withColumn("inner", inner).join(_before(ev, "sequence"), "segment", "left").withColumn("before", F.coalesce("inner", "boundary"))
    return rows.where(F.col("sequence") - F.col("before") != 1).select("segment", "sequence", "before", (F.col("sequence") - F.col("before") - 1).alias("missing"))


def integrity_report(checked: DataFrame, bad: str = "false") -> DataFrame:
    """One row: records, damaged ones, chain breaks, corrupted (either counts, a record may count twice), the last sequence and time, valid."""
    broken, damaged = F.count_if(~F.col("linked")), F.count_if(F.expr(bad))
    return checked.agg(F.count("*").alias("total"), damaged.alias("damaged"), broken.alias("chain_breaks"), (broken + damaged).alias("corrupted"), F.max("sequence").alias("last_sequence"), F.max_by("ts", "sequence").alias("last_time"), ((broken + damaged) == 0).alias("valid"))


def manifest_mismatch(listed: DataFrame, manifest: DataFrame) -> DataFrame:
    """Objects (name, md5_b64) whose digest is not the remembered one; unknown objects pass."""
    known = manifest.select("name", F.col("md5_b64").alias("expected"))
    return listed.join(known, "name", "left").where(F.col("expected").isNotNull() & F.col("md5_b64").isNotNull() & (F.col("expected") != F.col("md5_b64")))


def object_integrity(manifest: DataFrame) -> DataFrame:
    """One row over name, size, encrypted, locked, retention_until."""
    return manifest.agg(F.count("*").alias("objects"), F.sum("size").alias("bytes"), F.count_if(~F.col("encrypted")).alias("unencrypted"), F.count_if(~F.col("locked")).alias("unlocked"), F.count_if(F.col("retention_until").isNull()).alias("no_retention"))


def shadow_check(primary: DataFrame, shadow: DataFrame) -> DataFrame:
    """One row: files on both sides, equal counts, and names on one side only."""
    both = primary.select("name", F.lit(1).alias("p")).join(shadow.select("name", F.lit(1).alias("s")), "name", "full_outer")
    return both.agg(F.count("p").alias("primary_files"), F.count("s").alias("shadow_files"), F.count_if(F.col("s").isNull()).alias("missing_in_shadow"), F.count_if(F.col("p").isNull()).alias("missing_in_primary")).withColumn("counts_equal", F.col("primary_files") == F.col("shadow_files"))


def _numbered(ev: DataFrame) -> DataFrame:
    """pos (0, 1, ...) and hash of all records in order, whatever their sequences: places in a segment plus the counts of the segments before it."""
    counts = ev.groupBy("segment").agg(F.count("*").alias("n"))
    offsets = counts.select("segment", (F.sum("n").over(Window.orderBy("segment")) - F.col("n")).alias("offset"))
    place = F.row_number().over(Window.partitionBy("segment").orderBy("sequence"))
    return hashed(ev).withColumn("place", place).join(offsets, "segment").select("sequence", (F.col("offset") + F.col("place") - 1).alias("pos"), "hash")


def merkle_levels(ev: DataFrame, count: int, step: int = 10) -> list[DataFrame]:
    """Nodes (pos, hash) of the tree over the hashes of count records: the leaves, every step-th level above, and the root. An odd node is paired with itself.

    Aligned runs of 2^step nodes are folded where they meet, so a shuffle serves step levels of the tree."""
    nodes = _numbered(ev).select("pos", "hash")
    levels, out = max(0, (count - 1).bit_length()), [nodes]
    while levels:
        own = min(step, levels)
        nodes = nodes.groupBy(F.shiftright("pos", own).alias("run")).agg(_ordered().alias("h"))
        for _ in range(own):
            nodes = nodes.withColumn("h", F.transform(F.sequence(F.lit(0), F.expr("cast((size(h) - 1) div 2 as int)")), _pair))
        nodes = nodes.select(F.col("run").alias("pos"), F.get("h", F.lit(0)).alias("hash"))
        out.append(nodes)
        levels -= own
    return out


def _ordered():
    return F.transform(F.array_sort(F.collect_list(F.struct("pos", "hash"))), lambda x: x["hash"])


def _pair(k):
    return F.sha2(F.concat(F.get("h", 2 * k), F.coalesce(F.get("h", 2 * k + 1), F.get("h", 2 * k))).cast("binary"), 256)


def merkle_root(ev: DataFrame, count: int, step: int = 10) -> DataFrame:
    """One row: the root over the hashes of count records in order; gaps in their sequences don't matter."""
    return merkle_levels(ev, count, step)[-1].select(F.col("hash").alias("root"))


def merkle_proofs(ev: DataFrame, sequences: DataFrame, count: int, step: int = 10) -> DataFrame:
    """sequence, hash, proof: for each of sequences that the log has, the neighbours on the way to the root (left: whether it stands left; hash).

    A level's nodes meet only the runs of 2^step neighbours that a proof needs."""
    numbered = _numbered(ev)
    rows = numbered.join(sequences.select("sequence").distinct(), "sequence", "left_semi").withColumn("at", F.col("pos")).withColumn("proof", F.expr("cast(array() as array<struct<left:boolean,hash:string>>)"))
    levels, done = max(0, (count - 1).bit_length()), 0
    for nodes in merkle_levels(ev, count, step)[:-1]:
        own = min(step, levels - done)
        runs = nodes.withColumn("run", F.shiftright("pos", own)).join(rows.select(F.shiftright("at", own).alias("run")).distinct(), "run", "left_semi").groupBy("run").agg(_ordered().alias("h"))
        rows = rows.join(runs, F.shiftright("at", own) == F.col("run")).withColumn("k", (F.col("at") - F.shiftleft("run", own)).cast("int"))
        for _ in range(own):
            beside = F.get("h", F.col("k") + 1 - 2 * (F.col("k") % 2))
            rows = rows.withColumn("proof", F.concat("proof", F.array(F.struct((F.col("k") % 2 == 1).alias("left"), F.coalesce(beside, F.get("h", F.col("k"))).alias("hash")))))
            rows = rows.withColumn("h", F.transform(F.sequence(F.lit(0), F.expr("cast((size(h) - 1) div 2 as int)")), _pair)).withColumn("k", F.expr("k div 2").cast("int"))
        rows = rows.drop("h", "k").withColumn("at", F.col("run")).drop("run")
        done += own
    return rows.select("sequence", "hash", "proof")


def check_proofs(proofs: DataFrame, root: str) -> DataFrame:
    """proofs with valid: whether hash and proof lead to the root."""
    join = lambda acc, x: F.sha2(F.when(x["left"], F.concat(x["hash"], acc)).otherwise(F.concat(acc, x["hash"])).cast("binary"), 256)
    return proofs.withColumn("valid", F.aggregate("proof", F.col("hash"), join) == F.lit(root))
