"""Chains of records as a graph: records name the hash of the one before them, and from that alone, whatever their order, chains are put together.

Records that stand together are first taken as runs: a task finds, in each batch of its records, those that name another one of the batch, and runs are cut where a record elsewhere names one inside. Where
records lie in files doesn't matter to branches: it lays them together by ranges of their sequences, which a chain follows as a rule. Records whose sequences tell nothing of their place are put together all the
same, from more runs. All records travel once, as 32 bytes a hash; what is left is a row a run: its parent is the run whose last hash it names. On these, pointer doubling finds the first run of each chain and
the records on the way (list ranking), and at the same time the deepest end below each run, in as many rounds as the logarithm of the longest chain of runs. A round is a join of the
runs with themselves and an aggregate; rounds end as tables.

A fork is a hash that several records name. Of its ways the one with most records below goes on as the branch, the others are branches of their own (ties go to the least hash of their ends). A
chain's first record names no hash ("start"), or one that no record has ("lost": what was before is missing).
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from auditarium.functions.model import NO_HASH
from auditarium.functions.session import shared_dir

SPAN = 4096  #: sequences that are laid together
_NAMED = pa.schema([("before", pa.binary()), ("hashes", pa.list_(pa.binary())), ("sequences", pa.list_(pa.int64()))])


def _table(df: DataFrame, name: str) -> DataFrame:
    path = shared_dir(df.sparkSession, name)
    df.write.parquet(path, compression="zstd")
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _packed(digest: Column) -> Column:
    """The 32 bytes of a SHA-256; any other text as more bytes than that."""
    return F.when(digest.rlike("^[0-9a-f]{64}$"), F.unhex(digest)).otherwise(F.concat(digest.cast("binary"), F.lit(b"\xff" * 33)))


def _text(packed: Column) -> Column:
    return F.when(F.octet_length(packed) == 32, F.lower(F.hex(packed))).otherwise(F.substring(packed, F.lit(1), F.octet_length(packed) - 33).cast("string"))


def _linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs within each batch of part, sequence, hash, prev_hash: each record goes on the run of the one that it names if that stands before it in its part and no other names that."""
    for batch in batches:
        part, sequence, own, prev = (c.to_pylist() if c.null_count else c.to_numpy(zero_copy_only=False).tolist() for c in batch.columns)
        known: dict[tuple, int] = {}
        for k, name in enumerate(zip(part, own, strict=True)):
            at = known.get(name)
            if at is None or min(k, at, key=lambda x: (sequence[x] is not None, sequence[x] or 0, prev[x] or b"")) == k:
                known[name] = k
        kept = sorted(known.values())
        ahead = [known.get((part[k], prev[k])) if prev[k] is not None else None for k in kept]
        ahead = [at if at is not None and at < k else None for k, at in zip(kept, ahead, strict=True)]
        named, run, runs = Counter(ahead), {}, []
        for k, at in zip(kept, ahead, strict=True):
            if at is None or named[at] > 1:
                run[k] = []
                runs.append(run[k])
            else:
                run[k] = run[at]
            run[k].append(k)
        rows = [[prev[x[0]] for x in runs], [[own[k] for k in x] for x in runs], [[sequence[k] for k in x] for x in runs]]
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(rows, _NAMED.types, strict=True)], schema=_NAMED)


def runs(rec: DataFrame, part: str = "path", order: str = "offset") -> DataFrame:
    """id, last (hashes of its first and last record), before (the hash that the first one names), n, first_sequence, last_sequence of each run. rec: sequence, hash, prev_hash, and what part and order (the records
    that lie together, and how) are made of; a hash that occurs twice (a record that was found twice) counts once, with the least of its sequences."""
    rows = rec.withColumns({c: _packed(F.col(c)) for c in ("hash", "prev_hash")}).repartition(F.expr(part)).sortWithinPartitions(F.expr(part), F.expr(order))
    rows = rows.select(F.expr(part).alias("part"), "sequence", "hash", "prev_hash")
    span = _table(rows.mapInArrow(_linked, "before binary, hashes array<binary>, sequences array<long>").withColumn("run", F.monotonically_increasing_id()), "spans")

    # 64 bits of each hash tell all that may be named from elsewhere, or be there twice; a run that is cut without need is only two
    member = span.select("run", F.size("hashes").alias("n"), F.posexplode("hashes").alias("place", "hash")).select(F.xxhash64("hash").alias("mark"), "run", "place", (F.col("place") + 1 < F.col("n")).alias("inner"))
    named = span.select(F.xxhash64("before").alias("mark")).distinct().select("mark", F.lit(None).cast("long").alias("run"), F.lit(0).alias("place"), F.lit(False).alias("inner"))
    same = Window.partitionBy("mark")
    met = member.unionByName(named).withColumn("copies", F.count("run").over(same)).withColumn("names", F.count_if(F.col("run").isNull()).over(same))
    met = met.where(F.col("run").isNotNull() & ((F.col("copies") > 1) | (F.col("names") > 0) & F.col("inner")))
    at = F.when(F.col("copies") > 1, F.array(F.col("place"), F.col("place") + 1)).otherwise(F.array(F.col("place") + 1))
    cuts = _table(met.groupBy("run").agg(F.flatten(F.collect_list(at)).alias("cuts")), "cuts")

    begins = F.array_sort(F.array_distinct(F.concat(F.array(F.lit(0)), F.coalesce("cuts", F.array().cast("array<int>")))))
    pieces = span.join(cuts, "run", "left").withColumn("n", F.size("hashes")).withColumn("begins", F.filter(begins, lambda k: k < F.size("hashes")))

    def piece(begin: Column, k: Column) -> Column:
        end = F.coalesce(F.get("begins", k + 1), F.col("n"))
        before = F.when(begin == 0, F.col("before")).otherwise(F.get("hashes", begin - 1))
        return F.struct(F.get("hashes", begin).alias("id"), F.get("hashes", end - 1).alias("last"), before.alias("before"), (end - begin).cast("long").alias("n"), F.get("sequences", begin).alias("first_sequence"), F.get("sequences", end - 1).alias("last_sequence"))

    pieces = pieces.select(F.inline(F.transform("begins", piece)))
    pieces = pieces.withColumn("copy", F.row_number().over(Window.partitionBy("id").orderBy("first_sequence", "before"))).where("copy = 1")
    return pieces.select(_text(F.col("id")).alias("id"), _text(F.col("last")).alias("last"), _text(F.col("before")).alias("before"), "n", "first_sequence", "last_sequence")


def ranked(run: DataFrame) -> DataFrame:
    """runs with top (the first run of the chain), above (records before the run), depth (records on the longest way down from it, its own too) and tip (the last hash of it).

    Runs that name each other in a ring (hashes can't, forged numbers may) end with themselves as top of the round in which the ring closes; rounds are bounded by the number of runs."""
    parent = run.select(F.col("last").alias("before"), F.col("id").alias("parent"), F.col("n").alias("parent_n"))
    rows = run.join(parent, "before", "left").withColumn("top", F.coalesce("parent", "id")).withColumn("above", F.coalesce("parent_n", F.lit(0)))
    rows = _table(rows.withColumn("best", F.struct(F.col("n").alias("depth"), F.col("last").alias("tip"))), "ranks")
    left = max(1, rows.count().bit_length() + 1)
    moving = True
    while moving and left:
        left -= 1
        here = rows.select(F.col("id").alias("top"), F.col("top").alias("further"), F.col("above").alias("more"))
        below = rows.where("top <> id").groupBy(F.col("top").alias("id")).agg(F.max(F.struct((F.col("above") + F.col("best.depth")).alias("depth"), _least("best.tip").alias("least"))).alias("found"))
        rows = rows.join(here, "top").join(below, "id", "left")
        found = F.struct(F.col("found.depth").alias("depth"), _least("found.least").alias("tip"))
        deeper = F.col("found").isNotNull() & ((found["depth"] > F.col("best.depth")) | (found["depth"] == F.col("best.depth")) & (found["tip"] < F.col("best.tip")))
        rows = rows.withColumn("best", F.when(deeper, found).otherwise(F.col("best"))).withColumn("moved", (F.col("further") != F.col("top")) | deeper)
        rows = rows.withColumn("above", F.when(F.col("top") == F.col("id"), F.lit(0)).otherwise(F.col("above") + F.col("more"))).withColumn("top", F.col("further"))
        rows = _table(rows.drop("further", "more", "found"), "ranks")
        moving = bool(rows.where("moved").limit(1).count())
        rows = rows.drop("moved")
    return rows.select(*run.columns, "parent", "top", "above", F.col("best.depth").alias("depth"), F.col("best.tip").alias("tip"))


def _least(column: str):
    """Hexadecimal digits turned over, so that the greatest is the least; twice is once."""
    return F.translate(column, "0123456789abcdef", "fedcba9876543210")


def branches(rec: DataFrame) -> DataFrame:
    """One row for each branch: chain (the hash of its chain's first record), kind (start, lost), main, first_sequence, last_sequence, records (of the branch alone), tip (its last hash), fork_sequence (of the record
    that it leaves another branch at; null of main ones), before (the hash that its first record names)."""
    rows = _table(ranked(runs(rec, f"sequence div {SPAN}", "sequence")), "ranked")
    first = rows.where("top = id").select(F.col("id").alias("top"), F.col("before").alias("chain_before"), F.col("tip").alias("main_tip"))
    forks = rows.select(F.col("id").alias("parent"), F.col("last_sequence").alias("fork_sequence"))
    head, end = F.min_by(F.struct("before", "first_sequence", "parent"), "above"), F.max_by(F.struct("last", "last_sequence"), "above")
    grouped = rows.join(first, "top").groupBy("top", "tip").agg(head.alias("head"), end.alias("end"), F.sum("n").alias("records"), F.first("chain_before").alias("chain_before"), F.first(F.col("main_tip") == F.col("tip")).alias("main"))
    return grouped.withColumn("parent", F.col("head.parent")).join(forks, "parent", "left").select(
        F.col("top").alias("chain"), F.when(F.col("chain_before") == NO_HASH, "start").otherwise("lost").alias("kind"), "main", F.col("head.first_sequence").alias("first_sequence"), F.col("end.last_sequence").alias("last_sequence"), "records",
        F.col("end.last").alias("tip"), "fork_sequence", F.col("head.before").alias("before"),
    )


def lost(branch: DataFrame) -> DataFrame:
    """Chains whose beginning is missing: the hash that is missing, the sequence behind it, and the records and branches that hang on it."""
    return branch.where("kind = 'lost'").groupBy("chain").agg(F.max(F.when(F.col("main"), F.col("before"))).alias("missing"), F.min("first_sequence").alias("sequence"), F.sum("records").alias("records"), F.count("*").alias("branches"))
