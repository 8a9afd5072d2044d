"""Exports of events, and how their fields are written as text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditarium.functions.model import level_code

FORMATS = ("json", "jsonl", "csv", "text")
COLUMNS = ("Timestamp", "Level", "MessageTemplate", "RenderedMessage", "Properties", "Exception")


def render(template: Column, props: Column) -> Column:
    """template with {Name} (or {Name:format}) replaced by the property's text; unknown names stay. One pass: what a value holds is never filled again."""
    parts = F.split(template, r"(?=\{)|(?<=\})")  # holes are parts of their own; a part that is none stays
    name = lambda part: F.regexp_extract(part, r"^\{([^{}:]*)(?::[^{}]*)?\}$", 1)
    fill = F.array_join(F.transform(parts, lambda part: F.coalesce(F.when(part.startswith("{"), F.element_at(props, name(part))), part)), "")
    return F.when(props.isNull(), template).otherwise(fill)


def sorted_json(props: Column) -> Column:
    """A map as JSON with its keys in order."""
    return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(props))))


def rfc3339(ts: Column) -> Column:
    """Time as text, without trailing zeros of the fraction."""
    return F.concat(F.regexp_replace(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), r"\.?0+$", ""), F.lit("Z"))


def table(ev: DataFrame) -> DataFrame:
    """The six columns of an export. ev: ts, level, message_template, properties (a map), exception."""
    return ev.select(rfc3339(F.col("ts")).alias("Timestamp"), level_code(F.col("level")).alias("Level"), F.col("message_template").alias("MessageTemplate"), render(F.col("message_template"), F.col("properties")).alias("RenderedMessage"), sorted_json(F.col("properties")).alias("Properties"), F.coalesce("exception", F.lit("")).alias("Exception"))


def replay_table(ev: DataFrame) -> DataFrame:
    """The four columns of a replay as CSV."""
    return table(ev).select("Timestamp", "Level", F.col("RenderedMessage").alias("Message"), "Properties")


def lines(ev: DataFrame) -> DataFrame:
    """A line of text for each event: time, level, message."""
    t = table(ev)
    return t.select(F.format_string("[%s] %s: %s", "Timestamp", "Level", "RenderedMessage").alias("value"))


def export(ev: DataFrame, path: str, fmt: str = "jsonl", compression: str = "none") -> None:
    """Writes events as JSON lines, a JSON array (each file one array), CSV with a header, or text."""
    if fmt not in FORMATS:
        raise ValueError(f"no format {fmt}")
    if fmt == "text":
        lines(ev).write.option("compression", compression).text(path)
    elif fmt == "csv":
        table(ev).write.option("header", True).option("compression", compression).csv(path)
    elif fmt == "jsonl":
        table(ev).write.option("compression", compression).json(path)
    else:
        def arrays(batches):
            import pandas as pd

            held = None  # a row is written when the one behind it is known: the last has no comma
            begun = False
            for pdf in batches:
                for value in pdf["value"]:
                    if held is not None:
                        yield pd.DataFrame({"value": [("" if begun else "[\n") + held + ","]})
                        begun = True
                    held = value
            if held is not None:
                yield pd.DataFrame({"value": [("" if begun else "[\n") + held + "\n]"]})

        table(ev).select(F.to_json(F.struct(*COLUMNS)).alias("value")).mapInPandas(arrays, "value string").write.option("compression", compression).text(path)


#: JSON writers cut times to milliseconds otherwise.
_MICROS = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"


def write_days(ev: DataFrame, path: str) -> None:
    """JSON lines by year, month, day and hour, gzipped: the layout of object stores."""
    ts = F.col("ts")
    ev.withColumns({"year": F.year(ts), "month": F.month(ts), "day": F.dayofmonth(ts), "hour": F.hour(ts)}).write.partitionBy("year", "month", "day", "hour").option("compression", "gzip").options(timestampNTZFormat=_MICROS, timestampFormat=_MICROS + "XXX").mode("append").json(path)


def write_backend(ev: DataFrame, path: str, shadow: str | None = None, compression: str = "none") -> None:
    """Events as a file backend's JSON lines; with shadow, each file is copied there by the tasks, under its name."""
    from auditarium.sources.wal import files, store_of

    ev.write.option("compression", compression).options(timestampNTZFormat=_MICROS, timestampFormat=_MICROS + "XXX").mode("append").json(path)
    if shadow is None:
        return
    spark = ev.sparkSession
    names = spark.createDataFrame([(p,) for p, _ in files(path, "")], "name string").repartition("name")

    def copied(batches):
        (store, _), (other, base) = store_of(path), store_of(shadow)
        other.create_dir(base, recursive=True)
        for batch in batches:
            for name in batch.column("name").to_pylist():
                with store.open_input_stream(name) as src, other.open_output_stream(f"{base}/{name.rpartition('/')[2]}") as out:
                    while block := src.read(1 << 20):
                        out.write(block)
            yield batch

    names.mapInArrow(copied, "name string").count()


def export_array(rows: DataFrame, path: str, order: str = "sequence", pretty: bool = False) -> None:
    """Rows as one JSON array over all parts, in order of a column whose values differ: the parts, one behind the other by name, are the array. No task has all rows."""
    ends = rows.agg(F.min(order).alias("__first"), F.max(order).alias("__last"))
    body = F.to_json(F.struct(*rows.columns), {"pretty": "true"} if pretty else {})
    line = F.concat(F.when(F.col(order) == F.col("__first"), "[").otherwise(""), body, F.when(F.col(order) == F.col("__last"), "]").otherwise(","))
    dealt = rows.repartitionByRange(order).sortWithinPartitions(order)
    dealt.crossJoin(F.broadcast(ends)).select(line.alias("value")).write.text(path)


def manifest(spark, path: str) -> DataFrame:
    """name, size, records, first and last ts, and md5_b64 of each object that write_days wrote: what stores keep as its metadata."""
    objects = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.json*").load(path)
    sums = objects.select(_name("path").alias("name"), F.col("length").alias("size"), F.base64(F.unhex(F.md5("content"))).alias("md5_b64"))
    events = spark.read.schema("ts timestamp_ntz").option("recursiveFileLookup", True).option("pathGlobFilter", "*.json*").json(path)
    counts = events.groupBy(_name(F.input_file_name()).alias("name")).agg(F.count("*").alias("records"), F.min("ts").alias("first_time"), F.max("ts").alias("last_time"))
    return sums.join(counts, "name", "left").withColumn("records", F.coalesce("records", F.lit(0)))


def _name(path) -> Column:
    """An object's path from its year on."""
    return F.regexp_extract(path, r"(year=[^?]*)$", 1)


def read_days(spark, path: str, schema: str, start=None, end=None) -> DataFrame:
    """What write_days wrote, between start and end (exclusive, as backends do); days outside are not read."""
    from auditarium.operators.replay import replay

    df = spark.read.schema(f"{schema}, year int, month int, day int, hour int").json(path)
    day = F.col("year") * 10000 + F.col("month") * 100 + F.col("day")
    if start is not None:
        df = df.where(day >= int(str(start)[:10].replace("-", "")))
    if end is not None:
        df = df.where(day <= int(str(end)[:10].replace("-", "")))
    return replay(df, start, end, "exclusive").drop("year", "month", "day", "hour")


class Unsupported(NotImplementedError):
    """A backend that can be written but not read."""


#: What each kind of backend can do.
BACKENDS = {"filesystem": {"read", "write"}, "s3": {"read", "write"}, "azure": {"write"}, "gcs": {"write"}}


def backend(kind: str, need: str) -> str:
    if kind not in BACKENDS:
        raise ValueError(f"no backend {kind}")
    if need not in BACKENDS[kind]:
        raise Unsupported(f"{kind} can't {need}")
    return kind
