"""The run log: JSON lines of runs and events, its report and its tail."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from silt.functions.scalars import level_rank
from silt.schemas import RUN_RECORD

TAIL = 20
GENERATIONS = 5
ROTATE_BYTES = 8 << 20
#: More lines than any section of the printed report can have.
SECTION = 1 << 40
OWN_FIELDS = ["t", "lvl", "type", "msg"]


def scan(spark: SparkSession, path: str) -> DataFrame:
    """Records of a log's files: RUN_RECORD's columns, ``msg``, ``fields``, ``generation``.

    Lines that are no record lose themselves alone. A file's generation is the number
    that ends its name, 0 for the live file; the oldest records have the highest.
    """
    lines = spark.read.text(path).select("value", F.col("_metadata.file_name").alias("file"))
    return parse(lines.withColumn("generation", F.coalesce(F.try_to_number(F.regexp_extract("file", r"\.([0-9]{1,9})$", 1), F.lit("999999999")).cast("int"), F.lit(0))))


def parse(lines: DataFrame, value: str = "value") -> DataFrame:
    """Lines of JSON as records; what can't be read, or has no time or kind, is skipped."""
    schema = T.StructType([*RUN_RECORD.fields, T.StructField("msg", T.StringType())])
    kept = [c for c in lines.columns if c not in (value, "file")]
    rows = lines.select(*kept, F.from_json(value, schema, {"mode": "PERMISSIVE"}).alias("r"), F.from_json(value, "map<string,string>").alias("m"))
    rows = rows.where("r.t is not null and r.lvl is not null and r.type in ('run', 'event')")
    fields = F.when(F.col("r.type") == "event", F.map_filter("m", lambda k, _: ~k.isin(*OWN_FIELDS)))
    return rows.select(*kept, "r.*", fields.alias("fields"))


def lines(records: DataFrame, threshold: str = "info") -> DataFrame:
    """Records as JSON lines, absent where null; those above the threshold are dropped."""
    shown = records.where(level_rank(F.col("lvl")) <= level_rank(F.lit(threshold)))
    return shown.select(F.to_json(F.struct(*records.columns), {"ignoreNullFields": "true"}).alias("value"))


def append(records: DataFrame, path: str, threshold: str = "info") -> None:
    lines(records, threshold).write.mode("append").text(path)


def runs(records: DataFrame, since: str | Column | None = None, cmd: str | None = None) -> DataFrame:
    """Run records at or after ``since`` (RFC 3339, so text order is time order) of one command."""
    out = records.where(F.col("type") == "run")
    if since is not None:
        out = out.where(F.col("t") >= since)
    return out if cmd is None else out.where(F.col("cmd") == cmd)


def totals(run_records: DataFrame) -> DataFrame:
    """One row: runs, bytes, tokens in and out, passthroughs."""
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    return run_records.agg(
        F.count("*").alias("runs"),
        F.coalesce(F.sum(zero("out_bytes") + zero("err_bytes")), F.lit(0)).alias("bytes"),
        F.coalesce(F.sum(zero("in_tok")), F.lit(0)).alias("in_tok"),
        F.coalesce(F.sum(zero("out_tok")), F.lit(0)).alias("out_tok"),
        F.count_if("passthrough").alias("passthrough"),
    )


def report(run_records: DataFrame) -> DataFrame:
    """Totals with the share passed through and the reduction; null where nothing is."""
    t = totals(run_records)
    share = F.when(F.col("runs") > 0, 100.0 * F.col("passthrough") / F.col("runs"))
    less = F.when(F.col("in_tok") > 0, 100.0 - 100.0 * F.col("out_tok") / F.col("in_tok"))
    return t.withColumn("passthrough_pct", F.bround(share, 1)).withColumn("reduction_pct", F.bround(less, 1))


def by_command(run_records: DataFrame) -> DataFrame:
    """Runs of each command, most first, then by name."""
    return run_records.groupBy("cmd").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "cmd")


def by_reason(run_records: DataFrame) -> DataFrame:
    """Why runs were passed through, most first, then by name."""
    return run_records.where("passthrough and reason is not null").groupBy("reason").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "reason")


def printed(run_records: DataFrame) -> DataFrame:
    """The report as numbered lines of text: (at, line)."""
    r, pad = report(run_records), lambda c: F.lpad(F.col(c).cast("string"), 10, " ")
    share = F.format_string("  (%s%%)", F.bround(100.0 * F.col("passthrough") / F.col("runs"), 0).cast("int").cast("string"))
    some = F.array(
        F.concat(F.rpad(F.lit("runs"), 18, " "), pad("runs")),
        F.concat(F.rpad(F.lit("passthrough"), 18, " "), pad("passthrough"), share),
        F.concat(F.rpad(F.lit("captured bytes"), 18, " "), pad("bytes")),
    )
    tokens = F.array(
        F.concat(F.rpad(F.lit("input tokens"), 18, " "), pad("in_tok")),
        F.concat(F.rpad(F.lit("output tokens"), 18, " "), pad("out_tok")),
        F.concat(F.rpad(F.lit("reduction"), 18, " "), F.lpad(F.format_number("reduction_pct", 1), 9, " "), F.lit("%  (output tokens only)")),
    )
    head = F.when(F.col("runs") == 0, F.array(F.lit("no runs recorded"))).when(F.col("in_tok") > 0, F.concat(some, tokens)).otherwise(some)
    lines = r.select(F.posexplode(head).alias("at", "line")).select(F.col("at").cast("long").alias("at"), "line")
    parts = [lines]
    for n, (title, rows, key, width) in enumerate((("by command", by_command(run_records), "cmd", 14), ("passthrough reasons", by_reason(run_records), "reason", 22))):
        named = rows.select(F.col("n"), F.concat(F.lit("  "), F.rpad(F.col(key), width, " "), F.lpad(F.col("n").cast("string"), 8, " ")).alias("line"), F.col(key).alias("key"))
        # a section's lines are numbered on from its own multiple of SECTION
        body = named.select((F.row_number().over(Window.orderBy(F.desc("n"), "key")) + F.lit(SECTION * (n + 1))).alias("at"), "line")
        titled = body.limit(1).select(F.lit(SECTION * (n + 1)).alias("at"), F.lit(title).alias("line"))
        parts += [titled, body]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.orderBy("at")


def at_level(records: DataFrame, wanted: str) -> DataFrame:
    """Records no more verbose than ``wanted``."""
    return records.where(level_rank(F.col("lvl")) <= level_rank(F.lit(wanted)))


def tail(records: DataFrame, order: list[str], n: int = TAIL) -> DataFrame:
    """The last n records, in order."""
    return records.orderBy(*(F.desc(c) for c in order)).limit(n).orderBy(*order)


def keep_generations(files: DataFrame, n: int = GENERATIONS) -> DataFrame:
    """The newest n rotated files of each log (columns log, generation; 1 is the newest)."""
    place = F.row_number().over(Window.partitionBy("log").orderBy("generation"))
    return files.withColumn("_place", place).where(F.col("_place") <= n).drop("_place")


def rotation(files: DataFrame, max_bytes: int = ROTATE_BYTES, n: int = GENERATIONS) -> DataFrame:
    """Every log file (log, generation, bytes; 0 is the live one) with the generation it goes to.

    A log rotates once its live file is over ``max_bytes``: each generation moves up by one,
    and what passes ``n`` goes (null). All other files stay as they are.
    """
    live = F.max(F.when(F.col("generation") == 0, F.col("bytes"))).over(Window.partitionBy("log"))
    up = F.when(F.col("generation") < n, F.col("generation") + 1)
    return files.withColumn("_live", live).withColumn("goes_to", F.when(F.col("_live") > max_bytes, up).otherwise(F.col("generation"))).drop("_live")


def percentiles(values: DataFrame, key: list[str], value: str, shares: list[float]) -> DataFrame:
    """Exact nearest-rank percentiles by key: the value of rank floor((n - 1) q).

    Ranks are counted in a window over the key, so no group is ever held as one array.
    """
    w = Window.partitionBy(*key)
    ranked = values.select(*key, F.col(value).alias("v"), F.row_number().over(w.orderBy(value)).alias("at"), F.count("*").over(w).alias("n"))
    picks = [F.max(F.when(F.col("at") == F.floor((F.col("n") - 1) * F.lit(q)) + 1, F.col("v"))).alias(f"p{round(100 * q)}") for q in shares]
    return ranked.groupBy(*key).agg(*picks)
