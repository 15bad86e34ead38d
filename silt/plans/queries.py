"""Every operator as a query over the given tables, with its DuckDB SQL beside it."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from silt.functions import scalars as C
from silt.functions import text as T
from silt.operators import lines as L
from silt.operators import log as G
from silt.operators import measure as M
from silt.operators import planner as P
from silt.operators import render as R
from silt.operators import stages as S
from silt.operators import store as K
from silt.plans import oracle as O
from silt.plans import pipeline as PL
from silt.sources import capture as CP
from silt.sources import streams as ST
from silt.streaming import reports as RP

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}

ESC = chr(27)


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its function's name."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = sql
        return f

    return add


def events_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ST.from_events(ST.table(spark, sf_dir, "events"))


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the folder that driver and executors share."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    return f"{folder.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def document_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.split_lines(ST.from_text(ST.table(spark, sf_dir, "documents"), "doc_id", "text"))


def joined(blocks: DataFrame) -> DataFrame:
    return blocks.withColumn("body", S.block_text())


# -- lines and scalars -----------------------------------------------------------------


@query(f"WITH {O.DOCUMENTS}, {O.lines()} SELECT run_id, origin, text FROM lines")
def split_lines(spark, sf_dir):
    return document_lines(spark, sf_dir).select("run_id", "origin", "text")


@query(f"WITH {O.DOCUMENTS}, {O.lines()} SELECT run_id, count(*) AS lines, count(*) FILTER ({O.blank('text')}) AS blank, count(*) FILTER ({O.progress('text')}) AS progress, sum({O.tokens('text')})::BIGINT AS tokens FROM lines GROUP BY run_id")
def line_counts(spark, sf_dir):
    t = F.col("text")
    return document_lines(spark, sf_dir).groupBy("run_id").agg(F.count("*").alias("lines"), F.count_if(T.is_blank(t)).alias("blank"), F.count_if(T.is_progress(t)).alias("progress"), F.sum(T.token_estimate(t)).alias("tokens"))


_VARIED = f"WITH {O.DOCUMENTS}, {O.lines()}, v AS (SELECT run_id, origin, CASE origin % 7 WHEN 0 THEN 'Compiling ' || text WHEN 1 THEN length(text) || '% ' || 'done' WHEN 2 THEN text || ' 42%' WHEN 3 THEN repeat('#', length(text) % 12) || '>' WHEN 4 THEN '⠋ ' || text WHEN 5 THEN '  [' || (origin % 90) || '.5%] of 100 eta' ELSE text END AS text FROM lines)"


@query(f"{_VARIED} SELECT run_id, origin, {O.progress('text')} AS progress FROM v")
def is_progress_lines(spark, sf_dir):
    t, n = F.col("text"), F.col("origin")
    varied = (
        F.when(n % 7 == 0, F.concat(F.lit("Compiling "), t))
        .when(n % 7 == 1, F.concat(F.length(t).cast("string"), F.lit("% done")))
        .when(n % 7 == 2, F.concat(t, F.lit(" 42%")))
        .when(n % 7 == 3, F.concat(F.repeat(F.lit("#"), F.length(t) % 12), F.lit(">")))
        .when(n % 7 == 4, F.concat(F.lit("⠋ "), t))
        .when(n % 7 == 5, F.concat(F.lit("  ["), (n % 90).cast("string"), F.lit(".5%] of 100 eta")))
        .otherwise(t)
    )
    return document_lines(spark, sf_dir).select("run_id", "origin", T.is_progress(varied).alias("progress"))


_RAW_SQL = "chr(27) || '[1;3' || (origin % 8) || 'm' || text || chr(27) || '[0m' || chr(27) || ']0;title' || CASE WHEN origin % 2 = 0 THEN chr(7) ELSE chr(27) || chr(92) END || 'tail' || chr(27) || 'M' || chr(8) || chr(27) || '[3'"


@query(f"WITH {O.DOCUMENTS}, {O.lines()} SELECT run_id, origin, {O.strip_escapes(_RAW_SQL)} AS text FROM lines")
def strip_escapes(spark, sf_dir):
    n = F.col("origin")
    raw = F.concat(F.lit(f"{ESC}[1;3"), (n % 8).cast("string"), F.lit("m"), F.col("text"), F.lit(f"{ESC}[0m{ESC}]0;title"), F.when(n % 2 == 0, chr(7)).otherwise(f"{ESC}\\"), F.lit(f"tail{ESC}M\b{ESC}[3"))
    return document_lines(spark, sf_dir).select("run_id", "origin", T.strip_escapes(raw).alias("text"))


@query(f"WITH {O.DOCUMENTS}, {O.lines()} SELECT run_id, origin, {O.overwrite('replace(text, chr(32), chr(13))')} AS text FROM lines")
def carriage_overwrite(spark, sf_dir):
    return document_lines(spark, sf_dir).select("run_id", "origin", T.apply_overwrites(F.translate("text", " ", "\r")).alias("text"))


_SHOWN_SQL = "CASE origin % 4 WHEN 0 THEN chr(27) || '[3' || (origin % 8) || 'm' || text || chr(27) || '[0m' WHEN 1 THEN text || chr(13) || substr(text, 1, 4) || 'done' WHEN 2 THEN 'wait' || chr(27) || '[K' || chr(13) || text || chr(13) ELSE text END"


@query(f"WITH {O.DOCUMENTS}, {O.lines()}, v AS (SELECT run_id, origin, {_SHOWN_SQL} AS text FROM lines) SELECT run_id, origin, {O.clean_line('text')} AS text FROM v")
def clean_lines(spark, sf_dir):
    """Lines with escapes, with carriage returns, with both and with neither."""
    n, t = F.col("origin") % 4, F.col("text")
    raw = (
        F.when(n == 0, F.concat(F.lit(f"{ESC}[3"), (F.col("origin") % 8).cast("string"), F.lit("m"), t, F.lit(f"{ESC}[0m")))
        .when(n == 1, F.concat(t, F.lit("\r"), F.substring(t, 1, 4), F.lit("done")))
        .when(n == 2, F.concat(F.lit(f"wait{ESC}[K\r"), t, F.lit("\r")))
        .otherwise(t)
    )
    return document_lines(spark, sf_dir).select("run_id", "origin", T.clean_line(raw).alias("text"))


@query(f"SELECT doc_id, {O.sub('text', '[0-9]+', '#')} AS text FROM documents")
def normalise_digits(spark, sf_dir):
    return ST.table(spark, sf_dir, "documents").select("doc_id", T.normalise_digits(F.col("text")).alias("text"))


@query(f"SELECT doc_id, {O.tokens('text')} AS tokens FROM documents")
def token_estimate(spark, sf_dir):
    return ST.table(spark, sf_dir, "documents").select("doc_id", T.token_estimate(F.col("text")).alias("tokens"))


_SPOKEN = "CASE conv_id % 8 WHEN 0 THEN 'error: ' || text WHEN 1 THEN text || chr(10) || '3 tests failed' WHEN 2 THEN 'warning[x] ' || text WHEN 3 THEN '---' WHEN 4 THEN 'io.error.Exception: ' || text WHEN 5 THEN text || ' (deprecated: yes)' WHEN 6 THEN 'FAILED test_' || turn ELSE text END"


@query(f"""WITH c AS (SELECT conv_id, turn, {_SPOKEN} AS text FROM conversations),
l AS (SELECT *, string_split(text, chr(10)) AS ls FROM c),
f AS (SELECT *, list_filter(ls, lambda x: {O.failing("x")}) AS bad, list_filter(ls, lambda x: {O.warning("x")}) AS warn FROM l)
SELECT conv_id, turn, CASE WHEN len(bad) > 0 THEN CASE WHEN {O.testing("bad[1]")} THEN 'Failure' ELSE 'Error' END WHEN len(warn) > 0 THEN 'Warning' WHEN {O.content("text")} THEN 'Info' ELSE 'Noise' END AS class FROM f""")
def classify_text(spark, sf_dir):
    t, c = F.col("text"), F.col("conv_id") % 8
    spoken = (
        F.when(c == 0, F.concat(F.lit("error: "), t))
        .when(c == 1, F.concat(t, F.lit("\n3 tests failed")))
        .when(c == 2, F.concat(F.lit("warning[x] "), t))
        .when(c == 3, "---")
        .when(c == 4, F.concat(F.lit("io.error.Exception: "), t))
        .when(c == 5, F.concat(t, F.lit(" (deprecated: yes)")))
        .when(c == 6, F.concat(F.lit("FAILED test_"), F.col("turn").cast("string")))
        .otherwise(t)
    )
    return ST.table(spark, sf_dir, "conversations").select("conv_id", "turn", spoken.alias("text")).select("conv_id", "turn", T.classify_text(F.col("text")).alias("class"))


_HASHED = "s_name || chr(0) || s_suppkey || chr(0) || '/work' || chr(0)"


@query(f"""WITH b AS (SELECT s_suppkey, {_HASHED} || 'out ' || s_name || chr(0) || 'err' AS t FROM supplier)
SELECT s_suppkey, lower(printf('%08x', list_reduce(list_prepend({C.HASH_SEED}::BIGINT, list_transform(range(1, length(t) + 1), lambda i: ascii(substr(t, i, 1))::BIGINT)), lambda h, x: (xor(h, x) * {C.HASH_FACTOR}) & {C.MASK}))) AS handle FROM b""")
def content_hash(spark, sf_dir):
    argv = F.array("s_name", F.col("s_suppkey").cast("string"))
    return ST.table(spark, sf_dir, "supplier").select("s_suppkey", C.handle(argv, F.lit("/work"), F.concat(F.lit("out "), "s_name"), F.lit("err")).alias("handle"))


@query("SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS t, strftime(ts - to_seconds(n * CASE u WHEN 'm' THEN 60 WHEN 'h' THEN 3600 WHEN 'd' THEN 86400 WHEN 'w' THEN 604800 END), '%Y-%m-%dT%H:%M:%SZ') AS cutoff FROM (SELECT *, event_id % 50 AS n, substr('mhdwx', (event_id % 5)::INT + 1, 1) AS u FROM events)")
def times(spark, sf_dir):
    unit = F.element_at(F.array(*(F.lit(c) for c in "mhdwx")), (F.col("event_id") % 5 + 1).cast("int"))
    spec = F.concat((F.col("event_id") % 50).cast("string"), unit)
    ts = F.col("ts").cast("timestamp")
    return ST.table(spark, sf_dir, "events").select("event_id", C.rfc3339(ts).alias("t"), C.since_cutoff(spec, ts).alias("cutoff"))


@query("""SELECT p_partkey, list_extract(string_split(replace(p_name, ' ', '/'), '/'), -1) AS base,
  CASE WHEN p_size % 7 = 0 THEN 128 + p_size WHEN p_size % 5 = 0 THEN 1 WHEN p_partkey % 300 > 255 THEN 1 ELSE p_partkey % 300 END::INT AS code,
  regexp_matches(substr('0123456789abcdef', (p_partkey % 16 + 1)::BIGINT, 1) || '12345' || substr('xf', (p_size % 2 + 1)::BIGINT, 1) || 'e', '^[0-9a-f]{8}$') AS is_handle,
  CASE WHEN p_size % 6 < 4 THEN (p_size % 6)::INT END AS level,
  list_position(['off', 'error', 'warn', 'info', 'debug', 'trace'], lower(substr('OffWarninfo', (p_size % 3 * 4)::BIGINT + CASE WHEN p_size % 3 = 0 THEN 1 ELSE 0 END, CASE WHEN p_size % 3 = 0 THEN 3 ELSE 4 END))) - 1 AS rank
FROM part""")
def small_scalars(spark, sf_dir):
    size, key = F.col("p_size"), F.col("p_partkey")
    digit = F.lit("0123456789abcdef").substr((key % 16 + 1).cast("int"), F.lit(1))
    shape = F.concat(digit, F.lit("12345"), F.when(size % 2 == 0, "x").otherwise("f"), F.lit("e"))
    name = F.when(size % 3 == 0, "Off").when(size % 3 == 1, "Warn").otherwise("info")
    signal = F.when(size % 7 == 0, size).cast("int")
    code = F.when(size % 5 == 0, F.lit(None)).otherwise(key % 300).cast("int")
    return ST.table(spark, sf_dir, "part").select("p_partkey", C.basename(F.translate("p_name", " ", "/")).alias("base"), C.exit_code(code, signal).alias("code"), C.is_handle(shape).alias("is_handle"), C.view_level((size % 6).cast("string")).alias("level"), C.level_rank(name).alias("rank"))


# -- blocks, stages and views ----------------------------------------------------------


@query(f"WITH {O.CONVERSATIONS},\n{O.blocks()}\nSELECT run_id, block::BIGINT AS block, first_origin, n_lines FROM b0")
def segment_blocks(spark, sf_dir):
    blocks = PL.parse(ST.from_conversations(ST.table(spark, sf_dir, "conversations")))
    return blocks.select("run_id", "block", F.element_at("lines", 1)["origin"].alias("first_origin"), "n_lines")


@query(f"WITH {O.EVENTS},\n{O.blocks()}\nSELECT run_id, stream, block::BIGINT AS block, n_lines, reason, txt AS body FROM b1")
def dedupe_lines(spark, sf_dir):
    return joined(S.drop_progress(PL.parse(events_log(spark, sf_dir)))).select("run_id", "stream", "block", "n_lines", "reason", "body")


@query(f"WITH {O.EVENTS},\n{O.adjacent()}\nSELECT run_id, stream, block::BIGINT AS block, n_lines, reason, txt AS body FROM b2")
def dedupe_blocks(spark, sf_dir):
    return joined(S.collapse_adjacent(S.drop_progress(PL.parse(events_log(spark, sf_dir))))).select("run_id", "stream", "block", "n_lines", "reason", "body")


@query(f"WITH RECURSIVE {O.EVENTS},\n{O.windows()}\nSELECT run_id, stream, block::BIGINT AS block, n_lines, reason, txt AS body FROM b3")
def dedupe_windows(spark, sf_dir):
    return joined(S.collapse_windows(S.collapse_adjacent(S.drop_progress(PL.parse(events_log(spark, sf_dir)))))).select("run_id", "stream", "block", "n_lines", "reason", "body")


@query(f"WITH {O.EVENTS},\n{O.adjacent()},\n{O.classes('b2')},\n{O.floor()}\nSELECT run_id, stream, block::BIGINT AS block, class, keep1 AS keep FROM b5")
def failure_floor(spark, sf_dir):
    return PL.run(events_log(spark, sf_dir), stages=["dedupe_blocks", "failure_floor"]).select("run_id", "stream", "block", "class", "keep")


@query(f"WITH RECURSIVE {O.EVENTS},\n{O.full()}\nSELECT run_id, stream, block::BIGINT AS block, n_lines, class, keep, reason, txt AS body FROM b6")
def marked_blocks(spark, sf_dir):
    return joined(PL.run(events_log(spark, sf_dir))).select("run_id", "stream", "block", "n_lines", "class", "keep", "reason", "body")


@query(f"WITH RECURSIVE {O.CONVERSATIONS},\n{O.full()}\nSELECT run_id, stream, block::BIGINT AS block, n_lines, class, keep, reason, txt AS body FROM b6")
def marked_conversations(spark, sf_dir):
    streams = ST.from_conversations(ST.table(spark, sf_dir, "conversations"))
    return joined(PL.run(streams)).select("run_id", "stream", "block", "n_lines", "class", "keep", "reason", "body")


@query(O.view(R.SUMMARY))
def render_summary(spark, sf_dir):
    return PL.filter_view(events_log(spark, sf_dir), R.SUMMARY)


@query(O.view(R.ITEMS))
def render_items(spark, sf_dir):
    return PL.filter_view(events_log(spark, sf_dir), R.ITEMS)


@query(O.view(R.DETAIL))
def render_detail(spark, sf_dir):
    return PL.filter_view(events_log(spark, sf_dir), R.DETAIL)


_WITH_HANDLE = O.view(R.DETAIL).replace(f" · {R.REASONS['filtered']}]'", f" · {R.REASONS['filtered']} · {T.TAG} show ' || printf('%08x', run_id) || ' --level 3]'")


@query(_WITH_HANDLE)
def render_with_handle(spark, sf_dir):
    """Markers that say how to get what they stand for."""
    streams = events_log(spark, sf_dir).withColumn("handle", F.lpad(F.lower(F.hex("run_id")), 8, "0"))
    return PL.filter_view(streams)


@query(f"WITH {O.EVENTS} SELECT run_id, stream, {R.RAW}::INT AS level, raw AS body FROM streams")
def render_raw(spark, sf_dir):
    return PL.filter_view(events_log(spark, sf_dir), R.RAW)


@query(f"""WITH RECURSIVE {O.EVENTS},\n{O.full()}
SELECT run_id, stream, sum(n_lines)::BIGINT AS lines, coalesce(sum(n_lines) FILTER (keep <> 'Drop'), 0)::BIGINT AS kept_lines, coalesce(sum(n_lines) FILTER (keep = 'Drop'), 0)::BIGINT AS elided_lines,
  max((class IN ('Error', 'Failure'))::INT) AS has_failure FROM b6 GROUP BY run_id, stream""")
def elision_accounting(spark, sf_dir):
    return R.accounting(PL.run(events_log(spark, sf_dir)))


@query(f"""WITH RECURSIVE {O.EVENTS},\n{O.full()},\n{O.body()},
acc AS (SELECT run_id, stream, sum(n_lines) AS lines, coalesce(sum(n_lines) FILTER (keep <> 'Drop'), 0) AS kept FROM b6 GROUP BY run_id, stream)
SELECT run_id, sum(coalesce(lines, 0))::BIGINT AS in_lines, sum(coalesce(kept, 0))::BIGINT AS out_lines, sum({O.tokens("raw")})::BIGINT AS in_tok, sum({O.tokens("coalesce(body, '')")})::BIGINT AS out_tok
FROM streams LEFT JOIN vw USING (run_id, stream) LEFT JOIN acc USING (run_id, stream) GROUP BY run_id""")
def filter_report(spark, sf_dir):
    streams = events_log(spark, sf_dir)
    return R.report(PL.run(streams), streams)


@query("SELECT doc_id AS run_id, true AS is_text, length(text)::BIGINT AS n FROM documents UNION ALL SELECT p_partkey, false, NULL FROM part")
def decode_streams(spark, sf_dir):
    docs = ST.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("run_id"), F.encode("text", "UTF-8").alias("raw"))
    bad = ST.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("run_id"), F.concat(F.encode("p_name", "UTF-8"), F.lit(b"\xff")).alias("raw"))
    both = ST.decode(docs.unionByName(bad))
    return both.select("run_id", "is_text", F.when(F.col("is_text"), F.length("text")).cast("long").alias("n"))


@query(
    f"""WITH RECURSIVE {O.EVENTS},\n{O.full()},\n{O.body()},
acc AS (SELECT run_id, stream, sum(n_lines) AS lines, coalesce(sum(n_lines) FILTER (keep <> 'Drop'), 0) AS kept FROM b6 GROUP BY run_id, stream)
SELECT run_id, stream, md5(coalesce(body, '')) AS body, coalesce(lines, 0)::BIGINT AS in_lines, coalesce(kept, 0)::BIGINT AS out_lines FROM streams LEFT JOIN vw USING (run_id, stream) LEFT JOIN acc USING (run_id, stream)"""
)
def filter_bytes(spark, sf_dir):
    streams = events_log(spark, sf_dir).withColumn("raw", F.encode("raw", "UTF-8"))
    return PL.filter_bytes(streams).select("run_id", "stream", F.md5("body").alias("body"), "in_lines", "out_lines")


# -- run log ---------------------------------------------------------------------------

_LOG = """runs AS (SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS t, CASE event_type WHEN 'error' THEN 'error' WHEN 'signup' THEN 'warn' WHEN 'view' THEN 'debug' ELSE 'info' END AS lvl,
  event_type AS cmd, CASE WHEN user_id % 4 = 0 THEN NULL ELSE (value * 10)::BIGINT END AS in_tok, CASE WHEN user_id % 4 = 0 THEN NULL ELSE value::BIGINT END AS out_tok, event_id * 3 AS out_bytes, event_id AS err_bytes,
  user_id % 4 = 0 AS passthrough, CASE WHEN user_id % 4 = 0 THEN CASE user_id % 3 WHEN 0 THEN 'mode_raw' WHEN 1 THEN 'interactive' ELSE 'not_found' END END AS reason FROM events)"""


def run_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table as run records."""
    e = ST.table(spark, sf_dir, "events")
    kind, passed = F.col("event_type"), F.col("user_id") % 4 == 0
    return e.select(
        "event_id",
        C.rfc3339(F.col("ts").cast("timestamp")).alias("t"),
        F.when(kind == "error", "error").when(kind == "signup", "warn").when(kind == "view", "debug").otherwise("info").alias("lvl"),
        F.lit("run").alias("type"),
        kind.alias("cmd"),
        F.when(~passed, F.rint(F.col("value") * 10).cast("long")).alias("in_tok"),
        F.when(~passed, F.rint("value").cast("long")).alias("out_tok"),
        (F.col("event_id") * 3).alias("out_bytes"),
        F.col("event_id").alias("err_bytes"),
        passed.alias("passthrough"),
        F.when(passed, F.when(F.col("user_id") % 3 == 0, "mode_raw").when(F.col("user_id") % 3 == 1, "interactive").otherwise("not_found")).alias("reason"),
    )


@query(f"WITH {_LOG} SELECT count(*) AS runs, sum(out_bytes + err_bytes)::BIGINT AS bytes, sum(coalesce(in_tok, 0))::BIGINT AS in_tok, sum(coalesce(out_tok, 0))::BIGINT AS out_tok, count(*) FILTER (passthrough) AS passthrough FROM runs")
def log_totals(spark, sf_dir):
    return G.totals(G.runs(run_log(spark, sf_dir)))


@query(f"WITH {_LOG}, t AS (SELECT count(*) AS runs, sum(out_bytes + err_bytes)::BIGINT AS bytes, sum(coalesce(in_tok, 0))::BIGINT AS in_tok, sum(coalesce(out_tok, 0))::BIGINT AS out_tok, count(*) FILTER (passthrough) AS passthrough FROM runs) SELECT *, round_even(100.0 * passthrough / runs, 1) AS passthrough_pct, round_even(100.0 - 100.0 * out_tok / in_tok, 1) AS reduction_pct FROM t")
def log_report(spark, sf_dir):
    return G.report(G.runs(run_log(spark, sf_dir)))


@query(f"WITH {_LOG} SELECT cmd, count(*) AS n FROM runs GROUP BY cmd")
def log_by_command(spark, sf_dir):
    return G.by_command(G.runs(run_log(spark, sf_dir)))


@query(f"WITH {_LOG} SELECT reason, count(*) AS n FROM runs WHERE passthrough AND reason IS NOT NULL GROUP BY reason")
def log_by_reason(spark, sf_dir):
    return G.by_reason(G.runs(run_log(spark, sf_dir)))


@query(f"""WITH {_LOG}, t AS (SELECT count(*) AS n, sum(out_bytes + err_bytes)::BIGINT AS bytes, sum(coalesce(in_tok, 0))::BIGINT AS a, sum(coalesce(out_tok, 0))::BIGINT AS b, count(*) FILTER (passthrough) AS p FROM runs),
c AS (SELECT cmd AS k, count(*) AS n FROM runs GROUP BY cmd), w AS (SELECT reason AS k, count(*) AS n FROM runs WHERE passthrough AND reason IS NOT NULL GROUP BY reason),
parts AS (SELECT 0 AS s, unnest(range(6)) AS i, unnest([rpad('runs', 18, ' ') || lpad(n::VARCHAR, 10, ' '), rpad('passthrough', 18, ' ') || lpad(p::VARCHAR, 10, ' ') || '  (' || round_even(100.0 * p / n, 0)::INT || '%)', rpad('captured bytes', 18, ' ') || lpad(bytes::VARCHAR, 10, ' '),
  rpad('input tokens', 18, ' ') || lpad(a::VARCHAR, 10, ' '), rpad('output tokens', 18, ' ') || lpad(b::VARCHAR, 10, ' '), rpad('reduction', 18, ' ') || lpad(printf('%.1f', round_even(100.0 - 100.0 * b / a, 1)), 9, ' ') || '%  (output tokens only)']) AS line FROM t
  UNION ALL SELECT 1, 0, 'by command' UNION ALL SELECT 1, row_number() OVER (ORDER BY n DESC, k), '  ' || rpad(k, 14, ' ') || lpad(n::VARCHAR, 8, ' ') FROM c
  UNION ALL SELECT 2, 0, 'passthrough reasons' FROM (SELECT 1 FROM w LIMIT 1) UNION ALL SELECT 2, row_number() OVER (ORDER BY n DESC, k), '  ' || rpad(k, 22, ' ') || lpad(n::VARCHAR, 8, ' ') FROM w)
SELECT row_number() OVER (ORDER BY s, i) AS n, line FROM parts""")
def log_printed(spark, sf_dir):
    """The report as text: its lines in order, numbered on."""
    return G.printed(run_log(spark, sf_dir)).select(F.row_number().over(Window.orderBy("at")).cast("long").alias("n"), "line")


@query(f"WITH {_LOG}, m AS (SELECT max(t) AS last FROM runs), c AS (SELECT strftime(strptime(last, '%Y-%m-%dT%H:%M:%SZ') - INTERVAL 7 DAY, '%Y-%m-%dT%H:%M:%SZ') AS cut FROM m) SELECT cmd, count(*) AS n FROM runs, c WHERE t >= cut AND cmd = 'click' GROUP BY cmd")
def log_since(spark, sf_dir):
    log = run_log(spark, sf_dir)
    last = log.agg(F.to_timestamp(F.max("t")).alias("last")).select(C.since_cutoff(F.lit("7d"), F.col("last"))).first()[0]
    return G.by_command(G.runs(log, since=last, cmd="click"))


@query(f"WITH {_LOG} SELECT event_id, t, lvl FROM runs WHERE lvl IN ('error', 'warn') ORDER BY t DESC, event_id DESC LIMIT {G.TAIL}")
def log_tail(spark, sf_dir):
    return G.tail(G.at_level(run_log(spark, sf_dir), "warn"), ["t", "event_id"]).select("event_id", "t", "lvl")


@query(f"WITH {_LOG} SELECT event_id, t, lvl, cmd, in_tok, out_tok, passthrough, reason FROM runs WHERE lvl <> 'debug'")
def log_round_trip(spark, sf_dir):
    written = G.lines(run_log(spark, sf_dir).withColumn("exit", F.col("event_id").cast("int")))
    noise = spark.createDataFrame([("not json",), ("{}",), ("",)], "value string")
    return G.parse(written.unionByName(noise)).select(F.col("exit").cast("long").alias("event_id"), "t", "lvl", "cmd", "in_tok", "out_tok", "passthrough", "reason")


@query(f"WITH {_LOG} SELECT event_id, 0 AS generation, t, lvl, cmd, in_tok, passthrough FROM runs WHERE lvl <> 'debug'")
def log_scan(spark, sf_dir):
    """A log appended to twice and read from its files."""
    path = scratch(spark, "log")
    records = run_log(spark, sf_dir).withColumn("exit", F.col("event_id").cast("int"))
    G.append(records.where("event_id % 2 = 0"), path)
    G.append(records.where("event_id % 2 = 1"), path)
    return G.scan(spark, path).select(F.col("exit").cast("long").alias("event_id"), "generation", "t", "lvl", "cmd", "in_tok", "passthrough")


@query(f"WITH {_LOG} SELECT date_trunc('hour', strptime(t, '%Y-%m-%dT%H:%M:%SZ'))::VARCHAR AS hour, cmd, count(*) AS runs, sum(coalesce(in_tok, 0))::BIGINT AS in_tok, sum(coalesce(out_tok, 0))::BIGINT AS out_tok, count(*) FILTER (passthrough) AS passthrough FROM runs WHERE lvl <> 'debug' GROUP BY ALL")
def stream_hourly(spark, sf_dir):
    """The hourly report of a log as a stream reads it, its last state written as a table."""
    path, out, state = scratch(spark, "log"), scratch(spark, "hourly"), scratch(spark, "state")
    G.append(run_log(spark, sf_dir), path)
    report = RP.hourly(RP.read_log(spark, path)).writeStream.outputMode("complete").option("checkpointLocation", state)
    report.foreachBatch(lambda df, _: df.write.mode("overwrite").parquet(out)).trigger(availableNow=True).start().awaitTermination()
    rows = spark.read.parquet(out)
    return rows.select(F.date_format("window.start", "yyyy-MM-dd HH:mm:ss").alias("hour"), "cmd", "runs", "in_tok", "out_tok", "passthrough")


_FILES = "f AS (SELECT o_custkey AS log, (row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1)::INT AS generation, (o_totalprice * 100)::BIGINT AS bytes FROM orders)"


def order_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The orders table as log files: a customer's orders are the generations of a log."""
    place = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")) - 1
    return ST.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("log"), place.cast("int").alias("generation"), F.rint(F.col("o_totalprice") * 100).cast("long").alias("bytes"))


@query(f"WITH {_FILES}, l AS (SELECT log, bytes AS live FROM f WHERE generation = 0) SELECT log, generation, bytes, CASE WHEN live <= {G.ROTATE_BYTES} THEN generation WHEN generation < {G.GENERATIONS} THEN generation + 1 END AS goes_to FROM f JOIN l USING (log)")
def log_rotation(spark, sf_dir):
    return G.rotation(order_files(spark, sf_dir)).select("log", "generation", "bytes", "goes_to")


@query(f"WITH {_FILES}, r AS (SELECT *, row_number() OVER (PARTITION BY log ORDER BY generation) AS place FROM f WHERE generation > 0) SELECT log, generation, bytes FROM r WHERE place <= {G.GENERATIONS}")
def log_generations(spark, sf_dir):
    return G.keep_generations(order_files(spark, sf_dir).where("generation > 0")).select("log", "generation", "bytes")


@query("SELECT l_returnflag, quantile_disc(l_quantity, 0.0) AS p0, list_extract(list(l_quantity ORDER BY l_quantity), floor((count(*) - 1) * 0.5)::BIGINT + 1) AS p50, list_extract(list(l_quantity ORDER BY l_quantity), floor((count(*) - 1) * 0.99)::BIGINT + 1) AS p99 FROM lineitem GROUP BY l_returnflag")
def exact_percentiles(spark, sf_dir):
    return G.percentiles(ST.table(spark, sf_dir, "lineitem"), ["l_returnflag"], "l_quantity", [0.0, 0.5, 0.99])


_MEASURED = "m AS (SELECT l_suppkey AS fixture, l_linestatus AS stage, avg(l_quantity) * 10 AS p50 FROM lineitem WHERE l_returnflag <> 'R' GROUP BY ALL), b AS (SELECT l_suppkey AS fixture, l_linestatus AS stage, min(l_partkey)::DOUBLE AS was FROM lineitem WHERE l_linestatus = 'O' GROUP BY ALL)"


@query(f"WITH {_MEASURED}, r AS (SELECT m.*, was, CASE WHEN was > 0 THEN p50 / was END AS ratio FROM m LEFT JOIN b USING (fixture, stage)) SELECT fixture, stage, round(ratio, 6) AS ratio, CASE WHEN was IS NULL THEN 'new' WHEN was < {M.NOISE_US} THEN 'noise' WHEN ratio > {M.REGRESSION} THEN 'regression' ELSE 'ok' END AS verdict FROM r")
def baseline_check(spark, sf_dir):
    rows = ST.table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("fixture"), F.col("l_linestatus").alias("stage"), "l_quantity", "l_partkey", "l_returnflag")
    measured = rows.where("l_returnflag <> 'R'").groupBy("fixture", "stage").agg((F.avg("l_quantity") * 10).alias("p50"))
    baseline = rows.where("stage = 'O'").groupBy("fixture", "stage").agg(F.min("l_partkey").cast("double").alias("p50"))
    return M.against_baseline(measured, baseline).select("fixture", "stage", F.round("ratio", 6).alias("ratio"), "verdict")


_TIMED = "t AS (SELECT l_suppkey AS fixture, [1, 4, 16][l_linenumber] AS scale, sum(l_partkey % 50)::BIGINT AS p50 FROM lineitem WHERE l_linenumber <= 3 GROUP BY ALL)"


@query(f"""WITH {_TIMED}, g AS (SELECT fixture, max(greatest(p50, 1)) FILTER (scale = 1) AS a, max(greatest(p50, 1)) FILTER (scale = 4) AS b, max(greatest(p50, 1)) FILTER (scale = 16) AS c FROM t GROUP BY fixture)
SELECT fixture, round(b / a, 6) AS g4, round(c / b, 6) AS g16, CASE WHEN b / a > {M.GROWTH} OR c / b > {M.GROWTH} THEN 'superlinear' ELSE 'ok' END AS verdict FROM g""")
def growth_check(spark, sf_dir):
    rows = ST.table(spark, sf_dir, "lineitem").where("l_linenumber <= 3")
    scale = F.element_at(F.array(F.lit(1), F.lit(4), F.lit(16)), F.col("l_linenumber").cast("int"))
    times = rows.groupBy(F.col("l_suppkey").alias("fixture"), scale.alias("scale")).agg(F.sum(F.col("l_partkey") % 50).alias("p50"))
    return M.growth(times).select("fixture", F.round("g4", 6).alias("g4"), F.round("g16", 6).alias("g16"), "verdict")


@query("SELECT 'supplier ' || s_suppkey AS fixture, unnest(['parse', 'render', 'total']) AS stage, unnest([s_suppkey, s_nationkey, s_suppkey + s_nationkey])::BIGINT AS p50, unnest([s_suppkey, s_nationkey, s_suppkey + s_nationkey])::BIGINT * 2 AS p99 FROM supplier")
def baseline_read(spark, sf_dir):
    """Baseline files, one for each supplier, read from their JSON."""
    timed = lambda c: F.struct(c.cast("long").alias("p50_us"), (c * 2).cast("long").alias("p99_us"))
    a, b = F.col("s_suppkey"), F.col("s_nationkey")
    fixture = F.struct(a.alias("bytes"), F.create_map(F.lit("parse"), timed(a), F.lit("render"), timed(b)).alias("stages"), timed(a + b).alias("total"))
    files = ST.table(spark, sf_dir, "supplier").select(F.to_json(F.create_map(F.concat(F.lit("supplier "), a.cast("string")), fixture)).alias("value"))
    path = scratch(spark, "baseline")
    files.write.text(path)
    return M.parse_baseline(spark.read.text(path))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 5000 >= 1024 THEN (o_orderkey % 5000) // 1024 || ' KB' ELSE (o_orderkey % 5000) || ' B' END AS size, o_custkey / 1000 AS ms FROM orders")
def sizes_shown(spark, sf_dir):
    n = F.col("o_orderkey") % 5000
    return ST.table(spark, sf_dir, "orders").select("o_orderkey", M.format_bytes(n).alias("size"), M.milliseconds(F.col("o_custkey")).alias("ms"))


# -- store -----------------------------------------------------------------------------

_STORE = "st AS (SELECT o_custkey AS store, lower(printf('%08x', o_orderkey)) AS handle, (o_totalprice * 100)::BIGINT AS bytes, o_orderdate AS modified FROM orders)"


def order_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The orders table as run stores, one for each customer."""
    o = ST.table(spark, sf_dir, "orders")
    return o.select(F.col("o_custkey").alias("store"), F.lpad(F.lower(F.hex("o_orderkey")), 8, "0").alias("handle"), F.rint(F.col("o_totalprice") * 100).cast("long").alias("bytes"), F.col("o_orderdate").alias("modified"))


@query("SELECT s_suppkey, s_name AS out, 1::BIGINT AS copies FROM supplier")
def store_written(spark, sf_dir):
    """Runs written to a store twice, and listed: each is there once."""
    path = scratch(spark, "store")
    rows = ST.table(spark, sf_dir, "supplier").select(F.array("s_name").alias("argv"), F.lit("/work").alias("cwd"), F.encode("s_name", "UTF-8").alias("stdout"), F.lit(b"").alias("stderr"), "s_suppkey")
    K.write(rows.where("s_suppkey % 2 = 0"), path)
    K.write(rows, path)
    K.write(rows, path)
    return spark.read.parquet(path).groupBy("s_suppkey", F.decode("stdout", "UTF-8").alias("out")).agg(F.count("*").alias("copies"))


@query("SELECT lower(printf('%08x', l_orderkey)) AS handle, sum(l_partkey)::BIGINT AS bytes, max(l_shipdate)::VARCHAR AS modified FROM lineitem GROUP BY l_orderkey")
def store_entries(spark, sf_dir):
    files = ST.table(spark, sf_dir, "lineitem").select(F.lpad(F.lower(F.hex("l_orderkey")), 8, "0").alias("handle"), F.col("l_partkey").alias("length"), F.col("l_shipdate").alias("modified"))
    return K.listing(K.entries(files)).withColumn("modified", F.date_format("modified", "yyyy-MM-dd HH:mm:ss"))


@query(f"WITH {_STORE}, r AS (SELECT *, row_number() OVER w - 1 AS place, (sum(bytes) OVER w)::BIGINT AS running FROM st WINDOW w AS (PARTITION BY store ORDER BY modified DESC, handle ROWS UNBOUNDED PRECEDING)) SELECT store, handle, place::INT AS place, running, place >= 8 OR (running > 80000000 AND place > 0) AS evicted FROM r")
def store_retention(spark, sf_dir):
    return K.retention(order_store(spark, sf_dir), 8, 80_000_000, ["store"]).select("store", "handle", "place", "running", "evicted")


@query(f"WITH {_STORE}, r AS (SELECT *, row_number() OVER w - 1 AS place, sum(bytes) OVER w AS running FROM st WINDOW w AS (ORDER BY modified DESC, handle ROWS UNBOUNDED PRECEDING)) SELECT store, handle, bytes FROM r WHERE NOT (place >= {K.MAX_RUNS} OR (running > {K.MAX_BYTES} AND place > 0))")
def store_prune(spark, sf_dir):
    return K.prune(order_store(spark, sf_dir)).select("store", "handle", "bytes")


@query(f"WITH {_LOG}, {_STORE}, l AS (SELECT event_id, lower(printf('%08x', event_id * 2)) AS handle FROM runs) SELECT event_id, l.handle, bytes FROM l LEFT JOIN st ON l.handle = st.handle")
def log_with_store(spark, sf_dir):
    log = run_log(spark, sf_dir).select("event_id", F.lpad(F.lower(F.hex(F.col("event_id") * 2)), 8, "0").alias("handle"))
    return K.logged(log, order_store(spark, sf_dir)).select("event_id", "handle", "bytes")


@query(f"WITH {_LOG}, {_STORE}, l AS (SELECT event_id, lower(printf('%08x', event_id * 2)) AS handle FROM runs) SELECT event_id, handle FROM l WHERE handle NOT IN (SELECT handle FROM st)")
def log_evicted(spark, sf_dir):
    log = run_log(spark, sf_dir).select("event_id", F.lpad(F.lower(F.hex(F.col("event_id") * 2)), 8, "0").alias("handle"))
    return K.evicted(log, order_store(spark, sf_dir)).select("event_id", "handle")


_META = "m AS (SELECT doc_id AS run_id, quality AS exit_code FROM labels)"
_SHOWN = O.DOCUMENTS.replace("0::INT AS exit_code FROM documents", "coalesce(m.exit_code, 1)::INT AS exit_code FROM documents LEFT JOIN m ON m.run_id = doc_id")


@query(f"WITH RECURSIVE {_META}, {_SHOWN},\n{O.full()},\n{O.summary()}\nSELECT run_id, stream, 0::INT AS level, coalesce(body, '') AS body FROM streams LEFT JOIN vw USING (run_id, stream)")
def show_runs(spark, sf_dir):
    meta = ST.table(spark, sf_dir, "labels").select(F.col("doc_id").alias("handle"), F.col("quality").alias("exit_code"))
    streams = ST.from_text(ST.table(spark, sf_dir, "documents"), "doc_id", "text").drop("exit_code")
    return K.show(streams, meta, R.SUMMARY)


# -- command lines ---------------------------------------------------------------------

#: argv, whether a terminal is there, whether raw mode is on, and what should come out.
COMMANDS = [
    (["ls", "-l"], False, False, "capture", "/bin/ls", None),
    (["ls"], False, True, "passthrough", None, "mode_raw"),
    (["/usr/bin/vim", "x"], False, False, "passthrough", None, "interactive"),
    (["python3", "-q"], False, False, "passthrough", None, "interactive"),
    (["python3", "a.py"], False, False, "capture", "/usr/bin/python3", None),
    (["git", "commit", "-m", "x"], True, False, "passthrough", None, "interactive"),
    (["git", "commit", "-m", "x"], False, False, "capture", "/usr/bin/git", None),
    (["git", "add", "-p"], False, False, "passthrough", None, "interactive"),
    (["git", "log", "-p"], False, False, "capture", "/usr/bin/git", None),
    (["git", "-C", "/tmp", "commit"], True, False, "capture", "/usr/bin/git", None),
    (["git", "rebase", "-i"], False, False, "passthrough", None, "interactive"),
    (["git", "status", "--porcelain"], False, False, "passthrough", None, "machine_readable_flag"),
    (["git", "log", "--format=%H"], False, False, "passthrough", None, "machine_readable_flag"),
    (["ls", "--porcelain"], False, False, "capture", "/bin/ls", None),
    (["cargo", "-q", "build"], False, False, "passthrough", None, "machine_readable_flag"),
    (["nothing-here"], False, False, "passthrough", None, "not_found"),
    (["me"], False, False, "passthrough", None, "self_reference"),
    (["git"], True, False, "capture", "/usr/bin/git", None),
]
EXECUTABLES = [("ls", 2, "/usr/bin", False), ("ls", 1, "/bin", False), ("python3", 2, "/usr/bin", False), ("git", 2, "/usr/bin", False), ("cargo", 3, "/opt", False), ("me", 1, "/bin", True), ("ls", 0, "", False)]


@query(
    "SELECT * FROM (VALUES "
    + ", ".join(f"({n}, '{a}', {O.q(p) if p else 'NULL'}, {O.q(r) if r else 'NULL'})" for n, (_, _, _, a, p, r) in enumerate(COMMANDS))
    + ") t(n, action, program, reason)"
)
def plan_commands(spark, sf_dir):
    commands = spark.createDataFrame([(n, *c[:3]) for n, c in enumerate(COMMANDS)], "n int, argv array<string>, tty boolean, raw boolean")
    executables = spark.createDataFrame(EXECUTABLES, "name string, dir_rank int, dir string, own boolean")
    return P.plan(commands, executables).select("n", "action", "program", "reason")


#: Twelve command lines around a word; null stands for the word.
PLANNED: list[list[str | None]] = [["ls", None], ["/usr/bin/vim", None], ["python3", "-q"], ["python3", None], ["git", "commit", "-m", None], ["git", "add", "-p", None], ["git", "rebase", "-i"], ["git", "log", "--format=%H", None], ["ls", "--porcelain"], ["cargo", "-q", None], [None], ["me", None]]
_PLANNED_SQL = "CASE p_partkey % 12 " + " ".join(f"WHEN {n} THEN [{', '.join('w' if x is None else O.q(x) for x in a)}]::VARCHAR[]" for n, a in enumerate(PLANNED)) + " END"
_LISTS = {name: "[" + ", ".join(O.q(x) for x in getattr(P, name)) + "]" for name in ("ALWAYS_INTERACTIVE", "REPLS", "GIT_EDITORS", "GIT_PATCHES", "GIT_PROMPTS", "GIT_MACHINE_FLAGS", "MACHINE_FLAGS")}
_GIT_TAKES = f"(tty AND list_contains({_LISTS['GIT_EDITORS']}, sub)) OR (list_contains({_LISTS['GIT_PATCHES']}, sub) AND list_has_any(args, ['-p', '--patch'])) OR (list_contains({_LISTS['GIT_PROMPTS']}, sub) AND list_has_any(args, ['-i', '--interactive']))"
_GIT_SHOWS = f"list_has_any(args, {_LISTS['GIT_MACHINE_FLAGS']}) OR len(list_filter(args, lambda a: {' OR '.join(f'starts_with(a, {O.q(x)})' for x in P.GIT_MACHINE_PREFIXES)})) > 0"


@query(f"""WITH t AS (SELECT p_partkey, split_part(p_name, ' ', 1) AS w, p_size % 2 = 0 AS tty, p_size % 11 = 0 AS raw FROM part), a AS (SELECT *, {_PLANNED_SQL} AS argv FROM t),
e(name, dir_rank, dir, own) AS (VALUES {", ".join(f"('{n}', {k}, '{d}', {o})" for n, k, d, o in EXECUTABLES)}),
f AS (SELECT name, arg_min(dir || '/' || name, dir_rank) AS place, arg_min(own, dir_rank) AS own FROM e WHERE dir <> '' GROUP BY name),
b AS (SELECT a.*, place, own, list_extract(string_split(argv[1], '/'), -1) AS cmd, argv[2:] AS args, list_filter(argv[2:], lambda x: NOT starts_with(x, '-')) AS words FROM a LEFT JOIN f ON f.name = argv[1]),
c AS (SELECT *, words[1] AS sub FROM b),
d AS (SELECT *, CASE WHEN raw THEN 'mode_raw'
  WHEN list_contains({_LISTS["ALWAYS_INTERACTIVE"]}, cmd) OR (list_contains({_LISTS["REPLS"]}, cmd) AND len(words) = 0) OR (cmd = 'git' AND sub IS NOT NULL AND ({_GIT_TAKES})) THEN 'interactive'
  WHEN list_has_any(args, {_LISTS["MACHINE_FLAGS"]}) OR (cmd = 'git' AND ({_GIT_SHOWS})) THEN 'machine_readable_flag' WHEN place IS NULL THEN 'not_found' WHEN own THEN 'self_reference' END AS reason FROM c)
SELECT p_partkey, CASE WHEN reason IS NULL THEN 'capture' ELSE 'passthrough' END AS action, CASE WHEN reason IS NULL THEN place END AS program, reason FROM d""")
def plan_parts(spark, sf_dir):
    """What to do with command lines made of the part table, by the rules and not by answers."""
    word, argv = F.split("p_name", " ")[0], F.lit(None).cast("array<string>")
    for n, shape in enumerate(PLANNED):
        argv = F.when(F.col("p_partkey") % 12 == n, F.array(*(word if x is None else F.lit(x) for x in shape))).otherwise(argv)
    commands = ST.table(spark, sf_dir, "part").select("p_partkey", argv.alias("argv"), (F.col("p_size") % 2 == 0).alias("tty"), (F.col("p_size") % 11 == 0).alias("raw"))
    executables = spark.createDataFrame(EXECUTABLES, "name string, dir_rank int, dir string, own boolean")
    return P.plan(commands, executables).select("p_partkey", "action", "program", "reason")


@query("SELECT n_name AS name, 'out ' || n_name AS out, 'err' AS err, 3 AS exit_code FROM nation")
def captured_commands(spark, sf_dir):
    """One command for each nation, run where its row is; both streams and its exit code."""
    script = "printf 'out %s' \"$1\"; printf err >&2; exit 3"
    commands = ST.table(spark, sf_dir, "nation").select(F.array(F.lit("/bin/sh"), F.lit("-c"), F.lit(script), F.lit("sh"), F.col("n_name")).alias("argv"), F.lit("/").alias("cwd"))
    return CP.run_commands(commands).select(F.col("argv")[4].alias("name"), F.decode("stdout", "UTF-8").alias("out"), F.decode("stderr", "UTF-8").alias("err"), "exit_code")


# Twelve shapes of a command line around a word; null stands for the word.
ARGVS: list[list[str | None]] = [[], ["-h"], ["--help", None], ["--version"], ["-V"], ["--what", None], ["show", None], ["/usr/bin/git", None, "--all"], ["git"], ["--", None], [None, "--help"], ["-", None]]
_ARGV_SQL = "CASE p_partkey % 12 " + " ".join(f"WHEN {n} THEN [{', '.join('w' if x is None else O.q(x) for x in a)}]::VARCHAR[]" for n, a in enumerate(ARGVS)) + " END"


@query(f"""WITH t AS (SELECT p_partkey, split_part(p_name, ' ', 1) AS w FROM part), a AS (SELECT p_partkey, {_ARGV_SQL} AS argv FROM t)
SELECT p_partkey, CASE WHEN len(argv) = 0 OR argv[1] IN ('-h', '--help') THEN 'help' WHEN argv[1] IN ('-V', '--version') THEN 'version' WHEN argv[1] LIKE '-%' AND argv[1] NOT IN ('-', '--') THEN 'unknown_flag'
  WHEN argv[1] IN ({", ".join(O.q(c) for c in C.SUBCOMMANDS)}) THEN 'subcommand' ELSE 'run' END AS kind,
  coalesce(array_to_string(CASE WHEN list_extract(string_split(argv[1], '/'), -1) = 'git' THEN list_concat(['--no-pager'], argv[2:]) ELSE argv[2:] END, ' '), '') AS child FROM a""")
def invocations(spark, sf_dir):
    """What command lines ask for, and what their child is given."""
    word, argv = F.split("p_name", " ")[0], F.array().cast("array<string>")
    for n, shape in enumerate(ARGVS):
        if shape:
            argv = F.when(F.col("p_partkey") % 12 == n, F.array(*(word if x is None else F.lit(x) for x in shape))).otherwise(argv)
    rows = ST.table(spark, sf_dir, "part").select("p_partkey", argv.alias("argv"))
    child = F.when(F.size("argv") > 0, F.array_join(C.child_args(F.col("argv")), " ")).otherwise("")
    return rows.select("p_partkey", C.invocation(F.col("argv")).alias("kind"), child.alias("child"))


@query("SELECT n_nationkey, n_name AS kept, 1 AS size FROM nation")
def scrubbed_env(spark, sf_dir):
    env = F.create_map(F.lit("SILT_LEVEL"), F.lit("2"), F.lit("HOME"), F.col("n_name"))
    return ST.table(spark, sf_dir, "nation").withColumn("env", C.scrub_env(env, "SILT_")).select("n_nationkey", F.col("env")["HOME"].alias("kept"), F.size("env").alias("size"))

