import datetime

import pytest
from pyspark.sql import functions as F

from silt.functions import scalars as C
from silt.functions import text as T
from silt import config
from silt.operators import log, measure, planner, store
from silt.plans import pipeline, queries
from silt.sources import capture
from silt.streaming import reports


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(("raw", "want"), [("\x1b[1;31mred\x1b[0m", "red"), ("\x1b]0;title\x07x", "x"), ("\x1b]0;t\x1b\\y", "y"), ("a\x1b[3", "a"), ("abc\rX", "Xbc"), ("tab\t\x1bMkept", "tab\tkept"), ("bell\x07", "bell\x07")])
def test_clean_line(spark, raw, want):
    assert one(spark, T.clean_line(F.lit(raw))) == want


@pytest.mark.parametrize(("text", "want"), [("Compiling x", True), ("Compiling", False), ("  45.2% complete", True), ("45% of users left", False), ("[=====>  ]", True), ("[=====>    ]", False), ("========", True), ("⠋ go", True), ("", False), (".%", True)])
def test_is_progress(spark, text, want):
    assert one(spark, T.is_progress(F.lit(text))) is want


@pytest.mark.parametrize(("text", "want"), [("error: x", "Error"), ("3 failed tests", "Failure"), ("3 tests failed", "Info"), ("warning: y", "Warning"), ("errors_total is fine", "Info"), ("***", "Noise"), ("", "Noise"), ("no errors here", "Info"), ("0 errors", "Error"), ("java.io.IOException: z", "Error"), ("ok\nerror[E1]: late", "Error")])
def test_classify_text(spark, text, want):
    assert one(spark, T.classify_text(F.lit(text))) == want


@pytest.mark.parametrize(("text", "want"), [("", 0), ("hello", 1), ("hello world foo", 3), ("/usr/bin", 4), ("a" * 11, 3)])
def test_token_estimate(spark, text, want):
    assert one(spark, T.token_estimate(F.lit(text))) == want


def test_hash_vectors(spark):
    # published 64-bit vectors, low halves
    for text, want in [("", 0x84222325), ("a", 0x8601EC8C), ("foobar", 0xF73967E8)]:
        assert one(spark, C.fnv_low(F.lit(text.encode()))) == want


def test_handle_depends_on_every_part(spark):
    make = lambda argv, cwd, out, err: one(spark, C.handle(F.array(*map(F.lit, argv)), F.lit(cwd), F.lit(out), F.lit(err)))
    seen = {make(["a", "b"], "/", "o", "e"), make(["ab"], "/", "o", "e"), make(["a", "b"], "/x", "o", "e"), make(["a", "b"], "/", "oe", ""), make(["a", "b"], "/", "", "oe")}
    assert len(seen) == 5 and all(len(x) == 8 for x in seen)
    assert make(["a", "b"], "/", "o", "e") in seen


@pytest.mark.parametrize(("spec", "want"), [("7d", 604800), ("30m", 1800), ("2w", 1209600), ("1h", 3600), ("d", None), ("7x", None), ("", None), ("-1d", None)])
def test_since(spark, spec, want):
    assert one(spark, C.since_seconds(F.lit(spec))) == want


def test_rfc3339(spark):
    for text in ["1970-01-01T00:00:00Z", "2000-02-29T12:34:56Z", "2100-03-01T00:00:00Z"]:
        assert one(spark, C.rfc3339(F.to_timestamp(F.lit(text)))) == text


def test_store_round_trip(spark, tmp_path):
    rows = [(["ls"], "/", b"out\n", b"", 0), (["ls"], "/", b"out\n", b"", 0), (["x"], "/", b"\xff", b"bad", 2)]
    runs = spark.createDataFrame(rows, "argv array<string>, cwd string, stdout binary, stderr binary, exit_code int")
    path = str(tmp_path / "store")
    store.write(runs, path)
    got = spark.read.parquet(path).collect()
    assert len(got) == 2
    key = next(r["handle"] for r in got if r["exit_code"] == 2)
    assert bytes(store.read_run(spark, path, key).first()["stdout"]) == b"\xff"
    with pytest.raises(ValueError, match="not a handle"):
        store.read_run(spark, path, "../etc")


def test_store_keeps_distinct_runs(spark, tmp_path, monkeypatch):
    """Two writes of a run give one row; two runs of one short address give two."""
    monkeypatch.setattr(store, "handle", lambda *_: F.lit("00000000"))
    runs = spark.createDataFrame([(["a"], "/", bytearray(b"x"), bytearray(b"")), (["b"], "/", bytearray(b"x"), bytearray(b""))], "argv array<string>, cwd string, stdout binary, stderr binary")
    path = str(tmp_path / "store")
    for _ in range(3):
        store.write(runs, path)
    got = store.read_run(spark, path, "00000000").collect()
    assert sorted(r["argv"][0] for r in got) == ["a", "b"] and len({r["run_key"] for r in got}) == 2


def test_printed_report_of_many_commands(spark):
    df = spark.range(3000).selectExpr("concat('c', id) as cmd", "1L as in_tok", "1L as out_tok", "id % 2 = 0 as passthrough", "concat('r', id) as reason", "1L as out_bytes", "0L as err_bytes")
    lines = [r["line"] for r in log.printed(df).collect()]
    assert lines[6] == "by command" and lines.index("passthrough reasons") == 3007 and len(lines) == 3007 + 1 + 1500


def test_store_folder(spark, tmp_path):
    for name, files in {"0123abcd": {"stdout": b"hi\n", "stderr": b"", "meta.json": b'{"argv":["a"],"cwd":"/","exit_code":3,"extra":1}'}, "stray": {"stdout": b"no"}}.items():
        (tmp_path / name).mkdir()
        for file, data in files.items():
            (tmp_path / name / file).write_bytes(data)
    folder = str(tmp_path)
    assert {(r["run_id"], r["stream"], bytes(r["raw"])) for r in store.read_streams(spark, folder).collect()} == {("0123abcd", "stdout", b"hi\n"), ("0123abcd", "stderr", b"")}
    meta = store.read_meta(spark, folder)
    assert meta.first()["exit_code"] == 3
    text = store.read_streams(spark, folder).withColumn("raw", F.col("raw").cast("string"))
    shown = {r["stream"]: r["body"] for r in store.show(text, meta, 2).collect()}
    assert shown == {"stdout": "hi\n", "stderr": ""}
    assert store.entries(store.read_files(spark, folder)).first()["bytes"] == 3 + 48


def test_missing_meta_counts_as_failed(spark):
    streams = spark.createDataFrame([("aa", "stdout", "x")], "run_id string, stream string, raw string")
    meta = spark.createDataFrame([], "handle string, exit_code int")
    assert store.with_exit_codes(streams, meta).first()["exit_code"] == 1


def test_retention(spark):
    t = datetime.datetime(2024, 1, 1)
    rows = [(f"{n:08x}", 40, t + datetime.timedelta(hours=n // 2)) for n in range(6)]
    df = spark.createDataFrame(rows, "handle string, bytes long, modified timestamp")
    keep = lambda **k: [r["handle"][-1] for r in store.listing(store.prune(df, **k)).collect()]
    assert keep() == ["4", "5", "2", "3", "0", "1"]
    assert keep(max_runs=3) == ["4", "5", "2"]
    assert keep(max_bytes=80) == ["4", "5"]
    assert keep(max_bytes=1) == ["4"]


def test_log_round_trip(spark, tmp_path):
    records = spark.createDataFrame([("2024-01-01T00:00:00Z", "info", "run", "ls", 5, False, None), ("2024-01-02T00:00:00Z", "debug", "run", "x", None, True, "mode_raw")], "t string, lvl string, type string, cmd string, in_tok long, passthrough boolean, reason string")
    path = str(tmp_path / "log")
    log.append(records, path, "info")
    log.append(records, path, "trace")
    (tmp_path / "log" / "silt.log.2").write_text('broken\n{"t":"2024-01-03T00:00:00Z","lvl":"warn","type":"event","msg":"hm","path":"/x"}\n{"t":1}\n')
    got = log.scan(spark, path)
    assert got.count() == 4
    event = got.where("type = 'event'").first()
    assert event["msg"] == "hm" and event["fields"] == {"path": "/x"} and event["generation"] == 2
    assert log.totals(log.runs(got)).first().asDict() == {"runs": 3, "bytes": 0, "in_tok": 10, "out_tok": 0, "passthrough": 1}
    assert [r["cmd"] for r in log.by_command(log.runs(got, since="2024-01-02T00:00:00Z")).collect()] == ["x"]
    assert "in_tok" not in [r["value"] for r in log.lines(records, "trace").collect()][1]


def test_empty_log(spark):
    none = spark.createDataFrame([], "t string, lvl string, type string, cmd string, in_tok long, out_tok long, out_bytes long, err_bytes long, passthrough boolean, reason string")
    assert log.report(none).first().asDict() == {"runs": 0, "bytes": 0, "in_tok": 0, "out_tok": 0, "passthrough": 0, "passthrough_pct": None, "reduction_pct": None}


def test_generations(spark):
    df = spark.createDataFrame([("a", n) for n in range(8)], "log string, generation int")
    assert sorted(r["generation"] for r in log.keep_generations(df).collect()) == [0, 1, 2, 3, 4]


def test_rotation(spark):
    files = [("a", 0, 9), ("a", 1, 5), ("a", 5, 5), ("b", 0, 8), ("b", 5, 9), ("c", 1, 99)]
    got = {(r["log"], r["generation"]): r["goes_to"] for r in log.rotation(spark.createDataFrame(files, "log string, generation int, bytes long"), 8).collect()}
    assert got == {("a", 0): 1, ("a", 1): 2, ("a", 5): None, ("b", 0): 0, ("b", 5): 5, ("c", 1): 1}


def test_baseline_file(spark, tmp_path):
    (tmp_path / "b.json").write_text('{\n "x": {"bytes": 1, "stages": {"parse": {"p50_us": 2, "p99_us": 3}}, "total": {"p50_us": 4, "p99_us": 5}},\n "y": {}\n}')
    got = sorted(tuple(r) for r in measure.read_baseline(spark, str(tmp_path / "b.json")).collect())
    assert got == [("x", "parse", 2, 3), ("x", "total", 4, 5)]
    assert measure.parse_baseline(spark.createDataFrame([("broken",), (None,)], "value string")).count() == 0


def test_plan(spark):
    got = {r["n"]: (r["action"], r["program"], r["reason"]) for r in queries.plan_commands(spark, "").collect()}
    assert got == {n: c[3:] for n, c in enumerate(queries.COMMANDS)}


def test_stream_report(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.log").write_text("\n".join(f'{{"t":"2024-01-01T00:{m:02}:00Z","lvl":"info","type":"run","cmd":"ls","in_tok":{m},"passthrough":false}}' for m in range(3)) + "\nbroken")
    query = reports.hourly(reports.read_log(spark, str(folder))).writeStream.outputMode("complete").format("memory").queryName("hourly").start()
    query.processAllAvailable()
    query.stop()
    assert [(r["cmd"], r["runs"], r["in_tok"]) for r in spark.table("hourly").collect()] == [("ls", 3, 3)]


def test_closed_runs_stream(spark, tmp_path):
    folder, seen = str(tmp_path / "runs"), []
    spark.createDataFrame([(1, "stdout", "a\nb", 0)], "run_id long, stream string, raw string, exit_code int").write.parquet(folder)
    stream = spark.readStream.schema("run_id long, stream string, raw string, exit_code int").parquet(folder)
    query = reports.filter_closed(stream, lambda df, n: seen.extend(r["body"] for r in df.collect()), str(tmp_path / "ck"))
    query.processAllAvailable()
    query.stop()
    assert seen == ["a\nb\n"]


def test_planner_precedence(spark):
    df = spark.createDataFrame([(["vim", "--json"], False, False)], "argv array<string>, tty boolean, raw boolean")
    assert planner.plan(df, spark.createDataFrame([], "name string, dir_rank int, dir string, own boolean")).first()["reason"] == "interactive"


def test_capture(spark):
    script = "import os,sys; os.write(1, b'a\\n' * 70000); os.write(2, b'bad'); sys.exit(3)"
    rows = [(["python3", "-c", script], "/"), (["sh", "-c", "kill -9 $$"], "/"), (["/no/such"], "/")]
    got = [r for r in capture.run_commands(spark.createDataFrame(rows, "argv array<string>, cwd string")).collect()]
    by = {r["argv"][0]: r for r in got}
    assert (bytes(by["python3"]["stdout"]), bytes(by["python3"]["stderr"]), by["python3"]["exit_code"]) == (b"a\n" * 70000, b"bad", 3)
    assert by["sh"]["exit_code"] == 137 and by["/no/such"]["exit_code"] is None
    assert capture.child(["/usr/bin/git", "log"]) == ["/usr/bin/git", "--no-pager", "log"]


def test_binary_streams_pass_through(spark):
    rows = [(1, "stdout", b"\x01\x02\xff\x00\ntext\n", 0), (1, "stderr", "error: é\n".encode(), 1)]
    got = {r["stream"]: r for r in pipeline.filter_bytes(spark.createDataFrame(rows, "run_id long, stream string, raw binary, exit_code int")).collect()}
    assert bytes(got["stdout"]["body"]) == rows[0][2] and got["stdout"]["in_lines"] == got["stdout"]["out_lines"] == 2
    assert bytes(got["stderr"]["body"]).decode() == "error: é\n" and got["stderr"]["in_lines"] == 1


def test_measures(spark):
    measured = spark.createDataFrame([("a", "x", 130), ("a", "y", 500), ("b", "x", 9), ("c", "x", 110)], "fixture string, stage string, p50 long")
    baseline = spark.createDataFrame([("a", "x", 100), ("a", "y", 50), ("c", "x", 100)], "fixture string, stage string, p50 long")
    got = {(r["fixture"], r["stage"]): r["verdict"] for r in measure.against_baseline(measured, baseline).collect()}
    assert got == {("a", "x"): "regression", ("a", "y"): "noise", ("b", "x"): "new", ("c", "x"): "ok"}
    times = spark.createDataFrame([("a", 1, 10), ("a", 4, 40), ("a", 16, 170), ("b", 1, 0), ("b", 4, 9), ("b", 16, 10)], "fixture string, scale int, p50 long")
    assert {r["fixture"]: r["verdict"] for r in measure.growth(times).collect()} == {"a": "ok", "b": "superlinear"}
    assert [one(spark, measure.format_bytes(F.lit(n))) for n in (5, 1023, 1024, 5000)] == ["5 B", "1023 B", "1 KB", "4 KB"]


def test_printed_report(spark):
    rows = [("ls", 100, 40, False, None), ("ls", 60, 24, False, None), ("vim", None, None, True, "interactive")]
    df = spark.createDataFrame(rows, "cmd string, in_tok long, out_tok long, passthrough boolean, reason string").selectExpr("*", "10L as out_bytes", "null as err_bytes")
    assert [r["line"] for r in log.printed(df).collect()] == [
        "runs                       3", "passthrough                1  (33%)", "captured bytes            30", "input tokens             160", "output tokens             64", "reduction              60.0%  (output tokens only)",
        "by command", "  ls                   2", "  vim                  1", "passthrough reasons", "  interactive                  1",
    ]
    assert [r["line"] for r in log.printed(df.limit(0)).collect()] == ["no runs recorded"]


def test_folders():
    assert config.folders({"HOME": "/h"}) == ("/h/.cache", "/h/.config", "/h/.local/state", "/h/.cache/silt/runs", "/h/.local/state/silt/logs")
    got = config.folders({"HOME": "/h", "XDG_CACHE_HOME": "", "XDG_STATE_HOME": "/s", "SILT_STORE": "/x"}, "macos")
    assert got.cache == "/h/Library/Caches" and got.logs == "/s/silt/logs" and got.store == "/x"
