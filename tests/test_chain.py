import random

import pytest
from pyspark.sql import functions as F

from silt.operators import folds, render
from silt.operators import stages as S
from silt.plans import pipeline as P

from . import model

SOUP = [
    "error: broke", "warning: odd", "checked item 1", "checked item 2", "   Compiling x v1", "Compiling x", "  --> a.rs:1", "3 | let x", "= note: y", "", "", "  ", "same", "same", "same",
    "50% done", "[#####-----]", "--------", "---", "test result: 0 failed", "thread panicked at x", "\x1b[31merror\x1b[0m: red", "one\rtwo", "step 1", "step 2", "step 3", "retry 7", "ok", "Downloading a", "⠋ work", "..........F...", "FAILED test_a", "\ttab", "x" * 5, "1 tests failed", "note\r",
]


def streams(spark, rows):
    return spark.createDataFrame(rows, "run_id long, stream string, raw string, exit_code int")


@pytest.fixture(scope="module")
def soup(spark):
    rng = random.Random(4)
    rows = []
    for n in range(400):
        words = rng.sample(SOUP, rng.randint(2, 9)) if n % 2 else SOUP
        lines = [rng.choice(words) for _ in range(rng.randint(0, 45))]
        if n % 5 == 0:
            lines = [rng.choice(["a 1", "b 2", "c"]) + ("\n" if n % 10 else "") for _ in range(rng.randint(6, 60))]
        if n % 7 == 0:
            lines = (rng.sample(SOUP, 3) + [""]) * rng.randint(2, 6)
        rows.append((n, rng.choice(["stdout", "stderr"]), rng.choice(["\n", "\n", "\r\n"]).join(lines) + rng.choice(["", "\n"]), rng.randint(0, 1)))
    return rows, P.run(streams(spark, rows)).cache()


def test_chain_matches_the_model(spark, soup):
    rows, blocks = soup
    got = {}
    for r in blocks.orderBy("run_id", "stream", "block").collect():
        got.setdefault(r["run_id"], []).append(([tuple(x) for x in r["lines"]], r["class"], r["keep"], r["reason"]))
    for run_id, stream, raw, code in rows:
        want = [(b.lines, b.cls, b.keep, b.reason) for b in model.run(raw, stream, code)]
        assert got.get(run_id, []) == want, (run_id, raw)


@pytest.mark.parametrize("level", [0, 1, 2])
def test_views_match_the_model(spark, soup, level):
    rows, blocks = soup
    got = {r["run_id"]: r["body"] for r in render.render(blocks, streams(spark, rows), level).collect()}
    for run_id, stream, raw, code in rows:
        assert got[run_id] == model.render(model.run(raw, stream, code), level)


def test_invariants(spark, soup):
    rows, blocks = soup
    for r in S.elided(blocks).collect():
        assert (r["keep"] == "Drop") == (r["elided"] is not None)
        if r["elided"]:
            assert r["elided"]["lines_removed"] == len(r["lines"]) and r["elided"]["reason"]
    origins = blocks.select("run_id", F.explode("lines").alias("x")).groupBy("run_id").agg(F.count("*").alias("n"), F.countDistinct("x.origin").alias("d"))
    for r in origins.collect():
        want = sum(len(b.lines) for b in model.parse(rows[r["run_id"]][2]))
        assert r["n"] == r["d"] == want
    for r in render.accounting(blocks).collect():
        assert r["kept_lines"] + r["elided_lines"] == r["lines"]


def test_raw_is_untouched(spark, soup):
    rows, _ = soup
    got = {r["run_id"]: r["body"] for r in P.filter_view(streams(spark, rows), render.RAW).collect()}
    assert all(got[r[0]] == r[2] for r in rows)


def test_fold_matches_slices():
    rng = random.Random(2)
    for _ in range(5000):
        keys = [rng.randint(0, 1) for _ in range(rng.randint(0, 30))]
        dropped, counts = folds.fold_windows(keys)
        want, times, n = set(), {}, len(keys)
        for w in range(min(8, n // 3), 1, -1):
            s = 0
            while s + 3 * w <= n:
                r = 1
                while s + (r + 1) * w <= n and keys[s + r * w : s + (r + 1) * w] == keys[s : s + w]:
                    r += 1
                if r >= 3:
                    want |= set(range(s + w, s + w * r))
                    times.setdefault(s + w - 1, r)
                    s += w * r
                else:
                    s += 1
        assert (dropped, counts) == (want, times)


def test_shuffles_of_the_chain(spark):
    """One before the windows and, as Python hides the partitioning, one after the fold."""
    import io
    from contextlib import redirect_stdout

    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = io.StringIO()
        with redirect_stdout(plan):
            render.body(P.run(streams(spark, [(1, "stdout", "a\nb", 0)]))).explain()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert plan.getvalue().count("Exchange ") == 2 and "Join" not in plan.getvalue()


def test_empty_and_null_streams(spark):
    rows = [(1, "stdout", None, 1), (2, "stdout", "", 0), (3, "stdout", " \n\n", 1)]
    for level in (0, 1, 2):
        assert {r["body"] for r in P.filter_view(streams(spark, rows), level).collect()} == {""}
    assert P.filter_view(streams(spark, []), 2).count() == 0


def test_events_log_counts(spark):
    """Counts of the log made from the events table, worked out by hand beforehand."""
    import os

    from silt.plans import queries

    folder = "/root/testdata/sf0.001"
    if not os.path.isdir(folder):
        pytest.skip("no tables here")
    blocks = P.run(queries.events_log(spark, folder)).cache()
    count = lambda c: {r[c]: r["count"] for r in blocks.groupBy(c).count().collect()}
    assert blocks.count() == 283 and blocks.agg(F.sum("n_lines")).first()[0] == 798
    assert count("class") == {"Error": 9, "Warning": 134, "Info": 126, "Progress": 14}
    assert count("keep") == {"Force": 72, "Normal": 186, "Drop": 25}
    gone = {r["reason"]: r["n"] for r in blocks.where("keep = 'Drop'").groupBy("reason").agg(F.sum("n_lines").alias("n")).collect()}
    assert gone == {"progress": 26, "dedupe": 23}


def test_report_runs_the_chain_once(spark):
    """Counts and bodies come from one pass: one fold in Python, and the streams scanned twice."""
    import io
    from contextlib import redirect_stdout

    streams = spark.createDataFrame([(1, "stdout", "a\nb", 0)], "run_id long, stream string, raw string, exit_code int")
    binary = streams.withColumn("raw", F.encode("raw", "UTF-8"))
    for rows in (render.report(P.run(streams), streams), P.filter_bytes(binary)):
        plan = io.StringIO()
        with redirect_stdout(plan):
            rows.explain()
        assert plan.getvalue().count("ArrowEvalPython") == 1
