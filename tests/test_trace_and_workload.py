"""Trace parsing and analytics on written-out logs, the stream variants, workload tools."""

import threading
import time

import pytest
from pyspark.sql import functions as F

from millrace.operators import trace as T
from millrace.plans import workload as W
from millrace.streaming import timeline as S

LOG = """[gvm] 100.000000 BEGIN
[gvm] 100.000001 intercepting cudaMalloc at 7fff
[gvm] 100.000002 intercepted cudaMalloc( 1000 256 ) = 0
noise
[gvm] 100.000003 intercepted cudaFree( 1000 ) = 0
[gvm] 100.000004 intercepting cudaMalloc at 7fff
[gvm] 100.000005 intercepted cudaMalloc( 1000 512 ) = 0
[gvm] 100.000006 intercepting cudaMemcpy
[gvm] 100.000009 intercepted cudaMemcpy( 1000 7f00 64 1 ) = 0
[gvm] 100.000010 intercepted cudaConfigureCall( 1 1 ) = 0
[gvm] 100.000011 intercepted cudaSetupArgument( 8 10 10 0 0 0 0 0 0 ) = 0
[gvm] 100.000012 intercepted cudaSetupArgument( 4 1 0 0 0 ) = 0
[gvm] 100.000013 intercepting cudaLaunch
[gvm] 100.000020 intercepted cudaLaunch = 0
[gvm] 100.000021 intercepted cudaFree( 1000 ) = 0
[gvm] 100.000022 intercepted cudaFree( 2000 ) = 0
[gvm] 100.000023 intercepted cudaMalloc( 3000 99 ) = 0
"""


@pytest.fixture(scope="module")
def rows(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("log")
    (d / "q9.solo").write_text(LOG)
    return T.read_trace(spark, str(d)).cache()


def test_parse(rows):
    assert rows.count() == 15 and {r["query"] for r in rows.select("query").collect()} == {"q9"}
    first = rows.filter("idx = 2").first()
    assert (first["api"], first["addr"], first["bytes"], first["ts"]) == ("cudaMalloc", 0x1000, 256, 100_000_002)
    assert rows.filter("arg is not null").first()["arg"] == 0x1010


def test_pairs_follow_address_reuse(rows):
    got = {(r["alloc_idx"], r["free_idx"], r["bytes"]) for r in T.pairs(rows).collect()}
    assert got == {(2, 4, 256), (6, 14, 512)}  # neither the unmatched free nor the open allocation


def test_timeline_peak_usage_and_copies(rows):
    line = T.timeline(rows)
    assert [(r["before"], r["after"]) for r in line.orderBy("idx").collect()] == [(0, 256), (256, 0), (0, 512), (512, 0)]
    assert T.peaks(line, scale=2, device_bytes=1000).first()[1:] == (1024, True)
    assert T.kernel_usage(rows).first()["bytes"] == 512 - 16
    assert tuple(T.copy_spans(rows).select("begin", "end", "bytes", "kind").first()) == (100_000_006, 100_000_009, 64, 1)
    area = T.areas(line).first()
    assert int(area["area"]) == 256 * 1 + 512 * 16 and area["span"] == 17
    assert abs(T.utilisation(line, T.copy_spans(rows).select("query", "begin", "end", "bytes")).first()["utilisation"] - 64 * 3 / (256 + 512 * 16)) < 1e-12


def test_allocated_bytes_balance_with_a_double_free(spark):
    row = lambda i, api, a, n=None: ("q", i, i, "intercepted", api, a, n, None, None)
    lines = [row(0, "cudaMalloc", 8, 100), row(1, "cudaMalloc", 16, 7), row(2, "cudaFree", 8), row(3, "cudaFree", 8), row(4, "cudaFree", 16), row(5, "cudaFree", 24)]
    trace = spark.createDataFrame(lines, "query string, idx long, ts long, phase string, api string, addr long, bytes long, kind int, arg long")
    got = sorted((r["idx"], r["before"], r["after"]) for r in T.timeline(trace, block=2).collect())
    assert got == [(0, 0, 100), (0, 100, 200), (1, 200, 207), (2, 207, 107), (3, 107, 7), (4, 7, 0)]
    area = T.areas(T.timeline(trace), block=2).first()
    assert (int(area["area"]), area["span"]) == (200 + 207 + 107 + 7, 4)


def test_allocated_bytes_are_never_negative(spark):
    line = T.timeline(T.from_events(spark.read.parquet("/root/testdata/sf0.01/events.parquet")), block=500)
    low = line.groupBy("query").agg(F.min("after").alias("lo"), F.min("before").alias("first"), F.max_by("after", "idx").alias("end")).collect()
    assert all((r["lo"], r["first"], r["end"]) == (0, 0, 0) for r in low)


def test_blocks_hand_on_their_borders(spark, rows):
    events = T.from_events(spark.read.parquet("/root/testdata/sf0.001/events.parquet"))
    for f in (T.copy_spans, T.gantt, T.kernel_usage, T.regions, lambda t, block: T.areas(T.timeline(t), block=block)):
        for trace in (rows, events):
            few, one = (sorted(map(tuple, f(trace, block=b).collect()), key=repr) for b in (7, 1 << 40))
            assert few == one


def test_lines_are_read_as_written(rows):
    back = T.parse_lines(T.to_lines(rows))
    same = lambda df: sorted((tuple(r) for r in df.filter("api <> 'cudaConfigureCall' and (api <> 'cudaSetupArgument' or arg is not null)").collect()), key=repr)
    assert same(back) == same(rows)


def test_gantt_fills_gaps(rows):
    spans = sorted((r["class"], r["begin"], r["end"]) for r in T.gantt(rows).collect())
    assert [s for s in spans if s[0] != 5] == [(0, 5, 8), (2, 12, 19), (4, 0, 1), (4, 3, 4)]
    assert [s for s in spans if s[0] == 5] == [(5, 0, 0), (5, 1, 3), (5, 4, 5), (5, 8, 12)]


def test_memsize_lines(spark, tmp_path):
    (tmp_path / "q1.solo").write_text("[gvm] x BEGIN\n[gvm] x MEMSIZE 2000000 5.5\n[gvm] x MEMSIZE 500000 5.75\n")
    assert [(r["ts"], r["mb"]) for r in T.footprint_lines(spark, str(tmp_path)).orderBy("ts").collect()] == [(0.0, 2.0), (250.0, 0.5)]


def test_streams(spark, rows, tmp_path):
    rows.write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in")
    q = S.live_bytes(stream).writeStream.format("memory").queryName("live").outputMode("append").option("checkpointLocation", f"{tmp_path}/c1").start()
    q.processAllAvailable()
    q.stop()
    assert [r["bytes_live"] for r in spark.sql("select * from live order by idx").collect()] == [256, 0, 512, 0, 0, 99]
    events = spark.createDataFrame([("2024-01-01 00:10:00", "a", 1.0), ("2024-01-01 00:50:00", "a", 2.0), ("2024-01-01 05:00:00", "b", 4.0)], "ts string, event_type string, value double").withColumn("ts", F.to_timestamp("ts"))
    events.write.parquet(f"{tmp_path}/ev")
    q = S.windowed_counts(spark.readStream.schema(events.schema).parquet(f"{tmp_path}/ev")).writeStream.format("memory").queryName("win").outputMode("complete").option("checkpointLocation", f"{tmp_path}/c2").start()
    q.processAllAvailable()
    q.stop()
    assert sorted((r["event_type"], r["n"], r["total"]) for r in spark.table("win").collect()) == [("a", 2, 3.0), ("b", 1, 4.0)]


def test_plans_and_mixes():
    assert W.parse_plan("q1 q2\n\nq3 q3\n") == [["q1", "q2"], ["q3", "q3"]]
    assert len(W.combinations("abcdef", 3)) == 20 and len(W.combinations("abcdef", 4)) == 15 and len(W.combinations(map(str, range(13)), 2, True)) == 91
    assert W.growing(["a", "b"]) == [["a"], ["a", "b"]]
    assert W.random_mix(["a", "b"], 50, seed=3) == W.random_mix(["a", "b"], 50, seed=3) and len(W.random_mix(["a"])) == 500
    assert W.estimate(600, "14") == 900 and W.estimate(600, "7") == 450


def test_admission_never_exceeds():
    for gate in (W.Admission(permitted=100), W.Admission(permitted=None, most=2)):
        threads = [threading.Thread(target=gate, args=(40, lambda: time.sleep(0.01))) for _ in range(12)]
        [t.start() for t in threads]
        [t.join() for t in threads]
        assert gate.running == 0 and gate.bytes == 0 and gate.peak_running == 2


def test_runs_and_speedup(spark):
    make = lambda: spark.range(1000).selectExpr("sum(id) as s")
    bad = lambda: spark.sql("select raise_error('x')")
    solo = W.runs_frame(spark, W.solo_run(spark, "a", make, repeats=2))
    rows = W.co_run(spark, [("a", make), ("a", make)], repeats=5) + W.co_run(spark, [("a", make), ("b", bad)], repeats=2)
    runs = W.runs_frame(spark, rows)
    got = W.weighted_speedup(runs, W.solo_stats(solo)).collect()
    assert [r["combo"] for r in got] == ["a.a"] and got[0]["speedup"] > 0
    assert W.corun_stats(runs).count() == 4


def test_crash_report(spark):
    lines = spark.createDataFrame([("x", "error", "boom"), ("x", "t", ""), ("y", "error", " "), ("y", "t", "evicting region 7")], "combo string, stream string, line string")
    assert {tuple(r) for r in W.crash_report(lines).collect()} == {("x", True, False), ("y", False, True)}


def test_contexts_are_kept(spark, tmp_path):
    runs = W.runs_frame(spark, [("a", "a", 1, 2.0, "")])
    W.save_context(runs, f"{tmp_path}/r")
    assert W.restore_context(spark, f"{tmp_path}/r").collect() == runs.collect()
