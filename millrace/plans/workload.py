"""Concurrent workloads: combinations, random mixes, solo and co-runs, admission, speedup statistics."""

from __future__ import annotations

import itertools
import random
import threading
import time
from collections.abc import Callable, Iterable
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Memory that admitted queries may estimate together, and how data sizes scale an estimate.
PERMITTED_BYTES = 1_600_000_000
SIZE_FACTORS = {"14": (3, 2), "7": (3, 4)}


def parse_plan(text: str) -> list[list[str]]:
    """A combination a line, names apart by white space."""
    return [line.split() for line in text.splitlines() if line.strip()]


def combinations(names: Iterable[str], k: int, with_itself: bool = False) -> list[tuple[str, ...]]:
    pick = itertools.combinations_with_replacement if with_itself else itertools.combinations
    return list(pick(sorted(names), k))


def growing(names: list[str]) -> list[list[str]]:
    """Plans of 1, 2, ... queries."""
    return [names[:i] for i in range(1, len(names) + 1)]


def random_mix(names: list[str], n: int = 500, sizes: tuple[str, ...] = ("7", "14"), seed: int = 0) -> list[tuple[str, str]]:
    rnd = random.Random(seed)
    return [(rnd.choice(names), rnd.choice(sizes)) for _ in range(n)]


def estimate(memory: int, size: str) -> int:
    up, down = SIZE_FACTORS[size]
    return memory * up // down


class Admission:
    """Weighted permits: a query waits until its bytes fit, or with ``most`` until fewer run. A query larger than the whole is admitted alone."""

    def __init__(self, permitted: int | None = PERMITTED_BYTES, most: int | None = None):
        self.permitted, self.most = permitted, most
        self.bytes = self.running = self.peak_bytes = self.peak_running = 0
        self.changed = threading.Condition()

    def fits(self, size: int) -> bool:
        if self.running == 0:
            return True
        return (self.permitted is None or self.bytes + size <= self.permitted) and (self.most is None or self.running < self.most)

    def __call__(self, size: int, work: Callable[[], object]) -> object:
        with self.changed:
            self.changed.wait_for(lambda: self.fits(size))
            self.bytes += size
            self.running += 1
            self.peak_bytes, self.peak_running = max(self.peak_bytes, self.bytes), max(self.peak_running, self.running)
        try:
            return work()
        finally:
            with self.changed:
                self.bytes -= size
                self.running -= 1
                self.changed.notify_all()


def solo_run(spark: SparkSession, name: str, make: Callable[[], DataFrame], repeats: int = 6, warm: int = 1) -> list[tuple[str, str, int, float, str]]:
    """(combo, query, run, ms, error) rows; warm-up runs come first and are counted."""
    return [_timed(spark, name, name, make, i + 1) for i in range(warm + repeats)]


def _timed(spark: SparkSession, combo: str, name: str, make: Callable[[], DataFrame], run: int) -> tuple[str, str, int, float, str]:
    began, error = time.perf_counter(), ""
    try:
        make().write.format("noop").mode("overwrite").save()
    except Exception as e:  # a crash is a result here
        error = f"{type(e).__name__}: {e}"[:500]
    return combo, name, run, (time.perf_counter() - began) * 1000, error


def co_run(spark: SparkSession, combo: list[tuple[str, Callable[[], DataFrame]]], repeats: int = 9, limit_s: float | None = 30, admission: Admission | None = None, sizes: dict[str, int] | None = None) -> list[tuple[str, str, int, float, str]]:
    """Runs the queries of a combination at once, each ``repeats`` times, in a scheduler pool of its own.

    With ``limit_s`` what still runs then is cancelled; runs that had not begun
    are left out.
    """
    label = ".".join(n for n, _ in combo)
    for name, make in combo:
        _timed(spark, label, name, make, 0)
    group, stop = f"corun-{label}-{time.time_ns()}", threading.Event()

    def one(at: int) -> list[tuple[str, str, int, float, str]]:
        name, make = combo[at]
        sc = spark.sparkContext
        sc.setLocalProperty("spark.scheduler.pool", f"pool{at}")
        sc.setJobGroup(group, label, interruptOnCancel=True)
        rows = []
        for run in range(1, repeats + 1):
            if stop.is_set():
                break
            work = lambda run=run: _timed(spark, label, f"{name}#{at}", make, run)
            rows.append(admission((sizes or {}).get(name, 0), work) if admission else work())
        return rows

    timer = threading.Timer(limit_s, lambda: (stop.set(), spark.sparkContext.cancelJobGroup(group))) if limit_s else None
    if timer:
        timer.start()
    try:
        with ThreadPoolExecutor(len(combo)) as pool:
            return [r for rows in pool.map(one, range(len(combo))) for r in rows]
    finally:
        if timer:
            timer.cancel()


RUNS = "combo string, query string, run_no int, total_ms double, error string"


def runs_frame(spark: SparkSession, rows: list[tuple[str, str, int, float, str]]) -> DataFrame:
    return spark.createDataFrame(rows, RUNS)


def solo_stats(runs: DataFrame) -> DataFrame:
    """``query, solo_ms``: the average after the first run."""
    return runs.filter("run_no > 1").groupBy("query").agg(F.avg("total_ms").alias("solo_ms"))


def corun_stats(runs: DataFrame, first: int = 2, last: int = 6) -> DataFrame:
    """``combo, query, corun_ms`` over runs ``first`` to ``last``, when all overlap."""
    return runs.filter(F.col("run_no").between(first, last)).groupBy("combo", "query").agg(F.avg("total_ms").alias("corun_ms"))


def weighted_speedup(runs: DataFrame, solo: DataFrame, first: int = 2, last: int = 4) -> DataFrame:
    """``combo, speedup``: the sum of solo time over co-run time of the combination's queries; combinations with a crash are left out."""
    crashed = runs.filter("error is not null and error <> ''").select("combo").distinct()
    stats = corun_stats(runs.join(crashed, "combo", "left_anti"), first, last).withColumn("name", F.substring_index("query", "#", 1))
    solo = solo.select(F.col("query").alias("name"), "solo_ms")
    return stats.join(solo, "name").groupBy("combo").agg(F.sum(F.col("solo_ms") / F.col("corun_ms")).alias("speedup"))


def crash_report(lines: DataFrame) -> DataFrame:
    """``combo, crashed, evicted`` from ``combo, stream, line``: any text in the error stream is a crash, "evicting region" an eviction."""
    return lines.groupBy("combo").agg(F.max((F.col("stream") == "error") & (F.trim("line") != "")).alias("crashed"), F.max((F.col("stream") != "error") & F.col("line").contains("evicting region")).alias("evicted"))


def greedy_batches(mix: DataFrame, permitted: int = PERMITTED_BYTES, workload: str | None = None) -> DataFrame:
    """``seq, query, bytes, batch`` of ``seq, query, bytes``: queries in order; one that does not fit opens a batch.

    A batch's content depends on all before it, so a workload is folded in one
    group of hundreds of queries that an operator plans. With ``workload``, the
    name of a long column, each of its values is a workload of its own, which
    the result names too: for whole tables.
    """
    kept = [workload] if workload else []

    def fold(pdf):
        pdf = pdf.sort_values("seq")
        total, batch, out = 0, 0, []
        for b in pdf["bytes"]:
            if total and total + b > permitted:
                total, batch = 0, batch + 1
            total += b
            out.append(batch)
        return pdf.assign(batch=out)[[*kept, "seq", "query", "bytes", "batch"]]

    key = F.col(workload) if workload else F.lit(0).alias("workload")
    return mix.groupBy(key).applyInPandas(fold, "".join(f"{c} long, " for c in kept) + "seq long, query string, bytes long, batch int")


def save_context(runs: DataFrame, path: str) -> None:
    runs.write.mode("overwrite").parquet(path)


def restore_context(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)
