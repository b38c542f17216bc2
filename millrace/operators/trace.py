"""Analytics of device-memory traces: pairing, timelines, usage, copies, utilisation, spans.

A trace table has ``query, idx, ts, phase, api, addr, bytes, kind, args``: idx is
the line number within the query, ts the time in microseconds, phase
``intercepting`` (before the call) or ``intercepted`` (after), kind 1 for copies
to the device and 2 from it. Every operator works per query; within a query,
windows are partitioned further (by address) or run over blocks of ``LINES``
lines that hand on their borders, so a long query is the work of many tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .encoding import carried, prefix_sum

#: Lines of a block.
LINES = 1 << 16

#: Device memory that a footprint is flagged against, and the bytes of an address page.
DEVICE_BYTES = 1_470_000_000
PAGE = 1 << 20
# Event classes.
CLASSES = {"H2D": 0, "D2H": 1, "cudaLaunch": 2, "diskIO": 3, "cudaMalloc": 4, "other": 5}


def read_trace(spark: SparkSession, path: str) -> DataFrame:
    """Lines ``[gvm] time phase call(args)``; other lines and BEGIN lines are dropped. The file name without its ending is the query.

    A line's number comes from its place in its file, so files are read whole:
    one a task, as recorded traces are small; many files spread over tasks.
    """
    lines = spark.read.text(path, wholetext=True).select(F.regexp_extract(F.input_file_name(), r"([^/]+?)(\.[^./]*)?$", 1).alias("query"), F.posexplode(F.split("value", "\n")).alias("idx", "value"))
    return parse_lines(lines)


def parse_lines(lines: DataFrame) -> DataFrame:
    """Trace rows of ``query, idx, value``."""
    m = lambda pattern, g=1: F.regexp_extract("value", pattern, g)
    num = lambda c: F.expr(f"try_cast({c} as bigint)")
    w = F.split(F.trim(F.regexp_replace("args_text", r"\s+", " ")), " ")
    rows = lines.filter(F.col("value").startswith("[gvm]") & ~F.col("value").contains("BEGIN")).select(
        "query", F.col("idx").cast("long").alias("idx"), F.round(m(r"^\[gvm\]\s+([0-9.]+)").cast("double") * 1e6).cast("long").alias("ts"),
        m(r"^\[gvm\]\s+\S+\s+(intercept\w+)").alias("phase"), m(r"intercept\w+\s+(\w+)").alias("api"), m(r"\(([^)]*)\)").alias("args_text"),
    )
    hexa = lambda i: F.conv(F.regexp_replace(F.get(w, F.lit(i)), "^0x", ""), 16, 10).cast("long")
    return rows.withColumn("a0", F.get(w, F.lit(0))).withColumn("a1", F.get(w, F.lit(1))).withColumn("a2", F.get(w, F.lit(2))).withColumn("a3", F.get(w, F.lit(3))).select(
        "query", "idx", "ts", "phase", "api",
        F.when(F.col("api").isin("cudaMalloc", "cudaFree", "cudaMemcpy"), hexa(0)).alias("addr"),
        F.when(F.col("api") == "cudaMalloc", num("a1")).when(F.col("api") == "cudaMemcpy", num("a2")).alias("bytes"),
        F.when(F.col("api") == "cudaMemcpy", num("a3")).cast("int").alias("kind"),
        F.when((F.col("api") == "cudaSetupArgument") & (F.col("a0") == "8") & (F.size(w) >= 9), F.conv(F.concat_ws("", *[F.lpad(F.get(w, F.lit(i)), 2, "0") for i in range(8, 0, -1)]), 16, 10).cast("long")).alias("arg"),
    )


def to_lines(trace: DataFrame) -> DataFrame:
    """``query, idx, value``: trace rows as the lines that ``parse_lines`` reads."""
    hexa = lambda c: F.lower(F.hex(c))
    arg = F.lpad(hexa(F.col("arg")), 16, "0")
    octets = F.concat_ws(" ", *[F.substring(arg, i, 2) for i in range(15, 0, -2)])  # the lowest first
    call = (
        F.when(F.col("phase") == "intercepting", F.concat(F.col("api"), F.lit(" at 0")))
        .when(F.col("api") == "cudaMalloc", F.concat(F.lit("cudaMalloc( "), hexa("addr"), F.lit(" "), F.col("bytes").cast("string"), F.lit(" ) = 0")))
        .when(F.col("api") == "cudaFree", F.concat(F.lit("cudaFree( "), hexa("addr"), F.lit(" ) = 0")))
        .when(F.col("api") == "cudaMemcpy", F.concat(F.lit("cudaMemcpy( "), hexa("addr"), F.lit(" 0 "), F.col("bytes").cast("string"), F.lit(" "), F.col("kind").cast("string"), F.lit(" ) = 0")))
        .when(F.col("api") == "cudaSetupArgument", F.concat(F.lit("cudaSetupArgument( 8 "), octets, F.lit(" ) = 0")))
        .otherwise(F.concat(F.col("api"), F.lit(" = 0")))
    )
    time = F.format_string("%d.%06d", F.expr("ts div 1000000"), F.col("ts") % 1_000_000)
    return trace.select("query", "idx", F.concat(F.lit("[gvm] "), time, F.lit(" "), F.col("phase"), F.lit(" "), call).alias("value"))


def pairs(trace: DataFrame) -> DataFrame:
    """``query, addr, alloc_idx, alloc_ts, free_idx, free_ts, bytes``: each free with the latest allocation of its address before it.

    By line number, as times tie. Frees without one and allocations never freed
    are left out.
    """
    done = trace.filter("phase = 'intercepted' and api in ('cudaMalloc', 'cudaFree') and addr is not null")
    w = Window.partitionBy("query", "addr").orderBy("idx").rowsBetween(Window.unboundedPreceding, -1)
    alloc = F.when(F.col("api") == "cudaMalloc", F.struct("idx", "ts", "bytes"))
    return done.withColumn("a", F.last(alloc, ignorenulls=True).over(w)).filter("api = 'cudaFree' and a is not null").select("query", "addr", F.col("a.idx").alias("alloc_idx"), F.col("a.ts").alias("alloc_ts"), F.col("idx").alias("free_idx"), F.col("ts").alias("free_ts"), F.col("a.bytes").alias("bytes"))


def deltas(trace: DataFrame) -> DataFrame:
    """``query, idx, ts, delta``: for each free that has an allocation, plus its bytes at the allocation and minus them at the free.

    An allocation freed twice counts for each free, so that the sums balance:
    allocated bytes are never negative and end at 0.
    """
    p = pairs(trace)
    ups = p.select("query", F.col("alloc_idx").alias("idx"), F.col("alloc_ts").alias("ts"), F.col("bytes").alias("delta"))
    return ups.unionByName(p.select("query", F.col("free_idx").alias("idx"), F.col("free_ts").alias("ts"), (-F.col("bytes")).alias("delta")))


def timeline(trace: DataFrame, block: int = LINES) -> DataFrame:
    """``query, idx, ts, before, after``: allocated bytes around each change; a line that counts several times makes as many steps."""
    run = prefix_sum(deltas(trace), "idx", "delta", ("query",), block, "after")
    return run.select("query", "idx", "ts", (F.col("after") - F.col("delta")).alias("before"), "after")


def steps(timeline_df: DataFrame) -> DataFrame:
    """``query, idx, step, ts, bytes``: two points a change, for plotting."""
    return timeline_df.select("query", "idx", "ts", F.posexplode(F.array("before", "after")).alias("step", "bytes"))


def peaks(timeline_df: DataFrame, scale: float = 1.0, device_bytes: int = DEVICE_BYTES) -> DataFrame:
    """``query, peak, over``: the most bytes at once, scaled, and whether the device is too small."""
    peak = (F.max("after") * scale).cast("bigint")
    return timeline_df.groupBy("query").agg(peak.alias("peak")).withColumn("over", F.col("peak") > device_bytes)


def pair_footprints(peaks_df: DataFrame, device_bytes: int = DEVICE_BYTES) -> DataFrame:
    """``query_a, query_b, bytes, over`` for each two query names, a name with itself too.

    A report over query names (a list that people keep, not data): the join is a
    range join on names.
    """
    a, b = peaks_df.select(F.col("query").alias("query_a"), F.col("peak").alias("pa")), peaks_df.select(F.col("query").alias("query_b"), F.col("peak").alias("pb"))
    return a.join(b, F.col("query_a") <= F.col("query_b")).select("query_a", "query_b", (F.col("pa") + F.col("pb")).alias("bytes"), (F.col("pa") + F.col("pb") > device_bytes).alias("over"))


def kernel_usage(trace: DataFrame, page: int = PAGE, block: int = LINES) -> DataFrame:
    """``query, launch_idx, ts, bytes``: for each launch, the bytes that its 8-byte arguments point at.

    Arguments are those set since the launch before. An argument counts what is
    left of the allocation from its address on, taking the latest allocation
    before it that holds the address and was freed later in the trace.
    Allocations are cut into pages, so the range join is an equality on
    (query, page) refined by the range.
    """
    launch = F.when((F.col("api") == "cudaLaunch") & (F.col("phase") == "intercepted"), F.struct("idx", "ts"))
    args = carried(trace, "idx", launch, "l", ("query",), back=True, own=True, block=block).filter("api = 'cudaSetupArgument' and phase = 'intercepted' and arg is not null and l is not null").select("query", F.col("idx").alias("arg_idx"), "arg", F.col("l.idx").alias("launch_idx"))
    spans = pairs(trace).select("query", "alloc_idx", "addr", "bytes").distinct()
    paged = spans.withColumn("page", F.explode(F.sequence(F.floor(F.col("addr") / page), F.floor((F.col("addr") + F.greatest("bytes", F.lit(1)) - 1) / page))))
    a = args.withColumn("page", F.floor(F.col("arg") / page))
    held = a.join(paged, ["query", "page"]).filter("alloc_idx < arg_idx and arg >= addr and (arg < addr + bytes or arg = addr)")
    per_arg = held.groupBy("query", "launch_idx", "arg_idx").agg(F.max_by(F.col("addr") + F.col("bytes") - F.col("arg"), "alloc_idx").alias("bytes"))
    used = per_arg.groupBy("query", "launch_idx").agg(F.sum("bytes").alias("bytes"))
    launches = trace.filter("api = 'cudaLaunch' and phase = 'intercepted'").select("query", F.col("idx").alias("launch_idx"), "ts")
    return launches.join(used, ["query", "launch_idx"], "left").select("query", "launch_idx", "ts", F.coalesce("bytes", F.lit(0)).alias("bytes"))


def copy_spans(trace: DataFrame, block: int = LINES) -> DataFrame:
    """``query, idx, begin, end, bytes, kind``: a copy's call line with the line after it."""
    rows = carried(trace, "idx", F.struct("ts", "bytes", "kind"), "n", ("query",), back=True, block=block)
    return rows.filter("api = 'cudaMemcpy' and phase = 'intercepting' and n.ts is not null").select("query", "idx", F.col("ts").alias("begin"), F.col("n.ts").alias("end"), F.col("n.bytes").alias("bytes"), F.col("n.kind").alias("kind"))


def areas(timeline_df: DataFrame, block: int = LINES) -> DataFrame:
    """``query, area, span``: allocated bytes times microseconds, and microseconds with anything allocated."""
    rows = carried(timeline_df, "idx", F.col("ts"), "next_ts", ("query",), back=True, ties=("after",), block=block)
    held = rows.withColumn("dt", F.coalesce(F.col("next_ts") - F.col("ts"), F.lit(0))).filter("after > 0")
    return held.groupBy("query").agg(F.sum(F.col("after").cast("decimal(38,0)") * F.col("dt")).alias("area"), F.sum("dt").cast("bigint").alias("span"))


def utilisation(timeline_df: DataFrame, busy: DataFrame) -> DataFrame:
    """``query, utilisation``: integral of busy bytes over integral of allocated bytes.

    ``busy`` has ``query, begin, end, bytes``; intervals are clipped to nothing
    else, as a busy interval lies where memory is allocated.
    """
    work = busy.groupBy("query").agg(F.sum(F.col("bytes").cast("decimal(38,0)") * (F.col("end") - F.col("begin"))).alias("work"))
    return areas(timeline_df).join(work, "query", "left").select("query", (F.coalesce(F.col("work"), F.lit(0)).cast("double") / F.when(F.col("area") > 0, F.col("area").cast("double"))).alias("utilisation"))


def gantt(trace: DataFrame, block: int = LINES) -> DataFrame:
    """``query, idx, class, begin, end``: a span per call of a known class, and a span of class 5 for the gap before it; times from the query's first line."""
    origin = trace.groupBy("query").agg(F.min("ts").alias("origin"))
    rows = carried(trace, "idx", F.struct("ts", "phase"), "called", ("query", "api"), block=block)
    name = F.when((F.col("api") == "cudaMemcpy") & (F.col("kind") == 1), "H2D").when((F.col("api") == "cudaMemcpy") & (F.col("kind") == 2), "D2H").when(F.col("api").isin("cudaLaunch", "diskIO", "cudaMalloc"), F.col("api"))
    number = F.coalesce(*[F.when(name == k, v) for k, v in CLASSES.items()])
    calls = rows.filter((F.col("phase") == "intercepted") & name.isNotNull() & (F.col("called.phase") == "intercepting")).join(origin, "query").select("query", "idx", number.alias("class"), (F.col("called.ts") - F.col("origin")).alias("begin"), (F.col("ts") - F.col("origin")).alias("end"))
    gaps = carried(calls, "idx", F.col("end"), "before", ("query",), block=block).select("query", "idx", F.lit(CLASSES["other"]).alias("class"), F.coalesce("before", F.lit(0)).alias("begin"), F.col("begin").alias("end"))
    return calls.unionByName(gaps)


def class_stats(spans: DataFrame) -> DataFrame:
    """``class, n, total, mean, least, q1, median, q3, most`` of the spans' durations."""
    d = F.col("end") - F.col("begin")
    at = lambda p, name: F.percentile(d, p).alias(name)
    return spans.groupBy("class").agg(F.count(F.lit(1)).alias("n"), F.sum(d).cast("bigint").alias("total"), F.avg(d).alias("mean"), F.min(d).alias("least"), at(0.25, "q1"), at(0.5, "median"), at(0.75, "q3"), F.max(d).alias("most"))


def footprint_lines(spark: SparkSession, path: str) -> DataFrame:
    """``query, ts, mb`` of the files' lines ``[gvm] time MEMSIZE bytes seconds``; the file name without its ending is the query."""
    lines = spark.read.text(path, wholetext=True).select(F.regexp_extract(F.input_file_name(), r"([^/]+?)(\.[^./]*)?$", 1).alias("query"), F.explode(F.split("value", "\n")).alias("value"))
    return footprint(lines)


def footprint(lines: DataFrame) -> DataFrame:
    """``query, ts, mb`` of ``query, value``; ts in milliseconds from the query's first, other lines dropped."""
    w = F.split("value", r"\s+")
    rows = lines.filter(F.col("value").rlike(r"^\[gvm\]\s+\S+\s+MEMSIZE\s")).select("query", (F.get(w, F.lit(4)).cast("double") * 1000).alias("t"), (F.get(w, F.lit(3)).cast("double") / 1e6).alias("mb"))
    first = rows.groupBy("query").agg(F.min("t").alias("first"))
    return rows.join(first, "query").select("query", (F.col("t") - F.col("first")).alias("ts"), "mb")


def regions(trace: DataFrame, gap: int = 10, block: int = 1 << 30) -> DataFrame:
    """``query, addr, size, base``: each address's largest allocation, stacked from ``gap`` up with ``gap`` between; sums run in blocks of addresses."""
    size = trace.filter("api = 'cudaMalloc' and phase = 'intercepted'").groupBy("query", "addr").agg(F.max("bytes").alias("size"))
    stacked = prefix_sum(size.withColumn("room", F.col("size") + gap), "addr", "room", ("query",), block, "top")
    return stacked.select("query", "addr", "size", (F.col("top") - F.col("size")).cast("bigint").alias("base"))


def from_events(events: DataFrame, queries: int = 7, addresses: int = 40) -> DataFrame:
    """The event table read as a trace: purchases allocate, clicks free, views launch, errors copy in, signups copy out.

    An event makes two lines, the call and its return ``user_id`` microseconds
    later; a view makes an argument line before.
    """
    # a time without a zone counts as UTC, whatever the session's zone
    ts = F.concat(F.col("ts").cast("string"), F.lit("+00:00")).cast("timestamp") if dict(events.dtypes)["ts"] == "timestamp_ntz" else F.col("ts")
    e = events.withColumn("us", F.unix_micros(ts)).withColumn("query", F.concat(F.lit("q"), (F.col("user_id") % queries).cast("string"))).withColumn("addr", (F.col("event_id") % addresses + 1) * PAGE).withColumn("bytes", F.round(F.col("value") * 100).cast("bigint"))
    api = F.when(F.col("event_type") == "purchase", "cudaMalloc").when(F.col("event_type") == "click", "cudaFree").when(F.col("event_type") == "view", "cudaLaunch").otherwise("cudaMemcpy")
    kind = F.when(F.col("event_type") == "error", 1).when(F.col("event_type") == "signup", 2)
    line = lambda k, ts, phase, what, a=None, b=None, c=None, arg=None: F.struct(F.lit(k).alias("k"), ts.cast("long").alias("ts"), F.lit(phase).alias("phase"), what.alias("api"), (a if a is not None else F.lit(None)).cast("long").alias("addr"), (b if b is not None else F.lit(None)).cast("long").alias("bytes"), (c if c is not None else F.lit(None)).cast("int").alias("kind"), (arg if arg is not None else F.lit(None)).cast("long").alias("arg"))
    view = F.col("event_type") == "view"
    back = F.col("us") + F.col("user_id")
    made = F.array(
        F.when(view, line(0, F.col("us"), "intercepted", F.lit("cudaSetupArgument"), arg=F.col("addr") + F.col("bytes") % 64)),
        line(1, F.col("us"), "intercepting", api),
        line(2, back, "intercepted", api, F.when(~view, F.col("addr")), F.when(F.col("event_type").isin("purchase", "error", "signup"), F.col("bytes")), kind),
    )
    rows = e.select("query", "event_id", F.explode(F.filter(made, lambda x: x.isNotNull())).alias("r"))
    return rows.select("query", (F.col("event_id") * 3 + F.col("r.k")).alias("idx"), "r.ts", "r.phase", "r.api", "r.addr", "r.bytes", "r.kind", "r.arg")
