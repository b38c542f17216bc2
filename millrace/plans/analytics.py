"""Queries over encodings, load paths, traces and workloads, each with its oracle."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import predicates as P
from ..operators import encoding as E
from ..operators import trace as T
from ..sources import delimited, ssbgen
from ..sources.catalog import Catalog
from ..sources.schema import parse_schema
from ..streaming import timeline as S
from . import workload as W

BLOCK = 1000
#: Customers that make up a workload.
MIX = 100


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- encodings


def _typed(s: SparkSession, d: str) -> DataFrame:
    return _t(s, d, "events").select("event_id", (F.floor(F.col("value") / 40)).cast("int").alias("v"))


def enc_rle(s, d):
    return E.rle_encode(_typed(s, d), "event_id", "v", BLOCK)


def enc_rle_roundtrip(s, d):
    return E.rle_decode(enc_rle(s, d))


def enc_rle_filter(s, d):
    return E.rle_filter(enc_rle(s, d), F.col("value") >= 2).agg(F.sum("run_length").alias("n"))


def _parts(s, d):
    return _t(s, d, "part").select("p_partkey", "p_brand")


def enc_dict(s, d):
    return E.dict_encode(_parts(s, d), "p_brand")[0]


def enc_dict_roundtrip(s, d):
    return E.dict_decode(*E.dict_encode(_parts(s, d), "p_brand"), "p_brand")


def enc_dict_filter(s, d):
    coded, codes = E.dict_encode(_parts(s, d), "p_brand")
    return E.dict_filter(coded, codes, (F.col("value") == "Brand#3") | (F.col("value") > "Brand#7")).select("p_partkey")


def enc_dict_join(s, d):
    brands = _t(s, d, "part").groupBy("p_brand").agg(F.count(F.lit(1)).alias("n"))
    return E.dict_join(E.dict_encode(_parts(s, d), "p_brand"), E.dict_encode(brands, "p_brand")).select("p_partkey", "n")


def enc_rle_join(s, d):
    return E.rle_join(enc_rle(s, d), _t(s, d, "nation"), "n_nationkey").groupBy("n_name").agg(F.sum("run_length").alias("n"))


def scan_prefix_sum(s, d):
    rows = _t(s, d, "events").select("event_id", F.round(F.col("value") * 100).cast("bigint").alias("cents"))
    return E.prefix_sum(rows, "event_id", "cents", block=BLOCK)


def column_sort(s, d):
    return delimited.column_sort(_t(s, d, "part").select("p_size", "p_partkey"), "p_size")


# --- sources and sinks


def _scratch(s):
    """A folder that the driver and all executors see, new each time."""
    return f"{(s.conf.get('spark.checkpoint.dir', None) or s.conf.get('spark.sql.warehouse.dir')).rstrip('/')}/delimited-{uuid.uuid4().hex}"


def source_delimited(s, d):
    rows = _t(s, d, "customer").select(F.col("c_custkey").cast("int").alias("C_KEY"), F.col("c_name").alias("C_NAME"), F.col("c_acctbal").cast("decimal(18,2)").alias("C_BALANCE"))
    at = _scratch(s)
    delimited.write_delimited(rows, f"{at}/text")
    tables = parse_schema("CUSTOMER|C_KEY:INTEGER|C_NAME:TEXT:25|C_BALANCE:DECIMAL")
    return delimited.load_table(s, tables, "customer", f"{at}/text", f"{at}/customer", sort_by="C_KEY").select("C_KEY", "C_NAME", F.col("C_BALANCE").cast("double").alias("C_BALANCE"))


def source_catalog(s, d):
    at = _scratch(s)
    delimited.write_delimited(_t(s, d, "nation").select("n_nationkey", "n_name", "n_regionkey"), f"{at}/text")
    mine = Catalog(s, f"{at}/databases")
    mine.create("places", "PLACE|P_KEY:INTEGER|P_NAME:TEXT:25|P_REGION:INTEGER")
    mine.load("places", "place", f"{at}/text")
    Catalog(s, f"{at}/databases").restore("places")  # as another session would
    return s.table("place")


def gen_dates(s, d):
    return ssbgen.dates(s).select("d_datekey", "d_year", "d_yearmonthnum", "d_daynuminmonth", "d_daynuminyear", "d_monthnuminyear", "d_weeknuminyear", "d_lastdayinmonthfl")


# --- predicates


def predicate_any_frame(s, d):
    return P.compare_any(_t(s, d, "part"), F.col("p_size"), ">", _t(s, d, "nation").filter("n_regionkey = 3"), "n_nationkey").select("p_partkey", "p_size")


def predicate_all_frame(s, d):
    return P.compare_all(_t(s, d, "part"), F.col("p_size"), "<", _t(s, d, "nation").filter("n_regionkey = 3"), "n_nationkey").select("p_partkey", "p_size")


def predicate_multiset(s, d):
    sizes = _t(s, d, "nation").groupBy("n_regionkey").agg(F.collect_list(F.col("n_nationkey") % 3).alias("xs"))  # 25 rows in all
    return sizes.select("n_regionkey", P.is_a_set(F.col("xs")).alias("is_set"), P.is_empty(F.col("xs")).alias("is_empty"), P.member_of(F.lit(2), F.col("xs")).alias("has_two"), P.submultiset_of(F.array(F.lit(1), F.lit(1)), F.col("xs")).alias("two_ones"))


# --- traces


def _trace(s, d):
    return T.from_events(_t(s, d, "events"))


def trace_parse(s, d):
    return T.parse_lines(T.to_lines(_trace(s, d)))


def trace_pairs(s, d):
    return T.pairs(_trace(s, d))


def trace_deltas(s, d):
    return T.deltas(_trace(s, d))


def trace_timeline(s, d):
    return T.timeline(_trace(s, d), BLOCK)


def trace_steps(s, d):
    return T.steps(trace_timeline(s, d))


def trace_peak(s, d):
    return T.peaks(trace_timeline(s, d), device_bytes=200_000)


def trace_pair_footprint(s, d):
    return T.pair_footprints(trace_peak(s, d).select("query", "peak"), 400_000)


def trace_kernel_usage(s, d):
    return T.kernel_usage(_trace(s, d), block=BLOCK)


def trace_copy_spans(s, d):
    return T.copy_spans(_trace(s, d), block=BLOCK)


def trace_areas(s, d):
    return T.areas(trace_timeline(s, d), BLOCK).select("query", F.col("area").cast("double").alias("area"), "span")


def trace_utilisation(s, d):
    busy = T.copy_spans(_trace(s, d), block=BLOCK).select("query", "begin", "end", "bytes")
    return T.utilisation(trace_timeline(s, d), busy).select("query", F.round("utilisation", 12).alias("utilisation"))


def trace_gantt(s, d):
    return T.gantt(_trace(s, d), block=BLOCK)


def trace_class_stats(s, d):
    return T.class_stats(T.gantt(_trace(s, d), block=BLOCK)).withColumn("mean", F.round("mean", 4))


def trace_footprint(s, d):
    calls = _trace(s, d).filter("api = 'cudaMalloc' and phase = 'intercepted'")
    seconds = F.format_string("%d.%06d", F.expr("ts % 1000000000 div 1000000"), F.col("ts") % 1_000_000)
    lines = calls.select("query", F.concat(F.lit("[gvm] 0 MEMSIZE "), F.col("bytes").cast("string"), F.lit(" "), seconds).alias("value"))
    return T.footprint(lines).select("query", F.round("ts", 3).alias("ts"), "mb")


def trace_regions(s, d):
    return T.regions(_trace(s, d))


# --- streams: the tables read as streams to their end


def _events(s, d):
    """As a stream; the pattern also takes a table that is a single file, which a plain stream path must not be."""
    return s.readStream.schema(_t(s, d, "events").schema).parquet(f"{d}/events.parque[t]")


def stream_windowed_counts(s, d):
    name = f"windowed_{uuid.uuid4().hex}"
    counts = S.windowed_counts(_events(s, d)).writeStream.format("memory").queryName(name).outputMode("complete")  # a row a window and type
    counts.option("checkpointLocation", _scratch(s)).trigger(availableNow=True).start().awaitTermination()
    return s.table(name).select(F.unix_seconds("start").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


def stream_live_bytes(s, d):
    at = _scratch(s)
    live = S.live_bytes(T.from_events(_events(s, d))).writeStream.format("parquet").option("path", f"{at}/live").outputMode("append")
    live.option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start().awaitTermination()
    return s.read.schema(S.LIVE).parquet(f"{at}/live")


# --- workloads: the orders stand for recorded runs, the customers for queries to admit


def _runs(s, d):
    o = _t(s, d, "orders")
    return o.select(F.concat(F.lit("c"), (F.col("o_orderkey") % 12).cast("string")).alias("combo"), F.concat(F.lit("q"), (F.col("o_orderkey") % 12 % 4).cast("string"), F.lit("#0")).alias("query"), (F.floor(F.col("o_orderkey") / 12) % 9 + 1).cast("int").alias("run_no"), F.col("o_totalprice").alias("total_ms"), F.when((F.col("o_orderkey") % 12 == 5) & (F.col("o_orderstatus") == "P"), "boom").otherwise("").alias("error"))


def _solo(s, d):
    return W.solo_stats(_runs(s, d).withColumn("query", F.substring_index("query", "#", 1)))


def corun_solo_avg(s, d):
    return _solo(s, d).select("query", F.round("solo_ms", 6).alias("solo_ms"))


def corun_stats(s, d):
    return W.corun_stats(_runs(s, d)).select("combo", "query", F.round("corun_ms", 6).alias("corun_ms"))


def corun_speedup(s, d):
    return W.weighted_speedup(_runs(s, d), _solo(s, d)).select("combo", F.round("speedup", 9).alias("speedup"))


def corun_context(s, d):
    at = _scratch(s)
    W.save_context(_runs(s, d), at)
    return W.restore_context(s, at)


def corun_crashes(s, d):
    o = _t(s, d, "orders")
    lines = o.select(F.concat(F.lit("c"), (F.col("o_orderkey") % 12).cast("string")).alias("combo"), F.when(F.col("o_orderkey") % 2 == 0, "error").otherwise("trace").alias("stream"), F.when(F.col("o_orderkey") % 7 == 0, F.concat(F.lit("evicting region "), F.col("o_orderstatus"))).otherwise("").alias("line"))
    return W.crash_report(lines)


def corun_triples(s, d):
    names = [r["n_name"] for r in _t(s, d, "nation").filter("n_regionkey = 1").select("n_name").collect()]  # plan names, a few
    return s.createDataFrame(W.combinations(names, 3), "a string, b string, c string")


def corun_pairs(s, d):
    names = [r["n_name"] for r in _t(s, d, "nation").select("n_name").collect()]
    return s.createDataFrame(W.combinations(names, 2, with_itself=True), "a string, b string")


def corun_admission(s, d):
    key = F.col("c_custkey")
    mix = _t(s, d, "customer").select(F.floor(key / MIX).cast("long").alias("workload"), key.cast("long").alias("seq"), F.concat(F.lit("q"), (key % 13).cast("string")).alias("query"), (key % 7 * 100_000_000 + 100_000_000).cast("long").alias("bytes"))
    return W.greedy_batches(mix, workload="workload")


TRACE = """
ev as (select event_id, event_type, epoch_us(ts) as us, user_id, 'q' || (user_id % 7) as query, (event_id % 40 + 1) * 1048576 as a, cast(round(value * 100) as bigint) as b from events),
tr as (
    select query, event_id * 3 as idx, us as ts, 'intercepted' as phase, 'cudaSetupArgument' as api, null as addr, null as bytes, null as kind, a + b % 64 as arg from ev where event_type = 'view'
    union all
    select query, event_id * 3 + 1, us, 'intercepting', case event_type when 'purchase' then 'cudaMalloc' when 'click' then 'cudaFree' when 'view' then 'cudaLaunch' else 'cudaMemcpy' end, null, null, null, null from ev
    union all
    select query, event_id * 3 + 2, us + user_id, 'intercepted', case event_type when 'purchase' then 'cudaMalloc' when 'click' then 'cudaFree' when 'view' then 'cudaLaunch' else 'cudaMemcpy' end,
           case when event_type <> 'view' then a end, case when event_type in ('purchase', 'error', 'signup') then b end, case event_type when 'error' then 1 when 'signup' then 2 end, null from ev),
mf as (select * from tr where phase = 'intercepted' and api in ('cudaMalloc', 'cudaFree')),
pr as (select f.query, f.addr, m.idx as alloc_idx, m.ts as alloc_ts, f.idx as free_idx, f.ts as free_ts, m.bytes
       from mf f asof join (select * from mf where api = 'cudaMalloc') m on f.query = m.query and f.addr = m.addr and f.idx > m.idx where f.api = 'cudaFree'),
dl as (select query, alloc_idx as idx, alloc_ts as ts, bytes as delta from pr union all select query, free_idx, free_ts, -bytes from pr),
tl as (select query, idx, ts, cast(sum(delta) over w - delta as bigint) as "before", cast(sum(delta) over w as bigint) as "after" from dl window w as (partition by query order by idx rows unbounded preceding)),
pk as (select query, max("after") as peak, max("after") > 200000 as over from tl group by query),
cp as (select query, idx, ts as "begin", lead(ts) over w as "end", lead(bytes) over w as bytes, lead(kind) over w as kind, api, phase from tr window w as (partition by query order by idx)),
cs as (select query, idx, "begin", "end", bytes, kind from cp where api = 'cudaMemcpy' and phase = 'intercepting' and "end" is not null),
dt as (select query, "after", coalesce(lead(ts) over (partition by query order by idx, "after") - ts, 0) as d from tl),
ar as (select query, cast(sum(cast("after" as hugeint) * d) as double) as area, cast(sum(d) as bigint) as span from dt where "after" > 0 group by query),
og as (select query, min(ts) as origin from tr group by query),
la as (select tr.*, lag(ts) over w as called, lag(phase) over w as called_phase from tr window w as (partition by query, api order by idx)),
sp as (select la.query, idx, case when api = 'cudaMemcpy' and kind = 1 then 0 when api = 'cudaMemcpy' and kind = 2 then 1 when api = 'cudaLaunch' then 2 when api = 'cudaMalloc' then 4 end as class,
              called - origin as "begin", ts - origin as "end" from la join og on la.query = og.query where phase = 'intercepted' and called_phase = 'intercepting'),
ga as (select query, idx, class, "begin", "end" from sp where class is not null
       union all select query, idx, 5, coalesce(lag("end") over (partition by query order by idx), 0), "begin" from sp where class is not null),
ln as (select query, idx as launch_idx, ts from tr where api = 'cudaLaunch' and phase = 'intercepted'),
ag as (select t.query, t.idx as arg_idx, t.arg, min(l.launch_idx) as launch_idx from tr t join ln l on t.query = l.query and l.launch_idx >= t.idx where t.api = 'cudaSetupArgument' group by all),
hd as (select ag.query, ag.launch_idx, ag.arg_idx, arg_max(p.addr + p.bytes - ag.arg, p.alloc_idx) as bytes from ag join pr p on ag.query = p.query and p.alloc_idx < ag.arg_idx
       where ag.arg >= p.addr and (ag.arg < p.addr + p.bytes or ag.arg = p.addr) group by all)
"""


def _of_trace(select: str) -> str:
    return f"with {TRACE} {select}"


_RUNS = """
runs as (select 'c' || (o_orderkey % 12) as combo, 'q' || (o_orderkey % 12 % 4) || '#0' as query, cast(o_orderkey // 12 % 9 + 1 as integer) as run_no, o_totalprice as total_ms,
                case when o_orderkey % 12 = 5 and o_orderstatus = 'P' then 'boom' else '' end as error from orders),
solo as (select split_part(query, '#', 1) as query, avg(total_ms) as solo_ms from runs where run_no > 1 group by all)
"""
_RLE = """
typed as (select event_id, cast(floor(value / 40) as integer) as v from events),
marked as (select *, case when lag(v) over w is distinct from v or row_number() over w = 1 then 1 else 0 end as s from typed window w as (order by event_id)),
numbered as (select *, sum(s) over (order by event_id) as run from marked),
rle as (select min(event_id) as pos, min(v) as value, count(*) as run_length from numbered group by run)
"""
_DICT = "codes as (select value, row_number() over (order by value) - 1 as code from (select distinct p_brand as value from part where p_brand is not null))"

ORACLES = {
    "enc_rle": f"with {_RLE} select * from rle",
    "enc_rle_roundtrip": f"with {_RLE} select event_id as pos, v as value from typed",
    "enc_rle_filter": f"with {_RLE} select cast(sum(run_length) as bigint) as n from rle where value >= 2",
    "enc_dict": f"with {_DICT} select p_partkey, cast(code as integer) as code from part join codes on p_brand = value",
    "enc_dict_roundtrip": "select p_partkey, p_brand from part",
    "enc_dict_filter": "select p_partkey from part where p_brand = 'Brand#3' or p_brand > 'Brand#7'",
    "enc_dict_join": "select p_partkey, count(*) over (partition by p_brand) as n from part",
    "enc_rle_join": "select n_name, count(*) as n from events join nation on cast(floor(value / 40) as integer) = n_nationkey group by n_name",
    "source_delimited": "select cast(c_custkey as integer) as C_KEY, c_name as C_NAME, cast(cast(c_acctbal as decimal(18, 2)) as double) as C_BALANCE from customer",
    "source_catalog": "select n_nationkey as P_KEY, n_name as P_NAME, n_regionkey as P_REGION from nation",
    "gen_dates": "select cast(strftime(t, '%Y%m%d') as integer) as d_datekey, cast(year(t) as integer) as d_year, cast(year(t) * 100 + month(t) as integer) as d_yearmonthnum, cast(day(t) as integer) as d_daynuminmonth, cast(dayofyear(t) as integer) as d_daynuminyear, cast(month(t) as integer) as d_monthnuminyear, cast(week(t) as integer) as d_weeknuminyear, cast(last_day(t) = t as integer) as d_lastdayinmonthfl from (select cast(date '1992-01-01' + cast(i as integer) as date) as t from range(2557) r(i)) x",
    "trace_parse": _of_trace("select query, idx, ts, phase, api, addr, bytes, kind, arg from tr"),
    "scan_prefix_sum": "select event_id, cast(round(value * 100) as bigint) as cents, cast(sum(cast(round(value * 100) as bigint)) over (order by event_id) as bigint) as prefix from events",
    "column_sort": "select p_size, p_partkey from part order by p_size",
    "predicate_any_frame": "select p_partkey, p_size from part where p_size > (select min(n_nationkey) from nation where n_regionkey = 3)",
    "predicate_all_frame": "select p_partkey, p_size from part where p_size < (select min(n_nationkey) from nation where n_regionkey = 3)",
    "predicate_multiset": "select n_regionkey, count(*) = count(distinct n_nationkey % 3) as is_set, count(*) = 0 as is_empty, count(*) filter (n_nationkey % 3 = 2) > 0 as has_two, count(*) filter (n_nationkey % 3 = 1) >= 2 as two_ones from nation group by n_regionkey",
    "trace_pairs": _of_trace("select * from pr"),
    "trace_deltas": _of_trace("select * from dl"),
    "trace_timeline": _of_trace("select * from tl"),
    "trace_steps": _of_trace('select query, idx, ts, 0 as step, "before" as bytes from tl union all select query, idx, ts, 1, "after" from tl'),
    "trace_peak": _of_trace("select * from pk"),
    "trace_pair_footprint": _of_trace("select a.query as query_a, b.query as query_b, a.peak + b.peak as bytes, a.peak + b.peak > 400000 as over from pk a join pk b on a.query <= b.query"),
    "trace_kernel_usage": _of_trace("select ln.query, ln.launch_idx, ln.ts, cast(coalesce(s.bytes, 0) as bigint) as bytes from ln left join (select query, launch_idx, sum(bytes) as bytes from hd group by all) s on ln.query = s.query and ln.launch_idx = s.launch_idx"),
    "trace_copy_spans": _of_trace("select * from cs"),
    "trace_areas": _of_trace("select * from ar"),
    "trace_utilisation": _of_trace('select ar.query, round(cast(coalesce(work, 0) as double) / area, 12) as utilisation from ar left join (select query, sum(cast(bytes as hugeint) * ("end" - "begin")) as work from cs group by query) b on ar.query = b.query'),
    "trace_gantt": _of_trace("select * from ga"),
    "trace_class_stats": _of_trace('select class, count(*) as n, cast(sum("end" - "begin") as bigint) as total, round(avg("end" - "begin"), 4) as mean, min("end" - "begin") as least, max("end" - "begin") as most, quantile_cont(cast("end" - "begin" as double), 0.25) as q1, quantile_cont(cast("end" - "begin" as double), 0.5) as median, quantile_cont(cast("end" - "begin" as double), 0.75) as q3 from ga group by class'),
    "trace_footprint": _of_trace("select query, round((ts % 1000000000 - min(ts % 1000000000) over (partition by query)) / 1000.0, 3) as ts, bytes / 1e6 as mb from tr where api = 'cudaMalloc' and phase = 'intercepted'"),
    "trace_regions": _of_trace("select query, addr, size, cast(coalesce(sum(size + 10) over (partition by query order by addr rows between unbounded preceding and 1 preceding), 0) + 10 as bigint) as base from (select query, addr, max(bytes) as size from tr where api = 'cudaMalloc' and phase = 'intercepted' group by all)"),
    "stream_windowed_counts": "select cast(epoch(date_trunc('hour', ts)) as bigint) as start, event_type, count(*) as n, round(sum(value), 4) as total from events group by all",
    "stream_live_bytes": _of_trace(""", st as (select query, addr, idx, ts, case when api = 'cudaMalloc' then bytes else 0 end as live, lag(case when api = 'cudaMalloc' then bytes else 0 end, 1, 0) over (partition by query, addr order by idx) as had from mf)
        select query, idx, ts, cast(sum(live - had) over (partition by query order by idx rows unbounded preceding) as bigint) as bytes_live from st"""),
    "corun_solo_avg": f"with {_RUNS} select query, round(solo_ms, 6) as solo_ms from solo",
    "corun_stats": f"with {_RUNS} select combo, query, round(avg(total_ms), 6) as corun_ms from runs where run_no between 2 and 6 group by all",
    "corun_speedup": f"with {_RUNS}, st as (select combo, query, avg(total_ms) as ms from runs where run_no between 2 and 4 and combo not in (select combo from runs where error <> '') group by all) select combo, round(sum(solo_ms / ms), 9) as speedup from st join solo on split_part(st.query, '#', 1) = solo.query group by combo",
    "corun_context": f"with {_RUNS} select * from runs",
    "corun_crashes": "with l as (select 'c' || (o_orderkey % 12) as combo, o_orderkey % 2 = 0 as err, case when o_orderkey % 7 = 0 then 'evicting region ' || o_orderstatus else '' end as line from orders) select combo, bool_or(err and line <> '') as crashed, bool_or(not err and contains(line, 'evicting region')) as evicted from l group by combo",
    "corun_triples": "with n as (select n_name as x from nation where n_regionkey = 1) select a.x as a, b.x as b, c.x as c from n a join n b on a.x < b.x join n c on b.x < c.x",
    "corun_pairs": "select a.n_name as a, b.n_name as b from nation a join nation b on a.n_name <= b.n_name",
    "corun_admission": f"""
        with recursive mix as (select c_custkey // {MIX} as workload, c_custkey as seq, 'q' || (c_custkey % 13) as query, c_custkey % 7 * 100000000 + 100000000 as bytes, row_number() over (partition by c_custkey // {MIX} order by c_custkey) as k from customer),
        go as (select k, workload, seq, query, bytes, bytes as total, 0 as batch from mix where k = 1
               union all select m.k, m.workload, m.seq, m.query, m.bytes, case when g.total + m.bytes > 1600000000 then m.bytes else g.total + m.bytes end, case when g.total + m.bytes > 1600000000 then g.batch + 1 else g.batch end
               from go g join mix m on m.workload = g.workload and m.k = g.k + 1)
        select workload, seq, query, bytes, cast(batch as integer) as batch from go""",
}


def queries() -> dict:
    return {n: globals()[n] for n in ORACLES}


def oracles() -> dict[str, str]:
    return dict(ORACLES)
