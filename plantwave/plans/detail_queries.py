"""Queries on scans, imports, detectors by control type, gates, and places of alerts; each with its DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.signals import THRESHOLDS, control_type, normalise, quality
from ..operators import diagnosis, kpi, outliers, reports, rollup, rules, segments, sensors
from ..sources.stand_ins import LEDGER_SQL, NODES_SQL, SAMPLES_SQL, SNAPSHOTS_SQL, WORK_SQL, ledger, orders_of_work, plant_nodes, samples, snapshots, table
from ..sources.tables import keep_or_overwrite, payload_rows, tag_column, validated
from ..streaming import samples as stream

KEYS, BY = ["loop_id"], ["ts", "event_id"]
QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str):
    def keep(f):
        QUERIES[f.__name__], SQL[f.__name__] = f, sql
        return f

    return keep


# --- scans and imports


@query("select event_id, user_id, value from events where ts >= timestamp '2024-01-02' and ts <= timestamp '2024-01-04' and user_id in (1, 2, 3, 5, 8, 13)")
def range_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A time range of some loops, closed at both ends; filters and columns reach the files."""
    ts = F.col("ts")
    inside = (ts >= F.to_timestamp_ntz(F.lit("2024-01-02 00:00:00"))) & (ts <= F.to_timestamp_ntz(F.lit("2024-01-04 00:00:00")))
    return table(spark, sf_dir, "events").where(inside & F.col("user_id").isin(1, 2, 3, 5, 8, 13)).select("event_id", "user_id", "value")


_SUFFIXES = ["PV", "sp", "OP", "CV", "MV", "MODE", "P", "i", "D", "X"]
_TAG = f"'U' || c_nationkey || '.' || c_custkey || (case when c_custkey % 2 = 0 then '.' else '_' end) || {_SUFFIXES}[(c_custkey % 10)::int + 1]"


@query(f"with t as (select c_custkey, {_TAG} as tag, lower({_SUFFIXES}[(c_custkey % 10)::int + 1]) as suffix from customer) select c_custkey, tag, left(tag, len(tag) - len(suffix) - 1) as loop, case when suffix in ('pv', 'sp', 'op', 'mode') then suffix when suffix in ('cv', 'mv') then 'op' when suffix in ('p', 'i', 'd') then 'pid_' || suffix end as signal from t")
def tag_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Loop and signal of tags by their suffix."""
    key = F.col("c_custkey")
    tag = F.concat(F.lit("U"), F.col("c_nationkey"), F.lit("."), key, F.when(key % 2 == 0, ".").otherwise("_"), F.element_at(F.array(*map(F.lit, _SUFFIXES)), (key % 10).cast("int") + 1))
    df = table(spark, sf_dir, "customer").select("c_custkey", tag.alias("tag"))
    loop, signal = tag_column("tag")
    return df.select("c_custkey", "tag", loop.alias("loop"), signal.alias("signal"))


@query(f"with {SAMPLES_SQL} select loop_id, event_id, pv, op, mode::int as mode, case when quality in (0, 1) then quality::int end as pv_quality from s")
def history_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Payloads of parallel arrays, a loop and day each, back as rows."""
    df = samples(spark, sf_dir)
    cells = F.array_sort(F.collect_list(F.struct("ts", "event_id", "pv", "sp", "op", "mode", "quality")))
    packed = df.groupBy("loop_id", F.to_date("ts").alias("day")).agg(cells.alias("c"))
    payload = packed.select("loop_id", F.col("c.ts").alias("ts"), F.col("c.pv").alias("pv"), F.col("c.event_id").cast("array<double>").alias("sp"), F.col("c.op").alias("op"), F.col("c.mode").alias("mode"), F.col("c.quality").alias("quality"))
    return payload_rows(payload).select("loop_id", F.col("sp").cast("long").alias("event_id"), "pv", "op", "mode", "pv_quality")


_CONFLICT = f"with {SAMPLES_SQL}, o as (select loop_id, event_id // 3 as slot, 'old' as source from s where mode < 2), n as (select loop_id, event_id // 3 as slot, 'new' as source from s where mode >= 2), od as (select distinct * from o), nd as (select distinct * from n) "


@query(_CONFLICT + "select 'overwrite' as strategy, * from nd union all select 'overwrite', * from od where not exists (select 1 from nd where nd.loop_id = od.loop_id and nd.slot = od.slot) union all select 'keep', * from od union all select 'keep', * from nd where not exists (select 1 from od where od.loop_id = nd.loop_id and od.slot = nd.slot)")
def import_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Imports over stored rows: new ones replace the old ones, or fill gaps only."""
    df = samples(spark, sf_dir).withColumn("ts", F.floor(F.col("event_id") / 3))
    part = lambda new, name: df.where((F.col("mode") >= 2) == new).select("loop_id", "ts", F.lit(name).alias("source")).distinct()
    out = [keep_or_overwrite(part(False, "old"), part(True, "new"), over).select(F.lit(name).alias("strategy"), "loop_id", F.col("ts").alias("slot"), "source") for name, over in (("overwrite", True), ("keep", False))]
    return out[0].unionByName(out[1])


@query(f"with {LEDGER_SQL}, c as (select loop_id, list_filter([case when weight is null then 'weight: empty' end, case when not coalesce(level between 1 and 3, false) then 'level: wrong' end, case when not coalesce(weight >= 0, false) then 'weight: wrong' end], lambda x: x is not null) as e from l) select loop_id, array_to_string(e, '; ') as errors from c where len(e) > 0")
def row_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of a sheet that an import refuses, and why."""
    out = validated(ledger(spark, sf_dir), ["weight"], {"level": F.col("level").between(1, 3), "weight": F.col("weight") >= 0})
    return out.where(F.size("errors") > 0).select("loop_id", F.array_join("errors", "; ").alias("errors"))


@query(f"with {SAMPLES_SQL}, a as (select loop_id, date_trunc('hour', ts) as slot, ts, event_id, pv, case when event_id % 10 = 0 then 'late' else 'stored' end as source from s), r as (select *, row_number() over (partition by loop_id, slot, source order by event_id desc) as rn from a) select loop_id, slot::timestamp as slot, source, pv from r t where rn = 1 and (source = 'late' or not exists (select 1 from a where a.loop_id = t.loop_id and a.slot = t.slot and a.source = 'late'))")
def late_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Late rows replace stored ones of the same time; of several the last written counts."""
    df = samples(spark, sf_dir).select("loop_id", F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("slot"), "event_id", "pv", F.when(F.col("event_id") % 10 == 0, "late").otherwise("stored").alias("source"))
    key = ["loop_id", "slot"]
    stored = segments.last_write(df.where("source = 'stored'"), key, [F.desc("event_id")])
    return segments.upsert(stored, df.where("source = 'late'"), key, "event_id").select(*key, "source", "pv")


# --- detectors


def _typed_sql() -> str:
    case = lambda name, scale=1.0: "case kind " + " ".join(f"when '{k}' then {t[name] * scale}" for k, t in THRESHOLDS.items()) + " end"
    still = lambda n: f"count(*) over (w rows between current row and {n - 1} following) = {n} and stddev_pop(x) over (w rows between current row and {n - 1} following) < {case('frozen', 100)}"
    return f"""with {SAMPLES_SQL}, k as (select *, ['FC', 'PC', 'TC', 'LC', 'CC'][(loop_id % 5)::int + 1] as kind, pv / 500 * 100 as x from s),
 a as (select *, lag(x) over w as p, lead(x) over w as q, case when kind in ('FC', 'PC') then {still(5)} else {still(6)} end as still from k window w as (partition by loop_id order by ts, event_id)),
 b as (select *, case when kind in ('FC', 'PC') then bool_or(still) over (w rows between 4 preceding and current row) else bool_or(still) over (w rows between 5 preceding and current row) end as frozen from a window w as (partition by loop_id order by ts, event_id))
 select event_id, kind, array_to_string(list_filter([case when x < 0 or x > 100 then 'OUT_OF_RANGE' end, case when frozen then 'FROZEN' end, case when abs(x - p) > {case('jump', 100)} then 'JUMP' end, case when abs(x - p) > {case('spike', 100)} and abs(x - q) > {case('spike', 100)} then 'SPIKE' end, case when quality = 0 then 'QC_BAD' end], lambda r: r is not null), ',') as reasons from b"""


@query(_typed_sql())
def detectors_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each loop's samples by the thresholds of its control type: flow, pressure, temperature, level, composition."""
    kinds = F.element_at(F.array(*map(F.lit, THRESHOLDS)), (F.col("loop_id") % 5).cast("int") + 1)
    df = samples(spark, sf_dir).withColumns({"pv": normalise("pv", 0, 500), "kind": kinds})
    out = outliers.detect(df, "pv", KEYS, BY, 0, 100, F.col("kind"), "quality")
    return out.select("event_id", "kind", F.array_join("pv_reasons", ",").alias("reasons"))


@query(f"with {SAMPLES_SQL}, a as (select *, epoch_us(ts) - epoch_us(lag(ts) over w) as step, count(*) over (partition by loop_id, ts) as same from s window w as (partition by loop_id order by ts, event_id)) select event_id, coalesce(step <= 0 or step > 2 * 43200000000, false) or same > 1 as anomaly from a")
def timestamp_anomalies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeated times, and gaps of more than twice the interval (half a day here)."""
    return samples(spark, sf_dir).select("event_id", outliers.ts_anomaly("ts", KEYS, BY, 43_200).alias("anomaly"))


_VALID = f"with {SAMPLES_SQL}, k as (select *, pv / 500 * 100 as x, op / 100 * 100 as o from s), v as (select *, x is not null and x between 0 and 100 and not coalesce(abs(x - lag(x) over w) > 80, false) and not coalesce(abs(x - lag(x) over w) > 50 and abs(x - lead(x) over w) > 50, false) and coalesce(quality <> 0, true) as pv_valid, o is not null and o between 0 and 100 and not coalesce(abs(o - lag(o) over w) > 80, false) and not coalesce(abs(o - lag(o) over w) > 50 and abs(o - lead(o) over w) > 50, false) as op_valid from k window w as (partition by loop_id order by ts, event_id))"


@query(_VALID + " select event_id, pv_valid, op_valid, pv_valid and op_valid as all_valid from v")
def signal_validity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sample is valid if all its signals are; the set point is constant here."""
    out = outliers.preprocess(samples(spark, sf_dir), KEYS, BY, (0, 500))
    return out.select("event_id", "pv_valid", "op_valid", "all_valid")


@query(_VALID + ", g as (select loop_id, count(*) as points, count_if(pv_valid) as valid, count_if(pv is null) as absent, floor((epoch(max(ts)) - epoch(min(ts))) / 43200)::bigint + 1 as expected from v group by 1) select loop_id, points, valid, absent, expected, round_even(valid / points, 4) as valid_rate, round_even(absent / points, 4) as missing_rate, round_even(1 - valid / points, 4) as bad_rate from g")
def quality_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and rates of a loop's samples against what span and interval let expect."""
    df = outliers.detect(samples(spark, sf_dir).withColumn("pv", normalise("pv", 0, 500)), "pv", KEYS, BY, 0, 100, "FC", "quality")
    return outliers.quality_summary(df, KEYS, "pv", "ts", 43_200)


_CODES = f"with {SAMPLES_SQL}, c as (select loop_id, case when event_id % 9 = 0 then 'U' when quality = 0 then 'B' else 'G' end as code, row_number() over (partition by loop_id order by ts, event_id) as i from s), r as (select *, i - row_number() over (partition by loop_id, code order by i) as run from c), l as (select loop_id, count(*) as length from r where code = 'B' group by loop_id, run), m as (select loop_id, max(length) as longest, bool_or(length > 3) as lasting, bool_or(length between 2 and 3) as brief from l group by 1), g as (select c.loop_id, count(*) as points, count_if(code = 'B') as bad, avg((code = 'B')::int) as share, avg((code = 'U')::int) as unsure, coalesce(max(longest), 0) as longest, coalesce(bool_or(lasting), false) as lasting, coalesce(bool_or(brief), false) as brief from c left join m on m.loop_id = c.loop_id group by 1), q as (select *, case when longest > 5 then 'Q001' when lasting then 'Q004' when share > 0.1 then 'Q002' when unsure > 0.2 then 'Q003' when brief then 'Q005' else 'NORMAL' end as rule from g)"


@query(_CODES + " select loop_id, points, bad, longest, round(share, 6) as bad_share, round(unsure, 6) as uncertain_share, rule, case when rule = 'Q001' then case when longest * 10 > 600 then 0.9 when longest * 10 > 60 then 0.75 else 0.6 end when rule = 'Q004' then 0.8 when rule in ('Q002', 'Q003') then 0.6 when rule = 'Q005' then 0.4 else 0 end::double as confidence from q")
def quality_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quality rule that a loop's codes break, by runs of Bad; shorter runs than the rules' own, as loops have few samples here."""
    status = F.when(F.col("event_id") % 9 == 0, "Unknown").otherwise(quality("quality"))
    out = sensors.quality_rules(samples(spark, sf_dir).withColumn("quality_status", status), KEYS, BY, interval=10.0, long_run=5, run=3, short=(2, 3))
    return out.withColumns({c: F.round(c, 6) for c in ("bad_share", "uncertain_share")})


@query(_VALID + ", g as (select loop_id, count(*) as points, avg(pv_valid::int) as valid, 1 - count(*) / (floor((epoch(max(ts)) - epoch(min(ts))) / 28000) + 1) as gaps from v group by 1) select loop_id, points, round(greatest(0, least(1, gaps)), 6) as gaps, points >= 32 and valid >= 0.2 and gaps <= 0.3 as passed from g")
def data_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows that are fit for a diagnosis: points, valid share, and points missing against the expected ones."""
    df = outliers.detect(samples(spark, sf_dir).withColumn("pv", normalise("pv", 0, 500)), "pv", KEYS, BY, 0, 100, "FC", "quality")
    return diagnosis.gate(df, KEYS, diagnosis.expected_points("ts", 28_000)).select("loop_id", "points", F.round("gaps", 6).alias("gaps"), "passed")


def _sensor_sql(window: int, x: str, sp: str) -> str:
    return f"""with {SAMPLES_SQL}, a as (select loop_id, ts, event_id, {x} as x, {sp} as sp from s), b as (select *, row_number() over w - 1 as i, count(*) over (partition by loop_id) as n, count(*) over y = {window} and stddev_pop(x) over y < 0.0001 as still from a where x is not null
  window w as (partition by loop_id order by ts, event_id), y as (partition by loop_id order by ts, event_id rows between current row and {window - 1} following)),
 r as (select loop_id, max(len) as run from (select loop_id, count(*) as len from (select *, i - row_number() over (partition by loop_id, still order by i) as g from b) where still group by loop_id, g) group by 1),
 h as (select *, n // 2 as split, greatest(10, least(30, (n // 2) // 4, (n - n // 2) // 4)) as win from b),
 z as (select p.loop_id, p.i, p.i < p.split as early, case when stddev_pop(q.x) < 1e-6 * any_value(d.sd) then 0 else stddev_pop(q.x) end as sd from h p join (select loop_id, stddev_pop(x) as sd from b group by 1) d on d.loop_id = p.loop_id join h q on q.loop_id = p.loop_id and q.i between p.i - p.win + 1 and p.i and (q.i < q.split) = (p.i < p.split)
  where p.split >= 16 and (case when p.i < p.split then p.i else p.i - p.split end) >= p.win - 1 group by p.loop_id, p.i, p.split),
 m as (select loop_id, median(sd) filter (where early) as m1, median(sd) filter (where not early) as m2 from z group by 1),
 d as (select loop_id, count(*) as n, stddev_pop(x) as sd, {', '.join(f'avg(case when i // (n // 5) = {k} then {c} end) as {v}{k}' for v, c in (('x', 'x'), ('s', 'sp')) for k in range(5))} from b group by 1),
 f as (select d.*, case when run > 0 then run + {window - 1} else 0 end as frozen, case when m1 is null or m2 is null then 1 when least(m1, m2) > 1e-12 then greatest(m1, m2) / least(m1, m2) when greatest(m1, m2) > 1e-12 then 999 else 1 end as noise, case when n // 5 >= 4 then x4 - x0 else 0 end as drift from d left join r on r.loop_id = d.loop_id left join m on m.loop_id = d.loop_id),
 t as (select *, case when n < 32 then null when frozen / n > 0.2 then 'frozen' when noise > 3 then 'noisy' when n // 5 >= 4 and ((x1 > x0 and x2 > x1 and x3 > x2 and x4 > x3) or (x1 < x0 and x2 < x1 and x3 < x2 and x4 < x3)) and abs(drift) > 2 * sd and not ((s4 - s0) * drift > 0 and abs(s4 - s0) >= 0.5 * abs(drift)) then 'drift' end as subtype from f)
 select loop_id, n as points, frozen::bigint as frozen_segment, round(noise, 5) as noise_ratio, round(drift, 5) as drift, subtype, case subtype when 'frozen' then 0.85 when 'noisy' then 0.7 when 'drift' then 0.65 else 0 end::double as confidence from t"""


def _sensors(spark: SparkSession, sf_dir: str, window: int, x: Column, sp: Column) -> DataFrame:
    df = samples(spark, sf_dir).select("loop_id", "ts", "event_id", x.alias("x"), sp.alias("sp"))
    out = sensors.sensor_faults(df, "x", "sp", KEYS, BY, frozen_window=window)
    return out.select("loop_id", "points", F.col("frozen_segment").cast("long").alias("frozen_segment"), F.round("noise_ratio", 5).alias("noise_ratio"), F.round("drift", 5).alias("drift"), "subtype", "confidence")


@query(_sensor_sql(12, "case when loop_id % 3 = 0 and event_id % 4000 < 2000 then 7.0 else pv end", "sp"))
def sensor_frozen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sensors of which a third stands still for a time; windows of 12 samples, as loops have at most 99 here."""
    return _sensors(spark, sf_dir, 12, F.when((F.col("loop_id") % 3 == 0) & (F.col("event_id") % 4000 < 2000), 7.0).otherwise(F.col("pv")), F.col("sp"))


@query(_sensor_sql(300, "case when epoch(ts) < 1705276800 and loop_id % 2 = 0 then pv / 20 else pv end", "sp"))
def sensor_noise(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sensors that grow noisy: half of them much quieter before a time."""
    quiet = (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6 < 1_705_276_800) & (F.col("loop_id") % 2 == 0)
    return _sensors(spark, sf_dir, 300, F.when(quiet, F.col("pv") / 20).otherwise(F.col("pv")), F.col("sp"))


@query(_sensor_sql(300, "pv / 1000 + epoch(ts) / 50000 * (1 + loop_id % 3)", "case when loop_id % 4 = 0 then epoch(ts) / 50000 else sp end"))
def sensor_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sensors that drift, of a fourth the set point moves along."""
    at = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    return _sensors(spark, sf_dir, 300, F.col("pv") / 1000 + at / 50_000 * (1 + F.col("loop_id") % 3), F.when(F.col("loop_id") % 4 == 0, at / 50_000).otherwise(F.col("sp")))


# --- indicators and labels


@query(f"with {LEDGER_SQL}, c as (select loop_id, case when loop_id % 3 = 0 then loop_id % 50 end as manual, case when loop_id % 2 = 0 then 5.0 + loop_id % 9 end as tau, case when loop_id % 4 < 3 then (loop_id % 4)::double end as theta, case loop_type when 'FLOW' then 30.0 when 'PRESSURE' then 60.0 when 'TEMPERATURE' then 180.0 when 'LEVEL' then 600.0 else 30.0 end as fallback, 20.0 + loop_id % 200 as actual from l), i as (select *, case when manual > 0 then manual::double when tau + theta > 0 then 3 * (tau + theta) else fallback end as ideal from c) select loop_id, round(ideal, 6) as ideal, round(case when actual <= ideal then 100 else 100 * exp(-(actual - ideal) / ideal) end, 6) as fast_rate from i")
def fast_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Settling times against the ideal one: set by hand, from the model, or the type's."""
    i = F.col("loop_id")
    df = ledger(spark, sf_dir).withColumns({"manual": F.when(i % 3 == 0, (i % 50).cast("double")), "tau": F.when(i % 2 == 0, 5.0 + i % 9), "theta": F.when(i % 4 < 3, (i % 4).cast("double")), "actual": 20.0 + i % 200})
    df = df.withColumn("ideal", kpi.ideal_settling(F.col("manual"), F.col("tau"), F.col("theta"), control_type("loop_type")))
    return df.select("loop_id", F.round("ideal", 6).alias("ideal"), F.round(kpi.fast_rate(F.col("actual"), F.col("ideal")), 6).alias("fast_rate"))


_LABELS = ("OVERSHOOT", "SLOW", "STICTION", "OSCILLATION", "SATURATION")


@query(f"with f as (select l_suppkey as loop_id, {list(_LABELS)}[(l_partkey % 5)::int + 1] as label, l_discount * 5 + l_quantity / 1000 + 0.2 as confidence, l_orderkey * 10 + l_linenumber as finding, l_tax as tax, case when l_linenumber % 2 = 0 then l_quantity end as quantity from lineitem), r as (select *, row_number() over (partition by loop_id, label order by confidence desc, finding desc) as rn from f), p as (select loop_id, label, max(confidence) as confidence, 1 / (1 + exp(-sum(ln(confidence) - ln(1 - confidence)))) as fused, count(*) as n, first(tax order by rn) as tax, first(quantity order by rn) filter (where quantity is not null) as quantity, string_agg(finding::varchar, ',' order by rn) filter (where rn between 2 and 4) as others from r group by 1, 2) select loop_id, label, round(confidence, 6) as confidence, round(case when n = 1 then confidence else fused end, 6) as fused, tax, quantity, n - 1 as n_others, coalesce(others, '') as others from p")
def label_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One record of each label: the surest finding's, features filled from the others, which stay as evidence."""
    c = F.col
    features = F.map_filter(F.create_map(F.lit("tax"), c("l_tax"), F.lit("quantity"), F.when(c("l_linenumber") % 2 == 0, c("l_quantity"))), lambda k, v: v.isNotNull())
    df = table(spark, sf_dir, "lineitem").select(c("l_suppkey").alias("loop_id"), F.element_at(F.array(*map(F.lit, _LABELS)), (c("l_partkey") % 5).cast("int") + 1).alias("label"), (c("l_discount") * 5 + c("l_quantity") / 1000 + 0.2).alias("confidence"), (c("l_orderkey") * 10 + c("l_linenumber")).alias("finding"), features.alias("features"))
    out = diagnosis.distinct_labels(df, KEYS, "finding")
    told = F.array_join(F.transform(F.slice("others", 1, 3), lambda o: o["finding"].cast("string")), ",")
    return out.select("loop_id", "label", F.round("confidence", 6).alias("confidence"), F.round("fused", 6).alias("fused"), c("features")["tax"].alias("tax"), c("features")["quantity"].alias("quantity"), F.size("others").cast("long").alias("n_others"), told.alias("others"))


@query(f"with {SNAPSHOTS_SQL}, c as (select snapshot_id, score, auto_rate / 37 as confidence, snapshot_id % 9 = 0 as poor from k) select snapshot_id, case when poor then null when score < 40 and confidence >= 0.8 then 'HIGH' when score < 60 or confidence >= 0.6 then 'MEDIUM' else 'LOW' end as severity from c")
def severities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How grave a diagnosis is; windows without enough data have no severity."""
    primary = F.when(F.col("snapshot_id") % 9 == 0, "DATA_INSUFFICIENT").otherwise("TUNING")
    return snapshots(spark, sf_dir).select("snapshot_id", diagnosis.severity(F.col("score"), F.col("auto_rate") / 37, primary).alias("severity"))


@query(f"with {WORK_SQL}, r as (select order_id, line, l_partkey, loop_id, state, started, row_number() over (partition by loop_id, state order by started desc, order_id desc, line desc, l_partkey desc) as rn from w) select loop_id, state, order_id, line, l_partkey, started from r where rn = 1")
def latest_by_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest result of each label of a loop."""
    df = orders_of_work(spark, sf_dir)
    return reports.latest(df, ["loop_id", "state"], F.desc("started"), F.desc("order_id"), F.desc("line"), F.desc("l_partkey")).select("loop_id", "state", "order_id", "line", "l_partkey", "started")


# --- alerts, places, trees


_PLACES = f"with {SAMPLES_SQL}, {LEDGER_SQL}, {NODES_SQL} "


@query(_PLACES + "select s.event_id, l.loop_id, l.tag, u.id as unit, f.id as area from s join l on l.loop_id = s.loop_id left join n u on u.id = l.unit_id + 100 left join n f on f.id = u.parent_id where s.quality = 0")
def alert_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alerts with their loop, and the loop's place two steps up the plant's tree."""
    nodes = plant_nodes(spark, sf_dir)
    unit, area = nodes.select(F.col("id").alias("unit"), "parent_id"), nodes.select(F.col("id").alias("area"))
    df = samples(spark, sf_dir).where("quality = 0").select("event_id", "loop_id").join(ledger(spark, sf_dir), "loop_id")
    df = df.join(unit, F.col("unit_id") + 100 == F.col("unit"), "left").join(area, F.col("parent_id") == F.col("area"), "left")
    return df.select("event_id", "loop_id", "tag", "unit", "area")


@query(f"with recursive {NODES_SQL}, {LEDGER_SQL}, t(root, node) as (select id, id from n union all select t.root, n.id from t join n on n.parent_id = t.node) select root, loop_type, count(*) as loops from t join l on l.unit_id + 100 = t.node group by 1, 2")
def subtree_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many loops of each type lie below a node."""
    pairs = rollup.descendants(plant_nodes(spark, sf_dir)).select("root", (F.col("node") - 100).alias("unit_id"))
    return ledger(spark, sf_dir).join(pairs, "unit_id").groupBy("root", "loop_type").agg(F.count(F.lit(1)).alias("loops"))


_ITEMS = f"with {WORK_SQL}, q as (select loop_id, min(case state when 'OPEN' then 0 when 'ACKNOWLEDGED' then 1 when 'IN_PROGRESS' then 2 else 3 end) as stage, max(started) as newest, count(*) as items, array_to_string(list_sort(list(order_id || '-' || line || '-' || l_partkey)), ' ') as listed from w where state in ('OPEN', 'ACKNOWLEDGED', 'IN_PROGRESS') group by 1)"


@query(_ITEMS + " select loop_id, stage::int as stage, newest, items, listed, (select count(*) from q) > 20 as truncated from q order by stage, newest desc, loop_id limit 10 offset 10")
def attention_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second page of ten loops of the queue, each with its items, and whether more than twenty loops wait."""
    df = orders_of_work(spark, sf_dir).where("state in ('OPEN', 'ACKNOWLEDGED', 'IN_PROGRESS')")
    stage = F.when(F.col("state") == "OPEN", 0).when(F.col("state") == "ACKNOWLEDGED", 1).otherwise(2)
    item = F.concat_ws("-", "order_id", "line", "l_partkey")
    queue = df.groupBy("loop_id").agg(F.min(stage).alias("stage"), F.max("started").alias("newest"), F.count(F.lit(1)).alias("items"), F.array_join(F.array_sort(F.collect_list(item)), " ").alias("listed"))
    truncated = queue.agg((F.count(F.lit(1)) > 20).alias("more")).scalar()
    return queue.orderBy("stage", F.desc("newest"), "loop_id").offset(10).limit(10).withColumn("truncated", truncated)


@query(f"with {WORK_SQL}, g as (select loop_id, count(*) as orders, count_if(state = 'CLOSED') as closed, round(avg(delta), 6) as delta from w group by 1) select row_number() over (order by orders desc, loop_id) as place, loop_id, orders, closed, delta from g order by place limit 10")
def busiest_loops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten loops with most orders; a top-ten report."""
    g = orders_of_work(spark, sf_dir).groupBy("loop_id").agg(F.count(F.lit(1)).alias("orders"), F.count_if(F.col("state") == "CLOSED").alias("closed"), F.round(F.avg("delta"), 6).alias("delta"))
    top = g.orderBy(F.desc("orders"), "loop_id").limit(10)
    return top.select(F.row_number().over(Window.orderBy(F.desc("orders"), "loop_id")).cast("long").alias("place"), "loop_id", "orders", "closed", "delta")  # ten rows


@query(f"with {WORK_SQL} select strftime(started, '%Y-%m') as month, action as label, count(*) as orders, count(distinct loop_id) as loops, round(100.0 * avg((delta > 0)::int), 6) as improved from w group by 1, 2")
def label_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels by month: how many, on how many loops, and how often they improved."""
    return orders_of_work(spark, sf_dir).groupBy(F.date_format("started", "yyyy-MM").alias("month"), F.col("action").alias("label")).agg(F.count(F.lit(1)).alias("orders"), F.countDistinct("loop_id").alias("loops"), F.round(100.0 * F.avg((F.col("delta") > 0).cast("int")), 6).alias("improved"))


@query(f"with {SNAPSHOTS_SQL}, {LEDGER_SQL} select snapshot_id from k join l using (loop_id) where ts >= timestamp '1995-01-01' and ts < timestamp '1997-01-01' and score >= 20 and score <= 60 and confidence in ('A', 'B') and status = 'SUCCESS' and loop_type in ('FLOW', 'LEVEL') and unit_id in (1, 3, 5, 7) and is_active")
def filtered_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The list's filters, of which each may be absent."""
    df = snapshots(spark, sf_dir).join(ledger(spark, sf_dir), "loop_id")
    made = reports.snapshot_filter(start="1995-01-01", end="1997-01-01", least=20, most=60, confidences=["A", "B"], statuses=["SUCCESS"], loop_types=["FLOW", "LEVEL"], units=[1, 3, 5, 7], active=True)
    return df.where(made).select("snapshot_id")


@query(f"with {SNAPSHOTS_SQL} select snapshot_id, (epoch(timestamp '1998-01-01') - epoch(ts)) > greatest(2 * case when snapshot_id % 2 = 0 then 86400 * 300 else 600 end, 7200) as stale from k")
def stale_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values too old for an alert: more than twice their interval, two hours at least."""
    now = F.to_timestamp_ntz(F.lit("1998-01-01 00:00:00"))
    slow, fast = (rules.stale(F.col("ts"), now, s) for s in (86_400 * 300, 600))
    return snapshots(spark, sf_dir).select("snapshot_id", F.when(F.col("snapshot_id") % 2 == 0, slow).otherwise(fast).alias("stale"))


# --- streams' batch twins


@query(f"with {SAMPLES_SQL}, m as (select loop_id, time_bucket(interval 1 minute, ts) as ts, avg(pv) as a, count(*) as n from s group by 1, 2) select loop_id, ts::timestamp as ts from m where n > 1 or loop_id % 4 = 0 and a <> 0")
def downsample_consistency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Minutes whose stored aggregates differ from the samples: those of a faulty store that doubles counts or means."""
    raw = samples(spark, sf_dir).withColumn("ts", F.col("ts").cast("timestamp"))
    stored = stream.downsample(raw, ["pv"], late=None).withColumns({"pv_avg": F.when(F.col("loop_id") % 4 == 0, F.col("pv_avg") * 2).otherwise(F.col("pv_avg")), "pv_count": F.when(F.col("pv_count") > 1, F.col("pv_count") * 2).otherwise(F.col("pv_count"))})
    return stream.consistency(raw, stored, "pv").withColumn("ts", F.col("ts").cast("timestamp_ntz"))


@query(f"with {SAMPLES_SQL}, f as (select loop_id, min(ts) as until from s group by 1), c as (select loop_id, until, until - to_hours(((loop_id * 7) % 60)::int) - interval 1 second as since from f) select loop_id, greatest(since, until - interval 24 hours)::timestamp as since, until::timestamp as until from c where epoch_us(until) - epoch_us(since) > 2000000")
def gaps_to_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans between a loop's checkpoint and its first new row, at most a day."""
    df = samples(spark, sf_dir)
    checkpoint = df.groupBy("loop_id").agg(F.min("ts").alias("ts")).withColumn("ts", F.col("ts") - F.make_dt_interval(F.lit(0), ((F.col("loop_id") * 7) % 60).cast("int"), F.lit(0), F.lit(1.0)))
    return stream.gaps(df, checkpoint)


@query(f"with {SAMPLES_SQL}, n as (select loop_id, max(ts) as newest from s group by 1), r as (select s.event_id, s.loop_id, row_number() over (partition by s.loop_id order by s.ts desc, s.event_id desc) as rn from s join n on n.loop_id = s.loop_id where s.ts > n.newest - interval 48 hours) select event_id, loop_id from r where rn <= 3")
def newest_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The bounded buffer: a loop's rows of the last two days before its newest one, three at most, newest first."""
    newest = samples(spark, sf_dir).groupBy("loop_id").agg(F.max("ts").alias("newest"))
    df = samples(spark, sf_dir).join(newest, "loop_id")
    return stream.last_hour(df, F.col("newest"), span="48 hours", most=3, ties=("event_id",)).select("event_id", "loop_id")


@query(f"with {SAMPLES_SQL}, a as (select distinct loop_id from s), d as (select unnest(generate_series(timestamp '2024-01-01', timestamp '2024-01-10', interval 1 day)) as day), h as (select distinct loop_id, date_trunc('day', ts) as day from s), m as (select a.loop_id, d.day from a cross join d left join h on a.loop_id = h.loop_id and d.day = h.day where h.day is null), o as (select *, row_number() over (partition by loop_id order by day) - 1 as i from m) select loop_id, (i // 3)::bigint as batch, min(day)::date as first, max(day)::date as last, count(*) as windows from o group by 1, 2")
def backfill_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows (days here) without rows, dealt into batches of three a loop for the backfill."""
    df = samples(spark, sf_dir).select("loop_id", F.to_date("ts").alias("day")).distinct()
    axis = df.select("loop_id").distinct().select("loop_id", F.explode(F.expr("sequence(date'2024-01-01', date'2024-01-10')")).alias("day"))
    lacking = axis.join(df, ["loop_id", "day"], "left_anti").withColumn("batch", F.floor((F.row_number().over(Window.partitionBy("loop_id").orderBy("day")) - 1) / 3))
    return lacking.groupBy("loop_id", "batch").agg(F.min("day").alias("first"), F.max("day").alias("last"), F.count(F.lit(1)).alias("windows"))
