"""Queries on the hourly job, alert windows, trackers, risks, gaps and live rows; each with its DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import diagnosis, kpi, reports, rules, segments
from ..sources.stand_ins import LEDGER_SQL, SAMPLES_SQL, SNAPSHOTS_SQL, WORK_SQL, ledger, orders_of_work, samples, snapshots, table
from ..sources.tables import hot_or_cold
from ..streaming import samples as stream
from . import hourly

KEYS, BY = ["loop_id"], ["ts", "event_id"]
QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


#: The stand-in's clock runs a hundredth as fast from here on, so that an hour of a loop has many samples.
BASE = 1_704_067_200_000_000
START = "2024-01-01 01:00:00"


def dense_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples whose set point and mode are stored on change only; some outputs, and all of some loops, are missing."""
    ts = F.timestamp_micros(F.expr(f"{BASE} + (unix_micros(cast(ts as timestamp)) - {BASE}) div 100"))
    df = samples(spark, sf_dir).withColumn("ts", ts)
    changed = F.col("event_id") % 5 == 0
    known = (F.col("loop_id") % 13 != 0) & (F.col("event_id") % 11 != 0)
    return df.withColumns({"sp": F.when(changed, 100.0 + F.col("event_id") % 200), "mode": F.when(changed | (F.col("event_id") % 7 == 0), F.col("mode")), "op": F.when(known, F.col("op"))})


_DENSE = f"""{SAMPLES_SQL}, {LEDGER_SQL}, t as (select event_id, loop_id, make_timestamp({BASE} + (epoch_us(ts) - {BASE}) // 100) as ts, pv, case when loop_id % 13 <> 0 and event_id % 11 <> 0 then op / 100 * 100 end as op, quality,
 case when event_id % 5 = 0 then 100.0 + event_id % 200 end as sp, case when event_id % 5 = 0 or event_id % 7 = 0 then mode end as mode from s),
 c as (select event_id, loop_id, ts, date_trunc('hour', ts) as hour, pv, op, quality, last_value(sp ignore nulls) over v as sp, last_value(mode ignore nulls) over v as mode from t window v as (partition by loop_id order by ts, event_id rows unbounded preceding)),
 dims as (select loop_id, case loop_type when 'PRESSURE' then 'PC' when 'TEMPERATURE' then 'TC' when 'LEVEL' then 'LC' when 'ANALYSIS' then 'CC' else 'FC' end as control, loop_id % 4 * -10.0 as low, 500.0 - loop_id % 3 * 50 as high, case when loop_id % 6 = 0 then 20.0 else 0 end as op_low from (select * replace (case when loop_id % 5 = 4 then 'ANALYSIS' else loop_type end as loop_type) from l)),
 k as (select event_id, c.loop_id, hour, ts, (pv - coalesce(low, 0)) / (coalesce(high, 100) - coalesce(low, 0)) * 100 as pv, (sp - coalesce(low, 0)) / (coalesce(high, 100) - coalesce(low, 0)) * 100 as sp, op, mode, quality, coalesce(op_low, 0) as op_low, coalesce(control, 'FC') as control,
  case control when 'PC' then 50 when 'TC' then 30 when 'LC' then 30 when 'CC' then 20 else 80 end as jump, case control when 'PC' then 30 when 'TC' then 20 when 'LC' then 20 when 'CC' then 10 else 50 end as spike,
  case when control in ('TC', 'CC') then 0.05 else 0.1 end as still, case when control in ('TC', 'LC', 'CC') then 6 else 5 end as width, case control when 'PC' then 2 when 'TC' then 5 when 'LC' then 5 when 'CC' then 10 else 1 end as every,
  case control when 'PC' then 20 when 'TC' then 15 when 'LC' then 15 when 'CC' then 10 else 30 end as least from c left join dims on dims.loop_id = c.loop_id where ts >= timestamp '{START}')"""


def _detect_sql(x: str) -> str:
    return (
        f"coalesce({x} >= 0 and {x} <= 100 and not coalesce(abs({x} - lag({x}) over w) > jump, false) and not coalesce(abs({x} - lag({x}) over w) > spike and abs({x} - lead({x}) over w) > spike, false), false) as {x}_sound, "
        f"coalesce(abs({x} - lag({x}) over w) > jump, false) or coalesce({x} < 0 or {x} > 100, false) as {x}_fault"
    )


def _still_sql(n: int) -> str:
    return f"count(*) over y{n} = {n} and count(pv) over y{n} >= 2 and coalesce(stddev_pop(pv) over y{n} < still, false) as still{n}"


#: Written from the contracts: each indicator under its own mask, limits by control type, neighbours within the mask.
_FLAGS = f"""{_DENSE},
 f0 as (select *, {_detect_sql('pv')}, {_detect_sql('sp')}, {_detect_sql('op')}, coalesce(quality <> 0, true) as good, {_still_sql(5)}, {_still_sql(6)} from k window w as (partition by loop_id, hour order by ts, event_id),
  y5 as (partition by loop_id, hour order by ts, event_id rows between current row and 4 following), y6 as (partition by loop_id, hour order by ts, event_id rows between current row and 5 following)),
 f1 as (select *, pv_sound and good as pv_valid, sp_sound as sp_valid, op_sound as op_valid, mode is not null as mode_valid, pv is not null and case when width = 5 then bool_or(still5) over (partition by loop_id, hour order by ts, event_id rows between 4 preceding and current row) else bool_or(still6) over (partition by loop_id, hour order by ts, event_id rows between 5 preceding and current row) end as frozen from f0),
 f2 as (select *, row_number() over (partition by loop_id, hour order by ts, event_id) - row_number() over (partition by loop_id, hour, frozen order by ts, event_id) as run, row_number() over (partition by loop_id, hour order by ts, event_id) - row_number() over (partition by loop_id, hour, op_valid order by ts, event_id) as op_run from f1),
 f3 as (select *, frozen and epoch(max(ts) over r) - epoch(min(ts) over r) + every >= 300 and coalesce(stddev_pop(op) over r > still, false) as confirmed, op_valid and count(*) over (partition by loop_id, hour, op_valid, op_run) >= least as in_run from f2 window r as (partition by loop_id, hour, frozen, run)),
 m as (select *, case when pv_valid and sp_valid then pv - sp end as e, case when mode_valid then epoch(ts) end as m_at, case when mode_valid and op_valid then epoch(ts) end as b_at, case when in_run then op end as trip_op, case when in_run then epoch(ts) end as trip_at,
  mode in (1, 2, 3, 4) as auto from f3),
 o as (select *, coalesce(lead(m_at ignore nulls) over w - m_at, m_at - lag(m_at ignore nulls) over w, case when mode_valid then 0 end) as m_d, coalesce(lead(b_at ignore nulls) over w - b_at, b_at - lag(b_at ignore nulls) over w, case when b_at is not null then 0 end) as b_d,
  abs(trip_op - lag(trip_op ignore nulls) over w) as move, coalesce(e * lag(e ignore nulls) over w < 0, false) as crossed, e - avg(e) over (partition by loop_id, hour) as y from m window w as (partition by loop_id, hour order by ts, event_id))"""
_HOURLY_SQL = f"""with {_FLAGS},
 g as (select loop_id, hour, count(*) as n, count_if(pv_valid and sp_valid and op_valid and mode_valid) as points, count(e) as n_e, count_if(mode_valid) as n_m, count(b_at) as n_b, count(trip_at) as n_t, count_if(pv_valid) as n_pv, count_if(sp_valid) as n_sp, count_if(op_valid) as n_op, count_if(pv_valid and op_valid) as n_v,
  avg(good::int) * 100 as good, avg((pv_fault or confirmed)::int) * 100 as fault, avg(abs(e)) as a, max(abs(e)) - avg(abs(e)) as b, stddev_samp(e) as dev, sum(m_d) as md, sum(case when auto then m_d else 0 end) as md_auto, sum(b_d) as bd,
  sum(case when auto and op > op_low + 2 and op < 98 then b_d else 0 end) as bd_eff, sum(case when auto and (op >= 98 or op <= op_low + 2) then b_d else 0 end) as bd_sat, coalesce(sum(move), 0) / nullif(max(trip_at) - min(trip_at), 0) / 100 as trip,
  avg(pv) filter (where pv_valid) as pv_mean, avg(sp) filter (where sp_valid) as sp_mean, stddev_pop(sp) filter (where sp_valid) as sp_std, avg(op) filter (where op_valid) as op_mean, avg(e) as e_mean, count_if(crossed) as crossings,
  covar_pop(pv, op) filter (where pv_valid and op_valid) as cov, stddev_pop(pv) filter (where pv_valid and op_valid) * stddev_pop(op) filter (where pv_valid and op_valid) as devs from o group by 1, 2)
 select loop_id, hour::timestamp as hour, n::bigint as samples, points::bigint as points, case when points / n >= 0.95 then 'A' when points / n >= 0.8 then 'B' when points / n >= 0.6 then 'C' when points / n >= 0.2 then 'D' else 'E' end as confidence,
 round(case when good >= 20 then good end, 7) as good_value_rate, round(case when n_pv >= n * 0.2 then fault end, 7) as instrument_fault_rate, round(case when n_e >= n * 0.2 then case when b > 0 then greatest(least(100 * (1 - a / b * (1 - exp(-a / b))), 100), 0) when a > 0 then greatest(100 * (1 - a / 5), 0) when a = 0 then 100 end end, 7) as accuracy_rate,
 round(case when n_e >= n * 0.2 then 100 * exp(-dev / 5) end, 7) as stability_base, round(case when n_m >= n * 0.2 and md <> 0 then md_auto / md * 100 end, 7) as auto_mode_rate, round(case when n_b >= n * 0.2 and bd <> 0 then bd_eff / bd * 100 end, 7) as effective_auto_rate,
 round(case when n_b >= n * 0.2 and bd <> 0 then bd_sat / bd * 100 end, 7) as saturation_rate, round(case when n_t >= n * 0.2 then trip end, 11) as output_trip_index, round(case when n_pv >= n * 0.2 then pv_mean end, 7) as pv_mean, round(case when n_sp >= n * 0.2 then sp_mean end, 7) as sp_mean, round(case when n_sp >= n * 0.2 then sp_std end, 7) as sp_std,
 round(case when n_op >= n * 0.2 then op_mean end, 7) as op_mean, round(case when n_e >= n * 0.2 then e_mean end, 7) as error_mean, case when n_e >= n * 0.2 and n_e > 0 then crossings::bigint end as setpoint_crossing_count, round(case when n_v >= n * 0.2 and n_v > 0 then case when devs > 1e-9 then abs(cov / devs) else 0 end end, 6) as valve_linearity from g"""


def _window(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(samples of the job's window, last set points and modes before it)."""
    df = dense_samples(spark, sf_dir)
    start = F.lit(START).cast("timestamp")
    return df.where(F.col("ts") >= start), segments.last_before(df, KEYS, "ts", ["sp", "mode"], start)


def hourly_loops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ledger with ranges, output limits, ideal settling times, models and weights for some loops; five control types."""
    i = F.col("loop_id")
    return ledger(spark, sf_dir).withColumns({
        "loop_type": F.when(i % 5 == 4, "ANALYSIS").otherwise(F.col("loop_type")), "pv_low": i % 4 * -10.0, "pv_high": 500.0 - i % 3 * 50, "op_low": F.when(i % 6 == 0, 20.0),
        "ideal_settling": F.when(i % 7 == 0, 45.0), "tau": F.when(i % 2 == 0, 10.0 + i % 50), "theta": F.when(i % 2 == 0, 1.0 + i % 9),
        "weight_accuracy": F.when(i % 3 == 0, 50.0), "weight_fast": F.when(i % 3 == 0, 20.0), "weight_steady": F.when(i % 3 == 0, 30.0),
    })


@query(_HOURLY_SQL)
def hourly_indicators(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hourly job's indicators, each under its contract's mask; set points from before the window, limits by control type."""
    rows, before = _window(spark, sf_dir)
    out = hourly.indicators(hourly.prepare(rows, hourly_loops(spark, sf_dir), before, ("event_id",)))
    places = {"output_trip_index": 11, "valve_linearity": 6}
    rounded = ("good_value_rate", "instrument_fault_rate", "accuracy_rate", "stability_base", "auto_mode_rate", "effective_auto_rate", "saturation_rate", "output_trip_index", "pv_mean", "sp_mean", "sp_std", "op_mean", "error_mean", "valve_linearity")
    return out.select("loop_id", F.col("hour").cast("timestamp_ntz").alias("hour"), "samples", "points", hourly.grade("valid_rate").alias("confidence"), *(F.round(c, places.get(c, 7)).alias(c) for c in rounded), "setpoint_crossing_count")


@query()
def hourly_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole hourly job: settling, oscillation, scores and status by loop and hour."""
    rows, before = _window(spark, sf_dir)
    out = hourly.hourly(rows, hourly_loops(spark, sf_dir), before, ("event_id",))
    return out.select("loop_id", F.col("hour").cast("timestamp_ntz").alias("hour"), "points", F.round("valid_rate", 6).alias("valid_rate"), "settling_outcome", *(F.round(c, 4).alias(c) for c in ("settling_time", "fast_rate", "oscillation_rate", "stability_rate", "score")), "confidence", "score_grade", "status")


_CYCLES_SQL = f"""with {SAMPLES_SQL},
 e00 as (select loop_id, ts, event_id, {{e}} as e from s), e0 as (select *, last_value(case when e <> 0 then sign(e) end ignore nulls) over (partition by loop_id order by ts, event_id rows unbounded preceding) as sg from e00 where e is not null),
 e1 as (select *, coalesce((sg * lag(sg) over (partition by loop_id order by ts, event_id) < 0)::int, 0) as cross_ from e0), e2 as (select *, sum(cross_) over (partition by loop_id order by ts, event_id rows unbounded preceding) as part from e1),
 p as (select loop_id, part, sum(abs(e)) as area, count(*) as len, case when avg(e) > 0 then 1 else -1 end as side from e2 group by loop_id, part), t as (select loop_id, max(part) as crossings from p group by loop_id),
 h as (select p.*, avg(area) over (partition by p.loop_id, side) as m, count(*) over (partition by p.loop_id, side) as n from p join t using (loop_id) where part > 0 and part < crossings),
 r as (select *, first_value(area) over (partition by loop_id, side order by abs(area - m), part) as med from h), d as (select loop_id, side, med, n, avg(case when area / med between 0.05 and 15 then area end) as kept, sum(len) as len from r group by loop_id, side, med, n),
 u as (select *, case when n < 2 or abs(med) < 1e-12 then 0 else coalesce(greatest(0, least(1, 1 - abs(kept - med) / abs(med))), 0) end as alike from d),
 v as (select loop_id, max(case when side > 0 then alike end) as s_a, max(case when side < 0 then alike end) as s_b, sum(len) / sum(n) as half from u group by loop_id)
"""


@query(_CYCLES_SQL.format(e="pv - avg(pv) over (partition by loop_id)") + "select loop_id, crossings::bigint as crossings, round(half, 4) as half_cycle, round(s_a, 4) as s_a, round(s_b, 4) as s_b, coalesce(crossings >= 4 and half >= 2 and s_a >= 0.6 and s_b >= 0.6, false) as is_cycle from t left join v using (loop_id)")
def limit_cycles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Limit cycles of the process value; half cycles of two samples suffice, as the stand-in's loops have few."""
    out = kpi.limit_cycle(samples(spark, sf_dir), KEYS, BY, least_half=2)
    return out.withColumns({c: F.round(c, 4) for c in ("half_cycle", "s_a", "s_b")})


@query(_CYCLES_SQL.format(e="pv - sp") + ", z as (select t.loop_id, crossings, half, s_a, s_b, crossings >= 4 and s_a is not null and s_b is not null as known, coalesce(crossings >= 4 and s_a >= 0.4 and s_b >= 0.4 and half >= 2, false) as hit from t left join v using (loop_id)) select loop_id, hit as detected, round(case when hit then least(1.0, least(s_a, s_b) * 1.5) else 0.0 end, 4) as confidence, round(case when known then least(s_a, s_b) else 0.0 end, 4) as similarity, crossings::bigint as crossings, round(case when known then 2 * half else 0.0 end, 4) as mean_period from z")
def oscillation_by_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Oscillation by alike integrated errors of half cycles, of two samples at least here."""
    out = kpi.oscillation_by_error(samples(spark, sf_dir).withColumn("e", F.col("pv") - F.col("sp")), KEYS, BY, least_half=2)
    return out.withColumns({c: F.round(c, 4) for c in ("confidence", "similarity", "mean_period")})


_LOCAL = "extract(hour from ts + interval 8 hours)"


@query(f"with {SNAPSHOTS_SQL} select snapshot_id, {_LOCAL} >= 8 and {_LOCAL} < 20 as day_shift, {_LOCAL} in (0, 8, 16) as at_hours, {_LOCAL} = 6 as at_six, {_LOCAL} >= 22 and {_LOCAL} < 6 as over_midnight, true as always from k")
def rule_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hours of cron texts: a range [start, end), a list, one hour; a range over midnight fits nothing."""
    ts, crons = F.col("ts"), {"day_shift": "0 8-20 * * *", "at_hours": "0 0,8,16 * * *", "at_six": "0 6 * * *", "over_midnight": "0 22-6 * * *", "always": "0 * * * *"}
    return snapshots(spark, sf_dir).select("snapshot_id", *(rules.in_window(ts, cron).alias(name) for name, cron in crons.items()))


_STATES = ("PENDING", "IN_PROGRESS", "VERIFYING", "REOPENED", "IMPLEMENTED", "CLOSED", "IGNORED")
_MOVES = " or ".join(f"(state = '{a}' and to_ in ({', '.join(repr(b) for b in bs)}))" for a, bs in rules.TRACKER_MOVES.items() if bs)


@query(f"with {WORK_SQL}, m as (select order_id, line, l_partkey, {list(_STATES)}[(l_partkey % 7)::int + 1] as state, {list(_STATES)}[((l_partkey // 7 + line) % 7)::int + 1] as to_, case when l_partkey % 3 > 0 then l_partkey end as moc, delta from w) select order_id, line, l_partkey, state, to_, case when not ({_MOVES}) then 'INVALID_TRANSITION' when to_ = 'VERIFYING' and moc is null then 'MOC_REQUIRED' when to_ = 'VERIFYING' and delta <= 0 then 'PID_REQUIRED' when to_ = 'REOPENED' and moc is null then 'REASON_REQUIRED' end as error from m")
def tracker_moves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Moves of action trackers and what forbids them."""
    part, states = F.col("l_partkey"), F.array(*map(F.lit, _STATES))
    df = orders_of_work(spark, sf_dir).withColumns({"state": F.element_at(states, (part % 7).cast("int") + 1), "to_": F.element_at(states, ((F.floor(part / 7) + F.col("line")) % 7).cast("int") + 1), "moc": F.when(part % 3 > 0, part)})
    error = rules.tracker_error("state", "to_", F.col("moc"), F.when(F.col("delta") > 0, F.col("delta")), F.col("moc"))
    return df.select("order_id", "line", "l_partkey", "state", "to_", error.alias("error"))


_RISK = {"score": "score", "oscillation": "auto_rate", "saturation": "loop_count * 5.0", "steady": "100 - auto_rate * 2"}
_RISK_SQL = {
    "score": "case when {s} < -0.01 then least(35, abs({s}) * 20 * case when {f} < 60 then 1.5 else greatest(0.5, 100 - {f}) / 40 end) else 0 end",
    "oscillation": "case when {s} > 0.01 then least(25, abs({s}) * 20 * case when {f} > 20 then 1.5 else greatest(0.5, {f} / 20) end) else 0 end",
    "saturation": "case when {s} > 0.01 then least(15, abs({s}) * 20 * case when {f} > 20 then 1.5 else greatest(0.5, {f} / 20) end) else 0 end",
    "steady": "case when {s} < -0.01 then least(25, abs({s}) * 20 * case when {f} < 80 then 1.5 else greatest(0.5, (100 - {f}) / 20) end) else 0 end",
}


@query(
    f"with {SNAPSHOTS_SQL}, x as (select loop_id, {', '.join(f'{e} as {n}_' for n, e in _RISK.items())}, row_number() over (partition by loop_id order by ts, snapshot_id) - 1 as i from k), "
    f"g as (select loop_id, count(*) as n, {', '.join(f'regr_slope({n}_, i) as {n}_s, last({n}_ order by i) filter (where {n}_ is not null) as {n}_c' for n in _RISK)} from x group by loop_id having count(*) >= 12 and count(score_) >= 3), "
    f"r as (select loop_id, {', '.join('coalesce(' + _RISK_SQL[n].format(s=f'{n}_s', f=f'{n}_c') + ', 0) as ' + n for n in _RISK)} from g), z as (select *, least(100, score + oscillation + saturation + steady) as risk from r) "
    f"select loop_id, {', '.join(f'round({n}, 4) as {n}' for n in _RISK)}, round(risk, 4) as risk, case when risk >= 60 then 'HIGH' when risk >= 30 then 'MEDIUM' else 'LOW' end as band from z"
)
def risk_factors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The four trends' shares of a loop's risk: falling score and steadiness, rising oscillation and saturation."""
    w = Window.partitionBy("loop_id").orderBy("ts", "snapshot_id")
    df = snapshots(spark, sf_dir).select("loop_id", (F.row_number().over(w) - 1).cast("double").alias("i"), *(F.expr(e).cast("double").alias(n) for n, e in _RISK.items()))
    trends = {f"{n}_s": reports.regression(F.col("i"), F.col(n))[0] for n in _RISK} | {f"{n}_c": F.max_by(n, F.when(F.col(n).isNotNull(), F.col("i"))) for n in _RISK}
    g = df.groupBy("loop_id").agg(F.count(F.lit(1)).alias("_n"), F.count("score").alias("_have"), *(c.alias(n) for n, c in trends.items())).where("_n >= 12 and _have >= 3")
    shares = {n: F.coalesce(reports.contribution(n, F.col(f"{n}_s"), F.col(f"{n}_c")), F.lit(0.0)) for n in _RISK}
    g = g.withColumns(shares).withColumn("risk", F.least(F.lit(100.0), F.col("score") + F.col("oscillation") + F.col("saturation") + F.col("steady")))
    band = F.when(F.col("risk") >= 60, "HIGH").when(F.col("risk") >= 30, "MEDIUM").otherwise("LOW")
    return g.select("loop_id", *(F.round(n, 4).alias(n) for n in (*_RISK, "risk")), band.alias("band"))


@query(f"with {SAMPLES_SQL}, a as (select distinct loop_id from s), d as (select unnest(generate_series(timestamp '2024-01-01', timestamp '2024-01-10', interval 1 day)) as day), h as (select loop_id, date_trunc('day', ts) as day, count(*) as n from s group by 1, 2), j as (select d.day, count(*) as affected from a cross join d left join h on a.loop_id = h.loop_id and d.day = h.day where coalesce(h.n, 0) < 4 group by 1) select row_number() over (order by affected desc, day) as place, day::date as day, affected from j order by place limit 5")
def gap_hours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The buckets (days here) in which most loops lack samples; a top-five report."""
    df = samples(spark, sf_dir)
    counts = df.groupBy("loop_id", F.to_date("ts").alias("day")).agg(F.count(F.lit(1)).alias("n"))
    axis = df.select("loop_id").distinct().select("loop_id", F.explode(F.expr("sequence(date'2024-01-01', date'2024-01-10')")).alias("day"))
    lacking = axis.join(counts, ["loop_id", "day"], "left").where(F.coalesce("n", F.lit(0)) < 4).groupBy("day").agg(F.count(F.lit(1)).alias("affected"))
    place = F.row_number().over(Window.orderBy(F.desc("affected"), "day"))  # one row a bucket
    return lacking.select(place.cast("long").alias("place"), "day", "affected").where("place <= 5")


@query(f"with {SAMPLES_SQL}, hot as (select event_id, loop_id, ts from s where loop_id % 3 = 0 or event_id % 2 = 0), c as (select loop_id from hot group by 1 having epoch_us(min(ts)) <= epoch_us(timestamp '2024-01-03') + 60000000 and epoch_us(max(ts)) >= epoch_us(timestamp '2024-01-06') - 60000000) select event_id, loop_id, 'hot' as store from hot where ts between timestamp '2024-01-03' and timestamp '2024-01-06' and loop_id in (select loop_id from c) union all select event_id, loop_id, 'cold' from s where ts between timestamp '2024-01-03' and timestamp '2024-01-06' and loop_id not in (select loop_id from c)")
def hot_and_cold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples of a window from the cache where it covers the window, else from the store."""
    df = samples(spark, sf_dir).select("event_id", "loop_id", "ts")
    hot = df.where("loop_id % 3 = 0 or event_id % 2 = 0").withColumn("store", F.lit("hot"))
    start, end = (F.lit(f"2024-01-0{d} 00:00:00").cast("timestamp_ntz") for d in (3, 6))
    return hot_or_cold(hot, df.withColumn("store", F.lit("cold")), KEYS, start, end).select("event_id", "loop_id", "store")


@query(f"with {SAMPLES_SQL}, m as (select loop_id, event_id // 4 as flush, ['PV', 'SP', 'OP', 'MODE'][(event_id % 4)::int + 1] as role, ts, case when mode = 4 then 'bad' else pv::varchar end as value, quality from s), l as (select *, row_number() over (partition by loop_id, flush, role order by ts desc) as rn from m), p as (select loop_id, flush, coalesce(max(case when role = 'PV' then ts end), max(ts)) as ts, max(case when role = 'PV' and rn = 1 then try_cast(value as double) end) as pv, max(case when role = 'SP' and rn = 1 then try_cast(value as double) end) as sp, max(case when role = 'OP' and rn = 1 then try_cast(value as double) end) as op, max(case when role = 'MODE' and rn = 1 then trunc(try_cast(value as double))::int end) as mode, max(case when role = 'PV' and rn = 1 then quality::int end) as pv_quality from l group by 1, 2) select loop_id, flush, ts::timestamp as ts, pv, sp, op, mode, pv_quality from p")
def live_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages of tags as wide rows at the process value's time."""
    role = F.element_at(F.array(*map(F.lit, ("PV", "SP", "OP", "MODE"))), (F.col("event_id") % 4).cast("int") + 1)
    messages = samples(spark, sf_dir).select("loop_id", F.floor(F.col("event_id") / 4).alias("flush"), role.alias("role"), "ts", F.when(F.col("mode") == 4, "bad").otherwise(F.col("pv").cast("string")).alias("value"), F.col("quality").cast("string").alias("quality"))
    return stream.live_rows(messages, ["loop_id", "flush"]).select("loop_id", "flush", F.col("ts").cast("timestamp_ntz").alias("ts"), "pv", "sp", "op", "mode", "pv_quality")


@query(f"with {SNAPSHOTS_SQL}, a as (select snapshot_id % 20 as task_id, loop_id, ts, snapshot_id, score from k), old as (select * from a where snapshot_id % 2 = 0), new as (select * from a where snapshot_id % 2 = 1), o as (select *, row_number() over (partition by task_id, loop_id order by ts desc, snapshot_id desc) as rn from old), n as (select *, row_number() over (partition by task_id, loop_id order by ts desc, snapshot_id desc) as rn from new) select task_id, loop_id, snapshot_id, score, 'new' as written from n where rn = 1 union all select task_id, loop_id, snapshot_id, score, 'old' from o where rn = 1 and not exists (select 1 from n where n.task_id = o.task_id and n.loop_id = o.loop_id)")
def custom_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Snapshots of custom tasks: one row a (task, loop), written anew by a later run."""
    df = snapshots(spark, sf_dir).withColumn("task_id", F.col("snapshot_id") % 20).withColumn("at", F.struct("ts", "snapshot_id"))
    key = ["task_id", "loop_id"]
    part = lambda rest, name: segments.last_write(df.where(F.col("snapshot_id") % 2 == rest).withColumn("written", F.lit(name)), key, [F.desc("at")])
    return segments.upsert(part(0, "old"), part(1, "new"), key, "at").select(*key, "snapshot_id", "score", "written")


@query(f"with {SNAPSHOTS_SQL}, {SAMPLES_SQL}, a as (select loop_id, avg(case when snapshot_id % 4 <> 0 then score end) as score, avg(case when snapshot_id % 4 <> 0 then auto_rate end) as auto from k group by 1), o as (select loop_id, avg(coalesce((quality = 0)::int, 0)) as bad, avg((op >= 98 or op <= 2)::int) as sat from s group by 1) select loop_id, round(a.score, 8) as score, round(coalesce(100 - a.auto, o.bad * 100), 8) as bad_value_rate, case when a.auto is not null then 'kpi' when o.bad is not null then 'operator' else 'none' end as bad_value_source, round(coalesce(a.score * 0.1, o.sat * 100), 8) as saturation_rate, case when a.score is not null then 'kpi' when o.sat is not null then 'operator' else 'none' end as saturation_source from a full join o using (loop_id)")
def metric_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Summary of a diagnosis: means of the window's indicators, the operators' features where there are none, and which it was."""
    known = lambda c: F.avg(F.when(F.col("snapshot_id") % 4 != 0, F.col(c)))
    kpis = snapshots(spark, sf_dir).groupBy("loop_id").agg(known("score").alias("score"), (100 - known("auto_rate")).alias("bad_value_rate"), (known("score") * 0.1).alias("saturation_rate"))
    found = samples(spark, sf_dir).groupBy("loop_id").agg(F.avg(F.coalesce((F.col("quality") == 0).cast("double"), F.lit(0.0))).alias("bad_value_rate"), F.avg(((F.col("op") >= 98) | (F.col("op") <= 2)).cast("double")).alias("saturation_rate"))
    out = reports.metric_summary(kpis, found, KEYS, {"bad_value_rate": "bad_value", "saturation_rate": "saturation"})
    return out.select("loop_id", F.round("score", 8).alias("score"), *(c for n in ("bad_value", "saturation") for c in (F.round(f"{n}_rate", 8).alias(f"{n}_rate"), f"{n}_source")))


_SCOPED = f"with {LEDGER_SQL} select 'every' as rule_id, loop_id from l union all select 'levels', loop_id from l where loop_type = 'LEVEL'"


@query(_SCOPED)
def rule_scopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules of all loops beside rules of a type."""
    made = spark.createDataFrame([("every", "ALL", None), ("levels", "CONTROL_TYPE", "LEVEL")], "rule_id string, scope string, target string")
    return rules.subscriptions(made, ledger(spark, sf_dir))


@query(_CYCLES_SQL.format(e="pv / 5 - sp / 5") + ", b as (select loop_id, stddev_samp(pv / 5 - sp / 5) as dev from s group by 1), z as (select t.loop_id, case when crossings >= 4 and s_a is not null and s_b is not null then least(s_a, s_b) * 100 else 0 end as osc from t left join v using (loop_id)) select b.loop_id, round(100 * exp(-dev / 5) * (1 - coalesce(osc, 0) / 100), 6) as stability_rate from b left join z using (loop_id)")
def stability_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Steadiness of the error, less the share of oscillation."""
    df = samples(spark, sf_dir).withColumn("e", F.col("pv") / 5 - F.col("sp") / 5)
    base = df.groupBy("loop_id").agg((100 * F.exp(-F.stddev_samp("e") / 5)).alias("base"))
    swings = kpi.oscillation(df, KEYS, BY).select("loop_id", "oscillation_rate")
    return base.join(swings, "loop_id", "left").select("loop_id", F.round(kpi.stability(F.col("base"), F.col("oscillation_rate")), 6).alias("stability_rate"))


_FAMILIES = ("oscillation", "stiction", "sensor", "saturation", "overshoot", "slow", "bias_shift")
_CAUSES_SQL = f"""with f as (select l_suppkey as loop_id, {list(_FAMILIES)}[(l_partkey % 7)::int + 1] as family, max(l_discount * 10) filter (where l_discount >= 0.08 and l_tax >= 0.07) as c, count_if(l_discount >= 0.08 and l_tax >= 0.07) as hits from lineitem group by 1, 2 having count_if(l_discount >= 0.08 and l_tax >= 0.07) > 0),
 p as (select loop_id, {', '.join(f"max(case when family = '{x}' then c end) as {x}, max(case when family = '{x}' then hits end) as {x}_n" for x in _FAMILIES)} from f group by 1),
 w as (select loop_id, loop_id % 10 <> 0 as passed, loop_id % 7 <> 0 as linked, (loop_id % 100) / 100.0 as auto from (select s_suppkey as loop_id from supplier)),
 j as (select w.*, p.* exclude (loop_id) from w left join p using (loop_id)),
 k as (select loop_id, case when passed then list_filter([case when not linked then struct_pack(cause := 'COMMUNICATION', c := 0.9::double) end, case when sensor is not null then struct_pack(cause := 'INSTRUMENT', c := sensor) end,
  case when coalesce(stiction, 0) >= 0.7 or coalesce(stiction_n, 0) >= 2 then struct_pack(cause := 'VALVE', c := coalesce(stiction, 0)) end, case when coalesce(saturation, 0) > 0.8 then struct_pack(cause := 'VALVE', c := saturation) end,
  case when bias_shift is not null then struct_pack(cause := 'PROCESS', c := bias_shift) end, case when oscillation is not null and stiction is null and overshoot is null then struct_pack(cause := 'PROCESS', c := 0.5::double) end,
  case when overshoot is not null or slow is not null then struct_pack(cause := 'TUNING', c := greatest(coalesce(overshoot, 0), coalesce(slow, 0))) end, case when auto > 0 and auto < 0.5 then struct_pack(cause := 'UTILIZATION', c := 0.8::double) end], lambda x: x is not null) else [] end as causes from j),
 a as (select loop_id, causes, case when len(causes) > 0 then causes[1] else struct_pack(cause := 'DATA_INSUFFICIENT', c := 0.0::double) end as lead_ from k),
 b as (select *, case lead_.cause when 'COMMUNICATION' then ['INSTRUMENT', 'VALVE', 'PROCESS', 'TUNING'] when 'INSTRUMENT' then ['VALVE', 'PROCESS', 'TUNING'] when 'VALVE' then ['TUNING'] when 'PROCESS' then ['TUNING'] else [] end as doubtful, list_filter(causes, lambda x: x.cause <> lead_.cause) as rest from a)
 select loop_id, lead_.cause as primary_, round(lead_.c, 6) as confidence, array_to_string(list_sort(list_distinct(list_transform(list_filter(rest, lambda x: not list_contains(doubtful, x.cause) and x.c >= 0.6), lambda x: x.cause))), ',') as secondary, array_to_string(list_sort(list_distinct(list_transform(list_filter(rest, lambda x: list_contains(doubtful, x.cause)), lambda x: x.cause))), ',') as pending from b"""


@query(_CAUSES_SQL)
def cause_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ordered table of causes over findings of every kind, with windows that fail the gate and loops that are not linked."""
    hit = (F.col("l_discount") >= 0.08) & (F.col("l_tax") >= 0.07)  # where an operator found something
    family = F.element_at(F.array(*map(F.lit, _FAMILIES)), (F.col("l_partkey") % 7).cast("int") + 1)
    found = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("loop_id"), family.alias("family")).agg(F.max(F.when(hit, F.col("l_discount") * 10)).alias("confidence"), F.count_if(hit).alias("hits")).where("hits > 0")
    i = F.col("loop_id")
    windows = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("loop_id")).select("loop_id", (i % 10 != 0).alias("passed"), (i % 7 != 0).alias("linked"), ((i % 100) / 100.0).alias("auto_rate"))
    out = diagnosis.classify(found, windows, KEYS)
    listed = lambda c: F.array_join(F.array_sort(c), ",")
    return out.select("loop_id", F.col("primary").alias("primary_"), F.round("confidence", 6).alias("confidence"), listed("secondary").alias("secondary"), listed("pending").alias("pending"))
