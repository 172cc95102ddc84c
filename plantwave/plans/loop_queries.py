"""Queries on samples: quality, detectors, indicators, scores; each with its DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.masks import mask
from ..functions.signals import AUTO_MODES, clamp, control_type, grade, infer_loop_type, missing, normalise, quality, score_grade, to_standard_pid
from ..operators import kpi, outliers, segments
from ..sources.stand_ins import LEDGER_SQL, SAMPLES_SQL, ledger, samples, table

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


W = "window w as (partition by loop_id order by ts, event_id)"
HOLD = "coalesce(epoch(lead(ts) over w) - epoch(ts), epoch(ts) - epoch(lag(ts) over w), 0) as d"


def held(spark: SparkSession, sf_dir: str) -> DataFrame:
    return samples(spark, sf_dir).withColumn("d", segments.hold("ts", KEYS, BY))


@query(f"with {SAMPLES_SQL}, h as (select *, {HOLD} from s {W}) select loop_id, count(*) as points, round(sum(case when mode in (1, 2, 3, 4) then d else 0 end) / sum(d) * 100, 4) as auto_mode_rate from h group by loop_id")
def auto_mode_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    auto = F.col("mode").isin(*AUTO_MODES)
    rate = kpi.ratio(F.sum(F.when(auto, F.col("d")).otherwise(0.0)), F.sum("d"))
    return held(spark, sf_dir).groupBy("loop_id").agg(F.count(F.lit(1)).alias("points"), F.round(rate, 4).alias("auto_mode_rate"))


@query(f"with {SAMPLES_SQL} select event_id, case when quality is null or quality in (1, 2, 3, 192) then 'Good' when quality = 0 then 'Bad' else 'Unknown' end as quality_status, round((pv - 0) / 500 * 100, 6) as pv_pct, op is null as op_missing from s")
def quality_and_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return samples(spark, sf_dir).select("event_id", quality("quality").alias("quality_status"), F.round(normalise("pv", 0, 500), 6).alias("pv_pct"), missing("op").alias("op_missing"))


_DETECT = f"""with {SAMPLES_SQL},
a as (select *, pv / 500 * 100 as x, lag(pv / 500 * 100) over w as p, lead(pv / 500 * 100) over w as q,
 count(*) over (w rows between current row and 4 following) = 5 and stddev_pop(pv / 500 * 100) over (w rows between current row and 4 following) < 0.1 as still from s {W}),
b as (select *, bool_or(still) over (w rows between 4 preceding and current row) as frozen from a {W}),
c as (select *, list_filter([case when x is null then 'NAN' end, case when x < 0 or x > 100 then 'OUT_OF_RANGE' end, case when frozen then 'FROZEN' end, case when abs(x - p) > 80 then 'JUMP' end,
 case when abs(x - p) > 50 and abs(x - q) > 50 then 'SPIKE' end, case when quality = 0 then 'QC_BAD' end], lambda r: r is not null) as reasons from b)
"""


def detected(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = samples(spark, sf_dir).withColumn("pv", normalise("pv", 0, 500))
    return outliers.detect(df, "pv", KEYS, BY, 0, 100, "FC", "quality")


@query(_DETECT + "select event_id, array_to_string(reasons, ',') as reasons, len(list_filter(reasons, lambda r: r <> 'FROZEN')) = 0 as valid from c")
def outlier_detectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detected(spark, sf_dir).select("event_id", F.array_join("pv_reasons", ",").alias("reasons"), F.col("pv_valid").alias("valid"))


@query(
    _DETECT
    + f""", v as (select *, len(list_filter(reasons, lambda r: r <> 'FROZEN')) = 0 as valid from c),
n as (select *, row_number() over w as n, row_number() over w - row_number() over (partition by loop_id, valid order by ts, event_id) as run from v {W})
select loop_id, min(n)::int as "start", max(n)::int as "end", count(*) as points from n where valid group by loop_id, run having count(*) >= 3"""
)
def valid_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segments.islands(detected(spark, sf_dir), "pv_valid", KEYS, BY, 3)


@query(_DETECT + "select loop_id, count(*) as points, count_if(len(list_filter(reasons, lambda r: r <> 'FROZEN')) = 0) as valid, round_even(avg((len(list_filter(reasons, lambda r: r <> 'FROZEN')) = 0)::int), 4) as valid_rate, case when avg((len(list_filter(reasons, lambda r: r <> 'FROZEN')) = 0)::int) >= 0.95 then 'A' when avg((len(list_filter(reasons, lambda r: r <> 'FROZEN')) = 0)::int) >= 0.8 then 'B' when avg((len(list_filter(reasons, lambda r: r <> 'FROZEN')) = 0)::int) >= 0.6 then 'C' when avg((len(list_filter(reasons, lambda r: r <> 'FROZEN')) = 0)::int) >= 0.2 then 'D' else 'E' end as confidence from c group by loop_id")
def valid_rate_and_grade(spark: SparkSession, sf_dir: str) -> DataFrame:
    share = F.avg(F.col("pv_valid").cast("double"))
    return detected(spark, sf_dir).groupBy("loop_id").agg(F.count(F.lit(1)).alias("points"), F.count_if("pv_valid").alias("valid"), F.bround(share, 4).alias("valid_rate"), grade(share).alias("confidence"))


@query(f"with {SAMPLES_SQL} select event_id, (coalesce(pv <= 100, false) and (coalesce(op >= 20, false) or not coalesce(mode in (1, 2, 3, 4), false))) as masked from s")
def mask_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = samples(spark, sf_dir).withColumns({"pv_valid": F.col("pv") <= 100, "op_valid": F.col("op") >= 20, "mode_valid": F.col("mode").isin(*AUTO_MODES)})
    return df.select("event_id", mask("pv_valid && (op_valid || !mode_valid) && !nothing_known", df.columns).alias("masked"))


def prepared(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = held(spark, sf_dir).withColumns({"pv": F.col("pv") / 5, "sp": F.col("sp") / 5, "quality_status": quality("quality"), "faulty": F.col("pv") > 400})
    return kpi.with_moves(df, KEYS, BY)


_AGG_SQL = f"""with {SAMPLES_SQL},
a as (select *, pv / 5 - sp / 5 as e, {HOLD}, coalesce(abs(op - lag(op) over w), 0) as move, coalesce((pv / 5 - sp / 5) * lag(pv / 5 - sp / 5) over w < 0, false) as crossed, pv > 400 as faulty, mode in (1, 2, 3, 4) as auto from s {W}),
g as (select loop_id, count(*) as points, avg(abs(e)) as m, max(abs(e)) - avg(abs(e)) as b, sum(d) as d, stddev_samp(e) as dev, avg((quality is null or quality = 192)::int) * 100 as good,
 sum(case when auto then d else 0 end) as d_auto, sum(case when auto and op > 2 and op < 98 and abs(e) < 5 then d else 0 end) as d_eff, sum(case when auto and (op >= 98 or op <= 2) then d else 0 end) as d_sat,
 max((auto and op >= 98)::int) as hi, max((auto and op <= 2)::int) as lo, sum(move) as trip, avg(pv / 5) as pv_mean, stddev_pop(pv / 5) as pv_std, avg(op) as op_mean, stddev_pop(op) as op_std, avg(e) as e_mean, stddev_pop(e) as e_std,
 abs(corr(pv / 5, op)) as lin, max(op) - min(op) as span, sum(crossed::int) as crossings, avg(faulty::int) * 100 as fault from a group by loop_id)
select loop_id, points, round(case when b > 0 then greatest(least(100 * (1 - m / b * (1 - exp(-m / b))), 100), 0) when m > 0 then greatest(100 * (1 - m / 5), 0) else 100 end, 4) as accuracy_rate,
 round(100 * exp(-dev / 5), 4) as stability_base, round(good, 4) as good_value_rate, round(d_auto / d * 100, 4) as auto_mode_rate, round(d_eff / d * 100, 4) as effective_auto_rate, round(d_sat / d * 100, 4) as saturation_rate,
 case when hi + lo = 2 then 'BOTH' when hi = 1 then 'HIGH' when lo = 1 then 'LOW' else 'NONE' end as saturation_type, round(trip / (d * 100), 9) as output_trip_index,
 round(pv_mean, 4) as pv_mean, round(pv_std, 4) as pv_std, round(op_mean, 4) as op_mean, round(op_std, 4) as op_std, round(e_mean, 4) as error_mean, round(e_std, 4) as error_std, round(lin, 4) as valve_linearity, round(1 - lin, 4) as valve_nonlinearity,
 span as valve_operating_range, crossings::bigint as setpoint_crossing_count, round(m, 4) as oscillation_amplitude, round(fault, 4) as instrument_fault_rate from g where points > 2"""


@query(_AGG_SQL)
def loop_indicators(spark: SparkSession, sf_dir: str) -> DataFrame:
    exact = {"points", "saturation_type", "valve_operating_range", "setpoint_crossing_count"}
    made = kpi.aggregates()
    for s in ("sp_mean", "sp_std"):
        made.pop(s)
    places = {"output_trip_index": 9}
    df = prepared(spark, sf_dir).groupBy("loop_id").agg(*(v.alias(k) if k in exact else F.round(v, places.get(k, 4)).alias(k) for k, v in made.items()))
    return df.where("points > 2")


_OSC_SQL = f"""with {SAMPLES_SQL},
e0 as (select *, pv - sp as e, last_value(case when pv - sp <> 0 then sign(pv - sp) end ignore nulls) over (w rows unbounded preceding) as sg from s {W}),
e1 as (select *, coalesce((sg * lag(sg) over w < 0)::int, 0) as cross_ from e0 {W}),
e2 as (select *, sum(cross_) over (w rows unbounded preceding) as part from e1 {W}),
p as (select loop_id, part, sum(abs(e)) as area, count(*) as len, case when avg(e) > 0 then 1 else -1 end as side from e2 group by loop_id, part),
t as (select loop_id, max(part) as crossings from p group by loop_id),
h as (select p.*, avg(area) over (partition by p.loop_id, side) as m, count(*) over (partition by p.loop_id, side) as n from p join t using (loop_id) where part > 0 and part < crossings),
r as (select *, first_value(area) over (partition by loop_id, side order by abs(area - m), part) as med from h),
d as (select loop_id, side, med, n, avg(case when area / med between 0.05 and 15 then area end) as kept, sum(len) as len from r group by loop_id, side, med, n),
u as (select *, case when n < 2 or abs(med) < 1e-12 then 0 else coalesce(greatest(0, least(1, 1 - abs(kept - med) / abs(med))), 0) end as alike from d),
v as (select loop_id, max(case when side > 0 then alike end) as s_a, max(case when side < 0 then alike end) as s_b, sum(len) / sum(n) as half from u group by loop_id),
z as (select t.loop_id, crossings, s_a, s_b, half, crossings >= 4 and s_a is not null and s_b is not null as enough from t left join v using (loop_id))
"""


@query(_OSC_SQL + "select loop_id, crossings::bigint as crossings, round(s_a, 4) as s_a, round(s_b, 4) as s_b, round(case when enough then least(s_a, s_b) * 100 else 0 end, 4) as oscillation_rate, coalesce(enough and s_a >= 0.4 and s_b >= 0.4, false) as is_oscillating, round(case when enough and s_a >= 0.4 and s_b >= 0.4 then 2 * half else 0 end, 4) as period from z")
def oscillation_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = kpi.oscillation(samples(spark, sf_dir).withColumn("e", F.col("pv") - F.col("sp")), KEYS, BY)
    return out.drop("half_cycle").withColumns({c: F.round(c, 4) for c in ("s_a", "s_b", "oscillation_rate", "period")})


@query(
    f"""with {SAMPLES_SQL}, {LEDGER_SQL},
a as (select *, pv / 5 - sp / 5 as e, {HOLD} from s {W}),
g as (select loop_id, avg(abs(e)) as m, max(abs(e)) - avg(abs(e)) as b, stddev_samp(e) as dev, sum(case when mode in (1, 2, 3, 4) then d else 0 end) / sum(d) * 100 as auto, avg((quality is null or quality = 192)::int) * 100 as good from a group by loop_id having count(*) > 2),
k as (select g.loop_id, loop_type, greatest(least(100 * (1 - m / b * (1 - exp(-m / b))), 100), 0) as acc, 100 * exp(-dev / 5) as steady, auto, good, case when g.loop_id % 11 <> 0 then 80.0 end as fast,
 case loop_type when 'TEMPERATURE' then [.2, .3, .5] when 'PRESSURE' then [.2, .3, .5] when 'LEVEL' then [.3, .1, .6] when 'FLOW' then [.2, .5, .3] when 'SPEED' then [.2, .5, .3] else [0, .5, .6] end as w from g left join l using (loop_id)),
c as (select *, case when fast is not null then (w[1] * acc + w[2] * fast + w[3] * steady) / (w[1] + w[2] + w[3]) * auto / 100 end as score from k)
select loop_id, round(score, 4) as score, case when score is null then 'INCONCLUSIVE' when score >= 90 then 'EXCELLENT' when score >= 80 then 'GOOD' when score >= 70 then 'FAIR' when score >= 60 then 'POOR' else 'BAD' end as score_grade, case when score is null then 'INCONCLUSIVE' else 'SUCCESS' end as status from c"""
)
def composite_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = kpi.aggregates()
    df = prepared(spark, sf_dir).groupBy("loop_id").agg(*(made[k].alias(k) for k in ("points", "accuracy_rate", "stability_base", "auto_mode_rate", "good_value_rate"))).where("points > 2")
    df = df.join(ledger(spark, sf_dir), "loop_id", "left").withColumn("fast_rate", F.when(F.col("loop_id") % 11 != 0, 80.0))
    none = F.lit(None).cast("double")
    score = kpi.composite(F.col("accuracy_rate"), F.col("fast_rate"), F.col("stability_base"), F.col("auto_mode_rate"), kpi.weights((none, none, none), F.col("loop_type")))
    df = df.withColumn("score", score)
    return df.select("loop_id", F.round("score", 4).alias("score"), score_grade("score").alias("score_grade"), kpi.status(F.col("score"), F.col("good_value_rate"), F.col("auto_mode_rate"), F.col("stability_base")).alias("status"))


@query(f"with {SAMPLES_SQL}, a as (select *, last_value(case when mode = 2 then op end ignore nulls) over (w rows unbounded preceding) as carried_op from s {W}) select event_id, carried_op from a")
def forward_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = samples(spark, sf_dir).withColumn("sparse", F.when(F.col("mode") == 2, F.col("op")))
    return df.select("event_id", segments.carried("sparse", KEYS, BY).alias("carried_op"))


@query("with a as (select event_id, user_id, ts from events where event_type = 'purchase'), b as (select user_id, ts, value, event_id from events where event_type = 'view') select a.event_id, b.value as seen from a asof left join b on a.user_id = b.user_id and a.ts >= b.ts")
def as_of_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    left = events.where("event_type = 'purchase'").select("event_id", "user_id", "ts")
    right = events.where("event_type = 'view'").select("user_id", "ts", F.col("value").alias("seen"))
    return segments.as_of(left, right, ["user_id"], "ts", ["seen"]).select("event_id", "seen")


@query(
    "with a as (select event_id, user_id, ts from events where event_type = 'purchase'), b as (select user_id, ts, value from events where event_type = 'view'), "
    "m as (select a.event_id, b.value, row_number() over (partition by a.event_id order by abs(epoch_us(a.ts) - epoch_us(b.ts)), b.ts, b.value) as rn from a join b on a.user_id = b.user_id and abs(epoch_us(a.ts) - epoch_us(b.ts)) <= 14400000000) "
    "select a.event_id, m.value as seen from a left join m on a.event_id = m.event_id and rn = 1"
)
def nearest_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    left = events.where("event_type = 'purchase'").select("event_id", "user_id", "ts")
    right = events.where("event_type = 'view'").select("user_id", "ts", F.col("value").alias("seen"))
    return segments.nearest(left, right, ["user_id"], "ts", "seen", 14_400, ["event_id"]).select("event_id", "seen")


@query(f"with {SAMPLES_SQL} select loop_id, max_by(pv, ts) as pv, max_by(op, case when op is not null then ts end) as op from s where ts < timestamp '2024-01-20' group by loop_id")
def last_value_before(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segments.last_before(samples(spark, sf_dir), KEYS, "ts", ["pv", "op"], F.to_timestamp_ntz(F.lit("2024-01-20 00:00:00")))


@query("select user_id, date_trunc('day', ts)::timestamp as ts, max(case when event_type = 'view' then value end) as view, max(case when event_type = 'click' then value end) as click from events group by 1, 2")
def time_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = table(spark, sf_dir, "events").select("user_id", F.date_trunc("day", "ts").cast("timestamp_ntz").alias("ts"), "event_type", "value")
    return days.groupBy("user_id", "ts").pivot("event_type", ["view", "click"]).agg(F.max("value"))


@query(f"with {SAMPLES_SQL}, a as (select *, pv > 100 as bad from s) select event_id, last_value(case when not bad then pv end ignore nulls) over (partition by loop_id order by ts, event_id rows unbounded preceding) as repaired from a")
def out_of_range_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = samples(spark, sf_dir).withColumn("bad", F.col("pv") > 100)
    return df.select("event_id", outliers.repair_spikes(df, "pv", "bad", KEYS, BY).alias("repaired"))


@query(f"with {SAMPLES_SQL} select loop_id, count_if(op is null and quality is null) as null_null, count_if(op is not null and quality = 0) as value_bad, count_if(op is not null and quality = 192) as value_good, count_if(op is not null and quality is null) as value_null from s group by loop_id")
def quality_cross_tab(spark: SparkSession, sf_dir: str) -> DataFrame:
    none, code = F.col("op").isNull(), F.col("quality")
    counted = {"null_null": none & code.isNull(), "value_bad": ~none & (code == 0), "value_good": ~none & (code == 192), "value_null": ~none & code.isNull()}
    return samples(spark, sf_dir).groupBy("loop_id").agg(*(F.count_if(v).alias(k) for k, v in counted.items()))


@query(
    f"""with {LEDGER_SQL} select loop_id, case upper(loop_type) when 'FLOW' then 'FC' when 'PRESSURE' then 'PC' when 'TEMPERATURE' then 'TC' when 'LEVEL' then 'LC' else 'FC' end as control,
 case when level = 1 then 100 / (level + 1.0) else level + 1.0 end as kp, case when level = 2 then 60.0 * loop_id else loop_id::double end as ti, 'OTHER' as inferred from l"""
)
def controller_parameters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pid = to_standard_pid(F.col("level") + 1.0, F.col("loop_id").cast("double"), F.lit(0.0), F.col("level") == 1, F.col("level") == 2, F.lit(False))
    return ledger(spark, sf_dir).select("loop_id", control_type("loop_type").alias("control"), pid["kp"].alias("kp"), pid["ti"].alias("ti"), infer_loop_type("tag").alias("inferred"))


@query(f"with {SAMPLES_SQL} select loop_id, round(avg(e2), 4) as error_square, round(max(greatest(least(op, 90), 10)), 4) as op_clamped from (select *, (pv - sp) * (pv - sp) as e2 from s) group by loop_id")
def error_square(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("pv") - F.col("sp")
    return samples(spark, sf_dir).groupBy("loop_id").agg(F.round(F.avg(e * e), 4).alias("error_square"), F.round(F.max(clamp(F.col("op"), 10, 90)), 4).alias("op_clamped"))

