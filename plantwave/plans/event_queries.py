"""Queries on events within windows, trackers and cases; each with its DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.signals import lookup
from ..operators import diagnosis, events, outliers, reports
from ..sources.stand_ins import LEDGER_SQL, SAMPLES_SQL, SNAPSHOTS_SQL, WORK_SQL, ledger, orders_of_work, samples, snapshots, table

KEYS, BY = ["loop_id"], ["ts", "event_id"]
QUERIES: dict = {}
SQL: dict[str, str] = {}
W = "window w as (partition by loop_id order by ts, event_id)"


def query(sql: str):
    def keep(f):
        QUERIES[f.__name__], SQL[f.__name__] = f, sql
        return f

    return keep


@query(
    f"""with {SAMPLES_SQL}, s2 as (select * replace (case when ts < timestamp '2024-01-12' then 50.0 when ts < timestamp '2024-01-20' then 90.0 + loop_id % 7 else 60.0 end as sp) from s),
 a as (select *, abs(pv - sp) as e, row_number() over w - 1 as i, count(*) over (partition by loop_id) as n, sp - lag(sp) over w as move, coalesce(epoch(lead(ts) over w) - epoch(ts), epoch(ts) - epoch(lag(ts) over w), 0) as d from s2 where pv is not null {W}),
 b as (select *, e > 1.2 * stddev_pop(pv - sp) over (partition by loop_id) as beyond, abs(move) > 3 * stddev_pop(move) over (partition by loop_id) as step from a),
 t as (select distinct q.loop_id, q.i from b p join b q on q.loop_id = p.loop_id and p.step and q.i >= p.i and q.i < p.i + case when p.loop_id % 3 = 0 then 60 else greatest(5, (20000 + p.loop_id % 5 * 40000) // 20000) end),
 c as (select b.*, b.beyond and t.i is null as out_ from b left join t on t.loop_id = b.loop_id and t.i = b.i),
 r as (select *, i - row_number() over (partition by loop_id, out_ order by i) as run, sum(d) over (partition by loop_id order by i) as spent from c),
 v as (select loop_id, min(i) as start_, max(i) as end_, sum(d) as held from r where out_ and n >= 3 group by loop_id, run having sum(d) >= 40000),
 k as (select loop_id, i, spent, bool_and(not beyond) over (partition by loop_id order by i rows 1 preceding) and i > 0 as calm from r),
 m as (select v.*, min(k.i) as back from v left join k on k.loop_id = v.loop_id and k.i > v.end_ and k.calm group by all)
 select m.loop_id, start_ as "start", end_ as "end", coalesce(back, (select max(i) from r where r.loop_id = m.loop_id)) as recovered, round((select sum(d) from r where r.loop_id = m.loop_id and r.i between start_ and coalesce(back, 1000000)), 3) as seconds, back is null as censored from m"""
)
def disturbance_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of the error beyond its band that no step of the set point explains; a step is tracked for the loop's ideal settling time."""
    ts, i = F.col("ts"), F.col("loop_id")
    sp = F.when(ts < F.lit("2024-01-12").cast("timestamp_ntz"), 50.0).when(ts < F.lit("2024-01-20").cast("timestamp_ntz"), 90.0 + i % 7).otherwise(60.0)
    ideal = F.when(i % 3 != 0, 20_000.0 + i % 5 * 40_000)
    out = events.disturbances(samples(spark, sf_dir).withColumn("sp", sp), KEYS, BY, ideal, 20_000.0, band=1.2, recovery=2, least_seconds=40_000.0)
    return out.select("loop_id", *(F.col(c).cast("long").alias(c) for c in ("start", "end", "recovered")), F.round("seconds", 3).alias("seconds"), "censored")


@query(
    f"""with {SAMPLES_SQL}, a as (select *, pv < 20 as low, row_number() over w - row_number() over (partition by loop_id, pv < 20 order by ts, event_id) as run from s {W}),
 b as (select *, max(epoch(ts)) over r - min(epoch(ts)) over r >= 36000 and stddev_pop(op) over r > 10 as sure from a window r as (partition by loop_id, low, run)) select event_id, low and sure as confirmed from b"""
)
def frozen_confirmation(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = samples(spark, sf_dir).withColumn("low", F.col("pv") < 20)
    return events.confirmed_frozen(df, KEYS, BY, "low", "op", 600, 10).select("event_id", "confirmed")


@query(
    f"""with {SAMPLES_SQL}, a as (select *, row_number() over w as n, coalesce(epoch(ts) - epoch(lag(ts) over w) > 86400, false) as gap, op <= 2 or op >= 98 or op is null as sat, coalesce(mode <> lag(mode) over w, false) as chg from s {W}),
 b as (select *, (chg or gap or sat <> coalesce(lag(sat) over w, false))::int as cut, case when lead(sat) over w then 'saturation' when lead(gap) over w then 'gap' when lead(chg) over w then 'mode' else 'end' end as nxt from a {W}),
 c as (select *, sum(cut) over (w rows unbounded preceding) as part from b {W})
 select loop_id, min(n)::int as "start", max(n)::int as "end", count(*) as points, max(mode) as mode, max_by(nxt, n) as ended_by from c where not sat group by loop_id, part"""
)
def identification_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events.identification_segments(samples(spark, sf_dir), KEYS, BY, 86_400)


@query(
    "with " + SQL["identification_segments"].removeprefix("with ").rsplit(" select loop_id", 1)[0] + """, g as (select loop_id, part, min(n)::int as "start", max(n)::int as "end", count(*) as points, max(mode) as mode from c where not sat group by loop_id, part),
 r as (select *, row_number() over (partition by loop_id order by points desc, "start") as rn from g) select loop_id, "start", "end", points, mode from r where rn = 1"""
)
def best_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events.best_segment(identification_segments(spark, sf_dir), KEYS)


@query("select p_partkey as case_id, p_type as label, p_brand as kind, case when p_size % 4 <> 0 then p_size > 20 end as verified, p_size as improved from part where p_type = 'ECONOMY' or p_brand = 'Brand#4' order by verified desc nulls first, improved desc nulls first, case_id limit 25")
def similar_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    cases = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("case_id"), F.col("p_type").alias("label"), F.col("p_brand").alias("kind"), F.when(F.col("p_size") % 4 != 0, F.col("p_size") > 20).alias("verified"), F.col("p_size").alias("improved"))
    return events.similar_cases(cases, F.lit("ECONOMY"), F.lit("Brand#4"), 25)


@query(f"with {WORK_SQL} select started::date as day, count(*) as orders, count_if(state = 'CLOSED') as closed, count_if(state = 'CLOSED' and delta > 0) as improved, round(100.0 * count_if(state = 'CLOSED' and delta > 0) / nullif(count_if(state = 'CLOSED'), 0), 6) as rate from w group by 1")
def tracker_effectiveness(spark: SparkSession, sf_dir: str) -> DataFrame:
    closed = F.col("state") == "CLOSED"
    better = F.count_if(closed & (F.col("delta") > 0))
    return orders_of_work(spark, sf_dir).groupBy(F.to_date("started").alias("day")).agg(F.count(F.lit(1)).alias("orders"), F.count_if(closed).alias("closed"), better.alias("improved"), F.round(100.0 * better / F.nullif(F.count_if(closed), F.lit(0)), 6).alias("rate"))


@query(
    f"""with {SAMPLES_SQL}, h as (select unnest(generate_series(timestamp '2024-01-10', timestamp '2024-01-11 23:00:00', interval 1 hour)) as hour), g as (select date_trunc('hour', ts) as hour, count(*) as n, sum(pv * op) / nullif(sum(op), 0) as v from s group by 1)
 select h.hour::timestamp as hour, coalesce(n, 0) as n, round(v, 6) as v from h left join g on h.hour = g.hour"""
)
def board_trend(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weighted means on an hourly axis without gaps."""
    made = samples(spark, sf_dir).groupBy(F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("hour")).agg(F.count(F.lit(1)).alias("n"), F.try_divide(F.sum(F.col("pv") * F.col("op")), F.sum("op")).alias("v"))
    axis = spark.range(1).select(F.explode(F.expr("sequence(timestamp_ntz'2024-01-10 00:00:00', timestamp_ntz'2024-01-11 23:00:00', interval 1 hour)")).alias("hour"))
    return axis.join(made, "hour", "left").select("hour", F.coalesce("n", F.lit(0)).alias("n"), F.round("v", 6).alias("v"))


@query(
    f"""with {LEDGER_SQL}, r as (select loop_id, 'jump' as name, 'GLOBAL' as scope, 0.8::double as value from l union all select loop_id, 'jump', 'TYPE', 0.5 from l where loop_type = 'LEVEL' union all select loop_id, 'jump', 'LOOP', 0.1 from l where loop_id % 9 = 0),
 x as (select *, row_number() over (partition by loop_id, name order by case scope when 'LOOP' then 3 when 'UNIT' then 2 when 'TYPE' then 1 else 0 end desc) as rn from r) select loop_id, name, value from x where rn = 1"""
)
def threshold_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    loops = ledger(spark, sf_dir)
    row = lambda df, scope, value: df.select("loop_id", F.lit("jump").alias("name"), F.lit(scope).alias("scope"), F.lit(value).alias("value"))
    rows = row(loops, "GLOBAL", 0.8).unionByName(row(loops.where("loop_type = 'LEVEL'"), "TYPE", 0.5)).unionByName(row(loops.where("loop_id % 9 = 0"), "LOOP", 0.1))
    return diagnosis.merged_thresholds(rows, ["loop_id"])


@query(f"with {SNAPSHOTS_SQL}, r as (select *, row_number() over (partition by loop_id order by (status = 'INCONCLUSIVE')::int, ts desc, snapshot_id desc) as rn from k) select snapshot_id, loop_id, ts, score from r where rn = 1 and score < 60 order by ts desc, snapshot_id desc limit 50 offset 50")
def snapshot_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second page of loops whose latest snapshot is below 60."""
    return reports.latest_conclusive(snapshots(spark, sf_dir)).where("score < 60").orderBy(F.desc("ts"), F.desc("snapshot_id")).offset(50).limit(50).select("snapshot_id", "loop_id", "ts", "score")


@query(f"with {SNAPSHOTS_SQL}, {LEDGER_SQL} select loop_type, upper(status) as status, count(*) as n, count(distinct k.loop_id) as loops, min(ts) as first_, max(ts) as last_ from k join l using (loop_id) where ts >= '1998-06-01' and ts < '1998-09-01' group by 1, 2")
def snapshot_overview(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = snapshots(spark, sf_dir).where("ts >= '1998-06-01' and ts < '1998-09-01'").join(ledger(spark, sf_dir), "loop_id")
    return df.groupBy("loop_type", F.upper("status").alias("status")).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("loop_id").alias("loops"), F.min("ts").alias("first_"), F.max("ts").alias("last_"))


@query(
    f"""with {SAMPLES_SQL}, h as (select unnest(generate_series(timestamp '2024-01-05 06:00:00', timestamp '2024-01-05 18:00:00', interval 1 hour)) as hour),
 x as (select hour, ceil((epoch(least(hour + interval 1 hour, timestamp '2024-01-05 18:20:00')) - epoch(greatest(hour, timestamp '2024-01-05 06:30:00'))) / 300)::bigint as expected from h),
 g as (select date_trunc('hour', ts) as hour, count(*) as rows from s where ts >= '2024-01-05 06:30:00' and ts < '2024-01-05 18:20:00' group by 1)
 select x.hour::timestamp as hour, expected, coalesce(rows, 0) as rows, round(least(1.0, coalesce(rows / expected, 0)), 6) as completeness, case when coalesce(rows / expected, 0) >= 0.95 then 'COMPLETE' when coalesce(rows / expected, 0) >= 0.2 then 'PARTIAL' else 'MISSING' end as band from x left join g on x.hour = g.hour"""
)
def hourly_completeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows by hour against those of the hour's real seconds within the range."""
    axis = reports.hour_buckets(spark, "2024-01-05 06:30:00", "2024-01-05 18:20:00", 300)
    counts = samples(spark, sf_dir).where("ts >= '2024-01-05 06:30:00' and ts < '2024-01-05 18:20:00'").groupBy(F.date_trunc("hour", "ts").cast("timestamp").alias("hour")).agg(F.count(F.lit(1)).alias("rows"))
    out = reports.completeness(axis.join(counts, "hour", "left").withColumn("rows", F.coalesce("rows", F.lit(0))), F.col("expected"))
    return out.select(F.col("hour").cast("timestamp_ntz").alias("hour"), "expected", "rows", F.round("completeness", 6).alias("completeness"), "band")


@query(
    f"""with {SAMPLES_SQL}, a as (select *, row_number() over w as n, coalesce(abs(pv - lag(pv) over w) > 60, false) as ab from s {W}),
 b as (select *, max(case when ab then n end) over (w rows between unbounded preceding and 1 preceding) as bef, min(case when ab then n end) over (w rows between 1 following and unbounded following) as ahead from a {W}),
 c as (select *, sum((ab and coalesce(n - bef > 5, true))::int) over (w rows unbounded preceding) as cl from b {W}),
 d as (select *, sum(ab::int) over i as cnt, max(case when ab then n end) over i as since from c window i as (partition by loop_id, cl order by ts, event_id rows unbounded preceding)),
 e as (select *, coalesce(cnt % 2 = 1 and ahead - since <= 5, false) as spike from d) select event_id, spike, last_value(case when not spike then pv end ignore nulls) over (w rows unbounded preceding) as repaired from e {W}"""
)
def spike_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = outliers.spike_runs(samples(spark, sf_dir), "pv", KEYS, BY, 60.0)
    return df.select("event_id", "spike", outliers.repair_spikes(df, "pv", "spike", KEYS, BY).alias("repaired"))


@query(
    f"""with {SNAPSHOTS_SQL}, f as (select loop_id, ['QUALITY_ABNORMAL', 'VALVE_STICTION', 'OVERAGGRESSIVE', 'OVERCONSERVATIVE', 'OSCILLATION'][(snapshot_id % 5)::int + 1] as label, max(round(auto_rate / 40, 6)) as confidence, max(score / 100) as bad from k group by 1, 2),
 g as (select loop_id, max(bad) filter (where label = 'QUALITY_ABNORMAL') as bad, max(confidence) filter (where label = 'VALVE_STICTION') as st, max(confidence) filter (where label = 'OVERAGGRESSIVE') as hot, max(confidence) filter (where label = 'OVERCONSERVATIVE') as slow from f group by 1),
 h as (select f.loop_id, label, confidence, g.bad, case when coalesce(g.bad > 0.5, false) then label = 'QUALITY_ABNORMAL' else not (label = 'OSCILLATION' and (coalesce(st > 0.5, false) or (hot is not null and st is null))) and not (hot is not null and slow is not null and label = case when hot >= slow then 'OVERCONSERVATIVE' else 'OVERAGGRESSIVE' end) end as stays from f join g using (loop_id)),
 r as (select loop_id, label, confidence from h where stays union all select loop_id, 'MANUAL_REVIEW', 0.5 from h where not coalesce(bad > 0.5, false) group by loop_id having coalesce(max(confidence) filter (where stays), 0) < 0.5)
 select loop_id, label, confidence::double as confidence, case label when 'QUALITY_ABNORMAL' then 1 when 'VALVE_STICTION' then 2 when 'OVERAGGRESSIVE' then 3 when 'OVERCONSERVATIVE' then 4 when 'OSCILLATION' then 6 else 99 end as place from r"""
)
def expert_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = F.array(*map(F.lit, ("QUALITY_ABNORMAL", "VALVE_STICTION", "OVERAGGRESSIVE", "OVERCONSERVATIVE", "OSCILLATION")))
    found = snapshots(spark, sf_dir).groupBy("loop_id", F.element_at(names, (F.col("snapshot_id") % 5).cast("int") + 1).alias("label")).agg(F.max(F.round(F.col("auto_rate") / 40, 6)).alias("confidence"), F.max(F.col("score") / 100).alias("bad_rate"))
    return diagnosis.expert_rules(found, ["loop_id"])


@query(
    f"""with {LEDGER_SQL}, {SNAPSHOTS_SQL}, t as (select loop_id, arg_max_null(score, struct_pack(a := ts, b := snapshot_id)) as score, count(*) as n from k group by 1)
 select l.loop_id, case when l.weight is null then 'FIX_TAG_CONFIG' when t.n is null then 'IMPORT_DATA' when t.score is null or t.score < 10 then 'RUN_ASSESSMENT' when l.level = 0 then 'RUN_DIAGNOSIS' when l.level <> 1 and l.loop_id % 2 = 0 then 'CREATE_TRACKER' when l.level = 1 and l.loop_id % 3 <> 0 then 'RUN_TUNING' when l.loop_id % 3 = 0 and l.loop_type = 'FLOW' then 'RECORD_IMPLEMENTATION' when l.loop_type = 'LEVEL' then 'VERIFY_EFFECT' else 'KEEP_MONITORING' end as action from l left join t using (loop_id)"""
)
def next_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    newest = snapshots(spark, sf_dir).groupBy("loop_id").agg(F.max_by("score", F.struct("ts", "snapshot_id")).alias("score"), F.count(F.lit(1)).alias("n"))
    i = F.col("loop_id")
    df = ledger(spark, sf_dir).join(newest, "loop_id", "left").withColumns(
        {
            "complete": F.col("weight").isNotNull(),
            "has_data": F.col("n").isNotNull(),
            "assessed": F.col("score").isNotNull(),
            "worsened": F.coalesce(F.col("score") < 10, F.lit(False)),
            "diagnosed": F.col("level") != 0,
            "tunable": F.col("level") == 1,
            "tracked": i % 2 != 0,
            "tuning": F.when(i % 3 == 0, "COMPLETED"),
            "order_state": lookup("loop_type", {"FLOW": "OPEN", "LEVEL": "VERIFYING"}),
        }
    )
    return df.select("loop_id", reports.next_action().alias("action"))


@query(f"with {LEDGER_SQL} select complex_group, max(case when role = 'MAIN' then tag end) as main_tag, count(*) as members from l where complex_group is not null group by 1")
def complex_group_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger(spark, sf_dir).where("complex_group is not null").groupBy("complex_group").agg(F.max(F.when(F.col("role") == "MAIN", F.col("tag"))).alias("main_tag"), F.count(F.lit(1)).alias("members"))


@query(f"with {SNAPSHOTS_SQL} select confidence as card, round(avg(score), 6) as value, case when avg(score) >= 50 then 'NORMAL' when avg(score) >= 45 then 'WARNING' else 'DANGER' end as state from k where ts >= '1999-01-01' group by 1")
def indicator_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    mean = F.avg("score")
    return snapshots(spark, sf_dir).where("ts >= '1999-01-01'").groupBy(F.col("confidence").alias("card")).agg(F.round(mean, 6).alias("value"), F.when(mean >= 50, "NORMAL").when(mean >= 45, "WARNING").otherwise("DANGER").alias("state"))


@query(f"with {SAMPLES_SQL}, m as (select * from (values (0, 10, 0), (0, 11, 3), (1, 2, 1)) t(model, raw, standard)) select event_id, coalesce(standard, mode) as mode from s left join m on m.model = s.loop_id % 2 and m.raw = s.mode + case when s.loop_id % 2 = 0 then 10 else 0 end")
def mode_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw modes of each controller model as standard ones; those without a mapping stay."""
    mapping = spark.createDataFrame([(0, 10, 0), (0, 11, 3), (1, 2, 1)], "model long, raw int, standard int")
    df = samples(spark, sf_dir).withColumn("model", F.col("loop_id") % 2)
    df = df.withColumn("raw", F.col("mode") + F.when(F.col("model") == 0, 10).otherwise(0))
    return df.join(F.broadcast(mapping), ["model", "raw"], "left").select("event_id", F.coalesce("standard", "mode").alias("mode"))  # a few rows a model


@query(f"with {WORK_SQL} select action as label, count(*) filter (where state not in ('CLOSED', 'CANCELLED')) as open_, count(*) filter (where state = 'CLOSED') as archived, count(*) as n from w group by 1")
def task_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = F.col("state").isin("CLOSED", "CANCELLED")
    return orders_of_work(spark, sf_dir).groupBy(F.col("action").alias("label")).agg(F.count_if(~done).alias("open_"), F.count_if(F.col("state") == "CLOSED").alias("archived"), F.count(F.lit(1)).alias("n"))
