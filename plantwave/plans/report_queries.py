"""Queries on snapshots, the plant tree and work orders; each with its DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.signals import lookup, score_grade
from ..operators import reports, rollup, segments
from ..sources.stand_ins import LEDGER_SQL, NODES_SQL, SAMPLES_SQL, SNAPSHOTS_SQL, WORK_SQL, ledger, orders_of_work, plant_nodes, samples, snapshots, table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


_GRADE = "case when score is null then 'INCONCLUSIVE' when score >= 90 then 'EXCELLENT' when score >= 80 then 'GOOD' when score >= 70 then 'FAIR' when score >= 60 then 'POOR' else 'BAD' end"
_LATEST = f"with {SNAPSHOTS_SQL}, r as (select *, row_number() over (partition by loop_id order by (status = 'INCONCLUSIVE')::int, ts desc, snapshot_id desc) as rn from k), t as (select * exclude (rn) from r where rn = 1) "
_LEVEL = "case level when 1 then 3.0 when 2 then 2.0 when 3 then 1.0 else 1.0 end"


@query(
    f"""with {SNAPSHOTS_SQL}, {LEDGER_SQL}, j as (select * from k join l using (loop_id)) select unit_id,
 round(sum(score * coalesce(weight, 1)) / sum(coalesce(weight, 1)), 4) as w1, round_even(case when count(score) > 0 then sum(score * {_LEVEL}) / sum({_LEVEL}) end, 2) as w2,
 round(case when sum(case when score is not null then loop_count end) <> 0 then sum(score * loop_count) / sum(case when score is not null then loop_count end) else avg(score) end, 4) as w3,
 round(sum(score * loop_count) / sum(loop_count) filter (where score is not null), 4) as w4,
 round(case when sum(auto_rate) filter (where score is not null) > 0 then sum(score * auto_rate) / sum(auto_rate) filter (where score is not null) else avg(score) end, 4) as w5,
 round(sum({_LEVEL} * score) filter (where confidence <> 'E') / sum({_LEVEL}) filter (where confidence <> 'E' and score is not null), 4) as w6, max(confidence) as worst from j group by unit_id"""
)
def weighted_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = snapshots(spark, sf_dir).join(ledger(spark, sf_dir), "loop_id")
    return df.groupBy("unit_id").agg(
        F.round(rollup.mean_all_rows("score", "weight"), 4).alias("w1"),
        rollup.mean_level("score", "level").alias("w2"),
        F.round(rollup.mean_present("score", "loop_count"), 4).alias("w3"),
        F.round(rollup.mean_filtered("score", "loop_count"), 4).alias("w4"),
        F.round(rollup.mean_valid("score", "auto_rate"), 4).alias("w5"),
        F.round(rollup.mean_conclusive("score", "level", "confidence"), 4).alias("w6"),
        rollup.worst("confidence").alias("worst"),
    )


def _period(period: str) -> str:
    return f"with {SNAPSHOTS_SQL}, {LEDGER_SQL} select unit_id, date_trunc('{period}', ts)::timestamp as period, round(case when sum(case when score is not null then loop_count end) <> 0 then sum(score * loop_count) / sum(case when score is not null then loop_count end) else avg(score) end, 7) as score, max(loop_count) as loop_count from k join l using (loop_id) group by 1, 2"


def _rolled(spark: SparkSession, sf_dir: str, period: str) -> DataFrame:
    df = snapshots(spark, sf_dir).join(ledger(spark, sf_dir), "loop_id")
    return rollup.period_rollup(df, ["unit_id"], "ts", period, ["score"]).withColumns({"score": F.round("score", 7), "period": F.col("period").cast("timestamp_ntz")})


@query(_period("day"))
def daily_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rolled(spark, sf_dir, "day")


@query(_period("month"))
def monthly_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rolled(spark, sf_dir, "month")


@query(f"with recursive {NODES_SQL}, t(root, node) as (select id, id from n union all select t.root, n.id from t join n on n.parent_id = t.node) select root, count(*) - 1 as below, count_if(n.kind = 'UNIT') as units from t join n on n.id = t.node group by root")
def plant_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = plant_nodes(spark, sf_dir)
    pairs = rollup.descendants(nodes)
    return pairs.join(nodes.select(F.col("id").alias("node"), "kind"), "node").groupBy("root").agg((F.count(F.lit(1)) - 1).alias("below"), F.count_if(F.col("kind") == "UNIT").alias("units"))


@query(
    f"""with recursive {NODES_SQL}, {SNAPSHOTS_SQL}, {LEDGER_SQL}, t(root, node) as (select id, id from n union all select t.root, n.id from t join n on n.parent_id = t.node),
 r as (select *, row_number() over (partition by loop_id order by (status = 'INCONCLUSIVE')::int, ts desc, snapshot_id desc) as rn from k),
 j as (select t.root, r.*, l.level from r join l using (loop_id) join t on t.node = l.unit_id + 100 where rn = 1 and l.is_active)
 select root, count(*) as loops, round_even(case when count(score) > 0 then sum(score * {_LEVEL}) / sum({_LEVEL}) end, 2) as score, count_if(status = 'INCONCLUSIVE') as inconclusive from j group by root"""
)
def node_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = rollup.descendants(plant_nodes(spark, sf_dir)).select("root", (F.col("node") - 100).alias("unit_id"))
    loops = ledger(spark, sf_dir).where("is_active")
    df = reports.latest_conclusive(snapshots(spark, sf_dir)).join(loops, "loop_id").join(pairs, "unit_id")
    return df.groupBy("root").agg(F.count(F.lit(1)).alias("loops"), rollup.mean_level("score", "level").alias("score"), F.count_if(F.col("status") == "INCONCLUSIVE").alias("inconclusive"))


@query(_LATEST + f"select {_GRADE} as grade, count(*) as loops from t group by 1")
def grade_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.grade_distribution(snapshots(spark, sf_dir))


@query(_LATEST + "select loop_id, score, ts from t order by score nulls last, loop_id limit 20 offset 5")
def worst_loops(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.ranking(snapshots(spark, sf_dir), 20, 5).select("loop_id", "score", "ts")


@query(_LATEST + f", {LEDGER_SQL} select unit_id, round(avg(score), 9) as score, count(*) as loops from t join l using (loop_id) group by unit_id".replace(", l as", ", l as"))
def unit_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = reports.latest_conclusive(snapshots(spark, sf_dir)).join(ledger(spark, sf_dir), "loop_id")
    return df.groupBy("unit_id").agg(F.round(F.avg("score"), 9).alias("score"), F.count(F.lit(1)).alias("loops")).orderBy(F.asc_nulls_last("score"), "unit_id")


@query(
    f"""with {SNAPSHOTS_SQL}, d as (select unnest(generate_series(date '1998-03-01', date '1998-03-30', interval 1 day))::date as day),
 g as (select ts::date as day, round(avg(score), 4) as score, count(*) as snapshots from k where ts >= '1998-03-01' and ts < '1998-03-31' group by 1) select d.day, score, snapshots from d left join g using (day)"""
)
def dense_trend(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.dense_trend(snapshots(spark, sf_dir), "ts", "1998-03-01", 30, {"score": F.round(F.avg("score"), 4), "snapshots": F.count(F.lit(1))})


@query(f"with {SNAPSHOTS_SQL} select date_trunc('week', ts)::timestamp as bucket, round(avg(score), 7) as score, round(sum(score * loop_count) / nullif(sum(loop_count), 0), 7) as board, round(avg((auto_rate > 10)::int) * 100, 7) as auto_share from k group by 1")
def weekly_trend(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = snapshots(spark, sf_dir).groupBy(F.date_trunc("week", "ts").cast("timestamp_ntz").alias("bucket"))
    return df.agg(F.round(F.avg("score"), 7).alias("score"), F.round(F.try_divide(F.sum(F.col("score") * F.col("loop_count")), F.sum("loop_count")), 7).alias("board"), F.round(F.avg((F.col("auto_rate") > 10).cast("int")) * 100, 7).alias("auto_share"))


@query(f"with {SNAPSHOTS_SQL} select round(avg(score) filter (where ts >= '1998-01-01' and ts < '1999-01-01'), 4) as now_, round(avg(score) filter (where ts >= '1997-01-01' and ts < '1998-01-01'), 4) as before_, count(distinct loop_id) as loops from k")
def two_periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = lambda a, b: F.round(F.avg(F.when((F.col("ts") >= a) & (F.col("ts") < b), F.col("score"))), 4)
    return snapshots(spark, sf_dir).agg(part("1998-01-01", "1999-01-01").alias("now_"), part("1997-01-01", "1998-01-01").alias("before_"), F.countDistinct("loop_id").alias("loops"))


@query(
    f"""with {WORK_SQL} select loop_id, {", ".join(f"count(*) filter (where state = '{s}') as n_{s.lower()}" for s in ("OPEN", "ACKNOWLEDGED", "IN_PROGRESS", "VERIFYING", "CLOSED", "CANCELLED"))},
 max_by(action, struct_pack(a := started, b := order_id, c := line)) filter (where state <> 'CANCELLED') as last_action, round(avg(epoch(verified) - epoch(started)) / 3600, 4) as mean_hours, round(avg((delta > 0)::int) * 100, 4) as improved from w group by loop_id"""
)
def handling_by_loop(spark: SparkSession, sf_dir: str) -> DataFrame:
    states = ("OPEN", "ACKNOWLEDGED", "IN_PROGRESS", "VERIFYING", "CLOSED", "CANCELLED")
    hours = (segments.seconds("verified") - segments.seconds("started")) / 3600
    return orders_of_work(spark, sf_dir).groupBy("loop_id").agg(
        *(F.count_if(F.col("state") == s).alias(f"n_{s.lower()}") for s in states),
        F.max_by("action", F.when(F.col("state") != "CANCELLED", F.struct("started", "order_id", "line"))).alias("last_action"),
        F.round(F.avg(hours), 4).alias("mean_hours"),
        F.round(F.avg((F.col("delta") > 0).cast("int")) * 100, 4).alias("improved"),
    )


@query(
    f"""with {WORK_SQL}, m as (select strftime(started + interval 8 hours, '%Y-%m') as month, * from w),
 a as (select strftime(unnest(generate_series(timestamp '1996-01-01', timestamp '1997-12-01', interval 1 month)), '%Y-%m') as month),
 g as (select month, count(*) as orders, count_if(state = 'CLOSED') as closed, round(avg(delta), 4) as delta from m group by month) select a.month, coalesce(orders, 0) as orders, coalesce(closed, 0) as closed, delta from a left join g using (month)"""
)
def handling_by_month(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Months run in the plant's zone, eight hours ahead of UTC."""
    month = F.date_format(F.from_utc_timestamp(F.col("started").cast("timestamp"), "Asia/Shanghai"), "yyyy-MM")
    made = orders_of_work(spark, sf_dir).groupBy(month.alias("month")).agg(F.count(F.lit(1)).alias("orders"), F.count_if(F.col("state") == "CLOSED").alias("closed"), F.round(F.avg("delta"), 4).alias("delta"))
    axis = spark.range(1).select(F.explode(F.expr("sequence(date'1996-01-01', date'1997-12-01', interval 1 month)")).alias("d")).select(F.date_format("d", "yyyy-MM").alias("month"))
    return axis.join(made, "month", "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in ("orders", "closed")})


@query(f"with {WORK_SQL}, r as (select 'HD-' || strftime(started, '%Y%m%d') || '-' || lpad((row_number() over (partition by started order by order_id, line, l_partkey, loop_id))::varchar, 3, '0') as order_no, order_id, line, loop_id from w where state = 'OPEN') select * from r")
def order_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("started").orderBy("order_id", "line", "l_partkey", "loop_id")
    number = F.concat(F.lit("HD-"), F.date_format("started", "yyyyMMdd"), F.lit("-"), F.lpad(F.row_number().over(w).cast("string"), 3, "0"))
    return orders_of_work(spark, sf_dir).where("state = 'OPEN'").select(number.alias("order_no"), "order_id", "line", "loop_id")


@query(
    f"""with {SAMPLES_SQL}, h as (select loop_id, ts::date as day, count(*) as rows from s group by 1, 2), a as (select distinct loop_id from s), d as (select unnest(generate_series(date '2024-01-01', date '2024-01-10', interval 1 day))::date as day),
 j as (select a.loop_id, d.day, coalesce(h.rows, 0) as rows, least(1.0, coalesce(h.rows, 0) / 4.0) as c from a cross join d left join h on a.loop_id = h.loop_id and d.day = h.day)
 select loop_id, day, rows, round(c, 4) as completeness, case when c >= 0.95 then 'COMPLETE' when c >= 0.2 then 'PARTIAL' else 'MISSING' end as band from j"""
)
def data_integrity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows a loop and day against the expected number, on a calendar without gaps."""
    df = samples(spark, sf_dir)
    counts = df.groupBy("loop_id", F.to_date("ts").alias("day")).agg(F.count(F.lit(1)).alias("rows"))
    axis = df.select("loop_id").distinct().select("loop_id", F.explode(F.expr("sequence(date'2024-01-01', date'2024-01-10')")).alias("day"))
    filled = axis.join(counts, ["loop_id", "day"], "left").withColumn("rows", F.coalesce("rows", F.lit(0)))
    return reports.completeness(filled, F.lit(4.0)).withColumn("completeness", F.round("completeness", 4))


@query(
    f"""with {SNAPSHOTS_SQL}, x as (select *, row_number() over (partition by loop_id order by ts, snapshot_id) - 1 as i, count(*) over (partition by loop_id) as n from k),
 g as (select loop_id, max(n) as n, regr_slope(score, i) as slope, regr_intercept(score, i) as cut, count(score) as have, regr_slope(auto_rate, i) as o_slope, regr_intercept(auto_rate, i) as o_cut from x group by loop_id having count(score) >= 3 and max(n) >= 12),
 f as (select *, cut + slope * (n - 1 + 24) as s, o_cut + o_slope * (n - 1 + 24) as o from g),
 r as (select *, case when slope < -0.01 then least(35, abs(slope) * 20 * case when s <= 60 then 1.5 else greatest(0.5, 100 - s) / 40 end) else 0 end as a, case when o_slope > 0.01 then least(25, abs(o_slope) * 20 * case when o >= 20 then 1.5 else greatest(0.5, o / 20) end) else 0 end as b from f)
 select loop_id, round(slope, 6) as slope, round(s, 7) as forecast, round(a + b, 4) as risk, case when a + b >= 60 then 'HIGH' when a + b >= 30 then 'MEDIUM' else 'LOW' end as band from r"""
)
def risk_prediction(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("loop_id").orderBy("ts", "snapshot_id")
    df = snapshots(spark, sf_dir).withColumn("i", (F.row_number().over(w) - 1).cast("double"))
    slope, cut = reports.regression(F.col("i"), F.col("score"))
    o_slope, o_cut = reports.regression(F.col("i"), F.col("auto_rate"))
    g = df.groupBy("loop_id").agg(F.count(F.lit(1)).alias("n"), slope.alias("slope"), cut.alias("cut"), o_slope.alias("o_slope"), o_cut.alias("o_cut")).where("n >= 12 and slope is not null")
    ahead = F.col("n") - 1 + 24
    g = g.withColumns({"s": F.col("cut") + F.col("slope") * ahead, "o": F.col("o_cut") + F.col("o_slope") * ahead})
    risk = reports.contribution("score", F.col("slope"), F.col("s")) + reports.contribution("oscillation", F.col("o_slope"), F.col("o"))
    g = g.withColumn("risk", risk)
    return g.select("loop_id", F.round("slope", 6).alias("slope"), F.round("s", 7).alias("forecast"), F.round("risk", 4).alias("risk"), F.when(F.col("risk") >= 60, "HIGH").when(F.col("risk") >= 30, "MEDIUM").otherwise("LOW").alias("band"))


_ATTENTION = f"""with {SNAPSHOTS_SQL}, {SAMPLES_SQL}, p as (select *, lag(score) over (partition by loop_id order by ts, snapshot_id) as before_, row_number() over (partition by loop_id order by ts desc, snapshot_id desc) as rn from k where score is not null),
 i as (select loop_id, case when score - before_ <= -10 then 1 when score - before_ <= -5 then 2 else 3 end as urgency, 0 as stage, ts, 'degradation' as kind from p where rn = 1 and score - before_ <= -2
 union all select loop_id, case when confidence = 'E' then 1 else 2 end, 3, ts, 'data quality' from p where rn = 1 and confidence in ('D', 'E')
 union all select loop_id, case when pv > 200 then 0 when pv > 100 then 1 when pv > 50 then 2 else 3 end, 1, ts, 'alert' from s where quality = 0)
 select loop_id, min(urgency)::int as urgency, min(stage)::int as stage, max(ts) as newest, count(*) as items, array_to_string(list_sort(list_distinct(list(kind))), ',') as kinds from i group by loop_id order by urgency, stage, newest desc, loop_id limit 500"""


@query(_ATTENTION)
def attention_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("loop_id").orderBy("ts", "snapshot_id")
    newest = Window.partitionBy("loop_id").orderBy(F.desc("ts"), F.desc("snapshot_id"))
    scored = snapshots(spark, sf_dir).where("score is not null").withColumns({"change": F.col("score") - F.lag("score").over(w), "rn": F.row_number().over(newest)}).where("rn = 1")
    falls = scored.withColumn("priority", reports.fall_priority("change")).where("priority is not null").select("loop_id", "priority", F.lit("OPEN").alias("stage"), "ts", F.lit("degradation").alias("kind"))
    data = scored.where("confidence in ('D', 'E')").select("loop_id", F.when(F.col("confidence") == "E", "HIGH").otherwise("MEDIUM").alias("priority"), F.lit("ACKNOWLEDGED").alias("stage"), "ts", F.lit("data quality").alias("kind"))
    severity = F.when(F.col("pv") > 200, "CRITICAL").when(F.col("pv") > 100, "ERROR").when(F.col("pv") > 50, "WARN").otherwise("INFO")
    alerts = samples(spark, sf_dir).where("quality = 0").select("loop_id", reports.priority(severity).alias("priority"), F.lit("OVERDUE").alias("stage"), "ts", F.lit("alert").alias("kind"))
    return reports.attention([falls, data, alerts], 0).withColumn("kinds", F.array_join("kinds", ","))


@query(
    f"""with {LEDGER_SQL}, {SNAPSHOTS_SQL}, c as (select loop_id, max_by(confidence, snapshot_id) as confidence from k group by loop_id), j as (select l.*, c.confidence from l left join c using (loop_id)),
 r as (select *, row_number() over (partition by complex_group order by (role <> 'MAIN')::int, confidence nulls last, loop_id) as rn from j where complex_group is not null)
 select loop_id, complex_group, confidence from r where rn = 1 union all select loop_id, complex_group, confidence from j where complex_group is null"""
)
def complex_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = snapshots(spark, sf_dir).groupBy("loop_id").agg(F.max_by("confidence", "snapshot_id").alias("confidence"))
    df = ledger(spark, sf_dir).join(known, "loop_id", "left")
    return rollup.representatives(df, "complex_group", "role", "confidence", "loop_id").select("loop_id", "complex_group", "confidence")


@query(f"with {SNAPSHOTS_SQL}, i as (select distinct loop_id from k where status = 'INCONCLUSIVE' and ts >= '1999-01-01'), s as (select distinct loop_id from k where status = 'SUCCESS' and ts >= '1999-01-01') select loop_id from i where loop_id not in (select loop_id from s)")
def inconclusive_loops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Loops with inconclusive snapshots and no successful one in the window: an anti join."""
    df = snapshots(spark, sf_dir).where("ts >= '1999-01-01'")
    return df.where("status = 'INCONCLUSIVE'").select("loop_id").distinct().join(df.where("status = 'SUCCESS'").select("loop_id"), "loop_id", "left_anti")


@query(f"with {SNAPSHOTS_SQL}, {LEDGER_SQL} select l.loop_id, l.tag from l where exists (select 1 from k where k.loop_id = l.loop_id and k.score < 5) and lower(l.tag) like '%00000%' and upper(l.loop_type) = 'FLOW'")
def list_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    low = snapshots(spark, sf_dir).where("score < 5").select("loop_id")
    return ledger(spark, sf_dir).where(F.col("tag").ilike("%00000%") & (F.upper("loop_type") == "FLOW")).join(low, "loop_id", "left_semi").select("loop_id", "tag")


@query(f"with {SNAPSHOTS_SQL} select loop_id, round(avg(score) filter (where ts >= '1997-12-02' and ts < '1998-01-01'), 4) as score_before, round(avg(score) filter (where ts >= '1998-01-01' and ts <= '1998-01-31'), 4) as score_after, round(avg(score) filter (where ts >= '1998-01-01' and ts <= '1998-01-31') - avg(score) filter (where ts >= '1997-12-02' and ts < '1998-01-01'), 4) as score_change from k group by loop_id")
def before_after(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = reports.before_after(snapshots(spark, sf_dir), ["loop_id"], "ts", F.to_timestamp_ntz(F.lit("1998-01-01 00:00:00")), 30, ["score"])
    return out.select("loop_id", *(F.round(c, 4).alias(c) for c in ("score_before", "score_after", "score_change")))


@query(
    f"""with {SNAPSHOTS_SQL}, a as (select loop_id, confidence as label, round(avg(auto_rate) / 37, 4) as was from k where ts < '1998-01-01' group by 1, 2), b as (select loop_id, confidence as label, round(avg(auto_rate) / 37, 4) as now from k where ts >= '1998-01-01' group by 1, 2),
 j as (select coalesce(a.loop_id, b.loop_id) as loop_id, coalesce(a.label, b.label) as label, was, now from a full join b on a.loop_id = b.loop_id and a.label = b.label)
 select *, case when was is null then 'added' when now is null then 'removed' else 'changed' end as change from j where was is null or now is null or abs(now - was) > 0.01"""
)
def label_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = snapshots(spark, sf_dir).withColumnRenamed("confidence", "label")
    part = lambda x: x.groupBy("loop_id", "label").agg(F.round(F.avg("auto_rate") / 37, 4).alias("confidence"))
    return reports.label_changes(part(df.where("ts < '1998-01-01'")), part(df.where("ts >= '1998-01-01'")), ["loop_id", "label"])


@query(
    f"""with {SNAPSHOTS_SQL}, a as (select *, row_number() over (partition by loop_id order by ts desc, snapshot_id desc) as rn from k where ts < '1999-06-01') , b as (select * from a where rn <= 2),
 p as (select loop_id, max(case when rn = 1 then score end) as now_, max(case when rn = 2 then score end) as before_, max(case when rn = 1 then auto_rate end) as auto from b group by loop_id)
 select {_GRADE.replace('score', 'now_')} as grade, count(*) as loops, round(avg(now_), 4) as mean, count(*) filter (where now_ - before_ <= -2) as worsened, round(avg((auto > 0)::int) * 100, 4) as auto_share from p group by 1"""
)
def monitor_aggregate(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("loop_id").orderBy(F.desc("ts"), F.desc("snapshot_id"))
    last = snapshots(spark, sf_dir).where("ts < '1999-06-01'").withColumn("rn", F.row_number().over(w)).where("rn <= 2")
    pick = lambda c, n: F.max(F.when(F.col("rn") == n, F.col(c)))
    p = last.groupBy("loop_id").agg(pick("score", 1).alias("now_"), pick("score", 2).alias("before_"), pick("auto_rate", 1).alias("auto"))
    return p.groupBy(score_grade("now_").alias("grade")).agg(F.count(F.lit(1)).alias("loops"), F.round(F.avg("now_"), 4).alias("mean"), F.count_if(F.col("now_") - F.col("before_") <= -2).alias("worsened"), F.round(F.avg((F.col("auto") > 0).cast("int")) * 100, 4).alias("auto_share"))


@query(f"with {SAMPLES_SQL}, l as (select loop_id, max_by(mode, struct_pack(a := ts, b := event_id)) as mode from s group by loop_id) select loop_id % 7 as node, round(avg((mode in (1, 2, 3))::int) * 100, 4) as auto_rate, count(*) as loops from l group by 1")
def realtime_auto_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of loops whose latest mode counts as automatic, by node."""
    newest = samples(spark, sf_dir).groupBy("loop_id").agg(F.max_by("mode", F.struct("ts", "event_id")).alias("mode"))
    return newest.groupBy((F.col("loop_id") % 7).alias("node")).agg(F.round(F.avg(F.col("mode").isin(1, 2, 3).cast("int")) * 100, 4).alias("auto_rate"), F.count(F.lit(1)).alias("loops"))


@query(f"with {SNAPSHOTS_SQL}, c as (select loop_id, ts, score + 1 as score, snapshot_id from k where snapshot_id % 10 = 0), u as (select *, row_number() over (partition by loop_id, ts order by snapshot_id desc) as rn from c), x as (select * from u where rn = 1) select loop_id, ts, score, snapshot_id from k where not exists (select 1 from x where x.loop_id = k.loop_id and x.ts = k.ts) union all select loop_id, ts, score, snapshot_id from x")
def snapshot_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    old = snapshots(spark, sf_dir).select("loop_id", "ts", "score", "snapshot_id")
    return segments.upsert(old, old.where("snapshot_id % 10 = 0").withColumn("score", F.col("score") + 1), ["loop_id", "ts"], "snapshot_id")


@query("select c_nationkey as unit_id, count(*) as items, count_if(c_acctbal > 5000) as improved, count_if(c_acctbal < 0) as worse, round(avg(c_acctbal), 6) as mean, round(100.0 * count_if(c_acctbal > 5000) / count(*), 4) as rate from customer group by 1")
def knowledge_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    bal = F.col("c_acctbal")
    return table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("unit_id")).agg(F.count(F.lit(1)).alias("items"), F.count_if(bal > 5000).alias("improved"), F.count_if(bal < 0).alias("worse"), F.round(F.avg(bal), 6).alias("mean"), F.round(100.0 * F.count_if(bal > 5000) / F.count(F.lit(1)), 4).alias("rate"))


@query(f"with {WORK_SQL}, b as (select case when epoch(verified) - epoch(started) < 14400 then 'under 4 h' when epoch(verified) - epoch(started) < 86400 then 'under 1 d' when verified is not null then 'longer' else 'open' end as bucket, delta from w) select bucket, count(*) as orders, round(avg(delta), 4) as delta from b group by bucket")
def close_durations(spark: SparkSession, sf_dir: str) -> DataFrame:
    took = segments.seconds("verified") - segments.seconds("started")
    bucket = F.when(took < 14_400, "under 4 h").when(took < 86_400, "under 1 d").when(took.isNotNull(), "longer").otherwise("open")
    return orders_of_work(spark, sf_dir).groupBy(bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("orders"), F.round(F.avg("delta"), 4).alias("delta"))


@query(
    f"""with {LEDGER_SQL}, {SNAPSHOTS_SQL}, {WORK_SQL}, a as (select loop_id, count(*) as snapshots, max(ts) as last_snapshot from k group by loop_id), o as (select loop_id, count(*) as orders, max(started) as last_order from w group by loop_id)
 select l.loop_id, coalesce(snapshots, 0) as snapshots, coalesce(orders, 0) as orders, greatest(coalesce(last_snapshot, timestamp '1970-01-01'), coalesce(last_order, timestamp '1970-01-01')) as recent from l left join a using (loop_id) left join o using (loop_id)"""
)
def archive_by_loop(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both sides are aggregated before the join, so no side multiplies the other's rows."""
    a = snapshots(spark, sf_dir).groupBy("loop_id").agg(F.count(F.lit(1)).alias("snapshots"), F.max("ts").alias("last_snapshot"))
    o = orders_of_work(spark, sf_dir).groupBy("loop_id").agg(F.count(F.lit(1)).alias("orders"), F.max("started").alias("last_order"))
    never = F.to_timestamp_ntz(F.lit("1970-01-01 00:00:00"))
    df = ledger(spark, sf_dir).join(a, "loop_id", "left").join(o, "loop_id", "left")
    return df.select("loop_id", F.coalesce("snapshots", F.lit(0)).alias("snapshots"), F.coalesce("orders", F.lit(0)).alias("orders"), F.greatest(F.coalesce("last_snapshot", never), F.coalesce("last_order", never)).alias("recent"))


@query(f"with {LEDGER_SQL}, {SNAPSHOTS_SQL} select l.loop_id, x.score, x.ts, y.n from l left join lateral (select score, ts from k where k.loop_id = l.loop_id order by ts desc, snapshot_id desc limit 1) x on true left join lateral (select count(*) as n from k where k.loop_id = l.loop_id and k.score < 50) y on true")
def lateral_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The top row and a count for each loop, by one grouping instead of correlated queries."""
    per = snapshots(spark, sf_dir).groupBy("loop_id").agg(F.max(F.struct("ts", "snapshot_id", "score")).alias("x"), F.count_if(F.col("score") < 50).alias("n"))
    return ledger(spark, sf_dir).join(per, "loop_id", "left").select("loop_id", "x.score", "x.ts", F.coalesce("n", F.lit(0)).alias("n"))


@query(f"with {SNAPSHOTS_SQL} select case when get_level = 0 then 'LOW' when get_level = 1 then 'MEDIUM' else 'HIGH' end as risk, count(*) as n from (select json_extract(props, '$.k')::int % 3 as get_level from events) group by 1")
def risk_from_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    level = F.get_json_object("props", "$.k").cast("int") % 3
    return table(spark, sf_dir, "events").groupBy(lookup(level, {0: "LOW", 1: "MEDIUM"}, "HIGH").alias("risk")).agg(F.count(F.lit(1)).alias("n"))
