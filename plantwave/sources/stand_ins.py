"""The domain's tables, drawn from the driver's: loops from users, snapshots from orders, the plant tree from nations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """event_id, loop_id, ts, pv, sp, op, mode, quality."""
    kind = F.col("event_type")
    return table(spark, sf_dir, "events").select(
        "event_id",
        F.col("user_id").alias("loop_id"),
        "ts",
        F.col("value").alias("pv"),
        F.lit(50.0).alias("sp"),
        F.get_json_object("props", "$.k").cast("double").alias("op"),
        F.when(kind == "signup", 0).when(kind == "view", 1).when(kind == "click", 2).when(kind == "purchase", 3).otherwise(4).alias("mode"),
        F.when(kind == "error", 0).when(kind != "signup", 192).alias("quality"),
    )


SAMPLES_SQL = """s as (select event_id, user_id as loop_id, ts, value as pv, 50.0::double as sp, cast(props->>'k' as double) as op,
 case event_type when 'signup' then 0 when 'view' then 1 when 'click' then 2 when 'purchase' then 3 else 4 end as mode,
 case when event_type = 'error' then 0 when event_type <> 'signup' then 192 end as quality from events)"""


def snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly indicator snapshots: snapshot_id, loop_id, ts, score (null for a part), auto_rate, loop_count, confidence, status."""
    price = F.col("o_totalprice")
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("snapshot_id"),
        F.col("o_custkey").alias("loop_id"),
        F.col("o_orderdate").alias("ts"),
        F.when(F.col("o_orderstatus") != "P", F.round(price % 100, 2)).alias("score"),
        F.round(price % 37, 2).alias("auto_rate"),
        (F.col("o_orderkey") % 5).cast("int").alias("loop_count"),
        F.element_at(F.array(*map(F.lit, "ABCDE")), (F.substring("o_orderpriority", 1, 1).cast("int"))).alias("confidence"),
        F.when(F.col("o_orderstatus") == "P", "INCONCLUSIVE").otherwise("SUCCESS").alias("status"),
    )


SNAPSHOTS_SQL = """k as (select o_orderkey as snapshot_id, o_custkey as loop_id, o_orderdate as ts,
 case when o_orderstatus <> 'P' then round(o_totalprice % 100, 2) end as score, round(o_totalprice % 37, 2) as auto_rate,
 (o_orderkey % 5)::int as loop_count, ['A', 'B', 'C', 'D', 'E'][left(o_orderpriority, 1)::int] as confidence,
 case when o_orderstatus = 'P' then 'INCONCLUSIVE' else 'SUCCESS' end as status from orders)"""


def ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Loops: loop_id, tag, unit_id, level (importance), weight, loop_type, complex_group, role, is_active."""
    key = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select(
        key.alias("loop_id"),
        F.col("c_name").alias("tag"),
        F.col("c_nationkey").alias("unit_id"),
        (key % 4).cast("int").alias("level"),
        F.when(key % 7 != 0, F.round(F.col("c_acctbal") % 3, 2)).alias("weight"),
        F.element_at(F.array(*map(F.lit, ("FLOW", "PRESSURE", "TEMPERATURE", "LEVEL", "SPEED"))), (key % 5).cast("int") + 1).alias("loop_type"),
        F.when(key % 3 == 0, (key / 9).cast("long")).alias("complex_group"),
        F.when(key % 18 == 0, "MAIN").otherwise("AUX").alias("role"),
        (key % 10 != 0).alias("is_active"),
    )


LEDGER_SQL = """l as (select c_custkey as loop_id, c_name as tag, c_nationkey as unit_id, (c_custkey % 4)::int as level,
 case when c_custkey % 7 <> 0 then round(c_acctbal % 3, 2) end as weight, ['FLOW', 'PRESSURE', 'TEMPERATURE', 'LEVEL', 'SPEED'][(c_custkey % 5)::int + 1] as loop_type,
 case when c_custkey % 3 = 0 then c_custkey // 9 end as complex_group, case when c_custkey % 18 = 0 then 'MAIN' else 'AUX' end as role, c_custkey % 10 <> 0 as is_active from customer)"""


def plant_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FACTORY (region) → AREA (nation) → UNIT (supplier): id, parent_id, kind."""
    region = table(spark, sf_dir, "region").select(F.col("r_regionkey").cast("long").alias("id"), F.lit(None).cast("long").alias("parent_id"), F.lit("FACTORY").alias("kind"))
    nation = table(spark, sf_dir, "nation").select((F.col("n_nationkey") + 100).cast("long").alias("id"), F.col("n_regionkey").cast("long").alias("parent_id"), F.lit("AREA").alias("kind"))
    unit = table(spark, sf_dir, "supplier").select((F.col("s_suppkey") + 1000).alias("id"), (F.col("s_nationkey") + 100).cast("long").alias("parent_id"), F.lit("UNIT").alias("kind"))
    return region.unionByName(nation).unionByName(unit)


NODES_SQL = """n as (select r_regionkey::bigint as id, null::bigint as parent_id, 'FACTORY' as kind from region union all
 select n_nationkey + 100, n_regionkey, 'AREA' from nation union all select s_suppkey + 1000, s_nationkey + 100, 'UNIT' from supplier)"""


def orders_of_work(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Handling orders from line items: order_id, line, loop_id, state, action, started, verified, delta."""
    states = ("OPEN", "ACKNOWLEDGED", "IN_PROGRESS", "VERIFYING", "CLOSED", "CANCELLED")
    line = F.col("l_linenumber")
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("order_id"),
        line.alias("line"),
        F.col("l_suppkey").alias("loop_id"),
        F.element_at(F.array(*map(F.lit, states)), ((F.col("l_partkey") + line) % 6).cast("int") + 1).alias("state"),
        F.col("l_returnflag").alias("action"),
        F.col("l_shipdate").alias("started"),
        F.when(F.col("l_linestatus") == "F", F.col("l_shipdate") + F.make_dt_interval(F.lit(0), F.col("l_quantity").cast("int"))).alias("verified"),
        F.round(F.col("l_discount") * 100 - 5, 2).alias("delta"),
        "l_partkey",
    )


WORK_SQL = """w as (select l_orderkey as order_id, l_linenumber as line, l_suppkey as loop_id,
 ['OPEN', 'ACKNOWLEDGED', 'IN_PROGRESS', 'VERIFYING', 'CLOSED', 'CANCELLED'][((l_partkey + l_linenumber) % 6)::int + 1] as state, l_returnflag as action, l_shipdate as started,
 case when l_linestatus = 'F' then l_shipdate + to_hours(l_quantity::int) end as verified, round(l_discount * 100 - 5, 2) as delta, l_partkey from lineitem)"""
