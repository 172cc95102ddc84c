"""Queries on diagnosis, identification, tuning, rules and streams; DuckDB SQL where SQL can say it."""

from __future__ import annotations

import json

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.signals import normalise, quality
from ..operators import diagnosis, folds, identify, kernels, moments, outliers, rules, segments, tuning
from ..operators.reports import escalated
from ..sources.stand_ins import LEDGER_SQL, SAMPLES_SQL, SNAPSHOTS_SQL, WORK_SQL, ledger, orders_of_work, samples, snapshots, table
from ..streaming import samples as stream

#: Samples of one loop that a kernel sees at most.
SEGMENT = 3600
#: Samples of one waveform at most: a day of seconds.
WAVEFORM = 86_400
#: Loops that are simulated side by side, whose responses are in memory at once.
SIMULATED = 2_000

#: Rows of process_models().
MODEL = pa.schema([("loop_id", pa.int64()), ("segment", pa.int64()), ("points", pa.int64()), ("structure", pa.string()), *((c, pa.float64()) for c in ("gain", "tau", "theta", "fit")), ("feasible", pa.string()), ("grade", pa.string())])

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


def grouped(df: DataFrame, kernel, schema: str) -> DataFrame:
    """A kernel over each segment of a loop; results are rounded so that summation order does not show."""
    names = [c.split()[0] for c in schema.split(", ")]

    def run(key: tuple, window: pd.DataFrame) -> pd.DataFrame:
        out = kernel(key[0], window.sort_values(["ts", "event_id"])).set_axis(names, axis=1)
        return out.assign(segment=key[1])

    return segments.bounded(df, ["loop_id"], ["ts", "event_id"], SEGMENT).groupBy("loop_id", "segment").applyInPandas(run, f"{schema}, segment long")


def windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples in percent of range; each loop's events are one window."""
    return samples(spark, sf_dir).withColumn("pv", normalise("pv", 0, 500)).withColumn("sp", F.lit(10.0)).withColumn("mode", F.col("mode").cast("double"))


@query()
def diagnosis_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = segments.bounded(windows(spark, sf_dir), ["loop_id"], ["ts", "event_id"], SEGMENT)
    out = diagnosis.run_operators(df, ["loop_id", "segment"], ["ts", "event_id"])
    return out.withColumns({c: F.round(c, 6) for c in ("confidence", "value")})


@query()
def diagnosis_causes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By loop and segment of at most SEGMENT samples. A loop whose operators send only nulls of the output is not linked."""
    keys = ["loop_id", "segment"]
    df = segments.bounded(windows(spark, sf_dir), ["loop_id"], ["ts", "event_id"], SEGMENT)
    checked = outliers.detect(df, "pv", keys, ["ts", "event_id"], 0, 100, "FC", "quality")
    gate = diagnosis.gate(checked, keys, diagnosis.expected_points("ts", 43_200), 20)
    auto = df.groupBy(*keys).agg(F.avg((F.col("mode") > 0).cast("double")).alias("auto_rate"), (F.count("op") > 0).alias("linked"))
    families = diagnosis.fuse_families(diagnosis.run_operators(df, keys, ["ts", "event_id"]), keys)
    out = diagnosis.classify(families, gate.join(auto, keys), keys)
    return out.withColumns({"severity": diagnosis.severity(F.lit(50.0), F.col("confidence"), F.col("primary")), "confidence": F.round("confidence", 6), "secondary": F.array_join("secondary", ","), "pending": F.array_join("pending", ",")})


_FUSED = "with c as (select l_suppkey as loop_id, l_partkey % 6 as family, l_discount * 5 + 0.3 as c from lineitem) select loop_id, family, count(*)::int as hits, round(case when count(*) = 1 then max(c) else 1 / (1 + exp(-sum(ln(c) - ln(1 - c)))) end, 6) as confidence from c group by 1, 2"


@query(_FUSED)
def evidence_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line is evidence for a loop and family, equal ones of different lines too."""
    return fused_evidence(table(spark, sf_dir, "lineitem"))


def fused_evidence(lines: DataFrame) -> DataFrame:
    c = F.col("l_discount") * 5 + 0.3
    out = lines.groupBy(F.col("l_suppkey").alias("loop_id"), (F.col("l_partkey") % 6).alias("family")).agg(F.count(c).alias("n"), diagnosis.fusion(c).alias("confidence"))
    return out.select("loop_id", "family", F.col("n").cast("int").alias("hits"), F.round("confidence", 6).alias("confidence"))


@query()
def noise_and_oscillation(spark: SparkSession, sf_dir: str) -> DataFrame:
    def kernel(loop, w):
        pv = w["pv"].to_numpy(float)
        found, frequency, amplitude, index = kernels.spectrum_oscillation(pv)
        share = kernels.noise_share(pv, 1.0, 0.2)
        return pd.DataFrame([(loop, round(share or 0.0, 6), found, round(frequency, 6), round(amplitude, 4), round(index, 6))])

    return grouped(windows(spark, sf_dir), kernel, "loop_id long, noise double, oscillating boolean, frequency double, amplitude double, index double")


_SEGMENTS = f"{SAMPLES_SQL}, n as (select loop_id, ts, event_id, pv / 500 * 100 as pv, row_number() over (partition by loop_id order by ts, event_id) as i, count(*) over (partition by loop_id) as c from s), g as (select loop_id, (i - 1) * ((c + {SEGMENT - 1}) // {SEGMENT}) // c as segment, ts, event_id, pv from n)"
_LAGS = range(1, 11)
_SETTLING_SQL = f"""with recursive {_SEGMENTS}, y as (select loop_id, segment, ts, event_id, pv - avg(pv) over (partition by loop_id, segment) as y from g where pv is not null),
 l as (select loop_id, segment, y, {', '.join(f'lag(y, {k}) over w as y{k}' for k in _LAGS)} from y window w as (partition by loop_id, segment order by ts, event_id)),
 m as (select loop_id, segment, count(*) as n, [sum(y * y) / count(*), {', '.join(f'coalesce(sum(y * y{k}), 0) / count(*)' for k in _LAGS)}] as r from l group by 1, 2),
 c as (select *, case when r[1] * r[1] - r[2] * r[2] > 1e-12 * r[1] * r[1] then r[2] * (r[3] - r[1]) / (r[1] * r[1] - r[2] * r[2]) else -r[2] / nullif(r[1], 0) end as a1, case when r[1] * r[1] - r[2] * r[2] > 1e-12 * r[1] * r[1] then (r[2] * r[2] - r[1] * r[3]) / (r[1] * r[1] - r[2] * r[2]) else 0 end as a2 from m),
 e(loop_id, segment, a1, a2, k, g, h, low, hit, total, moment) as (select loop_id, segment, a1, a2, 0, 1.0::double, 0.0::double, 0, -1, 1.0::double, 0.0::double from c where n >= 30 and sqrt(r[1]) >= 1e-9 union all
  select loop_id, segment, a1, a2, k + 1, -a1 * g - a2 * h, g, case when abs(-a1 * g - a2 * h) < 0.05 then low + 1 else 0 end, case when hit < 0 and abs(-a1 * g - a2 * h) < 0.05 and low + 1 >= 10 then k + 1 - 9 else hit end,
   total + case when k + 1 < 500 then abs(-a1 * g - a2 * h) else 0 end, moment + case when k + 1 < 500 then (k + 1) * abs(-a1 * g - a2 * h) else 0 end from e where k < 999),
 v(loop_id, segment, r, a, v, k) as (select loop_id, segment, r, [1.0::double], r[1], 1 from c where n >= 50 union all
  select loop_id, segment, r, list_transform(range(1, k + 2), lambda i: (a || [0.0::double])[i] + turn * (a || [0.0::double])[k + 2 - i]), v * (1 - turn * turn), k + 1 from (select *, -list_sum(list_transform(range(1, k + 1), lambda i: a[i] * r[k - i + 2])) / nullif(v, 0) as turn from v where k <= 10))
 select c.loop_id, c.segment, c.n as points, case when c.n < 30 then 'IDENTIFICATION_FAILED' when sqrt(c.r[1]) < 1e-9 then 'ALREADY_STABLE' when e.hit > 0 then 'SETTLED' else 'NEVER_SETTLES' end as outcome, case when c.n < 30 then null when sqrt(c.r[1]) < 1e-9 then 0 when e.hit > 0 then e.hit else 1000 end::double as settling,
  round(e.moment / e.total, 4) as tau, round(case when v.v > 0 then c.r[1] / v.v end, 4) as harris from c left join (from e where k = 999) e on e.loop_id = c.loop_id and e.segment = c.segment left join (from v where k = 11) v on v.loop_id = c.loop_id and v.segment = c.segment"""


@query(_SETTLING_SQL)
def settling_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Settling time, time constant and Harris index of the error from its moments; 30 samples are enough here."""
    keys, by, one = ["loop_id", "segment"], ["ts", "event_id"], F.lit(1.0)
    df = segments.bounded(windows(spark, sf_dir), ["loop_id"], by, SEGMENT).withColumn("e", F.col("pv") - F.col("sp"))
    df = moments.lagged(df, "e", keys, by, 10).groupBy(*keys).agg(*(c.alias(n) for n, c in moments.sums("e", 10).items()))
    df = moments.time_constant(moments.settling(df.where("e_n > 0"), "e", one, 30), "e", one, 30)
    harris = F.when(F.col("e_n") >= 50, moments.harris("e", 10))
    return df.select(*keys, F.col("e_n").alias("points"), F.col("settling_outcome").alias("outcome"), F.col("settling_time").alias("settling"), F.round("time_constant", 4).alias("tau"), F.round(harris, 4).alias("harris"))


@query()
def stiction_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    def kernel(loop, w):
        op, pv = w["op"].to_numpy(float), w["pv"].to_numpy(float)
        outcome, index = kernels.stiction(op, pv)
        return pd.DataFrame([(loop, outcome, None if index is None else round(index, 4), round(kernels.bicoherence(op), 6), round(kernels.gaussianity(np.diff(op)), 6))])

    return grouped(windows(spark, sf_dir), kernel, "loop_id long, outcome string, stiction double, bicoherence double, gaussianity double")


_SHIFTS_SQL = f"""with recursive {_SEGMENTS}, z as (select loop_id, segment, row_number() over (partition by loop_id, segment order by ts, event_id) - 1 as i, pv - avg(pv) over q as x, stddev_pop(pv) over q as sd, count(*) over q as n, epoch(max(ts) over q) - epoch(min(ts) over q) as span from g where pv is not null window q as (partition by loop_id, segment)),
 c(loop_id, segment, i, up, down, side) as (select loop_id, segment, i, 0.0::double, 0.0::double, 0 from z where i = 0 and n >= 16 and sd >= 1e-9 union all
  select loop_id, segment, i, case when u > 2 * sd or -d > 2 * sd then 0 else u end, case when u > 2 * sd or -d > 2 * sd then 0 else d end, case when u > 2 * sd then 1 when -d > 2 * sd then -1 else 0 end from (select z.loop_id, z.segment, z.i, z.sd, greatest(0, c.up + z.x - 0.5 * z.sd) as u, least(0, c.down + z.x + 0.5 * z.sd) as d from c join z on z.loop_id = c.loop_id and z.segment = c.segment and z.i = c.i + 1)),
 f as (select c.loop_id, c.segment, c.i, c.side, any_value(z.sd) as sd, avg(z.x) filter (where z.i >= c.i) - avg(z.x) filter (where z.i < c.i) as change, count(*) filter (where z.i >= c.i) as after, count(*) filter (where z.i < c.i) as before from c join z on z.loop_id = c.loop_id and z.segment = c.segment and z.i between c.i - 10 and c.i + 9 where c.side <> 0 group by 1, 2, 3, 4),
 t as (select loop_id, segment, count(*) as shifts, string_agg(i::varchar, ',' order by i) as places, avg(abs(change)) as magnitude from f where before >= 5 and after >= 5 and change * side > sd group by 1, 2),
 w as (select distinct loop_id, segment, span, n >= 16 and sd >= 1e-9 as fit from z), o as (select w.*, coalesce(shifts, 0) as shifts, coalesce(places, '') as places, coalesce(magnitude, 0) as magnitude, coalesce(shifts, 0) / case when span > 0 then span / 3600 else 1 end as rate from w left join t on t.loop_id = w.loop_id and t.segment = w.segment)
 select loop_id, segment, shifts::int as shifts, places, round(magnitude, 6) as magnitude, round(case when fit then rate else 0 end, 9) as frequency, fit and rate >= 0.002 as detected from o"""


@query(_SHIFTS_SQL)
def bias_shifts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Confirmed level shifts of the error by a two-sided cumulative sum; a lower limit and a shorter window, as loops have few samples here."""
    df = segments.bounded(windows(spark, sf_dir), ["loop_id"], ["ts", "event_id"], SEGMENT).withColumn("e", F.col("pv") - F.col("sp")).where("e is not null")
    out = folds.bias_shifts(df, "e", ["loop_id", "segment"], ["ts", "event_id"], window=10, h=2.0, frequent=0.002)
    return out.select("loop_id", "segment", F.col("shift_count").alias("shifts"), F.array_join(F.transform("places", lambda p: p.cast("string")), ",").alias("places"), F.round("shift_magnitude", 6).alias("magnitude"), F.round("shift_frequency", 9).alias("frequency"), "detected")


def _triangles_sql(series: list[str]) -> str:
    scale = lambda v: f"case when list_max({v}) > list_min({v}) then list_max({v}) - list_min({v}) else 1 end" if len(series) > 1 else "1.0"
    names = [f"y{i}" for i in range(len(series))]
    area = [f"abs((x[last + 1] - mx) * ({y}[j + 1] - {y}[last + 1]) - (x[last + 1] - x[j + 1]) * (m{y} - {y}[last + 1])) * 0.5 / u{y}" for y in names]
    return f"""with recursive {SAMPLES_SQL}, w as (select *, row_number() over (partition by loop_id order by ts, event_id) as i, count(*) over (partition by loop_id) as c from s), n as (select loop_id, (i - 1) * ((c + {WAVEFORM - 1}) // {WAVEFORM}) // c as segment, list(event_id order by ts, event_id) as ids, list(epoch(ts) order by ts, event_id) as x, {', '.join(f'list(coalesce({c}, 0) order by ts, event_id) as {y}' for c, y in zip(series, names, strict=True))}, count(*) as n from w group by 1, 2),
 b as (select *, (n - 2) / 18.0 as size, {', '.join(f'{scale(y)} as u{y}' for y in names)} from n),
 t as (select 0 as i, loop_id, segment, 0::bigint as last from b where n > 20 union all
  select i + 1, loop_id, segment, case when stop > begin then begin + list_position(areas, list_max(areas)) - 1 else begin end from (select *, list_transform(range(begin, stop), lambda j: {'greatest(' + ', '.join(area) + ')' if len(area) > 1 else area[0]}) as areas from (select *, coalesce(list_avg(x[stop + 1:after]), 0) as mx, {', '.join(f'coalesce(list_avg({y}[stop + 1:after]), 0) as m{y}' for y in names)}
   from (select b.*, t.i, t.last, floor((t.i + 1) * size)::bigint + 1 as begin, least(floor((t.i + 2) * size)::bigint + 1, n) as stop, least(floor((t.i + 3) * size)::bigint + 1, n) as after from t join b on b.loop_id = t.loop_id and b.segment = t.segment where t.i < 18)))),
 k as (select loop_id, segment, i as place, last from t union all select loop_id, segment, 19, n - 1 from b where n > 20 union all select loop_id, segment, j, j from (select loop_id, segment, unnest(range(n)) as j from b where n <= 20))
 select k.loop_id, k.segment, k.place::int as place, ids[k.last + 1] as event_id from k join b on b.loop_id = k.loop_id and b.segment = k.segment"""


@query(_triangles_sql(["pv"]))
def downsampled_waveform(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Twenty samples of each loop's waveform, by largest triangles."""
    df = segments.bounded(samples(spark, sf_dir), ["loop_id"], ["ts", "event_id"], WAVEFORM)
    return folds.largest_triangles(df, "pv", ["loop_id", "segment"], ["ts", "event_id"], [], threshold=20, target=20).select("loop_id", "segment", "place", "event_id")


@query(_triangles_sql(["pv", "op"]))
def downsampled_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Twenty samples for process value and output on one axis, each scaled to its spread."""
    df = segments.bounded(samples(spark, sf_dir), ["loop_id"], ["ts", "event_id"], WAVEFORM)
    return folds.largest_triangles(df, ["pv", "op"], ["loop_id", "segment"], ["ts", "event_id"], [], threshold=20, target=20).select("loop_id", "segment", "place", "event_id")


_GRID_SQL = f"""with {SAMPLES_SQL}, t as (select loop_id, event_id, epoch(ts) as t, ts, pv / 500 * 100 as pv, mode::double as mode from s),
 n as (select *, lead(t) over w as u, lead(pv) over w as q from t window w as (partition by loop_id order by ts, event_id)),
 g as (select loop_id, pv, mode, t, u, q, unnest(generate_series(ceil(t / 86400)::bigint, case when u is null then floor(t / 86400)::bigint else ceil(u / 86400)::bigint - 1 end)) as k from n where u is null or u > t)
 select loop_id, k * 86400 as at, round(pv + case when u > t then (q - pv) * (k * 86400 - t) / (u - t) else 0 end, 6) as pv, mode from g"""


@query(_GRID_SQL)
def uniform_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples on a grid of days: values between the samples around it, modes as they hold. Each sample makes the grid's points up to the next."""
    w = Window.partitionBy("loop_id").orderBy("ts", "event_id")
    df = windows(spark, sf_dir).withColumn("t", segments.seconds("ts"))
    df = df.select("loop_id", "pv", "mode", "t", F.lead("t").over(w).alias("u"), F.lead("pv").over(w).alias("q")).where("u is null or u > t")
    last = F.when(F.col("u").isNull(), F.floor(F.col("t") / 86_400)).otherwise(F.ceil(F.col("u") / 86_400) - 1)
    first = F.ceil(F.col("t") / 86_400)
    points = F.when(first <= last, F.sequence(first, last)).otherwise(F.array().cast("array<bigint>"))
    made = df.select("*", F.explode(points).alias("k")).withColumn("at", F.col("k") * 86_400)
    pv = F.col("pv") + F.coalesce((F.col("q") - F.col("pv")) * (F.col("at") - F.col("t")) / (F.col("u") - F.col("t")), F.lit(0.0))
    return made.select("loop_id", "at", F.round(pv, 6).alias("pv"), "mode")


@query()
def process_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The process of each loop from its own pv and op; tau and theta in samples. Long histories are cut into segments that use every sample."""

    def run(key: tuple[pa.Scalar, ...], w: pa.Table) -> pa.Table:
        w = w.sort_by([("ts", "ascending"), ("event_id", "ascending")])
        y, u, r = (np.asarray(w[c].to_numpy(), float) for c in ("pv", "op", "sp"))
        found = identify.from_history(y, u, r=r)
        numbers = {name: None if found[x] is None else round(float(found[x]), 4) for name, x in (("gain", "K"), ("tau", "tau"), ("theta", "theta"), ("fit", "r2"))}
        row = {"loop_id": key[0].as_py(), "segment": key[1].as_py(), "points": len(y), "structure": found["structure"]} | numbers | {"feasible": found["feasible"], "grade": found["grade"]}
        return pa.Table.from_pylist([row], MODEL)

    df = segments.bounded(windows(spark, sf_dir).select("loop_id", "ts", "event_id", "pv", "sp", "op"), ["loop_id"], ["ts", "event_id"], SEGMENT)
    return df.groupBy("loop_id", "segment").applyInArrow(run, "loop_id long, segment long, points long, structure string, gain double, tau double, theta double, fit double, feasible string, grade string")


_MODELS = f"with {LEDGER_SQL}, m as (select loop_id, (0.5 + level * 0.5)::double as k, (10.0 + loop_id % 50)::double as tau, (1.0 + loop_id % 9)::double as theta from l) "


def models(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("loop_id")
    return ledger(spark, sf_dir).select("loop_id", (F.lit(0.5) + F.col("level") * 0.5).alias("k"), (10.0 + i % 50).alias("tau"), (1.0 + i % 9).alias("theta"))


@query(
    _MODELS
    + """select loop_id, round((tau + theta / 2) / (k * (theta + theta / 2)), 6) as imc_kp, round(tau + theta / 2, 4) as imc_ti, round(tau * theta / (2 * (tau + theta / 2)), 4) as imc_td,
 round(tau / (k * (tau + theta)), 6) as lambda_kp, round(1.2 * tau / (k * theta), 6) as zn_kp, round(2 * theta, 4) as zn_ti, round((1.35 + theta / tau / 3) / (k * theta / tau), 6) as cc_kp,
 round(theta * (32 + 6 * theta / tau) / (13 + 8 * theta / tau), 4) as cc_ti, round(4 * theta / (11 + 2 * theta / tau), 4) as cc_td, round(tau / (k * theta * 2), 6) as simc_kp, round(least(tau, 8 * theta), 4) as simc_ti from m"""
)
def tuning_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = models(spark, sf_dir)
    args = F.col("k"), F.col("tau"), F.col("theta")
    made = {n: f(*args) for n, f in (("imc", tuning.imc), ("lambda", tuning.lambda_rule), ("zn", tuning.ziegler_nichols), ("cc", tuning.cohen_coon), ("simc", tuning.simc))}
    wanted = ("imc_kp", "imc_ti", "imc_td", "lambda_kp", "zn_kp", "zn_ti", "cc_kp", "cc_ti", "cc_td", "simc_kp", "simc_ti")
    return m.select("loop_id", *(made[w.split("_")[0]][w.split("_")[1]].alias(w) for w in wanted))


@query(_MODELS + "select loop_id, case when r >= 4 then 'HIGH' when r >= 2 then 'MEDIUM' else 'LOW' end as risk from (select loop_id, case when abs(tau / (k * (tau + theta)) - 0.5) / 0.5 > 0.5 then 3 when abs(tau / (k * (tau + theta)) - 0.5) / 0.5 > 0.2 then 2 else 0 end + case when loop_id % 5 = 3 then 4 when loop_id % 5 = 2 then 1 else 0 end + case when theta / tau > 0.5 then 2 else 0 end + case when abs(k) > 10 or abs(k) < 0.1 then 1 else 0 end as r from m)")
def tuning_risk(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = models(spark, sf_dir)
    new = F.col("tau") / (F.col("k") * (F.col("tau") + F.col("theta")))
    grade = F.element_at(F.array(*map(F.lit, "ABCDE")), (F.col("loop_id") % 5).cast("int") + 1)
    grade = F.when(grade == "E", "B").otherwise(grade)
    return m.select("loop_id", tuning.risk(F.lit(0.5), new, grade, F.col("theta"), F.col("tau"), F.col("k")).alias("risk"))


@query()
def closed_loop_simulation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A step of every loop's set point; loops are dealt to tasks, since a small table of loops is much work in few files."""

    def run(parts):
        for part in parts:
            for at in range(0, len(part), SIMULATED):
                some = part.iloc[at : at + SIMULATED]
                k, tau, theta = (some[c].to_numpy(float) for c in ("k", "tau", "theta"))
                m = tuning.responses_metrics(*tuning.closed_loops(k, tau, theta, tau / (k * (tau + theta)), tau, np.zeros(len(k)), 300))
                yield pd.DataFrame({"loop_id": some["loop_id"]} | {x: [round(v, 4) for v in m[x].tolist()] for x in ("rise", "overshoot", "settling", "itae")})

    return models(spark, sf_dir).repartition("loop_id").mapInPandas(run, "loop_id long, rise double, overshoot double, settling double, itae double")


RULE = json.dumps({"condition": {"type": "AND", "conditions": [{"type": "threshold", "field": "score", "operator": "<", "value": 40}, {"type": "OR", "conditions": [{"type": "confidence", "worseThan": "B"}, {"type": "threshold", "field": "auto_rate", "operator": "<=", "value": 10}]}, {"type": "NOT", "conditions": [{"type": "threshold", "field": "status", "operator": "IN", "value": ["INCONCLUSIVE"]}]}]}, "durationCount": 2})
_HITS = f"with {SNAPSHOTS_SQL}, h as (select *, coalesce(score < 40 and (confidence in ('C', 'D', 'E') or auto_rate <= 10) and status <> 'INCONCLUSIVE', false) as hit from k) "


@query(_HITS + "select snapshot_id, hit, extract(hour from ts + interval 8 hours) >= 8 and extract(hour from ts + interval 8 hours) < 17 as in_hours from h")
def rule_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return snapshots(spark, sf_dir).select("snapshot_id", rules.compile_rule(RULE).alias("hit"), rules.in_hours(F.col("ts"), 8, 17).alias("in_hours"))


@query(_HITS + ", m as (select *, sum((not hit)::int) over (partition by loop_id order by ts, snapshot_id rows unbounded preceding) as miss from h), r as (select *, sum(hit::int) over (partition by loop_id, miss order by ts, snapshot_id rows unbounded preceding) as breaches from m) select snapshot_id, breaches::bigint as breaches, hit and breaches = 2 as fired from r where hit")
def consecutive_breaches(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = snapshots(spark, sf_dir).withColumn("hit", rules.compile_rule(RULE))
    return rules.consecutive(df, "hit", ["loop_id"], ["ts", "snapshot_id"], 2).where("hit").select("snapshot_id", "breaches", "fired")


@query(_HITS + ", c as (select loop_id, count(*) as n, min(confidence) as best from h where hit group by loop_id) select loop_id, n, case when n >= 3 then 'ERROR' else 'WARN' end as severity, case when best in ('D', 'E') then 'INFO' else 'WARN' end as gated from c")
def alert_severity(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = snapshots(spark, sf_dir).where(rules.compile_rule(RULE)).groupBy("loop_id").agg(F.count(F.lit(1)).alias("n"), F.min("confidence").alias("best"))
    return hits.select("loop_id", "n", escalated(F.lit("WARN"), "n").alias("severity"), rules.gated(F.lit("WARN"), F.col("best"), F.lit("DOWNGRADE")).alias("gated"))


@query(f"with {LEDGER_SQL}, r as (select * from (values ('r1', 'LOOP', '7'), ('r2', 'PLANT', '3'), ('r3', 'CONTROL_TYPE', 'LEVEL')) t(rule_id, scope, target)) select distinct rule_id, loop_id from r join l on case scope when 'LOOP' then loop_id::varchar = target when 'PLANT' then unit_id::varchar = target else loop_type = target end")
def rule_subscriptions(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = spark.createDataFrame([("r1", "LOOP", "7"), ("r2", "PLANT", "3"), ("r3", "CONTROL_TYPE", "LEVEL")], "rule_id string, scope string, target string")
    return rules.subscriptions(made, ledger(spark, sf_dir))


@query(f"with {WORK_SQL} select order_id, line, loop_id, l_partkey, state, action, state || '>' || case action when 'A' then 'ACKNOWLEDGED' when 'N' then 'CANCELLED' else 'CLOSED' end in ('OPEN>ACKNOWLEDGED', 'OPEN>CANCELLED', 'ACKNOWLEDGED>CANCELLED', 'IN_PROGRESS>CANCELLED', 'VERIFYING>CLOSED') as allowed from w".replace("state || '>' || case", "(state || '>' || case").replace("else 'CLOSED' end in", "else 'CLOSED' end) in"))
def state_machine(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = orders_of_work(spark, sf_dir).withColumn("to", F.when(F.col("action") == "A", "ACKNOWLEDGED").when(F.col("action") == "N", "CANCELLED").otherwise("CLOSED"))
    return df.select("order_id", "line", "loop_id", "l_partkey", "state", "action", rules.allowed_moves(df, "state", "to").alias("allowed"))


@query(f"with {SAMPLES_SQL} select loop_id, time_bucket(interval 1 day, ts)::timestamp as ts, round(avg(pv), 6) as pv_avg, min(pv) as pv_min, max(pv) as pv_max, count(pv) as pv_count from s group by 1, 2")
def downsample_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The batch twin of the streaming down-sample."""
    out = stream.downsample(samples(spark, sf_dir).withColumn("ts", F.col("ts").cast("timestamp")), ["pv"], "1 day")
    return out.withColumns({"ts": F.col("ts").cast("timestamp_ntz"), "pv_avg": F.round("pv_avg", 6)})


@query(f"with {SAMPLES_SQL}, m as (select loop_id, time_bucket(interval 1 minute, ts) as ts, avg(pv) as a, min(pv) as b, max(pv) as c, count(pv) as n from s group by 1, 2) select loop_id, date_trunc('hour', ts)::timestamp as ts, round(avg(a), 6) as pv_avg, min(b) as pv_min, max(c) as pv_max, sum(n)::bigint as pv_count from m group by 1, 2")
def downsample_hours(spark: SparkSession, sf_dir: str) -> DataFrame:
    minutes = stream.downsample(samples(spark, sf_dir).withColumn("ts", F.col("ts").cast("timestamp")), ["pv"])
    out = stream.hours_of_minutes(minutes, ["pv"])
    return out.withColumns({"ts": F.col("ts").cast("timestamp_ntz"), "pv_avg": F.round("pv_avg", 6)})


@query(f"with {SAMPLES_SQL}, r as (select *, row_number() over (partition by loop_id order by ts desc, event_id desc) as rn from s) select loop_id, event_id, case when quality is null or quality = 192 then 'Good' else 'Bad' end as quality_status from r where rn <= 3")
def bounded_buffer(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("loop_id").orderBy(F.desc("ts"), F.desc("event_id"))
    return samples(spark, sf_dir).withColumn("rn", F.row_number().over(w)).where("rn <= 3").select("loop_id", "event_id", quality("quality").alias("quality_status"))
