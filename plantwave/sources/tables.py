"""Scans and sinks of samples: wide range scans, imports of long and wide CSV, upserts, payloads, a remote history source."""

from __future__ import annotations

import json
import time
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition, SimpleDataSourceStreamReader

from ..functions.signals import present

SIGNALS = ("pv", "sp", "op", "mode", "pid_p", "pid_i", "pid_d", "pv_quality")
SAMPLE = T.StructType(
    [T.StructField("loop_id", T.StringType()), T.StructField("ts", T.TimestampType())] + [T.StructField(s, T.IntegerType() if s in ("mode", "pv_quality") else T.DoubleType()) for s in SIGNALS]
)


def scan(spark: SparkSession, path: str, start: str, end: str, loops: list[str] | None = None, closed: bool = True, columns: list[str] | None = None) -> DataFrame:
    """Samples of a time range, both ends in it unless half open. Partitions by day are pruned, columns and filters reach the files."""
    df = spark.read.parquet(path)
    ts = F.col("ts")
    df = df.where((ts >= F.lit(start).cast("timestamp")) & ((ts <= F.lit(end).cast("timestamp")) if closed else (ts < F.lit(end).cast("timestamp"))))
    if "day" in df.columns:
        df = df.where(F.col("day").between(F.to_date(F.lit(start)), F.to_date(F.lit(end))))
    if loops:
        df = df.where(F.col("loop_id").isin(loops))
    return df.select("loop_id", "ts", *columns) if columns else df


def write_samples(df: DataFrame, path: str, mode: str = "append") -> None:
    """One folder a day; within a task rows lie by loop, so row groups can be skipped. The last write of a (loop, ts) wins within a batch."""
    from ..operators.segments import last_write

    order = [F.desc("version")] if "version" in df.columns else [F.col("ts")]
    df = last_write(df, ["loop_id", "ts"], order).withColumn("day", F.to_date("ts"))
    df.repartition("day", "loop_id").sortWithinPartitions("day", "loop_id", "ts").write.mode(mode).option("partitionOverwriteMode", "dynamic").partitionBy("day").parquet(f"{path.rstrip('/')}/by_day")


def merge_samples(df: DataFrame, path: str, version: str = "version") -> None:
    """Adds samples so that the last write of a (loop, ts) wins over stored ones too. Only the days of the batch are rewritten.

    The merged days are written aside before they replace the stored ones, as a job must not overwrite what it reads."""
    from ..operators.segments import upsert

    spark, target = df.sparkSession, f"{path.rstrip('/')}/by_day"
    fresh = df.withColumn("day", F.to_date("ts"))
    days = [r["day"] for r in fresh.select("day").distinct().collect()]  # one row a day
    stored = spark.read.schema(fresh.schema).parquet(target).where(F.col("day").isin(days)) if _exists(spark, target) else fresh.limit(0)
    _replace_days(upsert(stored.select(fresh.columns), fresh, ["loop_id", "ts"], version), path)


def replace_range(df: DataFrame, path: str, loops: list[str], start: str, end: str) -> None:
    """Replaces the loops' stored samples from start to end, both ends in it, by df; other loops' rows stay."""
    spark, target = df.sparkSession, f"{path.rstrip('/')}/by_day"
    fresh = df.withColumn("day", F.to_date("ts"))
    if not _exists(spark, target):
        return _replace_days(fresh, path)
    touched = F.col("day").between(F.to_date(F.lit(start)), F.to_date(F.lit(end)))
    gone = F.col("loop_id").isin(loops) & F.col("ts").between(F.lit(start).cast("timestamp"), F.lit(end).cast("timestamp"))
    stored = spark.read.schema(fresh.schema).parquet(target).where(touched)
    return _replace_days(stored.where(~gone).select(fresh.columns).unionByName(fresh), path, stored.select("day").distinct())


def _exists(spark: SparkSession, path: str) -> bool:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(target)


def _replace_days(df: DataFrame, path: str, days: DataFrame | None = None) -> None:
    """Days of `days` for which nothing is left are removed."""
    spark, base = df.sparkSession, path.rstrip("/")
    aside, target = f"{base}/merging", f"{base}/by_day"
    df.write.mode("overwrite").parquet(aside)
    merged = spark.read.schema(df.schema).parquet(aside)
    empty = [] if days is None else [r["day"] for r in days.join(merged.select("day").distinct(), "day", "left_anti").collect()]
    merged.repartition("day", "loop_id").sortWithinPartitions("day", "loop_id", "ts").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day").parquet(target)
    for gone in (aside, *(f"{target}/day={day}" for day in empty)):
        spark._jvm.org.apache.hadoop.fs.Path(gone).getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(spark._jvm.org.apache.hadoop.fs.Path(gone), True)


def hot_or_cold(hot: DataFrame, cold: DataFrame, keys: list[str], start: Column, end: Column, slack: float = 60.0) -> DataFrame:
    """Samples of a window: a loop's cached rows where they cover it within `slack` seconds at both ends, else its stored ones."""
    inside = F.col("ts").between(start, end)
    micros = lambda c: F.unix_micros(c.cast("timestamp"))
    spans = hot.groupBy(*keys).agg(F.min("ts").alias("first"), F.max("ts").alias("last"))
    covered = spans.where((micros(F.col("first")) <= micros(start) + int(slack * 1e6)) & (micros(F.col("last")) >= micros(end) - int(slack * 1e6))).select(*keys)
    return hot.where(inside).join(covered, keys, "left_semi").unionByName(cold.where(inside).join(covered, keys, "left_anti"), allowMissingColumns=True)


def export_csv(df: DataFrame, path: str, columns: dict[str, str]) -> None:
    """Rows with the sheet's headings, as CSV files that spreadsheets open; columns: name → heading."""
    df.select(*(F.col(c).alias(h) for c, h in columns.items())).write.mode("overwrite").option("header", True).option("emptyValue", "").csv(path)


def tag_column(tag: Column | str) -> tuple[Column, Column]:
    """(loop, signal) of a tag by what follows its last separator: PV, SP, OP or CV or MV, MODE, P, I, D."""
    tag = F.col(tag) if isinstance(tag, str) else tag
    suffix = F.lower(F.regexp_extract(tag, r"(?i)[._](?:pid_)?([^._]+)$", 1))
    signal = F.when(suffix.isin("cv", "mv", "out"), "op").when(suffix.isin("p", "i", "d"), F.concat(F.lit("pid_"), suffix)).when(suffix.isin("pv", "sp", "op", "mode"), suffix)
    return F.regexp_replace(tag, r"(?i)[._](?:pid_)?[^._]+$", ""), signal


def long_to_wide(df: DataFrame, tag: str = "tag", ts: str = "ts", value: str = "value") -> DataFrame:
    """Single-tag rows as wide samples; tags without a known suffix are left out."""
    loop, signal = tag_column(tag)
    named = df.select(loop.alias("loop_id"), F.col(ts).cast("timestamp").alias("ts"), signal.alias("signal"), F.col(value).alias("value")).where("signal is not null and ts is not null")
    wide = named.groupBy("loop_id", "ts").pivot("signal", [s for s in SIGNALS if s != "pv_quality"]).agg(F.first("value", ignorenulls=True))
    return wide.withColumn("mode", F.col("mode").cast("int"))


def import_csv(spark: SparkSession, path: str, layout: str = "long") -> DataFrame:
    """CSV with header: long (tag, ts, value), or wide (ts and a column a tag). Values that are no numbers are null."""
    raw = spark.read.option("header", True).csv(path)
    if layout == "wide":
        raw = raw.unpivot(["ts"], [F.col(f"`{c}`") for c in raw.columns if c != "ts"], "tag", "value")
    return long_to_wide(raw.withColumns({"value": present(F.expr("try_cast(value as double)")), "ts": F.expr("try_cast(ts as timestamp)")}))


def validated(df: DataFrame, required: list[str], checks: dict[str, Column]) -> DataFrame:
    """Adds errors: the names of required columns that are empty and of checks that fail, for row-wise imports."""
    empty = [F.when(F.trim(F.coalesce(F.col(c).cast("string"), F.lit(""))) == "", F.lit(f"{c}: empty")) for c in required]
    wrong = [F.when(~F.coalesce(ok, F.lit(False)), F.lit(f"{name}: wrong")) for name, ok in checks.items()]
    return df.withColumn("errors", F.array_compact(F.array(*empty, *wrong)))


def payload_rows(df: DataFrame) -> DataFrame:
    """Rows (loop_id, ts[], pv[], sp[], op[], mode[], quality[]) of a history payload as samples; positions belong together."""
    zipped = F.arrays_zip("ts", "pv", "sp", "op", "mode", "quality")
    rows = df.select("loop_id", F.inline(zipped)).where("ts is not null")
    return rows.withColumns({s: present(s) for s in ("pv", "sp", "op")} | {"mode": F.col("mode").cast("int"), "pv_quality": F.when(F.col("quality").isin(0, 1), F.col("quality").cast("int"))}).drop("quality")


def chunk_hours(total: float, target: int = 12, low: int = 1, high: int = 24) -> int:
    """Hours of a chunk of a long import: about `target` chunks, within bounds."""
    return int(min(high, max(low, -(-total // target))))


def keep_or_overwrite(old: DataFrame, new: DataFrame, overwrite: bool) -> DataFrame:
    """Import conflicts on (loop, ts): the new rows replace the old ones, or only fill gaps."""
    key = ["loop_id", "ts"]
    return old.join(new, key, "left_anti").unionByName(new, True) if overwrite else old.unionByName(new.join(old, key, "left_anti"), True)


class HistorySource(DataSource):
    """Remote history over HTTP: spark.read.format("loop_history").option("url", ...).option("loops", "a,b").

    One partition a loop and chunk, or `concurrency` partitions that fetch theirs one after another, which bounds the
    requests at one time. Within a partition, `failures` failed requests in a row open the circuit: nothing is asked for
    `open_seconds`, then one probe decides. A partition that fails is retried by Spark."""

    @classmethod
    def name(cls) -> str:
        return "loop_history"

    def schema(self) -> str:
        return "loop_id string, ts timestamp, pv double, sp double, op double, mode int, pv_quality int"

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return HistoryReader(self.options)


class Chunk(InputPartition):
    def __init__(self, parts: list[tuple[str, int]]) -> None:
        self.parts = parts


class Breaker:
    """Calls that stop for a while after failures in a row."""

    #: Statuses of an overloaded or absent server.
    STATUSES = frozenset({429, 500, 502, 503, 504})

    def __init__(self, failures: int, open_seconds: float, sleep=time.sleep) -> None:
        self.most, self.open_seconds, self.sleep = failures, open_seconds, sleep
        self.failed = 0

    def call(self, f: Callable[[], bytes]) -> bytes:
        """f's value; while the circuit is open it waits, then probes once and gives up if that fails too."""
        while True:
            probe = self.failed >= self.most
            if probe:
                self.sleep(self.open_seconds)
            try:
                out = f()
            except urllib.error.HTTPError as e:
                if e.code not in self.STATUSES:
                    raise
                error: Exception = e
            except OSError as e:
                error = e
            else:
                self.failed = 0
                return out
            self.failed += 1
            if probe:
                raise error


class HistoryReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.options = options

    def partitions(self) -> list[InputPartition]:
        every = [(loop, i) for loop in self.options["loops"].split(",") for i in range(int(self.options.get("chunks", "1")))]
        at_once = min(int(self.options.get("concurrency", len(every))), len(every))
        return [Chunk(every[i::at_once]) for i in range(at_once)]

    def read(self, partition: Chunk) -> Iterator[tuple]:
        from datetime import datetime

        breaker = Breaker(int(self.options.get("failures", "5")), float(self.options.get("open_seconds", "30")))
        for loop, part in partition.parts:
            for r in json.loads(breaker.call(lambda loop=loop, part=part: _get(self.options["url"].format(loop=loop, chunk=part)))):
                yield loop, datetime.fromisoformat(r["ts"]), r.get("pv"), r.get("sp"), r.get("op"), r.get("mode"), r.get("quality")


def _get(url: str) -> bytes:
    with urllib.request.urlopen(url, timeout=30) as f:
        return f.read()


class HubSource(DataSource):
    """Live tag values of a hub: spark.readStream.format("loop_hub").option("url", "http://.../{after}").

    A poll asks for the messages after an offset and gets [{offset, loop, role, ts, value, quality}, ...]. A poll that fails
    is tried again after growing pauses; the query then fails and goes on from its checkpoint when restarted."""

    @classmethod
    def name(cls) -> str:
        return "loop_hub"

    def schema(self) -> str:
        return "loop_id string, role string, ts timestamp, value string, quality string, flush long"

    def simpleStreamReader(self, schema: T.StructType) -> SimpleDataSourceStreamReader:  # noqa: N802
        return HubReader(self.options)


class HubReader(SimpleDataSourceStreamReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.options = options

    def initialOffset(self) -> dict:  # noqa: N802
        return {"after": int(self.options.get("after", "0"))}

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        rows = self._poll(start["after"])
        return iter([self._row(r) for r in rows]), {"after": max([start["after"], *(int(r["offset"]) for r in rows)])}

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:  # noqa: N802
        return iter([self._row(r) for r in self._poll(start["after"]) if int(r["offset"]) <= end["after"]])

    def _row(self, r: dict) -> tuple:
        from datetime import datetime

        return r["loop"], r["role"], datetime.fromisoformat(r["ts"]), r.get("value"), r.get("quality"), int(r.get("flush", r["offset"]))

    def _poll(self, after: int) -> list[dict]:
        for pause in (*(reconnect_delay(n, float(self.options.get("first_pause", "1"))) for n in range(int(self.options.get("retries", "4")))), None):
            try:
                return json.loads(_get(self.options["url"].format(after=after)))
            except OSError:
                if pause is None:
                    raise
                time.sleep(pause)
        return []


def reconnect_delay(attempt: int, first: float = 1.0, most: float = 60.0) -> float:
    """Pauses that double up to a minute."""
    return min(most, first * 2**attempt)
