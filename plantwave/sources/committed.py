"""Tables by day that change all at once or not at all: new day folders first, then one new manifest that names them.

A manifest is a small JSON file that says which folder holds which day of which table. Writers put their days into fresh
folders and then create the next manifest, which the file system lets one of them do; who comes second starts from the
new manifest and merges again if it touches the same days. So readers see whole commits, a crash leaves folders that
no manifest names, and two writers never overwrite each other. Rows never pass the driver, only names of days do."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Manifests that stay readable after newer ones.
KEPT = 5


class Conflict(RuntimeError):
    """Another writer kept committing first."""


class CommittedTables:
    """Tables under one path that share their manifests."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        self._jvm = spark._jvm
        self._fs = self._file(self.path).getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())

    def _file(self, path: str):
        return self._jvm.org.apache.hadoop.fs.Path(path)

    def versions(self) -> list[int]:
        """Numbers of the manifests, rising."""
        folder = self._file(f"{self.path}/manifests")
        names = [s.getPath().getName() for s in self._fs.listStatus(folder)] if self._fs.exists(folder) else []
        return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json") and not n.startswith((".", "_")))

    def manifest(self, version: int | None = None) -> tuple[int, dict[str, str]]:
        """(number, folder by table/day) of a version, the newest without one."""
        known = self.versions()
        at = version if version is not None else known[-1] if known else 0
        if not at:
            return 0, {}
        stream = self._fs.open(self._file(f"{self.path}/manifests/{at}.json"))
        try:
            text = self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        return at, json.loads(text)

    def read(self, table: str, start: str | None = None, end: str | None = None, version: int | None = None) -> DataFrame | None:
        """The rows of a table, of days from start to end only; None while it has no day."""
        return self._of(self.manifest(version)[1], table, lambda day: (start is None or day >= start) and (end is None or day <= end))

    def _of(self, entries: Mapping[str, str], table: str, wanted: Callable[[str], bool]) -> DataFrame | None:
        own = [folder for key, folder in sorted(entries.items()) if key.partition("/")[0] == table and wanted(key.partition("/")[2])]
        return self.spark.read.parquet(*(f"{self.path}/{folder}" for folder in own)) if own else None

    def days(self, table: str) -> list[str]:
        return sorted(key.partition("/")[2] for key in self.manifest()[1] if key.partition("/")[0] == table)

    def commit(self, days: list[str], build: Callable[[Callable[[str], DataFrame | None]], Mapping[str, DataFrame]], attempts: int = 5) -> int:
        """Replaces the days of the tables that `build` returns, by name, and gives back the manifest's number.

        `build` gets a function that reads the stored rows of these days; the rows it returns have a column `day` and lie
        in these days; a day without rows goes. It runs again if another writer changed one of these days meanwhile."""
        base, entries = self.manifest()
        made = self._write(days, build(lambda table: self._of(entries, table, days.__contains__)))
        for _ in range(attempts):
            fresh = {k: v for k, v in entries.items() if not (k.partition("/")[0] in made and k.partition("/")[2] in days)}
            for table, folders in made.items():
                fresh |= {f"{table}/{day}": folder for day, folder in folders.items()}
            if self._publish(base + 1, fresh):
                self._forget(base + 1)
                return base + 1
            base, newer = self.manifest()
            touched = {k for k in {*entries, *newer} if k.partition("/")[2] in days and entries.get(k) != newer.get(k)}
            entries = newer
            if touched:
                made = self._write(days, build(lambda table, now=newer: self._of(now, table, days.__contains__)))
        raise Conflict(f"{attempts} commits under {self.path} were overtaken")

    def _write(self, days: list[str], tables: Mapping[str, DataFrame]) -> dict[str, dict[str, str]]:
        out: dict[str, dict[str, str]] = {}
        for table, df in tables.items():
            folder = f"data/{table}-{uuid.uuid4().hex}"
            rows = df.where(F.col("day").isin(days)).withColumn("_folder", F.col("day").cast("string"))
            keys = [c for c in ("loop_id", "ts", "hour") if c in df.columns]
            rows.repartition("day", *keys[:1]).sortWithinPartitions("day", *keys).write.partitionBy("_folder").parquet(f"{self.path}/{folder}")
            names = [s.getPath().getName() for s in self._fs.listStatus(self._file(f"{self.path}/{folder}")) if s.isDirectory()]
            out[table] = {n.partition("=")[2]: f"{folder}/{n}" for n in names if n.startswith("_folder=")}
        return out

    def _publish(self, version: int, entries: Mapping[str, str]) -> bool:
        """Creates the manifest of that number, if nobody has: written aside, then renamed to a name that must be new."""
        aside, target = self._file(f"{self.path}/manifests/.{version}-{uuid.uuid4().hex}"), self._file(f"{self.path}/manifests/{version}.json")
        stream = self._fs.create(aside, False)
        try:
            stream.write(bytearray(json.dumps(dict(entries)).encode()))
        finally:
            stream.close()
        try:
            lock = self._fs.create(self._file(f"{self.path}/manifests/_{version}.lock"), False)  # one writer gets it
            lock.close()
        except Exception:  # noqa: BLE001 - the JVM's FileAlreadyExistsException, wrapped
            self._fs.delete(aside, False)
            return self._wait(target)
        return bool(self._fs.rename(aside, target))

    def _wait(self, target) -> bool:
        """Another writer holds the number: it counts as taken. A writer that died between lock and rename is passed over."""
        import time

        for _ in range(50):
            if self._fs.exists(target):
                return False
            time.sleep(0.1)
        self._fs.delete(self._file(str(target.toString()).replace(f"/{target.getName()}", f"/_{target.getName().removesuffix('.json')}.lock")), False)
        return False

    def _forget(self, version: int) -> None:
        """Drops manifests older than KEPT, and their locks."""
        for old in self.versions()[:-KEPT]:
            for name in (f"{old}.json", f"_{old}.lock"):
                self._fs.delete(self._file(f"{self.path}/manifests/{name}"), False)

    def vacuum(self) -> int:
        """Deletes folders that no kept manifest names; to run while nobody writes. Returns how many went."""
        named = {folder.rpartition("/")[0] for v in self.versions() for folder in self.manifest(v)[1].values()}
        root, gone = self._file(f"{self.path}/data"), 0
        for s in self._fs.listStatus(root) if self._fs.exists(root) else []:
            if f"data/{s.getPath().getName()}" not in named:
                gone += bool(self._fs.delete(s.getPath(), True))
        return gone


def merge_samples(tables: CommittedTables, df: DataFrame, version: str = "version", table: str = "samples") -> int:
    """Adds samples so that the last write of a (loop, ts) wins over stored ones too; only the days of the batch are rewritten."""
    from ..operators.segments import upsert

    fresh = df.withColumn("day", F.to_date("ts"))
    days = [str(r["day"]) for r in fresh.select("day").distinct().collect()]  # one row a day

    def build(stored: Callable[[str], DataFrame | None]) -> dict[str, DataFrame]:
        old = stored(table)
        return {table: upsert(fresh.limit(0) if old is None else old.select(fresh.columns), fresh, ["loop_id", "ts"], version)}

    return tables.commit(days, build)


def replace_range(tables: CommittedTables, df: DataFrame, loops: list[str], start: str, end: str, table: str = "samples") -> int:
    """Replaces the loops' stored samples from start to end, both ends in it, by df; other loops' rows stay."""
    fresh = df.withColumn("day", F.to_date("ts"))
    days = sorted({*(str(r["day"]) for r in fresh.select("day").distinct().collect()), *(d for d in tables.days(table) if start[:10] <= d <= end[:10])})
    gone = F.col("loop_id").isin(loops) & F.col("ts").between(F.lit(start).cast("timestamp"), F.lit(end).cast("timestamp"))

    def build(stored: Callable[[str], DataFrame | None]) -> dict[str, DataFrame]:
        old = stored(table)
        return {table: fresh if old is None else old.where(~gone).select(fresh.columns).unionByName(fresh)}

    return tables.commit(days, build)


def backfill(tables: CommittedTables, wanted: DataFrame, compute: Callable[[DataFrame], DataFrame], cancelled: Callable[[], bool] = lambda: False, table: str = "snapshots", ledger: str = "ledger") -> list[str]:
    """Fills the loops' hours of wanted (loop_id, hour, version) day by day; returns the days committed.

    The ledger holds (loop_id, hour, version) of what is done, and is committed with the snapshots. Hours whose version it
    has are left out, so a second run writes nothing and a stopped one goes on where it was; a new version computes its
    hours anew. compute(todo) gives snapshots (loop_id, hour, ...) of the hours it is given; hours for which it gives none
    are done too. `cancelled` is asked between days."""
    wanted = wanted.select("loop_id", "hour", "version").distinct().withColumn("day", F.to_date("hour"))
    days = sorted(str(r["day"]) for r in wanted.select("day").distinct().collect())  # one row a day
    out = []
    for day in days:
        if cancelled():
            break
        of_day = wanted.where(F.col("day") == F.lit(day).cast("date"))
        done = tables.read(ledger, day, day)
        if (of_day if done is None else of_day.join(done, ["loop_id", "hour", "version"], "left_anti")).isEmpty():
            continue

        def build(stored: Callable[[str], DataFrame | None], of_day: DataFrame = of_day) -> dict[str, DataFrame]:
            known, old = stored(ledger), stored(table)
            todo = of_day if known is None else of_day.join(known, ["loop_id", "hour", "version"], "left_anti")
            made = compute(todo.select("loop_id", "hour", "version")).withColumn("day", F.to_date("hour"))
            hours = todo.select("loop_id", "hour")
            snapshots = made if old is None else old.join(hours, ["loop_id", "hour"], "left_anti").select(made.columns).unionByName(made)
            lines = todo.select("loop_id", "hour", "version", "day")
            return {table: snapshots, ledger: lines if known is None else known.join(hours, ["loop_id", "hour"], "left_anti").select(lines.columns).unionByName(lines)}

        tables.commit([day], build)
        out.append(day)
    return out
