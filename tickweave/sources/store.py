"""A series store on Parquet: immutable segments under a versioned catalog.

``data/segment_id=…/symbol=…/year=…`` holds tall rows, sorted by column and time
so that row groups prune; ``catalog/<version>`` holds the segments' bounds. A
commit writes its segment, claims the next version, which fails if another
writer was faster, and publishes its catalog. Readers
keep the version they began with. Overlapping commits are merged on read, the
later one wins; ``compact`` rewrites a symbol into one segment.
"""

from __future__ import annotations

import uuid
from collections.abc import Mapping, Sequence
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickweave.functions.time import instant, whole_division
from tickweave.functions.types import FIELD_TYPES, VALUE_COLUMNS, with_default
from tickweave.operators import align, carry, merge, model, segments

CATALOG = "symbol string, column string, type string, segment_id string, start timestamp_ntz, end timestamp_ntz, n_rows long, commit long"
#: Rows in one data file.
FILE_ROWS = 20_000_000
#: Input positions of one key that are compared in one task.
POSITIONS = 1_000_000


class Conflict(RuntimeError):
    """Another writer has published the version that this one was about to."""


class Store:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        hadoop = spark._jvm.org.apache.hadoop.fs
        self._path = hadoop.Path
        self._fs = hadoop.Path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    # catalog

    def version(self) -> int:
        """Last published version, 0 for a new store."""
        folder = self._path(f"{self.path}/versions")
        if not self._fs.exists(folder):
            return 0
        names = [s.getPath().getName() for s in self._fs.listStatus(folder)]
        return max((int(name) for name in names if name.isdigit()), default=0)

    def catalog(self, version: int | None = None) -> DataFrame:
        version = self.version() if version is None else version
        if not version:
            return self.spark.createDataFrame([], CATALOG)
        return self.spark.read.schema(CATALOG).parquet(f"{self.path}/catalog/{version}")

    def _publish(self, catalog: DataFrame, base: int) -> None:
        """Claim the next version, which only one writer can, then put its catalog in place and show it to readers."""
        new = base + 1
        staged = f"{self.path}/catalog/{new}-{uuid.uuid4().hex}"
        catalog.coalesce(1).write.parquet(staged)
        try:
            self._fs.create(self._path(f"{self.path}/versions/.{new}"), False).close()
        except Exception as e:
            self._fs.delete(self._path(staged), True)
            raise Conflict(f"version {new} is another writer's") from e
        if not self._fs.rename(self._path(staged), self._path(f"{self.path}/catalog/{new}")):
            self._fs.delete(self._path(staged), True)
            self._fs.delete(self._path(f"{self.path}/versions/.{new}"), False)
            raise OSError(f"the catalog of version {new} cannot be put in place")
        self._fs.create(self._path(f"{self.path}/versions/{new}"), False).close()

    def recover(self) -> None:
        """Drop the claim of a writer that died before it published; call it only when no writer is at work."""
        new = self.version() + 1
        for path in (f"versions/.{new}", f"catalog/{new}"):
            self._fs.delete(self._path(f"{self.path}/{path}"), True)

    def columns(self, symbol: str) -> dict[str, str]:
        """Column name -> type of a symbol."""
        return {r["column"]: r["type"] for r in self.catalog().where(F.col("symbol") == symbol).select("column", "type").distinct().collect()}

    # writes

    def _write(self, tall: DataFrame, segment: str) -> DataFrame:
        rows = tall.withColumn("year", F.year("ts"))
        # by range, so that a busy symbol's year is cut among tasks and stays sorted
        order = ["symbol", "year", "column", "ts", "seq"]
        dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order)
        dealt.write.option("maxRecordsPerFile", FILE_ROWS).partitionBy("symbol", "year").parquet(f"{self.path}/data/segment_id={segment}")
        return self._read([segment])

    def _read(self, names: Sequence[str]) -> DataFrame:
        """One scan of the named segments; segment, symbol and year are partitions."""
        schema = T.StructType.fromDDL(model.TALL_SCHEMA + ", segment_id string, year int")
        return self.spark.read.schema(schema).option("basePath", f"{self.path}/data").parquet(*[f"{self.path}/data/segment_id={name}" for name in names])

    def _entries(self, rows: DataFrame, segment: str, commit: int) -> DataFrame:
        kind = F.coalesce(*[F.when(F.col(t.column).isNotNull(), F.lit(t.name)) for t in FIELD_TYPES.values()])
        found = merge.bounds(rows.withColumn("type", kind), ["symbol", "column", "type"])
        return found.select("symbol", "column", "type", F.lit(segment).alias("segment_id"), "start", "end", "n_rows", F.lit(commit).cast("long").alias("commit"))

    def append(self, tall: DataFrame, segment: str | None = None) -> None:
        """Commit tall rows of any symbols as one segment; a type other than a column's stored one is an error.

        A ``segment`` that is named is committed once: while the catalog has
        it, another append under its name does nothing.
        """
        base = self.version()
        known = self.catalog(base)
        if segment is None:
            segment = uuid.uuid4().hex
        elif not known.where(F.col("segment_id") == segment).isEmpty():
            return
        else:
            # left by an attempt that did not publish
            self._fs.delete(self._path(f"{self.path}/data/segment_id={segment}"), True)
        written = self._write(tall.select(*model.TALL), segment)
        new = self._entries(written, segment, base + 1)
        stored = known.select("symbol", "column", F.col("type").alias("stored")).distinct()
        wrong = new.join(stored, ["symbol", "column"]).where("type <> stored").limit(5).collect()
        mixed = new.groupBy("symbol", "column").count().where("count > 1").limit(5).collect()
        if wrong or mixed:
            self._fs.delete(self._path(f"{self.path}/data/segment_id={segment}"), True)
            raise TypeError(f"types differ from the stored ones: {wrong or mixed}")
        if not new.isEmpty():
            self._publish(known.unionByName(new), base)

    def insert(self, symbol: str, data: DataFrame | Mapping[str, Sequence], sort: bool = False) -> None:
        """Insert wide rows with a ``timestamp`` column; nothing is written unless all are valid.

        Arrays of unequal length, a missing or mistyped ``timestamp`` and, for
        arrays unless ``sort`` is set, descending timestamps are errors.
        """
        if isinstance(data, Mapping):
            if "timestamp" not in data:
                raise ValueError("a timestamp column is needed")
            if len({len(v) for v in data.values()}) > 1:
                raise ValueError("columns differ in length")
            times = list(data["timestamp"])
            if not all(isinstance(t, datetime) for t in times):
                raise TypeError("timestamp holds something else than date and time")
            if not sort and any(b < a for a, b in zip(times, times[1:])):
                raise ValueError("timestamps descend")
            names = list(data)
            wide = self.spark.createDataFrame([(n, *row) for n, row in enumerate(zip(*data.values()))], ["__seq", *names])
        else:
            if "timestamp" not in data.columns:
                raise ValueError("a timestamp column is needed")
            if data.schema["timestamp"].dataType not in (T.TimestampNTZType(), T.TimestampType()):
                raise TypeError("timestamp holds something else than date and time")
            names = data.columns
            wide = data.withColumn("__seq", F.monotonically_increasing_id())
        tall = model.melt(wide.withColumn("symbol", F.lit(symbol)), "symbol", "timestamp", [n for n in names if n != "timestamp"], "__seq")
        self.append(tall)

    def delete(self, symbol: str, start: datetime | str, end: datetime | str, columns: list[str] | None = None) -> None:
        """Delete rows with start <= ts <= end; only segments that overlap the range are rewritten."""
        base = self.version()
        known = self.catalog(base)
        hit = segments.search(model.project(known.where(F.col("symbol") == symbol), columns), instant(start), instant(end))
        keys = ["symbol", "column", "segment_id"]
        hit = hit.select(*keys, "commit")
        touched = hit.collect()  # catalog rows of one symbol and range
        if not touched:
            return
        catalog = known.join(F.broadcast(self.spark.createDataFrame(touched, hit.schema).select(*keys)), keys, "left_anti")
        for segment, commit in sorted({(r["segment_id"], r["commit"]) for r in touched}):
            names = [r["column"] for r in touched if r["segment_id"] == segment]
            rows = self._read([segment]).where((F.col("symbol") == symbol) & F.col("column").isin(*names))
            kept = merge.delete_range(rows, instant(start), instant(end))
            if not kept.isEmpty():
                new = uuid.uuid4().hex
                written = self._write(kept.select(*model.TALL), new)
                catalog = catalog.unionByName(self._entries(written, new, commit))
        self._publish(catalog, base)

    def compact(self, symbol: str) -> None:
        """Rewrite a symbol's merged rows as one segment."""
        base = self.version()
        known = self.catalog(base)
        rows = self.scan(symbol)
        segment = uuid.uuid4().hex
        written = self._write(rows.withColumn("seq", F.lit(0).cast("long")).select(*model.TALL), segment)
        self._publish(known.where(F.col("symbol") != symbol).unionByName(self._entries(written, segment, base + 1)), base)

    # reads

    def scan(self, symbol: str | list[str], start=None, end=None, columns: list[str] | None = None, carry_in: str = "none", day: bool = False) -> DataFrame:
        """Merged tall rows of symbols with start <= ts <= end; ``day`` ends the range a day after its start.

        Only segments that overlap the range are opened, and symbol, year,
        column and time reach the scan as filters. ``carry_in`` says which
        earlier rows come along: none, those of segments that straddle the
        start, or all.
        """
        symbols = [symbol] if isinstance(symbol, str) else symbol
        known = self.catalog().where(F.col("symbol").isin(*symbols))
        if columns is not None and isinstance(symbol, str):
            model.project(known, columns, list(self.columns(symbol)) or columns)
        known = model.project(known, columns)
        low = instant(start if start is not None else "0001-01-01")
        high = instant(end) if end is not None else low + F.expr("interval 1 day") if day else instant("9999-12-31 23:59:59.999999")
        first = instant("0001-01-01") if carry_in == "unbounded" else low
        used = segments.search(known, first, high)
        # a segment may hold series that the catalog has since dropped from it, so rows meet their own entry
        keys = ["segment_id", "symbol", "column"]
        commits = used.select(*keys, "commit").distinct()
        names = sorted(r["segment_id"] for r in commits.select("segment_id").distinct().collect())
        if not names:
            return self.spark.createDataFrame([], model.TALL_SCHEMA)
        rows = model.project(self._read(names), columns).where(F.col("symbol").isin(*symbols) & (F.col("ts") <= high))
        rows = rows.join(commits, keys)
        if carry_in == "none":
            rows = rows.where((F.col("ts") >= low) & (F.col("year") >= F.year(low)))
        else:
            rows = segments.carry_in(used, rows, ["symbol", "column", "segment_id"], low, high, carry_in)
        merged = merge.collapse(rows.select("symbol", "column", "ts", "commit", "seq", *VALUE_COLUMNS), ["symbol", "column", "ts"], ["commit", "seq"])
        return merged.select(*model.TALL)

    def read_at(self, symbol: str, probes: DataFrame, start=None, end=None, columns: list[str] | None = None, carry_in: str = "segment", defaults: bool = False) -> DataFrame:
        """``probes`` (``ts``) with every column's value and update time at each of them, as a cursor would show."""
        kinds = {c: t for c, t in self.columns(symbol).items() if columns is None or c in columns}
        ticks = model.pivot(self.scan(symbol, start, end, columns, carry_in), kinds).withColumn("seq", F.lit(0).cast("long"))
        asked = probes.withColumn("symbol", F.lit(symbol))
        out = align.asof(ticks, asked, ["symbol"], "ts", list(kinds), ["seq"], stamps=True)
        return out.withColumns({c: with_default(F.col(c), t) for c, t in kinds.items()}) if defaults else out

    def recorder(self, symbol: str):
        from tickweave.sources.recorder import Recorder

        return Recorder(self, symbol)


def order_violations(rows: DataFrame, keys: list[str], position: str, ts: str) -> DataFrame:
    """Rows that come, in input order, after a row of the same key with a later timestamp.

    Compared in ``position`` order; only direct neighbours are looked at, as a
    writer would that rejects the first step back.
    Positions are whole numbers; a task holds POSITIONS of them for one key.
    """
    cut = whole_division(F.col(position), POSITIONS)
    before = carry.with_previous(rows, keys, [position], [ts], bucket=cut)
    return before.withColumnRenamed(f"prev_{ts}", "prev_ts").where(F.col("prev_ts") > F.col(ts))


