"""Incremental stages as Structured Streaming jobs over files.

Every job takes ``at``, a folder of its own that holds offsets, state and results, so that
the next run goes on where the last one ended. Without it a run starts in a new folder.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from callweave.operators.ingest import gate, make_id, merge_by_id
from callweave.plans.scratch import files, new_path


def stream_of(spark: SparkSession, path: str, most_files: int = 64) -> DataFrame:
    """New Parquet files of a folder, or one file, as they come; ``most_files`` bounds a micro-batch."""
    schema = spark.read.parquet(path).schema
    fs, at = files(spark, path)
    one = fs.getFileStatus(at).isFile()  # a source reads folders; the pattern names this file alone
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", most_files).parquet(f"{path[:-1]}[{path[-1]}]" if one else path)
    # watermarks need instants; local times are read in the session's time zone
    return rows.withColumns({f.name: F.col(f.name).cast("timestamp") for f in schema if f.dataType.typeName() == "timestamp_ntz"})


def drain(df: DataFrame, mode: str = "append", at: str | None = None) -> DataFrame:
    """Run a stream over all files that are there, and read what it has written so far."""
    spark, at = df.sparkSession, at or new_path(df.sparkSession, "stream")
    df.writeStream.outputMode(mode).format("parquet").option("path", f"{at}/rows").option("checkpointLocation", f"{at}/offsets").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(df.schema).parquet(f"{at}/rows")


def _versions(spark: SparkSession, at: str) -> list[int]:
    fs, path = files(spark, f"{at}/table")
    return sorted(int(s.getPath().getName()) for s in fs.listStatus(path)) if fs.exists(path) else []


def _replace(df: DataFrame, mode: str, at: str, make) -> DataFrame:
    """Run a stream whose table is replaced with each micro-batch: ``make(batch, table before)``.

    A version is named by its batch, and made from the one before, so a batch that is run
    again after a failure gives the same table. Older versions than the last two go.
    """
    spark = df.sparkSession

    def put(batch: DataFrame, number: int) -> None:
        before = [v for v in _versions(spark, at) if v < number]
        old = spark.read.schema(df.schema).parquet(f"{at}/table/{before[-1]}") if before else None
        make(batch, old).write.mode("overwrite").parquet(f"{at}/table/{number}")
        for v in before[:-1]:
            fs, path = files(spark, f"{at}/table/{v}")
            fs.delete(path, True)

    df.writeStream.outputMode(mode).foreachBatch(put).option("checkpointLocation", f"{at}/offsets").trigger(availableNow=True).start().awaitTermination()
    found = _versions(spark, at)
    return spark.read.schema(df.schema).parquet(f"{at}/table/{found[-1]}") if found else spark.createDataFrame([], df.schema)


def drain_complete(df: DataFrame, at: str | None = None) -> DataFrame:
    """Run an aggregating stream over all files that are there, and read its whole last result.

    For a table of counts that is replaced as a whole, open windows included; windows that
    are appended once they close are ``drain``'s.
    """
    return _replace(df, "complete", at or new_path(df.sparkSession, "complete"), lambda batch, _: batch)


def discovered(stream: DataFrame, seen: DataFrame, delay: str) -> DataFrame:
    """Ids of a URL stream, each once within the delay, without those seen before."""
    named = stream.withColumn("id", make_id(F.col("url"), "d")).select("id", "url", "ts")
    return named.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["id"]).join(seen.select("id"), "id", "left_anti")


#: Buckets of an upserted table.
BUCKETS = 64


def _manifest(spark: SparkSession, at: str, below: int | None = None) -> tuple[int, dict[int, int]]:
    """The number of the last batch (before ``below``) whose manifest stands, and its version of each bucket; -1 without any."""
    fs, path = files(spark, f"{at}/manifest")
    if not fs.exists(path):
        return -1, {}
    found = [int(s.getPath().getName()) for s in fs.listStatus(path) if s.getPath().getName().isdigit()]
    last = max((n for n in found if below is None or n < below), default=-1)
    if last < 0:
        return -1, {}
    return last, {r.bucket: r.version for r in spark.read.schema("bucket int, version bigint").parquet(f"{at}/manifest/{last}").collect()}  # a row a bucket


def _bucket_paths(at: str, versions: dict[int, int]) -> list[str]:
    return [f"{at}/data/{v}/bucket={b}" for b, v in sorted(versions.items())]


def read_upserted(spark: SparkSession, at: str, schema) -> DataFrame:
    """The table as the last manifest has it."""
    _, versions = _manifest(spark, at)
    return spark.read.schema(schema).parquet(*_bucket_paths(at, versions)) if versions else spark.createDataFrame([], schema)


def upsert(stream: DataFrame, key: str, order: str, at: str | None = None, buckets: int = BUCKETS) -> DataFrame:
    """The table of latest rows, with each micro-batch's rows in place of old ones.

    Rows lie in hash buckets of their key. A batch reads and writes only the buckets that it
    touches, as files of its own number, and then writes a manifest of the version that
    holds for each bucket. Readers follow the last manifest, so files of a batch that broke
    off before it are not seen, and a batch that is run again starts from the manifest
    before it and gives the same table. Files that the last two manifests do not name go.
    """
    spark, at = stream.sparkSession, at or new_path(stream.sparkSession, "upsert")
    columns = stream.columns
    place = F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")

    def put(batch: DataFrame, number: int) -> None:
        before, versions = _manifest(spark, at, below=number)
        rows = batch.withColumn("bucket", place).persist()
        try:
            touched = {r.bucket for r in rows.select("bucket").distinct().collect()}  # at most ``buckets``
            if not touched:
                return
            old = _bucket_paths(at, {b: v for b, v in versions.items() if b in touched})
            known = spark.read.schema(batch.schema).parquet(*old) if old else spark.createDataFrame([], batch.schema)
            merged = merge_by_id(known, rows.select(*columns), key, order).withColumn("bucket", place)
            merged.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{at}/data/{number}")
        finally:
            rows.unpersist()
        now = versions | dict.fromkeys(touched, number)
        spark.createDataFrame(sorted(now.items()), "bucket int, version bigint").coalesce(1).write.mode("overwrite").parquet(f"{at}/manifest/{number}")
        kept = set(now.values()) | set(versions.values())
        for folder, live in ((f"{at}/data", kept), (f"{at}/manifest", {number, before})):
            fs, path = files(spark, folder)
            for s in fs.listStatus(path):
                if s.getPath().getName().isdigit() and int(s.getPath().getName()) not in live:
                    fs.delete(s.getPath(), True)

    stream.writeStream.outputMode("append").foreachBatch(put).option("checkpointLocation", f"{at}/offsets").trigger(availableNow=True).start().awaitTermination()
    return read_upserted(spark, at, stream.schema)


#: State that a processor keeps by key needs this store.
STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
DAY = 86_400
#: Groups in which a processor sees its keys; a call for each key alone would cost more than its rows.
KEYED = 1024


class _Kept(StatefulProcessor):
    """A processor whose keys have one value, which goes once the watermark is ``span`` seconds past the key's last event.

    It sees hash buckets of keys, each with a map of its keys' values and one timer. The timer looks through the
    bucket, not more often than sixteen times a span, so a value may stay for a sixteenth longer.
    """

    def __init__(self, kind: str, span: float, by: list[str], columns: list[str]):
        self.kind, self.span, self.by, self.columns = kind, span, by, columns

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.values = handle.getMapState("values", "name string", f"{self.kind}, last double")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803  Spark's names
        found = pd.concat(rows).set_axis(self.names, axis=1)  # Spark leaves out the names of computed columns
        found = found.sort_values(["__name", *self.by], kind="stable", ignore_index=True)
        names, times = found["__name"].to_numpy(object), (found["ts"] - pd.Timestamp(0)).dt.total_seconds().to_numpy()
        starts = np.flatnonzero(np.r_[True, names[1:] != names[:-1]])
        ends = np.r_[starts[1:], len(names)]
        before = [self.values.getValue((names[lo],)) for lo in starts]
        kept, new = self.told(found, times, starts, ends, before)
        lasts = [max(times[hi - 1], old[-1] if old else float("-inf")) for hi, old in zip(ends, before, strict=True)]
        for lo, value, last in zip(starts, kept, lasts, strict=True):
            self.values.updateValue((names[lo],), (value, float(last)))
        if not list(self.handle.listTimers()):
            self.handle.registerTimer(int((min(lasts) + self.span) * 1000))
        if len(new):
            yield found.loc[new, self.columns]

    def told(self, found: pd.DataFrame, times: np.ndarray, starts: np.ndarray, ends: np.ndarray, before: list) -> tuple[list, np.ndarray]:
        """The value of each key whose rows lie from its start to its end, and the places of the rows to hand on."""
        raise NotImplementedError

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        now = timerValues.getCurrentWatermarkInMs() / 1000
        lasts = [(name, value[-1]) for name, value in self.values.iterator()]
        for name, last in lasts:
            if last + self.span <= now:
                self.values.removeKey(name)
        if left := [last for _, last in lasts if last + self.span > now]:
            self.handle.registerTimer(int(max(min(left) + self.span, now + self.span / 16) * 1000))
        yield from ()

    def close(self) -> None:
        pass


class _Changes(_Kept):
    def told(self, found, times, starts, ends, before):
        hashes = found["hash"].to_numpy(object)
        earlier, gap = np.r_[[None], hashes[:-1]].astype(object), np.diff(times, prepend=np.nan)
        for at, old in zip(starts, before, strict=True):
            earlier[at], gap[at] = (old[0], times[at] - old[1]) if old else (None, np.nan)
        # what is too old to count is too old in any batch
        new = (pd.Series(hashes, dtype=object) != pd.Series(earlier, dtype=object)).to_numpy() | (gap > self.span)
        return [hashes[hi - 1] for hi in ends], np.flatnonzero(new)


class _Throttle(_Kept):
    def __init__(self, span: float, failed: str, success: str, most: int):
        super().__init__("times array<double>", span, ["ts", "event_type"], ["id", "ts"])
        self.failed, self.success, self.most = failed, success, most

    def told(self, found, times, starts, ends, before):
        kinds, kept, new = found["event_type"].to_list(), [], []
        for lo, hi, old in zip(starts, ends, before, strict=True):
            last = list(old[0]) if old else []
            for at in range(lo, hi):
                second = float(times[at])
                if kinds[at] == self.success:
                    last = []
                elif kinds[at] == self.failed:
                    last = [t for t in last if t > second - self.span][-(self.most - 1) :] + [second] if self.most > 1 else [second]
                    if len(last) >= self.most:
                        new.append(at)
            kept.append(last)
        return kept, np.array(new, int)


def _with_state(stream: DataFrame, key: str, processor: _Kept, schema, delay: str) -> DataFrame:
    stream.sparkSession.conf.set(*STORE)
    named = stream.withColumns({"__name": F.coalesce(F.concat(F.lit("="), F.col(key)), F.lit("")), "__bucket": F.pmod(F.xxhash64(key), F.lit(KEYED)).cast("int")})
    processor.names = named.columns
    return named.withWatermark("ts", delay).groupBy("__bucket").transformWithStateInPandas(statefulProcessor=processor, outputStructType=schema, outputMode="Append", timeMode="eventTime")


def changed_pages(stream: DataFrame, keep_days: float = 400, delay: str = "1 hour") -> DataFrame:
    """``key, hash, ts`` of a crawl, only where a page's hash differs from the one before it.

    The state of a page is its last hash, which goes ``keep_days`` after its last visit (by
    the watermark); a page that comes back later counts as new. A page's rows within one
    micro-batch are put in order by time; the number of files a micro-batch reads bounds
    them. Rows later than ``delay`` are left out.
    """
    rows = stream.select("key", "hash", "ts")
    return _with_state(rows, "key", _Changes("hash string", keep_days * DAY, ["ts", "hash"], ["key", "hash", "ts"]), rows.schema, delay)


def blocked(stream: DataFrame, failed: str, most: int, span: str = "15 minutes", slide: str = "5 minutes", delay: str = "1 hour") -> DataFrame:
    """(key, window) with so many failures or more; late events within the delay count."""
    bad = stream.where(F.col("event_type") == failed).withWatermark("ts", delay)
    counts = bad.groupBy(F.window("ts", span, slide), "id").agg(F.count("*").alias("n"))
    return counts.where(F.col("n") >= most).select("id", F.col("window.start").cast("timestamp_ntz").alias("start"), "n")


def throttled(stream: DataFrame, failed: str, success: str, most: int, seconds: int, delay: str = "1 hour") -> DataFrame:
    """``id, ts`` of each failure that is the ``most``-th or a later one within ``seconds``, counted since the last success.

    The state of a key is the times of its last ``most`` failures at most; it goes once the
    watermark is ``seconds`` past the key's last event, when no failure in it counts any
    more. Rows later than ``delay`` are left out.
    """
    rows = stream.select("id", "ts", "event_type")
    return _with_state(rows, "id", _Throttle(seconds, failed, success, most), rows.select("id", "ts").schema, delay)


def routed(stream: DataFrame, rules, delay: str = "1 hour") -> DataFrame:
    """Rows by tumbling hour and reason of rejection (null: accepted)."""
    judged = gate(stream, rules).withWatermark("ts", delay)
    return judged.groupBy(F.window("ts", "1 hour"), "reason").agg(F.count("*").alias("n")).select(F.col("window.start").cast("timestamp_ntz").alias("start"), "reason", "n")
