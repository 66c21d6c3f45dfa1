"""Continuous forms: telemetry rollups, limiters, expiry, duplicate suppression, document ingest.

A stream reads a table's files as they come. State goes when the watermark, an hour behind event time unless
said otherwise, has passed it; a limiter's goes when its window has. ``drain`` runs a stream over what is there
and returns its result, from a table in the shared folder. A batch that is run again after a failure
overwrites what it wrote before.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from itertools import groupby

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from quern.sources.files import new_folder

RETENTION = "1 hour"
#: States over which the keys of a stream are dealt; a call for each key costs milliseconds, an entry in a state microseconds.
BUCKETS = 1024
#: The state store that lists and timers of a key need, and its setting.
STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def keyed_state(spark: SparkSession):
    """Streams that start in here may hold lists and timers."""
    before = spark.conf.get(STORE)
    spark.conf.set(STORE, ROCKS)
    try:
        yield
    finally:
        spark.conf.set(STORE, before)


def source(spark: SparkSession, sf_dir: str, name: str, files: int | None = None) -> DataFrame:
    """A table, one file or a folder of files, as a stream with zoned timestamps."""
    path = f"{sf_dir}/{name}.parquet"
    schema = spark.read.parquet(path).schema
    reader = spark.readStream.schema(schema)
    df = (reader.option("maxFilesPerTrigger", files) if files else reader).parquet(path[:-1] + "[t]")  # a pattern, as a stream takes a plain path for a folder
    return df.select(*(F.col(c).cast("timestamp").alias(c) if t == "timestamp_ntz" else c for c, t in df.dtypes))


def _put(batch: DataFrame, number: int, path: str) -> None:
    """Writes a batch to the folder of its number."""
    batch.write.mode("overwrite").parquet(f"{path}/_batch={number}")


def _latest(spark: SparkSession, schema: T.StructType, path: str, keys: list[str] | None) -> DataFrame:
    """What batches have written; with keys the row of each key's last batch."""
    out = spark.read.schema(T.StructType([*schema.fields, T.StructField("_batch", T.LongType())])).parquet(path)
    if keys:
        out = out.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(F.col("_batch").desc()))).filter("_r = 1").drop("_r")
    return out.drop("_batch")


def _run(df: DataFrame, mode: str) -> str:
    """Runs a stream over all there is; the folder with its batches in ``out`` and its checkpoint in ``log``."""
    at = new_folder(df.sparkSession, "stream")
    with keyed_state(df.sparkSession):
        query = df.writeStream.outputMode(mode).option("checkpointLocation", f"{at}/log").trigger(availableNow=True).foreachBatch(lambda batch, number: _put(batch, number, f"{at}/out")).start()
    query.awaitTermination()
    return at


def drain(df: DataFrame, mode: str = "append", keys: list[str] | None = None) -> DataFrame:
    """Runs a stream over all there is. In update mode the last row of each key stays."""
    return _latest(df.sparkSession, df.schema, f"{_run(df, mode)}/out", keys if mode == "update" else None)


def telemetry_rollup(events: DataFrame, width: str = "1 day") -> DataFrame:
    """Requests, errors and mean latency by tumbling window and event."""
    seen = events.withWatermark("ts", RETENTION).groupBy(F.window("ts", width), "event_type")
    return seen.agg(F.count("*").alias("requests"), F.count_if(F.col("event_type") == "error").alias("errors"), F.round(F.avg("value"), 6).alias("mean")).select(F.unix_seconds("window.start").alias("start"), "event_type", "requests", "errors", "mean")


def fixed_window_counts(events: DataFrame, seconds: int) -> DataFrame:
    """Requests of each key in its epoch-aligned window."""
    w = F.window("ts", f"{seconds} seconds")
    return events.withWatermark("ts", RETENTION).groupBy("user_id", w).agg(F.count("*").alias("request_count")).select("user_id", F.unix_seconds("window.start").alias("window_start"), "request_count")


def admit(times: list[int], accepted: list[int], limit: int, window: int) -> tuple[list[bool], list[int]]:
    """Whether each request (microseconds, in order) is admitted; one that is denied doesn't count."""
    out = []
    for t in times:
        accepted = [a for a in accepted if a > t - window]
        out.append(len(accepted) < limit)
        if out[-1]:
            accepted.append(t)
    return out, accepted


def bucketed(rows: DataFrame, key: str) -> DataFrame:
    """Adds bucket, of which there are BUCKETS: a state for many keys, which are looked up in it; null keys have one of their own (-1) and are 0 in it."""
    bucket = F.when(F.col(key).isNull(), -1).otherwise(F.pmod(F.xxhash64(key), F.lit(BUCKETS)).cast("int"))
    return rows.withColumn("bucket", bucket).withColumn(key, F.coalesce(F.col(key).cast("long"), F.lit(0).cast("long")))


class Bucket(StatefulProcessor):
    """A bucket's state and its one timer, at the first moment that anything of it is due."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle

    def wake(self, ms: int | None) -> None:
        """Puts the timer; none for None."""
        for at in list(self.handle.listTimers()):
            self.handle.deleteTimer(at)
        if ms is not None:
            self.handle.registerTimer(ms)

    def close(self) -> None:
        pass


class Limiter(Bucket):
    """Holds the events of a bucket of keys until the watermark has passed them, then judges them key by key in order of time."""

    def __init__(self, limit: int, seconds: int):
        self.limit, self.window = limit, seconds * 1_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.waiting = handle.getListState("waiting", "user_id array<long>, us array<long>, event_id array<long>")  # an element for many events
        self.accepted = handle.getListState("accepted", "user_id array<long>, us array<long>")  # one element

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        due = list(self.handle.listTimers())
        for f in rows:
            self.waiting.appendValue((f["user_id"].tolist(), f["us"].tolist(), f["event_id"].tolist()))
            due.append(-(-int(f["us"].min()) // 1000))
        self.wake(min(due))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        until = timerValues.getCurrentWatermarkInMs() * 1000
        held = sorted(x for element in self.waiting.get() for x in zip(*element, strict=True))
        due, rest = [x for x in held if x[1] <= until], [x for x in held if x[1] > until]
        accepted = defaultdict(list)
        for users, times in self.accepted.get():
            for user, us in zip(users, times, strict=True):
                accepted[user].append(us)
        admitted = []
        for user, events in groupby(due, key=lambda x: x[0]):
            told, accepted[user] = admit([us for _, us, _ in events], sorted(accepted[user]), self.limit, self.window)
            admitted += told
        left = [(user, us) for user, times in accepted.items() for us in times if us > until - self.window]
        for state, values in ((self.waiting, rest), (self.accepted, left)):
            state.put([tuple(map(list, zip(*values, strict=True)))]) if values else state.clear()
        if rest or left:
            self.wake(-(-min(us for _, us, _ in rest) // 1000) if rest else max(us for _, us in left) // 1000 + self.window // 1000 + 1)
        if due:
            yield pd.DataFrame({"event_id": [e for *_, e in due], "user_id": pd.array([None if key[0] < 0 else user for user, *_ in due], dtype="Int64"), "admitted": admitted})


def exact_limiter(events: DataFrame, limit: int, seconds: int, late: str = RETENTION) -> DataFrame:
    """Each event with whether it is admitted.

    A key's events wait in its state until the watermark, ``late`` behind the newest event, has passed them, and are judged in
    order of time and id; so the answer doesn't depend on how events fall into batches. The state holds what waits
    and the times of at most ``limit`` admitted events of a key; it goes when the last of these has left the window. Events behind the watermark are left out.
    Keys share the state of their bucket, so a key costs no calls of its own.
    """
    rows = bucketed(events.withWatermark("ts", late).select("event_id", "user_id", "ts", F.unix_micros("ts").alias("us")), "user_id")
    return rows.groupBy("bucket").transformWithStateInPandas(Limiter(limit, seconds), "event_id long, user_id long, admitted boolean", "Append", "EventTime")


def limit_all(events: DataFrame, limit: int, seconds: int, late: str = RETENTION) -> DataFrame:
    """``exact_limiter`` over all there is: when the stream has ended, what still waits in its state is judged too."""
    spark, stream = events.sparkSession, exact_limiter(events, limit, seconds, late)
    at = _run(stream, "append")

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come by key and in order of time; those without an event were admitted before."""
        of, accepted = (), []
        for b in batches:
            out = []
            for user, us, event in zip(*(b.column(c).to_pylist() for c in ("user_id", "us", "event_id")), strict=True):
                if (user,) != of:
                    of, accepted = (user,), []
                if event is None:
                    accepted.append(us)
                else:
                    told, accepted = admit([us], accepted, limit, seconds * 1_000_000)
                    out.append((event, user, *told))
            yield pa.RecordBatch.from_pylist([dict(zip(names, x, strict=True)) for x in out], pa.schema(list(zip(names, (pa.int64(), pa.int64(), pa.bool_()), strict=True))))

    names = ("event_id", "user_id", "admitted")
    held = lambda name: spark.read.format("statestore").option("stateVarName", name).load(f"{at}/log").select("key.bucket", "list_element.*")
    each = lambda name, *c: held(name).select("bucket", F.explode(F.arrays_zip("user_id", "us", *c)).alias("x")).select(F.when(F.col("bucket") >= 0, F.col("x.user_id")).alias("user_id"), "x.us", *(f"x.{n}" for n in c))
    rest = each("waiting", "event_id").unionByName(each("accepted").withColumn("event_id", F.lit(None).cast("long")))
    return _latest(spark, stream.schema, f"{at}/out", None).unionByName(rest.repartition("user_id").sortWithinPartitions("user_id", "us", "event_id").mapInArrow(judge, stream.schema))


def without_repeats(df: DataFrame, key: str, ts: str, within: str = RETENTION) -> DataFrame:
    """The first row of each key; a repeat after more than ``within`` is a first row again, as the state is gone by then."""
    return df.withWatermark(ts, within).dropDuplicatesWithinWatermark([key])


class Leases(Bucket):
    """The leases of a bucket of jobs, each renewed by the job's signs of life; those that have run out go by the bucket's timer."""

    def __init__(self, seconds: int, most: int, clock: str):
        self.lease, self.most, self.clock = seconds * 1000, most, clock

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.state = handle.getValueState("leases", "job_id array<long>, until array<long>, attempts array<long>")

    def _held(self) -> dict[int, tuple[int, int]]:
        """(until, attempts) of each job with a lease."""
        return {job: (until, n) for job, until, n in zip(*self.state.get(), strict=True)} if self.state.exists() else {}

    def _keep(self, held: dict[int, tuple[int, int]]) -> None:
        if held:
            self.state.update((list(held), [until for until, _ in held.values()], [n for _, n in held.values()]))
        else:
            self.state.clear()
        self.wake(min((until for until, _ in held.values()), default=None))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        seen: dict[int, tuple] = {}  # of each job the last row as (ms, running), the last sign and the number of signs
        for f in rows:
            for job, ms, running in zip(f["job_id"].tolist(), f["ms"].tolist(), f["running"].tolist(), strict=True):
                last, sign, n = seen.get(job, ((ms, running), 0, 0))
                seen[job] = (max(last, (ms, running)), max(sign, ms) if n and running else ms if running else sign, n + bool(running))
        held, now = self._held(), timerValues.getCurrentProcessingTimeInMs() if self.clock == "ProcessingTime" else None
        for job, ((_, running), sign, n) in seen.items():
            until, attempts = held.pop(job, (0, 0))
            if running:
                held[job] = (max(until, (sign if now is None else now) + self.lease), attempts + n)
        self._keep(held)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentProcessingTimeInMs() if self.clock == "ProcessingTime" else timerValues.getCurrentWatermarkInMs()
        held = self._held()
        out = {job: n for job, (until, n) in held.items() if until <= max(now, expiredTimerInfo.getExpiryTimeInMs())}
        self._keep({job: x for job, x in held.items() if job not in out})
        if out:
            yield pd.DataFrame({"job_id": pd.array([None if key[0] < 0 else job for job in out], dtype="Int64"), "status": ["failed" if n >= self.most else "retrying" for n in out.values()]})


def lease_sweep(signs: DataFrame, seconds: int, most: int, clock: str = "EventTime", late: str | None = RETENTION) -> DataFrame:
    """(job_id, status) of each job whose lease has run out: failed after ``most`` signs of life, else retrying.

    signs: (job_id, running, ts). A running job's sign starts or renews its lease; any other state ends it. The lease runs out by a timer,
    also while no row of the job comes: when the watermark has passed it, or with ``clock`` ProcessingTime when so many seconds have gone by.
    Jobs share the state of their bucket, where each has an entry, which goes with its lease. ``late`` is None where signs have a watermark.
    """
    rows = bucketed((signs.withWatermark("ts", late) if late else signs).select("job_id", "running", "ts", F.unix_millis("ts").alias("ms")), "job_id")
    return rows.groupBy("bucket").transformWithStateInPandas(Leases(seconds, most, clock), "job_id long, status string", "Append", clock)


class Publication(Bucket):
    """Of a bucket of documents their chunks and last jobs, until their time is over."""

    def __init__(self, wait: int):
        self.wait = wait * 1000

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.state = handle.getValueState("documents", "document_id array<long>, indexed array<long>, expected array<long>, job array<long>, status array<string>, told array<boolean>, until array<long>")

    def _held(self) -> dict[int, list]:
        """[indexed, expected, job, status, told, until] of each document."""
        return {document: x for document, *x in zip(*self.state.get(), strict=True)} if self.state.exists() else {}

    def _keep(self, held: dict[int, list]) -> None:
        if held:
            self.state.update((list(held), *map(list, zip(*held.values(), strict=True))))
        else:
            self.state.clear()
        self.wake(min((x[-1] for x in held.values()), default=None))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        held, touched, out = self._held(), set(), []
        for f in rows:
            for document, index, good, job, status, ms in zip(*(f[c].tolist() for c in ("document_id", "chunk_index", "good", "job", "status", "ms")), strict=True):
                touched.add(document)
                x = held.setdefault(document, [0, 0, None, None, None, 0])
                if index == index:  # no NaN: a chunk
                    x[0], x[1] = x[0] + bool(good), max(x[1], int(index) + 1)
                if job == job and (x[2] is None or job >= x[2]):
                    x[2], x[3] = int(job), status
                x[5] = max(x[5], int(ms) + self.wait)
        for document in touched:
            x = held[document]
            indexed, expected, _, status, told, until = x
            published = expected > 0 and indexed == expected and status in (None, "succeeded")
            if published != told and expected:
                out.append((None if key[0] < 0 else document, published))
            x[4] = published if expected else None
            if until <= timerValues.getCurrentWatermarkInMs():
                del held[document]
        self._keep(held)
        if out:
            yield pd.DataFrame({"document_id": pd.array([d for d, _ in out], dtype="Int64"), "published": [p for _, p in out]})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = max(timerValues.getCurrentWatermarkInMs(), expiredTimerInfo.getExpiryTimeInMs())
        self._keep({document: x for document, x in self._held().items() if x[-1] > now})
        return iter(())


def published_view(chunks: DataFrame, jobs: DataFrame, wait: int = 3600, late: str = RETENTION) -> DataFrame:
    """(document_id, published) whenever it changes: all expected chunks are indexed and the last job, if any, has succeeded.

    chunks: (document_id, chunk_index, good, ts); jobs: (document_id, job, status, ts). Both streams meet in one entry per document
    of its bucket's state, whichever comes first. The entry goes ``wait`` seconds of event time after the document's last row, by a timer, published or not; so it is bounded
    by the documents of that time. A document without chunks has no row.
    """
    a = chunks.select("document_id", F.col("chunk_index").cast("double").alias("chunk_index"), "good", F.lit(None).cast("double").alias("job"), F.lit(None).cast("string").alias("status"), "ts")
    b = jobs.select("document_id", F.lit(None).cast("double").alias("chunk_index"), F.lit(None).cast("boolean").alias("good"), F.col("job").cast("double").alias("job"), "status", "ts")
    rows = bucketed(a.unionByName(b).withWatermark("ts", late).withColumn("ms", F.unix_millis("ts")), "document_id")
    return rows.groupBy("bucket").transformWithStateInPandas(Publication(wait), "document_id long, published boolean", "Update", "EventTime")


class Chunks:
    """A table of documents' chunks that batches are written to, in the shared folder.

    A batch leaves its chunks and, for every document it held, the version it brought. A document's chunks are those of its newest version,
    and of its last batch with that version; so a text that comes again with fewer chunks, or with none, leaves nothing of the old one,
    and a version that comes late changes nothing. ``compact`` writes what holds into one folder, after which older batches aren't read.
    """

    def __init__(self, spark: SparkSession, path: str, key: str, schema: T.StructType):
        self.spark, self.path, self.key, self.schema = spark, path, key, schema

    def put(self, docs: DataFrame, chunk: Callable[[DataFrame], DataFrame], version: str | None, number: int) -> None:
        """A batch of documents; of rows with one key the one of the highest version counts, of equal versions the one of the greatest hash."""
        v = F.col(version).cast("long") if version else F.lit(0).cast("long")
        first = Window.partitionBy(self.key).orderBy(v.desc_nulls_last(), F.xxhash64(*(c for c, t in docs.dtypes if not t.startswith("map"))).desc())
        one = docs.withColumn("_version", F.coalesce(v, F.lit(-1).cast("long"))).withColumn("_r", F.row_number().over(first)).filter("_r = 1").drop("_r").persist()
        rows = chunk(one).join(one.select(self.key, "_version"), self.key)
        rows.write.mode("overwrite").parquet(f"{self.path}/chunks/_batch={number}")
        one.select(self.key, "_version").write.mode("overwrite").parquet(f"{self.path}/versions/_batch={number}")
        one.unpersist()

    def _folders(self, kind: str) -> list[str]:
        """The last compacted folder, if any, and the batches after it; folders that aren't finished don't count."""
        jvm = self.spark._jvm
        top = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{kind}")
        fs = top.getFileSystem(self.spark._jsc.hadoopConfiguration())
        names = [x.getPath().getName() for x in fs.listStatus(top)] if fs.exists(top) else []
        names = [n for n in names if fs.exists(jvm.org.apache.hadoop.fs.Path(f"{self.path}/{kind}/{n}/_SUCCESS"))]
        base = max((n for n in names if n.startswith("upto=")), key=lambda n: int(n[5:]), default=None)
        after = -1 if base is None else int(base[5:])
        return [*([base] if base else []), *sorted((n for n in names if n.startswith("_batch=") and int(n[7:]) > after), key=lambda n: int(n[7:]))]

    def _read(self, kind: str, fields: list[T.StructField]) -> DataFrame:
        out = self.spark.createDataFrame([], T.StructType([*fields, T.StructField("_batch", T.LongType())]))
        for name in self._folders(kind):
            df = self.spark.read.schema(T.StructType([*fields, *([T.StructField("_batch", T.LongType())] if name.startswith("upto=") else [])])).parquet(f"{self.path}/{kind}/{name}")
            out = out.unionByName(df if "_batch" in df.columns else df.withColumn("_batch", F.lit(int(name[7:])).cast("long")))
        return out

    def _newest(self) -> DataFrame:
        """(key, _version, _batch) that holds for each document."""
        fields = [self.schema[self.key], T.StructField("_version", T.LongType())]
        return self._read("versions", fields).groupBy(self.key).agg(F.max(F.struct("_version", "_batch")).alias("m")).select(self.key, "m._version", "m._batch")

    def _held(self) -> DataFrame:
        return self._read("chunks", [*self.schema.fields, T.StructField("_version", T.LongType())]).join(self._newest(), [self.key, "_version", "_batch"], "left_semi")

    def latest(self) -> DataFrame:
        return self._held().select(*self.schema.names)

    def compact(self) -> None:
        """Writes what holds of all batches so far as one folder."""
        done = [int(n[7:]) for n in self._folders("versions") if n.startswith("_batch=")]
        if done:
            self._held().write.mode("overwrite").parquet(f"{self.path}/chunks/upto={max(done)}")
            self._newest().write.mode("overwrite").parquet(f"{self.path}/versions/upto={max(done)}")


def ingest(docs: DataFrame, chunk: Callable[[DataFrame], DataFrame], key: str, version: str | None = None, every: int = 16) -> DataFrame:
    """The chunks of a stream of documents (a row a document, with its ``version`` if it has one), as ``Chunks`` keeps them; batches are compacted every so many."""
    at = new_folder(docs.sparkSession, "stream")
    table = Chunks(docs.sparkSession, at, key, chunk(docs).schema)

    def put(batch: DataFrame, number: int) -> None:
        table.put(batch, chunk, version, number)
        if number % every == every - 1:
            table.compact()

    docs.writeStream.option("checkpointLocation", f"{at}/log").trigger(availableNow=True).foreachBatch(put).start().awaitTermination()
    return table.latest()
