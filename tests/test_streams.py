"""Streams whose answer must not depend on batches: stale chunks, passing time, shuffled events, bounded state."""

import datetime as dt
import random
import time

import pytest
from pyspark.sql import functions as F

from quern.operators import chunking as ch
from quern.streaming import streams as st

DAY = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)


class Feed:
    """A folder that files come to, as a stream of one file a batch."""

    def __init__(self, spark, path, schema):
        self.spark, self.path, self.schema, self.n = spark, str(path), schema, 0

    def add(self, rows):
        self.spark.createDataFrame(rows, self.schema).coalesce(1).write.parquet(f"{self.path}/tmp{self.n}")
        import glob
        import os

        os.makedirs(f"{self.path}/in", exist_ok=True)
        (part,) = glob.glob(f"{self.path}/tmp{self.n}/*.parquet")
        os.rename(part, f"{self.path}/in/{self.n:04}.parquet")
        os.utime(f"{self.path}/in/{self.n:04}.parquet", (1_700_000_000 + self.n,) * 2)
        self.n += 1
        return self

    def stream(self):
        return self.spark.readStream.schema(self.schema).option("maxFilesPerTrigger", 1).parquet(f"{self.path}/in")


def cut(text):
    return [text[i : i + 10] for i in range(0, len(text or ""), 10)]


def test_ingest_leaves_no_stale_chunks(spark, tmp_path):
    """A text of three chunks, then of one; one that becomes empty or null; a version that comes late; the same document twice in a batch."""
    feed = Feed(spark, tmp_path, "doc_id long, text string, version int")
    batches = [
        [(1, "a" * 25, 1), (2, "b" * 30, 2), (3, "c" * 12, 1)],
        [(1, "z" * 8, 2), (2, "old" * 9, 1)],
        [(3, None, 2), (4, "d" * 15, 1), (5, "e" * 22, 1), (5, "f" * 11, 3)],
        [(4, "", 1), (1, "y" * 21, 2)],
        [(2, "g" * 5, None), (6, "h" * 9, 7)],
    ]
    for b in batches:
        feed.add(b)
    for every in (100, 2):
        got = st.ingest(feed.stream(), lambda b: ch.window_chunks(b, "doc_id", "text", 10), "doc_id", "version", every)
        want = {}
        for b in batches:
            for key in {r[0] for r in b}:
                _, text, version = max((r for r in b if r[0] == key), key=lambda r: r[2] or -1)
                if key not in want or (version or -1) >= want[key][0]:
                    want[key] = (version or -1, text)
        assert sorted(map(tuple, got.collect())) == sorted((k, i, c) for k, (_, t) in want.items() for i, c in enumerate(cut(t)))
        assert got.columns == ["doc_id", "chunk_index", "content"]


def test_compaction_and_repeated_batches(spark, tmp_path):
    chunk = lambda b: ch.window_chunks(b, "doc_id", "text", 10)
    docs = lambda *rows: spark.createDataFrame(list(rows), "doc_id long, text string")
    table = st.Chunks(spark, str(tmp_path / "t"), "doc_id", chunk(docs((1, "a"))).schema)
    held = lambda: sorted((r.doc_id, r.content) for r in table.latest().collect())
    assert held() == []
    table.put(docs((1, "a" * 25), (2, "b")), chunk, None, 0)
    table.put(docs((1, "short"), (3, "c")), chunk, None, 1)
    table.put(docs((1, "short"), (3, "c")), chunk, None, 1)
    want = [(1, "short"), (2, "b"), (3, "c")]
    assert held() == want
    table.compact()
    assert held() == want and table._folders("chunks") == ["upto=1"]
    table.put(docs((2, "")), chunk, None, 2)
    table.compact()
    assert held() == [(1, "short"), (3, "c")] and spark.read.parquet(f"{table.path}/chunks/upto=2").count() == 2


def admitted(events, limit, seconds):
    held, out = {}, {}
    for us, event, user in sorted(events):
        times = held.setdefault(user, [])
        out[event] = sum(t > us - seconds * 1_000_000 for t in times) < limit
        if out[event]:
            times.append(us)
    return out


def test_limiter_does_not_depend_on_batches(spark, tmp_path):
    rng = random.Random(2)
    events = [(i, rng.randrange(3), DAY + dt.timedelta(seconds=rng.randrange(3000), microseconds=rng.randrange(1000))) for i in range(120)]
    end = [(900 + u, 99, DAY + dt.timedelta(days=2)) for u in range(1)]
    want = admitted([(int((t - DAY) / dt.timedelta(microseconds=1)), i, u) for i, u, t in events], 3, 600)
    assert 20 < sum(want.values()) < 110
    for k, seed in enumerate((1, 2)):
        rows = events[:]
        random.Random(seed).shuffle(rows)
        feed = Feed(spark, tmp_path / str(k), "event_id long, user_id long, ts timestamp")
        for at in range(0, 120, 40 + 20 * k):
            feed.add(rows[at : at + 40 + 20 * k])
        got = st.drain(st.exact_limiter(feed.add(end).stream(), 3, 600)).filter("user_id < 9").collect()
        assert {r.event_id: r.admitted for r in got} == want and len(got) == 120
        few = Feed(spark, tmp_path / f"all{k}", "event_id long, user_id long, ts timestamp")
        for at in range(0, 120, 40 + 20 * k):
            few.add(rows[at : at + 40 + 20 * k])
        got = st.limit_all(few.stream(), 3, 600).collect()  # without a later event, most still wait when the stream ends
        assert {r.event_id: r.admitted for r in got} == want and len(got) == 120


def test_a_lease_runs_out_while_only_time_passes(spark, tmp_path):
    """By event time: other jobs' signs move the watermark. A renewed lease holds on, an ended one is no more swept."""
    at = lambda minutes: DAY + dt.timedelta(minutes=minutes)
    feed = Feed(spark, tmp_path, "job_id long, running boolean, ts timestamp")
    feed.add([(1, True, at(0)), (2, True, at(0)), (3, True, at(0)), (5, True, at(0)), (5, True, at(1))])
    feed.add([(2, True, at(8)), (3, False, at(4))])
    feed.add([(4, True, at(15))])
    first = st.drain(st.lease_sweep(feed.stream(), 600, 2, late="1 minute"))
    assert {tuple(r) for r in first.collect()} == {(1, "retrying"), (5, "failed")}
    feed.add([(4, True, at(40))])
    assert {tuple(r) for r in st.drain(st.lease_sweep(feed.stream(), 600, 2, late="1 minute")).collect()} == {(1, "retrying"), (5, "failed"), (2, "failed")}


def test_a_lease_runs_out_by_the_clock_without_rows(spark, tmp_path):
    """By processing time: one batch of rows, then nothing but time."""
    feed = Feed(spark, tmp_path, "job_id long, running boolean, ts timestamp").add([(1, True, DAY), (2, False, DAY), (3, True, DAY)])
    swept = []
    with st.keyed_state(spark):
        rows = st.lease_sweep(feed.stream(), 3, 2, clock="ProcessingTime")
        query = rows.writeStream.option("checkpointLocation", str(tmp_path / "log")).trigger(processingTime="500 milliseconds").foreachBatch(lambda b, n: swept.extend((time.time(), tuple(r)) for r in b.collect())).start()
    try:
        until = time.time() + 90
        while len(swept) < 2 and time.time() < until:
            time.sleep(0.5)
        assert sorted(r for _, r in swept) == [(1, "retrying"), (3, "retrying")]
    finally:
        query.stop()


@pytest.mark.parametrize("jobs_first", [False, True])
def test_published_view_and_its_state(spark, tmp_path, jobs_first):
    """A document is published when its last chunk or its job's success comes, whichever is later, hidden by a new job, and forgotten after a while."""
    at = lambda minutes: DAY + dt.timedelta(minutes=minutes)
    schema = "document_id long, chunk_index int, good boolean, job long, status string, ts timestamp"
    chunks = [[(1, 1, True, None, None, at(0)), (2, 0, True, None, None, at(0))], [(1, 0, True, None, None, at(1)), (3, 0, False, None, None, at(1)), (4, 0, True, None, None, at(1))]]
    jobs = [[(1, None, None, 7, "running", at(1)), (2, None, None, 5, "succeeded", at(1))], [(1, None, None, 8, "succeeded", at(2)), (2, None, None, 4, "failed", at(2)), (4, None, None, 2, "succeeded", at(2)), (4, None, None, 3, "running", at(2))]]
    feed = Feed(spark, tmp_path, schema)
    for b in jobs + chunks if jobs_first else chunks + jobs:
        feed.add(b)
    for k in (200, 400, 600):
        feed.add([(90 + k, 0, True, None, None, at(k))])
    rows = feed.stream()
    view = st.published_view(rows.filter("chunk_index IS NOT NULL").select("document_id", "chunk_index", "good", "ts"), rows.filter("job IS NOT NULL").select("document_id", "job", "status", "ts"), wait=600, late="30 minutes")
    seen = []
    with st.keyed_state(spark):
        query = view.writeStream.outputMode("update").option("checkpointLocation", str(tmp_path / "log")).trigger(availableNow=True).foreachBatch(lambda b, n: seen.extend(tuple(r) for r in b.collect())).start()
    query.awaitTermination()
    last = dict(seen)
    assert {k: last[k] for k in (1, 2, 3, 4)} == {1: True, 2: True, 3: False, 4: False}
    held = [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]]
    assert max(held) >= 4 and held[-1] <= 2  # of five documents of the first hours and the late ones, only the last is held


def test_many_keys_share_a_state(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(st, "BUCKETS", 3)
    rows = [(i, None if i % 11 == 0 else i % 9, 1_700_000_000_000_000 + i * i % 977 * 20_000_000) for i in range(300)]
    spark.createDataFrame(rows, "event_id long, user_id long, us long").selectExpr("event_id", "user_id", "timestamp_micros(us) AS ts").coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    got = {r.event_id: r.admitted for r in st.limit_all(st.source(spark, str(tmp_path), "events"), 3, 600).collect()}
    want = {}
    for user in {u for _, u, _ in rows}:
        mine = sorted((us, e) for e, u, us in rows if u == user)
        want |= dict(zip((e for _, e in mine), st.admit([us for us, _ in mine], [], 3, 600_000_000)[0]))
    assert got == want and 0 < sum(got.values()) < 300
