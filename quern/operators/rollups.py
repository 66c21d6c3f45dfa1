"""Rollups, windows and checks over events, jobs, documents and messages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.functions import policy as po
from quern.sources.files import written


def disc(p: float, c: str) -> Column:
    """Nearest-rank percentile, exact."""
    return F.expr(f"percentile_disc({p}) WITHIN GROUP (ORDER BY {c})")


def window_start(minutes: int) -> int:
    """A rollup's window in minutes, held between 5 and 10,080."""
    return max(5, min(minutes, 10_080))


def since(events: DataFrame, minutes: int, ts: str = "ts") -> DataFrame:
    """The rows of the last minutes of the table; its latest time reaches the driver."""
    last = events.agg(F.max(ts)).first()[0]
    return events.filter(F.col(ts) >= F.lit(last) - F.make_dt_interval(F.lit(0), F.lit(0), F.lit(window_start(minutes)), F.lit(0)))


def api_rollup(events: DataFrame, names: list[str]) -> DataFrame:
    """Requests, errors, error rate and latency percentiles of some events."""
    chosen, n, bad = events.filter(F.col("event").isin(names)), F.count("*"), F.count_if(F.col("status") == "error")
    sums = chosen.agg(n.alias("requests"), bad.alias("errors"), F.round(F.when(n == 0, 0.0).otherwise(bad / n), 4).alias("error_rate"))
    ps = {f"p{p}_ms": p / 100 for p in (50, 95, 99)}
    ranked = exact_percentiles(chosen, "latency_ms", ps)
    return sums.join(ranked, F.lit(True), "left").select("requests", "errors", "error_rate", *(F.coalesce(c, F.lit(0.0)).alias(c) for c in ps))


def ingestion_rollup(jobs: DataFrame) -> DataFrame:
    states = ("queued", "running", "retrying", "failed", "succeeded")
    ms = (F.unix_timestamp("completed_at") - F.unix_timestamp("started_at")) * 1000
    return jobs.agg(*(F.count_if(F.col("status") == s).alias(s) for s in states), F.coalesce(F.sum(F.greatest(F.col("attempt_count") - 1, F.lit(0))), F.lit(0)).alias("retries"), F.coalesce(F.round(F.avg(ms), 0), F.lit(0.0)).alias("avg_duration_ms"))


def latency_summary(df: DataFrame, value: str, by: list[str]) -> DataFrame:
    """Count, p50, p95, p99, largest and mean of the finite values."""
    ok = df.filter(F.col(value).isNotNull() & ~F.isnan(value) & (F.abs(value) < float("inf")))
    ranked = exact_percentiles(ok, value, {f"p{p}": p / 100 for p in (50, 95, 99)}, by)
    sums = ok.groupBy(*by).agg(F.count("*").alias("n"), F.max(value).alias("max"), F.round(F.avg(value), 4).alias("mean"))
    return sums.join(ranked, by).select(*by, "n", "p50", "p95", "p99", "max", "mean")


def score_histogram(df: DataFrame, score: str) -> DataFrame:
    """Ten bins of a score from 0 to 1, empty ones kept."""
    bins = df.filter(F.col(score).isNotNull()).groupBy(F.floor(F.least(F.greatest(score, F.lit(0.0)), F.lit(0.9999)) * 10).cast("long").alias("bin")).agg(F.count("*").alias("n"))
    return df.sparkSession.range(10).withColumnRenamed("id", "bin").join(bins, "bin", "left").select("bin", F.coalesce("n", F.lit(0)).alias("n"))


def admission_check(documents: DataFrame, order: str = "document_id", count: int = po.QUEUED_PER_OWNER, size: int = po.PENDING_BYTES) -> DataFrame:
    """Whether each active document may be taken, with those of its owner before it pending."""
    w = Window.partitionBy("tenant").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    active = documents.filter(F.col("status").isin([*po.ACTIVE]))
    held = active.withColumn("n_before", F.count("*").over(w)).withColumn("bytes_before", F.coalesce(F.sum("byte_size").over(w), F.lit(0)))
    return held.withColumn("admitted", ~((F.col("n_before") >= count) | (F.col("bytes_before") + F.col("byte_size") > size)))


def publication_check(chunks: DataFrame) -> DataFrame:
    """Per document: chunks that are indexed for its version and model against those expected (largest index + 1)."""
    good = (F.col("chunk_version") == F.col("version")) & F.col("model").isNotNull()
    return chunks.groupBy("document_id").agg(F.count_if(good).alias("indexed"), (F.max("chunk_index") + 1).alias("expected")).withColumn("complete", F.col("indexed") == F.col("expected"))


def due_jobs(jobs: DataFrame, now: Column, lease: int = po.LEASE_SECONDS) -> DataFrame:
    waiting = F.col("status").isin("queued", "retrying") & (F.col("available_at") <= now)
    stale = (F.col("status") == "running") & (F.col("locked_at").isNull() | (F.col("locked_at") < now - F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(lease))))
    return jobs.filter((waiting | stale) & (F.col("attempt_count") < po.MAX_ATTEMPTS))


def sliding_rate(events: DataFrame, seconds: int, keys: list[str], slices: int = 16) -> DataFrame:
    """Events of the key in the last seconds, this one included, and the oldest of them.

    A key's time is cut in slices of ``slices`` windows, so that no task sorts a whole key; an event that windows of the next slice
    reach back to goes there too, where it is only counted.
    """
    us, window = F.unix_micros("ts"), seconds * 1_000_000
    width = F.lit(window * slices)
    own = F.floor(us / width).cast("long")
    reached = us >= (own + 1) * width - window
    rows = events.withColumn("_own", own).withColumn("_slice", F.explode(F.when(reached, F.array("_own", F.col("_own") + 1)).otherwise(F.array("_own"))))
    w = Window.partitionBy(*keys, "_slice").orderBy(us).rangeBetween(-window, 0)
    counted = rows.withColumn("n_recent", F.count("*").over(w)).withColumn("oldest", F.min("ts").over(w))
    return counted.filter("_slice = _own").drop("_slice", "_own")


def retry_after(seconds: int) -> Column:
    age = (F.unix_micros("ts") - F.unix_micros("oldest")) / 1_000_000
    return F.greatest(F.lit(1), F.ceil(seconds - age))


def fixed_window_rate(events: DataFrame, seconds: int, most: int, key: str) -> DataFrame:
    """Place of each request in its epoch-aligned window, whether it is allowed, and the seconds to wait if not."""
    start = F.unix_seconds("ts") - F.unix_seconds("ts") % seconds
    w = Window.partitionBy(key, "window_start").orderBy("ts", "event_id")
    rows = events.withColumn("window_start", start).withColumn("request_count", F.row_number().over(w))
    return rows.withColumn("allowed", F.col("request_count") <= most).withColumn("retry_after", F.when(F.col("allowed"), 0).otherwise(F.col("window_start") + seconds - F.unix_seconds("ts")))


def illegal_transitions(log: DataFrame, key: str, order: str) -> DataFrame:
    """Changes of state in a log that aren't allowed."""
    allowed = log.sparkSession.createDataFrame([(a, b) for a, bs in po.TRANSITIONS.items() for b in bs], "before string, after string")
    w = Window.partitionBy(key).orderBy(order)
    steps = log.withColumn("before", F.lag("status").over(w)).filter(F.col("before").isNotNull() & (F.col("before") != F.col("status"))).withColumnRenamed("status", "after")
    return steps.join(F.broadcast(allowed), ["before", "after"], "left_anti")


def merge_spans(spans: DataFrame, keys: list[str]) -> DataFrame:
    """The union of overlapping or touching [start, end) of each key."""
    w = Window.partitionBy(*keys).orderBy("start", "end")
    reach = F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    rows = spans.withColumn("new", F.when(reach.isNull() | (F.col("start") > reach), 1).otherwise(0)).withColumn("island", F.sum("new").over(w))
    return rows.groupBy(*keys, "island").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("island")


def _runs(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Rows (first, last, n) of each key as one where they adjoin or overlap."""
    w = Window.partitionBy(*keys).orderBy("first", "last")
    island = F.sum(F.when(F.col("first") <= F.lag("last").over(w) + 1, 0).otherwise(1)).over(w)
    return rows.select(*keys, "first", "last", "n", island.alias("_i")).groupBy(*keys, "_i").agg(F.min("first").alias("first"), F.max("last").alias("last"), F.sum("n").alias("n")).drop("_i")


def adjoining_runs(rows: DataFrame, keys: list[str], index: str, width: int = 1 << 16) -> DataFrame:
    """Runs of consecutive indexes of each key: first, last, n (rows, where an index is repeated).

    Runs are found in slices of ``width`` indexes; only those that touch a slice's border, two a slice at most, are then
    joined over slices. So no task holds more of a key than a slice's indexes or the runs at its borders.
    """
    placed = rows.groupBy(*keys, F.col(index).alias("first")).agg(F.count("*").alias("n")).withColumn("last", F.col("first")).withColumn("_s", F.floor(F.col("first") / F.lit(width)))
    inner = _runs(placed, [*keys, "_s"])
    border = (F.col("first") == F.col("_s") * width) | (F.col("last") == (F.col("_s") + 1) * width - 1)
    return inner.filter(~border).select(*keys, "first", "last", "n").unionByName(_runs(inner.filter(border), keys).select(*keys, "first", "last", "n"))


def overlapping(a: DataFrame, b: DataFrame, keys: list[str], ends_a: tuple[str, str], ends_b: tuple[str, str], width: int = 64, step: int = 8) -> DataFrame:
    """Pairs of ``a`` and ``b`` with equal keys whose spans [start, end) share something; the other columns' names differ.

    Spans are of the level whose cells, ``width`` times a power of ``step``, are as long as they are. A span goes to the one or two cells that it
    touches on its own level and on all coarser ones up to the other side's coarsest, and a pair is met on the coarser of its two levels, in the
    first cell that both touch. So a key of many spans that overlap little is dealt over cells, and makes no square of pairs.
    """
    (sa, ea), (sb, eb) = ends_a, ends_b
    length = lambda s, e: F.greatest(F.col(e) - F.col(s), F.lit(1)).cast("double")
    level = lambda s, e: F.greatest(F.lit(0), F.ceil(F.log(length(s, e) / width) / F.log(F.lit(float(step))) - 1e-9)).cast("int")
    a, b = a.filter(F.col(sa) < F.col(ea)).withColumn("_la", level(sa, ea)), b.filter(F.col(sb) < F.col(eb)).withColumn("_lb", level(sb, eb))
    most = [df.agg(F.max(c)).first()[0] or 0 for df, c in ((a, "_la"), (b, "_lb"))]

    def dealt(df: DataFrame, own: str, s: str, e: str, top: int) -> DataFrame:
        cells = lambda x: F.pow(F.lit(float(step)), x) * width
        on = df.withColumn("_level", F.explode(F.sequence(F.col(own), F.greatest(F.col(own), F.lit(top)))))
        first, last = F.floor(F.col(s) / cells(F.col("_level"))), F.floor((F.col(e) - 1) / cells(F.col("_level")))
        return on.withColumn(f"_f{own}", first).withColumn("_cell", F.explode(F.sequence(first, last)))

    pairs = dealt(a, "_la", sa, ea, most[1]).join(dealt(b, "_lb", sb, eb, most[0]), [*keys, "_level", "_cell"])
    met = (F.col("_level") == F.greatest("_la", "_lb")) & (F.col("_cell") == F.greatest("_f_la", "_f_lb")) & (F.greatest(sa, sb) < F.least(ea, eb))
    return pairs.filter(met).drop("_la", "_lb", "_level", "_cell", "_f_la", "_f_lb")


def fingerprint(df: DataFrame, order: str, fan: int = 4096, levels: int = 3) -> DataFrame:
    """(fingerprint, n): a hash of all rows as key-sorted JSON, and their number.

    order: an integer key, unique in use. Rows of a range of ``fan`` keys are hashed in order, then so many ranges, and so on;
    the last of the ``levels`` takes all that is left. So no array is longer than the rows of ``fan`` keys, for keys
    below fan ** levels. Rows of equal keys are in order of their hashes.
    """
    k = F.col(order).cast("long")
    rows = df.select(k.alias("k"), F.sha2(F.to_json(F.struct(*sorted(df.columns))), 256).alias("h"), F.lit(1).cast("long").alias("n"))
    for level in range(levels):
        folded = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "h"))), lambda x: x["h"]), "")
        by = [F.floor(F.col("k") / F.lit(fan)).cast("long").alias("_k")] if level < levels - 1 else []
        rows = rows.groupBy(*by).agg(F.sha2(folded, 256).alias("h"), F.sum("n").alias("n")).withColumnsRenamed({"_k": "k"})
    return rows.select(F.col("h").alias("fingerprint"), F.coalesce("n", F.lit(0)).alias("n"))


def exact_percentiles(df: DataFrame, value: str, ps: dict[str, float], by: list[str] | None = None, ranges: int = 200) -> DataFrame:
    """Exact nearest-rank percentiles (as ``disc``) of the values that aren't null, without a group's values in one task.

    Equal values are counted before anything else. Approximate percentiles cut each group's distinct values into ranges;
    the ranges' counts tell which range holds each rank, and only that range's values are put in order.
    """
    by = by or []
    keys = [*by, "_all"]
    counts = written(df.filter(F.col(value).isNotNull()).withColumn("_all", F.lit(1)).groupBy(*keys, F.col(value).alias("_v")).agg(F.count("*").alias("_n")))
    cuts = counts.groupBy(*keys).agg(F.percentile_approx("_v", [i / ranges for i in range(1, ranges)], 10_000).alias("_cuts"), F.sum("_n").alias("_total"))
    placed = written(counts.join(cuts, keys).withColumn("_range", F.size(F.filter("_cuts", lambda c: c < F.col("_v")))).drop("_cuts"))
    sums = placed.groupBy(*keys, "_total", "_range").agg(F.sum("_n").alias("_here"))
    w = Window.partitionBy(*keys).orderBy("_range")
    sums = sums.withColumn("_before", F.sum("_here").over(w) - F.col("_here")).withColumn("_p", F.explode(F.array(*(F.struct(F.lit(name).alias("name"), F.greatest(F.ceil(F.lit(p) * F.col("_total")), F.lit(1)).alias("rank")) for name, p in ps.items()))))
    wanted = sums.filter("_before < _p.rank AND _p.rank <= _before + _here").select(*keys, "_range", F.col("_p.name").alias("_name"), (F.col("_p.rank") - F.col("_before")).alias("_left"))
    w = Window.partitionBy(*keys, "_name").orderBy("_v")
    found = placed.join(wanted, [*keys, "_range"]).withColumn("_sum", F.sum("_n").over(w)).filter("_sum >= _left")
    return found.groupBy(*keys).agg(*(F.min(F.when(F.col("_name") == name, F.col("_v"))).alias(name) for name in ps)).drop("_all")


def upsert(existing: DataFrame, incoming: DataFrame, keys: list[str]) -> DataFrame:
    """Incoming rows win over existing ones of the same key."""
    return incoming.unionByName(existing.join(incoming.select(*keys), keys, "left_anti"))
