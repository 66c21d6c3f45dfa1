"""Retrieval and answer metrics over ranked runs and gold labels, and the checks on a gold set."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.functions.text import normal_question

#: Splits that a gold set may have.
SPLITS = 100
#: Bits of a digest of a question's words.
DIGEST = 512


def judged(run: DataFrame, relevant: DataFrame) -> DataFrame:
    """The run (query_id, chunk_id, position) with a flag for relevant rows."""
    return run.join(relevant.select("query_id", "chunk_id", F.lit(1).alias("_r")), ["query_id", "chunk_id"], "left").select("query_id", "chunk_id", "position", F.coalesce("_r", F.lit(0)).alias("relevant"))


def ranking_metrics(run: DataFrame, relevant: DataFrame, queries: DataFrame, k: int, totals: DataFrame | None = None) -> DataFrame:
    """Per query: recall, precision (by what was returned, and by k), reciprocal rank and nDCG at k; no labels count as recall 1.

    relevant: pairs (query_id, chunk_id); with totals (query_id, n_relevant) those of the run are enough.
    """
    n = relevant.groupBy("query_id").agg(F.count("*").alias("n_relevant")) if totals is None else totals
    hit = (F.col("relevant") == 1) & (F.col("position") <= k)
    by = judged(run, relevant).groupBy("query_id").agg(
        F.count_if(hit).alias("hits"), F.count_if(F.col("position") <= k).alias("returned"), F.min(F.when(F.col("relevant") == 1, F.col("position"))).alias("first_rank"),
        F.sum(F.when(hit, 1 / F.log2(F.col("position") + 1)).otherwise(0.0)).alias("dcg"),
    )
    rows = queries.select("query_id").join(n, "query_id", "left").join(by, "query_id", "left").fillna(0, ["n_relevant", "hits", "returned", "dcg"])
    ideal = F.aggregate(F.sequence(F.lit(1), F.greatest(F.least(F.col("n_relevant"), F.lit(k)), F.lit(1)).cast("int")), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + 1))
    return rows.select(
        "query_id", F.round(F.when(F.col("n_relevant") == 0, 1.0).otherwise(F.col("hits") / F.col("n_relevant")), 6).alias("recall"),
        F.round(F.when(F.col("returned") == 0, 0.0).otherwise(F.col("hits") / F.col("returned")), 6).alias("precision_returned"), F.round(F.col("hits") / k, 6).alias("precision_k"),
        F.round(F.coalesce(1 / F.col("first_rank"), F.lit(0.0)), 6).alias("reciprocal_rank"), F.round(F.when(F.col("n_relevant") == 0, 0.0).otherwise(F.col("dcg") / ideal), 6).alias("ndcg"),
    )


def refusal_metrics(cases: DataFrame) -> DataFrame:
    """Answer rate, refusal accuracy and false refusal rate of (refused, expect_refusal); 1, 1 and 0 where there is nothing to count."""
    share = lambda n, d, empty: F.round(F.when(d == 0, F.lit(empty)).otherwise(n / d), 6)
    r, e = F.col("refused"), F.col("expect_refusal")
    return cases.agg(share(F.count_if(~r), F.count("*"), 1.0).alias("answer_rate"), share(F.count_if(r & e), F.count_if(e), 1.0).alias("refusal_accuracy"), share(F.count_if(r & ~e), F.count_if(~e), 0.0).alias("false_refusal_rate"))


def span_coverage(gold: DataFrame, evidence: DataFrame) -> DataFrame:
    """Per key: different gold spans, and how many of them lie whole within the union of the evidence spans.

    The union's spans are disjoint, so a gold span lies in the last one that begins no later: one sweep over both by their starts, without pairs.
    """
    from quern.operators.rollups import merge_spans

    union = merge_spans(evidence.select("key", "start", "end"), ["key"]).select("key", "start", F.lit(None).cast(gold.schema["end"].dataType).alias("end"), F.col("end").alias("reach"))
    both = union.unionByName(gold.select("key", "start", "end", F.lit(None).cast(union.schema["reach"].dataType).alias("reach")).distinct())
    reach = F.max("reach").over(Window.partitionBy("key").orderBy("start").rangeBetween(Window.unboundedPreceding, 0))
    swept = both.withColumn("covered", F.coalesce(reach >= F.col("end"), F.lit(False))).filter("reach IS NULL")
    return swept.groupBy("key").agg(F.count("*").alias("spans"), F.count_if("covered").alias("covered"))


def readiness_issues(cases: DataFrame, categories: dict[str, int], splits: dict[str, int], total: int = 60) -> DataFrame:
    """Unmet conditions of a set of cases (category, split): its size, categories below their least number, splits that miss theirs. A category or split without any case counts as zero."""
    spark = cases.sparkSession

    def held(targets: dict[str, int], by: str) -> DataFrame:
        wanted = spark.createDataFrame(list(targets.items()), f"{by} string, target int")
        return wanted.join(cases.groupBy(by).agg(F.count("*").alias("n")), by, "left").fillna(0, ["n"])

    size = cases.agg(F.count("*").alias("n")).filter(F.col("n") != total).select(F.lit(f"REQUIRES_{total}_REVIEWED_QUESTIONS").alias("issue"))
    few = held(categories, "category").filter("n < target").select(F.concat(F.lit("INSUFFICIENT_CATEGORY:"), "category").alias("issue"))
    kind = F.when(F.col("n") > F.col("target"), "EXCESS").otherwise("INSUFFICIENT")
    off = held(splits, "split").filter("n <> target").select(F.concat(kind, F.lit("_SPLIT:"), "split", F.lit(":"), F.col("target").cast("string")).alias("issue"))
    return size.unionByName(few).unionByName(off)


def threshold_gate(metrics: DataFrame, thresholds: list[tuple[str, str, float]]) -> DataFrame:
    """Violations of floors (min) and ceilings (max) by named metrics (metric, value)."""
    t = metrics.sparkSession.createDataFrame(thresholds, "metric string, bound string, threshold double")
    return metrics.join(F.broadcast(t), "metric").filter(((F.col("bound") == "min") & (F.col("value") < F.col("threshold"))) | ((F.col("bound") == "max") & (F.col("value") > F.col("threshold"))))


def split_leakage(questions: DataFrame, least: float = 0.8) -> DataFrame:
    """Pairs of questions (id, split, text) of different splits whose word sets have a Jaccard similarity of ``least`` or more.

    Candidates come from a prefix filter: of a question's words, the rarest first, one of the first
    n - ceil(least * n) + 1 is shared by any partner that is similar enough, so frequent words
    make no pairs. Where they are made, in the join, pairs are left that can't be similar enough by their sizes, by the words that come after the shared one, or by
    DIGEST bits, of which each word flips one: no more can differ than words do. So few pairs are dealt, and words are looked up for these alone.
    """
    words = questions.select("id", "split", F.array_distinct(F.split(normal_question("text"), " ")).alias("w")).filter("size(w) > 0 and w[0] <> ''")
    each = words.select("id", "split", F.size("w").alias("n"), F.explode(F.transform("w", lambda t: F.xxhash64(t))).alias("t"))
    freq = each.groupBy("t").agg(F.count("*").alias("f"))
    bit = F.pmod(F.shiftright("t", 16), F.lit(DIGEST)).cast("int")
    flips = [F.coalesce(F.bit_xor(F.when((bit / 64).cast("int") == k, F.call_function("shiftleft", F.lit(1).cast("long"), bit % 64))), F.lit(0).cast("long")).alias(f"d{k}") for k in range(DIGEST // 64)]
    ordered = each.join(freq, "t").groupBy("id", "split", "n").agg(F.array_sort(F.collect_list(F.struct("f", "t"))).alias("o"), *flips)
    prefix = ordered.select("id", "split", "n", *(f"d{k}" for k in range(DIGEST // 64)), F.posexplode(F.expr(f"slice(o, 1, CAST(size(o) - ceil({least} * size(o)) + 1 AS INT))")).alias("p", "x")).withColumn("t", F.col("x.t")).drop("x")
    a, b = (prefix.select("t", *(F.col(c).alias(f"{c}_{side}") for c in prefix.columns if c != "t")) for side in "ab")
    n, slack = F.col("n_a") + F.col("n_b"), 1e-6
    left = F.least(F.col("n_a") - F.col("p_a"), F.col("n_b") - F.col("p_b"))  # words in common, if this one is the first
    differ = reduce(Column.__add__, (F.bit_count(F.col(f"d{k}_a").bitwiseXOR(F.col(f"d{k}_b"))) for k in range(DIGEST // 64)))
    can = (F.col("split_a") < F.col("split_b")) & (F.least("n_a", "n_b") >= least * F.greatest("n_a", "n_b") - slack) & (left * (1 + least) >= least * n - slack) & (differ * (1 + least) <= n * (1 - least) + slack)
    pairs = a.join(b, "t").filter(can).select(F.col("id_a").alias("a"), F.col("id_b").alias("b")).distinct()
    w = lambda n: words.select(F.col("id").alias(n), F.col("w").alias(f"w{n}"))
    scored = pairs.join(w("a"), "a").join(w("b"), "b").withColumn("similarity", F.round(F.size(F.array_intersect("wa", "wb")) / F.size(F.array_union("wa", "wb")), 6))
    return scored.filter(F.col("similarity") >= least).select("a", "b", "similarity")


def leakage_checks(questions: DataFrame) -> DataFrame:
    """(violation, key, questions) of (id, split, text, leakage_group, document_id, page, start, end), one row per question and span.

    DUPLICATE_QUESTION_TEXT: questions of one normal text, by the smallest of their ids. CROSS_SPLIT_LEAKAGE_GROUP: a group with
    questions of several splits. CROSS_SPLIT_SUPPORT_OVERLAP: a document with spans of a page that overlap across
    splits, and how many questions have such a span. Each is a count by key; a span looks at the farthest end and the nearest
    start of other splits' spans in order of place, not at each of them.
    """
    each = questions.select("id", "split", "leakage_group", normal_question("text").alias("n")).distinct()
    same = each.groupBy("n").agg(F.min("id").cast("string").alias("key"), F.count_distinct("id").alias("questions")).filter("questions > 1").select(F.lit("DUPLICATE_QUESTION_TEXT").alias("violation"), "key", "questions")
    group = each.groupBy(F.col("leakage_group").alias("key")).agg(F.count_distinct("id").alias("questions"), (F.min("split") < F.max("split")).alias("both")).filter("both").select(F.lit("CROSS_SPLIT_LEAKAGE_GROUP").alias("violation"), "key", "questions")
    spans = questions.filter("start < end").select("id", "split", "document_id", "page", "start", "end")
    splits = [r.split for r in questions.select("split").distinct().limit(SPLITS + 1).collect()]
    if len(splits) > SPLITS:
        raise ValueError(f"more than {SPLITS} splits")
    before, after = (Window.partitionBy("document_id", "page").orderBy(*o) for o in (("start", "end", "id"), (F.col("start").desc(), F.col("end").desc(), F.col("id").desc())))
    hits = F.lit(False)
    for s in splits:
        other = F.col("split") != s
        far = F.max(F.when(F.col("split") == s, F.col("end"))).over(before.rowsBetween(Window.unboundedPreceding, -1))
        near = F.min(F.when(F.col("split") == s, F.col("start"))).over(after.rowsBetween(Window.unboundedPreceding, -1))
        hits = hits | (other & (F.coalesce(far > F.col("start"), F.lit(False)) | F.coalesce(near < F.col("end"), F.lit(False))))
    over = spans.withColumn("hit", hits).filter("hit").groupBy(F.col("document_id").cast("string").alias("key")).agg(F.count_distinct("id").alias("questions"))
    return same.unionByName(group).unionByName(over.select(F.lit("CROSS_SPLIT_SUPPORT_OVERLAP").alias("violation"), "key", "questions"))
