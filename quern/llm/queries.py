"""The registered queries of the operators, each over its whole table, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm import bpe_tree, decontam, exact_dedup, hard_negatives, license_rules, piece_bpe, quality, simhash, substring_dedup, token_files, toxicity, url_filter, whitening
from quern.llm.common import LOWER, UPPER


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary(name: str) -> str:
    """The path of a public tokenizer's file; a parameter of the operators."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_license(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_rules.scan(table(spark, sf_dir, "documents"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "n_near_items")


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.token_files(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"), end_id=2)


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"))


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.filter_urls(table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels"))


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_tree.encode_documents(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.remove_repeats(table(spark, sf_dir, "documents"))


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.components_long(whitening.whiten(table(spark, sf_dir, "embeddings")))


def op12_piece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_bpe.encode_documents(table(spark, sf_dir, "documents"), vocabulary("piece_bpe_32k.model"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    return hard_negatives.mine(rows, F.col("vec_id") % 100 == 0)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_quality, op2_license, op3_toxicity, op4_decontam, op5_token_files, op6_simhash, op7_exact_dedup, op8_url_filter, op9_bpe, op10_substring_dedup, op11_whitening, op12_piece, op13_hard_negatives)}


_WORDS = f"regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"

SQL = {
    "op4_decontam": f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents), b AS (SELECT item_id::VARCHAR AS item, {_WORDS} AS w FROM benchmark),
bw AS (SELECT DISTINCT item, least(len(w), 13) AS n, array_to_string(w[k:k + least(len(w), 13) - 1], ' ') AS x FROM (SELECT *, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS k FROM b WHERE len(w) > 0)),
dw AS (SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS x FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM bw) WHERE len(w) >= n)),
o AS (SELECT doc_id, i, n, item FROM dw JOIN bw USING (n, x)),
h AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM o) GROUP BY 1),
m AS (SELECT doc_id, list_sort(list(DISTINCT item)) AS items FROM o GROUP BY 1),
lw AS (SELECT DISTINCT item, w[k:k + least(len(w), 13) - 1] AS t FROM (SELECT *, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS k FROM b WHERE len(w) > 0)),
wn AS (SELECT row_number() OVER (ORDER BY t) AS wid, t FROM (SELECT DISTINCT t FROM lw)),
pw AS (SELECT doc_id, unnest(w) AS x, generate_subscripts(w, 1) AS p FROM d), fr AS (SELECT x, count(*) AS f FROM pw GROUP BY 1),
wo AS (SELECT wid, unnest(t) AS x, generate_subscripts(t, 1) AS o FROM wn),
ra AS (SELECT wid, arg_min(x, f) AS x, arg_min(o, f) AS o FROM (SELECT wid, o, wo.x, coalesce(f, 0) AS f FROM wo LEFT JOIN fr ON fr.x = wo.x) GROUP BY 1),
ca AS (SELECT DISTINCT doc_id, wid, p - o + e AS s FROM ra JOIN pw ON pw.x = ra.x, (SELECT unnest([-2, -1, 0, 1, 2]) AS e)),
nr AS (SELECT DISTINCT doc_id, wid FROM ca JOIN d USING (doc_id) JOIN wn USING (wid) WHERE list_bool_and(list_transform(range(1, len(t) + 1), lambda o: list_contains(w[greatest(1, s + o - 2):greatest(0, s + o + 2)], t[o])))),
ni AS (SELECT doc_id, count(DISTINCT item) AS n_near_items FROM nr JOIN wn USING (wid) JOIN lw ON lw.t = wn.t GROUP BY 1)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(len(items), 0)::BIGINT AS n_items, sha256(coalesce(array_to_string(items, ','), '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * n_hit >= len(w) AS contaminated, coalesce(n_near_items, 0) AS n_near_items
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN m USING (doc_id) LEFT JOIN ni USING (doc_id)""",
    "op7_exact_dedup": f"""
WITH d AS (SELECT doc_id, sha256(translate(coalesce(text, ''), '{UPPER}', '{LOWER}')) AS text_sha256 FROM documents),
g AS (SELECT text_sha256, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY 1)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM d JOIN g USING (text_sha256)""",
    "op13_hard_negatives": """
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q
    FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS same, list_inner_product(a.q, c.q)::BIGINT AS score FROM v a JOIN v c ON a.vec_id <> c.vec_id WHERE a.vec_id % 100 = 0),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT anchor_id, positive_id, (row_number() OVER w)::INTEGER AS rank, vec_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT same AND 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score
WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) QUALIFY row_number() OVER w <= 5""",
    "op10_substring_dedup": """
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
p AS (SELECT doc_id, w, unnest(range(1, len(w) - 33)) AS i FROM d WHERE len(w) >= 35),
x AS (SELECT doc_id, i, count(*) OVER (PARTITION BY sha256(array_to_string(w[i:i + 34], ' '))) AS c FROM p),
h AS (SELECT DISTINCT doc_id, unnest(range(i, i + 35)) AS k FROM x WHERE c > 1),
l AS (SELECT doc_id, list(k) AS ks FROM h GROUP BY 1),
k AS (SELECT d.doc_id, w, coalesce(ks, []) AS ks FROM d LEFT JOIN l USING (doc_id)),
f AS (SELECT k.doc_id, string_agg(w[i], ' ' ORDER BY i) AS t FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM k) k ANTI JOIN h ON k.doc_id = h.doc_id AND k.i = h.k GROUP BY 1)
SELECT k.doc_id, len(w)::BIGINT AS n_words, len(ks)::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM k LEFT JOIN f USING (doc_id)""",
}


def oracle_sql() -> dict[str, str]:
    return SQL | {"op2_license": license_rules.scan_sql(), "op8_url_filter": url_filter.filter_urls_sql()}


