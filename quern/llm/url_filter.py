"""URL filter by path-template trees, with built-in functions only.

Pages are first grouped by host and generalised path: numbers, long hexadecimal runs and digit runs inside
segments become placeholders. The groups of a host form a tree of segments. Level by level, from
the top, a node's children without labelled pages become one wildcard branch, and a child whose rate of
bad labelled pages does not differ from its siblings' (two-proportion z test) joins it too; a child that
differs keeps its name, however few or many siblings it has. Levels go on until no segments are left. A node below which
no page is labelled is closed: all its further levels follow from one count of segments by place, so jobs are made for the levels of labelled pages only, not for the deepest url.
A template is rejected when its smoothed purity, the share of good labelled pages drawn toward the share
of all, is below the threshold. Explicit rules come first: the longest that fits decides.

Counts are made per group before anything is joined, so a host with most of the pages is a few
rows; pages meet their template in one join, whose large keys the engine may split.
"""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.common import LOWER, UPPER, join_counted, written

#: Level of the tree's wildcards' test (two-sided, one in twenty), weight of the prior purity, purity below which a template is rejected.
Z, WEIGHT, PURITY = 1.96, 10.0, 0.5
RULES = [("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/")]
#: Patterns that Java and RE2 read alike, with what replaces them.
PLACEHOLDERS = [(r"^[0-9]+(\.[A-Za-z0-9]{1,5})?$", "{n}", 1), (r"^[0-9a-fA-F-]{8,}(\.[A-Za-z0-9]{1,5})?$", "{h}", 1), (r"[0-9]{3,}", "{n}", 0)]


def parts(url):
    """(host, path) of a url column; empty for null or without ://."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    return F.translate(F.regexp_extract(rest, "^([^/?#]*)", 1), UPPER, LOWER), F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def rule_of(host, path, rules: list[tuple[str, str]]):
    """The longest rule that fits, as struct(verdict, rule); null if none."""
    chosen = None
    for verdict, rule in sorted(rules, key=lambda r: (-len(r[1]), r[1])):
        h, _, p = rule.partition("/")
        fits = ((host == h) | F.endswith(host, F.lit("." + h))) & F.startswith(path, F.lit("/" + p))
        value = F.struct(F.lit(verdict).alias("verdict"), F.lit(rule).alias("rule"))
        chosen = F.when(fits, value) if chosen is None else chosen.when(fits, value)
    return chosen


def _general(segment):
    out = segment
    for pattern, to, group in PLACEHOLDERS:
        out = F.when(~F.contains(out, F.lit("{")), F.regexp_replace(out, pattern, to.replace("{", r"\{").replace("}", r"\}") + (f"${group}" if group else ""))).otherwise(out)
    return out


def _wildcards(closed: DataFrame) -> DataFrame:
    """Groups of nodes without labelled pages, with their whole template, all levels at once.

    There, all children of a node with several join, so a level is one node: its name is its only segment, or the wildcard. ``at`` is the first such level.
    """
    rest = F.slice("segments", F.col("at"), F.size("segments"))
    level = closed.select("host", "template", "at", F.posexplode(rest).alias("i", "s")).groupBy("host", "template", "at", "i").agg(F.min("s").alias("least"), F.max("s").alias("most"))
    level = level.select("host", "template", "at", F.struct("i", F.when(F.col("least") == F.col("most"), F.col("least")).otherwise("*").alias("name")).alias("x"))
    names = level.groupBy("host", "template", "at").agg(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["name"]).alias("names"))
    tail = F.array_join(F.slice("names", F.lit(1), F.size("segments") - F.col("at") + 1), "/")
    return closed.join(names, ["host", "template", "at"]).select("host", "segments", "n", "labelled", "bad", F.concat("template", F.lit("/"), tail).alias("template"))


def filter_urls(pages: DataFrame, labels: DataFrame, rules: list[tuple[str, str]] = RULES, id_col: str = "page_id", url_col: str = "url", depth: int | None = None) -> DataFrame:
    """One row per page: id_col, host, path, rule, verdict, template, n_labelled, purity.

    A page's label is that of the document its path's last number names; it is bad if of
    low quality or toxic. A null or malformed url has empty host and path, no segments and the template ``/``. Pages
    without labels have the purity of all; with no labels at all purity is 1 and nothing is rejected. Repeated rows get equal
    results; an empty table gives an empty result. Other columns are not read. By default no level is
    left out; with a ``depth`` the segments from that one on are one ``**`` in longer paths.
    """
    host, path = parts(F.col(url_col))
    rows = pages.select(F.col(id_col), host.alias("host"), path.alias("path"), F.regexp_extract(path, "([0-9]{1,18})[^0-9]*$", 1).try_cast("long").alias("doc"))
    segments = F.transform(F.filter(F.split("path", "/"), lambda s: s != ""), _general)
    rows = rows.withColumn("all", segments)
    rows = rows.withColumn("segments", F.col("all") if depth is None else F.when(F.size("all") > depth, F.concat(F.slice("all", 1, depth - 1), F.array(F.lit("**")))).otherwise(F.col("all"))).drop("all")
    marks = labels.filter("doc_id IS NOT NULL").groupBy(F.col("doc_id").alias("doc")).agg(F.max(F.when((F.col("quality") == 0) | (F.col("toxic") == 1), 1).otherwise(0)).alias("bad"))
    counted = rows.groupBy("host", "segments", "doc").agg(F.count("*").alias("n")).join(marks, "doc", "left")
    groups = written(counted.groupBy("host", "segments").agg(F.sum("n").alias("n"), F.sum(F.when(F.col("bad").isNotNull(), F.col("n")).otherwise(0)).alias("labelled"), F.sum(F.coalesce(F.col("bad") * F.col("n"), F.lit(0))).alias("bad")))

    tree, done, closed, k = groups.select("*", F.lit("").alias("template"), (F.size("segments") == 0).alias("ended"), F.lit(False).alias("closed")), [], [], 0
    while True:
        done.append(tree.filter("ended AND NOT closed").drop("closed"))
        closed.append(tree.filter("closed").select("host", "segments", "n", "labelled", "bad", "template", F.lit(k).alias("at")))
        tree = tree.filter("NOT ended AND NOT closed").drop("ended", "closed")
        if tree.isEmpty():
            break
        k += 1
        tree = tree.withColumn("child", F.element_at("segments", k))
        child = tree.groupBy("host", "template", "child").agg(F.count("*").alias("groups"), *(F.sum(c).alias(c) for c in ("n", "labelled", "bad")))
        node = child.groupBy("host", "template").agg(F.count("*").alias("children"), *(F.sum(c).alias(f"all_{c}") for c in ("groups", "labelled", "bad")))
        a, b, m, o = (F.col(c).cast("double") for c in ("bad", "all_bad", "labelled", "all_labelled"))
        pooled = (b + 0.5) / (o + 1)
        z = F.abs((a + 0.5) / (m + 1) - (b - a + 0.5) / (o - m + 1)) / F.sqrt(pooled * (1 - pooled) * (1 / (m + 1) + 1 / (o - m + 1)))
        joins = (F.col("children") > 1) & ((F.col("labelled") == 0) | (z <= Z))
        name = child.join(node, ["host", "template"]).select("host", "template", "child", F.when(joins, F.lit("*")).otherwise(F.col("child")).alias("name"), (F.col("all_groups") == 1).alias("alone"), (F.col("all_labelled") == 0).alias("closed"))
        # a group alone in its node has no siblings further down and keeps all its names
        names = F.when(F.col("closed"), "").when(F.col("alone"), F.concat(F.lit("/"), F.array_join(F.slice("segments", k, F.size("segments")), "/"))).otherwise(F.concat(F.lit("/"), "name"))
        ended = ~F.col("closed") & (F.col("alone") | (F.size("segments") == k))
        tree = tree.join(name, ["host", "template", "child"]).select("host", "segments", "n", "labelled", "bad", F.concat("template", names).alias("template"), ended.alias("ended"), "closed")
        tree = written(tree)  # each level reads its tree twice
    tree = functools.reduce(DataFrame.unionAll, [*(d.drop("ended") for d in done), _wildcards(functools.reduce(DataFrame.unionAll, closed))])
    total = tree.agg(F.sum("labelled").alias("labelled"), F.sum("bad").alias("bad")).first()
    prior = 1 - (total.bad / total.labelled) if total.labelled else 1.0
    purity = tree.groupBy("host", "template").agg(F.sum("labelled").alias("n_labelled"), F.sum("bad").alias("bad")).withColumn("purity", F.round((F.col("n_labelled") - F.col("bad") + WEIGHT * prior) / (F.col("n_labelled") + WEIGHT), 6))
    judged = written(tree.select("host", "segments", "n", "template").join(purity, ["host", "template"]))
    rule = rule_of(F.col("host"), F.col("path"), rules)
    return join_counted(rows, judged, ["host", "segments"], "n").select(
        id_col, "host", "path", rule["rule"].alias("rule"), F.coalesce(rule["verdict"], F.when(F.col("purity") < PURITY, "block").otherwise("allow")).alias("verdict"),
        F.when(F.col("template") == "", "/").otherwise(F.col("template")).alias("template"), "n_labelled", "purity",
    )


def filter_urls_sql(rules: list[tuple[str, str]] = RULES, levels: int = 16) -> str:
    """The same in DuckDB SQL over ``pages`` and ``labels``, for trees that have ended after so many levels.

    Paths of more segments whose group is not yet alone by then make the SQL fail rather than differ.
    """
    general = "s"
    for pattern, to, group in PLACEHOLDERS:
        general = f"CASE WHEN contains({general}, '{{') THEN {general} ELSE regexp_replace({general}, '{pattern}', '{to}{chr(92) + str(group) if group else ''}', 'g') END"
    cases = lambda k: " ".join(f"WHEN (host = '{r[1].partition('/')[0]}' OR suffix(host, '.{r[1].partition('/')[0]}')) AND prefix(path, '/{r[1].partition('/')[2]}') THEN '{r[k]}'" for r in sorted(rules, key=lambda r: (-len(r[1]), r[1])))
    steps = []
    for k in range(1, levels + 1):
        steps.append(f"""
c{k} AS MATERIALIZED (SELECT host, template, segments[{k}] AS child, count(*) AS m, sum(n) AS n, sum(labelled) AS labelled, sum(bad) AS bad FROM tree{k - 1} WHERE NOT ended GROUP BY ALL),
n{k} AS (SELECT *, count(*) OVER w AS children, sum(m) OVER w AS all_m, sum(labelled) OVER w AS o, sum(bad) OVER w AS b FROM c{k} WINDOW w AS (PARTITION BY host, template)),
z{k} AS (SELECT *, (b + 0.5::DOUBLE) / (o + 1) AS p FROM n{k}),
m{k} AS MATERIALIZED (SELECT host, template, child, all_m = 1 AS alone, CASE WHEN children > 1 AND (labelled = 0 OR
  abs((bad + 0.5::DOUBLE) / (labelled + 1) - (b - bad + 0.5::DOUBLE) / (o - labelled + 1)) / sqrt(p * (1 - p) * (1.0::DOUBLE / (labelled + 1) + 1.0::DOUBLE / (o - labelled + 1))) <= {Z}) THEN '*' ELSE child END AS name FROM z{k}),
tree{k} AS MATERIALIZED (SELECT * FROM tree{k - 1} WHERE ended UNION ALL
  SELECT l.host, l.segments, l.n, l.labelled, l.bad, l.template || '/' || CASE WHEN alone THEN array_to_string(l.segments[{k}:], '/') ELSE m.name END, alone OR len(l.segments) = {k}
  FROM tree{k - 1} l JOIN m{k} m ON NOT l.ended AND l.host = m.host AND l.template = m.template AND l.segments[{k}] = m.child)""")
    return f"""
WITH u AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
hp AS (SELECT page_id, translate(regexp_extract(coalesce(rest, ''), '^([^/?#]*)', 1), '{UPPER}', '{LOWER}') AS host, regexp_extract(coalesce(rest, ''), '^[^/?#]*([^?#]*)', 1) AS path FROM u),
r AS MATERIALIZED (SELECT *, try_cast(nullif(regexp_extract(path, '([0-9]{{1,18}})[^0-9]*$', 1), '') AS BIGINT) AS doc, list_transform(list_filter(string_split(path, '/'), lambda s: s <> ''), lambda s: {general}) AS segments FROM hp),
marks AS (SELECT doc_id AS doc, max(CASE WHEN quality = 0 OR toxic = 1 THEN 1 ELSE 0 END) AS bad FROM labels GROUP BY 1),
tree0 AS MATERIALIZED (SELECT host, segments, count(*) AS n, count(m.bad) AS labelled, coalesce(sum(m.bad), 0) AS bad, '' AS template, len(segments) = 0 AS ended FROM r LEFT JOIN marks m USING (doc) GROUP BY host, segments),
{','.join(steps)},
tree AS (SELECT * REPLACE (CASE WHEN ended THEN template ELSE error('more levels') END AS template) FROM tree{levels}),
total AS (SELECT CASE WHEN sum(labelled) > 0 THEN 1 - sum(bad)::DOUBLE / sum(labelled) ELSE 1 END AS prior FROM tree),
purity AS (SELECT host, template, sum(labelled)::BIGINT AS n_labelled, round((sum(labelled) - sum(bad) + {WEIGHT}::DOUBLE * any_value(prior)) / (sum(labelled) + {WEIGHT}), 6) AS purity FROM tree, total GROUP BY host, template)
SELECT r.page_id, r.host, r.path, rule, coalesce(ruled, CASE WHEN purity < {PURITY} THEN 'block' ELSE 'allow' END) AS verdict,
  CASE WHEN t.template = '' THEN '/' ELSE t.template END AS template, p.n_labelled, p.purity
FROM (SELECT *, CASE {cases(1)} END AS rule, CASE {cases(0)} END AS ruled FROM r) r JOIN tree t ON r.host = t.host AND r.segments = t.segments JOIN purity p ON p.host = t.host AND p.template = t.template"""
