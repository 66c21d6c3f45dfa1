"""Auditing of stored answers: citation markers, blocks, validity, quotes."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# The marker's syntax, line classes, the refusal text.
MARKER = r"\[source_(\d{1,2})\]"
RUN = r"\[[^\]\[\n]{1,48}\]"
FENCE = r"^\s{0,3}(`{3,}|~{3,})"
HEADING = r"^\s{0,3}#{1,6}(\s|$)"
RULE = r"^\s{0,3}(?:\*(\s*\*){2,}|-(\s*-){2,}|_(\s*_){2,})\s*$"
LIST = r"^\s{0,3}(?:[-*+]|\d{1,2}[.)])\s+\S"
TABLE, SEPARATOR = r"^\s*\|", r"^\s*\|?[\s|:-]*\|[\s|:-]*$"
SUBSTANTIVE = ["paragraph", "list-item", "blockquote", "table-row"]
REFUSAL = "I don't know — that isn't covered in your documents."


def normalize_markers(c):
    """``[source_1]`` as ``[source_01]``."""
    return F.regexp_replace(c, r"\[source_(\d)\]", "[source_0$1]")


def markers(c):
    """Ids of the markers in order of appearance, two digits each."""
    return F.transform(F.regexp_extract_all(c, F.lit(MARKER), 1), lambda d: F.concat(F.lit("source_"), F.lpad(d, 2, "0")))


def lines(answers: DataFrame) -> DataFrame:
    """(answer_id, i, line, code) of answers (answer_id, answer); code marks fences and what stands between them."""
    rows = answers.select("answer_id", F.posexplode(F.split(F.trim("answer"), "\n")).alias("i", "line")).withColumn("fence", F.rlike("line", F.lit(FENCE)))
    before = F.coalesce(F.sum(F.col("fence").cast("int")).over(Window.partitionBy("answer_id").orderBy("i").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return rows.withColumn("code", F.col("fence") | (before % 2 == 1))


def blocks(answers: DataFrame) -> DataFrame:
    """(answer_id, block, kind, text): code lines, headings, rules, citation-only lines and table rows alone; list items, quotes and paragraphs with the lines that go on with them."""
    w = Window.partitionBy("answer_id").orderBy("i")
    is_ = lambda p: F.rlike("line", F.lit(p))
    sep = ~F.col("code") & is_(TABLE) & is_(SEPARATOR)
    rows = lines(answers).withColumn("sep", sep).withColumn("next_sep", F.coalesce(F.lead("sep").over(w), F.lit(False)))
    only = F.rlike("line", F.lit(MARKER)) & (F.trim(F.regexp_replace("line", MARKER, "")) == "")
    raw = (
        F.when(F.col("code"), "code").when(~F.rlike("line", F.lit(r"\S")), "blank").when(is_(HEADING), "heading").when(is_(RULE), "rule").when(only, "citation-only")
        .when(is_(TABLE), F.when(F.col("sep") | F.col("next_sep"), "table-header").otherwise("table-row")).when(is_(r"^\s{0,3}>"), "blockquote").when(is_(LIST), "list-item")
        .when(is_(r"^\s+\S"), "indented").otherwise("paragraph")
    )
    rows = rows.withColumn("raw", raw)
    held = F.last(F.when(F.col("raw") != "indented", F.col("raw")), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    joins = (F.col("raw") == "indented") & held.isin("list-item", "blockquote")
    rows = rows.withColumn("joins", joins).withColumn("kind", F.when(F.col("joins"), held).when(F.col("raw") == "indented", "paragraph").otherwise(F.col("raw")))
    same = F.col("kind").isin("paragraph", "blockquote") & (F.lag("kind").over(w) == F.col("kind"))
    rows = rows.withColumn("new", F.when(F.col("joins") | F.coalesce(same, F.lit(False)), 0).otherwise(1)).withColumn("block", F.sum("new").over(w)).filter("kind <> 'blank'")
    joined = rows.groupBy("answer_id", "block", "kind").agg(F.array_sort(F.collect_list(F.struct("i", "line"))).alias("x"))
    return joined.select("answer_id", F.row_number().over(Window.partitionBy("answer_id").orderBy("block")).alias("block"), "kind", F.array_join(F.transform("x", lambda e: e["line"]), "\n").alias("text"))


def substantive(kind, text):
    """Whether a block carries words, beside markers and markup."""
    rest = F.regexp_replace(F.regexp_replace(text, MARKER, ""), r"[*_`~#>|\-+:]", "")
    return kind.isin(SUBSTANTIVE) & F.rlike(rest, F.lit(r"[\p{L}\p{N}]"))


def scan_markers(answers: DataFrame, evidence: DataFrame, known: list[str]) -> DataFrame:
    """(answer_id, reason, citation_id) of each answer's first offence outside code: unknown, outside the evidence, or malformed.

    evidence: answer_id, source_id.
    """
    runs = lines(answers).filter("NOT code").select("answer_id", "i", F.posexplode(F.regexp_extract_all("line", F.lit(f"({RUN})"), 1)).alias("j", "run"))
    strict = F.rlike("run", F.lit(f"^{MARKER}$"))
    long = F.rlike("run", F.lit(r"(?i)^\[\s*source_\s*(\d{3,})\s*\]$"))
    prefixed = F.rlike("run", F.lit(r"(?i)^\[\s*source_[^\]\[\n]{0,40}\]$"))
    rows = runs.withColumn("id", F.when(strict, F.element_at(markers(F.col("run")), 1))).join(evidence.select("answer_id", F.col("source_id").alias("id"), F.lit(True).alias("allowed")), ["answer_id", "id"], "left")
    reason = (
        F.when(strict & F.col("allowed"), None).when(strict, F.when(F.col("id").isin(known), "citation_outside_evidence_set").otherwise("unknown_citation"))
        .when(long, "unknown_citation").when(prefixed, "malformed_citation")
    )
    shown = F.when(strict, F.col("id")).when(long, F.concat(F.lit("source_"), F.regexp_extract("run", r"(\d{3,})", 1))).otherwise(F.col("run"))
    bad = rows.withColumn("reason", reason).filter("reason IS NOT NULL").withColumn("citation_id", shown)
    return bad.groupBy("answer_id").agg(F.min_by("reason", F.struct("i", "j")).alias("reason"), F.min_by("citation_id", F.struct("i", "j")).alias("citation_id"))


def validate(answers: DataFrame, evidence: DataFrame, known: list[str]) -> DataFrame:
    """answer_id, valid, reason, block (of the offence, from 0), citation_id, cited (ids in order), n_cited.

    An offending marker comes first, then no citation at all, then the first substantive block without one.
    """
    clean = answers.withColumn("answer", normalize_markers(F.col("answer")))
    b = blocks(clean).withColumn("real", substantive(F.col("kind"), F.col("text"))).withColumn("cites", F.size(markers(F.col("text"))) > 0)
    b = b.withColumn("n", F.sum(F.col("real").cast("int")).over(Window.partitionBy("answer_id").orderBy("block")) - 1)
    by = b.groupBy("answer_id").agg(F.count_if("real").alias("n_real"), F.min(F.when(F.col("real") & ~F.col("cites"), F.col("n"))).alias("uncited"))
    prose = lines(clean).filter("NOT code").groupBy("answer_id").agg(F.array_sort(F.collect_list(F.struct("i", "line"))).alias("x")).select("answer_id", F.array_distinct(F.flatten(F.transform("x", lambda e: markers(e["line"])))).alias("cited"))
    rows = clean.select("answer_id", F.trim("answer").alias("t")).join(by, "answer_id", "left").join(prose, "answer_id", "left").join(scan_markers(answers, evidence, known), "answer_id", "left")
    none = F.coalesce(F.size("cited"), F.lit(0)) == 0
    empty = F.col("t") == ""
    reason = F.when(empty, "no_citations").when(F.col("reason").isNotNull(), F.col("reason")).when(none & (F.coalesce("n_real", F.lit(0)) > 0), "no_citations").when(F.col("uncited").isNotNull(), "uncited_substantive_block")
    at = F.when(reason == "no_citations", 0).when(reason == "uncited_substantive_block", F.col("uncited"))
    ok = reason.isNull()
    return rows.select("answer_id", ok.alias("valid"), reason.alias("reason"), at.cast("long").alias("block"), F.when(~empty, F.col("citation_id")).alias("citation_id"), F.when(ok, F.coalesce("cited", F.array().cast("array<string>"))).otherwise(F.array().cast("array<string>")).alias("cited"))


def plan_delivery(validated: DataFrame, answers: DataFrame) -> DataFrame:
    """What is shown: the answer with its citations, or the fixed refusal and none."""
    rows = validated.join(answers, "answer_id")
    text = F.when(F.col("valid"), F.trim(normalize_markers(F.col("answer")))).otherwise(REFUSAL)
    return rows.select("answer_id", text.alias("text"), (~F.col("valid")).alias("refused"), F.size("cited").alias("n_citations"))


def check_quotes(answers: DataFrame, evidence: DataFrame) -> DataFrame:
    """(answer_id, quotes, found) of straight double quotes in blocks: found where an evidence text that the block cites holds the quote.

    evidence: answer_id, source_id, snippet.
    """
    b = blocks(answers.withColumn("answer", normalize_markers(F.col("answer"))))
    q = b.select("answer_id", "block", markers(F.col("text")).alias("ids"), F.posexplode(F.regexp_extract_all("text", F.lit('"([^"\\n]+)"'), 1)).alias("j", "quote"))
    cited = q.select("answer_id", "block", "j", "quote", F.explode_outer("ids").alias("source_id")).join(evidence, ["answer_id", "source_id"], "left")
    hit = cited.groupBy("answer_id", "block", "j").agg(F.bool_or(F.coalesce(F.contains("snippet", F.col("quote")), F.lit(False))).alias("hit"))
    return hit.groupBy("answer_id").agg(F.count("*").alias("quotes"), F.count_if("hit").alias("found"))


def strip_citations(c, known: list[str]):
    """(text, valid ids, invalid ids): unknown markers removed, the ids sorted."""
    ids = F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit(r"\[\s*(source_\d{1,3})\s*\]"), 1))
    good, keep = F.array(*map(F.lit, known)), "|".join(k.removeprefix("source_") for k in known)
    text = F.regexp_replace(F.regexp_replace(c, r"(?i)\[\s*source_(\d{1,3})\s*\]", "[source_$1]"), rf"\[source_(?!(?:{keep})\])\d{{1,3}}\]", "")
    return F.trim(F.regexp_replace(text, r"[ \t]{2,}", " ")), F.array_sort(F.array_intersect(ids, good)), F.array_sort(F.array_except(ids, good))


def emission_chunks(c, size: int = 240):
    """The text in pieces of whole words, about ``size`` characters each; joined they are the text again."""
    @F.pandas_udf("array<string>")
    def run(texts: pd.Series) -> pd.Series:
        import re

        def cut(text: str | None) -> list[str]:
            out, now = [], ""
            for word in re.split(r"(\s+)", text or ""):
                if now and len(now) + len(word) > size:
                    out.append(now)
                    now = ""
                now += word
                if len(now) >= size:
                    out.append(now)
                    now = ""
            return [*out, now] if now else out

        return texts.map(cut)

    return run(c)
