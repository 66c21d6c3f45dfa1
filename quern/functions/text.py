"""Text expressions: terms, normal forms, names and small formats. Each takes and returns a column."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# The two stop lists of the term functions.
CONTENT_STOP = "the a an and or of to in on for is are was were be been do does did how what why when which who we you i this that it as at by with from our their its can should would will".split()
TERM_STOP = "the a an of in on at to for and or is are was were what which how does do did with that about say says it".split()
# Formats with their media types and extensions.
FORMATS = {
    "pdf": (["application/pdf", "application/x-pdf"], ["pdf"]),
    "docx": (["application/vnd.openxmlformats-officedocument.wordprocessingml.document"], ["docx"]),
    "txt": (["text/plain"], ["txt"]),
    "md": (["text/markdown", "text/x-markdown"], ["md", "markdown"]),
    "csv": (["text/csv", "application/csv"], ["csv"]),
    "html": (["text/html", "application/xhtml+xml"], ["html", "htm"]),
    "xlsx": (["application/vnd.openxmlformats-officedocument.spreadsheetml.sheet"], ["xlsx"]),
    "pptx": (["application/vnd.openxmlformats-officedocument.presentationml.presentation"], ["pptx"]),
    "image": (["image/png", "image/jpeg", "image/webp"], ["png", "jpg", "jpeg", "webp"]),
}
EXTENSIONS = [e for _, es in FORMATS.values() for e in es]
DEFAULT_TITLE = "New conversation"


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with ``value`` computed once, where ``use`` names it within a lambda (which would compute it again for each element)."""
    return F.transform(F.array(value), lambda x: use(x))[0]


def strip(c) -> Column:
    """Without white space of any script at both ends."""
    return F.regexp_replace(_c(c), r"(?U)^\s+|\s+$", "")


def _kept(c, keep: str, stop: list[str]) -> Column:
    words = F.split(F.regexp_replace(F.lower(_c(c)), f"[^a-z0-9\\s{keep}]", " "), r"\s+")
    return F.filter(words, lambda w: (F.length(w) > 2) & ~w.isin(stop))


def content_terms(c) -> Column:
    """Words of more than two of [a-z0-9.-] that are no stop words, in order, with repeats."""
    return _kept(c, ".-", CONTENT_STOP)


def terms(c) -> Column:
    """As ``content_terms``, without dots and with the shorter stop list."""
    return _kept(c, "-", TERM_STOP)


def overlap_score(question, content) -> Column:
    """Share of the question's terms that the content has; 0 without terms."""

    def share(x: Column) -> Column:
        return F.when(F.size(x["q"]) == 0, 0.0).otherwise(F.size(F.filter(x["q"], lambda t: F.array_contains(x["both"], t))) / F.size(x["q"]))

    words = F.struct(terms(question).alias("q"), terms(content).alias("c"))
    return _once(words, lambda w: _once(F.struct(w["q"].alias("q"), F.array_intersect(w["q"], w["c"]).alias("both")), share))


def coverage(question, content) -> Column:
    """Share of the question's distinct content terms that the content has; 0 without terms."""
    q = F.array_distinct(content_terms(question))
    return F.when(F.size(q) == 0, 0.0).otherwise(F.size(F.array_intersect(q, content_terms(content))) / F.size(q))


def nfkc(c) -> Column:
    """Compatibility form NFKC, which no built-in function gives."""

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: t if t is None or t.isascii() else unicodedata.normalize("NFKC", t))

    return run(_c(c))


def normal_question(c) -> Column:
    """In compatibility form and lower case, with one space for whatever is no letter or digit."""
    return F.trim(F.regexp_replace(F.lower(nfkc(c)), r"[^\p{L}\p{N}]+", " "))


def normal_answer(c) -> Column:
    """Without citation markers, white space collapsed, lower case."""
    return F.lower(F.trim(F.regexp_replace(F.regexp_replace(_c(c), r"\[source_\d+\]", ""), r"\s+", " ")))


def usable(c) -> Column:
    """Has a letter or digit of any script."""
    return F.rlike(_c(c), F.lit(r"[\p{L}\p{N}]"))


def shingles3(c) -> Column:
    """Distinct lower-case word 3-grams; a shorter text is one shingle."""

    def grams(words: Column) -> Column:
        return F.when(F.size(words) > 2, F.transform(F.sequence(F.lit(1), F.size(words) - 2), lambda i: F.array_join(F.slice(words, i, 3), " "))).otherwise(F.array(F.array_join(words, " ")))

    return F.array_distinct(_once(F.split(F.trim(F.regexp_replace(F.lower(_c(c)), r"\s+", " ")), " "), grams))


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays without repeats."""
    share = _once(F.struct(F.size(a).alias("a"), F.size(b).alias("b"), F.size(F.array_intersect(a, b)).alias("both")), lambda n: n["both"] / (n["a"] + n["b"] - n["both"]))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(share)


def estimate_tokens(c) -> Column:
    return F.ceil(F.length(_c(c)) / 4)


def extension_of(c) -> Column:
    return F.lower(F.element_at(F.split(_c(c), r"\."), -1))


def safe_filename(c) -> Column:
    base = F.regexp_replace(F.element_at(F.split(_c(c), r"[\\/]"), -1), r"[\x00-\x1f]", "")
    clean = F.trim(F.regexp_replace(base, "[^A-Za-z0-9._ ()-]+", "_"))
    name = F.when(extension_of(clean).isin(EXTENSIONS), clean).otherwise(F.concat(F.when(clean == "", "document").otherwise(clean), F.lit(".pdf")))
    return F.when(F.length(name) > 180, F.right(name, F.lit(180))).otherwise(name)


def owner_path(owner, document, filename) -> Column:
    ext = extension_of(filename)
    return F.concat(_c(owner).cast("string"), F.lit("/"), _c(document).cast("string"), F.lit("."), F.when(ext.isin(EXTENSIONS), ext).otherwise("pdf"))


def is_owner_path(path, owner) -> Column:
    return F.startswith(_c(path), F.concat(_c(owner).cast("string"), F.lit("/"))) & ~F.contains(_c(path), F.lit(".."))


def is_sha256(c) -> Column:
    return F.rlike(_c(c), F.lit("^[a-f0-9]{64}$"))


def title_from(title, question, size: int = 60) -> Column:
    return F.when(_c(title) == DEFAULT_TITLE, F.substring(_c(question), 1, size)).otherwise(_c(title))


def format_bytes(c) -> Column:
    n = _c(c)
    return F.when(n < 1024, F.format_string("%d B", n)).when(n < 1048576, F.format_string("%.1f KB", n / 1024)).otherwise(F.format_string("%.1f MB", n / 1048576))


def percent(c, digits: int = 1) -> Column:
    return F.format_string(f"%.{digits}f%%", _c(c) * 100)


def route_format(filename, mime) -> Column:
    """The format of a name and a media type; null if the two don't go together."""
    ext, out = extension_of(filename), None
    kind = F.lower(F.trim(F.element_at(F.split(_c(mime), ";"), 1)))
    free = kind.isNull() | (kind == "") | (kind == "application/octet-stream")
    for name, (types, extensions) in FORMATS.items():
        fits = ext.isin(extensions) & (free | kind.isin(types))
        out = F.when(fits, name) if out is None else out.when(fits, name)
    return out


def extract_html(c, cap: int | None = 200_000) -> Column:
    """Text of a page: no scripts, styles or tags, two entities, white space collapsed.

    What stands beyond the first ``cap`` characters of the page is lost; with None nothing is.
    """
    x = F.substring(_c(c), 1, cap) if cap else _c(c)
    x = F.regexp_replace(x, r"(?is)<script.*?</script>|<style.*?</style>", " ")
    x = F.regexp_replace(F.regexp_replace(F.regexp_replace(x, "<[^>]+>", " "), "(?i)&nbsp;", " "), "(?i)&amp;", "&")
    return F.trim(F.regexp_replace(x, r"\s{2,}", " "))


def preview(c, size: int = 320) -> Column:
    """The stripped text with line ends as spaces, cut to ``size`` characters and three dots."""
    x = F.replace(strip(c), F.lit("\n"), F.lit(" "))
    return F.when(F.length(x) > size, F.concat(F.substring(x, 1, size), F.lit("..."))).otherwise(x)


def split_breadcrumb(c) -> tuple[Column, Column]:
    """The path of a leading ``[Section: a > b]`` (null if none) and the rest."""
    pattern = r"^\[Section:\s*([^\]]+)\]\s*"
    return F.when(F.rlike(_c(c), F.lit(pattern)), F.regexp_extract(_c(c), pattern, 1)), F.regexp_replace(_c(c), pattern, "")


def locator(filename, position, snippet) -> Column:
    ext = extension_of(filename)
    sheet, section = F.regexp_extract(_c(snippet), r"^Sheet: ([^\n]+)", 0), F.regexp_extract(_c(snippet), r"^\[Section:\s*([^\]]+)\]", 1)
    at = _c(position).cast("string")
    return (
        F.when(ext == "pdf", F.concat(F.lit("Page "), at)).when(ext == "pptx", F.concat(F.lit("Slide "), at))
        .when(ext == "xlsx", F.when(sheet != "", sheet).otherwise(F.concat(F.lit("Worksheet "), at))).otherwise(F.when(section != "", section).otherwise("Evidence excerpt"))
    )


def escape_xml(c) -> Column:
    x = _c(c)
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        x = F.replace(x, F.lit(a), F.lit(b))
    return x


def text_overlap(a, b, least: int = 16, most: int = 600) -> Column:
    """Length of the longest end of ``a`` that starts ``b``, between the two bounds; 0 if none.

    Only places of ``a`` where the first ``least`` characters of ``b`` stand are compared further.
    """

    def longest(end: str | None, start: str | None) -> int:
        if end is None or start is None or len(start) < least:
            return 0
        at = end.find(start[:least], max(0, len(end) - len(start)))
        while at >= 0 and not start.startswith(end[at:]):
            at = end.find(start[:least], at + 1)
        return len(end) - at if at >= 0 else 0

    @F.pandas_udf("int")
    def run(ends: pd.Series, starts: pd.Series) -> pd.Series:
        return pd.Series([longest(*x) for x in zip(ends, starts, strict=True)], dtype="int32")

    return run(F.right(_c(a), F.lit(most)), F.left(_c(b), F.lit(most)))


def dynamic_threshold(score, base: float = 0.82) -> Column:
    s = F.greatest(F.lit(0.0), F.least(F.lit(1.0), _c(score)))
    return (
        F.when(_c(score).isNull() | F.isnan(_c(score)), base).when(s >= 0.75, F.least(F.lit(0.92), F.lit(base) + (s - 0.75) / 0.25 * 0.1))
        .when(s < 0.5, F.greatest(F.lit(0.7), F.lit(base) - (0.5 - s) / 0.5 * (base - 0.7))).otherwise(base)
    )
