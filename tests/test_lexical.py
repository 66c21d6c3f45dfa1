"""Full-text search: syntax, covers and ranked lists against brute force; the written index."""

import random
import re

import pytest
from pyspark.sql import functions as F

from quern.operators import lexical as lx
from quern.operators import retrieval as rt


def cut(text):
    return re.findall("[a-z0-9]+", text.lower())


def asked_of(question):
    """Parts of (positive units, negative units), each unit a tuple of words."""
    tokens, out, can = re.findall(r'-?"[^"]*"|[^\s"]+', question.lower()), [([], [])], False
    for k, t in enumerate(tokens):
        if t == "or" and can and k < len(tokens) - 1:
            out.append(([], []))
            can = False
            continue
        can = True
        w = tuple(cut(t))
        if w and t[0] == "-":
            out[-1][1].append(w)
        elif w:
            out[-1][0].extend([w] if '"' in t else [(x,) for x in w])
    return [(set(p), set(n)) for p, n in out if p]


def brute(question, text):
    """None if the text isn't found, else the sum over minimal stretches that meet a part."""
    w = cut(text)
    at = lambda u: [i for i in range(len(w) - len(u) + 1) if tuple(w[i : i + len(u)]) == u]
    spans, found = {}, False
    for units, bars in asked_of(question):
        if any(at(u) for u in bars) or not all(at(u) for u in units):
            continue
        found = True
        n = sum(map(len, units))
        for s in range(len(w)):
            for e in range(s, len(w)):
                if all(any(s <= i and i + len(u) - 1 <= e for i in at(u)) for u in units):
                    spans.setdefault((s, e), n)
                    break
    least = {k: n for k, n in spans.items() if not any(k != o and k[0] <= o[0] and o[1] <= k[1] for o in spans)}
    return round(sum(0.1 / (1 + max(0, e - s + 1 - n)) for (s, e), n in least.items()), 6) if found else None


QUESTIONS = ["a b", "a", "a b c", '"a b"', '"a b" c', "a or b", "a b or c d", '"a b" or "c d" -a', "a -b", 'a -"b c"', "or a", "a or", "a or or b", "or", "", "-a", "a a b", "a-b", "-a-b c", '"a b" "b c"', 'a "a b"', "or or", "a or b or c", '"a', "zz", "a or -b"]


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(4)
    return ["", *(" ".join(rng.choice(["a", "b", "c", "d", "or", "e"]) for _ in range(rng.randrange(1, 25))) for _ in range(80)), "a" * 3, "a b " * 60]


@pytest.fixture(scope="module")
def chunks(spark, texts):
    return spark.createDataFrame([(i, i % 7, t) for i, t in enumerate([*texts, None])], "chunk_id int, document_id int, content string").repartition(3)


@pytest.fixture(scope="module")
def index(spark, chunks, tmp_path_factory):
    return lx.write_index(chunks, str(tmp_path_factory.mktemp("index") / "words"))


@pytest.mark.parametrize("written", [False, True])
def test_equal_to_brute_force(spark, texts, chunks, index, written):
    queries = spark.createDataFrame(list(enumerate(QUESTIONS)), "query_id int, question string")
    got = {(r.query_id, r.chunk_id): r.lexical_rank for r in rt.cover_density(queries, index if written else chunks).collect()}
    want = {(q, i): rank for q, question in enumerate(QUESTIONS) for i, t in enumerate(texts) if (rank := brute(question, t)) is not None}
    assert set(got) == set(want)
    assert all(abs(got[k] - want[k]) < 2e-6 for k in want), [(QUESTIONS[k[0]], texts[k[1]], got[k], want[k]) for k in want if abs(got[k] - want[k]) >= 2e-6][:3]
    assert {(r.query_id, r.chunk_id) for r in rt.lexical_match(queries, index if written else chunks).collect()} == set(want)


def listed(ranks, docs, cap, pool):
    """A variant's list: (rank, chunk) of the first ``pool`` with at most ``cap`` a document where there are several."""
    order, n, out = sorted(ranks, key=lambda c: (-ranks[c], c)), {}, []
    for c in order:
        n[docs[c]] = n.get(docs[c], 0) + 1
        if len({docs[x] for x in ranks}) == 1 or n[docs[c]] <= cap:
            out.append(c)
    return out[:pool]


@pytest.mark.parametrize("cap,pool", [(2, 6), (1, 3), (8, 60), (60, 5)])
def test_lists_with_cap_and_variants(spark, texts, chunks, index, cap, pool, monkeypatch):
    monkeypatch.setattr(lx, "AHEAD", 1)
    asked = [(1, 0, "a b"), (1, 1, "c"), (2, 0, '"a b" or c'), (3, 0, ""), (3, 1, None), (3, 2, "d"), (4, 0, "zz"), (5, 0, "a -d"), (6, 0, "aaa")]
    queries = spark.createDataFrame(asked, "query_id int, variant int, question string")
    want = set()
    for q in range(1, 7):
        best = {}
        for _, _, text in (x for x in asked if x[0] == q):
            ranks = {i: r for i, t in enumerate(texts) if text and (r := brute(text, t)) is not None}
            for c in listed(ranks, {i: i % 7 for i in ranks}, cap, pool):
                best[c] = max(best.get(c, 0), ranks[c])
        want |= {(q, c, c % 7, best[c], k + 1) for k, c in enumerate(sorted(best, key=lambda c: (-best[c], c)))}
    for source in (chunks, index):
        got = {tuple(r) for r in rt.lexical_topk(queries, source, english=False, cap=cap, pool=pool).select("query_id", "chunk_id", "document_id", "lexical_rank", "position").collect()}
        assert {(*r[:3], round(r[3], 5), r[4]) for r in got} == {(*r[:3], round(r[3], 5), r[4]) for r in want}


def test_one_document_does_not_hold_the_whole_list(spark):
    """Without the cap document 1 would take all sixty places."""
    rows = [(i, 1, "fox fox fox") for i in range(70)] + [(100 + i, 2 + i, "fox and more") for i in range(3)]
    chunks = spark.createDataFrame(rows, "chunk_id int, document_id int, content string")
    got = rt.lexical_topk(spark.createDataFrame([(1, "fox")], "query_id int, question string"), chunks, english=False).collect()
    assert len(got) == 11 and sum(r.document_id == 1 for r in got) == 8
    alone = rt.lexical_topk(spark.createDataFrame([(1, "fox")], "query_id int, question string"), chunks.filter("document_id = 1"), english=False).collect()
    assert len(alone) == 60 and [r.position for r in sorted(alone, key=lambda r: r.chunk_id)] == list(range(1, 61))


def test_only_eligible_chunks_are_ranked(spark, tmp_path):
    rows = [(1, 1, "red fox", "ready", 1, 1, "a.pdf", 1), (2, 1, "red fox", "ready", 0, 1, "a.pdf", 1), (3, 2, "red fox", "failed", 1, 1, "b.pdf", 1), (4, 3, "red fox", "ready", 1, 1, "C.PPTX", 1), (5, 4, "red fox", "ready", 1, 1, "d.pptx", 2)]
    passages = spark.createDataFrame(rows, "chunk_id int, document_id int, content string, status string, chunk_version int, version int, filename string, parser_version int")
    vectors = passages.withColumn("embedding", F.array(F.lit(1.0), F.lit(0.0)))
    queries = spark.createDataFrame([(1, "the red foxes", [1.0, 0.0])], "query_id int, question string, query_embedding array<double>")
    for index in (None, lx.write_index(passages, str(tmp_path / "i"), english=True)):
        got = rt.retrieve(queries, vectors, passages, index=index).collect()
        assert {(r.chunk_id, r.dense_position, r.lexical_position) for r in got} == {(1, 1, 1), (5, 2, 2)}


def test_the_index_is_read_without_texts(spark, index, chunks):
    """A second call opens the written postings; no text is read or cut, and only the asked word's folder is."""
    asked = spark.createDataFrame([(1, "a")], "query_id int, question string")
    filters = rt.cover_density(asked, index)._jdf.queryExecution().explainString(index._sc._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    scans = re.findall(r"ReadSchema: struct<([^\n]*)>", filters)  # the index, and the asked words
    assert len(scans) == 2 and sum("places:array" in x for x in scans) == 1 and not any("content:" in x for x in scans)
    assert re.search(r"PartitionFilters: \[.*folder#\d+ = \d", filters) and re.search(r"PushedFilters: \[.*EqualTo\(term,a\)", filters), filters


def test_bounds_leave_chunks_out(spark, tmp_path, monkeypatch):
    """Chunks that can't come among the first aren't ranked; the list is the same."""
    rng = random.Random(8)
    rows = [(i, i % 5, " ".join(["fox"] * rng.randrange(1, 40) + ["cat"] * rng.randrange(1, 3))) for i in range(400)]
    chunks = spark.createDataFrame(rows, "chunk_id int, document_id int, content string")
    index, asked = lx.write_index(chunks, str(tmp_path / "i")), spark.createDataFrame([(1, "fox")], "query_id int, question string")
    some = lx.best_density(asked, index, 10, 4).collect()
    assert 10 <= len(some) < 200
    rank = {r.chunk_id: r.lexical_rank for r in lx.density(asked, chunks).collect()}
    assert len(rank) == 400 and all(rank[r.chunk_id] == r.lexical_rank for r in some)
    lists = [sorted(tuple(r) for r in rt.lexical_topk(asked, s, english=False, cap=4, pool=10).collect()) for s in (index, chunks)]
    assert lists[0] == lists[1] and len(lists[0]) == 10


def test_pairs_are_not_dealt_or_sorted(spark, chunks):
    """Pairs of a question and a chunk that share a word are neither exchanged nor gathered; only the chunks' words are, before."""
    asked = spark.createDataFrame(list(enumerate(QUESTIONS)), "query_id int, question string")
    for found in (lx.match(asked, chunks), lx.density(asked, chunks)):
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert not re.search(r"Exchange hash|ObjectHashAggregate|SortAggregate|\bSort\b", plan), plan


@pytest.mark.parametrize("block,rows,places", [(3, 2, 5), (4096, 256, 1 << 20)])
def test_blocks_of_questions(spark, texts, chunks, block, rows, places, monkeypatch):
    for name, value in (("BLOCK", block), ("ROWS", rows), ("PLACES", places)):
        monkeypatch.setattr(lx, name, value)
    few = ["a b", '"a b" or c', "a -d"] * 2
    got = {(r.query_id, r.chunk_id) for r in lx.match(spark.createDataFrame(list(enumerate(few)), "query_id int, question string"), chunks).collect()}
    assert got == {(q, i) for q, question in enumerate(few) for i, t in enumerate(texts) if brute(question, t) is not None}


def test_sql_states_the_syntax(texts):
    """The SQL of cover density has parts, phrases and excluded words as the query has."""
    import duckdb

    from quern.plans.retrieval import _cover

    c, asked = duckdb.connect(), [*QUESTIONS, "a c or a b c", '"a b c" or b c', "a or or or b"]
    c.execute("CREATE TABLE qs(query_id INT, question VARCHAR)")
    c.executemany("INSERT INTO qs VALUES (?, ?)", list(enumerate(asked)))
    c.execute("CREATE TABLE ps(chunk_id INT, document_id INT, content VARCHAR)")
    c.executemany("INSERT INTO ps VALUES (?, ?, ?)", [(i, i % 7, t) for i, t in enumerate(texts)])
    got = {r[:2]: r[2] for r in c.execute("WITH " + _cover("qs", "ps", "query_id") + " SELECT query_id, chunk_id, lexical_rank FROM lexr").fetchall()}
    want = {(q, i): r for q, question in enumerate(asked) for i, t in enumerate(texts) if (r := brute(question, t)) is not None}
    assert set(got) == set(want) and all(abs(got[k] - want[k]) < 2e-6 for k in want)


def test_no_places_are_written_or_dealt(spark, chunks, monkeypatch):
    """Texts are cut where they are held against the questions: no table of places is written, and only few rows of a question leave a task."""
    tables, write = [], lx.written
    monkeypatch.setattr(lx, "written", lambda df: tables.append(df.columns) or write(df))
    asked = spark.createDataFrame([(1, "a b"), (2, "c")], "query_id int, question string")
    for found in (lx.match(asked, chunks), lx.density(asked, chunks), lx.best_density(asked, chunks, 3, 2)):
        assert "ObjectHashAggregate" not in found._jdf.queryExecution().executedPlan().toString()
    assert tables and not any("places" in t for t in tables)
    assert lx.best_density(asked, chunks, 3, 2).count() <= 2 * 3 * chunks.rdd.getNumPartitions() < lx.density(asked, chunks).count()


@pytest.mark.parametrize("rows,places,text_bytes", [(2, 5, 7), (70, 100, 200), (256, 1 << 20, 8 << 20)])
def test_ranks_do_not_depend_on_slices(spark, texts, chunks, rows, places, text_bytes, monkeypatch):
    for name, value in (("ROWS", rows), ("PLACES", places), ("TEXT_BYTES", text_bytes)):
        monkeypatch.setattr(lx, name, value)
    asked = ["a b", "a or b", '"a b c" or b c', "a b c d", '"b a" -e', "b"]
    got = {(r.query_id, r.chunk_id): r.lexical_rank for r in lx.density(spark.createDataFrame(list(enumerate(asked)), "query_id int, question string"), chunks).collect()}
    want = {(q, i): r for q, question in enumerate(asked) for i, t in enumerate(texts) if (r := brute(question, t)) is not None}
    assert set(got) == set(want) and all(abs(got[k] - want[k]) < 2e-6 for k in want)


@pytest.mark.parametrize("from_index", [False, True])
def test_equal_ranks_go_by_chunk(spark, tmp_path, monkeypatch, from_index):
    """A task that cuts its lists early keeps the smallest of equal chunks, and rows beyond the cap only of a question with one document."""
    monkeypatch.setattr(lx, "ROWS", 3)
    monkeypatch.setattr(lx, "PLACES", 8)
    rows = [(i, i % 3, "fox " * (1 + i % 2) + ("owl" if i % 3 == 1 else "")) for i in range(60, 0, -1)]
    chunks = spark.createDataFrame(rows, "chunk_id int, document_id int, content string").coalesce(1)
    asked = spark.createDataFrame([(1, "fox"), (2, "owl fox")], "query_id int, question string")
    source = lx.write_index(chunks, str(tmp_path / "i")) if from_index else chunks
    got = [(r.query_id, r.chunk_id) for r in rt.lexical_topk(asked, source, english=False, cap=2, pool=5).orderBy("query_id", "position").collect()]
    assert got == [(1, 1), (1, 3), (1, 5), (1, 7), (1, 9), *((2, i) for i in (1, 4, 7, 10, 13))]


def test_halves_are_rounded_as_decimals():
    import numpy as np

    assert lx._rounded(np.array([0.0015625, 0.1 / 7, 0.3, 1e-7, 12.0000005])).tolist() == [0.001563, 0.014286, 0.3, 0.0, 12.000001]


def test_many_chunks_of_one_task_are_dealt(spark, monkeypatch):
    monkeypatch.setattr(lx, "TASK_ROWS", 10)
    chunks = spark.range(0, 100, numPartitions=1).selectExpr("id AS chunk_id", "id % 7 AS document_id", "concat('fox ', id % 3) AS content")
    found = lx.match(spark.createDataFrame([(1, "fox 2")], "query_id int, question string"), chunks)
    assert sorted(r.chunk_id for r in found.collect()) == list(range(2, 100, 3)) and found.select(F.spark_partition_id()).distinct().count() > 1


@pytest.mark.parametrize("named,sent", [(1000, 200_000), (0, 200_000), (0, 0)])
def test_index_holds_a_row_for_a_word_and_a_block(spark, texts, chunks, index, named, sent, monkeypatch):
    """A word of many chunks has few rows, and words that aren't asked for are left before rows are dealt."""
    monkeypatch.setattr(lx, "NAMED", named)
    monkeypatch.setattr(lx, "SENT", sent)
    assert index.filter("term = 'a'").count() == index.select("block").distinct().count() <= 3
    asked = spark.createDataFrame([(1, "a b")], "query_id int, question string")
    terms = lx._asked_of(index, spark.createDataFrame([("a",), ("b",)], "term string")).select("term").distinct().collect()
    assert {r.term for r in terms} == {"a", "b"}
    few = chunks.filter("chunk_id % 3 = 0")
    for within in (None, few):
        got = {(r.chunk_id, r.document_id) for r in lx.density(asked, index, within=within).collect()}
        assert got == {(i, i % 7) for i, t in enumerate(texts) if brute("a b", t) is not None and (within is None or i % 3 == 0)}
