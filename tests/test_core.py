"""Registered queries against their SQL on the smallest tables, and what SQL can't express against brute force."""

import datetime as dt
import math
import random
import re

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from quern.functions import english
from quern.functions import text as tx
from quern.operators import chunking as ch
from quern.operators import citations as ct
from quern.operators import context as cx
from quern.operators import evaluation as ev
from quern.operators import retrieval as rt
from quern.operators import rollups as ro
from quern.plans.all import QUERIES, SQL
from quern.sources import files
from quern.sources.views import TABLES
from quern.streaming import streams as st

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def duck():
    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def plain(x):
    if isinstance(x, bool) or x is None:
        return x
    if isinstance(x, (list, tuple)):
        return [plain(y) for y in x]
    if isinstance(x, dt.datetime):
        return str(x)
    try:
        return f"{float(x):.6g}" if not isinstance(x, str) else x
    except (TypeError, ValueError):
        return str(x)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, duck, name):
    df = QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    r = duck.execute(SQL[name])
    assert sorted(d[0] for d in r.description) == cols
    names = [d[0] for d in r.description]
    want = sorted(str([plain(x[names.index(c)]) for c in cols]) for x in r.fetchall())
    assert sorted(str([plain(x[c]) for c in cols]) for x in df.collect()) == want


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_other_queries_run(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_ann_recall(spark):
    sf = "/root/testdata/sf0.01"
    exact = {(r.query_id, r.chunk_id) for r in QUERIES["ret_01_dense_topk"](spark, sf).filter("position <= 10").collect()}
    near = {(r.query_id, r.chunk_id) for r in QUERIES["ret_02_ann_topk"](spark, sf).collect()}
    assert len(exact & near) / len(exact) >= 0.9


def test_ann_recall_on_clustered_vectors(spark):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(30, 16))
    chunks = spark.createDataFrame([(i, (centres[i % 30] + 0.3 * rng.normal(size=16)).tolist()) for i in range(2400)], "chunk_id long, embedding array<double>")
    asked = spark.createDataFrame([(i, (centres[i] + 0.3 * rng.normal(size=16)).tolist()) for i in range(30)], "query_id long, query_embedding array<double>")
    exact = {(r.query_id, r.chunk_id) for r in rt.dense_topk(asked, chunks, 10, -1.0).collect()}
    near = {(r.query_id, r.chunk_id) for r in rt.ann_topk(asked, chunks, 10, share=0.1).collect()}
    assert len(exact) == len(near) == 300 and len(exact & near) >= 0.95 * 300


def test_best_of_a_batch_loses_nothing(spark):
    rng = np.random.default_rng(9)
    chunks = spark.createDataFrame([(i, i % 3, [float(x) for x in rng.integers(-1, 2, 3)]) for i in range(300)], "chunk_id long, document_id long, embedding array<double>").repartition(5)
    asked = spark.createDataFrame([(i, [float(x) for x in rng.integers(-1, 2, 3)]) for i in range(5)], "query_id long, query_embedding array<double>")
    rows = lambda df: sorted(tuple(r) for r in df.select("query_id", "chunk_id", "similarity", "position").collect())
    assert rows(rt.top(rt.similarities(asked, chunks, -1.0, 7), "similarity", 7)) == rows(rt.top(rt.similarities(asked, chunks, -1.0), "similarity", 7))
    every = {(r.query_id): (r.n, r.best) for r in rt.similarity_summary(asked, chunks).collect()}
    assert every == {r.query_id: (r.n, r.best) for r in rt.similarities(asked, chunks, -2.0).groupBy("query_id").agg(F.count("*").alias("n"), F.max("similarity").alias("best")).collect()}
    pairs = rt.similarities(asked, chunks, 0.0)
    one = pairs.filter("query_id > 1 OR document_id = 0")
    got = {}
    for r in rt.per_document_cap(one, cap=2, pool=5).collect():
        got.setdefault(r.query_id, []).append((r.position, r.chunk_id, r.document_id))
    for q in range(5):
        held = sorted(((-r.similarity, r.chunk_id, r.document_id) for r in one.filter(f"query_id = {q}").collect()))
        docs, n, want = {d for *_, d in held}, {}, []
        for _, c, d in held:
            n[d] = n.get(d, 0) + 1
            if n[d] <= (2 if len(docs) > 1 else 5) and len(want) < 5:
                want.append((len(want) + 1, c, d))
        assert sorted(got.get(q, [])) == want


def test_stems():
    words = "consign consigned consigning consignment consist consistency consistent knack knackeries knavish knife kneel knights knots generously generate communities arsenal skies dying running hopping hoping happiness relational conditional rationally triplicate electricity hopefulness adjustment replacement adoption controlling rolled by say cries ties agreed feed national sensibility absolutely analogies flyer yes boy".split()
    want = "consign consign consign consign consist consist consist knack knackeri knavish knife kneel knight knot generous generat communiti arsenal sky die run hop hope happi relat condit ration triplic electr hope adjust replac adopt control roll by say cri tie agre feed nation sensibl absolut analog flyer yes boy".split()
    assert [english.stem(w) for w in words] == want


def test_english_search(spark):
    chunks = spark.createDataFrame([(1, 1, "The cats were running to the houses"), (2, 1, "a cat runs"), (3, 2, "house of a cat"), (4, 2, "the of and"), (5, 3, "running the cat")], "chunk_id int, document_id int, content string")
    ask = lambda q: sorted(r.chunk_id for r in rt.lexical_match(spark.createDataFrame([(1, q)], "query_id int, question string"), chunks, english=True).collect())
    assert ask("which cats are running") == [1, 2, 5] and ask('"running cats"') == [] and ask('"running the cats"') == [5] and ask("house -run") == [3] and ask("the of") == []
    rank = {r.chunk_id: r.lexical_rank for r in rt.cover_density(spark.createDataFrame([(1, "the running of cats")], "query_id int, question string"), chunks, english=True).collect()}
    assert rank == {1: 0.05, 2: 0.1, 5: 0.05}


def test_listwise_replies(spark):
    from quern.plans.retrieval import parse_listwise_scores

    cases = {1: '{"scores":[{"index":0,"score":8},{"index":1,"score":2}]}', 2: "not json", 3: "[0.5, 7]", 4: '{"scores":[]}', 5: '{"scores":[{"index":9,"score":1}]}', 6: '[{"score":0.2},{"index":0,"score":0.4},{"score":0.6}]', 7: "{broken", 8: "[-3, 99]", 9: None}
    got = {}
    for r in parse_listwise_scores(spark.createDataFrame(list(cases.items()), "query_id int, reply string"), 2).collect():
        got.setdefault(r.query_id, {})[r.target] = r.score
    assert got == {1: {0: 0.8, 1: 0.2}, 3: {0: 0.5, 1: 0.7}, 6: {0: 0.4, 1: 0.0}, 8: {0: 0.0, 1: 1.0}}


def test_exact_percentiles_equal_sorted_values(spark):
    rng = random.Random(3)
    rows = [(rng.choice("ab"), rng.choice([None, float(rng.randrange(40)), rng.random() * 1000])) for _ in range(3000)] + [("c", 5.0), ("d", None)]
    df = spark.createDataFrame(rows, "k string, x double")
    ps = {"p1": 0.01, "p50": 0.5, "p99": 0.99, "p100": 1.0}
    got = {r.k: tuple(r[p] for p in ps) for r in ro.exact_percentiles(df, "x", ps, ["k"], ranges=7).collect()}
    for k in "abc":
        xs = sorted(x for g, x in rows if g == k and x is not None)
        assert got[k] == tuple(xs[max(1, math.ceil(p * len(xs))) - 1] for p in ps.values())
    assert set(got) == {"a", "b", "c"} and ro.exact_percentiles(df.filter("k = 'd'"), "x", ps).count() == 0


def test_fingerprint_sees_every_row(spark):
    base = [(i, i * 7 % 5) for i in range(9000)]
    of = lambda rows, n: ro.fingerprint(spark.createDataFrame(rows, "k long, x int").repartition(n), "k").first()
    a = of(base, 3)
    assert a == of(base[::-1], 5) and a.n == 9000 and a.fingerprint != of([*base[:-1], (8999, 77)], 3).fingerprint and a.fingerprint != of(base[1:], 3).fingerprint


def test_a_batch_run_again_leaves_its_rows_once(spark, tmp_path):
    for _ in range(2):
        st._put(spark.range(5), 0, str(tmp_path))
    st._put(spark.range(3), 1, str(tmp_path))
    assert st._latest(spark, spark.range(1).schema, str(tmp_path), None).count() == 8 and st._latest(spark, spark.range(1).schema, str(tmp_path), ["id"]).count() == 5


def test_evidence_checks(spark):
    ranked = spark.createDataFrame([(q, c, 1) for q in range(1, 8) for c in (10, 11)], "query_id int, chunk_id int, document_id int")
    cases = {1: [("source_01", 10, 1), ("source_02", 11, 1)], 2: [("source_01", 10, 1), ("source_01", 11, 1)], 3: [("source_1", 10, 1)], 4: [("source_01", 12, 1)], 5: [("source_01", 10, 2)], 6: [("source_01", 10, 1), ("source_02", 10, 1)]}
    evidence = spark.createDataFrame([(q, *x) for q, xs in cases.items() for x in xs], "query_id int, source_id string, chunk_id int, document_id int")
    verdicts = spark.createDataFrame([*((q, True) for q in range(1, 8)), (8, False)], "query_id int, grounded boolean")
    assert {r.query_id: r.valid for r in cx.evidence_ids_valid(evidence, ranked, verdicts).collect()} == {1: True, 2: False, 3: False, 4: False, 5: False, 6: False, 7: False, 8: True}
    assert spark.range(1).select(tx.preview(F.lit("  a\nb" + "c" * 400 + " \n"))).first()[0] == "a b" + "c" * 317 + "..."


def test_exact_limiter_equals_brute_force(spark):
    got = {r.event_id: r.admitted for r in QUERIES["str_03_exact_limiter"](spark, SF).collect()}
    held, want = {}, {}
    for r in spark.read.parquet(f"{SF}/events.parquet").select("event_id", "user_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("us")).orderBy("us", "event_id").collect():
        times = held.setdefault(r.user_id, [])
        want[r.event_id] = sum(t > r.us - 86_400_000_000 for t in times) < 5
        if want[r.event_id]:
            times.append(r.us)
    assert got == want and not all(want.values())
    assert st.admit([0, 1, 2, 11], [], 2, 10)[0] == [True, True, False, True]


def test_web_search_syntax(spark):
    chunks = spark.createDataFrame([(1, 1, "red fox runs far"), (2, 1, "fox red"), (3, 2, "the red hen"), (4, 2, "blue fox runs"), (5, 3, "")], "chunk_id int, document_id int, content string")
    ask = lambda q: sorted(r.chunk_id for r in rt.lexical_match(spark.createDataFrame([(1, q)], "query_id int, question string"), chunks).collect())
    assert ask("red fox") == [1, 2] and ask('"red fox"') == [1] and ask("red or blue") == [1, 2, 3, 4]
    assert ask("fox -blue") == [1, 2] and ask('fox -"red fox"') == [2, 4] and ask("") == [] and ask("hen or fox runs") == [1, 3, 4]


def test_cover_density_equals_brute_force(spark):
    rng = random.Random(4)
    texts = [" ".join(rng.choice("abcde") * 2 for _ in range(rng.randrange(1, 30))) for _ in range(40)]
    chunks = spark.createDataFrame([(i, i, t) for i, t in enumerate(texts)], "chunk_id int, document_id int, content string")
    got = {r.chunk_id: r.lexical_rank for r in rt.cover_density(spark.createDataFrame([(1, "aa bb cc")], "query_id int, question string"), chunks).collect()}
    for i, t in enumerate(texts):
        w, want = t.split(), {"aa", "bb", "cc"}
        spans = [(s, e) for s in range(len(w)) for e in range(s, len(w)) if want <= set(w[s : e + 1])]
        covers = [(s, e) for s, e in spans if not any((a, b) != (s, e) and s <= a and b <= e for a, b in spans)]
        score = sum(0.1 / (1 + e - s + 1 - 3) for s, e in covers)
        assert got.get(i, 0) == pytest.approx(score, abs=2e-6)


def test_gate_reasons(spark):
    q = spark.createDataFrame([(i,) for i in range(1, 5)], "query_id int")
    ranked = spark.createDataFrame([(1, 10, 0.9, 0.8), (2, 10, 0.2, 0.8), (3, 10, 0.5, 0.2)], "query_id int, document_id int, similarity double, rerank_score double")
    assert [r.reason for r in rt.evidence_gate(q, ranked).orderBy("query_id").collect()] == ["ok", "weak_top_score", "weak_top_score", "no_candidates"]


def test_recursive_split_invariants():
    rng = random.Random(2)
    for _ in range(200):
        text = "".join(rng.choice(["word ", "longerword ", ". ", "\n", "\n\n", "x" * 50, "y" * 400, "Fin. "]) for _ in range(rng.randrange(1, 200)))
        size, overlap = rng.choice([(300, 60), (100, 0), (250, 200), (1000, 200), (200, 300)])
        end = 0
        for a, b in ch.spans(text, size, overlap):
            assert a <= end < b and b - a <= size
            end = b
        assert end == len(text)
        assert all(0 < len(c) <= size and c == c.strip() and c in text for c in ch.recursive_split(text, size, overlap))
    long = ch.recursive_split("a" * 2500, 1000, 0)
    assert [c.count("a") for c in long] == [1000, 1000, 500] and ch.recursive_split(" .. ", 100) == []
    assert ch.recursive_split("SKU-1") == ["SKU-1"] and ch.recursive_split("A" * 96 + "\n\nSKU: AB-1234", 100, 0) == ["A" * 96, "SKU: AB-1234"]
    assert ch.recursive_split("one two. three four\nfive", 12, 0) == ["one two.", "three four", "five"] and ch.recursive_split("保留35天。") == ["保留35天。"]


def test_cut_places_equal_brute_force():
    """A place is one of the coarsest kind that makes its stretch short enough."""
    rng = random.Random(6)
    for _ in range(100):
        text = "".join(rng.choice(["ab", "cdefg", " ", ". ", "\n", "\n\n"]) for _ in range(rng.randrange(60)))

        def pieces(t, kinds, size=12):
            if len(t) <= size or not kinds:
                return [t[i : i + size] for i in range(0, len(t), size)]
            parts = [x + kinds[0] for x in t.split(kinds[0])]
            return [y for x in [*parts[:-1], parts[-1][: -len(kinds[0])]] for y in pieces(x, kinds[1:]) if y]

        at, want = 0, [0]
        for x in pieces(text, ["\n\n", "\n", ". ", " "]):
            at += len(x)
            want.append(at)
        assert ch.cut_places(text, 12) == sorted({*want, len(text)})


def test_windows_of_a_long_text(spark):
    text = "abé😀" * 250_500
    df = spark.createDataFrame([(7, text), (8, "x" * 2500), (9, ""), (10, None)], "k long, t string")
    got = {}
    for r in ch.window_chunks(df, "k", "t").collect():
        got.setdefault(r.k, {})[r.chunk_index] = r.content
    assert set(got) == {7, 8} and "".join(got[7][i] for i in range(len(got[7]))) == text and len(got[7]) == 1002
    assert [len(got[8][i]) for i in range(3)] == [1000, 1000, 500]
    assert [r.content for r in ch.window_chunks(spark.createDataFrame([(1, "abcdefghij")], "k int, t string"), "k", "t", 4, 1).orderBy("chunk_index").collect()] == ["abcd", "defg", "ghij", "j"]


def test_chunk_pages():
    pages = [(1, "# Guide #\nintro\n## Part\ntext  here\n```\ncode # no\n```\n| a | b |\n|---|---|\n| 1 | 2 |"), (2, "  "), (3, "### Deep\nmore\n# New\nend")]
    got = list(ch.chunk_pages(pages))
    assert [(p, path, t) for p, _, path, t in got] == [(1, "Guide", False), (1, "Guide > Part", False), (1, "Guide > Part", False), (1, "Guide > Part", True), (3, "Guide > Part > Deep", False), (3, "New", False)]
    assert got[1][1] == "[Section: Guide > Part]\n\ntext here" and got[5][1] == "[Section: New]\n\nend"


def test_split_table():
    rows = ["| h |", "|---|", *(f"| {'r' * 30}{i} |" for i in range(9)), "| " + "x" * 200 + " |"]
    out = ch.split_table(rows, 150)
    assert all(o.startswith("| h |\n|---|\n") for o in out) and sum(o.count("\n") - 1 for o in out) == 10
    assert all(len(o) <= 150 or o.count("\n") == 2 for o in out) and ch.split_table(rows[:2], 5) == ["| h |\n|---|"]


def test_boundary_overlap():
    text = "First sentence here. Second one follows now. Third is last."
    assert ch.boundary_overlap("First sentence about infrastructure. Second sentence detailing service reliability. Third sentence on incident response.", 55) == "Third sentence on incident response."
    assert ch.boundary_overlap("Continuous integration and delivery automation across cloud platforms", 25) == "across cloud platforms" and ch.boundary_overlap("Short text", 0) == ""
    assert ch.boundary_overlap(text, 20) == "Third is last." and ch.boundary_overlap("short", 5) == "" and ch.boundary_overlap("x" * 50, 10) == "x" * 10


def test_pack():
    row = lambda i, doc, idx, text, score=0.9: {"query_id": 1, "chunk_id": i, "document_id": doc, "page": 1, "chunk_index": idx, "content": text, "score": score, "place": i}
    a = "alpha beta gamma delta epsilon zeta eta theta shared tail of the text here"
    rows = [row(1, 1, 0, a), row(2, 1, 1, "shared tail of the text here and then more words follow"), row(3, 2, 5, a), row(4, 3, 0, "entirely different words stand in this passage"), row(5, 3, 7, "yet another quite separate statement of things"), row(6, 3, 12, "third passage of the page that goes over its cap")]
    kept, used, dropped, merged = cx.pack(rows)
    assert [k["chunk_id"] for k in kept] == [1, 3, 4, 5] or [k["chunk_id"] for k in kept] == [1, 4, 5]
    assert merged == 1 and kept[0]["snippet"].count("shared tail") == 1 and dropped >= 1 and used == sum(-(-len(k["snippet"]) // 4) + 24 for k in kept)
    kept, used, _, _ = cx.pack([row(1, 1, 0, "w " * 5000)], tokens=100)
    assert len(kept) == 1 and len(kept[0]["snippet"]) <= 304


def test_overlap_length():
    assert cx.overlap_length("one two three four five six", "three four five six seven") == len("three four five six")
    assert cx.overlap_length("a b\n  three four five six", "b three   four five six x") == len("b three   four five six")
    assert cx.overlap_length("nothing", "else") == 0


def test_validation_cases(spark):
    cases = {1: "", 2: "No marker here.", 3: "Fact [source_1].\n\nOther fact.", 4: "Fact [source_1] and [source_09].", 5: "Fact [source_05].", 6: "Fact [Source_1 ].", 7: "# Head\n\n- item [source_2]\n  goes on\n- next [source_01]\n\n```\n[source_77]\n```", 8: "| a |\n|---|\n| x [source_1] |\n| y |", 9: "Fact [source_1] [1] [link]."}
    answers = spark.createDataFrame(list(cases.items()), "answer_id int, answer string")
    evidence = spark.createDataFrame([(i, f"source_0{k}") for i in cases for k in (1, 2)], "answer_id int, source_id string")
    got = {r.answer_id: (r.valid, r.reason, r.block, r.cited) for r in ct.validate(answers, evidence, [f"source_0{k}" for k in range(1, 8)]).collect()}
    assert got == {
        1: (False, "no_citations", 0, []), 2: (False, "no_citations", 0, []), 3: (False, "uncited_substantive_block", 1, []), 4: (False, "unknown_citation", None, []), 5: (False, "citation_outside_evidence_set", None, []),
        6: (False, "malformed_citation", None, []), 7: (True, None, None, ["source_02", "source_01"]), 8: (False, "uncited_substantive_block", 1, []), 9: (True, None, None, ["source_01"]),
    }


def test_emission_joins_to_the_text(spark):
    text = "word " * 300 + "\n" + "y" * 500
    parts = spark.createDataFrame([(text,)], "t string").select(F.explode(ct.emission_chunks(F.col("t"))).alias("p")).collect()
    assert "".join(r.p for r in parts) == text and max(len(r.p) for r in parts[:-1]) <= 500 and len(parts) > 5


def test_metrics_without_labels(spark):
    q = spark.createDataFrame([(1,), (2,)], "query_id int")
    run = spark.createDataFrame([(1, 5, 1), (1, 6, 2)], "query_id int, chunk_id int, position int")
    m = {r.query_id: r for r in ev.ranking_metrics(run, spark.createDataFrame([(1, 6), (1, 9)], "query_id int, chunk_id int"), q, 2).collect()}
    assert (m[1].recall, m[1].precision_k, m[1].reciprocal_rank, m[2].recall, m[2].precision_returned) == (0.5, 0.5, 0.5, 1.0, 0.0)


def test_text_files_and_manifest(spark, tmp_path):
    for name, data in (("a.txt", "ok é".encode()), ("b.txt", b"\xff\xfe"), ("c.txt", b"a\x00b"), ("d.pdf", b"%PDF-1.7")):
        (tmp_path / name).write_bytes(data)
    got = {r.path.rsplit("/", 1)[1]: (r.text, r.problem) for r in files.read_text_files(spark, str(tmp_path)).collect()}
    assert got == {"a.txt": ("ok é", None), "b.txt": (None, "INVALID_UTF8"), "c.txt": (None, "BINARY_CONTENT"), "d.pdf": (None, "PDF")}
    (tmp_path / "m").mkdir()
    (tmp_path / "m" / "m.json").write_text('{"kind":"real","documents":[{"id":"d1","sha256":"x"},{"id":"d2","sha256":"x"}],"questions":[{"id":"q1","question":"?","supportingSpans":[{"documentId":"d1","page":1,"start":0,"end":2,"quote":"ab"},{"documentId":"zz","page":1,"start":0,"end":2,"quote":"ab"}]}]}')
    spans, bad = files.load_gold_manifest(spark, str(tmp_path / "m"))
    assert spans.count() == 2 and sorted((r.violation, r.id) for r in bad.collect()) == [("DUPLICATE_DOCUMENT_CONTENT", "x"), ("UNKNOWN_DOCUMENT", "q1")]
    files.append_events(spark.range(3), str(tmp_path / "e"))
    files.append_events(spark.range(2), str(tmp_path / "e"))
    files.write_report(spark.range(2), str(tmp_path / "r"))
    assert spark.read.parquet(str(tmp_path / "e")).count() == 5 and spark.read.json(str(tmp_path / "r")).count() == 2


def test_near_duplicate_classes_have_all_members(spark):
    base = [f"w{i}" for i in range(60)]
    near = " ".join([*base[:59], "changed"])
    df = spark.createDataFrame(enumerate([" ".join(base), near, " ".join(base).upper(), "  ".join(base), near, "alone words here", "copy of a copy", "copy of a copy", None, None]), "chunk_id long, content string")
    got = {r.chunk_id: (r.representative, r.class_size, r.n_links) for r in cx.near_duplicate_classes(df).collect()}
    assert got == {0: (0, 3, 1), 1: (1, 2, 1), 2: (0, 3, 1), 3: (0, 3, 1), 4: (1, 2, 1), 5: (5, 1, 0), 6: (6, 2, 0), 7: (6, 2, 0), 8: (8, 2, 0), 9: (8, 2, 0)}


def test_near_duplicates_equal_brute_force(spark):
    rng = random.Random(9)
    base = [f"w{rng.randrange(60)}" for _ in range(60)]
    texts = []
    for i in range(40):
        w = list(base) if i % 2 else [f"v{rng.randrange(80)}" for _ in range(50)]
        for _ in range(rng.randrange(3)):
            w[rng.randrange(len(w))] = f"z{rng.randrange(99)}"
        texts.append(" ".join(w))
    grams = [{" ".join(t.split()[k : k + 3]) for k in range(len(t.split()) - 2)} for t in texts]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "chunk_id int, content string")
    got = {(r.a, r.b) for r in cx.near_duplicate_pairs(df).collect()}
    first = [min(j for j in range(40) if grams[j] == grams[i]) for i in range(40)]
    want = {(a, b) for a in range(40) for b in range(a + 1, 40) if first[a] == a and first[b] == b and len(grams[a] & grams[b]) / len(grams[a] | grams[b]) >= 0.82}
    assert got == want and want


def test_compatibility_form(spark):
    df = spark.createDataFrame([("Ｗhat ﬁts ① here?",), ("plain",), (None,)], "t string")
    assert [r.n for r in df.select(tx.normal_question("t").alias("n")).collect()] == ["what fits 1 here", "plain", None]


def test_text_functions(spark):
    r = spark.range(1).select(tx.strip(F.lit("  x  ")).alias("s"), tx.safe_filename(F.lit("a/b\\c d*.TXT")).alias("n"), tx.format_bytes(F.lit(2048)).alias("b"), F.size(tx.shingles3(F.lit("One two"))).alias("g")).first()
    assert (r.s, r.n, r.b, r.g) == ("x", "c d_.TXT", "2.0 KB", 1)


def test_slices_of_a_key_that_holds_all_rows(spark):
    """Rates and runs with one key, over many slices, against plain loops; repeated times and indexes, borders."""
    rng = random.Random(6)
    times = sorted([rng.randrange(4000) for _ in range(300)] + [800, 800, 1599, 1600, 3200])
    events = spark.createDataFrame([(i, 1, dt.datetime.fromtimestamp(1_700_000_000 + t, dt.timezone.utc)) for i, t in enumerate(times)], "event_id int, user_id int, ts timestamp")
    for slices in (1, 4):
        got = {r.event_id: (r.n_recent, int(r.oldest.timestamp()) - 1_700_000_000) for r in ro.sliding_rate(events, 100, ["user_id"], slices).collect()}
        assert got == {i: (len(near), min(near)) for i, t in enumerate(times) if (near := [u for u in times if t - 100 <= u <= t])}
    plan = ro.sliding_rate(events, 100, ["user_id"])._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(user_id" in plan and "_slice" in plan.split("hashpartitioning(user_id")[1].split(")")[0]
    indexes = [i for i in range(0, 500) if i % 37 and i not in (10, 11, 64, 127)] + [5, 5, 63, -1, -2, -64, -65]
    rows = spark.createDataFrame([("k", i) for i in indexes], "key string, i long")
    want, held = [], sorted(set(indexes))
    for i in held:
        if want and i == want[-1][1] + 1:
            want[-1][1] = i
        else:
            want.append([i, i])
    for width in (1, 8, 64, 1 << 16):
        got = sorted((r["first"], r["last"], r.n) for r in ro.adjoining_runs(rows, ["key"], "i", width).collect())
        assert got == [(a, b, sum(a <= i <= b for i in indexes)) for a, b in want]


def test_overlapping_spans_equal_all_pairs(spark):
    rng = random.Random(7)
    spans = lambda n: [(rng.choice("ab"), i, s := rng.randrange(-300, 5000), s + rng.choice([0, 1, 5, 64, 65, 500, 512, 4000, rng.randrange(1, 300)])) for i in range(n)]
    one, two = spans(150), spans(150)
    a, b = spark.createDataFrame(one, "key string, a int, s long, e long"), spark.createDataFrame(two, "key string, b int, s2 long, e2 long")
    want = sorted((x[1], y[1]) for x in one for y in two if x[0] == y[0] and max(x[2], y[2]) < min(x[3], y[3]))
    for width, step in ((64, 8), (1, 2), (10_000, 8)):
        assert sorted((r.a, r.b) for r in ro.overlapping(a, b, ["key"], ("s", "e"), ("s2", "e2"), width, step).collect()) == want


def test_many_spans_that_overlap_little_make_no_square(spark):
    """One key with 100,000 spans: the join hands on about as many rows as there are pairs, not their square."""
    a = spark.range(100_000).selectExpr("'k' AS key", "id AS a", "id * 40 AS s", "id * 40 + 50 AS e")
    b = spark.range(100_000).selectExpr("'k' AS key", "id AS b", "id * 40 + 20 AS s2", "id * 40 + 45 AS e2")
    assert ro.overlapping(a, b, ["key"], ("s", "e"), ("s2", "e2")).count() == 100_000 + 99_999
    gold = b.selectExpr("key", "s2 AS start", "e2 AS end")
    assert [tuple(r) for r in ev.span_coverage(gold, a.filter("a % 3 = 0").selectExpr("key", "s AS start", "e AS end")).collect()] == [("k", 100_000, 33_334)]


def test_span_coverage_equals_brute_force(spark):
    rng = random.Random(8)
    spans = lambda n, w: [(rng.choice("abc"), s := rng.randrange(60), s + rng.randrange(1, w)) for _ in range(n)]
    gold, evidence = [*spans(60, 12), ("z", 1, 2)], [*spans(40, 9), ("y", 0, 9)]
    frame = lambda x: spark.createDataFrame(x, "key string, start int, end int")
    got = {r.key: (r.spans, r.covered) for r in ev.span_coverage(frame(gold), frame(evidence)).collect()}
    held = {k: {i for key, s, e in evidence if key == k for i in range(s, e)} for k in "abcz"}
    assert got == {k: (len({g for g in gold if g[0] == k}), sum(set(range(s, e)) <= held[k] for key, s, e in set(gold) if key == k)) for k in {g[0] for g in gold}}


def test_overlap_threshold_and_merge_by_definition():
    rng = random.Random(9)
    words = ["alpha", "beta", "gamma", "de", "e"]
    text = lambda n: "".join(rng.choice(words) + rng.choice([" ", "  ", "\n"]) for _ in range(n)).strip()
    for _ in range(1500):
        a, b = text(rng.randrange(1, 14)), text(rng.randrange(1, 14))
        b = a[-rng.randrange(5, 60) :].lstrip() + b if rng.random() < 0.6 else b
        exact = max((n for n in range(16, min(len(a), len(b), 600) + 1) if a.endswith(b[:n])), default=0)
        alike = max((n for n in range(1, len(b) + 1) if not b[n - 1].isspace() and len(" ".join(b[:n].split())) >= 16 and (" ".join(a.split())).endswith(" ".join(b[:n].split()))), default=0)
        assert cx.overlap_length(a, b) == (exact or alike)
    assert [round(cx.threshold_for(s), 6) for s in (None, float("nan"), -1, 0, 0.25, 0.5, 0.6, 0.75, 0.875, 1, 3)] == [0.82, 0.82, 0.7, 0.7, 0.76, 0.82, 0.82, 0.82, 0.87, 0.92, 0.92]
    assert cx.merge_texts("[Section: A]\n\none two three four five", "[section: B ]\n\nthree four five six seven", "[Section: A]\n\nend") == "[Section: A → B]\n\none two three four five three four five six seven end"
    assert cx.merge_texts("one two three four five six", "two three four five six seven") == "one two three four five six seven" and cx.merge_texts("", "x") == "x"


def test_packed_sources_hold_their_limits():
    """Whatever comes: costs add up, budgets and caps hold, each passage is a source, merged, dropped or not reached, and sources don't repeat each other."""
    rng = random.Random(10)
    for _ in range(300):
        index = rng.sample(range(40), 40)
        rows = [{"query_id": 1, "chunk_id": i, "document_id": rng.randrange(3), "page": rng.randrange(2), "chunk_index": index[i], "content": " ".join(rng.choice("abcdefghij") * 3 for _ in range(rng.choice([2, 9, 60, 300]))), "score": rng.random(), "place": i + 1} for i in range(rng.randrange(1, 32))]
        tokens, snippet = rng.choice([100, 700, 6400]), rng.choice([200, 1800])
        kept, used, dropped, merged = cx.pack([dict(r) for r in rows], tokens=tokens, snippet=snippet)
        assert 1 <= len(kept) <= 12 and used == sum(-(-len(k["snippet"]) // 4) + 24 for k in kept) and (used <= tokens or len(kept) == 1)
        assert len(kept) + dropped + merged <= len(rows) and [k["place"] for k in kept] == sorted(k["place"] for k in kept)
        assert all(len(k["snippet"]) <= max(snippet, 304) and k["low"] <= k["chunk_index"] <= k["high"] for k in kept)
        pages = [(k["document_id"], k["page"]) for k in kept]
        assert max(map(pages.count, pages)) <= 2 and len({(*p, i) for p, k in zip(pages, kept) for i in range(k["low"], k["high"] + 1)}) == sum(k["high"] - k["low"] + 1 for k in kept)


def test_a_large_text_file_is_read_by_several_tasks(spark, tmp_path):
    """Byte ranges of one file, with wide characters at their borders; what is found is what the whole file gives."""
    text = "".join(f"{i} é 語 line {'x' * (i % 90)}\n" for i in range(30_000)) + "no feed at the end"
    cases = {"good.txt": text.encode(), "bad.txt": text.encode() + b"\n\xff\xfe", "nul.txt": b"a\nb\0c\n", "pdf.txt": b"%PDF-1.7\nx", "late.txt": b"x\n%PDF-1.7\n", "cr.txt": b"a\r\nb\r\n"}
    for name, data in cases.items():
        (tmp_path / name).write_bytes(data)
    spark.conf.set("spark.sql.files.maxPartitionBytes", 200_000)
    try:
        lines = files.read_text_lines(spark, str(tmp_path))
        assert lines.filter(F.endswith("path", F.lit("good.txt"))).select("block").distinct().count() >= 8
        got = {r.path.rsplit("/", 1)[1]: r for r in files.text_file_report(lines).collect()}
        whole = {r.path.rsplit("/", 1)[1]: r for r in files.read_text_files(spark, str(tmp_path)).collect()}
        ordered = lines.filter(F.endswith("path", F.lit("good.txt"))).orderBy("block", "line").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert "\n".join(r.content for r in ordered) == text
    assert {n: (r.problem, r.n_chars) for n, r in got.items()} == {n: (r.problem, None if r.text is None else len(r.text)) for n, r in whole.items()}
    assert got["good.txt"].n_lines == 30_001


def test_documents_of_one_page_are_split_where_they_are_read(spark):
    texts = [None, "", " ", "# Head\n\nSome words here. " + "More of them follow. " * 200, "| a | b |\n|---|---|\n" + "| c | d |\n" * 300, "plain " * 5000]
    docs = spark.createDataFrame([(None if i == 3 else i, t) for i, t in enumerate(texts)], "document_id long, text string")
    got = ch.split_documents(docs)
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()
    want = ch.chunk_documents(docs.select("document_id", F.lit(1).alias("page"), "text"))
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_readiness_of_cases_that_lack_categories_and_splits(spark):
    of = lambda rows: sorted(r.issue for r in ev.readiness_issues(spark.createDataFrame(rows, "category string, split string"), {"a": 2, "b": 1}, {"dev": 2, "out": 1}, 3).collect())
    assert of([]) == ["INSUFFICIENT_CATEGORY:a", "INSUFFICIENT_CATEGORY:b", "INSUFFICIENT_SPLIT:dev:2", "INSUFFICIENT_SPLIT:out:1", "REQUIRES_3_REVIEWED_QUESTIONS"]
    assert of([("a", "dev"), ("a", "dev"), ("a", "dev")]) == ["EXCESS_SPLIT:dev:2", "INSUFFICIENT_CATEGORY:b", "INSUFFICIENT_SPLIT:out:1"]
    assert of([("a", "dev"), ("a", "dev"), ("b", "out")]) == []


@pytest.mark.parametrize("cap,best,docs", [(2, 6, 5), (3, 4, 1), (9, 4, 5)])
def test_capped_lists_from_few_pairs(spark, cap, best, docs):
    """Only pairs that can stand in a capped list leave the tasks, and the list is that of all pairs."""
    rng = np.random.default_rng(3)
    chunks = spark.createDataFrame([(i, i % docs, rng.normal(size=6).tolist()) for i in range(900)], "chunk_id int, document_id int, embedding array<double>").coalesce(1)
    asked = spark.createDataFrame([(i, rng.normal(size=6).tolist()) for i in range(5)], "query_id int, query_embedding array<double>")
    some, every = rt.similarities(asked, chunks, -1.0, best, cap), rt.similarities(asked, chunks, -1.0)
    rows = lambda df: sorted(tuple(r) for r in rt.per_document_cap(df, cap=cap, pool=best).select("query_id", "chunk_id", "similarity", "position").collect())
    assert rows(some) == rows(every) and some.count() <= 5 * 2 * best < every.count() == 4500


def test_dense_lists_carry_no_texts(spark):
    """The lists' pairs hold ids and scores; a chunk's text goes to no Python worker."""
    chunks = spark.createDataFrame([(1, 1, [1.0, 0.0], "x" * 50)], "chunk_id int, document_id int, embedding array<double>, content string")
    plan = rt.dense_lists(spark.createDataFrame([(1, [1.0, 0.0])], "query_id int, query_embedding array<double>"), chunks)._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in plan and "content" not in plan.split("MapInArrow")[0] and not re.search(r"MapInArrow[^\n]*content", plan)


def test_sql_of_spans_leaves_no_tie(spark):
    """A span that stands twice changes nothing, in whatever order the copies come."""
    from quern.plans.metrics import MERGE

    assert "SELECT DISTINCT l_orderkey" in MERGE
    c = duckdb.connect()
    c.execute("CREATE TABLE lineitem AS SELECT i % 900 AS l_orderkey, i * 7 % 40 AS l_partkey, 3 + i % 2 AS l_quantity FROM range(40000) t(i)")
    got = sorted(c.execute(f'WITH {MERGE} SELECT key, "start", "end" FROM u').fetchall())
    rows = spark.createDataFrame(c.execute("SELECT l_orderkey, l_partkey % 200, l_partkey % 200 + l_quantity FROM lineitem").fetchall(), "key long, start long, end long")
    assert got == sorted(tuple(r) for r in ro.merge_spans(rows, ["key"]).select("key", "start", "end").collect())


def test_sql_of_questions_in_capitals(spark):
    """A sharp s in capitals is two letters, in the query and in its SQL."""
    from quern.plans.metrics import ASKED

    c = duckdb.connect()
    c.execute("CREATE TABLE kb_messages AS SELECT 10 AS thread_id, 1 AS turn, 'Großer Spaß' AS text")
    want = spark.createDataFrame([("Großer Spaß",)], "text string").select(F.upper("text")).first()[0]
    assert want in [r[0] for r in c.execute(f"WITH {ASKED} SELECT text FROM qs").fetchall()]


def test_texts_that_no_row_names_are_not_dealt(spark):
    chunks = spark.range(2000).selectExpr("id AS chunk_id", "id AS document_id", "repeat('w ', 200) AS content").repartition(3)
    rows = files.written(spark.createDataFrame([(1, 5), (1, 7), (2, 5)], "query_id long, chunk_id long"))
    df = rt.with_chunks(rows, chunks)
    assert sorted((r.query_id, r.chunk_id, r.document_id) for r in df.collect()) == [(1, 5, 5), (1, 7, 7), (2, 5, 5)]
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftSemi" in plan and "broadcast" in plan


def test_context_with_texts_joined_late(spark):
    texts = [f"passage {i} " + " ".join(f"w{(i * 7 + k * (1 + i % 5)) % 90}" for k in range(60)) for i in range(12)]
    rows = [(q, i, i % 4, 1, i, texts[i], 0.2 + 0.06 * ((i * 5 + q) % 11), p + 1) for q in (1, 2, 3) for p, i in enumerate(range(q, 12))]
    ranked = spark.createDataFrame(rows, "query_id long, chunk_id long, document_id long, page long, chunk_index long, content string, score double, position int")
    contents = spark.createDataFrame(list(enumerate(texts)), "chunk_id long, content string")
    got = [sorted(map(str, df.collect())) for df in (cx.build_context(ranked), cx.build_context(files.written(ranked.drop("content")), contents=contents))]
    assert got[0] == got[1] and len(got[0]) > 10


def test_shared_terms_read_texts_once(spark):
    df = QUERIES["set_03_shared_terms"](spark, SF)
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and plan.count("Relation") == 1


def test_text_overlap_equals_brute_force(spark):
    rng = random.Random(3)
    some = ["", "a" * 15, "a" * 16, "a" * 700, "ab" * 400, None] + ["".join(rng.choice("ab") for _ in range(rng.choice((20, 90, 900)))) for _ in range(20)]
    pairs = [(a, b) for a in some for b in some] + [(a, a[-n:] + b) for a in some[6:] for b in some[6:9] for n in (15, 16, 17, 600, 601)]
    want = [max((n for n in range(16, min(len(a), len(b), 600) + 1) if a[-n:] == b[:n]), default=0) if a and b else 0 for a, b in pairs]
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "i int, a string, b string").select("i", tx.text_overlap("a", "b").alias("n"))
    assert [r.n for r in df.orderBy("i").collect()] == want
    assert "sequence(" not in df._jdf.queryExecution().optimizedPlan().toString()  # no list of all lengths


def test_overlap_score_counts_repeats(spark):
    rows = [("alpha beta alpha gamma", "alpha gamma delta"), ("of the", "alpha"), ("alpha", ""), (None, "alpha"), ("alpha", None)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, q string, c string").select("i", tx.overlap_score("q", "c").alias("s"))
    assert [r.s for r in df.orderBy("i").collect()] == [0.75, 0.0, 0.0, None, 0.0]
    assert "array_intersect" in df._jdf.queryExecution().optimizedPlan().toString()  # not each word against each


def test_shingles_are_not_dealt(spark):
    plan = QUERIES["ev_05_shingles_jaccard"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "array_distinct" not in plan[plan.index("Join") :]  # shingles are made above the join


def test_candidates_that_are_not_near_are_not_dealt(spark, monkeypatch):
    rng = random.Random(8)
    phrase = [f"p{i}" for i in range(12)]
    texts = [phrase + [f"r{i}x{k}" for k in range(rng.choice((40, 160, 420)))] for i in range(60)]  # all share ten shingles, and are far apart
    texts += [[*t[:-4], "other", *t[-3:]] for t in texts[:20]]
    df = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "chunk_id long, content string")
    seen = {}
    monkeypatch.setattr(cx, "written", lambda x: seen.setdefault(tuple(x.columns), files.written(x)))
    got = {(r.a, r.b) for r in cx.near_duplicate_pairs(df).collect()}
    sets = [{tuple(t[i : i + 3]) for i in range(len(t) - 2)} for t in texts]
    assert got == {(a, b) for b in range(80) for a in range(b) if len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.82} and len(got) > 10
    assert seen["a", "b"].count() <= 2 * len(got)
