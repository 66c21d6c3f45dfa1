"""Rows that need care: null and repeated ids, repeated rows, very deep urls, and no label at all."""

import hashlib
import zlib

import numpy as np
from quern.llm import bpe_tree, license_rules, simhash, substring_dedup, token_files, url_filter
from quern.llm.queries import vocabulary

MIT = "Permission is hereby granted, free of charge. Released under the MIT License."
SHARED = " ".join(f"s{i}" for i in range(50))
TEXTS = [None, "", "same text here", "same text here", SHARED + " tail", "head " + SHARED, MIT, MIT, "<|endoftext|> ü", "x " * 9000]
IDS = [None, None, 5, 5, 7, None, 8, 8, None, 5]


def frame(spark, ids):
    return spark.createDataFrame([(i, t, "clash") for i, t in zip(ids, TEXTS, strict=True)], "doc_id long, text string, n_words string").repartition(3)


def by_text(spark, operator, ids):
    """The operator's rows without their ids, by the ids that were given."""
    return sorted((str(r[0]), str(tuple(r[1:]))) for r in operator(frame(spark, ids)).collect())


def test_ids_do_not_matter(spark):
    """Encoding, substring dedup and licences give each row what it has under an id of its own."""
    for operator in (lambda d: bpe_tree.encode_documents(d, vocabulary("byte_bpe_50k.json")), substring_dedup.remove_repeats, license_rules.scan):
        alone = {int(i): rest for i, rest in by_text(spark, operator, list(range(len(TEXTS))))}
        assert by_text(spark, operator, IDS) == sorted((str(i), alone[k]) for k, i in enumerate(IDS))


def test_simhash_with_null_and_repeated_ids(spark):
    alone = {r.doc_id: r for r in simhash.near_duplicates(frame(spark, list(range(len(TEXTS))))).collect()}
    groups = {}
    for k in alone:
        groups.setdefault(alone[k].component_id, []).append(IDS[k])
    want = sorted((str(IDS[k]), alone[k].fingerprint, str(min((i for i in groups[alone[k].component_id] if i is not None), default=None))) for k in alone)
    assert sorted((str(r.doc_id), r.fingerprint, str(r.component_id)) for r in simhash.near_duplicates(frame(spark, IDS)).collect()) == want


def test_token_files_with_null_and_repeated_ids(spark):
    from tokenizers import Tokenizer

    path = vocabulary("word_bpe_49k.json")
    tok = Tokenizer.from_file(path)
    got = sorted(token_files.token_files(frame(spark, IDS), path).collect(), key=lambda r: r.start)
    order = [-1 if r.doc_id is None else r.doc_id for r in got]
    assert order == sorted(order) and len(got) == len(TEXTS)
    assert [r.start for r in got] == list(np.cumsum([0, *(r.n_tokens for r in got)])[:-1])
    crc = lambda t: zlib.crc32(np.array([*tok.encode(t or "", add_special_tokens=False).ids, 2], "<u4").tobytes())
    assert sorted((str(r.doc_id), r.ids_crc32) for r in got) == sorted((str(i), crc(t)) for i, t in zip(IDS, TEXTS))


def jobs_of(spark, work):
    group = hashlib.sha256(str(work).encode()).hexdigest()
    spark.sparkContext.setJobGroup(group, "counted")
    try:
        out = work()
    finally:
        spark.sparkContext._jsc.clearJobGroup()
    return out, len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))


def test_a_deep_host_makes_no_job_per_level(spark):
    """A trap of a thousand segments with a sibling at each of many levels, beside a host with labels; page ids repeat and are null."""
    deep = [(9, "http://trap.edu/" + "/".join(["a"] * k + [f"p{'xyz'[k % 3]}"])) for k in range(1, 1000, 9)]
    plain = [(i, f"https://example.org/{'good' if i % 2 else 'bad'}/page/{i}") for i in range(60)] + [(None, "https://example.org/good/page/1"), (1, None), (1, "no scheme")]
    pages = spark.createDataFrame(deep + plain, "page_id long, url string").repartition(3)
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(60)], "doc_id long, quality int, toxic int")
    got, jobs = jobs_of(spark, lambda: url_filter.filter_urls(pages, labels).collect())
    assert len(got) == len(deep) + len(plain) and jobs < 60, jobs
    # a page's last segment differs from the way down, and is a wildcard, until the deepest page is alone
    depths = list(range(1, 1000, 9))
    want = {"/" + "/".join("*" if j in depths[:-1] or j == k else "a" for j in range(k + 1)) for k in depths[:-1]}
    trap = {r.template for r in got if r.host == "trap.edu"}
    assert {r.verdict for r in got if r.host == "trap.edu"} == {"allow"} and len(trap) == len(deep)
    assert trap - want == {max(trap, key=len)} and max(trap, key=len).count("/") == depths[-1] + 1
    assert {r.verdict for r in got if r.path.startswith("/bad")} == {"block"} and {r.verdict for r in got if r.path.startswith("/good")} == {"allow"}
    assert sorted(str(r.page_id) for r in got if r.path == "/good/page/1") == ["1", "None"]
    shallow = url_filter.filter_urls(pages, labels.limit(0)).collect()
    assert len(shallow) == len(got) and {r.purity for r in shallow} == {1.0}


def test_closed_nodes_get_the_names_that_levels_would_give(spark):
    """Without labels every level with several segments is a wildcard, and a group that is left alone keeps its names."""
    urls = {"http://h/a/b/c": "/*/b/*", "http://h/a/b/d": "/*/b/*", "http://h/e/b": "/*/b", "http://h/e/b/f/g/h": "/*/b/*/g/h", "http://h/": "/", "http://one/x/y": "/x/y"}
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = {r.page_id: r.template for r in url_filter.filter_urls(pages, labels).collect()}
    assert got == dict(enumerate(urls.values()))
