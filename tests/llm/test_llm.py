"""Operators against brute-force versions, exact round trips and held-out accuracy, and their edge cases."""

import hashlib
import math
import random
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from quern.llm import bpe_tree, common, decontam, exact_dedup, license_rules, quality, simhash, substring_dedup, token_files, toxicity, url_filter
from quern.llm.queries import vocabulary

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, keep string, fp int, row string, id int, n int"


def docs_of(spark, texts, ids=None):
    ids = range(len(texts)) if ids is None else ids
    return spark.createDataFrame([(i, t, None if k % 5 == 4 else "en", None if k % 7 == 6 else f"src{k % 3}", None, "x", 1, "r", 2, 3) for k, (i, t) in enumerate(zip(ids, texts, strict=True))], SCHEMA).repartition(3)


def words(rng, n, size=40):
    return " ".join(f"w{rng.randrange(size)}" for _ in range(n))


@pytest.fixture(scope="module")
def odd():
    """Null, empty, blank, repeated, non-ASCII and long texts, with shared passages."""
    rng = random.Random(5)
    passage, base = words(rng, 60, 500), words(rng, 120, 800)
    near = base.split()
    near[60] = "changed"
    return [None, "", "  \n\t", "One", "one", "ONE", base, base, " ".join(near), passage + " tail " + words(rng, 50, 900), words(rng, 44, 900) + " " + passage, "É É é", "ａｂｃ 日本語 text 12 ok", "x" * 30_000, words(rng, 6000, 3000), ("same " * 80).strip(), "a\x0bb\x1cc\x85d e　f g", "<|endoftext|> a <|startoftext|>b"]


def rows(df, key="doc_id"):
    return {r[key]: r for r in df.collect()}


def test_exact_dedup(spark, odd):
    got = rows(exact_dedup.exact_dedup(docs_of(spark, odd)))
    low = ["".join(c.lower() if "A" <= c <= "Z" else c for c in (t or "")) for t in odd]
    for i, t in enumerate(low):
        same = [j for j, u in enumerate(low) if u == t]
        r = got[i]
        assert (r.keep_id, r.group_size, r.kept, r.text_sha256) == (max(same), len(same), i == max(same), hashlib.sha256(t.encode()).hexdigest())


def test_exact_dedup_ties_history_and_empty(spark):
    df = docs_of(spark, ["a", "A", "b", "b", "c"], [None, None, 3, 3, 4])
    got = exact_dedup.exact_dedup(df).collect()
    assert sorted((r.keep_id or 0, r.group_size, r.kept) for r in got) == [(0, 2, True), (0, 2, True), (3, 2, True), (3, 2, True), (4, 1, True)]
    left = exact_dedup.drop_repeats(df)
    assert left.columns == df.columns and sorted(r.text.lower() for r in left.collect()) == ["a", "b", "c"]
    old = exact_dedup.distinct_digests(docs_of(spark, ["b"], [1]).select("doc_id", "text").withColumnRenamed("doc_id", "id").select("id", exact_dedup.text_digest(F.col("text")).alias("digest")))
    got = {(r.doc_id, r.keep_id, r.kept) for r in exact_dedup.exact_dedup(df.filter("doc_id > 2"), history=old).collect()}
    assert got == {(3, 1, False), (4, 4, True)}
    assert exact_dedup.exact_dedup(df.limit(0)).count() == 0


def test_drop_repeats_with_clashing_columns(spark):
    rows = [(1, "Same", "a", 1, {"k": 1}), (1, "same", "b", 2, {"k": 2}), (2, "same", "c", 3, None), (2, "SAME", "d", 4, None), (3, "other", "e", 5, {}), (None, "none", "f", 6, None), (None, "none", "g", 7, None), (None, None, "h", 8, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, _row_digest string, _kept_id long, digest map<string,int>").withColumns({c: F.lit(c) for c in ("id", "keep", "n", "row", "open", "kept", "place", "row_id", "_kept_digest")}).repartition(4)
    left = exact_dedup.drop_repeats(df)
    assert left.dtypes == df.dtypes
    assert {(r.doc_id, r.text, r._row_digest, r._kept_id) for r in left.collect()} == {(2, "same", "c", 3), (3, "other", "e", 5), (None, "none", "g", 7), (None, None, "h", 8)}


def test_exact_dedup_in_two_parts(spark, monkeypatch):
    rng, seen = random.Random(8), []
    monkeypatch.setattr(exact_dedup, "partitions", lambda spark: 7)
    monkeypatch.setattr(exact_dedup, "LEAST_DIGESTS", 4)
    monkeypatch.setattr(exact_dedup, "SALT_ROWS", 10)
    looked = exact_dedup.lookup
    monkeypatch.setattr(exact_dedup, "lookup", lambda rows, history: seen.append((rows.count(), history.count())) or looked(rows, history))
    texts = [f"t{rng.randrange(60)}" if i % 3 else "HOT" for i in range(300)]
    got = rows(exact_dedup.exact_dedup(docs_of(spark, texts)))
    for i, t in enumerate(texts):
        same = [j for j, u in enumerate(texts) if u == t]
        assert (got[i].keep_id, got[i].group_size, got[i].kept) == (max(same), len(same), i == max(same))
    assert 100 < seen[0][0] < 200 and seen[0][1] < seen[1][1] == len(set(texts)) and seen[1][0] == 300


def test_perfect_hash_is_minimal_and_rejects_others():
    keys = np.frombuffer(b"".join(hashlib.sha256(str(i).encode()).digest() for i in range(5000)), "V32")
    sizes, bits, slots = exact_dedup.PerfectHash.build(keys)
    assert sorted(slots) == list(range(5000))
    table = exact_dedup.PerfectHash(sizes, bits, keys[np.argsort(slots)].tobytes())
    assert (table.find(keys) == slots).all()
    others = np.frombuffer(b"".join(hashlib.sha256(f"x{i}".encode()).digest() for i in range(5000)), "V32")
    assert (table.find(others) == -1).all()


def plain_fingerprint(text):
    w = "".join(c.lower() if "A" <= c <= "Z" else c for c in (text or "")).encode().split()
    if not w:
        return 0
    s = [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or [b" ".join(w)]
    h = [xxhash.xxh64_intdigest(x, 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(fps):
    ids, root = list(range(len(fps))), list(range(len(fps)))
    for i in ids:
        for j in ids[:i]:
            if bin(fps[i] ^ fps[j]).count("1") <= 3 and root[i] != root[j]:
                a, b = sorted((root[i], root[j]))
                root = [a if x == b else x for x in root]
    return root


def test_simhash(spark, odd):
    fps = [plain_fingerprint(t) for t in odd]
    want, got = plain_components(fps), rows(simhash.near_duplicates(docs_of(spark, odd)))
    assert [(got[i].fingerprint, got[i].component_id) for i in range(len(odd))] == [(f"{fps[i]:016x}", want[i]) for i in range(len(odd))]
    assert got[0].component_id == got[1].component_id == got[2].component_id == 0
    assert simhash.near_duplicates(docs_of(spark, ["a"]).limit(0)).count() == 0


@pytest.mark.parametrize("shard", [2048, 2])
def test_simhash_links_lose_none(spark, monkeypatch, shard):
    monkeypatch.setattr(simhash, "SHARD", shard)
    rng, fps = random.Random(3), []
    for _ in range(30):
        x = rng.getrandbits(64)
        for _ in range(rng.randrange(1, 8)):
            fps.append(x)
            for b in rng.sample(range(64), rng.randrange(1, 5)):
                x ^= 1 << b
    fps = list(dict.fromkeys(fps))
    nodes = spark.createDataFrame([(simhash._signed(x),) for x in fps], "fp long")
    got = {r.node: r.root for r in simhash.components(simhash.links(nodes)).collect()}
    label = [got.get(simhash._signed(x), simhash._signed(x)) for x in fps]
    want = plain_components(fps)
    assert all((label[i] == label[j]) == (want[i] == want[j]) for i in range(len(fps)) for j in range(i))


def test_decontam(spark, odd):
    items = [("7", odd[6]), ("10", " ".join(odd[9].split()[:20])), ("8", "One!"), ("9", None), ("11", " ...  "), ("12", "ＡＢＣ 日本語 text 12"), ("7", odd[14][:400].upper())]
    bench = spark.createDataFrame(items, "item_id string, text string")
    got = rows(decontam.decontaminate(docs_of(spark, odd), bench))
    for i, t in enumerate(odd):
        n, hit, found, near = decontam.brute_force(t, items)
        r = got[i]
        assert (r.n_words, r.n_hit, r.n_items, r["items"], r.n_near_items) == (n, hit, len(found), found, len(near))
        assert r.items_sha256 == hashlib.sha256(",".join(found).encode()).hexdigest() and r.contaminated == (hit > 0 and 20 * hit >= n)
    assert not any(r.contaminated for r in decontam.decontaminate(docs_of(spark, odd), bench.limit(0)).collect())
    assert decontam.decontaminate(docs_of(spark, odd).limit(0), bench).count() == 0


def test_decontam_in_blocks_and_near(spark, odd, monkeypatch):
    items = [(k, " ".join(odd[14].split()[k : k + 20])) for k in range(0, 400, 9)]
    bench = spark.createDataFrame(items, "item_id int, text string")
    want = rows(decontam.decontaminate(docs_of(spark, odd), bench))
    monkeypatch.setattr(decontam, "BLOCK_BYTES", 1500)
    monkeypatch.setattr(decontam, "SEGMENT_BYTES", 600)
    got = rows(decontam.decontaminate(docs_of(spark, odd), bench))
    assert got == want and got[14].n_hit > 300
    w = odd[14].split()[50:70]
    w.insert(10, "inserted")
    near = spark.createDataFrame([(1, " ".join(w[3:16]))], "item_id int, text string")
    r = rows(decontam.decontaminate(docs_of(spark, [*odd, odd[14].replace(" ".join(odd[14].split()[58:62]), " ".join(w[8:13]))]), near))
    assert r[14].n_items == 0 and r[len(odd)].n_items == 1


def test_decontam_proximity_equals_brute_force(spark):
    rng, pick = random.Random(12), lambda n: " ".join(rng.choice("abcdefg") for _ in range(n))
    texts = ["zzz", "a c b", None, "", "b c", *(pick(rng.randrange(1, 25)) for _ in range(60))]
    items = [("1", "a b c"), ("2", "g g a"), *((str(k), pick(rng.choice([1, 4, 6, 15]))) for k in range(3, 14))]
    got = rows(decontam.decontaminate(docs_of(spark, texts), spark.createDataFrame(items, "item_id string, text string")))
    for i, t in enumerate(texts):
        n, hit, found, near = decontam.brute_force(t, items)
        assert (got[i].n_words, got[i].n_hit, got[i]["items"], got[i].n_near_items) == (n, hit, found, len(near)), t
    assert sum(r.n_near_items > r.n_items for r in got.values()) > 10


def test_decontam_in_blocks_of_unequal_files(spark, monkeypatch):
    rng = random.Random(7)
    texts = [" ".join(f"d{i}x{rng.randrange(10 ** 6)}" for _ in range(900)) for i in range(24)]
    items = [(f"{i}-{k}", " ".join(t.split()[30 * k : 30 * k + 20])) for i, t in enumerate(texts) for k in range(1 + i)]
    docs, bench = docs_of(spark, [*texts, texts[0], None], [*range(24), None, None]), spark.createDataFrame(items, "item_id string, text string")
    want = sorted(str(r) for r in decontam.decontaminate(docs, bench).collect())
    monkeypatch.setattr(decontam, "BLOCK_BYTES", 8000)
    got = decontam.decontaminate(docs, bench).collect()
    assert sorted(str(r) for r in got) == want
    for r in got:
        assert r.doc_id is None or (r.n_words, r.n_hit, r["items"]) == (900, 20 * (1 + r.doc_id), sorted(f"{r.doc_id}-{k}" for k in range(1 + r.doc_id)))


def test_token_files(spark, odd):
    from tokenizers import Tokenizer

    path = vocabulary("word_bpe_49k.json")
    tok, start = Tokenizer.from_file(path), 0
    got = rows(token_files.token_files(docs_of(spark, odd), path))
    for i, t in enumerate(odd):
        ids = [*tok.encode(t or "", add_special_tokens=False).ids, 2]
        assert (got[i].start, got[i].n_tokens, got[i].ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    assert token_files.token_files(docs_of(spark, odd).limit(0), path).count() == 0


def test_token_files_random_access(spark, odd, tmp_path):
    from tokenizers import Tokenizer

    path = vocabulary("word_bpe_49k.json")
    tok = Tokenizer.from_file(path)
    files = token_files.write_tokens(docs_of(spark, odd).coalesce(1), path, 2, str(tmp_path), length=64).orderBy("part").collect()
    ids = [x for t in odd for x in [*tok.encode(t or "", add_special_tokens=False).ids, 2]]
    back = []
    for f in files:
        t = token_files.TokenFile(f.path + ".tokens.arrow")
        for i in range(f.n_sequences):
            s, m = t.sequence(i)
            assert len(s) == len(m) == 64
            back += s[np.array(m.to_pylist())].tolist()
    assert back == ids and sum(f.n_tokens for f in files) == len(ids)


def test_bpe_tree(spark, odd, monkeypatch):
    from tokenizers import Tokenizer

    path = vocabulary("byte_bpe_50k.json")
    tok = Tokenizer.from_file(path)
    monkeypatch.setattr(bpe_tree, "LEAF", 100)
    more = [*odd, "don't" * 300, "12 " * 400, "!?'s" * 200, " " * 1000 + "a", "日本" * 700]
    got = rows(bpe_tree.encode_documents(docs_of(spark, more), path, keep_ids=True))
    for i, t in enumerate(more):
        ids = tok.encode(t or "", add_special_tokens=False).ids
        assert got[i].ids == ids and got[i].n_tokens == len(ids)
        assert got[i].ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256(tok.decode(ids, skip_special_tokens=False).encode()).hexdigest() and got[i].decoded == (t or "")
    assert bpe_tree.encode_documents(docs_of(spark, odd).limit(0), path).count() == 0


def test_bpe_join_is_exact():
    code, rng = bpe_tree.codec(vocabulary("byte_bpe_50k.json")), random.Random(11)
    kinds = ["abcdefghijklmnopqrstuvwxyz", "ab '", "éèß the of ing", "!?'s 're 12 ", "  \n\t a", "日本語テキスト", "0123456789", "!!!!==--'"]
    for _ in range(400):
        pick = rng.choice(kinds)
        t = "".join(rng.choice(pick if rng.random() < 0.9 else rng.choice(kinds)) for _ in range(rng.randrange(700)))
        got = bpe_tree.fold(code, [bpe_tree.Piece(x, code.encode(x)) for x in bpe_tree.halves(t, rng.choice([16, 60, 200]))])
        assert got.tolist() == code.encode(t).tolist()


def test_substring_dedup(spark, odd, monkeypatch):
    want, seen = {}, {}
    cut = [(t or "").encode().split() for t in odd]
    for i, w in enumerate(cut):
        for k in range(len(w) - 34):
            seen.setdefault(tuple(w[k : k + 35]), []).append((i, k))
    gone = [set() for _ in odd]
    for at in seen.values():
        if len(at) > 1:
            for i, k in at:
                gone[i].update(range(k, k + 35))
    want = {i: (len(w), len(gone[i]), hashlib.sha256(b" ".join(x for k, x in enumerate(w) if k not in gone[i])).hexdigest()) for i, w in enumerate(cut)}
    assert sum(x[1] for x in want.values()) > 400
    for unit, block in ((1 << 30, substring_dedup.BLOCK), (900, 20)):
        for name, x in (("UNIT_BYTES", unit), ("PAGE_BYTES", unit // 2), ("SHARD_BYTES", unit // 4), ("BUCKET_BYTES", unit // 3), ("BLOCK", block), ("REMEMBERED", 3)):
            monkeypatch.setattr(substring_dedup, name, x)
        got = rows(substring_dedup.remove_repeats(docs_of(spark, odd)))
        assert {i: (r.n_words, r.n_removed, r.kept_sha256) for i, r in got.items()} == want
    assert substring_dedup.remove_repeats(docs_of(spark, odd).limit(0)).count() == 0


def test_sketch_never_underestimates():
    rng = np.random.default_rng(2)
    h = rng.integers(0, 1 << 63, 5000).astype(np.uint64)
    parts = [rng.choice(h, n, replace=False) for n in (2000, 1500, 900)]
    more = [(rng.random(len(p)) < 0.1).astype(np.uint8) for p in parts]
    width = substring_dedup.sketch_width(substring_dedup.ANCHOR_BYTES * sum(map(len, parts)))
    merged = np.zeros((substring_dedup.DEPTH, width), int)
    for p, m in zip(parts, more, strict=True):
        order = np.argsort(p)
        for row, (cells, twice) in enumerate(substring_dedup.sketch(p[order], 1 + m[order], width)):
            assert (np.diff(cells.astype(np.int64)) > 0).all()
            merged[row, cells.astype(np.int64)] += 1 + twice
    times = {}
    for p, m in zip(parts, more, strict=True):
        for x, twice in zip(p.tolist(), m.tolist(), strict=True):
            times[x] = times.get(x, 0) + 1 + twice
    said = dict(zip(h.tolist(), np.logical_and.reduce([merged[r, substring_dedup._cells(h, width, r).astype(np.int64)] > 1 for r in range(substring_dedup.DEPTH)]).tolist(), strict=True))
    for x in (h[:0], h[:1], np.sort(h[:2]), np.unique(h), np.array([5, 5, 6, 2**64 - 1], np.uint64)):
        assert (substring_dedup.unpack(substring_dedup.pack(x)) == x).all() and len(substring_dedup.pack(np.unique(h))) < 8 * len(h)
    assert all(said[x] for x, n in times.items() if n > 1)
    assert sum(said[x] for x, n in times.items() if n == 1) < 0.03 * len(times)


def test_a_passage_in_every_unit_and_block(spark, monkeypatch):
    """One anchor stands in every unit's sketch and one digest in every block, and nothing else repeats; with sketches so small that all cells are shared, too."""
    rng = random.Random(3)
    passage = words(rng, 40, 400)
    texts = [" ".join(f"d{i}x{rng.randrange(10**7)}" for _ in range(50)) + " " + passage + f" end{i}" for i in range(60)]
    for cells in (4, 1):
        for name, x in (("UNIT_BYTES", 600), ("PAGE_BYTES", 300), ("SHARD_BYTES", 2000), ("BUCKET_BYTES", 2000), ("BLOCK", 6), ("CELLS", cells), ("ANCHOR_BYTES", 72 if cells > 1 else 10**6)):
            monkeypatch.setattr(substring_dedup, name, x)
        got = rows(substring_dedup.remove_repeats(docs_of(spark, texts)))
        for i, t in enumerate(texts):
            kept = [*t.split()[:50], f"end{i}"]
            assert (got[i].n_words, got[i].n_removed, got[i].kept_sha256) == (91, 40, hashlib.sha256(" ".join(kept).encode()).hexdigest())


@pytest.mark.parametrize(("broadcast", "hot"), [(100, 5), (2, 5), (0, 5), (2, 1)])
def test_join_counted_gives_the_join(spark, monkeypatch, broadcast, hot):
    monkeypatch.setattr(common, "BROADCAST_ROWS", broadcast)
    monkeypatch.setattr(common, "HOT_ROWS", hot)
    left = spark.createDataFrame([(k, i) for i, k in enumerate([1] * 40 + [2] * 9 + [3, 4, 4, 9])], "k int, i int")
    side = spark.createDataFrame([(1, 40, "a"), (2, 9, "b"), (3, 1, "c"), (4, 2, "d"), (5, 0, "e")], "k int, n long, v string")
    got = common.join_counted(left, side, ["k"], "n")
    assert got.columns == ["k", "i", "n", "v"] and sorted(map(tuple, got.collect())) == sorted(map(tuple, left.join(side, "k").collect()))


def test_labelled_rows_are_bounded(spark):
    docs = spark.createDataFrame([(1, "a"), (1, "b"), (1, None), (2, "c"), (None, "d"), (3, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, 1), (3, 1), (None, 1), (4, 0), (2, None)], "doc_id long, quality int")
    got = common.labelled(docs, labels, F.col("quality"), "doc_id", "text", 10)
    assert sorted((r.mark, r.text in ("a", "b", "") if r.mark == 0 else r.text) for r in got.collect()) == [(0, True), (1, ""), (1, "c")]
    assert common.labelled(docs, labels, F.col("quality"), "doc_id", "text", 1).count() <= 1


def test_quality_held_out(spark):
    docs, labels = spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    half = labels.filter("doc_id % 2 = 0")
    truth = {r.doc_id: r.quality for r in labels.filter("doc_id % 2 = 1").collect()}
    got = rows(quality.classify(docs, half))
    assert sum(got[i].kept == bool(q) for i, q in truth.items()) / len(truth) > 0.93
    assert all(0 <= r.p_quality <= 1 for r in got.values()) and len(got) == docs.count()


def test_quality_shrinks_and_edges(spark, odd):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    assert len(rows(quality.classify(docs_of(spark, odd), labels))) == len(odd)
    none = quality.classify(docs_of(spark, odd), labels.limit(0))
    assert all(r.kept for r in none.collect())
    assert quality.classify(docs_of(spark, odd).limit(0), labels).count() == 0
    rate = rows(quality.classify(spark.read.parquet(f"{SF}/documents.parquet"), labels))
    assert len({r.path_rate for r in rate.values()}) > 5


def test_quality_posterior_equals_brute_force(spark):
    df = spark.read.parquet(f"{SF}/documents.parquet").withColumn("source", F.expr("CASE WHEN doc_id % 3 = 0 THEN 'hot/a' WHEN doc_id % 7 = 0 THEN NULL ELSE concat(source, '/p', doc_id % 11) END"))
    got = quality.classify(df, spark.read.parquet(f"{SF}/labels.parquet")).join(df.select("doc_id", "source", "lang"), "doc_id").collect()
    site = lambda r: ((r.source or "").split("/")[0], ((r.source or "").split("/")[1:], r.lang))
    of, mean = {}, sum(r.evidence for r in got) / len(got)
    for r in got:
        for k in (site(r)[0], str(site(r))):
            of.setdefault(k, []).append(r.evidence)

    def strength(sites):
        sites = [(sum(e), len(e), prior) for e, prior in sites if len(e) >= 2]
        n = sum(m for _, m, _ in sites)
        tau2 = max((sum(m * (g / m - p) ** 2 for g, m, p in sites) - sum(p * (1 - p) for *_, p in sites)) / n, 1e-6)
        return min(max(sum(p * (1 - p) * m for _, m, p in sites) / n / tau2 - 1, 1), 1e6)

    hosts = {site(r)[0] for r in got}
    a = strength([(of[h], mean) for h in hosts])
    rate = {h: (sum(of[h]) + a * mean) / (len(of[h]) + a) for h in hosts}
    b = strength([(of[k], rate[h]) for h, k in {(site(r)[0], str(site(r))) for r in got}])
    logit = lambda p: math.log(min(max(p, 1e-9), 1 - 1e-9) / (1 - min(max(p, 1e-9), 1 - 1e-9)))
    for r in got:
        h, p = of[site(r)[0]], of[str(site(r))]
        host = (sum(h) - r.evidence + a * mean) / (len(h) - 1 + a)
        path = (sum(p) - r.evidence + b * host) / (len(p) - 1 + b)
        want = 1 / (1 + math.exp(logit(mean) - logit(r.evidence) - logit(path)))
        assert (r.host_rate, r.path_rate) == pytest.approx((host, path), abs=1e-4) and r.p_quality == pytest.approx(want, abs=2e-3)


def test_cumulative_link_reaches_the_least_loss():
    rng = np.random.default_rng(3)
    rows = [sorted(rng.choice(6, rng.integers(0, 5), replace=False).tolist()) for _ in range(300)]
    grades = np.array([min(2, sum(i < 2 for i in r)) if rng.random() < 0.9 else int(rng.integers(3)) for r in rows])
    model = toxicity.CumulativeLink(rows, grades, 6, rounds=4000, rate=0.02)

    def loss(w, theta):
        p = 1 / (1 + np.exp(-(np.array([w[r].sum() for r in rows])[:, None] - theta)))
        over = grades[:, None] > np.arange(2)
        return -np.where(over, np.log(p), np.log(1 - p)).sum() / len(rows) + (w**2).sum() / (20 * len(rows))

    best = loss(model.w, model.theta)
    assert (model.w >= 0).all() and model.theta[0] <= model.theta[1] and model.w[:2].min() > model.w[2:].max()
    for _ in range(300):
        assert loss(np.maximum(model.w + rng.normal(0, 0.05, 6), 0), np.maximum.accumulate(model.theta + rng.normal(0, 0.05, 2))) > best - 1e-5


def test_severity_comes_from_other_folds():
    rng = np.random.default_rng(5)
    rows = [[0, 1] if i % 7 == 0 else [0] if i % 7 in (1, 2) else [2] if rng.random() < 0.5 else [] for i in range(700)]
    toxic = np.array([int(i % 7 < 3 and i % 35 != 1) for i in range(700)])
    grades = toxicity.severity(rows, toxic, 3, np.arange(700) % 5)
    assert (grades[toxic == 0] == 0).all() and set(grades[toxic == 1]) == {1, 2} and (grades[::7] == 2).all()


def test_toxicity_held_out(spark, odd):
    docs, labels = spark.read.parquet("/root/testdata/sf0.1/documents.parquet"), spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    truth = labels.filter("doc_id % 2 = 1")
    scored = rows(toxicity.score(docs, labels.filter("doc_id % 2 = 0")))
    pairs = [(scored[r.doc_id].toxic, bool(r.toxic)) for r in truth.collect()]
    hit, said, there = sum(a and b for a, b in pairs), sum(a for a, _ in pairs), sum(b for _, b in pairs)
    assert hit / said > 0.95 and hit / there > 0.85
    assert all(r.p_over_0 >= r.p_over_1 and abs(r.expected_severity - r.p_over_0 - r.p_over_1) < 3e-6 for r in scored.values())
    edge = rows(toxicity.score(docs_of(spark, odd), labels))
    assert len(edge) == len(odd) and not any(r.toxic for r in edge.values())
    assert toxicity.score(docs_of(spark, odd).limit(0), labels).count() == 0


def test_toxicity_does_not_depend_on_partitions(spark):
    """At a size where the sample lies in many partitions; every row is compared."""
    sf, found = "/root/testdata/sf0.1", []
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    for n in (4, 11):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet").repartition(n, F.rand(n)) for t in ("documents", "labels"))
        found.append(sorted(tuple(r) for r in toxicity.score(docs, labels).collect()))
    spark.conf.set("spark.sql.shuffle.partitions", 4)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert len(found[0]) == 10_000 and found[0] == found[1]


def test_toxicity_equals_brute_force(spark):
    """Every step again from its definition over plain lists; only the fit itself, which has its own test, is shared."""
    sf = "/root/testdata/sf0.001"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    text, mark = {r.doc_id: r.text or "" for r in docs.collect()}, {r.doc_id: int(r.toxic > 0) for r in labels.collect()}
    key = {i: xxhash.xxh64_intdigest(i.to_bytes(8, "little"), 42) for i in mark}
    key = {i: k - (k >> 63 << 64) for i, k in key.items()}
    sample = [(key[i], mark[i], toxicity.terms_of(text[i].encode())) for i in mark if i in text]
    size = {m: sum(t == m for _, t, _ in sample) for m in (0, 1)}
    z = {}
    for term in {t for *_, ts in sample for t in ts}:
        a, b = (sum(m == k and term in ts for _, m, ts in sample) for k in (1, 0))
        if a + b >= 5:
            pull = math.log((a + 0.5) / (size[1] - a + 0.5)) - math.log((b + 0.5) / (size[0] - b + 0.5))
            z[term] = pull / math.sqrt(1 / (a + 0.5) + 1 / (b + 0.5))
    clear = {t for t in z if z[t] >= 0.75 * math.sqrt(2 * math.log(len(z)))} | set(sorted(z, key=lambda t: (-z[t], t))[:20])
    number = {t: i for i, t in enumerate(sorted(clear))}
    rows_ = sorted((k, m, sorted(number[t] for t in ts & clear)) for k, m, ts in sample)
    held, toxic, fold = [r[2] for r in rows_], np.array([r[1] for r in rows_]), np.array([r[0] % toxicity.FOLDS for r in rows_])
    apart = np.zeros(len(held))
    for k in set(fold.tolist()):
        model = toxicity.CumulativeLink([h for h, f in zip(held, fold) if f != k], toxic[fold != k], len(number))
        for i in np.flatnonzero(fold == k):
            apart[i] = 1 / (1 + math.exp(model.theta[0] - sum(model.w[j] for j in held[i])))
    grades = toxic + ((toxic > 0) & (apart > np.median(apart[toxic > 0])))
    model = toxicity.CumulativeLink(held, grades, len(number))
    got = rows(toxicity.score(docs, labels))
    for i, t in text.items():
        s = sum(model.w[number[x]] for x in toxicity.terms_of(t.encode()) if x in number)
        p = [1 / (1 + math.exp(c - s)) for c in model.theta]
        r = got[i]
        assert abs(r.p_over_0 - p[0]) < 2e-6 and abs(r.p_over_1 - p[1]) < 2e-6 and abs(r.expected_severity - sum(p)) < 3e-6
        assert r.grade == sum(x >= 0.5 for x in p) and r.toxic == (r.grade > 0)


def test_decontam_repeated_passages_are_one_block(spark, odd, monkeypatch):
    items = [(1, "  ".join(odd[14].split()[:20]))] * 200 + [(2, " ".join(odd[14].split()[40:60]))]
    bench = spark.createDataFrame(items, "item_id int, text string")
    want = rows(decontam.decontaminate(docs_of(spark, odd), bench.distinct()))
    monkeypatch.setattr(decontam, "BLOCK_BYTES", 1000)
    made, build = [], decontam.build_index
    monkeypatch.setattr(decontam, "build_index", lambda *a: made.append(1) or build(*a))
    assert rows(decontam.decontaminate(docs_of(spark, odd), bench)) == want and len(made) == 1
    monkeypatch.setattr(decontam, "BLOCK_BYTES", 20)  # more blocks than passages
    assert rows(decontam.decontaminate(docs_of(spark, odd), bench)) == want and len(made) <= 1 + 3


def test_license_rules(spark, odd):
    mit = " ".join(s + "." for k in ("mit-grant", "mit-notice", "mit-warranty") for s in license_rules.SENTENCES[k])
    texts = [mit, "Foo.\nLicensed under the Apache License, Version 2.0.", "bar. Released under the MIT License. baz\nLicensed under CC BY-NC 4.0.", "permission is hereby granted", *odd]
    got = rows(license_rules.scan(docs_of(spark, texts)))
    assert [got[i].licenses for i in range(4)] == ["MIT", "Apache-2.0", "MIT,CC-BY-NC-4.0", ""] and got[0].rules == "mit-full"
    assert got[2].sequence == "?<mit-ref>?<cc-by-nc-ref>" and all(got[i + 4].n_known == 0 for i in range(len(odd)))
    assert license_rules.scan(docs_of(spark, odd).limit(0)).count() == 0


def licences_over_lines():
    import textwrap

    s = {k: v[0] for k, v in license_rules.SENTENCES.items()}
    wrap = lambda t, first="", rest="": textwrap.fill(t, 76, initial_indent=first, subsequent_indent=rest)
    bsd = ["bsd-source", "bsd-binary", "bsd-name"]
    numbered = lambda n, mark: "\n".join([wrap(s["bsd-grant"] + ":"), "", *(wrap(s[k] + ".", mark.format(i + 1), "   ") for i, k in enumerate(bsd[:n]))])
    gpl = "\n *\n".join(wrap(t, " * ", " * ") for t in (f"{s['gpl-free']}: {s['gpl3-modify']}.", f"{s['gpl-hope']}; without even the implied warranty."))
    texts = [
        "MIT License\n\nCopyright (c) 2020 A\n\n" + "\n\n".join(wrap(s[k] + e) for k, e in (("mit-grant", ":"), ("mit-notice", "."), ("mit-warranty", "."))), wrap(s["isc-grant"] + ".") + "\n\n" + wrap(s["isc-warranty"] + ". IN NO EVENT"),
        numbered(2, "1. ".replace("1", "{}")), numbered(3, "{}) "), numbered(3, "* "), f"/*\n{gpl}\n */", "Title\nReleased under the MIT License\nmore words\n", "Foo\r\nReleased under the MIT License\r\n\r\nBar",
        "2.0", "Version: 2.0", "X: MIT", "This Source Code Form is subject to the terms of the Mozilla Public License, v.\n2.0.", "# SPDX-License-Identifier: MIT\nimport x", "Released under the MIT\n\nLicense",
        "Licensed under the GNU General Public License, version\n3. Other words.", "Released under the MIT License of sorts.", "x\x02MIT\x02y",
    ]
    return texts


def test_license_rules_over_lines(spark):
    texts = licences_over_lines()
    got = rows(license_rules.scan(docs_of(spark, texts)))
    assert [got[i].licenses for i in range(len(texts))] == ["MIT", "ISC", "BSD-2-Clause", "BSD-3-Clause", "BSD-3-Clause", "GPL-3.0-or-later", "MIT", "MIT", "", "", "", "MPL-2.0", "MIT", "", "GPL-3.0-only", "", ""]
    assert [got[i].rules for i in range(6)] == ["mit-full,mit", "isc-full", "bsd-2-full", "bsd-3-full", "bsd-3-full", "gpl-3-header"] and got[2].n_known == 3 and got[8].sequence == "?"


#: Texts as they stand in well-known files, typed here independently of the table, with the licence of each.
TYPED = [
    ("Permission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files (the \"Software\"), to deal\nin the Software without restriction, including without limitation the rights\nto use, copy, modify, merge, publish, distribute, sublicense, and/or sell\ncopies of the Software, and to permit persons to whom the Software is\nfurnished to do so, subject to the following conditions:\n\nThe above copyright notice and this permission notice shall be included in all\ncopies or substantial portions of the Software.\n\nTHE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR\nIMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,\nFITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE\nAUTHORS BE LIABLE.", "MIT"),
    ("   Licensed under the Apache License, Version 2.0 (the \"License\");\n   you may not use this file except in compliance with the License.\n   You may obtain a copy of the License at\n\n       http://www.apache.org/licenses/LICENSE-2.0\n", "Apache-2.0"),
    ("                                 Apache License\n                           Version 2.0, January 2004\n                        http://www.apache.org/licenses/\n\n   TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION\n", "Apache-2.0"),
    ("# This program is free software: you can redistribute it and/or modify\n# it under the terms of the GNU General Public License as published by\n# the Free Software Foundation, either version 3 of the License, or\n# (at your option) any later version.\n#\n# This program is distributed in the hope that it will be useful,\n# but WITHOUT ANY WARRANTY; without even the implied warranty of\n", "GPL-3.0-or-later"),
    (" * This program is free software; you can redistribute it and/or modify\n * it under the terms of the GNU General Public License as published by\n * the Free Software Foundation; either version 2 of the License, or\n * (at your option) any later version.\n", "GPL-2.0-or-later"),
    ("// This library is free software; you can redistribute it and/or\n// modify it under the terms of the GNU Lesser General Public\n// License as published by the Free Software Foundation; either\n// version 2.1 of the License, or (at your option) any later version.\n", "LGPL-2.1-or-later"),
    ("    This program is free software: you can redistribute it and/or modify\n    it under the terms of the GNU Affero General Public License as published by\n    the Free Software Foundation, either version 3 of the License, or\n    (at your option) any later version.\n", "AGPL-3.0-or-later"),
    ("/* This Source Code Form is subject to the terms of the Mozilla Public\n * License, v. 2.0. If a copy of the MPL was not distributed with this\n * file, You can obtain one at http://mozilla.org/MPL/2.0/. */", "MPL-2.0"),
    ("                    GNU GENERAL PUBLIC LICENSE\n                       Version 3, 29 June 2007\n\n Copyright (C) 2007", "GPL-3.0-only"),
    ("This is free and unencumbered software released into the public domain.\n\nAnyone is free to copy, modify, publish, use, compile, sell, or\ndistribute this software, either in source code form or as a compiled\nbinary, for any purpose, commercial or non-commercial, and by any\nmeans.\n", "Unlicense"),
    ("  This software is provided 'as-is', without any express or implied\n  warranty.  In no event will the authors be held liable for any damages\n  arising from the use of this software.\n\n  Permission is granted to anyone to use this software for any purpose,\n  including commercial applications, and to alter it and redistribute it\n  freely, subject to the following restrictions:\n", "Zlib"),
    ("//          Distributed under the Boost Software License, Version 1.0.\n//    (See accompanying file LICENSE_1_0.txt)", "BSL-1.0"),
    ("/* SPDX-License-Identifier: GPL-2.0-or-later */\n", "GPL-2.0-or-later"),
    ("Redistribution and use in source and binary forms, with or without\nmodification, are permitted provided that the following conditions are met:\n\n1. Redistributions of source code must retain the above copyright notice, this\n   list of conditions and the following disclaimer.\n\n2. Redistributions in binary form must reproduce the above copyright notice,\n   this list of conditions and the following disclaimer in the documentation\n   and/or other materials provided with the distribution.\n\nTHIS SOFTWARE", "BSD-2-Clause"),
    ("changes\n2.0\n1.9\nMIT\nGrades: MIT.\nmit.", ""), ("We talked about the MIT License of sorts and the GNU project", ""),
]


#: Short notices in people's own words.
NOTICES = [
    ("Distributed under the MIT License. See LICENSE for more information.", "MIT"), ("This code is licensed under the MIT license.", "MIT"), ("Licensed under MIT", "MIT"), ('{\n  "name": "foo",\n  "license": "MIT",\n  "main": "x.js"\n}', "MIT"),
    ("// SPDX-License-Identifier: Apache-2.0 OR MIT\nfn main() {}", "MIT,Apache-2.0"), ("License: Apache 2.0", "Apache-2.0"), ("/* SPDX-License-Identifier: (GPL-2.0-or-later WITH Classpath-exception-2.0 AND MIT) */", "MIT,GPL-2.0-or-later"),
    ("GNU Foo is free software: you can redistribute it and/or modify\nit under the terms of the GNU General Public License as published by\nthe Free Software Foundation, either version 3 of the License, or\n(at your option) any later version.\n\nGNU Foo is distributed in the hope that it will be useful,\nbut WITHOUT ANY WARRANTY; without even", "GPL-3.0-or-later"),
    ("This project is released under the terms of the BSD 3-Clause\nLicense.", "BSD-3-Clause"), ("foo, the best tool, is available under the Apache License 2.0.", "Apache-2.0"), ("Licence\n\nThe source code is licensed under the ISC licence, see LICENSE.md.", "ISC"),
    ("This software is published under the GPLv3+", "GPL-3.0-or-later"), ("The data are licensed under CC BY-SA 4.0!", "CC-BY-SA-4.0"), ("This project is licensed under the MIT License - see the [LICENSE.md](LICENSE.md) file for details", "MIT"), ("This project is licensed under the MIT License - see the LICENSE file for details", "MIT"),
    ("one two three four five six seven eight is licensed under the MIT License", ""), ("MIT is a school. Licensed to nobody under the sun", ""), ("SPDX-License-Identifier: Foo-1.0", ""), ("a license: none", ""),
]


def test_license_notices(spark):
    got = rows(license_rules.scan(docs_of(spark, [t for t, _ in NOTICES])))
    assert [got[i].licenses for i in range(len(NOTICES))] == [x for _, x in NOTICES]


def test_license_texts_typed_by_hand(spark):
    got = rows(license_rules.scan(docs_of(spark, [t for t, _ in TYPED])))
    assert [got[i].licenses for i in range(len(TYPED))] == [x for _, x in TYPED]


def test_license_sql_equals_query(spark, odd):
    import duckdb

    texts = [*licences_over_lines(), *(t for t, _ in TYPED), *(t for t, _ in NOTICES), *odd]
    got = rows(license_rules.scan(docs_of(spark, texts)))
    c = duckdb.connect()
    c.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    c.executemany("INSERT INTO documents VALUES (?, ?)", [list(x) for x in enumerate(texts)])
    found = c.execute(license_rules.scan_sql())
    names = [d[0] for d in found.description]
    for r in map(lambda x: dict(zip(names, x, strict=True)), found.fetchall()):
        assert got[r["doc_id"]].asDict() == r


def test_url_filter(spark):
    urls = [None, "", "no scheme", "http://Example.NET/en/1", "http://a.example.net/de/2", "https://x.example.com/de/3?x", "http://y.org/fr/4#a", "http://y.org", "http://z.com/a/b/c/d/e/f/99999", "http://net/1", "http://xnet/1"]
    pages = spark.createDataFrame([(i, u, "x", 1) for i, u in enumerate(urls)] + [(100 + i, f"http://bad.com/spam/{i}.html", "x", 1) for i in range(40)] + [(200 + i, f"http://bad.com/good/{i + 100}.html", "x", 1) for i in range(40)], "page_id long, url string, host string, n int")
    labels = spark.createDataFrame([(i, 0, 1) for i in range(40)] + [(i + 100, 1, 0) for i in range(40)] + [(None, 0, 0)], "doc_id long, quality int, toxic int")
    got = rows(url_filter.filter_urls(pages, labels), "page_id")
    assert [(got[i].host, got[i].path, got[i].rule) for i in range(11)] == [("", "", None), ("", "", None), ("", "", None), ("example.net", "/en/1", "example.net/en/"), ("a.example.net", "/de/2", "net/"), ("x.example.com", "/de/3", "example.com/de/"), ("y.org", "/fr/4", "org/fr/"), ("y.org", "", None), ("z.com", "/a/b/c/d/e/f/99999", None), ("net", "/1", "net/"), ("xnet", "/1", None)]
    assert [got[i].verdict for i in range(3, 7)] == ["allow", "block", "block", "allow"]
    assert {got[100 + i].verdict for i in range(40)} == {"block"} and {got[200 + i].verdict for i in range(40)} == {"allow"}
    assert got[100].template == "/spam/{n}.html" and got[8].template == "/a/b/c/d/e/f/{n}"
    assert rows(url_filter.filter_urls(pages, labels, depth=4), "page_id")[8].template == "/a/b/c/**"
    assert all(r.verdict == "allow" for r in url_filter.filter_urls(pages, labels.limit(0)).filter("rule is null").collect())
    assert url_filter.filter_urls(pages.limit(0), labels).count() == 0


def test_url_filter_sql_equals_query(spark):
    import duckdb

    rng = random.Random(21)
    urls = [f"http://{rng.choice(['a.com', 'b.org', 'c.de'])}" + "".join("/" + rng.choice(["x", "y", "news", str(rng.randrange(99)), "deadbeef01", "p12345q"]) for _ in range(rng.randrange(9))) + f"/{i}" for i in range(600)]
    marks = [(i, int(("x/y" in u) == (rng.random() < 0.1)), rng.randrange(2) if i % 50 == 0 else 0) for i, u in enumerate(urls) if i % 3]
    pages, labels = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string"), spark.createDataFrame(marks, "doc_id long, quality int, toxic int")
    c = duckdb.connect()
    c.execute("CREATE TABLE pages (page_id BIGINT, url VARCHAR)")
    c.execute("CREATE TABLE labels (doc_id BIGINT, quality INT, toxic INT)")
    c.executemany("INSERT INTO pages VALUES (?, ?)", [list(x) for x in enumerate(urls)])
    c.executemany("INSERT INTO labels VALUES (?, ?, ?)", [list(x) for x in marks])
    found = c.execute(url_filter.filter_urls_sql())
    names = [d[0] for d in found.description]
    got = rows(url_filter.filter_urls(pages, labels), "page_id")
    for r in map(lambda x: dict(zip(names, x, strict=True)), found.fetchall()):
        assert got[r["page_id"]].asDict() == r
    assert len({r.template for r in got.values()}) > 20


def test_url_filter_keeps_branches_that_differ(spark, tmp_path):
    from quern.llm.queries import op8_url_filter

    word = lambda i: "w" + "".join("ghijklmnop"[int(c)] for c in str(i))
    urls = [f"http://h.com/{word(i)}/{i}" for i in range(1000)] + [f"http://h.com/spam/{i}" for i in range(1000, 1500)]
    urls += [f"http://deep.com/a/b/c/d/{'bad' if i % 2 else 'good'}/x/{i}" for i in range(1500, 1700)] + ["http://deep.com/a" + "/s" * 300]
    spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").write.parquet(f"{tmp_path}/pages.parquet")
    spark.createDataFrame([(i, int(i < 1000 or (i >= 1500 and i % 2 == 0)), 0) for i in range(1700)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = rows(op8_url_filter(spark, str(tmp_path)), "page_id")
    assert {i for i, r in got.items() if r.verdict == "block"} == {*range(1000, 1500), *range(1501, 1700, 2)}
    assert (got[1000].template, got[1000].n_labelled) == ("/spam/{n}", 500) and got[1501].template.endswith("/bad/x/{n}") and got[1700].template == "/a/*/*/*/*" + "/s" * 296


def test_pipeline(spark):
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for name, stage in p.STAGES[:-1]:
        left = stage(spark, docs, SF)
        assert left.columns == docs.columns, name
        left = spark.createDataFrame(left.collect(), docs.schema)
        assert 0 < left.count() <= docs.count(), name
        docs = left
    assert p.run(spark, SF).count() == docs.count()


def test_pipeline_stages_on_odd_rows(spark, odd):
    import corpus_pipeline as p

    docs = docs_of(spark, [*odd, "x", "x"], [None, *range(1, len(odd)), 90, 90])
    assert p.exact_stage(spark, docs, SF).filter("doc_id = 90").count() == 1
    for _, stage in p.STAGES[:-1]:
        assert stage(spark, docs, SF).columns == docs.columns
        assert stage(spark, docs.limit(0), SF).count() == 0
    coded = p.bpe_stage(spark, docs, SF).collect()
    assert len(coded) == docs.count() and sum(r.n_tokens == 0 for r in coded) == 2 and p.bpe_stage(spark, docs.limit(0), SF).count() == 0
    clash = docs.withColumns({c: F.lit(1) for c in ("_id", "_h", "key", "h", "digest", "host", "path", "evidence", "good", "place")})
    for _, stage in p.STAGES[:-1]:
        assert stage(spark, clash, SF).columns == clash.columns
    near = {r.doc_id for r in p.near_stage(spark, docs, SF).collect()}
    assert len(near) == len({x for x in plain_components([plain_fingerprint(t) for t in [*odd, "x"]])})


def test_pipeline_equals_brute_force(spark):
    import corpus_pipeline as p
    from tokenizers import Tokenizer

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    good = {r.doc_id for r in quality.classify(docs, spark.read.parquet(f"{SF}/labels.parquet")).filter("kept").collect()}
    left = {r.doc_id: r.text for r in docs.collect() if r.doc_id in good}
    low = lambda t: "".join(c.lower() if "A" <= c <= "Z" else c for c in t)
    last = {}
    for i in sorted(left):
        last[low(left[i])] = i
    left = {i: left[i] for i in last.values()}
    ids = sorted(left)
    root = plain_components([plain_fingerprint(left[i]) for i in ids])
    left = {i: left[i] for k, i in enumerate(ids) if root[k] == k}
    windows = {}
    for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect():
        w = decontam.words(r.text.encode())
        for k in range(max(1, len(w) - 12)):
            windows.setdefault(len(w[k : k + 13]), set()).add(tuple(w[k : k + 13]))
    for i, t in list(left.items()):
        w, hit = decontam.words(t.encode()), set()
        for n, held in windows.items():
            for k in range(len(w) - n + 1):
                if tuple(w[k : k + n]) in held:
                    hit.update(range(k, k + n))
        if hit and 20 * len(hit) >= len(w):
            del left[i]
    tok = Tokenizer.from_file(vocabulary("byte_bpe_50k.json"))
    want = {i: hashlib.sha256(np.array(tok.encode(t, add_special_tokens=False).ids, "<u4").tobytes()).hexdigest() for i, t in left.items()}
    assert {r.doc_id: r.ids_sha256 for r in p.run(spark, SF).collect()} == want
