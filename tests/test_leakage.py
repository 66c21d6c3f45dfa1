"""Questions of different splits that are alike, against brute force."""

import random

import pytest

from quern.operators import evaluation as ev


@pytest.mark.parametrize("least", [0.5, 0.6, 0.8, 1.0])
@pytest.mark.parametrize("digest", [64, 512])
def test_leakage_equals_brute_force(spark, least, digest, monkeypatch):
    monkeypatch.setattr(ev, "DIGEST", digest)
    rng = random.Random(digest)
    base = [[f"w{rng.randrange(60)}" for _ in range(rng.choice([1, 2, 5, 12, 40, 120]))] for _ in range(40)]
    texts = ["", "  ", "…", *(" ".join(x if rng.random() > 0.15 else f"w{rng.randrange(60)}" for x in rng.choice(base)) for _ in range(160))]
    rows = [(i, f"s{i % 3}", t) for i, t in enumerate(texts)]
    got = {(r.a, r.b): r.similarity for r in ev.split_leakage(spark.createDataFrame(rows, "id int, split string, text string"), least).collect()}
    sets = [(i, s, set(t.split())) for i, s, t in rows if "w" in t]
    want = {(i, j): round(len(x & y) / len(x | y), 6) for i, s, x in sets for j, o, y in sets if s < o and len(x & y) / len(x | y) >= least}
    assert got == want and len(want) > 20


def test_pairs_that_share_a_rare_word_are_not_dealt(spark):
    """Of pairs that share their rarest word none but similar ones leave the join."""
    rows = [(i, f"s{i % 2}", " ".join(["rare", *(f"u{i}x{k}" for k in range(9))])) for i in range(60)] + [(100, "s0", "rare a b c"), (101, "s1", "rare a b c d")]
    found = ev.split_leakage(spark.createDataFrame(rows, "id int, split string, text string"), 0.6)
    assert [(r.a, r.b, r.similarity) for r in found.collect()] == [(100, 101, 0.8)]
    plan = found._jdf.queryExecution().executedPlan().toString()
    joins = [x for x in plan.splitlines() if "Join [t#" in x]
    assert any("bit_count" in x and "least(n_a" in x for x in joins), joins
