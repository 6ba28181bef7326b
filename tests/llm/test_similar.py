import random
from itertools import combinations

import numpy as np
import pytest

import corpus_pipeline
from inkwell.llm import similar


def slow_set(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def slow_roots(docs):
    """doc_id -> the smallest doc_id reachable over pairs with a five-word Jaccard of 0.8 or more."""
    sets, root = {i: slow_set(t) for i, t in docs}, {i: i for i, _ in docs}
    for a, b in combinations(sorted(sets), 2):
        if sets[a] == sets[b] or len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
            low, high = sorted((root[a], root[b]))
            root = {i: low if r == high else r for i, r in root.items()}
    return root


def changed(rng, text, n):
    w = text.split()
    for _ in range(n):
        w[rng.randrange(len(w))] = f"x{rng.randrange(10**6)}"
    return " ".join(w)


@pytest.fixture(scope="module")
def copies():
    """Near copies of every nearness, a large group of them, a chain, exact copies and loners."""
    rng = random.Random(7)
    new = lambda n: " ".join(f"w{rng.randrange(5000)}" for _ in range(n))
    texts = []
    for n in (60, 120, 900):
        for _ in range(3):
            base = new(n)
            texts += [base, base.upper(), *[changed(rng, base, max(1, n * k // 100)) for k in (1, 1, 2, 2, 3, 5)]]
    base = new(200)
    texts += [changed(rng, base, 3) for _ in range(60)] + [changed(rng, base, 1) for _ in range(20)]
    for _ in range(30):
        base = changed(rng, base, 3)
        texts.append(base)
    texts += [new(80) for _ in range(50)] + ["a b c", "a b c", "a b d", "", " "]
    rng.shuffle(texts)
    return list(enumerate(texts))


def compared(found, want):
    """No document is in a component that all pairs do not give it, and of the pairs linked so 97 % at least are found."""
    assert all(want[i] == want[c] for i, c in found.items())
    pairs = [(a, b) for a, b in combinations(sorted(want), 2) if want[a] == want[b]]
    assert sum(found[a] == found[b] for a, b in pairs) >= 0.97 * len(pairs)


def test_components_are_those_of_all_pairs(spark, copies):
    df = spark.createDataFrame(copies, "doc_id long, text string").repartition(5)
    compared({r.doc_id: r.component_id for r in similar.near_copies(df, group=4).collect()}, slow_roots(copies))


def test_filed_rows_are_shuffled_once(spark, copies, monkeypatch):
    """Sizes of groups and both sides of their comparison come from one shuffle, and what is filed is not written before."""
    plans, real = {}, similar.stash_freed

    def spy(df, name):
        if name not in plans:
            df.collect()
            plans[name] = df._jdf.queryExecution().executedPlan().toString().partition("== Initial Plan ==")[0]
        return real(df, name)

    monkeypatch.setattr(similar, "stash_freed", spy)
    similar.near_copies(spark.createDataFrame(copies, "doc_id long, text string")).count()
    assert list(plans)[:3] == ["signatures", "nodes", "pairs"]
    assert plans["pairs"].count("Generate explode") == 1 and "ReusedExchange" in plans["pairs"]


def test_the_scheme_finds_what_it_says():
    """Pairs at the similarity itself: of those that differ in as many random bits, the share that some partition finds."""
    rng = np.random.default_rng(5)
    n = 500_000
    both = np.full((similar.WORDS, 64, 64), n / 4)
    for b in both:
        np.fill_diagonal(b, n / 2)
    parts = similar.scheme(both, n)
    flips = rng.random((400, similar.WORDS, 64)) < similar.differing(similar.SIMILARITY)
    found = np.zeros(400, bool)
    for word, bits, t in parts:
        found |= flips[:, word, bits].sum(1) <= t
    assert found.mean() >= similar.RECALL - 0.02
    assert similar.scheme(both, 10**10, recall=0.1)[0][1] != parts[0][1]  # wider partitions for more documents


def test_bits_differ_as_the_similarity_says():
    rng = np.random.default_rng(1)
    shares = []
    for _ in range(40):
        x = rng.integers(0, 2**63, 360).astype(np.uint64)
        a, b = np.unique(x[:324]), np.unique(np.append(x[36:324], x[324:]))  # 288 of 360 shared
        d = np.bitwise_count(similar.wide_fingerprint(a) ^ similar.wide_fingerprint(b)).sum()
        shares.append(d / (64 * similar.WORDS))
    assert np.mean(shares) == pytest.approx(similar.differing(0.8), abs=0.01)


def test_the_pipeline_keeps_one_of_each(spark, copies):
    df = spark.createDataFrame(copies, "doc_id long, text string")
    out = dict(corpus_pipeline.STAGES)["simhash_near_dedup"](spark, df, "")
    roots = slow_roots(copies)
    kept, texts = {r.doc_id: r.text for r in out.collect()}, dict(copies)
    alone = {i for i, _ in copies if list(roots.values()).count(roots[i]) == 1}
    assert {i for i in roots if roots[i] == i} <= set(kept) and alone <= set(kept) and all(texts[i] == t for i, t in kept.items())
    assert len(kept) <= len(set(roots.values())) + 3


def test_odd(odd, none):
    roots = slow_roots([(k, t) for k, t in enumerate(r.text for r in odd.collect())])
    out = similar.deduplicated(odd)
    assert out.columns == odd.columns and out.count() == len(set(roots.values()))
    assert similar.near_copies(none).count() == 0 and similar.deduplicated(none).count() == 0
