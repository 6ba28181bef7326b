import numpy as np
import pytest
import xxhash
from hypothesis import given, strategies as st

from inkwell.llm import components, simhash as sh


def slow_fingerprint(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_components(values, distance=3):
    """value -> the smallest of its component."""
    values, root = sorted(set(values)), {}
    for i, v in enumerate(values):
        near = {root[u] for u in values[:i] if (u ^ v).bit_count() <= distance}
        root[v] = v
        for u in values[: i + 1]:
            if root[u] in near:
                root[u] = v
    least = {}
    for v, r in root.items():
        least[r] = min(least.get(r, v), v)
    return {v: least[r] for v, r in root.items()}


def check(df):
    rows = sh.near_duplicates(df).collect()
    docs = [(r.doc_id, r.text) for r in df.collect()]
    roots = slow_components([slow_fingerprint(t) for _, t in docs])
    best = {}
    for i, t in docs:
        r = roots[slow_fingerprint(t)]
        best[r] = min([x for x in (best.get(r), i) if x is not None], default=None)
    want = sorted([(i, f"{slow_fingerprint(t):016x}", best[roots[slow_fingerprint(t)]]) for i, t in docs], key=str)
    assert sorted([(r.doc_id, r.fingerprint, r.component_id) for r in rows], key=str) == want
    return len(best)


def test_documents(documents):
    check(documents)


def test_odd(odd, none):
    groups = check(odd)
    kept = sh.deduplicated(odd)
    assert kept.count() == groups and kept.columns == odd.columns
    assert sh.near_duplicates(none).count() == 0 and sh.deduplicated(none).count() == 0


@given(st.text(alphabet="aB é\n\x0b", max_size=40))
def test_fingerprint(text):
    assert sh.fingerprint(text.encode()) == slow_fingerprint(text)


@pytest.mark.parametrize("group", [3, 1024])
def test_links_keep_every_component(spark, group):
    """Dense clusters, chains and loners; with small groups, everything is filed again and again."""
    rng = np.random.default_rng(3)
    values = {0, (1 << 64) - 1}
    for _ in range(12):
        center = int(rng.integers(0, 1 << 63))
        for _ in range(25):
            v = center
            for b in rng.choice(64, int(rng.integers(0, 4)), replace=False):
                v ^= 1 << int(b)
            values.add(v)
    values |= {int(x) for x in rng.integers(0, 1 << 63, 200)}
    df = spark.createDataFrame([(sh._signed(v),) for v in values], "fp long")
    found = components.components(sh.links(df, group=group)).collect()
    root = {r.node & sh.MASK: r.root & sh.MASK for r in found}
    groups = {}
    for v in values:
        groups.setdefault(root.get(v, v), set()).add(v)
    want = {}
    for v, r in slow_components(values).items():
        want.setdefault(r, set()).add(v)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, want.values()))


def test_thresholds_are_the_cheapest():
    assert sh.thresholds([[0, 1, 9, 99, 999]] * 4) == (4, [0, 0, 0, 0])
    assert sh.thresholds([[0, 5, 6, 99, 999], [0, 1, 50, 99, 999], [0, 1, 50, 99, 999]]) == (8, [1, 0, 0])
    assert sh.thresholds([[0, 1000, 1000, 1000, 1000], [0, 1, 2, 3, 4]])[1] == [-1, 3]


@given(st.integers(0, 2**64 - 1), st.lists(st.integers(0, 63), min_size=0, max_size=3), st.integers(2, 4))
def test_pigeonhole(value, flips, parts):
    """Whatever the allowed thresholds, a pair within the distance agrees within one of them."""
    other = value
    for b in set(flips):
        other ^= 1 << b
    bits = [list(range(64 * k // parts, 64 * (k + 1) // parts)) for k in range(parts)]
    for first in range(-1, 4):
        rest = [0] * parts
        rest[0] = first
        spare = 4 - sum(t + 1 for t in rest)
        if spare < 0 or spare > 3:
            continue
        rest[1] += spare
        assert any(((value ^ other) & sh._mask(b)).bit_count() <= t for b, t in zip(bits, rest))


def test_components_of_a_long_path_and_a_hub(spark):
    edges = [(i, i + 1) for i in range(100)] + [(1000, 2000 + i) for i in range(500)] + [(5, 5), (7, 6)]
    rows = components.components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert {r.node: r.root for r in rows} == {**{i: 0 for i in range(101)}, 1000: 1000, **{2000 + i: 1000 for i in range(500)}}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0
