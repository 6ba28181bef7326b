import hashlib

import numpy as np
from hypothesis import given, strategies as st

from inkwell.llm import substring_dedup as sd


def expected(rows, window):
    first, out = {}, []
    key = lambda i: float("inf") if i is None else i
    split = [(key(i), (t or "").encode().split()) for i, t in rows]
    for i, w in split:
        for p in range(len(w) - window + 1):
            g = tuple(w[p : p + window])
            first[g] = min(first.get(g, i), i)
    for i, w in split:
        gone = set()
        for p in range(len(w) - window + 1):
            if first[tuple(w[p : p + window])] < i:
                gone.update(range(p, p + window))
        kept = b" ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((None if i == float("inf") else i, len(w), len(gone), hashlib.sha256(kept).hexdigest(), kept.decode()))
    return sorted(out, key=str)


def found(df, window=sd.WINDOW):
    return sorted([(r.doc_id, r.n_words, r.n_removed, r.kept_sha256, r.text) for r in sd.removed(df, window).collect()], key=str)


def test_documents(documents):
    got = found(documents)
    assert got == expected([(r.doc_id, r.text) for r in documents.collect()], 50)
    assert sum(r[2] for r in got) > 0


def test_small_window(documents):
    assert found(documents, 6) == expected([(r.doc_id, r.text) for r in documents.collect()], 6)


def test_odd(odd, none):
    assert found(odd) == expected([(r.doc_id, r.text) for r in odd.collect()], 50)
    assert found(none) == []


def test_one_passage_that_very_many_share(spark):
    passage = " ".join(f"p{i}" for i in range(70))
    rows = [(i, f"own{i} {passage} tail{i}") for i in range(400)]
    got = found(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(r[2] for r in got) == [0] + [70] * 399


@given(st.lists(st.tuples(st.integers(0, 5), st.integers(0, 400), st.integers(0, 2**64 - 1)), max_size=50), st.integers(1, 300))
def test_packing_of_probes(rows, buckets):
    rows = sorted(set(rows))
    ids, places, hashes = (np.array([r[k] for r in rows], t) for k, t in ((0, np.int64), (1, np.int64), (2, np.uint64)))
    if not rows:
        return
    back = []
    for bucket, kind, *data in sd.packed(1, ids, places, hashes, buckets):
        docs, counts, at, low = sd.unpacked(*data)
        back += zip(np.repeat(docs, counts).tolist(), at.tolist(), low.tolist())
        assert kind == 1 and 0 <= bucket < buckets
    assert sorted(back) == sorted((int(i), int(p), int(h) & 0xFFFFFFFF) for i, p, h in rows)


@given(st.lists(st.integers(0, 2**64 - 1), max_size=30), st.integers(1, 10))
def test_rolling_hash_is_the_window_s(words, width):
    h = sd.rolling(np.array(words, np.uint64), width)
    assert len(h) == max(0, len(words) - width + 1)
    for i in range(len(h)):
        assert h[i] == sd.rolling(np.array(words[i : i + width], np.uint64), width)[0]


def test_sql(spark, sf_dir, duck, same_rows):
    from inkwell.llm import registry

    same_rows(registry.op3_substring_dedup(spark, sf_dir), duck.sql(registry.oracle_sql()["op3_substring_dedup"]))


def test_nulls_are_last_and_spread(spark):
    passage = " ".join(f"p{i}" for i in range(55))
    rows = [(None, f"{passage} {i}") for i in range(20)] + [(4, f"x {passage}"), (None, "short")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert found(df) == expected(rows, 50)
