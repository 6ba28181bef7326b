import zlib
from collections import Counter
from itertools import combinations

import numpy as np
from hypothesis import given, settings, strategies as st

from inkwell.llm import packing
from inkwell.llm.registry import tokenizer_path


def check(rows, docs, capacity=packing.CAPACITY):
    """Pieces are the tokenizer's ids in order, sequences have no gaps and fit."""
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokenizer_path())
    want = []
    for doc_id, text in docs:
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [1]
        for k, at in enumerate(range(0, len(ids), capacity)):
            part = ids[at : at + capacity]
            want.append((doc_id, k, at, len(part), zlib.crc32(np.array(part, "<u4").tobytes())))
    key = lambda x: tuple((v is None, v or 0) for v in x)
    assert sorted([(r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows], key=key) == sorted(want, key=key)
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by), sum(w[3] for w in want)


def test_documents(documents):
    rows = packing.pack(documents, tokenizer_path()).collect()
    n, total = check(rows, [(r.doc_id, r.text) for r in documents.collect()])
    assert n <= -(-total // packing.CAPACITY) * 1.02 + 1


def test_odd(odd, none):
    check(packing.pack(odd, tokenizer_path()).collect(), [(r.doc_id, r.text) for r in odd.collect()])
    assert packing.pack(none, tokenizer_path()).count() == 0


def test_small_capacity(documents):
    rows = packing.pack(documents, tokenizer_path(), 64).collect()
    check(rows, [(r.doc_id, r.text) for r in documents.collect()], 64)


@given(st.lists(st.integers(1, 30), max_size=60))
@settings(deadline=None)
def test_plan_places_every_piece_once(lengths):
    counts = np.bincount(lengths, minlength=31)[:31]
    placed = np.zeros(31, int)
    for combo, times in packing.plan(counts, 30):
        assert times > 0 and sum(combo) <= 30
        for x in combo:
            placed[x] += times
    assert (placed == counts).all()


def test_exact_complements():
    counts = np.zeros(101, int)
    counts[[60, 25, 10, 5, 50]] = [4, 4, 4, 4, 2]
    assert packing.plan(counts, 100) == [([60, 25, 10, 5], 4), ([50, 50], 1)]


def combinations_of(counts, n):
    """All sums of n pieces that the counts allow, each once."""
    pieces = [x for x, c in enumerate(counts) for _ in range(min(c, n))]
    return Counter(sum(c) for c in set(combinations(pieces, n)))


@given(st.lists(st.integers(0, 4), min_size=2, max_size=14), st.lists(st.integers(0, 100), max_size=12))
@settings(deadline=None, max_examples=300)
def test_the_index_is_that_of_all_combinations(counts, takes):
    counts = np.array([0, *counts])
    index = packing.SumIndex(counts)
    for x in takes:
        have = np.flatnonzero(counts)
        if len(have):
            index.take(int(have[x % len(have)]))
    pairs, triples = combinations_of(counts, 2), combinations_of(counts, 3)
    assert index.pairs.tolist() == [pairs[s] for s in range(len(counts))] and index.triples.tolist() == [triples[s] for s in range(len(counts))]
    for gap in range(1, len(counts)):
        found = index.exact(gap)
        assert (found is not None) == bool(counts[gap] or pairs[gap] or triples[gap])
        assert found is None or sum(found) == gap and all(counts[x] >= found.count(x) for x in found)


def test_a_triple_behind_very_many_thirds():
    """Lengths that are all but one even: an odd gap needs the odd one as the last of three."""
    counts = np.zeros(packing.CAPACITY + 1, int)
    counts[np.arange(2, 2000, 2)] = 1
    counts[3] = 1
    found = packing.SumIndex(counts).exact(3001)
    assert sum(found) == 3001 and 3 in found


def test_another_tokenizer_goes_whole(tmp_path):
    from tokenizers import Tokenizer, models, pre_tokenizers

    other = Tokenizer(models.WordLevel({"a b": 0, "?": 1}, unk_token="?"))
    other.pre_tokenizer = pre_tokenizers.Split("|", "removed")
    other.save(str(tmp_path / "t.json"))
    ids = packing.WordIds(str(tmp_path / "t.json"))
    assert not ids.by_word and np.frombuffer(packing.token_bytes(b"a b|c", ids), "<u4").tolist() == [0, 1, 1]
    assert packing.word_ids(tokenizer_path()).by_word


def test_spans_keep_their_order(spark, documents, odd, none, tmp_path, monkeypatch):
    monkeypatch.setattr(packing, "SPAN_ROWS", 40)
    documents.repartition(3).write.parquet(str(tmp_path / "d"))
    docs = spark.read.parquet(str(tmp_path / "d"))
    rows = packing.pack_in_order(docs, tokenizer_path()).collect()
    check(rows, [(r.doc_id, r.text) for r in docs.collect()])
    span = {}
    for k, f in enumerate(sorted((tmp_path / "d").glob("part-*"))):
        span |= {r.doc_id: (k, n // 40) for n, r in enumerate(spark.read.parquet(str(f)).coalesce(1).collect())}
    order = sorted({(r.sequence_id, span[r.doc_id]) for r in rows})
    assert [s for _, s in order] == sorted(s for _, s in order) and len(set(span.values())) > 3
    check(packing.pack_in_order(odd, tokenizer_path()).collect(), [(r.doc_id, r.text) for r in odd.collect()])
    assert packing.pack_in_order(none, tokenizer_path()).count() == 0


def test_a_length_that_very_many_share():
    counts = np.zeros(packing.CAPACITY + 1, int)
    counts[1000] = 10**12
    counts[96] = 10**6
    assert sum(t for _, t in packing.plan(counts)) == 10**12 // 4


@given(st.text(alphabet="aZé日ß'’!.,*#-_<|>0 1½\ń̸ \x85İΣ", max_size=25))
@settings(deadline=None, max_examples=1500)
def test_ids_are_the_tokenizer_s(text):
    ids = packing.word_ids(tokenizer_path())
    found = np.frombuffer(packing.token_bytes(text.encode(), ids), "<u4").tolist()
    assert found == ids.tokenizer.encode(text, add_special_tokens=False).ids + [1]
