from collections import defaultdict

from hypothesis import given, strategies as st

from inkwell.llm import line_dedup as ld, registry


def expected(rows, least=ld.LEAST_WORDS):
    """By comparing every line with every earlier one of nearly its length: {(doc, text): (n_lines, n_near, kept)}."""
    order = sorted({(float("inf") if i is None else i, -1 if i is None else 0, t) for i, t in rows}, key=lambda x: (x[0], str(x[2])))
    seen, by_length, out = set(), defaultdict(list), {}
    for i, _, text in order:
        kept, near, n = [], 0, 0
        for k, line in enumerate((text or "").split("\n")):
            words = line.encode().split()
            if not words:
                continue
            n += 1
            if tuple(words) in seen:
                continue
            seen.add(tuple(words))
            m = len(words)
            if m >= least and any(ld.within_one(words, x) for d in (m - 1, m, m + 1) if d >= least for x in by_length[d]):
                near += 1
            else:
                kept.append(k)
            by_length[m].append(words)
        out[(None if i == float("inf") else i, text)] = (n, near, kept)
    return out


def test_equals_brute_force(documents):
    rows = [(r.doc_id, r.text) for r in documents.collect()]
    want = {i: v for (i, _), v in expected(rows).items()}
    got = {r.doc_id: (r.n_lines, r.n_near, r.kept_lines) for r in ld.decisions(documents).collect()}
    assert got == want
    assert sum(v[1] for v in want.values()) > 0


def test_odd_documents(odd):
    rows = ld.decisions(odd).collect()
    assert len(rows) == odd.count()
    by = {r.doc_id: r for r in rows if r.doc_id not in (None, 8)}
    assert (by[1].n_removed, by[2].n_removed, by[2].n_near) == (0, 2, 1)
    assert by[3].n_lines == by[4].n_lines == by[5].n_lines == 0 and by[3].kept_lines == []
    assert by[6].n_removed == 0 and by[7].n_removed == 1
    assert sorted((r.n_lines, r.n_removed) for r in rows if r.doc_id is None) == [(1, 0), (3, 2), (3, 2)]


def test_texts_without_duplicate_lines(odd):
    out = ld.deduplicated(odd)
    assert out.columns == odd.columns
    texts = {r.doc_id: r.text for r in out.collect()}
    assert 2 not in texts and 7 not in texts and texts[3] is None and texts[4] == "" and texts[5] == " \n\t "
    assert texts[None] in ("no id", "another without id") and out.where("_doc = 'own _doc' and size = 'own size'").count() == out.count()


def test_empty(none):
    assert ld.decisions(none).count() == 0 and ld.deduplicated(none).count() == 0


@given(st.lists(st.sampled_from("abc"), max_size=6), st.lists(st.sampled_from("abc"), max_size=6))
def test_within_one(a, b):
    def distance(x, y):
        row = list(range(len(y) + 1))
        for i, p in enumerate(x, 1):
            row, before = [i], row
            for j, q in enumerate(y, 1):
                row.append(min(before[j] + 1, row[-1] + 1, before[j - 1] + (p != q)))
        return row[-1]

    assert ld.within_one(a, b) == (distance(a, b) <= 1)


@given(st.lists(st.sampled_from([b"a", b"b", b"c"]), min_size=8, max_size=20), st.integers(0, 19), st.sampled_from(["drop", "put", "replace"]))
def test_near_lines_meet_twice(words, at, how):
    """They share an end, and a variant from the same place or the whole of one."""
    at %= len(words)
    other = words[:at] + {"drop": [], "put": [b"z", words[at]], "replace": [b"z"]}[how] + words[at + 1 :]
    if len(other) < ld.LEAST_WORDS:
        return
    assert set(filter(None, ld.ends(words))) & set(filter(None, ld.ends(other)))
    v, s = ld.variants(b" ".join(words))
    u, t = ld.variants(b" ".join(other))
    a, b = set(zip(v.tolist(), s.tolist())), set(zip(u.tolist(), t.tolist()))
    assert a & b or int(v[0]) in {x for x, k in b if k} or int(u[0]) in {x for x, k in a if k}


def test_one_variant_that_very_many_lines_share(spark):
    rows = [(i, f"a log line of some words with number {i} in its middle somewhere") for i in range(3000)]
    out = ld.decisions(spark.createDataFrame(rows, "doc_id long, text string")).where("n_removed = 0").collect()
    assert [r.doc_id for r in out] == [0]


def test_sql(spark, sf_dir, duck, same_rows):
    same_rows(registry.op1_line_dedup(spark, sf_dir), duck.sql(registry.oracle_sql()["op1_line_dedup"]))


def test_one_document_of_very_many_lines(spark):
    lines = [f"line number {k % 150_000} of a very long document" for k in range(200_000)]
    df = spark.createDataFrame([(1, "\n".join(lines)), (2, "other words")], "doc_id long, text string")
    out = {r.doc_id: r.text for r in ld.deduplicated(df, least=20).collect()}
    assert out == {1: "\n".join(lines[:150_000]), 2: "other words"}


def test_the_least_number_of_words_is_a_parameter(spark):
    df = spark.createDataFrame([(1, "a b c d e"), (2, "a b x d e"), (3, "a b"), (4, "a c")], "doc_id long, text string")
    assert {r.doc_id for r in ld.deduplicated(df, least=5).collect()} == {1, 3, 4}
    assert ld.deduplicated(df).count() == 4
