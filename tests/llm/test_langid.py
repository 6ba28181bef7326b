import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from inkwell.llm import langid


def is_held_out(doc_id):
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % 3 == 1


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    lang = {r.doc_id: r.lang for r in docs.select("doc_id", "lang").collect()}
    rows = langid.identified(docs).collect()
    assert len(rows) == len(lang) and all(r.held_out == is_held_out(r.doc_id) and 0 <= r.score <= 1 for r in rows)
    kept = [r for r in rows if r.held_out]
    assert np.mean([r.lang_pred == lang[r.doc_id] for r in kept]) > 0.97


def test_odd(odd, none, spark):
    rows = langid.identified(odd).collect()
    assert len(rows) == odd.count()
    by = {r.doc_id: r for r in rows}
    assert all((by[i].lang_pred, by[i].score) == ("und", 0.0) for i in (3, 4, 5)) and by[1].lang_pred in ("en", "de")
    assert all(r.held_out == is_held_out(r.doc_id) for r in rows)
    assert langid.identified(none).count() == 0
    unlabelled = odd.withColumn("lang", F.lit(None).cast("string"))
    assert {r.lang_pred for r in langid.identified(unlabelled).collect()} == {"und"}


def test_only_text_decides(documents):
    model = langid.fit(langid.sample(documents))
    blind = documents.withColumns({"lang": F.lit("xx"), "source": F.lit("yy")})
    a, b = ({r.doc_id: (r.lang_pred, r.score) for r in langid.identified(d, model).collect()} for d in (documents, blind))
    assert a == b


def test_no_sample_from_held_out(documents):
    texts = {r.text: r.doc_id for r in documents.collect() if is_held_out(r.doc_id)}
    others = {r.text for r in documents.collect() if not is_held_out(r.doc_id)}
    assert not [t for t, _ in langid.sample(documents) if t.decode() in texts and t.decode() not in others]


def brute(emit, transitions):
    """Marginals and expected transitions of one sequence by summing over all labellings."""
    from itertools import product

    n, k = emit.shape
    total, marginal, expected = 0.0, np.zeros((n, k)), np.zeros((k, k))
    for path in product(range(k), repeat=n):
        p = np.exp(sum(emit[t, y] for t, y in enumerate(path)) + sum(transitions[a, b] for a, b in zip(path, path[1:])))
        total += p
        for t, y in enumerate(path):
            marginal[t, y] += p
        for a, b in zip(path, path[1:]):
            expected[a, b] += p
    return marginal / total, expected / total


def test_forward_backward_is_exact():
    rng = np.random.default_rng(0)
    transitions = rng.normal(size=(3, 3))
    lengths = [5, 3, 3, 1]
    emits = [rng.normal(size=(n, 3)) for n in lengths]
    active = np.array([sum(n > t for n in lengths) for t in range(max(lengths))])
    packed = np.concatenate([[e[t] for e in emits if len(e) > t] for t in range(max(lengths))])
    expected = np.zeros((3, 3))
    found = langid.forward_backward(packed, transitions, active, expected)
    at = np.append(0, np.cumsum(active))
    want = [brute(e, transitions) for e in emits]
    for j, (m, _) in enumerate(want):
        assert np.allclose([found[at[t] + j] for t in range(lengths[j])], m)
    assert np.allclose(expected, sum(e for _, e in want))


def test_switches_are_followed():
    en, de = b"the of and to is was with for that this " * 60, b"der die das und ist nicht mit auf ein zu " * 60
    model = langid.fit([(en, "en"), (de, "de")] * 4)
    known = langid.Emissions(model)
    words = (en[:200] + de[:200]).split()
    known.learn(words)
    label = langid.forward_backward(known.table[[known[w] for w in words]], model.transitions, np.ones(len(words), int)).argmax(1)
    truth = [model.langs.index("en")] * len(en[:200].split()) + [model.langs.index("de")] * (len(words) - len(en[:200].split()))
    assert np.mean(label == truth) > 0.95
    assert model.transitions[0, 0] > model.transitions[0, 1] and model.transitions[1, 1] > model.transitions[1, 0]


@pytest.mark.parametrize(("text", "has"), [(None, False), (b"", False), (b"12 !", False), ("é".encode(), True), ("日".encode(), True), ("…“".encode(), False), (b"a", True)])
def test_letters(text, has):
    assert langid.has_letter(text) == has


def test_batches_do_not_show():
    model = langid.fit([(b"the of and to is was", "en"), (b"der die das und ist", "de")])
    texts = [b"the of", b"der", None, b"das und ist the", b"1 2 the"] * 3
    one = [langid.predicted([t], langid.Emissions(model))[0] for t in texts]
    many = langid.predicted(texts, langid.Emissions(model))
    assert [a[0] for a in one] == [a[0] for a in many] and np.allclose([a[1] for a in one], [a[1] for a in many])


def test_the_sample_is_bounded_by_rows(spark, monkeypatch):
    """However often an id or a row stands in the table; a language of long texts only gives spans of them."""
    monkeypatch.setattr(langid, "SAMPLE_DOCS", 5)
    monkeypatch.setattr(langid, "SAMPLE_CHARS", 30)
    ids = [i for i in range(60) if zlib.crc32(str(i).encode()) % 3 != 1]
    rows = [(ids[k % 4], f"text {k % 90} of one", "en") for k in range(2000)] + [(ids[5], "same", "de")] * 300 + [(i, "x" * 100 + str(i), "fr") for i in ids[:9]]
    found = langid.sample(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    by = {lang: [t for t, x in found if x == lang] for lang in ("en", "de", "fr")}
    assert len(by["en"]) == 5 and by["de"] == [b"same"] and by["fr"] == [b"x" * 30] * 5


def test_the_sample_is_the_first_by_hash_however_it_is_dealt(spark, monkeypatch):
    monkeypatch.setattr(langid, "SAMPLE_DOCS", 40)
    df = spark.createDataFrame([(k, f"text {k}", "en" if k % 3 else "de") for k in range(900)], "doc_id long, text string, lang string")
    found = langid.sample(df)
    monkeypatch.setattr(langid, "WAYS", 1)
    assert found == langid.sample(df) and len(found) == 80
