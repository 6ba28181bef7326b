import zlib

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from inkwell.llm import mixing, packing
from inkwell.llm.common import stash
from inkwell.llm.quality import MADE
from inkwell.llm.registry import oracle_sql, queries, tokenizer_path
from tests.llm.conftest import CLASHES
from tests.llm.test_line_dedup import expected as slow_lines
from tests.llm.test_quality import counts
from tests.llm.test_similar import slow_roots


def kept_by_rules(text):
    from inkwell.llm.quality import STOP_WORDS

    n, chars, symbols, dup, repeat = counts(text)
    if n < 50 or 100 * repeat > 50 * n:
        return False
    lines = [x for x in text.split("\n") if x.encode().split()]
    stop = {x for w in STOP_WORDS for x in (w, w[0].upper() + w[1:], f"{w},", f"{w}.")}
    stops = sum(w.decode() in stop for w in text.encode().split())
    return 2 <= chars / n <= 12 and symbols / n <= 0.25 and stops / n >= 0.01 and dup / max(len(lines), 1) <= 0.6


def test_stages_against_plain_python(spark, sf_dir):
    """Each stage on what the one before kept; the mix is held to its sizes in its own tests, and taken over here."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns = docs.columns
    rows = {r.doc_id: r.text for r in docs.collect()}
    stages = dict(corpus_pipeline.STAGES)

    docs = stash(stages["quality_rules"](spark, docs, sf_dir), "a")
    rows = {i: t for i, t in rows.items() if kept_by_rules(t)}
    assert docs.columns == columns and {r.doc_id: r.text for r in docs.collect()} == rows

    docs = stash(stages["line_dedup"](spark, docs, sf_dir), "b")
    kept = {i: v[2] for (i, _), v in slow_lines(list(rows.items())).items()}
    rows = {i: "\n".join(x for k, x in enumerate(t.split("\n")) if k in kept[i] or not x.encode().split()) for i, t in rows.items() if kept[i]}
    assert docs.columns == columns and {r.doc_id: r.text for r in docs.collect()} == rows
    assert all(r.n_chars == len(r.text) for r in docs.collect())

    docs = stash(stages["simhash_near_dedup"](spark, docs, sf_dir), "c")
    roots = slow_roots(list(rows.items()))
    rows = {i: t for i, t in rows.items() if roots[i] == i}
    assert docs.columns == columns and {r.doc_id: r.text for r in docs.collect()} == rows

    docs = stash(stages["source_mixing"](spark, docs, sf_dir), "d")
    mixed = docs.collect()
    assert docs.columns == columns and all(rows[r.doc_id] == r.text for r in mixed)

    packed = stages["best_fit_packing"](spark, docs, sf_dir).collect()
    ids = packing.word_ids(tokenizer_path())
    want = []
    for r in mixed:
        data = packing.token_bytes(r.text.encode(), ids)
        want += [(r.doc_id, k, zlib.crc32(data[at : at + 4 * 4096])) for k, at in enumerate(range(0, len(data), 4 * 4096))]
    assert sorted((r.doc_id, r.piece, r.ids_crc32) for r in packed) == sorted(want)
    assert np.max([r.offset + r.length for r in packed]) <= 4096


def test_run(spark, sf_dir):
    out = corpus_pipeline.run(spark, sf_dir)
    assert out.count() > 0 and {"doc_id", "sequence_id", "offset"} <= set(out.columns)


def test_on_no_documents(spark, none):
    docs = none
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, "")
    assert docs.count() == 0


def test_on_odd_documents(spark, odd):
    docs = odd
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, "")
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == odd.columns
            assert all(r[c] == f"own {c}" for r in docs.collect() for c in CLASHES if c != "n_chars")


def test_values_of_clashing_columns_stay(spark, documents):
    """Every column that a stage makes on its way exists already, with values of its own."""
    names = [*CLASHES, *MADE, "copies", "positions", "nth", "source_size", "target", "_nth", "_draw", "_position", "_at", "span", "node", "sig", "key", "root"]
    docs = documents.withColumns({c: F.concat(F.lit(f"{c} of "), F.col("doc_id").cast("string")) for c in dict.fromkeys(names)})
    columns = docs.columns
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stash(stage(spark, docs, ""), "stage")
        rows = docs.collect()
        assert rows and docs.columns == columns and all(r[c] == f"{c} of {r.doc_id}" for r in rows for c in names)


def test_sequences_follow_the_positions_of_training(spark, documents, monkeypatch):
    monkeypatch.setattr(packing, "SPAN_ROWS", 20)
    docs = stash(mixing.mixed(documents), "mix")
    place = {}
    for k, r in enumerate(docs.orderBy("_metadata.file_name", "_metadata.row_index").collect()):
        place.setdefault(r.doc_id, []).append(k)
    rows = dict(corpus_pipeline.STAGES)["best_fit_packing"](spark, docs, "").where("piece = 0").collect()
    ranks = {s: k for k, s in enumerate(sorted({r.sequence_id for r in rows}))}
    rows = [r for r in rows if len(place[r.doc_id]) == 1]
    x = [place[r.doc_id][0] for r in rows]
    y = [ranks[r.sequence_id] for r in rows]
    assert np.corrcoef(x, y)[0, 1] > 0.6


def test_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in queries()) == list(range(1, 11))
    assert set(oracle_sql()) <= set(queries())
