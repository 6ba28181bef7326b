import re
from collections import Counter

from pyspark.sql import functions as F

from inkwell.llm import quality, registry


def counts(text):
    words = (text or "").encode().split()
    grams = list(zip(words, words[1:], words[2:]))
    often, covered, seen, dup = Counter(grams), set(), set(), 0
    for i, g in enumerate(grams):
        if often[g] > 1:
            covered |= {i, i + 1, i + 2}
    for line in (text or "").split("\n"):
        if line.encode().split():
            dup += line in seen
            seen.add(line)
    return len(words), len(b"".join(words).decode()), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(covered)


def test_sql(spark, sf_dir, duck, same_rows):
    same_rows(registry.op4_quality_rules(spark, sf_dir), duck.sql(registry.oracle_sql()["op4_quality_rules"]))


def test_odd(odd, none):
    rows = quality.judged(odd).collect()
    assert len(rows) == odd.count()
    for r in rows:
        assert counts(r.text) == (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words)
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        assert not (r.base_failed and r.kept) and r["size"] == "own size"
    assert quality.judged(none).count() == 0


def test_verdict_can_be_filtered_on(documents):
    judged = quality.judged(documents)
    kept = judged.where("kept").select(*documents.columns)
    assert 0 < kept.count() < documents.count() and kept.columns == documents.columns
    assert kept.count() == sum(r.kept for r in judged.collect())


def test_rules_are_a_table(spark):
    df = spark.createDataFrame([("the " + "word#" * 3 + " ") * 30], "string").toDF("text").withColumn("doc_id", F.lit(1))
    strict = (quality.Rule("symbols_per_word", None, 0.1),)
    assert quality.base(df).select(quality.verdict(strict)).first()[0] is False
    assert quality.base(df).select(quality.verdict((quality.Rule("symbols_per_word", 1, 2),))).first()[0] is True


def test_no_python_on_the_executors(documents):
    plan = quality.judged(documents)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan


def test_clean_documents_stay(spark, sf_dir):
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where("quality = 1").select("doc_id")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").join(labels, "doc_id")
    assert quality.judged(docs).where("not base_failed and not kept").count() == 0
