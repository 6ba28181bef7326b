import pytest
from pyspark.sql import functions as F

from inkwell.llm import mixing, registry


def water(sizes, weights=(3, 1, 2)):
    """sizes by source -> target, by filling a little at a time until all is given."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % 3] for i, s in enumerate(order)}
    open_, out, rest = set(order), {}, 1.5 * sum(sizes.values())
    while open_:
        total = sum(w[s] for s in open_)
        over = {s for s in open_ if rest * w[s] / total > 2 * sizes[s]}
        if not over:
            out |= {s: rest * w[s] / total for s in open_}
            break
        for s in over:
            out[s] = 2.0 * sizes[s]
        rest -= sum(out[s] for s in over)
        open_ -= over
    return out


def check(df):
    rows = mixing.mix(df).collect()
    docs = df.collect()
    size = lambda t: len((t or "").encode().split())
    assert sorted([(r.doc_id, r.source, r["size"]) for r in rows], key=str) == sorted([(r.doc_id, r.source, size(r.text)) for r in docs], key=str)
    sums, longest = {}, {}
    for r in docs:
        sums[r.source] = sums.get(r.source, 0) + size(r.text)
        longest[r.source] = max(longest.get(r.source, 0), size(r.text))
    want = water(sums) if sums else {}
    taken = {}
    for r in rows:
        taken[r.source] = taken.get(r.source, 0) + r.taken
        assert r.source_size == sums[r.source] and r.target == pytest.approx(want[r.source])
        assert r.taken in (0, r["size"], 2 * r["size"])
        assert (r.position is None) == (r.copies == 0) and (r.position is None or 0 <= r.position <= 1)
    for s, n in taken.items():
        assert abs(n - want[s]) <= longest[s] / 2 + 1e-6
    return rows


def test_documents(documents):
    a = check(documents)
    b = mixing.mix(documents.repartition(7)).collect()
    key = lambda r: (r.doc_id, r.taken, r.position)
    assert sorted(map(key, a), key=str) == sorted(map(key, b), key=str)


def test_odd(odd, none):
    rows = check(odd)
    out = mixing.mixed(odd)
    assert out.columns == odd.columns and out.count() == sum(r.copies for r in rows)
    assert mixing.mix(none).count() == 0 and mixing.mixed(none).count() == 0


def test_no_words_at_all(spark):
    rows = mixing.mix(spark.createDataFrame([(1, None, "a"), (2, " ", None)], "doc_id long, text string, source string")).collect()
    assert [(r["size"], r.taken, r.target) for r in rows] == [(0, 0, 0.0)] * 2


def test_copies_are_the_mix(documents):
    words = F.sum(mixing.n_words(F.col("text"))).alias("n")
    out = {r.source: r.n for r in mixing.mixed(documents).groupBy("source").agg(words).collect()}
    assert out == {r.source: r.n for r in mixing.mix(documents).groupBy("source").agg(F.sum("taken").alias("n")).where("n > 0").collect()}


def test_a_hot_source_is_dealt_in_buckets(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BUCKET_ROWS", 10)
    check(spark.range(500).select(F.col("id").alias("doc_id"), F.repeat(F.lit("w "), (F.col("id") % 9).cast("int")).alias("text"), F.when(F.col("id") % 3 > 0, "hot").otherwise(F.concat(F.lit("s"), F.col("id") % 5)).alias("source")))


@pytest.mark.parametrize("ramp", [(1.0, 1.0), (1.5, 0.5), (0.5, 1.5), (0.0, 2.0), (2.0, 0.0)])
def test_position_inverts_the_integral(spark, ramp):
    first, last = ramp
    for t in (0.0, 0.2, 0.5, 0.9, 1.0):
        done = (first * t + (last - first) * t * t / 2) / ((first + last) / 2)
        found = spark.range(1).select(mixing.position(F.lit(done), F.lit(first), F.lit(last))).first()[0]
        assert found == pytest.approx(t, abs=1e-6)


def test_positions_follow_the_schedules(spark):
    """With a falling ramp more than half of the words come before the middle of training."""
    df = spark.range(2000).select(F.col("id").alias("doc_id"), F.lit("a b c").alias("text"), F.lit("s").alias("source"))
    rows = mixing.mix(df, mixing.Curriculum(weights=(1,), ramps=((1.5, 0.5),), budget=1.0)).collect()
    early = sum(r.taken for r in rows if r.position < 0.5) / sum(r.taken for r in rows)
    assert early == pytest.approx(0.625, abs=0.01)


@pytest.mark.parametrize("ramp", [(1.0, 1.0), (1.5, 0.5), (0.5, 1.5)])
def test_every_copy_has_a_place_of_its_own(spark, ramp):
    """Of two and a half passes, each quarter of training holds the words that its schedule asks for."""
    df = spark.range(800).select(F.col("id").alias("doc_id"), F.lit("a b c").alias("text"), F.lit("s").alias("source"))
    plan = mixing.Curriculum(weights=(1,), ramps=(ramp,), budget=2.5, most_epochs=3.0)
    rows = mixing.mix(df, plan).collect()
    assert all(len(r.positions) == r.copies and r.positions[0] == r.position and r.positions == sorted(set(r.positions)) for r in rows)
    places = [p for r in rows for p in r.positions]
    first, last = ramp
    for t in (0.25, 0.5, 0.75, 1.0):
        assert sum(p <= t for p in places) / len(places) == pytest.approx(first * t + (last - first) * t * t / 2, abs=0.01)
    order = [r.doc_id for r in mixing.mixed(df, plan).collect()]
    assert len(order) == 2000 and len(set(order[:800])) == len(set(order[800:1600])) == 800


def test_default_positions_against_a_plain_loop(documents):
    """At the default budget: every copy where its source's demand over all passes reaches the middle of it."""
    rows = mixing.mix(documents).collect()
    by = {}
    for r in rows:
        by.setdefault(r.source, []).append(r)
    ramps = mixing.Curriculum().ramps
    tenths, wanted = [0] * 10, [0.0] * 10
    longest = max(r["size"] for r in rows)
    for k, source in enumerate(sorted(by, key=lambda s: (s is None, s or ""))):
        first, last = ramps[k % 3]
        members = sorted(by[source], key=lambda r: r.draw)
        total = sum(r["size"] for r in members)
        share = lambda t: (first * t + (last - first) * t * t / 2) / ((first + last) / 2)
        taken, target = 0, members[0].target
        for number in range(2):
            ahead = 0
            for r in members:
                if number < r.copies:
                    done = min((number * total + ahead + r["size"] / 2) / target, 1.0)
                    assert share(r.positions[number]) == pytest.approx(done, abs=1e-6)
                    tenths[min(9, int(r.positions[number] * 10))] += r["size"]
                    taken += r["size"]
                ahead += r["size"]
        wanted = [w + target * (share((t + 1) / 10) - share(t / 10)) for t, w in enumerate(wanted)]
    assert all(abs(a - b) <= 2 * len(by) * longest for a, b in zip(tenths, wanted))


def test_no_copy_stands_beside_itself(documents):
    order = [r.doc_id for r in mixing.mixed(documents).collect()]
    assert not any(a == b for a, b in zip(order, order[1:]))


def test_the_same_row_very_often(spark):
    """They are one row with a count until they are dealt out, each with places of its own."""
    same = spark.range(25_000).select(F.lit(1).cast("long").alias("doc_id"), F.lit("a b c").alias("text"), F.lit("s").alias("source"), F.col("id").alias("more"))
    other = spark.range(1000).select((F.col("id") + 2).alias("doc_id"), F.lit("a b c d").alias("text"), F.lit("t").alias("source"), F.lit(0).cast("long").alias("more"))
    df = same.union(other)
    rows = mixing.mix(df)
    assert rows.count() == 26_000 and rows.where("doc_id = 1").select("nth").distinct().count() == 25_000
    out = mixing.mixed(df)
    assert out.count() == rows.agg(F.sum("copies")).first()[0]
    assert out.where("doc_id = 1").select("more").distinct().count() == rows.where("doc_id = 1 and copies > 0").count()


def test_targets_of_very_many_sources(spark):
    sizes = {f"s{i}": (i * i * 37) % 1009 for i in range(2000)} | {None: 500}
    df = spark.createDataFrame(list(sizes.items()), "source string, words long").repartition(7)
    found = {r.source: r.target for r in mixing.targets(df, mixing.Curriculum()).collect()}
    assert found == pytest.approx(water(sizes))


def test_sql(spark, sf_dir, duck, same_rows):
    same_rows(registry.op10_source_mixing(spark, sf_dir), duck.sql(registry.oracle_sql()["op10_source_mixing"]))
