import hashlib
import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

from inkwell.llm import sharding, registry


def check(df, limit):
    rows = sharding.shards(df, limit=limit).collect()
    size = lambda t: len((t or "").encode())
    assert sorted([(r.doc_id, r.n_bytes) for r in rows], key=str) == sorted([(r.doc_id, size(r.text)) for r in df.collect()], key=str)
    total, n = Counter(), Counter()
    for r in rows:
        total[r.shard] += r.n_bytes
        n[r.shard] += 1
        assert len(r.shard) == r.depth
    for r in rows:
        assert (r.shard_bytes, r.shard_rows) == (total[r.shard], n[r.shard])
        assert r.shard_bytes <= limit or r.shard_rows == 1
    names = sorted(total)
    assert not any(b.startswith(a) for a, b in zip(names, names[1:]))  # no shard's prefix is another's
    return rows


@pytest.mark.parametrize("limit", [10**9, 60_000, 5_000, 300])
def test_documents(documents, limit):
    rows = check(documents, limit)
    assert (len({r.shard for r in rows}) == 1) == (limit == 10**9)


def test_only_large_cells_split(documents):
    rows = check(documents, 60_000)
    depth = {r.shard: r.depth for r in rows}
    by = {r.shard: r.shard_bytes for r in rows}
    for s in by:
        if s and depth[s] > min(depth.values()):
            assert sum(v for k, v in by.items() if k.startswith(s[:-1])) > 60_000


def test_odd(odd, none):
    check(odd, 100)
    check(odd, 10**9)
    assert sharding.shards(none).count() == 0


def test_the_same_row_a_thousand_times(spark):
    rows = check(spark.createDataFrame([(1, "x" * 100)] * 1000 + [(None, "y" * 50)] * 200, "doc_id long, text string"), 1000)
    assert len({r.shard for r in rows}) >= 110


def test_the_same_row_very_often(spark):
    df = spark.range(300_000).select(F.lit(1).cast("long").alias("doc_id"), F.lit("x" * 100).alias("text"))
    out = sharding.shards(df, limit=150)
    assert out.count() == 300_000 and out.select("shard").distinct().count() == 300_000
    assert out.where("shard_bytes > 150 or shard_rows > 1").isEmpty()


def slow_shards(docs, limit):
    """(doc_id, text) -> shard, by a directory of dictionaries; rows are told apart as the operator does."""
    seen, bits, sizes = Counter(), [], []
    for i, t in docs:
        h = hashlib.md5(f"{'-' if i is None else f'={i}'}|{t or ''}".encode()).hexdigest()
        nth = seen[h]
        seen[h] += 1
        h = h if nth == 0 else hashlib.md5(f"{h}|{nth}".encode()).hexdigest()
        bits.append(f"{int(h, 16):0128b}")
        sizes.append(len((t or "").encode()))
    start = max(0, math.ceil(math.log2(max(sum(sizes), 1) / limit)))

    def split(members, depth):
        if sum(sizes[m] for m in members) <= limit or len(members) == 1:
            return {m: bits[m][:depth] for m in members}
        halves = [[m for m in members if bits[m][depth] == b] for b in "01"]
        return {k: v for h in halves if h for k, v in split(h, depth + 1).items()}

    first = {}
    for m, b in enumerate(bits):
        first.setdefault(b[:start], []).append(m)
    of = {k: v for members in first.values() for k, v in split(members, start).items()}
    return sorted([(str(docs[m][0]), sizes[m], s) for m, s in of.items()])


@pytest.mark.parametrize("limit", [60_000, 5_000, 300])
def test_against_a_plain_directory(documents, odd, limit):
    for df in (documents, odd):
        found = sorted((str(r.doc_id), r.n_bytes, r.shard) for r in sharding.shards(df, limit=limit).collect())
        assert found == slow_shards([(r.doc_id, r.text) for r in df.collect()], limit)


def test_rows_that_share_all_bits_of_the_directory(documents, monkeypatch):
    monkeypatch.setattr(sharding, "MOST_BITS", 4)
    rows = sharding.shards(documents, limit=300).collect()
    assert len(rows) == documents.count() and all(r.shard_bytes <= 300 or r.shard_rows == 1 for r in rows)
    assert {r.depth for r in rows if r.depth > 4} == {sharding.ALL_BITS}


def test_sizes_are_shuffled_once(documents):
    """One exchange of the sums, one of the directory by starting cell; the documents' rows join the directory in place."""
    sized = sharding._sized(documents, "doc_id", "text").withColumnRenamed("_hash", "_own").withColumn("_bits", sharding._bits(F.col("_own")))
    cells = sized.groupBy(sharding._prefix(10).alias("cell")).agg(F.sum("n_bytes").alias("bytes"), F.count("*").alias("n"))
    plan = sharding._directory(cells, 4, 10, 5_000)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 3 and plan.count("Window [") >= 1


def test_shard_does_not_depend_on_the_run(documents):
    a, b = ({r.doc_id: r.shard for r in sharding.shards(d, limit=20_000).collect()} for d in (documents, documents.repartition(5)))
    assert a == b


def test_no_python(documents):
    plan = sharding.shards(documents, limit=20_000)._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))


def test_written_shards(odd, tmp_path, spark):
    df = odd
    where = sharding.write_shards(df, str(tmp_path / "s"), limit=200)
    back = spark.read.parquet(str(tmp_path / "s"))
    assert back.drop("_shard").columns == df.columns
    own = lambda d: sorted(map(str, d.select(df.columns).collect()))
    assert own(back) == own(df)
    assert sorted(map(str, [(r.doc_id, r._shard) for r in back.collect()])) == sorted(map(str, [(r.doc_id, f"b{r.shard}") for r in where.collect()]))
    with pytest.raises(ValueError):
        sharding.write_shards(df.withColumn("_shard", F.lit(1)), str(tmp_path / "t"))


def test_sql(spark, sf_dir, duck, same_rows):
    same_rows(registry.op7_sharding(spark, sf_dir), duck.sql(registry.oracle_sql()["op7_sharding"]))
