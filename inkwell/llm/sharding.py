"""Sharding by extendible hashing, in DataFrame operations alone.

The directory starts with as many hash-prefix bits as the total bytes ask for. A cell over the byte limit splits on the
next bit, and only such cells do, level after level, until every shard fits. The sums of the deepest level of a pass are
the one aggregate over all documents; the levels above it are sums over the directory, which is smaller than the data by the
limit. Texts are never shuffled, their sizes once, and joined to the directory, by broadcast if it is small.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import alike, numbered, packed, prepare, spread, stash

SHARD_BYTES = 32 * 1024 * 1024
#: Levels that one pass over the sizes adds to the directory.
LEVELS = 6
#: Bits of the hash that the directory can use, and all bits that it has.
MOST_BITS, ALL_BITS = 60, 128


def row_hash(key: Column, text: Column) -> Column:
    """128 bits of key and text as 32 hex digits."""
    return F.md5(F.concat_ws("|", F.coalesce(F.concat(F.lit("="), key.cast("string")), F.lit("-")), F.coalesce(text, F.lit(""))))


def _bits(digits: Column) -> Column:
    """The first MOST_BITS bits of hex digits as a number."""
    return F.conv(F.substring(digits, 1, MOST_BITS // 4), 16, 10).cast("long")


def _prefix(depth: int) -> Column:
    return F.shiftright(F.col("_bits"), MOST_BITS - depth)


def _name(prefix: Column, depth: int) -> Column:
    """The bits of a prefix as text."""
    return F.right(F.concat(F.lit("0" * MOST_BITS), F.bin(prefix)), F.lit(depth)) if depth else F.lit("")


def _directory(cells: DataFrame, start: int, deep: int, limit: int) -> DataFrame:
    """cells (cell of `deep` bits, bytes, n) -> the same cells with shard (its bits), depth, shard_bytes, shard_rows of the first level from `start` that fits; null if none does."""
    cells = cells.repartition(F.shiftright("cell", deep - start))  # all levels of a starting cell lie together
    found = cells
    for d in range(start, deep + 1):
        at = Window.partitionBy(F.shiftright("cell", deep - start), F.shiftright("cell", deep - d))
        found = found.withColumns({f"_bytes{d}": F.sum("bytes").over(at), f"_rows{d}": F.sum("n").over(at)})
    fits = lambda d: (F.col(f"_bytes{d}") <= limit) | (F.col(f"_rows{d}") == 1)
    first = lambda value: F.coalesce(*[F.when(fits(d), value(d)) for d in range(start, deep + 1)])
    return found.select(
        "cell",
        first(lambda d: _name(F.shiftright("cell", deep - d), d)).alias("shard"),
        first(F.lit).cast("int").alias("depth"),
        first(lambda d: F.col(f"_bytes{d}")).alias("shard_bytes"),
        first(lambda d: F.col(f"_rows{d}")).alias("shard_rows"),
    )


def _sized(docs: DataFrame, key: str, text: str) -> DataFrame:
    """_key, n_bytes, _hash, n: a row for rows alike in key and text, and how many they are."""
    digits = row_hash(F.col(key), F.col(text))
    sizes = docs.select(F.col(key).alias("_key"), F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("n_bytes"), digits.alias("_hash"))
    return sizes.groupBy("_key", "n_bytes", "_hash").agg(F.count("*").alias("n"))


def _dealt(docs: DataFrame, key: str, text: str, limit: int) -> DataFrame:
    """_key, _hash (of key and text), nth, n_bytes, shard, depth, shard_bytes, shard_rows of every row."""
    prepare(docs.sparkSession)
    rows = spread(_sized(docs, key, text), "n", "nth").drop("n")
    own = F.when(F.col("nth") == 0, F.col("_hash")).otherwise(F.md5(F.concat_ws("|", "_hash", F.col("nth").cast("string"))))
    rows = stash(rows.withColumn("_own", own).withColumn("_bits", _bits(F.col("_own"))), "sizes")
    total = rows.agg(F.sum("n_bytes")).first()[0] or 0
    start = min(MOST_BITS, max(0, math.ceil(math.log2(max(total, 1) / limit))))
    done = []
    while True:
        deep = min(start + LEVELS, MOST_BITS)
        cells = rows.groupBy(_prefix(deep).alias("cell")).agg(F.sum("n_bytes").alias("bytes"), F.count("*").alias("n"))
        found = rows.join(_directory(cells, start, deep, limit), _prefix(deep) == F.col("cell")).drop("cell")
        found = stash(found, f"level{deep}")
        done.append(found.where("shard is not null"))
        rest = found.where("shard is null")
        if rest.isEmpty():
            break
        rows = rest.drop("shard", "depth", "shard_bytes", "shard_rows")
        if deep == MOST_BITS:  # rows that share all bits of the directory are told apart by all bits of their hash
            bits = F.concat(*[F.lpad(F.conv(F.substring("_own", at, 1), 16, 2), 4, "0") for at in range(1, ALL_BITS // 4 + 1)])
            done.append(rows.select("*", bits.alias("shard"), F.lit(ALL_BITS).alias("depth"), F.col("n_bytes").alias("shard_bytes"), F.lit(1).cast("long").alias("shard_rows")))
            break
        start = deep
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out


def shards(docs: DataFrame, key: str = "doc_id", text: str = "text", limit: int = SHARD_BYTES) -> DataFrame:
    """One row per document: key, n_bytes (UTF-8; null: 0), shard (its hash-prefix bits; '' for the only one), depth, shard_bytes, shard_rows.

    Every shard has at most `limit` bytes, or is a single document that is larger by itself. The hash is of key and text, so a
    document's shard does not depend on the run; the second and further of repeated rows take a hash of their number too, so they
    spread like other rows. A null key is a key of its own, an empty table gives no rows. Other columns are not read.
    """
    return _dealt(docs, key, text, limit).select(F.col("_key").alias(key), "n_bytes", "shard", "depth", "shard_bytes", "shard_rows")


def write_shards(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", limit: int = SHARD_BYTES) -> DataFrame:
    """Write docs as Parquet, a folder per shard, named in a column `_shard` that must not be one of docs; returns shards().

    All columns of docs are kept. Of rows alike in key and text, which may differ in other columns, any goes to any of their shards.
    """
    if "_shard" in {c.lower() for c in docs.columns}:
        raise ValueError("documents have a column _shard")
    where = stash(_dealt(docs, key, text, limit), "shards")
    by = ["_key", "_hash"]
    keyed = packed(docs, _key=F.col(key), _hash=row_hash(F.col(key), F.col(text)))
    if where.where("nth > 0").isEmpty():
        keyed = keyed.withColumn("nth", F.lit(0).cast("long"))
    else:
        keyed = numbered(keyed, by, "nth")
    named = where.select(*by, "nth", F.concat(F.lit("b"), F.col("shard")).alias("_shard"))
    out = keyed.join(named, alike(keyed, named, [*by, "nth"])).select(*[F.col("_doc").getField(c).alias(c) for c in docs.columns], "_shard")
    out.repartition("_shard").write.partitionBy("_shard").parquet(path)
    return where.select(F.col("_key").alias(key), "n_bytes", "shard", "depth", "shard_bytes", "shard_rows")
