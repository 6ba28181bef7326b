"""Removing long passages that an earlier document has too, with fixed-block anchors.

A window of 50 words holds a whole block of 25 whichever document's grid of blocks is laid over it. So each document's
non-overlapping blocks are the index, every rolling window of 25 words is a probe, and a probe that meets a block of
another document is an anchor. Windows of 50 around anchors are the only ones that can repeat; they are extended as long as
they do by comparing their whole hashes across documents, and the union of those found earlier is the maximal repeats.

Probes are sent to the index in packed form, some 5 bytes each, by hash range: a bucket's blocks come first and are
kept with only their smallest and largest document, then probes stream past. There are as many buckets as the
bytes of all texts ask for, so that an index fits a worker and hits by accident stay rare at any size. So a passage that very many documents share costs no pairs
and no memory. Exact copies are settled by the digest of the text and neither index nor probe.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .common import arrow_map, prepare, text_bytes

WINDOW = 50
LAST = (1 << 63) - 1
#: From here on numbers stand for a null doc_id, which is larger than any other: one of many, by text, so that nulls spread.
NULL = LAST - (1 << 24)
#: Bytes of text that a worker hashes at a time, words whose hashes it remembers.
CHUNK_BYTES = 3_000_000
CACHE_WORDS = 300_000
#: Bytes of text whose blocks one bucket indexes at most: some 7 million blocks, a 600th of the hashes that a bucket tells apart.
BUCKET_BYTES = 1 << 29
_BASE = 0x9E3779B97F4A7C15

PACKED = "bucket int, kind int, ids binary, counts binary, places binary, hashes binary"


class WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        found = self[word] = xxhash.xxh3_64_intdigest(word)
        return found


_hashes = WordHashes()


def word_hashes(text: bytes | None) -> np.ndarray:
    words = (text or b"").split()
    if len(_hashes) > CACHE_WORDS:
        _hashes.clear()
    return np.fromiter(map(_hashes.__getitem__, words), np.uint64, len(words))


def rolling(hashes: np.ndarray, width: int) -> np.ndarray:
    """Hash of each window of `width` words: a polynomial modulo 2**64 over random word hashes, then mixed."""
    n = len(hashes)
    if n < width:
        return np.zeros(0, np.uint64)
    up = np.full(n + 1, _BASE, np.uint64)
    down = np.full(n + 1, pow(_BASE, -1, 1 << 64), np.uint64)
    up[0] = down[0] = 1
    np.cumprod(up, out=up)
    np.cumprod(down, out=down)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(hashes * up[:n], out=sums[1:])
    return mixed((sums[width:] - sums[:-width]) * down[: n - width + 1])


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _planes(x: np.ndarray) -> bytes:
    """32-bit numbers byte by byte: the high bytes, nearly all zero, then cost next to nothing when compressed."""
    return np.ascontiguousarray(x.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes()


def _unplanes(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(4, -1).T).view("<u4").ravel()


def packed(kind: int, ids: np.ndarray, places: np.ndarray, hashes: np.ndarray, buckets: int) -> list[tuple]:
    """Rows by bucket of (document, place, hash); the bucket is the hash's upper half scaled, its lower half is kept."""
    bucket = ((hashes >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.uint16 if buckets <= 1 << 16 else np.uint32)
    order = np.argsort(bucket, kind="stable")
    bucket, ids, places, low = bucket[order], ids[order], places[order], (hashes & np.uint64(0xFFFFFFFF)).astype("<u4")[order]
    new = np.empty(len(ids), bool)  # a run is what one document has in one bucket
    new[:1] = True
    new[1:] = (bucket[1:] != bucket[:-1]) | (ids[1:] != ids[:-1])
    runs = np.flatnonzero(new)
    steps = places.copy()
    steps[1:] -= places[:-1]
    steps[runs] = places[runs]
    counts = np.diff(np.append(runs, len(ids)))
    used, starts = np.unique(bucket, return_index=True)
    run_at = np.searchsorted(runs, starts)
    ends, run_ends = np.append(starts[1:], len(ids)), np.append(run_at[1:], len(runs))
    return [(int(u), kind, ids[runs[p:q]].astype("<i8").tobytes(), _planes(counts[p:q]), _planes(steps[a:b]), low[a:b].tobytes()) for u, a, b, p, q in zip(used, starts, ends, run_at, run_ends)]


def unpacked(ids: bytes, counts: bytes, steps: bytes, hashes: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """ids and counts of the runs, places and hashes of all."""
    n, delta = _unplanes(counts).astype(np.int64), _unplanes(steps).astype(np.int64)
    total = np.cumsum(delta)
    before = np.append(0, np.cumsum(n)[:-1])
    places = total - np.repeat(total[before] - delta[before], n)
    return np.frombuffer(ids, "<i8"), n, places, np.frombuffer(hashes, "<u4")


def _chunks(texts: list[bytes | None]) -> Iterator[range]:
    start = size = 0
    for i, t in enumerate(texts):
        size += len(t or b"")
        if size >= CHUNK_BYTES:
            yield range(start, i + 1)
            start, size = i + 1, 0
    if start < len(texts):
        yield range(start, len(texts))


def even_keys(spark: SparkSession, n: int) -> list[int]:
    """For each of n partitions a number that Spark's hash partitioning sends there, so that n buckets fill n partitions alike."""
    tries = spark.range(int(n * (math.log(n) + 12))).select(F.col("id").cast("int").alias("k"))
    first = {r["p"]: r["k"] for r in tries.groupBy(F.pmod(F.hash("k"), F.lit(n)).alias("p")).agg(F.min("k").alias("k")).collect()}  # n rows
    return [first.get(i, i) for i in range(n)]


def _probes(keys: list[int], window: int):
    block, buckets = window // 2, len(keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, texts, chosen = b.column(0).to_pylist(), text_bytes(b.column(1)), b.column(2).to_pylist()
            for part in _chunks(texts):
                docs, places, hashes = [], [], []
                for i in part:
                    if chosen[i] and len(words := word_hashes(texts[i])) >= window:
                        found = rolling(words, block)
                        docs.append(np.full(len(found), ids[i], np.int64))
                        places.append(np.arange(len(found)))
                        hashes.append(found)
                if not docs:
                    continue
                doc, place, found = (np.concatenate(x) for x in (docs, places, hashes))
                grid = place % block == 0
                rows = packed(0, doc[grid], place[grid], found[grid], buckets) + packed(1, doc, place, found, buckets)
                rows = [(keys[r[0]], *r[1:]) for r in rows]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _PACKED_TYPES)], _PACKED_NAMES)

    return run


_PACKED_NAMES = [c.split()[0] for c in PACKED.split(", ")]
_PACKED_TYPES = [pa.int32(), pa.int32(), *[pa.binary()] * 4]


class Blocks:
    """A bucket's index: each hash with the smallest and the largest document that has it."""

    def __init__(self) -> None:
        self.hashes, self.least, self.most = np.zeros(0, "<u4"), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.new: list[tuple[np.ndarray, np.ndarray]] = []
        self.waiting = 0

    def add(self, hashes: np.ndarray, ids: np.ndarray) -> None:
        self.new.append((hashes, ids))
        self.waiting += len(ids)
        if self.waiting > max(1 << 18, len(self.hashes)):
            self.settle()

    def settle(self) -> None:
        if not self.new:
            return
        hashes = np.concatenate([self.hashes, *(x[0] for x in self.new)])
        least = np.concatenate([self.least, *(x[1] for x in self.new)])
        most = np.concatenate([self.most, *(x[1] for x in self.new)])
        order = np.argsort(hashes, kind="stable")
        hashes, least, most = hashes[order], least[order], most[order]
        starts = np.flatnonzero(np.append(True, hashes[1:] != hashes[:-1]))
        self.hashes, self.least, self.most = hashes[starts], np.minimum.reduceat(least, starts), np.maximum.reduceat(most, starts)
        self.new, self.waiting = [], 0

    def others(self, hashes: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """Whether a document other than ids has a block of that hash."""
        self.settle()
        if not len(self.hashes):
            return np.zeros(len(hashes), bool)
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        hit = self.hashes[at] == hashes
        hit[hit] = (self.least[at[hit]] != ids[hit]) | (self.most[at[hit]] != ids[hit])
        return hit


def _anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in order of bucket and kind -> id and the places of its probes that met another document's block."""
    bucket, blocks = None, Blocks()
    for b in batches:
        for row in zip(*(c.to_pylist() for c in b.columns)):
            if row[0] != bucket:
                bucket, blocks = row[0], Blocks()
            ids, counts, places, hashes = unpacked(*row[2:])
            each = np.repeat(ids, counts)
            if row[1] == 0:
                blocks.add(hashes, np.minimum(each, NULL))
                continue
            hit = blocks.others(hashes, np.minimum(each, NULL))
            if not hit.any():
                continue
            each, places = each[hit], places[hit]
            starts = np.flatnonzero(np.append(True, each[1:] != each[:-1]))
            offsets = np.append(starts, len(each)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(each[starts]), pa.ListArray.from_arrays(pa.array(offsets), pa.array(places.astype(np.int32)))], ["_id", "places"])


def _near_anchors(n: int, places: list[list[int]] | None, window: int) -> np.ndarray:
    """The starts of windows that hold an anchor."""
    block = window // 2
    mark = np.zeros(n + 1, np.int64)
    at = np.concatenate([np.asarray(p, np.int64) for p in places])
    mark[at[at < n] + 1] = 1
    seen = np.cumsum(mark)
    starts = np.arange(n - window + 1)
    return starts[seen[starts + window - block + 1] > seen[starts]]


def _candidates(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = text_bytes(b.column(1))
            for i, (doc, places, chosen) in enumerate(zip(b.column(0).to_pylist(), b.column(3).to_pylist(), b.column(2).to_pylist())):
                if places is None or not chosen or len(words := word_hashes(texts[i])) < window:
                    continue
                found = np.unique(rolling(words, window)[_near_anchors(len(words), places, window)]).view(np.int64)
                if len(found):
                    yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(np.full(len(found), doc))], ["h", "_id"])

    return run


def _results(window: int, with_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for doc, text, first, found in zip(b.column(0).to_pylist(), text_bytes(b.column(1)), b.column(2).to_pylist(), b.column(3).to_pylist()):
                words = (text or b"").split()
                n, spans = len(words), []
                if not first and n >= window:
                    spans = [(0, n)]
                elif found is not None and n >= window:
                    repeated = np.concatenate([np.asarray(x, np.int64) for x in found]).view(np.uint64)
                    spans = covered(np.flatnonzero(np.isin(rolling(word_hashes(text), window), repeated)), window)
                kept, at = [], 0
                for start, end in spans:
                    kept += words[at:start]
                    at = end
                kept = b" ".join(kept + words[at:])
                rows.append((None if doc >= NULL else doc, n, sum(e - s for s, e in spans), hashlib.sha256(kept).hexdigest(), spans, kept.decode() if with_text else None))
            out = zip(*rows) if rows else [[]] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, _RESULT_TYPES)], _RESULT_NAMES)

    return run


_SPAN = pa.struct([("start", pa.int64()), ("end", pa.int64())])
_RESULT_NAMES = ["doc_id", "n_words", "n_removed", "kept_sha256", "spans", "text"]
_RESULT_TYPES = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(_SPAN), pa.string()]
RESULT = "doc_id long, n_words long, n_removed long, kept_sha256 string, spans array<struct<start long, end long>>, text string"


def covered(starts: np.ndarray, window: int) -> list[tuple[int, int]]:
    """The union of windows as spans of words: maximal repeats."""
    if not len(starts):
        return []
    cut = np.flatnonzero(np.diff(starts) > window)
    return [(int(starts[a]), int(starts[b]) + window) for a, b in zip(np.append(0, cut + 1), np.append(cut, len(starts) - 1))]


def removed(docs: DataFrame, window: int = WINDOW, with_text: bool = True) -> DataFrame:
    """One row per document: doc_id, n_words, n_removed, kept_sha256, spans (of removed words), text (kept words joined by a space).

    A word goes if a window of `window` words over it starts in a document of smaller doc_id too. Null and empty texts have no
    words; a null doc_id counts as larger than any other; rows alike in doc_id are not earlier than one another; an empty table gives no rows.
    Other columns are not read. Texts cross the network once: the exchange by doc_id is used again by every join.
    """
    spark = prepare(docs.sparkSession)
    size = docs.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // BUCKET_BYTES))
    null = F.lit(NULL) + F.pmod(F.xxhash64("text"), F.lit(LAST - NULL))
    base = docs.select(F.coalesce(F.col("doc_id").cast("long"), null).alias("_id"), "text", F.md5(F.coalesce("text", F.lit(""))).alias("_md5"))
    dealt = base.repartition(buckets, "_id")
    firsts = base.groupBy("_md5").agg(F.min("_id").alias("_first")).groupBy("_first").agg(F.collect_set("_md5").alias("_own"))

    def flagged() -> DataFrame:
        joined = dealt.join(firsts, dealt["_id"] == firsts["_first"], "left")
        return joined.select("_id", "text", F.coalesce(F.array_contains("_own", F.col("_md5")), F.lit(False)).alias("_is_first"))

    sent = arrow_map(flagged(), _probes(even_keys(spark, buckets), window), PACKED).repartition(buckets, "bucket").sortWithinPartitions("bucket", "kind")
    anchors = arrow_map(sent, _anchors, "_id long, places array<int>").groupBy("_id").agg(F.collect_list("places").alias("places"))
    windows = arrow_map(_with(flagged(), anchors, F.col("places")), _candidates(window), "h long, _id long")
    place = F.least(F.col("_id"), F.lit(NULL))
    least = windows.groupBy("h").agg(F.min(place).alias("least"), F.max(place).alias("most")).where("least < most").select(F.col("h").alias("_h"), "least")
    found = windows.join(least, windows["h"] == least["_h"]).where(place > F.col("least"))
    found = found.groupBy("_id").agg(F.collect_list("h").alias("found")).withColumn("found", F.array("found"))
    return arrow_map(_with(flagged(), found, F.col("found")), _results(window, with_text), RESULT)


def _with(docs: DataFrame, more: DataFrame, value: Column) -> DataFrame:
    more = more.select(F.col("_id").alias("_of"), value.alias("_more"))
    return docs.join(more, docs["_id"] == more["_of"], "left").select("_id", "text", "_is_first", "_more")
