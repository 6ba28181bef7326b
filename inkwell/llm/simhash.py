"""SimHash near-duplicates by the generalised pigeonhole principle.

If the 64 bits fall into partitions with thresholds t_i and the sum of (t_i + 1) is one more than the distance, two
fingerprints within the distance are within t_i in some partition. Bits that go together share a partition, so that
partitions are less alike; how many partitions and which thresholds is decided by dynamic programming on candidate
counts estimated from all fingerprints. A fingerprint is then filed under its value in each partition and under all
values within the threshold; fingerprints that meet are verified by their whole distance.

A group that is too large is filed again under its value and each of distance + 1 blocks of the bits left, which loses no
link, until it is small or all bits are used. Of a group only a spanning forest is emitted, never all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from .common import arrow_map, packed, stash, text_bytes, unpacked
from .components import components

BITS = 64
DISTANCE = 3
SHINGLE = 3
SEED = 42
#: Largest group whose pairs are compared in one go.
GROUP = 1024
#: What moving a filed row costs, in comparisons.
ROW_COST = 5
MASK = (1 << BITS) - 1


def fingerprint(text: bytes | None, shingle: int = SHINGLE) -> int:
    """Bit i is set if it is in over half of the shingles' hashes, repeats counted; 0 without words."""
    words = (text or b"").lower().split()
    if not words:
        return 0
    whole = b" ".join(words)
    if len(words) <= shingle:
        hashes = [xxhash.xxh64_intdigest(whole, SEED)]
    else:
        starts = [0, *accumulate([len(w) + 1 for w in words])]
        digest = xxhash.xxh64_intdigest
        hashes = [digest(whole[a : b - 1], SEED) for a, b in zip(starts, starts[shingle:])]
    return majority(hashes)


def majority(hashes: list[int]) -> int:
    counts = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = np.array(hashes[at : at + (1 << 16)], "<u8")
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, text_hash, fp (the fingerprint as a signed long) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = np.array([fingerprint(t, shingle) for t in text_bytes(b.column(2))], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(found)], ["doc_id", "text_hash", "fp"])

    return arrow_map(docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("text_hash"), "text"), run, "doc_id long, text_hash long, fp long")


def together(fps: DataFrame) -> np.ndarray:
    """64 x 64 counts of fingerprints that have both bits, summed over all of them; 4,096 rows reach the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((BITS, BITS))
        for b in batches:
            x = np.unpackbits(b.column(0).to_numpy().astype("<i8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float32)
            total += x.T @ x
        cells = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(cells), pa.array(total.ravel()[cells].astype(np.int64))], ["cell", "n"])

    out = np.zeros(BITS * BITS)
    for cell, n in arrow_map(fps.select("fp"), run, "cell long, n long").groupBy("cell").agg(F.sum("n")).collect():
        out[cell] = n
    return out.reshape(BITS, BITS)


def grouped(both: np.ndarray, n: int, parts: int) -> list[list[int]]:
    """The bits in `parts` partitions of near equal width: each starts at the bit most tied to the others and takes in those most tied to it."""
    share = np.diag(both) / max(n, 1)
    spread = np.sqrt(np.clip(share * (1 - share), 1e-9, None))
    tie = np.abs((both / max(n, 1) - np.outer(share, share)) / np.outer(spread, spread))
    np.fill_diagonal(tie, 0)
    left, out = list(range(BITS)), []
    for k in range(parts):
        width = BITS * (k + 1) // parts - BITS * k // parts
        group = [max(left, key=lambda i: (tie[i, left].sum(), -i))]
        left.remove(group[0])
        while len(group) < width:
            group.append(max(left, key=lambda i: (tie[i, group].sum(), -i)))
            left.remove(group[-1])
        out.append(sorted(group))
    return out


def ball(width: int, radius: int) -> int:
    size = term = 1
    for k in range(radius):
        term = term * (width - k) // (k + 1)
        size += term
    return size if radius >= 0 else 0


def allocated(costs: list[list[float]], gains: list[list[int]], need: int) -> tuple[float, list[int]] | None:
    """costs[i][t + 1], gains[i][t + 1] of partition i at threshold t (from -1) -> the least total cost whose gains reach need, and its thresholds."""
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for row, gain in zip(costs, gains):
        step: dict[int, tuple[float, list[int]]] = {}
        for used, (cost, chosen) in best.items():
            for t, (extra, more) in enumerate(zip(row, gain), -1):
                reached = min(need, used + more)
                if reached not in step or cost + extra < step[reached][0]:
                    step[reached] = (cost + extra, [*chosen, t])
        best = step
    return best.get(need)


def thresholds(costs: list[list[float]], distance: int = DISTANCE) -> tuple[float, list[int]]:
    """The cheapest thresholds t whose t + 1 sum to distance + 1, by the pigeonhole principle enough for every pair within it."""
    return allocated(costs, [list(range(len(row))) for row in costs], distance + 1)


def scheme(fps: DataFrame, distance: int = DISTANCE) -> list[tuple[int, list[int], int]]:
    """Partitions as (mask, bits, threshold), those of threshold -1 left out, for the least estimated work on these fingerprints."""
    n = fps.count()
    both = together(fps)
    options = {m: grouped(both, n, m) for m in range(max(2, (distance + 2) // 2), distance + 2)}
    masks = sorted({_mask(bits) for parts in options.values() for bits in parts})
    counted = fps.select(F.explode(F.array(*[F.struct(F.lit(_signed(m)).alias("mask"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("value")) for m in masks])).alias("k"))
    counted = counted.groupBy("k.mask", "k.value").count().groupBy("mask").agg(F.sum(F.col("count").cast("double") * F.col("count")).alias("meet"))
    meet = {r["mask"] & MASK: r["meet"] for r in counted.collect()}  # a row per partition
    found = []
    for parts in options.values():
        costs = []
        for bits in parts:
            sizes = [ball(len(bits), t) for t in range(-1, distance + 1)]
            costs.append([size * (meet.get(_mask(bits), 0.0) + ROW_COST * max(n, 1)) for size in sizes])
        found.append((*thresholds(costs, distance), parts))
    _, chosen, parts = min(found, key=lambda x: x[0])
    return [(_mask(bits), bits, t) for bits, t in zip(parts, chosen) if t >= 0]


def _mask(bits: list[int]) -> int:
    return sum(1 << b for b in bits)


def _signed(x: int) -> int:
    return x - (1 << BITS) if x >> (BITS - 1) else x


def filed(fps: DataFrame, parts: list[tuple[int, list[int], int]]) -> DataFrame:
    """mask, at (the fingerprint, or one within the threshold in that partition), fp: rows meet where mask and at & mask agree."""

    def flips(bits: list[int], t: int) -> list[int]:
        return [_signed(_mask(list(c))) for r in range(t + 1) for c in combinations(bits, r)]

    keys = [F.struct(F.lit(_signed(mask)).alias("mask"), F.col("fp").bitwiseXOR(F.lit(x)).alias("at")) for mask, bits, t in parts for x in flips(bits, t)]
    return fps.select("fp", F.explode(F.array(*keys)).alias("k")).select("k.mask", "k.at", "fp")


def refined(mask: int, distance: int = DISTANCE) -> list[int]:
    """The masks under which a group that is too large is filed again."""
    rest = [b for b in range(BITS) if not mask >> b & 1]
    return [mask | _mask(rest[k :: distance + 1]) for k in range(min(distance + 1, len(rest)))]


def forest(fps: np.ndarray, distance: int = DISTANCE) -> tuple[np.ndarray, np.ndarray]:
    """Each fingerprint and the least one that it is linked to through others of this group; singles left out."""
    x = np.unique(fps)
    bits = x.view(np.uint64)
    label = np.arange(len(x))
    while True:
        least = np.empty_like(label)
        for at in range(0, len(x), 256):  # bounds the memory for groups of any size
            near = np.bitwise_count(bits[at : at + 256, None] ^ bits[None, :]) <= distance
            least[at : at + 256] = np.where(near, label[None, :], len(x)).min(1)
        least = least[least]
        if (least == label).all():
            break
        label = least
    far = label != np.arange(len(x))
    return x[far], x[label[far]]


def links(fps: DataFrame, distance: int = DISTANCE, group: int = GROUP) -> DataFrame:
    """Edges (a, b) between fingerprints within the distance that connect all that such links connect."""
    rows = filed(fps, scheme(fps, distance)).withColumn("value", F.col("at").bitwiseAND(F.col("mask")))
    out = None
    while True:
        rows = stash(rows.select("mask", "value", "at", "fp"), "filed")
        counts = rows.groupBy("mask", "value").count().where("count > 1")
        # Under all bits a group is one value and those within the threshold of it, a bounded number, and is compared as it is.
        fits = (F.col("count") <= group) | (F.col("mask") == -1)
        large = stash(counts.where(~fits).select("mask", "value"), "large")
        masks = [r["mask"] for r in large.select("mask").distinct().collect()]  # at most a few per partition and level
        small = rows.join(counts.where(fits).select("mask", "value"), ["mask", "value"], "left_semi")
        found = _compared(small, distance)
        out = found if out is None else out.union(found)
        if not masks:
            return out
        steps = fps.sparkSession.createDataFrame([(m, [_signed(x) for x in refined(m & MASK, distance)]) for m in masks], "mask long, next array<long>")
        again = rows.join(large, ["mask", "value"], "left_semi").join(F.broadcast(steps), "mask")  # a row per mask
        rows = again.select("at", "fp", F.explode("next").alias("mask")).withColumn("value", F.col("at").bitwiseAND(F.col("mask")))


def _compared(rows: DataFrame, distance: int) -> DataFrame:
    """Forests of the groups (mask, value), which are read one after the other in order of key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        key = None
        for b in batches:
            mask, value, fp = (b.column(i).to_numpy() for i in range(3))
            if not len(fp):
                continue
            cuts = [0, *(np.flatnonzero((mask[1:] != mask[:-1]) | (value[1:] != value[:-1])) + 1), len(fp)]
            done: list[tuple[np.ndarray, np.ndarray]] = []
            for lo, hi in zip(cuts, cuts[1:]):
                if key is not None and key != (mask[lo], value[lo]):
                    done.append(forest(np.concatenate(held), distance))
                    held = []
                key = (mask[lo], value[lo])
                held.append(fp[lo:hi])
            yield edges(done)
        if held:
            yield edges([forest(np.concatenate(held), distance)])

    def edges(done: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        a, b = ([x[k] for x in done if len(x[0])] for k in (0, 1))
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x) if x else np.zeros(0, np.int64)) for x in (a, b)], ["a", "b"])

    dealt = rows.select("mask", "value", "fp").repartition("mask", "value").sortWithinPartitions("mask", "value")
    return arrow_map(dealt, run, "a long, b long")


def near_duplicates(docs: DataFrame, distance: int = DISTANCE, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (the smallest doc_id reachable), text_hash, is_kept.

    Texts that are null or empty have fingerprint zero and are linked like any other; equal texts share a fingerprint
    and so a component. One row of each component, the first by doc_id (null last) and text_hash, has is_kept; rows alike
    in both are all marked. An empty table gives no rows; other columns are not read.
    """
    rows = stash(fingerprints(docs, shingle), "fingerprints")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash"))
    fps = stash(rows.groupBy("fp").agg(first.alias("first")), "distinct")
    roots = components(links(fps.select("fp"), distance))
    known = fps.join(roots, fps["fp"] == roots["node"], "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    known = stash(known, "roots")
    best = known.groupBy("root").agg(F.min("first").alias("best"))
    of = known.join(best, "root").select("fp", "best")
    joined = rows.join(of, "fp")
    kept = joined["doc_id"].eqNullSafe(F.col("best.doc_id")) & (joined["text_hash"] == F.col("best.text_hash"))
    return joined.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("best.doc_id").alias("component_id"), "text_hash", kept.alias("is_kept"))


def deduplicated(docs: DataFrame, distance: int = DISTANCE, shingle: int = SHINGLE) -> DataFrame:
    """One document of each component, with docs' columns; rows alike in doc_id and text become one."""
    kept = near_duplicates(docs, distance, shingle).where("is_kept").select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_th"))
    keyed = packed(docs, _doc_id=F.col("doc_id").cast("long"), _text_hash=F.xxhash64("text"))
    out = keyed.join(kept, keyed["_doc_id"].eqNullSafe(kept["_id"]) & (keyed["_text_hash"] == kept["_th"]), "left_semi")
    return unpacked(out.dropDuplicates(["_doc_id", "_text_hash"]), docs.columns)
