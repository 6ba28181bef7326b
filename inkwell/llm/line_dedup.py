"""Line dedup by a deletion-neighbourhood join.

Lines are compared as sequences of words. A line is a duplicate if an earlier one is equal to it, or, where both have at
least `least` words, within one edit of it (a word inserted, deleted or replaced): one edit in LEAST_WORDS words is the nearness
asked for, as one of fewer says something else more often than the same. Order is that of documents, then of lines.

Every line's variants, itself and each way to delete one word, are hashed. Lines with an equal variant from the same place differ in
the deleted word alone; a line equal to another's variant lacks one of its words. So the earliest of each (variant, place) is all that
later ones need to meet, and a variant that very many lines share costs a minimum, not pairs. What meets is verified on the words.

Before that, equal lines are one, and a line stays in only if another shares its first or last words, about half of
them, which one edit cannot change both of.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from .common import arrow_map, packed, stash, text_bytes, unpacked
from .substring_dedup import _BASE, LAST, mixed, word_hashes

#: Words that a line must have for one edit to be near.
LEAST_WORDS = 8
#: Bytes of lines that a worker takes at a time.
CHUNK_BYTES = 1_000_000

_LINES = "id long, th long, line int, n int, fh binary, k1 long, k2 long, k3 long, k4 long"
_LINE_TYPES = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary(), *[pa.int64()] * 4]
_LINE_NAMES = [c.split()[0] for c in _LINES.split(", ")]
_PLACE = ["id", "th", "line"]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def half(n: int) -> int:
    """Words at one end that a line of n words and another within one edit, not shorter, must share."""
    return 1 << ((n // 2).bit_length() - 1)


def ends(words: list[bytes], least: int = LEAST_WORDS) -> list[int | None]:
    """Hashes of the line's first and last words, as many as lines of its length and of one word less must share."""
    n, out = len(words), []
    if n >= least:
        for size in dict.fromkeys((half(n), half(max(n - 1, least)))):
            out += [_signed(xxhash.xxh3_64_intdigest(b" ".join(words[:size]), 2 * size)), _signed(xxhash.xxh3_64_intdigest(b" ".join(words[-size:]), 2 * size + 1))]
    return out + [None] * (4 - len(out))


def variants(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of a line's variants and their places: 0 for the line itself, i for the line without its word number i."""
    h = word_hashes(text)
    n = len(h)
    powers = np.full(n + 1, _BASE, np.uint64)
    powers[0] = 1
    np.cumprod(powers, out=powers)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(h * powers[:n], out=sums[1:])
    without = sums[:-1] + (sums[-1] - sums[1:]) * np.uint64(pow(_BASE, -1, 1 << 64))
    return mixed(np.append(sums[-1:], without)), np.arange(n + 1, dtype=np.int32)


def within_one(a: list[bytes], b: list[bytes]) -> bool:
    """Whether one inserted, deleted or replaced word at most makes a into b."""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1:
        return False
    i = 0
    while i < len(a) and a[i] == b[i]:
        i += 1
    return a[i + 1 :] == b[i + 1 :] if len(a) == len(b) else a[i:] == b[i + 1 :]


def _batch(rows: list[tuple], names: list[str], types: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("id"), F.xxhash64("text").alias("th"), "text")


def lines(docs: DataFrame, least: int = LEAST_WORDS) -> DataFrame:
    """A row per line with a word: its place, number of words, digest of the words, and hashes of its ends."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, size = [], 0
            for id_, th, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), text_bytes(b.column(2))):
                for k, line in enumerate((text or b"").split(b"\n")):
                    if words := line.split():
                        rows.append((id_, th, k, len(words), xxhash.xxh3_128_digest(b" ".join(words)), *ends(words, least)))
                        size += len(line) + 100
                        if size > CHUNK_BYTES:
                            yield _batch(rows, _LINE_NAMES, _LINE_TYPES)
                            rows, size = [], 0
            if rows:
                yield _batch(rows, _LINE_NAMES, _LINE_TYPES)

    return arrow_map(_keyed(docs), run, _LINES)


def first_lines(docs: DataFrame, least: int = LEAST_WORDS) -> DataFrame:
    """The earliest of equal lines: place, n, hashes of ends."""
    keys = ["k1", "k2", "k3", "k4"]
    first = lines(docs, least).groupBy("fh").agg(F.min(F.struct(*_PLACE)).alias("p"), F.first("n").alias("n"), *[F.first(k).alias(k) for k in keys])
    return first.select("p.*", "n", *keys)


def _similar(firsts: DataFrame) -> DataFrame:
    """id, th, wanted: the lines of each document that share an end with another line."""
    ends_ = firsts.select(*_PLACE, F.explode(F.array_compact(F.array("k1", "k2", "k3", "k4"))).alias("key"))
    shared = ends_.groupBy("key").count().where("count > 1").select("key")
    return ends_.join(shared, "key", "left_semi").groupBy("id", "th").agg(F.collect_set("line").alias("wanted"))


def _wanted(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """seq, id, th, line, words: the wanted lines, numbered in order."""
    docs, wanted = _keyed(docs), wanted.withColumnsRenamed({"id": "_id", "th": "_th"})
    joined = docs.join(wanted, (docs["id"] == wanted["_id"]) & (docs["th"] == wanted["_th"])).select("id", "th", "text", "wanted")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.int64(), pa.int64(), pa.int32(), pa.binary()]
        for b in batches:
            rows, size = [], 0
            for id_, th, text, chosen in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), text_bytes(b.column(2)), b.column(3).to_pylist()):
                all_lines = (text or b"").split(b"\n")
                for k in chosen:
                    rows.append((id_, th, k, b" ".join(all_lines[k].split())))
                    size += len(all_lines[k]) + 30
                    if size > CHUNK_BYTES:
                        yield _batch(rows, [*_PLACE, "words"], types)
                        rows, size = [], 0
            if rows:
                yield _batch(rows, [*_PLACE, "words"], types)

    # Rows alike in doc_id and text are one document.
    found = stash(arrow_map(joined, run, "id long, th long, line int, words binary").dropDuplicates(_PLACE), "wanted")
    return stash(found.repartitionByRange(*_PLACE).sortWithinPartitions(*_PLACE).withColumn("seq", F.monotonically_increasing_id()), "numbered")


def _variant_rows(numbered: DataFrame) -> DataFrame:
    names = ["variant", "slot", "seq"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found, size = [], 0
            for seq, text in zip(b.column(0).to_pylist(), text_bytes(b.column(1))):
                variant, slot = variants(text)
                found.append((variant, slot, np.full(len(slot), seq)))
                size += len(text) + 20 * len(slot)
                if size > CHUNK_BYTES:
                    yield joined(found)
                    found, size = [], 0
            if found:
                yield joined(found)

    def joined(found: list[tuple]) -> pa.RecordBatch:
        variant, slot, seq = (np.concatenate(x) for x in zip(*found))
        return pa.RecordBatch.from_arrays([pa.array(variant.view(np.int64)), pa.array(slot), pa.array(seq)], names)

    return arrow_map(numbered.select("seq", "words"), run, "variant long, slot int, seq long")


def near_lines(docs: DataFrame, firsts: DataFrame) -> DataFrame:
    """id, th, line of those first lines that are within one edit of an earlier one."""
    numbered = _wanted(docs, _similar(firsts))
    rows = _variant_rows(numbered)
    whole, cut = F.col("slot") == 0, F.col("slot") > 0
    met = rows.groupBy("variant").agg(F.count("*").alias("n"), F.min(F.when(whole, F.col("seq"))).alias("whole"), F.min(F.when(cut, F.col("seq"))).alias("cut"))
    met = met.where("n > 1").select(F.col("variant").alias("_v"), "whole", "cut")
    rows = stash(rows.join(met, rows["variant"] == met["_v"]).drop("_v"), "met")
    same = rows.groupBy("variant", "slot").agg(F.min("seq").alias("same"))
    pairs = rows.join(same, ["variant", "slot"]).withColumn("earlier", F.least("same", F.when(whole, F.col("cut")).otherwise(F.col("whole"))))
    pairs = pairs.where("earlier < seq").groupBy("seq").agg(F.min("earlier").alias("earlier"))
    one = numbered.select("seq", *_PLACE, F.col("words").alias("a"))
    other = numbered.select(F.col("seq").alias("earlier"), F.col("words").alias("b"))

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            good = [within_one(x.split(b" "), y.split(b" ")) for x, y in zip(b.column(3).to_pylist(), b.column(4).to_pylist())]
            yield pa.RecordBatch.from_arrays(b.columns[:3], _PLACE).filter(pa.array(good, pa.bool_()))

    return arrow_map(pairs.join(one, "seq").join(other, "earlier").select(*_PLACE, "a", "b"), verify, "id long, th long, line int")


def _kept(docs: DataFrame, least: int) -> DataFrame:
    firsts = stash(first_lines(docs, least), "first_lines")
    near = stash(near_lines(docs, firsts), "near")
    marked = firsts.join(near.withColumn("_near", F.lit(True)), _PLACE, "left")
    return marked.groupBy("id", "th").agg(
        F.sort_array(F.collect_list(F.when(F.col("_near").isNull(), F.col("line")))).alias("kept"),
        F.count("_near").alias("n_near"),
    )


def _n_lines(text: Column) -> Column:
    return F.size(F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))


def decisions(docs: DataFrame, least: int = LEAST_WORDS) -> DataFrame:
    """One row per document: doc_id, n_lines (with a word), n_removed, n_near (of those, the near ones), kept_lines (their numbers from 0).

    Null and empty texts have no lines. A null doc_id comes after all others; rows of equal doc_id come in order of their text's hash, and
    rows alike in both are one document, so both have the same result. An empty table gives no rows; other columns are not read.
    """
    kept = _kept(docs, least).withColumnsRenamed({"id": "_id", "th": "_th"})
    base = docs.select("doc_id", F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("id"), F.xxhash64("text").alias("th"), _n_lines(F.col("text")).cast("long").alias("n_lines"))
    joined = base.join(kept, (base["id"] == kept["_id"]) & (base["th"] == kept["_th"]), "left")
    lines_kept = F.coalesce("kept", F.array().cast("array<int>"))
    return joined.select("doc_id", "n_lines", (F.col("n_lines") - F.size(lines_kept)).alias("n_removed"), F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), lines_kept.alias("kept_lines"))


def deduplicated(docs: DataFrame, least: int = LEAST_WORDS) -> DataFrame:
    """docs without their duplicate lines, and without documents of which no word is left though they had some.

    Lines without a word stay where they are. Rows, ids, texts and tables without any are as in decisions(); all columns are kept.
    """
    kept = _kept(docs, least).select(F.col("id").alias("_id"), F.col("th").alias("_th"), "kept")
    keyed = packed(docs, _i=F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)), _t=F.xxhash64("text"))
    text = F.col("_doc").getField("text")
    joined = keyed.join(kept, (keyed["_i"] == kept["_id"]) & (keyed["_t"] == kept["_th"]), "left").withColumn("_n", _n_lines(text))
    gone = (F.col("_n") > 0) & (F.col("kept").isNull() | (F.size("kept") == 0))
    joined = joined.where(~F.coalesce(gone, F.lit(False))).withColumn("_lines", F.split(text, "\n"))
    # By the numbers of the lines that stay, in order: a step per line, however many a document has.
    blank = F.array_compact(F.transform("_lines", lambda x, i: F.when(~x.rlike(r"[^\x20\x09-\x0D]"), i)))
    joined = joined.withColumn("_stay", F.array_sort(F.concat("kept", blank)))
    left = F.array_join(F.transform("_stay", lambda i: F.get(F.col("_lines"), i)), "\n")
    return unpacked(joined, docs.columns, text=F.when(F.col("_n") > F.size("kept"), left).otherwise(text))
