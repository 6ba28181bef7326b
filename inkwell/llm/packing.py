"""Best-fit packing by exact-complement hashing.

Only the number of pieces of each length decides a packing, so the plan is made on a histogram of at most
`capacity` counts, whatever the input's size: for the longest length left, the index of single, pair and triple
sums is asked for a combination that fills the gap exactly, as many sequences are made of it as counts allow, and
where there is none the longest piece that fits is added (best fit) and the smaller gap asked again. The plan is a
bounded list of (pattern, how many); pieces find their places in it by their rank among those of their length.
Ranks come from counters kept while the pieces are made and a prefix sum over (partition, length) counts, so no
length, however common, meets in one task.

Where the order of documents counts, as after a curriculum, spans of consecutive documents are packed each by itself and
sequences are numbered by span; a span ends in a sequence or two that are not full, which is what the order costs.
"""

from __future__ import annotations

import json
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import arrow_map, stash, text_bytes

CAPACITY = 4096
END_ID = 1
#: Consecutive documents that are packed together where their order counts, and the sequences that they may make.
SPAN_ROWS, SPAN_SEQUENCES = 1 << 10, 1 << 22
#: Bytes of text that a worker cuts at a time.
CHUNK_BYTES = 4_000_000
#: Words whose ids a worker remembers; more than that, and it starts again.
CACHE_WORDS = 600_000

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, local_rank long, span long"
_tokenizers: dict[str, WordIds] = {}


def _byte_letters() -> dict[int, str]:
    """Byte -> the character that stands for it in a byte-level vocabulary: itself if printable, else 256 upwards."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(other)}


_BYTE_LETTERS = _byte_letters()
_TAIL = b".,!?;:*#$%&|"


class WordIds(dict):
    """word -> its ids as little-endian unsigned 32-bit numbers.

    The tokenizer's normalizer and splitter never join what white space parts, so a text's ids are those of its
    words in a row; likewise those of a word are its stem's and those of the ASCII punctuation it ends in. A stem of
    letters alone is a single unit to the splitter and goes to the vocabulary's merges at once; any other word goes
    the whole way. That is so for tokenizers with the parts in PARTS; with any other, `by_word` is false and texts go whole.
    """

    # The normalizer and splitter of the tokenizer file whose texts can be taken word by word.
    PARTS = (
        [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}],
        [
            {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    )

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        self.merge = self.tokenizer.model.tokenize
        parts = json.loads(self.tokenizer.to_str())
        found = [(parts[k] or {}).get(name) for k, name in (("normalizer", "normalizers"), ("pre_tokenizer", "pretokenizers"))]
        self.by_word = found == list(self.PARTS) and parts["model"]["type"] == "BPE"

    def whole(self, word: bytes) -> bytes:
        return np.asarray(self.tokenizer.encode(word.decode("utf-8", "replace"), add_special_tokens=False).ids, "<u4").tobytes()

    def merged(self, letters: str) -> bytes:
        return b"".join([t.id.to_bytes(4, "little") for t in self.merge(letters)])

    def stem(self, stem: bytes) -> bytes:
        if stem.isalpha():  # of bytes: ASCII letters only
            return self.merged(stem.decode("ascii"))
        text = "".join([c.lower() for c in stem.decode("utf-8", "replace")])
        if not (text.isalpha() and unicodedata.is_normalized("NFC", text)):
            return self.whole(stem)
        return self.merged(text.encode().decode("latin-1").translate(_BYTE_LETTERS))

    def __missing__(self, word: bytes) -> bytes:
        low = word.lower()
        stem = low.rstrip(_TAIL)
        if b"<|" in word:  # special tokens are told by case
            found = self.whole(word)
        elif stem == word:
            found = self.stem(word)
        elif stem and (stem[-1:].isalnum() or stem.decode("utf-8", "replace")[-1].lower().isalpha()):
            found = self[stem] + (self[low[len(stem) :]] if len(stem) < len(low) else b"")
        else:  # signs alone, or a run of them that begins before the tail
            found = self.whole(low)
        self[word] = found
        return found

    def trim(self) -> None:
        """Bounds the memory; called between batches."""
        if len(self) > CACHE_WORDS:
            self.clear()


def word_ids(path: str) -> WordIds:
    if path not in _tokenizers:
        _tokenizers[path] = WordIds(path)
    return _tokenizers[path]


def token_bytes(text: bytes | None, ids: WordIds) -> bytes:
    """All ids of a text and END_ID, as bytes."""
    found = b"".join(map(ids.__getitem__, text.split())) if text and ids.by_word else ids.whole(text or b"")
    return found + END_ID.to_bytes(4, "little")


def _chunks(texts: list[bytes | None]) -> Iterator[range]:
    start = size = 0
    for i, t in enumerate(texts):
        size += len(t or b"") + 100
        if size >= CHUNK_BYTES:
            yield range(start, i + 1)
            start, size = i + 1, 0
    if start < len(texts):
        yield range(start, len(texts))


def pieces(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, span: Column | None = None) -> DataFrame:
    """One row per piece of each document; null and empty texts are the single id END_ID.

    local_rank counts the pieces of the same length made before by the same task; span is passed on.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, seen, part = word_ids(tokenizer_path), np.zeros(capacity + 1, np.int64), TaskContext.get().partitionId()
        for batch in batches:
            doc_ids, texts, spans = batch.column(0).to_pylist(), text_bytes(batch.column(1)), batch.column(2).to_pylist()
            for chunk in _chunks(texts):
                ids.trim()
                rows: list[tuple] = []
                for i in chunk:
                    data = token_bytes(texts[i], ids)
                    for k, start in enumerate(range(0, len(data), 4 * capacity)):
                        part_of = data[start : start + 4 * capacity]
                        n = len(part_of) // 4
                        rows.append((doc_ids[i], k, start // 4, n, zlib.crc32(part_of), part, int(seen[n]), spans[i]))
                        seen[n] += 1
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _PIECE_TYPES)], _PIECE_NAMES)

    span = F.lit(0) if span is None else span
    return arrow_map(docs.select(F.col("doc_id").cast("long"), "text", span.cast("long").alias("span")), cut, PIECES)


_PIECE_TYPES = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64())
_PIECE_NAMES = [c.split()[0] for c in PIECES.split(", ")]


def _moved(x: np.ndarray, by: int) -> np.ndarray:
    """x with what stands at s at s + by."""
    out = np.zeros_like(x)
    if by < len(x):
        out[by:] = x[: len(x) - by]
    return out


class SumIndex:
    """Tables keyed by sum: how many single lengths, pairs and triples that the counts allow have that sum.

    A length is once, twice or three times or more available; only when a count falls below one of these do the tables change,
    by the combinations that need it, so that a sum's entry is above 0 just when a combination of it can be taken.
    """

    def __init__(self, counts: np.ndarray):
        size = len(counts)
        self.counts = counts
        self.has = [counts >= k for k in (1, 2, 3)]  # once, twice, three times
        one, two, three = (h.astype(np.int64) for h in self.has)
        double = np.zeros(size, np.int64)
        double[::2] = two[: len(double[::2])]
        double[0] = 0
        twice = np.zeros(size, np.int64)
        twice[::2] = one[: len(twice[::2])]
        self.pairs = (_product(one, one) - twice) // 2 + double
        # Of all (x, y, z) in a row: three alike stand once, two alike three times, none alike six times.
        alike3 = np.zeros(size, np.int64)
        alike3[::3] = one[: len(alike3[::3])]
        two_alike = _product(twice, one) - alike3
        distinct = (_product(_product(one, one), one) - 3 * two_alike - alike3) // 6
        triple = np.zeros(size, np.int64)
        triple[::3] = three[: len(triple[::3])]
        alike2 = np.zeros(size, np.int64)  # (x, x) with x twice available, and another
        alike2[::2] = two[: len(alike2[::2])]
        own = np.zeros(size, np.int64)
        own[::3] = two[: len(own[::3])]
        self.triples = distinct + _product(alike2, one) - own + triple

    def take(self, length: int, times: int = 1) -> None:
        before, after = int(self.counts[length]), int(self.counts[length]) - times
        self.counts[length] = after
        for k in (3, 2, 1):
            if before >= k > after:
                self._drop(length, k)

    def _drop(self, x: int, k: int) -> None:
        """Length x is no longer k times available."""
        size = len(self.counts)
        if k == 3:
            self.has[2][x] = False
            if 3 * x < size:
                self.triples[3 * x] -= 1
            return
        others = self.has[0].copy()
        others[x] = False
        if k == 2:
            self.has[1][x] = False
            if 2 * x < size:
                self.pairs[2 * x] -= 1
                self.triples -= _moved(others.astype(np.int64), 2 * x)
            return
        self.has[0][x] = False
        with_x = _moved(others.astype(np.int64), x)
        self.triples -= _moved(self.pairs - with_x, x)
        self.pairs -= with_x

    def exact(self, gap: int) -> list[int] | None:
        """One, two or three lengths that can be taken and sum to gap, with the longest possible first."""
        if self.has[0][gap]:
            return [gap]
        if self.pairs[gap] > 0:
            small = np.arange(1, gap // 2 + 1)
            fits = self.has[0][small] & self.has[0][gap - small] & ((2 * small != gap) | self.has[1][small])
            low = int(small[np.argmax(fits)])
            return [gap - low, low]
        if self.triples[gap] > 0:
            x = np.arange(gap - 2, 0, -1)
            left = gap - 2 * x  # of a pair (x, left) that makes up the rest beside x
            with_x = (left > 0) & self.has[0][np.maximum(left, 0)] & (left != x)
            beside = self.pairs[gap - x] - with_x - ((left == x) & self.has[1][x])
            fits = self.has[0][x] & ((beside > 0) | (with_x & self.has[1][x]) | ((left == x) & self.has[2][x]))
            top = int(x[np.argmax(fits)])
            rest = gap - top
            small = np.arange(1, rest // 2 + 1)
            many = sum(h.astype(int) for h in self.has)
            both = 2 * small == rest
            fits = (many[small] >= 1 + (small == top) + both) & (many[rest - small] >= 1 + (rest - small == top) + both)
            low = int(small[np.argmax(fits)])
            return [top, rest - low, low]
        return None

    def longest(self, gap: int) -> int:
        """The longest length that fits into gap; 0 if none does."""
        fits = np.flatnonzero(self.has[0][1 : gap + 1])
        return int(fits[-1]) + 1 if len(fits) else 0


def _product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Numbers of ways to make each sum of one of a and one of b, up to the largest sum in the tables."""
    n = 2 * len(a)
    return np.rint(np.fft.irfft(np.fft.rfft(a, n) * np.fft.rfft(b, n), n))[: len(a)].astype(np.int64)


def plan(counts: np.ndarray, capacity: int = CAPACITY) -> list[tuple[list[int], int]]:
    """counts[length] -> [(lengths of a sequence, how many such sequences)]; every piece is placed."""
    left = counts.astype(np.int64).copy()
    left[0] = 0
    index, out = SumIndex(left), []
    for length in range(capacity, 0, -1):
        while left[length] > 0:
            combo, gap = [length], capacity - length
            index.take(length)
            while gap:
                found = index.exact(gap) or [x for x in [index.longest(gap)] if x]
                if not found:
                    break
                for x in found:
                    index.take(x)
                combo += found
                gap -= sum(found)
            lengths, uses = np.unique(combo, return_counts=True)
            more = int((left[lengths] // uses).min())
            for x, n in zip(lengths.tolist(), uses.tolist()):
                index.take(x, n * more)
            out.append((combo, 1 + more))
    return out


def places(packing: list[tuple[list[int], int]]) -> dict[str, np.ndarray]:
    """The plan by length: pieces of rank first to first + times - 1 go to sequences from `sequence` on, at `offset`."""
    rows, first, sequence = [], {}, 0
    for combo, times in packing:
        offset = 0
        for length in combo:
            rank = first.get(length, 0)
            rows.append((length, rank, sequence, offset))
            first[length] = rank + times
            offset += length
        sequence += times
    rows.sort()
    length, rank, base, offset = (np.array(x, np.int64) for x in zip(*rows)) if rows else [np.zeros(0, np.int64)] * 4
    return {"key": (length << 48) + rank, "first": rank, "sequence": base, "offset": offset}


_PACKED = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
_PACKED_NAMES = [c.split()[0] for c in _PACKED.split(", ")]


def _placed(where: dict[str, np.ndarray], length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sequence and offset of pieces by length and rank."""
    at = np.searchsorted(where["key"], (length << 48) + rank, "right") - 1
    return where["sequence"][at] + rank - where["first"][at], where["offset"][at]


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY) -> DataFrame:
    """Pack all documents into sequences of at most `capacity` tokens.

    Returns doc_id, piece, start, length, ids_crc32, sequence_id, offset. Null and empty texts are one token long,
    repeated rows are packed each, an empty table gives no rows; columns besides doc_id and text are not read.
    """
    made = stash(pieces(docs, tokenizer_path, capacity), "pieces")
    groups = made.groupBy("part", "length").agg(F.count("*").alias("n"))
    counts = np.zeros(capacity + 1, np.int64)
    for length, n in made.groupBy("length").count().collect():  # at most `capacity` rows
        counts[length] = n
    where = places(plan(counts, capacity))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    firsts = groups.select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first_rank"))
    ranked = made.join(firsts, ["part", "length"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("first_rank") + F.col("local_rank")).alias("rank"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sequence, offset = _placed(where, b.column(3).to_numpy(), b.column(5).to_numpy())
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(5)), pa.array(sequence), pa.array(offset)], _PACKED_NAMES)

    return arrow_map(ranked, place, _PACKED)


def in_order(docs: DataFrame) -> Column:
    """The span of each row, for pack_in_order(): SPAN_ROWS rows of a Parquet file, by its part number, or of a partition."""
    try:
        name, row = F.col("_metadata.file_name"), F.col("_metadata.row_index")
        docs.select(name, row).schema  # noqa: B018  resolves the columns
    except AnalysisException:
        at = F.monotonically_increasing_id()
        return F.shiftleft(F.shiftright(at, 33), 20) + F.floor(at.bitwiseAND(F.lit((1 << 33) - 1)) / SPAN_ROWS).cast("long")
    part = F.coalesce(F.expr("try_cast(regexp_extract(_metadata.file_name, 'part-([0-9]+)', 1) as long)"), F.lit(0))
    return F.shiftleft(part, 20) + F.floor(row / SPAN_ROWS).cast("long")


def pack_in_order(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY) -> DataFrame:
    """pack(), with sequences numbered in the order of documents: a row of one span is in a sequence before any of a later span.

    The order is that of the part files of a Parquet folder and of the rows in them; of other DataFrames that of their partitions.
    A span has SPAN_ROWS documents at most, which are planned and placed in one task without their texts.
    """
    made = pieces(docs, tokenizer_path, capacity, in_order(docs))

    def place(span: pa.Table) -> pa.Table:
        span = span.sort_by([("length", "ascending"), ("part", "ascending"), ("local_rank", "ascending")])
        length = span["length"].to_numpy()
        counts = np.bincount(length, minlength=capacity + 1)
        rank = np.arange(len(length)) - (np.cumsum(counts) - counts)[length]
        sequence, offset = _placed(places(plan(counts, capacity)), length, rank)
        sequence = span["span"].to_numpy() * SPAN_SEQUENCES + sequence
        return pa.table([*(span[c] for c in _PACKED_NAMES[:5]), pa.array(sequence), pa.array(offset)], _PACKED_NAMES)

    return made.groupBy("span").applyInArrow(place, _PACKED)
