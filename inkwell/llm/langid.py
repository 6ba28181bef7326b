"""Language identification with a linear-chain conditional random field over words.

Each word has hashed features (the word, its character n-grams with marked ends, so affixes too) and lexicon features (whether
it is among a language's frequent words); languages of neighbouring words are tied by learned transitions. Forward-backward
labels each word, so text that switches languages is followed, and a document's language is the one with most of its words.

The field is fitted on the driver to a bounded sample of labelled documents, cut into sequences that switch between
languages; every other step covers all documents, a few thousand at a time, all of them moving forward one word at a step.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import arrow_map, text_bytes

#: Bounds of the sample: documents of each language, characters of a document, languages.
SAMPLE_DOCS, SAMPLE_CHARS, LANGUAGES = 150, 20_000, 200
#: Parts that the rows of a language are ranked in before its sample is chosen.
WAYS = 32
DIMS = 1 << 16
GRAMS = (2, 3, 4)
LEXICON = 200
STEPS, RATE, SHRINK = 40, 0.5, 1e-4
SEQUENCE = 48
CACHE_WORDS = 200_000
CHUNK_BYTES = 3_000_000
UNDETERMINED = "und"

_EDGES = b".,;:!?\"'()[]{}<>#*$%&|-_/\\=+~`^@0123456789"
_LETTER = re.compile(rb"[A-Za-z]")


def held_out(doc_id: Column) -> Column:
    """Documents that are never learned from."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 3 == 1


def normal(word: bytes) -> bytes:
    return word.lower().strip(_EDGES)


def has_letter(text: bytes | None) -> bool:
    if not text:
        return False
    return bool(_LETTER.search(text)) or any(c.isalpha() for c in text.decode("utf-8", "replace"))


def hashed(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Feature numbers of normal words, and whose each is."""
    marked = np.frombuffer(b"".join([b"\x02" + w + b"\x03" for w in words]), np.uint8).astype(np.uint32)
    lengths = np.array([len(w) + 2 for w in words])
    owner = np.repeat(np.arange(len(words)), lengths)
    place = np.arange(len(marked)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    ids, owners = [np.array([xxhash.xxh32_intdigest(w) % DIMS for w in words], np.int64)], [np.arange(len(words))]
    for n in GRAMS:
        whole = np.flatnonzero(place + n <= lengths[owner])
        value = np.full(len(whole), n, np.uint32)
        for k in range(n):
            value = (value ^ marked[whole + k]) * np.uint32(0x01000193)
        value ^= value >> np.uint32(15)
        value *= np.uint32(0x85EBCA6B)
        ids.append(((value >> np.uint32(16)) % DIMS).astype(np.int64))
        owners.append(owner[whole])
    return np.concatenate(ids), np.concatenate(owners)


@dataclass
class Field:
    """The fitted field: weights by feature and language, by lexicon and language, and transitions from row to column."""

    langs: list[str]
    weights: np.ndarray
    lexicons: dict[bytes, list[int]]
    lexicon_weights: np.ndarray
    transitions: np.ndarray
    index: dict = field(default_factory=dict, repr=False)

    def lexicon_rows(self, words: list[bytes]) -> np.ndarray:
        out = np.zeros((len(words), len(self.langs)), np.float32)
        for i, w in enumerate(words):
            if w in self.lexicons:
                out[i, self.lexicons[w]] = 1
        return out

    def emissions(self, words: list[bytes]) -> np.ndarray:
        ids, owner = hashed(words)
        out = np.stack([np.bincount(owner, self.weights[ids, k], len(words)) for k in range(len(self.langs))], 1)
        return (out + self.lexicon_rows(words) @ self.lexicon_weights).astype(np.float32)


def forward_backward(emit: np.ndarray, transitions: np.ndarray, active: np.ndarray, expected: np.ndarray | None = None) -> np.ndarray:
    """Marginals of packed sequences: step t's rows are the first active[t] sequences, longest first, one after another.

    expected, if given, gets the expected numbers of transitions added.
    """
    psi = np.exp(emit - emit.max(1, keepdims=True))
    tie = np.exp(transitions - transitions.max()).astype(psi.dtype)
    at = np.append(0, np.cumsum(active))
    alpha = np.empty_like(psi)
    last = None
    for t, n in enumerate(active):
        now = psi[at[t] : at[t] + n]
        if last is not None:
            now = (last[:n] @ tie) * now
        last = alpha[at[t] : at[t] + n]
        np.divide(now, now.sum(1, keepdims=True), out=last)
    beta = np.ones((active[0], psi.shape[1]), psi.dtype)
    for t in range(len(active) - 2, -1, -1):
        n = active[t + 1]
        ahead = psi[at[t + 1] : at[t + 1] + n] * beta[:n]
        if expected is not None:
            joint = alpha[at[t] : at[t] + n, :, None] * tie * ahead[:, None, :]
            expected += (joint / joint.sum((1, 2), keepdims=True)).sum(0)
        some = ahead @ tie.T
        beta[:n] = some / some.sum(1, keepdims=True)
        alpha[at[t] : at[t] + active[t]] *= beta[: active[t]]
    return alpha / alpha.sum(1, keepdims=True)


def sequences(texts: list[tuple[bytes, str]], langs: list[str]) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """The sample's words, and sequences of word numbers and languages that switch now and then."""
    rng = np.random.default_rng(7)
    pieces: list[tuple[list[bytes], int]] = []
    for text, lang in texts:
        words = [w for w in map(normal, text.split()) if w]
        at = 0
        while at < len(words):
            n = int(rng.integers(4, 3 * SEQUENCE))
            pieces.append((words[at : at + n], langs.index(lang)))
            at += n
    order = rng.permutation(len(pieces))
    flat = [(w, k) for i in order for w in pieces[i][0] for k in (pieces[i][1],)]
    known = {w: i for i, w in enumerate(dict.fromkeys(w for w, _ in flat))}
    rows = len(flat) // SEQUENCE or 1
    flat = (flat * (SEQUENCE if len(flat) < SEQUENCE else 1))[: rows * SEQUENCE]
    numbers = np.array([known[w] for w, _ in flat]).reshape(rows, -1)
    return list(known), numbers, np.array([k for _, k in flat]).reshape(rows, -1)


def fit(texts: list[tuple[bytes, str]]) -> Field:
    """Maximises the likelihood of the sample's labels, by gradient steps with rates that adapt to each weight."""
    langs = sorted({lang for _, lang in texts})
    counts = {lang: Counter(w for t, x in texts if x == lang for w in map(normal, t.split()) if w) for lang in langs}
    lexicons: dict[bytes, list[int]] = {}
    for k, lang in enumerate(langs):
        for w, _ in sorted(counts[lang].items(), key=lambda x: (-x[1], x[0]))[:LEXICON]:
            lexicons.setdefault(w, []).append(k)
    size = len(langs)
    model = Field(langs, np.zeros((DIMS, size)), lexicons, np.zeros((size, size)), np.zeros((size, size)))
    if not any(counts.values()) or size < 2:
        return model
    words, numbers, labels = sequences(texts, langs)
    ids, owner = hashed(words)
    lexicon = model.lexicon_rows(words)
    rows, length = numbers.shape
    active = np.full(length, rows)
    order = numbers.T.ravel()
    gold = np.eye(size)[labels.T.ravel()]
    steps = gold.reshape(length, rows, size)
    pairs = np.einsum("tri,trj->ij", steps[:-1], steps[1:])
    parameters = [model.weights, model.lexicon_weights, model.transitions]
    squares = [np.full_like(p, 1e-3) for p in parameters]
    for _ in range(STEPS):
        emit = np.stack([np.bincount(owner, model.weights[ids, k], len(words)) for k in range(size)], 1) + lexicon @ model.lexicon_weights
        here = emit[order]
        expected = np.zeros((size, size))
        marginal = forward_backward(here, model.transitions, active, expected)
        wrong = gold - marginal
        each = np.stack([np.bincount(order, wrong[:, k], len(words)) for k in range(size)], 1)
        by_feature = np.stack([np.bincount(ids, each[owner, k], DIMS) for k in range(size)], 1)
        for p, s, g in zip(parameters, squares, (by_feature, lexicon.T @ each, pairs - expected)):
            g = g / rows - SHRINK * p
            s += g * g
            p += RATE * g / np.sqrt(s)
    model.weights = model.weights.astype(np.float32)
    return model


class Emissions(dict):
    """word as written -> its row in a table of emissions; row 0 is for words without letters."""

    def __init__(self, model: Field):
        super().__init__()
        self.model, self.table = model, np.zeros((1, len(model.langs)), np.float32)

    def learn(self, words: list[bytes]) -> None:
        if len(self) > CACHE_WORDS:
            self.clear()
            self.table = self.table[:1]
        by_normal: dict[bytes, list[bytes]] = {}
        for w in set(words).difference(self):
            if n := normal(w):
                by_normal.setdefault(n, []).append(w)
            else:
                self[w] = 0
        if by_normal:
            for row, same in enumerate(by_normal.values(), len(self.table)):
                for w in same:
                    self[w] = row
            self.table = np.concatenate([self.table, self.model.emissions(list(by_normal))])


def labelled(texts: list[list[bytes]], known: Emissions) -> tuple[np.ndarray, np.ndarray]:
    """For each text (its words, at least one): sum over words with letters of their marginals, and how many they are."""
    lengths = np.array([len(t) for t in texts])
    order = np.argsort(-lengths, kind="stable")
    active = np.searchsorted(-lengths[order], -np.arange(lengths.max()), "left")
    at = np.append(0, np.cumsum(active))
    rows = np.empty(at[-1], np.int64)
    for j, i in enumerate(order):
        rows[at[: lengths[i]] + j] = np.fromiter(map(known.__getitem__, texts[i]), np.int64, lengths[i])
    marginal = forward_backward(known.table[rows], known.model.transitions, active)
    who = np.arange(at[-1]) - np.repeat(at[:-1], active)
    counted = rows > 0
    total = np.stack([np.bincount(who, marginal[:, k] * counted, len(texts)) for k in range(marginal.shape[1])], 1)
    out, n = np.empty_like(total), np.empty(len(texts))
    out[order], n[order] = total, np.bincount(who, counted, len(texts))
    return out, n


def predicted(texts: list[bytes | None], known: Emissions | None) -> list[tuple[str, float]]:
    out: list[tuple[str, float]] = [(UNDETERMINED, 0.0)] * len(texts)
    if known is None:
        return out
    some, size = [], 0
    for i, t in [*enumerate(texts), (None, None)]:
        if i is None or size > CHUNK_BYTES:
            if some:
                words = [texts[j].split() for j in some]
                known.learn([w for x in words for w in x])
                total, n = labelled(words, known)
                best = total.argmax(1)
                for j, k, row, m in zip(some, best, total, n):
                    out[j] = (known.model.langs[k], float(min(1.0, row[k] / m)) if m else 0.0)
            some, size = [], 0
        if has_letter(t):
            some.append(i)
            size += len(t)
    return out


def sample(docs: DataFrame) -> list[tuple[bytes, str]]:
    """At most SAMPLE_DOCS rows of each language that may be learned from, chosen by hash of id and text, and of LANGUAGES languages.

    Rows alike in id, language and text count as one. A language all of whose texts are longer than SAMPLE_CHARS gives a
    span of that many characters of each chosen text. If there are more languages than LANGUAGES, those with the most rows count.
    """
    usable = docs.where(~held_out(F.col("doc_id")) & F.col("lang").isNotNull() & (F.char_length("text") > 0))
    chosen = usable.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(LANGUAGES).select("lang")
    # Texts stay where they are until rows are chosen: what is ranked are hashes.
    keyed = usable.join(F.broadcast(chosen), "lang", "left_semi")  # LANGUAGES rows at most
    ranked = keyed.select("lang", (F.char_length("text") > SAMPLE_CHARS).alias("_long"), F.xxhash64("doc_id", "text").alias("_h")).distinct()
    for ways in (WAYS, 1):  # a language with very many rows is ranked in parts first, and only their first rows meet
        by_hash = Window.partitionBy("lang", F.pmod("_h", F.lit(ways))).orderBy("_long", "_h")
        ranked = ranked.withColumn("_n", F.row_number().over(by_hash)).where(F.col("_n") <= SAMPLE_DOCS).drop("_n")
    wanted = ranked.select("lang", "_h")  # SAMPLE_DOCS * LANGUAGES rows at most
    found = keyed.select("lang", "doc_id", "text", F.xxhash64("doc_id", "text").alias("_h")).join(F.broadcast(wanted), ["lang", "_h"])
    found = found.select("lang", "doc_id", "_h", F.left("text", F.lit(SAMPLE_CHARS)).alias("text"))
    rows = found.groupBy("lang", "_h").agg(F.min(F.struct("doc_id", "text")).alias("r")).select("lang", "_h", "r.text").collect()
    return [(r["text"].encode(), r["lang"]) for r in sorted(rows, key=lambda r: (r["lang"], r["_h"]))]


def identified(docs: DataFrame, model: Field | None = None) -> DataFrame:
    """One row per document: doc_id, held_out, lang_pred, score (share of its words' probability that the language has).

    A text that is null or has no letter is `und` with score 0, as are all if nothing can be learned. Predictions read the
    text alone. A null doc_id counts as '' for held_out; repeated rows are predicted alike; an empty table gives no rows.
    """
    model = model or fit(sample(docs))
    model = model if model.langs else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Emissions(model) if model else None
        for whole in batches:
            for at in range(0, len(whole), 2000):  # predicted() works in steps of CHUNK_BYTES
                b = whole.slice(at, 2000)
                lang, score = zip(*predicted(text_bytes(b.column(2)), known))
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(lang, pa.string()), pa.array(score, pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])

    return arrow_map(docs.select(F.col("doc_id").cast("long"), held_out(F.col("doc_id")).alias("held_out"), "text"), run, "doc_id long, held_out boolean, lang_pred string, score double")
