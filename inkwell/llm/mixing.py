"""Mixing sources to target weights along a time-varying curriculum.

Each source has a weight schedule over training time, linear from `first` to `last`. Its integral gives the source's
cumulative demand; a copy of a document that fills the source's words from a to b is trained on when demand reaches the middle
of that span, which is found by inverting the integral in closed form. Documents are then sorted by range of position.

Targets come from fixed weights: `budget` times all words is shared by weight, a source gets `most_epochs` times its own words at
most, and what is above goes to the others by weight until none is above.

Words before a document within its source are a prefix sum in order of a hash. It is taken in three steps, over blocks of
hash buckets, over the buckets of a block and within a bucket, so that a source of any size is dealt over many tasks. Rows
alike are one row with a count until their places are known. Sources are a table too, as there may be millions of them.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import NOT_WORD, alike, numbered, packed, prepare, spread, stash, unpacked

#: Rows that a hash bucket of a source has on average at most, and buckets of a block.
BUCKET_ROWS, BLOCK = 500, 1024


@dataclass(frozen=True)
class Curriculum:
    """weights: repeated over the sources in order of code point, null last; ramps: (first, last) of each schedule, likewise."""

    weights: tuple[float, ...] = (3, 1, 2)
    ramps: tuple[tuple[float, float], ...] = ((1.0, 1.0), (1.5, 0.5), (0.5, 1.5))
    budget: float = 1.5
    most_epochs: float = 2.0


def n_words(text: Column) -> Column:
    """Number of words; 0 for null. Counted from the gaps, without an array of words."""
    inner = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), NOT_WORD, " "))
    return F.when(inner == "", F.lit(0)).otherwise(F.length(inner) - F.length(F.replace(inner, F.lit(" "), F.lit(""))) + 1).cast("long")


def draw(doc_id: Column, text: Column) -> Column:
    """Where a document stands in its source: the first 60 bits of a hash of id and text."""
    whole = F.concat_ws("|", F.coalesce(F.concat(F.lit("="), doc_id.cast("string")), F.lit("-")), F.coalesce(text, F.lit("")))
    return F.conv(F.substring(F.md5(whole), 1, 15), 16, 10).cast("long")


def targets(sizes: DataFrame, plan: Curriculum) -> DataFrame:
    """sizes (source, words; a row per source) -> source, source_size, target, first, last.

    Water-filling: a source's target is its weight times a level, `most_epochs` times its words at most. The level rises until
    the targets are `budget` times all words; each step sums over all sources and adds those that the level has filled, so
    it takes as many steps as resharing until none is above.
    """
    ordered = stash(sizes.orderBy(F.asc_nulls_last("source")).withColumn("_at", F.monotonically_increasing_id()), "sources")
    parts = ordered.groupBy(F.shiftright("_at", 33).alias("_task")).agg(F.count("*").alias("n"))
    before = Window.orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)  # a row per task that has sources
    firsts = parts.select("_task", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_before"))
    ranked = ordered.withColumn("_task", F.shiftright("_at", 33)).join(firsts, "_task")
    rank = F.col("_before") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))

    def repeated(values: list[float]) -> Column:
        return F.element_at(F.array(*[F.lit(float(v)) for v in values]), (F.pmod(rank, F.lit(len(values))) + 1).cast("int"))

    dim = ranked.select(
        "source",
        F.col("words").alias("source_size"),
        repeated(list(plan.weights)).alias("weight"),
        repeated([r[0] for r in plan.ramps]).alias("first"),
        repeated([r[1] for r in plan.ramps]).alias("last"),
        (F.col("words") * F.lit(float(plan.most_epochs))).alias("most"),
    )
    dim = stash(dim, "weights")
    total = dim.agg(F.sum("source_size")).first()[0] or 0
    level, full = -1.0, None
    while full is None or level > full:
        full = level
        above = F.col("weight") * F.lit(full) > F.col("most")
        row = dim.agg(F.sum(F.when(above, F.col("most"))).alias("filled"), F.sum(F.when(~above, F.col("weight"))).alias("open")).first()
        if not row["open"]:
            break
        level = (plan.budget * total - (row["filled"] or 0.0)) / row["open"]
    return dim.select("source", "source_size", F.when(above, F.col("most")).otherwise(F.col("weight") * F.lit(level)).alias("target"), "first", "last")


def position(done: Column, first: Column, last: Column) -> Column:
    """Inverts demand: the time t in 0..1 at which the share `done` of a schedule linear from first to last is reached."""
    slope = last - first
    total = (first + last) / 2
    root = (-first + F.sqrt(first * first + 2 * slope * total * done)) / F.when(slope == 0, F.lit(1.0)).otherwise(slope)
    return F.when(F.abs(slope) < 1e-9, done).otherwise(root)


def mix(docs: DataFrame, plan: Curriculum = Curriculum()) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, taken, copies, position, positions.

    A source's documents are laid in a row, in order of a hash of doc_id and text, as often as its target needs; `copies` is how often
    all of a document is taken and `taken` that many times its size. The last pass over a source ends with the document in which the
    target lies, taken if more than half of it is needed, so taken words differ from the target by half a document at most.
    positions (0..1) has one for each copy, later passes over the source after earlier ones, and position is the first; both are
    null when nothing is taken. A null text has size 0, a null source is a
    source of its own, sorted last; repeated rows are documents of their own; an empty table gives no rows. Documents
    without words take nothing and have as many copies as the whole passes over their source.
    """
    laid = _laid(docs, plan)
    a = F.col("base") + F.col("ahead") + F.col("nth") * F.col("size")
    passes = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    rest = F.col("target") - passes * F.col("source_size")
    copies = passes + F.when(a + F.col("size") / 2 < rest, 1).otherwise(0)

    def place(k: Column) -> Column:
        done = F.least((a + k * F.col("source_size") + F.col("size") / 2) / F.col("target"), F.lit(1.0))
        return position(F.when(F.col("target") > 0, done).otherwise(F.lit(0.0)), F.col("first"), F.col("last"))

    return laid.select(
        "doc_id",
        "source",
        "size",
        "source_size",
        "target",
        (copies * F.col("size")).alias("taken"),
        copies.cast("int").alias("copies"),
        F.when(copies > 0, place(F.lit(0))).alias("position"),
        F.when(copies > 0, F.transform(F.sequence(F.lit(0).cast("long"), copies - 1), place)).alias("positions"),
        "draw",
        "nth",
    )


def _laid(docs: DataFrame, plan: Curriculum) -> DataFrame:
    """doc_id, source, size, draw, nth (number among rows alike in all of these), base + ahead (words before the first of those), and the source's row."""
    prepare(docs.sparkSession)
    rows = docs.select("doc_id", "source", n_words(F.col("text")).alias("size"), draw(F.col("doc_id"), F.col("text")).alias("draw"))
    rows = stash(rows.groupBy("doc_id", "source", "size", "draw").agg(F.count("*").alias("n")), "sizes")
    words = F.col("size") * F.col("n")
    sources = stash(rows.groupBy("source").agg(F.sum(words).alias("words"), F.count("*").alias("rows")), "sums")
    buckets = max(1, -(-(sources.agg(F.max("rows")).first()[0] or 1) // BUCKET_ROWS))
    # Bucket = place of the hash among equal ranges, so buckets in order hold hashes in order.
    bucket = F.floor(F.col("draw") / F.lit(2.0**60) * buckets).cast("long")
    rows = rows.withColumn("bucket", F.least(bucket, F.lit(buckets - 1)))
    sums = rows.groupBy("source", "bucket").agg(F.sum(words).alias("words")).withColumn("block", F.floor(F.col("bucket") / BLOCK).cast("long"))
    sums = stash(sums, "buckets")

    def ahead(value: str, by: list[str], *order: str) -> Column:
        return F.coalesce(F.sum(value).over(Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))

    blocks = sums.groupBy("source", "block").agg(F.sum("words").alias("words"))
    blocks = blocks.select("source", "block", ahead("words", ["source"], "block").alias("_before"))
    inner = sums.select("source", "block", "bucket", ahead("words", ["source", "block"], "bucket").alias("_inner"))
    starts = inner.join(blocks, alike(inner, blocks, ["source", "block"])).select(inner["source"], "bucket", (F.col("_before") + F.col("_inner")).alias("base"))
    dim = stash(targets(sources.select("source", "words"), plan), "targets")
    starts = starts.join(dim, starts["source"].eqNullSafe(dim["source"])).drop(dim["source"])
    placed = rows.withColumn("_words", words).withColumn("ahead", ahead("_words", ["source", "bucket"], "draw", "doc_id", "size"))
    laid = placed.join(starts, alike(placed, starts, ["source", "bucket"])).drop(starts["source"], starts["bucket"])
    return spread(laid, "n", "nth")


def by_position(df: DataFrame, position: str = "position", draw: str = "draw") -> DataFrame:
    """Sorted by range of position. The hash parts equal positions, and the many nulls of what is not taken."""
    return df.repartitionByRange(position, draw).sortWithinPartitions(position, draw)


def mixed(docs: DataFrame, plan: Curriculum = Curriculum()) -> DataFrame:
    """The documents as the mix trains on them: a row per copy at its own position, with docs' columns, sorted by range of position.

    Rows alike in doc_id, text and source share out the places that mix() gave them. Columns besides are passed on.
    """
    by = ["_id", "_draw", "_source", "_nth"]
    decided = mix(docs, plan).select(F.col("doc_id").alias("_id"), F.col("draw").alias("_draw"), F.col("source").alias("_source"), F.col("nth").alias("_nth"), "copies", "positions")
    decided = stash(decided, "decided")
    keyed = packed(docs, _id=F.col("doc_id"), _draw=draw(F.col("doc_id"), F.col("text")), _source=F.col("source"))
    if decided.where("_nth > 0").isEmpty():
        keyed = keyed.withColumn("_nth", F.lit(0).cast("long"))
    else:
        keyed = numbered(keyed, by[:-1], "_nth")
    decided = decided.where("copies > 0")
    out = keyed.join(decided, alike(keyed, decided, by)).select("_doc", keyed["_draw"], F.explode("positions").alias("_position"))
    return unpacked(by_position(out, "_position", "_draw"), docs.columns)
