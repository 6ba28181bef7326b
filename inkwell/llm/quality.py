"""Quality rules: a table of thresholds compiled into one projection, without user functions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from .common import NOT_WORD, packed, unpacked

# Frequent function words of English, German, French and Spanish.
STOP_WORDS = (
    "the of and to a in is that for it as was with be by on he this are or his from at which but have an had they you were their "
    "der die und den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach bei "
    "le la les de et un une du que est pour qui dans par plus pas au sur se ce il sont ne en ou avec "
    "el los las y del se por con una para su lo como más pero sus al no si"
).split()

SYMBOLS = "[#*$%&|<>]"
LINE_WITH_WORD = r"[^\x20\x09-\x0D]"


@dataclass(frozen=True)
class Rule:
    """A document passes if low <= measure <= high; None: no bound."""

    measure: str
    low: float | None = None
    high: float | None = None


#: Measures are ratios to the document's words or lines. Bounds are loose: they take out what is plainly not prose.
RULES = (
    Rule("mean_word_chars", 2.0, 12.0),
    Rule("symbols_per_word", None, 0.25),
    Rule("stop_word_ratio", 0.01, None),
    Rule("dup_line_ratio", None, 0.6),
)


#: Columns that base() and judged() add; columns of docs of the same name give way. accepted() adds none and keeps all.
MADE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_stop_words", "base_failed", "kept")


def _is_stop_word(word: Column) -> Column:
    return word.isin([x for w in sorted(set(STOP_WORDS)) for x in (w, w[0].upper() + w[1:], f"{w},", f"{w}.")])


def _counted(docs: DataFrame) -> DataFrame:
    """_doc, a struct of docs' columns, and the counts that rules are made of.

    Words that lie in a three-word window found twice or more in the text are counted by sorting windows' hashes with their
    places: equal ones are then neighbours, and a word counts when its nearest such window begins at most two words before.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(LINE_WITH_WORD))
    step = packed(docs, _text=text, _w=F.filter(F.split(text, NOT_WORD), lambda w: w != ""), _l=lines)
    n = F.size("_w")
    windows = F.when(
        n >= 3,
        F.sort_array(
            F.transform(
                F.sequence(F.lit(0), n - 3),
                lambda i: F.struct(F.xxhash64(F.get("_w", i), F.get("_w", i + 1), F.get("_w", i + 2)).alias("h"), i.alias("i")),
            )
        ),
    )
    step = step.select(
        "*",
        n.alias("_n"),
        F.length(F.array_join("_w", "")).alias("_chars"),
        F.regexp_count("_text", F.lit(SYMBOLS)).alias("_symbols"),
        F.size("_l").alias("_lines"),
        (F.size("_l") - F.size(F.array_distinct("_l"))).alias("_dup"),
        F.size(F.filter("_w", _is_stop_word)).alias("_stop"),
        windows.alias("_s"),
    )
    last = F.size("_s") - 1
    step = step.select("*", last.alias("_last"))
    same = lambda x, j: (j >= 0) & (j <= F.col("_last")) & (F.get(F.col("_s"), j)["h"] == x["h"])
    again = F.sort_array(F.transform(F.filter("_s", lambda x, j: F.coalesce(same(x, j - 1), F.lit(False)) | F.coalesce(same(x, j + 1), F.lit(False))), lambda x: x["i"]))
    step = step.select("*", again.alias("_again"))
    # In order of place, each window adds the words that the one before did not cover.
    added = F.transform("_again", lambda p, j: F.when(j == 0, F.lit(3)).otherwise(F.least(F.lit(3), p - F.get(F.col("_again"), j - 1))))
    covered = F.aggregate(added, F.lit(0), lambda a, x: a + x)
    counts = F.struct(
        F.col("_n").cast("long").alias("n_words"),
        F.col("_chars").cast("long").alias("word_chars"),
        F.col("_symbols").cast("long").alias("n_symbols"),
        F.col("_dup").cast("long").alias("n_dup_lines"),
        F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"),
        F.col("_lines").cast("long").alias("n_lines"),
        F.col("_stop").cast("long").alias("n_stop_words"),
    )
    # An array of one, exploded: a filter on the counts is then not pushed below them, where all would be worked out again.
    return step.select("_doc", F.explode(F.array(counts)).alias("_counts")).select("_doc", "_counts.*")


def base(docs: DataFrame) -> DataFrame:
    """docs and their counts: n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words, n_stop_words.

    A null or empty text has none of anything; repeated rows are counted each; an empty table gives no rows. A column of docs
    that has the name of one in MADE, in any case of letters, is left out.
    """
    own = [c for c in docs.columns if c.lower() not in MADE]
    counts = [c for c in MADE if c not in ("base_failed", "kept")]
    return _counted(docs).select(*[F.col("_doc").getField(c).alias(c) for c in own], *counts)


def measures() -> dict[str, Column]:
    words = F.greatest(F.col("n_words"), F.lit(1))
    return {
        "mean_word_chars": F.col("word_chars") / words,
        "symbols_per_word": F.col("n_symbols") / words,
        "stop_word_ratio": F.col("n_stop_words") / words,
        "dup_line_ratio": F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1)),
    }


def verdict(rules: tuple[Rule, ...] = RULES) -> Column:
    """The whole table as one boolean column over base()'s counts."""
    out = F.lit(True)
    for rule in rules:
        value = measures()[rule.measure]
        if rule.low is not None:
            out = out & (value >= rule.low)
        if rule.high is not None:
            out = out & (value <= rule.high)
    return out


BASE_FAILED = "n_words < 50 or 100 * n_repeat_words > 50 * n_words"


def judged(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """base() with base_failed and kept. A text without words fails; repeated rows are judged alike; an empty table gives no rows.

    Columns of docs named as one in MADE give way.
    """
    failed = F.expr(BASE_FAILED)
    return base(docs).withColumn("base_failed", failed).withColumn("kept", ~failed & verdict(rules))


def accepted(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The rows of docs that judged() keeps, with docs' columns and values, whatever their names."""
    return unpacked(_counted(docs).where(~F.expr(BASE_FAILED) & verdict(rules)), docs.columns)
