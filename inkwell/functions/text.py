"""Scalar functions of the workspace, as Column expressions.

Missing means null or empty throughout, as where these rules come from. Lengths are in code points.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

KIB, MIB = 1024, 1024 * 1024
MOST_FILE_BYTES = 20 * MIB
MOST_AI_CHARS = 12_000
MOST_CONTEXT_CHARS = 3_000
MOST_ANSWER_CHARS = 600

#: White space of the web's strings: Unicode's, the no-break and the byte-order mark among it, but not U+0085.
SPACE = r"[\t-\r\u0020\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff]"


def present(x: Column) -> Column:
    """Neither null nor empty."""
    return x.isNotNull() & (x != "")


def or_else(*xs: Column | str) -> Column:
    """The first that is present; a string is a literal, and the last is taken as it is."""
    cols = [F.lit(x) if isinstance(x, str) else x for x in xs]
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in cols[:-1]], cols[-1])


def trimmed(x: Column) -> Column:
    return F.regexp_replace(x, rf"\A{SPACE}+|{SPACE}+\z", "")


def not_blank(x: Column) -> Column:
    return F.coalesce(F.length(trimmed(x)) > 0, F.lit(False))


def extension(name: Column) -> Column:
    """After the last dot, lower case; all of a name without a dot; '' for null."""
    return F.coalesce(F.lower(F.element_at(F.split(name, r"\."), -1)), F.lit(""))


def one_decimal(x: Column) -> Column:
    return F.format_string("%.1f", x)


def file_size(n: Column) -> Column:
    """B below 1024, KB below 1024 squared, else MB."""
    return (
        F.when(n < KIB, F.concat(n.cast("string"), F.lit(" B")))
        .when(n < MIB, F.concat(one_decimal(n / F.lit(float(KIB))), F.lit(" KB")))
        .otherwise(F.concat(one_decimal(n / F.lit(float(MIB))), F.lit(" MB")))
    )


def truncated(x: Column, most: int = MOST_AI_CHARS) -> Column:
    """Longer texts become their prefix and a note, which makes them longer than `most`."""
    # Fixed value: the note.
    note = f"\n\n…[Content truncated at {most:,} characters. The full text is stored but only this portion was sent to the AI.]"
    return F.when(F.length(x) <= most, x).otherwise(F.concat(F.left(x, F.lit(most)), F.lit(note)))


def prefix(x: Column, most: int) -> Column:
    return F.left(x, F.lit(most))


def short_label(name: Column) -> Column:
    """More than 18 characters: the first 16 and an ellipsis."""
    return F.when(F.length(name) > 18, F.concat(F.left(name, F.lit(16)), F.lit("…"))).otherwise(name)


def first_token(x: Column) -> Column:
    return F.split(x, " ")[0]


def initial(x: Column) -> Column:
    return F.upper(F.left(x, F.lit(1)))


def plural(n: Column) -> Column:
    return F.when(n != 1, "s").otherwise("")


def counted(n: Column, noun: str) -> Column:
    return F.concat(n.cast("string"), F.lit(f" {noun}"), plural(n))


def greeting(ts: Column) -> Column:
    return F.when(F.hour(ts) < 12, "morning").when(F.hour(ts) < 18, "afternoon").otherwise("evening")


def date_text(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd")


def datetime_text(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd HH:mm:ss")


def percent(n: Column) -> Column:
    return F.concat(n.cast("string"), F.lit("%"))


def digits_or_zero(x: Column) -> Column:
    """The first run of digits as a number, 0 without one."""
    digits = F.nullif(F.regexp_extract(x, "[0-9]+", 0), F.lit(""))
    return F.coalesce(digits.try_cast("bigint"), F.lit(0).cast("bigint"))


def storage_key(user: Column, project: Column, millis: Column, name: Column) -> Column:
    return F.concat(user, F.lit("/"), project, F.lit("/"), millis.cast("string"), F.lit("_"), name)


# What of a slide's XML is replaced by what, in this order; the ampersand comes before what it may begin.
SLIDE_TEXT = (("<a:t>", " "), ("</a:t>", " "), ("<a:br/>", "\n"))
SLIDE_ENTITIES = (("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&apos;", "'"), ("&quot;", '"'), ("&#xD;", "\n"))


def slide_text(xml: Column) -> Column:
    """The text of a slide's XML."""
    out = xml
    for a, b in SLIDE_TEXT:
        out = F.replace(out, F.lit(a), F.lit(b))
    out = F.regexp_replace(out, "<[^>]+>", "")
    for a, b in SLIDE_ENTITIES:
        out = F.replace(out, F.lit(a), F.lit(b))
    return trimmed(F.regexp_replace(out, SPACE + "{2,}", " "))


def unfenced(reply: Column) -> Column:
    """A reply without the marks of a fenced block."""
    return trimmed(F.regexp_replace(reply, "```json|```", ""))


# The first part that a message has decides its text.
FRIENDLY_ERRORS = (
    (("Invalid login credentials",), "Wrong email or password. Double-check and try again."),
    (("Email not confirmed", "email_not_confirmed"), "Please confirm your email first — check your inbox (and spam)."),
    (("User already registered",), "An account with this email already exists. Try signing in instead."),
    (("Password should be",), "Password must be at least 6 characters."),
    (("Unable to validate", "provider"), "Google sign-in failed. Make sure pop-ups are not blocked and try again."),
)
FRIENDLY_DEFAULT = "Something went wrong. Please try again."


def friendly_error(message: Column) -> Column:
    out = or_else(message, FRIENDLY_DEFAULT)
    for parts, text in reversed(FRIENDLY_ERRORS):
        hit = F.lit(False)
        for p in parts:
            hit = hit | F.contains(message, F.lit(p))
        out = F.when(hit, F.lit(text)).otherwise(out)
    return out
