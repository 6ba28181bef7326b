from hypothesis import given, strategies as st

from inkwell.operators import markdown as md


def kinds(text, mode="compat"):
    return [(b.kind, b.level, b.items) for b in md.blocks(text, mode)]


def test_each_rule():
    text = "# a\n## b\n### c\n---\n * * *\n- x\n+ y\n1. p\n23. q\n> u\n> v\n```py\ncode\n\nmore\n```\none\ntwo\n\nthree"
    assert kinds(text) == [
        ("heading", 1, ["a"]),
        ("heading", 2, ["b"]),
        ("heading", 3, ["c"]),
        ("rule", 0, []),
        ("paragraph", 0, [" * * *"]),
        ("bullets", 0, ["x", "y"]),
        ("numbers", 0, ["p", "q"]),
        ("quote", 0, ["u"]),
        ("quote", 0, ["v"]),
        ("code", 0, ["code\n\nmore"]),
        ("paragraph", 0, ["one two"]),
        ("spacer", 0, []),
        ("paragraph", 0, ["three"]),
    ]


def test_lines_that_look_like_markers():
    for line in ("#### x", "**bold** line", "-x", ">x", "#x", "2.5 million"):
        assert kinds(line) == []
        assert kinds(line, "lenient") == [("paragraph", 0, [line])]


def test_edges():
    assert kinds("") == [] and md.blocks(None) == []
    assert kinds("\n\nx") == [("paragraph", 0, ["x"])]
    assert kinds("x\n\n\n") == [("paragraph", 0, ["x"]), ("spacer", 0, []), ("spacer", 0, []), ("spacer", 0, [])]
    assert kinds("```\nopen") == [("code", 0, ["open"])]


def test_spans():
    assert md.spans("a **b** *c* `d` ~~e~~ f") == [("text", "a "), ("bold", "b"), ("text", " "), ("italic", "c"), ("text", " "), ("code", "d"), ("text", " "), ("strike", "e"), ("text", " f")]
    assert md.spans("") == [("text", "")]
    assert md.spans("**a") == [("text", "**a")]


@given(st.text(alphabet="#*-+>`_~1. \nab", max_size=80))
def test_any_text_ends_and_lenient_loses_no_line(text):
    assert all(b.kind for b in md.blocks(text))
    shown = "".join("".join(b.items) for b in md.blocks(text, "lenient"))
    assert shown.count("a") + shown.count("b") >= sum(text.count(c) for c in "ab") - sum(line.count("a") + line.count("b") for line in text.split("\n") if line.startswith("```"))


def test_table_function(spark):
    df = spark.createDataFrame([(1, "# a\nb"), (2, None)], "id int, text string")
    assert [tuple(r) for r in md.with_blocks(df, "text").select("id", "pos", "kind", "level", "items").collect()] == [(1, 0, "heading", 1, ["a"]), (1, 1, "paragraph", 0, ["b"])]


def test_marked_spans_as_expressions(spark):
    from pyspark.sql import functions as F

    row = spark.createDataFrame([("a **b** *c* `d` ~~e~~",)], "x string").select(F.transform(md.marked(F.col("x")), lambda s: F.concat(md.marked_kind(s), F.lit("="), s))).first()[0]
    assert row == ["bold=**b**", "italic=*c*", "code=`d`", "strike=~~e~~"]
