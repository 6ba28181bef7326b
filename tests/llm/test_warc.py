import base64
import gzip
import hashlib

import pytest
from hypothesis import given, strategies as st

from inkwell.llm import registry, warc


def test_sql(spark, sf_dir, duck, same_rows):
    same_rows(registry.op9_warc_converter(spark, sf_dir), duck.sql(registry.oracle_sql()["op9_warc_converter"]))


def test_odd_pages(spark):
    rows = [(1, "http://a/x y", "same"), (2, None, "same"), (3, "http://b", None), (4, "http://c", ""), (5, "http://d\nq", "WARC/1.1\r\n\r\nx\n\r\n\r\n"), (6, "u", "a\n" * 50_000), (7, "é", "ü\x00"), (7, "é", "ü\x00"), (None, "n", "same"), (8, "", "http://x 0.0.0.0 20240101000000 text/html 3\nabc")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'own' as digest", "1 as length", "'x' as record_id").repartition(3)
    got = {}
    for r in warc.archived(df).collect():
        got.setdefault(r.page_id, []).append(r)
    for page_id, _, html in rows:
        data = (html or "").encode()
        for r in got[page_id]:
            assert (r.payload_bytes, r.payload_digest) == (len(data), base64.b32encode(hashlib.sha1(data).digest()).decode())
    kinds = {k: sorted((r.record_type, r.refers_to) for r in v) for k, v in got.items()}
    assert kinds[1] == kinds[3] == kinds[5] == kinds[6] == kinds[8] == [("response", None)]
    assert kinds[2] == kinds[None] == [("revisit", 1)] and kinds[4] == [("revisit", 3)]
    assert kinds[7] == [("response", None), ("revisit", 7)]


def test_least_size_of_a_revisit(spark):
    df = spark.createDataFrame([(1, "a", "xx"), (2, "b", "xx"), (3, "c", "long text"), (4, "d", "long text")], "page_id long, url string, html string")
    assert {r.page_id: r.refers_to for r in warc.archived(df, 3).collect()} == {1: None, 2: None, 3: None, 4: 3}


def test_no_pages(spark):
    assert warc.archived(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def arc(version, records):
    block = f"{version} 0 maker\n{warc.ARC_FIELDS[version]}\n"
    extra = "200 - - 0 f.arc " if version == 2 else ""
    out = f"filedesc://f.arc 0.0.0.0 20000101 text/plain {extra}{len(block)}\n{block}\n".encode()
    for url, payload in records:
        out += f"{url} 1.2.3.4 19991231235959 text/html {extra}{len(payload)}\n".encode() + payload + b"\n"
    return out


@given(st.integers(1, 2), st.lists(st.tuples(st.sampled_from(["http://a/", "http://a b/c", "x"]), st.binary(max_size=60)), max_size=5), st.booleans())
def test_both_versions_plain_and_gzipped(version, records, zipped):
    data = arc(version, records)
    if zipped:  # a member for each half, as archives have for each record
        data = gzip.compress(data[: len(data) // 2]) + gzip.compress(data[len(data) // 2 :])
    found = list(warc.read_arc(data))
    assert [(r["url"], r["payload"]) for r in found] == records
    assert all(r["archive-date"] == "19991231235959" and r["ip-address"] == "1.2.3.4" for r in found)


def test_broken_archives():
    for data, said in ((b"http://a 0 0 t 3\nabc\n", "version block"), (arc(1, [("u", b"abc")])[:-3], "declared"), (arc(1, []).replace(b"1 0 maker", b"9 0 maker"), "version 9"), (arc(1, []) + b"short line\n", "fields")):
        with pytest.raises(warc.ArchiveError, match=said):
            list(warc.read_arc(data))
    with pytest.raises(warc.ArchiveError):
        list(warc.read_warc(b"HTTP/1.1 200\r\n\r\n"))


def test_fields_are_synthesised():
    assert warc.iso_date("19991231235959") == "1999-12-31T23:59:59Z" and warc.iso_date("1999") == "1999-01-01T00:00:00Z"
    assert warc.record_id("u", "d", "x", "p") == warc.record_id("u", "d", "x", "p") != warc.record_id("u", "d", "x", "q")


def test_archives_are_warc(spark, tmp_path):
    """The files themselves, read with plain tools."""
    arcs, out = str(tmp_path / "arc"), str(tmp_path / "warc")
    warc.write_arc(spark.createDataFrame([(1, "http://a", "x"), (2, "http://b", "x")], "page_id long, url string, html string").coalesce(1), arcs)
    warc.convert(spark, arcs, out)
    data = b"".join(gzip.decompress(p.read_bytes()) for p in (tmp_path / "warc").glob("part-*"))
    assert data.count(b"WARC/1.1\r\n") == 2 and data.endswith(b"\r\n\r\n")
    assert data.count(b"WARC-Type: response\r\n") == data.count(b"WARC-Type: revisit\r\n") == 1
    assert b"WARC-Refers-To: <urn:uuid:" in data and b"WARC-Date: 2024-01-01T00:00:00Z\r\n" in data
