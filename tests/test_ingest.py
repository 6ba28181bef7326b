import io
import json
import zipfile
import zlib

import pytest
from pyspark.sql import functions as F

from inkwell import sinks
from inkwell.operators import ingest, prompts
from inkwell.providers import OfflineStub, ProviderError, called, reply_text
from inkwell.sources import files
from inkwell.streaming import uploads


def zipped(**entries):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, data in entries.items():
            z.writestr(name, data)
    return out.getvalue()


def pptx(**slides):
    return zipped(**{f"ppt/slides/{k}.xml": v for k, v in slides.items()}, **{"docProps/app.xml": "<x/>"})


def docx(*paragraphs):
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    body = "".join(f"<w:p><w:r><w:t>{p}</w:t></w:r></w:p>" for p in paragraphs)
    return zipped(**{"word/document.xml": f"<w:document {w}><w:body>{body}</w:body></w:document>"})


def pdf(*pages, flate=False):
    parts, kids = [], []
    for i, content in enumerate(pages):
        data = zlib.compress(content) if flate else content
        extra = b"/Filter /FlateDecode " if flate else b""
        kids.append(b"%d 0 R" % (10 + 2 * i))
        parts.append(b"%d 0 obj\n<< /Type /Page /Parent 2 0 R /Contents %d 0 R >>\nendobj\n" % (10 + 2 * i, 11 + 2 * i))
        parts.append(b"%d 0 obj\n<< %s/Length %d >>\nstream\n%s\nendstream\nendobj\n" % (11 + 2 * i, extra, len(data), data))
    head = b"%PDF-1.4\n1 0 obj\n<< /Type /Catalog /Pages 2 0 R >>\nendobj\n2 0 obj\n<< /Type /Pages /Kids [" + b" ".join(kids) + b"] /Count %d >>\nendobj\n" % len(pages)
    return head + b"".join(parts) + b"trailer\n<< /Root 1 0 R >>\n%%EOF"


def test_pptx_numbers_and_skips():
    data = pptx(slide10="<a:t>ten</a:t>", slide2="<a:t>two &amp;lt;</a:t>", Slide1="<a:t>one</a:t>", slide3="<p/>")
    assert files.pptx_text(data) == "[Slide 1]\none\n\n[Slide 2]\ntwo <\n\n[Slide 4]\nten"


def test_pptx_errors():
    assert files.extract("pptx", b"no zip") == (None, files.ERRORS["pptx unreadable"])
    assert files.extract("pptx", zipped(a="b")) == (None, files.ERRORS["pptx no slides"])
    assert files.extract("pptx", pptx(slide1="<p/>")) == (None, files.ERRORS["pptx no text"])
    assert files.extract("ppt", b"no zip") == (None, files.ERRORS["ppt"])
    assert files.extract("ppt", pptx(slide1="<a:t>x</a:t>")) == ("[Slide 1]\nx", None)


def test_docx():
    assert files.docx_text(docx("one", "two &amp; three")) == "one\n\ntwo & three"
    assert files.extract("docx", docx()) == (None, files.ERRORS["docx"])
    assert files.extract("doc", b"\xd0\xcf") == (None, files.ERRORS["doc"])


@pytest.mark.parametrize("flate", [False, True])
def test_pdf(flate):
    data = pdf(b"BT (Hello \\(a\\)) Tj [(wor) -20 (ld)] TJ ET", b"", b"BT <48 69> Tj ET", flate=flate)
    assert files.pdf_text(data) == "[Page 1]\nHello (a) world\n\n[Page 2]\n\n\n[Page 3]\nHi"


def test_pdf_of_today():
    """Objects in an object stream, inherited resources, a composite font with a map to Unicode, a simple one without."""
    cmap = b"begincodespacerange <0000> <FFFF> endcodespacerange 2 beginbfchar <0001> <0048> <0002> <00660069> endbfchar 1 beginbfrange <0010> <0012> <0061> <0020> <0021> [<00E9> <D83DDE00>] endbfrange"
    content = b"q BT /F1 12 Tf <00010002> Tj [<0010> -20 <00110012>] TJ /F2 9 Tf (caf\\351 \\(x) Tj /F1 1 Tf <00200021> ' BI /W 1 ID (junk) Tj EI ET"
    inner = {2: b"<< /Type /Pages /Kids [3 0 R] /Count 1 /Resources << /Font 6 0 R >> >>", 3: b"<< /Type /Page /Parent 2 0 R /Contents [5 0 R] >>", 6: b"<< /F1 7 0 R /F2 << /Subtype /Type1 >> >>", 7: b"<< /Type /Font /Subtype /Type0 /Encoding /Identity-H /ToUnicode 8 0 R >>"}
    table, body = b"", b""
    for number, value in inner.items():
        table += b"%d %d " % (number, len(body))
        body += value + b" "
    packed = zlib.compress(table + body)
    streams = {4: (b"/Type /ObjStm /N 4 /First %d" % len(table), packed), 5: (b"", zlib.compress(content)), 8: (b"", zlib.compress(cmap))}
    data = b"%PDF-1.5\n1 0 obj << /Type /Catalog /Pages 2 0 R >> endobj\n"
    for number, (head, stream) in streams.items():
        data += b"%d 0 obj << %s /Filter /FlateDecode /Length %d >> stream\n%s\nendstream endobj\n" % (number, head, len(stream), stream)
    data += b"9 0 obj << /Type /XRef /Root 1 0 R /Length 0 >> stream\n\nendstream endobj\n"
    assert files.pdf_text(data) == "[Page 1]\nHfi abc café (x é\U0001f600"
    without = data.replace(b"/Filter /FlateDecode /Length %d >> stream\n%s" % (len(packed), packed), b"/Length %d >> stream\n%s" % (len(table + body), table + body.replace(b"/ToUnicode", b"/ToNothing")))
    assert files.extract("pdf", without) == (None, files.ERRORS["pdf unreadable"])


def test_docx_text_boxes_once():
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main" xmlns:mc="http://schemas.openxmlformats.org/markup-compatibility/2006"'
    box = "<w:txbxContent><w:p><w:r><w:t>boxed</w:t></w:r></w:p></w:txbxContent>"
    body = f"<w:p><w:r><w:t>out</w:t></w:r><w:r><mc:AlternateContent><mc:Choice>{box}</mc:Choice><mc:Fallback>{box}</mc:Fallback></mc:AlternateContent></w:r><w:r><w:t>er</w:t></w:r></w:p><w:p><w:r><w:t>next</w:t></w:r></w:p>"
    assert files.docx_text(zipped(**{"word/document.xml": f"<w:document {w}><w:body>{body}</w:body></w:document>"})) == "outer\n\nboxed\n\nnext"


def test_what_is_inserted_is_returned(spark, tmp_path):
    """Ids, times and texts that are made on the way are those of the table; nothing is worked out again."""
    made = F.concat(F.lit("s"), F.rand().cast("string"))
    rows = spark.range(20).select(F.concat(F.lit("p"), F.col("id") % 2).alias("project_id"), F.col("id").cast("string").alias("name"), made.alias("summary"))
    out = sinks.append_documents(rows, str(tmp_path / "t"))
    key = lambda r: (r.id, r.project_id, r.name, r.summary, r.created_at)
    table = spark.read.parquet(str(tmp_path / "t")).collect()
    assert sorted(map(key, out.collect())) == sorted(map(key, out.collect())) == sorted(map(key, table)) and len(table) == 20


def test_pdf_says_what_it_cannot_read():
    assert files.extract("pdf", b"%PDF-1.5 /ObjStm")[1] == files.ERRORS["pdf unreadable"]
    assert files.extract("pdf", b"text")[1] == files.ERRORS["pdf unreadable"]


@pytest.fixture
def folder(tmp_path):
    samples = {"a.txt": b"\xef\xbb\xbf text \xff", "empty.txt": b"", "b.pptx": pptx(slide1="<a:t>x</a:t>"), "c.docx": docx("doc"), "d.ppt": b"no", "e.xyz": b"?", "README": b"r", "f.pdf": pdf(b"(p) Tj")}
    for name, data in samples.items():
        (tmp_path / name).write_bytes(data)
    return tmp_path


def test_every_file_has_text_or_error(spark, folder):
    rows = {r.name: r for r in files.extracted(files.files(spark, str(folder))).collect()}
    assert rows["a.txt"].text == " text �" and rows["empty.txt"].text == "" and rows["empty.txt"].error is None
    assert rows["b.pptx"].text == "[Slide 1]\nx" and rows["c.docx"].text == "doc" and rows["f.pdf"].text == "[Page 1]\np"
    assert rows["d.ppt"].error == files.ERRORS["ppt"] and 'type ".xyz"' in rows["e.xyz"].error and 'type ".readme"' in rows["README"].error
    assert all((r.text is None) != (r.error is None) for r in rows.values())


def test_size_comes_first(spark):
    df = spark.createDataFrame([("pdf", 20 * 2**20), ("xyz", 20 * 2**20 + 1)], "ext string, size long")
    assert [r[0] for r in df.select(files.route(F.col("ext"), F.col("size"))).collect()] == ["pdf", "too_large"]


def test_one_bad_file_stops_no_other(spark, folder, tmp_path):
    def failing(body):
        if "---\ndoc\n---" in json.loads(body)["messages"][-1]["content"]:
            raise RuntimeError("no")
        return "fine"

    entries = files.files(spark, str(folder))
    done = ingest.processed(entries, failing, "u", "p")
    rows = {r.name: r for r in done.collect()}
    assert rows["c.docx"].status == "error" and rows["c.docx"].error_msg == "no" and rows["a.txt"].status == "done"
    ok = ingest.processed(entries, OfflineStub(), "u", "p")
    assert {r.name for r in ingest.to_documents(ok).collect()} == {"a.txt", "empty.txt", "b.pptx", "c.docx", "f.pdf"}
    assert ingest.to_retry(entries, ok).count() == 3
    assert {r.error_msg for r in ingest.processed(entries, OfflineStub(), None, "p").collect()} == {ingest.SIGNED_OUT}
    out = f"{folder}_docs"
    sinks.append_documents(ingest.to_documents(ok), out)
    assert spark.read.parquet(out).where("project_id = 'p' and summary like '[offline stub]%'").count() == 5


def test_files_are_stored(spark, folder):
    kept = sinks.store_files(files.files(spark, str(folder)), f"file://{folder}_store", "u", "p").collect()
    assert all(r.warning is None and r.key.startswith("u/p/") for r in kept)
    from pathlib import Path

    assert len(list(Path(f"{folder}_store/u/p").iterdir())) == 8
    assert all(r.warning for r in sinks.store_files(files.files(spark, str(folder)), "nosuch://x", "u", "p").collect())


def test_turns_are_stored_when_they_succeed(spark, tmp_path):
    answered = spark.createDataFrame([("p", "q", "a", None), ("p", "bad", None, "error")], "project_id string, question string, reply string, model_error string")
    sinks.append_turns(answered, str(tmp_path / "chat"))
    rows = spark.read.parquet(str(tmp_path / "chat")).orderBy("created_at").collect()
    assert [(r.role, r.text) for r in rows] == [("user", "q"), ("model", "a")]


def test_projects_need_names(spark, tmp_path):
    sinks.append_projects(spark.createDataFrame([(" a ",), ("  ",)], "name string"), str(tmp_path / "p"))
    assert [r.name for r in spark.read.parquet(str(tmp_path / "p")).collect()] == ["a"]


def test_merge_keeps_the_last(spark, tmp_path):
    spark.createDataFrame([(1, 1, "a"), (2, 1, "b")], "id int, seq int, x string").write.parquet(str(tmp_path / "t"))
    more = spark.createDataFrame([(2, 2, "c"), (3, 1, "d")], "id int, seq int, x string")
    out = sinks.merged(spark, str(tmp_path / "t"), more, str(tmp_path / "u"), order="seq")
    assert sorted((r.id, r.x) for r in out.collect()) == [(1, "a"), (2, "c"), (3, "d")]


def test_replies():
    assert reply_text(200, "OK", '{"choices":[{"message":{"content":"x"}}]}') == "x"
    for status, body, said in ((200, "{}", "Empty response"), (500, "?", "error 500: Bad"), (400, '{"error":{"message":"m"}}', "m"), (200, '{"choices":[]}', "Empty")):
        with pytest.raises(ProviderError, match=said):
            reply_text(status, "Bad", body)


@pytest.mark.parametrize(
    ("reply", "found"),
    [('```json\n["a","b","c","d","e"]\n```', ["a", "b", "c"]), ('{"a":1}', []), ('["a"] trailing', []), ("['a']", []), ("", []), (None, []), ('["a", 1, null]', ["a", "1", "null"]), ("[NaN]", []), (" []﻿", [])],
)
def test_follow_ups(reply, found):
    assert prompts.parsed_follow_ups(reply) == found


def test_chat_round(spark):
    docs = spark.createDataFrame([("1", "p", "n", "text"), ("2", "p", "m", "")], "id string, project_id string, name string, content string")
    chat = spark.createDataFrame([("p", 1, "user", "before"), ("p", 2, "model", "answer")], "project_id string, seq int, role string, text string")
    asked = spark.createDataFrame([("p", " why? ", None), ("p", "  ", None), ("q", "x", None)], "project_id string, question string, model string")
    rows = {r.project_id: r for r in called(prompts.chat_requests(asked, chat, docs, "id"), OfflineStub()).collect()}
    assert len(rows) == 2 and rows["q"].error == prompts.NO_DOCUMENTS and rows["q"].reply is None
    assert [(m.role, m.content) for m in rows["p"].messages] == [("user", "before"), ("assistant", "answer"), ("user", "why?")]
    assert rows["p"].system.endswith("Documents:\n--- n ---\ntext") and rows["p"].reply.startswith("[offline stub]")


def test_stream(spark, folder, tmp_path):
    q = uploads.ingest(spark, str(folder), f"{folder}_out", f"{folder}_check", OfflineStub(), "u", "p")
    q.awaitTermination(120)
    assert spark.read.parquet(f"{folder}_out/status").count() == 7  # a stream does not see files without bytes
    assert spark.read.parquet(f"{folder}_out/documents").count() == 4
