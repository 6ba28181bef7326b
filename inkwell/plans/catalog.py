"""The queries over the driver's tables by name, each beside the SQL that it must equal."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from .. import schema, sinks
from ..functions import dimensions as dim, text as tx
from ..providers import OfflineStub
from ..operators import ingest, markdown as md, prompts, workspace as ws
from ..schema import load
from ..sources import files

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a query under its function's name."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def _quoted(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def _case(key: str, values: dict, default) -> str:
    q = lambda x: _quoted(x) if isinstance(x, str) else str(x)
    return f"CASE {key} " + " ".join(f"WHEN {q(k)} THEN {q(v)}" for k, v in values.items()) + f" ELSE {q(default)} END"


_ENDINGS = "[" + ", ".join(map(_quoted, schema.NAME_ENDINGS)) + "]"
PROJECTS = "projects AS (SELECT DISTINCT source AS id, source AS name FROM documents)"
DOCS = f"docs AS (SELECT doc_id AS id, source AS project_id, 'doc' || doc_id || '.' || ({_ENDINGS})[doc_id % 7 + 1] AS name, text AS content FROM documents)"
READY = f"{DOCS}, done AS (SELECT docs.*, CASE WHEN l.doc_id IS NOT NULL THEN 'ready' END AS summary FROM docs LEFT JOIN (SELECT doc_id FROM labels WHERE quality = 1) l ON docs.id = l.doc_id)"
SOME = f"{PROJECTS}, {DOCS}, half AS (SELECT id, CASE WHEN id LIKE '%5' THEN '' ELSE name END AS name FROM projects WHERE id LIKE 'src1%')"
EXT = "string_split(lower(name), '.')[-1]"


def _some_projects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Half of the projects, one of them without a name, so that look-ups miss."""
    half = schema.projects(spark, sf_dir).where("id like 'src1%'")
    return half.withColumn("name", F.when(F.col("id").endswith("5"), "").otherwise(F.col("name")))


@query(f"""WITH {PROJECTS}, {READY}, top AS (SELECT *, row_number() OVER (ORDER BY id DESC) - 1 AS pos FROM projects QUALIFY pos < 6),
n AS (SELECT project_id, count(*) AS c, count(*) FILTER (summary <> '') AS s FROM done GROUP BY 1)
SELECT id, name, pos::INT AS pos, (['◈','◉','◎','◍','◌','●'])[pos % 6 + 1] AS icon, coalesce(c, 0) AS doc_count, coalesce(s, 0) AS summary_count,
coalesce(c, 0) || ' document' || CASE WHEN coalesce(c, 0) <> 1 THEN 's' ELSE '' END AS count_text FROM top LEFT JOIN n ON id = project_id""")
def dashboard_overview(spark, sf_dir):
    return ws.dashboard(schema.projects(spark, sf_dir), schema.summarised(spark, sf_dir), order="id")


@query(f"""WITH {PROJECTS}, {READY} SELECT count(*) AS total_docs, count(*) FILTER (summary <> '') AS total_summaries,
(SELECT count(*) FROM projects) AS total_projects, count(*) FILTER (summary <> '') || ' / ' || count(*) || ' ready' AS ready_text FROM done""")
def workspace_totals(spark, sf_dir):
    return ws.totals(schema.summarised(spark, sf_dir), schema.projects(spark, sf_dir))


@query(f"""WITH {PROJECTS}, {DOCS} SELECT p.id, p.name, count(d.id) AS doc_count, count(d.id) || ' document' || CASE WHEN count(d.id) <> 1 THEN 's' ELSE '' END AS count_text
FROM projects p LEFT JOIN (SELECT * FROM docs WHERE project_id LIKE 'src1%') d ON d.project_id = p.id GROUP BY p.id, p.name""")
def project_doc_counts(spark, sf_dir):
    few = schema.documents(spark, sf_dir).where("project_id like 'src1%'")
    out = ws.project_counts(schema.projects(spark, sf_dir), few).drop("summary_count")
    return out.withColumn("count_text", tx.counted(F.col("doc_count"), "document"))


@query(f"WITH {DOCS} SELECT * FROM docs WHERE project_id = 'src1'")
def project_documents(spark, sf_dir):
    return ws.project_documents(schema.documents(spark, sf_dir), "src1", "id")


@query(f"WITH {PROJECTS} SELECT * FROM projects")
def all_projects(spark, sf_dir):
    return ws.newest_first(schema.projects(spark, sf_dir), "name")


@query(f"WITH {DOCS} SELECT id, project_id, name FROM docs")
def all_documents(spark, sf_dir):
    return ws.newest_first(schema.documents(spark, sf_dir), "id").select("id", "project_id", "name")


@query("SELECT conv_id AS project_id, turn AS seq, role, text FROM conversations WHERE conv_id = 3")
def chat_history(spark, sf_dir):
    return ws.chat_history(schema.chat_messages(spark, sf_dir).withColumn("id", F.col("seq")), 3, "seq").drop("id")


@query(f"WITH {SOME} SELECT d.id, d.project_id, d.name, coalesce(nullif(p.name, ''), 'Unknown project') AS project_name FROM docs d LEFT JOIN half p ON p.id = d.project_id ORDER BY d.id DESC LIMIT 4")
def recent_documents(spark, sf_dir):
    top = ws.newest(schema.documents(spark, sf_dir).drop("content"), 4, "id")
    return ws.with_project_name(top, _some_projects(spark, sf_dir))


@query(f"""WITH {SOME} SELECT d.id, d.project_id, d.name, coalesce(nullif(p.name, ''), 'Unknown project') AS project_name, {EXT.replace("name", "d.name")} AS ext,
{_case(EXT.replace("name", "d.name"), dim.HISTORY_ICONS, dim.OTHER_ICON)} AS icon FROM docs d LEFT JOIN half p ON p.id = d.project_id""")
def file_history(spark, sf_dir):
    return ws.history(schema.documents(spark, sf_dir).drop("content"), _some_projects(spark, sf_dir), "id")


@query("""SELECT c_custkey AS id, c_nationkey AS project_id, coalesce(nullif(n_name, ''), 'Unknown project') AS project_name
FROM customer LEFT JOIN (SELECT * FROM nation WHERE n_nationkey % 2 = 0) ON c_nationkey = n_nationkey""")
def unknown_project_label(spark, sf_dir):
    docs = load(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("project_id"))
    half = load(spark, sf_dir, "nation").where("n_nationkey % 2 = 0").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"))
    return ws.with_project_name(docs, half)


@query(f"WITH {SOME} SELECT id, project_id, name FROM docs WHERE project_id IN (SELECT id FROM half)")
def navigable_rows(spark, sf_dir):
    return ws.navigable(schema.documents(spark, sf_dir).drop("content"), _some_projects(spark, sf_dir))


@query(f"WITH {READY} SELECT id, project_id, summary, coalesce(summary <> '', false) AS is_ready FROM done")
def ready_pending_split(spark, sf_dir):
    return ws.split_ready(schema.summarised(spark, sf_dir)).select("id", "project_id", "summary", "is_ready")


@query(f"WITH {READY} SELECT nullif(count(*) FILTER (summary <> ''), 0) AS summary_count, count(*) = 0 AS is_empty FROM done WHERE project_id = 'src2'")
def summary_badge(spark, sf_dir):
    return ws.summary_badge(schema.summarised(spark, sf_dir).where("project_id = 'src2'"))


@query(f"""WITH {READY}, r AS (SELECT id, project_id, name, summary, row_number() OVER (ORDER BY id DESC) - 1 AS pos, count(*) OVER () AS n FROM done WHERE summary <> '' AND project_id = 'src3')
SELECT id, project_id, name, summary FROM r WHERE pos = least(2, n - 1)""")
def active_tab(spark, sf_dir):
    docs = schema.summarised(spark, sf_dir).where("project_id = 'src3'").drop("content")
    return ws.active_tab(docs, 2, "id")


@query(f"WITH {DOCS} SELECT id, project_id, name FROM docs WHERE id = 7")
def point_lookup(spark, sf_dir):
    return ws.by_id(schema.documents(spark, sf_dir).drop("content"), 7)


@query(f"WITH {DOCS} SELECT id, project_id, name FROM docs WHERE id <> 7")
def exclude_by_id(spark, sf_dir):
    return ws.without_id(schema.documents(spark, sf_dir).drop("content"), 7)


@query(f"WITH {DOCS} SELECT id, project_id, CASE WHEN id = 7 THEN 'renamed.txt' ELSE name END AS name FROM docs")
def patch_row(spark, sf_dir):
    return ws.patched(schema.documents(spark, sf_dir).drop("content"), 7, name=F.lit("renamed.txt"))


_NOTE = _quoted("\n\n…[Content truncated at 12,000 characters. The full text is stored but only this portion was sent to the AI.]")


@query(f"SELECT doc_id, length(text) > 12000 AS is_cut, CASE WHEN length(text) <= 12000 THEN text ELSE left(text, 12000) || {_NOTE} END AS content FROM documents")
def truncate_documents(spark, sf_dir):
    text = F.col("text")
    return load(spark, sf_dir, "documents").select("doc_id", (F.length(text) > tx.MOST_AI_CHARS).alias("is_cut"), tx.truncated(text).alias("content"))


@query(f"""WITH {DOCS} SELECT project_id, md5(string_agg('--- ' || name || ' ---' || chr(10) || left(content, 3000), chr(10) || chr(10) ORDER BY id DESC)) AS context_md5,
sum(least(length(content), 3000))::BIGINT AS chars FROM docs WHERE content <> '' GROUP BY project_id""")
def chat_context(spark, sf_dir):
    docs = schema.documents(spark, sf_dir)
    chars = docs.where(tx.present(F.col("content"))).groupBy("project_id").agg(F.sum(F.least(F.length("content"), F.lit(tx.MOST_CONTEXT_CHARS))).alias("chars"))
    return prompts.context(docs, "id").select("project_id", F.md5("context").alias("context_md5")).join(chars, "project_id")


_ROLE = "CASE WHEN role = 'user' THEN 'user' ELSE 'assistant' END"


@query(f"SELECT conv_id AS project_id, count(*)::INT AS n, string_agg({_ROLE} || ': ' || text, chr(10) ORDER BY turn) AS transcript FROM conversations GROUP BY conv_id")
def chat_transcript(spark, sf_dir):
    made = prompts.transcript(schema.chat_messages(spark, sf_dir))
    lines = F.transform("messages", lambda m: F.concat(m["role"], F.lit(": "), m["content"]))
    return made.select("project_id", F.size("messages").alias("n"), F.array_join(lines, "\n").alias("transcript"))


@query(f"SELECT role, {_ROLE} AS api_role, count(*) AS n FROM conversations GROUP BY ALL")
def role_mapping(spark, sf_dir):
    return load(spark, sf_dir, "conversations").groupBy("role", prompts.api_role(F.col("role")).alias("api_role")).agg(F.count("*").alias("n"))


@query(f"SELECT doc_id, md5({_quoted(prompts.SUMMARY_PROMPT[0])} || CASE WHEN length(text) <= 12000 THEN text ELSE left(text, 12000) || {_NOTE} END || {_quoted(prompts.SUMMARY_PROMPT[1])}) AS prompt_md5 FROM documents")
def summary_prompt(spark, sf_dir):
    return load(spark, sf_dir, "documents").select("doc_id", F.md5(prompts.summary_prompt(tx.truncated(F.col("text")))).alias("prompt_md5"))


_A, _B, _C = map(_quoted, prompts.FOLLOW_UP_PROMPT)


@query(f"""SELECT u.conv_id, u.turn, {_A} || u.text || {_B} || left(a.text, 600) || {_C} AS prompt
FROM conversations u JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 WHERE u.role = 'user' AND a.role = 'assistant'""")
def followup_prompt(spark, sf_dir):
    turns = load(spark, sf_dir, "conversations")
    asked = turns.where("role = 'user'").select("conv_id", "turn", F.col("text").alias("question"))
    answered = turns.where("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("answer"))
    return asked.join(answered, ["conv_id", "turn"]).select("conv_id", "turn", prompts.follow_up_prompt(F.col("question"), F.col("answer")).alias("prompt"))


@query(f"""WITH u AS (SELECT conv_id AS project_id, CASE WHEN conv_id % 2 = 0 THEN 'Be brief.' ELSE '' END AS system, list({{'role': {_ROLE}, 'content': text}} ORDER BY turn) AS m FROM conversations GROUP BY conv_id)
SELECT project_id, CASE WHEN system <> '' THEN 'system' ELSE m[1].role END AS first_role, (len(m) + CASE WHEN system <> '' THEN 1 ELSE 0 END)::INT AS n FROM u""")
def system_head(spark, sf_dir):
    made = prompts.transcript(schema.chat_messages(spark, sf_dir)).withColumn("system", F.when(F.col("project_id") % 2 == 0, "Be brief.").otherwise(""))
    full = made.withColumn("m", prompts.with_system(F.col("system"), F.col("messages")))
    return full.select("project_id", F.col("m")[0]["role"].alias("first_role"), F.size("m").alias("n"))


_SYSTEM = _quoted(prompts.CHAT_SYSTEM)


@query(f"""WITH {DOCS}, q AS (SELECT conv_id, 'src' || conv_id AS project_id, CASE WHEN conv_id % 5 = 0 THEN '  ' ELSE ' What of ' || conv_id || '?  ' END AS question FROM conversations GROUP BY conv_id),
c AS (SELECT project_id, string_agg('--- ' || name || ' ---' || chr(10) || left(content, 3000), chr(10) || chr(10) ORDER BY id DESC) AS context FROM docs WHERE content <> '' GROUP BY project_id)
SELECT q.project_id, trim(question) AS question, CASE WHEN q.project_id NOT IN (SELECT project_id FROM docs) THEN '{prompts.NO_DOCUMENTS}' END AS error, md5({_SYSTEM} || coalesce(context, '')) AS system_md5
FROM q LEFT JOIN c ON c.project_id = q.project_id WHERE trim(question) <> ''""")
def chat_requests(spark, sf_dir):
    messages = schema.chat_messages(spark, sf_dir).withColumn("project_id", F.concat(F.lit("src"), F.col("project_id").cast("string")))
    number = F.substring_index("project_id", "src", -1).cast("long")
    asked = messages.select("project_id").distinct().select("project_id", F.when(number % 5 == 0, "  ").otherwise(F.concat(F.lit(" What of "), number.cast("string"), F.lit("?  "))).alias("question"), F.lit("").alias("model"))
    made = prompts.chat_requests(asked, messages, schema.documents(spark, sf_dir), "id")
    return made.select("project_id", "question", "error", F.md5("system").alias("system_md5"))


_BYTES = """CASE WHEN n < 1024 THEN n || ' B' WHEN n < 1048576 THEN printf('%.1f', round(n / 1024.0::DOUBLE, 1)) || ' KB' ELSE printf('%.1f', round(n / 1048576.0::DOUBLE, 1)) || ' MB' END"""


@query(f"SELECT doc_id, n, {_BYTES} AS size_text FROM (SELECT doc_id, n_chars * CASE doc_id % 3 WHEN 0 THEN 1 WHEN 1 THEN 37 ELSE 4099 END AS n FROM documents)")
def format_bytes(spark, sf_dir):
    n = F.col("n_chars") * F.when(F.col("doc_id") % 3 == 0, 1).when(F.col("doc_id") % 3 == 1, 37).otherwise(4099)
    return load(spark, sf_dir, "documents").select("doc_id", n.alias("n")).withColumn("size_text", tx.file_size(F.col("n")))


@query(f"WITH {DOCS} SELECT name, {EXT} AS ext FROM docs UNION ALL SELECT n_name AS name, lower(n_name) AS ext FROM nation")
def file_extension(spark, sf_dir):
    names = schema.documents(spark, sf_dir).select("name").unionByName(load(spark, sf_dir, "nation").select(F.col("n_name").alias("name")))
    return names.withColumn("ext", tx.extension(F.col("name")))


@query(f"WITH {DOCS} SELECT id, {EXT} AS ext, {_case(EXT, dim.UPLOAD_ICONS, dim.OTHER_ICON)} AS icon FROM docs")
def extension_icon(spark, sf_dir):
    docs = schema.documents(spark, sf_dir).select("id", tx.extension(F.col("name")).alias("ext"))
    return docs.withColumn("icon", dim.looked_up(F.col("ext"), dim.UPLOAD_ICONS, dim.OTHER_ICON))


_SIZED = f"{DOCS}, sized AS (SELECT docs.id, docs.name, {EXT.replace('name', 'docs.name')} AS ext, n_chars * 4099 AS size FROM docs JOIN documents ON doc_id = id)"


def _sized(spark: SparkSession, sf_dir: str) -> DataFrame:
    chars = load(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), (F.col("n_chars") * 4099).alias("size"))
    return schema.documents(spark, sf_dir).drop("content").join(chars, "id").select("id", "name", tx.extension(F.col("name")).alias("ext"), "size")


@query(f"WITH {_SIZED} SELECT id, size, size > 20971520 AS is_too_large FROM sized")
def size_gate(spark, sf_dir):
    return _sized(spark, sf_dir).select("id", "size", files.too_large(F.col("size")).alias("is_too_large"))


@query(f"""WITH {_SIZED} SELECT id, CASE WHEN size > 20971520 THEN 'too_large' WHEN ext IN ('pdf', 'docx', 'doc', 'pptx', 'ppt', 'txt') THEN ext ELSE 'unsupported' END AS route,
CASE WHEN size > 20971520 THEN 'File is too large (' || printf('%.1f', round(size / 1048576.0::DOUBLE, 1)) || ' MB). Maximum allowed size is 20 MB. Please compress or split the file.'
WHEN ext = 'xyz' THEN 'Unsupported file type ".xyz". Supported formats: pdf, docx, pptx, txt.' END AS error FROM sized""")
def dispatch_route(spark, sf_dir):
    ext, size = F.col("ext"), F.col("size")
    return _sized(spark, sf_dir).select("id", files.route(ext, size).alias("route"), files.route_error(ext, size).alias("error"))


_EVENT_STATUS = {"click": "reading", "view": "summarizing", "purchase": "done", "signup": "error"}


@query(f"""WITH s AS (SELECT event_id, {_case("event_type", _EVENT_STATUS, "unheard of")} AS status FROM events)
SELECT event_id, status, {_case("status", {k: v for k, v, _ in dim.STATUSES}, "Pending")} AS status_label, {_case("status", {k: n for k, _, n in dim.STATUSES}, 0)} AS progress,
{_case("status", {k: f"{n}%" for k, _, n in dim.STATUSES}, "0%")} AS progress_text, status IN ('reading', 'extracting', 'summarizing', 'saving') AS is_active FROM s""")
def status_dimension(spark, sf_dir):
    events = load(spark, sf_dir, "events").select("event_id", dim.looked_up(F.col("event_type"), _EVENT_STATUS, "unheard of").alias("status"))
    return ws.status_shown(events, F.col("status"))


_MODEL_ROWS = ", ".join(f"({i}, {', '.join(map(_quoted, m))})" for i, m in enumerate(dim.MODELS))


@query(f"SELECT * FROM (VALUES {_MODEL_ROWS}) t(pos, id, label, provider, badge, description)")
def model_list(spark, sf_dir):
    return dim.models(spark)


_CHOICE = f"CASE event_id % 4 WHEN 0 THEN {_quoted(dim.MODELS[2][0])} WHEN 1 THEN {_quoted(dim.MODELS[5][0])} WHEN 2 THEN '' ELSE 'gone' END"


@query(f"""WITH m AS (SELECT * FROM (VALUES {_MODEL_ROWS}) t(pos, id, label, provider, badge, description)), c AS (SELECT event_id, {_CHOICE} AS model_id FROM events)
SELECT event_id, model_id, coalesce(label, {_quoted(dim.MODELS[0][1])}) AS model_label, coalesce(provider, {_quoted(dim.MODELS[0][2])}) AS model_provider FROM c LEFT JOIN m ON id = model_id""")
def model_dimension(spark, sf_dir):
    by = F.col("event_id") % 4
    choice = F.when(by == 0, dim.MODELS[2][0]).when(by == 1, dim.MODELS[5][0]).when(by == 2, "").otherwise("gone")
    return ws.model_row(load(spark, sf_dir, "events").select("event_id", choice.alias("model_id")), dim.models(spark))


@query("SELECT * FROM (VALUES " + ", ".join(f"({i}, {_quoted(s)})" for i, s in enumerate(dim.STARTERS[: dim.SHOWN_STARTERS])) + ") t(pos, prompt)")
def starter_prompts(spark, sf_dir):
    return dim.starters(spark).where(F.col("pos") < dim.SHOWN_STARTERS)


@query("SELECT p_partkey, CASE WHEN length(p_name) > 18 THEN left(p_name, 16) || '…' ELSE p_name END AS label FROM part")
def ellipsis_label(spark, sf_dir):
    return load(spark, sf_dir, "part").select("p_partkey", tx.short_label(F.col("p_name")).alias("label"))


@query("SELECT p_partkey, string_split(p_type, ' ')[1] AS first_token FROM part")
def first_token(spark, sf_dir):
    return load(spark, sf_dir, "part").select("p_partkey", tx.first_token(F.col("p_type")).alias("first_token"))


@query("SELECT c_custkey, upper(left(coalesce(nullif(CASE WHEN c_custkey % 3 = 0 THEN '' ELSE lower(c_mktsegment) END, ''), nullif(CASE WHEN c_custkey % 2 = 0 THEN c_name END, ''), 'U'), 1)) AS initial FROM customer")
def initial(spark, sf_dir):
    name = F.when(F.col("c_custkey") % 3 == 0, "").otherwise(F.lower("c_mktsegment"))
    other = F.when(F.col("c_custkey") % 2 == 0, F.col("c_name"))
    return load(spark, sf_dir, "customer").select("c_custkey", tx.initial(tx.or_else(name, other, "U")).alias("initial"))


@query("SELECT event_id, CASE WHEN hour(ts) < 12 THEN 'morning' WHEN hour(ts) < 18 THEN 'afternoon' ELSE 'evening' END AS greeting FROM events")
def greeting_bucket(spark, sf_dir):
    return load(spark, sf_dir, "events").select("event_id", tx.greeting(F.col("ts")).alias("greeting"))


@query("SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS date_text FROM orders")
def date_label(spark, sf_dir):
    return load(spark, sf_dir, "orders").select("o_orderkey", tx.date_text(F.col("o_orderdate")).alias("date_text"))


@query("SELECT o_orderkey, 'u' || o_custkey || '/p' || o_orderpriority || '/' || epoch_ms(o_orderdate) || '_' || o_orderstatus || '.txt' AS key FROM orders")
def storage_key(spark, sf_dir):
    user, project = F.concat(F.lit("u"), F.col("o_custkey").cast("string")), F.concat(F.lit("p"), F.col("o_orderpriority"))
    millis = F.unix_millis(F.col("o_orderdate").cast("timestamp"))
    return load(spark, sf_dir, "orders").select("o_orderkey", tx.storage_key(user, project, millis, F.concat(F.col("o_orderstatus"), F.lit(".txt"))).alias("key"))


_MARKUP = "html"
for _a, _b in (("<a:t>", " "), ("</a:t>", " "), ("<a:br/>", "\n")):
    _MARKUP = f"replace({_MARKUP}, {_quoted(_a)}, {_quoted(_b)})"
_MARKUP = f"regexp_replace({_MARKUP}, '<[^>]+>', '', 'g')"
for _a, _b in (("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&apos;", "'"), ("&quot;", '"'), ("&#xD;", "\n")):
    _MARKUP = f"replace({_MARKUP}, {_quoted(_a)}, {_quoted(_b)})"
_SPACE = r"[\t-\r\x{20}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}]"
_MARKUP = f"regexp_replace(regexp_replace({_MARKUP}, '{_SPACE}{{2,}}', ' ', 'g'), '^{_SPACE}+|{_SPACE}+$', '', 'g')"


@query(f"SELECT page_id, {_MARKUP} AS text FROM pages")
def strip_markup(spark, sf_dir):
    return load(spark, sf_dir, "pages").select("page_id", tx.slide_text(F.col("html")).alias("text"))


@query(f"""WITH s AS (SELECT page_id % 10 AS deck, page_id, {_MARKUP} AS text FROM pages),
n AS (SELECT deck, row_number() OVER (PARTITION BY deck ORDER BY page_id) AS i, CASE WHEN page_id % 7 = 0 THEN '' ELSE text END AS text FROM s)
SELECT deck, md5(string_agg('[Slide ' || i || ']' || chr(10) || text, chr(10) || chr(10) ORDER BY i)) AS text_md5 FROM n WHERE text <> '' GROUP BY deck""")
def slide_concat(spark, sf_dir):
    """Numbered first and filtered after: an empty slide has a number but no text."""
    from pyspark.sql import Window

    slides = load(spark, sf_dir, "pages").select((F.col("page_id") % 10).alias("deck"), "page_id", F.when(F.col("page_id") % 7 == 0, "").otherwise(tx.slide_text(F.col("html"))).alias("text"))
    numbered = slides.withColumn("i", F.row_number().over(Window.partitionBy("deck").orderBy("page_id"))).where("text <> ''")
    shown = F.concat(F.lit("[Slide "), F.col("i").cast("string"), F.lit("]\n"), F.col("text"))
    gathered = numbered.groupBy("deck").agg(F.array_sort(F.collect_list(F.struct("i", shown.alias("shown")))).alias("s"))
    return gathered.select("deck", F.md5(F.array_join(F.transform("s", lambda x: x["shown"]), "\n\n")).alias("text_md5"))


@query(f"""WITH {DOCS} SELECT project_id, md5(string_agg('[Page ' || i || ']' || chr(10) || content || chr(10) || chr(10), '' ORDER BY i)) AS text_md5
FROM (SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY id) AS i FROM docs) GROUP BY project_id""")
def page_concat(spark, sf_dir):
    """Pages are numbered in order, and those without text are shown by their number."""
    pages = schema.documents(spark, sf_dir).groupBy("project_id").agg(F.array_sort(F.collect_list(F.struct("id", "content"))).alias("p"))
    shown = F.transform("p", lambda x, i: F.concat(F.lit("[Page "), (i + 1).cast("string"), F.lit("]\n"), x["content"], F.lit("\n\n")))
    return pages.select("project_id", F.md5(F.array_join(shown, "")).alias("text_md5"))


@query("""SELECT conv_id AS project_id, turn, unnest([0, 1]) AS seq, unnest(['user', 'model']) AS role, unnest([text, 're: ' || left(text, 20)]) AS text
FROM conversations WHERE role = 'user' AND turn % 3 <> 0""")
def chat_turn_rows(spark, sf_dir):
    """A failed turn (here every third) leaves no rows."""
    asked = load(spark, sf_dir, "conversations").where("role = 'user'")
    failed = F.col("turn") % 3 == 0
    answered = asked.select(F.col("conv_id").alias("project_id"), "turn", F.col("text").alias("question"), F.when(~failed, F.concat(F.lit("re: "), F.left("text", F.lit(20)))).alias("reply"), F.when(failed, "no").alias("model_error"))
    return sinks.turn_rows(answered, "project_id", "turn")


@query(f"WITH {DOCS} SELECT id, name FROM docs WHERE id % 4 = 1")
def retry_rows(spark, sf_dir):
    docs = schema.documents(spark, sf_dir).select("id", "name")
    ran = docs.withColumn("status", F.when(F.col("id") % 4 == 1, "error").otherwise("done"))
    return ingest.to_retry(docs, ran)


@query("SELECT s_name AS path, coalesce(try_cast(nullif(regexp_extract(s_name, '[0-9]+'), '') AS BIGINT), 0) AS number FROM supplier")
def numeric_path_sort(spark, sf_dir):
    names = load(spark, sf_dir, "supplier").select(F.col("s_name").alias("path"), tx.digits_or_zero(F.col("s_name")).alias("number"))
    return ws.numeric_order(names, "path")


@query(r"SELECT n_name, regexp_matches('ppt/slides/' || n_name || n_nationkey || '.xml', '(?i)^ppt/slides/slide[0-9]+\.xml$') OR n_nationkey % 2 = 0 AS is_slide FROM nation")
def slide_paths(spark, sf_dir):
    name = F.when(F.col("n_nationkey") % 2 == 0, "SLIDE").otherwise(F.col("n_name"))
    path = F.concat(F.lit("ppt/slides/"), name, F.col("n_nationkey").cast("string"), F.lit(".xml"))
    return load(spark, sf_dir, "nation").select("n_name", path.rlike(r"(?i)\Appt/slides/slide[0-9]+\.xml\z").alias("is_slide"))


@query("""WITH t AS (SELECT o_orderkey AS id, o_orderdate AS created_at, row_number() OVER (ORDER BY o_orderdate DESC, o_orderkey) - 1 AS pos FROM orders)
SELECT id, created_at, pos::INT AS pos, (['◈','◉','◎','◍','◌','●'])[pos % 6 + 1] AS icon FROM t WHERE pos < 8""")
def cyclic_icon(spark, sf_dir):
    return ws.ranked_icon(load(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("created_at")), 8)


@query("""SELECT event_id, CASE WHEN event_id % 3 = 0 THEN '' ELSE array_to_string(list_slice(['a' || event_id, event_type, props, 'more'], 1, 3), '|') END AS follow_ups FROM events""")
def json_follow_ups(spark, sf_dir):
    four = F.to_json(F.array(F.concat(F.lit("a"), F.col("event_id").cast("string")), F.col("event_type"), F.col("props"), F.lit("more")))
    reply = F.when(F.col("event_id") % 3 == 0, F.concat(four, F.lit(" and more"))).when(F.col("event_id") % 3 == 1, F.concat(F.lit("```json\n"), four, F.lit("\n```"))).otherwise(four)
    return load(spark, sf_dir, "events").select("event_id", F.array_join(prompts.follow_ups(reply), "|").alias("follow_ups"))


@query("SELECT event_id, json_extract_string(props, '$.k') AS value FROM events")
def json_path(spark, sf_dir):
    return load(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").alias("value"))


@query(r"SELECT doc_id, len(regexp_extract_all(text, '(\*\*(.+?)\*\*|\*(.+?)\*|`(.+?)`|~~(.+?)~~)', 1))::INT AS n, array_to_string(regexp_extract_all(text, '(\*\*(.+?)\*\*|\*(.+?)\*|`(.+?)`|~~(.+?)~~)', 1), '|') AS spans FROM documents")
def inline_spans(spark, sf_dir):
    return load(spark, sf_dir, "documents").select("doc_id", md.marked(F.col("text")).alias("s")).select("doc_id", F.size("s").alias("n"), F.array_join("s", "|").alias("spans"))


@query("""SELECT p_partkey, unnest([0, 1, 2, 3, 4, 5]) AS pos, unnest(['heading', 'bullets', 'numbers', 'quote', 'spacer', 'paragraph']) AS kind, unnest([p_size % 3 + 1, 0, 0, 0, 0, 0]) AS level,
unnest([p_name, p_brand || '|' || p_type, p_type, p_name, '', p_brand || ' ' || p_name]) AS items FROM part""")
def markdown_blocks(spark, sf_dir):
    line = lambda *cols: F.concat(*[F.lit(c) if isinstance(c, str) else c for c in cols])
    c = F.col
    text = F.concat_ws("\n", line(F.repeat(F.lit("#"), c("p_size") % 3 + 1), " ", c("p_name")), line("- ", c("p_brand")), line("* ", c("p_type")), line("12. ", c("p_type")), line("> ", c("p_name")), F.lit(""), c("p_brand"), c("p_name"))
    made = md.with_blocks(load(spark, sf_dir, "part").select("p_partkey", text.alias("text")), "text")
    return made.select("p_partkey", "pos", "kind", "level", F.array_join("items", "|").alias("items"))


@query("""SELECT p_partkey, unnest([0, 1, 2, 3]) AS pos, unnest(['code', 'rule', 'paragraph', 'code']) AS kind, unnest([0, 0, 0, 0]) AS level,
unnest([p_name || chr(10) || '# ' || p_brand, '', p_type, '- open']) AS items FROM part""")
def markdown_rules(spark, sf_dir):
    """Fenced code to its fence or the end, a rule, and lines that look like a marker but are none, which are dropped."""
    c = F.col
    lines = (F.lit("```sql"), c("p_name"), F.concat(F.lit("# "), c("p_brand")), F.lit("```"), F.lit(" *** "), F.concat(F.lit("#### "), c("p_name")), F.concat(F.lit("**"), c("p_brand"), F.lit("**")), c("p_type"), F.lit("```"), F.lit("- open"))
    made = md.with_blocks(load(spark, sf_dir, "part").select("p_partkey", F.concat_ws("\n", *lines).alias("text")), "text")
    return made.select("p_partkey", "pos", "kind", "level", F.array_join("items", "|").alias("items"))


@query("SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS datetime_text FROM events")
def datetime_label(spark, sf_dir):
    return load(spark, sf_dir, "events").select("event_id", tx.datetime_text(F.col("ts")).alias("datetime_text"))


def _text_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents as uploaded files: texts with a byte-order mark, every seventh of an unknown kind, every eleventh too large."""
    c = F.col
    name = F.concat(F.lit("f/doc"), c("doc_id").cast("string"), F.when(c("doc_id") % 7 == 0, ".XYZ").otherwise(".TXT"))
    size = F.when(c("doc_id") % 11 == 0, F.lit(20971521)).otherwise(F.octet_length("text")).cast("long")
    content = F.concat(F.unhex(F.lit("EFBBBF")), c("text").cast("binary"))
    return files.entries(load(spark, sf_dir, "documents").select(name.alias("path"), size.alias("length"), content.alias("content")))


_FILES = """f AS (SELECT 'doc' || doc_id || CASE WHEN doc_id % 7 = 0 THEN '.XYZ' ELSE '.TXT' END AS name, text,
CASE WHEN doc_id % 11 = 0 THEN 'File is too large (20.0 MB). Maximum allowed size is 20 MB. Please compress or split the file.'
WHEN doc_id % 7 = 0 THEN 'Unsupported file type ".xyz". Supported formats: pdf, docx, pptx, txt.' END AS error FROM documents)"""


@query(f"WITH {_FILES} SELECT sha256('f/' || name) AS id, name, CASE WHEN error IS NULL THEN md5(text) END AS text_md5, error FROM f")
def extracted_texts(spark, sf_dir):
    """Each file has a text or an error; the byte-order mark is no part of the text."""
    return files.extracted(_text_files(spark, sf_dir)).select("id", "name", F.md5("text").alias("text_md5"), "error")


@query(f"""WITH {_FILES}, c AS (SELECT *, CASE WHEN length(text) <= 12000 THEN text ELSE left(text, 12000) || {_NOTE} END AS content FROM f)
SELECT name, CASE WHEN error IS NULL THEN 'done' ELSE 'error' END AS status, error AS error_msg, CASE WHEN error IS NULL THEN md5(content) END AS content_md5,
CASE WHEN error IS NULL THEN '[offline stub] ' || left(sha256({_quoted(prompts.SUMMARY_PROMPT[0])} || content || {_quoted(prompts.SUMMARY_PROMPT[1])}), 16) END AS summary,
'p' AS project_id, 'u' AS user_id FROM c""")
def file_status(spark, sf_dir):
    """Files through extraction, the cap and a provider (the stub, which is no model): one that fails stops no other."""
    done = ingest.processed(_text_files(spark, sf_dir), OfflineStub(), "u", "p")
    return done.select("name", "status", "error_msg", F.md5("content").alias("content_md5"), "summary", "project_id", "user_id")


@query("SELECT user_id AS id, event_id AS seq, event_type, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1")
def upsert_by_id(spark, sf_dir):
    return ws.upserted(load(spark, sf_dir, "events").select(F.col("user_id").alias("id"), F.col("event_id").alias("seq"), "event_type", "value"))


@query("SELECT conv_id, turn, role FROM conversations")
def append_bag(spark, sf_dir):
    turns = load(spark, sf_dir, "conversations").select("conv_id", "turn", "role")
    return ws.append(turns.where("turn % 2 = 0"), turns.where("turn % 2 = 1"))


_MESSAGES = ("Invalid login credentials", "x Email not confirmed", "email_not_confirmed", "User already registered.", "Password should be longer", "Unable to validate", "no provider", "else", "")


@query("SELECT * FROM (VALUES " + ", ".join(f"({i}, {_quoted(next((t for ps, t in tx.FRIENDLY_ERRORS if any(p in m for p in ps)), m or tx.FRIENDLY_DEFAULT))})" for i, m in enumerate(_MESSAGES)) + ") t(pos, shown)")
def friendly_error(spark, sf_dir):
    rows = spark.createDataFrame(list(enumerate(_MESSAGES)), "pos int, message string")
    return rows.select("pos", tx.friendly_error(F.col("message")).alias("shown"))
