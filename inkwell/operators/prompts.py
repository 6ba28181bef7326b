"""Prompts and transcripts by ordered aggregation, requests to language models, and parsing of their replies."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..functions import dimensions as dim, text as tx
from .markdown import WEB_SPACE

MOST_TOKENS = 1500
FOLLOW_UPS = 3
NO_DOCUMENTS = "No documents yet — upload files first."

# What the models are told.
SUMMARY_SYSTEM = "You are an expert document analyst. Produce structured, insightful summaries."
SUMMARY_PROMPT = (
    "Please provide a comprehensive summary of the following document.\n\n"
    "Use clear headings (##), bullet points, and highlight key insights. Be thorough but concise.\n\n---\n",
    "\n---",
)
CHAT_SYSTEM = (
    "You are an intelligent document assistant with access to the following documents. "
    "Answer questions accurately, cite relevant parts when useful, and be concise yet thorough.\n\nDocuments:\n"
)
FOLLOW_UP_SYSTEM = "You generate follow-up questions. Return only valid JSON arrays."
FOLLOW_UP_PROMPT = (
    "Based on this Q&A exchange, generate exactly 3 short, natural follow-up questions a user might want to ask next. "
    "Return ONLY a JSON array of 3 strings, no extra text, no markdown fences.\n\nQuestion: ",
    "\nAnswer: ",
    '\n\nReturn format: ["question 1", "question 2", "question 3"]',
)

MESSAGES = "array<struct<role:string,content:string>>"


def summary_prompt(content: Column) -> Column:
    return F.concat(F.lit(SUMMARY_PROMPT[0]), content, F.lit(SUMMARY_PROMPT[1]))


def follow_up_prompt(question: Column, answer: Column) -> Column:
    a, b, c = map(F.lit, FOLLOW_UP_PROMPT)
    return F.concat(a, question, b, tx.prefix(answer, tx.MOST_ANSWER_CHARS), c)


def context(documents: DataFrame, order: str = "created_at") -> DataFrame:
    """project_id, context: per document its name and the first characters of its content, newest first, a blank line between.

    Documents without content are left out; only prefixes are gathered, so a group holds some 3,000 characters a document.
    """
    part = F.concat(F.lit("--- "), F.coalesce("name", F.lit("")), F.lit(" ---\n"), tx.prefix(F.col("content"), tx.MOST_CONTEXT_CHARS))
    entry = F.struct(F.col(order).alias("o"), F.col("id").alias("id"), part.alias("part"))
    newest = lambda a, b: F.when(a["o"] > b["o"], -1).when(a["o"] < b["o"], 1).when(a["id"] < b["id"], -1).when(a["id"] > b["id"], 1).otherwise(0)
    gathered = documents.where(tx.present(F.col("content"))).groupBy("project_id").agg(F.collect_list(entry).alias("_parts"))
    return gathered.select("project_id", F.array_join(F.transform(F.array_sort("_parts", newest), lambda e: e["part"]), "\n\n").alias("context"))


def api_role(role: Column) -> Column:
    """user stays; all else speaks for the assistant."""
    return F.when(role == "user", "user").otherwise("assistant")


def transcript(messages: DataFrame, order: str = "seq") -> DataFrame:
    """project_id, messages: the whole history as role and content, oldest first."""
    entry = F.struct(F.col(order).alias("o"), api_role(F.col("role")).alias("role"), F.col("text").alias("content"))
    gathered = messages.groupBy("project_id").agg(F.array_sort(F.collect_list(entry)).alias("_m"))
    return gathered.select("project_id", F.transform("_m", lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content"))).alias("messages"))


def with_system(system: Column, messages: Column) -> Column:
    """messages, with the system's first if it is present."""
    head = F.array(F.struct(F.lit("system").alias("role"), system.alias("content")))
    return F.when(tx.present(system), F.concat(head, messages)).otherwise(messages)


def request_body(messages: Column, system: Column, model: Column) -> Column:
    """The JSON of a request; a missing model is the default."""
    return F.to_json(F.struct(tx.or_else(model, dim.DEFAULT_MODEL).alias("model"), F.lit(MOST_TOKENS).alias("max_tokens"), with_system(system, messages).alias("messages")))


def one_message(prompt: Column) -> Column:
    return F.array(F.struct(F.lit("user").alias("role"), prompt.alias("content")))


def chat_requests(questions: DataFrame, messages: DataFrame, documents: DataFrame, order: str = "created_at") -> DataFrame:
    """questions (project_id, question, model) with `error` or the `messages`, `system` and `body` of the request.

    A blank question is ignored (no row); a project without documents gives an error. The history goes in whole.
    """
    asked = questions.where(tx.not_blank(F.col("question"))).withColumn("question", tx.trimmed(F.col("question")))
    has = documents.select("project_id").distinct().withColumn("_has", F.lit(True))
    full = asked.join(has, "project_id", "left").join(context(documents, order), "project_id", "left").join(transcript(messages).withColumnRenamed("messages", "_before"), "project_id", "left")
    turn = F.concat(F.coalesce("_before", F.array().cast(MESSAGES)), one_message(F.col("question")))
    system = F.concat(F.lit(CHAT_SYSTEM), F.coalesce("context", F.lit("")))
    out = full.withColumns({"error": F.when(F.col("_has").isNull(), NO_DOCUMENTS), "messages": turn, "system": system})
    return out.withColumn("body", F.when(F.col("error").isNull(), request_body(F.col("messages"), F.col("system"), F.col("model")))).drop("_has", "_before", "context")


def reply_of(response: Column) -> Column:
    """The text of a JSON response; null where the path does not exist."""
    return F.get_json_object(response, "$.choices[0].message.content")


def parsed_follow_ups(reply: str | None) -> list[str]:
    """The first strings of a reply that is a JSON array, fenced or not; [] for anything else.

    Strict, as no built-in parser is: text after the array, single quotes, NaN and infinities are errors. Members that are not
    strings become their JSON text.
    """

    def reject(name: str) -> None:
        raise ValueError(name)

    try:
        found = json.loads((reply or "").replace("```json", "").replace("```", "").strip(WEB_SPACE), parse_constant=reject)
    except (ValueError, RecursionError):
        return []
    return [x if isinstance(x, str) else json.dumps(x, ensure_ascii=False, separators=(",", ":")) for x in found[:FOLLOW_UPS]] if isinstance(found, list) else []


@F.pandas_udf(T.ArrayType(T.StringType()))
def follow_ups(replies: pd.Series) -> pd.Series:
    return replies.map(parsed_follow_ups)
