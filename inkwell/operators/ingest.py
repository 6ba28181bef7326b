"""From files to documents: extract, cap, summarise, with a status for each file."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import text as tx
from ..providers import Provider, called
from ..sources.files import EXTRACTORS, Extractor, extracted
from .prompts import SUMMARY_SYSTEM, one_message, request_body, summary_prompt

SIGNED_OUT = "User not authenticated. Please refresh and log in again."


def processed(entries: DataFrame, provider: Provider, user_id: str | None, project_id: str, model: str | None = None, extractors: dict[str, Extractor] = EXTRACTORS) -> DataFrame:
    """A row per file: entries without content, content (capped text), summary, status (done or error), error_msg, and the document's columns.

    Failures are a file's own; a missing user fails every file before anything is read.
    """
    if not user_id:
        empty = F.lit(None).cast("string")
        return _finished(entries.drop("content"), empty, empty, F.lit(SIGNED_OUT), user_id, project_id)
    texts = extracted(entries, extractors).withColumn("_content", tx.truncated(F.col("text")))
    asked = texts.withColumn("_body", F.when(F.col("error").isNull(), request_body(one_message(summary_prompt(F.col("_content"))), F.lit(SUMMARY_SYSTEM), F.lit(model).cast("string"))))
    answered = called(asked, provider, "_body")
    return _finished(answered, F.col("_content"), F.col("reply"), F.coalesce("error", "model_error"), user_id, project_id).drop("text", "error", "_content", "_body", "reply", "model_error")


def _finished(df: DataFrame, content: Column, summary: Column, error: Column, user_id: str | None, project_id: str) -> DataFrame:
    good = error.isNull()
    return df.withColumns(
        {
            "project_id": F.lit(project_id),
            "user_id": F.lit(user_id).cast("string"),
            "content": F.when(good, content),
            "summary": F.when(good, summary),
            "status": F.when(good, "done").otherwise("error"),
            "error_msg": error,
        }
    )


def to_documents(processed: DataFrame) -> DataFrame:
    """The rows to store, of the files that are done."""
    return processed.where("status = 'done'").select("id", "project_id", "user_id", "name", "content", "summary")


def to_retry(entries: DataFrame, processed: DataFrame) -> DataFrame:
    """The entries whose last run failed, to be processed again."""
    return entries.join(processed.where("status = 'error'").select("id"), "id", "left_semi")
