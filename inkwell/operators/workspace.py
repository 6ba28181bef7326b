"""Workspace queries: scans, look-ups, counts, recent items, states.

Every order ends in the row's id, so that ties do not depend on how rows are dealt out. Reads filter on user_id where it is given.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import dimensions as dim, text as tx

UNKNOWN_PROJECT = "Unknown project"


def of_user(df: DataFrame, user_id: str | None) -> DataFrame:
    return df if user_id is None else df.where(F.col("user_id") == user_id)


def newest_first(df: DataFrame, order: str = "created_at", user_id: str | None = None) -> DataFrame:
    return of_user(df, user_id).orderBy(F.desc_nulls_last(order), F.asc("id"))


def project_documents(documents: DataFrame, project_id: str, order: str = "created_at") -> DataFrame:
    """The filter reaches the scan; a table partitioned by project is pruned by it."""
    return newest_first(documents.where(F.col("project_id") == project_id), order)


def chat_history(messages: DataFrame, project_id: str, order: str = "created_at") -> DataFrame:
    return messages.where(F.col("project_id") == project_id).orderBy(F.asc_nulls_first(order), F.asc("id"))


def newest(df: DataFrame, k: int, order: str = "created_at") -> DataFrame:
    return newest_first(df, order).limit(k)


def ready(documents: DataFrame) -> DataFrame:
    return documents.where(tx.present(F.col("summary")))


def split_ready(documents: DataFrame) -> DataFrame:
    return documents.withColumn("is_ready", tx.present(F.col("summary")))


def by_id(df: DataFrame, id_: object) -> DataFrame:
    return df.where(F.col("id") == F.lit(id_)).limit(1)


def without_id(df: DataFrame, id_: object) -> DataFrame:
    return df.where(~F.col("id").eqNullSafe(F.lit(id_)))


def with_project_name(documents: DataFrame, projects: DataFrame) -> DataFrame:
    """project_name: the project's, or UNKNOWN_PROJECT where there is none or its name is missing."""
    names = projects.select(F.col("id").alias("_project"), F.col("name").alias("_name"))
    joined = documents.join(names, documents["project_id"] == names["_project"], "left")
    return joined.withColumn("project_name", tx.or_else(F.col("_name"), UNKNOWN_PROJECT)).drop("_project", "_name")


def navigable(documents: DataFrame, projects: DataFrame) -> DataFrame:
    """Documents whose project exists."""
    ids = projects.select(F.col("id").alias("_project"))
    return documents.join(ids, documents["project_id"] == ids["_project"], "left_semi")


def project_counts(projects: DataFrame, documents: DataFrame) -> DataFrame:
    """projects with doc_count and summary_count: 0 without documents; documents of no project are not counted.

    Counted before the join, so a project of any size sends a row per task.
    """
    summary = F.col("summary") if "summary" in documents.columns else F.lit(None)
    counts = documents.groupBy(F.col("project_id").alias("_project")).agg(F.count(F.lit(1)).alias("_n"), F.count_if(tx.present(summary)).alias("_ready"))
    joined = projects.join(counts, projects["id"] == counts["_project"], "left")
    zero = F.lit(0).cast("long")
    return joined.select(*[projects[c] for c in projects.columns], F.coalesce("_n", zero).alias("doc_count"), F.coalesce("_ready", zero).alias("summary_count"))


def totals(documents: DataFrame, projects: DataFrame) -> DataFrame:
    """One row: total_docs, total_summaries, total_projects, ready_text ('ready / all ready')."""
    a = documents.agg(F.count(F.lit(1)).alias("total_docs"), F.count_if(tx.present(F.col("summary"))).alias("total_summaries"))
    return a.join(projects.agg(F.count(F.lit(1)).alias("total_projects"))).withColumn("ready_text", F.concat(F.col("total_summaries").cast("string"), F.lit(" / "), F.col("total_docs").cast("string"), F.lit(" ready")))


def summary_badge(documents: DataFrame) -> DataFrame:
    """One row: summary_count, null instead of 0, and is_empty."""
    n = F.count_if(tx.present(F.col("summary")))
    return documents.agg(F.nullif(n, F.lit(0).cast("long")).alias("summary_count"), (F.count(F.lit(1)) == 0).alias("is_empty"))


def ranked_icon(df: DataFrame, k: int, order: str = "created_at") -> DataFrame:
    """The k newest, with pos (from 0) and the icon of that place, round and round."""
    top = newest(df, k, order)  # k rows, so that ranking them is no matter of size
    by = Window.orderBy(F.desc_nulls_last(order), F.asc("id"))
    icons = F.array(*map(F.lit, dim.PROJECT_ICONS))
    return top.withColumn("pos", F.row_number().over(by) - 1).withColumn("icon", F.element_at(icons, F.col("pos") % len(dim.PROJECT_ICONS) + 1))


def dashboard(projects: DataFrame, documents: DataFrame, k: int = 6, order: str = "created_at") -> DataFrame:
    """The k newest projects with their counts, count text, icon and place."""
    top = ranked_icon(projects, k, order)
    return project_counts(top, documents).withColumn("count_text", tx.counted(F.col("doc_count"), "document"))


def history(documents: DataFrame, projects: DataFrame, order: str = "created_at") -> DataFrame:
    """All documents, newest first, with project_name, ext and icon."""
    ext = tx.extension(F.col("name"))
    named = with_project_name(documents, projects).withColumns({"ext": ext, "icon": dim.looked_up(ext, dim.HISTORY_ICONS, dim.OTHER_ICON)})
    return newest_first(named, order)


def active_tab(documents: DataFrame, tab: int, order: str = "created_at") -> DataFrame:
    """The summarised document at place `tab` of the list, or the last one."""
    r = ready(documents)
    by = Window.orderBy(F.desc_nulls_last(order), F.asc("id"))
    last = r.count() - 1
    return newest_first(r, order).limit(min(tab, max(last, 0)) + 1).withColumn("_pos", F.row_number().over(by) - 1).where(F.col("_pos") == min(tab, last)).drop("_pos")


def model_row(choices: DataFrame, models: DataFrame, column: str = "model_id") -> DataFrame:
    """choices with the chosen model's label and provider; a missing or unknown choice gets the first model's."""
    named = models.select(F.col("id").alias("_id"), F.col("label").alias("_label"), F.col("provider").alias("_provider"))
    joined = choices.join(F.broadcast(named), choices[column] == named["_id"], "left")  # a literal table
    return joined.select(*[choices[c] for c in choices.columns], F.coalesce("_label", F.lit(dim.MODELS[0][1])).alias("model_label"), F.coalesce("_provider", F.lit(dim.MODELS[0][2])).alias("model_provider"))


def status_shown(df: DataFrame, status: Column) -> DataFrame:
    """status_label, progress, progress_text, is_active."""
    known = dim.status_progress(status)
    return df.withColumns({"status_label": dim.status_label(status), "progress": known, "progress_text": tx.percent(known), "is_active": F.coalesce(status.isin(*dim.ACTIVE), F.lit(False))})


def patched(df: DataFrame, id_: object, **values: Column) -> DataFrame:
    """df with the columns of the row with that id replaced."""
    here = F.col("id") == F.lit(id_)
    return df.withColumns({c: F.when(here, v).otherwise(F.col(c)) for c, v in values.items()})


def append(first: DataFrame, more: DataFrame) -> DataFrame:
    return first.unionByName(more)


def upserted(rows: DataFrame, key: str = "id", order: str = "seq") -> DataFrame:
    """The last written row of each key. max_by needs only a row per key and task, where a window would need all of a key's."""
    fields = [c for c in rows.columns if c != key]
    last = F.max_by(F.struct(*fields), F.struct(order, F.xxhash64(*fields)))
    return rows.groupBy(key).agg(last.alias("_r")).select(key, "_r.*")


def numeric_order(names: DataFrame, column: str) -> DataFrame:
    """By the first run of digits, 0 without one, then by name."""
    return names.orderBy(tx.digits_or_zero(F.col(column)), F.col(column))
