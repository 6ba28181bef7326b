"""Sinks: documents, projects, chat turns, files."""

from __future__ import annotations

import atexit
import uuid
from collections.abc import Iterator
from datetime import datetime, timezone

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from .functions import text as tx
from .operators.workspace import upserted
from .schema import CHAT_MESSAGES, DOCUMENTS, PROJECTS


def _appended(rows: DataFrame, schema, path: str, partition_by: tuple[str, ...] = (), mode: str = "append", returning: bool = True) -> DataFrame | None:
    """Write rows in the table's shape and return them as written, or None.

    They are worked out once, to a folder beside the table's files that its readers do not see and that goes when the driver
    ends; what is returned is read from there, so times and ids are the table's and no model is called again.
    """
    spark, now = rows.sparkSession, F.lit(datetime.now(timezone.utc))
    given = {f.name: F.col(f.name).cast(f.dataType) if f.name in rows.columns else (F.uuid() if f.name == "id" else now if f.name == "created_at" else F.lit(None).cast(f.dataType)) for f in schema}
    shaped = rows.select(*[c.alias(n) for n, c in given.items()])
    if not returning:
        shaped.write.mode(mode).partitionBy(*partition_by).parquet(path)
        return None
    staged = f"{path.rstrip('/').rpartition('/')[0]}/_staged-{uuid.uuid4().hex}"
    shaped.write.parquet(staged)
    atexit.register(_remove, spark, staged)
    out = spark.read.schema(schema).parquet(staged)
    out.write.mode(mode).partitionBy(*partition_by).parquet(path)
    return out


def _remove(spark: SparkSession, path: str) -> None:
    sc = spark.sparkContext
    if sc._jsc is None:  # the session was stopped before
        return
    try:
        p = sc._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(sc._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # noqa: BLE001  the JVM may be gone at exit
        return


def append_documents(rows: DataFrame, path: str, mode: str = "append", returning: bool = True) -> DataFrame | None:
    """Partitioned by project, so that a project's documents are read by themselves."""
    return _appended(rows, DOCUMENTS, path, ("project_id",), mode, returning)


def append_projects(rows: DataFrame, path: str) -> DataFrame:
    """Names are trimmed; blank ones are refused, that is, not written."""
    named = rows.where(tx.not_blank(F.col("name"))).withColumn("name", tx.trimmed(F.col("name")))
    return _appended(named, PROJECTS, path)


def turn_rows(answered: DataFrame, *keep: str) -> DataFrame:
    """keep, seq, role, text: the user's message (seq 0), then the model's (1), of the turns that succeeded."""
    good = answered.where(F.col("model_error").isNull() & tx.present(F.col("reply")))
    pair = F.array(F.struct(F.lit(0).alias("seq"), F.lit("user").alias("role"), F.col("question").alias("text")), F.struct(F.lit(1).alias("seq"), F.lit("model").alias("role"), F.col("reply").alias("text")))
    return good.select(*keep, F.explode(pair).alias("m")).select(*keep, "m.*")


def append_turns(answered: DataFrame, path: str) -> DataFrame:
    """answered (project_id, question, reply, model_error): both messages of the turns that succeeded, in one write.

    A failed turn is never stored. The model's message is stored a microsecond after the user's, which keeps their order.
    """
    at = F.timestamp_micros(F.unix_micros(F.current_timestamp()) + F.col("seq"))
    return _appended(turn_rows(answered, "project_id").withColumn("created_at", at), CHAT_MESSAGES, path)


def merged(spark: SparkSession, path: str, rows: DataFrame, out: str, key: str = "id", order: str = "created_at") -> DataFrame:
    """The table at path with rows written over it by key, the latest by `order` winning, as a new table at out."""
    both = spark.read.parquet(path).unionByName(rows, allowMissingColumns=True)
    upserted(both, key, order).write.mode("overwrite").parquet(out)
    return spark.read.parquet(out)


def store_files(entries: DataFrame, root: str, user_id: str, project_id: str) -> DataFrame:
    """Copy each file to root/{user}/{project}/{epoch ms}_{name}; returns id, key, warning. A failed copy is a warning only.

    root is any file system that pyarrow opens by URI. Writing again under the same key replaces the file.
    """
    keyed = entries.select("id", "content", tx.storage_key(F.lit(user_id), F.lit(project_id), F.unix_millis(F.current_timestamp()), F.col("name")).alias("key"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        for f in frames:
            warnings = []
            for key, content in zip(f["key"], f["content"]):
                try:
                    system, base = fs.FileSystem.from_uri(root)
                    target = f"{base}/{key}"
                    system.create_dir(target.rpartition("/")[0], recursive=True)
                    with system.open_output_stream(target) as s:
                        s.write(content or b"")
                    warnings.append(None)
                except Exception as e:  # noqa: BLE001  the row in the table counts, the copy is best effort
                    warnings.append(str(e) or type(e).__name__)
            yield pd.DataFrame({"id": f["id"], "key": f["key"], "warning": pd.Series(warnings, dtype=object)})

    return keyed.mapInPandas(run, "id string, key string, warning string")
