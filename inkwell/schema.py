"""The workspace tables and their making from the driver's test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from .session import prepare

PROJECTS = T.StructType([T.StructField("id", T.StringType()), T.StructField("user_id", T.StringType()), T.StructField("name", T.StringType()), T.StructField("created_at", T.TimestampType())])

DOCUMENTS = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("project_id", T.StringType()),
        T.StructField("user_id", T.StringType()),
        T.StructField("name", T.StringType()),
        T.StructField("content", T.StringType()),
        T.StructField("summary", T.StringType()),
        T.StructField("created_at", T.TimestampType()),
    ]
)

CHAT_MESSAGES = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("project_id", T.StringType()),
        T.StructField("user_id", T.StringType()),
        T.StructField("role", T.StringType()),
        T.StructField("text", T.StringType()),
        T.StructField("created_at", T.TimestampType()),
    ]
)

#: File endings that adapted document names cycle through; the last two are the unsupported cases.
NAME_ENDINGS = ("pdf", "docx", "doc", "pptx", "ppt", "txt", "xyz")


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def projects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, name: a project per source. The text of the source serves as the order, for want of a time."""
    source = F.col("source")
    return load(spark, sf_dir, "documents").select(source.alias("id"), source.alias("name")).distinct()


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, project_id, name, content; id serves as the order, for want of a time."""
    ending = F.element_at(F.array(*map(F.lit, NAME_ENDINGS)), (F.col("doc_id") % len(NAME_ENDINGS)).cast("int") + 1)
    return load(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("id"),
        F.col("source").alias("project_id"),
        F.concat(F.lit("doc"), F.col("doc_id").cast("string"), F.lit("."), ending).alias("name"),
        F.col("text").alias("content"),
    )


def summarised(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents() with a summary where labels call the document good; it stands for presence only."""
    labels = load(spark, sf_dir, "labels").where("quality = 1").select(F.col("doc_id").alias("id"), F.lit("ready").alias("summary"))
    return documents(spark, sf_dir).join(labels, "id", "left")


def chat_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """project_id, seq, role, text."""
    return load(spark, sf_dir, "conversations").select(F.col("conv_id").alias("project_id"), F.col("turn").alias("seq"), "role", "text")
