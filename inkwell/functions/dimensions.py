"""Literal dimension tables. Their rows are fixed values of the application this engine serves."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

# Id, label, provider, badge, description. The first is the default.
MODELS = (
    ("stepfun/step-3.5-flash:free", "Step 3.5 Flash", "StepFun", "⚡", "Fast responses, great for quick Q&A"),
    ("arcee-ai/trinity-large-preview:free", "Trinity Large", "Arcee AI", "🔬", "Larger model, deeper analysis"),
    ("z-ai/glm-4.5-air:free", "GLM 4.5 Air", "Z.ai", "🌬️", "Advanced communications and text generation."),
    ("deepseek/deepseek-r1-0528:free", "DeepSeek R1 0528", "DeepSeek", "🔍", "Focuses on deep analysis and insights extraction."),
    ("openai/gpt-oss-120b:free", "OpenAI GPT-OSS 120B", "OpenAI", "🤖", "Model based on 120 billion parameters for versatile tasks."),
    ("qwen/qwen3-coder:free", "Qwen3 Coder 480B A35B", "Qwen", "💻", "Large model for programming and code-related tasks."),
)
DEFAULT_MODEL = MODELS[0][0]

# What an empty chat offers; the first SHOWN_STARTERS are shown.
STARTERS = (
    "What are the main topics covered?",
    "Summarize the key findings.",
    "What are the most important conclusions?",
    "List all dates and deadlines mentioned.",
    "What action items are recommended?",
    "Who are the key people or organizations?",
    "What data or statistics are referenced?",
    "What problems or challenges are discussed?",
)
SHOWN_STARTERS = 6

# Status, label, progress. An unknown status is shown as the first.
STATUSES = (
    ("pending", "Pending", 0),
    ("reading", "Reading…", 20),
    ("extracting", "Extracting…", 45),
    ("summarizing", "Summarizing…", 75),
    ("saving", "Saving…", 90),
    ("done", "Done ✓", 100),
    ("error", "Error", 0),
)
ACTIVE = ("reading", "extracting", "summarizing", "saving")

# Icons of file endings when uploading and in the history, and that of any other; icons of projects by rank.
UPLOAD_ICONS = {"pdf": "📄", "docx": "📝", "pptx": "📊", "txt": "📃"}
HISTORY_ICONS = {"pdf": "📄", "docx": "📝", "doc": "📝", "pptx": "📊", "txt": "📃"}
OTHER_ICON = "📁"
PROJECT_ICONS = ("◈", "◉", "◎", "◍", "◌", "●")


def models(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(i, *m) for i, m in enumerate(MODELS)], "pos int, id string, label string, provider string, badge string, description string")


def starters(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(enumerate(STARTERS)), "pos int, prompt string")


def statuses(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(i, *s) for i, s in enumerate(STATUSES)], "pos int, status string, label string, progress int")


def looked_up(key: Column, values: dict, default) -> Column:
    """values[key], or default, as an expression: a table this small needs no join."""
    out = F.lit(default)
    for k, v in values.items():
        out = F.when(key == k, F.lit(v)).otherwise(out)
    return out


def status_label(status: Column) -> Column:
    return looked_up(status, {s: label for s, label, _ in STATUSES}, STATUSES[0][1])


def status_progress(status: Column) -> Column:
    return looked_up(status, {s: n for s, _, n in STATUSES}, STATUSES[0][2])
