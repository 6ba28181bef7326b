"""What the training-data operators share: words, the shared folder and worker set-up."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

#: A word is a run of characters other than ASCII white space; bytes.split() cuts the same way.
NOT_WORD = r"[\x20\x09-\x0D]+"

_ROOT = str(Path(__file__).resolve().parents[2])


def prepare(spark: SparkSession) -> SparkSession:
    """Let Python workers import this package where it is not installed but lies on a common path."""
    spark.sparkContext.environment.setdefault("PYTHONPATH", _ROOT)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where all run on one machine and it is unset, as in tests, a temporary one."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = f"file://{tempfile.mkdtemp(prefix='inkwell-')}"
        spark.conf.set("spark.checkpoint.dir", base)
    return base


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, removed when the driver ends."""
    path = f"{shared_dir(spark)}/inkwell-{uuid.uuid4().hex}/{name}"
    atexit.register(_remove, spark, path.rpartition("/")[0])
    return path


def _remove(spark: SparkSession, path: str) -> None:
    sc = spark.sparkContext
    if sc._jsc is None:  # the session was stopped before
        return
    try:
        p = sc._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(sc._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # noqa: BLE001  the JVM may be gone at exit
        return


def stash(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it again: cuts lineage, survives lost executors."""
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Whether a query's shuffle files go when it ends; otherwise they stay until the driver happens to collect its garbage.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stash_freed(df: DataFrame, name: str) -> DataFrame:
    """stash(), after which no shuffle file of the write is left: disk is that of the largest step, not of all so far."""
    conf = df.sparkSession.conf
    before = conf.get(_CLEANUP, None)
    conf.set(_CLEANUP, "true")
    try:
        return stash(df, name)
    finally:
        conf.set(_CLEANUP, before) if before is not None else conf.unset(_CLEANUP)


def words(text: Column) -> Column:
    """array<string> of the words; a null text has none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), NOT_WORD), lambda w: w != "")


def packed(docs: DataFrame, **keys: Column) -> DataFrame:
    """docs as one struct column `_doc` beside keys, so that no column of docs, whatever its name, is taken for another."""
    whole = F.struct(*[F.col(_quoted(c)) for c in docs.columns]).alias("_doc")
    return docs.select(whole, *[c.alias(name) for name, c in keys.items()])


def unpacked(df: DataFrame, columns: list[str], **replaced: Column) -> DataFrame:
    """The columns of packed() documents again, some of them replaced."""
    return df.select(*[replaced[c].alias(c) if c in replaced else F.col("_doc").getField(c).alias(c) for c in columns])


def _quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def alike(left: DataFrame, right: DataFrame, names: list[str]) -> Column:
    """The condition that left and right agree in the columns `names`, nulls with nulls."""
    out = F.lit(True)
    for name in names:
        out = out & left[name].eqNullSafe(right[name])
    return out


def numbered(df: DataFrame, by: list[str], name: str) -> DataFrame:
    """df, written to the shared folder, with a column `name`: 0, 1, ... among the rows that agree in `by`.

    Counted in two steps, within what a task has written and over tasks, so that a value that very many rows share meets
    in no task; only `by` and row numbers are shuffled for it.
    """
    df = stash(df.withColumn("_at", F.monotonically_increasing_id()), "numbered")
    ids = df.select(*by, "_at", F.shiftright("_at", 33).alias("_task"))
    local = ids.withColumn("_local", F.row_number().over(Window.partitionBy(*by, "_task").orderBy("_at")) - 1)
    counts = ids.groupBy(*by, "_task").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*by).orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)
    firsts = counts.select(*by, "_task", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    ranked = local.join(firsts, alike(local, firsts, [*by, "_task"])).select(local["_at"], (F.col("_before") + F.col("_local")).alias(name))
    return df.join(ranked, "_at").drop("_at")


def spread(df: DataFrame, n: str, name: str, step: int = 10_000) -> DataFrame:
    """df with each row as often as its column n says, numbered 0 to n - 1 in `name`; the copies of a row with very many are dealt over tasks."""
    many = df.agg(F.max(n)).first()[0] or 0
    if many > step:
        df = df.withColumn("_step", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col(n) - 1) / step).cast("long")))).repartition(F.col("_step"), *df.columns)
        return df.withColumn(name, F.explode(F.sequence(F.col("_step") * step, F.least(F.col(n), (F.col("_step") + 1) * step) - 1))).drop("_step")
    return df.withColumn(name, F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1)))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def arrow_map(df: DataFrame, f: Callable[[Iterator[pa.RecordBatch]], Iterable[pa.RecordBatch]], schema: str) -> DataFrame:
    """mapInArrow, with the workers set up."""
    prepare(df.sparkSession)
    return df.mapInArrow(f, schema)


def text_bytes(column: pa.Array) -> list[bytes | None]:
    """The UTF-8 bytes of a string column, without a decoding step."""
    return column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()).to_pylist()
