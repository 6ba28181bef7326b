import time

import pytest

from inkwell.llm import common


def test_shared_folder_is_the_one_named(spark):
    assert common.shared_dir(spark) == common.shared_dir(spark) == spark.conf.get("spark.checkpoint.dir")


def test_a_cluster_must_name_its_folder():
    class Conf:
        def get(self, *_):
            return None

    class Cluster:
        conf = Conf()

        class sparkContext:  # noqa: N801
            master = "spark://host:7077"

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        common.shared_dir(Cluster())


def test_stash_reads_what_was_written(spark):
    df = spark.createDataFrame([(1, None), (2, "x")], "a long, b string")
    out = common.stash(df, "t")
    assert out.schema == df.schema and sorted(map(tuple, out.collect())) == sorted(map(tuple, df.collect()))


def test_a_freed_stash_leaves_no_shuffle_files(spark):
    def shuffled():
        files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
        return {f for f in files.mkString("\n").split("\n") if "/shuffle_" in f}

    before, setting = shuffled(), spark.conf.get(common._CLEANUP)
    out = common.stash_freed(spark.range(1000).repartition(3, "id").groupBy("id").count(), "t")
    assert len(out.collect()) == 1000 and spark.conf.get(common._CLEANUP) == setting
    until = time.time() + 20  # Spark doesn't wait for the files to go
    while shuffled() - before and time.time() < until:
        time.sleep(0.2)
    assert not shuffled() - before


def test_words_are_parted_by_ascii_space_alone(spark):
    from pyspark.sql import functions as F

    row = spark.createDataFrame([(" a\x0bb\tc  d\x85e\x1cf ",)], "t string")
    assert row.select(common.words(F.col("t"))).first()[0] == ["a", "b", "c", "d\x85e\x1cf"]
    assert " a\x0bb\tc  d\x85e\x1cf ".encode().split() == [w.encode() for w in ["a", "b", "c", "d\x85e\x1cf"]]


def test_packed_columns_keep_odd_names(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(1, 2, 3)], ["a.b", "_doc", "`q"])
    out = common.unpacked(common.packed(df, _key=F.lit(0)), df.columns)
    assert out.columns == df.columns and tuple(out.first()) == (1, 2, 3)
