from tarnweave.llm import common


def test_stored_tables_can_be_deleted(spark):
    kept = common.store(spark.range(5).toDF("i"), "t")
    assert sorted(r["i"] for r in kept.collect()) == [0, 1, 2, 3, 4]
    path = common._paths[-1]
    fs = spark._jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark._jsc.hadoopConfiguration())
    assert fs.exists(spark._jvm.org.apache.hadoop.fs.Path(path))
    common.clean_up(spark)
    assert not fs.exists(spark._jvm.org.apache.hadoop.fs.Path(path)) and common._paths == []


def test_checkpoint_cuts_lineage(spark):
    df = common.checkpoint(spark.range(3).selectExpr("id + 1 as x"))
    assert "Range" not in df._jdf.queryExecution().toString() and df.count() == 3


def test_lower_ascii_leaves_other_letters(spark):
    df = spark.createDataFrame([("ÄÖ AbZ",), (None,)], "t string")
    assert [r[0] for r in df.select(common.lower_ascii(df.t)).collect()] == ["ÄÖ abz", ""]
