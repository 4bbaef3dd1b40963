import os

from quillspark import session


def test_the_run_folder_can_be_dropped(spark, monkeypatch):
    other = session.shared_folder(spark) + "/drop-test"
    monkeypatch.setattr(session, "run_folder", lambda _: other)
    table = session.materialize(spark.range(3), "numbers")
    folder = session.run_folder(spark)
    assert table.count() == 3 and os.listdir(folder.removeprefix("file:"))
    session.drop_run_folder(spark)
    assert not os.path.exists(folder.removeprefix("file:"))
    assert session.materialize(spark.range(3), "numbers").count() == 3


def test_discarded_table_is_gone(spark):
    table = session.materialize(spark.range(5).toDF("x"))
    files = table.inputFiles()
    assert table.count() == 5 and files
    session.discard(table)
    assert not os.path.exists(files[0].removeprefix("file://"))


def test_a_written_table_leaves_no_shuffle_files(spark):
    def files():
        found = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
        return {name for k in range(found.size()) if (name := found.apply(k).getName()).startswith("shuffle_") and name.endswith(".data")}

    before = files()
    rows = spark.range(1000).selectExpr("id % 10 AS k", "id")
    written = session.materialize(rows.groupBy("k").sum("id").join(rows.groupBy("k").count(), "k"))
    assert not files() - before
    assert written.count() == 10 and spark.conf.get(session.DROP_SHUFFLES, "false") == "false"
