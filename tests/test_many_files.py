"""Many small files: few rows cross to Python at once, and few tasks read them back."""

import pickle

from pyspark.sql import Row
from pyspark.sql import functions as F

from lodestone.plans.oracles import ORACLE_SQL
from lodestone.plans.queries import QUERIES
from lodestone.sources import named_files


def test_rows_are_handed_on_in_pieces(spark, tmp_path, monkeypatch):
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    seen = []
    save = type(spark.range(1).write).save

    def saved(self, *own, **named):
        seen.append(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch"))
        return save(self, *own, **named)

    monkeypatch.setattr(type(spark.range(1).write), "save", saved)
    rows = spark.range(300).select(F.concat(F.lit("f/"), "id").alias("name"), F.repeat(F.lit("x"), 10).alias("content"))
    named_files.write_named_files(rows, str(tmp_path / "out"))
    assert seen == [str(named_files.ROWS_HELD)] and spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == before
    assert len(list((tmp_path / "out" / "f").iterdir())) == 300


def test_files_are_read_by_few_tasks(spark, small):
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("files", "files")
    try:
        n = QUERIES["document_files"](spark, small).count()
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    stages = [tracker.getStageInfo(s) for j in tracker.getJobIdsForGroup("files") for s in tracker.getJobInfo(j).stageIds]
    assert n > 150 and max(s.numTasks for s in stages if s) <= n // 20


def test_empty_and_hidden_files_count(spark, tmp_path, duck):
    rows = [(1, "a", "en"), (2, "", "src"), (3, None, "src"), (4, "x\r\ny", "_hidden"), (5, "b", ".dot"), (6, "c", "!"), (7, "d", None)]
    spark.createDataFrame(rows, "doc_id long, text string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    con = duck.cursor()
    con.execute(f"CREATE TEMP VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = con.execute(ORACLE_SQL["document_files"]).fetchall()
    con.execute("DROP VIEW temp.documents")
    assert sorted(map(tuple, QUERIES["document_files"](spark, str(tmp_path)).collect())) == sorted(want) and len(want) == 7


def test_driver_gets_a_message_for_a_task(tmp_path):
    """Names stay in lists that tasks write; what a task tells the driver has none."""
    writer = named_files.NamedFilesWriter(str(tmp_path / "staging"))
    told = writer.write(iter([Row(name=f"d/{i}", content="x") for i in range(500)]))
    assert len(pickle.dumps(told)) < 500
