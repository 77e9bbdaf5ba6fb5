"""Counters in the same pass, progress and the stop flag."""

import threading
import time

import pytest
from pyspark.sql import functions as F

from lodestone import storage
from lodestone.plans import runs


def test_counters_come_with_the_pass(spark):
    told = threading.Event()
    seen = {}
    rows = spark.range(1000).withColumn("odd", F.col("id") % 2 == 1)
    out, counters = runs.observed(rows, {"n": F.count(F.lit(1)), "n_odd": runs.counted_if(F.col("odd")), "top": F.max("id")}, lambda c: (seen.update(c), told.set()))
    assert not told.wait(0.2)
    assert out.filter("odd").count() == 500  # the counters stand before the filter
    assert told.wait(20) and seen == counters.get == {"n": 1000, "n_odd": 500, "top": 999}


def test_counters_of_no_rows(spark):
    out, counters = runs.observed(spark.range(0), {"n": F.count(F.lit(1)), "n_odd": runs.counted_if(F.col("id") % 2 == 1)})
    out.collect()
    assert counters.get == {"n": 0, "n_odd": 0}


def slow(spark):
    """Some jobs over a scratch table; the last takes a minute."""
    held = storage.materialise(spark.range(100), "held")

    def wait(batches):
        for b in batches:
            time.sleep(60)
            yield b

    return held.count() + held.mapInPandas(wait, "id long").count()


def exists(spark, path):
    hadoop_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop_path)


def test_a_run_stops_and_leaves_nothing(spark):
    said = []
    run = runs.Run(spark, slow, lambda *x: said.append(x), every=0.05)
    for _ in range(600):
        if run._scratch and spark.sparkContext.statusTracker().getActiveStageIds() and exists(spark, f"{run._scratch[0]}/_SUCCESS"):
            break
        time.sleep(0.05)
    assert run.running and exists(spark, run._scratch[0])
    began = time.time()
    run.stop()
    assert time.time() - began < 60 and not run.running
    with pytest.raises(runs.Stopped):
        run.result()
    assert not exists(spark, run._scratch[0])
    time.sleep(0.5)
    assert said[-1] == ("analysis", 1.0, "stopped") and all(0 <= share <= 1 for _, share, _ in said)
    assert spark.range(10).count() == 10  # other work isn't touched


def test_a_run_gives_its_result_and_its_error(spark):
    said = []
    run = runs.Run(spark, lambda s: storage.materialise(s.range(7), "kept").count(), lambda *x: said.append(x), "count")
    assert run.result(60) == 7 and exists(spark, run._scratch[0])
    storage.delete(spark, run._scratch[0])
    failing = runs.Run(spark, lambda s: (storage.materialise(s.range(7), "gone"), 1 / 0))
    with pytest.raises(ZeroDivisionError):
        failing.result(60)
    assert not exists(spark, failing._scratch[0])
    with pytest.raises(TimeoutError):
        runs.Run(spark, lambda s: time.sleep(2)).result(0.1)
