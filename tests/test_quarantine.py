"""Loading CSV tables with bad rows: nothing is lost, and every reason is told."""

import os

from helpers import rows
from trendlens.session import scratch_path
from trendlens.sources.quarantine import load_csv

SCHEMA = "name string, n bigint, day date"
TEXT = '''name,n,day
a,1,2024-01-01
"b, ""quoted""",,2024-02-30
,x,
c,7,NA
d,8
e,9,2024-01-02,more
,12345678901234567890,2024-01-01
'''


def load(spark, tmp_path, text, **kwargs):
    path = f"{tmp_path}/t.csv"
    with open(path, "w") as f:
        f.write(text)
    return load_csv(spark, path, SCHEMA, scratch_path(spark, "loaded"), **kwargs)


def test_good_and_rejected_rows(spark, tmp_path):
    loaded = load(spark, tmp_path, TEXT, required=["name"], pandas_na=True)
    assert loaded.good.schema.simpleString() == "struct<name:string,n:bigint,day:date>"
    assert [(r[0], r[1], str(r[2])) for r in rows(loaded.good)] == [("a", 1, "2024-01-01"), ("c", 7, "None")]
    got = {(r.name, r.n, r.day, r.line): list(r.reasons) for r in loaded.rejected.collect()}
    assert got == {
        ('b, "quoted"', None, "2024-02-30", None): ["not a date in day: 2024-02-30"],
        (None, "x", None, None): ["no name", "not a bigint in n: x"],
        ("d", "8", None, "d,8"): ["wrong number of cells"],
        ("e", "9", "2024-01-02", "e,9,2024-01-02,more"): ["wrong number of cells"],
        (None, "12345678901234567890", "2024-01-01", None): ["no name", "not a bigint in n: 12345678901234567890"],
    }
    assert (loaded.n_good, loaded.n_rejected) == (2, 5)


def test_all_good_all_bad_and_nothing(spark, tmp_path):
    for name, text, good, bad in (("g", "name,n,day\na,1,\nb,,\n", 2, 0), ("b", "name,n,day\na,x,\n", 0, 1), ("e", "name,n,day\n", 0, 0)):
        folder = tmp_path / name
        os.mkdir(folder)
        loaded = load(spark, folder, text)
        assert (loaded.n_good, loaded.n_rejected) == (good, bad) == (loaded.good.count(), loaded.rejected.count())


def test_one_job_reads_the_files_once(spark, tmp_path):
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("load", "load")
    load(spark, tmp_path, TEXT)
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert len(tracker.getJobIdsForGroup("load")) <= 2  # the write, and listing at most
