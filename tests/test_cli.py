"""The command line over a written topic file."""

from helpers import SF_SMALL, rows
from trendlens.__main__ import main
from trendlens.session import scratch_path
from trendlens.sources import fixtures as fx
from trendlens.sources.readers import read_csv
from trendlens.sources.writers import write_parquet


def test_cli_commands(spark, capsys):
    path = scratch_path(spark, "facts") + ".parquet"
    write_parquet(fx.topic_facts(spark, SF_SMALL), path)
    assert main(["top", path, "--level1", "STANDARD", "--from", "1996-01-01", "--to", "1998-12-31"], spark) == 0
    out = capsys.readouterr().out
    assert "rank" in out and "category: STANDARD, dates: 1996-01-01 to 1998-12-31" in out
    assert main(["info", path], spark) == 0
    assert "unique_topics" in capsys.readouterr().out
    assert main(["values", path, "level2", "--search", "#1", "--page-size", "5"], spark) == 0
    assert "Brand#1" in capsys.readouterr().out
    out_dir = scratch_path(spark, "cli_export")
    assert main(["export", path, out_dir, "--column", "level1", "--values", "PROMO", "SMALL"], spark) == 0
    assert "rows written" in capsys.readouterr().out


def test_download_is_named_by_its_filters(spark, capsys):
    path, folder = scratch_path(spark, "facts") + ".parquet", scratch_path(spark, "downloads")
    facts = fx.topic_facts(spark, SF_SMALL)
    write_parquet(facts, path)
    n = facts.where("level1 = 'STANDARD' AND date >= '1996-01-01'").count()
    assert n and main(["download", path, folder + "/", "--level1", "STANDARD", "--from", "1996-01-01", "--single-file"], spark) == 0
    assert f"{n:,} rows written to {folder}/filtered_topics_STANDARD_All.csv" in capsys.readouterr().out
    back = read_csv(spark, f"{folder}/filtered_topics_STANDARD_All.csv", schema=facts.schema)
    assert rows(back) == rows(facts.where("level1 = 'STANDARD' AND date >= '1996-01-01'"))
    assert main(["download", path, folder], spark) == 0
    assert read_csv(spark, f"{folder}/filtered_topics_All_All.csv", schema=facts.schema).count() == facts.count()
