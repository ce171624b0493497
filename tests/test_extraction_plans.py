"""What grows with the files never goes through the driver, however small Spark takes it for."""

import sys
from pathlib import Path

from factloom.sources import extraction, structure

sys.path.insert(0, str(Path(__file__).parent))
from plan_rows import operators  # noqa: E402


def _files(spark):
    text = "concat('class P', id, ' extends P1 {\\n  void run', id, '() { run', id + 1, '(); }\\n}')"
    return spark.range(20).selectExpr("concat('P', id, '.java') path", "'java' language", f"{text} content")


def test_files_to_extract_anew_are_found_without_broadcasts(spark):
    artifacts = _files(spark)
    e = extraction.extract(artifacts, "shop")
    again = extraction.incremental(artifacts, artifacts.where("path = 'P3.java'").select("path"), e.relationships, e.entities)
    assert sorted(r["path"] for r in again.collect()) == ["P2.java", "P3.java"]
    assert "BroadcastExchangeExec" not in operators(again)


def test_statements_take_one_shuffle_of_files(spark):
    names = operators(structure.statements(_files(spark)))
    assert names.count("ShuffleExchangeExec") == 1 and "BroadcastExchangeExec" not in names
