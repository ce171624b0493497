"""Sources of documents by heading, and keys that a file defines again."""

import pytest
from factloom.operators import chunks, documentation
from factloom.sources import manifests


def test_sections_by_heading(spark):
    pages = {"a.md": "before\n# One\nx\n```\n## in a fence\n```\n#no heading\n#\u3000wide\n", "b.md": "no heading\nat all", "c.md": " \n\t", "d.md": "", "e.md": "# only", "f/yarn.lock": "# x", "g.md": None}
    rows = spark.createDataFrame([(p, "documentation", t) for p, t in pages.items()] + [("h.ts", "code", "# x")], "path string, kind string, content string")
    got = {r["source_id"]: (r["content"], r["start_line"], r["end_line"]) for r in chunks.document_sources(rows).collect()}
    assert got == {
        "a.md#section-1": ("# One\nx\n```", 2, 4), "a.md#section-2": ("## in a fence\n```\n#no heading", 5, 7), "a.md#section-3": ("#\u3000wide\n", 8, 9),
        "b.md#section-1": ("no heading\nat all", 1, 2), "e.md#section-1": ("# only", 1, 1),
    }


def test_later_keys_are_told(spark):
    rows = spark.createDataFrame([("a.properties", "x=1\ny=2\nx=3\nx:4"), ("b.yml", "a:\n  x: 1\nb:\n  x: 2\na:\n  x: 3\n"), (".env.example", "K=\nK=2")], "path string, content string")
    got = sorted((r["path"], r["line"], r["message"]) for r in manifests.configuration_diagnostics(rows).collect())
    said = "Duplicate configuration key {} was ignored".format
    assert got == [(".env.example", 2, said("K")), ("a.properties", 3, said("x")), ("a.properties", 4, said("x")), ("b.yml", 6, said("a.x"))]


@pytest.mark.parametrize(("completeness", "missing"), [(0.975, 1), (0.875, 3), (2, 0), (-1, 20)])
def test_health_explains_itself(spark, completeness, missing):
    findings = spark.createDataFrame([("high", "confirmed"), ("informational", "review")], "severity string, status string")
    row = documentation.health(findings, spark.range(2), completeness).first()
    assert row["explanation"] == f"100 - 16 finding penalty - 2 gap penalty - {missing} indexing penalty = {82 - missing}"
    assert (row["score"], row["confirmed"], row["review"]) == (82 - missing, 1, 1)
