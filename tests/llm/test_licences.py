from __future__ import annotations

from pyspark.sql import functions as F

from trialweave.llm import licences


def found(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    return sorted((r.doc_id, r.scope, r.line, r.license_id) for r in licences.scan(docs, licences.known_licences(spark)).collect())


def test_case_marks_spelling_and_copyright_lines_do_not_matter(spark):
    mit = dict(reversed(licences.KNOWN))["MIT"]
    full = next(t for i, t in licences.KNOWN if i == "MIT" and "Permission" in t)
    changed = full.upper().replace("<YEAR> <COPYRIGHT HOLDERS>", "1999 Jane Doe").replace("LICENSE", "Licence").replace("\n\n", "\r\n\r\n  ").replace(",", " ,")
    assert mit and found(spark, [changed, full + " and more"]) == [(0, "document", 0, "MIT")]
    assert found(spark, ["licenced under the apache licence version 2.0", "© 2001 X\nAll rights reserved.\nReleased under the MIT License"]) == [
        (0, "document", 0, "Apache-2.0"), (0, "line", 1, "Apache-2.0"), (1, "document", 0, "MIT"), (1, "line", 3, "MIT"),
    ]


def test_a_part_of_a_line_is_no_match(spark):
    assert found(spark, ["It is released under the MIT License.", "Released under the MIT", None, "", "  \n ", "Copyright 2001 X"]) == []


def test_edges_and_clashing_columns(spark, edges, nothing):
    known = licences.known_licences(spark)
    rows = licences.scan(edges.withColumn("form", F.lit(1)).withColumn("digest", F.lit(2)), known).collect()
    assert [(r.doc_id, r.scope, r.line, r.license_id) for r in rows] == [(8, "line", 1, "MIT")]
    assert licences.scan(nothing, known).count() == 0
    assert licences.scan(edges, known.where("false")).count() == 0


def test_no_python_in_the_plan(spark, edges):
    plan = licences.scan(edges, licences.known_licences(spark))._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "Pandas"))
