from pyspark.sql import functions as F

from graphloom.sinks import reports


def test_report_keeps_all_rows_in_order(spark):
    many = spark.range(2500).repartition(7).select((F.lit(2500) - F.col("id")).alias("n")).orderBy("n")
    rows = reports.analysis_report(spark, {"orphans": many, "cycles": many.limit(0)}).collect()
    got = sorted((r.place, r.line) for r in rows if r.section == "orphans")
    assert got == [(k, f"n={k + 1}") for k in range(2500)]
    assert [tuple(r) for r in rows if r.section == "cycles"] == [("cycles", 0, "none detected")]
