"""Health is a matter of findings a file."""

from loomwork.operators import report


def test_health_does_not_depend_on_size(spark):
    rows = [(k, "c", k % 4, "medium") for k in range(8)]
    more = rows + [(k + 8, "c", f + 4, s) for k, _, f, s in rows]
    score = lambda r: report.health(spark.createDataFrame(r, "id long, category string, file long, severity string")).first().score
    assert score(rows) == score(more) == 63  # 6 points a file
    assert report.health(spark.createDataFrame([], "id long, category string, file long, severity string")).first().score == 100
