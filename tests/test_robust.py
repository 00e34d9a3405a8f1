from pyspark.sql import functions as F

from sparkassay.operators.robust import mask_outliers


def test_mask_keeps_every_row_and_ignores_nan(spark):
    rows = [(i, "a", float(i)) for i in range(9)] + [(9, "a", 1000.0), (10, "a", None), (11, "a", float("nan")), (12, "a", -5.0)]
    df = spark.createDataFrame(rows, "id int, g string, x double")
    got = {r.id: r for r in mask_outliers(df, "x", ["g"], impossible=F.col("x") < 0).collect()}
    assert len(got) == len(rows)
    assert got[9].is_outlier and got[9].x is None
    assert got[12].is_outlier and not got[10].is_outlier and not got[0].is_outlier
