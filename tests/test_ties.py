"""Rows that an ORDER BY does not tell apart: their order is that of their values, not of the files."""

from pyspark.sql import functions as F

from leafline.plans import boxes


def test_lines_of_one_order_and_number_are_told_apart_by_their_values(spark, tmp_path):
    made = [(7, 1, 1, 5, 3, 28.0), (7, 1, 1, 4, 3, 19.0), (7, 2, 1, 4, 1, 5.0), (7, 1, 1, 4, 3, 7.0)]
    seen = []
    for k, rows in enumerate((made, made[::-1], [made[2], made[0], made[3], made[1]])):
        path = str(tmp_path / str(k))
        df = spark.createDataFrame(rows, "l_partkey long, l_orderkey long, l_linenumber int, l_suppkey long, l_shipdate int, l_quantity double")
        df.coalesce(1).write.parquet(f"{path}/lineitem.parquet")
        seen.append([(r["line"], float(r["x"])) for r in boxes._lines(spark, path).orderBy("line").select("line", F.col("x")).collect()])
    assert seen[0] == seen[1] == seen[2]
