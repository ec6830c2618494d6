"""The query of order flips and its SQL over one vector whose first reading has a broken sum but the right choice."""

import duckdb
from pyspark.sql import functions as F

import __spark_entry__ as entry


def test_a_broken_sum_is_no_wrong_choice(spark, tmp_path):
    embedding = [0.01 * i for i in range(64)]
    embedding[4] = 1.0
    rows = spark.createDataFrame([(129, embedding, 4)], "vec_id bigint, embedding array<double>, label bigint")
    rows.withColumn("embedding", F.col("embedding").cast("array<float>")).coalesce(1).write.parquet(f"{tmp_path}/embeddings.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    told = con.execute(f"SELECT valid, first_correct, second_correct FROM ({entry.oracle_sql()['e25_order_flips']}) WHERE scope = 'at_most_52'").fetchall()
    got = entry.queries()["e25_order_flips"](spark, str(tmp_path)).filter("scope = 'at_most_52'").select("valid", "first_correct", "second_correct").collect()
    assert told == [(1, 1, 1)] == [tuple(r) for r in got]
