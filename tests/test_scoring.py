from pyspark.sql import functions as F

from tidewheel.functions.text import normalize_text
from tidewheel.operators import location, relevance


def test_scoring_deals_one_row_group_to_many_tasks(spark, tmp_path):
    """A file of one row group has many splits by bytes, of which one holds all rows."""
    path, was = f"file://{tmp_path}/t", spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.range(4000).select(F.col("id").alias("ord"), F.sha2(F.col("id").cast("string"), 256).alias("description")).coalesce(1).write.parquet(path)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "10000")
    try:
        table = spark.read.parquet(path)
        assert table.rdd.getNumPartitions() > 4
        most = relevance.spread(table).groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", was)
    assert most < 1000


def test_normal_texts_are_what_lower_case_and_two_replacements_give(spark):
    texts = ["", None, " a  b ", "A,B ;c", "C++ / C# – x—y", "Kelvin İstanbul İx", "ÄÖ ẞǅ Straße", "x_y\tz\n\n q,", ",, a , ", "\U0001d400b & c&d", "Å Σσ 1²"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    low = F.translate(F.lower(F.coalesce("t", F.lit(""))), "–—", "--")
    wanted = F.trim(F.regexp_replace(F.regexp_replace(low, "[^a-z0-9+#./ -]+", " "), " +", " "))
    padded = F.trim(F.regexp_replace(F.replace(F.lower(F.coalesce("t", F.lit(""))), F.lit("&"), F.lit(" and ")), "[^a-z0-9]+", " "))
    for r in rows.select("t", normalize_text(F.col("t")).alias("a"), wanted.alias("b"), F.trim(location.plain(F.col("t"))).alias("c"), padded.alias("d")).collect():
        assert (r.a, r.c) == (r.b, r.d), r.t
