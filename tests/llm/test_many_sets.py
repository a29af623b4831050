"""Near duplicates where a task's sets are more than 16 bits can number, and where lists stay long."""

from pyspark.sql import functions as F

from cairn.llm import op8_near_duplicates


def test_links_of_more_sets_than_16_bits_number(spark):
    words = lambda of, n: F.array_join(F.transform(F.sequence(F.lit(1), F.lit(n)), lambda i: F.concat(F.lit("w"), of.cast("string"), F.lit("x"), i.cast("string"))), " ")
    plain = spark.range(69_400).select(F.col("id").alias("doc_id"), words(F.col("id"), 12).alias("text"))
    near = spark.range(69_100, 69_400).select((F.col("id") + 100_000).alias("doc_id"), words(F.col("id"), 13).alias("text"))
    docs = plain.unionByName(near).coalesce(1).sortWithinPartitions("doc_id")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        times = op8_near_duplicates.met_counts(docs, 1).toPandas()
        found = op8_near_duplicates.near_duplicates(docs)
        linked = found.where("doc_id >= 100000")
        assert len(times) >= 600 and linked.where("component_id = doc_id - 100000").count() == 300
        assert found.where("doc_id < 100000 and component_id <> doc_id").count() == 0
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
