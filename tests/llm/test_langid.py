"""Languages with few documents in a large table."""

from pyspark.sql import functions as F

from loomdoc.llm import langid


def test_rare_languages_are_learned(spark):
    common = spark.range(3000).select(F.col("id").alias("doc_id"), F.lit("the house and the garden are here").alias("text"), F.lit("en").alias("lang"))
    rare = spark.range(5000, 5012).select(F.col("id").alias("doc_id"), F.lit("hiša in vrt sta tukaj").alias("text"), F.lit("sl").alias("lang"))
    model = langid.fit(common.union(rare), most=100)
    assert model.langs == ("en", "sl") and model.predictor()("vrt in hiša")[0] == "sl" and model.predictor()("the garden")[0] == "en"
