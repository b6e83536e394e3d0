"""Token totals and cost by model."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docprep.functions.text import est_cost_twd, est_cost_usd, est_output_tokens

#: Prices in US dollars for a million tokens.
PRICES = (("pro", 1.25, 5.00), ("flash", 0.075, 0.30), ("lite", 0.0375, 0.15))


def price_list(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(PRICES, "model_id string, input_price double, output_price double")


def find_model(models: DataFrame, model_id: str) -> DataFrame:
    return models.where(F.col("model_id") == model_id)


def scaled_tokens(total: Column, factor: int = 20) -> Column:
    """An exact sum of batches times `factor`, rounded half up."""
    return F.floor(total * factor + 0.5).cast("long")


def token_total(batches: DataFrame, factor: int = 20) -> DataFrame:
    """Exact sum of a document's batches times `factor`, rounded half up."""
    return batches.groupBy("doc_id").agg(scaled_tokens(F.sum("tokens"), factor).alias("tokens"))


def cost_by_model(tokens: DataFrame, models: DataFrame) -> DataFrame:
    """Every document against every model of the price list.

    The prices become one array literal, so no side is joined: the list is a parameter of a few rows, read here.
    """
    listed = F.array(*[F.struct(F.lit(r["model_id"]).alias("model_id"), F.lit(r["input_price"]).alias("i"), F.lit(r["output_price"]).alias("o")) for r in models.orderBy("model_id").collect()])
    each = tokens.select("doc_id", "tokens", F.explode(listed).alias("m")).select("doc_id", "tokens", "m.model_id", "m.i", "m.o")
    usd = est_cost_usd(F.col("tokens"), F.col("i"), F.col("o"))
    return each.select("doc_id", "model_id", "tokens", est_output_tokens(F.col("tokens")).alias("output_tokens"), usd.alias("usd"), est_cost_twd(usd).alias("twd"))


def cost_display(costs: DataFrame) -> DataFrame:
    """Four places for dollars, two for the other currency, rounded on the exact binary value."""
    plain = lambda c, places: F.replace(F.format_number(c, places), F.lit(","), F.lit(""))
    return costs.select("doc_id", "model_id", plain("usd", 4).alias("usd_text"), plain("twd", 2).alias("twd_text"))
