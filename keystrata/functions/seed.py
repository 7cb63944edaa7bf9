"""Generated pairs for trying the store out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keystrata.model import PUT

# The generated pairs.
SEED_PAIRS = [
    ("apple", "artichoke"), ("banana", "broccoli"), ("cherry", "cabbage"), ("durian", "daikon"), ("elderberry", "eggplant"), ("fig", "fennel"), ("grapefruit", "ginger"),
    ("honeydew", "horseradish"), ("imbe", "ivygourd"), ("jackfruit", "jicama"), ("kiwi", "kale"), ("lime", "leek"), ("mango", "mushroom"), ("nectarine", "nopale"), ("orange", "okra"),
    ("peach", "peas"), ("quince", "quinoa"), ("raspberry", "radish"), ("strawberry", "spinach"), ("tangerine", "tomato"), ("ugni", "ube"), ("voavanga", "vanilla"),
    ("watermelon", "watercress"), ("ximenia", "xanthan"), ("yuzu", "yam"), ("zarzamora", "zucchini"),
]


def seed_rows(indexes: DataFrame) -> DataFrame:
    """A pair of each kind for each index (column id), as mutations with their order."""
    pairs = F.explode(F.arrays_zip(F.array(*[F.lit(k) for k, _ in SEED_PAIRS]).alias("k"), F.array(*[F.lit(v) for _, v in SEED_PAIRS]).alias("v")))
    text = F.col("id").cast("string")
    return indexes.select("id", pairs.alias("p")).select(F.concat(F.lpad(text, 12, "0"), F.col("p.k")).alias("ord"), F.lit(PUT).alias("op"), F.concat("p.k", text).alias("key"), F.concat("p.v", text).alias("value"))


def seed_frame(spark: SparkSession, first: int, count: int) -> DataFrame:
    """26 x count pairs with indexes first..first+count-1, as mutations in order."""
    return seed_rows(spark.range(first, first + count))
