"""Review files and generated stand-ins for them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import pick, stable_number

REVIEW = "id int, spam int, text string"

# Word lists and sentence templates of the generated reviews.
CATEGORIES = ["Electronics", "Home & Garden", "Sports", "Books", "Clothing",
              "Toys", "Health", "Automotive", "Food", "Office"]
ADJECTIVES = ["great", "excellent", "good", "okay", "poor", "amazing", "terrible"]
USES = ["home", "office", "travel", "daily use"]
DETAILS = ["Would recommend to others.", "Shipping was fast.", "Build quality is solid.",
           "Easy to set up and use.", "Customer service was helpful.", "Works as described.",
           "Better than similar products I've tried."]
TEMPLATES = [
    "This {adj} product exceeded my expectations. {detail}",
    "I bought this for my {use} and it works {adj}. {detail}",
    "After using this for a month, I can say it's {adj}. {detail}",
    "{adj} quality for the price. {detail}",
    "The {category} item arrived quickly. Overall {adj} experience. {detail}",
]


def read_reviews(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """Pipe-separated ``(id, spam, text)`` with a header and quoted text.

    A text with line breaks keeps a file in one task; files without any can be
    split with ``multi_line=False``.
    """
    return spark.read.csv(path, schema=REVIEW, sep="|", header=True, quote='"', escape='"',
                          multiLine=multi_line, mode="FAILFAST")


def synthetic_reviews(ids: DataFrame, key: str = "id", seed: int = 42) -> DataFrame:
    """One generated review per id, none of them spam.

    Every choice is a hash of seed, slot and id, so a rerun gives the same text.
    """
    def choice(slot: str, values: list[str]):
        return pick(values, stable_number(f"{seed}", slot, F.col(key)))

    text = choice("template", TEMPLATES)
    for slot, words in (("adj", ADJECTIVES), ("category", [c.lower() for c in CATEGORIES]),
                        ("use", USES), ("detail", DETAILS)):
        text = F.replace(text, F.lit("{%s}" % slot), choice(slot, words))
    return ids.select(F.col(key).alias("id"), F.lit(0).alias("spam"), text.alias("text"))


def reviews_or_synthetic(spark: SparkSession, path: str, n: int = 10_000) -> DataFrame:
    """The review file, or ``n`` generated reviews when it does not exist."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = where.getFileSystem(spark._jsc.hadoopConfiguration())
    return read_reviews(spark, path) if files.exists(where) else synthetic_reviews(spark.range(n))
