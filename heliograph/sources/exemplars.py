"""The bank of labelled exemplars and the priors of platforms, kept as JSON."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BANK = "signal_type string, text string, embedding array<double>, entities array<string>, platform string"

#: How likely signal types are on a platform where no file says so.
PRIORS = {
    "reddit": {"support_request": 0.30, "feature_request": 0.20, "competitor_mention": 0.15, "alternative_seeking": 0.15},
    "twitter": {"competitor_mention": 0.25, "complaint": 0.20, "churn_risk": 0.15},
    "linkedin": {"partnership_opportunity": 0.30, "expansion_opportunity": 0.20},
}


def save_bank(exemplars: DataFrame, path: str) -> None:
    """One JSON object a line, in as many files as the table has partitions."""
    exemplars.select(*(c.split()[0] for c in BANK.split(", "))).write.mode("overwrite").json(path)


def there(spark: SparkSession, path: str) -> bool:
    try:
        spark.read.text(path)
    except AnalysisException:
        return False
    return True


def load_bank(spark: SparkSession, path: str, types: list[str] | None = None) -> DataFrame:
    """Exemplars of a saved bank, or of one JSON array; none if there is no file, or if any exemplar lacks its type, text or embedding or has a type that isn't among ``types``."""
    if not there(spark, path):
        return spark.createDataFrame([], BANK)
    rows = spark.read.schema(BANK).option("multiLine", spark.read.text(path).where(F.trim("value").startswith("[")).limit(1).count() > 0).json(path)
    known = F.col("signal_type").isin(types) if types is not None else F.lit(True)
    bad = rows.where(F.col("signal_type").isNull() | F.col("text").isNull() | F.col("embedding").isNull() | ~known).limit(1).count()
    whole = rows.withColumns({"entities": F.coalesce("entities", F.array().cast("array<string>")), "platform": F.coalesce("platform", F.lit(""))})
    return whole.limit(0) if bad else whole


def load_priors(spark: SparkSession, path: str | None, types: list[str] | None = None, defaults: dict[str, dict[str, float]] = PRIORS) -> DataFrame:
    """platform, signal_type and prior of a JSON object of objects; the defaults if there is no file or it can't be read."""
    built_in = spark.createDataFrame([(p, t, v) for p, ts in defaults.items() for t, v in ts.items()], "platform string, signal_type string, prior double")
    if path is None or not there(spark, path):
        return built_in
    read = spark.read.text(path, wholetext=True).select(F.from_json("value", "map<string, map<string, double>>").alias("m"))
    rows = read.select(F.explode("m").alias("platform", "ts")).select(F.lower("platform").alias("platform"), F.explode("ts").alias("signal_type", "prior"))
    wrong = F.col("prior").isNull() | (~F.col("signal_type").isin(types) if types is not None else F.lit(False))
    if read.where("m IS NULL").limit(1).count() or not rows.take(1) or rows.where(wrong).limit(1).count():
        return built_in
    return rows


def candidates(items: DataFrame, priors: DataFrame, platform: Column, least: float = 0.0) -> DataFrame:
    """Each item with the signal types that its platform makes likely. Priors are a configuration's few rows; Spark decides whether to broadcast them."""
    return items.withColumn("_platform", F.lower(platform)).join(priors.withColumnRenamed("platform", "_platform"), "_platform").where(F.col("prior") >= least).drop("_platform")
