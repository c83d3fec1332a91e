"""Card and mobile-money scans: fixed schemas, stable ids in time order."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.values import CARD_EPOCH
from ..plans.ordering import Ordered

SIGNALS = [f"V{i}" for i in range(1, 29)]
CARD_SCHEMA = ", ".join(["`Time` double"] + [f"`{v}` double" for v in SIGNALS] + ["`Amount` double", "`Class` int"])
CARD_FEATURES = ["Time"] + SIGNALS + ["Amount"]
SIM_SCHEMA = """trans_date_trans_time string, cc_num string, merchant string, category string, amt double, first string,
 last string, gender string, street string, city string, state string, zip string, lat double, long double, city_pop int,
 job string, dob string, trans_num string, unix_time long, merch_lat double, merch_long double, is_fraud int"""
MONEY_SCHEMA = """step int, type string, amount double, nameOrig string, oldbalanceOrg double, newbalanceOrig double,
 nameDest string, oldbalanceDest double, newbalanceDest double, isFraud tinyint, isFlaggedFraud tinyint"""
# Where a simulated-card training file may lie, and the names of the two data sets.
SIM_TRAIN_PATHS = ["fraudTrain.csv", "kartik2112/fraudTrain.csv", "fraud_train.csv"]
CARD_NAMES = ["creditcard", "creditcard.csv", "ulb"]
SIM_NAMES = ["kartik2112", "sparkov", "kartik"]


def exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def normalise_cards(raw: DataFrame) -> DataFrame:
    """Card rows numbered in time order from 0."""
    tie = raw.withColumn("_tie", F.xxhash64(*raw.columns))
    rows = Ordered(tie, [], ["Time", "Amount", "_tie"]).numbered("_rn").plain()
    return rows.select(
        F.lit("creditcard").alias("dataset_id"), F.format_string("TX-CC-%06d", F.col("_rn") - 1).alias("transaction_id"),
        F.col("Time").alias("timestamp_seconds"), F.timestamp_micros(F.lit(CARD_EPOCH * 1_000_000) + F.round(F.col("Time") * 1e6).cast("long")).alias("timestamp"),
        F.col("Amount").alias("amount"), *SIGNALS, F.col("Class").alias("is_fraud"))


def scan_card(spark: SparkSession, path: str, sample_size: int | None = None) -> DataFrame:
    """``sample_size`` takes the first rows of the file, before the sort."""
    raw = spark.read.schema(CARD_SCHEMA).option("header", True).csv(path)
    return normalise_cards(raw.limit(sample_size) if sample_size else raw)


def normalise_card_sim(raw: DataFrame) -> DataFrame:
    ts = F.to_timestamp("trans_date_trans_time")
    start = raw.agg(F.min(ts).alias("_start"))          # one row
    rows = raw.withColumn("timestamp", ts).join(F.broadcast(start), F.lit(True))
    return rows.select(
        F.lit("kartik2112").alias("dataset_id"), F.col("trans_num").alias("transaction_id"), "timestamp",
        ((F.unix_micros("timestamp") - F.unix_micros("_start")) / F.lit(1e6)).alias("timestamp_seconds"),
        "cc_num", "merchant", "category", F.col("amt").alias("amount"), "lat", "long", "merch_lat", "merch_long",
        "city_pop", "job", F.to_timestamp("dob").alias("dob"), "is_fraud")


def scan_card_sim(spark: SparkSession, folder: str, sample_size: int | None = None) -> DataFrame:
    """First training file found, with its test file beside it when there is one."""
    read = spark.read.schema(SIM_SCHEMA).option("header", True)
    for name in SIM_TRAIN_PATHS:
        train = f"{folder}/{name}"
        if exists(spark, train):
            test = f"{folder}/" + name.replace("Train", "Test").replace("train", "test")
            raw = read.csv(train)
            if exists(spark, test):
                raw = raw.unionByName(read.csv(test))
            return normalise_card_sim(raw.limit(sample_size) if sample_size else raw)
    raise FileNotFoundError(f"no simulated-card file in {folder}")


def load_dataset(spark: SparkSession, dataset_id: str, folder: str, sample_size: int | None = None) -> DataFrame:
    name = dataset_id.lower().strip()
    if name in CARD_NAMES:
        return scan_card(spark, f"{folder}/creditcard.csv", sample_size)
    if name in SIM_NAMES:
        return scan_card_sim(spark, folder, sample_size)
    raise ValueError(f"unknown dataset_id {dataset_id!r}; use 'creditcard' or 'kartik2112'")


def scan_mobile_money(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(MONEY_SCHEMA).option("header", True).csv(path)


def dataset_profile(rows: DataFrame, label: str, split: str) -> DataFrame:
    """Rows, positives and prevalence per split."""
    return rows.groupBy(split).agg(F.count(F.lit(1)).alias("n_rows"), F.sum(F.col(label).cast("long")).alias("positives"),
                                   F.round(F.avg(F.col(label).cast("double")), 6).alias("prevalence"))
