"""Bank-ledger scan: raw export -> canonical ledger rows (the spreadsheet codec is not built)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..plans.ordering import Ordered, sizes_of
from ..plans.storage import written

RAW_COLUMNS = ["Account No", "DATE", "TRANSACTION DETAILS", "CHQ.NO.", "VALUE DATE",
               "WITHDRAWAL AMT", "DEPOSIT AMT", "BALANCE AMT"]
RAW_SCHEMA = ", ".join(f"`{c}` string" for c in RAW_COLUMNS)


def read_raw(spark: SparkSession, path: str, fmt: str = "csv") -> DataFrame:
    """Ledger export with every column as text; casts happen in :func:`normalise`."""
    reader = spark.read.schema(RAW_SCHEMA)
    return reader.option("header", True).csv(path) if fmt == "csv" else reader.parquet(path)


def normalise(raw: DataFrame, tie: Column | None = None, source: str = "bank") -> DataFrame:
    """Raw text columns -> canonical columns without the id; ``tie`` orders rows of one day."""
    out = F.col("`WITHDRAWAL AMT`")
    paid_out, paid_in = text.number_or_zero(out), text.number_or_zero(F.col("`DEPOSIT AMT`"))
    debit = paid_out > 0
    dt = F.try_to_timestamp(F.col("DATE"))
    details = F.coalesce(F.col("`TRANSACTION DETAILS`"), F.lit(""))
    tie = tie if tie is not None else F.xxhash64(*[F.col(f"`{c}`") for c in RAW_COLUMNS])
    return raw.select(
        F.lit("real_ledger").alias("tier"),
        text.clean_account(F.col("`Account No`")).alias("account_id"),
        dt.alias("dt"),
        F.coalesce(F.try_to_timestamp(F.col("`VALUE DATE`")), dt).alias("value_dt"),
        F.when(debit, paid_out).otherwise(paid_in).alias("amount"),
        F.when(debit, "debit").otherwise("credit").alias("direction"),
        text.number_or_zero(F.col("`BALANCE AMT`")).alias("balance"),
        details.alias("raw_narration"),
        text.payment_rail(details).alias("payment_rail"),
        text.counterparty(details).alias("counterparty"),
        text.cheque_number(F.col("`CHQ.NO.`")).alias("chq_no"),
        F.lit(source).alias("source_dataset"),
        tie.alias("tie"),
    )


def with_sequential_ids(rows: DataFrame, prefix: str = "TX-LEDGER-") -> DataFrame:
    """``TX-LEDGER-%06d`` over (account, dt, tie).

    Position within the account plus the number of rows of earlier accounts. The account counts
    (one row per account) are ordered table-wide; the rows themselves never are.
    """
    per_account = written(rows.groupBy("account_id").agg(F.count(F.lit(1)).alias("_n")), "per-account")     # the text is parsed once for the counts
    offsets = (Ordered(per_account, [], ["account_id"]).running(_upto=F.col("_n")).plain()
               .select("account_id", (F.col("_upto") - F.col("_n")).alias("_offset")))
    numbered = Ordered(rows, ["account_id"], ["dt", "tie"], sizes_of(per_account, F.col("_n"))).numbered("_rn").plain()
    return (numbered.join(offsets, "account_id")
            .withColumn("id", F.format_string(prefix + "%06d", F.col("_offset") + F.col("_rn")))
            .drop("_offset", "_rn", "tie"))


def scan_ledger(spark: SparkSession, path: str, cache: str | None = None,
                force_reload: bool = False, fmt: str = "csv", tie: Column | None = None) -> DataFrame:
    """Parsed ledger. With a Parquet ``cache``: read from it when it exists (the source is not touched), else parsed and written to it;
    ``force_reload`` parses and writes it anew. ``tie`` orders rows of one account and moment."""
    if cache and not force_reload and _exists(spark, cache):
        return spark.read.parquet(cache)
    raw = read_raw(spark, path, fmt)
    rows = with_sequential_ids(normalise(raw) if tie is None else normalise(raw, tie=tie))
    if not cache:
        return rows
    rows.write.mode("overwrite").parquet(cache)
    return spark.read.parquet(cache)


def _exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path.rstrip("/") + "/_SUCCESS")
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def account_transactions(ledger: DataFrame, account: str) -> DataFrame:
    wanted = account.replace("'", "").strip()
    return ledger.filter(F.col("account_id") == wanted)


def transaction_by_id(rows: DataFrame, tx_id: str) -> DataFrame:
    return rows.filter(F.col("id") == tx_id)
