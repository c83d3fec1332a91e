"""Leak-free card features and ledger features for the mobile-money models."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import values as V
from ..plans.ordering import Ordered

HOUR, DAY = 3_600, 86_400


def causal_features(rows: DataFrame, user: str = "cc_num", ts: str = "timestamp", amount: str = "amount",
                    tie: str = "transaction_id") -> DataFrame:
    """Earlier rows of the same user in the last hour and day, and amount over the mean so far.

    Earlier means earlier in (time, tie) order; the look-back is in whole seconds and inclusive.
    """
    money = F.col(amount).cast("decimal(28,6)")
    one = F.lit(1).cast("long")
    base = rows.withColumns({"_us": F.unix_micros(ts), "_s": F.unix_seconds(ts)})
    seq = (Ordered(base, [user], ["_us", tie])
           .trailing("_s", HOUR, _h=one).trailing("_s", DAY, _d=one).running(_sum=money, _n=one)).plain()
    before = (F.col("_sum") - money).cast("double") / (F.col("_n") - 1)
    return seq.withColumns({
        "velocity_1h": F.col("_h") - 1, "velocity_24h": F.col("_d") - 1,
        "amount_to_user_mean_ratio": F.when(F.col("_n") == 1, 1.0).otherwise(F.round(F.col(amount) / (before + F.lit(1e-6)), 4)),
    }).drop("_us", "_s", "_h", "_d", "_sum", "_n")


def temporal_features(rows: DataFrame, ts: str = "timestamp", born: str | None = "dob") -> DataFrame:
    hour = F.hour(ts)
    return rows.withColumns({
        "hour_of_day": hour, "is_night": V.is_night(hour),
        "age_at_transaction": V.age_years(F.col(ts), F.col(born) if born in rows.columns else None)})


def card_features(rows: DataFrame) -> DataFrame:
    """All seven features of the simulated-card pipeline."""
    far = rows.withColumn("haversine_distance", F.round(V.haversine_km(
        F.col("lat"), F.col("long"), F.col("merch_lat"), F.col("merch_long")), 3))
    return causal_features(temporal_features(far))


def mobile_money_features(rows: DataFrame) -> DataFrame:
    return rows.withColumns(V.money_features())


def ledger_model_features(ledger: DataFrame) -> DataFrame:
    """Ledger rows as mobile-money feature vectors.

    The balance change looks at the account's own previous row; the first row of an account has
    change 0.
    """
    debit = F.col("direction") == "debit"
    seq = Ordered(ledger, ["account_id"], ["dt", "id"]).previous(_prev="balance").numbered("_rn").plain()
    opened = F.greatest(F.when(debit, F.col("balance") + F.col("amount")).otherwise(F.col("balance") - F.col("amount")), F.lit(0.01))
    change = F.abs(F.coalesce(F.col("balance") - F.col("_prev"), F.lit(0.0)))
    kind = V.money_type(F.col("payment_rail"), F.col("direction"))
    return seq.withColumns({
        "balance_drain_ratio": V.clamp(F.col("amount") / opened, 0.0, 1.0),
        "tx_velocity": F.log1p(F.col("_rn") - 1),
        "orig_dest_mismatch": F.log1p(F.abs(change - F.col("amount"))),
        "amount_log": F.log1p("amount"), "orig_open_log": F.log1p(opened),
        "orig_close_zero": (F.abs("balance") < 1.0).cast("double"),
        **V.money_type_flags(kind)}).drop("_prev", "_rn")


def align(rows: DataFrame, features: list[str], keep: list[str]) -> DataFrame:
    """Exactly ``features`` in order, absent or null ones as 0.0, after the columns to keep."""
    have = set(rows.columns)
    return rows.select(*keep, *[(F.coalesce(F.col(f).cast("double"), F.lit(0.0)) if f in have else F.lit(0.0)).alias(f)
                                for f in features])
