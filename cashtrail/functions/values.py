"""Time, geography, risk-label and model-feature expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_KM = 6371.0
DAY = 86_400
NIGHT_FROM, NIGHT_TO = 22, 6
YEAR_SECONDS = 365.25 * DAY
AGE_UNKNOWN = 40.0
# Origins of the offset clocks.
CARD_EPOCH = 1_377_993_600        # 2013-09-01T00:00:00Z
OFFSET_EPOCH = 1_789_689_600      # 2026-09-18T00:00:00Z

# Payment rail -> mobile-money transaction type (anything else is PAYMENT).
RAIL_TYPES = {
    "NEFT": "TRANSFER", "RTGS": "TRANSFER", "IMPS": "TRANSFER", "INDO_GIBL": "TRANSFER",
    "INTERNAL_TRANSFER": "TRANSFER", "BOOK_TRANSFER": "TRANSFER", "CASH_ATM": "CASH_OUT",
    "CHEQUE": "PAYMENT", "CARD_POS": "PAYMENT", "UPI": "PAYMENT", "GENERAL_TRANSFER": "PAYMENT",
    "OTHER": "PAYMENT",
}
MONEY_TYPES = ["PAYMENT", "TRANSFER", "CASH_OUT", "CASH_IN", "DEBIT"]
MONEY_FEATURES = ["balance_drain_ratio", "tx_velocity", "orig_dest_mismatch", "amount_log",
                  "orig_open_log", "orig_close_zero"] + [f"type_{t}" for t in MONEY_TYPES]


def clamp(c: Column, low, high) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), c))


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    half_lat = F.sin((F.radians(lat2) - F.radians(lat1)) / 2.0)
    half_lon = F.sin((F.radians(lon2) - F.radians(lon1)) / 2.0)
    a = half_lat * half_lat + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * half_lon * half_lon
    return F.lit(2.0 * EARTH_KM) * F.asin(F.sqrt(clamp(a, 0.0, 1.0)))


def is_night(hour: Column) -> Column:
    return ((hour >= NIGHT_FROM) | (hour < NIGHT_TO)).cast("int")


def age_years(ts: Column, born: Column | None) -> Column:
    if born is None:
        return F.lit(AGE_UNKNOWN)
    seconds = (F.unix_micros(ts) - F.unix_micros(born)) / F.lit(1e6)
    return F.round(seconds / F.lit(YEAR_SECONDS), 1)


def time_of_day_label(seconds: Column) -> Column:
    """Offset seconds -> ``HH:MM AM/PM``."""
    inside = F.pmod(F.floor(seconds), F.lit(DAY))
    return F.date_format(F.timestamp_seconds(inside), "hh:mm a")


def iso_from_offset(seconds: Column) -> Column:
    return F.date_format(F.timestamp_seconds(F.lit(OFFSET_EPOCH) + F.floor(seconds)),
                         "yyyy-MM-dd'T'HH:mm:ss'Z'")


def iso(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def money_type(rail: Column, direction: Column) -> Column:
    lookup = F.create_map(*[F.lit(x) for pair in RAIL_TYPES.items() for x in pair])
    mapped = F.coalesce(lookup[rail], F.lit("PAYMENT"))
    return F.when((mapped == "CASH_OUT") & (direction != "debit"), "CASH_IN").otherwise(mapped)


def money_type_flags(kind: Column) -> dict[str, Column]:
    return {f"type_{t}": F.coalesce((kind == t).cast("double"), F.lit(0.0)) for t in MONEY_TYPES}


def money_features() -> dict[str, Column]:
    """Mobile-money feature columns over step, type, amount and the four balances."""
    opened = F.greatest(F.col("oldbalanceOrg"), F.lit(0.01))
    gap = F.abs(F.col("oldbalanceDest") + F.col("amount") - F.col("newbalanceDest"))
    cols = {
        "balance_drain_ratio": clamp(F.col("amount") / opened, 0.0, 1.0),
        "tx_velocity": F.log1p("step"),
        "orig_dest_mismatch": F.log1p(gap),
        "amount_log": F.log1p("amount"),
        "orig_open_log": F.log1p("oldbalanceOrg"),
        "orig_close_zero": (F.col("newbalanceOrig") == 0).cast("double"),
        **money_type_flags(F.col("type")),
    }
    return {k: F.coalesce(F.nanvl(c, F.lit(0.0)), F.lit(0.0)) for k, c in cols.items()}


def factor_label(feature: Column, value: Column) -> Column:
    money = F.concat(F.lit("Transaction amount ($"), F.format_number(value, 2), F.lit(")"))
    clock = F.concat(F.lit("Transaction time ("), time_of_day_label(value), F.lit(")"))
    return (F.when(feature == "Amount", money).when(feature == "Time", clock)
            .otherwise(F.concat(F.lit("Anonymized behavioral signal "), feature)))


def verdict(score: Column, threshold: float) -> Column:
    return F.when(F.round(score, 4) >= threshold, "flagged").otherwise("clear")


def risk_band(score: Column) -> Column:
    return F.when(score >= 0.7, "high").when(score >= 0.4, "medium").otherwise("low")


def interval_label(score: Column, low: Column, high: Column, confidence: float) -> Column:
    pct = int(round(confidence * 100))
    return F.format_string(f"risk score: %.2f, {pct}%% CI: [%.2f, %.2f]", score, low, high)
