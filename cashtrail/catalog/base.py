"""Registry of queries and their SQL twins, and the SQL for the shared derived tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import RAIL_KEYWORDS
from ..sources.tables import CARD_COLUMNS, LEDGER_COLUMNS, MONEY_COLUMNS, SCORED_COLUMNS, SIM_COLUMNS

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(key: str, sql: str | None = None):
    """Register ``fn(spark, sf_dir)`` under ``key`` with its SQL twin, if there is one."""
    def add(fn):
        assert key not in QUERIES, key

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            spark.conf.set("spark.sql.session.timeZone", "UTC")     # days and hours are UTC throughout
            return fn(spark, sf_dir)

        run.__module__, run.__name__ = fn.__module__, fn.__name__
        QUERIES[key] = run
        if sql is not None:
            SQL[key] = sql
        return fn
    return add


def out(df: DataFrame) -> DataFrame:
    """Timestamps without zone, as the SQL side returns them."""
    stamps = [f.name for f in df.schema if f.dataType.simpleString() == "timestamp"]
    return df.withColumns({c: F.col(c).cast("timestamp_ntz") for c in stamps}) if stamps else df


def joined(c: str):
    """A list column as text, so both engines return the same value."""
    return F.array_join(F.transform(c, lambda x: x.cast("string")), ",").alias(c)


_rails = "CASE WHEN n IS NULL THEN 'OTHER' " + " ".join(
    "WHEN " + " OR ".join(f"contains(upper(n), '{w}')" for w in words) + f" THEN '{rail}'"
    for rail, words in RAIL_KEYWORDS) + " ELSE 'GENERAL_TRANSFER' END"
RAIL_SQL = lambda col: _rails.replace("(n)", f"({col})").replace("WHEN n IS", f"WHEN {col} IS")
COUNTERPARTY_SQL = lambda c: f"""CASE WHEN trim({c}) = '' THEN NULL ELSE coalesce(nullif(trim(regexp_replace(
  regexp_replace(trim({c}), '^(TRF (?:FROM|FRM|TO)|NEFT|RTGS|UPI/CR|UPI/DR|FDRL/)\\s*', '', 'i'), '\\s+', ' ', 'g')), ''), trim({c})) END"""

LEDGER_SQL = f"""led0 AS (SELECT {', '.join(f"{e} AS {n}" for n, e in LEDGER_COLUMNS.items())},
  CAST(l_shipdate AS TIMESTAMP) AS dt FROM lineitem),
ledger AS (SELECT *, 'real_ledger' AS tier, {RAIL_SQL('raw_narration')} AS payment_rail,
  {COUNTERPARTY_SQL('raw_narration')} AS counterparty,
  round(0.6E0*p_lgb + 0.4E0*p_rf, 4) AS risk_score, (p_lgb >= 0.95 OR p_rf >= 0.99) AS flagged FROM led0)"""

EDGES_SQL = """edges AS (SELECT * FROM (SELECT event_id AS id, CAST(user_id AS BIGINT) AS from_account,
  CAST(user_id // 100 * 100 + CAST(json_extract_string(props, '$.k') AS BIGINT) AS BIGINT) AS to_account,
  value AS amount, CAST(ts AS TIMESTAMP) AS dt, epoch_us(CAST(ts AS TIMESTAMP)) AS us, event_type AS payment_rail FROM events)
  WHERE from_account <> to_account)"""


def with_(*ctes: str, recursive: bool = False) -> str:
    return ("WITH RECURSIVE " if recursive else "WITH ") + ",\n".join(ctes) + "\n"


def _cte(columns: dict[str, str]) -> str:
    return ", ".join(f'{e} AS "{n}"' for n, e in columns.items())


EVENTS_US = "(SELECT *, CAST(ts AS TIMESTAMP) AS dt, epoch_us(CAST(ts AS TIMESTAMP)) AS us FROM events)"
CARDS_SQL = f"cards AS (SELECT {_cte(CARD_COLUMNS)} FROM {EVENTS_US})"
SCORED_SQL = f"scored AS (SELECT {_cte(SCORED_COLUMNS)}, dt FROM {EVENTS_US})"
MONEY_SQL = f"money AS (SELECT {_cte(MONEY_COLUMNS)} FROM lineitem)"
SIM_SQL = f"""sim AS (SELECT {_cte(SIM_COLUMNS)}, moment, CAST(DATE '1960-01-01' + CAST(o_custkey % 10000 AS INT) AS TIMESTAMP) AS dob
 FROM (SELECT *, CAST(o_orderdate AS TIMESTAMP) + to_seconds(CAST(o_orderkey * 7919 % 86400 AS BIGINT)) AS moment FROM orders))"""
