"""Nested network and labelled-case files, and the network export."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EDGE = """struct<id:string, tier:string, from_account:string, to_account:string, amount:double, timestamp:string,
 payment_rail:string, raw_narration:string, source_dataset:string>"""
NODE = "struct<account_id:string, account_name:string, entity_type:string, risk_rating:string, tier:string>"
NETWORK_SCHEMA = f"nodes array<{NODE}>, edges array<{EDGE}>"
CASE_SCHEMA = f"""test_id string, description string, expected_verdict string, expected_typology string,
 nodes array<{NODE}>, edges array<{EDGE}>, test_rationale string"""
METADATA_SCHEMA = "total_nodes long, total_edges long, typology_count int"


def _edges(df: DataFrame, *keep: str) -> DataFrame:
    rows = df.select(*keep, F.explode("edges").alias("e")).select(*keep, "e.*")
    return rows.withColumn("dt", F.to_timestamp("timestamp")).drop("timestamp")


def scan_network(spark: SparkSession, path: str, multi_line: bool = True) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of one or many network documents."""
    doc = spark.read.schema(NETWORK_SCHEMA).option("multiLine", multi_line).json(path)
    return doc.select(F.inline("nodes")), _edges(doc)


def scan_labelled_cases(spark: SparkSession, path: str, multi_line: bool = True) -> tuple[DataFrame, DataFrame]:
    """(cases, edges); an edge's ``net`` is its test id, so all cases run as one job."""
    doc = spark.read.schema(CASE_SCHEMA).option("multiLine", multi_line).json(path)
    return (doc.select("test_id", "description", "expected_verdict"),
            _edges(doc, "test_id").withColumnRenamed("test_id", "net"))


def network_metadata(nodes: DataFrame, edges: DataFrame, flags: DataFrame) -> DataFrame:
    count = lambda df, name: df.agg(F.count(F.lit(1)).alias(name))
    return (count(nodes, "total_nodes").join(count(edges, "total_edges"), F.lit(True))
            .join(flags.agg(F.countDistinct("typology").alias("typology_count")), F.lit(True)))


def export_network(nodes: DataFrame, edges: DataFrame, flags: DataFrame, folder: str) -> None:
    """Nodes, edges, flags and metadata as JSON folders (one nested document would need one task). The metadata counts what was written."""
    back = []
    for name, df in (("nodes", nodes), ("edges", edges), ("flags", flags)):
        df.write.mode("overwrite").json(f"{folder}/{name}")
        back.append(df.sparkSession.read.schema(df.schema).json(f"{folder}/{name}"))
    network_metadata(*back).write.mode("overwrite").json(f"{folder}/metadata")


def exported_metadata(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(METADATA_SCHEMA).json(f"{folder}/metadata")
