"""The exported graph read back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

NODE = "struct<tags:array<string>,links_out:array<string>,links_in:array<string>,degree_out:bigint,degree_in:bigint,cluster:bigint,path:string,source_dir:string>"
SCHEMA = f"nodes map<string,{NODE}>, edges array<array<string>>, clusters map<string,array<string>>"
#: How the export of this library begins, and its lines for nodes (name and value) and edges, with a comma before all but the first.
HEAD, NAMED, LINK = '{"stats": {', r'^,?("(?:[^"\\]|\\.)*"): (\{.*\})$', r'^,?(\["(?:[^"\\]|\\.)*",.*\])$'


def read(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of a links-graph.json; missing fields are null, a missing cluster is -1.

    The export of this library has a line for each node and edge, which tasks read in parts; any other form is one JSON value, which
    one task parses.
    """
    lines = spark.read.text(path)
    first = lines.first()
    if first is not None and first["value"].startswith(HEAD) and first["value"].endswith("},"):
        named = lines.filter(F.col("value").rlike(NAMED))
        key = F.from_json(F.concat(F.lit('{"k":'), F.regexp_extract("value", NAMED, 1), F.lit("}")), "k string")
        nodes = named.select(key["k"].alias("fname"), F.from_json(F.regexp_extract("value", NAMED, 2), NODE).alias("n")).select("fname", "n.*")
        listed = lines.filter(F.col("value").rlike(LINK)).select(F.from_json(F.regexp_extract("value", LINK, 1), "array<string>").alias("e"))
    else:
        held = spark.read.text(path, wholetext=True).select(F.from_json("value", SCHEMA).alias("g"))
        nodes = held.select(F.explode("g.nodes").alias("fname", "n")).select("fname", "n.*")
        listed = held.select(F.explode("g.edges").alias("e"))
    edges = listed.select(F.get("e", F.lit(0)).alias("src"), F.get("e", F.lit(1)).alias("dst"))
    return nodes.withColumn("cluster", F.coalesce("cluster", F.lit(-1).cast("long"))), edges
