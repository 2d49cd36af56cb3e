"""The graph for other tools: Cypher statements and JSON summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillgraph.config import STRUCTURAL


def quoted(c: Column) -> Column:
    return F.concat(F.lit("'"), F.replace(F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit("'"), F.lit("\\'")), F.lit("\n"), F.lit("\\n")), F.lit("'"))


def relation_type(c: Column) -> Column:
    name = F.upper(F.regexp_replace(c, "[^A-Za-z0-9_]", "_"))
    return F.when(name.rlike("^[A-Z_]"), name).otherwise(F.concat(F.lit("R_"), name))


def cypher(entities: DataFrame, relations: DataFrame) -> DataFrame:
    """(part, statement): MERGE statements, so that running them again changes nothing."""
    nodes = entities.select(F.lit(0).alias("part"), F.concat(F.lit("MERGE (n:Entity {id: "), quoted(F.col("id")), F.lit("}) SET n.label = "), quoted(F.col("label")), F.lit(", n.type = "), quoted(F.col("type")), F.lit(";")).alias("statement"))
    links = relations.select(F.lit(1).alias("part"), F.concat(F.lit("MATCH (a:Entity {id: "), quoted(F.col("src")), F.lit("}), (b:Entity {id: "), quoted(F.col("dst")), F.lit("}) MERGE (a)-[r:"), relation_type(F.col("label")), F.lit("]->(b) SET r.weight = "), F.col("weight").cast("string"), F.lit(";")).alias("statement"))
    return nodes.unionByName(links)


def dashboard(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(section, json): counts by collection and label, relations, and degrees."""
    by_coll = nodes.groupBy("coll").agg(F.count("*").alias("n"))
    by_label = edges.groupBy("label").agg(F.count("*").alias("n"))
    typed = edges.where(~F.col("label").isin(*STRUCTURAL) & F.col("expired_at").isNull())
    degree = typed.select(F.explode(F.array("src", "dst")).alias("id")).groupBy("id").agg(F.count("*").alias("degree"))
    out = None
    for name, df in (("collections", by_coll), ("labels", by_label), ("relations", typed.select("src", "label", "dst", "weight")), ("degrees", degree)):
        one = df.select(F.lit(name).alias("section"), F.to_json(F.struct(*df.columns)).alias("json"))
        out = one if out is None else out.unionByName(one)
    return out
