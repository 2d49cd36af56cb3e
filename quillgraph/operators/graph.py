"""Graph algorithms over a user's visible part of the graph. entities: id, label, type; relations: src, dst, label, weight."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillgraph.config import GENERIC, STRUCTURAL, Config
from quillgraph.functions import text as T
from quillgraph.operators.acl import visible_edges
from quillgraph.operators.lineage import cut


def knowledge_graph(edges: DataFrame, entities: DataFrame, acl: DataFrame, carry: tuple[str, ...] | None = None) -> tuple[DataFrame, DataFrame]:
    """Per user: entities that accessible records mention, and live relations between them that such records assert,
    with all columns or those to carry (as visible_edges())."""
    mentions = edges.where("label = 'mentions'").select(F.col("src").alias("record_id"), F.col("dst").alias("id"))
    seen = mentions.join(acl.select("user_id", "record_id"), "record_id").select("user_id", "id").distinct()
    own = seen.join(entities, "id").select("user_id", "id", "label", F.coalesce("type", F.lit("CONCEPT")).alias("type"))
    live = edges.where(~F.col("label").isin(*STRUCTURAL) & F.col("expired_at").isNull())
    ends = seen.select("user_id", F.col("id").alias("src")), seen.select("user_id", F.col("id").alias("dst"))
    between = visible_edges(live, acl, carry).join(ends[0], ["user_id", "src"], "left_semi").join(ends[1], ["user_id", "dst"], "left_semi")
    return own, between


def adjacency(relations: DataFrame, *keys: str) -> DataFrame:
    """Both directions: (keys, node, to, label, weight, dir)."""
    out = relations.select(*keys, F.col("src").alias("node"), F.col("dst").alias("to"), "label", "weight", F.lit("out").alias("dir"))
    return out.unionByName(relations.select(*keys, F.col("dst").alias("node"), F.col("src").alias("to"), "label", "weight", F.lit("in").alias("dir")))


def resolve(names: DataFrame, entities: DataFrame) -> DataFrame:
    """names (name) to ids: by id or label, else by a part of either."""
    n = names.select("name", F.lower(F.trim("name")).alias("q"), T.slugify(F.col("name")).alias("slug")).where("q != ''")
    low = F.lower("label")
    ents = entities.select("id", low.alias("low"))
    hit = lambda df, tier: df.select("name", "id", F.lit(tier).alias("tier"))
    exact = hit(n.join(ents, F.col("id") == F.concat(F.lit(T.ENTITY), "slug")), 0).unionByName(hit(n.join(ents, F.col("low") == F.col("q")), 0))
    # a part of a label is found by its first characters, up to three, among the label's runs of as many
    part = None
    for text, wanted, least in (("low", "q", 1), ("id", "slug", 3)):
        for size in (1, 2, 3):
            fits = (F.length(wanted) >= 3) if size == 3 else (F.length(wanted) == size)
            keyed = n.where(fits & (F.length(wanted) >= least)).withColumn("g", F.substring(wanted, 1, size))
            one = keyed.join(ents.withColumn("g", F.explode(T.grams(F.col(text), size))), "g").where(F.contains(text, F.col(wanted)))
            if size >= least:
                part = hit(one, 1) if part is None else part.unionByName(hit(one, 1))
    both = exact.unionByName(part).groupBy("name", "id").agg(F.min("tier").alias("tier"))
    best = both.groupBy("name").agg(F.min("tier").alias("tier"))
    return both.join(best, ["name", "tier"]).select("name", "id")


def neighbours(relations: DataFrame, ids: DataFrame, relation: str | None = None) -> DataFrame:
    """(node, to, label, dir, weight, rank): typed relations before generic ones, then heavier ones."""
    adj = adjacency(relations).join(ids.select(F.col("id").alias("node")), "node", "left_semi")
    if relation:
        adj = adj.where(F.col("label") == relation)
    once = adj.groupBy("node", "to", "label", "dir").agg(F.max("weight").alias("weight"))
    w = Window.partitionBy("node").orderBy((F.col("label") == GENERIC).cast("int"), F.desc("weight"), "to", "label", "dir")
    return once.withColumn("rank", F.row_number().over(w))


def degrees(relations: DataFrame) -> DataFrame:
    """(node, degree, strength)."""
    return adjacency(relations).groupBy("node").agg(F.count("*").alias("degree"), F.sum("weight").alias("strength"))


def central(relations: DataFrame, limit: int = 10) -> DataFrame:
    return degrees(relations).orderBy(F.desc("strength"), F.desc("degree"), "node").limit(limit)


def hub_threshold(relations: DataFrame) -> DataFrame:
    """One row: the larger of 50 and the degree at the 99th percentile (an existing degree, no interpolation).

    Degrees are counted per value first, so that one task sees as many rows as there are different degrees.
    """
    hist = degrees(relations).groupBy("degree").agg(F.count("*").alias("c"))
    run = hist.withColumn("upto", F.sum("c").over(Window.orderBy("degree"))).withColumn("n", F.sum("c").over(Window.partitionBy()))
    place = F.least(F.col("n") - 1, F.floor(F.col("n") * 0.99))
    return run.where(F.col("upto") > place).agg(F.greatest(F.lit(50), F.coalesce(F.min("degree"), F.lit(50))).cast("long").alias("hub"))


def shortest_path(relations: DataFrame, starts: list[str], goals: list[str]) -> DataFrame:
    """(step, src, label, dst) of a shortest undirected chain; hubs are reached but never passed through.

    A level at a time, until a goal is met or nothing new is; each round's frontier joins the adjacency and drops what
    is known. Of equal parents the first by (typed first, weight, id) counts.
    """
    spark = relations.sparkSession
    schema = "step int, src string, label string, dst string"
    if not starts or not goals:
        return spark.createDataFrame([], schema)
    if set(starts) & set(goals):
        return spark.createDataFrame([], schema)
    relations = cut(relations.select("src", "dst", "label", "weight"))
    adj = adjacency(relations)
    hub = hub_threshold(relations).first()["hub"]
    big = degrees(relations).where(F.col("degree") > hub).select("node")
    known = spark.createDataFrame([(s, None, None, 0) for s in starts], "node string, parent string, label string, level int")
    frontier, hit, level = known, None, 0
    while not hit:
        level += 1
        open_ = frontier if level == 1 else frontier.join(big, "node", "left_anti")
        step = open_.select("node").join(adj, "node").join(known.select(F.col("node").alias("to")), "to", "left_anti")
        best = F.min_by(F.struct("node", "label"), F.struct((F.col("label") == GENERIC).cast("int"), -F.col("weight"), "node", "label"))
        frontier = step.groupBy("to").agg(best.alias("b")).select(F.col("to").alias("node"), F.col("b.node").alias("parent"), F.col("b.label").alias("label"), F.lit(level).alias("level"))
        frontier = cut(frontier)
        if frontier.isEmpty():
            return spark.createDataFrame([], schema)
        known = known.unionByName(frontier)
        if level % 16 == 0:  # a plan of few parts, however long the chain
            known = cut(known)
        hit = frontier.where(F.col("node").isin(*goals)).orderBy("node").first()
    chain, node = [], hit
    while node["parent"] is not None:  # as many look-ups as the path has steps
        chain.append((node["level"], node["parent"], node["label"], node["node"]))
        node = known.where((F.col("node") == node["parent"]) & (F.col("level") == node["level"] - 1)).first()
    return spark.createDataFrame(sorted(chain), schema)


def impact(edges: DataFrame, acl: DataFrame, ids: DataFrame) -> DataFrame:
    """(user_id, id, record_id): accessible records that mention the entities."""
    m = edges.where("label = 'mentions'").select(F.col("src").alias("record_id"), F.col("dst").alias("id"))
    return m.join(ids, "id", "left_semi").join(acl.select("user_id", "record_id"), "record_id").select("user_id", "id", "record_id").distinct()


def pagerank(relations: DataFrame, seeds: list[str], alpha: float = 0.85, rounds: int = 30, cut_every: int = 10) -> DataFrame:
    """(node, score) of a walk that restarts at the seeds; nodes without links lose their mass; seeds aren't returned.

    Each round is one join with the adjacency and one aggregation; lineage is cut by checkpoints in the shared folder.
    """
    spark = relations.sparkSession
    adj = adjacency(relations).groupBy("node", "to").agg(F.sum("weight").alias("weight"))
    out = adj.groupBy("node").agg(F.sum("weight").alias("total"))
    arcs = adj.join(out, "node").select("node", "to", (F.col("weight") / F.when(F.col("total") == 0, 1.0).otherwise(F.col("total"))).alias("share"))
    arcs = cut(arcs)
    restart = spark.createDataFrame([(s, 1.0 / len(set(seeds))) for s in sorted(set(seeds))], "node string, mass double")
    rank = restart.select("node", F.col("mass").alias("r"))
    for i in range(rounds):
        moved = rank.join(arcs, "node").select(F.col("to").alias("node"), (alpha * F.col("r") * F.col("share")).alias("r"))
        rank = moved.unionByName(restart.select("node", ((1 - alpha) * F.col("mass")).alias("r"))).groupBy("node").agg(F.sum("r").alias("r"))
        if (i + 1) % cut_every == 0 and i + 1 < rounds:
            rank = cut(rank)
    return rank.where(~F.col("node").isin(*seeds) & (F.col("r") > 0)).select("node", F.col("r").alias("score"))


def propagate_labels(relations: DataFrame, key: str, passes: int = 10) -> DataFrame:
    """(key, node, community) by weighted label propagation in order of ids, in place; ties take the smallest label.

    The algorithm is sequential by definition, so one task takes one scope (key): a user's visible graph.
    """

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        nodes = sorted(set(frame["node"]))
        links: dict[str, list[tuple[str, float]]] = {n: [] for n in nodes}
        for a, b, w in zip(frame["node"], frame["to"], frame["weight"]):
            links[a].append((b, w))
        own = {n: n for n in nodes}
        for _ in range(passes):
            moved = False
            for n in nodes:
                votes: dict[str, float] = {}
                for m, w in links[n]:
                    votes[own[m]] = votes.get(own[m], 0.0) + w
                best = min(votes, key=lambda x: (-votes[x], x))
                moved |= best != own[n]
                own[n] = best
            if not moved:
                break
        return pd.DataFrame({key: frame[key].iloc[0], "node": nodes, "community": [own[n] for n in nodes]})

    return adjacency(relations, key).groupBy(key).applyInPandas(run, f"{key} string, node string, community string")


def communities(relations: DataFrame, entities: DataFrame, key: str, least: int = 2) -> DataFrame:
    """(key, community, size, hub, members, top_relations): the hub is the best-connected member."""
    own = propagate_labels(relations, key)
    degree = adjacency(relations, key).groupBy(key, "node").agg(F.count("*").alias("d"))
    named = own.join(degree, [key, "node"]).join(entities.select(F.col("id").alias("node"), F.col("label").alias("name")), "node", "left").withColumn("name", F.coalesce("name", "node"))
    groups = named.groupBy(key, "community").agg(
        F.count("*").alias("size"),
        F.min_by("name", F.struct(-F.col("d"), F.col("node"))).alias("hub"),
        F.transform(F.array_sort(F.collect_list(F.struct((-F.col("d")).alias("d"), "node", "name"))), lambda x: x["name"]).alias("members"),
    )
    ends = own.select(key, F.col("node").alias("src"), F.col("community").alias("c1")), own.select(key, F.col("node").alias("dst"), F.col("community").alias("c2"))
    inner = relations.where(F.col("label") != GENERIC).join(ends[0], [key, "src"]).join(ends[1], [key, "dst"]).where("c1 = c2").groupBy(key, F.col("c1").alias("community"), "label").agg(F.count("*").alias("n"))
    top = inner.groupBy(key, "community").agg(F.transform(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("n"), "label"))), 1, 3), lambda x: F.replace(x["label"], F.lit("_"), F.lit(" "))).alias("top_relations"))
    return groups.where(F.col("size") >= least).join(top, [key, "community"], "left").withColumn("top_relations", F.coalesce("top_relations", F.array().cast("array<string>")))


def related_records(edges: DataFrame, acl: DataFrame, seeds: DataFrame, limit: int = 5, cfg: Config = Config()) -> DataFrame:
    """(query_id, record_id, shared, rank): records that share specific entities with the seeds or with their
    neighbours. seeds: query_id, user_id, record_id. Hubs are left out, the rarest neighbours come first."""
    mentions = edges.where("label = 'mentions'").select(F.col("src").alias("record_id"), F.col("dst").alias("e"))
    rare = mentions.groupBy("e").agg(F.count("*").alias("deg")).where(F.col("deg") <= cfg.hub)
    first = seeds.select("query_id", "record_id").join(mentions, "record_id").select("query_id", "e").distinct().join(rare.select("e"), "e", "left_semi")
    live = edges.where(~F.col("label").isin(*STRUCTURAL) & F.col("expired_at").isNull())
    hop = adjacency(live).select(F.col("node").alias("e"), "to")
    near = first.join(hop, "e").select("query_id", F.col("to").alias("e")).unionByName(first).distinct().join(rare, "e")
    w = Window.partitionBy("query_id").orderBy("deg", "e")
    kept = near.withColumn("n", F.row_number().over(w)).where(F.col("n") <= cfg.max_neighbours)
    # access comes before records are counted: only what a query's user may read is ever paired with it
    asked = seeds.select("query_id", "user_id").distinct()
    may = acl.select("user_id", "record_id").join(asked.select("user_id").distinct(), "user_id", "left_semi").distinct()
    readable = mentions.join(rare.select("e"), "e", "left_semi").join(may, "record_id")
    found = kept.select("query_id", "e").join(asked, "query_id").join(readable, ["user_id", "e"]).groupBy("query_id", "user_id", "record_id").agg(F.count("*").alias("shared"))
    allowed = found.join(seeds.select("query_id", "record_id"), ["query_id", "record_id"], "left_anti")
    ranked = allowed.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("shared"), "record_id")))
    return ranked.where(F.col("rank") <= limit).select("query_id", "record_id", "shared", "rank")


def walk_records(edges: DataFrame, acl: DataFrame, seeds: DataFrame, cfg: Config = Config()) -> DataFrame:
    """(query_id, record_id, score): records by the mass that a restarting walk brings to the entities they mention.

    seeds: query_id, user_id, entity. The walk stays in a part of the graph that is bounded per query by hops, nodes
    and edges, rarest first and without hubs; hops are joins over all queries, and each query's small part is then
    walked in one task. Seeds map to no records; a node's mass is split over its accessible records.
    """
    mentions = edges.where("label = 'mentions'").select(F.col("src").alias("record_id"), F.col("dst").alias("e"))
    total = mentions.groupBy("e").agg(F.count("*").alias("deg"))
    hubs = total.where(F.col("deg") > cfg.hub).select("e")
    readable = mentions.join(hubs, "e", "left_anti").join(acl.select("user_id", "record_id"), "record_id").select("user_id", "e", "record_id").distinct()
    df = readable.groupBy("user_id", "e").agg(F.count("*").alias("df"))
    start = seeds.select("query_id", "user_id", F.col("entity").alias("e")).distinct().join(df, ["user_id", "e"])
    by = Window.partitionBy("query_id").orderBy("df", "e")
    start = start.withColumn("n", F.row_number().over(by)).where(F.col("n") <= cfg.ppr_seeds).drop("n")
    start = cut(start)
    live = edges.where(~F.col("label").isin(*STRUCTURAL, GENERIC) & F.col("expired_at").isNull())
    seen = visible_edges(live, acl).select("user_id", F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b"), "weight")
    pairs = seen.groupBy("user_id", "a", "b").agg(F.max("weight").alias("weight"))
    both = pairs.select("user_id", F.col("a").alias("e"), F.col("b").alias("to"), "weight").unionByName(pairs.select("user_id", F.col("b").alias("e"), F.col("a").alias("to"), "weight"))
    nodes = frontier = start.select("query_id", "user_id", "e")
    arcs = None
    for _ in range(cfg.ppr_hops):
        step = frontier.join(both, ["user_id", "e"])
        arcs = step if arcs is None else arcs.unionByName(step)
        new = step.select("query_id", "user_id", F.col("to").alias("e")).distinct().join(nodes.select("query_id", "e"), ["query_id", "e"], "left_anti").join(total, "e", "left").withColumn("deg", F.coalesce("deg", F.lit(0))).where(F.col("deg") <= cfg.hub)
        ranked = new.withColumn("n", F.row_number().over(Window.partitionBy("query_id").orderBy("deg", "e"))).where(F.col("n") <= cfg.max_neighbours)
        frontier = ranked.select("query_id", "user_id", "e")
        nodes = nodes.unionByName(frontier)
    arcs = arcs.select("query_id", F.least("e", "to").alias("a"), F.greatest("e", "to").alias("b"), "weight").where("a != b").distinct()
    arcs = arcs.withColumn("n", F.row_number().over(Window.partitionBy("query_id").orderBy("a", "b"))).where(F.col("n") <= cfg.ppr_edges)
    rows = start.select("query_id", F.col("e").alias("a"), F.lit(None).cast("string").alias("b"), F.col("df").cast("double").alias("weight")).unionByName(arcs.select("query_id", "a", "b", F.col("weight").cast("double")))

    def walk(frame: pd.DataFrame) -> pd.DataFrame:
        first, links = frame[frame["b"].isna()], frame[~frame["b"].isna()]
        ids = sorted(set(first["a"]) | set(links["a"]) | set(links["b"]))
        at = {x: i for i, x in enumerate(ids)}
        m = np.zeros((len(ids), len(ids)))
        for a, b, w in zip(links["a"], links["b"], links["weight"]):
            m[at[a], at[b]] = m[at[b], at[a]] = w if w > 0 else 1.0
        out = m.sum(1)
        t = np.zeros(len(ids))
        for a, d in zip(first["a"], first["weight"]):
            t[at[a]] = 1 / d
        t /= t.sum()
        r = t.copy()
        for _ in range(cfg.ppr_iterations):
            go = np.where(out > 0, cfg.ppr_alpha * r / np.where(out > 0, out, 1), 0)
            new = go @ m
            new += (r.sum() - cfg.ppr_alpha * r[out > 0].sum()) * t
            delta = np.abs(new - r).sum()
            r = new
            if delta < 1e-9:
                break
        return pd.DataFrame({"query_id": frame["query_id"].iloc[0], "e": ids, "mass": r})

    mass = rows.groupBy("query_id").applyInPandas(walk, "query_id string, e string, mass double").join(start.select("query_id", "e"), ["query_id", "e"], "left_anti")
    reach = mass.join(seeds.select("query_id", "user_id").distinct(), "query_id").join(df, ["user_id", "e"]).join(readable, ["user_id", "e"])
    scored = reach.groupBy("query_id", "record_id").agg(F.sum(F.col("mass") / F.col("df")).alias("score")).where("score > 0")
    ranked = scored.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "record_id")))
    return ranked.where(F.col("rank") <= cfg.ppr_limit).select("query_id", "record_id", "score")


def components(relations: DataFrame, rounds: int = 50) -> DataFrame:
    """(node, component): the smallest id that a node reaches, by passing on smallest ids and jumping."""
    adj = cut(adjacency(relations).select("node", "to").where("node != to").distinct())
    own = adj.select("node").distinct().withColumn("component", F.col("node"))
    for _ in range(rounds):
        low = adj.join(own.select(F.col("node").alias("to"), "component"), "to").groupBy("node").agg(F.min("component").alias("m"))
        new = own.join(low, "node").select("node", F.least("component", "m").alias("component"))
        jump = new.select(F.col("node").alias("component"), F.col("component").alias("further"))
        new = new.join(jump, "component", "left").select("node", F.coalesce("further", "component").alias("component"))
        new = cut(new)
        if not new.join(own.withColumnRenamed("component", "old"), "node").where("component != old").limit(1).count():
            return new
        own = new
    raise RuntimeError("components did not settle")


def belief_diff(relations: DataFrame, a: str, b: str) -> DataFrame:
    """(src, label, dst, only): typed relations that only one of two users sees."""
    facts = relations.where(~F.col("label").isin(*STRUCTURAL, GENERIC)).select("user_id", "src", "label", "dst").distinct()
    x, y = (facts.where(F.col("user_id") == u).drop("user_id") for u in (a, b))
    return x.exceptAll(y).withColumn("only", F.lit(a)).unionByName(y.exceptAll(x).withColumn("only", F.lit(b)))


def shared_beliefs(relations: DataFrame, users: list[str]) -> DataFrame:
    facts = relations.where(~F.col("label").isin(*STRUCTURAL, GENERIC) & F.col("user_id").isin(*users))
    return facts.groupBy("src", "label", "dst").agg(F.count_distinct("user_id").alias("n")).where(F.col("n") == len(set(users))).drop("n")


def pca(vectors: DataFrame, k: int = 3) -> DataFrame:
    """vectors (id, embedding) with their k principal components."""
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector, vector_to_array

    rows = vectors.select("id", array_to_vector(F.col("embedding").cast("array<double>")).alias("v"))
    return PCA(k=k, inputCol="v", outputCol="p").fit(rows).transform(rows).select("id", vector_to_array("p").alias("components"))

