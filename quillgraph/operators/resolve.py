"""Which surface forms are one entity: blocking by name keys, pairwise rules, then groups with the first form as canonical."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgraph.functions import names
from quillgraph.operators.graph import components
from quillgraph.operators.lineage import cut


#: counters of words by hash; a counter that several words share only makes the choice of a rare word less good
COUNTERS = 1 << 18


def tasks(df: DataFrame) -> int:
    """Tasks for names' rules: their rows are few bytes, but much work, which adaptive plans would leave to one task."""
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), df.sparkSession.sparkContext.defaultParallelism)


def classes(surfaces: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(id, node) of all surfaces, and a row per node, the class of names that no rule tells apart, with its number (n)
    and its keys.

    A form without any word has no node; it matches nothing.
    """
    once = surfaces.select("label", "type").repartition(tasks(surfaces), "label", "type").distinct()
    labels = once.select("label", "type", F.explode(F.array(names.name_classes("label", "type"))).alias("c"))  # computed once, then filtered
    labels = cut(labels.where("c.node is not null").select("label", "type", "c.*"))
    of = labels.select(F.col("label").alias("l"), F.col("type").alias("t"), "node")
    own = surfaces.join(of, F.col("label").eqNullSafe(F.col("l")) & F.col("type").eqNullSafe(F.col("t"))).select("id", "node").distinct()
    first = F.min_by(F.struct("label", "type", "looks", "index", "near", "far", "texts", "few", "many"), F.struct("label", "type"))
    return cut(own), cut(labels.groupBy("node").agg(first.alias("x")).select(F.monotonically_increasing_id().alias("n"), "node", "x.*"))


def contained(inner: DataFrame, outer: DataFrame) -> DataFrame:
    """(inner, outer) numbers of nodes where a rare word of one is among the other's: all that can hold all its words.

    Words are counted by hash, so that a word of most names is never brought together in one task.
    """
    counter = lambda rows: rows.withColumn("c", F.pmod(F.xxhash64("word"), F.lit(COUNTERS)))
    words = counter(outer.select(F.col("n").alias("outer"), F.explode("many").alias("word")))
    often = words.groupBy("c").agg(F.count("*").alias("often"))
    few = counter(inner.select(F.col("n").alias("inner"), F.explode("few").alias("word"))).join(F.broadcast(often), "c", "left")
    rare = few.groupBy("inner").agg(F.min_by(F.struct("word", "c"), F.struct(F.coalesce("often", F.lit(0)), "word")).alias("x")).select("inner", "x.*")
    asked = words.join(F.broadcast(rare.select("c").distinct()), "c", "left_semi")
    return rare.select("inner", "word").join(asked.select("outer", "word"), "word").select("inner", "outer")


def cuts(nodes: DataFrame, name: str) -> DataFrame:
    """(name, k): hashes of nodes' texts, whole and without each of their characters. Texts within one edit of each other
    have one in common."""
    each = F.expr("transform(sequence(0, length(text)), i -> xxhash64(concat(left(text, i), substring(text, i + 2))))")
    return nodes.select(F.col("n").alias(name), F.explode("texts").alias("text")).select(name, F.explode(each).alias("k"))


def links(a: DataFrame, b: DataFrame, least: float) -> DataFrame:
    """(a, b, score, reason, na, nb) of different nodes, and their numbers, that share a blocking key and match.

    Each rule finds its pairs by keys of its own, so a blocking key that many nodes share costs no more than the
    pairs that come out. What the keys give too much is judged and dropped.
    """
    near = a.select(F.col("n").alias("na"), F.explode("near").alias("k")).select("na", F.xxhash64("k").alias("k"))
    far = b.select(F.col("n").alias("nb"), F.explode("far").alias("k")).select("nb", F.xxhash64("k").alias("k"))
    holds = contained(a, b)
    held = holds if a is b else contained(b, a)
    other = "na != nb" if a is b else "true"
    pairs = near.join(far, "k").where(other).select("na", "nb").unionByName(cuts(a, "na").join(cuts(b, "nb"), "k").where(other).select("na", "nb"))
    pairs = pairs.unionByName(holds.toDF("na", "nb").where(other)).unionByName(held.toDF("nb", "na").where(other)).distinct()
    pairs = cut(pairs)  # the plan in two, each of which is planned again whenever a part of it is done
    x = a.select(F.col("n").alias("na"), F.col("node").alias("a"), F.col("label").alias("la"), F.col("type").alias("ta"), "looks")
    y = b.select(F.col("n").alias("nb"), F.col("node").alias("b"), F.col("label").alias("lb"), F.col("type").alias("tb"), "index")
    blocked = pairs.join(x, "na").join(y, "nb").where(F.arrays_overlap("looks", "index") & (F.col("a") != F.col("b")))
    judged = blocked.repartition(tasks(a)).select("a", "b", "na", "nb", F.explode(F.array(names.name_match("la", "ta", "lb", "tb"))).alias("m"))  # judged once, then filtered
    return judged.where((F.col("m.match")) & (F.col("m.score") >= least)).select("a", "b", "m.score", "m.reason", "na", "nb")


def with_self(found: DataFrame, nodes: DataFrame) -> DataFrame:
    """links, and each node to itself."""
    return found.drop("na", "nb").unionByName(nodes.select(F.col("node").alias("a"), F.col("node").alias("b"), F.lit(1.0).alias("score"), F.lit("equal").alias("reason")))


def matches(surfaces: DataFrame, known: DataFrame, least: float = 0.85) -> DataFrame:
    """(id, other, score, reason) of accepted pairs. surfaces and known: id, label, type."""
    (own, a), (theirs, b) = classes(surfaces), classes(known)
    found = with_self(links(a, b, least), a)
    pairs = own.withColumnRenamed("node", "a").join(found, "a").join(theirs.select(F.col("id").alias("other"), F.col("node").alias("b")), "b")
    return pairs.where("id != other").select("id", "other", "score", "reason").distinct()


def best_match(surfaces: DataFrame, known: DataFrame) -> DataFrame:
    """(id, canonical) of new surfaces that match something known; the surest match, then the smallest id."""
    (own, a), (theirs, b) = classes(surfaces), classes(known)
    # of each known class two ids are enough: the smallest that isn't the surface's own
    low = theirs.groupBy("node").agg(F.min("id").alias("low"))
    next_ = theirs.join(low, "node").where("id != low").groupBy("node").agg(F.min("id").alias("id"))
    two = low.select(F.col("node").alias("b"), F.col("low").alias("other")).unionByName(next_.select(F.col("node").alias("b"), F.col("id").alias("other")))
    pairs = own.withColumnRenamed("node", "a").join(with_self(links(a, b, 0.85), a), "a").join(two, "b").where("id != other")
    return pairs.groupBy("id").agg(F.min_by("other", F.struct(-F.col("score"), F.col("other"))).alias("canonical"))


def groups(surfaces: DataFrame) -> DataFrame:
    """(id, component) of all surfaces that have a word."""
    own, nodes = classes(surfaces)
    own = cut(own.join(nodes.select("node", "n"), "node").select("id", "n"))
    found = links(nodes, nodes, 0.85).select(F.col("na").alias("src"), F.col("nb").alias("dst"))
    # an id that comes with several names holds them together
    several = own.groupBy("id").agg(F.min("n").alias("src")).join(own, "id").where("src != n").select("src", F.col("n").alias("dst"))
    same = cut(found.unionByName(several))  # read in both directions, found once
    group = components(same.select("src", "dst", F.lit("same").alias("label"), F.lit(1.0).alias("weight")))
    return own.join(group.withColumnRenamed("node", "n"), "n", "left").select("id", F.coalesce("component", "n").alias("component")).distinct()


def canonicalise(surfaces: DataFrame) -> DataFrame:
    """surfaces (id, label, type, seq) with canonical: of each group of matching forms the first seen.

    All forms are judged in one pass; where sameness isn't transitive a group may join forms that a sequential pass
    would keep apart.
    """
    group = groups(surfaces)
    first = surfaces.join(group, "id").groupBy("component").agg(F.min_by("id", F.struct("seq", "id")).alias("canonical"))
    own = group.join(first, "component").select("id", "canonical")
    return surfaces.join(own, "id", "left").withColumn("canonical", F.coalesce("canonical", "id"))


def upgrade_labels(surfaces: DataFrame) -> DataFrame:
    """(canonical, label, aliases): the longest form is an entity's label, ties by the first seen."""
    return surfaces.groupBy("canonical").agg(F.min_by("label", F.struct(-F.length("label"), F.col("seq"))).alias("label"), F.array_sort(F.collect_set("label")).alias("aliases"))


def dedupe(entities: DataFrame, degrees: DataFrame) -> DataFrame:
    """(loser, winner) of entities that match: of each group the one with the highest degree, then the smallest id."""
    group = groups(entities).withColumnRenamed("id", "node")
    group = group.join(degrees.select("node", "degree"), "node", "left").withColumn("degree", F.coalesce("degree", F.lit(0)))
    best = group.groupBy("component").agg(F.min_by("node", F.struct(-F.col("degree"), F.col("node"))).alias("winner"))
    return group.join(best, "component").where("node != winner").select(F.col("node").alias("loser"), "winner")
