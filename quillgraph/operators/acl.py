"""Who may see which record. Every path to access is a join; their union is the only way to rows of others.

Tables: principals (id, coll, user_id, org_id, file_key), edges (src, dst, label), records. Grants run from a
principal to a record or record group, membership from a user to a group or from a record to its record group,
inheritance from a record or group to the group that it inherits from.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgraph.operators.lineage import cut

COMPLETED = "COMPLETED"
GROUPS = ("groups", "organizations", "roles", "teams")
#: parts of a class's records that are written out for its members apart from each other
SALTS = 32


def principals_of(users: DataFrame, edges: DataFrame, principals: DataFrame) -> DataFrame:
    """(user_id, principal): the user, groups it belongs to, and group-like principals granted to it."""
    own = users.select("user_id", F.col("user_id").alias("principal"))
    belongs = edges.where("label = 'belongsTo'").join(users, F.col("src") == F.col("user_id")).select("user_id", F.col("dst").alias("principal"))
    groups = principals.where(F.col("coll").isin(*GROUPS)).select(F.col("id").alias("dst"))
    granted = edges.where("label = 'permissions'").join(groups, "dst", "left_semi").join(users, F.col("src") == F.col("user_id")).select("user_id", F.col("dst").alias("principal"))
    return own.unionByName(belongs).unionByName(granted).distinct()


def descend(edges: DataFrame, roots: DataFrame, depth: int = 64) -> DataFrame:
    """(user_id, id) of everything that inherits from the roots, over any number of steps up to depth; cycles end.

    Each round joins only what the round before found, against what is known (an anti join).
    """
    down = edges.where("label = 'inheritPermissions'").select("src", "dst")
    step = roots.join(down, F.col("id") == F.col("dst")).select("user_id", F.col("src").alias("id")).distinct()
    known = None
    for _ in range(depth):
        step = cut(step)
        if step.isEmpty():
            break
        known = step if known is None else known.unionByName(step)
        step = step.join(down, F.col("id") == F.col("dst")).select("user_id", F.col("src").alias("id")).distinct().join(known, ["user_id", "id"], "left_anti")
    return known if known is not None else step


def accessible(users: DataFrame, principals: DataFrame, edges: DataFrame, records: DataFrame, apps: list[str] | None = None, groups: list[str] | None = None) -> DataFrame:
    """(user_id, virtual_record_id, record_id): one row per user and virtual record; of several records behind one
    the path decides (own grants, inherited, knowledge base, anyone), then the smallest id.

    users: user_id, org_id; users that aren't among the principals see nothing. apps: connector ids of direct and
    inherited records; groups: record groups. Records that aren't indexed are never accessible.

    Access is that of classes; its rows meet the members in SALTS parts of each class, where they are written out.
    """
    seen, members = accessible_to_classes(users, principals, edges, records, apps, groups)
    salted = seen.withColumn("salt", F.pmod(F.xxhash64("virtual_record_id"), F.lit(SALTS)))
    every = members.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    return salted.join(every, ["class", "salt"]).select("user_id", "virtual_record_id", "record_id")


def classes_of(known: DataFrame, mine: DataFrame, edges: DataFrame) -> DataFrame:
    """(user_id, class): users of the same organisations with the same principals, of those that grant anything, see the
    same records. A class is named by its smallest user."""
    granting = edges.where("label = 'permissions'").select(F.col("src").alias("principal")).distinct()
    held = mine.join(granting, "principal", "left_semi").groupBy("user_id").agg(F.array_sort(F.collect_set("principal")).alias("held"))
    orgs = known.groupBy("user_id").agg(F.array_sort(F.collect_set("org_id")).alias("orgs"))
    sets = orgs.join(held, "user_id", "left").withColumn("held", F.coalesce("held", F.array().cast("array<string>")))
    first = sets.groupBy("orgs", "held").agg(F.min("user_id").alias("class"))
    return cut(sets.join(first, ["orgs", "held"]).select("user_id", "class"))


def accessible_to_classes(users: DataFrame, principals: DataFrame, edges: DataFrame, records: DataFrame, apps: list[str] | None = None, groups: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(class, virtual_record_id, record_id) and the classes' members (user_id, class), as accessible() has them."""
    known = users.join(principals.where("coll = 'users'").select("user_id"), "user_id", "left_semi")
    done = records.where(F.col("indexing_status") == COMPLETED).select("record_id", "virtual_record_id", "connector_id", "origin")
    via_app = done.where(F.col("connector_id").isin(*apps)) if apps else done
    mine = principals_of(known.select("user_id"), edges, principals)
    members = classes_of(known, mine, edges)
    first = members.where("user_id = class").select("user_id")  # one of each class stands for all
    known, mine = known.join(first, "user_id", "left_semi"), mine.join(first, "user_id", "left_semi")
    grants = edges.where("label = 'permissions'").select(F.col("src").alias("principal"), "dst").join(mine, "principal").select("user_id", F.col("dst").alias("id")).distinct()
    pick = lambda who, what, n: who.join(what, F.col("id") == F.col("record_id")).select("user_id", "virtual_record_id", "record_id", F.lit(n).alias("path"))
    direct = pick(grants, via_app, 0)
    heads = principals.where("coll = 'recordGroups'").select("id")
    if groups:
        heads = heads.where(F.col("id").isin(*groups))
    held = grants.join(heads, "id", "left_semi")
    inherited = pick(descend(edges, held), via_app, 1)
    in_base = edges.where("label = 'belongsTo'").join(held, F.col("dst") == F.col("id")).select("user_id", F.col("src").alias("id"))
    base = pick(in_base, done.where("origin = 'UPLOAD'"), 2)
    open_to = principals.where("coll = 'anyone'").select("org_id", F.col("file_key").alias("id"))
    anyone = pick(known.join(open_to, "org_id").select("user_id", "id"), done, 3)
    every = direct.unionByName(inherited).unionByName(base).unionByName(anyone)
    best = F.min_by("record_id", F.struct("path", "record_id")).alias("record_id")
    return every.groupBy(F.col("user_id").alias("class"), "virtual_record_id").agg(best), members


def can_access(acl: DataFrame, wanted: DataFrame) -> DataFrame:
    """wanted (user_id, virtual_record_id) with a boolean column allowed."""
    return wanted.join(acl.select("user_id", "virtual_record_id", F.lit(True).alias("allowed")), ["user_id", "virtual_record_id"], "left").withColumn("allowed", F.coalesce("allowed", F.lit(False)))


def visible_edges(edges: DataFrame, acl: DataFrame, carry: tuple[str, ...] | None = None) -> DataFrame:
    """(user_id, edge columns) of edges that an accessible record asserts; without provenance nothing is visible.

    Where an edge stands once (as folded) and only some columns besides src, dst and label are wanted, small ones, they
    are carried along, and edges aren't computed and joined a second time.
    """
    key = ["src", "dst", "label"]
    cut = edges.select(*key, *(carry or ()), F.explode("provenance").alias("record_id"))
    seen = cut.join(acl.select("user_id", "record_id"), "record_id")
    if carry is not None:
        return seen.groupBy("user_id", *key).agg(*[F.first(c).alias(c) for c in carry]) if carry else seen.select("user_id", *key).distinct()
    return seen.select("user_id", *key).distinct().join(edges, key)


def filter_facets(records: DataFrame, facets: DataFrame, wanted: dict[str, list[str]]) -> DataFrame:
    """Records that have one of the wanted values of every facet. facets: record_id, facet, value."""
    for facet, values in wanted.items():
        records = records.join(facets.where((F.col("facet") == facet) & F.col("value").isin(*values)), "record_id", "left_semi")
    return records


def authorize(requests: DataFrame, principals: DataFrame, edges: DataFrame) -> DataFrame:
    """requests (request_id, user_id, org_id, action, owner_id, grants array<string>, share_with_org) with allowed and
    reason. Viewers don't create; only admins and owners modify; grants stay among oneself, own groups and the org."""
    roles = principals.where("coll = 'users'").select("user_id", F.coalesce("role", F.lit("viewer")).alias("role"))
    member = edges.where("label = 'belongsTo'").select("src", "dst")
    asked = requests.join(roles, "user_id", "left").withColumn("role", F.coalesce("role", F.lit("viewer")))
    each = asked.select("request_id", "user_id", "org_id", F.explode("grants").alias("p"))
    mine = each.join(member.select(F.col("src").alias("user_id"), F.col("dst").alias("p"), F.lit(1).alias("own")).distinct(), ["user_id", "p"], "left")
    same = mine.join(member.select(F.col("src").alias("p"), F.col("dst").alias("org_id"), F.lit(1).alias("in_org")).distinct(), ["p", "org_id"], "left")
    bad = same.where((F.col("p") != F.col("user_id")) & (F.col("p") != F.col("org_id")) & F.col("own").isNull() & F.col("in_org").isNull()).select("request_id").distinct().withColumn("outside", F.lit(True))
    reason = (
        F.when((F.col("action") == "create") & (F.col("role") == "viewer"), "viewers don't create")
        .when(F.col("action").isin("modify", "delete") & (F.col("role") != "admin") & ~F.coalesce(F.col("owner_id") == F.col("user_id"), F.lit(False)), "neither owner nor admin")
        .when((F.col("role") != "admin") & F.coalesce(F.col("share_with_org") != F.col("org_id"), F.lit(False)), "shares outside of the organisation")
        .when((F.col("role") != "admin") & F.col("outside"), "grants outside of its scope")
    )
    return asked.join(bad, "request_id", "left").select("request_id", "user_id", "action", reason.isNull().alias("allowed"), reason.alias("reason"))
