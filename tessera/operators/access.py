"""Access control over resources, grants and principals."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.lineage import if_small, met_by_key, met_in_blocks, written

#: What each permission implies.
IMPLIED = {"READ": ("READ", "WRITE", "MANAGE"), "WRITE": ("WRITE", "MANAGE"), "MANAGE": ("MANAGE",)}
#: Pairs of principals and resources that one task may have to give, at most.
PAIRS_OF_A_TASK = 20_000_000


def allowed_resources(resources: DataFrame, grants: DataFrame, principals: DataFrame, required: str = "READ") -> DataFrame:
    """user_id, resource_id: resources (resource_id, tenant, owner, visibility, department, deleted) that principals (user_id, tenant, role, department) may use; once for each row of both.

    Only live ones of the principal's tenant (a system_admin sees all tenants). Then: admins of the tenant, the owner, a grant to the user, the role or the
    department whose permission implies the required one, and for READ the visibility TENANT, or DEPARTMENT of one's own. A system_admin's answer is all live resources: such users, who are few, meet them in counted blocks.

    The answer may hold most pairs, so it is neither shuffled nor made distinct: a resource names each way in once (all, its roles, its departments, single users), principals meet it by equal
    keys, and who comes in by an earlier way is left out of the later ones. Roles and departments of a resource are at most those of the principals.
    """
    everywhere = F.coalesce(F.col("role") == "system_admin", F.lit(False))
    who = principals.select("user_id", "tenant", "role", F.col("department").cast("string").alias("department"))
    live = resources.filter("deleted = 0").select("resource_id", F.col("tenant").alias("_t"), "owner", "visibility", F.col("department").cast("string").alias("_d"))
    p = written(who.filter(~everywhere))
    ways = F.array(*[F.struct(F.lit(kind).alias("kind"), name.alias("name")) for kind, name in (("ALL", F.lit("")), ("ROLE", F.col("role")), ("DEPARTMENT", F.col("department")))])
    subjects = p.select("user_id", F.col("tenant").alias("_t"), "role", F.inline(ways)).filter("name is not null")

    known = written(subjects.select("kind", "name").unionByName(p.select(F.lit("USER").alias("kind"), F.col("user_id").cast("string").alias("name"))).distinct())
    implied = grants.filter((F.col("deleted") == 0) & F.col("permission").isin(*IMPLIED[required])).select("resource_id", F.col("subject_type").alias("kind"), F.col("subject_id").alias("name"))
    granted = implied.join(if_small(known), ["kind", "name"], "left_semi")
    named = lambda kind: F.collect_set(F.when(F.col("kind") == kind, F.col("name")))
    wide = granted.filter("kind in ('ROLE', 'DEPARTMENT')").groupBy("resource_id").agg(named("ROLE").alias("roles"), named("DEPARTMENT").alias("departments"))
    none = F.array().cast("array<string>")
    reads = F.lit(required == "READ")
    own = F.when(reads & (F.col("visibility") == "DEPARTMENT") & F.col("_d").isNotNull(), F.array("_d")).otherwise(none)
    open_to = live.join(wide, "resource_id", "left").select(
        "resource_id", "_t", "owner", F.coalesce(reads & (F.col("visibility") == "TENANT"), F.lit(False)).alias("everyone"),
        F.array_union(F.coalesce("roles", none), F.array(F.lit("admin"), F.lit("tenant_admin"))).alias("roles"), F.array_union(F.coalesce("departments", none), own).alias("departments"),
    )
    open_to = written(open_to.repartition(max(live.sparkSession.sparkContext.defaultParallelism, live.count() * p.count() // PAIRS_OF_A_TASK)))

    entries = lambda kind, names: F.transform(names, lambda x: F.struct(F.lit(kind).alias("kind"), x.alias("name")))
    keys = F.when(F.col("everyone"), entries("ALL", F.array(F.lit("")))).otherwise(F.concat(entries("ROLE", F.col("roles")), entries("DEPARTMENT", F.col("departments"))))
    by_role = F.coalesce(F.array_contains("roles", F.col("role")), F.lit(False))
    met = met_by_key(subjects, open_to.select("resource_id", "_t", "roles", F.inline(keys)), ["_t", "kind", "name"], block=200_000).filter((F.col("kind") != "DEPARTMENT") | ~by_role)

    alone = ~(F.col("everyone") | by_role | F.coalesce(F.array_contains("departments", F.col("department")), F.lit(False)))
    same = F.col("tenant") == F.col("_t")
    owned = open_to.join(if_small(p), same & (F.col("user_id") == F.col("owner"))).filter(alone)
    single = granted.filter("kind = 'USER'").select("resource_id", "name").distinct().join(if_small(p), F.col("user_id").cast("string") == F.col("name"))
    single = single.join(open_to, "resource_id").filter(same & alone & ~F.coalesce(F.col("user_id") == F.col("owner"), F.lit(False)))
    all_of = [met_in_blocks(who.filter(everywhere), live), met, owned, single]
    return reduce(DataFrame.union, [w.select("user_id", "resource_id") for w in all_of])


def authorized_hits(hits: DataFrame, allowed: DataFrame) -> DataFrame:
    """Hits (user_id, resource_id, ..) whose resource the user may use; anything unknown goes. The order is in the hits' own rank column."""
    return hits.join(allowed, ["user_id", "resource_id"], "left_semi")
