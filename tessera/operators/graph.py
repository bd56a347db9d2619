"""Entity graphs on node and edge tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.lineage import if_small, met_in_blocks, written


def cooccurrences(mentions: DataFrame, group: str, name: str, place: str, most: int = 8) -> DataFrame:
    """src, dst, n: pairs of the first `most` names of each group (src < dst), with the number of groups that have them. At most most * (most - 1) / 2 rows a group."""
    first = Window.partitionBy(group).orderBy(place)
    few = mentions.withColumn("_r", F.row_number().over(first)).filter(F.col("_r") <= most)
    a, b = few.select(group, F.col(name).alias("src")), few.select(group, F.col(name).alias("dst"))
    return a.join(b, group).filter("src < dst").groupBy("src", "dst").agg(F.count_distinct(group).alias("n"))


def updated_cooccurrences(edges: DataFrame, before: DataFrame, after: DataFrame, group: str, name: str, place: str, most: int = 8) -> DataFrame:
    """cooccurrences() of all mentions, from those that were there (edges: src, dst, n) and from the mentions of the groups that changed, before and after the change: a pair's number is a sum over groups, so what they
    add and take away is enough. Work grows with the changed groups; pairs that don't change aren't computed again."""
    count = lambda rows, sign: cooccurrences(rows, group, name, place, most).select("src", "dst", (F.col("n") * sign).alias("n"))
    change = written(count(after, 1).unionByName(count(before, -1)).groupBy("src", "dst").agg(F.sum("n").alias("_d")).filter("_d <> 0"))
    small = if_small(change)
    same = edges.join(small, ["src", "dst"], "left_anti").select("src", "dst", "n")
    moved = change.join(edges.join(small.select("src", "dst"), ["src", "dst"], "left_semi"), ["src", "dst"], "left").select("src", "dst", (F.coalesce("n", F.lit(0)) + F.col("_d")).alias("n"))
    return same.unionByName(moved.filter("n > 0"))


def first_nodes(nodes: DataFrame, order: list, most: int) -> DataFrame:
    """The first `most` nodes with rank and truncated: whether there are more. One node more is looked at for that."""
    few = nodes.orderBy(*order).limit(most + 1).withColumn("rank", F.row_number().over(Window.orderBy(*order)))  # at most `most` + 1 rows
    return few.withColumn("truncated", F.max("rank").over(Window.partitionBy()) > most).filter(F.col("rank") <= most)


def undirected(edges: DataFrame) -> DataFrame:
    return edges.select("src", "dst").union(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()


def within_hops(edges: DataFrame, starts: DataFrame, depth: int) -> DataFrame:
    """start, node, hops: nodes at most `depth` edges (src, dst; either way) from each start (start), itself excluded, with the least number of edges.

    One join a hop; each hop goes on only from nodes that were not met before.
    """
    both = undirected(edges)
    seen = starts.select("start", F.col("start").alias("node"), F.lit(0).alias("hops"))
    rim = seen
    for hop in range(1, depth + 1):
        stepped = rim.join(both, rim["node"] == both["src"]).select("start", F.col("dst").alias("node")).distinct()
        rim = stepped.join(seen.select("start", "node"), ["start", "node"], "left_anti").withColumn("hops", F.lit(hop))
        seen = seen.unionByName(rim)
    return seen.filter("hops > 0")


def expandable(edges: DataFrame, visible: DataFrame) -> DataFrame:
    """node, expandable: whether a visible node (node) has a neighbour that isn't visible."""
    both = undirected(edges)
    hidden = both.join(visible.select(F.col("node").alias("dst")), "dst", "left_anti").select(F.col("src").alias("node")).distinct().withColumn("_x", F.lit(True))
    return visible.join(hidden, "node", "left").select("node", F.coalesce("_x", F.lit(False)).alias("expandable"))


def degrees(edges: DataFrame) -> DataFrame:
    return undirected(edges).groupBy(F.col("src").alias("node")).agg(F.count("*").alias("degree"))


def bridges(nodes: DataFrame, degree: DataFrame) -> DataFrame:
    """tenant, name, kb_a, kb_b, a, b: for each name the node with the highest degree (ties: smallest id) of each knowledge base, and all pairs of bases.

    nodes: id, tenant, name, kb. Pairs are of bases, not of nodes; a name has as many representatives as bases.
    """
    ranked = nodes.join(degree.withColumnRenamed("node", "id"), "id", "left").withColumn("_r", F.row_number().over(Window.partitionBy("tenant", "name", "kb").orderBy(F.desc(F.coalesce("degree", F.lit(0))), "id")))
    best = ranked.filter("_r = 1")
    a = best.select("tenant", "name", F.col("kb").alias("kb_a"), F.col("id").alias("a"))
    b = best.select("tenant", "name", F.col("kb").alias("kb_b"), F.col("id").alias("b"))
    return a.join(b, ["tenant", "name"]).filter("kb_a < kb_b")


def top_per_type(nodes: DataFrame, kind: str, order: list, most: int) -> DataFrame:
    """nodes with rank and total of their type; the first `most` of each."""
    counts = nodes.groupBy(kind).agg(F.count("*").alias("total"))
    ranked = nodes.withColumn("rank", F.row_number().over(Window.partitionBy(kind).orderBy(*order))).filter(F.col("rank") <= most)
    return ranked.join(counts, kind)


def merged_edges(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """src, dst, relation, weight of both, the existing one where both have an edge."""
    new = incoming.join(existing.select("src", "dst", "relation"), ["src", "dst", "relation"], "left_anti")
    return existing.unionByName(new.select(*existing.columns))


def overview(edges: DataFrame, groups: DataFrame) -> DataFrame:
    """g1, g2, edges, cross: edges between groups of nodes (node, kb, kind), within groups left out; cross: whether any crosses knowledge bases."""
    a = groups.select(F.col("node").alias("src"), F.struct("kb", "kind").alias("_a"))
    b = groups.select(F.col("node").alias("dst"), F.struct("kb", "kind").alias("_b"))
    named = edges.join(a, "src").join(b, "dst").filter("_a <> _b")
    label = lambda c: F.concat_ws("/", f"{c}.kb", f"{c}.kind")
    pairs = named.select(F.least(label("_a"), label("_b")).alias("g1"), F.greatest(label("_a"), label("_b")).alias("g2"), (F.col("_a.kb") != F.col("_b.kb")).alias("x"))
    return pairs.groupBy("g1", "g2").agg(F.count("*").alias("edges"), F.bool_or("x").alias("cross"))


def paths(nodes: DataFrame) -> DataFrame:
    """id, path, depth: names from the root, joined by ' > ', of nodes (id, parent, name). A node without a parent, or whose parent isn't in the table, is a root; nodes of
    cycles, and below them, have no path. One join a level, however many there are; each level is written, so none is computed twice."""
    kids = written(nodes.filter("parent is not null").select("id", "parent", "name"))
    placed = nodes.join(nodes.select(F.col("id").alias("parent")).distinct(), "parent", "left_anti")
    out = rim = written(placed.select("id", F.col("name").alias("path"), F.lit(0).alias("depth")))
    while not rim.isEmpty():
        up = rim.select(F.col("id").alias("parent"), F.col("path").alias("_p"), F.col("depth").alias("_d"))
        rim = written(kids.join(up, "parent").select("id", F.concat_ws(" > ", "_p", "name").alias("path"), (F.col("_d") + 1).alias("depth")))
        out = out.unionByName(rim)
    return out


def recall_paths(edges: DataFrame, nodes: DataFrame, questions: DataFrame, most: int = 4) -> DataFrame:
    """query_id, place, src, dst: the first `most` edges of a breadth-first tree for each question (query_id, text). It starts at the node (node, name) with the longest name that the
    question holds (ties: the smaller id), else at the one of the highest degree; neighbours are met in the order of their ids.

    At most `most` nodes a question are gone on from at each hop, and at most `most` hops are made."""
    both = written(undirected(edges))
    named = met_in_blocks(questions.select("query_id", F.lower("text").alias("_t")), nodes).filter(F.contains("_t", F.lower("name")) & (F.char_length("name") > 0))
    best = named.withColumn("_r", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc(F.char_length("name")), "node"))).filter("_r = 1").select("query_id", "node")
    hub = both.groupBy(F.col("src").alias("_hub")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "_hub").limit(1).select("_hub")
    seeds = questions.select("query_id").join(best, "query_id", "left").join(F.broadcast(hub), F.lit(True), "left").select("query_id", F.coalesce("node", "_hub").alias("node")).filter("node is not null")
    seen = written(seeds.select("query_id", "node", F.lit(0).alias("place"), F.lit(None).cast(edges.schema["src"].dataType).alias("src")))
    rim = seen
    for _ in range(most):
        met = rim.select("query_id", F.col("node").alias("src"), "place").join(both, "src").join(seen.select("query_id", F.col("node").alias("dst")), ["query_id", "dst"], "left_anti")
        first = met.groupBy("query_id", F.col("dst").alias("node")).agg(F.min(F.struct("place", "src")).alias("_m"))
        count = seen.groupBy("query_id").agg(F.max("place").alias("_n"))
        order = Window.partitionBy("query_id").orderBy("_m.place", "node")
        rim = first.withColumn("_r", F.row_number().over(order)).filter(F.col("_r") <= most).join(count, "query_id").withColumn("place", F.col("_n") + F.col("_r")).filter(F.col("place") <= most)
        rim = written(rim.select("query_id", "node", "place", F.col("_m.src").alias("src")))
        seen = written(seen.unionByName(rim))
    return seen.filter("place > 0").select("query_id", "place", "src", F.col("node").alias("dst"))


def induced(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges both of whose ends are among the nodes (node)."""
    return edges.join(nodes.select(F.col("node").alias("src")), "src", "left_semi").join(nodes.select(F.col("node").alias("dst")), "dst", "left_semi").select("src", "dst")


def mentioned_chunks(questions: DataFrame, entities: DataFrame, k: int) -> DataFrame:
    """query_id, chunk_id, name, score, rank: chunks of entities (name, description, chunk_id) that hold a term of a question (query_id, terms) in their name (100) or else in their
    description (72). The best k entities of a question are taken (ties: the shorter name), then each of their chunks once, as long as any stay.

    The questions are a stated set and meet all entities; each task keeps k rows a question before the shuffle."""
    held = lambda c: F.exists("terms", lambda t: F.contains(F.lower(c), t))
    met = met_in_blocks(questions.select("query_id", "terms"), entities).withColumn("score", F.when(held("name"), 100).when(held("description"), 72)).filter("score is not null")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), F.char_length("name"), "name", "chunk_id")
    top = met.withColumn("_r", F.row_number().over(best)).filter(F.col("_r") <= max(1, min(k, 50)))
    once = top.withColumn("_c", F.row_number().over(Window.partitionBy("query_id", "chunk_id").orderBy("_r"))).filter("_c = 1")
    return once.select("query_id", "chunk_id", "name", "score", F.row_number().over(Window.partitionBy("query_id").orderBy("_r")).alias("rank"))
