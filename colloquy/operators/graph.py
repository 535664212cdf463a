"""Edges between messages, conversations and entities, and measures over them."""

from __future__ import annotations

import functools
import re
import tempfile

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..sources.shared import written
from .nearest import nearest
from .retrieve import top_k

#: Pairs that one task counts.
DEALT = 1_000_000
#: Pairs that are counted in a round, if there are more.
ROUND = 250_000_000


def _checkpointed(df: DataFrame) -> DataFrame:
    """Cut lineage by a checkpoint in the cluster's shared folder; a temporary one in local mode alone, where none is set."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        shared = sc.getConf().get("spark.checkpoint.dir")
        if not shared and not re.match(r"local(\[|$)", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(shared or tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
    return df.checkpoint()


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, component) of all ids in undirected edges, component the smallest id reachable.

    Stars by turns: every id's larger neighbours are linked to the least id of its neighbourhood, then every id and its
    smaller neighbours are; edges become stars around the least ids in few rounds, for long chains and cycles, too. A hot
    id is a skewed partition of a merge join, which Spark splits as it runs.
    """
    turned = lambda u, v: (F.greatest(u, v).alias("u"), F.least(u, v).alias("v"))
    now = _checkpointed(edges.select(*turned(F.col(a), F.col(b))).filter("u <> v").distinct())
    ids = edges.select(F.col(a).alias("id")).union(edges.select(b)).distinct()
    mark = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
    while True:
        both = now.union(now.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(least.hint("merge"), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least.hint("merge"), "u").select("v", "m").union(least.select("u", "m"))
        now = _checkpointed(small.select(*turned(F.col("v"), F.col("m"))).filter("u <> v").distinct())
        was, mark = mark, now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
        if was == mark:
            return ids.join(now.hint("merge"), F.col("id") == F.col("u"), "left").select("id", F.coalesce("v", "id").alias("component"))


def pairs_within(rows: DataFrame, group: str, item: str, crowd: int = 500, parts: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(group, a, b) with a < b of items in the same group, and the groups of over ``crowd`` items (group, n), whose
    pairs are dealt over blocks of partners rather than made in one task. ``parts``: the number of tasks, if not Spark's own."""
    dealt = lambda df, *by: df if parts is None else df.repartition(parts, *by)
    own = dealt(rows.select(group, item), group).distinct()
    sizes = own.groupBy(group).agg(F.count("*").alias("n"))
    left = own.join(sizes.hint("merge"), group).withColumn("block", F.explode(F.sequence(F.lit(0), F.floor((F.col("n") - 1) / crowd)))).select(group, F.col(item).alias("a"), "block")
    left = dealt(left, group, "block")
    right = own.join(sizes.hint("merge"), group).withColumn("block", F.pmod(F.xxhash64(item), F.floor((F.col("n") - 1) / crowd) + 1)).select(group, F.col(item).alias("b"), "block")
    right = dealt(right, group, "block")
    return left.join(right.hint("merge"), [group, "block"]).filter("a < b").select(group, "a", "b"), sizes.filter(F.col("n") > crowd)


def paired(rows: DataFrame, group: str, item: str, crowd: int = 500) -> DataFrame:
    """Lists (x, y, same) whose pairs (an item of x, a larger one of y) are those of items in the same group: a group's items in
    order, and those of a group of over ``crowd`` in blocks, of which each meets each. ``rows`` hold an item of a group once."""
    rows = rows.filter(F.col(group).isNotNull() & F.col(item).isNotNull())
    blocks = rows.groupBy(group).agg((F.floor((F.count("*") - 1) / crowd) + 1).alias("blocks"))
    own = rows.join(blocks.hint("merge"), group).withColumn("block", F.pmod(F.xxhash64(item), F.col("blocks")))
    lists = written(own.groupBy(group, "block", "blocks").agg(F.sort_array(F.collect_list(item)).alias("x")), "lists")
    more = lists.filter("blocks > 1")
    other = more.select(group, F.col("block").alias("to"), F.col("x").alias("y"))
    met = more.join(other.hint("merge"), group).filter("block <> to").select("x", "y", F.lit(False).alias("same"))
    return lists.select("x", F.col("x").alias("y"), F.lit(True).alias("same")).union(written(met, "met"))


def dealt_pairs(rows: DataFrame, group: str, item: str) -> DataFrame:
    """The pairs (a, b), a < b, of items in the same group, equal ones in one task, in as many tasks as their number asks for.
    They are dealt out before they are counted, so what a task holds does not grow with the table."""
    return _dealt_rounds(rows, group, item, None)[0]


def _dealt_rounds(rows: DataFrame, group: str, item: str, most: int | None) -> list[DataFrame]:
    """The pairs of ``dealt_pairs`` in tables of about ``most`` pairs, by their first items; in one table if that is None."""
    own = written(rows.select(group, item).distinct(), "items")
    n = int(own.groupBy(group).count().agg(F.sum(F.greatest(F.col("count"), F.col("count") * (F.col("count") - 1) / 2))).first()[0] or 0)
    rounds = 1 if most is None else n // most + 1
    parts = max(rows.sparkSession.sparkContext.defaultParallelism, n // rounds // DEALT + 1)
    lists = paired(own, group, item)

    def dealt(turn: int) -> DataFrame:
        each = lists.select(F.posexplode("x").alias("i", "a"), "y", "same")
        each = each if rounds == 1 else each.filter(F.pmod(F.xxhash64("a"), F.lit(rounds)) == turn)
        rest = F.when(F.col("same"), F.slice("y", F.col("i") + 2, F.size("y"))).otherwise(F.col("y"))
        return each.select("a", F.explode(rest).alias("b")).filter("a < b").repartition(parts, "a", "b")

    return [dealt(turn) for turn in range(rounds)]


def cooccurrence(mentions: DataFrame, scope: str, least: int = 2) -> DataFrame:
    """(a, b, weight) of entities that share ``least`` distinct messages or conversations (``scope``).

    Many pairs are counted in rounds, one after another, each with the pairs of some entities; a round leaves only the edges
    behind, so the disk that pairs take does not grow with the table.
    """
    rounds = _dealt_rounds(mentions, scope, "entity_id", ROUND)
    counted = [pairs.groupBy("a", "b").agg(F.count("*").alias("weight")).filter(F.col("weight") >= least) for pairs in rounds]
    return counted[0] if len(counted) == 1 else functools.reduce(DataFrame.union, [written(edges, "edges") for edges in counted])


def both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("a", "b", "weight").union(edges.select("b", "a", "weight"))


def neighbours(edges: DataFrame, k: int) -> DataFrame:
    """(id, other, weight, rank): each node's k strongest neighbours."""
    return top_k(both_ways(edges).toDF("id", "other", "weight"), ["id"], [F.desc("weight"), F.col("other")], k)


def conversation_similarity(points: DataFrame, least: float = 0.55, k: int = 5, candidates: int = 30) -> DataFrame:
    """(conversation_id, other, weight): mean score over the points of another conversation among the nearest
    points to the mean of a conversation's first three."""
    first = points.withColumn("_n", F.row_number().over(Window.partitionBy("conversation_id").orderBy("created_at", "point_id"))).filter("_n <= 3")
    parts = first.select("conversation_id", F.posexplode("vector").alias("i", "x")).groupBy("conversation_id", "i").agg(F.avg(F.col("x").cast("double")).alias("x"))
    mean = parts.groupBy("conversation_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("qv"))
    hits = nearest(points, mean.select(F.col("conversation_id").alias("qid"), F.col("qv").alias("vector")), candidates, skip_own=False)
    near = points.select("point_id", F.col("conversation_id").alias("other")).join(hits.hint("merge"), "point_id").withColumnRenamed("qid", "conversation_id").filter("conversation_id <> other")
    means = near.groupBy("conversation_id", "other").agg(F.avg("score").alias("weight")).filter(F.col("weight") >= least)
    return top_k(means, ["conversation_id"], [F.desc("weight"), F.col("other")], k)


def keyword_similarity(rows: DataFrame, least: float = 0.3, quality: float = 0.5) -> DataFrame:
    """(a, b, jaccard, shared) of messages (message_id, conversation_id, keywords, quality_score) of different
    conversations and of a quality over ``quality``, exact; shared: their common keywords, sorted.

    Messages meet at the keywords of their prefixes, rarest first, so that similar ones meet at the rarest keyword that
    they share; there alone the whole sets are compared. The pairs of a crowded keyword are dealt over blocks.
    """
    rows = rows.filter(F.col("quality_score") > quality)
    words = rows.select("message_id", "conversation_id", F.explode(F.array_distinct(F.array_compact("keywords"))).alias("k"))
    df = words.groupBy("k").agg(F.count("*").alias("df"))
    sets = words.join(df.hint("merge"), "k").groupBy("message_id", "conversation_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("df", "k"))), lambda s: s["k"]).alias("set"))
    n = F.size("set")
    prefix = F.slice("set", F.lit(1), (n - F.ceil(least * n - 1e-9) + 1).cast("int"))  # rounding must not shorten it
    pairs, _ = pairs_within(sets.select(F.struct("message_id", "conversation_id", "set").alias("m"), F.explode(prefix).alias("k")), "k", "m")
    pairs = pairs.filter("a.conversation_id <> b.conversation_id").withColumn("both", F.array_intersect("a.set", "b.set")).filter(F.get("both", F.lit(0)) == F.col("k"))
    shared = F.size("both")
    return pairs.select(F.col("a.message_id").alias("a"), F.col("b.message_id").alias("b"), (shared / (F.size("a.set") + F.size("b.set") - shared)).alias("jaccard"), F.sort_array("both").alias("shared")).filter(F.col("jaccard") >= least)


def project(messages: DataFrame, items: DataFrame, tasks: DataFrame, relationships: DataFrame) -> tuple[DataFrame, DataFrame]:
    """G1: nodes (label, id) and edges (src_label, src, rel, dst_label, dst) of the tables."""
    text = lambda c: F.col(c).cast("string")
    node = lambda df, label, c: df.select(F.lit(label).alias("label"), text(c).alias("id"))
    nodes = node(messages, "Message", "message_id").union(node(messages, "Conversation", "conversation_id")).union(node(items, "Item", "id")).union(node(tasks, "Task", "id")).union(node(items, "Domain", "domain"))
    edge = lambda df, a, x, rel, b, y: df.select(F.lit(a).alias("src_label"), text(x).alias("src"), F.lit(rel).alias("rel"), F.lit(b).alias("dst_label"), text(y).alias("dst")).filter("src is not null and dst is not null")
    parts = [
        edge(messages, "Message", "message_id", "BELONGS_TO", "Conversation", "conversation_id"),
        edge(follows(messages), "Message", "message_id", "FOLLOWS", "Message", "previous"),
        edge(items, "Item", "id", "IN_DOMAIN", "Domain", "domain"),
        edge(items, "Item", "id", "PART_OF", "Item", "parent_id"),
        edge(tasks, "Task", "id", "TARGETS_ITEM", "Item", "target_item_id"),
        relationships.select(F.initcap("source_type").alias("src_label"), F.col("source_id").alias("src"), F.upper("relationship_type").alias("rel"), F.initcap("target_type").alias("dst_label"), F.col("target_id").alias("dst")),
    ]
    edges = parts[0]
    for p in parts[1:]:
        edges = edges.union(p)
    return nodes.distinct(), edges.distinct()


def follows(messages: DataFrame) -> DataFrame:
    """(message_id, previous) within a conversation."""
    before = F.lag("message_id").over(Window.partitionBy("conversation_id").orderBy("sequence"))
    return messages.select("message_id", before.alias("previous")).filter("previous is not null")


def participants(messages: DataFrame, source: Column) -> DataFrame:
    """(conversation_id, speaker, rel): who takes part, by source and which side of a turn is not empty."""
    who = F.array(F.when(F.length("user_prompt") > 0, "user"), F.when(F.length("model_response") > 0, source))
    return messages.select("conversation_id", F.explode(F.filter(who, lambda x: x.isNotNull())).alias("speaker")).distinct().withColumn("rel", F.lit("PARTICIPATED_IN"))


def statistics(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(metric, name, n)."""
    return nodes.groupBy(F.lit("node").alias("metric"), F.col("label").alias("name")).agg(F.count("*").alias("n")).union(edges.groupBy(F.lit("edge"), F.col("rel")).agg(F.count("*")))


def degree(edges: DataFrame) -> DataFrame:
    """(id, degree) of an undirected graph without repeated edges."""
    return edges.select(F.col("a").alias("id")).union(edges.select("b")).groupBy("id").agg(F.count("*").alias("degree"))


def betweenness(edges: DataFrame, sources: DataFrame | None = None) -> DataFrame:
    """(id, betweenness) of an undirected, unweighted graph by Brandes' two passes, level by level for all sources.

    The frontier holds a row per (source, node); each level is one join with the edges and is checkpointed, until a
    level is empty. Edges lead at most one level on or back, so a level only has to leave out the two before it.
    ``sources`` (id) restricts the sources, e.g. to a sample of a large graph.
    """
    both = _checkpointed(edges.select("a", "b").union(edges.select("b", "a")).distinct())
    start = both.select(F.col("a").alias("id")).distinct() if sources is None else sources
    levels = [_checkpointed(start.select(F.col("id").alias("s"), F.col("id").alias("v"), F.lit(1.0).alias("sigma")))]
    while True:
        seen = levels[-1].select("s", "v")
        if len(levels) > 1:
            seen = seen.union(levels[-2].select("s", "v"))
        step = levels[-1].join(both, F.col("v") == F.col("a")).groupBy("s", F.col("b").alias("v")).agg(F.sum("sigma").alias("sigma"))
        step = _checkpointed(step.join(seen, ["s", "v"], "left_anti"))
        if not step.limit(1).count():
            break
        levels.append(step)
    delta, total = None, None
    for below, own in zip(levels[:0:-1], levels[-2::-1], strict=True):
        lower = below.withColumn("d", F.lit(0.0)) if delta is None else below.join(delta.withColumnRenamed("delta", "d"), ["s", "v"], "left").fillna(0.0, ["d"])
        lower = lower.select("s", F.col("v").alias("w"), F.col("sigma").alias("sw"), "d")
        part = own.join(both, F.col("v") == F.col("a")).join(lower, (own.s == lower.s) & (F.col("b") == F.col("w")))
        delta = _checkpointed(part.groupBy(own.s, "v").agg(F.sum(F.col("sigma") / F.col("sw") * (1 + F.col("d"))).alias("delta")))
        total = delta if total is None else total.union(delta)
    ids = both.select(F.col("a").alias("id")).distinct()
    if total is None:
        return ids.withColumn("betweenness", F.lit(0.0))
    sums = total.filter("s <> v").groupBy(F.col("v").alias("id")).agg((F.sum("delta") / 2).alias("betweenness"))
    return ids.join(sums, "id", "left").fillna(0.0, ["betweenness"])


def enrich(scores: DataFrame, mentions: DataFrame, salience: DataFrame) -> DataFrame:
    """Scores by id with the number of distinct conversations and the mean salience of their messages."""
    own = mentions.join(salience, "message_id", "left").groupBy(F.col("entity_id").alias("id")).agg(F.countDistinct("conversation_id").alias("conversations"), F.avg("salience").alias("mean_salience"))
    return scores.join(own, "id", "left")


def match_path(edges: DataFrame, rels: list[str]) -> DataFrame:
    """(n0, n1, ...): paths along edges of the given types, each edge joined to the one before."""
    path = edges.filter(F.col("rel") == rels[0]).select(F.col("src").alias("n0"), F.col("dst").alias("n1"))
    for k, rel in enumerate(rels[1:], 1):
        path = path.join(edges.filter(F.col("rel") == rel).select(F.col("src").alias(f"n{k}"), F.col("dst").alias(f"n{k + 1}")), f"n{k}")
    return path.select(*(f"n{k}" for k in range(len(rels) + 1)))


def provenance(hits: DataFrame) -> DataFrame:
    """(src, rel, dst_label, dst, score): what an answer was informed by; even collections hold messages, odd ones documents."""
    return hits.select(F.col("qid").alias("src"), F.lit("INFORMED_BY").alias("rel"), F.when(F.col("collection") == 0, "Message").otherwise("Document").alias("dst_label"), F.col("point_id").alias("dst"), "score")


def best_seeds(points: DataFrame, quality: DataFrame, k: int = 50) -> DataFrame:
    """(qid, vector, seed_conversation) of the k points of best quality (point_id, quality) among all; ties by point_id."""
    best = quality.orderBy(F.desc("quality"), "point_id").limit(k).select("point_id")
    return points.join(F.broadcast(best), "point_id").select(F.col("point_id").alias("qid"), "vector", F.col("conversation_id").alias("seed_conversation"))


def clusters(hits: DataFrame, quality: DataFrame, least: float = 0.6, smallest: int = 3, largest: int = 6, greedy: bool = True) -> DataFrame:
    """(seed, members, score): a seed's near points of other conversations, best first by mean quality * share of
    distinct conversations; with ``greedy`` no point is in two clusters that stay.

    hits: (qid, seed_conversation, point_id, conversation_id, score). The greedy rule runs in rounds: a cluster stays if
    no better one that is still open holds one of its points; those it shares points with go.
    """
    near = hits.filter((F.col("score") > least) & (F.col("conversation_id") != F.col("seed_conversation")))
    near = top_k(near.drop("rank"), ["qid"], [F.desc("score"), F.col("point_id")], largest - 1)
    rows = near.select("qid", "point_id", "conversation_id").union(near.select("qid", F.col("qid"), F.col("seed_conversation")).distinct())
    rows = rows.join(quality.select("point_id", "quality").hint("merge"), "point_id", "left")
    found = rows.groupBy(F.col("qid").alias("seed")).agg(F.sort_array(F.collect_list("point_id")).alias("members"), (F.avg("quality") * F.countDistinct("conversation_id") / F.count("*")).alias("score")).filter(F.size("members") >= smallest)
    if not greedy:
        return found
    open_, kept = _checkpointed(found.withColumn("place", F.row_number().over(Window.orderBy(F.desc("score"), "seed")))), None  # seeds are a stated, small set
    while open_.limit(1).count():
        flat = open_.select("seed", "place", F.explode("members").alias("m"))
        least_place = flat.groupBy("m").agg(F.min("place").alias("best"))
        blocked = flat.join(least_place.hint("merge"), "m").filter("place > best").select("seed").distinct()
        stay = _checkpointed(open_.join(blocked.hint("merge"), "seed", "left_anti"))
        kept = stay if kept is None else kept.union(stay)
        used = stay.select(F.explode("members").alias("m"))
        open_ = _checkpointed(open_.join(flat.join(used, "m", "left_semi").select("seed").distinct(), "seed", "left_anti"))
    return (kept if kept is not None else open_).select("seed", "members", "score")


def write_back(insights: DataFrame, items: DataFrame, least: float = 0.4, width: int = 8) -> DataFrame:
    """Insights (title, confidence) sure enough, whose first 40 characters, whatever their case, stand in no item's title yet.

    A head's first ``width`` characters are looked up among the pieces of that length of the titles, and only titles that have
    them are searched for the whole head. Insights without a title are never new.
    """
    head = F.lower(F.substring("title", 1, 40))
    own = insights.filter(F.col("confidence") >= least).withColumn("_head", head).filter(F.length("_head") > 0)
    heads = own.select("_head").distinct().withColumn("_k", F.substring("_head", 1, width))
    sizes = [r.n for r in heads.select(F.length("_k").alias("n")).distinct().collect()]  # `width` rows at most
    title = items.select(F.lower("title").alias("_t")).filter("_t is not null").distinct()

    def cut(n: int) -> Column:
        return F.transform(F.sequence(F.lit(1), F.greatest(F.length("_t") - n + 1, F.lit(1))), lambda i: F.substring(F.col("_t"), i, F.lit(n)))

    pieces = F.array_distinct(F.flatten(F.array(*map(cut, sizes or [1]))))
    met = heads.join(title.select("_t", F.explode(pieces).alias("_k")).hint("merge"), "_k").filter(F.contains("_t", F.col("_head"))).select("_head").distinct()
    return own.join(met.hint("merge"), "_head", "left_anti").drop("_head")
