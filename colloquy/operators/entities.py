"""Entity resolution, duplicates, merging, decay and linking."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.text import entity_candidates
from ..sources.shared import written
from .graph import components
from .index import Index, terms_of


def resolve(extracted: DataFrame) -> DataFrame:
    """Extracted rows (entity_type, name, description, message_id, created_at) summed up by type and normal name."""
    key = F.lower(F.trim("name")).alias("key")
    text = F.array_join(F.array_sort(F.collect_set(F.when(F.col("description") != "", F.col("description")))), " | ")
    return extracted.groupBy("entity_type", key).agg(F.min("name").alias("name"), F.min("created_at").alias("first_seen_at"), F.max("created_at").alias("last_seen_at"), F.countDistinct("message_id").alias("mention_count"), F.substring(text, 1, 2000).alias("description"))


def extraction_queue(metadata: DataFrame, extracted: DataFrame, least: float = 0.3, n: int = 20) -> DataFrame:
    """The best messages that are not extracted yet."""
    return metadata.filter(F.col("quality_score") >= least).join(extracted.select("message_id"), "message_id", "left_anti").orderBy(F.desc("quality_score"), "message_id").limit(n)


def duplicates(entities: DataFrame, exclude: DataFrame | None = None) -> DataFrame:
    """(canonical_id, duplicate_id, rule): names of one type that differ by an article, a plural or case."""
    own = entities.select("id", "entity_type", "name", "mention_count", F.lower(F.trim("name")).alias("low"))
    rules = [("article", 0, F.concat(F.lit("the "), F.col("low"))), ("plural", 1, F.concat(F.col("low"), F.lit("s"))), ("case", 2, F.col("low"))]
    found = None
    for name, place, key in rules:
        left = own.select(F.col("id").alias("x"), "entity_type", F.col("mention_count").alias("mx"), key.alias("k"))
        right = own.select(F.col("id").alias("y"), "entity_type", F.col("mention_count").alias("my"), F.col("low").alias("k"))
        pairs = left.join(right, ["entity_type", "k"]).filter("x <> y").withColumn("rule", F.lit(name)).withColumn("place", F.lit(place))
        found = pairs if found is None else found.union(pairs)
    first = (F.col("mx") > F.col("my")) | ((F.col("mx") == F.col("my")) & (F.col("x") < F.col("y")))
    named = found.select(F.when(first, F.col("x")).otherwise(F.col("y")).alias("canonical_id"), F.when(first, F.col("y")).otherwise(F.col("x")).alias("duplicate_id"), "rule", "place")
    once = named.groupBy("canonical_id", "duplicate_id").agg(F.min_by("rule", "place").alias("rule"))
    return once if exclude is None else once.join(exclude, ["canonical_id", "duplicate_id"], "left_anti")


def canonical_map(pairs: DataFrame) -> DataFrame:
    """(duplicate_id, canonical_id) of all ids that pairs (duplicate_id, canonical_id) link, directly or by others.

    The canonical id of a group is its smallest one that is nobody's duplicate; where all are, as in a cycle, its smallest.
    """
    groups = components(pairs, "duplicate_id", "canonical_id")
    duplicates_ = pairs.filter("duplicate_id <> canonical_id").select(F.col("duplicate_id").alias("id")).distinct().withColumn("_d", F.lit(True))
    marked = groups.join(duplicates_.hint("merge"), "id", "left")
    heads = marked.groupBy("component").agg(F.coalesce(F.min(F.when(F.col("_d").isNull(), F.col("id"))), F.min("id")).alias("canonical_id"))
    return groups.join(heads.hint("merge"), "component").filter("id <> canonical_id").select(F.col("id").alias("duplicate_id"), "canonical_id")


def merge(entities: DataFrame, mentions: DataFrame, mapping: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Entities with their duplicates' counts and dates, and mentions re-pointed without repeated (entity, message)."""
    target = F.coalesce("canonical_id", "id")
    own = entities.join(mapping.withColumnRenamed("duplicate_id", "id"), "id", "left").withColumn("target", target)
    rest = F.struct((F.col("id") != F.col("target")).alias("other"), F.col("id"), "entity_type", "name")
    merged = own.groupBy("target").agg(F.min(rest).alias("r"), F.sum("mention_count").alias("mention_count"), F.min("first_seen_at").alias("first_seen_at"), F.max("last_seen_at").alias("last_seen_at"))
    seen = mentions.join(mapping.withColumnRenamed("duplicate_id", "entity_id"), "entity_id", "left").withColumn("entity_id", F.coalesce("canonical_id", "entity_id")).drop("canonical_id")
    return merged.select(F.col("target").alias("id"), "r.entity_type", "r.name", "mention_count", "first_seen_at", "last_seen_at"), seen.groupBy("entity_id", "message_id").agg(F.min("rowid").alias("rowid"))


def merged_descriptions(entities: DataFrame, mapping: DataFrame) -> DataFrame:
    """(id, description): the canonical entity's, or where that is blank the first one of its duplicates, by id."""
    own = entities.join(mapping.withColumnRenamed("duplicate_id", "id").hint("merge"), "id", "left").withColumn("target", F.coalesce("canonical_id", "id"))
    said = F.when(F.trim(F.coalesce("description", F.lit(""))) != "", F.col("description"))
    order = F.struct(F.col("canonical_id").isNotNull().alias("other"), "id")
    return own.groupBy(F.col("target").alias("id")).agg(F.coalesce(F.min_by(said, F.when(said.isNotNull(), order)), F.lit("")).alias("description"))


def merged_edges(edges: DataFrame, mapping: DataFrame) -> DataFrame:
    """Edges (src, rel, dst) of entities with both ends re-pointed, each once, without those that a merge turns on themselves.
    Edges of co-occurrence are counted anew from the merged mentions (G5) instead."""
    to = lambda side: mapping.select(F.col("duplicate_id").alias(side), F.col("canonical_id").alias(f"_{side}")).hint("merge")
    both = edges.join(to("src"), "src", "left").join(to("dst"), "dst", "left")
    moved = both.select(F.coalesce("_src", "src").alias("src"), "rel", F.coalesce("_dst", "dst").alias("dst"), (F.col("_src").isNotNull() | F.col("_dst").isNotNull()).alias("_moved"))
    return moved.filter("not _moved or src <> dst").select("src", "rel", "dst").distinct()


def merge_report(entities: DataFrame, edges: DataFrame, pairs: DataFrame) -> DataFrame:
    """E4, dry run: a row for each asked pair: (canonical_id, duplicate_id, outcome, edges): whether it would be merged, or skipped
    as its duplicate or canonical entity is not there, and how many edges of the duplicate would be moved."""
    known = lambda c: entities.select(F.col("id").alias(c), F.lit(True).alias(f"_{c}")).hint("merge")
    ends = edges.select(F.col("src").alias("duplicate_id"), F.col("dst").alias("other")).union(edges.select("dst", "src"))
    n = ends.groupBy("duplicate_id").agg(F.count("*").alias("edges"))
    both = pairs.join(known("canonical_id"), "canonical_id", "left").join(known("duplicate_id"), "duplicate_id", "left").join(n.hint("merge"), "duplicate_id", "left")
    outcome = F.when(F.col("_canonical_id").isNull(), "no canonical").when(F.col("_duplicate_id").isNull(), "skipped").otherwise("merge")
    return both.select("canonical_id", "duplicate_id", outcome.alias("outcome"), F.when(outcome == "merge", F.coalesce("edges", F.lit(0))).otherwise(0).cast("long").alias("edges"))


def persist(existing: DataFrame, extracted: DataFrame, types: list | None = None, most: int = 2000, snippet: int = 200) -> tuple[DataFrame, DataFrame]:
    """(entities, mentions) after extracted rows (entity_type, name, description, message_id, relevance, snippet, created_at).

    A row belongs to the entity of its type and lower-cased trimmed name: one that exists (the one of smallest id) or a new one, whose
    id is a hash of both. Counts grow by its rows, dates reach to them; descriptions that differ from those before, whatever
    their case, are joined in the order of their dates and cut. A message mentions an entity once, by its earliest row, with its
    relevance between 0 and 1. Rows without a name and of other than the given types are left out.
    """
    key = F.lower(F.trim("name"))
    rows = extracted.filter(F.length(F.trim("name")) > 0)
    rows = (rows if types is None else rows.filter(F.col("entity_type").isin(types))).withColumn("key", key)
    said = F.when(F.trim(F.coalesce("description", F.lit(""))) != "", F.struct("created_at", "message_id", F.trim("description").alias("d")))
    found = rows.groupBy("entity_type", "key").agg(F.min_by(F.trim("name"), F.struct("created_at", "message_id", "name")).alias("name"), F.count("*").alias("n"), F.min("created_at").alias("first"), F.max("created_at").alias("last"), F.sort_array(F.collect_set(said)).alias("said"))
    known = existing.withColumn("key", key).groupBy("entity_type", "key").agg(F.min("id").alias("known"))
    named = found.join(known.hint("merge"), ["entity_type", "key"], "left")
    named = named.withColumn("entity_id", F.coalesce("known", F.xxhash64("entity_type", "key").bitwiseAND(F.lit((1 << 62) - 1)).bitwiseOR(F.lit(1 << 62))))

    def together(old: Column) -> Column:
        texts = F.concat(F.when(F.coalesce(old, F.lit("")) != "", F.array(old)).otherwise(F.array().cast("array<string>")), F.transform(F.coalesce("said", F.array().cast("array<struct<created_at:timestamp,message_id:bigint,d:string>>")), lambda s: s["d"]))
        low = F.transform(texts, lambda t: F.lower(t))
        once = F.filter(texts, lambda t, i: F.array_position(low, F.lower(t)) == i + 1)
        return F.substring(F.array_join(once, " | "), 1, most)

    columns = ["id", "entity_type", "name", "description", "mention_count", "first_seen_at", "last_seen_at"]
    more = named.filter("known is not null").select(F.col("known").alias("id"), "n", "first", "last", "said")
    old = existing.select(*columns).join(more.hint("merge"), "id", "left")
    old = old.select("id", "entity_type", "name", together(F.col("description")).alias("description"), (F.coalesce("mention_count", F.lit(0)) + F.coalesce("n", F.lit(0))).alias("mention_count"), F.least("first_seen_at", "first").alias("first_seen_at"), F.greatest("last_seen_at", "last").alias("last_seen_at"))
    new = named.filter("known is null").select(F.col("entity_id").alias("id"), "entity_type", "name", together(F.lit("")).alias("description"), F.col("n").alias("mention_count"), F.col("first").alias("first_seen_at"), F.col("last").alias("last_seen_at"))
    seen = rows.join(named.select("entity_type", "key", "entity_id").hint("merge"), ["entity_type", "key"])
    first = F.min(F.struct("created_at", F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce("relevance", F.lit(0.5)))).alias("relevance"), F.substring(F.coalesce("snippet", F.lit("")), 1, snippet).alias("snippet")))
    mentions = seen.groupBy("entity_id", "message_id").agg(first.alias("m")).select("entity_id", "message_id", "m.relevance", "m.snippet", "m.created_at")
    return old.unionByName(new), mentions


def aliases(entities: DataFrame, pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """E5: alias edges (alias_id, name) of a list of pairs (alias, name), and full names that no entity has yet."""
    low = entities.select("id", F.lower("name").alias("k"))
    own = pairs.select(F.lower("alias").alias("k"), "name")
    edges = low.join(own, "k").select(F.col("id").alias("alias_id"), "name")
    missing = pairs.select("name").distinct().join(entities.select(F.lower("name").alias("k")), F.lower("name") == F.col("k"), "left_anti")
    return edges, missing


def decay(entities: DataFrame, as_of: str) -> DataFrame:
    """(id, salience, change): 0.5 * max(0.15, 45 / (45 + days)) + min(0.15, mentions * 0.005), at most 1."""
    days = F.greatest(F.lit(0), F.floor((F.unix_timestamp(F.lit(as_of).cast("timestamp")) - F.unix_timestamp("last_seen_at")) / 86400))
    new = F.round(F.least(F.lit(1.0), 0.5 * F.greatest(F.lit(0.15), F.lit(45.0) / (45 + F.coalesce(days, F.lit(0)))) + F.least(F.lit(0.15), F.col("mention_count") * 0.005)), 3)
    move = F.when(F.abs(new - F.col("salience")) < 0.001, "same").when(new < F.col("salience"), "decayed").otherwise("boosted")
    return entities.select("id", new.alias("salience"), move.alias("change"))


def link(messages: DataFrame, entities: DataFrame, index: Index, k: int = 3, least: float = 0.4) -> DataFrame:
    """(message_id, entity_id, score, place): the entities that messages (message_id, text) name.

    A candidate (F16) that is an entity's name, whatever its case, is that entity with 0.95, of several the first by type and id.
    Another one is searched for in the index of names: of the three best, equal names count 0.9, names that hold each other 0.6,
    others 0.4, times min(1, ln(mentions + 1) / 3), 0.9 at most; what reaches ``least`` stays. An entity counts by the first
    candidate that found it; the k best of a message are kept, earlier candidates first. Every different candidate is looked
    up once for all messages.
    """
    cand = written(messages.select("message_id", F.posexplode(entity_candidates(F.col("text"))).alias("pos", "c")).select("message_id", "pos", F.lower("c").alias("c")), "candidates")
    names = entities.select(F.lower(F.trim("name")).alias("c"), F.struct("entity_type", F.col("id").alias("entity_id")).alias("e"))
    asked = written(cand.select("c").distinct(), "asked")
    exact = asked.join(names.groupBy("c").agg(F.min("e").alias("e")).hint("merge"), "c").select("c", F.col("e.entity_id").alias("entity_id"), F.lit(0.95).alias("score"), F.lit(1).alias("rank"))
    exact = written(exact, "exact")
    rest = asked.join(exact.select("c").hint("merge"), "c", "left_anti")
    near = index.search(terms_of(rest.select(F.col("c").alias("qid"), F.col("c").alias("text")), []), 3).select(F.col("qid").alias("c"), F.col("doc_id").alias("entity_id"), "rank")
    both = near.join(entities.select(F.col("id").alias("entity_id"), F.lower("name").alias("low"), "mention_count").hint("merge"), "entity_id")
    like = F.when(F.col("low") == F.col("c"), 0.9).when(F.contains("low", F.col("c")) | F.contains("c", F.col("low")), 0.6).otherwise(0.4)
    score = F.least(F.lit(0.9), like * F.least(F.lit(1.0), F.log(F.col("mention_count") + 1) / 3))
    found = exact.union(both.select("c", "entity_id", score.alias("score"), "rank").filter(F.col("score") >= least))
    met = cand.join(found.hint("merge"), "c").groupBy("message_id", "entity_id").agg(F.min(F.struct("pos", "rank", "score")).alias("f"))
    place = F.row_number().over(Window.partitionBy("message_id").orderBy(F.desc("f.score"), "f.pos", "f.rank"))
    return met.withColumn("place", place).filter(F.col("place") <= k).select("message_id", "entity_id", F.col("f.score").alias("score"), "place")


def context_block(matches: DataFrame, budget: int = 2000, snippets: int = 3) -> DataFrame:
    """(qid, context): what is known of the matches (qid, rank, name, entity_type, mention_count, description, snippets), in
    order while their blocks fit the budget; of the first that does not fit, its head and 200 characters of its description
    if these do, and nothing after it."""
    #: The forms of the heading, of a block's head, of its list and of its shortened end.
    heading = F.lit("\n## Known Context\n")
    head = F.concat(F.lit("**"), F.col("name"), F.lit("** ("), F.col("entity_type").cast("string"), F.lit(", referenced "), F.col("mention_count").cast("string"), F.lit(" times):\n"))
    said = F.when(F.coalesce("description", F.lit("")) != "", F.col("description")).otherwise(F.lit("(no description)"))
    some = F.slice(F.coalesce("snippets", F.array().cast("array<string>")), 1, snippets)
    listed = F.when(F.size(some) > 0, F.concat(F.lit("\nRecent context:\n"), F.array_join(F.transform(some, lambda x: F.concat(F.lit('- "'), x, F.lit('"\n'))), ""))).otherwise("")
    own = matches.select("qid", "rank", F.concat(head, said, F.lit("\n"), listed, F.lit("\n")).alias("block"), F.concat(head, F.substring(said, 1, 200), F.lit("...\n\n")).alias("short"))
    order = Window.partitionBy("qid").orderBy("rank")
    own = own.withColumn("end", F.length(heading) + F.sum(F.length("block")).over(order)).withColumn("over", F.col("end") > budget)
    own = own.withColumn("overs", F.sum(F.col("over").cast("int")).over(order))
    fits = F.col("end") - F.length("block") + F.length("short") <= budget
    part = F.when(~F.col("over"), F.col("block")).when((F.col("overs") == 1) & fits, F.col("short"))
    kept = own.select("qid", "rank", part.alias("part"))
    return kept.groupBy("qid").agg(F.concat(heading, F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("part").isNotNull(), F.struct("rank", "part")))), lambda s: s["part"]), "")).alias("context"))


def statistics(entities: DataFrame) -> DataFrame:
    """(entity_type, n, mentions, top): counts and the most mentioned name of each type."""
    return entities.groupBy("entity_type").agg(F.count("*").alias("n"), F.sum("mention_count").alias("mentions"), F.max(F.struct("mention_count", F.col("name"))).getField("name").alias("top"))
