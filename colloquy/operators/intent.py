"""Intent hypotheses per conversation, gates, retrospectives and action proposals."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..functions.text import route, status_enum

ENTRY = "map<string, struct<confidence: double, seen: int, first: int, last: int>>"


def advance(state: dict, name: str, confidence: float, turn: int, weight: float = 0.3, fade: float = 0.15, least: float = 0.05) -> dict:
    """One turn: state maps an intent to (confidence, times seen, first turn, last turn)."""
    out = {}
    for k, (c, n, first, last) in state.items():
        if k == name:
            n += 1
            c = (1 - weight) * c + weight * confidence + (min(0.05 * (n - 2), 0.2) if n > 2 else 0.0)
            out[k] = (min(c, 1.0), n, first, turn)
        elif c * (1 - fade) >= least:
            out[k] = (c * (1 - fade), n, first, last)
    if name not in state:
        out[name] = (confidence, 1, turn, turn)
    return out


def observed(messages: DataFrame) -> DataFrame:
    """(conversation_id, sequence, name, confidence) of every message's intent."""
    turn = F.col("sequence").cast("int")
    rows = messages.select("conversation_id", turn.alias("sequence"), route(F.col("user_prompt"), turn).alias("r"))
    return rows.select("conversation_id", "sequence", F.col("r.intent").alias("name"), "r.confidence")


def hypotheses(messages: DataFrame, weight: float = 0.3, fade: float = 0.15, least: float = 0.05) -> DataFrame:
    """(conversation_id, sequence, name, confidence, seen, first, last): the hypotheses after every turn.

    A fold over a conversation's turns in their order: the intent seen moves to its new confidence by ``weight`` (and
    gains once it was seen more than twice), others fade and are dropped below ``least``.
    """
    turns = F.array_sort(F.collect_list(F.struct("sequence", "name", "confidence")))
    empty = F.create_map().cast(ENTRY)

    def step(states, t):
        now = F.when(F.size(states) > 0, F.element_at(states, -1)["state"]).otherwise(empty)
        old = F.element_at(now, t["name"])
        n = old["seen"] + 1
        boost = F.when(n > 2, F.least(0.05 * (n - 2), F.lit(0.2))).otherwise(0.0)
        entry = lambda c, n, first, last: F.struct(c.alias("confidence"), n.cast("int").alias("seen"), first.alias("first"), last.alias("last"))
        seen = F.when(old.isNotNull(), entry(F.least(F.lit(1.0), (1 - weight) * old["confidence"] + weight * t["confidence"] + boost), n, old["first"], t["sequence"])).otherwise(entry(t["confidence"], F.lit(1), t["sequence"], t["sequence"]))
        others = F.map_filter(now, lambda k, v: (k != t["name"]) & (v["confidence"] * (1 - fade) >= least))
        faded = F.transform_values(others, lambda k, v: entry(v["confidence"] * (1 - fade), v["seen"], v["first"], v["last"]))
        return F.concat(states, F.array(F.struct(t["sequence"].alias("sequence"), F.map_concat(faded, F.map_from_arrays(F.array(t["name"]), F.array(seen))).cast(ENTRY).alias("state"))))

    zero = F.array().cast(f"array<struct<sequence: int, state: {ENTRY}>>")
    states = observed(messages).groupBy("conversation_id").agg(turns.alias("t")).select("conversation_id", F.explode(F.aggregate("t", zero, step)).alias("s"))
    return states.select("conversation_id", "s.sequence", F.explode("s.state").alias("name", "v")).select("conversation_id", "sequence", "name", "v.*")


def gates(states: DataFrame) -> DataFrame:
    """(conversation_id, sequence, hold_planning, patience)."""
    hold = F.bool_or((F.col("name") == "emotional") & (F.col("confidence") > 0.3) & (F.col("seen") >= 2))
    wait = F.bool_or(F.col("name").isin("continuation", "clarification") & (F.col("seen") >= 2))
    return states.groupBy("conversation_id", "sequence").agg(hold.alias("hold_planning"), wait.alias("patience"))


def retrospectives(states: DataFrame, every: int = 5) -> DataFrame:
    """(conversation_id, sequence, name, finding) at every fifth turn, a row for each finding: a mode sustained over
    three turns or more, an emotional pattern that escalates, an intent that was weak in the three turns before."""
    w = Window.partitionBy("conversation_id", "name").orderBy("sequence").rangeBetween(-3, -1)
    s = states.withColumn("weakest", F.min("confidence").over(w))
    sustained = (F.col("seen") >= 3) & (F.col("last") - F.col("first") >= 2)
    escalates = (F.col("name") == "emotional") & (F.col("seen") >= 2) & (F.col("confidence") > 0.4)
    drift = (F.col("seen") >= 2) & (F.col("confidence") > 0.6) & (F.col("weakest") < 0.3) & (F.col("first") < F.col("sequence") - 2)
    found = F.array_compact(F.array(F.when(sustained, "sustained"), F.when(escalates, "escalation"), F.when(drift, "drift")))
    return s.filter(F.col("sequence") % every == 0).select("conversation_id", "sequence", "name", F.explode(found).alias("finding"))


def recommend_actions(messages: DataFrame, items: DataFrame, act: float = 0.75, confirm: float = 0.5) -> DataFrame:
    """I4: (message_id, tool, status, item_id, confidence, outcome): what a message asks for, with the item its text names."""
    text = F.lower("user_prompt")
    tool = F.when(text.rlike("^(create|add|new) "), "create_item").when(text.rlike("(mark|set|update|finished|done with|completed) "), "update_item").when(text.rlike("^(show|list|what|find) "), "query_items")
    base = F.when(F.col("tool") == "create_item", 0.7).when(F.col("tool") == "update_item", 0.65).otherwise(0.6)
    rows = messages.select("message_id", text.alias("text"), tool.alias("tool"), status_enum(F.col("user_prompt")).alias("status")).filter("tool is not null")
    # A title is indexed by the rarest of its words, then looked for as a whole, from one end of a word to another.
    words = lambda c: F.explode(F.array_distinct(F.filter(F.split(c, r"[^\p{L}\p{N}]+"), lambda w: w != ""))).alias("w")
    title = items.groupBy(F.lower("title").alias("title")).agg(F.min("id").alias("item_id"))
    own = title.select("title", "item_id", words(F.col("title")))
    index = own.join(own.groupBy("w").agg(F.count("*").alias("n")).hint("merge"), "w").groupBy("title", "item_id").agg(F.min(F.struct("n", "w")).alias("r")).select("title", "item_id", "r.w")
    whole = F.concat(F.lit(r"(?<![\p{L}\p{N}])\Q"), F.replace("title", F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E(?![\p{L}\p{N}])"))
    named = rows.select("message_id", "text", words(F.col("text"))).join(index.hint("merge"), "w").filter(F.contains("text", F.col("title"))).filter(F.rlike("text", whole)).groupBy("message_id").agg(F.min("item_id").alias("item_id"))
    both = rows.join(named.hint("merge"), "message_id", "left").withColumn("confidence", F.round(base + F.when(F.col("item_id").isNotNull(), 0.1).when(F.col("tool") == "create_item", 0.0).otherwise(-0.2), 2))
    outcome = F.when(F.col("confidence") >= act, "act").when(F.col("confidence") >= confirm, "confirm").otherwise("ignore")
    return both.select("message_id", "tool", "status", "item_id", "confidence", outcome.alias("outcome"))
