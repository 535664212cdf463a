"""Column functions over texts and scores."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Window, functions as F

#: Words that a search leaves out of its terms.
SEARCH_STOPWORDS = (
    "a an and are as at be but by can do for from had has have he her his how i if in into is it its me my no not of on or our "
    "she so that the their them then there these they this to up us was we were what when which who will with would you your"
).split()
#: Our own choice of words without weight for keywords.
STOPWORDS = (
    "a about after all also an and any are as at be been but by can could did do does for from had has have he her him his "
    "how i if in into is it its just like me more my no not of on one or our out she so some than that the their them then "
    "there these they this to up us was we were what when which who will with would you your"
).split()
_STOP = "^(" + "|".join(STOPWORDS) + ")$"
_SEARCH_STOP = "^(" + "|".join(SEARCH_STOPWORDS) + ")$"


def stripped(text: Column) -> Column:
    """Without white space at both ends."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def normalized(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), r"[ \t\r\n]+", " "))


def content_hash(text: Column) -> Column:
    """SHA-256 of the lower-cased text with white space collapsed."""
    return F.sha2(normalized(text), 256)


def raw_hash(content: Column) -> Column:
    """SHA-256 of the bytes."""
    return F.sha2(content, 256)


def conversation_hash(messages: DataFrame) -> DataFrame:
    """(conversation_id, hash) of the ordered prompts and responses of each conversation."""
    turn = F.concat(F.lit("U:"), "user_prompt", F.lit("\nA:"), "model_response")
    turns = F.array_sort(F.collect_list(F.struct("sequence", turn.alias("t"))))
    return messages.groupBy("conversation_id").agg(turns.alias("t")).select("conversation_id", content_hash(F.array_join(F.transform("t", lambda x: x["t"]), "\n---\n")).alias("hash"))


def point_id(record: Column, index: Column, count: Column, namespace: str = "6ba7b8119dad11d180b400c04fd430c8") -> Column:
    """the record's id if it is one chunk, else the name-based UUID (version 5) of ``{id}_c{index:03d}``."""
    name = F.concat(record, F.lit("_c"), F.lpad(index.cast("string"), 3, "0"))
    h = F.sha1(F.concat(F.unhex(F.lit(namespace)), F.encode(name, "UTF-8")))
    variant = F.lower(F.hex(F.conv(F.substring(h, 17, 1), 16, 10).cast("int").bitwiseAND(3).bitwiseOR(8).cast("long")))
    parts = [F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("5"), F.substring(h, 14, 3)), F.concat(variant, F.substring(h, 18, 3)), F.substring(h, 21, 12)]
    return F.when(count == 1, record).otherwise(F.concat_ws("-", *parts))


def compose_qa(prompt: Column, response: Column, most: int = 20_000) -> Column:
    """the text that a message is searched by."""
    return F.substring(F.concat(F.lit("Q: "), prompt, F.lit("\nA: "), response), 1, most)


def compose_item(kind: Column, title: Column, description: Column) -> Column:
    return F.concat(kind, F.lit(": "), title, F.lit("\n"), F.coalesce(description, F.lit("")))


def split_qa(text: Column, preview: int = 200) -> tuple[Column, Column]:
    """prompt and response (cut to a preview) of a composed text; without its form, no prompt."""
    at = F.locate("\nA: ", text)
    both = text.startswith("Q: ") & (at > 0)
    cut = lambda c: F.substring(c, 1, preview)
    return F.when(both, cut(F.substring(text, F.lit(4), at - 4))), F.when(both, cut(F.substring(text, at + 4, F.length(text)))).otherwise(cut(text))


def clean_text(text: Column) -> Column:
    """no control characters but tab and line feed, line feeds for CRLF, two line feeds at most, trimmed."""
    t = F.regexp_replace(F.regexp_replace(text, "\r\n?", "\n"), r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]", "")
    return stripped(F.regexp_replace(t, "\n{3,}", "\n\n"))


def split_reasoning(raw: Column) -> tuple[Column, Column]:
    """F8: (reasoning, clean text): paired think tags, then what stands before a closing tag left over without an opening one,
    then paired reasoning tags; parts are trimmed and joined by a blank line."""
    think, reasoning = r"(?s)<think>(.*?)</think>", r"(?s)<reasoning>(.*?)</reasoning>"
    first = F.regexp_replace(raw, think, "")
    at = F.locate("</think>", first)
    lone = (at > 0) & (F.locate("<think>", first) == 0)
    before = stripped(F.substring(first, F.lit(1), at - 1))
    second = F.when(lone, F.substring(first, at + 8, F.length(first))).otherwise(first)
    parts = F.concat(
        F.transform(F.regexp_extract_all(raw, F.lit(think), 1), stripped),
        F.when(lone & (before != ""), F.array(before)).otherwise(F.array().cast("array<string>")),
        F.transform(F.regexp_extract_all(second, F.lit(reasoning), 1), stripped),
    )
    return F.array_join(parts, "\n\n"), stripped(F.regexp_replace(second, reasoning, ""))


def strip_report_format(text: Column, signature: str | None = None) -> Column:
    """marks of headings go, and rules of three or more of the marks - _ * in any mix, the stars of bold-only lines, lines that
    sign with ``signature`` after one or two dashes, and runs of blank lines; code fences stay as they are."""
    rules = [(r"(?md)^#{1,6}\s+", ""), (r"(?md)^[-_*]{3,}\s*$", ""), (r"(?md)^\*\*([^*]+)\*\*\s*$", "$1")]
    if signature:
        rules.append((rf"(?md)^[—–-]{{1,2}}\s*\Q{signature}\E\s*$", ""))
    fence = "(?s)```.*?```"
    bare = F.replace(text, F.lit("\0"), F.lit(""))
    blocks = F.regexp_extract_all(bare, F.lit(fence), 0)
    # Each fence is one mark while the rules run, so that no line begins or ends at it.
    plain = functools.reduce(lambda t, r: F.regexp_replace(t, *r), [*rules, ("\n{3,}", "\n\n")], F.regexp_replace(bare, fence, "\0"))
    parts = F.transform(F.split(plain, "\0"), lambda t, i: F.concat(t, F.coalesce(F.get(blocks, i), F.lit(""))))
    return stripped(F.array_join(parts, ""))


def tokens(text: Column, pattern: str = r"[a-z][a-z0-9_]+") -> Column:
    """Lower-cased ASCII words."""
    return F.regexp_extract_all(F.lower(text), F.lit(pattern), 0)


def content_words(text: Column) -> Column:
    """Words of three letters or more that are no stopwords."""
    return F.filter(tokens(text), lambda w: (F.length(w) >= 3) & ~w.rlike(_STOP))


def keywords(rows: DataFrame, n: int, id_column: str = "id", text_column: str = "text") -> DataFrame:
    """(id, keyword, times, place): the n most frequent content words of each text, ties by first appearance."""
    words = rows.select(id_column, F.posexplode(content_words(F.col(text_column))).alias("at", "keyword"))
    counts = words.groupBy(id_column, "keyword").agg(F.count("*").alias("times"), F.min("at").alias("at"))
    place = F.row_number().over(Window.partitionBy(id_column).orderBy(F.desc("times"), "at"))
    return counts.withColumn("place", place).filter(F.col("place") <= n).select(id_column, "keyword", "times", "place")


def fts_terms(query: Column) -> Column:
    """search terms; numbers also padded with zeros to four and five digits where they are shorter."""
    words = F.filter(F.split(F.regexp_replace(F.lower(query), r"[^a-z0-9 ]", " "), " +"), lambda w: (F.length(w) > 1) & ~w.rlike(_SEARCH_STOP))
    wide = lambda w, n: F.when(F.length(w) < n, F.lpad(w, n, "0")).otherwise(w)
    return F.flatten(F.transform(words, lambda w: F.when(w.rlike("^[0-9]+$"), F.array_distinct(F.array(w, wide(w, 4), wide(w, 5)))).otherwise(F.array(w))))


def relative_time(ts: Column, as_of: str) -> Column:
    """how long ago, in whole days of 24 hours; empty for the future."""
    d = F.floor((F.unix_timestamp(F.lit(as_of).cast("timestamp")) - F.unix_timestamp(ts)) / 86400)
    n = lambda k, unit: F.concat(F.floor(d / k).cast("string"), F.when(F.floor(d / k) == 1, f" {unit} ago").otherwise(f" {unit}s ago"))
    return F.when(d < 0, "").when(d == 0, "today").when(d == 1, "yesterday").when(d < 7, n(1, "day")).when(d < 30, n(7, "week")).when(d < 365, n(30, "month")).otherwise(n(365, "year"))


#: Patterns of references to the past, in any case.
MONTHS = "january|february|march|april|may|june|july|august|september|october|november|december"
HISTORICAL = (
    rf"last\s*(year|month|week|summer|winter|fall|spring|{MONTHS})",
    r"(months?|years?|weeks?)\s*ago",
    rf"in\s*({MONTHS})",
    r"in\s+\d{4}",
    r"back\s+when|first\s+time|earliest|originally",
    r"our\s+(first|earliest|original)\s+(conversation|discussion|chat)",
)


def is_historical(text: Column) -> Column:
    """any of the patterns occurs."""
    return text.rlike("(?i)" + "|".join(f"({p})" for p in HISTORICAL))


#: The patterns of each intent, in any case. Those of SHORT must fit a whole message, up to its closing
#: marks; of the others, CLARIFICATION and COMMAND must begin it, the rest may occur anywhere.
SHORT = {
    "greeting": r"hey|hi|hello|howdy|yo|sup|good\s*(morning|afternoon|evening|night)|what'?s\s*up|greetings",
    "acknowledgment": r"ok(ay)?|got\s*it|thanks?(\s*you)?|cool|nice|great|perfect|understood|right|yep|yup|yeah|sure|absolutely|will\s*do|noted|sounds?\s*good|that('?s|\s+is)\s*(helpful|great|perfect|good)",
    "farewell": r"bye|goodbye|goodnight|good\s*night|see\s*you|talk\s*(later|soon|tomorrow)|gotta\s*go|heading\s*out|signing\s*off|night|ttyl|later",
    "continuation": r"tell\s*me\s*more|go\s*on|continue|and(\s*then)?|what\s*else|keep\s*going|more\s*(details?|info(rmation)?)|elaborate",
}
CLARIFICATION = r"what\s*(do\s*you|did\s*you|does\s*that)\s*mean|can\s*you\s*(explain|clarify)|i\s*don'?t\s*(understand|get\s*it)|how\s*so|in\s*what\s*(way|sense)"
COMMAND = r"/\w+"
ANYWHERE = {
    "emotional": r"i('?m|\s+am)\s*(feeling|so\s*(tired|sad|frustrated|angry|anxious|overwhelmed))|i\s*(hate|can'?t\s*(do|handle|take))|everything\s*(is|feels)\s*(terrible|hopeless|pointless)|having\s*a\s*(bad|rough|hard|tough)\s*(day|time|week)",
    "meta": r"how\s*are\s*you|what\s*do\s*you\s*(remember|recall|know\s*about\s*me)|do\s*you\s*remember|what('?s|\s+is)\s*your\s*(status|state)|how('?s|\s+is)\s*(the\s*)?(system|platform|janus)",
    "planning": r"let'?s\s*(work\s*on|plan|build|design|architect|figure\s*out|think\s*about)|we\s*(need|should)\s*(to|build|create|implement)|(next\s*steps?|roadmap|sprint|milestone)|how\s*should\s*we\s*(approach|handle|implement)",
    "knowledge": r"what\s*did\s*we\s*(discuss|talk\s*about|decide|agree)|(tell|remind)\s*me\s*about|(remember|recall)\s*when\s*we|what('?s|\s+is|was)\s*(the|our)\s*(plan|decision|conclusion)|search\s*(for|through)|find\s*(the|our)",
    "creative": r"(write|draft|compose|create|generate|brainstorm|imagine|design)\s",
}
#: Retrieval depth of each intent, and whether signals are gathered before the answer.
ROUTES = {
    "greeting": ("none", False), "acknowledgment": ("none", False), "farewell": ("none", False), "emotional": ("none", True), "continuation": ("light", False), "clarification": ("light", False),
    "knowledge": ("full", True), "creative": ("full", True), "planning": ("full", True), "meta": ("light", True), "command": ("none", False),
}


def route(text: Column, turn: Column | int = 0) -> Column:
    """(intent, confidence, depth, prepass) of a message, by the first rule that fits.

    A slash command; distress anywhere; in messages of under 60 characters the short forms; then clarification, meta,
    planning, knowledge and creative signals. Otherwise over 20 characters count as knowledge, fewer as
    acknowledgment. A greeting is surer in the first turns.
    """
    t = stripped(text)
    whole = lambda name: (F.length(t) < 60) & t.rlike(rf"(?i)^({SHORT[name]})[\s!?.]*$")
    found = lambda name: t.rlike(f"(?i){ANYWHERE[name]}")
    opening = F.when(F.lit(turn) <= 1 if isinstance(turn, int) else turn <= 1, 0.95).otherwise(0.8)
    rules = [
        (t == "", "acknowledgment", 0.9), (t.rlike(f"^{COMMAND}"), "command", 1.0), (found("emotional"), "emotional", 0.8), (whole("greeting"), "greeting", opening), (whole("acknowledgment"), "acknowledgment", 0.9),
        (whole("farewell"), "farewell", 0.9), (whole("continuation"), "continuation", 0.85), (t.rlike(f"(?i)^({CLARIFICATION})"), "clarification", 0.8), (found("meta"), "meta", 0.8), (found("planning"), "planning", 0.75),
        (found("knowledge"), "knowledge", 0.75), (found("creative"), "creative", 0.7), (F.length(t) > 20, "knowledge", 0.5), (F.lit(True), "acknowledgment", 0.4),
    ]

    def result(name: str, confidence) -> Column:
        depth, prepass = ROUTES[name]
        return F.struct(F.lit(name).alias("intent"), (confidence if isinstance(confidence, Column) else F.lit(confidence)).cast("double").alias("confidence"), F.lit(depth).alias("depth"), F.lit(prepass).alias("prepass"))

    return functools.reduce(lambda c, r: c.when(r[0], result(*r[1:])), rules[1:], F.when(rules[0][0], result(*rules[0][1:])))


def intent(text: Column, turn: Column | int = 0) -> Column:
    return route(text, turn)["intent"]


def intent_confidence(text: Column, turn: Column | int = 0) -> Column:
    return route(text, turn)["confidence"]


def retrieval_depth(text: Column) -> Column:
    return route(text)["depth"]


#: Document types, in order, by pattern of title and file name; folders of entries.
DOC_TYPES = (
    ("chapter", r"^chapter\b|^chpt\b|^ch\s*\d"),
    ("conversation", r"conversation|session_\d|^\d{8}"),
    ("journal", r"journal|diary|log\b"),
    ("essay", r"essay|paper|thesis|abstract"),
    ("research", r"research|study|analysis|survey"),
    ("creative", r"grimoire|spell|illusion|ritual"),
    ("project_doc", r"protocol|mandate|sprint|mission"),
    ("documentation", r"readme|changelog|todo|guide"),
    ("session_notes", r"minutes|book.club"),
)
ENTRY_FOLDERS = ("Claude Journal", "Claude_Journal")


def doc_type(title: Column, path: Column | None = None) -> Column:
    """the type of a document by its path's folders, then by the first pattern in its title and file name."""
    text = title if path is None else F.concat(title, F.lit(" "), F.element_at(F.split(path, "/"), -1))
    entry = F.lit(False) if path is None else functools.reduce(lambda a, b: a | b, (F.contains(path, F.lit(x)) for x in ENTRY_FOLDERS))
    return functools.reduce(lambda c, x: c.when(text.rlike(f"(?i){x[1]}"), x[0]), DOC_TYPES, F.when(entry, "entry")).otherwise("general")


#: The endings of compound names.
COMPOUNDS = ("Theory", "Model", "Framework", "Pattern", "Cycle", "Loop")


def entity_candidates(text: Column, stopwords: list[str] = SEARCH_STOPWORDS) -> Column:
    """F16: names that a text may mention, in the order of the rules and of the text, each once whatever its case.

    Runs of capitalised words; what stands between quotation marks, 2 to 50 characters; compounds; R and one to three
    digits; capitalised words of three letters or more that do not begin a sentence; where none of these finds any, the
    three longest words of three letters or more, the earlier of equally long ones. Stopwords and single characters are no names.
    """
    letter = "[\\p{L}\\p{N}_]"
    compound = f"(?i)(?<!{letter}){letter}+-(?:{'|'.join(COMPOUNDS)})(?!{letter})"
    rules = [(rf"(?<!{letter})[A-Z][a-zA-Z]*(?:[\s-][A-Z][a-zA-Z]*)+(?!{letter})", 0), (r"""['"]([^'"]{2,50})['"]""", 1), (compound, 0), (rf"(?<!{letter})R[0-9]{{1,3}}(?!{letter})", 0)]
    found = [F.transform(F.regexp_extract_all(text, F.lit(p), g), stripped) for p, g in rules]
    words = lambda t: F.filter(F.split(t, r"\s+"), lambda w: w != "")
    inner = F.flatten(F.transform(F.split(text, r"[.!?]\s+"), lambda t: let(words(t), lambda w: F.slice(w, 2, F.greatest(F.size(w) - 1, F.lit(0))))))
    clean = F.transform(inner, lambda w: F.regexp_replace(w, r"[^\p{L}\p{N}_-]", ""))
    found.append(F.filter(clean, lambda w: w.rlike(r"^\p{Lu}") & (F.length(w) > 2)))
    stop = "^(" + "|".join(stopwords) + ")$"
    names = F.filter(F.concat(*found), lambda w: (F.length(w) > 1) & ~F.lower(w).rlike(stop))
    plain = F.filter(F.regexp_extract_all(text, F.lit(f"{letter}+"), 0), lambda w: (F.length(w) > 2) & ~F.lower(w).rlike(stop))
    ranked = F.array_sort(F.transform(plain, lambda w, i: F.struct((-F.length(w)).alias("n"), i.alias("i"), w.alias("w"))))
    longest = F.transform(F.slice(ranked, 1, 3), lambda x: x["w"])

    def once(all_names: Column) -> Column:
        low = F.transform(all_names, F.lower)
        return let(F.struct(all_names.alias("n"), low.alias("l")), lambda s: F.filter(s["n"], lambda w, i: F.array_position(s["l"], F.lower(w)) == i + 1))

    return let(names, lambda n: F.when(F.size(n) > 0, once(n)).otherwise(once(longest)))


def normal_name(name: Column) -> Column:
    """lower-cased, without punctuation, white space collapsed."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(name), r"[^a-z0-9 ]", ""), " +", " "))


def time_of_day(ts: Column) -> Column:
    """F18."""
    h = F.hour(ts)
    return F.when(h < 5, "night").when(h < 8, "early morning").when(h < 12, "morning").when(h < 17, "afternoon").when(h < 21, "evening").otherwise("night")


def greeting(ts: Column) -> Column:
    """a greeting for the hour, the evening's at night."""
    h = F.hour(ts)
    return F.when((h >= 5) & (h < 12), "Good morning").when((h >= 12) & (h < 17), "Good afternoon").otherwise("Good evening")


def season(ts: Column, latitude: float) -> Column:
    names = ("winter", "spring", "summer", "fall")
    k = F.floor(F.month(ts) % 12 / 3) + (0 if latitude >= 0 else 2)
    return F.element_at(F.array(*map(F.lit, names)), (k % 4 + 1).cast("int"))


def daylight_hours(ts: Column, latitude: float) -> Column:
    """hours between sunrise and sunset by solar declination; null in polar day and night."""
    declination = F.radians(23.45 * F.sin(F.radians(360.0 / 365.0 * (F.dayofyear(ts) - 81))))
    x = -F.tan(F.radians(F.lit(latitude))) * F.tan(declination)
    return F.when(F.abs(x) <= 1, 2 * F.degrees(F.acos(x)) / 15)


def sunrise_sunset(ts: Column, latitude: float, longitude: float, utc_offset: float = 0.0) -> tuple[Column, Column]:
    """sunrise and sunset in hours after midnight of the local clock; null in polar day and night."""
    noon, half = 12 + (utc_offset * 15 - longitude) / 15, daylight_hours(ts, latitude) / 2
    return noon - half, noon + half


#: Mean lowest and highest temperature of each month, Fahrenheit.
CLIMATE = ((-2, 17), (3, 23), (16, 36), (30, 53), (43, 67), (53, 76), (58, 82), (55, 80), (44, 69), (31, 55), (17, 36), (2, 21))


def celsius(fahrenheit: Column) -> Column:
    """F20."""
    return (fahrenheit - 32) * 5 / 9


def climate(ts: Column) -> tuple[Column, Column]:
    """the month's mean lowest and highest temperature, in Fahrenheit."""
    at = lambda k: F.element_at(F.array(*(F.lit(m[k]) for m in CLIMATE)), F.month(ts))
    return at(0), at(1)


#: The words after "to", "as" or "is" that name a status, and what they are stored as if not as they stand.
STATUS_PATTERN = r"(?:to|as|is)\s+(done|complete|finished|shipped|in.?progress|started|blocked|not.?started|planning|review|archived|pending|processing|failed)"
STATUS_WORDS = {"done": "completed", "complete": "completed", "finished": "completed", "started": "in_progress"}


def status_enum(text: Column) -> Column:
    """the stored form of the status that a phrase names; null without one."""
    word = F.lower(F.regexp_extract(text, "(?i)" + STATUS_PATTERN, 1))
    known = functools.reduce(lambda c, w: c.when(word == w, STATUS_WORDS[w]), STATUS_WORDS, F.when(word == "", F.lit(None).cast("string")))
    return known.otherwise(F.regexp_replace(word, "[ -]", "_"))


def split_tokens(total: Column, reasoning: Column, response: Column) -> Column:
    """the part of a completion's tokens that its reasoning takes, by length."""
    n = F.length(reasoning) + F.length(response)
    return F.when(n > 0, F.floor(total * F.length(reasoning) / n)).otherwise(F.lit(0))


#: Phrases that say nothing.
BOILERPLATE = ("i hope this helps", "let me know if", "feel free to", "i'd be happy to", "is there anything else")


def let(value: Column, body) -> Column:
    """The body of a value that is computed once, however often the body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def quality_score(prompt: Column, response: Column, reasoning: Column | None = None) -> Column:
    """from 0.5 up for reasoning and substance, down for terse, repetitive and boilerplate responses; 0 to 1, and 0
    without a response. Time is linear in the response, but for a sort of its four-word runs."""
    split = lambda text: F.filter(F.split(F.coalesce(text, F.lit("")), r"\s+"), lambda x: x != "")

    def runs(w: Column) -> Column:
        rest = lambda k: F.slice(w, k + 1, F.greatest(F.size(w) - k, F.lit(0)))
        fours = F.arrays_zip(w.alias("a"), rest(1).alias("b"), rest(2).alias("c"), rest(3).alias("d"))
        return F.sort_array(F.transform(F.slice(fours, 1, F.greatest(F.size(w) - 3, F.lit(0))), lambda r: F.concat_ws(" ", r["a"], r["b"], r["c"], r["d"])))

    def repeated(r: Column) -> Column:
        """In sorted order, a run that occurs three times or more equals the one two places on."""
        pairs = F.arrays_zip(r.alias("x"), F.slice(r, 3, F.size(r)).alias("y"))
        return F.size(F.array_distinct(F.transform(F.filter(pairs, lambda p: p["x"] == p["y"]), lambda p: p["x"])))

    phrases = sum((F.contains(F.lower(response), F.lit(p)).cast("int") for p in BOILERPLATE), F.lit(0))
    asked = F.when(F.length(F.coalesce(prompt, F.lit(""))) > 0, F.size(split(prompt))).otherwise(1)
    thought = F.lit(0) if reasoning is None else F.coalesce(F.length(reasoning), F.lit(0))
    counted = let(split(F.lower(response)), lambda w: F.struct(F.size(w).alias("n"), let(runs(w), repeated).alias("repeated")))
    facts = F.struct(counted.alias("c"), asked.alias("asked"), phrases.alias("phrases"), thought.alias("thought"))

    def score(f: Column) -> Column:
        n, m = f["c"]["n"], f["asked"]
        total = F.lit(0.5) + F.when(f["thought"] > 500, 0.2).when(f["thought"] > 100, 0.1).when(f["thought"] > 0, 0.05).otherwise(0.0)
        total = total + F.when(n < 10, -0.15).when(n > 100, 0.1).otherwise(0.0) - F.when((m > 20) & (n / F.greatest(m, F.lit(1)) < 0.3), 0.1).otherwise(0.0)
        total = total - F.when((n > 20) & (f["c"]["repeated"] > 3), 0.15).otherwise(0.0) - F.when(f["phrases"] >= 2, 0.1).otherwise(0.0)
        return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.round(total, 3)))

    return F.when(F.length(F.coalesce(response, F.lit(""))) == 0, 0.0).otherwise(let(facts, score))


def salience_floor(quality: Column) -> Column:
    """the least salience by band of quality."""
    return F.when(quality >= 0.9, 0.9).when(quality >= 0.8, 0.7).when(quality >= 0.7, 0.6).when(quality >= 0.5, 0.3).otherwise(0.0)


def attribution(title: Column, position: Column, age: Column) -> Column:
    """F26."""
    return F.concat_ws(" ", F.lit("From"), F.concat(F.lit('"'), title, F.lit('"')), F.concat(F.lit("("), position, F.lit(",")), F.concat(age, F.lit(")")))


def layer_variant(weight: Column) -> Column:
    """F27."""
    return F.when(weight < 0.3, "none").when(weight < 0.7, "minimal").when(weight > 1.3, "expanded").otherwise("standard")


def age_years(born: Column, as_of: str) -> Column:
    """whole years."""
    return F.floor(F.months_between(F.lit(as_of).cast("date"), born.cast("date")) / 12).cast("int")
