"""Benchmark decontamination by template canonicalisation.

Texts become tokens; numbers, names (capitalised words that are no function words; several in a row are one name) and
units (after a number) become typed placeholders wherever they stand, all other words are lower-cased. Windows of
`window` tokens are hashed and hash-joined with those of the benchmark items, so a question whose numbers or names were
changed still meets its template. Neighbouring windows on one diagonal form runs. Inside a run, slots are consistent
as long as every value of the item's slots stands for one value of the document's and the other way round; a run is
divided where a slot contradicts an earlier one, and the longest consistent stretch counts when it holds `least`
tokens, or the whole of a shorter item.

Only expressions and SQL operators are used. Windows are hashed first; slots are compared for those that met one of the
benchmark's. The benchmark's windows are broadcast when they are few (`most_broadcast`, counted before), and joined by
shuffle beyond that. Windows with fewer than half literal words are hashed with their slots' values, as columns of
numbers would match each other everywhere; windows on one diagonal that touch or overlap form one run, so others bridge
them. What is rewritten word by word, or has words put in every few tokens, is no longer its template and isn't found.

Edge cases: null and empty texts, and texts shorter than an item, match nothing; items shorter than a window are
compared whole; texts of any length are used whole; repeated rows and items give their own pairs once, rows that share a
doc_id or items that share an item_id but no text are compared each by itself and give the longest stretch of the pair;
rows with a null doc_id match nothing and stay; an empty table on either side gives no pairs; other columns stay,
whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terrapoint.llm.common import fresh, staged

#: Units of measure, a parameter. Fixed values.
UNITS = (
    "kg", "g", "mg", "lb", "lbs", "oz", "km", "m", "cm", "mm", "mi", "ft", "in", "l", "ml", "s", "ms", "min", "h",
    "second", "seconds", "minute", "minutes", "hour", "hours", "day", "days", "week", "weeks", "month", "months",
    "year", "years", "meter", "meters", "mile", "miles", "gram", "grams", "liter", "liters", "percent", "dollar",
    "dollars", "euro", "euros", "cent", "cents", "%", "$", "€", "£",
)
#: Words that may begin a sentence and are no names, a parameter. Fixed values.
FUNCTION_WORDS = (
    "a", "after", "all", "an", "and", "are", "as", "at", "before", "but", "by", "calculate", "can", "did", "do", "does",
    "each", "every", "find", "for", "from", "given", "has", "have", "he", "her", "his", "how", "if", "in", "is", "it",
    "its", "let", "many", "much", "no", "not", "of", "on", "one", "or", "she", "so", "some", "suppose", "that", "the",
    "their", "then", "there", "these", "they", "this", "those", "to", "was", "we", "were", "what", "when", "where",
    "which", "who", "why", "will", "with", "you",
)
_NAME = "\\p{Lu}\\p{Ll}++"
# Repeated groups are possessive: Java's other ones take stack for every repeat, and a row of names has no bound.
_NAMES = f"{_NAME}(?: {_NAME})*+"
_TOKEN = f"{_NAME}(?: {_NAME}(?!\\p{{L}}))++|\\p{{L}}++|\\p{{N}}++(?:[.,]\\p{{N}}++)*+|[%$€£]"


def tokens(text: Column) -> Column:
    """Raw tokens; capitalised words in a row are one."""
    return F.regexp_extract_all(F.coalesce(text.cast("string"), F.lit("")), F.lit(_TOKEN), F.lit(0))


def canonical(raw: str, numbered: str, units: tuple[str, ...] = UNITS) -> Column:
    """Tokens of the column raw with placeholders: #n for numbers, #w for names, #u for units after a number. The
    column numbered tells whether the text has a digit at all."""
    known = F.array(*[F.lit(u) for u in units])
    number = lambda x: F.ascii(x).between(48, 57) | ((F.ascii(x) > 127) & x.rlike("^\\p{N}"))
    name = lambda x, word: (word != x) & ~word.isin(*FUNCTION_WORDS) & x.rlike(f"^{_NAMES}$")
    plain = lambda x: F.when(name(x, F.lower(x)), "#w").otherwise(F.lower(x))

    def one(x: Column, i: Column) -> Column:
        before = F.coalesce(number(F.get(F.col(raw), i - 1)), F.lit(False))
        return F.when(number(x), "#n").when(before & F.array_contains(known, F.lower(x)), "#u").otherwise(plain(x))

    return F.when(F.col(numbered), F.transform(raw, one)).otherwise(F.transform(raw, plain))


def _held(df: DataFrame, keep: list[str], made: list[Column]) -> DataFrame:
    """df[keep] and the new columns, computed once a row: the generator keeps the optimizer from moving their
    expressions into the functions that later run for every window."""
    return df.select(*keep, F.inline(F.array(F.struct(*made))))


def _cut(texts: DataFrame, keys: list[str], least: int) -> DataFrame:
    """keys, raw and can: the raw and the canonical tokens of the texts that have `least` of them."""
    text = F.col("text")
    raw = _held(texts, keys, [tokens(text).alias("raw"), F.coalesce(text.rlike("\\p{N}"), F.lit(False)).alias("numbered")])
    return _held(raw.where(F.size("raw") >= least), [*keys, "raw"], [canonical("raw", "numbered").alias("can")])


def _slot(x: Column) -> Column:
    return x.startswith("#")


def windows(texts: DataFrame, keys: list[str], sizes: list[int], dense: bool = True) -> DataFrame:
    """keys, pos, size, by_value and hash of all windows of these sizes. Each has a row with the hash of its template
    (by_value false); with `dense`, those of texts with slots also have one with the hash of their slots' values.
    texts: keys and text."""
    cut = _cut(texts, keys, min(sizes))
    made = _held(cut, keys, [F.transform("can", lambda x: F.xxhash64(x)).alias("h"), F.lit(False).alias("by_value")])
    if dense:
        valued = F.zip_with("can", "raw", lambda c, r: F.xxhash64(c, F.when(_slot(c), F.lower(r))))
        made = made.unionByName(_held(cut.where(F.exists("can", _slot)), keys, [valued.alias("h"), F.lit(True).alias("by_value")]))
    def of(size: int) -> DataFrame:
        last = F.size("h") - size
        hashes = F.transform(F.sequence(F.lit(0), last), lambda i: F.xxhash64(F.lit(size), F.slice("h", i + 1, size)))
        return made.where(last >= 0).select(*keys, F.lit(size).alias("size"), "by_value", F.posexplode(hashes).alias("pos", "hash"))

    out = of(sizes[0])
    for size in sizes[1:]:
        out = out.unionByName(of(size))
    return out


def _places(texts: DataFrame, keys: list[str]) -> DataFrame:
    """keys, pos, size and slots (at and value of the placeholders) of the windows at the texts' places. texts: keys,
    text and places (pos and size)."""
    cut = _cut(texts, [*keys, "places"], 1)
    window = lambda p: F.struct(p["pos"].alias("pos"), p["size"].alias("size"), F.slice("raw", p["pos"] + 1, p["size"]).alias("raw"), F.slice("can", p["pos"] + 1, p["size"]).alias("can"))
    found = cut.select(*keys, F.inline(F.transform("places", window)))
    return found.select(*keys, "pos", "size", _slots("can", "raw").alias("slots"))


def _slots(can: str, raw: str) -> Column:
    """(at, value) of a window's placeholders: place in the window, type and value."""
    pairs = F.transform(F.arrays_zip(F.col(can).alias("c"), F.col(raw).alias("r")), lambda x, i: F.struct(i.alias("at"), F.when(x["c"].startswith("#"), F.concat(x["c"], F.lower(x["r"]))).alias("value")))
    return F.filter(pairs, lambda x: x["value"].isNotNull())


def matches(docs: DataFrame, benchmark: DataFrame, window: int = 8, least: int = 13, most_broadcast: int = 500_000) -> DataFrame:
    """doc_id, item_id, start (token), tokens (of the longest consistent stretch), item_tokens and slots (tokens of the
    stretch that are slots) of each leaked pair. benchmark: item_id and text."""
    item = ["item_id", "item_hash"]
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("item_id is not null").distinct()
    lengths = items.select("item_id", F.xxhash64("text").alias("item_hash"), "text", F.size(tokens(F.col("text"))).alias("item_tokens")).where("item_tokens > 0")
    short = sorted(r["n"] for r in lengths.where(F.col("item_tokens") < window).select(F.col("item_tokens").alias("n")).distinct().collect())  # window - 1 at most
    size = F.least(F.col("item_tokens"), F.lit(window))
    every = F.transform(F.sequence(F.lit(0), F.col("item_tokens") - size), lambda i: F.struct(i.alias("pos"), size.alias("size")))
    slots = _places(lengths.select(*item, "text", every.alias("places")), item)
    marks = windows(lengths.select(*item, "text"), item, [window, *short]).join(slots, [*item, "pos", "size"])
    marks = marks.where((F.size("slots") * 2 > F.col("size")) == F.col("by_value")).join(lengths.select(*item, "item_tokens"), item)
    marks = marks.where(F.col("size") == F.least(F.col("item_tokens"), F.lit(window)))
    marks = staged(marks.select("hash", "by_value", *item, F.col("pos").alias("item_pos"), F.col("slots.value").alias("item_slots"), "item_tokens"), "benchmark-windows")
    few = marks.limit(most_broadcast + 1).count() <= most_broadcast
    dense = not marks.where("by_value").isEmpty()

    # Hashes first: where the documents' windows meet the benchmark's.
    own = ["doc_id", "doc_hash"]
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.col("text").cast("string")).alias("doc_hash"), F.col("text").cast("string").alias("text")).where("doc_id is not null")
    marks = marks.drop("by_value")
    met = windows(texts, own, [window, *short], dense).drop("by_value").join(F.broadcast(marks) if few else marks, "hash")
    met = staged(met.select(*own, "pos", "size", *item, "item_pos", "item_slots", "item_tokens"), "benchmark-hits")

    # Then the slots of those windows, from the texts that have any.
    places = met.select(*own, "pos", "size").distinct().groupBy(*own).agg(F.collect_list(F.struct("pos", "size")).alias("places"), F.count(F.lit(1)).alias("n"))  # a text's own windows
    places = staged(places, "benchmark-places")
    total = places.agg(F.sum("n")).first()[0] or 0
    wanted = texts.join(F.broadcast(places.drop("n")) if total <= most_broadcast * 4 else places.drop("n"), own)
    found = _places(wanted, own).dropDuplicates([*own, "pos", "size"])
    values = F.zip_with("slots", "item_slots", lambda d, i: F.struct((F.col("pos") + d["at"]).alias("t"), i.alias("i"), d["value"].alias("d")))
    line = [*own, *item, "size", "diagonal"]
    hits = met.join(found, [*own, "pos", "size"]).select(*own, *item, "size", (F.col("pos") - F.col("item_pos")).alias("diagonal"), "pos", "item_tokens", values.alias("slots"))
    hits = hits.repartition(*own, *item).dropDuplicates([*line, "pos"])

    # Runs, and in each of them a row for every window's start and every slot.
    order = Window.partitionBy(*line).orderBy("pos")
    far = F.coalesce(F.col("pos") - F.lag("pos").over(order) > F.col("size"), F.lit(True))
    hits = hits.withColumn("far", far.cast("int")).withColumn("run", F.sum("far").over(order))
    run = [*line, "run"]
    whole = Window.partitionBy(*run)
    hits = hits.withColumns({"first": F.min("pos").over(whole), "stop": F.max("pos").over(whole) + F.col("size")})
    start = F.array(F.struct(F.col("pos").alias("t"), F.lit(None).cast("string").alias("i"), F.lit(None).cast("string").alias("d")))
    places = hits.select(*run, "first", "stop", "item_tokens", F.inline(F.concat(start, "slots"))).dropDuplicates([*run, "t", "i"])

    # The last earlier slot that a slot contradicts, and from there the consistent stretches.
    against = []
    for same, other in (("i", "d"), ("d", "i")):
        by = Window.partitionBy(*run, same).orderBy("t")
        name = f"against_{same}"
        places = places.withColumn(name, F.when(F.lag(other).over(by) != F.col(other), F.lag("t").over(by))).withColumn(name, F.when(F.col(same).isNotNull(), F.max(name).over(by)))
        against.append(F.coalesce(name, F.lit(-1)))
    places = places.withColumn("after", F.max(F.greatest(*against)).over(Window.partitionBy(*run).orderBy("t")))
    parts = places.groupBy(*run, "first", "stop", "item_tokens", "after").agg(F.min("t").alias("t"), F.count("i").alias("slots"))
    end = F.coalesce(F.lead("t").over(Window.partitionBy(*run).orderBy("after")), F.col("stop"))
    begin = F.greatest(F.col("after") + 1, F.col("first"))
    good = parts.withColumns({"start": begin, "tokens": end - begin}).where(F.col("tokens") >= F.least(F.lit(least), F.col("item_tokens")))
    best = good.groupBy("doc_id", "item_id").agg(F.max(F.struct("tokens", (-F.col("start")).alias("s"), F.col("item_tokens").alias("t"), F.col("slots").alias("n"))).alias("m"))
    return best.select("doc_id", "item_id", (-F.col("m.s")).alias("start"), F.col("m.tokens").alias("tokens"), F.col("m.t").alias("item_tokens"), F.col("m.n").cast("int").alias("slots"))


def drop_leaked(docs: DataFrame, benchmark: DataFrame, window: int = 8, least: int = 13) -> DataFrame:
    """docs without the documents that hold a benchmark passage."""
    key = fresh(docs.columns, "leaked")
    leaked = staged(matches(docs, benchmark, window, least).select(F.col("doc_id").alias(key)).distinct(), "leaked-documents")
    return docs.join(leaked, F.col("doc_id").cast("long") == F.col(key), "left_anti")
