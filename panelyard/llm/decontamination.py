"""Benchmark decontamination by template windows (DataFrame functions only).

Texts become templates: a number is <num>, whether in digits (behind signs, currency marks and
brackets, or an x, too) or in words, a unit of measure is <unit>, a capitalised word is <name>
(unless it is one of OPENERS, the words that often begin a sentence), any other word is itself in
lower case without its outer punctuation. What a word becomes does not depend on the
words beside it, so a passage has the same template wherever it stands.

A benchmark item is known by its windows of WINDOW template tokens (an item with fewer tokens, but
SHORTEST at least, by one window of them all). Windows with fewer than LITERAL of their tokens
literal say too little and are not used; an item that is left without windows is known by the
windows of its very words, of any number. All windows of a text are joined by hash with those of
the items. For texts that are hit the tokens are compared, and the slots of all windows at one
alignment of a text with an item must have one binding: each of the item's values stands for one
value of the text and the other way round. A window whose values break the binding speaks against
the alignment, however many others fit.

A text is contaminated by an item if an alignment has a binding and REQUIRED different windows of
the item (all, if it has fewer). The items' windows are broadcast only when a count shows at most
BROADCAST_ROWS of them; otherwise the same join shuffles by hash.

Rows: a null or empty text matches nothing. Repeated rows and ids give a row each, judged by its
own text. A null doc_id matches nothing. Null item texts are left out, repeated items count each.
Empty tables give an empty or an all-clean result. Other columns are ignored, or kept by clean().
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelyard.llm.runtime import written

WINDOW, SHORTEST, REQUIRED = 8, 4, 4
LITERAL = 0.6
BROADCAST_ROWS = 200_000
# fixed values: what is cut from a token's ends, what may stand before digits, number words, units of
# measure, and words that begin sentences
OUTER = ".,;:!?\"'()[]{}«»“”„…"
DIGITS = r"^[^\p{L}0-9]*[xX]?[0-9]"
NUMBERS = "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million billion dozen".split()
UNITS = "mm cm m km mg kg g t ml l kb mb gb tb ms s sec second seconds min minute minutes h hour hours day days week weeks month months year years inch inches foot feet yard yards mile miles ounce ounces pound pounds ton tons gallon gallons percent degree degrees dollar dollars euro euros cent cents usd eur gbp meter meters metre metres kilometer kilometers kilometre kilometres gram grams kilogram kilograms liter liters litre litres watt watts volt volts".split()
OPENERS = "a add all an and are as at but by calculate can consider could did do does each every explain find for from given he her his how i if in is it its let my name not of on one or our she should some suppose that the their then there these they this those to two under was we were what when where which while who whom whose why will with would write you your das der die ein eine es für ich im in ist mit sie und von was wenn wer wie wo zu ce cette de des elle en est et il la le les où par pour que quel quelle qui si un une con cuál cuando cómo del donde el en es la las los no para por qué se su una y".split()


def _words(text: Column) -> Column:
    return F.filter(F.split(text, r"[ \t-\r]+"), lambda w: w != "")


def _slot(core: Column) -> Column:
    """'<num>', '<unit>', '<name>' or null for a literal; core has no outer punctuation."""
    first, low = F.ascii(core), F.lower(core)
    capital = (F.left(core, F.lit(1)) != F.left(low, F.lit(1))) & (F.char_length(core) > 1) & (F.substr(core, F.lit(2)) == F.substr(low, F.lit(2)))
    marked = ~first.between(97, 119) & ~first.between(65, 87) & core.rlike(DIGITS)  # few words come to the pattern
    counted = low.isin(*NUMBERS) | (low.contains("-") & F.forall(F.split(low, "-"), lambda x: x.isin(*NUMBERS)))
    return F.when(((first >= 48) & (first <= 57)) | marked | counted, F.lit("<num>")).when(capital & ~low.isin(*OPENERS), F.lit("<name>")).when(low.isin(*UNITS), F.lit("<unit>"))


def templates(df: DataFrame, keys: list[str], text: str) -> DataFrame:
    """The keys, tokens and slots: template tokens, and the lower-case values of slots (null
    elsewhere). Words of punctuation alone are no tokens."""
    cores = F.filter(F.transform(_words(F.coalesce(F.col(text), F.lit(""))), lambda w: F.btrim(w, F.lit(OUTER))), lambda c: c != "")
    typed = df.select(*keys, F.transform(cores, lambda c: F.struct(_slot(c).alias("t"), F.lower(c).alias("v"))).alias("z"))
    return typed.select(
        *keys,
        F.transform("z", lambda x: F.coalesce(x["t"], x["v"])).alias("tokens"),
        F.transform("z", lambda x: F.when(x["t"].isNotNull(), x["v"])).alias("slots"),
    )


def _values() -> Column:
    return F.transform(F.arrays_zip("tokens", "slots"), lambda z: F.coalesce(z["slots"], z["tokens"]))


def _hashes(tokens: Column) -> Column:
    return F.transform(tokens, lambda t: F.xxhash64(t))


def windows(texts: DataFrame, keys: list[str], sizes: list[int]) -> DataFrame:
    """The keys, size, i and h for templates(): a row for each window of each of the sizes, i from
    1. Negative sizes are windows of that many very words."""
    verbatim = _hashes(_values()) if min(sizes) < 0 else F.lit(None).cast("array<bigint>")
    hashed = texts.select(*keys, _hashes(F.col("tokens")).alias("hs"), verbatim.alias("vs"))

    def of(size: int) -> Column:
        own, n = F.col("hs" if size > 0 else "vs"), abs(size)
        starts = F.when(F.size(own) >= n, F.sequence(F.lit(1), F.size(own) - (n - 1))).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: F.struct(F.lit(size).alias("size"), i.alias("i"), F.xxhash64(F.slice(own, i, n)).alias("h")))

    parts = [of(size) for size in sizes]
    return hashed.select(*keys, F.inline(parts[0] if len(parts) == 1 else F.concat(*parts)))


def items_and_windows(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(item_id, want, values, slots, needed): the items' tokens, and how many different windows a
    match needs; and (item_id, size, at, h): their telling windows, from token at on. Items without
    any have windows of their very words, of negative sizes."""
    texts = benchmark.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("item_id"), F.col(text_col).alias("text"))
    items = templates(texts, ["item_id"], "text").where(F.size("tokens") > 0).withColumn("size", F.least(F.lit(WINDOW), F.size("tokens")))
    # rows, not ids: an id may stand there twice
    items = written(items.withColumn("item", F.monotonically_increasing_id()), "items")

    def cut(rows: DataFrame) -> DataFrame:
        place = F.explode(F.sequence(F.lit(1), F.size("tokens") - F.col("size") + 1)).alias("at")
        return rows.select("item", "size", "tokens", "slots", place).select("item", "size", "at", *(F.slice(c, F.col("at"), F.col("size")).alias(c) for c in ("tokens", "slots")))

    literal = F.size(F.filter("slots", lambda s: s.isNull()))
    told = cut(items.where(F.size("tokens") >= SHORTEST)).where(literal >= LITERAL * F.col("size"))
    mute = cut(items.withColumn("tokens", _values()).join(told.select("item").distinct(), "item", "left_anti")).withColumn("size", -F.col("size"))
    known = written(told.unionByName(mute).select("item", "size", "at", F.xxhash64(_hashes(F.col("tokens"))).alias("h")), "item-windows")
    needed = known.groupBy("item").agg(F.least(F.lit(REQUIRED), F.count_distinct("h")).alias("needed"))
    return items.join(needed, "item").select("item", "item_id", F.col("tokens").alias("want"), _values().alias("said"), F.col("slots").alias("from"), "needed"), known


def matches(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, dk, item_id, n_windows) for each item that contaminates a text; dk is its hash."""
    keys = ["doc_id", "dk"]
    items, known = items_and_windows(benchmark)
    sizes = sorted(r["size"] for r in known.select("size").distinct().collect()) or [WINDOW]  # at most 2 * WINDOW
    small = F.broadcast(known) if known.count() <= BROADCAST_ROWS else known
    texts = docs.where("doc_id is not null").select("doc_id", _text_key().alias("dk"), F.coalesce("text", F.lit("")).alias("text"))
    hits = windows(templates(texts, keys, "text"), keys, sizes).join(small, ["size", "h"])
    # an alignment has no more windows than its item
    windows_at = F.collect_set(F.struct("size", "at", "h")).alias("windows")
    aligned = written(hits.groupBy(*keys, "item", (F.col("i") - F.col("at")).alias("place")).agg(windows_at), "aligned")
    aligned = aligned.join(items, "item").where(F.size(F.array_distinct(F.col("windows.h"))) >= F.col("needed"))
    # the few texts that are hit, once more with their tokens
    which = written(aligned.select(*keys).distinct(), "hit")
    again = templates(texts.join(which, keys, "left_semi").dropDuplicates(keys), keys, "text")
    both = aligned.join(again.withColumn("values", _values()), keys)

    def equal(w: Column) -> Column:
        own = lambda name: F.slice(name, w["at"] + F.col("place"), F.abs(w["size"]))
        of = lambda name: F.slice(name, w["at"], F.abs(w["size"]))
        return F.when(w["size"] > 0, own("tokens") == of("want")).otherwise(own("values") == of("said"))

    def stands_for(value: Column, i: Column) -> Column:
        there = F.get("tokens", F.col("place") + i) == F.get("want", i)
        return F.when(value.isNotNull() & there, F.struct(value.alias("a"), F.get("values", F.col("place") + i).alias("b")))

    bound = F.array_distinct(F.filter(F.transform("from", stands_for), lambda x: x.isNotNull()))
    per = both.select(*keys, "item", "item_id", "needed", F.size(F.array_distinct(F.transform(F.filter("windows", equal), lambda w: w["h"]))).alias("n"), bound.alias("bound"))
    side = lambda name: F.size(F.array_distinct(F.transform("bound", lambda x: x[name])))
    one = (side("a") == F.size("bound")) & (side("b") == F.size("bound"))
    return per.where(one & (F.col("n") >= F.col("needed"))).groupBy(*keys, "item", "item_id").agg(F.max("n").alias("n_windows")).drop("item")


def _text_key(text: Column | str = "text") -> Column:
    return F.xxhash64(F.coalesce(text, F.lit("")))


def contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Per row of docs: doc_id, n_items, n_windows (of those items), contaminated."""
    per = written(matches(docs, benchmark).groupBy("doc_id", "dk").agg(F.count("*").alias("n_items"), F.sum("n_windows").alias("n_windows")), "contaminated")
    zero = F.lit(0).cast("long")
    rows = docs.select("doc_id", _text_key().alias("dk")).join(per, ["doc_id", "dk"], "left")
    return rows.select("doc_id", F.coalesce("n_items", zero).alias("n_items"), F.coalesce("n_windows", zero).alias("n_windows"), F.col("n_items").isNotNull().alias("contaminated"))


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that no benchmark item contaminates, all columns kept."""
    # written, so that Spark knows its size and deals the documents only where it is large
    hit = written(matches(docs, benchmark).select(F.col("doc_id").alias("_hit"), F.col("dk").alias("_dk")).distinct(), "contaminated")
    return docs.join(hit, (docs["doc_id"] == hit["_hit"]) & (_text_key(docs["text"]) == hit["_dk"]), "left_anti")


def _quoted(words: list[str]) -> str:
    return ", ".join("'" + w.replace("'", "''") + "'" for w in words)


def _templates_sql(table: str, key: str, where: str) -> str:
    return f"""
  SELECT k, list_transform(z, lambda x: coalesce(x.t, x.v)) AS tokens, list_transform(z, lambda x: x.v) AS vals,
         list_transform(z, lambda x: x.t IS NOT NULL) AS slot
  FROM (SELECT k, list_transform(list_filter(list_transform(w, lambda x: trim(x, '{OUTER.replace("'", "''")}')), lambda c: c <> ''), lambda c: struct_pack(
          t := CASE WHEN regexp_matches(c, '{DIGITS}') OR len(list_filter(string_split(lower(c), '-'), lambda x: NOT list_contains([{_quoted(NUMBERS)}], x))) = 0 THEN '<num>'
                    WHEN length(c) > 1 AND c[1] <> lower(c[1]) AND c[2:] = lower(c[2:]) AND NOT list_contains([{_quoted(OPENERS)}], lower(c)) THEN '<name>'
                    WHEN list_contains([{_quoted(UNITS)}], lower(c)) THEN '<unit>' END,
          v := lower(c))) AS z
        FROM (SELECT {key} AS k, list_filter(regexp_split_to_array(coalesce(text, ''), '[ \t-\r]+'), lambda x: x <> '') AS w FROM {table} WHERE {where}))
"""


SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, text FROM documents),
bench AS (SELECT row_number() OVER () AS item, text FROM benchmark),
texts AS ({_templates_sql("d", "r", "doc_id IS NOT NULL")}),
items AS (SELECT *, least({WINDOW}, len(tokens)) AS size FROM ({_templates_sql("bench", "item", "text IS NOT NULL")}) WHERE len(tokens) > 0),
cut AS (SELECT k AS item, size, i, len(tokens) AS n, tokens[i:i + size - 1] AS w, vals[i:i + size - 1] AS v, slot[i:i + size - 1] AS s
        FROM (SELECT *, unnest(range(1, len(tokens) - size + 2)) AS i FROM items)),
told AS (SELECT item, size, i, array_to_string(w, ' ') AS h FROM cut
         WHERE n >= {SHORTEST} AND len(list_filter(s, lambda x: NOT x)) >= {LITERAL} * size),
known AS (SELECT * FROM told UNION ALL
          SELECT item, -size, i, array_to_string(v, ' ') FROM cut WHERE item NOT IN (SELECT item FROM told)),
needs AS (SELECT item, least({REQUIRED}, count(DISTINCT h)) AS needed FROM known GROUP BY item),
own AS (SELECT k AS r, size, j, array_to_string(CASE WHEN size > 0 THEN tokens[j:j + size - 1] ELSE vals[j:j - size - 1] END, ' ') AS h
        FROM (SELECT *, unnest(range(1, len(tokens) - abs(size) + 2)) AS j
              FROM texts, (SELECT DISTINCT size FROM known) WHERE len(tokens) >= abs(size))),
hit AS (SELECT r, item, j - i AS place, count(DISTINCT h) AS n FROM own JOIN known USING (size, h) GROUP BY r, item, place),
fit AS (SELECT r, item, n, list_distinct(list_filter(list_transform(range(1, len(b.tokens) + 1), lambda q: CASE WHEN b.slot[q] AND place + q >= 1 AND t.tokens[place + q] = b.tokens[q]
          THEN struct_pack(a := b.vals[q], b := t.vals[place + q]) END), lambda q: q IS NOT NULL)) AS b
        FROM hit JOIN needs USING (item) JOIN texts t ON t.k = r JOIN items b ON b.k = item WHERE n >= needed),
per AS (SELECT r, item, max(n) AS n FROM fit
        WHERE len(list_distinct(list_transform(b, lambda q: q.a))) = len(b) AND len(list_distinct(list_transform(b, lambda q: q.b))) = len(b)
        GROUP BY r, item),
told_rows AS (SELECT r, count(*) AS n_items, sum(n) AS n_windows FROM per GROUP BY r)
SELECT doc_id, coalesce(n_items, 0)::BIGINT AS n_items, coalesce(n_windows, 0)::BIGINT AS n_windows, n_items IS NOT NULL AS contaminated
FROM d LEFT JOIN told_rows USING (r)
"""
