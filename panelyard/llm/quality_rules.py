"""Quality rules by distribution divergence (DataFrame functions only).

Base counts come first: words, their characters, symbols, repeated lines, and words inside 8-word
windows that occur twice or more. A text fails the base rules if it has under MIN_WORDS words or
over REPEATED % of them in repeated windows.

What is left is judged by Jensen-Shannon distances (the root of the divergence, base 2) to its
language's reference: of character classes (other, upper case, digit, white space, punctuation,
symbol) and of common words. References are fitted from the clean rows of the languages with a
list in COMMON: all texts that pass the base rules with COMMON_WORDS words or more and symbols in
at most CLEAN_SYMBOLS % of their characters, whatever share of the table they are. A language
without a list is held to the reference of all clean rows together, by character classes alone,
so a body of junk can't be its own measure. Short texts are noisy, so the distances count only
from CLASS_WORDS and COMMON_WORDS words on. A text over either limit isn't kept. A language in the
list without any clean row has no reference: its texts are judged by the base rules alone.

Rows: a null text has no words and fails. A null lang is a language without a list.
Repeated rows and ids give a row each. An empty table gives an empty result. Other columns are
ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelyard.llm.runtime import written

WINDOW = 8
MIN_WORDS, REPEATED = 20, 30
CLASS_WORDS, CLASS_LIMIT = 20, 0.265
COMMON_WORDS, COMMON_LIMIT = 100, 0.283
CLEAN_SYMBOLS = 5
SYMBOLS = r"[#*$%&|<>]"
#: Character classes after "other"; white space follows from the words.
CLASSES = {"upper": r"\p{Lu}+", "digit": r"[0-9]+", "punctuation": r"[.,;:!?'\"()-]+", "symbol": r"[#*$%&|<>]+"}
# fixed values: common words of each language
COMMON = {
    "en": "the of and to a in is that it for was on with as be by this are at from not have or an".split(),
    "de": "der die und in den von zu das mit sich des auf für ist im nicht dem ein eine als auch es an werden".split(),
    "fr": "de la le et les des en un du une que pour est par dans qui avec pas sur au plus ce se ne".split(),
    "es": "de la que el en y los se las del un por con no su una para es al lo como más pero sus".split(),
}
_BINS = "".join(chr(ord("A") + i) for i in range(25))  # A: another word


def _count(text: Column, pattern: str) -> Column:
    return F.char_length(text) - F.char_length(F.regexp_replace(text, pattern, ""))


def features(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, lang, the base counts, and the histograms classes and common."""
    text = docs.select("doc_id", "lang", F.coalesce("text", F.lit("")).alias("text"))
    base = text.select("doc_id", "lang", "text", F.filter(F.split("text", r"[ \t-\r]+"), lambda w: w != "").alias("w"))
    lists = F.coalesce(*(F.when(F.col("lang") == k, F.array(*map(F.lit, v))) for k, v in COMMON.items()))
    bare = lambda w: F.lower(F.btrim(w, F.lit(".,")))
    bins = F.array_join(F.transform("w", lambda w: F.substr(F.lit(_BINS), F.coalesce(F.array_position(F.col("list"), bare(w)), F.lit(0)).cast("int") + 1, F.lit(1))), "")
    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^ \t-\r]"))
    counted = base.withColumn("list", lists).select(
        "doc_id",
        "lang",
        F.size("w").cast("long").alias("n_words"),
        F.char_length(F.array_join("w", "")).cast("long").alias("word_chars"),
        F.char_length("text").alias("n"),
        *(_count(F.col("text"), p).cast("long").alias(k) for k, p in CLASSES.items()),
        lines.alias("lines"),
        F.transform("w", lambda w: F.xxhash64(w)).alias("hs"),
        F.when(F.col("list").isNotNull(), bins).alias("bins"),
    )
    starts = F.when(F.size("hs") >= WINDOW, F.sequence(F.lit(1), F.size("hs") - (WINDOW - 1))).otherwise(F.array().cast("array<int>"))
    windows = counted.withColumn("win", F.transform(starts, lambda i: F.xxhash64(F.slice("hs", i, WINDOW)))).drop("hs")
    # only texts with an equal pair of windows are sorted
    ranked = F.when(F.size(F.array_distinct("win")) < F.size("win"), F.array_sort(F.transform("win", lambda h, i: F.struct(h.alias("h"), i.alias("i")))))
    tagged = windows.withColumn("ranked", ranked).drop("win")

    def equal(x: Column, k: Column) -> Column:
        before, after = F.get("ranked", k - 1)["h"], F.get("ranked", k + 1)["h"]
        return F.coalesce(before == x["h"], F.lit(False)) | F.coalesce(after == x["h"], F.lit(False))

    places = tagged.withColumn("at", F.sort_array(F.transform(F.filter("ranked", equal), lambda x: x["i"]))).drop("ranked")
    covered = F.transform("at", lambda s, k: F.least(F.lit(WINDOW), F.coalesce(F.get("at", k + 1) - s, F.lit(WINDOW))))
    repeated = F.coalesce(F.aggregate(covered, F.lit(0), lambda a, x: a + x), F.lit(0)).cast("long")
    space = F.col("n") - F.col("word_chars")
    rest = F.col("word_chars") - sum((F.col(k) for k in CLASSES), F.lit(0))
    return places.select(
        "doc_id",
        "lang",
        "n_words",
        "word_chars",
        F.col("symbol").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        repeated.alias("n_repeat_words"),
        F.array(rest, F.col("upper"), F.col("digit"), space.cast("long"), F.col("punctuation"), F.col("symbol")).alias("classes"),
        F.when(F.col("bins").isNotNull(), F.array(*((F.char_length("bins") - F.char_length(F.replace("bins", F.lit(b), F.lit("")))).cast("long") for b in _BINS))).alias("common"),
    )


def js_distance(counts: Column, reference: Column) -> Column:
    """Jensen-Shannon distance (base 2) of two histograms of counts."""
    total = lambda a: F.aggregate(a, F.lit(0).cast("double"), lambda s, x: s + x)

    def side(p: Column, m: Column) -> Column:
        return F.when(p > 0, p * F.log2(p / m)).otherwise(F.lit(0.0))

    def both(a: Column, b: Column) -> Column:
        p, q = a / total(counts), b / total(reference)
        return (side(p, (p + q) / 2) + side(q, (p + q) / 2)) / 2

    return F.sqrt(F.greatest(total(F.zip_with(counts, reference, both)), F.lit(0.0)))


def verdicts(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, the base counts, base_failed, kept, class_distance, common_distance."""
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > REPEATED * F.col("n_words"))
    key = F.when(F.col("lang").isin(*COMMON), F.col("lang")).otherwise("")
    own = written(features(docs).withColumns({"base_failed": failed, "key": key}), "quality")
    sums = lambda name, n: F.array(*(F.sum(F.get(name, F.lit(i))) for i in range(n)))
    clean = own.where(~F.col("base_failed") & (F.col("key") != "") & (F.col("n_words") >= COMMON_WORDS) & (100 * F.col("n_symbols") <= CLEAN_SYMBOLS * F.col("word_chars")))
    both = clean.select("classes", "common", F.explode(F.array("key", F.lit(""))).alias("_key")).groupBy("_key")
    # a row for each list and one for all: never more than a few
    reference = written(both.agg(sums("classes", 2 + len(CLASSES)).alias("all_classes"), sums("common", len(_BINS)).alias("all_common")), "references")
    judged = own.join(F.broadcast(reference), F.col("key") == F.col("_key"), "left")
    judged = judged.withColumn("class_distance", F.when(F.col("n_words") >= CLASS_WORDS, js_distance(F.col("classes"), F.col("all_classes")))).withColumn(
        "common_distance", F.when((F.col("n_words") >= COMMON_WORDS) & F.col("common").isNotNull(), js_distance(F.col("common"), F.col("all_common")))
    )
    far = (F.coalesce("class_distance", F.lit(0.0)) > CLASS_LIMIT) | (F.coalesce("common_distance", F.lit(0.0)) > COMMON_LIMIT)
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & ~far).alias("kept"), "class_distance", "common_distance")


def _jsd_sql(a: str, b: str) -> str:
    zipped = f"list_transform(range(1, len({a}) + 1), lambda i: struct_pack(p := {a}[i] / list_sum({a}), q := {b}[i] / list_sum({b})))"
    term = "CASE WHEN x.{0} > 0 THEN x.{0} * log2(x.{0} / ((x.p + x.q) / 2)) ELSE 0.0 END"
    return f"sqrt(greatest(list_sum(list_transform({zipped}, lambda x: ({term.format('p')} + {term.format('q')}) / 2)), 0))"


_LISTS = " ".join(f"WHEN '{k}' THEN [{', '.join(repr(w) for w in v)}]" for k, v in COMMON.items())
SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, lang, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, list_filter(regexp_split_to_array(text, '[ \\t-\\r]+'), lambda x: x <> '') AS w, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^ \\t-\\r]')) AS lines,
      CASE lang {_LISTS} END AS list FROM d),
win AS (SELECT r, i, array_to_string(w[i:i + {WINDOW - 1}], ' ') AS s FROM (SELECT r, w, unnest(range(1, len(w) - {WINDOW - 2})) AS i FROM w WHERE len(w) >= {WINDOW})),
again AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, s) AS n FROM win) WHERE n > 1),
rep AS (SELECT r, sum(step) AS n FROM (SELECT r, least({WINDOW}, coalesce(lead(i) OVER (PARTITION BY r ORDER BY i) - i, {WINDOW})) AS step FROM again) GROUP BY r),
c AS (SELECT w.*, length(array_to_string(w, '')) AS word_chars, {', '.join(f"length(text) - length(regexp_replace(text, '{p.replace(chr(39), chr(39) * 2)}', '', 'g')) AS n_{k}" for k, p in CLASSES.items())},
      CASE WHEN list IS NOT NULL THEN list_transform(w, lambda x: coalesce(list_position(list, lower(trim(x, '.,'))), 0)) END AS pos FROM w),
f AS (SELECT r, doc_id, lang, len(w) AS n_words, word_chars, n_symbol AS n_symbols, len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words,
      [word_chars - n_upper - n_digit - n_punctuation - n_symbol, n_upper, n_digit, length(text) - word_chars, n_punctuation, n_symbol] AS classes,
      CASE WHEN pos IS NOT NULL THEN list_transform(range(0, {len(_BINS)}), lambda k: len(list_filter(pos, lambda p: p = k))) END AS common
      FROM c LEFT JOIN rep USING (r)),
g AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {REPEATED} * n_words AS base_failed, CASE WHEN list_contains([{', '.join(repr(k) for k in COMMON)}], lang) THEN lang ELSE '' END AS key FROM f),
clean AS (SELECT * FROM g WHERE NOT base_failed AND key <> '' AND n_words >= {COMMON_WORDS} AND 100 * n_symbols <= {CLEAN_SYMBOLS} * word_chars),
ref AS (SELECT k AS of, [{', '.join(f'sum(classes[{i + 1}])' for i in range(6))}] AS all_classes, [{', '.join(f'sum(common[{i + 1}])' for i in range(len(_BINS)))}] AS all_common
        FROM (SELECT *, unnest([key, '']) AS k FROM clean) GROUP BY k),
j AS (SELECT g.*,
      CASE WHEN n_words >= {CLASS_WORDS} THEN {_jsd_sql('classes', 'all_classes')} END AS cd,
      CASE WHEN n_words >= {COMMON_WORDS} AND common IS NOT NULL THEN {_jsd_sql('common', 'all_common')} END AS wd
      FROM g LEFT JOIN ref ON key = of)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words,
       base_failed, NOT base_failed AND coalesce(cd, 0) <= {CLASS_LIMIT} AND coalesce(wd, 0) <= {COMMON_LIMIT} AS kept
FROM j
"""
