import random

import duckdb
import pytest

from panelyard.llm import decontamination, quality_rules


@pytest.fixture
def bench(spark):
    items = [(0, "The train left Paris at 9 in the morning and was due after 450 km at noon."), (1, "short one"), (2, None), (3, "Add 5 apples and 5 pears , then take 7 plums away from them all .")]
    return spark.createDataFrame(items, "item_id long, text string")


def test_reparameterised_questions(docs, bench):
    texts = [
        "filler words here. The train left Paris at 9 in the morning and was due after 450 km at noon. More.",
        "Yes: the train left Madrid at 7 in the morning and was due after 300 miles at noon.",
        "Add 8 apples and 8 pears , then take 2 plums away from them all .",
        "Add 8 apples and 9 pears , then take 2 plums away from them all .",
        "A clean text about a train that left in the morning.",
        None,
        "",
        "9 9 9 9 9 9 9 9 9 9 9",
    ]
    out = {r.doc_id: r for r in decontamination.contamination(docs([*texts[:5], *texts[5:], texts[0]]), bench).collect()}
    assert [out[i].contaminated for i in range(len(texts) + 1)] == [True, True, True, False, False, False, False, False, True]
    kept = decontamination.clean(docs(texts), bench)
    assert kept.columns == docs(texts).columns and {r.doc_id for r in kept.collect()} == {3, 4, 5, 6, 7}


def test_numbers_with_marks_and_in_words(docs, spark):
    items = ["Tom has $48 and gives his sister $20 of it before they go home again.", "She read five books in June and seven books in July but only two after that.", "The set holds twenty-five cups (x2 if you ask) and costs -3 points a day on the list."]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    asked = ["Tom has $36 and gives his sister $15 of it before they go home again.", "She read nine books in June and four books in July but only three after that.", "The set holds forty-one cups (x3 if you ask) and costs -8 points a day on the list."]
    clean = ["Tom has money and gives his sister most of it before they go home again.", "She read many books in June and more books in July but only some after that."]
    table = docs([*asked, *clean, *items, "€5 5€ five - x", "x -- twenty-one-"])
    got = sorted(map(tuple, decontamination.contamination(table, bench).collect()))
    assert [r[3] for r in got] == [True] * 3 + [False] * 2 + [True] * 3 + [False] * 2
    con = duckdb.connect()
    con.register("documents", table.toPandas())
    con.register("benchmark", bench.toPandas())
    assert got == sorted(con.execute(decontamination.SQL).fetchall())


def test_clean_finds_verbatim_copies_anywhere(docs, spark):
    items = ["What is the largest planet in the solar system?", "Paris is 9 km from Berlin by 2 roads and then 7 Rivers to Rome.", "Name Three Great Lakes Of Old Africa Today.", "3 km 4 km 5 km 6 km 7 km", "Who ran?", None, ""]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    texts = [f"{before} {item} {after}" for item in items[:5] for before in ("Question:", '"', "so,", "End.", "and (") for after in ("", "And more follows here.")]
    clean = ["The largest planet in the system is what we saw.", "Who ever ran?", "3 km 5 km 4 km 6 km 7 km", "Question: What was the largest planet in the solar system?", None, ""]
    kept = decontamination.clean(docs([*texts, *clean]), bench)
    assert sorted(r.doc_id for r in kept.collect()) == list(range(len(texts), len(texts) + len(clean)))


def test_broadcast_and_shuffle_agree(docs, bench, monkeypatch):
    texts = ["The train left Paris at 9 in the morning and was due after 450 km at noon.", "nothing"]
    one = decontamination.contamination(docs(texts), bench).collect()
    monkeypatch.setattr(decontamination, "BROADCAST_ROWS", 0)
    assert sorted(one) == sorted(decontamination.contamination(docs(texts), bench).collect())


def test_sql_agrees_on_bindings_and_very_words(docs, bench, spark):
    items = [*(tuple(r) for r in bench.collect()), (7, "3 km 4 km 5 km 6 km 7 km"), (8, "Who ran?"), (9, "Rome beat Pisa by 3 and Rome beat Bari by 4 in the cup that year .")]
    own = spark.createDataFrame(items, "item_id long, text string")
    said = "{} beat {} by 8 and {} beat {} by 9 in the cup that year ."
    texts = [*(x[1] for x in items), said.format("Ulm", "Hof", "Ulm", "Jena"), said.format("Ulm", "Hof", "Hof", "Jena"), said.format("Ulm", "Jena", "Ulm", "Jena"), "so who ran away, 3 km 4 km 5 km 6 km 7 km", "", None]
    table = docs([*texts, (3, texts[0]), (3, texts[0]), (None, texts[0])])
    got = sorted(map(tuple, decontamination.contamination(table, own).collect()), key=str)
    con = duckdb.connect()
    con.register("documents", table.toPandas())
    con.register("benchmark", own.toPandas())
    assert got == sorted(con.execute(decontamination.SQL).fetchall(), key=str)
    hit = {r[0] for r in got if r[3]}
    n = len(items)
    assert {n, n + 3} <= hit and not {n + 1, n + 2, None} & hit  # one binding for all windows


def test_empty_tables(docs, bench, spark):
    assert decontamination.contamination(docs([]), bench).count() == 0
    none = spark.createDataFrame([], "item_id long, text string")
    assert [r.contaminated for r in decontamination.contamination(docs(["a b c d e f g h i"]), none).collect()] == [False]
    assert decontamination.contamination(docs([(None, "x"), (1, "y"), (1, "y")]), bench).count() == 2 + 1


def test_quality_equals_sql(docs, edges):
    r = random.Random(8)
    line = lambda: " ".join(r.choice("the of and to cat dog sat ran THE Who? 12 x## a, b.".split()) for _ in range(r.randint(0, 40)))
    texts = [*edges, *("\n".join(r.choice([a, a, line()]) for a in [line()] * r.randint(1, 6)) for _ in range(40))]
    own = docs(texts)
    got = sorted(tuple(x) for x in quality_rules.verdicts(own).drop("class_distance", "common_distance").collect())
    documents = own.toPandas()  # noqa: F841
    con = duckdb.connect()
    con.register("documents", documents)
    rel = con.execute(quality_rules.SQL)
    names = [d[0] for d in rel.description]
    order = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    assert got == sorted(tuple(row[names.index(c)] for c in order) for row in rel.fetchall())


def test_repeat_words_by_hand(docs):
    eight = "a b c d e f g h"
    rows = quality_rules.features(docs([f"{eight} x {eight}", "a " * 20, None, ""])).collect()
    assert [x.n_repeat_words for x in sorted(rows, key=lambda x: x.doc_id)] == [16, 20, 0, 0]
    assert quality_rules.verdicts(docs([])).count() == 0
    assert quality_rules.verdicts(docs([(None, "a"), (1, "a"), (1, "a")])).count() == 3


def test_a_language_of_junk_is_no_measure(spark):
    r = random.Random(3)
    prose = lambda: " ".join(r.choice("the of and to a cat dog sat ran for with on is it was river, stone. Wind".split()) for _ in range(150))
    junk = lambda: " ".join(r.choice(["#$%", "&&|", "<*>", "%%$#"]) + r.choice("abcdefgh") + str(r.randint(0, 999)) for _ in range(60))
    rows = [(i, prose(), "en") for i in range(20)] + [(100 + i, junk(), lang) for i in range(20) for lang in ("xx", None)] + [(200, prose(), "yy")]
    out = {x.doc_id: x.kept for x in quality_rules.verdicts(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert all(out[i] for i in range(20)) and out[200] and not any(out[100 + i] for i in range(20))
