"""Ranked search against scoring every document."""

import math
import re
from collections import Counter

import pytest

from panelyard.llm import lexical_search as ls

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items, top=20):
    counted = [(i, Counter(terms(t))) for i, t in docs]
    n = sum(bool(c) for _, c in counted)
    length = sum(sum(c.values()) for _, c in counted)
    df = Counter(t for _, c in counted for t in c)
    out = []
    for item, text in items:
        rows = []
        for i, c in counted:
            m = 75 + (25 * sum(c.values()) * n) // length if length else 0
            score = sum(q * math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((1_000_000_000 * c[t]) // (1000 * c[t] + 12 * m)) for t, q in Counter(terms(text)).items() if t in c)
            if score > 0:
                rows.append((-score, i is None, i if i is not None else 0, i))
        out += [(item, k, r[3], -r[0]) for k, r in enumerate(sorted(rows)[:top], 1)]
    return sorted(out, key=str)


def found(spark, docs, items):
    d = spark.createDataFrame([(i, t, 1, 2.0, 3) for i, t in docs], "doc_id long, text string, n int, score double, item int").repartition(3)
    b = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, rank string").coalesce(1)
    got = ls.ranked_search(d, b)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    return sorted((tuple(r) for r in got.collect()), key=str)


@pytest.fixture
def corpus(edges):
    words = [f"w{i}" for i in range(40)]
    docs = [(i, " ".join(words[(i * k) % (7 + i % 33)] for k in range(1, 5 + i % 17))) for i in range(120)]
    docs += [(200 + i, t) for i, t in enumerate(edges)] + [(None, "w1 w2 w3"), (None, "w1 w2 w3"), (5, "w5 w5"), (5, "w5 w5"), (300, "Ünïcode-TEST w1,w2.W3 中文" * 3), (301, "w1 " * 5000)]
    items = [(k, " ".join(words[k % 5 : k % 5 + 9])) for k in range(12)] + [(50, "w1 w1 w1 unknown"), (51, None), (52, "..."), (53, "test 中文w1"), (54, " ".join(words * 2 + [f"z{i}" for i in range(90)])), (54, "w39"), (None, "w3 w4")]
    return docs, items


def test_against_all_scores(spark, corpus):
    assert found(spark, *corpus) == brute(*corpus)


def test_small_blocks_and_item_groups(spark, corpus, monkeypatch):
    monkeypatch.setattr(ls, "BLOCK_ROWS", 8)
    monkeypatch.setattr(ls, "BLOCK_TERMS", 12)
    monkeypatch.setattr(ls, "AT_ONCE", 1)
    assert found(spark, *corpus) == brute(*corpus)


def test_ties_beyond_the_last_rank(spark):
    docs = [(i, "same words here") for i in range(70)] + [(100, "others")]
    got = found(spark, docs, [(1, "words")])
    assert [r[2] for r in sorted(got, key=lambda r: r[1])] == list(range(20)) and got == brute(docs, [(1, "words")])


def test_empty_tables(spark):
    assert found(spark, [], [(1, "a")]) == [] and found(spark, [(1, "a")], []) == [] and found(spark, [(1, None)], [(1, "a")]) == []
