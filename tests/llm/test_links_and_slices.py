"""Words of a shard as dealt to buckets, and candidates from fingerprints among near copies."""

import gc
import tracemalloc

import pyarrow as pa

from panelyard.llm import filter_audit, near_copies, suffix_dedup
from panelyard.llm.simhash import links


def test_words_are_dealt_in_one_pass(monkeypatch):
    monkeypatch.setattr(filter_audit, "DEALT_ROWS", 2)
    shard = filter_audit._Shard()
    shard.add(1, "a", b"one two three four five six seven two")
    row = shard.row(7, 16)
    cuts, words = row.column("cuts")[0].as_py(), row.column("words")[0].as_py()
    got = [r for b in filter_audit._dealt(iter([row.select(["shard", "words", "cuts"])])) for r in b.to_pylist()]
    want = [{"shard": 7, "bucket": k, "start": cuts[k], "words": words[cuts[k] : cuts[k + 1]]} for k in range(16) if cuts[k] < cuts[k + 1]]
    assert got == want and sum((r["words"] for r in got), []) == words


def test_pigeonring_chains_give_candidates(spark, monkeypatch):
    signed = spark.createDataFrame([(5, 0b111), (3, 0), (9, 0), (4, 0b1111), (8, 1 << 40 | 1 << 50)], "node long, fp long")
    pairs = {tuple(sorted(r)) for r in near_copies.fingerprint_links(signed).collect()}
    assert pairs == {(3, 9), (3, 5), (4, 5), (3, 8)}
    seen, verified = [], near_copies.verified
    monkeypatch.setattr(near_copies, "_paired", lambda rows, keys: (spark.createDataFrame([], "a long, b long"), spark.createDataFrame([], "key long, a long, b long")))
    monkeypatch.setattr(near_copies, "verified", lambda docs, signed, pairs, text: seen.append(pairs.count()) or verified(docs, signed, pairs, text))
    text = " ".join(f"w{k}" for k in range(400))
    docs = spark.createDataFrame([(1, text), (2, text + " end"), (3, "other words")], "doc_id long, text string")
    assert sorted(r.doc_id for r in near_copies.one_of_each(docs).collect()) == [1, 3] and seen == [1]


def test_words_are_numbered_as_they_come():
    known = filter_audit._numbers()
    assert list(map(known.__getitem__, [b"b", b"a", b"b", b"c"])) == [0, 1, 0, 2]
    assert not gc.is_tracked(known.default_factory) or known not in gc.get_referents(known.default_factory)  # freed with its shard


def test_links_send_a_key_and_a_fingerprint(spark):
    distinct = spark.createDataFrame([(0,), (0b111,), (0b1111 << 58,)], "fp long")
    plan = links(distinct)._jdf.queryExecution().optimizedPlan().toString()
    assert "struct(" not in plan and "turned" not in plan
    assert [(r.a, r.b) for r in links(distinct).collect()] == [(0, 7)]


def test_hashed_bytes_are_few_at_once():
    texts = pa.RecordBatch.from_arrays([pa.array(range(40)), pa.array(range(40)), pa.array([f"{k:05d}" * 8000 for k in range(40)])], ["doc_id", "dk", "text"])
    tracemalloc.start()
    n = sum(b.num_rows for b in suffix_dedup._chunks(iter([texts])))
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert n >= 40 and most < 60 << 20
