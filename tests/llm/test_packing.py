import random
import zlib

import numpy as np
import tokenizers

from panelyard.llm import packing


def test_pack_is_whole_and_reaches_known_optima():
    r = random.Random(4)
    for _ in range(30):
        sizes = []
        for _ in range(6):  # six bins that are exactly full
            cuts = sorted(r.sample(range(1, 100), r.randint(1, 3)))
            sizes += [b - a for a, b in zip([0, *cuts], [*cuts, 100])]
        r.shuffle(sizes)
        bins = packing.pack(sizes, 100)
        assert sorted(i for b in bins for i in b) == list(range(len(sizes)))
        assert all(sum(sizes[i] for i in b) <= 100 for b in bins)
        assert len(bins) <= len(packing.best_fit(sorted(sizes, reverse=True), 100))


def test_search_beats_best_fit():
    sizes = [44, 41, 30, 29, 28, 28]  # best fit needs three bins of 100, two hold them all
    assert len(packing.best_fit(sorted(sizes, reverse=True), 100)) == 3
    assert len(packing.pack(sizes, 100)) == 2


def test_rows(docs, edges, monkeypatch):
    monkeypatch.setattr(packing, "GROUP", 5)
    rows = [*enumerate(edges), (None, "a b"), (9, "The end."), (20, "one two three " * 5000)]
    out = packing.best_fit_packing(docs(rows)).toPandas()
    library = tokenizers.Tokenizer.from_file(packing.VOCABULARY)
    total = 0
    for doc, text in rows:
        ids = np.array([*library.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        total += len(ids)
        own = out[out.doc_id.isna() if doc is None else out.doc_id == doc].sort_values("start")
        for k, at in enumerate(range(0, len(ids), 4096)):
            part = ids[at : at + 4096]
            assert ((own.piece == k) & (own.start == at) & (own.length == len(part)) & (own.ids_crc32 == zlib.crc32(part.tobytes()))).any()
    assert out.length.sum() == total
    by = out.sort_values(["sequence_id", "offset"]).groupby("sequence_id")
    assert (by.length.cumsum() - out.sort_values(["sequence_id", "offset"]).length == out.sort_values(["sequence_id", "offset"]).offset).all()
    assert by.length.sum().max() <= 4096
    assert by.ngroups <= -(-total // 4096) + 1
    assert packing.best_fit_packing(docs([])).count() == 0


def test_one_id_for_all_rows_is_dealt_and_packed_like_any(spark):
    """100,000 pieces without an id: no group takes them all, no sequence is over the capacity."""
    from pyspark.sql import functions as F

    for size in (4000, 700):
        rows = spark.range(100_000, numPartitions=8)
        pieces = rows.select(F.lit(None).cast("long").alias("doc_id"), F.lit(0).alias("piece"), F.lit(0).cast("long").alias("start"), F.lit(size).cast("long").alias("length"), F.lit(7).cast("long").alias("ids_crc32"), F.col("id").alias("row"))
        out = packing.packed(pieces).groupBy("sequence_id").agg(F.sum("length").alias("n"), F.max(F.expr("offset + length")).alias("end"), F.count("*").alias("k"))
        got = out.agg(F.max("n").alias("n"), F.max(F.expr("end - n")).alias("gap"), F.count("*").alias("sequences"), F.sum("k").alias("pieces")).first()
        per = 4096 // size
        assert got.n <= 4096 and got.gap == 0 and got.pieces == 100_000
        assert got.sequences <= 1.01 * (100_000 / per)


def test_large_groups_are_searched_to_the_end():
    """Seven hundred pieces near the capacity: a complete solution lies deeper than 400 sequences."""
    sizes = [2 * 44, 2 * 41, 2 * 30, 2 * 29, 2 * 28, 2 * 28] + [195 + i % 6 for i in range(700)]
    bins = packing.pack(sizes, 200)
    assert sorted(i for b in bins for i in b) == list(range(len(sizes))) and all(sum(sizes[i] for i in b) <= 200 for b in bins)
    assert len(bins) == 702
