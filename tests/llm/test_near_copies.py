import random

import corpus_pipeline
from panelyard.llm import near_copies as nc


def words(r, n):
    return [f"w{r.randint(0, 5000)}" for _ in range(n)]


def edited(r, own, n):
    own = list(own)
    for i in r.sample(range(len(own)), n):
        own[i] = "other"
    return own


def test_stage_drops_edited_copies(spark, data, docs):
    r = random.Random(3)
    texts, copies = [], set()
    for i in range(30):
        own = words(r, 300)
        near = edited(r, own, 5)
        assert nc.jaccard(nc.shingles(" ".join(own)), nc.shingles(" ".join(near))) >= 0.8
        texts += [" ".join(own), " ".join(near)]
        copies.add(2 * i + 1)
    far = edited(r, texts[0].split(), 60)  # one word in five: no near copy
    rows = docs([*texts, " ".join(far)])
    kept = [x.doc_id for x in corpus_pipeline.near_duplicates(spark, rows, data).collect()]
    assert sorted(kept) == sorted(set(range(61)) - copies)


def test_classes_equal_brute_force(docs, monkeypatch, edges):
    r = random.Random(4)
    base = [words(r, 60) for _ in range(6)]
    texts = [" ".join(edited(r, b, r.choice([0, 0, 1, 1, 2, 4]))) for b in base for _ in range(12)] + list(edges)
    sets = [nc.shingles(t or "") for t in texts]
    root = list(range(len(texts)))

    def find(x):
        return x if root[x] == x else find(root[x])

    for i in range(len(texts)):
        for j in range(i):
            if nc.jaccard(sets[i], sets[j]) >= nc.SIMILAR:
                x, y = sorted((find(i), find(j)))
                root[y] = x
    want = sorted({find(i) for i in range(len(texts))})
    for heavy in (32, 3):
        monkeypatch.setattr(nc, "HEAVY", heavy)
        assert sorted(x.doc_id for x in nc.one_of_each(docs(texts)).collect()) == want


def test_rows(docs):
    rows = docs([(5, "a b"), (5, "a b"), (7, "A  b"), (None, "a b"), (None, "alone"), (3, None), (4, " ")])
    out = nc.one_of_each(rows)
    assert out.columns == rows.columns
    assert sorted((x.doc_id or 0, x.text) for x in out.where("text is not null").collect()) == [(0, "alone"), (5, "a b"), (5, "a b")]
    assert out.where("text is null").count() == 1 and out.count() == 4
    assert nc.one_of_each(docs([])).count() == 0


def test_hot_band_loses_no_link(spark, docs, monkeypatch):
    r = random.Random(5)
    base = words(r, 200)
    texts = [" ".join(words(r, 200)) for _ in range(40)] + [" ".join(base), " ".join(edited(r, base, 3))]
    rows = docs(texts).withColumn("node", nc._node("text")).orderBy("node").collect()
    texts = [x.text for x in rows]
    two = [i for i, t in enumerate(texts) if len(set(t.split()) & set(base)) > 100]
    assert len(two) == 2 and not {0, 41} & set(two)  # neither the smallest nor the largest node
    # all texts share all bands, so that no key tells the two apart
    signed = spark.createDataFrame([(x.node, bytes(nc.BANDS * nc.ROWS), list(range(nc.BANDS))) for x in rows], "node long, signature binary, keys array<long>")
    none = spark.createDataFrame([], "a long, b long")
    want = [tuple(rows[i].node for i in two)]
    for block in (nc.BLOCK_TEXTS, 5):
        monkeypatch.setattr(nc, "BLOCK_TEXTS", block)
        got = nc.similar(docs(texts), signed, "text", none).collect()
        assert [tuple(sorted(x)) for x in got] == want
