import random

import numpy as np

from panelyard.llm import simhash


def classes(prints):
    """Brute force: {fingerprint: smallest fingerprint reachable}."""
    nodes = sorted(set(prints))
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(nodes):
        for b in nodes[i + 1 :]:
            if (a ^ b).bit_count() <= 3:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {n: find(n) for n in nodes}


def clusters(n=40):
    r = random.Random(5)
    out = [r.getrandbits(64) for _ in range(n)]
    for centre in out[:4]:
        weak = r.sample(range(64), 9)
        out += [centre ^ sum(1 << b for b in r.sample(weak, r.randint(0, 5))) for _ in range(60)]
    return sorted(set(out))


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def test_links_and_components_equal_brute_force(spark, monkeypatch):
    for heavy in (256, 2):  # the second takes most keys through the chain of three
        monkeypatch.setattr(simhash, "HEAVY", heavy)
        prints = clusters()
        table = spark.createDataFrame([(signed(p),) for p in prints], "fp long")
        found = {frozenset((r.a, r.b)) for r in simhash.links(table).collect()}
        want = {frozenset((signed(a), signed(b))) for i, a in enumerate(prints) for b in prints[i + 1 :] if (a ^ b).bit_count() <= 3}
        assert found == want
    edges = simhash.links(table)
    roots = {r.node: r.root for r in simhash.components(edges).collect()}
    groups = classes(prints)
    by_root = {}
    for node, root in roots.items():
        by_root.setdefault(root, set()).add(node)
    want = {}
    for node, root in groups.items():
        want.setdefault(root, set()).add(signed(node))
    assert {frozenset(s) for s in by_root.values()} == {frozenset(s) for s in want.values() if len(s) > 1}


def test_fingerprint_by_hand():
    import xxhash

    words = b"One  two\tTHREE four".lower().split()
    hashes = [xxhash.xxh64_intdigest(b" ".join(words[i : i + 3]), 42) for i in range(2)]
    want = sum(1 << b for b in range(64) if 2 * sum((h >> b) & 1 for h in hashes) > 2)
    assert simhash.fingerprint(b"One  two\tTHREE four") == want
    assert simhash.fingerprint(b"") == 0
    assert simhash.fingerprint(b"A b") == xxhash.xxh64_intdigest(b"a b", 42)


def test_documents(docs, edges):
    r = random.Random(1)
    long = [f"w{r.randint(0, 500)}" for _ in range(3000)]
    near = list(long)
    near[100] = "other"
    rows = [*enumerate(edges), (50, " ".join(long)), (51, " ".join(near)), (51, " ".join(near)), (52, " ".join(long)), (None, "alone here now")]
    out = simhash.near_duplicates(docs(rows)).collect()
    assert len(out) == len(rows)
    by = {x.doc_id: x for x in out}
    assert by[50].component_id == by[51].component_id == by[52].component_id == 50
    assert by[0].component_id == by[2].component_id == by[4].component_id == 0 and by[0].fingerprint == "0" * 16
    assert by[6].component_id == 5
    assert by[None].component_id is None
    kept = simhash.one_of_each(docs(rows))
    assert kept.columns == docs(rows).columns
    ids = sorted(x.doc_id for x in kept.collect() if x.doc_id is not None)
    assert 50 in ids and 51 not in ids and 6 not in ids and 9 in ids


def test_empty(docs):
    assert simhash.near_duplicates(docs([])).count() == 0
    assert simhash.one_of_each(docs([])).count() == 0


def test_unsigned_bits():
    assert np.uint64(simhash.fingerprint("één twee drie vier vijf".encode())) >= 0
