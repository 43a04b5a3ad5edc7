import hashlib
import random

import pytest

from panelyard.llm import suffix_dedup as sd


def brute(rows):
    """(removed mask) of each (doc_id, bytes), in order."""
    seen, out = set(), {}
    for doc, raw in sorted(set(rows)):
        mask = bytearray(len(raw))
        for p in range(len(raw) - sd.WINDOW + 1):
            w = raw[p : p + sd.WINDOW]
            if w in seen:
                mask[p : p + sd.WINDOW] = b"\1" * sd.WINDOW
            seen.add(w)
        out[doc] = mask
    return out


def corpus():
    r = random.Random(9)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(r.randint(1, 7)))
    passage = [" ".join(word() for _ in range(n)) for n in (14, 40, 200)]
    texts = []
    for i in range(60):
        own = [" ".join(word() for _ in range(r.randint(1, 150))) for _ in range(2)]
        texts.append(f"{own[0]} {r.choice(passage)} {own[1]} {r.choice(passage)[: r.randint(50, 900)]}")
    texts += [texts[3], texts[3][:400], "é" * 120, "ab" * 400, "x" * 99, "x" * 100, "x" * 101, "", "\x00" * 250]
    return texts


@pytest.mark.parametrize("hot, piece", [(20_000, sd.LONGEST), (2, 700)])
def test_equals_brute_force(docs, monkeypatch, hot, piece):
    monkeypatch.setattr(sd, "HOT", hot)
    monkeypatch.setattr(sd, "LONGEST", piece)
    texts = corpus()
    want = brute([(i, t.encode()) for i, t in enumerate(texts)])
    for r in sd.removals(docs(texts)).collect():
        raw, mask = texts[r.doc_id].encode(), want[r.doc_id]
        assert r.n_bytes == len(raw) and r.n_removed == sum(mask)
        assert r.kept_sha256 == hashlib.sha256(bytes(b for b, m in zip(raw, mask) if not m)).hexdigest()
        assert r.n_spans == sum(m and not (k and mask[k - 1]) for k, m in enumerate(mask))


def test_edges(docs, edges):
    rows = [*enumerate(edges), (None, "word " * 30), (5, "word " * 30)]
    out = sd.removals(docs(rows)).collect()
    assert len(out) == len(rows)
    by = {}
    for r in out:
        by.setdefault(r.doc_id, []).append(r)
    assert by[None][0].n_removed == 0
    assert by[0][0].n_bytes == 0 and by[0][0].kept_sha256 == hashlib.sha256(b"").hexdigest()
    assert len({r.n_removed for r in by[5]}) == 1 and by[6][0].n_removed == 150
    assert sd.removals(docs([])).count() == 0


def test_repeated_rows_with_the_first_occurrence(docs, spark):
    r = random.Random(11)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(r.randint(1, 7)))
    own = lambda n: " ".join(word() for _ in range(n))
    passage = own(40)
    rows = [(5, f"{own(90)} {passage} {own(80)}"), (8, f"{own(70)} {passage} {own(95)}"), (9, own(50))]
    want = brute([(i, t.encode()) for i, t in rows])
    assert not sum(want[5]) and sum(want[8]) >= len(passage)
    texts = dict(rows)
    for parts in (1, 4):
        out = sd.removals(docs([rows[0], *rows, rows[0]]).repartition(parts)).collect()
        assert sorted(x.doc_id for x in out) == [5, 5, 5, 8, 9]
        for x in out:
            raw, mask = texts[x.doc_id].encode(), want[x.doc_id]
            assert x.n_removed == sum(mask)
            assert x.kept_sha256 == hashlib.sha256(bytes(b for b, m in zip(raw, mask) if not m)).hexdigest()


def test_cut_texts(docs):
    text = " ".join(f"w{i}" for i in range(80))
    rows = docs([text, f"before {text} after", text, None, "short"])
    out = {r.doc_id: r for r in sd.without_repeats(rows).collect()}
    assert sorted(out) == [0, 1, 3, 4]
    assert out[1].text == "before  after" and out[1].n_chars == len("before  after")
    assert out[0].text == text and out[3].text is None
    assert sd.without_repeats(rows).columns == rows.columns
    assert sd.without_repeats(docs([])).count() == 0


def test_index_family_levels():
    import numpy as np

    family = sd.IndexFamily()
    r = random.Random(2)
    seen = set()
    for _ in range(20):
        batch = [bytes([r.randint(0, 3)]) * 99 + bytes([r.randint(0, 60)]) for _ in range(30)]
        got = family.add(np.array(batch, f"S{sd.WINDOW}"))
        for one, again in zip(batch, got):
            assert again == (one in seen)
            seen.add(one)
        sizes = [len(x) for x in family.levels]
        assert all(a >= 2 * b for a, b in zip(sizes, sizes[1:]))

def test_repeated_rows_of_the_first_occurrence(docs):
    """A document that stands there twice keeps its passage; the others lose it, wherever they are."""
    r = random.Random(2)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(r.randint(1, 7)))
    passage, own = " ".join(word() for _ in range(60)), [" ".join(word() for _ in range(300)) for _ in range(3)]
    rows = [(1, f"{own[0]} {passage}"), (1, f"{own[0]} {passage}"), (2, f"{passage} {own[1]}"), (3, f"{own[2]} {passage}"), (3, f"{own[2]} {passage}")]
    out = sd.removals(docs(rows)).collect()
    want = {k: sum(v) for k, v in brute([(i, t.encode()) for i, t in rows]).items()}
    assert sorted((x.doc_id, x.n_removed) for x in out) == [(1, 0), (1, 0), (2, want[2]), (3, want[3]), (3, want[3])] and want[2] >= len(passage)


def test_tasks_hand_rows_on_as_they_go(docs, monkeypatch):
    monkeypatch.setattr(sd, "ROWS", 3)
    monkeypatch.setattr(sd, "HOT", 2)
    texts = corpus()
    want = {k: sum(v) for k, v in brute([(i, t.encode()) for i, t in enumerate(texts)]).items()}
    assert {x.doc_id: x.n_removed for x in sd.removals(docs(texts)).collect()} == want
