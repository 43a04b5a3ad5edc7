import random

import numpy as np
import pytest
import tokenizers

from panelyard.llm import packing, token_counts

ODD = [" ", "  ", "\n", "\n\n", "\t", "\x1c", "\x85", "\xa0", "　", "'s", "'LL", "é", "é", "́", "١", "²", "Ⅷ", "a", "B", "zz", "<|endoftext|>", "<|end", "aaaaaaa", "....", "\U0001f600", "中", "ß", "​", "﻿", "_", "9", "\r\n", "İ", "Σ", "ª", "ſ", "-"]


def texts():
    r = random.Random(3)
    return ["".join(r.choice(ODD) for _ in range(r.randint(0, 30))) for _ in range(3000)] + ["a" * 3000, " " * 999, "ab" * 1500, ""]


def test_counts_equal_the_library():
    own, library = token_counts.merger(token_counts.VOCABULARY), tokenizers.Tokenizer.from_file(token_counts.VOCABULARY)
    want = [len(e.ids) for e in library.encode_batch(texts(), add_special_tokens=False)]
    assert own.count(texts()).tolist() == want


def test_packing_ids_equal_the_library():
    library = tokenizers.Tokenizer.from_file(packing.VOCABULARY)
    want = [np.array(e.ids, "<u4").tobytes() for e in library.encode_batch(texts(), add_special_tokens=False)]
    assert packing.token_bytes(packing.VOCABULARY, texts()) == want


def test_rows(docs, edges):
    out = {r.doc_id: r for r in token_counts.token_counts(docs(edges)).collect()}
    assert len(out) == len(edges)
    assert (out[0].n_bytes, out[0].n_tokens, out[0].over_limit) == (0, 0, False)
    assert out[7].n_bytes == 50_000 and out[7].over_limit
    assert out[5].n_tokens == out[6].n_tokens == 31


@pytest.mark.parametrize("rows", [[], [(None, "a b"), (1, "a"), (1, "a")]])
def test_empty_and_repeated(docs, rows):
    assert token_counts.token_counts(docs(rows)).count() == len(rows)
