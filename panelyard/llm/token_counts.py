"""Byte-level BPE token counts by rank-synchronous array merging.

Pre-tokens that a worker has not met yet are laid out as one ragged array of symbols. In each
round every sequence finds its lowest-ranked pair, all of its occurrences are merged at once
(left to right where they overlap), and sequences without a mergeable pair leave. What is left
of a sequence is its number of tokens.

Merging a pair everywhere at once gives the library's result: a merge that uses the new symbol
always has a higher rank than the merge that made it.

Rows: a null text counts as empty (0 bytes, 0 tokens). Repeated rows and ids give a row each.
An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import public_tokenizers
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelyard.llm.runtime import bounded_batches

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
#: White space as the vocabulary's library has it (Unicode White_Space).
SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
PRETOKEN = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{SPACE}\p{{L}}\p{{N}}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"
ODD_SPACE = re.compile("[\t\x0b-\r\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
CACHED = 300_000
NEVER = np.int64(1 << 40)


def byte_symbols() -> dict[str, int]:
    """The printable stand-in of each byte in byte-level vocabularies."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class RankMerger:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            model = json.load(f)
        vocab, merges = model["model"]["vocab"], model["model"]["merges"]
        self.specials = [t["content"] for t in model["added_tokens"]]
        self.byte_id = np.zeros(256, np.int64)
        for char, byte in byte_symbols().items():
            self.byte_id[byte] = vocab[char]
        pairs = [m if isinstance(m, list) else m.split(" ") for m in merges]
        keys = np.array([(vocab[a] << 20) | vocab[b] for a, b in pairs], np.int64)
        order = np.argsort(keys)
        self.keys, self.ranks = keys[order], np.arange(len(pairs), dtype=np.int64)[order]
        self.made = np.array([vocab[a + b] for a, b in pairs], np.int64)[order]
        self.split = regex.compile(PRETOKEN).findall
        self.special = regex.compile("|".join(map(re.escape, self.specials))) if self.specials else None
        self.cache: dict[str, int] = {}

    def merge(self, words: list[str]) -> np.ndarray:
        """Tokens of each pre-token."""
        raw = [w.encode("utf-8", "surrogatepass") for w in words]
        length = np.fromiter(map(len, raw), np.int64, len(raw))
        out = np.zeros(len(raw), np.int64)
        ids = np.flatnonzero(length)
        symbols, length = self.byte_id[np.frombuffer(b"".join(raw), np.uint8)], length[ids]
        while len(ids):
            starts = np.concatenate([[0], np.cumsum(length)[:-1]])
            last = starts + length - 1
            rank = np.full(len(symbols), NEVER)
            place = np.zeros(len(symbols), np.int64)
            pair = (symbols[:-1] << 20) | symbols[1:]
            at = np.minimum(np.searchsorted(self.keys, pair), len(self.keys) - 1)
            known = self.keys[at] == pair
            rank[:-1][known] = self.ranks[at[known]]
            place[:-1] = at
            rank[last] = NEVER
            lowest = np.minimum.reduceat(rank, starts)
            going = lowest < NEVER
            out[ids[~going]] = length[~going]
            hit = (rank == np.repeat(lowest, length)) & np.repeat(going, length)
            # of overlapping pairs (a run of one symbol) every second one merges, from the left
            here = np.arange(len(symbols))
            begins = hit & ~np.concatenate([[False], hit[:-1]])
            run = np.maximum.accumulate(np.where(begins, here, 0))
            hit &= ((here - run) & 1) == 0
            symbols[hit] = self.made[place[hit]]
            stays = np.repeat(going, length)
            stays[np.flatnonzero(hit) + 1] = False
            length = np.add.reduceat(stays.astype(np.int64), starts)[going]
            symbols, ids = symbols[stays], ids[going]
        return out

    def pieces(self, text: str) -> tuple[list[str], int]:
        """Strings that tokenize on their own, and the special tokens between them."""
        found = 0
        parts = [text]
        if self.special is not None and any(s in text for s in self.specials):
            parts = self.special.split(text)
            found = len(parts) - 1
        words: list[str] = []
        for part in parts:
            if not part:
                continue
            odd = part[0] in " \n" or part[-1] in " \n" or "  " in part or " \n" in part or "\n " in part or ODD_SPACE.search(part)
            if odd:
                words += self.split(part)
            else:  # single spaces between words: a space belongs to the word after it
                first, *rest = part.split(" ")
                words.append(first)
                words += [" " + w for w in rest]
        return words, found

    def count(self, texts: list[str]) -> np.ndarray:
        cache = self.cache
        split = [self.pieces(t) for t in texts]
        new = list(set().union(*(w for w, _ in split)).difference(cache))
        if len(cache) + len(new) > CACHED:
            cache.clear()
            new = list(set().union(*(w for w, _ in split)))
        if new:
            inner = [self.split(w) for w in new]
            tokens = self.merge([p for x in inner for p in x])
            ends = np.cumsum([len(x) for x in inner])
            sums = np.concatenate([[0], np.cumsum(tokens)])
            cache.update(zip(new, (sums[ends] - sums[ends - np.fromiter(map(len, inner), np.int64, len(inner))]).tolist()))
        return np.array([sum(map(cache.__getitem__, w)) + n for w, n in split], np.int64)


_MERGERS: dict[str, RankMerger] = {}


def merger(path: str) -> RankMerger:
    if path not in _MERGERS:
        _MERGERS[path] = RankMerger(path)
    return _MERGERS[path]


def token_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str = VOCABULARY, limit: int = 512) -> DataFrame:
    """Per row: the id, n_bytes (UTF-8), n_tokens, and over_limit (n_tokens > limit)."""
    bounded_batches(docs.sparkSession)

    @F.pandas_udf("long")
    def tokens(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = merger(path)
        for texts in parts:
            yield pd.Series(own.count(texts.tolist()))

    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.col(id_col), F.octet_length(text).cast("long").alias("n_bytes"), tokens(text).alias("n_tokens")).withColumn(
        "over_limit", F.col("n_tokens") > limit
    )
