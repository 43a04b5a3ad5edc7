"""Best-fit packing of tokenized documents by bin completion.

Tokens come from the library of the vocabulary file (lower-cased words with word ends), each
document is closed by one end id, and documents over the capacity are cut into full pieces and a
rest. Pieces are packed in groups of bounded size, dealt by hash, so no task sees the corpus:

* the incumbent of a group is its best-fit-decreasing solution;
* if that has more sequences than the lower bound, branch and bound looks for a better one: the
  largest piece left opens a sequence, undominated fillings around it are tried fullest first, and
  a branch ends when its waste exceeds what one sequence less would leave. The search may open
  NODES sequences for each one of the incumbent; without a better solution the incumbent holds.

Groups are dealt by a number that each written piece has of its own, so rows that share an id (or
have none) spread like all others.

Sequences that end up with room are opened again and their pieces packed in fewer groups, until
one group is left, so the loss of a group's last sequence does not add up over the groups. Where
that stalls, groups double up to LARGEST times GROUP; what still stalls then stays as it is.

Rows: a null or empty text is the end id alone. Repeated rows and ids are packed as often as they
occur. A null id stays null. An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import bisect
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import public_tokenizers
import tokenizers
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelyard.llm.runtime import bounded_batches, settled, written
from panelyard.llm.token_counts import byte_symbols

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")
CAPACITY = 4096
END = 1
CACHED = 250_000
GROUP, LARGEST = 512, 8
#: A sequence with more room than this is opened again in the next round.
ROOM = 16
NODES, LEAST_NODES, FILLINGS, STEPS = 4, 400, 6, 400
#: Split by Python as white space, but not by the library.
SEPARATORS = re.compile("[\x1c-\x1f]")
SIMPLE = re.compile(r"([A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f]+)([!-&(-/:-@[-`{-~]*)").fullmatch


class Encoder:
    """The library's ids, remembered for the runs of text between white space. White space is
    dropped by the vocabulary and nothing is joined across it, so each run stands alone. A run of
    Latin letters and closing ASCII punctuation is two pre-tokens, which go to the library's model
    as they are; any other run takes the library's whole way."""

    def __init__(self, path: str):
        self.library = tokenizers.Tokenizer.from_file(path)
        self.model = self.library.model
        self.letters = {chr(b): c for c, b in byte_symbols().items()}
        self.runs: dict[str, bytes] = {}
        self.words: dict[str, bytes] = {}

    def word(self, word: str) -> bytes:
        """Ids of one pre-token, already in lower case."""
        own = word if word.isascii() else "".join(self.letters[chr(b)] for b in word.encode())
        got = self.words[word] = struct.pack(f"<{len(ids)}I", *ids) if (ids := [t.id for t in self.model.tokenize(own)]) else b""
        return got

    def run(self, run: str) -> bytes:
        if (m := SIMPLE(run)) and (low := m.group(1).lower()).isalpha() and max(low) < "\u0250":
            words, end = self.words, m.group(2)
            got = words.get(low) or self.word(low)
            if end:
                got += words.get(end) or self.word(end)
        else:
            got = np.array(self.library.encode(run, add_special_tokens=False).ids, "<u4").tobytes()
        self.runs[run] = got
        return got

    def encode(self, text: str) -> bytes:
        if SEPARATORS.search(text):
            return np.array(self.library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        if len(self.runs) > CACHED:
            self.runs.clear()
        if len(self.words) > CACHED:
            self.words.clear()
        runs = text.split()
        ids = list(map(self.runs.get, runs))
        if None in ids:
            known = self.runs.get
            ids = [i if i is not None else known(r) or self.run(r) for r, i in zip(runs, ids)]
        return b"".join(ids)

    def forget(self) -> None:
        self.runs.clear()
        self.words.clear()


_ENCODERS: dict[str, Encoder] = {}


def token_bytes(path: str, texts: list[str]) -> list[bytes]:
    """Each text's ids as little-endian unsigned 32-bit numbers."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return list(map(_ENCODERS[path].encode, texts))


def token_pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str = VOCABULARY, capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """Per piece: doc_id, piece, start, length, ids_crc32."""
    bounded_batches(docs.sparkSession)
    last = int(end).to_bytes(4, "little")

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for doc, ids in zip(batch.doc_id, token_bytes(path, batch.text.tolist())):
                ids += last
                for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    out.append((doc, k, at // 4, len(part) // 4, zlib.crc32(part)))
            yield pd.DataFrame(out, columns=["doc_id", "piece", "start", "length", "ids_crc32"]).astype({"doc_id": "Int64"})
        if path in _ENCODERS:  # the worker lives on, and later tasks need its memory
            _ENCODERS[path].forget()
        settled()

    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return texts.mapInPandas(cut, "doc_id long, piece int, start long, length long, ids_crc32 long")


def best_fit(sizes: list[int], capacity: int) -> list[list[int]]:
    """Bins of positions; sizes descend."""
    rooms: list[tuple[int, int]] = []
    bins: list[list[int]] = []
    for i, size in enumerate(sizes):
        at = bisect.bisect_left(rooms, (size, -1))
        if at < len(rooms):
            room, k = rooms.pop(at)
        else:
            room, k = capacity, len(bins)
            bins.append([])
        bins[k].append(i)
        bisect.insort(rooms, (room - size, k))
    return bins


def fillings(sizes: list[int], left: list[int], room: int) -> list[tuple[int, list[int]]]:
    """Undominated fillings of room from the positions left (sizes descend): (waste, positions),
    least waste first. A filling is dominated if a piece that is left over fits beside it or in
    place of a smaller one of its pieces."""
    found: list[tuple[int, list[int]]] = []
    steps = 0
    ends = [-sizes[i] for i in left]

    def dominated(chosen: list[int], waste: int) -> bool:
        taken = set(chosen)
        for limit, own in [(waste, 0)] + [(waste + sizes[i], sizes[i]) for i in chosen]:
            k = bisect.bisect_left(ends, -limit)  # the largest pieces that fit
            while k < len(left) and left[k] in taken:
                k += 1
            if k < len(left) and sizes[left[k]] > own:
                return True
        return False

    def grow(k: int, room: int, chosen: list[int]) -> None:
        nonlocal steps
        steps += 1
        if steps > STEPS or len(found) >= 4 * FILLINGS:
            return
        k = max(k, bisect.bisect_left(ends, -room))
        if k >= len(left):
            if not dominated(chosen, room):
                found.append((room, list(chosen)))
            return
        last = None
        while k < len(left) and steps <= STEPS and len(found) < 4 * FILLINGS:
            size = sizes[left[k]]
            if size != last:
                grow(k + 1, room - size, [*chosen, left[k]])
                last = size
            k += 1

    grow(0, room, [])
    return sorted(found, key=lambda x: x[0])[:FILLINGS]


def pack(sizes: list[int], capacity: int = CAPACITY) -> list[list[int]]:
    """Bins of positions in sizes: best fit, improved by bin completion where the bound allows."""
    order = sorted(range(len(sizes)), key=lambda i: -sizes[i])
    ordered = [sizes[i] for i in order]
    best = best_fit(ordered, capacity)
    total = sum(ordered)
    bound = max(-(-total // capacity), sum(2 * s > capacity for s in ordered))
    nodes = max(LEAST_NODES, NODES * len(best))  # so many sequences may be opened

    def options(left: list[int]) -> Iterator[tuple[int, list[int]]]:
        room = capacity - ordered[left[0]]
        return iter(fillings(ordered, left[1:], room) or [(room, [])])

    # a depth-first walk; for each open sequence: its pieces, the pieces left, the waste before it
    # and its fillings not yet tried
    walk: list[tuple[list[int], int, Iterator]] = []
    bins: list[list[int]] = []
    if len(best) > bound and total <= (len(best) - 1) * capacity:
        left = list(range(len(ordered)))
        walk.append((left, 0, options(left)))
    while walk and nodes and len(best) > bound:
        left, waste, untried = walk[-1]
        room, chosen = next(untried, (None, None))
        # none left, or more waste than one sequence less would leave (the rest waste more)
        if room is None or waste + room > (len(best) - 1) * capacity - total:
            walk.pop()
            if bins:
                bins.pop()
            continue
        nodes -= 1
        taken = {left[0], *chosen}
        bins.append([left[0], *chosen])
        rest = [i for i in left if i not in taken]
        if rest:
            walk.append((rest, waste + room, options(rest)))
            continue
        if len(bins) < len(best):
            best = [list(b) for b in bins]
        bins.pop()
    return [[order[i] for i in b] for b in best]


_PACKED = "doc_id long, piece int, start long, length long, ids_crc32 long, row long, sequence_id long, offset long, room long"
#: Bits of a sequence_id: level, group (of hundreds of pieces), number in the group.
LEVEL_BITS, NUMBER_BITS = 58, 16


def packed(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """pieces with sequence_id (any numbers) and offset (gapless from 0 in a sequence), for a
    written table of token_pieces() with row, a number that no two rows share."""
    spark = pieces.sparkSession
    columns = pieces.columns

    def solver(level: int):
        def solve(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
            group = group.sort_values("row", ignore_index=True)
            sizes = group["length"].tolist()
            bins = pack(sizes, capacity)
            at = np.concatenate([np.asarray(b, np.int64) for b in bins])
            out = group[columns].iloc[at].copy()
            number = np.repeat(np.arange(len(bins), dtype=np.int64), [len(b) for b in bins])
            if len(bins) >> NUMBER_BITS or int(key[0]) >> (LEVEL_BITS - NUMBER_BITS):
                raise OverflowError("a sequence_id has no room for this group")
            out["sequence_id"] = (level << LEVEL_BITS) | (int(key[0]) << NUMBER_BITS) | number
            out["offset"] = np.concatenate([np.cumsum([0] + [sizes[i] for i in b[:-1]]) for b in bins])
            out["room"] = np.repeat([capacity - sum(sizes[i] for i in b) for b in bins], [len(b) for b in bins])
            return out

        return solve

    done, left = [], pieces
    count = left.count()
    level, size = 0, GROUP
    while True:
        groups = max(1, -(-count // size))
        dealt = left.withColumn("_group", F.pmod(F.xxhash64("row", F.lit(level)), F.lit(groups)))
        table = written(dealt.groupBy("_group").applyInPandas(solver(level), _PACKED), "packed")
        if groups == 1:
            done.append(table)
            break
        done.append(table.where(F.col("room") <= ROOM))
        left = table.where(F.col("room") > ROOM).select(columns)
        after = left.count()
        # rounds go on while opened sequences become fewer; then groups grow, up to LARGEST times GROUP
        if after == 0:
            break
        if after > 0.9 * count and level:
            if size >= LARGEST * GROUP:
                done[-1] = table
                break
            size *= 2
        count, level = after, level + 1
    out = done[0]
    for table in done[1:]:
        out = out.unionByName(table)
    return out.drop("room", "row")


def best_fit_packing(docs: DataFrame, path: str = VOCABULARY, capacity: int = CAPACITY) -> DataFrame:
    """Per piece of each document: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    pieces = written(token_pieces(docs, path=path, capacity=capacity).withColumn("row", F.monotonically_increasing_id()), "pieces")
    return packed(pieces, capacity)
