"""Token counts of a byte-level BPE vocabulary, without emitting tokens.

Method: a piece starts as one symbol per byte in a doubly linked list; a heap holds every adjacent pair
with a known rank; the lowest rank (leftmost first) is merged until none is left. The count is the number
of initial symbols minus the merges. Counts of short pieces are remembered per Python worker, up to a
fixed number of pieces.

Edge cases: a null text counts as empty (0 tokens); an empty table gives an empty table; repeated rows
are counted each; an input column named like an output column is replaced.
"""

from __future__ import annotations

import hashlib
import heapq
import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
# Letters and numbers assigned after Unicode 16.0, which the tokenizer library does not know.
LATER = (
    (0x558, 0x558), (0x58B, 0x58C), (0x88F, 0x88F), (0xC5C, 0xC5C), (0xCDC, 0xCDC), (0x208F, 0x208F), (0x209D, 0x209F),
    (0xA7CE, 0xA7CF), (0xA7D2, 0xA7D2), (0xA7D4, 0xA7D4), (0xA7DD, 0xA7DD), (0xA7E2, 0xA7E2), (0xA7F1, 0xA7F1),
    (0xAB6C, 0xAB6D), (0x107BB, 0x107BF), (0x10940, 0x10959), (0x10EC5, 0x10EC7), (0x10ED9, 0x10EEE), (0x11B0A, 0x11B0A),
    (0x11DB0, 0x11DDB), (0x11DE0, 0x11DE9), (0x11DF1, 0x11DF1), (0x1246F, 0x1246F), (0x12475, 0x1247F), (0x12550, 0x12686),
    (0x16EA0, 0x16EB8), (0x16EBB, 0x16ED3), (0x16FF2, 0x16FF6), (0x187F8, 0x187FF), (0x18CD6, 0x18CDA), (0x18D09, 0x18D20),
    (0x18D80, 0x18DF2), (0x18E00, 0x19191), (0x191A0, 0x191D2), (0x1B123, 0x1B128), (0x1B168, 0x1B168), (0x1D6A6, 0x1D6A6),
    (0x1DF1F, 0x1DF24), (0x1DF2B, 0x1DF81), (0x1DF90, 0x1DF96), (0x1DFCD, 0x1DFFF), (0x1E6C0, 0x1E6DE), (0x1E6E0, 0x1E6E2),
    (0x1E6E4, 0x1E6E5), (0x1E6E7, 0x1E6ED), (0x1E6F0, 0x1E6F4), (0x1E6FE, 0x1E6FF), (0x2B73A, 0x2B73F), (0x2B81E, 0x2B81E),
    (0x2CEA2, 0x2CEAD), (0x323B0, 0x33479), (0x3D000, 0x3FC3F),
)
CACHED_PIECES = 400_000
CACHED_LENGTH = 64
_LOADED: dict[str, Callable[[str], int]] = {}


def byte_symbols() -> list[str]:
    """The printable stand-in of every byte in a byte-level vocabulary."""
    plain = {*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)}
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


def merged_count(symbols: list[str], ranks: dict[tuple[str, str], int]) -> int:
    """Symbols left after merging; ``symbols`` is consumed."""
    n = len(symbols)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    heap = []
    for i in range(n - 1):
        rank = ranks.get((symbols[i], symbols[i + 1]))
        if rank is not None:
            heap.append((rank, i))
    heapq.heapify(heap)
    left = n
    while heap:
        rank, i = heapq.heappop(heap)
        j = after[i]
        if not symbols[i] or j >= n or ranks.get((symbols[i], symbols[j])) != rank:
            continue  # one of the two has been merged since
        symbols[i] += symbols[j]
        symbols[j] = ""
        left -= 1
        k = after[i] = after[j]
        if k < n:
            before[k] = i
            rank = ranks.get((symbols[i], symbols[k]))
            if rank is not None:
                heapq.heappush(heap, (rank, i))
        h = before[i]
        if h >= 0:
            rank = ranks.get((symbols[h], symbols[i]))
            if rank is not None:
                heapq.heappush(heap, (rank, h))
    return left


class _Counts(dict):
    """Tokens per piece, filled on demand and emptied when it is full."""

    def __init__(self, ranks: dict[tuple[str, str], int]):
        super().__init__()
        self.ranks, self.symbols = ranks, byte_symbols()

    def __missing__(self, piece: str) -> int:
        count = merged_count([self.symbols[b] for b in piece.encode()], self.ranks)
        if len(piece) <= CACHED_LENGTH:
            if len(self) >= CACHED_PIECES:
                self.clear()
            self[piece] = count
        return count


def counter(vocabulary: bytes) -> Callable[[str], int]:
    """``text -> tokens`` for the contents of a byte-level ``tokenizer.json``."""
    known = hashlib.sha256(vocabulary).hexdigest()
    if known in _LOADED:
        return _LOADED[known]
    import regex

    spec = json.loads(vocabulary)
    merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in spec["model"]["merges"]]
    counts = _Counts({pair: i for i, pair in reversed(list(enumerate(merges)))})
    later = "".join(f"{chr(a)}-{chr(b)}" for a, b in LATER)
    usual, has_later = regex.compile(PIECES), regex.compile(f"[{later}]")
    strict = regex.compile(
        PIECES.replace(r"[^\s\p{L}\p{N}]", r"(?:[^\s\p{L}\p{N}]|[@])").replace(r"?\p{L}+", r"?(?:(?![@])\p{L})+")
        .replace(r"?\p{N}+", r"?(?:(?![@])\p{N})+").replace("[@]", f"[{later}]")
    )
    special = [t["content"] for t in spec.get("added_tokens", [])]
    splitter = regex.compile("|".join(map(regex.escape, sorted(special, key=len, reverse=True)))) if special else None

    def plain(text: str) -> int:
        pieces = usual if text.isascii() or not has_later.search(text) else strict
        if len(text) < 1_000_000:
            return sum(map(counts.__getitem__, pieces.findall(text)))
        return sum(counts[m.group()] for m in pieces.finditer(text))

    def count(text: str) -> int:
        if splitter is None or not any(s in text for s in special):
            return plain(text)
        parts = splitter.split(text)
        return sum(map(plain, parts)) + len(parts) - 1

    _LOADED[known] = count
    return count


def count_tokens(docs: DataFrame, vocabulary: str, text: str = "text", limit: int = 512) -> DataFrame:
    """``docs`` with ``n_bytes``, ``n_tokens`` and ``over_limit`` (more than ``limit`` tokens).

    ``vocabulary`` is the path of a byte-level ``tokenizer.json`` on the driver; its contents (a file of
    a few MB, whatever the corpus) are sent to the workers. Special strings inside texts are one token
    each, as in that library's default.
    """
    with open(vocabulary, "rb") as f:
        sent = docs.sparkSession.sparkContext.broadcast(f.read())

    @F.pandas_udf("long")
    def tokens(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        count = counter(sent.value)
        for texts in batches:
            yield texts.map(count).astype("int64")

    body = F.coalesce(F.col(text), F.lit(""))
    return docs.withColumns(
        {"n_bytes": F.octet_length(body).cast("long"), "n_tokens": tokens(body)}
    ).withColumn("over_limit", F.col("n_tokens") > limit)
