"""Token counts of texts under byte-level byte-pair encoding, without making ids.

The recorder that this library follows keeps no text, so the operator is general.

Method: a pre-token's bytes are a linked list of symbols, and a heap holds the rank of every adjacent
pair that may merge.  The lowest rank is popped and merged while there is one; the count is the number
of initial symbols minus the number of merges.  Pre-tokens are counted once per worker while they stay
in a cache of bounded size.
"""

from __future__ import annotations

import functools
import heapq
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cliploom.llm.vocab import byte_letters, public_file

CACHE_ENTRIES = 600_000
LONG_PIECE = 64
#: Fixed value: how the vocabulary's library cuts a text into pre-tokens (the public byte-level pattern).
PRE_TOKEN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: White space as that pattern's library knows it.
SPACE = r"\t\n\x0b\f\r \x85\xa0  -     　"
#: Pre-tokens begin at these borders too; between them a stretch can be counted by itself.
STRETCH = rf" ?[^{SPACE}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]"


class Counter:
    """Counts tokens by the merges of one vocabulary file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            content = json.load(f)
        merges = (m.split(" ") if isinstance(m, str) else m for m in content["model"]["merges"])
        self.ranks = {(a, b): rank for rank, (a, b) in enumerate(merges)}
        self.letters = byte_letters()
        special = [t["content"] for t in content.get("added_tokens", [])]
        self.special = re.compile("|".join(re.escape(s) for s in sorted(special, key=len, reverse=True))) if special else None
        self.pre_token = regex.compile(PRE_TOKEN.replace(r"\s", f"[{SPACE}]").replace(f"[^[{SPACE}]", f"[^{SPACE}").replace(r"\S", f"[^{SPACE}]"))
        self.stretch = re.compile(STRETCH)
        self.cache: dict[str, int] = {}
        self.parts: dict[str, int] = {}

    def merged(self, piece: str) -> int:
        """Symbols left of one pre-token after all merges."""
        symbols = [self.letters[b] for b in piece.encode("utf-8", "surrogatepass")]
        n = len(symbols)
        after, before = [*range(1, n), -1], [*range(-1, n - 1)]
        ranks = self.ranks
        heap = [(r, i) for i in range(n - 1) if (r := ranks.get((symbols[i], symbols[i + 1]))) is not None]
        heapq.heapify(heap)
        left = n
        while heap:
            rank, i = heapq.heappop(heap)
            j = after[i]
            # stale unless both sides still stand and still make the pair of this rank
            if symbols[i] == "" or j < 0 or ranks.get((symbols[i], symbols[j])) != rank:
                continue
            symbols[i] += symbols[j]
            symbols[j] = ""
            left -= 1
            after[i] = k = after[j]
            if k >= 0:
                before[k] = i
                if (r := ranks.get((symbols[i], symbols[k]))) is not None:
                    heapq.heappush(heap, (r, i))
            if (h := before[i]) >= 0 and (r := ranks.get((symbols[h], symbols[i]))) is not None:
                heapq.heappush(heap, (r, h))
        return left

    def _part(self, piece: str) -> int:
        n = self.parts.get(piece)
        if n is None:
            n = self.merged(piece)
            if len(piece) <= LONG_PIECE:
                if len(self.parts) >= CACHE_ENTRIES:
                    self.parts.clear()
                self.parts[piece] = n
        return n

    def _learn(self, pieces: list[str]) -> int:
        total = 0
        for piece in pieces:
            n = self.cache.get(piece)
            if n is None:
                n = sum(map(self._part, self.pre_token.findall(piece)))
                if len(piece) <= LONG_PIECE:
                    if len(self.cache) >= CACHE_ENTRIES:
                        self.cache.clear()
                    self.cache[piece] = n
            total += n
        return total

    def plain(self, text: str) -> int:
        pieces = self.stretch.findall(text)
        try:
            return sum(map(self.cache.__getitem__, pieces))
        except KeyError:
            return self._learn(pieces)

    def count(self, text: str) -> int:
        if self.special is None or self.special.search(text) is None:
            return self.plain(text)
        parts = self.special.split(text)
        return len(parts) - 1 + sum(map(self.plain, parts))


@functools.cache
def counter(path: str) -> Counter:
    return Counter(path)


def token_counts(docs: DataFrame, tokenizer: str | None = None, id_column: str = "doc_id", text_column: str = "text",
                 limit: int = 512) -> DataFrame:
    """``doc_id, n_bytes`` (UTF-8), ``n_tokens`` and ``over_limit`` (more than ``limit`` tokens) of every row.

    ``tokenizer`` is the path of a byte-level BPE file, the same on every machine (the public 50k-word
    file if not given).  The vocabulary's special strings inside a text count as one token each.

    Null and empty texts have no bytes and no tokens.  Repeated rows and null ids stay as they are.
    Other columns are not read.
    """
    file = tokenizer or public_file("byte_bpe_50k.json")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(file).count
        for batch in batches:
            texts = batch.column(1)
            n = np.array([count(texts[i].as_py() or "") for i in range(batch.num_rows)], np.int64)
            size = pa.compute.fill_null(pa.compute.binary_length(texts), 0).cast(pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), size, pa.array(n), pa.array(n > limit)], names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return docs.select(F.col(id_column).cast("long").alias("doc_id"), text_column).mapInArrow(
        scan, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
