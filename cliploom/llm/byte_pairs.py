"""Byte-level byte-pair encoding by a file of ranks, and decoding.

The recorder that this library follows keeps no texts (its manifest's paths are its only strings), so the
operator is general: it works on any table with an integer id column and a text column.

Method: vectorised pre-tokenisation.  Code points become classes by one look-up in an array.  A small
automaton reads the classes; each class is a transition function on its states, and the composition of
functions is associative, so a stretch of a million characters is cut to rows of equal length, every row
is folded to one function by table look-ups over all rows at once, the folds are scanned, and the rows are
replayed from their true states, again all at once.  The automaton says where a match of the pattern begins.
The slices between borders are merged once each and kept in a cache of bounded size.  Where each token
begins in the text is kept, so decoding writes every token to its place.
"""

from __future__ import annotations

import base64
import functools
import heapq
from array import array
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cliploom.llm.vocab import public_file, text_slices

CACHE_PIECES = 400_000  # of at most LONG_PIECE bytes: some 80 MB a worker
LONG_PIECE = 64
ROW = 256  # characters of one row of the scan
CHUNK = 1 << 18  # tokens that are decoded at a time

LETTER, DIGIT, OTHER, SHORT, LONG, BLANK, LAST_SPACE, LAST_BLANK = range(8)
FRESH, LETTERS, DIGITS, OTHERS, BLANKS, SPACE, ONE_LEFT, TWO_LEFT = range(8)
#: What may follow an apostrophe in the pattern's contractions.
SHORT_ENDINGS, LONG_ENDINGS = "stmd", ("re", "ve", "ll")


def _step(state: int, kind: int) -> tuple[int, bool]:
    """The state after a character and whether a match begins at it.

    ``SHORT`` and ``LONG`` are apostrophes that one or two letters of a contraction follow.  ``LAST_SPACE``
    and ``LAST_BLANK`` are the last of a run of white space that does not end the text; such a space
    belongs to what follows.
    """
    if state == TWO_LEFT:
        return ONE_LEFT, False
    if state == ONE_LEFT:
        return FRESH, False
    if kind in (LETTER, DIGIT, OTHER):
        own = {LETTER: LETTERS, DIGIT: DIGITS, OTHER: OTHERS}[kind]
        return own, state not in (own, SPACE)
    if kind in (SHORT, LONG):
        if state in (OTHERS, SPACE):
            return OTHERS, False
        return (ONE_LEFT if kind == SHORT else TWO_LEFT), True
    if kind == BLANK:
        return BLANKS, state != BLANKS
    return (SPACE if kind == LAST_SPACE else FRESH), True


NEXT = np.array([[_step(s, k)[0] for s in range(8)] for k in range(8)], np.uint8)
BEGINS = np.array([[_step(s, k)[1] for s in range(8)] for k in range(8)], bool)
# a kind above 7 is the first character of a text: whatever came before, a match begins
NEXT = np.concatenate([NEXT, np.repeat(NEXT[:, FRESH : FRESH + 1], 8, axis=1)])
BEGINS = np.concatenate([BEGINS, np.ones((8, 8), bool)])


@functools.cache
def _monoid() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All functions that compositions of the kinds' transitions give: the functions, what each followed by
    a kind gives, and what each followed by each gives."""
    kinds = [tuple(row.tolist()) for row in NEXT]
    functions = [tuple(range(8))]
    number = {functions[0]: 0}
    for f in functions:  # grows while it is read
        for g in kinds:
            h = tuple(g[s] for s in f)
            if h not in number:
                number[h] = len(functions)
                functions.append(h)
    then = lambda f, g: number[tuple(g[s] for s in f)]
    by_kind = np.array([[then(f, g) for g in kinds] for f in functions], np.uint16)
    by_function = np.array([[then(f, g) for g in functions] for f in functions], np.uint16)
    return np.array(functions, np.uint8), by_kind, by_function


def match_starts(kinds: np.ndarray) -> np.ndarray:
    """Whether a match begins at each character, by a scan over transition functions."""
    n = len(kinds)
    functions, by_kind, by_function = _monoid()
    n_rows = -(-n // ROW)
    padded = np.full(n_rows * ROW, LETTER, np.uint8)
    padded[:n] = kinds
    columns = np.ascontiguousarray(padded.reshape(n_rows, ROW).T)
    fold = np.zeros(n_rows, np.uint16)
    for column in columns:
        fold = by_kind[fold, column]
    # inclusive scan of the rows' functions by doubling
    step = 1
    while step < n_rows:
        fold[step:] = by_function[fold[:-step], fold[step:]]
        step *= 2
    state = np.zeros(n_rows, np.uint8)
    state[0:1] = FRESH
    state[1:] = functions[fold[:-1], FRESH]
    starts = np.empty((ROW, n_rows), bool)
    for at, column in enumerate(columns):
        starts[at] = BEGINS[column, state]
        state = NEXT[column, state]
    return starts.T.reshape(-1)[:n]


def reference_classes(pattern_class: str) -> np.ndarray:
    """The code points of a class such as ``\\p{L}``, as the library that the ranks are made for knows it."""
    import tiktoken

    singles = {bytes([b]): b for b in range(256)}
    known = tiktoken.Encoding("classes", pat_str=pattern_class, mergeable_ranks=singles, special_tokens={})
    every = np.concatenate([np.arange(0xD800, dtype="<u4"), np.arange(0xE000, 0x110000, dtype="<u4")]).tobytes().decode("utf-32-le")
    return np.frombuffer(bytes(known.encode_ordinary(every)).decode().encode("utf-32-le"), "<u4")


@functools.cache
def class_table() -> np.ndarray:
    """Class of every code point: letter, digit, white space or other."""
    table = np.full(0x110000, OTHER, np.uint8)
    for kind, pattern in ((LETTER, r"\p{L}"), (DIGIT, r"\p{N}"), (BLANK, r"\s")):
        table[reference_classes(pattern)] = kind
    return table


def kinds_of(points: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Classes of code points with what their neighbours decide; ``first`` marks the first one of each text."""
    kinds = class_table()[points]
    one, two = np.zeros_like(points), np.zeros_like(points)  # the next characters of the same text, else 0
    inside = ~first[1:]
    one[:-1] = np.where(inside, points[1:], 0)
    two[:-2] = np.where(inside[:-1] & inside[1:], points[2:], 0)
    blank = kinds == BLANK
    last = np.zeros(len(points), bool)
    last[:-1] = blank[:-1] & ~blank[1:] & inside
    kinds[last] = np.where(points[last] == 0x20, LAST_SPACE, LAST_BLANK)
    at = np.flatnonzero(points == 0x27)
    if len(at):
        a, b = one[at], two[at]
        kinds[at[np.isin(a, [ord(c) for c in SHORT_ENDINGS])]] = SHORT
        for x, y in LONG_ENDINGS:
            kinds[at[(a == ord(x)) & (b == ord(y))]] = LONG
    return kinds + (first * 8).astype(np.uint8)


class Vocabulary(dict):
    """Ids of pieces by a rank file, merged when first asked for; and the bytes of every id."""

    def __init__(self, path: str):
        super().__init__()
        with open(path, "rb") as f:
            pairs = [line.split() for line in f if line.strip()]
        self.ranks = {base64.b64decode(token): int(rank) for token, rank in pairs}
        n = max(self.ranks.values()) + 1
        self.length = np.zeros(n, np.int64)
        for token, rank in self.ranks.items():
            self.length[rank] = len(token)
        self.place = np.cumsum(self.length) - self.length
        flat = bytearray(int(self.length.sum()))
        for token, rank in self.ranks.items():
            flat[self.place[rank] : self.place[rank] + len(token)] = token
        self.flat = np.frombuffer(bytes(flat), np.uint8)

    def merged(self, piece: bytes) -> list[int]:
        """Ids of one piece: the adjacent pair of lowest rank becomes one symbol while any pair has a rank."""
        ranks = self.ranks
        if (whole := ranks.get(piece)) is not None:
            return [whole]
        n = len(piece)
        end = list(range(1, n + 1))  # of the symbol that begins here; 0 once it is part of an earlier one
        before = list(range(-1, n))
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, stop = heapq.heappop(heap)
            j = end[i]
            if not j or j >= n or end[j] != stop:
                continue  # one side has changed since
            end[i], end[j] = stop, 0
            if stop < n:
                before[stop] = i
                if (r := ranks.get(piece[i : end[stop]])) is not None:
                    heapq.heappush(heap, (r, i, end[stop]))
            if (h := before[i]) >= 0 and (r := ranks.get(piece[h:stop])) is not None:
                heapq.heappush(heap, (r, h, stop))
        out, at = [], 0
        while at < n:
            out.append(ranks[piece[at : end[at]]])
            at = end[at]
        return out

    def __missing__(self, piece: bytes) -> bytes:
        ids = array("I", self.merged(piece)).tobytes()
        if len(piece) <= LONG_PIECE:
            self[piece] = ids
        return ids

    def encode(self, texts: Sequence[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of all texts after each other, where each token begins in its text's bytes, tokens of each text."""
        whole = [(t or "").encode() for t in texts]
        joined = b"".join(whole)
        sizes = np.fromiter(map(len, whole), np.int64, len(whole))
        if not joined:
            return np.zeros(0, "<u4"), np.zeros(0, "<u4"), np.zeros(len(whole), np.int64)
        raw = np.frombuffer(joined, np.uint8)
        places = np.flatnonzero((raw & 0xC0) != 0x80)  # of characters, in bytes
        points = np.frombuffer(joined.decode().encode("utf-32-le"), "<u4")
        ends = np.cumsum(sizes)
        first = np.zeros(len(raw), bool)
        first[(ends - sizes)[sizes > 0]] = True
        starts = places[match_starts(kinds_of(points, first[places]))].tolist()
        if len(self) > CACHE_PIECES:
            self.clear()
        pieces = map(joined.__getitem__, map(slice, starts, [*starts[1:], len(joined)]))
        ids = np.frombuffer(b"".join(map(self.__getitem__, pieces)), np.uint32).astype("<u4")
        done = np.cumsum(self.length[ids])
        counts = np.searchsorted(done, ends, side="right")
        counts = np.diff(counts, prepend=0)
        offsets = done - self.length[ids] - np.repeat(ends - sizes, counts)
        return ids, offsets.astype("<u4"), counts

    def decode(self, ids: np.ndarray, offsets: np.ndarray) -> bytes:
        """Bytes of the tokens, each at its offset; a million bytes or so are made at a time."""
        out = []
        for at in range(0, len(ids), CHUNK):
            part, begin = ids[at : at + CHUNK].astype(np.int64), offsets[at : at + CHUNK].astype(np.int64)
            if part.max() >= len(self.length):
                raise ValueError(f"no token has the id {part.max()}")
            length = self.length[part]
            if (begin[1:] != begin[:-1] + length[:-1]).any():
                raise ValueError("the offsets are not those of the ids")
            total = int(length.sum())
            source = np.repeat(self.place[part] - begin, length) + np.arange(begin[0], begin[0] + total)
            out.append(self.flat[source].tobytes())
        return b"".join(out)


@functools.cache
def vocabulary(path: str) -> Vocabulary:
    """One vocabulary and its cache for each worker process."""
    return Vocabulary(path)


def encode(docs: DataFrame, ranks: str | None = None, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``doc_id, n_tokens, ids, offsets`` of every row: each match of the pattern is encoded by itself.

    ``ids`` are little-endian unsigned 32-bit integers in a binary, and ``offsets`` likewise the place of each
    token's first byte in the text's UTF-8.  ``ranks`` is the path of a rank file, the same on every machine (the
    public multilingual file if not given).  There are no special tokens: their strings are ordinary text.

    Null and empty texts have no tokens.  Texts of any length are encoded whole.  Repeated rows and null ids
    stay as they are.  Other columns are not read.
    """
    file = ranks or public_file("byte_bpe_multi_50k.tiktoken")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = vocabulary(file)
        for batch in batches:
            at = 0
            for texts in text_slices(batch.column(1)):
                ids, offsets, counts = words.encode(texts)
                stops = (np.cumsum(counts) * 4).tolist()
                spans = list(zip([0, *stops[:-1]], stops, strict=True))
                held, where = ids.tobytes(), offsets.tobytes()
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(at, len(texts)), pa.array(counts, pa.int64()),
                    pa.array([held[a:b] for a, b in spans], pa.binary()), pa.array([where[a:b] for a, b in spans], pa.binary())],
                    names=["doc_id", "n_tokens", "ids", "offsets"])
                at += len(texts)

    return docs.select(F.col(id_column).cast("long").alias("doc_id"), text_column).mapInArrow(
        scan, "doc_id long, n_tokens long, ids binary, offsets binary")


def decode(encoded: DataFrame, ranks: str | None = None) -> DataFrame:
    """``encoded`` as ``encode`` gives it, with ``decoded``: the bytes of each row's tokens.

    A row of null ids or null offsets has null bytes; one without tokens has none.  Ids that no token has, and
    offsets that do not belong to the ids, are errors.  Other columns stay, and a column ``decoded`` is replaced.
    """
    file = ranks or public_file("byte_bpe_multi_50k.tiktoken")
    kept = encoded.drop("decoded")
    at_ids, at_offsets = kept.columns.index("ids"), kept.columns.index("offsets")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = vocabulary(file)
        for batch in batches:
            done = 0
            while done < batch.num_rows:
                out, size, begin = [], 0, done
                while done < batch.num_rows and size < 1 << 20:
                    ids, offsets = batch.column(at_ids)[done].as_py(), batch.column(at_offsets)[done].as_py()
                    got = None
                    if ids is not None and offsets is not None:
                        got = words.decode(np.frombuffer(ids, "<u4"), np.frombuffer(offsets, "<u4"))
                        size += len(got)
                    out.append(got)
                    done += 1
                yield pa.RecordBatch.from_arrays(
                    [*batch.slice(begin, done - begin).columns, pa.array(out, pa.binary())], names=[*batch.schema.names, "decoded"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema)
    return kept.mapInArrow(scan, f"{schema}, decoded binary")
