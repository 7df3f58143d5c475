"""Oversized texts cut into pieces within a token limit, at natural boundaries, with an overlap.

Every token border of a text has a boundary strength (paragraph, line, sentence, clause, word, inside a word). A
sparse table answers range-maximum queries over the strengths, so the strongest cut in each permissible window of
lengths is found in constant time; ties go to the rightmost border. The next piece starts the overlap before the cut.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from freshet.llm.tokens import MEMO, VOCABULARY, Tokenizer, tokenizer

LIMIT, OVERLAP = 1024, 64
#: Share of the limit that a piece fills at least when a natural boundary is sought.
FILL = 0.5
#: Borders on either side of the overlap that are tried for the exact number of tokens.
NEAR = 12
# Strengths, strongest last.
BROKEN, INSIDE, WORD, CLAUSE, SENTENCE, LINE, PARAGRAPH = range(-1, 6)

_WORD, _SPACE, _STOP, _MARK, _LINE = 1, 2, 4, 8, 16
_CLASS = np.zeros(256, np.uint8)
for _c in b" \t\v\f\r":
    _CLASS[_c] |= _SPACE
_CLASS[10] |= _SPACE | _LINE
for _c in b".!?":
    _CLASS[_c] |= _STOP
for _c in b",;:)]":
    _CLASS[_c] |= _MARK
_CLASS[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] |= _WORD


def strengths(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Strength of a cut before each byte position of ``at`` (inner positions of the text).

    A cut before white space, or after it, is judged by what precedes the white space. A position within a UTF-8
    character is BROKEN and never chosen.
    """
    cls = _CLASS[data]
    space = (cls & _SPACE) > 0
    line = (cls & _LINE) > 0
    n = len(data)
    index = np.arange(n)
    # Last byte before each position that is no white space, and line ends since then.
    solid = np.maximum.accumulate(np.where(~space, index, -1))
    lines = np.cumsum(line)
    prev = at - 1
    base = solid[prev]
    gaps = lines[prev] - np.where(base >= 0, lines[np.maximum(base, 0)], 0)
    before = cls[np.maximum(base, 0)] * (base >= 0)
    spaced = space[prev] | space[at]
    # A line end right after the cut counts too, when the cut stands before the white space.
    here = np.where(space[at] & line[at], 1, 0)
    out = np.full(len(at), INSIDE, np.int8)
    out[spaced] = WORD
    out[~spaced & ((cls[prev] & _WORD) == 0)] = WORD
    out[spaced & ((before & _MARK) > 0)] = CLAUSE
    out[spaced & ((before & _STOP) > 0)] = SENTENCE
    out[(gaps >= 1) | (here > 0)] = LINE
    out[gaps >= 2] = PARAGRAPH
    out[(data[at] & 0xC0) == 0x80] = BROKEN
    return out


class RangeMaximum:
    """Sparse table: the rightmost position of the maximum of any range in constant time."""

    def __init__(self, values: np.ndarray):
        # Packing the position under the value makes the maximum also the rightmost.
        best = values.astype(np.int64) * (1 << 40) + np.arange(len(values))
        self.rows, width = [best], 1
        while 2 * width <= len(values):
            last = self.rows[-1]
            self.rows.append(np.maximum(last[: len(last) - width], last[width:]))
            width *= 2

    def query(self, a: int, b: int) -> tuple[int, int]:
        """(value, position) over [a, b]."""
        k = (b - a + 1).bit_length() - 1
        best = max(int(self.rows[k][a]), int(self.rows[k][b - (1 << k) + 1]))
        return best >> 40, best & ((1 << 40) - 1)


def cuts(text: str, limit: int = LIMIT, overlap: int = OVERLAP, fill: float = FILL, tok: Tokenizer | None = None) -> list[tuple[int, int, int]]:
    """(first byte, end byte, tokens) of the pieces; one piece where the text is within the limit.

    Each piece holds at most ``limit`` tokens, counted anew on the piece itself. Consecutive pieces share ``overlap``
    tokens, counted on the shared text; where no border near there gives that number, the next higher one.
    """
    if not 0 <= overlap < int(limit * fill):
        raise ValueError("the overlap must stay under the least fill")
    tok = tok or tokenizer()
    raw = text.encode("utf-8", "replace")
    at = tok.starts(text)
    n = len(at) - 1
    if n <= limit:
        return [(0, len(raw), n)]
    data = np.frombuffer(raw, np.uint8)
    force = np.concatenate(([PARAGRAPH], strengths(data, at[1:n]), [PARAGRAPH]))
    table = RangeMaximum(force)
    out, start = [], 0
    while True:
        room = limit
        while True:
            if n - start <= room:
                end = n
            else:
                end = _solid(table, start + max(1, int(room * fill)), start + room, start)
            a, b = int(at[start]), int(at[end])
            # Cutting regroups white space and parts of words, so a piece near the limit is counted anew.
            size = end - start if end - start < limit - 8 and force[start] > INSIDE and force[end] > INSIDE else tok.count(raw[a:b].decode("utf-8", "replace"))
            if size <= limit or room <= 8:
                break
            room -= max(1, size - limit)
        out.append((a, b, size))
        if end == n:
            return out
        start = _step_back(tok, raw, at, force, end, overlap, start)


def _step_back(tok: Tokenizer, raw: bytes, at: np.ndarray, force: np.ndarray, end: int, overlap: int, floor: int) -> int:
    """The border beyond ``floor`` from which the text up to ``end`` holds exactly ``overlap`` tokens, counted on that text.

    Where the words there regroup so that none does, the border nearest to it that holds more; where there is none, ``end``.
    """
    if not overlap:
        return end
    b, best = int(at[end]), None
    for d in sorted(range(-NEAR, NEAR + 1), key=lambda d: (abs(d), d)):
        s = end - overlap + d
        if s <= floor or s >= end or force[s] == BROKEN:
            continue
        n = tok.count(raw[int(at[s]) : b].decode("utf-8", "replace"))
        if n == overlap:
            return s
        if n > overlap and (best is None or n < best[0]):
            best = (n, s)
    return best[1] if best else end


def _solid(table: RangeMaximum, a: int, b: int, floor: int) -> int:
    """Strongest border in [a, b]; a range inside one UTF-8 character is widened to the left, not beyond ``floor`` + 1."""
    while True:
        force, at = table.query(a, b)
        if force > BROKEN or a <= floor + 1:
            return at
        a = max(floor + 1, a - 4)


def split_texts(df: DataFrame, key: str = "doc_id", text: str = "text", limit: int = LIMIT, overlap: int = OVERLAP, fill: float = FILL, vocabulary: str = VOCABULARY, only_oversized: bool = False) -> DataFrame:
    """``key, piece, n_pieces, start_byte, end_byte, n_tokens, piece_text``.

    A text within the limit is one piece; ``only_oversized`` leaves those out, and skips all texts of at most ``limit``
    bytes before they reach Python, since a byte-level token holds a byte at least. Null and empty texts give no piece.
    Pieces cover the text; dropping the overlap restores it byte for byte. Copies give the same pieces under their own
    key. Each text is cut where it lies: no shuffle.
    """
    key_type = df.schema[key].dataType.simpleString()
    rows = df.select(F.col(key).alias("key"), F.col(text).alias("text")).filter(F.octet_length("text") > (limit if only_oversized else 0))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = tokenizer(vocabulary)
        for b in batches:
            keys, index, cols = b.column(0), [], ([], [], [], [], [], [])
            for i, t in enumerate(b.column(1).to_pylist()):
                pieces = MEMO.get(("cuts", limit, overlap, fill, vocabulary), t, lambda t=t: cuts(t, limit, overlap, fill, tok))
                if only_oversized and len(pieces) == 1:
                    continue
                raw = t.encode("utf-8", "replace")
                for k, (a, z, size) in enumerate(pieces):
                    index.append(i)
                    for c, v in zip(cols, (k, len(pieces), a, z, size, raw[a:z].decode("utf-8", "replace"))):
                        c.append(v)
            if index:
                types = (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.string())
                yield pa.RecordBatch.from_arrays([keys.take(pa.array(index)), *(pa.array(c, k) for c, k in zip(cols, types))], ["key", "piece", "n_pieces", "start_byte", "end_byte", "n_tokens", "piece_text"])

    out = rows.mapInArrow(run, f"key {key_type}, piece int, n_pieces int, start_byte bigint, end_byte bigint, n_tokens int, piece_text string")
    return out.withColumnRenamed("key", key)


def found(df: DataFrame) -> DataFrame:
    """Documents longer than the limit: those that the splitter cuts."""
    return split_texts(df, only_oversized=True).filter(F.col("piece") == 0).select("doc_id")
