"""Token ids packed into rows of fixed length by best-fit decreasing.

A window of documents is packed at once: longest first, each into the open row with the least room that still holds
it, found in a segment tree over capacities in logarithmic time. Documents longer than a row are split losslessly into
full rows and a rest, and each piece is a segment of its own. A packed row holds the ids, the cumulative segment
lengths and where each segment's positions start anew. Windows follow the input, so nothing is shuffled, memory is
bounded by a window, and a lost task is redone alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hopweave.llm.bpe import Encoder, vocabulary
from hopweave.llm.common import as_bytes, text_or_empty

#: Ids of a row, the id that fills it up, and the tokens of a window.
ROW, PAD, WINDOW_TOKENS = 2048, 49407, 4_000_000


class Capacities:
    """A segment tree over room 0..size: how many open rows have it. first(n): the least room of n or more."""

    def __init__(self, size: int):
        self.leaves = 1 << size.bit_length()
        self.count = [0] * (2 * self.leaves)

    def add(self, room: int, n: int) -> None:
        at = room + self.leaves
        while at:
            self.count[at] += n
            at >>= 1

    def first(self, room: int) -> int | None:
        at = room + self.leaves
        if not self.count[at]:
            while at > 1 and (at & 1 or not self.count[at + 1]):
                at >>= 1
            if at <= 1:
                return None
            at += 1
            while at < self.leaves:
                at = 2 * at if self.count[2 * at] else 2 * at + 1
        return at - self.leaves


def pack(lengths: list[int], row: int = ROW) -> list[list[tuple[int, int, int]]]:
    """Rows of (item, start, length), by best-fit decreasing; items longer than a row are split. Ties keep their order.
    An item of length 0 is a segment of no ids."""
    pieces = [(i, at, min(row, n - at)) for i, n in enumerate(lengths) for at in range(0, max(n, 1), row)]
    pieces.sort(key=lambda p: -p[2])
    tree, rows, by_room = Capacities(row), [], [[] for _ in range(row + 1)]
    for piece in pieces:
        room = tree.first(piece[2])
        if room is None:
            room = row
            by_room[room].append(len(rows))
            rows.append([])
            tree.add(room, 1)
        at = by_room[room].pop()
        tree.add(room, -1)
        rows[at].append(piece)
        by_room[room - piece[2]].append(at)
        tree.add(room - piece[2], 1)
    return rows


PACKED = "window long, row int, doc_ids array<long>, piece_starts array<int>, cu_seqlens array<int>, position_resets array<int>, n_ids int, ids binary"


def packed(docs: DataFrame, row: int = ROW, pad: int = PAD, window_tokens: int = WINDOW_TOKENS, path: str | None = None) -> DataFrame:
    """One line per packed row: doc_ids of its segments and at which token of its document each starts; cu_seqlens, from 0 to n_ids;
    position_resets, where positions start at 0 again (the padding's start too, where there is padding); ids, `row` little-endian unsigned 32-bit ids.

    Null and empty texts are segments without ids, so that every row of docs is found again; repeated rows and null doc_ids stay;
    very long texts are split; an empty table gives an empty table. Other columns are ignored.
    """

    def flush(names: list, ids: list[np.ndarray], window: int) -> pa.RecordBatch:
        rows = pack([len(x) for x in ids], row)
        cols: list[list] = [[] for _ in range(8)]
        for r, segments in enumerate(rows):
            ends = np.cumsum([0, *[n for _, _, n in segments]])
            matrix = np.full(row, pad, "<u4")
            for (i, at, n), start in zip(segments, ends, strict=False):
                matrix[start : start + n] = ids[i][at : at + n]
            total = int(ends[-1])
            values = (window, r, [names[i] for i, _, _ in segments], [at for _, at, _ in segments], ends.tolist(), [*dict.fromkeys([*ends[:-1].tolist(), *([total] if total < row else [])])], total, matrix.tobytes())
            for c, v in zip(cols, values, strict=True):
                c.append(v)
        types = [pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.int32(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], [x.split()[0] for x in PACKED.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(vocabulary(path))
        names, ids, held, window = [], [], 0, None
        for batch in batches:
            for name, text, at in zip(batch.column(0).to_pylist(), as_bytes(batch.column(1)), batch.column(2).to_pylist(), strict=True):
                window = at if window is None else window
                names.append(name)
                ids.append(np.frombuffer(encoder.encode(text), "<u4"))
                held += len(ids[-1])
                if held >= window_tokens:
                    yield flush(names, ids, window)
                    names, ids, held, window = [], [], 0, None
        if names:
            yield flush(names, ids, window)

    return text_or_empty(docs).withColumn("at", F.monotonically_increasing_id()).mapInArrow(run, PACKED)


def matrix(rows: list) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
    """Of collected or read lines of packed(): the id matrix, each row's cu_seqlens, and the position matrix."""
    ids = np.stack([np.frombuffer(r["ids"], "<u4") for r in rows]) if rows else np.zeros((0, 0), "<u4")
    positions = np.zeros(ids.shape, np.int32)
    for p, r in zip(positions, rows, strict=True):
        cuts = [*r["position_resets"], len(p)]
        for a, b in zip(cuts, cuts[1:], strict=False):
            p[a:b] = np.arange(b - a)
    return ids, [np.array(r["cu_seqlens"], np.int32) for r in rows], positions


def write(rows: DataFrame, path: str) -> None:
    """The packed rows as Parquet; ids stay fixed-length binary, so a file's column is its id matrix."""
    rows.write.parquet(path)
