"""Cost-balanced packing of tokenised documents into fixed-length training sequences.

The cost of a piece of n tokens is ``linear * n + quadratic * n * n`` (projections plus
attention within the piece).  Documents are packed in groups of about ``GROUP_TOKENS``
ids (some thousand sequences), in the order in which a task reads them, so nothing is
shuffled and a task holds one group.  Full sequences are cut from documents that are at
least one sequence long, whose cost no placement changes; what is left is taken in
descending length and each piece goes to the cheapest sequence with room for it, or is cut
to fill the roomiest one.

Whole sequences are filled to the last id.  What is left of a group is carried over to the
task's next one; what is left at a task's end, less than one sequence, becomes sequences
whose lengths are powers of two, which need no padding.

Nulls: a null text is its end id alone, as an empty one; a null doc_id stays null.  Equal
rows are packed each for itself, pieces of one length in the order in which they were read.
A very long text is cut like any other; its ids are held at once.  An empty table gives an
empty table.  Other columns are not read, whatever their names.  Group borders follow the
input's partitions, so ``sequence_id`` (task number and running number) names sequences of
one layout of the input.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from draftmetrics.llm.shared import text_slices, tidied

#: Ids packed together; one longer document is a group of its own.
GROUP_TOKENS = 1 << 22
#: Distinct words whose ids a worker holds (about 100 bytes each).
CACHE_PIECES = 400_000

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, sequence_tokens long, cost double"


def place(lengths: list[int], capacity: int, linear: float = 1.0, quadratic: float | None = None, tail: bool = True) -> tuple[list[tuple[int, int, int, int, int]], list[int]]:
    """Pieces (document, start, length, sequence, offset) and the tokens of each sequence.

    Without ``tail`` what fills no whole sequence is left over: pieces of sequence -1.
    """
    quadratic = 1.0 / capacity if quadratic is None else quadratic
    pieces: list[tuple[int, int, int, int, int]] = []
    full: list[int] = []
    rest: list[tuple[int, int, int]] = []
    for d, n in enumerate(lengths):
        for k in range(n // capacity):
            pieces.append((d, k * capacity, capacity, len(full), 0))
            full.append(capacity)
        if n % capacity:
            rest.append((n % capacity, d, n - n % capacity))
    total = sum(n for n, _, _ in rest)
    short = [1 << k for k in range(capacity.bit_length() - 1, -1, -1) if (total % capacity) >> k & 1]
    room = np.array([capacity] * (total // capacity) + short * tail, np.int64)
    cost = np.zeros(len(room))
    cost[total // capacity :] = np.inf  # short sequences take what is cut last
    used = np.zeros(len(room), np.int64)
    rest.sort(key=lambda x: (-x[0], x[1]))
    for n, d, start in rest:
        while n:
            fits = np.where(room >= n, cost, np.inf)
            at = int(fits.argmin()) if len(fits) else 0
            if not len(fits) or not np.isfinite(fits[at]):
                at = int(room.argmax()) if len(fits) else -1
            if at < 0 or not room[at]:  # no room is left
                pieces.append((d, start, n, -1, 0))
                break
            take = min(n, int(room[at]))
            pieces.append((d, start, take, len(full) + at, int(used[at])))
            used[at] += take
            room[at] -= take
            cost[at] += linear * take + quadratic * take * take
            n, start = n - take, start + take
    return pieces, full + used.tolist()


def pack(docs: DataFrame, tokenizer_path: str, end_id: int = 2, capacity: int = 4096, linear: float = 1.0, quadratic: float | None = None, group_tokens: int = GROUP_TOKENS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each piece: where it lies in its document and in its sequence."""
    per_square = 1.0 / capacity if quadratic is None else quadratic

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from draftmetrics.llm.tokens import tokenizer

        tok = tokenizer(tokenizer_path, CACHE_PIECES)
        tail = np.array([end_id], "<u4")
        base = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 36
        made = 0
        held: list[tuple[int | None, int, int, np.ndarray]] = []  # document, start and ids of a piece, ids of the document
        size = 0

        def flush(last: bool) -> pa.RecordBatch:
            nonlocal made, held, size
            pieces, filled = place([len(x) for _, _, _, x in held], capacity, linear, per_square, last)
            pieces.sort(key=lambda p: (p[3], p[4]))
            left = [(held[d][0], held[d][1] + s, held[d][2], held[d][3][s : s + n].copy()) for d, s, n, q, _ in pieces if q < 0]
            rows = [(held[d][0], held[d][1] + s, n, zlib.crc32(held[d][3][s : s + n].tobytes()), held[d][2], base + made + q, o, filled[q], linear * n + per_square * n * n) for d, s, n, q, o in pieces if q >= 0]
            columns = list(zip(*rows)) if rows else [()] * 9
            made += len(filled)
            held, size = left, sum(len(x) for _, _, _, x in left)
            kinds = [pa.int64()] * 8 + [pa.float64()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=[x.split()[0] for x in SCHEMA.split(", ")])

        for batch in batches:
            ids = batch.column(0)
            for a, b, texts in text_slices(batch.column(1), 1 << 20):
                for d, x in zip(ids.slice(a, b - a).to_pylist(), tok.encode(texts)):
                    x = np.concatenate([x, tail]).astype("<u4")
                    if size >= capacity and size + len(x) > group_tokens:
                        yield flush(False)
                    held.append((d, 0, len(x), x))
                    size += len(x)
        if held:
            yield flush(True)

    picked = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return picked.mapInArrow(tidied(run), SCHEMA)
