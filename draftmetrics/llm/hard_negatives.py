"""Hard negatives of anchors by a vector-approximation file.

Vectors become whole numbers, floor(``SCALE`` * x).  They are stored in packs: codes of one
byte a dimension (the cell of each component, cells being quantiles of the pack), the cells'
ends, and the exact vectors.  Anchors, a stated query set, meet the packs in blocks.  For a
block and a pack, the cells' centres and half-widths are looked up by code, and two matrix
products bound all scores from below and above (centre * anchor -/+ half-width * |anchor|).
Only candidates whose bounds may still enter are scored exactly:

1. positives: rows of the anchor's label whose upper bound reaches the k-th best lower bound
   or the k-th best exact score so far;
2. negatives: rows of other labels whose bounds touch the window of a positive's score and
   whose upper bound reaches the k-th best lower bound of those surely within it, or the
   k-th best exact score so far.

A task keeps the best so far of each anchor and gives one short list each, which are merged
by rank; nothing goes through the driver, and no list grows with the rows.  Each anchor
block is sent once to each share of packs.

Handling: rows with a null id, label or vector, or with a null or non-finite component, take
no part; rows that are equal in id, label and vector count once; a row never is a partner of
one with its own id; ties go to the smaller id; vectors are compared with vectors of their
own length; an anchor without positives, and a positive without negatives in its window,
give no row.  An empty table gives an empty table.  Scores that do not fit 63 bits raise.
Texts and other columns are not read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from draftmetrics.llm.shared import Scratch, tidied

SCALE = 256
#: Rows in a pack, anchors in a block, cells of a dimension, packs in a share.
PACK, BLOCK, CELLS, SHARE = 4096, 256, 64, 16
#: Anchor blocks whose best so far a task holds.
OPEN_BLOCKS = 64

_PACKED = "dim int, pack long, ids binary, labels binary, codes binary, low binary, high binary, kind string, vectors binary"


def whole_numbers(rows: DataFrame, id_col: str, vector_col: str, label: Column) -> DataFrame:
    """(id, label, v) of the rows that take part."""
    kept = rows.select(F.col(id_col).cast("long").alias("id"), label.cast("long").alias("label"), F.col(vector_col).alias("v"))
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    kept = kept.filter(F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("v").isNotNull()).filter(fine)
    return kept.withColumn("v", F.transform("v", lambda x: F.floor(x.cast("double") * SCALE))).distinct()


def cells(v: np.ndarray, n_cells: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(codes, low, high) of the rows of ``v``: the cell of each component, and each cell's ends."""
    n, dim = v.shape
    codes = np.zeros((n, dim), np.uint8)
    low, high = np.zeros((dim, n_cells), v.dtype), np.zeros((dim, n_cells), v.dtype)
    for d in range(dim):
        ordered = np.sort(v[:, d])
        starts = np.unique(ordered[np.arange(n_cells) * n // n_cells])  # values at which cells begin
        codes[:, d] = np.searchsorted(starts, v[:, d], side="right") - 1
        first = np.searchsorted(ordered, starts)
        low[d, : len(starts)] = starts
        high[d, : len(starts)] = ordered[np.append(first[1:], n) - 1]
    return codes, low, high


def packed(rows: DataFrame, pack: int = PACK, n_cells: int = CELLS) -> DataFrame:
    """The vector-approximation file: one row for each pack of vectors of one length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 32
        held: dict[int, list[tuple[int, int, list[int]]]] = {}

        def flush(dim: int) -> pa.RecordBatch:
            nonlocal number
            part = held.pop(dim)
            v = np.array([x for _, _, x in part], np.int64).reshape(len(part), dim)
            most = int(np.abs(v).max(initial=0))
            kind = "<i2" if most < 1 << 15 else "<i4" if most < 1 << 31 else "<i8"
            codes, low, high = cells(v, n_cells)
            row = [dim, number, np.array([i for i, _, _ in part], "<i8").tobytes(), np.array([x for _, x, _ in part], "<i8").tobytes(), codes.tobytes(), low.astype("<i8").tobytes(), high.astype("<i8").tobytes(), kind, v.astype(kind).tobytes()]
            number += 1
            types = [pa.int32(), pa.int64(), *[pa.binary()] * 5, pa.string(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, types)], names=[x.split()[0] for x in _PACKED.split(", ")])

        for batch in batches:
            for i, label, v in zip(*(c.to_pylist() for c in batch.columns)):
                held.setdefault(len(v), []).append((i, label, v))
                if len(held[len(v)]) == pack:
                    yield flush(len(v))
        for dim in sorted(held):
            yield flush(dim)

    return rows.select("id", "label", "v").mapInArrow(tidied(run), _PACKED)


def anchor_blocks(rows: DataFrame, n_anchors: int, block: int = BLOCK) -> DataFrame:
    """(dim, block, anchors): the query set in blocks of about ``block`` rows."""
    blocks = max(1, -(-n_anchors // block))
    cut = rows.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks))).withColumn("dim", F.size("v"))
    return cut.groupBy("dim", "block").agg(F.sort_array(F.collect_list(F.struct("id", "label", "v"))).alias("anchors"))


# -- one block against one pack ----------------------------------------------------------


class _Block:
    """Anchors of a block, with the best partners so far."""

    def __init__(self, anchors: list[dict]):
        self.ids = np.array([a["id"] for a in anchors], np.int64)
        self.labels = np.array([a["label"] for a in anchors], np.int64)
        self.v = np.array([a["v"] for a in anchors], np.int64).reshape(len(anchors), len(anchors[0]["v"]))
        self.real = self.v.astype(np.float64)
        self.most = int(np.abs(self.v).max(initial=0))
        self.best: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}  # (anchor, window) -> scores and ids, best first

    def keep(self, key: tuple[int, int], scores: np.ndarray, ids: np.ndarray, k: int) -> None:
        if key in self.best:
            scores, ids = np.concatenate([self.best[key][0], scores]), np.concatenate([self.best[key][1], ids])
        order = np.lexsort((ids, -scores))[:k]
        self.best[key] = scores[order], ids[order]

    def bar(self, key: tuple[int, int], k: int) -> float:
        scores = self.best.get(key, ((),))[0]
        return float(scores[-1]) if len(scores) == k else -np.inf


class _Pack:
    def __init__(self, row: dict):
        dim = row["dim"]
        self.ids, self.labels = np.frombuffer(row["ids"], "<i8"), np.frombuffer(row["labels"], "<i8")
        self.v = np.frombuffer(row["vectors"], row["kind"]).reshape(len(self.ids), dim)
        codes = np.frombuffer(row["codes"], np.uint8).reshape(len(self.ids), dim)
        low, high = (np.frombuffer(row[x], "<i8").reshape(dim, len(row[x]) // (8 * dim) if dim else 0) for x in ("low", "high"))
        at = np.arange(dim)
        centre, half = (low.astype(np.float64) + high) / 2, (high.astype(np.float64) - low) / 2
        self.centre, self.half = centre[at, codes], half[at, codes]  # table look-ups
        self.most = int(max(np.abs(low).max(initial=0), np.abs(high).max(initial=0)))

    def bounds(self, block: _Block) -> tuple[np.ndarray, np.ndarray]:
        """Lower and upper bounds of all scores (anchors x rows); without any where floats would not be exact."""
        reach = self.v.shape[1] * self.most * block.most
        if reach >= 1 << 62:
            raise OverflowError("scores do not fit 63 bits")
        if reach >= 1 << 51:
            whole = np.full((len(block.ids), len(self.ids)), np.inf)
            return -whole, whole
        middle, around = block.real @ self.centre.T, np.abs(block.real) @ self.half.T
        return middle - around, middle + around

    def scores(self, rows: np.ndarray, anchor: np.ndarray) -> np.ndarray:
        return self.v[rows].astype(np.int64) @ anchor


def _kth_largest(x: np.ndarray, k: int) -> np.ndarray:
    """The k-th largest of each row; minus infinity where there are fewer."""
    return np.partition(x, x.shape[1] - k, axis=1)[:, -k] if x.shape[1] >= k else np.full(len(x), -np.inf)


def near_rows(block: _Block, pack: _Pack, k: int) -> int:
    """Positives: the pack's rows that enter an anchor's first k of its own label; returns how many were scored."""
    low, high = pack.bounds(block)
    same = (block.labels[:, None] == pack.labels) & (block.ids[:, None] != pack.ids)
    bar = _kth_largest(np.where(same, low, -np.inf), k)
    scored = 0
    for i in np.flatnonzero(same.any(1)).tolist():
        rows = np.flatnonzero(same[i] & (high[i] >= max(bar[i], block.bar((i, 0), k))))
        if len(rows):
            scored += len(rows)
            block.keep((i, 0), pack.scores(rows, block.v[i]), pack.ids[rows], k)
    return scored


def window_rows(block: _Block, pack: _Pack, windows: dict[int, list[tuple[int, int, int]]], k: int) -> int:
    """Negatives: the pack's rows that enter the first k of an anchor's windows (number, least and largest score)."""
    low, high = pack.bounds(block)
    scored = 0
    for i, own in windows.items():
        other = (pack.labels != block.labels[i]) & (pack.ids != block.ids[i])
        may = []
        for j, least, most in own:
            sure = low[i][other & (low[i] >= least) & (high[i] <= most)]
            bar = np.partition(sure, len(sure) - k)[-k] if len(sure) >= k else -np.inf
            may.append(other & (low[i] <= most) & (high[i] >= max(least, bar, block.bar((i, j), k))))
        rows = np.flatnonzero(np.logical_or.reduce(may))
        if not len(rows):
            continue
        scored += len(rows)
        score = pack.scores(rows, block.v[i])
        for (j, least, most), m in zip(own, may):
            inside = m[rows] & (score >= least) & (score <= most)
            if inside.any():
                block.keep((i, j), score[inside], pack.ids[rows[inside]], k)
    return scored


_FOUND = "dim int, block long, anchor int, anchor_id long, slot int, score long, other_id long"


def _searched(blocks: DataFrame, packs: DataFrame, shares: int, k: int, windows: bool) -> DataFrame:
    """Each task's best partners for each anchor (and window)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, int], tuple[_Block, dict]] = {}

        def flush() -> pa.RecordBatch:
            rows = [(dim, number, i, int(b.ids[i]), j, s, x) for (dim, number), (b, _) in held.items() for (i, j), (scores, ids) in b.best.items() for s, x in zip(scores.tolist(), ids.tolist())]
            held.clear()
            types = [pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [()] * 7, types)], names=[x.split()[0] for x in _FOUND.split(", ")])

        for batch in batches:
            for r in range(batch.num_rows):
                row = {n: batch.column(c)[r].as_py() for c, n in enumerate(batch.schema.names) if n not in ("anchors", "windows")}
                key = (row["dim"], row["block"])
                if key not in held:
                    if len(held) >= OPEN_BLOCKS:
                        yield flush()
                    own: dict[int, list[tuple[int, int, int]]] = {}
                    if windows:
                        for w in batch.column(batch.schema.get_field_index("windows"))[r].as_py():
                            own.setdefault(w["anchor"], []).append((w["slot"], w["least"], w["most"]))
                    held[key] = _Block(batch.column(batch.schema.get_field_index("anchors"))[r].as_py()), own
                block, own = held[key]
                if windows:
                    window_rows(block, _Pack(row), own, k)
                else:
                    near_rows(block, _Pack(row), k)
        if held:
            yield flush()

    sent = blocks.withColumn("share", F.explode(F.sequence(F.lit(0), F.lit(shares - 1)))).withColumn("share", F.col("share").cast("long"))
    return sent.join(packs.withColumn("share", F.pmod(F.xxhash64("pack"), F.lit(shares))), ["dim", "share"]).mapInArrow(tidied(run), _FOUND)


def _first(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("dim", "block", "anchor", "slot").orderBy(F.desc("score"), "other_id")  # k rows from each task
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def mine(rows: DataFrame, is_anchor: Column, label: Column, positives: int = 5, negatives: int = 10, least_percent: int = 30, most_percent: int = 90, id_col: str = "vec_id", vector_col: str = "embedding", pack: int = PACK, block: int = BLOCK, n_cells: int = CELLS, share: int = SHARE) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) of all anchors.

    ``label`` is an expression over the columns of ``rows``, ``is_anchor`` one over ``id``.
    """
    scratch = Scratch(rows.sparkSession)
    marked = whole_numbers(rows, id_col, vector_col, label)
    clean = scratch.table(marked, "vectors")
    packs = scratch.table(packed(clean, pack, n_cells), "packs")
    n_packs = packs.count()
    shares = max(1, -(-n_packs // share), min(n_packs, rows.sparkSession.sparkContext.defaultParallelism))
    asked = clean.filter(is_anchor)
    blocks = scratch.table(anchor_blocks(asked, asked.count(), block), "anchor-blocks")
    near = scratch.table(_first(_searched(blocks, packs, shares, positives, False), positives).select("dim", "block", "anchor", "anchor_id", F.col("rank").alias("slot"), F.col("score").alias("positive_score"), F.col("other_id").alias("positive_id")), "positives")
    # 30 p <= 100 n <= 90 p has no solution for a negative p
    whole = lambda p, up: F.expr(f"positive_score DIV 100 * {p} + (positive_score % 100 * {p} + {99 if up else 0}) DIV 100")  # noqa: E731  exact for scores from 0
    asking = near.filter(F.col("positive_score") >= 0).select("dim", "block", F.struct("anchor", "slot", whole(least_percent, True).alias("least"), whole(most_percent, False).alias("most")).alias("w"))
    windows = asking.groupBy("dim", "block").agg(F.sort_array(F.collect_list("w")).alias("windows"))  # a block's anchors x positives
    found = _first(_searched(blocks.join(windows, ["dim", "block"]), packs, shares, negatives, True), negatives)
    return found.join(near.drop("anchor_id"), ["dim", "block", "anchor", "slot"]).select("anchor_id", "positive_id", "rank", F.col("other_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
