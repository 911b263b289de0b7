"""Exact n-gram Jaccard join by universe partitions and the pigeonhole principle.

Two shingle sets of sizes a and b with Jaccard similarity of at least t differ in at most
H = floor((1 - t) / (1 + t) * (a + b)) shingles.  The universe (64-bit shingle hashes) is
cut into M segments of equal width, one cut for each size band; a pair belongs to the
band of its larger set.  Every set is indexed by its first k segments, so that k covers
its largest possible H, in one of two ways, whichever costs less in a band:

* *plain*: one signature for each segment's subset.  With k = H + 1 + e segments at
  least e + 1 subsets of a pair are equal.  Empty subsets are left out, unless a set has
  more than e of them: so a pair always shares a signature.
* *one-deletion*: a segment's subset and all subsets that lack one shingle.  With
  2 k >= H + 1 segments one of them differs in one shingle at most.

Equal sets are one class, met before the join.  In every bucket of equal signatures the
members are verified against the bucket's smallest class (a star, never all pairs);
verified pairs make components.  Members that met the same pivot and are then still in
different components are compared with one another in blocks, and each comparison passes
on a spanning forest of the links that it finds.  So no link between components is lost,
and no row stands for a pair that isn't linked.

Before any text moves, pairs and blocks are compared by *sketches*: bit maps in which
every shingle of a set flips one bit.  Two sketches differ in no more bits than the sets
in shingles, so what they reject cannot be linked; whole texts decide on the rest.

Words and shingles are compared as 64-bit hashes (``wordhash``).  Nulls: a null text or
one without words has no set and no links; a null doc_id stays null and never names a
component.  Repeated rows share their class.  Very long texts are hashed in blocks of
bounded memory; a set's hashes are held as a whole.  An empty table gives an empty table.
Other columns of ``keep_one`` stay, whatever their names.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from draftmetrics.llm.components import components
from draftmetrics.llm.rowmap import free_name
from draftmetrics.llm.shared import Scratch, slices, table, text_slices, tidied
from draftmetrics.llm.wordhash import hash_words, mix, separators

#: Words are runs of bytes other than blank and \x09-\x0D.
WORDS = separators(lambda b: not (b == 32 or 9 <= b <= 13))
#: Ratio of a size band's ends; sets of one size lie in two bands at most, as 1 / t is smaller.
BAND_RATIO = 1.5
#: What one expected weak subset (one shingle or none) costs, in signatures.
WEAK_COST = 30.0
#: Partners of one pivot that are verified in one run of rows; the pivot is repeated for each run.
PIVOT_CHUNK = 256
#: Members of a block on average, and shingles in it; columns of an incidence matrix that is held at once.
BLOCK, BLOCK_VOLUME, COLUMNS = 512, 1 << 19, 2048
#: Bits of a sketch for each shingle, at least (then the next power of two).
SKETCH_BITS = 1.5
#: Classes (four 64-bit values each) that may be broadcast to pick their texts; beyond it that join is shuffled.
BROADCAST_CLASSES = 400_000


@dataclass(frozen=True)
class Band:
    low: int
    high: int  #: exclusive
    segments: int
    spare: int  #: e of the plain way
    deletions: bool


def most_apart(a: int, b: int, percent: int) -> int:
    """Most shingles in which sets of sizes a and b may differ."""
    return (100 - percent) * (a + b) // (100 + percent)


@lru_cache(maxsize=8)
def bands(percent: int) -> tuple[Band, ...]:
    """Size bands up to 2^31 shingles, each with the cheaper of both ways."""
    out, low = [], 1
    while low < 1 << 31:
        high = max(low + 1, int(low * min(BAND_RATIO, 100 / percent * 1.25)))
        h = most_apart(high - 1, high - 1, percent)
        spare = 1
        for _ in range(20):
            k = h + 1 + spare
            p = np.exp(-low / k)
            spare = max(spare, int(np.ceil(k * p + 4 * np.sqrt(k * p))))
        plain = h + 1 + spare
        halves = h // 2 + 1

        def weak(segments: int) -> float:
            x = low / segments
            return segments * np.exp(-x) * (1 + x)

        cost_plain = plain + WEAK_COST * weak(plain)
        cost_deletions = high + halves + WEAK_COST * (weak(halves) if halves > 1 else 0)
        out.append(Band(low, high, *((halves, 0, True) if cost_deletions < cost_plain else (plain, spare, False))))
        low = high
    return tuple(out)


def shingle_sets(texts: list[str | None], words: int) -> list[np.ndarray]:
    """Each text's sorted distinct shingle hashes."""
    hashes, counts = hash_words(texts, WORDS)
    out, at = [], 0
    if len(hashes) >= words:
        rolled = np.zeros(len(hashes) - words + 1, np.uint64)
        for k in range(words):
            rolled = mix(rolled + hashes[k : k + len(rolled)])
    for n in counts.tolist():
        if n >= words:
            out.append(np.unique(rolled[at : at + n - words + 1]))
        elif n:
            x = np.full(1, n, np.uint64)
            for k in range(n):
                x = mix(x + hashes[at + k : at + k + 1])
            out.append(x)
        else:
            out.append(hashes[:0])
        at += n
    return out


def signatures(shingles: np.ndarray, percent: int, seed: int = 0) -> np.ndarray:
    """Signatures of one set in the band of its size and in the next, where it may have larger partners."""
    n, plan, out = len(shingles), bands(percent), []
    if not n or most_apart(n, n * 100 // percent, percent) == 0:
        return shingles[:0]  # its partners are equal sets
    spread = mix(shingles + np.uint64(seed)) if seed else shingles
    if seed:
        spread = np.sort(spread)
    value = mix(spread ^ np.uint64(0xA0761D6478BD642F))
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(value, dtype=np.uint64)])
    largest = n * 100 // percent
    k0 = next(k for k, b in enumerate(plan) if n < b.high)
    for k in range(k0, len(plan)):
        band = plan[k]
        if k > k0 and band.low > largest:
            break
        h = most_apart(n, min(largest, band.high - 1), percent)
        use = min(band.segments, h // 2 + 1 if band.deletions else h + 1 + band.spare)
        width = (1 << 64) // band.segments
        edges = np.array([i * width for i in range(use + 1)] if use < band.segments else [*(i * width for i in range(use)), (1 << 64) - 1], np.uint64)
        at = np.searchsorted(spread, edges)
        if use == band.segments:
            at[-1] = n
        size = np.diff(at)
        sums = total[at[1:]] - total[at[:-1]]
        tag = np.arange(use, dtype=np.uint64) + np.uint64((k + 1) << 32)
        if band.deletions:
            seg = np.repeat(np.arange(use), size)
            lack = sums[seg] - value[at[0] : at[-1]]
            out += [mix(sums + mix(tag)), mix(lack + mix(tag[seg]))]
        else:
            full = size > 0
            if (~full).sum() > band.spare:
                full[:] = True
            out.append(mix(sums[full] + mix(tag[full])))
    return np.unique(np.concatenate(out))


def sketch(shingles: np.ndarray) -> np.ndarray:
    """A set's bit map, 64 bits to a value: each shingle flips one bit of a power of two."""
    bits = 64
    while bits < SKETCH_BITS * len(shingles):
        bits *= 2
    at = mix(shingles ^ np.uint64(0xE7037ED1A0B428DB)) & np.uint64(bits - 1)
    return np.packbits(np.bincount(at.astype(np.int64), minlength=bits).astype(np.uint8) & 1, bitorder="little").view(np.int64)


def sketches_differ(x: Column, y: Column) -> Column:
    """Bits in which two sketches differ; a larger one is folded to the other's size first."""
    n = F.least(F.size(x), F.size(y))
    fold = lambda c: F.when(F.size(c) > n, F.zip_with(F.slice(c, F.lit(1), n), F.slice(c, n + 1, n), lambda p, q: p.bitwiseXOR(q))).otherwise(c)
    return F.aggregate(F.zip_with(fold(x), fold(y), lambda p, q: F.bit_count(p.bitwiseXOR(q))), F.lit(0), lambda a, b: a + b)


def row_key(id_col: str, text_col: str) -> list[Column]:
    """What names a row's content: id, text hash and bytes of the text."""
    text = F.col(text_col).cast("string")
    return [F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("text_hash"), F.coalesce(F.octet_length(text), F.lit(-1)).cast("long").alias("n_bytes")]


KEY = ("doc_id", "text_hash", "n_bytes")


def sign(docs: DataFrame, words: int, percent: int, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, text_hash, n_bytes, n_shingles, c1, c2, sigs, sketch, rid): c1 and c2 name the set; sigs and sketch are null where this task has given that set's already."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, int]] = set()
        rid = TaskContext.get().partitionId() << 36  # stays with the row, as the result is written
        for batch in batches:
            for a, b, texts in text_slices(batch.column(3), 1 << 19):
                n, c1, c2, sigs, maps = [], [], [], [], []
                rids = pa.array(range(rid, rid + b - a), pa.int64())
                rid += b - a
                for s in shingle_sets(texts, words):
                    n.append(len(s))
                    with np.errstate(over="ignore"):
                        key = (int(mix(s).sum(dtype=np.uint64)), int(mix(s ^ np.uint64(0x8EBC6AF09C88C6E3)).sum(dtype=np.uint64)))
                    c1.append(key[0])
                    c2.append(key[1])
                    old = key in seen or not len(s)
                    sigs.append(None if old else signatures(s, percent).view(np.int64))
                    maps.append(None if old else sketch(s))
                    seen.add(key)
                made = [pa.array(n, pa.int64()), pa.array(np.array(c1, np.uint64).view(np.int64)), pa.array(np.array(c2, np.uint64).view(np.int64)), pa.array(sigs, pa.list_(pa.int64())), pa.array(maps, pa.list_(pa.int64())), rids]
                yield pa.RecordBatch.from_arrays([*(batch.column(i).slice(a, b - a) for i in range(3)), *made], names=[*KEY, "n_shingles", "c1", "c2", "sigs", "sketch", "rid"])

    picked = docs.select(*row_key(id_col, text_col), F.col(text_col).cast("string").alias("text"))
    return picked.mapInArrow(tidied(run), "doc_id long, text_hash long, n_bytes long, n_shingles long, c1 long, c2 long, sigs array<long>, sketch array<long>, rid long")


def packed(texts: DataFrame) -> DataFrame:
    """(cls, text) with the text as compressed UTF-8, as it will be shuffled more than once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, some in text_slices(batch.column(1), 1 << 20):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array([zlib.compress(t.encode(), 3) for t in some], pa.binary())], names=["cls", "text"])

    return texts.mapInArrow(tidied(run), "cls long, text binary")


def packed_sets(texts: list[bytes], words: int) -> list[np.ndarray]:
    return shingle_sets([zlib.decompress(t).decode() for t in texts], words)


def verify(pairs: DataFrame, texts: DataFrame, words: int) -> DataFrame:
    """(a, b, shared, either) for each pair of classes: sizes of intersection and union, from whole texts (class, text)."""
    many = pairs.groupBy("a").count().withColumn("runs", F.ceil(F.col("count") / PIVOT_CHUNK))
    dealt = pairs.join(many, "a").select("a", "b", F.expr("pmod(hash(b), runs)").alias("run"))
    partner = dealt.join(texts.withColumnRenamed("cls", "b"), "b").select("a", "run", F.lit(1).alias("kind"), "b", "text")
    pivot = dealt.select("a", "run").distinct().join(texts.withColumnRenamed("cls", "a"), "a").select("a", "run", F.lit(0).alias("kind"), F.col("a").alias("b"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine, own = None, np.zeros(0, np.uint64)
        for batch in batches:
            a, kind, b, texts_ = (batch.column(i).to_pylist() for i in (0, 2, 3, 4))
            runs = batch.column(1).to_pylist()
            for lo, hi in slices([len(t) for t in texts_], 1 << 18):
                rows = []
                for i, s in zip(range(lo, hi), packed_sets(texts_[lo:hi], words)):
                    if kind[i] == 0:
                        mine, own = (a[i], runs[i]), s
                    elif mine == (a[i], runs[i]):
                        both = len(np.intersect1d(own, s, assume_unique=True))
                        rows.append((a[i], b[i], both, len(own) + len(s) - both))
                cols = list(zip(*rows)) if rows else [(), (), (), ()]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["a", "b", "shared", "either"])

    together = partner.unionByName(pivot).repartition("a", "run").sortWithinPartitions("a", "run", "kind")
    return together.mapInArrow(tidied(run), "a long, b long, shared long, either long")


def links_across(left: list[np.ndarray], right: list[np.ndarray], percent: int) -> np.ndarray:
    """Which sets of one block link to which of the other: intersections by products of incidence matrices."""
    n_left, n_right = (np.array([len(x) for x in side], np.int64) for side in (left, right))
    flat_l, flat_r = np.concatenate(left), np.concatenate(right)
    common = np.intersect1d(flat_l, flat_r)
    shared = np.zeros((len(left), len(right)), np.float32)  # exact below 2^24 shingles a set

    def places(flat: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.minimum(np.searchsorted(common, flat), max(0, len(common) - 1))
        known = common[at] == flat if len(common) else np.zeros(len(flat), bool)
        return np.repeat(np.arange(len(n)), n)[known], at[known]

    (row_l, col_l), (row_r, col_r) = places(flat_l, n_left), places(flat_r, n_right)
    for k in range(0, len(common), COLUMNS):
        parts = []
        for row, col, n in ((row_l, col_l, len(left)), (row_r, col_r, len(right))):
            mine = (col >= k) & (col < k + COLUMNS)
            m = np.zeros((n, min(COLUMNS, len(common) - k)), np.float32)
            m[row[mine], col[mine] - k] = 1
            parts.append(m)
        shared += parts[0] @ parts[1].T
    both = shared.astype(np.int64)
    return 100 * both >= percent * (n_left[:, None] + n_right[None, :] - both)


def close_by_sketch(left: list[tuple[int, np.ndarray]], right: list[tuple[int, np.ndarray]], percent: int) -> np.ndarray:
    """Which sets (size, sketch) of one block may link to which of the other: no linked pair is left out."""
    n_left, n_right = (np.array([n for n, _ in side], np.int64) for side in (left, right))
    out = np.zeros((len(left), len(right)), bool)
    width = [np.array([len(k) for _, k in side], np.int64) for side in (left, right)]

    def rows(side: list[tuple[int, np.ndarray]], at: np.ndarray, w: int) -> np.ndarray:
        m = np.stack([side[i][1] for i in at.tolist()]).view(np.uint64)
        return m if m.shape[1] == w else m[:, :w] ^ m[:, w:]

    def signs(m: np.ndarray) -> np.ndarray:
        return 1 - 2 * np.unpackbits(m.view(np.uint8), axis=1).astype(np.float32)

    for wl in np.unique(width[0]).tolist():
        for wr in {wl // 2, wl, wl * 2} & set(width[1].tolist()):
            i, j, w = np.flatnonzero(width[0] == wl), np.flatnonzero(width[1] == wr), min(wl, wr)
            x, y = rows(left, i, w), rows(right, j, w)
            equal = np.zeros((len(i), len(j)), np.float32)
            for k in range(0, w, COLUMNS // 64):
                equal += signs(np.ascontiguousarray(x[:, k : k + COLUMNS // 64])) @ signs(np.ascontiguousarray(y[:, k : k + COLUMNS // 64])).T
            a, b = n_left[i][:, None], n_right[j][None, :]
            apart = (64 * w - equal) / 2
            out[np.ix_(i, j)] = (apart <= (100 - percent) * (a + b) // (100 + percent)) & (100 * np.minimum(a, b) >= percent * np.maximum(a, b))
    return out


def open_members(members: DataFrame, sketches: DataFrame, percent: int, scratch: Scratch) -> DataFrame:
    """(b1, b2, side, cls, label): members of open pivots that may link to one of another component, by pairs of blocks.

    ``members`` is (pivot_cls, size, cls, n, label).  Every member has a home, its largest
    pivot, and lies in one block of that home (large homes are cut by set size first); blocks
    that meet at some pivot, and whose sets may be alike in size, are compared as a whole.  A
    block's sketches are one row, so a group of g members that share signatures without being
    linked gives (g / BLOCK)^2 rows at most, each of two blocks, and none for members or pairs.
    """
    homes = members.groupBy("cls").agg(F.max(F.struct("size", "pivot_cls")).alias("h"), F.first("label").alias("label"), F.first("n").alias("n")).select("cls", "label", "n", F.col("h.pivot_cls").alias("home"))
    homes = scratch.table(homes, "jaccard-homes")
    # a home that few chose is what a larger one has left of its pivot: it joins that one
    taken = scratch.table(homes.groupBy("home").agg(F.count("*").alias("chosen")), "jaccard-taken")
    larger = members.select("pivot_cls", "cls").join(homes.join(taken, "home").select("cls", "home", "chosen"), "cls").groupBy(F.col("pivot_cls").alias("home")).agg(F.max(F.struct("chosen", "home")).alias("l"))
    larger = scratch.table(larger, "jaccard-larger")
    moved = homes.join(taken, "home").join(larger, "home").withColumn("home", F.when(F.col("chosen") < BLOCK / 2, F.col("l.home")).otherwise(F.col("home"))).select("cls", "label", "n", "home")
    moved = scratch.table(moved, "jaccard-moved")
    large = moved.groupBy("home").count().filter(F.col("count") > BLOCK).select("home", F.lit(True).alias("large"))
    step = F.floor(F.log("n") / F.log(F.lit(100 / percent)))  # sets that are not of neighbouring steps are never linked
    cut = moved.join(large, "home", "left").withColumn("step", F.when(F.col("large"), step).otherwise(-1)).drop("large")
    parts = cut.groupBy("home", "step").agg(F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum("n") / BLOCK_VOLUME)).alias("parts"))
    blocked = cut.join(parts, ["home", "step"]).select("cls", "label", "n", F.xxhash64("home", "step", F.pmod(F.hash("cls"), "parts")).alias("block"))
    blocked = scratch.table(blocked, "jaccard-blocks")
    row = F.collect_list(F.struct("cls", "label", "n", "sketch"))  # a block's members: BLOCK on average, BLOCK_VOLUME shingles
    packed_blocks = scratch.table(blocked.join(sketches, "cls").groupBy("block").agg(row.alias("rows"), F.min("n").alias("least"), F.max("n").alias("most")), "jaccard-packed")
    where = members.select("pivot_cls", "cls").join(blocked, "cls").groupBy("pivot_cls", "block").agg(F.min("label").alias("lo"), F.max("label").alias("hi"))
    where = scratch.table(where.join(packed_blocks.select("block", "least", "most"), "block"), "jaccard-where")
    x, y = where.alias("x"), where.alias("y")
    alike = f"100 * x.most >= {percent} * y.least AND 100 * y.most >= {percent} * x.least"
    meet = x.join(y, F.expr(f"x.pivot_cls = y.pivot_cls AND x.block <= y.block AND {alike} AND NOT (x.lo = y.hi AND x.hi = y.lo AND x.lo = x.hi)")).select(F.col("x.block").alias("b1"), F.col("y.block").alias("b2")).distinct()
    side = lambda k, name: packed_blocks.select(F.col("block").alias(f"b{k}"), F.col("rows").alias(name))
    together = meet.join(side(1, "left"), "b1").join(side(2, "right"), "b2").select("b1", "b2", "left", "right")

    def sets(block: pa.Array) -> tuple[np.ndarray, np.ndarray, list[tuple[int, np.ndarray]]]:
        """(classes, labels, (size, sketch) of each) of a block's members."""
        cls, label, n = (block.field(c).to_numpy() for c in ("cls", "label", "n"))
        maps = block.field("sketch")
        values, at = maps.flatten().to_numpy(), np.cumsum([0, *pc.list_value_length(maps).to_pylist()])
        return cls, label, [(k, values[a:b]) for k, a, b in zip(n.tolist(), at, at[1:])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                b1, b2 = batch.column(0)[k].as_py(), batch.column(1)[k].as_py()
                left = sets(batch.column(2)[k].values)
                right = left if b1 == b2 else sets(batch.column(3)[k].values)
                close = close_by_sketch(left[2], right[2], percent) & (left[1][:, None] != right[1][None, :])
                for side, (cls, label, _), any_ in ((0, left, close.any(1)), (1, right, close.any(0))):
                    at = np.flatnonzero(any_)
                    if len(at) and (side == 0 or b1 != b2):
                        same = [pa.array(np.full(len(at), v, np.int64)) for v in (b1, b2, side)]
                        yield pa.RecordBatch.from_arrays([*same, pa.array(cls[at], pa.int64()), pa.array(label[at], pa.int64())], names=["b1", "b2", "side", "cls", "label"])

    return together.mapInArrow(tidied(run), "b1 long, b2 long, side long, cls long, label long")


def verify_blocks(close: DataFrame, texts: DataFrame, words: int, percent: int) -> DataFrame:
    """(u, v): labels of components that links join; each pair of blocks passes on a spanning forest of the links that it finds."""
    together = close.join(texts, "cls").select("b1", "b2", "side", "cls", "label", "text")

    def links(left: list[tuple[int, bytes]], right: list[tuple[int, bytes]]) -> Iterator[tuple[int, int]]:
        """Labels that links between two lists of (label, text) join."""
        if not left or not right:
            return
        sets = [packed_sets([t for _, t in side], words) for side in ([left] if right is left else [left, right])]
        linked = links_across(sets[0], sets[-1], percent)
        linked &= np.array([g for g, _ in left])[:, None] != np.array([g for g, _ in right])[None, :]
        parent: dict[int, int] = {}

        def find(v: int) -> int:
            while parent.setdefault(v, v) != v:
                parent[v] = parent[parent[v]]
                v = parent[v]
            return v

        for i, j in zip(*(k.tolist() for k in np.nonzero(linked))):
            u, v = find(left[i][0]), find(right[j][0])
            if u != v:
                parent[u] = v
                yield left[i][0], right[j][0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple[list, list] = ([], [])
        now = None

        def done() -> pa.RecordBatch:
            rows = list(links(held[0], held[0] if now[0] == now[1] else held[1]))
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.int64()) for k in (0, 1)], names=["u", "v"])

        for batch in batches:
            for b1, b2, side, _, label, text in zip(*(col.to_pylist() for col in batch.columns)):
                if now is not None and now != (b1, b2):
                    yield done()
                    held = ([], [])
                now = (b1, b2)
                held[side].append((label, text))
        if now is not None:
            yield done()

    return together.repartition("b1", "b2").sortWithinPartitions("b1", "b2", "side").mapInArrow(tidied(run), "u long, v long")


def jaccard_classes(docs: DataFrame, words: int = 4, percent: int = 85, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text_hash, n_bytes, n_shingles, cls, component): one row for each row of ``docs``, as a table.

    ``cls`` is the same for equal sets, ``component`` for classes that links join; both are
    null for rows without a set.
    """
    scratch = Scratch(docs.sparkSession)
    out = scratch.table(_classes(docs, words, percent, id_col, text_col, scratch), "jaccard-result")
    scratch.drop(*(name for name in list(scratch.paths) if name != "jaccard-result"), shuffles=True)
    return out


def _texts(docs: DataFrame, wanted: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(cls, text) of the classes in ``wanted`` (cls and key): whole texts, compressed."""
    n = wanted.count()
    side = F.broadcast(wanted) if n <= BROADCAST_CLASSES else wanted  # then the texts of all others need not move
    source = docs.select(*row_key(id_col, text_col), F.col(text_col).cast("string").alias("text")).alias("d")
    same = F.expr(" AND ".join(f"d.{c} <=> w.{c}" for c in KEY))
    return packed(source.join(side.alias("w"), same).select("cls", "d.text"))


def _classes(docs: DataFrame, words: int, percent: int, id_col: str, text_col: str, scratch: Scratch) -> DataFrame:
    signed = scratch.table(sign(docs, words, percent, id_col, text_col), "jaccard-signed")
    sets = signed.filter("n_shingles > 0")
    # classes: their smallest row that has signatures names them
    named = sets.groupBy("c1", "c2").agg(F.min(F.when(F.col("sigs").isNotNull(), F.col("rid"))).alias("cls"), F.min("n_shingles").alias("n"))
    classes = scratch.table(named, "jaccard-classes")
    # minima are taken beside the data first, so that a frequent signature is no hot spot; the join with them can be split
    rows = sets.filter("sigs IS NOT NULL").select("rid", F.explode("sigs").alias("sig"))
    pivots = scratch.table(rows.groupBy("sig").agg(F.min("rid").alias("pivot"), F.max("rid").alias("last")).filter("pivot < last").select("sig", "pivot"), "jaccard-pivots")
    met = scratch.table(rows.join(pivots, "sig").filter("rid <> pivot").select("pivot", "rid").distinct(), "jaccard-met")
    slim = scratch.table(signed.drop("sigs", "sketch"), "jaccard-rows")
    # rows that were met, by class; sketches of classes that were met
    used = met.select("rid").union(met.select("pivot")).distinct()
    of = scratch.table(slim.filter("n_shingles > 0").select("rid", "c1", "c2").join(used, "rid").join(classes, ["c1", "c2"]).select("rid", "cls", "n"), "jaccard-of")
    sketches = scratch.table(sets.select(F.col("rid").alias("cls"), "sketch").join(of.select("cls").distinct(), "cls"), "jaccard-sketches")
    del signed, sets, rows, pivots
    scratch.drop("jaccard-signed", "jaccard-pivots", shuffles=True)
    as_a = of.select(F.col("rid").alias("pivot"), F.col("cls").alias("pivot_cls"), F.col("n").alias("pivot_n"))
    star = scratch.table(met.join(as_a, "pivot").join(of, "rid").filter("pivot_cls <> cls").select("pivot_cls", "pivot_n", "cls", "n").distinct(), "jaccard-star")
    near = f"100 * least(pivot_n, n) >= {percent} * greatest(pivot_n, n)"
    pairs = star.filter(near).select(F.least("pivot_cls", "cls").alias("a"), F.greatest("pivot_cls", "cls").alias("b"), (F.col("pivot_n") + F.col("n")).alias("both")).distinct()
    seen = pairs.join(sketches.select(F.col("cls").alias("a"), F.col("sketch").alias("x")), "a").join(sketches.select(F.col("cls").alias("b"), F.col("sketch").alias("y")), "b")
    apart = F.expr(f"{100 - percent} * both DIV {100 + percent}")
    pairs = scratch.table(seen.filter(sketches_differ(F.col("x"), F.col("y")) <= apart).select("a", "b"), "jaccard-pairs")
    del met, of, as_a
    scratch.drop("jaccard-met", "jaccard-of")

    def texts_of(some: DataFrame, name: str) -> DataFrame:
        wanted = scratch.table(some.distinct().join(slim.select(F.col("rid").alias("cls"), *KEY), "cls"), f"{name}-wanted")
        texts = scratch.table(_texts(docs, wanted, id_col, text_col), f"{name}-texts", "none")
        return texts.dropDuplicates(["cls"]) if texts.count() > wanted.count() else texts  # repeated rows: the texts are equal

    texts = texts_of(pairs.select(F.col("a").alias("cls")).union(pairs.select("b")), "jaccard")
    checked = scratch.table(verify(pairs, texts, words), "jaccard-checked")
    labels = components(checked.filter(f"100 * shared >= {percent} * either").select(F.col("a").alias("u"), F.col("b").alias("v")), scratch)
    del pairs, texts, checked
    scratch.drop("jaccard-pairs", "jaccard-texts", "jaccard-wanted", "jaccard-checked", shuffles=True)
    # members of one pivot's buckets have not met one another: where they are in different components, blocks of them do
    labelled = star.join(labels.select(F.col("node").alias("cls"), "label"), "cls", "left").withColumn("label", F.coalesce("label", "cls"))
    labelled = scratch.table(labelled.select("pivot_cls", "cls", "n", "label"), "jaccard-labelled")
    open_ = labelled.groupBy("pivot_cls").agg(F.count("*").alias("size"), F.min("label").alias("lo"), F.max("label").alias("hi")).filter("lo < hi")
    open_ = scratch.table(open_.drop("lo", "hi"), "jaccard-open-pivots")  # written, so that a pivot with very many members can be split
    members = scratch.table(labelled.join(open_, "pivot_cls"), "jaccard-open")
    if not members.isEmpty():
        close = scratch.table(open_members(members, sketches, percent, scratch), "jaccard-close")
        if not close.isEmpty():
            more = scratch.table(verify_blocks(close, texts_of(close.select("cls"), "jaccard-more"), words, percent), "jaccard-more")
            merged = components(more, scratch)  # of labels: far fewer than classes
            labels = labels.join(merged.select(F.col("node").alias("label"), F.col("label").alias("top")), "label", "left").select("node", F.coalesce("top", "label").alias("label"))
            alone = merged.join(labels.select("node"), "node", "left_anti")  # classes that no star had linked are labels of their own
            labels = scratch.table(labels.unionByName(alone), "jaccard-labels")
    out = slim.select(*KEY, "n_shingles", "c1", "c2").join(classes.select("c1", "c2", "cls"), ["c1", "c2"], "left")
    out = out.withColumn("cls", F.when(F.col("n_shingles") > 0, F.col("cls")))
    return out.join(labels.withColumnRenamed("node", "cls"), "cls", "left").select(*KEY, "n_shingles", "cls", F.coalesce("label", "cls").alias("component"))


def jaccard_components(docs: DataFrame, words: int = 4, percent: int = 85, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id): the smallest doc_id that links reach."""
    rows = jaccard_classes(docs, words, percent, id_col, text_col)
    # written, so that the join is one of two shuffles and a component with very many rows can be split
    least = table(rows.filter("component IS NOT NULL").groupBy("component").agg(F.min("doc_id").alias("least")), "jaccard-least", "lz4")
    return rows.join(least, "component", "left").select("doc_id", "n_shingles", F.coalesce("least", "doc_id").alias("component_id"), "text_hash")


def keep_one(docs: DataFrame, words: int = 4, percent: int = 85, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each component: that with the smallest id (then the smallest text hash).

    Rows without a set all stay.  Of repeated rows (equal id and text) that stay, one does.
    """
    scratch = Scratch(docs.sparkSession)
    rows = jaccard_classes(docs, words, percent, id_col, text_col).filter("component IS NOT NULL")
    best = F.min(F.struct(F.col("doc_id").isNull().alias("none"), *KEY))
    # written, so that the join is one of two shuffles and a component with very many rows can be split
    chosen = scratch.table(rows.groupBy("component").agg(best.alias("x")), "jaccard-chosen")
    each = scratch.table(rows.groupBy("component", *KEY).count(), "jaccard-each").join(chosen, "component")
    stays = F.expr(" AND ".join(f"{c} <=> x.{c}" for c in KEY))
    each = scratch.table(each.withColumn("stays", stays).filter("NOT stays OR count > 1").select(*KEY, "stays"), "jaccard-gone")
    scratch.drop("jaccard-chosen", "jaccard-each")
    names = [free_name(docs, f"row_{c}") for c in KEY]
    keyed = docs.select("*", *[c.alias(n) for c, n in zip(row_key(id_col, text_col), names)]).alias("d")
    same = F.expr(" AND ".join(f"d.`{n}` <=> g.{c}" for n, c in zip(names, KEY)))

    def keys(stays: str) -> tuple[DataFrame, int]:
        some = each.filter(stays).select(*KEY)
        n = some.count()
        return (F.broadcast(some) if n <= BROADCAST_CLASSES else some).alias("g"), n

    gone, n_gone = keys("NOT stays")
    repeated, n_repeated = keys("stays")
    out = keyed.join(gone, same, "left_anti") if n_gone else keyed
    if n_repeated:
        out = out.join(repeated, same, "left_anti").unionByName(out.join(repeated, same, "left_semi").dropDuplicates(names))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])
