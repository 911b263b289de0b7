"""Benchmark decontamination with suffix arrays of training shards.

Training texts are read in shards (slices of a task's rows).  A shard's suffix array
orders all its word positions by all the words that follow, up to their document's end
(prefix doubling; the ranks after every doubling are kept).  Every suffix of every
benchmark item is binary-searched in it: doubled blocks of its words are looked up in the
ranks, and blocks of falling size narrow an interval of the array, which ends as the
longest verbatim match with all its locations.  The first ``window`` words (or a shorter
item as a whole) have an interval of their own; equal windows have the same one, so
occurrences are marked once for each interval and never for pairs of occurrences and
windows.  A position's longest match with any item is that with one of its two neighbours
among the items' suffixes.

A document word inside any occurrence is *hit*; a document is contaminated when at
least one word in ``1 / share`` is hit.

Very long texts are cut into pieces of ``SHARD_WORDS`` words that overlap by the longest
item, so that every match lies in one piece as a whole.  The benchmark goes to the workers
in blocks of at most ``BLOCK_BYTES`` of text; further blocks are further passes that add to
what a row has.  Nulls: a null text has no words; a null item_id hits words but is not
listed.  Items without words are ignored; repeated items count once for each distinct id.
Repeated rows get the same result each.  An empty table gives an empty table, and without
a benchmark nothing is contaminated.  Other columns stay, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from draftmetrics.llm.rowmap import free_name, with_text_struct
from draftmetrics.llm.shared import table
from draftmetrics.llm.wordhash import hash_words, separators

#: Words are runs of a-z, 0-9 and bytes from 128, after A-Z are lower-cased.
WORDS = separators(lambda b: 48 <= b <= 57 or 97 <= b <= 122 or b >= 128)
WINDOW, SHARE = 13, 20
BLOCK_BYTES = 16 << 20
#: Bytes of training text that are read at once, and words of one suffix array (more where items are very long).
SHARD_BYTES, SHARD_WORDS = 1 << 19, 1 << 17
#: (document, item) pairs that are listed before repeated ones go.
PAIRS = 1 << 20


class SuffixArray:
    """Suffix array of documents given as word hashes; a document's end is smaller than any word."""

    def __init__(self, hashes: np.ndarray, counts: np.ndarray, longest: int):
        n_docs = len(counts)
        self.vocabulary, number = np.unique(hashes, return_inverse=True)
        self.first_word = n_docs  #: ends are numbered 0 .. n_docs - 1, words from here on
        self.doc = np.repeat(np.arange(n_docs, dtype=np.int32), counts + 1)
        self.place = np.arange(len(hashes)) + np.repeat(np.arange(n_docs), counts)  # of each word in ``text``
        self.text = np.empty(len(hashes) + n_docs, np.int32)
        self.text[self.place] = number + n_docs
        self.text[np.cumsum(counts + 1) - 1] = np.arange(n_docs)
        order = np.argsort(self.text, kind="stable").astype(np.int32)
        sizes = np.bincount(self.text, minlength=n_docs + len(self.vocabulary))
        self.starts = np.cumsum(sizes) - sizes  # of each word's suffixes in the array
        rank = self.starts[self.text].astype(np.int32)
        #: ranks[k]: where in the array the suffixes begin that share the first 2^k words
        self.ranks = [rank]
        open_, h = np.flatnonzero(np.repeat(sizes > 1, sizes)), 1
        while len(open_):
            at = order[open_]
            key = rank[at].astype(np.int64) * len(self.text) + rank[at + h]
            again = np.argsort(key, kind="stable")
            key, at = key[again], at[again]
            order[open_] = at
            new = np.concatenate([[True], key[1:] != key[:-1]])
            begin = np.flatnonzero(new)
            size = np.diff(np.append(begin, len(key)))
            rank = rank.copy()
            rank[at] = np.repeat(open_[begin], size)
            h *= 2
            if h <= longest:
                self.ranks.append(rank)
            open_ = open_[np.repeat(size > 1, size)]
        self.order = order
        while 1 << len(self.ranks) <= longest:
            self.ranks.append(self.ranks[-1])
        self._in_order = [r[order] for r in self.ranks]

    def end_of(self, k: int, begin: np.ndarray) -> np.ndarray:
        """Where the suffixes end that begin at ``begin`` and share 2^k words."""
        return np.searchsorted(self._in_order[k], begin, side="right")

    def first_at_least(self, values: np.ndarray, shift: np.ndarray, low: np.ndarray, high: np.ndarray, wanted: np.ndarray) -> np.ndarray:
        """Binary search between low and high: the first suffix whose value ``shift`` words on is at least ``wanted``."""
        low, high = low.copy(), high.copy()
        going = np.flatnonzero(low < high)
        while len(going):
            mid = (low[going] + high[going]) >> 1
            less = values[self.order[mid] + shift[going]] < wanted[going]
            low[going[less]] = mid[less] + 1
            high[going[~less]] = mid[~less]
            going = going[low[going] < high[going]]
        return low


class Benchmark:
    """All suffixes of a block of items, ready to be searched."""

    def __init__(self, items: list[tuple[str | None, str | None]], window: int = WINDOW):
        self.window = window
        hashes, counts = hash_words([t for _, t in items], WORDS)
        ends = np.cumsum(counts)
        owners: dict[bytes, set[str]] = defaultdict(set)
        for (item, _), end, n in zip(items, ends.tolist(), counts.tolist()):
            if n:
                owners[hashes[end - n : end].tobytes()] |= {str(item)} if item is not None else set()
        self.owners = [frozenset(x) for x in owners.values()]
        words = [np.frombuffer(k, np.uint64) for k in owners]
        sizes = np.array([len(w) for w in words], np.int64)
        self.hashes = np.concatenate(words) if words else np.zeros(0, np.uint64)
        self.longest = int(sizes.max()) if len(sizes) else 0
        self.item = np.repeat(np.arange(len(words)), sizes)
        #: words from each position to its item's end
        self.left = np.repeat(np.cumsum(sizes), sizes) - np.arange(len(self.hashes))
        whole = (self.left == np.repeat(sizes, sizes)) & (self.left < window)
        #: positions where a window starts, and its words
        self.windows = np.flatnonzero((self.left >= window) | whole)
        self.sizes = np.minimum(self.left[self.windows], window)
        self.vocabulary, self.number = np.unique(self.hashes, return_inverse=True)
        own = SuffixArray(self.hashes, sizes, 0)
        spot = np.zeros(len(own.text), np.int64)
        spot[own.place] = np.arange(len(self.hashes))
        self.sorted = spot[own.order[len(words) :]]  # all suffixes in order


class Search:
    """Every benchmark suffix searched in one suffix array."""

    def __init__(self, array: SuffixArray, bench: Benchmark):
        self.array, self.bench = array, bench
        known = np.searchsorted(array.vocabulary, bench.vocabulary)
        inside = array.vocabulary[np.minimum(known, len(array.vocabulary) - 1)] == bench.vocabulary
        #: number that a word has, or would come before, in the array's text
        self.before = (known + array.first_word)[bench.number]
        starts = np.where(inside, array.starts[np.minimum(known + array.first_word, len(array.starts) - 1)], -1)
        #: names[k]: rank of each suffix's first 2^k words, -1 where no document has them
        self.names = [starts[bench.number]]
        for k in range(len(array.ranks) - 1):
            h = 1 << k
            name = np.full(len(bench.hashes), -1, np.int64)
            at = np.flatnonzero(self.names[k] >= 0)
            at = at[bench.left[at] >= 2 * h]
            at = at[self.names[k][at + h] >= 0]
            if len(at):
                low, second = self.names[k][at], self.names[k][at + h]
                high, shift = array.end_of(k, low), np.full(len(at), h)
                found = array.first_at_least(array.ranks[k], shift, low, high, second)
                hit = found < high
                hit[hit] = array.ranks[k][array.order[found[hit]] + h] == second[hit]
                name[at[hit]] = found[hit]
            self.names.append(name)

    def narrow(self, at: np.ndarray, most: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(length, low, high): the longest match, of at most ``most`` words, of each suffix, and where it is in the array."""
        array = self.array
        length = np.zeros(len(at), np.int64)
        low, high = np.zeros(len(at), np.int64), np.full(len(at), len(array.order), np.int64)
        for k in range(len(self.names) - 1, -1, -1):
            going = np.flatnonzero(length + (1 << k) <= most)
            name = self.names[k][at[going] + length[going]]
            going, name = going[name >= 0], name[name >= 0]
            if not len(going):
                continue
            rank, shift = array.ranks[k], length[going]
            a = array.first_at_least(rank, shift, low[going], high[going], name)
            hit = a < high[going]
            hit[hit] = rank[array.order[a[hit]] + shift[hit]] == name[hit]
            going, name, a, shift = going[hit], name[hit], a[hit], shift[hit]
            b = array.first_at_least(rank, shift, a, high[going], name + 1)
            low[going], high[going] = a, b
            length[going] += 1 << k
        return length, low, high

    def longest_from(self, length: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """The longest match of every place of the text, given all suffixes' own longest matches."""
        array, bench = self.array, self.bench
        ended = length >= bench.left
        ahead = np.minimum(np.arange(len(length)) + length, len(length) - 1)
        where = np.where(ended, low, array.first_at_least(array.text, length, low, np.where(ended, low, high), self.before[ahead]))
        where = where[bench.sorted]
        after = np.searchsorted(where, np.arange(len(array.order)), side="right")
        best = np.zeros(len(array.order), np.int64)
        for side in (after - 1, after):
            rows = np.flatnonzero((side >= 0) & (side < len(where)))
            p, pos = bench.sorted[side[rows]], array.order[rows].astype(np.int64)
            same = array.ranks[0][pos] == self.names[0][p]
            rows, p, pos = rows[same], p[same], pos[same]
            shared = np.zeros(len(rows), np.int64)
            for k in range(len(self.names) - 1, -1, -1):
                going = np.flatnonzero(shared + (1 << k) <= bench.left[p])
                x, y = pos[going] + shared[going], p[going] + shared[going]
                going = going[array.ranks[k][x] == self.names[k][y]]
                shared[going] += 1 << k
            best[rows] = np.maximum(best[rows], shared)
        out = np.zeros(len(array.text), np.int64)
        out[array.order] = best
        return out

    def occurrences(self, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(which places of the text are hit, distinct (document, item) pairs), given the suffixes' longest matches."""
        array, bench = self.array, self.bench
        cover = np.zeros(len(array.text) + 1, np.int64)
        pairs = np.zeros((0, 2), np.int64)
        met = length[bench.windows] >= bench.sizes
        at, size = bench.windows[met], bench.sizes[met]
        _, low, high = self.narrow(at, size)
        for n in np.unique(size).tolist():
            mine = size == n
            begin, which = np.unique(low[mine], return_inverse=True)
            count = np.zeros(len(begin), np.int64)
            count[which] = (high - low)[mine]
            spot = np.repeat(np.arange(len(begin)), count)
            place = array.order[np.arange(len(spot)) - np.repeat(np.cumsum(count) - count, count) + np.repeat(begin, count)]
            np.add.at(cover, place, 1)
            np.add.at(cover, place + n, -1)
            docs = np.unique(np.stack([spot, array.doc[place]], 1), axis=0)  # of each interval
            items = np.unique(np.stack([which, bench.item[at[mine]]], 1), axis=0)
            first, n_items = np.searchsorted(items[:, 0], docs[:, 0]), np.bincount(items[:, 0], minlength=len(begin))[docs[:, 0]]
            a = 0
            while a < len(docs):
                b = max(a + 1, a + int(np.searchsorted(np.cumsum(n_items[a:]), PAIRS, side="right")))
                k = n_items[a:b]
                row = np.arange(k.sum()) - np.repeat(np.cumsum(k) - k, k) + np.repeat(first[a:b], k)
                pairs = np.unique(np.concatenate([pairs, np.stack([np.repeat(docs[a:b, 1], k), items[row, 1]], 1)]), axis=0)
                a = b
        return np.cumsum(cover[:-1]) > 0, pairs


def match(texts: list[str | None], bench: Benchmark) -> list[tuple[int, np.ndarray, set[str], int, list[tuple[int, int]]]]:
    """For each text: words, hit flags, item ids, longest match in words, and spans (first word, words)."""
    hashes, counts = hash_words(texts, WORDS)
    first = np.cumsum(counts) - counts
    flags, longest = np.zeros(len(hashes), bool), np.zeros(len(texts), np.int64)
    items: list[set[str]] = [set() for _ in texts]
    step = max(SHARD_WORDS, 2 * bench.longest)
    pieces = [(d, int(a) + k, min(step, int(n) - k)) for d, (a, n) in enumerate(zip(first, counts)) for k in range(0, max(1, int(n) - bench.longest + 1), max(1, step - bench.longest + 1)) if n] if bench.longest else []
    while pieces:
        now, total = [], 0
        while pieces and (not now or total + pieces[0][2] <= step):
            now.append(pieces.pop(0))
            total += now[-1][2]
        docs, size = np.array([d for d, _, _ in now]), np.array([n for _, _, n in now])
        spot = np.concatenate([np.arange(a, a + n) for _, a, n in now])
        array = SuffixArray(hashes[spot], size, bench.longest)
        search = Search(array, bench)
        length, low, high = search.narrow(np.arange(len(bench.hashes)), bench.left)
        hit, pairs = search.occurrences(length)
        flags[spot[hit[array.place]]] = True
        np.maximum.at(longest, docs[array.doc], search.longest_from(length, low, high))
        for d, i in pairs.tolist():
            items[docs[d]] |= bench.owners[i]
    out = []
    for d, (a, n) in enumerate(zip(first.tolist(), counts.tolist())):
        f = flags[a : a + n]
        edge = np.flatnonzero(np.diff(np.concatenate([[0], f.astype(np.int8), [0]])))
        out.append((n, f, items[d], int(longest[d]), list(zip(edge[::2].tolist(), (edge[1::2] - edge[::2]).tolist()))))
    return out


FIELDS = "n_words long, n_hit long, items array<string>, longest_match_words long, span_start array<long>, span_words array<long>"


def _pass(docs: DataFrame, bench: Benchmark, text_col: str, name: str) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(bench)  # made from BLOCK_BYTES of text at most

    def make():
        block = shared.value

        def work(texts: list[str | None]) -> list[list]:
            cols: list[list] = [[] for _ in range(6)]
            for n, flags, items, longest, spans in match(texts, block):
                for c, v in zip(cols, (n, int(flags.sum()), sorted(items), longest, [a for a, _ in spans], [k for _, k in spans])):
                    c.append(v)
            return cols

        return work

    return with_text_struct(docs, text_col, name, FIELDS, make, SHARD_BYTES)


def find_contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, share: int = SHARE, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", name: str | None = None) -> DataFrame:
    """``docs`` with a struct column: n_words, n_hit, items, longest match, hit spans, contaminated."""
    name = name or free_name(docs, "contamination")
    items = benchmark.select(F.col(item_col).cast("string").alias("i"), F.col(item_text_col).cast("string").alias("t")).filter("t IS NOT NULL")
    n_bytes = items.agg(F.coalesce(F.sum(F.octet_length("t")), F.lit(0))).first()[0]
    n_blocks = max(1, -(-n_bytes // BLOCK_BYTES))
    out = docs
    for k in range(n_blocks):
        rows = items if n_blocks == 1 else items.filter(F.pmod(F.xxhash64("t"), F.lit(n_blocks)) == k)
        bench = Benchmark([(r["i"], r["t"]) for r in rows.toLocalIterator()], window)
        made = name if k == 0 else free_name(out, "more")
        out = _pass(out, bench, text_col, made)
        if k:
            out = _merged(out, name, made)
        if n_blocks > 1:
            out = table(out, "contamination")
    return out.withColumn(name, F.col(name).withField("contaminated", (F.col(f"`{name}`.n_hit") > 0) & (share * F.col(f"`{name}`.n_hit") >= F.col(f"`{name}`.n_words"))))


def _merged(df: DataFrame, name: str, more: str) -> DataFrame:
    """Spans and items of two passes as one."""
    a, b = F.col(name), F.col(more)
    pairs = F.array_sort(F.concat(F.arrays_zip(a["span_start"].alias("s"), a["span_words"].alias("n")), F.arrays_zip(b["span_start"].alias("s"), b["span_words"].alias("n"))))
    zero = F.from_json(F.lit('{"done": [], "s": -1, "e": -1}'), "done array<struct<s:bigint,n:bigint>>, s bigint, e bigint")

    def step(acc, x):
        s, e = x["s"], x["s"] + x["n"]
        joined = F.struct(acc["done"].alias("done"), acc["s"].alias("s"), F.greatest(acc["e"], e).alias("e"))
        new = F.struct(F.when(acc["s"] < 0, acc["done"]).otherwise(F.array_append(acc["done"], F.struct(acc["s"].alias("s"), (acc["e"] - acc["s"]).alias("n")))).alias("done"), s.alias("s"), e.alias("e"))
        return F.when((acc["s"] >= 0) & (s <= acc["e"]), joined).otherwise(new)

    spans = F.aggregate(pairs, zero, step, lambda acc: F.when(acc["s"] < 0, acc["done"]).otherwise(F.array_append(acc["done"], F.struct(acc["s"].alias("s"), (acc["e"] - acc["s"]).alias("n")))))
    out = df.withColumn(more, F.struct(spans.alias("spans"), b["items"].alias("items"), b["longest_match_words"].alias("longest")))
    m = F.col(more)
    merged = F.struct(a["n_words"].alias("n_words"), F.aggregate(m["spans"], F.lit(0).cast("long"), lambda acc, x: acc + x["n"]).alias("n_hit"), F.array_sort(F.array_union(a["items"], m["items"])).alias("items"), F.greatest(a["longest_match_words"], m["longest"]).alias("longest_match_words"), F.transform(m["spans"], lambda x: x["s"]).alias("span_start"), F.transform(m["spans"], lambda x: x["n"]).alias("span_words"))
    return out.withColumn(name, merged).drop(more)


def items_digest(items: list[str]) -> str:
    """The digest that the query gives: item ids sorted as strings, comma-joined, SHA-256."""
    return hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()
