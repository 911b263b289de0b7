"""Token counts of whole texts from counts of distinct pre-tokens; no ids are made.

A byte-pair merge never crosses a pre-token, so a text has as many tokens as its pre-tokens
have together.  Documents become frequency rows: one row for each block of about
``BLOCK_BYTES`` of text, with the block's distinct pre-tokens and, for each document, which
of them it has and how often.  The blocks' pre-tokens are dealt by name, so all rows of one
meet in a task and the file's model counts it once; the counts go back to their blocks as
one array each, are joined to the frequencies and summed over each document's.

A frequent pre-token is one row in each block at most, so no key is hot: its share of the
joined rows is at most one over a block's distinct pre-tokens.

Texts are cut at single blanks and line breaks between two other characters, where a
pre-token always begins.  Latin words with marks after them are one or two pre-tokens; any
other distinct piece goes through the library's own pre-tokenizer; texts with other white space or with added tokens such as <|endoftext|> are
cut by that pre-tokenizer as a whole (long ones in stretches that end at such blanks).  An
added token counts as one.  Files with a normaliser or another pre-tokenizer than the known
byte-level one are counted by the whole tokenizer.

Handling: a null text counts as an empty one (no bytes, no tokens); a null doc_id stays null;
repeated rows are counted each for itself; a very long text is a block of its own; an empty
table gives an empty table.  Other columns are not read, whatever their names.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from draftmetrics.llm.shared import table, text_slices, tidied
from draftmetrics.llm.tokens import BYTE_LETTERS, KNOWN, LATIN_END, MARKS, set_up

#: Bytes of text in one block (a longer text is a block of its own).
BLOCK_BYTES = 24 << 20
#: Distinct pieces that a worker holds; beyond them it begins anew.
CACHE_PIECES = 400_000
#: Characters that the library's pre-tokenizer gets at once.
STRETCH = 1 << 20

_BREAK = re.compile(r"(?<=\S)(?=[ \n]\S)")
_FREQUENCIES = "block long, words array<string>, doc_ids array<long>, n_bytes array<long>, known array<long>, n_words array<long>, word binary, freq binary"


class PreTokens:
    """Numbers of pre-tokens of texts; ``names`` are the pre-tokens in the byte-level alphabet."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self._tok = Tokenizer.from_file(path)
        added = self._tok.get_added_tokens_decoder().values()
        plain = not any(t.normalized or t.single_word or t.lstrip or t.rstrip for t in added)
        self.countable = set_up(self._tok) == KNOWN[0] and plain
        contents = sorted((t.content for t in added), key=lambda s: (-len(s), s))  # the longest of those that begin at one place
        self._added = re.compile("|".join(map(re.escape, contents)) or r"(?!)")
        self._split = self._tok.pre_tokenizer
        self.clear()

    def clear(self) -> None:
        self.names: list[str] = []
        self._number: dict[str, int] = {}
        self._piece: dict[str, int] = {}
        self._start, self._flat, self._used = np.zeros(1 << 16, np.int64), np.zeros(1 << 17, np.int32), 0

    def full(self) -> bool:
        return len(self._piece) > CACHE_PIECES

    def whole(self, text: str) -> int:
        return len(self._tok.encode_batch_fast([text], add_special_tokens=False)[0].ids)

    def _numbers(self, names: list[str]) -> list[int]:
        out = []
        for x in names:
            n = self._number.get(x)
            if n is None:
                n = self._number[x] = len(self.names)
                self.names.append(x)
            out.append(n)
        return out

    def _cut(self, text: str) -> list[str]:
        return [x for x, _ in self._split.pre_tokenize_str(text)]

    def _plain(self, pieces: list[str]) -> dict[str, list[int]]:
        """Pre-tokens of Latin letters with a run of marks after them: one or two, told without the library."""
        out: dict[str, list[int]] = {}
        number, names = self._number, self.names
        for p in pieces:
            core = p.rstrip(MARKS)
            if not core.isalpha():
                continue
            if core.isascii():
                word = "Ġ" + core
            elif max(core) < LATIN_END:
                word = "Ġ" + core.encode().decode("latin-1").translate(BYTE_LETTERS)
            else:
                continue
            n = number.get(word)
            if n is None:
                n = number[word] = len(names)
                names.append(word)
            out[p] = [n] if len(core) == len(p) else [n, *self._numbers([p[len(core) :]])]
        return out

    def _learn(self, pieces: list[str]) -> None:
        """Pre-tokens of new pieces: "\\n" and "\\r" (the text's start) stand before a piece without a blank."""
        plain = self._plain(pieces)
        inner = [p for p in pieces if p not in plain and p[:1] not in ("\n", "\r")]
        found = {p: ["Ċ", *self._cut(p[1:])] if p[0] == "\n" else self._cut(p[1:]) for p in pieces if p[:1] in ("\n", "\r")}
        for k in range(0, len(inner), 20_000):
            some = inner[k : k + 20_000]
            cuts = self._cut("\n".join([f" {p}" for p in some]))
            at = [i for i, x in enumerate(cuts) if x == "Ċ"]
            if len(at) == len(some) - 1:
                found.update((p, cuts[i + 1 : j]) for p, i, j in zip(some, [-1, *at], [*at, len(cuts)]))
            else:
                found.update((p, self._cut(f" {p}")) for p in some)
        each = [plain[p] if p in plain else self._numbers(found[p]) for p in pieces]
        n, lens = len(self._piece), np.fromiter(map(len, each), np.int64, len(each))
        ends = self._used + np.cumsum(lens)
        while n + len(each) >= len(self._start):
            self._start = np.concatenate([self._start, np.zeros_like(self._start)])
        while ends[-1] > len(self._flat):
            self._flat = np.concatenate([self._flat, np.zeros_like(self._flat)])
        self._flat[self._used : ends[-1]] = np.fromiter((x for e in each for x in e), np.int32, int(lens.sum()))
        self._start[n + 1 : n + 1 + len(each)] = ends
        self._used = int(ends[-1])
        self._piece.update((p, n + k) for k, p in enumerate(pieces))

    def _stretches(self, text: str) -> Iterator[str]:
        at = 0
        while len(text) - at > STRETCH:
            m = _BREAK.search(text, at + STRETCH)
            if not m:
                break
            yield text[at : m.start()]
            at = m.start()
        yield text[at:]

    def of(self, texts: list[str]) -> tuple[list[np.ndarray], list[int]]:
        """For each text the numbers of its pre-tokens in order, and the tokens that are none of them."""
        out: list[np.ndarray | None] = [None] * len(texts)
        known = [0] * len(texts)
        plan: list[tuple[int, int]] = []
        words: list[str] = []
        for i, text in enumerate(texts):
            if not self.countable:
                known[i], out[i] = self.whole(text) if text else 0, np.zeros(0, np.int32)
            elif self._added.search(text) or " ".join(text.split()) != text.replace("\n", " "):
                known[i] = len(self._added.findall(text))
                cuts = [self._numbers(self._cut(s)) for part in self._added.split(text) if part for s in self._stretches(part)]
                out[i] = np.fromiter((n for c in cuts for n in c), np.int32)
            elif text:
                mine = ("\r" + text.replace("\n", " \n")).split(" ")
                words += mine
                plan.append((i, len(mine)))
            else:
                out[i] = np.zeros(0, np.int32)
        if words:
            new = [p for p in dict.fromkeys(words) if p not in self._piece]
            if new:
                self._learn(new)
            at = np.fromiter(map(self._piece.__getitem__, words), np.int64, len(words))
            start, flat = self._start, self._flat
            lens = start[at + 1] - start[at]
            ends = np.cumsum(lens)
            numbers = flat[np.arange(ends[-1]) + np.repeat(start[at] - (ends - lens), lens)]
            k = a = 0
            for i, n in plan:
                k += n
                b = int(ends[k - 1])
                out[i], a = numbers[a:b], b
        return out, known  # type: ignore[return-value]


_pre_tokens: dict[str, PreTokens] = {}


def pre_tokens(path: str) -> PreTokens:
    """One for each worker process and file."""
    if path not in _pre_tokens:
        _pre_tokens[path] = PreTokens(path)
    return _pre_tokens[path]


def _planes(x: np.ndarray) -> bytes:
    """Unsigned 32-bit numbers, all their lowest bytes first; small numbers compress well so."""
    return zlib.compress(np.ascontiguousarray(x.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes(), 1)


def _from_planes(raw: bytes) -> np.ndarray:
    flat = np.frombuffer(zlib.decompress(raw), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(flat.T).view("<u4").reshape(-1).astype(np.int64)


def frequencies(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row for each block of documents: its distinct pre-tokens and each document's frequencies of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cutter = pre_tokens(path)
        block = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 32
        ids: list[int | None] = []
        sizes: list[int] = []
        known: list[int] = []
        each: list[np.ndarray] = []
        held = 0

        def flush() -> pa.RecordBatch:
            nonlocal block, ids, sizes, known, each, held
            n_docs, lens = len(each), [len(x) for x in each]
            used, local = np.unique(np.concatenate(each), return_inverse=True)
            each, width = [], max(len(used), 1)
            pair = np.repeat(np.arange(n_docs), lens)  # (document, pre-token) as one number, in place: a block's arrays are the worker's largest
            pair *= width
            pair += local
            del local
            pair, freq = np.unique(pair, return_counts=True)
            doc, word = np.divmod(pair, width)
            first = np.concatenate([[True], doc[1:] != doc[:-1]]) if len(doc) else np.zeros(0, bool)
            step = np.where(first, word, np.diff(word, prepend=0))  # within a document numbers ascend
            kinds = [pa.int64(), pa.list_(pa.string()), *[pa.list_(pa.int64())] * 4, pa.binary(), pa.binary()]
            row = [block, [cutter.names[k] for k in used], ids, sizes, known, np.bincount(doc, minlength=n_docs), _planes(step), _planes(freq)]
            block, ids, sizes, known, each, held = block + 1, [], [], [], [], 0
            if cutter.full():
                cutter.clear()
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds)], names=[x.split()[0] for x in _FREQUENCIES.split(", ")])

        for batch in batches:
            size = pc.fill_null(pc.binary_length(batch.column(1)), 0)
            for a, b, texts in text_slices(batch.column(1), 1 << 20):
                more = size.slice(a, b - a).to_pylist()
                if each and held + sum(more) > block_bytes:
                    yield flush()
                numbers, extra = cutter.of([t or "" for t in texts])
                ids += batch.column(0).slice(a, b - a).to_pylist()
                sizes, known, each, held = sizes + more, known + extra, each + numbers, held + sum(more)
        if each:
            yield flush()

    picked = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return picked.mapInArrow(tidied(run), _FREQUENCIES)


def count_words(words: DataFrame, path: str) -> DataFrame:
    """(block, at, n) of (block, at, word): equal pre-tokens meet in one task, side by side, and the model counts each once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = pre_tokens(path)._tok.model
        last, n_last = None, 0
        for batch in batches:
            coded = batch.column(2).dictionary_encode()
            names = coded.dictionary.to_pylist()
            n = [n_last if w == last else len(model.tokenize(w)) for w in names]
            if names:
                last, n_last = names[-1], n[-1]
            counts = np.asarray(n, np.int32)[coded.indices.to_numpy()] if names else np.zeros(0, np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(counts, pa.int32())], names=["block", "at", "n"])

    met = words.select("block", "at", "word").repartition("word").sortWithinPartitions("word")
    return met.mapInArrow(tidied(run), "block long, at int, n int")


def count_tokens(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(doc_id, n_bytes, n_tokens) of every document."""
    blocks = table(frequencies(docs, path, id_col, text_col, block_bytes), "pre-token-frequencies")
    words = blocks.select("block", F.posexplode("words").alias("at", "word"))
    found = count_words(words, path).groupBy("block").agg(F.collect_list(F.expr("shiftleft(CAST(at AS BIGINT), 32) + n")).alias("found"))  # a block's distinct pre-tokens

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [batch.column(batch.schema.get_field_index(c)) for c in ("doc_ids", "n_bytes", "known", "n_words", "word", "freq", "found")]
            for doc_ids, n_bytes, known, n_words, word, freq, of_block in zip(*columns):
                per_doc = np.array(n_words.as_py(), np.int64)
                step, times = _from_planes(word.as_py()), _from_planes(freq.as_py())
                ends = np.cumsum(per_doc)
                run_sum = np.cumsum(step)
                before = np.concatenate([[0], run_sum])[ends - per_doc]  # steps of the documents before
                at = run_sum - np.repeat(before, per_doc)
                n = np.zeros(0, np.int64)
                if of_block.is_valid:
                    pairs = of_block.values.to_numpy()
                    n = np.zeros(len(pairs), np.int64)
                    n[pairs >> 32] = pairs & 0xFFFFFFFF
                total = np.concatenate([[0], np.cumsum(n[at] * times)])
                tokens = total[ends] - total[ends - per_doc] + np.array(known.as_py(), np.int64)
                yield pa.RecordBatch.from_arrays([doc_ids.values, n_bytes.values, pa.array(tokens, pa.int64())], names=["doc_id", "n_bytes", "n_tokens"])

    joined = blocks.drop("words").join(found, "block", "left").drop("block")
    return joined.mapInArrow(tidied(run), "doc_id long, n_bytes long, n_tokens long")
