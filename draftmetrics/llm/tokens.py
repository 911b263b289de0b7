"""Token ids of whole texts by the ``tokenizers`` library, with a bounded cache of words.

A byte-pair merge never crosses a pre-token, and in files with one of the two known
set-ups (``KNOWN``) a pre-token boundary lies before every single space or line break that stands between two
non-blank characters.  So a text is cut there, each distinct piece is encoded by the
library once per worker and cache, and ids are gathered from the cache.  Latin words
with marks after them go straight to the file's byte-pair model (they are one or two
pre-tokens, which need no splitter); any other piece goes through the whole tokenizer.  Texts with other white
space (runs, tabs, leading or trailing blanks) go to the library whole wherever blanks
are themselves tokens, and so do texts that hold an added token such as <|endoftext|>.
With a file of any other set-up every text goes to the library whole.
"""

from __future__ import annotations

import itertools
import json
import os

import numpy as np

#: Distinct pieces held by one worker; when it is full the half that was used least goes.
CACHE_PIECES = 1_000_000
#: Marks that form one pre-token when they follow a letter (no apostrophe: contractions are split otherwise).
MARKS = ".,;:!?%*$&#"
#: Letters below this code point are letters in every Unicode version.
LATIN_END = "\u0250"
#: Byte-level files write a byte that is no visible Latin-1 character as a letter from U+0100 on.
_VISIBLE = [*range(33, 127), *range(161, 173), *range(174, 256)]
BYTE_LETTERS = {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in _VISIBLE)}

# Set-ups (normaliser, pre-tokenizer, model without its vocabulary) whose pre-token boundaries are known.
_BYTE_LEVEL = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True}
_MODEL = {"type": "BPE", "dropout": None, "unk_token": None, "continuing_subword_prefix": None, "fuse_unk": False, "byte_fallback": False, "ignore_merges": False}
KNOWN = (
    (None, _BYTE_LEVEL | {"use_regex": True}, _MODEL | {"end_of_word_suffix": None}),
    (
        {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]},
        {"type": "Sequence", "pretokenizers": [{"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True}, _BYTE_LEVEL | {"use_regex": False}]},
        _MODEL | {"end_of_word_suffix": "</w>"},
    ),
)


def set_up(tokenizer) -> tuple:
    """A tokenizer's (normaliser, pre-tokenizer, model without its vocabulary)."""
    parts = json.loads(tokenizer.to_str())
    return parts["normalizer"], parts["pre_tokenizer"], {k: v for k, v in parts["model"].items() if k not in ("vocab", "merges")}


class _Pieces(dict):
    """Numbers of pieces in the order in which they are first met; ``new`` lists those whose ids are still to be found."""

    def __init__(self) -> None:
        super().__init__()
        self.new: list[str] = []

    def __missing__(self, piece: str) -> int:
        self[piece] = n = len(self)
        self.new.append(piece)
        return n


class WordCachedTokenizer:
    """``encode(texts)`` gives one uint32 array of ids for each text (null: empty)."""

    def __init__(self, path: str, cache_pieces: int = CACHE_PIECES):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self._tok = Tokenizer.from_file(path)
        added = self._tok.get_added_tokens_decoder().values()
        self._added = [t.content for t in added]
        one = lambda s: self._tok.encode(s, add_special_tokens=False).ids
        self._blank_is_token = one("a b") != one("a") + one("b")
        self._mark = one("\n") if self._blank_is_token else one("\x01")
        self._cacheable = set_up(self._tok) in KNOWN and len(self._mark) == 1 and not any(t.normalized for t in added)  # such a token can match text that is written otherwise
        self._model = self._tok.model
        self._mark_ids: dict[str, list[int]] = {}
        self._limit = cache_pieces
        self._at = _Pieces()
        self._ids = np.zeros(1 << 20, np.uint32)
        self._start = np.zeros(1 << 16, np.int64)
        self._len = np.zeros(1 << 16, np.int64)
        self._used = self._known = 0
        self._uses = np.zeros(1 << 16, np.int64)

    def _shrink(self) -> None:
        """Keep the half of the pieces that was used most."""
        kept = np.sort(np.argsort(-self._uses[: self._known], kind="stable")[: self._limit // 2])
        pieces, old = list(self._at), (self._ids, self._start, self._len)
        self._at = _Pieces()
        self._at.update((pieces[k], n) for n, k in enumerate(kept.tolist()))
        lens = self._len[kept]
        total = np.cumsum(lens)
        place = np.arange(total[-1] if len(total) else 0) + np.repeat(self._start[kept] - (total - lens), lens)
        self._uses[: len(kept)] = self._uses[kept] // 2
        self._uses[len(kept) :] = 0
        self._ids[: len(place)] = old[0][place]
        self._start[: len(kept)], self._len[: len(kept)] = total - lens, lens
        self._used, self._known = len(place), len(kept)

    def _add(self, each: list[list[int]]) -> None:
        """Store the ids of the pieces met last, in their order."""
        n, k = self._known, len(each)
        lens = np.fromiter(map(len, each), np.int64, k)
        flat = np.fromiter(itertools.chain.from_iterable(each), np.uint32, int(lens.sum()))
        while n + k > len(self._start):
            self._start, self._len, self._uses = (np.concatenate([x, np.zeros_like(x)]) for x in (self._start, self._len, self._uses))
        while self._used + len(flat) > len(self._ids):
            self._ids = np.concatenate([self._ids, np.zeros_like(self._ids)])
        self._ids[self._used : self._used + len(flat)] = flat
        self._start[n : n + k] = np.cumsum(lens) - lens + self._used
        self._len[n : n + k] = lens
        self._used += len(flat)
        self._known += k

    def _together(self, pieces: list[str]) -> list[list[int]]:
        """Ids of pieces by one call, told apart by a mark that is one id and no part of a piece."""
        if self._blank_is_token:
            text = "\n".join([f" {p}" for p in pieces])
        else:
            text = " \x01 ".join(pieces)
        ids = self.whole(text)
        cut = [i for i, x in enumerate(ids) if x == self._mark[0]]
        if len(cut) != len(pieces) - 1:  # a piece holds the mark after all: one by one
            return [self.whole(f" {p}" if self._blank_is_token else p) for p in pieces]
        return [ids[i + 1 : j] for i, j in zip([-1, *cut], [*cut, len(ids)])]

    def whole(self, text: str) -> list[int]:
        return self._tok.encode_batch_fast([text], add_special_tokens=False)[0].ids

    def _pieces(self, text: str) -> list[str] | None:
        """Pieces of a text; None if it must be encoded whole.

        Where blanks are tokens a piece stands for " piece", but "\npiece" for itself and
        "\rpiece" for a text's start.
        """
        if not self._blank_is_token:
            return None if "\x01" in text else text.replace("\n", " ").split(" ")
        if " ".join(text.split()) != text.replace("\n", " "):
            return None
        return ("\r" + text.replace("\n", " \n")).split(" ")

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        out: list[np.ndarray | None] = [None] * len(texts)
        plan: list[tuple[int, int]] = []
        words: list[str] = []
        for i, text in enumerate(texts):
            mine = self._pieces(text) if text and self._cacheable and not any(a in text for a in self._added) else None
            if mine is None:
                out[i] = np.asarray(self.whole(text) if text else [], np.uint32)
                continue
            words += mine
            plan.append((i, len(mine)))
        if words:
            lens, ids = self._gather(words)
            ends, k, a = np.cumsum(lens), 0, 0
            for i, n in plan:
                k += n
                b = int(ends[k - 1])
                out[i] = ids[a:b]
                a = b
        return out  # type: ignore[return-value]

    def _gather(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        if len(self._at) > self._limit:
            self._shrink()
        idx = np.fromiter(map(self._at.__getitem__, words), np.int64, len(words))
        if self._at.new:
            self._learn(self._at.new)
            self._at.new = []
        self._uses[idx] += 1  # once for each call
        lens, starts = self._len[idx], self._start[idx]
        total = np.cumsum(lens)
        pos = np.arange(total[-1], dtype=np.int64)
        pos += np.repeat(starts - (total - lens), lens)
        return lens, self._ids[pos]

    def _learn(self, new: list[str]) -> None:
        """Encode new pieces: plain words by the file's model itself, all others by the whole tokenizer."""
        each = [self._word(w) for w in new]
        odd = [i for i, ids in enumerate(each) if ids is None]
        lines = [i for i in odd if self._blank_is_token and new[i][:1] in ("\n", "\r")]
        inner = [i for i in odd if not (self._blank_is_token and new[i][:1] in ("\n", "\r"))]
        for k in range(0, len(inner), 50_000):
            some = inner[k : k + 50_000]
            for i, ids in zip(some, self._together([new[i] for i in some])):
                each[i] = ids
        if lines:  # encoded without the blank; "\r" marks the start of a text
            for i, x in zip(lines, self._tok.encode_batch_fast([new[i][1:] for i in lines], add_special_tokens=False)):
                each[i] = (self._mark if new[i][0] == "\n" else []) + x.ids
        self._add(each)

    def _word(self, w: str) -> list[int] | None:
        """Ids of Latin letters with a run of marks after them: two pre-tokens that need no splitter."""
        head = ""
        if self._blank_is_token:
            head = w[:1]
            if head in ("\n", "\r"):
                w = w[1:]
            else:
                head = " "
        core = w.rstrip(MARKS)
        if not core.isalpha() or not (core.isascii() or max(core) < LATIN_END):
            return None
        if not self._blank_is_token and not core.lower().isalpha():  # lower case adds a mark, which joins those that follow
            return None
        if len(core) < len(w) and head in ("", " "):  # the word without its marks may be known
            n = self._at.get(core, self._known)
            if n < self._known:
                a = self._start[n]
                return self._ids[a : a + self._len[n]].tolist() + self._marks(w[len(core) :])
        if self._blank_is_token:
            text = core if core.isascii() else core.encode().decode("latin-1").translate(BYTE_LETTERS)
            ids = [t.id for t in self._model.tokenize("\u0120" + text if head == " " else text)]
            if head == "\n":
                ids = self._mark + ids
        else:
            text = core.lower()
            if not text.isascii():
                text = text.encode().decode("latin-1").translate(BYTE_LETTERS)
            ids = [t.id for t in self._model.tokenize(text)]
        if len(core) < len(w):
            ids += self._marks(w[len(core) :])
        return ids

    def _marks(self, run: str) -> list[int]:
        if run not in self._mark_ids:
            if len(self._mark_ids) > 10_000:
                self._mark_ids.clear()
            self._mark_ids[run] = [t.id for t in self._model.tokenize(run)]
        return self._mark_ids[run]


_tokenizers: dict[str, WordCachedTokenizer] = {}


def tokenizer(path: str, cache_pieces: int = CACHE_PIECES) -> WordCachedTokenizer:
    """One tokenizer for each worker process and file."""
    if path not in _tokenizers:
        _tokenizers[path] = WordCachedTokenizer(path, cache_pieces)
    return _tokenizers[path]
