"""Language identification by multilingual mixture inference.

A model holds, for each learned language, smoothed log probabilities of hashed byte
trigrams of lower-cased text.  A document is cut into units of ``UNIT`` trigrams; every
unit has a log likelihood under each language, and the document is a mixture of
languages.  Expectation-maximisation estimates the proportions; the language set is
selected by penalised likelihood, adding languages in the order of their share in the
full mixture as long as each pays its penalty.  A document in which even the best
language of every unit could not pay for a second language is settled without EM (an
exact bound, no approximation).

Nulls: a null text, or one without a letter, is ``und`` with score 0.  Rows with a null
language or text are not learned from.  A model of an empty table knows no language and
calls every document ``und``; an empty table gives an empty table.  Ties go to the language
whose name comes first.  Repeated rows get the same result each.  Very long texts are whole
mixtures of all their units; likelihoods are summed a bounded run of units at a time.  Other
columns stay, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from draftmetrics.llm.rowmap import free_name, with_text_struct

UNDETERMINED = "und"
#: Trigrams of a unit; their log likelihood counts as a third, as each byte is in three trigrams.
UNIT, TEMPER = 48, 1.0 / 3.0
#: Log likelihood that a further language must gain: a constant and half the logarithm of the units.
PENALTY = 3.0
EM_ROUNDS, SMOOTHING = 12, 0.5
#: Values in a model at most: buckets are halved until they fit (16 MB as float32).
MODEL_VALUES = 1 << 22
MAX_BUCKET_BITS, MIN_BUCKET_BITS = 16, 10
#: Log probabilities that are looked up at once.
LOOKED_UP = 1 << 22
#: Counters of different languages that a training task holds before it passes them on.
HELD_LANGUAGES = 64

_LETTER = regex.compile(r"\p{L}")
_CLASS = bytes((b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32) for b in range(256))


def _trigrams(texts: list[str | None], bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(buckets of all trigrams whose middle is no blank, trigrams of each text)."""
    raw = [(t or "").encode() for t in texts]
    sizes = np.array([len(r) + 2 for r in raw], np.int64)
    buf = np.frombuffer((b" " + b"  ".join(raw) + b" ").translate(_CLASS), np.uint8).astype(np.uint32)
    h = buf[:-2] * np.uint32(0x9E3779B1) ^ buf[1:-1] * np.uint32(0x85EBCA77) ^ buf[2:] * np.uint32(0xC2B2AE3D)
    h = (h ^ h >> np.uint32(15)) * np.uint32(0x2C1B3C6D)
    at = np.flatnonzero(buf[1:-1] != 32)
    doc = np.searchsorted(np.cumsum(sizes), at + 1, side="right")
    return (h[at] >> np.uint32(32 - bits)).astype(np.int64), np.bincount(doc, minlength=len(texts))


@dataclass(frozen=True)
class LanguageModel:
    languages: tuple[str, ...]
    log_p: np.ndarray  #: float32, (buckets, languages)
    bits: int

    def mixture(self, texts: list[str | None]) -> list[list[tuple[str, float]]]:
        """Each text's languages with their proportions, largest first; empty if undetermined."""
        out: list[list[tuple[str, float]]] = [[] for _ in texts]
        if not self.languages:
            return out
        bucket, count = _trigrams(texts, self.bits)
        readable = np.array([n > 0 and bool(_LETTER.search(t)) for t, n in zip(texts, count)], bool)
        if not readable.any():
            return out
        first = np.cumsum(count) - count
        units = -(-count // UNIT)
        starts = np.repeat(first, units) + UNIT * (np.arange(units.sum()) - np.repeat(np.cumsum(units) - units, units))
        ll = self._unit_likelihoods(bucket, starts)
        docs = np.flatnonzero(readable)
        for d, mix in zip(docs.tolist(), _select(ll, np.cumsum(units) - units, units, docs)):
            out[d] = [(self.languages[k], p) for k, p in mix]
        return out

    def _unit_likelihoods(self, bucket: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """(units, languages): log likelihoods of the units that begin at ``starts``."""
        step = max(1, LOOKED_UP // (UNIT * len(self.languages)))
        out = np.empty((len(starts), len(self.languages)))
        for a in range(0, len(starts), step):
            some = starts[a : a + step]
            end = starts[a + step] if a + step < len(starts) else len(bucket)
            out[a : a + step] = np.add.reduceat(self.log_p[bucket[some[0] : end]], some - some[0], axis=0)
        return out * TEMPER


def _select(ll: np.ndarray, first: np.ndarray, units: np.ndarray, docs: np.ndarray) -> list[list[tuple[int, float]]]:
    """For each of ``docs`` the selected languages and proportions."""
    n_lang = ll.shape[1]
    take = np.repeat(np.isin(np.arange(len(units)), docs), units)
    ll, n = ll[take], units[docs]
    start = np.cumsum(n) - n
    single = np.add.reduceat(ll, start, axis=0)
    best = single.argmax(1)
    score = single[np.arange(len(docs)), best]
    penalty = PENALTY + 0.5 * np.log(n)
    out = [[(int(b), 1.0)] for b in best]
    bound = np.add.reduceat(ll.max(1), start)
    open_ = np.flatnonzero(bound - score > penalty) if n_lang > 1 else np.zeros(0, np.int64)
    if not len(open_):
        return out

    def rows(which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        keep = np.zeros(len(docs), bool)
        keep[which] = True
        return ll[np.repeat(keep, n)], n[which]

    def em(part: np.ndarray, size: np.ndarray, allowed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Proportions and log likelihood with the allowed languages of each document."""
        begin = np.cumsum(size) - size
        masked = np.where(np.repeat(allowed, size, axis=0), part, -np.inf)
        top = masked.max(1)
        like = np.exp(masked - top[:, None])
        pi = allowed / allowed.sum(1, keepdims=True)
        for _ in range(EM_ROUNDS):
            r = like * np.repeat(pi, size, axis=0)
            r /= r.sum(1, keepdims=True)
            pi = np.add.reduceat(r, begin, axis=0) / size[:, None]
        total = np.log((like * np.repeat(pi, size, axis=0)).sum(1)) + top
        return pi, np.add.reduceat(total, begin)

    part, size = rows(open_)
    share, _ = em(part, size, np.ones((len(open_), n_lang), bool))
    share[np.arange(len(open_)), best[open_]] = 2.0  # the best single language comes first
    order = np.argsort(-share, axis=1, kind="stable")
    current, k = score[open_], 1
    going = np.arange(len(open_))
    while len(going) and k < n_lang:
        k += 1
        allowed = np.zeros((len(going), n_lang), bool)
        np.put_along_axis(allowed, order[going, :k], True, axis=1)
        part, size = rows(open_[going])
        pi, like = em(part, size, allowed)
        paid = like - current[going] > penalty[open_[going]]
        for g, p in zip(going[paid], pi[paid]):
            out[open_[g]] = sorted(((int(j), float(p[j])) for j in order[g, :k]), key=lambda x: (-x[1], x[0]))
        current[going[paid]] = like[paid]
        going = going[paid]
    return out


def train(labelled: DataFrame, lang_col: str = "lang", text_col: str = "text") -> LanguageModel:
    """Count trigrams by language over all labelled rows (both columns not null)."""
    rows = labelled.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text")).filter("lang IS NOT NULL AND text IS NOT NULL")
    n_lang = max(1, rows.select("lang").distinct().count())
    bits = max(MIN_BUCKET_BITS, min(MAX_BUCKET_BITS, int(np.log2(MODEL_VALUES / n_lang))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] = {}

        def flush() -> Iterator[pa.RecordBatch]:
            for lang, total in held.items():
                at = np.flatnonzero(total)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(total[at], pa.int64())], names=["lang", "bucket", "n"])
            held.clear()

        for batch in batches:
            langs = batch.column(0).to_pylist()
            for lang in dict.fromkeys(langs):
                texts = batch.column(1).filter(pa.array([x == lang for x in langs])).to_pylist()
                while texts:
                    some, size = [], 0
                    while texts and size < 1 << 20:
                        some.append(texts.pop())
                        size += len(some[-1])
                    counts = np.bincount(_trigrams(some, bits)[0], minlength=1 << bits)
                    if lang in held:
                        held[lang] += counts
                    else:
                        if len(held) >= HELD_LANGUAGES:
                            yield from flush()
                        held[lang] = counts
        yield from flush()

    summed = rows.mapInArrow(run, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    by_lang: dict[str, np.ndarray] = {}
    for r in summed.toLocalIterator():  # MODEL_VALUES rows at most, whatever the corpus
        by_lang.setdefault(r["lang"], np.zeros(1 << bits))[r["bucket"]] = r["n"]
    languages = tuple(sorted(by_lang))
    if not languages:
        return LanguageModel((), np.zeros((1 << bits, 0), np.float32), bits)
    counts = np.stack([by_lang[x] for x in languages], axis=1) + SMOOTHING
    return LanguageModel(languages, np.log(counts / counts.sum(0)).astype(np.float32), bits)


def identify(docs: DataFrame, model: LanguageModel, text_col: str = "text", name: str | None = None) -> DataFrame:
    """``docs`` with a struct column (lang_pred, score, languages, proportions)."""
    name = name or free_name(docs, "language")
    shared = docs.sparkSession.sparkContext.broadcast(model)  # MODEL_VALUES at most

    def make():
        fitted = shared.value

        def work(texts: list[str | None]) -> list[list]:
            found = fitted.mixture(texts)
            return [[m[0][0] if m else UNDETERMINED for m in found], [min(1.0, m[0][1]) if m else 0.0 for m in found], [[x for x, _ in m] for m in found], [[p for _, p in m] for m in found]]

        return work

    return with_text_struct(docs, text_col, name, "lang_pred string, score double, languages array<string>, proportions array<double>", make)
