"""``metrics.vocabulary_grade`` by the similarity of sentences and glosses, for a lexicon that a worker holds.

A batch of sentences is worked on at once: n-grams are numbered together, words find their
senses in one look-up, and each gloss of a sentence is compared with it once, by bits of the
gloss at the sentence's numbers, however often its words occur.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from draftmetrics.functions import text as tx
from draftmetrics.functions.profiles import ScriptProfile
from draftmetrics.operators import encoder, metrics
from draftmetrics.operators.features import BROADCAST_ROWS

#: Glosses that a worker holds at most (8 KB each); numbers that are looked up at once.
GLOSSES, LOOKUPS = 4096, 1 << 21


class Senses:
    """A lexicon in arrays: the senses of a word stand together, in their order; ``sets`` has a bit for each number of a gloss."""

    def __init__(self, rows: list, glosses: list):
        rows = sorted(rows, key=lambda r: (r["word"], r["sense_ord"]))
        place = {r["gloss_id"]: k for k, r in enumerate(glosses)}
        self.words, self.count = (list(x) for x in np.unique(np.array([r["word"] for r in rows], object), return_counts=True)) if rows else ([], [])
        self.count = np.array(self.count, np.int64)
        self.first = np.cumsum(self.count) - self.count
        self.grade = np.array([math.nan if r["grade"] is None else r["grade"] for r in rows], float)
        self.gloss = np.array([place[r["gloss_id"]] for r in rows], np.int64)
        self.size = np.array([len(r["numbers"]) for r in glosses], float)
        has = np.zeros((len(glosses), -(-encoder.DIMENSIONS // 8)), np.uint8)
        for k, r in enumerate(glosses):
            np.bitwise_or.at(has[k], np.array(r["numbers"], np.int64) >> 3, np.uint8(1) << (np.array(r["numbers"], np.int64) & 7).astype(np.uint8))
        self.width, self.sets = has.shape[1], has.ravel()

    def overlaps(self, sentence: np.ndarray, gloss: np.ndarray, ends: np.ndarray, numbers: np.ndarray) -> np.ndarray:
        """How many numbers each sentence has in common with the gloss beside it."""
        begin, size = ends[sentence], ends[sentence + 1] - ends[sentence]
        out, upto = np.zeros(len(sentence), np.int64), np.cumsum(size)
        a = 0
        while a < len(sentence):
            b = max(a + 1, int(np.searchsorted(upto, (upto[a - 1] if a else 0) + LOOKUPS, side="right")))
            n = size[a:b]
            first = np.cumsum(n) - n
            number = numbers[np.arange(int(n.sum())) - np.repeat(first - begin[a:b], n)]
            hit = (self.sets[np.repeat(gloss[a:b] * self.width, n) + (number >> 3)] >> (number & 7).astype(np.uint8)) & 1
            out[a:b] = np.diff(np.append(0, np.cumsum(hit, dtype=np.int64))[np.append(first, len(hit))])
            a = b
        return out

    def grades(self, clean: pa.Array, words: pa.Array, threshold: float) -> tuple[np.ndarray, np.ndarray]:
        """For each sentence how many of its words the lexicon knows, and the sum of their grades."""
        length = pc.fill_null(pc.list_value_length(words), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        word = pc.fill_null(pc.index_in(words.flatten(), pa.array(self.words, pa.string())), -1).to_numpy(zero_copy_only=False).astype(np.int64)
        owner, kinds = np.repeat(np.arange(len(length)), length), max(1, len(self.words))
        pairs, times = np.unique((owner * kinds + word)[word >= 0], return_counts=True)
        owner, word = pairs // kinds, pairs % kinds
        chosen = self.grade[self.first[word]] if len(word) else np.zeros(0)
        several = np.flatnonzero(self.count[word] > 1)
        if len(several):
            found = encoder.numbers_of(clean)
            ends, numbers = found.offsets.to_numpy().astype(np.int64), found.values.to_numpy().astype(np.int64)
            own, most = owner[several], self.count[word[several]]
            best = np.full(len(own), math.nextafter(threshold, -math.inf))  # below it all senses are alike, so that the first wins
            for k in range(int(most.max())):
                mine = np.flatnonzero(most > k)
                sense = self.first[word[several[mine]]] + k
                asked, back = np.unique(own[mine] * len(self.size) + self.gloss[sense], return_inverse=True)
                sentence, gloss = asked // len(self.size), asked % len(self.size)
                scale = np.sqrt((ends[sentence + 1] - ends[sentence]).astype(float) * self.size[gloss])
                sim = (self.overlaps(sentence, gloss, ends, numbers) / np.where(scale > 0, scale, 1.0))[back]
                better = sim > best[mine]
                best[mine[better]] = sim[better]
                chosen[several[mine[better]]] = self.grade[sense[better]]
        known = ~np.isnan(chosen)
        owner, times, chosen = owner[known], times[known], chosen[known]
        return np.bincount(owner, times, len(length)).astype(np.int64), np.bincount(owner, times * chosen, len(length)).astype(float)


def gloss_grade(docs: DataFrame, id_col: str, text_col: str, senses: DataFrame, glosses: DataFrame, profile: ScriptProfile, threshold: float = 0.45) -> DataFrame:
    """(id, n_sentences, n_matched, avg_grade) as ``metrics.vocabulary_grade`` with ``encoder.overlap`` gives them.

    ``senses`` has word, sense_ord (different for each sense of a word), grade and gloss_id, ``glosses`` gloss_id and the gloss's numbers.
    A lexicon that is too large for a worker is joined instead.
    """
    if senses.limit(BROADCAST_ROWS + 1).count() > BROADCAST_ROWS or glosses.limit(GLOSSES + 1).count() > GLOSSES:
        lexicon = senses.join(glosses, "gloss_id").select("word", "sense_ord", "grade", F.col("numbers").alias("gloss"))
        return metrics.vocabulary_grade(docs, id_col, text_col, lexicon, profile, similarity=encoder.overlap, threshold=threshold, view=encoder.many_buckets)
    shared = docs.sparkSession.sparkContext.broadcast(Senses(senses.collect(), glosses.collect()))  # checked above
    found = docs.select(id_col, F.coalesce(tx.sentences(F.col(text_col), profile.letters), F.array().cast("array<string>")).alias("s"))
    opened = found.select(id_col, F.size("s").cast("long").alias("n_sentences"), F.explode_outer("s").alias("line"))
    given = opened.select(id_col, "n_sentences", encoder.clean(F.col("line")).alias("clean"), tx.words(F.col("line")).alias("words"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, total = shared.value.grades(batch.column(2), batch.column(3), threshold)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n), pa.array(total)], names=["id", "n_sentences", "n", "total"])

    kind = docs.schema[id_col].dataType.simpleString()
    graded = given.mapInArrow(run, f"id {kind}, n_sentences long, n long, total double")
    summed = graded.groupBy("id").agg(F.max("n_sentences").alias("n_sentences"), F.sum("n").alias("n_matched"), F.sum("total").alias("total"))
    return summed.select(F.col("id").alias(id_col), "n_sentences", "n_matched", F.when(F.col("n_matched") > 0, F.col("total") / F.col("n_matched")).alias("avg_grade"))
