"""One feature row per document from its text."""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from draftmetrics.functions import text as tx
from draftmetrics.functions.profiles import EXACT, HANGUL, PHRASE, START, ScriptProfile
from draftmetrics.functions.scalars import rounded, tag_class
from draftmetrics.operators import encoder, morphology
from draftmetrics.operators.features import checked_broadcast


def sentence_length(docs: DataFrame, id_col: str, text_col: str, profile: ScriptProfile, digits: int | None = None) -> DataFrame:
    """(id, n_sentences, n_words, avg_words): mean words of a sentence, 0 without sentences; rounded only if ``digits`` are given."""
    found = docs.select(id_col, tx.sentences(F.col(text_col), profile.letters).alias("s"))
    n_words = F.aggregate("s", F.lit(0).cast("long"), lambda acc, x: acc + F.size(tx.words(x)))
    counted = found.select(id_col, F.when(F.col("s").isNull(), 0).otherwise(F.size("s")).cast("long").alias("n_sentences"), F.coalesce(n_words, F.lit(0)).alias("n_words"))
    mean = F.coalesce(F.try_divide("n_words", "n_sentences"), F.lit(0.0))
    return counted.withColumn("avg_words", mean if digits is None else rounded(mean, digits))


def exception_candidates(docs: DataFrame, id_col: str, text_col: str, profile: ScriptProfile) -> DataFrame:
    """(id, pos, sentence): sentences with an exception keyword; documents without one are dropped early."""
    text = F.col(text_col)
    kept = docs.filter(tx.contains_any(text, profile.exception_keywords)).select(id_col, F.posexplode(tx.loose_sentences(text)).alias("pos", "sentence"))
    return kept.filter(tx.contains_any(F.col("sentence"), profile.exception_keywords) & F.col("sentence").endswith("."))


def exception_summary(docs: DataFrame, id_col: str, candidates: DataFrame, similarity: Column | None = None, threshold: float = 0.45, examples: int = 3) -> DataFrame:
    """(id, exception_count, avg_similarity, examples) of every document.

    ``similarity`` (a column of ``candidates``) must exceed the threshold and is averaged as
    rounded to three places, the mean is rounded to three places as well; without it every
    candidate counts.
    """
    sim = rounded(similarity, 3) if similarity is not None else F.lit(None).cast("double")
    kept = candidates if similarity is None else candidates.filter(similarity > threshold)
    kept = kept.withColumn("sim", sim).withColumn("rn", F.row_number().over(Window.partitionBy(id_col).orderBy("pos")))
    few = F.collect_list(F.when(F.col("rn") <= examples, F.struct("pos", "sentence")))  # ``examples`` entries at most
    summary = kept.groupBy(id_col).agg(F.count("*").alias("n"), rounded(F.avg("sim"), 3).alias("a"), F.array_join(F.transform(F.array_sort(few), lambda x: x["sentence"]), " | ").alias("examples"))
    joined = docs.select(id_col).join(summary, id_col, "left")
    return joined.select(id_col, F.coalesce("n", F.lit(0)).alias("exception_count"), F.coalesce("a", F.lit(0.0)).alias("avg_similarity"), F.coalesce("examples", F.lit("")).alias("examples"))


def exception_similarity(docs: DataFrame, id_col: str, text_col: str, profile: ScriptProfile, exemplars: Sequence[str] | None = None, model: DataFrame | None = None, threshold: float = 0.45) -> DataFrame:
    """``exception_summary`` by the n-gram encoder: sentences that are similar to one of the exemplars (default: the profile's).

    ``model`` is a fitted encoder; without one it is fitted on the candidate sentences of ``docs``.
    """
    candidates = exception_candidates(docs, id_col, text_col, profile)
    model = encoder.fit(candidates, "sentence") if model is None else model
    scored = encoder.with_similarity(candidates, "sentence", exemplars or profile.exemplars, model)
    return exception_summary(docs, id_col, scored, F.col("similarity"), threshold)


def rule_condition(token: Column, tag: Column, profile: ScriptProfile) -> dict[str, Column]:
    """For each token rule of a profile, whether a token (with its tag) meets it."""
    out = {}
    for name, kind, pattern, start in profile.of_kind(START, EXACT):
        cond = token.startswith(pattern) if kind == START else token == pattern
        out[name] = cond & tag.startswith(start) if start else cond
    return out


def vague_terms(docs: DataFrame, id_col: str, text_col: str, profile: ScriptProfile, tag: Column | Callable[[Column], Column] | None = None, morphemes: DataFrame | None = None) -> DataFrame:
    """Counts of every vague term in fixed order, and their total; a token may meet several rules.

    Tokens are words, tagged by a function ``tag`` (default: no tags) and counted in place,
    without a shuffle; or by an expression over the column ``token``; or ``morphemes``
    (id, form, tag, n) as ``morphology.tokens_of`` gives them.  The Hangul profile, whose rules
    ask for tags, gets morphemes by the default model if neither is given.
    """
    text = F.col(text_col)
    if tag is None and morphemes is None and profile is HANGUL:
        morphemes = morphology.tokens_of(docs, id_col, text_col, morphology.default_model(docs.sparkSession))
    if morphemes is not None:
        tokens = morphemes.select(id_col, F.col("form").alias("token"), "tag", "n")
        rules = rule_condition(F.col("token"), F.col("tag"), profile)
        hits = tokens.groupBy(id_col).agg(*[F.sum(F.when(c, F.col("n")).otherwise(0)).alias(n) for n, c in rules.items()])
    elif isinstance(tag, Column):
        tokens = docs.select(id_col, F.explode(tx.words(text)).alias("token")).filter(F.col("token").rlike(_starts(profile)))
        hits = tokens.groupBy(id_col).agg(*[F.count_if(c).alias(n) for n, c in rule_condition(F.col("token"), tag, profile).items()])
    else:
        tag = tag or (lambda token: F.lit(""))
        kept = docs.select(id_col, F.filter(tx.words(text), lambda w: w.rlike(_starts(profile))).alias("hits"), *_phrases(text, profile))
        meets = lambda name: lambda w: rule_condition(w, tag(w), profile)[name]
        counted = [F.when(F.col("hits").isNotNull(), F.size(F.filter("hits", meets(name)))).alias(name) for name, *_ in profile.of_kind(START, EXACT)]
        return _with_total(kept.select(id_col, *counted, *[F.col(f"`{n}`") for n, *_ in profile.of_kind(PHRASE)]), id_col, profile)
    return _with_total(docs.select(id_col, *_phrases(text, profile)).join(hits, id_col, "left"), id_col, profile)


def _starts(profile: ScriptProfile) -> str:
    """What a token that meets some rule looks like."""
    return "^(?:" + "|".join(re.escape(pattern) + ("$" if kind == EXACT else "") for _, kind, pattern, _ in profile.of_kind(START, EXACT)) + ")"


def _phrases(text: Column, profile: ScriptProfile) -> list[Column]:
    return [F.coalesce(tx.phrase_count(text, p), F.lit(0)).cast("long").alias(n) for n, _, p, _ in profile.of_kind(PHRASE)]


def _with_total(joined: DataFrame, id_col: str, profile: ScriptProfile) -> DataFrame:
    """All rules' columns in the profile's order, 0 where null, and their sum."""
    columns = [F.coalesce(F.col(f"`{n}`"), F.lit(0)).cast("long").alias(n) for n in profile.rule_names]
    total = sum((F.coalesce(F.col(f"`{n}`"), F.lit(0)) for n in profile.rule_names[1:]), F.coalesce(F.col(f"`{profile.rule_names[0]}`"), F.lit(0)))
    return joined.select(id_col, *columns, total.cast("long").alias("total"))


def vague_totals(wide: DataFrame, names: list[str]) -> DataFrame:
    """(term, total): corpus totals in long form."""
    sums = wide.agg(*[F.sum(f"`{n}`").alias(n) for n in names])
    return sums.unpivot([], [f"`{n}`" for n in names], "term", "total")


def token_counts(docs: DataFrame, id_col: str, text_col: str, vocabulary: DataFrame, word_col: str = "word") -> DataFrame:
    """(id, token, n, first_pos) of tokens that are in the vocabulary."""
    tokens = docs.select(id_col, F.posexplode(tx.words(F.col(text_col))).alias("pos", "token"))
    known = vocabulary.select(F.col(word_col).alias("token")).filter("token IS NOT NULL AND token <> ''").distinct()
    return tokens.join(checked_broadcast(known), "token").groupBy(id_col, "token").agg(F.count("*").alias("n"), F.min("pos").cast("long").alias("first_pos"))


def token_summary(docs: DataFrame, id_col: str, counts: DataFrame, top: int = 10) -> DataFrame:
    """(id, total, uniq, top): occurrences, distinct tokens, and the most common (ties by first appearance)."""
    order = Window.partitionBy(id_col).orderBy(F.desc("n"), "first_pos")
    ranked = counts.withColumn("rank", F.row_number().over(order))
    best = F.collect_list(F.when(F.col("rank") <= top, F.struct("rank", F.concat_ws(":", "token", F.col("n").cast("string")).alias("x"))))
    summary = ranked.groupBy(id_col).agg(F.sum("n").alias("total"), F.count("*").alias("uniq"), F.array_join(F.transform(F.array_sort(best), lambda e: e["x"]), ", ").alias("top"))
    joined = docs.select(id_col).join(summary, id_col, "left")
    return joined.select(id_col, F.coalesce("total", F.lit(0)).alias("total"), F.coalesce("uniq", F.lit(0)).alias("uniq"), F.coalesce("top", F.lit("")).alias("top"))


def counts_json(counts: DataFrame, id_col: str) -> DataFrame:
    """(id, counts_json): a JSON object of token counts with sorted keys (one document's own tokens)."""
    entries = F.array_sort(F.collect_list(F.struct(F.col("token").alias("key"), F.col("n").alias("value"))))
    return counts.groupBy(id_col).agg(F.to_json(F.map_from_entries(entries)).alias("counts_json"))


def pick_senses(candidates: DataFrame, key: list[str], threshold: float = 0.45) -> DataFrame:
    """The grade of each occurrence: of the most similar sense, the first on ties; of the first sense where only one exists or none is similar enough.

    ``candidates`` has the key, ``sense_ord``, ``grade`` and ``sim``.
    """
    picked = candidates.groupBy(*key).agg(
        F.count("*").alias("n"), F.max("sim").alias("best"),
        F.max_by("grade", F.struct("sim", (-F.col("sense_ord")).alias("o"))).alias("by_sim"),
        F.min_by("grade", "sense_ord").alias("first_grade"),
    )
    grade = F.when((F.col("n") == 1) | F.col("best").isNull() | (F.col("best") < threshold), F.col("first_grade")).otherwise(F.col("by_sim"))
    return picked.select(*key, grade.alias("grade"))


#: Senses of a word whose choice is written out sense by sense, at most; more are compared by a function over the array.
WRITTEN_OUT = 8


def chosen_grade(senses: Column, similarity: Callable[[Column], Column], threshold: float, most: int = WRITTEN_OUT + 1) -> Column:
    """``pick_senses`` within an array of (sense_ord, grade, gloss) in that order, of at most ``most``; null without senses.

    A single sense is compared with nothing.  Few senses are written out, as generated code compares them, functions over arrays don't.
    """
    below = math.nextafter(threshold, -math.inf)
    # whatever is null or below the threshold is alike, so that the first wins; written thus, each similarity is evaluated once
    entry = lambda s, k: F.struct(F.greatest(similarity(s["gloss"]).cast("double"), F.lit(below)).alias("sim"), (-k).alias("o"), s["grade"].alias("grade"))
    if most > WRITTEN_OUT:
        every = F.transform(senses, entry)
    else:
        every = F.array(*[F.when(F.size(senses) > k, entry(F.get(senses, F.lit(k)), F.lit(k))) for k in range(max(most, 1))])
    return F.when(F.size(senses) > 1, F.array_max(every)["grade"]).otherwise(F.get(senses, F.lit(0))["grade"])


def first_senses(lexicon: DataFrame, keys: list[str]) -> DataFrame:
    """One row for each key of a lexicon (keys, grade, sense_ord): the grade of the first sense."""
    if "sense_ord" not in lexicon.columns:
        return lexicon.select(*keys, "grade").groupBy(*keys).agg(F.min("grade").alias("grade"))
    return lexicon.groupBy(*keys).agg(F.min_by("grade", "sense_ord").alias("grade"))


def vocabulary_grade(
    docs: DataFrame, id_col: str, text_col: str, lexicon: DataFrame, profile: ScriptProfile, tokens: Callable[[Column], Column] | None = None, similarity: Callable[[Column, Column], Column] | None = None, threshold: float = 0.45, digits: int | None = None, view: Callable[[Column], Column] = lambda s: s
) -> DataFrame:
    """(id, n_sentences, n_matched, avg_grade): mean grade of the tokens of sentences that the lexicon knows.

    The lexicon has word and grade, and may have pos, sense_ord and gloss.  ``tokens`` gives a
    sentence's (form, tag) pairs (default: words; a lexicon with pos then needs tags, whose
    class is compared with pos).  Of several senses the one whose gloss is most similar to the
    sentence counts (``similarity`` of sentence and gloss, as in ``pick_senses``); without
    ``similarity`` the first one.  ``view`` makes of a sentence what ``similarity`` gets, once
    for each sentence.  A word counts once for each occurrence, however many senses.
    """
    by_class = "pos" in lexicon.columns
    keys = ["word", "pos"] if by_class else ["word"]
    found = docs.select(id_col, F.coalesce(tx.sentences(F.col(text_col), profile.letters), F.array().cast("array<string>")).alias("s"))
    size = F.size("s").cast("long").alias("n_sentences")
    if similarity is None and tokens is None:  # one row for each token; documents without any keep a row
        opened = found.select(id_col, size, F.explode_outer(F.flatten(F.transform("s", tx.words))).alias("word"))
    else:
        opened = found.select(id_col, size, F.explode_outer("s").alias("line"))
        parts = tokens(F.col("line")) if tokens else F.transform(tx.words(F.col("line")), lambda w: F.struct(w.alias("form"), F.lit("").alias("tag")))
        opened = opened.select(id_col, "n_sentences", view(F.col("line")).alias("sentence"), parts.alias("parts"))
        opened = opened.select(id_col, "n_sentences", "sentence", F.explode_outer("parts").alias("token")).withColumn("word", F.col("token.form"))
    if by_class:
        opened = opened.withColumn("pos", tag_class(F.col("token.tag")))
    if similarity is None:
        graded = opened.join(checked_broadcast(first_senses(lexicon, keys)), keys, "left")
    else:  # a word's senses are one array, so the choice needs no shuffle
        senses = lexicon.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("sense_ord", "grade", "gloss"))).alias("senses"))
        most = senses.agg(F.max(F.size("senses"))).first()[0] or 0
        known = opened.join(checked_broadcast(senses), keys, "left")
        graded = known.withColumn("grade", chosen_grade(F.col("senses"), lambda gloss: similarity(F.col("sentence"), gloss), threshold, most))
    mean = F.avg("grade")
    return graded.groupBy(id_col).agg(F.max("n_sentences").alias("n_sentences"), F.count("grade").alias("n_matched"), (mean if digits is None else rounded(mean, digits)).alias("avg_grade"))
