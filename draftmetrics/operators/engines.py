"""Interfaces to what the library doesn't bundle: tokenizers with tags, sentence encoders, judges.

A factory makes the engine; it is called once in each worker process, so a model is loaded
where it is used.  The defaults need no model file: words without tags, hashed character
n-grams, and answers replayed from a table.
"""

from __future__ import annotations

import hashlib
import re
import time
import traceback
from collections.abc import Callable, Iterator
from typing import Any, Protocol

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from draftmetrics.operators.encoder import NgramEncoder
from draftmetrics.sources.harvest import JUDGE_CALLS, RetryPolicy

#: Engines of this process by their pickled factory.
_made: dict[bytes, Any] = {}


def engine(factory: Callable[[], Any]) -> Any:
    """The factory's engine; made once in a process for each factory, told apart by what it is and closes over."""
    key = hashlib.sha256(cloudpickle.dumps(factory)).digest()
    if key not in _made:
        _made[key] = factory()
    return _made[key]


class Tokenizer(Protocol):
    def tokenize(self, text: str) -> list[tuple[str, str]]:
        """(form, tag) of every token, in order."""


class Embedder(Protocol):
    def encode(self, texts: list[str]) -> np.ndarray:
        """One vector for each text."""


class Judge(Protocol):
    def upload(self, name: str, content: bytes) -> str:
        """A handle of the stored document."""

    def ask(self, handle: str, prompt: str) -> str:
        """The raw answer."""

    def delete(self, handle: str) -> None: ...


class WordTokenizer:
    """Runs of word characters, all with one tag."""

    tag = "NNG"

    def tokenize(self, text: str) -> list[tuple[str, str]]:
        return [(w, self.tag) for w in re.findall(r"\w+", text)]


class ReplayJudge:
    """Answers by name of the document."""

    def __init__(self, answers: dict[str, str]):
        self.answers = answers

    def upload(self, name: str, content: bytes) -> str:
        return name

    def ask(self, handle: str, prompt: str) -> str:
        return self.answers[handle]

    def delete(self, handle: str) -> None:
        pass


def tagged_tokens(text: Column, factory: Callable[[], Tokenizer] = WordTokenizer) -> Column:
    """An array of (form, tag); null stays null."""

    @F.pandas_udf("array<struct<form:string,tag:string>>")
    def tag(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        tokenizer = engine(factory)
        for part in parts:
            yield part.map(lambda t: None if t is None else [{"form": f, "tag": g} for f, g in tokenizer.tokenize(t)])

    return tag(text)


def embedded(text: Column, factory: Callable[[], Embedder] = NgramEncoder) -> Column:
    """The encoder's vector of each text; null stays null."""

    @F.pandas_udf("array<double>")
    def encode(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encoder = engine(factory)
        for part in parts:
            known = [t for t in part if t is not None]
            vectors = iter(np.asarray(encoder.encode(known), float).tolist() if known else [])
            yield pd.Series([None if t is None else next(vectors) for t in part], dtype=object)

    return encode(text)


def judged(docs: DataFrame, id_col: str, name_col: str, content_col: str, prompt: str, factory: Callable[[], Judge], accept: Callable[[str], bool] | None = None, policy: RetryPolicy = JUDGE_CALLS, sleep: Callable[[float], None] = time.sleep) -> DataFrame:
    """(id, raw, _error): each document is uploaded, judged and deleted again, whatever happens.

    An attempt fails by an error or by an answer that ``accept`` refuses; ``_error`` holds
    the last one's traceback.
    """

    def one(judge: Judge, name: str, content: bytes) -> tuple[str | None, str | None]:
        error = None
        for n in range(1, policy.attempts + 1):
            handle = None
            try:
                handle = judge.upload(name, content)
                raw = judge.ask(handle, prompt)
                if accept is not None and not accept(raw):
                    raise ValueError(f"no answer in: {raw}")
                return raw, None
            except Exception:  # noqa: BLE001  whatever a judge raises is a failed attempt
                error = traceback.format_exc()
                if n < policy.attempts:
                    sleep(policy.pause(n))
            finally:
                if handle is not None:
                    try:
                        judge.delete(handle)
                    except Exception:  # noqa: BLE001, S110  a document that can't be deleted is no failure
                        pass
        return None, error

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        judge = engine(factory)
        for frame in frames:
            found = [one(judge, name, bytes(content or b"")) for name, content in zip(frame["name"], frame["content"])]
            yield pd.DataFrame({"id": frame["id"], "raw": [r for r, _ in found], "_error": [e for _, e in found]})

    picked = docs.select(F.col(id_col).cast("string").alias("id"), F.col(name_col).cast("string").alias("name"), F.col(content_col).cast("binary").alias("content"))
    return picked.mapInPandas(run, "id string, raw string, _error string").withColumnRenamed("id", id_col)
