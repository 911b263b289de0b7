"""Harvesting pages: fetchers with retries, politeness delays, a cache with a time to live, pagination.

A fetcher is any picklable callable from URL to text that raises on failure; the one that
opens connections is ``http_get``.  A session (``Session``) keeps its cookies between a GET
and the POST of a form.  URLs are fetched once each, in ``partitions`` tasks.
"""

from __future__ import annotations

import random
import time
import urllib.parse
import urllib.request
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from http.cookiejar import CookieJar
from typing import Protocol

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from draftmetrics.functions.dom import page_count
from draftmetrics.functions.html import total_pages
from draftmetrics.session import scratch_table
from draftmetrics.sources.sinks import write_parquet


@dataclass(frozen=True)
class RetryPolicy:
    """Attempts and the pause after the n-th failure: fixed, linear or doubling."""

    attempts: int = 3
    kind: str = "fixed"
    seconds: float = 2.0

    def pause(self, failures: int) -> float:
        if self.kind == "fixed":
            return self.seconds
        return self.seconds * (failures if self.kind == "linear" else 2 ** (failures - 1))


# The policies of the published harvest.
DETAIL_PAGES = RetryPolicy(3, "fixed", 2.0)
MEMBER_PAGES = RetryPolicy(3, "linear", 0.25)
JUDGE_CALLS = RetryPolicy(5, "doubling", 1.0)


#: Seconds between calls: of bill pages, meetings, parties, and members (fixed, or at random within a range).
PAUSES = {"bills": (0.8, 1.5), "meetings": (0.5, 1.2), "parties": 0.5, "members": 0.10}
#: Names under which a listing may take its page number, the usual one first.
PAGE_PARAMETERS = ("pageIndex", "pageNo", "page", "currPage", "pageNum")


def http_get(url: str, timeout: float = 10.0, headers: dict[str, str] | None = None) -> str:
    """The decoded body of a GET; an error status raises."""
    with urllib.request.urlopen(urllib.request.Request(url, headers=headers or {}), timeout=timeout) as r:  # noqa: S310
        return r.read().decode(r.headers.get_content_charset() or "utf-8", "replace")


class Session(Protocol):
    def get(self, url: str) -> str: ...

    def post(self, url: str, form: dict[str, str], headers: dict[str, str]) -> str: ...


class HttpSession:
    """GET and form POST with the cookies of earlier answers."""

    def __init__(self, timeout: float = 15.0):
        self.timeout = timeout
        self.opener = urllib.request.build_opener(urllib.request.HTTPCookieProcessor(CookieJar()))

    def _open(self, request: urllib.request.Request) -> str:
        with self.opener.open(request, timeout=self.timeout) as r:
            return r.read().decode(r.headers.get_content_charset() or "utf-8", "replace")

    def get(self, url: str) -> str:
        return self._open(urllib.request.Request(url))

    def post(self, url: str, form: dict[str, str], headers: dict[str, str]) -> str:
        return self._open(urllib.request.Request(url, urllib.parse.urlencode(form).encode(), headers))


def with_retries(fetch: Callable[..., str], policy: RetryPolicy, sleep: Callable[[float], None] = time.sleep, raising: bool = False) -> Callable[..., tuple[str | None, str | None]]:
    """A call that gives (text, None) or (None, last error); with ``raising`` the last error is raised again."""

    def call(*args) -> tuple[str | None, str | None]:
        error = None
        for n in range(1, policy.attempts + 1):
            try:
                return fetch(*args), None
            except Exception as e:  # noqa: BLE001  whatever a fetcher raises is a failed attempt
                if raising and n == policy.attempts:
                    raise
                error = f"{type(e).__name__}: {e}"
                if n < policy.attempts:
                    sleep(policy.pause(n))
        return None, error

    return call


def rest(delay: float | tuple[float, float], sleep: Callable[[float], None] = time.sleep) -> None:
    """Wait a fixed time, or a random one of a range."""
    seconds = random.uniform(*delay) if isinstance(delay, tuple) else delay
    if seconds:
        sleep(seconds)


def fetch_pages(urls: DataFrame, url_col: str, fetch: Callable[[str], str], policy: RetryPolicy = DETAIL_PAGES, delay: float | tuple[float, float] = 0.0, partitions: int = 8) -> DataFrame:
    """(url, body, _error) of every distinct URL; ``delay`` seconds pass between calls of a task."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        call = with_retries(fetch, policy)
        for frame in frames:
            done = []
            for url in frame["url"]:
                done.append((url, *call(url)))
                rest(delay)
            yield pd.DataFrame(done, columns=["url", "body", "_error"])

    distinct = urls.select(F.col(url_col).alias("url")).filter("url IS NOT NULL").distinct().repartition(partitions, "url")
    return distinct.mapInPandas(run, "url string, body string, _error string")


def fetch_forms(
    ids: DataFrame, id_col: str, session: Callable[[], Session], page_url: str, form_url: str, parameter: str, headers: dict[str, str] | None = None, policy: RetryPolicy = DETAIL_PAGES, delay: float | tuple[float, float] = 0.0, partitions: int = 8
) -> DataFrame:
    """(id, page, body, _error): for each distinct id a session opens its page, then posts the form with that page as referrer."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            done = []
            for i in frame["id"]:
                mine = session()
                url = f"{page_url}?{urllib.parse.urlencode({parameter: i})}"
                page, error = with_retries(mine.get, policy)(url)
                body = None
                if error is None:
                    body, error = with_retries(mine.post, policy)(form_url, {parameter: i}, {"Referer": url, "X-Requested-With": "XMLHttpRequest", **(headers or {})})
                done.append((i, page, body, error))
                rest(delay)
            yield pd.DataFrame(done, columns=["id", "page", "body", "_error"])

    distinct = ids.select(F.col(id_col).cast("string").alias("id")).filter("id IS NOT NULL").distinct().repartition(partitions, "id")
    return distinct.mapInPandas(run, "id string, page string, body string, _error string")


def listing_page(base: str, page: int, fetch: Callable[[str], str], accept: Callable[[str], bool], parameters: tuple[str, ...] = PAGE_PARAMETERS) -> str:
    """A listing's page under the first parameter name whose answer is accepted, else the listing as it is."""
    for name in parameters:
        try:
            body = fetch(f"{base}{'&' if '?' in base else '?'}{name}={page}")
        except Exception:  # noqa: BLE001, S112  the next name may work
            continue
        if accept(body):
            return body
    return fetch(base)


def fetch_listings(bases: DataFrame, url_col: str, fetch: Callable[[str], str], accept: Callable[[str], bool], policy: RetryPolicy = MEMBER_PAGES, delay: float | tuple[float, float] = 0.0, partitions: int = 8) -> DataFrame:
    """(url, page, body, _error): every page of each distinct listing, as many as its first page's pager says."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        call = with_retries(lambda base, page: listing_page(base, page, fetch, accept), policy)
        for frame in frames:
            for base in frame["url"]:
                body, error = call(base, 1)
                done = [(base, 1, body, error)]
                for page in range(2, (page_count(body) if body else 1) + 1):
                    rest(delay)
                    done.append((base, page, *call(base, page)))
                yield pd.DataFrame(done, columns=["url", "page", "body", "_error"])

    distinct = bases.select(F.col(url_col).alias("url")).filter("url IS NOT NULL").distinct().repartition(partitions, "url")
    return distinct.mapInPandas(run, "url string, page long, body string, _error string")


def fetch_missing(urls: DataFrame, url_col: str, cache: DataFrame, now: Column, ttl_hours: float = 24.0) -> tuple[DataFrame, DataFrame]:
    """URLs to fetch, and the cache rows (url, body, fetched_at) that are fresh enough to use."""
    fresh = cache.filter(F.unix_timestamp("fetched_at") > F.unix_timestamp(now) - F.lit(ttl_hours * 3600))
    wanted = urls.select(F.col(url_col).alias("url")).distinct()
    return wanted.join(fresh.select("url"), "url", "left_anti"), wanted.join(fresh, "url")


def fetch_cached(urls: DataFrame, url_col: str, fetch: Callable[[str], str], cache_path: str, now: Column, ttl_hours: float = 24.0, use_cache: bool = True, **options) -> DataFrame:
    """(url, body, _error) of every distinct URL; bodies that are fresh enough come from the cache table, which takes up the new ones.

    Expired rows leave the cache.  Without ``use_cache`` everything is fetched and nothing is kept.
    """
    if not use_cache:
        return fetch_pages(urls, url_col, fetch, **options)
    spark = urls.sparkSession
    try:
        cache = spark.read.parquet(cache_path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        cache = spark.createDataFrame([], "url string, body string, fetched_at timestamp")
    missing, _ = fetch_missing(urls, url_col, cache, now, ttl_hours)
    got = scratch_table(fetch_pages(missing, "url", fetch, **options))
    kept = cache.filter(F.unix_timestamp("fetched_at") > F.unix_timestamp(now) - F.lit(ttl_hours * 3600))
    fresh = got.filter("_error IS NULL").select("url", "body", now.cast("timestamp").alias("fetched_at"))
    write_parquet(kept.unionByName(fresh), cache_path)
    wanted = urls.select(F.col(url_col).alias("url")).filter("url IS NOT NULL").distinct()
    hits = wanted.join(spark.read.parquet(cache_path).select("url", "body"), "url").withColumn("_error", F.lit(None).cast("string"))
    return hits.unionByName(got.filter("_error IS NOT NULL"))


def page_fanout(first_pages: DataFrame, url_col: str, html_col: str, parameter: str = "page") -> DataFrame:
    """(url, page, page_url) of every page of a listing."""
    opened = first_pages.select(F.col(url_col).alias("url"), F.explode(F.sequence(F.lit(1).cast("long"), total_pages(F.col(html_col)))).alias("page"))
    return opened.withColumn("page_url", F.concat("url", F.when(F.contains("url", F.lit("?")), "&").otherwise("?"), F.lit(f"{parameter}="), F.col("page").cast("string")))
