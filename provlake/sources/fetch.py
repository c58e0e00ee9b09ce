"""The fetch stage: lookups and downloads that no cache has, beside the plans and never inside them.

A fetcher is a function from an address to bytes. What it gives becomes a table of responses, which the caller appends to
the cache; plans read the cache. Each source's requests run in one task, so a source's pace holds for all of them.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from datetime import datetime, timezone

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from provlake.sources.loaders import cached

Fetcher = Callable[[str], bytes]
AGENT = "provlake/0.1"


class RateLimited(Exception):
    """A server's answer that it was asked too often, and after how many seconds to ask again."""

    def __init__(self, message: str, after: float | None = None):
        super().__init__(message)
        self.after = after


def http(url: str, timeout: float = 30) -> bytes:
    """The bytes at an address."""
    from urllib.error import HTTPError
    from urllib.request import Request, urlopen

    try:
        with urlopen(Request(url, headers={"User-Agent": AGENT}), timeout=timeout) as answer:
            return answer.read()
    except HTTPError as e:
        if e.code == 429:
            after = e.headers.get("Retry-After") if e.headers else None
            raise RateLimited(f"HTTPError: HTTP Error 429: {e.reason}", float(after) if after and after.isdigit() else None) from e
        raise


def now() -> str:
    return datetime.now(timezone.utc).replace(microsecond=0).isoformat()


RESPONSE = "source string, url string, status int, body string, body_sha256 string, fetched_at string, error string"


def fetch(requests: DataFrame, fetcher: Fetcher = http, cache: DataFrame | None = None, interval: float = 0, retry: int = 0, wait: float = 0, as_of: str | None = None) -> DataFrame:
    """Responses to requests (source, url): those of the cache, and what is fetched of the rest, with an error where that fails.

    Only an answer of too many requests is tried again, ``retry`` times, after ``wait`` seconds or what the answer says.
    """
    wanted = requests.select("source", "url").distinct()
    kept = None
    if cache is not None:
        kept = cached(cache, wanted).select("source", "url", "status", "body", "body_sha256", "fetched_at", F.lit(None).cast("string").alias("error"))
        wanted = wanted.join(cache.select("source", "url"), ["source", "url"], "left_anti")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        last: dict[str, float] = {}
        for b in batches:
            rows = []
            for source, url in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                body = error = None
                for attempt in range(retry + 1):
                    pause = interval - (time.monotonic() - last.get(source, -1e9))
                    if pause > 0:
                        time.sleep(pause)
                    try:
                        body = fetcher(url).decode("utf-8", errors="replace")
                        error = None
                        break
                    except RateLimited as e:
                        error = f"{e}" if "HTTP Error 429" in f"{e}" else f"HTTP Error 429: {e}"
                        if attempt < retry:
                            time.sleep(wait or e.after or interval or 1)
                    except Exception as e:  # told in the row
                        error = f"{type(e).__name__}: {e}"
                        break
                    finally:
                        last[source] = time.monotonic()
                sha = None if body is None else hashlib.sha256(body.encode()).hexdigest()
                rows.append((source, url, None if body is None else 200, body, sha, as_of or now(), error))
            kinds = (pa.string(), pa.string(), pa.int32(), *[pa.string()] * 4)
            names = ["source", "url", "status", "body", "body_sha256", "fetched_at", "error"]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True) if rows else [[]] * 7, kinds, strict=True)], names=names)

    new = wanted.repartition("source").sortWithinPartitions("source", "url").mapInArrow(run, RESPONSE)
    return new if kept is None else kept.unionByName(new)


DOWNLOAD = "citation_key string, url string, status string, bytes long, error string, payload binary"


def download(items: DataFrame, fetcher: Fetcher = http, there: DataFrame | None = None, overwrite: bool = False) -> DataFrame:
    """The bytes of a download plan's addresses: status downloaded, skipped_exists, missing_url or download_failed.

    items: citation_key, url, output; there: path of files that exist already.
    """
    rows = items.select("citation_key", "url", "output")
    if there is not None and not overwrite:
        rows = rows.join(there.select(F.col("path").alias("output"), F.lit(True).alias("_there")).distinct(), "output", "left")
    else:
        rows = rows.withColumn("_there", F.lit(None).cast("boolean"))
    rows = rows.select("citation_key", "url", F.when(F.col("url").isNull(), "missing_url").when(F.col("_there"), "skipped_exists").alias("status"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for key, url, status in zip(*(c.to_pylist() for c in b.columns), strict=True):
                payload = error = None
                if status is None:
                    try:
                        payload, status = fetcher(url), "downloaded"
                    except Exception as e:  # told in the row
                        status, error = "download_failed", f"{type(e).__name__}: {e}"
                row = (key, url, status, None if payload is None else len(payload), error, payload)
                kinds = (pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds, strict=True)], names=["citation_key", "url", "status", "bytes", "error", "payload"])

    return rows.mapInArrow(run, DOWNLOAD)


def download_issues(done: DataFrame) -> DataFrame:
    return done.where("status = 'download_failed'").select(F.lit("SOURCE_DOWNLOAD_FAILED").alias("code"), F.lit("blocking").alias("severity"), "citation_key", F.array("url", "error").alias("evidence"))
