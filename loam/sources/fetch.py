"""Live pages as rows: fetching a frontier of addresses, host by host.

The rows of one host are fetched by one task, with a pause between them; hosts are spread over the tasks. Certificates are
always verified and an address is never tried again without encryption.
"""

from __future__ import annotations

import re
import time
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator
from urllib.parse import urlsplit

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loam.functions.urls import part

ATTEMPTS, TIMEOUT_S = 3, 60
AGENT = "Mozilla/5.0 (compatible; loam)"
_CHARSET = re.compile(rb"""<meta[^>]+charset=["']?([A-Za-z0-9_-]+)""", re.IGNORECASE)

Fetcher = Callable[[str], tuple[int, str, bytes]]


def over_http(url: str) -> tuple[int, str, bytes]:
    """(status, content type, body) of an address; http and https only."""
    if not url.startswith(("http://", "https://")):
        raise ValueError("not an http address")
    request = urllib.request.Request(url, headers={"User-Agent": AGENT})
    try:
        with urllib.request.urlopen(request, timeout=TIMEOUT_S) as answer:  # noqa: S310 - the scheme is checked
            return answer.status, answer.headers.get("Content-Type", ""), answer.read()
    except urllib.error.HTTPError as error:
        return error.code, error.headers.get("Content-Type", ""), error.read()


def decoded(body: bytes, content_type: str) -> str:
    """A body as text: by the header's character set, else the page's own, else UTF-8, else GB 18030.

    ISO 8859-1 in a header says nothing, as servers name it by default.
    """
    named = re.search(r"charset=([\w-]+)", content_type or "", re.IGNORECASE)
    own = _CHARSET.search(body[:2048])
    candidates = [named[1] if named and named[1].lower() != "iso-8859-1" else None, own[1].decode("ascii") if own else None, "utf-8", "gb18030"]
    for name in filter(None, candidates):
        try:
            return body.decode(name)
        except (UnicodeDecodeError, LookupError):
            continue
    return body.decode("utf-8", "replace")


def fetched_once(url: str, fetch: Fetcher, pause: Callable[[float], None]) -> tuple[int | None, str | None, bytes | None, str | None]:
    """An address with up to ATTEMPTS attempts: (status, content type, body, error). Errors of the client but 429 are final."""
    error = None
    for attempt in range(ATTEMPTS):
        try:
            status, kind, body = fetch(url)
            if status < 400:
                return status, kind, body, None
            error = f"HTTP {status}"
            if 400 <= status < 500 and status != 429:
                return status, kind, None, error
        except Exception as problem:  # noqa: BLE001 - a page that fails is a row with an error
            error = f"{type(problem).__name__}: {problem}"[:200]
        if attempt < ATTEMPTS - 1:
            pause(2.0 * (attempt + 1))
    return None, None, None, error


def fetched(frontier: DataFrame, delay: float = 1.0, fetch: Fetcher = over_http) -> DataFrame:
    """The pages of a frontier (url): url, status, content_type, body, text, error.

    Null addresses are left out; every other row comes out once, with an error where it could not be had. ``delay``
    seconds pass between two addresses of one host, which one task asks after another; other hosts of the task do not wait
    for it.
    """

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        asked: dict[str, float] = {}
        for batch in batches:
            out = []
            for url in batch["url"]:
                host = urlsplit(url).netloc
                if host in asked:
                    time.sleep(max(0.0, asked[host] + delay - time.monotonic()))
                asked[host] = time.monotonic()
                status, kind, body, error = fetched_once(url, fetch, time.sleep)
                out.append((url, status, kind, body, decoded(body, kind) if body is not None else None, error))
            frame = pd.DataFrame(out, columns=["url", "status", "content_type", "body", "text", "error"])
            yield frame.astype({"status": "Int32"})

    hosts = frontier.where("url is not null").select("url").repartition(part(F.col("url"), 2))
    return hosts.mapInPandas(rows, "url string, status int, content_type string, body binary, text string, error string")
