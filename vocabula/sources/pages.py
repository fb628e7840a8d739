"""Pages of external databases as a Spark data source: one partition per database, cursor paging within it.

    spark.dataSource.register(PagesSource)
    spark.read.format("pages").option("databases", "a,b").option("base", "https://...").option("token", "...").load()

A base that is a folder replays recorded answers: <folder>/<database>/<page number>.json. Filters on edit time are applied in the reader.
"""

from __future__ import annotations

import json
import os
import random
import re
import time
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "database_id string, id string, url string, created_time string, last_edited_time string, archived boolean, properties string"
PAGE_SIZE = 100
RETRIES, FIRST_DELAY, MOST_DELAY = 3, 1.0, 30.0
_RETRYABLE = {429, 500, 502, 503, 504}


def retry_delay(attempt: int, retry_after: str | None = None, jitter: Callable[[], float] = random.random) -> float:
    """Seconds before the next attempt: what the server asks for, else doubling with up to 30 % more, at most MOST_DELAY."""
    if retry_after and re.fullmatch(r"\d+(\.\d+)?", retry_after):
        return min(float(retry_after), MOST_DELAY)
    return min(FIRST_DELAY * 2**attempt * (1 + 0.3 * jitter()), MOST_DELAY)


def with_retries(call: Callable[[], dict], sleep: Callable[[float], None] = time.sleep) -> dict:
    for attempt in range(RETRIES + 1):
        try:
            return call()
        except urllib.error.HTTPError as e:
            if e.code not in _RETRYABLE or attempt == RETRIES:
                raise
            sleep(retry_delay(attempt, e.headers.get("Retry-After") if e.headers else None))
        except (urllib.error.URLError, TimeoutError):
            if attempt == RETRIES:
                raise
            sleep(retry_delay(attempt))
    raise AssertionError


def normalize_id(text: str) -> str:
    """A 32-digit hexadecimal id as UUID; other forms are an error."""
    bare = text.replace("-", "").strip().lower()
    if not re.fullmatch(r"[0-9a-f]{32}", bare):
        raise ValueError(f"not a database id: {text!r}")
    return "-".join((bare[:8], bare[8:12], bare[12:16], bare[16:20], bare[20:]))


class _Database(InputPartition):
    def __init__(self, database: str):
        self.database = database


class PagesReader(DataSourceReader):
    def __init__(self, options: dict):
        self.base = options["base"]
        self.token = options.get("token", "")
        self.since = options.get("modifiedafter", "")
        self.most = int(options.get("maxitems", "0"))
        self.archived = options.get("archived", "false") == "true"
        self.names = [x.strip() for x in options["databases"].split(",") if x.strip()]
        self.page = min(int(options.get("pagesize", str(PAGE_SIZE))), PAGE_SIZE)

    def partitions(self) -> list[InputPartition]:
        return [_Database(x) for x in self.names]

    def _answer(self, database: str, cursor: str | None, number: int) -> dict:
        if os.path.isdir(self.base):
            with open(os.path.join(self.base, database, f"{number}.json"), encoding="utf-8") as f:
                return json.load(f)
        body = {"page_size": self.page} | ({"start_cursor": cursor} if cursor else {})
        request = urllib.request.Request(
            f"{self.base}/databases/{normalize_id(database)}/query", json.dumps(body).encode(), {"Authorization": f"Bearer {self.token}", "Content-Type": "application/json"}
        )

        def call() -> dict:
            with urllib.request.urlopen(request, timeout=30) as r:
                return json.load(r)

        return with_retries(call)

    def read(self, partition: _Database) -> Iterator[tuple]:
        cursor, number, given = None, 0, 0
        while True:
            answer = self._answer(partition.database, cursor, number)
            for p in answer.get("results", []):
                if (p.get("archived") and not self.archived) or (self.since and p.get("last_edited_time", "") < self.since):
                    continue
                if self.most and given == self.most:
                    return
                given += 1
                yield (partition.database, p.get("id"), p.get("url"), p.get("created_time"), p.get("last_edited_time"), bool(p.get("archived")), json.dumps(p.get("properties") or {}, ensure_ascii=False))
            cursor, number = answer.get("next_cursor"), number + 1
            if not answer.get("has_more") or not cursor:
                return


class PagesSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "pages"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> PagesReader:
        return PagesReader({k.lower(): v for k, v in self.options.items()})
