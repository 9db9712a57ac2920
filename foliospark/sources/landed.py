"""Responses of per-record services, fetched by tasks or landed before: (key, status, body) tables.

Everything downstream works on these tables, so the network is needed for acquisition only.
"""

from __future__ import annotations

import http.client
import random
import threading
import time
import urllib.parse
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foliospark.session import ship_package
from foliospark.sources.files import file_name

#: Texts by which the BioC service says that it has nothing.
NO_RECORD = ("No record can be found", "No result can be found")
RESPONSE = "key string, status int, body string, error string"


def read_landed(spark: SparkSession, path: str) -> DataFrame:
    """(key, status, body) of a folder of files named <key>.<suffix>."""
    files = spark.read.text(path, wholetext=True).select(file_name().alias("name"), F.col("value").alias("body"))
    return files.select(F.regexp_replace("name", r"\.[^.]*$", "").alias("key"), F.lit(200).alias("status"), "body", F.lit(None).cast("string").alias("error"))


class Pace:
    """A token bucket that holds one token: a request takes it, and base + up to jitter seconds later the next one is there."""

    def __init__(self, base: float, jitter: float):
        self.base, self.jitter, self.next, self.lock = base, jitter, 0.0, threading.Lock()

    def wait(self) -> None:
        if not self.base and not self.jitter:
            return
        with self.lock:
            begin = max(time.monotonic(), self.next)
            self.next = begin + self.base + random.uniform(0, self.jitter)
        time.sleep(max(0.0, begin - time.monotonic()))


class Pool:
    """Connections that are kept and taken again, as many as requests are under way at once."""

    def __init__(self, timeout: float, agent: str):
        self.timeout, self.agent, self.idle, self.lock = timeout, agent, {}, threading.Lock()

    def get(self, url: str) -> tuple[int, str]:
        """(status, body). A kept connection that the service has closed meanwhile is replaced once."""
        parts = urllib.parse.urlsplit(url)
        place = (parts.scheme, parts.netloc)
        with self.lock:
            kept = self.idle.setdefault(place, [])
            connection, fresh = (kept.pop(), False) if kept else (self._open(*place), True)
        try:
            found = self._ask(connection, parts)
        except (http.client.HTTPException, ConnectionError):
            connection.close()
            if fresh:
                raise
            connection = self._open(*place)
            found = self._ask(connection, parts)
        except OSError:
            connection.close()
            raise
        with self.lock:
            self.idle[place].append(connection)
        return found

    def _open(self, scheme: str, netloc: str) -> http.client.HTTPConnection:
        return (http.client.HTTPSConnection if scheme == "https" else http.client.HTTPConnection)(netloc, timeout=self.timeout)

    def _ask(self, connection: http.client.HTTPConnection, parts: urllib.parse.SplitResult) -> tuple[int, str]:
        connection.request("GET", urllib.parse.urlunsplit(("", "", parts.path or "/", parts.query, "")), headers={"User-Agent": self.agent})
        r = connection.getresponse()
        return r.status, r.read().decode("utf-8", "replace")

    def close(self) -> None:
        for connections in self.idle.values():
            for c in connections:
                c.close()


def fetch(ids: DataFrame, column: str, template: str, timeout: float = 15.0, base: float = 0.0, jitter: float = 0.0, agent: str = "foliospark", at_once: int = 1) -> DataFrame:
    """Responses to GET template.format(id). A task keeps at most `at_once` connections and has that many requests under
    way, at one pace for all of them. 404 is a status; other failures are errors in their row, and the run goes on."""
    ship_package(ids.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pool, pace = Pool(timeout, agent), Pace(base, jitter)

        def one(key: str | None) -> tuple:
            pace.wait()
            try:
                status, body = pool.get(template.format(urllib.parse.quote(str(key), safe="")))
            except (OSError, http.client.HTTPException) as e:
                return key, None, None, f"{type(e).__name__}: {e}"
            return (key, status, body, None) if status < 400 else (key, status, None, None if status == 404 else f"HTTP {status}")

        try:
            with ThreadPoolExecutor(at_once) as workers:
                for pdf in batches:
                    yield pd.DataFrame(list(workers.map(one, pdf["key"])), columns=["key", "status", "body", "error"]).astype({"status": "Int32"})
        finally:
            pool.close()

    return ids.select(F.col(column).cast("string").alias("key")).mapInPandas(run, RESPONSE)


def outcome(status: Column, error: Column) -> Column:
    """ok, not_found or error."""
    return F.when(error.isNotNull() | status.isNull(), "error").when(status == 404, "not_found").when(status == 200, "ok").otherwise("error")


def with_record(responses: DataFrame) -> DataFrame:
    """Responses whose body is a record."""
    none = F.lit(False)
    for text in NO_RECORD:
        none = none | F.contains("body", F.lit(text))
    return responses.where((F.col("status") == 200) & ~none & ~F.startswith("body", F.lit("[Error]")))
