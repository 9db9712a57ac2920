"""A paged search as a Spark data source, for batch and streaming.

Pages come from a folder of landed responses (page-0000.json, ...: {hitCount, nextCursorMark,
resultList: {result: [...]}}) or, with option url, from a search service. Landed pages are read by Spark
itself, in parallel and from any store it knows. Of a service the driver walks the chain of cursors by light
responses (identifiers only) and plans a task a page, in batch and stream alike; tasks fetch the whole pages.
Conditions on the fields that the service can search go to it with the query. Errors surface; a cap is strict.
"""

from __future__ import annotations

import json
import random
import time
import urllib.parse
import urllib.request
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, In, InputPartition

from foliospark.operators.articles import RESULT
from foliospark.session import ship_package

PAGE_ROWS = 1000
FIRST = "*"
#: Fields of a result that the service can search, by its names.
SEARCHED = {"source": "SRC", "license": "LICENSE", "language": "LANG", "pubYear": "PUB_YEAR", "isOpenAccess": "OPEN_ACCESS", "inEPMC": "HAS_FT"}
FIELDS = tuple(SEARCHED)


class Client:
    """Fetches a page by cursor; one per task, and one for the chain in the driver."""

    def __init__(self, options: dict[str, str]):
        self.options = options

    def page(self, cursor: str, light: bool = False) -> dict:
        o = self.options
        query = {"query": o["query"], "format": "json", "resultType": "idlist" if light else "core", "pageSize": o.get("pagesize", str(PAGE_ROWS)), "cursorMark": cursor}
        if o.get("synonym"):
            query["synonym"] = o["synonym"]
        request = urllib.request.Request(f"{o['url']}?{urllib.parse.urlencode(query)}", headers={"User-Agent": o.get("useragent", "foliospark")})
        with urllib.request.urlopen(request, timeout=float(o.get("timeout", "45"))) as r:
            return json.load(r)

    def pause(self) -> None:
        base, jitter = float(self.options.get("sleepbase", "0")), float(self.options.get("sleepjitter", "0"))
        if base or jitter:
            time.sleep(base + random.uniform(0, jitter))

    def chain(self, cursor: str = FIRST) -> Iterator[tuple[str, int, str]]:
        """(cursor, records, next cursor) of pages up to an empty one or the last cursor; "" is no cursor."""
        while cursor:
            page = self.page(cursor, light=True)
            n = len(page.get("resultList", {}).get("result", []))
            if not n:
                return
            following = page.get("nextCursorMark") or ""
            following = "" if following == cursor else following
            yield cursor, n, following
            cursor = following
            self.pause()


@dataclass
class _Page(InputPartition):
    """A page by its cursor, the number of its first record, and how many records it had when it was planned."""

    cursor: str
    start: int
    n: int

    def __init__(self, cursor: str, start: int, n: int):
        self.cursor, self.start, self.n = cursor, start, n


def _rows(options: dict[str, str], page: _Page) -> Iterator[tuple]:
    client = Client(options)
    results = client.page(page.cursor).get("resultList", {}).get("result", [])
    if len(results) < page.n:
        raise ValueError(f"the page at {page.cursor!r} has {len(results)} records, {page.n} were announced")
    for i, r in enumerate(results[: page.n]):
        yield (page.start + i, *[None if r.get(f) is None else str(r[f]) for f in FIELDS], json.dumps(r, ensure_ascii=False))
    client.pause()


def narrowing(column: str, values: Iterable) -> str | None:
    """A condition that a field has one of some values, in the service's language; None if that can't say it."""
    texts = list(values)
    if column not in SEARCHED or not texts or not all(isinstance(v, str) and v.strip() and '"' not in v for v in texts):
        return None
    return "(" + " OR ".join(f'{SEARCHED[column]}:"{v}"' for v in texts) + ")"


class _Reader(DataSourceReader):
    def __init__(self, options):
        self.options = dict(options)

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Narrows the search by what the service can tell. All filters stay with Spark too, as the service compares
        without regard to case."""
        for f in filters:
            said = None
            if isinstance(f, (EqualTo, In)) and len(f.attribute) == 1:
                said = narrowing(f.attribute[0], f.value if isinstance(f, In) else [f.value])
            if said:
                self.options["query"] = f"({self.options['query']}) AND {said}"
            yield f

    def partitions(self):
        most, start, out = int(self.options.get("maxrecords", "0")), 0, []
        for cursor, n, _ in Client(self.options).chain():
            out.append(_Page(cursor, start, min(n, most - start) if most else n))
            start += n
            if most and start >= most:
                break
        return out or [_Page("", 0, 0)]

    def read(self, partition):
        return _rows(self.options, partition) if partition.n else iter(())


class _Stream(DataSourceStreamReader):
    """The offset is the next page's cursor and the number of records before it. The driver follows the light chain
    and plans; a task reads a page. After a restart the chain is walked anew, and only pages behind the checkpoint are fetched."""

    def __init__(self, options):
        self.options = dict(options)
        self.at = self.initialOffset()
        self.known: list[tuple[int, str, int]] = []  # number of the first record, cursor, records

    def initialOffset(self):
        return {"cursor": FIRST, "n": 0}

    def latestOffset(self):
        for cursor, n, following in Client(self.options).chain(self.at["cursor"]):
            self.known.append((self.at["n"], cursor, n))
            self.at = {"cursor": following, "n": self.at["n"] + n}
        return self.at

    def partitions(self, start, end):
        planned = [k for k in self.known if start["n"] <= k[0] < end["n"]]
        if end["n"] > start["n"] and (not planned or planned[0][:2] != (start["n"], start["cursor"])):
            # after a restart: what is behind the checkpoint is dealt in pages from there on
            planned, at = [], start["n"]
            for cursor, n, _ in Client(self.options).chain(start["cursor"]):
                planned.append((at, cursor, n))
                at += n
                if at >= end["n"]:
                    break
        return [_Page(cursor, first, min(n, end["n"] - first)) for first, cursor, n in planned]

    def read(self, partition):
        return _rows(self.options, partition)

    def commit(self, end):
        self.known = [k for k in self.known if k[0] >= end["n"]]


class PagedSearch(DataSource):
    @classmethod
    def name(cls):
        return "paged_search"

    def schema(self):
        return f"ord bigint, {', '.join(f'{f} string' for f in FIELDS)}, result string"

    def reader(self, schema):
        return _Reader(self.options)

    def streamReader(self, schema):
        return _Stream(self.options)


def parsed(raw: DataFrame) -> DataFrame:
    """ord and the fields of each result."""
    parts = raw.select("*", F.from_json("result", RESULT).alias("__r"))
    names = [c.name for c in parts.schema["__r"].dataType]
    return parts.select("ord", *[F.col(c) if c in raw.columns else F.col("__r")[c].alias(c) for c in names])


def _service(spark: SparkSession, options: dict) -> dict[str, str]:
    ship_package(spark)
    spark.dataSource.register(PagedSearch)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return {k: str(v) for k, v in options.items()}


def read_search(spark: SparkSession, **options) -> DataFrame:
    """Results of a search: path= or url= and query=, maxrecords=, synonym=, sleepbase=, sleepjitter=."""
    if "path" in options and "url" not in options:
        return parsed(landed_results(spark, options["path"], int(options.get("maxrecords", 0))))
    return parsed(spark.read.format("paged_search").options(**_service(spark, options)).load())


def landed_results(spark: SparkSession, path: str, most: int = 0) -> DataFrame:
    """(ord, result) of landed pages, in order of their names up to the first one without results, at most
    `most` if that isn't 0. A page that is no JSON is an error."""
    page = F.from_json("value", "hitCount long, nextCursorMark string, resultList struct<result:array<string>>", {"mode": "FAILFAST"})
    files = spark.read.text(f"{path.rstrip('/')}/*.json", wholetext=True)
    pages = files.select(F.col("_metadata.file_name").alias("file"), page["resultList"]["result"].alias("results"))
    sizes = pages.select("file", F.greatest(F.coalesce(F.size("results"), F.lit(0)), F.lit(0)).alias("n"))
    order = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, Window.currentRow)  # a row a page, not a record
    starts = sizes.select("file", (F.sum("n").over(order) - F.col("n")).alias("start"), F.max((F.col("n") == 0).cast("int")).over(order).alias("over"))
    rows = pages.join(starts.where("over = 0"), "file").select("start", F.posexplode("results").alias("pos", "result"))
    out = rows.select((F.col("start") + F.col("pos")).cast("long").alias("ord"), "result")
    return out.where(F.col("ord") < most) if most > 0 else out


def stream_landed(spark: SparkSession, path: str, pages_a_batch: int = 100) -> DataFrame:
    """(ord, result) of landed pages as they arrive, by Spark's own file stream. Numbers of records follow the number in a
    page's name, so they rise in the order of pages, with gaps behind pages that aren't full."""
    page = F.from_json("value", "resultList struct<result:array<string>>", {"mode": "FAILFAST"})
    files = spark.readStream.schema("value string").option("wholetext", True).option("maxFilesPerTrigger", pages_a_batch).option("pathGlobFilter", "*.json").text(path)
    number = F.regexp_extract(F.col("_metadata.file_name"), r"(\d+)\D*$", 1).cast("long")
    rows = files.select(number.alias("page"), F.posexplode(page["resultList"]["result"]).alias("pos", "result"))
    return rows.select((F.col("page") * PAGE_ROWS + F.col("pos")).cast("long").alias("ord"), "result")


def stream_search(spark: SparkSession, **options) -> DataFrame:
    """As read_search, as a stream: the pages of path= (pages_a_batch=), or of url= and query=."""
    if "path" in options and "url" not in options:
        return parsed(stream_landed(spark, options["path"], int(options.get("pages_a_batch", 100))))
    return parsed(spark.readStream.format("paged_search").options(**_service(spark, options)).load())


def hit_count(**options) -> int:
    """What the service says it has."""
    return int(Client({k: str(v) for k, v in options.items()} | {"pagesize": "1"}).page(FIRST).get("hitCount", 0))


def landed_hit_count(spark: SparkSession, path: str) -> int:
    """What the first of landed pages says there is; 0 without pages."""
    count = F.from_json("value", "hitCount long")["hitCount"]
    files = spark.read.text(f"{path.rstrip('/')}/*.json", wholetext=True)
    return files.agg(F.min_by(count, F.col("_metadata.file_name"))).first()[0] or 0
