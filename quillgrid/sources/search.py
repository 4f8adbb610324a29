"""Repository search as a Spark data source: a paged JSON service, a partition for each page.

    spark.dataSource.register(SearchSource)
    spark.read.format("repo_search").option("path", "https://…/search/repositories").option("queries", '["topic:ai"]').load()

A page is asked for with q, per_page, page, sort and order; its answer is an object with total_count and items. Rate limits (403, 429) are waited for, as long as the
service says but no longer than maxWait, `attempts` times in all; then, and for other refusals, the page has no rows (mode PERMISSIVE) or the read fails (FAILFAST). Answers that
don't come or can't be read fail the task, which Spark tries again.

Filters: those on query and page choose what is asked for and are Spark's no more. Equality on language, archived and fork and bounds on stars and pushed_at are put into q as the
service's qualifiers, so that less comes back; Spark still applies them, too.

Pages (option `pages`): a number for each query, or "all", for which each query's first page is asked for its total count while the read is planned (at most MOST_RESULTS results are served).

Beside http and https, path may be a folder of answers as files in any store that Arrow reads: <folder>/<key of q>/<page>.json, with `answer_key` for the key, and {"status": …, "headers": {…}, "body": {…}} or the body alone in it.
"""

from __future__ import annotations

import hashlib
import json
import time
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, LessThan, LessThanOrEqual

from quillgrid.session import ship

FIELDS = "query string, page int, position int, full_name string, language string, stars long, archived boolean, fork boolean, pushed_at string, item string"
MOST_RESULTS = 1000
#: Filters that become qualifiers of q: the service's name for the column, and the sign before the value.
QUALIFIERS = {"language": "language", "stars": "stars", "archived": "archived", "fork": "fork", "pushed_at": "pushed"}
SIGNS = {EqualTo: "", GreaterThan: ">", GreaterThanOrEqual: ">=", LessThan: "<", LessThanOrEqual: "<="}


class SearchError(Exception):
    """An answer that isn't a page of results."""


def answer_key(q: str) -> str:
    """The folder of a query's answers."""
    return hashlib.sha256(q.encode()).hexdigest()[:16]


def ask(path: str, query: str, params: dict, token: str | None, seconds: float) -> tuple[int, dict, str]:
    """Status, headers and body of an answer. Files are by query; qualifiers that params["q"] has beside it are left to Spark there."""
    if path.startswith(("http://", "https://")):
        headers = {"Accept": "application/vnd.github.v3+json"} | ({"Authorization": f"Bearer {token}"} if token else {})
        request = urllib.request.Request(f"{path}?{urllib.parse.urlencode(params)}", headers=headers)
        try:
            with urllib.request.urlopen(request, timeout=seconds) as got:
                return got.status, dict(got.headers), got.read().decode()
        except urllib.error.HTTPError as e:
            return e.code, dict(e.headers), e.read().decode(errors="replace")
    from pyarrow import fs

    store, folder = fs.FileSystem.from_uri(path)
    try:
        with store.open_input_file(f"{folder}/{answer_key(query)}/{params['page']}.json") as f:
            body = f.read().decode()
    except FileNotFoundError:
        return 404, {}, ""
    told = json.loads(body)
    return (told["status"], told.get("headers", {}), json.dumps(told.get("body"))) if "status" in told else (200, {}, body)


@dataclass
class Settings:
    path: str
    queries: list[str]
    per_page: int = 30
    pages: str = "1"
    attempts: int = 3
    least_wait: float = 10
    most_wait: float = 60
    seconds: float = 30
    strict: bool = False
    token: str | None = None

    def page(self, query: str, qualifiers: list[str], page: int) -> dict:
        """A page's answer; without items where the service refuses or never stops limiting."""
        q = " ".join([query, *sorted(qualifiers)])
        params = {"q": q, "per_page": self.per_page, "page": page, "sort": "updated", "order": "desc"}
        why = ""
        for attempt in range(self.attempts):
            status, headers, body = ask(self.path, query, params, self.token, self.seconds)
            if status == 200:
                told = json.loads(body)
                if not isinstance(told, dict):
                    raise SearchError(f"page {page} of {q!r} is no object")
                return told
            why = f"{status}: {body[:200]}"
            if status not in (403, 429):
                break
            if attempt + 1 < self.attempts:
                reset = next((v for k, v in headers.items() if k.lower() == "x-ratelimit-reset"), 0)
                time.sleep(min(max(float(reset) - time.time(), self.least_wait), self.most_wait))
        if self.strict:
            raise SearchError(f"page {page} of {q!r}: {why}")
        return {"items": [], "total_count": 0}

    def pages_of(self, query: str, qualifiers: list[str]) -> int:
        if self.pages != "all":
            return int(self.pages)
        total = min(int(self.page(query, qualifiers, 1).get("total_count") or 0), MOST_RESULTS)
        return max(1, -(-total // self.per_page))


class SearchPage(InputPartition):
    def __init__(self, query: str, page: int):
        self.query, self.page = query, page


class SearchReader(DataSourceReader):
    def __init__(self, settings: Settings):
        self.settings = settings
        self.only: set[str] | None = None
        self.first, self.last = 1, None
        self.qualifiers: list[str] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            column, value = getattr(f, "attribute", ()), getattr(f, "value", None)
            if column in (("query",), ("page",)) and isinstance(f, IsNotNull):
                continue
            if column == ("query",) and isinstance(f, EqualTo | In):
                wanted = {value} if isinstance(f, EqualTo) else set(value)
                self.only = wanted if self.only is None else self.only & wanted
            elif column == ("page",) and type(f) in SIGNS and isinstance(value, int):
                low = value + (type(f) is GreaterThan) if type(f) in (EqualTo, GreaterThan, GreaterThanOrEqual) else 1
                high = value - (type(f) is LessThan) if type(f) in (EqualTo, LessThan, LessThanOrEqual) else self.last
                self.first, self.last = max(self.first, low), high if self.last is None else min(self.last, high)
            else:
                if len(column) == 1 and column[0] in QUALIFIERS and type(f) in SIGNS and (type(f) is EqualTo or column[0] in ("stars", "pushed_at")):
                    said = str(value).lower() if isinstance(value, bool) else str(value)
                    self.qualifiers.append(f"{QUALIFIERS[column[0]]}:{SIGNS[type(f)]}{said}")
                yield f  # Spark's, too: a service may know a field only nearly

    def partitions(self) -> list[InputPartition]:
        queries = [q for q in dict.fromkeys(self.settings.queries) if self.only is None or q in self.only]
        found = []
        for q in queries:
            last = self.settings.pages_of(q, self.qualifiers)
            found += [SearchPage(q, p) for p in range(self.first, min(last, last if self.last is None else self.last) + 1)]
        return found

    def read(self, partition: SearchPage | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # what Spark gives for no pages at all
            return
        items = self.settings.page(partition.query, self.qualifiers, partition.page).get("items") or []
        field = lambda name: [i.get(name) if isinstance(i, dict) else None for i in items]
        n = len(items)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([partition.query] * n, pa.string()), pa.array([partition.page] * n, pa.int32()), pa.array(range(n), pa.int32()), pa.array(field("full_name"), pa.string()), pa.array(field("language"), pa.string()),
                pa.array(field("stargazers_count"), pa.int64()), pa.array(field("archived"), pa.bool_()), pa.array(field("fork"), pa.bool_()), pa.array(field("pushed_at"), pa.string()), pa.array([json.dumps(i, ensure_ascii=False) for i in items], pa.string()),
            ],
            [f.split(" ")[0] for f in FIELDS.split(", ")],
        )


class SearchSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "repo_search"

    def schema(self) -> str:
        return FIELDS

    def reader(self, schema) -> SearchReader:
        o = {k.lower(): v for k, v in self.options.items()}
        known = {"per_page": ("perpage", int), "pages": ("pages", str), "attempts": ("attempts", int), "least_wait": ("leastwait", float), "most_wait": ("maxwait", float), "seconds": ("timeout", float), "token": ("token", str)}
        given = {name: kind(o[key]) for name, (key, kind) in known.items() if key in o}
        return SearchReader(Settings(o["path"], json.loads(o["queries"]), strict=o.get("mode", "").upper() == "FAILFAST", **given))


def search(spark: SparkSession, path: str, queries: list[str], **options) -> DataFrame:
    """The pages of all queries. options: those of the source, as pages="all"."""
    ship(spark)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(SearchSource)
    return spark.read.format("repo_search").options(path=path, queries=json.dumps(queries), **options).load()


# Fixed value: an item's fields that discovery looks at.
ITEM = "struct<stargazers_count: int, size: int, created_at: string, topics: array<string>, license: struct<spdx_id: string>>"


def repositories(found: DataFrame) -> DataFrame:
    """repo, stars, license, language, archived, fork, size_kb, pushed_at, created_at and topics of the first hit of each repository, by query, page and position."""
    item: Column = F.from_json("item", ITEM)
    rows = found.filter("full_name IS NOT NULL").withColumn("i", item)
    # Everything but the name rides along in the least (query, page, position): tasks combine before any rows meet.
    hit = F.struct("query", "page", "position", F.struct("i", "language", "archived", "fork", "pushed_at").alias("r"))
    first = rows.groupBy("full_name").agg(F.min_by(hit["r"], F.struct("query", "page", "position")).alias("r"))
    return first.select(
        F.col("full_name").alias("repo"), F.coalesce("r.i.stargazers_count", F.lit(0)).alias("stars"), F.col("r.i.license.spdx_id").alias("license"), "r.language", F.coalesce("r.archived", F.lit(False)).alias("archived"), F.coalesce("r.fork", F.lit(False)).alias("fork"),
        F.col("r.i.size").alias("size_kb"), "r.pushed_at", F.col("r.i.created_at").alias("created_at"), F.coalesce("r.i.topics", F.array().cast("array<string>")).alias("topics"),
    )
