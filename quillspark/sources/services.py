"""Readers of the search services as a Spark data source: paging, retries, rate limits, decoding, full texts.

A service is asked over HTTP, or its answers are played back from a recording (a
folder of JSON lines with url, status, headers and body), as tests and work
without a network need it.  Paging by cursor can't be split, so a search is read
by one task; lookups of many identifiers are split over partitions.
"""

from __future__ import annotations

import base64
import datetime as dt
import email.utils
import gzip
import json
import os
import random
import tempfile
import time
import urllib.error
import urllib.parse
import urllib.request
import xml.etree.ElementTree as ET
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions.markup import article_markdown

#: Fixed values of the clients: statuses asked again, how often, and the seconds waited.
RETRYABLE = (429, 500, 502, 503, 504)
RETRIES, BASE_WAIT, LONGEST_WAIT, JITTER = 7, 3.0, 180.0, 0.5
#: Letters of an error's body that are kept, and most items of a page by service.
ERROR_BODY, OPENALEX_PAGE, EPMC_PAGE = 500, 100, 1000
#: Where the services are.
OPENALEX = "https://api.openalex.org/"
EPMC = "https://www.ebi.ac.uk/europepmc/webservices/rest/"
ARXIV = "https://export.arxiv.org/api/query?"
CROSSREF = "https://api.crossref.org/"
#: Seconds between two requests.
GAPS = {"openalex": 0.1, "epmc": 1.0, "arxiv": 3.0, "crossref": 0.5}


class ServiceError(RuntimeError):
    """An answer that isn't one: its status (None for no answer) and the start of its body."""

    def __init__(self, message: str, status: int | None = None, body: bytes = b""):
        super().__init__(message)
        self.status, self.body = status, body[:ERROR_BODY].decode("utf-8", "replace")


@dataclass
class Answer:
    status: int
    headers: dict[str, str] = field(default_factory=dict)
    body: bytes = b""

    def header(self, name: str) -> str | None:
        return next((v for k, v in self.headers.items() if k.lower() == name), None)

    def bytes(self) -> bytes:
        packed = (self.header("content-encoding") or "").lower() == "gzip"
        return gzip.decompress(self.body) if packed else self.body

    def text(self) -> str:
        kind = self.header("content-type") or ""
        charset = next((p.split("=", 1)[1].strip("\"' ") for p in kind.split(";") if p.strip().lower().startswith("charset=")), "utf-8")
        return self.bytes().decode(charset, "replace")


def retry_after(value: str | None, now: dt.datetime | None = None) -> float | None:
    """Seconds that a Retry-After header asks to wait, given as a number or a date; NULL for neither."""
    if value is None:
        return None
    try:
        return float(value)
    except ValueError:
        pass
    try:
        at = email.utils.parsedate_to_datetime(value)
    except (TypeError, ValueError):
        return None
    at = at if at.tzinfo else at.replace(tzinfo=dt.UTC)
    return max(0.0, (at - (now or dt.datetime.now(dt.UTC))).total_seconds())


def wait_before(attempt: int, asked: float | None, noise: float = 0.0) -> float:
    """Seconds before the next attempt (from 0): doubling up to a bound, never less than asked for, plus noise."""
    return max(min(BASE_WAIT * 2**attempt, LONGEST_WAIT), asked or 0.0) + noise


class Limiter:
    """Lets the processes of one machine pass one by one with a gap between them, by a locked file that holds the last time."""

    def __init__(self, name: str, gap: float, folder: str | None = None):
        self.path, self.gap = os.path.join(folder or tempfile.gettempdir(), f"quill-gap-{name}"), gap

    def wait(self) -> None:
        if self.gap <= 0:
            return
        import fcntl

        with open(self.path, "a+") as held:
            fcntl.flock(held, fcntl.LOCK_EX)
            held.seek(0)
            last = held.read().strip()
            pause = float(last) + self.gap - time.monotonic() if last else 0.0
            # A time from before a restart of the machine lies ahead by more than the gap.
            if 0 < pause <= self.gap:
                time.sleep(pause)
            held.seek(0)
            held.truncate()
            held.write(str(time.monotonic()))


Opener = Callable[[str, float], Answer]


def live(url: str, timeout: float) -> Answer:
    """Ask over HTTP; statuses of errors are answers too."""
    request = urllib.request.Request(url, headers={"Accept-Encoding": "gzip", "User-Agent": "quillspark"})
    try:
        with urllib.request.urlopen(request, timeout=timeout) as r:
            return Answer(r.status, dict(r.headers), r.read())
    except urllib.error.HTTPError as e:
        with e:
            return Answer(e.code, dict(e.headers), e.read())


class Recording:
    """Answers of a folder or file of JSON lines; a URL that was asked several times is answered in that order, the last
    answer again and again.  Only the places of the answers are held in memory."""

    def __init__(self, path: str):
        from pyarrow import fs

        self.fs, base = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)
        kind = self.fs.get_file_info(base)
        files = [kind.path] if kind.is_file else sorted(f.path for f in self.fs.get_file_info(fs.FileSelector(base)) if f.is_file and not os.path.basename(f.path).startswith(("_", ".")))
        self.places: dict[str, list[tuple[str, int, int]]] = {}
        self.asked: dict[str, int] = {}
        for name in files:
            at = 0
            with self.fs.open_input_stream(name) as stream:
                for line in stream.read().split(b"\n") if not name.endswith(".gz") else []:
                    if line.strip():
                        self.places.setdefault(json.loads(line)["url"], []).append((name, at, len(line)))
                    at += len(line) + 1

    def __call__(self, url: str, timeout: float) -> Answer:
        places = self.places.get(url)
        if not places:
            return Answer(404, {}, b"not recorded")
        n = self.asked[url] = self.asked.get(url, -1) + 1
        name, at, size = places[min(n, len(places) - 1)]
        with self.fs.open_input_file(name) as held:
            held.seek(at)
            x = json.loads(held.read(size))
        body = base64.b64decode(x["body64"]) if x.get("body64") else (x.get("body") or "").encode()
        return Answer(int(x.get("status") or 200), x.get("headers") or {}, body)


class Client:
    """Asks one host, again where that may help."""

    def __init__(self, base: str, opener: Opener = live, limiter: Limiter | None = None, retries: int = RETRIES, sleep: Callable[[float], None] = time.sleep, timeout: float = 30.0):
        self.base, self.opener, self.limiter, self.retries, self.sleep, self.timeout = base, opener, limiter, retries, sleep, timeout

    def resolve(self, url: str) -> str:
        """A URL below the base; one of another host or kind raises."""
        whole = url if "://" in url else self.base + url
        a, b = urllib.parse.urlsplit(self.base), urllib.parse.urlsplit(whole)
        if b.scheme not in ("http", "https") or (a.scheme, a.netloc) != (b.scheme, b.netloc):
            raise ServiceError(f"{whole} is not below {self.base}")
        return whole

    def get(self, url: str) -> Answer:
        whole = self.resolve(url)
        for attempt in range(self.retries + 1):
            if self.limiter:
                self.limiter.wait()
            asked = None
            try:
                answer = self.opener(whole, self.timeout)
                if answer.status < 400:
                    return answer
                error = ServiceError(f"status {answer.status} of {whole}", answer.status, answer.body)
                asked = retry_after(answer.header("retry-after"))
            except OSError as e:
                error = ServiceError(f"no answer from {whole}: {e}")
            if attempt == self.retries or error.status is not None and error.status not in RETRYABLE:
                raise error
            self.sleep(wait_before(attempt, asked, random.uniform(0, JITTER)))
        raise AssertionError("unreachable")

    def json(self, url: str) -> dict:
        return json.loads(self.get(url).text())


def openalex_url(entity: str, search=None, filter=None, group_by=None, sample=None, seed=None, select=None, sort=None, page: int = 1, per_page: int = 25) -> str:
    """Request of an entity's works: no sorting of samples, no paging of samples and groups, at most 100 on a page."""
    params = {k: v for k, v in (("search", search), ("filter", filter), ("group_by", group_by), ("sample", sample), ("seed", seed), ("select", select)) if v is not None}
    if sort is not None and sample is None:
        params["sort"] = sort
    if group_by is None and sample is None:
        params |= {"per_page": max(1, min(OPENALEX_PAGE, int(per_page))), "page": int(page)}
    return f"{entity}?{urllib.parse.urlencode(params)}"


def epmc_url(query: str, size: int, cursor: str = "*", kind: str = "core", sort: str | None = None) -> str:
    """Request of a search, open access unless the query says something on that."""
    query = query if "OPEN_ACCESS:" in query.upper() else f"({query}) AND OPEN_ACCESS:y"
    params = {"query": query, "format": "json", "resultType": kind, "pageSize": min(size, EPMC_PAGE), "cursorMark": cursor} | ({"sort": sort} if sort else {})
    return f"search?{urllib.parse.urlencode(params)}"


def epmc_list_url(source: str, article: str, kind: str, page: int = 1, size: int = 25) -> str:
    return f"{source}/{article}/{kind}?{urllib.parse.urlencode({'page': page, 'pageSize': min(size, EPMC_PAGE), 'format': 'json'})}"


def arxiv_url(query=None, ids=None, start: int = 0, most: int = 10, sort_by=None, order=None) -> str:
    params = {"start": start, "max_results": most} | {k: v for k, v in (("search_query", query), ("id_list", ids), ("sortBy", sort_by), ("sortOrder", order)) if v}
    return urllib.parse.urlencode(params)


def openalex_items(client: Client, most: int | None = None, **asked) -> Iterator[dict]:
    """Items of all pages, or of groups or a sample at once, up to ``most``."""
    page, seen = int(asked.pop("page", 1)), 0
    paged = asked.get("sample") is None and asked.get("group_by") is None
    while True:
        answer = client.json(openalex_url(page=page, **asked))
        items = answer.get("group_by" if asked.get("group_by") is not None else "results") or []
        for item in items:
            if most is not None and seen >= most:
                return
            seen += 1
            yield item
        total = (answer.get("meta") or {}).get("count")
        if not paged or not items or (total is not None and seen >= total):
            return
        page += 1


def epmc_items(client: Client, query: str, most: int, **asked) -> Iterator[dict]:
    """Results of a search page by page, until the cursor stays or ``most`` were given."""
    cursor, seen = "*", 0
    while seen < most:
        answer = client.json(epmc_url(query, most, cursor, **asked))
        for item in (answer.get("resultList") or {}).get("result") or []:
            if seen >= most:
                return
            seen += 1
            yield item
        following = answer.get("nextCursorMark") or ""
        if following in ("", cursor):
            return
        cursor = following


def epmc_linked(client: Client, source: str, article: str, kind: str, size: int = 25) -> Iterator[dict]:
    """Citations or references of an article, page by page."""
    page, seen = 1, 0
    while True:
        answer = client.json(epmc_list_url(source, article, kind, page, size))
        items = (answer.get(f"{kind[:-1]}List") or {}).get(kind[:-1]) or []
        yield from items
        seen += len(items)
        if not items or seen >= int(answer.get("hitCount") or 0):
            return
        page += 1


_ATOM = "{http://www.w3.org/2005/Atom}"


def atom_items(feed: bytes) -> Iterator[dict]:
    """Entries of a feed: white space collapsed, ids without what stands before '/abs/'."""
    for entry in ET.fromstring(feed).iter(f"{_ATOM}entry"):
        one = lambda name, e=entry: " ".join((e.findtext(_ATOM + name) or "").split())
        yield {"id": one("id").rpartition("/abs/")[2], "title": one("title"), "summary": one("summary"), "published": one("published"), "authors": [" ".join(a.split()) for a in (n.findtext(f"{_ATOM}name") or "" for n in entry.iter(f"{_ATOM}author"))]}


def arxiv_items(client: Client, **asked) -> Iterator[dict]:
    yield from atom_items(client.get(arxiv_url(**asked)).bytes())


def work_by_doi(client: Client, doi: str) -> dict | None:
    """The work of a DOI; None if it is unknown or the service fails."""
    try:
        return client.json(f"works/https://doi.org/{doi}")
    except ServiceError:
        return None


def pmcid_of_doi(client: Client, doi: str) -> str | None:
    """The PMCID of the first result of a DOI that has one."""
    asked = urllib.parse.urlencode({"query": f'DOI:"{doi}"', "format": "json", "pageSize": 5})
    results = (client.json(f"search?{asked}").get("resultList") or {}).get("result") or []
    return next((r["pmcid"] for r in results if r.get("pmcid")), None)


def full_text(client: Client, pmcid: str) -> str | None:
    """An open-access article as Markdown."""
    return article_markdown(client.get(f"{pmcid}/fullTextXML").text())


def pdf(client: Client, url: str) -> bytes | None:
    """A PDF's bytes; None for an answer that isn't one."""
    body = client.get(url).bytes()
    return body if body.startswith(b"%PDF-") else None


def has_notice(client: Client, doi: str) -> bool | None:
    """Whether a retraction notice updates a DOI, asked as a count; None if that can't be known."""
    if "," in doi:
        return None
    asked = urllib.parse.urlencode({"filter": f"updates:{doi},update-type:retraction", "rows": 0})
    try:
        return int((client.json(f"works?{asked}").get("message") or {}).get("total-results") or 0) > 0
    except ServiceError:
        return None


def client_of(service: str, options: dict[str, str]) -> Client:
    base = options.get("base") or {"openalex": OPENALEX, "epmc": EPMC, "arxiv": ARXIV, "crossref": CROSSREF}[service]
    recording = options.get("recording")
    gap = float(options.get("gap", 0.0 if recording else GAPS[service]))
    return Client(base, Recording(recording) if recording else live, Limiter(service, gap), int(options.get("retries", RETRIES)))


#: What can be read as a table: the service that is asked, and its items by client and options.
KINDS: dict[str, tuple[str, Callable[[Client, dict[str, str]], Iterator[dict]]]] = {
    "openalex": ("openalex", lambda c, o: openalex_items(c, int(o["most"]) if "most" in o else None, **{k: o[k] for k in ("entity", "search", "filter", "group_by", "sample", "seed", "select", "sort", "page", "per_page") if k in o})),
    "epmc": ("epmc", lambda c, o: epmc_items(c, o["query"], int(o.get("most", 10)))),
    "citations": ("epmc", lambda c, o: epmc_linked(c, o["source"], o["article"], "citations", int(o.get("per_page", 25)))),
    "references": ("epmc", lambda c, o: epmc_linked(c, o["source"], o["article"], "references", int(o.get("per_page", 25)))),
    "arxiv": ("arxiv", lambda c, o: arxiv_items(c, **({k: o[k] for k in ("query", "ids", "sort_by", "order") if k in o} | {k: int(o[k]) for k in ("start", "most") if k in o}))),
}


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.options = options

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(0)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        service, items = KINDS[self.options["kind"]]
        for k, item in enumerate(items(client_of(service, self.options), self.options)):
            yield k, json.dumps(item, ensure_ascii=False)


class Services(DataSource):
    """(ord, item): items of a service's answers as JSON, in order.  Options: kind and what its request takes; recording, base, gap, retries."""

    @classmethod
    def name(cls) -> str:
        return "quill-services"

    def schema(self) -> str:
        return "ord bigint, item string"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(dict(self.options))


def read(spark: SparkSession, kind: str, **options: object) -> DataFrame:
    """(ord, item) of a service; see :class:`Services`."""
    if kind not in KINDS:
        raise ValueError(f"unknown kind {kind!r}; there are {', '.join(KINDS)}")
    spark.dataSource.register(Services)
    return spark.read.format("quill-services").options(kind=kind, **{k: str(v) for k, v in options.items()}).load()


LOOKUPS: dict[str, tuple[str, Callable[[Client, str], object]]] = {
    "work": ("openalex", work_by_doi), "pmcid": ("epmc", pmcid_of_doi), "text": ("epmc", full_text), "notice": ("crossref", has_notice),
}


def look_up(ids: DataFrame, column: str, kind: str, **options: object) -> DataFrame:
    """(id, found, error) for the distinct ids of a column: what the service says as JSON; errors don't end the job.

    The partitions ask side by side, each machine no faster than the service allows.
    """
    service, ask = LOOKUPS[kind]
    plain = {k: str(v) for k, v in options.items()}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        client = client_of(service, plain)
        for batch in batches:
            out = []
            for value in batch["id"]:
                try:
                    found = ask(client, value)
                    out.append((value, None if found is None else json.dumps(found), None))
                except ServiceError as e:
                    out.append((value, None, str(e)))
            yield pd.DataFrame(out, columns=["id", "found", "error"])

    return ids.select(ids[column].cast("string").alias("id")).where("id <> ''").distinct().mapInPandas(run, "id string, found string, error string")


def graph_edges(items: DataFrame, article: str, kind: str) -> DataFrame:
    """(citing, cited) of the ids of an article's citations or references (ord, item)."""
    from pyspark.sql import functions as F

    other = F.get_json_object("item", "$.id")
    one, two = (other, F.lit(article)) if kind == "citations" else (F.lit(article), other)
    return items.select(one.alias("citing"), two.alias("cited")).where("citing is not null and cited is not null")
