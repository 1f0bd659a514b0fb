"""Text services and article indexes, with a transport that the caller gives (SRC-8, SRC-9, SRC-12..14).

Nothing here opens a connection by itself: a transport is a function of
(url, headers, body or None, seconds) that gives (status, text). It is pickled
with the query and opened in the workers; http_transport is one over the
standard library. Without a transport every request fails with a reason in its
row and the job goes on.
"""

from __future__ import annotations

import json
import time
import urllib.parse
from collections import OrderedDict
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Transport = Callable[[str, dict[str, str], str | None, float], tuple[int, str]]


def http_transport(url: str, headers: dict[str, str], body: str | None, seconds: float) -> tuple[int, str]:
    """A request over HTTP by the standard library; statuses that are errors are given back, not raised."""
    import urllib.error
    import urllib.request

    request = urllib.request.Request(url, None if body is None else body.encode(), headers)
    try:
        with urllib.request.urlopen(request, timeout=seconds) as reply:
            return reply.status, reply.read().decode("utf-8", "replace")
    except urllib.error.HTTPError as e:
        return e.code, e.read().decode("utf-8", "replace")


@dataclass(frozen=True)
class Service:
    """A text service. kind: chat (remote, with a key), generate or dialogue (a server of one's own), local (a model in the process)."""

    kind: str = "chat"
    base_url: str = ""
    model: str = ""
    api_key: str = ""
    timeout: float = 30
    max_retries: int = 3
    temperature: float = 0.7
    max_tokens: int = 1000
    rate_limit: int = 10_000
    context: int = 2048
    threads: int = 4

    def problems(self) -> list[str]:
        """What is wrong with the settings; nothing if they can be used (SRC-13)."""
        rules = [
            (self.kind in ("chat", "generate", "dialogue", "local"), f"no kind {self.kind!r}"),
            (1 <= self.context <= 8192, "context must be 1 to 8192"),
            (self.threads >= 1, "threads must be 1 or more"),
            (0.0 <= self.temperature <= 2.0, "temperature must be 0 to 2"),
            (1 <= self.max_tokens <= 4096, "max_tokens must be 1 to 4096"),
            (self.max_retries >= 1, "max_retries must be 1 or more"),
        ]
        return [what for ok, what in rules if not ok]

    def request(self, prompt: str) -> tuple[str, dict[str, str], dict]:
        """url, headers and body of a prompt's request."""
        message = [{"role": "user", "content": prompt}]
        headers = {"Content-Type": "application/json"}
        own = {"model": self.model, "temperature": self.temperature}
        if self.kind == "chat":
            return f"{self.base_url}/chat/completions", {"Authorization": f"Bearer {self.api_key}"} | headers, own | {"messages": message, "max_tokens": self.max_tokens}
        if self.kind == "generate":
            return f"{self.base_url}/api/generate", headers, own | {"prompt": prompt, "max_tokens": self.max_tokens, "stream": False}
        return f"{self.base_url}/api/chat", headers, own | {"messages": message, "stream": False}

    def reply(self, data: dict) -> str:
        """The text in a reply; an empty reply is an error."""
        if self.kind == "chat":
            if not data.get("choices"):
                raise ValueError("a reply without choices")
            return data["choices"][0]["message"]["content"]
        return data["response"] if self.kind == "generate" else data["message"]["content"]


@dataclass
class TokenBudget:
    """At most so many tokens a minute, a token being four characters (STR-1): waits for the next minute where they are used up."""

    limit: int
    clock: Callable[[], float] = time.time
    sleep: Callable[[float], None] = time.sleep
    begin: float = field(default=float("-inf"))
    used: int = 0

    def take(self, prompt: str) -> None:
        now = self.clock()
        if now - self.begin >= 60.0:
            self.begin, self.used = now, 0
        elif self.used >= self.limit:
            self.sleep(60.0 - (now - self.begin))
            self.begin, self.used = self.clock(), 0
        self.used += len(prompt) // 4


class Replies:
    """Replies by prompt for a time and up to a number; the oldest goes first (STR-2)."""

    def __init__(self, most: int = 1000, seconds: float = 3600, clock: Callable[[], float] = time.time):
        self.most, self.seconds, self.clock, self.held = most, seconds, clock, OrderedDict()

    def get(self, key: str) -> str | None:
        if key in self.held and self.clock() - self.held[key][1] < self.seconds:
            return self.held[key][0]
        return None

    def put(self, key: str, value: str) -> None:
        self.held.pop(key, None)
        self.held[key] = value, self.clock()
        while len(self.held) > self.most:
            self.held.popitem(last=False)


def asked(service: Service, transport: Transport, budget: TokenBudget, prompt: str) -> str:
    """The reply to a prompt: again after 2, 4, 8 ... seconds where the service is busy or the request fails, up to max_retries times."""
    url, headers, body = service.request(prompt)
    budget.take(prompt)
    for attempt in range(1, service.max_retries + 1):
        last = attempt == service.max_retries
        try:
            status, text = transport(url, headers, json.dumps(body), service.timeout)
        except Exception as e:  # noqa: BLE001
            if last:
                raise ConnectionError(f"Request failed: {e}") from e
        else:
            if status == 200:
                return service.reply(json.loads(text))
            if status != 429:
                raise ConnectionError(f"HTTP {status}: {text[:500]}")
            if last:
                raise ConnectionError("Rate limit exceeded")
        budget.sleep(float(2**attempt))
    raise ConnectionError("Max retries exceeded")


def backend(service: Service, transport: Transport = http_transport, sleep: Callable[[float], None] = time.sleep) -> Callable[[], Callable[[list[str]], list[str]]]:
    """For files.complete: opened once by each worker, with a budget and a memory of replies of its own. One rate limit holds for each worker."""
    if wrong := service.problems():
        raise ValueError("; ".join(wrong))

    def open_() -> Callable[[list[str]], list[str]]:
        budget, held = TokenBudget(service.rate_limit, sleep=sleep), Replies()

        def run(prompts: list[str]) -> list[str]:
            out = []
            for p in prompts:
                if (reply := held.get(p)) is None:
                    reply = asked(service, transport, budget, p)
                    held.put(p, reply)
                out.append(reply)
            return out

        return run

    return open_


ARTICLE = "query string, pmid string, title string, abstract string, authors array<string>, doi string, publication_date string, journal string, error string"


def article_text(title: Column, abstract: Column) -> Column:
    """Title and abstract, those that are there, with a blank between (SRC-9)."""
    return F.concat_ws(" ", F.nullif(title, F.lit("")), F.nullif(abstract, F.lit("")))


def article(record: Column) -> Column:
    """title, abstract, authors, pmid, doi, publication_date, journal of an article as JSON, empty where they are missing (SRC-9)."""
    kinds = "title string, abstract string, authors array<string>, pmid string, doi string, publication_date string, journal string"
    got = F.from_json(record, kinds)
    value = lambda c: F.coalesce(got[c], F.array().cast("array<string>") if c == "authors" else F.lit("")).alias(c)
    return F.struct(*(value(x.split()[0]) for x in kinds.split(", ")))


def page_title(html: str | Column) -> Column:
    """What stands in a page's title element; empty without one."""
    return F.regexp_extract(html, r"<title>([^<]*)</title>", 1)


def search_articles(queries: DataFrame, transport: Transport | None = None, base_url: str = "https://eutils.ncbi.nlm.nih.gov/entrez/eutils", most: int = 100, sort: str = "relevance", since: str | None = None, until: str | None = None) -> DataFrame:
    """Articles of an index for each row of queries (query): ARTICLE (SRC-8).

    A search gives ids, a fetch their articles as JSON records. A query whose
    requests fail, and every query without a transport, is one row with an
    error and no article; a query that finds nothing gives no row.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in ARTICLE.split(", ")]
        for batch in batches:
            rows = []
            for query in batch.column("query").to_pylist():
                try:
                    if transport is None:
                        raise ConnectionError("no transport")
                    found = list(_articles(query, transport, base_url, most, sort, since, until))
                    rows += [(query, *(a.get(c) or ([] if c == "authors" else "") for c in names[1:-1]), None) for a in found]
                except Exception as e:  # noqa: BLE001
                    rows.append((query, *(None,) * 7, str(e)))
            kinds = [pa.list_(pa.string()) if c == "authors" else pa.string() for c in names]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [()] * len(names), kinds)], names)

    return queries.select("query").mapInArrow(run, ARTICLE)


def _articles(query: str, transport: Transport, base_url: str, most: int, sort: str, since: str | None, until: str | None) -> Iterator[dict]:
    asked_ = {"db": "pubmed", "term": query, "retmax": most, "sort": sort, "retmode": "json"} | ({"mindate": since} if since else {}) | ({"maxdate": until} if until else {})
    status, text = transport(f"{base_url}/esearch.fcgi?{urllib.parse.urlencode(asked_)}", {}, None, 30)
    if status != 200:
        raise ConnectionError(f"HTTP {status}")
    ids = json.loads(text).get("esearchresult", {}).get("idlist", [])[:most]
    if ids:
        status, text = transport(f"{base_url}/esummary.fcgi?{urllib.parse.urlencode({'db': 'pubmed', 'id': ','.join(ids), 'retmode': 'json'})}", {}, None, 30)
        if status != 200:
            raise ConnectionError(f"HTTP {status}")
        result = json.loads(text).get("result", {})
        for i in ids:
            r = result.get(i, {})
            doi = next((x.get("value", "") for x in r.get("articleids", []) if x.get("idtype") == "doi"), "")
            yield {"pmid": i, "title": r.get("title"), "abstract": r.get("abstract"), "authors": [a.get("name", "") for a in r.get("authors", [])], "doi": doi, "publication_date": r.get("pubdate"), "journal": r.get("fulljournalname")}
