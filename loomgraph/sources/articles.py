"""An article store as a Spark data source: files are its partitions, words and dates are pushed into it (SRC-8)."""

from __future__ import annotations

import datetime
import json
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, IsNotNull, LessThan, LessThanOrEqual, StringContains

SCHEMA = "article_id long, title string, abstract string, url string, published date"
_COLUMNS = [c.split(" ")[0] for c in SCHEMA.split(", ")]
_TYPES = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.date32()]
_TEXTS = ("title", "abstract", "url")
#: Articles in a batch.
BATCH = 500


def write_store(articles: DataFrame, path: str) -> None:
    """Articles (article_id, title, abstract, url, published) as lines of JSON in a folder for each year; articles without a date in one of their own."""
    year = F.coalesce(F.year("published"), F.lit(0))
    articles.select(*_COLUMNS, year.alias("_year")).write.partitionBy("_year").json(path)


class File(InputPartition):
    def __init__(self, path: str):
        self.path = path


class ArticleReader(DataSourceReader):
    """Files of the years that the dates allow; of their lines, those that hold all words are decoded."""

    def __init__(self, path: str):
        self.path = path
        self.words: list[tuple[str, str]] = []
        self.dates: list[tuple[str, datetime.date]] = []
        self.present: list[str] = []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        signs = {GreaterThan: ">", GreaterThanOrEqual: ">=", LessThan: "<", LessThanOrEqual: "<=", EqualTo: "=="}
        for f in filters:
            column = f.attribute[0] if hasattr(f, "attribute") and len(f.attribute) == 1 else ""
            if isinstance(f, StringContains) and column in _TEXTS:
                self.words.append((column, f.value))
            elif column == "published" and type(f) in signs and isinstance(f.value, datetime.date):
                self.dates.append((signs[type(f)], f.value))
            elif isinstance(f, IsNotNull) and column in _COLUMNS:
                self.present.append(column)
            else:
                yield f

    def _may_hold(self, year: int) -> bool:
        """Whether a folder's year can have dates that all filters take; folder 0 has none."""
        if not self.dates and "published" not in self.present:
            return True
        first, last = (datetime.date(year, 1, 1), datetime.date(year, 12, 31)) if year else (None, None)
        holds = {">": lambda d: last > d, ">=": lambda d: last >= d, "<": lambda d: first < d, "<=": lambda d: first <= d, "==": lambda d: first <= d <= last}
        return bool(year) and all(holds[sign](d) for sign, d in self.dates)

    def partitions(self) -> list[File]:
        files, root = _filesystem(self.path)
        found = files.get_file_info(fs.FileSelector(root, recursive=True, allow_not_found=True))
        out = []
        for f in sorted(x.path for x in found if x.is_file and x.path.endswith(".json")):
            year = re.search(r"/_year=(\d+)/", f)
            if year is None or self._may_hold(int(year[1])):
                out.append(File(f))
        return out

    def _takes(self, row: dict) -> bool:
        published = row["published"]
        tests = {">": lambda a, b: a > b, ">=": lambda a, b: a >= b, "<": lambda a, b: a < b, "<=": lambda a, b: a <= b, "==": lambda a, b: a == b}
        return all(row[c] is not None for c in self.present) and all(row[c] is not None and w in row[c] for c, w in self.words) and all(published is not None and tests[sign](published, d) for sign, d in self.dates)

    def read(self, partition: File | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # no file is left
            return
        files, _ = _filesystem(self.path)
        # what every line with the words must hold, whatever its fields
        marks = [json.dumps(w, ensure_ascii=False)[1:-1].encode() for _, w in self.words if not re.search(r"[/\x00-\x1f\x7f-\x9f  \ud800-\udfff]", w)]
        rows: list[list] = []
        with files.open_input_stream(partition.path) as raw:
            for line in _lines(raw):
                if all(m in line for m in marks):
                    got = json.loads(line)
                    row = {c: got.get(c) for c in _COLUMNS}
                    row["published"] = datetime.date.fromisoformat(row["published"]) if row["published"] else None
                    if self._takes(row):
                        rows.append([row[c] for c in _COLUMNS])
                if len(rows) == BATCH:
                    yield _batch(rows)
                    rows = []
        if rows:
            yield _batch(rows)


def _lines(stream: pa.NativeFile) -> Iterator[bytes]:
    """Lines of a stream, a piece of it held at a time."""
    held = b""
    while piece := stream.read(1 << 20):
        *whole, held = (held + piece).split(b"\n")
        yield from (x for x in whole if x)
    if held:
        yield held


def _batch(rows: list[list]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _TYPES)], _COLUMNS)


def _filesystem(path: str) -> tuple[fs.FileSystem, str]:
    if path.startswith("file:"):
        path = "/" + path[5:].lstrip("/")
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


class ArticleSource(DataSource):
    """spark.read.format("articles").load(folder): a store that write_store() has written."""

    @classmethod
    def name(cls) -> str:
        return "articles"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> ArticleReader:
        return ArticleReader(self.options["path"])


def articles(spark: SparkSession, path: str) -> DataFrame:
    spark.dataSource.register(ArticleSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark.read.format("articles").load(path)


def search(spark: SparkSession, path: str, query: str, most: int = 100, sort: str = "relevance", first: datetime.date | None = None, last: datetime.date | None = None) -> DataFrame:
    """rank, article_id, title, published, score of the articles whose abstract holds a query's words, all of them.

    score counts the places of the words; by relevance the highest
    comes first, by date the latest, ties go to the smaller id. Words are sought
    as they are written; a query without words finds nothing. Dates bound the
    articles' own, both included.
    """
    if sort not in ("relevance", "date"):
        raise ValueError(f"no order by {sort!r}")
    found, words = articles(spark, path), query.split()
    if first is not None:
        found = found.where(F.col("published") >= F.lit(first))
    if last is not None:
        found = found.where(F.col("published") <= F.lit(last))
    for w in words or ():
        found = found.where(F.col("abstract").contains(w))
    count = sum((F.regexp_count("abstract", F.lit(re.escape(w))) for w in words), F.lit(0))
    found = (found if words else found.limit(0)).select("article_id", "title", "published", count.cast("long").alias("score"))
    order = [F.desc("score"), "article_id"] if sort == "relevance" else [F.desc_nulls_last("published"), "article_id"]
    ranked = found.orderBy(*order).limit(most)
    return ranked.select(F.row_number().over(Window.orderBy(*order)).alias("rank"), "*")  # at most `most` rows
