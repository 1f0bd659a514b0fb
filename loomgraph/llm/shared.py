"""What the training-data operators share: tables, the shared folder, files."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import os
import tempfile
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes of an Arrow batch sent to Python: bound a worker's memory when texts are long.
BATCH_ROWS, BATCH_BYTES = 2000, 8 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Keep Arrow batches small; smaller settings of the session stay."""
    for key, most in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        now = spark.conf.get(f"spark.sql.execution.arrow.{key}").rstrip("bB")
        if not (now.isdigit() and 0 < int(now) <= most):
            spark.conf.set(f"spark.sql.execution.arrow.{key}", str(most))


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share. One of our own only in local mode, where they are one process."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="loomgraph-")
        spark.sparkContext.setCheckpointDir(root)
    return root


#: Folders made inside scratch() blocks that no caller keeps account of.
_scratch: list[list[str]] = []


@contextlib.contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Folders made within go at the end: for callers that have written what they need."""
    _scratch.append([])
    try:
        yield
    finally:
        for path in _scratch.pop():
            drop_path(spark, path)


def shared_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"
    if _scratch:
        _scratch[-1].append(path)
    return path


def written(df: DataFrame, name: str, keep: list[str] | None = None) -> DataFrame:
    """Write a table to the shared folder and read it back: cuts lineage, outlives executors."""
    spark = df.sparkSession
    path = shared_path(spark, name)
    df.write.parquet(path)
    if keep is not None:
        keep.append(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_path(spark: SparkSession, path: str) -> None:
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


#: Columns of row ids, and of the folder that a row is looked up in.
FILE, AT, BUCKET = "__loomgraph_file", "__loomgraph_at", "__loomgraph_bucket"
#: The most folders of a lookup table, and rows of a file that share one.
BUCKETS, BUCKET_ROWS_LOG2 = 8192, 20


def _is_scan(df: DataFrame) -> bool:
    """Whether rows of the frame are rows of files one to one: a scan under column choices and filters only."""
    plan = df._jdf.queryExecution().analyzed()
    while plan.nodeName() in ("Project", "Filter", "SubqueryAlias"):
        if not plan.deterministic():
            return False
        plan = plan.children().head()
    return plan.nodeName().startswith(("LogicalRelation", "Relation"))


def with_row_ids(docs: DataFrame, made: list[str]) -> DataFrame:
    """docs with FILE and AT: ids of its rows that hold in every later scan, however the scan is split among tasks.

    Rows of Parquet files have them in their metadata (a hash of the file's
    path and the row's place in the file), which does not depend on splits,
    cores or executors. Any other table is written to the shared folder first.
    A table that has the ids already stays as it is.
    """
    if FILE in docs.columns and AT in docs.columns:
        return docs

    def ids(df: DataFrame) -> DataFrame:
        m = df.metadataColumn("_metadata")
        return df.select("*", F.xxhash64(m["file_path"]).alias(FILE), m["row_index"].alias(AT))

    if _is_scan(docs):
        with contextlib.suppress(AnalysisException):
            return ids(docs)
    return ids(written(docs, "rows", made))


def with_buckets(numbered: DataFrame) -> DataFrame:
    return numbered.withColumn(BUCKET, F.pmod(F.xxhash64(FILE, F.shiftright(AT, BUCKET_ROWS_LOG2)), BUCKETS).cast("int"))


def lookup_table(rows: DataFrame, name: str, made: list[str]) -> str:
    """Write a table with FILE and AT in folders by BUCKET, so that a later scan picks its rows without a shuffle of its texts."""
    path = shared_path(rows.sparkSession, name)
    with_buckets(rows).repartition(BUCKET).sortWithinPartitions(BUCKET, FILE, AT).write.partitionBy(BUCKET).parquet(path)
    made.append(path)
    return path


class Lookup:
    """Finds the rows of a scan's batches (FILE, AT, BUCKET) in a lookup table; holds one bucket at a time."""

    def __init__(self, path: str):
        self.path, self.held, self.table = path, None, None

    def _bucket(self, number: int) -> pa.Table | None:
        import pyarrow.parquet as pq

        if number != self.held:
            self.held, self.table = number, None
            folder = f"{self.path}/{BUCKET}={number}"
            if is_folder(folder):
                parts = []
                for f in list_files(folder, ".parquet"):
                    with open_read(f) as file:
                        parts.append(pq.read_table(file))
                self.table = pa.concat_tables(parts).combine_chunks() if parts else None
        return self.table

    def pick(self, batch: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, pa.Table | None, pa.Array]]:
        """The batch in parts of one bucket and file, each with its table and places in that table (null: not in it)."""
        keys = batch.select([BUCKET, FILE]).to_pandas()
        for (bucket, file), where in keys.groupby([BUCKET, FILE], sort=True).indices.items():
            part = batch if len(where) == batch.num_rows else batch.take(pa.array(np.sort(where)))
            table = self._bucket(int(bucket))
            if table is not None:
                table = table.filter(pc.equal(table.column(FILE), pa.scalar(int(file), pa.int64())))
            if table is None or not table.num_rows:
                yield part, None, pa.nulls(part.num_rows, pa.int32())
            else:
                yield part, table, pc.index_in(part.column(AT), value_set=table.column(AT).combine_chunks())


def filter_rows(docs: DataFrame, numbered: DataFrame, rows: DataFrame, name: str, keep: bool) -> DataFrame:
    """docs without the rows that rows (FILE, AT) names, or only those; numbered is docs with its row ids."""
    made: list[str] = []
    path = lookup_table(rows.select(FILE, AT).distinct(), name, made)
    small_batches(docs.sparkSession)

    def run(batches):
        found = Lookup(path)
        for batch in batches:
            for part, _, at in found.pick(batch):
                yield part.filter(at.is_valid() if keep else at.is_null()).drop_columns([FILE, AT, BUCKET])

    return with_buckets(numbered).mapInArrow(run, docs.schema)


def is_folder(path: str) -> bool:
    if (p := _local(path)) is not None:
        return os.path.isdir(p)
    from pyarrow import fs

    f, p = _filesystem(path)
    return f.get_file_info(p).type == fs.FileType.Directory


def _filesystem(path: str):
    """A pyarrow file system and the path in it, for paths that are not local."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


def _local(path: str) -> str | None:
    if path.startswith("file:"):
        return "/" + path[5:].lstrip("/")
    return path if "://" not in path else None


def make_folder(path: str) -> None:
    if (p := _local(path)) is not None:
        os.makedirs(p, exist_ok=True)
    else:
        f, p = _filesystem(path)
        f.create_dir(p, recursive=True)


def list_files(path: str, suffix: str) -> list[str]:
    """Files of a folder, or the file itself, in order of their names."""
    if (p := _local(path)) is not None:
        if os.path.isfile(p):
            return [p]
        return sorted(os.path.join(p, x) for x in os.listdir(p) if x.endswith(suffix))
    from pyarrow import fs

    f, p = _filesystem(path)
    root = path[: len(path) - len(p)] if path.endswith(p) else path.split("://")[0] + "://"
    return sorted(root + x.path for x in f.get_file_info(fs.FileSelector(p)) if x.path.endswith(suffix))


def open_write(path: str):
    if (p := _local(path)) is not None:
        return open(p, "wb")
    f, p = _filesystem(path)
    return f.open_output_stream(p)


def open_read(path: str):
    if (p := _local(path)) is not None:
        return open(p, "rb")
    f, p = _filesystem(path)
    return f.open_input_file(p)


def file_size(path: str) -> int:
    if (p := _local(path)) is not None:
        return os.path.getsize(p)
    f, p = _filesystem(path)
    return f.get_file_info(p).size


def texts_of(batch: pa.RecordBatch, column: str) -> list[str]:
    """The column as Python strings, null as the empty text."""
    return [x if x is not None else "" for x in batch.column(column).to_pylist()]


#: Bytes of text that an operator works on at a time; one longer text is worked on alone.
SLICE_BYTES = 1 << 20


def slices(batches: Iterable[pa.RecordBatch], rows: int, column: str = "text", most: int = SLICE_BYTES) -> Iterable[pa.RecordBatch]:
    """The batches in slices of at most so many rows and bytes of a text column; then memory goes back to the system."""
    for batch in batches:
        at = 0
        if column in batch.schema.names and batch.num_rows:
            size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype("int64")
            total = size.cumsum()
            while at < batch.num_rows:
                before = total[at - 1] if at else 0
                end = min(at + rows, max(at + 1, int(total.searchsorted(before + most, side="right"))))
                yield batch.slice(at, end - at)
                at = end
        else:
            for at in range(0, batch.num_rows, rows):
                yield batch.slice(at, rows)
    release()


def release() -> None:
    """Give back what a task's arrays held: workers live on, and later stages share the executor's memory."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def sql_crc32(text: str) -> str:
    """DuckDB's expression of the unsigned CRC-32 of a string of ASCII characters."""
    codes = f"list_transform(string_split({text}, ''), lambda c: CAST(ascii(c) AS BIGINT))"
    byte = "list_reduce(list_prepend(xor(crc, b), [0, 0, 0, 0, 0, 0, 0, 0]), lambda x, z: xor(x >> 1, CASE WHEN x & 1 = 1 THEN 3988292384 ELSE 0 END))"
    return f"xor(4294967295, list_reduce(list_prepend(CAST(4294967295 AS BIGINT), {codes}), lambda crc, b: {byte}))"
