"""Token-ID binary output in seekable zstandard files (operator 2).

A file is a run of independent zstandard frames, one for each document (more
for a document of over FRAME_IDS ids), then a skippable frame with the
document index, then the seek table: the public seekable format, a skippable
frame with each frame's compressed and decompressed sizes and a checksum (low
32 bits of xxh64 of the decompressed bytes) and a footer. A reader seeks to
the frames of the documents that it is asked for and decompresses no others.
"""

from __future__ import annotations

import itertools
import re
import struct
import uuid
import zlib
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .chunks import ChunkTable
from .shared import make_folder, open_read, open_write, shared_path, slices, small_batches, table, texts_of

# Fixed values of the public zstandard seekable format.
SKIPPABLE_INDEX = 0x184D2A50
SKIPPABLE_SEEK = 0x184D2A5E
SEEKABLE_MAGIC = 0x8F92EAB1
CHECKSUM_FLAG = 0x80

FRAME_IDS = 1 << 20
#: Compressed bytes and documents after which a task begins another file: they bound what writer and reader hold of one.
FILE_BYTES, FILE_DOCS = 256 << 20, 1 << 20
#: Documents that a reader gives at a time.
READ_DOCS = 5000
SUFFIX = ".ids.zst"
#: Texts with white space other than blanks and line ends, or with special tokens, are encoded whole.
_ODD = re.compile(r"[^\S \n]|[\x1c-\x1f\x85᠎​-‏﻿]|<\|")


@lru_cache(1)
def encoder_for(tokenizer_path: str) -> "Encoder":
    """One encoder, and so one table, for all tasks of a Python worker."""
    return Encoder(tokenizer_path)


class Encoder:
    """Exactly what tokenizers gives for encode(text, add_special_tokens=False).ids."""

    def __init__(self, tokenizer_path: str):
        from tokenizers import Tokenizer

        self.tokenizer = t = Tokenizer.from_file(tokenizer_path)
        vocabulary = t.get_vocab(with_added_tokens=True)
        starts = np.zeros(max(vocabulary.values()) + 1, bool)
        for token, k in vocabulary.items():
            starts[k] = token.startswith("Ġ")
        one = lambda text: t.encode_batch_fast([text], add_special_tokens=False)[0].ids
        self.one = one
        self.table = ChunkTable(lambda chunks: one(" " + " ".join(chunks)), starts, first=one, odd=_ODD)

    def encode(self, texts: list[str]) -> list[bytes]:
        body = self.table.encode_all(texts)
        for k, ids in enumerate(body):
            if ids is None:
                body[k] = np.asarray(self.one(texts[k]), "<u4").tobytes()
        return body


class SeekableWriter:
    def __init__(self, path: str, level: int = 1):
        import zstandard

        self.path, self.file = path, open_write(path)
        self.compressor = zstandard.ZstdCompressor(level=level)
        self.frames: list[tuple[int, int, int]] = []
        self.docs: list[tuple[int | None, int, int]] = []
        self.tokens = self.bytes = 0

    def add(self, doc_id: int | None, ids: bytes) -> None:
        import xxhash

        parts = [ids[k : k + 4 * FRAME_IDS] for k in range(0, len(ids), 4 * FRAME_IDS)] or [b""]
        for raw in parts:
            packed = self.compressor.compress(raw)
            self.file.write(packed)
            self.bytes += len(packed)
            self.frames.append((len(packed), len(raw), xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF))
        self.docs.append((doc_id, len(ids) // 4, len(parts)))
        self.tokens += len(ids) // 4

    def close(self) -> None:
        n = len(self.docs)
        index = struct.pack("<Q", n)
        index += np.array([d[0] or 0 for d in self.docs], "<i8").tobytes() + np.array([d[0] is None for d in self.docs], "u1").tobytes()
        index += np.array([d[1] for d in self.docs], "<i8").tobytes() + np.array([d[2] for d in self.docs], "<u4").tobytes()
        packed = self.compressor.compress(index)
        self.file.write(struct.pack("<II", SKIPPABLE_INDEX, len(packed)) + packed)
        entries = b"".join(struct.pack("<III", *f) for f in self.frames)
        entries += struct.pack("<IBI", len(self.frames), CHECKSUM_FLAG, SEEKABLE_MAGIC)
        self.file.write(struct.pack("<II", SKIPPABLE_SEEK, len(entries)) + entries)
        self.file.close()


class SeekableReader:
    """Reads the seek table and the index; frames only as they are asked for."""

    def __init__(self, path: str):
        import zstandard

        self.path, self.file, self.zstd = path, open_read(path), zstandard.ZstdDecompressor()
        size = self.file.seek(0, 2)
        self.file.seek(size - 9)
        n, flags, magic = struct.unpack("<IBI", self.file.read(9))
        if magic != SEEKABLE_MAGIC or not flags & CHECKSUM_FLAG:
            raise ValueError(f"no seek table with checksums in {path}")
        self.file.seek(size - 9 - 12 * n)
        self.entries = np.frombuffer(self.file.read(12 * n), "<u4").reshape(n, 3)
        self.offsets = np.concatenate([[0], np.cumsum(self.entries[:, 0].astype(np.int64))])
        self.file.seek(int(self.offsets[-1]))
        magic, length = struct.unpack("<II", self.file.read(8))
        if magic != SKIPPABLE_INDEX:
            raise ValueError(f"no document index in {path}")
        raw = self.zstd.decompress(self.file.read(length))
        (k,) = struct.unpack_from("<Q", raw)
        ids, null = np.frombuffer(raw, "<i8", k, 8), np.frombuffer(raw, "u1", k, 8 + 8 * k)
        self.doc_ids = [None if z else int(x) for x, z in zip(ids, null)]
        self.n_tokens = np.frombuffer(raw, "<i8", k, 8 + 9 * k)
        self.n_frames = np.frombuffer(raw, "<u4", k, 8 + 17 * k)
        self.first = np.concatenate([[0], np.cumsum(self.n_frames.astype(np.int64))])

    def read(self, at: int) -> bytes:
        """The ids of the document at this place, checked against the frames' checksums."""
        import xxhash

        out = []
        for f in range(int(self.first[at]), int(self.first[at + 1])):
            self.file.seek(int(self.offsets[f]))
            raw = self.zstd.decompress(self.file.read(int(self.entries[f, 0])), max_output_size=max(1, int(self.entries[f, 1])))
            if xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF != self.entries[f, 2]:
                raise ValueError(f"checksum of frame {f} of {self.path}")
            out.append(raw)
        return b"".join(out)

    def documents(self, wanted: set[int] | None = None) -> Iterator[tuple[int | None, bytes]]:
        for at, doc_id in enumerate(self.doc_ids):
            if wanted is None or doc_id in wanted:
                yield doc_id, self.read(at)

    def close(self) -> None:
        self.file.close()


def write_token_files(docs: DataFrame, tokenizer_path: str, folder: str, end_id: int = 2) -> list[tuple[str, int, int]]:
    """Encode and write the documents in ascending doc_id order; (path, documents, ids) of each file, in order.

    Rows are dealt by ranges of doc_id and a hash of the text, so that one
    hot doc_id is divided too, and sorted (null doc_ids first, equal ones by
    that hash and the text). A task writes files of bounded size under names of
    its own attempt, and only files of tasks that ended well are returned, so
    lost executors leave no half files behind in the list. A null text is the
    empty text: the end id alone. An empty table gives no files.
    """
    spark = docs.sparkSession
    small_batches(spark)
    make_folder(folder)
    end = struct.pack("<I", end_id)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, number, out, encoder = TaskContext.get().partitionId(), 0, None, encoder_for(tokenizer_path)

        def closed() -> pa.RecordBatch:
            out.close()
            return pa.RecordBatch.from_pydict({"path": [out.path], "n_docs": [len(out.docs)], "n_ids": [out.tokens], "part": [part], "number": [number]})

        for batch in slices(batches, 2000, most=8 << 20):
            for doc_id, ids in zip(batch.column("doc_id").to_pylist(), encoder.encode(texts_of(batch, "text"))):
                if out is None:
                    out = SeekableWriter(f"{folder}/part-{part:06d}-{number:06d}-{uuid.uuid4().hex}{SUFFIX}")
                out.add(doc_id, ids + end)
                if out.bytes >= FILE_BYTES or len(out.docs) >= FILE_DOCS:
                    yield closed()
                    out, number = None, number + 1
        if out is not None:
            yield closed()

    files = (
        docs.select(docs["doc_id"].cast("long").alias("doc_id"), F.xxhash64("text").alias("_h"), "text")
        .repartitionByRange(parts, "doc_id", "_h")
        .sortWithinPartitions("doc_id", "_h", "text")
        .select("doc_id", "text")
        .mapInArrow(run, "path string, n_docs long, n_ids long, part long, number long")
    )
    # one row for each file, not for each document
    return [(r.path, r.n_docs, r.n_ids) for r in sorted(files.collect(), key=lambda r: (r.part, r.number))]


def read_token_files(spark: SparkSession, files: list[tuple[str, int, int]]) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the files."""
    rows, start = [], 0
    for path, _, n in files:
        rows.append((path, start))
        start += n

    def run(batches):
        names = ["doc_id", "start", "n_tokens", "ids_crc32"]
        for batch in batches:
            for path, base in zip(batch.column("path").to_pylist(), batch.column("base").to_pylist()):
                reader = SeekableReader(path)
                documents = reader.documents()
                while True:
                    out = []
                    for doc_id, ids in itertools.islice(documents, READ_DOCS):
                        out.append((doc_id, base, len(ids) // 4, zlib.crc32(ids)))
                        base += len(ids) // 4
                    if not out:
                        break
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], names)
                reader.close()

    listed = spark.createDataFrame(rows, "path string, base long").repartition(max(1, len(rows)))
    return listed.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op2_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = write_token_files(table(spark, sf_dir, "documents"), default_tokenizer(), shared_path(spark, "token-files"))
    return read_token_files(spark, files)
