"""SentencePiece encoding and decoding by a distinct-chunk table (operator 10).

Where no piece of a model crosses a whitespace mark, a text is the sequence of
its marked words, and every distinct marked word is segmented once per task
(``chunks.ChunkTable``); ids are joined back by position. Models with such
pieces, or with a normaliser or whitespace rules that look across words, are
encoded whole by the library.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .chunks import ChunkTable
from .shared import slices, small_batches, table, texts_of

MARK = "▁"
#: Words that a worker's table holds.
MAX_ENTRIES = 150_000
#: Bytes of text that are encoded and decoded at a time: their ids are Python numbers for a moment.
SLICE = 2 << 20
#: Texts with one of these are encoded whole: they may hold what a model treats apart.
_ODD = re.compile("[\x00▁�\ud800-\udfff]")


@lru_cache(1)
def codec_for(model_path: str) -> "Codec":
    """One codec, and so one table, for all tasks of a Python worker."""
    return Codec(model_path)


class Codec:
    """Exactly what the library gives for encode(text) and decode(ids)."""

    def __init__(self, model_path: str, add_bos: bool = True, add_eos: bool = True):
        import sentencepiece

        self.sp = sp = sentencepiece.SentencePieceProcessor(model_file=model_path)
        pieces = [sp.id_to_piece(i) for i in range(sp.get_piece_size())]
        self.head = np.asarray([sp.bos_id()] if add_bos and sp.bos_id() >= 0 else [], "<u4").tobytes()
        self.tail = np.asarray([sp.eos_id()] if add_eos and sp.eos_id() >= 0 else [], "<u4").tobytes()
        self.by_chunk = not any(re.search(f"[^{MARK}]{MARK}", p) for p in pieces) and self._plain()
        mark = sp.piece_to_id(MARK)
        self.table = ChunkTable(
            lambda chunks: sp.encode(" ".join(chunks)) if chunks != [""] else [mark],
            np.array([p.startswith(MARK) for p in pieces]),
            first=None,
            odd=_ODD,
            max_entries=MAX_ENTRIES,
        )

    def _plain(self) -> bool:
        """No normaliser that changes texts, a mark put before them, all white space kept."""
        sp = self.sp
        probe = [" a  b ", "a\tb\n", "Ａéé", "　x"]
        return all(sp.decode(sp.encode(t)) == t for t in probe) and sp.encode("a") == sp.encode("a b")[:1]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text with begin and end ids, as little-endian unsigned 32-bit integers."""
        if not self.by_chunk:
            return [self.head + np.asarray(self.sp.encode(t), "<u4").tobytes() + self.tail for t in texts]
        body = self.table.encode_all(texts)
        for k, ids in enumerate(body):
            if ids is None:
                body[k] = np.asarray(self.sp.encode(texts[k]), "<u4").tobytes()
        return [self.head + b + self.tail for b in body]

    def decode(self, ids: list[bytes]) -> list[str]:
        return [self.sp.decode(np.frombuffer(b, "<u4").tolist()) for b in ids]


def _digests(model_path: str):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_for(model_path)
        for batch in slices(batches, 1000, most=SLICE):
            ids = codec.encode(texts_of(batch, "text"))
            out = codec.decode(ids)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id").cast(pa.int64()),
                    pa.array([len(b) // 4 for b in ids], pa.int64()),
                    pa.array([hashlib.sha256(b).hexdigest() for b in ids], pa.string()),
                    pa.array([hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in out], pa.string()),
                ],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return run


def encode_documents(docs: DataFrame, model_path: str) -> DataFrame:
    """doc_id, ids (array of int with begin and end ids), decoded text.

    A null text counts as the empty text: begin and end ids alone, decoded to
    "". Repeated rows give repeated results; null doc_ids stay null; other
    columns are left aside; an empty table gives no rows.
    """
    small_batches(docs.sparkSession)

    def run(batches):
        codec = codec_for(model_path)
        for batch in slices(batches, 1000, most=SLICE):
            ids = codec.encode(texts_of(batch, "text"))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").cast(pa.int64()), pa.array([np.frombuffer(b, "<u4").astype("<i4") for b in ids], pa.list_(pa.int32())), pa.array(codec.decode(ids), pa.string())],
                ["doc_id", "ids", "decoded"],
            )

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, ids array<int>, decoded string")


def codec_digests(docs: DataFrame, model_path: str) -> DataFrame:
    """Per row of docs: doc_id, n_tokens, ids_sha256, decoded_sha256; cases as in encode_documents."""
    small_batches(docs.sparkSession)
    return docs.select("doc_id", "text").mapInArrow(_digests(model_path), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op10_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codec_digests(table(spark, sf_dir, "documents"), default_model())
