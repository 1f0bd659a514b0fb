"""Readers and writers: texts, benchmark files, configuration, checkpoints, model replies (SRC-1..7, SRC-12..14, SNK-9)."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def texts(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, text of whole files (SRC-1)."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("doc_id"), F.col("value").alias("text"))


def records(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of a JSON array or, for other names, of a CSV file with a header; none if the file is missing (SRC-2, SRC-3)."""
    try:
        if path.endswith(".json"):
            return spark.read.schema(schema).json(path, multiLine=True)
        return spark.read.schema(schema).csv(path, header=True)
    except AnalysisException:
        return spark.createDataFrame([], schema)


def merged(defaults: dict, over: dict) -> dict:
    """Nested settings with those of a file over the defaults (SRC-5)."""
    out = dict(defaults)
    for k, v in over.items():
        out[k] = merged(out[k], v) if isinstance(v, dict) and isinstance(out.get(k), dict) else v
    return out


def read_json(spark: SparkSession, path: str):
    """What one JSON file holds, through the file system that the path names; None if it is missing or broken."""
    try:
        rows = spark.read.text(path, wholetext=True).limit(1).collect()
        return json.loads(rows[0].value) if rows else None
    except (AnalysisException, ValueError):
        return None


def load_config(spark: SparkSession, path: str, defaults: dict) -> dict:
    """Settings from a JSON file over the defaults; the defaults if it is missing or broken (SRC-5)."""
    got = read_json(spark, path)
    return merged(defaults, got) if isinstance(got, dict) else dict(defaults)


def nested(config: dict, path: str, default=None):
    """The value at a dotted path (MAP-1)."""
    for key in path.split("."):
        if not isinstance(config, dict) or key not in config:
            return default
        config = config[key]
    return config


def api_config(spark: SparkSession, path: str) -> dict:
    """Settings of a text service with defaults for each key; the file must be there (SRC-6)."""
    if not isinstance(got := read_json(spark, path), dict):
        raise FileNotFoundError(f"no settings in {path}")
    return {"base_url": "", "timeout": 30, "max_retries": 3, "rate_limit": 10_000} | got


# A small training set to begin with (SRC-7).
SAMPLE_TEXTS = [
    "Diabetes mellitus is a chronic metabolic disorder.",
    "Metformin is commonly used to treat type 2 diabetes.",
    "Insulin resistance is a key feature of type 2 diabetes.",
]
SAMPLE_TRIPLES = [("diabetes", "C0011849", "treats", "metformin", [2156, 23421], 0.95, "UMLS"), ("metformin", "C0025598", "inhibits", "diabetes", [23421, 2156], 0.92, "UMLS")]


def sample_texts(spark: SparkSession) -> DataFrame:
    """doc_id, text of the built-in training texts (SRC-7)."""
    return spark.createDataFrame(list(enumerate(SAMPLE_TEXTS)), "doc_id long, text string")


def sample_triples(spark: SparkSession) -> DataFrame:
    """The built-in seed triples (SRC-7)."""
    return spark.createDataFrame(SAMPLE_TRIPLES, "head string, head_kb_id string, relation string, tail string, tail_tokens array<int>, score double, source string")


def write_json(spark: SparkSession, path: str, value: dict | list) -> None:
    """Settings as one JSON file, through the file system that the path names (SNK-9); what was there is replaced."""
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    out = p.getFileSystem(spark._jsc.hadoopConfiguration()).create(p, True)
    try:
        out.write(bytearray(json.dumps(value, indent=2, sort_keys=True).encode()))
    finally:
        out.close()


def checkpoint_of(model_type: str, parameters: int, config: dict | None, timestamp: str, version: str = "0.1.0") -> dict:
    """What a checkpoint file says of a model; weights are not part of it (SNK-9, SRC-4)."""
    return {"model_type": model_type, "version": version, "timestamp": timestamp, "model_params": parameters, "config": config, "description": f"{model_type} model checkpoint"}


def model_info(spark: SparkSession, path: str, model_type: str) -> dict | None:
    """A saved model's description, or None if it is missing, broken or of another type (SRC-4)."""
    got = load_config(spark, path, {})
    return got if got.get("model_type") == model_type else None


def complete(prompts: DataFrame, backend: Callable[[], Callable[[list[str]], list[str]]] | None = None) -> DataFrame:
    """prompts (prompt, ...) with reply and error from a backend that each worker opens once (SRC-12..14).

    backend() gives a function of a list of prompts; without one, replies are
    empty, error says so and no prompt leaves the JVM. A batch that fails has
    its error, not its job.
    """
    if backend is None:
        return prompts.withColumn("reply", F.lit("")).withColumn("error", F.lit("no backend"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fn = backend()
        for batch in batches:
            asked = batch.column("prompt").to_pylist()
            try:
                replies, errors = fn(asked), [None] * len(asked)
            except Exception as e:  # noqa: BLE001
                replies, errors = [""] * len(asked), [str(e)] * len(asked)
            yield batch.append_column("reply", pa.array(replies, pa.string())).append_column("error", pa.array(errors, pa.string()))

    from pyspark.sql import types as T

    return prompts.mapInArrow(run, T.StructType([*prompts.schema.fields, T.StructField("reply", T.StringType()), T.StructField("error", T.StringType())]))
