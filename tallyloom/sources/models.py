"""External models as plain functions, called on Arrow batches with retries; tests and offline runs use stubs."""

from __future__ import annotations

import hashlib
import time
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BATCH = 32


def with_retry(call: Callable, attempts: int = 3, wait: float = 0.5, transient: tuple[type[Exception], ...] = (ConnectionError, TimeoutError, OSError)) -> Callable:
    """A function that calls again after a transient error, each time after twice the wait."""

    def run(*args):
        for i in range(attempts):
            try:
                return call(*args)
            except transient:
                if i == attempts - 1:
                    raise
                time.sleep(wait * 2**i)
        return None

    return run


def error_class(error: Exception) -> str:
    """timeout, connection, http or other: whether to go on with the next row or to give up."""
    if isinstance(error, TimeoutError):
        return "timeout"
    if isinstance(error, (ConnectionError, OSError)):
        return "connection"
    return "http" if "http" in type(error).__name__.lower() else "other"


def hash_embedding(texts: Sequence[str], size: int = 64) -> list[list[float]]:
    """A stub: word counts in hashed places, of length one."""
    out = []
    for text in texts:
        v = [0.0] * size
        for w in (text or "").lower().split():
            v[int.from_bytes(hashlib.blake2b(w.encode(), digest_size=4).digest(), "big") % size] += 1.0
        norm = sum(x * x for x in v) ** 0.5
        out.append([x / norm for x in v] if norm else v)
    return out


def embed(rows: DataFrame, function: Callable[[Sequence[str]], list[list[float]]] = hash_embedding, text: str = "text", batch: int = BATCH) -> DataFrame:
    """Adds ``embedding``; the function gets BATCH texts at a time and must return as many vectors."""
    call = with_retry(function)

    def run(series: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in series:
            out: list[list[float]] = []
            for i in range(0, len(s), batch):
                part = s.iloc[i : i + batch].fillna("").tolist()
                got = call(part)
                if len(got) != len(part):
                    raise ValueError("the model returned another number of vectors")
                out += got
            yield pd.Series(out)

    return rows.withColumn("embedding", F.pandas_udf(run, "array<float>")(F.col(text)))


def ask(rows: DataFrame, function: Callable[[str], str], prompt: str = "prompt") -> DataFrame:
    """Adds ``answer`` and ``error`` (its class); a failing row does not fail the others."""
    call = with_retry(function)
    schema = rows.drop("answer", "error").schema.add("answer", "string").add("error", "string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            answers, errors = [], []
            for p in b.column(b.schema.get_field_index(prompt)).to_pylist():
                try:
                    answers.append(call(p or ""))
                    errors.append(None)
                except Exception as e:  # noqa: BLE001
                    answers.append(None)
                    errors.append(error_class(e))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(answers, pa.string()), pa.array(errors, pa.string())], names=[*b.schema.names, "answer", "error"])

    return rows.drop("answer", "error").mapInArrow(run, schema)


def prompts(fields: DataFrame, windows: DataFrame, head: str) -> DataFrame:
    """(entity_id, prompt): fields and numbered evidence below a heading, in order."""
    listed = lambda df, line: df.groupBy("entity_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", line.alias("t")))), lambda x: x["t"]), "\n").alias("_t"))
    f = listed(fields, F.concat(F.lit("- "), F.col("label"), F.lit(": "), F.coalesce("description", F.lit("")))).withColumnRenamed("_t", "_f")
    w = listed(windows, F.concat(F.lit("["), F.col("ord").cast("string"), F.lit("] "), F.col("text"))).withColumnRenamed("_t", "_w")
    return f.join(w, "entity_id", "left").select("entity_id", F.concat_ws("\n\n", F.lit(head), "_f", "_w").alias("prompt"))
