"""Token counts of fields and sections by offset-mapped attribution (operator 8).

A document is its fields joined by a separator; its last field is cut further into sections (lines).  The whole document
is encoded once, so tokens are those of the text as it will be trained on.  Each token's span follows from the bytes it
stands for; spans are joined to the sections' intervals, and a token that crosses a boundary goes, by rule,

* ``most``: to the section that holds most of its bytes, the earlier one on a tie;
* ``first``: to the section of its first byte.

Separators belong to the section before them.  Section boundaries never lie inside a character, so byte spans and
character spans order tokens and sections alike.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .scratch import worker_cache

RULES = ("most", "first")
SEPARATOR = "\n"


def byte_encoder(path: str, pattern: str):
    """A rank file's encoder and the byte length of each id, once per worker."""
    cache = worker_cache()
    if ("ranks", path) not in cache:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        size = np.zeros(max(ranks.values()) + 1, np.int64)
        size[list(ranks.values())] = [len(x) for x in ranks]
        cache["ranks", path] = tiktoken.Encoding("tallyloom", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}), size
    return cache["ranks", path]


def allocate(ends: np.ndarray, bounds: np.ndarray, rule: str) -> np.ndarray:
    """The section of each token: token i spans ends[i - 1]..ends[i], section j spans bounds[j]..bounds[j + 1]."""
    starts = np.append(0, ends[:-1])
    first = np.searchsorted(bounds, starts, "right") - 1
    if rule == "first":
        return first
    last = np.searchsorted(bounds, ends - 1, "right") - 1
    out = first.copy()
    best = np.minimum(ends, bounds[np.minimum(first + 1, len(bounds) - 1)]) - starts
    crossing = np.flatnonzero(last > first)
    step = 1
    while len(crossing):
        j = first[crossing] + step
        share = np.minimum(ends[crossing], bounds[j + 1]) - np.maximum(starts[crossing], bounds[j])
        more = share > best[crossing]
        out[crossing[more]], best[crossing[more]] = j[more], share[more]
        step += 1
        crossing = crossing[last[crossing] >= first[crossing] + step]
    return out


def token_attribution(docs: DataFrame, ranks: str, pattern: str, fields: Sequence[str] = ("text",), doc_id: str = "doc_id", rule: str = "most", separator: str = SEPARATOR) -> DataFrame:
    """A row per section: doc_id, field, section (from 0 within its field), start, length (bytes), n_tokens, n_crossing.

    All but the last of ``fields`` are one section each; the last one has a section per line.  A null field is an empty
    one and has one empty section.  ``n_crossing`` counts the section's tokens that reach into another section.  Every
    token of the document is counted once.  Rows that repeat are counted row by row; an empty table gives no rows.
    """
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    fields = list(fields)
    schema = T.StructType([T.StructField("doc_id", docs.schema[doc_id].dataType), T.StructField("field", T.StringType())] + [T.StructField(c, T.LongType()) for c in ("section", "start", "length", "n_tokens", "n_crossing")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, width = byte_encoder(ranks, pattern)
        for batch in batches:
            values = [pc.fill_null(batch.column(i + 1), "").to_pylist() for i in range(len(fields))]
            held, room = [], 0
            for row, parts in enumerate(zip(*values, strict=True)):
                cuts, names, numbers, at = [0], [], [], 0
                for k, part in enumerate(parts[:-1]):
                    at += len((part + separator).encode())
                    cuts.append(at)
                    names.append(k)
                    numbers.append(0)
                raw = np.frombuffer(parts[-1].encode(), np.uint8)
                breaks = np.flatnonzero(raw == 10) + 1
                inner = np.append(breaks[breaks < len(raw)], len(raw)) + at
                cuts = np.append(np.array(cuts), inner)
                names += [len(fields) - 1] * len(inner)
                numbers += range(len(inner))
                ids = np.array(encoder.encode_ordinary(separator.join(parts)), np.int64)
                ends = np.cumsum(width[ids])
                if len(ids):
                    owner = allocate(ends, cuts, rule)
                    n = np.bincount(owner, minlength=len(cuts) - 1)
                    starts = ends - width[ids]
                    across = np.bincount(owner, (starts < cuts[owner]) | (ends > cuts[owner + 1]), minlength=len(cuts) - 1).astype(np.int64)
                else:
                    n = across = np.zeros(len(cuts) - 1, np.int64)
                held.append((row, names, numbers, cuts[:-1], np.diff(cuts), n, across))
                room += len(cuts)
                if room > 100_000:
                    yield _rows(batch, held, fields, schema)
                    held, room = [], 0
            if held:
                yield _rows(batch, held, fields, schema)

    return docs.select(F.col(doc_id).alias("_id"), *[F.col(c).alias(f"_f{i}") for i, c in enumerate(fields)]).mapInArrow(run, schema)


def _rows(batch: pa.RecordBatch, held: list, fields: list[str], schema: T.StructType) -> pa.RecordBatch:
    times = [len(h[1]) for h in held]
    ids = batch.column(0).take(pa.array(np.repeat([h[0] for h in held], times)))
    names = pa.array(np.array(fields, object)[np.concatenate([h[1] for h in held])], pa.string())
    return pa.RecordBatch.from_arrays([ids, names, *[pa.array(np.concatenate([h[i] for h in held]), pa.int64()) for i in range(2, 7)]], names=schema.names)


def op8_token_attribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return token_attribution(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, ("source", "lang", "text"))
