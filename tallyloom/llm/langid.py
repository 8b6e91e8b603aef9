"""Language identification with error-correcting output codes (operator 4).

Every language gets a codeword.  For each bit a binary classifier over hashed byte n-grams (naive Bayes, all labelled
languages weighted alike) gives a log-odds margin.  Loss-weighted decoding sums a logistic loss of the margins against
each codeword, weighted by how well the bit separates its two sides in training; the nearest codeword wins and a
result whose runner-up is close is flagged.

The n-gram counts cover all labelled training rows and are summed by Spark.  What reaches the driver is
languages x BUCKETS counts at most, and the number of languages is checked.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import kernels as K

GRAM = 4
BUCKETS = 1 << 15
MAX_LANGUAGES = 128
#: N-grams of a text depend on each other, so a text counts as this many independent ones at most: margins are mean
#: log-odds times that, and long texts do not become certain by length alone.
EVIDENCE = 40.0
#: A best posterior under this is ambiguous.  ``keep_identified`` asks it of the mean log-odds at EVIDENCE n-grams, a rule
#: that does not depend on a text's length.
CLEAR = 0.6
#: N-grams whose weights are summed at a time.
SLICE = 1 << 16
UNDETERMINED = "und"

_ASCII_LETTER = np.zeros(256, bool)
_ASCII_LETTER[[*range(65, 91), *range(97, 123)]] = True
_HIGH = np.zeros(256, bool)
_HIGH[0xC0:] = True


def codewords(n: int) -> np.ndarray:
    """A matrix of +1 and -1, one row per language: all splits for up to five, else random words far apart."""
    if n <= 1:
        return np.ones((n, 1))
    if n <= 5:
        bits = 2 ** (n - 1) - 1
        return np.array([[1 if i == 0 or not ((b + 1) >> (i - 1)) & 1 else -1 for b in range(bits)] for i in range(n)], float)
    bits, rng = int(np.ceil(10 * np.log2(n))), np.random.Generator(np.random.PCG64(7))
    best, best_distance = None, -1
    for _ in range(200):
        code = rng.choice([-1.0, 1.0], (n, bits))
        code[:, np.abs(code.sum(0)) == n] *= np.where(np.arange(n) % 2, -1, 1)[:, None]
        distance = min(int((code[i] != code[j]).sum()) for i in range(n) for j in range(i))
        if distance > best_distance:
            best, best_distance = code, distance
    return best


@dataclass
class Model:
    languages: list[str]
    code: np.ndarray
    weights: np.ndarray  # BUCKETS x bits
    reliability: np.ndarray  # by bit


def grams(data: np.ndarray) -> np.ndarray:
    """Buckets of the n-grams that start at each byte but the last GRAM - 1."""
    x = np.zeros(max(0, len(data) - GRAM + 1), np.uint32)
    for i in range(GRAM):
        x = (x << np.uint32(8)) | data[i : len(data) - GRAM + 1 + i]
    return ((x * np.uint32(0x9E3779B1)) >> np.uint32(32 - BUCKETS.bit_length() + 1)).astype(np.intp)


def gram_bounds(chunk: K.Chunk) -> tuple[np.ndarray, np.ndarray]:
    """First and last-plus-one n-gram inside each document."""
    return chunk.offsets[:-1], np.maximum(chunk.offsets[:-1], chunk.offsets[1:] - GRAM + 1)


def gram_counts(docs: DataFrame, text: Column, lang: Column) -> DataFrame:
    """(lang, bucket, n) summed over all rows with a language."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[str, np.ndarray] = {}
        for batch in batches:
            langs = batch.column(1).to_pylist()
            for chunk in K.chunks(batch.column(0), lower=True, size=K.CHUNK // 2):
                codes = grams(chunk.data)
                for row, a, b in zip(chunk.rows, *(x.tolist() for x in gram_bounds(chunk)), strict=True):
                    total = totals.setdefault(langs[row], np.zeros(BUCKETS, np.int64))
                    if b > a:
                        total += np.bincount(codes[a:b], minlength=BUCKETS) if b - a > BUCKETS // 8 else 0
                        if b - a <= BUCKETS // 8:
                            np.add.at(total, codes[a:b], 1)
        for name, total in totals.items():
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(total[at], pa.int64())], names=["lang", "bucket", "n"])

    labelled = docs.select(text.alias("text"), lang.alias("lang")).filter("text IS NOT NULL AND lang IS NOT NULL")
    return labelled.mapInArrow(run, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))


def fit(docs: DataFrame, text: str = "text", lang: str = "lang") -> Model:
    """Learn from every row with a text and a language."""
    counted = gram_counts(docs, F.col(text), F.col(lang))
    rows = counted.groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("bucket", "n"))).alias("counts")).orderBy("lang").limit(MAX_LANGUAGES + 1).collect()
    if len(rows) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    languages = [r["lang"] for r in rows]
    code = codewords(len(languages))
    if not languages:
        return Model([], code, np.zeros((BUCKETS, 1), np.float32), np.ones(1))
    p = np.full((len(languages), BUCKETS), 0.5)
    for i, r in enumerate(rows):
        p[i, [c["bucket"] for c in r["counts"]]] += [c["n"] for c in r["counts"]]
    p /= p.sum(1, keepdims=True)
    weights = np.zeros((BUCKETS, code.shape[1]), np.float32)
    for b in range(code.shape[1]):
        plus, minus = p[code[:, b] > 0], p[code[:, b] < 0]
        if len(plus) and len(minus):
            weights[:, b] = np.log(plus.mean(0)) - np.log(minus.mean(0))
    # expected margins of the languages on each bit: a bit whose sides overlap counts less
    margins = (p @ weights) * code
    reliability = np.clip(margins.min(0), 0.05, None)
    return Model(languages, code, weights, reliability / reliability.max())


def _decode(model: Model, margins: np.ndarray, n: np.ndarray, evidence: float = EVIDENCE) -> tuple[np.ndarray, np.ndarray]:
    """Best language and its posterior for each row of margins summed over n n-grams, which count as ``evidence`` at most."""
    scaled = margins / np.maximum(n, 1)[:, None] * np.minimum(np.maximum(n, 0), evidence)[:, None]
    loss = (np.logaddexp(0, -scaled[:, None, :] * model.code[None]) * model.reliability).sum(2)
    score = np.exp(loss.min(1, keepdims=True) - loss)
    score /= score.sum(1, keepdims=True)
    best = score.argmax(1)
    return best, score[np.arange(len(best)), best]


def _sums(weights: np.ndarray, codes: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Sums of the weights of codes[a:b] for each pair of bounds, SLICE codes at a time."""
    out = np.zeros((len(a), weights.shape[1]))
    for lo in range(0, len(codes), SLICE):
        part = np.zeros((min(SLICE, len(codes) - lo) + 1, weights.shape[1]))
        np.cumsum(weights[codes[lo : lo + SLICE]], axis=0, out=part[1:], dtype=np.float64)
        out += part[np.clip(b - lo, 0, len(part) - 1)] - part[np.clip(a - lo, 0, len(part) - 1)]
    return out


_LETTER = re.compile(r"[^\W\d_]")


def identify(docs: DataFrame, model: Model, text: str = "text", keep: Sequence[str] = ("doc_id",)) -> DataFrame:
    """``keep``, ``lang_pred``, ``score`` (0 to 1), ``ambiguous``, ``n_letters`` and ``fits`` of every whole text.

    ``fits`` asks whether the text's n-grams are those of the language on average, whatever their number.  A long text is
    read whole, in slices; beside it a task holds some 20 bytes for each of its bytes.

    A null text, an empty one and one without a letter give ``und`` with score 0, as does a model without languages.
    A text shorter than an n-gram has no evidence: the first codeword at an even score, flagged ambiguous.  Rows that
    repeat get the same answer.  ``n_letters`` counts ASCII letters and other lead bytes, which is enough for a bound.
    """
    keep = list(keep)
    at = keep.index(text) if text in keep else len(keep)
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)
    schema = T.StructType([docs.schema[c] for c in keep] + [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("ambiguous", T.BooleanType()), T.StructField("n_letters", T.LongType()), T.StructField("fits", T.BooleanType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        names = np.array([*m.languages, UNDETERMINED], object)
        for batch in batches:
            column = batch.column(at)
            size = batch.num_rows
            best, score, letters, fits = np.full(size, len(m.languages)), np.zeros(size), np.zeros(size, np.int64), np.zeros(size, bool)
            for chunk in K.chunks(column, lower=True, size=K.CHUNK // 2):
                rows = slice(chunk.first, chunk.first + chunk.n)
                codes = grams(chunk.data)
                a, b = gram_bounds(chunk)
                b = np.minimum(b, len(codes))
                a = np.minimum(a, b)
                if m.languages:
                    margins = _sums(m.weights, codes, a, b)
                    best[rows], score[rows] = _decode(m, margins, b - a)
                    # too short for an n-gram: nothing speaks against the text
                    fits[rows] = (b == a) | (_decode(m, margins * (EVIDENCE / np.maximum(b - a, 1))[:, None], np.full(len(a), EVIDENCE))[1] >= CLEAR)
                letters[rows] = chunk.per_doc(_ASCII_LETTER[chunk.data])
                high = chunk.per_doc(_HIGH[chunk.data])
                for i in np.flatnonzero((letters[rows] == 0) & (high > 0)):
                    value = column[int(i) + chunk.first].as_py()
                    letters[chunk.first + i] = len(_LETTER.findall(value)) if _LETTER.search(value) else 0
                letters[rows] += np.where(letters[rows] > 0, high, 0)
            none = letters == 0
            best[none], score[none] = len(m.languages), 0
            out = [pa.array(names[best], pa.string()), pa.array(score), pa.array((score < CLEAR) & ~none), pa.array(letters, pa.int64()), pa.array(fits & ~none)]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], *out], names=schema.names)

    return docs.select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(keep)], *([] if text in keep else [F.col(text).alias("_text")])).mapInArrow(run, schema)


def training_rows(docs: DataFrame, doc_id: str = "doc_id") -> Column:
    """False for the held-out quarter (and for rows without an id)."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 4 != 2, F.lit(False))


def keep_identified(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """All columns of the documents that a language fits: ``und`` goes, and so do texts of any length whose n-grams no
    language accounts for better than the others."""
    columns = docs.columns
    renamed = docs.select(*[F.col(c).alias(f"_c{i}") for i, c in enumerate(columns)])
    seen = identify(renamed, model, f"_c{columns.index(text)}", renamed.columns)
    good = seen.filter((F.col("lang_pred") != UNDETERMINED) & F.col("fits"))
    return good.select(*[F.col(f"_c{i}").alias(c) for i, c in enumerate(columns)])


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = fit(docs.filter(training_rows(docs)))
    held_out = docs.select("doc_id", "text", F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False)).alias("held_out"))
    return identify(held_out, model, keep=("doc_id", "held_out")).select("doc_id", "held_out", "lang_pred", "score", "ambiguous")
