"""Quality rules with host verdicts (operator 10).

Each text gets rule counts in one vectorised pass.  Rule failures are summed by host, each host's failure rate is
shrunk with a beta prior fitted to all hosts by moments, and hosts whose shrunk rate is over a threshold lose their
documents.  The host table is joined back; Spark broadcasts it only under its own size threshold and splits hot hosts
in a shuffled join otherwise.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import bitmaps
from . import kernels as K
from .scratch import materialise, passing

MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
MAX_SYMBOLS_PER_WORD = 0.5
MAX_DUPLICATE_LINES = 0.5
#: A host whose shrunk failure rate is over this is rejected as a whole.
MAX_HOST_RATE = 0.6
MIN_PRIOR, MAX_PRIOR = 2.0, 1000.0
FEATURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")

_SYMBOLS = np.zeros(256, bool)
_SYMBOLS[[ord(c) for c in "#*$%&|<>"]] = True
_NEWLINE = np.zeros(256, bool)
_NEWLINE[10] = True


def _keys(hashes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Hashes that also differ between documents."""
    doc = np.repeat(np.arange(len(bounds) - 1, dtype=np.uint64), np.diff(bounds))
    return K.mix(hashes + doc * np.uint64(0xC2B2AE3D27D4EB4F))


def rule_counts(chunk: K.Chunk) -> np.ndarray:
    """The columns FEATURES of each document of a chunk."""
    starts, ends, bounds = chunk.spans(K.SPACES)
    prefix = chunk.prefix_hash()
    hashes = chunk.span_hash(prefix, starts, ends)
    data = chunk.data
    chars = chunk.per_doc(((data & 0xC0) != 0x80) & ~K.SPACES[data])
    symbols = chunk.per_doc(_SYMBOLS[data])

    # windows of five words that occur twice in their document cover words
    covered = np.zeros(len(hashes) + 1, np.int64)
    if len(hashes) >= 5:
        rolled = hashes[:-4].copy()
        for i in range(1, 5):
            rolled = rolled * np.uint64(0xD6E8FEB86659FD93) + hashes[i : len(hashes) - 4 + i]
        doc = np.repeat(np.arange(chunk.n), np.diff(bounds))
        whole = np.flatnonzero(doc[:-4] == doc[4:])
        keys = K.mix(K.mix(rolled[whole]) + doc[whole].astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))
        order = np.argsort(keys)
        ordered = keys[order]
        same = np.zeros(len(keys) + 1, bool)
        same[1:-1] = ordered[1:] == ordered[:-1]
        again = whole[order[same[1:] | same[:-1]]]
        np.add.at(covered, again, 1)
        np.add.at(covered, again + 5, -1)
    inside = np.zeros(len(hashes) + 1, np.int64)
    np.cumsum(np.cumsum(covered[:-1]) > 0, out=inside[1:])

    # lines that have a word
    a, b, line_bounds = chunk.spans(_NEWLINE)
    with_word = np.searchsorted(starts, b) > np.searchsorted(starts, a)
    kept = np.zeros(len(a) + 1, np.int64)
    np.cumsum(with_word, out=kept[1:])
    lines = kept[line_bounds]
    keys = _keys(chunk.span_hash(prefix, a[with_word], b[with_word]), lines)
    doc = np.repeat(np.arange(chunk.n), np.diff(lines))
    order = np.argsort(keys)
    repeated = np.zeros(len(keys), bool)
    repeated[1:] = keys[order][1:] == keys[order][:-1]
    duplicates = np.bincount(doc[order[repeated]], minlength=chunk.n)
    return np.stack([np.diff(bounds), chars, symbols, duplicates, inside[bounds[1:]] - inside[bounds[:-1]], np.diff(lines)])


def with_rule_counts(docs: DataFrame, text: str = "text", keep: Sequence[str] = ("doc_id", "source")) -> DataFrame:
    """``keep`` and the counts FEATURES (long) of every whole text; a null text has zeros."""
    keep = list(keep)
    schema = T.StructType([docs.schema[c] for c in keep] + [T.StructField(f"_q_{c}", T.LongType()) for c in FEATURES])
    at = keep.index(text) if text in keep else len(keep)
    source = docs.select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(keep)], *([] if text in keep else [F.col(text).alias("_text")]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [rule_counts(c) for c in K.chunks(batch.column(at))]
            counts = np.concatenate(parts, axis=1) if parts else np.zeros((len(FEATURES), 0), np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], *[pa.array(x, pa.int64()) for x in counts]], names=[*keep, *[f"_q_{c}" for c in FEATURES]])

    return source.mapInArrow(run, schema)


def failures(prefix: str = "_q_") -> dict[str, object]:
    c = {n: F.col(prefix + n) for n in FEATURES}
    return {
        "base_failed": (c["n_words"] < MIN_WORDS) | (100 * c["n_repeat_words"] > MAX_REPEAT_PERCENT * c["n_words"]),
        "many_symbols": c["n_symbols"] > MAX_SYMBOLS_PER_WORD * c["n_words"],
        "many_dup_lines": c["n_dup_lines"] > MAX_DUPLICATE_LINES * c["n_lines"],
    }


def host_verdicts(counted: DataFrame, host: str = "source", max_rate: float = MAX_HOST_RATE) -> DataFrame:
    """One row per host: rows, failed rows (any rule), shrunk rate and ``host_ok``.

    The prior's mean is the overall rate; its weight comes from the variance of the hosts' rates beyond what their
    sizes explain.  A null host is a host of its own.
    """
    failed = None
    for rule in failures().values():
        failed = rule if failed is None else failed | rule
    hosts = counted.groupBy(F.col(host).alias("_host")).agg(F.count("*").alias("host_docs"), F.sum(failed.cast("long")).alias("host_failed"))
    rate = F.col("host_failed") / F.col("host_docs")
    row = hosts.agg(F.sum("host_docs").alias("n"), F.sum("host_failed").alias("f"), F.var_pop(rate).alias("v"), F.avg(1 / F.col("host_docs")).alias("i")).first()
    n, f = row["n"] or 0, row["f"] or 0
    mean = f / n if n else 0.0
    within = mean * (1 - mean)
    between = (row["v"] or 0.0) - within * (row["i"] or 0.0)
    weight = min(MAX_PRIOR, max(MIN_PRIOR, within / between - 1)) if between > 1e-9 else MAX_PRIOR
    shrunk = (F.col("host_failed") + F.lit(weight * mean)) / (F.col("host_docs") + F.lit(weight))
    return hosts.withColumn("host_rate", shrunk).withColumn("host_ok", F.col("host_rate") <= max_rate)


def quality_rules(docs: DataFrame, text: str = "text", host: str = "source", keep: Sequence[str] = ("doc_id",), max_rate: float = MAX_HOST_RATE) -> DataFrame:
    """``keep``, the rule counts, ``base_failed``, the host's ``host_rate`` and ``kept``.

    Null or empty text: zero words, so base_failed.  Null host: judged with the other rows without a host.  Rows that
    repeat are judged row by row.  Empty table: no rows.
    """
    keep = [*keep, *([] if host in keep else [host])]
    counted = materialise(with_rule_counts(docs, text, keep), "quality")
    verdicts = host_verdicts(counted, host, max_rate)
    joined = counted.join(verdicts, counted[host].eqNullSafe(verdicts["_host"]), "left")
    rules = failures()
    return joined.select(
        *keep, *[F.col(f"_q_{c}").alias(c) for c in FEATURES], *[rule.alias(name) for name, rule in rules.items()],
        "host_rate", (~rules["base_failed"] & F.coalesce("host_ok", F.lit(True))).alias("kept"),
    )


#: Bits of the map of rejected hosts (8 MB, whatever their number).
MAP_BITS = 1 << 26


def keep_good(docs: DataFrame, text: str = "text", host: str = "source", max_rate: float = MAX_HOST_RATE) -> DataFrame:
    """The documents that ``quality_rules`` keeps, with all their columns, whatever their names.

    Texts stay where they are: a map of bits tells which rows may belong to a rejected host, and only those are joined
    with the rejected hosts; without any, there is no join.
    """
    mine = [f"_c{i}" for i in range(len(docs.columns))]
    renamed = docs.toDF(*mine)
    text, host = (mine[docs.columns.index(c)] for c in (text, host))
    with passing() as keep:
        verdicts = host_verdicts(materialise(with_rule_counts(renamed, text, [host]), "quality"), host, max_rate)
        rejected = keep(materialise(verdicts.filter("NOT host_ok").select("_host"), "rejected"))
    good = with_rule_counts(renamed, text, mine).filter(~failures()["base_failed"]).select(*mine)
    if not rejected.isEmpty():
        spot = lambda c: F.pmod(F.xxhash64(c), F.lit(MAP_BITS))
        good, asked = bitmaps.split(good, spot(host), bitmaps.pages(rejected.select(spot("_host").alias("at")), "at"))
        good = good.unionByName(asked.join(rejected, asked[host].eqNullSafe(rejected["_host"]), "left_anti"))
    return good.toDF(*docs.columns)


def op10_quality_hosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return quality_rules(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


ORACLE = r"""
WITH w AS (
  SELECT doc_id, source, coalesce(text, '') AS text,
         list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM documents),
g AS (
  SELECT *, CASE WHEN len(words) >= 5 THEN list_transform(range(1, len(words) - 3), lambda i: array_to_string(words[i:i+4], ' ')) ELSE [] END AS grams FROM w),
pairs AS (SELECT doc_id, unnest(grams) AS gram, unnest(range(1, len(grams) + 1)) AS pos FROM g),
twice AS (SELECT doc_id, pos FROM pairs QUALIFY count(*) OVER (PARTITION BY doc_id, gram) > 1),
covered AS (SELECT doc_id, count(DISTINCT pos + k.k) AS n FROM twice, (SELECT unnest(range(0, 5)) AS k) k GROUP BY doc_id),
f AS (
  SELECT g.doc_id, g.source, len(words) AS n_words, coalesce(list_sum(list_transform(words, lambda x: length(x))), 0) AS word_chars,
         length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols, len(lines) AS n_lines,
         len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(c.n, 0) AS n_repeat_words
  FROM g LEFT JOIN covered c USING (doc_id)),
r AS (
  SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
         n_words < 10 OR 100 * n_repeat_words > 20 * n_words OR n_symbols > 0.5 * n_words OR n_dup_lines > 0.5 * n_lines AS failed
  FROM f),
h AS (SELECT source, count(*) AS n, count(*) FILTER (failed) AS f FROM r GROUP BY source),
m AS (SELECT sum(f) / sum(n) AS mean, var_pop(f / n) - (sum(f) / sum(n)) * (1 - sum(f) / sum(n)) * avg(1 / n) AS between_hosts FROM h),
p AS (SELECT mean, CASE WHEN between_hosts > 1e-9 THEN least(1000.0, greatest(2.0, mean * (1 - mean) / between_hosts - 1)) ELSE 1000.0 END AS weight FROM m),
v AS (SELECT source, (f + weight * mean) / (n + weight) <= 0.6 AS ok FROM h, p)
SELECT r.doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols,
       n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words, base_failed, NOT base_failed AND v.ok AS kept
FROM r JOIN v ON r.source IS NOT DISTINCT FROM v.source
"""
