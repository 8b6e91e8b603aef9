"""Documents, pages, conversations and vectors: chunks, searches, paths, facts, budgets and scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text
from ..operators import documents, paths, scoring, search
from ..sources.tables import table, with_row_id

STOP = ("there", "which", "their")
FILTERS = paths.PathFilters(extension="", excluded_names=("fr",), exclude_words=("ref=x",), profile_exclude_words=("page=3",), include_words=("page=1", "page=2", "example"))
PROFILES = (("english", ("/en/",)), ("second", ("page=2", "page=4")))
VOCABULARY = {"limit": ("page", "track"), "nav": ("href",)}


def top_terms(spark, d):
    return search.top_terms(table(spark, d, "documents").select("lang", "text"), ["lang"], n=5, stop=STOP)


def chunk_fixed(spark, d):
    c = search.chunks_fixed(table(spark, d, "documents").select("doc_id", "text"))
    return c.select("doc_id", "chunk", "start", F.length("text").alias("length"), F.md5("text").alias("text_md5"))


def chunk_natural(spark, d):
    return search.chunks_natural(table(spark, d, "documents").select("doc_id", "text"))


def lexical_topk(spark, d):
    chunks = search.chunks_fixed(table(spark, d, "documents").select("doc_id", "text"))
    return search.lexical_topk(chunks, "the license of this version is public under general terms", 10).select("doc_id", "chunk", F.round("score", 6).alias("score"))


def cosine_topk(spark, d):
    v = table(spark, d, "embeddings").select("vec_id", "embedding", "label")
    q = v.filter("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    return search.cosine_topk(q, v, 6, where=F.col("label") < 8).select("query_id", "vec_id", F.round("score", 5).alias("score"), "rank")


def doc_dedupe_hash(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("hash"))
    return docs.groupBy("hash").agg(F.min("doc_id").alias("first"), F.count("*").alias("copies"))


def keyword_verdict(spark, d):
    words = F.array(*map(F.lit, ("license", "Éau", "version 3", "ungen")))
    docs = table(spark, d, "documents").select("doc_id", scoring.keyword_verdict(F.col("text"), words).alias("k"))
    return docs.select("doc_id", F.array_join("k.matched", "|").alias("matched"), F.array_join("k.missing", "|").alias("missing"), F.col("k.ratio").alias("ratio"))


def path_verdict(spark, d):
    pages = table(spark, d, "pages").select("page_id", "url")
    return pages.select("page_id", paths.path_verdict(F.col("url"), FILTERS).alias("v")).select("page_id", "v.kept", "v.reason", "v.matched")


def group_by_folder(spark, d):
    pages = table(spark, d, "pages").select(F.col("page_id").alias("row_id"), F.regexp_replace("url", "^https?://", "").alias("path"))
    return paths.dossiers(pages, paths.PathFilters(extension="")).select("dossier", "first", F.size("rows").alias("files"))


def profile_detect(spark, d):
    pages = table(spark, d, "pages").select("page_id", "url")
    return paths.detect_profile(pages, PROFILES, "other", text="url").select("page_id", "profile")


def budget_prefix(spark, d):
    c = table(spark, d, "conversations").select("conv_id", "turn", "text")
    out = search.budget_prefix(c, ["conv_id"], ["turn"], "text", 600)
    return out.select("conv_id", "turn", F.length("text").alias("chars"))


def rag_context(spark, d):
    c = table(spark, d, "conversations").select("conv_id", "turn", "role", "text")
    return search.rag_context(c, ["conv_id"], "turn", label=F.col("role")).select("conv_id", "hits", F.md5("context").alias("context_md5"))


def label_normalised(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "text")
    return docs.select("doc_id", F.md5(text.normalise_label(F.col("text"))).alias("label_md5"), F.md5(text.letters_and_digits(F.col("text"))).alias("plain_md5"), text.useful_length(F.col("text")).alias("useful"))


def point_ids(spark, d):
    return table(spark, d, "documents").select("doc_id", text.point_id(F.col("source"), F.col("doc_id")).alias("point"))


def numeric_facts(spark, d):
    pages = table(spark, d, "pages").select("page_id", F.col("html").alias("text"))
    return documents.facts_index(documents.numeric_facts(pages, VOCABULARY))


def page_pairs(spark, d):
    pages = table(spark, d, "orders").select(
        F.col("o_orderkey").alias("page_id"),
        F.concat(F.lit("Order: "), F.col("o_orderkey").cast("string"), F.lit("  Total: "), F.format_string("%.2f", "o_totalprice"), F.lit("\nStatus    Opened\n"), F.rpad("o_orderstatus", 10, " "), F.date_format("o_orderdate", "dd/MM/yyyy")).alias("page"),
    )
    return documents.label_value_pairs(pages)


def page_batches(spark, d):
    docs = table(spark, d, "documents").select("source", "doc_id", "text")
    return documents.page_batches(docs, "source", ["doc_id"], "text", 20_000).select("source", "batch", F.length("text").alias("chars"))


def eval_score(spark, d):
    labels = table(spark, d, "labels")
    expected = labels.select(F.col("doc_id").cast("string").alias("field_id"), F.col("quality").cast("string").alias("value"), F.lit("exact").alias("mode"), F.array(F.lit("9")).alias("forbidden"))
    docs = table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("field_id"), F.when(F.col("n_chars") % 11 == 0, "").when(F.col("n_chars") % 13 == 0, "9").when(F.col("n_chars") > 1000, "1").otherwise("0").alias("value"))
    out = scoring.score_extraction(expected, docs)
    return out.select(*[c for c in out.columns if not c.endswith("rate")], *[F.round(c, 9).alias(c) for c in out.columns if c.endswith("rate")])


def numbered_rows(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "source", "lang", F.md5("text").alias("text_md5"))
    return with_row_id(docs, "source", "doc_id")


QUERIES = {f.__name__: f for f in (top_terms, chunk_fixed, chunk_natural, lexical_topk, cosine_topk, doc_dedupe_hash, keyword_verdict, path_verdict, group_by_folder, profile_detect, budget_prefix, rag_context, label_normalised, point_ids, numeric_facts, page_pairs, page_batches, eval_score, numbered_rows)}

_SQUEEZE = r"trim(regexp_replace({0}, '[\s\x{{00A0}}]+', ' ', 'g'))"
_PLAIN = "regexp_replace(lower(strip_accents({0})), '[^a-z0-9]+', ' ', 'g')"
_CHUNKS = rf"""s AS (SELECT doc_id, {_SQUEEZE.format('text')} AS s FROM documents),
c AS (SELECT doc_id, s, unnest(range(0, greatest(1, ceil((len(s) - 100) / 700.0)::INT))) AS chunk FROM s WHERE s <> ''),
k AS (SELECT doc_id, chunk::INT AS chunk, (chunk * 700)::INT AS start, substr(s, (chunk * 700 + 1)::INT, 800) AS text FROM c)"""
_WORDS = r"list_filter(regexp_split_to_array(lower({0}), '[^\p{{L}}\p{{N}}_]+'), lambda w: len(w) >= 3)"
ORACLES = {
    "top_terms": f"""WITH t AS (SELECT lang, unnest(string_split(trim({_PLAIN.format('text')}), ' ')) AS term FROM documents),
      c AS (SELECT lang, term, count(*) AS "count" FROM t WHERE len(term) >= 5 AND NOT regexp_full_match(term, '[0-9]+') AND term NOT IN {STOP} GROUP BY 1, 2)
      SELECT *, row_number() OVER (PARTITION BY lang ORDER BY "count" DESC, term)::INT AS rank FROM c QUALIFY rank <= 5""",
    "chunk_fixed": f"WITH {_CHUNKS} SELECT doc_id, chunk, start, len(text)::INT AS length, md5(text) AS text_md5 FROM k",
    "lexical_topk": f"""WITH {_CHUNKS}, w AS (SELECT doc_id, chunk, {_WORDS.format('text')} AS t FROM k),
      h AS (SELECT doc_id, chunk, len(t) AS n, len(list_filter(t, lambda x: list_contains(['the', 'license', 'this', 'version', 'public', 'under', 'general', 'terms'], x))) AS m FROM w)
      SELECT doc_id, chunk, round(m + 10.0 * m / greatest(n, 1), 6) AS score FROM h WHERE m > 0 ORDER BY round(m + 10.0 * m / greatest(n, 1), 9) DESC, doc_id, chunk LIMIT 10""",
    "cosine_topk": """WITH p AS (SELECT q.vec_id AS query_id, v.vec_id, round(list_cosine_similarity(q.embedding::DOUBLE[], v.embedding::DOUBLE[]), 9) AS s FROM embeddings q, embeddings v WHERE q.vec_id % 50 = 0 AND v.label < 8)
      SELECT query_id, vec_id, round(s, 5) AS score, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, vec_id)::INT AS rank FROM p QUALIFY rank <= 6""",
    "doc_dedupe_hash": "SELECT sha256(text) AS hash, min(doc_id) AS first, count(*) AS copies FROM documents GROUP BY 1",
    "keyword_verdict": f"""WITH t AS (SELECT doc_id, trim({_PLAIN.format('text')}) AS t FROM documents),
      k AS (SELECT doc_id, list_filter(['license', 'Éau', 'version 3', 'ungen'], lambda k: contains(t, trim({_PLAIN.format('k')}))) AS m FROM t)
      SELECT doc_id, array_to_string(m, '|') AS matched, array_to_string(list_filter(['license', 'Éau', 'version 3', 'ungen'], lambda k: NOT list_contains(m, k)), '|') AS missing, len(m) / 4.0::DOUBLE AS ratio FROM k""",
    "path_verdict": """WITH p AS (SELECT page_id, lower(url) AS p, list_filter(string_split(lower(url), '/'), lambda s: s <> '') AS s FROM pages),
      v AS (SELECT page_id, p, len(list_filter(s, lambda x: starts_with(x, '.') OR starts_with(x, '~$') OR x IN ('fr', '__macosx', 'thumbs.db', 'desktop.ini', '$recycle.bin', 'system volume information'))) > 0 AS named FROM p)
      SELECT page_id, NOT named AND NOT contains(p, 'ref=x') AND NOT contains(p, 'page=3') AND (contains(p, 'page=1') OR contains(p, 'page=2') OR contains(p, 'example')) AS kept,
        CASE WHEN named THEN 'excluded_name' WHEN contains(p, 'ref=x') THEN 'exclude_word' WHEN contains(p, 'page=3') THEN 'profile_exclude_word' WHEN NOT (contains(p, 'page=1') OR contains(p, 'page=2') OR contains(p, 'example')) THEN 'include_word' END AS reason,
        CASE WHEN named THEN NULL WHEN contains(p, 'ref=x') THEN 'ref=x' WHEN contains(p, 'page=3') THEN 'page=3' WHEN contains(p, 'page=1') THEN 'page=1' WHEN contains(p, 'page=2') THEN 'page=2' WHEN contains(p, 'example') THEN 'example' END AS matched FROM v""",
    "group_by_folder": """WITH p AS (SELECT page_id, list_filter(string_split(regexp_replace(url, '^https?://', ''), '/'), lambda s: s <> '') AS s FROM pages)
      SELECT CASE WHEN len(s) < 2 THEN '#' || page_id ELSE array_to_string(s[1:len(s) - 1], '/') END AS dossier, min(page_id) AS first, count(*)::INT AS files FROM p
      WHERE len(list_filter(s, lambda x: starts_with(x, '.') OR starts_with(x, '~$'))) = 0 GROUP BY 1""",
    "profile_detect": "SELECT page_id, CASE WHEN contains(lower(url), '/en/') THEN 'english' WHEN contains(lower(url), 'page=2') OR contains(lower(url), 'page=4') THEN 'second' ELSE 'other' END AS profile FROM pages",
    "budget_prefix": r"""WITH c AS (SELECT conv_id, turn, text, len(regexp_replace(text, '[\s\x{00A0}]+', ' ', 'g')) AS cost FROM conversations),
      b AS (SELECT *, row_number() OVER w AS n, coalesce(sum(cost) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM c WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
      SELECT conv_id, turn, CASE WHEN n > 1 AND before + cost > 600 THEN least(len(text), 600 - before) ELSE len(text) END::INT AS chars FROM b WHERE n = 1 OR before < 600""",
    "rag_context": "WITH n AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM conversations) SELECT conv_id, count(*) AS hits, md5(string_agg('[' || n || '] ' || role || chr(10) || text, chr(10) || chr(10) ORDER BY n)) AS context_md5 FROM n GROUP BY 1",
    "label_normalised": rf"""SELECT doc_id, md5({_SQUEEZE.format("regexp_replace(lower(strip_accents(text)), '[-‐-―/_:;]+', ' ', 'g')")}) AS label_md5, md5(regexp_replace(lower(strip_accents(text)), '[^a-z0-9]', '', 'g')) AS plain_md5,
      len(regexp_replace(text, '[\s\x{{00A0}}]+', ' ', 'g'))::INT AS useful FROM documents""",
    "point_ids": "WITH h AS (SELECT doc_id, sha1(source || '|' || doc_id) AS h FROM documents) SELECT doc_id, h[1:8] || '-' || h[9:12] || '-5' || h[14:16] || '-8' || h[18:20] || '-' || h[21:32] AS point FROM h",
    "page_pairs": """WITH o AS (SELECT o_orderkey AS page_id, printf('%.2f', o_totalprice) AS total, strftime(o_orderdate, '%d/%m/%Y') AS day FROM orders)
      SELECT page_id, 1 AS row, 'Order' AS label, page_id::VARCHAR AS value, NULL::INT AS "column" FROM o UNION ALL SELECT page_id, 1, 'Total', total, NULL FROM o UNION ALL SELECT page_id, 2, 'Opened', day, 10 FROM o""",
    "page_batches": r"""WITH p AS (SELECT source, doc_id, text, len(regexp_replace(text, '[\s\x{00A0}]+', ' ', 'g')) AS u FROM documents WHERE trim(text, ' ') <> ''),
      c AS (SELECT source, doc_id, CASE WHEN u > 20000 THEN left(text, 20000) ELSE text END AS t FROM p), d AS (SELECT source, doc_id, len(t) AS n, len(regexp_replace(t, '[\s\x{00A0}]+', ' ', 'g')) AS cost FROM c),
      l AS (SELECT source, list_reduce(list({'cost': cost, 'done': []::BIGINT[], 'now': n::BIGINT, 'used': cost + 2} ORDER BY doc_id), lambda x, y: CASE WHEN x.used + y.cost + 2 > 20000
        THEN {'cost': y.cost, 'done': list_append(x.done, x.now), 'now': y.now, 'used': y.cost + 2} ELSE {'cost': y.cost, 'done': x.done, 'now': x.now + 2 + y.now, 'used': x.used + y.cost + 2} END) AS s FROM d GROUP BY 1)
      SELECT source, unnest(range(0, len(s.done) + 1))::INT AS batch, unnest(list_append(s.done, s.now))::INT AS chars FROM l""",
    "eval_score": """WITH a AS (SELECT doc_id, CASE WHEN n_chars % 11 = 0 THEN '' WHEN n_chars % 13 = 0 THEN '9' WHEN n_chars > 1000 THEN '1' ELSE '0' END AS v FROM documents),
      j AS (SELECT l.quality::VARCHAR AS e, nullif(a.v, '') AS v FROM labels l LEFT JOIN a USING (doc_id)),
      c AS (SELECT count(*) AS expected, count(*) FILTER (v = e) AS exact, 0::BIGINT AS normalized, count(*) FILTER (v <> e AND v <> '9') AS mismatch, count(*) FILTER (v IS NULL) AS missing, count(*) FILTER (v = '9') AS forbidden FROM j)
      SELECT *, (SELECT count(*) FROM a WHERE v <> '' AND doc_id NOT IN (SELECT doc_id FROM labels)) AS extra, round(exact / expected, 9) AS exact_rate, round(exact / expected, 9) AS match_rate, round((mismatch + forbidden) / (expected - missing), 9) AS hallucination_rate FROM c""",
    "numbered_rows": "SELECT doc_id, source, lang, md5(text) AS text_md5, row_number() OVER (ORDER BY source, doc_id) - 1 AS row_id FROM documents",
}
