"""The registered queries of this subpackage, thin over its operators, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import public_tokenizers
from factloom.llm import bpe, codes, infill, language, mixing, near_duplicates, neighbours, passages, pii, quality_rules, secrets, topk, toxicity
from factloom.llm.common import fold, table


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.tokenise(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op2_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, 5)


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2(secrets.joined(F.col("base_spans")), 256).alias("base_sha256"), secrets.joined(F.col("spans")).alias("spans"))


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = lambda: F.coalesce(fold("doc_id", 3) == 1, F.lit(False))
    model = language.learn(docs, ~held_out())
    return language.identify(docs, model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "accepted")


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = lambda: F.coalesce(fold("doc_id", 5) == 0, F.lit(False))
    docs = table(spark, sf_dir, "documents")
    model = toxicity.learn(docs, table(spark, sf_dir, "labels").where(~held_out()))
    return toxicity.score(docs, model).select("doc_id", held_out().alias("held_out"), "score", "predicted")


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.in_training_order(mixing.mix(table(spark, sf_dir, "documents"))).select("doc_id", "size", "source_size", "target", "taken", "position", "second_position", "source")


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    rules = quality_rules.learn(docs, table(spark, sf_dir, "labels"))
    return quality_rules.apply_rules(docs, rules).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rule")


def op8_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.extract(table(spark, sf_dir, "documents").select("doc_id", "text"))
    count = lambda i, kind: F.size(F.filter("base", lambda s: s["kind"] == i)).cast("long").alias(f"n_{kind}")
    base = pii.joined(F.col("base"))
    return found.select("doc_id", *[count(i, k) for i, k in enumerate(pii.KINDS)], F.sha2(base, 256).alias("base_sha256"), pii.joined(F.concat("base", "more")).alias("spans"))


def op9_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates.near_duplicates(table(spark, sf_dir, "documents"), k=3, percent=85)


def op10_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.repeated(table(spark, sf_dir, "documents"))


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codes.compress(table(spark, sf_dir, "embeddings"), parts=16, entries=64, rounds=2)


def op12_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, 20)


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = infill.transform(table(spark, sf_dir, "documents"), "char")
    restored = infill.restore(F.col("output"), F.col("form"))
    return cut.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(restored, 256).alias("restored_sha256"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_byte_bpe": op1_byte_bpe,
    "op2_exact_topk": op2_exact_topk,
    "op3_secret_scan": op3_secret_scan,
    "op4_language": op4_language,
    "op5_toxicity": op5_toxicity,
    "op6_mixing": op6_mixing,
    "op7_quality_rules": op7_quality_rules,
    "op8_personal_data": op8_personal_data,
    "op9_near_duplicates": op9_near_duplicates,
    "op10_repeated_passages": op10_repeated_passages,
    "op11_vector_codes": op11_vector_codes,
    "op12_nearest_neighbours": op12_nearest_neighbours,
    "op13_fill_in_middle": op13_fill_in_middle,
}

_SHINGLED = """
        WITH RECURSIVE w AS (
            SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w
            FROM documents
        ), s AS (
            SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
                ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) END AS s
            FROM w
        ), x AS (
            SELECT doc_id, len(s) AS n, unnest(s) AS x FROM s
        ), links AS (
            SELECT a.doc_id AS a, b.doc_id AS b
            FROM x a JOIN x b ON a.x = b.x AND a.doc_id <> b.doc_id AND 100 * least(a.n, b.n) >= 85 * greatest(a.n, b.n)
            GROUP BY a.doc_id, b.doc_id, a.n, b.n
            HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))
        ), reach AS (
            SELECT doc_id AS a, doc_id AS b FROM s
            UNION
            SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a
        ), least AS (
            SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a
        )
        SELECT s.doc_id, CAST(len(s) AS BIGINT) AS n_shingles, component_id, s.doc_id = component_id AS kept
        FROM s JOIN least USING (doc_id)"""

#: op11: each round holds every part of every vector against every entry of its codebook.
_ROUND = """, near{i} AS (
            SELECT x.row, x.p, arg_min(e.j, list_sum(list_transform(range(1, len(x.v) + 1), lambda t: (x.v[t] - e.v[t]) * (x.v[t] - e.v[t]))) * 64 + e.j) AS j
            FROM x JOIN book{i} e USING (p) GROUP BY x.row, x.p
        )"""
_MEAN = """, sums{i} AS (
            SELECT p, j, t, CAST(floor(sum(v[t]) / count(*)) AS BIGINT) AS c
            FROM near{i} JOIN x USING (row, p), generate_series(1, 4) g(t) GROUP BY p, j, t
        ), book{n} AS (
            SELECT b.p, b.j, CASE WHEN count(s.c) = 0 THEN any_value(b.v) ELSE list(s.c ORDER BY s.t) END AS v
            FROM book{i} b LEFT JOIN sums{i} s ON b.p = s.p AND b.j = s.j GROUP BY b.p, b.j
        )"""
_CODES = f"""
        WITH k AS (
            SELECT row_number() OVER (ORDER BY vec_id) AS row, vec_id, label,
                   list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
            FROM embeddings
            WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), x AS (
            SELECT row, p, v[p * (len(v) // 16) + 1:(p + 1) * (len(v) // 16)] AS v FROM k, range(16) r(p)
        ), book0 AS (
            SELECT p, row - 1 AS j, v FROM x WHERE row <= 64
        ){_ROUND.format(i=0)}{_MEAN.format(i=0, n=1)}{_ROUND.format(i=1)}{_MEAN.format(i=1, n=2)}{_ROUND.format(i=2)}, done AS (
            SELECT n.row, string_agg(printf('%02x', n.j), '' ORDER BY n.p) AS code,
                   CAST(sum(list_sum(list_transform(range(1, len(x.v) + 1), lambda t: (x.v[t] - e.v[t]) * (x.v[t] - e.v[t])))) AS BIGINT) AS error
            FROM near2 n JOIN x USING (row, p) JOIN book2 e ON e.p = n.p AND e.j = n.j GROUP BY n.row
        ), digest AS (
            SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY p, j)) AS codebooks_sha256 FROM book2
        )
        SELECT k.vec_id, code, error, CAST(sum(error) OVER (PARTITION BY k.label) AS BIGINT) AS label_error, codebooks_sha256
        FROM done JOIN k USING (row), digest"""

_INFILL = """
        WITH h AS (
            SELECT doc_id, coalesce(text, '') AS t, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents
        ), d AS (
            SELECT doc_id, t, length(t) AS n, CAST('0x' || h[1:8] AS BIGINT) AS h1, CAST('0x' || h[9:16] AS BIGINT) AS h2, CAST('0x' || h[17:24] AS BIGINT) AS h3, CAST('0x' || h[25:32] AS BIGINT) AS h4 FROM h
        ), c AS (
            SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
                   CASE WHEN n = 0 OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain'
                        WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form
            FROM d
        ), o AS (
            SELECT *, substr(t, 1, a) AS p, substr(t, a + 1, b - a) AS m, substr(t, b + 1) AS s FROM c
        )
        SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
               sha256(CASE form WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m WHEN 'spm' THEN '<S>' || s || '<P>' || p || '<M>' || m ELSE t END) AS output_sha256,
               sha256(t) AS restored_sha256
        FROM o"""

ORACLES: dict[str, str] = {
    "op11_vector_codes": _CODES,
    "op13_fill_in_middle": _INFILL,
    "op9_near_duplicates": _SHINGLED,
    "op2_exact_topk": """
        WITH v AS (
            SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
            FROM embeddings
            WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), s AS (
            SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
                   CAST(list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * c.v[i])) AS BIGINT) AS score
            FROM v q JOIN v c ON c.vec_id <> q.vec_id
            WHERE q.vec_id % 50 = 0
        )
        SELECT query_id, rank, vec_id, score
        FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s) t
        WHERE rank <= 5""",
}
