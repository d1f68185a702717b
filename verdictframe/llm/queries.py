"""One query for each operator: it applies the operator to its whole table and gives its full result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from verdictframe.llm import bpe, counts, divergence, golay, langid, neardup, packing, pages, secrets, spelling, topk, warc, winnow
from verdictframe.llm.common import table

Query = Callable[[SparkSession, str], DataFrame]


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(table(spark, sf_dir, "documents"))


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(secrets.find_secrets(table(spark, sf_dir, "documents")))


def op3_host_consensus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.extract(table(spark, sf_dir, "pages"))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counts.token_counts(table(spark, sf_dir, "documents"))


def op5_warc_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op6_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return winnow.edited(table(spark, sf_dir, "documents"))


def op7_curve_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents")).drop("ids")


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = langid.identify(docs.select("doc_id", "text"), langid.learn(docs))
    return found.select("doc_id", langid.held_out().alias("held_out"), "lang_pred", "score")


def op9_bagminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.classes(table(spark, sf_dir, "documents"))


def op10_term_at_a_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return topk.top_k(vectors, vectors["vec_id"] % 50 == 0, 5)


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(table(spark, sf_dir, "documents"))


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.divergence(table(spark, sf_dir, "documents"))


def op13_golay_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return golay.clusters(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        op1_byte_bpe,
        op2_secret_scan,
        op3_host_consensus,
        op4_token_counts,
        op5_warc_index,
        op6_winnowing,
        op7_curve_packing,
        op8_language_id,
        op9_bagminhash,
        op10_term_at_a_time,
        op11_spelling_variants,
        op12_source_divergence,
        op13_golay_simhash,
    )
}
ORACLES: dict[str, str] = {
    "op10_term_at_a_time": """
        WITH whole AS (
            SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
            FROM embeddings
            WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
              AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        scored AS (
            SELECT q.vec_id AS query_id, c.vec_id,
                   CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
            FROM whole q JOIN whole c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0)
        SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
        FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored)
        WHERE rank <= 5
    """,
    "op11_spelling_variants": """
        WITH RECURSIVE runs AS (
            SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS id, unnest(regexp_extract_all(text, '[A-Za-z\u00C0-\u00FF]+')) AS run FROM documents),
        each AS (
            SELECT id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run, count(*) AS n FROM runs GROUP BY 1, 2),
        bytes AS (
            SELECT run, n, list_transform(range(CAST(strlen(id || ':' || run) AS BIGINT)), lambda i:
                CAST('0x' || substr(hex(encode(id || ':' || run)), CAST(2 * i + 1 AS INTEGER), 2) AS BIGINT)) AS b FROM each),
        hashed AS (
            SELECT run, n, xor(list_reduce(b, lambda a, x: list_reduce([0, 1, 2, 3, 4, 5, 6, 7], lambda c, i:
                CASE WHEN c & 1 = 1 THEN xor(c >> 1, CAST(3988292384 AS BIGINT)) ELSE c >> 1 END, xor(a, x)), CAST(4294967295 AS BIGINT)), CAST(4294967295 AS BIGINT)) AS h
            FROM bytes),
        results AS (
            SELECT CASE WHEN h % 97 = 0 THEN substr(run, 1, CAST(h % length(run) AS INTEGER)) || substr(run, CAST(h % length(run) + 2 AS INTEGER)) ELSE run END AS word, n FROM hashed),
        words AS (
            SELECT word, CAST(sum(n) AS BIGINT) AS n FROM results WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3),
        less AS (
            SELECT DISTINCT word, n, i, substr(word, 1, CAST(i - 1 AS INTEGER)) || substr(word, CAST(i + 1 AS INTEGER)) AS rest
            FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words)),
        near AS (
            SELECT a.word, b.word AS other, b.n FROM less a JOIN less b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
            UNION SELECT a.word, b.word, b.n FROM less a JOIN words b ON a.rest = b.word
            UNION SELECT b.word, a.word, a.n FROM less a JOIN words b ON a.rest = b.word),
        best AS (
            SELECT word, count(*) AS n_near, min({'less': -n, 'form': other}) AS best FROM near GROUP BY word),
        forms AS (
            SELECT w.word, w.n, coalesce(b.n_near, 0) AS n_near, CASE WHEN -b.best.less >= 2 * w.n THEN b.best.form END AS form,
                   CASE WHEN -b.best.less >= 2 * w.n THEN -b.best.less END AS form_n
            FROM words w LEFT JOIN best b ON w.word = b.word),
        walk AS (
            SELECT word, form AS root FROM forms WHERE form IS NOT NULL
            UNION ALL SELECT walk.word, f.form FROM walk JOIN forms f ON walk.root = f.word WHERE f.form IS NOT NULL),
        ends AS (
            SELECT walk.word, walk.root FROM walk JOIN forms f ON walk.root = f.word WHERE f.form IS NULL)
        SELECT f.word, f.form, coalesce(e.root, f.word) AS root, f.n, CAST(f.n_near AS BIGINT) AS n_near, CAST(f.form_n AS BIGINT) AS form_n
        FROM forms f LEFT JOIN ends e ON f.word = e.word
    """,
    "op12_source_divergence": """
        WITH docs AS (
            SELECT row_number() OVER () AS doc, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
                   translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
        found AS (
            SELECT doc, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM docs),
        kept AS (
            SELECT lang, term FROM found GROUP BY lang, term HAVING count(DISTINCT doc) >= 3),
        counts AS (
            SELECT f.lang, f.source, f.term, CAST(count(*) AS HUGEINT) AS n FROM found f JOIN kept k ON f.lang = k.lang AND f.term = k.term GROUP BY ALL),
        sizes AS (SELECT lang, CAST(count(*) AS HUGEINT) AS v FROM kept GROUP BY lang),
        all_groups AS (SELECT DISTINCT lang, source FROM docs),
        sums AS (SELECT lang, source, sum(n) AS total FROM counts GROUP BY lang, source),
        shares AS (
            SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, 1 + (CAST(1000000000 AS HUGEINT) * (coalesce(c.n, 0) + 1)) // (coalesce(s.total, 0) + z.v) AS p
            FROM all_groups g JOIN kept k ON g.lang = k.lang JOIN sizes z ON g.lang = z.lang
            LEFT JOIN counts c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term
            LEFT JOIN sums s ON s.lang = g.lang AND s.source = g.source),
        language AS (
            SELECT c.lang, c.term, 1 + (CAST(1000000000 AS HUGEINT) * (sum(c.n) + 1)) // (any_value(t.total) + any_value(z.v)) AS q
            FROM counts c JOIN (SELECT lang, sum(n) AS total FROM counts GROUP BY lang) t ON c.lang = t.lang JOIN sizes z ON c.lang = z.lang GROUP BY c.lang, c.term),
        pair AS (
            SELECT a.lang, a.source, 'pair' AS part, b.source AS item,
                   coalesce((SELECT sum(((x.p - y.p) * (x.p - y.p)) // y.p) FROM shares x JOIN shares y ON x.lang = y.lang AND x.term = y.term
                             WHERE x.lang = a.lang AND x.source = a.source AND y.source = b.source), 0) AS value
            FROM all_groups a JOIN all_groups b ON a.lang = b.lang AND a.source <> b.source),
        special AS (
            SELECT s.lang, s.source, 'term' AS part, s.term AS item, ((s.p - l.q) * (s.p - l.q)) // l.q AS value
            FROM shares s JOIN language l ON s.lang = l.lang AND s.term = l.term WHERE s.n > 0 AND s.p > l.q)
        SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank
        FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM (SELECT * FROM pair UNION ALL SELECT * FROM special))
        WHERE part = 'pair' OR rank <= 200
    """,
}
