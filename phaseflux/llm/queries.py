"""The queries of this subpackage: each applies an operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import byte_bpe, centroid_clustering, divergence_audit, embedding_dedup, exact_dedup, html_text, language_id, minhash_dedup, packing, quality, secret_scan, substring_dedup, url_filter
from .scratch import Scratch

#: (host, path, verdict) of the URL rules.
RULES = (("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block"))


def vocabulary(name: str) -> str:
    """Place of a public tokenizer's file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_vectors(_table(spark, sf_dir, "embeddings"), Scratch(spark))


def op2_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_dedup.near_dedup(_table(spark, sf_dir, "documents"), Scratch(spark), size=2)


def op3_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(_table(spark, sf_dir, "pages"))


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = vocabulary("byte_bpe_50k.tiktoken")
    coded = byte_bpe.bpe_round_trip(_table(spark, sf_dir, "documents"), path)
    joined = F.array_join(F.col("ids").cast("array<string>"), " ")
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(joined, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(_table(spark, sf_dir, "documents"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score_quality(_table(spark, sf_dir, "documents"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"), Scratch(spark), vocabulary("byte_bpe_50k.json"))


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(_table(spark, sf_dir, "documents"), Scratch(spark))


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge_urls(_table(spark, sf_dir, "pages"), RULES)


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring_dedup.substring_dedup(_table(spark, sf_dir, "documents"), Scratch(spark))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


def op11_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = secret_scan.scan(_table(spark, sf_dir, "documents"), Scratch(spark))
    names = F.array(*map(F.lit, secret_scan.KINDS))
    listed = lambda x: F.array_join(F.transform(x, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ",")
    number = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    count = [number(kind).alias(f"n_{name}") for kind, name in enumerate(secret_scan.KINDS[:3])]
    base = F.filter("spans", lambda s: s["kind"] < 3)
    return spans.select("doc_id", *count, F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))


def op12_divergence_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence_audit.audit(_table(spark, sf_dir, "documents"), Scratch(spark))


def op13_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = centroid_clustering.cluster(_table(spark, sf_dir, "embeddings"), Scratch(spark))
    return out.withColumn("centroid_sha256", F.sha2(F.array_join("centroid", ","), 256)).drop("centroid")


def _centroid_sql(k: int = 8, rounds: int = 10, seed: int = 3) -> str:
    """Every round as a query of its own: the numbers of the nearest centroids, then the floors of the means."""
    steps = [
        f"""
            x AS MATERIALIZED (
                SELECT vec_id, list_transform(embedding, lambda e: floor(1024 * e::DOUBLE)::HUGEINT) AS v FROM embeddings
                WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0),
            x1 AS MATERIALIZED (SELECT vec_id, unnest(v) AS e, unnest(range(64)) AS d FROM x),
            c0 AS MATERIALIZED (
                SELECT c, unnest(v) AS e, unnest(range(64)) AS d
                FROM (SELECT v, row_number() OVER (ORDER BY sha256('{seed}:' || vec_id)) - 1 AS c FROM x QUALIFY c < {k}))"""
    ]
    for r in range(rounds + 1):
        steps.append(f"""
            a{r} AS MATERIALIZED (
                SELECT vec_id, min_by(c, dist * {k} + c) AS c, min(dist) AS dist
                FROM (SELECT vec_id, c, sum((x1.e - c{r}.e) * (x1.e - c{r}.e)) AS dist FROM x1 JOIN c{r} USING (d) GROUP BY vec_id, c) GROUP BY vec_id)""")
        if r < rounds:
            steps.append(f"""
            c{r + 1} AS MATERIALIZED (
                SELECT o.c, o.d, CASE WHEN m.n IS NULL THEN o.e ELSE (m.s - ((m.s % m.n) + m.n) % m.n) // m.n END AS e
                FROM c{r} o LEFT JOIN (SELECT c, d, sum(e) AS s, count(*) AS n FROM x1 JOIN a{r} USING (vec_id) GROUP BY c, d) m USING (c, d))""")
    return "WITH" + ",".join(steps) + f""",
            h AS (SELECT c, sha256(string_agg(e::VARCHAR, ',' ORDER BY d)) AS h FROM c{rounds} GROUP BY c)
            SELECT vec_id, c::INT AS cluster, dist::BIGINT AS distance, (sum(dist) OVER (PARTITION BY c))::BIGINT AS cluster_inertia,
                (sum(dist) OVER ())::BIGINT AS inertia, h AS centroid_sha256
            FROM a{rounds} JOIN h USING (c)"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (
        op1_embedding_dedup, op2_minhash_dedup, op3_html_text, op4_byte_bpe, op5_language_id, op6_quality, op7_packing, op8_exact_dedup, op9_url_filter, op10_substring_dedup,
        op11_secret_scan, op12_divergence_audit, op13_centroid_clustering,
    )}


def oracle_sql() -> dict[str, str]:
    """DuckDB's SQL for the queries that SQL expresses on whole tables."""
    space = r"'[\x20\x09-\x0D]+'"
    return {
        "op12_divergence_audit": r"""
            WITH d AS (
                SELECT row_number() OVER () AS doc, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
                    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents),
            t AS MATERIALIZED (SELECT doc, lang, source, unnest(terms) AS term FROM d),
            k AS MATERIALIZED (SELECT lang, term, count(*) AS all_n FROM t GROUP BY lang, term HAVING count(DISTINCT doc) >= 3),
            c AS MATERIALIZED (SELECT lang, source, term, count(*) AS n FROM t SEMI JOIN k USING (lang, term) GROUP BY ALL),
            v AS (SELECT lang, count(*) AS v, sum(all_n) AS all_total FROM k GROUP BY lang),
            s AS (SELECT lang, source, sum(n) AS total FROM c GROUP BY ALL),
            g AS MATERIALIZED (
                SELECT lang, source, coalesce(total, 0)::HUGEINT AS total, coalesce(v, 0)::HUGEINT AS v, coalesce(all_total, 0)::HUGEINT AS all_total
                FROM (SELECT DISTINCT lang, source FROM d) LEFT JOIN s USING (lang, source) LEFT JOIN v USING (lang)),
            p AS MATERIALIZED (
                SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, 1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 1)) // (g.total + g.v) AS p,
                    1 + (1000000000::HUGEINT * (k.all_n + 1)) // (g.all_total + g.v) AS q
                FROM g JOIN k USING (lang) LEFT JOIN c ON (c.lang, c.source, c.term) = (g.lang, g.source, k.term)),
            f AS (SELECT x.lang, x.source, y.source AS item, sum((x.p - y.p) * (x.p - y.p) // y.p) AS value FROM p x JOIN p y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY ALL),
            r AS (
                SELECT x.lang, x.source, 'pair' AS part, y.source AS item, coalesce(f.value, 0) AS value
                FROM g x JOIN g y ON x.lang = y.lang AND x.source <> y.source LEFT JOIN f ON (f.lang, f.source, f.item) = (x.lang, x.source, y.source)
                UNION ALL SELECT lang, source, 'term', term, (p - q) * (p - q) // q FROM p WHERE n > 0 AND p > q)
            SELECT lang, source, part, item, value::BIGINT AS value, (row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item))::INT AS rank
            FROM r QUALIFY part = 'pair' OR rank <= 200""",
        "op13_centroid_clustering": _centroid_sql(),
        "op8_exact_dedup": f"""
            WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), {space}, ' ', 'g') AS plain FROM documents)
            SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = min(doc_id) OVER w AS kept, sha256(plain) AS text_sha256
            FROM t WINDOW w AS (PARTITION BY plain)""",
        "op9_url_filter": r"""
            WITH u AS (
                SELECT page_id, CASE WHEN contains(url, '://') THEN regexp_extract(substr(url, strpos(url, '://') + 3), '^[^?#]*') ELSE '' END AS rest FROM pages),
            s AS (
                SELECT page_id, translate(regexp_extract(rest, '^[^/]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                    CASE WHEN contains(rest, '/') THEN substr(rest, strpos(rest, '/')) ELSE '' END AS path FROM u),
            r(h, p, verdict) AS (VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
            m AS (
                SELECT s.page_id, s.host, s.path, arg_max(r.h || r.p, length(r.h || r.p)) AS rule, arg_max(r.verdict, length(r.h || r.p)) AS verdict
                FROM s LEFT JOIN r ON (s.host = r.h OR s.host LIKE '%.' || r.h) AND starts_with(s.path, r.p)
                GROUP BY s.page_id, s.host, s.path)
            SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM m""",
        "op1_embedding_dedup": """
            WITH RECURSIVE v AS (
                SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings),
            l AS (
                SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id
                WHERE list_cosine_similarity(a.e, b.e) >= 0.93),
            reach(a, b) AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM reach r JOIN l ON r.b = l.a),
            n AS (SELECT a, count(*) AS n FROM l GROUP BY a),
            c AS (SELECT a, min(b) AS c FROM reach GROUP BY a)
            SELECT v.vec_id, coalesce(n.n, 0)::BIGINT AS n_links, least(v.vec_id, coalesce(c.c, v.vec_id)) AS component_id, v.vec_id = least(v.vec_id, coalesce(c.c, v.vec_id)) AS kept
            FROM v LEFT JOIN n ON n.a = v.vec_id LEFT JOIN c ON c.a = v.vec_id""",
        "op2_minhash_dedup": f"""
            WITH RECURSIVE w AS (
                SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), {space}), lambda x: x <> '') AS w FROM documents),
            g AS (SELECT DISTINCT doc_id, CASE WHEN len(w) = 1 THEN w ELSE list_slice(w, i, i + 1) END AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w), 2))) AS i FROM w WHERE len(w) > 0)),
            n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY 1),
            h AS (SELECT doc_id, n, s FROM g JOIN n USING (doc_id)),
            i AS (SELECT a.doc_id AS a, b.doc_id AS b, any_value(a.n) AS x, any_value(b.n) AS y, count(*) AS c FROM h a JOIN h b ON a.s = b.s AND a.doc_id < b.doc_id AND 100 * a.n >= 80 * b.n AND 100 * b.n >= 80 * a.n GROUP BY 1, 2),
            l0 AS (SELECT a, b FROM i WHERE 100 * c >= 80 * (x + y - c)),
            l AS (SELECT a, b FROM l0 UNION ALL SELECT b, a FROM l0),
            reach(a, b) AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM reach r JOIN l ON r.b = l.a),
            c AS (SELECT a, min(b) AS c FROM reach GROUP BY a)
            SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, least(d.doc_id, coalesce(c.c, d.doc_id)) AS component_id, d.doc_id = least(d.doc_id, coalesce(c.c, d.doc_id)) AS kept FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN c ON c.a = d.doc_id""",
        "op10_substring_dedup": f"""
            WITH d AS (
                SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), {space}), lambda x: x <> '') AS w FROM documents),
            k AS (
                SELECT doc_id, i, list_slice(w, i, i + 12) AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM d WHERE len(w) >= 13)),
            f AS (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY g) AS first FROM k),
            c AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS pos FROM f WHERE first < doc_id),
            g AS (SELECT doc_id, list(pos) AS gone, count(*) AS n FROM c GROUP BY doc_id)
            SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(g.n, 0)::BIGINT AS n_removed,
                sha256(array_to_string(list_filter(d.w, lambda x, j: NOT list_contains(coalesce(g.gone, []), j)), ' ')) AS kept_sha256
            FROM d LEFT JOIN g USING (doc_id)""",
    }
