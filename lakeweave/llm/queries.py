"""The registered query of each corpus operator, and its SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lakeweave.llm import embed_dedup, exact_dedup, fill_middle, html_extract, ngram_join, packing, piece_codec, quality, sharding, source_audit, suffix_dedup, toxicity, warc
from lakeweave.sources.io import spread


def _tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def op1_kk_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(_table(spark, sf_dir, "documents"), n_shards=40)


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(_table(spark, sf_dir, "documents"), keep="largest")


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return quality.score_quality(docs, quality.fit_quality(docs, _table(spark, sf_dir, "labels")))


def op4_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.near_duplicates(_table(spark, sf_dir, "documents"), n=5, threshold=0.8, recall=0.9999)


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.removal_digests(_table(spark, sf_dir, "documents"), window=200)


def op6_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed_dedup.near_vectors(_table(spark, sf_dir, "embeddings"), threshold=0.98)


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = warc.archive_round_trip(_table(spark, sf_dir, "pages"))
    return got.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "whole")


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return toxicity.score_toxicity(docs, toxicity.fit_toxicity(docs, _table(spark, sf_dir, "labels")))


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_table(spark, sf_dir, "documents"), _tokenizer("word_bpe_49k.json"))


def op10_piece_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_codec.encoding_digests(_table(spark, sf_dir, "documents"), _tokenizer("piece_bpe_32k.model"))


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_audit.source_divergence(_table(spark, sf_dir, "documents"), least_docs=30, top=50)


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_middle.middle_digests(_table(spark, sf_dir, "documents"), seed=1, plain_share=10, spm_share=20)


def op13_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.main_texts(_table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_kk_sharding, op2_exact_dedup, op3_quality_classifier, op4_ngram_join, op5_suffix_dedup, op6_embedding_near_dedup, op7_warc, op8_toxicity, op9_best_fit_packing, op10_piece_codec, op11_source_divergence, op12_fill_in_middle, op13_html_extraction)}


def oracle_sql() -> dict[str, str]:
    return {
        "op4_ngram_join": """
            WITH RECURSIVE w AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '\\s+'), lambda x: x <> '') AS w FROM documents),
            g AS (SELECT doc_id, list_sort(list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
                  ELSE list_transform(generate_series(1, len(w) - 4), lambda i: array_to_string(w[i:i + 4], ' ')) END)) AS g FROM w),
            c AS (SELECT g, min(doc_id) AS class_id, count(*) AS size FROM g WHERE len(g) > 0 GROUP BY g),
            e AS (SELECT class_id, size, len(g) AS n, unnest(g) AS gram FROM c),
            p AS (SELECT a.class_id AS a, b.class_id AS b, any_value(b.size) AS size FROM e a JOIN e b ON a.gram = b.gram AND a.class_id <> b.class_id
                  GROUP BY 1, 2 HAVING count(*) >= 0.8 * (any_value(a.n) + any_value(b.n) - count(*)) - 1e-6),
            l AS (SELECT a, sum(size)::BIGINT AS links FROM p GROUP BY a),
            r AS (SELECT class_id AS id, class_id AS to_ FROM c UNION SELECT r.id, p.b FROM r JOIN p ON r.to_ = p.a),
            k AS (SELECT id, min(to_) AS component FROM r GROUP BY id)
            SELECT g.doc_id, coalesce(c.class_id, g.doc_id) AS class_id, (coalesce(links, 0) + coalesce(size, 1) - 1)::BIGINT AS n_links,
                   coalesce(component, g.doc_id) AS component_id, g.doc_id = coalesce(component, g.doc_id) AS kept
            FROM g LEFT JOIN c USING (g) LEFT JOIN l ON l.a = c.class_id LEFT JOIN k ON k.id = c.class_id""",
        "op6_embedding_near_dedup": """
            WITH RECURSIVE v AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings),
            u AS (SELECT vec_id, label, e FROM v WHERE label IS NOT NULL AND list_dot_product(e, e) > 0),
            p AS (SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.label = b.label AND a.vec_id <> b.vec_id
                  WHERE list_dot_product(a.e, b.e) / sqrt(list_dot_product(a.e, a.e)) / sqrt(list_dot_product(b.e, b.e)) >= 0.98),
            r AS (SELECT vec_id AS id, vec_id AS to_ FROM v UNION SELECT r.id, p.b FROM r JOIN p ON r.to_ = p.a),
            k AS (SELECT id, min(to_) AS component_id FROM r GROUP BY id)
            SELECT v.vec_id, (SELECT count(*) FROM p WHERE p.a = v.vec_id) AS n_links, component_id, v.vec_id = component_id AS kept
            FROM v JOIN k ON k.id = v.vec_id""",
        "op7_warc": """
            WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
            g AS (SELECT *, strlen(h) >= 1000 AND page_id <> max(page_id) OVER (PARTITION BY h) AS again, max(page_id) OVER (PARTITION BY h) AS stored FROM p)
            SELECT page_id, strlen(h) AS payload_bytes, sha1(h) AS payload_digest,
                   CASE WHEN again THEN 'revisit' ELSE 'response' END AS record_type,
                   CASE WHEN again THEN stored END AS refers_to, true AS whole FROM g""",
        "op11_source_divergence": r"""
            WITH d AS (SELECT row_number() OVER () AS doc, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
                       unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents),
            grp AS (SELECT DISTINCT coalesce(lang, '') AS lang, coalesce(source, '') AS source FROM documents),
            v AS (SELECT lang, term, count(*) AS n FROM d GROUP BY ALL HAVING count(DISTINCT doc) >= 30),
            size AS (SELECT lang, count(*) AS v, sum(n) AS n FROM v GROUP BY lang),
            c AS (SELECT lang, source, term, count(*) AS c FROM d SEMI JOIN v USING (lang, term) GROUP BY ALL),
            total AS (SELECT lang, source, sum(c) AS n FROM c GROUP BY ALL),
            p AS (SELECT grp.lang, grp.source, v.term, coalesce(c, 0) AS c, v.n AS lang_c,
                  (1 + 1000000000::HUGEINT * (coalesce(c, 0) + 5) // (coalesce(total.n, 0) + 5 * size.v))::BIGINT AS p,
                  (1 + 1000000000::HUGEINT * (v.n + 5) // (size.n + 5 * size.v))::BIGINT AS q
                  FROM grp JOIN v USING (lang) JOIN size USING (lang) LEFT JOIN total USING (lang, source) LEFT JOIN c USING (lang, source, term)),
            pair AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
            every AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0)::BIGINT AS value FROM grp a JOIN grp b ON a.lang = b.lang AND a.source <> b.source
                      LEFT JOIN pair ON pair.lang = a.lang AND pair.source = a.source AND pair.item = b.source
                      UNION ALL SELECT lang, source, 'term', term, p - q FROM p WHERE c > 0 AND p > q),
            r AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank FROM every)
            SELECT lang, source, part, item, value, rank FROM r WHERE part = 'pair' OR rank <= 50""",
        "op12_fill_in_middle": r"""
            WITH d AS (SELECT doc_id, coalesce(text, '') AS text, sha256('1:' || doc_id) AS h, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]', 0, 's') AS u FROM documents),
            n AS (SELECT *, len(u) AS n, ('0x' || h[1:8])::BIGINT AS h1, ('0x' || h[9:16])::BIGINT AS h2, ('0x' || h[17:24])::BIGINT AS h3, ('0x' || h[25:32])::BIGINT AS h4 FROM d),
            c AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
                  CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM n),
            p AS (SELECT *, coalesce(array_to_string(u[1:a], ''), '') AS pre, coalesce(array_to_string(u[a + 1:b], ''), '') AS mid, coalesce(array_to_string(u[b + 1:], ''), '') AS suf FROM c)
            SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(pre) END::BIGINT AS prefix_chars, CASE WHEN form <> 'plain' THEN length(mid) END::BIGINT AS middle_chars,
                   sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256,
                   sha256(text) AS restored_sha256 FROM p""",
        "op13_html_extraction": r"""
            WITH b AS (SELECT page_id, url, string_split_regex(regexp_extract(coalesce(html, ''), '<article>(.*?)</article>', 1, 's'), '</?(?:p|h1)>') AS b FROM pages),
            t AS (SELECT page_id, url, list_transform(b, lambda x: trim(regexp_replace(
                  regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(x, '<[^>]*>', '', 'g'), '&quot;?', '"', 'g'), '&lt;?', '<', 'g'), '&gt;?', '>', 'g'), '&amp;?', '&', 'g'), '\s+', ' ', 'g'))) AS b FROM b)
            SELECT page_id, url, array_to_string(list_filter(b, lambda x: x <> ''), chr(10)) AS text, length(array_to_string(list_filter(b, lambda x: x <> ''), chr(10)))::BIGINT AS n_chars FROM t""",
        "op2_exact_dedup": """
            SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
                   doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
            FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))""",
    }
