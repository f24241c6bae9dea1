"""The registered queries of this folder's operators, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import bottomk, bpe_codec, bwt_dedup, exact_dedup, hilbert_packing, language_id, merkle_manifest, minhash_forest, pii_bootstrap, source_audit, token_files, url_trust, warc_archive


def tokenizer_file(name: str) -> str:
    """Where a public vocabulary lies; the operators take any path."""
    import public_tokenizers

    return public_tokenizers.path(name)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_minhash_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_forest.near_duplicates(spark, _table(spark, sf_dir, "documents"))


def op2_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return bpe_codec.digests(spark, _table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(spark, _table(spark, sf_dir, "documents"), spans=False)


def op4_url_trust(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_trust.judge(spark, _table(spark, sf_dir, "pages"))


def op5_bottomk(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = bottomk.fingerprints(spark, _table(spark, sf_dir, "documents"))
    return found.withColumns({c: bottomk.as_text(F.col(c)) for c in ("fingerprint", "edited_fingerprint")})


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(spark, _table(spark, sf_dir, "documents")).drop("bucket")


def op7_pii_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii_bootstrap.digests(pii_bootstrap.extract(spark, _table(spark, sf_dir, "documents")))


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.digests(token_files.token_files(spark, _table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.json"), end_id=2))


def op9_bwt_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bwt_dedup.digests(bwt_dedup.without_repeats(spark, _table(spark, sf_dir, "documents")))


def op10_hilbert_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hilbert_packing.digests(hilbert_packing.pack(spark, _table(spark, sf_dir, "documents"), tokenizer_file("word_bpe_49k.json"), end_id=1))


def op11_source_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_audit.audit(spark, _table(spark, sf_dir, "documents"))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle_manifest.manifest(spark, _table(spark, sf_dir, "documents"))


def op13_warc_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc_archive.digests(warc_archive.read_archives(spark, warc_archive.archive(spark, _table(spark, sf_dir, "pages")), payload=False))


QUERIES = {f.__name__: f for f in (
    op1_minhash_forest, op2_bpe_codec, op3_language_id, op4_url_trust, op5_bottomk, op6_exact_dedup,
    op7_pii_bootstrap, op8_token_files, op9_bwt_dedup, op10_hilbert_packing, op11_source_audit, op12_merkle_manifest, op13_warc_archive)}

_NORM = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
SQL = {
    "op6_exact_dedup": f"""
        WITH d AS (SELECT doc_id, {_NORM} AS norm FROM documents),
             g AS (SELECT norm, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY norm)
        SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id = g.keep_id AS kept, sha256(d.norm) AS text_sha256
        FROM d JOIN g ON d.norm = g.norm""",
    "op1_minhash_forest": rf"""
        WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array({_NORM}, '[\x20\x09-\x0D]+'), lambda x: x != '') AS ws FROM documents),
             s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) >= 5 THEN list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END) AS sh FROM w),
             n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
             k AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id < b.doc_id GROUP BY 1, 2),
             l AS (SELECT a, b FROM k JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 75 * (x.n + y.n - k)),
             e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
             r AS (SELECT doc_id AS node, doc_id AS reached FROM documents UNION SELECT r.node, e.b FROM r JOIN e ON e.a = r.reached)
        SELECT r.node AS doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(r.reached) AS component_id, r.node = min(r.reached) AS kept
        FROM r LEFT JOIN n ON n.doc_id = r.node GROUP BY r.node""",
    "op11_source_audit": rf"""
        WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, regexp_extract_all({_NORM}, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS ws FROM documents),
             t AS (SELECT r, lang, source, unnest(ws) AS term FROM d),
             k AS (SELECT lang, term FROM t GROUP BY lang, term HAVING count(DISTINCT r) >= 3),
             v AS (SELECT lang, count(*) AS v FROM k GROUP BY lang),
             c AS (SELECT lang, source, term, count(*) AS n FROM t JOIN k USING (lang, term) GROUP BY ALL),
             s AS (SELECT g.lang, g.source, coalesce(v.v, 0) AS v, coalesce(h.held, 0) AS held FROM (SELECT DISTINCT lang, source FROM d) g
                   LEFT JOIN v ON v.lang = g.lang LEFT JOIN (SELECT lang, source, sum(n) AS held FROM c GROUP BY ALL) h ON h.lang = g.lang AND h.source = g.source),
             p AS (SELECT s.lang, s.source, k.term, coalesce(c.n, 0) AS n, (1 + 1000000000::HUGEINT * (coalesce(c.n, 0) + 1) // (s.held + s.v))::BIGINT AS p
                   FROM s JOIN k ON k.lang = s.lang LEFT JOIN c ON c.lang = s.lang AND c.source = s.source AND c.term = k.term),
             q AS (SELECT lang, term, (1 + 1000000000::HUGEINT * (sum(n) + 1) // (sum(sum(n)) OVER (PARTITION BY lang) + count(*) OVER (PARTITION BY lang)))::BIGINT AS q FROM p GROUP BY lang, term),
             pair AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(sum((x.p - y.p) * (x.p - y.p) // y.p), 0)::BIGINT AS value
                      FROM s a JOIN s b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN p x ON x.lang = a.lang AND x.source = a.source
                      LEFT JOIN p y ON y.lang = b.lang AND y.source = b.source AND y.term = x.term GROUP BY ALL),
             term AS (SELECT p.lang, p.source, 'term' AS part, p.term AS item, (p.p - q.q) * (p.p - q.q) // q.q AS value FROM p JOIN q USING (lang, term) WHERE p.n > 0 AND p.p > q.q),
             f AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank FROM (SELECT * FROM pair UNION ALL SELECT * FROM term))
        SELECT lang, source, part, item, value, rank FROM f WHERE part = 'pair' OR rank <= 200""",
    # crc32 bit by bit; the trees level by level, the languages' as one more tree of group -1.
    "op12_merkle_manifest": f"""
        WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, doc_id, text, dense_rank() OVER (ORDER BY lang NULLS FIRST) - 1 AS g,
                 concat({", ".join(f"coalesce(octet_length(encode({c}::VARCHAR)) || ':' || {c}::VARCHAR, '-')" for c in ("doc_id", "source", "lang", "n_chars"))}) AS head,
                 list_reduce(list_prepend(4294967295, list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)), lambda a, x:
                     list_reduce(list_prepend(xor(a, x), range(8)), lambda c, i: xor(c // 2, 3988292384 * (c % 2)))) AS c FROM documents),
             l AS (SELECT r, doc_id, g, sha256(head || coalesce(octet_length(encode(text)) || ':' || text, '-')) AS leaf,
                 CASE WHEN doc_id IS NOT NULL AND xor(c, 4294967295) % 3 = 0 THEN sha256(head || coalesce(octet_length(encode(text)) || ':' || translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '-')) END AS tampered FROM d),
             p AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf, r) - 1 AS i, count(*) OVER (PARTITION BY g) AS n FROM l),
             t AS (SELECT g, 0 AS level, i AS j, leaf AS h, n FROM p
                   UNION ALL SELECT g, any_value(level) + 1, j // 8, sha256(string_agg(h, '' ORDER BY j)), any_value((n + 7) // 8) FROM t WHERE n > 1 GROUP BY g, j // 8),
             s AS (SELECT g, h AS subroot FROM t WHERE n = 1),
             u AS (SELECT 0 AS level, g AS j, subroot AS h, count(*) OVER () AS n FROM s
                   UNION ALL SELECT any_value(level) + 1, j // 8, sha256(string_agg(h, '' ORDER BY j)), any_value((n + 7) // 8) FROM u WHERE n > 1 GROUP BY j // 8),
             a AS (SELECT g, level, j // 8 AS j, list(h ORDER BY j) AS hs FROM t WHERE n > 1 GROUP BY g, level, j // 8
                   UNION ALL SELECT -1, level, j // 8, list(h ORDER BY j) FROM u WHERE n > 1 GROUP BY level, j // 8),
             f AS (SELECT r, g, 0 AS level, i AS j, '' AS proof, coalesce(tampered, leaf) AS h, n FROM p
                   UNION ALL SELECT f.r, f.g, f.level + 1, f.j // 8, proof || array_to_string(list_concat(hs[:f.j % 8], hs[f.j % 8 + 2:]), ''),
                       sha256(array_to_string(hs[:f.j % 8], '') || f.h || array_to_string(hs[f.j % 8 + 2:], '')), (f.n + 7) // 8
                   FROM f JOIN a ON a.g = f.g AND a.level = f.level AND a.j = f.j // 8 WHERE f.n > 1),
             v AS (SELECT r, 0 AS level, g AS j, proof, h, (SELECT count(*) FROM s) AS n FROM f WHERE n = 1
                   UNION ALL SELECT v.r, v.level + 1, v.j // 8, proof || array_to_string(list_concat(hs[:v.j % 8], hs[v.j % 8 + 2:]), ''),
                       sha256(array_to_string(hs[:v.j % 8], '') || v.h || array_to_string(hs[v.j % 8 + 2:], '')), (v.n + 7) // 8
                   FROM v JOIN a ON a.g = -1 AND a.level = v.level AND a.j = v.j // 8 WHERE v.n > 1)
        SELECT p.doc_id, p.leaf, s.subroot, u.h AS root, sha256(v.proof) AS proof_sha256, v.h AS folded_root, v.h = u.h AS verified
        FROM p JOIN s ON s.g = p.g JOIN v ON v.r = p.r AND v.n = 1 JOIN u ON u.n = 1""",
    "op13_warc_archive": """
        WITH p AS (SELECT row_number() OVER () AS r, page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
             o AS (SELECT *, row_number() OVER w AS k, first(page_id) OVER w AS head FROM p WINDOW w AS (PARTITION BY payload_digest ORDER BY page_id NULLS LAST, r))
        SELECT page_id, payload_bytes, payload_digest, CASE WHEN k > 1 AND payload_bytes >= 100 THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN k > 1 AND payload_bytes >= 100 THEN head END AS refers_to FROM o""",
}
