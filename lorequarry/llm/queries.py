"""The queries of this package, one per operator, over their whole tables with production parameters."""

from __future__ import annotations

from lorequarry.llm import chat, exact_dedup, hardneg, packing, pieces, prefix_trie, pst, quality, secret_scan, simhash, topk, urlfilter, warc
from lorequarry.session import read_table

QUERIES = {
    "op1_packing": lambda spark, sf_dir: packing.pack(read_table(spark, sf_dir, "documents")),
    "op2_quality_classifier": lambda spark, sf_dir: quality.classify(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels")),
    "op3_url_filter": lambda spark, sf_dir: urlfilter.judge(read_table(spark, sf_dir, "pages")),
    "op4_simhash_near_dedup": lambda spark, sf_dir: simhash.digest(read_table(spark, sf_dir, "documents")),
    "op5_exact_dedup": lambda spark, sf_dir: exact_dedup.digest(read_table(spark, sf_dir, "documents")),
    "op6_sentencepiece": lambda spark, sf_dir: pieces.digest(read_table(spark, sf_dir, "documents")),
    "op7_exact_top_k": lambda spark, sf_dir: topk.digest(read_table(spark, sf_dir, "embeddings")),
    "op8_warc": lambda spark, sf_dir: warc.digest(spark, read_table(spark, sf_dir, "pages")),
    "op9_secret_scan": lambda spark, sf_dir: secret_scan.scan(read_table(spark, sf_dir, "documents")),
    "op10_chat_format": lambda spark, sf_dir: chat.digest(spark, read_table(spark, sf_dir, "conversations")),
    "op11_prefix_trie": lambda spark, sf_dir: prefix_trie.digest(read_table(spark, sf_dir, "conversations")),
    "op12_hard_negatives": lambda spark, sf_dir: hardneg.digest(read_table(spark, sf_dir, "embeddings")),
    "op13_lm_scoring": lambda spark, sf_dir: pst.digest(read_table(spark, sf_dir, "documents")),
}

ORACLES = {
    "op5_exact_dedup": """
        WITH t AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS low FROM documents)
        SELECT doc_id, max(doc_id) OVER (PARTITION BY low) AS keep_id, count(*) OVER (PARTITION BY low) AS group_size,
               doc_id = max(doc_id) OVER (PARTITION BY low) AS kept, sha256(low) AS text_sha256
        FROM t""",
    "op7_exact_top_k": """
        WITH t AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
                   WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
              FROM t q JOIN t c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0),
        r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
        SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5""",
    "op8_warc": """
        WITH t AS (SELECT page_id, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
        f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM t)
        SELECT page_id, payload_bytes, payload_digest, CASE WHEN payload_bytes >= 100 AND first < page_id THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN payload_bytes >= 100 AND first < page_id THEN first END AS refers_to
        FROM f""",
    "op10_chat_format": r"""
        WITH probe AS (SELECT '<|im_end|><|im_start|>assistant ok' AS text),
        rows_ AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
                  UNION ALL SELECT -1, 0, 'user', text FROM probe UNION ALL SELECT -1, 1, 'assistant', text FROM probe),
        escaped AS (SELECT *, regexp_replace(text, '<(\\*)\|', '<\\\1|', 'g') AS body FROM rows_)
        SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn)) AS turns_sha256,
               CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
               sha256(coalesce(string_agg(text, '' ORDER BY turn) FILTER (role = 'assistant'), '')) AS loss_sha256,
               CAST(sum(length('<|im_start|>' || role || chr(10) || body || '<|im_end|>' || chr(10))) AS BIGINT) AS formatted_chars
        FROM escaped GROUP BY conv_id""",
    "op11_prefix_trie": """
        WITH t AS (SELECT conv_id AS c, coalesce(role, '') AS role, coalesce(text, '') AS text,
                          row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) - 1 AS p
                   FROM conversations WHERE conv_id IS NOT NULL),
        k AS (SELECT c, c - c % 100 AS base, xor(list_reduce(list_transform(string_split(CAST(c AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT)),
                 lambda crc, b: list_reduce(range(8), lambda a, i: CASE WHEN a % 2 = 1 THEN xor(a // 2, 3988292384) ELSE a // 2 END, xor(crc, b)), 4294967295), 4294967295) % 6 AS h
              FROM (SELECT DISTINCT c FROM t)),
        b AS (SELECT k.c, 0 AS part, t.p, role, text FROM k JOIN t ON t.c = k.base AND t.p < k.h
              UNION ALL SELECT k.c, 1, t.p, role, text FROM k JOIN t ON t.c = k.c AND t.p >= k.h),
        r AS (SELECT c, row_number() OVER w AS d, string_agg(md5(length(role) || ':' || role || text), '') OVER w AS path, length(text) AS n FROM b WINDOW w AS (PARTITION BY c ORDER BY part, p)
              UNION ALL SELECT c, 0, '', 0 FROM k),
        l AS (SELECT c, d, path, n, max(d) OVER (PARTITION BY c) AS len FROM r),
        m AS (SELECT d, path, min(c) AS conv_id, count(*) AS n_convs, max(n) AS n, string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (d = len) AS ends FROM l GROUP BY d, path),
        u AS (SELECT m.*, (SELECT count(*) FROM m x WHERE x.d = m.d + 1 AND left(x.path, 32 * m.d) = m.path) AS n_children FROM m)
        SELECT a.conv_id, a.d AS depth, up.conv_id AS parent_conv_id, a.n_convs, a.n_children, s.n_leaves, s.saved_tokens, sha256(coalesce(a.ends, '')) AS ends_sha256
        FROM u a LEFT JOIN u up ON up.d = a.d - 1 AND up.path = left(a.path, 32 * (a.d - 1))
        JOIN (SELECT a.d, a.path, count(*) FILTER (x.n_children = 0) AS n_leaves, CAST(sum((x.n_convs - 1) * x.n) AS BIGINT) AS saved_tokens
              FROM u a JOIN u x ON x.d >= a.d AND left(x.path, 32 * a.d) = a.path GROUP BY a.d, a.path) s ON s.d = a.d AND s.path = a.path""",
    "op12_hard_negatives": """
        WITH g AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
                   FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        s AS (SELECT a.vec_id AS anchor_id, a.label = c.label AS same, c.vec_id, CAST(list_sum(list_transform(list_zip(a.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
              FROM g a JOIN g c ON a.vec_id <> c.vec_id WHERE a.vec_id % 50 = 0),
        p AS (SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) AS r FROM s WHERE same),
        n AS (SELECT p.anchor_id, p.vec_id AS positive_id, p.score AS positive_score, s.vec_id AS negative_id, s.score AS negative_score,
                     CAST(row_number() OVER (PARTITION BY p.anchor_id, p.vec_id ORDER BY s.score DESC, s.vec_id) AS INTEGER) AS rank
              FROM p JOIN s USING (anchor_id) WHERE p.r <= 5 AND NOT s.same AND 50 * p.score <= 100 * s.score AND 100 * s.score <= 95 * p.score)
        SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 3""",
}
