"""Thin registered queries opN_<name> over the operators of this subpackage."""

from __future__ import annotations

from .common import table


def op5_simhash_near_dedup(spark, sf_dir):
    from .simhash import simhash_groups

    return simhash_groups(table(spark, sf_dir, "documents"), width=4, distance=4)


def op1_embedding_near_dedup(spark, sf_dir):
    from .collide import embedding_groups

    return embedding_groups(table(spark, sf_dir, "embeddings"))


def op8_byte_bpe(spark, sf_dir):
    import public_tokenizers
    from pyspark.sql import functions as F

    from .bpe import decode_column, encode_documents

    ranks, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    tokens = encode_documents(table(spark, sf_dir, "documents"), ranks, pattern)
    return tokens.withColumn("decoded", decode_column("ids", ranks, pattern)).select(
        "doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256")
    )


def op9_document_fingerprints(spark, sf_dir):
    from .sketch import neighbour_fingerprints

    return neighbour_fingerprints(table(spark, sf_dir, "documents"))


def op3_url_filters(spark, sf_dir):
    from .urlfilter import judge_pages

    return judge_pages(table(spark, sf_dir, "pages"))


def op4_warc(spark, sf_dir):
    from .warc import archive_pages

    return archive_pages(table(spark, sf_dir, "pages")).drop("url")


OP4_SQL = """
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS h FROM pages
), d AS (
  SELECT page_id, payload_bytes, h, max(page_id) OVER (PARTITION BY h) AS keeper FROM p
)
SELECT page_id, payload_bytes,
  array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST(
    ((instr('0123456789abcdef', substr(h, 1 + CAST(i * 5 // 4 AS INT), 1)) - 1) * 16
     + instr('0123456789abcdef', substr(h, 2 + CAST(i * 5 // 4 AS INT), 1)) - 1) // (1 << CAST(3 - i * 5 % 4 AS INT)) % 32 AS INT), 1)), '') AS payload_digest,
  CASE WHEN page_id = keeper THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> keeper THEN keeper END AS refers_to
FROM d
"""


def op2_toxicity(spark, sf_dir):
    from .toxicity import fit_chain, score

    docs = table(spark, sf_dir, "documents")
    return score(docs, fit_chain(docs, table(spark, sf_dir, "labels"))).select("doc_id", "toxic", "p_toxic", "p_low_quality")


def op7_substring_dedup(spark, sf_dir):
    from .linededup import dedup_lines

    return dedup_lines(table(spark, sf_dir, "documents"))


def op6_mixing(spark, sf_dir):
    import public_tokenizers

    from .mixing import mix

    rows = mix(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return rows.select("doc.doc_id", "doc.source", "doc.lang", "topic", "tokens", "probability", "sampled")


def op10_secret_scans(spark, sf_dir):
    from pyspark.sql import functions as F

    from .secretscan import scan

    hits = scan(table(spark, sf_dir, "documents"))
    return hits.select(F.col("id").alias("doc_id"), "start", "end", F.sha2("value", 256).alias("value_sha256"), "score", "secret")


def op11_fill_in_middle(spark, sf_dir):
    from pyspark.sql import functions as F

    from .infill import fill_in_middle, restored_column

    rows = fill_in_middle(table(spark, sf_dir, "documents")).withColumn("restored", restored_column("output", "form"))
    return rows.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2("restored", 256).alias("restored_sha256")
    )


OP11_SQL = """
WITH t AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS u, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents
), d AS (
  SELECT doc_id, text, u, len(u) AS n, [('0x' || substr(h, 1 + 8 * k, 8))::BIGINT for k in [0, 1, 2, 3]] AS h FROM t
), c AS (
  SELECT *, least(h[1] % (n + 1), h[2] % (n + 1)) AS low, greatest(h[1] % (n + 1), h[2] % (n + 1)) AS high,
    CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h[3] % 100 >= 90 THEN 'plain' WHEN h[4] % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM d
), p AS (
  SELECT doc_id, text, n, form, array_to_string(u[1:low], '') AS pre, array_to_string(u[low + 1:high], '') AS mid, array_to_string(u[high + 1:], '') AS suf FROM c
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(pre) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(mid) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256,
  sha256(text) AS restored_sha256
FROM p
"""


def op12_conversation_repair(spark, sf_dir):
    from .convrepair import repair_conversations

    return repair_conversations(table(spark, sf_dir, "conversations"))


def op13_license_scans(spark, sf_dir):
    from .license import scan_licenses

    return scan_licenses(table(spark, sf_dir, "documents"))


def _op13_sql() -> str:
    from .license import PHRASES, template_sets

    words = lambda tokens: "[" + ", ".join(f"'{t}'" for t in sorted(tokens)) + "]::VARCHAR[]"
    sets = ", ".join(f"({s.tid}, '{s.label}', {words(s.tokens)}, {words(s.names)}, {s.least}, {s.step})" for s in template_sets())
    phrases = ", ".join(f"({p.split()}, '{label}')" for p, label in PHRASES)
    return f"""
WITH s(tid, label, tokens, names, least, step) AS (VALUES {sets}), p(phrase, label) AS (VALUES {phrases}),
d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents
), x AS (
  SELECT doc_id, w, unnest(w) AS t, generate_subscripts(w, 1) - 1 AS pos FROM d
), b AS (
  SELECT doc_id, count(*) AS n_base, min(pos) AS first_word, max(pos) AS last_word, list(DISTINCT label) AS found
  FROM x JOIN p ON x.t = p.phrase[1] AND x.w[pos + 1:pos + len(p.phrase)] = p.phrase GROUP BY 1
), v AS (
  SELECT DISTINCT step, unnest(tokens) AS t FROM s
), y AS (
  SELECT doc_id, step, pos // step AS k, t FROM x JOIN v USING (t) UNION SELECT doc_id, step, pos // step - 1, t FROM x JOIN v USING (t) WHERE pos >= step
), k AS (
  SELECT doc_id, step, k, list(t) AS b FROM y GROUP BY ALL
), m AS (
  SELECT doc_id, k.step, k, label, names, len(list_intersect(b, tokens)) / len(tokens) AS containment FROM k JOIN s ON s.step = k.step
  WHERE len(list_intersect(b, tokens)) >= least AND len(list_intersect(b, names)) = len(names)
), o AS (
  SELECT * FROM m WHERE NOT EXISTS (SELECT 1 FROM m n WHERE n.doc_id = m.doc_id AND n.step = m.step AND n.k = m.k AND len(m.names) > 0
    AND len(n.names) > len(m.names) AND len(list_intersect(n.names, m.names)) = len(m.names))
), l AS (
  SELECT doc_id, list(DISTINCT label) AS more, max(containment) AS score FROM o GROUP BY 1
)
SELECT d.doc_id, len(w) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(array_to_string(list_sort(found), ','), '') AS base_labels,
  array_to_string(list_sort(list_distinct(coalesce(found, []) || coalesce(more, []))), ',') AS labels, coalesce(score, 0)::DOUBLE AS score
FROM d LEFT JOIN b USING (doc_id) LEFT JOIN l USING (doc_id)
"""


OP1_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
), fit AS (
  SELECT * FROM v WHERE label IS NOT NULL AND e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0
), p AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM fit a JOIN fit b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_cosine_similarity(a.e, b.e) >= 0.93
), reach(id, root) AS (
  SELECT vec_id, vec_id FROM v UNION SELECT p.b, reach.root FROM reach JOIN p ON p.a = reach.id
), c AS (
  SELECT id, min(root) AS component_id FROM reach GROUP BY id
)
SELECT v.vec_id, (SELECT count(*) FROM p WHERE p.a = v.vec_id) AS n_links, component_id, v.vec_id = component_id AS kept
FROM v JOIN c ON c.id = v.vec_id
"""


QUERIES = {
    f.__name__: f
    for f in (
        op1_embedding_near_dedup, op2_toxicity, op3_url_filters, op4_warc, op5_simhash_near_dedup, op6_mixing, op7_substring_dedup, op8_byte_bpe,
        op9_document_fingerprints, op10_secret_scans, op11_fill_in_middle, op12_conversation_repair, op13_license_scans,
    )
}
ORACLES = {"op1_embedding_near_dedup": OP1_SQL, "op4_warc": OP4_SQL, "op11_fill_in_middle": OP11_SQL, "op13_license_scans": _op13_sql()}
