"""The registered queries of the corpus operators, over whole tables with production parameters."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import ann, conversation_trie, cover_tree, filter_audit, minhash, mixing, packing, pii, quality, token_counts, token_files, toxicity, warc
from ._scratch import materialize, scratch_path

#: Folder of the public tokenizer files; each executor has them.
TOKENIZERS = os.environ.get("PLUMBLINE_TOKENIZERS", "")

#: The pseudonyms' key; a deployment sets its own.
PII_KEY = os.environ.get("PLUMBLINE_PII_KEY", "plumbline-test-key")


def tokenizer(name: str) -> str:
    if TOKENIZERS:
        return f"{TOKENIZERS}/{name}"
    import public_tokenizers

    return str(public_tokenizers.path(name))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return ann.nearest(vectors, vectors.filter(F.col("vec_id") % 20 == 0))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = toxicity.score(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "spans")


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = token_counts.count_tokens(table(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json"))
    return counted.withColumn("over_limit", F.col("n_tokens") > 2048)


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.apply_rules(table(spark, sf_dir, "documents"), keep=["doc_id"]).drop("host_rate")


def op5_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    laid = mixing.lay_out(mixing.plan_mixture(table(spark, sf_dir, "documents")), all_documents=True)
    documents = laid.filter("copy is null or copy = 0")  # a document stands at its first training position
    return documents.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "position", "positions")


def op6_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = pii.pseudonymize(table(spark, sf_dir, "documents").select("doc_id", "text"), PII_KEY)
    return done.select("doc_id", "text", F.size("pseudonyms").cast("long").alias("n_pseudonyms"), "pseudonyms")


def op7_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.cut_pieces(table(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json"))
    narrow = materialize(pieces.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32")), "pack-pieces")
    return packing.pack(narrow, order=("doc_id", "piece", "ids_crc32"))


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "token-files")
    token_files.write_token_files(table(spark, sf_dir, "documents"), path, tokenizer("byte_bpe_50k.json"))
    read = token_files.document_starts(token_files.read_token_files(spark, path, with_ids=False))
    return read.select("doc_id", "start", "n_tokens", "ids_crc32")


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "warc")
    warc.write_archives(warc.mark_revisits(table(spark, sf_dir, "pages")), path)
    pages = warc.reassemble(warc.read_records(spark, path))
    return pages.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op11_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = conversation_trie.prefixes(table(spark, sf_dir, "conversations"))
    return conversation_trie.trie(conversation_trie.graft(found, lambda c: c - c % 100, lambda c: F.crc32(c.cast("string").cast("binary")) % 6, most=5))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op13_embedding_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cover_tree.near_vectors(table(spark, sf_dir, "embeddings"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_nearest_neighbours, op2_toxicity, op3_token_counts, op4_quality_rules, op5_source_mixing, op6_pseudonyms, op7_near_duplicates, op8_best_fit_packing, op9_token_files, op10_warc, op11_conversation_trie, op12_filter_audit, op13_embedding_duplicates)}


OP4_SQL = r"""
WITH d AS (SELECT doc_id, source, row_number() OVER () AS r, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, list_filter(string_split_regex(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM d),
g AS (SELECT r, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM w, unnest(range(1, len(w) - 1)) u(i)),
h AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS n FROM g) x WHERE n >= 2),
c AS (SELECT r, count(DISTINCT i + k) AS n FROM h, (VALUES (0), (1), (2)) v(k) GROUP BY r),
m AS (SELECT doc_id, source, len(w) AS n_words, length(t) - length(regexp_replace(t, '[^\x20\x09-\x0D]', '', 'g')) AS word_chars, length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols, len(l) - len(list_distinct(l)) AS n_dup_lines, coalesce(c.n, 0) AS n_repeat_words FROM w LEFT JOIN c ON c.r = w.r),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m),
s AS (SELECT source, count(*) AS n, sum(CASE WHEN base_failed THEN 1 ELSE 0 END) AS failed FROM b GROUP BY source),
p AS (SELECT sum(failed) / sum(n) AS m, var_pop(failed / n) AS v FROM s),
q AS (SELECT m, CASE WHEN v > 0 AND v < m * (1 - m) THEN m * (1 - m) / v - 1 ELSE 1.0 END AS k FROM p),
t AS (SELECT source, n + k AS weight, (failed + m * k) / (n + k) AS rate FROM s CROSS JOIN q)
SELECT b.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT (t.rate - 1.645 * sqrt(t.rate * (1 - t.rate) / (t.weight + 1)) > 0.5) AS kept FROM b JOIN t ON t.source IS NOT DISTINCT FROM b.source
"""

OP7_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS s FROM w, unnest(range(1, greatest(len(w) - 3, 2))) u(i) WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
e AS (SELECT x.doc_id AS a, y.doc_id AS b FROM s x JOIN s y ON x.s = y.s AND x.doc_id <> y.doc_id JOIN n p ON p.doc_id = x.doc_id JOIN n q ON q.doc_id = y.doc_id GROUP BY x.doc_id, y.doc_id, p.n, q.n HAVING 100 * count(*) >= 75 * (p.n + q.n - count(*))),
r(a, b) AS (SELECT doc_id, doc_id FROM w UNION SELECT r.a, e.b FROM r JOIN e ON e.a = r.b)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, c.c AS component_id, w.doc_id = c.c AS kept FROM w LEFT JOIN n ON n.doc_id = w.doc_id JOIN (SELECT a, min(b) AS c FROM r GROUP BY a) c ON c.a = w.doc_id
"""

OP10_SQL = """
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS n, sha1(coalesce(html, '')) AS d FROM pages),
g AS (SELECT d, max(page_id) AS last_id FROM p WHERE n >= 1000 GROUP BY d)
SELECT p.page_id, p.n AS payload_bytes, p.d AS payload_digest, CASE WHEN g.last_id <> p.page_id THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN g.last_id <> p.page_id THEN g.last_id END AS refers_to
FROM p LEFT JOIN g ON g.d = p.d AND p.n >= 1000
"""


OP11_SQL = """
WITH o AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, md5(length(coalesce(role, ''))::varchar || ':' || coalesce(role, '') || coalesce(text, ''))) AS i, {'r': coalesce(role, ''), 't': coalesce(text, '')} AS x FROM conversations WHERE conv_id IS NOT NULL),
g AS (SELECT conv_id, list(x ORDER BY i) AS l FROM o GROUP BY conv_id),
z AS (SELECT conv_id, l, list_reduce(list_concat([4294967295::bigint], flatten([[ord(b)::bigint, -1, -1, -1, -1, -1, -1, -1] for b in string_split(conv_id::varchar, '')])), lambda a, e: xor(xor(a, greatest(e, 0::bigint)) // 2, 3988292384 * (xor(a, greatest(e, 0::bigint)) % 2))) AS c FROM g),
h AS (SELECT conv_id, l, xor(c, 4294967295::bigint) % 6 AS h FROM z),
r AS (SELECT h.conv_id, list_concat(coalesce(b.l[1:h.h], []), h.l[h.h + 1:]) AS l FROM h LEFT JOIN g b ON b.conv_id = h.conv_id - h.conv_id % 100),
p AS (SELECT conv_id, d, md5(l[1:d]::json::varchar) AS k, CASE WHEN d > 0 THEN md5(l[1:d - 1]::json::varchar) END AS u, CASE WHEN d > 0 THEN length(l[d].t) ELSE 0 END AS n, d = len(l) AS e FROM r, unnest(range(0, len(l) + 1)) v(d)),
n AS (SELECT d, k, min(u) AS u, min(n) AS n, min(conv_id) AS conv_id, count(*) AS n_convs, sha256(coalesce(string_agg(conv_id::varchar, ',' ORDER BY conv_id) FILTER (WHERE e), '')) AS ends_sha256 FROM p GROUP BY d, k),
c AS (SELECT d - 1 AS d, u AS k, count(*) AS n_children FROM n WHERE d > 0 GROUP BY 1, 2),
m AS (SELECT n.*, coalesce(c.n_children, 0) AS n_children FROM n LEFT JOIN c USING (d, k)),
s AS (SELECT a.d, a.k, sum(CASE WHEN m.n_children = 0 THEN 1 ELSE 0 END)::bigint AS n_leaves, sum((m.n_convs - 1) * m.n)::bigint AS saved_tokens FROM m JOIN p a ON a.conv_id = m.conv_id AND a.d <= m.d GROUP BY a.d, a.k)
SELECT m.conv_id, m.d AS depth, q.conv_id AS parent_conv_id, m.n_convs, m.n_children, s.n_leaves, s.saved_tokens, m.ends_sha256 FROM m JOIN s USING (d, k) LEFT JOIN n q ON q.d = m.d - 1 AND q.k = m.u
"""

OP12_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
l AS (SELECT doc_id, coalesce(bool_or(quality = 1), false) AS good, coalesce(bool_or(toxic = 1), false) AS toxic FROM labels GROUP BY doc_id),
f AS (SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic, [len(w) < 200, 100 * len(list_distinct(w)) < 50 * len(w), 100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > 3 * length(t), regexp_matches(t, '[#$%&*|]'), coalesce(d.doc_id > min(d.doc_id) OVER (PARTITION BY t), false)] AS x FROM d LEFT JOIN l ON l.doc_id = d.doc_id),
g AS (SELECT part, good, toxic, x, count(*) AS n FROM f GROUP BY part, good, toxic, x),
i AS (SELECT unnest(range(1, 6)) AS i),
o AS (SELECT [a.i, b.i, c.i, d.i, e.i] AS o FROM i a, i b, i c, i d, i e WHERE len(list_distinct([a.i, b.i, c.i, d.i, e.i])) = 5),
s AS (SELECT o, i AS step, o[i] AS f, o[1:i - 1] AS before FROM o, i),
r AS (SELECT part, array_to_string([chr((64 + k)::int) for k in o], '') AS filter_order, step, f, n, good, toxic, x[f] AS fails, len([k for k in before if x[k]]) > 0 AS gone, len([k for k in x if k]) = 1 AS alone FROM s, g),
q AS (SELECT part, filter_order, step, f, sum(CASE WHEN NOT fails AND NOT gone THEN n ELSE 0 END)::bigint AS kept, sum(CASE WHEN fails AND NOT gone THEN n ELSE 0 END)::bigint AS removed, sum(CASE WHEN fails AND gone THEN n ELSE 0 END)::bigint AS redundant, sum(CASE WHEN fails AND alone THEN n ELSE 0 END)::bigint AS unique_fails, sum(CASE WHEN fails AND NOT gone AND good THEN n ELSE 0 END)::bigint AS good_lost, sum(CASE WHEN fails AND NOT gone AND toxic THEN n ELSE 0 END)::bigint AS toxic_lost FROM r GROUP BY part, filter_order, step, f)
SELECT part, filter_order, step::int AS step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, sum(removed) OVER (PARTITION BY part, f)::bigint AS shapley FROM q
"""

OP13_SQL = """
WITH RECURSIVE v AS (SELECT vec_id, label, embedding::double[] AS e FROM embeddings WHERE label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
l AS (SELECT x.vec_id AS a, y.vec_id AS b FROM v x JOIN v y ON x.label = y.label AND x.vec_id <> y.vec_id AND len(x.e) = len(y.e) WHERE list_cosine_similarity(x.e, y.e) >= 0.98),
r(a, b) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT r.a, l.b FROM r JOIN l ON l.a = r.b)
SELECT e.vec_id, (SELECT count(*) FROM l WHERE l.a = e.vec_id) AS n_links, c.c AS component_id, e.vec_id = c.c AS kept FROM embeddings e JOIN (SELECT a, min(b) AS c FROM r GROUP BY a) c ON c.a = e.vec_id
"""


def oracle_sql() -> dict[str, str]:
    """The other queries tokenize, hash, permute or learn; they are tested against brute force."""
    return {"op4_quality_rules": OP4_SQL, "op7_near_duplicates": OP7_SQL, "op10_warc": OP10_SQL, "op11_conversation_trie": OP11_SQL, "op12_filter_audit": OP12_SQL, "op13_embedding_duplicates": OP13_SQL}
