"""The operators of this package as queries over the test tables, with SQL where SQL can express them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from recurva.llm import (
    ann, archives, bpe, conversations, decontamination, embedding_dedup, licenses, line_dedup, merkle, mixing, quality, simhash, toxicity,
)
from recurva.llm.sampling import crc_part
from recurva.llm.text import ascii_lower, read_table

QUERIES, ORACLES = {}, {}

#: CRC-32 of an ASCII text, before its last negation: per byte eight steps of the reversed polynomial.
CRC_SQL = """list_reduce(list_concat([CAST(4294967295 AS BIGINT)], list_transform(string_split({0}, ''), lambda c: CAST(ascii(c) AS BIGINT))),
  lambda crc, byte: list_reduce(list_concat([xor(crc, byte)], range(8)), lambda x, k: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END))"""


def query(name, sql=None):
    def register(function):
        QUERIES[name] = function
        if sql:
            ORACLES[name] = sql
        return function
    return register


@query("op1_simhash")
def op1(spark, folder):
    return simhash.simhash_groups(read_table(spark, folder, "documents").select("doc_id", "text"))


@query("op2_line_dedup", r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS pos
  FROM documents),
keyed AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM lines),
shared AS (
  SELECT key, max(doc_id) AS keeper FROM keyed WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
judged AS (
  SELECT k.*, s.key IS NOT NULL AND k.doc_id <> s.keeper AS gone FROM keyed k LEFT JOIN shared s ON k.key = s.key)
SELECT doc_id, CAST(count(*) AS BIGINT) AS n_lines, CAST(count(*) FILTER (WHERE gone) AS BIGINT) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM judged GROUP BY doc_id""")
def op2(spark, folder):
    docs = read_table(spark, folder, "documents").select("doc_id", "text")
    kept = line_dedup.dedup_lines(docs)
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


@query("op3_licenses")
def op3(spark, folder):
    docs = read_table(spark, folder, "documents").select("doc_id", "text")
    found = licenses.document_licenses(docs, licenses.train(docs))
    return found.withColumn("families", F.array_join("families", ",")).withColumn("probability", F.round("probability", 6))


@query("op4_source_mixing")
def op4(spark, folder):
    docs = read_table(spark, folder, "documents").select("doc_id", "text", "source")
    return mixing.taken_words(mixing.mix(docs)).drop("source")


@query("op5_bpe")
def op5(spark, folder, ranks=None, pattern=public_tokenizers.PATTERN):
    ranks = ranks or public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    docs = read_table(spark, folder, "documents").select("doc_id", "text")
    ids = bpe.encode(docs, ranks, pattern, keep_text=False)
    both = bpe.decode(ids, ranks, pattern)
    return both.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"))


def held_out(parts, rest):
    return F.coalesce(crc_part(F.col("doc_id"), parts) == rest, F.lit(False))


@query("op6_quality")
def op6(spark, folder):
    docs = read_table(spark, folder, "documents").select("doc_id", "text")
    rules = quality.learn_rules(docs, read_table(spark, folder, "labels"), ~held_out(3, 1))
    scored = quality.score_quality(docs, rules)
    return scored.select("doc_id", held_out(3, 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


@query("op7_toxicity")
def op7(spark, folder):
    docs = read_table(spark, folder, "documents").select("doc_id", "text")
    model = toxicity.learn_toxicity(docs, read_table(spark, folder, "labels"), ~held_out(4, 2))
    scored = toxicity.score_toxicity(docs, model)
    return scored.select("doc_id", held_out(4, 2).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


@query("op8_warc", """
WITH payloads AS (SELECT page_id, coalesce(html, '') AS html, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes FROM pages),
hashed AS (SELECT *, CAST(CAST(unhex(sha1(html)) AS BIT) AS VARCHAR) AS bits, min(page_id) OVER (PARTITION BY html) AS first FROM payloads)
SELECT page_id, payload_bytes,
  list_aggregate(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST(CAST(substr(bits, i * 5 + 1, 5) AS BIT) AS INTEGER), 1)),
                 'string_agg', '') AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to
FROM hashed""")
def op8(spark, folder):
    found = archives.archive_pages(read_table(spark, folder, "pages"))
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query("op9_nearest")
def op9(spark, folder):
    vectors = read_table(spark, folder, "embeddings")
    return ann.nearest(vectors, vectors.where(F.col("vec_id") % 50 == 0))


@query("op10_embedding_dedup", """
WITH RECURSIVE vectors AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
  WHERE label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(CAST(embedding AS DOUBLE[]), lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(CAST(embedding AS DOUBLE[]), lambda x: x <> 0)) > 0),
links AS (
  SELECT a.vec_id AS u, b.vec_id AS w FROM vectors a JOIN vectors b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v)
  WHERE list_cosine_similarity(a.v, b.v) >= 0.98),
reach AS (SELECT vec_id AS node, vec_id AS origin FROM embeddings UNION SELECT l.w, r.origin FROM reach r JOIN links l ON l.u = r.node),
roots AS (SELECT node, min(origin) AS component_id FROM reach GROUP BY 1)
SELECT e.vec_id, (SELECT CAST(count(*) AS BIGINT) FROM links l WHERE l.u = e.vec_id) AS n_links, component_id, e.vec_id = component_id AS kept
FROM embeddings e JOIN roots ON node = e.vec_id""")
def op10(spark, folder):
    return embedding_dedup.embedding_groups(read_table(spark, folder, "embeddings"))


@query("op11_decontamination", r"""
WITH docs AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM documents),
items AS (
  SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM benchmark),
sized AS (SELECT *, least(len(words), 10) AS n FROM items WHERE len(words) > 0),
places AS (SELECT *, unnest(range(1, len(words) - n + 2)) AS i FROM sized),
windows AS (SELECT DISTINCT item, n, array_to_string(list_slice(words, i, i + n - 1), ' ') AS w FROM places),
lengths AS (SELECT DISTINCT n FROM windows),
spots AS (SELECT doc_id, words, n, unnest(range(1, len(words) - n + 2)) AS i FROM docs, lengths),
found AS (
  SELECT DISTINCT doc_id, s.i, n, item FROM (SELECT doc_id, n, i, array_to_string(list_slice(words, i, i + n - 1), ' ') AS w FROM spots) s
  JOIN windows USING (n, w)),
hit AS (SELECT doc_id, count(DISTINCT place) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS place FROM found) GROUP BY doc_id),
listed AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
           FROM (SELECT DISTINCT doc_id, item FROM found) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM docs d LEFT JOIN hit h ON h.doc_id = d.doc_id LEFT JOIN listed l ON l.doc_id = d.doc_id""")
def op11(spark, folder):
    docs = read_table(spark, folder, "documents").select("doc_id", "text")
    found = decontamination.contaminated_spans(docs, read_table(spark, folder, "benchmark"))
    n_hit = decontamination.span_words(F.col("spans"))
    return found.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


@query("op12_merkle", r"""
WITH RECURSIVE texts AS (
  SELECT *, CASE WHEN xor(""" + CRC_SQL.format("CAST(doc_id AS VARCHAR)") + r""", 4294967295) % 3 = 0 THEN translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')
    ELSE text END AS altered FROM documents),
framed AS (
  SELECT doc_id, lang, text, altered, concat(
    coalesce(strlen(CAST(doc_id AS VARCHAR)) || ':' || doc_id, '-'), coalesce(strlen(source) || ':' || source, '-'),
    coalesce(strlen(lang) || ':' || lang, '-'), coalesce(strlen(CAST(n_chars AS VARCHAR)) || ':' || n_chars, '-')) AS head FROM texts),
leaves AS (
  SELECT doc_id, dense_rank() OVER (ORDER BY lang NULLS FIRST) - 1 AS tree, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
    sha256(head || coalesce(strlen(altered) || ':' || altered, '-')) AS changed,
    row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST) - 1 AS rank, count(*) OVER (PARTITION BY lang) AS n FROM framed),
low(tree, level, rank, n, digest) AS (
  SELECT tree, 0, rank, n, leaf FROM leaves
  UNION ALL SELECT tree, level + 1, rank // 8, any_value((n + 7) // 8), sha256(string_agg(digest, '' ORDER BY rank))
  FROM low WHERE n > 1 GROUP BY tree, level, rank // 8),
subroots AS (SELECT tree, digest FROM low WHERE n = 1),
high(level, rank, n, digest) AS (
  SELECT 0, tree, (SELECT count(*) FROM subroots), digest FROM subroots
  UNION ALL SELECT level + 1, rank // 8, any_value((n + 7) // 8), sha256(string_agg(digest, '' ORDER BY rank)) FROM high WHERE n > 1 GROUP BY level, rank // 8),
nodes AS (SELECT * FROM low UNION ALL SELECT -1, level, rank, n, digest FROM high),
steps AS (
  SELECT a.tree, a.level, a.rank, coalesce(string_agg(b.digest, '' ORDER BY b.rank) FILTER (WHERE b.rank < a.rank), '') AS l,
    coalesce(string_agg(b.digest, '' ORDER BY b.rank) FILTER (WHERE b.rank > a.rank), '') AS r
  FROM nodes a JOIN nodes b ON a.tree = b.tree AND a.level = b.level AND a.rank // 8 = b.rank // 8 WHERE a.n > 1 GROUP BY ALL),
ways(doc_id, home, leaf, tree, level, rank, folded, proof) AS (
  SELECT doc_id, tree, leaf, tree, 0, rank, changed, '' FROM leaves
  UNION ALL
  SELECT w.doc_id, w.home, w.leaf, CASE WHEN s.tree IS NULL THEN -1 ELSE w.tree END, CASE WHEN s.tree IS NULL THEN 0 ELSE w.level + 1 END,
    CASE WHEN s.tree IS NULL THEN w.home ELSE w.rank // 8 END, CASE WHEN s.tree IS NULL THEN w.folded ELSE sha256(s.l || w.folded || s.r) END,
    CASE WHEN s.tree IS NULL THEN w.proof ELSE w.proof || s.l || s.r END
  FROM ways w LEFT JOIN steps s ON s.tree = w.tree AND s.level = w.level AND s.rank = w.rank WHERE w.tree >= 0 OR s.tree IS NOT NULL),
ends AS (SELECT * FROM ways WHERE tree = -1 AND level = (SELECT max(level) FROM high))
SELECT doc_id, leaf, s.digest AS subroot, h.digest AS root, sha256(proof) AS proof_sha256, folded AS folded_root, folded = h.digest AS verified
FROM ends JOIN subroots s ON s.tree = ends.home JOIN high h ON h.n = 1""")
def op12(spark, folder):
    docs = read_table(spark, folder, "documents")
    touched = F.coalesce(crc_part(F.col("doc_id"), 3) == 0, F.lit(False))
    values = [F.col(f) for f in merkle.FIELDS[:-1]]
    altered = F.when(touched, merkle.leaf_digest(*values, ascii_lower(F.col("text"))))
    found = merkle.proofs(merkle.build_manifest(docs, altered=altered))
    folded = merkle.fold(F.coalesce("altered", "digest"), F.col("proof"))
    return found.select(
        F.col("key").alias("doc_id"), F.col("digest").alias("leaf"), "subroot", "root", merkle.digest(merkle.proof_text(F.col("proof"))).alias("proof_sha256"),
        folded.alias("folded_root"), (folded == F.col("root")).alias("verified"))


def _sql_least(*options):
    """The least of costs and audits, kept as six digits and the audit."""
    return f"least({', '.join(options)})"


def _sql_after(cost, edit, rest):
    return f"printf('%06d', CAST(substr({rest}, 1, 6) AS INTEGER) + {cost}) || '{edit}' || substr({rest}, 7)"


def _sql_row(at, then):
    """What a row can do in a state, before inserts; `kept` holds its initial, or x if it must go."""
    expected = "a" if at == 2 else "u"
    keep = f"CASE WHEN kept = '{expected}' THEN {_sql_after('cut', 'K', f'f{then}')} ELSE '999999' END"
    system = [f"CASE WHEN kept = 's' THEN {_sql_after('cut', 'K', 'f1')} ELSE '999999' END"] if at == 0 else []
    change = f"CASE WHEN kept <> 'x' THEN {_sql_after('cut + 2', 'R', f'f{then}')} ELSE '999999' END"
    return _sql_least(_sql_after(3, "D", f"f{at}"), keep, change, *system) + f" AS b{at}"


@query("op13_conversation_repair", r"""
WITH RECURSIVE keyed AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    concat(coalesce(CAST(conv_id AS VARCHAR), ' '), ':', coalesce(CAST(turn AS VARCHAR), ' ')) AS k FROM conversations),
hashed AS (SELECT *, xor(""" + CRC_SQL.format("k") + r""", 4294967295) % 20 AS kind FROM keyed),
damaged AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
    CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(range(CASE WHEN kind = 3 THEN 2 ELSE 1 END)) AS copy
  FROM hashed WHERE kind <> 0),
placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i FROM damaged),
judged AS (
  SELECT *, left(role, 1) AS initial, lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS previous,
    CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'blank'
      WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate'
      WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') THEN 'truncated' ELSE 'none' END AS fault FROM placed),
letters AS (SELECT *, CASE WHEN fault IN ('blank', 'duplicate') THEN 'x' ELSE initial END AS kept, CAST(fault = 'truncated' AS INTEGER) AS cut FROM judged),
counted AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank,
    count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
    count(*) FILTER (previous || initial NOT IN ('su', 'ua', 'au')) AS illegal, max(i) AS n FROM letters GROUP BY conv_id),
costs(conv_id, i, f0, f1, f2, f3) AS (
  SELECT conv_id, n + 1, '000000', '000004II', '000002I', '000000' FROM counted
  UNION ALL
  SELECT conv_id, i, """ + ", ".join([
    _sql_least("b0", _sql_after(2, "I", _sql_least("b2", _sql_after(2, "I", "b3")))),
    _sql_least("b1", _sql_after(2, "I", _sql_least("b2", _sql_after(2, "I", "b3")))),
    _sql_least("b2", _sql_after(2, "I", "b3")), _sql_least("b3", _sql_after(2, "I", "b2"))]) + r"""
  FROM (SELECT c.conv_id, l.i, """ + ", ".join(_sql_row(at, then) for at, then in enumerate((2, 2, 3, 2))) + r"""
    FROM costs c JOIN letters l ON l.conv_id IS NOT DISTINCT FROM c.conv_id AND l.i = c.i - 1)),
best AS (SELECT conv_id, CAST(substr(f0, 1, 6) AS BIGINT) AS cost, substr(f0, 7) AS audit FROM costs WHERE i = 1),
told(conv_id, pos, i, state, said, audit) AS (
  SELECT conv_id, 0, 0, 'start', '', audit FROM best
  UNION ALL
  SELECT conv_id, pos + 1, i, CASE WHEN edit = 'D' THEN state WHEN edit = 'K' AND state = 'start' AND kept = 's' THEN 'system'
      WHEN state = 'user' THEN 'assistant' ELSE 'user' END,
    CASE WHEN edit = 'D' THEN said ELSE concat(said, CASE WHEN state <> 'start' THEN chr(10) ELSE '' END,
      CASE WHEN edit = 'K' THEN role WHEN state = 'user' THEN 'assistant' ELSE 'user' END, ':', CASE WHEN edit = 'I' THEN '' ELSE text END) END, audit
  FROM (SELECT t.conv_id, t.pos, l.i, t.state, t.said, t.audit, substr(t.audit, t.pos + 1, 1) AS edit, l.kept, l.role, l.text
        FROM told t JOIN (SELECT conv_id, i, kept, role, text FROM letters UNION ALL SELECT conv_id, 0, NULL, NULL, NULL FROM best) l
          ON l.conv_id IS NOT DISTINCT FROM t.conv_id AND l.i = length(replace(substr(t.audit, 1, t.pos + 1), 'I', ''))
        WHERE t.pos < length(t.audit))),
ended AS (SELECT conv_id, said FROM told WHERE pos = length(audit))
SELECT o.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, CAST(coalesce(blank, 0) AS BIGINT) AS blank, CAST(coalesce(duplicate, 0) AS BIGINT) AS duplicate,
  CAST(coalesce(truncated, 0) AS BIGINT) AS truncated, CAST(coalesce(illegal, 0) AS BIGINT) AS illegal, CAST(coalesce(cost, 0) AS BIGINT) AS cost,
  coalesce(audit, '') AS audit, sha256(coalesce(said, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o
LEFT JOIN counted c ON c.conv_id IS NOT DISTINCT FROM o.conv_id LEFT JOIN best b ON b.conv_id IS NOT DISTINCT FROM o.conv_id
LEFT JOIN ended e ON e.conv_id IS NOT DISTINCT FROM o.conv_id""")
def op13(spark, folder):
    rows = read_table(spark, folder, "conversations")
    found = conversations.repair(conversations.damage(rows)).withColumnRenamed("conv_id", "__conv")
    every = rows.select("conv_id").distinct().join(found, F.col("conv_id").eqNullSafe(F.col("__conv")), "left")
    counts = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return every.select("conv_id", *counts, F.coalesce("audit", F.lit("")).alias("audit"),
                        F.coalesce("repaired_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"))
