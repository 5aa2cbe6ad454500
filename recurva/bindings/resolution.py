"""Entity resolution: keys, blocks, scores, clusters, golden records."""

from __future__ import annotations

from pyspark.sql import functions as F

from recurva.bindings.tables import (
    MATCHES_SQL, RECORDS_SQL, mixed_records, number, postgres_records, records, stripe_records, table,
)
from recurva.functions import normalize, similarity
from recurva.functions.coerce import exact_sum
from recurva.functions.normalize import phone_key
from recurva.operators import blocking, clustering, golden, matching
from recurva.operators.blocking import Strategy
from recurva.plans.analyse import analyse
from recurva.plans.resolve import resolve_entities
from recurva.session import checkpointed
from recurva.sources.envelope import as_map, unite

QUERIES, ORACLES = {}, {}


def query(name, sql=None):
    def register(function):
        QUERIES[name] = function
        if sql:
            ORACLES[name] = sql
        return function
    return register


# --- normalisers ------------------------------------------------------------------------------------


@query("n1_email_domain", """
SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN NULL WHEN 1 THEN 'd' || c_nationkey || '.com' WHEN 2 THEN '' ELSE 'b' END AS domain FROM customer""")
def n1(spark, folder):
    k = F.col("c_custkey")
    email = (F.when(k % 4 == 0, F.lit("no address")).when(k % 4 == 1, F.concat(F.lit(" U@D"), F.col("c_nationkey").cast("string"), F.lit(".Com ")))
             .when(k % 4 == 2, F.lit("a@")).otherwise("a@b@c"))
    return table(spark, folder, "customer").select(k, normalize.email_domain(email).alias("domain"))


_ENDINGS = ("Inc", "Inc.", "incorporated", "LLC", "L.L.C.", "Ltd", "Ltd.", "Corp", "Corp.", "Corporation", "Co", "& Co.", "Company",
            "GmbH", "AG", "SA", "BV", "Holding")


def _company_sql(name):
    from recurva.functions.normalize import COMPANY_ENDINGS
    text = f"lower(trim({name}))"
    for ending in COMPANY_ENDINGS:
        text = f"regexp_replace({text}, '{ending.replace('.', '[.]')}$', '')"
    return f"trim(regexp_replace(regexp_replace({text}, '[^a-z0-9\\s]', '', 'g'), '\\s+', ' ', 'g'))"


@query("n2_company_key", f"""WITH named AS (
  SELECT p_partkey, '  ' || p_name || '  O''Neil ' || list_extract([{', '.join("'" + e + "'" for e in _ENDINGS)}], CAST(p_partkey % {len(_ENDINGS)} + 1 AS INTEGER)) AS name FROM part)
SELECT p_partkey, {_company_sql('name')} AS key FROM named""")
def n2(spark, folder):
    ending = F.element_at(F.array(*map(F.lit, _ENDINGS)), (F.col("p_partkey") % len(_ENDINGS) + 1).cast("int"))
    name = F.concat(F.lit("  "), "p_name", F.lit("  O'Neil "), ending)
    return table(spark, folder, "part").select("p_partkey", normalize.company_key(name).alias("key"))


@query("n3_phone_key", """
SELECT c_custkey, right(regexp_replace('+1 (555) ' || c_custkey * 37 || '-' || c_nationkey, '[^0-9]', '', 'g'), 7) AS key FROM customer""")
def n3(spark, folder):
    phone = F.concat(F.lit("+1 (555) "), (F.col("c_custkey") * 37).cast("string"), F.lit("-"), F.col("c_nationkey").cast("string"))
    return table(spark, folder, "customer").select("c_custkey", normalize.phone_key(phone).alias("key"))


# --- pair scores --------------------------------------------------------------------------------------


@query("n4_email_score", """
SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 1.0 WHEN 1 THEN 0.8 ELSE 0.0 END::DOUBLE AS score,
       CASE o_orderkey % 4 WHEN 0 THEN 'email_exact' WHEN 1 THEN 'email_domain' WHEN 2 THEN 'email_mismatch' ELSE 'no_email' END AS method FROM orders""")
def n4(spark, folder):
    k = F.col("o_orderkey")
    own = F.concat(F.lit("U"), F.col("o_custkey").cast("string"))
    a = F.concat(own, F.lit("@Acme.com "))
    b = F.when(k % 4 == 0, F.lower(F.trim(a))).when(k % 4 == 1, F.lit("other@acme.com")).when(k % 4 == 2, F.lit("x@y.com")).otherwise("")
    a, b = similarity.clean_email(a), similarity.clean_email(b)
    return table(spark, folder, "orders").select(k, similarity.score_email(a, b).alias("score"), similarity.email_method(a, b).alias("method"))


# Longest common subsequences row by row: a row is the running maximum of what the row before and the next letter allow.
_NAME_SQL = """WITH RECURSIVE pairs AS (
  SELECT a.p_partkey, lower(a.p_name) AS a, lower(b.p_name) AS b FROM part a JOIN part b ON b.p_partkey = a.p_partkey + 1),
names AS (
  SELECT DISTINCT a, b, list_sort(list_filter(string_split(a, ' '), lambda x: x <> '')) AS wa, list_sort(list_filter(string_split(b, ' '), lambda x: x <> '')) AS wb
  FROM pairs),
sets AS (
  SELECT *, list_sort(list_distinct(list_filter(wa, lambda x: list_contains(wb, x)))) AS both_words,
         list_sort(list_distinct(list_filter(wa, lambda x: NOT list_contains(wb, x)))) AS rest_a,
         list_sort(list_distinct(list_filter(wb, lambda x: NOT list_contains(wa, x)))) AS rest_b FROM names),
texts AS (
  SELECT a, b, array_to_string(wa, ' ') AS sa, array_to_string(wb, ' ') AS sb, array_to_string(both_words, ' ') AS shared,
         array_to_string(rest_a, ' ') AS oa, array_to_string(rest_b, ' ') AS ob, trim(concat(array_to_string(both_words, ' '), ' ', array_to_string(rest_a, ' '))) AS ta,
         trim(concat(array_to_string(both_words, ' '), ' ', array_to_string(rest_b, ' '))) AS tb,
         greatest(length(a), length(b)) / least(length(a), length(b)) AS spread FROM sets),
sides AS (
  SELECT a, b, kind, CASE WHEN length(x) <= length(y) THEN x ELSE y END AS s, CASE WHEN length(x) <= length(y) THEN y ELSE x END AS l
  FROM (SELECT a, b, 'plain' AS kind, a AS x, b AS y FROM texts UNION ALL SELECT a, b, 'sorted', sa, sb FROM texts UNION ALL SELECT a, b, 'rest', oa, ob FROM texts)),
stretches AS (
  SELECT a, b, kind, s, substr(l, greatest(at_, 0) + 1, at_ + length(s) - greatest(at_, 0)) AS piece
  FROM (SELECT *, unnest(range(1 - length(s), length(l))) AS at_ FROM sides WHERE s <> '')),
needed AS (
  SELECT a AS x, b AS y FROM texts UNION SELECT sa, sb FROM texts UNION SELECT ta, tb FROM texts UNION SELECT shared, ta FROM texts
  UNION SELECT shared, tb FROM texts UNION SELECT s, piece FROM stretches),
steps(x, y, i, line) AS (
  SELECT x, y, 0, list_transform(range(length(y) + 1), lambda j: 0) FROM needed
  UNION ALL
  SELECT x, y, i + 1, list_transform(range(1, length(y) + 2), lambda j: list_max(list_slice(reach, 1, j))) FROM (
    SELECT x, y, i, list_transform(range(1, length(y) + 2), lambda j: CASE WHEN j > 1 AND substr(y, CAST(j - 1 AS INTEGER), 1) = substr(x, i + 1, 1)
      THEN greatest(line[j], line[j - 1] + 1) ELSE line[j] END) AS reach FROM steps WHERE i < length(x))),
ratios AS (
  SELECT x, y, CASE WHEN length(x) + length(y) = 0 THEN 100.0 ELSE 200.0 * line[-1] / (length(x) + length(y)) END::DOUBLE AS ratio FROM steps WHERE i = length(x)),
best AS (
  SELECT d.a, d.b, d.kind, CASE WHEN d.s = '' THEN CASE WHEN d.l = '' THEN 100.0 ELSE 0.0 END WHEN contains(d.l, d.s) THEN 100.0 ELSE max(ratio) END AS best
  FROM sides d LEFT JOIN stretches p ON p.a = d.a AND p.b = d.b AND p.kind = d.kind LEFT JOIN ratios ON x = p.s AND y = piece GROUP BY d.a, d.b, d.kind, d.s, d.l),
judged AS (
  SELECT t.*, p.ratio AS plain, greatest(n.ratio, w.ratio, CASE WHEN shared <> '' THEN ra.ratio END, CASE WHEN shared <> '' THEN rb.ratio END) AS words,
         (SELECT best FROM best z WHERE z.a = t.a AND z.b = t.b AND kind = 'plain') AS inside,
         (SELECT max(best) FROM best z WHERE z.a = t.a AND z.b = t.b AND kind <> 'plain') AS inside_words
  FROM texts t JOIN ratios p ON p.x = t.a AND p.y = t.b JOIN ratios n ON n.x = sa AND n.y = sb JOIN ratios w ON w.x = ta AND w.y = tb
  JOIN ratios ra ON ra.x = shared AND ra.y = ta JOIN ratios rb ON rb.x = shared AND rb.y = tb),
scored AS (
  SELECT a, b, CASE WHEN a = '' OR b = '' THEN 0.0 WHEN a = b THEN 100.0
    WHEN spread < 1.5 THEN greatest(plain, 0.95 * CASE WHEN sa = '' OR sb = '' THEN 0.0 WHEN shared <> '' AND (oa = '' OR ob = '') THEN 100.0 ELSE words END)
    ELSE greatest(plain, CASE WHEN spread <= 8 THEN 0.9 ELSE 0.6 END * inside, CASE WHEN spread <= 8 THEN 0.9 ELSE 0.6 END * 0.95
      * CASE WHEN shared <> '' THEN 100.0 WHEN sa = '' OR sb = '' THEN 0.0 ELSE inside_words END) END / 100 AS similarity FROM judged)
SELECT p_partkey, p.a AS a_name, p.b AS b_name, round(similarity + 1e-9, 4) AS similarity,
       round(CASE WHEN similarity >= 0.95 THEN 1.0 WHEN similarity >= 0.8 THEN similarity ELSE 0.0 END + 1e-9, 4) AS score
FROM pairs p JOIN scored s ON s.a = p.a AND s.b = p.b"""


@query("n5_name_score", _NAME_SQL)
def n5(spark, folder):
    parts = table(spark, folder, "part").select("p_partkey", F.lower("p_name").alias("a_name"))
    following = parts.select((F.col("p_partkey") - 1).alias("p_partkey"), F.col("a_name").alias("b_name"))
    scored = matching.with_similarity(parts.join(following, "p_partkey"))
    return scored.select("p_partkey", "a_name", "b_name", number("similarity").alias("similarity"),
                         number(similarity.name_score(F.col("similarity"))).alias("score"))


@query("n6_temporal_score", """
SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS line, CASE WHEN abs(days) <= 3 THEN 1.0 - abs(days) / 4.0 ELSE 0.0 END::DOUBLE AS score FROM (
  SELECT l_orderkey, l_linenumber, CAST(floor((epoch(l_shipdate) - epoch(o_orderdate) - 43200 * (l_orderkey % 5)) / 86400) AS BIGINT) AS days
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey)""")
def n6(spark, folder):
    rows = table(spark, folder, "lineitem").join(table(spark, folder, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    later = F.col("o_orderdate") + F.make_interval(hours=(F.lit(12) * (F.col("l_orderkey") % 5)).cast("int"))
    a = similarity.iso_micros(F.date_format("l_shipdate", "yyyy-MM-dd"))
    b = similarity.iso_micros(F.date_format(later, "yyyy-MM-dd'T'HH:mm:ss"))
    return rows.select("l_orderkey", F.col("l_linenumber").cast("long").alias("line"), similarity.score_temporal(a, b, F.lit(True)).alias("score"))


@query("n7_amount_score", """
SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS line, CASE WHEN a = 0 AND b = 0 THEN 0.5 WHEN abs(a - b) / nullif(greatest(abs(a), abs(b)), 0) <= 0.05 THEN 1.0
       WHEN abs(a - b) / nullif(greatest(abs(a), abs(b)), 0) <= 0.10 THEN 0.7 ELSE 0.0 END::DOUBLE AS score
FROM (SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber = 1 THEN 0 ELSE l_quantity END AS a, CASE WHEN l_linenumber = 1 THEN 0 ELSE l_quantity * (1 + l_discount) END AS b FROM lineitem)""")
def n7(spark, folder):
    first = F.col("l_linenumber") == 1
    a = F.when(first, 0.0).otherwise(F.col("l_quantity"))
    b = F.when(first, 0.0).otherwise(F.col("l_quantity") * (1 + F.col("l_discount")))
    return table(spark, folder, "lineitem").select("l_orderkey", F.col("l_linenumber").cast("long").alias("line"), similarity.score_amount(a, b).alias("score"))


_PAIR_SCORES = "a_id, b_id, email_score, name_score, temporal_score, amount_score, total_score"


def _score_list(pairs):
    return pairs.select(F.col("a_record_id").alias("a_id"), F.col("b_record_id").alias("b_id"),
                        *[number(c).alias(c) for c in ("email_score", "name_score", "temporal_score", "amount_score", "total_score")])


def _score_sql(rows):
    return f"""SELECT a_id, b_id, CAST(email_score AS DOUBLE) AS email_score, CAST(name_score AS DOUBLE) AS name_score,
  CAST(temporal_score AS DOUBLE) AS temporal_score, CAST(amount_score AS DOUBLE) AS amount_score, CAST(total_score AS DOUBLE) AS total_score FROM {rows}"""


@query("n9_given_pairs", f"""WITH RECURSIVE {MATCHES_SQL},
totals AS (SELECT *, round(CAST(email_score AS DOUBLE) * 0.35 + name_score * 0.25 + temporal_score * 0.10 + amount_score * 0.10, 4) AS total_score FROM scored
           WHERE a_source = 'csv' AND b_source = 'stripe' AND substr(a_id, 2) = substr(b_id, 2))
{_score_sql('totals')}""")
def n9(spark, folder):
    given = table(spark, folder, "part").select(
        F.lit("csv").alias("a_source"), F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("a_id"),
        F.lit("stripe").alias("b_source"), F.concat(F.lit("c"), F.col("p_partkey").cast("string")).alias("b_id"))
    return _score_list(matching.score_pairs(given, records(spark, folder)))


@query("n9_evidence", f"""WITH RECURSIVE {MATCHES_SQL}
SELECT a_id, b_id, concat_ws(' | ',
  CASE WHEN email_score = 1 THEN 'email_exact: ' ELSE 'email_domain: ' END || a.email || ' <> ' || b.email,
  CASE WHEN name_score > 0 THEN 'name_exact: ' || a.company_name || ' <> ' || b.company_name END,
  CASE WHEN temporal_score > 0 THEN 'temporal_match_' || days || 'd' END,
  CASE WHEN amount_score = 1 THEN 'amount_exact' WHEN amount_score > 0.6 THEN 'amount_close' WHEN amount_score > 0 THEN 'both_zero' END) AS evidence
FROM matches JOIN records a ON a.source_type = a_source AND a.record_id = a_id JOIN records b ON b.source_type = b_source AND b.record_id = b_id""")
def n9_evidence(spark, folder):
    pairs = matching.match_records(records(spark, folder))
    return pairs.select(F.col("a_record_id").alias("a_id"), F.col("b_record_id").alias("b_id"), F.array_join("evidence", " | ").alias("evidence"))


# --- blocks ---------------------------------------------------------------------------------------------


KEYS_SQL = RECORDS_SQL + """,
keys AS (
  SELECT source_type, record_id, 'email_domain' AS strategy, 'd' || domain_no || '.com' AS key FROM records
  UNION ALL SELECT source_type, record_id, 'company_name', lower(substr(company_name, 1, 12)) FROM records
  UNION ALL SELECT source_type, record_id, 'phone', right(phone, 7) FROM records),
counts AS (SELECT strategy, key, source_type, count(*) AS n FROM keys GROUP BY 1, 2, 3)
"""


def _blocks(strategy):
    def run(spark, folder):
        chosen = [s for s in blocking.STRATEGIES if s.name == strategy]
        return blocking.block_sizes(blocking.block_keys(records(spark, folder), chosen))
    return run


for place, strategy in enumerate(("email_domain", "company_name", "phone"), 1):
    QUERIES[f"j{place}_{strategy}_blocks"] = _blocks(strategy)
    ORACLES[f"j{place}_{strategy}_blocks"] = f"""WITH {KEYS_SQL}
SELECT strategy, key, CAST(count(*) AS BIGINT) AS sources, CAST(sum(n) AS BIGINT) AS records, CAST((sum(n) * sum(n) - sum(n * n)) // 2 AS BIGINT) AS pairs
FROM counts WHERE strategy = '{strategy}' GROUP BY 1, 2"""


@query("j4_block_index", f"WITH {KEYS_SQL} SELECT source_type, record_id, strategy, key FROM keys")
def j4(spark, folder):
    return blocking.block_keys(records(spark, folder))


@query("j5_source_pairs", f"""WITH {KEYS_SQL}
SELECT a.strategy, a.source_type AS source_a, b.source_type AS source_b, CAST(sum(a.n * b.n) AS BIGINT) AS candidate_pairs
FROM counts a JOIN counts b ON a.strategy = b.strategy AND a.key = b.key AND a.source_type < b.source_type GROUP BY 1, 2, 3""")
def j5(spark, folder):
    rows = records(spark, folder)
    per_strategy = [blocking.candidate_counts(rows, [s]).withColumn("strategy", F.lit(s.name)) for s in blocking.STRATEGIES]
    return per_strategy[0].unionByName(per_strategy[1]).unionByName(per_strategy[2])


@query("u1_candidate_union", f"""WITH {KEYS_SQL}
SELECT source_a, source_b, CAST(count(*) AS BIGINT) AS candidate_pairs FROM (
  SELECT DISTINCT a.source_type AS source_a, b.source_type AS source_b, a.record_id AS a_id, b.record_id AS b_id
  FROM keys a JOIN keys b ON a.strategy = b.strategy AND a.key = b.key AND a.source_type < b.source_type) GROUP BY 1, 2""")
def u1(spark, folder):
    return blocking.candidate_counts(records(spark, folder))


def _copies(spark, folder):
    """Line items as records with several copies per id."""
    return table(spark, folder, "lineitem").select(
        F.lit("erp").alias("source_type"), F.col("l_orderkey").alias("record_id"),
        F.struct(F.col("l_linenumber").alias("line"), F.col("l_quantity").alias("quantity")).alias("data"),
        F.col("l_shipdate").alias("extracted_at"), F.lpad(F.concat_ws("-", "l_linenumber", "l_partkey", "l_suppkey"), 30, "0").alias("record_hash"))


@query("j12_latest_records", """
SELECT CAST(l_orderkey AS VARCHAR) AS record_id,
       CAST(arg_max(l_linenumber, {'at': l_shipdate, 'hash': lpad(l_linenumber || '-' || l_partkey || '-' || l_suppkey, 30, '0')}) AS BIGINT) AS line,
       arg_max(l_quantity, {'at': l_shipdate, 'hash': lpad(l_linenumber || '-' || l_partkey || '-' || l_suppkey, 30, '0')}) AS quantity
FROM lineitem GROUP BY 1""")
def j12(spark, folder):
    rows = blocking.latest_records(_copies(spark, folder))
    return rows.select("record_id", F.col("data.line").cast("long").alias("line"), "data.quantity")


@query("u5_source_split", f"""WITH {RECORDS_SQL}
SELECT CASE WHEN source_type = 'postgres' THEN 'unknown' ELSE source_type END AS source_type, CAST(count(*) AS BIGINT) AS n FROM records GROUP BY 1""")
def u5(spark, folder):
    rows = records(spark, folder)
    rows = rows.withColumn("source_type", F.when(F.col("source_type") != "postgres", F.col("source_type")))
    return blocking.with_source(rows).groupBy("source_type").agg(F.count(F.lit(1)).alias("n"))


# --- matches, clusters, golden records --------------------------------------------------------------


@query("p5_matches", f"WITH RECURSIVE {MATCHES_SQL} {_score_sql('matches')}")
def p5(spark, folder):
    return _score_list(matching.match_records(records(spark, folder)))


@query("p6_review_band", f"WITH RECURSIVE {MATCHES_SQL} {_score_sql('matches WHERE total_score < 0.7')}")
def p6(spark, folder):
    return _score_list(matching.review_pairs(matching.match_records(records(spark, folder))))


@query("j6_weak_matches", f"""WITH RECURSIVE {MATCHES_SQL},
totals AS (SELECT *, round(CAST(email_score AS DOUBLE) * 0.35 + name_score * 0.25 + temporal_score * 0.10 + amount_score * 0.10, 4) AS total_score FROM scored)
{_score_sql('totals WHERE total_score >= 0.46')}""")
def j6(spark, folder):
    return _score_list(matching.match_records(records(spark, folder), threshold=0.46))


@query("u4_components", f"WITH RECURSIVE {MATCHES_SQL} SELECT node, cluster_id FROM components")
def u4(spark, folder):
    nodes = checkpointed(matching.match_nodes(checkpointed(matching.record_profiles(records(spark, folder)))))
    names = checkpointed(matching.similar_names(nodes))
    return clustering.connected_components(matching.match_links(nodes, names), "a_node", "b_node")


@query("a11_cluster_confidence", f"""WITH RECURSIVE {MATCHES_SQL}
SELECT cluster_id, CAST(max_confidence AS DOUBLE) AS max_confidence, round(avg_confidence + 1e-9, 6) AS avg_confidence, CAST(pairs AS BIGINT) AS pairs FROM confidence""")
def a11(spark, folder):
    clusters = resolve_entities(records(spark, folder), unique_ids=True).clusters
    return clusters.select("cluster_id", "max_confidence", number("avg_confidence", 6).alias("avg_confidence"), "pairs")


def _place(sources):
    return "CASE source_type " + " ".join(f"WHEN '{s}' THEN {i}" for i, s in enumerate(sources)) + f" ELSE {len(sources)} END" if sources else "0"


def _pick_sql(field):
    place = _place(golden.FIELD_SOURCES.get(field, ()))
    weight = "CASE source_type " + " ".join(f"WHEN '{s}' THEN {-w}" for s, w in golden.SOURCE_PRIORITY.items()) + " ELSE 0 END"
    return f"""arg_min({field}, {{'a': {place}, 'b': {weight}, 'c': source_type, 'd': record_id}}) FILTER ({field} IS NOT NULL) AS {field}"""


_FIELDS = ("email", "company_name", "phone", "created_at", "mrr", "seats")
GOLDEN_SQL = MATCHES_SQL + f""",
golden AS (
  SELECT cluster_id AS entity_id, {', '.join(map(_pick_sql, _FIELDS))}, count(*) AS source_count FROM members GROUP BY 1),
alone AS (
  SELECT source_type || ':' || record_id AS entity_id, {', '.join(_FIELDS)}, 1 AS source_count, 1.0 AS confidence, source_type, record_id FROM records
  WHERE source_type || ':' || record_id NOT IN (SELECT node FROM components))
"""
_ENTITY = f"entity_id, {', '.join(_FIELDS)}, CAST(source_count AS BIGINT) AS source_count"
_JOINED_SQL = f"SELECT {_ENTITY}, round(avg_confidence + 1e-9, 6) AS confidence FROM golden JOIN confidence ON cluster_id = entity_id"
_ALONE_SQL = f"SELECT {_ENTITY}, CAST(confidence AS DOUBLE) AS confidence FROM alone"


def _entities(rows):
    return rows.select("entity_id", *_FIELDS, F.col("_source_count").cast("long").alias("source_count"), number("_confidence", 6).alias("confidence"))


@query("a12_golden_records", f"WITH RECURSIVE {GOLDEN_SQL} {_JOINED_SQL}")
def a12(spark, folder):
    rows = records(spark, folder)
    resolved = resolve_entities(rows, unique_ids=True)
    members = resolved.lineage.join(resolved.clusters.select(F.col("cluster_id").alias("entity_id")), "entity_id").withColumnRenamed("entity_id", "cluster_id")
    return _entities(golden.golden_records(members, rows, resolved.clusters))


@query("j8_unmatched", f"WITH RECURSIVE {GOLDEN_SQL} {_ALONE_SQL}")
def j8(spark, folder):
    rows = records(spark, folder)
    resolved = resolve_entities(rows, unique_ids=True)
    members = resolved.lineage.join(resolved.clusters, F.col("entity_id") == F.col("cluster_id"))
    return _entities(golden.unmatched_records(rows, members))


@query("r1_resolved_entities", f"WITH RECURSIVE {GOLDEN_SQL} {_JOINED_SQL} UNION ALL {_ALONE_SQL}")
def r1(spark, folder):
    return _entities(resolve_entities(records(spark, folder)).entities)


_MIXED = {"email": ("email", "stripe"), "company_name": ("company_name", "stripe"), "email_address": ("email", "postgres"), "company": ("company_name", "postgres"),
          "phone_number": ("phone", "postgres"), "seats": ("seats", "postgres"), "contact_email": ("email", "csv"), "name": ("company_name", "csv"),
          "tel": ("phone", "csv"), "signup_date": ("created_at", "csv")}
_MIXED_SQL = f"""
SELECT cluster_id AS entity_id, {', '.join(f"arg_min({old}, record_id) FILTER (source_type = '{source}' AND {old} IS NOT NULL) AS {new}" for new, (old, source) in _MIXED.items())},
       {_pick_sql('created_at').replace('FILTER (', "FILTER (source_type <> 'csv' AND ")}, {_pick_sql('mrr')}, {_pick_sql('status')}, CAST(count(*) AS BIGINT) AS source_count
FROM members GROUP BY 1
UNION ALL
SELECT source_type || ':' || record_id, {', '.join(f"CASE WHEN source_type = '{source}' THEN {old} END" for old, source in _MIXED.values())},
       CASE WHEN source_type <> 'csv' THEN created_at END, mrr, status, 1
FROM records WHERE source_type || ':' || record_id NOT IN (SELECT node FROM components)"""


@query("r1_mixed_sources", f"WITH RECURSIVE {MATCHES_SQL} {_MIXED_SQL}")
def r1_mixed(spark, folder):
    found = resolve_entities(unite(*mixed_records(spark, folder))).entities
    return found.select("entity_id", *_MIXED, "created_at", "mrr", "status", F.col("_source_count").cast("long").alias("source_count"))


@query("r1_mixed_maps", f"WITH RECURSIVE {MATCHES_SQL}, entities AS ({_MIXED_SQL}) SELECT entity_id, email, contact_email, seats, status, source_count FROM entities")
def r1_maps(spark, folder):
    first, *others = mixed_records(spark, folder)
    found = resolve_entities(unite(as_map(first), *others)).entities
    return found.select("entity_id", *[F.col("data")[c].alias(c) for c in ("email", "contact_email")], F.col("data")["seats"].cast("long").alias("seats"),
                        F.col("data")["status"].alias("status"), F.col("_source_count").cast("long").alias("source_count"))


# Amounts under three names; that of one source is no amount to the scores, so its pairs have no amount score.
_AMOUNTS = {**_MIXED, "mrr_amount": ("mrr", "csv"), "mrr": ("mrr", "stripe"), "revenue": ("mrr", "postgres")}
_AMOUNT_MATCHES_SQL = MATCHES_SQL.replace("CASE WHEN a_mrr = 0", "CASE WHEN a_source = 'csv' OR b_source = 'csv' THEN 0.0 WHEN a_mrr = 0")
_ANALYSE_SQL = f"""WITH RECURSIVE {_AMOUNT_MATCHES_SQL}, entities AS (
  SELECT cluster_id AS entity_id, {', '.join(f"arg_min({old}, record_id) FILTER (source_type = '{source}' AND {old} IS NOT NULL) AS {new}" for new, (old, source) in _AMOUNTS.items())},
         {_pick_sql('status')} FROM members GROUP BY 1
  UNION ALL
  SELECT source_type || ':' || record_id, {', '.join(f"CASE WHEN source_type = '{source}' THEN {old} END" for old, source in _AMOUNTS.values())}, status
  FROM records WHERE source_type || ':' || record_id NOT IN (SELECT node FROM components)),
totals AS (
  SELECT sum(coalesce(mrr_amount, mrr, revenue)) FILTER (status = 'active') AS mrr, CAST(count(*) FILTER (status = 'active') AS DOUBLE) AS active_customers,
         CAST(count(*) AS BIGINT) AS n FROM entities),
now AS (
  SELECT n, unnest(['mrr', 'new_mrr', 'expansion_mrr', 'contraction_mrr', 'churn_mrr', 'nrr', 'active_customers', 'arpu', 'quick_ratio', 'logo_churn_rate']) AS metric_id,
         unnest([mrr, 0, 0, 0, 0, 0, active_customers, mrr / active_customers, 0, 0]) AS value FROM totals),
earlier AS (SELECT 'mrr' AS metric_id, arg_max(value, period) AS previous_value FROM (
  SELECT date_trunc('month', o_orderdate) AS period, CAST(sum(CAST(o_totalprice AS DECIMAL(32,6))) AS DOUBLE) AS value FROM orders GROUP BY 1)),
rows AS (SELECT metric_id, value, previous_value, n FROM now LEFT JOIN earlier USING (metric_id))
SELECT metric_id, round(value + 1e-9, 2) AS value, round(previous_value + 1e-9, 2) AS previous_value,
       round((value - previous_value) / nullif(previous_value, 0) * 100 + 1e-9, 4) AS change_percent, n AS entity_count,
       CASE WHEN metric_id = 'mrr' THEN abs((value - previous_value) / previous_value) > 0 END AS changed, CAST(3 AS BIGINT) AS validations
FROM rows"""


def _analysed(spark, folder, sources):
    month = F.to_date(F.date_trunc("month", "o_orderdate"))
    history = table(spark, folder, "orders").groupBy(month.alias("period_date")).agg(exact_sum(F.col("o_totalprice")).alias("value")).withColumn("metric_id", F.lit("mrr"))
    result = analyse(unite(*sources), "2035-01-15", history)
    checks = result.validations.agg(F.count(F.lit(1)).alias("validations"))
    changed = result.anomalies.where("metric_id = 'mrr'").select("metric_id", F.lit(True).alias("changed")).distinct()
    rows = result.metrics.join(F.broadcast(changed), "metric_id", "left").join(F.broadcast(checks), F.lit(True))
    return rows.select("metric_id", number("value", 2).alias("value"), number("previous_value", 2).alias("previous_value"),
                       number("change_percent").alias("change_percent"), "entity_count", "changed", "validations")


@query("r6_analyse", _ANALYSE_SQL)
def r6(spark, folder):
    return _analysed(spark, folder, mixed_records(spark, folder, ("mrr", "revenue", "mrr_amount")))


@query("r6_analyse_maps", _ANALYSE_SQL)
def r6_maps(spark, folder):
    first, *others = mixed_records(spark, folder, ("mrr", "revenue", "mrr_amount"))
    return _analysed(spark, folder, [as_map(first), *others])


_PHONES = (Strategy("phone", ("phone", "phone_number", "tel"), phone_key, 7),)


@query("x6_phone_only", f"""WITH RECURSIVE {MATCHES_SQL.replace("a.source_type < b.source_type)", "a.source_type < b.source_type AND a.phone = b.phone)")}
SELECT node, cluster_id FROM components""")
def x6(spark, folder):
    """Custom strategies: only records with the same phone number may match, whatever their domain."""
    pairs = checkpointed(matching.match_records(records(spark, folder), strategies=_PHONES).select("a_node", "b_node"))
    return clustering.connected_components(pairs, "a_node", "b_node")


@query("u3_single_source", f"WITH {RECORDS_SQL} SELECT source_type || ':' || record_id AS entity_id, {', '.join(_FIELDS)}, CAST(1 AS BIGINT) AS source_count, CAST(1 AS DOUBLE) AS confidence FROM records WHERE source_type = 'stripe'")
def u3(spark, folder):
    return _entities(resolve_entities(stripe_records(spark, folder)).entities)


@query("u2_two_sources", f"""WITH RECURSIVE {GOLDEN_SQL.replace("a.source_type < b.source_type)", "a.source_type < b.source_type AND a.source_type <> 'csv')")}
{_JOINED_SQL} UNION ALL {_ALONE_SQL} WHERE source_type <> 'csv'""")
def u2(spark, folder):
    return _entities(resolve_entities(stripe_records(spark, folder).unionByName(postgres_records(spark, folder))).entities)


@query("j7_lineage", f"""WITH RECURSIVE {GOLDEN_SQL}
SELECT cluster_id AS entity_id, source_type, record_id FROM members UNION ALL SELECT entity_id, source_type, record_id FROM alone""")
def j7(spark, folder):
    return resolve_entities(records(spark, folder), unique_ids=True).lineage


@query("a13_nested_lineage", f"""WITH RECURSIVE {GOLDEN_SQL}, lines AS (
  SELECT cluster_id AS entity_id, source_type, record_id FROM members UNION ALL SELECT entity_id, source_type, record_id FROM alone),
placed AS (SELECT *, (row_number() OVER (PARTITION BY entity_id ORDER BY source_type, record_id) - 1) // 3 AS part FROM lines)
SELECT entity_id, CAST(part AS INTEGER) AS part, string_agg(source_type || ':' || record_id, ',' ORDER BY source_type, record_id) AS sources, CAST(count(*) AS BIGINT) AS n
FROM placed GROUP BY 1, 2""")
def a13(spark, folder):
    nested = golden.bounded_lineage(resolve_entities(records(spark, folder), unique_ids=True).lineage, 3)
    text = F.transform("_sources", lambda s: F.concat_ws(":", s["source_type"], s["record_id"]))
    return nested.select("entity_id", "part", F.array_join(text, ",").alias("sources"), F.size("_sources").cast("long").alias("n"))


@query("a10_counters", f"""WITH RECURSIVE {GOLDEN_SQL}
SELECT CAST((SELECT count(*) FROM golden) + (SELECT count(*) FROM alone) AS BIGINT) AS entity_count, CAST((SELECT count(*) FROM golden) AS BIGINT) AS clusters_found,
       CAST((SELECT count(DISTINCT source_type) FROM records) AS BIGINT) AS source_count, CAST((SELECT count(*) FROM records) AS BIGINT) AS record_count""")
def a10(spark, folder):
    return resolve_entities(records(spark, folder), unique_ids=True).counters()
