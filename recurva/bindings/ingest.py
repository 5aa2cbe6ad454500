"""Sources, sinks, column profiles, change records."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from recurva.bindings.tables import day, number, table
from recurva.functions.coerce import currency_to_double
from recurva.operators.blocking import latest_records
from recurva.session import scratch_path
from recurva.sources import billing, database, envelope, tabular
from recurva.streaming import changes, current

QUERIES, ORACLES = {}, {}


def query(name, sql=None):
    def register(function):
        QUERIES[name] = function
        if sql:
            ORACLES[name] = sql
        return function
    return register


def text_orders(spark, folder):
    """Orders as a CSV reader would deliver them: all text, currency amounts, blanks."""
    k = F.col("o_orderkey")
    amount = F.when(k % 7 == 0, "").otherwise(F.concat(F.lit("$"), F.format_number("o_totalprice", 2)))
    return table(spark, folder, "orders").select(
        k.cast("string").alias("Order Id"),
        F.when(k % 11 == 0, "").otherwise(F.col("o_custkey").cast("string")).alias("customer_id"),
        amount.alias("mrr"), F.col("o_orderstatus").alias(" Status"), day("o_orderdate").alias("created_at"),
        F.when(k % 4 == 0, "n/a").otherwise(F.col("o_custkey").cast("string")).alias("mixed"), F.lit("").alias("empty"),
        F.when((k > 50) & (k % 97 == 0), "gold").otherwise(k.cast("string")).alias("late"))


def csv_orders(spark, folder):
    """The same orders, written as CSV files in the order of their keys."""
    path = scratch_path(spark, "csv")
    text_orders(spark, folder).orderBy(F.col("Order Id").cast("long")).write.csv(
        path, header=True, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    return path


TEXT_SQL = """text_orders AS (
  SELECT o_orderkey AS k, CAST(o_orderkey AS VARCHAR) AS order_id, CASE WHEN o_orderkey % 11 = 0 THEN '' ELSE CAST(o_custkey AS VARCHAR) END AS customer_id,
         CASE WHEN o_orderkey % 7 = 0 THEN '' ELSE format('${:,.2f}', o_totalprice) END AS mrr, o_orderstatus AS status,
         CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS created_at,
         CASE WHEN o_orderkey % 4 = 0 THEN 'n/a' ELSE CAST(o_custkey AS VARCHAR) END AS mixed, '' AS empty,
         CASE WHEN o_orderkey > 50 AND o_orderkey % 97 = 0 THEN 'gold' ELSE CAST(o_orderkey AS VARCHAR) END AS late FROM orders)"""


@query("s1_csv_scan", """
SELECT CAST(c_custkey AS VARCHAR) AS customer_id, c_name AS name, CAST(round(c_acctbal * 100) AS BIGINT) AS cents,
       'say "hi", ' || c_mktsegment || chr(10) || 'twice' AS note FROM customer""")
def s1(spark, folder):
    path = scratch_path(spark, "csv")
    note = F.concat(F.lit('say "hi", '), "c_mktsegment", F.lit("\ntwice"))
    rows = table(spark, folder, "customer").select(
        F.col("c_custkey").alias("customer_id"), F.col("c_name").alias("name"),
        F.round(F.col("c_acctbal") * 100).cast("long").alias("cents"), note.alias("note"))
    rows.write.csv(path, header=True, escape='"', quoteAll=True)
    found = tabular.read_csv(spark, path)
    return found.select("customer_id", "name", F.col("cents").cast("long").alias("cents"), "note")


@query("s2_typed_cells", f"""WITH {TEXT_SQL}
SELECT coalesce(nullif(customer_id, ''), CAST(row_number() OVER (ORDER BY k) - 1 AS VARCHAR)) AS record_id, CAST(order_id AS DOUBLE) AS order_id,
       CAST(nullif(customer_id, '') AS DOUBLE) AS customer_id, TRY_CAST(regexp_replace(nullif(mrr, ''), '[,$]', '', 'g') AS DOUBLE) AS mrr, status,
       mixed, nullif(empty, '') AS empty, TRY_CAST(late AS DOUBLE) AS late, CASE WHEN late = 'gold' THEN late END AS raw_late FROM text_orders""")
def s2(spark, folder):
    data = tabular.csv_records(spark, csv_orders(spark, folder), "shop").select("record_id", "data.*")
    return data.select("record_id", F.col("Order Id").alias("order_id"), "customer_id", "mrr", F.col(" Status").alias("status"), "mixed", "empty",
                       "late", F.col("_raw_late").alias("raw_late"))


_PROFILE_SQL = f"""WITH {TEXT_SQL},
cells AS (
  SELECT column_name, cell FROM (
    SELECT order_id AS "Order Id", customer_id, mrr, status AS " Status", created_at, mixed, empty, late FROM text_orders)
  UNPIVOT (cell FOR column_name IN ("Order Id", customer_id, mrr, " Status", created_at, mixed, empty, late))),
counted AS (
  SELECT column_name, count(*) FILTER (cell <> '') AS filled, count(*) AS row_count,
         count(*) FILTER (cell <> '' AND TRY_CAST(regexp_replace(cell, '[,$]', '', 'g') AS DOUBLE) IS NOT NULL) AS numbers,
         count(*) FILTER (regexp_matches(cell, '[-/T]') AND length(cell) >= 8) AS dates
  FROM cells GROUP BY 1)
SELECT column_name, CASE WHEN numbers / nullif(filled, 0) > 0.8 THEN 'numeric' WHEN dates / nullif(filled, 0) > 0.5 THEN 'timestamp'
                         ELSE 'string' END AS data_type"""


def _profile(spark, folder):
    return tabular.profile_columns(tabular.read_csv(spark, csv_orders(spark, folder)), "orders")


@query("s3_column_types", _PROFILE_SQL + " FROM counted")
def s3(spark, folder):
    return _profile(spark, folder).select("column_name", "data_type")


@query("s4_table_profile", _PROFILE_SQL.replace("cells AS (", """first_rows AS (SELECT * FROM text_orders ORDER BY k LIMIT 5),
samples AS (
  SELECT column_name, string_agg(cell, '|' ORDER BY k) AS sample_values FROM (
    SELECT k, order_id AS "Order Id", customer_id, mrr, status AS " Status", created_at, mixed, empty, late FROM first_rows)
  UNPIVOT (cell FOR column_name IN ("Order Id", customer_id, mrr, " Status", created_at, mixed, empty, late)) GROUP BY 1),
cells AS (""") + """, 'orders' AS table_name, CAST(filled AS BIGINT) AS filled, CAST(numbers AS BIGINT) AS numbers, CAST(row_count AS BIGINT) AS row_count,
  true AS nullable, false AS is_primary_key, sample_values FROM counted JOIN samples USING (column_name)""")
def s4(spark, folder):
    return _profile(spark, folder).drop("semantic_type").withColumn("sample_values", F.array_join("sample_values", "|"))


@query("s5_alias_columns", f"""WITH {TEXT_SQL}
SELECT order_id, nullif(customer_id, '') AS customer_entity_id, coalesce(nullif(mrr, ''), CASE WHEN k % 14 = 0 THEN CAST(k AS VARCHAR) END) AS mrr_amount,
       status, created_at FROM text_orders""")
def s5(spark, folder):
    """Amounts under two names: rows whose first is blank are read from the second."""
    k = F.col("Order Id").cast("long")
    rows = tabular.metric_names(text_orders(spark, folder).withColumn("Revenue", F.when(k % 14 == 0, k.cast("string"))))
    return rows.select(F.col("Order Id").alias("order_id"), "customer_entity_id", "mrr_amount", "status", "created_at")


@query("s6_semantic_tags", f"""WITH {TEXT_SQL}, tags(column_name, semantic_type) AS (VALUES ('Order Id', NULL), ('customer_id', 'customer_id'),
  ('mrr', 'mrr'), (' Status', 'status'), ('created_at', 'created_at'), ('mixed', NULL), ('empty', NULL), ('late', NULL))
SELECT column_name, semantic_type, (SELECT CAST(count(*) AS BIGINT) FROM text_orders) AS row_count FROM tags""")
def s6(spark, folder):
    return _profile(spark, folder).select("column_name", "semantic_type", "row_count")


@query("s7_record_ids", f"""WITH {TEXT_SQL}, placed AS (SELECT *, row_number() OVER (ORDER BY k) - 1 AS place FROM text_orders)
SELECT order_id, coalesce(nullif(customer_id, ''), CAST(place AS VARCHAR)) AS record_id FROM placed""")
def s7(spark, folder):
    rows = tabular.read_csv(spark, csv_orders(spark, folder))
    return rows.select(F.col("Order Id").alias("order_id"), tabular.record_id(rows).alias("record_id"))


def _customers(spark, folder):
    return table(spark, folder, "customer").select(
        F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("plan"),
        F.col("c_nationkey").alias("region"))


@query("s8_record_envelope", """
SELECT 'crm' AS source_type, 'conn-1' AS source_id, 'customer' AS object_type, CAST(c_custkey AS VARCHAR) AS record_id, 'create' AS change_type,
       c_name AS name, c_mktsegment AS plan, true AS has_time, 32 AS hash_length FROM customer""")
def s8(spark, folder):
    rows = envelope.wrap(_customers(spark, folder), "crm", "conn-1", "customer")
    return rows.select("source_type", "source_id", "object_type", "record_id", "change_type", "data.name", "data.plan",
                       F.col("extracted_at").isNotNull().alias("has_time"), F.length("record_hash").alias("hash_length"))


@query("s9_content_hash", """
SELECT o_orderpriority, CAST(count(*) AS BIGINT) AS n,
       CAST(count(DISTINCT coalesce(nullif(o_orderstatus, 'P'), '-') || '|' || (o_custkey % 100)) AS BIGINT) AS distinct_hashes
FROM orders GROUP BY 1""")
def s9(spark, folder):
    status = F.when(F.col("o_orderstatus") != "P", F.col("o_orderstatus"))
    rows = table(spark, folder, "orders").select("o_orderpriority", F.struct(status.alias("s"), (F.col("o_custkey") % 100).alias("c")).alias("data"))
    hashed = rows.withColumn("hash", envelope.content_hash(F.col("data"), ["s", "c"]))
    return hashed.groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("hash").alias("distinct_hashes"))


def _order_changes(spark, folder):
    return table(spark, folder, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"),
                                                 F.col("o_orderdate").alias("updated_at"))


@query("s9_nested_hash", """
SELECT o_orderpriority, CAST(count(DISTINCT o_orderstatus || '|' || (o_custkey % 50)) AS BIGINT) AS distinct_hashes FROM orders GROUP BY 1""")
def s9_nested(spark, folder):
    """Nested maps in two orders of their keys, within structs and arrays, count as one content."""
    status, buyer = F.col("o_orderstatus"), (F.col("o_custkey") % 50).cast("string")
    one, other = F.create_map(F.lit("s"), status, F.lit("c"), buyer), F.create_map(F.lit("c"), buyer, F.lit("s"), status)
    tags = F.when(F.col("o_orderkey") % 2 == 0, one).otherwise(other)
    rows = table(spark, folder, "orders").select("o_orderpriority", F.struct(tags.alias("tags")).alias("inner"), F.array(tags).alias("list"))
    records = envelope.envelope(rows, "shop", "conn-1", "order", F.lit(None), ["inner", "list"])
    placed = rows.select("o_orderpriority", envelope.content_hash(F.struct("inner", "list"), ["list", "inner"], envelope.field_kinds(rows.schema)).alias("hash"))
    known = placed.join(records.select(F.col("record_hash").alias("hash")).distinct(), "hash", "left_semi")
    return known.groupBy("o_orderpriority").agg(F.count_distinct("hash").alias("distinct_hashes"))


@query("s12_changed_rows", """
SELECT CAST(o_orderkey AS VARCHAR) AS record_id, o_orderstatus AS status, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS updated_on,
       'update' AS change_type, 'orders' AS object_type FROM orders WHERE o_orderdate > TIMESTAMP '1998-06-30'""")
def s12(spark, folder):
    rows = database.changed_records(_order_changes(spark, folder), "1998-06-30", "pg-1", "orders")
    return rows.select("record_id", "data.status", day("data.updated_at").alias("updated_on"), "change_type", "object_type")


@query("o4_ordered_changes", """
SELECT o_orderkey AS id, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS updated_on FROM orders WHERE o_orderdate > TIMESTAMP '2000-01-01'""")
def o4(spark, folder):
    rows = database.changed_since(_order_changes(spark, folder), "2000-01-01", ordered=True)
    return rows.select("id", day("updated_at").alias("updated_on"))


@query("s13_billing_objects", """
SELECT 'customer' AS object_type, 'cus_' || c_custkey AS record_id, c_name AS label, CAST(NULL AS BIGINT) AS amount FROM customer
UNION ALL
SELECT 'invoice', 'in_' || o_orderkey, 'cus_' || o_custkey, CAST(round(o_totalprice * 100) AS BIGINT) FROM orders""")
def s13(spark, folder):
    path = scratch_path(spark, "billing")
    table(spark, folder, "customer").select(
        F.concat(F.lit("cus_"), F.col("c_custkey").cast("string")).alias("id"), F.col("c_name").alias("name")).write.json(f"{path}/customer")
    table(spark, folder, "orders").select(
        F.concat(F.lit("in_"), F.col("o_orderkey").cast("string")).alias("id"),
        F.concat(F.lit("cus_"), F.col("o_custkey").cast("string")).alias("customer"),
        F.round(F.col("o_totalprice") * 100).cast("long").alias("amount_paid")).write.json(f"{path}/invoice")
    found = billing.read_objects(spark, path, "acct", ["customer", "invoice", "unheard_of"])
    people = found["customer"].select("object_type", "record_id", F.col("data.name").alias("label"), F.lit(None).cast("long").alias("amount"))
    return people.unionByName(found["invoice"].select("object_type", "record_id", F.col("data.customer").alias("label"),
                                                      F.col("data.amount_paid").alias("amount")))


@query("s10_rows_without_id", """
SELECT 'orders' AS object_type, o_orderstatus || ' ' || o_orderpriority AS label, CAST(count(DISTINCT o_custkey) AS BIGINT) AS records FROM orders GROUP BY ALL
UNION ALL SELECT 'customer', c_mktsegment, CAST(count(DISTINCT c_name) AS BIGINT) FROM customer GROUP BY ALL""")
def s10(spark, folder):
    """Tables without an `id` column, once with copies of rows: every distinct row stays a record."""
    orders = table(spark, folder, "orders").select(F.concat_ws(" ", "o_orderstatus", "o_orderpriority").alias("label"), F.col("o_custkey").alias("buyer"))
    people = table(spark, folder, "customer").select(F.col("c_mktsegment").alias("label"), F.col("c_name").alias("name"))
    rows = envelope.unite(database.table_records(orders, "pg-1", "orders"), database.table_records(people.unionAll(people), "my-1", "customer", "mysql"))
    kept = latest_records(rows)
    return kept.groupBy("object_type", F.col("data.label").alias("label")).agg(F.count(F.lit(1)).alias("records"))


@query("s14_billing_schemas", """
WITH declared(column_name, data_type, semantic_type, is_primary_key) AS (VALUES ('id', 'string', 'external_id', true), ('customer', 'string', 'external_id', false),
  ('amount_paid', 'integer', 'revenue_amount', false), ('status', 'string', 'status_flag', false), ('created', 'timestamp', 'created_timestamp', false)),
filled AS (
  SELECT CAST(count(*) AS BIGINT) AS n, CAST(count(*) FILTER (o_orderstatus <> 'P') AS BIGINT) AS told FROM orders)
SELECT 'invoice' AS table_name, column_name, data_type, semantic_type, is_primary_key, CASE WHEN column_name = 'status' THEN told ELSE n END AS filled
FROM declared, filled""")
def s14(spark, folder):
    """The declared columns of invoices, with the number of invoices that fill each when read by that schema."""
    path = scratch_path(spark, "invoices")
    rows = table(spark, folder, "orders").select(
        F.concat(F.lit("in_"), F.col("o_orderkey").cast("string")).alias("id"), F.concat(F.lit("cus_"), F.col("o_custkey").cast("string")).alias("customer"),
        F.round(F.col("o_totalprice") * 100).cast("long").alias("amount_paid"), F.when(F.col("o_orderstatus") != "P", F.col("o_orderstatus")).alias("status"),
        F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss").alias("created"), F.lit("x").alias("undeclared"))
    rows.write.json(path)
    declared = billing.describe_objects(spark, ["invoice"]).drop("nullable")
    read = spark.read.schema(billing.object_schema("invoice")).json(path)
    filled = read.agg(*[F.count(c).alias(c) for c in read.columns]).unpivot([], read.columns, "column_name", "filled")
    return declared.join(filled, "column_name")


def _event_name():
    suffix = F.when(F.col("event_type") == "signup", "created").when(F.col("event_type") == "error", "deleted").otherwise("updated")
    return F.concat("event_type", F.lit("."), suffix)


def billing_events(events):
    """Test events in the shape of a billing event log."""
    kind = F.when(F.col("user_id") % 5 != 0, "customer")
    amount = F.get_json_object("props", "$.k").cast("long")
    return events.select(
        _event_name().alias("type"), F.col("ts").alias("created"),
        F.struct(F.struct(kind.alias("object"), F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("id"),
                          amount.alias("k")).alias("object")).alias("data"))


_CHANGE_SQL = """
SELECT CASE event_type WHEN 'signup' THEN 'create' WHEN 'error' THEN 'delete' ELSE 'update' END AS change_type,
       CASE WHEN user_id % 5 <> 0 THEN 'customer' ELSE 'unknown' END AS object_type, 'u' || user_id AS record_id,
       CAST(count(*) AS BIGINT) AS n, CAST(sum(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS BIGINT) AS total
FROM events WHERE ts >= TIMESTAMP '2024-01-10' GROUP BY 1, 2, 3"""


def _change_totals(rows):
    return rows.groupBy("change_type", "object_type", "record_id").agg(
        F.count(F.lit(1)).alias("n"), F.sum("data.k").alias("total"))


@query("s15_event_changes", _CHANGE_SQL)
def s15(spark, folder):
    return _change_totals(billing.event_records(billing_events(table(spark, folder, "events")), "acct", "2024-01-10"))


@query("t1_change_stream", _CHANGE_SQL)
def t1(spark, folder):
    path = scratch_path(spark, "stream")
    schema = table(spark, folder, "events").schema
    stream = changes.read_stream(spark, folder, schema, "parquet", "events.parquet")
    changes.drain(stream, f"{path}/records", f"{path}/checkpoint",
                  lambda events: billing.event_records(billing_events(events), "acct", "2024-01-10"))
    return _change_totals(spark.read.parquet(f"{path}/records"))


@query("t1_current_records", """
WITH changes AS (
  SELECT *, CASE WHEN user_id % 5 <> 0 THEN 'customer' ELSE 'unknown' END AS object_type, 'u' || user_id AS record_id FROM events)
SELECT object_type, record_id, CAST(max(event_id) AS BIGINT) AS event_id, arg_max(CASE event_type WHEN 'signup' THEN 'create' ELSE 'update' END, event_id) AS change_type
FROM changes GROUP BY 1, 2 HAVING arg_max(event_type, event_id) <> 'error'""")
def t1_current(spark, folder):
    """The change log as files that arrive in several batches, not in their order, followed by state: deleted users are gone."""
    path = scratch_path(spark, "log")
    log = table(spark, folder, "events").select(
        F.lit("acct").alias("source_type"), F.when(F.col("user_id") % 5 != 0, "customer").otherwise("unknown").alias("object_type"),
        F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("record_id"), billing.change_kind(_event_name()).alias("change_type"),
        F.col("event_id").alias("version"))
    log.repartition(6, F.pmod(F.xxhash64("version"), F.lit(6))).write.parquet(f"{path}/log")
    stream = changes.read_stream(spark, f"{path}/log", log.schema, "parquet", max_files=2)
    current.drain_changes(stream, f"{path}/newer", f"{path}/checkpoint")
    rows = current.current_records(spark, f"{path}/newer")
    return rows.select("object_type", "record_id", F.col("version").alias("event_id"), "change_type")


@query("s16_json_export", """
SELECT '{"record_id":"' || c_custkey || '","name":"' || c_name || '","plan":' || CASE WHEN c_mktsegment = 'BUILDING' THEN 'null'
       ELSE '"' || c_mktsegment || '"' END || '}' AS document, (SELECT CAST(count(*) AS BIGINT) FROM customer) AS record_count FROM customer""")
def s16(spark, folder):
    rows = table(spark, folder, "customer").select(
        F.col("c_custkey").cast("string").alias("record_id"), F.col("c_name").alias("name"),
        F.when(F.col("c_mktsegment") != "BUILDING", F.col("c_mktsegment")).alias("plan"))
    count = rows.agg(F.count(F.lit(1)).alias("record_count"), F.lit(1).alias("one"))
    documents = envelope.to_json(rows).withColumn("one", F.lit(1))
    return documents.join(F.broadcast(count), "one").drop("one")


@query("s17_json_sink", "SELECT o_orderkey, o_orderstatus, round(o_totalprice + 1e-9, 2) AS o_totalprice FROM orders")
def s17(spark, folder):
    rows = table(spark, folder, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    path = scratch_path(spark, "json")
    envelope.write_json(rows, path)
    return spark.read.schema(rows.schema).json(path).withColumn("o_totalprice", number("o_totalprice", 2))


@query("s18_payload_rows", "SELECT CAST(o_orderkey AS VARCHAR) AS record_id, o_orderstatus AS status, o_custkey AS customer FROM orders")
def s18(spark, folder):
    k = F.col("o_orderkey")
    flat = F.struct(k.cast("string").alias("record_id"), F.col("o_orderstatus").alias("status"), F.col("o_custkey").alias("customer"))
    nested = F.struct(k.cast("string").alias("record_id"), F.struct(F.col("o_orderstatus").alias("status"), F.col("o_custkey").alias("customer")).alias("data"))
    item = F.when(k % 3 == 0, F.to_json(nested)).otherwise(F.to_json(flat))
    rows = table(spark, folder, "orders").select(
        F.when(k % 2 == 0, F.concat(F.lit("["), item, F.lit("]"))).otherwise(F.concat(F.lit('{"records":['), item, F.lit("]}"))).alias("payload"))
    kind = T.StructType([T.StructField("record_id", T.StringType()), T.StructField("status", T.StringType()), T.StructField("customer", T.LongType())])
    return envelope.unwrap_payload(rows, "payload", kind)


@query("o3_preview", "SELECT o_orderkey, o_orderstatus FROM orders ORDER BY o_orderkey LIMIT 500")
def o3(spark, folder):
    return envelope.preview(table(spark, folder, "orders").select("o_orderkey", "o_orderstatus"), 500, ("o_orderkey",))


@query("n15_currency_text", f"""WITH {TEXT_SQL}
SELECT order_id, TRY_CAST(regexp_replace(mrr, '[,$]', '', 'g') AS DOUBLE) AS amount, TRY_CAST(mixed AS DOUBLE) AS mixed FROM text_orders""")
def n15(spark, folder):
    rows = text_orders(spark, folder)
    return rows.select(F.col("Order Id").alias("order_id"), currency_to_double(F.col("mrr")).alias("amount"),
                       currency_to_double(F.col("mixed")).alias("mixed"))
