import csv
import datetime
import json
import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from recurva.plans.analyse import analyse
from recurva.plans.resolve import resolve_entities
from recurva.sources import billing, database, envelope, quoted, tabular
from recurva.streaming import changes, current

CSV = """customer_id,email,company_name,plan,status,mrr_amount,created_at,seats
cust_1,a@one.com,One Inc,growth,active,"$1,200.50",2024-01-15,5
cust_2,b@two.com,"Two, LLC",starter,active,299,2024-02-15,2
,c@three.com,"Three
Lines",starter,canceled,£49,2024-03-01,
cust_4,d@four.com,"Say ""Four\""",growth,active,,2024-03-02,7
"""


@pytest.fixture
def csv_file(tmp_path):
    path = tmp_path / "customers.csv"
    path.write_text("﻿" + CSV, encoding="utf-8")
    return str(path)


@pytest.mark.parametrize("cells, kind", [
    (["1.5", "£2", "€3,000", "-4", "n/a"], "string"),  # four in five is not above 80 %
    (["1.5", "£2", "€3,000", "-4", "5e2", "n/a"], "numeric"),
    (["2031-07-09T10:00:00Z", "09/07/2031", "none yet", "unclear"], "string"),  # one half is not above 50 %
    (["2031-07-09T10:00:00Z", "09/07/2031", "2031-07-10 08:00", "unclear"], "timestamp"),
    ([None, "", "7"], "numeric"), ([None, ""], "string"), (["0x1A", "12f", "Infinity?"], "string"),
    (["17"] * 40 + ["seventeen"] * 9, "numeric"), (["17"] * 20 + ["seventeen"] * 21, "string"),
])
def test_column_types(spark, cells, kind):
    rows = spark.createDataFrame([(c,) for c in cells], "v string")
    assert tabular.profile_columns(rows).first()["data_type"] == kind


@pytest.mark.parametrize("headers, meaning, found", [
    ([" Customer_Email ", "plan"], "email", " Customer_Email "), (["TIER", "pricing_plan"], "plan", "TIER"),
    (["account_id", "ID"], "customer_id", "ID"), (["signup_date", "Created"], "created_at", "Created"), (["seats", "notes"], "status", None),
])
def test_field_aliases(headers, meaning, found):
    assert tabular.resolve_field(headers, tabular.FIELD_ALIASES[meaning]) == found
    assert found is None or tabular.semantic_type(found) == meaning


def test_cells_that_are_no_numbers_are_kept(spark, tmp_path):
    path = tmp_path / "plans.csv"
    path.write_text("id,plan,seats\n" + "".join(f"{i},{'gold' if i > 110 else i * 10},{i}\n" for i in range(120)))
    rows = {r["record_id"]: r["data"] for r in tabular.csv_records(spark, str(path), "demo").collect()}
    assert len(rows) == 120 and "_raw_seats" not in rows["0"]
    assert all(d["plan"] == (None if i > 110 else i * 10.0) and d["_raw_plan"] == ("gold" if i > 110 else None) for i, d in ((int(k), v) for k, v in rows.items()))


def test_rows_without_ids_stay_apart(spark):
    rows = spark.createDataFrame([(f"n{i}",) for i in range(100)], "name string")
    records = database.table_records(rows, "pg", "people")
    assert records.select("record_id").distinct().count() == 100
    assert resolve_entities(records).counters().first()["entity_count"] == 100
    blank = spark.createDataFrame([(None, "a"), ("", "b"), ("7", "c")], "id string, name string")
    assert resolve_entities(database.table_records(blank, "pg", "people")).counters().first()["entity_count"] == 3


def test_csv_records(spark, csv_file):
    rows = {r["record_id"]: r for r in tabular.csv_records(spark, csv_file, "demo").collect()}
    assert set(rows) == {"cust_1", "cust_2", "2", "cust_4"}
    assert rows["cust_1"]["data"]["mrr_amount"] == 1200.5 and rows["cust_1"]["change_type"] == "create"
    assert rows["cust_1"]["object_type"] == "customers" and rows["cust_1"]["source_id"] == "demo"
    assert rows["2"]["data"]["company_name"] == "Three\nLines" and rows["2"]["data"]["seats"] is None
    assert rows["cust_4"]["data"]["company_name"] == 'Say "Four"' and rows["cust_4"]["data"]["mrr_amount"] is None
    assert len({r["record_hash"] for r in rows.values()}) == 4


def test_csv_profile(spark, csv_file):
    rows = {r["column_name"]: r for r in tabular.profile_columns(tabular.read_csv(spark, csv_file), "customers", samples=2).collect()}
    assert {n: r["data_type"] for n, r in rows.items()} == {
        "customer_id": "string", "email": "string", "company_name": "string", "plan": "string", "status": "string",
        "mrr_amount": "numeric", "created_at": "timestamp", "seats": "numeric"}
    assert rows["mrr_amount"]["semantic_type"] == "mrr" and rows["seats"]["semantic_type"] is None
    assert rows["seats"]["row_count"] == 4 and rows["customer_id"]["sample_values"] == ["cust_1", "cust_2"]


def test_missing_csv(spark, tmp_path):
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        tabular.read_csv(spark, str(tmp_path / "none.csv"))


def test_positions_over_many_files(spark, tmp_path):
    path = str(tmp_path / "many")
    spark.range(0, 1000, 1, 7).select(F.col("id").alias("n")).write.csv(path, header=True)
    rows = tabular.read_csv(spark, path)
    assert rows.where(F.col("n").cast("long") != F.col(tabular.POSITION)).count() == 0 and rows.count() == 1000


def test_positions_over_file_splits(spark, tmp_path):
    path = str(tmp_path / "one")
    spark.range(0, 20000, 1, 1).select(F.col("id").alias("n")).write.csv(path, header=True)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8192")
    try:
        rows = tabular.read_csv(spark, path)
        assert rows.rdd.getNumPartitions() > 1
        assert rows.where(F.col("n").cast("long") != F.col(tabular.POSITION)).count() == 0 and rows.count() == 20000
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


@pytest.mark.parametrize("size", [40, 333, 1 << 20])
def test_quoted_line_ends_over_parts(spark, tmp_path, size):
    """Records with line ends, quotes and commas in their values, in parts of any size, as Python's reader sees them."""
    rng = random.Random(size)
    cells = ["plain", 'say "hi", twice', "two\nlines", '"', "", "a,b", "\n\n\n", "x" * 90, '5" pipe\n', "é\nü", '""\n""']
    rows = [[str(i), rng.choice(cells), rng.choice(cells)] for i in range(300)]
    folder = tmp_path / "files"
    folder.mkdir()
    for place, end in enumerate(("\n", "\r\n")):
        with open(folder / f"{place}.csv", "w", newline="", encoding="utf-8") as out:
            writer = csv.writer(out, lineterminator=end, quoting=csv.QUOTE_MINIMAL if place else csv.QUOTE_ALL)
            writer.writerows([["n", "first", "Second Cell"], *rows[place * 150:place * 150 + 150]])
            out.write(end)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
    try:
        found = tabular.read_csv(spark, str(folder))
        assert found.columns == ["n", "first", "Second Cell", tabular.POSITION]
        got = [tuple(r) for r in found.orderBy(tabular.POSITION).collect()]
        parts = quoted.quoted_records(spark, str(folder)).select("file", "start").distinct().count()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert got == [(a, b or None if i >= 150 else b, c or None if i >= 150 else c, i) for i, (a, b, c) in enumerate(rows)] or [
        (a, b or "", c or "", p) for a, b, c, p in got] == [(a, b, c, i) for i, (a, b, c) in enumerate(rows)]
    assert parts > 8 if size < 1000 else parts == 2


def test_quoted_states():
    for line, outside, inside in [("a,b", False, True), ('"a', True, False), ('"a""', True, False), ('a"b', False, False), ('"a"",b', True, False), ('x,"y', True, False),
                                  ('",""",c', False, True), ('"",""', False, False), ("", False, True), ('a",b', False, False)]:
        assert quoted._ends_inside(line, False) is outside, line
    assert quoted._ends_inside('end",next', True) is False and quoted._ends_inside('end","next', True) is True and quoted._ends_inside('""', True) is True


def test_hash_ignores_column_order_and_sees_nulls(spark):
    rows = spark.createDataFrame([("x", None, ""), ("x", "", None)], "a string, b string, c string")
    hashes = [r[0] for r in rows.select(envelope.content_hash(F.struct("a", "b", "c"), ["a", "b", "c"])).collect()]
    turned = [r[0] for r in rows.select(envelope.content_hash(F.struct("c", "b", "a"), ["c", "b", "a"])).collect()]
    assert hashes == turned and hashes[0] != hashes[1]


def test_hash_ignores_order_at_every_depth(spark):
    kind = "a struct<m:map<string,struct<x:int,y:map<string,int>>>,l:array<map<string,int>>>"
    one = ({"p": (1, {"k": 1, "j": 2}), "q": None}, [{"u": 1, "v": 2}, {}])
    other = ({"q": None, "p": (1, {"j": 2, "k": 1})}, [{"v": 2, "u": 1}, {}])
    unlike = ({"p": (1, {"k": 2, "j": 1}), "q": None}, [{"u": 1, "v": 2}, {}])
    rows = spark.createDataFrame([(one,), (other,), (unlike,), (None,), ((None, None),)], kind)
    records = envelope.envelope(rows, "shop", "c", "thing", F.lit(None))
    hashes = [r["record_hash"] for r in records.collect()]
    assert hashes[0] == hashes[1] and len(set(hashes)) == 4
    turned = rows.select(F.col("a").withField("m", F.col("a.m")).alias("a"))
    assert [r["record_hash"] for r in envelope.envelope(turned, "shop", "c", "thing", F.lit(None)).collect()] == hashes


def test_changed_rows(spark):
    rows = spark.createDataFrame([(1, datetime.datetime(2024, 1, 1)), (2, datetime.datetime(2024, 2, 1))], "id int, modified_at timestamp")
    found = database.changed_records(rows, datetime.datetime(2024, 1, 1), "pg", "accounts").collect()
    assert [(r["record_id"], r["change_type"]) for r in found] == [("2", "update")]
    assert database.changed_records(rows.select("id"), "2024-01-01", "pg", "accounts") is None
    assert database.change_column(["last_modified", "updated_at"]) == "updated_at"


def test_database_helpers(spark):
    assert "'it''s'" in database.columns_query("it's")
    described = database.describe_tables(spark.createDataFrame(
        [("accounts", "id", "integer", "NO", 1), ("accounts", "name", "text", "YES", 2)],
        "table_name string, column_name string, data_type string, is_nullable string, ordinal_position int"))
    assert [(r["column_name"], r["nullable"]) for r in described.orderBy("ordinal_position").collect()] == [("id", False), ("name", True)]
    assert database.known_tables(described, ["nothing", "accounts"]) == ["accounts"]
    assert database.partition_options(None, None, "id", 4) == {}
    assert database.partition_options(1, 9, "id", 4)["numPartitions"] == "4"


def test_billing_objects(spark, tmp_path):
    (tmp_path / "customer").mkdir()
    (tmp_path / "customer" / "a.json").write_text(json.dumps({"id": "cus_1", "email": "a@x.com", "created": "2024-01-01T00:00:00Z"}))
    found = billing.read_objects(spark, str(tmp_path), "acct", ["customer", "nothing"])
    assert list(found) == ["customer"]
    row = found["customer"].first()
    assert row["record_id"] == "cus_1" and row["data"]["email"] == "a@x.com" and row["object_type"] == "customer"
    tables = {r["table_name"] for r in billing.describe_objects(spark).collect()}
    assert tables == {"customer", "subscription", "invoice"}


EVENT = T.StructType([
    T.StructField("type", T.StringType()), T.StructField("created", T.TimestampType()),
    T.StructField("data", T.StructType([T.StructField("object", T.StructType([
        T.StructField("object", T.StringType()), T.StructField("id", T.StringType()), T.StructField("status", T.StringType())]))])),
])


def write_event(folder, name, kind, created, obj):
    (folder / name).write_text(json.dumps({"type": kind, "created": created, "data": {"object": obj}}))


def test_stream_goes_on_where_it_stopped(spark, tmp_path):
    inbox = tmp_path / "in"
    inbox.mkdir()
    target, checkpoint = str(tmp_path / "out"), str(tmp_path / "checkpoint")

    def run():
        stream = changes.read_stream(spark, str(inbox), EVENT)
        changes.drain(stream, target, checkpoint, lambda e: billing.event_records(e, "acct"))
        return sorted((r["record_id"], r["object_type"], r["change_type"]) for r in spark.read.parquet(target).collect())

    write_event(inbox, "1.json", "customer.created", "2024-01-01T00:00:00Z", {"object": "customer", "id": "c1"})
    write_event(inbox, "2.json", "customer.deleted", "2024-01-02T00:00:00Z", {"id": "c2"})
    assert run() == [("c1", "customer", "create"), ("c2", "unknown", "delete")]
    write_event(inbox, "3.json", "invoice.paid", "2024-01-03T00:00:00Z", {"object": "invoice", "id": "i1", "status": "paid"})
    assert run() == [("c1", "customer", "create"), ("c2", "unknown", "delete"), ("i1", "invoice", "update")]


def test_current_records_follow_the_stream(spark, tmp_path):
    """Changes in several runs and out of order: late ones change nothing, and what was deleted stays so until it comes anew."""
    schema = "source_type string, object_type string, record_id string, change_type string, version string, plan string"
    runs = [[("a", "create", "01", "x"), ("b", "create", "01", "x"), ("a", "update", "03", "y")], [("a", "update", "02", "late"), ("b", "delete", "05", None)],
            [("b", "update", "04", "late"), ("c", "create", "01", "z"), (None, "create", "01", "n")], [("b", "create", "06", "w"), ("c", "update", "01", "tie")]]
    want = [{"a": ("03", "y", 1), "b": ("01", "x", 1)}, {"a": ("03", "y", 1)}, {"a": ("03", "y", 1), "c": ("01", "z", 1), None: ("01", "n", 1)},
            {"a": ("03", "y", 1), "b": ("06", "w", 3), "c": ("01", "z", 1), None: ("01", "n", 1)}]
    inbox, target, checkpoint = (str(tmp_path / n) for n in ("in", "out", "checkpoint"))
    for rows, expected in zip(runs, want):
        frame = spark.createDataFrame([("s", "customer", i, kind, v, plan) for i, kind, v, plan in rows], schema)
        frame.coalesce(1).write.mode("append").parquet(inbox)
        current.drain_changes(changes.read_stream(spark, inbox, frame.schema, "parquet"), target, checkpoint)
        found = {r["record_id"]: (r["version"], r["plan"], r["revision"]) for r in current.current_records(spark, target).collect()}
        assert found == expected


def test_events_since(spark):
    events = spark.createDataFrame([("a.created", datetime.datetime(2024, 1, 1), (("x", "1", None),)), ("a.updated", datetime.datetime(2024, 1, 2), (("x", "2", None),))], EVENT)
    found = billing.event_records(events, "acct", "2024-01-02").collect()
    assert [(r["record_id"], r["change_type"]) for r in found] == [("2", "update")]


def test_payload_forms(spark):
    kind = T.StructType([T.StructField("id", T.StringType()), T.StructField("mrr", T.DoubleType())])
    texts = ['[{"id":"a","mrr":1}]', '{"records":[{"id":"b","data":{"mrr":2}},{"id":"c"}]}', "{}", "[]"]
    rows = spark.createDataFrame([(t,) for t in texts], "payload string")
    found = {r["id"]: r["mrr"] for r in envelope.unwrap_payload(rows, "payload", kind).collect()}
    assert found == {"a": 1.0, "b": 2.0, "c": None}


def test_unite_and_json(spark):
    a = envelope.wrap(spark.createDataFrame([("1", "x")], "id string, name string"), "stripe", "s", "customer")
    b = envelope.wrap(spark.createDataFrame([("2", 5)], "id string, seats int"), "postgres", "p", "accounts")
    rows = {r["record_id"]: r["data"] for r in envelope.unite(a, b).collect()}
    assert {k: d.asDict() for k, d in rows.items()} == {"1": {"id": "1", "name": "x", "seats": None}, "2": {"id": "2", "name": None, "seats": 5}}
    maps = {r["record_id"]: r["data"] for r in envelope.unite(envelope.as_map(a), b).collect()}
    assert maps == {"1": {"id": "1", "name": "x"}, "2": {"id": "2", "seats": "5"}}
    c = envelope.wrap(spark.createDataFrame([("3", 1.5, ["t"])], "id string, seats double, name array<string>"), "csv", "c", "rows")
    mixed = {r["record_id"]: r["data"].asDict() for r in envelope.unite(a, b, c).collect()}
    assert mixed["2"]["seats"] == 5.0 and mixed["3"] == {"id": "3", "name": '["t"]', "seats": 1.5}
    assert json.loads(envelope.to_json(a.select("record_id", "data")).first()[0]) == {"record_id": "1", "data": {"id": "1", "name": "x"}}


def test_analysis_of_a_csv(spark, csv_file):
    records = tabular.csv_records(spark, csv_file, "demo")
    history = spark.createDataFrame(
        [("mrr", datetime.date(2024, 1, d), 100.0 + d % 3) for d in range(1, 20)], "metric_id string, period_date date, value double")
    result = analyse(records, "2024-03-05", history, use_forest=False)
    found = {r["metric_id"]: r for r in result.metrics.collect()}
    assert found["mrr"]["value"] == 1499.5 and found["active_customers"]["value"] == 3.0
    assert found["arpu"]["value"] == pytest.approx(1499.5 / 3)
    assert {(r["metric_id"], r["detection_method"]) for r in result.anomalies.collect()} == {("mrr", "z_score"), ("mrr", "rate_of_change")}
    assert result.resolution.counters().first()["entity_count"] == 4
