import itertools
import random

import pytest
from pyspark.sql import functions as F

from recurva.functions.normalize import COMPANY_ENDINGS
from recurva.functions.similarity import weighted_ratio
from recurva.operators import blocking, clustering, golden, matching
from recurva.operators.ranking import ranked
from recurva.plans.resolve import resolve_entities
from recurva.session import checkpointed
from recurva.sources.envelope import as_map

KIND = "source_type string, record_id string, data struct<email:string,company_name:string,phone:string,created_at:string,mrr:string>"


def records(spark, rows):
    return spark.createDataFrame(rows, KIND)


def noisy(seed, n=60):
    """Records whose names, dates and amounts are alike in many ways; some are copies."""
    rng = random.Random(seed)
    names = ["Acme Corp", "Acme Corporation", "acme corp", "Acme", "ACME Widgets Inc", "Widgets Acme", "Globex", "Globexx", "Initech LLC",
             "Initech Systems LLC", "a", "ab", "axb", "Umbrella Holding International Group", "Umbrella", None, ""]
    rows = []
    for i in range(n):
        source = rng.choice(["stripe", "postgres", "csv"])
        email = rng.choice([f"u{rng.randrange(4)}@d{rng.randrange(3)}.com", "someone", None, ""])
        day = f"2024-01-{rng.randrange(1, 8):02d}" + rng.choice(["", "", "T12:30:00"])
        data = (email, rng.choice(names), rng.choice([None, "555-123-4567"]), rng.choice([day, day, None]), rng.choice(["100", "104", "109", "0", "x", None]))
        rows += [(source, f"{i}", data)] + ([(source, f"{i}-copy", data)] if i % 9 == 0 else [])
    return rows


def brute_force(rows, threshold):
    """All matching pairs by comparing every pair of records of different sources."""
    import datetime

    def domain(email):
        parts = (email or "").strip().lower().split("@")
        return parts[1] if len(parts) > 1 else None

    def score(a, b):
        ea, eb = (a[0] or "").strip().lower(), (b[0] or "").strip().lower()
        email = 0.0 if not ea or not eb else 1.0 if ea == eb else 0.8 if domain(ea) and domain(ea) == domain(eb) else 0.0
        ratio = weighted_ratio((a[1] or "").lower(), (b[1] or "").lower()) / 100
        name = 0.0 if not a[1] or not b[1] else 1.0 if ratio >= 0.95 else ratio if ratio >= 0.8 else 0.0
        temporal = 0.0
        if a[3] and b[3]:
            days = abs((datetime.datetime.fromisoformat(a[3]) - datetime.datetime.fromisoformat(b[3])).days)
            temporal = 1 - days / 4 if days <= 3 else 0.0
        amount = 0.0
        try:
            x, y = float(a[4] or "nan"), float(b[4] or "nan")
            if x == 0 and y == 0:
                amount = 0.5
            elif x == x and y == y:
                share = abs(x - y) / max(abs(x), abs(y))
                amount = 1.0 if share <= 0.05 else 0.7 if share <= 0.1 else 0.0
        except ValueError:
            pass
        return round(0.35 * email + 0.25 * name + 0.1 * temporal + 0.1 * amount, 4)

    def keys(data):
        name = (data[1] or "").strip().lower()
        for ending in COMPANY_ENDINGS:
            name = name.removesuffix(ending)
        name = " ".join("".join(c for c in name if c.isascii() and (c.isalnum() or c.isspace())).split())
        return {("d", domain(data[0])) if domain(data[0]) else None, ("n", name) if len(name) >= 2 else None,
                ("p", data[2]) if data[2] else None} - {None}

    found = {}
    for (sa, ia, a), (sb, ib, b) in itertools.product(rows, rows):
        if sa < sb and keys(a) & keys(b) and score(a, b) >= threshold:
            found[f"{sa}:{ia}", f"{sb}:{ib}"] = score(a, b)
    return found


def expanded(spark, frame, pairs):
    """Pairs of nodes as pairs of records."""
    profiles = matching.record_profiles(frame).select("source_type", "record_id", "profile")
    nodes = matching.match_nodes(matching.record_profiles(frame)).select("node", "source_type", "profile")
    own = nodes.join(profiles, ["source_type", "profile"]).select("node", F.concat_ws(":", "source_type", "record_id").alias("record"))
    a, b = (own.select(F.col("node").alias(f"{s}_node"), F.col("record").alias(s)) for s in "ab")
    return {(r["a"], r["b"]): r["total_score"] for r in pairs.join(a, "a_node").join(b, "b_node").collect()}


@pytest.mark.parametrize("threshold, tile_rows", [(0.5, 4096), (0.5, 3), (0.4938, 4096), (0.45, 4096), (0.3, 5)])
def test_matches_equal_brute_force(spark, threshold, tile_rows):
    rows = noisy(int(threshold * 100))
    frame = records(spark, rows)
    pairs = matching.match_records(frame, threshold, tile_rows=tile_rows)
    assert expanded(spark, frame, pairs) == brute_force(rows, threshold)


def test_name_filter_never_drops_a_similar_pair(spark):
    rng = random.Random(5)
    letters = "abcde "
    names = {"".join(rng.choice(letters) for _ in range(rng.randrange(1, 16))).strip() for _ in range(220)} - {""}
    names |= {n + rng.choice("abc") for n in list(names)[:60]} | {" ".join(reversed(n.split())) for n in list(names)[:40]}
    rows = [(s, f"{i}", ("x@hot.com", n, None, None, None)) for i, n in enumerate(sorted(names)) for s in ("csv", "stripe")]
    nodes = checkpointed(matching.match_nodes(matching.record_profiles(records(spark, rows))))
    found = {(r["a_name"], r["b_name"]) for r in matching.similar_names(nodes, tile_rows=50).collect()}
    lowered = {n.lower() for n in names}
    assert found == {(a, b) for a, b in itertools.permutations(lowered, 2) if weighted_ratio(a, b) >= 80}


def test_block_sizes_and_counts_equal_listing(spark):
    rows = noisy(8, 80)
    frame = records(spark, rows)
    index = [(r["source_type"], r["record_id"], r["strategy"], r["key"]) for r in blocking.block_keys(frame).collect()]
    listed, blocks = {}, {}
    for a, b in itertools.product(index, index):
        if a[0] < b[0] and a[2:] == b[2:]:
            listed.setdefault((a[0], b[0]), set()).add((a[1], b[1]))
            blocks[a[2:]] = blocks.get(a[2:], 0) + 1
    counted = {(r["source_a"], r["source_b"]): r["candidate_pairs"] for r in blocking.candidate_counts(frame).collect()}
    assert counted == {k: len(v) for k, v in listed.items()}
    sizes = {(r["strategy"], r["key"]): r["pairs"] for r in blocking.block_sizes(blocking.block_keys(frame)).collect()}
    assert {k: v for k, v in sizes.items() if v} == blocks


def test_candidates_with_many_shared_keys(spark):
    """Records that share twenty keys, all with one record, one each with many, and in random parts, counted by brute force."""
    rng = random.Random(9)
    fields = [f"f{i}" for i in range(20)]
    tags = (blocking.Strategy("tag", tuple(fields), lambda value: value),)
    keys = [f"k{i:02d}" for i in range(20)]
    rows = [("a", "same", keys), ("b", "same", keys), ("c", "same", keys), ("b", "half", keys[:10]), ("c", "rest", keys[7:])]
    rows += [("b", f"one{i}", [k]) for i, k in enumerate(keys)] + [("c", "own", [f"x{i}" for i in range(20)])]
    rows += [(rng.choice("abc"), f"part{i}", rng.sample(keys, rng.randint(1, 3))) for i in range(40)]
    frame = spark.createDataFrame([(s, i, tuple(k + [None] * (20 - len(k)))) for s, i, k in rows],
                                  f"source_type string, record_id string, data struct<{','.join(f'{f}:string' for f in fields)}>")
    scattered = frame.where("record_id = 'own' OR record_id LIKE 'one%' OR (record_id = 'same' AND source_type = 'a')")
    whole = frame.where("record_id IN ('same', 'own')")
    parts = frame.where("record_id NOT IN ('same', 'rest')")

    def counted(sample, at_once):
        return {(r["source_a"], r["source_b"]): r["candidate_pairs"] for r in blocking.candidate_counts(sample, tags, at_once).collect()}

    held = {tuple(r) for r in parts.select("source_type", "record_id").collect()}
    want = {}
    for (s, _, k), (t, _, m) in itertools.combinations([r for r in rows if r[:2] in held], 2):
        if s != t and set(k) & set(m):
            want[min(s, t), max(s, t)] = want.get((min(s, t), max(s, t)), 0) + 1
    assert counted(parts, 8) == want and counted(scattered, 8) == {("a", "b"): 20}
    assert counted(whole, 8) == counted(whole, 1) == {("a", "b"): 1, ("a", "c"): 1, ("b", "c"): 1}


def test_blocks_of_small_cases(spark):
    def shared(a, b):
        frame = records(spark, [("stripe", "a1", (*a, None, None, None)), ("postgres", "b1", (*b, None, None, None))])
        return sum(r["candidate_pairs"] for r in blocking.candidate_counts(frame).collect())

    assert shared(("alex@acme.com", None), ("bob@acme.com", None)) == 1
    assert shared(("alex@acme.com", None), ("bob@other.com", None)) == 0
    assert shared((None, "Acme Corp"), (None, "Acme Corporation")) == 1
    assert shared(("alex@acme.com", "Acme Corp"), ("bob@acme.com", "Acme Inc")) == 1


def test_repeated_words_are_no_reason_to_compare(spark):
    """Names that repeat a word pass the same filters as others, and no similar pair is lost by them."""
    rng = random.Random(11)
    words = ["new", "york", "acme", "data", "systems", "b", "global", "north", "tele", "ünit"]
    names = {" ".join(rng.choices(words, k=rng.randint(1, 6))) for _ in range(250)}
    names |= {"".join(rng.choice([c, c, c, rng.choice("abn ")]) for c in name).strip() for name in list(names)[:120]}
    names |= {"duran duran", "duran", "duran duran duran", "new new york york", "york new", "b b b b", "b"}
    names = sorted(n for n in names if n)
    frame = matching._name_features(spark.createDataFrame([(n,) for n in names], "name string"))
    pairs = matching._side(frame, "a").join(matching._side(frame, "b"), F.col("a_name") < F.col("b_name"))
    passed = {(r["a_name"], r["b_name"]) for r in pairs.where(matching._may_be_similar()).select("a_name", "b_name").collect()}
    similar = {(a, b) for i, a in enumerate(names) for b in names[i + 1:] if weighted_ratio(a, b) >= 80.0}
    assert len(similar) > 100 and not similar - passed
    repeats = [f"{a} {a}" for a in ("".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=8)) for _ in range(150))]
    frame = matching._name_features(spark.createDataFrame([(n,) for n in repeats], "name string"))
    pairs = matching._side(frame, "a").join(matching._side(frame, "b"), F.col("a_name") < F.col("b_name"))
    assert pairs.where(matching._may_be_similar()).count() < 0.01 * pairs.count()


def test_names_that_are_not_compared_are_not_similar(spark):
    """The condition ahead of the comparison holds for all similar names, and for few others where a word is common to all."""
    rng = random.Random(12)
    words = ["acme", "global", "north", "systems", "inc", "group", "of", "ab", "holding", "water", "works", "solutions"]

    def changed(name):
        for _ in range(rng.randint(0, 3)):
            at = rng.randrange(len(name) + 1)
            name = rng.choice([name[:at] + rng.choice("aeio ") + name[at:], name[:at] + name[at + 1:], " ".join(rng.sample(name.split(), len(name.split()))),
                               f"{name} {rng.choice(words)}", " ".join(name.split()[1:]) or name])
        return name.strip() or "x"

    names = [" ".join(rng.choices(words, k=rng.randint(1, 4))) for _ in range(60)]
    names = sorted({changed(n) for n in names for _ in range(4)} | set(names))
    frame = matching._name_features(spark.createDataFrame([("x.com", n) for n in names], "link string, name string")).withColumn("first", F.lit("s"))
    frame = checkpointed(frame)
    pairs = matching._side(frame, "a", ("link",)).join(matching._side(frame, "b", ("link",)), "link").where("a_name < b_name")
    passed = {(r["a_name"], r["b_name"]) for r in pairs.where(matching._may_be_similar()).select("a_name", "b_name").collect()}
    similar = {(a, b) for a, b in itertools.combinations(names, 2) if weighted_ratio(a, b) >= 80 - 1e-9}
    assert len(similar) > 500 and similar <= passed

    common = [f"{''.join(rng.choices('bcdfghjklmnpqrstvwxyz', k=9))} {''.join(rng.choices('bcdfghjklmnpqrstvwxyz', k=9))} inc" for _ in range(300)]
    frame = checkpointed(matching._name_features(spark.createDataFrame([("x.com", n) for n in common], "link string, name string")))
    pairs = matching._side(frame, "a", ("link",)).join(matching._side(frame, "b", ("link",)), "link").where("a_name < b_name")
    assert pairs.where(matching._may_be_similar()).count() < 0.01 * pairs.count()


def test_profiles_are_dealt_to_all_tasks(spark):
    """Records that come in one partition are profiled in as many tasks as a shuffle has."""
    rows = records(spark, [("stripe", f"s{i}", (f"a{i}@d{i}.com", f"Name {i} Inc", None, None, "5")) for i in range(90)]).coalesce(1)
    sizes = matching.record_profiles(rows).groupBy(F.spark_partition_id().alias("part")).count().collect()
    assert len(sizes) == int(spark.conf.get("spark.sql.shuffle.partitions")) and max(r["count"] for r in sizes) < 60


def test_only_links_with_several_names_and_sources_are_compared(spark, monkeypatch):
    seen = []
    features = matching._name_features
    monkeypatch.setattr(matching, "_name_features", lambda names: seen.append(names) or features(names))
    rows = [("stripe", "a", ("a@one.com", "Acme", None, None, None)), ("csv", "b", ("b@one.com", "acme", None, None, None)),
            ("csv", "c", ("c@two.com", "Globex", None, None, None)), ("csv", "d", ("d@two.com", "Globexx", None, None, None)),
            ("stripe", "e", ("e@three.com", "Initech", None, None, None)), ("csv", "f", ("f@three.com", "Initechs", None, None, None)),
            ("csv", "g", ("g@three.com", None, None, None, None))]
    found = matching.similar_names(matching.match_nodes(matching.record_profiles(records(spark, rows)))).collect()
    assert {(r["a_name"], r["b_name"]) for r in found} == {("initech", "initechs"), ("initechs", "initech")}
    assert {r["link"] for r in seen[0].select("link").collect()} == {"three.com"}


def test_only_profiles_with_copies_are_collapsed(spark, monkeypatch):
    """Few copies are listed and only their rows aggregated; many send all rows through the aggregate. Both give the same nodes."""
    seen = []
    collapsed = matching._collapsed
    monkeypatch.setattr(matching, "_collapsed", lambda rows: seen.append(rows) or collapsed(rows))
    rows = noisy(5) + [("stripe", "z", (None,) * 5), ("csv", "z", (None,) * 5), ("csv", "y", (None,) * 5)]
    profiles = checkpointed(matching.record_profiles(records(spark, rows)))
    listed, whole = matching.match_nodes(profiles), matching.match_nodes(profiles, listed_copies=0)
    groups = profiles.groupBy("source_type", "profile").count().collect()
    assert sorted(r["count"] for r in groups if r["count"] > 1) and any(r["count"] == 1 for r in groups)
    assert [part.count() for part in seen] == [sum(r["count"] for r in groups if r["count"] > 1), len(rows)]
    assert set(listed.columns) == set(whole.columns) and len(listed.collect()) == len(groups)
    assert sorted(map(repr, listed.collect())) == sorted(map(repr, whole.select(*listed.columns).collect()))


def test_bitmaps_are_left_out_where_few_names_meet(spark):
    names = spark.createDataFrame([("acme acme corp", 2), ("acme acme corp", 99), ("zeta acme", 99)], "name string, crowd long")
    few, many, turned = matching._name_features(names).collect()
    bitmaps = [c for c in few.asDict() if c.endswith(("_0", "_64"))]
    assert len(bitmaps) == 8 and {few[c] for c in bitmaps} == {-1} and -1 not in {many[c] for c in bitmaps}
    assert all(few[c] == many[c] for c in few.asDict() if c not in bitmaps)
    assert few["ordered_grams"] == few["grams"] and sorted(few["grams"])[:6] == [" a", " c", "ac", "ac1", "cm", "cm1"]
    assert set(few["once_grams"]) == {" c", "ac", "cm", "co", "e ", "me", "or", "rp"}
    assert set(turned["ordered_grams"]) == {" z", "ac", "cm", "e ", "et", "me", "ta", "ze"} != set(turned["grams"])


def test_addresses_of_one_source_or_name_are_left_out(spark):
    rows = [("stripe", "1", "one", "acme"), ("csv", "1", "one", "acme"), ("stripe", "2", "two", "acme"), ("stripe", "3", "two", "globex"),
            ("stripe", "4", "three", "acme"), ("csv", "4", "three", "globex"), ("stripe", "5", "four", None), ("csv", "5", "four", None),
            ("stripe", "6", "five", "acme"), ("csv", "6", "five", None), ("csv", "7", "six", None)]
    nodes = spark.createDataFrame(rows, "source_rank string, record_id string, email string, name string")
    assert {r["email"] for r in matching._mixed_addresses(nodes).collect()} == {"three", "four", "five"}


def test_keys_are_normalised_once(spark):
    """Short and missing keys are left out, equal ones kept once."""
    rows = spark.createDataFrame([("s", "1", ("Acme Inc", "acme", "x", None)), ("s", "2", (None, "", "12", "555 1234567"))],
                                 "source_type string, record_id string, data struct<name:string,company:string,phone:string,tel:string>")
    got = {r["record_id"]: r["keys"] for r in rows.select("record_id", blocking.key_array(rows).alias("keys")).collect()}
    assert got == {"1": ["company_name:acme"], "2": ["phone:1234567"]}


def test_given_pairs(spark):
    frame = records(spark, [("stripe", "a", ("alex@acme.com", "Acme Corp", None, None, "500")), ("postgres", "b", ("alex@acme.com", "Acme Corp", None, None, "500")),
                            ("postgres", "c", ("bob@other.com", "Totally Different", None, None, None))])
    given = spark.createDataFrame([("stripe", "a", "postgres", "b"), ("stripe", "a", "postgres", "c"), ("stripe", "a", "postgres", "zzz")],
                                  "a_source string, a_id string, b_source string, b_id string")
    found = {r["b_record_id"]: r for r in matching.score_pairs(given, frame).collect()}
    assert found["b"]["total_score"] == 0.7 and found["c"]["total_score"] < 0.3 and "zzz" not in found
    assert found["b"]["evidence"] == ["email_exact: alex@acme.com <> alex@acme.com", "name_exact: Acme Corp <> Acme Corp", "amount_exact"]


def union_find(edges):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        ra, rb = find(a), find(b)
        parent[max(ra, rb)] = min(ra, rb)
    return {x: find(x) for x in list(parent)}


@pytest.mark.parametrize("shape", ["random", "chain", "star", "hubs", "empty"])
def test_components(spark, shape):
    rng = random.Random(4)
    edges = {"random": [(f"n{rng.randrange(300):03d}", f"n{rng.randrange(300):03d}") for _ in range(220)],
             "chain": [(f"n{i:03d}", f"n{i + 1:03d}") for i in range(200)], "star": [("hub", f"n{i:03d}") for i in range(300)], "hubs": [(f"h{i % 3}", f"n{i:03d}") for i in range(300)] + [("h0", "n001")], "empty": []}[shape]
    edges = [(a, b) for a, b in edges if a != b]
    frame = spark.createDataFrame(edges, "a string, b string").repartition(5)
    for heavy in (4096, 20):
        found = {r["node"]: r["cluster_id"] for r in clustering.connected_components(frame, "a", "b", heavy_edges=heavy).collect()}
        assert found == union_find(edges)


def test_edges_of_a_hub_stay_where_they_are(spark):
    """A node with most of the edges is joined by a broadcast; what is shuffled are the edges of the others."""
    edges = spark.range(30_000).select(F.col("id").alias("u"), F.lit(-1).cast("long").alias("v"))
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    met, low = clustering._with_smallest(both, 60_000, 4096)
    assert met.count() == 60_000 and low.count() == 30_001
    assert met.where("u = -1 AND smallest = 0").count() == 30_000 and met.where("u <> -1 AND smallest = -1").count() == 30_000


@pytest.mark.parametrize("threshold, tile_rows", [(0.5, 3), (0.52, 4096), (0.5638, 4096), (0.4, 4096)])
def test_clusters_equal_components_of_all_matches(spark, threshold, tile_rows):
    rows = noisy(int(threshold * 1000), 90)
    result = resolve_entities(records(spark, rows), threshold, tile_rows=tile_rows)
    matches = brute_force(rows, threshold)
    clusters = union_find(matches)
    found = {f"{r['source_type']}:{r['record_id']}": r["entity_id"] for r in result.lineage.collect()}
    assert {k: found[k] for k in clusters} == clusters
    assert all(found[k] == k for k in found if k not in clusters)
    expected = {}
    for (a, _), score in matches.items():
        expected.setdefault(clusters[a], []).append(score)
    confidence = {r["cluster_id"]: (r["max_confidence"], round(r["avg_confidence"], 9), r["pairs"]) for r in result.clusters.collect()}
    assert confidence == {k: (max(v), round(sum(v) / len(v), 9), len(v)) for k, v in expected.items()}


def test_resolution_does_not_depend_on_partitions(spark):
    rows = noisy(21, 80)
    results = []
    for parts in (1, 7):
        result = resolve_entities(records(spark, rows).repartition(parts))
        results.append((sorted(map(str, result.entities.collect())), sorted(map(str, result.lineage.collect()))))
    assert results[0] == results[1]
    assert len(results[0][1]) == len(rows)


def test_confidence_counts_copies(spark):
    same = ("a@x.com", "Acme", None, None, None)
    rows = [("csv", "1", same), ("csv", "2", same), ("stripe", "3", same), ("stripe", "4", ("b@x.com", "Acme", None, None, None))]
    result = resolve_entities(records(spark, rows))
    row = result.clusters.first()
    assert row["pairs"] == 4 and row["max_confidence"] == 0.6
    assert row["avg_confidence"] == pytest.approx((0.6 * 2 + 0.53 * 2) / 4)
    entity = result.entities.first()
    assert entity["_source_count"] == 4 and entity["entity_id"] == "csv:1"


def test_golden_priorities(spark):
    rows = [("csv", "1", ("c@x.com", "Csv Name", None, "2024-01-03", "1")), ("hubspot", "2", ("h@x.com", "Hub Name", "1", "2024-01-02", "2")),
            ("stripe", "3", (None, "Stripe Name", None, None, None)), ("postgres", "4", ("p@x.com", None, "2", "2024-01-01", "4"))]
    frame = records(spark, rows)
    members = frame.select(F.lit("k").alias("cluster_id"), "source_type", "record_id")
    confidence = spark.createDataFrame([("k", 0.9, 0.8, 3)], "cluster_id string, max_confidence double, avg_confidence double, pairs int")
    row = golden.golden_records(members, frame, confidence).first()
    assert (row["email"], row["company_name"], row["phone"], row["created_at"], row["mrr"]) == ("h@x.com", "Hub Name", "2", "2024-01-01", "4")
    assert (row["_source_count"], row["_confidence"]) == (4, 0.8)
    as_fields = {r["field"]: r["value"] for r in golden.golden_maps(members, as_map(frame)).collect()}
    assert as_fields == {f: row[f] for f in ("email", "company_name", "phone", "created_at", "mrr")}


def test_latest_record_wins(spark):
    import datetime

    rows = [("s", "1", "old", datetime.datetime(2024, 1, 1), "z"), ("s", "1", "new", datetime.datetime(2024, 1, 2), "a"), (None, "1", "other", None, "b")]
    frame = spark.createDataFrame(rows, "source_type string, record_id string, v string, extracted_at timestamp, record_hash string")
    assert {(r["source_type"], r["v"]) for r in blocking.latest_records(frame).collect()} == {("s", "new"), ("unknown", "other")}


def test_source_order_decides_side_a(spark):
    rows = [("stripe", "1", ("a@x.com", "Acme", None, "2024-01-01T00:00:00", None)), ("csv", "2", ("a@x.com", "Acme", None, "2024-01-01T12:00:00", None))]
    by_name = matching.match_records(records(spark, rows)).first()
    given = matching.match_records(records(spark, rows), source_order=["stripe", "csv"]).first()
    assert (by_name["a_source_type"], by_name["temporal_score"]) == ("csv", 1.0)
    assert (given["a_source_type"], given["temporal_score"]) == ("stripe", 0.75)


def test_bounded_lineage(spark):
    large = spark.range(2500).select(F.lit("e").alias("entity_id"), F.lit("s").alias("source_type"), F.col("id").cast("string").alias("record_id"))
    lines = large.unionByName(spark.range(3).select(F.lit("f"), F.lit("s"), F.col("id").cast("string")).toDF(*large.columns))
    found = golden.bounded_lineage(lines, 400).collect()
    assert sorted((r["entity_id"], r["part"], len(r["_sources"])) for r in found) == [*(("e", i, 400) for i in range(6)), ("e", 6, 100), ("f", 0, 3)]
    assert sorted((r["entity_id"], *s) for r in found for s in r["_sources"]) == sorted(map(tuple, lines.collect()))
    assert golden.bounded_lineage(lines.limit(0)).count() == 0


def test_only_given_strategies_make_candidates(spark):
    rows = [("stripe", "1", ("a@x.com", "Acme", "5550001111", "2024-01-01", "5")), ("csv", "2", ("a@x.com", "Acme", "5550002222", "2024-01-01", "5")),
            ("csv", "3", ("b@x.com", "Acme", "555 000 1111", "2024-01-01", "5"))]
    frame = records(spark, rows)
    by_phone = (blocking.STRATEGIES[2],)
    assert {(r["a_record_id"], r["b_record_id"]) for r in matching.match_records(frame, strategies=by_phone).collect()} == {("3", "1")}
    assert matching.match_records(frame).count() == 2
    resolved = resolve_entities(frame, strategies=by_phone)
    assert {(r["entity_id"], r["record_id"]) for r in resolved.lineage.collect()} == {("csv:2", "2"), ("csv:3", "1"), ("csv:3", "3")}


def test_map_records_match_like_structs(spark):
    rows = noisy(31, 40)
    frame = records(spark, rows)
    structs = expanded(spark, frame, matching.match_records(frame))
    maps = expanded(spark, as_map(frame), matching.match_records(as_map(frame)))
    assert structs == maps


def test_ranked(spark):
    rng = random.Random(1)
    rows = [(rng.choice(["a", "b", None]), rng.choice([None, *range(20)]), i) for i in range(500)] + [("b", 5, 999)] * 300
    got = ranked(spark.createDataFrame(rows, "g string, v int, n int").repartition(7), ["g"], ["v"]).collect()
    for group in ("a", "b", None):
        held = sorted((r for r in got if r["g"] == group), key=lambda r: r["rank"])
        values = [r["v"] for r in held]
        assert values == sorted(values, key=lambda v: (v is not None, v or 0))
        assert [r["rank"] for r in held] == list(range(len(held))) and {r["members"] for r in held} == {len(held)}
    assert ranked(spark.createDataFrame([], "g string, v int"), ["g"], ["v"]).count() == 0
