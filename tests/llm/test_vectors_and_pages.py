"""Vector searches, archives and the pipeline against brute force."""

import base64
import gzip
import hashlib
import math
import random

import numpy as np
import public_tokenizers
import pytest

import corpus_pipeline
from recurva.llm import ann, archives, bpe, embedding_dedup
from recurva.session import scratch_path

SCHEMA = "vec_id long, embedding array<float>, label int, node string, list int"


def usable(v):
    return v is not None and len(v) > 0 and all(x is not None and math.isfinite(x) for x in v) and any(v)


def cosine(a, b):
    a, b = np.array(a, np.float64), np.array(b, np.float64)
    return float((a * b).sum() / (np.sqrt((a * a).sum()) * np.sqrt((b * b).sum())))


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(4)
    rows = [(i, rng.standard_normal(16).astype(np.float32).tolist(), int(i % 3)) for i in range(400)]
    for i in range(400, 520):  # near copies of a few, a dense group among them
        centre = np.array(rows[i % 4 if i < 480 else 7][1])
        rows.append((i, (centre * rng.uniform(0.5, 3) + rng.standard_normal(16) * 0.05 * np.abs(centre).mean()).astype(np.float32).tolist(), rows[i % 4 if i < 480 else 7][2]))
    rows += [(520 + i, rows[9][1], rows[9][2]) for i in range(30)]  # copies
    rows += [(600, None, 1), (601, [], 1), (602, [0.0] * 16, 1), (603, [1.0, None] * 8, 1), (604, [float("nan")] * 16, 1), (605, [float("inf")] * 16, 1),
             (606, rows[9][1], None), (607, rows[9][1], 2 - rows[9][2]), (608, [3.0, 1.0], 1), (609, [3.0, 1.0], 1), (None, rows[9][1], rows[9][2]),
             (610, [1e30] * 16, 1), (611, [1e-30] * 16, 1), (50, rows[50][1], rows[50][2])]
    return rows, spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA)


@pytest.mark.parametrize("block_rows", [1024, 16])
def test_embedding_groups(spark, vectors, block_rows, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "BLOCK_ROWS", block_rows)
    rows, frame = vectors
    n, links, root = len(rows), [0] * len(rows), list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i
    for a in range(n):
        for b in range(a + 1, n):
            (_, u, p), (_, v, q) = rows[a], rows[b]
            if p is not None and p == q and usable(u) and usable(v) and len(u) == len(v) and cosine(u, v) >= 0.98:
                links[a] += 1
                links[b] += 1
                root[find(a)] = find(b)
    smallest = {}
    for a, (i, _, _) in enumerate(rows):
        if i is not None:
            smallest[find(a)] = min(i, smallest.get(find(a), i))
    want = [(i, links[a], smallest.get(find(a)), i is not None and i == smallest.get(find(a))) for a, (i, _, _) in enumerate(rows)]
    got = [tuple(r) for r in embedding_dedup.embedding_groups(frame).select("vec_id", "n_links", "component_id", "kept").collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_no_vectors(spark, vectors):
    empty = vectors[1].limit(0)
    assert embedding_dedup.embedding_groups(empty).count() == 0
    assert ann.nearest(empty, empty).count() == 0


def exact(rows, queries, k):
    best = {}
    for i, v in rows:
        if i is not None and usable(v):
            best[i] = min(best.get(i, v), v)
    found = {q: sorted(((-cosine(best[q], v), i) for i, v in best.items() if i != q and len(v) == len(best[q])))[:k] for q in queries if q in best}
    return {q: near for q, near in found.items() if near}


@pytest.mark.parametrize("share, least", [(1.0, 0.99), (None, 0.9)])
def test_nearest(spark, vectors, share, least, monkeypatch):
    monkeypatch.setattr(ann, "GROUP_ROWS", 100)
    monkeypatch.setattr(ann, "QUERY_ROWS", 8)
    rows, frame = vectors
    got = {}
    for r in ann.nearest(frame, frame.where("vec_id % 20 = 0"), probe_share=share).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    want = exact([r[:2] for r in rows], [i for i, _, _ in rows if i is not None and i % 20 == 0], 5)
    assert set(got) == set(want)
    hits = 0
    scores = {i: v for i, v, _ in rows if i is not None}
    for q, found in got.items():
        assert [r for r, _, _ in found] == list(range(1, len(want[q]) + 1))
        assert all(s == pytest.approx(cosine(scores[q], scores[i]), abs=1e-12) for _, i, s in found)
        assert [(-s, i) for _, i, s in found] == sorted((-s, i) for _, i, s in found)
        hits += len({i for _, i, _ in found} & {i for _, i in want[q]})
    assert hits >= least * sum(map(len, want.values()))
    ties = [i for _, i, _ in got[520]]
    assert ties == sorted(ties)  # copies have one score


def test_few_candidates(spark):
    frame = spark.createDataFrame([(0, [1.0, 0.0]), (50, [0.0, 2.0]), (7, [1.0, 1.0])], "vec_id long, embedding array<double>")
    got = [tuple(r) for r in ann.nearest(frame, frame.where("vec_id % 50 = 0")).orderBy("query_id", "rank").select("query_id", "rank", "vec_id").collect()]
    assert got == [(0, 1, 7), (0, 2, 50), (50, 1, 7), (50, 2, 0)]


def test_every_length_is_searched(spark):
    rng = random.Random(8)
    rows = [(i, [rng.gauss(0, 1) for _ in range(8 if i < 300 else 4)]) for i in range(400)] + [(450, [1.0, 2.0, 3.0])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {}
    for r in ann.nearest(frame, frame.where("vec_id % 50 = 0")).collect():
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    want = exact(rows, range(0, 451, 50), 5)
    assert set(got) == set(want) == {0, 50, 100, 150, 200, 250, 300, 350}
    assert sum(len(got[q] & {i for _, i in near}) for q, near in want.items()) >= 0.9 * 5 * len(want)


def test_probes_follow_the_structure():
    """Clustered vectors need few lists, vectors without any structure more than half."""
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(60, 32))
    unit = lambda x: x / np.sqrt((x * x).sum(axis=1, keepdims=True))
    for noise, low, high in ((0.05, 1, 12), (100.0, 60, 160)):
        sample = unit(centres[rng.integers(0, 60, 3000)] + noise * rng.normal(size=(3000, 32)))
        assert low <= ann.measured_probes(sample, ann.fit_centroids(sample, 160), 5, 0.97, 1) <= high


# archives

def digest(text):
    return base64.b32encode(hashlib.sha1((text or "").encode()).digest()).decode()


def test_files_are_cut_by_bytes(spark, monkeypatch):
    monkeypatch.setattr(archives, "ARCHIVE_BYTES", 4000)
    rows = [(i, "http://a", "x" * n) for i, n in enumerate([1, 1, 1, 3000, 3000, 3000, 9000, 1, 1, 1])]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1)
    arc, warc = scratch_path(spark, "arc"), scratch_path(spark, "warc")
    archives.write_arc(frame, arc)
    archives.convert_to_warc(spark, arc, warc)
    parts = lambda path: [gzip.decompress(bytes(r["content"])) for r in spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path).collect()]
    in_arc = [[len(archives.split_http(r.block)[1]) for r in archives.parse_arc(data)] for data in parts(arc)]
    assert sorted(in_arc) == sorted([[1, 1, 1, 3000], [3000], [3000], [9000], [1, 1, 1]])
    in_warc = [[f["warc-type"] for f, _ in archives.parse_warc(data)] for data in parts(warc)]
    assert all(kinds[0] == "warcinfo" and "warcinfo" not in kinds[1:] and len(kinds) > 1 for kinds in in_warc)
    assert all(len(data) < 6000 or len(list(archives.parse_warc(data))) == 2 for data in parts(warc))
    assert sum(len(kinds) - 1 for kinds in in_warc) == len(rows)


def test_archive_pages(spark, monkeypatch):
    monkeypatch.setattr(archives, "ARCHIVE_BYTES", 3000)  # several files of both versions
    tricky = "WARC/1.1\r\n\r\nfiledesc://x 0 0 text/plain 3\r\n\r\nhttp://a 0.0.0.0 20240101000000 text/html 9\n"
    rows = [(i, f"http://example.org/{i}", f"<p>{'x' * (i % 7)}</p>" if i % 3 else f"<p>page {i}</p>") for i in range(80)]
    rows += [(100, None, None), (101, "http://with blank/ä\n", ""), (102, "http://b", tricky), (103, "http://c", tricky), (104, "u", "long " * 40_000), (None, "http://n", "<p>page 0</p>"),
             (None, "http://n", "only without id"), (5, "http://example.org/5", rows[5][2])]
    frame = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, digest string").repartition(3)
    got = archives.archive_pages(frame).collect()
    assert len(got) == len(rows) and len({r["record_id"] for r in got}) == len(rows)
    firsts = {}
    for i, _, html in sorted(rows, key=lambda r: (r[0] is None, r[0])):
        firsts.setdefault(digest(html), i)
    sizes = {digest(html): len((html or "").encode()) for _, _, html in rows}
    for r in got:
        assert r["payload_bytes"] == sizes[r["payload_digest"]] and r["date"] == "2024-01-01T00:00:00Z"
        assert r["refers_to"] == (firsts[r["payload_digest"]] if r["record_type"] == "revisit" else None)
    assert sorted((r["page_id"] or -1, r["payload_digest"]) for r in got) == sorted((i or -1, digest(html)) for i, _, html in rows)
    responses = [r for r in got if r["record_type"] == "response"]
    assert sorted((r["payload_digest"], r["page_id"] or -1) for r in responses) == sorted((d, i or -1) for d, i in firsts.items())
    assert {r["url"] for r in got} >= {"about:blank", "http://with%20blank/ä%0A"}
    assert archives.archive_pages(frame.limit(0)).count() == 0


def test_small_payloads_stay(spark):
    frame = spark.createDataFrame([(1, "u", "ab"), (2, "u", "ab"), (3, "u", "abc"), (4, "u", "abc")], "page_id long, url string, html string")
    got = sorted((r["page_id"], r["record_type"], r["refers_to"]) for r in archives.archive_pages(frame, min_bytes=3).collect())
    assert got == [(1, "response", None), (2, "response", None), (3, "response", None), (4, "revisit", 3)]


def test_files_on_disk(spark):
    path, warc = scratch_path(spark, "arc"), scratch_path(spark, "warc")
    frame = spark.createDataFrame([(1, "http://a", "first"), (2, "http://b", "first")], "page_id long, url string, html string").coalesce(1)
    archives.write_arc(frame, path)
    archives.convert_to_warc(spark, path, warc)
    data = b"".join(gzip.decompress(bytes(r["content"])) for r in spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(warc).collect())
    records = list(archives.parse_warc(data))
    assert [f["warc-type"] for f, _ in records] == ["warcinfo", "response", "revisit"]
    response, revisit = records[1][0], records[2][0]
    assert revisit["warc-refers-to"] == response["warc-record-id"] and revisit["warc-refers-to-target-uri"] == "http://a"
    assert records[1][1].endswith(b"\r\n\r\nfirst") and records[2][1].endswith(b"\r\n\r\n") and revisit["warc-profile"] == archives.REVISIT_PROFILE
    assert data.endswith(b"\r\n\r\n") and all(f["warc-block-digest"] == "sha1:" + archives.sha1_base32(b) for f, b in records)


@pytest.mark.parametrize("version", [1, 2])
def test_arc_lines(version):
    blocks = [b"HTTP/1.0 200 OK\r\nA: b\r\n\r\n" + b"body\n\nhttp://fake 0.0.0.0 20000101 text/html 3\nabc", b"", b"no http"]
    data = archives.arc_description(version, "x.arc", "19970102") + b"\n"
    for block in blocks:
        data += archives.arc_line(version, "http://a b/c", "19970102030405", "text/html", block) + b"\n" + block + b"\n"
    found = list(archives.parse_arc(data))
    assert [r.block for r in found] == blocks and {r.url for r in found} == {"http://a b/c"} and all(r.whole for r in found)
    cut = list(archives.parse_arc(data[:-4]))
    assert cut[-1].block == b"no h" and not cut[-1].whole
    with pytest.raises(ValueError, match="no record line"):
        list(archives.parse_arc(data + b"\nrubbish line\n"))


def test_arc_without_description():
    with pytest.raises(ValueError, match="description"):
        list(archives.parse_arc(b"http://a 0.0.0.0 20000101 text/html 3\nabc\n"))


@pytest.mark.parametrize("written, meant", [("19970102030405", "1997-01-02T03:04:05Z"), ("199701020304", "1997-01-02T03:04:00Z"), ("19970102", "1997-01-02T00:00:00Z"), ("1997", "1997-01-01T00:00:00Z")])
def test_dates(written, meant):
    assert archives.warc_date(written) == meant


# the pipeline

def test_pipeline(spark, tmp_path):
    rng = random.Random(8)

    def prose(words=120):
        return " ".join("".join(rng.choices("abcdefghij", k=rng.randint(2, 6))) for _ in range(words)) + "."

    shared = "a passage that a good many of the documents hold word by word"
    rows = []
    for i in range(120):
        text = prose()
        if i % 4 == 0:
            text = " ".join(w + "***" for w in text.split())
        elif i % 4 == 1:
            text += "\n" + shared + f"\n{prose(30)}"
        rows.append((i, text, "en", f"src{i % 3}", len(text)))
    rows += [(200 + i, rows[2][1], "en", "src0", 1) for i in range(5)] + [(300, None, None, None, None)]
    folder = str(tmp_path)
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, int(i % 4 != 0), 0) for i in range(120)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")

    docs, seen = spark.read.parquet(f"{folder}/documents.parquet"), {}
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        path = scratch_path(spark, "stage")
        stage(spark, docs, folder).write.parquet(path)
        docs = spark.read.parquet(path)
        seen[name] = {r["doc_id"]: r for r in docs.collect()}
        assert docs.columns == columns or name == "byte-level BPE"
    good = {i for i, *_ in rows if i >= 200 or i % 4}
    assert good - {300} <= set(seen["quality classifier"]) <= good
    lines = seen["line dedup"]
    assert {i for i, r in lines.items() if shared in r["text"]} == {117} and all(r["n_chars"] == len(r["text"]) for r in lines.values())
    single = seen["SimHash near-dedup"]
    # of the copies the last keeps its lines, and the others, now empty, are one group
    assert lines[204]["text"] == rows[2][1] and {lines[i]["text"] for i in (2, 200, 201, 202, 203)} == {""}
    assert good - set(single) - {300} == {200, 201, 202, 203} and all(single[i]["text"] == lines[i]["text"] for i in single)
    mixed, last = seen["source mixing"], seen["byte-level BPE"]
    assert 0 < len(mixed) <= len(single) and set(last) == set(mixed)
    encoding = bpe.load_encoding(corpus_pipeline.public_tokenizers.path(corpus_pipeline.RANKS), corpus_pipeline.public_tokenizers.PATTERN)
    for i, r in last.items():
        ids = encoding.encode_ordinary(mixed[i]["text"])
        assert r["ids"] == ids and r["n_tokens"] == len(ids) and r["decoded_sha256"] == hashlib.sha256(mixed[i]["text"].encode()).hexdigest()
        assert r["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
    again = corpus_pipeline.run(spark, folder).select("doc_id", "ids_sha256").collect()
    assert {r["doc_id"]: r["ids_sha256"] for r in again} == {i: r["ids_sha256"] for i, r in last.items()}


CLASHING = ("score", "fp", "ids", "size", "block", "shard", "n_lines", "label", "held", "decoded", "n_tokens", "component_id", "words", "times")


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    """NULLs in every column, empty and very long texts, repeated rows, and columns named like those the operators use."""
    rng = random.Random(4)
    long = " ".join("".join(rng.choices("abcdefghij", k=5)) for _ in range(40_000)) + "\n" + "x" * 50_000
    texts = [None, "", " \n\t", "one", "É ü 漢字", long, "same text of two rows, word by word", "same text of two rows, word by word", "a line that is shared by three\nb", "a line that is shared by three",
             "A line that is shared by three\n\n"]
    rows = [(i, t, "en", f"s{i % 2}", 1) for i, t in enumerate(texts)] + [(6, texts[6], "en", "s0", 1)] * 2
    rows += [(None, "no id here", None, None, None), (None, None, None, None, None), (50, "no source", "en", None, None)]
    folder = str(tmp_path_factory.mktemp("odd"))
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in CLASHING)
    docs = spark.createDataFrame([(*r, *["kept"] * len(CLASHING)) for r in rows], schema)
    docs.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, None if i == 2 else 1, 0) for i in range(6)] + [(None, 1, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return spark.read.parquet(f"{folder}/documents.parquet"), folder


@pytest.mark.parametrize("place", range(5))
def test_stages_take_odd_rows(spark, odd, place):
    docs, folder = odd
    name, stage = corpus_pipeline.STAGES[place]
    out = stage(spark, docs, folder)
    empty = stage(spark, docs.limit(0), folder)
    assert empty.count() == 0 and set(empty.columns) == set(out.columns)
    rows = out.collect()
    if name == "byte-level BPE":
        assert len(rows) == docs.count() and all((r["n_tokens"] == 0) == (r["decoded_sha256"] == hashlib.sha256(b"").hexdigest()) for r in rows)
        return
    assert set(out.columns) == set(docs.columns) and all(r[c] == "kept" for r in rows for c in CLASHING)
    ids = [r["doc_id"] for r in rows]
    if name == "quality classifier":
        assert len(rows) == docs.count()  # with good examples only, all is kept
    elif name == "line dedup":
        assert len(rows) == docs.count() and sum("a line that is shared by three" in r["text"].lower() for r in rows) == 1
    elif name == "SimHash near-dedup":
        assert sorted(i for i in ids if i is not None) == [0, 3, 4, 5, 6, 6, 6, 8, 9, 50] and ids.count(None) == 1
    else:
        assert {5, 6, None, 50} <= set(ids) and not {0, 1, 2} & set(ids)


def test_tokens_of_odd_rows(spark, odd):
    docs, _ = odd
    ranks, pattern = bpe_files()
    coded = bpe.encode(docs, ranks, pattern, ids="label")
    both = bpe.decode(coded, ranks, pattern, ids="label", decoded="score")
    assert both.count() == docs.count() and set(both.columns) == set(docs.columns)
    assert all(bytes(r["score"]) == (r["text"] or "").encode() for r in both.collect())
    nothing = bpe.decode(spark.createDataFrame([(None, 1), (None, 1)], "ids array<int>, decoded int"), ranks, pattern).collect()
    assert [r["decoded"] for r in nothing] == [None, None]
    assert bpe.decode(coded.limit(0), ranks, pattern, ids="label").count() == 0


def bpe_files():
    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
