import hashlib
from collections import Counter

from pyspark.sql import functions as F

from lumenframe.llm import fingerprints as fp


def shingles(text):
    w = [x for x in (text or "").split() if x]
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def test_query_against_brute_force(spark, docs):
    some = docs.where("doc_id IS NOT NULL").dropDuplicates(["doc_id"])
    got = {r.doc_id: r for r in fp.op1_query(some).collect()}
    rows = sorted(((r.doc_id, r.text or "") for r in some.collect()))
    assert sorted(got) == [d for d, _ in rows]
    for i, (doc, text) in enumerate(rows):
        after = rows[(i + 1) % len(rows)][1]
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        assert got[doc].n_chars == len(text)
        assert got[doc].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        for near, other in ((got[doc].near_edited, edited), (got[doc].near_next, after)):
            a, b = shingles(text), shingles(other)
            true = len(a & b) / len(a | b) if a | b else 1.0
            assert abs(near - true) < (0.15 if len(a | b) > fp.SIZE else 1e-9), (doc, near, true)
    assert got[4].fingerprint == got[5].fingerprint
    assert got[1].fingerprint == ""


def test_many_chunks(spark, monkeypatch):
    rows = [(i * 3, f"text number {i} of the many that there are") for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert len(chunk_sizes(df, 16)) > 10
    monkeypatch.setattr(fp.in_chunks, "__defaults__", (16,))
    got = {r.doc_id: r.edited_sha256 for r in fp.op1_query(df).collect()}
    for i, (doc, text) in enumerate(rows):
        half, after = len(text) // 2, rows[(i + 1) % 300][1]
        assert got[doc] == hashlib.sha256((text[: len(text) - half] + after[:half]).encode()).hexdigest()


def chunk_sizes(df, rows):
    return sorted(r["count"] for r in fp.in_chunks(df, rows).groupBy("chunk").count().collect())


def test_chunks_are_even_however_ids_are_spread(spark):
    rows = [(i, f"text {i}") for i in range(5000)] + [(10**17, "far")]
    assert max(chunk_sizes(spark.createDataFrame(rows, "doc_id bigint, text string"), 100)) < 400
    same = [(None, None)] * 3000 + [(7, "copy")] * 3000
    assert max(chunk_sizes(spark.createDataFrame(same, "doc_id bigint, text string"), 100)) < 400


def test_chunks_follow_the_order(spark):
    rows = [(i * (-1) ** i * 10**15 // (1 + i % 7), f"text {i}") for i in range(2000)] + [(None, "n"), (None, None)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    at = {}
    for r in fp.in_chunks(df, 50).collect():
        at.setdefault(r.chunk, []).append(-(1 << 63) if r.doc_id is None else r.doc_id)
    ranges = [(min(v), max(v)) for _, v in sorted(at.items())]
    assert len(ranges) > 20 and all(a[1] <= b[0] for a, b in zip(ranges, ranges[1:], strict=False))


def test_repeated_rows_are_neighbours_of_each_other(spark):
    rows = [(1, "a b")] * 40 + [(2, "c d e f g")] * 40
    got = fp.op1_query(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    told = Counter((r.doc_id, r.edited_sha256) for r in got)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    assert told == {(1, sha("a a")): 39, (1, sha("a c")): 1, (2, sha("c d e" + "c d ")): 39, (2, sha("c d e" + "a b")): 1}


def test_awkward_rows_and_empty_table(docs, empty):
    assert fp.op1_query(docs).count() == docs.count()
    assert fp.op1_query(empty).collect() == []


def test_merge_is_the_sketch_of_the_whole(spark):
    texts = [" ".join(f"t{(i * 37 + j * j) % 5000}" for j in range(400)) for i in range(6)]
    df = spark.createDataFrame([(i % 2, t) for i, t in enumerate(texts)], "g int, text string")
    sketches = fp.with_sketch(df, F.col("text"), "s", 64)
    merged = {r.g: r.s for r in fp.merge_parts(sketches, ["g"], "s", 64).collect()}
    bare = spark.createDataFrame([(1, []), (1, []), (2, [5]), (2, []), (None, None), (3, None)], "g int, s array<bigint>")
    assert {r.g: r.s for r in fp.merge_parts(bare, ["g"], "s", 64).collect()} == {1: [], 2: [5], None: [], 3: []}
    for g in (0, 1):
        parts = [r.s for r in sketches.where(f"g = {g}").collect()]
        assert merged[g] == sorted({h for p in parts for h in p})[:64]


def test_comparison_in_columns_is_that_of_the_expressions(spark):
    texts = ["", " ".join(f"v{i}" for i in range(900)), " ".join(f"v{i}" for i in range(300, 1500)), "a b c", " ".join(f"v{i}" for i in range(40))]
    df = spark.createDataFrame([(a, b) for a in texts for b in texts], "p string, q string")
    df = fp.with_sketch(fp.with_sketch(df, F.col("p"), "x"), F.col("q"), "y")
    rows = fp.with_comparison(df, "x", "y", "near", "share").select(
        "near", "share", fp.resemblance(F.col("x"), F.col("y")).alias("r"), fp.containment(F.col("x"), F.col("y")).alias("c")
    ).collect()
    assert len(rows) == 25 and all(r.near == r.r and r.share == r.c for r in rows)


def test_distinct_count_and_containment(spark):
    text = " ".join(f"u{i}" for i in range(3000))
    part = " ".join(f"u{i}" for i in range(1500))
    df = spark.createDataFrame([(text, part)], "a string, b string")
    df = fp.with_sketch(fp.with_sketch(df, F.col("a"), "x"), F.col("b"), "y")
    row = df.select(fp.distinct_shingles(F.col("x")).alias("n"), fp.containment(F.col("y"), F.col("x")).alias("c")).first()
    assert abs(row.n - 2996) < 900
    assert row.c > 0.75
