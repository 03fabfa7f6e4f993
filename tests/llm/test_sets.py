import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenframe.llm import mixing, sharding, simhash, topk_search
from lumenframe.llm.common import cut_lineage


def brute_groups(rows):
    """component of each (doc_id, fp) row by comparing all fingerprints."""
    fps = sorted({fp for _, fp in rows})
    root = {f: f for f in fps}

    def find(f):
        while root[f] != f:
            f = root[f]
        return f

    for i, a in enumerate(fps):
        for b in fps[i + 1 :]:
            if (a ^ b).bit_count() <= simhash.RADIUS:
                root[find(b)] = find(a)
    least: dict = {}
    for doc, fp in rows:
        if doc is not None:
            least[find(fp)] = min(least.get(find(fp), doc), doc)
    return Counter((doc, fp, least.get(find(fp))) for doc, fp in rows)


def plain_fingerprint(text):
    import xxhash

    w = [x.lower() if x.isascii() else x for x in (text or "").split()]
    parts = [" ".join(w[i : i + 4]) for i in range(max(1, len(w) - 3))] if w else []
    hashes = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0


def test_fingerprint():
    for text in (None, "", "  ", "One", "one two three four", "A b C d e f g h " * 7, "x " * 400):
        assert simhash.fingerprint(text) == plain_fingerprint(text)


@pytest.mark.parametrize("crowd", [1000, 1])
def test_groups_against_brute_force(spark, docs, crowd):
    got = simhash.grouped(docs, crowd).collect()
    want = brute_groups([(r.doc_id, simhash.fingerprint(r.text)) for r in docs.collect()])
    assert Counter((r.doc_id, r.fp & (1 << 64) - 1, r.component_id) for r in got) == want


@pytest.mark.parametrize("crowd", [10_000, 3])
def test_links_of_dense_fingerprints(spark, crowd):
    """Many fingerprints around few centres: components must be those of all pairs."""
    rng = np.random.default_rng(4)
    centres = rng.integers(0, 1 << 63, 6, dtype=np.uint64)
    fps = set()
    for c in centres.tolist():
        for _ in range(40):
            x = c
            for b in rng.integers(0, 64, rng.integers(0, 8)).tolist():
                x ^= 1 << b
            fps.add(x)
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    df = spark.createDataFrame([(f,) for f in signed], "fp bigint")
    pairs = simhash.links(df, crowd)
    found = {r.node: r.root for r in simhash.components(pairs).collect()}
    want = brute_groups([(i, f) for i, f in enumerate(sorted(fps))])
    by_root = {}
    for f in fps:
        s = f - (1 << 64) if f >> 63 else f
        by_root.setdefault(found.get(s, s), set()).add(f)
    ids = {f: i for i, f in enumerate(sorted(fps))}
    assert {(ids[f], f, min(ids[g] for g in group)) for group in by_root.values() for f in group} == set(want)
    for r in pairs.collect():
        assert ((r.a ^ r.b) & (1 << 64) - 1).bit_count() <= simhash.RADIUS


def test_components_of_a_long_path(spark):
    path = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(500, 501)], "a bigint, b bigint")
    found = {r.node: r.root for r in simhash.components(path).collect()}
    assert found == {**{i: 0 for i in range(1, 201)}, 501: 500}


def test_deduplicated(spark, docs, empty):
    kept = simhash.deduplicated(docs)
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.collect()]
    assert sorted(i for i in ids if i is not None) == [1, 3, 4, 8, 9, 10, 11]
    # One row of each group: the null text without an id is in the group of the empty text 1, the other such row in a group of its own.
    assert ids.count(None) == 1
    assert simhash.deduplicated(empty).collect() == []
    assert simhash.op4_query(empty).collect() == []


def test_deduplicated_with_an_id_on_several_texts(spark):
    """Groups {1: a, 2: a}, {1: b, 3: b}, {null: c, null: c} and {null: d, 9: d}: a row of each stays, the same whatever the order."""
    a, b, c, d = (" ".join(f"w{(s * 7919 + i * i * 31 + i) % 997}" for i in range(50)) for s in (21, 22, 23, 24))
    rows = [(1, a, "x"), (2, a, "x"), (1, b, "x"), (3, b, "x"), (None, c, "x"), (None, c, "y"), (None, d, "x"), (9, d, "x"), (9, d, None), (9, d, "z")] + [(2, a, "x")] * 5
    schema = "doc_id bigint, text string, __row string"
    first = sorted(simhash.deduplicated(spark.createDataFrame(rows, schema)).collect(), key=str)
    again = sorted(simhash.deduplicated(spark.createDataFrame(rows[::-1], schema).repartition(3)).collect(), key=str)
    assert first == again
    assert Counter((r.doc_id, r.text) for r in first) == Counter([(1, a), (1, b), (None, c), (9, d)])


def test_deduplicated_keeps_one_row_of_each_group(spark):
    rng = np.random.default_rng(11)
    texts = [" ".join(rng.choice(["p", "q", "r", "s"], rng.integers(0, 6))) for _ in range(150)]
    rows = [(int(rng.integers(0, 60)), t) for t in texts]
    kept = simhash.deduplicated(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    fps = sorted({simhash.fingerprint(t) for t in texts})
    group = {f: f for f in fps}
    for a in fps:
        for b in fps:
            if (a ^ b).bit_count() <= simhash.RADIUS and group[a] != group[b]:
                old, new = group[b], group[a]
                group = {f: new if g == old else g for f, g in group.items()}
    least = {}
    for i, t in rows:
        g = group[simhash.fingerprint(t)]
        least[g] = min(i, least.get(g, i))
    assert Counter((group[simhash.fingerprint(r.text)], r.doc_id) for r in kept) == Counter(least.items())


@pytest.mark.parametrize("crowd", [10_000, 3])
@pytest.mark.parametrize("count", [10, 10**6, 10**9])
def test_links_whatever_the_segments(spark, crowd, count):
    cuts = simhash.segments(count)
    assert sum(bits for _, bits, _ in cuts) == 64 and sum(r + 1 for *_, r in cuts) == simhash.RADIUS + 1
    rng = np.random.default_rng(5)
    fps = set()
    for c in rng.integers(0, 1 << 63, 4, dtype=np.uint64).tolist():
        fps |= {c ^ sum({1 << int(b) for b in rng.integers(0, 64, rng.integers(0, 7))}) for _ in range(25)}
    signed = [f - (1 << 64) if f >> 63 else f for f in sorted(fps)]
    df = spark.createDataFrame([(f,) for f in signed], "fp bigint")
    pairs = {(r.a, r.b) for r in simhash.links(df, crowd, cuts).collect()}
    near = {(a, b) for a in signed for b in signed if a > b and ((a ^ b) & (1 << 64) - 1).bit_count() <= simhash.RADIUS}
    assert pairs <= near
    if crowd > 1000:
        assert pairs == near
    found = {r.node: r.root for r in simhash.components(spark.createDataFrame(sorted(pairs), "a bigint, b bigint")).collect()}
    want = {r.node: r.root for r in simhash.components(spark.createDataFrame(sorted(near), "a bigint, b bigint")).collect()}
    assert found == want


def test_sharding_law_and_slots(spark, docs, empty):
    df = spark.range(3000).select(F.col("id").alias("doc_id"), F.concat(F.lit("té"), F.col("id")).alias("text"))
    rows = sharding.op5_query(df).collect()
    assert {r.law for r in rows} == {"key"} and {r.shard for r in rows} == set(range(24))
    for s in range(24):
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(sum(r.shard == s for r in rows)))
    assert all(r.grown_shard in (r.shard, 24) for r in rows)
    assert 60 < sum(r.grown_shard == 24 for r in rows) < 200
    assert all(r.size == len(f"té{r.doc_id}".encode()) + 8 and r.text_crc32 == zlib.crc32(f"té{r.doc_id}".encode()) for r in rows)
    same = sharding.op5_query(spark.createDataFrame([(None, "t")] * 500 + [(5, f"u{i}") for i in range(300)], "doc_id bigint, text string"))
    for r in same.groupBy("shard").agg(F.count("*").alias("n"), F.countDistinct("slot").alias("d"), F.max("slot").alias("m")).collect():
        assert r.n == r.d == r.m + 1
    odd = sharding.op5_query(docs).collect()
    assert len(odd) == docs.count()
    for s in {r.shard for r in odd}:
        assert sorted(r.slot for r in odd if r.shard == s) == list(range(sum(r.shard == s for r in odd)))
    assert sharding.op5_query(empty).collect() == []


def test_weights_decide_and_changes_stay_inside(spark):
    keys = spark.range(8000)
    tree = sharding.layout(24)
    heavy = [sharding.Shard(s.region, s.rack, s.shard, 3.0 if s.shard == 5 else 1.0) for s in tree]
    before, after = sharding.placed(F.col("id"), tree), sharding.placed(F.col("id"), heavy)
    rows = keys.select(before.alias("a"), after.alias("b")).collect()
    region, rack = {s.shard: s.region for s in tree}, {s.shard: s.rack for s in tree}
    moved = [(r.a, r.b) for r in rows if r.a != r.b]
    # Rows go only into the region whose weight grew, from inside it only into the rack that grew, from there only into the shard.
    assert moved and all(region[b] == region[5] for _, b in moved)
    assert all(rack[b] == rack[5] for a, b in moved if region[a] == region[5])
    assert all(b == 5 for a, b in moved if rack[a] == rack[5])
    share = sum(r.b == 5 for r in rows) / len(rows)
    assert abs(share - 3 / 26) < 0.02


def test_mixing_rates(spark, docs, empty):
    df = spark.range(6000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 6 == 0, "rare").otherwise("big").alias("source"))
    out = mixing.mixed(df, {"rare": 3.0, "big": 1.0})
    n = {r["s"]: r["n"] for r in out.groupBy(F.col("row.source").alias("s")).agg(F.count("*").alias("n")).collect()}
    assert abs(n["rare"] / 4500 - 1) < 0.1 and abs(n["big"] / 1500 - 1) < 0.1
    copies = [r.copies for r in out.where("row.source = 'rare'").select("row.doc_id", "copies").distinct().collect()]
    assert abs(np.var([*copies, *[0] * (1000 - len(copies))]) / 4.5 - 1) < 0.2  # Poisson: variance equals mean
    again = mixing.mixed(df, {"rare": 3.0, "big": 1.0})
    key = lambda x: sorted((r.row.doc_id, r.copy, r.shuffle_key) for r in x.collect())
    assert key(out) == key(again)
    every = mixing.mixed(docs)
    assert set(every.select("row.*").columns) == set(docs.columns)
    assert mixing.mixed(empty).collect() == []
    assert {r.row.source for r in mixing.mixed(df, {"big": 1.0}).collect()} == {"big"}


def test_mixing_many_small_sources(spark):
    """Sources below and above the size that is broadcast draw the same copies as SQL says."""
    import duckdb

    rows = [(i, "t", "en", None if i % 3 == 0 else "big" if i % 3 == 1 else f"small{i}", 1) for i in range(6000)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    got = Counter((r.doc_id, r.copies, r.copy) for r in mixing.op7_query(df).collect())
    con = duckdb.connect()
    con.register("documents", df.toPandas())
    want = con.execute(f"SELECT doc_id, copies, copy FROM ({mixing.OP7_SQL})").fetchall()
    assert got == Counter(want) and len({r[3] for r in rows}) > 1500


def test_mixing_large_means(spark):
    df = spark.createDataFrame([(i, "one" if i < 5 else "rest") for i in range(2000)], "doc_id bigint, source string")
    out = mixing.mixed(df, {"one": 0.5, "rest": 0.5}).where("row.source = 'one'")
    assert out.first().rate == 200.0
    assert abs(out.count() / 1000 - 1) < 0.15


def brute_topk(rows, k=20):
    whole = lambda v: [int(np.floor(np.float64(x) * 64)) for x in v]
    fine = [(i, whole(v)) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out, hold = [], lambda s: min(max(s, -(1 << 63)), (1 << 63) - 1)
    for at, (q, v) in enumerate(fine):
        if q % 20 == 0:
            scores = (((hold(sum(a * b for a, b in zip(v, w, strict=False)))), i) for j, (i, w) in enumerate(fine) if j != at)
            best = sorted(scores, key=lambda r: (-r[0], r[1]))[:k]
            out += [(q, n + 1, i, s) for n, (s, i) in enumerate(best)]
    return Counter(out)


@pytest.mark.parametrize("spread", [0.0, 0.02, 3.0])
def test_topk_against_brute_force(spark, spread, monkeypatch):
    rng = np.random.default_rng(7)
    centres = rng.normal(0, 1, (5, 8))
    rows = [(i, (centres[i % 5] * np.exp(rng.normal(0, spread)) + rng.normal(0, 0.02, 8)).astype(float).tolist()) for i in range(400)]
    rows += [(400 + i, [1.0] * 8) for i in range(30)]  # ties
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    monkeypatch.setattr(topk_search, "PART_ROWS", 64)
    monkeypatch.setattr(topk_search, "SEEDS", 25)
    monkeypatch.setattr(topk_search, "STEP", 2)
    monkeypatch.setattr(topk_search, "QUERY_ROWS", 7)
    got = Counter(tuple(r) for r in topk_search.op6_query(df).collect())
    assert got == brute_topk(rows)


@pytest.mark.parametrize("scale", [1e5, 1e7, 3e9, 1e30])
def test_topk_of_long_vectors(spark, scale):
    """Products beyond 2**53 stay exact, and those beyond a long are held at its ends."""
    rng = np.random.default_rng(9)
    rows = [(i, (rng.normal(0, 1, 6) * scale).tolist()) for i in range(120)]
    rows += [(200 + i, [scale, scale, 0.0, 0.0, 0.0, (i % 3) / 64]) for i in range(60)]  # differ in the last digits only
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    assert Counter(tuple(r) for r in topk_search.op6_query(df).collect()) == brute_topk(rows)


def test_topk_awkward(spark):
    rows = [(0, [0.0, 0.0]), (1, None), (2, [float("nan"), 1.0]), (3, [1.0, None]), (4, [-1.0, 2.0]), (4, [-1.0, 2.0]), (20, [5.0]), (None, [1.0, 1.0]), (40, [float("inf"), 0.0]), (60, [1e6, -1e6])]
    df = spark.createDataFrame([(*r, 1, 2.0) for r in rows], "vec_id bigint, embedding array<double>, label int, norm double")
    assert Counter(tuple(r) for r in topk_search.op6_query(df).collect()) == brute_topk(rows)
    assert topk_search.op6_query(df.where("false")).collect() == []


def test_cut_lineage_refuses_a_folder_of_one_machine():
    """Without spark.checkpoint.dir only a single process may choose a folder of its own."""
    from types import SimpleNamespace

    def frame(master):
        chosen = []
        sc = SimpleNamespace(master=master, getConf=lambda: SimpleNamespace(get=lambda _: None), getCheckpointDir=lambda: None, setCheckpointDir=chosen.append)
        return SimpleNamespace(sparkSession=SimpleNamespace(sparkContext=sc), checkpoint=lambda: chosen)

    assert len(cut_lineage(frame("local[4]"))) == len(cut_lineage(frame("local"))) == 1
    for master in ("spark://host:7077", "local-cluster[3,2,1024]", "yarn", "k8s://x"):
        with pytest.raises(ValueError):
            cut_lineage(frame(master))


def test_cut_lineage_keeps_rows(spark):
    assert sorted(r.id for r in cut_lineage(spark.range(10)).collect()) == list(range(10))
