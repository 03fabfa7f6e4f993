"""SimHash near-duplicate groups by multi-index hashing.

Each document gets a 64-bit fingerprint: bit i is 1 if it is set in over half
of the XXH64 hashes of the document's word shingles. Two fingerprints link if at
most RADIUS bits differ, and a document's group is everything reachable by links.

Search. Fingerprints are cut into segments with radii r_i such that
sum(r_i + 1) = RADIUS + 1: of two linked fingerprints, some segment i differs in
at most r_i bits (else over RADIUS bits differ). So a table of (segment, key)
is probed with the Hamming ball of radius r_i around each key, and complete
distances verify what the table returns. The more fingerprints there are, the fewer and
wider the segments, and the larger the balls (`segments`): keys stay selective.

Crowded keys. A key of the table that over `crowd` fingerprints share isn't
probed pair by pair. Its members and probers meet at codewords instead: a
fingerprint with the key itself goes to all words within 2 bits of its other
bits, one that probes from 1 bit away to all words within 1. Any two that meet
at a word link (2+2, 1+2+1 or 1+1+2 bits differ at most), and any two that link
in this key meet (distance 4 splits in 2+2, 3 in 2+1). A fingerprint so gets at
most some thousand words, however many share the key.

Defined cases: a null text counts as empty; no words: fingerprint 0, linked
like any other; a null id belongs to its group but never names it (a group
without any id has a null component); repeated rows stay apart, in one group;
an empty table gives an empty result.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut_lineage, slices

WORDS, SEED, RADIUS = 4, 42, 4
CROWD = 1000
#: Rows of links that a stored file holds, about.
ROWS_OF_A_FILE = 20_000
#: A fingerprint that over one in HEAVY rows have is joined by a broadcast; fewer than HEAVY fingerprints can be.
HEAVY = 1024
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def fingerprint(text: str | None, words: int = WORDS, seed: int = SEED) -> int:
    """The SimHash of `text`, A-Z lower-cased, over shingles of `words` words with repeats."""
    tokens = (text or "").encode("utf-8", "replace").translate(_LOWER).split()
    if not tokens:
        return 0
    if len(tokens) <= words:
        hashes = [xxhash.xxh64_intdigest(b" ".join(tokens), seed)]
    else:
        joined, digest = b" ".join(tokens), xxhash.xxh64_intdigest
        after = np.cumsum(np.fromiter(map(len, tokens), np.int64, len(tokens)) + 1)
        begins = [0, *after[:-words].tolist()]
        hashes = [digest(joined[a : b - 1], seed) for a, b in zip(begins, after[words - 1 :].tolist(), strict=True)]
    counts = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 65536):
        block = np.array(hashes[i : i + 65536], dtype="<u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(block, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(hashes), bitorder="little").view("<u8")[0])


def with_fingerprints(docs: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, fp) and the columns `keep`: fingerprints as signed longs."""
    names = ["doc_id", *keep]

    def run(batches):
        for batch in slices(batches):
            fps = np.array([fingerprint(t.as_py()) for t in batch.column("text")], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(fps, pa.int64())], [*names, "fp"])

    kinds = ", ".join(f"{c} {docs.schema[c].dataType.simpleString()}" for c in names)
    return docs.select(*names, "text").mapInArrow(run, f"{kinds}, fp bigint")


def segments(count: int) -> list[tuple[int, int, int]]:
    """(shift, bits, radius) of each segment: two or three of them, with the fewest probes and expected candidates.

    A probe meets ``count / 2**bits`` fingerprints on average: three segments of 45 probes
    are the choice up to some 24 million fingerprints, two of 562 beyond.
    """

    def cut(n: int) -> list[tuple[int, int, int]]:
        edges = [64 * i // n for i in range(n + 1)]
        return [(a, b - a, (RADIUS + 1 - n + n - 1 - i) // n) for i, (a, b) in enumerate(zip(edges, edges[1:], strict=False))]

    def cost(found: list[tuple[int, int, int]]) -> float:
        return sum(len(_masks(range(bits), radius)) * (1 + count / 2**bits) for _, bits, radius in found)

    return min((cut(n) for n in (2, 3)), key=cost)


def _masks(places: range | list[int], radius: int) -> list[int]:
    """All differences of at most `radius` bits among `places`."""
    return [sum(1 << i for i in some) for r in range(radius + 1) for some in combinations(places, r)]


def _longs(values: list[int]) -> Column:
    """The values, unsigned, as a constant array of signed longs."""
    return F.split(F.lit(" ".join(str(v - (1 << 64) if v >> 63 else v) for v in values)), " ").cast("array<bigint>")


def _keys(fps: DataFrame, cuts: list[tuple[int, int, int]], probe: bool) -> DataFrame:
    """(seg, key, fp, off): the segments' keys, or with `probe` the balls around them; off: bits away."""

    def entries(i: int, shift: int, bits: int, radius: int) -> Column:
        own = F.shiftrightunsigned("fp", shift).bitwiseAND(F.lit((1 << bits) - 1).cast("bigint"))
        return F.transform(
            _longs(_masks(range(bits), radius if probe else 0)),
            lambda m: F.struct(F.lit(i).alias("seg"), own.bitwiseXOR(m).alias("key"), F.bit_count(m).cast("int").alias("off")),
        )

    every = [entries(i, *cut) for i, cut in enumerate(cuts)]
    return fps.select("fp", F.explode(F.concat(*every)).alias("k")).select("k.seg", "k.key", "fp", "k.off")


def _words(cuts: list[tuple[int, int, int]]) -> Column:
    """All codewords of (seg, fp, off): `fp` without its segment, and what differs from that in at most 2 - off other bits."""
    out = None
    for i, (shift, bits, _) in enumerate(cuts):
        free = [i for i in range(64) if not shift <= i < shift + bits]
        rest = F.col("fp").bitwiseAND(F.get(_longs([sum(1 << i for i in free)]), F.lit(0)))
        arms = [F.transform(_longs(_masks(free, 2 - off)), rest.bitwiseXOR) for off in range(3)]
        words = F.when(F.col("off") == 0, arms[0]).when(F.col("off") == 1, arms[1]).otherwise(arms[2])
        out = F.when(F.col("seg") == i, words) if out is None else out.when(F.col("seg") == i, words)
    return out


def links(fps: DataFrame, crowd: int = CROWD, cuts: list[tuple[int, int, int]] | None = None) -> DataFrame:
    """(a, b): pairs of the distinct fingerprints `fps` whose components are those of all links.

    Outside crowded keys these are all links; in crowded ones, for each codeword
    a link from every fingerprint to the least one.
    """
    cuts = cuts or segments(fps.count())
    table, probes = _keys(fps, cuts, False), _keys(fps, cuts, True)
    crowded = table.groupBy("seg", "key").count().where(F.col("count") > crowd).select("seg", "key")
    some = crowded.limit(1).count() > 0
    if some:
        crowded = cut_lineage(crowded)
        held = probes.join(crowded, ["seg", "key"], "left_semi")
        probes = probes.join(crowded, ["seg", "key"], "left_anti")
    other = table.select("seg", "key", F.col("fp").alias("b"))
    pairs = (
        probes.select("seg", "key", F.col("fp").alias("a"))
        .join(other, ["seg", "key"])
        .where((F.col("a") > F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= RADIUS))
        .select("a", "b")
    )
    if some:
        met = held.select("seg", "key", "fp", F.explode(_words(cuts)).alias("word"))
        first = met.groupBy("seg", "key", "word").agg(F.min("fp").alias("b"), F.count("*").alias("n")).where("n > 1")
        pairs = pairs.unionByName(
            met.join(first, ["seg", "key", "word"]).where(F.col("fp") > F.col("b")).select(F.col("fp").alias("a"), "b")
        )
    return pairs.distinct()


def components(pairs: DataFrame) -> DataFrame:
    """(node, root): the least node that each node of `pairs` (a, b) reaches.

    Alternates large-star and small-star steps until the links no longer change;
    links never grow in number, and rounds grow with the logarithm of a path. What is stored between steps stands in as
    many files as its rows need.
    """

    def stored(df: DataFrame) -> DataFrame:
        return cut_lineage(df.coalesce(8 + 2 * seen[0] // ROWS_OF_A_FILE))

    def smallest(df: DataFrame) -> DataFrame:
        # Stored, so that the join that follows has two plain sides and can be split where a node has very many links.
        return stored(df.groupBy("a").agg(F.min("b").alias("m")))

    def state(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    now = cut_lineage(pairs.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct())
    seen = state(now)
    while seen[0]:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = smallest(both).select("a", F.least("a", "m").alias("m"))
        large = stored(both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct())
        small = large.join(smallest(large), "a").select(F.explode(F.array("a", "b")).alias("a"), F.col("m").alias("b"))
        now = stored(small.where("a <> b").distinct())
        before, seen = seen, state(now)
        if seen == before:
            break
    return now.select(F.col("a").alias("node"), F.col("b").alias("root"))


def _components_of(fps: DataFrame, crowd: int, cuts: list[tuple[int, int, int]] | None) -> DataFrame:
    """(fp, n, root, component_id) of each distinct fingerprint of `fps` (doc_id, fp); root: the same for all of a group, and only for them."""
    reps = cut_lineage(fps.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")))
    roots = components(links(reps.select("fp"), crowd, cuts))
    # Only fingerprints that link to another one have a root; few documents have one.
    every = roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())
    named = cut_lineage(every.join(reps, every["node"] == reps["fp"]).select("node", "root", "least"))
    least = cut_lineage(named.groupBy("root").agg(F.min("least").alias("component_id")))
    linked = named.join(least, "root").select(F.col("node").alias("fp"), "root", "component_id")
    own = F.col("root").isNull()
    return cut_lineage(
        reps.join(linked, "fp", "left").select(
            "fp", "n", F.when(own, F.col("fp")).otherwise(F.col("root")).alias("root"), F.when(own, F.col("least")).otherwise(F.col("component_id")).alias("component_id")
        )
    )


def _joined(rows: DataFrame, known: DataFrame) -> DataFrame:
    """`rows` with what `known` holds for their fingerprint, wherever their rows crowd.

    A fingerprint of over one in HEAVY rows is joined by a broadcast of fewer than HEAVY
    rows; the others, of few rows each, meet in a shuffle.
    """
    total = known.agg(F.sum("n")).first()[0] or 0
    heavy = F.broadcast(known.where(F.col("n") * HEAVY > total).drop("n"))
    light = known.where(F.col("n") * HEAVY <= total).drop("n")
    return rows.join(heavy, "fp").unionByName(rows.join(heavy, "fp", "left_anti").join(light, "fp"))


def grouped(docs: DataFrame, crowd: int = CROWD, cuts: list[tuple[int, int, int]] | None = None) -> DataFrame:
    """(doc_id, fp, component_id) for each row of `docs`."""
    fps = cut_lineage(with_fingerprints(docs))
    return _joined(fps, _components_of(fps, crowd, cuts)).select("doc_id", "fp", "component_id")


def op4_query(docs: DataFrame) -> DataFrame:
    return grouped(docs).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def deduplicated(docs: DataFrame) -> DataFrame:
    """`docs` with one row of each group.

    It is the row with the least id (a row without an id only where no row of the group has one), and
    of several rows with that id the one whose two hashes of all columns are least. So
    the choice doesn't depend on the order of rows, and an id on texts of several groups
    stands in as many rows. Of rows that are equal in all columns one stays.
    """
    told = [x for c in docs.columns for x in (docs[c], docs[c].isNull())]
    # Equal rows, and only they, have equal hashes; with 128 bits, but for a chance of 2**-128 a pair.
    marked = docs.select(F.xxhash64(F.lit(1), *told).alias("__h"), F.xxhash64(F.lit(2), *told).alias("__i"), F.struct(*docs.columns).alias("__row"))
    fps = cut_lineage(with_fingerprints(marked.select("__row.doc_id", "__row.text", "__h", "__i"), ("__h", "__i")))
    by_root = _joined(fps, _components_of(fps.select("doc_id", "fp"), CROWD, None)).groupBy("root")
    best = by_root.agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "__h", "__i")).alias("b")).select("b.__h", "b.__i")
    # Equal rows become one before the shuffle, so that no task gets very many of them.
    single = marked.groupBy("__h", "__i").agg(F.first("__row").alias("__row"))
    return single.join(cut_lineage(best), ["__h", "__i"], "left_semi").select("__row.*")
