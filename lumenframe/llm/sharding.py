"""Sharding by a hierarchical weighted hash tree.

A cluster map lists shards with their region, rack and weight. A document
descends region, rack and shard; at each level every child draws
``-ln(u) / weight`` from a hash of (document, child) and the least draw wins, so
children get documents in proportion to their weights. A draw depends on nothing
but the document and the child: when a weight changes, documents move only out
of or into the children on the path whose weights changed.

A shard added to an existing region pulls documents into that region, and
those spread over all of its shards; a shard added as a region of its own takes
documents only into itself. `grown` adds it that way, and `layout` builds every
size by repeating it after the first full regions, so one more shard never
moves a row between two old ones.

Defined cases: all rows with a null id draw alike and share a shard; a null text
has size 8; repeated rows get the same shard and slots of their own.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import digest, hashed_unit, hashed_unit_sql

#: Sub-buckets of a shard, in which slots are counted apart: three hexadecimal digits of a hash.
SUBS = 16**3


@dataclass(frozen=True)
class Shard:
    region: str
    rack: str
    shard: int
    weight: float = 1.0


def layout(shards: int, racks: int = 3, per_rack: int = 4, base: int = 24) -> list[Shard]:
    """The cluster map of `shards` equal shards: up to `base` in regions of racks, each later one a region of its own."""
    out = []
    for i in range(min(shards, base)):
        rack, region = i // per_rack, i // per_rack // racks
        out.append(Shard(f"region{region}", f"rack{rack}", i))
    for i in range(base, shards):
        out.append(Shard(f"region-of-{i}", f"rack-of-{i}", i))
    return out


def grown(cluster: list[Shard], weight: float = 1.0) -> list[Shard]:
    """`cluster` with one more shard, in a region of its own."""
    i = 1 + max((s.shard for s in cluster), default=-1)
    return [*cluster, Shard(f"region-of-{i}", f"rack-of-{i}", i, weight)]


def tree(cluster: list[Shard]) -> dict[str, dict[str, float]]:
    """The children of each node and their weights: of the root "", of regions, of racks ("region/rack")."""
    out: dict[str, dict[str, float]] = {}
    for s in cluster:
        if s.weight > 0:
            rack = f"{s.region}/{s.rack}"
            for node, child in (("", s.region), (s.region, rack), (rack, str(s.shard))):
                children = out.setdefault(node, {})
                children[child] = children.get(child, 0.0) + s.weight
    return out


def placed(key: Column, cluster: list[Shard]) -> Column:
    """The shard of `key`: from the root, three times the child with the least weighted draw."""
    nodes = tree(cluster)
    children = F.create_map(*[
        e for node, found in nodes.items()
        for e in (F.lit(node), F.array(*[F.struct(F.lit(n).alias("name"), F.lit(float(w)).alias("weight")) for n, w in found.items()]))
    ])

    def below(node: Column) -> Column:
        draws = F.transform(
            F.element_at(children, node), lambda c: F.struct((-F.log(hashed_unit(c["name"], key)) / c["weight"]).alias("draw"), c["name"].alias("name"))
        )
        return F.array_min(draws)["name"]

    return below(below(below(F.lit("")))).cast("int")


def with_slots(df: DataFrame, shard: str, key: str, spread: tuple[str, ...] = (), slot: str = "slot") -> DataFrame:
    """`df` with gapless slot numbers from 0 within each shard (which is never null).

    Equal rows are counted before the shuffle and written out again at the end. The others are
    counted in SUBS sub-buckets of each shard, by a hash of `key` and the columns `spread`, so no task
    gets a whole shard or all rows of a key. Order within a shard: sub-bucket, key, the other columns.
    """
    others = [c for c in df.columns if c not in (shard, key)]
    sub = F.conv(F.substring(digest("slot", F.col(key), *(F.col(c) for c in spread)), 1, 3), 16, 10).cast("int")
    rows = df.groupBy(df.columns).agg(F.count("*").alias("__copies")).withColumn("__sub", sub)
    counts = rows.groupBy(shard, "__sub").agg(F.sum("__copies").alias("__n"))
    ahead = Window.partitionBy(shard).orderBy("__sub").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(shard, "__sub", F.coalesce(F.sum("__n").over(ahead), F.lit(0)).alias("__at"))
    within = Window.partitionBy(shard, "__sub").orderBy(key, *others).rowsBetween(Window.unboundedPreceding, -1)
    numbered = rows.withColumn("__k", F.coalesce(F.sum("__copies").over(within), F.lit(0)))
    first = (F.col("__at") + F.col("__k")).cast("bigint")
    return numbered.join(offsets, [shard, "__sub"]).select(
        *df.columns, F.explode(F.sequence(first, first + F.col("__copies") - 1)).alias(slot)
    )


def op5_query(docs: DataFrame, shards: int = 24) -> DataFrame:
    """Every document in one of `shards` shards by law `key`: its id and the number of shards decide."""
    cluster = layout(shards)
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(
        "doc_id",
        (F.octet_length(text) + 8).cast("bigint").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        placed(F.col("doc_id"), cluster).alias("shard"),
        placed(F.col("doc_id"), grown(cluster)).alias("grown_shard"),
    )
    # The other columns follow from the id.
    return with_slots(rows, "shard", "doc_id", ("size", "text_crc32")).select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard"
    )


# The same in SQL: the draws of a level compared one by one, and CRC-32 as a fold over the text's bytes.


def _placed_sql(cluster: list[Shard], key: str) -> str:
    nodes = tree(cluster)

    def below(node: str) -> str:
        if node not in nodes:
            return node
        draws = {name: f"(-ln({hashed_unit_sql(name, key)}) / {w!r}::DOUBLE)" for name, w in nodes[node].items()}
        arms = " ".join(f"WHEN {d} <= least({', '.join(draws.values())}) THEN {below(name)}" for name, d in draws.items())
        return f"CASE {arms} END"

    return below("")


OP5_SQL = f"""
WITH bits AS (SELECT list(c ORDER BY i) AS t FROM (
  SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM range(256) AS r(i))),
rows AS (SELECT doc_id, text, coalesce(text, '') AS body, hex(encode(coalesce(text, ''))) AS h FROM documents),
sized AS (SELECT doc_id, text, (length(h) // 2 + 8)::BIGINT AS size,
  xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(0, length(h) // 2), lambda k: ('0x' || substr(h, 2 * k + 1, 2))::BIGINT)),
    lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) AS text_crc32 FROM rows, bits),
placed AS (SELECT doc_id, size, text_crc32, ({_placed_sql(layout(24), "doc_id")})::INT AS shard,
  ({_placed_sql(grown(layout(24)), "doc_id")})::INT AS grown_shard FROM sized)
SELECT doc_id, size, text_crc32, 'key' AS law, shard, grown_shard,
  row_number() OVER (PARTITION BY shard ORDER BY substr(md5('slot|' || coalesce(doc_id::VARCHAR, '') || '|' || size || '|' || text_crc32), 1, 3), doc_id, size, text_crc32) - 1 AS slot FROM placed
"""
