"""Sharding by a hierarchical weighted hash tree: region, then rack, then shard.

At each level every child draws an exponential variate from a hash of the key and its own name, divided by
its weight (the sum of the shard weights below it), and the least draw wins. A child's draw depends on nothing
but key, name and weight. So when weights change below one node, keys move only into or out of subtrees whose
weights changed, and a key that stays in an unchanged subtree keeps its rack and shard.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from marlstone.llm.common import stored


@dataclass(frozen=True)
class Tree:
    """regions[r][k] is rack k of region r: its (shard, weight) pairs."""

    regions: tuple[tuple[tuple[tuple[int, float], ...], ...], ...]

    @property
    def shards(self) -> int:
        return sum(len(rack) for region in self.regions for rack in region)


def balanced(shards: int, per_rack: int = 4, racks: int = 2) -> Tree:
    """Shards 0 to shards - 1 with weight 1, in racks of `per_rack`, in regions of `racks` racks."""
    if shards < 1:
        raise ValueError("a tree needs a shard")
    rows = [tuple((s, 1.0) for s in range(i, min(i + per_rack, shards))) for i in range(0, shards, per_rack)]
    return Tree(tuple(tuple(rows[i : i + racks]) for i in range(0, len(rows), racks)))


def grown(tree: Tree, weight: float = 1.0) -> Tree:
    """One more shard, in a region of its own: no other subtree's weight changes, so rows move only into it."""
    return Tree((*tree.regions, (((tree.shards, weight),),)))


def _bits(*parts: Column) -> Column:
    """52 bits of the md5 of the parts as text, with bars between; a null is empty."""
    text = F.concat_ws("|", *(F.coalesce(p.cast("string"), F.lit("")) for p in parts))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10).cast("long")


def _least(key: Column, level: str, children: Column) -> Column:
    """Of `children` (name, weight), the name with the least weighted draw; the lower name wins a tie."""

    def draw(child: Column) -> Column:
        bits = _bits(key, F.lit(level), child["name"])
        return F.struct((-F.log((bits + F.lit(0.5)) / F.lit(2.0**52)) / child["weight"]).alias("draw"), child["name"].alias("name"))

    return F.array_min(F.transform(children, draw))["name"]


def _children(pairs: list[tuple[int, float]]) -> Column:
    return F.array(*(F.struct(F.lit(n).alias("name"), F.lit(float(w)).alias("weight")) for n, w in pairs))


def place(df: DataFrame, key: Column, tree: Tree, prefix: str = "") -> DataFrame:
    """Adds `region`, `rack` (numbered through all regions) and `shard`, each with `prefix`; a null key is a key."""
    weight = lambda rack: sum(w for _, w in rack)
    regions, racks, shards = [], [], []
    for r, region in enumerate(tree.regions):
        regions.append((r, sum(map(weight, region))))
        racks.append(_children([(len(shards) + k, weight(rack)) for k, rack in enumerate(region)]))
        shards += [_children(list(rack)) for rack in region]
    region, rack, shard = (prefix + x for x in ("region", "rack", "shard"))
    return (
        df.withColumn(region, _least(key, "region", _children(regions)))
        .withColumn(rack, _least(key, "rack", F.element_at(F.array(*racks), F.col(region) + 1)))
        .withColumn(shard, _least(key, "shard", F.element_at(F.array(*shards), F.col(rack) + 1)))
    )


def with_slots(df: DataFrame, group: str, lane: str, slot: str = "slot") -> DataFrame:
    """Numbers the rows of each `group` from 0 without gaps.

    `lane` deals each group's rows to a fixed number of lanes, so no task sorts a whole group: rows are numbered
    within (group, lane), and each lane starts where the lanes before it end. The lanes' starts are the only
    broadcast: groups times lanes rows. `df` must not change when read twice.
    """
    counts = df.groupBy(group, lane).agg(F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(W.partitionBy(group).orderBy(lane).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select(group, lane, before.alias("start"))
    rank = F.row_number().over(W.partitionBy(group, lane).orderBy("doc_id", "text_crc32", "size")) - 1
    return df.withColumn("rank", rank).join(F.broadcast(starts), [group, lane]).withColumn(slot, (F.col("start") + F.col("rank")).cast("long")).drop("rank", "start")


def shard_documents(docs: DataFrame, shards: int = 40, lanes: int = 256) -> DataFrame:
    """Places documents (doc_id, text) into `shards` shards by doc_id; see `balanced` and `grown` for the trees.

    Law `key`: doc_id and the shard count decide, nothing else. Size is the text's UTF-8 bytes (null: none) plus
    16. A shard's slots go by lane, then doc_id, text_crc32 and size; a lane is a hash of those, but rows without a
    doc_id are dealt to the lanes evenly. A null text has the crc32 of an empty one; a null doc_id is one more key;
    repeated rows share a shard and have slots of their own; an empty table gives no rows; other columns are not read.
    Only ids, sizes and sums are shuffled; the texts are read once.
    """
    tree = balanced(shards)
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    rows = docs.select("doc_id", (F.octet_length(text) + F.lit(16)).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    even = F.when(F.col("doc_id").isNull(), F.monotonically_increasing_id()).otherwise(_bits(F.col("doc_id"), F.lit("lane"), F.col("text_crc32"), F.col("size")))
    rows = rows.withColumn("lane", F.pmod(even, F.lit(lanes)).cast("int"))
    rows = place(rows, F.col("doc_id"), tree)
    rows = place(rows, F.col("doc_id"), grown(tree), "grown_")
    slotted = with_slots(stored(rows), "shard", "lane")
    return slotted.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard", "region", "rack")


def _tree_sql(tree: Tree, prefix: str) -> str:
    """Common table expressions that place `doc` (row, doc_id, ...) in the tree: <prefix>placed (row, region, rack, shard)."""
    nodes: list[tuple[str, int, int, float]] = []
    racks = 0
    for r, region in enumerate(tree.regions):
        nodes.append(("region", 0, r, sum(w for rack in region for _, w in rack)))
        for rack in region:
            nodes.append(("rack", r, racks, sum(w for _, w in rack)))
            nodes += [("shard", racks, s, w) for s, w in rack]
            racks += 1
    values = ", ".join(f"('{level}', {above}, {name}, {weight!r}::DOUBLE)" for level, above, name, weight in nodes)
    steps = []
    for level, above, source in (("region", "0", "doc"), ("rack", "region", f"{prefix}region"), ("shard", "rack", f"{prefix}rack")):
        kept = "row, doc_id" + {"region": "", "rack": ", region", "shard": ", region, rack"}[level]
        draw = f"-ln((('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || '|{level}|' || name), 1, 13))::BIGINT + 0.5) / 4503599627370496.0) / weight"
        steps.append(f"{prefix}{level if level != 'shard' else 'placed'} AS (SELECT {kept}, arg_min(name, struct_pack(d := {draw}, n := name)) AS {level} FROM {source} JOIN {prefix}node ON level = '{level}' AND above = {above} GROUP BY ALL)")
    return f"{prefix}node(level, above, name, weight) AS (VALUES {values}),\n" + ",\n".join(steps)


def documents_sql(shards: int = 40, lanes: int = 256) -> str:
    """DuckDB SQL for the rows of `shard_documents(documents)` where no doc_id is null."""
    tree = balanced(shards)
    return rf"""
WITH crc_table AS (SELECT list_transform(range(256), lambda n: list_reduce(list_prepend(n, range(8)), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
bytes AS (SELECT row_number() OVER () AS row, doc_id, list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda x: ('0x' || x)::BIGINT) AS b FROM documents),
doc AS (SELECT row, doc_id, CAST(len(b) + 16 AS BIGINT) AS size, CAST(xor(list_reduce(list_prepend(4294967295::BIGINT, b), lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295) AS BIGINT) AS text_crc32 FROM bytes, crc_table),
lane AS (SELECT row, ('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || '|lane|' || text_crc32 || '|' || size), 1, 13))::BIGINT % {lanes} AS lane FROM doc),
{_tree_sql(tree, "")},
{_tree_sql(grown(tree), "grown_")}
SELECT doc.doc_id, size, text_crc32, 'key' AS law, CAST(p.shard AS INTEGER) AS shard,
       row_number() OVER (PARTITION BY p.shard ORDER BY lane, doc.doc_id, text_crc32, size) - 1 AS slot,
       CAST(g.shard AS INTEGER) AS grown_shard, CAST(p.region AS INTEGER) AS region, CAST(p.rack AS INTEGER) AS rack
FROM doc JOIN lane USING (row) JOIN placed p USING (row) JOIN grown_placed g USING (row)
"""
