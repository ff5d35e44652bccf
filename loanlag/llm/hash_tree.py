"""Shards from a hierarchical weighted hash tree.

A document descends region, rack and shard.  At each level every child draws
-ln(u) / weight, with u from a hash of document and child, and the smallest
draw wins, so a child is chosen in proportion to its weight.  A draw depends
on nothing but the document, the child's name and its weight: a changed
weight moves documents only into or out of that child, at its own level, and
every other subtree keeps its documents where they are.
"""

from __future__ import annotations

from collections import defaultdict
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import total_before

#: Hex digits of an MD5 that make a draw.
DRAW_DIGITS = 12


@dataclass(frozen=True)
class Shard:
    number: int
    region: str
    rack: str
    weight: float = 1.0


def layout(shards: int, per_rack: int = 4, racks: int = 2, base: int = 24) -> list[Shard]:
    """A tree of ``shards`` equal shards.

    The first ``base`` fill regions of ``racks`` racks of ``per_rack``.  Each
    one beyond them opens a region and a rack of its own, so that it takes
    documents only into itself.
    """
    out = []
    for n in range(shards):
        region = n // (per_rack * racks) if n < base else base + n
        rack = n // per_rack % racks if n < base else 0
        out.append(Shard(n, f"r{region}", f"r{region}.{rack}"))
    return out


def draw(key: Column, name: Column, weight: Column) -> Column:
    """-ln(u) / weight, u uniform in (0, 1) by MD5 of key and name."""
    digits = F.substring(F.md5(F.concat_ws("|", key, name)), 1, DRAW_DIGITS)
    u = (F.conv(digits, 16, 10).cast("double") + 0.5) / float(16**DRAW_DIGITS)
    return -F.ln(u) / weight


def descend(key: Column, shards: list[Shard]) -> Column:
    """The shard number of a key: three weighted draws, each among the children of the node chosen before."""
    regions: dict[str, float] = defaultdict(float)
    racks: dict[str, dict[str, float]] = defaultdict(lambda: defaultdict(float))
    leaves: dict[str, list[tuple[str, float]]] = defaultdict(list)
    for s in (s for s in shards if s.weight > 0):
        regions[s.region] += s.weight
        racks[s.region][s.rack] += s.weight
        leaves[s.rack].append((str(s.number), s.weight))

    def children(pairs) -> Column:
        return F.array(*[F.struct(F.lit(n).alias("name"), F.lit(float(w)).alias("weight")) for n, w in sorted(pairs)])

    def by_parent(of: dict[str, list]) -> Column:
        return F.create_map(*[x for name in sorted(of) for x in (F.lit(name), children(of[name]))])

    def winner(options: Column) -> Column:
        drawn = F.transform(options, lambda c: F.struct(draw(key, c["name"], c["weight"]).alias("draw"), c["name"].alias("name")))
        return F.array_min(drawn)["name"]

    region = winner(children(regions.items()))
    rack = winner(F.element_at(by_parent({r: list(x.items()) for r, x in racks.items()}), region))
    return winner(F.element_at(by_parent(leaves), rack)).cast("int")


def assign(docs: DataFrame, shards: list[Shard], grown: list[Shard], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) of every row.

    ``shard`` is drawn from ``shards``, ``grown_shard`` from ``grown``; both
    depend on the id alone (rows of a null id go together).  ``slot`` counts
    a shard's rows from 0 without gaps, in the order of hashes of id and
    text, so that rows of one id, null ids too, are counted by many tasks.  ``size`` is the text's UTF-8 bytes
    plus 8, ``text_crc32`` the CRC-32 of those bytes; a null text counts as
    no bytes.  Repeated rows each get a slot.  An empty table gives no rows.
    Other columns are not read.
    """
    rows = drawn(docs, shards, grown, id_col, text_col)
    slots = total_before(rows, ["shard"], "__bucket", ["__order", "doc_id", "text_crc32"], "__one", "slot")
    return slots.select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")


def drawn(docs: DataFrame, shards: list[Shard], grown: list[Shard], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each row's shards, its place in the order of hashes and the part of that order it is counted in."""
    key = F.coalesce(F.col(id_col).cast("string"), F.lit("null"))
    bytes_of = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    return docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        (F.length(bytes_of) + F.lit(8)).cast("long").alias("size"),
        F.crc32(bytes_of).alias("text_crc32"),
        F.lit("key").alias("law"),
        descend(key, shards).alias("shard"),
        descend(key, grown).alias("grown_shard"),
        F.md5(F.concat_ws("|", key, F.crc32(bytes_of).cast("string"))).alias("__order"),
        F.lit(1).cast("long").alias("__one"),
    ).withColumn("__bucket", F.substring("__order", 1, 3))


def oracle(shards: list[Shard], grown: list[Shard], table: str = "documents") -> str:
    """DuckDB SQL for ``assign``."""
    u = f"(('0x' || substr(md5(k || '|' || name), 1, {DRAW_DIGITS}))::BIGINT::DOUBLE + 0.5) / {float(16**DRAW_DIGITS)!r}"

    def tree(of: list[Shard], name: str) -> str:
        leaves = ", ".join(f"('{s.region}', '{s.rack}', {s.number}, {s.weight}::DOUBLE)" for s in of)
        return f"""{name}_leaf(region, rack, number, weight) AS (VALUES {leaves}),
{name}_region AS (SELECT k, arg_min(name, (-ln({u}) / weight, name)) AS region
  FROM keys, (SELECT region AS name, sum(weight) AS weight FROM {name}_leaf GROUP BY 1) GROUP BY k),
{name}_rack AS (SELECT k, arg_min(name, (-ln({u}) / weight, name)) AS rack
  FROM {name}_region JOIN (SELECT region, rack AS name, sum(weight) AS weight FROM {name}_leaf GROUP BY 1, 2) USING (region) GROUP BY k),
{name} AS (SELECT k, arg_min(name, (-ln({u}) / weight, name))::INTEGER AS shard
  FROM {name}_rack JOIN (SELECT rack, number::VARCHAR AS name, weight FROM {name}_leaf) USING (rack) GROUP BY k)"""

    return f"""
WITH rows_in AS (SELECT doc_id, coalesce(doc_id::VARCHAR, 'null') AS k, encode(coalesce(text, '')) AS b FROM {table}),
keys AS (SELECT DISTINCT k FROM rows_in),
crc_table AS (SELECT list(c ORDER BY i) AS t FROM (
  SELECT i, list_reduce(list_prepend(i, [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]),
    lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM (SELECT unnest(range(256)) AS i))),
sized AS (SELECT doc_id, k, octet_length(b) + 8 AS size,
  xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(regexp_extract_all(hex(b), '..'), lambda h: ('0x' || h)::BIGINT)),
    lambda c, v: xor(c >> 8, t[(xor(c, v) & 255) + 1]))) AS text_crc32
  FROM rows_in, crc_table),
{tree(shards, 'now')},
{tree(grown, 'later')}
SELECT doc_id, size::BIGINT AS size, text_crc32::BIGINT AS text_crc32, 'key' AS law, now.shard AS shard,
  row_number() OVER (PARTITION BY now.shard ORDER BY md5(k || '|' || text_crc32), doc_id NULLS FIRST, text_crc32) - 1 AS slot, later.shard AS grown_shard
FROM sized JOIN now USING (k) JOIN later USING (k)"""
