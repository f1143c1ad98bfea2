"""Sharding by a hierarchical weighted hash tree: region, rack, shard.

At each level every child draws ``-ln(u) / weight`` with ``u`` hashed from the key and
the child's name, and the smallest draw wins. A child's draw depends on nothing but
the key, its name and its weight. Raising a weight, or adding a child, can therefore
only pull rows into that child; siblings exchange nothing among themselves, and other
subtrees are left alone. A shard that is added as a subtree of its own takes rows
from all others and moves none between them.

Only DataFrame expressions are used: the descent is one projection without a shuffle.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Hex digits of the key's hash that split a shard into cells for numbering its rows: 16**3 cells a shard.
CELL_DIGITS = 3


@dataclass(frozen=True)
class Node:
    """A subtree. ``shard`` is set for leaves; a parent weighs what its children weigh together."""

    name: str
    children: tuple[Node, ...] = ()
    shard: int | None = None
    own_weight: float = 1.0

    @property
    def weight(self) -> float:
        return sum(c.weight for c in self.children) if self.children else self.own_weight


def even_tree(shards: int, per_rack: int = 2, racks_per_region: int = 2) -> Node:
    """Regions of racks of equal shards, filled in order."""
    leaves = [Node(f"s{i}", shard=i) for i in range(shards)]
    racks = [Node(f"k{i // per_rack}", tuple(leaves[i : i + per_rack])) for i in range(0, shards, per_rack)]
    regions = [
        Node(f"r{i // racks_per_region}", tuple(racks[i : i + racks_per_region]))
        for i in range(0, len(racks), racks_per_region)
    ]
    return Node("root", tuple(regions))


def grown(tree: Node, shard: int, weight: float = 1.0) -> Node:
    """The tree with one more shard, in a region and rack of its own: rows move into it only."""
    leaf = Node(f"s{shard}", shard=shard, own_weight=weight)
    return Node(tree.name, (*tree.children, Node(f"r+{shard}", (Node(f"k+{shard}", (leaf,)),))))


def _draw(key: Column, node: Node) -> Column:
    """Weighted draw of a child: exponential with rate ``weight``; the smallest of several wins by weight."""
    bits = F.conv(F.substring(F.md5(F.concat(key, F.lit("/" + node.name)).cast("binary")), 1, 13), 16, 10).cast("long")
    return -F.log((bits.cast("double") + F.lit(0.5)) / F.lit(float(2**52))) / F.lit(float(node.weight))


def descend(key: Column, node: Node) -> Column:
    """Shard that the key falls to below ``node``. Equal draws go to the child named first."""
    if node.shard is not None:
        return F.lit(node.shard)
    if len(node.children) == 1:
        return descend(key, node.children[0])
    draws = F.array(*[F.struct(_draw(key, c).alias("draw"), F.lit(i).alias("child")) for i, c in enumerate(node.children)])
    winner = F.array_min(draws)["child"]
    return reduce(
        lambda rest, pair: F.when(winner == pair[0], descend(key, pair[1])).otherwise(rest),
        list(enumerate(node.children))[-2::-1],
        descend(key, node.children[-1]),
    )


def shard_documents(docs: DataFrame, tree: Node, grown_tree: Node) -> DataFrame:
    """Place every row by its doc_id and number the rows of each shard from 0.

    Numbers follow (hash cell of the id, id, size, checksum): a shard is cut into 16**3
    cells, cells are counted first, and rows are numbered inside their cell, so that no
    task sorts a shard. Cases: a null doc_id is placed as empty text and numbered before
    others of its cell; a null text has size 1 and checksum 0; repeated rows are placed
    together and get a number each; an empty table gives no rows; extra columns are
    ignored. Returns doc_id, size, text_crc32, law, shard, slot, grown_shard.
    """
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    body = F.coalesce(F.col("text").cast("binary"), F.lit("").cast("binary"))
    cell = F.substring(F.md5(key.cast("binary")), 1, CELL_DIGITS)
    shard = descend(key, tree)
    placed = docs.select(
        "doc_id",
        (F.octet_length(body).cast("long") + 1).alias("size"),
        F.crc32(body).alias("text_crc32"),
        shard.cast("int").alias("shard"),
        cell.alias("cell"),
        descend(key, grown_tree).cast("int").alias("grown_shard"),
    )
    counts = docs.select(shard.cast("int").alias("shard"), cell.alias("cell")).groupBy("shard", "cell").count()
    before = Window.partitionBy("shard").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("shard", "cell", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("offset"))
    inside = Window.partitionBy("shard", "cell").orderBy("doc_id", "size", "text_crc32")
    return (
        placed.withColumn("place", F.row_number().over(inside) - 1)
        .join(offsets, ["shard", "cell"])
        .select(
            "doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard",
            (F.col("offset") + F.col("place")).cast("long").alias("slot"), "grown_shard",
        )
    )


def _sql_draw(node: Node) -> str:
    bits = f"('0x' || substr(md5(k || '/{node.name}'), 1, 13))::BIGINT"
    return f"-ln(({bits}::DOUBLE + 0.5) / {float(2**52)!r}) / {float(node.weight)!r}"


def sql_descend(node: Node) -> str:
    """The same descent as text for DuckDB."""
    if node.shard is not None:
        return str(node.shard)
    if len(node.children) == 1:
        return sql_descend(node.children[0])
    draws = ", ".join(f"{{'d': {_sql_draw(c)}, 'c': {i}}}" for i, c in enumerate(node.children))
    arms = " ".join(f"WHEN {i} THEN {sql_descend(c)}" for i, c in enumerate(node.children))
    return f"(CASE list_min([{draws}]).c {arms} END)"


def oracle(tree: Node, grown_tree: Node) -> str:
    """DuckDB text of ``shard_documents``; the checksum is folded byte by byte, its table built by rule."""
    return f"""
    WITH crc_table AS (
      SELECT list(list_reduce(range(8), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, n) ORDER BY n) t
      FROM range(256) r(n)
    ), base AS (
      SELECT doc_id, coalesce(doc_id::VARCHAR, '') k, coalesce(text, '') text FROM documents
    ), placed AS (
      SELECT doc_id, (strlen(text) + 1)::BIGINT size,
        xor(list_reduce(
          list_transform(range(strlen(text)), lambda i: ('0x' || substr(hex(encode(text)), 2 * i + 1, 2))::BIGINT),
          lambda c, b: xor(t[(xor(c, b) & 255) + 1], c >> 8), 4294967295::BIGINT), 4294967295::BIGINT) text_crc32,
        {sql_descend(tree)} shard, substr(md5(k), 1, {CELL_DIGITS}) cell, {sql_descend(grown_tree)} grown_shard
      FROM base, crc_table
    )
    SELECT doc_id, size, text_crc32, 'key' AS law, shard::INT AS shard,
      row_number() OVER (PARTITION BY shard ORDER BY cell, doc_id NULLS FIRST, size, text_crc32) - 1 AS slot,
      grown_shard::INT AS grown_shard
    FROM placed
    """
