"""Merkle manifest of a table by a nested-struct rollup, with a proof for each row.

Rows of a tree are ranked by a range partitioning. The digits of a rank to the base
``FAN`` say where a row hangs in its tree. Ranks are cut into blocks of ``FAN ** LEVELS``
rows, one shuffle brings a block together, and its digit columns are grouped away one
after the other inside that partitioning, lowest first: each step nests the children
of a node, in order, as an array of structs in their parent. A block ends as one row,
its hash and everything below it. The hashes of blocks are the rows of the next stage,
which is made in the same way, until each tree is one block; the roots of the trees
are the rows of one tree more.

Proofs come down the same stages without joins: what lies above a block meets the
block's row in one grouping, a transform over the nested structs lists the siblings
on both sides at each level, and an explode gives one row per child. Nothing larger
than a block is ever one row, and no tree is in one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from termindex.llm.common import read
from termindex.operators.slices import ranked
from termindex.session import settled

FAN = 3
LEVELS = 6  # 729 rows a block


def digest(*parts: Column) -> Column:
    """Lowercase hex sha256 of the parts, concatenated."""
    return F.sha2(F.concat(*parts), 256)


def field(column: Column) -> Column:
    """A value as its UTF-8 byte count, a colon and itself; a null as a dash."""
    value = column.cast("string")
    return F.coalesce(F.concat(F.octet_length(value), F.lit(":"), value), F.lit("-"))


def _joined(kids: Column) -> Column:
    return F.concat_ws("", F.transform(kids, lambda kid: kid["node"]["hash"]))


def nested(nodes: DataFrame, fan: int = FAN, levels: int = LEVELS) -> DataFrame:
    """(tree, rank, hash, load) to one row per block: (tree, block, height, node).

    ``height`` is how many levels of the block are hashed: all, but in a tree of one block only those
    with more than one node. The levels above pass their only node on.
    """
    rank, span = F.col("rank"), fan**levels
    digits = [f"d{k}" for k in range(levels)]
    rows = nodes.select(
        "tree", F.expr(f"rank div {span}").alias("block"),
        *[(F.expr(f"rank div {fan**k}") % fan).cast("int").alias(d) for k, d in enumerate(digits)],
        F.struct("hash", "load").alias("node"), rank.alias("rank")).repartition("tree", "block")
    own = Window.partitionBy("tree", "block")  # at most ``span`` rows
    alone = sum((F.count(F.lit(1)).over(own) > fan**k).cast("int") for k in range(levels))
    rows = rows.withColumn("height", F.when(F.col("block") > 0, F.lit(levels)).otherwise(alone)).drop("rank")
    for k in range(levels):
        kids = F.sort_array(F.collect_list(F.struct(F.col(digits[k]).alias("digit"), "node")))
        rows = rows.groupBy("tree", "block", "height", *digits[k + 1:]).agg(kids.alias("kids"))
        own_hash = F.when(F.col("height") > k, F.sha2(_joined(F.col("kids")), 256)).otherwise(F.col("kids")[0]["node"]["hash"])
        rows = rows.select("tree", "block", "height", *digits[k + 1:], F.struct(own_hash.alias("hash"), "kids").alias("node"))
    return rows


def climb(nodes: DataFrame, fan: int = FAN, levels: int = LEVELS) -> list[DataFrame]:
    """The stages of blocks above the nodes; in the last one each tree is one block."""
    stages = []
    while True:
        blocks = settled(nested(nodes, fan, levels), "blocks")
        stages.append(blocks)
        if not blocks.agg(F.max("block")).first()[0]:
            return stages
        nodes = blocks.select("tree", F.col("block").alias("rank"), F.col("node.hash").alias("hash"),
                              F.struct("block").alias("load"))


def _below(node: Column, level: int, height: Column, fan: int) -> Column:
    """(load, hash, path) of each lowest node; a path lists the siblings before and after, from the lowest level up."""
    if level == 0:
        return F.array(F.struct(node["load"].alias("load"), node["hash"].alias("hash"),
                                F.array().cast("array<struct<before:string,after:string>>").alias("path")))
    kids = node["kids"]

    def of(kid: Column, k: Column) -> Column:
        here = F.array(F.struct(_joined(F.slice(kids, F.lit(1), k)).alias("before"),
                                _joined(F.slice(kids, k + 2, F.lit(fan))).alias("after")))
        step = F.when(height >= level, here).otherwise(F.array().cast("array<struct<before:string,after:string>>"))
        return F.transform(_below(kid["node"], level - 1, height, fan), lambda it: F.struct(
            it["load"].alias("load"), it["hash"].alias("hash"), F.concat(it["path"], step).alias("path")))

    return F.flatten(F.transform(kids, of))


def descend(stages: Sequence[DataFrame], above: DataFrame, fan: int = FAN, levels: int = LEVELS) -> DataFrame:
    """(tree, load, hash, above) of the lowest nodes.

    ``above`` has (tree, block, above) for the blocks of the last stage; its ``path`` is lengthened on the way.
    """
    for depth, blocks in enumerate(reversed(stages)):
        none = F.lit(None)
        met = (
            blocks.withColumn("above", none.cast(above.schema["above"].dataType))
            .unionByName(above.select("tree", "block", "above", none.cast("int").alias("height"),
                                      none.cast(blocks.schema["node"].dataType).alias("node")))
            .groupBy("tree", "block").agg(*[F.first(c, ignorenulls=True).alias(c) for c in ("height", "node", "above")])
        )
        rows = met.select("tree", "above", F.explode(_below(F.col("node"), levels, F.col("height"), fan)).alias("it")).select(
            "tree", "it.load", "it.hash",
            F.col("above").withField("path", F.concat("it.path", "above.path")).alias("above"))
        if depth + 1 < len(stages):
            above = rows.select("tree", F.col("load.block").alias("block"), "above")
    return rows


def proofs(leaves: DataFrame, order: Sequence[str], fan: int = FAN, levels: int = LEVELS) -> DataFrame:
    """(load, hash, subroot, root, path) of each leaf of (tree, hash, load, and the columns of ``order``).

    ``tree`` is a string that is not null. Leaves stand in the order given; nulls come first, and leaves that
    agree in all of it in the order of their hashes. Equal leaves may change places: nothing depends on it. The
    roots stand in the order of their trees. ``leaves`` should be a stored table.
    """
    made = ranked(leaves.withColumn("_u", F.monotonically_increasing_id()), ["tree"], [*order, "hash", "_u"], "rank")
    trees = climb(made.select("tree", F.col("rank") - 1, "hash", "load").toDF("tree", "rank", "hash", "load"), fan, levels)
    roots = trees[-1].select("tree", F.col("node.hash").alias("hash"))
    tops = climb(ranked(roots, [], ["tree"], "rank").select(
        F.lit("").alias("tree"), (F.col("rank") - 1).alias("rank"), "hash", F.struct("tree").alias("load")), fan, levels)
    path = F.array().cast("array<struct<before:string,after:string>>")
    root = tops[-1].select("tree", "block", F.struct(
        F.col("node.hash").alias("root"), F.lit(None).cast("string").alias("subroot"), path.alias("path")).alias("above"))
    subroots = descend(tops, root, fan, levels).select(
        F.col("load.tree").alias("tree"), F.lit(0).cast("bigint").alias("block"),
        F.col("above").withField("subroot", F.col("hash")).alias("above"))
    return descend(trees, subroots, fan, levels).select("load", "hash", "above.subroot", "above.root", "above.path")


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its siblings give."""
    return F.aggregate(path, leaf, lambda held, step: F.sha2(F.concat(step["before"], held, step["after"]), 256))


def proof_digest(path: Column) -> Column:
    """One digest of all siblings, level by level, left to right."""
    return F.sha2(F.concat_ws("", F.transform(path, lambda step: F.concat(step["before"], step["after"]))), 256)


FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def manifest(docs: DataFrame, altered: dict[str, Column] | None = None, fields: Sequence[str] = FIELDS,
             group: str = "source", order: str = "doc_id", fan: int = FAN, levels: int = LEVELS) -> DataFrame:
    """(order column, leaf, subroot, root, path, folded_root, verified) of each row of a table.

    A row's leaf is the digest of its ``fields``; groups are the trees, in the order of their names, a null one
    first. ``altered`` replaces fields when rows are checked against their proofs: ``verified`` says whether the
    leaf made from the replaced fields still gives the root. Rows without an order value stand first in their
    group; rows that repeat one stand in the order of their leaves. An empty table gives none. Other columns are not read.
    """
    now = {f: F.col(f"`{f}`") for f in fields}
    leaf = digest(*[field(c) for c in now.values()])
    again = digest(*[field(c) for c in (now | (altered or {})).values()]) if altered else leaf
    leaves = settled(docs.select(
        F.coalesce(F.concat(F.lit("1"), F.col(f"`{group}`").cast("string")), F.lit("0")).alias("tree"),
        F.col(f"`{order}`").alias("key"), leaf.alias("hash"), again.alias("again")), "leaves")
    found = proofs(leaves.select("tree", "key", "hash", F.struct(
        "key", F.nullif("again", F.col("hash")).alias("again")).alias("load")), ["key"], fan, levels)
    return found.select(
        F.col("load.key").alias(order), F.col("hash").alias("leaf"), "subroot", "root", "path",
        folded(F.coalesce("load.again", "hash"), F.col("path")).alias("folded_root")).withColumn(
            "verified", F.col("folded_root") == F.col("root"))


def op12_merkle_manifest(spark: SparkSession, sf: str) -> DataFrame:
    docs = read(spark, sf, "documents")
    picked = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 2 == 0, F.lit(False))
    altered = F.when(picked, F.translate("text", "\n", "")).otherwise(F.col("text"))
    return manifest(docs, {"text": altered}).select(
        "doc_id", "leaf", "subroot", "root", proof_digest(F.col("path")).alias("proof_sha256"), "folded_root", "verified")


def _sql(levels: int = 14, tops: int = 9) -> str:
    """The same by plain levels and self-joins: up to 3 ** levels rows a source, 3 ** tops sources."""
    step = "xor(c, CASE WHEN i % 8 = 0 THEN ascii(substr(CAST(doc_id AS varchar), (i // 8 + 1)::int, 1))::bigint ELSE 0::bigint END)"
    crc = (f"xor(list_reduce(range(8 * strlen(CAST(doc_id AS varchar))), lambda c, i: xor({step} >> 1, "
           f"({step} & 1) * 3988292384::bigint), 4294967295::bigint), 4294967295::bigint)")
    part = lambda c: f"coalesce(strlen(CAST({c} AS varchar)) || ':' || CAST({c} AS varchar), '-')"
    head = " || ".join(part(c) for c in FIELDS[:-1])
    out = [f"""leaf AS (SELECT doc_id, coalesce('1' || source, '0') AS tree, sha256({head} || {part('text')}) AS h,
        sha256({head} || {part("(CASE WHEN " + crc + " % 2 = 0 THEN replace(text, chr(10), '') ELSE text END)")}) AS again
      FROM documents)""",
           """a0 AS (SELECT tree, h, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, h) - 1 AS i,
        count(*) OVER (PARTITION BY tree) AS n FROM leaf)""",
           """w0 AS (SELECT doc_id, tree, h AS leaf, again AS held, '' AS proof,
        row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, h) - 1 AS i FROM leaf)"""]

    def level(nodes: str, walk: str, k: int, last: str) -> None:
        out.append(f"""{nodes}{k + 1} AS (SELECT tree, i // 3 AS i, max(n) AS n,
        CASE WHEN max(n) > {3**k} THEN sha256(string_agg(h, '' ORDER BY i)) ELSE max(h) END AS h FROM {nodes}{k} GROUP BY tree, i // 3)""")
        out.append(f"""s{nodes}{k} AS (SELECT a.tree, a.i, coalesce(string_agg(b.h, '' ORDER BY b.i) FILTER (b.i < a.i), '') AS l,
        coalesce(string_agg(b.h, '' ORDER BY b.i) FILTER (b.i > a.i), '') AS r
      FROM {nodes}{k} a JOIN {nodes}{k} b ON a.tree = b.tree AND a.i // 3 = b.i // 3 WHERE a.n > {3**k} GROUP BY a.tree, a.i)""")
        out.append(f"""{walk}{k + 1} AS (SELECT w.* EXCLUDE (held, proof), proof || coalesce(l || r, '') AS proof,
        CASE WHEN l IS NULL THEN held ELSE sha256(l || held || r) END AS held
      FROM {walk}{k} w LEFT JOIN s{nodes}{k} s ON s.tree = w.tree AND s.i = w.{last} // {3**k})""")

    for k in range(levels):
        level("a", "w", k, "i")
    out.append(f"""b0 AS (SELECT '' AS tree, h, row_number() OVER (ORDER BY tree) - 1 AS i, count(*) OVER () AS n, tree AS name FROM a{levels})""")
    out.append(f"""v0 AS (SELECT w.doc_id, '' AS tree, w.leaf, w.proof, w.held, b.i AS j, b.h AS subroot
      FROM w{levels} w JOIN b0 b ON b.name = w.tree)""")
    for k in range(tops):
        level("b", "v", k, "j")
    return "WITH " + ",\n".join(out) + f"""
    SELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, held AS folded_root, held = root AS verified
    FROM v{tops}, (SELECT h AS root FROM b{tops})"""


SQL = _sql()
