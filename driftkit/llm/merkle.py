"""A Merkle manifest of a dataset: a tree per source, a tree over the sources, a proof per row.

Every level is a table of nodes, numbered within their tree. A node's siblings
have computed numbers: its own with another last digit, which is the exclusive or
of the digit for pairs and an offset of the slot otherwise. So every level is one
equijoin of the level with itself per sibling, on keys that are unique, and the
node in slot zero of each run emits the parent. All trees climb together; a tree
that has one node left waits with it, the subroot. Proofs come down the same
tables, from the root to the leaves, and each row folds its own up again.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.order_index import order_index, positioned, ranked
from ..session import discard
from .common import scratch

FANOUT = 3
LEAF_COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")


def digest(*inputs: Column) -> Column:
    """Lowercase hex sha256 of the inputs one after the other; nulls add nothing."""
    return F.sha2(F.concat_ws("", *inputs), 256)


def leaf_digest(columns: Sequence[Column]) -> Column:
    """The digest of a row: each value as its UTF-8 length, a colon and itself, or ``-`` if null."""
    parts = []
    for c in columns:
        value = c.cast("string")
        parts.append(F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-")))
    return digest(*parts)


def without_line_ends(df: DataFrame) -> dict[str, Column]:
    """A change to detect: rows whose doc_id has an even crc32 lose the line ends of their text; without a doc_id none is lost."""
    hit = F.crc32(df["doc_id"].cast("string").cast("binary")) % 2 == 0
    return {"text": F.when(hit, F.replace(df["text"], F.lit("\n"), F.lit(""))).otherwise(df["text"])}


@dataclass
class _Files:
    """The tables of one manifest, each written once to the shared folder and deleted together."""

    path: str
    n: int = 0

    def store(self, df: DataFrame) -> DataFrame:
        self.n += 1
        path = f"{self.path}/{self.n}"
        df.write.parquet(path)
        return df.sparkSession.read.schema(df.schema).parquet(path)


@dataclass(frozen=True)
class Manifest:
    """``rows`` with their proofs, the ``root`` (None without rows), and the folder that holds it all."""

    rows: DataFrame
    root: str | None
    path: str

    def release(self) -> None:
        """Deletes the files; ``rows`` is of no use from here on."""
        discard(self.rows.sparkSession, self.path)


def _sibling(slot: Column, offset: int, fanout: int) -> Column:
    """The slot ``offset`` further on in the run, round to its beginning."""
    return slot.bitwiseXOR(F.lit(offset)) if fanout == 2 else (slot + offset) % fanout


def _with_siblings(nodes: DataFrame, fanout: int) -> DataFrame:
    """``nodes`` and the digests to the ``left`` and the ``right`` of each in its run."""
    slot = F.col("node") % fanout
    out = nodes
    for k in range(1, fanout):
        at, found = f"at{k}", f"sibling{k}"
        others = nodes.select(F.col("tree").alias("its"), F.col("node").alias("number"), F.col("digest").alias(found))
        out = out.withColumn(at, F.col("node") - slot + _sibling(slot, k, fanout))
        out = out.join(others, (F.col("tree") == F.col("its")) & (F.col(at) == F.col("number")), "left").drop("its", "number")
    run = F.array_sort(F.array(*[F.struct(F.col(f"at{k}").alias("at"), F.col(f"sibling{k}").alias("d")) for k in range(1, fanout)]))

    def side(before: bool) -> Column:
        kept = F.filter(run, lambda s: s["at"] < F.col("node") if before else s["at"] > F.col("node"))
        return F.array_join(F.transform(kept, lambda s: s["d"]), "")

    return out.select(*nodes.columns, side(True).alias("left"), side(False).alias("right"))


def _climb(nodes: DataFrame, fanout: int, files: _Files) -> tuple[list[DataFrame], DataFrame]:
    """The levels of all trees, and the tops (``tree``, ``digest``, ``height``).

    ``nodes`` are the leaves: ``tree``, ``node`` (0, 1, ...), ``size`` of the tree,
    ``digest``. The number of levels is the height of the largest tree.
    """
    most = nodes.agg(F.max("size")).first()[0] or 0
    tops = [nodes.filter("size = 1").select("tree", "digest", F.lit(0).alias("height"))]
    levels, alive = [], nodes.filter("size > 1")
    while most > 1:
        levels.append(files.store(_with_siblings(alive, fanout)))
        most = -(-most // fanout)
        parents = levels[-1].filter(F.col("node") % fanout == 0).select(
            "tree", F.expr(f"node div {fanout}").alias("node"), F.expr(f"(size + {fanout - 1}) div {fanout}").alias("size"),
            digest(F.col("left"), F.col("digest"), F.col("right")).alias("digest"),
        )
        tops.append(parents.filter("size = 1").select("tree", "digest", F.lit(len(levels)).alias("height")))
        alive = parents.filter("size > 1")
    return levels, files.store(reduce(DataFrame.unionByName, tops))


def _descend(nodes: DataFrame, levels: list[DataFrame], above: DataFrame, fanout: int) -> DataFrame:
    """The leaves with the ``path`` of sibling digests, own level first, and what ``above`` says of their tree.

    ``above`` has ``tree``, ``height``, the ``path`` from the tree's top on, and columns to hand down.
    """
    handed = [c for c in above.columns if c not in ("tree", "height")]
    below = None
    for k in reversed(range(len(levels))):
        over = above.filter(F.col("height") == k + 1).select("tree", F.lit(0).cast("bigint").alias("node"), *handed)
        over = over if below is None else over.unionByName(below.select("tree", "node", *handed))
        over = over.withColumnsRenamed({"tree": "its", "node": "parent"})
        match = (F.col("tree") == F.col("its")) & (F.expr(f"node div {fanout}") == F.col("parent"))
        here = F.array(F.struct("left", "right"))
        below = levels[k].join(over, match).withColumn("path", F.concat(here, "path")).drop("its", "parent", "left", "right")
    alone = nodes.filter("size = 1").join(above.filter("height = 0").drop("height"), "tree")
    return alone if below is None else below.unionByName(alone)


def manifest(
    df: DataFrame, columns: Sequence[str] = LEAF_COLUMNS, key: str = "doc_id", source: str = "source",
    fanout: int = FANOUT, carry: Mapping[str, Column] | None = None,
) -> Manifest:
    """The trees over ``df``: per row ``key``, ``source``, ``node``, ``leaf``, ``subroot`` and its ``path``.

    Leaves ascend by ``key`` in their source, nulls first; rows that share a key
    go by their digest, so repeated rows are leaves of their own and the tree is
    the same whichever comes first. A null source is a source like others, and the
    first. Each entry of ``path`` has the digests to the ``left`` and the ``right``
    of the row's node in its run, up to the root; a lone node has none. Nulls in
    any column, empty and very long texts are values to digest. Only the named
    columns are read, whatever else the table holds; ``carry`` adds others, which
    are computed with the leaf. An empty table has no rows and no root.
    """
    if fanout < 2:
        raise ValueError("a run needs two nodes")
    files = _Files(scratch(df, "merkle"))
    carry = carry or {}
    leaves = files.store(df.select(
        df[source].alias("source"), df[key].alias("key"), leaf_digest([df[c] for c in columns]).alias("digest"),
        *[c.alias(f"carried_{n}") for n, c in carry.items()],
    ))
    # Ties in key and digest are equal rows in all that the digest covers.
    index = order_index(leaves, ["source", "key", "digest"], f"{files.path}/order")
    tree = F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit("-"))
    nodes = files.store(ranked(index, ["source"]).withColumn("tree", tree).withColumnRenamed("rank", "node").drop("source"))
    levels, tops = _climb(nodes, fanout, files)

    named = F.when(F.col("tree") != "-", F.substring("tree", 2, 2**31 - 1))
    subroots = order_index(tops.withColumn("source", named.cast(leaves.schema["source"].dataType)), ["source"], f"{files.path}/subroots")
    upper = positioned(subroots).select(
        F.lit("").alias("tree"), F.col("position").alias("node"), F.lit(subroots.total()).alias("size"), "digest",
        F.col("tree").alias("under"), F.col("height").alias("its_height"), "source",
    )
    upper_levels, top = _climb(upper, fanout, files)
    root = top.first()
    over = top.select("tree", "height", F.array().cast("array<struct<left:string,right:string>>").alias("path"))
    above = files.store(_descend(upper, upper_levels, over, fanout).select(
        F.col("under").alias("tree"), F.col("its_height").alias("height"), "source", F.col("digest").alias("subroot"), "path",
    ))
    rows = _descend(nodes, levels, above, fanout).select(
        F.col("key").alias(key), F.col("source").alias(source), "node", F.col("digest").alias("leaf"), "subroot", "path",
        *[F.col(f"carried_{n}").alias(n) for n in carry],
    )
    return Manifest(rows, root and root["digest"], files.path)


def proof_digest(path: Column | str = "path") -> Column:
    """One digest over all siblings of a path."""
    return digest(F.array_join(F.transform(path, lambda p: F.concat(p["left"], p["right"])), ""))


def folded(leaf: Column | str, path: Column | str = "path") -> Column:
    """The root that a leaf and a path of siblings lead to."""
    leaf = F.col(leaf) if isinstance(leaf, str) else leaf
    return F.aggregate(path, leaf, lambda own, p: digest(p["left"], own, p["right"]))


def verified_manifest(df: DataFrame, claimed: Mapping[str, Column]) -> DataFrame:
    """The manifest of ``df``, and whether the rows with ``claimed`` columns in place of theirs still lead to its root.

    ``doc_id``, ``leaf``, ``subroot``, ``root``, ``proof_sha256`` (all siblings,
    left to right, leaf to root), ``folded_root`` and ``verified``. The files of the
    trees are deleted once the result is stored.
    """
    tampered = leaf_digest([claimed.get(c, df[c]) for c in LEAF_COLUMNS])
    made = manifest(df, carry={"claimed": tampered})
    # Without rows there is no root; the column is a string all the same.
    root = F.lit(made.root).cast("string")
    out = made.rows.select(
        "doc_id", "leaf", "subroot", root.alias("root"), proof_digest().alias("proof_sha256"),
        folded("claimed").alias("folded_root"),
    ).withColumn("verified", F.col("folded_root") == F.col("root"))
    kept = scratch(df, "manifest")
    out.write.parquet(kept)
    made.release()
    return df.sparkSession.read.schema(out.schema).parquet(kept)
