"""A Merkle manifest of documents as a persistent, path-copying tree.

Leaves are digests of documents, in order of id within their source.  Runs of 16
nodes have a parent, up to the root of the source; the roots of the sources are
the leaves of a tree above them.  The work goes by aligned blocks of 16 ** 3
nodes: a block is three levels of a tree, worked out in one go, and the roots of
the blocks are the nodes of the next round.  So a source of any size is spread,
and a round has 4096 times fewer nodes than the one before.

A changed leaf makes a version of the tree that shares all nodes with the tree as
it was, but for its ancestors: those of its block are copied there, and the upper
ones by the path that the block got from the rounds above, so the versions of a
source stay spread over its blocks.
"""

from __future__ import annotations

from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanery.llm.common import Scratch
from gleanery.llm.spread import groups_of, ranked

# Children of a node, and levels of a block.
RUN, LEVELS = 16, 3
BLOCK = RUN ** LEVELS
# The tree above the sources.
TOP = -1
MAX_BROADCAST = 200_000
# Letters that tampering lowers.
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")

NODE = "tree bigint, index bigint, hash string, n bigint"
PATH = ("tree bigint, block bigint, left array<string>, right array<string>, place bigint,"
        " subroot string, root string")


def node_hash(children: str) -> str:
    return sha256(children.encode()).hexdigest()


def height(n: int) -> int:
    """Levels above ``n`` leaves."""
    levels = 0
    while n > 1:
        n, levels = -(-n // RUN), levels + 1
    return levels


def leaf_hash(text: Column) -> Column:
    """The leaf of a row with ``text``: each field with its length in bytes."""
    def field(value: Column) -> Column:
        return F.when(value.isNull(), "-").otherwise(
            F.concat(F.octet_length(value).cast("string"), F.lit(":"), value))

    values = [F.col(name).cast("string") for name in FIELDS[:-1]] + [text]
    return F.sha2(F.concat(*map(field, values)), 256)


def tampered_row() -> Column:
    return F.crc32(F.col("doc_id").cast("string")) % 5 == 0


def block_levels(hashes: list[str], n: int) -> list[list[str]]:
    """The nodes of a block of a tree of ``n`` nodes, level by level; the last
    level is the block's root."""
    levels = [hashes]
    for _ in range(min(LEVELS, height(n))):
        below = levels[-1]
        levels.append([node_hash("".join(below[i:i + RUN])) for i in range(0, len(below), RUN)])
    return levels


def siblings(levels: list[list[str]], at: int) -> tuple[list[str], list[str]]:
    """What stands before and behind the ancestors of leaf ``at`` (or the leaf) in
    their runs, level by level within the block."""
    left, right = [], []
    for nodes in levels[:-1]:
        low = at - at % RUN
        left.append("".join(nodes[low:at]))
        right.append("".join(nodes[at + 1:low + RUN]))
        at //= RUN
    return left, right


def folded(leaf: str, left: list[str], right: list[str]) -> list[str]:
    """A leaf and the ancestors it makes with these siblings."""
    path = [leaf]
    for before, behind in zip(left, right):
        path.append(node_hash(before + path[-1] + behind))
    return path


def _roots(batches):
    """Blocks to nodes of the next round."""
    for group in groups_of(batches, "tree", "block"):
        n = group.column("n")[0].as_py()
        root = block_levels(group.column("hash").to_pylist(), n)[-1][0]
        yield pa.RecordBatch.from_pydict({
            "tree": group.column("tree")[:1], "index": group.column("block")[:1],
            "hash": pa.array([root]), "n": pa.array([-(-n // BLOCK)], pa.int64())})


def _inner(depth: int):
    """The nodes of blocks that are no leaves of the block."""
    def run(batches):
        for group in groups_of(batches, "tree", "block"):
            levels = block_levels(group.column("hash").to_pylist(), group.column("n")[0].as_py())
            tree, block = group.column("tree")[0].as_py(), group.column("block")[0].as_py()
            rows = [(tree, depth + k, block * RUN ** (LEVELS - k) + i, node)
                    for k, nodes in enumerate(levels[1:], 1) for i, node in enumerate(nodes)]
            if rows:
                yield pa.RecordBatch.from_pydict(dict(zip(
                    ("tree", "level", "index", "hash"), map(list, zip(*rows)))))

    return run


def _with_paths(batches):
    """(rows, levels, path) of each block, whose first row is its path from above."""
    for group in groups_of(batches, "tree", "block"):
        path, rows = group.slice(0, 1).to_pylist()[0], group.slice(1)
        yield rows, block_levels(rows.column("hash").to_pylist(), path["n"]), path


def _paths(batches):
    """The paths of the nodes of a round, which are blocks of the round below."""
    for rows, levels, path in _with_paths(batches):
        left, right = zip(*[siblings(levels, i) for i in range(len(rows))])
        size = len(rows)
        yield pa.RecordBatch.from_arrays(
            [rows.column("tree"), rows.column("index"),
             pa.array([own + path["left"] for own in left], pa.list_(pa.string())),
             pa.array([own + path["right"] for own in right], pa.list_(pa.string())),
             pa.array([path["place"]] * size, pa.int64()),
             pa.array([path["subroot"]] * size, pa.string()),
             pa.array([path["root"]] * size, pa.string())],
            ["tree", "block", "left", "right", "place", "subroot", "root"])


def _proofs(batches):
    """Digests of the proofs of leaves, and what they and the leaf now lead to."""
    for rows, levels, path in _with_paths(batches):
        above = "".join(before + behind for before, behind in zip(path["left"], path["right"]))
        proofs, roots = [], []
        for at, (leaf, changed) in enumerate(zip(levels[0], rows.column("changed").to_pylist())):
            left, right = siblings(levels, at)
            own = "".join(before + behind for before, behind in zip(left, right))
            proofs.append(node_hash(own + above))
            roots.append(folded(changed or leaf, left + path["left"], right + path["right"])[-1])
        size = len(rows)
        yield pa.RecordBatch.from_arrays(
            [rows.column("doc_id"), rows.column("hash"),
             pa.array([path["subroot"]] * size, pa.string()),
             pa.array([path["root"]] * size, pa.string()),
             pa.array(proofs, pa.string()), pa.array(roots, pa.string()),
             pa.array([root == path["root"] for root in roots], pa.bool_())],
            ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"])


def _copies(batches):
    """The nodes that versions do not share: the changed leaf and its ancestors."""
    for rows, levels, path in _with_paths(batches):
        inner, up = len(levels) - 1, height(path["total"])
        found = []
        for at, changed in enumerate(rows.column("changed").to_pylist()):
            if changed is None:
                continue
            left, right = siblings(levels, at)
            nodes = folded(changed, left + path["left"], right + path["right"])
            doc_id, index = (rows.column(c)[at].as_py() for c in ("doc_id", "index"))
            tree = rows.column("tree")[at].as_py()
            found += [(doc_id, tree, k, index // RUN ** k, node)
                      for k, node in enumerate(nodes[:up + 1])]
            found += [(doc_id, TOP, k, path["place"] // RUN ** k, node)
                      for k, node in enumerate(nodes[up:])]
        columns = list(zip(*found)) if found else [[]] * 5
        yield pa.RecordBatch.from_arrays(
            [pa.array(columns[0], rows.schema.field("doc_id").type),
             pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.int64()),
             pa.array(columns[3], pa.int64()), pa.array(columns[4], pa.string())],
            ["version", "tree", "level", "index", "hash"])


def _dealt(rows: DataFrame) -> DataFrame:
    """Rows with their block, blocks whole and in order."""
    if "block" not in rows.columns:
        rows = rows.withColumn("block", F.expr(f"index div {BLOCK}"))
    return rows.repartition("tree", "block").sortWithinPartitions("tree", "block", "index")


class Forest:
    """Trees over the nodes (tree, index, hash, n), n the nodes of the tree."""

    def __init__(self, nodes: DataFrame, scratch: Scratch, label: str):
        self.scratch, self.label = scratch, label
        self.rounds = []
        tops = None
        while True:
            self.rounds.append(nodes)
            roots = scratch.save(_dealt(nodes.select("tree", "index", "hash", "n"))
                                 .mapInArrow(_roots, NODE), f"{label}{len(self.rounds)}")
            done = roots.where("n = 1").select(
                "tree", "hash", F.lit(len(self.rounds) - 1).alias("round"))
            tops = done if tops is None else tops.unionByName(done)
            nodes = roots.where("n > 1")
            if nodes.isEmpty():
                break
        #: Roots: tree, hash and the round that made it.
        self.tops = tops

    def inner_nodes(self) -> DataFrame:
        """All nodes but the leaves: tree, level, index, hash."""
        found = [_dealt(nodes.select("tree", "index", "hash", "n")).mapInArrow(
            _inner(LEVELS * at), "tree bigint, level bigint, index bigint, hash string")
            for at, nodes in enumerate(self.rounds)]
        rows = found[0]
        for more in found[1:]:
            rows = rows.unionByName(more)
        return rows

    def _meeting(self, nodes: DataFrame, above: DataFrame, *more: str) -> DataFrame:
        """Blocks of ``nodes``, each headed by its path; one more column for each
        of ``more`` that only nodes have."""
        sizes = nodes.select("tree", F.expr(f"index div {BLOCK}").alias("block"), "index",
                             "hash", "n", *more)
        heads = above.select("*", F.lit(-1).cast("bigint").alias("index"))
        first = sizes.where(F.col("index") % BLOCK == 0).select("tree", "block", "n")
        heads = heads.join(first, ["tree", "block"])
        return _dealt(sizes.unionByName(heads, allowMissingColumns=True))

    def paths(self, tops: DataFrame) -> DataFrame:
        """The paths of the blocks of the leaves, given those of the roots."""
        above = None
        for at in reversed(range(len(self.rounds))):
            ends = self.tops.where(F.col("round") == at).select("tree").join(tops, "tree")
            above = ends if above is None else above.unionByName(ends)
            if at:
                above = self.scratch.save(self._meeting(self.rounds[at], above).mapInArrow(
                    _paths, PATH), f"{self.label}-path{at}")
        return above


class Manifest:
    """The manifest of ``documents`` and the versions that changed texts make.

    Rows are leaves, ordered by doc_id (null first) within their source (null is one
    of its own); equal ids are ordered by leaf, and a repeated row is a leaf of its
    own.  ``altered`` says which rows change and ``text`` to what; null counts as no.
    Columns beyond the five of a leaf are not read.
    """

    def __init__(self, documents: DataFrame, altered: Column | None = None,
                 text: Column | None = None):
        spark = documents.sparkSession
        self.scratch = scratch = Scratch(spark, "merkle")
        altered = tampered_row() if altered is None else altered
        text = F.translate("text", UPPER, LOWER) if text is None else text
        self.kind = documents.schema["doc_id"].dataType.simpleString()
        rows = scratch.save(documents.select(*FIELDS).select(
            "source", "doc_id", leaf_hash(F.col("text")).alias("hash"),
            F.when(altered, leaf_hash(text)).alias("changed"),
            F.monotonically_increasing_id().alias("row")), "rows")
        order = ranked(rows, ["source", "doc_id", "hash", "row"], scratch, "order")
        sources = scratch.save(order.groupBy("source").agg(
            F.min("at").alias("tree"), F.count(F.lit(1)).alias("n")), "sources")
        self.sources = sources.count()
        few = F.broadcast(sources) if self.sources <= MAX_BROADCAST else sources
        joined = order.join(few.withColumnRenamed("source", "of"),
                            F.col("source").eqNullSafe(F.col("of")))
        self.leaves = scratch.save(joined.select(
            "tree", (F.col("at") - F.col("tree")).alias("index"), "hash", "changed", "doc_id",
            "n"), "leaves")
        scratch.drop("rows", "order")
        self.trees = Forest(self.leaves, scratch, "trees")
        placed = ranked(sources.select("tree", "source"), ["tree"], scratch, "places").select(
            "tree", F.col("at").alias("place"), "source")
        #: Sources: tree, place among the sources, source, subroot.
        self.subroots = scratch.save(placed.join(self.trees.tops.select(
            "tree", F.col("hash").alias("subroot")), "tree"), "subroots")
        self.top = Forest(self.subroots.select(
            F.lit(TOP).cast("bigint").alias("tree"), F.col("place").alias("index"),
            F.col("subroot").alias("hash"), F.lit(self.sources).cast("bigint").alias("n")),
            scratch, "top")
        self._above = None

    def nodes(self) -> DataFrame:
        """The tree as it was: tree, level, index, hash.  A source's tree has the
        least rank of its documents as its name, the one above them is ``TOP``."""
        leaves = [rounds.select("tree", F.lit(0).cast("bigint").alias("level"), "index", "hash")
                  for rounds in (self.trees.rounds[0], self.top.rounds[0])]
        return leaves[0].unionByName(self.trees.inner_nodes()).unionByName(
            leaves[1]).unionByName(self.top.inner_nodes())

    def above(self) -> DataFrame:
        """The path of every block of leaves, up to the root."""
        if self._above is not None:
            return self._above
        empty = F.array().cast("array<string>")
        start = self.top.tops.select("tree", F.lit(0).cast("bigint").alias("block"),
                                     empty.alias("left"), empty.alias("right"),
                                     F.lit(None).cast("bigint").alias("place"),
                                     F.lit(None).cast("string").alias("subroot"),
                                     F.col("hash").alias("root"))
        places = self.scratch.save(self.top._meeting(
            self.top.rounds[0], self.top.paths(start)).mapInArrow(_paths, PATH), "top-paths")
        own = self.subroots.select("tree", F.col("place").alias("at"),
                                   F.col("subroot").alias("own"))
        tops = places.join(own, F.col("block") == F.col("at")).select(
            own["tree"], F.lit(0).cast("bigint").alias("block"), "left", "right",
            F.col("at").alias("place"), F.col("own").alias("subroot"), "root")
        self._above = self.trees.paths(tops)
        return self._above

    def proofs(self) -> DataFrame:
        """A row per leaf: doc_id, leaf, subroot, root, proof_sha256 (the siblings up
        to the root), folded_root (what these and the leaf of the changed text, if it
        changed, lead to), verified."""
        return self.trees._meeting(self.leaves, self.above(), "doc_id", "changed").mapInArrow(
            _proofs, f"doc_id {self.kind}, leaf string, subroot string, root string,"
                     " proof_sha256 string, folded_root string, verified boolean")

    def versions(self) -> DataFrame:
        """The nodes that the version of each changed row (its doc_id) does not share
        with ``nodes``: version, tree, level, index, hash."""
        sizes = self.leaves.where("index = 0").select("tree", F.col("n").alias("total"))
        return self.trees._meeting(
            self.leaves, self.above().join(sizes, "tree"), "doc_id", "changed").mapInArrow(
            _copies, f"version {self.kind}, tree bigint, level bigint, index bigint, hash string")


def manifest_proofs(documents: DataFrame) -> DataFrame:
    """``Manifest.proofs`` of ``documents``, where every fifth row by the checksum of
    its id has its text's A-Z lower-cased."""
    return Manifest(documents).proofs()
