"""Near-duplicate texts by a chosen-path set similarity join.

A text is its set of word shingles.  Independent trees branch the texts: at a
node, which knows one or two coordinates of a minhash signature, a text goes to
the child its minwise token there selects, so alike texts tend to stay
together and others part.  Nodes of few texts are compared exhaustively, larger
ones in random parts.

The trees come in waves.  After each one the texts found to be connected are one
component, and a node whose texts are all of one is done with, which is what becomes
of large groups of copies after the first wave.  Texts that look alike, though they
are not all similar, are a bunch: its pairs are compared once and for all, so that
later trees pass them over.  Large nodes that then still hold undecided pairs are
compared in pairs of blocks, but for blocks of one component or bunch; the texts of
very large ones go through more trees of greater depth.  So nothing is dropped.

To compare texts, short sketches find clusters of those that may be similar and are
not connected yet.  The whole texts of a cluster then meet in one group of bounded
size, which finds all links at once and puts out no more than connects components,
never pairs.

Texts with equal sets are one class from the start.  A link counts only when the
full sets of shingles confirm it.
"""

from __future__ import annotations

import hashlib
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gleanery.llm.common import Scratch, components
from gleanery.llm.words import mix, shingles, word_hashes

# Similar: 100 * shared shingles >= PERCENT * all shingles of both.
PERCENT = 80
# Trees, and more of them for each level beyond which fewer pairs stay together; what
# a pair of just that similarity meets in is then 0.9999 at every depth.
TREES, MORE_TREES, FULL_DEPTH, MAX_DEPTH = 16, 4, 6, 12
# Trees of a wave, the last size for all further ones; levels that one more phase adds.
WAVES, DEEPER = (2, 2, 4, 8), 2
# A second coordinate is taken at so many nodes of 256: 1 / 0.8 branches a node
# on average, which keeps texts of just that similarity together.
SECOND = 64
# Texts that are compared at once (half of what a pair of blocks has), and texts
# of a node from which it branches on.
LEAF, LARGE = 1024, 8192
# Bunches of fewer texts are compared anew in each tree.  Bunches are made in so many
# waves of a phase.
LEAST_BUNCH, BUNCHED = 16, 2
# Shingles of a block: what bounds it if texts are long.
LEAF_SHINGLES = 2_000_000
# Unlike texts share a minwise token about this often at most; nodes cannot be
# small before that has been halved often enough, so these levels are one step.
CHANCE = 0.04
COORDINATES = 64
# Of the low bytes of two signatures so many must agree before texts are compared:
# 5 standard deviations below what a similarity of 0.8 has.
LEAST_AGREEING = 35
MAX_BROADCAST = 200_000

# What is known of a class: its component, and its bunch ``done``, whose pairs are
# all decided.
STATE = ("class", "comp", "done")

_rng = np.random.default_rng(20240605)
_ADD = _rng.integers(0, 1 << 64, COORDINATES, dtype=np.uint64, endpoint=False)
_TIMES = _rng.integers(0, 1 << 63, COORDINATES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _blocks_of(texts, shingles):
    """Blocks that so many texts with so many shingles call for."""
    texts, shingles = (F.col(c) if isinstance(c, str) else c for c in (texts, shingles))
    return F.greatest(F.ceil(texts / LEAF), F.ceil(shingles / LEAF_SHINGLES)).cast("bigint")


def signature(grams: np.ndarray) -> np.ndarray:
    """16 bits of the least value of each of the random orders of the shingles."""
    least = np.full(COORDINATES, np.iinfo(np.uint64).max)
    for at in range(0, len(grams), 4096):
        part = (grams[at:at + 4096, None] ^ _ADD) * _TIMES
        least = np.minimum(least, part.min(axis=0))
    return (mix(least) & np.uint64(0xFFFF)).astype(np.uint16)


def _sets(k: int):
    """Size, mark and signature of the shingle set of every text."""
    def run(batches):
        for batch in batches:
            sizes, marks, signs, briefs = [], [], [], []
            for i, j, hashes, bounds in word_hashes(batch.column("text")):
                for x in range(j - i):
                    grams = np.unique(shingles(hashes[bounds[x]:bounds[x + 1]], k))
                    sizes.append(len(grams))
                    marks.append(hashlib.blake2b(grams.tobytes(), digest_size=16).digest()
                                 if len(grams) else None)
                    sign = signature(grams) if len(grams) else None
                    signs.append(sign.tobytes() if len(grams) else None)
                    briefs.append(sign.astype(np.uint8).tobytes() if len(grams) else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("text_mark"), pa.array(sizes, pa.int64()),
                 pa.array(marks, pa.binary()), pa.array(signs, pa.binary()),
                 pa.array(briefs, pa.binary())],
                ["doc_id", "text_mark", "n_shingles", "mark", "sign", "brief"])

    return run


def _signs(column, width=np.uint16) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), width).reshape(len(column), -1)


def branch(nodes: np.ndarray, signs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Children of (node, text) pairs: (index of the pair, child).  The node
    alone decides on the coordinates."""
    chosen = mix(nodes + np.uint64(0x9E3779B97F4A7C15))
    one = (chosen & np.uint64(63)).astype(np.int64)
    step = (chosen >> np.uint64(6)) % np.uint64(COORDINATES - 1) + np.uint64(1)
    two = ((one.astype(np.uint64) + step) % np.uint64(COORDINATES)).astype(np.int64)
    also = np.flatnonzero((chosen >> np.uint64(32)) & np.uint64(255) < np.uint64(SECOND))
    index = np.concatenate([np.arange(len(nodes)), also])
    at = np.concatenate([one, two[also]])
    token = signs[index, at].astype(np.uint64)
    return index, mix(chosen[index] ^ mix((at.astype(np.uint64) << np.uint64(16)) + token))


def trees_for(depth: int) -> int:
    return TREES + MORE_TREES * max(depth - FULL_DEPTH, 0)


def waves(first: int, trees: int) -> list[range]:
    """Numbers of the trees of each wave."""
    found, end = [], first + trees
    while first < end:
        size = WAVES[min(len(found), len(WAVES) - 1)]
        found.append(range(first, min(first + size, end)))
        first += size
    return found


def _roots(trees: range, depth: int):
    """Nodes at ``depth`` of some trees, from (class, comp, done, n_shingles, sign)."""
    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            signs = _signs(batch.column("sign"))
            owner = np.tile(np.arange(len(signs)), len(trees))
            nodes = mix(np.repeat(np.array(trees, np.uint64), len(signs)))
            for _ in range(depth):
                index, nodes = branch(nodes, signs[owner])
                owner = owner[index]
            owner = pa.array(owner)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c).take(owner) for c in (*STATE, "n_shingles")),
                 pa.array(nodes.view(np.int64))], [*STATE, "n_shingles", "node"])

    return run


def _alike(signs: np.ndarray) -> np.ndarray:
    """Which pairs of rows, the first before the second, agree enough."""
    near = np.empty((len(signs), len(signs)), bool)
    for low in range(0, len(signs), 32):
        part = signs[low:low + 32, None] == signs[None]
        near[low:low + 32] = part.sum(2, dtype=np.uint8) >= LEAST_AGREEING
    return np.triu(near, 1)


def _roots_of(near: np.ndarray) -> np.ndarray:
    """The least row that each row is connected with."""
    root = np.arange(len(near))
    a, b = np.nonzero(near)
    while True:
        low = root.copy()
        np.minimum.at(low, a, root[b])
        np.minimum.at(low, b, root[a])
        low = low[low]
        if (low == root).all():
            return root
        root = low


def _clusters(batches):
    """Of each row's list, the clusters of classes that may be similar and are
    not all connected yet, with what is known of them."""
    for batch in batches:
        column = batch.column("members")
        offsets = np.asarray(column.offsets)
        *state, brief = column.flatten().flatten()
        ids, comp, done = map(np.asarray, state)
        signs = np.frombuffer(b"".join(brief.to_pylist()), np.uint8).reshape(len(ids), -1)
        found = []
        for low, high in zip(offsets[:-1] - offsets[0], offsets[1:] - offsets[0]):
            near = _alike(signs[low:high]) & (comp[low:high, None] != comp[low:high]) \
                & (done[low:high, None] != done[low:high])
            if near.any():
                root = _roots_of(near)
                for r in np.flatnonzero(np.bincount(root, minlength=high - low) > 1):
                    own = np.flatnonzero(root == r) + low
                    found.append(own[np.argsort(ids[own])])
        kind = pa.list_(pa.int64())
        yield pa.RecordBatch.from_arrays(
            [pa.array([values[own] for own in found], kind) for values in (ids, comp, done)],
            list(STATE))


def similar(sets: list[np.ndarray]) -> np.ndarray:
    """Which pairs of sets of distinct hashes, the first before the second, are
    similar, by counting what they share, some thousand hashes at a time."""
    n, sizes = len(sets), np.array([len(s) for s in sets], np.int64)
    owner = np.repeat(np.arange(n), sizes)
    values, at, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    # What only one set has is shared by none.
    kept = times[at] > 1
    owner, at = owner[kept], (np.cumsum(times > 1) - 1)[at[kept]]
    order = np.argsort(at, kind="stable")
    owner, at = owner[order], at[order]
    shared = np.zeros((n, n))
    width = 4096
    for low in range(0, int(at[-1]) + 1 if len(at) else 0, width):
        a, b = np.searchsorted(at, [low, low + width])
        has = np.zeros((n, width), np.float32)
        has[owner[a:b], at[a:b] - low] = 1
        shared += has @ has.T
    return np.triu(100 * shared >= PERCENT * (sizes[:, None] + sizes - shared), 1)


def _confirmed(k: int):
    """The links of a cluster of (class, comp, text) between components, no more of
    them than connect these."""
    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        comps = table.column("comp").to_numpy()
        sets = []
        for _, _, hashes, bounds in word_hashes(table.column("text").combine_chunks()):
            sets += [np.unique(shingles(hashes[a:b], k)) for a, b in zip(bounds[:-1], bounds[1:])]
        names, at = np.unique(comps, return_inverse=True)
        linked = np.zeros((len(names), len(names)), bool)
        a, b = np.nonzero(similar(sets))
        linked[at[a], at[b]] = True
        np.fill_diagonal(linked, False)
        root = _roots_of(linked)
        joined = root != np.arange(len(root))
        return pa.table({"a": names[joined], "b": names[root[joined]]})

    return run


class Join:
    """One run of the join over (doc_id, text) rows."""

    def __init__(self, documents: DataFrame, k: int):
        self.k, self.spark = k, documents.sparkSession
        self.scratch = Scratch(self.spark, "near_dup")
        self.documents = documents.select(
            "doc_id", "text", F.md5(F.encode(F.coalesce("text", F.lit("")), "UTF-8"))
            .alias("text_mark"))
        kind = documents.schema["doc_id"].dataType.simpleString()
        sets = self.documents.mapInArrow(_sets(k), (
            f"doc_id {kind}, text_mark string, n_shingles bigint, mark binary, sign binary,"
            " brief binary"))
        self.rows = self.scratch.save(
            sets.withColumn("row", F.monotonically_increasing_id()), "rows")
        # Text and signature of any row stand for the class, of which the least
        # row is the name.
        self.classes = self.scratch.save(
            self.rows.where("mark is not null").groupBy("mark").agg(
                F.min("row").alias("class"), F.min("text_mark").alias("text_mark"),
                F.min("sign").alias("sign"), F.min("brief").alias("brief"),
                F.min("n_shingles").alias("n_shingles"),
                F.min("doc_id").alias("low")), "classes")
        #: The component of the classes that do not name theirs.
        self.root = None
        #: The bunch of a class, where it is in one.
        self.done = None
        self.saved = 0

    def _compare(self, rows: DataFrame, name: str) -> DataFrame | None:
        """Find the links among the ``rows`` (class, comp, done, node) of each node, and
        the components anew; the clusters, if there were any."""
        members = self._with(rows, "brief").groupBy("node").agg(F.collect_list(
            F.struct(*STATE, "brief")).alias("members")).select("members")
        # Equal clusters of different trees are one; clusters of one hash would be one
        # group, with no harm.
        clusters = members.mapInArrow(_clusters, ", ".join(f"{c} array<bigint>" for c in STATE)) \
            .distinct().select(F.xxhash64("class").alias("cluster"), F.explode(
                F.arrays_zip(*STATE)).alias("x")).select("cluster", "x.*")
        clusters = self._kept(clusters, f"{name}-clusters")
        used = self._kept(clusters.select("class").distinct().join(
            self.classes.select("class", "text_mark"), "class"), f"{name}-used")
        times = used.count()
        if not times:
            return None
        marks = used.select("text_mark")
        if times <= MAX_BROADCAST:
            marks = F.broadcast(marks)
        texts = self.documents.join(marks, "text_mark", "left_semi").groupBy("text_mark") \
            .agg(F.first("text").alias("text"))
        texts = self.scratch.save(used.join(texts, "text_mark").select("class", "text"),
                                  f"{name}-texts")
        found = clusters.join(texts, "class").groupBy("cluster").applyInArrow(
            _confirmed(self.k), "a bigint, b bigint")
        self._contract(found, name)
        self.scratch.drop(f"{name}-texts")
        return clusters

    def _contract(self, links: DataFrame, name: str) -> None:
        """Join the components that ``links`` (a, b) connect."""
        merged = components(self.scratch, links, f"{name}-components").select(
            F.col("node").alias("class"), F.col("root").alias("comp"))
        if self.root is None:
            self.root = merged
            return
        onto = merged.select(F.col("class").alias("comp"), F.col("comp").alias("onto"))
        moved = self.root.join(onto, "comp", "left").select(
            "class", F.coalesce("onto", "comp").alias("comp"))
        self.root = self._kept(moved.unionByName(merged), "root")

    def _kept(self, frame: DataFrame, name: str) -> DataFrame:
        self.saved += 1
        return self.scratch.save(frame, f"{name}{self.saved}")

    def _with_comp(self, rows: DataFrame) -> DataFrame:
        if self.root is None:
            return rows.withColumn("comp", F.col("class"))
        return rows.join(self.root, "class", "left").withColumn(
            "comp", F.coalesce("comp", "class"))

    def _with_state(self, rows: DataFrame) -> DataFrame:
        rows = self._with_comp(rows)
        # A class by itself is a bunch of its own.
        own = F.xxhash64(F.lit("done"), "class")
        if self.done is None:
            return rows.withColumn("done", own)
        return rows.join(self.done, "class", "left").withColumn("done", F.coalesce("done", own))

    def _bunch(self, clusters: DataFrame, name: str) -> None:
        """Make the bunches that ``clusters`` connect one, compare all their pairs, and
        note them.  Very large ones stay apart, for deeper trees."""
        low = clusters.groupBy("cluster").agg(F.min("done").alias("b"))
        links = clusters.select("cluster", F.col("done").alias("a")).join(low, "cluster")
        onto = components(self.scratch, links.select("a", "b"), f"{name}-bunches")
        known = clusters.select("class", "done").distinct()
        if self.done is not None:
            known = known.unionByName(self.done).distinct()
        members = known.join(onto, known["done"] == onto["node"], "left").select(
            "class", F.coalesce("root", "done").alias("node"))
        sizes = members.groupBy("node").agg(F.count(F.lit(1)).alias("size")).where(
            F.col("size").between(LEAST_BUNCH, LARGE))
        members = self.scratch.save(members.join(sizes.select("node"), "node"), f"{name}-members")
        stated = self._kept(self._with_state(self._with(members, "n_shingles")), "stated")
        rows = self._open(stated)
        if not rows.isEmpty():
            self._compare(self._blocks(rows), f"{name}-bunch")
        kept = members.select("class", F.col("node").alias("done"))
        if self.done is not None:
            kept = kept.unionByName(self.done.join(kept.select("class"), "class", "left_anti"))
        self.done = self._kept(kept, "done")
        self.scratch.drop(f"{name}-members")

    def _with(self, rows: DataFrame, column: str) -> DataFrame:
        return rows.join(self.classes.select("class", column), "class")

    def _open(self, rows: DataFrame) -> DataFrame:
        """The rows (class, comp, done, n_shingles, node) of nodes that have pairs to
        compare, with the number of texts and of blocks."""
        mixed = rows.groupBy("node").agg(
            F.count(F.lit(1)).alias("n"), F.sum("n_shingles").alias("shingles"),
            F.min("comp").alias("x"), F.max("comp").alias("y"),
            F.min("done").alias("u"), F.max("done").alias("v")).where("x < y and u < v").select(
            "node", "n", _blocks_of("n", "shingles").alias("blocks"))
        return rows.join(mixed, "node")

    def _wave(self, classes: DataFrame, trees: range, depth: int, bunch: bool) -> DataFrame | None:
        """Compare the texts of ``classes`` that meet in some trees, but for nodes too
        large for it; the classes of these, if there are any."""
        name, rest = f"trees{trees.start}", None
        nodes = self._with_state(classes).select(*STATE, "n_shingles", "sign").mapInArrow(
            _roots(trees, depth),
            "class bigint, comp bigint, done bigint, n_shingles bigint, node bigint")
        nodes = self.scratch.save(nodes, f"{name}-nodes")
        live = self.scratch.save(self._open(nodes), f"{name}-live")
        self.scratch.drop(f"{name}-nodes")
        if not live.isEmpty():
            # Random parts of a large node connect most of what belongs together.
            part = F.pmod(F.xxhash64("node", "class"), "blocks")
            clusters = self._compare(
                live.select(*STATE, F.xxhash64("node", part).alias("node")), name)
            if bunch and clusters is not None:
                self._bunch(clusters, name)
            large = live.where("blocks > 1").select("class", "n_shingles", "node")
            stated = self._kept(self._with_state(large), "stated")
            still = self.scratch.save(self._open(stated), f"{name}-still")
            if not still.isEmpty():
                limit = F.lit(True) if depth >= MAX_DEPTH else F.col("n") <= LARGE
                self._compare(self._blocks(still.where(limit)), f"{name}-blocks")
                rest = self._kept(still.where(~limit).select("class").distinct(), "rest")
            self.scratch.drop(f"{name}-still")
        self.scratch.drop(f"{name}-live")
        return rest

    def run(self) -> DataFrame:
        """Rows (class, comp) for all classes that are linked with others."""
        classes, total = self.classes, self.classes.count()
        depth, first = 1, 1
        while total * CHANCE ** depth > 1 and depth < MAX_DEPTH - 2:
            depth += 1
        while True:
            found = [self._wave(classes.select("class", "n_shingles", "sign"), trees, depth,
                                at < BUNCHED)
                     for at, trees in enumerate(waves(first, trees_for(depth)))]
            first += trees_for(depth)
            found = [rows for rows in found if rows is not None and not rows.isEmpty()]
            if not found:
                return self.root
            classes = self.classes.join(
                self._kept(reduce(DataFrame.unionByName, found).distinct(), "deeper"), "class")
            depth = min(depth + DEEPER, MAX_DEPTH)

    def _blocks(self, rows: DataFrame) -> DataFrame:
        """Open nodes as pairs of blocks, a node of its own for each pair.

        A large component or bunch has blocks of its own, and a pair of these is none;
        the texts of the others share blocks.
        """
        # Written, as they are used several times below.
        rows = self._kept(rows.select(*STATE, "n_shingles", "node"), "open")
        for kind in ("comp", "done"):
            counted = rows.groupBy("node", kind).agg(F.count(F.lit(1)).alias(f"{kind}_n"))
            rows = rows.join(counted, ["node", kind])
        rows = self._kept(rows.withColumn("group", F.when(
            F.col("done_n") > F.col("comp_n"), F.xxhash64(F.lit("done"), "done"))
            .otherwise(F.xxhash64(F.lit("comp"), "comp"))), "grouped")
        sizes = rows.groupBy("node", "group").agg(
            F.count(F.lit(1)).alias("own_n"), F.sum("n_shingles").alias("shingles"))
        sizes = sizes.withColumn("own_blocks", _blocks_of("own_n", "shingles"))
        before = Window.partitionBy("node").orderBy("group").rowsBetween(
            Window.unboundedPreceding, -1)
        large = sizes.where("own_blocks > 1").select(
            "node", "group", "own_blocks", F.coalesce(F.sum("own_blocks").over(before), F.lit(0))
            .alias("start"))
        small = F.col("own_blocks") == 1
        totals = sizes.groupBy("node").agg(
            F.sum(F.when(~small, F.col("own_blocks")).otherwise(0)).alias("large_blocks"),
            F.greatest(F.lit(1), _blocks_of(
                F.coalesce(F.sum(F.when(small, F.col("own_n"))), F.lit(0)),
                F.coalesce(F.sum(F.when(small, F.col("shingles"))), F.lit(0))))
            .alias("small_blocks"))
        placed = rows.join(totals, "node").join(large, ["node", "group"], "left")
        spot = F.xxhash64("class")
        own = F.when(F.col("start").isNull(),
                     F.col("large_blocks") + F.pmod(spot, F.col("small_blocks"))).otherwise(
            F.col("start") + F.pmod(spot, F.coalesce("own_blocks", F.lit(1))))
        others = F.explode(F.sequence(F.lit(0).cast("bigint"),
                                      F.col("large_blocks") + F.col("small_blocks") - 1))
        paired = placed.withColumn("own", own).withColumn("other", others).where(
            "start is null or other < start or other >= start + own_blocks")
        return paired.select(*STATE, F.xxhash64(
            "node", F.least("own", "other"), F.greatest("own", "other")).alias("node"))

    def labelled(self) -> DataFrame:
        """All rows with doc_id, text_mark, n_shingles, row and comp (null if the
        set is empty), and ``low``, the least doc_id of the component."""
        self.run()
        placed = self._with_comp(self.classes.select("class", "mark", "low"))
        low = placed.groupBy("comp").agg(F.min("low").alias("least"))
        named = self.scratch.save(placed.drop("low").join(low, "comp"), "named")
        return self.rows.select("doc_id", "text_mark", "n_shingles", "row", "mark").join(
            named.select("mark", "comp", F.col("least").alias("low")), "mark", "left")


def near_duplicates(documents: DataFrame, k: int = 5) -> DataFrame:
    """A row per row of ``documents``: doc_id, n_shingles, component_id, kept.

    Shingles are runs of ``k`` words, or the whole text if it has fewer.  A null
    or empty text has none and is linked with nothing.  Repeated rows are alike
    and so in one component.
    """
    rows = Join(documents, k).labelled()
    component = F.when(F.col("comp").isNull(), F.col("doc_id")).otherwise(F.col("low"))
    return rows.select("doc_id", "n_shingles", component.alias("component_id"),
                       F.col("doc_id").eqNullSafe(component).alias("kept"))


def without_near_duplicates(documents: DataFrame, k: int = 5) -> DataFrame:
    """``documents`` with one document of each component: that of the least
    doc_id, the first of them if it repeats.  Null and empty texts stay.  All
    columns stay as they are.
    """
    join = Join(documents, k)
    rows = join.labelled()
    best = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row"))
    winners = rows.where("comp is not null").groupBy("comp").agg(best.alias("b")) \
        .select(F.col("b.row").alias("row"), F.lit(True).alias("wins"))
    judged = rows.join(winners, "row", "left").where("comp is not null").groupBy(
        "doc_id", "text_mark").agg(F.max(F.coalesce("wins", F.lit(False))).alias("wins"),
                                   F.count(F.lit(1)).alias("n"))
    # Rows that are not alone and the winner: gone, or one of several.
    other = join.scratch.save(judged.where("not wins or n > 1").select(
        F.col("doc_id").alias("of"), F.col("text_mark").alias("with"), "wins"), "judged")

    def small(frame):
        return F.broadcast(frame) if frame.count() <= MAX_BROADCAST else frame

    marked = documents.select(
        F.struct(*[F.col(f"`{c}`") for c in documents.columns]).alias("row"),
        F.md5(F.encode(F.coalesce("text", F.lit("")), "UTF-8")).alias("text_mark"))
    same = F.col("row.doc_id").eqNullSafe(F.col("of")) & (F.col("text_mark") == F.col("with"))
    alone = marked.join(small(other), same, "left_anti")
    repeated = other.where("wins")
    if not repeated.isEmpty():
        again = marked.join(small(repeated), same, "left_semi").withColumn(
            "of", F.col("row.doc_id")).dropDuplicates(["of", "text_mark"]).drop("of")
        alone = alone.unionByName(again)
    return alone.select("row.*")
