"""Tries of the prefixes that conversations share, as packed double arrays.

Conversations are put in the order of their first turns, and runs of them, next to
others with the same beginning, are shards; long ones are also cut into bands of
depth.  So a shard is bounded whatever is common.  It numbers its turns densely,
packs the trie of its paths into BASE and CHECK arrays and traverses it for the
nodes.  Nodes near the root are in many shards; a node's name is a hash of its
turns, so what the shards say of it is merged by that name.  What is summed over a
subtree goes bottom-up through the packed tries a second time.
"""

from __future__ import annotations

from functools import reduce
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleanery.llm.common import Scratch
from gleanery.llm.double_array import FREE, DoubleArray
from gleanery.llm.spread import groups_of, join_by_weight, ranked, running

# Conversations and depths of a shard.
SHARD, BAND = 1024, 64
# A conversation opens with fewer turns of another than this.
OPENINGS = 6
# Ids of a piece of a list of conversations.
PIECE = 4096
NAME = ["a", "b"]

TRIE = ("block bigint, band bigint, base array<bigint>, check array<bigint>, a array<bigint>,"
        " b array<bigint>, pa array<bigint>, pb array<bigint>, depth array<bigint>,"
        " chars array<bigint>, n array<bigint>, low array<bigint>, members array<bigint>,"
        " ends array<bigint>")
PER_STATE = ("check", "a", "b", "pa", "pb", "depth", "chars", "n", "low")


def openings(conv_id: Column) -> Column:
    """How many turns of the base conversation come first."""
    return F.crc32(conv_id.cast("string")) % OPENINGS


def base_of(conv_id: Column) -> Column:
    return conv_id - conv_id % 100


def _turn_digest() -> Column:
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    return F.unhex(F.md5(F.encode(F.concat(
        F.octet_length(role).cast("string"), F.lit(":"), role, text), "UTF-8")))


def _dense(*columns: np.ndarray) -> np.ndarray:
    """Equal rows of the columns get equal numbers, from 0 without gaps."""
    return np.unique(np.stack(columns, 1), axis=0, return_inverse=True)[1].reshape(-1)


def _packed(group: pa.RecordBatch) -> dict:
    """The trie of a shard: rows (conv_id, depth, ta, tb, chars, a, b, pa, pb), in
    order, the turns of a conversation without gaps."""
    conv, depth, chars, ta, tb, a, b, p, q = (
        group.column(c).to_numpy() for c in
        ("conv_id", "depth", "chars", "ta", "tb", "a", "b", "pa", "pb"))
    new = np.concatenate([[True], conv[1:] != conv[:-1]])
    first, row = np.flatnonzero(new), np.cumsum(new) - 1
    column = 1 + np.arange(len(conv)) - first[row]
    # The first label is the prefix that the paths of the shard begin at.
    labels = _dense(ta, tb) + 1
    starts = _dense(p[first], q[first]) + 1
    paths = np.zeros((len(first), int(column.max()) + 1), np.int64)
    paths[:, 0], paths[row, column] = starts, labels
    trie = DoubleArray(paths)
    size = len(trie.check)
    states = trie.states[row, column]
    found = {name: np.zeros(size, np.int64) for name in PER_STATE[1:]}
    for name, values in (("a", a), ("b", b), ("pa", p), ("pb", q), ("depth", depth),
                         ("chars", chars)):
        found[name][states] = values
    np.add.at(found["n"], states, 1)
    heads = trie.states[:, 0]
    found["a"][heads], found["b"][heads] = p[first], q[first]
    found["depth"][heads] = depth[first] - 1
    # The shard above counts the heads of a later band, and none does the root.
    np.add.at(found["n"], heads[depth[first] == 1], 1)
    found["low"][:] = np.iinfo(np.int64).max
    np.minimum.at(found["low"], trie.states[trie.states != FREE],
                  np.broadcast_to(conv[first][:, None], paths.shape)[trie.states != FREE])
    last = np.append(first[1:], len(conv)) - 1
    return {**found, "base": trie.base, "check": trie.check, "members": conv[first],
            "ends": states[last]}


def _tries(batches):
    for group in groups_of(batches, "block", "band"):
        packed = _packed(group)
        columns = {"block": group.column("block")[:1], "band": group.column("band")[:1]}
        for name, values in packed.items():
            columns[name] = pa.array([values], pa.list_(pa.int64()))
        names = [field.split()[0] for field in TRIE.split(", ")]
        yield pa.RecordBatch.from_arrays([columns[n] for n in names], names)


def subtree_sums(check: np.ndarray, depth: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Of values (a row per state), the sums over the states below and the state,
    deepest first, through CHECK."""
    sums = values.copy()
    used = np.flatnonzero(check != FREE)
    used = used[used != 0]
    for level in np.unique(depth[used])[::-1]:
        at = used[depth[used] == level]
        at = at[check[at] != 0]
        np.add.at(sums, check[at], sums[at])
    return sums


def _summed(batches):
    """Sums of the members' (weight, leaf) by node, from packed tries."""
    for batch in batches:
        for row in range(batch.num_rows):
            check, a, b, depth, members, ends = (
                batch.column(c)[row].values.to_numpy()
                for c in ("check", "a", "b", "depth", "members", "ends"))
            given = batch.column("given")[row].as_py() or []
            values = np.zeros((len(check), 2), np.int64)
            if given:
                conv, *weights = (np.array(x, np.int64) for x in zip(
                    *[(g["conv_id"], g["weight"], g["leaf"]) for g in given]))
                order = np.argsort(conv)
                place = np.minimum(np.searchsorted(conv[order], members), len(conv) - 1)
                known = conv[order][place] == members
                np.add.at(values, ends[known], np.stack(weights, 1)[order[place[known]]])
            sums = subtree_sums(check, depth, values)
            used = np.flatnonzero((check != FREE) & sums.any(axis=1))
            used = used[(used != 0) & ((check[used] != 0) | (depth[used] == 0))]
            yield pa.RecordBatch.from_arrays(
                [pa.array(x) for x in (a[used], b[used], sums[used, 0], sums[used, 1])],
                ["a", "b", "weight", "leaf"])


def _pieces(batches):
    """Of sorted (a, b, conv_id), pieces of the list of each (a, b): with ``first``,
    the least id in it."""
    for batch in batches:
        a, b, ids = (batch.column(c).to_numpy() for c in ("a", "b", "conv_id"))
        cut = np.flatnonzero((np.diff(a, prepend=0) != 0) | (np.diff(b, prepend=0) != 0)
                             | (np.arange(len(a)) % PIECE == 0))
        pieces = [",".join(map(str, part)) for part in np.split(ids, cut[1:])] if len(a) else []
        yield pa.RecordBatch.from_arrays(
            [pa.array(a[cut]), pa.array(b[cut]), pa.array(ids[cut]), pa.array(pieces, pa.string())],
            ["a", "b", "first", "piece"])


def _ends(batches):
    """The digest of each list from its sorted pieces, which pass one by one."""
    name, digest = None, None
    for batch in batches:
        found = []
        for a, b, piece in zip(*(batch.column(c).to_pylist() for c in ("a", "b", "piece"))):
            if (a, b) != name:
                if name is not None:
                    found.append((*name, digest.hexdigest()))
                name, digest = (a, b), sha256()
            else:
                digest.update(b",")
            digest.update(piece.encode())
        yield _digests(found)
    if name is not None:
        yield _digests([(*name, digest.hexdigest())])


def _digests(rows):
    a, b, digests = zip(*rows) if rows else ((), (), ())
    return pa.RecordBatch.from_arrays(
        [pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(digests, pa.string())],
        ["a", "b", "ends_sha256"])


class PrefixTrie:
    """The trie of all rebuilt conversations of (conv_id, turn, role, text) rows."""

    def __init__(self, conversations: DataFrame):
        self.scratch = Scratch(conversations.sparkSession, "trie")
        self.paths = self._paths(self._turns(conversations))
        self.convs, self.tries = self._packed_tries()
        self.nodes = self._merged()

    def _turns(self, conversations: DataFrame) -> DataFrame:
        """Turns with their place ``at`` among all, conversation by conversation."""
        rows = self.scratch.save(conversations.where("conv_id is not null").select(
            F.col("conv_id").cast("bigint").alias("conv_id"), "turn",
            _turn_digest().alias("digest"),
            F.char_length(F.coalesce("text", F.lit(""))).cast("bigint").alias("chars"),
            F.monotonically_increasing_id().alias("row")), "rows")
        return ranked(rows, ["conv_id", "turn", "digest", "row"], self.scratch, "turns")

    def _paths(self, turns: DataFrame) -> DataFrame:
        """The turns (ta, tb) of the rebuilt conversations with their depth, and the
        names of the node (a, b) and of its parent (pa, pb)."""
        own = turns.groupBy("conv_id").agg(F.min("at").alias("start"),
                                           F.count(F.lit(1)).alias("turns"))
        own = own.withColumn("h", openings(F.col("conv_id")))
        bases = own.select(F.col("conv_id").alias("base"), F.col("turns").alias("base_turns"))
        self.originals = originals = self.scratch.save(
            own.withColumn("base", base_of(F.col("conv_id"))).join(bases, "base", "left")
            .withColumn("got", F.least("h", F.coalesce("base_turns", F.lit(0)))), "originals")
        total = turns.count()
        placed = join_by_weight(
            turns.select("conv_id", "at", "digest", "chars"),
            originals.select("conv_id", "start", "turns", "h", "got"), ["conv_id"], "turns", total) \
            .withColumn("at", F.col("at") - F.col("start"))
        kept = placed.where("at >= h").select(
            "conv_id", (F.col("at") - F.col("h") + F.col("got") + 1).alias("depth"),
            "digest", "chars")
        # No more than six turns of a conversation open others, at most 199 of them.
        heads = placed.where(F.col("at") < OPENINGS - 1).select(
            F.col("conv_id").alias("base"), "at", "digest", "chars")
        opened = originals.where("got > 0").select("conv_id", "base", "got").join(heads, "base") \
            .where("at < got").select("conv_id", (F.col("at") + 1).alias("depth"), "digest", "chars")
        turn = F.struct("digest", "depth")
        rows = kept.unionByName(opened).withColumn("band", F.expr(f"(depth - 1) div {BAND}")) \
            .select("conv_id", "band", "depth", "chars", F.xxhash64("digest").alias("ta"),
                    F.xxhash64(F.reverse(F.hex("digest"))).alias("tb"),
                    F.xxhash64(turn).alias("a"), F.xxhash64(F.lit(1), turn).alias("b"))
        rows = self.scratch.save(rows, "steps")
        named = running(rows, "conv_id", "depth", "band", NAME, F.bit_xor, 0)
        return self.scratch.save(named.select(
            "conv_id", "band", "depth", "chars", "ta", "tb",
            F.col("a_before").alias("pa"), F.col("b_before").alias("pb"),
            F.col("a").bitwiseXOR(F.col("a_before")).alias("a"),
            F.col("b").bitwiseXOR(F.col("b_before")).alias("b")), "paths")

    def _packed_tries(self) -> tuple[DataFrame, DataFrame]:
        """Conversations with their end node and block, and the packed tries."""
        def at_depth(depth, column):
            return F.max(F.when(F.col("depth") == depth, F.col(column))).alias(f"{column}{depth}")

        last = F.max_by(F.struct("a", "b"), "depth")
        ends = self.paths.groupBy("conv_id").agg(
            F.count(F.lit(1)).alias("length"), last.alias("end"),
            *[at_depth(depth, "a") for depth in (1, 2, 3)])
        zero = F.lit(0).cast("bigint")
        convs = self.originals.select("conv_id").join(ends, "conv_id", "left").select(
            "conv_id", F.coalesce("length", zero).alias("length"),
            F.coalesce("end.a", zero).alias("a"), F.coalesce("end.b", zero).alias("b"),
            "a1", "a2", "a3")
        placed = ranked(convs, ["a1", "a2", "a3", "a", "b", "conv_id"], self.scratch, "order")
        convs = self.scratch.save(placed.select(
            "conv_id", "length", "a", "b", F.expr(f"at div {SHARD}").alias("block")), "convs")
        spread = join_by_weight(self.paths, convs.where("length > 0").select(
            "conv_id", "length", "block"), ["conv_id"], "length", self.paths.count())
        dealt = spread.drop("length").repartition("block", "band").sortWithinPartitions(
            "block", "band", "conv_id", "depth")
        tries = self.scratch.save(dealt.mapInArrow(_tries, TRIE), "tries")
        return convs, tries

    def _merged(self) -> DataFrame:
        """Nodes: name, parent's name, depth, chars, n, low."""
        states = self.tries.select(F.explode(F.arrays_zip(*PER_STATE)).alias("s")).select("s.*") \
            .where(f"check <> {FREE} and n > 0").drop("check")
        silent = self.convs.where("length = 0").groupBy("a", "b").agg(
            F.count(F.lit(1)).alias("n"), F.min("conv_id").alias("low")).select(
            "a", "b", *[F.lit(0).cast("bigint").alias(c) for c in ("pa", "pb", "depth", "chars")],
            "n", "low")
        return self.scratch.save(states.unionByName(silent).groupBy(*NAME).agg(
            *[F.max(c).alias(c) for c in ("pa", "pb", "depth", "chars")],
            F.sum("n").alias("n"), F.min("low").alias("low")), "nodes")

    def _sums(self, nodes: DataFrame) -> DataFrame:
        """By node, over its members: of what a conversation has as the least member
        of nodes, the weight of these, and whether a childless one is among them.
        As a conversation is the least member from some depth on to its end, the
        nodes of a subtree are those of its members, but for the ones above."""
        given = nodes.groupBy(F.col("low").alias("conv_id")).agg(
            F.sum("weight").alias("weight"),
            F.max((F.col("n_children") == 0).cast("bigint")).alias("leaf"))
        given = self.convs.join(given, "conv_id")
        lists = given.where("length > 0").groupBy("block").agg(
            F.collect_list(F.struct("conv_id", "weight", "leaf")).alias("given"))
        sums = self.tries.select("block", "check", "a", "b", "depth", "members", "ends") \
            .join(lists, "block").mapInArrow(
                _summed, "a bigint, b bigint, weight bigint, leaf bigint")
        silent = given.where("length = 0").select(*NAME, "weight", "leaf")
        return sums.unionByName(silent).groupBy(*NAME).agg(
            F.sum("weight").alias("below"), F.sum("leaf").alias("n_leaves"))

    def ends(self) -> DataFrame:
        """The digest of the ids of the conversations that end at a node.  A list of
        any length passes through its task in pieces; a digest has no other way."""
        order = [*NAME, "conv_id"]
        lists = self.convs.select(*order).repartitionByRange(*order).sortWithinPartitions(*order)
        pieces = lists.mapInArrow(_pieces, "a bigint, b bigint, first bigint, piece string")
        return pieces.repartition(*NAME).sortWithinPartitions(*NAME, "first").mapInArrow(
            _ends, "a bigint, b bigint, ends_sha256 string")

    def report(self) -> DataFrame:
        """A row per node: conv_id (least member), depth, parent_conv_id, n_convs,
        n_children, n_leaves, saved_tokens, ends_sha256."""
        zero = F.lit(0).cast("bigint")
        children = self.nodes.where("depth > 0").groupBy(
            F.col("pa").alias("a"), F.col("pb").alias("b")).agg(
            F.count(F.lit(1)).alias("n_children"))
        nodes = self.nodes.join(children, NAME, "left").select(
            *NAME, "pa", "pb", "depth", "n", "low", F.coalesce("n_children", zero)
            .alias("n_children"), ((F.col("n") - 1) * F.col("chars")).alias("weight"))
        nodes = self.scratch.save(
            nodes.withColumn("band", F.expr(f"depth div {BAND}")), "weighed")
        parents = nodes.where("n_children > 0").select(
            F.col("a").alias("pa"), F.col("b").alias("pb"), F.col("low").alias("parent_conv_id"),
            F.col("n_children").alias("times"))
        below = running(nodes, "low", "depth", "band", ["weight"], F.sum, 0)
        named = join_by_weight(below.where("depth > 0"), parents, ["pa", "pb"], "times",
                               nodes.count()).drop("times")
        top = below.where("depth = 0").withColumn("parent_conv_id", F.lit(None).cast("bigint"))
        none = sha256(b"").hexdigest()
        return named.unionByName(top).join(self._sums(nodes), NAME).join(
            self.ends(), NAME, "left").select(
            F.col("low").alias("conv_id"), "depth", "parent_conv_id", F.col("n").alias("n_convs"),
            "n_children", "n_leaves", (F.col("below") - F.col("weight_before")).alias("saved_tokens"),
            F.coalesce("ends_sha256", F.lit(none)).alias("ends_sha256"))


def prefix_nodes(conversations: DataFrame) -> DataFrame:
    """The nodes of the trie of rebuilt conversations (see ``PrefixTrie.report``).

    A conversation has its turns in order of ``turn`` (null first), equal numbers in
    order of a digest; a null role or text is empty.  Rows without a conv_id are of no
    conversation, so no member of any node.  A repeated row is a turn of its own.
    Conversation c is rebuilt from the first h turns of conversation c - c % 100, as
    far as there are any, and its own turns after its first h.  Without conversations
    there is no node.  Other columns are not read.
    """
    return PrefixTrie(conversations).report()
