"""Language model: a probabilistic suffix tree over the bytes of texts.

A text is written as its words, A-Z as a-z, one space between two words and one
end symbol behind the last.  The tree has as states the contexts (up to
``DEPTH`` bytes) after which the next symbol is distributed differently enough
from what it is after the context without its oldest byte: a divergence test on
counts over all training texts.  It compares the likelihood of the symbols under the
shorter context with that under any distribution, these weighed around it; that such
a ratio is above x has a chance of 1 / x at most, however few or uneven the counts
are, so the level is divided by the contexts that are tested.  The next symbol is scored in the longest
suffix of what precedes it that is a state, smoothed towards the shorter ones.

Also the probability of a text by its single words alone, for comparison.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanery.llm.common import Scratch
from gleanery.llm.spread import WITHIN
from gleanery.llm.words import SPACE, mix, pieces, raw_texts, word_hashes

DEPTH = 5
# A context must be seen so often.  Those that make up LEAST_SHARE of the training
# symbols, at most 1 / LEAST_SHARE of each length, are broadcast, the others joined.
LEAST_SHARE, LEAST_COUNT = 1e-5, 16
# Bits of the map of the other contexts every task has: 2 MB, at any size.
MAP_BITS = 24
# Divergence from the shorter context: nats per symbol, and the chance that any context
# of a length passes though its symbols come as they do after the shorter one.
LEAST_NATS, CHANCE = 0.01, 0.01
# How many symbols' weight the shorter context has in the test.
PRIOR = 4.0
# Counts of at most so many words go to every task; the others are joined.
MAX_FREQUENT = 2_000_000
# Distinct values a task holds before it hands on its counts.
HOLD = 4_000_000
# Texts whose symbols in rare states are handed on together: at most so many, and no
# more once so many symbols of theirs are held, each counted once per text.
BLOCK_TEXTS, BLOCK_SYMBOLS = 1 << 15, 2_000_000
# Keys of a block in a row.
BLOCK_KEYS = 1 << 13

END, PAD, BLANK = 10, 11, 32
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_LOWER[SPACE] = BLANK


def held_out():
    """Rows the model does not learn from."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2,
                      F.lit(False))


def canonical(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Texts as the model sees them, each after DEPTH pads, and where the end
    symbol of each is."""
    ends = np.repeat(bounds[1:], DEPTH + 1)
    tail = np.tile(np.array([END] + [PAD] * DEPTH, np.uint8), len(bounds) - 1)
    stream = np.insert(_LOWER[data], ends, tail)
    inside = (stream != BLANK) & (stream != END) & (stream != PAD)
    keep = stream != BLANK
    keep[1:] |= inside[:-1]
    stream = stream[keep]
    last = np.zeros(len(stream), bool)
    last[:-1] = (stream[:-1] == BLANK) & (stream[1:] == END)
    stream = np.concatenate([np.full(DEPTH, PAD, np.uint8), stream[~last]])
    return stream, np.flatnonzero(stream == END)


def packed(stream: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The symbols at the places ``at`` with the DEPTH symbols before each: the
    symbol in the lowest byte, its predecessor in the next, and so on."""
    total = stream[at].astype(np.uint64)
    for i in range(1, DEPTH + 1):
        total |= stream[at - i].astype(np.uint64) << np.uint64(8 * i)
    return total


class Counter:
    """Counts of 64-bit values, handed on in sorted runs when there are many."""

    def __init__(self):
        self.parts, self.held = [], 0

    def add(self, values: np.ndarray):
        """Takes values in; gives back (values, counts) if there are too many."""
        found = np.unique(values, return_counts=True)
        self.parts.append(found)
        self.held += len(found[0])
        if self.held > HOLD:
            self._merge()
            if self.held > HOLD // 2:
                return self.flush()
        return None

    def _merge(self):
        keys = np.concatenate([k for k, _ in self.parts])
        counts = np.concatenate([n for _, n in self.parts])
        order = np.argsort(keys, kind="stable")
        keys, counts = keys[order], counts[order]
        first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        self.parts = [(keys[first], np.add.reduceat(counts, first))]
        self.held = len(first)

    def flush(self):
        if not self.parts:
            return None
        self._merge()
        out, self.parts, self.held = self.parts[0], [], 0
        return out


def _count(batches):
    """(kind, key, n): 0 for words, 1 for symbols with their context."""
    words, grams = Counter(), Counter()

    def batches_of(kind, found):
        if found is not None:
            for at in range(0, len(found[0]), 1 << 16):
                keys = found[0][at:at + (1 << 16)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(keys), kind, np.int32)), pa.array(keys.view(np.int64)),
                     pa.array(found[1][at:at + (1 << 16)])], ["kind", "key", "n"])

    for batch in batches:
        column = batch.column("text")
        for i, j, hashes, bounds in word_hashes(column):
            yield from batches_of(0, words.add(hashes))
        data, offsets = raw_texts(column)
        for i, j in pieces(offsets):
            low, high = int(offsets[i]), int(offsets[j])
            stream, _ = canonical(data[low:high], offsets[i:j + 1] - low)
            real = np.flatnonzero(stream != PAD)
            for at in range(0, len(real), 1 << 21):
                yield from batches_of(1, grams.add(packed(stream, real[at:at + (1 << 21)])))
    yield from batches_of(0, words.flush())
    yield from batches_of(1, grams.flush())


class Table:
    """Keys to positions, by open addressing in arrays."""

    def __init__(self, keys: np.ndarray):
        self.bits = max(int(2 * len(keys)).bit_length(), 4)
        self.keys = np.zeros(1 << self.bits, np.uint64)
        self.index = np.full(1 << self.bits, -1, np.int32)
        todo = np.arange(len(keys))
        slot = self._slot(keys)
        while len(todo):
            free = self.index[slot] < 0
            at, first = np.unique(slot[free], return_index=True)
            put = todo[free][first]
            self.keys[at], self.index[at] = keys[put], put
            left = self.index[slot] != todo
            todo, slot = todo[left], (slot[left] + 1) & ((1 << self.bits) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (mix(keys) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Position of each key, or -1."""
        slot = self._slot(keys)
        found = self.index[slot]
        open_ = np.flatnonzero((found >= 0) & (self.keys[slot] != keys))
        slot = slot[open_]
        while len(open_):
            slot = (slot + 1) & ((1 << self.bits) - 1)
            found[open_] = self.index[slot]
            wrong = (found[open_] >= 0) & (self.keys[slot] != keys[open_])
            open_, slot = open_[wrong], slot[wrong]
        return found


def _mask(k: int) -> np.uint64:
    return np.uint64((1 << (8 * k)) - 1)


class Tree:
    """States and smoothed next-symbol distributions.

    ``levels[k]``: (context, symbol, n) of the states of length k, as arrays of
    packed keys (context, then symbol in the lowest byte) and counts.  In a
    state the share (n + d * shorter) / (total + d) goes to a symbol, d being
    the number of different symbols seen there and ``shorter`` what the state
    without the oldest byte gives it; the empty state is smoothed evenly.
    """

    def __init__(self, levels: list[tuple[np.ndarray, np.ndarray]]):
        self.root = np.full(256, 1.0)
        self.states, self.pairs = [], []
        keys, counts = levels[0]
        self.root[keys.astype(np.int64)] += counts
        self.root = self.root / self.root.sum()
        below = None
        for k, (keys, counts) in enumerate(levels[1:], 1):
            order = np.argsort(keys)
            keys, counts = keys[order], counts[order].astype(float)
            context, inverse = np.unique(keys >> np.uint64(8), return_inverse=True)
            total = np.bincount(inverse, counts, len(context))
            kinds = np.bincount(inverse, minlength=len(context))
            shorter = self._given(keys & _mask(k), k - 1, below)
            share = (counts + kinds[inverse] * shorter) / (total + kinds)[inverse]
            self.states.append((Table(context), np.log10(kinds / (total + kinds))
                                if len(context) else np.empty(0)))
            self.pairs.append((Table(keys), np.log10(share)))
            below = (keys, share)

    def _given(self, keys, k, below):
        if k == 0:
            return self.root[keys.astype(np.int64)]
        at = np.searchsorted(below[0], keys)
        return below[1][at]

    def log10(self, keys: np.ndarray, lengths: np.ndarray | None = None) -> np.ndarray:
        """Log probability of the symbols of packed keys; ``lengths`` takes in how
        long the longest state of each is."""
        n = len(keys)
        active = np.arange(n)
        where = []
        for k in range(1, DEPTH + 1):
            found = self.states[k - 1][0].find((keys[active] >> np.uint64(8)) & _mask(k))
            good = found >= 0
            active, found = active[good], found[good]
            if lengths is not None:
                lengths[active] = k
            where.append((active, found))
            if not len(active):
                break
        out = np.zeros(n)
        open_ = np.ones(n, bool)
        for k in range(len(where), 0, -1):
            active, found = where[k - 1]
            mine = open_[active]
            active, found = active[mine], found[mine]
            table, share = self.pairs[k - 1]
            at = table.find(keys[active] & _mask(k + 1))
            hit = at >= 0
            out[active[hit]] += share[at[hit]]
            open_[active[hit]] = False
            out[active[~hit]] += self.states[k - 1][1][found[~hit]]
        rest = np.flatnonzero(open_)
        out[rest] += np.log10(self.root)[(keys[rest] & np.uint64(255)).astype(np.int64)]
        return out


def _log_gamma(x: Column) -> Column:
    """By Stirling's series, six steps up; exact to 2e-7."""
    up = x + 6
    steps = F.log(x * (x + 1) * (x + 2)) + F.log((x + 3) * (x + 4) * (x + 5))
    return (up - 0.5) * F.log(up) - up + 0.5 * math.log(2 * math.pi) + 1 / (12 * up) \
        - 1 / (360 * up * up * up) - steps


def divergence(n: Column, total: Column, share: Column) -> Column:
    """Log of the likelihood ratio of one context, an aggregate over its symbols:
    ``n`` of ``total``, and the ``share`` that the shorter context gives them."""
    own = _log_gamma(PRIOR * share + n) - _log_gamma(PRIOR * share) - n * F.log(share)
    every = F.max(total)
    return F.sum(own) + math.lgamma(PRIOR) - _log_gamma(every + PRIOR)


def fit_states(grams: DataFrame, scratch: Scratch) -> tuple[list[DataFrame], int]:
    """``grams``: (key, n) of symbols with DEPTH symbols before them.  A table of
    the states of each length (key, n, context, total, kinds), and the total from
    which a state is a frequent one.

    Counting, tests and closure under suffixes are joins of tables of contexts.
    """
    total = grams.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    counts = []
    for k in range(DEPTH + 1):
        mask = F.lit((1 << (8 * (k + 1))) - 1)
        level = grams.select(F.col("key").bitwiseAND(mask).alias("key"), "n")
        level = level.groupBy("key").agg(F.sum("n").alias("n")).withColumn(
            "context", F.shiftrightunsigned("key", 8))
        if k:
            seen = level.groupBy("context").agg(F.sum("n").alias("total"),
                                                F.count(F.lit(1)).alias("kinds"))
            level = level.join(seen.where(F.col("total") >= LEAST_COUNT), "context")
        else:
            level = level.withColumn("total", F.lit(total)).withColumn("kinds", F.lit(256))
        counts.append(scratch.save(level, f"level{k}"))

    kept = [None] * (DEPTH + 1)
    for k in range(DEPTH, 0, -1):
        shorter = counts[k - 1].select(
            F.col("key").alias("suffix"), F.col("n").alias("m"), F.col("total").alias("all"))
        # A frequent context has frequent suffixes, so each has its partner.
        paired = counts[k].withColumn("suffix", F.col("key").bitwiseAND(
            F.lit((1 << (8 * k)) - 1))).join(shorter, "suffix")
        gain = F.sum(F.col("n") * F.log((F.col("n") / F.col("total"))
                                        / (F.col("m") / F.col("all"))))
        tested = scratch.save(paired.groupBy("context").agg(
            gain.alias("gain"), F.max("total").alias("total"), divergence(
                F.col("n"), F.col("total"), F.col("m") / F.col("all")).alias("evidence")),
            f"tested{k}")
        level = math.log(max(tested.count(), 1) / CHANCE)
        states = tested.where((F.col("gain") >= LEAST_NATS * F.col("total"))
                              & (F.col("evidence") >= level)).select("context")
        if k < DEPTH:
            states = states.unionByName(kept[k + 1].select(
                F.col("context").bitwiseAND(F.lit((1 << (8 * k)) - 1)).alias("context"))).distinct()
        kept[k] = scratch.save(states, f"states{k}")
        scratch.drop(f"tested{k}")

    levels = [counts[0]]
    for k in range(1, DEPTH + 1):
        levels.append(scratch.save(counts[k].join(kept[k], "context"), f"pairs{k}"))
        scratch.drop(f"level{k}", f"states{k}")
    return levels, max(LEAST_COUNT, math.ceil(LEAST_SHARE * total))


def frequent_tree(levels: list[DataFrame], often: int) -> Tree:
    """The frequent states; what ends a frequent state is one as well."""
    found = []
    for k, level in enumerate(levels):
        rows = level.where(F.lit(k == 0) | (F.col("total") >= often)).select("key", "n").toArrow()
        found.append((rows.column("key").to_numpy().view(np.uint64),
                      rows.column("n").to_numpy()))
    return Tree(found)


def fit_tree(grams: DataFrame, scratch: Scratch) -> Tree:
    return frequent_tree(*fit_states(grams, scratch))


def _places(contexts: np.ndarray, lengths) -> np.ndarray:
    """The bit of the map that contexts of so many bytes set."""
    return mix(contexts | (np.asarray(lengths).astype(np.uint64) << np.uint64(56))) \
        >> np.uint64(64 - MAP_BITS)


def _map_bits(batches):
    for batch in batches:
        bit = _places(batch.column("context").to_numpy().view(np.uint64),
                      batch.column("length").to_numpy()).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(bit)], ["bit"])


def rare_map(levels: list[DataFrame], often: int) -> np.ndarray:
    """A bit map that has all states that are not frequent."""
    rare = None
    for k, level in enumerate(levels[1:], 1):
        part = level.where(F.col("total") < often).select("context", F.lit(k).alias("length"))
        rare = part if rare is None else rare.unionByName(part)
    # At most 2^18 rows, each 64 bits of the map.
    rows = rare.distinct().mapInArrow(_map_bits, "bit bigint").groupBy(
        F.shiftright("bit", 6).alias("word")).agg(
        F.expr("bit_or(shiftleft(1L, cast(bit & 63 as int)))").alias("bits")).toArrow()
    words = np.zeros(1 << (MAP_BITS - 6), np.int64)
    words[rows.column("word").to_numpy()] = rows.column("bits").to_numpy()
    return words.view(np.uint8)


def joined_log10(keys: DataFrame, levels: list[DataFrame], scratch: Scratch) -> DataFrame:
    """(key, log10) for distinct packed ``keys``: their log probability as
    ``Tree.log10`` has it, with all states, by joins from length to length."""
    def low(k):
        return F.lit((1 << (8 * k)) - 1)

    total = levels[0].agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    shares = levels[0].select(F.col("key").alias("pair"),
                              ((F.col("n") + 1) / F.lit(total + 256.0)).alias("share"))
    out = keys.withColumn("pair", F.col("key").bitwiseAND(low(1))).join(shares, "pair", "left") \
        .select("key", F.log10(F.coalesce("share", F.lit(1 / (total + 256.0)))).alias("log10"))
    for k in range(1, DEPTH + 1):
        shorter = shares.withColumnsRenamed({"pair": "suffix", "share": "shorter"})
        shares = scratch.save(
            levels[k].withColumn("suffix", F.col("key").bitwiseAND(low(k))).join(shorter, "suffix")
            .select(F.col("key").alias("pair"), ((F.col("n") + F.col("kinds") * F.col("shorter"))
                    / (F.col("total") + F.col("kinds"))).alias("share")), f"shares{k}")
        states = levels[k].groupBy("context").agg(F.max(F.log10(
            F.col("kinds") / (F.col("total") + F.col("kinds")))).alias("miss"))
        out = out.withColumn("pair", F.col("key").bitwiseAND(low(k + 1))) \
            .withColumn("context", F.shiftrightunsigned("pair", 8)) \
            .join(states, "context", "left").join(shares, "pair", "left") \
            .select("key", F.coalesce(F.log10("share"), F.col("miss") + F.col("log10"), "log10")
                    .alias("log10"))
    values = scratch.save(out, "values")
    scratch.drop(*(f"shares{k}" for k in range(1, DEPTH + 1)))
    return values


class Frequent:
    """Counts of the most frequent words, for every task."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray):
        self.table, self.worth = Table(keys), np.log10(counts + 1.0)

    def split(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(worth, known): log10(count + 1) of frequent words, 0 of others."""
        at = self.table.find(hashes)
        known = at >= 0
        worth = np.zeros(len(hashes))
        worth[known] = self.worth[at[known]]
        return worth, known


class Block:
    """How often the texts of a run, numbered from ``first``, have symbols (packed keys)
    whose state is not in the tree."""

    def __init__(self, first: int):
        self.first, self.texts, self.held, self.parts = first, 0, 0, []

    def add(self, kinds: np.ndarray, which: np.ndarray, texts: np.ndarray):
        """Takes in the symbols ``kinds[which]`` of ``texts``."""
        pairs, times = np.unique(which * BLOCK_TEXTS + texts, return_counts=True)
        self.parts.append((kinds[pairs // BLOCK_TEXTS],
                           (pairs % BLOCK_TEXTS).astype(np.int16), times.astype(np.int32)))
        self.held += len(pairs)

    def rows(self):
        """Runs of (keys, counts, places, times): the distinct keys, how many pairs each
        has, and of each pair which text it is and how often the key is in it."""
        if not self.held:
            return
        keys, places, times = (np.concatenate(c) for c in zip(*self.parts))
        order = np.lexsort((places, keys))
        keys, places, times = keys[order], places[order], times[order]
        starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        bounds = np.append(starts, len(keys))
        for i in range(0, len(starts), BLOCK_KEYS):
            own = bounds[i:i + BLOCK_KEYS + 1]
            span = slice(own[0], own[-1])
            yield (keys[own[:-1]].view(np.int64), np.diff(own).astype(np.int32), places[span],
                   times[span])


def block_sums(symbols: pa.Table, values: pa.Table) -> pa.Table:
    """(row, late): what the symbols of a block's rows add to the scores of its texts;
    ``values`` has (key, log10) for each of its keys."""
    keys, counts, places, times = (
        symbols.column(name).combine_chunks().flatten().to_numpy()
        for name in ("keys", "counts", "places", "times"))
    known = values.column("key").to_numpy()
    order = np.argsort(known)
    worth = values.column("log10").to_numpy()[order[np.searchsorted(known, keys, sorter=order)]]
    sums = np.bincount(places, np.repeat(worth, counts) * times)
    found = np.unique(places).astype(np.int64)
    return pa.table({"row": found + symbols.column("block")[0].as_py(), "late": sums[found]})


def _score(tree, frequent, rare_states):
    masks = np.array([_mask(k) for k in range(DEPTH + 1)])

    def lists_of(rows, kind):
        return pa.ListArray.from_arrays(
            pa.array(np.cumsum([0, *map(len, rows)]), pa.int32()),
            pa.array(np.concatenate([np.empty(0, np.int64), *rows]), kind))

    def rows_of(n, kind, **columns):
        """``n`` rows, null in other columns."""
        kinds = {"doc_id": kind, "held_out": pa.bool_(), "words": pa.int64(),
                 "known": pa.int64(), "base": pa.float64(), "score": pa.float64(),
                 "rare": pa.list_(pa.int64()), "row": pa.int64(), "block": pa.int64(),
                 "keys": pa.list_(pa.int64()), "counts": pa.list_(pa.int32()),
                 "places": pa.list_(pa.int16()), "times": pa.list_(pa.int32())}
        return pa.RecordBatch.from_arrays(
            [columns[c] if c in columns else pa.nulls(n, t) for c, t in kinds.items()],
            list(kinds))

    def block_rows(block, kind):
        for keys, counts, places, times in block.rows():
            yield rows_of(1, kind, block=pa.array([block.first]), keys=lists_of([keys], pa.int64()),
                          counts=lists_of([counts], pa.int32()),
                          places=lists_of([places], pa.int16()),
                          times=lists_of([times], pa.int32()))

    def run(batches):
        t, f, bitmap = tree.value, frequent.value, rare_states.value
        block, doc_kind = Block(0), pa.null()

        def is_open(keys, lengths):
            """Whether the state may go on as one that is not in the tree."""
            longer = np.minimum(lengths + 1, DEPTH)
            bit = _places((keys >> np.uint64(8)) & masks[longer], longer)
            on = bitmap[bit >> np.uint64(3)] >> (bit & np.uint64(7)).astype(np.uint8) & 1
            return (on > 0) & (lengths < DEPTH)

        for batch in (b.slice(at, BLOCK_TEXTS) for b in batches
                      for at in range(0, b.num_rows, BLOCK_TEXTS)):
            column = batch.column("text")
            n, doc_kind = batch.num_rows, batch.column("doc_id").type
            if block.texts + n > BLOCK_TEXTS or block.held > BLOCK_SYMBOLS:
                yield from block_rows(block, doc_kind)
                block = Block(block.first + block.texts)
            tokens, known = np.zeros(n, np.int64), np.zeros(n, np.int64)
            base, score = np.zeros(n), np.zeros(n)
            rare = [None] * n
            for i, j, hashes, bounds in word_hashes(column):
                worth, common = f.split(hashes)
                tokens[i:j] = np.diff(bounds)
                for out, values in ((base, worth), (known, common)):
                    sums = np.concatenate([[0], np.cumsum(values)])
                    out[i:j] = sums[bounds[1:]] - sums[bounds[:-1]]
                for x in range(j - i):
                    span = slice(bounds[x], bounds[x + 1])
                    rare[i + x] = hashes[span][~common[span]].view(np.int64)
            data, offsets = raw_texts(column)
            for i, j in pieces(offsets):
                low, high = int(offsets[i]), int(offsets[j])
                stream, ends = canonical(data[low:high], offsets[i:j + 1] - low)
                sums = np.zeros(j - i)
                real = np.flatnonzero(stream != PAD)
                at_end = np.searchsorted(real, ends, "right")
                for at in range(0, len(real), 1 << 18):
                    part = real[at:at + (1 << 18)]
                    # Most symbols come again with what is before them: looked up once.
                    kinds, which = np.unique(packed(stream, part), return_inverse=True)
                    longest = np.zeros(len(kinds), np.int64)
                    own = t.log10(kinds, longest)[which]
                    later = is_open(kinds, longest)[which]
                    logs = np.concatenate([[0.0], np.cumsum(np.where(later, 0.0, own))])
                    cut = np.clip(at_end - at, 0, len(part))
                    later = np.flatnonzero(later)
                    block.add(kinds, which[later], block.texts + i + np.searchsorted(
                        at_end, at + later, "right"))
                    sums += np.diff(np.concatenate([[0.0], logs[cut]]))
                score[i:j] = sums
            yield rows_of(
                n, doc_kind, doc_id=batch.column("doc_id"), held_out=batch.column("held_out"),
                words=pa.array(tokens), known=pa.array(known), base=pa.array(base),
                score=pa.array(score), rare=lists_of(rare, pa.int64()),
                row=pa.array(np.arange(n) + block.first + block.texts))
            block.texts += n
        yield from block_rows(block, doc_kind)

    return run


def score_documents(documents: DataFrame) -> DataFrame:
    """Per row of ``documents``: doc_id, held_out, n_tokens, n_known,
    train_tokens, base_score, score.

    A null or empty text is the end symbol alone.  Rows without an id are
    learned from.  With nothing to learn from, all symbols are equally likely.
    """
    spark = documents.sparkSession
    scratch = Scratch(spark, "suffix_tree")
    rows = documents.select("doc_id", "text", held_out().alias("held_out"))
    learned = rows.where("not held_out").select("text")
    counted = learned.mapInArrow(_count, "kind int, key bigint, n bigint") \
        .groupBy("kind", "key").agg(F.sum("n").alias("n"))
    counted = scratch.save(counted, "counts")
    grams = counted.where("kind = 1").select("key", "n")
    texts = learned.count()
    # The end of a text is a token too.
    words = scratch.save(counted.where("kind = 0").select("key", "n"), "words")
    seen = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    total, kinds = seen[0] + texts, seen[1] + (1 if texts else 0)
    often = max(2, math.ceil(total / MAX_FREQUENT))
    common = words.where(F.col("n") >= often).toArrow()
    frequent = Frequent(common.column("key").to_numpy().view(np.uint64),
                        common.column("n").to_numpy())
    levels, least = fit_states(grams, scratch)
    scratch.drop("counts")
    tree = frequent_tree(levels, least)
    kind = documents.schema["doc_id"].dataType.simpleString()
    scored = rows.mapInArrow(
        _score(spark.sparkContext.broadcast(tree), spark.sparkContext.broadcast(frequent),
               spark.sparkContext.broadcast(rare_map(levels, least))), (
            f"doc_id {kind}, held_out boolean, words bigint, known bigint, base double,"
            " score double, rare array<bigint>, row bigint, block bigint, keys array<bigint>,"
            " counts array<int>, places array<smallint>, times array<int>"))
    # Numbered within a task so far.
    above = F.shiftleft(F.spark_partition_id().cast("bigint"), WITHIN)
    scored = scratch.save(scored.withColumns(
        {"row": F.col("row") + above, "block": F.col("block") + above}), "scored")
    blocks = scored.where("block is not null").select("block", "keys", "counts", "places", "times")
    scored = scored.where("block is null").drop("block", "keys", "counts", "places", "times")
    rest = scored.select("row", F.explode("rare").alias("key")).join(
        words.where(F.col("n") < often), "key") \
        .groupBy("row").agg(F.sum(F.log10(F.col("n") + 1.0)).alias("more"),
                            F.count(F.lit(1)).alias("also"))
    # A block asks once for each of its symbols, and gets the answers as one group.
    asked = blocks.select(F.col("block").alias("asker"), F.explode("keys").alias("key"))
    values = joined_log10(asked.select("key").distinct(), levels, scratch)
    scratch.drop(*(f"pairs{k}" for k in range(1, DEPTH + 1)))
    answers = asked.join(values, "key")
    late = blocks.groupBy("block").cogroup(answers.groupBy("asker")).applyInArrow(
        block_sums, "row bigint, late double")
    n_tokens = F.col("words") + 1
    ends = math.log10(texts + 1)
    return scored.drop("rare").join(rest, "row", "left") \
        .join(late, "row", "left").select(
        "doc_id", "held_out", n_tokens.alias("n_tokens"),
        (F.col("known") + F.coalesce("also", F.lit(0)) + (1 if texts else 0)).cast("bigint")
        .alias("n_known"), F.lit(total).cast("bigint").alias("train_tokens"),
        (F.col("base") + F.coalesce("more", F.lit(0.0)) + F.lit(ends)
         - n_tokens * F.lit(math.log10(total + kinds + 1))).alias("base_score"),
        (F.col("score") + F.coalesce("late", F.lit(0.0))).alias("score"))
