"""Benchmark passages in training texts, found by spaced seeds.

A seed is a mask over consecutive words; only the words under a 1 are hashed,
so a substitution under a 0 leaves the hash as it is.  Hashes that texts and
benchmark items share give alignments, and each alignment is compared word by
word: a stretch in which at least ``IDENTITY`` of the words agree is an overlap if it
is long enough, whatever words it begins and ends with.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanery.llm.common import Scratch
from gleanery.llm.words import mix, word_hashes

# Six words each.  However the substitutions lie that ``IDENTITY`` allows, one of
# the masks has a place between them in every stretch of LEAST_WORDS or more.
MASKS = ("1101100101", "1110010011", "1011001101", "1100001000111", "11101000011")
# An overlap has so many words, or all of an item that has fewer; items of one or two
# words are no evidence and are not looked for.
LEAST_WORDS, LEAST_ITEM = 13, 3
IDENTITY = 0.8
# Bits of the map of benchmark hashes every task has: 2 MB, at any size.
MAP_BITS = 24
# Broadcast up to so many marks of texts, or seeds, of 100 bytes each at most, and item
# texts of so many bytes.
MAX_BROADCAST, MAX_BROADCAST_BYTES = 200_000, 32 << 20
# Items that one copy of a text is compared with.
ITEMS = 256


# The same for items that have to be there whole, by their words.  However the
# substitutions lie, a mask of the item has a place between them.
SHORT = {
    3: ("111",),
    4: ("1111",),
    5: ("1111", "11101", "11011", "10111"),
    6: ("1111", "11011"),
    7: ("11111", "111011", "110111"),
    8: ("111111", "1111011", "1101111"),
    9: ("1111011", "1101111"),
    10: ("1111011", "11001111", "110110011", "11110101", "10101111"),
    11: ("1110111", "111001011", "1011111", "111111"),
    12: ("11101011", "101100111", "111111"),
}
ALL_MASKS = tuple(dict.fromkeys(MASKS + sum(SHORT.values(), ())))


def masks_for(words: int) -> tuple[str, ...]:
    """The masks an item of so many words is looked for with."""
    return MASKS if words >= LEAST_WORDS else SHORT.get(words, ())


def seed_hashes(hashes: np.ndarray, mask: str) -> np.ndarray:
    """The hash of every place of ``mask`` in a text of word hashes."""
    n = len(hashes) - len(mask) + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    total = np.full(n, ALL_MASKS.index(mask) + 1, np.uint64)
    for i, bit in enumerate(mask):
        if bit == "1":
            total *= np.uint64(0x9E3779B97F4A7C15)
            total += hashes[i:n + i]
    return mix(total)


def _bits(seed):
    """The two bits of the map a seed sets."""
    low = (1 << MAP_BITS) - 1
    return F.shiftrightunsigned(seed, 64 - MAP_BITS), \
        F.shiftrightunsigned(seed, 8).bitwiseAND(F.lit(low))


def _item_seeds(batches):
    for batch in batches:
        mark = batch.column("item")
        for i, j, hashes, bounds in word_hashes(batch.column("text")):
            for k in range(i, j):
                own = hashes[bounds[k - i]:bounds[k - i + 1]]
                for mask in masks_for(len(own)):
                    seeds = seed_hashes(own, mask)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(seeds.view(np.int64)),
                         pa.array([mark[k].as_py()] * len(seeds), pa.string()),
                         pa.array(np.arange(len(seeds), dtype=np.int32)),
                         pa.array(np.full(len(seeds), ALL_MASKS.index(mask), np.int32))],
                        ["seed", "item", "off", "mask"])


def _hits(shared, used):
    """Places of texts whose hash is on the map."""
    def run(batches):
        bitmap = shared.value
        for batch in batches:
            marks = batch.column("mark")
            for i, j, hashes, bounds in word_hashes(batch.column("text")):
                seeds, places = [], []
                for mask in used:
                    own = seed_hashes(hashes, mask)
                    for shift in (np.uint64(64 - MAP_BITS), np.uint64(8)):
                        if shift == 8:
                            bit = (own[at] >> shift) & np.uint64((1 << MAP_BITS) - 1)
                            at = at[bitmap[bit >> np.uint64(3)] >> (bit & np.uint64(7)).astype(
                                np.uint8) & 1 > 0]
                        else:
                            bit = own >> shift
                            at = np.flatnonzero(bitmap[bit >> np.uint64(3)] >> (
                                bit & np.uint64(7)).astype(np.uint8) & 1)
                    # Not across the end of a text.
                    text = np.searchsorted(bounds, at, "right") - 1
                    inside = at + len(mask) <= bounds[np.minimum(text + 1, len(bounds) - 1)]
                    seeds.append(own[at[inside]])
                    places.append(at[inside])
                seed, place = np.concatenate(seeds), np.concatenate(places)
                text = np.searchsorted(bounds, place, "right") - 1
                if len(seed):
                    yield pa.RecordBatch.from_arrays(
                        [marks.take(pa.array(text + i)), pa.array(seed.view(np.int64)),
                         pa.array((place - bounds[text]).astype(np.int32))],
                        ["mark", "seed", "place"])

    return run


def best_stretch(equal: np.ndarray, identity: float = IDENTITY) -> tuple[int, int, int]:
    """(start, end, agreeing) of the stretch with the most words agreeing beyond
    ``identity``: the greatest sum of +1 for a match and, for a mismatch, what
    makes the sum 0 at ``identity``."""
    worth = np.where(equal, 1.0, -identity / (1 - identity) + 1e-6)
    sums = np.concatenate([[0.0], np.cumsum(worth)])
    low = np.minimum.accumulate(sums)
    end = int(np.argmax(sums - low))
    start = int(np.flatnonzero(sums[:end + 1] == low[end])[-1])
    return start, end, int(equal[start:end].sum())


def longest_stretch(equal: np.ndarray, identity: float = IDENTITY) -> tuple[int, int, int]:
    """(start, end, agreeing) of the longest stretch with ``identity`` of its words
    agreeing; of several the last."""
    # What makes up for rounding is less than any real difference.
    sums = np.concatenate([[0.0], np.cumsum(equal - identity)])
    # For every end the first start that lies no higher.
    low = np.minimum.accumulate(sums[:-1])
    first = np.searchsorted(-low, -(sums[1:] + 1e-6))
    length = np.arange(1, len(sums)) - first
    if not len(length) or length.max() <= 0:
        return 0, 0, 0
    end = len(length) - int(np.argmax(length[::-1]))
    start = int(first[end - 1])
    return start, end, int(equal[start:end].sum())


def overlap(equal: np.ndarray, least: int) -> tuple[int, int, int] | None:
    """(start, end, agreeing) of an overlap of ``least`` words or more, if there
    is one: the best stretch, or if that is too short the longest."""
    for stretch in (best_stretch, longest_stretch):
        start, end, same = stretch(equal)
        if end - start >= least:
            return start, end, same
    return None


def _words_of(text: str) -> np.ndarray:
    return np.concatenate([np.empty(0, np.uint64),
                           *(h for _, _, h, _ in word_hashes(pa.array([text], pa.string())))])


def _verify(batches):
    """Overlaps of (mark, text, items) rows, an item with its text and diagonals."""
    for batch in batches:
        rows, last, words, known = [], None, None, {}
        for mark, text, items in zip(*(batch.column(c) for c in ("mark", "text", "items"))):
            mark = mark.as_py()
            if mark != last:
                last, words = mark, _words_of(text.as_py())
            for held in items.as_py():
                item = held["item"]
                if item not in known:
                    known[item] = _words_of(held["item_text"])
                other = known[item]
                for diagonal in held["diagonals"]:
                    low, high = max(0, -diagonal), min(len(other), len(words) - diagonal)
                    if high <= low:
                        continue
                    found = overlap(words[low + diagonal:high + diagonal] == other[low:high],
                                    min(LEAST_WORDS, len(other)))
                    if found:
                        start, end, same = found
                        rows.append((mark, item, low + start + diagonal, low + start,
                                     end - start, same))
        if rows:
            kinds = (pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(zip(*rows), kinds)],
                ["mark", "item", "start_word", "item_word", "n_words", "n_equal"])


def _small(frame: DataFrame) -> DataFrame:
    """``frame``, to be broadcast if it is small enough."""
    return F.broadcast(frame) if frame.count() <= MAX_BROADCAST else frame


def _small_texts(frame: DataFrame, text: str) -> DataFrame:
    """The same, by the bytes of its texts."""
    size = frame.agg(F.coalesce(F.sum(F.octet_length(text)), F.lit(0))).first()[0]
    return F.broadcast(frame) if size <= MAX_BROADCAST_BYTES else frame


def text_mark(text: str = "text") -> Column:
    """Equal texts are looked at once."""
    return F.md5(F.encode(F.coalesce(F.col(text), F.lit("")), "UTF-8"))


def overlaps_by_text(documents: DataFrame, benchmark: DataFrame, scratch: Scratch) -> DataFrame:
    """Rows (mark, item, start_word, item_word, n_words, n_equal): the longest
    overlap of every text, known by its mark, with every item that has one."""
    spark = documents.sparkSession
    items = benchmark.select(text_mark().alias("item"), F.col("text").alias("text")) \
        .where("text is not null").dropDuplicates(["item"])
    seeds = scratch.save(items.mapInArrow(_item_seeds, "seed bigint, item string, off int, mask int"),
                         "seeds")
    bits = seeds.select(F.explode(F.array(*_bits(F.col("seed")))).alias("bit"))
    # At most 2^18 rows, each 64 bits of the map.
    rows = bits.groupBy(F.shiftright("bit", 6).alias("word")).agg(
        F.expr("bit_or(shiftleft(1L, cast(bit & 63 as int)))").alias("bits")).collect()
    words = np.zeros(1 << (MAP_BITS - 6), np.int64)
    for word, value in rows:
        words[word] = value
    shared = spark.sparkContext.broadcast(words.view(np.uint8))
    used = [ALL_MASKS[n] for (n,) in seeds.select("mask").distinct().collect()] or MASKS

    texts = documents.where("text is not null").select(text_mark().alias("mark"), "text")
    hits = texts.mapInArrow(_hits(shared, used), "mark string, seed bigint, place int")
    diagonals = hits.join(_small(seeds), "seed").select(
        "mark", "item", (F.col("place") - F.col("off")).alias("diagonal")).distinct()
    diagonals = scratch.save(diagonals, "diagonals")
    wanted = _small(diagonals.select("mark").distinct())
    one = texts.join(wanted, "mark", "left_semi").groupBy("mark").agg(
        F.first("text").alias("text"))
    item_texts = items.select("item", F.col("text").alias("item_text"))
    held = diagonals.groupBy("mark", "item").agg(F.collect_set("diagonal").alias("diagonals")) \
        .join(_small_texts(item_texts, "item_text"), "item")
    # A text that holds very many items is worked on in copies with some of them each.
    many = diagonals.groupBy("mark").agg(F.count_distinct("item").alias("n")).where(
        F.col("n") > ITEMS).select("mark", F.ceil(F.col("n") / ITEMS).alias("copies"))
    copy = F.pmod(F.xxhash64("item"), F.coalesce("copies", F.lit(1)))
    gathered = held.join(many, "mark", "left").groupBy("mark", copy.alias("copy")).agg(
        F.collect_list(F.struct("item", "item_text", "diagonals")).alias("items"))
    found = one.join(gathered, "mark").select("mark", "text", "items").mapInArrow(_verify, (
        "mark string, item string, start_word bigint, item_word bigint, n_words bigint,"
        " n_equal bigint"))
    best = F.max(F.struct("n_equal", "n_words", (-F.col("start_word")).alias("early"), "item_word"))
    return scratch.save(found.groupBy("mark", "item").agg(best.alias("b")).select(
        "mark", "item", (-F.col("b.early")).alias("start_word"), "b.item_word", "b.n_words",
        "b.n_equal"), "overlaps")


def contaminated(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """A row per document and benchmark item that overlap: doc_id, item_id,
    start_word and item_word (where, in words), n_words, n_equal.

    Clean documents have no row; nor have null and empty texts.  Equal items
    and equal documents have their rows each.
    """
    scratch = Scratch(documents.sparkSession, "decontamination")
    found = overlaps_by_text(documents, benchmark, scratch)
    ids = benchmark.where("text is not null").select("item_id", text_mark().alias("item"))
    rows = documents.where("text is not null").select("doc_id", text_mark().alias("mark"))
    return rows.join(_small(found.join(_small(ids), "item")), "mark").select(
        "doc_id", "item_id", "start_word", "item_word", "n_words", "n_equal")


def decontaminated(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``documents`` without those that overlap with ``benchmark``; all columns
    stay as they are, null texts stay."""
    scratch = Scratch(documents.sparkSession, "decontamination")
    marks = overlaps_by_text(documents, benchmark, scratch).select("mark").distinct()
    rows = documents.select(F.struct(*[F.col(f"`{c}`") for c in documents.columns]).alias("row"),
                            text_mark().alias("mark"))
    return rows.join(_small(marks), "mark", "left_anti").select("row.*")
