"""Language of texts by bit-sliced Bloom filters of character n-grams.

Every language has a Bloom filter of the n-grams frequent in it.  The filters
lie side by side: a slot is a number with one bit per language, so that the
conjunction of the slots of an n-gram gives at once all languages that have it.
Counting the bits over a text gives, per language, how many of its n-grams it
has; from that goes what its filter would pass by chance.  The highest count
decides.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleanery.llm.common import Scratch
from gleanery.llm.words import PIECE, mix, pieces, raw_texts

NGRAM = 4
# Fit: at most about so many documents of each language (drawn by hash of the
# id), and only n-grams that make up so much of them; so a filter has at most
# 1 / LEAST_SHARE n-grams.
SAMPLE_DOCS = 3000
LEAST_SHARE = 5e-5
SLOT_BITS, PROBES = 18, 3
# A text is of no learned language if fewer of its n-grams are known in it.
LEAST_SCORE = 0.2

_fold: list[np.ndarray] = []


def _folded() -> np.ndarray:
    """Lower-case letter of each code point of the basic plane; others are 1."""
    if not _fold:
        table = np.ones(1 << 16, np.uint64)
        for code in range(1 << 16):
            letter = chr(code)
            if letter.isalpha():
                low = letter.lower()
                table[code] = ord(low) if len(low) == 1 else code
        _fold.append(table)
    return _fold[0]


def _beyond(codes: np.ndarray) -> np.ndarray:
    """The same for code points of the other planes: few, so one by one."""
    return np.array([c if chr(c).isalpha() else 1 for c in codes.tolist()], np.uint64)


def ngrams(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the n-grams of texts in UTF-8, how far each text's go, and how
    many letters each text has.

    A run of other characters than letters counts as one space; n-grams reach
    over at most one space at either end and never from text to text.
    """
    text = data.tobytes().decode("utf-8")
    codes = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    # Place of every code point: the bytes that begin one.
    at = np.cumsum(np.concatenate([[0], (data & 0xC0) != 0x80]))[bounds]
    table = _folded()
    folded = table[np.minimum(codes, 0xFFFF)]
    high = np.flatnonzero(codes > 0xFFFF)
    if len(high):
        folded[high] = _beyond(codes[high])
    letter = folded > 1
    owner = np.repeat(np.arange(len(bounds) - 1), np.diff(at))
    letters = np.bincount(owner[letter], minlength=len(bounds) - 1)
    first = np.zeros(len(folded) + 1, bool)
    first[at] = True
    # Keep letters, and the first of each run of others; a text begins and ends
    # with a space.
    gap = ~letter
    lead = gap & np.concatenate([[True], letter[:-1]]) | gap & first[:-1]
    kept = np.flatnonzero(letter | lead)
    folded, owner = folded[kept], owner[kept]
    pads = np.searchsorted(owner, np.arange(len(bounds) - 1))
    folded, owner = np.insert(folded, pads, 1), np.insert(owner, pads, np.arange(len(pads)))
    closing = np.searchsorted(owner, np.arange(len(pads)), "right")
    folded, owner = np.insert(folded, closing, 1), np.insert(owner, closing, np.arange(len(pads)))
    n = len(folded) - NGRAM + 1
    if n <= 0:
        return np.empty(0, np.uint64), np.zeros(len(bounds), np.int64), letters
    packed = folded[:n].copy()
    for i in range(1, NGRAM):
        packed = packed * np.uint64(0x9E3779B97F4A7C15) + folded[i:n + i]
    # No space but at either end, at least two letters, one text.
    inner = np.ones(n, bool)
    for i in range(1, NGRAM - 1):
        inner &= folded[i:n + i] > 1
    good = inner & (owner[:n] == owner[NGRAM - 1:n + NGRAM - 1])
    packed, owner = mix(packed[good]), owner[:n][good]
    return packed, np.searchsorted(owner, np.arange(len(bounds))), letters


def _cut(data: np.ndarray, offsets: np.ndarray):
    """Pieces of texts: (text index of each, bytes, bounds).  A long text is cut
    between code points, with the overlap its n-grams need."""
    size = PIECE
    for i, j in pieces(offsets, size):
        low, high = int(offsets[i]), int(offsets[j])
        if j > i + 1 or high - low <= size:
            yield np.arange(i, j), data[low:high], offsets[i:j + 1] - low
            continue
        while low < high:
            end = min(low + size, high)
            while end < high and data[end] & 0xC0 == 0x80:
                end += 1
            yield np.array([i]), data[low:end], np.array([0, end - low])
            low = end


def slots_of(grams: np.ndarray) -> list[np.ndarray]:
    """The slots of n-grams, one array per probe."""
    mask = np.uint64((1 << SLOT_BITS) - 1)
    return [(grams >> np.uint64(21 * i)) & mask for i in range(PROBES)]


class Filters:
    """The filters of all languages: ``names`` in order, ``words`` an array of
    slots by 64 languages, ``chance`` the share of unknown n-grams each passes."""

    def __init__(self, names: list[str], rows):
        self.names = names
        width = max(-(-len(names) // 64), 1)
        self.words = np.zeros((width, 1 << SLOT_BITS), np.uint64)
        for slot, word, bits in rows:
            self.words[word, slot] = np.uint64(bits & ((1 << 64) - 1))
        filled = [np.count_nonzero(self._bit(self.words[k // 64], k)) / (1 << SLOT_BITS)
                  for k in range(len(names))]
        self.chance = np.array(filled) ** PROBES

    @staticmethod
    def _bit(words, k):
        return words >> np.uint64(k % 64) & np.uint64(1)

    def counts(self, grams: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Texts by languages: how many n-grams of the text the filter passes."""
        slots = slots_of(grams)
        out = np.zeros((len(bounds) - 1, len(self.names)), np.int64)
        for w, words in enumerate(self.words):
            found = words[slots[0]]
            for s in slots[1:]:
                found &= words[s]
            for k in range(64 * w, min(64 * w + 64, len(self.names))):
                sums = np.concatenate([[0], np.cumsum(self._bit(found, k), dtype=np.int64)])
                out[:, k] = sums[bounds[1:]] - sums[bounds[:-1]]
        return out

    def decide(self, passed: np.ndarray, total: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of the language and its corrected share, in [0, 1]."""
        total = total[:, None]
        true = (passed - total * self.chance) / np.maximum(1 - self.chance, 1e-9)
        share = np.clip(true / np.maximum(total, 1), 0, 1)
        best = share.argmax(axis=1)
        return best, share[np.arange(len(best)), best]


def _gram_counts(batches):
    """(lang, gram, n) of (lang, text) rows, combined per batch."""
    for batch in batches:
        langs = batch.column("lang").to_pylist()
        data, offsets = raw_texts(batch.column("text"))
        order = {lang: i for i, lang in enumerate(dict.fromkeys(langs))}
        for index, piece, bounds in _cut(data, offsets):
            grams, ends, _ = ngrams(piece, bounds)
            for lang, k in order.items():
                mine = [grams[ends[x]:ends[x + 1]] for x in range(len(index))
                        if langs[index[x]] == lang]
                if not mine:
                    continue
                values, n = np.unique(np.concatenate(mine), return_counts=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(values), pa.string()), pa.array(values.view(np.int64)),
                     pa.array(n)], ["lang", "gram", "n"])


def fit(labelled: DataFrame, sample_docs: int = SAMPLE_DOCS,
        least_share: float = LEAST_SHARE) -> Filters:
    """Filters of the languages of ``labelled`` (doc_id, text, lang), rows whose
    text and lang are not null.

    The sample, the n-grams (at most 1 / least_share per language) and the slots
    (fixed number) are bounded; the names and slots come to the driver, and
    from there to all tasks.
    """
    spark = labelled.sparkSession
    scratch = Scratch(spark, "language")
    known = labelled.where("text is not null and lang is not null").select(
        "doc_id", "text", "lang")
    share = known.groupBy("lang").agg(F.least(F.lit(1.0), F.lit(float(sample_docs))
                                              / F.count(F.lit(1))).alias("share"))
    draw = F.shiftrightunsigned(F.xxhash64(F.lit(20240609), "doc_id"), 11) / float(1 << 53)
    sample = known.join(F.broadcast(share), "lang").where(draw < F.col("share"))
    counted = scratch.save(sample.select("lang", "text").mapInArrow(
        _gram_counts, "lang string, gram bigint, n bigint")
        .groupBy("lang", "gram").agg(F.sum("n").alias("n")), "grams")
    total = counted.groupBy("lang").agg(F.sum("n").alias("total"))
    frequent = counted.join(F.broadcast(total), "lang") \
        .where(F.col("n") >= F.col("total") * least_share).select("lang", "gram")
    names = sorted(row[0] for row in share.select("lang").collect())
    if not names:
        return Filters([], [])
    number = F.create_map(*[x for i, n in enumerate(names) for x in (F.lit(n), F.lit(i))])
    mask = (1 << SLOT_BITS) - 1
    slots = F.explode(F.array(*[
        F.shiftrightunsigned("gram", 21 * i).bitwiseAND(F.lit(mask)) for i in range(PROBES)]))
    rows = frequent.select(slots.alias("slot"), number[F.col("lang")].alias("k")) \
        .groupBy("slot", F.floor(F.col("k") / 64).alias("word")) \
        .agg(F.expr("bit_or(shiftleft(1L, k % 64))").alias("bits")).collect()
    return Filters(names, rows)


def predict(frame: DataFrame, filters: Filters) -> DataFrame:
    """``frame`` (doc_id, text, extra columns) with lang_pred and score.

    ``und`` with score 0 if the text is null or has no letter, or if nothing has
    been learned.  Equal scores: the first language by name.
    """
    spark = frame.sparkSession
    shared = spark.sparkContext.broadcast(filters)
    kept = [c for c in frame.columns if c not in ("text", "lang_pred", "score")]

    def run(batches):
        f = shared.value
        for batch in batches:
            column = batch.column("text")
            data, offsets = raw_texts(column)
            n = batch.num_rows
            passed, total = np.zeros((n, len(f.names)), np.int64), np.zeros(n, np.int64)
            letters = np.zeros(n, np.int64)
            for index, piece, bounds in _cut(data, offsets):
                grams, ends, own = ngrams(piece, bounds)
                passed[index] += f.counts(grams, ends)
                total[index] += np.diff(ends)
                letters[index] += own
            unknown = (letters == 0) | (not f.names)
            best, score = f.decide(passed, total) if f.names and n else (total, total * 0.0)
            names = [*f.names, "und"]
            best = np.where(unknown, len(f.names), best)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in kept), pa.array([names[i] for i in best], pa.string()),
                 pa.array(np.where(unknown, 0.0, score), pa.float64())],
                [*kept, "lang_pred", "score"])

    schema = ", ".join(f"`{c}` {frame.schema[c].dataType.simpleString()}" for c in kept)
    return frame.select("text", *[F.col(f"`{c}`") for c in kept]).mapInArrow(
        run, f"{schema}, lang_pred string, score double")


def held_out():
    """Rows the model does not learn from."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1


def identify(documents: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score per row; learns from the labelled rows
    that are not held out.  A row without an id is not held out."""
    rows = documents.select("doc_id", "text", "lang", F.coalesce(
        held_out(), F.lit(False)).alias("held_out"))
    filters = fit(rows.where("not held_out"))
    return predict(rows.select("doc_id", "held_out", "text"), filters)


def in_known_language(documents: DataFrame, least_score: float = LEAST_SCORE) -> DataFrame:
    """``documents`` without the texts of no learned language: those without a
    letter, and those with a score below ``least_score``.  All columns stay as
    they are."""
    rows = documents.select("doc_id", "text", "lang", F.coalesce(
        held_out(), F.lit(False)).alias("held_out"))
    filters = fit(rows.where("not held_out"))
    return confident(documents, filters, least_score)


def confident(documents: DataFrame, filters: Filters, least_score: float) -> DataFrame:
    """The rows of ``documents`` whose score is high enough."""
    shared = documents.sparkSession.sparkContext.broadcast(filters)
    text = documents.columns.index("text")
    inner = documents.toDF(*[f"c{i}" for i in range(len(documents.columns))])

    def run(batches):
        f = shared.value
        for batch in batches:
            data, offsets = raw_texts(batch.column(text))
            n = batch.num_rows
            passed, total = np.zeros((n, len(f.names)), np.int64), np.zeros(n, np.int64)
            letters = np.zeros(n, np.int64)
            for index, piece, bounds in _cut(data, offsets):
                grams, ends, own = ngrams(piece, bounds)
                passed[index] += f.counts(grams, ends)
                total[index] += np.diff(ends)
                letters[index] += own
            keep = letters > 0
            if f.names and n:
                keep &= f.decide(passed, total)[1] >= least_score
            yield batch.filter(pa.array(keep))

    return inner.mapInArrow(run, inner.schema).toDF(*documents.columns)
