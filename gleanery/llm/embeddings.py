"""Near duplicates among embeddings by cross-polytope hashing.

A vector is rotated at random (three rounds of random signs and a fast Hadamard
transform) and hashed to the axis, with its sign, it then lies closest to; the
next closest axes are probed as well.  Several rotations make several tables.
In a bucket all cosines are worked out in double precision, so what is linked
is linked truly; pairs that meet in several buckets count in the first of them.

Vectors are compared only within their label, and equal ones are one class from the
start, with their number.  A bucket of many classes is cut into blocks, and blocks are
paired, so that no task gets it whole; buckets hold numbers, and vectors come to the
blocks.  No pairs are put out: a block gives each vector its number of links, and links
enough to connect what is connected.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanery.llm.common import Scratch, components

SEED = 20240610
COSINE = 0.93
TABLES, PROBES = 3, 3
# Tables and probes by axes hashed: what further axes part, more of both bring
# together again.
SETTINGS = {1: (TABLES, PROBES), 2: (4, 9), 3: (5, 16)}
# Rows of a block, and rows of a bucket from which its label has one more axis.
BLOCK, BUCKET = 1024, 4096
# Rows with a bucket each that a task hands on at once.
HANDED = 90_000


def hadamard(rows: np.ndarray) -> np.ndarray:
    """Fast Walsh-Hadamard transform of every row; its length is a power of 2."""
    n, d = rows.shape
    step = 1
    while step < d:
        pairs = rows.reshape(n, d // (2 * step), 2, step)
        rows = np.stack([pairs[:, :, 0] + pairs[:, :, 1], pairs[:, :, 0] - pairs[:, :, 1]],
                        axis=2).reshape(n, d)
        step *= 2
    return rows / np.sqrt(d)


def rotate(vectors: np.ndarray, table: int, axis: int, seed: int = SEED) -> np.ndarray:
    """The vectors, padded to a power of 2, under one of the random rotations."""
    n, d = vectors.shape
    size = 1 << max(d - 1, 1).bit_length()
    rows = np.zeros((n, size))
    rows[:, :d] = vectors
    rng = np.random.default_rng([seed, table, axis])
    for _ in range(3):
        rows = hadamard(rows * rng.choice([-1.0, 1.0], size))
    return rows


def nearest_axes(rotated: np.ndarray, probes: int) -> tuple[np.ndarray, np.ndarray]:
    """The closest axes of every row, numbered with their sign, and how close."""
    probes = min(probes, rotated.shape[1])
    size = np.abs(rotated)
    top = np.argsort(-size, axis=1, kind="stable")[:, :probes]
    value = np.take_along_axis(rotated, top, 1)
    return 2 * top + (value < 0), np.abs(value)


def bucket_ids(vectors: np.ndarray, axes: int, tables: int | None = None,
               probes: int | None = None) -> np.ndarray:
    """Rows by tables * probes: the buckets of every vector, the table in the
    high digits.  With several axes per table, probes are the combinations
    closest in sum of squares."""
    tables, probes = tables or SETTINGS[axes][0], probes or SETTINGS[axes][1]
    found = []
    for table in range(tables):
        number = np.full((len(vectors), 1), table, np.int64)
        close = np.zeros((len(vectors), 1))
        for axis in range(axes):
            ids, value = nearest_axes(rotate(vectors, table, axis), probes)
            base = 4 * vectors.shape[1]
            number = (number[:, :, None] * base + ids[:, None, :]).reshape(len(vectors), -1)
            close = (close[:, :, None] + value[:, None, :] ** 2).reshape(len(vectors), -1)
            best = np.argsort(-close, axis=1, kind="stable")[:, :probes]
            number = np.take_along_axis(number, best, 1)
            close = np.take_along_axis(close, best, 1)
        found.append(number)
    return np.concatenate(found, axis=1)


def _matrix(column) -> np.ndarray:
    flat = column.flatten()
    return np.asarray(flat.to_numpy(zero_copy_only=False), np.float64).reshape(len(column), -1)


def _bucketed(axes: int):
    """Vectors with all their buckets."""
    step = HANDED // (SETTINGS[axes][0] * SETTINGS[axes][1])

    def run(batches):
        for batch in (b.slice(at, step) for b in batches for at in range(0, b.num_rows, step)):
            vectors = _matrix(batch.column("vector"))
            # Vectors of other lengths than the first are in batches of their own.
            unit = vectors / np.linalg.norm(vectors, axis=1)[:, None]
            ids = bucket_ids(unit, axes)
            buckets = pa.FixedSizeListArray.from_arrays(pa.array(ids.ravel()), ids.shape[1]) \
                .cast(pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("row", "label", "times", "vector")), buckets],
                ["row", "label", "times", "vector", "buckets"])

    return run


def first_common(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The smallest bucket that each pair of rows of bucket ids shares."""
    least = np.full(len(left), np.iinfo(np.int64).max)
    for k in range(left.shape[1]):
        column = left[:, k]
        shared = (column[:, None] == right).any(axis=1)
        least = np.where(shared, np.minimum(least, column), least)
    return least


def _compare(limit: float):
    """Links among the vectors of one block pair of one bucket."""
    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        rows, times = table.column("row").to_numpy(), table.column("times").to_numpy()
        vectors = _matrix(table.column("vector").combine_chunks())
        vectors = vectors / np.linalg.norm(vectors, axis=1)[:, None]
        buckets = _matrix(table.column("buckets").combine_chunks()).astype(np.int64)
        block = table.column("block").to_numpy()
        bucket = table.column("bucket")[0].as_py()
        low, high = table.column("low")[0].as_py(), table.column("high")[0].as_py()
        first = np.flatnonzero(block == low)
        second = np.flatnonzero(block == high)
        links = np.zeros(len(rows), np.int64)
        root = np.arange(len(rows))
        for at in range(0, len(first), 256):
            part = first[at:at + 256]
            near = vectors[part] @ vectors[second].T >= limit
            a, b = np.nonzero(near)
            a, b = part[a], second[b]
            if low == high:
                a, b = a[a < b], b[a < b]
            for cut in range(0, len(a), 1 << 16):
                x, y = a[cut:cut + (1 << 16)], b[cut:cut + (1 << 16)]
                new = first_common(buckets[x], buckets[y]) == bucket
                np.add.at(links, x[new], times[y[new]])
                np.add.at(links, y[new], times[x[new]])
                _join(root, x[new], y[new])
        used = np.flatnonzero(links)
        return pa.table({"row": rows[used], "links": links[used], "root": rows[root[used]]})

    return run


def _join(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Merge the groups that the pairs (a, b) connect; ``root`` is kept flat."""
    while len(a):
        x, y = root[a], root[b]
        open_ = x != y
        a, b, x, y = a[open_], b[open_], x[open_], y[open_]
        if not len(a):
            return
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while True:
            flat = root[root]
            if (flat == root).all():
                break
            root[:] = flat


def usable() -> Column:
    """Neither null nor zero, and all components finite numbers."""
    return (F.col("embedding").isNotNull() & F.col("label").isNotNull()
            & F.forall("embedding", lambda x: F.coalesce(
                ~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
            & F.exists("embedding", lambda x: F.coalesce(x != 0, F.lit(False))))


def axes_for(rows: str, dims: str) -> Column:
    """Axes to hash a label of so many rows with."""
    axes = F.lit(1)
    for more in range(2, len(SETTINGS) + 1):
        held = F.col(rows) * SETTINGS[more - 1][1] / F.pow(
            2.0 * F.greatest(F.col(dims), F.lit(2)), F.lit(float(more - 1)))
        axes = F.when((axes == more - 1) & (held > BUCKET), more).otherwise(axes)
    return axes


def near_embeddings(vectors: DataFrame, limit: float = COSINE) -> DataFrame:
    """A row per row of ``vectors`` (vec_id, embedding, label): vec_id, n_links,
    component_id, kept.

    Rows that cannot be linked (null label or vector, zero, a component that is
    null or not finite) have no links and are their own component.  Vectors of
    different length are not compared.  Repeated rows are different vectors.  A
    null vec_id is smaller than none: the component is named by the smallest id
    there is in it.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark, "embeddings")
    rows = scratch.save(vectors.select(
        F.monotonically_increasing_id().alias("row"), "vec_id", "label", "embedding",
        usable().alias("usable")), "rows")
    good = rows.where("usable").select(
        "row", F.struct(F.size("embedding").alias("size"), "label").alias("label"),
        F.col("embedding").cast("array<double>").alias("vector"))
    good = good.withColumn("same", F.struct(
        F.xxhash64("vector").alias("a"), F.xxhash64(F.lit(1), "vector").alias("b")))
    classes = scratch.save(good.groupBy("label", "same").agg(
        F.min("row").alias("class"), F.count(F.lit(1)).alias("times")), "classes")
    members = good.select("row", "label", "same").join(classes, ["label", "same"]) \
        .select("row", "class", "times")
    unique = good.join(classes.select(F.col("class").alias("row"), "times"), "row")
    # One axis separates 2 * dimensions ways; labels too large for that have more.
    deep = scratch.save(classes.groupBy("label").agg(F.count(F.lit(1)).alias("n")).select(
        "label", axes_for("n", "label.size").alias("axes")).where("axes > 1"), "deep")
    unique = unique.join(deep, "label", "left").withColumn("axes", F.coalesce("axes", F.lit(1)))
    kinds = [1, *sorted(r[0] for r in deep.select("axes").distinct().collect())]
    sizes = [r[0] for r in classes.select("label.size").distinct().collect()]
    schema = ("row bigint, label bigint, times bigint, vector array<double>,"
              " buckets array<bigint>")
    keyed = unique.withColumn("label", F.xxhash64("label"))
    parts = [keyed.where((F.size("vector") == size) & (F.col("axes") == axes))
             .mapInArrow(_bucketed(axes), schema) for size in sorted(sizes) for axes in kinds]
    if not parts:
        return rows.select("vec_id", F.lit(0).cast("bigint").alias("n_links"),
                           F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    units = parts[0]
    for part in parts[1:]:
        units = units.unionByName(part)
    units = scratch.save(units, "units")
    bucketed = units.select("row", "label", F.explode("buckets").alias("bucket"))
    held = bucketed.groupBy("label", "bucket").agg(F.count(F.lit(1)).alias("n")) \
        .where("n > 1").withColumn("blocks", F.ceil(F.col("n") / BLOCK).cast("int"))
    block = F.pmod(F.xxhash64(F.lit(SEED), "row"), F.col("blocks")).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    paired = bucketed.join(held.drop("n"), ["label", "bucket"]).withColumn("block", block) \
        .withColumn("other", other) \
        .withColumn("low", F.least("block", "other")).withColumn("high", F.greatest("block", "other"))
    linked = paired.select("label", "bucket", "low", "high", "block", "row") \
        .join(units.drop("label"), "row") \
        .groupBy("label", "bucket", "low", "high") \
        .applyInArrow(_compare(limit), "row bigint, links bigint, root bigint")
    linked = scratch.save(linked, "links")
    totals = linked.groupBy(F.col("row").alias("class")).agg(F.sum("links").alias("links"))
    roots = components(scratch, linked.select(F.col("row").alias("a"), F.col("root").alias("b")))
    of_class = classes.select("class", "times").join(totals, "class", "left") \
        .join(roots.select(F.col("node").alias("class"), "root"), "class", "left") \
        .select("class", (F.coalesce("links", F.lit(0)) + F.col("times") - 1).alias("links"),
                F.coalesce("root", "class").alias("root"))
    placed = rows.select("row", "vec_id").join(
        members.select("row", "class").join(of_class, "class"), "row", "left") \
        .select("vec_id", "links", F.coalesce("root", "row").alias("root"))
    named = placed.where("links > 0").groupBy("root").agg(F.min("vec_id").alias("low"))
    out = placed.join(named, "root", "left").withColumn("component_id", F.coalesce("low", "vec_id"))
    return out.select("vec_id", F.coalesce("links", F.lit(0)).cast("bigint").alias("n_links"),
                      "component_id", F.col("vec_id").eqNullSafe(F.col("component_id"))
                      .alias("kept"))
