"""What the operators share: scratch tables and connected components."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed value: what separates words, everywhere in this package.
SPACES = r"\x20\x09-\x0D"
WORD = f"[^{SPACES}]+"
# Bytes of an Arrow batch that is handed to Python.
BATCH_SETTING, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 8 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def let(value: Column, body) -> Column:
    """``body`` of a value that is worked out once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors see; in local mode one is made if none is set."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not spark.sparkContext.master.startswith(("local[", "local")) \
                or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        shared = "file://" + tempfile.mkdtemp(prefix="gleanery-")
        spark.conf.set("spark.checkpoint.dir", shared)
    return shared.rstrip("/")


def bound_batches(spark: SparkSession) -> None:
    """Let Arrow batches end by bytes as well as by rows, unless the session says
    something of its own: ten thousand texts may be of any size."""
    if spark.conf.get(BATCH_SETTING, None) is None:
        spark.conf.set(BATCH_SETTING, str(BATCH_BYTES))


class Scratch:
    """Tables of one run in the shared folder.

    A table cuts the lineage, so a lost executor costs tasks, not the run.
    What is not dropped earlier goes when the session ends.
    """

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        bound_batches(spark)
        self.root = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
        self.sorted = set()
        path = self._path(self.root)
        self._files(path).deleteOnExit(path)

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(name)

    def _files(self, path):
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def save(self, frame: DataFrame, name: str, partition: str | None = None) -> DataFrame:
        """``frame`` as written; with ``partition``, in folders by that column."""
        frame.write.parquet(f"{self.root}/{name}", partitionBy=partition)
        return self.spark.read.schema(frame.schema).parquet(f"{self.root}/{name}")

    def _sorted_name(self, name: str) -> str:
        return f"{self.root.rsplit('/', 1)[1].replace('-', '_')}_{name}"

    def save_sorted(self, frame: DataFrame, name: str, by: list[str], buckets: int) -> None:
        """``frame`` in ``buckets``, each sorted; ``sorted_table`` reads it."""
        frame.write.bucketBy(buckets, *by).sortBy(*by).option(
            "path", f"{self.root}/{name}").saveAsTable(self._sorted_name(name))
        self.sorted.add(name)

    def sorted_table(self, name: str) -> DataFrame:
        return self.spark.table(self._sorted_name(name))

    def drop(self, *names: str) -> None:
        for name in names:
            if name in self.sorted:
                self.sorted.remove(name)
                self.spark.sql(f"DROP TABLE {self._sorted_name(name)}")
            path = self._path(f"{self.root}/{name}")
            self._files(path).delete(path, True)


def components(scratch: Scratch, edges: DataFrame, name: str = "components") -> DataFrame:
    """Connected components of ``edges`` (a, b): rows (node, root), root the
    smallest node, for every node but the roots.

    Large-star and small-star steps in turn: each hangs the neighbours of a
    node on the smallest of them, until every component is a star.  The minima
    are combined before the shuffle, so a node with very many neighbours is no
    group in one task; its joins are left to the skew handling of AQE.
    """
    current = scratch.save(edges.where("a <> b").select(
        F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), f"{name}0")
    step = 0
    while not _stars(current):
        both = current.unionByName(current.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least("a", F.min("b")).alias("low"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"),
                                                            F.col("low").alias("b"))
        large = large.unionByName(least.where("low < a").select("a", F.col("low").alias("b")))
        # All edges point from the larger node to the smaller one here.
        large = scratch.save(large.distinct(), f"{name}{step}l")
        low = large.groupBy("a").agg(F.min("b").alias("low"))
        small = large.join(low, "a").select(F.col("b").alias("a"), F.col("low").alias("b")) \
            .where("a <> b").unionByName(low.select("a", F.col("low").alias("b")))
        step += 1
        current = scratch.save(small.distinct(), f"{name}{step}")
        scratch.drop(f"{name}{step - 1}", f"{name}{step - 1}l")
    return current.select(F.col("a").alias("node"), F.col("b").alias("root"))


def _stars(edges: DataFrame) -> bool:
    """Whether every node hangs on one other, which itself hangs on none."""
    several = edges.groupBy("a").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    roots = edges.select(F.col("b").alias("a"))
    return several.isEmpty() and edges.join(roots, "a", "left_semi").isEmpty()
