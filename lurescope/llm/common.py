"""Helpers shared by the operators: table access, staging, row keys and
connected components as Spark jobs."""

from __future__ import annotations

import io
import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lurescope.session import ensure_checkpoint_dir


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def ship(spark: SparkSession) -> None:
    """Give the package to the executors' Python workers, once per context; a
    cluster needs no installed copy."""
    sc = spark.sparkContext
    if getattr(sc, "_lurescope_shipped", False):
        return
    import lurescope
    root = os.path.dirname(os.path.abspath(lurescope.__file__))
    held = io.BytesIO()
    with zipfile.ZipFile(held, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, names in os.walk(root):
            for name in sorted(n for n in names if n.endswith(".py")):
                path = os.path.join(folder, name)
                z.write(path, os.path.relpath(path, os.path.dirname(root)))
    # Spark serves the file from the driver; executors never read this folder
    path = os.path.join(tempfile.mkdtemp(prefix="lurescope-code-"), "lurescope_code.zip")
    with open(path, "wb") as out:
        out.write(held.getvalue())
    sc.addPyFile(path)
    sc._lurescope_shipped = True


#: What a remembered entry costs beside its key and its value.
ENTRY_BYTES = 160


class Remembered(dict):
    """``make(key)`` of each key, remembered in two generations of at most
    ``limit`` bytes: what is used again moves to the young one, and when that is
    full the old one is forgotten, so frequent keys always stay."""

    def __init__(self, make, limit: int):
        super().__init__()
        self.make, self.limit = make, limit
        self.old: dict = {}
        self.held = 0

    def __missing__(self, key):
        got = self.old.get(key)
        if got is None:
            got = self.make(key)
        self.held += ENTRY_BYTES + len(key) + len(got)
        if self.held > self.limit:
            self.old = dict(self)
            self.clear()
            self.held = ENTRY_BYTES + len(key) + len(got)
        self[key] = got
        return got


def stage_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder that ``spark.checkpoint.dir`` names."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/llm/{name}-{uuid.uuid4().hex[:12]}"


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and return a scan of it.

    Cuts the lineage: a lost executor re-reads the table, and every later use
    sees the same rows.
    """
    spark = df.sparkSession
    path = stage_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def unstage(*tables: DataFrame) -> None:
    """Delete staged tables from which nothing is read any more: call it only when every
    table built from them is written."""
    for df in tables:
        jvm, conf = df.sparkSession._jvm, df.sparkSession._jsc.hadoopConfiguration()
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            path = jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(conf).delete(path, True)


def free_name(name: str, *frames: DataFrame) -> str:
    """``name`` with underscores in front until no frame has such a column."""
    taken = {c.lower() for df in frames for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def with_text(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, text, rk): null text counts as empty.  ``rk`` tells rows that
    share an id but differ in text apart; identical rows share it."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return docs.select(F.col(id_col).alias("id"), text.alias("text"),
                       F.xxhash64(F.col(id_col), text).alias("rk"))


def bounded_broadcast(small: DataFrame, max_rows: int) -> DataFrame:
    """Broadcast hint for a staged table of at most ``max_rows`` narrow rows;
    a larger one is returned as it is and joins by shuffle."""
    return F.broadcast(small) if small.count() <= max_rows else small


def most_frequent(counts: DataFrame, c: str, most: int) -> DataFrame:
    """The rows of ``counts`` with the largest counts: all with at least n, for
    the smallest n that leaves no more than ``most`` rows.  The rows are neither
    sorted nor gathered; the driver sees one row per different count, of which
    there are no more than the square root of twice the counted total."""
    histogram = counts.groupBy(c).agg(F.count(F.lit(1)).alias("_n"))
    rows = sorted(((r[c], r["_n"]) for r in histogram.toLocalIterator()), reverse=True)
    total, least = 0, (rows[0][0] + 1 if rows else 1)
    for value, n in rows:
        total += n
        if total > most:
            break
        least = value
    return counts.filter(F.col(c) >= least)


def components(edges: DataFrame, name: str, max_rounds: int = 60) -> DataFrame:
    """Connected components of (a, b) edges: one row (node, component) for
    each node of an edge, ``component`` its smallest reachable node.

    Alternating large-star and small-star contraction: every round keeps only
    edges towards the smallest neighbour known, so a component of any shape
    becomes a star in O(log n) rounds.  Each round is a Spark job over a staged
    edge table; neighbourhoods are only reduced with ``min`` (combined in the
    map tasks), never gathered, and a hot centre is a skewed join that AQE
    splits.  Only a row count and a checksum reach the driver.
    """
    e = (edges.filter("a <> b")
         .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    e = stage(e, f"{name}-edges")
    seen = None
    for _ in range(max_rounds):
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select(
            "a", F.least("a", "m").alias("m"))
        large = (both.filter("b > a").join(low, "a")
                 .select(F.col("b").alias("a"), F.col("m").alias("b")).distinct())
        large = stage(large, f"{name}-large")
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        joined = large.join(low, "a")
        small = (joined.select("a", F.col("m").alias("b"))
                 .unionByName(joined.filter("b > m").select(F.col("b").alias("a"),
                                                            F.col("m").alias("b"))).distinct())
        e = stage(small, f"{name}-small")
        mark = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if seen == tuple(mark):
            break
        seen = tuple(mark)
    else:
        raise RuntimeError(f"{name}: components not stable after {max_rounds} rounds")
    roots = e.select(F.col("b").alias("node")).distinct()
    return (e.select(F.col("a").alias("node"), F.col("b").alias("component"))
            .unionByName(roots.select("node", F.col("node").alias("component"))).distinct())


def positions(rows: DataFrame, order: list, name: str) -> DataFrame:
    """``rows``, written once, with ``pos``: their place (from 0) in the total
    ``order`` of the whole table.

    Range partitions are sorted and staged with their number and the place of
    each row in them; one count per partition gives the offsets, the only rows
    that one task or a broadcast sees.  Rows equal in ``order`` get places in
    any order, which the staged table then keeps.
    """
    placed = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = stage(placed.withColumn("_place", F.monotonically_increasing_id()), name)
    part = F.shiftright("_place", 33)
    sizes = placed.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(F.col("_part"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    return (placed.withColumn("_part", part).join(F.broadcast(offsets), "_part")
            .withColumn("pos", F.col("_before") + F.col("_place") % F.lit(1 << 33))
            .drop("_part", "_place", "_before"))
