"""What the corpus operators share: word rules, cut lineage, connected components."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space that separates words: space and U+0009 to U+000D.
SPACE = r"[\x20\x09-\x0D]"
#: A word.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def cut(df: DataFrame) -> DataFrame:
    """``df`` as files in the shared checkpoint folder, so that lost executors cost no recomputation of what led to it.

    The folder is the one that the session names in ``spark.checkpoint.dir``. Where none is set, a local session gets
    a temporary one; a cluster without one is an error, as a folder of one machine can't be read by the others.
    """
    spark = df.sparkSession
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = context.getConf().get("spark.checkpoint.dir")
        if folder is None:
            if not context.master.startswith("local[") and context.master != "local":
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            folder = tempfile.mkdtemp(prefix="tidemark-checkpoint-")
        context.setCheckpointDir(folder)
    return df.checkpoint()


#: Tasks that the members of one component are spread over when they are told its smallest id.
SALTS = 32
#: Tasks that the rows of one key are spread over when they are told something of all of them.
KEY_SALTS = 256


def with_least(rows: DataFrame, key: str, value: str) -> DataFrame:
    """``rows`` with ``least``, the smallest ``value`` of their ``key``. Rows of a key are dealt by ``KEY_SALTS`` salts of their
    values, once for the minimum and for the join, so a key that a third of all rows have is spread. A key is told its
    minimum under the salts it has, which are no more than its rows. Rows without a key or a value don't come back."""
    # never null by Spark's rules, so nothing is filtered on one side alone and both read the same shuffle
    salt = F.coalesce(F.pmod(F.xxhash64(value), F.lit(KEY_SALTS)), F.lit(0)).cast("int")
    rows = rows.withColumn("__salt", salt).repartition(key, "__salt")
    part = rows.groupBy(key, "__salt").agg(F.min(value).alias("least"))
    low = part.groupBy(key).agg(F.min("least").alias("least"), F.collect_list("__salt").alias("salts"))
    # by shuffle: Spark's sizes are those before explode, so it would broadcast many times what its threshold says
    return rows.join(low.select(key, "least", F.explode("salts").alias("__salt")).hint("merge"), [key, "__salt"]).drop("__salt")


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Connected components of ``edges`` (``a``, ``b``: long) as (``node``, ``root``), the root being the smallest node.

    Alternates large-star and small-star steps, each of which replaces links by links to a smaller neighbour, until the
    links are stars: no node that has a smaller neighbour has another one. A step is a grouped minimum and a join back
    (``with_least``): no group of neighbours is gathered anywhere, and a node that a third of all links meet is spread. The
    links only shrink, and each round is written to the checkpoint folder. Links that are stars from the start cost no
    round. Loops and repeated links are allowed; without links the result is empty.
    """

    def both(links: DataFrame) -> DataFrame:
        return links.select(F.explode(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))).alias("e")).select("e.u", "e.v")

    def stars(links: DataFrame) -> bool:
        return both(links).groupBy("u").agg(F.count("*").alias("n"), F.min("v").alias("low")).filter("n > 1 AND low < u").isEmpty()

    links = cut(edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    for _ in range(max_rounds):
        if stars(links):
            return links.select(F.col("u").alias("node"), F.col("v").alias("root"))
        large = with_least(both(links), "u", "v").select(F.col("v").alias("u"), F.least("least", "u").alias("v"), F.col("u").alias("w"))
        large = large.filter("u > w").select("u", "v").distinct()
        small = with_least(large, "u", "v")
        small = small.select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("least").alias("v")), F.struct(F.col("u"), F.col("least").alias("v")))).alias("e"))
        links = cut(small.select("e.u", "e.v").filter("u <> v").distinct())
    raise RuntimeError(f"the components did not settle in {max_rounds} rounds")


def labelled(prints: DataFrame, roots: DataFrame, node: str) -> DataFrame:
    """(``doc_id``, ``node``, ``component_id``) of ``prints`` (``doc_id``, ``node``) and ``roots`` (``node``, ``root``; roots
    themselves and single nodes may be missing): the smallest id of each component. Only nodes of a component of several
    are joined on its root, and each component's id is there under those of ``SALTS`` salts that it has, so that a large one is
    spread; nodes of very many documents are not joined by shuffle."""
    least = cut(prints.groupBy(node).agg(F.min("doc_id").alias("least"), F.count("*").alias("rows")))
    linked = roots.select(F.col("node").alias(node), "root")
    linked = linked.unionByName(linked.select(F.col("root").alias(node), "root")).distinct()
    salt = F.pmod(F.xxhash64(node), F.lit(SALTS)).cast("int")
    known = cut(linked.join(least.drop("rows"), node).select(node, "root", "least", salt.alias("salt")))
    low = known.groupBy("root", "salt").agg(F.min("least").alias("least")).groupBy("root").agg(F.min("least").alias("component_id"), F.collect_list("salt").alias("salts"))
    low = low.select("root", "component_id", F.explode("salts").alias("salt"))
    # by shuffle, as in with_least
    told = known.join(low.hint("merge"), ["root", "salt"]).select(node, F.col("component_id").alias("of_several"))
    every = cut(least.join(told, node, "left").select(node, F.coalesce("of_several", "least").alias("component_id"), "rows"))
    # a node of more than a thousandth of the rows: there are fewer than a thousand, so they are told by broadcast
    total = every.agg(F.sum("rows").alias("n")).first()["n"] or 0
    hot = F.broadcast(every.filter(F.col("rows") * 1000 > total).drop("rows"))
    cold = prints.join(hot.drop("component_id"), node, "left_anti").join(every.drop("rows"), node)
    return prints.join(hot, node).select("doc_id", node, "component_id").unionByName(cold.select("doc_id", node, "component_id"))
