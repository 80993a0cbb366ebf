"""Exact duplicates by content-defined chunk recipes, with DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, cut

#: Salts for groups of copies, so that one large group is spread over so many tasks.
SALTS = 32


def normalized(text: Column) -> Column:
    """A text without its white space; null counts as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACE + "+", "")


def chunks(text: Column, least: int, most: int) -> Column:
    """The content-defined chunks of a text, in order: a chunk ends at the first sentence or clause mark after ``least``
    characters, or after ``most``. They join to the text again, and equal texts have equal chunks."""
    return F.regexp_extract_all(text, F.lit(rf"(?s).{{{least},{most - 1}}}?[.!?;:,。！？、।؟]|.{{1,{most}}}"), F.lit(0))


def exact_dedup(docs: DataFrame, least: int = 512, most: int = 4096, key_bits: int = 64) -> DataFrame:
    """Groups of documents whose texts are equal without white space, one row per row of ``docs``:
    (``doc_id``, ``keep_id``, ``group_size``, ``kept``, ``text_sha256``).

    1. Every text is cut into content-defined chunks, each with a key of 64 bits.
    2. A dictionary of the chunks verifies the keys: where the smallest and the largest chunk of a key are the same
       text, all are, and the key identifies it. Each distinct chunk moves once per map task, no document does.
    3. The recipe of a document is the list of its chunks' identifiers. Documents that use a key with several texts
       name their chunks by SHA-256 instead; as a copy uses the same chunks, it changes over with them.
    4. Equal recipes are one group. Groups are counted before the shuffle, and those of two or more are joined back
       under ``SALTS`` salts, so that a group with a third of all rows is spread.

    Of a group the row with the most code points in the original text stays, then that with the smallest ``doc_id``.

    Null text: as empty. Texts of white space alone: equal to empty ones. Null ``doc_id``: after every other id; the
    row is kept if it wins on code points. Repeated rows (one id, equal texts) count each, and all of them are kept if
    their id is. Very long texts: only their recipes move. Empty table: empty result. Other columns are not read.
    """
    text = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("raw"))
    text = text.select("doc_id", F.length("raw").alias("points"), normalized(F.col("raw")).alias("norm"))
    salt = F.pmod(F.xxhash64("doc_id", "points"), F.lit(SALTS)).cast("int")
    key = (lambda c: F.xxhash64(c)) if key_bits >= 64 else (lambda c: F.pmod(F.xxhash64(c), F.lit(1 << key_bits)))

    parts = text.select("doc_id", F.explode(chunks(F.col("norm"), least, most)).alias("chunk")).withColumn("key", key(F.col("chunk")))
    book = parts.groupBy("key").agg(F.min("chunk").alias("low"), F.max("chunk").alias("high"))
    unsure = cut(book.filter("low <> high").select("key"))

    listed = chunks(F.col("norm"), least, most)
    rows = text.select(
        "doc_id",
        "points",
        F.sha2("norm", 256).alias("text_sha256"),
        F.array_join(F.transform(listed, lambda c: F.hex(key(c))), ".").alias("recipe"),
        *([] if unsure.isEmpty() else [F.array_join(F.transform(listed, lambda c: F.sha2(c, 256)), ".").alias("long_recipe"), F.transform(listed, key).alias("keys")]),
    )
    if "keys" in rows.columns:
        users = rows.select("long_recipe", F.explode("keys").alias("key")).join(unsure, "key", "left_semi").select("long_recipe").distinct()
        users = users.select("long_recipe", F.lit(True).alias("changes"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
        rows = rows.withColumn("salt", salt).join(users, ["long_recipe", "salt"], "left").withColumn("recipe", F.when(F.col("changes"), F.col("long_recipe")).otherwise(F.col("recipe")))
    rows = cut(rows.select("doc_id", "points", "text_sha256", "recipe"))

    best = F.min(F.struct((-F.col("points")).alias("less"), F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"))).alias("best")
    groups = rows.groupBy("recipe").agg(F.count("*").alias("group_size"), best).filter("group_size > 1")
    groups = groups.select("recipe", "group_size", F.col("best.id").alias("keep_id"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    both = rows.withColumn("salt", salt).join(groups, ["recipe", "salt"], "left")
    single = F.col("group_size").isNull()
    keep = F.when(single, F.col("doc_id")).otherwise(F.col("keep_id"))
    return both.select(
        "doc_id",
        keep.alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        F.col("doc_id").eqNullSafe(keep).alias("kept"),
        "text_sha256",
    )


def distinct_texts(docs: DataFrame, **options) -> DataFrame:
    """One row of ``docs`` for each text, with its columns. Of rows that share an id and a text the one whose columns hash lowest
    stays; they are looked for only among ids that occur more than once."""
    stay = exact_dedup(docs, **options).filter("kept").select(F.col("doc_id").alias("__stay"), F.col("text_sha256").alias("__kept"))
    again = cut(docs.groupBy("doc_id").count().filter("count > 1").select(F.col("doc_id").alias("__again")))
    same = docs["doc_id"].eqNullSafe(stay["__stay"])
    if again.isEmpty():
        return docs.join(stay, same, "left_semi")
    several = docs["doc_id"].eqNullSafe(again["__again"])
    mark = F.xxhash64(*(F.to_json(F.struct(docs[c])) for c in docs.columns)).alias("__hash")
    rows = docs.join(again, several, "left_semi")
    rows = rows.select(F.struct(*(docs[c] for c in docs.columns)).alias("__row"), docs["doc_id"].alias("__id"), F.sha2(normalized(docs["text"]), 256).alias("__sha"), mark)
    rows = rows.join(stay, rows["__id"].eqNullSafe(stay["__stay"]) & (rows["__sha"] == stay["__kept"]), "left_semi")
    one = rows.groupBy("__id", "__sha").agg(F.min_by("__row", "__hash").alias("__row")).select("__row.*")
    return docs.join(again, several, "left_anti").join(stay, same, "left_semi").unionByName(one)


def op1_exact_dedup(spark, sf_dir):
    from .common import table

    return exact_dedup(table(spark, sf_dir, "documents"))


ORACLE = r"""
WITH n AS (
  SELECT doc_id, length(coalesce(text, '')) AS points, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm FROM documents
), g AS (
  SELECT doc_id, sha256(norm) AS text_sha256, count(*) OVER (PARTITION BY norm) AS group_size,
    first_value(doc_id) OVER (PARTITION BY norm ORDER BY points DESC, doc_id NULLS LAST) AS keep_id FROM n
)
SELECT doc_id, keep_id, CAST(group_size AS BIGINT) AS group_size, doc_id IS NOT DISTINCT FROM keep_id AS kept, text_sha256 FROM g
"""
