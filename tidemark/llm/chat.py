"""Chat formatting of reply trees."""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

#: The strings that mark turns. None of them may stand in an escaped text.
CONTROL = ("<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "[ROLE]", "[/ROLE]")
STARTS = re.compile("|".join(map(re.escape, sorted(CONTROL, key=len, reverse=True))))


def escape(text: str) -> str:
    """Doubles backslashes, and puts one after the first character of each control string."""
    text = text.replace("\\", "\\\\")
    while True:
        # a string that begins within another one stays after the first pass
        new = STARTS.sub(lambda m: m[0][0] + "\\" + m[0][1:], text)
        if new == text:
            return text
        text = new


def unescape(text: str) -> str:
    return re.sub(r"\\(\\?)", r"\1", text)


def format_turns(turns: list[tuple[str | None, str | None]]) -> tuple[str, list[tuple[int, int]]]:
    """Turns (role, text) as one string, and the spans in it that a loss is taken over: the texts of the assistant.

    A user's turn is ``<s>[INST] text [/INST]``, an assistant's ``<s> text </s>``, a system's ``<s><<SYS>> text
    <</SYS>>``, any other's ``<s>[ROLE] role [/ROLE] text </s>``; a null role is the role of no characters.
    """
    out, spans, at = [], [], 0
    for role, text in turns:
        body = escape(text or "")
        if role == "user":
            head, tail = "<s>[INST] ", " [/INST]"
        elif role == "assistant":
            head, tail = "<s> ", " </s>"
            spans.append((at + len(head), at + len(head) + len(body)))
        elif role == "system":
            head, tail = "<s><<SYS>> ", " <</SYS>>"
        else:
            head, tail = f"<s>[ROLE] {escape(role or '')} [/ROLE] ", " </s>"
        out.append(head + body + tail)
        at += len(out[-1])
    return "".join(out), spans


def parse(formatted: str) -> list[tuple[str, str]]:
    """The turns of a formatted string."""
    out = []
    for part in formatted.split("<s>")[1:]:
        if part.startswith("[INST] "):
            role, body = "user", part[7:-8]
        elif part.startswith("<<SYS>> "):
            role, body = "system", part[8:-9]
        elif part.startswith("[ROLE] "):
            role, _, body = part[7:-5].partition(" [/ROLE] ")
            role = unescape(role)
        else:
            role, body = "assistant", part[1:-5]
        out.append((role, unescape(body)))
    return out


def totals(nodes: DataFrame) -> DataFrame:
    """For each node that leads to a root, what lies on the way: (``tree``, ``node``, ``total`` score, ``steps`` nodes).

    ``nodes``: (``tree``, ``node``, ``parent``, ``score``). Each round joins the ways so far with themselves, so they double:
    log2(depth) rounds, written to the checkpoint folder. Ways that have come to a root are not joined any more.
    """
    way = cut(nodes.select("tree", "node", F.col("parent").alias("above"), F.col("score").alias("total"), F.lit(1).cast("long").alias("steps")))
    most, length = way.groupBy("tree").count().agg(F.max("count")).first()[0] or 0, 1
    done, going = way.filter("above is null"), way.filter("above is not null")
    while length <= most and not going.isEmpty():
        further = done.unionByName(going).select("tree", F.col("node").alias("above"), F.col("above").alias("top"), F.col("total").alias("more"), F.col("steps").alias("longer"))
        joined = going.join(further, ["tree", "above"])
        way = cut(joined.select("tree", "node", F.col("top").alias("above"), (F.col("total") + F.col("more")).alias("total"), (F.col("steps") + F.col("longer")).alias("steps")))
        done, going = done.unionByName(way.filter("above is null")), way.filter("above is not null")
        length *= 2
    # what still has a node above leads into a cycle, and so to no root
    return done.select("tree", "node", "total", "steps")


def paths(nodes: DataFrame, leaves: DataFrame) -> DataFrame:
    """The paths from ``leaves`` (``tree``, ``leaf``) to the roots: (``tree``, ``leaf``, ``node``, ``steps`` from the leaf).

    Iterative self-joins: the links to the nodes 1, 2, 4, ... steps up are joined with themselves, so a tree of depth d takes
    log2(d) rounds; and the paths so far are joined with the links of that length, which doubles them. Each round is
    written to the checkpoint folder. Rows are as many as the chosen paths have nodes.
    """
    up = nodes.filter("parent is not null").select("tree", "node", F.col("parent").alias("above"))
    path = leaves.select("tree", "leaf", F.col("leaf").alias("node"), F.lit(0).cast("long").alias("steps"))
    length, most = 1, nodes.groupBy("tree").count().agg(F.max("count")).first()[0] or 0
    while length <= most:
        up = cut(up)
        if up.isEmpty():
            break
        longer = path.join(up, ["tree", "node"]).select("tree", "leaf", F.col("above").alias("node"), (F.col("steps") + length).alias("steps"))
        path = cut(path.unionByName(longer))
        further = up.select("tree", F.col("node").alias("above"), F.col("above").alias("top"))
        up = up.join(further, ["tree", "above"]).select("tree", "node", F.col("top").alias("above"))
        length *= 2
    return path


def format_trees(nodes: DataFrame, keep: int | None = 1) -> DataFrame:
    """One formatted conversation per chosen path: (``tree``, ``leaf``, ``rank``, ``score``, ``formatted``,
    ``loss_spans`` array of (start, end) in code points).

    ``nodes``: (``tree``, ``node``, ``parent``, ``role``, ``text``, ``score``). The branches of a tree are ranked by the
    mean score of their nodes, then by leaf; ``keep`` of each tree are formatted, null for all. Scores are added up along
    the trees and ranked first; only chosen paths are laid out, and only their texts joined. A path's turns come together
    in one row, as they do in its string.

    Null text and null role: as empty. Null score: counts as 0. Null tree: a tree like any other. A parent that isn't there
    makes a node a root; nodes in a cycle, and those that lead into one, are on no path. Empty table: empty result. Other
    columns are not read.
    """
    kind = nodes.schema["tree"].dataType.simpleString()
    # a tree's id in a struct, as a null in it equals a null
    nodes = cut(nodes.select(F.struct(F.col("tree").alias("id")).alias("tree"), "node", "parent", "role", "text", F.coalesce("score", F.lit(0.0)).cast("double").alias("score")))
    there = nodes.select("tree", F.col("node").alias("parent"), F.lit(True).alias("there"))
    links = nodes.select("tree", "node", "parent", "score").join(there, ["tree", "parent"], "left")
    links = cut(links.select("tree", "node", F.when(F.col("there"), F.col("parent")).alias("parent"), "score"))
    parents = links.filter("parent is not null").select("tree", F.col("parent").alias("node")).distinct()
    leaves = totals(links).join(parents, ["tree", "node"], "left_anti").select("tree", F.col("node").alias("leaf"), (F.col("total") / F.col("steps")).alias("path_score"))
    ranked = leaves.withColumn("rank", F.row_number().over(Window.partitionBy("tree").orderBy(F.desc("path_score"), "leaf")))
    if keep is not None:
        ranked = ranked.filter(F.col("rank") <= keep)
    ranked = cut(ranked)
    turns = paths(links, ranked).join(ranked, ["tree", "leaf"]).join(nodes.select("tree", "node", "role", "text"), ["tree", "node"])
    told = turns.groupBy("tree", "leaf", "rank", "path_score").agg(F.sort_array(F.collect_list(F.struct((-F.col("steps")).alias("at"), "role", "text"))).alias("turns"))
    told = told.select(F.col("tree.id").alias("tree"), "leaf", "rank", "path_score", F.col("turns.role").alias("roles"), F.transform("turns", lambda t: F.coalesce(t["text"], F.lit(""))).alias("texts"))

    def run(batches):
        for batch in batches:
            made = [format_turns(list(zip(r, t, strict=True))) for r, t in zip(batch.column(4).to_pylist(), batch.column(5).to_pylist(), strict=True)]
            spans = pa.array([[{"start": a, "end": b} for a, b in s] for _, s in made], pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array([f for f, _ in made], pa.string()), spans], names=["tree", "leaf", "rank", "score", "formatted", "loss_spans"])

    types = {f.name: f.dataType.simpleString() for f in told.schema}
    return told.mapInArrow(run, f"tree {kind}, leaf {types['leaf']}, rank int, score double, formatted string, loss_spans array<struct<start:int,end:int>>")


def conversation_nodes(conversations: DataFrame) -> DataFrame:
    """A conversation as a tree of one branch: each turn replies to the one before, in order of turn (null last), role and text.
    Rows without an id are one conversation; repeated rows are turns each."""
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_last(), "role", "text")
    at = F.row_number().over(order).cast("long")
    rows = conversations.select(F.col("conv_id").alias("tree"), at.alias("node"), "role", "text")
    return rows.withColumn("parent", F.when(F.col("node") > 1, F.col("node") - 1)).withColumn("score", F.length(F.coalesce("text", F.lit(""))).cast("double"))


def digests(formatted: DataFrame) -> DataFrame:
    """What is read back from formatted strings and their loss spans."""

    def run(batches):
        for batch in batches:
            rows = []
            for text, spans in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                turns = parse(text)
                loss = "".join(unescape(text[s["start"] : s["end"]]) for s in spans)
                told = hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode("utf-8", "surrogatepass")).hexdigest()
                rows.append((len(turns), told, len(loss), hashlib.sha256(loss.encode("utf-8", "surrogatepass")).hexdigest(), len(text)))
            columns = list(zip(*rows, strict=True)) if rows else [()] * 5
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    kind = formatted.schema["tree"].dataType.simpleString()
    return formatted.select("tree", "formatted", "loss_spans").mapInArrow(run, f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def op10_chat_format(spark, sf_dir):
    from .common import table

    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    more = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    return digests(format_trees(conversation_nodes(rows.unionByName(more))))


def escaped_sql(text: str) -> str:
    out = f"replace({text}, '\\', '\\\\')"
    for c in sorted(CONTROL, key=len, reverse=True):
        out = f"replace({out}, '{c}', '{c[0]}\\{c[1:]}')"
    return out


ORACLE = rf"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text, role AS r, text AS t FROM conversations
  UNION ALL SELECT -1, v.turn, v.role, '</s>[INST] ok [/INST]', v.role, '</s>[INST] ok [/INST]' FROM (VALUES (0, 'user'), (1, 'assistant')) AS v(turn, role)
), e AS (
  SELECT *, length({escaped_sql('text')}) + CASE role WHEN 'user' THEN {len('<s>[INST] ' + ' [/INST]')} WHEN 'assistant' THEN {len('<s> ' + ' </s>')} WHEN 'system' THEN {len('<s><<SYS>> ' + ' <</SYS>>')}
    ELSE {len('<s>[ROLE] ' + ' [/ROLE] ' + ' </s>')} + length({escaped_sql('role')}) END AS chars,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS LAST, r NULLS FIRST, t NULLS FIRST) AS place FROM c
), g AS (
  SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY place) AS told, coalesce(string_agg(text, '' ORDER BY place) FILTER (role = 'assistant'), '') AS loss, sum(chars) AS chars FROM e GROUP BY conv_id
)
SELECT conv_id, n_turns, sha256(told) AS turns_sha256, CAST(length(loss) AS BIGINT) AS loss_chars, sha256(loss) AS loss_sha256, CAST(chars AS BIGINT) AS formatted_chars FROM g
"""
