"""Document fingerprints by Merkle trees over sections, paragraphs and content-defined passages of paragraphs."""

from __future__ import annotations

import hashlib
import math
from collections import Counter
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from .common import shuffle_partitions
from .substring import LAST_ID

#: One in so many bytes ends a passage, on average; bytes that decide on an end; and the longest passage.
PASSAGE, BEHIND, LONGEST = 16, 8, 1 << 15
#: Bytes of a digest in a tree, and those of a node below the root in a fingerprint.
WHOLE, SHORT = 16, 4
#: How a fingerprint writes the numbers of parts of sections and paragraphs, and the bytes of passages.
WIDE = (">u4", ">u4", ">u2")
#: Bytes of a range of documents, at least; ranges are read in order, not held. Bytes that are fingerprinted at a time.
RANGE_BYTES, HELD = 512 << 20, 1 << 20
#: A fixed pseudorandom number for each byte.
GEAR = np.frombuffer(b"".join(hashlib.sha256(b"gear %d" % i).digest()[:4] for i in range(256)), np.uint32)


class Node(NamedTuple):
    """A part of a text: where it begins and ends, in bytes; its digest, of its bytes or of its parts' digests; its parts."""

    start: int
    end: int
    digest: bytes
    parts: tuple = ()


def digest(kind: bytes, parts: list[bytes]) -> bytes:
    h = hashlib.blake2b(kind, digest_size=WHOLE)
    for p in parts:
        h.update(p)
    return h.digest()


def passage_ends(text: bytes) -> np.ndarray:
    """Where passages end: after line ends, after bytes where a hash of the last ``BEHIND`` bytes says so (not twice in a run of
    one byte), after ``LONGEST`` bytes, and at the end. So a passage ends at the same places wherever it stands."""
    raw = np.frombuffer(text, np.uint8)
    if not len(raw):
        return np.zeros(0, np.int64)
    value = GEAR[raw]
    sums = value.copy()
    for k in range(1, min(BEHIND, len(raw))):
        sums[k:] += value[:-k] << np.uint32(k)
    stop = sums >> np.uint32(16) & np.uint32(PASSAGE - 1) == 0
    stop[1:] &= sums[1:] != sums[:-1]
    stop |= raw == 10
    stop[-1] = True
    ends = np.flatnonzero(stop) + 1
    sizes = np.diff(np.r_[0, ends])
    if (sizes > LONGEST).any():
        more = [np.arange(e - n + LONGEST, e, LONGEST) for e, n in zip(ends.tolist(), sizes.tolist(), strict=True) if n > LONGEST]
        ends = np.union1d(ends, np.concatenate(more))
    return ends


def tree(text: bytes) -> Node:
    """Root, sections (ended by blank lines), paragraphs (lines, with their ends), passages. Every byte is in one passage, so
    roots are equal just if texts are."""
    sections, paragraphs, passages, at, blank = [], [], [], 0, True
    hash_ = hashlib.blake2b

    def close(kind: bytes, parts: list[Node], into: list[Node]) -> None:
        if parts:
            into.append(Node(parts[0].start, parts[-1].end, digest(kind, [p.digest for p in parts]), tuple(parts)))
            parts.clear()

    for end in passage_ends(text).tolist():
        passage = text[at:end]
        passages.append(Node(at, end, hash_(passage, digest_size=WHOLE).digest()))
        blank = blank and passage.isspace()
        if passage[-1] == 10:
            close(b"p", passages, paragraphs)
            if blank:
                close(b"s", paragraphs, sections)
            blank = True
        at = end
    close(b"p", passages, paragraphs)
    close(b"s", paragraphs, sections)
    return Node(0, at, digest(b"r", [s.digest for s in sections]), tuple(sections))


def fingerprint(root: Node) -> str:
    """The root's digest (32 hex digits), and after a colon the tree: by level the nodes' short digests, in order, after their
    number; for sections and paragraphs also how many parts each has, and for passages their bytes."""
    out = []
    nodes = list(root.parts)
    for level in range(3):
        below = [p for n in nodes for p in n.parts]
        sizes = [n.end - n.start if level == 2 else len(n.parts) for n in nodes]
        out += [len(nodes).to_bytes(4, "big"), *(n.digest[:SHORT] for n in nodes), np.array(sizes, WIDE[level]).tobytes()]
        nodes = below
    return f"{root.digest.hex()}:{b''.join(out).hex()}"


def read(print_: str) -> list[tuple[list[int], list[int]]]:
    """The levels of a fingerprint: short digests, and numbers of parts or of bytes."""
    raw, at, out = bytes.fromhex(print_[2 * WHOLE + 1 :]), 0, []
    for wide in WIDE:
        n = int.from_bytes(raw[at : at + 4], "big")
        at += 4
        digests = np.frombuffer(raw, f">u{SHORT}", n, at).tolist()
        at += SHORT * n
        out.append((digests, np.frombuffer(raw, wide, n, at).tolist()))
        at += np.dtype(wide).itemsize * n
    return out


def unmatched(a: list[int], b: list[int]) -> tuple[list[int], list[int]]:
    """The places in two lists that no equal digest in the other list answers, the first ones first."""
    common = Counter(a) & Counter(b)
    if not common:
        return list(range(len(a))), list(range(len(b)))
    out = []
    for line in (a, b):
        left, rest = common.copy(), []
        for i, d in enumerate(line):
            n = left.get(d)
            if n:
                left[d] = n - 1
            else:
                rest.append(i)
        out.append(rest)
    return out[0], out[1]


def differing(a: str, b: str) -> tuple[list[int], list[int]]:
    """The passages, by number, in which two fingerprints differ: sections with equal digests are passed over, then equal
    paragraphs of the sections that are left, then equal passages of the paragraphs that are left."""
    return ([], []) if a[: 2 * WHOLE] == b[: 2 * WHOLE] else apart(read(a), read(b))


def apart(x: list, y: list) -> tuple[list[int], list[int]]:
    here = (list(range(len(x[0][0]))), list(range(len(y[0][0]))))
    for level in range(3):
        p, q = unmatched([x[level][0][i] for i in here[0]], [y[level][0][i] for i in here[1]])
        here = ([here[0][i] for i in p], [here[1][i] for i in q])
        if level < 2:
            ends = [np.cumsum([0, *t[level][1]]).tolist() for t in (x, y)]
            here = tuple([j for i in side for j in range(e[i], e[i + 1])] for side, e in zip(here, ends, strict=True))
    return here


def likeness(a: str, b: str) -> float:
    """From two fingerprints alone: the share of their bytes that stand in branches which both trees have; 1 for equal roots,
    0 if one text is empty and the other isn't."""
    if a[: 2 * WHOLE] == b[: 2 * WHOLE]:
        return 1.0
    return shared(read(a), read(b))


def shared(x: list, y: list) -> float:
    sizes = [x[2][1], y[2][1]]
    whole = sum(map(sum, sizes))
    lost = sum(sum(map(s.__getitem__, side)) for s, side in zip(sizes, apart(x, y), strict=True))
    return (whole - lost) / whole


def edits(a: str, b: str) -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
    """Where two texts differ, as ranges of bytes of either: the differing passages of their fingerprints, neighbours joined."""
    out = []
    for print_, side in zip((a, b), differing(a, b), strict=True):
        ends, ranges = np.cumsum([0, *read(print_)[2][1]]).tolist(), []
        for i in side:
            if ranges and ranges[-1][1] == ends[i]:
                ranges[-1] = (ranges[-1][0], ends[i + 1])
            else:
                ranges.append((ends[i], ends[i + 1]))
        out.append(ranges)
    return out[0], out[1]


def edited(text: str, following: str) -> str:
    """The last third of the code points replaced by as many of the next text's first ones, or all it has."""
    k = len(text) // 3
    return text[: len(text) - k] + following[:k]


def with_next(docs: DataFrame, work, schema: str, number: int | None = None) -> DataFrame:
    """``work(rows)`` for documents in descending order of id, ``rows`` being (id, text, next text), some at a time; the next
    of the last is the first.

    Ids alone are read for the bounds of ``number`` ranges (a range has ``RANGE_BYTES``, and there are no fewer than shuffle
    partitions) and for the largest id of each: two numbers a range, which workers get as arrays and search. Then every
    document moves once, to its range, and the one with a range's largest id to the range above as well, where it is the
    next of the last. A range is sorted by Spark and read in order, so a task holds some documents, however large its range.
    """
    size = docs.agg(F.sum(F.octet_length("text").cast("long")).alias("n")).first()["n"] or 0
    number = number or max(shuffle_partitions(docs.sparkSession), math.ceil(size / RANGE_BYTES))
    kind = docs.schema["doc_id"].dataType
    order = F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST_ID))
    ids = docs.select(order.alias("i"))
    found = ids.approxQuantile("i", [k / number for k in range(1, number)], 0.2 / number) if number > 1 else []
    bounds = np.unique(np.array(found, float).astype(np.int64)) if found else np.zeros(0, np.int64)

    place = StructType([StructField("to", IntegerType()), StructField("guest", IntegerType())])

    def placed(tops: np.ndarray | None):
        """Where a document of an id belongs, and where it is a guest, or -1."""

        @F.pandas_udf(place)
        def run(line):
            import pandas as pd

            i = line.to_numpy(np.int64)
            to = np.searchsorted(bounds, i, "right").astype(np.int32)
            guest = np.full(len(i), -1, np.int32)
            if tops is not None and len(tops) > 1:
                top = np.searchsorted(tops[:, 0], to)
                above = tops[(top + 1) % len(tops), 0].astype(np.int32)
                guest = np.where(tops[top, 1] == i, above, guest)
            return pd.DataFrame({"to": to, "guest": guest})

        return run

    largest = ids.select("i", placed(None)(F.col("i")).alias("p")).groupBy("p.to").agg(F.max("i").alias("top")).collect()
    tops = np.array(sorted((r["to"], r["top"]) for r in largest), np.int64).reshape(-1, 2)
    rows = docs.select("doc_id", "text", order.alias("i")).withColumn("p", placed(tops)(F.col("i")))
    visits = F.array(F.struct(F.col("p.to").alias("to"), F.lit(False).alias("guest")), F.struct(F.col("p.guest").alias("to"), F.lit(True).alias("guest")))
    dealt = rows.select("doc_id", "text", "i", F.explode(F.filter(visits, lambda v: v["to"] >= 0)).alias("v"))
    dealt = dealt.select(F.col("v.to").alias("range"), F.col("v.guest").alias("guest"), "doc_id", "text", "i")
    dealt = dealt.repartition(number, "range").sortWithinPartitions("range", "guest", F.desc("i"), "text").drop("i")

    def run(batches):
        here, first, last, held, size = None, None, None, [], 0

        def ended():
            # the last of a range without a guest: all documents are in this range
            return [(*last, first)] if last is not None else []

        for batch in batches:
            where, guests, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(3).cast(pa.binary())
            for k in range(batch.num_rows):
                text = (texts[k].as_py() or b"").decode("utf-8", "surrogatepass")
                if where[k] != here:
                    held += ended()
                    here, first, last = where[k], text, None
                if last is not None:
                    held.append((*last, text))
                    size += len(text)
                    last = None
                if not guests[k]:
                    last = (batch.column(2)[k], text)
                if size > HELD:
                    yield work(held)
                    held, size = [], 0
        held += ended()
        if held:
            yield work(held)

    return dealt.mapInArrow(run, f"doc_id {kind.simpleString()}, {schema}")


def merkle_fingerprints(docs: DataFrame) -> DataFrame:
    """Fingerprints of whole texts and of their edited texts: (``doc_id``, ``n_chars``, ``edited_sha256``,
    ``fingerprint``, ``edited_fingerprint``, ``near_edited``, ``near_next``).

    A fingerprint has the tree: sections, paragraphs and passages, all of them. ``near_edited`` and ``near_next`` are the
    likeness of a document's fingerprint to that of its edited text, and of the next document in descending order of id:
    the share of bytes in branches that both trees have, found by going down differing branches alone. What was edited is
    told apart by passages of about ``PASSAGE`` bytes, so short texts are measured roughly.

    Null text: as empty; two empty texts are alike, an empty and another one are not. Null ``doc_id``: as the largest, so
    first in that order. Rows that share an id: by text. Very long texts: held singly. A single row is its own next.
    Empty table: empty result. Other columns are not read.
    """

    def work(rows):
        raw = lambda t: t.encode("utf-8", "surrogatepass")
        seen: dict[str, tuple[str, list]] = {}

        def print_of(text: str) -> tuple[str, list]:
            made = fingerprint(tree(raw(text)))
            return made, read(made)

        def kept(text: str) -> tuple[str, list]:
            # a document's next one is the document after it
            if text not in seen:
                seen[text] = print_of(text)
            return seen[text]

        near = lambda a, b: 1.0 if a[0][: 2 * WHOLE] == b[0][: 2 * WHOLE] else shared(a[1], b[1])
        changed = [edited(t, n) for _, t, n in rows]
        own, next_ = [kept(t) for _, t, _ in rows], [kept(n) for _, _, n in rows]
        new, near_edited = [], []
        for text, mine in zip(changed, own, strict=True):
            there = print_of(text)
            new.append(there[0])
            near_edited.append(near(mine, there))
        columns = {
            "doc_id": pa.array([i.as_py() for i, _, _ in rows], rows[0][0].type),
            "n_chars": pa.array([len(t) for _, t, _ in rows], pa.int64()),
            "edited_sha256": pa.array([hashlib.sha256(raw(t)).hexdigest() for t in changed], pa.string()),
            "fingerprint": pa.array([f for f, _ in own], pa.string()),
            "edited_fingerprint": pa.array(new, pa.string()),
            "near_edited": pa.array(near_edited, pa.float64()),
            "near_next": pa.array(list(map(near, own, next_)), pa.float64()),
        }
        return pa.RecordBatch.from_pydict(columns)

    return with_next(docs, work, "n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


def op8_merkle_fingerprints(spark, sf_dir):
    from .common import table

    return merkle_fingerprints(table(spark, sf_dir, "documents"))
