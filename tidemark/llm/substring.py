"""Repeated passages by level-wise doubling."""

from __future__ import annotations

import hashlib
import math
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import shuffle_partitions

#: An odd multiplier for rolling hashes modulo 2^64, and its inverse.
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
#: Bytes of whole texts that are hashed at a time.
SEGMENT = 1 << 20
GAP = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])


def byte_values() -> np.ndarray:
    """A fixed pseudorandom 64-bit value for each byte."""
    return np.frombuffer(b"".join(hashlib.sha256(b"byte %d" % i).digest()[:8] for i in range(256)), np.uint64)


VALUES = byte_values()


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit over all."""
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ x >> np.uint64(shift)) * np.uint64(factor)
    return x ^ x >> np.uint64(31)


@lru_cache(maxsize=1)
def kept_powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    out = []
    for base in (BASE, INVERSE):
        row = np.full(size, base, np.uint64)
        row[:1] = 1
        out.append(np.multiply.accumulate(row))
    return tuple(out)


def powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, ``size`` of each or more."""
    return kept_powers(max(2 * SEGMENT, size))


class Words:
    """The words of several texts: where each begins and ends in the joined bytes, and which text it belongs to."""

    def __init__(self, texts: list[bytes]):
        joined = np.frombuffer(b" ".join([*texts, b""]), np.uint8) if texts else np.zeros(0, np.uint8)
        gap = GAP[joined]
        kept = ~gap
        kept[1:] |= ~gap[:-1]  # the first white space after a word
        line = joined[kept]
        line = np.where(GAP[line], np.uint8(32), line)
        self.line = line
        self.ends = np.flatnonzero(line == 32)
        self.starts = np.r_[0, self.ends[:-1] + 1] if len(self.ends) else np.zeros(0, np.int64)
        sizes = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
        edges = np.r_[0, np.cumsum(sizes)]
        before = np.r_[0, np.cumsum(kept & gap)]
        #: Words before each text, and in all.
        self.at = before[edges] if len(texts) else np.zeros(1, np.int64)
        self.doc = np.repeat(np.arange(len(texts)), np.diff(self.at))

    def windows(self, width: int) -> np.ndarray:
        """The first words of all windows of ``width`` words of one text."""
        n = len(self.starts) - width + 1
        return np.flatnonzero(self.doc[:n] == self.doc[width - 1 :]) if n > 0 else np.zeros(0, np.int64)

    def between(self, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """64-bit hashes of what stands from the word ``first`` to the word ``last`` of one text, joined by single spaces.
        ``first`` ascends. Works through whole texts of about ``SEGMENT`` bytes at a time, so memory stays bounded."""
        out, at = np.zeros(len(first), np.uint64), 0
        if len(first):  # the byte after the last word of each text, or of one before it
            edges = np.where(self.at[1:] > 0, self.ends[np.maximum(self.at[1:], 1) - 1], 0)
        while at < len(first):
            d = int(self.doc[first[at]])
            begin = int(self.starts[self.at[d]])
            stop = max(d + 1, int(np.searchsorted(edges, begin + SEGMENT, "right")))
            end = int(edges[stop - 1])
            to = int(np.searchsorted(first, self.at[stop], "left"))
            power, back = powers(end - begin)
            sums = np.zeros(end - begin + 1, np.uint64)
            np.cumsum(VALUES[self.line[begin:end]] * power[: end - begin], out=sums[1:])
            s, e = self.starts[first[at:to]] - begin, self.ends[last[at:to]] - begin
            out[at:to] = (sums[e] - sums[s]) * back[s]
            at = to
        return out

    def hashes(self, first: np.ndarray, width: int) -> np.ndarray:
        """64-bit hashes of the windows of ``width`` words that begin at ``first``. Equal windows have equal ones; unequal ones
        may, if their words are made for it, so they only filter."""
        return mixed(self.between(first, first + width - 1) + np.uint64(width))

    def digests(self, first: np.ndarray, width: int) -> np.ndarray:
        """BLAKE2 digests of 128 bits of the windows' bytes, as rows of two numbers."""
        line, hash_ = memoryview(self.line.tobytes()), hashlib.blake2b
        raw = b"".join([hash_(line[a:b], digest_size=16).digest() for a, b in zip(self.starts[first].tolist(), self.ends[first + width - 1].tolist(), strict=True)])
        return np.frombuffer(raw, ">u8").astype(np.uint64).reshape(-1, 2)


def levels(start: int, target: int) -> list[int]:
    """``start``, twice that, and so on up to ``target``."""
    out = [min(start, target)]
    while out[-1] < target:
        out.append(min(2 * out[-1], target))
    return out


class Block:
    """The windows of a block of documents, level by level. ``ids``: numbers that order the documents, in any order; rows of
    one number are one document."""

    def __init__(self, ids: np.ndarray, texts: list[bytes], bucket_bits: int):
        self.words, self.bits = Words(texts), bucket_bits
        self.id = ids[self.words.doc] if len(ids) else np.zeros(0, np.int64)
        self.alive: np.ndarray | None = None
        self.width = 0

    def level(self, width: int, last: bool) -> None:
        """Go on to windows of ``width`` words: those whose two halves, of the last width, both survived."""
        first = self.words.windows(width)
        if self.alive is not None:
            first = first[self.alive[first] & self.alive[first + width - self.width]]
        self.first, self.width, self.last = first, width, last
        if last:
            keys = self.words.digests(first, width)
            self.order = np.lexsort((keys[:, 1], keys[:, 0]))
        else:
            keys = self.words.hashes(first, width)[:, None]
            self.order = np.argsort(keys[:, 0], kind="stable")
        ordered = keys[self.order]
        step = np.r_[True, (ordered[1:] != ordered[:-1]).any(axis=1)] if len(ordered) else np.zeros(0, bool)
        begin = np.flatnonzero(step)
        self.group = np.cumsum(step) - 1
        #: The distinct keys, sorted; the smallest id of each; and whether several documents of the block have it.
        self.keys = ordered[step]
        owner = self.id[first][self.order]
        self.least = np.minimum.reduceat(owner, begin) if len(begin) else np.zeros(0, np.int64)
        self.several = (np.maximum.reduceat(owner, begin) != self.least) if len(begin) else np.zeros(0, bool)
        #: For each window, whether a document of the block with a smaller id has it.
        self.later = owner > self.least[self.group] if len(owner) else np.zeros(0, bool)

    def settle(self, elsewhere: np.ndarray) -> None:
        """``elsewhere``: for each key, whether another block has it (on the last level: with a smaller id)."""
        hit = (elsewhere[self.group] | self.later) if self.last else (elsewhere | self.several)[self.group]
        self.alive = np.zeros(len(self.words.starts) + 1, bool)
        self.alive[self.first[self.order[hit]]] = True

    def sent(self) -> tuple[np.ndarray, np.ndarray, bytes]:
        """The keys as (bucket, number of keys, their bytes): on the last level all of a key and the smallest id that has it,
        on the others ``KEY`` bytes of the key."""
        bucket = (self.keys[:, 0] >> np.uint64(64 - self.bits)).astype(np.int64)
        which, counts = np.unique(bucket, return_counts=True)
        if self.last:
            return which, counts, np.c_[self.keys, self.least.view(np.uint64)].astype(">u8").tobytes()
        rest = self.keys[:, 0] << np.uint64(self.bits)
        return which, counts, np.ascontiguousarray(rest.astype(">u8").view(np.uint8).reshape(-1, 8)[:, :KEY]).tobytes()


#: Bytes of a key on the levels that only filter, and of a key with an id on the last.
KEY, LAST_KEY = 4, 24


def replay(ids, texts, answers: list[tuple[int, int, bytes]], widths: list[int], bits: int, upto: int) -> Block:
    """The block on level ``upto``, with the answers (level, bucket, bits) of the levels before it settled."""
    block = Block(ids, texts, bits)
    by_level: dict[int, dict[int, bytes]] = {}
    for level, bucket, hits in answers:
        by_level.setdefault(level, {})[bucket] = hits
    for k in range(upto + 1):
        if k == len(widths):
            break
        block.level(widths[k], k == len(widths) - 1)
        if k == upto:
            break
        elsewhere = np.zeros(len(block.keys), bool)
        which, counts, _ = block.sent()
        at = 0
        for b, n in zip(which.tolist(), counts.tolist(), strict=True):
            hits = by_level.get(k, {}).get(b)
            if hits is not None:
                elsewhere[at : at + n] = np.unpackbits(np.frombuffer(hits, np.uint8), count=n)
            at += n
        block.settle(elsewhere)
    return block


def heard(raw: list[bytes], last: bool) -> list[bytes]:
    """What a bucket answers to the keys of each block: one bit a key, whether another block has it too; on the last level,
    whether one has it with a smaller id."""
    size = LAST_KEY if last else KEY
    counts = np.array([len(x) // size for x in raw], np.int64)
    source = np.repeat(np.arange(len(counts)), counts)
    if last:
        told = np.frombuffer(b"".join(raw), ">u8").astype(np.uint64).reshape(-1, 3)
        owner = told[:, 2].copy().view(np.int64)
        order = np.lexsort((told[:, 1], told[:, 0]))
        ordered = told[order, :2]
    else:
        told = np.frombuffer(b"".join(raw), f">u{KEY}").astype(np.uint64).reshape(-1, 1)
        owner = source
        order = np.argsort(told[:, 0], kind="stable")
        ordered = told[order]
    step = np.r_[True, (ordered[1:] != ordered[:-1]).any(axis=1)] if len(ordered) else np.zeros(0, bool)
    begin = np.flatnonzero(step)
    hit = np.zeros(len(order), bool)
    if len(begin):
        group, mine = np.cumsum(step) - 1, owner[order]
        low = np.minimum.reduceat(mine, begin)
        # cut keys may come twice from one block: what counts is whether there are two blocks
        hit[order] = mine > low[group] if last else (np.maximum.reduceat(mine, begin) != low)[group]
    at = np.r_[0, np.cumsum(counts)]
    return [np.packbits(hit[a:b]).tobytes() for a, b in zip(at, at[1:], strict=False)]


def documents_of(table: pa.Table) -> tuple[np.ndarray, pa.Array, list[bytes]]:
    """Numbers that order the documents of a block (null ids after all), the ids, and the texts."""
    ids = table.column("doc_id").combine_chunks()
    order = np.asarray(pc.fill_null(ids.cast(pa.int64()), LAST_ID))
    return order, ids, [t or b"" for t in table.column("text").cast(pa.binary()).to_pylist()]


#: What stands for a null id, after all others.
LAST_ID = 2**63 - 1
#: Bytes of text that a block of documents should hold.
BLOCK_BYTES = 8 << 20


def n_blocks(docs: DataFrame) -> int:
    """Blocks of about ``BLOCK_BYTES``, and no fewer than there are shuffle partitions; reads the texts' lengths."""
    size = docs.agg(F.sum(F.octet_length("text").cast("long")).alias("n")).first()["n"] or 0
    return max(shuffle_partitions(docs.sparkSession), math.ceil(size / BLOCK_BYTES))


def repeated_passages(docs: DataFrame, target: int = 13, start: int = 4, number: int | None = None) -> DataFrame:
    """Removes each word that is covered by a window of ``target`` words which a document with a smaller id has too:
    (``doc_id``, ``n_words``, ``n_removed``, ``kept_sha256``, ``kept_text``).

    Level-wise doubling: windows of ``start`` words come first; those that no other document has are dropped, and only
    windows whose two halves both survived are looked at with twice the length, up to ``target``, where a window goes
    if a document with a smaller id has it. A level without candidates sends nothing.

    Documents are dealt once into blocks of about ``BLOCK_BYTES`` by a hash of id and text, so neither an order of all
    documents nor a table of blocks is needed, and rows of one id are spread; all levels reuse that one exchange. Within a
    block equal windows meet in memory, and each distinct one is sent once to one of 2^b buckets; the answer is one bit. So
    a passage that a third of all documents share reaches a bucket once per block, not once per document. A message holds
    the keys that a block has for a bucket, so there are never more messages than distinct windows. On the levels that
    only filter a key is 4 bytes of a hash, and what is taken for repeated by chance is looked at once more with the next
    width. On the last level keys are BLAKE2 digests of 128 bits of the whole window, each with the smallest id that the
    block has for it; they decide, so no structure of words makes two windows one.

    Words are as the contract says, unchanged; windows are judged on the input. Null, empty and blank texts: no words.
    Null ``doc_id``: after all ids, one document. Rows that share an id are one document, which doesn't repeat itself.
    Very long texts: held singly, in one block. Empty table: empty result. Other columns are not read.
    """
    spark = docs.sparkSession
    number = number or n_blocks(docs)
    bits = max(7, math.ceil(math.log2(number)) - 1)
    widths = levels(start, target)
    id_type = docs.schema["doc_id"].dataType.simpleString()
    texts = docs.select(F.pmod(F.xxhash64("doc_id", "text"), F.lit(number)).cast("int").alias("block"), "doc_id", "text")
    n_levels = len(widths)

    def settled(table, answers, upto: int) -> tuple:
        order, ids, bodies = documents_of(table)
        known = list(zip(*(answers.column(c).to_pylist() for c in ("level", "bucket", "hits")), strict=True)) if answers.num_rows else []
        return ids, replay(order, bodies, known, widths, bits, upto)

    def ask(k: int):
        def run(key, table, answers):
            _, block = settled(table, answers, k)
            which, counts, raw = block.sent()
            offsets = np.r_[0, np.cumsum(counts * (LAST_KEY if block.last else KEY))].astype(np.int64)
            keys = pa.Array.from_buffers(pa.large_binary(), len(which), [None, pa.py_buffer(offsets), pa.py_buffer(raw)]).cast(pa.binary())
            return pa.table({"bucket": pa.array(which, pa.int32()), "block": pa.array(np.full(len(which), key[0].as_py()), pa.int32()), "keys": keys})

        return run

    def answer(k: int):
        def run(key, table):
            hits = heard(table.column("keys").to_pylist(), k == n_levels - 1)
            return pa.table({"block": table.column("block").combine_chunks(), "level": pa.array([k] * len(hits), pa.int32()), "bucket": pa.array([key[0].as_py()] * len(hits), pa.int32()), "hits": pa.array(hits, pa.binary())})

        return run

    def finish(key, table, answers):
        ids, block = settled(table, answers, n_levels)
        words = block.words
        cover = np.zeros(len(words.starts) + target + 1, np.int64)
        hit = np.flatnonzero(block.alive)
        np.add.at(cover, hit, 1)
        np.add.at(cover, hit + target, -1)
        gone = np.cumsum(cover)[: len(words.starts)] > 0
        line, starts, ends, at = words.line.tobytes(), words.starts, words.ends, words.at
        n_words, n_removed, texts_, digests = [], [], [], []
        for d in range(len(ids)):
            a, b = int(at[d]), int(at[d + 1])
            removed = int(gone[a:b].sum())
            if a == b:
                kept = b""
            elif not removed:
                kept = line[starts[a] : ends[b - 1]]
            else:
                stay = ~gone[a:b]
                edge = np.flatnonzero(np.diff(np.r_[False, stay, False].astype(np.int8)))
                kept = b" ".join([line[starts[a + i] : ends[a + j - 1]] for i, j in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True)])
            n_words.append(b - a)
            n_removed.append(removed)
            digests.append(hashlib.sha256(kept).hexdigest())
            texts_.append(kept)
        return pa.table({"doc_id": ids, "n_words": pa.array(n_words, pa.int64()), "n_removed": pa.array(n_removed, pa.int64()), "kept_sha256": pa.array(digests, pa.string()), "kept_text": pa.array(texts_, pa.binary()).cast(pa.string())})

    answers = spark.createDataFrame([], "block int, level int, bucket int, hits binary")
    for k in range(n_levels):
        asked = texts.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(ask(k), "bucket int, block int, keys binary")
        told = asked.groupBy("bucket").applyInArrow(answer(k), "block int, level int, bucket int, hits binary")
        answers = told if k == 0 else answers.unionByName(told)
    return texts.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(finish, f"doc_id {id_type}, n_words long, n_removed long, kept_sha256 string, kept_text string")


def op3_repeated_passages(spark, sf_dir):
    from .common import table

    return repeated_passages(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", "kept_sha256")


ORACLE = r"""
WITH w AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents
), p AS (
  SELECT doc_id, unnest(range(1, len(ws) - 11)) AS place, ws FROM w
), v AS (
  SELECT doc_id, place, array_to_string(ws[place : place + 12], ' ') AS win FROM p
), h AS (
  SELECT doc_id, place, doc_id > min(doc_id) OVER (PARTITION BY win) AS again FROM v
), gone AS (
  SELECT DISTINCT doc_id, place + unnest(range(0, 13)) AS place FROM h WHERE again
), each AS (
  SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS place FROM w
), marked AS (
  SELECT e.doc_id, e.word, e.place, g.place IS NOT NULL AS gone FROM each e LEFT JOIN gone g ON g.doc_id = e.doc_id AND g.place = e.place
), told AS (
  SELECT doc_id, count(*) AS n_words, count(*) FILTER (gone) AS n_removed, coalesce(string_agg(word, ' ' ORDER BY place) FILTER (NOT gone), '') AS kept FROM marked GROUP BY 1
)
SELECT w.doc_id, CAST(coalesce(n_words, 0) AS BIGINT) AS n_words, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM w LEFT JOIN told t ON t.doc_id = w.doc_id
"""
