"""SimHash near-duplicates by anchor-point covering."""

from __future__ import annotations

from collections import defaultdict
from functools import cache
from itertools import combinations, pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, cut, labelled

LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
#: Members of an anchor that one task compares; larger anchors are dealt out as cells of two slices.
SLICE = 20_000
#: Distinct fingerprints up to which three blocks are used, and beyond which two.
THREE_BLOCKS = 1 << 24
SIGN = np.uint64(1 << 63)


def shingle_hashes(text: bytes, width: int = 4) -> list[int]:
    """XXH64 (seed 42) of each shingle of ``width`` words of a text in UTF-8, A-Z lowered; of all words if there are fewer."""
    from xxhash import xxh64_intdigest

    words = text.translate(LOWER).split()
    n = len(words)
    if not n:
        return []
    line = b" ".join(words)
    if n <= width:
        return [xxh64_intdigest(line, 42)]
    lengths = np.fromiter(map(len, words), np.int64, n)
    ends = np.cumsum(lengths + 1) - 1
    starts = (ends - lengths)[: n - width + 1].tolist()
    return [xxh64_intdigest(line[s:e], 42) for s, e in zip(starts, ends[width - 1 :].tolist(), strict=True)]


def majority(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Fingerprints of consecutive runs of hashes; ``counts`` has the length of each run. A bit is set if it is in over
    half the run; an empty run gives zero."""
    out = np.zeros(len(counts), np.uint64)
    some = np.flatnonzero(counts)
    if len(some):
        ends = np.cumsum(counts[some])
        bits = np.unpackbits(hashes.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        sums = np.add.reduceat(bits, ends - counts[some], axis=0, dtype=np.int32)
        out[some] = np.packbits(sums * 2 > counts[some][:, None], axis=1).view(">u8")[:, 0]
    return out


def fingerprint_batches(width: int):
    def run(batches):
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1).cast(pa.binary())
            prints, hashes, counts, held = [], [], [], 0
            for text in texts:
                h = shingle_hashes(text.as_py() or b"", width)
                hashes.append(np.array(h, np.uint64))
                counts.append(len(h))
                held += len(h)
                if held > 50_000:
                    prints.append(majority(np.concatenate(hashes), np.array(counts)))
                    hashes, counts, held = [], [], 0
            if counts:
                prints.append(majority(np.concatenate(hashes), np.array(counts)))
            found = np.concatenate(prints) if prints else np.zeros(0, np.uint64)
            yield pa.RecordBatch.from_arrays([ids, pa.array(found.view(np.int64))], names=["doc_id", "fp"])

    return run


def fingerprints(docs: DataFrame, width: int = 4) -> DataFrame:
    """(``doc_id``, ``fp`` long: the 64 bits of the SimHash of the whole text)."""
    return docs.select("doc_id", "text").mapInArrow(fingerprint_batches(width), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, fp long")


class Code:
    """A covering code of the words of ``bits`` bits: a Hamming code on the first 2^r - 1 bits, any bits after them.

    As the Hamming code is perfect, every word is within one bit of a codeword: the covering radius is 1.
    """

    def __init__(self, bits: int, radius: int):
        self.bits, self.r = bits, (bits + 1).bit_length() - 1
        self.n = (1 << self.r) - 1
        #: Syndromes of the low and the high 16 bits of a word.
        self.low, self.high = (self._syndromes(at) for at in (0, 16))
        errors = defaultdict(list)
        for weight in range(radius + 1):
            for places in combinations(range(bits), weight):
                syndrome = 0
                for i in places:
                    syndrome ^= i + 1 if i < self.n else 0
                errors[syndrome].append(sum(1 << i for i in places))
        #: By syndrome: what to flip to reach each codeword within the radius.
        self.errors = [np.array(errors[s], np.uint64) for s in range(1 << self.r)]

    def _syndromes(self, at: int) -> np.ndarray:
        out, words = np.zeros(1 << 16, np.uint64), np.arange(1 << 16)
        for i in range(16):
            if at + i < self.n:
                out ^= np.where(words >> i & 1, at + i + 1, 0).astype(np.uint64)
        return out

    def syndrome(self, words: np.ndarray) -> np.ndarray:
        return self.low[words & np.uint64(0xFFFF)] ^ self.high[words >> np.uint64(16) & np.uint64(0xFFFF)]

    def home(self, words: np.ndarray) -> np.ndarray:
        """The nearest codeword."""
        s = self.syndrome(words)
        return np.where(s > 0, words ^ (np.uint64(1) << (np.maximum(s, 1) - np.uint64(1))), words)

    def near(self, words: np.ndarray):
        """All codewords within the radius, as (place of the word, codeword)."""
        s = self.syndrome(words)
        for syndrome, errors in enumerate(self.errors):
            at = np.flatnonzero(s == syndrome)
            if len(at) and len(errors):
                yield np.repeat(at, len(errors)), (words[at][:, None] ^ errors[None, :]).ravel()


@cache
def blocks(number: int, threshold: int) -> list[tuple[int, Code]]:
    """The 64 bits as ``number`` blocks, each as (first bit, its code with radius 1 + floor(threshold / number))."""
    cuts = [64 * i // number for i in range(number + 1)]
    return [(a, Code(b - a, 1 + threshold // number)) for a, b in pairwise(cuts)]


def anchor_batches(number: int, threshold: int):
    def run(batches):
        for batch in batches:
            prints = np.asarray(batch.column(0)).view(np.uint64)
            for k, (first, code) in enumerate(blocks(number, threshold)):
                words = prints >> np.uint64(first) & np.uint64((1 << code.bits) - 1)
                home, at, anchors = code.home(words), [], []
                for i, a in code.near(words):
                    at.append(i)
                    anchors.append(a)
                if not at:
                    continue
                at, anchors = np.concatenate(at), np.concatenate(anchors)
                keys = (anchors | np.uint64(k << 34)).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(prints[at].view(np.int64)), pa.array(anchors == home[at])], names=["anchor", "fp", "home"])

    return run


def forest(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """Of links between 0 .. n-1: for each node the smallest one that it is connected to."""
    label = np.arange(n)
    while len(a):
        low = np.minimum(label[a], label[b])
        np.minimum.at(label, label[a], low)
        np.minimum.at(label, label[b], low)
        while (label[label] != label).any():
            label = label[label]
        open_ = label[a] != label[b]
        a, b = a[open_], b[open_]
    return label


def linked(cell: np.ndarray, prints: np.ndarray, home: np.ndarray, threshold: int) -> tuple[np.ndarray, np.ndarray]:
    """Links within cells of sorted rows: those at home in the cell's anchor against all of the cell, as a forest of
    fewer links than rows. Pairs are compared in blocks of bounded size and never leave this function."""
    label = np.arange(len(cell))
    first = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1]]) if len(cell) else np.zeros(0, np.int64)
    last = np.r_[first[1:], len(cell)]
    run = np.repeat(np.arange(len(first)), last - first)
    own = np.flatnonzero(home)
    size = (last - first)[run[own]]
    limit = 400_000
    begin = 0
    held = np.cumsum(size)
    while begin < len(own):
        end = max(begin + 1, int(np.searchsorted(held, (held[begin - 1] if begin else 0) + limit, "right")))
        rows, sizes = own[begin:end], size[begin:end]
        left = np.repeat(rows, sizes)
        right = np.arange(len(left)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(first[run[rows]], sizes)
        near = np.bitwise_count(prints[left] ^ prints[right]) <= threshold
        near &= left != right
        if near.any():
            label = forest(np.r_[np.arange(len(label)), left[near]], np.r_[label, right[near]], len(label))
        begin = end
    other = np.flatnonzero(label != np.arange(len(label)))
    return prints[other], prints[label[other]]


def whole_cells(batches, others: int):
    """Rows sorted by cell, as tables of whole cells; all columns but the last ``others`` are those of the cell. A cell may run
    over several batches."""
    held = []
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = [np.asarray(batch.column(i)) for i in range(batch.num_columns - others)]
        same = np.ones(batch.num_rows, bool)
        for k in keys:
            same &= k == k[-1]
        start = int(np.flatnonzero(~same)[-1]) + 1 if not same.all() else 0
        if start == 0 and held and all(held[-1].column(i)[-1].as_py() == k[0] for i, k in enumerate(keys)):
            held.append(batch)  # the cell goes on
            continue
        yield pa.Table.from_batches([*held, batch.slice(0, start)])
        held = [batch.slice(start)]
    if held:
        yield pa.Table.from_batches(held)


def compare_batches(threshold: int):
    """Rows (cell columns..., fp, home), sorted by cell, in; links out."""

    def links(table: pa.Table) -> pa.RecordBatch:
        columns = [np.asarray(table.column(i).combine_chunks()) for i in range(table.num_columns - 2)]
        step = np.zeros(table.num_rows, bool)
        for c in columns:
            step[1:] |= c[1:] != c[:-1]
        a, b = linked(np.cumsum(step), np.asarray(table.column("fp").combine_chunks()).view(np.uint64), np.asarray(table.column("home").combine_chunks().cast(pa.int8())) > 0, threshold)
        return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])

    def run(batches):
        for table in whole_cells(batches, 2):
            yield links(table)

    return run


def simhash_links(prints: DataFrame, threshold: int = 4, number: int | None = None, slice_rows: int = SLICE) -> DataFrame:
    """Links (``a``, ``b``) among distinct fingerprints (``fp`` long) that join just those that a chain of links within
    ``threshold`` bits joins.

    The 64 bits are split into blocks; of two fingerprints within the threshold, some block differs in at most
    t = floor(threshold / blocks) bits. In each block the anchors are a covering code of radius 1. A fingerprint is at
    home with its nearest anchor and is replicated to every anchor within 1 + t bits. So of two that differ in at most
    t bits of a block, each is found at the other's home, and comparing homes with all others per anchor misses none.
    Three blocks (t = 1, 15-bit Hamming code and 6 free bits: about 41 copies, 2^17 anchors a block) are used up to
    ``THREE_BLOCKS`` fingerprints, two (t = 2, 31-bit code: about 340 copies, 2^27 anchors) beyond.

    Each anchor yields a forest of links, fewer than its members, even if all are alike. An anchor with more than
    ``slice_rows`` members is dealt out to cells, each of a slice of its homes and a slice of its members.
    """
    if number is None:
        number = 3 if prints.count() <= THREE_BLOCKS else 2
    members = prints.select("fp").mapInArrow(anchor_batches(number, threshold), "anchor long, fp long, home boolean")
    large = cut(members.groupBy("anchor").agg(F.count("*").alias("n")).filter(F.col("n") > slice_rows))
    cells = ["anchor"]
    if not large.isEmpty():
        cells = ["anchor", "i", "j"]
        slices = F.ceil(F.coalesce("n", F.lit(1)) / F.lit(slice_rows)).cast("int")
        own = F.pmod(F.xxhash64("fp"), F.col("k")).cast("int")
        members = members.join(large, "anchor", "left").withColumn("k", slices).withColumn("own", own)
        every = F.sequence(F.lit(0), F.col("k") - 1)
        column = F.transform(every, lambda x: F.struct(x.alias("i"), F.col("own").alias("j"), F.lit(False).alias("home")))
        row = F.when(F.col("home"), F.transform(every, lambda x: F.struct(F.col("own").alias("i"), x.alias("j"), F.lit(True).alias("home")))).otherwise(F.array().cast("array<struct<i:int,j:int,home:boolean>>"))
        # a home of slice i stands in the cells (i, *) as a home, and as a member in (*, own)
        placed = F.filter(F.concat(row, column), lambda c: c["home"] | ~(F.col("home") & (c["i"] == F.col("own"))))
        members = members.select("anchor", "fp", F.explode(placed).alias("c")).select("anchor", "c.i", "c.j", "fp", "c.home")
    dealt = members.repartition(*cells).sortWithinPartitions(*cells, "fp")
    return dealt.mapInArrow(compare_batches(threshold), "a long, b long")


def simhash_components(docs: DataFrame, width: int = 4, threshold: int = 4, **options) -> DataFrame:
    """(``doc_id``, ``fp``, ``component_id``): documents joined by chains of fingerprints within ``threshold`` bits.

    Words are `[^\\x20\\x09-\\x0D]+` of the whole text with A-Z lowered, shingles have ``width`` of them, repeats
    included; fewer words are one shingle. A bit is set if it is set in over half the shingles' XXH64 (seed 42).
    ``component_id`` is the smallest ``doc_id`` that can be reached.

    Fingerprints are computed once and written; equal ones are one node, so copies cost nothing further.

    Null, empty and blank texts: fingerprint zero, which links like any other. Null ``doc_id``: takes part, but is never
    the smallest unless all are null. Repeated rows: one result each. Very long texts: held singly. Empty table: empty
    result. Other columns are not read.
    """
    prints = cut(fingerprints(docs, width))
    nodes = cut(prints.select("fp").distinct())
    roots = components(simhash_links(nodes, threshold, **options))
    return labelled(prints, roots, "fp")


def one_of_each(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` whose id is the smallest of its component. Rows that share an id stay or go together."""
    stay = simhash_components(docs, **options).filter(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias("__stay"))
    return docs.join(stay, docs["doc_id"].eqNullSafe(stay["__stay"]), "left_semi")


def op2_simhash_anchors(spark, sf_dir):
    from .common import table

    out = simhash_components(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
