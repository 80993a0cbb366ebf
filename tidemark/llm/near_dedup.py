"""Near copies by similarity of shingle sets: anchors of wide SimHash fingerprints find candidates, exact Jaccard similarity decides."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import KEY_SALTS, components, cut, labelled
from .simhash import Code, forest, shingle_hashes, whole_cells
from .substring import mixed

#: Words of a shingle, and the similarity from which two texts are near copies, in hundredths.
WIDTH, SIMILAR = 5, 80
#: Blocks of a fingerprint and bits of each, up to ``MANY`` texts and beyond.
MANY, BLOCKS = 1 << 24, ((96, 18), (160, 21))
#: One of so many blocks comes first.
EARLY = 6
#: Shingles up to which a set has twice the blocks: the majority of few hashes changes more easily.
FEW = 8
#: Words of 64 bits of a fingerprint that candidates are compared by, and the bits that may differ in the first and in all.
TOLD, FIRST_APART, APART = 3, 26, 54
#: Sets of a slice, and shingles in them, about; groups with more are dealt out as pairs of slices, a task each.
SLICE, SLICE_SHINGLES = 4_000, 1_000_000
#: Members of an anchor that one task compares with as many others.
ANCHOR_SLICE = 20_000
#: Links that a task joins at a time, about.
LINKS = 1 << 19
#: Shingles that are fingerprinted at a time, about.
HELD = 50_000


def shingle_set(text: bytes | None, width: int) -> np.ndarray:
    return np.unique(np.array(shingle_hashes(text or b"", width), np.uint64))


def node_of(shingles: np.ndarray) -> int:
    """64 bits that depend on the whole set."""
    from xxhash import xxh64_intdigest

    return int(np.uint64(xxh64_intdigest(shingles.tobytes(), 7)).view(np.int64))


#: By byte: its bits as eight counters of a byte.
COUNTERS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).view(np.uint64)[:, 0]


def wide_prints(sets: list[np.ndarray], words: int) -> np.ndarray:
    """SimHash fingerprints of ``words`` times 64 bits of sets, which aren't empty: a bit is set if it is in over half the
    shingles' hashes, of which there is one for each 64 bits."""
    size = np.array([len(s) for s in sets])
    flat = np.concatenate(sets)
    # runs of 255 shingles at most, so that a counter of a byte holds their sum
    pieces = -(-size // 255)
    first = np.cumsum(pieces) - pieces
    runs = np.repeat(np.cumsum(size) - size - first * 255, pieces) + np.arange(pieces.sum()) * 255
    out = np.empty((len(sets), words), np.uint64)
    for w, turn in enumerate(mixed(np.arange(1, words + 1, dtype=np.uint64)).tolist()):
        octets = mixed(flat ^ np.uint64(turn)).view(np.uint8).reshape(-1, 8).T
        sums = np.add.reduceat(COUNTERS[octets], runs, axis=1).T.copy().view(np.uint8)
        sums = np.add.reduceat(sums, first, axis=0, dtype=np.int32)
        out[:, w] = np.packbits(sums * 2 > size[:, None], axis=1).view(np.uint64)[:, 0]
    return out


def sketch_batches(width: int, words: int):
    def run(batches):
        for batch in batches:
            texts, at = batch.column(1).cast(pa.binary()), 0
            while at < batch.num_rows:
                sets, held, begin = [], 0, at
                while at < batch.num_rows and held < HELD:
                    sets.append(shingle_set(texts[at].as_py(), width))
                    held += len(sets[-1])
                    at += 1
                prints: list[bytes | None] = [None] * len(sets)
                for low, high, wide in ((1, FEW, words * 2), (FEW + 1, np.inf, words)):
                    places = [i for i, s in enumerate(sets) if low <= len(s) <= high]
                    for i, p in zip(places, wide_prints([sets[i] for i in places], wide) if places else (), strict=True):
                        prints[i] = p.tobytes()
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(begin, at - begin), pa.array([node_of(s) for s in sets], pa.int64()), pa.array([len(s) for s in sets], pa.int64()), pa.array(prints, pa.binary())], names=["doc_id", "node", "shingles", "print"])

    return run


def anchor_batches(number: int, bits: int, first: int, last: int | None):
    """The anchor that each block of a fingerprint, from the ``first`` to before the ``last``, is at home with: its nearest
    codeword."""
    code, scale = Code(bits, 1), np.uint64(1) << np.arange(bits, dtype=np.uint64)
    words = -(-number * bits // 64)

    def anchored(nodes, groups, prints):
        times = prints.shape[1] // (words * 8)
        blocks = np.unpackbits(prints.reshape(-1, words * 8), axis=1)[:, : number * bits].reshape(-1, number * times, bits)[:, first:last].astype(np.uint64) @ scale
        keys = code.home(blocks) | np.arange(number * times, dtype=np.uint64)[first:last] << np.uint64(32)
        told = prints.view(np.int64)[:, :TOLD]
        columns = [keys.ravel().view(np.int64), *(np.repeat(c, keys.shape[1]) for c in (nodes, groups, *told.T))]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["anchor", "node", "group", *(f"w{i}" for i in range(TOLD))])

    def run(batches):
        for batch in batches:
            for begin in range(0, batch.num_rows, 1000):
                part = batch.slice(begin, 1000)
                nodes, groups, prints = np.asarray(part.column(0)), np.asarray(part.column(1)), part.column(2).to_pylist()
                size = np.array([len(p) for p in prints])
                for s in np.unique(size):
                    at = np.flatnonzero(size == s)
                    yield anchored(nodes[at], groups[at], np.frombuffer(b"".join(prints[i] for i in at), np.uint8).reshape(len(at), -1))

    return run


def thinned(batches):
    """Links (a, b) in; fewer that join the same nodes out: of every ``LINKS`` links, one of each node to the smallest that it
    is connected to among them. Repeated links and loops go."""
    held, n = [], 0

    def stars():
        a, b = (np.concatenate([np.asarray(h.column(i)) for h in held]) for i in (0, 1))
        nodes, place = np.unique(np.r_[a, b], return_inverse=True)
        label = forest(place[: len(a)], place[len(a) :], len(nodes))
        other = np.flatnonzero(label != np.arange(len(nodes)))
        return pa.RecordBatch.from_arrays([pa.array(nodes[other]), pa.array(nodes[label[other]])], names=["a", "b"])

    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= LINKS:
            yield stars()
            held, n = [], 0
    if n:
        yield stars()


def close_batches(batches):
    """Rows (anchor, i, j, group, words of the fingerprint), sorted by cell and group, in; links of groups with rows that are
    close out, as a forest of fewer links than rows. Pairs of one group are not compared; those of two are, in blocks of
    bounded size, and never leave this function."""
    for table in whole_cells(batches, TOLD + 1):
        columns = [np.asarray(table.column(i).combine_chunks()) for i in range(table.num_columns)]
        n, group, words = table.num_rows, columns[-TOLD - 1], [c.view(np.uint64) for c in columns[-TOLD:]]
        step = np.zeros(n, bool)
        for c in columns[: -TOLD - 1]:
            step[1:] |= c[1:] != c[:-1]
        turn = step.copy()
        turn[1:] |= group[1:] != group[:-1]
        ends, turns = np.r_[np.flatnonzero(step), n], np.r_[np.flatnonzero(turn), n]
        own = np.diff(np.r_[0, turns])
        # the first row of the group in its cell, and the row after its last
        begins, beyond = np.repeat(turns - own, own), np.repeat(turns, own)
        after = np.repeat(ends, np.diff(np.r_[0, ends])) - beyond
        held, label, begin = np.cumsum(after), begins, 0
        while begin < n:
            end = max(begin + 1, int(np.searchsorted(held, (held[begin - 1] if begin else 0) + 400_000, "right")))
            size = after[begin:end]
            left = np.repeat(np.arange(begin, end), size)
            right = beyond[left] + np.arange(len(left)) - np.repeat(np.cumsum(size) - size, size)
            apart = np.bitwise_count(words[0][left] ^ words[0][right])
            some = apart <= FIRST_APART
            left, right, apart = left[some], right[some], apart[some].astype(np.int64)
            for w in words[1:]:
                apart += np.bitwise_count(w[left] ^ w[right])
            near = apart <= APART
            if near.any():
                label = forest(np.r_[np.arange(n), left[near]], np.r_[label, right[near]], n)
            begin = end
        other = np.flatnonzero((begins == np.arange(n)) & (label != begins))
        yield pa.RecordBatch.from_arrays([pa.array(group[other]), pa.array(group[label[other]])], names=["a", "b"])


def links_of_blocks(prints: DataFrame, number: int, bits: int, first: int, last: int | None, slice_rows: int) -> DataFrame:
    """Links (``a``, ``b``) of groups of ``prints`` (``node``, ``group``, ``print``) by the blocks from the ``first`` to before the ``last``."""
    words = [f"w{i}" for i in range(TOLD)]
    members = prints.select("node", "group", "print").mapInArrow(anchor_batches(number, bits, first, last), ", ".join(f"{c} long" for c in ("anchor", "node", "group", *words)))
    # counted from the anchors alone: few rows, whatever the number of members
    large = cut(members.groupBy("anchor").agg(F.count("*").alias("n")).filter(F.col("n") > slice_rows))
    if large.isEmpty():
        placed = members.withColumns({"i": F.lit(0), "j": F.lit(0)})
    else:
        members = members.join(F.broadcast(large), "anchor", "left").withColumn("slices", F.ceil(F.coalesce("n", F.lit(1)) / F.lit(slice_rows)).cast("int"))
        own = F.pmod(F.xxhash64("node"), F.col("slices")).cast("int")
        cells = F.transform(F.sequence(F.lit(0), F.col("slices") - 1), lambda x: F.struct(F.least(x, own).alias("i"), F.greatest(x, own).alias("j")))
        placed = members.withColumn("c", F.explode(cells)).withColumns({"i": F.col("c.i"), "j": F.col("c.j")})
    dealt = placed.select("anchor", "i", "j", "group", *words).repartition("anchor", "i", "j").sortWithinPartitions("anchor", "i", "j", "group")
    links = dealt.mapInArrow(lambda batches: thinned(close_batches(batches)), "a long, b long")
    # the links of a node come from many anchors; together they are few
    return links.repartition("a").mapInArrow(thinned, "a long, b long")


def close_links(prints: DataFrame, number: int, bits: int, slice_rows: int = ANCHOR_SLICE) -> DataFrame:
    """Links (``a``, ``b``) of nodes of ``prints`` (``node`` long, ``print`` binary, each node once) that join what is joined by
    links of two that meet at an anchor and differ in ``APART`` or fewer of the first ``TOLD`` * 64 bits.

    Each of ``number`` blocks (twice as many for ``FEW`` shingles) of ``bits`` bits is covered by the anchors of a code of radius 1, and is dealt to its nearest. An
    anchor of more than ``slice_rows`` members is dealt out to cells of two slices, all pairs of slices.

    Members of a large group meet in most blocks, and each block would link them once more. So the first blocks
    (one of ``EARLY``) are joined to groups, and in the others only nodes of different groups are compared and linked."""
    first = number // EARLY
    early = components(links_of_blocks(prints.withColumn("group", F.col("node")), number, bits, 0, first, slice_rows))
    grouped = cut(prints.join(early, "node", "left").select("node", F.coalesce("root", "node").alias("group"), "print"))
    return early.toDF("a", "b").unionByName(links_of_blocks(grouped, number, bits, first, None, slice_rows))


def set_batches(width: int):
    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                sets = [shingle_set(t.as_py(), width) for t in batch.column(0).slice(at, 500).cast(pa.binary())]
                yield pa.RecordBatch.from_arrays([pa.array([node_of(s) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())], names=["node", "shingles"])

    return run


def near_groups(sets: list[np.ndarray], similar: int) -> np.ndarray:
    """For each set, the first one that a chain of sets, each at least so similar to the next, leads to.

    A set is compared with all that are in no chain yet, by the sets that each of its shingles is in; the more are in
    chains, the less there is to compare, so a group in which all are alike costs one step."""
    size = np.array([len(s) for s in sets])
    _, term = np.unique(np.concatenate(sets), return_inverse=True)
    edges = np.r_[0, np.cumsum(size)]
    order = np.argsort(term, kind="stable")
    owner = np.repeat(np.arange(len(sets)), size)[order]
    ends = np.r_[0, np.cumsum(np.bincount(term))]
    label, left, built = np.full(len(sets), -1), len(sets), len(sets)
    for first in range(len(sets)):
        if label[first] >= 0:
            continue
        label[first] = first
        left -= 1
        queue = [first]
        while queue and left:
            if left * 2 < built:
                keep = label[owner] < 0
                ends = np.r_[0, np.cumsum(keep)][ends]
                owner, built = owner[keep], left
            x = queue.pop()
            mine = term[edges[x] : edges[x + 1]]
            begin, count = ends[mine], ends[mine + 1] - ends[mine]
            where = np.repeat(begin - np.r_[0, np.cumsum(count)[:-1]], count) + np.arange(count.sum())
            both = np.bincount(owner[where], minlength=len(sets))
            found = np.flatnonzero((label < 0) & (both * 100 >= similar * (size[x] + size - both)))
            label[found] = first
            left -= len(found)
            queue.extend(found.tolist())
    return label


def near_components(docs: DataFrame, width: int = WIDTH, similar: int = SIMILAR, slice_sets: int = SLICE, slice_shingles: int = SLICE_SHINGLES, anchor_slice: int = ANCHOR_SLICE) -> DataFrame:
    """(``doc_id``, ``node``, ``component_id``): documents joined by chains of near copies, and the smallest id of each.

    Near copies have sets of shingles (``width`` words, as SimHash takes them; fewer words are one) of Jaccard similarity
    ``similar`` hundredths or more. Candidates come from SimHash by anchor-point covering, on fingerprints as wide as that
    similarity needs (``BLOCKS``): two sets that meet at an anchor of some block are candidates if few of 192 bits differ.
    What chains of candidates join is gathered, each set once, and compared exactly there, whether the pair itself was a
    candidate or not. Equal sets are one node, by a hash of 64 bits.

    At similarity 0.8 a bit differs with a chance of about 0.15, so a pair meets at no anchor with a chance of about
    0.0001; at 0.9, of 1e-9. The majority of 4 shingles and that of the same and a fifth differ with 0.19, which
    twice the blocks make up for.

    A group of more than ``slice_sets`` sets, or ``slice_shingles`` shingles in them, is cut into slices, and each pair of slices
    is a cell, compared by one task: every pair of sets meets in a cell, none is left out, and a task holds two slices at
    most, at 8 bytes a shingle. A set comes to its cells once, however many documents have it: from the document of the
    smallest id. What the cells join is joined once more as components. Null, empty and blank texts: one empty set,
    like each other and nothing else. Null ``doc_id``: takes part, but is never the smallest unless all are null.
    Repeated rows: one result each. Empty table: empty result. Other columns are not read.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    number, bits = BLOCKS[0] if docs.count() <= MANY else BLOCKS[1]
    prints = cut(docs.select("doc_id", "text").mapInArrow(sketch_batches(width, -(-number * bits // 64)), f"doc_id {kind}, node long, shingles long, print binary"))
    links = close_links(cut(prints.filter("print IS NOT NULL").groupBy("node").agg(F.first("print").alias("print"))), number, bits, anchor_slice)
    found = components(links).withColumnRenamed("root", "group")
    groups = found.unionByName(found.select(F.col("group").alias("node"), "group").distinct())
    one = prints.groupBy("node").agg(F.min("doc_id").alias("__asked"), F.max("shingles").alias("held"))
    known = cut(one.join(groups, "node").withColumn("salt", F.pmod(F.xxhash64("node"), F.lit(KEY_SALTS)).cast("int")))
    asked = known.select("__asked").distinct()
    some = docs.select("doc_id", "text").join(asked, F.col("doc_id").eqNullSafe(F.col("__asked")), "left_semi")
    sets = some.select("text").mapInArrow(set_batches(width), "node long, shingles binary")
    sizes = known.groupBy("group", "salt").agg(F.count("*").alias("n"), F.sum("held").alias("held"))
    sizes = sizes.groupBy("group").agg(F.sum("n").alias("n"), F.sum("held").alias("held"), F.collect_list("salt").alias("salts"))
    slices = F.ceil(F.greatest(F.col("n") / F.lit(slice_sets), F.col("held") / F.lit(slice_shingles))).cast("int")
    # by shuffle, as in with_least
    sizes = sizes.select("group", slices.alias("slices"), F.explode("salts").alias("salt")).hint("merge")
    own = F.pmod(F.xxhash64("node"), F.col("slices")).cast("int")
    # a set of slice s stands in the cells (0, s) .. (s, s), (s, s + 1) .. (s, last)
    cells = F.transform(F.sequence(F.lit(0), F.col("slices") - 1), lambda x: F.struct(F.least(x, own).alias("i"), F.greatest(x, own).alias("j")))
    dealt = sets.join(known.join(sizes, ["group", "salt"]).select("node", "group", "slices"), "node").select("node", "shingles", "group", F.explode(cells).alias("c")).select("node", "shingles", "group", "c.i", "c.j")

    def run(table):
        nodes, at = np.unique(np.asarray(table.column("node").combine_chunks()), return_index=True)
        label = near_groups([np.frombuffer(table.column("shingles")[i].as_py(), np.uint64) for i in at.tolist()], similar)
        apart = label != np.arange(len(label))
        return pa.table({"a": pa.array(nodes[apart]), "b": pa.array(nodes[label][apart])})

    near = components(dealt.groupBy("group", "i", "j").applyInArrow(run, "a long, b long"))
    return labelled(prints.select("doc_id", "node"), near, "node")


def one_of_each(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` whose id is the smallest of its component. Rows that share an id stay or go together."""
    stay = near_components(docs, **options).filter(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias("__stay")).distinct()
    return docs.join(stay, docs["doc_id"].eqNullSafe(stay["__stay"]), "left_semi")
