"""SentencePiece encoding with seeded merge-dropout, and decoding."""

from __future__ import annotations

import re
from heapq import heappop, heappush
from math import log1p

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
#: Code points there are.
CHARACTERS = 0x110000
#: Letters that stand together in words of many languages.
LETTER_RANGES = ("AZ", "az", "ÀÖ", "Øö", "øɏ")
LETTERS = "".join(f"{a}-{b}" for a, b in LETTER_RANGES)
MASK = (1 << 64) - 1
#: Odd factors that spread a number and a place over 64 bits.
SPREAD, MIX, PLACE = 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0x9E3779B97F4A7C15
#: More candidates than any part has; no candidate.
NEVER, FREE = 1 << 62, np.int64(2**63 - 1)
#: Characters of parts that are worked on at a time, about; parts that are merged in step; and their characters at most.
PARTS, COLUMNS, LONG = 400_000, 16_384, 100


class Vocabulary:
    """Pieces with ids and scores, and the bytes that each id stands for."""

    def __init__(self, pieces: list[tuple[str, float, int]]):
        """``pieces``: (piece, score, kind) by id; kind 0: of characters, 1: a byte, 2: of neither."""
        self.ids = {p: (i, s) for i, (p, s, kind) in enumerate(pieces) if kind == 0}
        #: What a merge into a piece needs: its rank (best first) and its id.
        self.merges = {p: (-s, i) for p, (i, s) in self.ids.items()}
        self.byte = [0] * 256
        self.text = [b""] * len(pieces)
        for i, (p, _, kind) in enumerate(pieces):
            if kind == 1:
                self.byte[int(p[3:-1], 16)] = i
                self.text[i] = bytes([int(p[3:-1], 16)])
            elif kind == 0:
                self.text[i] = p.replace(SPACE, " ").encode()
        mixed = re.compile(f"[{LETTERS}][^{LETTERS}]|[^{LETTERS}{SPACE}][{LETTERS}]")
        #: A part of a text is what no piece reaches across: spaces and what follows them, letters apart from other signs,
        #: and characters in no longer piece, as far as the pieces allow. By character: 0 a space, 1 one by itself, 2 a
        #: letter, 3 others.
        self.whole = any(SPACE in p.lstrip(SPACE) for p in self.ids)
        self.kind = np.ones(CHARACTERS, np.uint8)
        self.kind[[ord(c) for c in {c for p in self.ids if len(p) > 1 for c in p} - {SPACE}]] = 3
        self.kind[32] = 0
        if not any(map(mixed.search, self.ids)):
            for a, b in LETTER_RANGES:
                self.kind[ord(a) : ord(b) + 1][self.kind[ord(a) : ord(b) + 1] == 3] = 2
        self._symbols(len(pieces))

    def _symbols(self, n: int) -> None:
        """Numbers for symbols: a piece has its id, any other character ``n`` and its code point, a mark that is part of the
        text itself the one after those; and a table of the pairs of symbols that merge."""
        self.n = n
        self.of = np.arange(n, n + CHARACTERS, dtype=np.int32)
        for p, (i, _) in self.ids.items():
            if len(p) == 1:
                self.of[ord(p)] = i
        self.of[32] = self.ids[SPACE][0] if SPACE in self.ids else n + 32
        self.of[ord(SPACE)] = n + CHARACTERS
        number = lambda s: self.ids[s][0] if s in self.ids else (n + 32 if s == SPACE else n + ord(s)) if len(s) == 1 else None
        ranked = sorted((p for p in self.ids if len(p) > 1), key=self.merges.get)
        #: Ids of the longer pieces, best first; and the numbers of their scores, which several may have.
        self.by_rank = np.array([self.ids[p][0] for p in ranked], np.int32)
        scores = np.array([self.merges[p][0] for p in ranked])
        self.level = np.cumsum(np.r_[False, scores[1:] != scores[:-1]]) if len(ranked) else np.zeros(0, np.int64)
        pairs = {}
        for rank, p in enumerate(ranked):
            for at in range(1, len(p)):
                a, b = number(p[:at]), number(p[at:])
                if a is not None and b is not None:
                    pairs[a << 32 | b] = rank
        self.pairs = pairs
        keys = np.fromiter(pairs, np.int64, len(pairs))
        ranks = np.fromiter(pairs.values(), np.int64, len(pairs))
        #: What a pair is worth in an agenda, least first: number of the score, room for a place of 8 bits, rank.
        ranks |= self.level[ranks] << 40
        self.shift = np.uint64(62 - max(2, len(pairs)).bit_length())
        slots = 1 << (64 - int(self.shift))
        self.keys, self.ranks = np.full(slots, -1, np.int64), np.full(slots, FREE)
        at = self._slot(keys)
        while len(keys):
            free = self.keys[at] == -1
            self.keys[at[free]] = keys[free]
            placed = self.keys[at] == keys
            self.ranks[at[placed]] = ranks[placed]
            keys, ranks, at = keys[~placed], ranks[~placed], (at[~placed] + 1) & (slots - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (keys.view(np.uint64) * np.uint64(SPREAD) >> self.shift).view(np.int64)

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """What pairs of symbols are worth in an agenda; ``FREE`` for those that don't merge."""
        keys = a.astype(np.int64) << 32 | b.astype(np.int64) & 0xFFFFFFFF
        at = self._slot(keys)
        found = self.keys[at]
        out = self.ranks[at]
        miss = np.flatnonzero((found != keys) & (found != -1))
        out[found != keys] = FREE
        at = at[miss]
        while len(miss):
            at = at + 1 & (len(self.keys) - 1)
            found = self.keys[at]
            hit = found == keys[miss]
            out[miss[hit]] = self.ranks[at[hit]]
            left = ~hit & (found != -1)
            miss, at = miss[left], at[left]
        return out


def load(path: str = MODEL) -> Vocabulary:
    """The vocabulary of a BPE model file with byte fallback. Read on the driver alone; workers get the pieces."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    kind = lambda i: 1 if model.is_byte(i) else 2 if model.is_control(i) or model.is_unknown(i) or model.is_unused(i) else 0
    return Vocabulary([(model.id_to_piece(i), model.get_score(i), kind(i)) for i in range(model.vocab_size())])


def spread(x):
    """64 bits that depend on all of ``x``: an array of 64-bit numbers, or a number."""
    if not isinstance(x, np.ndarray):
        x &= MASK
        x = (x ^ x >> 30) * SPREAD & MASK
        x = (x ^ x >> 27) * MIX & MASK
        return x ^ x >> 31
    x = (x ^ x >> np.uint64(30)) * np.uint64(SPREAD)
    x = (x ^ x >> np.uint64(27)) * np.uint64(MIX)
    return x ^ x >> np.uint64(31)


class Draws:
    """Which candidates of each part are skipped. Each is skipped with probability ``dropout`` by itself: what is drawn, from a
    hash of seed, document and place of the part, are the gaps between the skipped ones."""

    def __init__(self, dropout: float, states: np.ndarray):
        #: A gap is the logarithm of a uniform number times this, rounded down.
        self.scale = 1 / log1p(-dropout) if 0 < dropout < 1 else -0.0 if dropout >= 1 else None
        self.states = states
        self.next = np.full(len(states), NEVER) if self.scale is None else self._gaps(states)

    def _gaps(self, states: np.ndarray) -> np.ndarray:
        return np.minimum(np.log(((states >> np.uint64(11)) + 0.5) * 2.0**-53) * self.scale, NEVER).astype(np.int64)

    def go_on(self, at: np.ndarray) -> None:
        """The next skipped candidates of the parts ``at``."""
        self.states[at] = spread(self.states[at] + np.uint64(PLACE))
        self.next[at] += 1 + self._gaps(self.states[at])


def merge_one(symbols: list[int], v: Vocabulary, draws: Draws, part: int) -> list[int]:
    """The symbols of one part after its merges, by an agenda: candidate merges of neighbours, best score first, then
    leftmost. Each candidate taken from it is either skipped or made; then the merges with its new neighbours are
    candidates. Skipped ones don't come back, but a merge that grows around may."""
    n = len(symbols)
    agenda: list[tuple] = []

    def add(i: int, k: int) -> None:
        r = v.pairs.get(symbols[i] << 32 | symbols[k])
        if r is not None:
            heappush(agenda, (int(v.level[r]), i, k, symbols[i], symbols[k], r))

    for i in range(n - 1):
        add(i, i + 1)
    before, after, taken = list(range(-1, n - 1)), list(range(1, n + 1)), 0
    while agenda:
        _, i, j, a, b, r = heappop(agenda)
        if symbols[i] != a or symbols[j] != b or after[i] != j:
            continue
        taken += 1
        if draws.next[part] == taken - 1:
            draws.go_on(np.array([part]))
            continue
        symbols[i], symbols[j] = int(v.by_rank[r]), -1
        k = after[i] = after[j]
        if k < n:
            before[k] = i
            add(i, k)
        if before[i] >= 0:
            add(before[i], i)
    return [s for s in symbols if s >= 0]


def merge_many(symbols: np.ndarray, v: Vocabulary, draws: Draws, parts: np.ndarray) -> np.ndarray:
    """As ``merge_one``, for many parts at a time: one candidate of each part in a round. ``symbols``: a column for each
    part, -1 below its end, and a row of -1 before and after; the result has -1 where a symbol went into a merge."""
    height, n = symbols.shape
    flat = symbols.ravel()
    columns = np.arange(n)
    after = np.repeat(np.arange(1, height + 1, dtype=np.int16), n)
    before = np.repeat(np.arange(-1, height - 1, dtype=np.int16), n)
    # the agenda: by column the candidates, with the row of the left symbol
    agenda = v.rank(flat[:-n], flat[n:])
    agenda = np.where(agenda == FREE, FREE, agenda + np.repeat(np.arange(height - 1) << 32, n)).reshape(height - 1, n)
    taken = 0
    while True:
        best = agenda.min(axis=0)
        some = np.flatnonzero(best != FREE)
        if not len(some):
            return symbols
        if len(some) < 0.8 * len(best):
            agenda, columns, best = np.ascontiguousarray(agenda[:, some]), columns[some], best[some]
            some = np.arange(len(columns))
        width = agenda.shape[1]
        lines = agenda.ravel()
        best = best[some]
        row = best >> 32 & 255
        skipped = draws.next[parts[columns[some]]] == taken
        taken += 1
        if skipped.any():
            lines[row[skipped] * width + some[skipped]] = FREE
            draws.go_on(parts[columns[some[skipped]]])
            stay = ~skipped
            some, best, row = some[stay], best[stay], row[stay]
        column = columns[some]
        i = row * n + column
        j_row = after[i].astype(np.int64)
        j = j_row * n + column
        k_row = after[j].astype(np.int64)
        h_row = before[i].astype(np.int64)
        k, h = k_row * n + column, h_row * n + column
        new = v.by_rank[best & 0xFFFFFFFF]
        flat[i], flat[j], after[i], before[k] = new, -1, k_row, row
        right, left = v.rank(new, flat[k]), v.rank(flat[h], new)
        lines[j_row * width + some] = FREE
        lines[row * width + some] = np.where(right == FREE, FREE, right + (row << 32))
        lines[h_row * width + some] = np.where(left == FREE, FREE, left + (h_row << 32))


class Encoder:
    """Encodes texts, many parts at a time. Nothing is remembered between calls, so memory is bounded by ``PARTS``."""

    def __init__(self, v: Vocabulary, dropout: float, seed: int, document: int = 0):
        self.v, self.dropout, self.document, self.seed = v, dropout, document, xxh64_intdigest(f"{seed}")

    def merged(self, symbols: np.ndarray, ends: np.ndarray, states: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Symbols of parts that end at ``ends``, after their merges, and how many of each part are left."""
        v, draws = self.v, Draws(self.dropout, states)
        starts = np.r_[0, ends[:-1]]
        sizes = ends - starts
        out, left = symbols.copy(), np.ones(len(symbols), bool)
        order = np.argsort(sizes, kind="stable")
        ordered = sizes[order]
        at = int(np.searchsorted(ordered, 2))
        while at < len(order):
            longest = int(ordered[at])
            if longest > LONG:
                p = int(order[at])
                made = merge_one(symbols[starts[p] : ends[p]].tolist(), v, draws, p)
                out[starts[p] : starts[p] + len(made)] = made
                left[starts[p] + len(made) : ends[p]] = False
                at += 1
                continue
            most = min(LONG, longest + longest // 4)
            stop = min(at + COLUMNS, int(np.searchsorted(ordered, most, "right")))
            parts = order[at:stop]
            rows = np.arange(int(sizes[parts[-1]]))[:, None]
            there = rows < sizes[parts]
            place = (starts[parts] + rows)[there]
            square = np.full((len(rows) + 2, len(parts)), -1, np.int32)
            square[1:-1][there] = symbols[place]
            made = merge_many(square, v, draws, parts)[1:-1][there]
            out[place], left[place] = made, made >= 0
            at = stop
        return out[left], np.add.reduceat(left.astype(np.int64), starts) if len(starts) else sizes

    def written(self, symbols: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids for symbols: what is no piece is written as its bytes. ``counts``: symbols, and in the result ids, by part."""
        v = self.v
        if not (symbols >= v.n).any():
            return symbols, counts
        point = np.where(symbols == v.n + CHARACTERS, ord(SPACE), symbols - v.n)
        size = np.where(symbols < v.n, 1, 1 + (point > 0x7F) + (point > 0x7FF) + (point > 0xFFFF))
        at = np.r_[0, np.cumsum(size)]
        out = np.repeat(symbols, size)
        byte = np.array(v.byte, np.int32)
        for n, lead in ((1, 0), (2, 0xC0), (3, 0xE0), (4, 0xF0)):
            some = np.flatnonzero((size == n) & (symbols >= v.n))
            for i in range(n):
                bits = point[some] >> 6 * (n - 1 - i)
                out[at[some] + i] = byte[lead | bits if i == 0 else 0x80 | bits & 0x3F]
        last = np.cumsum(counts)
        return out, np.diff(np.r_[0, at[last]])

    def encode(self, texts: list[str], documents: list[int]) -> list[np.ndarray]:
        """The ids of each text, one space put before it, as the model does; an empty text has none. Each occurrence of a part
        has draws of its own, from a hash of seed, document and its place in it."""
        v = self.v
        raw = "".join(" " + t for t in texts if t).encode("utf-32-le", "surrogatepass")
        points = np.frombuffer(raw, np.uint32)
        lengths = np.array([len(t) + 1 if t else 0 for t in texts], np.int64)
        first = np.cumsum(lengths) - lengths
        begins = np.zeros(len(points) + 1, bool)
        begins[first] = True
        if not v.whole and len(points):
            kind = v.kind[points]
            a, b = kind[:-1], kind[1:]
            begins[1:-1] |= (b == 0) & (a != 0) | (a == 1) | (b == 1) | (a != b) & (a > 1) & (b > 1)
        starts = np.flatnonzero(begins[:-1])
        ends = np.r_[starts[1:], len(points)]
        document = np.searchsorted(first[lengths > 0], starts, "right") - 1
        keys = np.array([spread(self.seed ^ spread(d)) for d, t in zip(documents, texts, strict=True) if t], np.uint64)
        opening = np.searchsorted(starts, first[lengths > 0])
        place = np.arange(1, len(starts) + 1) - opening[document] if len(starts) else starts
        out, counts, at = [], [], 0
        while at < len(starts):
            stop = max(at + 1, int(np.searchsorted(ends, starts[at] + PARTS, "right")))
            states = spread(place[at:stop].astype(np.uint64) * np.uint64(PLACE) + keys[document[at:stop]])
            symbols = v.of[points[starts[at] : ends[stop - 1]]]
            ids, n = self.written(*self.merged(symbols, ends[at:stop] - starts[at], states))
            out.append(ids)
            counts.append(n)
            at = stop
        ids = np.concatenate(out) if out else np.zeros(0, np.int32)
        edges = np.r_[0, np.cumsum(np.concatenate(counts))] if counts else np.zeros(1, np.int64)
        cuts = np.searchsorted(starts, np.r_[first, len(points)])
        return [ids[a:b] for a, b in zip(edges[cuts[:-1]].tolist(), edges[cuts[1:]].tolist(), strict=True)]


def encode(text: str, encoder: Encoder, document: int | None = None) -> np.ndarray:
    """The ids of one text. ``document``: what tells its draws from those of other texts, else that of the encoder."""
    return encoder.encode([text], [encoder.document if document is None else document])[0]


def decode(ids, v: Vocabulary) -> str:
    """The text of ids, without the space that was put before it."""
    raw = b"".join(map(v.text.__getitem__, ids.tolist() if isinstance(ids, np.ndarray) else ids))
    return raw[1:].decode("utf-8", "surrogatepass")


def portions(batch: pa.RecordBatch):
    """A batch in slices of about ``2 * PARTS`` bytes of text (column 1), a longer text by itself."""
    size = np.asarray(pc.fill_null(pc.binary_length(batch.column(1)), 0)).astype(np.int64)
    held, at = np.cumsum(size), 0
    while at < batch.num_rows:
        stop = max(at + 1, int(np.searchsorted(held, held[at] - size[at] + 2 * PARTS, "right")))
        yield batch.slice(at, stop - at)
        at = stop


def tokenized(docs: DataFrame, vocabulary: Vocabulary | None = None, dropout: float = 0.1, seed: int = 11, copy: str | None = None) -> DataFrame:
    """Every whole text as ids, and whether they decode to it again: (``doc_id``, ``n_tokens``, ``ids``, ``lossless``).

    Each candidate merge is skipped with probability ``dropout``, by draws that depend on seed, document, copy and the
    place of the word's occurrence. So reruns agree, and each occurrence of a word, in a document or in copies of it, is
    cut by itself. ``copy`` names the column that tells rows of one id apart; without it they get the same ids. With
    dropout 0 the ids are those of the plain encoder.

    Documents are encoded where they are, no shuffle, all parts of some texts in step. Null text: as empty,
    no ids. Null id: told apart by text. Repeated rows: one result each. Very long texts: whole. Empty table: empty
    result. Other columns are not read.
    """
    v = docs.sparkSession.sparkContext.broadcast(vocabulary or load())

    def run(batches):
        coder = Encoder(v.value, dropout, seed)
        for batch in batches:
            for part in portions(batch):
                texts = [t or "" for t in part.column(1).to_pylist()]
                made = coder.encode(texts, part.column(2).to_pylist())
                same = [decode(ids, v.value) == text for ids, text in zip(made, texts, strict=True)]
                lengths = np.fromiter(map(len, made), np.int32, len(made))
                flat = np.concatenate(made) if made else np.zeros(0, np.int32)
                lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(lengths)].astype(np.int32)), pa.array(flat, pa.int32()))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(lengths.astype(np.int64)), lists, pa.array(same, pa.bool_())], names=["doc_id", "n_tokens", "ids", "lossless"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    key = F.xxhash64("doc_id", F.when(F.col("doc_id").isNull(), F.col("text")), F.col(copy) if copy else F.lit(0))
    return docs.select("doc_id", "text", key.alias("key")).mapInArrow(run, f"doc_id {kind}, n_tokens long, ids array<int>, lossless boolean")


def detokenized(rows: DataFrame, vocabulary: Vocabulary | None = None) -> DataFrame:
    """(``doc_id``, ``text``) of rows with ``doc_id`` and ``ids``; null ids give null."""
    v = rows.sparkSession.sparkContext.broadcast(vocabulary or load())

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([None if i is None else decode(i, v.value) for i in batch.column(1).to_pylist()], pa.string())], names=["doc_id", "text"])

    return rows.select("doc_id", "ids").mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, text string")


def op4_merge_dropout(spark, sf_dir):
    from .common import table

    return tokenized(table(spark, sf_dir, "documents"))
