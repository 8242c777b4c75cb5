"""Operator 4: language-model scores by online logistic context mixing."""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import keep, release, table
from .words import SPACE, U, batches, hashes, mix, spans

#: Words that are leaves of the tree of words (others are escapes), and the most frequent of them, of
#: which the last one seen is a context.
VOCABULARY, COMMON = 1 << 16, 64
#: Hashed contexts of two bytes each, for spelling.
BYTE_CONTEXTS = 4096
#: Characters of a slice of texts, whose n-grams are sent once.
SLICE = 1 << 20
#: Entries of the table of counts that one part holds, as a power of two: the parts grow with the input.
PART_BITS = 21
#: Refinements of a text's weights come after 16, 16, 32, 64, ... up to so many symbols.
LONGEST = 1024
END, START = np.uint64(0xE0D0E0D0E0D0E0D1), np.uint64(0x51A7051A7051A707)
_LOWER = np.arange(256)
_LOWER[65:91] += 32


# ---- trees of bits, mixed from what all texts and what one context says

class Tree:
    """A Huffman tree over leaves 0 .. n - 1; every inner node is a binary decision."""

    def __init__(self, weights: np.ndarray):
        self.n = n = len(weights)
        heap = [(int(max(1, x)), i) for i, x in enumerate(weights)]
        heapq.heapify(heap)
        self.kids = np.zeros((max(0, n - 1), 2), np.int64)
        for node in range(n - 1):
            (a, i), (b, j) = heapq.heappop(heap), heapq.heappop(heap)
            self.kids[node] = i, j
            heapq.heappush(heap, (a + b, n + node))
        depth = np.zeros(2 * n - 1, np.int64)
        for node in range(n - 2, -1, -1):
            depth[self.kids[node]] = depth[n + node] + 1
        inner = depth[n:]
        self.levels = [np.flatnonzero(inner == d) for d in range(int(inner.max()) + 1)] if n > 1 else []

    def sums(self, leaves: np.ndarray) -> np.ndarray:
        """Of rows of leaf counts: the counts of all nodes."""
        out = np.zeros((len(leaves), 2 * self.n - 1), np.float32)
        out[:, : self.n] = leaves
        for level in reversed(self.levels):
            out[:, self.n + level] = out[:, self.kids[level, 0]] + out[:, self.kids[level, 1]]
        return out

    def logs(self, one: np.ndarray, zero: np.ndarray) -> np.ndarray:
        """Of rows of log-probabilities of both sides of each node: those of the leaves."""
        out = np.zeros((len(one), 2 * self.n - 1), np.float32)
        for level in self.levels:
            for side, log in enumerate((zero, one)):
                out[:, self.kids[level, side]] = out[:, self.n + level] + log[:, level]
        return out[:, : self.n]


def _stretch(n0: np.ndarray, n1: np.ndarray) -> np.ndarray:
    return np.log((n1 + 0.4) / (n0 + 0.4))


def _gate(n0: np.ndarray, n1: np.ndarray) -> np.ndarray:
    """What a context knows of a decision: how much, and whether it saw both sides."""
    return np.minimum(np.log2(n0 + n1 + 1), 7).astype(np.int64) * 2 + (np.minimum(n0, n1) > 0)


def blend(counts: np.ndarray, rows: int = 1 << 20) -> np.ndarray:
    """log P(leaf | context) of contexts x leaves, from the counts of both.

    Each bit of a leaf's path has two predictors, the tree's totals and the context's own counts,
    mixed in the logistic domain with weights gated by what the context knows. The weights are
    learnt from all counts, each event predicted by the others (its own count taken away).
    """
    k, n = counts.shape
    tree = Tree(counts.sum(0))
    if n < 2:
        return np.zeros((k, n), np.float32)
    total = tree.sums(counts.sum(0, dtype=np.float64)[None])[0]
    prior = _stretch(total[tree.kids[:, 0]], total[tree.kids[:, 1]])
    weights = np.tile([1.0, 0.0], (16, 1))
    weights[1:] = 0.4, 0.6
    step = max(1, rows // n)
    for _ in range(3):
        grad, bend = np.zeros((16, 2)), np.zeros((16, 3))
        for a in range(0, k, step):
            c = tree.sums(counts[a : a + step])
            n0, n1 = c[:, tree.kids[:, 0]], c[:, tree.kids[:, 1]]
            r, at = np.nonzero(n0 + n1 > 0)
            n0, n1, p0 = n0[r, at], n1[r, at], prior[at]
            for y, times, m0, m1 in ((1.0, n1, n0, np.maximum(n1 - 1, 0)), (0.0, n0, np.maximum(n0 - 1, 0), n1)):
                g, s = _gate(m0, m1), _stretch(m0, m1)
                p = 1 / (1 + np.exp(-np.clip(weights[g, 0] * p0 + weights[g, 1] * s, -20, 20)))
                e, b = times * (y - p), times * p * (1 - p)
                for i, x in enumerate((p0, s)):
                    grad[:, i] += np.bincount(g, e * x, 16)
                for i, x in enumerate((p0 * p0, p0 * s, s * s)):
                    bend[:, i] += np.bincount(g, b * x, 16)
        for g in range(1, 16):
            weights[g] += np.linalg.solve([[bend[g, 0] + 1, bend[g, 1]], [bend[g, 1], bend[g, 2] + 1]], grad[g])
    out = np.zeros((k, n), np.float32)
    for a in range(0, k, step):
        c = tree.sums(counts[a : a + step])
        n0, n1 = c[:, tree.kids[:, 0]], c[:, tree.kids[:, 1]]
        g = _gate(n0, n1)
        z = np.clip(weights[g, 0] * prior + weights[g, 1] * _stretch(n0, n1), -20, 20)
        out[a : a + step] = tree.logs(-np.log1p(np.exp(-z)), -np.log1p(np.exp(z)))
    return out


def byte_contexts(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hashed context of the two bytes before, symbol) of all bytes of words and their ends (256)."""
    x = np.where(SPACE[data], 256, _LOWER[data])
    one = np.concatenate([[256], x[:-1]])
    two = np.where(one == 256, 256, np.concatenate([[256, 256], x[:-2]])[: len(x)])
    real = (x != 256) | (one != 256)
    slot = ((one * 257 + two) * 0x9E3779B1 & 0xFFFFFFFF) >> 20
    return slot[real], x[real]


def _learns(doc_id: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(7)) != 2, F.lit(True))


def token_counts(docs: DataFrame) -> DataFrame:
    """(kind, h, c): kind 0 counts words by hash and ends, kind 1 the bytes of all words and their ends
    by hashed context (``byte_contexts``)."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size, bytes_ = 0, np.zeros(BYTE_CONTEXTS * 257, np.int64)

        def merge() -> tuple[np.ndarray, np.ndarray]:
            h = np.concatenate([x[0] for x in held])
            order = np.argsort(h)
            h, c = h[order], np.concatenate([x[1] for x in held])[order]
            first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
            return h[first], np.add.reduceat(c, first)

        def rows(kind, h, c):
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(h), kind, np.int32)), pa.array(h.view(np.int64)), pa.array(c)], ["kind", "h", "c"])

        for p in (q.slice(a, 1024) for q in parts for a in range(0, q.num_rows, 1024)):
            texts = p.column(0).to_pylist()
            for x, y in batches(texts):
                data, starts, ends, first = spans(texts[x:y])
                h = np.sort(hashes(data, starts, ends))
                at = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])) if len(h) else np.zeros(0, int)
                held.append((np.append(h[at], END), np.append(np.diff(np.append(at, len(h))), y - x)))
                ctx, sym = byte_contexts(data)
                bytes_ += np.bincount(ctx * 257 + sym, minlength=len(bytes_))
                size += len(at)
                if size > 2_000_000:
                    held[:] = [merge()]
                    size = len(held[0][0])
                    if size > 1_500_000:
                        yield rows(0, *held.pop())
                        size = 0
        if held:
            yield rows(0, *merge())
        at = np.flatnonzero(bytes_)
        yield rows(1, at.astype(U), bytes_[at])

    return docs.select("text").mapInArrow(run, "kind int, h long, c long").groupBy("kind", "h").agg(F.sum("c").alias("c"))


# ---- coded texts, and the counts of their n-grams

class Coder:
    """Leaves of words: the most frequent by hash, then the escape and the end; and what is learnt of them."""

    def __init__(self, words: np.ndarray, counts: np.ndarray, tokens: int, types: int, ends: int, byte_counts: np.ndarray):
        self.k = k = len(words)
        self.esc, self.end = k, k + 1
        self.counts, self.ends, self.tokens, self.types = counts.astype(float), ends, tokens, types
        #: Training tokens and types that are escapes; a type not seen has their chance by types.
        self.rare = max(0, tokens - ends - int(counts.sum()))
        self.rare_types = max(1, types - k - (ends > 0))
        self.letters = blend(byte_counts.reshape(BYTE_CONTEXTS, 257) + 0.01)
        self.leaves: np.ndarray | None = None
        # words by hash: open addressing, a quarter full
        self.bits = max(4, (4 * k - 1).bit_length())
        self.keys, self.ids = np.zeros(1 << self.bits, U), np.full(1 << self.bits, -1, np.int32)
        todo, at, self.rounds = np.arange(k), (words >> U(64 - self.bits)).astype(np.int64), 0
        while len(todo):
            free = np.flatnonzero(self.ids[at] < 0)
            _, one = np.unique(at[free], return_index=True)
            put = free[one]
            self.ids[at[put]], self.keys[at[put]] = todo[put], words[todo[put]]
            left = np.ones(len(todo), bool)
            left[put] = False
            todo, at = todo[left], (at[left] + 1) & ((1 << self.bits) - 1)
            self.rounds += 1
        self.hashes = words

    def word_ids(self, h: np.ndarray) -> np.ndarray:
        """Leaves of words by hash; the escape for others."""
        out = np.full(len(h), self.esc, np.int32)
        todo, at = np.arange(len(h)), (h >> U(64 - self.bits)).astype(np.int64)
        for _ in range(self.rounds):
            got = self.ids[at]
            same = (self.keys[at] == h[todo]) & (got >= 0)
            out[todo[same]] = got[same]
            go = ~same & (got >= 0)
            todo, at = todo[go], (at[go] + 1) & ((1 << self.bits) - 1)
            if not len(todo):
                break
        return out

    def spelt(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """log-probabilities of words spelt in bytes, each with its end."""
        n = ends - starts
        at = np.repeat(starts, n + 1) + np.arange(len(n) + n.sum()) - np.repeat(np.cumsum(n + 1) - n - 1, n + 1)
        text = np.append(data, 32)[at].astype(np.uint8)
        text[np.cumsum(n + 1) - 1] = 32
        slot, sym = byte_contexts(text)
        total = np.concatenate([[0], np.cumsum(self.letters[slot, sym], dtype=float)])
        last = np.cumsum(n + 1)
        return total[last] - total[last - n - 1]

    def common(self, ids: np.ndarray, begin: np.ndarray) -> np.ndarray:
        """The last very common word before each token (it tells the language or kind of text)."""
        at = np.where(ids < min(COMMON, self.k), np.arange(len(ids)), -1)
        at = np.concatenate([[-1], np.maximum.accumulate(at)[:-1]]) if len(at) else at
        return np.where(at >= np.repeat(begin[:-1], np.diff(begin)), ids[at], COMMON)


def _planes(x: np.ndarray, width: int, z: zstandard.ZstdCompressor) -> bytes:
    """The ``width`` low bytes of whole numbers, plane by plane, compressed."""
    return z.compress(np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes())


def _unplane(b: bytes, width: int, z: zstandard.ZstdDecompressor) -> np.ndarray:
    raw = np.frombuffer(z.decompress(b), np.uint8).reshape(width, -1)
    out = np.zeros((raw.shape[1], 8), np.uint8)
    out[:, :width] = raw.T
    return out.reshape(-1).view("<u8")


CODED = "batch long, doc_id array<long>, lens binary, learns binary, bytes array<long>, ids binary, rare binary, spelt binary"


def code(docs: DataFrame, shared) -> DataFrame:
    """Slices of texts as leaves, a row each: their ids, lengths in tokens, whether they train, the
    hashes of escapes in order, and the log-probabilities of those of texts held out as spelt in bytes."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k, z = shared.value, zstandard.ZstdCompressor(level=1)
        batch = TaskContext.get().partitionId() << 32
        for p in (q.slice(a, 2048) for q in parts for a in range(0, q.num_rows, 2048)):
            texts, learns = p.column(1).to_pylist(), p.column(2).to_numpy(zero_copy_only=False)
            for x, y in batches(texts, SLICE):
                data, starts, ends, first = spans(texts[x:y])
                h = hashes(data, starts, ends)
                word = k.word_ids(h)
                ids = np.full(len(h) + y - x, k.end, np.int64)
                text = np.repeat(np.arange(y - x), np.diff(first))
                ids[np.arange(len(h)) + text] = word
                off = word == k.esc
                out = off & ~learns[x:y][text]
                row = {"batch": [batch], "doc_id": [p.column(0).slice(x, y - x).to_pylist()], "lens": [_planes(np.diff(first) + 1, 4, z)], "learns": [learns[x:y].tobytes()],
                       "bytes": [[len(t.encode("utf-8", "surrogatepass")) if t else 0 for t in texts[x:y]]],
                       "ids": [_planes(ids, 3, z)], "rare": [_planes(h[off], 8, z)], "spelt": [z.compress(k.spelt(data, starts[out], ends[out]).astype(np.float32).tobytes())]}
                batch += 1
                yield pa.RecordBatch.from_pydict(row, schema=_schema(CODED))

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", _learns(F.col("doc_id")).alias("learns")).mapInArrow(run, CODED)


def _schema(ddl: str) -> pa.Schema:
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "double": pa.float64(), "boolean": pa.bool_(), "array<long>": pa.list_(pa.int64()), "array<double>": pa.list_(pa.float64())}
    return pa.schema([(c.split()[0], kinds[c.split()[1]]) for c in ddl.split(", ")])


@dataclass
class Slice:
    """One coded row: tokens of texts, and the hashes of what they say with the one and two before."""

    lens: np.ndarray
    begin: np.ndarray
    text: np.ndarray
    learns: np.ndarray
    ids: np.ndarray
    off: np.ndarray
    grams: list[np.ndarray]

    def __init__(self, row: dict, k: Coder):
        z = zstandard.ZstdDecompressor()
        self.lens = _unplane(row["lens"], 4, z).astype(np.int64)
        self.begin = np.concatenate([[0], np.cumsum(self.lens)])
        self.text = np.repeat(np.arange(len(self.lens)), self.lens)
        self.learns = np.frombuffer(row["learns"], bool)
        self.ids = _unplane(row["ids"], 3, z).astype(np.int64)
        self.off = np.flatnonzero(self.ids == k.esc)
        w = np.append(k.hashes, [U(0), END])[self.ids]
        rare = _unplane(row["rare"], 8, z)
        w[self.off] = rare
        one = np.concatenate([[START], w[:-1]])
        one[self.begin[:-1]] = START
        two = np.concatenate([[START], one[:-1]])
        two[self.begin[:-1]] = START
        self.grams = [mix(w * U(0x9E3779B97F4A7C15) + one), mix(mix(w * U(0xC2B2AE3D27D4EB4F) + one) * U(0x165667B19E3779F9) + two), mix(rare + U(0x27D4EB2F165667C5))]

    def entries(self) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
        """(distinct hashes, sorted; their counts in training texts; where each n-gram's is)."""
        whole = np.concatenate(self.grams)
        weight = np.concatenate([self.learns[self.text]] * 2 + [self.learns[self.text[self.off]]])
        order = np.argsort(whole, kind="stable")
        new = np.diff(whole[order], prepend=~whole[order[:1]]) != 0 if len(order) else np.zeros(0, bool)
        at = np.empty(len(order), np.int64)
        at[order] = np.cumsum(new) - 1
        first = np.flatnonzero(new)
        counts = np.add.reduceat(weight[order].astype(np.int64), first) if len(first) else np.zeros(0, np.int64)
        n = len(self.ids)
        return whole[order[first]], counts, [at[:n], at[n : 2 * n], at[2 * n :]]

    def own(self, at: np.ndarray, n: int) -> np.ndarray:
        """How often each n-gram is in its own text, if that trains; ``n`` texts at most."""
        key = at * n + self.text
        order = np.argsort(key, kind="stable")
        new = np.flatnonzero(np.diff(key[order], prepend=-1) != 0)
        size = np.diff(np.append(new, len(key)))
        out = np.empty(len(key), np.int64)
        out[order] = np.repeat(size, size)
        return out * self.learns[self.text]


def look_up(coded: DataFrame, shared, parts: int) -> DataFrame:
    """(batch, part, counts): how often training texts hold each distinct n-gram of each slice.

    A slice sends an n-gram once, in the order of hashes (whose first bytes take little room so), with
    its own count; the ``parts`` go by hash, add up, and answer every slice in the order asked. No n-gram has more rows than there are slices.
    """

    def ask(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k, z = shared.value, zstandard.ZstdCompressor(level=1)
        for p in rows:
            for i in range(p.num_rows):
                row = p.slice(i, 1).to_pylist()[0]
                h, c, _ = Slice(row, k).entries()
                part = (((h >> U(40)) * U(parts)) >> U(24)).astype(np.int64)
                cuts = np.flatnonzero(np.diff(part, prepend=-1) != 0)
                ends = np.append(cuts[1:], len(h))
                yield pa.RecordBatch.from_pydict({"batch": [row["batch"]] * len(cuts), "part": part[cuts].astype(np.int32), "hash": [_planes(h[a:b] >> U(8), 7, z) for a, b in zip(cuts, ends, strict=True)], "n": [_planes(c[a:b], 4, z) for a, b in zip(cuts, ends, strict=True)]}, schema=_schema("batch long, part int, hash binary, n binary"))

    def answer(t: pa.Table) -> pa.Table:
        d, z = zstandard.ZstdDecompressor(), zstandard.ZstdCompressor(level=1)
        asked = [_unplane(b.as_py(), 7, d) for b in t.column("hash")]
        h, n = np.concatenate(asked), np.concatenate([_unplane(b.as_py(), 4, d).astype(np.int64) for b in t.column("n")])
        order = np.argsort(h)
        first = np.flatnonzero(np.diff(h[order], prepend=~h[order[:1]]) != 0)
        total = np.empty(len(h), np.int64)
        total[order] = np.repeat(np.add.reduceat(n[order], first), np.diff(np.append(first, len(h))))
        ends = np.cumsum([0, *map(len, asked)])
        counts = [_planes(total[a:b], 5, z) for a, b in zip(ends, ends[1:], strict=False)]
        return pa.table({"batch": t.column("batch"), "part": t.column("part"), "counts": pa.array(counts, pa.binary())})

    return coded.select("batch", "lens", "learns", "ids", "rare").mapInArrow(ask, "batch long, part int, hash binary, n binary").groupBy("part").applyInArrow(answer, "batch long, part int, counts binary")


# ---- the bits of a text, and their mixing

#: A token's decisions: is it one that other texts have after the two before it? After the one before it?
#: Then it is drawn by their counts; else from the tree of words.
ORDERS = 2
#: Contexts of a bit: the counts of what stands before; the last eight outcomes; the run of outcomes that
#: were yes with the last count. Each has this many slots.
SLOTS, PREDICTORS, GATES = 256, 3, 16


def _size(n: np.ndarray, most: int) -> np.ndarray:
    return np.minimum(np.frexp(n.astype(float))[1], most)


SETTLED = "doc_id array<long>, lens binary, learns binary, bytes array<long>, known array<long>, logs array<double>, tail array<double>, before binary, came binary"


def settle(coded: DataFrame, found: DataFrame, shared) -> DataFrame:
    """Slices with, for each token, what the counts before it are and which decisions came out how;
    ``tail`` holds the log-probability of a text's words once these are known."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        k, z, d = shared.value, zstandard.ZstdCompressor(level=1), zstandard.ZstdDecompressor()
        row = left.to_pylist()[0]
        s = Slice(row, k)
        _, _, at = s.entries()
        order = np.argsort(right.column("part").to_numpy())
        blobs = right.column("counts").to_pylist()
        total = np.concatenate([_unplane(blobs[i], 5, d).astype(np.int64) for i in order])
        texts = len(s.lens)
        two, three = (total[a] - s.own(a, texts) for a in at[:2])  # without the text's own
        single = np.append(k.counts, [0, k.ends])[s.ids]
        single[s.off] = total[at[2]]
        first = s.begin[:-1]
        ctx2 = np.concatenate([[0], two[:-1]])
        ctx1 = np.concatenate([[0], single[:-1]])
        ctx2[first], ctx1[first] = 0, k.ends
        b2 = (ctx2 > 0) & (three > 0)
        b1 = ~b2 & (ctx1 > 0) & (two > 0)
        tail = k.leaves[k.common(s.ids, s.begin), s.ids].astype(float)
        rare = np.log(np.where(single[s.off] > 0, single[s.off], k.rare_types) / (k.rare + k.rare_types))
        out = np.flatnonzero(~s.learns[s.text[s.off]])
        rare[out] += np.where(single[s.off[out]] > 0, 0, np.frombuffer(d.decompress(row["spelt"]), np.float32))
        tail[s.off] += rare
        tail[b2] = np.log(three[b2] / ctx2[b2])
        tail[b1] = np.log(two[b1] / ctx1[b1])
        before = _size(ctx2, 15) * 16 + _size(np.sqrt(ctx1), 15)
        came = b2 | b1 << 1 | _size(three, 15) << 4
        add = lambda x: np.bincount(s.text, x, texts)
        return pa.Table.from_pydict({"doc_id": [row["doc_id"]], "lens": [row["lens"]], "learns": [row["learns"]], "bytes": [row["bytes"]], "known": [add(single > 0).astype(int).tolist()],
                                     "logs": [add(np.log10(single + 1)).tolist()], "tail": [add(tail).tolist()], "before": [_planes(before, 1, z)], "came": [_planes(came, 1, z)]}, schema=_schema(SETTLED))

    return coded.groupBy("batch").cogroup(found.groupBy("batch")).applyInArrow(run, SETTLED)


class Bits:
    """The decisions of a settled slice: for each order, where they are, how they came out, and the
    slots of their contexts and gates."""

    def __init__(self, row: dict):
        d = zstandard.ZstdDecompressor()
        self.lens = _unplane(row["lens"], 4, d).astype(np.int64)
        self.learns = np.frombuffer(row["learns"], bool)
        self.text = np.repeat(np.arange(len(self.lens)), self.lens)
        self.place = np.arange(len(self.text)) - np.repeat(np.cumsum(self.lens) - self.lens, self.lens)
        before, came = (_unplane(row[c], 1, d).astype(np.int64) for c in ("before", "came"))
        b2, yes, level = came & 1, (came & 3) > 0, came >> 4
        self.parts = []
        for order, bit in enumerate((b2, yes.astype(np.int64))):
            past = np.zeros(len(bit), np.int64)
            for i in range(1, 9):
                past[i:] |= np.where(self.place[i:] >= i, bit[:-i], 0) << (i - 1)
            no = np.where((bit == 0) | (self.place == 0), np.arange(len(bit)) - (bit != 0), -1)  # the last token before a run
            run = np.arange(len(bit)) - np.maximum.accumulate(np.maximum(no, -1)) if len(bit) else bit
            run = np.where(self.place > 0, np.concatenate([[0], run[:-1]]), 0)
            last = np.where(self.place > 0, np.concatenate([[0], level[:-1]]), 0)
            long = _size(run, 15)
            at = np.flatnonzero(before >> 4 > 0 if order == 0 else (before & 15 > 0) & (b2 == 0))
            slots = np.stack([before, past, long * 16 + last])[:, at]
            gate = np.minimum(long, 3) * 4 + np.minimum(before >> 4, 3)
            self.parts.append((at, bit[at], slots, gate[at]))


def _each(settled: DataFrame, make, shape: str) -> DataFrame:
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from make(row for p in parts for i in range(p.num_rows) for row in p.slice(i, 1).to_pylist())

    return settled.mapInArrow(run, shape)


def learn(settled: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """(stretched predictions by order, predictor and slot; first weights by order and gate), from all
    training texts: outcomes are counted by context, then one Newton step fits the weights."""

    def count(rows):
        total = np.zeros((ORDERS, PREDICTORS, SLOTS, 2), np.int64)
        for row in rows:
            b = Bits(row)
            for o, (at, bit, slots, _) in enumerate(b.parts):
                m = b.learns[b.text[at]]
                for i in range(PREDICTORS):
                    total[o, i] += np.bincount(slots[i][m] * 2 + bit[m], minlength=2 * SLOTS).reshape(SLOTS, 2)
        yield pa.RecordBatch.from_pydict({"cell": np.arange(total.size, dtype=np.int32), "n": total.ravel().astype(float)})

    def sums(make, size):
        out = np.zeros(size)
        for r in _each(settled, make, "cell int, n double").groupBy("cell").agg(F.sum("n").alias("n")).collect():  # ``size`` rows
            out[r["cell"]] = r["n"]
        return out

    n = sums(count, ORDERS * PREDICTORS * SLOTS * 2).reshape(ORDERS, PREDICTORS, SLOTS, 2)
    says = np.clip(np.log((n[..., 1] + 0.4) / (n[..., 0] + 0.4)), -12, 12)
    start = np.full((ORDERS, GATES, PREDICTORS), 0.4)

    def newton(rows):
        total = np.zeros((ORDERS, GATES, PREDICTORS * (PREDICTORS + 1)))
        for row in rows:
            b = Bits(row)
            for o, (at, bit, slots, gate) in enumerate(b.parts):
                m = b.learns[b.text[at]]
                x = [says[o, i][slots[i][m]] for i in range(PREDICTORS)]
                p = 1 / (1 + np.exp(-np.clip(0.4 * sum(x), -12, 12)))
                e, w = bit[m] - p, p * (1 - p)
                terms = [e * v for v in x] + [w * u * v for u in x for v in x]
                for i, t in enumerate(terms):
                    total[o, :, i] += np.bincount(gate[m], t, GATES)
        yield pa.RecordBatch.from_pydict({"cell": np.arange(total.size, dtype=np.int32), "n": total.ravel()})

    t = sums(newton, start.size * (PREDICTORS + 1)).reshape(ORDERS, GATES, -1)
    for o in range(ORDERS):
        for g in range(GATES):
            bend = t[o, g, PREDICTORS:].reshape(PREDICTORS, PREDICTORS) + 5 * np.eye(PREDICTORS)
            start[o, g] = np.clip(start[o, g] + np.linalg.solve(bend, t[o, g, :PREDICTORS]), -0.5, 2.0)
    return says.astype(np.float32), start.astype(np.float32)


def bits_cost(b: Bits, says: np.ndarray, start: np.ndarray) -> np.ndarray:
    """log-probability of each text's decisions. The weights of a text start as learnt and are refined
    by its own past after 16, 32, 64, ... tokens, at most ``LONGEST`` at a time; a text's own outcomes
    add to what its contexts say as it goes on."""
    texts = len(b.lens)
    total = np.zeros(texts)
    for o, (at, bit, slots, gate) in enumerate(b.parts):
        w = np.tile(start[o], (texts, 1, 1)).reshape(texts * GATES, PREDICTORS)
        bias = np.zeros(texts * GATES)
        place, own = b.place[at], b.text[at]
        order = np.argsort(place, kind="stable")
        place = place[order]
        begin, size, longest = 0, 16, int(b.lens.max()) if texts else 0
        while begin < longest:
            pick = order[slice(*np.searchsorted(place, [begin, begin + size]))]
            g = own[pick] * GATES + gate[pick]
            x = [says[o, i].take(slots[i].take(pick)) for i in range(PREDICTORS)]
            z = bias[g] + sum(w[g, i] * x[i] for i in range(PREDICTORS))
            sign = 2 * bit[pick] - 1
            q = 1 / (1 + np.exp(-np.clip(z, -12, 12) * sign))
            total += np.bincount(own[pick], np.log(q), texts)
            begin += size
            if begin < longest and len(pick):
                e, h = sign * (1 - q), q * (1 - q)
                for i, v in enumerate(x):
                    w[:, i] += 0.5 * np.bincount(g, e * v, len(w)) / (np.bincount(g, h * v * v, len(w)) + 20)
                bias += 0.7 * np.bincount(g, e, len(w)) / (np.bincount(g, h, len(w)) + 2)
            size = min(LONGEST, begin)
    return total


# ---- the operator

def model(train_docs: DataFrame, vocabulary: int) -> tuple[Coder, DataFrame]:
    """(what is counted of words, the kept table of counts) of all rows of ``train_docs`` (text)."""
    counts = keep(token_counts(train_docs), "counts")
    words = counts.where("kind = 0").select("h", "c")
    n, v = words.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1))).first()
    end = words.where(F.col("h") == int(END.view(np.int64))).select("c").first()
    head = words.where(F.col("h") != int(END.view(np.int64))).orderBy(F.desc("c"), "h").limit(vocabulary).toArrow()  # at most ``vocabulary`` rows
    letters = np.zeros(BYTE_CONTEXTS * 257)
    for r in counts.where("kind = 1").toLocalIterator():  # at most BYTE_CONTEXTS * 257 rows
        letters[r["h"]] = r["c"]
    return Coder(head.column(0).to_numpy().view(U), head.column(1).to_numpy(), int(n), int(v), end[0] if end else 0, letters), counts


def count_leaves(coded: DataFrame, k: Coder, shared) -> np.ndarray:
    """How often each leaf follows each last common word, in training texts."""
    width, chunk = k.k + 2, 1 << 14
    cells = (COMMON + 1) * width

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c, d, z = shared.value, zstandard.ZstdDecompressor(), zstandard.ZstdCompressor(level=1)
        total = np.zeros(cells, np.int32)
        for p in rows:
            for r in p.to_pylist():
                lens = _unplane(r["lens"], 4, d).astype(np.int64)
                ids = _unplane(r["ids"], 3, d).astype(np.int64)
                learns = np.repeat(np.frombuffer(r["learns"], bool), lens)
                np.add.at(total, (c.common(ids, np.concatenate([[0], np.cumsum(lens)])) * width + ids)[learns], np.int32(1))
        for a in range(0, cells, chunk):
            part = total[a : a + chunk]
            if part.any():
                yield pa.RecordBatch.from_pydict({"chunk": [a // chunk], "part": [z.compress(part.tobytes())]}, schema=_schema("chunk int, part binary"))

    def add(t: pa.Table) -> pa.Table:
        d, z = zstandard.ZstdDecompressor(), zstandard.ZstdCompressor(level=1)
        whole = sum((np.frombuffer(d.decompress(x.as_py()), np.int32).astype(np.int64) for x in t.column("part")), np.int64(0))
        return pa.table({"chunk": t.column("chunk").slice(0, 1), "part": pa.array([z.compress(whole.tobytes())], pa.binary())})

    out, d = np.zeros(cells, np.int64), zstandard.ZstdDecompressor()
    kept = keep(coded.select("lens", "learns", "ids").mapInArrow(run, "chunk int, part binary").groupBy("chunk").applyInArrow(add, "chunk int, part binary"), "leaves")
    for r in kept.toLocalIterator():  # a number of chunks that follows the vocabulary only
        part = np.frombuffer(d.decompress(bytes(r["part"])), np.int64)
        out[r["chunk"] * chunk : r["chunk"] * chunk + len(part)] = part
    release(kept)
    return out.reshape(COMMON + 1, width)


def score(docs: DataFrame, vocabulary: int = VOCABULARY, part_bits: int = PART_BITS) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte) of every
    row of ``docs`` (doc_id, text).

    Tokens: words, A-Z lower-cased, then one end. Rows whose CRC-32 of the id, as text, leaves 2 by
    7 are held out; all others train, whole. score is the mixing model's log10 probability;
    base_score the unigram's.

    The model codes a token by bits. The first ones ask whether other training texts have it after the
    two tokens before it, then after the one before it; yes draws it by their counts. These counts are
    exact, of all training texts but the text itself, in a table whose parts grow in number with the
    input. What is left goes down a tree of the most frequent words, and other words by their exact
    counts, or, if training texts don't have them, by bytes. Every bit is mixed from several contexts
    with gated weights learnt from the training texts; those of the first kind are refined in each text.

    Defined results: null and empty texts are one end; a null id is not held out; repeated rows
    are scored, and train, each; an empty table gives an empty one; other columns are not read, whatever
    their names. bits_per_byte is null for texts without bytes. Escapes and n-grams are told apart by
    56 bits of hash.
    """
    coder, counts = model(docs.where(_learns(F.col("doc_id"))), vocabulary)
    context = docs.sparkSession.sparkContext
    shared = context.broadcast(coder)
    coded = keep(code(docs, shared), "coded")
    release(counts)
    coder.leaves = blend(count_leaves(coded, coder, shared) + np.full((COMMON + 1, 1), 1e-3))
    whole = context.broadcast(coder)
    tokens = coder.tokens * 7 // 6 + 1
    found = keep(look_up(coded, shared, max(1, min(1 << 24, -(-2 * tokens >> part_bits)))), "found")
    settled = keep(settle(coded, found, whole), "settled")
    release(coded, found)
    says, start = learn(settled)
    spread = float(np.log10(coder.tokens + coder.types + 1))
    n = coder.tokens

    def run(rows):
        for row in rows:
            b = Bits(row)
            total = (np.array(row["tail"]) + bits_cost(b, says, start)) / np.log(10)
            size = np.array(row["bytes"])
            per = np.divide(-total * np.log2(10), size, out=np.zeros(len(size)), where=size > 0)
            yield pa.RecordBatch.from_pydict({"doc_id": row["doc_id"], "held_out": ~b.learns, "n_tokens": b.lens, "n_known": row["known"], "train_tokens": np.full(len(size), n), "base_score": np.array(row["logs"]) - b.lens * spread, "score": total, "bits_per_byte": pa.array(per, mask=size == 0)}, schema=_schema(SCORED))

    return _each(settled, run, SCORED)


SCORED = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, bits_per_byte double"


def op4_mixing_lm(spark, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents"))
