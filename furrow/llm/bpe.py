"""BPE encoding and decoding by speculation and verification.

Greedy longest match proposes the tokens of each distinct pre-token. A proposal is right when
every token encodes to itself and no merge would have crossed a border between two neighbours;
that is tested for all distinct neighbouring pairs at once on arrays. Only words that fail go
through exact merging. A task works on one Arrow batch at a time, without any shuffle.

When would a merge cross a border a|b? Let the right spine of ``a`` be a, its right part, that
part's right part, ... and the left spine of ``b`` likewise. A spine node x is there until the
merge that consumes it, of rank next(x) (never, for a and b themselves). Merges run in rank
order and from left to right, so the border is crossed exactly if some pair (x, y) has a merge
of rank r with r < next(x) and r <= next(y).

Null text counts as empty; empty texts have 0 tokens; a very long text is encoded whole, in a batch
of its own; ties of ranks go from left to right, as in the library. Repeated rows, and rows with equal
or null ids, are encoded alike, each for itself. An empty table gives an empty one. Only doc_id and text
are read, so other columns may have any name.
"""

from __future__ import annotations

import functools
import heapq
import json

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import tokens

NEVER = np.int64(1) << 40
#: Distinct pre-tokens remembered by a worker; beyond that it starts anew, results don't change.
REMEMBERED = 400_000


def byte_letters() -> dict[int, str]:
    """The printable stand-in for each byte in byte-level vocabularies."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {b: chr(b) for b in shown}
    hidden = (b for b in range(256) if b not in letters)
    return letters | {b: chr(256 + i) for i, b in enumerate(hidden)}


class Bpe:
    """Tables of one byte-level BPE file, and encoding of pre-tokens by them."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        of_letter = {c: b for b, c in byte_letters().items()}
        self.path = path
        self.special = tokens.special_tokens(path)
        raw = {i: bytes(of_letter[c] for c in t) for t, i in model["vocab"].items()}
        raw |= {i: s.encode() for s, i in self.special.items()}
        n = max(raw) + 1
        self.raw = [raw.get(i, b"") for i in range(n)]
        self.length = np.array([len(x) for x in self.raw], dtype=np.int64)
        self.start = np.concatenate([[0], np.cumsum(self.length)[:-1]])
        self.pool = np.frombuffer(b"".join(self.raw), dtype=np.uint8)
        vocab = model["vocab"]
        self.merge: dict[tuple[int, int], tuple[int, int]] = {}
        left, right = np.full(n, -1, dtype=np.int64), np.full(n, -1, dtype=np.int64)
        born = np.full(n, -1, dtype=np.int64)
        for rank, pair in enumerate(model["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            x, y, z = vocab[a], vocab[b], vocab[a + b]
            self.merge[x, y] = (rank, z)
            if born[z] < 0:
                left[z], right[z], born[z] = x, y, rank
        keys = np.array([x * n + y for x, y in self.merge], dtype=np.int64)
        order = np.argsort(keys)
        self.pair_key, self.pair_rank = keys[order], np.array([r for r, _ in self.merge.values()], dtype=np.int64)[order]
        self.n, self.left, self.right, self.born = n, left, right, born
        ordinary = {self.raw[i]: i for i in vocab.values()}
        self.by_bytes = ordinary
        self.longest = max(map(len, ordinary))
        self.right_spine, self.right_until = self._spine(right)
        self.left_spine, self.left_until = self._spine(left)
        self.sound = self._sound()

    def _spine(self, part: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each token the nodes down one edge, -1 padded, and the rank that consumes each."""
        node, until = np.arange(self.n), np.full(self.n, NEVER)
        nodes, untils = [], []
        while (node >= 0).any():
            nodes.append(node)
            untils.append(until)
            held = np.maximum(node, 0)
            until = np.where(node >= 0, self.born[held], -1)
            node = np.where(node >= 0, part[held], -1)
        return np.stack(nodes, 1), np.stack(untils, 1)

    def _sound(self) -> np.ndarray:
        """Tokens whose own bytes encode to themselves: their two parts are sound and compatible,
        and their merge is the one that the table gives for these parts."""
        sound = np.array([len(x) == 1 for x in self.raw])
        order = np.argsort(self.born, kind="stable")
        order = order[self.born[order] >= 0]
        inner = np.ones(self.n, dtype=bool)
        inner[order] = self._apart(self.left[order], self.right[order], self.born[order])
        for z in order:
            sound[z] = inner[z] and sound[self.left[z]] and sound[self.right[z]]
        return sound

    def _apart(self, a: np.ndarray, b: np.ndarray, limit: np.ndarray | None = None) -> np.ndarray:
        """For each pair: no merge of rank below ``limit`` crosses the border."""
        bad = np.zeros(len(a), dtype=bool)
        for i in range(self.right_spine.shape[1]):
            x, x_until = self.right_spine[a, i], self.right_until[a, i]
            if not (x >= 0).any():
                break
            for j in range(self.left_spine.shape[1]):
                y, y_until = self.left_spine[b, j], self.left_until[b, j]
                at = np.flatnonzero((x >= 0) & (y >= 0) & ~bad)
                if not len(at):
                    continue
                key = x[at] * self.n + y[at]
                place = np.minimum(np.searchsorted(self.pair_key, key), len(self.pair_key) - 1)
                rank = np.where(self.pair_key[place] == key, self.pair_rank[place], NEVER)
                crossed = (rank < x_until[at]) & (rank <= y_until[at]) & (rank < NEVER)
                if limit is not None:
                    crossed &= rank < limit[at]
                bad[at[crossed]] = True
        return ~bad

    def compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Per neighbouring pair whether both tokens would stand side by side."""
        keys, back = np.unique(a * self.n + b, return_inverse=True)
        return self._apart(keys // self.n, keys % self.n)[back]

    def greedy(self, word: bytes) -> list[int]:
        out, at, known, end = [], 0, self.by_bytes, len(word)
        while at < end:
            for size in range(min(self.longest, end - at), 0, -1):
                t = known.get(word[at : at + size])
                if t is not None:
                    out.append(t)
                    at += size
                    break
        return out

    def exact(self, word: bytes) -> list[int]:
        """Merge by rank, leftmost first; O(n log n) in the length of the word."""
        ids = [self.by_bytes[word[i : i + 1]] for i in range(len(word))]
        n, merge = len(ids), self.merge
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        heap = [(*merge[ids[i], ids[i + 1]], i, i + 1) for i in range(n - 1) if (ids[i], ids[i + 1]) in merge]
        heap = [(rank, i, j, z, ids[i], ids[j]) for rank, z, i, j in heap]
        heapq.heapify(heap)
        while heap:
            _, i, j, z, x, y = heapq.heappop(heap)
            if ids[i] != x or ids[j] != y or after[i] != j:
                continue
            ids[i], ids[j] = z, -1
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
            for p, q in ((before[i], i), (i, after[i])):
                if 0 <= p and q < n and (ids[p], ids[q]) in merge:
                    rank, made = merge[ids[p], ids[q]]
                    heapq.heappush(heap, (rank, p, q, made, ids[p], ids[q]))
        return [t for t in ids if t >= 0]

    def words(self, words: list[str]) -> tuple[list[bytes], int]:
        """Ids (little-endian 32-bit) of each distinct pre-token, and how many needed merging."""
        if not words:
            return [], 0
        raw = [w.encode() for w in words]
        proposed = [[self.special[w]] if w in self.special else self.greedy(r) for w, r in zip(words, raw)]
        sizes = np.array([len(p) for p in proposed])
        flat = np.fromiter((t for p in proposed for t in p), dtype=np.int64, count=int(sizes.sum()))
        word = np.repeat(np.arange(len(words)), sizes)
        wrong = np.zeros(len(words), dtype=bool)
        special = np.isin(flat, list(self.special.values()))
        wrong[word[~self.sound[flat] & ~special]] = True
        near = np.flatnonzero(word[1:] == word[:-1])
        if len(near):
            wrong[word[near[~self.compatible(flat[near], flat[near + 1])]]] = True
        for i in np.flatnonzero(wrong):
            proposed[i] = self.exact(raw[i])
        return [np.array(p, dtype="<u4").tobytes() for p in proposed], int(wrong.sum())

    def decode(self, ids: np.ndarray) -> bytes:
        """Bytes of the ids, gathered from the vocabulary on arrays."""
        if not len(ids):
            return b""
        size = self.length[ids]
        end = np.cumsum(size)
        at = np.arange(end[-1]) + np.repeat(self.start[ids] - (end - size), size)
        return self.pool[at].tobytes()


@functools.cache
def bpe(path: str) -> Bpe:
    return Bpe(path)


class Encoder:
    """Encodes whole texts, remembering distinct pre-tokens."""

    def __init__(self, path: str):
        self.bpe, self.path, self.known = bpe(path), path, {}

    def ids(self, texts: list[str]) -> list[bytes]:
        split = [tokens.pre_tokens(self.path, t) for t in texts]
        if len(self.known) > REMEMBERED:
            self.known = {}
        known = self.known
        new = list({w for ws in split for w in ws if w not in known})
        known.update(zip(new, self.bpe.words(new)[0]))
        return [b"".join(map(known.__getitem__, ws)) for ws in split]


def encode(docs: DataFrame, vocabulary_file: str = "byte_bpe_50k.json", batch_chars: int = 4_000_000) -> DataFrame:
    """doc_id, ids (binary, little-endian unsigned 32-bit) and decoded (the text of those ids)."""

    def run(batches):
        encoder = Encoder(tokens.vocabulary(vocabulary_file))
        for batch in batches:
            for part in slices(batch, batch_chars):
                ids = encoder.ids([t or "" for t in part.column(1).to_pylist()])
                out = [encoder.bpe.decode(np.frombuffer(x, dtype="<u4")).decode("utf-8", "replace") for x in ids]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(ids, pa.binary()), pa.array(out, pa.string())], ["doc_id", "ids", "decoded"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, ids binary, decoded string")


def slices(batch: pa.RecordBatch, most: int, column: int = 1):
    """Parts of a batch of about ``most`` bytes of text each; one row at least. Behind the last
    one, memory that the parts took and Arrow still holds goes back to the system."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    if not len(sizes):
        return
    group = (np.cumsum(sizes) - sizes) // most
    edges = [0, *(np.flatnonzero(np.diff(group)) + 1), len(sizes)]
    for a, b in zip(edges, edges[1:]):
        yield batch.slice(a, b - a)
    pa.default_memory_pool().release_unused()


def digests(docs: DataFrame, vocabulary_file: str = "byte_bpe_50k.json") -> DataFrame:
    """The contract's columns: ids and decoded text stand behind them, only digests leave."""
    coded = encode(docs, vocabulary_file)
    return coded.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )
