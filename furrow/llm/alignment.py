"""Alignment of two tokenizers' tokens over the same bytes, by a sweep over their end events.

Both tokenizers cut space+text into tokens; a token's event lies at its end. One pass over the
documents emits the union of the A and B events, packed: a row holds the ids of one side's events of
one run of offsets, and their offsets follow from the tokens' lengths. The events are repartitioned
by document and sorted by offset within partitions, then stream through a machine whose state is
the open group alone: the tokens of both sides since the last offset where both ended. Between two
neighbouring events lies one pair of tokens that overlap, so each distinct event offset closes one
link, and each common offset one group. A document of any length streams in runs.

Links are counted by id pair over the corpus: pre-aggregated by task, then summed. Documents take
the counts back in two ways that together are exact. Pairs of which the corpus has at least a
millionth of all links are at most a million (``HEAVY``), so they are broadcast; all other pairs
are joined, and none of them is frequent enough to make a hot key.

Texts that are null or empty, or whose joined token bytes differ from space+text on either side
(such as texts with U+2581), have no tokens: zeros and an empty digest. Strings of special tokens
inside texts are plain text. Ties for a B id's highest count all count as best. Repeated rows, and
rows with equal or null ids, are aligned each for itself. An empty table gives an empty one. Only
doc_id and text are read, so other columns may have any name.
"""

from __future__ import annotations

import functools
import hashlib
import re
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import tokens
from .bpe import bpe, slices
from .common import scratch, stored

#: Byte offsets that one packed run of events spans.
RUN = 1 << 16
#: Pairs that are broadcast at most; see above.
HEAVY = 1_000_000
#: A worker forgets the words it knows beyond this many characters; results don't change.
REMEMBERED = 8_000_000

EVENTS = "_key long, run long, side int, doc_id long, ids binary"
LINKS = "_key long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs binary, times binary"


class Words:
    """Token ids (little-endian unsigned 32-bit) of distinct words, as far as they are remembered."""

    def __init__(self, split, encode):
        self.split, self.encode, self.known, self.held = split, encode, {}, 0

    def ids(self, texts: list[str]) -> list[bytes | None]:
        """The ids of each text; None where a word's tokens hold other bytes than the word."""
        if self.held > REMEMBERED:
            self.known, self.held = {}, 0
        words, known = [self.split(t) for t in texts], self.known
        new = list(set().union(*words).difference(known))
        known.update(zip(new, self.encode(new)))
        self.held += sum(map(len, new))
        out: list[bytes | None] = []
        for ws in words:
            try:
                out.append(b"".join(map(known.__getitem__, ws)))
            except TypeError:  # one is None
                out.append(None)
        return out


class ByteLevel:
    """A byte-level BPE file: the ids of texts and the bytes of ids.

    Where ids follow the order of merges they are ranks, and the rank coder takes the short words."""

    def __init__(self, path: str):
        self.coder = c = bpe(path)
        self.raw = c.raw
        made = np.flatnonzero(c.born >= 0)
        self.ranked = bool((np.diff(c.born[made]) > 0).all()) and len(c.merge) == len(made)
        if self.ranked:
            import tiktoken

            self.ranks = tiktoken.Encoding("words", pat_str=r"[\s\S]+", mergeable_ranks={self.raw[i]: i for i in c.by_bytes.values()}, special_tokens={})

    def words(self) -> Words:
        return Words(tokens.ordinary_pre_tokens, self._encoded)

    def _encoded(self, words: list[str]) -> list[bytes]:
        if not self.ranked:
            return self.coder.words(words)[0]
        one, long = self.ranks.encode_ordinary, [w for w in words if len(w) > 100]
        known = dict(zip(long, self.coder.words(long)[0]))
        return [known[w] if len(w) > 100 else array("I", one(w)).tobytes() for w in words]


class Pieces:
    """A piece model that puts a space before a text. Where no piece goes on behind a space inside it and
    no text is rewritten, a text's pieces are those of its words, each with the spaces before it."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = m = sentencepiece.SentencePieceProcessor(model_file=path)
        names = [m.id_to_piece(i) for i in range(m.get_piece_size())]
        self.raw = [bytes([int(p[3:5], 16)]) if m.is_byte(i) else b"" if m.is_control(i) else p.replace("▁", " ").encode() for i, p in enumerate(names)]
        probe = "a  Åﬁ b\t\n c"
        whole = b"".join(self.raw[i] for i in m.encode(probe)) == f" {probe}".encode()
        self.by_word = whole and not any(re.search("[^▁]▁", p) for p in names)
        self.lone = m.piece_to_id("▁")

    def words(self) -> Words:
        split = re.compile(" *[^ ]+| +").findall if self.by_word else lambda text: [text]
        return Words(split, self._encoded)

    def _encoded(self, words: list[str]) -> list[bytes | None]:
        """Each word begins with a space, which the model puts there again."""
        out: list[bytes | None] = []
        for word, ids in zip(words, self.model.encode([w[1:] for w in words], num_threads=1)):
            ids = [self.lone] if word == " " else ids
            same = b"".join(map(self.raw.__getitem__, ids)) == word.encode()
            out.append(array("I", ids).tobytes() if same else None)
        return out


@functools.cache
def vocabulary(path: str) -> ByteLevel | Pieces:
    return ByteLevel(path) if path.endswith(".json") else Pieces(path)


def lengths(path: str) -> np.ndarray:
    """Bytes of each id's token."""
    return np.array([len(x) for x in vocabulary(path).raw], dtype=np.int64)


def events(docs: DataFrame, a: str, b: str, run: int = RUN, batch_chars: int = 2_000_000) -> DataFrame:
    """_key (of the row), run, side (0: A, 1: B), doc_id, ids: the end events of each document, packed.

    A document without tokens has one row without ids."""

    def rows(batches):
        paths = [tokens.vocabulary(x) for x in (a, b)]
        sides = [(vocabulary(p).words(), lengths(p)) for p in paths]
        for batch in batches:
            for part in slices(batch, batch_chars, 2):
                texts = [t or "" for t in part.column(2).to_pylist()]
                coded = [words.ids([f" {t}" for t in texts]) for words, _ in sides]
                out: list[tuple] = []
                for key, doc_id, text, *both in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), texts, *coded):
                    if not text or None in both:
                        out.append((key, 0, 0, doc_id, b""))
                        continue
                    for side, raw in enumerate(both):
                        ids = np.frombuffer(raw, dtype="<u4")
                        at = (np.cumsum(sides[side][1][ids]) - 1) // run
                        cuts = [0, *(np.flatnonzero(np.diff(at)) + 1), len(ids)]
                        packed = ids.astype("<u2") if len(sides[side][1]) <= 1 << 16 else ids
                        out += [(key, int(at[lo]), side, doc_id, packed[lo:hi].tobytes()) for lo, hi in zip(cuts, cuts[1:])]
                columns = [pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.binary()))]
                yield pa.RecordBatch.from_arrays(columns, ["_key", "run", "side", "doc_id", "ids"])

    keyed = docs.select("doc_id", "text").select(F.monotonically_increasing_id().alias("_key"), "doc_id", "text")
    return keyed.mapInArrow(rows, EVENTS)


class Open:
    """The document that streams through: what is known of it, and its open group."""

    def __init__(self, key: int, doc_id: int | None):
        self.key, self.doc_id, self.sha, self.begun = key, doc_id, hashlib.sha256(), False
        self.tail = [np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)]


class Machine:
    """Groups and links from packed events in the order of document, run and side."""

    def __init__(self, length_a: np.ndarray, length_b: np.ndarray):
        self.length = (length_a, length_b)
        self.kind = ["<u2" if len(x) <= 1 << 16 else "<u4" for x in self.length]
        self.size = max(map(len, self.length))
        shown = [str(i) for i in range(self.size)]
        self.text = [*(f",{s}" for s in shown), *(f"|{s}" for s in shown), *(f";{s}" for s in shown), *shown]
        self.pair = np.dtype("<u4") if len(length_a) * len(length_b) <= 1 << 32 else np.dtype("<u8")
        self.open: Open | None = None

    def step(self, keys: list[int], sides: list[int], doc_ids: list, runs: list[bytes]) -> list[tuple]:
        """Rows of LINKS: of each document what the given runs close, and the digest of one that has ended."""
        out, docs = [], [self.open] if self.open is not None else []
        taken: list[tuple[list, list]] = [([d.tail[0]], [d.tail[1]]) for d in docs]
        for key, side, doc_id, run in zip(keys, sides, doc_ids, runs):
            if not docs or docs[-1].key != key:
                docs.append(Open(key, doc_id))
                taken.append(([], []))
            taken[-1][side].append(np.frombuffer(run, dtype=self.kind[side]).astype(np.int64))
        counts = [np.array([sum(map(len, t[s])) for t in taken]) for s in (0, 1)]
        a, b = (np.concatenate([x for t in taken for x in t[s]] or [np.zeros(0, dtype=np.int64)]) for s in (0, 1))
        ends_a, ends_b = np.cumsum(self.length[0][a]), np.cumsum(self.length[1][b])
        mark = np.zeros(1 + max(ends_a[-1] if len(a) else 0, ends_b[-1] if len(b) else 0), dtype=np.uint8)
        mark[ends_a] = 1
        mark[ends_b] |= 2
        ends = np.flatnonzero(mark)
        common = ends[mark[ends] == 3]
        ends = ends[ends <= (common[-1] if len(common) else 0)]
        used = [int(np.searchsorted(e, common[-1] if len(common) else 0, "right")) for e in (ends_a, ends_b)]
        docs[-1].tail = [a[used[0] :], b[used[1] :]]  # its open group
        for n, whole, some in zip(counts, (len(a), len(b)), used):
            n[-1] -= whole - some
        a, b = a[: used[0]], b[: used[1]]
        kind = mark[ends]
        both = kind == 3
        group = np.cumsum(both) - both
        own = (group[(kind & 1) > 0], group[(kind & 2) > 0])
        edge = np.concatenate([[0], ends_a])[np.cumsum(counts[0])]  # where each document ends
        doc = np.searchsorted(edge, ends, "left")
        link = a[np.cumsum(kind & 1) - (kind & 1)] * len(self.length[1]) + b[np.cumsum(kind >> 1) - (kind >> 1)]
        n_links, n_groups = np.bincount(doc, minlength=len(docs)), np.bincount(doc[both], minlength=len(docs))
        words = self._words(a, b, own, counts, int(both.sum()), docs)
        stop = np.cumsum(counts[0] + counts[1])
        span = len(self.length[0]) * len(self.length[1])
        code, times = np.unique(doc * span + link, return_counts=True)
        cut = np.searchsorted(code, np.arange(len(docs) + 1) * span)
        for i, d in enumerate(docs):
            if n_links[i]:
                d.sha.update("".join(words[stop[i] - counts[0][i] - counts[1][i] : stop[i]]).encode())
                d.begun = True
            own_pairs = np.diff(code[cut[i] : cut[i + 1]] - i * span, prepend=0).astype(self.pair)
            done = None if i == len(docs) - 1 else self._digest(d)
            out.append((d.key, d.doc_id, int(counts[0][i]), int(counts[1][i]), int(n_groups[i]), int(n_links[i]), done, own_pairs.tobytes(), times[cut[i] : cut[i + 1]].astype("<u4").tobytes()))
        self.open = docs[-1]
        return out

    def end(self) -> list[tuple]:
        """The row that closes the last document."""
        d, self.open = self.open, None
        return [] if d is None else [(d.key, d.doc_id, 0, 0, 0, 0, self._digest(d), b"", b"")]

    @staticmethod
    def _digest(d: Open) -> str:
        return d.sha.hexdigest() if d.begun else ""

    def _words(self, a, b, own, counts, groups: int, docs) -> list[str]:
        """The tokens as text in the order of the digest: by group, A's before B's, each with what stands before it."""
        n = [np.bincount(g, minlength=groups) for g in own]
        start = [np.cumsum(x) - x for x in n]
        at = [np.arange(len(a)), np.arange(len(b))]
        code = np.empty(len(a) + len(b), dtype=np.int64)
        first = np.where(at[0] == start[0][own[0]], 2, 0) if len(a) else at[0]
        new = np.array([not d.begun for d in docs]) & (counts[0] > 0)
        first[(np.cumsum(counts[0]) - counts[0])[new]] = 3
        code[at[0] + start[1][own[0]]] = a + self.size * first
        code[at[1] + (start[0] + n[0])[own[1]]] = b + self.size * (at[1] == start[1][own[1]])
        return list(map(self.text.__getitem__, code.tolist()))


def links(run: DataFrame, a: str, b: str, batch_bytes: int = 2_000_000) -> DataFrame:
    """LINKS: by document, in one row or more, its counts, its digest (in one row) and its distinct id pairs with how
    often each is linked; pairs are packed as differences of ascending a * (number of B ids) + b."""

    def rows(batches):
        machine = Machine(*(lengths(tokens.vocabulary(x)) for x in (a, b)))
        names = [c.split()[0] for c in LINKS.split(", ")]
        kinds = (*[pa.int64()] * 6, pa.string(), pa.binary(), pa.binary())
        packed = lambda out: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names)
        for batch in batches:
            for part in slices(batch, batch_bytes, 4):
                yield packed(machine.step(*(part.column(i).to_pylist() for i in (0, 2, 3, 4))))
        if out := machine.end():
            yield packed(out)

    return run.repartition("_key").sortWithinPartitions("_key", "run", "side").mapInArrow(rows, LINKS)


def _unpacked(pairs: bytes, times: bytes, kind: np.dtype) -> tuple[np.ndarray, np.ndarray]:
    return np.cumsum(np.frombuffer(pairs, dtype=kind).astype(np.int64)), np.frombuffer(times, dtype="<u4").astype(np.int64)


def pair_counts(linked: DataFrame, kind: np.dtype, flush: int = 1_000_000) -> DataFrame:
    """pair, n: links of each id pair over all documents; summed by task before the shuffle."""

    def rows(batches):
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def summed():
            code, back = np.unique(np.concatenate([c for c, _ in held]), return_inverse=True)
            n = np.zeros(len(code), dtype=np.int64)
            np.add.at(n, back, np.concatenate([t for _, t in held]))
            return code, n

        fresh = 0
        for batch in batches:
            for pairs, times in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                held.append(_unpacked(pairs, times, kind))
                fresh += len(held[-1][0])
                if fresh > flush:
                    held, fresh = [summed()], 0
                    if len(held[0][0]) > flush:
                        yield pa.RecordBatch.from_arrays(list(map(pa.array, held.pop())), ["pair", "n"])
        if held:
            yield pa.RecordBatch.from_arrays(list(map(pa.array, summed())), ["pair", "n"])

    return linked.select("pairs", "times").mapInArrow(rows, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))


def align(docs: DataFrame, a: str = "byte_bpe_50k.json", b: str = "piece_bpe_32k.model", heavy: int = HEAVY) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256: a row for each row of ``docs``."""
    spark = docs.sparkSession
    size_a, size_b = (len(lengths(tokens.vocabulary(x))) for x in (a, b))
    kind = np.dtype("<u4") if size_a * size_b <= 1 << 32 else np.dtype("<u8")
    with scratch(spark):
        linked = stored(links(events(docs, a, b), a, b), "links", keep=True)
        counted = stored(pair_counts(linked, kind), "pair-counts")
        best = counted.groupBy((F.col("pair") % size_b).alias("b")).agg(F.max("n").alias("most"))
        flagged = counted.withColumn("b", F.col("pair") % size_b).join(F.broadcast(best), "b")  # a row a B id
        table = stored(flagged.select("pair", "n", (F.col("n") == F.col("most")).alias("top")), "pairs", keep=True)
        total = counted.agg(F.sum("n")).first()[0] or 0
        least = -(-total // heavy) or 1
        frequent = table.where(F.col("n") >= least).orderBy("pair").toArrow()  # total / least rows at most
        given = spark.sparkContext.broadcast([frequent.column(i).to_numpy() for i in range(3)])

    def found(pairs: bytes, times: bytes):
        code, k = _unpacked(pairs, times, kind)
        known, n, top = given.value
        at = np.minimum(np.searchsorted(known, code), max(len(known) - 1, 0))
        hit = known[at] == code if len(known) else np.zeros(len(code), dtype=bool)
        return code, k, hit, at, n, top

    def scored(batches):
        for batch in batches:
            sums = []
            for pairs, times in zip(batch.column(7).to_pylist(), batch.column(8).to_pylist()):
                _, k, hit, at, n, top = found(pairs, times)
                sums.append((int((k[hit] * n[at[hit]]).sum()), int(k[hit][top[at[hit]]].sum())))
            more = [pa.array(c, pa.int64()) for c in zip(*sums)] if sums else [pa.array([], pa.int64())] * 2
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(7)), *more], [*batch.schema.names[:7], "count_sum", "n_best"])

    def rare(batches):
        for batch in batches:
            for key, pairs, times in zip(*(batch.column(i).to_pylist() for i in range(3))):
                code, k, hit, *_ = found(pairs, times)
                if not hit.all():
                    yield pa.RecordBatch.from_arrays([pa.array(np.full((~hit).sum(), key)), pa.array(code[~hit]), pa.array(k[~hit])], ["_key", "pair", "k"])

    numbers = ["n_a", "n_b", "n_groups", "n_links", "count_sum", "n_best"]
    mine = linked.mapInArrow(scored, ", ".join(LINKS.split(", ")[:7]) + ", count_sum long, n_best long")
    rest = linked.select("_key", "pairs", "times").mapInArrow(rare, "_key long, pair long, k long")
    rest = rest.join(table.where(F.col("n") < least), "pair").groupBy("_key").agg(
        F.sum(F.col("k") * F.col("n")).alias("count_sum"), F.sum(F.when(F.col("top"), F.col("k")).otherwise(0)).alias("n_best")
    )
    every = mine.unionByName(rest, allowMissingColumns=True).groupBy("_key").agg(
        F.max("doc_id").alias("doc_id"), *(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in numbers), F.max("groups_sha256").alias("groups_sha256")
    )
    return every.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
