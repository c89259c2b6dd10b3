"""Packing along a space-filling curve.

Every document becomes token ids and a hashed vector of them, projected to three dimensions and
turned into a place on a Hilbert curve. Documents are range-sorted by that place; laid end to
end in this order they are cut every ``length`` tokens, so neighbours in content share
sequences and only the last sequence is not full. Positions are running sums over the narrow
sorted rows; ids are read from the written token table and never sorted.

Null text counts as empty: such a document is its end id alone. A very long text is cut into as many
pieces as it needs. Equal documents, repeated rows and ties on the curve are told apart by id and row,
so no place gathers in one task. An empty table gives an empty one. Only doc_id and text are read, so
other columns may have any name.
"""

from __future__ import annotations

import functools
import json
import re
import unicodedata
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from . import tokens
from .bpe import slices
from .common import row_numbers, sized, stored

DIMENSIONS, BITS, BUCKETS = 3, 10, 1024
REMEMBERED = 300_000
#: Texts with these are encoded whole: separators that Unicode does not call white space, a letter that
#: is lower-cased by its place in the word, and scripts without spaces.
UNLIKE = re.compile("[\x1c-\x1f\u03a3\u3000-\U0010ffff]")
#: White space beyond ASCII.
SPACES = "\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f"
FAR_SPACE, TO_SPACE = re.compile(f"[{SPACES}]"), str.maketrans(SPACES, " " * len(SPACES))
#: Marks that stand around words; an apostrophe may begin a piece with letters, and isn't one.
MARKS = ".,;:!?#*$%&|<>()[]{}-_/=+\""


@functools.cache
def _without_cleaning(path: str):
    """The same vocabulary and merges behind a split at spaces alone, and which ids end a word."""
    with open(path, encoding="utf-8") as f:
        form = json.load(f)
    letters = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}
    form |= {"normalizer": None, "added_tokens": [], "pre_tokenizer": {"type": "Sequence", "pretokenizers": [{"type": "WhitespaceSplit"}, letters]}}
    ends = np.zeros(1 + max(form["model"]["vocab"].values()), dtype=bool)
    suffix = form["model"]["end_of_word_suffix"]
    ends[[i for t, i in form["model"]["vocab"].items() if t.endswith(suffix)]] = True
    return Tokenizer.from_str(json.dumps(form)), ends


class ChunkEncoder:
    """Ids of whole texts for vocabularies that drop white space and case, as the library gives them.

    No piece reaches across white space there, nor from letters to the marks around them, so texts
    are lower-cased and encoded chunk by chunk: a chunk of letters between marks is put together
    from its parts, others go to the library, and what was encoded is remembered. Texts with special strings,
    odd separators, or letters that aren't composed go to the library whole."""

    def __init__(self, file: str):
        path = tokens.vocabulary(file)
        self.library, self.special = tokens.tokenizer(path), tuple(tokens.special_tokens(path))
        self.plain, self.ends = _without_cleaning(path)
        top = self.library.get_vocab_size()
        self.kind = "<u2" if top < 1 << 16 else "<u4"
        self.known: dict[str, bytes] = {"": b""}

    def _words(self, words: list[str], together: int = 100) -> list[bytes]:
        """Runs of lower-case letters, each one piece, many in a call; a word's last id ends it."""
        lines = [" ".join(words[i : i + together]) for i in range(0, len(words), together)]
        ids = np.array(list(chain.from_iterable(e.ids for e in self.plain.encode_batch_fast(lines, add_special_tokens=False))), dtype=self.kind)
        at = (np.flatnonzero(self.ends[ids]) + 1) * ids.itemsize
        raw = ids.tobytes()
        return [raw[a:b] for a, b in zip([0, *at.tolist()], at.tolist())]

    def _encoded(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, dtype=self.kind).tobytes() for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, chunks: list[str]) -> None:
        known = self.known
        words, rest, parts, whole = [c for c in chunks if c.isalpha()], [c for c in chunks if not c.isalpha()], [], set()
        for c in rest:
            left = c.lstrip(MARKS)
            core = left.rstrip(MARKS)
            if core.isalpha():
                parts.append((c, before := c[: len(c) - len(left)], core, after := left[len(core) :]))
                whole.update((before, after))
            else:
                whole.add(c)
        cores = {core for _, _, core, _ in parts if core not in known}.difference(words)
        words += cores
        known.update(zip(words, self._words(words)))
        whole = [c for c in whole if c not in known]
        known.update(zip(whole, self._encoded(whole)))
        for c, before, core, after in parts:
            known[c] = known[before] + known[core] + known[after]

    def ids(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as unsigned numbers of ``kind``."""
        low = [t.lower() for t in texts]
        odd = [
            UNLIKE.search(t) is not None or any(s in x for s in self.special) or not unicodedata.is_normalized("NFC", t) or not unicodedata.is_normalized("NFC", x)
            for t, x in zip(texts, low)
        ]
        plain = pa.array(["" if o else x if FAR_SPACE.search(x) is None else x.translate(TO_SPACE) for x, o in zip(low, odd)], pa.string())
        split = pc.ascii_split_whitespace(plain)
        coded = split.flatten().dictionary_encode()
        if len(self.known) > REMEMBERED:
            self.known = {"": b""}
        chunks = coded.dictionary.to_pylist()
        found = list(map(self.known.get, chunks))
        new = [c for c, ids in zip(chunks, found) if ids is None]
        self._learn(new)
        found = list(map(self.known.__getitem__, chunks))
        # every chunk's ids, by its number, laid end to end
        pool = np.frombuffer(b"".join(found), dtype=self.kind)
        size = np.fromiter(map(len, found), dtype=np.int32, count=len(found)) // pool.itemsize
        number = coded.indices.to_numpy()
        each = size[number]
        end = np.concatenate([np.zeros(1, np.int32), np.cumsum(each, dtype=np.int32)])
        at = np.repeat((np.cumsum(size, dtype=np.int32) - size)[number] - end[:-1], each)
        at += np.arange(end[-1], dtype=np.int32)
        laid = pool[at].tobytes()
        edge = (end[split.offsets.to_numpy()].astype(np.int64) * pool.itemsize).tolist()
        whole = iter(self._encoded([t for t, o in zip(texts, odd) if o]))
        return [next(whole) if o else laid[a:b] for o, a, b in zip(odd, edge, edge[1:])]


def hilbert(points: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Places of integer points (rows; coordinates below 2**bits) on the Hilbert curve.

    Level by level, from the top bit: the orthant's rank in Gray order is the next digit, and
    the frame is turned so that consecutive cells touch."""
    x = points.astype(np.int64).copy()
    n, d = x.shape
    for level in range(bits - 1, 0, -1):
        low = (1 << level) - 1
        for i in range(d):
            set_ = (x[:, i] >> level) & 1 == 1
            x[set_, 0] ^= low
            swap = np.where(set_, 0, (x[:, 0] ^ x[:, i]) & low)
            x[:, 0] ^= swap
            x[:, i] ^= swap
    for i in range(1, d):
        x[:, i] ^= x[:, i - 1]
    turn = np.zeros(n, dtype=np.int64)
    for level in range(bits - 1, 0, -1):
        turn ^= np.where((x[:, -1] >> level) & 1 == 1, (1 << level) - 1, 0)
    x ^= turn[:, None]
    key = np.zeros(n, dtype=np.int64)
    for level in range(bits - 1, -1, -1):
        for i in range(d):
            key = key << 1 | (x[:, i] >> level) & 1
    return key


def _projector(seed: int = 0):
    rng = np.random.default_rng(seed)
    bucket = rng.integers(0, BUCKETS, 1 << 17)
    sign = rng.choice([-1.0, 1.0], (BUCKETS, DIMENSIONS))

    def place(ids: list[np.ndarray]) -> np.ndarray:
        vectors = np.stack([np.bincount(bucket[i.astype(np.int64) & 0x1FFFF], minlength=BUCKETS) for i in ids])
        vectors = np.sqrt(vectors)
        vectors /= np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-9)
        spread = 1 / (1 + np.exp(-1.7 * (vectors @ sign)))
        return hilbert(np.minimum((spread * (1 << BITS)).astype(np.int64), (1 << BITS) - 1))

    return place


def tokenise(docs: DataFrame, file: str, end_id: int, batch_chars: int = 4_000_000) -> DataFrame:
    """doc_id, ids (binary, 16-bit where the vocabulary allows), doc_tokens and curve key."""

    def run(batches):
        encoder, place = ChunkEncoder(file), _projector()
        end = np.array(end_id, dtype=encoder.kind).tobytes()
        for batch in batches:
            for part in slices(batch, batch_chars):
                raw = [x + end for x in encoder.ids([t or "" for t in part.column(1).to_pylist()])]
                ids = [np.frombuffer(x, dtype=encoder.kind) for x in raw]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(raw, pa.binary()), pa.array([len(i) for i in ids], pa.int64()), pa.array(np.concatenate([place(ids[k : k + 512]) for k in range(0, len(ids), 512)]))],
                    ["doc_id", "ids", "doc_tokens", "curve"],
                )

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, ids binary, doc_tokens long, curve long")


def pack(docs: DataFrame, file: str = "word_bpe_49k.json", length: int = 4096, end_id: int = 2) -> DataFrame:
    """doc_id, start, ids (binary, unsigned 32-bit), doc_tokens, sequence_id, offset per piece."""
    table = stored(tokenise(docs, file, end_id).withColumn("_row", F.monotonically_increasing_id()), "tokens")
    rows, ids = table.agg(F.count("*"), F.coalesce(F.sum("doc_tokens"), F.lit(0))).first()
    narrow = table.select("_row", "doc_id", "doc_tokens", "curve")
    placed = row_numbers(narrow, ["curve", "doc_id", "_row"], "curve", "_begin", "doc_tokens", 32 * rows).select("_row", "_begin")

    def cut(batches):
        for batch in batches:
            doc_id, ids, n, begin = batch.columns
            out: list[list] = [[] for _ in range(6)]
            for d, raw, n_, at in zip(doc_id.to_pylist(), ids.to_pylist(), n.to_pylist(), begin.to_pylist()):
                own = np.frombuffer(raw, dtype="<u2" if len(raw) == 2 * n_ else "<u4").astype("<u4")
                start = 0
                while start < n_:
                    sequence, offset = divmod(at + start, length)
                    stop = min(n_, start + length - offset)
                    for values, v in zip(out, (d, start, own[start:stop].tobytes(), n_, sequence, offset)):
                        values.append(v)
                    start = stop
            kinds = [pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
            yield from pa.Table.from_arrays([pa.array(v, k) for v, k in zip(out, kinds)], ["doc_id", "start", "ids", "doc_tokens", "sequence_id", "offset"]).to_batches(4096)

    whole = sized(table.select("_row", "doc_id", "ids", "doc_tokens").join(placed, "_row").select("doc_id", "ids", "doc_tokens", "_begin"), 2 * ids)
    return whole.mapInArrow(cut, "doc_id long, start long, ids binary, doc_tokens long, sequence_id long, offset long")


def pieces(docs: DataFrame, file: str = "word_bpe_49k.json", length: int = 4096, end_id: int = 2) -> DataFrame:
    """The contract's columns, digests of the ids in their place."""
    packed = pack(docs, file, length, end_id)
    return packed.select("doc_id", "start", F.expr("octet_length(ids) div 4").cast("long").alias("length"), F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
