"""Token counts without token ids.

Each distinct pre-token is counted once, by the public library. Per-document frequencies of
pre-tokens are inverted in blocks of documents: a row holds a pre-token, a block, and which
documents of the block have it, once or how often. These rows join the piece counts, are summed
per block inside the tasks, and a last small shuffle by block adds up each document. A block's list
of its documents goes along under a key of its own.

Very frequent pre-tokens have one row a block, whose join partition Spark can split. Null text
counts as empty; empty texts have 0 tokens; a very long text is a block of its own, and frequencies
of any size are kept. Repeated rows, and rows with equal or null ids, stay rows of their own. An empty
table gives an empty one. Only doc_id and text are read, so other columns may have any name.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import tokens

#: A block ends at so many characters or documents.
BLOCK_CHARS, BLOCK_DOCS = 30_000_000, 1 << 16
#: Distinct pre-tokens that a task holds before it hands them to Spark's distinct().
HELD = 600_000
#: Sums that a task holds before it hands them on.
HELD_SUMS = 2_000_000
#: With a block's number: what the row that lists its documents goes under. No pre-token has letters and digits.
HEADER = "block"


def pieces_per_pre_token(docs: DataFrame, file: str) -> DataFrame:
    """pre, n: every distinct pre-token with the number of its tokens."""

    def in_order(held: set):  # neighbours share letters, which shuffle files compress
        yield from pa.Table.from_arrays([pa.array(sorted(held), pa.string())], ["pre"]).to_batches(20_000)

    def distinct(batches):
        path, held = tokens.vocabulary(file), set()
        for batch in batches:
            for text in batch.column(0):
                held.update(tokens.pre_tokens(path, text.as_py() or ""))
                if len(held) >= HELD:
                    yield from in_order(held)
                    held = set()
        if held:
            yield from in_order(held)

    def count(batches):
        t = tokens.tokenizer(tokens.vocabulary(file))
        for batch in batches:
            n = [len(e.ids) for e in t.encode_batch_fast(batch.column(0).to_pylist(), add_special_tokens=False)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64())], ["pre", "n"])

    return docs.select("text").mapInArrow(distinct, "pre string").distinct().mapInArrow(count, "pre string, n long")


def inverted_frequencies(docs: DataFrame, file: str) -> DataFrame:
    """pre, block, once (16-bit ordinals of documents with it once), more (ordinal, frequency)."""
    names = ["pre", "block", "once", "more"]

    def binary(values: np.ndarray, ends: np.ndarray) -> pa.Array:
        offsets = np.concatenate([[0], ends]).astype(np.int32) * values.itemsize
        return pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(offsets), pa.py_buffer(values.tobytes())])

    def emit(block: int, words: dict, codes: list, ids: list, sizes: list):
        order = sorted(words, key=words.__getitem__)  # by code
        rank = np.array(sorted(range(len(order)), key=order.__getitem__), dtype=np.int64)
        new = np.empty(len(order), dtype=np.int64)
        new[rank] = np.arange(len(order))
        key = new[np.concatenate(codes)] if codes else np.zeros(0, np.int64)
        key *= BLOCK_DOCS
        key += np.repeat(np.arange(len(codes), dtype=np.uint16), [len(c) for c in codes])
        codes.clear()
        key.sort()
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])[: len(key)])
        freq = np.diff(np.append(first, len(key)))
        key = key[first]
        while (big := freq > 65535).any():  # a frequency beyond 16 bits becomes several
            key, freq = np.concatenate([key, key[big]]), np.concatenate([np.where(big, 65535, freq), freq[big] - 65535])
            at = np.argsort(key, kind="stable")
            key, freq = key[at], freq[at]
        word, ordinal, single = key // BLOCK_DOCS, key % BLOCK_DOCS, freq == 1
        ends = [np.searchsorted(word[m], np.arange(len(order)), "right") for m in (single, ~single)]
        head = np.array([-1 if i is None else i for i in ids], dtype="<i8").tobytes(), np.array([[n, i is None] for n, i in zip(sizes, ids)], dtype="<i8").tobytes()
        yield pa.RecordBatch.from_arrays([pa.array([f"{HEADER}{block}"]), pa.array([block], pa.int64()), pa.array([head[0]], pa.binary()), pa.array([head[1]], pa.binary())], names)
        once = binary(ordinal[single].astype("<u2"), ends[0])
        more = binary((ordinal[~single] << 16 | freq[~single]).astype("<u4"), ends[1])
        yield from pa.Table.from_arrays([pa.array([order[i] for i in rank], pa.string()), pa.array(np.full(len(order), block)), once, more], names).to_batches(20_000)

    def run(batches):
        path, block = tokens.vocabulary(file), TaskContext.get().partitionId() << 20
        words, codes, ids, sizes, chars = {}, [], [], [], 0
        for batch in batches:
            for doc_id, text in zip(batch.column(0), batch.column(1)):
                text = text.as_py() or ""
                found = tokens.pre_tokens(path, text)
                for w in set(found):
                    if w not in words:
                        words[w] = len(words)
                codes.append(np.fromiter(map(words.__getitem__, found), dtype=np.int32, count=len(found)))
                ids.append(doc_id.as_py())
                sizes.append(len(text.encode()))
                chars += len(text)
                if chars >= BLOCK_CHARS or len(ids) == BLOCK_DOCS:
                    yield from emit(block, words, codes, ids, sizes)
                    block += 1
                    words, codes, ids, sizes, chars = {}, [], [], [], 0
        if ids:
            yield from emit(block, words, codes, ids, sizes)

    return docs.select("doc_id", "text").mapInArrow(run, "pre string, block long, once binary, more binary")


def _values(column: pa.Array, dtype: str) -> tuple[np.ndarray, np.ndarray]:
    """All items of a binary column, and how many each row has."""
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int32, count=len(column) + column.offset + 1)[column.offset :]
    size = np.dtype(dtype).itemsize
    data = np.frombuffer(column.buffers()[2] or b"", dtype=np.uint8)[offsets[0] : offsets[-1]]
    return np.frombuffer(data.tobytes(), dtype=dtype), np.diff(offsets) // size


def _partial_sums(batches):
    """Sum pieces by block and document as far as this task has them; headers pass through."""
    keys, sums, held = [], [], 0

    def summed():
        k, back = np.unique(np.concatenate(keys), return_inverse=True)
        return k, np.bincount(back, np.concatenate(sums), len(k)).astype(np.int64)

    def flush():
        k, v = summed()
        blocks, first = np.unique(k >> 16, return_index=True)
        for b, i, j in zip(blocks, first, [*first[1:], len(k)]):
            yield pa.RecordBatch.from_arrays([pa.array([b], pa.int64()), pa.array([False]), pa.array([(k[i:j] & 0xFFFF).astype("<u2").tobytes()], pa.binary()), pa.array([v[i:j].astype("<u4" if v[i:j].max() < 2**32 else "<u8").tobytes()], pa.binary())], ["block", "header", "a", "b"])

    for batch in batches:
        pre, block, once, more, n = batch.columns
        head = np.flatnonzero(n.is_null().to_numpy(zero_copy_only=False))  # no pre-token, so no pieces
        for i in head:
            yield pa.RecordBatch.from_arrays([block.slice(i, 1), pa.array([True]), once.slice(i, 1), more.slice(i, 1)], ["block", "header", "a", "b"])
        if len(head):
            rest = pa.array(~np.isin(np.arange(len(pre)), head))
            block, once, more, n = (x.filter(rest) for x in (block, once, more, n))
        if not len(block):
            continue
        base, n = block.to_numpy().astype(np.int64) << 16, n.to_numpy()
        one, ones = _values(once, "<u2")
        many, manys = _values(more, "<u4")
        keys.append(np.concatenate([np.repeat(base, ones) + one, np.repeat(base, manys) + (many >> 16)]))
        sums.append(np.concatenate([np.repeat(n, ones), np.repeat(n, manys) * (many & 0xFFFF)]).astype(np.float64))
        held += len(keys[-1])
        if held > HELD_SUMS:
            k, v = summed()
            keys, sums, held = [k], [v.astype(np.float64)], len(k)
            if held > HELD_SUMS // 2:
                yield from flush()
                keys, sums, held = [], [], 0
    if keys:
        yield from flush()


def _documents(rows: pa.Table) -> pa.Table:
    """The rows of one block -> its documents."""
    head = rows.filter(pa.compute.field("header"))
    ids, info = np.frombuffer(head.column("a")[0].as_py(), dtype="<i8"), np.frombuffer(head.column("b")[0].as_py(), dtype="<i8").reshape(-1, 2)
    total = np.zeros(len(ids), dtype=np.int64)
    for a, b in zip(*(rows.filter(~pa.compute.field("header")).column(c) for c in ("a", "b"))):
        at = np.frombuffer(a.as_py(), dtype="<u2")
        raw = b.as_py()
        total[at] += np.frombuffer(raw, dtype="<u4" if len(raw) == 4 * len(at) else "<u8").astype(np.int64)
    return pa.table({"doc_id": pa.array(ids, pa.int64(), mask=info[:, 1] == 1), "n_bytes": info[:, 0], "n_tokens": total})


def count_tokens(docs: DataFrame, file: str = "byte_bpe_50k.json", limit: int = 1024) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for every row of ``docs``."""
    joined = inverted_frequencies(docs, file).join(pieces_per_pre_token(docs, file), "pre", "left")
    sums = joined.select("pre", "block", "once", "more", "n").mapInArrow(_partial_sums, "block long, header boolean, a binary, b binary")
    out = sums.groupBy("block").applyInArrow(_documents, "doc_id long, n_bytes long, n_tokens long")
    return out.withColumn("over_limit", F.col("n_tokens") > limit)
