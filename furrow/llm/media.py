"""Media columns: content-addressed payloads in tar shards.

A payload is stored losslessly as a grey PNG, 64 samples of 8 bits a row, and lies in a tar
shard in the shared folder under the digest of its stored form. Table rows carry digest, shard,
offset and length only. Metadata columns are filled by range reads of the first bytes of an
entry; samples are read back by another range read.

A writing task stores a payload once while it remembers it; where several tasks met the same one, or
a task forgot it, every row points to the first copy by (shard, offset). Shards are named by
their content and put in place by a rename, so a task that runs again writes the same shard again.
Reading tasks are dealt out by the bytes that they read.

Null text counts as empty; an empty payload is one row of zeros; a very long text is one entry of its
own size. Equal texts have equal values, and repeated rows or ids stay rows of their own; a tie of
places goes to the smallest. An empty table gives an empty one and no shard. Only doc_id and text are
read, so other columns may have any name.
"""

from __future__ import annotations

import hashlib
import io
import struct
import tarfile
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import slices
from .common import own_dir, sized, stored

WIDTH = 64
SHARD_BYTES = 16_000_000
#: Payload and stored bytes that a task reads back.
READ_BYTES = 32_000_000
#: Places of stored payloads that a writing task remembers beyond its open shard.
REMEMBERED = 50_000
#: The PNG signature and the length of signature and header chunk.
SIGNATURE, HEADER_BYTES = b"\x89PNG\r\n\x1a\n", 33


def payload_of(text: str | None) -> bytes:
    raw = (text or "").encode()
    return raw + bytes(-len(raw) % WIDTH or (WIDTH if not raw else 0))


def to_png(payload: bytes) -> bytes:
    rows = np.frombuffer(payload, dtype=np.uint8).reshape(-1, WIDTH)
    lines = np.zeros((len(rows), WIDTH + 1), dtype=np.uint8)  # byte 0 of a line: no filter
    lines[:, 1:] = rows
    data = zlib.compress(lines.tobytes(), 6)
    most = (1 << 31) - 1
    parts = [(b"IHDR", struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 0, 0, 0, 0))]
    parts += [(b"IDAT", data[i : i + most]) for i in range(0, len(data), most)] + [(b"IEND", b"")]
    return SIGNATURE + b"".join(struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d)) for k, d in parts)


def read_header(head: bytes) -> dict:
    """Width, height, bit depth and colour type from the first ``HEADER_BYTES`` of an entry."""
    if head[:8] != SIGNATURE or head[12:16] != b"IHDR" or zlib.crc32(head[12:29]) != struct.unpack(">I", head[29:33])[0]:
        raise ValueError("no PNG header where the row points")
    width, height, depth, colour = struct.unpack(">IIBB", head[16:26])
    return {"width": width, "height": height, "bit_depth": depth, "colour": colour}


def read_samples(png: bytes) -> np.ndarray:
    header, at, data = read_header(png[:HEADER_BYTES]), HEADER_BYTES, []
    while True:
        size, kind = struct.unpack(">I4s", png[at : at + 8])
        if kind == b"IEND":
            break
        body = png[at + 8 : at + 8 + size]
        if zlib.crc32(kind + body) != struct.unpack(">I", png[at + 8 + size : at + 12 + size])[0]:
            raise ValueError("damaged entry")
        data.append(body)
        at += 12 + size
    lines = np.frombuffer(zlib.decompress(b"".join(data)), dtype=np.uint8).reshape(header["height"], header["width"] + 1)
    if lines[:, 0].any():
        raise ValueError("filtered lines are not written here")
    return lines[:, 1:]


def average_hash(samples: np.ndarray) -> str:
    """64 bits, one for each cell of an 8 by 8 grid: whether it is lighter than the picture."""
    height, width = samples.shape
    edge = np.minimum(np.arange(8) * height // 8, height - 1)
    columns = samples.reshape(height, 8, width // 8).sum(axis=2, dtype=np.int64)
    cells = np.add.reduceat(columns, edge, axis=0) / (np.maximum(np.diff([*edge, height]), 1) * (width // 8))[:, None]
    return np.packbits(cells > samples.mean()).tobytes().hex()


def _files(folder: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder)


def _put(folder: str, content: memoryview) -> str:
    files, path = _files(folder)
    name, part = f"{hashlib.sha256(content).hexdigest()}.tar", f".part-{uuid.uuid4().hex}"
    with files.open_output_stream(f"{path}/{part}") as out:
        out.write(content)
    files.move(f"{path}/{part}", f"{path}/{name}")
    return f"{folder}/{name}"


class _Shard:
    def __init__(self):
        self.buffer, self.entries = io.BytesIO(), {}
        self.tar = tarfile.open(fileobj=self.buffer, mode="w", format=tarfile.USTAR_FORMAT)

    def add(self, digest: str, data: bytes) -> None:
        info = tarfile.TarInfo(f"{digest}.png")
        info.size = len(data)
        self.tar.addfile(info, io.BytesIO(data))
        self.entries[digest] = (-(-len(data) // 512) * 512, len(data), self.buffer.tell())

    def place(self, digest: str) -> tuple[int, int]:
        padded, size, end = self.entries[digest]
        return end - padded, size


def store(docs: DataFrame, folder: str, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Write the payloads; doc_id, n_bytes, digest (of the stored form), shard, offset, length."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("digest", pa.string()), ("shard", pa.string()), ("offset", pa.int64()), ("length", pa.int64())])

    def run(batches):
        shard, rows, seen = _Shard(), [], {}

        def close():
            shard.tar.close()
            where = _put(folder, shard.buffer.getbuffer())
            placed = [(i, n, d, where, *shard.place(d)) for i, n, d in rows]
            if len(seen) > REMEMBERED:
                seen.clear()
            seen.update({d: (where, *shard.place(d)) for d in shard.entries})
            return pa.RecordBatch.from_arrays([pa.array(list(c), k.type) for c, k in zip(zip(*placed), schema)], schema=schema)

        for batch in (part for batch in batches for part in slices(batch, 8_000_000)):
            old = []
            for doc_id, text in zip(batch.column(0), batch.column(1)):
                text = text.as_py()
                data = to_png(payload_of(text))
                digest, n = hashlib.sha256(data).hexdigest(), len((text or "").encode())
                if digest in seen:
                    old.append((doc_id.as_py(), n, digest, *seen[digest]))
                    continue
                if digest not in shard.entries:
                    shard.add(digest, data)
                rows.append((doc_id.as_py(), n, digest))
                if shard.buffer.tell() >= shard_bytes:
                    yield close()
                    shard, rows = _Shard(), []
            if old:
                yield pa.RecordBatch.from_arrays([pa.array(list(c), k.type) for c, k in zip(zip(*old), schema)], schema=schema)
        if rows:
            yield close()

    _files(folder)[0].create_dir(_files(folder)[1], recursive=True)
    kinds = "doc_id long, n_bytes long, digest string, shard string, offset long, length long"
    return stored(docs.select("doc_id", "text").mapInArrow(run, kinds), "media-rows")


def entries(rows: DataFrame) -> DataFrame:
    """One place for each digest, and the bytes of payload and stored form together."""
    at = F.min(F.struct("shard", "offset", "length", (F.col("n_bytes") + F.col("length")).alias("_bytes")))
    return rows.groupBy("digest").agg(at.alias("_at")).select("digest", "_at.*")


HEADER_COLUMNS = {"width": "int", "height": "int", "bit_depth": "int", "colour": "int"}
SAMPLE_COLUMNS = {"payload_bytes": "long", "payload_sha256": "string", "tail_crc32": "long", "media_bytes": "long", "media_sha256": "string", "average_hash": "string"}


def _read(places: DataFrame, header: bool, samples: bool) -> DataFrame:
    """Range-read each entry's head, its whole, or both, and add the columns that follow."""
    names = (HEADER_COLUMNS if header else {}) | (SAMPLE_COLUMNS if samples else {})

    def run(batches):
        shard, file = None, None
        for batch in batches:
            out = []
            for name, offset, length in zip(*(batch.column(c).to_pylist() for c in (1, 2, 3))):
                if name != shard:
                    files, path = _files(name)
                    shard, file = name, files.open_input_file(path)
                found = read_header(file.read_at(min(length, HEADER_BYTES), offset)) if header else {}
                out.append(found | (sample_features(file.read_at(length, offset)) if samples else {}))
            kinds = {"int": pa.int32(), "long": pa.int64(), "string": pa.string()}
            added = [pa.array([o[c] for o in out], kinds[t]) for c, t in names.items()]
            yield pa.RecordBatch.from_arrays([*batch.columns, *added], [*batch.schema.names, *names])

    schema = ", ".join([f"{c} {t}" for c, t in places.dtypes] + [f"{c} {t}" for c, t in names.items()])
    return places.mapInArrow(run, schema)


def sample_features(png: bytes) -> dict:
    """Digests of payload and stored form, and a feature of the samples, read back."""
    samples = read_samples(png)
    payload = samples.tobytes()
    return {"payload_bytes": len(payload), "payload_sha256": hashlib.sha256(payload).hexdigest(), "tail_crc32": zlib.crc32(payload[-WIDTH:]), "media_bytes": len(png), "media_sha256": hashlib.sha256(png).hexdigest(), "average_hash": average_hash(samples)}


def with_metadata(places: DataFrame) -> DataFrame:
    """Metadata columns from header-only range reads."""
    return _read(places, header=True, samples=False)


def with_features(places: DataFrame) -> DataFrame:
    """Metadata from header-only reads, then features from reads of whole entries."""
    return _read(places, header=True, samples=True)


def media_columns(docs: DataFrame) -> DataFrame:
    """The contract's columns, with the row's digest, shard, offset and length."""
    rows = store(docs, f"{own_dir(docs.sparkSession)}/media-{uuid.uuid4().hex}")
    places = entries(rows)
    total = places.agg(F.coalesce(F.sum("_bytes"), F.lit(0))).first()[0]
    spread = max(1, -(-total // READ_BYTES))
    places = places.drop("_bytes").repartition(spread, "shard", F.expr("offset div 2000000")).sortWithinPartitions("shard", "offset")
    known = with_features(places)
    feature = F.concat_ws(":", F.concat_ws("x", "width", "height", "bit_depth"), "average_hash")
    out = rows.select("doc_id", "n_bytes", "digest").join(known, "digest").select(
        "doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", feature.alias("feature"), "shard", "offset", "length"
    )
    return sized(out, 250 * rows.count())  # a row has about 250 bytes
