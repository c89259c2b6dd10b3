"""Near-duplicates by an inverted join of MinHash signature coordinates.

1. Each text becomes its set of word shingles, a digest of the set and a signature of ``ALL`` minima, the
   first ``K`` of them as posts (hashes of coordinate and value), all of them as half a byte each.
   Texts with equal sets form a class, which from here on is one node.
2. Nodes are posted under each (coordinate, value) pair. Pairs posted once can't collide and go.
   A node left with fewer than ``T`` posts can't reach ``T`` collisions and goes as well.
3. Skip merge: each list names its pivot, the node whose lists are the longest. Collisions with that
   node are counted; this needs one row a post, however long a list is, and joins large groups of
   near copies, whose pivot is the text they were copied from, into components.
4. Prefix merge: of its posts, rarest first, a node with ``m`` of them needs only the first
   m - T + 1: two nodes with ``T`` collisions meet there. Lists whose nodes all are in one
   component are skipped. Nodes of the others are not paired list by list, which would pair all edited
   copies of a text that lost their link to it: they are posted once more, under their rarest shingles.
   Sets of sizes n and k at the threshold share o shingles at least, and so meet among the n - o + 1
   and k - o + 1 rarest. Copies that were changed too much to be linked have rare shingles
   enough to fill that, and don't meet each other under the common ones. Shingles that the same nodes
   have, such as those of one passage, are posted once for all. A long list is joined in blocks.
5. Match threshold: of all ``ALL`` coordinates a pair that met must agree in ``MATCH`` (by half
   bytes, which agree by chance once in 16). What is left is compared on full sets.
6. Components of all confirmed links.

Two sets at the threshold (0.8) reach T = 24 of K = 48 collisions but for about 1 in a million, and
83 of 128 but for 4 in a million; more similar ones miss far more rarely. Links are exact, as they are
confirmed on full sets. Of pairs at 0.5, 5 in a thousand are compared on full sets.

Null and empty texts, or texts without words, have no shingles: they are linked with nothing and
each is its own component. Fewer words than a shingle's make one shingle of all. Texts are taken whole;
a very long one is spread over rows of its shingles. Repeated rows are one node. Rows that share a
doc_id count as one document when links are followed, whatever their texts. A null doc_id has no
component, and such a row is kept as its own. Ties between pivots go to the smallest node. An empty
table gives an empty one. Only doc_id and text are read, so other columns may have any name. Ids lie
below 2**62.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .bpe import slices
from .common import Remembered, scratch, stored
from .components import components

#: Coordinates that are posted, and collisions there; coordinates of a signature, and those that must agree.
K, T = 48, 24
ALL, MATCH = 128, 83
#: Members compared with one centre in one group.
GROUP = 128
#: Nodes of a list in a block of the join, and pairs that a task looks at.
BLOCK, PAIRS = 512, 4_000_000

#: Ids that ``keep_one`` broadcasts at most: 64 MB at 16 bytes each.
GONE = 4_000_000


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Shingler:
    """Sorted distinct 64-bit hashes of a text's word shingles."""

    def __init__(self, words: int):
        self.words, self.known = words, Remembered(xxhash.xxh3_64_intdigest)

    def __call__(self, text: str | None) -> np.ndarray:
        found = (text or "").encode().lower().split()  # of bytes: ASCII letters, ASCII white space
        if not found:
            return np.zeros(0, dtype=np.uint64)
        self.known.trim()
        h = np.fromiter(map(self.known.__getitem__, found), dtype=np.uint64, count=len(found))
        n = min(self.words, len(h))
        rolled = np.full(len(h) - n + 1, n, dtype=np.uint64)
        with np.errstate(over="ignore"):
            for i in range(n):
                rolled = _mix(rolled * np.uint64(0x9E3779B97F4A7C15) + h[i : len(h) - n + 1 + i])
        return np.unique(rolled)


def _minima(seed: int = 1):
    factors = np.random.default_rng(seed).integers(1, 2**63, ALL, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

    def of(sets: list[np.ndarray]) -> np.ndarray:
        """Row per set (none empty): ``ALL`` hashes of coordinate and minimum."""
        sizes = np.array([len(s) for s in sets])
        if not len(sizes):
            return np.zeros((0, ALL), dtype=np.uint64)
        every, begin = np.concatenate(sets), np.cumsum(sizes) - sizes
        high = every >> np.uint64(29)
        own, other, low = np.empty_like(every), np.empty_like(every), []
        with np.errstate(over="ignore"):
            for f, g in zip(factors, np.roll(factors, 1)):  # in place: fresh memory would cost more than the hashing
                np.bitwise_xor(np.multiply(every, f, out=own), np.multiply(high, g, out=other), out=own)
                low.append(np.minimum.reduceat(own, begin))
            return _mix(np.stack(low, 1) + np.arange(1, ALL + 1, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))

    return of


def sketch(docs: DataFrame, words: int) -> DataFrame:
    """doc_id, a hash and the bytes of the text, n_shingles, digest of the set, posts (K hashes of
    coordinate and value), signature (half a byte a coordinate, sixteen to a number)."""
    kind = pa.list_(pa.int64())

    def lists(values: np.ndarray, some: list[np.ndarray]) -> pa.Array:
        ends = np.cumsum([0, *(values[0].nbytes // 8 if len(s) else 0 for s in some)]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.ascontiguousarray(values).ravel().view(np.int64))).cast(kind)

    def halves(low: np.ndarray) -> np.ndarray:
        four = (low & np.uint64(15)).astype(np.uint8)
        return four[:, ::2] << 4 | four[:, 1::2]

    def run(batches):
        shingles, minima = Shingler(words), _minima()
        for batch in batches:
            for part in slices(batch, 1_000_000):
                sets = [shingles(t) for t in part.column(1).to_pylist()]
                digest = [xxhash.xxh3_128_digest(s.tobytes()) for s in sets]
                low = minima([s for s in sets if len(s)])
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), *part.columns[2:], pa.array([len(s) for s in sets], pa.int64()), pa.array(digest, pa.binary()), lists(low[:, :K], sets), lists(halves(low), sets)],
                    ["doc_id", "text_hash", "n_bytes", "n_shingles", "digest", "posts", "signature"],
                )

    whole = docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash"), F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"))
    return whole.mapInArrow(run, "doc_id long, text_hash long, n_bytes long, n_shingles long, digest binary, posts array<long>, signature array<long>")


def unlike(a: Column, b: Column) -> Column:
    """Coordinates in which two signatures differ."""
    threes, out = F.lit(0x3333333333333333), F.lit(0)
    for i in range(ALL // 16):
        x = F.get(a, F.lit(i)).bitwiseXOR(F.get(b, F.lit(i)))
        low = x.bitwiseOR(F.shiftrightunsigned(x, 2)).bitwiseAND(threes)  # 0 where the half bytes are equal
        out = out + F.bit_count((low + threes).bitwiseAND(F.lit(0x4444444444444444)))
    return out


def confirmed(pairs: DataFrame, texts: DataFrame, words: int, percent: int) -> DataFrame:
    """Of ``pairs`` (a, b: nodes) those whose full sets are similar enough.

    The members b of a centre a come to it in groups of about ``GROUP``, each with a copy of the
    centre's text, so a centre of any number of members spreads over tasks."""
    pairs = stored(pairs, "candidates")
    spread = pairs.groupBy("a").agg(F.ceil(F.count("*") / GROUP).cast("int").alias("groups"))
    member = pairs.join(spread, "a").select(F.col("b").alias("node"), "a", F.pmod(F.xxhash64("b"), F.col("groups")).cast("int").alias("part"), F.lit(1).alias("order"))
    centre = spread.select(F.col("a").alias("node"), "a", F.explode(F.sequence(F.lit(0), F.col("groups") - 1)).alias("part"), F.lit(0).alias("order"))
    placed = member.union(centre).join(texts, "node").repartition("a", "part").sortWithinPartitions("a", "part", "order")

    def run(batches):
        shingles, at, own = Shingler(words), None, None
        for batch in batches:
            for cut in slices(batch, 4_000_000, 4):
                out = []
                for a, part, node, order, text in zip(*(c.to_pylist() for c in cut.columns)):
                    s = shingles(text)
                    if (a, part) != at and order == 0:
                        at, own = (a, part), s
                    elif order == 1:
                        both = len(np.intersect1d(own, s, assume_unique=True))
                        if both and 100 * both >= percent * (len(own) + len(s) - both):
                            out.append((a, node))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], ["a", "b"])

    return placed.select("a", "part", "node", "order", "text").mapInArrow(run, "a long, b long")


def rare_shingles(nodes: DataFrame, texts: DataFrame, words: int, percent: int) -> DataFrame:
    """node, component, n, shingle, place: the rarest shingles of each node, places from 1, as
    many as a set that meets the threshold with the smallest possible partner may need; only those
    that nodes of several components have, one for all that the same nodes have, and only of nodes
    with enough of these. ``nodes``: node, component, n."""

    def run(batches):
        shingles = Shingler(words)
        for batch in batches:
            for cut in slices(batch, 1_000_000, 1):
                sets = [shingles(t) for t in cut.column(1).to_pylist()]
                row = pa.array(np.repeat(np.arange(len(sets)), [len(s) for s in sets]))
                flat = np.concatenate(sets).view(np.int64)
                yield from pa.Table.from_arrays([*(cut.column(i).take(row) for i in (0, 2, 3)), pa.array(flat)], ["node", "component", "n", "shingle"]).to_batches(50_000)

    rows = nodes.join(texts, "node").select("node", "text", "component", "n").mapInArrow(run, "node long, component long, n long, shingle long")
    who = F.bit_xor(F.xxhash64("node")).alias("who")  # tells the lists of a node apart
    lists = rows.groupBy("shingle").agg(F.count("*").alias("length"), (F.min("component") < F.max("component")).alias("apart"), who).where("length > 1")
    own = rows.join(lists, "shingle").repartition("node").groupBy("node", "component", "n", "length", "who", "apart").agg(F.count("*").alias("size"), F.min("shingle").alias("shingle"))
    each = W.partitionBy("node")
    before = each.orderBy("length", "who").rowsBetween(W.unboundedPreceding, -1)
    own = own.withColumns(
        {
            "held": F.sum("size").over(each),
            "n_apart": F.sum(F.when(F.col("apart"), F.col("size")).otherwise(0)).over(each),
            "before": F.coalesce(F.sum("size").over(before), F.lit(0)),
        }
    )
    place = F.col("n") - F.col("held") + F.col("before") + 1  # shingles of this node alone come first
    most = F.col("n") - F.ceil(F.col("n") * percent / 100) + 1
    own = own.where((F.col("n_apart") * 100 >= F.col("n") * percent) & F.col("apart")).withColumn("place", place).where(F.col("place") <= most)
    return own.select("node", "component", "n", "shingle", "place")


def _nodes(own: DataFrame, every: int) -> tuple[DataFrame, DataFrame | None]:
    """A node for every digest, with its smallest row (doc_id, text_hash); and links between nodes
    that hold texts of one doc_id, None where there are none. A node is named by its doc_id, or where
    another has that name, by a hash beyond all ids."""
    row = F.min(F.struct("doc_id", "text_hash", "n_bytes")).alias("row")
    nodes = own.groupBy("digest").agg(row, F.first("n_shingles").alias("n"), F.first("posts").alias("posts"), F.first("signature").alias("signature"))
    nodes = stored(nodes.select("digest", "row.*", "n", "posts", "signature"), "nodes", 600 * every)
    several = stored(own.groupBy("doc_id").agg(F.min("digest").alias("_l"), F.max("digest").alias("_h")).where("_l < _h").select("doc_id"), "several", 8 * every)
    if several.isEmpty():
        return nodes.withColumn("node", F.col("doc_id")), None
    first = nodes.groupBy("doc_id").agg(F.min("digest").alias("_first"))
    hashed = F.xxhash64("doc_id", "digest").bitwiseAND(F.lit((1 << 62) - 1)).bitwiseOR(F.lit(1 << 62))
    nodes = nodes.join(first, "doc_id").withColumn("node", F.when(F.col("digest") == F.col("_first"), F.col("doc_id")).otherwise(hashed)).drop("_first")
    nodes = stored(nodes, "nodes", 600 * every)
    same = own.join(several, "doc_id", "left_semi").select("doc_id", "digest").distinct().join(nodes.select("digest", "node"), "digest")
    return nodes, stored(same.join(same.groupBy("doc_id").agg(F.min("node").alias("a")), "doc_id").where("a < node").select("a", F.col("node").alias("b")), "same")


def _met(rare: DataFrame, percent: int) -> DataFrame:
    """a, b: nodes of different components that meet under a rare shingle and agree in enough coordinates."""
    lists = rare.groupBy("shingle").agg(F.count("*").alias("posted"), F.min("component").alias("_l"), F.max("component").alias("_h")).where("_l < _h")
    lists = stored(lists.select("shingle", "posted"), "rare-lists")
    pairs = lists.agg(F.coalesce(F.sum(F.col("posted").cast("double") ** 2), F.lit(0.0))).first()[0]
    spread = max(1, math.ceil(pairs / PAIRS))
    # blocks of a list meet in pairs, so the two sides of a key are two blocks at most
    blocks = F.ceil(F.col("posted") / BLOCK).cast("int")
    rare = rare.join(lists, "shingle").withColumns({"last": blocks - 1, "own": F.pmod(F.xxhash64("node"), blocks).cast("int")})
    x = rare.withColumn("low", F.col("own")).withColumn("high", F.explode(F.sequence("own", "last"))).repartition(spread, "shingle", "low", "high").alias("x")
    y = rare.withColumn("high", F.col("own")).withColumn("low", F.explode(F.sequence(F.lit(0), "own"))).repartition(spread, "shingle", "low", "high").alias("y")
    both = F.expr(f"({percent} * (x.n + y.n) + {99 + percent}) div {100 + percent}")  # shingles that they share at least
    early = (F.col("x.place") <= F.col("x.n") - both + 1) & (F.col("y.place") <= F.col("y.n") - both + 1)
    enough = F.least("x.place", "y.place") + F.least(F.col("x.n") - F.col("x.place"), F.col("y.n") - F.col("y.place")) >= both
    apart = ((F.col("x.low") < F.col("x.high")) | (F.col("x.node") < F.col("y.node"))) & (F.col("x.component") != F.col("y.component"))
    same = [F.col(f"x.{c}") == F.col(f"y.{c}") for c in ("shingle", "low", "high")]
    alike = unlike(F.col("x.signature"), F.col("y.signature")) <= ALL - MATCH
    meet = x.join(y, [*same, apart & early & enough & alike])
    return meet.select(F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b")).distinct()


def _components(docs: DataFrame, table: DataFrame, words: int, percent: int) -> DataFrame:
    """digest, component_id for every class of ``table`` (the sketches of ``docs``)."""
    own = table.where("n_shingles > 0 and doc_id is not null")
    every = own.count()
    nodes, same = _nodes(own, every)
    posts = nodes.select("node", F.explode("posts").alias("post"))
    lists = posts.groupBy("post").agg(F.count("*").alias("length")).where("length > 1")
    # few posts stay: those of documents that share shingles
    shared = posts.join(lists, "post").groupBy("node").agg(F.sort_array(F.collect_list(F.struct("length", "post"))).alias("lists"))  # K at most
    shared = shared.where(F.size("lists") >= T).join(nodes.select("node", "doc_id", "text_hash", "n_bytes", "n", "signature"), "node")
    shared = stored(shared, "lists", 1000 * every)
    most, bytes_ = shared.agg(F.count("*"), F.coalesce(F.sum("n_bytes"), F.lit(0))).first()
    texts = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text").join(shared.select("node", "doc_id", "text_hash"), ["doc_id", "text_hash"])
    texts = stored(texts.select("node", "text").dropDuplicates(["node"]), "texts", bytes_)
    signed = shared.select("node", "signature")

    # skip merge: collisions with the pivot of each list
    reach = F.aggregate("lists", F.lit(0).cast("long"), lambda n, x: n + x.length)
    posted = shared.select("node", F.struct(reach, -F.col("node")).alias("rank"), F.explode("lists.post").alias("post"))
    pivots = posted.groupBy("post").agg(F.max_by("node", "rank").alias("pivot"))
    star = posted.join(pivots, "post").where("pivot != node").groupBy("pivot", "node").count()
    star = star.where(F.col("count") >= T).select(F.col("pivot").alias("a"), F.col("node").alias("b"))
    star = star.join(signed.toDF("b", "_b"), "b").join(signed.toDF("a", "_a"), "a").where(unlike(F.col("_a"), F.col("_b")) <= ALL - MATCH).select("a", "b")
    links = confirmed(star, texts, words, percent)
    near = stored(components(links if same is None else links.union(same), size=16 * most), "near", 16 * most)

    # prefix merge: what is still apart
    prefix = shared.join(near, "node", "left").select(
        "node", "n", F.coalesce("component", "node").alias("component"), F.explode(F.expr(f"transform(slice(lists, 1, size(lists) - {T - 1}), x -> x.post)")).alias("post")
    )
    apart = prefix.groupBy("post").agg(F.min("component").alias("_l"), F.max("component").alias("_h")).where("_l < _h").select("post")
    left = prefix.join(apart, "post", "left_semi").select("node", "component", "n").distinct()
    rare = rare_shingles(stored(left, "apart", 24 * most), texts, words, percent)
    met = _met(stored(rare.join(signed, "node"), "rare"), percent)
    label = lambda c, name: near.select(F.col("node").alias(c), F.col("component").alias(name))
    links = confirmed(met, texts, words, percent)
    joined = links.join(label("a", "ca"), "a", "left").join(label("b", "cb"), "b", "left").select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b"))
    far = components(joined, size=16 * most).select(F.col("node").alias("component"), F.col("component").alias("whole"))
    whole = near.join(far, "component", "left").select("node", F.coalesce("whole", "component").alias("component"))
    alone = far.select(F.col("component").alias("node"), F.col("whole").alias("component")).join(near, "node", "left_anti")
    found = stored(whole.union(alone), "components", 16 * most)
    return nodes.select("digest", "node").join(found, "node", "left").select("digest", F.coalesce("component", "node").alias("component_id"))


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id and kept for every row of ``docs``."""
    with scratch(docs.sparkSession):
        table = stored(sketch(docs, words), "sketch")
        found = _components(docs, table, words, percent)
        out = table.select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("digest")).alias("digest")).join(found, "digest", "left")
        component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
        out = out.select("doc_id", "n_shingles", component.alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
        return stored(out, "near-duplicates", 32 * table.count(), keep=True)


def keep_one(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` with one document of each group: the rows of its smallest id.

    The ids that go are counted: up to ``GONE`` of them are broadcast, so that no text is shuffled; more are joined."""
    gone = near_duplicates(docs, words, percent).where("not kept").select("doc_id").distinct()
    few = gone.count() <= GONE
    return docs.join(F.broadcast(gone) if few else gone, "doc_id", "left_anti").select(docs.columns)
