"""Blocks of training rows, and sums over them in one array or over a Spark table."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from furrow.session import removed, stored

SCHEMA = "x array<double>, y double, w double, u long"
#: Numbers of a block that a task holds at once.
BLOCK = 1_000_000
#: Trees (or other steps) that rows apply anew before their margins are written again.
PENDING = 8


@dataclass
class Block:
    """Rows: features, target, weight, and a number that is theirs wherever they lie; margins of a boosted model."""

    x: np.ndarray
    y: np.ndarray
    w: np.ndarray
    u: np.ndarray
    margin: np.ndarray | None = None

    def chosen(self, share: float, salt: int) -> np.ndarray:
        """A share of the rows by their numbers alone, another one for each ``salt``."""
        return shares(self.u, salt) < share

    def where(self, mask: np.ndarray) -> Block:
        return Block(self.x[mask], self.y[mask], self.w[mask], self.u[mask], None if self.margin is None else self.margin[mask])


def shares(u: np.ndarray, salt: int) -> np.ndarray:
    """Numbers in [0, 1) that follow from u and salt."""
    mixed = (u.astype(np.uint64) ^ np.uint64(salt * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)) * np.uint64(0xD6E8FEB86659FD93)
    mixed ^= mixed >> np.uint64(32)
    mixed *= np.uint64(0xD6E8FEB86659FD93)
    return (mixed >> np.uint64(11)).astype(np.float64) / (1 << 53)


def added(a, b):
    return tuple(x + y for x, y in zip(a, b))


class Held:
    """All rows in one block, for tables of proven small size."""

    def __init__(self, block: Block):
        self.block = block

    def sum(self, f: Callable, *state, merge=added):
        return f(self.block, *state)

    def begin(self, width: int) -> None:
        self.block.margin = np.zeros((len(self.block.y), width))

    def weighted(self, by_class: np.ndarray) -> Held:
        """The rows with weights times those of their classes."""
        b = self.block
        return Held(Block(b.x, b.y, b.w * by_class[b.y.astype(int)], b.u))

    def mapped(self, f: Callable, *state) -> Held:
        """The rows with other features."""
        b = self.block
        return Held(Block(f(b.x, *state), b.y, b.w, b.u, b.margin))

    def advance(self, f: Callable, *state) -> None:
        self.block.margin = self.block.margin + f(self.block.x, *state)

    def done(self) -> None:
        pass


class Spread:
    """A table of rows (``SCHEMA``); each sum is one job whose tasks add up their blocks and merge in a tree."""

    def __init__(self, table: DataFrame, width: int = 0, by_class: np.ndarray | None = None):
        self.table, self.width, self.by_class = table, width, by_class
        self.steps: list[tuple[Callable, tuple]] = []
        self.own: str | None = None

    def sum(self, f: Callable, *state, merge=added):
        context = self.table.sparkSession.sparkContext
        given = context.broadcast((f, self.steps, state))

        def part(batches):
            total = None
            f, steps, state = given.value
            for block in read(batches, width, by_class):
                apply(block, steps)
                got = f(block, *state)
                total = got if total is None else merge(total, got)
            if total is not None:
                yield pa.RecordBatch.from_pydict({"m": pa.array([pickle.dumps(total)], pa.binary())})

        width, by_class = self.width, self.by_class
        tasks = self.table.mapInArrow(part, "m binary").rdd.map(lambda r: pickle.loads(bytes(r.m)))
        both = lambda a, b: b if a is None else a if b is None else merge(a, b)
        out = tasks.treeAggregate(None, both, both)
        given.unpersist()
        if out is None:
            raise ValueError("no rows to learn from")
        return out

    def begin(self, width: int) -> None:
        self._written([], width, lambda block: np.zeros((len(block.y), width)))

    def weighted(self, by_class: np.ndarray) -> Spread:
        return Spread(self.table, self.width, by_class)

    def mapped(self, f: Callable, *state) -> Spread:
        """The rows with other features, written once."""
        given, by_class = self.table.sparkSession.sparkContext.broadcast((f, state)), self.by_class

        def part(batches):
            for block in read(batches, 0, by_class):
                f, state = given.value
                block.x = f(block.x, *state)
                yield from written(block)

        out = Spread(stored(self.table.mapInArrow(part, SCHEMA), "features"))
        out.own = out.table.inputFiles()[0].rsplit("/", 1)[0] if out.table.inputFiles() else None
        return out

    def advance(self, f: Callable, *state) -> None:
        """Margins grow by ``f``: rows apply it anew in each sum until the margins are written again."""
        self.steps.append((f, state))
        if len(self.steps) >= PENDING:
            steps = self.steps
            self._written(steps, self.width, None)

    def _written(self, steps: list, width: int, start) -> None:
        given = self.table.sparkSession.sparkContext.broadcast(steps)
        old_width = self.width

        def part(batches):
            for block in read(batches, old_width):
                if start is not None:
                    block.margin = start(block)
                apply(block, given.value)
                yield from written(block)

        table = stored(self.table.mapInArrow(part, f"{SCHEMA}, margin array<double>"), "margins")
        self.done()
        self.table, self.width, self.steps = table, width, []
        self.own = table.inputFiles()[0].rsplit("/", 1)[0] if table.inputFiles() else None

    def done(self) -> None:
        """Remove the table that was written last."""
        if self.own:
            removed(self.table.sparkSession, self.own)
        self.own = None


def apply(block: Block, steps: list[tuple[Callable, tuple]]) -> None:
    for f, state in steps:
        block.margin = block.margin + f(block.x, *state)


def read(batches, width: int, by_class: np.ndarray | None = None) -> Iterator[Block]:
    """Blocks of a table's batches, with margins if ``width``; weights times those of their classes."""
    for batch in batches:
        if not batch.num_rows:
            continue
        d = len(batch.column(0)[0])
        step = max(1, BLOCK // max(d, 1))
        for at in range(0, batch.num_rows, step):
            part = batch.slice(at, step)
            flat = lambda c, k: part.column(c).flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, k)
            y, w, u = (part.column(c).to_numpy(zero_copy_only=False) for c in (1, 2, 3))
            yield Block(flat(0, d), y, w if by_class is None else w * by_class[y.astype(int)], u, flat(4, width) if width else None)


def written(block: Block):
    lists = lambda a: pa.FixedSizeListArray.from_arrays(pa.array(a.astype(np.float64).reshape(-1)), a.shape[1]).cast(pa.list_(pa.float64()))
    columns = [lists(block.x), pa.array(block.y), pa.array(block.w), pa.array(block.u), *([lists(block.margin)] if block.margin is not None else [])]
    yield pa.RecordBatch.from_arrays(columns, ["x", "y", "w", "u", "margin"][: len(columns)])


def moments(rows: Held | Spread, columns: int) -> tuple[np.ndarray, np.ndarray]:
    """Mean and population deviation of the first ``columns`` features; a constant one has deviation 1."""
    n, s = rows.sum(_first, columns)
    mean = s / n
    (q,) = rows.sum(_second, columns, mean)
    deviation = np.sqrt(q / n)
    return mean, np.where(deviation > 1e-12 * np.maximum(np.abs(mean), 1), deviation, 1.0)


def _first(b: Block, columns: int):
    return np.float64(len(b.y)), b.x[:, :columns].sum(0)


def _second(b: Block, columns: int, mean: np.ndarray):
    return (((b.x[:, :columns] - mean) ** 2).sum(0),)


def scaled(x: np.ndarray, mean: np.ndarray, deviation: np.ndarray) -> np.ndarray:
    """``x`` with its first columns scaled."""
    k = len(mean)
    return np.concatenate([(x[:, :k] - mean) / deviation, x[:, k:]], axis=1)
