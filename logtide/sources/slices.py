"""Records that may hold separators inside quotes or brackets, read from one file by many tasks.

Spark hands out a file in blocks of bytes and cuts it at every separator, whatever stands around it. Each task tells for
its block, for either thing it may start in (between records, or within quotes), what it ends in. A pass over one row per
block then fixes the start of each, and blocks are cut into whole records independently of each other. The rest of a
record that runs beyond its block is looked up, so that records keep their place. No task reads more than its blocks.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from logtide.runtime import arrow_rows, stored

# Pieces a task is handed at a time: pieces may be long.
PIECE_ROWS = 2_000


@dataclass(frozen=True)
class State:
    """Where a reader stands: within quotes or not, how many brackets are open, and whether it is past the records."""

    inside: bool = False
    depth: int = 0
    closed: bool = False


@dataclass(frozen=True)
class Format:
    """`step` moves a state over a piece; `depth` is that of the records; `plain` finds pieces that may change a state."""

    separator: str
    step: Callable[[State, str], State]
    depth: int
    plain: str | None
    # Records that are nothing, and have no place.
    skipped: tuple[str, ...] = ()

    def between(self, state: State) -> bool:
        """Whether a separator here ends a record."""
        return not state.inside and state.depth <= self.depth


def csv_step(state: State, line: str) -> State:
    """Over one line of CSV: quotes count at the start of a field only, two in a row stand for one."""
    # A byte-order mark stands before the first field of a file.
    inside, at = state.inside, int(line.startswith("\ufeff"))
    while True:
        if inside:
            at = line.find('"', at)
            if at < 0:
                return State(True)
            if line.startswith('""', at):
                at += 2
                continue
            inside = False
        elif line.startswith('"', at):
            inside, at = True, at + 1
            continue
        at = line.find(",", at) + 1
        if not at:
            return State(False)


_ESCAPED = re.compile(r"\\.", re.DOTALL)
_BRACKET = re.compile(r"[\[\]{}]")


def json_step(depth: int) -> Callable[[State, str], State]:
    """Over a piece of JSON: brackets count outside strings; the records end where the list around them closes."""

    def step(state: State, piece: str) -> State:
        if "\\" in piece:
            piece = _ESCAPED.sub("", piece)
        parts = piece.split('"')
        now, closed = state.depth, state.closed
        for bracket in _BRACKET.findall('"'.join(parts[int(state.inside) :: 2])):
            was, now = now, now + (1 if bracket in "[{" else -1)
            closed = closed or now < depth <= was
        return State(state.inside != (len(parts) % 2 == 0), now, closed)

    return step


CSV = Format("\n", csv_step, 0, '"', ("", "\r"))
LINES = Format("\n", lambda state, _: state, 0, None, ("", "\r"))


def json_list(depth: int) -> Format:
    """The elements of the list that opens at the given depth, from 1."""
    return Format(",", json_step(depth), depth, None)


def pieces(spark: SparkSession, path: str, separator: str) -> DataFrame:
    """(file, block, value) of everything between separators, in order within each block."""
    read = spark.read.text(path, lineSep=separator)
    return read.select(F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), "value")


def _runs(batch: pa.RecordBatch) -> Iterator[tuple[int, int, pa.RecordBatch]]:
    """The parts of a batch that belong to one block each."""
    files, blocks = batch.column("file").to_numpy(), batch.column("block").to_numpy()
    changes = np.flatnonzero((files[1:] != files[:-1]) | (blocks[1:] != blocks[:-1])) + 1
    edges = [0, *changes.tolist(), len(files)]
    for start, stop in zip(edges[:-1], edges[1:], strict=True):
        if stop > start:
            yield int(files[start]), int(blocks[start]), batch.slice(start, stop - start)


_ENDS = "file bigint, block bigint, start boolean, inside boolean, depth bigint, lowest bigint, head string, shut int"
# Characters of a file that tell its shape.
HEAD = 1_000


def block_ends(found: DataFrame, form: Format) -> DataFrame:
    """For each block and either start: how it ends, how much deeper, and the lowest depth on the way.

    The first block of a file also tells how the file starts, and as bits whether a list around records of depth 1, and
    of depth 2, has opened and closed in it.
    """
    lists = (json_step(1), json_step(2)) if form.depth else ()

    def end(values: pa.Array, held: list, known: list) -> None:
        if form.plain is not None:
            values = values.filter(pc.match_substring(values, form.plain))
        for piece in values.to_pylist():
            for at, (state, lowest) in enumerate(held):
                state = form.step(state, piece)
                held[at] = (state, min(lowest, state.depth))
            for at, state in enumerate(known):
                known[at] = lists[at](state, piece)

    def made(key: tuple[int, int], held: list, known: list, head: str | None) -> pa.RecordBatch:
        shut = sum(state.closed << at for at, state in enumerate(known))
        rows = [(*key, bool(n), state.inside, state.depth, lowest, head, shut) for n, (state, lowest) in enumerate(held)]
        return pa.RecordBatch.from_pylist([dict(zip(names, row, strict=True)) for row in rows], shape)

    def ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, known, head = None, [], [], None
        for batch in batches:
            for file, block, part in _runs(batch):
                if key != (file, block):
                    if key is not None:
                        yield made(key, held, known, head)
                    key, held = (file, block), [(State(False), 0), (State(True), 0)]
                    head = part.column("value")[0].as_py()[:HEAD] if block == 0 else None
                    known = [State() for _ in lists] if block == 0 else []
                end(part.column("value"), held, known)
        if key is not None:
            yield made(key, held, known, head)

    names = [field.split()[0] for field in _ENDS.split(", ")]
    kinds = {"bigint": pa.int64(), "boolean": pa.bool_(), "string": pa.string(), "int": pa.int32()}
    shape = pa.schema([(name, kinds[field.split()[1]]) for name, field in zip(names, _ENDS.split(", "), strict=True)])
    with arrow_rows(found.sparkSession, PIECE_ROWS):
        return stored(found.mapInArrow(ends, _ENDS), "block-ends")


_STARTS = "file bigint, block bigint, previous bigint, inside boolean, depth bigint, closed boolean, last boolean"


def block_starts(ends: DataFrame, form: Format) -> DataFrame:
    """(file, block, previous, inside, depth, closed) of every block, and a row of block -1 for the end of each file."""
    names = [field.split()[0] for field in _STARTS.split(", ")]

    def follow(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        file, previous, state, opened, out = None, -1, State(), False, []

        def finished() -> None:
            if file is not None:
                out.append((file, -1, previous, state.inside, state.depth, state.closed, True))

        for batch in batches:
            for row in batch.itertuples(index=False):
                if row.file != file:
                    finished()
                    file, previous, state, opened = row.file, -1, State(), False
                if previous != row.block:
                    out.append((file, row.block, previous, state.inside, state.depth, state.closed, False))
                    start, previous = state, row.block
                if row.start == start.inside:
                    shut = form.depth > 0 and bool(row.shut >> (form.depth - 1) & 1)
                    closed = start.closed or shut or (opened and start.depth + row.lowest < form.depth)
                    state = State(bool(row.inside), int(start.depth + row.depth), bool(closed))
                    opened = opened or closed or state.depth >= form.depth
            if out:
                yield pd.DataFrame(out, columns=names)
                out.clear()
        finished()
        if out:
            yield pd.DataFrame(out, columns=names)

    ordered = ends.repartition("file").sortWithinPartitions("file", "block", "start")
    return stored(ordered.mapInPandas(follow, _STARTS), "block-starts")


_CUT = "file bigint, block bigint, place bigint, open boolean, record string"


def _cut(joined: DataFrame, form: Format, prefix: int, heads: bool) -> DataFrame:
    """Records of each block, or only the end of the one that it starts in; `open` ones go on in the next block."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state, parts, head, place = None, State(), [], False, 0

        def made(open_: bool) -> tuple | None:
            nonlocal place, head
            text, was_head = form.separator.join(parts), head
            parts.clear()
            head = False
            if was_head != heads or (not open_ and not heads and text in form.skipped):
                return None
            place += 1
            return (*key, place - 1, open_, text)

        for batch in batches:
            rows = []
            for file, block, part in _runs(batch):
                if key != (file, block):
                    if parts:
                        rows.append(made(True))
                    row = part.slice(0, 1).to_pylist()[0]
                    key, state = (file, block), State(row["inside"], row["depth"], row["closed"])
                    head, place, waiting = not form.between(state), 0, prefix if block == 0 else 0
                values = part.column("value").to_pylist()
                for piece in values:
                    if state.closed or (heads and not head):
                        break
                    before, state = state, form.step(state, piece)
                    if waiting:
                        piece, waiting = _after_opening(piece, waiting)
                        if waiting:
                            continue
                    parts.append(piece if not state.closed else _before_closing(before, piece, form.depth))
                    if state.closed or form.between(state):
                        rows.append(made(False))
            rows = [row for row in rows if row is not None]
            if rows:
                yield _table(rows)
        if parts and key is not None:
            last = made(True)
            if last is not None:
                yield _table([last])

    with arrow_rows(joined.sparkSession, PIECE_ROWS):
        return stored(joined.mapInArrow(cut, _CUT), "records")


def _table(rows: list[tuple]) -> pa.RecordBatch:
    names, kinds = ("file", "block", "place", "open", "record"), (pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.string())
    columns = [pa.array(column, kind) for column, kind in zip(zip(*rows, strict=True), kinds, strict=True)]
    return pa.RecordBatch.from_arrays(columns, names=list(names))


def _after_opening(piece: str, waiting: int) -> tuple[str, int]:
    """What follows the bracket that opens the list, and how many brackets are still to come."""
    for found in _BRACKET.finditer(piece):
        waiting -= 1
        if not waiting:
            return piece[found.end() :], 0
    return "", waiting


def _before_closing(state: State, piece: str, depth: int) -> str:
    """What stands before the bracket that closes the list."""
    inside, now, escaped = state.inside, state.depth, False
    for at, mark in enumerate(piece):
        if escaped:
            escaped = False
        elif inside and mark == "\\":
            escaped = True
        elif mark == '"':
            inside = not inside
        elif not inside and mark in "[{":
            now += 1
        elif not inside and mark in "]}":
            now -= 1
            if now < depth and state.depth >= depth:
                return piece[:at]
    return piece


def _rests(joined: DataFrame, starts: DataFrame, form: Format, prefix: int) -> DataFrame:
    """(file, block, rest): for each block with an open record, what later blocks hold of it."""
    heads = _cut(joined, form, prefix, True).join(F.broadcast(starts.select("file", "block", "previous")), ["file", "block"])
    schema = "file bigint, block bigint, rest string"

    def chain(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        origin, through, parts, out = None, None, [], []

        def finished() -> None:
            if origin is not None:
                out.append((*origin, form.separator.join(parts)))

        for batch in batches:
            for row in batch.itertuples(index=False):
                if through == (row.file, row.previous):
                    parts.append(row.record)
                else:
                    finished()
                    origin, parts = (row.file, row.previous), [row.record]
                # An open head fills its block: the record goes on in the one behind it.
                through = (row.file, row.block) if row.open else None
            if out:
                yield pd.DataFrame(out, columns=["file", "block", "rest"])
                out.clear()
        finished()
        if out:
            yield pd.DataFrame(out, columns=["file", "block", "rest"])

    ordered = heads.repartition("file").sortWithinPartitions("file", "block")
    with arrow_rows(joined.sparkSession, PIECE_ROWS):
        return stored(ordered.mapInPandas(chain, schema), "rests")


def records(found: DataFrame, form: Format, prefix: int = 0, ends: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """((file, block, place, record) of all records, block starts) from (file, block, value) pieces.

    `prefix` is the number of brackets before the first record of a file. Places count from 0 within a block.
    """
    starts = block_starts(block_ends(found, form) if ends is None else ends, form)
    # One short row per block, 128 MB of input by default.
    known = starts.where("NOT last").select("file", "block", "inside", "depth", "closed")
    joined = found.join(F.broadcast(known), ["file", "block"])
    cut = _cut(joined, form, prefix, False)
    within = starts.where("NOT last").where(F.col("inside") | (F.col("depth") > form.depth)).where(~F.col("closed"))
    if within.isEmpty():
        return cut.drop("open"), starts
    late = found.join(F.broadcast(within.select("file", "block", "inside", "depth", "closed")), ["file", "block"])
    rests = _rests(late, starts, form, prefix)
    whole = cut.join(F.broadcast(rests), ["file", "block"], "left") if rests.count() <= 100_000 else cut.join(rests, ["file", "block"], "left")
    text = F.when(F.col("open") & F.col("rest").isNotNull(), F.concat("record", F.lit(form.separator), "rest")).otherwise(F.col("record"))
    return whole.select("file", "block", "place", text.alias("record")), starts


def lines(found: DataFrame) -> DataFrame:
    """(file, block, place, record) where every piece is a record."""
    outside = found.withColumns({"inside": F.lit(False), "depth": F.lit(0).cast("bigint"), "closed": F.lit(False)})
    return _cut(outside, LINES, 0, False).drop("open")


def numbered(found: DataFrame, spark: SparkSession, path: str, name: str, headers: int = 0) -> DataFrame:
    """Adds the 1-based position of each record over all files, in the order of their paths, whatever the splits were.

    The first `headers` records of each file are not counted.
    """
    files = spark.read.format("binaryFile").load(path).select(F.col("_metadata.file_path").alias("path")).distinct()
    sizes = found.groupBy("file", "block").agg(F.count(F.lit(1)).alias("_n"))
    per_file = sizes.groupBy("file").agg((F.sum("_n") - headers).alias("_of_file"))
    # One row per file, then one per block of a file.
    earlier = Window.orderBy("path").rowsBetween(Window.unboundedPreceding, -1)
    before_file = per_file.join(files.select(F.xxhash64("path").alias("file"), "path"), "file").select(
        "file", F.coalesce(F.sum("_of_file").over(earlier), F.lit(0)).alias("_before_file")
    )
    inner = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    before = sizes.select("file", "block", F.coalesce(F.sum("_n").over(inner), F.lit(0)).alias("_before")).join(before_file, "file")
    offsets = before.select("file", "block", (F.col("_before") + F.col("_before_file") - headers).alias("_offset"))
    return found.join(F.broadcast(offsets), ["file", "block"]).withColumn(name, F.col("_offset") + F.col("place") + 1).drop("_offset")
