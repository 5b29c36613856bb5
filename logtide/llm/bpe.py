"""Byte-level BPE: ranked merges folded over the byte arrays of distinct words, by Spark's higher-order functions.

Every distinct word of a lot of texts is folded in the plan (`folded`), up to `LONG` bytes. So that the commonest are not
folded again in each lot, those of a sample of the texts, the most frequent first up to `WORDS`, are folded ahead and
become a dictionary of bounded size, which is broadcast. Which words it holds never changes a result. A task numbers the
words of its texts by lots; what the dictionary does not hold goes into the plan with the lot, and the ids of the texts are
put together from both. The rank map reaches the fold as two columns beside the words of a lot: as literals the driver would hold it in
every copy of the plan. Nothing is shuffled but the sample's word counts. A longer word would take the fold a time that grows with its
square, so its pairs wait in a heap of the task instead. The ids leave the task twice,
as a list and as bytes from the same buffer. Decoding concatenates the pieces of the ids with built-in functions alone.

The rank map is keyed by a pair of ids and gives the rank of their joint bytes. Rows of the sparse pair matrix are
laid into one array at offsets at which they do not collide, so a look-up is two array reads.

A null text is empty: no ids. Ties: of equal ranks the leftmost pair merges first. Repeated rows get a row each. An
empty table gives no rows. Texts of any length are encoded whole. Columns other than the key and the text are left out.
"""

from __future__ import annotations

import base64
import heapq
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logtide.llm.common import TEXT_ROWS, batch_rows, short_plans, stored

# Words of the dictionary, and the expected number of texts, chosen by hash, whose words are counted for it.
WORDS, SAMPLE = 1 << 17, 20_000
# Texts and characters of a lot, and the length of a word beyond which pairs wait in a heap.
LOT, LOT_CHARS, LONG = 4_000, 16_000_000, 512
_KEEP = 17
# Places of a word within the fold; above LONG.
_PLACES = 1 << 10
_NONE = 1 << 30


@dataclass(frozen=True)
class Vocabulary:
    """Pieces by id, and the pair matrix as offsets and packed slots."""

    pieces: list[bytes]
    offsets: np.ndarray
    slots: np.ndarray

    @property
    def first(self) -> np.ndarray:
        """Id of each single byte."""
        at = {piece: i for i, piece in enumerate(self.pieces) if len(piece) == 1}
        return np.array([at[bytes([b])] for b in range(256)], dtype=np.int32)


def read_ranks(path: str) -> list[bytes]:
    """Pieces in the order of their ranks, from a file of base64 pieces and ranks."""
    with open(path, "rb") as file:
        ranked = sorted((int(rank), base64.b64decode(piece)) for piece, rank in (line.split() for line in file if line.strip()))
    if [rank for rank, _ in ranked] != list(range(len(ranked))):
        raise ValueError("ranks must run from 0 without gaps")
    return [piece for _, piece in ranked]


def vocabulary(path: str) -> Vocabulary:
    pieces = read_ranks(path)
    ids = {piece: i for i, piece in enumerate(pieces)}
    rows: dict[int, list[tuple[int, int]]] = {}
    for i, piece in enumerate(pieces):
        for cut in range(1, len(piece)):
            left, right = ids.get(piece[:cut]), ids.get(piece[cut:])
            if left is not None and right is not None:
                rows.setdefault(left, []).append((right, i))
    entries = sum(map(len, rows.values()))
    span = max(len(pieces), 3 * entries)
    slots = np.full(span + len(pieces) + 1, -1, dtype=np.int64)
    # The last row and column are the mark at both ends of a word, which merges with nothing.
    offsets = np.zeros(len(pieces) + 1, dtype=np.int64)
    draw = np.random.default_rng(1)
    for left, found in sorted(rows.items(), key=lambda row: (-len(row[1]), row[0])):
        columns = np.array([right for right, _ in found])
        at = int(draw.integers(span))
        while (slots[at + columns] >= 0).any():
            at = int(draw.integers(span))
        offsets[left] = at
        slots[at + columns] = (left << _KEEP) | np.array([merged for _, merged in found])
    return Vocabulary(pieces, offsets, slots)


def _literal(values: np.ndarray) -> Column:
    """A constant array; the optimizer folds it to a literal."""
    return F.split(F.lit(",".join(map(str, values.tolist()))), ",").cast("array<bigint>")


def encoded_word(word: Column, vocab: Vocabulary) -> Column:
    """Ids of one word by a rank map that stands in the plan."""
    return folded(word, _literal(vocab.offsets), _literal(vocab.slots))


def folded(word: Column, offsets: Column, slots: Column) -> Column:
    """Ids of one word, given as the ids of its single bytes: merges the leftmost pair of the lowest rank until none is left.

    `offsets` and `slots` are the rank map of a `Vocabulary`.
    """

    def best_pair(ids: Column) -> Column:
        """Lowest rank of a neighbouring pair and its place, as one number."""

        def pair(i: Column) -> Column:
            left = F.get(ids, i)
            slot = F.get(slots, F.get(offsets, left) + F.get(ids, i + 1))
            ranked = lambda s: F.when(F.shiftright(s, _KEEP) == left, s.bitwiseAND((1 << _KEEP) - 1) * _PLACES + i).otherwise(F.lit(_NONE))
            return F.transform(F.array(slot), ranked)[0]

        return F.array_min(F.transform(F.sequence(F.lit(0), F.size(ids) - 2), pair))

    def merge(state: Column, _: Column) -> Column:
        ids = state["ids"]

        def apply(best: Column) -> Column:
            at = best.bitwiseAND(_PLACES - 1).cast("int")
            joined = F.concat(F.slice(ids, 1, at), F.array((best / _PLACES).cast("int")), F.slice(ids, at + 3, F.size(ids)))
            return F.when(best >= _NONE, F.struct(ids.alias("ids"), F.lit(True).alias("done"))).otherwise(
                F.struct(joined.alias("ids"), (F.size(ids) <= 2).alias("done"))
            )

        return F.when(state["done"], state).otherwise(F.transform(F.array(best_pair(ids)), apply)[0])

    start = F.struct(word.alias("ids"), F.lit(False).alias("done"))
    ids = F.aggregate(F.sequence(F.lit(2), F.size(word)), start, merge, lambda state: state["ids"])
    return F.when(F.size(word) < 2, word).otherwise(ids)


Pairs = dict[int, int]


def pair_ranks(vocab: Vocabulary) -> Pairs:
    """The rank map for tasks: left id and right id, packed, to the rank."""
    filled = np.flatnonzero(vocab.slots >= 0)
    left = vocab.slots[filled] >> _KEEP
    return dict(zip(((left << _KEEP) | (filled - vocab.offsets[left])).tolist(), (vocab.slots[filled] & ((1 << _KEEP) - 1)).tolist(), strict=True))


def merged(ids: list[int], pairs: Pairs) -> list[int]:
    """The merges of one word, the fold's result, in a task."""
    if len(ids) > LONG:
        return merged_from_heap(ids, pairs)
    find = pairs.get
    ranks = [find(a << _KEEP | b, _NONE) for a, b in zip(ids, ids[1:])]  # noqa: B905
    while ranks and (best := min(ranks)) != _NONE:
        at = ranks.index(best)
        ids[at : at + 2] = [best]
        del ranks[at]
        if at:
            ranks[at - 1] = find(ids[at - 1] << _KEEP | best, _NONE)
        if at < len(ranks):
            ranks[at] = find(best << _KEEP | ids[at + 1], _NONE)
    return ids


def merged_from_heap(ids: list[int], pairs: Pairs) -> list[int]:
    """The same for a long word: pairs wait in a heap by rank and place."""
    ids, end = list(ids), len(ids)
    after, before = list(range(1, end + 1)), list(range(-1, end - 1))
    waiting: list[tuple[int, int, int, int]] = []

    def offer(i: int) -> None:
        if i >= 0 and after[i] < end and (rank := pairs.get(ids[i] << _KEEP | ids[after[i]])) is not None:
            heapq.heappush(waiting, (rank, i, ids[i], ids[after[i]]))

    for i in range(end - 1):
        offer(i)
    while waiting:
        rank, i, left, right = heapq.heappop(waiting)
        if ids[i] != left or after[i] >= end or ids[after[i]] != right:
            continue
        gone = after[i]
        ids[i], ids[gone], after[i] = rank, -1, after[gone]
        if after[i] < end:
            before[after[i]] = i
        offer(before[i])
        offer(i)
    return [i for i in ids if i >= 0]


def _row(values: pa.Array) -> pa.Array:
    """One row that holds all the values."""
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)


def _lists(parts: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, parts)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([np.zeros(0, np.int32), *parts]), pa.int32()))


def frequent_words(documents: DataFrame, vocab: Vocabulary, pattern: str, text: str, words: int, sample: int) -> DataFrame:
    """(word, ids) of the most frequent words of about `sample` texts."""
    first = vocab.first

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = regex.compile(pattern).findall
        for batch in batches:
            counts: Counter = Counter()
            for value in batch.column(0).to_pylist():
                counts.update(find(value))
            kept = [(word, n, first[np.frombuffer(data, dtype=np.uint8)]) for word, n in counts.items() if len(data := word.encode()) <= LONG]
            names = ["word", "n", "bytes"]
            kinds = [pa.string(), pa.int64(), pa.list_(pa.int32())]
            yield pa.RecordBatch.from_arrays([pa.array([row[i] for row in kept], kinds[i]) for i in range(3)], names)

    texts = documents.select(F.col(text).cast("string").alias("text")).where("text IS NOT NULL")
    share = sample / max(1, documents.count())
    if share < 1:
        texts = texts.where(F.pmod(F.xxhash64("text"), F.lit(1_000_003)) < share * 1_000_003)
    counted = texts.mapInArrow(count, "word string, n bigint, bytes array<int>")
    most = counted.groupBy("word").agg(F.sum("n").alias("n"), F.first("bytes").alias("bytes")).orderBy(F.desc("n"), "word").limit(words)
    # A variable of its own, else the tasks get the pieces too.
    ranks = vocab.offsets, vocab.slots

    def with_ranks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """One row for the words of a batch, with the rank map beside them."""

        tables = [_row(pa.array(table, pa.int64())) for table in ranks]
        for batch in batches:
            yield pa.RecordBatch.from_arrays([_row(batch.column(0)), _row(batch.column(1)), *tables], ["words", "bytes", "offsets", "slots"])

    dealt = most.select("word", "bytes").repartition(F.xxhash64("word"))
    lots = dealt.mapInArrow(with_ranks, "words array<string>, bytes array<array<int>>, offsets array<bigint>, slots array<bigint>")
    ids = F.transform("bytes", lambda word: folded(word, F.col("offsets"), F.col("slots")))
    found = lots.select(F.explode(F.arrays_zip(F.col("words").alias("word"), ids.alias("ids"))).alias("found"))
    return found.select("found.word", "found.ids")


def encode(documents: DataFrame, vocab: Vocabulary, pattern: str, key: str = "doc_id", text: str = "text",
           words: int = WORDS, sample: int = SAMPLE) -> DataFrame:
    """(key, tokens array<int>, packed binary) of every row; packed: the ids as little-endian unsigned 32-bit integers."""
    batch_rows(documents.sparkSession, TEXT_ROWS)
    short_plans(documents.sparkSession)
    made = stored(frequent_words(documents, vocab, pattern, text, words, sample), "words").orderBy("word").toArrow()
    ids = made.column("ids").combine_chunks()
    base = (made.column("word").to_pylist(), ids.flatten().to_numpy().astype(np.int32), ids.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64))
    words_of_all, ids_of_all = base[0], base[1:]
    shared = documents.sparkSession.sparkContext.broadcast((words_of_all, vocab.first, pair_ranks(vocab), (vocab.offsets, vocab.slots)))
    known = documents.sparkSession.sparkContext.broadcast(ids_of_all)
    field = documents.schema[key]
    kind = field.dataType.simpleString()

    def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row for each lot: keys, words of each text, numbers of the words, and the words that the dictionary has not."""
        listed, first, pairs, ranks = shared.value
        find = regex.compile(pattern).findall
        index = {word: i for i, word in enumerate(listed)}
        at = index.get
        tables = [_row(pa.array(table, pa.int64())) for table in ranks]
        keys: list[pa.Array] = []
        counts: list[int] = []
        places: list[np.ndarray] = []
        more: dict[str, int] = {}
        short: list[np.ndarray] = []
        long: list[list[int]] = []

        def number(word: str) -> int:
            found = more.get(word)
            if found is None:
                data = first[np.frombuffer(word.encode(), dtype=np.uint8)]
                if len(data) > LONG:
                    long.append(merged_from_heap(data.tolist(), pairs))
                    found = -len(long)
                else:
                    short.append(data)
                    found = len(listed) + len(short) - 1
                more[word] = found
            return found

        def lot() -> pa.RecordBatch:
            made = [
                _row(pa.concat_arrays(keys)),
                _row(pa.array(counts, pa.int32())),
                _row(pa.array(np.concatenate(places), pa.int32())),
                _row(_lists(short)),
                _row(_lists([np.array(ids, dtype=np.int32) for ids in long])),
            ]
            for part in (keys, counts, places, more, short, long):
                part.clear()
            return pa.RecordBatch.from_arrays([*made, *tables], ["keys", "counts", "places", "bytes", "late", "offsets", "slots"])

        chars = 0
        for batch in batches:
            for row, value in enumerate(batch.column(1).to_pylist()):
                found = find(value) if value else ()
                keys.append(batch.column(0).slice(row, 1))
                counts.append(len(found))
                places.append(np.array([i if (i := at(word)) is not None else number(word) for word in found], dtype=np.int32))
                chars += len(value or "")
                if len(counts) >= LOT or chars >= LOT_CHARS:
                    yield lot()
                    chars = 0
        if counts:
            yield lot()

    def tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flat, sizes = known.value
        for batch in batches:
            for row in range(batch.num_rows):
                keys, counts, places, *own = (batch.column(i)[row].values for i in range(5))
                own_sizes = [part.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64) for part in own]
                pieces = np.concatenate([flat, *(part.flatten().to_numpy(zero_copy_only=False).astype(np.int32) for part in own)])
                lengths = np.concatenate([sizes, *own_sizes])
                starts = np.cumsum(lengths) - lengths
                numbers = places.to_numpy(zero_copy_only=False).astype(np.int64)
                # The long words count from -1 down and stand behind all others.
                numbers = np.where(numbers < 0, len(lengths) - len(own_sizes[1]) - 1 - numbers, numbers)
                ends_of_texts = np.concatenate([[0], np.cumsum(counts.to_numpy(zero_copy_only=False).astype(np.int64))])
                for begin in range(0, len(counts), 256):
                    bounds = ends_of_texts[begin : begin + 257]
                    used = numbers[bounds[0] : bounds[-1]]
                    ends = np.concatenate([[0], np.cumsum(lengths[used])])
                    out = pieces[np.arange(ends[-1]) + np.repeat(starts[used] - ends[:-1], lengths[used])]
                    limits = ends[bounds - bounds[0]].astype(np.int32)
                    lists = pa.ListArray.from_arrays(pa.array(limits, pa.int32()), pa.array(out, pa.int32()))
                    data = pa.py_buffer(out.astype("<u4", copy=False))
                    raw = pa.BinaryArray.from_buffers(pa.binary(), len(limits) - 1, [None, pa.py_buffer(limits * 4), data])
                    yield pa.RecordBatch.from_arrays([keys.slice(begin, 256), lists, raw], [key, "tokens", "packed"])

    texts = documents.select(key, F.col(text).cast("string").alias("text"))
    made_of = f"keys array<{kind}>, counts array<int>, places array<int>, bytes array<array<int>>, late array<array<int>>"
    lots = texts.mapInArrow(numbered, f"{made_of}, offsets array<bigint>, slots array<bigint>")
    ids = F.transform("bytes", lambda word: folded(word, F.col("offsets"), F.col("slots")))
    return lots.select("keys", "counts", "places", ids.alias("ids"), "late").mapInArrow(tokens, f"{key} {kind}, tokens array<int>, packed binary")


def decode(tokens: Column, vocab: Vocabulary) -> Column:
    """The concatenated bytes of the ids; empty for no ids, null for null."""
    pieces = F.split(F.lit(",".join(piece.hex() for piece in vocab.pieces)), ",")
    return F.unhex(F.array_join(F.transform(tokens, lambda t: F.get(pieces, t)), ""))


def digests(documents: DataFrame, path: str, pattern: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of whole texts, the decoded bytes read back from the ids."""
    vocab = vocabulary(path)
    return encode(documents, vocab, pattern).select(
        "doc_id",
        F.size("tokens").cast("bigint").alias("n_tokens"),
        F.sha2("packed", 256).alias("ids_sha256"),
        F.sha2(decode(F.col("tokens"), vocab), 256).alias("decoded_sha256"),
    )
