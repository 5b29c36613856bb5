"""MinHash near-duplicates by a chosen-path similarity join.

Texts with equal shingle sets form a class; one row of a class goes on. Each class starts `TREES` independent trees
at the value of one of its minwise tokens, so classes of similarity J share the root node of a tree with
probability J. A node of more than `LEAF` members branches on `BRANCHES` further minwise tokens that the node
chooses, as long as that splits it; a node whose members mostly stay together is dense and ends there.

Members of an end node are compared exhaustively by their 128 minwise tokens, which ties candidates to clusters; a
dense node beyond `LEAF` members is tied as a whole. Full shingle sets travel once, to their cluster, and every
candidate pair of a cluster that is not yet in one component is decided on the full sets:

1. a cluster is cut into blocks of `LEAF`; a block is compared within itself and with a few leaders of the cluster;
2. where a cluster of several blocks still has several components, the members outside its largest component are
   compared with all members, block by block.

Inside a block, pairs that are already connected are skipped, so a group of thousands of copies takes about one
comparison a member and never emits all its pairs, and no link that changes a component is lost. With 12 trees a
pair of similarity 0.75 misses every root node with probability 0.25^12; a pair is dropped without a look at the
full sets only below 74 of 128 equal tokens, which a linked pair does with probability 2e-6.

Nulls: a null text is empty; empty texts and texts of blanks link with nothing. A row without doc_id links with
nothing, has no component and is kept. Rows that repeat a doc_id belong to one document. Ties: the smallest
doc_id stands for its component.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logtide.llm.common import TEXT_ROWS, batch_rows, components, stored
from logtide.llm.groups import Arrays, map_groups
from logtide.llm.shingles import mixed, shingle_set

WORDS = 5
PERCENT = 75
TREES = 12
TOKENS = 128
LEAF = 512
BRANCHES = 2
DENSE = 0.6
DEPTH = 8
# Expected number of a large cluster's members that every block of it is compared with.
LEADERS = 8
# Fewest equal tokens of 128 for a look at the full sets.
LEAST_EQUAL = 74

_random = np.random.default_rng(20_011)
_A = _random.integers(0, 1 << 63, TOKENS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _random.integers(0, 1 << 63, TOKENS, dtype=np.uint64)
_SKETCH = "n_shingles bigint, set_key binary, heads array<bigint>, tokens binary"


def minwise(shingles: np.ndarray) -> np.ndarray:
    """The 128 minwise values of a set of hashes."""
    out = np.full(TOKENS, np.iinfo(np.uint64).max, dtype=np.uint64)
    for start in range(0, len(shingles), 4_096):
        part = shingles[start : start + 4_096]
        for i in range(0, TOKENS, 16):
            values = (part[None, :] ^ _B[i : i + 16, None]) * _A[i : i + 16, None]
            np.minimum(out[i : i + 16], values.min(axis=1), out=out[i : i + 16])
    return mixed(out)


def sketches(texts: Column, words: int) -> Column:
    @F.pandas_udf(_SKETCH)
    def sketch(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for text in batch.tolist():
                found = shingle_set(text, words)
                if len(found):
                    values = minwise(found)
                    rows.append((len(found), xxhash.xxh3_128_digest(found.tobytes()), values[:TREES].view(np.int64), (values >> np.uint64(56)).astype(np.uint8).tobytes()))
                else:
                    rows.append((0, None, None, None))
            yield pd.DataFrame(rows, columns=["n_shingles", "set_key", "heads", "tokens"])

    return sketch(texts)


def _branched(large: DataFrame) -> DataFrame:
    """Children of nodes that are still too large: the node chooses the tokens on which its members part."""
    which = F.explode(F.sequence(F.lit(0), F.lit(BRANCHES - 1)))
    rows = large.withColumn("branch", which)
    at = F.pmod(F.xxhash64("node", "branch"), F.lit(TOKENS)).cast("int") + 1
    child = F.xxhash64("node", "branch", F.expr("substring(tokens, at, 1)"))
    return rows.withColumn("at", at).select(child.alias("node"), "rep", "n_shingles", "tokens", F.col("size").alias("above"))


def _sized(members: DataFrame) -> DataFrame:
    """Members of the nodes that hold more than one, with the size of the node."""
    sizes = members.groupBy("node").agg(F.count("*").alias("size")).where("size > 1")
    return members.join(sizes, "node")


def end_nodes(classes: DataFrame) -> DataFrame:
    """(node, size, rep, n_shingles, tokens) of every node at which the trees end."""
    roots = classes.select("rep", F.posexplode("heads").alias("tree", "value")).select(F.xxhash64("tree", "value").alias("node"), "rep")
    level = stored(_sized(roots).join(classes.select("rep", "n_shingles", "tokens"), "rep").withColumn("above", F.lit(None).cast("bigint")), "nodes")
    ended = None
    for depth in range(DEPTH):
        open_ = (F.col("size") > LEAF) & (F.col("above").isNull() | (F.col("size") < DENSE * F.col("above")))
        done = level if depth == DEPTH - 1 else level.where(~open_)
        ended = done if ended is None else ended.unionByName(done)
        if depth == DEPTH - 1 or level.where(open_).isEmpty():
            break
        level = stored(_sized(_branched(level.where(open_))), "nodes")
    return ended.select("node", "size", "rep", "n_shingles", "tokens")


def _alike(tokens: tuple, sizes: tuple) -> np.ndarray:
    """Which pairs of two lists may be linked by their tokens and by the sizes of their sets."""
    x, y = (np.frombuffer(b"".join(t), dtype=np.uint8).reshape(-1, TOKENS) for t in tokens)
    n, m = sizes[0][:, None], sizes[1][None, :]
    equal = np.zeros((len(x), len(y)), dtype=np.int16)
    for start in range(0, len(x), 16):
        equal[start : start + 16] = (x[start : start + 16, None, :] == y[None, :, :]).sum(axis=2)
    return (equal >= LEAST_EQUAL) & (100 * np.minimum(n, m) >= PERCENT * np.maximum(n, m))


def _roots(parents: list[int]) -> list[int]:
    for i in range(len(parents)):
        while parents[i] != parents[parents[i]]:
            parents[i] = parents[parents[i]]
    return parents


def _find(parents: list[int], i: int) -> int:
    while parents[i] != i:
        parents[i] = parents[parents[i]]
        i = parents[i]
    return i


def _tied(group: Arrays) -> Iterator[tuple]:
    """Ties (member, smallest member) of the candidates in one end node; they form clusters, not links."""
    reps, tokens, sizes = group["rep"], group["tokens"], group["n_shingles"]
    if len(reps) < 2:
        return
    if group["dense"][0]:
        yield reps, np.full(len(reps), group["least"][0])
        return
    i, j = np.nonzero(np.triu(_alike((tokens, tokens), (sizes, sizes)), 1))
    parents = list(range(len(reps)))
    for x, y in zip(i.tolist(), j.tolist(), strict=True):
        x, y = _find(parents, x), _find(parents, y)
        if x != y:
            parents[max(x, y)] = min(x, y)
    roots = np.array(_roots(parents))
    moved = np.flatnonzero(roots != np.arange(len(roots)))
    yield reps[moved], reps[roots[moved]]


def clusters(nodes: DataFrame) -> DataFrame:
    """(rep, cluster) of every class that has a candidate."""
    least = nodes.where(F.col("size") > LEAF).groupBy("node").agg(F.min("rep").alias("least"))
    block = F.when(F.col("size") <= LEAF, F.col("node")).otherwise(F.xxhash64("node", F.pmod(F.xxhash64("rep"), F.ceil(F.col("size") / LEAF))))
    rows = nodes.join(least, "node", "left").select(block.alias("block"), (F.col("size") > LEAF).alias("dense"), "least", "rep", "n_shingles", "tokens")
    ties = map_groups(rows, "block", _tied, "a bigint, b bigint").where("a <> b").distinct()
    return components(ties).select(F.col("node").alias("rep"), F.col("component").alias("cluster"))


def _shared(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    if len(a) > len(b):
        a, b = b, a
    both = int((b[np.minimum(np.searchsorted(b, a), len(b) - 1)] == a).sum())
    return 100 * both >= percent * (len(a) + len(b) - both)


def _decided(percent: int):
    """Links of one block: rows of side 0 against all, on full sets, skipping what is already connected."""

    def decide(group: Arrays) -> Iterator[tuple]:
        reps, side = group["rep"], group["side"]
        own, other = np.flatnonzero(side == 0), np.arange(len(reps))
        if not len(own) or len(other) < 2:
            return
        tokens, sizes = group["tokens"], group["n_shingles"]
        alike = _alike((tokens[own], tokens), (sizes[own], sizes))
        known: dict[int, int] = {}
        parents = [known.setdefault(int(c), i) for i, c in enumerate(group["component"])]
        sets: dict[int, np.ndarray] = {}

        def shingles(i: int) -> np.ndarray:
            if i not in sets:
                sets[i] = np.frombuffer(group["shingles"][i], dtype=np.uint64)
            return sets[i]

        made = []
        # Rows with many candidates first: a hub connects its group at once, and the rest is skipped.
        for row in np.argsort(-alike.sum(axis=1), kind="stable").tolist():
            x = int(own[row])
            for y in np.flatnonzero(alike[row]).tolist():
                px, py = _find(parents, x), _find(parents, y)
                if px != py and _shared(shingles(x), shingles(y), percent):
                    parents[px] = py
                    made.append((reps[x], reps[y]))
        if made:
            a, b = np.array(made).T
            yield np.maximum(a, b), np.minimum(a, b)

    return decide


_LINKS = "a bigint, b bigint"
_PAYLOAD = ["rep", "n_shingles", "tokens", "shingles"]


def links_within(members: DataFrame, percent: int) -> DataFrame:
    """Links of every block with itself and with the leaders of its cluster."""
    leader = F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1))
    own = members.select(F.xxhash64("cluster", "mine").alias("cell"), F.lit(0).alias("side"), F.col("rep").alias("component"), *_PAYLOAD)
    led = members.where("blocks > 1 AND leads").withColumn("other", leader).where("other <> mine")
    lent = led.select(F.xxhash64("cluster", "other").alias("cell"), F.lit(1).alias("side"), F.col("rep").alias("component"), *_PAYLOAD)
    return map_groups(own.union(lent), "cell", _decided(percent), _LINKS)


def links_across(members: DataFrame, found: DataFrame, percent: int) -> DataFrame:
    """Links between blocks, of clusters that are not one component yet: members outside the largest one against all."""
    large = members.where("blocks > 1").join(found.withColumnRenamed("node", "rep"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    counts = large.groupBy("cluster", "component").agg(F.count("*").alias("n"))
    most = counts.groupBy("cluster").agg(F.max_by("component", F.struct("n", "component")).alias("most"), F.count("*").alias("parts")).where("parts > 1")
    rows = large.join(most, "cluster")
    others = rows.where("component <> most").withColumn("other", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1)))
    left = others.select(F.xxhash64("cluster", "mine", "other").alias("cell"), F.lit(0).alias("side"), "component", *_PAYLOAD)
    cells = others.where("other <> mine").select("cluster", F.col("mine").alias("first"), F.col("other").alias("mine")).distinct()
    right = rows.join(cells, ["cluster", "mine"]).select(F.xxhash64("cluster", "first", "mine").alias("cell"), F.lit(1).alias("side"), "component", *_PAYLOAD)
    return map_groups(left.union(right), "cell", _decided(percent), _LINKS)


def cluster_members(documents: DataFrame, classes: DataFrame, named: DataFrame, words: int) -> DataFrame:
    """(rep, n_shingles, tokens, shingles, cluster, blocks, mine, leads) of the classes in a cluster."""

    @F.pandas_udf("binary")
    def packed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([shingle_set(text, words).tobytes() for text in batch.tolist()], dtype=object)

    sizes = named.groupBy("cluster").agg(F.count("*").alias("size"), F.min(F.xxhash64("rep")).alias("first"))
    placed = named.join(sizes, "cluster").join(classes.select("rep", "set_key", "n_shingles", "tokens"), "rep")
    blocks = F.ceil(F.col("size") / LEAF).cast("bigint")
    placed = placed.withColumn("blocks", blocks).withColumn("mine", F.pmod(F.xxhash64("rep"), blocks))
    placed = placed.withColumn("leads", (F.xxhash64("rep") == F.col("first")) | (F.pmod(F.xxhash64("rep", F.lit("lead")), F.col("size")) < LEADERS))
    texts = documents.select(F.col("doc_id").alias("rep"), "text").join(placed, "rep").withColumn("shingles", packed("text"))
    return texts.select("rep", "n_shingles", "tokens", "shingles", "cluster", "blocks", "mine", "leads")


def near_duplicates(documents: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept), a row for each row of the documents."""
    batch_rows(documents.sparkSession, TEXT_ROWS)
    rows = stored(documents.select("doc_id", sketches(F.col("text"), words).alias("s")).select("doc_id", "s.*"), "sketches")
    known = rows.where("doc_id IS NOT NULL AND set_key IS NOT NULL")
    classes = stored(
        known.groupBy("set_key").agg(
            F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n_shingles"), F.first("heads").alias("heads"), F.first("tokens").alias("tokens")
        ),
        "classes",
    )
    named = clusters(end_nodes(classes.select("rep", "n_shingles", "heads", "tokens")))
    # Filtered only after it is written: a condition on the sets would move their making in front of the join, to all texts.
    members = stored(cluster_members(documents, classes, named, words), "members").where(F.length("shingles") == 8 * F.col("n_shingles"))
    links = stored(links_within(members, percent), "links")
    links = links.union(links_across(members, components(links), percent))
    # Rows that repeat a doc_id tie the classes of their texts together.
    repeated = known.groupBy("doc_id").agg(F.min("set_key").alias("least"), F.max("set_key").alias("most")).where("least <> most").select("doc_id")
    of_repeated = known.join(repeated, "doc_id").join(classes.select("set_key", "rep"), "set_key")
    links = links.union(of_repeated.where("doc_id <> rep").select(F.col("doc_id").alias("a"), F.col("rep").alias("b")))
    found = components(links)
    named = classes.select("set_key", "rep").join(found.withColumnRenamed("node", "rep"), "rep", "left")
    named = named.select("set_key", F.coalesce("component", "rep").alias("component_id"))
    placed = known.select("doc_id", "n_shingles", "set_key").join(named, "set_key").select("doc_id", "n_shingles", "component_id")
    rest = rows.where("doc_id IS NULL OR set_key IS NULL").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return placed.union(rest).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
