"""Mixing sources to target weights: iterative proportional fitting of token weights, then calibrated sampling.

Documents are counted into cells (source, language, topic). Only the table of cells is raked: each round scales the
weights of the cells to the targets of one column after the other. A cell's weight over its tokens, divided by the
largest such ratio, is the probability of its documents, so the expected tokens kept follow the raked weights in
every cell. A document is kept if a hash of its id falls below the probability of its cell.

Nulls form cells of their own, as the text `<null>`. Targets are scaled to one over the values that have tokens;
a value without a target takes no part (probability 0). Empty texts count one token, so that they can be drawn.
Ties do not arise: the draw is a hash of the id, the same on every run; rows that repeat an id in the same cell are
kept or dropped together. Empty tables give empty results. Texts of any length count whole. Other columns pass through
untouched; `with_probability` replaces those named in `ADDED`, `kept` keeps them as well.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logtide.llm.common import stored, unused

MARGINS = ("_source", "_lang", "_topic")
# All columns that `with_probability` adds.
ADDED = (*MARGINS, "_tokens", "_probability", "_kept")
# Powers of the token shares that make the default targets: below 1 lifts small sources, languages and topics.
POWERS = {"_source": 0.85, "_lang": 0.95, "_topic": 0.95}
ROUNDS = 8
_WORDS = r"[^\x09-\x0D ]+"


def topic(text: Column) -> Column:
    """A coarse topic by the form of a text."""
    text = F.coalesce(text, F.lit(""))
    lower = F.lower(text)
    return (
        F.when(lower.contains("license") | lower.contains("all rights reserved"), "licensed")
        .when(lower.contains(" | "), "tabular")
        .when(F.length(text) < 1_000, "short")
        .otherwise("prose")
    )


def marked(documents: DataFrame) -> DataFrame:
    """The documents with `_source`, `_lang` and `_topic`, never null, and `_tokens`, one at least."""
    return documents.withColumns({
        "_source": F.coalesce(F.col("source").cast("string"), F.lit("<null>")),
        "_lang": F.coalesce(F.col("lang").cast("string"), F.lit("<null>")),
        "_topic": topic(F.col("text")),
        "_tokens": F.greatest(F.lit(1), F.regexp_count(F.coalesce(F.col("text"), F.lit("")), F.lit(_WORDS))).cast("bigint"),
    })


def cell_counts(rows: DataFrame) -> DataFrame:
    return rows.groupBy(*MARGINS).agg(F.sum("_tokens").alias("tokens"))


def tempered(cells: DataFrame, margin: str, power: float) -> DataFrame:
    """(value, target): token shares of a margin's values, raised to a power."""
    return cells.groupBy(F.col(margin).alias("value")).agg(F.pow(F.sum("tokens").cast("double"), F.lit(power)).alias("target"))


def raked(cells: DataFrame, targets: dict[str, DataFrame], rounds: int = ROUNDS) -> DataFrame:
    """(source, lang, topic, probability): cell weights raked to the targets, as sampling probabilities."""
    rows = cells.withColumn("w", F.col("tokens").cast("double"))
    for margin, target in targets.items():
        wanted = target.select(F.col("value").alias(margin), F.col("target").cast("double").alias(f"t{margin}"))
        rows = rows.join(wanted, margin, "left").withColumn(f"t{margin}", F.coalesce(f"t{margin}", F.lit(0.0)))
    rows = stored(rows, "cells")
    for margin, target in targets.items():
        present = rows.groupBy(margin).agg(F.first(f"t{margin}").alias("t")).agg(F.sum("t").alias("all"))
        rows = rows.withColumn(f"t{margin}", F.col(f"t{margin}") / present.scalar())
    for step in range(rounds):
        for margin in targets:
            sums = F.sum("w").over(Window.partitionBy(margin))
            rows = rows.withColumn("w", F.when(sums > 0, F.col("w") * F.col(f"t{margin}") / sums).otherwise(0.0))
        if step % 2:
            rows = stored(rows, "cells")
    rows = stored(rows.withColumn("ratio", F.col("w") / F.col("tokens")), "cells")
    top = rows.agg(F.max("ratio")).scalar()
    return rows.select(*MARGINS, F.when(top > 0, F.col("ratio") / top).otherwise(0.0).alias("probability"))


def draw(key: str = "doc_id") -> Column:
    """A number in [0, 1) from the id alone."""
    text = F.coalesce(F.col(key).cast("string"), F.lit("<null>"))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("double") / float(1 << 32)


def with_probability(documents: DataFrame, targets: dict[str, DataFrame] | None = None) -> DataFrame:
    """The documents with their cell, `_tokens`, `_probability` and `_kept`. Default targets: `POWERS`."""
    rows = marked(documents)
    cells = stored(cell_counts(rows), "cells")
    targets = targets or {margin: tempered(cells, margin, power) for margin, power in POWERS.items()}
    chances = stored(raked(cells, targets), "chances").withColumnRenamed("probability", "_probability")
    # The table of cells was written, so Spark knows its size: broadcast if small, else a join that splits hot cells.
    placed = rows.join(chances, list(MARGINS), "left")
    return placed.withColumn("_kept", draw() < F.col("_probability"))


def kept(documents: DataFrame) -> DataFrame:
    """The documents drawn, with their own columns only, even those that are named like an added one."""
    aside = {c: unused(documents, f"_{c}") for c in documents.columns if c.lower() in ADDED}
    drawn = with_probability(documents.withColumnsRenamed(aside)).where("_kept").drop(*ADDED)
    return drawn.withColumnsRenamed({new: old for old, new in aside.items()})


def mixed(documents: DataFrame) -> DataFrame:
    """(doc_id, source, lang, topic, n_tokens, probability, kept) of every document."""
    found = with_probability(documents.select("doc_id", "text", "source", "lang"))
    return found.select(
        "doc_id",
        F.col("_source").alias("source"),
        F.col("_lang").alias("lang"),
        F.col("_topic").alias("topic"),
        F.col("_tokens").alias("n_tokens"),
        F.round("_probability", 6).alias("probability"),
        F.col("_kept").alias("kept"),
    )


def sql(rounds: int = ROUNDS, documents: str = "documents") -> str:
    """The rows of `mixed` in DuckDB's SQL."""
    lines = [
        f"""WITH m AS (SELECT doc_id, coalesce(source, '<null>') AS source, coalesce(lang, '<null>') AS lang,
      CASE WHEN contains(lower(coalesce(text, '')), 'license') OR contains(lower(coalesce(text, '')), 'all rights reserved') THEN 'licensed'
        WHEN contains(lower(coalesce(text, '')), ' | ') THEN 'tabular' WHEN length(coalesce(text, '')) < 1000 THEN 'short' ELSE 'prose' END AS topic,
      greatest(1, len(regexp_extract_all(coalesce(text, ''), '[^\\x09-\\x0D ]+')))::BIGINT AS n_tokens FROM {documents}),
    c AS (SELECT source, lang, topic, sum(n_tokens)::DOUBLE AS tokens FROM m GROUP BY ALL)"""
    ]
    names = [margin[1:] for margin in POWERS]
    for name in names:
        lines.append(f"t_{name} AS (SELECT {name}, pow(sum(tokens), {POWERS['_' + name]}) AS t FROM c GROUP BY 1)")
    shares = ", ".join(f"(SELECT t FROM t_{n} x WHERE x.{n} = c.{n}) / (SELECT sum(t) FROM t_{n}) AS t{n}" for n in names)
    lines.append(f"r0 AS (SELECT *, tokens AS w, {shares} FROM c)")
    for step in range(rounds * len(names)):
        name = names[step % len(names)]
        lines.append(f"r{step + 1} AS (SELECT * REPLACE (w * t{name} / sum(w) OVER (PARTITION BY {name}) AS w) FROM r{step})")
    last = f"r{rounds * len(names)}"
    return ",\n".join(lines) + f""",
    p AS (SELECT source, lang, topic, w / tokens / max(w / tokens) OVER () AS probability FROM {last})
    SELECT doc_id, source, lang, topic, n_tokens, round(probability, 6) AS probability,
      ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '<null>')), 1, 8))::BIGINT / 4294967296.0 < probability AS kept
    FROM m JOIN p USING (source, lang, topic)"""
