"""Language identification by words first, with backoff to ever shorter character n-grams.

A known word scores its log frequency in each language. An unknown word scores the mean log frequency of its
longest n-grams that are known, from `LONGEST` characters down to one; each step down costs a fixed penalty.

Null texts and texts without letters: `und`, score 0. Ties go to the language that comes first in the alphabet.
Repeated rows get a row each. Without training rows everything is `und`. Texts of any length count whole. Other columns
pass through untouched, but for those that the caller names for the results, which are replaced.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logtide.llm.common import TEXT_ROWS, batch_rows, crc_part, stored, unused

# Expected number of training documents of each language, chosen by hash of the id.
SAMPLE_PER_LANGUAGE = 5_000
# Words and n-grams the model may hold, the most frequent first.
WORDS, GRAMS = 50_000, 50_000
LONGEST = 5
STEP_DOWN = 0.7
_CACHE = 200_000
_LETTERS = regex.compile(r"\p{L}+")
_LETTERS_SQL = r"(\p{L}+)"


@dataclass
class Model:
    languages: list[str]
    words: dict[str, np.ndarray]
    grams: dict[str, np.ndarray]
    floor: np.ndarray
    cache: dict[str, np.ndarray] = field(default_factory=dict)

    def _backoff(self, word: str) -> np.ndarray:
        known = self.cache.get(word)
        if known is None:
            known, marked = self.floor, f"^{word}$"
            for n in range(min(LONGEST, len(marked)), 0, -1):
                hits = [g for i in range(len(marked) - n + 1) if (g := self.grams.get(marked[i : i + n])) is not None]
                if hits:
                    known = np.mean(hits, axis=0) - STEP_DOWN * (LONGEST - n)
                    break
            if len(self.cache) >= _CACHE:
                self.cache.clear()
            self.cache[word] = known
        return known

    def predict(self, text: str | None) -> tuple[str, float]:
        counts = Counter(_LETTERS.findall(text.lower())) if text else {}
        if not counts or not self.languages:
            return "und", 0.0
        find = self.words.get
        rows = [row if (row := find(word)) is not None else self._backoff(word) for word in counts]
        times = np.fromiter(counts.values(), dtype=np.float64, count=len(counts))
        total = times @ np.array(rows)
        best = int(np.argmax(total))
        return self.languages[best], float(1.0 / np.exp(np.maximum(total - total[best], -700.0)).sum())


def _logs(found: pa.Table, languages: list[str]) -> dict[str, np.ndarray]:
    """Log frequency of each key in each language, with a half added to every count."""
    names = found.column(0).to_pylist()
    counts = np.array([found.column(1 + i).to_numpy() for i in range(len(languages))], dtype=np.float64).reshape(len(languages), -1).T
    logs = np.log((counts + 0.5) / (counts.sum(axis=0) + 0.5 * max(1, len(names))))
    return dict(zip(names, logs, strict=True))


def fit(training: DataFrame, per_language: int = SAMPLE_PER_LANGUAGE, words: int = WORDS, grams: int = GRAMS) -> Model:
    """Learns from (doc_id, text, lang): all rows of a language, or by hash of the id about `per_language` of them."""
    rows = training.select("doc_id", "text", "lang").where("text IS NOT NULL AND lang IS NOT NULL")
    # The languages, few by nature, are part of the model; so their shares are a literal map instead of a join on a hot key.
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    languages = sorted(sizes)
    if not languages:
        return Model([], {}, {}, np.zeros(0))
    shares = F.create_map(*[F.lit(x) for lang in languages for x in (lang, min(1.0, per_language / sizes[lang]))])
    draw = F.pmod(F.xxhash64(F.col("doc_id").cast("string"), F.lit("lang")), F.lit(1_000_003)) / 1_000_003
    kept = rows.where(draw < F.element_at(shares, F.col("lang")))
    tokens = kept.select("lang", F.explode(F.regexp_extract_all(F.lower("text"), F.lit(_LETTERS_SQL), 1)).alias("word"))
    counts = tokens.groupBy("lang", "word").count().where(F.length("word") <= 40)
    counts = stored(counts, "words")

    def most(frame: DataFrame, key: str, bound: int) -> pa.Table:
        """The most frequent keys with a count for each language."""
        each = [F.coalesce(F.sum(F.when(F.col("lang") == lang, F.col("count"))), F.lit(0)).alias(f"n{i}") for i, lang in enumerate(languages)]
        both = frame.groupBy(key).agg(F.sum("count").alias("n"), *each)
        return both.orderBy(F.desc("n"), key).limit(bound).drop("n").toArrow()

    frequent = most(counts, "word", words)
    marked = F.concat(F.lit("^"), "word", F.lit("$"))
    pieces = [F.expr(f"transform(sequence(1, greatest(1, length(w) - {n} + 1)), i -> substring(w, i, {n}))") for n in range(1, LONGEST + 1)]
    spread = counts.withColumn("w", marked).select("lang", "count", F.explode(F.flatten(F.array(*pieces))).alias("gram"))
    common = most(spread.groupBy("lang", "gram").agg(F.sum("count").alias("count")), "gram", grams)
    by_gram = _logs(common, languages)
    floor = min((row.min() for row in by_gram.values()), default=0.0) - STEP_DOWN * LONGEST
    return Model(languages, _logs(frequent, languages), by_gram, np.full(len(languages), floor))


def with_language(documents: DataFrame, model: Model, predicted: str = "lang_pred", score: str = "score", text: str = "text") -> DataFrame:
    """All columns of the documents, the predicted language and its posterior probability."""
    shared = documents.sparkSession.sparkContext.broadcast(model)
    batch_rows(documents.sparkSession, TEXT_ROWS)

    @F.pandas_udf("lang string, score double")
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [shared.value.predict(text) for text in batch.tolist()]
            yield pd.DataFrame(found, columns=["lang", "score"])

    both = unused(documents, "_lang")
    named = documents.withColumn(both, predict(F.col(text).cast("string")))
    return named.withColumns({predicted: F.col(f"{both}.lang"), score: F.col(f"{both}.score")}).drop(both)


def identified(documents: DataFrame, parts: int = 4, held: int = 2) -> DataFrame:
    """(doc_id, held_out, lang_pred, score); rows whose crc32 of the id leaves `held` are not learned from."""
    model = fit(documents.where(crc_part("doc_id", parts) != held))
    found = with_language(documents.select("doc_id", "text"), model)
    return found.select("doc_id", F.coalesce(crc_part("doc_id", parts) == held, F.lit(False)).alias("held_out"), "lang_pred", "score")
