"""Toxicity by a weighted finite-state pattern grammar over clauses.

Five small transducers read the words of a clause from left to right and are composed into one machine:

* insult - words and word beginnings learned from labelled texts, each with its log odds as weight;
* threat - verbs of harm, which count only in a clause that also has a target;
* target - second and third person pronouns, which raise the weight of the clause;
* negation - lowers the weight of what follows within three words;
* reported speech - verbs of saying and quotation marks, which lower the weight of the rest of the clause.

A clause matches if it holds an insult, or a threat with a target. The score of a text is a logistic function of its
matched clauses (sum, largest and number of the weights), fitted on the labelled sample. Words of the grammar that
carry no label of their own are fixed; insults are learned, so the grammar follows the languages of the labels.

Nulls and empty texts have no clauses and get the score of a text without a match. Repeated rows get a row each.
Ties between candidate insults go to the alphabet. Without labels of both classes every score is 0. Other columns
pass through untouched.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logtide.llm.common import TEXT_ROWS, batch_rows, crc_part, sample_by_hash, stored, texts_of

# Labelled rows the model may learn from, by class.
TOXIC_SAMPLE, CLEAN_SAMPLE = 4_000, 8_000
# Entries of the learned insult transducer.
ENTRIES = 5_000
PREFIXES = (4, 5, 6, 7, 8)
LEAST_EVIDENCE = 12.0
THRESHOLD = 0.5

# Closed word classes of English, French, German and Spanish.
THREATS = frozenset("kill hurt destroy beat punch shoot stab tuer frapper détruire töten schlagen zerstören matar golpear destruir".split())
TARGETS = frozenset("you your he she they them tu vous toi te il elle ils du dich dir ihr sie er tú usted ustedes él ella ellos".split())
NEGATIONS = frozenset("not no never nor isn't aren't don't ne pas jamais nicht nie kein keine nunca jamás tampoco".split())
REPORTS = frozenset("said says wrote called claimed reported dit disait écrit sagte sagt schrieb nannte dijo dice escribió llamó".split())

_CLAUSES = re.compile(r"[.!?;:\n]+")
_TOKENS = re.compile(r"[^\W\d_]+(?:'[^\W\d_]+)?|[\"“”«»„]")
_WORDS_SQL = r"(\p{L}+)"


def _machine(clause: str, weights: dict[str, float]) -> float:
    """Weight of one clause; 0 if it does not match."""
    total, negated, reported, quoted, target, threat = 0.0, 0, False, False, False, False
    for token in _TOKENS.findall(clause):
        weight = weights.get(token)
        if weight is not None:
            total += weight * (0.5 if negated else 1.0) * (0.6 if reported or quoted else 1.0)
        elif token in NEGATIONS:
            negated = 4
        elif token in REPORTS:
            reported = True
        elif token in TARGETS:
            target = True
        elif token in THREATS:
            threat = threat or not negated
        elif len(token) == 1 and not token.isalpha():
            quoted = not quoted
        negated = max(0, negated - 1)
    if threat and target:
        total += 2.0 * (0.6 if reported or quoted else 1.0)
    return total * (1.2 if target else 1.0)


@dataclass(frozen=True)
class Model:
    words: dict[str, float]
    prefixes: dict[str, float]
    coefficients: np.ndarray

    def _weights(self, words: set[str]) -> dict[str, float]:
        """The insult words among those of a text."""
        found = {}
        for word in words:
            weight = self.words.get(word)
            if weight is None:
                for n in PREFIXES:
                    if (weight := self.prefixes.get(word[:n])) is not None and len(word) >= n:
                        break
            if weight is not None:
                found[word] = weight
        return found

    def clauses(self, text: str | None) -> list[float]:
        """Weights of the matched clauses."""
        if not text:
            return []
        lower = text.lower()
        words = set(_TOKENS.findall(lower))
        weights = self._weights(words)
        if not weights and not (words & THREATS and words & TARGETS):
            return []
        return [weight for clause in _CLAUSES.split(lower) if (weight := _machine(clause, weights)) > 0]

    def features(self, text: str | None) -> tuple[float, float, float]:
        matched = self.clauses(text)
        return (min(sum(matched), 50.0), max(matched), math.log1p(len(matched))) if matched else (0.0, 0.0, 0.0)

    def score(self, text: str | None) -> float:
        if not len(self.coefficients):
            return 0.0
        z = float(self.coefficients[0] + np.dot(self.coefficients[1:], self.features(text)))
        return 1.0 / (1.0 + math.exp(-max(-500.0, min(500.0, z))))


def _logistic(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Ridge logistic regression by Newton steps; the intercept comes first."""
    x = np.hstack([np.ones((len(x), 1)), x])
    w = np.zeros(x.shape[1])
    ridge = np.diag([1e-6, *[0.1] * (x.shape[1] - 1)])
    for _ in range(25):
        p = 1.0 / (1.0 + np.exp(-np.clip(x @ w, -30, 30)))
        w -= np.linalg.solve(x.T @ (x * (p * (1 - p) + 1e-9)[:, None]) + ridge, x.T @ (p - y) + ridge @ w)
    return w


def _evidence(toxic: int, clean: int, share: float) -> float:
    """Log likelihood ratio of the counts against the share of toxic rows."""
    n = toxic + clean
    return sum(k * math.log(k / (n * s)) for k, s in ((toxic, share), (clean, 1.0 - share)) if k)


def fit(documents: DataFrame, labelled: DataFrame, toxic: int = TOXIC_SAMPLE, clean: int = CLEAN_SAMPLE) -> Model:
    """Learns from at most `toxic` and `clean` rows of (doc_id, toxic); the texts are read from the documents."""
    rows = labelled.where("doc_id IS NOT NULL AND toxic IN (0, 1)").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("label"))
    sample = sample_by_hash(rows.where("label = 1"), "doc_id", toxic).union(sample_by_hash(rows.where("label = 0"), "doc_id", clean))
    texts = stored(texts_of(sample, documents).where("text IS NOT NULL"), "labelled")
    sizes = {r["label"]: r["n"] for r in texts.groupBy("label").agg(F.count("*").alias("n")).collect()}
    if not sizes.get(1) or not sizes.get(0):
        return Model({}, {}, np.zeros(0))
    words = texts.select("label", F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(_WORDS_SQL), 1)).alias("words"))
    # Near copies share their smallest hash among the longer words, so they speak for a word or beginning only once.
    least = lambda kept: F.array_min(F.transform(kept, lambda w: F.xxhash64(w)))
    group = F.coalesce(least(F.filter("words", lambda w: F.length(w) >= 8)), least(F.col("words")))
    starts = F.flatten(F.array(*[F.transform(F.filter("words", lambda w: F.length(w) >= n), lambda w: F.concat(F.substring(w, 1, n), F.lit("*"))) for n in PREFIXES]))
    keys = words.select("label", group.alias("copies"), F.explode(F.array_distinct(F.concat("words", starts))).alias("key"))
    toxic_counts = keys.where("label = 1").select("key", "copies").distinct().groupBy("key").agg(F.count("*").alias("toxic")).where("toxic >= 3")
    clean_counts = keys.where("label = 0").groupBy("key").agg(F.count("*").alias("clean"))
    counts = toxic_counts.join(clean_counts, "key", "left").fillna(0, ["clean"])
    share = sizes[1] / (sizes[0] + sizes[1])
    candidates = counts.where(F.col("toxic") * (1 - share) > 10 * F.col("clean") * share).orderBy(F.desc("toxic"), "key").limit(ENTRIES).collect()
    weights = {}
    for row in candidates:
        if _evidence(row["toxic"], row["clean"], share) >= LEAST_EVIDENCE:
            weights[row["key"]] = math.log((row["toxic"] + 0.5) / (sizes[1] + 1)) - math.log((row["clean"] + 0.5) / (sizes[0] + 1))
    found = Model({k: v for k, v in weights.items() if k[-1] != "*"}, {k[:-1]: v for k, v in weights.items() if k[-1] == "*"}, np.zeros(0))
    shared = documents.sparkSession.sparkContext.broadcast(found)

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            made = [(*shared.value.features(text), label) for text, label in zip(batch["text"], batch["label"], strict=True)]
            yield pd.DataFrame(made, columns=["total", "best", "number", "label"])

    made = texts.select("text", "label").mapInPandas(measure, "total double, best double, number double, label int").toPandas().sort_values(["total", "best", "number", "label"])
    return Model(found.words, found.prefixes, _logistic(made[["total", "best", "number"]].to_numpy(), made["label"].to_numpy(dtype=float)))


def with_score(documents: DataFrame, model: Model, column: str = "score", text: str = "text") -> DataFrame:
    """All columns of the documents and their score, 0 to 1; higher: toxic likelier."""
    shared = documents.sparkSession.sparkContext.broadcast(model)
    batch_rows(documents.sparkSession, TEXT_ROWS)

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([shared.value.score(text_) for text_ in batch.tolist()], dtype="float64")

    return documents.withColumn(column, score(F.col(text).cast("string")))


def judged(documents: DataFrame, labels: DataFrame, folds: int = 5) -> DataFrame:
    """(doc_id, held_out, score, predicted); learns only from labels whose crc32 of the id is not 0 modulo `folds`."""
    scored = with_score(documents.select("doc_id", "text"), fit(documents, labels.where(crc_part("doc_id", folds) != 0)))
    return scored.select(
        "doc_id",
        F.coalesce(crc_part("doc_id", folds) == 0, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )
