"""Personal data by weak supervision: labelers vote on spans, their votes are aggregated, a span classifier decides.

One pass over the whole texts finds the spans of the stated patterns (base spans) and wider candidates: e-mail addresses
with spelt-out marks, defanged and longer internet addresses, cards with other separators, phone numbers without a plus,
and matches that failed a check. Six labelers vote yes, no or nothing on each: the shape of the pattern, its checksum,
the gazetteers of `GAZETTEERS`, words nearby that speak for it, words nearby that speak against it, and what it touches.
The votes and three facts about the form of a span are its signature; there are at most 4 * 3**6 * 16 of them, so the
counts of signatures over all documents are small enough for the driver however large the corpus is.

Expectation-maximisation on these counts estimates how each labeler votes on personal and on other spans, and so how
likely each signature is personal; base spans are known to be. A logistic regression is then trained on signatures with
these likelihoods as labels, and decides: base spans always stay, a candidate is added at `THRESHOLD` or more, if it
overlaps no base span and no likelier candidate (ties: the earlier kind, then the earlier span).

Nulls: a null text is empty and has no spans; rows without doc_id are scanned as well. Texts may be empty or of any
length; every search is linear in the text. Repeated rows get a row each. An empty table gives an empty result. Columns
other than doc_id and text are left out, whatever their names. Offsets are code points, ends are exclusive.
"""

from __future__ import annotations

import ipaddress
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logtide.llm.common import TEXT_ROWS, batch_rows, replaced

KINDS = ("email", "ip", "card", "phone")
THRESHOLD = 0.9
# Characters before and after a span in which words are looked for.
BEFORE, AFTER = 40, 20

# The stated patterns, the first one in two parts so that a text without @ is not searched for it.
_LOCAL = "A-Za-z0-9._%+-"
_HOST = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_NUMBERS = re.compile(r"[0-9]+(?:\.[0-9]+)*")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

# Lists that labelers look in.
GAZETTEERS = {
    "email": frozenset("com org net edu gov info biz io app dev co uk de fr es it nl at ch be eu us ca au jp cn in br mx ru pl se no".split()),
    "ip": ("0.", "127.", "255.", "::"),
    "card": ("34", "37", "30", "36", "38", "39", "35", "4", "51", "52", "53", "54", "55", "22", "23", "24", "25", "26", "27", "6011", "64", "65"),
    "phone": ("1", "20", "27", "30", "31", "32", "33", "34", "39", "41", "43", "44", "45", "46", "47", "48", "49", "52", "55", "61", "81", "86", "91"),
}
SPEAKS_FOR = {
    "email": "mail email e-mail contact contacto kontakt courriel correo write address adresse",
    "ip": "ip host address server login client adresse",
    "card": "card visa mastercard amex credit debit karte carte tarjeta paid",
    "phone": "phone tel telephone call mobile cell fax telefon telefono appel anruf whatsapp",
}
SPEAKS_AGAINST = "version release isbn issn doi order invoice sku serial page section license licence password token key sha md5 id total price eur usd"
_WORD = re.compile(r"[^\W\d_][\w-]*")
_FOR = {kind: frozenset(words.split()) for kind, words in SPEAKS_FOR.items()}
_AGAINST = frozenset(SPEAKS_AGAINST.split())

# Wider candidates; every repetition is bounded or can fail once only.
_AT = re.compile(r"\s?(?:\(at\)|\[at\]|\{at\})\s?|\sat\s|\s@\s?|@\s", re.IGNORECASE)
_LOCAL_END = re.compile(rf"[{_LOCAL}]{{1,64}}\Z")
_LOOSE_HOST = re.compile(
    r"[A-Za-z0-9-]{1,63}(?:(?:\s?(?:\(dot\)|\[dot\]|\{dot\}|\[\.\]|\.)\s?|\sdot\s)[A-Za-z0-9-]{2,63}){1,4}", re.IGNORECASE
)
_LABEL_END = re.compile(r"[A-Za-z0-9-]{1,63}\Z")
_SPELT = re.compile(r"\((?:at|dot)\)|\[(?:at|dot|\.)\]|\{(?:at|dot)\}|\sdot\s", re.IGNORECASE)
_DEFANGED = re.compile(r"(?<![0-9.])[0-9]{1,3}(?:\s?(?:\[\.\]|\(\.\)|\[dot\]|\(dot\))\s?[0-9]{1,3}){3}(?![0-9])", re.IGNORECASE)
_LONG_ADDRESS = re.compile(r"(?<![0-9A-Za-z:.])[0-9A-Fa-f]{0,4}(?::[0-9A-Fa-f]{0,4}){2,8}(?![0-9A-Za-z:])")
_CARD_GROUPS = re.compile(r"(?<![0-9.])[0-9]{4}(?:[./_ ]{1,2}[0-9]{4}){2}[./_ ]{1,2}[0-9]{1,7}(?![0-9])")
_CALLED = re.compile(r"(?<![\w+./-])\(?[0-9]{2,5}\)?(?:[ .-]{1,2}\(?[0-9]{2,5}\)?){1,5}(?![\w@])")
_CALLED_WELL = re.compile(r"\(?[2-9][0-9]{2}\)?[ .-][0-9]{3}[ .-][0-9]{4}|00[0-9]{1,3}([ .-]{1,2}\(?[0-9]{2,5}\)?)+|\(?0[1-9][0-9]{1,3}\)?([ .-][0-9]{2,5})+")
_DATE = re.compile(r"(19|20)[0-9]{2}[ .-][01]?[0-9][ .-][0-3]?[0-9].*|[0-3]?[0-9][ .-][01]?[0-9][ .-](19|20)[0-9]{2}.*")

NO, YES, NOTHING = 0, 1, 2
LABELERS = ("shape", "checksum", "gazetteer", "speaks_for", "speaks_against", "edges")
# Facts about the form: length in four steps, another span of the kind within the text before it, first on its line.
_FORMS = (4, 2, 2)


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def luhn(digits: str) -> bool:
    total = 0
    for place, digit in enumerate(reversed(digits)):
        twice = int(digit) * (1 + place % 2)
        total += twice - 9 * (twice > 9)
    return total % 10 == 0


def _octet(part: str) -> bool:
    short = part.lstrip("0")
    return len(short) <= 3 and int(short or "0") <= 255


def _emails(text: str) -> Iterator[tuple[int, int]]:
    last, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and (text[start - 1].isascii() and text[start - 1].isalnum() or text[start - 1] in "._%+-"):
            start -= 1
        host = _HOST.match(text, at + 1) if start < at else None
        if host:
            last = host.end()
            yield start, last
        at = text.find("@", max(at + 1, last))


def _quads(text: str) -> Iterator[tuple[int, int, bool]]:
    for run in _NUMBERS.finditer(text):
        parts, at = run[0].split("."), run.start()
        for n in range(0, len(parts) - 3, 4):
            four = parts[n : n + 4]
            end = at + sum(map(len, four)) + 3
            yield at, end, all(map(_octet, four))
            at = end + 1


def base_and_failed(text: str) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """Base spans by kind, then start; and the matches of their patterns that failed a check and might be one."""
    base, failed = [], []
    base.extend(("email", start, end) for start, end in _emails(text))
    for start, end, fits in _quads(text):
        (base if fits else failed).append(("ip", start, end))
    for found in _CARD.finditer(text):
        digits = _digits(found[0])
        if 13 <= len(digits) <= 19:
            (base if luhn(digits) else failed).append(("card", *found.span()))
    for found in _PHONE.finditer(text):
        (base if 9 <= len(_digits(found[0])) <= 15 else failed).append(("phone", *found.span()))
    return base, failed


def base_spans(text: str) -> list[tuple[str, int, int]]:
    return base_and_failed(text)[0]


def _wider(text: str) -> Iterator[tuple[str, int, int]]:
    for mark in _AT.finditer(text):
        left = _LOCAL_END.search(text[max(0, mark.start() - 64) : mark.start()])
        right = _LOOSE_HOST.match(text, mark.end())
        if left and right:
            yield "email", mark.start() - len(left[0]), right.end()
    yield from (("ip", *found.span()) for found in _DEFANGED.finditer(text))
    if ":" in text:
        yield from (("ip", *found.span()) for found in _LONG_ADDRESS.finditer(text))
    yield from (("card", *found.span()) for found in _CARD_GROUPS.finditer(text))
    for found in _CALLED.finditer(text):
        if 7 <= len(_digits(found[0])) <= 15:
            yield "phone", *found.span()


def _address(shown: str) -> bool:
    if ":" in shown:
        try:
            ipaddress.IPv6Address(shown)
        except ValueError:
            return False
        return True
    return all(map(_octet, re.findall("[0-9]+", shown)))


def _checks(kind: str, shown: str, base: bool) -> tuple[int, int, int]:
    """Votes of shape, checksum and gazetteer."""
    digits = _digits(shown)
    if kind == "email":
        top = _LABEL_END.search(shown)[0].lower()
        shape = YES if base or _SPELT.search(shown) else NO if re.search(r"\.\s", shown) else NOTHING
        return shape, YES if top.isalpha() and 2 <= len(top) <= 24 else NO, YES if top in GAZETTEERS[kind] else NO
    if kind == "ip":
        listed = shown.startswith(GAZETTEERS[kind])
        return YES if base or "[" in shown or "(" in shown or shown.count(":") > 3 else NOTHING, YES if _address(shown) else NO, NO if listed else YES
    if kind == "card":
        even = re.fullmatch(r"[0-9]{13,19}|[0-9]{4}(.{1,2}[0-9]{4}){2}.{1,2}[0-9]{1,7}|[0-9]{4}.[0-9]{6}.[0-9]{5}", shown)
        return YES if even else NO, YES if 13 <= len(digits) <= 19 and luhn(digits) else NO, YES if digits.startswith(GAZETTEERS[kind]) else NO
    abroad = shown.startswith("+") or digits.startswith("00")
    national = digits.startswith("0") or digits[:1] >= "2" and len(digits) == 10
    known = digits.lstrip("0").startswith(GAZETTEERS[kind]) if abroad else national
    shape = NO if _DATE.fullmatch(shown) else YES if base or _CALLED_WELL.fullmatch(shown) else NO
    return shape, YES if 9 <= len(digits) <= 15 else NO, YES if known else NO


def _votes(text: str, kind: str, start: int, end: int, base: bool) -> tuple[int, ...]:
    near = text[max(0, start - BEFORE) : start] + " " + text[end : end + AFTER]
    words = {word.lower() for word in _WORD.findall(near)}
    before, after = text[start - 1 : start], text[end : end + 1]
    touches = any(c.isalnum() or c in "_=@" for c in before + after)
    return (
        *_checks(kind, text[start:end], base),
        YES if words & _FOR[kind] else NOTHING,
        NO if words & _AGAINST else NOTHING,
        NO if touches else YES,
    )


def signature(kind: str, votes: tuple[int, ...], forms: tuple[int, ...]) -> int:
    code = KINDS.index(kind)
    for vote in votes:
        code = code * 3 + vote
    for form, size in zip(forms, _FORMS, strict=True):
        code = code * size + form
    return code


def parts(code: int) -> tuple[int, tuple[int, ...], tuple[int, ...]]:
    """Kind, votes and form of a signature."""
    forms, votes = [], []
    for size in reversed(_FORMS):
        code, form = divmod(code, size)
        forms.append(form)
    for _ in LABELERS:
        code, vote = divmod(code, 3)
        votes.append(vote)
    return code, tuple(reversed(votes)), tuple(reversed(forms))


def candidates(text: str) -> list[tuple[str, int, int, bool, int]]:
    """(kind, start, end, base, signature): base spans by kind and start, then the other candidates that overlap none of them."""
    base, failed = base_and_failed(text)
    taken = sorted((start, end) for _, start, end in base)
    starts = np.array([start for start, _ in taken], dtype=np.int64)
    # Base spans of different kinds may overlap: what counts is how far those that start earlier reach.
    reach = np.maximum.accumulate(np.array([end for _, end in taken], dtype=np.int64)) if taken else starts
    found = [(*span, True) for span in base]
    for kind, start, end in sorted({*failed, *_wider(text)}):
        before = int(np.searchsorted(starts, end)) - 1
        if before < 0 or reach[before] <= start:
            found.append((kind, start, end, False))
    seen: set[str] = set()
    out = []
    for kind, start, end, is_base in found:
        forms = (min(3, (end - start) // 8), int(kind in seen), int(start == 0 or text[start - 1] == "\n"))
        seen.add(kind)
        out.append((kind, start, end, is_base, signature(kind, _votes(text, kind, start, end, is_base), forms)))
    return out


_CANDIDATE = "struct<kind:string,start:int,end:int,base:boolean,signature:int>"


def scanned(documents: DataFrame) -> DataFrame:
    """(doc_id, candidates) of every document."""

    @F.pandas_udf(f"array<{_CANDIDATE}>")
    def scan(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        names = ("kind", "start", "end", "base", "signature")
        for batch in batches:
            yield pd.Series([[dict(zip(names, row, strict=True)) for row in candidates(text)] for text in batch])

    batch_rows(documents.sparkSession, TEXT_ROWS)
    return documents.select("doc_id", scan(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("candidates"))


@dataclass(frozen=True)
class Model:
    """Reliabilities of the labelers (labeler, class, vote), shares of personal spans by kind, score of each signature."""

    reliabilities: np.ndarray
    shares: np.ndarray
    scores: dict[int, float]


def aggregated(kinds: np.ndarray, votes: np.ndarray, counts: np.ndarray, known: np.ndarray, most: int = 500) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(likelihood of each row, reliabilities, shares) by expectation-maximisation; `known` rows are personal.

    Labelers vote independently given the class. Pseudo-counts hold each one to be right more often than wrong.
    """
    n, labelers = votes.shape
    prior = np.empty((labelers, 2, 3))
    prior[:, 0] = (4.0, 2.0, 2.0)
    prior[:, 1] = (2.0, 4.0, 2.0)
    likely = np.where(known, 1.0, np.clip((1.0 + (votes == YES).sum(1)) / (2.0 + (votes != NOTHING).sum(1)), 0.05, 0.95))
    chosen = np.eye(3)[votes]
    for _ in range(most):
        weights = np.stack([counts * (1 - likely), counts * likely], axis=1)
        rates = prior + np.einsum("nc,nlv->lcv", weights, chosen)
        rates /= rates.sum(axis=2, keepdims=True)
        shares = np.array([(1 + weights[(kinds == k) & ~known, 1].sum()) / (2 + weights[(kinds == k) & ~known].sum()) for k in range(len(KINDS))])
        odds = np.log(shares / (1 - shares))[kinds]
        odds = odds + np.log(rates[np.arange(labelers), 1, votes] / rates[np.arange(labelers), 0, votes]).sum(axis=1)
        now = np.where(known, 1.0, 1 / (1 + np.exp(-np.clip(odds, -500, 500))))
        done = np.abs(now - likely).max(initial=0.0) < 1e-9
        likely = now
        if done:
            break
    return likely, rates, shares


def _design(codes: list[int]) -> np.ndarray:
    """A row of zeros and ones per signature: kind, votes, form."""
    rows = []
    for code in codes:
        kind, votes, forms = parts(code)
        rows.append([*np.eye(len(KINDS))[kind], *np.eye(3)[list(votes)][:, :2].ravel(), *np.eye(4)[forms[0]][1:], *forms[1:]])
    return np.array(rows, dtype=np.float64)


def logistic(design: np.ndarray, target: np.ndarray, weights: np.ndarray, penalty: float = 1.0) -> np.ndarray:
    """Coefficients by Newton steps on the penalised likelihood of fractional targets."""
    at = np.zeros(design.shape[1])
    for _ in range(50):
        shown = 1 / (1 + np.exp(-np.clip(design @ at, -30, 30)))
        slope = design.T @ (weights * (target - shown)) - penalty * at
        curve = (design.T * (weights * np.maximum(shown * (1 - shown), 1e-9))) @ design + penalty * np.eye(len(at))
        step = np.linalg.solve(curve, slope)
        at = at + step * min(1.0, 5.0 / max(np.abs(step).max(), 1e-12))
        if np.abs(step).max() < 1e-9:
            break
    return at


def fit(scans: DataFrame) -> Model:
    """Learns from the votes on all candidates of all documents; what reaches the driver are counts of signatures."""
    spans = scans.select(F.explode("candidates").alias("c")).groupBy("c.signature", "c.base").agg(F.count("*").alias("n"))
    rows = sorted((row["signature"], row["base"], row["n"]) for row in spans.collect())
    if not rows:
        return Model(np.full((len(LABELERS), 2, 3), 1 / 3), np.full(len(KINDS), 0.5), {})
    codes = [row[0] for row in rows]
    split = [parts(code) for code in codes]
    kinds, votes = np.array([p[0] for p in split]), np.array([p[1] for p in split])
    known, counts = np.array([row[1] for row in rows]), np.array([row[2] for row in rows], dtype=np.float64)
    likely, rates, shares = aggregated(kinds, votes, counts, known)
    design = _design(codes)
    # Counts by their root: the many repeats of a common signature say less than as many signatures.
    coefficients = logistic(design, likely, np.sqrt(counts))
    scores = 1 / (1 + np.exp(-np.clip(design @ coefficients, -30, 30)))
    return Model(rates, shares, dict(zip(codes, scores.tolist(), strict=True)))


def accepted(found: list, scores: dict[int, float], threshold: float = THRESHOLD) -> list[tuple[str, int, int, bool, float]]:
    """Base spans, and of the other candidates the likely ones without overlap; by kind, then start."""
    kept = [(c["kind"], c["start"], c["end"], True, 1.0) for c in found if c["base"]]
    others = [(c["kind"], c["start"], c["end"], False, scores.get(c["signature"], 0.0)) for c in found if not c["base"]]
    added: list[tuple[str, int, int, bool, float]] = []
    ends: dict[int, int] = {}
    likely = sorted((c for c in others if c[4] >= threshold), key=lambda c: (-c[4], KINDS.index(c[0]), c[1], c[2]))
    for c in likely:
        # Spans are at most a few hundred characters long, so that a place is taken if any of its characters is.
        if not any(at in ends for at in range(c[1], c[2])):
            ends.update(dict.fromkeys(range(c[1], c[2]), 1))
            added.append(c)
    return sorted(kept + added, key=lambda c: (KINDS.index(c[0]), c[1], c[2]))


def found_in(scans: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, spans): what the classifier keeps, with its score, by kind and start."""
    schema = "array<struct<kind:string,start:int,end:int,base:boolean,score:double>>"
    scores = model.scores

    @F.pandas_udf(schema)
    def choose(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        names = ("kind", "start", "end", "base", "score")
        for batch in batches:
            yield pd.Series([[dict(zip(names, row, strict=True)) for row in accepted(list(found), scores, threshold)] for found in batch])

    # Documents without candidates, most of them, need no Python.
    some = scans.where(F.size("candidates") > 0).select("doc_id", choose("candidates").alias("spans"))
    none = scans.where(F.size("candidates") == 0).select("doc_id", F.array().cast(schema).alias("spans"))
    return some.unionByName(none)


def _number(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind))


def _shown(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def judged(documents: DataFrame) -> DataFrame:
    """Counts and digest of the base spans and all spans of every document."""
    scans = replaced(scanned(documents), "candidates")
    found = found_in(scans, fit(scans))
    base = F.filter("spans", lambda s: s["base"])
    counts = [_number(base, kind).cast("bigint").alias(f"n_{kind}") for kind in KINDS]
    return found.select("doc_id", *counts, F.sha2(_shown(base), 256).alias("base_sha256"), _shown(F.col("spans")).alias("spans"))
