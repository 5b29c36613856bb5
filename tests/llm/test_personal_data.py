"""Personal data: the stated patterns by plain matching, added spans, what the aggregation and the classifier learn."""

import hashlib
import random
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from logtide.llm import pii

DOCS = "doc_id bigint, text string"


def plain(text):
    """Base spans as the patterns read, one after the other."""
    spans = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(part) <= 255 for part in m[0].split(".")):
            spans.append(("ip", *m.span()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = re.sub("[^0-9]", "", m[0])
        if 13 <= len(digits) <= 19 and sum(sum(map(int, str(int(d) * (1 + i % 2)))) for i, d in enumerate(digits[::-1])) % 10 == 0:
            spans.append(("card", *m.span()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15:
            spans.append(("phone", *m.span()))
    return spans


PIECES = ["a", "b1", "@", ".", "-", "+", "1", "22", "255", "0256", " ", "(", "0", "é", "🙂", "4111", "٣", ".com", "\n"]


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(PIECES), max_size=40))
def test_base_spans_equal_plain_matching(pieces):
    text = "".join(pieces)
    assert pii.base_spans(text) == plain(text)


@pytest.mark.parametrize("piece", ["a", "1", "1.", "@", "a@", "+1 ", " at a", ":", "4111 ", "(", "[at]", "1-1.", "a."])
def test_searches_are_linear_in_the_text(piece):
    text = piece * (200_000 // len(piece))
    assert isinstance(pii.candidates(text), list)


def _corpus():
    draw = random.Random(4)
    words = "than the erth onhe is reble ly ated nd ofor thing 3.0 stan".split()
    prose = lambda n: " ".join(draw.choice(words) for _ in range(n))
    said = [
        lambda: f"mail {draw.choice('abcxyz')}{draw.randint(1, 99)}@mail{draw.randint(1, 9)}.example.com",
        lambda: f"+1 ({draw.randint(200, 999)}) 555-{draw.randint(1000, 9999)}",
        lambda: f"{draw.randint(11, 99)}.{draw.randint(11, 99)}.{draw.randint(1, 250)}.{draw.randint(1, 250)}",
        lambda: "4111 1111 1111 1111",
    ]
    rows = [(i, prose(30) + (" " + said[i % 4]() + " " if i % 3 == 0 else " ") + prose(20)) for i in range(400)]
    return rows, prose


def test_spans_are_added_and_clean_texts_left_alone(spark):
    rows, prose = _corpus()
    hidden = {
        1000: ("email", "john.smith [at] mail3.example [dot] com"),
        1001: ("email", "jane (at) example.org"),
        1002: ("ip", "93[.]184[.]216[.]34"),
        1003: ("phone", "(366) 555-9807"),
        1004: ("card", "4111.1111.1111.1111"),
    }
    rows += [(i, f"{prose(5)} {shown} {prose(5)}") for i, (_, shown) in hidden.items()]
    texts = dict(rows)
    found = {r["doc_id"]: r["spans"] for r in pii.judged(spark.createDataFrame(rows, DOCS)).collect()}
    for i, (kind, shown) in hidden.items():
        start = texts[i].index(shown)
        assert f"{kind}:{start}:{start + len(shown)}" in found[i].split(","), (shown, found[i])
    for i, text in texts.items():
        if i < 1000:
            assert found[i] == ",".join(f"{k}:{a}:{b}" for k, a, b in plain(text))


def test_nulls_empty_repeated_and_extra_columns(spark):
    rows = [(1, None, "x", 0), (2, "", "y", 1), (None, "a@b.co 4111111111111111", "z", 2), (3, "é🙂 a@b.co", "z", 2), (3, "é🙂 a@b.co", "z", 2)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, spans string, candidates int")
    made = pii.judged(docs)
    assert made.columns == ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"]
    found = sorted((tuple(r) for r in made.collect()), key=repr)
    nothing = hashlib.sha256(b"").hexdigest()
    assert [r for r in found if r[0] in (1, 2)] == [(1, 0, 0, 0, 0, nothing, ""), (2, 0, 0, 0, 0, nothing, "")]
    assert [r[6] for r in found if r[0] == 3] == ["email:3:9"] * 2
    assert [(r[1], r[3], r[6]) for r in found if r[0] is None] == [(1, 1, "email:0:6,card:7:23")]
    assert pii.judged(docs.limit(0)).count() == 0


def test_base_digest_of_all_documents(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text")
    texts = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    for row in pii.judged(docs).collect():
        spans = plain(texts[row["doc_id"]])
        assert row["base_sha256"] == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in spans).encode()).hexdigest()
        assert [row[f"n_{kind}"] for kind in pii.KINDS] == [sum(k == kind for k, _, _ in spans) for kind in pii.KINDS]
        assert {f"{k}:{a}:{b}" for k, a, b in spans} <= set(row["spans"].split(","))


def test_aggregation_equals_one_row_per_span_and_finds_reliabilities():
    rng = np.random.default_rng(2)
    truth = rng.random(6000) < 0.3
    right = np.array([0.95, 0.9, 0.8, 0.7, 0.85, 0.6])
    votes = np.where(rng.random((6000, 6)) < right, truth[:, None], ~truth[:, None]).astype(int)
    votes[rng.random((6000, 6)) < 0.2] = pii.NOTHING
    kinds, known = np.zeros(6000, dtype=int), truth & (rng.random(6000) < 0.2)
    single, rates, _ = pii.aggregated(kinds, votes, np.ones(6000), known)
    rows, at, counts = np.unique(np.column_stack([votes, known]), axis=0, return_inverse=True, return_counts=True)
    grouped, same, _ = pii.aggregated(np.zeros(len(rows), dtype=int), rows[:, :6], counts.astype(float), rows[:, 6] == 1)
    assert np.allclose(rates, same, atol=1e-6) and np.allclose(single, grouped[at.ravel()], atol=1e-6)
    assert ((single > 0.5) == truth).mean() > 0.95
    cast = rates[:, :, :2].sum(axis=2)
    assert np.allclose(rates[:, 1, 1] / cast[:, 1], right, atol=0.05)


def test_signatures_can_be_read_back():
    for votes in [(0, 1, 2, 1, 2, 0), (2, 2, 2, 2, 2, 2), (1, 1, 1, 1, 1, 1)]:
        for kind in pii.KINDS:
            assert pii.parts(pii.signature(kind, votes, (3, 1, 0))) == (pii.KINDS.index(kind), votes, (3, 1, 0))


def test_overlapping_candidates_leave_the_likelier_one():
    row = lambda kind, start, end, base, code: {"kind": kind, "start": start, "end": end, "base": base, "signature": code}
    found = [row("email", 0, 5, True, 1), row("phone", 10, 20, False, 2), row("card", 15, 30, False, 3), row("ip", 40, 50, False, 4)]
    kept = pii.accepted(found, {2: 0.95, 3: 0.99, 4: 0.1})
    assert [c[:3] for c in kept] == [("email", 0, 5), ("card", 15, 30)]
