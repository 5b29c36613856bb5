"""Chat formatting by a grammar round trip.

A conversation is rendered turn by turn as

    <|turn|>ROLE<|text|>TEXT<|end|>

and the rendered text is parsed again by a deterministic parser that knows only the grammar. A turn whose parsed role
and text differ from the source, because they hold control strings or look escaped, has them escaped and is parsed
again until both are identical. Escaping puts one more backslash behind the first character of each control string
(`<|end|>` becomes `<\\|end|>`); parsing takes one away, so texts that hold escaped strings survive as well.

The output has a row per turn, in order: `piece` is the rendered turn, and the pieces of a conversation joined by
nothing are its formatted text; `loss_start` and `loss_length` mark the span under the loss mask within the piece.
Rendering needs one turn at a time, so a conversation of any length is never held as a whole; only digests read the
turns of one conversation in order, as a stream.

Nulls: a null role or text is empty; turns without a conversation id form one conversation; null turns come first.
Ties: rows of the same turn follow each other by role, then text; repeated rows are turns of their own. Texts may
be empty or of any length. Other columns are left out.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>"
LOSS_ROLES = ("assistant",)
# Control strings, those of other common templates included: in a text they all are escaped.
_CONTROL = re.compile(r"(<|\[)(\\*)(\|(?:turn|text|end|im_start|im_end|endoftext|system|user|assistant)\||/?s(?=>)|/?INST(?=\]))")
_ESCAPED = re.compile(_CONTROL.pattern.replace(r"(\\*)", r"\\(\\*)"))
_GRAMMAR = re.compile(re.escape(TURN) + r"(.*?)" + re.escape(TEXT) + r"(.*?)" + re.escape(END), re.DOTALL)


def escape(text: str) -> str:
    return _CONTROL.sub(r"\1\\\2\3", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1\2\3", text)


def parse(formatted: str) -> list[tuple[str, str, int, int]]:
    """(role, text, start, length of the text as rendered) of every turn; anything else in the input is an error."""
    turns, at = [], 0
    while at < len(formatted):
        found = _GRAMMAR.match(formatted, at)
        if found is None:
            raise ValueError(f"no turn at character {at}")
        turns.append((unescape(found[1]), unescape(found[2]), found.start(2), found.end(2) - found.start(2)))
        at = found.end()
    return turns


def _read(piece: str) -> tuple[str, str, int, int] | None:
    try:
        turns = parse(piece)
    except ValueError:
        return None
    return turns[0] if len(turns) == 1 else None


def render(role: str, text: str) -> tuple[str, int, int]:
    """(piece, start and length of the text in it), escaped as far as the round trip needs it."""
    shown_role, shown_text = role, text
    for _ in range(2):
        piece = f"{TURN}{shown_role}{TEXT}{shown_text}{END}"
        found = _read(piece)
        # Control strings of other templates are escaped as well: a reader of the text could take them for its own.
        if found is not None and found[:2] == (role, text) and not _CONTROL.search(text):
            return piece, found[2], found[3]
        if found is not None and found[:2] == (role, text) and shown_text != text:
            return piece, found[2], found[3]
        shown_role, shown_text = escape(role), escape(text)
    raise ValueError("the turn does not survive the round trip")


def formatted(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, piece, loss_start, loss_length), a row per turn; the loss columns are null outside the mask."""

    @F.pandas_udf("piece string, loss_start int, loss_length int")
    def rendered(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for roles, texts in batches:
            rows = [render(role, text) for role, text in zip(roles, texts, strict=True)]
            made = pd.DataFrame(rows, columns=["piece", "loss_start", "loss_length"])
            outside = ~roles.isin(LOSS_ROLES).to_numpy()
            yield made.astype({"loss_start": "Int32", "loss_length": "Int32"}).assign(
                **{c: made[c].astype("Int32").mask(outside) for c in ("loss_start", "loss_length")}
            )

    rows = conversations.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.withColumn("_r", rendered("role", "text")).select("conv_id", "turn", "role", "text", "_r.*")


class _Digest:
    """What is read back from the pieces of one conversation."""

    def __init__(self, conv_id) -> None:
        self.conv_id, self.n_turns, self.loss_chars, self.chars = conv_id, 0, 0, 0
        self.turns, self.loss = hashlib.sha256(), hashlib.sha256()

    def add(self, piece: str, start: int | None, length: int | None) -> None:
        for role, text, _, _ in parse(piece):
            self.n_turns += 1
            self.turns.update(f"{role}\n{text}\n".encode())
        if start is not None:
            masked = unescape(piece[start : start + length])
            self.loss_chars += len(masked)
            self.loss.update(masked.encode())
        self.chars += len(piece)

    def row(self) -> tuple:
        return self.conv_id, self.n_turns, self.turns.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars


_SCHEMA = "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint"


def read_back(pieces: DataFrame) -> DataFrame:
    """Digests of every conversation, from the rendered pieces and the loss spans alone."""
    columns = [part.split()[0] for part in _SCHEMA.split(", ")]

    def stream(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        open_: _Digest | None = None
        for batch in batches:
            done = []
            rows = zip(batch["conv_id"].astype("Int64"), batch["piece"], batch["loss_start"].astype("Int64"), batch["loss_length"].astype("Int64"), strict=True)
            for conv_id, piece, start, length in rows:
                conv_id = None if pd.isna(conv_id) else int(conv_id)
                if open_ is None or open_.conv_id != conv_id:
                    if open_ is not None:
                        done.append(open_.row())
                    open_ = _Digest(conv_id)
                open_.add(piece, None if pd.isna(start) else int(start), None if pd.isna(length) else int(length))
            if done:
                yield pd.DataFrame(done, columns=columns).astype({"conv_id": "Int64"})
        if open_ is not None:
            yield pd.DataFrame([open_.row()], columns=columns).astype({"conv_id": "Int64"})

    ordered = pieces.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return ordered.select("conv_id", "piece", "loss_start", "loss_length").mapInPandas(stream, _SCHEMA)


# The conversation that the query adds, which holds another template's control strings.
ADDED_ID, ADDED_TEXT = -7, "</s>[INST] ok [/INST]"


def with_added(conversations: DataFrame) -> DataFrame:
    rows = [(ADDED_ID, 0, "user", ADDED_TEXT), (ADDED_ID, 1, "assistant", ADDED_TEXT)]
    added = conversations.sparkSession.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    return conversations.select("conv_id", "turn", "role", "text").unionByName(added)


def sql() -> str:
    """The rows of the query in DuckDB's SQL; the lengths count what rendering adds to the source."""
    marks = len(TURN + TEXT + END)
    return f"""WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
      UNION ALL VALUES ({ADDED_ID}, 0, 'user', '{ADDED_TEXT}'), ({ADDED_ID}, 1, 'assistant', '{ADDED_TEXT}')),
    e AS (SELECT *, regexp_replace(text, '(<|\\[)(\\\\*\\|(?:turn|text|end|im_start|im_end|endoftext|system|user|assistant)\\||\\\\*/?s>|\\\\*/?INST\\])', '\\1\\\\\\2', 'g') AS shown FROM c)
    SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
      coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
      sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
      sum(length(role) + length(shown) + {marks})::BIGINT AS formatted_chars
    FROM e GROUP BY conv_id"""
