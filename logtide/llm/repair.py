"""Conversation structure repair: a dynamic program streamed over secondary-sorted turns.

Role initials of a sound conversation read `(s?(ua)+)?`. Rows are dealt by conversation and sorted by turn, and one
stream over them carries the cheapest way into each of the four states of that grammar (nothing yet, after a system,
user or assistant turn) from one Arrow batch to the next: Keep costs 0, Rerole to user or assistant 2, Delete 3 (the
only way for blank and duplicate rows), Insert an empty user or assistant turn 2, and a truncated row that stays 1.
A row leaves four bytes behind, the backpointers of the states. The backpointers of a conversation of at most `CHUNK`
rows are read back at once; those of a longer one leave the task as rows, `CHUNK` of them each, and a second stream
reads these from the last to the first. A third stream over the sorted rows applies the edits and returns the repaired
turns. Memory holds a batch, a chunk and the edits of one conversation (a byte a row, as in the result).

Of equally cheap edits the ASCII-least string of initials is taken. Edits before a row are compared by a rank of the
at most four strings kept, as none of them begins another one: each ends with the edit of the same row, and an edit and
a state leave one next state only.

Nulls: a null role or text is one space, so such a text is blank; null turns come first and have no part in gaps; rows
without a conversation id form one conversation. Ties: rows of one turn follow each other by role, then text, and
repeated rows are duplicates. An empty role, or one with another initial than s, u or a, can be reroled or deleted but
not kept. Texts may be empty or of any length. A conversation that lost all rows has zeros, no edits and no turns; an
empty table gives an empty result. Columns other than conv_id, turn, role and text are left out, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logtide.llm.common import TEXT_ROWS, batch_rows, replaced

# Rows whose backpointers are held before they leave the task.
CHUNK = 65_536
# A table of repeated turns is broadcast up to this many rows of about 50 bytes.
REPEATED_ROWS = 65_536
BLANKS = " \t\n\v\f\r"
ENDS = ".!?"

# States: 0 nothing yet, 1 after system, 2 after user, 3 after assistant. The turn to insert, or the role to give, is
# settled by the state: user, but after a user assistant.
_KEPT = {"s": (1, None, None, None), "u": (2, 2, None, 2), "a": (None, None, 3, None)}
_GIVEN = (2, 2, 3, 2)
_ROLES = {2: "user", 3: "assistant"}
_SOUND_PAIRS = frozenset({"su", "ua", "au"})
_EDITS = "DKR"
_DEAD = 255
# From the cheapest state any rest can be finished at 5 more than from another one: dearer states are dropped, which
# leaves finitely many tables of costs and makes a step one look-up.
_MOST_APART = 5
_FIRST = ((0, 0), None, None, None)

Level = tuple[tuple[int, int] | None, ...]


def _with_inserts(level: Level) -> list[tuple[int, int, int, int] | None]:
    """(cost, rank, inserts, origin) of the cheapest way into each state by inserts alone."""
    best: list[tuple[int, int, int, int] | None] = [None] * 4
    for origin, held in enumerate(level):
        if held is not None:
            state, cost = origin, held[0]
            for inserts in range(3):
                found = (cost, held[1], inserts, origin)
                best[state] = found if best[state] is None else min(best[state], found)
                state, cost = _GIVEN[state], cost + 2
    return best


@lru_cache(maxsize=65_536)
def _step(level: Level, initial: str, doomed: bool, truncated: bool) -> tuple[Level, bytes, int]:
    """The table after one row, its four backpointers, and what all costs have risen by."""
    found: dict[int, tuple[int, int, str, int]] = {}
    for state, reached in enumerate(_with_inserts(level)):
        if reached is None:
            continue
        cost, rank, inserts, origin = reached
        moves = [("D", state, 3)]
        if not doomed:
            kept = _KEPT[initial][state] if initial in _KEPT else None
            if kept is not None:
                moves.append(("K", kept, int(truncated)))
            moves.append(("R", _GIVEN[state], 2 + int(truncated)))
        for edit, to, more in moves:
            option = (cost + more, rank, "I" * inserts + edit, origin)
            found[to] = min(found.get(to, option), option)
    least = min(option[0] for option in found.values())
    alive = {state: option for state, option in found.items() if option[0] - least <= _MOST_APART}
    ranks = {edits: n for n, edits in enumerate(sorted({option[1:3] for option in alive.values()}))}
    after = tuple((alive[s][0] - least, ranks[alive[s][1:3]]) if s in alive else None for s in range(4))
    trace = bytes(
        alive[s][3] | (len(alive[s][2]) - 1) << 2 | _EDITS.index(alive[s][2][-1]) << 4 if s in alive else _DEAD for s in range(4)
    )
    return after, trace, least


def _finish(level: Level) -> tuple[int, int, int]:
    """(cost, inserts, state of the last row) of the cheapest sound end."""
    reached = _with_inserts(level)
    cost, _, inserts, origin = min(reached[state] for state in (0, 3) if reached[state] is not None)
    return cost, inserts, origin


def _read_back(trace: bytes, state: int) -> tuple[str, int]:
    """The edits of the rows of a piece of backpointers, and the state before it; `state` is the one behind it."""
    edits = []
    for at in range(len(trace) - 4, -1, -4):
        code = trace[at + state]
        edits.append("I" * (code >> 2 & 3) + _EDITS[code >> 4])
        state = code & 3
    return "".join(reversed(edits)), state


def damaged(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, present): each row damaged as the hash of its conversation and turn says.

    A dropped row stays as one that is not present, so that its conversation is known.
    """
    key = F.concat_ws(":", *(F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")))
    kind = F.crc32(key.cast("binary")) % 20
    rows = conversations.select(
        "conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"), kind.alias("kind")
    )
    text = F.when(F.col("kind").isin(0, 1), "").when(F.col("kind") == 2, F.translate("text", ENDS, "")).otherwise(F.col("text"))
    copies = F.array_repeat(F.col("kind") != 0, F.when(F.col("kind") == 3, 2).otherwise(1))
    role = F.when(F.col("kind") == 4, "user").otherwise(F.col("role"))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(copies).alias("present"))


def _with_later(rows: DataFrame) -> DataFrame:
    """Marks rows whose role and text stand in an earlier turn of their conversation.

    Only turns that occur more than once are joined; copies within the first turn follow each other in the stream.
    """
    known = F.struct(F.col("turn").isNotNull().alias("known"), "turn")
    mark = F.unhex(F.sha2(F.concat_ws(":", F.length("role").cast("string"), "role", "text"), 256))
    keyed = rows.withColumn("mark", mark)
    repeated = keyed.where("present").groupBy("conv_id", "mark").agg(F.min(known).alias("first"), F.count("*").alias("n"))
    repeated = replaced(repeated.where("n > 1").select(F.col("conv_id").alias("of"), F.col("mark").alias("same"), "first"), "repeated-turns")
    if repeated.count() <= REPEATED_ROWS:
        repeated = F.broadcast(repeated)
    joined = keyed.join(repeated, F.col("conv_id").eqNullSafe(F.col("of")) & (F.col("mark") == F.col("same")), "left")
    return joined.select(*rows.columns, F.coalesce(known > F.col("first"), F.lit(False)).alias("later"))


class _Conversation:
    """What the first stream carries of the conversation that it is in."""

    def __init__(self, conv_id: int | None) -> None:
        self.conv_id = conv_id
        self.turns, self.first_turn, self.last_turn = 0, 0, 0
        self.blank = self.duplicate = self.truncated = self.illegal = self.cost = 0
        self.role: str | None = None
        self.text = ""
        self.level = _FIRST
        self.trace = bytearray()
        self.chunks = 0

    def add(self, turn: int | None, role: str, text: str, later: bool) -> None:
        if turn is not None and (not self.turns or turn != self.last_turn):
            self.first_turn = turn if not self.turns else self.first_turn
            self.turns, self.last_turn = self.turns + 1, turn
        shown = text.rstrip(BLANKS)
        blank = not shown
        duplicate = not blank and (later or (role == self.role and text == self.text))
        truncated = not blank and not duplicate and shown[-1] not in ENDS
        self.blank, self.duplicate, self.truncated = self.blank + blank, self.duplicate + duplicate, self.truncated + truncated
        if self.role is not None and self.role[:1] + role[:1] not in _SOUND_PAIRS:
            self.illegal += 1
        self.role, self.text = role, text
        self.level, trace, more = _step(self.level, role[:1], blank or duplicate, truncated)
        self.cost += more
        self.trace += trace

    def spilled(self) -> tuple:
        """The backpointers held, as a row of their own."""
        row = (self.conv_id, self.chunks, bytes(self.trace), *[None] * 9)
        self.chunks, self.trace = self.chunks + 1, bytearray()
        return row

    def row(self) -> tuple:
        """The summary; its edits are null where backpointers have left the task."""
        cost, inserts, state = _finish(self.level)
        end = "I" * inserts
        edits = None if self.chunks else _read_back(self.trace, state)[0] + end
        gaps = self.last_turn - self.first_turn + 1 - self.turns if self.turns else 0
        counts = (gaps, self.blank, self.duplicate, self.truncated, self.illegal, self.cost + cost)
        return self.conv_id, None, bytes(self.trace) if self.chunks else None, *counts, edits, state, end


_COUNTS = "gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string"
_PIECES = f"conv_id bigint, chunk bigint, trace binary, {_COUNTS}, state bigint, ending string"
_EDITED = f"conv_id bigint, {_COUNTS}"


def _frame(rows: list[tuple], schema: str) -> pd.DataFrame:
    fields = [field.split() for field in schema.split(", ")]
    made = pd.DataFrame(rows, columns=[name for name, _ in fields], dtype=object)
    return made.astype({name: "Int64" for name, kind in fields if kind == "bigint"})


def _values(batch: pd.DataFrame, *names: str) -> Iterator[tuple]:
    """Rows of a batch with plain integers, and None for null ones."""
    columns = []
    for name in names:
        column = batch[name]
        if pd.api.types.is_numeric_dtype(column) and not pd.api.types.is_bool_dtype(column):
            column = column.astype("Int64").astype(object).where(column.notna(), None)
        columns.append(column.tolist())
    return zip(*columns, strict=True)


def edits(rows: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit) of each conversation of `rows`."""

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now: _Conversation | None = None
        for batch in batches:
            made = []
            for conv_id, turn, role, text, present, later in _values(batch, "conv_id", "turn", "role", "text", "present", "later"):
                if now is None or now.conv_id != conv_id:
                    if now is not None:
                        made.append(now.row())
                    now = _Conversation(conv_id)
                if present:
                    if len(now.trace) == 4 * chunk:
                        made.append(now.spilled())
                    now.add(turn, role, text, later)
            if made:
                yield _frame(made, _PIECES)
        if now is not None:
            yield _frame([now.row()], _PIECES)

    def back(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, pieces = None, []
        for batch in batches:
            made = []
            for row in _values(batch, *[field.split()[0] for field in _PIECES.split(", ")]):
                if row[1] is None:
                    now, state, pieces = row, row[10], [row[11]]
                piece, state = _read_back(row[2], state)
                pieces.append(piece)
                if row[1] == 0:
                    made.append((now[0], *now[3:9], "".join(reversed(pieces))))
            if made:
                yield _frame(made, _EDITED)

    batch_rows(rows.sparkSession, TEXT_ROWS)
    ordered = _with_later(rows).repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    found = replaced(ordered.mapInPandas(walk, _PIECES), "edits")
    whole = found.where("audit IS NOT NULL").select(*[field.split()[0] for field in _EDITED.split(", ")])
    long = found.where("audit IS NULL").repartition("conv_id").sortWithinPartitions("conv_id", F.desc_nulls_first("chunk"))
    return whole.unionByName(long.mapInPandas(back, _EDITED))


_TURNS = "conv_id bigint, position bigint, edit string, role string, text string"


def repaired(rows: DataFrame, edited: DataFrame) -> DataFrame:
    """(conv_id, position, edit, role, text): the turns that the edits leave, in order within each conversation.

    Turns of a conversation follow each other within one partition.
    """

    def apply(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        conv_id, audit, at, state, position = None, "", 0, 0, 0
        made: list[tuple] = []

        def put(edit: str, to: int, role: str, text: str) -> None:
            nonlocal state, position
            made.append((conv_id, position, edit, role, text))
            state, position = to, position + 1

        def inserted() -> None:
            nonlocal at
            while at < len(audit) and audit[at] == "I":
                put("I", _GIVEN[state], _ROLES[_GIVEN[state]], "")
                at += 1

        for batch in batches:
            for found, kind, role, text in _values(batch, "conv_id", "kind", "role", "text"):
                if kind == 0:
                    inserted()
                    conv_id, audit, at, state, position = found, text, 0, 0, 0
                    continue
                inserted()
                edit = audit[at]
                at += 1
                if edit == "K":
                    put(edit, _KEPT[role[:1]][state], role, text)
                elif edit == "R":
                    put(edit, _GIVEN[state], _ROLES[_GIVEN[state]], text)
            if made:
                yield _frame(made, _TURNS)
                made.clear()
        inserted()
        if made:
            yield _frame(made, _TURNS)

    batch_rows(rows.sparkSession, TEXT_ROWS)
    turns = rows.where("present").select("conv_id", F.lit(1).alias("kind"), "turn", "role", "text")
    heads = edited.select("conv_id", F.lit(0).alias("kind"), F.lit(None).cast("bigint").alias("turn"), F.lit("").alias("role"), F.col("audit").alias("text"))
    ordered = turns.unionByName(heads).repartition("conv_id").sortWithinPartitions("conv_id", "kind", "turn", "role", "text")
    return ordered.select("conv_id", "kind", "role", "text").mapInPandas(apply, _TURNS)


def digests(turns: DataFrame) -> DataFrame:
    """(conv_id, repaired_sha256) of every conversation with turns, read in the order in which `repaired` makes them."""
    schema = "conv_id bigint, repaired_sha256 string"

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        conv_id, digest = None, None
        for batch in batches:
            made = []
            for found, position, role, text in _values(batch, "conv_id", "position", "role", "text"):
                if position == 0:
                    if digest is not None:
                        made.append((conv_id, digest.hexdigest()))
                    conv_id, digest = found, hashlib.sha256()
                digest.update(f"{chr(10) if position else ''}{role}:{text}".encode("utf-8", "surrogatepass"))
            if made:
                yield _frame(made, schema)
        if digest is not None:
            yield _frame([(conv_id, digest.hexdigest())], schema)

    return turns.mapInPandas(read, schema)


def judged(conversations: DataFrame) -> DataFrame:
    """Faults, cheapest edits and the digest of the repaired turns of every conversation, after the stated damage."""
    rows = damaged(conversations)
    edited = replaced(edits(rows), "conversations-edited")
    found = digests(repaired(rows, edited)).withColumnRenamed("conv_id", "of")
    joined = edited.join(found, F.col("conv_id").eqNullSafe(F.col("of")), "left")
    return joined.select(*edited.columns, F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))


def sql() -> str:
    """The rows of the query in DuckDB's SQL: costs from the last row back, then the edits from the first one on."""
    space = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
    return rf"""WITH RECURSIVE bits AS (SELECT list(v ORDER BY i) AS tab FROM (
      SELECT i, list_reduce(list_concat([i], range(8)), lambda c, n: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v FROM range(256) r(i))),
    keyed AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
      coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS k FROM conversations),
    hashed AS (SELECT conv_id, turn, role, text, xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(range(1, length(k) + 1), lambda i: ord(k[i])::BIGINT)),
      lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1])), 4294967295) % 20 AS kind FROM keyed, bits),
    hurt AS (SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
      CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
      FROM hashed, range(2) c(copy) WHERE kind <> 0 AND (copy = 0 OR kind = 3)),
    numbered AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i,
      rtrim(text, {space}) AS shown FROM hurt),
    marked AS (SELECT *, shown = '' AS blank,
      shown <> '' AND row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS duplicate, left(role, 1) AS initial,
      lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS before FROM numbered),
    faults AS (SELECT *, blank OR duplicate AS doomed, NOT blank AND NOT duplicate AND right(shown, 1) NOT IN ('.', '!', '?') AS cut FROM marked),
    counted AS (SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank,
      count(*) FILTER (duplicate) AS duplicate, count(*) FILTER (cut) AS truncated,
      count(*) FILTER (i > 1 AND before || initial NOT IN ('su', 'ua', 'au')) AS illegal FROM faults GROUP BY conv_id),
    costs AS (SELECT conv_id, n + 1 AS i, 0 AS g0, 4 AS g1, 2 AS g2, 0 AS g3 FROM counted UNION ALL
      SELECT conv_id, i, least(x0, 2 + x2, 4 + x3), least(x1, 2 + x2, 4 + x3), least(x2, 2 + x3), least(x3, 2 + x2) FROM (
        SELECT c.conv_id, f.i,
          least(3 + g0, CASE WHEN NOT doomed AND initial = 's' THEN cut::INT + g1 WHEN NOT doomed AND initial = 'u' THEN cut::INT + g2 ELSE 99 + g0 END, CASE WHEN doomed THEN 99 + g0 ELSE 2 + cut::INT + g2 END) AS x0,
          least(3 + g1, CASE WHEN NOT doomed AND initial = 'u' THEN cut::INT + g2 ELSE 99 + g1 END, CASE WHEN doomed THEN 99 + g1 ELSE 2 + cut::INT + g2 END) AS x1,
          least(3 + g2, CASE WHEN NOT doomed AND initial = 'a' THEN cut::INT + g3 ELSE 99 + g2 END, CASE WHEN doomed THEN 99 + g2 ELSE 2 + cut::INT + g3 END) AS x2,
          least(3 + g3, CASE WHEN NOT doomed AND initial = 'u' THEN cut::INT + g2 ELSE 99 + g3 END, CASE WHEN doomed THEN 99 + g3 ELSE 2 + cut::INT + g2 END) AS x3
        FROM costs c JOIN faults f ON f.conv_id IS NOT DISTINCT FROM c.conv_id AND f.i = c.i - 1)),
    levels AS (SELECT conv_id, i, [g0, g1, g2, g3] AS g FROM costs),
    walk AS (SELECT conv_id, 1::BIGINT AS i, 0 AS s, 0 AS step, ''::VARCHAR AS edit, NULL::VARCHAR AS role, NULL::VARCHAR AS text FROM counted UNION ALL
      SELECT conv_id, i + (edit <> 'I')::INT, CASE edit WHEN 'D' THEN s WHEN 'K' THEN CASE initial WHEN 's' THEN 1 WHEN 'u' THEN 2 ELSE 3 END ELSE given END,
        step + 1, edit, CASE edit WHEN 'D' THEN NULL WHEN 'K' THEN role ELSE CASE given WHEN 2 THEN 'user' ELSE 'assistant' END END,
        CASE edit WHEN 'D' THEN NULL WHEN 'I' THEN '' ELSE text END FROM (
        SELECT w.conv_id, w.i, w.s, w.step, f.role, f.text, f.initial, CASE w.s WHEN 2 THEN 3 ELSE 2 END AS given,
          CASE WHEN f.i IS NOT NULL AND here.g[w.s + 1] = 3 + after.g[w.s + 1] THEN 'D'
            WHEN here.g[w.s + 1] = 2 + here.g[given + 1] THEN 'I'
            WHEN f.i IS NULL THEN NULL
            WHEN NOT doomed AND (initial, w.s) IN (('s', 0), ('u', 0), ('u', 1), ('u', 3), ('a', 2))
              AND here.g[w.s + 1] = cut::INT + after.g[CASE initial WHEN 's' THEN 2 WHEN 'u' THEN 3 ELSE 4 END] THEN 'K' ELSE 'R' END AS edit
        FROM walk w JOIN levels here ON here.conv_id IS NOT DISTINCT FROM w.conv_id AND here.i = w.i
        LEFT JOIN faults f ON f.conv_id IS NOT DISTINCT FROM w.conv_id AND f.i = w.i
        LEFT JOIN levels after ON after.conv_id IS NOT DISTINCT FROM w.conv_id AND after.i = w.i + 1) WHERE edit IS NOT NULL),
    done AS (SELECT conv_id, string_agg(edit, '' ORDER BY step) AS audit, string_agg(role || ':' || text, chr(10) ORDER BY step) AS repaired FROM walk GROUP BY conv_id)
    SELECT o.conv_id, coalesce(c.gaps, 0)::BIGINT AS gaps, coalesce(c.blank, 0)::BIGINT AS blank, coalesce(c.duplicate, 0)::BIGINT AS duplicate,
      coalesce(c.truncated, 0)::BIGINT AS truncated, coalesce(c.illegal, 0)::BIGINT AS illegal, coalesce(costs.g0, 0)::BIGINT AS cost,
      coalesce(done.audit, '') AS audit, sha256(coalesce(done.repaired, '')) AS repaired_sha256
    FROM (SELECT DISTINCT conv_id FROM conversations) o
    LEFT JOIN counted c ON c.conv_id IS NOT DISTINCT FROM o.conv_id
    LEFT JOIN costs ON costs.conv_id IS NOT DISTINCT FROM o.conv_id AND costs.i = 1
    LEFT JOIN done ON done.conv_id IS NOT DISTINCT FROM o.conv_id"""
