r"""Chat formatting with a grammar round trip.

Grammar of a formatted conversation (a concatenation of turns)::

    turn   := opener text closer
    system := "<<SYS>>\n" text "\n<</SYS>>\n"
    user   := "[INST] " text " [/INST]"
    assistant := "<s>" text "</s>"
    other  := "[ROLE " role "]" text "[/ROLE]"

A backslash in text or role stands before the character it keeps literal. The parser
is deterministic: an opener decides the kind of a turn, and the turn ends at the
first closer that no backslash guards. A turn is written as it is, parsed and compared with its source;
if they differ, conflicting content is escaped, step by step
(backslashes; then every control string too), until both are identical.

The loss mask covers the text of assistant turns, as spans of the formatted conversation.

Turns are written where they are read, spread over the cluster. A conversation is the
written turns in order; a task streams them from a sort into a parser that
gets text only, not where turns begin or end (`Reader`). It holds what it hasn't parsed yet and
running hashes, however long the conversation.

Defined cases: a null text is an empty one, a null role the role ""; turns
are ordered by (turn, role, text), null turns first; repeated rows are turns of
their own; a null conv_id is a conversation of its own.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Opener and closer of the named roles. Fixed values.
MARKS = {"system": ("<<SYS>>\n", "\n<</SYS>>\n"), "user": ("[INST] ", " [/INST]"), "assistant": ("<s>", "</s>")}
OTHER = ("[ROLE ", "]", "[/ROLE]")
_CONTROLS = re.compile(r"<<SYS>>|<</SYS>>|\[INST\]|\[/INST\]|<s>|</s>|\[ROLE |\[/ROLE\]")


def _until(text: str, at: int, closer: str) -> tuple[str, int] | None:
    """What stands at `at` before the first unguarded `closer`, unescaped, and where it ends."""
    out: list[str] = []
    while True:
        end = text.find(closer, at)
        guard = text.find("\\", at, end if end >= 0 else len(text))
        if guard < 0:
            if end < 0:
                return None
            out.append(text[at:end])
            return "".join(out), end
        if guard + 1 >= len(text):
            return None
        out.append(text[at:guard])
        out.append(text[guard + 1])
        at = guard + 2


def parse_turn(text: str, at: int = 0) -> tuple[str, str, int, int, int] | None:
    """(role, text, begin and end of the written text, end of the turn) of the turn at `at`, if one is there."""
    for role, (opener, closer) in MARKS.items():
        if text.startswith(opener, at):
            begin = at + len(opener)
            found = _until(text, begin, closer)
            return None if found is None else (role, found[0], begin, found[1], found[1] + len(closer))
    if text.startswith(OTHER[0], at):
        role = _until(text, at + len(OTHER[0]), OTHER[1])
        if role is not None:
            begin = role[1] + len(OTHER[1])
            found = _until(text, begin, OTHER[2])
            if found is not None:
                return role[0], found[0], begin, found[1], found[1] + len(OTHER[2])
    return None


def parse(text: str) -> list[tuple[str, str]] | None:
    """The (role, text) turns of a whole formatted conversation; None if it isn't one."""
    at, turns = 0, []
    while at < len(text):
        turn = parse_turn(text, at)
        if turn is None:
            return None
        turns.append(turn[:2])
        at = turn[4]
    return turns


def escape(text: str, step: int) -> str:
    """`text` as it is (0), with its backslashes guarded (1), with the first character of each control string too (2), or all of it (3)."""
    if step == 0:
        return text
    if step == 3:
        return re.sub(r"(.)", r"\\\1", text, flags=re.S)
    text = text.replace("\\", "\\\\")
    return text if step == 1 else _CONTROLS.sub(lambda m: "\\" + m[0], text)


def render_turn(role: str, text: str) -> str:
    """The turn written with the least escaping that parses back to it."""
    for step in range(4):
        if role in MARKS:
            opener, closer = MARKS[role]
            out = opener + escape(text, step) + closer
        else:
            name = escape(role, 3) if step or "]" in role or "\\" in role else role
            out = OTHER[0] + name + OTHER[1] + escape(text, step) + OTHER[2]
        if (back := parse_turn(out)) and back[:2] == (role, text) and back[4] == len(out):
            return out
    raise ValueError("a turn doesn't parse back")


class Reader:
    """Parses a formatted conversation that arrives in pieces, cut anywhere."""

    def __init__(self):
        self.text, self.begin = "", 0

    def feed(self, text: str) -> list[tuple[str, str, int, int]]:
        """(role, text, begin and end of the written text in the whole conversation) of each turn that is complete now.

        A turn ends at the first unguarded closer, so what follows can't change it.
        """
        self.text += text
        at, turns = 0, []
        while at < len(self.text) and (turn := parse_turn(self.text, at)):
            turns.append((*turn[:2], self.begin + turn[2], self.begin + turn[3]))
            at = turn[4]
        self.text, self.begin = self.text[at:], self.begin + at
        return turns

    def end(self) -> None:
        if self.text:
            raise ValueError("not a formatted conversation")


def rendered(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, piece, text_begin, text_end): each turn written out, and where its text stands in the piece.

    The formatted conversation is its pieces in order.
    """

    def run(batches):
        for batch in batches:
            roles = [r or "" for r in batch.column("role").to_pylist()]
            pieces = [render_turn(r, t or "") for r, t in zip(roles, batch.column("text").to_pylist(), strict=True)]
            spans = [parse_turn(p)[2:4] for p in pieces]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("conv_id"), batch.column("turn"), pa.array(roles, pa.string()), pa.array(pieces, pa.string()),
                    pa.array([s[0] for s in spans], pa.int32()), pa.array([s[1] for s in spans], pa.int32()),
                ],
                ["conv_id", "turn", "role", "piece", "text_begin", "text_end"],
            )

    kinds = {f.name: f.dataType.simpleString() for f in conversations.schema}
    schema = f"conv_id {kinds['conv_id']}, turn {kinds['turn']}, role string, piece string, text_begin int, text_end int"
    return conversations.select("conv_id", "turn", "role", "text").mapInArrow(run, schema)


def _in_order(conversations: DataFrame) -> DataFrame:
    """(conv_id, piece, mask_begin, mask_end): the pieces of each conversation in one partition, in order of (turn, role, text)."""
    pieces = rendered(conversations).repartition("conv_id")
    written = F.substring(F.col("piece"), F.col("text_begin") + 1, F.col("text_end") - F.col("text_begin"))
    text = F.regexp_replace(written, r"(?s)\\(.)", "$1")
    masked = lambda c: F.when(F.col("role") == "assistant", F.col(c))
    return pieces.sortWithinPartitions("conv_id", "turn", "role", text).select(
        "conv_id", "piece", masked("text_begin").alias("mask_begin"), masked("text_end").alias("mask_end")
    )


def _folded(conversations: DataFrame, names: dict[str, tuple[str, pa.DataType]], start) -> DataFrame:
    """The rows that ``start(conv_id)`` makes of each conversation: of ``add(piece, begin, end)`` and at last of ``finish()``."""
    kind = next(f.dataType.simpleString() for f in conversations.schema if f.name == "conv_id")

    def run(batches):
        now, done, id_type = None, [], None

        def flush():
            columns = list(zip(*done, strict=True)) or [()] * (1 + len(names))
            done.clear()
            types = [id_type, *(t for _, t in names.values())]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["conv_id", *names])

        for batch in batches:
            id_type = batch.schema.field("conv_id").type
            for conv_id, piece, begin, end in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if now is None or now.conv_id != conv_id:
                    if now is not None:
                        done += now.finish()
                    now = start(conv_id)
                done += now.add(piece, begin, end)
                if len(done) >= 4096:
                    yield flush()
        if now is not None:
            done += now.finish()
        if done:
            yield flush()

    schema = ", ".join([f"conv_id {kind}", *(f"{name} {spark_type}" for name, (spark_type, _) in names.items())])
    return _in_order(conversations).mapInArrow(run, schema)


class _Digest:
    """Running digests of one conversation, parsed again from its formatted text."""

    def __init__(self, conv_id):
        self.conv_id, self.turns, self.loss_chars, self.chars = conv_id, 0, 0, 0
        self.all, self.loss, self.reader = hashlib.sha256(), hashlib.sha256(), Reader()

    def add(self, piece: str, begin: int | None, end: int | None) -> list[tuple]:
        for role, text, *_ in self.reader.feed(piece):
            self.turns += 1
            self.all.update(f"{role}\n{text}\n".encode())
        self.chars += len(piece)
        if begin is not None:
            masked = re.sub(r"\\(.)", r"\1", piece[begin:end], flags=re.S)
            self.loss_chars += len(masked)
            self.loss.update(masked.encode())
        return []

    def finish(self) -> list[tuple]:
        self.reader.end()
        return [(self.conv_id, self.turns, self.all.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars)]


def digests(conversations: DataFrame) -> DataFrame:
    """One row for each conversation, read back from its formatted text."""
    names = {
        "n_turns": ("bigint", pa.int64()), "turns_sha256": ("string", pa.string()), "loss_chars": ("bigint", pa.int64()),
        "loss_sha256": ("string", pa.string()), "formatted_chars": ("bigint", pa.int64()),
    }
    return _folded(conversations, names, _Digest)


class _Parts:
    """The formatted text of a conversation in parts of whole turns, with the loss mask of each."""

    def __init__(self, conv_id, most: int):
        self.conv_id, self.most, self.part, self.begin = conv_id, most, 0, 0
        self.pieces: list[str] = []
        self.size, self.mask = 0, []

    def add(self, piece: str, begin: int | None, end: int | None) -> list[tuple]:
        out = self.finish() if self.pieces and self.size + len(piece) > self.most else []
        if begin is not None:
            self.mask.append({"begin": self.size + begin, "end": self.size + end})
        self.pieces.append(piece)
        self.size += len(piece)
        return out

    def finish(self) -> list[tuple]:
        row = (self.conv_id, self.part, self.begin, "".join(self.pieces), self.mask)
        self.part, self.begin = self.part + 1, self.begin + self.size
        self.pieces, self.size, self.mask = [], 0, []
        return [row]


def formatted(conversations: DataFrame, most: int = 1 << 20) -> DataFrame:
    """(conv_id, part, begin, text, mask): the formatted conversations and the spans of their texts under the loss mask.

    A conversation of over `most` characters comes in parts of whole turns, numbered from 0, `begin` characters from its start.
    """
    span = pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))
    names = {
        "part": ("bigint", pa.int64()), "begin": ("bigint", pa.int64()), "text": ("string", pa.string()),
        "mask": ("array<struct<begin:bigint,end:bigint>>", span),
    }
    return _folded(conversations, names, lambda conv_id: _Parts(conv_id, most))


def op9_query(conversations: DataFrame) -> DataFrame:
    told = conversations.select("conv_id", "turn", "role", "text")
    hard = "</s>[INST] ok [/INST]"
    extra = told.sparkSession.createDataFrame([(-1, 0, "user", hard), (-1, 1, "assistant", hard)], "conv_id bigint, turn bigint, role string, text string")
    return digests(told.unionByName(extra.select([F.col(f.name).cast(f.dataType) for f in told.schema])))


def _op9_sql() -> str:
    quoted = lambda t: "'" + t.replace("'", "''") + "'"
    line = lambda t: quoted(t).replace("\n", "' || chr(10) || '")
    closer = " ".join(f"WHEN {quoted(r)} THEN {line(c)}" for r, (_, c) in MARKS.items())
    opener = " ".join(f"WHEN {quoted(r)} THEN {len(o)}" for r, (o, _) in MARKS.items())
    hard = quoted("</s>[INST] ok [/INST]")
    return f"""
WITH told AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', {hard} UNION ALL SELECT -1, 1, 'assistant', {hard}),
marked AS (SELECT *, CASE role {closer} ELSE {quoted(OTHER[2])} END AS closer, CASE role {opener} ELSE {len(OTHER[0]) + len(OTHER[1])} + length(role) END AS opener FROM told),
counted AS (SELECT *, length(text) - length(replace(text, chr(92), '')) AS guards, len(regexp_extract_all(text, {quoted(_CONTROLS.pattern)})) AS controls,
  instr(text || closer, closer) = length(text) + 1 AS plain FROM marked),
sized AS (SELECT *, opener + length(text) + length(closer) + guards + CASE WHEN plain THEN 0 ELSE controls END AS chars FROM counted)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256, sum(chars)::BIGINT AS formatted_chars
FROM sized GROUP BY conv_id
"""


#: The same in SQL, for roles without brackets or backslashes: a turn is escaped where its closer would come too early.
OP9_SQL = _op9_sql()
