"""Chat formatting by a finite-state machine over roles.

A template declares the marks of turns, the roles that are trained on, and the machine: for each state the roles that may
follow and the state they lead to. A conversation is formatted turn by turn into segments, each with a loss flag; the
machine follows its roles and stays in ``ERROR`` from the first turn that it does not allow. Marks inside a text, and the
escape sign itself, get an escape sign before them, so that the output can be read back exactly.

No conversation is brought together to be formatted: its rows are dealt out in blocks of ``2 ** BLOCK_BITS`` turn numbers.
A first pass over turn numbers and roles alone makes of each block a function from the state before it to the state after
it; chained over the blocks of a conversation these give each block its first state. Texts are shuffled once, sorted in
their block, and streamed; what a task holds is one batch and one piece of output (``PIECE`` characters, or one turn).

Reading back streams over the pieces where they were made. Only conversations of several blocks are dealt out again, by
id: a digest over a whole conversation is a chain, which one task must follow, though it holds one piece at a time.

Defined results: turns are ordered by turn number (null first), then role, then text; a null role is an empty one, a null
text is empty, a null id is one conversation; repeated rows are turns of their own, which the machine rejects as any
turn out of order. Roles without a mark are written under ``other`` and read back. Conversations that the machine
rejects are formatted too and marked invalid. Texts of any length are handled row by row; an empty table gives an
empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from traceqc.llm.common import cut, table

BLOCK_BITS = 10
PIECE = 1 << 20
START, ERROR = "start", "error"


@dataclass(frozen=True)
class Template:
    """``marks`` open a turn of a role, ``end`` closes it; ``other`` opens one of a role without a mark, which stands before
    ``end_role``. ``machine`` is the table of transitions, ``final`` the states that a conversation may end in."""

    marks: dict[str, str] = field(default_factory=lambda: {"system": "### System:", "user": "### User:", "assistant": "### Assistant:"})
    other: str = "### Other:"
    end_role: str = "</role>"
    end: str = "</turn>"
    escape: str = "\\"
    trained: frozenset[str] = frozenset({"assistant"})
    machine: dict[str, dict[str, str]] = field(
        default_factory=lambda: {START: {"system": "told", "user": "asked"}, "told": {"user": "asked"}, "asked": {"assistant": "answered"}, "answered": {"user": "asked"}}
    )
    final: frozenset[str] = frozenset({"answered"})

    def __post_init__(self) -> None:
        controls = self.controls
        if len(set(controls)) < len(controls) or any(c == "" or self.escape in c for c in controls) or len(self.escape) != 1:
            raise ValueError("marks must differ, and not hold the escape sign, which is one character")
        for c in controls:
            for i in range(1, len(c)):
                for closing in (self.end, self.end_role):
                    if closing.startswith(c[i:]) or c[i:].startswith(closing):
                        raise ValueError(f"{c!r} could end inside {closing!r} after a text")

    @property
    def controls(self) -> list[str]:
        return [*self.marks.values(), self.other, self.end_role, self.end]

    @property
    def states(self) -> list[str]:
        return list(dict.fromkeys([START, ERROR, *self.machine, *(s for t in self.machine.values() for s in t.values())]))

    def step(self, state: str, role: str) -> str:
        return self.machine.get(state, {}).get(role, ERROR)

    def pattern(self) -> str:
        """Whatever is escaped in a text; the longest mark first."""
        return "|".join(re.escape(c) for c in [self.escape, *sorted(self.controls, key=len, reverse=True)])


class Writer:
    """Segments of a turn, and turns of segments."""

    def __init__(self, template: Template):
        self.template = template
        self.known = re.compile(template.pattern())
        self.token = re.compile(f"{re.escape(template.escape)}({template.pattern()})|({template.pattern()})")
        self.role = {m: r for r, m in template.marks.items()}

    def escaped(self, text: str) -> str:
        return self.known.sub(lambda m: self.template.escape + m[0], text)

    def unescaped(self, text: str) -> str:
        return self.token.sub(lambda m: m[1] or m[0], text)

    def segments(self, role: str, text: str) -> list[tuple[str, bool]]:
        t = self.template
        opening = t.marks[role] if role in t.marks else t.other + self.escaped(role) + t.end_role
        return [(opening + " ", False), (self.escaped(text), role in t.trained), (t.end + "\n", False)]

    def turns(self, text: str) -> Iterator[tuple[str, str]]:
        """(role, text) of each turn in formatted text."""
        t, at = self.template, 0
        while at < len(text):
            opening = self.mark(text, at)
            if opening.start() != at or not (opening[0] in self.role or opening[0] == t.other):
                raise ValueError(f"no turn begins at {at}")
            role, begin = self.role.get(opening[0]), opening.end()
            if role is None:
                closing = self.mark(text, begin)
                role, begin = self.unescaped(text[begin : closing.start()]), closing.end()
            closing = self.mark(text, begin + 1)
            if closing[0] != t.end:
                raise ValueError(f"a turn does not end at {closing.start()}")
            yield role, self.unescaped(text[begin + 1 : closing.start()])
            at = closing.end() + 1

    def mark(self, text: str, at: int) -> re.Match:
        """The first mark that is not escaped."""
        for m in self.token.finditer(text, at):
            if m[2] and m[2] != self.template.escape:
                return m
        raise ValueError(f"no mark after {at}")


def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """Rows of batches, one small slice of Python objects at a time."""
    for batch in batches:
        step = max(1, min(256, batch.num_rows * PIECE // max(1, batch.nbytes)))
        for at in range(0, batch.num_rows, step):
            yield from batch.slice(at, step).to_pylist()


def batched(rows: Iterator[tuple[dict, int]], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Rows with their sizes as batches of about ``PIECE``."""
    out, size = [], 0
    for row, n in rows:
        if out and (size + n > PIECE or len(out) >= 4096):
            yield pa.RecordBatch.from_pylist(out, schema)
            out, size = [], 0
        out.append(row)
        size += n
    if out:
        yield pa.RecordBatch.from_pylist(out, schema)


def turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, block, turn, role, text) without nulls in role and text."""
    filled = {c: F.coalesce(F.col(c), F.lit("")) for c in ("role", "text")}
    turn = F.col("turn").cast("long")
    return conversations.select("conv_id", F.shiftright(turn, BLOCK_BITS).alias("block"), turn.alias("turn"), *(f.alias(c) for c, f in filled.items()))


SEGMENTS = pa.list_(pa.struct([("text", pa.string()), ("loss", pa.bool_())]))
TYPES = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "boolean": pa.bool_(), "array<int>": pa.list_(pa.int32()), "array<struct<text:string,loss:boolean>>": SEGMENTS}


def described(df: DataFrame, fields: dict[str, str]) -> tuple[str, pa.Schema]:
    """The schema of rows of a conversation for Spark and for Arrow."""
    kind = df.schema["conv_id"].dataType
    return ", ".join([f"conv_id {kind.simpleString()}", *(f"{n} {t}" for n, t in fields.items())]), pa.schema([("conv_id", to_arrow_type(kind)), *((n, TYPES[t]) for n, t in fields.items())])


def first_states(rows: DataFrame, template: Template) -> DataFrame:
    """(conv_id, block, state, single): the state before each block, and whether its conversation has no other block."""
    states, place = template.states, {s: i for i, s in enumerate(template.states)}
    chain, chain_schema = described(rows, {"block": "long", "after": "array<int>"})
    entry, entry_schema = described(rows, {"block": "long", "state": "string", "single": "boolean"})

    def functions(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[dict, int]]:
        """Each block as a function of states."""
        key, after = None, states
        for r in rows_of(batches):
            if key != (r["conv_id"], r["block"]):
                if key is not None:
                    yield {"conv_id": key[0], "block": key[1], "after": [place[s] for s in after]}, 64
                key, after = (r["conv_id"], r["block"]), states
            after = [template.step(s, r["role"]) for s in after]
        if key is not None:
            yield {"conv_id": key[0], "block": key[1], "after": [place[s] for s in after]}, 64

    def entered(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[dict, int]]:
        """The state before each block, following the blocks of a conversation; one row is held back for its ``single``."""
        held, state = None, 0
        for r in rows_of(batches):
            same = held is not None and held["conv_id"] == r["conv_id"]
            if held is not None:
                yield held | {"single": held["single"] and not same}, 64
            state = state if same else place[START]
            held = {"conv_id": r["conv_id"], "block": r["block"], "state": states[state], "single": not same}
            state = r["after"][state]
        if held is not None:
            yield held, 64

    slim = rows.select("conv_id", "block", "turn", "role").repartition("conv_id", "block").sortWithinPartitions("conv_id", "block", "turn", "role")
    blocks = slim.select("conv_id", "block", "role").mapInArrow(lambda b: batched(functions(b), chain_schema), chain)
    return blocks.repartition("conv_id").sortWithinPartitions("conv_id", "block").mapInArrow(lambda b: batched(entered(b), entry_schema), entry)


def formatted(conversations: DataFrame, template: Template = Template()) -> DataFrame:
    """(conv_id, block, piece, single, n_turns, state, segments): formatted pieces in order of block and piece. ``state`` is
    the machine's after the piece; ``single`` says that the conversation has no other block."""
    rows = turns(conversations)
    none = {"turn": "long", "role": "string", "text": "string"}
    heads = first_states(rows, template).select("conv_id", "block", F.lit(0).alias("_row"), *(F.lit(None).cast(t).alias(c) for c, t in none.items()), "state", "single")
    both = heads.union(rows.select("conv_id", "block", F.lit(1), "turn", "role", "text", F.lit(None).cast("string"), F.lit(None).cast("boolean")))
    fields, schema = described(rows, {"block": "long", "piece": "int", "single": "boolean", "n_turns": "int", "state": "string", "segments": "array<struct<text:string,loss:boolean>>"})

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[dict, int]]:
        writer, piece, size, state = Writer(template), {}, 0, START
        for r in rows_of(batches):
            if r["_row"] == 0:  # a block begins; it has a turn at least
                if piece:
                    yield piece, size
                state, size = r["state"], 0
                piece = {"conv_id": r["conv_id"], "block": r["block"], "piece": 0, "single": r["single"], "n_turns": 0, "segments": []}
                continue
            if size > PIECE:
                yield piece, size
                piece, size = piece | {"piece": piece["piece"] + 1, "n_turns": 0, "segments": []}, 0
            made = writer.segments(r["role"], r["text"])
            state = template.step(state, r["role"])
            piece["segments"] += [{"text": t, "loss": loss} for t, loss in made]
            piece |= {"state": state, "n_turns": piece["n_turns"] + 1}
            size += sum(len(t) for t, _ in made)
        if piece:
            yield piece, size

    dealt = both.repartition("conv_id", "block").sortWithinPartitions("conv_id", "block", "_row", "turn", "role", "text")
    return dealt.drop("turn").mapInArrow(lambda b: batched(pieces(b), schema), fields)


class Digest:
    """What is read back of one conversation, piece by piece."""

    def __init__(self, conv_id, template: Template):
        self.conv_id, self.template, self.writer = conv_id, template, Writer(template)
        self.turns, self.trained = hashlib.sha256(), hashlib.sha256()
        self.n_turns = self.loss_chars = self.formatted_chars = 0
        self.state = START

    def read(self, segments: list[dict], state: str) -> None:
        text = "".join(s["text"] for s in segments)
        for role, said in self.writer.turns(text):
            self.turns.update(f"{role}\n{said}\n".encode())
            self.n_turns += 1
        at = 0
        for s in segments:
            if s["loss"]:
                said = self.writer.unescaped(text[at : at + len(s["text"])])
                self.trained.update(said.encode())
                self.loss_chars += len(said)
            at += len(s["text"])
        self.formatted_chars += len(text)
        self.state = state

    def row(self) -> dict:
        return {
            "conv_id": self.conv_id, "n_turns": self.n_turns, "turns_sha256": self.turns.hexdigest(), "loss_chars": self.loss_chars,
            "loss_sha256": self.trained.hexdigest(), "formatted_chars": self.formatted_chars, "valid": self.state in self.template.final,
        }


FIELDS = {"n_turns": "long", "turns_sha256": "string", "loss_chars": "long", "loss_sha256": "string", "formatted_chars": "long", "valid": "boolean"}


def read_back(pieces: DataFrame, template: Template = Template()) -> DataFrame:
    """One row a conversation, from the formatted pieces alone: number of turns, digests of all turns and of the text under
    the loss flags, its length, the length of the formatted text, and whether the machine accepts the conversation."""
    left = {"block": "long", "piece": "int", "state": "string", "segments": "array<struct<text:string,loss:boolean>>"}
    wide, wide_schema = described(pieces, FIELDS | left)
    slim, slim_schema = described(pieces, FIELDS)

    def followed(batches: Iterator[pa.RecordBatch], every: bool) -> Iterator[tuple[dict, int]]:
        """Digests of conversations that lie in one stretch of rows; pieces of others pass unless ``every`` is set."""
        digest = None
        for batch in batches:
            for at in range(batch.num_rows):
                r = batch.slice(at, 1).to_pylist()[0]
                if every or r["single"]:
                    if digest is None or digest.conv_id != r["conv_id"]:
                        if digest is not None:
                            yield digest.row(), 512
                        digest = Digest(r["conv_id"], template)
                    digest.read(r["segments"], r["state"])
                else:
                    yield {c: r[c] for c in ("conv_id", *left)}, sum(len(s["text"]) for s in r["segments"])
        if digest is not None:
            yield digest.row(), 512

    part = cut(pieces.mapInArrow(lambda b: batched(followed(b, False), wide_schema), wide))
    rest = part.where("segments is not null").select("conv_id", *left).repartition("conv_id").sortWithinPartitions("conv_id", "block", "piece")
    return part.where("segments is null").select("conv_id", *FIELDS).union(rest.mapInArrow(lambda b: batched(followed(b, True), slim_schema), slim))


#: A conversation whose texts look like the template.
PLANTED = r"select -7L conv_id, turn, role, '\\### Assistant: </turn> ok' text from values (0L, 'user'), (1L, 'assistant') t(turn, role)"


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return read_back(formatted(given.union(spark.sql(PLANTED))))


def oracle(template: Template = Template()) -> str:
    quoted = template.pattern().replace("'", "''")
    grown = "length({x}) + len(regexp_extract_all({x}, '" + quoted + "'))"
    marks = " ".join(f"when '{r}' then {len(m)}" for r, m in template.marks.items())
    opening = f"case role {marks} else {len(template.other) + len(template.end_role)} + {grown.format(x='role')} end"
    trained = "role in (" + ", ".join(f"'{r}'" for r in sorted(template.trained)) + ")"
    # the machine of the default template is told by neighbouring roles
    legal = "('', 'system'), ('', 'user'), ('system', 'user'), ('user', 'assistant'), ('assistant', 'user')"
    return f"""with c as (select conv_id, turn, coalesce(role, '') role, coalesce(text, '') text from (select conv_id, turn, role, text from conversations
  union all select -7, t, r, '\\### Assistant: </turn> ok' from (values (0, 'user'), (1, 'assistant')) v(t, r))),
o as (select *, row_number() over w k, lag(role) over w before from c window w as (partition by conv_id order by turn nulls first, role, text))
select conv_id, count(*) n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by k)) turns_sha256,
  coalesce(sum(length(text)) filter ({trained}), 0)::bigint loss_chars, sha256(coalesce(string_agg(text, '' order by k) filter ({trained}), '')) loss_sha256,
  sum({opening} + 1 + {grown.format(x='text')} + {len(template.end) + 1})::bigint formatted_chars,
  bool_and((coalesce(before, ''), role) in ({legal})) and arg_max(role, k) = 'assistant' valid
from o group by conv_id"""


ORACLE = oracle()
