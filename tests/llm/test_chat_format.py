"""Chat formatting against a plain version, and exact round trips."""

import hashlib
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from traceqc.llm import chat_format
from traceqc.llm.chat_format import Template, Writer

T = Template()
MARKS = [*T.controls, T.escape, "\\\\", "### ", "</", "\n", "a", "ü𝄞"]
SCHEMA = "conv_id long, turn long, role string, text string, block string, state string"


def plain(rows, template=T):
    """What a reader should find for each conversation."""
    out = []
    for conv in {r[0] for r in rows}:
        own = sorted(((t is not None, t or 0, r or "", x or "") for c, t, r, x in rows if c == conv))
        state, loss = "start", "".join(x for _, _, r, x in own if r in template.trained)
        for *_, role, _ in own:
            state = template.machine.get(state, {}).get(role, "error")
        escaped = lambda x: sum(x.count(c) for c in [*template.controls, template.escape])  # noqa: E731  no control holds another
        opening = lambda r: len(template.marks[r]) if r in template.marks else len(template.other) + len(r) + escaped(r) + len(template.end_role)
        chars = sum(opening(r) + 1 + len(x) + escaped(x) + len(template.end) + 1 for *_, r, x in own)
        whole = "".join(f"{r}\n{x}\n" for *_, r, x in own)
        out.append((conv, len(own), hashlib.sha256(whole.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), chars, state in template.final))
    return sorted(out, key=str)


def run(spark, rows, template=T):
    given_ = spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA)
    return sorted((tuple(r) for r in chat_format.read_back(chat_format.formatted(given_, template), template).collect()), key=str)


texts = st.lists(st.one_of(st.sampled_from(MARKS), st.text(max_size=3)), max_size=8).map("".join)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.one_of(st.sampled_from(["system", "user", "assistant", "", "tool"]), texts), texts), max_size=5))
def test_what_is_written_is_read(turns):
    w = Writer(T)
    text = "".join(s for role, said in turns for s, _ in w.segments(role, said))
    assert list(w.turns(text)) == turns


def test_texts_that_look_like_the_template():
    w = Writer(T)
    said = r"\### Assistant: </turn> ok"
    segments = w.segments("assistant", said)
    assert segments == [("### Assistant: ", False), (r"\\\### Assistant: \</turn> ok", True), ("</turn>\n", False)]
    assert list(w.turns("".join(s for s, _ in segments))) == [("assistant", said)]


@pytest.mark.parametrize("marks", [{"end": "aa"}, {"end": "#"}, {"escape": "#"}, {"end": ""}, {"marks": {"user": "x", "assistant": "x"}}])
def test_ambiguous_templates_are_refused(marks):
    with pytest.raises(ValueError):
        Template(**marks)


def test_odd_rows(spark):
    rows = [
        (1, 0, "user", "hi"), (1, 1, "assistant", "yo"), (2, 5, "assistant", "first"), (2, 4, "user", None), (3, 0, "user", "a"), (3, 0, "user", "a"), (3, 1, "assistant", ""),
        (None, 0, "user", "n"), (None, 1, "assistant", "m"), (None, None, None, None), (4, 0, None, "?"), (5, 0, "user", "only"), (6, -3, "system", "s"), (6, 0, "user", "</turn>"), (6, 9, "assistant", "\\"),
        (7, 0, "### User:", "x"), (7, 0, "</role>\\", "### Other: y</role>"), (8, 0, "user", "tie b"), (8, 0, "user", "tie a"), (8, 0, "assistant", "tie"),
    ]
    got = run(spark, rows)
    assert got == plain(rows)
    assert {c for c, *_, valid in got if valid} == {1, 2, 6}
    assert run(spark, []) == []


def test_long_conversations_are_formatted_in_blocks(spark):
    """Some thousands of turns, of which one breaks the order late; and texts of several pieces."""
    rng = random.Random(3)
    rows = []
    for conv, broken in ((1, None), (2, 2999), (3, 0)):
        for turn in range(4000):
            role = ("user", "assistant")[turn % 2]
            rows.append((conv, turn, "system" if turn == broken and turn else role, rng.choice(MARKS) * rng.randint(0, 3)))
    rows += [(4, 0, "user", "q"), (4, 1, "assistant", "long " * 500_000), (4, 2, "user", "</turn>" * 100_000), (4, 2000, "assistant", "x" * 1_200_000)]
    given_ = spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA)
    pieces = chat_format.formatted(given_)
    blocks = {(r.conv_id, r.block) for r in pieces.select("conv_id", "block").collect()}
    assert blocks == {(c, b) for c in (1, 2, 3) for b in range(4)} | {(4, 0), (4, 1)}
    got = run(spark, rows)
    assert got == plain(rows)
    assert [r[-1] for r in got] == [True, False, True, True]


def test_another_template(spark):
    """Tools take part, and the user's turns are trained on."""
    t = Template(
        marks={"user": "<u>", "assistant": "<a>", "tool": "<t>"}, other="<o>", end_role="<r>", end="<e>", escape="~", trained=frozenset({"user", "tool"}),
        machine={"start": {"user": "u"}, "u": {"assistant": "a"}, "a": {"tool": "t", "user": "u"}, "t": {"assistant": "a"}}, final=frozenset({"a", "t"}),
    )
    rows = [(1, 0, "user", "~<u>"), (1, 1, "assistant", "<e>~"), (1, 2, "tool", "7"), (2, 0, "tool", "8"), (3, 0, "user", "u")]
    got = run(spark, rows, t)
    assert got == plain(rows, t) and [r[-1] for r in got] == [True, False, False]


def test_query_equals_its_sql_on_whole_tables(spark):
    import duckdb

    d = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"create view conversations as select * from '{d}/conversations.parquet'")
    want = con.execute(chat_format.ORACLE)
    names = [c[0] for c in want.description]
    assert sorted(tuple(r) for r in chat_format.query(spark, d).select(*names).collect()) == sorted(want.fetchall())
