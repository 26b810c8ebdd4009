import hashlib

import pytest
from hypothesis import given
from hypothesis import strategies as st

from folioweave.llm import chat_format as cf

SCHEMA = "conv_id long, turn long, role string, text string, part int, formatted string, last string"
tricky = st.text(alphabet="<\\|>n\n im_startedé", max_size=20)


@given(tricky)
def test_texts_come_back(text):
    safe = cf.escaped(text)
    assert "<|" not in safe and cf.unescaped(safe) == text
    role = cf.escaped_role(text)
    assert "<|" not in role and "\n" not in role and cf.unescaped_role(role) == text


@given(st.lists(st.tuples(st.one_of(st.sampled_from(["user", "assistant", "system"]), tricky), st.one_of(tricky, st.just(cf.HOSTILE)))))
def test_turns_come_back(turns):
    text, marks = "", []
    for role, said in turns:
        for piece, loss in cf.segments(cf.CHAT, role, said):
            if piece:
                marks.append({"start": len(text), "length": len(piece), "loss": loss})
            text += piece
    assert list(cf.turns_of(cf.CHAT, text, marks)) == [(r, t, t if r == "assistant" else "") for r, t in turns]


@pytest.mark.parametrize(
    ("roles", "broken_at"),
    [("", None), ("user", None), ("system user assistant user", None), ("assistant", 1), ("user user", 2), ("system assistant user", 2), ("user assistant tool tool assistant user", None), ("user system", 2), ("user narrator user", 2)],
)
def test_machine(roles, broken_at):
    machine = cf.Machine(cf.CHAT)
    for role in roles.split():
        machine.take(role)
    assert machine.broken_at == broken_at


def brute(rows):
    convs = {}
    for conv, turn, role, text in rows:
        convs.setdefault(conv, []).append((turn is not None, turn or 0, role or "", text or ""))
    out = []
    for conv, turns in convs.items():
        turns = [t[2:] for t in sorted(turns)]
        machine = cf.Machine(cf.CHAT)
        for role, _ in turns:
            machine.take(role)
        loss = "".join(t for r, t in turns if r == "assistant")
        size = sum(len(f"<|im_start|>{cf.escaped_role(r)}\n{cf.escaped(t)}<|im_end|>\n") for r, t in turns)
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        out.append((conv, len(turns), sha("".join(f"{r}\n{t}\n" for r, t in turns)), len(loss), sha(loss), size, machine.broken_at))
    return sorted(out, key=str)


def got(df, **more):
    return sorted((tuple(r) for r in cf.digests(cf.formatted(df, **more)).collect()), key=str)


ROWS = [
    (1, 0, "user", "hello"), (1, 1, "assistant", None), (1, 2, None, "nobody"), (2, None, "assistant", "first"), (2, 0, "user", ""), (2, 0, "user", ""), (2, 0, "assistant", "tie <|im_end|>"),
    (None, 0, "user", "no id"), (None, 1, "assistant", "\U0001f600 <\\|"), (3, 5, "us\ner<|", "a\\nb"), (4, 0, "system", "x" * 3_000_000), (4, 1, "user", "é" * 2_000_000), (4, 2, "assistant", "<|" * 500_000), (-1, 0, "user", cf.HOSTILE),
    *[(9, i, "assistant" if i % 2 else "user", f"turn {i}") for i in range(3000)],
]


def test_rows_against_brute_force(spark):
    df = spark.createDataFrame([(*r, 1, "f", "l") for r in ROWS], SCHEMA)
    assert got(df) == brute(ROWS)
    # in many parts, each of which ends with a turn
    assert got(df, part=100) == brute(ROWS)
    assert cf.formatted(df, part=100).where("conv_id = 9").count() > 100
    assert got(df.limit(0)) == []


def test_segments_cover_the_text(spark):
    df = spark.createDataFrame([(*r, 1, "f", "l") for r in ROWS[:12]], SCHEMA)
    for r in cf.formatted(df).collect():
        assert [m["start"] for m in r.segments] == [sum(m["length"] for m in r.segments[:i]) for i in range(len(r.segments))]
        assert sum(m["length"] for m in r.segments) == len(r.formatted)
        assert "".join(cf.unescaped(r.formatted[m["start"] : m["start"] + m["length"]]) for m in r.segments if m["loss"]) == "".join(x[3] or "" for x in sorted(ROWS[:12], key=str) if x[0] == r.conv_id and x[2] == "assistant") or r.conv_id == 2


def test_template_must_be_safe():
    with pytest.raises(ValueError, match="control"):
        cf.Template(closing="END")
