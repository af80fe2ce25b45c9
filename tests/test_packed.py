import random
import re
import time

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from threadloom.operators import packed
from threadloom.operators.packed import MACHINES, explode_packed, tokenize


def values(text, dialect, lanes=32):
    data = text.encode()
    row, a, b, quoted = tokenize(np.frombuffer(data, np.uint8), np.array([0, len(data)]), MACHINES[dialect], lanes)
    if dialect == "entry":
        _, a, b = packed._unquoted(np.frombuffer(data, np.uint8), row, a, b, quoted)
    return [data[x:y].decode() for x, y in zip(a, b)]


ANGLE = {
    "<a@b> <c@d>": ["<a@b>", "<c@d>"],
    '["<a@b>", "<c@d>"]': ["<a@b>", "<c@d>"],
    "'<a@b>';'<c@d>'": ["<a@b>", "<c@d>"],
    '<"x; y"@h><"p,q"@h>': ['<"x; y"@h>', '<"p,q"@h>'],
    '<"x > y"@h> <z@h>': ['<"x > y"@h>', "<z@h>"],
    '<"x \\" > y"@h>,<z@h>': ['<"x \\" > y"@h>', "<z@h>"],
    "<a@b>\r\n\t<a@b> <é@b>,": ["<a@b>", "<a@b>", "<é@b>"],
    "<open <a@b>": ["<a@b>"],
    '<"never closed@b> <c@d> <e@f>': ["<c@d>", "<e@f>"],
    "words only": [],
    "<": [],
    "": [],
}
ENTRY = {
    "Xref: host g.a:1 g.b:2": ["Xref:", "host", "g.a:1", "g.b:2"],
    'host:119 "g.a:1;g.b:2"': ["host:119", "g.a:1", "g.b:2"],
    "h;g.a:1|g.b:2, g.c:3 ": ["h", "g.a:1", "g.b:2", "g.c:3"],
    'host "g.a,x:12" g.b:2': ["host", "g.a,x:12", "g.b:2"],
    'h "g.a:1","g.b:2"': ["h", "g.a:1", "g.b:2"],
    'h"g.a:1 g.b:2"g.c:3': ["h", "g.a:1", "g.b:2", "g.c:3"],
    r'h "g \" g.a:1" g.b:2': ["h", r'g \" g.a:1', "g.b:2"],
    'h "g.a:1 g.b:2': ["h", "g.a:1", "g.b:2"],
    "h [g.a:1, g.b:2]": ["h", "g.a:1", "g.b:2"],
}
LIST = {
    'a, "b; c" | d': ["a", "b; c", "d"],
    "x(1, 2),y": ["x(1, 2)", "y"],
    "[a, b] <c d>": ["[a, b]", "<c d>"],
    'k="v, w" z': ['k="v, w"', "z"],
    "a,,b": ["a", "b"],
    "(open, a b": ["(open", "a", "b"],
    "[" * 20 + "a,b" + "]" * 20 + ",c": ["[" * 20 + "a,b" + "]" * 20, "c"],
    "[" * 300 + '"]",' + "]" * 300 + " x": ["[" * 300 + '"]",' + "]" * 300, "x"],
}


@pytest.mark.parametrize("dialect, cases", [("angle", ANGLE), ("entry", ENTRY), ("list", LIST)])
def test_dialects(dialect, cases):
    for text, want in cases.items():
        assert values(text, dialect) == want, text
        assert values(text, dialect, lanes=0) == want, "in lock-step"


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet='<>"\\ ,;ab [', max_size=14), max_size=40))
def test_lock_step_equals_one_by_one(texts):
    data = [t.encode() for t in texts]
    offsets = np.concatenate([[0], np.cumsum([len(d) for d in data])]).astype(np.int64)
    for dialect, machine in MACHINES.items():
        whole = b"".join(data)
        row, a, b, quoted = tokenize(np.frombuffer(whole, np.uint8), offsets, machine, lanes=0)
        if dialect == "entry":
            row, a, b = packed._unquoted(np.frombuffer(whole, np.uint8), row, a, b, quoted)
        got = [[whole[x:y].decode(errors="replace") for r, x, y in zip(row, a, b) if r == i] for i in range(len(texts))]
        assert got == [values(t, dialect) for t in texts]


def test_against_a_pattern(spark, rows):
    rng = random.Random(2)
    ids = [f"<{i}@h>" for i in range(20)] + ['<"a, b"@h>', '<"c;d"@h>']
    texts = ["".join(rng.choice([" ", ",", "; ", "\t", ""]) + rng.choice(ids) for _ in range(rng.randint(0, 9))) for _ in range(300)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "k bigint, v string")
    want = sorted(((i, "v", p, x) for i, t in enumerate(texts) for p, x in enumerate(re.findall(r'<(?:"[^"]*"|[^<>"])*>', t), 1)), key=repr)
    assert rows(explode_packed(df, "k", {"v": "angle"})) == want


def test_catalogue_in_memory_and_joined(spark, rows):
    df = spark.createDataFrame([(1, "<a> <b>", "h:1 g.a:1 g.x:2 g.b:3"), (2, None, "g.a:7"), (3, "", None), (4, "<a>", "g.a:x g.b:5 g.b:6")], "ord bigint, refs string, xref string")
    groups = spark.createDataFrame([("g.a",), ("g.b",), (None,), ("g.a",)], "group_name string")
    want = sorted([(1, "refs", 1, "<a>"), (1, "refs", 2, "<b>"), (1, "xref", 1, "g.a:1"), (1, "xref", 2, "g.b:3"), (4, "xref", 1, "g.b:5"), (4, "xref", 2, "g.b:6")], key=repr)
    dialects = {"refs": "angle", "xref": "entry"}
    assert rows(explode_packed(df, "ord", dialects, groups, min_values=2)) == want
    assert rows(explode_packed(df, "ord", dialects, groups, min_values=2, max_catalogue=0)) == want


def test_bad_openers_cost_one_more_pass():
    for text in ('[" ' * 20_000, '<" ' * 20_000, '<a "' * 20_000):
        for dialect in MACHINES:
            began = time.perf_counter()
            values(text, dialect)
            assert time.perf_counter() - began < 2


def test_edges(spark, rows):
    df = spark.createDataFrame([(1, "<a>" * 30_000, "x", 1), (1, "<b>", "x", 1), (None, "<c>", None, None)], "k bigint, v string, value string, pos int")
    got = explode_packed(df, "k", {"v": "angle"})
    assert got.count() == 30_002 and got.columns == ["k", "field", "pos", "value"]
    assert rows(got.where("k IS NULL")) == [(None, "v", 1, "<c>")]
    assert explode_packed(df.limit(0), "k", {"v": "angle"}).count() == 0
    assert len(packed._tokens(pa.array(["<a> <b>", None, "<c>"]).slice(1), "angle")[1]) == 1
