"""Several values packed in one field, one value per row with its position.

A finite-state tokenizer walks the bytes of a text.  Its tables track quoting, escapes and nesting
depth; a value begins and ends where the tables say so, so a delimiter inside quotes or inside a
bracketed value never splits it.  All rows of an Arrow batch are walked in lock-step: step *t*
takes the *t*-th byte of every row that is still running with one table lookup, so the cost per byte
is that of a few numpy gathers.  When few long rows remain they are finished one at a time by the
same tables.  Nothing is shuffled: the operator is a ``mapInArrow`` behind the column-pruned scan.

Dialects:

``angle``   values are ``<...>`` with their brackets; a quoted part inside may hold any delimiter;
``entry``   values are ``name:number``; a quoted part is one value whatever delimiters it holds, unless every
            piece of it is itself such a value: then it is a list in quotes and is taken apart once more.
            Brackets and separators outside quotes only surround values;
``list``    values lie between ``, ; |`` or white space outside quotes and outside brackets; the
            quotes around a value are not part of it.

NULL and empty texts give no rows.  An unfinished bracket or quote never swallows the values after
it: the opener is skipped and the rest is read again.  Repeated values are kept.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

OTHER, SPACE, COMMA, DQUOTE, SQUOTE, LT, GT, BACKSLASH, OPEN, CLOSE = range(10)
N_CLASSES = 10
#: Events; ``TURN`` ends a value before a byte and begins the next after it.
NONE, START, END_BEFORE, END_AFTER, START_AFTER, TURN = range(6)


@dataclass(frozen=True)
class Machine:
    """Transition, event and depth tables, indexed by ``state * N_CLASSES + class``.

    ``open_end``: states in which the end of the text ends a value; ``stuck``: states in which it leaves an opener
    unmatched.  ``nested`` is the state inside brackets: its depth is a number of its own per text, without
    bound, and at depth 0 it becomes the state before it.  ``skipped``: the class that an unmatched opener gets.
    """

    step: np.ndarray
    event: np.ndarray
    depth: np.ndarray | None
    open_end: frozenset
    stuck: frozenset
    nested: int
    skipped: int


def _machine(states: int, rules: dict, open_end=(), stuck=(), nested: int = -1, skipped: int = SPACE) -> Machine:
    step = np.repeat(np.arange(states, dtype=np.uint8), N_CLASSES).reshape(states, N_CLASSES)
    event = np.zeros((states, N_CLASSES), np.uint8)
    depth = np.zeros((states, N_CLASSES), np.int32)
    for (state, classes), (to, what, *more) in rules.items():
        for c in range(N_CLASSES) if classes is None else classes:
            step[state, c], event[state, c] = to, what
            depth[state, c] = more[0] if more else 0
    return Machine(step.ravel(), event.ravel(), depth.ravel() if nested >= 0 else None, frozenset(open_end), frozenset(stuck), nested, skipped)


def _angle() -> Machine:
    out, inside, quoted, escaped = range(4)
    return _machine(
        4,
        {
            (out, (LT,)): (inside, START),
            (inside, (LT,)): (inside, START),
            (inside, (GT,)): (out, END_AFTER),
            (inside, (DQUOTE,)): (quoted, NONE),
            (quoted, (DQUOTE,)): (inside, NONE),
            (quoted, (BACKSLASH,)): (escaped, NONE),
            (escaped, None): (quoted, NONE),
        },
        stuck=(inside, quoted, escaped),
    )


def _entry() -> Machine:
    out, inside, quoted, escaped = range(4)
    return _machine(
        4,
        {
            (out, (OTHER, BACKSLASH)): (inside, START),
            (out, (DQUOTE,)): (quoted, START_AFTER),
            (inside, (SPACE, COMMA, SQUOTE, LT, GT, OPEN, CLOSE)): (out, END_BEFORE),
            (inside, (DQUOTE,)): (quoted, TURN),
            (quoted, (DQUOTE,)): (out, END_BEFORE),
            (quoted, (BACKSLASH,)): (escaped, NONE),
            (escaped, None): (quoted, NONE),
        },
        open_end=(inside,),
        stuck=(quoted, escaped),
    )


def _list() -> Machine:
    between, plain, deep, quoted, escaped, deep_quoted, deep_escaped, whole, whole_escaped = range(9)
    rules: dict = {
        (between, (OTHER, BACKSLASH, SQUOTE, GT, CLOSE)): (plain, START),
        (between, (LT, OPEN)): (deep, START, 1),
        (between, (DQUOTE,)): (whole, START_AFTER),
        (whole, (DQUOTE,)): (between, END_BEFORE),
        (whole, (BACKSLASH,)): (whole_escaped, NONE),
        (whole_escaped, None): (whole, NONE),
        (plain, (SPACE, COMMA)): (between, END_BEFORE),
        (plain, (LT, OPEN)): (deep, NONE, 1),
        (deep, (LT, OPEN)): (deep, NONE, 1),
        (deep, (GT, CLOSE)): (deep, NONE, -1),
    }
    for state, inside, after in ((plain, quoted, escaped), (deep, deep_quoted, deep_escaped)):
        rules |= {(state, (DQUOTE,)): (inside, NONE), (inside, (DQUOTE,)): (state, NONE), (inside, (BACKSLASH,)): (after, NONE), (after, None): (inside, NONE)}
    return _machine(9, rules, open_end=(plain,), stuck=(deep, quoted, escaped, deep_quoted, deep_escaped, whole, whole_escaped), nested=deep, skipped=OTHER)


MACHINES = {"angle": _angle(), "entry": _entry(), "list": _list()}

_CLASS = np.zeros(256, np.uint8)
for _chars, _c in ((b" \t\n\r\f\v", SPACE), (b",;|", COMMA), (b'"', DQUOTE), (b"'", SQUOTE), (b"<", LT), (b">", GT), (b"\\", BACKSLASH), (b"[{(", OPEN), (b"]})", CLOSE)):
    _CLASS[list(_chars)] = _c


def _classes(data: np.ndarray) -> np.ndarray:
    """The class of every byte; the bytes of non-ASCII spaces count as white space."""
    cls = _CLASS[data]
    if len(data) > 1:
        at = np.flatnonzero((data[:-1] == 0xC2) & (data[1:] == 0xA0))
        cls[at] = cls[at + 1] = SPACE
    if len(data) > 2:
        a, b, c = data[:-2], data[1:-1], data[2:]
        at = np.flatnonzero(((a == 0xE2) & (b == 0x80) & ((c <= 0x8A) | (c == 0xAF) | (c == 0xA8) | (c == 0xA9))) | ((a == 0xE3) & (b == 0x80) & (c == 0x80)))
        cls[at] = cls[at + 1] = cls[at + 2] = SPACE
    return cls


def _walk(m: Machine, cls: np.ndarray, begin: int, end: int, state: int, depth: int, row: int, events: list) -> int:
    """One text from ``begin`` on, its events added to ``events``; the state at its end."""
    step, event, change = m.step, m.event, m.depth
    for i, c in enumerate(cls[begin:end].tolist(), begin):
        code = state * N_CLASSES + c
        state = int(step[code])
        if change is not None:
            depth += int(change[code])
            if state == m.nested and depth == 0:
                state -= 1
        if event[code]:
            events.append((row, i, int(event[code])))
    return state


def tokenize(data: np.ndarray, offsets: np.ndarray, machine: Machine, lanes: int = 32) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Row, first byte, end byte of every value of the texts ``data[offsets[i]:offsets[i + 1]]``, in order, and whether it was a quoted one."""
    cls = _classes(data)
    starts, lengths = offsets[:-1], np.diff(offsets)
    order = np.argsort(-lengths, kind="stable")
    by_length, first = lengths[order], starts[order]
    running = len(order) - np.searchsorted(by_length[::-1], np.arange(by_length[0] + 1 if len(order) else 1), side="right")
    state, depth = np.zeros(len(order), np.uint8), np.zeros(len(order), np.int32)
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    t = 0
    while t < len(running) and running[t] > lanes:
        k = running[t]
        at = first[:k] + t
        code = state[:k] * np.int64(N_CLASSES) + cls[at]
        state[:k] = machine.step[code]
        if machine.depth is not None:
            depth[:k] += machine.depth[code]
            state[:k] -= (state[:k] == machine.nested) & (depth[:k] == 0)
        ev = machine.event[code]
        hit = np.flatnonzero(ev)
        if len(hit):
            found.append((order[hit], at[hit], ev[hit]))
        t += 1
    single: list[tuple[int, int, int]] = []
    for i in range(int(running[t]) if t < len(running) else 0):
        state[i] = _walk(machine, cls, int(first[i]) + t, int(first[i] + by_length[i]), int(state[i]), int(depth[i]), int(order[i]), single)
    ends = np.flatnonzero(np.isin(state, list(machine.open_end)) & (by_length > 0))
    found.append((order[ends], first[ends] + by_length[ends], np.full(len(ends), END_BEFORE, np.uint8)))
    if single:
        found.append(tuple(np.array(c) for c in zip(*single)))
    row, pos, ev = (np.concatenate([f[i] for f in found]) for i in range(3))
    sort = np.lexsort((pos, row))
    row, pos, ev = row[sort], pos[sort], ev[sort]
    stuck = np.flatnonzero(np.isin(state, list(machine.stuck)))
    if len(stuck):
        again: list[tuple[int, int, int]] = []
        sound = np.ones(len(row), bool)
        for i in stuck:
            a, b = np.searchsorted(row, [order[i], order[i] + 1])
            _recover(machine, cls, pos[a:b], ev[a:b], int(order[i]), int(first[i]), int(first[i] + by_length[i]), again)
            sound[a:b] = False
        more = [np.array(c, np.int64) for c in zip(*again)] or [np.zeros(0, np.int64)] * 3
        row, pos, ev = (np.concatenate([x[sound], y]) for x, y in zip((row, pos, ev), more))
        sort = np.lexsort((pos, row))
        row, pos, ev = row[sort], pos[sort], ev[sort]
    turn = np.flatnonzero(ev == TURN)
    if len(turn):
        ev[turn] = END_BEFORE
        row, pos, ev = np.insert(row, turn + 1, row[turn]), np.insert(pos, turn + 1, pos[turn]), np.insert(ev, turn + 1, START_AFTER)
    if not len(ev):
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, bool),)
    end = np.flatnonzero((ev[1:] >= END_BEFORE) & (ev[1:] <= END_AFTER) & ((ev[:-1] == START) | (ev[:-1] == START_AFTER)) & (row[1:] == row[:-1])) + 1
    quoted = ev[end - 1] == START_AFTER
    return row[end], pos[end - 1] + quoted, pos[end] + (ev[end] == END_AFTER), quoted


def _recover(m: Machine, cls: np.ndarray, pos: np.ndarray, ev: np.ndarray, row: int, begin: int, end: int, out: list) -> None:
    """A text (with its events ``pos`` and ``ev``) that ended inside an opener, read anew from there: the opener, quotes after it and brackets
    that never close count as ordinary bytes.  One more pass over the rest of the text, whatever it holds.
    """
    openers = np.flatnonzero((ev == START) | (ev == START_AFTER) | (ev == TURN))
    opener = int(pos[openers[-1]]) if len(openers) else begin
    out += [(row, int(p), int(e)) for p, e in zip(pos, ev) if p < opener]
    turned = len(openers) and ev[openers[-1]] == TURN
    if turned:
        out.append((row, opener, END_BEFORE))
    tail = cls[opener:end].copy()
    tail[0] = m.skipped
    tail[tail == DQUOTE] = m.skipped
    if m.depth is None:
        last = np.flatnonzero(tail == GT)
        tail[int(last[-1]) + 1 if len(last) else 0 :][tail[int(last[-1]) + 1 if len(last) else 0 :] == LT] = m.skipped
    else:
        waiting: list[int] = []
        for i in np.flatnonzero(np.isin(tail, (LT, OPEN, GT, CLOSE))).tolist():
            if tail[i] in (LT, OPEN):
                waiting.append(i)
            elif waiting:
                waiting.pop()
        tail[waiting] = m.skipped
    events: list[tuple[int, int, int]] = []
    state = _walk(m, tail, 0, end - opener, 0, 0, row, events)
    out += [(r, p + opener, e) for r, p, e in events]
    if state in m.open_end:
        out.append((row, end, END_BEFORE))


def _slices(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> pa.Array:
    lengths = end - begin
    offsets = np.zeros(len(begin) + 1, np.int64)
    np.cumsum(lengths, out=offsets[1:])
    picked = data[np.repeat(begin - offsets[:-1], lengths) + np.arange(offsets[-1])]
    return pa.Array.from_buffers(pa.large_string(), len(begin), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(picked.tobytes())]).cast(pa.string())


#: A value of the ``entry`` dialect.
ENTRY = r"^(?P<g>.+):(?P<n>[0-9]+)$"


def _tokens(column: pa.Array, dialect: str) -> tuple[np.ndarray, pa.Array]:
    """Row numbers and values of one column of a batch."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    column = pa.concat_arrays([column])
    offsets = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, column.offset * 8)
    body = column.buffers()[2]
    data = np.frombuffer(body, np.uint8) if body is not None and body.size else np.zeros(0, np.uint8)
    row, begin, end, quoted = tokenize(data, offsets, MACHINES[dialect])
    if dialect == "entry" and quoted.any():
        row, begin, end = _unquoted(data, row, begin, end, quoted)
    return row, _slices(data, begin, end)


def _unquoted(data: np.ndarray, row: np.ndarray, begin: np.ndarray, end: np.ndarray, quoted: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Quoted parts that are lists of entries throughout replaced by their pieces."""
    at = np.flatnonzero(quoted)
    length = end[at] - begin[at]
    offsets = np.concatenate([[0], np.cumsum(length)])
    inner = data[np.repeat(begin[at] - offsets[:-1], length) + np.arange(offsets[-1])]
    part, b, e, deep = tokenize(inner, offsets, MACHINES["entry"])
    good = pc.is_valid(pc.extract_regex(_slices(inner, b, e), ENTRY)).to_numpy(zero_copy_only=False) & ~deep
    whole = np.bincount(part, minlength=len(at)) == np.bincount(part[good], minlength=len(at))
    lists = whole & (np.bincount(part, minlength=len(at)) > 0)
    take = lists[part]
    shift = begin[at] - offsets[:-1]
    keep = np.ones(len(row), bool)
    keep[at[lists]] = False
    row = np.concatenate([row[keep], row[at[part[take]]]])
    begin, end = np.concatenate([begin[keep], b[take] + shift[part[take]]]), np.concatenate([end[keep], e[take] + shift[part[take]]])
    sort = np.lexsort((begin, row))
    return row[sort], begin[sort], end[sort]


def explode_packed(
    df: DataFrame,
    key: str,
    columns: dict[str, str],
    catalogue: DataFrame | None = None,
    min_values: int = 1,
    max_catalogue: int = 200_000,
    names: tuple[str, str, str] = ("field", "pos", "value"),
) -> DataFrame:
    """One row per packed value: ``key``, field, position from 1, value.

    ``columns`` maps packed columns to dialects.  ``key`` identifies a row of ``df`` and must be unique.
    ``catalogue`` (column ``group_name``) says which names an ``entry`` value may have; up to
    ``max_catalogue`` names (checked by a count) they travel with the tasks, beyond that the values are
    joined with the catalogue and numbered again by a window over the key.  A field with fewer than
    ``min_values`` values gives no rows.  Other columns of ``df`` are not read.
    """
    spark = df.sparkSession
    f_name, p_name, v_name = names
    known: list[str] | None = None
    by_join = False
    if catalogue is not None and "entry" in columns.values():
        listed = catalogue.select("group_name").where("group_name IS NOT NULL").distinct()
        by_join = listed.count() > max_catalogue
        known = None if by_join else sorted(r[0] for r in listed.collect())
    key_type = df.schema[key].dataType
    schema = T.StructType([T.StructField(key, key_type), T.StructField(f_name, T.StringType()), T.StructField(p_name, T.LongType()), T.StructField(v_name, T.StringType())])
    items = list(columns.items())
    least = 1 if by_join else min_values

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names_set = None if known is None else pa.array(known, pa.string())
        for batch in batches:
            keys = batch.column(0)
            for i, (field, dialect) in enumerate(items):
                row, value = _tokens(batch.column(i + 1), dialect)
                if dialect == "entry" and len(row):
                    parts = pc.extract_regex(value, ENTRY)
                    good = parts.is_valid()
                    if names_set is not None:
                        good = pc.and_(good, pc.is_in(pc.struct_field(parts, "g"), value_set=names_set))
                    good = pc.fill_null(good, False)
                    row, value = row[good.to_numpy(zero_copy_only=False)], value.filter(good)
                if not len(row):
                    continue
                _, begin, count = np.unique(row, return_index=True, return_counts=True)
                pos = np.arange(len(row)) - np.repeat(begin, count) + 1
                enough = np.repeat(count >= least, count)
                row, pos, value = row[enough], pos[enough], value.filter(pa.array(enough))
                if len(row):
                    yield pa.RecordBatch.from_arrays([keys.take(pa.array(row)), pa.array([field] * len(row), pa.string()), pa.array(pos.astype(np.int64)), value], names=[key, *names])

    out = df.select(key, *[F.col(f"`{c}`").cast("string") for c in columns]).where(F.coalesce(*[F.col(f"`{c}`") for c in columns]).isNotNull()).mapInArrow(run, schema)
    if not by_join:
        return out
    entries = [c for c, d in items if d == "entry"]
    group = F.when(F.col(f_name).isin(entries), F.regexp_extract(v_name, r"^(.+):[0-9]+$", 1))
    kept = out.where(~F.col(f_name).isin(entries)).unionByName(out.where(F.col(f_name).isin(entries)).withColumn("__g", group).join(listed, F.col("__g") == listed["group_name"], "left_semi").drop("__g"))
    w = Window.partitionBy(key, f_name)
    numbered = kept.withColumn("__n", F.count("*").over(w)).withColumn(p_name, F.row_number().over(w.orderBy(p_name)).cast("bigint"))
    return numbered.where(F.col("__n") >= min_values).drop("__n")
