"""Row filters of a search: group, substrings with ASCII case folding, exclusions, ranges.

A term may hold the wildcards ``%`` and ``_``; a backslash is an ordinary character.  Terms without wildcards
become ``contains``.  An empty option filters nothing.  NULL in a column that an option names drops the row, as in
SQL's three-valued logic.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadloom.functions.text import all_of, ascii_fold, fold

COLUMNS = ["message_id", "subject", "from_addr", "date_utc", "bytes", "artnum", "group_name"]


def like(c: Column, term: str) -> Column:
    """``c`` holds ``term`` somewhere, ASCII case aside."""
    term = fold(term)
    folded = ascii_fold(c)
    if "%" not in term and "_" not in term:
        return folded.contains(term)
    body = term.replace("\\", "\\\\")
    return folded.like(f"%{body}%")


def all_terms(c: Column, pattern: str) -> Column:
    """Every term of a ``%``-separated pattern occurs, in any order."""
    return all_of([like(c, t) for t in pattern.split("%") if t])


def none_of(c: Column, pattern: str) -> Column:
    """No term of a ``|``-separated pattern occurs; terms are stripped."""
    return all_of([~like(c, t.strip()) for t in pattern.split("|") if t.strip()])


def search(
    df: DataFrame,
    group: str | None = None,
    subject_like: str | None = None,
    from_like: str | None = None,
    not_subject: str | None = None,
    not_from: str | None = None,
    terms: bool = False,
) -> DataFrame:
    """The rows that meet all options, with the columns of a search; ``terms``: the two ``like`` options are lists of terms."""
    pick = all_terms if terms else like
    where = []
    if group:
        where.append(F.col("group_name") == group)
    if subject_like:
        where.append(pick(F.col("subject"), subject_like))
    if from_like:
        where.append(pick(F.col("from_addr"), from_like))
    if not_subject:
        where.append(none_of(F.col("subject"), not_subject))
    if not_from:
        where.append(none_of(F.col("from_addr"), not_from))
    keep = COLUMNS + (["ord"] if "ord" in df.columns else [])
    return df.where(all_of(where)).select(*keep)


def described(group: str | None = None, subject_like: str | None = None, from_like: str | None = None, not_subject: str | None = None, not_from: str | None = None, terms: bool = False) -> str:
    """The search as one line of SQL, for showing it."""
    quoted = lambda t: "'" + t.replace("'", "''") + "'"
    parts = [f"group_name = {quoted(group)}"] if group else []
    for column, value in (("subject", subject_like), ("from_addr", from_like)):
        for t in ([x for x in value.split("%") if x] if terms else [value]) if value else []:
            parts.append(f"{column} LIKE {quoted(f'%{t}%')}")
    for column, value in (("subject", not_subject), ("from_addr", not_from)):
        parts += [f"{column} NOT LIKE {quoted(f'%{t.strip()}%')}" for t in (value or "").split("|") if t.strip()]
    return f"SELECT {', '.join(COLUMNS)} FROM articles" + (" WHERE " + " AND ".join(parts) if parts else "")
