"""Column functions on subjects, posters and message ids.  All are JVM expressions.

Patterns follow Unicode: digits, white space and word borders of any script count.  NULL in gives NULL out
unless a function says otherwise.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space, with the four separators that Java's Unicode class leaves out.
WS = r"[\s\x1c-\x1f]"
# Part counters, and the endings of file names.
BRACKET = r"[(\[{](\d+)/(\d+)[)\]}]"
PART_OF = rf"\bpart{WS}+(\d+){WS}+of{WS}+(\d+)\b"
#: What a collection's name leaves out, in this order: counters, numbers in brackets, quoted names, endings, sizes, what follows a free-standing
#: dash or point; then quotes, the encoding mark, file counters, punctuation, and numbers at the end.
COUNTERS = rf"{WS}*[\[(]\d+/\d+[\])]{WS}*"
IN_BRACKETS = (rf"{WS}*\[\d+\]{WS}*", rf"{WS}*\(\d+\){WS}*")
QUOTED = r'"[^"]*"'
SIZES = rf"\d+\.?\d*{WS}*(?:kb|mb|gb|bytes?)\b"
REST = rf"{WS}+[-.]{WS}+.*$"
ENCODING_MARK = rf"{WS}*yEnc{WS}*"
FILE_OF = rf"{WS}*-?{WS}*File{WS}+\d+{WS}+of{WS}+\d+{WS}*-?{WS}*"
PUNCTUATION = r"[&\-\\/,.:;!?(){}\[\]]"
NUMBERS_AT_END = rf"(?:{WS}|[\d_])+$"
ENDINGS = "jpg jpeg png gif bmp tif tiff rar zip r\\d+ par2? nfo sfv txt diz mkv avi mp4 wmv mov mpg mpeg flv webm m4v".split()


def strip(c: Column) -> Column:
    return F.regexp_replace(c, rf"(?U)^{WS}+|{WS}+$", "")


def subject_base(subject: Column) -> Column:
    """The subject without counters and without the encoding mark, outer white space stripped."""
    s = F.regexp_replace(subject, "(?U)" + BRACKET, "")
    s = F.regexp_replace(s, "(?iU)" + PART_OF, "")
    return strip(F.regexp_replace(s, r"(?iU)\byEnc\b", ""))


def _counter(subject: Column, which: int, last: bool) -> Column:
    # A greedy prefix leads to the last counter: counters can't overlap.
    lead = "^.*" if last else ""
    pick = lambda flags, p: F.nullif(F.regexp_extract(subject, flags + lead + p, which), F.lit("")).try_cast("bigint")
    bracket, words = pick("(?sU)", BRACKET), pick("(?siU)", PART_OF)
    return F.when(subject.rlike("(?U)" + BRACKET), bracket).otherwise(words)


def counter_left(subject: Column) -> tuple[Column, Column]:
    """Number and total of the first bracket counter, else of the first ``part n of m``, else NULL (also beyond 18 digits)."""
    return _counter(subject, 1, False), _counter(subject, 2, False)


def counter_right(subject: Column) -> tuple[Column, Column]:
    """The same of the last counter; brackets still come before ``part n of m``."""
    return _counter(subject, 1, True), _counter(subject, 2, True)


def message_id_text(mid: Column) -> Column:
    """The id without its angle brackets if it has both; NULL and empty give the empty text."""
    return F.regexp_replace(strip(F.coalesce(mid, F.lit(""))), r"(?s)^<(.*)>$", "$1")


def sanitize_filename(c: Column) -> Column:
    return F.regexp_replace(c, r"[^\p{L}\p{N} _-]", "_")


def clean_text(s):
    """A Python text without code points that UTF-8 can't hold; anything else as it is."""
    return s.encode("utf-8", "ignore").decode("utf-8") if isinstance(s, str) else s


def _literal(term: str) -> str:
    return "".join(ch if ch.isalnum() or ord(ch) > 127 else "\\" + ch for ch in term)


def collection_name(subject: Column, search: str | None = None) -> Column:
    """The name under which posts of one collection meet: counters, quoted names, endings, sizes, everything after a
    free-standing dash or point, the terms of ``search`` (separated by %), punctuation and trailing numbers go; at most 100 characters."""
    s = F.coalesce(subject, F.lit(""))

    def cut(pattern: str, to: str, flags: str = "(?U)") -> None:
        nonlocal s
        s = F.regexp_replace(s, flags + pattern, to)

    for pattern in (COUNTERS, *IN_BRACKETS):
        cut(pattern, " ")
    cut(QUOTED, "")
    cut(rf"\.(?:{'|'.join(ENDINGS)})({WS}|$)", " ", "(?iU)")
    cut(SIZES, "", "(?iU)")
    s = strip(F.regexp_replace(s, "(?sU)" + REST, ""))
    for term in (search or "").split("%"):
        if term.strip():
            cut(_literal(term.strip()), "", "(?iu)")
    cut("[\"']", "")
    cut(ENCODING_MARK, " ", "(?iU)")
    cut(FILE_OF, " ", "(?iU)")
    cut(PUNCTUATION, " ")
    n = F.length(s)
    head = F.when(n > 10, F.substring(s, F.lit(1), n - 10)).otherwise(F.lit(""))
    tail = F.when(n > 10, F.substring(s, n - 9, F.lit(10))).otherwise(s)
    s = F.concat(head, F.translate(tail, "_", " "))
    cut(NUMBERS_AT_END, "")
    s = strip(F.regexp_replace(s, rf"(?U){WS}+", " "))
    return strip(F.substring(s, 1, 100))


def file_base(poster: Column, collection: Column) -> Column:
    """Base of a manifest's file name: poster and collection, each cut to 50 characters."""
    name = F.when(collection == "", "misc").otherwise(collection)
    return F.concat_ws("_", sanitize_filename(F.substring(poster, 1, 50)), sanitize_filename(F.substring(name, 1, 50)))


def ascii_fold(c: Column) -> Column:
    """ASCII capitals as small letters; no other letter changes."""
    upper = "".join(chr(x) for x in range(65, 91))
    return F.translate(c, upper, upper.lower())


def fold(term: str) -> str:
    return "".join(ch.lower() if ch.isascii() else ch for ch in term)


def all_of(parts: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, parts, F.lit(True))
