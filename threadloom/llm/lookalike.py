"""Visually identical text with different characters, brought to one form.

Only words that hold an unusual character leave the scan: full-width forms, separate combining marks,
invisible characters, non-breaking spaces, or letters of more than one script.  Their distinct values
are mapped letter by letter to the script that the rest of the word is written in, and the mapped
values are grouped in SQL under the accent-sensitive collation ``UNICODE``, where composed and
decomposed spellings are equal and accents are not ignored.  Each class gets one canonical member: the
composed spelling, then the one most often met, then the least by bytes.  The canonical member is
joined back to the words and the texts are put together again.  A kind of unusual writing is what a word has and its canonical
member has not.  Texts without such words are passed through untouched by any shuffle.

The look-alike letters are a fixed list of the strongest, and beyond it all letters that the Unicode confusables give the
same skeleton as a Latin letter; these data come with Spark's collations.  A word wholly in one script stays as it is.  NULL
and empty texts stay as they are.
"""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from threadloom.session import checkpoint

# Look-alike letters of other scripts (and the one-storey g) and the Latin letter each is taken for.
LATIN_FOR = {
    # Cyrillic, small
    "а": "a", "с": "c", "ԁ": "d", "е": "e", "һ": "h", "і": "i", "ј": "j", "ӏ": "l", "о": "o", "р": "p", "ԛ": "q",
    "ѕ": "s", "у": "y", "х": "x", "ԝ": "w", "ѵ": "v", "ү": "y",
    # Cyrillic, capital
    "А": "A", "В": "B", "С": "C", "Е": "E", "Н": "H", "І": "I", "Ј": "J", "К": "K", "М": "M", "О": "O", "Р": "P",
    "Ѕ": "S", "Т": "T", "У": "Y", "Х": "X", "Ԁ": "D", "Ԛ": "Q", "Ԝ": "W", "Ѵ": "V", "Ү": "Y", "Ӏ": "I",
    # Greek
    "ο": "o", "ν": "v", "α": "a", "ι": "i", "ρ": "p", "υ": "u", "κ": "k", "χ": "x", "γ": "y", "ϲ": "c", "ϳ": "j",
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P",
    "Τ": "T", "Υ": "Y", "Χ": "X",
    # Armenian
    "օ": "o", "ո": "n", "ս": "u", "հ": "h", "զ": "q", "ց": "g", "յ": "j", "Օ": "O", "Տ": "S", "Ս": "U", "Լ": "L",
    # Latin letters drawn like other Latin letters
    "ɡ": "g", "ɑ": "a", "ı": "i",
}
# Latin letters and the Cyrillic or Greek letter each stands in for.
CYRILLIC_FOR = dict(zip("aceopxyiABCEHKMOPTXY", "асеорхуіАВСЕНКМОРТХУ"))
GREEK_FOR = dict(zip("ovaiABEZHIKMNOPTYX", "οναιΑΒΕΖΗΙΚΜΝΟΡΤΥΧ"))

# Characters without width (the default-ignorable ones that are no letters), variation selectors, and spaces at which
# no line may break.
INVISIBLE = "\u00ad\u034f\u061c\u180e\u200b-\u200f\u202a-\u202e\u2060-\u206f\ufeff\ufff0-\ufff8\U0001bca0-\U0001bca3\U0001d173-\U0001d17a\U000e0000-\U000e00ff\U000e01f0-\U000e0fff"
SELECTOR = "\u180b-\u180d\u180f\ufe00-\ufe0f\U000e0100-\U000e01ef"
HARD_SPACE = "\u00a0\u2007\u202f"
FULLWIDTH = "\uff01-\uff5e"

# Letter ranges as regular-expression classes, and marks that are written apart from Latin, Greek or Cyrillic letters.
_LETTERS = {"latin": "A-Za-z\u00aa\u00ba\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f\u0250-\u02af\u1e00-\u1eff", "cyrillic": "\u0400-\u052f", "greek": "\u0370-\u03ff\u1f00-\u1fff", "armenian": "\u0530-\u058f"}
_MARK = "\u0300-\u034e\u0350-\u036f\u1ab0-\u1aff\u1dc0-\u1dff\u20d0-\u20ff\ufe20-\ufe2f"
_OTHER = "".join(_LETTERS[s] for s in ("cyrillic", "greek", "armenian"))
#: Blocks whose letters are drawn like Latin ones and rarely met beside them: Cherokee, Lisu, letter-like and mathematical signs.
_RARE = "\u13a0-\u13ff\uab70-\uabbf\ua4d0-\ua4ff\u2100-\u214f\U0001d400-\U0001d7ff"
_OWN_LATIN = "ɡɑı"


def _composing() -> dict[str, str]:
    """The other marks with which letters have one composed form, and these letters (elsewhere such marks are ordinary writing)."""
    before: dict[str, set[str]] = {}
    for c in map(chr, range(0x370, 0x12000)):
        parts = unicodedata.decomposition(c).split()
        if len(parts) == 2 and not parts[0].startswith("<") and unicodedata.normalize("NFC", c) == c:
            base, mark = (chr(int(x, 16)) for x in parts)
            if unicodedata.category(mark)[0] == "M" and not re.match(f"[{_MARK}]", mark):
                before.setdefault(mark, set()).add(base)
    return {m: "".join(sorted(b)) for m, b in sorted(before.items())}


_JOINING = _composing()
#: A letter and a mark that has one composed form with it.
_COMPOSING = "|".join(rf"[{bases}][{INVISIBLE}\u064b-\u0652\u0670]*+{mark}" for mark, bases in _JOINING.items())
#: A letter with a separate mark.
COMBINING = rf"\p{{L}}[{INVISIBLE}{SELECTOR}\p{{M}}]*?[{_MARK}]|{_COMPOSING}"
#: An invisible character, or a variation selector of a letter.
HIDDEN = rf"[{INVISIBLE}]|\p{{L}}\p{{M}}*?[{SELECTOR}]"
#: Characters that are never suspicious by themselves, the most common first (not the dotless i).
USUAL = "\\x00-\\x9f\\u00a1-\\u00ac\\u00ae-\\u0130\\u0132-\\u024f\\u2013-\\u2027"
_NEXT_TO = rf"{_LETTERS['latin']}{_OTHER}{_RARE}{_MARK}{INVISIBLE}{SELECTOR}\p{{Nd}}"
#: Matches a text that may hold a suspicious word: the longest unsuspicious beginning is taken possessively, and something is
#: left.  Words are judged when they have been taken out (:func:`odd_word`); this only spares most texts that.
SUSPECT = (
    rf"(?s)^(?:[{USUAL}]++|(?<![{_NEXT_TO}])(?:[{_LETTERS['cyrillic']}]++|[{_LETTERS['greek']}]++|[{_LETTERS['armenian']}]++)(?![{_NEXT_TO}])"
    rf"|[^{USUAL}{FULLWIDTH}{INVISIBLE}{SELECTOR}{HARD_SPACE}{_OWN_LATIN}{_MARK}{''.join(_JOINING)}{_OTHER}{_RARE}])*+."
)
_RUN = rf"\p{{L}}\p{{M}}\p{{N}}℀-⅏{INVISIBLE}"
#: Words, single full-width signs, single hard spaces.
UNIT = rf"[{_RUN}]+|[{FULLWIDTH}{HARD_SPACE}]"
#: The same and what lies between, so that the pieces make up the text.
PIECE = rf"{UNIT}|[^{_RUN}{FULLWIDTH}{HARD_SPACE}]+"


def suspect(text: Column) -> Column:
    return text.rlike(SUSPECT)


def odd_word(word: Column) -> Column:
    """Whether a word holds an unusual character, or letters of more than one script; words of any length are judged as a whole."""
    latin, rest = word.rlike(f"[{_LETTERS['latin']}]"), word.rlike(f"[{_OTHER}{_RARE}]")
    east = word.rlike(f"[{_LETTERS['cyrillic']}]") & word.rlike(f"[{_LETTERS['greek']}{_LETTERS['armenian']}{_RARE}]")
    return word.rlike(rf"[{FULLWIDTH}{HARD_SPACE}{_OWN_LATIN}]|{HIDDEN}|{COMBINING}") | (latin & rest) | east


def confusables(spark: SparkSession) -> dict[str, str]:
    """Letters of other scripts that have the skeleton of a Latin letter in the Unicode confusables, and that letter.

    A skeleton that is a small capital counts as its letter.  Of several Latin letters with one skeleton that of the same case is taken.
    """
    checker = spark._jvm.com.ibm.icu.text.SpoofChecker.Builder().build()
    # Digits with the skeleton of a letter are no letters.
    chars = [c for c in re.findall(f"[{_OTHER}{_RARE}]", "".join(map(chr, (*range(0x370, 0xD800), *range(0x1D400, 0x1D800))))) if unicodedata.category(c)[0] == "L"]
    latin = [chr(c) for c in (*range(65, 91), *range(97, 123))]
    shapes = dict(zip(latin + chars, checker.getSkeleton(0, "\n".join(latin + chars)).split("\n")))
    same: dict[str, list[str]] = {}
    for x in latin:
        same.setdefault(shapes[x], []).append(x)
        capital = f"LATIN LETTER SMALL CAPITAL {x}" if x.isupper() else ""
        try:
            same.setdefault(unicodedata.lookup(capital), []).append(x.lower())
        except KeyError:
            pass
    same["ĸ"] = ["k"]  # the letter kra
    out = {}
    for c in chars:
        near = same.get(shapes[c], [])
        if near:
            out[c] = next((x for x in near if x.isupper() == c.isupper()), near[0])
    return out | LATIN_FOR


_WIDE = "".join(chr(c) for c in range(0xFF01, 0xFF5F))
_NARROW = "".join(chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F))


def _drop_and_narrow(word: Column) -> Column:
    """Full-width forms to ASCII, hard spaces to spaces, invisible characters and selectors of letters away."""
    shown = F.regexp_replace(word, f"[{INVISIBLE}]", "")
    shown = F.when(shown.rlike(r"\p{L}"), F.regexp_replace(shown, f"[{SELECTOR}]", "")).otherwise(shown)
    return F.translate(shown, _WIDE + HARD_SPACE, _NARROW + " " * len(HARD_SPACE))


def _without(script: str, table: dict[str, str]) -> str:
    """A pattern for a letter of ``script`` that is not one of the table's keys."""
    return rf"[{_LETTERS[script]}&&[^{''.join(table)}]]"


def _count(word: Column, pattern: str) -> Column:
    return F.length(word) - F.length(F.regexp_replace(word, pattern, ""))


def _one_script(word: Column, wide: dict[str, str]) -> Column:
    """The word with look-alike letters given in the script of the letters that stay; ``wide``: all look-alikes of Latin letters."""
    latin = word.rlike(_without("latin", CYRILLIC_FOR | GREEK_FOR | dict.fromkeys(_OWN_LATIN)))
    cyrillic, greek = word.rlike(_without("cyrillic", LATIN_FOR)), word.rlike(_without("greek", LATIN_FOR))
    armenian = word.rlike(_without("armenian", LATIN_FOR))
    other = LATIN_FOR
    to_latin = F.translate(word, "".join(other), "".join(other.values()))
    keep_cyr = {k: v for k, v in other.items() if not ("Ѐ" <= k <= "ԯ")}
    keep_greek = {k: v for k, v in other.items() if not ("Ͱ" <= k <= "Ͽ")}
    to_cyr = F.translate(F.translate(word, "".join(keep_cyr), "".join(keep_cyr.values())), "".join(CYRILLIC_FOR), "".join(CYRILLIC_FOR.values()))
    to_greek = F.translate(F.translate(word, "".join(keep_greek), "".join(keep_greek.values())), "".join(GREEK_FOR), "".join(GREEK_FOR.values()))
    n_latin, n_cyr, n_greek = (_count(word, f"[{_LETTERS[s]}]") for s in ("latin", "cyrillic", "greek"))
    single = ~word.rlike(r"\p{L}.*\p{L}")
    # Letters proper to Latin, and beside them only letters that look like Latin ones.
    not_alike = word.rlike(f"[{_OTHER}{_RARE}&&[^{''.join(wide)}]]")
    has_wide = word.rlike(f"[{_OTHER}{_RARE}]")
    to_wide = F.translate(word, "".join(wide), "".join(wide.values()))
    return (
        F.when(single, word)
        .when(latin & has_wide & ~not_alike, to_wide)
        .when((latin.cast("int") + cyrillic.cast("int") + greek.cast("int") + armenian.cast("int")) > 1, word)  # really mixed
        .when(armenian, word)
        .when(cyrillic, to_cyr)
        .when(greek, to_greek)
        .when(latin, to_latin)
        .when((n_latin == 0) & (n_greek == 0) | (n_latin == 0) & (n_cyr == 0), word)
        .when((n_cyr > n_latin) & (n_cyr >= n_greek), to_cyr)
        .when((n_greek > n_latin) & (n_greek > n_cyr), to_greek)
        .otherwise(to_latin)
    )


@F.pandas_udf(StringType())
def composed(word: pd.Series) -> pd.Series:
    """Composed spelling (distinct suspicious words only pass here)."""
    return word.map(lambda w: None if w is None else unicodedata.normalize("NFC", w))


def suspicious_units(df: DataFrame, key: str, text: str) -> DataFrame:
    """``key, word``: the distinct suspicious words of every text, computed in the scan stage."""
    units = F.filter(F.regexp_extract_all(F.col(f"`{text}`"), F.lit(UNIT), F.lit(0)), lambda w: F.octet_length(w) > F.length(w))
    found = df.where(suspect(F.col(f"`{text}`"))).select(F.col(f"`{key}`").alias(key), F.explode(F.array_distinct(units)).alias("word"))
    return found.where(odd_word(F.col("word")))


def canonical_words(words: DataFrame) -> DataFrame:
    """``word, canonical, kinds`` for distinct words (column ``word``, count ``n``)."""
    plain = words.withColumn("narrow", _drop_and_narrow(F.col("word")))
    mapped = plain.withColumn("mapped", _one_script(F.col("narrow"), confusables(words.sparkSession)))
    spelled = mapped.withColumn("nfc", F.when(F.col("mapped").rlike(r"\p{M}"), composed("mapped")).otherwise(F.col("mapped")))
    spelled = spelled.withColumn("class", F.collate("mapped", "UNICODE"))
    # The canonical member of a class; a member's rank: most often met first, then by bytes.
    best = spelled.groupBy("class").agg(F.min_by("nfc", F.struct(F.negative("n"), F.col("nfc"))).alias("canonical"))
    both = spelled.select("word", "narrow", "class").join(best, "class")
    # What a word has and the canonical member of its class has not.  A mark that composes with no letter stays, and is told.
    word, canonical = F.col("word"), F.col("canonical")
    lost = lambda pattern: word.rlike(pattern) & ~canonical.rlike(pattern)
    kinds = F.array_compact(
        F.array(
            F.when(lost(f"[{FULLWIDTH}]"), "fullwidth"),
            F.when(word.rlike(COMBINING), "combining"),
            F.when(lost(HIDDEN), "invisible"),
            F.when(lost(f"[{HARD_SPACE}]"), "space"),
            F.when(_letters(F.col("narrow")) != _letters(canonical), "lookalike"),
        )
    )
    return both.select("word", "canonical", F.when(word != canonical, kinds).otherwise(F.when(word.rlike(COMBINING), F.array(F.lit("combining"))).otherwise(F.array().cast("array<string>"))).alias("kinds"))


def _letters(word: Column) -> Column:
    """A composed word (a canonical member), or one that may still hold separate marks, as it is composed."""
    return F.when(word.rlike(r"\p{M}"), composed(word)).otherwise(word)


def word_table(df: DataFrame, key: str, text: str) -> tuple[DataFrame, DataFrame]:
    """The suspicious words per text and the table of their canonical members."""
    pairs = checkpoint(suspicious_units(df, key, text))
    return pairs, canonical_words(pairs.groupBy("word").agg(F.count("*").alias("n")))


def kinds_found(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, kind``: the kinds of unusual writing that a text holds at least once."""
    pairs, words = word_table(df, key, text)
    return pairs.join(words, "word").select(key, F.explode("kinds").alias("kind")).distinct()


def canonical_text(df: DataFrame, key: str = "doc_id", text: str = "text", out: str = "canonical") -> DataFrame:
    """``df`` and a column ``out``: ``text`` in its consistent form.

    ``key`` brings a text together with its words; rows that share a key share their words, and a row with a
    NULL key keeps its text.  Texts without suspicious words never leave their partition; the others meet their words' canonical
    members once.
    """
    pairs, words = word_table(df, key, text)
    per_text = pairs.join(words.select("word", "canonical"), "word").groupBy(key)
    per_text = per_text.agg(F.map_from_entries(F.collect_set(F.struct("word", "canonical"))).alias("__words"))
    keep = [F.col(f"`{c}`") for c in df.columns if c != out]
    odd = F.coalesce(suspect(F.col(f"`{text}`")), F.lit(False))
    clean = df.where(~odd).select(*keep, F.col(f"`{text}`").alias(out))
    pieces = F.regexp_extract_all(F.col(f"`{text}`"), F.lit(PIECE), F.lit(0))
    mended = F.array_join(F.transform(pieces, lambda p: F.when(F.octet_length(p) > F.length(p), F.coalesce(F.try_element_at(F.col("__words"), p), p)).otherwise(p)), "")
    dirty = df.where(odd).join(per_text, key, "left").select(*keep, mended.alias(out))
    return clean.unionByName(dirty)
