"""Text decoded with the wrong character encoding: found, and given back where nothing was lost.

Words are the white-space separated pieces of the fields that hold a non-ASCII character.  Every distinct
word is judged once.  Garbled forms under every encoding chain are generated from the distinct clean words, from their
runs of non-ASCII characters, and from their single characters; the corpus words are hash-joined with these tables:

1. whole words: a word that is the form of a clean word is damaged, and the clean word is its original;
2. runs: each run of non-ASCII characters of a word that was nowhere met undamaged;
3. characters: a word or run is cut into the units that a chain makes of single characters, and every unit is joined
   (with the forms of the characters of clean words, and of the few hundred of the single-byte encodings).

A word is damaged by the chain that explains its runs, if the outcome reads as clean text.  Of several chains one
that starts from UTF-8 comes first (other text is hardly ever valid UTF-8 by chance), then the evidence of a whole run, then
the outcome whose letter pairs are the most usual, by a join with the counted pairs of all clean words.  A word in Cyrillic
capitals that a chain makes of small letters is damaged where the small letters are far more usual.  The
replacement character is the form of any character under a lossy reading: such words are damaged beyond repair.

Every damaged word is found by these joins.  Only :func:`words_beside`, for restoring, leads back a
clean-looking word without corpus evidence of its own, through the chain of a damaged word in the same value; the result marks
such values as ``inferred``.

The generation is verified by construction: a form is in a table only if the chain leads from the clean
text to exactly that form.  NULL and empty values hold no damage.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadloom.session import checkpoint, tasks

# The encoding chains.  Each step is (encoding that the bytes were in, encoding they were read in).
CHAINS = {
    "utf8-cp1252": [("utf-8", "cp1252")],
    "utf8-latin1": [("utf-8", "latin-1")],
    "utf8-cp1252-twice": [("utf-8", "cp1252"), ("utf-8", "cp1252")],
    "utf8-latin1-twice": [("utf-8", "latin-1"), ("utf-8", "latin-1")],
    "utf8-cp1252-thrice": [("utf-8", "cp1252"), ("utf-8", "cp1252"), ("utf-8", "cp1252")],
    "utf8-macroman": [("utf-8", "mac_roman")],
    "utf8-cp437": [("utf-8", "cp437")],
    "utf8-cp850": [("utf-8", "cp850")],
    "utf8-cp1250": [("utf-8", "cp1250")],
    "utf8-cp1251": [("utf-8", "cp1251")],
    "utf8-cp866": [("utf-8", "cp866")],
    "utf8-koi8r": [("utf-8", "koi8-r")],
    "latin1-macroman": [("latin-1", "mac_roman")],
    "latin1-cp437": [("latin-1", "cp437")],
    "latin1-cp850": [("latin-1", "cp850")],
    "macroman-latin1": [("mac_roman", "cp1252")],
    "cp437-latin1": [("cp437", "cp1252")],
    "latin2-latin1": [("iso8859-2", "cp1252")],
    "cp1250-latin1": [("cp1250", "cp1252")],
    "cp1251-latin1": [("cp1251", "cp1252")],
    "koi8r-latin1": [("koi8-r", "cp1252")],
    "cp866-latin1": [("cp866", "cp1252")],
    "cp1251-koi8r": [("cp1251", "koi8-r")],
    "koi8r-cp1251": [("koi8-r", "cp1251")],
    "cp866-cp1251": [("cp866", "cp1251")],
    "cp1251-cp866": [("cp1251", "cp866")],
    "greek-latin1": [("iso8859-7", "cp1252")],
    "sjis-latin1": [("shift_jis", "cp1252")],
    "eucjp-latin1": [("euc_jp", "cp1252")],
}
#: Chains whose source spends several bytes on a character: their garbled runs are unmistakable even where each sign is usual.
LONG = tuple(c for c, steps in CHAINS.items() if steps[0][0] in ("utf-8", "shift_jis", "euc_jp"))
#: Chains whose source is UTF-8.
UTF8 = tuple(c for c, steps in CHAINS.items() if steps[0][0] == "utf-8")
MARK = "\ufeff"
#: The character that a lossy reading leaves, and the name of that reading.
LOST, LOSSY = "\ufffd", "lossy"


def _tables() -> dict[str, dict[int, str]]:
    """Byte to character for every reading encoding; undefined bytes stay control characters."""
    out = {}
    for _, to in {s for steps in CHAINS.values() for s in steps}:
        out[to] = {b: bytes([b]).decode(to, "ignore") or chr(b) for b in range(256)}
    return out


_READ = _tables()


def garbled(text: str, chain: str) -> str | None:
    """What ``text`` becomes under ``chain``; None if the chain can't carry it."""
    for source, reading in CHAINS[chain]:
        try:
            data = text.encode(source)
        except UnicodeEncodeError:
            return None
        table = _READ[reading]
        text = "".join([table[b] for b in data])
    return text


_LETTERS = re.compile(r"[^\W\d_]+")


def _script(o: int) -> str:
    if o < 0x80 or 0xC0 <= o <= 0x17F or 0x218 <= o <= 0x21B or 0x1E00 <= o <= 0x1EFF:
        return "latin"
    if 0x370 <= o <= 0x3FF or 0x1F00 <= o <= 0x1FFF:
        return "greek"
    if 0x400 <= o <= 0x52F:
        return "cyrillic"
    if 0x3040 <= o <= 0x30FF or 0x3400 <= o <= 0x9FFF or 0xFF66 <= o <= 0xFF9F or o in (0x3005, 0x3006):
        return "japanese"
    if 0x530 <= o <= 0x58F or 0x5D0 <= o <= 0x5FF or 0x620 <= o <= 0x6FF or 0x900 <= o <= 0xE7F or 0x10A0 <= o <= 0x11FF or 0xAC00 <= o <= 0xD7A3:
        return f"block {o >> 8}"
    return "stray"


def repertoire() -> list[str]:
    """The characters of the single-byte source encodings: forms of these are known also where no clean word holds them."""
    sources = {source for steps in CHAINS.values() for source, _ in steps if source not in ("utf-8", "shift_jis", "euc_jp")}
    chars = {bytes([b]).decode(source, "ignore") for source in sources for b in range(0xA0 if source.startswith(("latin", "iso")) else 0x80, 256)}
    return sorted(c for c in chars if c and not 0x2500 <= ord(c) < 0x2600 and unicodedata.category(c)[0] in "LNPS")


#: Verdicts of :func:`verdict`.
CLEAN, ODD, BROKEN = 0, 1, 2


def verdict(word: str) -> int:
    """CLEAN: could have been written as it stands; ODD: letters that do not go together; BROKEN: signs no one writes there."""
    for ch in word:
        o = ord(ch)
        if 0x80 <= o <= 0xA0 or o in (0xAD, 0xFFFD) or 0x2500 <= o <= 0x25FF or 0xE000 <= o <= 0xF8FF:
            return BROKEN
    begin, end = 0, len(word)
    while begin < end and unicodedata.category(word[begin])[0] not in "LNM":
        begin += 1
    while end > begin and unicodedata.category(word[end - 1])[0] not in "LNM":
        end -= 1
    # A mathematical or other symbol sticks to digits, not to letters.
    for beside, sign in ((begin, begin - 1), (end - 1, end)):
        if 0 <= sign < len(word) and begin < end and ord(word[sign]) > 127 and word[beside].isalpha():
            if unicodedata.category(word[sign])[0] == "S" and word[sign] not in "®™":
                return BROKEN
    core = word[begin:end]
    if len(core) > 1 and core[-1] in "²³" and core[:-1].isascii() and len(core) <= 4:
        core = core[:-1]
    if re.fullmatch(r"µ[A-Za-z]{1,2}|[0-9]*[¼½¾⅐-⅞]|[0-9]*[¹²³]", core):
        return CLEAN
    for i, ch in enumerate(core):
        if ord(ch) < 128:
            continue
        kind = unicodedata.category(ch)
        if kind[0] == "L":
            if _script(ord(ch)) == "stray":
                return BROKEN
        elif kind[0] == "M" or kind == "Nd":
            continue
        elif not (ch in "’‘–—‐‑·・" and 0 < i < len(core) - 1 and core[i - 1].isalnum() and core[i + 1].isalnum() and (ch != "·" or not core.isascii() and core[i - 1] > "\x7f")):
            return BROKEN
    for run in _LETTERS.findall(core):
        if run.isascii():
            continue
        if len({_script(ord(ch)) for ch in run}) > 1:
            return ODD
        far = 0
        for i, ch in enumerate(run):
            o = ord(ch)
            if o < 128:
                far = 0
                continue
            if o < 0x250:
                far += 1
                if far >= 3:
                    return ODD
            if ch.isupper() and i and (run[i - 1].islower() or (i + 1 < len(run) and run[i + 1].islower())):
                return ODD
        if far == len(run) >= 2:
            return ODD
    return CLEAN


def reads_clean(word: str) -> bool:
    return verdict(word) == CLEAN


_FAR = re.compile(r"[^\x00-\x7f]+")


def _judged(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """word, n -> word, n, verdict."""
    for b in batches:
        words = b.column(0).to_pylist()
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([verdict(w) for w in words], pa.int32())], names=["word", "n", "verdict"])


def _forms(each: bool):
    """Clean text, n -> form, text, n, chain: its garbled forms; ``each``: under every chain, else a form once, under its first chain."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for text, n in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                seen = {text}
                for chain in CHAINS:
                    form = garbled(text, chain)
                    if form is not None and form not in seen:
                        rows.append((form, text, n, chain))
                        if not each:
                            seen.add(form)
            if rows:
                f, t, n, c = zip(*rows)
                yield pa.RecordBatch.from_arrays([pa.array(f, pa.string()), pa.array(t, pa.string()), pa.array(n, pa.int64()), pa.array(c, pa.string())], names=["form", "text", "n", "chain"])

    return run


_FORM = "form string, text string, n bigint, chain string"


_WRITE = {to: {c: b for b, c in table.items()} for to, table in _READ.items()}


def undone(word: str, chain: str) -> str | None:
    """The text that ``chain`` turns into ``word``, if there is one."""
    text = word
    for source, reading in reversed(CHAINS[chain]):
        table = _WRITE[reading]
        data = [table.get(ch) for ch in text]
        if None in data:
            return None
        try:
            text = bytes(data).decode(source)
        except UnicodeDecodeError:
            return None
    return text if text != word and garbled(text, chain) == word else None


#: Capitals that these chains make of small Cyrillic letters read clean.
TURNING = ("cp1251-koi8r", "koi8r-cp1251")
#: Gain in mean log frequency of its letter pairs from which a word in capitals that stands alone counts as damaged.
GAIN = 2.0
_CAPITAL = re.compile(r"[\u0400-\u042f]")


def _turned(word: str) -> bool:
    """Whether the word has Cyrillic capitals and no small letters."""
    return word == word.upper() and _CAPITAL.search(word) is not None


def _cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """piece, verdict of its word, number -> number, chain, n_units, k, unit: the units that a chain may have made of single characters, for every chain
    under which the piece can be cut.  ASCII between them is given as a unit with no chain to look up.
    """
    for b in batches:
        rows: list[tuple[int, str, int, int, str]] = []
        for piece, kind, number in zip(*(b.column(i).to_pylist() for i in range(3))):
            if LOST in piece:
                rows.append((number, LOSSY, 1, 0, LOST))
                continue
            if kind == CLEAN and not _turned(piece):
                continue
            for chain in TURNING if kind == CLEAN else CHAINS:
                text = undone(piece, chain)
                if text is not None:
                    rows += [(number, chain, len(text), k, garbled(ch, chain) or ch) for k, ch in enumerate(text)]
        if rows:
            p, c, n, k, u = zip(*rows)
            yield pa.RecordBatch.from_arrays([pa.array(p, pa.int64()), pa.array(c, pa.string()), pa.array(n, pa.int32()), pa.array(k, pa.int32()), pa.array(u, pa.string())], names=["number", "chain", "n_units", "k", "unit"])


def _candidates(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """word, verdict, parts (form, text, chain, units) of its explained pieces -> word, verdict, chain, text, clean, run: what each chain leads back to.

    ``run`` says that runs of three characters or more were found as such.  A lossy reading leads back to no text.
    """
    for b in batches:
        rows: list[tuple[str, int, str, str | None, bool, bool]] = []
        for word, kind, parts in zip(*(b.column(i).to_pylist() for i in range(3))):
            table: dict[str, dict[str, tuple[bool, str]]] = {}
            for p in parts or []:
                own = table.setdefault(p["chain"], {})
                own[p["form"]] = max(own.get(p["form"], (False, "")), (not p["units"], p["text"]))
            if LOSSY in table:
                rows.append((word, kind, LOSSY, None, False, False))
                continue
            body = word.strip(EDGES)
            for chain, own in table.items():
                long = chain in LONG
                if kind == CLEAN and not (long and any(len(f) > 1 for f in own)) and not (chain in TURNING and _turned(word)):
                    continue
                runs = _FAR.findall(word)
                known = [r for r in runs if r in own]
                whole = word if word in own else body
                if whole in own and not (len(known) == len(runs) and all(own[r][0] for r in known)):
                    text = word.replace(whole, own[whole][1])
                elif known and (long or len(known) == len(runs)):
                    # A long chain may have garbled only some of the runs: the others must read clean as they are.
                    text = _FAR.sub(lambda m: own[m.group()][1] if m.group() in own else m.group(), word)
                else:
                    continue
                text = text.replace(MARK, "")
                clean = reads_clean(text)
                # Explained throughout, an impossible word is damage also where what it comes of is itself oddly mixed.
                odd = kind == BROKEN and len(known) == len(runs) and all(reads_clean(own[r][1]) for r in known) and (chain in UTF8 or sum(map(len, runs)) > 2)
                if text != word and (clean or odd and verdict(text) == ODD) and (kind != CLEAN or chain not in TURNING or text == text.lower()):
                    rows.append((word, kind, chain, text, clean, any(len(r) > 2 and own[r][0] for r in known)))
        if rows:
            w, v, c, t, e, r = zip(*rows)
            yield pa.RecordBatch.from_arrays([pa.array(w, pa.string()), pa.array(v, pa.int32()), pa.array(c, pa.string()), pa.array(t, pa.string()), pa.array(e, pa.bool_()), pa.array(r, pa.bool_())], names=["word", "verdict", "chain", "text", "clean", "run"])


def _explained(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Damaged word, original -> word, chain: every chain that makes the one of the other."""
    for b in batches:
        rows = [(w, c) for w, o in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) for c in CHAINS if garbled(o, c) == w]
        if rows:
            w, c = zip(*rows)
            yield pa.RecordBatch.from_arrays([pa.array(w, pa.string()), pa.array(c, pa.string())], names=["word", "chain"])


def _led_back(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Word that looks clean, chain -> word, chain, text: where the chain leads back to clean text."""
    for b in batches:
        rows = []
        for word, chain in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            text = undone(word, chain)
            if text is not None and reads_clean(word) and reads_clean(text):
                rows.append((word, chain, text))
        if rows:
            w, c, t = zip(*rows)
            yield pa.RecordBatch.from_arrays([pa.array(w, pa.string()), pa.array(c, pa.string()), pa.array(t, pa.string())], names=["word", "chain", "text"])


def words_of(df: DataFrame, key: str, fields: tuple[str, ...]) -> DataFrame:
    """``key, field, word``: the distinct non-ASCII words of every field value."""
    parts = None
    for f in fields:
        value = F.col(f"`{f}`")
        # White space that is no ASCII stays inside: it may be half of a garbled letter.
        words = F.array_distinct(F.filter(F.split(value, r"[ \t\r\n\f]+"), lambda w: w.rlike(r"[^\x00-\x7F]")))
        one = df.where(value.rlike(r"[^\x00-\x7F]")).select(F.col(f"`{key}`").alias(key), F.lit(f).alias("field"), F.explode(words).alias("word"))
        parts = one if parts is None else parts.unionByName(one)
    return parts


# Signs that Western text holds as they are (of Latin-1, punctuation, euro, trade mark).
USUAL_SIGNS = r"\u00a1-\u00ff\u2010-\u2027\u20ac\u2122"
#: Signs around a word that do not belong to it when words are compared.
EDGES = "\"'()<>,:;.[]{}!?"


def _pairs_in(texts: DataFrame, keep: str) -> DataFrame:
    """``keep, p``: the pairs of neighbouring characters of column ``text``, outer signs away, of which at least one is not ASCII."""
    letters = F.split(F.lower(F.concat(F.lit(" "), F.trim(F.col("text"), F.lit(EDGES)), F.lit(" "))), "")
    two = texts.select(keep, letters.alias("c")).select(keep, F.explode(F.zip_with(F.col("c"), F.slice("c", F.lit(2), F.size("c")), lambda a, b: F.concat(a, b))).alias("p"))
    return two.where(F.col("p").rlike(r"[^\x00-\x7F]"))


@dataclass(frozen=True)
class Pairs:
    """``shares``: p, share, the logarithmic share of every letter pair of clean words; ``least``: that of a pair never met."""

    shares: DataFrame
    least: float


def letter_pairs(sources: DataFrame) -> Pairs:
    """The letter pairs of clean words (text, n); every pair is kept.

    Words in Cyrillic capitals are left out: they may be what a chain made of small letters.
    """
    sources = sources.where(~((F.upper("text") == F.col("text")) & F.col("text").rlike(_CAPITAL.pattern)))
    counted = checkpoint(_pairs_in(sources, "n").groupBy("p").agg(F.sum("n").alias("n")))
    total = (counted.agg(F.sum("n")).first()[0] or 0) + 1
    return Pairs(counted.select("p", F.log((F.col("n") + 0.01) / total).alias("share")), math.log(0.01 / total))


def usual_of(texts: DataFrame, pairs: Pairs) -> DataFrame:
    """``text, usual``: the mean log share of the letter pairs of each of the texts that has any."""
    # Pairs carry the number of their text, not the text.
    distinct = checkpoint(texts.where("text IS NOT NULL").select("text").distinct().withColumn("number", F.monotonically_increasing_id()))
    found = _pairs_in(distinct, "number").join(pairs.shares, "p", "left")
    return found.groupBy("number").agg(F.avg(F.coalesce("share", F.lit(pairs.least))).alias("usual")).join(distinct, "number").select("text", "usual")


def damage_table(words: DataFrame) -> tuple[DataFrame, Pairs]:
    """``word, original`` of the damaged ones among distinct ``words`` (word, n), and the letter pairs; original is NULL where it can't be told."""
    n = tasks(words.sparkSession)
    # Few bytes but much work: the rows are spread by number, not by size.
    judged = checkpoint(words.repartition(n).mapInArrow(_judged, "word string, n bigint, verdict int"))
    bare = F.trim(F.col("word"), F.lit(EDGES))
    sources = judged.where("verdict = 0").groupBy(bare.alias("text")).agg(F.sum("n").alias("n")).where("text <> ''")
    forms = sources.repartition(n).mapInArrow(_forms(False), _FORM)
    # Whole words: the original most often met, by bytes among equals, UTF-8 first.
    whole = forms.groupBy(F.trim(F.col("form"), F.lit(EDGES)).alias("form")).agg(F.max(F.struct(F.col("chain").isin(*UTF8).alias("utf8"), "n", "text", F.col("chain").isin(*LONG).alias("long"))).alias("best"))
    joined = judged.withColumn("form", bare).join(whole, "form").where(F.col("best.text") != F.col("form"))
    # Two words that both read clean: the original is the one met more often, but never the one in capitals, which some
    # chains make of small letters.  Signs alone that are usual in Western text are what they are, unless a long chain makes them.
    original, form = F.col("best.text"), F.col("form")
    capitals = lambda c: (F.upper(c) == c) & (F.lower(c) != c)
    small = lambda c: (F.lower(c) == c) & (F.upper(c) != c)
    turned = capitals(form) & small(original)
    western = F.regexp_replace(form, r"[\x00-\x7F]", "").rlike(f"^[{USUAL_SIGNS}]+$")
    words_both = F.col("best.long") | (form.rlike(r"\p{L}") & original.rlike(r"\p{L}")) | ~western
    joined = joined.where((F.col("verdict") > 0) | turned | (words_both & (F.col("best.n") > F.col("n")) & ~(capitals(original) & small(form))))
    inside = F.expr("concat(substring(word, 1, instr(word, form) - 1), best.text, substring(word, instr(word, form) + length(form)))")
    by_word = joined.select("word", inside.alias("original"))

    pairs = letter_pairs(sources)
    rest = judged.join(by_word.select("word"), "word", "left_anti")
    runs = lambda c: F.regexp_extract_all(F.col(c), F.lit(r"[^\x00-\x7F]+"), F.lit(0))
    clean_runs = sources.select(F.explode(F.array_distinct(runs("text"))).alias("run"), "n").groupBy("run").agg(F.sum("n").alias("n"))
    run_forms = clean_runs.select("run", "n").repartition(n).mapInArrow(_forms(True), _FORM)
    # A run that clean words hold too is no sign of damage in a word that reads clean.
    usual = clean_runs.select(F.col("run").alias("form"), F.col("n").alias("usual"))
    run_forms = run_forms.join(usual, "form", "left").where(F.col("usual").isNull() | (F.col("usual") < F.col("n")))
    # A run and a chain have one original: that most often met.
    run_forms = run_forms.groupBy("form", "chain").agg(F.max_by("text", F.struct("n", "text")).alias("text"))
    pieces = checkpoint(rest.select("word", "verdict", F.explode(F.array_distinct(F.concat(runs("word"), F.array(bare, F.col("word"))))).alias("form")))
    by_run = pieces.join(run_forms, "form").select("word", "verdict", "form", "text", "chain", F.lit(False).alias("units"))

    letters = clean_runs.select(F.explode(F.split("run", "")).alias("text"), "n").where("text <> ''").groupBy("text").agg(F.sum("n").alias("n"))
    known = [MARK, *repertoire()]
    marks = words.sparkSession.range(1).select(F.explode(F.lit(known)).alias("text"), F.lit(0).cast("bigint").alias("n"))
    units = letters.unionByName(marks).repartition(n).mapInArrow(_forms(True), _FORM).groupBy("chain", F.col("form").alias("unit")).agg(F.max_by("text", F.struct("n", "text")).alias("text"))
    lost = words.sparkSession.range(1).select(F.lit(LOSSY).alias("chain"), F.lit(LOST).alias("unit"), F.lit(LOST).alias("text"))
    tried = pieces.where(f"verdict > 0 OR form = upper(form) OR contains(form, '{LOST}')").groupBy("form").agg(F.max("verdict").alias("verdict"))
    # Units carry the number of their piece, not the piece, which may be very long.
    tried = checkpoint(tried.repartition(n).withColumn("number", F.monotonically_increasing_id()))
    cut = tried.mapInArrow(_cut, "number bigint, chain string, n_units int, k int, unit string")
    plain = F.col("unit").rlike(r"^[\x00-\x7F]+$")
    met = cut.where(~plain).join(units.unionByName(lost), ["chain", "unit"]).unionByName(cut.where(plain).withColumn("text", F.col("unit")), allowMissingColumns=True)
    spelled = met.groupBy("number", "chain", "n_units").agg(F.count("*").alias("c"), F.array_sort(F.collect_list(F.struct("k", "text"))).alias("t"))
    spelled = spelled.where("c = n_units").join(tried.select("number", "form"), "number").select("form", "chain", F.array_join(F.transform("t", lambda x: x["text"]), "").alias("text"))
    by_unit = pieces.join(spelled, "form").select("word", "verdict", "form", "text", "chain", F.lit(True).alias("units"))

    parts = by_run.unionByName(by_unit).groupBy("word", "verdict").agg(F.collect_list(F.struct("form", "text", "chain", "units")).alias("parts"))
    found = checkpoint(parts.repartition(n).mapInArrow(_candidates, "word string, verdict int, chain string, text string, clean boolean, run boolean"))
    # A word in capitals is led back only where that makes it far more usual.
    heads = found.where(F.col("chain").isin(*TURNING) & (F.col("verdict") == 0)).select(F.col("word").alias("text"))
    usual_now = checkpoint(usual_of(found.select("text").unionByName(heads), pairs))
    likely = found.join(usual_now, "text", "left").fillna(0.0, ["usual"])
    before = usual_now.select(F.col("text").alias("word"), F.col("usual").alias("before"))
    likely = likely.join(before, "word", "left").where(~(F.col("chain").isin(*TURNING) & (F.col("verdict") == 0)) | (F.col("usual") - F.coalesce("before", F.lit(0.0)) > GAIN))
    rank = F.struct("clean", F.col("chain").isin(*UTF8).alias("utf8"), "run", (F.col("usual") + F.when(F.col("chain").isin(*LONG), 1.0).otherwise(0.0)).alias("u"), F.col("text").alias("t"))
    by_chain = likely.groupBy("word").agg(F.max_by("text", rank).alias("original"), F.bool_or(F.col("chain") == LOSSY).alias("lost"))
    return by_word.unionByName(by_chain.select("word", F.when(~F.col("lost"), F.col("original")).alias("original"))), pairs


def damaged_words(df: DataFrame, key: str = "ord", fields: tuple[str, ...] = ("subject", "from_addr")) -> tuple[DataFrame, DataFrame, Pairs]:
    words = words_of(df, key, fields)
    damage, pairs = damage_table(words.groupBy("word").agg(F.count("*").alias("n")))
    return words, checkpoint(damage), pairs


#: Bytes of damaged words and their originals up to which their table is sent to every executor.
SMALL = 16_000_000


def _small(damage: DataFrame) -> DataFrame:
    """``damage`` marked for broadcast if its text is small enough."""
    size = F.octet_length("word") + (F.coalesce(F.octet_length("original"), F.lit(0)) if "original" in damage.columns else F.lit(0)) + 64
    return F.broadcast(damage) if (damage.agg(F.sum(size)).first()[0] or 0) <= SMALL else damage


def _join_damage(words: DataFrame, damage: DataFrame) -> DataFrame:
    return words.join(_small(damage), "word")


def damaged_fields(df: DataFrame, key: str = "ord", fields: tuple[str, ...] = ("subject", "from_addr")) -> DataFrame:
    """``key, field``: the values that hold damage."""
    words, damage, _ = damaged_words(df, key, fields)
    return _join_damage(words, damage.select("word")).select(key, "field").distinct()


def words_beside(words: DataFrame, damage: DataFrame, pairs: Pairs, key: str) -> DataFrame:
    """``key, field, word, original`` of words that look clean but stand beside a damaged one whose chain leads them back to more usual text."""
    chains = damage.where("original IS NOT NULL").mapInArrow(_explained, "word string, chain string")
    chains = checkpoint(_join_damage(words, checkpoint(chains)).select(key, "field", "chain").distinct())
    tried = checkpoint(words.join(_small(damage.select("word")), "word", "left_anti").join(chains, [key, "field"]))
    back = checkpoint(tried.select("word", "chain").distinct().mapInArrow(_led_back, "word string, chain string, text string"))
    usual = checkpoint(usual_of(back.select("text").unionByName(back.select(F.col("word").alias("text"))), pairs))
    named = lambda c, u: usual.select(F.col("text").alias(c), F.col("usual").alias(u))
    both = back.withColumnRenamed("text", "original").join(named("original", "after"), "original", "left").join(named("word", "before"), "word", "left").fillna(0.0, ["after", "before"])
    gained = both.select("word", "chain", "original", (F.col("after") - F.col("before")).alias("gain")).where("gain > 0")
    best = F.max_by("original", F.struct("gain", "original")).alias("original")
    return tried.join(gained, ["word", "chain"]).groupBy(key, "field", "word").agg(best)


def restored_fields(df: DataFrame, key: str = "ord", fields: tuple[str, ...] = ("subject", "from_addr")) -> DataFrame:
    """``key, field, damaged, restored, whole, inferred``: damaged values with every restorable word put back.

    ``whole`` says that no damage is left, ``inferred`` that a clean-looking word was led back through the chain of a
    damaged one beside it, without evidence of its own.
    """
    words, damage, pairs = damaged_words(df, key, fields)
    hit = _join_damage(words, damage)
    beside = words_beside(words, damage, pairs, key).withColumns({"known": F.lit(True), "led": F.lit(True)})
    found = hit.withColumns({"known": F.col("original").isNotNull(), "led": F.lit(False)}).unionByName(beside).groupBy(key, "field").agg(
        F.map_from_entries(F.collect_set(F.struct("word", F.coalesce("original", "word").alias("o")))).alias("__m"),
        F.bool_and("known").alias("whole"),
        F.bool_or("led").alias("inferred"),
    )
    values = None
    for f in fields:
        one = df.where(F.col(f"`{f}`").rlike(r"[^\x00-\x7F]")).select(F.col(f"`{key}`").alias(key), F.lit(f).alias("field"), F.col(f"`{f}`").alias("damaged"))
        values = one if values is None else values.unionByName(one)
    pieces = F.regexp_extract_all(F.col("damaged"), F.lit(r"[^ \t\r\n\f]+|[ \t\r\n\f]+"), F.lit(0))
    mended = F.array_join(F.transform(pieces, lambda p: F.coalesce(F.try_element_at(F.col("__m"), p), p)), "")
    return values.join(found, [key, "field"]).select(key, "field", "damaged", mended.alias("restored"), "whole", "inferred")
