"""Dates written in many forms, as one exact instant.

Every written form is one alternative of a single regular expression with named groups.  One
``regexp_replace`` pulls the components of whichever alternative matched into a fixed record,
calendar ranges are checked on those integers, and the instant is put together by integer day
arithmetic.  Everything stays in JVM expressions, so the column is computed inside the scan stage
with no Python worker and no shuffle.

Rules:

* NULL, empty text, words, and impossible calendar dates give NULL; a text may have any length (no part of the
  pattern gives back what it took, so the work is linear in it);
* a text with no zone is local time of ``local_zone``; in an hour that occurs twice the first is
  taken, in a skipped hour the time moves forward by the jump (the same for named regions);
* digits only: seconds, milliseconds, microseconds or nanoseconds since 1970 UTC by length;
* zone letters are those of mail headers (``UT``, ``GMT``, the four North American pairs); a single
  letter is UTC; ``CET`` is +1 and ``CEST`` +2; any other zone word denotes no instant;
* ``-0000`` is UTC; a trailing parenthesised comment is ignored; a leading weekday is ignored;
* dotted numbers are day.month.year, two-digit years are 20xx, missing seconds are 0, fractions
  beyond the microsecond are cut.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Month names in the forms met in headers (English, German).
MONTHS = {
    1: ["jan", "january", "januar", "jänner"],
    2: ["feb", "february", "februar"],
    3: ["mar", "march", "märz", "mrz"],
    4: ["apr", "april"],
    5: ["may", "mai"],
    6: ["jun", "june", "juni"],
    7: ["jul", "july", "juli"],
    8: ["aug", "august"],
    9: ["sep", "sept", "september"],
    10: ["oct", "october", "okt", "oktober"],
    11: ["nov", "november"],
    12: ["dec", "december", "dez", "dezember"],
}

# Minutes east of UTC of the zone words of mail headers, and CET/CEST.
ZONE_MINUTES = {
    "Z": 0, "UT": 0, "UTC": 0, "GMT": 0,
    "EST": -300, "EDT": -240, "CST": -360, "CDT": -300,
    "MST": -420, "MDT": -360, "PST": -480, "PDT": -420,
    "CET": 60, "CEST": 120,
}

_TIME = r"(?<H{k}>\d{{1,2}}):(?<M{k}>\d{{2}})(?::(?<S{k}>\d{{2}})(?:[.,](?<f{k}>\d++))?)?"
_ZONE = r"(?:\s*+(?:(?<o{k}>[+-]\d{{2}}:?\d{{2}})|(?<z{k}>[A-Za-z]{{1,5}}+)(?![A-Za-z_/])|(?<r{k}>[A-Za-z_]++(?:/[A-Za-z_+0-9-]++)++)))?"
_DAYNAME = r"(?:[A-Za-z]{2,10}\.?,?\s++)?"

#: One alternative per written form; ``{k}`` keeps the group names of the alternatives apart.
FORMS = [
    # 2021-02-01T02:52:06.123+01:00 | 2021-02-01 12:17:39 Europe/Berlin
    r"(?<Y{k}>\d{{4}})-(?<m{k}>\d{{2}})-(?<d{k}>\d{{2}})(?:[Tt]|\s++)" + _TIME + _ZONE,
    # 20210201T190405Z
    r"(?<Y{k}>\d{{4}})(?<m{k}>\d{{2}})(?<d{k}>\d{{2}})[Tt](?<H{k}>\d{{2}})(?<M{k}>\d{{2}})(?<S{k}>\d{{2}})?(?:[.,](?<f{k}>\d++))?" + _ZONE,
    # Mon, 01 Feb 2021 12:16:04 +0100 (CET) | 10. Februar 2021 15:33:04 +0900
    _DAYNAME.replace("{", "{{").replace("}", "}}") + r"(?<d{k}>\d{{1,2}})\.?\s++(?<n{k}>\p{{L}}++)\.?,?\s++(?<Y{k}>\d{{4}}|\d{{2}})\s++" + _TIME + _ZONE,
    # 02.02.2021 11:00:18
    r"(?<d{k}>\d{{1,2}})\.(?<m{k}>\d{{1,2}})\.(?<Y{k}>\d{{4}}|\d{{2}}),?\s++" + _TIME + _ZONE,
    # Sun Oct 31 02:12:04 2021
    r"(?:[A-Za-z]{{2,10}},?\s++)?(?<n{k}>\p{{L}}++)\s++(?<d{k}>\d{{1,2}})\s++" + _TIME + r"\s++(?<Y{k}>\d{{4}})",
    # Feb 14, 2021 6:47:48 PM
    r"(?<n{k}>\p{{L}}++)\.?\s++(?<d{k}>\d{{1,2}}),\s++(?<Y{k}>\d{{4}}|\d{{2}})\s++" + _TIME + r"(?:\s*+(?<p{k}>[AaPp][Mm]))?" + _ZONE,
]

_FIELDS = "Y n m d H M S f p o z r".split()
_PATTERN = r"^\s*+(?:" + "|".join(form.format(k=i) for i, form in enumerate(FORMS)) + r"|(?<e>\d{1,19}+))\s*+(?:\([^()]*+\))?+\s*+$"
_PRESENT = [[f for f in _FIELDS if f"(?<{f}{i}>" in form.format(k=i)] for i, form in enumerate(FORMS)]
_RECORD = "\u0001|" + "|".join("".join(f"${{{f}{i}}}" for i, has in enumerate(_PRESENT) if f in has) for f in _FIELDS) + "|${e}|"

_DAY = 86_400_000_000


def valid_zones(spark: SparkSession) -> list[str]:
    """Region names that the JVM's zone database knows (about 600, fixed by the runtime)."""
    return sorted(z for z in spark._jvm.java.time.ZoneId.getAvailableZoneIds() if "/" in z)


def _div(a: Column, b: int) -> Column:
    return ((a - F.pmod(a, F.lit(b))) / b).cast("bigint")


def _days(y: Column, m: Column, d: Column) -> Column:
    """Days from 1970-01-01 to a proleptic Gregorian date; years begin in March, so a leap day is a year's last."""
    shifted = y - F.when(m <= 2, 1).otherwise(0)
    era = _div(shifted, 400)
    in_era = shifted - era * 400
    day_of_year = _div((m + 9) % 12 * 153 + 2, 5) + d - 1
    return era * 146_097 + in_era * 365 + _div(in_era, 4) - _div(in_era, 100) + day_of_year - 719_468


def to_iso(micros: Column) -> Column:
    """An instant (microseconds since 1970 UTC) in the stored form, to the second, in the session's zone UTC; NULL stays NULL."""
    return F.date_format(F.timestamp_micros(micros), "yyyy-MM-dd'T'HH:mm:ssxxx")


def with_utc_micros(df: DataFrame, text: str, out: str, local_zone: str = "Europe/Berlin") -> DataFrame:
    """``df`` and a column ``out``: microseconds since 1970-01-01 UTC that column ``text`` denotes.

    NULL where the text denotes no instant (rules: module docstring).  Other columns, whatever their
    names, pass through; a column already named ``out`` is replaced.  An empty table stays empty.
    The work is a chain of projections: each step is computed once per row and nothing is shuffled.
    """
    spark = df.sparkSession
    keep = [c for c in df.columns if c != out]
    tmp = "__ts"
    while any(c.startswith(tmp) for c in df.columns):
        tmp += "_"
    at = {f: i + 1 for i, f in enumerate([*_FIELDS, "e"])}
    cut = F.split(F.regexp_replace(F.col(f"`{text}`"), _PATTERN, _RECORD), r"\|")
    df = df.withColumn(tmp, cut)
    df = df.withColumn(tmp, F.when((F.size(tmp) == len(at) + 2) & (F.get(F.col(tmp), F.lit(0)) == "\u0001"), F.col(tmp)))
    part = lambda f: F.nullif(F.get(F.col(tmp), F.lit(at[f])), F.lit(""))
    num = lambda f: part(f).try_cast("bigint")

    month_of = F.create_map(*[x for n, names in MONTHS.items() for name in names for x in (F.lit(name), F.lit(n))])
    zone_of = F.create_map(*[x for z, n in ZONE_MINUTES.items() for x in (F.lit(z), F.lit(n))])
    offset, letters = F.regexp_replace(part("o"), ":", ""), F.upper(part("z"))
    off_h, off_m = F.substring(offset, 2, 2).try_cast("bigint"), F.substring(offset, 4, 2).try_cast("bigint")
    df = df.withColumn(
        tmp,
        F.struct(
            F.when(F.length(part("Y")) == 2, num("Y") + 2000).otherwise(num("Y")).alias("y"),
            F.coalesce(num("m"), F.try_element_at(month_of, F.lower(part("n"))).cast("bigint")).alias("m"),
            num("d").alias("d"), num("H").alias("h"), num("M").alias("mi"), F.coalesce(num("S"), F.lit(0)).alias("s"),
            F.coalesce(F.rpad(F.substring(part("f"), 1, 6), 6, "0").try_cast("bigint"), F.lit(0)).alias("us"),
            F.lower(part("p")).alias("half"),
            (part("o").isNotNull() | letters.isNotNull()).alias("fixed"),
            F.when(offset.isNotNull(), F.when((off_h <= 23) & (off_m <= 59), F.when(offset.startswith("-"), -1).otherwise(1) * (off_h * 60 + off_m)))
            .when(F.length(letters) == 1, F.lit(0)).otherwise(F.try_element_at(zone_of, letters)).alias("east"),
            part("r").alias("region"),
            F.length(part("e")).alias("digits"), num("e").alias("e"),
        ),
    )
    y, m, d, h, half = (F.col(tmp)[x] for x in ("y", "m", "d", "h", "half"))
    leap = ((y % 4 == 0) & (y % 100 != 0)) | (y % 400 == 0)
    last = F.when(m == 2, F.when(leap, 29).otherwise(28)).when(m.isin(4, 6, 9, 11), 30).otherwise(31)
    good = (
        (y >= 1) & m.between(1, 12) & (d >= 1) & (d <= last) & (h <= 23) & (F.col(tmp)["mi"] <= 59) & (F.col(tmp)["s"] <= 59)
        & (half.isNull() | h.between(1, 12))
    )
    hour = F.when(half.isNull(), h).otherwise(h % 12 + F.when(half == "pm", 12).otherwise(0))
    wall = _days(y, m, d) * _DAY + hour * 3_600_000_000 + F.col(tmp)["mi"] * 60_000_000 + F.col(tmp)["s"] * 1_000_000 + F.col(tmp)["us"]
    df = df.withColumn(tmp + "w", F.when(good, wall))
    clock, region, e, digits = F.timestamp_micros(F.col(tmp + "w")), F.col(tmp)["region"], F.col(tmp)["e"], F.col(tmp)["digits"]
    known = F.when(region.isin(valid_zones(spark)), region)
    value = (
        F.when(digits <= 11, e * 1_000_000).when(digits <= 14, e * 1_000).when(digits <= 17, e).when(digits.isNotNull(), _div(e, 1000))
        .when(F.col(tmp)["fixed"], F.col(tmp + "w") - F.col(tmp)["east"] * 60_000_000)
        .when(region.isNotNull(), F.unix_micros(F.to_utc_timestamp(clock, known)))
        .otherwise(F.unix_micros(F.to_utc_timestamp(clock, F.lit(local_zone))))
    )
    # A one-element explode: a later filter on ``out`` stays above it instead of being rewritten into copies of the whole chain.
    return df.select(*[F.col(f"`{c}`") for c in keep], F.explode(F.array(value.cast("bigint"))).alias(out))
