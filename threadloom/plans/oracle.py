"""The core queries in SQL, for checking the Spark plans against another engine."""

from __future__ import annotations

from threadloom.functions.text import ENDINGS
from threadloom.sources.overview import FIELDS

_WS = r"[\s\x0B\x1c-\x1f\x85\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
_BRACKET = r"[(\[{](\d+)/(\d+)[)\]}]"
_PART = rf"\bpart{_WS}+(\d+){_WS}+of{_WS}+(\d+)\b"
_ID = r"""<(?:"(?:\\.|[^"\\])*"|[^<>"])*>"""
_STORED = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}[+-]\d{2}:\d{2}$"


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _sub(s: str, pattern: str, to: str = "") -> str:
    return f"regexp_replace({s}, {_q(pattern)}, {_q(to)}, 'g')"


def _strip(s: str) -> str:
    return _sub(s, rf"^{_WS}+|{_WS}+$")


def _base(s: str) -> str:
    return _strip(_sub(_sub(_sub(s, _BRACKET), "(?i)" + _PART), r"(?i)\byEnc\b"))


def _counter(s: str, which: int, last: bool) -> str:
    lead = "(?s)^.*" if last else ""
    lead_i = "(?si)^.*" if last else "(?i)"
    one = lambda p: f"try_cast(nullif(regexp_extract({s}, {_q(p)}, {which}), '') AS BIGINT)"
    return f"CASE WHEN regexp_matches({s}, {_q(_BRACKET)}) THEN {one(lead + _BRACKET)} ELSE {one(lead_i + _PART)} END"


def _idtext(s: str) -> str:
    return f"regexp_replace({_strip(f'coalesce({s}, chr(0)[1:0])')}, '(?s)^<(.*)>$', '\\1')"


def _collection(source: str, term: str | None = None) -> str:
    """``source`` with a column collection, one step per sub-select."""
    steps = [
        _sub("s", rf"{_WS}*[\[(]\d+/\d+[\])]{_WS}*", " "),
        _sub("s", rf"{_WS}*\[\d+\]{_WS}*", " "),
        _sub("s", rf"{_WS}*\(\d+\){_WS}*", " "),
        _sub("s", r'"[^"]*"'),
        _sub("s", rf"(?i)\.(?:{'|'.join(ENDINGS)})({_WS}|$)", " "),
        _sub("s", rf"(?i)\d+\.?\d*{_WS}*(?:kb|mb|gb|bytes?)\b"),
        _strip(_sub("s", rf"(?s){_WS}+[-.]{_WS}+.*$")),
        *[_sub("s", "(?i)" + t.strip()) for t in (term or "").split("%") if t.strip()],
        _sub("s", "[\"']"),
        _sub("s", rf"(?i){_WS}*yEnc{_WS}*", " "),
        _sub("s", rf"(?i){_WS}*-?{_WS}*File{_WS}+\d+{_WS}+of{_WS}+\d+{_WS}*-?{_WS}*", " "),
        _sub("s", r"[&\-\\/,.:;!?(){}\[\]]", " "),
        "CASE WHEN length(s) > 10 THEN substring(s, 1, length(s) - 10) || replace(substring(s, length(s) - 9, 10), '_', ' ') ELSE replace(s, '_', ' ') END",
        _sub("s", rf"(?:{_WS}|[\d_])+$"),
        _strip(_sub("s", rf"{_WS}+", " ")),
        _strip("substring(s, 1, 100)"),
    ]
    q = f"SELECT *, coalesce(subject, '') AS s FROM {source}"
    for step in steps:
        q = f"SELECT * REPLACE ({step} AS s) FROM ({q})"
    return f"(SELECT *, s AS collection FROM ({q}))"


KEPT = "(SELECT * FROM articles WHERE message_id IS NULL UNION ALL SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY group_name, message_id ORDER BY ord) AS rn FROM articles WHERE message_id IS NOT NULL) WHERE rn = 1)"


def _parts(source: str = KEPT) -> str:
    s = "coalesce(subject, '')"
    return (
        f"(SELECT *, coalesce(from_addr, '') AS poster, {_base(s)} AS base, {_counter(s, 1, False)} AS n_left, {_counter(s, 2, False)} AS m_left, "
        f"{_counter(s, 1, True)} AS n_right, {_counter(s, 2, True)} AS m_right FROM {source})"
    )


def _strategy(parts: str, scope: str) -> str:
    keys = f"{scope}, " if scope else ""
    by = f"GROUP BY {scope}" if scope else ""

    def side(m: str) -> str:
        return f"(SELECT {keys}count(*) FILTER (WHERE c > 1) AS k FROM (SELECT {keys}base, {m}, poster, count(*) AS c FROM {parts} WHERE m_left IS NOT NULL GROUP BY {keys}base, {m}, poster) {by})"

    on = f"JOIN {side('m_right')} r USING ({scope})" if scope else f"CROSS JOIN {side('m_right')} r"
    return f"SELECT {keys}l.k AS multi_left, r.k AS multi_right, r.k > l.k AS takes_right FROM {side('m_left')} l {on}"


def _sets(scope: str, source: str = KEPT) -> str:
    """Common tables ``parts``, ``chosen`` (with m) and ``sets``."""
    return (
        f"WITH parts AS MATERIALIZED (SELECT * FROM {_parts(source)}), choice AS ({_strategy('parts', scope)}), "
        f"chosen AS (SELECT p.*, CASE WHEN takes_right THEN m_right ELSE m_left END AS m FROM parts p JOIN choice USING ({scope}) WHERE m_left IS NOT NULL), "
        f"sets AS (SELECT {scope}, base, m, poster, count(*) AS n_rows, count(DISTINCT CASE WHEN n_right BETWEEN 1 AND m THEN n_right END) AS n_parts, min(artnum) AS first_pos, "
        f"CAST(sum(coalesce(bytes, 0)) AS BIGINT) AS total_bytes, ends_with(lower(base), '.exe') AS is_program FROM chosen GROUP BY {scope}, base, m, poster), "
        f"judged AS (SELECT *, n_rows >= m AND n_parts = greatest(m, 0) AS complete FROM sets) "
    )


def _like(c: str, term: str) -> str:
    fold = f"translate({c}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return f"{fold} LIKE {_q('%' + term.lower() + '%')}"


def _instant(source: str = "articles") -> str:
    """``SELECT ord, date_utc, us``: the instants of all written dates of ``source`` (ord, date_utc)."""
    zone = r"(?:\s*(?:([+-]\d{2}:?\d{2})|([A-Za-z]{1,5})|([A-Za-z_]+(?:/[A-Za-z_+0-9-]+)+)))?"
    time = r"(\d{1,2}):(\d{2})(?::(\d{2})(?:[.,](\d+))?)?"
    end = r"\s*(?:\([^()]*\))?\s*$"
    # Per form: pattern and the group numbers of year, month name, month, day, hour, minute, second, fraction, half, offset, letters, region.
    forms = [
        (r"^\s*(\d{4})-(\d{2})-(\d{2})(?:[Tt]|\s+)" + time + zone + end, dict(y=1, m=2, d=3, h=4, mi=5, s=6, f=7, o=8, z=9, r=10)),
        (r"^\s*(\d{4})(\d{2})(\d{2})[Tt](\d{2})(\d{2})(\d{2})?(?:[.,](\d+))?" + zone + end, dict(y=1, m=2, d=3, h=4, mi=5, s=6, f=7, o=8, z=9, r=10)),
        (r"^\s*(?:[A-Za-z]{2,10}\.?,?\s+)?(\d{1,2})\.?\s+(\p{L}+)\.?,?\s+(\d{4}|\d{2})\s+" + time + zone + end, dict(d=1, n=2, y=3, h=4, mi=5, s=6, f=7, o=8, z=9, r=10)),
        (r"^\s*(\d{1,2})\.(\d{1,2})\.(\d{4}|\d{2}),?\s+" + time + zone + end, dict(d=1, m=2, y=3, h=4, mi=5, s=6, f=7, o=8, z=9, r=10)),
        (r"^\s*(?:[A-Za-z]{2,10},?\s+)?(\p{L}+)\s+(\d{1,2})\s+" + time + r"\s+(\d{4})" + end, dict(n=1, d=2, h=3, mi=4, s=5, f=6, y=7)),
        (r"^\s*(\p{L}+)\.?\s+(\d{1,2}),\s+(\d{4}|\d{2})\s+" + time + r"(?:\s*([AaPp][Mm]))?" + zone + end, dict(n=1, d=2, y=3, h=4, mi=5, s=6, f=7, p=8, o=9, z=10, r=11)),
    ]
    from threadloom.functions.timestamps import MONTHS, ZONE_MINUTES

    months = "MAP {" + ", ".join(f"{_q(n)}: {k}" for k, names in MONTHS.items() for n in names) + "}"
    zones = "MAP {" + ", ".join(f"{_q(z)}: {m}" for z, m in ZONE_MINUTES.items()) + "}"
    parts = []
    for k, (pattern, at) in enumerate(forms):
        names = ", ".join(_q(next(x for x, g in at.items() if g == i)) for i in range(1, len(at) + 1))
        got = f"regexp_extract(date_utc, {_q(pattern)}, [{names}])"
        take = ", ".join(f"nullif({got}.{x}, '') AS {x}" if x in at else f"CAST(NULL AS VARCHAR) AS {x}" for x in "y n m d h mi s f p o z r".split())
        before = " AND ".join(f"NOT regexp_matches(date_utc, {_q(p)})" for p, _ in forms[:k]) or "true"
        parts.append(f"SELECT ord, date_utc, {take} FROM {source} WHERE regexp_matches(date_utc, {_q(pattern)}) AND {before}")
    cut = " UNION ALL ".join(parts)
    num = (
        f"SELECT ord, date_utc, CASE WHEN length(y) = 2 THEN 2000 + CAST(y AS BIGINT) ELSE CAST(y AS BIGINT) END AS y, coalesce(CAST(m AS BIGINT), {months}[lower(n)]) AS m, CAST(d AS BIGINT) AS d, "
        "CASE WHEN p IS NULL THEN CAST(h AS BIGINT) WHEN CAST(h AS BIGINT) BETWEEN 1 AND 12 THEN CAST(h AS BIGINT) % 12 + CASE WHEN lower(p) = 'pm' THEN 12 ELSE 0 END END AS h, CAST(mi AS BIGINT) AS mi, "
        f"coalesce(CAST(s AS BIGINT), 0) AS s, CAST(rpad(left(coalesce(f, '0'), 6), 6, '0') AS BIGINT) AS us, o, z, r FROM ({cut})"
    )
    day = "try_cast(printf('%04d-%02d-%02d', y, m, d) AS DATE)"
    wall = f"SELECT *, CASE WHEN y >= 1 AND h <= 23 AND mi <= 59 AND s <= 59 THEN epoch_us(CAST({day} AS TIMESTAMP)) + h * 3600000000 + mi * 60000000 + s * 1000000 + us END AS w FROM ({num})"
    off = "CASE WHEN o IS NOT NULL THEN (CASE WHEN left(o, 1) = '-' THEN -1 ELSE 1 END) * (CAST(substring(o, 2, 2) AS BIGINT) * 60 + CAST(right(o, 2) AS BIGINT)) " f"WHEN length(z) = 1 THEN 0 ELSE {zones}[upper(z)] END"
    local = "timezone(coalesce(r, 'Europe/Berlin'), make_timestamp(w))"
    # The engine takes the later of two readings; the earlier one is wanted.
    first = f"CASE WHEN timezone(coalesce(r, 'Europe/Berlin'), {local} - INTERVAL 1 HOUR) = make_timestamp(w) THEN epoch_us({local}) - 3600000000 ELSE epoch_us({local}) END"
    written = f"SELECT ord, date_utc, CASE WHEN o IS NOT NULL OR z IS NOT NULL THEN w - ({off}) * 60000000 ELSE {first} END AS us FROM ({wall})"
    digits = r"^\s*(\d{1,19})\s*(?:\([^()]*\))?\s*$"
    e = f"CAST(regexp_extract(date_utc, {_q(digits)}, 1) AS HUGEINT)"
    n = f"length(regexp_extract(date_utc, {_q(digits)}, 1))"
    count = f"SELECT ord, date_utc, CASE WHEN {n} <= 11 THEN {e} * 1000000 WHEN {n} <= 14 THEN {e} * 1000 WHEN {n} <= 17 THEN {e} ELSE {e} // 1000 END AS us FROM {source} WHERE regexp_matches(date_utc, {_q(digits)})"
    return f"(SELECT ord, date_utc, CAST(us AS BIGINT) AS utc_us FROM ({written} UNION ALL {count}))"


def _threads() -> str:
    """Common tables of reply threads: nodes, up (id, parent)."""
    return (
        "WITH RECURSIVE nodes AS (SELECT message_id, arg_min(coalesce(refs, ''), ord) AS refs FROM articles WHERE message_id IS NOT NULL GROUP BY message_id), "
        f"given AS (SELECT message_id, unnest(regexp_extract_all(refs, {_q(_ID)})) AS ref, generate_subscripts(regexp_extract_all(refs, {_q(_ID)}), 1) AS pos FROM nodes), "
        "up AS MATERIALIZED (SELECT g.message_id AS id, arg_max(g.ref, g.pos) AS parent FROM given g JOIN nodes n ON n.message_id = g.ref GROUP BY g.message_id), "
        "walk AS (SELECT id, parent AS anc FROM up UNION SELECT w.id, u.parent FROM walk w JOIN up u ON u.id = w.anc), "
        "reach AS (SELECT DISTINCT id, anc FROM walk), "
        "loops AS (SELECT id FROM reach WHERE id = anc), "
        "root AS (SELECT r.id, count(*) AS depth, max(CASE WHEN u.id IS NULL THEN r.anc END) AS top, min(CASE WHEN l.id IS NOT NULL THEN r.anc END) AS loop FROM reach r LEFT JOIN up u ON u.id = r.anc LEFT JOIN loops l ON l.id = r.anc GROUP BY r.id) "
    )


def _escaped(s: str, attribute: bool) -> str:
    s = _sub(s, r"[\x00-\x08\x0b\x0c\x0e-\x1f\x{FFFE}\x{FFFF}]")
    pairs = [("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")]
    for a, b in pairs:
        s = f"replace({s}, {_q(a)}, {_q(b)})"
    for c, b in ((34, "&quot;"), (13, "&#13;"), (10, "&#10;"), (9, "&#9;")) if attribute else ():
        s = f"replace({s}, chr({c}), {_q(b)})"
    return s


def _empty() -> str:
    from threadloom.plans.manifests import DECLARATION, DOCTYPE, NAMESPACE

    return f"'{DECLARATION}' || chr(10) || '{DOCTYPE}' || chr(10) || '<nzb xmlns=\"{NAMESPACE}\"/>' || chr(10)"


def _documents(scope: str, date: int) -> str:
    """Common table ``docs`` (scope, xml) after those of :func:`_sets`."""
    from threadloom.plans.manifests import DECLARATION, DOCTYPE, NAMESPACE, PIECES

    text_id = f"regexp_replace({_strip('coalesce(message_id, ' + _q('') + ')')}, '(?s)^<(.*)>$', '\\1')"
    same = " AND ".join(f"c.{k} = j.{k}" for k in [*scope.split(", "), "base", "m", "poster"])
    nl = "' || chr(10) || '"
    seg = f"'      <segment bytes=\"' || bytes || '\" number=\"' || number || CASE WHEN id = '' THEN '\"/>' ELSE '\">' || {_escaped('id', False)} || '</segment>' END || chr(10)"
    first = f"'  <file poster=\"' || {_escaped('who', True)} || '\" date=\"{date}\" subject=\"' || {_escaped('base', True)} || '\">{nl}    <groups>{nl}      <group>' || {_escaped('group_name', False)} || '</group>{nl}    </groups>{nl}    <segments>{nl}'"
    head = f"'{DECLARATION}{nl}{DOCTYPE}{nl}<nzb xmlns=\"{NAMESPACE}\">{nl}'"
    sets = f"SELECT {scope}, base, m, poster AS who, first_pos"
    return (
        f", emitted AS ({sets} FROM judged WHERE complete AND NOT is_program), "
        f"segs AS (SELECT c.*, j.first_pos, n_right AS number, artnum AS pos, {text_id} AS id FROM (SELECT * REPLACE (coalesce(bytes, 0) AS bytes) FROM chosen) c JOIN judged j ON j.complete AND NOT j.is_program AND {same}), "
        f"pieces AS (SELECT DISTINCT {scope}, 0 AS section, NULL::BIGINT AS first_pos, NULL AS base, NULL::BIGINT AS m, NULL AS who, 0 AS kind, NULL::BIGINT AS number, NULL::BIGINT AS pos, NULL::BIGINT AS bytes, NULL AS id, {head} AS xml FROM emitted "
        f"UNION ALL SELECT DISTINCT {scope}, 2, NULL, NULL, NULL, NULL, 0, NULL, NULL, NULL, NULL, '</nzb>{nl}' FROM emitted "
        f"UNION ALL SELECT {scope}, 1, first_pos, base, m, who, 0, NULL, NULL, NULL, NULL, {first} FROM emitted "
        f"UNION ALL SELECT {scope}, 1, first_pos, base, m, poster, 1, number, pos, bytes, id, {seg} FROM segs "
        f"UNION ALL SELECT {scope}, 1, first_pos, base, m, who, 2, NULL, NULL, NULL, NULL, '    </segments>{nl}  </file>{nl}' FROM emitted), "
        f"placed AS (SELECT *, row_number() OVER (PARTITION BY {scope} ORDER BY section, first_pos, base, m, who, kind, number, pos, bytes, id) AS place FROM pieces), "
        f"docs AS (SELECT {scope}, (place - 1) // {PIECES} AS block, string_agg(xml, '' ORDER BY place) AS xml FROM placed GROUP BY {scope}, (place - 1) // {PIECES}) "
    )


def statements(asof_us: int, group: str) -> dict[str, str]:
    cols = "message_id, subject, from_addr, date_utc, bytes, artnum, group_name, ord"
    kept_named = _collection(KEPT)
    scope3 = "group_name, poster, collection"
    named = f"(SELECT *, coalesce(from_addr, '') AS poster FROM {kept_named})"
    file_base = "regexp_replace(substring(poster, 1, 50), '[^\\p{L}\\p{N} _-]', '_', 'g') || '_' || regexp_replace(substring(CASE WHEN collection = '' THEN 'misc' ELSE collection END, 1, 50), '[^\\p{L}\\p{N} _-]', '_', 'g')"
    # The collection's scope has poster already; the parts view makes it again.
    parts3 = f"(SELECT * FROM {_parts(kept_named)})"
    sets3 = _sets(scope3, kept_named)
    numbered = (
        f", shown AS (SELECT {scope3}, count(*) AS n_sets FROM judged WHERE NOT is_program " "{only}" f" GROUP BY {scope3}), "
        f"firsts AS (SELECT {scope3}, min(coalesce(subject, '') || chr(1) || lpad(CAST(artnum AS VARCHAR), 20, '0')) AS first FROM {named} GROUP BY {scope3}), "
        f"based AS (SELECT *, {file_base} AS base_name FROM shown JOIN firsts USING ({scope3})), "
        "files AS (SELECT *, row_number() OVER (PARTITION BY group_name, base_name ORDER BY poster, first) AS k FROM based) "
    )
    files = f"SELECT {scope3}, base_name || CASE WHEN k > 1 THEN '_' || k ELSE '' END || '.nzb' AS file_name, n_sets FROM files"
    field = lambda name: f"fields[list_sort(list_filter(map_keys(fields), lambda k: contains(lower(k), {_q(name)})))[1]]"
    num = lambda c: f"CASE WHEN coalesce({c}, '') = '' THEN 0 ELSE try_cast(trim({c}) AS BIGINT) END"
    wire = (
        f"(SELECT group_name, artnum, {field(FIELDS['message_id'])} AS message_id, coalesce({field(FIELDS['subject'])}, '') AS subject, coalesce({field(FIELDS['from_addr'])}, '') AS from_addr, "
        f"{field(FIELDS['date_utc'])} AS date_utc, {field(FIELDS['refs'])} AS refs, {num(field(FIELDS['bytes']))} AS bytes, {num(field(FIELDS['lines']))} AS lines, {field(FIELDS['xref'])} AS xref FROM overviews WHERE artnum IS NOT NULL)"
    )
    values = (
        f"SELECT ord, 'refs' AS field, pos, value FROM (SELECT ord, unnest(v) AS value, CAST(generate_subscripts(v, 1) AS BIGINT) AS pos FROM (SELECT ord, regexp_extract_all(refs, {_q(_ID)}) AS v FROM articles)) "
        "UNION ALL SELECT ord, 'xref', row_number() OVER (PARTITION BY ord ORDER BY k), value FROM (SELECT ord, unnest(v) AS value, generate_subscripts(v, 1) AS k FROM (SELECT ord, regexp_split_to_array(xref, '[\\s,;|\"''\\[\\](){}<>]+') AS v FROM articles)) "
        "JOIN (SELECT DISTINCT group_name FROM newsgroups) ON regexp_extract(value, '^(.+):\\d+$', 1) = group_name"
    )
    dated = f"(SELECT a.ord, a.group_name, a.artnum, i.utc_us AS us FROM articles a JOIN {_instant()} i USING (ord) WHERE i.utc_us IS NOT NULL)"
    plan = lambda chunk, end: f"SELECT group_name, chunk_start, least(chunk_start + {chunk - 1}, e) AS chunk_end FROM (SELECT group_name, {end} AS e, unnest(generate_series(first_article, {end}, {chunk})) AS chunk_start FROM newsgroups WHERE last_article >= first_article)"
    added = "n AS (SELECT group_name, artnum, message_id FROM w WHERE message_id IS NULL UNION ALL SELECT group_name, min(artnum), message_id FROM w WHERE message_id IS NOT NULL GROUP BY group_name, message_id)"
    iso_wire = f"WITH w AS MATERIALIZED (SELECT row_number() OVER () AS ord, * FROM {wire}) SELECT w.* EXCLUDE (ord) REPLACE (strftime(make_timestamp(i.utc_us), '%Y-%m-%dT%H:%M:%S') || '+00:00' AS date_utc) FROM w LEFT JOIN {_instant('w')} i ON i.ord = w.ord"
    return {
        "p2_found": "SELECT from_addr FROM articles WHERE from_addr <> '' GROUP BY from_addr HAVING count(*) >= 0.03 * (SELECT count(*) FROM articles)",
        "p2_totals": f"SELECT from_addr, count(*) AS n_rows, CAST(sum(coalesce(bytes, 0)) AS BIGINT) AS total_bytes, min(utc_us) AS first_us, max(utc_us) AS last_us FROM articles LEFT JOIN {_instant()} i USING (ord) GROUP BY from_addr",
        "p4_found": _threads() + "SELECT id AS message_id, coalesce(loop, top) AS root_id, CASE WHEN loop IS NULL THEN CAST(depth AS BIGINT) ELSE -1 END AS depth FROM root",
        "p4_trees": _threads()
        + ", sound AS (SELECT id, depth, top FROM root WHERE loop IS NULL UNION ALL SELECT message_id, 0, message_id FROM nodes WHERE message_id NOT IN (SELECT id FROM up)), "
        + "above AS (SELECT r.id, list(r.anc ORDER BY s.depth) AS names FROM reach r JOIN sound s ON s.id = r.anc GROUP BY r.id), below AS (SELECT r.anc AS id, count(*) AS n FROM reach r JOIN sound s ON s.id = r.id GROUP BY r.anc) "
        + "SELECT n.message_id, coalesce(x.loop, x.top, n.message_id) AS root_id, CASE WHEN x.loop IS NOT NULL THEN -1 ELSE CAST(coalesce(x.depth, 0) AS BIGINT) END AS depth, "
        + "CASE WHEN x.loop IS NULL THEN list_append(coalesce(a.names, []), n.message_id) END AS path, CASE WHEN x.loop IS NULL THEN coalesce(b.n, 0) END AS n_descendants "
        + "FROM nodes n LEFT JOIN root x ON x.id = n.message_id LEFT JOIN above a ON a.id = n.message_id LEFT JOIN below b ON b.id = n.message_id",
        "p4_descendants": _threads() + ", sound AS (SELECT id, depth FROM root WHERE loop IS NULL) SELECT r.anc AS message_id, r.id AS descendant_id, CAST(s.depth - coalesce(t.depth, 0) AS BIGINT) AS distance FROM reach r JOIN sound s ON s.id = r.id LEFT JOIN sound t ON t.id = r.anc",
        "p5_found": f"SELECT ord, utc_us FROM {_instant()} WHERE utc_us IS NOT NULL AND NOT regexp_matches(date_utc, {_q(_STORED)})",
        "p5_all": f"SELECT a.ord, i.utc_us FROM articles a LEFT JOIN {_instant()} i USING (ord)",
        "p6_values": values,
        "p6_found": f"WITH v AS ({values}) SELECT v.* FROM v JOIN (SELECT ord, field FROM v GROUP BY ord, field HAVING count(*) >= 2) USING (ord, field)",
        "articles_projection": f"SELECT {cols} FROM articles",
        "group_filter": f"SELECT {cols} FROM articles WHERE group_name = {_q(group)}",
        "subject_like": f"SELECT ord, subject FROM articles WHERE {_like('subject', 'window')}",
        "subject_like_wildcard": f"SELECT ord, subject FROM articles WHERE {_like('subject', 'p_rt%of 2')}",
        "subject_like_terms": f"SELECT ord, subject FROM articles WHERE {_like('subject', 'yenc')} AND {_like('subject', 'garden')}",
        "poster_like": f"SELECT ord, from_addr FROM articles WHERE {_like('from_addr', 'grum & sons')}",
        "subject_not_any": "SELECT ord, subject FROM articles WHERE " + " AND ".join(f"NOT {_like('subject', t)}" for t in ("yenc", "part", "re:")),
        "poster_not_any": "SELECT ord, from_addr FROM articles WHERE " + " AND ".join(f"NOT {_like('from_addr', t)}" for t in ("example", "robot")),
        "combined_filters": f"SELECT ord, subject, from_addr FROM articles WHERE group_name = {_q(group)} AND {_like('subject', 'yenc')} AND {_like('from_addr', 'a')} AND NOT {_like('subject', '.exe')} AND NOT {_like('subject', '.nfo')} AND NOT {_like('from_addr', 'anon')}",
        "order_by_artnum": "SELECT ord, group_name, artnum, row_number() OVER (PARTITION BY group_name ORDER BY artnum, ord) AS place FROM articles",
        "order_by_artnum_limit": "SELECT * FROM (SELECT ord, group_name, artnum, row_number() OVER (PARTITION BY group_name ORDER BY artnum, ord) AS place FROM articles) WHERE place <= 10",
        "order_by_poster_subject": "SELECT ord, row_number() OVER (ORDER BY coalesce(from_addr, ''), coalesce(subject, ''), artnum, ord) AS place FROM articles",
        "dedup_first_wins": f"SELECT ord, group_name, message_id FROM {KEPT}",
        "dedup_by_message_id": "SELECT ord, message_id FROM articles WHERE message_id IS NULL UNION ALL SELECT min(ord), message_id FROM articles WHERE message_id IS NOT NULL GROUP BY message_id",
        "null_ids_kept": "SELECT group_name, count(*) AS n FROM articles WHERE message_id IS NULL GROUP BY group_name",
        "upsert_ignore_existing": f"WITH w AS (SELECT * FROM {wire}), n AS (SELECT group_name, artnum, message_id FROM w WHERE message_id IS NULL UNION ALL SELECT group_name, min(artnum), message_id FROM w WHERE message_id IS NOT NULL GROUP BY group_name, message_id) SELECT * FROM n WHERE NOT EXISTS (SELECT 1 FROM articles a WHERE a.group_name = n.group_name AND a.message_id = n.message_id)",
        "high_water_marks": "SELECT g.group_name, coalesce(max(artnum), 0) AS db_max, coalesce(min(artnum), 0) AS db_min FROM newsgroups g LEFT JOIN articles a USING (group_name) GROUP BY g.group_name",
        "next_ranges": "SELECT * FROM (SELECT g.group_name, CASE WHEN coalesce(max(artnum), 0) > 0 THEN max(artnum) + 1 ELSE first_article END AS lo, last_article AS hi FROM newsgroups g LEFT JOIN articles a USING (group_name) GROUP BY g.group_name, first_article, last_article) WHERE lo <= hi",
        "group_counts": "SELECT group_name, CASE WHEN first_article IS NOT NULL AND last_article IS NOT NULL THEN last_article - first_article + 1 ELSE 0 END AS article_count FROM newsgroups",
        "groups_replace": f"WITH n AS (SELECT group_name, min(artnum) AS a, max(artnum) AS b FROM articles GROUP BY group_name) SELECT group_name, a AS first_article, b AS last_article, b - a + 1 AS article_count, 'y' AS status_flag, CAST({asof_us} AS BIGINT) AS updated_us FROM n UNION ALL SELECT group_name, first_article, last_article, article_count, status_flag, epoch_us(last_updated) FROM newsgroups WHERE group_name NOT IN (SELECT group_name FROM n)",
        "subject_base": f"SELECT ord, {_base('subject')} AS base FROM articles",
        "counters": f"SELECT ord, {_counter('subject', 1, False)} AS n_left, {_counter('subject', 2, False)} AS m_left, {_counter('subject', 1, True)} AS n_right, {_counter('subject', 2, True)} AS m_right FROM articles",
        "message_id_text": f"SELECT ord, regexp_replace({_strip(chr(99) + 'oalesce(message_id, ' + _q('') + ')')}, '(?s)^<(.*)>$', '\\1') AS id FROM articles",
        "sanitize_filename": "SELECT ord, regexp_replace(substring(subject, 1, 30), '[^\\p{L}\\p{N} _-]', '_', 'g') AS name FROM articles",
        "collection_name": f"SELECT ord, collection FROM {_collection('articles')}",
        "collection_name_without_term": f"SELECT ord, collection FROM {_collection('articles', 'lantern%file')}",
        "to_iso": f"SELECT a.ord, strftime(make_timestamp(utc_us), '%Y-%m-%dT%H:%M:%S') || '+00:00' AS iso FROM articles a LEFT JOIN {_instant()} i USING (ord)",
        "singles": f"SELECT ord, base FROM {_parts()} WHERE m_left IS NULL",
        "strategy_choice": _strategy(_parts(), ""),
        "strategy_by_group": _strategy(_parts(), "group_name"),
        "strategy_by_collection": _strategy(parts3, scope3),
        "set_sizes": _sets("group_name") + "SELECT group_name, base, m, poster, n_rows, n_parts, first_pos, total_bytes, complete, is_program FROM judged",
        "complete_sets": _sets("group_name") + "SELECT group_name, base, m, poster, n_rows, first_pos FROM judged WHERE complete AND NOT is_program",
        "missing_parts": _sets("group_name")
        + ", k AS (SELECT DISTINCT group_name, base, m, poster, n_right AS part FROM chosen WHERE n_right BETWEEN 1 AND m UNION SELECT group_name, base, m, poster, unnest([0, m + 1]) FROM sets WHERE m >= 1), "
        + "g AS (SELECT *, lead(part) OVER (PARTITION BY group_name, base, m, poster ORDER BY part) AS after FROM k) SELECT group_name, base, m, poster, part + 1 AS first_part, after - 1 AS last_part FROM g WHERE after > part + 1",
        "programs_dropped": _sets("group_name", f"(SELECT * REPLACE (replace(subject, chr(34), '') AS subject) FROM {KEPT})") + "SELECT group_name, base, m, poster, n_rows FROM sets WHERE is_program",
        "segments_sorted": _sets("group_name")
        + "SELECT c.group_name, c.base, c.m, c.poster, row_number() OVER (PARTITION BY c.group_name, c.base, c.m, c.poster ORDER BY n_right, ord) AS place, n_right AS number, coalesce(bytes, 0) AS bytes, "
        + f"regexp_replace({_strip(chr(99) + 'oalesce(message_id, ' + _q('') + ')')}, '(?s)^<(.*)>$', '\\1') AS id FROM chosen c JOIN judged j ON j.complete AND NOT j.is_program AND j.group_name = c.group_name AND j.base = c.base AND j.m = c.m AND j.poster = c.poster",
        "collections": f"SELECT {scope3}, count(*) AS n_rows FROM {named} GROUP BY {scope3}",
        "collection_files": sets3 + numbered.replace("{only}", "") + files,
        "collection_files_complete": sets3 + numbered.replace("{only}", "AND complete") + files,
        "manifest_totals": sets3
        + numbered.replace("{only}", "AND complete")
        + f"SELECT group_name, n_collections, coalesce(n_files, 0) AS n_files, n_collections - coalesce(n_files, 0) AS n_skipped FROM (SELECT group_name, count(*) AS n_collections FROM firsts GROUP BY group_name) LEFT JOIN (SELECT group_name, count(*) AS n_files FROM files GROUP BY group_name) USING (group_name)",
        "manifest_single": _sets("group_name")
        + _documents("group_name", asof_us // 1_000_000)
        + f"SELECT group_name, 'output.nzb' AS file_name, coalesce(block, 0) AS block, coalesce(xml, {_empty()}) AS xml FROM (SELECT DISTINCT group_name FROM {KEPT}) LEFT JOIN docs USING (group_name)",
        "manifest_grouped": sets3 + numbered.replace("{only}", "AND complete") + _documents(scope3, asof_us // 1_000_000) + f"SELECT d.group_name, f.file_name, d.block, d.xml FROM docs d JOIN ({files}) f USING ({scope3})",
        "age_days": f"SELECT ord, floor(({asof_us} - us) / CAST(86400000000.0 AS DOUBLE) * CAST(1000 AS DOUBLE)) / CAST(1000 AS DOUBLE) AS age FROM {dated}",
        "date_boundaries": f"WITH r AS (SELECT group_name, artnum, ({asof_us} - us) / CAST(86400000000.0 AS DOUBLE) AS age FROM {dated}), g AS (SELECT group_name, coalesce(max(artnum) FILTER (WHERE age >= 200), min(artnum)) AS a, coalesce(min(artnum) FILTER (WHERE age <= 400), max(artnum)) AS b, "
        "max(artnum) FILTER (WHERE age >= 200) IS NULL AS no_a, min(artnum) FILTER (WHERE age <= 400) IS NULL AS no_b FROM r GROUP BY group_name HAVING min(age) <= 400 AND max(age) >= 200), "
        "x AS (SELECT g.*, (SELECT max(age) FROM r WHERE r.group_name = g.group_name AND artnum = a AND (no_a OR age >= 200)) AS age_a, (SELECT max(age) FROM r WHERE r.group_name = g.group_name AND artnum = b AND (no_b OR age <= 400)) AS age_b FROM g) "
        "SELECT group_name, least(a, b) AS lower, greatest(a, b) AS upper, floor(CASE WHEN a > b THEN age_b ELSE age_a END * CAST(1000 AS DOUBLE)) / CAST(1000 AS DOUBLE) AS lower_age, floor(CASE WHEN a > b THEN age_a ELSE age_b END * CAST(1000 AS DOUBLE)) / CAST(1000 AS DOUBLE) AS upper_age FROM x",
        "chunk_plan": plan(1000, "last_article"),
        "chunk_plan_limit": plan(100, "least(last_article, first_article + 249)"),
        "chunk_row_counts": f"SELECT p.group_name, p.chunk_start, count(a.artnum) AS n FROM ({plan(1000, 'last_article')}) p LEFT JOIN articles a ON a.group_name = p.group_name AND a.artnum BETWEEN p.chunk_start AND p.chunk_end GROUP BY p.group_name, p.chunk_start",
        "overview_records": iso_wire,
        "overview_source": iso_wire,
        "catalog_listing": "SELECT group_name, min(artnum) AS first_article, max(artnum) AS last_article, max(artnum) - min(artnum) + 1 AS article_count, 'y' AS status_flag FROM overviews WHERE artnum IS NOT NULL GROUP BY group_name",
        "upsert_written": f"WITH w AS (SELECT * FROM {wire}), {added} SELECT group_name, artnum, message_id FROM {KEPT} UNION ALL SELECT * FROM n WHERE NOT EXISTS (SELECT 1 FROM articles a WHERE a.group_name = n.group_name AND a.message_id = n.message_id)",
        "reload_written": f"WITH w AS (SELECT * FROM {wire}), {added} SELECT group_name, artnum, message_id FROM {KEPT} WHERE group_name NOT IN (SELECT group_name FROM w) UNION ALL SELECT * FROM n",
        "archive_roundtrip": "SELECT message_id, group_name, artnum, subject, from_addr, date_utc, refs, bytes, lines, xref FROM articles",
        "manifests_read_back": sets3 + _documents(scope3, asof_us // 1_000_000) + "SELECT number, bytes, id FROM segs WHERE id <> ''",
        "file_reduction": sets3 + numbered.replace("{only}", "AND complete") + "SELECT group_name, CAST(sum(n_sets) AS BIGINT) AS n_ungrouped, count(*) AS n_grouped FROM files GROUP BY group_name",
        "nzb_segments": "SELECT _poster AS poster, _date AS date, _subject AS subject, coalesce(len(groups['group']), 0) AS n_groups, s._number AS number, s._bytes AS bytes, s._VALUE AS id FROM (SELECT *, unnest(segments.segment) AS s FROM nzb_files)",
        "nzb_segments_stored": f"WITH s AS (SELECT DISTINCT _subject AS subject, s._number AS number, s._VALUE AS id FROM (SELECT *, unnest(segments.segment) AS s FROM nzb_files)) SELECT s.subject, s.number, s.id, k.group_name, k.artnum FROM s JOIN {KEPT} k ON regexp_replace(k.message_id, '(?s)^<(.*)>$', '\\1') = s.id",
    }
