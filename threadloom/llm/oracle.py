"""Those text queries that SQL can express, in SQL."""

from __future__ import annotations

from threadloom.llm import lookalike as L


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _pairs() -> str:
    return (
        "WITH RECURSIVE w AS MATERIALIZED (SELECT DISTINCT ord, unnest(regexp_extract_all(lower(coalesce(subject, '') || ' ' || coalesce(from_addr, '')), '[a-z0-9]+')) AS word FROM articles WHERE contains(group_name, '.forsale.')), "
        "n AS MATERIALIZED (SELECT ord, count(*) AS k FROM w GROUP BY ord), "
        "c AS (SELECT a.ord AS ord_a, b.ord AS ord_b, count(*) AS common FROM w a JOIN w b ON a.word = b.word AND a.ord < b.ord GROUP BY a.ord, b.ord), "
        "p AS MATERIALIZED (SELECT ord_a, ord_b FROM c JOIN n x ON x.ord = ord_a JOIN n y ON y.ord = ord_b WHERE common >= 0.6 * (x.k + y.k - common))"
    )


def _kinds() -> str:
    """By the definitions alone, without the operator's tables: a look-alike is a letter of another script inside a word that keeps Latin, Cyrillic or Greek letters."""
    latin, cyrillic, greek, armenian = r"[A-Za-z\x{C0}-\x{D6}\x{D8}-\x{F6}\x{F8}-\x{2AF}\x{1E00}-\x{1EFF}]", r"[\x{400}-\x{52F}]", r"[\x{370}-\x{3FF}\x{1F00}-\x{1FFF}]", r"[\x{530}-\x{58F}]"
    hidden = r"[\x{AD}\x{34F}\x{61C}\x{180E}\x{200B}-\x{200F}\x{202A}-\x{202E}\x{2060}-\x{206F}\x{FEFF}]"
    unit = rf"[\p{{L}}\p{{M}}\p{{N}}{hidden[1:-1]}]+|[\x{{FF01}}-\x{{FF5E}}\x{{A0}}\x{{2007}}\x{{202F}}]"
    has = lambda c, w="word": f"regexp_matches({w}, {_q(c)})"
    scripts = " + ".join(f"CAST({has(c)} AS INT)" for c in (latin, cyrillic, greek, armenian))
    kinds = [
        (has(r"[\x{FF01}-\x{FF5E}]"), "fullwidth"),
        (has(rf"\p{{L}}{hidden}*[\x{{300}}-\x{{34E}}\x{{350}}-\x{{36F}}]"), "combining"),
        (has(hidden), "invisible"),
        (has(r"[\x{A0}\x{2007}\x{202F}]"), "space"),
        (f"({scripts}) > 1 OR ({has('[ɡɑı]')} AND {has(latin.replace('A-Za-z', 'A-Za-z'), 'translate(word, ' + _q('ɡɑı') + ', ' + _q('') + ')')})", "lookalike"),
    ]
    cases = ", ".join(f"CASE WHEN {c} THEN '{k}' END" for c, k in kinds)
    return (
        f"WITH u AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(text, {_q(unit)})) AS word FROM documents), o AS (SELECT * FROM u WHERE regexp_matches(word, '[^\\x00-\\x7F]')), "
        f"k AS (SELECT doc_id, unnest(list_filter([{cases}], lambda x: x IS NOT NULL)) AS kind FROM o) SELECT DISTINCT doc_id, kind FROM k"
    )


def _leaks() -> str:
    """Ten-word stretches in common.  Items are in Latin script, so every look-alike may be read as a Latin letter here."""
    wide = "".join(chr(c) for c in range(0xFF01, 0xFF5F))
    narrow = "".join(chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F))
    hidden = r"[\x{AD}\x{34F}\x{61C}\x{180E}\x{200B}-\x{200F}\x{202A}-\x{202E}\x{2060}-\x{206F}\x{FEFF}]"
    bare = f"regexp_replace(translate(nfc_normalize(text), {_q(wide + L.HARD_SPACE)}, {_q(narrow + ' ' * len(L.HARD_SPACE))}), {_q(hidden)}, '', 'g')"
    plain = f"lower(translate({bare}, {_q(''.join(L.LATIN_FOR))}, {_q(''.join(L.LATIN_FOR.values()))}))"

    def grams(key: str, table: str) -> str:
        words = f"SELECT {key}, regexp_extract_all({plain}, '[\\p{{L}}\\p{{N}}]+') AS w FROM {table}"
        return f"(SELECT DISTINCT {key}, array_to_string(w[i : i + 9], ' ') AS g FROM (SELECT {key}, w, unnest(generate_series(1, len(w) - 9)) AS i FROM ({words}) WHERE len(w) >= 10))"

    return f"SELECT DISTINCT doc_id, item_id FROM {grams('doc_id', 'documents')} JOIN {grams('item_id', 'eval_items')} USING (g)"


def statements() -> dict[str, str]:
    return {
        "p7_found": _leaks(),
        "p3_found": _pairs() + " SELECT ord_a, ord_b FROM p",
        "p3_groups": _pairs()
        + ", e AS MATERIALIZED (SELECT ord_a AS a, ord_b AS b FROM p UNION ALL SELECT ord_b, ord_a FROM p), r AS (SELECT ord AS a, ord AS b FROM n UNION SELECT r.a, e.b FROM r JOIN e ON e.a = r.b) "
        + "SELECT r.a AS ord, min(r.b) AS group_id, coalesce(any_value(d.n), 0) AS n_links FROM r LEFT JOIN (SELECT a, count(*) AS n FROM e GROUP BY a) d ON d.a = r.a GROUP BY r.a",
        "p9_found": _kinds(),
    }
