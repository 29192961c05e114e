"""SQL that DuckDB runs beside the queries of this subpackage."""

# Look-alike letters by their code points, Cyrillic then Greek, and the Latin letters they are drawn like. Written here again,
# so that a letter missing from the operator's table shows.
_DRAWN = "".join(map(chr, (0x410, 0x412, 0x421, 0x415, 0x41D, 0x406, 0x408, 0x41A, 0x41C, 0x41E, 0x420, 0x405, 0x422, 0x425, 0x423, 0x430, 0x441, 0x501, 0x435, 0x4BB, 0x456, 0x458, 0x4CF, 0x43E, 0x440, 0x51B, 0x455, 0x475, 0x51D, 0x445, 0x443)))
_DRAWN_GREEK = "".join(map(chr, (0x391, 0x392, 0x395, 0x396, 0x397, 0x399, 0x39A, 0x39C, 0x39D, 0x39F, 0x3A1, 0x3A4, 0x3A5, 0x3A7, 0x3BF, 0x3BD, 0x3F2, 0x3F3)))
_LATIN = "ABCEHIJKMOPSTXY" "acdehijlopqsvwxy" "ABEZHIKMNOPTYXovcj"

_P1_RANKS = """
    WITH s AS (
        SELECT row_id, run_id, field_name, strategy_score AS a, ensemble_score AS c,
               CASE WHEN page_confidence < 0 THEN NULL WHEN page_confidence > 1 THEN round(page_confidence / 100, 4)
                    ELSE page_confidence END AS b
        FROM kie_approaches),
    r AS (
        SELECT row_id, run_id, field_name,
               CASE WHEN a IS NOT NULL THEN rank() OVER (PARTITION BY run_id, field_name ORDER BY a DESC NULLS LAST) END AS rank_strategy_score,
               CASE WHEN b IS NOT NULL THEN rank() OVER (PARTITION BY run_id, field_name ORDER BY b DESC NULLS LAST) END AS rank_page_confidence,
               CASE WHEN c IS NOT NULL THEN rank() OVER (PARTITION BY run_id, field_name ORDER BY c DESC NULLS LAST) END AS rank_ensemble_score
        FROM s)
"""


def _skeleton(text: str) -> str:
    """A text with every look-alike letter in Latin: coarser than the operator's form where a text is really foreign."""
    wide = "".join(chr(c) for c in range(0xFF01, 0xFF5F))
    plain = "".join(chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F))
    quote = lambda x: "'" + x.replace("'", "''") + "'"
    out = rf"regexp_replace({text}, '\r\n?|[\x{{85}}\x{{2028}}\x{{2029}}]', chr(10), 'g')"
    out = rf"regexp_replace({out}, '\x{{AD}}+([ \t]*(?:\n|$))', '-\1', 'g')"
    out = rf"regexp_replace(regexp_replace({out}, '\p{{Cf}}', '', 'g'), '\p{{Zs}}', ' ', 'g')"
    out = rf"translate(regexp_replace({out}, '[\x{{2010}}\x{{2011}}]', '-', 'g'), {quote(wide)}, {quote(plain)})"
    for joined, letters in (("ﬀ", "ff"), ("ﬁ", "fi"), ("ﬂ", "fl"), ("ﬃ", "ffi"), ("ﬄ", "ffl")):
        out = f"replace({out}, '{joined}', '{letters}')"
    return f"nfc_normalize(translate(nfc_normalize({out}), {quote(_DRAWN + _DRAWN_GREEK)}, {quote(_LATIN)}))"


def _look_alikes(tab: str, key: str, text: str) -> str:
    forms = f"(SELECT {key} AS id, {text} AS t, md5({_skeleton(text)}) AS f FROM {tab} WHERE {text} <> '')"
    return f"SELECT '{tab}' AS tab, a.id AS id_a, b.id AS id_b FROM {forms} a JOIN {forms} b ON a.f = b.f AND a.id < b.id AND a.t <> b.t"


def _grams(tab: str, key: str) -> str:
    words = rf"regexp_extract_all(lower(strip_accents(regexp_replace(text, '\p{{Cf}}', '', 'g'))), '[\p{{L}}\p{{N}}]+')"
    return f"(SELECT {key}, array_to_string(w[i : i + 11], ' ') AS g FROM (SELECT {key}, w, unnest(generate_series(1, len(w) - 11)) AS i FROM (SELECT {key}, {words} AS w FROM {tab} WHERE text IS NOT NULL) WHERE len(w) >= 12))"


_SPANS = """
    d AS (SELECT doc_id, text, min(doc_id) OVER (PARTITION BY text) AS rep, count(*) OVER (PARTITION BY text) AS n_copies FROM documents WHERE length(text) >= 300),
    w AS (SELECT doc_id, rep, i - 1 AS s, hash(substr(text, i, 300)) AS h FROM (SELECT *, unnest(generate_series(1, length(text) - 299)) AS i FROM d)),
    m AS (SELECT * FROM w WHERE h IN (SELECT h FROM w GROUP BY h HAVING count(DISTINCT doc_id) > 1)),
    o AS (SELECT *, CASE WHEN s <= lag(s) OVER (PARTITION BY doc_id ORDER BY s) + 300 THEN 0 ELSE 1 END AS fresh FROM m),
    st AS (SELECT doc_id, min(s)::INT AS start, (max(s) + 300 - min(s))::INT AS size FROM (SELECT doc_id, s, sum(fresh) OVER (PARTITION BY doc_id ORDER BY s) AS k FROM o) GROUP BY doc_id, k),
    c AS (SELECT DISTINCT rep, h FROM m),
    l AS (SELECT a.rep AS a, b.rep AS b, count(*) AS common FROM c a JOIN c b ON a.h = b.h AND a.rep <> b.rep GROUP BY 1, 2)
"""


def _components(edges: str) -> str:
    """(rep, cluster) of every class that ``edges`` (a, b, in both directions) link."""
    return f"""r(a, b) AS (SELECT a, b FROM ({edges}) UNION SELECT r.a, e.b FROM r JOIN ({edges}) e ON r.b = e.a),
    k AS (SELECT a AS rep, least(a, min(b)) AS cluster FROM r GROUP BY a)"""


_ALIKE = """SELECT a, b FROM l JOIN (SELECT rep, max(length(text)) - 299 AS n FROM d GROUP BY rep) x ON x.rep = a JOIN (SELECT rep, max(length(text)) - 299 AS n FROM d GROUP BY rep) y ON y.rep = b
    WHERE common >= 0.8 * (x.n + y.n - common)"""

ORACLE = {
    "p2_found": _look_alikes("generated_documents", "row_no", "content") + " UNION ALL " + _look_alikes("ocr_pages", "page_row_id", "raw_text"),
    "p6_found": f"SELECT DISTINCT doc_id, item_id FROM {_grams('documents', 'doc_id')} d JOIN {_grams('eval_items', 'item_id')} i ON d.g = i.g",
    "p6_report": f"""SELECT e.item_id, count(DISTINCT f.doc_id) AS n_documents FROM eval_items e
        LEFT JOIN (SELECT doc_id, item_id FROM {_grams('documents', 'doc_id')} d JOIN {_grams('eval_items', 'item_id')} i ON d.g = i.g) f ON e.item_id = f.item_id GROUP BY e.item_id""",
    "p8_found": """
        WITH w AS (SELECT doc_id, hash(substr(text, i, 300)) AS h FROM (SELECT doc_id, text, unnest(generate_series(1, length(text) - 299)) AS i FROM documents WHERE length(text) >= 300)),
        s AS (SELECT DISTINCT doc_id, h FROM w), m AS (SELECT * FROM s WHERE h IN (SELECT h FROM s GROUP BY h HAVING count(*) > 1))
        SELECT DISTINCT a.doc_id AS doc_id_a, b.doc_id AS doc_id_b FROM m a JOIN m b ON a.h = b.h AND a.doc_id < b.doc_id""",
    "p8_stretches": f"WITH {_SPANS} SELECT * FROM st",
    "p8_shares": f"""WITH {_SPANS}, t AS (SELECT doc_id, sum(size) AS n FROM st GROUP BY doc_id)
        SELECT doc_id, length(text) AS n_chars, CASE WHEN text IS NOT NULL THEN coalesce(n, 0) END AS shared_chars,
               CASE WHEN length(text) > 0 THEN round(coalesce(n, 0) / length(text), 6) WHEN text IS NOT NULL THEN 0.0 END AS shared_part
        FROM documents LEFT JOIN t USING (doc_id)""",
    "p8_clusters": f"WITH RECURSIVE {_SPANS}, {_components('SELECT a, b FROM l')} SELECT doc_id, rep, coalesce(cluster, rep) AS cluster FROM d LEFT JOIN k USING (rep) WHERE n_copies > 1 OR cluster IS NOT NULL",
    "p8_classes": f"WITH {_SPANS} SELECT doc_id, rep, n_copies, coalesce(n, 0) AS n_links FROM d LEFT JOIN (SELECT a AS rep, count(*) AS n FROM l GROUP BY a) USING (rep)",
    "p8_removals": f"WITH RECURSIVE {_SPANS}, {_components(_ALIKE)} SELECT doc_id, rep, coalesce(cluster, rep) AS cluster, doc_id = coalesce(cluster, rep) AS keep FROM d LEFT JOIN k USING (rep)",
    "p1_found": _P1_RANKS
    + """
    SELECT row_id FROM r WHERE rank_strategy_score <= 20 AND rank_page_confidence <= 20 AND rank_ensemble_score <= 20
""",
    "p1_ranking": _P1_RANKS
    + """,
    f AS (
        SELECT *, coalesce(1.0::DOUBLE / (60 + rank_strategy_score), 0) + coalesce(1.0::DOUBLE / (60 + rank_page_confidence), 0)
                  + coalesce(1.0::DOUBLE / (60 + rank_ensemble_score), 0) AS x
        FROM r)
    SELECT row_id, run_id, field_name, rank_strategy_score, rank_page_confidence, rank_ensemble_score, round(x, 12) AS rrf,
           rank() OVER (PARTITION BY run_id, field_name ORDER BY x DESC) AS fused_rank
    FROM f
""",
}
