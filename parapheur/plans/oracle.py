"""SQL that DuckDB runs beside the core queries: the same semantics, written again in another dialect.

DuckDB's patterns know only ASCII blanks, digits and word ends, so these classes are spelled out.
"""

from __future__ import annotations

from parapheur.functions import text as t
from parapheur.operators.evaluate import GOLD_COLUMNS, METRICS

WS = r"[\s\p{Z}\x{85}\x{0B}]"
WORD = r"\p{L}\p{M}\p{N}_\x{200C}\x{200D}"


def _q(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


def _re(pattern: str) -> str:
    """A pattern with Unicode blanks and digits, as a literal."""
    out, i, inside = [], 0, False
    while i < len(pattern):
        two = pattern[i : i + 2]
        if two == r"\s":
            out.append(WS[1:-1] if inside else WS)
            i += 2
        elif two == r"\d":
            out.append(r"\p{Nd}")
            i += 2
        elif two == r"\w":
            out.append(WORD if inside else f"[{WORD}]")
            i += 2
        elif pattern[i] == "\\":
            out.append(two)
            i += 2
        else:
            inside = pattern[i] == "[" or inside and pattern[i] != "]"
            out.append(pattern[i])
            i += 1
    return _q("".join(out))


def strip(x: str) -> str:
    return f"regexp_replace({x}, {_re(r'^\s+|\s+$')}, '', 'g')"


def squeeze(x: str) -> str:
    return f"regexp_replace({strip(x)}, {_re(r'\s+')}, ' ', 'g')"


def norm(x: str) -> str:
    return squeeze(f"lower({x})")


def has(x: str, pattern: str, flags: str = "i") -> str:
    return f"regexp_matches({x}, {_re(pattern)}{f', {_q(flags)}' if flags else ''})"


def group(x: str, pattern: str, n: int = 1, flags: str = "i") -> str:
    return f"nullif(regexp_extract({x}, {_re(pattern)}, {n}{f', {_q(flags)}' if flags else ''}), '')"


def repaired(x: str) -> str:
    out = f"regexp_replace({strip(f"replace({x}, '’', '''')")}, '[|¦]+', ':', 'g')"
    for pattern, label in t.LABEL_REPAIRS["compat"]:
        out = f"regexp_replace({out}, {_re(pattern)}, {_q(label)}, 'i')"
    return f"regexp_replace({out}, {_re(r'\s{2,}')}, ' ', 'g')"


PLAIN = "regexp_replace(raw_text, '<[^>]+>', '', 'g')"
PAGES = f"""
    WITH n AS (SELECT page_row_id, doc_id, list_transform(string_split({PLAIN}, chr(10)), lambda x: {repaired('x')}) AS norm FROM ocr_pages WHERE raw_text IS NOT NULL),
    p AS (SELECT page_row_id, doc_id, array_to_string(norm, chr(10)) AS text, list_transform(norm, lambda x: {strip('x')}) AS lines,
                 list_filter(list_transform(norm, lambda x: {strip('x')}), lambda x: x <> '') AS filled FROM n)
"""


def noise(x: str) -> str:
    ratio = rf"length(regexp_replace({x}, '[^\p{{L}}]', '', 'g')) / greatest(length({x}), 1) < 0.4"
    tests = [has(x, "[+%]|N8X|oloX|米", ""), has(x, r"[\x{0600}-\x{06FF}]", ""), has(x, t.URL), has(x, t.SYMBOLS_FIRST, ""), has(x, t.FOOTER), ratio, f"length({x}) < 3"]
    return "(" + " OR ".join(tests) + ")"


def reference(x: str) -> str:
    return f"({has(x, t.REF_CODE, '')} OR {has(x, r'^/?REF\s*:?$')})"


def keyword(x: str) -> str:
    return has(x, f"^{t.KEYWORD}")


def labelled(lines: str, label: str, bad: str) -> str:
    values = f"list_transform({lines}, lambda x: {strip(group('x', '^' + label + '(.+)'))})"
    return f"list_filter({values}, lambda v: v IS NOT NULL AND v <> '' AND NOT {bad})[1]"


def value_query(expression: str) -> str:
    return f"{PAGES} SELECT page_row_id, value FROM (SELECT page_row_id, {expression} AS value FROM p) WHERE value IS NOT NULL"


def _subtype() -> str:
    cases = []
    for name, cues in t.SUBTYPES:
        either = cues.replace(r"\b", "")  # every cue stands between word ends
        cases.append(f"WHEN {has('lower(raw_text)', f'(?:^|[^{WORD}])(?:{either})(?:$|[^{WORD}])', '')} THEN '{name}'")
    return "CASE WHEN raw_text IS NULL THEN NULL " + " ".join(cases) + " ELSE 'autre' END"


DATED = rf"(?:^|[^{WORD}])({t.DATE})(?:$|[^{WORD}])"
ADDRESSEE = r"(?:A|À)\s*(?:l['’]attention\s+(?:de|du|des)|:)\s*"
REF_BODY = r"(?:Réf|REF)\s*:\s*(" + t.REF_CODE + r"(?:\s+du\s+[\d/]+)?)"

BEFORE, AFTER = f"(?:^|[^{WORD}])", f"(?:$|[^{WORD}])"
COUNT, THINGS = r"(\d{1,2}|un|une|deux|trois|quatre)", r"(?:pi[eè]ces?|dossiers?|documents?|fichiers?)"
SALUTATION = r"(?:^|\n)Monsieur\s*,\s*\n"


def integer(x: str) -> str:
    return f"TRY_CAST(translate({x}, '０１２３４５６７８９', '0123456789') AS INT)"


def spelled(x: str) -> str:
    return f"coalesce({integer(x)}, CASE lower({x}) WHEN 'un' THEN 1 WHEN 'une' THEN 1 WHEN 'deux' THEN 2 WHEN 'trois' THEN 3 WHEN 'quatre' THEN 4 END)"


def pieces(n: str) -> str:
    return f"(lpad(CAST({n} AS VARCHAR), 2, '0') || CASE WHEN {n} = 1 THEN ' pièce jointe' ELSE ' pièces jointes' END)"


def from_match(pattern: str) -> str:
    """Text from the first match on; the line starts that the pattern names are those of any line."""
    return f"nullif(regexp_extract(text, {_re('(?s)(?:' + pattern + ').*')}, 0, 'i'), '')"


def first_code(lines: str) -> str:
    codes = f"list_transform({lines}, lambda x: nullif(regexp_extract(x, {_re(t.REF_CODE)}, 0), ''))"
    return squeeze(f"list_filter({codes}, lambda v: v IS NOT NULL)[1]")


PIECE_LABEL = r"^(?:P\.?\s*J\.?|Pi[eè]ces?\s+jointes?)\s*:?\s*"
_OWN = strip(f"regexp_replace(lines[i], {_re(PIECE_LABEL)}, '', 'i')")
_VALUE = f"CASE WHEN {_OWN} <> '' THEN {_OWN} ELSE coalesce(lines[i + 1], '') END"
LABELLED_PIECES = f"""CASE WHEN {has('lines[i]', PIECE_LABEL)} THEN coalesce({pieces(integer(group(f'({_VALUE})', BEFORE + r'(\d{1,2})' + AFTER)))},
    CASE WHEN ({_VALUE}) <> '' AND len(list_filter(regexp_split_to_array({_VALUE}, {_re(r'\s+')}), lambda w: w <> '')) <= 4 THEN {_VALUE} END) END"""
_SPELLED = strip(f"regexp_replace({group('text', r'Alger\s*,?\s*le\s*([.\-_\s]{0,20})\n?\s*([A-Za-z0-9][^\n]{3,}?)(?:\n|$)', 2)}, {_re(r'^[.\-_\s]+')}, '')")
SPELLED_DATE = f"""CASE WHEN length(replace({_SPELLED}, ' ', '')) >= 4 AND NOT {has(_SPELLED, rf'^[^{WORD}]+$')} AND NOT {has(_SPELLED, r'^(?:Messieurs?|Mesdames?|Monsieur)\s+')} THEN {_SPELLED} END"""



def tidy(x: str) -> str:
    bare = f"regexp_replace({strip(x)}, '^(?:[^{WORD}]|_)+', '')"
    return strip(f"regexp_replace({bare}, {_re(r'^A\s*:\s*')}, 'À: ', 'i')")


def can_receive(x: str) -> str:
    return f"({x} IS NOT NULL AND length({x}) > 5 AND NOT ({noise(x)} OR {reference(x)} OR {keyword(x)}))"


def valid(x: str) -> str:
    """The value if it can name a receiver; computed once, as the only element of a list."""
    return f"list_filter([{x}], lambda v: {can_receive('v')})[1]"


def at(lines: str, pattern: str) -> str:
    return f"coalesce(list_position(list_transform({lines}, lambda x: {has('x', pattern)}), true), 0)"


def regexp_named() -> str:
    return f"regexp_matches(array_to_string(lines, chr(10)), {_re(NAMED)}, 'i')"


NAMED = r"(?m)^\s*[AÀ]\s*(?:l['’]attention\s+(?:de|du|des)|:)\s*([^\n]+?)\s*$"
SENDER_AT = at("lines[1:15]", r"^De\s*:")
LETTERS = r"length(regexp_replace(x, '[^\p{L}]', '', 'g')) / greatest(length(x), 1)"
BELOW_SENDER = f"CASE WHEN {SENDER_AT} > 0 THEN {tidy(f'list_filter(lines[{SENDER_AT} + 1 : {SENDER_AT} + 5], lambda x: {can_receive("x")} AND {LETTERS} > 0.5)[1]')} END"
ADDRESSED = tidy(f"regexp_extract(array_to_string(lines, chr(10)), {_re(NAMED)}, 1, 'i')")
TITLE_AT = at("lines", r"^(?:Messieurs?|Mesdames?|Monsieur)\s+(?:le|les|la|l['’])\s+")
_FOLLOW = f"lines[{TITLE_AT} + 1 : {TITLE_AT} + 3]"
_STOP = f"list_position(list_transform({_FOLLOW}, lambda x: x = '' OR {has('x', r'^(?:Objet|Réf|P\.J|Alger|REF)')} OR NOT {can_receive('x')}), true)"
_MERGED = f"array_to_string(list_concat([lines[{TITLE_AT}]], {_FOLLOW}[1 : coalesce({_STOP} - 1, 3)]), chr(10))"
TITLED = tidy(f"list_filter([{_MERGED}], lambda v: {can_receive('v')})[1]")
_CLEAN = f"list_filter(lines[1 : coalesce(list_position(list_transform(lines[1:12], lambda x: {reference('x')} OR {keyword('x')}), true) - 1, 12)], lambda x: NOT {noise('x')})"
SECOND_LINE = tidy(f"{_CLEAN}[2]")
_POOR = f"CASE WHEN {noise('top[i]')} OR {reference('top[i]')} OR {keyword('top[i]')} THEN -4 ELSE 0 END"


def points(pattern: str, n: int) -> str:
    return f"CASE WHEN {has('top[i]', pattern)} THEN {n} ELSE 0 END"


SENDER_SCORE = f"{_POOR} + {points(BEFORE + '(?:Service|Département|Direction)' + AFTER, 3)} + {points(r'^De\s*:', 6)} + CASE WHEN i <= 6 THEN 1 ELSE 0 END"
RECEIVER_SCORE = f"{_POOR} + {points(BEFORE + '(?:Service|Département|Direction|Monsieur|Mesdames?)' + AFTER, 2)} + CASE WHEN i > -s.before THEN 2 ELSE 0 END + {points(r"^[AÀ]\s*(?:l['’]attention|:)", 5)}"

STRATEGY = """CASE regexp_replace(lower(strategy), '[\\s_]+', '', 'g') WHEN 'regex' THEN 'Regex' WHEN 'heuristic' THEN 'Heuristic'
              WHEN 'rapidfuzzy' THEN 'RapidFuzzy' WHEN 'sequencefallback' THEN 'Sequence Fallback' ELSE strategy END"""
RANK = f"CASE {STRATEGY} WHEN 'Regex' THEN 0 WHEN 'Heuristic' THEN 1 WHEN 'RapidFuzzy' THEN 2 ELSE 3 END"
KEY = r"nullif(regexp_extract(filename, 'doc_\d+'), '')"
GOLD = f"g AS (SELECT {KEY} AS doc_id, * FROM generated_documents WHERE {KEY} IS NOT NULL QUALIFY row_number() OVER (PARTITION BY {KEY} ORDER BY row_no DESC) = 1)"
GOLD_FIELDS = "gf AS (" + " UNION ALL ".join(f"SELECT doc_id, '{f}' AS field_name, CASE WHEN {strip(c)} <> '' THEN {c} END AS gold FROM g" for f, c in GOLD_COLUMNS.items()) + ")"
LAST_PAGE = "l AS (SELECT * FROM ocr_pages WHERE doc_id IS NOT NULL AND page IS NOT NULL QUALIFY row_number() OVER (PARTITION BY doc_id, page ORDER BY page_row_id DESC) = 1)"


def tokens(x: str) -> str:
    return f"list_filter(string_split({norm(f"coalesce({x}, '')")}, ' '), lambda w: w <> '')"


def ref_norm(x: str) -> str:
    return f"regexp_replace(regexp_replace({norm(x)}, {_re(r'[-\s]+')}, '/', 'g'), '^/+|/+$', '', 'g')"


SCORED = f"""
    t AS (SELECT *, {tokens('predicted')} AS p, {tokens('gold')} AS q FROM j),
    c AS (SELECT *, coalesce(list_sum(list_transform(list_intersect(p, q), lambda w: least(len(list_filter(p, lambda x: x = w)), len(list_filter(q, lambda x: x = w))))), 0)::DOUBLE AS common,
                 len(list_intersect(p, q)) / nullif(len(list_distinct(list_concat(p, q))), 0) AS jac FROM t),
    s AS (SELECT *, CASE WHEN len(q) > 0 THEN CASE WHEN len(p) > 0 THEN common / len(p) ELSE 0 END END AS prec,
                 CASE WHEN len(q) > 0 THEN common / len(q) END AS recall,
                 CASE WHEN len(q) > 0 THEN CASE WHEN common > 0 THEN 2 * common / (len(p) + len(q)) ELSE 0 END END AS f1,
                 CASE WHEN len(q) > 0 THEN (CASE WHEN contains(lower(field_name), 'ref') THEN {ref_norm("coalesce(predicted, '')")} = {ref_norm("coalesce(gold, '')")}
                      ELSE {norm("coalesce(predicted, '')")} = {norm("coalesce(gold, '')")} END)::INT::DOUBLE END AS exact_match,
                 CASE WHEN len(q) > 0 THEN coalesce(jac, 0) END AS iou FROM c),
    m AS (SELECT *, CASE WHEN f1 IS NOT NULL THEN (f1 >= 0.65)::INT::DOUBLE END AS field_accuracy FROM s)
"""
ROUNDED = ", ".join(f"round({c}, 6) AS {c}" for c in METRICS)
MEANS = ", ".join(f"round(avg({c}), 6) AS {c}" for c in METRICS)


def _matrix(metric: str) -> str:
    cell = lambda s: f"avg({metric}) FILTER (WHERE s = '{s}')"
    return f"""
    WITH r AS (SELECT field_name, {STRATEGY} AS s, {metric} FROM kie_approaches WHERE {metric} IS NOT NULL AND field_name IS NOT NULL),
    w AS (SELECT coalesce(field_name, 'Overall') AS field_name, {cell('Regex')} AS a, {cell('Heuristic')} AS b, {cell('RapidFuzzy')} AS c
          FROM r WHERE s IN ('Regex', 'Heuristic', 'RapidFuzzy') GROUP BY ROLLUP (field_name))
    SELECT field_name, round(a, 6) AS "Regex", round(b, 6) AS "Heuristic", round(c, 6) AS "RapidFuzzy",
           CASE WHEN coalesce(a, b, c) IS NULL THEN 'n/a' WHEN a = greatest(a, b, c) THEN 'Regex' WHEN b = greatest(a, b, c) THEN 'Heuristic' ELSE 'RapidFuzzy' END AS best
    FROM w"""


def _stats(columns: tuple[str, ...], key: str = "") -> str:
    k = f"{key}, " if key else ""
    long = " UNION ALL ".join(f"SELECT {k}'{c}' AS metric, {c} AS v FROM kie_approaches" for c in columns)
    return f"""SELECT {k}metric, round(avg(v), 6) AS mean, round(min(v), 6) AS "min", round(max(v), 6) AS "max", round(stddev_pop(v), 6) AS std
               FROM ({long}) WHERE v IS NOT NULL GROUP BY {k}metric"""


AREA = "greatest(x.bbox[3] - x.bbox[1], 0)::BIGINT * greatest(x.bbox[4] - x.bbox[2], 0)"
INTERVAL = "CASE " + " ".join(f"WHEN {{0}} BETWEEN {90 * i} AND {90 * i + 100} THEN {i}" for i in range(4)) + " END"



def json_array(x: str) -> str:
    """A JSON value as a list: strings that hold JSON opened, an object as its only element."""
    opened = f"CASE WHEN json_type({x}) = 'VARCHAR' THEN CASE WHEN json_valid(json_extract_string({x}, '$')) THEN json_extract_string({x}, '$')::JSON END ELSE {x} END"
    return f"CASE json_type({opened}) WHEN 'ARRAY' THEN ({opened})::JSON[] WHEN 'OBJECT' THEN [{opened}] END"


def json_objects(name: str, source: str, keep: str, array: str) -> str:
    """A table of the objects in an array, with their places."""
    return f"""{name} AS (SELECT * FROM (SELECT {keep}, unnest(l) AS o, unnest(generate_series(0, len(l) - 1)) AS pos FROM (SELECT *, {json_array(array)} AS l FROM {source})) WHERE json_type(o) = 'OBJECT')"""


SHREDDED = f"""
    WITH d AS (SELECT record_id, CASE WHEN json_valid(payload) THEN payload::JSON END AS j FROM kie_documents),
    {json_objects('pg', "(SELECT * FROM d WHERE json_type(j) = 'OBJECT')", 'record_id', "(j->'$.pages')")},
    {json_objects('tb', '(SELECT record_id, pos AS page_pos, o AS parent FROM pg)', 'record_id, page_pos', "(parent->'$.tables')")},
    fd AS (SELECT record_id, pos AS page_pos, o->'$.field_details' AS f FROM pg),
    fm AS (SELECT record_id, page_pos, k AS field_name, json_extract(f, '$."' || k || '"') AS o FROM (SELECT *, unnest(json_keys(f)) AS k FROM fd WHERE json_type(f) = 'OBJECT')),
    fa AS (SELECT record_id, page_pos, coalesce(o->>'$.field', '') AS field_name, o FROM (SELECT record_id, page_pos, unnest(f::JSON[]) AS o FROM fd WHERE json_type(f) = 'ARRAY')),
    dt AS (SELECT * FROM (SELECT * FROM fm UNION ALL SELECT * FROM fa) WHERE json_type(o) = 'OBJECT'),
    {json_objects('cd', '(SELECT record_id, page_pos, field_name, o AS parent FROM dt)', 'record_id, page_pos, field_name', "(parent->'$.candidates')")}
    SELECT record_id, 'page' AS kind, pos AS page_pos, '' AS field_name, -1 AS item_pos FROM pg
    UNION ALL SELECT record_id, 'tbl', page_pos, '', pos FROM tb
    UNION ALL SELECT record_id, 'detail', page_pos, field_name, -1 FROM dt
    UNION ALL SELECT record_id, 'candidate', page_pos, field_name, pos FROM cd
"""

ORIGINS = SHREDDED[: SHREDDED.index("    SELECT record_id, 'page'")].rstrip() + """,
    sel AS (SELECT row_number() OVER () AS d, * FROM (SELECT record_id, page_pos, field_name, o, o->>'$.selected' AS selected FROM dt) WHERE selected IS NOT NULL),
    can AS (SELECT * FROM (SELECT d, selected, unnest(l) AS c, unnest(generate_series(0, len(l) - 1)) AS pos FROM (SELECT d, selected, {0} AS l FROM sel)) WHERE json_type(c) = 'OBJECT' AND c->>'$.value' = selected
            QUALIFY row_number() OVER (PARTITION BY d ORDER BY pos) = 1)
    SELECT s.record_id, s.page_pos, s.field_name, s.selected, c->>'$.strategy' AS origin, pos AS item_pos FROM sel s LEFT JOIN can ON s.d = can.d
""".replace("{0}", json_array("(o->'$.candidates')"))

_NESTED = SHREDDED[: SHREDDED.index("    SELECT record_id, 'page'")].rstrip()


def scalar(path: str) -> str:
    """A property that is neither an object nor an array."""
    return f"CASE WHEN json_type(o, '{path}') NOT IN ('OBJECT', 'ARRAY') THEN o->>'{path}' END"


def _properties(source: str, keys: str, *names: str, **renamed: str) -> str:
    columns = {n: n for n in names} | {a: n for n, a in renamed.items()}
    return f"{_NESTED} SELECT record_id, {keys}, {', '.join(f'{scalar(f'$.{n}')} AS {a}' for a, n in columns.items())} FROM {source}"


_BOX = f"(CASE WHEN json_type({json_array("(o->'$.bbox')")}[{{0}}]) NOT IN ('OBJECT', 'ARRAY') THEN {json_array("(o->'$.bbox')")}[{{0}}]->>'$' END)"
CELLS = f"""{_NESTED},
    rw AS (SELECT record_id, page_pos, pos AS item_pos, unnest(l) AS r, unnest(generate_series(0, len(l) - 1)) AS row_pos FROM (SELECT *, {json_array("(o->'$.data')")} AS l FROM tb)),
    ce AS (SELECT record_id, page_pos, item_pos, row_pos, unnest(r::JSON[]) AS c, unnest(generate_series(0, json_array_length(r)::INT - 1)) AS col_pos FROM rw WHERE json_type(r) = 'ARRAY')
    SELECT record_id, page_pos, item_pos, row_pos, col_pos, c->>'$' AS cell FROM ce WHERE json_type(c) NOT IN ('NULL', 'OBJECT', 'ARRAY')"""

ORACLE: dict[str, str] = {
    "p3_page_rows": _properties("pg", "pos AS page_pos", "page_number", "ocr_confidence"),
    "p3_table_rows": _properties("tb", "page_pos, pos AS item_pos, " + ", ".join(f"{_BOX.replace('{0}', str(i + 1))} AS {n}" for i, n in enumerate(("x1", "y1", "x2", "y2"))), "table_index", "method"),
    "p3_cell_rows": CELLS,
    "p3_detail_rows": _properties("dt", "page_pos, nullif(field_name, '') AS field_name", "selected"),
    "p3_candidate_rows": _properties("cd", "page_pos, nullif(field_name, '') AS field_name, pos AS item_pos", "strategy", "strategy_score", "page_confidence", "score", "reason", value="cand_value"),
    "j4_letters_not_evaluated": "SELECT DISTINCT filename FROM generated_documents WHERE filename NOT IN (SELECT document FROM kie_approaches WHERE document IS NOT NULL)",
    "p3_found": SHREDDED,
    "j8_selected_origins": ORIGINS,
    "op_p14_table_cells": """
        WITH r AS (SELECT row_no, list_filter(string_split(table_text, chr(10)), lambda x: trim(x) <> '') AS rows FROM generated_documents WHERE table_text IS NOT NULL),
        c AS (SELECT row_no, i - 1 AS r, string_split(rows[i], ',') AS cells FROM (SELECT row_no, rows, unnest(generate_series(1, len(rows))) AS i FROM r))
        SELECT row_no, r, j - 1 AS c, trim(cells[j]) AS cell FROM (SELECT row_no, r, cells, unnest(generate_series(1, len(cells))) AS j FROM c)""",
    "t1_strip_html": f"SELECT page_row_id, {PLAIN} AS plain FROM ocr_pages",
    "t2_normalised_lines": f"{PAGES} SELECT page_row_id, i - 1 AS line_no, norm[i] AS line FROM (SELECT page_row_id, norm, unnest(generate_series(1, len(norm))) AS i FROM n)",
    "t4_normal_forms": f"SELECT row_no, {norm('objet')} AS objet_norm, {ref_norm('ref_code')} AS ref_norm, CASE WHEN content IS NOT NULL THEN len(list_filter(regexp_split_to_array(content, {_re(r'\s+')}), lambda w: w <> '')) END AS n_words FROM generated_documents",
    "f1_line_classes": f"{PAGES} SELECT page_row_id, i - 1 AS line_no, {noise('line')} AS noise, {reference('line')} AS reference, {keyword('line')} AS keyword FROM (SELECT page_row_id, unnest(lines) AS line, unnest(generate_series(1, len(lines))) AS i FROM p)",
    "x10_subtype": f"SELECT page_row_id, {_subtype()} AS doc_subtype FROM ocr_pages",
    "x1_sender_regex": value_query(labelled("filled[1:12]", r"(?:De|Source|Exp[eé]diteur)\s*:\s*", noise("v"))),
    "x2_receiver_regex": value_query(labelled("filled[1:15]", ADDRESSEE, noise("v"))),
    "x3_reference_regex": value_query(
        f"coalesce({strip(group('text', REF_BODY))}, list_filter(list_transform(string_split(text, chr(10))[1:25], lambda x: CASE WHEN {has('x', r'^(?:Réf|REF)\s*:')} THEN {strip(f"regexp_replace(x, {_re(r'^(?:Réf|REF)\s*:\s*')}, '', 'i')")} END), lambda v: v IS NOT NULL AND v <> '')[1])"
    ),
    "x8_reference_in_body": value_query(strip(group("text", REF_BODY))),
    "x4_date_regex": value_query(f"coalesce({group('text', DATED)}, {group('text', r'Alger\s*:?,?\s*(?:le\s*)?\n\s*(' + t.DATE + ')')})"),
    "x5_subject_regex": value_query(f"nullif({strip(group('text', r'Objet\s*:\s*([^\n]+?)(?:\n|$)'))}, '')"),
    "x6_attachments_regex": value_query(f"nullif({strip(group('text', r'(?:P\.?\s*J\.?\s*:?\s*|Pi[eè]ces?\s+jointes?\s*:?\s*)([^\n]+?)(?:\n|$)'))}, '')"),
    "x1_sender_heuristic": value_query(
        f"""coalesce({labelled('filled[1:12]', r'De\s*:\s*', f"({noise('v')} OR {reference('v')})")},
            list_filter(filled[1:coalesce(list_position(list_transform(filled[1:8], lambda x: {reference('x')} OR {keyword('x')}), true) - 1, 8)], lambda x: NOT {noise('x')})[1],
            list_filter(filled[1:14], lambda x: NOT {noise('x')} AND NOT {reference('x')} AND {has('x', f'(?:^|[^{WORD}])(?:Service|Département|Direction)(?:$|[^{WORD}])')})[1])"""
    ),
    "x4_date_heuristic": value_query(
        f"""coalesce({group('text', r'Alger\s*:?\s*,?\s*(?:le\s*)?\n\s*(' + t.DATE + ')')},
            list_filter(list_transform(string_split(text, chr(10))[1:25], lambda x: {group('x', DATED)}), lambda v: v IS NOT NULL)[1],
            {SPELLED_DATE})"""
    ),
    "x6_attachments_heuristic": value_query(
        f"""coalesce(list_filter(list_transform(generate_series(1, len(lines)), lambda i: {LABELLED_PIECES}), lambda v: v IS NOT NULL)[1],
            {pieces(integer(group('text', BEFORE + r'(\d{1,2})\s*pi[eè]ce?s?\s+jointe?s?' + AFTER)))},
            {pieces(spelled(group('text', BEFORE + r'(deux|trois|quatre)\s+pi[eè]ce?s?\s+jointe?s?' + AFTER)))},
            {pieces(spelled(group('lower(text)', r'ci[\-\s]?joint(?:e|es)?(?:\s+\w+){0,4}\s+' + COUNT + r'\s+' + THINGS)))},
            {pieces(spelled(group('lower(text)', COUNT + r'\s+' + THINGS + r'(?:\s+\w+){0,6}\s+ci[\-\s]?joint(?:e|es)?')))},
            CASE WHEN {has('text', BEFORE + r'Copie\s+[aà]\s*:')} OR {has('text', BEFORE + r'(?:annexes?|pi[eè]ces?)' + AFTER)} THEN '01 pièce jointe' END)"""
    ),
    "x7_body_regex": value_query(
        f"""nullif({strip(f"regexp_replace(regexp_replace(coalesce({from_match(t.BODY_START)}, {from_match(SALUTATION)}), '^\n+', ''), {_re('(?s)(?:' + t.BODY_END + ').*')}, '', 'i')")}, '')"""
    ),
    "x3_reference_heuristic": value_query(
        f"""coalesce({first_code(f"list_transform(generate_series(1, len(lines[1:25]) - 1), lambda i: CASE WHEN {has('lines[i]', r'^REF\s*:?\s*$')} THEN lines[i + 1] END)")},
            {squeeze(f"list_filter(list_transform(lines[1:25], lambda x: {group('x', r'REF\s*:\s*(' + t.REF_CODE + ')')}), lambda v: v IS NOT NULL)[1]")},
            {first_code(f"list_filter(lines[1:25], lambda x: NOT {has('x', r'^Réf\s*:')})")},
            {first_code(f"list_filter(flatten(list_transform(generate_series(1, len(lines[1:25]) - 1), lambda i: [lines[i] || lines[i + 1], lines[i + 1] || lines[i]])), lambda x: NOT {has('x', r'^Réf\s*:')})")})"""
    ),
    "x2_receiver_heuristic": value_query(f"coalesce({BELOW_SENDER}, CASE WHEN {regexp_named()} THEN {valid(ADDRESSED)} WHEN {TITLE_AT} > 0 THEN {TITLED} ELSE {valid(SECOND_LINE)} END)"),
    "x9_decoded_head": f"""{PAGES},
        t AS (SELECT page_row_id, filled[1:18] AS top FROM p),
        s AS (SELECT page_row_id, top, list_max(list_transform(generate_series(1, len(top)), lambda i: {{'score': {SENDER_SCORE}, 'before': -i, 'line': top[i]}})) AS s FROM t),
        r AS (SELECT page_row_id, s, list_max(list_transform(generate_series(1, len(top)), lambda i: {{'score': {RECEIVER_SCORE}, 'before': -i, 'line': top[i]}})) AS r FROM s),
        b AS (SELECT page_row_id, CASE WHEN s.score > 0 THEN s.line END AS sender, CASE WHEN r.score > 0 THEN r.line END AS receiver FROM r)
        SELECT page_row_id, sender, CASE WHEN sender IS NULL OR sender <> receiver THEN receiver END AS receiver FROM b
        UNION ALL SELECT page_row_id, NULL, NULL FROM ocr_pages WHERE raw_text IS NULL""",
    "a1_page_text": f"SELECT page_row_id, {strip(f"regexp_replace(array_to_string(list_filter(string_split(raw_text, chr(10)), lambda x: {strip('x')} <> ''), chr(10)), '<[^>]+>', '', 'g')")} AS text FROM ocr_pages",
    "a2_document_confidence": """SELECT doc_id, count(*) AS n_pages, round(coalesce(avg(least(greatest(CASE WHEN coalesce(confidence, 0) > 1 THEN confidence / 100 ELSE coalesce(confidence, 0) END, 0), 1)), 0), 6) AS confidence
                                 FROM ocr_pages WHERE doc_id IS NOT NULL GROUP BY doc_id""",
    "a3_document_text": f"WITH {LAST_PAGE} SELECT doc_id, md5(coalesce(string_agg(raw_text, chr(10) ORDER BY page), '')) AS text_md5, max(page) AS last_page FROM l GROUP BY doc_id",
    "m9_confidence": "SELECT page_row_id, round(least(greatest(CASE WHEN coalesce(confidence, 0) > 1 THEN confidence / 100 ELSE coalesce(confidence, 0) END, 0), 1), 9) AS share FROM ocr_pages",
    "a6_filled_share": """
        WITH x AS (SELECT page_row_id, unnest(tables) AS x FROM ocr_pages),
        c AS (SELECT page_row_id, x.table_index AS table_index, flatten(list_filter(x.data, lambda r: r IS NOT NULL)) AS cells, x.data AS data FROM x)
        SELECT page_row_id, table_index, CASE WHEN len(cells) > 0 THEN round(len(list_filter(cells, lambda v: length(trim(coalesce(v, ''))) > 0)) / len(cells), 2) ELSE 0 END AS filled,
               coalesce(len(data), 0) AS n_rows, coalesce(len(data[1]), 0) AS n_columns FROM c""",
    "f6_large_tables": f"SELECT page_row_id, x.table_index AS table_index, round(({AREA}) / (2480 * 3508), 6) AS page_share, ({AREA}) / (2480 * 3508) <= 0.3 AS kept FROM (SELECT page_row_id, unnest(tables) AS x FROM ocr_pages)",
    "j5_stamps_outside_tables": """
        SELECT page_row_id, s.x AS x, s.y AS y, s.radius AS radius FROM (SELECT page_row_id, coalesce(table_bboxes, []) AS boxes, unnest(stamp_regions) AS s FROM ocr_pages)
        WHERE len(list_filter(boxes, lambda b: s.x BETWEEN b[1] - 8 AND b[3] + 8 AND s.y BETWEEN b[2] - 8 AND b[4] + 8)) = 0""",
    "j6_grid_cells": f"SELECT l_orderkey, l_linenumber, {INTERVAL.format('l_suppkey % 400')} AS r, {INTERVAL.format('l_partkey % 400')} AS c FROM lineitem",
    "a19_tables_per_document": f"WITH {LAST_PAGE} SELECT doc_id, sum(coalesce(len(tables), 0)) AS tables_detected, sum(coalesce(len(stamp_regions), 0)) AS stamps_detected FROM l GROUP BY doc_id",
    "s3_gold_letters": f"WITH {GOLD} SELECT doc_id, row_no, ref_code FROM g",
    "j2_gold_fields": f"WITH {GOLD}, {GOLD_FIELDS} SELECT doc_id, field_name, gold FROM gf",
    "op_p9_full_text": "SELECT row_no, md5(array_to_string(list_filter(["
    + ", ".join(strip(c) for c in ("source", "destination", "date_text", "ref_code", "objet", "pj", "content", "copie"))
    + "], lambda x: x IS NOT NULL AND x <> ''), ' ')) AS text_md5 FROM generated_documents",
    "j1_pages_with_letters": f"WITH {GOLD} SELECT o.page_row_id, o.doc_id, g.row_no AS letter FROM ocr_pages o LEFT JOIN g ON o.doc_id = g.doc_id",
    "j4_letters_without_pages": f"WITH {GOLD} SELECT doc_id FROM g WHERE doc_id NOT IN (SELECT doc_id FROM ocr_pages WHERE doc_id IS NOT NULL)",
    "w9_batches": "SELECT filename, row_number() OVER (ORDER BY filename) AS place, (row_number() OVER (ORDER BY filename) - 1) // 20 + 1 AS batch FROM (SELECT DISTINCT filename FROM generated_documents WHERE filename IS NOT NULL)",
    "e1_processed_documents": "SELECT doc_id FROM ocr_pages WHERE doc_id IS NOT NULL UNION SELECT document_id FROM kie_documents WHERE document_id IS NOT NULL",
    "m8_scored_candidates": f"""WITH {GOLD}, {GOLD_FIELDS},
        j AS (SELECT a.row_id, a.doc_id, a.field_name, a.strategy, a.predicted, gf.gold
              FROM (SELECT row_id, {KEY.replace('filename', 'document')} AS doc_id, field_name, {STRATEGY} AS strategy, cand_value AS predicted FROM kie_approaches) a
              LEFT JOIN gf ON a.doc_id = gf.doc_id AND a.field_name = gf.field_name), {SCORED}
        SELECT row_id, doc_id, field_name, strategy, {ROUNDED} FROM m""",
    "m2_subject_errors": f"""{PAGES}, {GOLD},
        f AS (SELECT page_row_id, doc_id, regexp_replace(lower(nullif({strip(group('text', r'Objet\s*:\s*([^\n]+?)(?:\n|$)'))}, '')), '[^a-z0-9 ]', '', 'g') AS h FROM p),
        j AS (SELECT f.page_row_id, f.h, regexp_replace(lower(coalesce(g.objet, '')), '[^a-z0-9 ]', '', 'g') AS r FROM f JOIN g ON f.doc_id = g.doc_id WHERE f.h IS NOT NULL),
        e AS (SELECT *, levenshtein(h, r) AS d, CASE WHEN r = '' THEN CASE WHEN h = '' THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END ELSE least(levenshtein(h, r) / length(r), 1.0::DOUBLE) END AS cer FROM j)
        SELECT page_row_id, d AS edit_distance, round(cer, 6) AS cer, round(greatest(0, 1 - cer), 6) AS accuracy FROM e""",
    "a8_metric_stats": _stats(METRICS),
    "a9_run_stats": _stats(("f1", "exact_match"), "run_id"),
    "a10_field_means": f"""
        WITH f AS (SELECT * FROM (VALUES {', '.join(f"({i}, '{f}')" for i, f in enumerate(GOLD_COLUMNS))}) v(field_order, field_name)),
        a AS (SELECT field_name, {MEANS}, count(f1) AS n FROM kie_approaches GROUP BY field_name)
        SELECT f.field_order, f.field_name, {', '.join(METRICS)}, coalesce(n, 0) AS n FROM f LEFT JOIN a USING (field_name)""",
    "a14_macro_average": f"SELECT {MEANS}, count(f1) AS n_fields FROM (SELECT field_name, {', '.join(f'avg({c}) AS {c}' for c in METRICS)} FROM kie_approaches GROUP BY field_name)",
    "a15_macro_by_strategy": f"SELECT strategy, {MEANS}, count(f1) AS n_fields FROM (SELECT {STRATEGY} AS strategy, field_name, {', '.join(f'avg({c}) AS {c}' for c in METRICS)} FROM kie_approaches GROUP BY 1, 2) GROUP BY strategy",
    "a16_running_means": """
        WITH s AS (SELECT evaluated_at::DATE AS day, field_name, sum(f1) AS s, count(f1) AS n FROM kie_approaches GROUP BY 1, 2),
        e AS (SELECT day, field_name FROM (SELECT DISTINCT day FROM s) CROSS JOIN (SELECT DISTINCT field_name FROM s)),
        m AS (SELECT e.day, sum(coalesce(s.s, 0)) OVER w / nullif(sum(coalesce(s.n, 0)) OVER w, 0) AS mean FROM e LEFT JOIN s ON e.day = s.day AND e.field_name = s.field_name
              WINDOW w AS (PARTITION BY e.field_name ORDER BY e.day ROWS UNBOUNDED PRECEDING))
        SELECT day, round(avg(mean), 6) AS running_mean FROM m GROUP BY day""",
    "a20_heatmap": f"""SELECT field_name, {', '.join(f"round(avg(exact_match) FILTER (WHERE s = '{s}'), 6) AS \"{s}\"" for s in ('Regex', 'Heuristic', 'RapidFuzzy'))}
                       FROM (SELECT field_name, {STRATEGY} AS s, exact_match FROM kie_approaches) WHERE s IN ('Regex', 'Heuristic', 'RapidFuzzy') GROUP BY field_name""",
    "w10_ranked_candidates": f"""
        SELECT row_id, row_number() OVER (PARTITION BY run_id, document, field_name ORDER BY ensemble_score DESC NULLS LAST, strategy_score DESC NULLS LAST, length(cand_value) DESC, {RANK}, row_id) AS place
        FROM kie_approaches WHERE {strip('cand_value')} <> ''""",
    "w10_winners": f"""
        SELECT run_id, document, field_name, {STRATEGY} AS selected_strategy, cand_value AS selected, ensemble_score AS selected_score FROM kie_approaches WHERE {strip('cand_value')} <> ''
        QUALIFY row_number() OVER (PARTITION BY run_id, document, field_name ORDER BY ensemble_score DESC NULLS LAST, strategy_score DESC NULLS LAST, length(cand_value) DESC, {RANK}, row_id) = 1""",
    "op_p8_report_values": "SELECT row_id, substr(cand_value, 1, 120) AS short_value FROM kie_approaches",
    "op_p7_table_extent": """
        SELECT page_row_id, coalesce(list_min(list_transform(table_bboxes, lambda b: b[1])), 0) AS x1, coalesce(list_min(list_transform(table_bboxes, lambda b: b[2])), 0) AS y1,
               coalesce(list_max(list_transform(table_bboxes, lambda b: b[3])), 0) AS x2, coalesce(list_max(list_transform(table_bboxes, lambda b: b[4])), 0) AS y2 FROM ocr_pages""",
    "x4_dates_by_field": f"""{PAGES}, {GOLD}, {GOLD_FIELDS},
        f AS (SELECT page_row_id, doc_id, 'Date' AS field_name, coalesce({group('text', DATED)}, {group('text', r'Alger\s*:?,?\s*(?:le\s*)?\n\s*(' + t.DATE + ')')}) AS predicted FROM p
              UNION ALL SELECT page_row_id, doc_id, 'Ref', coalesce({strip(group('text', REF_BODY))}, list_filter(list_transform(string_split(text, chr(10))[1:25], lambda x: CASE WHEN {has('x', r'^(?:Réf|REF)\s*:')} THEN {strip(f"regexp_replace(x, {_re(r'^(?:Réf|REF)\s*:\s*')}, '', 'i')")} END), lambda v: v IS NOT NULL AND v <> '')[1]) FROM p
              UNION ALL SELECT page_row_id, doc_id, unnest(['Date', 'Ref']), NULL FROM ocr_pages WHERE raw_text IS NULL),
        j AS (SELECT f.field_name, f.predicted, gf.gold FROM f JOIN gf ON f.doc_id = gf.doc_id AND f.field_name = gf.field_name), {SCORED}
        SELECT field_name, {MEANS}, count(f1) AS n FROM m GROUP BY field_name""",
    **{f"a12_matrix_{metric}": _matrix(metric) for metric in METRICS},
}
