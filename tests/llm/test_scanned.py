import random

import numpy as np

from parapheur.llm import near, scanned as s

SCHEMA = "page_row_id BIGINT, doc_id STRING, page INT, raw_text STRING, body_text_no_tables STRING, tables ARRAY<STRUCT<table_index INT, data ARRAY<ARRAY<STRING>>>>, col_name STRING"
PROSE = "la réception de la mainlevée commerciale concerne le service et la notification du bordereau"


def pages(spark, texts, tables=None):
    rows = [(i, doc, page, text, text, tables, "kept out") for i, (doc, page, text) in enumerate(texts)]
    corpus = spark.createDataFrame([(PROSE,)] * 40 + [("le procès-verbal de l'agence Zeriba-Haute",)] * 5 + [(None,), ("",)], "t STRING")
    return s.ScannedPages(spark.createDataFrame(rows, SCHEMA), corpus)


def found(spark, texts, tables=None):
    out = pages(spark, texts, tables).found().where("col_name = 'raw_text'")
    return sorted((r.page_row_id, r.kind, r.line_no) for r in out.collect())


def test_headers_come_back_on_other_pages_in_any_form(spark):
    texts = [
        ("d", 1, f"Agence  FONTARANE n° 1\n{PROSE}\n{PROSE}"), ("d", 2, f" agence fontarane n° 2 .\n{PROSE}\n{PROSE}"), ("d", 2, f"Ag3nce\n{PROSE}"),
        ("e", 1, f"Agence Fontarane n° 1\n{PROSE}"), ("e", 1, f"Agence Fontarane n° 1\n{PROSE}"), (None, 1, "Agence Fontarane"), (None, 2, "Agence Fontarane"), ("d", None, "Agence Fontarane n° 7"),
    ]
    lines = [x for x in found(spark, texts) if x[1] == "header" and x[2] == 0]
    assert lines == [(0, "header", 0), (1, "header", 0)]


def test_page_numbers(spark):
    lines = [("3", True), ("- 3 -", True), ("— 3 —", True), ("[3]", True), ("p. 3", True), ("Page : 03", True), ("PAGE 3", True), ("Pagc 3 sur 7", True), ("3/7", True), ("4", False), ("3094.", False), ("3 articles", False)]
    got = found(spark, [(f"d{i}", 3, f"{PROSE}\n{line}") for i, (line, _) in enumerate(lines)])
    assert [((i, "pageno", 1) in got) for i in range(len(lines))] == [good for _, good in lines]


def test_hyphens_by_vocabulary(spark):
    text = "la récep-\ntion de la main¬\nlevée du procès-\nverbal de Zeriba-\nHaute et no­\ntification FAC-\n2023 le ser- \nvice"
    assert [x[2] for x in found(spark, [("d", 1, text)]) if x[1] == "hyphen"] == [0, 1, 4, 6]


def test_misread_words(spark):
    text = "la réccption du 5ervice et la notific@tion\nla rnainlevée du bord-\ncreau concerne Oulmitselle et 1er A4-30\nx@y.fr"
    assert [x[2] for x in found(spark, [("d", 1, text)]) if x[1] == "char"] == [0, 1, 2]


def test_look_alike_characters_are_not_misread(spark):
    assert not [x for x in found(spark, [("d", 1, "lа réceptiοn du ｓｅｒｖｉｃｅ")]) if x[1] == "char"]


def test_table_rows_are_no_case(spark):
    tables = [(1, [["5ervice", None, "réccption"], None, ["", "12"]])]
    assert found(spark, [("d", 1, f"{PROSE}\n5ervice réccption\n12\n{PROSE}")], tables) == []


def test_odd_rows(spark):
    assert found(spark, []) == []
    long = "\n".join([PROSE] * 3000)
    assert found(spark, [("d", 1, None), ("d", 2, ""), ("d", 3, "\n\n"), ("d", 1, long)]) == []


def test_paragraphs(spark):
    other = "le bordereau de la notification concerne la mainlevée"  # a line on two pages' edges would be a header
    text = f"Agence Fontarane\n{PROSE} et la récep-\ntion du 5ervice de Zeriba-\nHaute.\n\n{PROSE}\n1"
    sp = pages(spark, [("d", 1, text), ("d", 2, f"AGENCE FONTARANE\n{other}\n2"), ("d", 3, None)])
    out = {(r.page_row_id, r.col_name): r.paragraphs for r in sp.repaired().collect()}
    assert out[0, "raw_text"] == f"{PROSE} et la réception du service de Zeriba-Haute.\n{PROSE}"
    assert out[1, "raw_text"] == other and out[2, "raw_text"] is None and len(out) == 6


def test_readings_undo_up_to_two_misreadings():
    assert {"recoiivrcment": "recouvrement"}.items() <= {w: f for w in ["recoiivrcment"] for f, _ in s.readings(w) if f == "recouvrement"}.items()
    assert s.readings("") == [] and all(w.isalpha() for w, _ in s.readings("dél@i!"))


def test_words_that_only_the_body_has_are_tried(spark):
    rows = [(1, "d", 1, PROSE, f"{PROSE}\nle 5ervice", None, "kept out"), (2, "d", 2, PROSE, f"{PROSE} la réccp-\ntion", None, "kept out")]
    sp = s.ScannedPages(spark.createDataFrame(rows, SCHEMA), spark.createDataFrame([(PROSE,)] * 40, "t STRING"))
    assert {(r.page_row_id, r.col_name, r.line_no) for r in sp.found().where("kind = 'char'").collect()} == {(1, "body_text_no_tables", 1), (2, "body_text_no_tables", 0)}
    assert sp.words.where("word = 'service'").first().n == 42  # not counted twice


def test_any_number_of_misreadings(spark):
    long = "anticonstitutionnellement" * 2
    vocabulary = [("commissionnaire", 50), ("cornrni55i0nnaire", 1), ("minimum", 50), ("rniniiinurn", 1), ("miriirnurn", 1), (long, 50), (long.replace("e", "c"), 1), ("A4I0O5", 1)]
    out = {r.word: (r.fix, r.place) for r in s.misreadings(spark.createDataFrame(vocabulary, "word STRING, n BIGINT")).collect()}
    assert out == {"cornrni55i0nnaire": ("commissionnaire", 2), "miriirnurn": ("minimum", 2), long.replace("e", "c"): (long, long.index("e"))}
    keys = spark.createDataFrame(s.MISREAD, "a STRING, b STRING").where(s._folded_key(s.F.col("a")) != s._folded_key(s.F.col("b")))
    assert keys.isEmpty()


def test_edges_go_on_as_far_as_lines_come_back(spark):
    head = "\n".join(f"Agence Fontarane ligne {w}" for w in "une deux trois quatre cinq six sept".split())
    texts = [("d", 1, f"{head}\n{PROSE}\n{PROSE} un\n{PROSE} deux"), ("d", 2, f"{head}\nle bordereau de la mainlevée\n{PROSE} trois")]
    assert [x[2] for x in found(spark, texts) if x[1] == "header" and x[0] == 0][:7] == list(range(7))


def test_sentences_and_short_marks_need_their_place_on_most_pages(spark):
    body = "le service\nla réception\nle bordereau concerne\nla notification\nla mainlevée"
    foot = "Société Générale du Sud S.A.\nDRH"
    texts = [("d", n, f"début {w} de la page\n{body} {w}\n{foot}") for n, w in ((1, "alpha"), (2, "bravo"), (3, "charlie"))]
    assert {x[2] for x in found(spark, texts) if x[1] == "header" and x[0] == 0} >= {6, 7}
    once = [("e", 1, f"{body}\n{foot}"), ("e", 2, f"{body} x\nautre fin"), ("e", 3, "rien"), ("e", 4, f"DRH\n{body} y")]
    assert not {6, 7} & {x[2] for x in found(spark, once) if x[1] == "header" and x[0] == 0 and x[2] > 4}


def test_headers_within_a_few_edits(spark):
    texts = [("d", 1, f"Direction régionale des archives centrales\n{PROSE}"), ("d", 2, f"Direction régionalle des archivvs centrales\n{PROSE} x"), ("d", 3, f"Direction des achats\n{PROSE} y")]
    assert [x[0] for x in found(spark, texts) if x[1] == "header" and x[2] == 0] == [0, 1]


def test_page_number_sequences(spark):
    cases = [(["7", "8"], True), (["iv", "v"], True), (["- deux -", "- trois -"], True), (["Page 12", "Page 13"], True), (["7", "7"], False), (["iv", "ix"], False)]
    got = found(spark, [(f"d{k}", n + 1, f"{PROSE} {line} {'abc'[n] * 9}\n{line}") for k, (lines, _) in enumerate(cases) for n, line in enumerate(lines)])
    assert [((2 * k, "pageno", 1) in got, (2 * k + 1, "pageno", 1) in got) for k in range(len(cases))] == [(good, good) for _, good in cases]


def test_near_headers_need_no_common_beginning_or_end_and_no_neighbours(spark, monkeypatch):
    forms = ["Dxrection régionale des archives centralqs", "Direction régionale des archives centrales"]
    between = [f"Direction régionale d{c} {w}" for c, w in (("e", "la reliure ancienne"), ("es", "achats"))]
    texts = [("d", 1, f"{forms[0]}\n{PROSE}"), ("d", 2, f"{forms[1]}\n{PROSE} x"), ("d", 3, f"{between[0]}\n{PROSE} y"), ("d", 4, f"{between[1]}\n{PROSE} z"), ("e", 1, f"{forms[0]}\n{PROSE}")]
    for block in (s.BLOCK, 3):  # also where a document's forms are dealt into blocks
        monkeypatch.setattr(s, "BLOCK", block)
        assert [x[0] for x in found(spark, texts) if x[1] == "header" and x[2] == 0] == [0, 1]


def test_near_is_exact(monkeypatch):
    draw = random.Random(5)

    def edits(a, b):
        row = list(range(len(b) + 1))
        for i, c in enumerate(a):
            row, up = [i + 1], row
            for j, d in enumerate(b):
                row.append(min(up[j + 1] + 1, row[j] + 1, up[j] + (c != d)))
        return row[-1]

    for many in (near.MANY, 2):
        monkeypatch.setattr(near, "MANY", many)
        group = sorted(draw.randrange(3) for _ in range(60))
        base = ["".join(draw.choice("abcdé #") for _ in range(n)) for n in (9, 20, 33)]
        forms = ["".join(draw.choice("abxé") if draw.random() < 0.12 else c for c in draw.choice(base))[draw.randrange(3) :] for _ in group]
        lo = [draw.randrange(3) for _ in group]
        hi = [a + (draw.random() < 0.2) for a in lo]
        want = [lo[i] == hi[i] and any(group[i] == group[j] and (lo[j] != lo[i] or hi[j] != lo[i]) and edits(forms[i], forms[j]) <= int(0.15 * max(len(forms[i]), len(forms[j]))) for j in range(60) if j != i) for i in range(60)]
        assert 0 < sum(want) < 60 and near.near(np.array(group), forms, np.array(lo), np.array(hi), 0.15).tolist() == want


def test_page_numbers_of_any_length(spark):
    texts = [("d", 12345, f"{PROSE}\n- 12345 -"), ("e", 2147483647, f"{PROSE}\nPage 2147483647 sur 2147483647"), ("f", 12345, f"{PROSE}\n12346")]
    assert [x[0] for x in found(spark, texts) if x[1] == "pageno"] == [0, 1]


def test_lines_keep_their_document_without_a_join(spark):
    rows = [(1, doc, page, f"Agence Fontarane\n{PROSE} {doc}", None, None, "kept out") for page, doc in ((1, "d"), (2, "e"))]  # one key, two documents
    sp = s.ScannedPages(spark.createDataFrame(rows, SCHEMA))
    assert sp.found().where("kind = 'header'").isEmpty()
    assert "Join" not in sp._edges._jdf.queryExecution().optimizedPlan().toString()


def test_bulk_words_are_those_of_the_lines():
    p = s.Page("la récep-\ntion du ser-\nvice a@b.fr [x] 5ervice\n\nde Zeriba-\nHaute\n12 3¬\nfin", ["5ervice", "12 3¬"])
    plain, cut = p.apart()
    alone = sorted(w for _, found, _, _ in p.words() for w in found)
    assert alone == sorted(p.words_of(plain) + [w for _, found, _, _ in p.words(cut) for w in found])
    assert [x for x in p.words() if x[2]] == [x for x in p.words(cut) if x[2]]


def test_figures_are_not_looked_up(spark, monkeypatch):
    monkeypatch.setattr(s, "FREQUENT", 1)
    shipped = []
    monkeypatch.setattr(type(spark.sparkContext), "broadcast", lambda self, x: shipped.append(x) or type("Shipped", (), {"value": x})())
    out = pages(spark, [("d", 1, "2021 " * 500 + "\nle 5ervice la réccption")]).found().where("kind = 'char'").collect()
    assert {r.line_no for r in out} == {1} and not any(w.isdigit() for x in shipped for w in x)


def test_edges_go_on_over_near_lines_short_marks_and_page_numbers(spark):
    head = [f"Agence Fontarane ligne {w}" for w in "une deux trois quatre".split()]
    first = [*head, "Direction régionale des archives centrales", "DRH", "1", "Service du courrier", PROSE]
    second = [*head, "Dxrection régionale des archives centralqs", "DRH", "2", "Service du courrier", "le bordereau de la mainlevée"]
    out = found(spark, [("d", 1, "\n".join([*first, *[PROSE] * 6])), ("d", 2, "\n".join([*second, *["la notification"] * 6]))])
    assert [(x[0], x[2]) for x in out if x[1] == "header" and x[2] < 8] == [(k, i) for k in (0, 1) for i in (0, 1, 2, 3, 4, 5, 7)]
    assert [(x[0], x[2]) for x in out if x[1] == "pageno"] == [(0, 6), (1, 6)]


def test_deep_lines_come_back_among_the_first_lines(spark):
    head = [f"Agence Fontarane ligne {w}" for w in "une deux trois quatre cinq".split()]
    texts = [("d", 1, "\n".join([*head, *[PROSE] * 6])), ("d", 2, "\n".join([*head[1:], *["la notification"] * 6])), ("d", 3, "\n".join([head[0], *["le service"] * 8]))]
    assert [x[2] for x in found(spark, texts) if x[1] == "header" and x[0] == 0][:5] == [0, 1, 2, 3, 4]
