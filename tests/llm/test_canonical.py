import pytest

from parapheur.llm import canonical as c


@pytest.mark.parametrize(
    ("text", "form"),
    [
        ("ａ１，ﬁn", "a1,fin"), ("été", "été"), ("a​b⁠c﻿", "abc"), ("a b c d", "a b c d"), ("mot­\nsuite", "mot-\nsuite"), ("mo­t", "mot"),
        ("a\r\nb c", "a\nb\nc"), ("x²  y", "x²  y"), ("Отдел", "Отдел"), ("", ""), ("½ ° – —", "½ ° – —"), ("cœur", "cœur"),
    ],
)
def test_fold(text, form):
    assert c.fold(text) == form and c.fold(form) == form


def test_mixed_tokens_are_repaired_to_attested_words_only():
    assert c.canonical("sеrvіcе", {"service"}) == "service" and c.canonical("sеrvіcе") == "sеrvіcе"
    assert c.canonical("Оtdеl Отдел Σελίδα", {"Otdel"}) == "Otdel Отдел Σελίδα"
    assert c.canonical("а") == "а" and c.canonical("а", {"a"}) == "a"
    assert c.canonical("Oтдел", {"Отдел"}) == "Отдел" and c.canonical("гavid", {"david"}) == "гavid"
    assert c.canonical("régionalе", {"régionale"}) == "régionale"
    assert c.canonical("sօսs Ꭺgence", {"sous", "Agence"}) == "sous Agence"


def test_what_no_reader_sees_and_styled_letters():
    assert c.fold("a\ufe0fb\u034fc\u3164d\U000e0041e") == "abcde" and c.fold("𝐀𝑏𝟗") == "Ab9" and c.fold("ﻼ") == "لا"


def pairs(spark, texts, schema="id BIGINT, t STRING, form STRING"):
    df = spark.createDataFrame([(i, t, "kept out") for i, t in enumerate(texts)], schema)
    return sorted(tuple(r) for r in c.look_alike_pairs(df, "id", "t").collect())


def test_pairs(spark):
    texts = ["le service a reçu", "le sеrvice а reçu", "le service a reçu", "lе serviсe a reçu", "le service a recu", "Le service a reçu", None, "", "​", "le  service a reçu"]
    assert pairs(spark, texts) == [(0, 1), (0, 3), (1, 2), (1, 3), (2, 3)]


def test_disguises_are_no_evidence_for_each_other(spark):
    # 'Соріе' all in Cyrillic twice; the Latin word stands in a third text
    assert pairs(spark, ["Соріе à", "Сорiе à", "Copie à"]) == [(0, 1), (0, 2), (1, 2)]


def test_no_rows_and_long_texts(spark):
    assert pairs(spark, []) == []
    long = "mot " * 60_000
    assert pairs(spark, [long, long.replace("o", "о", 3)]) == [(0, 1)]


def test_forms_keep_every_row(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (None, "аb"), (3, "é"), (3, "é")], "id BIGINT, t STRING")
    out = sorted(((r.id or 0, r.canonical) for r in c.canonical_form(df, "id", "t").collect()), key=str)
    assert out == sorted([(1, None), (2, ""), (0, "аb"), (3, "é"), (3, "é")], key=str)  # 'ab' stands nowhere


def test_two_disguises_of_one_word_attest_it(spark):
    assert pairs(spark, ["M. Zеrvanouard", "M. Zervаnouard", "M. Zervanouаrd"]) == [(0, 1), (0, 2), (1, 2)]
