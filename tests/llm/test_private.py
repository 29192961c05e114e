import itertools
import re

import pytest

from parapheur.llm import private as p
from parapheur.llm import queries
from parapheur.llm import surrogates as sg


@pytest.mark.parametrize(
    ("text", "kind", "piece"),
    [
        ("à nadir.b-c+x@poste.tirelles.test sous", "email", "nadir.b-c+x@poste.tirelles.test"),
        ("à NADIR@EXAMPLE.ORG.", "email", "NADIR@EXAMPLE.ORG"),
        ("à x.y [at] oulma.example sous", "email", "x.y [at] oulma.example"),
        ("à x (arobase) example point org sous", "email", "x (arobase) example point org"),
        ("tél. 03 53 01 99 24.", "phone", "03 53 01 99 24"),
        ("au 03.53.01.13.94", "phone", "03.53.01.13.94"),
        ("au +33 (0)6 39 98 56 35 ;", "phone", "+33 (0)6 39 98 56 35"),
        ("au 0033639981728.", "phone", "0033639981728"),
        ("au (021) 00.51.07.", "phone", "(021) 00.51.07"),
        ("au 06 39 98 62\n14", "phone", "06 39 98 62\n14"),
        ("passeport n° FP4959501.", "id_number", "FP4959501"),
        ("NIN 195 8410 50958 234885", "id_number", "195 8410 50958 234885"),
        ("n° de sécurité soci-\nale 726074822154", "id_number", "726074822154"),
        ("(carte d'identit6 n° 012117879)", "id_number", "012117879"),
        ("domicile : 70, avenue des Oliviers, 30529 Chabet-Rim.", "address", "70, avenue des Oliviers, 30529 Chabet-Rim"),
        ("au Rue des Potiers n° 164, Chabet-Rim puis", "address", "Rue des Potiers n° 164, Chabet-Rim"),
        ("au Cité Amrane-Telli, Bât. D, Apt 35, Sidi-Marfa.", "address", "Cité Amrane-Telli, Bât. D, Apt 35, Sidi-Marfa"),
        ("demeure au 217 bis avenue des Potiers - Oued-Zirat.", "address", "217 bis avenue des Potiers - Oued-Zirat"),
        ("contactez Mlle Inès Zivroldani-Ramzevrane au", "person", "Inès Zivroldani-Ramzevrane"),
        ("contactez Mon5ieur M. Teflevrane au", "person", "M. Teflevrane"),
        ("Je soussigné Walid BELKO, agent", "person", "Walid BELKO"),
        ("cordialement\nLe Directeur\nM. Cherzofeche\nPage 1", "person", "M. Cherzofeche"),
        ("cordialement\nLe Directeur\nM. Karim Belko\nPage 1", "person", "Karim Belko"),
        ("contactez Ｍｍｅ Lаmіа Fаrgou au", "person", "Lаmіа Fаrgou"),
    ],
)
def test_found(text, kind, piece):
    found = p.find(text)
    assert [(f.kind, text[f.start : f.end]) for f in found] == [(kind, piece)]


@pytest.mark.parametrize(
    "text",
    [
        "Le code article 139328703 remplace le code 797727379.", "La commande n° 4596495339 porte sur 23 articles.", "Le tarif @ 12,50 l'unité reste inchangé.",
        "Mesures relevées : 01 99 / 02 61 / 03 53 sur la grille A4-30.", "La version 06.39.44 du formulaire du 16/12/2022.", "Voir FAC-2020-44318 et le lot 18-122-17.",
        "Montant : 19 385 768,90 dinars.", "Le Service Relations Publiques et la Direction Générale Adjointe.", "Veuillez agréer, Madame, Monsieur, nos salutations.",
        "la délég@tion reste", "La Responsable\nDésignation Quantité Montant", "il remplace le mur", None, "", " ",
    ],
)
def test_not_found(text):
    assert p.find(text) == []


def test_positions_are_those_of_the_stored_text():
    text = "a​b ﬁn ét­\né M. Kаrim Belko et 03 53 01 99 24"
    found = p.find(text)
    assert [(f.kind, text[f.start]) for f in found] == [("person", "K"), ("phone", "0")]


def test_long_text_is_read_whole():
    text = "mot " * 100_000 + "contactez M. Karim Belko au 03 53 01 99 24"
    assert [f.kind for f in p.find(text)] == ["person", "phone"] and text[p.find(text)[1].start :] == "03 53 01 99 24"


def safe(spark, texts, secret="s"):
    df = spark.createDataFrame(list(enumerate(texts)), "id BIGINT, t STRING")
    return [(r.safe_text, r.n_replaced) for r in p.pseudonymised(df, "id", "t", secret).orderBy("id").collect()]


def test_surrogates_are_consistent_distinct_and_typed(spark):
    texts = ["Voir Mme Leïla BELKO au 03 53 01 99 24.", "Voir Mme BELKO Leïla au +33 3 53 01 99 24 !", "Voir M. Karim Belka au 03 53 01 99 25.", "Rien.", None, ""]
    out = safe(spark, texts)
    names = [set(re.search(r"\[PERSON ([^\]]+)\]", t)[1].casefold().split()) for t, _ in out[:3]]
    assert names[0] == names[1] != names[2]
    phones = [re.sub(r"\D", "", re.search(r"\[PHONE ([^\]]+)\]", t)[1])[-9:] for t, _ in out[:3]]
    assert phones[0] == phones[1] != phones[2]
    assert out[3:] == [("Rien.", 0), (None, 0), ("", 0)] and [n for _, n in out[:3]] == [2, 2, 2]
    assert re.sub(r"\[[A-Z_]+ [^\]]*\]", "#", out[0][0]) == "Voir Mme # au #." and not any("elk" in t.lower() for t, _ in out[:3])
    given = re.search(r"\[PERSON (\S+)", out[0][0])[1]
    assert given.casefold() in p._WOMEN_SET
    assert safe(spark, texts) == out and safe(spark, texts, "other")[0] != out[0]


def test_no_two_parts_of_one_form_share_an_image_and_none_is_its_own():
    cipher = sg.Cipher("k")
    for n in (2, 3, 10, 700):
        images = [cipher.moved(i, n, "t") for i in range(n)]
        assert sorted(images) == list(range(n)) and all(i != x for i, x in enumerate(images))
    words = ["".join(w) for w in itertools.product("bcd", "aei", "mn", "ou")]
    images = {cipher.shuffled(w, "t") for w in words}
    assert len(images) == len(words) and all(w[0] in sg.ALPHABETS[1] and w[1] in sg.ALPHABETS[0] for w in images)
    assert cipher.shuffled("a-b.c", "t")[1::2] == "-." and cipher.shuffled("", "t") == ""
    with pytest.raises(ValueError):
        sg.Cipher("")


def test_numbers_keep_their_form_and_stay_distinct():
    maker = sg.Surrogates("k", (p.WOMEN, p.MEN))
    out = {maker.of("id_number", f"AB{i:07d}", f"ab{i:07d}") for i in range(2000)}
    assert len(out) == 2000 and all(re.fullmatch(r"[A-Z]{2}\d{7}", x) for x in out)
    streets = {maker.of("address", f"{i}, rue des Oliviers, Alger", "") for i in range(10, 99)}
    assert len(streets) == 89 and all(re.fullmatch(r"[1-9]\d, rue des [A-Z]\w+, [A-Z]\w+", x) and "Olivier" not in x for x in streets)
    mails = {maker.of("email", m, m) for m in ("a@x.org", "b@x.org", "a@y.org")}
    assert len(mails) == 3 and all(m.endswith(".example") for m in mails)


def test_names_keep_gender_script_and_coreference(spark):
    safe_text = safe(spark, ["Madame Jeanne Durand et Madame J. Durand ; M. Karim Durand.", "Monsieur Ανδρέας Παπαδάκης", "السيد احمد بنعلي", "Madame DURAND Jeanne"])
    jeanne, short, karim = re.findall(r"\[PERSON ([^\]]+)\]", safe_text[0][0])
    assert jeanne.split()[0].casefold() in p._WOMEN_SET and karim.split()[0].casefold() in p._MEN_SET
    assert short == f"{jeanne[0]}. {jeanne.split()[1]}" and karim.split()[1] == jeanne.split()[1]
    greek, arabic, other = (re.search(r"\[PERSON ([^\]]+)\]", t)[1] for t, _ in safe_text[1:])
    assert all("\u0370" <= c <= "\u03ff" for c in greek if c.isalpha()) and all("\u0600" <= c <= "\u06ff" for c in arabic if c.isalpha())
    assert set(other.casefold().split()) == set(jeanne.casefold().split()) and other.split()[0].isupper()


@pytest.mark.parametrize(
    ("text", "pieces"),
    [
        ("Tél. +213 550 12 34 56.", [("phone", "+213 550 12 34 56")]), ("Tél : 213 21 45 67 89", [("phone", "213 21 45 67 89")]), ("au +44 20 7946 0958", [("phone", "+44 20 7946 0958")]),
        ("au +1 (202) 555-0175 ou", [("phone", "+1 (202) 555-0175")]), ("SSN 123-45-6789", [("id_number", "123-45-6789")]), ("dossier 123-45-6789 clos", [("id_number", "123-45-6789")]),
        ("le contrat est signé par Jean Dupont et Marie Curie.", [("person", "Jean Dupont"), ("person", "Marie Curie")]), ("notre interlocuteur Zohir Belkadiouane", [("person", "Zohir Belkadiouane")]),
        ("à " + "a" * 141 + "@example.org", [("email", "a" * 141 + "@example.org")]), ("M. Иван Петров", [("person", "Иван Петров")]),
        ("12 rue du Chevalier de la Barre et du Grand Veneur de France, Alger puis", [("address", "12 rue du Chevalier de la Barre et du Grand Veneur de France, Alger")]),
        ("passeport " + "sous le numéro : " * 9 + "AB1234567", [("id_number", "AB1234567")]), ("passcport" + " sous le n° :" * 9 + " AB1234567", [("id_number", "AB1234567")]), ("sans label AB1234567", []),
        ("La Directrice " + "générale " * 9 + "\nAmel Zorgani\n", [("person", "Amel Zorgani")]),
    ],
)
def test_forms_without_bounds(text, pieces):
    assert [(f.kind, text[f.start : f.end]) for f in p.find(text)] == pieces


def test_one_number_in_all_formats(spark):
    forms = ["03 53 01 99 24", "+33 (0)3 53 01 99 24", "0033353019924", "03.53.01.99.24"]
    out = [re.search(r"\[PHONE ([^\]]+)\]", t)[1] for t, _ in safe(spark, [f"au {f} !" for f in forms])]
    assert len({re.sub(r"\D", "", x)[-9:] for x in out}) == 1 and out[0][0] == "0" and out[1].startswith("+33 (0)")


def test_empty_table(spark):
    df = spark.createDataFrame([], "id BIGINT, t STRING")
    assert p.pieces(df, "id", "t").count() == 0 and p.pseudonymised(df, "id", "t", "s").count() == 0


def test_surrogates_hold_across_the_tables_of_the_query(spark, tmp_path):
    line = "passeport n° AB{:07d}.".format
    spark.createDataFrame([(i, line(i)) for i in range(3)], "row_no BIGINT, content STRING").write.parquet(str(tmp_path / "generated_documents.parquet"))
    spark.createDataFrame([(i, line(i)) for i in range(1, 4)] + [(9, None)], "page_row_id BIGINT, raw_text STRING").write.parquet(str(tmp_path / "ocr_pages.parquet"))
    out = {(r.tab, r.row_id): r.safe_text for r in queries.p4_pseudonymised(spark, str(tmp_path)).collect()}
    letters, pages = ({k[1]: v for k, v in out.items() if k[0] == tab} for tab in ("generated_documents", "ocr_pages"))
    assert letters[1] == pages[1] and letters[2] == pages[2] and len({*letters.values(), *pages.values()}) == 5 and pages[9] is None


def test_no_key_no_surrogates(spark):
    with pytest.raises(ValueError):
        p.pseudonymised(spark.createDataFrame([], "id BIGINT, t STRING"), "id", "t", "")
