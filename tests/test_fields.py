import pytest
from pyspark.sql import functions as F

from parapheur.functions import text as t
from parapheur.operators import fields as fd

LETTER = """De : Service Planification
À : Direction Patrimoine
Alger, le
01/07/2025
REF : SAC/2025/357
Objet : La délégation informatique
P.J : 2

J'ai l'honneur de vous saisir de ce qui suit.
La commande est prête.
Veuillez agréer, Monsieur, nos salutations distinguées.
La Responsable"""


def one(spark, value, expression):
    return spark.createDataFrame([(value,)], "x STRING").select(expression(F.col("x")).alias("y")).first().y


def rule(spark, name, strategy, text):
    pages = fd.with_page_columns(spark.createDataFrame([(text,)], "raw STRING"), "raw")
    return pages.select(getattr(fd.BY_NAME[name], strategy)(fd.page_columns()).alias("v")).first().v


@pytest.mark.parametrize(
    ("line", "out"),
    [
        ("Obje1: X", "Objet : X"), ("R|EF", "R:EF"), ("P.1 02", "P.J : 02"), ("REF: SRI/2024/001", "Réf : SRI/2024/001"), ("Recevez, Monsieur", "Réf : cevez, Monsieur"),
        ("RÉF : A", "Réf : A"), ("  l’avis  du   jour ", "l'avis du jour"), ("", ""), (None, None),
    ],
)
def test_labels(spark, line, out):
    assert one(spark, line, t.repair_label) == out


def test_strict_labels_need_a_word_end(spark):
    assert one(spark, "Recevez, Monsieur", lambda c: t.repair_label(c, "strict")) == "Recevez, Monsieur"
    assert one(spark, "Objets divers", lambda c: t.repair_label(c, "strict")) == "Objets divers"


@pytest.mark.parametrize("code", ["SRI/2024/001", "SRI/DG-2024", "DF/N°12/2024"])
def test_reference_grammar(spark, code):
    assert one(spark, f"x {code} y", lambda c: F.regexp_substr(c, F.lit(t.U + t.REF_CODE))) == code


@pytest.mark.parametrize(("line", "noise"), [("22/05/2024", True), ("Service des achats", False), ("", True), ("www.site.dz", True), ("مكتب", True), ("ab", True), ("+++", True)])
def test_noise(spark, line, noise):
    assert one(spark, line, t.is_noise) is noise


@pytest.mark.parametrize(
    ("text", "kind"), [("prie ... transmet", "demande"), ("il transmet", "transmission"), ("nous informons", "information"), ("l'avis informé", "information"), ("rien", "autre"), ("àprie", "autre"), (None, None)]
)
def test_subtype(spark, text, kind):
    assert one(spark, text, t.document_subtype) == kind


@pytest.mark.parametrize(
    ("field", "regex", "heuristic"),
    [
        ("sender", "Service Planification", "Service Planification"),
        ("receiver", "Direction Patrimoine", "À : Direction Patrimoine"),
        ("ref_header", "SAC/2025/357", "SAC/2025/357"),
        ("date", "01/07/2025", "01/07/2025"),
        ("objet", "La délégation informatique", "La délégation informatique"),
        ("pj", "2", "02 pièces jointes"),
    ],
)
def test_planted_fields(spark, field, regex, heuristic):
    assert rule(spark, field, "regex", LETTER) == regex
    assert rule(spark, field, "heuristic", LETTER) == heuristic


def test_body_runs_from_opening_to_closing(spark):
    body = "J'ai l'honneur de vous saisir de ce qui suit.\nLa commande est prête."
    assert rule(spark, "body", "regex", LETTER) == body
    assert rule(spark, "body", "heuristic", LETTER) == body
    skip = "Suite aux\nObjet : X\nMonsieur,\nLe texte.\nRecevoir"
    assert rule(spark, "body", "heuristic", skip).startswith("Monsieur,")
    assert rule(spark, "body", "regex", "rien à voir") is None


@pytest.mark.parametrize(
    ("text", "out"),
    [
        ("P.J : 1", "01 pièce jointe"), ("ci-joint les quatre dossiers", "04 pièces jointes"), ("voir annexe", "01 pièce jointe"), ("les deux pièces jointes", "02 pièces jointes"),
        ("P.J : ０４", "04 pièces jointes"), ("trois documents sont ci-joints", "03 pièces jointes"), ("rien", None),
    ],
)
def test_attachments(spark, text, out):
    assert rule(spark, "pj", "heuristic", text) == out


def test_subject_candidates(spark):
    assert rule(spark, "objet", "heuristic", "Objet :\nDemande de congé annuel\npour le service des achats\n\nSuite à") == "Demande de congé annuel pour le service des achats"
    assert rule(spark, "objet", "heuristic", "pas de label") is None
    assert rule(spark, "objet", "heuristic", "Objet :") is None


def test_receiver_alternatives(spark):
    assert rule(spark, "receiver", "heuristic", "Texte\nMessieurs les membres du conseil\nde la direction\nObjet : x") == "Messieurs les membres du conseil\nde la direction"
    assert rule(spark, "receiver", "heuristic", "Premier service\nSecond service\nREF : A") == "Second service"


@pytest.mark.parametrize("text", [None, "", "\n\n", "x" * 50_000, "a\n" * 3000])
def test_odd_pages_crash_nothing(spark, text):
    df = spark.createDataFrame([(1, text, 50.0, "kept")], "id INT, raw STRING, conf DOUBLE, value STRING")
    found = fd.candidates(df, "raw", "conf", ["id"]).collect()
    assert not found if not (text or "").strip() else True
    assert fd.extract(df, "raw", "conf", ["id"]).count() == 1


def test_score_formula_and_choice(spark):
    df = spark.createDataFrame([(1, LETTER, 97.2)], "id INT, raw STRING, conf DOUBLE")
    found = fd.candidates(df, "raw", "conf", ["id"])
    rows = {(r.field, r.strategy): r for r in found.collect()}
    assert rows["sender", "regex"].score == pytest.approx(0.8 * 0.85 + 0.2 * 0.972 + 0.02, abs=5e-5)
    won = {r.field: r for r in fd.selected(found, ["id"]).collect()}
    assert won["sender"].strategy == "regex" and won["sender"].value == "Service Planification"
    first = {(r.field, r.strategy) for r in fd.ranked(found, ["id"]).where("place = 1").collect()}
    assert first == {(r.field, r.strategy) for r in won.values()}
    golden = spark.range(1).select(fd.candidate_score("sender", F.lit("Service X"), F.lit(0.96), F.lit(0.972)).alias("s")).first().s
    assert golden == 0.9824


def test_ties_go_to_the_longer_value_then_the_earlier_strategy(spark):
    rows = [("sender", s, v, 0.8, 1.0, 0.9, "", r) for r, (s, v) in enumerate([("regex", "ab"), ("heuristic", "abc"), ("rapid_fuzzy", "xyz")])]
    df = spark.createDataFrame([(1, *r) for r in rows], "id INT, field STRING, strategy STRING, value STRING, strategy_score DOUBLE, page_confidence DOUBLE, score DOUBLE, reason STRING, strategy_rank INT")
    assert fd.selected(df, ["id"]).first().value == "abc"


def test_decoder(spark):
    pages = fd.with_page_columns(spark.createDataFrame([(LETTER,), ("",)], "raw STRING"), "raw")
    sender, receiver = fd.decoded_head(fd.page_columns())
    rows = pages.select(sender.alias("s"), receiver.alias("r")).collect()
    assert tuple(rows[0]) == ("De : Service Planification", "À : Direction Patrimoine") and tuple(rows[1]) == (None, None)
