import random

import pytest

from parapheur.llm import leakage as lk

WORDS = [f"mot{i}" for i in range(200)] + ["a", "à", "l", "été"]


def run(spark, docs, items, **options):
    d = spark.createDataFrame(list(enumerate(docs)), "doc_id BIGINT, text STRING")
    i = spark.createDataFrame(list(enumerate(items)), "item_id BIGINT, text STRING")
    return sorted(tuple(r) for r in lk.contaminated(d, i, **options).collect())


def brute(docs, items, n=12):
    out = set()
    split = lambda t: lk.plain_words(t or "").split()
    for a, d in enumerate(docs):
        grams = {tuple(split(d)[k : k + n]) for k in range(len(split(d)) - n + 1)}
        for b, i in enumerate(items):
            w = split(i)
            if any(tuple(w[k : k + n]) in grams for k in range(len(w) - n + 1)):
                out.add((a, b))
    return sorted(out)


def test_against_brute_force(spark):
    rng = random.Random(2)
    text = lambda n: [rng.choice(WORDS) for _ in range(n)]
    items = [text(rng.randrange(5, 40)) for _ in range(30)]
    docs = []
    for _ in range(80):
        d, i = text(60), rng.choice(items)
        k = rng.randrange(6, 20)
        s = rng.randrange(max(1, len(i) - k))
        docs.append(d[:30] + i[s : s + k] + d[30:])
    items.append(["a", "l"] * 8)
    docs.append(["x"] + ["l", "a"] * 9)
    docs, items = [" ".join(d) for d in docs] + [None, "", "x"], [" ".join(i) for i in items] + [None, ""]
    want = brute(docs, items)
    assert len(want) > 10 and run(spark, docs, items) == want
    assert run(spark, docs, items, block_chars=500) == want  # items in several blocks


def test_form_does_not_matter_but_words_do(spark):
    words = "Le comité de suivi a révoqué la décision du service avant le huit juin dernier"
    same = "LE Comité, de​ suivi\na révoqué — la ｄécision (du) ser­vice avant\n\nle huit juin dernier !"
    inside = words.replace("dernier", "dernières").replace("Le comité", "Le sous comité")
    assert run(spark, [same, "xx" + words, inside], [words]) == [(0, 0), (1, 0), (2, 0)]
    assert run(spark, [" ".join(words.split()[:11]), " ".join(words.split()[::-1])], [words]) == []


def test_edit_budget(spark):
    words = "comité suivi révoqué décision service avant juin dernier agence centrale régionale notification"
    typo = words.replace("décision", "décisiom").replace("agence", "agences")
    gap = words.replace("décision ", "")
    assert run(spark, ["début " + typo + " fin", gap], [words], budget=0) == []
    assert run(spark, ["début " + typo + " fin", gap], [words], budget=2) == [(0, 0)]


def edits_to_find(passage, text):
    row = [0] * (len(text) + 1)
    for i, c in enumerate(passage):
        last, row[0] = row[0], i + 1
        for j, d in enumerate(text):
            last, row[j + 1] = row[j + 1], min(last + (c != d), row[j] + 1, row[j + 1] + 1)
    return min(row)


def test_edits_against_brute_force(spark):
    rng = random.Random(5)
    items = [" ".join(rng.choice(WORDS) for _ in range(rng.randrange(12, 16))) for _ in range(6)]
    docs = []
    for _ in range(40):
        t = list(rng.choice(items))
        for _ in range(rng.randrange(5)):
            k = rng.randrange(len(t))
            t[k : k + rng.randrange(2)] = rng.choice(["", "x", " ", "été"[:1]])
        docs.append("début " + "".join(t) + " fin")
    for budget in (0, 1, 2, 3):
        want = []
        for a, d in enumerate(map(lk.plain_words, docs)):
            for b, words in enumerate(i.split() for i in items):
                if any(edits_to_find(f" {' '.join(lk.plain_words(' '.join(words[k : k + 12])).split())} ", d) <= budget for k in range(len(words) - 11)):
                    want.append((a, b))
        assert run(spark, docs, items, budget=budget) == want and (budget == 0 or want)


def test_common_grams_are_expanded_in_parts(monkeypatch):
    monkeypatch.setattr(lk, "HITS", 50)
    items = [(i, " ".join(WORDS[:20]) + f" z{i}") for i in range(30)]
    index = lk.ItemIndex(items, 12, 0)
    assert sorted(lk.leaked(["x " + " ".join(WORDS[:20])] * 3 + ["y"], index)) == [(d, i) for d in range(3) for i in range(30)]


def test_empty_tables_and_repeated_rows(spark):
    words = " ".join(WORDS[:20])
    assert run(spark, [], [words]) == [] and run(spark, [words], []) == []
    assert run(spark, [words, words], [words, words]) == [(0, 0), (0, 1), (1, 0), (1, 1)]
    assert run(spark, ["z " * 300_000 + words], [words]) == [(0, 0)]


def test_report_names_clean_items_too(spark):
    found = spark.createDataFrame([(1, 5), (2, 5)], "doc_id BIGINT, item_id BIGINT")
    items = spark.createDataFrame([(5,), (6,)], "item_id BIGINT")
    assert {(r.item_id, r.n_documents) for r in lk.leak_report(found, items).collect()} == {(5, 2), (6, 0)}


@pytest.mark.parametrize("text", ["", " ", "…", None])
def test_texts_without_words(spark, text):
    assert run(spark, [text], [text]) == []
