import itertools
import random

import numpy as np
import pytest

from parapheur.llm import codes, spans
from parapheur.llm.components import connected_components

L, G = 60, 24


def texts(seed=4, n=40):
    rng = random.Random(seed)
    fresh = lambda k: "".join(rng.choice("abcdé fgh") for _ in range(k))
    pool = [fresh(rng.randrange(40, 160)) for _ in range(8)]
    out = []
    for _ in range(n):
        t = fresh(rng.randrange(0, 80)) + rng.choice(pool) + fresh(rng.randrange(0, 80))
        out.append(t)
    return out + [out[0], out[0], None, "", "court", "ab" * 100, "ba" * 90, fresh(30) + "ab" * 40]


def brute(docs):
    windows = {}
    for i, t in enumerate(docs):
        for k in range(len(t or "") - L + 1):
            windows.setdefault(t[k : k + L], set()).add(i)
    pairs = {p for s in windows.values() for p in itertools.combinations(sorted(s), 2)}
    cover = {}
    for i, t in enumerate(docs):
        mark = bytearray(len(t or ""))
        for k in range(len(t or "") - L + 1):
            if len(windows[t[k : k + L]]) > 1:
                mark[k : k + L] = b"\1" * L
        cover[i] = sum(mark) if t is not None else None
    return sorted(pairs), cover


@pytest.mark.parametrize(("bands", "rows"), [(1, 4), (3, 2), (1, 1)])
def test_against_all_windows(spark, bands, rows):
    docs = texts()
    pairs, cover = brute(docs)
    shared = spans.SharedSpans(spark.createDataFrame([(i, t, 1) for i, t in enumerate(docs)], "doc_id BIGINT, text STRING, rep INT"), length=L, gram=G, bands=bands, rows=rows)
    assert sorted(tuple(r) for r in shared.pairs().collect()) == pairs and len(pairs) > 30
    assert {r.doc_id: r.shared_chars for r in shared.shares().collect()} == cover
    parent = {i: i for p in pairs for i in p}
    for a, b in pairs:
        ra, rb = a, b
        while parent[ra] != ra:
            ra = parent[ra]
        while parent[rb] != rb:
            rb = parent[rb]
        parent[max(ra, rb)] = min(ra, rb)
    root = lambda x: x if parent[x] == x else root(parent[x])
    assert {r.doc_id: r.cluster for r in shared.clusters().collect()} == {i: root(i) for i in parent}
    rep = {r.doc_id: r.rep for r in shared.membership().collect()}
    linked = {tuple(r) for r in shared.class_pairs().collect()}
    links = {i: sum(i in p for p in linked) for i in set(rep.values())}
    assert {r.doc_id: (r.rep, r.n_copies, r.n_links) for r in shared.class_rows().collect()} == {i: (r, list(rep.values()).count(r), links[r]) for i, r in rep.items()}
    assert {(a, b) for a, b in pairs if rep[a] != rep[b]} == {(a, b) for a, b in itertools.combinations(sorted(rep), 2) if (min(rep[a], rep[b]), max(rep[a], rep[b])) in linked}


def test_nothing_to_share(spark):
    empty = spans.SharedSpans(spark.createDataFrame([], "doc_id BIGINT, text STRING"))
    assert empty.pairs().count() == 0 and empty.shares().count() == 0 and empty.clusters().count() == 0 and empty.stretches().count() == 0
    one = spans.SharedSpans(spark.createDataFrame([(1, "x" * 400), (1, "x" * 400), (None, "x" * 400), (2, "y" * 400)], "doc_id BIGINT, text STRING"))
    assert one.pairs().count() == 0


def test_every_span_holds_a_whole_paragraph_cut_alike():
    cutter, rng = spans.Cutter(L, G), random.Random(1)
    cut = lambda t: {(i, n, int(v[0])) for _, s, z, f in cutter.paragraphs([t]) for i, n, v in zip(s.tolist(), z.tolist(), zip(*f))}
    for letters in ("ab", "abcdefgh ", "a"):
        for _ in range(60):
            span, fill = ("".join(rng.choice(letters) for _ in range(n)) for n in (L, 200))
            a, b = fill[:70] + span + fill[70:90], fill[100:103] + span + fill[110:]
            inside = [{(i - at, n, v) for i, n, v in cut(t) if i >= at and i + n <= at + L} for t, at in ((a, 70), (b, 3))]
            assert inside[0] & inside[1]
    assert not list(cutter.paragraphs([])) and not list(cutter.paragraphs(["", "x"]))


def test_repetitive_text_takes_no_longer_than_other(spark):
    df = spark.createDataFrame([(1, "-" * 300_000), (2, "-" * 250_000 + "x"), (3, "y" * 300)], "doc_id BIGINT, text STRING")
    shared = spans.SharedSpans(df)
    assert [tuple(r) for r in shared.pairs().collect()] == [(1, 2)]
    assert {r.doc_id: r.shared_chars for r in shared.shares().collect()} == {1: 300_000, 2: 250_000, 3: 0}


def test_removals_keep_one_of_each_group_of_like_texts(spark):
    rng = random.Random(3)
    fresh = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    a, b = fresh(900), fresh(400)
    docs = [(5, a), (2, a), (9, a + fresh(40)), (3, b + fresh(900)), (4, b + fresh(900)), (7, "short"), (8, None)]
    out = {r.doc_id: (r.cluster, r.keep) for r in spans.SharedSpans(spark.createDataFrame(docs, "doc_id BIGINT, text STRING")).removals().collect()}
    assert out == {2: (2, True), 5: (2, False), 9: (2, False), 3: (3, True), 4: (4, True)}


def test_sliding_min_and_window_hashes():
    x = np.random.default_rng(1).integers(0, 99, 500).astype(np.uint64)
    for w in (1, 2, 7, 499, 500, 501):
        assert codes.sliding_min(x, w).tolist() == [x[i : i + w].min() for i in range(500 - w + 1)]
    c = np.frombuffer(("abcde" * 50).encode("utf-32-le"), np.uint32)
    h = codes.Prefix(c).windows(7)
    assert len(set(h.tolist())) == 5 and (codes.Prefix(c).at(np.arange(50), 7) == h[:50]).all() and len(codes.Prefix(c).windows(999)) == 0


def test_components_of_chains_stars_and_loops(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, k) for k in range(101, 160)] + [(7, 7), (200, 201), (201, 200), (None, 3)]
    df = spark.createDataFrame(edges, "a BIGINT, b BIGINT")
    got = {r.node: r.component for r in connected_components(df).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{i: 100 for i in range(100, 160)}, 200: 200, 201: 200}
    assert connected_components(df.limit(0)).count() == 0


def test_a_crowd_is_one_passage(spark):
    crowd = spans.SharedSpans(spark.createDataFrame([], "doc_id BIGINT, text STRING"))
    crowd.candidates = spark.range(600).selectExpr("explode(array(1L, 2L)) AS w1", "1 AS w2", "9000000000000000000 + id AS rep", "1 AS start", "false AS again")
    assert crowd.links.count() == 600 * 599 // 2 and crowd.links.where("common <> 2").isEmpty()
