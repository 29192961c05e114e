import numpy as np
import pytest

from parapheur.llm import mixing as mx

TARGETS = "source STRING, target_share DOUBLE, max_repeats INT"


def corpus(spark, sizes):
    rows = [(n, s, "mot " * k if k is not None else None) for n, (s, k) in enumerate((s, k) for s, ks in sizes.items() for k in ks)]
    return spark.createDataFrame(rows, "doc_id BIGINT, source STRING, text STRING")


def test_flight_keeps_number_and_size_and_decides_all_but_two():
    rng = np.random.default_rng(1)
    sizes = rng.integers(1, 900, 500).astype(float)
    p = np.full(500, 0.37)
    q = mx.flight(p, sizes, np.random.default_rng(2))
    assert ((q > 0) & (q < 1)).sum() <= 2
    assert q.sum() == pytest.approx(p.sum()) and (q * sizes).sum() == pytest.approx((p * sizes).sum())
    mean = np.mean([mx.flight(np.full(40, 0.3), sizes[:40], np.random.default_rng(i)) for i in range(800)], axis=0)
    assert abs(mean - 0.3).max() < 0.08  # everyone keeps their chance


def test_equal_sizes_and_few_units():
    q = mx.flight(np.full(9, 0.5), np.full(9, 7.0), np.random.default_rng(0))
    assert q.sum() == pytest.approx(4.5)
    landed = [mx.landing(np.array([0.5, 1.0, 0.25, 0.7]), np.array([4.0, 9.0, 8.0, 1.0]), np.random.default_rng(i)) for i in range(3000)]
    assert {x for p in landed for x in p} <= {0.0, 1.0} and abs(np.mean(landed, axis=0) - [0.5, 1.0, 0.25, 0.7]).max() < 0.04  # chances are kept
    assert np.std([p @ [4.0, 9.0, 8.0, 1.0] for p in landed]) < 3  # independent draws: 4.2
    assert mx.flight(np.array([]), np.array([]), np.random.default_rng(0)).size == 0


@pytest.mark.parametrize("block", [20_000, 60])
def test_shares_and_limits(spark, block):
    rng = np.random.default_rng(3)
    sizes = {"big": rng.integers(1, 300, 700).tolist(), "mid": rng.integers(1, 300, 300).tolist(), "small": rng.integers(1, 300, 80).tolist(), "other": [5, 6]}
    targets = spark.createDataFrame([("big", 0.5, 1), ("mid", 0.3, 2), ("small", 0.15, 3), ("gone", 0.05, 2)], TARGETS)
    mix = mx.Mixture(corpus(spark, sizes), targets, block=block)
    shares = {r.source: r for r in mix.shares().collect()}
    assert shares["gone"].used_tokens == 0 and shares["gone"].goal_share == 0 and "other" not in shares
    for name in ("big", "mid", "small"):
        assert shares[name].actual_share == pytest.approx(shares[name].goal_share, abs=0.002)
        assert shares[name].most_copies <= shares[name].max_repeats
    assert sum(r.goal_share for r in shares.values()) == pytest.approx(1)
    chosen = mix.selection().collect()
    assert len({r.doc_id for r in chosen}) == len(chosen) and all(r.copies >= 1 for r in chosen)
    assert sum(r.n_tokens * r.copies for r in chosen) == sum(r.used_tokens for r in shares.values())


def test_odd_inputs(spark):
    docs = corpus(spark, {"a": [3, None, 0, 5], None: [4], "b": [7]})
    targets = spark.createDataFrame([("a", 0.5, 1), ("b", 0.0, 3), (None, 0.5, 1)], TARGETS)
    assert {r.source for r in mx.Mixture(docs, targets).selection().collect()} == {"a"}
    for d, t in ((docs.limit(0), targets), (docs, targets.limit(0))):
        mix = mx.Mixture(d, t)
        assert mix.selection().count() == 0 and mix.shares().where("used_tokens > 0").isEmpty()


def test_token_counts_of_long_texts_are_those_of_the_whole():
    path = f"{mx.TOKENIZERS}/{mx.VOCABULARY}"
    text = "L'agence a reçu le bordereau n° 17. " * 9000
    assert mx.n_tokens(text, path) == len(mx.encoding(path).encode_ordinary(text))
    assert mx.n_tokens("x\ud800y", path) > 0 and mx.n_tokens("a" * 250_000, path) > 0
    odd = ("x" * 130_000 + " été" * 9 + "12 34 " * 40_000) * 2
    assert mx.n_tokens(odd, path) == len(mx.encoding(path).encode_ordinary(odd))
