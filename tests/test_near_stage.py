"""The similarity stage at work: exact neighbours, and only what can count is looked at closely."""

import random
from difflib import SequenceMatcher

import numpy as np
import pandas as pd
import pytest

from inkstone.functions import vector
from inkstone.operators import dedupe, search
from inkstone.plans import catalogue


def brute(own, q, n, v, k, metric, keep_self):
    out = []
    for i, x in zip(own, q, strict=True):
        if metric == "cosine":
            s = (v @ x) / ((np.sqrt((v * v).sum(1)) + 1e-8) * (np.sqrt(x @ x) + 1e-8))
        else:
            s = 1 / (1 + ((v - x) ** 2).sum(1))
        near = sorted((-round(float(t), 12), int(m)) for t, m in zip(s, n, strict=True) if keep_self or m != i)
        out += [(int(i), m, -t) for t, m in near[:k]]
    return out


@pytest.mark.parametrize("metric", ["cosine", "closeness"])
@pytest.mark.parametrize("size", [1.0, 1e-6, 300.0])
def test_nearest_is_exact(monkeypatch, metric, size):
    """As a comparison of all pairs says, over ties, several tiles, and vectors that single precision can't tell apart."""
    monkeypatch.setattr(search, "ROWS", 16)
    monkeypatch.setattr(search, "COLUMNS", 96)
    rng = np.random.default_rng(3)
    v = rng.integers(0, 4, (500, 12)) * size
    v[100:130] = v[:30]
    v[130:160] = v[:30] * (1 + 1e-9)
    q = np.concatenate([v[:20], rng.random((23, 12)) * size, np.zeros((2, 12))])
    n, own = rng.permutation(500), np.arange(len(q))
    for keep_self in (True, False):
        near = search._Nearest(own, q, 3, metric, keep_self)
        for at in range(0, 500, 200):
            near.add(n[at : at + 200], v[at : at + 200])
        got, want = near.rows().to_pylist(), brute(own, q, n, v, 3, metric, keep_self)
        assert [(r["q"], r["n"]) for r in got] == [r[:2] for r in want]
        assert np.allclose([r["s"] for r in got], [r[2] for r in want], rtol=0, atol=2e-12)


def test_few_pairs_in_double_precision(monkeypatch):
    """Under 2 % of the pairs are scored one by one."""
    rng, scored, score = np.random.default_rng(5), [], search._Nearest._score
    monkeypatch.setattr(search._Nearest, "_score", lambda self, q, v, c: scored.append(len(q)) or score(self, q, v, c))
    q, v = (x / np.sqrt((x * x).sum(1))[:, None] for x in (rng.poisson(1, (500, 64)).astype(float), rng.poisson(1, (10000, 64)).astype(float)))
    near = search._Nearest(np.arange(500), q, 3, "closeness", True)
    near.add(np.arange(10000), v)
    assert near.rows().num_rows == 1500 and sum(scored) < 0.02 * 500 * 10000


def test_only_able_rows_are_compared(spark, monkeypatch):
    """Texts are joined only for rows of which a candidate can reach a threshold; the rows out are those of all pairs."""
    random.seed(2)
    text = lambda n: "".join(random.choice("集合数列函数概率统计0123456789abcdef") for _ in range(n))
    old = [(i, f"o{i}", text(60), [random.random() for _ in range(8)]) for i in range(200)]
    old += [(200, "o200", "", [0.0] * 8), (201, "o201", "ab" * 150, [9.0] * 8)]
    new = [(1000 + i, f"n{i}", text(60), [10 * i + 5.0] * 8) for i in range(40)]
    new += [(1040 + i, f"m{i}", old[i][2][:57] + text(i % 7), [x + i / 90 for x in old[i][3]]) for i in range(40)]
    new += [(1090, "e", "。", [0.0] * 8), (1091, "p", "ba" * 150, [9.3] * 8)]
    schema = "seq bigint, id string, content string, embedding array<double>"
    seen, written = {}, dedupe.written
    monkeypatch.setattr(dedupe, "written", lambda df, name: seen.setdefault(name, written(df, name)))
    got = {(r.seq, r.match_id, round(r.embedding_similarity, 9), round(r.text_similarity, 9)) for r in dedupe.similar_to_stored(spark.createDataFrame(new, schema), spark.createDataFrame(old, schema)).collect()}
    want = set()
    for seq, _, t, v in new:
        near = sorted((-round(1 / (1 + sum((a - b) ** 2 for a, b in zip(v, w, strict=True))), 12), n, i, u) for n, i, u, w in old)[:3]
        ratios = [(SequenceMatcher(None, t, u).ratio(), -s, -at, i) for at, (s, _, i, u) in enumerate(near) if u and t != "。"]
        if ratios and (max(ratios)[0] >= 0.92 or max(ratios)[1] >= 0.8):
            want.add((seq, max(ratios)[3], round(max(ratios)[1], 9), round(max(ratios)[0], 9)))
    assert got == want and len(want) > 20
    assert not {r.new for r in seen["pairs"].collect()} & set(range(1000, 1040))


def test_text_bound():
    """The bound is never under the ratio, and NULL for empty texts only."""
    random.seed(4)
    a = ["".join(random.choice("ab集c") for _ in range(random.randint(0, 300))) for _ in range(200)]
    b = ["".join(random.choice("ab合d😀") for _ in range(random.randint(0, 300))) for _ in range(199)] + [a[-1]]
    counts = [dedupe._counts.func(pd.Series(x)) for x in (a, b)]
    for x, y, most in zip(a, b, dedupe._most.func(*counts), strict=True):
        assert np.isnan(most) if not (x and y) else most >= SequenceMatcher(None, x, y).ratio()


def test_first_stages_run_once(spark, sf, monkeypatch):
    """What the first two stages leave is written, so the third stage's plans don't work them out again."""
    seen, written = {}, catalogue.written
    monkeypatch.setattr(catalogue, "written", lambda df, name: seen.setdefault(name, written(df, name)))
    report = catalogue.dedupe_report(spark, sf).first()
    assert seen["left"].count() == report.after_db_existing_id == report.after_similarity + seen["similar"].count()


def test_words_are_hashed_once(monkeypatch):
    """A word of many texts is hashed once a batch; vectors are those of hashing every word."""
    import xxhash

    hashed, digest = [], xxhash.xxh64_intdigest
    monkeypatch.setattr(xxhash, "xxh64_intdigest", lambda b: hashed.append(b) or digest(b))
    texts = ["集合 函数 函数", "", None, "  ", "函数 a\ud800 集合"] * 20
    got = vector.hashed_words(pd.Series(texts), 8)
    assert len(hashed) == 3
    for t, v in zip(texts, got, strict=True):
        want = np.zeros(8)
        for w in (t or "").split():
            want[digest(w.encode("utf-8", "surrogatepass")) % 8] += 1
        length = np.sqrt(want @ want)
        assert v.dtype == np.float32 and (v == (want / length if length else want).astype(np.float32)).all()
