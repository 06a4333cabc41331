import random

import numpy as np
import pytest

from inkstone.llm import leakage, packing, spans
from inkstone.llm.text import WindowHash, codes, letters_digits, local_combine
from tests.llm.brute import leaks
from tests.llm.brute import spans as brute_spans

DOC = "doc_id bigint, text string, k string, id string, pos int"


def frame(spark, docs):
    return spark.createDataFrame([(d, t, "k", "i", 0) for d, t in docs], DOC).repartition(3)


def some_text(r, n):
    return "".join(r.choice("abcdefgh 的一是不了\n") for _ in range(n))


@pytest.mark.parametrize("least", [12, 60, 200])
def test_shared_spans(spark, least):
    r = random.Random(least)
    docs = [(i, some_text(r, r.randint(0, 5 * least))) for i in range(12)]
    block = some_text(r, 2 * least)
    docs += [(20 + i, some_text(r, r.randint(0, least)) + block[r.randint(0, least) :][: r.randint(least - 2, 2 * least)] + some_text(r, 9)) for i in range(8)]
    docs += [(40, docs[0][1]), (41, block + block), (42, "ab" * 3 * least), (43, "ab" * 2 * least + "c"), (44, None), (45, ""), (46, "z" * 4 * least)]
    docs += [(50, block[:least]), (51, "x" + block[: least - 1]), (52, some_text(r, 3) * 1000)]
    got = {tuple(x) for x in spans.shared_spans(frame(spark, docs), min_len=least).collect()}
    assert got == brute_spans(docs, least)
    part = {x.doc_id: (x.n_chars, x.shared_chars) for x in spans.shared_fraction(frame(spark, docs), min_len=least).collect()}
    want = {d: 0 for d, _ in docs}
    for d, a, b in got:
        want[d] += b - a + 1
    assert part == {d: (len(t or ""), want[d]) for d, t in docs}
    assert spans.shared_spans(frame(spark, docs).where("doc_id < 0"), min_len=least).count() == 0


def test_covers():
    assert all(spans.covers(p, c) for p, c in spans.COVERS.items())
    assert spans.cover_for(200)[0] == 133 and spans.cover_for(1) == (1, (0,), 1)


def test_window_hash():
    h = WindowHash(5)
    text = "abcde" * 30_000  # over two pieces
    got = h(codes(text))
    assert len(got) == len(text) - 4 and len(set(got.tolist())) == 5 and (got[:5] == got[100_000:100_005]).all()
    assert len(h(codes("abc"))) == 0


def test_local_combine():
    key, owner = np.array([7, 7, 7, 8, 8, 9], np.uint64), np.array([1, 1, 2, 3, 3, 4])
    known, send = local_combine(key, owner)
    assert known.tolist() == [True, True, True, False, False, False] and send.sum() == 4 and send[:3].sum() == 1
    assert [x.tolist() for x in local_combine(key[:0], owner[:0])] == [[], []]


def test_leaks(spark):
    r = random.Random(4)
    items = [(i, some_text(r, 90).replace(" ", "，")) for i in range(9)] + [(10, "short"), (11, None), (12, "Ｆｕｌｌ Width" * 8)]
    docs = [(i, some_text(r, 300)) for i in range(6)]
    docs += [(100 + i, some_text(r, 50) + " ".join(items[i][1][r.randint(0, 20) :][: r.randint(44, 80)]) + some_text(r, 20)) for i in range(9)]
    docs += [(200, "FULLWIDTH" * 8), (201, None), (202, ""), (203, items[0][1] + items[1][1]), (204, items[2][1][:40].upper())]
    d, it = frame(spark, docs), spark.createDataFrame([(i, t, "C", 1) for i, t in items], "item_id bigint, text string, answer string, id int")
    want = leaks(docs, items)
    assert {tuple(x) for x in leakage.leaked(d, it).collect()} == want
    for chars in (10**6, 100):
        rows = leakage.leaked_spans(d, it, block_chars=chars).collect()
        assert {(x.doc_id, x.item_id) for x in rows} == want
        for x in rows:
            piece = letters_digits(dict(docs)[x.doc_id][x.start_pos - 1 : x.end_pos])
            assert len(piece) >= 40 and piece in letters_digits(dict(items)[x.item_id])
    assert leakage.leaked(d.where("doc_id < 0"), it).count() == 0 and leakage.leaked(d, it.where("item_id < 0")).count() == 0


def test_origin():
    for t in ("éa ﬁ２①", "가 각", "", "x̄y"):
        assert len(leakage.origin(t)) == len(letters_digits(t))


def test_pack(spark):
    r = random.Random(6)
    docs = [(i, "好a"[r.randint(0, 1)] * r.randint(0, 90)) for i in range(300)] + [(900, "汉字" * 100), (901, None), (902, ""), (903, "x" * 100)]
    for rule in ("dot", "norm"):
        got = packing.pack(frame(spark, docs), capacity=100, max_items=7, rule=rule, group_items=100).collect()
        bins, per = {}, {}
        for x in got:
            bins.setdefault(x.container, []).append(x.tokens)
            per.setdefault(x.doc_id, []).append(x)
        size = {d: len(t.encode()) for d, t in docs if t is not None}
        assert {d: sum(p.tokens for p in v) for d, v in per.items()} == size
        assert all(sum(b) <= 100 and len(b) <= 7 for b in bins.values())
        assert {d for d, v in per.items() if len(v) > 1} == {d for d, n in size.items() if n > 100}
        assert all(len(v) == v[0].n_pieces for v in per.values())
        assert len(bins) <= 1.15 * sum(size.values()) / 100 + 3
    assert [x.doc_id for x in packing.cut_documents(frame(spark, [(1, "字" * 3000), (2, "a" * 8192), (3, "a" * 8193)])).orderBy("doc_id").collect()] == [1, 3]
    assert packing.pack(frame(spark, docs).where("doc_id < 0")).count() == 0


def test_every_capacity_decides():
    """Each capacity by itself, the others wide, keeps pieces apart that would fit without it."""
    fit = lambda sizes, *a, rule="dot": len(set(packing.best_fit(np.array(sizes), *a, rule).tolist()))
    for rule in ("dot", "norm"):
        assert fit([6, 4, 5, 5], 10, 9, 1e9, rule=rule) == 2 and fit([6, 5, 5, 5], 10, 9, 1e9, rule=rule) == 3
        assert fit([1] * 6, 10, 9, 1e9, rule=rule) == 1 and fit([1] * 6, 10, 2, 1e9, rule=rule) == 3
        assert fit([6, 4, 3, 3], 16, 9, 1e9, rule=rule) == 1 and fit([6, 4, 3, 3], 16, 9, 36.0, rule=rule) == 2
        assert fit([9, 1, 1], 10, 9, 80.0, rule=rule) == 2  # the first is alone
    bins = packing.best_fit(np.array([50, 30, 60, 40]), 90, 9, 1e9)
    assert bins[2] == bins[1] and bins[0] == bins[3]  # the tightest container, not the first


def test_production_capacities_bind(spark):
    r = random.Random(16)
    docs = [(i, "x" * r.randint(1, 60)) for i in range(900)] + [(1000 + i, "y" * 7900) for i in range(5)] + [(2000 + i, "z" * 5000) for i in range(8)]
    bins = {}
    for x in packing.pack(frame(spark, docs)).collect():
        bins.setdefault(x.container, []).append(x.tokens)
    most = packing.ATTENTION * 8192**2
    assert all(len(b) <= packing.MAX_ITEMS and sum(b) <= 8192 and (len(b) == 1 or sum(t * t for t in b) <= most) for b in bins.values())
    assert any(len(b) == packing.MAX_ITEMS for b in bins.values()) and sum(b == [7900] for b in bins.values()) == 5


def test_cut_points():
    raw = ("汉" * 10).encode()
    ends = packing.cut_points(raw, 10)
    assert ends == [9, 18, 27, 30] and all(raw[a:b].decode() for a, b in zip([0, *ends], ends, strict=False))
