import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from inkstone.llm import components, incremental, index, neardup
from inkstone.llm.text import codes, gram_ids
from tests.llm.brute import groups, norm, rejected, similarity

WORDS = "集合函数数列概率向量统计导数不等式三角立体几何排列组合命题充要条件样本平均方差直线椭圆抛物线公比首项公差" * 2


def text(r, n=60):
    return "".join(r.choice(WORDS) + (str(r.randint(10, 99)) if r.random() < 0.3 else "") for _ in range(n))


def edited(r, t, n):
    t = list(t)
    for _ in range(n):
        t[r.randrange(len(t))] = r.choice(["", "改", "，", "9"])
    return "".join(t)


@pytest.fixture(scope="module")
def texts():
    r = random.Random(5)
    out = []
    for _ in range(25):
        t = text(r)
        out += [t, edited(r, t, 2), edited(r, edited(r, t, 3), 3), t.replace("数", " 数 ")][: r.randint(1, 4)]
    r.shuffle(out)
    return [*out, None, "", "  ", "ab", "AB", "ａb"]


def test_groups(spark, texts):
    rows = list(enumerate(texts, 100))
    df = spark.createDataFrame([(q, t, "x", 1) for q, t in rows], "seq bigint, content string, key string, node int").repartition(3)
    got = {tuple(r) for r in neardup.near_groups(df).select("group_seq", "seq").collect()}
    assert got == groups(rows)
    assert neardup.near_groups(df.where("seq < 0")).count() == 0


def test_large_group_of_copies(spark):
    """Half of all rows are one text or near it: all come into one group, by links to few nodes."""
    r = random.Random(1)
    base = text(r, 80)
    rows = [(i, base if i % 3 else edited(r, base, 3)) for i in range(400)] + [(1000 + i, text(r)) for i in range(50)]
    got = neardup.near_groups(spark.createDataFrame(rows, "seq bigint, content string")).collect()
    assert {x.seq for x in got} == set(range(1, 400)) and {x.group_seq for x in got} == {0}


def test_signature():
    """Unlike places of signatures are never more than the runs that one of two texts has alone."""
    r = random.Random(8)
    texts = [norm(text(r, r.randint(1, 90))) for _ in range(60)]
    grams = [gram_ids(t) for t in texts]
    _, _, bits = index.signatures(grams)
    assert bits.shape == (60, index.WORDS)
    for i in range(60):
        for j in range(i):
            unlike = int(np.bitwise_count((bits[i] ^ bits[j]).view(np.uint64)).sum())
            assert unlike <= len(set(grams[i].tolist()) ^ set(grams[j].tolist()))
    assert codes("a好").tolist() == [97, 22909]


@pytest.mark.parametrize("most", [index.LIST, 7])
def test_candidates_hold_all_pairs(spark, monkeypatch, most):
    """The index's pairs hold every pair of the similarity, with lists whole or divided, by tag, and with one side's bound."""
    monkeypatch.setattr(index, "LIST", most)
    r = random.Random(11)
    base = [text(r, 25) for _ in range(8)]
    texts = [norm(edited(r, r.choice(base), r.randint(0, 6))) for _ in range(80)] + [norm("".join(r.choice("abc") for _ in range(r.randint(3, 12)))) for _ in range(80)]
    texts = sorted(set(texts), key=texts.index)
    tag = [r.randrange(3) for _ in texts]
    nodes = spark.createDataFrame([(i, t, g) for i, (t, g) in enumerate(zip(texts, tag, strict=True))], "node bigint, norm string, tag bigint").repartition(3)
    common = index.common_runs(nodes)
    seen = {k: sum(k in set(gram_ids(t).view(np.int64).tolist()) for t in texts) for k in common["key"]}
    assert seen == dict(zip(common["key"], common["n"], strict=True)) and min(seen.values()) > 1
    rows = index.entries(nodes, common, 0.6, ("tag",)).cache()
    near = {(i, j) for j in range(len(texts)) for i in range(j) if similarity(texts[i], texts[j]) >= 0.6}
    got = lambda df: {tuple(x) for x in index.verified(df, nodes, nodes, 0.6).collect()}
    parts = index.list_parts(index.counted_lists(rows, common, "tag"))
    assert (parts.count() > 0) == (most == 7)
    assert got(index.candidates(rows, parts, 0.6, tag="tag")) == {(i, j) for i, j in near if tag[i] != tag[j]}
    parts = index.list_parts(rows.groupBy("key").agg(F.count("*").alias("n")))
    assert got(index.candidates(rows, parts, 0.6)) == near
    sided = rows.withColumn("most", F.expr("if(node % 3 = 0, node, 9223372036854775807)"))
    want = {(i, j) for x, y in near for i, j in ((x, y), (y, x)) if i % 2 and not j % 2 and (i % 3 or j < i)}
    assert got(index.candidates(sided, parts, 0.6, F.col("node") % 2 == 1, most="most")) == want
    rows.unpersist()


def test_shared_template_costs_in_proportion(spark):
    """Texts with a template in common, none of which are alike, leave no pairs for verification, and few are looked at."""
    looked = []
    for n in (300, 600):
        r = random.Random(n)
        han = lambda k, r=r: "".join(chr(0x4E00 + r.randrange(9000)) for _ in range(k))
        stem = han(100)
        nodes = spark.createDataFrame([(i, stem + han(60)) for i in range(n)], "node bigint, norm string")
        rows = index.entries(nodes, index.common_runs(nodes), 0.6).toPandas().assign(part=0, left=True, right=True)
        seen = []
        lists = index._Lists(rows.sort_values("key"), 0.6, None, None)
        lists._admitted = lambda i, j, seen=seen: (seen.append(len(i)), (i[:0], j[:0]))[1]
        assert not len(lists.pairs())
        looked.append(sum(seen))
    assert looked[1] <= 2 * looked[0] + 600


def test_long_unlike_texts_leave_no_pairs(spark):
    """Texts of some 270 runs from the same words, none alike, meet in lists but aren't sent on for verification."""
    r = random.Random(21)
    words = ["".join(chr(0x4E00 + r.randrange(9000)) for _ in range(12)) for _ in range(200)]
    nodes = spark.createDataFrame([(i, "".join(r.sample(words, 22))) for i in range(200)], "node bigint, norm string")
    rows = index.entries(nodes, index.common_runs(nodes), 0.6).toPandas().assign(part=0, left=True, right=True)
    assert rows["key"].duplicated().sum() > 1000
    assert len(index._Lists(rows.sort_values("key"), 0.6, None, None).pairs()) < 5


def test_runs_of_many_texts():
    texts = ["abc", "abcabc", "甲乙丙丁甲乙丙", "\U0001d49c甲x\ud800"]
    row, at, key = index.text_runs(texts)
    row, at = index.once(row, at, len(key))
    assert [key[at[row == i]].tolist() for i in range(4)] == [gram_ids(t).tolist() for t in texts]


def test_components(spark):
    r = random.Random(2)
    edges = [(i, i + 1) for i in range(200)] + [(500, 500 + i) for i in range(1, 50)] + [(900, 900), (901, 902), (902, 901)]
    r.shuffle(edges)
    got = {x.node: x.comp for x in components.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {**{i: 0 for i in range(201)}, **{500 + i: 500 for i in range(50)}, 901: 901, 902: 901}


def history_and_batches(texts):
    r = random.Random(7)
    ids = [None, "a:1", "A:1 ", "b:2", "c:3", " C:3", "d", "e", "f"]
    rows = [(i, r.choice(ids) if r.random() < 0.5 else f"u{i}", t) for i, t in enumerate(texts * 2)]
    return rows[: len(texts)], rows[len(texts) :]


def test_rejected(spark, texts):
    old, new = history_and_batches(texts)
    frame = lambda rows: spark.createDataFrame([(*x, 1, x[0] // 30) for x in rows], "seq bigint, id string, content string, fresh int, batch_no int").repartition(3)
    got = {tuple(r) for r in incremental.rejected(frame(old), frame(new)).select("accepted_seq", "seq").collect()}
    assert got == rejected(old, new)
    alone = {tuple(r) for r in incremental.rejected(frame(old).where("seq < 0"), frame(new)).collect()}
    assert alone == rejected([], new)
    assert incremental.rejected(frame(old), frame(new).where("seq < 0")).count() == 0


def test_segments_batch_by_batch(spark, texts, tmp_path):
    """Segments give what one pass over everything gives, and are merged as they grow."""
    old, new = history_and_batches(texts[:30])
    store = incremental.SegmentStore(spark, str(tmp_path / "segments"))
    rows, out, size = [*old[:20], *new[:12]], set(), 8
    for at in range(0, len(rows), size):
        batch = spark.createDataFrame(rows[at : at + size], "seq bigint, id string, content string")
        out |= {tuple(r) for r in store.accept(batch).select("accepted_seq", "seq").collect()}
        base, now = store._list()
        assert all(b["rows"] < a["rows"] / incremental.RATIO for a, b in zip(now, now[1:], strict=False))
    assert out == rejected([], rows) and len(store.segments()) < 4
    with pytest.raises(RuntimeError):  # another writer after the list before
        store._publish([], f"list-{int(base[5:]) - 1:08d}")
    array = store.read("array", store.segments())
    assert array.count() == array.select("key", "node").distinct().count() > 0


def test_batch_reads_its_ranges(spark, texts, tmp_path):
    """The search of a batch reads only ranges that hold one of its keys, and files are sorted by key."""
    old, _ = history_and_batches(texts)
    store = incremental.SegmentStore(spark, str(tmp_path / "segments"))
    store.load(spark.createDataFrame(old, "seq bigint, id string, content string"))
    every = store.read("array", store.segments())
    keys = every.select("key").orderBy("key").limit(1)
    some = store.read("array", store.segments(), keys)
    plan = some._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(part" in plan
    assert 0 < some.count() < every.count() and some.join(keys, "key").count() == every.join(keys, "key").count()
    assert some.select(F.input_file_name()).distinct().count() == 1 < every.select(F.input_file_name()).distinct().count()


def test_backlog(spark, texts, monkeypatch):
    """A backlog of batches gives the same whatever number of them are taken together."""
    old, new = history_and_batches(texts[:40])
    frame = lambda rows: spark.createDataFrame([(*x, x[0] // 9) for x in rows], "seq bigint, id string, content string, batch_no bigint").repartition(3)
    want = rejected(old, new)
    for share in (0.4, 9.0):
        taken, accept = [], incremental.SegmentStore.accept
        monkeypatch.setattr(incremental.SegmentStore, "accept", lambda self, rows, *a, taken=taken, accept=accept: (taken.append(rows.count()), accept(self, rows, *a))[1])
        assert {tuple(r) for r in incremental.rejected(frame(old), frame(new), share=share).select("accepted_seq", "seq").collect()} == want
        monkeypatch.undo()
        assert sum(taken) == len(new) and (len(taken) == 1) == (share == 9.0)


def test_last_batches_are_not_stored(spark, texts, tmp_path, monkeypatch):
    """A query writes no segment that nothing is searched in; a store that stays gets all that is accepted."""
    old, new = history_and_batches(texts[:30])
    frame = lambda rows: spark.createDataFrame([(*x, x[0] // 9) for x in rows], "seq bigint, id string, content string, batch_no bigint").repartition(3)
    added, add = [], incremental.SegmentStore.add
    monkeypatch.setattr(incremental.SegmentStore, "add", lambda self, rows: (added.append(rows.count()), add(self, rows))[1])
    want = rejected(old, new)
    assert {tuple(r) for r in incremental.rejected(frame(old), frame(new), share=9.0).collect()} == want
    assert added == [len(old)]
    store = incremental.SegmentStore(spark, str(tmp_path / "segments"))
    store.load(frame(old))
    assert {tuple(r) for r in store.accept_backlog(frame(new), "batch_no", share=9.0).collect()} == want
    assert added[1:] == [len(old), len(new) - len({q for _, q in want})]


def test_family_over_history_and_batches(spark):
    """A third of all rows are near copies of one text: each repeats the first, and few pairs are verified."""
    r = random.Random(15)
    base = text(r, 60)
    rows = [(i, None, edited(r, base, 2)) for i in range(250)] + [(300 + i, None, text(r, 40)) for i in range(400)]
    rows += [(1000 + i, None, edited(r, base, 2)) for i in range(120)]
    df = spark.createDataFrame([(*x, 1) for x in rows], "seq bigint, id string, content string, batch_no int")
    looked = []
    check = incremental.verified
    count = lambda pairs, *a: (looked.append(pairs.count()), check(pairs, *a))[1]
    incremental.verified = count
    try:
        got = {tuple(x) for x in incremental.rejected(df.where("seq < 1000"), df.where("seq >= 1000")).collect()}
    finally:
        incremental.verified = check
    assert got == rejected([x for x in rows if x[0] < 1000], [x for x in rows if x[0] >= 1000]) and len(got) == 120
    assert sum(looked) < 2000


def brute_rows(spark, rows, first_new):
    df = spark.createDataFrame(rows, "seq bigint, id string, content string").withColumn("batch_no", F.expr(f"(seq - {first_new}) div 300"))
    got = {tuple(x) for x in incremental.rejected(df.where(f"seq < {first_new}"), df.where(f"seq >= {first_new}")).collect()}
    assert got == rejected([x for x in rows if x[0] < first_new], [x for x in rows if x[0] >= first_new])
    return got


def test_hard_pairs(spark):
    """Texts of few characters, with short matches only, with clauses in other orders, with edits every twelve characters, and
    one text with many near copies: all that brute force finds at 0.60 or more, in one run."""
    r = random.Random(12)
    han = lambda n: "".join(chr(0x4E00 + r.randrange(9000)) for _ in range(n))
    every = lambda t, k: "".join(han(1) if i % k == k - 1 else c for i, c in enumerate(t))
    clauses, short, long_ = [han(10) for _ in range(12)], han(60), han(300)
    pairs = [
        ("计算12加34的值", "计算12加34的值是"), ("求函数f(x)=2x+3的最小值和最大值", "求函数f(x)=5x+3的最小值和最大值"), ("，".join(clauses), "，".join(clauses[::-1])),
        (short, every(short, 13)), (long_, every(long_, 12)),
        ("21. （11分）直三棱柱的体积为860，其高与底面边长之比是15/43，老岑比初珩晚到69分钟，则证明：TP∥平面TGM。", "9．老岑比初珩晚到69分钟，其高与底面边长之比是15/43，（11分）直三棱柱的体积为860，则证明：TP∥平面TGM。"),
        ("abc", "abcd"), ("abcd", "abcde"), ("甲乙丙", "甲乙丙甲乙丙"),
    ]
    assert all(similarity(*p) >= 0.6 for p in pairs[:6])
    old, new = [(i, None, a) for i, (a, _) in enumerate(pairs)], [(1000 + i, None, b) for i, (_, b) in enumerate(pairs)]
    some = [han(14) for _ in range(20)]
    old += [(100 + i, None, "，".join(r.sample(some, 6))) for i in range(150)]
    new += [(1100 + i, None, "，".join(r.sample(old[len(pairs) + 5 * i][2].split("，"), 6))) for i in range(30)]
    few = lambda: "".join(r.choice("xyz") for _ in range(r.randint(3, 14)))
    old += [(400 + i, None, few()) for i in range(120)]
    new += [(1400 + i, None, few()) for i in range(120)]
    base = text(r, 80)
    old.append((600, None, base))
    new += [(1600 + i, None, edited(r, base, 1)) for i in range(100)]
    got = brute_rows(spark, old + new, 1000)
    assert {(i, 1000 + i) for i in range(6)} | {(600, 1600 + i) for i in range(100)} <= got
    assert set(range(1100, 1130)) <= {q for _, q in got}


def test_middle_of_long_lists(spark, monkeypatch):
    """In a family of texts that share a stem, a fresh record is like one from the middle only; lists are whole or divided."""
    r = random.Random(14)
    stem = text(r, 30)
    rows = [(i, None, stem + text(r, 30)) for i in range(160)]
    rows += [(200 + i, None, edited(r, rows[i][2], 2)) for i in range(40, 120, 8)]
    want = {(i, 200 + i) for i in range(40, 120, 8)}
    assert want == rejected(rows[:160], rows[160:])
    df = spark.createDataFrame(rows, "seq bigint, id string, content string").withColumn("batch_no", F.lit(1))
    for most in (index.LIST, 16):
        monkeypatch.setattr(index, "LIST", most)
        got = {tuple(x) for x in incremental.rejected(df.where("seq < 200"), df.where("seq >= 200")).collect()}
        assert got == want
