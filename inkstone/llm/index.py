"""An inverted index of runs that finds every pair of texts with a given similarity, without comparing all pairs.

A text is the set of its runs of three characters. Similarity is intersection over union of two such sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from inkstone.llm.text import codes, gram_set, jaccard, letters_digits, mix64
from inkstone.session import spread

#: Characters of a run.
DEPTH = 3
#: The most frequent runs, as many as are sent to the tasks. They decide the order of runs in a text, and with it only the
#: length of the lists: any order finds all pairs.
COMMON = 1 << 17
#: Runs that a task counts before it adds them up.
COUNTED = 1 << 21
#: 64-bit words of a text's signature: with four, texts of 200 runs and more with nothing in common pass. Of FIRST of them
#: most pairs are told apart. Pairs that are tested at a time are few enough to stay in a core's cache.
WORDS, FIRST, CHUNK = 6, 3, 1 << 15
BITS = [f"b{i}" for i in range(WORDS)]
_BITS = ", ".join(f"{b} bigint" for b in BITS)
ENTRY = f"key bigint, node bigint, size int, room int, {_BITS}"
#: Runs of a text's sketch.
SKETCH = 4
#: Entries of a list that are tested in one group; longer lists are divided.
LIST = 20_000
#: Keys of long lists that are broadcast; with more of them they are joined.
SENT_KEYS = 1 << 17


def normal_rows(rows: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, cls, norm): a row per record with at least three letters or digits. Records with the same normal form have the
    same cls, 128 bits of it in hexadecimal."""
    base = rows.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("string").alias("text"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import xxhash

        for pdf in batches:
            norm = [letters_digits(t) for t in pdf["text"]]
            out = pd.DataFrame({"id": pdf["id"], "cls": [xxhash.xxh3_128_hexdigest(x.encode("utf-8", "surrogatepass")) for x in norm], "norm": norm})
            yield out[out["norm"].str.len() >= DEPTH]

    return spread(base.where("id is not null and text is not null")).mapInPandas(run, "id bigint, cls string, norm string")


def class_nodes(rows: DataFrame) -> DataFrame:
    """(node, cls, norm) of rows (id, cls, norm): a node per class of equal normal forms, its least id."""
    return rows.groupBy("cls").agg(F.min("id").alias("node"), F.first("norm").alias("norm")).select("node", "cls", "norm")


def text_runs(norms: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, at, key): of every place of the texts' runs its text and where key has it, and the distinct runs of all, ascending."""
    c, n = codes("".join(norms)).astype(np.uint64), np.fromiter(map(len, norms), np.int64, len(norms))
    runs = np.maximum(n - DEPTH + 1, 0)
    row = np.repeat(np.arange(len(norms)), runs)
    at = np.arange(len(row)) + np.repeat((np.cumsum(n) - n) - (np.cumsum(runs) - runs), runs)
    key, at = np.unique((c[at] << np.uint64(42)) | (c[at + 1] << np.uint64(21)) | c[at + 2], return_inverse=True)
    return row, at, key


def once(row: np.ndarray, rank: np.ndarray, ranks: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, rank) without repeats, in order of both. Ranks are under ranks."""
    both = np.sort(row * ranks + rank)
    both = both[np.r_[True, both[1:] != both[:-1]]] if len(both) else both
    return both // max(ranks, 1), both % max(ranks, 1)


def common_runs(nodes: DataFrame) -> pd.DataFrame:
    """(key, n): the most frequent runs of nodes (node, norm), counted over all of them, by key."""

    def added(keys: list[np.ndarray], ns: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        key, at = np.unique(np.concatenate(keys), return_inverse=True)
        return key, np.bincount(at, np.concatenate(ns), len(key)).astype(np.int64)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        keys, ns, held = [], [], 0
        for pdf in batches:
            if not len(pdf):
                continue
            row, at, key = text_runs(pdf["norm"].tolist())
            n = np.bincount(once(row, at, len(key))[1], minlength=len(key))
            keys, ns, held = [*keys, key], [*ns, n], held + len(key)
            if held > COUNTED:
                key, n = added(keys, ns)
                if len(key) > COUNTED // 2:
                    yield pd.DataFrame({"key": key.view(np.int64), "n": n})
                    keys, ns, held = [], [], 0
                else:
                    keys, ns, held = [key], [n], len(key)
        if keys:
            key, n = added(keys, ns)
            yield pd.DataFrame({"key": key.view(np.int64), "n": n})

    counted = nodes.select("norm").mapInPandas(run, "key bigint, n bigint")
    top = counted.groupBy("key").agg(F.sum("n").alias("n")).where("n > 1").orderBy(F.desc("n"), "key").limit(COMMON)
    return top.toPandas().sort_values("key")


def signatures(grams: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, mixed, bits) of texts' runs: the text of each run, its hash, and by text a signature of WORDS words. A bit's
    place is a run's hash, its value whether an even number of runs have it, so unlike bits are at most as many as runs
    that only one text has."""
    size = np.array([len(g) for g in grams], np.int64)
    row, mixed = np.repeat(np.arange(len(size)), size), mix64(np.concatenate(grams))
    return row, mixed, _signed(row, _places(mixed), len(size))


def _places(mixed: np.ndarray) -> np.ndarray:
    return (mixed % np.uint64(64 * WORDS)).astype(np.int64)


def _signed(row: np.ndarray, place: np.ndarray, texts: int) -> np.ndarray:
    n = np.bincount(row * 64 * WORDS + place, minlength=texts * 64 * WORDS) & 1
    return np.packbits(n.astype(np.uint8).reshape(texts, -1), 1).view(np.int64)


def entries(nodes: DataFrame, common: pd.DataFrame, similarity: float, keep: tuple[str, ...] = ()) -> DataFrame:
    """ENTRY rows, with the columns keep (bigint) of nodes (node, norm): the runs by which a pair of the similarity must meet.

    The runs of a text have an order that is the same for all texts, rare ones first. Texts with size runs of which a pair
    must share n have their first shared one among the first size - n + 1 of each, and n is similarity * size at least,
    so the others need no entry. room is the greatest size of a partner that this can be the first shared run with: n is
    similarity / (1 + similarity) of both sizes, and no more than what is left of the text.
    """
    known = nodes.sparkSession.sparkContext.broadcast((common["key"].to_numpy(np.int64), common["n"].to_numpy(np.int64)))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        runs, often = known.value
        for pdf in (whole[at : at + 2000] for whole in batches for at in range(0, len(whole), 2000)):
            row, at, key = text_runs(pdf["norm"].tolist())
            mixed, key, n = mix64(key), key.view(np.int64), np.zeros(len(key), np.int64)
            if len(runs):
                known_at = np.minimum(np.searchsorted(runs, key), len(runs) - 1)
                n = np.where(runs[known_at] == key, often[known_at], 0)
            order = np.lexsort((mixed, n))
            row, at = once(row, np.argsort(order)[at], len(key))
            size = np.bincount(row, minlength=len(pdf))
            bits = _signed(row, _places(mixed)[order][at], len(pdf))
            left = np.repeat(np.cumsum(size), size) - np.arange(len(row))  # runs of the text from this one on
            use = left >= np.ceil(similarity * size - 1e-9)[row]
            key, row, left = key[order][at[use]], row[use], left[use]
            room = np.floor(left * (1 + similarity) / similarity - size[row] + 1e-6)
            out = {"key": key, "node": pdf["node"].to_numpy(np.int64)[row], "size": size[row].astype(np.int32), "room": room.astype(np.int32)}
            out |= {b: bits[row, i] for i, b in enumerate(BITS)} | {c: pdf[c].to_numpy(np.int64)[row] for c in keep}
            yield pd.DataFrame(out)

    return nodes.select("node", "norm", *keep).mapInPandas(run, ENTRY + "".join(f", {c} bigint" for c in keep))


def sketches(nodes: DataFrame) -> DataFrame:
    """(key, node, size, bits): of each text the SKETCH runs that come first in an order by hash. Like texts have many of
    them in common, so a few lists tell what most groups are; what these miss is left to the index."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in (whole[at : at + 2000] for whole in batches for at in range(0, len(whole), 2000)):
            row, at, key = text_runs(pdf["norm"].tolist())
            mixed = mix64(key)
            order = np.argsort(mixed)
            row, at = once(row, np.argsort(order)[at], len(key))
            size = np.bincount(row, minlength=len(pdf))
            bits = _signed(row, _places(mixed)[order][at], len(pdf))
            use = np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size) < SKETCH
            row, key = row[use], key.view(np.int64)[order][at[use]]
            out = {"key": key, "node": pdf["node"].to_numpy(np.int64)[row], "size": size[row].astype(np.int32)}
            yield pd.DataFrame(out | {b: bits[row, i] for i, b in enumerate(BITS)})

    return nodes.select("node", "norm").mapInPandas(run, f"key bigint, node bigint, size int, {_BITS}")


def may_reach(similarity: float, x: str, y: str) -> Column:
    """Whether sizes and signatures of the structs x and y admit the similarity. What this rejects hasn't got it."""
    size = F.col(f"{x}.size") + F.col(f"{y}.size")
    unlike = sum((F.bit_count(F.col(f"{x}.{b}").bitwiseXOR(F.col(f"{y}.{b}"))) for b in BITS), F.lit(0))
    least = F.least(f"{x}.size", f"{y}.size") >= F.greatest(f"{x}.size", f"{y}.size") * similarity - 1e-6
    return least & (unlike <= size * ((1 - similarity) / (1 + similarity)) + 1e-6)


def first_of_lists(rows: DataFrame, firsts: DataFrame, similarity: float) -> DataFrame:
    """(a, b): nodes b of rows with the least node a of firsts in each list of sketches that both are in, where these can
    have the similarity. Firsts are aggregated before the exchange, so a list of any length costs a pair a node."""
    side = F.struct("node", "size", *BITS)
    least = firsts.groupBy("key").agg(F.min(side).alias("x"))
    pairs = rows.select("key", side.alias("y")).join(least, "key").where("x.node != y.node").where(may_reach(similarity, "x", "y"))
    return pairs.select(F.col("x.node").alias("a"), F.col("y.node").alias("b")).distinct()


def list_parts(lists: DataFrame) -> DataFrame:
    """(key, parts): in how many parts lists (key, n) of over LIST entries are divided. Those that are said not to be mixed
    (a column mixed) have no pairs to find, and 0 parts."""
    mixed = F.col("mixed") if "mixed" in lists.columns else F.lit(True)
    return lists.where(F.col("n") > LIST).select("key", F.when(mixed, F.ceil(F.col("n") / LIST)).otherwise(0).cast("int").alias("parts"))


def counted_lists(index: DataFrame, common: pd.DataFrame, tag: str) -> DataFrame:
    """(key, n, mixed) of lists that may be long: length, and whether they have more than one tag. A list has no more entries
    than texts have the run, so only frequent runs are counted, unless there may be more of these than common has."""
    hot = common[common["n"] > LIST][["key"]]
    if len(common) < COMMON or common["n"].min() <= LIST:
        spark = index.sparkSession
        index = index.join(F.broadcast(spark.createDataFrame(hot, "key bigint") if len(hot) else spark.createDataFrame([], "key bigint")), "key", "left_semi")
    return index.groupBy("key").agg(F.count("*").alias("n"), (F.min(tag) != F.max(tag)).alias("mixed"))


def _chunks(left: np.ndarray, begin: np.ndarray, end: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (i, j) of each i of left with all j from its begin up to its end, some CHUNK at a time."""
    n = np.maximum(end - begin, 0)
    stop = np.cumsum(n)
    every, shift = int(stop[-1]) if len(stop) else 0, begin - (stop - n)
    for p in range(0, every, CHUNK):
        q = min(p + CHUNK, every)
        k, m = np.searchsorted(stop, [p, q - 1], "right")
        lens = np.minimum(stop[k : m + 1], q) - np.maximum(stop[k : m + 1] - n[k : m + 1], p)
        yield np.repeat(left[k : m + 1], lens), np.arange(p, q) + np.repeat(shift[k : m + 1], lens)


class _Lists:
    """Entries of whole lists, or parts of them. left and right: the sides of a pair that an entry may be on."""

    def __init__(self, pdf: pd.DataFrame, similarity: float, tag: str | None, most: str | None) -> None:
        column = lambda c: pdf[c].to_numpy(np.int64)
        self.similarity, self.node, self.size, self.room = similarity, column("node"), column("size"), column("room")
        self.bits = [column(b).view(np.uint64) for b in BITS]
        self.quota = self.size * ((1 - similarity) / (1 + similarity))
        self.left, self.right = pdf["left"].to_numpy(bool), pdf["right"].to_numpy(bool)
        self.tag = column(tag) if tag else self.node
        self.most = column(most) if most else None
        key, part = column("key"), column("part")
        self.group = np.cumsum(np.r_[True, (key[1:] != key[:-1]) | (part[1:] != part[:-1])]) - 1

    def _admitted(self, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        size, room, quota, unlike = self.size, self.room, self.quota[i] + self.quota[j] + 1e-6, 0
        for some in (self.bits[:FIRST], self.bits[FIRST:]):
            for b in some:
                unlike = unlike + np.bitwise_count(b[i] ^ b[j]).astype(np.int16)
            use = np.flatnonzero(unlike <= quota)
            i, j, quota, unlike = i[use], j[use], quota[use], unlike[use]
        use = (size[j] <= room[i]) & (size[i] <= room[j]) & (self.tag[i] != self.tag[j])
        # of two that may both stand left, the smaller does
        use &= (size[i] < size[j]) | ((size[i] == size[j]) & (self.node[i] < self.node[j])) if self.most is None else self.node[j] < self.most[i]
        return i[use], j[use]

    def pairs(self) -> pd.DataFrame:
        """(a, b): admitted pairs, each once. By entry, partners are taken in order of size, or of what tells them apart (tag, or
        node where there is a bound), whichever leaves fewer."""
        own, others, t = np.flatnonzero(self.left), np.flatnonzero(self.right), self.similarity
        place = lambda by, at, side: np.searchsorted(by, at, side)
        big = int(max(self.size.max(initial=0), self.room.max(initial=0))) + 2
        by_size = others[np.lexsort((self.size[others], self.group[others]))]
        key, g = self.group[by_size] * big + self.size[by_size], self.group[own]
        begin, end = place(key, g * big + self.size[own], "left"), place(key, g * big + np.maximum(self.room[own], 0), "right")
        ways = [(by_size, begin, np.maximum(begin, end))]
        if self.most is not None:
            # a right entry is the smaller of two only if it has room for more than its own size
            early = by_size[self.room[by_size] > self.size[by_size]]
            key, low = self.group[early] * big + self.size[early], np.ceil(t * self.size[own] - 1e-6).astype(np.int64)
            begin, end = place(key, g * big + low, "left"), place(key, g * big + np.maximum(np.minimum(self.room, self.size - 1)[own], 0), "right")
            ways.append((early, begin, np.maximum(begin, end)))
        # tags and nodes as ranks, so that they can be searched with their group
        what = self.tag if self.most is None else self.node
        names, rank = np.unique(what, return_inverse=True)
        n = len(names) + 1
        by_tag = others[np.lexsort((rank[others], self.group[others]))]
        key, first, last = self.group[by_tag] * n + rank[by_tag], place(self.group[by_tag], g, "left"), place(self.group[by_tag], g, "right")
        if self.most is None:
            a, b = place(key, g * n + rank[own], "left"), place(key, g * n + rank[own], "right")
        else:
            a, b = place(key, g * n + place(names, self.most[own], "left"), "left"), last
        short = (a - first) + (last - b) < sum(end - begin for _, begin, end in ways)
        out = [self._admitted(i, by[j]) for by, begin, end in ways for i, j in _chunks(own[~short], begin[~short], end[~short])]
        for x, y in ((first, a), (b, last)):
            out += [self._admitted(i, by_tag[j]) for i, j in _chunks(own[short], x[short], y[short])]
        none = np.empty(0, np.int64)
        i, j = (np.concatenate([none, *x]) for x in zip(*out, strict=True)) if out else (none, none)
        a, b = self.node[i], self.node[j]
        if self.most is None:
            a, b = np.minimum(a, b), np.maximum(a, b)
        return pd.DataFrame({"a": a, "b": b}).drop_duplicates()


def candidates(index: DataFrame, parts: DataFrame, similarity: float, left: Column | None = None, tag: str | None = None, most: str | None = None) -> DataFrame:
    """(a, b): pairs of nodes of an index, among them all that have the similarity, once each.

    Without left every entry meets every other (a < b); with it, each entry that is left (a) meets those that aren't (b).
    Pairs of equal tag are left out. With most, a column, b must be under a's most.

    One exchange brings a list together. Long lists (parts, of list_parts) are divided by node, and each part's left
    entries meet each part in a group of their own, so a task holds two parts at most and a list of any length is
    tested by as many tasks as it has pairs of parts.
    """
    schema = "a bigint, b bigint"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        for pdf in batches:
            if not len(pdf):
                continue
            key, part = pdf["key"].to_numpy(), pdf["part"].to_numpy()
            cut = int(np.flatnonzero((key != key[-1]) | (part != part[-1])).max(initial=-1)) + 1  # the last group may go on
            if cut or held and (held[-1]["key"].iat[-1] != key[0] or held[-1]["part"].iat[-1] != part[0]):
                yield _Lists(pd.concat([*held, pdf[:cut]]), similarity, tag, most).pairs()
                held = []
            held.append(pdf[cut:])
        if held:
            yield _Lists(pd.concat(held), similarity, tag, most).pairs()

    rows = index.withColumn("left", F.lit(True) if left is None else left).withColumn("right", F.lit(True) if left is None else ~left)
    n = parts.count()
    if not n:
        placed = rows.withColumn("part", F.lit(0).cast("bigint"))
    else:
        rows = rows.join(F.broadcast(parts) if n <= SENT_KEYS else parts, "key", "left").where("parts is null or parts > 0")
        own = F.expr("cast(pmod(xxhash64(node), parts) as int)")
        sides = F.expr(
            "case when parts is null then array(named_struct('part', 0L, 'left', left, 'right', right)) else concat("
            "case when right then transform(sequence(0, parts - 1), p -> named_struct('part', cast(p as bigint) * parts + own, 'left', left and p = own, 'right', true)) else array() end, "
            "case when left then transform(filter(sequence(0, parts - 1), p -> not right or p != own), p -> named_struct('part', cast(own as bigint) * parts + p, 'left', true, 'right', false)) "
            "else array() end) end"
        )
        placed = rows.withColumn("own", own).select(*[c for c in rows.columns if c not in ("left", "right", "parts")], F.inline(sides))
    partitions = int(index.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = placed.repartition(partitions, "key", "part").sortWithinPartitions("key", "part")
    return ordered.mapInPandas(run, schema).distinct()


@F.pandas_udf(DoubleType())
def similarity_of(x: pd.Series, y: pd.Series) -> pd.Series:
    known: dict[str, frozenset] = {}
    grams = lambda t: known.get(t) or known.setdefault(t, gram_set(t))
    return pd.Series([jaccard(grams(p), grams(q)) for p, q in zip(x, y, strict=True)], dtype="float64")


def verified(pairs: DataFrame, a: DataFrame, b: DataFrame, similarity: float) -> DataFrame:
    """(a, b): of pairs those that have the similarity, by the normal forms in a and b (node, norm)."""
    side = lambda nodes, name: nodes.select(F.col("node").alias(name), F.col("norm").alias(f"norm_{name}"))
    full = pairs.join(side(a, "a"), "a").join(side(b, "b"), "b")
    return full.where(similarity_of("norm_a", "norm_b") >= similarity).select("a", "b")
