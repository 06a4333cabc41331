"""The results by definition, in plain Python, for small tables."""

import unicodedata
from collections import defaultdict


def norm(s):
    return "".join(c for c in unicodedata.normalize("NFKC", s or "").lower() if c.isalnum())


def similarity(a, b):
    x, y = ({t[i : i + 3] for i in range(len(t) - 2)} for t in (norm(a), norm(b)))
    return len(x & y) / len(x | y) if x | y else 0.0


def groups(rows, least=0.6):
    up = {}

    def find(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for i, (p, a) in enumerate(rows):
        for q, b in rows[:i]:
            if a and b and similarity(a, b) >= least:
                x, y = sorted((find(p), find(q)))
                up[y] = x
    return {(find(p), p) for p, _ in rows if find(p) != p}


def rejected(history, incoming, least=0.6):
    accepted, out = list(history), set()
    key = lambda i: None if i is None else i.strip().lower()
    for q, i, t in sorted(incoming, key=lambda r: r[0]):
        same = [a for a, j, u in accepted if (i is not None and j is not None and key(i) == key(j)) or (t and u and similarity(t, u) >= least)]
        if same:
            out.add((min(same), q))
        else:
            accepted.append((q, i, t))
    return out


def leaks(docs, items, least=40):
    out = set()
    for k, text in items:
        n = norm(text)
        runs = {n[i : i + least] for i in range(len(n) - least + 1)}
        out |= {(d, k) for d, t in docs if any(r in norm(t) for r in runs)}
    return out


def spans(docs, least=200):
    where = defaultdict(set)
    for d, t in docs:
        for i in range(len(t or "") - least + 1):
            where[t[i : i + least]].add(d)
    out = set()
    for d, t in docs:
        last = None
        for i in range(len(t or "") - least + 1):
            if len(where[t[i : i + least]]) > 1:
                if last and i + 1 <= last[1] + 1:
                    last[1] = i + least
                else:
                    if last:
                        out.add((d, *last))
                    last = [i + 1, i + least]
        if last:
            out.add((d, *last))
    return out
