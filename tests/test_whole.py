"""Queries that use every row of their tables, against plain Python."""

import hashlib
from collections import defaultdict

from inkstone.plans import catalogue


def test_pages_flattened(spark, sf):
    """No record's text is missing from its document."""
    pages = defaultdict(lambda: defaultdict(list))
    rows = spark.read.parquet(f"{sf}/scanned_records.parquet").select("doc_hash", "page_no", "rec_id", "content").collect()
    for r in sorted(rows, key=lambda r: r.rec_id):
        pages[r.doc_hash][r.page_no].append(r.content or "")
    want = {h: "\n".join(f"--- 第 {n} 页 ---\n" + "\n".join(p[n]) for n in sorted(p)) for h, p in pages.items()}
    assert any(len(c) > 1 for p in pages.values() for c in p.values())
    got = {r.doc_hash: (r.n, r.text_md5) for r in catalogue.pages_flattened(spark, sf).collect()}
    assert got == {h: (len(t), hashlib.md5(t.encode()).hexdigest()) for h, t in want.items()}


def test_similarity_of_all_incoming(spark, sf):
    """Incoming records that aren't divisible by 20 are checked as well, and the stages agree with the query."""
    near = {r.seq for r in catalogue.similarity_dedupe(spark, sf).collect()}
    assert any(q % 20 for q in near)
    rejects = {r.seq: r.reason for r in catalogue.dedupe_rejects(spark, sf).collect()}
    third = {q for q, r in rejects.items() if r == "similarity"}
    first = {q for q in rejects if q not in third}
    assert third and third == near - first
    report = catalogue.dedupe_report(spark, sf).first()
    n = spark.read.parquet(f"{sf}/incoming_records.parquet").count()
    assert (report.extracted_total, report.similarity, report.after_similarity) == (n, len(third), n - len(rejects))
