"""Problem 3: near-duplicate records, by an inverted index of runs and signatures by position."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkstone.llm.components import components
from inkstone.llm.index import candidates, class_nodes, common_runs, counted_lists, entries, first_of_lists, list_parts, normal_rows, sketches, verified
from inkstone.session import drop, written


def near_groups(rows: DataFrame, id_col: str = "seq", text_col: str = "content", similarity: float = 0.6) -> DataFrame:
    """(group_<id>, <id>): each record of a group of two or more except its smallest id, which is named in group_<id>.

    Records belong together if a chain links them in which neighbours have at least the similarity: intersection over
    union of the sets of three-character runs of the normal form (NFKC, lower case, letters and digits).

    Equal normal forms become one node. A node's bytes by position are its signature (a run's hash is its position), and
    an inverted index has the nodes by run, of each as many runs as a pair of the similarity cannot do without. Of the
    nodes of a list those pairs are kept whose signatures are equal at the least number of positions that a pair of these
    sizes is bound to reach; they are verified over the normal forms. Both bounds hold always, so no pair is missed.

    Lists that hold a third of all nodes cost no pairs within a group: first, nodes are linked to the least node of each
    list of a few sketch runs, and what is verified of these links makes groups; then the index compares nodes of
    different groups only, in lists that hold some.

    NULL ids, NULL and blank contents and those of under three letters or digits take no part. Repeated ids are one record.
    """
    out = f"group_{id_col}"
    normal = written(normal_rows(rows, id_col, text_col), "normal")
    nodes = written(class_nodes(normal), "nodes")
    sketch = written(sketches(nodes), "sketch")
    first = written(verified(first_of_lists(sketch, sketch, similarity), nodes, nodes, similarity), "links")
    groups = components(first)

    tagged = nodes.join(groups, "node", "left").select("node", "norm", F.coalesce("comp", "node").alias("tag"))
    common = common_runs(nodes)
    index = written(entries(tagged, common, similarity, ("tag",)), "index")
    parts = written(list_parts(counted_lists(index, common, "tag")), "parts")
    more = written(verified(candidates(index, parts, similarity, tag="tag"), nodes, nodes, similarity), "links")
    drop(sketch, index, parts)
    if not more.isEmpty():
        groups = components(more.unionByName(groups.select(F.col("comp").alias("a"), F.col("node").alias("b"))))

    member = normal.select("id", "cls").join(nodes.select("cls", "node"), "cls").join(groups, "node", "left")
    return member.select(F.coalesce("comp", "node").alias(out), F.col("id").alias(id_col)).where(F.col(out) != F.col(id_col)).distinct()
