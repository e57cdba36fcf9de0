"""Citation graphs: edges, degrees, neighbourhoods and their label distribution, forest-fire sampling."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from citeloom.operators.numbering import dense_ids
from citeloom.session import cut_lineage


def edges_with_multiplicity(edges: DataFrame) -> DataFrame:
    """(src, dst, multiplicity); edges with a null end are left out."""
    return edges.where("src is not null and dst is not null").groupBy("src", "dst").agg(F.count(F.lit(1)).alias("multiplicity"))


def simple_edges(edges: DataFrame) -> DataFrame:
    return edges.where("src is not null and dst is not null").select("src", "dst").distinct()


def gather(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """rows of the wanted (idx, pos), in order of pos; an idx wanted twice stands twice, one without a row is left out."""
    return wanted.select("idx", "pos").join(rows, "idx").orderBy("pos")


def degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(idx, out_deg, in_deg) of every node, 0 for isolated ones; a self-loop counts on both sides."""
    ends = edges.select(F.col("src").alias("idx"), F.lit(1).alias("o"), F.lit(0).alias("i")).unionAll(edges.select(F.col("dst").alias("idx"), F.lit(0).alias("o"), F.lit(1).alias("i")))
    counts = ends.groupBy("idx").agg(F.sum("o").alias("out_deg"), F.sum("i").alias("in_deg"))
    return nodes.select("idx").distinct().join(counts, "idx", "left").select("idx", F.coalesce("out_deg", F.lit(0)).alias("out_deg"), F.coalesce("in_deg", F.lit(0)).alias("in_deg"))


def graph_counts(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: n_nodes, n_edges (distinct), n_self_loops."""
    simple = simple_edges(edges).agg(F.count(F.lit(1)).alias("n_edges"), F.count_if(F.col("src") == F.col("dst")).alias("n_self_loops"))
    return nodes.select("idx").distinct().agg(F.count(F.lit(1)).alias("n_nodes")).join(F.broadcast(simple))


def neighbours(edges: DataFrame, cap: int = 50) -> DataFrame:
    """(idx, pos, neighbour): each node's first `cap` neighbours, those it points to before those that point to it, by id.

    A reciprocal neighbour and a self-loop stand twice. The cap is the feature: a bounded context per node.
    """
    simple = simple_edges(edges)
    both = simple.select(F.col("src").alias("idx"), F.lit(0).alias("side"), F.col("dst").alias("neighbor")).unionAll(simple.select(F.col("dst").alias("idx"), F.lit(1).alias("side"), F.col("src").alias("neighbor")))
    order = Window.partitionBy("idx").orderBy("side", "neighbor")
    return both.withColumn("pos", F.row_number().over(order).cast("long")).where(F.col("pos") <= cap).select("idx", "pos", "neighbor")


def label_distribution(near: DataFrame, labels: DataFrame, k: int = 5) -> DataFrame:
    """(idx, rk, label_idx, cnt, total, ratio): the k most frequent labels among a node's neighbours.

    total counts the labelled neighbours, of all labels; nodes without one have no row. Ties go to the smaller label.
    """
    known = labels.where("label_idx is not null").dropDuplicates(["idx"]).select(F.col("idx").alias("neighbor"), "label_idx")
    counts = near.join(known, "neighbor").groupBy("idx", "label_idx").agg(F.count(F.lit(1)).alias("cnt"))
    node = Window.partitionBy("idx")
    counts = counts.withColumn("total", F.sum("cnt").over(node)).withColumn("rk", F.row_number().over(node.orderBy(F.desc("cnt"), "label_idx")).cast("long"))
    return counts.where(F.col("rk") <= k).select("idx", "rk", "label_idx", "cnt", "total", F.round(F.col("cnt") / F.col("total"), 6).alias("ratio"))


def citation_context(asked: DataFrame, nodes: DataFrame, edges: DataFrame, labels: DataFrame, cap: int = 50) -> DataFrame:
    """(idx, branch, total, top_label, top_ratio) of every asked node.

    branch is not_in_graph, isolated (no neighbour), unlabeled (none of the first `cap` neighbours is labelled) or evidence.
    """
    near = cut_lineage(neighbours(edges, cap))
    top = label_distribution(near, labels, 1).select("idx", "total", F.col("label_idx").alias("top_label"), F.col("ratio").alias("top_ratio"))
    has = near.select("idx").distinct().withColumn("has", F.lit(True))
    known = nodes.select("idx").distinct().withColumn("known", F.lit(True))
    out = asked.select("idx").distinct().join(known, "idx", "left").join(has, "idx", "left").join(top, "idx", "left")
    branch = F.when(F.col("known").isNull(), "not_in_graph").when(F.col("has").isNull(), "isolated").when(F.col("total").isNull(), "unlabeled").otherwise("evidence")
    return out.select("idx", branch.alias("branch"), F.coalesce("total", F.lit(0)).alias("total"), "top_label", "top_ratio")


def context_text(context: DataFrame, distribution: DataFrame, categories: DataFrame) -> DataFrame:
    """(idx, text): "name (count=c, ratio=r)" of the listed labels, separated by "; "; the branch's name where there is no evidence."""
    named = distribution.join(categories.select("label_idx", "category"), "label_idx", "left")
    part = F.format_string("%s (count=%d, ratio=%.2f)", F.coalesce("category", F.lit("UNKNOWN")), "cnt", "ratio")
    texts = named.groupBy("idx").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rk", part.alias("p")))), lambda x: x["p"]), "; ").alias("evidence"))
    return context.join(texts, "idx", "left").select("idx", F.coalesce("evidence", "branch").alias("text"))


def forest_fire(nodes: DataFrame, edges: DataFrame, target: int, burn: float = 0.75, seed: int = 7) -> DataFrame:
    """(idx, round): a forest-fire sample of min(target, number of nodes) nodes, the same for the same seed.

    Round by round every burning node draws k with P(k) = (1 - burn) burn^k from a hash and sets fire to its first k
    out-neighbours that haven't burned, in a hash order; a fire that dies starts again at an unburned node, and at twice as many at once
    each time that it dies without having spread further than it was lit, so that a graph of scattered pieces takes few jobs. Each such
    node has a round of its own. Nodes of one round don't see each other's fires, unlike a queue that is worked off
    one by one; the last round is cut to size by hash. Each round is a join of the frontier with the edges, written down before the next.
    """
    nodes = cut_lineage(nodes.select("idx").where("idx is not null").distinct())
    edges = cut_lineage(simple_edges(edges))
    goal = min(target, nodes.count())
    burned = nodes.limit(0).withColumn("round", F.lit(0).cast("long"))
    frontier, n, step, lit_at_once, spread_since = None, 0, 0, 1, 0
    uniform = (F.pmod(F.xxhash64("src", F.lit(seed)), F.lit(1 << 30)) + 1) / ((1 << 30) + 1)
    while n < goal:
        if frontier is None:
            if step:
                lit_at_once = 1 if spread_since > lit_at_once else 2 * lit_at_once
            spread_since = 0
            order = [F.xxhash64("idx", F.lit(seed + step)), F.col("idx")]
            lit = cut_lineage(nodes.join(burned, "idx", "left_anti").orderBy(*order).limit(min(lit_at_once, goal - n)))
            lit = cut_lineage(dense_ids(lit.select("idx", order[0].alias("at")), ["at", "idx"], "round", step).select("idx", F.col("round").cast("long").alias("round")))
            size = lit.count()
            burned = cut_lineage(burned.unionAll(lit))
            frontier, n, step = lit.select("idx"), n + size, step + size
            continue
        else:
            open_ = edges.join(frontier.select(F.col("idx").alias("src")), "src").join(burned.select(F.col("idx").alias("dst")), "dst", "left_anti")
            order = Window.partitionBy("src").orderBy(F.xxhash64("dst", F.lit(seed)), "dst")
            lit = open_.withColumn("k", F.floor(F.log(uniform) / F.log(F.lit(burn)))).withColumn("i", F.row_number().over(order)).where("i <= k").select(F.col("dst").alias("idx")).distinct()
        lit = cut_lineage(lit)
        size = lit.count()
        if size == 0:
            frontier = None
            continue
        spread_since += size
        if n + size > goal:
            lit = lit.orderBy(F.xxhash64("idx", F.lit(seed)), "idx").limit(goal - n)
            size = goal - n
        burned = cut_lineage(burned.unionAll(lit.withColumn("round", F.lit(step).cast("long"))))
        frontier, n, step = lit, n + size, step + 1
    return burned
