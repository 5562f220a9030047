"""Embedding near-duplicates: exact threshold pairs by dual traversal of cover trees.

Vectors are scaled to length 1 (first by their largest component, so that huge and tiny ones neither
overflow nor vanish), where cosine >= t means a distance of at most sqrt(2 - 2t). Equal directions of a
label are one entry with a multiplicity.

The top of the tree is a table: as long as a node holds more than CELL entries, its entries are dealt to
the nearest of about FAN centres drawn from it, which become its children, each with the radius that
covers it. Pairs of nodes are walked down together, level by level, and those farther apart than their
radii and the threshold allow are dropped. For each pair of leaves left a task builds the rest of both
trees in memory (levels of halving radii, each centre nested in the next level), walks them in the same
way, and decides what remains by the cosine in double precision. Out come counts of links and a spanning
forest, not the pairs. A node that its centres don't part is dealt to chunks by hash instead, all pairs of
which are walked.

Vectors that are null, empty, zero or hold null or non-finite components link with nothing, nor do
those with a null label or id; vectors of different lengths never link. All still come out, with
n_links 0 and their own id. Ties at the threshold link. Repeated rows come out as often; extra columns are
left behind; an empty table gives no rows.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import connected_components, forest, join_by_key, save

CELL = 4096
FAN = 16
DEPTH = 24
LEAF = 24
SLACK = 1e-9  # rounding in distances; the cosine itself decides


class CoverTree:
    """Nodes as arrays: centre, covering radius, children (none: a leaf), members."""

    def __init__(self, x: np.ndarray):
        self.x, self.centre, self.radius, self.kids, self.members = x, [], [], [], []
        if len(x):
            self.root = self.add(np.arange(len(x)), self.far(0, np.arange(len(x))), 2.0)

    def far(self, c: int, others: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum(0, 2 - 2 * (self.x[others] @ self.x[c])))

    def add(self, members: np.ndarray, dist: np.ndarray, level: float) -> int:
        """members[0] is the centre; level is the radius that covers all."""
        node = len(self.centre)
        self.centre.append(members[0])
        self.radius.append(float(dist.max()))
        self.kids.append([])
        self.members.append(members)
        if len(members) > LEAF and self.radius[node] > 1e-6:
            while level / 2 >= self.radius[node]:
                level /= 2
            level /= 2
            while len(members):
                near = dist <= level
                near[0] = True
                self.kids[node].append(self.add(members[near], dist[near], level))
                members = members[~near]
                if len(members):
                    dist = self.far(members[0], members)
                    dist[0] = 0.0
        return node


def dual_pairs(a: CoverTree, b: CoverTree, reach: float, same: bool):
    """Pairs of leaves (as member arrays) that may hold points within reach."""
    if not len(a.x) or not len(b.x):
        return
    todo = [(a.root, b.root)]
    while todo:
        i, j = todo.pop()
        ki, kj = a.kids[i] or [i], b.kids[j] or [j]
        if ki == [i] and kj == [j]:
            yield a.members[i], b.members[j]
            continue
        rj = np.array([b.radius[k] for k in kj]) + reach + SLACK
        cj = b.x[[b.centre[k] for k in kj]]
        for s in range(0, len(ki), 512):
            part = ki[s : s + 512]
            d = np.sqrt(np.maximum(0, 2 - 2 * (a.x[[a.centre[k] for k in part]] @ cj.T)))
            near = np.argwhere(d <= np.array([a.radius[k] for k in part])[:, None] + rj[None, :])
            todo += [(part[p], kj[q]) for p, q in near.tolist() if not (same and i == j and part[p] > kj[q])]


def block_forest(hit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links (row, column) that connect what the block's hits connect, not many more than its sides."""
    if hit.sum() <= 4 * sum(hit.shape):
        return np.nonzero(hit)
    out_r, out_c, rows = [], [], hit.any(1)
    while rows.any():
        r = np.zeros(len(hit), bool)
        r[np.argmax(rows)] = True
        seen_r, seen_c, first = r.copy(), np.zeros(hit.shape[1], bool), int(np.argmax(rows))
        while r.any():
            c = hit[r].any(0) & ~seen_c
            out_r += [int(np.flatnonzero(r)[np.argmax(hit[r][:, k])]) for k in np.flatnonzero(c)]
            out_c += np.flatnonzero(c).tolist()
            seen_c |= c
            r = hit[:, c].any(1) & ~seen_r
            out_r += np.flatnonzero(r).tolist()
            out_c += [int(np.flatnonzero(c)[np.argmax(hit[k][c])]) for k in np.flatnonzero(r)]
            seen_r |= r
        rows &= ~seen_r
        assert first >= 0
    return np.array(out_r, int), np.array(out_c, int)


def link_chunks(x: np.ndarray, m: np.ndarray, rep: np.ndarray, side: np.ndarray, threshold: float, same: bool) -> pd.DataFrame:
    """rep, links, root of the entries with links: within one chunk (same) or between side 0 and side 1."""
    ia, ib = (np.arange(len(x)),) * 2 if same else (np.flatnonzero(side == 0), np.flatnonzero(side == 1))
    ta = CoverTree(x[ia])
    tb = ta if same else CoverTree(x[ib])
    links, a, b = np.zeros(len(x), np.int64), [], []
    for ma, mb in dual_pairs(ta, tb, float(np.sqrt(max(0.0, 2 - 2 * threshold))), same):
        hit = ta.x[ma] @ tb.x[mb].T >= threshold
        own = same and ma is mb
        if own:
            np.fill_diagonal(hit, False)
        if hit.any():
            ga, gb = ia[ma], ib[mb]
            links[ga] += hit @ m[gb]
            if not own:
                links[gb] += hit.T @ m[ga]
            r, c = block_forest(hit)
            a.append(ga[r])
            b.append(gb[c])
    if not a:
        return pd.DataFrame({"rep": rep[:0], "links": links[:0], "root": rep[:0]})
    child, root = forest(rep[np.concatenate(a)], rep[np.concatenate(b)])
    of = dict(zip(child.tolist(), root.tolist()))
    some = np.flatnonzero(links)
    return pd.DataFrame({"rep": rep[some], "links": links[some], "root": [of.get(r, r) for r in rep[some].tolist()]})


def _deal(batches):
    """Entries with their node's centres to the nearest one: (node, v, m, rep, child, dist)."""
    for pdf in batches:
        child, dist = np.zeros(len(pdf), np.int64), np.zeros(len(pdf))
        for node, at in pdf.groupby("node").indices.items():
            centres = np.stack(pdf["centres"].iloc[at[0]])
            d = np.sqrt(np.maximum(0, 2 - 2 * (np.stack(pdf["v"].iloc[at].to_numpy()) @ centres.T)))
            near = d.argmin(1)
            child[at], dist[at] = near, d[np.arange(len(at)), near]
        yield pdf[["node", "v", "m", "rep"]].assign(child=child, dist=dist)


def grown(entries: DataFrame, cell: int) -> tuple[DataFrame, DataFrame]:
    """entries (node, v, m, rep), a root a node, to (nodes: parent, node, level, centre, radius, n, leaf) and
    the entries under their leaves."""
    nodes = save(entries.groupBy("node").agg(F.count("*").alias("n")).select(F.lit(None).cast("long").alias("parent"), "node", F.lit(0).alias("level"), F.lit(None).cast("array<double>").alias("centre"), F.lit(2.0).alias("radius"), "n", (F.col("n") <= cell).alias("leaf")), "nodes")
    placed, done, level = entries, [], 0
    while nodes.where(f"level = {level} and not leaf").limit(1).count():
        large = nodes.where(f"level = {level} and not leaf").select("node", "n")
        draw = F.pmod(F.xxhash64("rep", F.lit(level)), F.lit(1 << 30)) / F.lit(float(1 << 30))
        met = save(join_by_key(placed, large.withColumn("all", F.col("n")), ["node"], "n"), "node-entries")
        done.append(placed.join(large, "node", "left_anti"))
        some = met.where(draw < 2.0 * FAN / F.col("all")).groupBy("node").agg(F.slice(F.sort_array(F.collect_list(F.struct(draw.alias("d"), "rep", "v"))), 1, FAN).alias("c"))
        # a node without a draw takes its first entry
        first = met.groupBy("node").agg(F.min(F.struct("rep", "v")).alias("f"), F.count("*").alias("n"))
        centres = save(first.join(some, "node", "left").select("node", F.coalesce(F.col("c.v"), F.array("f.v")).alias("centres"), "n"), "centres")
        schema = "node long, v array<double>, m long, rep long, child long, dist double"
        dealt = save(join_by_key(met.drop("all"), centres, ["node"], "n").select("node", "v", "m", "rep", "centres").mapInPandas(_deal, schema), "dealt")
        at = F.element_at("centres", (F.col("child") + 1).cast("int"))
        kids = dealt.groupBy("node", "child").agg(F.max("dist").alias("radius"), F.count("*").alias("n")).join(centres.withColumnRenamed("n", "all"), "node")
        stuck = (F.col("n") == F.col("all")) | F.lit(level + 1 >= DEPTH)
        kids = kids.select(F.col("node").alias("parent"), F.xxhash64("node", "child").alias("node"), F.lit(level + 1).alias("level"), at.alias("centre"), "radius", "n", ((F.col("n") <= cell) | stuck).alias("leaf"))
        nodes = save(nodes.unionByName(kids), "nodes")
        placed, level = dealt.select(F.xxhash64("node", "child").alias("node"), "v", "m", "rep"), level + 1
    done.append(placed)
    return nodes, reduce(DataFrame.unionByName, done)


def leaf_pairs(nodes: DataFrame, reach: float) -> DataFrame:
    """Pairs (p1, p2) of leaves that may hold vectors within reach: the nodes walked down together."""
    depth = nodes.agg(F.max("level")).first()[0] or 0
    pairs = nodes.where("level = 0").select(F.col("node").alias("p1"), F.col("node").alias("p2"))
    known = ["node", "centre", "radius"]
    for level in range(1, depth + 1):
        kids = nodes.where(f"level = {level}").select("parent", *known).unionByName(nodes.where(f"leaf and level < {level}").select(F.col("node").alias("parent"), *known))
        side = lambda k: kids.select(F.col("parent").alias(f"p{k}"), *[F.col(c).alias(f"{c}{k}") for c in known])  # noqa: E731, B023
        met = pairs.join(side(1), "p1").join(side(2), "p2").where("p1 <> p2 or node1 <= node2")
        gap = F.sqrt(F.aggregate(F.zip_with("centre1", "centre2", lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda a, x: a + x))
        near = F.col("centre1").isNull() | F.col("centre2").isNull() | (gap <= F.col("radius1") + F.col("radius2") + reach)
        pairs = save(met.where((F.col("node1") == F.col("node2")) | near).select(F.col("node1").alias("p1"), F.col("node2").alias("p2")), "node-pairs")
    return pairs


def near_duplicates(vectors: DataFrame, threshold: float = 0.98, id_col: str = "vec_id", vector_col: str = "embedding",
                    label_col: str = "label", cell: int = CELL) -> DataFrame:
    """id_col, n_links, component_id, kept."""
    sound = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))
    rows = vectors.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), F.col(vector_col).cast("array<double>").alias("v"))
    good = F.col("label").isNotNull() & F.col("id").isNotNull() & (F.size("v") > 0) & F.forall("v", sound) & F.exists("v", lambda c: c != 0)
    scaled = lambda by: F.transform("v", lambda c: c / by)
    sound_rows = rows.where(good).withColumn("top", F.array_max(F.transform("v", lambda c: F.abs(c)))).select("id", "label", scaled(F.col("top")).alias("v"))
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, c: a + c * c))
    unit = save(sound_rows.withColumn("norm", norm).select("id", "label", scaled(F.col("norm")).alias("v")), "vectors")
    entries = save(unit.groupBy("label", "v").agg(F.count("*").alias("m"), F.min("id").alias("rep")).withColumn("node", F.xxhash64("label", F.size("v"))), "vector-entries")
    nodes, placed = grown(entries.select("node", "v", "m", "rep"), cell)
    pairs = leaf_pairs(nodes, float(np.sqrt(max(0.0, 2 - 2 * threshold))) + 1e-6)
    # a leaf is one chunk, but for those that centres could not part
    subs = nodes.where("leaf").select("node", F.ceil(F.col("n") / cell).cast("int").alias("subs"))
    one, two = (subs.select(F.col("node").alias(f"p{k}"), F.col("subs").alias(f"s{k}")) for k in (1, 2))
    pairs = pairs.join(one, "p1").join(two, "p2")
    pairs = pairs.withColumn("c1", F.explode(F.sequence(F.lit(0), F.col("s1") - 1))).withColumn("c2", F.explode(F.sequence(F.lit(0), F.col("s2") - 1)))
    pairs = pairs.where((F.col("p1") != F.col("p2")) | (F.col("c1") <= F.col("c2"))).select("p1", "c1", "p2", "c2")
    same = (F.col("p1") == F.col("p2")) & (F.col("c1") == F.col("c2"))
    left = pairs.select(F.col("p1").alias("node"), F.col("c1").alias("c"), F.lit(0).alias("side"), "p1", "c1", "p2", "c2")
    right = pairs.where(~same).select(F.col("p2").alias("node"), F.col("c2").alias("c"), F.lit(1).alias("side"), "p1", "c1", "p2", "c2")
    chunked = placed.join(subs, "node").withColumn("c", F.pmod(F.xxhash64("rep"), F.col("subs")).cast("int"))
    dealt = chunked.join(left.unionByName(right), ["node", "c"]).select("p1", "c1", "p2", "c2", "side", "v", "m", "rep")

    def task(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        p1, c1, p2, c2 = key
        pdf = pdf.sort_values(["side", "rep"])
        return link_chunks(np.stack(pdf["v"].to_numpy()), pdf["m"].to_numpy(), pdf["rep"].to_numpy(), pdf["side"].to_numpy(), threshold, (p1, c1) == (p2, c2))

    found = save(dealt.groupBy("p1", "c1", "p2", "c2").applyInPandas(task, "rep long, links long, root long"), "vector-links")
    roots = connected_components(found.select(F.col("rep").alias("a"), F.col("root").alias("b")))
    per = found.groupBy("rep").agg(F.sum("links").alias("links")).join(roots, F.col("rep") == F.col("node"), "left").select("rep", "links", "root")
    known = save(entries.join(per, "rep", "left").select("label", "v", F.col("m").alias("met"), "m", "rep", "links", "root"), "vector-components")
    out = join_by_key(unit, known, ["label", "v"], "met").select(
        "id", (F.coalesce("links", F.lit(0)) + F.col("m") - 1).alias("n_links"), F.coalesce("root", "rep").alias("component_id")
    )
    out = out.unionByName(rows.where(~F.coalesce(good, F.lit(False))).select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id")))
    return out.select(F.col("id").alias(id_col), "n_links", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept"))
