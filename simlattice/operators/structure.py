"""Trees and clusters of a distance table, each as one grouped-map step over a dense matrix, and comparisons of two of them.

These kernels are sequential and need the whole matrix, so a group is refused beyond most_n records instead of hanging a task.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from simlattice.operators import kernels

MOST = 3000
TREE = "node long, parent long, length double, name string, depth double, height double"


def dense(pdf: pd.DataFrame, names: list, missing: float = 1.0) -> np.ndarray:
    """The symmetric matrix of pairs (i, j, d) over names; pairs without a row are at distance missing."""
    at = {x: k for k, x in enumerate(names)}
    out = np.full((len(names), len(names)), missing)
    np.fill_diagonal(out, 0.0)
    i, j = pdf["i"].map(at).to_numpy(), pdf["j"].map(at).to_numpy()
    out[i, j] = out[j, i] = pdf["d"].to_numpy(float)
    return out


def _in_one(pairs: DataFrame, ids: DataFrame, make: Callable[[np.ndarray, list[str]], pd.DataFrame], schema: str, most: int, missing: float) -> DataFrame:
    """make(matrix, names) in one task, names in the order of ids(id, row_idx)."""
    n = ids.count()
    if n > most:
        raise ValueError(f"{n} records; a dense matrix of more than {most} is refused")
    rows = pairs.select(F.lit(0).alias("g"), F.col("i").cast("string"), F.col("j").cast("string"), F.col("d").cast("double"), F.lit(None).cast("long").alias("row_idx"))
    names = ids.select(F.lit(0).alias("g"), F.col("id").cast("string").alias("i"), F.lit(None).cast("string").alias("j"), F.lit(None).cast("double").alias("d"), F.col("row_idx").cast("long"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        own = pdf[pdf["j"].isna()].sort_values("row_idx", kind="stable")["i"].tolist()
        return make(dense(pdf[pdf["j"].notna()], own, missing), own)

    return rows.unionByName(names).groupBy("g").applyInPandas(run, schema)


def _tree_rows(tree: kernels.Tree) -> pd.DataFrame:
    place = {n: (depth, height) for n, depth, height in kernels.layout(tree)}
    rows = [(n, up, length, name, *place[n]) for n, up, length, name in tree]
    out = pd.DataFrame(rows, columns=["node", "parent", "length", "name", "depth", "height"])
    out["parent"] = out["parent"].astype("Int64")
    return out


def neighbour_joining(pairs: DataFrame, ids: DataFrame, midpoint: bool = True, most: int = MOST, missing: float = 1.0) -> DataFrame:
    """The neighbour-joining tree, rooted at its midpoint, as rows with places for drawing."""
    root = kernels.midpoint_rooted if midpoint else (lambda t: t)
    return _in_one(pairs, ids, lambda d, names: _tree_rows(root(kernels.neighbour_joining(d, names))), TREE, most, missing)


def average_linkage(pairs: DataFrame, ids: DataFrame, most: int = MOST, missing: float = 1.0) -> DataFrame:
    return _in_one(pairs, ids, lambda d, names: _tree_rows(kernels.average_linkage(d, names)), TREE, most, missing)


def _labels(kernel: Callable) -> Callable:
    return lambda d, names: pd.DataFrame({"id": names, "label": kernel(d)})


def hdbscan(pairs: DataFrame, ids: DataFrame, least: int = 2, most: int = MOST, missing: float = 1.0) -> DataFrame:
    """(id, label): density clusters, -1 for noise."""
    return _in_one(pairs, ids, _labels(lambda d: kernels.hdbscan(d, least)), "id string, label int", most, missing)


def greedy_clusters(pairs: DataFrame, ids: DataFrame, threshold: float = 0.5, most: int = MOST, missing: float = 1.0) -> DataFrame:
    """(id, label): each record joins the first cluster that has a member within the threshold, in order."""
    return _in_one(pairs, ids, _labels(lambda d: kernels.greedy_clusters(d, threshold)), "id string, label int", most, missing)


def collected(tree: DataFrame) -> kernels.Tree:
    """A tree table, of at most twice MOST rows, as the kernels' list."""
    return [(r["node"], r["parent"], r["length"], r["name"]) for r in tree.orderBy("node").collect()]


def compare(tree_a: DataFrame, tree_b: DataFrame) -> DataFrame:
    """One row: the share of splits that only one tree has, and the correlation of path lengths."""
    a, b = collected(tree_a), collected(tree_b)
    return tree_a.sparkSession.createDataFrame([(kernels.robinson_foulds(a, b), kernels.cophenetic_r(a, b))], "robinson_foulds double, cophenetic_r double")


def nearest_unchanged(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: the share of records whose nearest one is the same in both nearest(i, j) tables."""
    both = a.select("i", F.col("j").alias("ja")).join(b.select("i", F.col("j").alias("jb")), "i")
    return both.agg(F.avg((F.col("ja") == F.col("jb")).cast("double")).alias("unchanged"))


def nearest_changes(a: DataFrame, b: DataFrame, examples: int = 15) -> DataFrame:
    """(i, ja, jb): the first records whose nearest one changed."""
    both = a.select("i", F.col("j").alias("ja")).join(b.select("i", F.col("j").alias("jb")), "i")
    return both.filter("ja <> jb").orderBy("i").limit(examples)
