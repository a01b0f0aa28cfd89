"""Speaker embeddings: similarities, pruning, Laplacian, centroids and clustering, per job."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import cosine
from .scans import cut_lineage

#: Vectors of one block of a job's matrix.
BLOCK = 256


def similarity_pairs(embedded: DataFrame) -> DataFrame:
    """Cosine similarity of every pair of vectors of a job (a job's matrix is the result asked for).

    The matrix is made in blocks: each vector goes to its block's row of blocks (job, block, other block) once, so a job
    spreads over its blocks, and each vector is normalised once. Only i <= j are computed; the rest is mirrored."""
    norm = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda t, v: t + v.cast("double") * v.cast("double")))
    unit = embedded.select("job_id", "ord", F.expr(f"ord div {BLOCK}").alias("block"), F.transform("embedding", lambda v: v.cast("double") / (norm + 1e-8)).alias("u"))
    blocks = unit.groupBy("job_id").agg(F.max("block").alias("last"))
    dealt = unit.join(blocks, "job_id")
    rows = dealt.select("job_id", F.col("ord").alias("i"), F.col("u").alias("a"), F.col("block").alias("p"), F.explode(F.sequence("block", "last")).alias("q"))
    columns = dealt.select("job_id", F.col("ord").alias("j"), F.col("u").alias("b"), F.explode(F.sequence(F.lit(0).cast("long"), "block")).alias("p"), F.col("block").alias("q"))
    dot = F.aggregate(F.zip_with("a", "b", lambda x, y: x * y), F.lit(0.0), lambda t, v: t + v)
    half = rows.join(columns, ["job_id", "p", "q"]).filter("i <= j").select("job_id", "i", "j", dot.alias("sim"))
    both = F.when(F.col("i") == F.col("j"), F.array(F.struct("i", "j"))).otherwise(F.array(F.struct("i", "j"), F.struct(F.col("j").alias("i"), F.col("i").alias("j"))))
    return half.select("job_id", F.explode(both).alias("at"), "sim").select("job_id", "at.i", "at.j", "sim")


def prune(pairs: DataFrame, pval: float = 0.012, least: int = 6) -> DataFrame:
    """The least similar entries of each row become 0: int((1 - pval) * N) of them, at most N - ``least``."""
    row = W.partitionBy("job_id", "i")
    n = F.count("*").over(row)
    gone = F.least(F.floor((1 - pval) * n), n - least)
    rank = F.row_number().over(row.orderBy("sim", "j"))
    return pairs.withColumns({"_n": gone, "_r": rank}).select("job_id", "i", "j", F.when(F.col("_r") <= F.col("_n"), 0.0).otherwise(F.col("sim")).alias("sim"))


def laplacian(pairs: DataFrame) -> DataFrame:
    """D - M of the symmetrised matrix without its diagonal, D the row sums of magnitudes."""
    back = pairs.select("job_id", F.col("i").alias("j"), F.col("j").alias("i"), F.col("sim").alias("back"))
    m = pairs.join(back, ["job_id", "i", "j"]).select("job_id", "i", "j", F.when(F.col("i") == F.col("j"), 0.0).otherwise(0.5 * (F.col("sim") + F.col("back"))).alias("m"))
    degree = F.sum(F.abs("m")).over(W.partitionBy("job_id", "i"))
    return m.select("job_id", "i", "j", F.when(F.col("i") == F.col("j"), degree).otherwise(-F.col("m")).alias("value"))


def centroids(embedded: DataFrame, label: str = "label") -> DataFrame:
    """Mean vector by label, as rows (label, dim, mean), and sizes."""
    return embedded.select(label, F.posexplode("embedding").alias("dim", "x")).groupBy(label, "dim").agg(F.avg(F.col("x").cast("double")).alias("mean"), F.count("*").alias("size"))


def reassign_minor(embedded: DataFrame, max_minor: int) -> DataFrame:
    """Rows of clusters of at most ``max_minor`` go to the most similar centroid of a larger one (the smaller label
    on a tie). Centroids are one row a label and are joined by job."""
    sizes = embedded.groupBy("job_id", "label").agg(F.count("*").alias("size"))
    rows = embedded.join(sizes, ["job_id", "label"])
    flat = rows.filter(F.col("size") > max_minor).select("job_id", "label", F.posexplode("embedding").alias("dim", "x"))
    mean = flat.groupBy("job_id", "label", "dim").agg(F.avg(F.col("x").cast("double")).alias("m"))
    centre = mean.groupBy("job_id", "label").agg(F.transform(F.sort_array(F.collect_list(F.struct("dim", "m"))), lambda p: p["m"]).alias("c"))
    minor = rows.filter(F.col("size") <= max_minor).select("job_id", "vec_id", "label", "embedding")
    near = minor.join(centre.withColumnRenamed("label", "to"), "job_id").select("job_id", "vec_id", "to", cosine("embedding", "c").alias("sim"))
    best = near.groupBy("job_id", "vec_id").agg(F.max_by("to", F.struct("sim", -F.col("to"))).alias("new_label"))
    return rows.join(best, ["job_id", "vec_id"], "left").select("job_id", "vec_id", F.coalesce("new_label", "label").alias("label"))


def _average_linkage(sims: np.ndarray, threshold: float) -> np.ndarray:
    """Average-linkage clusters whose mean similarity reaches ``threshold``."""
    n = len(sims)
    label, size = np.arange(n), np.ones(n)
    work = sims.astype(float).copy()
    np.fill_diagonal(work, -np.inf)
    while n > 1:
        i, j = divmod(int(np.argmax(work)), n)
        if work[i, j] < threshold:
            break
        i, j = min(i, j), max(i, j)
        work[i] = (size[i] * work[i] + size[j] * work[j]) / (size[i] + size[j])
        work[:, i] = work[i]
        work[i, i] = work[j, :] = work[:, j] = -np.inf
        size[i] += size[j]
        label[label == j] = i
    return np.unique(label, return_inverse=True)[1]


def average_linkage(embedded: DataFrame, threshold: float = 0.4) -> DataFrame:
    """E5 for recordings of any length: (job_id, ord, cluster), the average-linkage clusters whose mean similarity reaches
    ``threshold``, named by their first ord.

    The state is a table of cluster pairs with the sum and the number of their vectors' similarities, made from the blocks
    of E1. In each round every two clusters that are nearest to each other merge. A merged cluster is never nearer to a
    third than the nearer of its parts was, so merging such pairs side by side gives the same clusters as merging the
    nearest pair of all, one after the other; the rounds are about the logarithm of the number of vectors. A job needs no
    group and no matrix of its own."""
    pairs = similarity_pairs(embedded).filter("i < j").select("job_id", F.col("i").alias("a"), F.col("j").alias("b"), F.col("sim").alias("total"), F.lit(1).cast("long").alias("n"))
    pairs, labels = cut_lineage(pairs), embedded.select("job_id", "ord", F.col("ord").alias("cluster"))
    while True:
        # one order of all pairs for both ends, so ties do not break the symmetry
        rank = F.named_struct(F.lit("mean"), F.col("total") / F.col("n"), F.lit("a"), -F.col("a"), F.lit("b"), -F.col("b"))
        ends = pairs.select("job_id", rank.alias("rank"), F.explode(F.array("a", "b")).alias("end"))
        best = ends.groupBy("job_id", "end").agg(F.max("rank").alias("rank")).filter(F.col("rank.mean") >= threshold)
        merged = best.groupBy("job_id", "rank").agg(F.count("*").alias("ends")).filter("ends = 2")
        merged = cut_lineage(merged.select("job_id", (-F.col("rank.b")).alias("gone"), (-F.col("rank.a")).alias("into")))
        if merged.isEmpty():
            return labels
        moved = lambda rows, c: rows.join(merged.withColumnRenamed("gone", c), ["job_id", c], "left").withColumn(c, F.coalesce("into", c)).drop("into")
        pairs = moved(moved(pairs, "a"), "b").filter("a <> b")
        pairs = pairs.groupBy("job_id", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.sum("total").alias("total"), F.sum("n").alias("n"))
        pairs, labels = cut_lineage(pairs), cut_lineage(moved(labels, "cluster"))


def _spectral(vectors: np.ndarray, most: int, seed: int = 0) -> np.ndarray:
    """Clusters by the largest gap of the Laplacian's first eigenvalues and seeded k-means on its eigenvectors."""
    unit = vectors / (np.linalg.norm(vectors, axis=1, keepdims=True) + 1e-8)
    sims = unit @ unit.T
    n = len(sims)
    gone = max(0, min(int((1 - 0.012) * n), n - 6))
    np.put_along_axis(sims, np.argsort(sims, axis=1, kind="stable")[:, :gone], 0.0, axis=1)
    m = 0.5 * (sims + sims.T)
    np.fill_diagonal(m, 0)
    values, axes = np.linalg.eigh(np.diag(np.abs(m).sum(axis=1)) - m)
    k = int(np.argmax(np.diff(values[: most + 1]))) + 1
    points, draw = axes[:, :k], np.random.default_rng(seed)
    centre = points[draw.choice(n, size=k, replace=False)]
    for _ in range(100):
        label = np.argmin(((points[:, None] - centre[None]) ** 2).sum(axis=2), axis=1)
        new = np.stack([points[label == c].mean(axis=0) if (label == c).any() else centre[c] for c in range(k)])
        if np.allclose(new, centre):
            break
        centre = new
    return label


def _merge_near(vectors: np.ndarray, label: np.ndarray, threshold: float) -> np.ndarray:
    """The two clusters with the closest centroids merge while their cosine reaches ``threshold``."""
    while len(names := np.unique(label)) > 1:
        mean = np.stack([vectors[label == c].mean(axis=0) for c in names])
        mean /= np.linalg.norm(mean, axis=1, keepdims=True) + 1e-8
        sims = mean @ mean.T
        np.fill_diagonal(sims, -np.inf)
        i, j = divmod(int(np.argmax(sims)), len(names))
        if sims[i, j] < threshold:
            break
        label = np.where(label == names[max(i, j)], names[min(i, j)], label)
    return np.unique(label, return_inverse=True)[1]


def _without_minor(vectors: np.ndarray, label: np.ndarray, minor: int) -> np.ndarray:
    """E6 inside one job: clusters of at most ``minor`` vectors go to the nearest centroid of a larger one (cluster 0 if
    there is none)."""
    names, counts = np.unique(label, return_counts=True)
    major = names[counts > minor]
    if not len(major):
        return np.zeros_like(label)
    centre = np.stack([vectors[label == c].mean(axis=0) for c in major])
    unit = centre / (np.linalg.norm(centre, axis=1, keepdims=True) + 1e-8)
    return np.where(np.isin(label, major), label, major[np.argmax(vectors @ unit.T, axis=1)])


def cluster_speakers(embedded: DataFrame, linkage: float = 0.4, merge: float = 0.8, most: int = 15, small: int = 40, minor: int = 4) -> DataFrame:
    """Speaker clusters of each job: one vector is cluster 0, under ``small`` vectors average linkage,
    else spectral; then clusters of at most ``minor`` vectors are dissolved, and near clusters merge. A job's vectors
    (one for each 1.5 s of one recording) are one group."""

    def work(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("ord")
        vectors = np.stack(pdf["embedding"].to_numpy()).astype(float)
        if len(vectors) <= 1:
            label = np.zeros(len(vectors), np.int64)
        elif len(vectors) < small:
            unit = vectors / (np.linalg.norm(vectors, axis=1, keepdims=True) + 1e-8)
            label = _average_linkage(unit @ unit.T, linkage)
        else:
            label = _spectral(vectors, most)
        if len(vectors) > 1:
            label = _without_minor(vectors, label, minor)
        return pdf[["job_id", "ord"]].assign(cluster=_merge_near(vectors, label, merge).astype("int64"))

    return embedded.select("job_id", "ord", "embedding").groupBy("job_id").applyInPandas(work, "job_id long, ord long, cluster long")
