"""Clusters of symbols with similar returns, and scores of a clustering.

A symbol's feature vector is its open/high/low/close log returns over the union
of all bar times, zero where it has none; it is never built.  A squared distance
is the two squared lengths less twice the products at common times, so one join
on time and one aggregation give it, for pairs without common times as well.
"""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import DataFrame, functions as F

from tandem.functions.ordered import chunked
from tandem.operators.clean import clean_returns
from tandem.operators.pairs import enumerate_pairs
from tandem.operators.spectral import spectral_clusters
from tandem.sources.shared import written

FIELDS = ("open", "high", "low", "close")


def return_features(bars: DataFrame) -> DataFrame:
    """(symbol, ts, r_open, r_high, r_low, r_close), gaps as zero."""
    def build(d, w):
        return d.withColumns({f"r_{f}": clean_returns(F.log(F.try_divide(F.col(f), F.lag(f, 1).over(w)))) for f in FIELDS})

    return chunked(bars.select("symbol", "ts", "rn", *FIELDS), ["symbol"], "rn", 1, 0, build).drop(*FIELDS, "rn")


def squared_distances(features: DataFrame) -> DataFrame:
    """a < b with the squared euclidean distance of their features."""
    cols = [f"r_{f}" for f in FIELDS]
    own = sum((F.pow(F.col(c), 2) for c in cols), F.lit(0.0))
    length = features.groupBy("symbol").agg(F.sum(own).alias("l2"))
    pairs = enumerate_pairs(features.select("symbol").distinct()).select(F.col("n1").alias("a"), F.col("n2").alias("b"))
    both = (pairs.join(length.select(F.col("symbol").alias("a"), F.col("l2").alias("la")), "a")
            .join(length.select(F.col("symbol").alias("b"), F.col("l2").alias("lb")), "b"))
    a = features.select(F.col("symbol").alias("a"), "ts", *[F.col(c).alias(f"a_{c}") for c in cols])
    b = features.select(F.col("symbol").alias("b"), "ts", *[F.col(c).alias(f"b_{c}") for c in cols])
    product = sum((F.col(f"a_{c}") * F.col(f"b_{c}") for c in cols), F.lit(0.0))
    common = a.join(b, "ts").where("a < b").groupBy("a", "b").agg(F.sum(product).alias("ab"))
    d2 = F.greatest(F.lit(0.0), F.col("la") + F.col("lb") - 2 * F.coalesce("ab", F.lit(0.0)))
    return both.join(common, ["a", "b"], "left").select("a", "b", d2.alias("d2"))


def affinity(distances: DataFrame, gamma: float) -> DataFrame:
    return distances.withColumn("weight", F.exp(-gamma * F.col("d2")))


def cluster_symbols(distances: DataFrame, k: int, gamma: float = 1.0) -> DataFrame:
    """(symbol, cluster) by spectral clustering of the affinity graph: leading eigenvectors, then k-means."""
    return spectral_clusters(affinity(distances, gamma), [k]).select("symbol", "cluster")


def cluster_lists(assigned: DataFrame) -> DataFrame:
    """Size and sorted members per cluster (the universe bounds a list)."""
    return assigned.groupBy("cluster").agg(F.count(F.lit(1)).alias("size"), F.array_sort(F.collect_list("symbol")).alias("symbols"))


def silhouette(assigned: DataFrame, distances: DataFrame) -> DataFrame:
    """Per asked_k the mean silhouette over all symbols from pair distances; a cluster of one scores zero."""
    both = distances.select("a", "b", F.sqrt("d2").alias("d")).unionByName(
        distances.select(F.col("b").alias("a"), F.col("a").alias("b"), F.sqrt("d2").alias("d")))
    own = assigned.select("asked_k", F.col("symbol").alias("a"), F.col("cluster").alias("ca"))
    other = assigned.select("asked_k", F.col("symbol").alias("b"), F.col("cluster").alias("cb"))
    mean = both.join(own, "a").join(other, ["asked_k", "b"]).groupBy("asked_k", "a", "ca", "cb").agg(F.avg("d").alias("m"))
    ab = mean.groupBy("asked_k", "a").agg(F.max(F.when(F.col("ca") == F.col("cb"), F.col("m"))).alias("near"),
                                          F.min(F.when(F.col("ca") != F.col("cb"), F.col("m"))).alias("far"))
    s = F.when(F.col("near").isNull() | F.col("far").isNull(), 0.0).otherwise(
        (F.col("far") - F.col("near")) / F.greatest("far", "near"))
    return ab.groupBy("asked_k").agg(F.avg(s).alias("silhouette"))


def in_one_row(*scores: DataFrame) -> DataFrame:
    """All columns in one row for each asked_k (each table has one at most); a join by a constant asked_k would have no key."""
    d = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), scores)
    return d.groupBy("asked_k").agg(*[F.max(c).alias(c) for c in d.columns if c != "asked_k"])


def centroid_scores(assigned: DataFrame, features: DataFrame) -> DataFrame:
    """Davies-Bouldin and Calinski-Harabasz scores per asked_k."""
    cols = [f"r_{f}" for f in FIELDS]
    f = features.join(assigned, "symbol")
    centre = f.groupBy("asked_k", "cluster", "ts").agg(*[F.avg(c).alias(f"m_{c}") for c in cols])
    sq = lambda left, right: sum((F.pow(F.col(left + c) - F.col(right + c), 2) for c in cols), F.lit(0.0))
    within = (f.join(centre, ["asked_k", "cluster", "ts"]).groupBy("asked_k", "cluster", "symbol").agg(F.sum(sq("", "m_")).alias("d2")))
    per = within.groupBy("asked_k", "cluster").agg(F.count(F.lit(1)).alias("size"), F.avg(F.sqrt("d2")).alias("s"), F.sum("d2").alias("w"))
    whole = features.groupBy("ts").agg(*[F.avg(c).alias(f"g_{c}") for c in cols])
    between = centre.join(whole, "ts").groupBy("asked_k", "cluster").agg(F.sum(sq("m_", "g_")).alias("g2"))
    ch = per.join(between, ["asked_k", "cluster"]).groupBy("asked_k").agg(
        F.sum("size").alias("n"), F.count(F.lit(1)).alias("k"), F.sum("w").alias("w"),
        F.sum(F.col("size") * F.col("g2")).alias("b"))
    ratio = F.try_divide(F.try_divide(F.col("b"), F.col("k") - 1), F.try_divide(F.col("w"), F.col("n") - F.col("k")))
    ch = ch.select("asked_k", "k", ratio.alias("calinski_harabasz"))
    i = centre.select("asked_k", F.col("cluster").alias("i"), "ts", *[F.col(f"m_{c}").alias(f"i_{c}") for c in cols])
    j = centre.select("asked_k", F.col("cluster").alias("j"), "ts", *[F.col(f"m_{c}").alias(f"j_{c}") for c in cols])
    apart = i.join(j, ["asked_k", "ts"]).where("i <> j").groupBy("asked_k", "i", "j").agg(F.sqrt(F.sum(sq("i_", "j_"))).alias("m"))
    ratio = (apart.join(per.select("asked_k", F.col("cluster").alias("i"), F.col("s").alias("si")), ["asked_k", "i"])
             .join(per.select("asked_k", F.col("cluster").alias("j"), F.col("s").alias("sj")), ["asked_k", "j"])
             .withColumn("r", F.try_divide(F.col("si") + F.col("sj"), F.col("m"))))
    db = ratio.groupBy("asked_k", "i").agg(F.max("r").alias("r")).groupBy("asked_k").agg(F.avg("r").alias("davies_bouldin"))
    return in_one_row(ch, db)


def size_ratio(assigned: DataFrame) -> DataFrame:
    """Per asked_k the largest cluster size over the fifth largest distinct size (or the last there is)."""
    sizes = assigned.groupBy("asked_k", "cluster").agg(F.count(F.lit(1)).alias("size")).select("asked_k", "size").distinct()
    order = F.sort_array(F.collect_list("size"), asc=False)
    d = sizes.groupBy("asked_k").agg(order.alias("_s"))
    last = F.when(F.size("_s") >= 5, 5).otherwise(F.size("_s"))
    return d.select("asked_k", (F.col("_s")[0] / F.element_at("_s", last)).alias("size_ratio"))


def scores_by_k(assigned: DataFrame, features: DataFrame, distances: DataFrame) -> DataFrame:
    """All scores of each clustering (asked_k, symbol, cluster): one row for each asked_k."""
    return in_one_row(centroid_scores(assigned, features), silhouette(assigned, distances), size_ratio(assigned)).where("k is not null")


def cluster_scores(assigned: DataFrame, features: DataFrame, distances: DataFrame) -> DataFrame:
    """All scores of one clustering: a single row."""
    return scores_by_k(assigned.withColumn("asked_k", F.lit(0)), features, distances).drop("asked_k")


def best_k(features: DataFrame, distances: DataFrame, ks: Iterable[int], gamma: float) -> DataFrame:
    """Scores for each number of clusters, all from one embedding and one pass of each score."""
    return scores_by_k(written(spectral_clusters(affinity(distances, gamma), ks), "assigned"), features, distances)
