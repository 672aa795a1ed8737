"""Fuzzy density clustering of a similarity graph, its parameters from the data, and parameter sweeps.

Points whose summed similarity to neighbours reaches mu_min are cores; connected cores are a cluster;
another point with core neighbours belongs to their clusters in proportion to its similarity; the rest
is noise. Similarities and densities are compared after rounding to 12 decimals. Many parameter
settings run as one job, told apart by ``candidate``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .components import components
from .graph import degrees, jaccard, local_graph, pairs
from .storage import cut_lineage, written

DEFAULTS = {"sim_min": 0.12, "mu_min": 0.5, "min_cooc": 2, "limit": 200}
FACTORS = (0.7, 1.0, 1.5, 2.2)


def _near(points: DataFrame, edges: DataFrame, params: DataFrame) -> DataFrame:
    """(candidate, mu_min, p, q, sim), both ways, of the pairs that are similar enough."""
    e = edges.select("a", "b", F.round("sim", 12).alias("sim")).filter("a <> b and sim > 0")
    e = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b"), "sim")).groupBy("a", "b").agg(F.max("sim").alias("sim"))
    pts = points.select(F.col("point").alias("a")).distinct()
    e = e.join(pts, "a", "left_semi").join(pts.withColumnRenamed("a", "b"), "b", "left_semi")
    return e.join(F.broadcast(params), F.col("sim") >= F.round("sim_min", 12)).select("candidate", "mu_min", F.col("a").alias("p"), F.col("b").alias("q"), "sim")


def fdbscan_batch(points: DataFrame, edges: DataFrame, params: DataFrame) -> DataFrame:
    """(candidate, point, cluster, membership, core) of every point that is in a cluster.

    ``points``: point. ``edges``: a, b, sim, in one direction or both. ``params``: candidate, sim_min, mu_min.
    """
    near = cut_lineage(_near(points, edges, params))
    # summed in a fixed order, as a threshold follows
    rho = F.round(F.aggregate(F.sort_array(F.collect_list("sim")), F.lit(0.0), lambda s, x: s + x), 12)
    core = near.groupBy("candidate", "p", "mu_min").agg(rho.alias("rho")).filter((F.col("rho") > 0) & (F.col("rho") >= F.round("mu_min", 12))).select("candidate", "p")
    core = cut_lineage(core)
    to_core = near.join(core.withColumnRenamed("p", "q"), ["candidate", "q"], "left_semi")
    inner = to_core.join(core, ["candidate", "p"], "left_semi")
    label = components(core.select("candidate", F.col("p").alias("node")), inner.filter("p < q").select("candidate", F.col("p").alias("a"), F.col("q").alias("b")), ["candidate"])
    of = label.withColumnRenamed("node", "p")
    border = to_core.join(core, ["candidate", "p"], "left_anti").join(of.withColumnRenamed("p", "q"), ["candidate", "q"]).select("candidate", "p", "label", "sim")
    return members_of(of, border, label, "sim")


def members_of(cores: DataFrame, border: DataFrame, labels: DataFrame, weight: str) -> DataFrame:
    """(candidate, point, cluster, membership, core) from cores (candidate, p, label) and what other points have of a label (candidate, p, label, weight).

    Clusters are numbered in the order of ``labels``.
    """
    w = Window.partitionBy("candidate").orderBy("label")
    number = labels.select("candidate", "label").distinct().withColumn("cluster", (F.row_number().over(w) - 1).cast("int"))
    own = cores.join(number, ["candidate", "label"]).select("candidate", F.col("p").alias("point"), "cluster", F.lit(1.0).alias("membership"), F.lit(True).alias("core"))
    part = border.groupBy("candidate", "p", "label").agg(F.sum(weight).alias("s")).join(number, ["candidate", "label"])
    share = F.col("s") / F.sum("s").over(Window.partitionBy("candidate", "p"))
    return own.unionByName(part.select("candidate", F.col("p").alias("point"), "cluster", share.alias("membership"), F.lit(False).alias("core")))


def _one(spark, sim_min: float, mu_min: float) -> DataFrame:
    return spark.createDataFrame([(0, float(sim_min), float(mu_min))], "candidate int, sim_min double, mu_min double")


def fdbscan(points: DataFrame, edges: DataFrame, sim_min: float = DEFAULTS["sim_min"], mu_min: float = DEFAULTS["mu_min"]) -> DataFrame:
    """(point, cluster, membership, core) for one setting."""
    return fdbscan_batch(points, edges, _one(points.sparkSession, sim_min, mu_min)).drop("candidate")


def noise(points: DataFrame, members: DataFrame) -> DataFrame:
    return points.select("point").distinct().join(members, "point", "left_anti")


#: One part in so many is how far a sketch may be off in rank.
_ACCURACY = 20_000

#: Groups that every task may hold.
SMALL_GROUPS = 500_000


def quantile(df: DataFrame, by: list[str], value: str, q: float, out: str = "q") -> DataFrame:
    """(by, out): the value at place floor(q * (n - 1)) in ascending order, of the values of each group; null if there are none.

    A sketch brackets the place; values below the bracket are counted, and only those within, one row for each
    value, are put in order. So no group is gathered, and the result is exact.
    """
    v = df.select(*by, F.col(value).alias("_v")).filter(F.col("_v").isNotNull())
    keys = by or ["_all"]
    v = v if by else v.withColumn("_all", F.lit(1))
    near = lambda d: F.percentile_approx("_v", F.lit(min(1.0, max(0.0, q + d / _ACCURACY))), F.lit(_ACCURACY))
    edge = v.groupBy(*keys).agg(F.count("*").alias("_n"), near(-3).alias("_lo"), near(3).alias("_hi"), F.min("_v").alias("_min"), F.max("_v").alias("_max"))
    # the place of a small group may be off by a row or two besides
    small = F.col("_n") <= 10 * _ACCURACY
    edge = edge.select(*keys, F.floor(F.lit(q) * (F.col("_n") - 1)).alias("_place"), F.when(small, F.col("_min")).otherwise(F.col("_lo")).alias("_lo"), F.when(small, F.col("_max")).otherwise(F.col("_hi")).alias("_hi"))
    edge = written(edge, "edge")
    # a join on so few keys would gather each group in one task
    met = v.join(F.broadcast(edge) if edge.count() <= SMALL_GROUPS else edge, keys).filter("_v <= _hi")
    below = F.col("_v") < F.col("_lo")
    counts = met.groupBy(*keys, "_place", F.when(~below, F.col("_v")).alias("_v")).agg(F.count("*").alias("_k"))
    upto = F.sum("_k").over(Window.partitionBy(*keys).orderBy(F.col("_v").asc_nulls_first()))
    got = counts.withColumn("_upto", upto).filter((F.col("_upto") > F.col("_place")) & F.col("_v").isNotNull()).groupBy(*keys).agg(F.min("_v").alias(out))
    if by:
        return df.select(*by).distinct().join(got, by, "left")
    return got.agg(F.min(out).alias(out))


def estimate_min_cooc(units: Column) -> Column:
    return F.least(F.greatest(F.floor(F.log10(units + 1.0) + 0.5), F.lit(1)), F.lit(5)).cast("int")


def round3(c: Column) -> Column:
    return F.floor(c * 1000 + 0.5) / 1000


def suggest_thresholds(points: DataFrame, edges: DataFrame, sim_q: float = 0.8, mu_q: float = 0.5) -> DataFrame:
    """One row: sim_min and mu_min from the quantiles of similarities and of densities, and positive_edges."""
    e = cut_lineage(edges.filter("sim > 0").select("a", "b", F.round("sim", 12).alias("sim")))
    s = quantile(e, [], "sim", sim_q, "s").join(e.agg(F.count("*").alias("positive_edges")), F.lit(True)).withColumn("s", F.coalesce("s", F.lit(DEFAULTS["sim_min"])))
    s = cut_lineage(s)
    both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b"), "sim"))
    strong = both.join(F.broadcast(s), F.col("sim") >= F.col("s")).groupBy("a").agg(F.aggregate(F.sort_array(F.collect_list("sim")), F.lit(0.0), lambda t, x: t + x).alias("rho"))
    dens = points.select(F.col("point").alias("a")).distinct().join(strong, "a", "left").select(F.round(F.coalesce("rho", F.lit(0.0)), 12).alias("rho"))
    mu = quantile(dens, [], "rho", mu_q, "m")
    return s.join(F.broadcast(mu), F.lit(True)).select(round3(F.col("s")).alias("sim_min"), round3(F.coalesce("m", F.lit(DEFAULTS["mu_min"]))).alias("mu_min"), "positive_edges")


def suggest(mentions: DataFrame, unit: str, entity: str, seed: DataFrame, limit: int = 200) -> dict | None:
    """Parameters for the seed's local graph, or None if the seed or its neighbours are not there."""
    members, edges, _ = local_graph(mentions, unit, entity, seed, 1, limit)
    members = cut_lineage(members)
    own = degrees(mentions, unit, entity, seed).agg(F.max("degree").alias("d")).select("d", estimate_min_cooc(F.col("d")).alias("m")).first()
    if own["d"] is None or members.count() < 2:
        return None
    if own["m"] > 1:
        members, edges, _ = local_graph(mentions, unit, entity, seed, own["m"], limit)
        members = cut_lineage(members)
    r = suggest_thresholds(members.select(F.col("entity").alias("point")), edges).first()
    return {"min_cooc": own["m"], "sim_min": r["sim_min"], "mu_min": r["mu_min"], "seed_units": own["d"], "neighbours": members.count() - 1, "positive_edges": r["positive_edges"]}


def quality(points: DataFrame, members: DataFrame, params: DataFrame) -> DataFrame:
    """candidate, clusters, noise_rate, max_fuzzy, border_rate and score (null where the clustering is degenerate)."""
    n = F.lit(float(points.select("point").distinct().count()))
    sizes = members.groupBy("candidate", "cluster").agg(F.count("*").alias("k")).groupBy("candidate").agg(F.count("*").alias("clusters"), F.max("k").alias("largest"))
    point = members.groupBy("candidate", "point").agg(F.count("*").alias("k"), F.max("membership").alias("m")).groupBy("candidate").agg(
        F.count("*").alias("inside"), F.count(F.when(~((F.col("k") == 1) & (F.col("m") == 1)), 1)).alias("border")
    )
    z = lambda c: F.coalesce(F.col(c), F.lit(0))
    out = params.join(sizes, "candidate", "left").join(point, "candidate", "left").select(
        "candidate", "sim_min", "mu_min", z("clusters").alias("clusters"), ((n - z("inside")) / n).alias("noise_rate"), (z("largest") / n).alias("max_fuzzy"), (z("border") / n).alias("border_rate")
    )
    s = -F.abs(F.col("noise_rate") - 0.4) - F.greatest(F.lit(0.0), F.col("max_fuzzy") - 0.5) - F.when(F.col("clusters").between(2, 6), 0.0).otherwise(0.3) + F.least("border_rate", F.lit(0.2))
    bad = (F.col("clusters") == 0) | (F.col("noise_rate") > 0.9) | (F.col("max_fuzzy") > 0.9)
    return out.withColumn("score", F.when(~bad, s))


def grid(spark, sim_min: float, mu_min: float, factors=FACTORS) -> DataFrame:
    rows = [(i * len(factors) + j, sim_min * a, mu_min * b) for i, a in enumerate(factors) for j, b in enumerate(factors)]
    return spark.createDataFrame(rows, "candidate int, sim_min double, mu_min double")


def auto(points: DataFrame, edges: DataFrame, sim_min: float, mu_min: float) -> tuple[DataFrame, dict]:
    """Members for the best of the settings around (sim_min, mu_min), and the choice.

    Best by score, then lower sim_min, then lower mu_min. If all are degenerate the defaults are used.
    """
    spark = points.sparkSession
    params = grid(spark, sim_min, mu_min)
    members = cut_lineage(fdbscan_batch(points, edges, params))
    best = quality(points, members, params).filter("score is not null").orderBy(F.desc(F.round("score", 12)), "sim_min", "mu_min").limit(1).collect()
    if best:
        b = best[0]
        return members.filter(F.col("candidate") == b["candidate"]).drop("candidate"), {"sim_min": b["sim_min"], "mu_min": b["mu_min"], "score": b["score"], "fallback": False}
    return fdbscan(points, edges), {"sim_min": DEFAULTS["sim_min"], "mu_min": DEFAULTS["mu_min"], "score": None, "fallback": True}


def sweep(points: DataFrame, edges: DataFrame, params: DataFrame) -> DataFrame:
    """``assess`` of every setting."""
    return assess(points, fdbscan_batch(points, edges, params), params)


def assess(points: DataFrame, members: DataFrame, params: DataFrame) -> DataFrame:
    """Quality of every setting with core ratio, points in several clusters and mean membership entropy."""
    members = cut_lineage(members)
    n = float(points.select("point").distinct().count())
    per = members.groupBy("candidate", "point").agg(F.count("*").alias("k"), F.max(F.col("core").cast("int")).alias("core"), (-F.sum(F.col("membership") * F.log("membership"))).alias("h"))
    more = per.groupBy("candidate").agg((F.sum("core") / n).alias("core_ratio"), (F.count(F.when(F.col("k") > 1, 1)) / n).alias("multi_border"), F.avg(F.when(F.col("core") == 0, F.col("h"))).alias("entropy"))
    return quality(points, members, params).join(more, "candidate", "left")


def place_clusters(mentions: DataFrame, unit: str, entity: str, seed: DataFrame, mode: str = "fixed", sim_min: float = DEFAULTS["sim_min"], mu_min: float = DEFAULTS["mu_min"], min_cooc: int = DEFAULTS["min_cooc"], limit: int = DEFAULTS["limit"]) -> dict:
    """Clusters around a seed: {members, noise, params, truncated, ...}. An unknown seed has no members and no noise."""
    if mode not in ("fixed", "auto"):
        raise ValueError("mode is fixed or auto")
    pick: dict = {"fallback": False}
    if mode == "auto":
        s = suggest(mentions, unit, entity, seed, limit)
        min_cooc = s["min_cooc"] if s else min_cooc
    points, edges, more = local_graph(mentions, unit, entity, seed, min_cooc, limit)
    points = cut_lineage(points.select(F.col("entity").alias("point")))
    if mode == "auto" and s and points.count() >= 2:
        members, pick = auto(points, edges, s["sim_min"], s["mu_min"])
        sim_min, mu_min = pick["sim_min"], pick["mu_min"]
    else:
        members = fdbscan(points, edges, sim_min, mu_min)
    known = not edges.isEmpty()
    lost = noise(points, members)
    return {"members": assemble(members), "noise": lost if known else lost.limit(0), "params": {"sim_min": sim_min, "mu_min": mu_min, "min_cooc": min_cooc, "limit": limit}, "truncated": more, "selection": pick}


def assemble(members: DataFrame) -> DataFrame:
    """Members by cluster: the strongest first, then by name."""
    return members.orderBy("cluster", F.desc("membership"), "point")
