"""Contact graph: mixing, degrees and cascades of adoption."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions.skew import lookup


def contact_edges(arcs: DataFrame, src: str = "follower_id", dst: str = "followee_id") -> DataFrame:
    """Unordered distinct pairs without self-loops."""
    return (
        arcs.where(F.col(src) != F.col(dst))
        .select(F.least(src, dst).alias("src"), F.greatest(src, dst).alias("dst"))
        .distinct()
    )


def directed_edges(arcs: DataFrame, src: str = "follower_id", dst: str = "followee_id") -> DataFrame:
    """Distinct arcs without self-loops."""
    return arcs.where(F.col(src) != F.col(dst)).select(F.col(src).alias("src"), F.col(dst).alias("dst")).distinct()


def both_ways(edges: DataFrame) -> DataFrame:
    pairs = F.array(
        F.struct(F.col("src").alias("user_id"), F.col("dst").alias("neighbor_id")),
        F.struct(F.col("dst").alias("user_id"), F.col("src").alias("neighbor_id")),
    )
    return edges.select(F.inline(pairs))


def missing_community_edges(arcs: DataFrame, users: DataFrame, src: str = "follower_id", dst: str = "followee_id") -> DataFrame:
    """Arcs with an unlabelled endpoint, self-loops included: the label check comes first."""
    ends = label_edges(arcs.select(F.col(src).alias("src"), F.col(dst).alias("dst")), users)
    return ends.where("src_community is null or dst_community is null").select("src", "dst")


def label_edges(edges: DataFrame, users: DataFrame, *, limit: int | None = None) -> DataFrame:
    out = edges
    for end in ("src", "dst"):
        dim = users.select(F.col("user_id").alias(end), F.col("community").alias(f"{end}_community"))
        out = lookup(out, dim, end, "left", limit=limit)
    return out


def mixing_stats(arcs: DataFrame, users: DataFrame, mode: str = "symmetrize") -> DataFrame:
    """One row: intra and inter edges, mu (NULL without edges), self-loops, duplicates.

    Repeated pairs are collapsed while counting, so one pass gives both the distinct
    edges and the number of duplicates.
    """
    if mode not in ("symmetrize", "arcs"):
        raise ValueError("mode is symmetrize or arcs")
    a, b = F.col("follower_id"), F.col("followee_id")
    ends = (F.least(a, b), F.greatest(a, b)) if mode == "symmetrize" else (a, b)
    pairs = arcs.select(ends[0].alias("src"), ends[1].alias("dst")).groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n"))
    rows = label_edges(pairs, users)
    loop = F.col("src") == F.col("dst")
    same = F.col("src_community") == F.col("dst_community")
    intra, inter = F.count_if(~loop & same), F.count_if(~loop & ~same)
    out = rows.agg(
        intra.alias("intra_edges"),
        inter.alias("inter_edges"),
        F.coalesce(F.sum(F.when(loop, F.col("n"))), F.lit(0)).alias("self_loops"),
        F.coalesce(F.sum(F.when(~loop, F.col("n") - 1)), F.lit(0)).alias("duplicates"),
        F.count_if(F.col("src_community").isNull() | F.col("dst_community").isNull()).alias("unlabelled"),
    )
    total = F.col("intra_edges") + F.col("inter_edges")
    # one unlabelled endpoint makes the whole measurement invalid
    valid = F.col("unlabelled") == 0
    return out.select(
        F.lit(mode).alias("mode"),
        "intra_edges",
        "inter_edges",
        total.alias("total_edges"),
        F.when(valid & (total > 0), F.col("inter_edges") / total).alias("mu"),
        "self_loops",
        "duplicates",
        valid.alias("valid"),
    )


def mixing_per_community(arcs: DataFrame, users: DataFrame) -> DataFrame:
    """Per community: nodes, intra incidents (2 per edge), inter incidents, isolated nodes."""
    edges = label_edges(contact_edges(arcs), users)
    same = F.col("src_community") == F.col("dst_community")
    ends = F.array(F.col("src_community"), F.col("dst_community"))
    incidents = (
        edges.select(same.alias("same"), F.explode(ends).alias("community"))
        .groupBy("community")
        .agg(F.count_if("same").alias("intra_incidents"), F.count_if(~F.col("same")).alias("inter_incidents"))
    )
    touched = edges.select(F.explode(F.array("src", "dst")).alias("user_id")).distinct().withColumn("touched", F.lit(True))
    nodes = (
        users.join(touched, "user_id", "left")
        .groupBy("community")
        .agg(F.count(F.lit(1)).alias("nodes"), F.count_if(F.col("touched").isNull()).alias("isolated_nodes"))
    )
    return nodes.join(incidents, "community", "left").select(
        "community",
        "nodes",
        F.coalesce("intra_incidents", F.lit(0)).alias("intra_incidents"),
        F.coalesce("inter_incidents", F.lit(0)).alias("inter_incidents"),
        "isolated_nodes",
    )


def isolated_nodes(arcs: DataFrame, users: DataFrame) -> DataFrame:
    touched = both_ways(contact_edges(arcs)).select("user_id").distinct()
    return users.join(touched, "user_id", "left_anti")


def degree_split(arcs: DataFrame, users: DataFrame) -> DataFrame:
    """Total, intra and inter degree of every user."""
    edges = label_edges(contact_edges(arcs), users)
    same = (F.col("src_community") == F.col("dst_community")).alias("same")
    ends = edges.select(same, F.explode(F.array("src", "dst")).alias("user_id"))
    per = ends.groupBy("user_id").agg(F.count(F.lit(1)).alias("total_degree"), F.count_if("same").alias("intra_degree"))
    zero = F.lit(0)
    return users.select("user_id").join(per, "user_id", "left").select(
        "user_id",
        F.coalesce("total_degree", zero).alias("total_degree"),
        F.coalesce("intra_degree", zero).alias("intra_degree"),
        (F.coalesce("total_degree", zero) - F.coalesce("intra_degree", zero)).alias("inter_degree"),
    )


def labelled_contacts(arcs: DataFrame, users: DataFrame) -> DataFrame:
    """(user_id, neighbor_id, same) in both directions."""
    edges = label_edges(contact_edges(arcs), users)
    same = F.col("src_community") == F.col("dst_community")
    pairs = F.array(
        F.struct(F.col("src").alias("user_id"), F.col("dst").alias("neighbor_id"), same.alias("same")),
        F.struct(F.col("dst").alias("user_id"), F.col("src").alias("neighbor_id"), same.alias("same")),
    )
    return edges.select(F.inline(pairs))


def adoption_summary(adopted: DataFrame, users: DataFrame, root_community: DataFrame) -> DataFrame:
    """Per root: adopters, fraction, intra/inter adoptions, community coverage, generations."""
    total = users.agg(F.count(F.lit(1)).alias("n")).scalar()
    communities = users.agg(F.countDistinct("community").alias("n")).scalar()
    rows = lookup(adopted, users, "user_id", "left")
    rows = lookup(rows, root_community, "root_post_id", "left")
    return rows.groupBy("root_post_id").agg(
        F.count(F.lit(1)).alias("final_adopters"),
        F.count_if(F.col("community") == F.col("root_community")).alias("intra_adoptions"),
        F.count_if(F.col("community") != F.col("root_community")).alias("inter_adoptions"),
        F.countDistinct("community").alias("communities"),
        F.countDistinct(F.when(F.col("round") > 0, F.col("round"))).alias("generations"),
    ).select(
        "root_post_id",
        "final_adopters",
        (F.col("final_adopters") / total).alias("final_fraction"),
        "intra_adoptions",
        "inter_adoptions",
        (F.col("communities") / communities).alias("coverage"),
        "generations",
    )


def round_counts(adopted: DataFrame) -> DataFrame:
    """Per root and round: new and total adopters (few rounds per root)."""
    new = adopted.groupBy("root_post_id", "round").agg(F.count(F.lit(1)).alias("new_adopters"))
    upto: Column = F.sum("new_adopters").over(
        W.partitionBy("root_post_id").orderBy("round").rowsBetween(W.unboundedPreceding, 0)
    )
    return new.withColumn("total_adopters", upto)


def predicted_against_observed(predicted: DataFrame, observed: DataFrame) -> DataFrame:
    """Per root: adopters the rounds predict beyond round 0, adopters the log has, and those in both.

    ``predicted``: user_id, root_post_id, round. ``observed``: user_id, root_post_id. Adopters of
    round 0 are what the prediction starts from and count on neither side.
    """
    keys = ["root_post_id", "user_id"]
    a = predicted.select(*keys, F.col("round").alias("r"))
    b = observed.select(*keys).distinct().withColumn("o", F.lit(True))
    later = a.join(b, keys, "full").where("coalesce(r, 1) > 0")
    return later.groupBy("root_post_id").agg(F.count("r").alias("predicted"), F.count("o").alias("observed"), F.count_if(F.col("r").isNotNull() & F.col("o").isNotNull()).alias("both"))
