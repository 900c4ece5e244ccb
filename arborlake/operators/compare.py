"""Agreement of labellings, neuron sets and memberships."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from .clustering import Tree, labels_for_ks


def contingency(rows: DataFrame, a: str = "a", b: str = "b", by: Sequence[str] = ()) -> DataFrame:
    return rows.groupBy(*by, a, b).agg(F.count(F.lit(1)).alias("n"))


def _pairs(c: Column) -> Column:
    return c * (c - 1) / F.lit(2.0)


def agreement(table: DataFrame, a: str = "a", b: str = "b", by: Sequence[str] = ()) -> DataFrame:
    """Adjusted Rand index and normalised mutual information (arithmetic mean) of contingency rows.

    Only label pairs and labels pass through, never members.
    """
    n = F.col("n").cast("double")
    marginal = lambda label, name: table.groupBy(*by, label).agg(F.sum(n).alias("m")).groupBy(*by).agg(
        F.sum(_pairs(F.col("m"))).alias(f"p{name}"), F.sum(F.col("m") * F.log("m")).alias(f"l{name}"), F.count(F.lit(1)).alias(f"k{name}"))
    cells = table.groupBy(*by).agg(F.sum(n).alias("t"), F.sum(_pairs(n)).alias("pij"), F.sum(n * F.log(n)).alias("lij"))
    if by:
        rows = cells.join(marginal(a, "a"), list(by)).join(marginal(b, "b"), list(by))
    else:
        pick = lambda frame, name: frame.select(name).scalar()
        ma, mb = marginal(a, "a"), marginal(b, "b")
        rows = cells.withColumns({**{c: pick(ma, c) for c in ("pa", "la", "ka")}, **{c: pick(mb, c) for c in ("pb", "lb", "kb")}})
    t = F.col("t")
    expected = F.col("pa") * F.col("pb") / F.nullif(_pairs(t), F.lit(0.0))
    ceiling = (F.col("pa") + F.col("pb")) / 2
    same = (F.col("pij") == F.col("pa")) & (F.col("pij") == F.col("pb"))
    ari = F.when(same, 1.0).otherwise(F.try_divide(F.col("pij") - expected, F.nullif(ceiling - expected, F.lit(0.0))))
    entropy = lambda c: F.log(t) - F.col(c) / t
    mutual = (F.col("lij") - F.col("la") - F.col("lb")) / t + F.log(t)
    mean = (entropy("la") + entropy("lb")) / 2
    nmi = F.when((F.col("ka") == 1) & (F.col("kb") == 1), 1.0).when(mutual <= 1e-12, 0.0).otherwise(F.try_divide(mutual, F.nullif(mean, F.lit(0.0))))
    return rows.select(*by, t.cast("long").alias("jointly_assigned"), ari.alias("ari"), nmi.alias("nmi")).filter("jointly_assigned IS NOT NULL")


def compare_partitions(first: Tree, second: Tree, ks: Sequence[int] = range(2, 21)) -> DataFrame:
    """(k, ari, nmi) of both trees cut into at most k clusters."""
    ks = list(ks)
    a = labels_for_ks(first, ks).withColumnRenamed("label", "a")
    b = labels_for_ks(second, ks).withColumnRenamed("label", "b")
    table = contingency(a.join(b, ["k", "file_id"]), by=["k"])
    return agreement(table, by=["k"]).select("k", "ari", "nmi")


def _joint(reference: DataFrame, candidate: DataFrame) -> DataFrame:
    return reference.select("file_id", F.col("label").alias("a")).join(candidate.select("file_id", F.col("label").alias("b")), "file_id")


def cohort_counts(reference: DataFrame, candidate: DataFrame, reference_cohort: DataFrame, candidate_cohort: DataFrame) -> DataFrame:
    """One row: cohort overlap and who is assigned where. A cohort includes everything assigned."""
    flag = lambda df, name: df.select("file_id").distinct().withColumn(name, F.lit(True))
    of = lambda cohort, labels, name: flag(cohort.select("file_id").unionByName(labels.select("file_id")), name)
    rows = of(reference_cohort, reference, "rc").join(of(candidate_cohort, candidate, "cc"), "file_id", "full_outer")
    rows = rows.join(flag(reference, "ra"), "file_id", "left").join(flag(candidate, "ca"), "file_id", "left")
    rows = rows.na.fill(False, ["rc", "cc", "ra", "ca"])
    rc, cc, ra, ca = (F.col(c) for c in ("rc", "cc", "ra", "ca"))
    both = rc & cc
    return rows.agg(
        F.count_if(rc).alias("reference_cohort"), F.count_if(cc).alias("candidate_cohort"), F.count_if(both).alias("shared_cohort"),
        F.count_if(rc & ~cc).alias("reference_cohort_only"), F.count_if(cc & ~rc).alias("candidate_cohort_only"),
        F.count_if(both & ra & ca).alias("assigned_in_both"), F.count_if(both & ra & ~ca).alias("reference_assigned_only"),
        F.count_if(both & ca & ~ra).alias("candidate_assigned_only"), F.count_if(both & ~ra & ~ca).alias("unassigned_in_both"),
    )


def _shared(labels: DataFrame, own: DataFrame, other: DataFrame, other_labels: DataFrame) -> DataFrame:
    """Labels of files in both cohorts."""
    ids = other.select("file_id").unionByName(other_labels.select("file_id")).distinct()
    return labels.join(ids, "file_id", "left_semi")


def cluster_matches(reference: DataFrame, candidate: DataFrame, reference_cohort: DataFrame, candidate_cohort: DataFrame) -> DataFrame:
    """Mutual-best pairs of labels with sizes and Jaccard, and the labels left over.

    A label's best partner has the largest overlap, the smaller label on a tie. Sizes count the shared cohort.
    """
    a = _shared(reference, reference_cohort, candidate_cohort, candidate)
    b = _shared(candidate, candidate_cohort, reference_cohort, reference)
    table = contingency(_joint(a, b))
    best = lambda own, other: table.groupBy(own).agg(F.max(F.struct("n", (-F.col(other)).alias("m"))).alias("v")).select(
        own, (-F.col("v.m")).alias(other), F.col("v.n").alias("n"))
    mutual = best("a", "b").join(best("b", "a").select("a", "b"), ["a", "b"])
    sizes = lambda rows, name: rows.groupBy(F.col("label").alias(name)).agg(F.count(F.lit(1)).alias(f"size_{name}"))
    rows = sizes(a, "a").join(mutual, "a", "left").join(sizes(b, "b"), "b", "full_outer")
    shared = F.coalesce("n", F.lit(0))
    size_a, size_b = F.coalesce("size_a", F.lit(0)), F.coalesce("size_b", F.lit(0))
    union = size_a + size_b - shared
    return rows.select(
        F.col("a").alias("reference_label"), F.col("b").alias("candidate_label"), shared.alias("intersection"),
        size_a.alias("reference_size"), size_b.alias("candidate_size"), union.alias("union"),
        F.try_divide(shared.cast("double"), union).alias("jaccard"),
    )


def compare_memberships(reference: DataFrame, candidate: DataFrame, reference_cohort: DataFrame, candidate_cohort: DataFrame) -> DataFrame:
    """One row: cohort counts, ARI, NMI and the share of jointly assigned files in mutual-best pairs."""
    table = contingency(_joint(reference, candidate))
    scores = agreement(table)
    paired = cluster_matches(reference, candidate, reference_cohort, candidate_cohort).agg(
        F.coalesce(F.sum("intersection"), F.lit(0)).alias("m"))
    one = lambda frame, name: frame.select(name).scalar()
    row = cohort_counts(reference, candidate, reference_cohort, candidate_cohort).withColumns({
        "ari": one(scores, "ari"), "nmi": one(scores, "nmi"), "matched_file_ids": one(paired, "m"),
    })
    return row.withColumns({
        "mutual_agreement": F.try_divide(F.col("matched_file_ids").cast("double"), F.nullif(F.col("assigned_in_both"), F.lit(0))),
        "status": F.when(F.col("assigned_in_both") > 0, "ok").otherwise("no_joint_assignments"),
    })


def match_labels(reference: DataFrame, candidate: DataFrame) -> DataFrame:
    """(candidate_label, reference_label, shared_file_ids, candidate_shared_cohort) per candidate label."""
    matches = cluster_matches(reference, candidate, reference, candidate)
    return matches.filter("candidate_label IS NOT NULL").select(
        "candidate_label", "reference_label", F.col("intersection").alias("shared_file_ids"),
        F.col("candidate_size").alias("candidate_shared_cohort"),
    )


def compare_runs(before: DataFrame, after: DataFrame) -> DataFrame:
    """One row: how far an exported run moved. Unlike labels of mutual-best pairs, everything else counts as moved."""
    table = contingency(_joint(before, after))
    scores = agreement(table)
    kept = cluster_matches(before, after, before, after).agg(F.coalesce(F.sum("intersection"), F.lit(0)).alias("m"))
    raw = table.agg(F.coalesce(F.sum(F.when(F.col("a") != F.col("b"), F.col("n"))), F.lit(0)).alias("r"))
    rows = scores.withColumns({"kept": kept.select("m").scalar(), "raw_changed": raw.select("r").scalar()})
    total = F.col("jointly_assigned")
    return rows.select(
        total.alias("total"), (total - F.col("kept")).alias("moved"),
        (F.lit(1.0) - F.try_divide(F.col("kept").cast("double"), total)).alias("changed_fraction"), "raw_changed", "ari",
    )


# --- set overlap

def overlap(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Sizes and overlap measures of two key sets; an empty denominator gives null."""
    left = a.select(*keys).distinct().withColumn("_a", F.lit(1))
    right = b.select(*keys).distinct().withColumn("_b", F.lit(1))
    rows = left.join(right, list(keys), "full_outer")
    ina, inb = F.col("_a").isNotNull(), F.col("_b").isNotNull()
    counted = rows.agg(
        F.count("_a").alias("a"), F.count("_b").alias("b"), F.count_if(ina & inb).alias("intersection"),
        F.count(F.lit(1)).alias("union"), F.count_if(ina & ~inb).alias("a_only"), F.count_if(inb & ~ina).alias("b_only"),
    )
    shared = F.col("intersection").cast("double")
    return counted.withColumns({
        "jaccard": F.try_divide(shared, F.col("union")), "dice": F.try_divide(2 * shared, F.col("a") + F.col("b")),
        "fraction_a": F.try_divide(shared, F.col("a")), "fraction_b": F.try_divide(shared, F.col("b")),
    })


def membership_overlap(a: DataFrame, b: DataFrame) -> DataFrame:
    return overlap(a, b, ["file_id"])


def mask_overlap(a: DataFrame, b: DataFrame) -> DataFrame:
    return overlap(a, b, ["ai", "bi", "ci"])


def shared_maxima(entries: DataFrame) -> DataFrame:
    """One maximum per group of comparable entries (key, observed, override); overridden ones do not count."""
    v = F.col("observed").cast("double")
    usable = F.col("key").isNotNull() & F.col("override").isNull() & v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf")))
    return entries.filter(usable).groupBy("key").agg(F.greatest(F.max(v), F.lit(0.0)).alias("maximum"))
