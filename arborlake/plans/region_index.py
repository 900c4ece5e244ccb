"""A bitmap index of the regional profile: Boolean region queries as bit operations.

Files get ordinals; a word of the index holds one bit for each of 64 files. Per (region, side, compartment) the index has the files that
are present, for regions as they are recorded and rolled up to every region above, so a selection with its descendants is
one key and no distinct count follows a join with the hierarchy. AND, OR and NOT of conditions are the same operations
on words. Thresholds need sums, which the index keeps per region and ordinal.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.ranks import number_rows
from ..session import keep_keys, lookup_join, settle
from .region_query import COMPARISONS, EITHER, MEASURES, AllOf, AnyOf, Not, SomaIn, Threshold, conditions

WORD = 64
BITS = "region_id int, rolled boolean, laterality string, compartment string, word long, bits long"
SUMS = "region_id int, rolled boolean, laterality string, compartment string, ordinal long, cable_length_um double, node_count long, terminus_count long"
BELOW = "region_id int, below array<int>"
FILES = "word long, all_bits long, names array<string>"


def _bit(ordinal: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(ordinal, F.lit(WORD)).cast("int"))


def _word(ordinal: Column) -> Column:
    return F.floor(ordinal / WORD)


@dataclass(frozen=True)
class RegionIndex:
    """``below`` has the regions of the hierarchy with their descendants, whose number is bounded by the ontology."""

    bits: DataFrame
    sums: DataFrame
    files: DataFrame
    below: dict[int, frozenset[int]]

    def write(self, path: str, mode: str = "error") -> None:
        for name in ("bits", "sums", "files"):
            getattr(self, name).write.mode(mode).parquet(f"{path}/{name}")
        rows = [(k, sorted(v)) for k, v in sorted(self.below.items())]
        self.bits.sparkSession.createDataFrame(rows, BELOW).coalesce(1).write.mode(mode).parquet(f"{path}/below")


def open_index(spark: SparkSession, path: str) -> RegionIndex:
    bits, sums, files = (spark.read.schema(kind).parquet(f"{path}/{name}") for name, kind in (("bits", BITS), ("sums", SUMS), ("files", FILES)))
    return RegionIndex(bits, sums, files, {r[0]: frozenset(r[1]) for r in spark.read.schema(BELOW).parquet(f"{path}/below").collect()})


def build_index(profile: DataFrame, closure: DataFrame) -> RegionIndex:
    """The index of a profile; regions outside the hierarchy, such as 0, are kept as recorded."""
    ordinals = settle(number_rows(profile.select("file_id").distinct(), ["file_id"], "ordinal"))
    named = F.struct(F.pmod("ordinal", F.lit(WORD)).alias("at"), "file_id")
    files = ordinals.groupBy(_word(F.col("ordinal")).alias("word")).agg(F.bit_or(_bit(F.col("ordinal"))).alias("all_bits"), F.sort_array(F.collect_list(named)).alias("n"))
    files = settle(files.select("word", "all_bits", F.col("n.file_id").alias("names")))
    rows = lookup_join(profile, ordinals, "file_id", salt_by=["region_id", "laterality"])
    rows = settle(rows.groupBy("region_id", "laterality", "compartment", "ordinal").agg(*[F.sum(m).alias(m) for m in MEASURES]))
    above = closure.select("ancestor_region_id", F.col("direct_region_id").alias("region_id")).distinct()
    up = lookup_join(rows, above.groupBy("region_id").agg(F.collect_set("ancestor_region_id").alias("above")), "region_id", salt_by=["ordinal"])
    up = up.withColumn("region_id", F.explode("above")).groupBy("region_id", "laterality", "compartment", "ordinal").agg(*[F.sum(m).alias(m) for m in MEASURES])
    keys = ["region_id", "rolled", "laterality", "compartment"]
    sums = rows.withColumn("rolled", F.lit(False)).unionByName(up.withColumn("rolled", F.lit(True))).select(*keys, "ordinal", *MEASURES)
    # rows of a key lie side by side, so a query reads the row groups of its regions
    sums = settle(sums.repartitionByRange(*keys, "ordinal").sortWithinPartitions(*keys, "ordinal"))
    present = (F.col("node_count") > 0) | ((F.col("compartment") == "neurite") & (F.col("cable_length_um") > 0))
    bits = sums.filter(present).groupBy(*keys, _word(F.col("ordinal")).alias("word")).agg(F.bit_or(_bit(F.col("ordinal"))).alias("bits"))
    bits = settle(bits.repartitionByRange(*keys, "word").sortWithinPartitions(*keys, "word"))
    below = closure.groupBy("ancestor_region_id").agg(F.collect_set("direct_region_id")).collect()
    return RegionIndex(bits, sums, files, {r[0]: frozenset(r[1]) for r in below})


def _keyed(index: RegionIndex, condition) -> Column:
    """Index rows a condition looks at.

    One region with its descendants is read rolled up. Of several, those below another are left out: its rows hold theirs.
    """
    compartment = "soma" if isinstance(condition, SomaIn) else getattr(condition, "compartment", "neurite")
    ids, rolled = condition.regions.ids, condition.regions.descendants
    if rolled:
        ids = [i for i in ids if not any(i in index.below[o] for o in ids if o != i)]
    test = (F.col("compartment") == compartment) & (F.col("rolled") == rolled) & F.col("region_id").isin(list(ids))
    side = getattr(condition, "laterality", EITHER)
    return test if side == EITHER else test & (F.col("laterality") == side)


def _combine(tree, leaves: dict[str, Column], path: str = "query") -> Column:
    if isinstance(tree, Not):
        return F.bitwise_not(_combine(tree.child, leaves, f"{path}.child"))
    if isinstance(tree, (AllOf, AnyOf)):
        out = None
        for i, child in enumerate(tree.children):
            part = _combine(child, leaves, f"{path}.children[{i}]")
            out = part if out is None else (out.bitwiseAND(part) if isinstance(tree, AllOf) else out.bitwiseOR(part))
        return out
    return leaves[path]


def _threshold_words(index: RegionIndex, condition: Threshold, number: int) -> tuple[DataFrame, bool]:
    """Words of the files that meet a threshold, or of those that don't where a file without rows, a sum of 0, meets it."""
    rows = index.sums.filter(_keyed(index, condition))
    totals = rows.groupBy("ordinal").agg(F.sum(condition.measure).alias("total"))
    meets = COMPARISONS[condition.comparison](F.col("total"), F.lit(condition.value))
    of_none = COMPARISONS[condition.comparison](0, condition.value)
    hits = totals.filter(~meets if of_none else meets)
    words = hits.groupBy(_word(F.col("ordinal")).alias("word")).agg(F.bit_or(_bit(F.col("ordinal"))).alias("bits"))
    return words.select("word", F.lit(number).alias("leaf"), "bits"), of_none


def index_words(index: RegionIndex, tree) -> DataFrame:
    """(word, bits, names): the words of files that satisfy the tree."""
    leaves = conditions(tree)
    unknown = sorted({i for _, c in leaves for i in c.regions.ids} - set(index.below))
    if unknown:
        raise ValueError(f"unknown regions {unknown}")
    present = [(number, path, c) for number, (path, c) in enumerate(leaves) if not isinstance(c, Threshold)]
    found, inverted = None, set()
    if present:
        wanted = F.lit(False)
        cases = []
        for number, _, c in present:
            wanted = wanted | _keyed(index, c)
            cases.append(F.bit_or(F.when(_keyed(index, c), F.col("bits")).otherwise(F.lit(0).cast("long"))).alias(f"_c{number}"))
        found = index.bits.filter(wanted).groupBy("word").agg(*cases)
    for number, (path, c) in enumerate(leaves):
        if isinstance(c, Threshold):
            words, of_none = _threshold_words(index, c, number)
            words = words.select("word", F.col("bits").alias(f"_c{number}"))
            inverted |= {number} if of_none else set()
            found = words if found is None else found.join(words, "word", "full")
    rows = index.files.join(found, "word", "left")
    columns = {}
    for number, (path, _) in enumerate(leaves):
        bits = F.coalesce(F.col(f"_c{number}"), F.lit(0).cast("long"))
        columns[path] = F.bitwise_not(bits) if number in inverted else bits
    hits = _combine(tree, columns).bitwiseAND(F.col("all_bits"))
    return rows.select("word", hits.alias("bits"), "names").filter("bits <> 0")


def indexed_files(index: RegionIndex, tree, scope=None) -> DataFrame:
    """The file_ids of ``matching_files``, from the index."""
    rows = index_words(index, tree).select("bits", F.posexplode("names").alias("at", "file_id"))
    hits = rows.filter(F.call_function("shiftright", F.col("bits"), F.col("at")).bitwiseAND(F.lit(1).cast("long")) == 1).select("file_id")
    return hits if scope is None else keep_keys(hits, scope)


def neurons_present(index: RegionIndex, split: bool = False, cohort: DataFrame | None = None) -> DataFrame:
    """(region_id, laterality, is_aggregate, neurons_present): files with a neurite per region, counted as bits.

    ``is_aggregate`` rows are regions with their descendants. ``cohort`` is a list of files that count.
    """
    side = F.col("laterality") if split else F.lit("combined")
    rows = index.bits.filter("compartment = 'neurite'").groupBy("region_id", F.col("rolled").alias("is_aggregate"), side.alias("laterality"), "word").agg(F.bit_or("bits").alias("bits"))
    if cohort is not None:
        ordinals = index.files.select("word", F.posexplode("names").alias("at", "file_id"))
        chosen = keep_keys(ordinals, cohort).groupBy("word").agg(F.bit_or(_bit(F.col("at").cast("long"))).alias("chosen"))
        rows = lookup_join(rows, chosen, "word", salt_by=["region_id"]).withColumn("bits", F.col("bits").bitwiseAND(F.col("chosen")))
    counted = rows.groupBy("region_id", "laterality", "is_aggregate").agg(F.sum(F.bit_count("bits")).alias("neurons_present"))
    return counted.filter("neurons_present > 0")
