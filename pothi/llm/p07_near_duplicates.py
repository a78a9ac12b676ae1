"""Near-duplicate records with small edits (problem 7).

Anchor covering: every record is replicated to a set of anchors chosen so that
any two records whose similarity reaches the threshold meet at one of them, and
records are compared per anchor. The anchors are shingles in one order for all
records; a record of n shingles goes to its first ``n - ceil(t n) + 5``. That
radius makes the cover complete: records with a Jaccard similarity of t or more
have an anchor in common. (A covering code over Hamming fingerprints can't do
this at t = 0.5: see the README.) Shingles come from rare to common by the number
of classes they stand in, counted in blocks of about half a million; those of one
class find nothing and don't leave their record. A table of constant size tells
shingles too common to be counted one by one: they come last, and where they are
anchors still, they are split into parts.

Exact copies of a shingle set are one class and are compared once. Anchors go to
blocks, about half a million a block whatever the data. A record goes to four anchors
more than one in common would take, so that two alike records share five; only
those standing early enough in both count, and only pairs with five have their
sets compared. Nothing is lost by it.

Defined results: null, empty and too short texts have no shingles and are in no
pair, each its own class in ``groups``; a key that occurs twice counts once (the
text of the least hash); rows without a key are left out; extra columns are
ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pothi.llm.runs import anchored, frequencies, loads, meetings, run_sets
from pothi.plans.lineage import cut

BUCKETS, HOT, EACH = 1 << 17, 2000, 1 << 19


class NearDuplicates:
    def __init__(self, df: DataFrame, key: str, text: str, shingle: int, threshold: float, buckets: int = BUCKETS, hot: int = HOT, each: int = EACH):
        named = df.select(F.col(key).cast("string").alias("key"), F.col(text).alias("text")).where("key IS NOT NULL")
        alone = F.size("runs") == 0
        cls = F.when(alone, F.xxhash64("key", F.lit("alone"))).otherwise(F.xxhash64("runs"))
        self._keyed = cut(run_sets(named, shingle).select("key", "digest", cls.alias("cls"), "runs"))
        #: key, cls, alone: the class of equal shingle sets, named by a hash of the set.
        self.members = self._keyed.groupBy("key").agg(F.min(F.struct("digest", "cls", alone.alias("alone"))).alias("r")).select("key", "r.cls", "r.alone")
        self.threshold, self.buckets, self.hot, self.each = threshold, buckets, hot, each

    def class_pairs(self) -> DataFrame:
        """a, b, shared, either: classes with a Jaccard similarity of the threshold or more; a < b."""
        t = self.threshold
        filled = self._keyed.where(F.size("runs") > 0).select("cls", "runs")
        # Copies count for nothing in what is common: loads are of classes.
        sets = cut(filled.groupBy("cls").agg(F.first("runs").alias("runs")))
        load = loads(sets, self.buckets)
        counts = frequencies(sets, load, self.hot, self.each).groupBy("cls").agg(F.array_sort(F.collect_list(F.struct("block", "counts"))).alias("c"))
        counted = sets.join(counts.select("cls", F.array_join(F.transform("c", lambda x: F.hex(x["counts"])), "").alias("c")), "cls", "left").select("cls", "runs", F.unhex(F.coalesce("c", F.lit(""))).alias("counts"))
        met = meetings(anchored(counted, load, t, self.hot, self.each), t)
        candidates = met.groupBy("a", "b").agg(F.sum("met").alias("met"), F.max("least").alias("least")).where("met >= least").select("a", "b")
        left, right = sets.select(F.col("cls").alias("a"), F.col("runs").alias("ra")), sets.select(F.col("cls").alias("b"), F.col("runs").alias("rb"))
        sized = candidates.join(left, "a").join(right, "b").select("a", "b", F.size(F.array_intersect("ra", "rb")).alias("shared"), (F.size("ra") + F.size("rb")).alias("total"))
        return sized.select("a", "b", "shared", (F.col("total") - F.col("shared")).alias("either")).where(F.col("shared") >= F.col("either") * t - 1e-9)

    def pairs(self) -> DataFrame:
        """key_a < key_b: all pairs, copies among them."""
        names = self.members.where(~F.col("alone")).select("key", "cls")
        a, b = names.select(F.col("key").alias("k1"), F.col("cls").alias("a")), names.select(F.col("key").alias("k2"), F.col("cls").alias("b"))
        across = self.class_pairs().join(a, "a").join(b, "b").select("k1", "k2")
        within = a.join(b, F.col("a") == F.col("b")).select("k1", "k2").where("k1 < k2")
        both = across.unionByName(within)
        return both.select(F.least("k1", "k2").alias("key_a"), F.greatest("k1", "k2").alias("key_b"))

    def groups(self) -> DataFrame:
        """key, class_id, group_id, n_links: one row per record; group_id is the least class of its component."""
        from pothi.llm.components import components

        links = cut(self.class_pairs().select("a", "b"))
        comp = components(links)
        degree = links.select(F.col("a").alias("cls")).unionByName(links.select(F.col("b").alias("cls"))).groupBy("cls").agg(F.count("*").alias("n"))
        size = self.members.groupBy("cls").agg(F.count("*").alias("copies"))
        return (
            self.members.select("key", "cls").join(size, "cls").join(degree, "cls", "left").join(comp, "cls", "left")
            .select("key", F.col("cls").alias("class_id"), F.coalesce("component", "cls").alias("group_id"), F.coalesce("n", F.lit(0)).alias("n_links"), "copies")
        )
