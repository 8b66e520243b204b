"""Exact deduplication by a log-structured merge index of digests. DataFrame operations only.

An ingest flushes its memtables, one a task, as a run of entries (digest, probe, id, count) sorted
by digest. Each run has a bit filter, built when it is first asked for; a batch that is looked up
reads the runs alone whose filter passes one of its digests. Compaction merges the runs of a size
tier, and at the end all of them, into a run with one entry a digest: the surviving identifier
and a count. Spark merges by a hash aggregation and sorts what it writes; it cannot zip sorted
files. Documents whose digest occurs more than once are hits, picked by a filter; their bytes are
compared (grouping by the text itself) before they count as equal, so a digest collision cannot
drop a document.
"""

from __future__ import annotations

from collections import Counter
from functools import cached_property, reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.llm.storage import BitFilter, fresh_name, without_keys, written

#: Runs of a size tier that are merged; a tier's runs are up to TIER_RUNS times those of the one below.
TIER_RUNS = 4


class Run:
    """A sorted run (digest, probe, id, count). ``reads`` counts how often its entries were asked for."""

    def __init__(self, entries: DataFrame):
        self._entries, self.reads = entries, 0
        self.rows = entries.count()

    @property
    def tier(self) -> int:
        return max(0, self.rows.bit_length() - 1) // (TIER_RUNS.bit_length() - 1)

    @property
    def entries(self) -> DataFrame:
        self.reads += 1
        return self._entries

    @cached_property
    def filter(self) -> BitFilter:
        return BitFilter.of(self._entries, "digest", "lsm-filter")


class DigestIndex:
    """LSM index over texts. ``keep`` is "largest" or "smallest": which id of equal texts stays."""

    def __init__(self, spark: SparkSession, keep: str = "largest"):
        if keep not in ("largest", "smallest"):
            raise ValueError("keep is 'largest' or 'smallest'")
        self.spark, self.pick = spark, F.max if keep == "largest" else F.min
        self.runs: list[Run] = []
        self.flushed: list[DataFrame] = []  # the rows of every ingest, which answers need
        self.sources: list[DataFrame] = []

    @staticmethod
    def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
        text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
        return docs.select(F.col(id_col).alias("id"), text.alias("text")).select(
            "id", F.unhex(F.sha2("text", 256)).alias("digest"), F.xxhash64("text").alias("probe"), "text"
        )

    def ingest(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> None:
        """Flush one sorted run; null texts count as empty, ids may repeat or be null. A full size tier
        is compacted."""
        keyed = self._keyed(docs, id_col, text_col)
        flushed = written(keyed.select("id", "digest", "probe").sortWithinPartitions("digest"), "lsm-run")
        self.sources.append(keyed)
        self.flushed.append(flushed)
        self.runs.append(Run(flushed.select("digest", "probe", "id", F.lit(1).cast("long").alias("count"))))
        while full := [t for t, n in Counter(r.tier for r in self.runs).items() if n >= TIER_RUNS]:
            merged = self._merge([r for r in self.runs if r.tier == min(full)])
            self.runs = [r for r in self.runs if r.tier != min(full)] + [merged]

    def _merge(self, runs: list[Run]) -> Run:
        """One entry for each digest of the runs, sorted by digest in every file."""
        rows = reduce(DataFrame.unionByName, [r.entries for r in runs])
        level = rows.groupBy("digest", "probe").agg(self.pick("id").alias("id"), F.sum("count").alias("count"))
        return Run(written(level.sortWithinPartitions("digest"), "lsm-level"))

    def lookup(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """Rows (id, found) of the documents whose text is in the index: found is the id that stays
        there. Only runs whose filter passes a digest are read; bytes are compared."""
        keyed = written(self._keyed(docs, id_col, text_col).select("id", "digest", "probe"), "lsm-asked")
        hits = None
        for run in self.runs:
            maybe = run.filter.maybe(keyed, F.col("digest"))
            if not maybe.isEmpty():
                part = maybe.join(run.entries.withColumnRenamed("id", "found"), ["digest", "probe"]).select("id", "digest", "probe", "found")
                hits = part if hits is None else hits.unionByName(part)
        if hits is None:
            return keyed.select("id", F.col("id").alias("found")).limit(0)
        found = written(hits.groupBy("id", "digest", "probe").agg(self.pick("found").alias("found")), "lsm-hits")
        wanted = BitFilter.of(found, "digest", "lsm-filter")
        stored = reduce(DataFrame.unionByName, [wanted.maybe(k, F.col("digest")) for k in self.sources]).select("digest", "probe", F.col("text").alias("stored")).distinct()
        asked = wanted.maybe(self._keyed(docs, id_col, text_col), F.col("digest")).select("digest", "probe", "text").distinct()
        wrong = stored.join(asked, ["digest", "probe"]).where("stored <> text").count()
        self._check(wrong)
        return found.select("id", "found")

    @staticmethod
    def _check(wrong: int) -> None:
        if wrong:
            raise RuntimeError(f"{wrong} digests with equal SHA-256 and xxhash64 have different bytes")

    def compact(self) -> DataFrame:
        """All runs merged: one row per distinct text (digest, probe, keep_id, group_size), byte-verified."""
        self.runs = [self._merge(self.runs)]
        merged = self.runs[0].entries.select("digest", "probe", F.col("id").alias("keep_id"), F.col("count").alias("group_size"))
        repeated = merged.where(F.col("group_size") > 1)
        bits = BitFilter.of(repeated, "digest", "lsm-filter")
        hits = reduce(DataFrame.unionByName, [bits.maybe(keyed, F.col("digest")) for keyed in self.sources])
        # Equal bytes meet in one group; map-side combination leaves one row per task of a hot text.
        same = hits.groupBy("digest", "probe", "text").agg(F.count("*").alias("n"))
        verified = same.groupBy("digest", "probe").agg(F.count("*").alias("texts"), F.sum("n").alias("n"))
        wrong = repeated.join(verified, ["digest", "probe"], "left").where((F.coalesce("texts", F.lit(0)) != 1) | (F.col("n") != F.col("group_size")))
        self._check(wrong.count())
        return merged

    def resolve(self) -> DataFrame:
        """One row per ingested row: id, keep_id, group_size, kept, text_sha256 (lowercase hex)."""
        level = self.compact()
        return reduce(DataFrame.unionByName, self.flushed).join(level, ["digest", "probe"]).select(
            "id", "keep_id", "group_size", F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256")
        )


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "largest") -> DataFrame:
    """Groups of byte-equal texts: id_col, keep_id, group_size, kept, text_sha256, a row per input row.

    Null text counts as the empty text. Ids are compared as they are; rows that repeat the kept
    id within a group are all marked kept (they cannot be told apart by id). A null id is kept
    only if no row of its group has an id. Empty input gives no rows. Other columns are ignored.
    """
    index = DigestIndex(docs.sparkSession, keep)
    index.ingest(docs, id_col, text_col)
    return index.resolve().withColumnRenamed("id", id_col)


def drop_exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "largest") -> DataFrame:
    """``docs`` without the copies, all columns kept; of rows equal in id and text one stays."""
    found = written(exact_dedup(docs, id_col, text_col, keep), "lsm-found")

    def key(sha: Column) -> Column:  # id and digest: an id may come with several texts
        return F.concat_ws("|", F.coalesce(F.col(id_col).cast("string"), F.lit("-")), sha)

    sha = F.sha2(F.coalesce(F.col(text_col).cast("string"), F.lit("")), 256)
    kept = without_keys(docs, key(sha), found.where("not kept").select(key(F.col("text_sha256"))), "lsm-gone")
    same, once = fresh_name(docs.columns, "__same"), fresh_name(docs.columns, "__once")
    repeated = found.where("kept and group_size > 1").groupBy(key(F.col("text_sha256")).alias(same)).count().where("count > 1").select(same)
    if repeated.isEmpty():
        return kept
    single = kept.withColumn(once, key(sha)).join(repeated, F.col(once) == F.col(same), "left_semi").dropDuplicates([once]).drop(once)
    return without_keys(kept, key(sha), repeated, "lsm-same").unionByName(single)
