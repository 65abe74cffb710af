"""Problem 3: records that differ only in form, collapsed and counted in an incremental ledger.

The ledger keeps, by bucket of the canonical key, one row of counts for each record and one row for each entry it has
counted. A batch is reduced to its own keys, joined with the matching buckets only, and those buckets are written anew
beside the old ones: an interrupted update leaves the last version as it was.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Collection

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from phrasewerk.llm.common import has_word
from phrasewerk.sources.store import scratch_dir

#: Buckets of a ledger at least, and entries for each where the first batch is large; entries in a file of a bucket.
BUCKETS, BUCKET_ROWS, FILE_ROWS = 32, 1_000_000, 1_000_000
#: A record's entries are spread over SALTS in the last join from so many copies on and if it holds this share of all entries, so hot records are at most 1 / HOT_SHARE.
HOT_COPIES, HOT_SHARE, SALTS = 100_000, 1e-4, 64
_SEPARATORS = r"(?:(?![.,])[\s\x{1c}-\x{1f}\p{Z}\p{P}]|(?<!\p{Nd})[.,]|[.,](?!\p{Nd}))+"


def canonical_text(text: Column) -> Column:
    """Lower case; each run of whitespace and punctuation is one blank, none at the ends; a point or comma between digits stays. Null stays null."""
    folded = F.replace(F.lower(text), F.lit("ß"), F.lit("ss"))  # written SS in capitals
    return F.trim(F.regexp_replace(folded, "(?U)" + _SEPARATORS, " "))


def canonical_json(value: Column) -> Column:
    """A JSON object without blanks, its fields in order of name; null stays null, a broken one is kept as it is, trimmed."""
    return F.coalesce(F.to_json(F.try_parse_json(value)), F.trim(value))


def keyed(entries: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, key, entry_id, seen_at, phrase, process_name) of every entry that is a record.

    Rows without an entry_id, and phrases that are null or without letters and digits, are no records.
    """
    shape = F.to_json(F.struct(F.col("process_name").alias("a"), canonical_text(F.col("phrase")).alias("b"), canonical_json(F.col("metadata")).alias("c")))
    rows = entries.where(F.col("entry_id").isNotNull() & has_word(F.col("phrase")))
    rows = rows.select(F.unhex(F.md5(shape)).alias("key"), "entry_id", F.col("added_at").alias("seen_at"), "phrase", "process_name")
    return rows.select(F.pmod(F.xxhash64("key"), F.lit(buckets)).cast("int").alias("bucket"), "*")


COUNTS = "bucket int, key binary, n_copies long, first_entry long, earliest struct<seen_at:timestamp,entry_id:long,phrase:string,process_name:string>"
MEMBERS = "bucket int, key binary, entry_id long"


class Ledger:
    """Counts of copies under *root*, a folder all executors share.

    ``update`` takes a batch of entries (columns entry_id, process_name, phrase, metadata, added_at; others are
    ignored); an entry delivered again, in the same or a later batch, counts once. ``counts`` and ``members`` read
    the present state; both are empty before the first update.
    """

    def __init__(self, spark: SparkSession, root: str | None = None, buckets: int | None = None):
        self.spark, self.buckets = spark, buckets
        self.root = root or f"{scratch_dir(spark)}/ledger-{uuid.uuid4().hex}"
        self.parts: dict[str, dict[int, list[str]]] = {"counts": {}, "members": {}}
        self.version = 0
        self._load()

    def _load(self) -> None:
        """Takes up the last complete version, if there is one."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/manifest")
        fs = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if fs.exists(path):
            last = self.spark.read.schema("version int, buckets int, parts string").json(f"{self.root}/manifest").orderBy(F.desc("version")).first()
            if last:
                self.version, self.buckets = last.version, last.buckets
                self.parts = {t: {int(b): p for b, p in x.items()} for t, x in json.loads(last.parts).items()}

    def _read(self, kind: str, schema: str, touched: Collection[int] | None = None) -> DataFrame:
        paths = sorted({p for b, ps in self.parts[kind].items() if touched is None or b in touched for p in ps})
        if not paths:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*paths)

    def counts(self) -> DataFrame:
        """One row for each record: key, n_copies, first_entry (smallest entry_id), earliest (by added_at, then entry_id; a null time comes last)."""
        return self._read("counts", COUNTS)

    def members(self) -> DataFrame:
        """One row for each counted entry: bucket, key, entry_id."""
        return self._read("members", MEMBERS)

    def update(self, batch: DataFrame) -> None:
        """Adds *batch*; ties between representatives go to the smaller entry_id. Reads the buckets that the batch touches, no others."""
        home = f"{self.root}/v{self.version + 1}-{uuid.uuid4().hex[:8]}"
        if self.buckets is None:
            self.buckets = max(BUCKETS, -(-batch.count() // BUCKET_ROWS))
        rows = keyed(batch, self.buckets)
        late = F.coalesce("seen_at", F.lit("9999-01-01").cast("timestamp"))
        fresh = rows.groupBy("bucket", "key", "entry_id").agg(F.min(F.struct(late.alias("seen_at"), "entry_id", "phrase", "process_name")).alias("earliest"))
        fresh = self._kept(fresh, f"{home}/batch")
        if self.version:
            known = self._read("members", MEMBERS, self._sizes(fresh).keys())
            fresh = self._kept(fresh.join(known, ["bucket", "key", "entry_id"], "left_anti"), f"{home}/fresh")
        sizes = self._sizes(fresh)
        touched = set(sizes)
        new = fresh.groupBy("bucket", "key").agg(F.count("*").alias("n"), F.min("entry_id").alias("first"), F.min("earliest").alias("first_seen"))
        old = self._read("counts", COUNTS, touched)
        both = old.join(new, ["bucket", "key"], "full_outer").select(
            "bucket", "key",
            (F.coalesce("n_copies", F.lit(0)) + F.coalesce("n", F.lit(0))).alias("n_copies"),
            F.least("first_entry", "first").alias("first_entry"),
            F.least("earliest", "first_seen").alias("earliest"),
        )
        both.repartition("bucket").withColumn("part", F.col("bucket")).write.partitionBy("part").parquet(f"{home}/counts")
        files = self.spark.createDataFrame([(b, -(-n // FILE_ROWS)) for b, n in sizes.items()], "bucket int, files long")
        spread = fresh.select("bucket", "key", "entry_id").join(F.broadcast(files), "bucket")  # one row for each bucket
        spread = spread.repartition("bucket", F.pmod(F.xxhash64("entry_id"), F.col("files"))).drop("files")
        spread.withColumn("part", F.col("bucket")).write.partitionBy("part").parquet(f"{home}/members")
        for b in touched:
            self.parts["counts"][b] = [f"{home}/counts/part={b}"]
            self.parts["members"][b] = [*self.parts["members"].get(b, []), f"{home}/members/part={b}"]
        self.version += 1
        state = self.spark.createDataFrame([(self.version, self.buckets, json.dumps(self.parts))], "version int, buckets int, parts string")
        state.coalesce(1).write.mode("append").json(f"{self.root}/manifest")

    def _kept(self, rows: DataFrame, path: str) -> DataFrame:
        rows.write.parquet(path)
        return self.spark.read.schema(rows.schema).parquet(path)

    def _sizes(self, rows: DataFrame) -> dict[int, int]:
        """The rows of each bucket: at most self.buckets numbers."""
        return {r.bucket: r["count"] for r in rows.groupBy("bucket").count().collect()}

    def copies(self) -> DataFrame:
        """(first_entry, entry_id): every further entry of a record beside its smallest one.

        Entries of hot records meet their record in SALTS parts: such records are at most 1 / HOT_SHARE, so their
        keys are broadcast.
        """
        many = self.counts().where("n_copies > 1").select("bucket", "key", "first_entry", "n_copies")
        least = max(HOT_COPIES, int((self.counts().agg(F.sum("n_copies")).first()[0] or 0) * HOT_SHARE))
        hot = many.where(F.col("n_copies") >= least).select("key", F.lit(True).alias("is_hot"))
        members = self.members().join(F.broadcast(hot), "key", "left")
        members = members.withColumn("salt", F.when(F.col("is_hot"), F.pmod(F.xxhash64("entry_id"), F.lit(SALTS)).cast("int")).otherwise(0))
        salts = F.when(F.col("n_copies") >= least, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
        firsts = many.select("key", "first_entry", F.explode(salts).alias("salt"))
        return members.join(firsts, ["key", "salt"]).where("entry_id <> first_entry").select("first_entry", "entry_id")


def ledger_of(entries: DataFrame, batches: int = 2) -> Ledger:
    """A new ledger that took *entries* in batches of equal spans of added_at, the earliest first; rows without a time go with the first."""
    ledger = Ledger(entries.sparkSession)
    cols = entries.select("entry_id", "process_name", "phrase", "metadata", "added_at")
    ends = cols.agg(F.min("added_at").cast("double").alias("a"), F.max("added_at").cast("double").alias("b")).first()
    if ends.a is None or batches < 2:
        ledger.update(cols)
        return ledger
    at = F.floor((F.col("added_at").cast("double") - ends.a) / max(ends.b - ends.a, 1e-6) * batches)
    nr = F.coalesce(F.least(at, F.lit(batches - 1)), F.lit(0))
    for k in range(batches):
        ledger.update(cols.where(nr == k))
    return ledger
