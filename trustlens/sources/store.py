"""A versioned store of the three input tables and of what is derived from them.

Below one shared folder:

- ``batches/<folder>/<table>``: the rows of one append, never changed once written, range-clustered by
  business (reviews by business and time, replies by the business of their review, which is added to them),
  with ``batches/<folder>/index/<table>``, one row per file (see ``file_index``);
- ``derived/<folder>/<name>``: states and models that a refresh wrote;
- ``manifest``: the commits. A commit is one Parquet file with the entries that it adds, put in place by
  a single rename, so a version is there as a whole or not at all.

**Versions.** Version v is the manifest's entries up to v. Readers name a version, or take the latest and
stay with it; nothing they read is ever overwritten. A writer that fails leaves folders that no
version names, and the rerun writes new ones. There may be many readers and one writer at a time.

**Ledger.** A batch carries an id. An id that the manifest knows is not written again, and rows whose
primary key is stored already are left out of a new batch, so a rerun, whole or in part, leaves the tables
as they are. Of the stored tables only the id column is read for this, and only in files whose range
of ids meets the batch's. Rows without an id have no key and are always stored; keys
repeated within one batch stay (the key check reports them).

**Look-ups.** ``of_business`` opens the files that the index names for the business, and those with replies
whose review was not there when they came (their business is unknown).
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trustlens.plans.sizing import spread
from trustlens.schemas import BUSINESSES, RESPONSES, REVIEWS, SCHEMAS, Feedback, conform
from trustlens.sources.file_index import between, files_of, index_files, paths_where, read_files, write_clustered

#: Replies as stored: with the business of their review, null while that review is not there.
STORED_RESPONSES = T.StructType([*RESPONSES.fields, T.StructField("business_id", T.LongType())])
STORED = {"businesses": BUSINESSES, "reviews": REVIEWS, "responses": STORED_RESPONSES}
#: Key column of a business's rows, columns that cluster a table, columns with a range in the index.
BUSINESS_KEY = {"businesses": "id", "reviews": "business_id", "responses": "business_id"}
CLUSTERED_BY = {"businesses": ("id",), "reviews": ("business_id", "created_at"), "responses": ("business_id", "review_id")}
RANGES = {"businesses": ("id",), "reviews": ("business_id", "id", "created_at"), "responses": ("business_id", "id", "review_id")}
#: Rows of a file (about 100 to 200 MB of reviews).
ROWS_PER_FILE = 2_000_000
#: Rows that a task writes, in one or several files.
ROWS_PER_TASK = 500_000

MANIFEST = T.StructType(
    [
        T.StructField("version", T.LongType()),
        T.StructField("kind", T.StringType()),  # create, batch, drop, state, model
        T.StructField("name", T.StringType()),
        T.StructField("folder", T.StringType()),
        T.StructField("through", T.LongType()),  # version of the batches that a state or model covers
    ]
)


class FeedbackStore:
    """The store below the folder ``root`` (make one with ``FeedbackStore.create``)."""

    def __init__(self, spark: SparkSession, root: str, rows_per_file: int = ROWS_PER_FILE):
        self.spark, self.root, self.rows_per_file = spark, root.rstrip("/"), rows_per_file

    @classmethod
    def create(cls, spark: SparkSession, root: str, rows_per_file: int = ROWS_PER_FILE) -> FeedbackStore:
        """A new, empty store (version 0); an existing one is an error."""
        store = cls(spark, root, rows_per_file)
        first = spark.createDataFrame([(0, "create", None, None, None)], MANIFEST)
        first.coalesce(1).write.mode("errorifexists").parquet(f"{store.root}/manifest")
        return store

    # -- versions ------------------------------------------------------------------

    def entries(self, version: int | None = None) -> list[Row]:
        """The manifest's entries up to ``version`` in commit order: a few per append or refresh."""
        rows = self.spark.read.schema(MANIFEST).parquet(f"{self.root}/manifest")
        if version is not None:
            rows = rows.where(F.col("version") <= version)
        return rows.orderBy("version", "kind", "name").collect()

    def version(self) -> int:
        """The latest version."""
        return self.entries()[-1]["version"]

    def commit(self, added: Sequence[tuple[str, str, str | None, int | None]]) -> int:
        """A new version with the entries (kind, name, folder, through); visible as a whole."""
        version = self.version() + 1
        rows = self.spark.createDataFrame([(version, *a) for a in added], MANIFEST)
        rows.coalesce(1).write.mode("append").parquet(f"{self.root}/manifest")
        return version

    def batches(self, version: int | None = None, after: int = 0) -> list[Row]:
        """The batches that make up a version, in order; only those committed after version ``after``."""
        rows = [r for r in self.entries(version) if r["kind"] in ("batch", "drop")]
        dropped = max((r["version"] for r in rows if r["kind"] == "drop"), default=0)
        return [r for r in rows if r["kind"] == "batch" and r["version"] >= dropped and r["version"] > after]

    # -- writing -------------------------------------------------------------------

    def append(self, fb: Feedback, batch_id: str) -> int:
        """Store the rows of ``fb`` as batch ``batch_id`` and return the new version; a batch that is
        there already changes nothing."""
        if any(b["name"] == batch_id for b in self.batches()):
            return self.version()
        return self._write(fb, batch_id, self.batches(), [])

    def replace(self, fb: Feedback, batch_id: str) -> int:
        """Drop and recreate: a version of this batch alone. Readers of earlier versions go on."""
        return self._write(fb, batch_id, [], [("drop", "all", None, None)])

    def _write(self, fb: Feedback, batch_id: str, stored: list[Row], also: list[tuple]) -> int:
        folder = f"batches/{uuid.uuid4().hex}"
        fb = fb.conformed()
        for name in ("businesses", "reviews", "responses"):
            batch = getattr(fb, name)
            n, low, high = batch.agg(F.count(F.lit(1)), F.min("id"), F.max("id")).first()
            new = self._unseen(batch, name, stored, low, high)
            if name == "responses":
                new = self._with_business(new, f"{folder}/reviews", stored)
            path = f"{self.root}/{folder}/{name}"
            write_clustered(new, path, CLUSTERED_BY[name], self._tasks(n), self.rows_per_file)
            written = self.spark.read.schema(STORED[name]).parquet(path)
            index = index_files(written, BUSINESS_KEY[name], RANGES[name])
            # by range, so that a look-up reads few row groups of a large index
            order = f"min_{BUSINESS_KEY[name]}"
            index.orderBy(F.col(order).asc_nulls_first(), "file").write.parquet(f"{self.root}/{folder}/index/{name}")
        return self.commit([*also, ("batch", batch_id, folder, None)])

    def _tasks(self, n: int) -> int:
        """Tasks that write ``n`` rows: no more than files, and beyond the cluster's cores as many as the rows fill."""
        return min(-(-n // self.rows_per_file), max(self.spark.sparkContext.defaultParallelism, -(-n // ROWS_PER_TASK)))

    def _unseen(self, df: DataFrame, name: str, stored: list[Row], low: int | None, high: int | None) -> DataFrame:
        """The rows whose id, in [low, high] if there is one, is not stored yet."""
        paths = paths_where(self.index(name, stored), between("id", low, high)) if stored else []
        if not paths:
            return df
        known = read_files(self.spark, STORED[name], paths).select(F.col("id").alias("known_id"))
        known = known.where(F.col("known_id").between(low, high))
        return df.join(spread(known), df["id"] == known["known_id"], "left_anti")

    def _with_business(self, replies: DataFrame, reviews_folder: str, stored: list[Row]) -> DataFrame:
        """Replies with the business of their review, from this batch's reviews and from the stored ones
        in files whose ids meet those that the replies name."""
        paths = [f"{self.root}/{reviews_folder}"]
        if stored:
            low, high = replies.agg(F.min("review_id"), F.max("review_id")).first()
            paths += paths_where(self.index("reviews", stored), between("id", low, high))
        keys = read_files(self.spark, REVIEWS, paths).where(F.col("id").isNotNull() & F.col("business_id").isNotNull())
        # one business per review id, whatever the keys, so that no reply is stored twice
        keys = keys.groupBy(F.col("id").alias("of_id")).agg(F.min("business_id").alias("business_id"))
        return replies.join(spread(keys), replies["review_id"] == keys["of_id"], "left").drop("of_id")

    # -- reading -------------------------------------------------------------------

    def index(self, name: str, batches: list[Row]) -> DataFrame:
        """The file index of a table over some batches (at least one)."""
        return self.spark.read.parquet(*[f"{self.root}/{b['folder']}/index/{name}" for b in batches])

    def rows(self, name: str, batches: list[Row]) -> DataFrame:
        """A table's rows of some batches, replies with their business."""
        return read_files(self.spark, STORED[name], [f"{self.root}/{b['folder']}/{name}" for b in batches])

    def read(self, version: int | None = None) -> Feedback:
        """The three tables as of a version (the latest if none is named)."""
        batches = self.batches(version)
        return Feedback(**{name: conform(self.rows(name, batches), SCHEMAS[name]) for name in SCHEMAS})

    def of_business(self, business_ids: Sequence[int], version: int | None = None) -> Feedback:
        """The rows of some businesses, from the files that may hold them."""
        batches = self.batches(version)
        found = {}
        for name, key in BUSINESS_KEY.items():
            unknown = F.col("null_keys") > 0 if name == "responses" else None
            paths = files_of(self.index(name, batches), key, business_ids, unknown) if batches else []
            found[name] = read_files(self.spark, STORED[name], paths)
        theirs = {name: found[name].where(F.col(key).isin(list(business_ids))) for name, key in BUSINESS_KEY.items()}
        # replies that came before their review
        early = found["responses"].where(F.col("business_id").isNull())
        ids = theirs["reviews"].select(F.col("id").alias("of_id")).distinct()
        early = early.join(ids, early["review_id"] == ids["of_id"], "left_semi")
        theirs["responses"] = theirs["responses"].unionByName(early)
        return Feedback(**{name: conform(theirs[name], SCHEMAS[name]) for name in SCHEMAS})

    def latest(self, kind: str, name: str, version: int | None = None) -> Row | None:
        """The entry of a state or model that holds at a version."""
        rows = [r for r in self.entries(version) if r["kind"] in (kind, "drop") and r["name"] in (name, "all")]
        return rows[-1] if rows and rows[-1]["kind"] == kind else None

    def derived(self, kind: str, name: str, version: int | None = None) -> DataFrame:
        """A state or model as of a version; an error if no refresh wrote it."""
        entry = self.latest(kind, name, version)
        if entry is None:
            raise LookupError(f"no {kind} {name} at version {self.version() if version is None else version}")
        return self.spark.read.parquet(f"{self.root}/{entry['folder']}")


def stack(frames: Sequence[DataFrame]) -> DataFrame:
    """The rows of all frames."""
    return reduce(DataFrame.unionByName, frames)
