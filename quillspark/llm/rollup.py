"""Token counts kept up to date by signed deltas.

A batch says what happened to documents: ``insert``, ``delete``, or ``revise`` (its count under a tokenizer version is
now another one).  Each event becomes signed rows: an insert adds a document and its tokens, a delete takes away what was
counted, a revision takes away the old count and adds the new one.  Rows are summed by source, language and tokenizer version
before they move, and one signed total per group is added to the rollup.

The state is a folder in the shared storage: ``deltas/batch=<id>`` holds a batch's signed totals, ``counts/batch=<id>`` the
documents' counts that it set, both written before ``commits/batch=<id>``.  Readers see committed batches only, and a
batch that is already committed is not applied again; one that broke off is written anew by the next try.  So a batch
counts exactly once, whatever is run again.  Sums do not depend on the order of batches; a document's own count
is that of its last batch.

Nulls and odd rows: null source and language are groups of their own.  A null or empty text has 0 tokens but is a document.
Several events of one document in one batch are applied in the order of their number ``seq``.  An insert of a
document that is there counts as a revision, a delete or revision of one that is not there changes nothing.  Equal repeated
events have the effect of one.  An event without a document id is ignored.  An empty batch commits and changes
nothing.  Other columns are not read.
"""

from __future__ import annotations

import posixpath

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.session import new_path

GROUP = ("source", "lang", "version")
STATE = "doc_id long, version string, source string, lang string, tokens long, present boolean, applied long"
DELTA = "source string, lang string, version string, documents long, tokens long"


def _committed(spark: SparkSession, folder: str) -> list[str]:
    """Ids of the committed batches: names of the marker files, read through Spark's own file system."""
    marker = posixpath.join(folder, "commits")
    try:
        return [r["id"] for r in spark.read.schema("id string").json(marker).distinct().collect()]
    except Exception as error:  # no batch yet
        if "PATH_NOT_FOUND" in str(error):
            return []
        raise


def _read(spark: SparkSession, folder: str, kind: str, batches: list[str], schema: str) -> DataFrame:
    if not batches:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(*(posixpath.join(folder, kind, f"batch={b}") for b in batches))


class Rollup:
    """Additive token totals under ``folder`` (a new one in the shared folder if none is given)."""

    def __init__(self, spark: SparkSession, folder: str | None = None):
        self.spark, self.folder = spark, folder or new_path(spark, "rollup")

    def counts(self) -> DataFrame:
        """The last known count of every document and version: doc_id, version, source, lang, tokens, present."""
        rows = _read(self.spark, self.folder, "counts", _committed(self.spark, self.folder), STATE)
        last = rows.groupBy("doc_id", "version").agg(F.max_by(F.struct("source", "lang", "tokens", "present"), "applied").alias("s"))
        return last.select("doc_id", "version", "s.*")

    def totals(self) -> DataFrame:
        """documents and tokens by source, language and tokenizer version; groups that are empty again are left out."""
        rows = _read(self.spark, self.folder, "deltas", _committed(self.spark, self.folder), DELTA)
        sums = rows.groupBy(*GROUP).agg(F.sum("documents").alias("documents"), F.sum("tokens").alias("tokens"))
        return sums.where("documents <> 0 OR tokens <> 0")

    def apply(self, batch: str, events: DataFrame) -> bool:
        """Apply a batch once; tells whether it was new.

        ``events``: doc_id, version, op (insert, delete, revise), source, lang, tokens, seq.
        """
        done = _committed(self.spark, self.folder)
        if batch in done:
            return False
        known = self.counts().select("doc_id", "version", F.struct("source", "lang", "tokens", "present").alias("before"))
        order = F.struct("seq", "op", "source", "lang", "tokens")
        events = events.where("doc_id IS NOT NULL AND version IS NOT NULL").select("doc_id", "version", order.alias("e")).distinct()
        # a document's events of one batch are few; the list is folded in their order
        listed = events.groupBy("doc_id", "version").agg(F.sort_array(F.collect_list("e")).alias("events")).join(known, ["doc_id", "version"], "left")
        state = "cast(null as struct<source:string,lang:string,tokens:bigint,present:boolean>)"
        step = ("CASE WHEN e.op = 'insert' OR e.op = 'revise' AND s.present THEN named_struct('source', IF(e.op = 'revise', s.source, e.source), "
                "'lang', IF(e.op = 'revise', s.lang, e.lang), 'tokens', coalesce(e.tokens, 0L), 'present', true) "
                "WHEN e.op = 'delete' AND s.present THEN named_struct('source', s.source, 'lang', s.lang, 'tokens', s.tokens, 'present', false) ELSE s END")
        listed = listed.withColumn("after", F.expr(f"aggregate(events, coalesce(before, {state}), (s, e) -> {step})")).drop("events")
        path = posixpath.join(self.folder, "counts", f"batch={batch}")
        listed = listed.withColumn("applied", F.lit(len(done)).cast("long"))
        listed.select("doc_id", "version", "after.*", "applied", "before").where("present IS NOT NULL").write.mode("overwrite").parquet(path)
        moved = self.spark.read.parquet(path)
        signed = F.explode(F.array(
            F.struct(F.col("before.source").alias("source"), F.col("before.lang").alias("lang"), F.col("before.present").alias("there"), F.lit(-1).alias("sign"), F.col("before.tokens").alias("tokens")),
            F.struct("source", "lang", F.col("present").alias("there"), F.lit(1).alias("sign"), "tokens"),
        ))
        rows = moved.select("version", signed.alias("d")).where("d.there").select("d.source", "d.lang", "version", "d.sign", "d.tokens")
        delta = rows.groupBy(*GROUP).agg(F.sum("sign").cast("long").alias("documents"), F.sum(F.col("sign") * F.col("tokens")).cast("long").alias("tokens"))
        delta.write.mode("overwrite").parquet(posixpath.join(self.folder, "deltas", f"batch={batch}"))
        # the commit is one small file; until it is there the batch does not count
        self.spark.createDataFrame([(batch,)], "id string").coalesce(1).write.mode("append").json(posixpath.join(self.folder, "commits"))
        return True


def insert_events(docs: DataFrame, tokens: Column, version: str, id_col: str = "doc_id", source_col: str = "source", lang_col: str = "lang") -> DataFrame:
    """Events that insert every document."""
    return docs.select(
        F.col(id_col).cast("long").alias("doc_id"), F.lit(version).alias("version"), F.lit("insert").alias("op"), F.col(source_col).cast("string").alias("source"),
        F.col(lang_col).cast("string").alias("lang"), tokens.cast("long").alias("tokens"), F.lit(0).cast("long").alias("seq"),
    )
