"""Token counts, and totals of them that signed deltas keep up to date.

A store holds batches.  A batch has the signed rows of its changes (minus
what a document counted before, plus what it counts now) and the totals of
those by source, language and tokenizer version.  Totals are additive: those
of the store are the sums over its batches, and no document is read again.
What documents counted before is looked up by key: signed rows lie in
``BUCKETS`` folders by a hash of the id, a batch reads the folders of its own
ids only, and drops all other ids before it sums.  ``compact`` folds batches
into one.

A batch's data is written aside, under a name that nobody else has; then a
small file with the batch's name is moved into place, which fails if it is
there.  That file is the commit: data that no commit names count nowhere, and
of two writers of a batch one wins.  A batch that is sent again, after a lost
driver for instance, changes nothing.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.llm._shared import forget, materialise
from factloom.llm.secrets import encoding, vocabulary

LEDGER = "doc_id long, source string, lang string, version string, n_docs long, n_tokens long"
DELTA = "source string, lang string, version string, n_docs long, n_tokens long"

#: Folders of signed rows in a batch.
BUCKETS = 64

#: Characters that are encoded at once; a longer text is cut after a space, where no token crosses.
CUT = 1 << 16


def count_tokens(text: str | None, enc) -> int:
    """Tokens of a whole text; none for null."""
    if not text:
        return 0
    if len(text) <= CUT:
        return len(enc.encode_ordinary(text))
    total, at = 0, 0
    while at < len(text):
        end = at + CUT
        # A word starts with the space before it, so cut between a letter and a space.
        while end < len(text) and not (text[end] == " " and text[end - 1].isalpha() and text[end + 1 : end + 2].isalpha()):
            end += 1
        total += len(enc.encode_ordinary(text[at:end]))
        at = end
    return total


def token_counts(docs: DataFrame, vocab_path: str, *, text_col: str = "text", keep: list[str], as_col: str = "n_tokens") -> DataFrame:
    """The columns ``keep`` of each row of ``docs`` and the number of tokens of its whole text.

    A null or empty text has none; repeated rows each get a row, an empty
    table none.  ``as_col`` is not to be among ``keep``.
    """
    if as_col in keep:
        raise ValueError(f"{as_col} is the name of the result")
    vocab = vocabulary(docs.sparkSession, vocab_path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(vocab.value)
        for batch in batches:
            n = pa.array([count_tokens(x.as_py(), enc) for x in batch.column(0)], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], n], [*batch.schema.names[1:], as_col])

    src = docs.select(F.col(text_col).alias("the text that is counted"), *keep)
    return src.mapInArrow(run, docs.select(*keep).schema.add(as_col, "long"))


class Rollups:
    """Additive totals in a folder that all executors share."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def _publish(self, name: str, content: dict) -> bool:
        """Put a small file in place, whole and at once; false if one of that name is there."""
        fs, aside = self._fs(f"{self.path}/aside/{uuid.uuid4().hex}")
        out = fs.create(aside, False)
        out.write(bytearray(json.dumps(content).encode()))
        out.close()
        _, target = self._fs(f"{self.path}/commits/{name}.json")
        fs.mkdirs(target.getParent())
        jvm = self.spark._jvm
        none = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), self.spark._jsc.hadoopConfiguration()).rename(aside, target, none)
        except Py4JJavaError as e:
            if not fs.exists(target):
                raise
            fs.delete(aside, False)
            if "AlreadyExists" not in str(e.java_exception):
                raise
            return False
        return True

    def _commits(self) -> dict[str, dict]:
        """Commits by name: a row for each batch since the store began."""
        fs, p = self._fs(f"{self.path}/commits")
        if not fs.exists(p) or not fs.listStatus(p):
            return {}
        rows = self.spark.read.text(f"{self.path}/commits", wholetext=True).select(F.element_at(F.split("_metadata.file_path", "/"), -1).alias("n"), "value")
        return {r["n"][: -len(".json")]: json.loads(r["value"]) for r in rows.collect()}

    def committed(self, batch: str) -> bool:
        fs, p = self._fs(f"{self.path}/commits/{_named(batch)}.json")
        return fs.exists(p)

    def _read(self, part: str, schema: str, buckets: list[int] | None = None) -> DataFrame:
        commits = self._commits()
        folded = {d for c in commits.values() for d in c.get("folds", ())}
        live = sorted(c["data"] for c in commits.values() if c["data"] not in folded)
        if not live:
            return self.spark.createDataFrame([], schema)
        rows = self.spark.read.option("basePath", f"{self.path}/data").schema(f"{schema}, data string, part string, bucket int")
        rows = rows.parquet(*(f"{self.path}/data/data={d}/part={part}" for d in live))
        return (rows if buckets is None else rows.filter(F.col("bucket").isin(buckets))).drop("data", "part", "bucket")

    def ledger(self, keys: DataFrame | None = None) -> DataFrame:
        """What each document counts now, by tokenizer version; with ``keys`` (doc_id, version, none null), of those only."""
        buckets = [r[0] for r in keys.select(_bucket()).distinct().collect()] if keys is not None else None  # BUCKETS at most
        rows = self._read("ledger", LEDGER, buckets)
        if keys is not None:
            rows = rows.join(keys, ["doc_id", "version"], "left_semi")
        now = rows.groupBy("doc_id", "source", "lang", "version").agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))
        return now.filter("n_docs <> 0 or n_tokens <> 0")

    def totals(self) -> DataFrame:
        """Rows (source, lang, version, n_docs, n_tokens); none of an empty store."""
        sums = self._read("totals", DELTA).groupBy("source", "lang", "version").agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))
        return sums.filter("n_docs <> 0 or n_tokens <> 0")

    def _write(self, signed: DataFrame) -> str:
        """Signed rows and their totals as new data that no commit names yet; the name."""
        name = uuid.uuid4().hex
        where = f"{self.path}/data/data={name}"
        # Few files, of about equal size: adaptive execution joins small folders' rows in a task and splits large ones.
        signed.withColumn("bucket", _bucket()).hint("rebalance", F.col("bucket")).write.partitionBy("bucket").parquet(f"{where}/part=ledger")
        rows = self.spark.read.schema(LEDGER).parquet(f"{where}/part=ledger")
        sums = rows.groupBy("source", "lang", "version").agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))
        sums.withColumn("bucket", F.lit(0)).write.partitionBy("bucket").parquet(f"{where}/part=totals")
        return name

    def commit(self, batch: str, changes: DataFrame) -> bool:
        """Apply a batch of changes once; whether it was new.

        ``changes``: kind (insert, delete or revise), doc_id, source, lang,
        version and n_tokens (null: none).  Inserts and revisions both set
        what a document counts under a version; deletes need its id and
        version only.  Rows that repeat a document and version are one change,
        and of those that differ the last in order of (kind, source, lang,
        n_tokens) holds.  A null doc_id can be inserted, not taken back; a
        null version is one like others for inserts, and can't be taken back
        either.  Batches can have any name; those that change the same
        documents are to be sent one after the other.
        """
        if self.committed(batch):
            return False
        fields = ("kind", "source", "lang", "n_tokens")
        changes = materialise(changes.select("doc_id", "version", *fields), "rollup-sent")
        named = changes.filter("doc_id is not null").groupBy("doc_id", "version").agg(F.max(F.struct(*fields)).alias("c")).select("doc_id", "version", *(F.col(f"c.{x}").alias(x) for x in fields))
        one = materialise(named.unionByName(changes.filter("doc_id is null").select("doc_id", "version", *fields)), "rollup-changes")
        put = one.filter("kind <> 'delete'").select("doc_id", "source", "lang", "version", F.lit(1).cast("long").alias("n_docs"), F.coalesce("n_tokens", F.lit(0)).cast("long").alias("n_tokens"))
        old = self.ledger(one.select("doc_id", "version").filter("doc_id is not null and version is not null"))
        take = old.select("doc_id", "source", "lang", "version", (-F.col("n_docs")).alias("n_docs"), (-F.col("n_tokens")).alias("n_tokens"))
        data = self._write(put.unionByName(take))
        forget(changes, one)
        return self._publish(_named(batch), {"data": data})

    def compact(self) -> bool:
        """Fold all batches into one; false if another did so meanwhile, or there is nothing to fold.

        Their names stay known, and so do batches that come in the meantime.
        """
        commits = self._commits()
        folded = {d for c in commits.values() for d in c.get("folds", ())}
        live = sorted(c["data"] for c in commits.values() if c["data"] not in folded)
        if len(live) < 2:
            return False
        rows = self.spark.read.option("basePath", f"{self.path}/data").schema(f"{LEDGER}, data string, part string, bucket int").parquet(*(f"{self.path}/data/data={d}/part=ledger" for d in live))
        sums = rows.groupBy("doc_id", "source", "lang", "version").agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens")).filter("n_docs <> 0 or n_tokens <> 0")
        turn = sum("folds" in c for c in commits.values())
        return self._publish(f"{_FOLD}{turn}", {"data": self._write(sums), "folds": live})


#: What the names of foldings start with: no batch's file does.
_FOLD = "+fold-"


def _named(batch: str) -> str:
    """A file's name for any batch's."""
    return "b-" + quote(batch, safe="")


def _bucket() -> Column:
    """The folder of a row, by its id; rows without one are dealt by chance."""
    return F.pmod(F.coalesce(F.xxhash64("doc_id"), F.monotonically_increasing_id()), F.lit(BUCKETS)).cast("int").alias("bucket")
