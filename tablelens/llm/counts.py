"""Token counts as rollups maintained by deltas.

The rollup holds additive totals (documents, tokens, characters) by source,
language and tokenizer version.  It changes by batches of signed rows: an
insert adds a document's numbers, a delete takes away those it was entered
with, a revised count is a delete of the old and an insert of the new ones.
A ledger keeps what each document was entered with, so callers name only the
documents and the new numbers.

A batch is committed under its id.  Its per-document changes and its
aggregated delta are written to folders of their own, and one record in a log
makes them count.  Records are numbered without gaps and a record is put in
place by a rename that does not replace: of several writers that saw the same
log, one gets the next number.  The others look at the log again, compute their
batch from the ledger as it is by then, and try the next number; so two
batches never take out the same entry twice, and a batch whose id is in the
log is not applied again.  What a lost attempt wrote is named by no record and
never read.  The state is the sum of the deltas the log names, so a reader
sees whole batches only.  ``compact`` folds all batches into one base, which
one record puts in their place.

The ledger is divided by a hash of doc_id into ``BUCKETS`` folders a batch; a
delete or revision that touches few buckets reads those only.

Keys are (source, lang, version); NULL is a key value of its own.  A document
is (doc_id, part, version); ``part`` tells texts apart that share an id and is
NULL where a caller has no use for it.  A delete or revision that comes
without ``part`` means all parts of its documents.  Edge cases: a NULL text has
no tokens and no characters; rows that share a doc_id and part in one insert
are all counted, as one document entry with their sum for each (source, lang);
a delete of a document that was never entered changes nothing; groups that
have come to nothing are left out; an empty batch can be committed; other
columns are ignored.  Rows with a NULL id are counted like an id of their own.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import tiktoken
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from .bpe import read_ranks
from .common import doc_columns, map_batches

KEYS = ["source", "lang", "version"]
SUMS = ["n_docs", "n_tokens", "n_chars"]
ENTRY = "doc_id long, part string, source string, lang string, version string, n_docs long, n_tokens long, n_chars long"
ENTRY_NAMES = [f.split()[0] for f in ENTRY.split(", ")]
#: Batch id of a base: this and a random name.
BASE = "base-"
RECORD = "seq long, batch string, data string, folds array<string>"
#: Parts of the ledger; fixed, as all batches must agree.
BUCKETS = 64
#: Times a batch is computed again because another writer was first.
ATTEMPTS = 50
SIGNS = "[#*$%&|<>]"
DELTA = "source string, lang string, version string, n_docs long, n_tokens long, n_chars long"

_encoders: dict[tuple[str, str], tiktoken.Encoding] = {}


def _encoder(path: str, pattern: str) -> tiktoken.Encoding:
    if (path, pattern) not in _encoders:
        _encoders[path, pattern] = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=read_ranks(path),
                                                     special_tokens={})
    return _encoders[path, pattern]


def counted(docs: DataFrame, tokenizers: dict[str, Callable[[], Callable[[list[str]], list[int]]]]) -> DataFrame:
    """Entries of every row and tokenizer version.

    ``tokenizers`` maps a version to a function that, called on an executor,
    gives a function from texts to token counts.  A column ``part`` of ``docs``
    is kept, else the entries have none.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ready = {version: make() for version, make in tokenizers.items()}
        for b in batches:
            texts = [t or "" for t in b.column(4).to_pylist()]
            chars, one = pa.array([len(t) for t in texts], pa.int64()), pa.array([1] * len(b), pa.int64())
            for version, count in ready.items():
                yield pa.RecordBatch.from_arrays(
                    [*b.columns[:4], pa.array([version] * len(b), pa.string()), one,
                     pa.array(count(texts), pa.int64()), chars], names=ENTRY_NAMES)

    part = F.col("part").cast("string") if "part" in docs.columns else F.lit(None).cast("string")
    return map_batches(docs.select("doc_id", part.alias("part"), "source", "lang", "text"), run, ENTRY)


def rank_tokenizer(path: str, pattern: str) -> Callable[[], Callable[[list[str]], list[int]]]:
    """Counts by a rank file."""
    def make() -> Callable[[list[str]], list[int]]:
        encoder = _encoder(path, pattern)
        return lambda texts: [len(encoder.encode_ordinary(t)) for t in texts]

    return make


def word_tokenizer() -> Callable[[list[str]], list[int]]:
    """Counts words between ASCII blanks."""
    return lambda texts: [len(t.encode().split()) for t in texts]


class Rollup:
    """The totals below a folder that all executors share."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _log(self) -> list[Row]:
        """The records so far, in their order."""
        log = self._path(f"{self.folder}/log")
        if not self._fs.exists(log):
            return []
        return self.spark.read.schema(RECORD).json(f"{self.folder}/log").orderBy("seq").collect()

    def committed(self) -> list[str]:
        """Ids of the batches that count, those folded into a base included."""
        return sorted(r["batch"] for r in self._log())

    def _claim(self, seq: int, record: dict) -> bool:
        """Put the record in place as number ``seq``, whole; False if another writer has that number."""
        draft, place = self._path(f"{self.folder}/drafts/{record['data']}"), self._path(f"{self.folder}/log/{seq:012d}.json")
        out = self._fs.create(draft, True)
        out.write(bytearray(json.dumps({"seq": seq, **record}).encode()))
        out.close()
        self._fs.mkdirs(place.getParent())
        return not self._fs.exists(place) and self._fs.rename(draft, place)

    def _read(self, kind: str, schema: str, log: list[Row]) -> DataFrame:
        """What the batches of the log wrote, a base in place of those it folds."""
        folded = {d for r in log for d in r["folds"]}
        paths = [f"{self.folder}/{kind}/data={r['data']}" for r in log if r["data"] not in folded]
        if not paths:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).option("basePath", f"{self.folder}/{kind}").parquet(*paths)

    def _ledger(self, log: list[Row], buckets: list[int] | None = None) -> DataFrame:
        rows = self._read("entries", f"{ENTRY}, bucket int", log)
        if buckets is not None:
            rows = rows.filter(F.col("bucket").isin(buckets))
        return (rows.groupBy("doc_id", "part", *KEYS).agg(*[F.sum(c).alias(c) for c in SUMS])
                .filter(F.col("n_docs") != 0))

    def ledger(self) -> DataFrame:
        """What each document is entered with now."""
        return self._ledger(self._log())

    def totals(self) -> DataFrame:
        """source, lang, version, n_docs, n_tokens, n_chars."""
        return (self._read("deltas", DELTA, self._log()).groupBy(*KEYS).agg(*[F.sum(c).alias(c) for c in SUMS])
                .filter(F.col("n_docs") != 0))

    def _write(self, signed: DataFrame) -> str:
        """Write signed entries and their delta; the name of what was written."""
        data = uuid.uuid4().hex
        entries = f"{self.folder}/entries/data={data}"
        sums = [F.sum(c).alias(c) for c in SUMS]
        # one row a document and key, so no bucket grows with the rows of one id
        (signed.groupBy("doc_id", "part", *KEYS).agg(*sums).select(*ENTRY_NAMES, _bucket().alias("bucket"))
         .repartition("bucket").write.partitionBy("bucket").parquet(entries))
        delta = self.spark.read.schema(f"{ENTRY}, bucket int").parquet(entries).groupBy(*KEYS).agg(*sums)
        delta.write.parquet(f"{self.folder}/deltas/data={data}")
        return data

    def _commit(self, batch: str, signed: Callable[[list[Row]], DataFrame], reads: bool = True,
                folds: bool = False) -> bool:
        """Commit the signed entries made from a state of the log; False, and nothing done, if the id is taken.

        A batch that does not read the ledger is written once, whoever comes first.
        """
        data = None
        for _ in range(ATTEMPTS):
            log = self._log()
            if batch in {r["batch"] for r in log}:
                return False
            if reads or data is None:
                data = self._write(signed(log))
            if self._claim(len(log), {"batch": batch, "data": data, "folds": [r["data"] for r in log] if folds else []}):
                return True
        raise RuntimeError(f"batch {batch} came second to other writers {ATTEMPTS} times")

    @staticmethod
    def _minus(entries: DataFrame) -> DataFrame:
        return entries.select("doc_id", "part", *KEYS, *[(-F.col(c)).alias(c) for c in SUMS])

    def _entered(self, ids: DataFrame, log: list[Row]) -> DataFrame:
        """Ledger rows of the documents (doc_id, version, and part if given) in ``ids``."""
        names = [n for n in ("doc_id", "part", "version") if n in ids.columns]
        wanted = ids.select(*[F.col(n).alias(f"_{n}") for n in names], _bucket().alias("_bucket")).distinct()
        buckets = [r["_bucket"] for r in wanted.select("_bucket").distinct().collect()]  # at most BUCKETS
        same = [F.col(n).eqNullSafe(F.col(f"_{n}")) for n in names]
        return self._ledger(log, buckets).join(wanted, same, "left_semi")

    def insert(self, batch: str, entries: DataFrame) -> bool:
        """Add documents; ``entries`` as ``counted`` gives them."""
        return self._commit(batch, lambda log: entries, reads=False)

    def delete(self, batch: str, ids: DataFrame) -> bool:
        """Take out documents named by (doc_id, version) or (doc_id, part, version)."""
        return self._commit(batch, lambda log: self._minus(self._entered(ids, log)))

    def revise(self, batch: str, entries: DataFrame, by_part: bool = False) -> bool:
        """Replace what documents were entered with; unknown ones are added.

        ``by_part``: only the parts that ``entries`` names, else all parts of its documents.
        """
        ids = entries if by_part else entries.drop("part")
        return self._commit(batch, lambda log: self._minus(self._entered(ids, log)).unionByName(entries))

    def compact(self) -> str:
        """Fold all committed batches into a base, which readers see in their place at once."""
        name = BASE + uuid.uuid4().hex[:16]
        self._commit(name, self._ledger, folds=True)
        return name


def _bucket() -> Column:
    return F.pmod(F.xxhash64("doc_id"), F.lit(BUCKETS)).cast("int")


def change_feed(rollup: Rollup, docs: DataFrame,
                tokenizers: dict[str, Callable[[], Callable[[list[str]], list[int]]]]) -> DataFrame:
    """The totals of a corpus after it was loaded, rid of exact copies and cleaned.

    Four commits: all documents; the same batch once more, as after a crash,
    which changes nothing; the deletion of documents whose text an earlier
    document has (other texts under its id stay); and revised counts of the
    documents left that hold any of ``#*$%&|<>``, counted without these.
    """
    digest = F.substring(F.sha2(F.coalesce("text", F.lit("")), 256), 1, 32)
    parted = doc_columns(docs, "doc_id", "source", "lang", "text").withColumn("part", digest)
    entries = counted(parted, tokenizers)
    rollup.insert("load", entries)
    rollup.insert("load", entries)
    prints = parted.select("doc_id", "part")
    firsts = prints.groupBy("part").agg(F.min("doc_id").alias("first"))
    copies = prints.join(firsts, "part").filter(F.col("doc_id") > F.col("first")).select("doc_id", "part").distinct()
    versions = F.explode(F.array(*map(F.lit, tokenizers)))
    rollup.delete("copies", copies.withColumn("version", versions))
    cleaned = parted.filter(F.col("text").rlike(SIGNS)).join(copies, ["doc_id", "part"], "left_anti").withColumn(
        "text", F.regexp_replace("text", SIGNS, ""))
    rollup.revise("cleaned", counted(cleaned, tokenizers), by_part=True)
    return rollup.totals()
