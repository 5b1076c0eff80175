"""Vector code compression: product codes from member-resident Lloyd rounds.

Each vector is cut into parts. Rows (position, entry, salt, part) are stored in buckets of
(position, entry, salt): the members of a codebook entry stay with the tasks that own it.
A round has two steps. Owners sum their resident members, one row per entry and task, and
the driver gets one row per entry. Then residents compare themselves with the new
codebook; only those whose nearest entry has changed go through a shuffle, to the buckets
of their new entry. Those that stay are written by the task that read them into the same
bucket, so a bucket is one file of residents and one of arrivals. An entry that holds a
third of all parts is spread by the salt. The table of a round is dropped once the next
one is written.

Rows go whose vector is NULL or holds a NULL or non-finite component, and those whose
length differs from that of the smallest kept id with a length that is a multiple of
`parts`. NULL ids stand after all others. Rows repeating an id are vectors of their own,
ordered by their components where starts are chosen. Fewer vectors than `entries` give as
many entries. An empty table gives no rows. Integers beyond `vectors.COMPONENT_BOUND` are
set to it.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.config import session_settings
from tidemark.llm.vectors import exact_sum, integer_vectors, joined, matrix
from tidemark.sources.shared import materialise

HOME = ("position", "entry", "salt")
# Spark drops the buckets of a scan under a plain write, which asks for no arrangement.
KEEP_BUCKETS = "spark.sql.sources.bucketing.autoBucketedScan.enabled"


@dataclass(frozen=True)
class CodeOptions:
    parts: int = 8
    entries: int = 16
    rounds: int = 6
    scale: int = 4096
    cell: int = 2_000  # members of an entry that share a salt, about


def encode(rows: DataFrame, options: CodeOptions = CodeOptions()) -> DataFrame:
    """vec_id, code, error, label_error, codebooks_sha256 per vector."""
    labels = [c for c in ("label",) if c in rows.columns]
    kept = integer_vectors(rows.withColumn("label", F.col("label") if labels else F.lit(None).cast("int")), options.scale, also=("label",))
    first = (
        kept.where(F.size("v") % options.parts == 0)
        .orderBy(F.col("vec_id").asc_nulls_last(), "v")
        .limit(1)
        .collect()
    )
    if not first:
        return rows.sparkSession.createDataFrame(
            [], "vec_id long, code string, error long, label_error long, codebooks_sha256 string"
        )
    width = len(first[0]["v"])
    vectors = materialise(kept.where(F.size("v") == width), "codes-vectors")
    return described(vectors, codebooks(vectors, width, options), width)


def codebooks(vectors: DataFrame, width: int, options: CodeOptions = CodeOptions()) -> np.ndarray:
    """Entries by position after all rounds: parts x entries x components."""
    start = vectors.orderBy(F.col("vec_id").asc_nulls_last(), "v").limit(options.entries).collect()
    ordered = sorted((r["vec_id"] is None, r["vec_id"] or 0, r["v"]) for r in start)
    books = np.array([v for _, _, v in ordered], np.int64)
    books = books.reshape(len(books), options.parts, width // options.parts).swapaxes(0, 1)

    spark = vectors.sparkSession
    homes = int(spark.conf.get("spark.sql.shuffle.partitions"))
    with _residence(spark, homes) as settle:
        residents = settle(_arrivals(_parts(vectors, width, books, options), homes))
        for turn in range(options.rounds):
            books = owners_update(residents, books)
            if turn + 1 < options.rounds:
                residents = settle(migrated(residents, books, homes))
    return books


def _parts(vectors: DataFrame, width: int, books: np.ndarray, options: CodeOptions) -> DataFrame:
    """A row per vector and position, at its nearest entry, salted by the whole row."""
    step = width // options.parts
    salts = max(1, -(-vectors.count() // options.cell))
    pieces = [F.slice("v", i * step + 1, step) for i in range(options.parts)]
    cut = vectors.select(
        F.pmod(F.xxhash64("vec_id", "v"), F.lit(salts)).cast("int").alias("salt"),
        F.posexplode(F.array(*pieces)).alias("position", "part"),
    )
    return cut.select("position", _nearest(books).alias("entry"), "salt", "part")


def _nearest(books: np.ndarray) -> Column:
    @F.arrow_udf("int")
    def entry(position: pa.Array, part: pa.Array) -> pa.Array:
        return pa.array(_compare(books, position, part)[0], pa.int32())

    return entry("position", "part")


def _compare(books: np.ndarray, position: pa.Array, part: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    at = position.to_numpy(zero_copy_only=False)
    rows = matrix(part, books.shape[2])
    near, error = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
    for p in np.unique(at):
        here = np.flatnonzero(at == p)
        near[here], error[here] = _closest(rows[here], books[p])
    return near, error


def _closest(rows: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lowest index among the nearest entries, and the squared distance, in integers."""
    total = np.zeros((len(rows), len(entries)), np.int64)
    for d in range(rows.shape[1]):
        total += (rows[:, d, None] - entries[None, :, d]) ** 2
    near = total.argmin(axis=1)
    return near, total[np.arange(len(rows)), near]


def owners_update(residents: DataFrame, books: np.ndarray) -> np.ndarray:
    """Floor of the mean of each entry's members; an entry without any stays."""
    step = books.shape[2]
    sums = residents.groupBy("position", "entry").agg(
        F.count("*").alias("members"), *(F.sum(F.col("part")[d]).alias(f"s{d}") for d in range(step))
    )
    after = books.copy()
    for r in sums.collect():  # one row per position and entry
        after[r["position"], r["entry"]] = [r[f"s{d}"] // r["members"] for d in range(step)]
    return after


def migrated(residents: DataFrame, books: np.ndarray, homes: int) -> DataFrame:
    """Residents after comparing with `books`: those that change entry are shuffled."""
    near = _nearest(books)
    stay = residents.withColumn("near", near).where("near = entry").drop("near")
    move = residents.withColumn("near", near).where("near <> entry")
    return stay.union(_arrivals(move.select("position", F.col("near").alias("entry"), "salt", "part"), homes))


def _arrivals(parts: DataFrame, homes: int) -> DataFrame:
    return parts.repartition(homes, *HOME)


@contextmanager
def _residence(spark: SparkSession, homes: int) -> Iterator:
    """Stores arranged rows as a table of `homes` buckets, in place of the one before."""
    tables: list[str] = []
    label = f"tidemark_residents_{uuid.uuid4().hex}"

    def settle(arranged: DataFrame) -> DataFrame:
        name = f"{label}_{len(tables)}"
        arranged.write.format("parquet").bucketBy(homes, *HOME).saveAsTable(name)
        if tables:
            spark.sql(f"DROP TABLE {tables[-1]}")
        tables.append(name)
        return spark.table(name)

    try:
        with session_settings(spark, {KEEP_BUCKETS: "false"}):
            yield settle
    finally:
        for name in tables[-1:]:
            spark.sql(f"DROP TABLE IF EXISTS {name}")


def described(vectors: DataFrame, books: np.ndarray, width: int) -> DataFrame:
    """The final assignment, which needs no sums, straight from the stored vectors."""
    parts, _, step = books.shape
    digest = hashlib.sha256(joined(books.ravel().tolist()).encode()).hexdigest()

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = matrix(batch.column("v"), width)
            found = [_closest(rows[:, p * step : (p + 1) * step], books[p]) for p in range(parts)]
            codes = np.stack([near for near, _ in found], axis=1).astype(np.uint8)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("vec_id"),
                    batch.column("label"),
                    pa.array([c.tobytes().hex() for c in codes], pa.string()),
                    pa.array(sum(error for _, error in found), pa.int64()),
                ],
                ["vec_id", "label", "code", "error"],
            )

    label = vectors.schema["label"].dataType.simpleString()
    coded = materialise(
        vectors.select("vec_id", "label", "v").mapInArrow(code, f"vec_id long, label {label}, code string, error long"),
        "codes-coded",
    )
    # Combined before the shuffle, so that a label with a third of the rows is no burden;
    # the join's larger side is split by adaptive execution where the sums are not small.
    sums = coded.groupBy("label").agg(exact_sum("error").alias("label_error")).withColumnRenamed("label", "of")
    return coded.join(sums, coded["label"].eqNullSafe(sums["of"])).select(
        "vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256")
    )
