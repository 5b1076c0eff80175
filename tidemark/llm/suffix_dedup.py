"""Suffix-array dedup: bytes covered by a long string that starts anywhere else too.

The suffix order is built blockwise with a difference cover. `cover` is a set of residues
modulo `period` in which every difference occurs, so for any two suffixes there is a shift
below `period` that takes both to sample positions; whoever shares `length` bytes shares a
sample string of `length - period + 1` bytes there.

1. Documents are packed into stored blocks of some megabytes, bucketed by block, so that
   later passes read whole blocks in place and send only small results to them.
2. Sample strings get ranks: their prints are dealt into buckets of bounded size, each
   sorted on its own, and equal ones get the first place in the corpus that holds them.
   Within a block equal samples leave as one, so a passage that a third of all documents
   share costs one entry per block.
3. Long ties are resolved by these ranks alone: consecutive samples whose ranks lie on one
   diagonal of one earlier place show that the text between them repeats that place. Only
   suffixes that touch a repeated sample and are not settled so, are left.
4. The left suffixes are dealt by a 128-bit print of their first `length` bytes into buckets
   and sorted, one bucket at a time; neighbours that agree repeat each other. As only equality
   of heads matters, buckets follow the order of prints, not of letters.

NULL texts count as empty and are kept whole, NULL and repeated ids are rows of their
own, further columns are left behind, an empty table gives no rows. Equality is that of
prints: 96 bits in step 4, two or more 32-bit ranks and their buckets in step 3.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.config import session_settings
from tidemark.llm.common import groups, keyed, unkeyed
from tidemark.sources.shared import materialise

# A perfect difference set modulo 73.
COVER = (0, 1, 3, 7, 15, 31, 36, 54, 63)
# A bucketed scan keeps its buckets, and a step's shuffle files go when it has ended.
STEP = {
    "spark.sql.sources.bucketing.autoBucketedScan.enabled": "false",
    "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true",
    "spark.sql.execution.arrow.maxRecordsPerBatch": "64",
}
_ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xBF58476D1CE4E5B9)]
_HALF = np.uint64(32)
_FOUND = "home int, kind int, block long, a binary, b binary, c binary"
ENTRY, PLAN, MARK, ALONE = range(4)


@dataclass(frozen=True)
class SuffixOptions:
    length: int = 200
    period: int = 73
    cover: tuple[int, ...] = COVER
    block: int = 4 << 20  # bytes of text in a stored block; a longer document has its own
    bucket: int = 4 << 20  # entries sorted at once, about

    def __post_init__(self):
        shifts = {(a - b) % self.period for a in self.cover for b in self.cover}
        if len(shifts) < self.period or self.sample < 8:
            raise ValueError("cover must hold every difference, and samples eight bytes")

    @property
    def sample(self) -> int:
        return self.length - self.period + 1


def dedup(docs: DataFrame, options: SuffixOptions = SuffixOptions(), key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_bytes, spans (maximal removed byte ranges, end exclusive), kept (bytes)."""
    spark = docs.sparkSession
    homes = int(spark.conf.get("spark.sql.shuffle.partitions"))
    name = f"tidemark_suffix_blocks_{uuid.uuid4().hex}"
    try:
        with session_settings(spark, STEP | {"spark.sql.execution.arrow.maxRecordsPerBatch": "2000"}):
            blocks = _stored_blocks(keyed(docs, key, text), name, homes, options)
        with session_settings(spark, STEP):
            total = blocks.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
            buckets = max(homes, -(-total * len(options.cover) // options.period // options.bucket))
            ties = materialise(_ranked(blocks, homes, buckets, options), "suffix-ties")
            found = materialise(_compared(blocks, ties, homes, buckets, options), "suffix-found")
            kept = materialise(_kept(blocks, found, options), "suffix-kept")
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {name}")
    return kept.select(unkeyed("key", "doc_id"), "n_bytes", "spans", "kept")


# Blocks --------------------------------------------------------------------------


def _stored_blocks(docs: DataFrame, name: str, homes: int, options: SuffixOptions) -> DataFrame:
    """block, size, keys, sizes, data: whole documents side by side, bucketed by block.

    Numbers come from the writing task; a task that is run again gives the same numbers,
    and only one attempt's files count.
    """

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 33
        keys, texts, size = [], [], 0
        for batch in batches:
            for k, t in zip(batch.column("key").to_pylist(), batch.column("text"), strict=True):
                raw = t.as_buffer()
                if texts and size + raw.size > options.block:
                    yield _block(number, keys, texts, size)
                    number, keys, texts, size = number + 1, [], [], 0
                keys.append(k)
                texts.append(raw.to_pybytes() if raw.size else b"")
                size += raw.size
        if texts:
            yield _block(number, keys, texts, size)

    packed = docs.select("key", F.col("text").cast("binary").alias("text")).mapInArrow(
        pack, "block long, size long, keys array<bigint>, sizes array<int>, data binary"
    )
    packed.write.format("parquet").option("compression", "zstd").bucketBy(homes, "block").saveAsTable(name)
    return docs.sparkSession.table(name)


def _block(number: int, keys: list[int], texts: list[bytes], size: int) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [
            pa.array([number], pa.int64()),
            pa.array([size], pa.int64()),
            pa.array([keys], pa.list_(pa.int64())),
            pa.array([[len(t) for t in texts]], pa.list_(pa.int32())),
            pa.array([b"".join(texts)], pa.binary()),
        ],
        ["block", "size", "keys", "sizes", "data"],
    )


class _Text:
    """A block's bytes with a gap after each document that no string can bridge."""

    def __init__(self, sizes: list[int], data: bytes, options: SuffixOptions):
        gap = options.length + options.period
        self.sizes = np.array(sizes, np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.sizes + gap)[:-1]]) if len(sizes) else np.zeros(0, np.int64)
        self.size = int((self.sizes + gap).sum()) + 8
        buffer = np.zeros(self.size, np.uint8)
        raw, at = np.frombuffer(data, np.uint8), 0
        for start, size in zip(self.starts, self.sizes, strict=True):
            buffer[start : start + size] = raw[at : at + size]
            at += size
        self.bytes = buffer
        self.words = np.ndarray((self.size - 7,), "<u8", buffer, strides=(1,))

    def samples(self, options: SuffixOptions) -> np.ndarray:
        """Sample positions from which a whole sample string fits into the document."""
        cover = np.array(sorted(options.cover))
        found = []
        for start, size in zip(self.starts, self.sizes, strict=True):
            last = size - options.sample
            if last >= 0:
                at = (np.arange(0, last + 1, options.period)[:, None] + cover).ravel()
                found.append(start + at[at <= last])
        return np.concatenate(found) if found else np.zeros(0, np.int64)

    def windows(self, length: int) -> np.ndarray:
        """Which positions have `length` bytes left in their document."""
        steps = np.zeros(self.size + 1, np.int32)
        fits = self.sizes >= length
        steps[self.starts[fits]] = 1
        steps[self.starts[fits] + self.sizes[fits] - length + 1] = -1
        return np.cumsum(steps[:-1]) > 0

    def prints(self, at: np.ndarray, length: int, seed: int, piece: int = 1 << 18) -> np.ndarray:
        """64-bit prints of the strings of `length` bytes that start at `at`."""
        out = np.empty(len(at), np.uint64)
        offsets = [*range(0, length - 7, 8), *([length - 8] if length % 8 else [])]
        times = _ODD[seed]
        for begin in range(0, len(at), piece):
            here = at[begin : begin + piece]
            h = np.full(len(here), seed + 1, np.uint64)
            for k in offsets:
                h ^= self.words[here + k]
                h *= times
                h ^= h >> _HALF
            h *= _ODD[2]
            out[begin : begin + piece] = h ^ (h >> np.uint64(29))
        return out


def _homes(prints: np.ndarray, buckets: int) -> np.ndarray:
    """Bucket of each print, by its upper half."""
    return ((prints >> _HALF) * np.uint64(buckets) >> _HALF).astype(np.int64)


def _packed(values: np.ndarray) -> bytes:
    """Ascending numbers below 2^32 as differences, byte planes apart, which compress."""
    steps = np.diff(values, prepend=0).astype("<u4")
    return steps.view(np.uint8).reshape(-1, 4).T.tobytes()


def _unpacked(raw: bytes) -> np.ndarray:
    planes = np.frombuffer(raw, np.uint8).reshape(4, -1).T
    return np.cumsum(np.ascontiguousarray(planes).view("<u4").ravel().astype(np.int64))


def _batch(rows: list[tuple], names: list[str], types: list[pa.DataType]) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [[] for _ in names]
    return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types, strict=True)], names)


def _found(rows: list[tuple]) -> pa.RecordBatch:
    types = [pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary()]
    return _batch(rows, ["home", "kind", "block", "a", "b", "c"], types)


def _runs(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of true."""
    edges = np.flatnonzero(np.diff(flags.astype(np.int8), prepend=0, append=0))
    return edges[::2], edges[1::2]


def _within(size: int, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Flags of the positions that some range covers."""
    steps = np.bincount(starts, minlength=size + 1)[: size + 1] - np.bincount(ends, minlength=size + 1)[: size + 1]
    return np.cumsum(steps[:size]) > 0


# Ranks of samples ------------------------------------------------------------------


def _firsts(prints: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Place of each distinct print's first holder, that of each row's, and how many hold it."""
    _, first, at, held = np.unique(prints, return_index=True, return_inverse=True, return_counts=True)
    return first, first[at], held[at]


def _ranked(blocks: DataFrame, homes: int, buckets: int, options: SuffixOptions) -> DataFrame:
    """block, at, rank_block, rank_at (packed): of samples that occur in several places."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, text in _texts(batches, options):
            at = text.samples(options)
            prints = text.prints(at, options.sample, 0)
            chosen = np.sort(_firsts(prints)[0])
            yield from _dealt(block, at[chosen], prints[chosen], _homes(prints[chosen], buckets), None)

    def rank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in groups(batches, "home"):
            block, at, prints, _ = _entries(table, "<u4")
            order = np.argsort(prints, kind="stable")  # entries lie in the order of places
            new = np.diff(prints[order], prepend=-1) != 0
            first = np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))
            held = np.bincount(first, minlength=len(order))[first] > 1
            member, leader = order[held], order[first[held]]
            back = np.argsort(member)
            member, leader = member[back], leader[back]
            cuts = np.flatnonzero(np.diff(block[member], prepend=-1))
            rows = [
                (int(block[m[0]]), _packed(at[m]), block[r].astype("<i8").tobytes(), at[r].astype("<u4").tobytes())
                for m, r in zip(np.split(member, cuts[1:]), np.split(leader, cuts[1:]), strict=True)
                if len(m)
            ]
            if rows:
                yield _batch(rows, ["block", "at", "rank_block", "rank_at"], [pa.int64(), pa.binary(), pa.binary(), pa.binary()])

    dealt = blocks.select("block", "sizes", "data").mapInArrow(deal, _FOUND)
    home = _at_home(dealt.drop("kind", "c"), homes)
    return home.mapInArrow(rank, "block long, at binary, rank_block binary, rank_at binary")


def _at_home(dealt: DataFrame, homes: int) -> DataFrame:
    """Buckets in turn to the tasks: none gets two while another has none."""
    return dealt.repartitionById(homes, F.pmod("home", F.lit(homes))).sortWithinPartitions("home", "block")


def _texts(batches: Iterator[pa.RecordBatch], options: SuffixOptions) -> Iterator[tuple[int, _Text]]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield (
                batch.column("block")[i].as_py(),
                _Text(batch.column("sizes")[i].as_py(), batch.column("data")[i].as_buffer(), options),
            )


def _dealt(
    block: int, at: np.ndarray, prints: np.ndarray, home: np.ndarray, more: np.ndarray | None
) -> Iterator[pa.RecordBatch]:
    """An entry row per bucket: lower halves or whole prints, further prints, places."""
    order = np.argsort(home, kind="stable")
    cuts = np.flatnonzero(np.diff(home[order], prepend=-1))
    rows = []
    for part in np.split(order, cuts[1:]):
        if not len(part):
            continue
        if more is None:
            rows.append((int(home[part[0]]), ENTRY, block, prints[part].astype("<u4").tobytes(), _packed(at[part]), None))
        else:
            rows.append(
                (int(home[part[0]]), ENTRY, block, prints[part].tobytes(), _packed(at[part]), more[part].astype("<u4").tobytes())
            )
    if rows:
        yield _found(rows)


def _entries(table: pa.Table, kind: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Block, place, print and further print of all entries of a bucket."""
    at = [_unpacked(x) for x in table.column("b").to_pylist()]
    block = np.repeat(table.column("block").to_numpy(), [len(x) for x in at])
    prints = np.frombuffer(b"".join(table.column("a").to_pylist()), kind).astype(np.int64 if kind == "<u4" else np.uint64)
    more = b"".join(x or b"" for x in table.column("c").to_pylist()) if "c" in table.column_names else b""
    return block, np.concatenate(at), prints, np.frombuffer(more, "<u4")


# Ties by ranks, and the suffixes that are left --------------------------------------------


def _compared(blocks: DataFrame, ties: DataFrame, homes: int, buckets: int, options: SuffixOptions) -> DataFrame:
    """Per block: its plan (sure and asked windows), marks on it, asked windows found alone."""
    told = ties.groupBy("block").agg(F.collect_list(F.struct("at", "rank_block", "rank_at")).alias("ties"))
    both = blocks.select("block", "sizes", "data").join(told.hint("shuffle_hash"), "block", "left")

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for (block, text), ranks in zip(_texts([batch], options), batch.column("ties"), strict=True):
                yield from _settled(block, text, ranks.as_py() or [], homes, buckets, options)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in groups(batches, "home"):
            if table.column("home")[0].as_py() >= buckets:
                yield from table.to_batches()
                continue
            block, at, prints, more = _entries(table, "<u8")
            order = np.lexsort((more, prints))
            same = (np.diff(prints[order]) == 0) & (np.diff(more[order].astype(np.int64)) == 0)
            alone = np.sort(order[~(np.append(same, False) | np.insert(same, 0, False))])
            cuts = np.flatnonzero(np.diff(block[alone], prepend=-1))
            rows = [
                (buckets, ALONE, int(block[m[0]]), _packed(at[m]), None, None)
                for m in np.split(alone, cuts[1:])
                if len(m)
            ]
            if rows:
                yield _found(rows)

    left = _at_home(both.mapInArrow(settle, _FOUND), homes)
    return left.mapInArrow(compare, _FOUND).drop("home", "c")


def _settled(
    block: int, text: _Text, ranks: list[dict], homes: int, buckets: int, options: SuffixOptions
) -> Iterator[pa.RecordBatch]:
    at = text.samples(options)
    if not len(at):
        return
    first, own, held = _firsts(text.prints(at, options.sample, 0))
    # The rank of a sample: its place in the corpus, first in this block or before.
    rank_block, rank_at = np.full(len(at), block), at[own]
    repeated = held > 1
    for r in ranks:
        known = np.searchsorted(at, _unpacked(r["at"]))
        rank_block[known], rank_at[known] = np.frombuffer(r["rank_block"], "<i8"), np.frombuffer(r["rank_at"], "<u4")
        repeated[known] = True
    rank_block, rank_at, repeated = rank_block[own], rank_at[own], repeated[own]

    # Long ties: consecutive samples on one diagonal of one earlier block.
    tied = np.flatnonzero(repeated & ((rank_block != block) | (rank_at != at)))
    shift = at[tied] - rank_at[tied]
    order = np.lexsort((at[tied], shift, rank_block[tied]))
    tied, shift = tied[order], shift[order]
    new = np.ones(len(tied), bool)
    new[1:] = (np.diff(shift) != 0) | (np.diff(rank_block[tied]) != 0) | (np.diff(at[tied]) > options.sample)
    begin = np.flatnonzero(new)
    end = np.append(begin[1:], len(tied)) - 1 if len(tied) else begin
    starts, ends = at[tied[begin]], at[tied[end]] + options.sample - options.length + 1
    long = ends > starts
    starts, ends, begin = starts[long], ends[long], begin[long]
    fits = text.windows(options.length)
    sure = _within(text.size, starts, ends) & fits
    source, moved = rank_block[tied[begin]], shift[begin]
    rows = []
    for b in np.unique(source):
        there = source == b
        s, e = starts[there] - moved[there], ends[there] - moved[there]
        flags_from = np.argsort(s, kind="stable")
        s, e = s[flags_from], e[flags_from]
        rows.append((buckets + int(b % homes), MARK, int(b), _packed(s), (e - s).astype("<u4").tobytes(), None))

    # What else touches a repeated sample is asked for.
    marked = np.zeros(text.size + options.period + 1, np.int32)
    marked[at[repeated] + 1] = 1
    seen = np.cumsum(marked)
    near = seen[options.period : options.period + text.size] > seen[: text.size]
    asked = np.flatnonzero(near & fits & ~sure)
    prints = text.prints(asked, options.length, 0)
    more = text.prints(asked, options.length, 1) >> _HALF
    first, _, held = _firsts(prints ^ (more * _ODD[0]))
    sure[asked[held > 1]] = True
    open_ = np.zeros(text.size, bool)
    open_[asked[held == 1]] = True
    plan = [_packed(np.stack(_runs(x), axis=1).ravel()) for x in (sure, open_)]
    rows.append((buckets + block % homes, PLAN, block, *plan, None))
    yield _found(rows)
    first = np.sort(first)
    yield from _dealt(block, asked[first], prints[first], _homes(prints[first], buckets), more[first])


# What stays -------------------------------------------------------------------------------


def _kept(blocks: DataFrame, found: DataFrame, options: SuffixOptions) -> DataFrame:
    """key, n_bytes, spans, kept per document."""

    def ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, a, b in zip(*(batch.column(c).to_pylist() for c in ("block", "a", "b")), strict=True):
                starts = _unpacked(a)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(starts), block)), pa.array(starts), pa.array(starts + np.frombuffer(b, "<u4"))],
                    ["block", "start", "end"],
                )

    marks = found.where(F.col("kind") == MARK).select("block", "a", "b").mapInArrow(ranges, "block long, start long, end long")
    # One range per start, combined before the shuffle: a block that thousands of others
    # repeat gets no more ranges than it has bytes.
    marks = marks.groupBy("block", "start").agg(F.max("end").alias("end"))
    marks = marks.groupBy("block").agg(F.collect_list(F.struct("start", "end")).alias("marks"))
    told = found.where(F.col("kind") != MARK).groupBy("block").agg(F.collect_list(F.struct("kind", "a", "b")).alias("told"))
    whole = (
        blocks.select("block", "keys", "sizes", "data")
        .join(told.hint("shuffle_hash"), "block", "left")
        .join(marks.hint("shuffle_hash"), "block", "left")
    )

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rest = zip(batch.column("keys"), batch.column("told"), batch.column("marks"), strict=True)
            for (_, text), (keys, told, marks) in zip(_texts([batch], options), rest, strict=True):
                yield _cut(text, keys.as_py(), told.as_py() or [], marks, options)

    return whole.mapInArrow(cut, "key long, n_bytes long, spans array<struct<start: long, end: long>>, kept binary")


def _cut(text: _Text, keys: list[int], told: list[dict], marks: pa.Scalar, options: SuffixOptions) -> pa.RecordBatch:
    repeats = np.zeros(text.size, bool)
    for row in told:
        if row["kind"] == PLAN:
            repeats |= _within(text.size, *_unpacked(row["b"]).reshape(-1, 2).T)
    for row in told:
        if row["kind"] == ALONE:
            repeats[_unpacked(row["a"])] = False
    for row in told:
        if row["kind"] == PLAN:
            repeats |= _within(text.size, *_unpacked(row["a"]).reshape(-1, 2).T)
    if marks.is_valid:
        ranges = marks.values.flatten()
        repeats |= _within(text.size, *(x.to_numpy() for x in ranges))
    begin, end = _runs(repeats)
    gone = _within(text.size, begin, end + options.length - 1)
    begin, end = _runs(gone)
    owner = np.searchsorted(text.starts, begin, side="right") - 1
    spans: list[list[dict]] = [[] for _ in keys]
    for i, s, e in zip(owner.tolist(), begin.tolist(), end.tolist(), strict=True):
        spans[i].append({"start": s - int(text.starts[i]), "end": e - int(text.starts[i])})
    kept = []
    for start, size in zip(text.starts, text.sizes, strict=True):
        here = slice(start, start + size)
        kept.append(text.bytes[here][~gone[here]].tobytes())
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    return pa.RecordBatch.from_arrays(
        [pa.array(keys, pa.int64()), pa.array(text.sizes), pa.array(spans, kind), pa.array(kept, pa.binary())],
        ["key", "n_bytes", "spans", "kept"],
    )
