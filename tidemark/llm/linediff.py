"""Line dedup by pairwise alignment.

Documents are found through runs of lines: the shortest run from a line on, or up to it, that
has `least_words` words, so a long line is a run alone. Whatever block two documents share,
it begins with such a run. A later holder of a rare run is paired with every earlier one, a
later holder of a frequent run with its first, so pairs grow with the lines, never with
their square. What travels is the places of the runs a pair shares, not the documents. Each
pair is aligned with patience diff over these runs, and the lines of the aligned ones are
deleted from the later document.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import keyed, pieces_of, unkeyed
from tidemark.sources.shared import materialise


@dataclass(frozen=True)
class DiffOptions:
    """A block is deleted if it has `least_words` words or more. Runs in at most `rare`
    documents pair a holder with all earlier ones, others with the first."""

    rare: int = 20
    least_words: int = 5


def blocks(a: list, b: list, words: list[int] | None = None) -> list[tuple[int, int, int]]:
    """Patience diff: runs (start in a, start in b, length) of equal lines, in order.

    Lines that occur once on either side are anchors; the longest ascending chain of them
    is kept, grown over equal neighbours, and the gaps between are treated alike. Given the
    words of each line of b, a gap without anchors takes as anchors its lines with words,
    the n-th of equal lines in a with the n-th in b.
    """
    found: list[tuple[int, int, int]] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        if a0 >= a1 or b0 >= b1:
            continue
        count: dict = {}
        for i in range(a0, a1):
            count[a[i]] = (i, None) if a[i] not in count else (None, None)
        once: dict = {}
        for j in range(b0, b1):
            once[b[j]] = None if b[j] in once else j
        anchors = sorted((count[x][0], j) for x, j in once.items() if j is not None and count.get(x, (None,))[0] is not None)
        chain = _ascending(anchors or (_repeated(a, b, words, (a0, a1, b0, b1)) if words else []))
        if not chain:
            continue
        low_a, low_b = a0, b0
        for i, j in chain:
            if i < low_a or j < low_b:
                continue
            start_a, start_b = i, j
            while start_a > low_a and start_b > low_b and a[start_a - 1] == b[start_b - 1]:
                start_a, start_b = start_a - 1, start_b - 1
            end_a, end_b = i + 1, j + 1
            while end_a < a1 and end_b < b1 and a[end_a] == b[end_b]:
                end_a, end_b = end_a + 1, end_b + 1
            todo.append((low_a, start_a, low_b, start_b))
            found.append((start_a, start_b, end_a - start_a))
            low_a, low_b = end_a, end_b
        todo.append((low_a, a1, low_b, b1))
    return sorted(found)


def _repeated(a: list, b: list, words: list[int], gap: tuple[int, int, int, int]) -> list[tuple[int, int]]:
    """Places of equal lines that have words, paired in order of occurrence."""
    a0, a1, b0, b1 = gap
    places: dict = {}
    for i in range(a1 - 1, a0 - 1, -1):
        places.setdefault(a[i], []).append(i)
    return sorted((places[b[j]].pop(), j) for j in range(b0, b1) if words[j] and places.get(b[j]))


def _ascending(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Longest chain ascending in both places (patience sorting)."""
    tops: list[int] = []
    at: list[int] = []
    back: list[int] = []
    for n, (_, j) in enumerate(pairs):
        k = bisect_left(tops, j)
        tops[k : k + 1], at[k : k + 1] = [j], [n]
        back.append(at[k - 1] if k else -1)
    out, n = [], at[-1] if at else -1
    while n >= 0:
        out.append(pairs[n])
        n = back[n]
    return out[::-1]


def runs(text: str, least_words: int) -> Iterator[tuple[int, int, int, int, int]]:
    """(token, at, n, first, last) of the runs of a text.

    `at` counts lines with words; a run has `n` of them, `first` and `last` are line numbers.
    Runs from a line on have `at` of their first line and an even token, runs up to a line
    `at` of their last and an odd one.
    """
    lines = [(i, line, len(line.split())) for i, line in enumerate(text.split("\n"))]
    lines = [x for x in lines if x[2]]
    hashes = [xxhash.xxh3_64_digest(line.encode("utf-8", "replace")) for _, line, _ in lines]
    end, words = 0, 0
    for at in range(len(lines)):
        while end < len(lines) and words < least_words:
            words += lines[end][2]
            end += 1
        if words < least_words:
            break
        yield _token(hashes[at:end], 0), at, end - at, lines[at][0], lines[end - 1][0]
        words -= lines[at][2]
    start, words = 0, 0
    for at in range(len(lines)):
        words += lines[at][2]
        while words - lines[start][2] >= least_words:
            words -= lines[start][2]
            start += 1
        if words >= least_words:
            yield _token(hashes[start : at + 1], 1), at, at + 1 - start, lines[start][0], lines[at][0]


def _token(hashes: list[bytes], odd: int) -> int:
    return (xxhash.xxh3_64_intdigest(b"".join(hashes)) >> 2 << 1) | odd


def _with_runs(docs: DataFrame, options: DiffOptions) -> DataFrame:
    """(token, doc, places) for each run of each document."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, digests = (batch.column(c).to_pylist() for c in ("key", "digest"))
            texts = batch.column("text").to_pylist()
            for low, high in pieces_of(texts):
                rows = [
                    (keys[i], digests[i], *run) for i in range(low, high) for run in runs(texts[i], options.least_words)
                ]
                if rows:
                    columns = zip(*rows, strict=True)
                    arrays = [pa.array(c, pa.int64() if i < 3 else pa.int32()) for i, c in enumerate(columns)]
                    yield pa.RecordBatch.from_arrays(arrays, ["key", "digest", "token", "at", "n", "first", "last"])

    found = docs.select("key", "digest", "text").mapInArrow(
        cut, "key long, digest long, token long, at int, n int, first int, last int"
    )
    places = F.collect_list(F.struct("at", "n", "first", "last")).alias("places")
    return found.groupBy("token", F.struct("key", "digest").alias("doc")).agg(places)


def _aligned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for doc, shared in zip(batch.column("later").to_pylist(), batch.column("shared").to_pylist(), strict=True):
            gone = common_lines(shared)
            if gone:
                out.append((doc["key"], doc["digest"], gone))
        columns = zip(*out, strict=True) if out else ([], [], [])
        kinds = (pa.int64(), pa.int64(), pa.list_(pa.int32()))
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["key", "digest", "gone"]
        )


def common_lines(shared: list[dict]) -> list[int]:
    """Numbers of the later document's lines in aligned blocks, from the runs it shares with
    the earlier one."""
    early: dict[int, dict[int, int]] = {0: {}, 1: {}}
    later: dict[int, dict[int, tuple[int, dict]]] = {0: {}, 1: {}}
    for run in shared:
        odd = run["token"] & 1
        early[odd].update((p["at"], run["token"]) for p in run["early_places"])
        later[odd].update((p["at"], (run["token"], p)) for p in run["places"])
    a, at_a = _spaced({at: token for at, token in early[0].items()})
    b, at_b = _spaced({at: token for at, (token, _) in later[0].items()})
    gone: set[int] = set()
    for i, j, n in blocks(a, b, [int(at is not None) for at in at_b]):
        for k in range(n):
            if at_b[j + k] is None:
                continue
            run = later[0][at_b[j + k]][1]
            gone.update(range(run["first"], run["last"] + 1))
            if k + 1 < n and at_b[j + k + 1] is not None:
                continue
            # Short lines behind the last run still belong to the block.
            x, y = at_a[i + k] + run["n"], at_b[j + k] + run["n"]
            while y in later[1] and early[1].get(x) == later[1][y][0]:
                gone.update(range(later[1][y][1]["first"], later[1][y][1]["last"] + 1))
                x, y = x + 1, y + 1
    return sorted(gone)


def _spaced(tokens: dict[int, int]) -> tuple[list, list]:
    """Tokens in order with a sign that equals no other wherever places are not adjacent."""
    out, places = [], []
    before = None
    for at in sorted(tokens):
        if before is not None and at != before + 1:
            out.append(object())
            places.append(None)
        out.append(tokens[at])
        places.append(at)
        before = at
    return out, places


def removals(docs: DataFrame, options: DiffOptions = DiffOptions()) -> DataFrame:
    """(key, digest, gone): ascending numbers of the lines to delete, for documents that lose
    any.

    `docs` has a row per (key, digest); the smaller pair is the earlier document.
    """
    held = materialise(_with_runs(docs, options), "runs")
    first = F.min(F.struct("doc", "places")).alias("first")
    many = held.groupBy("token").agg(F.count("*").alias("docs"), first).where("docs > 1")
    many = many.select("token", "docs", F.col("first.doc").alias("early"), F.col("first.places").alias("early_places"))
    # A frequent run's holders are split by adaptive execution.
    frequent = held.join(many.where(F.col("docs") > options.rare), "token").where("doc <> early")
    few = materialise(held.join(many.where(F.col("docs") <= options.rare).select("token"), "token"), "rare-runs")
    before = few.select("token", F.col("doc").alias("early"), F.col("places").alias("early_places"))
    rare = few.join(before, "token").where("early < doc")
    columns = ["doc", "early", "token", "places", "early_places"]
    pairs = frequent.select(columns).union(rare.select(columns)).groupBy(F.col("doc").alias("later"), "early")
    shared = pairs.agg(F.collect_list(F.struct("token", "places", "early_places")).alias("shared"))
    gone = shared.select("later", "shared").mapInArrow(_aligned, "key long, digest long, gone array<int>")
    # Each line once per task and document before the shuffle.
    each = gone.select("key", "digest", F.explode("gone").alias("at")).distinct()
    return each.groupBy("key", "digest").agg(F.sort_array(F.collect_list("at")).alias("gone"))


def _flags(gone: str) -> Column:
    """Ascending line numbers as an array of flags, in one walk over them."""
    gaps = F.transform(gone, lambda x, i: x - F.coalesce(F.get(gone, i - 1), F.lit(-1)) - 1)
    return F.flatten(F.transform(gaps, lambda n: F.concat(F.array_repeat(F.lit(False), n), F.array(F.lit(True)))))


def dedup_lines(docs: DataFrame, options: DiffOptions = DiffOptions()) -> DataFrame:
    """doc_id, n_lines, n_removed, kept_text for each row of `docs`.

    Earlier means a smaller id, then a smaller hash of the text; NULL comes first. Lines
    without words are never candidates; inside a deleted block they go with it. NULL and
    empty texts stay empty. Rows that repeat an id and a text are one document and each lose
    the lines found; rows that repeat an id with other texts are documents of their own. An
    empty table gives no row.
    """
    rows = keyed(docs).withColumn("digest", F.xxhash64("text"))
    once = rows.where(F.col("text") != "")
    found = materialise(removals(once, options), "lines-gone")
    lines = F.split("text", "\n")
    # A flag per line up to the last deleted one, looked up by place.
    flagged = found.select("key", "digest", F.size("gone").alias("n"), _flags("gone").alias("flags"))
    kept = F.filter(lines, lambda x, i: ~F.coalesce(F.get("flags", i), F.lit(False)))
    return rows.join(flagged, ["key", "digest"], "left").select(
        unkeyed("key", "doc_id"),
        F.size(lines).cast("long").alias("n_lines"),
        F.coalesce("n", F.lit(0)).cast("long").alias("n_removed"),
        F.when(F.col("flags").isNull(), F.col("text")).otherwise(F.array_join(kept, "\n")).alias("kept_text"),
    )
