"""Vector codes and centroid clusters against plain integer arithmetic."""

import hashlib
import math
import random

import pytest

import oracle
from tidemark.llm import lookup_clusters, queries, resident_codes, vectors

SCHEMA = "vec_id long, embedding array<float>, label int, cluster int, v string, entry int"
CLUSTERS = lookup_clusters.ClusterOptions(clusters=5, rounds=3, width=8)
CODES = resident_codes.CodeOptions(parts=2, entries=4, rounds=4, cell=7)


def frame(spark, rows):
    return spark.createDataFrame([(i, x, label, 0, "x", 0) for i, x, label in rows], SCHEMA)


def random_rows(n, width, seed, spread=1.0):
    """Vectors with many ties, so that equal distances and empty cells occur."""
    r = random.Random(seed)
    return [(i, [r.choice((-0.5, 0.0, 0.25, 0.30078125, 1.0)) * spread for _ in range(width)], r.choice((None, 1, 2))) for i in range(n)]


def whole(rows, scale, width):
    out = []
    for i, x, label in rows:
        if x and all(c is not None and math.isfinite(c) for c in x) and (width is None or len(x) == width):
            bound = vectors.COMPONENT_BOUND
            out.append((i, [max(-bound, min(bound, math.floor(scale * c))) for c in x], label))
    return out


def squared(a, b):
    return sum((x - y) ** 2 for x, y in zip(a, b, strict=True))


def closest(x, centres):
    return min((squared(x, c), i) for i, c in enumerate(centres))


def means(points, near, centres):
    out = []
    for i, c in enumerate(centres):
        own = [p for p, n in zip(points, near, strict=True) if n == i]
        out.append([sum(d) // len(own) for d in zip(*own, strict=True)] if own else c)
    return out


def brute_clusters(rows, o):
    kept = whole(rows, o.scale, o.width)
    order = sorted((hashlib.sha256(f"{o.seed}{'' if i is None else i}".encode()).hexdigest(), v) for i, v, _ in kept)
    centres = [v for _, v in order[: o.clusters]]
    points = [v for _, v, _ in kept]
    for _ in range(o.rounds):
        centres = means(points, [closest(p, centres)[1] for p in points], centres)
    found = [(i, *reversed(closest(v, centres))) for i, v, _ in kept]
    total = sum(d for _, _, d in found)
    return sorted(
        (
            (i, c, d, sum(y for _, x, y in found if x == c), total, hashlib.sha256(",".join(map(str, centres[c])).encode()).hexdigest())
            for i, c, d in found
        ),
        key=repr,
    )


def brute_codes(rows, o):
    kept = whole(rows, o.scale, None)
    usable = sorted(((i is None, i or 0, v) for i, v, _ in kept if len(v) % o.parts == 0))
    if not usable:
        return []
    width = len(usable[0][2])
    kept = [(i, v, label) for i, v, label in kept if len(v) == width]
    step = width // o.parts
    starts = sorted((i is None, i or 0, v) for i, v, _ in kept)[: o.entries]
    books, near = [], []
    for p in range(o.parts):
        cut = [v[p * step : (p + 1) * step] for _, v, _ in kept]
        book = [v[p * step : (p + 1) * step] for _, _, v in starts]
        for _ in range(o.rounds):
            book = means(cut, [closest(x, book)[1] for x in cut], book)
        books.append(book)
        near.append([closest(x, book) for x in cut])
    digest = hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()
    error = [sum(n[k][0] for n in near) for k in range(len(kept))]
    by_label = {label: sum(e for e, (_, _, other) in zip(error, kept, strict=True) if other == label) for _, _, label in kept}
    return sorted(
        (
            (i, "".join(f"{n[k][1]:02x}" for n in near), error[k], by_label[label], digest)
            for k, (i, _, label) in enumerate(kept)
        ),
        key=repr,
    )


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


AWKWARD = [
    (1, None, 1), (2, [], 1), (3, [None] * 8, 1), (4, [float("nan")] + [0.0] * 7, 1), (5, [float("inf")] + [0.0] * 7, 2),
    (6, [0.0] * 7, 1), (7, [3e38] * 8, None), (7, [-3e38] * 8, None), (8, [-0.001] * 8, 2), (None, [0.5] * 8, 1),
    (9, [0.5] * 8, 1), (9, [0.5] * 8, 1), (10, [-1.0] * 8, None), (11, [0.25] * 16, 3),
]


@pytest.mark.parametrize("rows", [random_rows(60, 8, 1), random_rows(3, 8, 2), AWKWARD, random_rows(40, 8, 3) + AWKWARD])
def test_clusters_equal_brute_force(spark, rows):
    assert got(lookup_clusters.cluster(frame(spark, rows), CLUSTERS)) == brute_clusters(rows, CLUSTERS)


@pytest.mark.parametrize("rows", [random_rows(60, 8, 4), random_rows(3, 8, 5), AWKWARD, random_rows(40, 8, 6) + AWKWARD])
def test_codes_equal_brute_force(spark, rows):
    assert got(resident_codes.encode(frame(spark, rows), CODES)) == brute_codes(rows, CODES)


def test_codes_of_one_hot_entry(spark):
    """A third of all parts are equal: the salt spreads them, the result is the same."""
    rows = random_rows(60, 8, 7) + [(100 + i, [0.25] * 8, 1) for i in range(30)]
    assert got(resident_codes.encode(frame(spark, rows), CODES)) == brute_codes(rows, CODES)


def test_empty_tables(spark):
    empty = frame(spark, [])
    assert lookup_clusters.cluster(empty).collect() == []
    assert resident_codes.encode(empty).collect() == []
    assert resident_codes.encode(frame(spark, [(1, None, 1), (2, [0.5] * 7, 1)])).collect() == []


def test_only_parts_that_change_entry_are_shuffled(spark):
    """A round's plan exchanges the movers and nothing else."""
    rows = frame(spark, random_rows(60, 8, 8))
    kept = vectors.integer_vectors(rows, CODES.scale)
    seen = []
    wrapped = resident_codes.migrated

    def spied(*args):
        df = wrapped(*args)
        seen.append(df._jdf.queryExecution().sparkPlan().toString())
        return df

    resident_codes.migrated = spied
    try:
        resident_codes.codebooks(kept, 8, CODES)
    finally:
        resident_codes.migrated = wrapped
    assert len(seen) == CODES.rounds - 1
    for plan in seen:
        stay, move = plan.split("Exchange")
        assert plan.count("Exchange") == 1 and "Union" in stay and "Filter" in stay
    assert not [t for t in spark.catalog.listTables() if "residents" in t.name]


@pytest.mark.parametrize("name", ["op11_vector_codes", "op12_centroid_clusters"])
def test_queries_equal_sql(spark, name):
    df = queries.QUERIES[name](spark, f"{oracle.DATA}/sf0.001")
    assert oracle.spark_rows(df) == oracle.duck_rows(oracle.duck("sf0.001"), queries.ORACLES[name])
    assert oracle.type_mismatches(df, oracle.duck_types(oracle.duck("sf0.001"), queries.ORACLES[name])) == {}
