"""Repeated strings removed, against a dictionary of all windows."""

import collections
import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

import oracle
from tidemark.llm import queries, suffix_dedup
from tidemark.llm.suffix_dedup import SuffixOptions

SCHEMA = "doc_id long, text string, key long, block long, data string"
# Small windows; blocks and buckets of a few texts each, so that matches cross them.
SMALL = SuffixOptions(length=20, period=7, cover=(0, 1, 3), block=150, bucket=40)


def docs(spark, texts, ids=None):
    ids = range(len(texts)) if ids is None else ids
    return spark.createDataFrame([(i, t, 1, 2, "x") for i, t in zip(ids, texts, strict=True)], SCHEMA)


def brute(texts, length):
    raw = [(t or "").encode() for t in texts]
    seen = collections.Counter(b[i : i + length] for b in raw for i in range(len(b) - length + 1))
    out = []
    for b in raw:
        gone = [False] * len(b)
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                gone[i : i + length] = [True] * length
        spans, i = [], 0
        while i < len(b):
            j = i
            while j < len(b) and gone[j]:
                j += 1
            if j > i:
                spans.append((i, j))
            i = max(j, i + 1)
        out.append((len(b), spans, bytes(x for x, g in zip(b, gone, strict=True) if not g)))
    return out


def found(df):
    return [(r.n_bytes, [tuple(s) for s in r.spans], bytes(r.kept)) for r in df.orderBy("doc_id").collect()]


def passage(r, words):
    return " ".join(r.choice(("alpha", "be", "gamma-ray", "δέλτα", "e")) for _ in range(words))


@pytest.mark.parametrize("seed", range(3))
def test_random_texts_equal_brute_force(spark, seed):
    r = random.Random(seed)
    shared = [passage(r, n) for n in (3, 5, 8, 20)]
    texts = [" ".join(r.choice([passage(r, 3), str(r.random()), *shared]) for _ in range(r.randrange(9))) for _ in range(80)]
    texts += ["a" * 19, "b" * 20, "c" * 21, "c" * 21, "d" * 300, "", None, "xy" * 40, "yx" * 40, texts[5], texts[5] + "!"]
    got = found(suffix_dedup.dedup(docs(spark, texts), SMALL))
    assert got == brute(texts, SMALL.length)


@settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.text(alphabet="ab\n", max_size=60), max_size=12))
def test_two_letters_equal_brute_force(spark, texts):
    """Nearly everything repeats, in every alignment."""
    assert found(suffix_dedup.dedup(docs(spark, texts), SMALL)) == brute(texts, SMALL.length)


def test_match_must_not_cross_documents(spark):
    """Adjacent documents repeat what one other document holds across the seam."""
    texts = ["0123456789abcdef", "ghijklmnopqrstuv", "0123456789abcdefghijklmnopqrstuv", "0123456789abcdef", "ghijklmnopqrstuv"]
    assert found(suffix_dedup.dedup(docs(spark, texts), SMALL)) == brute(texts, SMALL.length)
    assert brute(texts, 20)[2][1] == []


def test_one_passage_in_every_document(spark):
    """A hot passage, and chains of copies whose first holders lie in different blocks."""
    r = random.Random(9)
    hot = "the quick brown fox jumps over the lazy dog and runs"
    texts = [f"{r.random()} {hot[r.randrange(3) :]} {r.random()}" for _ in range(120)]
    base = [str(r.random()) for _ in range(30)]
    texts += [" ".join(base[i : i + 6]) for i in range(25)]
    assert found(suffix_dedup.dedup(docs(spark, texts), SMALL)) == brute(texts, SMALL.length)


def test_null_and_repeated_ids_are_rows_of_their_own(spark):
    texts = ["x" * 25, "unique text that stands alone", "x" * 25, None, ""]
    got = suffix_dedup.dedup(docs(spark, texts, [None, 7, 7, 8, None]), SMALL).collect()
    assert collections.Counter((r.doc_id, r.n_bytes, bytes(r.kept)) for r in got) == collections.Counter(
        [(None, 25, b""), (7, 29, b"unique text that stands alone"), (7, 25, b""), (8, 0, b""), (None, 0, b"")]
    )
    assert suffix_dedup.dedup(docs(spark, [], []), SMALL).collect() == []


def test_cover_must_hold_every_difference():
    with pytest.raises(ValueError, match="difference"):
        SuffixOptions(cover=(0, 1, 2))
    assert len({(a - b) % 73 for a in suffix_dedup.COVER for b in suffix_dedup.COVER}) == 73


def test_query_equals_brute_force(spark):
    table = queries.table(spark, f"{oracle.DATA}/sf0.001", "documents")
    want = brute([r.text for r in table.orderBy("doc_id").collect()], 200)
    got = queries.op13_suffix_dedup(spark, f"{oracle.DATA}/sf0.001").orderBy("doc_id").collect()
    assert [(r.n_bytes, r.n_removed, r.n_spans) for r in got] == [(n, sum(e - s for s, e in spans), len(spans)) for n, spans, _ in want]
    assert not [t for t in spark.catalog.listTables() if "suffix" in t.name]
