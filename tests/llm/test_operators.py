"""Operators on small awkward tables, against brute force, round trips and SQL."""

import collections
import hashlib
import itertools
import random
import re
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
import oracle
from tidemark.llm import chat, decontaminate, langid, linediff, mixing, ngram_join, packing, pii, queries, rules, warc
from tidemark.sources.shared import materialise

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key long, hash string, rank int"
DIR = f"{oracle.DATA}/sf0.001"
WORDS = [f"w{i}" for i in range(400)]
LONG = " ".join(WORDS[i % 397] + str(i // 397) for i in range(30_000))


def docs(spark, texts, first=0):
    """Texts as documents with clashing extra columns; ids count up."""
    rows = [
        (first + i, t, ("en", "de", None)[i % 3], ("a", "b", None)[i % 3], 0, 1, "x", 2) for i, t in enumerate(texts)
    ]
    return spark.createDataFrame(rows, SCHEMA)


AWKWARD = [None, "", " \n\t ", "one", "a b c d e", "a b c d e", "x " * 60, "日本語 Жд \U0001f600 z", LONG, LONG + " tail", "###"]


@pytest.fixture(scope="module")
def awkward(spark):
    return docs(spark, AWKWARD).union(spark.createDataFrame([(None, "null id text here now", None, None, 0, 1, "x", 2), (3, "one", "en", "a", 0, 1, "x", 2)], SCHEMA))


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


def by_id(df, *columns):
    return {r[0]: tuple(r)[1:] for r in df.select("doc_id", *columns).collect()}


# N-gram join -------------------------------------------------------------------


def shingle_set(text):
    w = re.findall(r"\w+", (text or "").lower())
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute_join(texts):
    sets = {k: shingle_set(t) for k, t in texts.items()}
    links, root = dict.fromkeys(sets, 0), {k: k for k in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(sorted(sets), 2):
        both = len(sets[a] & sets[b])
        if both and both >= 0.8 * len(sets[a] | sets[b]):
            links[a], links[b] = links[a] + 1, links[b] + 1
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return {k: (find(k), links[k]) for k in sets}


def test_join_equals_brute_force(spark):
    table = queries.table(spark, DIR, "documents")
    want = brute_join({r.doc_id: r.text for r in table.collect()})
    assert by_id(ngram_join.ngram_join(table), "class_id", "n_links") == want


def test_join_splits_large_groups_without_loss(spark):
    base = [f"t{i}" for i in range(120)]
    texts = [" ".join(base[:i] + ["new"] + base[i + 1 :]) for i in range(60)]
    options = ngram_join.JoinOptions(block=8)
    got = by_id(ngram_join.ngram_join(docs(spark, texts), options), "class_id", "n_links")
    assert got == brute_join(dict(enumerate(texts)))


def test_join_on_awkward_rows(spark, awkward, nothing):
    got = by_id(ngram_join.ngram_join(awkward), "class_id", "n_links")
    assert got[0] == (0, 0) and got[1] == (1, 0) and got[10] == (10, 0)
    assert got[5] == (4, 1) and got[9] == (8, 1) and got[None] == (None, 0) and len(got) == 12
    kept = ngram_join.keep_first(awkward)
    assert sorted(r.doc_id for r in kept.where("doc_id IS NOT NULL").collect()) == [0, 1, 2, 3, 4, 6, 7, 8, 10]
    assert kept.columns == awkward.columns
    assert ngram_join.ngram_join(nothing).count() == 0


def test_join_compares_only_the_row_an_id_stands_for(spark):
    base = [WORDS[i : i + 60] for i in (0, 100)]
    near = [" ".join([*b[:-1], "other"]) for b in base]
    texts = [" ".join(b) for b in base]
    stands = min(range(2), key=lambda i: ngram_join._digest(ngram_join.Shingler(5)(texts[i]).tobytes()))
    rows = [(5, texts[0]), (5, texts[1]), (5, texts[stands]), (6, near[0]), (7, near[1])]
    table = spark.createDataFrame([(i, x, "en", "a", 0, 1, "x", 2) for i, x in rows], SCHEMA)
    like, unlike = (6, 7) if stands == 0 else (7, 6)
    got = by_id(ngram_join.ngram_join(table), "copy_id", "class_id", "n_links")
    assert got == {5: (5, 5, 1), like: (like, 5, 1), unlike: (unlike, unlike, 0)}


def test_no_text_is_lost_for_its_id(spark):
    base = [" ".join(WORDS[i : i + 30]) for i in (0, 60, 120, 180)]
    rows = [(None, base[0]), (None, base[1]), (None, base[0]), (7, base[2]), (7, base[3]), (7, base[2] + " end"), (9, base[1])]
    table = spark.createDataFrame([(i, x, "en", "a", 0, 1, "x", 2) for i, x in rows], SCHEMA)
    kept = [(r.doc_id, r.text) for r in ngram_join.keep_first(table).collect()]
    assert {t.removesuffix(" end") for _, t in kept} == set(base) and len(kept) == 4
    assert {i for i, t in kept if t in base[:2]} == {None}


# Decontamination ----------------------------------------------------------------


def leaks_brute(texts, items, options=decontaminate.LeakOptions()):
    def words(t):
        return [w for w in re.split(r"[\W_]+", (t or "").lower()) if w]

    def bag(w):
        return collections.Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))

    bags = {k: (len(words(t)), bag(words(t))) for k, t in items.items()}
    df = collections.Counter(s for _, b in bags.values() for s in b)
    weight = {s: max(1, options.top_weight // n) for s, n in df.items()}
    out = set()
    for d, text in texts.items():
        w = words(text)
        for k, (n, b) in bags.items():
            for start in range(max(1, len(w) - n + 1)):
                mine = bag(w[start : start + n])
                common = sum(min(c, b[s]) * weight.get(s, 1) for s, c in mine.items())
                total = sum(max(mine[s], b[s]) * weight.get(s, 1) for s in mine | b)
                if total and common >= options.threshold * total:
                    out.add((d, k))
                    break
    return out


def test_leaks_equal_brute_force(spark):
    item = " ".join(f"q{i}" for i in range(40))
    one_changed = item.replace("q20 ", "other ")
    texts = [f"{LONG[:900]} {item} {LONG[900:1500]}", f"lead in {one_changed.upper()}, then more", item.replace("q20 ", "").replace("q5 ", ""), " ".join(f"q{i}" for i in range(0, 40, 2)), item[:60], None, ""]
    items = spark.createDataFrame([(1, item, "x"), (2, "too few words", "y"), (3, None, "z"), (4, "r1 r2 r3 r4 r5", "x")], "item_id long, text string, key string")
    got = decontaminate.find_leaks(docs(spark, texts), items).collect()
    assert {(r.doc_id, r.item_id) for r in got} == leaks_brute(dict(enumerate(texts)), {1: item, 4: "r1 r2 r3 r4 r5"})
    exact = next(r for r in got if r.doc_id == 0)
    assert exact.similarity == 1.0 and exact.n_words == 40
    kept = decontaminate.drop_leaks(docs(spark, texts), items)
    assert {0, 1} & {r.doc_id for r in kept.collect()} == set() and kept.columns == docs(spark, []).columns


def test_leaks_on_awkward_rows(spark, awkward, nothing):
    items = spark.createDataFrame([(1, "a b c d e")], "item_id long, text string")
    assert {r.doc_id for r in decontaminate.find_leaks(awkward, items).collect()} == {4, 5}
    assert decontaminate.find_leaks(nothing, items).count() == 0
    assert decontaminate.find_leaks(awkward, items.limit(0)).count() == 0


def test_native_plans_hold_no_python(spark):
    for name in ("op4_benchmark_leaks", "op10_quality_rules"):
        plan = queries.QUERIES[name](spark, DIR)._jdf.queryExecution().toString()
        assert not re.search("Python|Pandas|Arrow|CartesianProduct|NestedLoop", plan)


# Language ------------------------------------------------------------------------


def test_language_accuracy_and_spans(spark):
    table = queries.table(spark, f"{oracle.DATA}/sf0.01", "documents")
    model = langid.train(table)
    found = langid.identify(table, model).where(langid.held_out(F.col("doc_id"))).join(table.select("doc_id", "lang"), "doc_id")
    right = found.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0]
    assert right > 0.97
    texts = {r.lang: r.text for r in table.where("length(text) > 2000 AND doc_id % 5 = 0").collect()}
    mixed = " ".join(texts["en"].split()[:60] + texts["de"].split()[:100])
    ((lang, share, spans),) = langid.label([mixed], model, langid.LangOptions())
    assert lang == "de" and [s["lang"] for s in spans] == ["en", "de"] and 0.5 < share < 1


def test_viterbi_equals_all_paths():
    rng = np.random.default_rng(1)
    scores = -rng.random((6, 3)).astype(np.float32)
    got = langid.viterbi(scores, np.array([0]), np.array([6]), 0.3)

    def value(path):
        return sum(scores[t, s] for t, s in enumerate(path)) - 0.3 * sum(a != b for a, b in zip(path, path[1:]))

    assert value(got) == pytest.approx(max(map(value, itertools.product(range(3), repeat=6))), abs=1e-5)


def test_language_on_awkward_rows(spark, awkward, nothing):
    model = langid.train(queries.table(spark, DIR, "documents"))
    found = langid.identify(awkward, model)
    got = by_id(found, "lang_pred", "score")
    assert [got[i] for i in (0, 1, 2, 10)] == [("und", 0.0)] * 4 and found.count() == 13
    assert got[7][0] in model.langs
    assert langid.identify(awkward, langid.train(nothing)).where("lang_pred <> 'und'").count() == 0
    assert langid.keep_identified(awkward, model).columns == awkward.columns


# Mixing --------------------------------------------------------------------------


def brute_targets(sizes, options=mixing.MixOptions()):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: options.weights[i % 3] for i, s in enumerate(names)}
    left, open_, out = options.share * sum(sizes.values()), set(names), {}
    while open_:
        unit = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if weight[s] * unit >= options.most * sizes[s]}
        if not full:
            return out | {s: weight[s] * unit for s in open_}
        out |= {s: options.most * sizes[s] for s in full}
        left, open_ = left - sum(options.most * sizes[s] for s in full), open_ - full
    return out


def test_mix_meets_targets(spark, awkward, nothing):
    for table in (queries.table(spark, DIR, "documents"), awkward):
        rows = table.select("doc_id", "text", "source").collect()
        size = collections.Counter()
        for r in rows:
            size[r.source] += len(re.findall(r"[^\x20\x09-\x0D]+", r.text or ""))
        want = brute_targets(dict(size))
        got = mixing.shares(table, mixing.MixOptions(slice_rows=3)).join(table.select("doc_id", "source").distinct(), "doc_id", "left").collect()
        assert len(got) >= len(rows)
        taken = collections.Counter()
        for r in got:
            assert 0 <= r.taken <= 2 * r.size
            if r.doc_id is not None:
                assert r.target == pytest.approx(want[r.source])
                taken[r.source] += r.taken
        if table is not awkward:
            assert all(taken[s] == int(want[s] + 1e-6) for s in want)
    assert mixing.shares(nothing).count() == 0
    assert mixing.mixed(awkward).columns == awkward.columns


def test_curriculum_follows_the_schedules(spark):
    table = docs(spark, [" ".join(WORDS[:50])] * 300)
    rows = mixing.assign(table, mixing.MixOptions(slice_rows=20)).groupBy("source").agg(F.avg("position").alias("p")).collect()
    early, even, late = (r.p for r in sorted(rows, key=lambda r: (r.source is None, r.source or "")))
    assert early < even < late


def test_registered_mix_returns_the_training_order(spark):
    options = mixing.MixOptions()
    table = queries.table(spark, DIR, "documents")
    source = {r.doc_id: r.source for r in table.collect()}
    rows, steps = queries.op8_source_mix(spark, DIR).collect(), []
    assert sorted(r.doc_id for r in rows) == sorted(source)
    for r in rows:
        parts = [min(r.size, r.taken), r.taken - min(r.size, r.taken)]
        for p, part in enumerate(parts):
            assert (r[f"position_{p}"] is None) == (r[f"place_{p}"] is None) == (part == 0 and (r.size > 0 or p > 0))
            if r[f"place_{p}"] is not None:
                steps.append((r[f"place_{p}"], r[f"position_{p}"], part, source[r.doc_id], int(r.target)))
    steps.sort()
    assert [s[0] for s in steps] == list(range(len(steps)))
    assert all(a[1] <= b[1] for a, b in itertools.pairwise(steps))
    t = np.linspace(0, 1, 20_001)
    for i, name in enumerate(sorted(set(source.values()), key=lambda s: (s is None, (s or "").encode()))):
        knots = options.schedules[i % len(options.schedules)]
        weight = np.interp(t, np.linspace(0, 1, len(knots)), knots)
        demand = np.concatenate([[0], np.cumsum((weight[1:] + weight[:-1]) / 2)])
        before = 0
        for _, position, part, _, target in (s for s in steps if s[3] == name):
            assert np.interp(position, t, demand / demand[-1]) == pytest.approx((before + part / 2) / max(target, 1), abs=1e-6)
            before += part


def test_rows_repeating_an_id_are_drawn_one_by_one(spark):
    for i in (7, None):
        rows = [(i, " ".join(WORDS[j : j + 10]), "en", "a", 0, 1, "x", 2) for j in range(0, 80, 10)]
        got = collections.Counter(r.text for r in mixing.mixed(spark.createDataFrame(rows, SCHEMA)).collect())
        assert set(got) == {r[1] for r in rows} and sum(got.values()) == 12 and max(got.values()) == 2


# Token files ---------------------------------------------------------------------


@pytest.mark.parametrize("bits", [1, 3, 8, 11, 16, 17, 31])
def test_bits_round_trip(bits):
    ids = np.random.default_rng(bits).integers(0, 2**bits, 1001).astype(np.uint32)
    packed = packing.pack(ids, bits)
    assert len(packed) == -(-1001 * bits // 8) and (packing.unpack(packed, bits, 1001) == ids).all()


@pytest.mark.parametrize("ids", [49_408, 70_000])
def test_token_files_equal_direct_encoding(spark, awkward, ids):
    from tokenizers import Tokenizer

    path = queries.tokenizer_path("word_bpe_49k.json")
    tokenizer = Tokenizer.from_file(path)
    odd = ["it's I'LL. <|endoftext|>, '<|ENDOFTEXT|>.", "İ ΣΑΣ é é, ́a", "\xa0x\r\nq", "don't,, ab's."]
    table = awkward.union(docs(spark, odd, 100))
    manifest = packing.write_tokens(table, packing.PackOptions(path, ids=ids, block=1000, files=3))
    got = sorted((r.key, r.n_tokens, bytes(r.ids), r.start) for r in packing.read_tokens(manifest).collect())
    want = []
    for r in table.collect():
        found = np.array([*tokenizer.encode(r.text or "", add_special_tokens=False).ids, 2], "<u4")
        want.append((-(2**63) if r.doc_id is None else r.doc_id, len(found), found.tobytes()))
    assert [g[:3] for g in got] == sorted(want)
    assert [g[3] for g in sorted(got, key=lambda g: g[3])] == [0, *itertools.accumulate(g[1] for g in sorted(got, key=lambda g: g[3]))][:-1]
    whole = packing.PackedFile(manifest.orderBy(F.desc("n_tokens")).first().file)
    assert (whole.tokens(990, 1010) == whole.tokens(0, whole.n_tokens)[990:1010]).all()


def test_token_files_of_nothing(spark, nothing):
    path = queries.tokenizer_path("word_bpe_49k.json")
    assert packing.token_digests(nothing, packing.PackOptions(path)).count() == 0


# WARC, chat ----------------------------------------------------------------------


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_matches_sql(spark, name):
    df = queries.QUERIES[name](spark, DIR)
    assert oracle.spark_rows(df) == oracle.duck_rows(oracle.duck("sf0.001"), queries.ORACLES[name])


def test_warc_on_awkward_pages(spark):
    big = "é<p>" * 60_000
    rows = [(5, "u", big, 1), (3, None, big, 1), (4, "u\r\nX: y", "short", 1), (6, "u", "short", 1), (7, "u", None, 1), (8, "u", "", 1), (3, None, big, 1), (None, "u", "k" * 200, 1)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, key int")
    options = warc.WarcOptions(chunk=1000)
    read = warc.read_warc(warc.write_warc(pages, options), options)
    got = sorted(warc.records(read).collect(), key=str)
    want = []
    for page, _, html, _ in rows:
        data = (html or "").encode()
        back = html == big and page == 5
        want.append((page, len(data), hashlib.sha256(data).hexdigest(), "revisit" if back else "response", 3 if back else None))
    assert [tuple(r) for r in got] == [tuple(r) for r in sorted(got, key=str)] and sorted(map(tuple, got), key=str) == sorted(want, key=str)
    parts = read.where("key = 3").orderBy("file", "record", "chunk").collect()
    assert max(len(p.data) for p in parts) <= 1000
    one = [p for p in parts if (p.file, p.record) == (parts[0].file, parts[0].record)]
    assert b"".join(p.data for p in one).decode() == big
    assert one[3].digest == hashlib.sha256(big.encode()[: sum(p.bytes for p in one[:4])]).hexdigest()
    assert warc.records(warc.read_warc(warc.write_warc(pages.limit(0)))).count() == 0


@pytest.mark.parametrize("text", [*chat.CONTROL, "<\\s>", "[\\\\INST] <|turn|>", "plain \\ <", "<|turn|><|body|></s>\\"])
def test_escape_is_reversible(text):
    assert chat.unescape(chat.escape(text)) == text
    assert not any(c in chat.escape(text) for c in chat.CONTROL)


def test_chat_on_awkward_turns(spark):
    rows = [(1, i, ("user", "assistant")[i % 2], f"turn {i} <|end|> é\U0001f600") for i in range(40)]
    rows += [(2, 0, None, None), (2, None, "assistant", "first"), (None, 0, "assistant", ""), (2, 0, None, None)]
    options = chat.ChatOptions(queries.tokenizer_path("byte_bpe_50k.json"), slice_turns=7)
    turns = spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, key int")
    got = {r.conv_id: r for r in chat.digests(chat.format_turns(turns, options), options).collect()}
    said = "".join(f"{r}\n{t}\n" for _, _, r, t in rows[:40])
    loss = "".join(t for _, _, r, t in rows[:40] if r == "assistant")
    assert got[1].turns_sha256 == hashlib.sha256(said.encode()).hexdigest()
    assert (got[1].loss_chars, got[1].loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert got[2].n_turns == 3 and got[2].turns_sha256 == hashlib.sha256(b"assistant\nfirst\n\n\n\n\n").hexdigest()
    assert got[None].loss_chars == 0
    assert chat.digests(chat.format_turns(turns.limit(0), options), options).count() == 0


# Lines ---------------------------------------------------------------------------


def test_patience_blocks():
    assert linediff.blocks(list("xabcyde"), list("abcqde")) == [(1, 0, 3), (5, 4, 2)]
    assert linediff.blocks([], [1]) == [] and linediff.blocks([1, 1], [1, 1]) == []


def test_lines_go_from_the_later_document(spark, awkward, nothing):
    shared = ["this line is shared by two", "and so is this one here"]
    texts = ["\n".join(["alpha beta gamma delta one", *shared, "end of it all now"]), "\n".join(["other words entirely at first", *shared, "short"]), "\n".join(["short", shared[1]])]
    got = by_id(linediff.dedup_lines(docs(spark, texts)), "n_lines", "n_removed", "kept_text")
    assert got[0] == (4, 0, texts[0])
    assert got[1] == (4, 2, "other words entirely at first\nshort")
    assert got[2] == (2, 1, "short")
    frequent = docs(spark, ["a frequent line of several words\nown " + str(i) for i in range(9)])
    kept = by_id(linediff.dedup_lines(frequent, linediff.DiffOptions(rare=3)), "n_removed")
    assert kept == {0: (0,)} | {i: (1,) for i in range(1, 9)}
    assert linediff.dedup_lines(awkward).count() == 13 and linediff.dedup_lines(nothing).count() == 0


def test_many_copies_of_short_lines_go_like_few(spark):
    verse = ["roses are red", "violets are blue", "sugar is sweet", "and so are"]
    texts = ["\n".join([f"title of number {i} here today", *verse]) for i in range(30)]
    for rare in (3, 20, 100):
        got = by_id(linediff.dedup_lines(docs(spark, texts), linediff.DiffOptions(rare=rare)), "n_removed")
        assert got == {0: (0,)} | {i: (4,) for i in range(1, 30)}


def test_repeated_lines_are_paired_in_order():
    assert linediff.blocks([1, 1], [1, 1], [5, 5]) == [(0, 0, 2)]
    assert linediff.blocks([1, 0, 2, 1], [3, 1, 1, 0, 0], [5, 5, 5, 0, 0]) == [(0, 1, 1), (3, 2, 1)]
    rng = np.random.default_rng(5)
    for _ in range(300):
        a, b = (rng.integers(0, 5, rng.integers(0, 12)).tolist() for _ in range(2))
        found = linediff.blocks(a, b, [1] * len(b))
        assert all(a[i : i + n] == b[j : j + n] for i, j, n in found)
        edges = [(0, 0, 0), *found, (len(a), len(b), 0)]
        for (i, j, n), (k, m, _) in itertools.pairwise(edges):
            assert i + n <= k and j + n <= m and not set(a[i + n : k]) & set(b[j + n : m])


def test_copies_of_repeated_lines_go(spark):
    line = "one line of five words"
    texts = ["\n".join([line] * 3), "\n".join([line] * 3), "\n".join(["own", line, "too", line])]
    got = by_id(linediff.dedup_lines(docs(spark, texts)), "n_removed", "kept_text")
    assert got == {0: (0, texts[0]), 1: (3, ""), 2: (2, "own\ntoo")}


def brute_lines(texts, rare=20):
    """Lines deleted per document when every pair of documents is looked at."""
    held, order = {}, sorted(range(len(texts)))
    for i in order:
        for token, *place in linediff.runs(texts[i], 5):
            held.setdefault(token, {}).setdefault(i, []).append(dict(zip(("at", "n", "first", "last"), place, strict=True)))
    gone = {i: set() for i in order}
    for later in order:
        for early in range(later):
            shared = [
                {"token": t, "places": docs[later], "early_places": docs[early]}
                for t, docs in held.items()
                if later in docs and early in docs and (len(docs) <= rare or early == min(docs))
            ]
            gone[later].update(linediff.common_lines(shared))
    return {i: "\n".join(x for k, x in enumerate(texts[i].split("\n")) if k not in gone[i]) for i in order}


@pytest.mark.parametrize("seed, rare", [(1, 20), (2, 3), (3, 100)])
def test_lines_equal_brute_force_over_all_pairs(spark, seed, rare):
    r = random.Random(seed)
    known = ["one two three four five six", "a b", "c", "", "d e f", "g h i j k", "l m n o"]
    texts = ["\n".join(r.choice([*known, f"own line {r.random()} of this text"]) for _ in range(r.randrange(1, 12))) for _ in range(60)]
    got = by_id(linediff.dedup_lines(docs(spark, texts), linediff.DiffOptions(rare=rare)), "kept_text")
    assert {i: k for i, (k,) in got.items()} == brute_lines(texts, rare)


def test_runs_are_the_shortest_with_enough_words():
    text = "a b c d e\n\nf\ng h i\nj k"
    found = [x[1:] for x in linediff.runs(text, 5)]
    assert found == [(0, 1, 0, 0), (1, 3, 2, 4), (2, 2, 3, 4), (0, 1, 0, 0), (1, 2, 0, 2), (2, 3, 0, 3), (3, 2, 3, 4)]
    even = [x[0] & 1 for x in linediff.runs(text, 5)]
    assert even == [0, 0, 0, 1, 1, 1, 1] and list(linediff.runs("a b\nc d", 5)) == [] == list(linediff.runs("", 5))


def test_a_copy_goes_though_each_line_was_held_before(spark):
    short = ["one two", "three four", "five", "six seven", "eight nine"]
    texts = [*short, "\n".join(short), "\n".join(short)]
    got = by_id(linediff.dedup_lines(docs(spark, texts)), "n_removed", "kept_text")
    assert got[5] == (0, texts[5]) and got[6] == (5, "") and all(got[i] == (0, t) for i, t in enumerate(short))


def test_texts_of_one_id_are_judged_apart(spark):
    shared = "this is a line of words\nand here is yet another one"
    rows = [(1, shared), (5, shared), (5, "a text that nobody shares at all"), (5, shared), (None, "x y z w v\nu")]
    table = spark.createDataFrame([(i, x, "en", "a", 0, 1, "x", 2) for i, x in rows], SCHEMA)
    got = sorted((r.doc_id or 0, r.kept_text) for r in linediff.dedup_lines(table).collect())
    assert got == [(0, "x y z w v\nu"), (1, shared), (5, ""), (5, ""), (5, "a text that nobody shares at all")]


# Personal data -------------------------------------------------------------------


def test_base_spans():
    text = "mail a.b@x-y.org, ip 10.0.0.255 not 10.0.0.256, card 4111 1111 1111 1111 not 4111 1111 1111 1112, call +49 (30) 123-4567."
    found = [(k, text[a:b]) for k, a, b in pii.base_spans(text)]
    assert found == [("email", "a.b@x-y.org"), ("ip", "10.0.0.255"), ("card", "4111 1111 1111 1111"), ("phone", "+49 (30) 123-4567")]


def test_trees_learn_and_thresholds_hold():
    rng = np.random.default_rng(3)
    x = rng.random((2000, 3))
    x[:, 0] = 4
    y = ((x[:, 1] > 0.5) & (x[:, 2] > 0.3)).astype(float)
    trees = pii.calibrate(pii.fit(x, y, pii.PiiOptions()), x, y, pii.PiiOptions())
    picked = trees.score(x) >= trees.thresholds["secret"]
    assert y[picked].mean() >= 0.97 and picked.sum() > 0.9 * y.sum()


def test_pii_keeps_base_and_adds(spark, awkward, nothing):
    table = queries.table(spark, f"{oracle.DATA}/sf0.01", "documents")
    trees = pii.train(table)
    extra = docs(spark, ['x token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff" y', "plain words without anything"], 10**9)
    got = by_id(pii.find_pii(table.unionByName(extra.select(*table.columns)), trees), "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans")
    for r in table.collect():
        base = pii.base_spans(r.text or "")
        joined = ",".join(f"{k}:{a}:{b}" for k, a, b in base)
        assert got[r.doc_id][4] == hashlib.sha256(joined.encode()).hexdigest()
        assert {f"{k}:{a}:{b}" for k, a, b in base} <= set(got[r.doc_id][5].split(","))
    assert got[10**9][5] == "secret:11:51" and got[10**9 + 1][5] == ""
    assert pii.find_pii(awkward, pii.train(nothing)).where("spans <> ''").count() == 0


def test_every_kind_can_be_added(spark):
    trees = pii.train(queries.table(spark, f"{oracle.DATA}/sf0.01", "documents"))
    added = {"email": "jane [at] host [dot] com", "ip": "192[.]168[.]0[.]1", "card": "4111.1111.1111.1111", "phone": "(555) 123-4567"}
    for kind, span in added.items():
        text = f"Words before it {span} and words after."
        assert list(pii.all_spans([text], trees)) == [([], [(kind, 16, 16 + len(span))])]
    for span in ("look @ this. Next", "300[.]1[.]1[.]1", "4111.1111.1111.1112", "4111111111111112", "1234567890"):
        assert list(pii.all_spans([f"Words before it {span} and words after."], trees)) == [([], [])]


# Rules ---------------------------------------------------------------------------


def test_rules_equal_brute_force(spark, awkward, nothing):
    table = queries.table(spark, DIR, "documents").unionByName(awkward.select("doc_id", "text", "lang", "source", "n_chars"))
    want = collections.Counter()
    for r in table.collect():
        x, w = r.text or "", re.findall(r"[^\x20\x09-\x0D]+", r.text or "")
        runs = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
        often = collections.Counter(runs)
        covered = {j for i, run in enumerate(runs) if often[run] > 1 for j in range(i, i + 5)}
        lines = [y for y in x.split("\n") if re.search(r"[^\x20\x09-\x0D]", y)]
        failed = len(w) < 10 or 100 * len(covered) > 20 * len(w)
        want[(r.doc_id, len(w), sum(map(len, w)), sum(x.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered), failed)] += 1
    found = rules.judge(table)
    got = collections.Counter(tuple(r)[:7] for r in found.collect())
    assert got == want
    assert found.where("base_failed AND kept").count() == 0
    assert rules.judge(nothing).count() == 0


def test_thresholds_follow_the_group(spark):
    clean = [" ".join(WORDS[i : i + 40]) for i in range(300)]
    noisy = [" ".join(f"{w}###" for w in WORDS[i : i + 40]) for i in range(3)]
    got = by_id(rules.judge(docs(spark, clean + noisy)), "kept")
    assert [got[300 + i] for i in range(3)] == [(False,)] * 3 and sum(v == (True,) for v in got.values()) == 300


def test_each_fence_depends_on_the_group(spark):
    def text(i, length=5, symbols=0, repeats=0):
        """40 words of mean length `length` in lines of 10, and two lines, `repeats` of them repeated."""
        words = [f"{(i * 7919 + j * 104729) % 10**9:x}".rjust(8, "z")[: length - 1 + 2 * (j % 2)] for j in range(40)]
        words = [w + "#" * (j < symbols) for j, w in enumerate(words)]
        lines = [" ".join(words[j : j + 10]) for j in range(0, 40, 10)]
        return "\n".join([*lines, *(f"ab{i % 97} cd{k}" for k in range(2)), *(f"ab{i % 97} cd{k}" for k in range(repeats))])

    probes = {"long": {"length": 7}, "short": {"length": 3}, "symbols": {"symbols": 30}, "repeats": {"repeats": 1}}
    rows = []
    for name, of in probes.items():
        for group in ("plain", "used"):
            for i in range(300):
                rows.append((len(rows), text(i, **(of if group == "used" and i % 3 else {})), name, group, 0, 1, "x", 2))
            rows.append((10**6 + len(rows), text(1000, **of), name, group, 0, 1, "probe", 2))
    table = spark.createDataFrame(rows, SCHEMA)
    got = rules.judge(table).join(table.where("hash = 'probe'").select("doc_id", "lang", "source"), "doc_id").collect()
    assert {(r.lang, r.source): (r.base_failed, r.kept) for r in got} == {
        (name, group): (False, group == "used") for name in probes for group in ("plain", "used")
    }


def test_sketch_quantiles_are_close(spark):
    options = rules.RuleOptions()
    rows = spark.range(5000).select(
        F.lit("en").alias("lang"), F.lit("s").alias("source"), (F.col("id") + 1).alias("word_chars"), F.lit(1).alias("n_words"),
        F.lit(0).alias("n_symbols"), F.lit(0).alias("n_dup_lines"), F.lit(1).alias("n_lines"),
    )
    got = rules._quartiles(rules.sketches(rows, options), ["lang"], options).first()
    assert got["word_length_low"] == pytest.approx(1250, rel=0.02) and got["word_length_high"] == pytest.approx(3750, rel=0.02)
    assert got["symbols_high"] == 0.0 and got["docs"] == 5000


# Pipeline ------------------------------------------------------------------------


def test_pipeline_stages_keep_columns_and_take_effect(spark):
    table = queries.table(spark, DIR, "documents")
    rows = table
    for name, stage in corpus_pipeline.STAGES[:-1]:
        rows = ngram_join.materialise(stage(spark, rows, DIR), f"test-{name}")
        assert rows.columns == table.columns
    last = corpus_pipeline.STAGES[-1][1](spark, rows, DIR)
    assert last.count() == rows.count()
    ids = {r.doc_id for r in rows.collect()}
    groups = brute_join({r.doc_id: r.text for r in table.collect()})
    assert all(groups[d][0] == d for d in ids)
    items = {r.item_id: r.text for r in queries.table(spark, DIR, "benchmark").collect()}
    assert not leaks_brute({r.doc_id: r.text for r in rows.dropDuplicates(["doc_id"]).collect() if r.doc_id < 60}, items)


def test_repeated_rows_hide_no_leak(spark):
    item = " ".join(WORDS[:40])
    items = spark.createDataFrame([(1, item)], "item_id long, text string")
    leak, clean, other = f"before {item} behind", " ".join(WORDS[100:142]), " ".join([*WORDS[200:210], *WORDS[:32]])
    rows = [(1, leak), (1, leak), (2, leak), (None, leak), (None, clean), (None, other), (3, clean), (3, clean), (4, other), (4, leak)]
    table = spark.createDataFrame([(i, x, "en", "a", 0, 1, "x", 2) for i, x in rows], SCHEMA)
    got = {r.doc_id: (r.item_id, r.similarity, r.first_word) for r in decontaminate.find_leaks(table, items).collect()}
    assert got == dict.fromkeys((1, 2, 4, None), (1, 1.0, 1))
    assert sorted(r.doc_id for r in decontaminate.drop_leaks(table, items).collect()) == [3, 3]


# Legal input that once broke an operator -------------------------------------------


def slow_base_spans(text):
    return [
        (kind, m.start(), m.end())
        for kind, pattern in pii.BASE.items()
        for m in pattern.finditer(text)
        if pii._valid(kind, m.group())
    ]


def test_base_spans_equal_the_patterns():
    r = random.Random(5)
    for _ in range(4000):
        text = "".join(r.choice("a1@.. -+(_%2:9\n") for _ in range(r.randrange(60)))
        assert pii.base_spans(text) == slow_base_spans(text)
    for text in ("a@b.c_d@e.f", "1.2.3.4.5.6.7.8", "x" + "0" * 5000 + "1.1.1.1", "0" * 6000 + ".1.1.1 300.1.1.1", "a@@b.cc@d"):
        assert pii.base_spans(text) == slow_base_spans(text)
    assert ("ip", 0, 6006) in pii.base_spans("0" * 6000 + ".1.1.1")


@pytest.mark.parametrize("piece", ["1", "a", "a@", ".", "1.", "+", "+1", "-", "1 ", "a."])
def test_base_spans_of_long_runs_take_no_time(piece):
    text = piece * (1_000_000 // len(piece)) + "@"
    began = time.perf_counter()
    pii.base_spans(text)
    assert time.perf_counter() - began < 8


def test_numerals_are_no_letters(spark):
    texts = ["\u00bd \u00b2 \u2460 \u2167", "the cat and the dog", "der Hund und die Katze", "\u4e00 \u4e8c"] * 3
    table = spark.createDataFrame([(i, t, ("en", "de")[i % 4 == 2], "a", 0, 1, "x", 2) for i, t in enumerate(texts)], SCHEMA)
    found = by_id(langid.identify(table, langid.train(table)), "lang_pred", "score")
    assert found[0][0] == "und" and found[1][0] == "en" and found[3][0] != "und"


def test_more_languages_than_a_byte_counts(spark):
    table = spark.createDataFrame(
        [(5 * i + k, f"w{chr(97 + i % 26)}{chr(97 + i // 26)} " * 30, f"l{i:03d}", "a", 0, 1, "x", 2) for i in range(200) for k in range(5)],
        SCHEMA,
    )
    model = langid.train(table)
    assert len(model.langs) == 200
    found = by_id(langid.identify(table, model), "lang_pred")
    assert sum(found[5 * i][0] == f"l{i:03d}" for i in range(200)) > 150


def test_ids_that_do_not_fit_are_refused():
    with pytest.raises(ValueError, match="70000 does not fit 16"):
        packing.pack(np.array([1, 70000], np.uint32), 16)
    assert list(packing.unpack(packing.pack(np.array([1, 65535], np.uint32), 16), 16, 2)) == [1, 65535]


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_any_vocabulary_equals_the_tokenizer(spark, name):
    from tokenizers import Tokenizer

    path = queries.tokenizer_path(name)
    texts = ["Hello World again", "", None, "  two  spaces\nand lines", "It's ÜBER-cool, isn't it?", LONG[:3000]]
    manifest = packing.write_tokens(docs(spark, texts), packing.PackOptions(path, end=2))
    got = {r.key: np.frombuffer(r.ids, "<u4").tolist() for r in packing.read_tokens(manifest).collect()}
    tokenizer = Tokenizer.from_file(path)
    assert got == {i: [*tokenizer.encode(t or "", add_special_tokens=False).ids, 2] for i, t in enumerate(texts)}


def test_token_files_stand_in_training_order(spark):
    import glob

    import pyarrow.parquet as pq

    rows = materialise(mixing.mixed(spark.read.parquet(f"{DIR}/documents.parquet")), "mixed")
    folder = rows.select("_metadata.file_path").first()[0].rpartition("/")[0].removeprefix("file:")
    stored = [i for f in sorted(glob.glob(f"{folder}/part-*.parquet")) for i in pq.read_table(f, columns=["doc_id"])["doc_id"].to_pylist()]
    assert len(set(stored)) < len(stored) and stored != sorted(stored)
    found = corpus_pipeline.token_files(spark, rows, DIR).orderBy("start").collect()
    assert [r.doc_id for r in found] == stored


def test_rows_from_no_file_stand_by_id(spark):
    rows = docs(spark, ["b", "a", "c"]).orderBy(F.desc("doc_id"))
    assert packing.stored_order(rows) == []
    found = corpus_pipeline.token_files(spark, rows, DIR).orderBy("start").collect()
    assert [r.doc_id for r in found] == [0, 1, 2]


def test_encoder_equals_the_tokenizer_while_it_forgets():
    import random

    from tokenizers import Tokenizer

    path, draw = queries.tokenizer_path("word_bpe_49k.json"), random.Random(5)
    letters = [*map(chr, range(256)), *"aabbccddé''$$##..,,   ", "İ", "ſ", "К", "日", "́", "'s", "'re", "<|endoftext|>", "</w>"]
    texts = ["".join(draw.choices(letters, k=draw.randint(0, 30))) for _ in range(5000)]
    mine, tokenizer = packing.Encoder(path, 2000, by_pieces=True), Tokenizer.from_file(path)
    for low in range(0, len(texts), 100):
        part = texts[low : low + 100]
        found = [np.frombuffer(x, "<u4").tolist() for x in mine.encode(part)]
        assert found == [tokenizer.encode(t, add_special_tokens=False).ids for t in part]


def test_written_chunks_carry_the_digest_so_far(spark):
    import hashlib

    texts = ["é" * 777, "", None, "x" * 1000, "x" * 1000, "yz" * 1000]
    pages = spark.createDataFrame([(i, None, t) for i, t in enumerate(texts)], "page_id long, url string, html string")
    options = warc.WarcOptions(chunk=1000)
    rows = warc.chunks(warc.planned(pages, options), options).orderBy("key", "chunk").collect()
    for page, text in enumerate(texts):
        mine, payload = [r for r in rows if r.key == page], (text or "").encode()
        if page == 4:
            assert [(r.refers, bytes(r.data)) for r in mine] == [(3, b"")]
            continue
        assert b"".join(bytes(r.data) for r in mine) == payload and len(mine) == max(1, -(-len(payload) // 1000))
        assert [r.sofar for r in mine] == [hashlib.sha256(payload[: 1000 * (i + 1)]).hexdigest() for i in range(len(mine))]
        assert mine[-1].sofar == mine[-1].digest


def test_encoder_learns_a_word_once():
    path = queries.tokenizer_path("word_bpe_49k.json")
    mine = packing.Encoder(path, 2000, by_pieces=True)
    mine.encode(['Word, (word) "WORD" word\'s $word...', "word\n--word", "wörd"])
    assert [w for w in mine.known if w.endswith("rd")] == ["word", "wörd"]


def test_encoder_cuts_like_the_tokenizer():
    from tokenizers import Tokenizer

    path = queries.tokenizer_path("word_bpe_49k.json")
    mine, tokenizer = packing.Encoder(path, 2000, by_pieces=True), Tokenizer.from_file(path)
    texts = ["'solo 'twas O'Really a.'s 's's'll x'", "ªº µ ß Ñ \x85a\x1cb", "…WORD “Word” word", "", "12'st 1's ²x", "日本 Word's", "\n \n"]
    assert [np.frombuffer(x, "<u4").tolist() for x in mine.encode(texts)] == [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]


def test_scores_of_many_words_stay_small():
    import tracemalloc

    words, langs = [f"{i:x}".translate(str.maketrans("0123456789", "ghijklmnop")).rjust(8, "q") for i in range(50_000)], 30
    options = langid.LangOptions()
    weights = np.random.default_rng(3).random((options.buckets, langs), dtype=np.float32)
    model = langid.LangModel([f"l{i:02}" for i in range(langs)], weights, np.ones((len(langid.NAMES), langs), dtype=bool))
    tracemalloc.start()
    scores = langid._scored(words, model, options)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert scores.shape == (50_000, langs) and peak < 10 * scores.nbytes
    assert (scores == langid._scores(words, model, options)).all()


def test_labels_keep_different_words_only():
    import tracemalloc

    model = langid.LangModel(["a", "b"], np.zeros((langid.LangOptions().buckets, 2), dtype=np.float32), np.ones((len(langid.NAMES), 2), dtype=bool))
    texts = ["abcdefghij klmnopqrst uvwxyzabcd " * 1000] * 100
    tracemalloc.start()
    langid.label(texts, model, langid.LangOptions())
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 300_000 * 50


def test_tokens_are_digested_where_they_are_read(spark):
    path = queries.tokenizer_path("word_bpe_49k.json")
    found = packing.token_digests(docs(spark, ["one", "two"]), packing.PackOptions(path))
    assert found._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1


def test_encoded_task_leaves_no_pieces_behind():
    import pyarrow as pa

    options = packing.PackOptions(queries.tokenizer_path("word_bpe_49k.json"))
    batch = pa.RecordBatch.from_pydict({"key": [1, 2], "text": ["some words", "other words"]})
    (got,) = packing._encoded(iter([batch]), options, 16, True)
    worker = packing.encoder(options.tokenizer, options.cached, True)
    assert got.column("key").to_pylist() == [1, 2] and not worker.known and not worker.older
