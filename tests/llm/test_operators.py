"""The text operators against brute force, round trips and defined edge cases."""

import collections
import hashlib
import random
import re
import time

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lumenfare.llm import bpe, chat, common, decontam, fingerprint, html_extract, line_dedup, ngram_join, quality_crf, queries, toxicity, warc
from tests.llm import fixtures
from tests.oracle import SF, expected, rows, same

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@pytest.mark.parametrize("name", ["op4_warc", "op5_line_dedup"])
def test_query_equals_its_sql(spark, name):
    same(queries.QUERIES[name](spark, SF), queries.ORACLE_SQL[name])


def unique(rows_):
    """Rows without the repeated and null doc_ids, for oracles that take doc_id as a key."""
    n = collections.Counter(r[0] for r in rows_)
    return [r for r in rows_ if r[0] is not None and n[r[0]] == 1]


# Line dedup


def test_line_dedup_on_the_fixture(spark):
    own = unique(fixtures.documents())
    df = fixtures.frame(spark, own, clash=True)
    import pandas as pd

    same(line_dedup.digest(df), line_dedup.ORACLE, views={"documents": pd.DataFrame(own, columns=["doc_id", "text", "lang", "source", "n_chars"])})
    full = {(r.doc_id, r.n_dropped) for r in line_dedup.digest(fixtures.frame(spark)).collect()}
    assert {(14, 0), (None, 1), (3, 1), (4, 1), (5, 1), (7, 0)} <= full
    assert line_dedup.digest(fixtures.frame(spark, [])).count() == 0


def test_keep_bitmaps(spark):
    text = "\n".join(["a shared line of enough length"] * 3 + ["kept"] + ["a shared line of enough length"] + ["x"] * 200 + ["another shared line of enough length", "end"])
    df = spark.createDataFrame([(k, text) for k in range(4)], "doc_id long, text string")
    got = {r.doc_id: {64 * w.word + i for w in r.keep for i in range(64) if not w.bits >> i & 1} for r in line_dedup.keep_words(df).collect()}
    assert got == {k: {0, 1, 2, 4, 205} for k in range(3)}
    assert {r.doc_id: r.text for r in line_dedup.dedup(df).collect()} == {**{k: "\n".join(["kept", *["x"] * 200, "end"]) for k in range(3)}, 3: text}
    # Words that keep all their lines are left out, and a hot line is dealt over as many salts as its rows demand.
    words = line_dedup.digest(df).where("doc_id = 0").first().keep_bitmap.split(",")
    assert [w.split(":")[0] for w in words] == ["0", "3"]
    assert {r.doc_id: r.keep for r in line_dedup.keep_words(df, salt_rows=1).collect()} == {r.doc_id: r.keep for r in line_dedup.keep_words(df).collect()}


def test_line_dedup_of_very_long_texts_is_linear(spark):
    """200,000 lines of which every second one goes, in documents of which one is of another kind."""
    own = ["\n".join(f"a shared line of number {i:08d}" if i % 2 else f"own {k} {i}" for i in range(200_000)) for k in range(3)] + ["x\ny", None]
    df = spark.createDataFrame(list(enumerate(own)), "doc_id long, text string")
    want = {k: "\n".join(x for x in t.split("\n") if k == 2 or not x.startswith("a")) if t else "" for k, t in enumerate(own)}
    line_dedup.digest(df.limit(0)).count()
    began = time.perf_counter()
    got = {r.doc_id: (r.n_dropped, r.kept_sha256) for r in line_dedup.digest(df).collect()}
    assert time.perf_counter() - began < 60
    assert got == {k: (100_000 * (k < 2), hashlib.sha256(t.encode()).hexdigest()) for k, t in want.items()}


# N-gram join


def brute_groups(ids, texts, percent=80):
    sets = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOW))
        sets.append(set(zip(*[w[k:] for k in range(5)])) if len(w) >= 5 else {tuple(w)} if w else set())
    parent = list(range(len(ids)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    where = collections.defaultdict(list)
    for i, g in enumerate(sets):
        near = collections.Counter(j for x in g for j in where[x])
        for j, o in near.items():
            if 100 * o >= percent * (len(g) + len(sets[j]) - o):
                parent[root(i)] = root(j)
        for x in g:
            where[x].append(i)
    least = {}
    for i, d in enumerate(ids):
        least[root(i)] = min(least.get(root(i), d), d)
    return {d: (len(sets[i]), least[root(i)]) for i, d in enumerate(ids)}


def test_ngram_join_equals_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    local = docs.select("doc_id", "text").collect()
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.groups(docs).collect()}
    assert got == brute_groups([r.doc_id for r in local], [r.text for r in local])


@pytest.mark.parametrize("part", [3, 512])
def test_chains_of_near_copies_over_divided_families(spark, part):
    """A chain of copies, each near the next only, one hot family, and parts so small that links cross them."""
    rng = random.Random(3)
    rows_, words = [], fixtures.prose(9, 150).split()
    for k in range(60):
        rows_.append((k, " ".join(words), "en", "s", 0))
        words[rng.randrange(len(words))] = f"w{k}"
    rows_ += [(1000 + k, fixtures.prose(50 + k, 40) + " " + rows_[0][1][:200], "en", "s", 0) for k in range(20)] + [(2000, rows_[5][1].upper(), "en", "s", 0)]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.groups(fixtures.frame(spark, rows_), part=part).collect()}
    assert got == brute_groups([r[0] for r in rows_], [r[1] for r in rows_])


def test_ngram_join_edges(spark):
    own = unique(fixtures.documents())
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.groups(fixtures.frame(spark, own, clash=True)).collect()}
    assert got == brute_groups([r[0] for r in own], [r[1] for r in own])
    assert got[10] == (1, 9) and got[11] == (1, 9) and got[7] == (0, 7)
    assert ngram_join.groups(fixtures.frame(spark)).count() == len(fixtures.documents())
    assert ngram_join.groups(fixtures.frame(spark, [])).count() == 0


def test_tree_finds_all_components():
    rng = np.random.default_rng(1)
    base = [rng.integers(0, 2**63, 50).astype(np.uint64) for _ in range(12)]
    sets = [np.unique(np.where(rng.random(50) < 0.06, rng.integers(0, 2**63, 50).astype(np.uint64), b)) for b in base for _ in range(15)]
    parent = list(range(len(sets)))

    def root(p, x):
        while p[x] != x:
            x = p[x]
        return x

    for i, j in ngram_join.tree_links(sets, 80):
        parent[root(parent, i)] = root(parent, j)
    want = list(range(len(sets)))
    for i in range(len(sets)):
        for j in range(i):
            o = len(np.intersect1d(sets[i], sets[j]))
            if 100 * o >= 80 * (len(sets[i]) + len(sets[j]) - o):
                want[root(want, i)] = root(want, j)
    group = lambda p: sorted(sorted(k for k in range(len(sets)) if root(p, k) == r) for r in {root(p, k) for k in range(len(sets))})
    assert group(parent) == group(want)


def test_signature_trees_prune_and_lose_no_link(spark):
    docs = spark.read.parquet(f"{SF.replace('sf0.001', 'sf0.01')}/documents.parquet")
    rows_ = common.materialize(ngram_join.representatives(ngram_join.set_rows(docs)), "t")
    known = {r.doc_id: r for r in rows_.collect()}
    doc = {r.cls: r.doc_id for r in known.values()}
    nodes = collections.defaultdict(list)
    for r in ngram_join.members(rows_).collect():
        nodes[doc[r.node], r.band].append(doc[r.cls])
    left, pruned = collections.defaultdict(set), 0
    own = collections.defaultdict(list)
    for (node, band), ids in nodes.items():
        for d in ids:
            own[d, band].append(node)
    for (node, band), ids in nodes.items():
        maps = [ngram_join._folded(np.frombuffer(known[d].bitmap, np.uint64), ngram_join._bits(band)) for d in ids]
        stay, n = ngram_join.left_over(maps, np.array([known[d].n_shingles for d in ids]), 80, node, [own[d, band] for d in ids])
        pruned += n
        left[node, band] = {d for d, s in zip(ids, stay) if s}
    assert pruned > 20 and sum(map(len, left.values())) < sum(map(len, nodes.values()))
    sets = {}
    for r in docs.select("doc_id", "text").collect():
        w = re.findall(r"[^\x20\x09-\x0D]+", (r.text or "").translate(LOW))
        sets[r.doc_id] = set(zip(*[w[k:] for k in range(5)])) if len(w) >= 5 else {tuple(w)} if w else set()
    n_links = 0
    where = collections.defaultdict(set)
    for d in known:
        near = collections.Counter(j for g in sets[d] for j in where[g])
        for j, o in near.items():
            if 100 * o >= 80 * (len(sets[d]) + len(sets[j]) - o):
                n_links += 1
                assert any({d, j} <= x for x in left.values())
        for g in sets[d]:
            where[g].add(d)
    assert n_links > 3


def test_one_row_of_each_group_stays(spark):
    a, b, c = (fixtures.prose(k, 60) for k in (1, 2, 3))
    data = [(5, a), (5, a), (7, a + " end"), (None, a), (None, b), (None, b), (9, c), (9, b + " other " + c), (4, None), (4, None), (None, ""), (6, " ")]
    docs = fixtures.frame(spark, [(d, t, "en", "s", 0) for d, t in data], clash=True)
    kept = sorted(((r.doc_id, r.text) for r in ngram_join.keep_first(docs).collect()), key=str)
    assert kept == sorted([(5, a), (None, b), (9, c), (9, b + " other " + c), (4, None), (4, None), (None, ""), (6, " ")], key=str)


@pytest.mark.parametrize("part", [2, 512])
def test_rows_are_judged_by_their_own_text(spark, part):
    """Repeated and null ids with texts of their own, against brute force by rows."""
    a, b, c, d = (fixtures.prose(k, 60) for k in range(4))
    data = [(1, a), (2, b), (9, a + " end"), (9, b + " end"), (9, c), (9, b + " other " + c), (None, a + " stop"), (None, d), (None, d + " end"), (None, d), (3, c + " x"), (3, c + " x"), (None, None), (9, "")]
    data += [(20 + k, f"{fixtures.prose(9, 60)} {k}") for k in range(6)] + [(None, f"{fixtures.prose(9, 60)} z")]
    at = brute_groups(list(range(len(data))), [t for _, t in data])
    least = collections.defaultdict(list)
    for k, (_, home) in at.items():
        if data[k][0] is not None:
            least[home].append(data[k][0])
    want = collections.Counter((data[k][0], n, min(least[home], default=None)) for k, (n, home) in at.items())
    docs = fixtures.frame(spark, [(i, t, "en", "s", 0) for i, t in data])
    assert collections.Counter(tuple(r) for r in ngram_join.groups(docs, part=part).collect()) == want
    kept = collections.Counter((r.doc_id, r.text) for r in ngram_join.keep_first(docs, part=part).collect())
    homes = collections.Counter(home for n, home in at.values() if n)
    assert sum(kept.values()) == len(homes) + sum(not n for n, _ in at.values())
    assert kept[1, a] and kept[2, b] and kept[3, c + " x"] == 1 and kept[9, b + " other " + c] and not kept[9, c] and sum(kept[None, t] for t in (d, d + " end")) == 1


def test_join_order_puts_passages_of_few_documents_last(spark):
    # Ten documents share each passage of 60 words; their own 340 words differ, so that a prefix of rare grams meets none.
    rng = random.Random(5)
    word = lambda: f"{rng.randrange(1 << 40):x}"
    passages = [" ".join(word() for _ in range(60)) for _ in range(400)]
    texts = [(k, " ".join(word() for _ in range(340)) + " " + passages[k % 400]) for k in range(4000)]
    classes = ngram_join.representatives(ngram_join.set_rows(spark.createDataFrame(texts, "doc_id long, text string")))
    assert classes.count() == 4000 and ngram_join.members(classes).count() == 0


def test_components(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(40)] + [(100, 90), (90, 80), (5, 5), (7, None)], "a long, b long")
    got = {r.node: r.component for r in common.components(edges).collect()}
    assert got == {**{k: 0 for k in range(41)}, 80: 80, 90: 80, 100: 80}
    assert common.components(edges.limit(0)).count() == 0


# BPE


@pytest.fixture(scope="module")
def encoder():
    import public_tokenizers

    return bpe.encoder(public_tokenizers.path("byte_bpe_50k.tiktoken"))


def test_bpe_equals_the_library(encoder):
    import tiktoken

    ref = tiktoken.Encoding("own", pat_str=bpe.USUAL_PATTERN, mergeable_ranks=encoder.ranks, special_tokens={})
    rng = random.Random(2)
    texts = [t or "" for _, t, *_ in fixtures.documents()] + ["".join(rng.choice("abc XYZ'\t\n\r  ²½ªº_0129٣é中文👍\x1c\x85\xa0.,!?-’sſ") for _ in range(rng.randrange(16))) for _ in range(3000)]
    for text, ids in zip(texts, encoder.encode_all(texts)):
        assert np.frombuffer(ids, "<u4").tolist() == ref.encode_ordinary(text)
        assert encoder.decode(ids) == text.encode()


def test_bpe_prefix_table_appends_and_edits(encoder):
    rng = random.Random(4)
    for _ in range(200):
        data = fixtures.prose(rng.randrange(99), 30).encode()
        cut, start = rng.randrange(len(data)), rng.randrange(len(data))
        table = bpe.PrefixTable(encoder, data[:cut])
        table.append(data[cut:])
        end, new = min(len(data), start + rng.randrange(5)), bytes(rng.choice(b"abc ") for _ in range(rng.randrange(4)))
        work = table.replace(start, end, new)
        again = bpe.PrefixTable(encoder, data[:start] + new + data[end:])
        assert table.last == again.last and table.ids() == again.ids() and work <= len(again.last) - start


def test_bpe_query(spark, encoder):
    df = queries.bpe.digest(fixtures.frame(spark, clash=True), __import__("public_tokenizers").path("byte_bpe_50k.tiktoken"))
    got = df.collect()
    assert len(got) == len(fixtures.documents())
    texts = collections.Counter((d, hashlib.sha256((t or "").encode()).hexdigest()) for d, t, *_ in fixtures.documents())
    assert collections.Counter((r.doc_id, r.decoded_sha256) for r in got) == texts


def test_bpe_leaves_no_encoder_in_a_worker(spark):
    path = __import__("public_tokenizers").path("byte_bpe_50k.tiktoken")
    assert bpe.digest(spark.range(40).select(F.col("id").alias("doc_id"), F.lit("some words").alias("text")), path).count() == 40

    def held(batches):
        from lumenfare.llm import bpe as own

        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([len(own._encoders)] * len(b), pa.int64())], ["n"])

    assert {r.n for r in spark.range(40).mapInArrow(held, "n long").collect()} == {0}


# Decontamination


def brute_score(item, passage):
    """Smith-Waterman, cell by cell."""
    h = [[0] * (len(passage) + 1) for _ in range(len(item) + 1)]
    best = 0
    for i, a in enumerate(item, 1):
        for j, b in enumerate(passage, 1):
            h[i][j] = max(0, h[i - 1][j - 1] + (2 if a == b else -1), h[i - 1][j] - 1, h[i][j - 1] - 1)
            best = max(best, h[i][j])
    return best


def test_alignment_equals_brute_force():
    rng = random.Random(7)
    for _ in range(200):
        a, b = ([rng.randrange(6) for _ in range(rng.randrange(1, 14))] for _ in range(2))
        score, start, end = decontam.align(np.array(a, np.uint64), np.array(b, np.uint64))
        assert score == brute_score(a, b)
        if score:
            assert brute_score(a, b[start:end]) == score


def test_decontamination_finds_copies_and_edits(spark):
    rng = random.Random(11)
    items = [(k, fixtures.prose(100 + k, 40)) for k in range(8)] + [(8, None), (9, ""), (10, "two words")]
    rows_ = []
    for k in range(8):
        words = items[k][1].split()
        edited = [w if rng.random() > 0.15 else "zzz" for w in words]
        rows_ += [(k, fixtures.prose(k, 50) + " " + items[k][1].upper() + " " + fixtures.prose(k + 30, 50)), (100 + k, fixtures.prose(k + 60, 200) + "\n" + " ".join(edited) + "!"), (200 + k, fixtures.prose(k + 500, 300))]
    rows_ += [(300, None), (301, ""), (302, "some two, words more")]
    docs = fixtures.frame(spark, [(d, t, "en", "s", 0) for d, t in rows_], clash=True)
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontam.matches(docs, bench).collect()}
    assert {(k, k) for k in range(8)} | {(100 + k, k) for k in range(8)} | {(302, 10)} <= got
    assert not {d for d, _ in got} & set(range(200, 208))
    # A bit table that passes nearly all grams changes nothing.
    assert {(r.doc_id, r.item_id) for r in decontam.matches(docs, bench, most_bits=7).collect()} == got
    kept = {r.doc_id for r in decontam.clean(docs, bench).collect()}
    assert kept == {d for d, _ in rows_} - {d for d, _ in got}
    assert decontam.matches(docs.limit(0), bench).count() == 0 and decontam.matches(docs, bench.limit(0)).count() == 0


def test_decontamination_judges_rows_by_their_text(spark):
    item, other = fixtures.prose(1, 40), fixtures.prose(2, 60)
    leak = fixtures.prose(3, 30) + " " + item
    data = [(None, leak), (1, leak), (1, other), (2, other), (None, other), (3, None), (3, leak.replace(" ", "\u00a0")), (4, "\u201c" + item.replace(" ", " \u2014 ") + "\u201d"), (None, None), (5, "")]
    docs = fixtures.frame(spark, [(d, t, "en", "s", 0) for d, t in data], clash=True)
    bench = spark.createDataFrame([(1, item), (1, item), (None, item)], "item_id long, text string")
    kept = sorted(((r.doc_id, r.text) for r in decontam.clean(docs, bench).collect()), key=str)
    assert kept == sorted([(1, other), (2, other), (None, other), (3, None), (None, None), (5, "")], key=str)
    got = collections.Counter((r.doc_id, r.item_id) for r in decontam.matches(docs, bench).collect())
    assert got == {(d, i): n for d in (None, 1, 3, 4) for i, n in ((1, 2), (None, 1))}
    long = fixtures.prose(9, 300)
    part = spark.createDataFrame([(1, fixtures.prose(10, 80) + " " + " ".join(long.split()[100:140]))], "doc_id long, text string")
    assert decontam.clean(part, spark.createDataFrame([(1, long)], "item_id long, text string")).count() == 0


def test_decontamination_recall_against_all_alignments(spark):
    """Items with 10 to 30 % of their words changed, left out or put in, against the best alignment of every item with every whole text."""
    rng = random.Random(5)
    items = [(k, fixtures.prose(700 + k, 14 + k % 46)) for k in range(40)]
    data = []
    for k, text in items:
        for share in (0.1, 0.2, 0.3):
            words = []
            for w in text.split():
                kind = rng.random() / share
                words += [w] if kind > 1 else ["changed"] if kind < 0.5 else [] if kind < 0.75 else [w, "more"]
            data.append((len(data), fixtures.prose(k + 40, 40) + " " + " ".join(words) + " " + fixtures.prose(k + 90, 40)))
    data += [(len(data) + k, fixtures.prose(k + 5000, 120)) for k in range(20)]
    docs, bench = spark.createDataFrame(data, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.score for r in decontam.matches(docs, bench).collect()}
    number: dict = {}
    plain = lambda t: np.array([number.setdefault(w, len(number)) for w in re.findall(r"[a-z]+", t.lower())], np.uint64)
    own, texts = [plain(t) for _, t in items], [plain(t) for _, t in data]
    want = {(d, k): s for d, t in enumerate(texts) for k, w in enumerate(own) if (s := decontam.align(w, t)[0] / (2 * len(w))) >= 0.5}
    assert len(want) >= 90 and set(got) <= set(want) and len(got) >= 0.95 * len(want)
    assert sum(abs(got[x] - want[x]) < 1e-9 for x in got) >= 0.98 * len(got)


# Classifiers


def held_out(df, labels, label):
    y = {r.doc_id: r[label] for r in labels.collect()}
    got = [(r.score, y[r.doc_id], r.predicted) for r in df.where("held_out").collect() if r.doc_id in y]
    pos, neg = [s for s, v, _ in got if v == 1], [s for s, v, _ in got if v == 0]
    auc = np.mean([(a > b) + 0.5 * (a == b) for a in pos for b in neg])
    return auc, np.mean([p == v for _, v, p in got])


def test_held_out_accuracy(spark):
    sf = SF.replace("sf0.001", "sf0.01")
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    auc, right = held_out(toxicity.digest(docs, labels), labels, "toxic")
    assert auc > 0.93 and right > 0.93
    auc, right = held_out(quality_crf.digest(docs, labels), labels, "quality")
    assert auc > 0.97 and right > 0.95


def test_counterfactual_penalty_clears_neutral_mentions(spark):
    """Where a group's name goes with toxic labels, the penalty takes the weight off the name and leaves it on the insult."""
    rng = random.Random(1)
    data = []
    for k in range(400):
        bad = k % 2
        group = "muslims" if rng.random() < (0.9 if bad else 0.1) else "christians"
        data.append((k, f"{group} {'idiotic' if bad and rng.random() < 0.8 else 'calm'} {fixtures.prose(k, 6)}", bad))
    docs = spark.createDataFrame([(d, t) for d, t, _ in data] + [(9000, "muslims met today"), (9001, "christians met today"), (9002, None), (9003, "")], "doc_id long, text string")
    labels = spark.createDataFrame([(d, y) for d, _, y in data] + [(None, 1), (5, None)], "doc_id long, toxic int")
    gap = {}
    for fairness in (0.0, 50.0):
        model = toxicity.fit(docs, labels, fairness=fairness)
        got = {r.doc_id: r.score for r in toxicity.score(docs, model).where("doc_id >= 9000").collect()}
        gap[fairness] = got[9000] - got[9001]
        assert got[9002] == got[9003]
        gap["all", fairness] = toxicity.group_gap(model)
    assert gap["all", 50.0] < gap["all", 0.0] / 2
    assert gap[0.0] > 0.3 and gap[50.0] < gap[0.0] / 2


def test_fit_equals_the_texts_written_out():
    """Features of mentions and swaps put together from parts, and the sparse solver, against whole texts and a dense solver."""
    rng = np.random.default_rng(5)
    words = ["alpha", "beta", "women", "black", "awful", "gamma", "delta", "men", "Muslims", "jewish"]
    texts = [" ".join(rng.choice(words, rng.integers(0, 7))) for _ in range(60)] + ["", "awful", "alphabet, women"]
    sample = {i: int("awful" in t) for i, t in enumerate(texts)}
    terms = [t for g in toxicity.IDENTITY for t in g]
    vocabulary = np.unique(toxicity.features(pa.array([*words[:7], *terms], pa.string()))[1])
    swap, n = toxicity.swapper(), len(vocabulary)
    numbers = lambda some: toxicity._numbers(vocabulary, some)
    rows = []
    for i, t in enumerate(texts):
        a, b = numbers([t])[0], swap(t)
        b = None if b is None else numbers([b])[0]
        rows.append((i, a.tobytes(), None if b is None else np.setdiff1d(a, b).tobytes(), None if b is None else np.setdiff1d(b, a).tobytes()))
    got = toxicity._regress(*toxicity._learnt(rows, sample, toxicity.Mentions.of(vocabulary, toxicity.IDENTITY), n), n, 3.0, rounds=40)

    def dense(some):
        x = np.zeros((len(some), n))
        for i, at in enumerate(numbers(some)):
            x[i, at] = 1
        return x

    told = [(sample[i], t + toxicity.MENTION.format(terms[toxicity.mentioned(i, len(terms))])) for i, t in enumerate(texts) if swap(t) is None]
    x, y = dense([*texts, *(t for _, t in told)]), np.array([*sample.values(), *(k for k, _ in told)], float)
    pairs = [(t, swap(t)) for t in [*(t for _, t in told), *texts] if swap(t) is not None]
    gaps = dense([a for a, _ in pairs]) - dense([b for _, b in pairs])
    w, c = np.zeros(n), np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6))
    m, v = np.zeros(n + 1), np.zeros(n + 1)
    for step in range(1, 41):
        e = 1 / (1 + np.exp(-(x @ w + c))) - y
        grad = np.append(x.T @ e / len(y) + 1e-5 * w + 2 * 3.0 / len(pairs) * gaps.T @ (gaps @ w), e.mean())
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
        move = 0.05 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        w, c = w - move[:n], c - move[n]
    assert len(told) > 10 and len(pairs) > len(told) + 10
    assert np.allclose(got[0], w, atol=1e-6) and abs(got[1] - c) < 1e-6


def test_classifier_edges(spark):
    docs = fixtures.frame(spark, clash=True)
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    same_kind = spark.createDataFrame([(0, 1, 1), (3, 1, 1), (3, 1, None)], "doc_id long, quality int, toxic int")
    for labels in (none, same_kind):
        for digest in (toxicity.digest, quality_crf.digest):
            got = digest(docs, labels).collect()
            assert len(got) == len(fixtures.documents()) and len({r.score for r in got}) == 1 and all(0 <= r.score <= 1 and r.held_out is not None for r in got)
            assert digest(docs.limit(0), labels).count() == 0


def test_forward_backward_equals_enumeration():
    import itertools

    rng = np.random.default_rng(2)
    good, steps, first = rng.normal(size=9), rng.normal(size=(2, 2)), np.array([0, 1, 5])
    p, pair, logz = quality_crf.marginals(good, steps, first)
    total, edge, z_all = np.zeros(9), np.zeros((2, 2)), 0.0
    for a, b in zip(first, [1, 5, 9]):
        z, own, pairs = 0.0, np.zeros(b - a), np.zeros((2, 2))
        for y in itertools.product((0, 1), repeat=b - a):
            w = np.exp(sum(good[a + i] * v for i, v in enumerate(y)) + sum(steps[u, v] for u, v in zip(y, y[1:])))
            z += w
            own += w * np.array(y)
            for u, v in zip(y, y[1:]):
                pairs[u, v] += w
        total[a:b], z_all = own / z, z_all + np.log(z)
        edge += pairs / z
    assert np.allclose(p, total) and np.allclose(pair, edge) and np.isclose(logz, z_all)


def test_line_features_count_lines():
    import pyarrow as pa

    texts = ["", "a\nb\n", "\n", "x", None, "é É\nZ"]
    data, offsets = common.utf8(pa.array(texts))
    x, length, first = quality_crf.lines(data, offsets)
    sizes = np.diff(np.append(first, len(x)))
    assert sizes.tolist() == [len((t or "").split("\n")) for t in texts]
    assert length.tolist() == [len(line) + 1 for t in texts for line in (t or "").split("\n")]


# Fingerprints


def walk(text):
    c = fingerprint._classes(text)
    level, out = fingerprint.level_of(len(text)), []
    symbol = (fingerprint.mix64(np.arange(256, dtype=np.uint64) + np.uint64(77)) % np.uint64(15)).astype(int) + 1
    for moves in fingerprint._MOVES:
        i = step = 0
        digits, picked = "", fingerprint._levels(8 * len(text) + 5000)
        while i < len(text):
            if picked[step] >= level:
                digits += "0123456789abcdef"[symbol[c[i]]]
            i += moves[step % fingerprint.PERIOD, c[i]]
            step += 1
        out.append(digits)
    return f"{level:02x}:" + ":".join(out)


def test_fingerprint_query_equals_serial_walks(spark):
    rows_ = sorted(unique(fixtures.documents()), key=lambda r: r[0])
    got = {r.doc_id: r for r in fingerprint.digest(fixtures.frame(spark, rows_, clash=True), batch_chars=500).collect()}
    for k, (d, t, *_) in enumerate(rows_):
        t, following = t or "", rows_[(k + 1) % len(rows_)][1] or ""
        edited = t[: len(t) - len(t) // 2] + following[: len(t) // 2]
        r = got[d]
        assert (r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint) == (len(t), hashlib.sha256(edited.encode()).hexdigest(), walk(t), walk(edited))
        assert r.near_edited == fingerprint.likeness(walk(t), walk(edited)) and r.near_next == fingerprint.likeness(walk(t), walk(following))
    assert fingerprint.digest(fixtures.frame(spark)).count() == len(fixtures.documents()) and fingerprint.digest(fixtures.frame(spark, [])).count() == 0


def test_likeness_follows_edits():
    rng = random.Random(5)
    near, far = [], []
    for k in range(40):
        t = fixtures.prose(k, 400)
        p = rng.randrange(len(t))
        near.append(fingerprint.likeness(*fingerprint.fingerprints([t, t[:p] + "x" + t[p + 2 :]])))
        far.append(fingerprint.likeness(*fingerprint.fingerprints([t, fixtures.prose(k + 1000, 400)])))
    assert np.median(near) > 0.9 and np.max(far) < 0.5 and np.median(far) < 0.2
    assert fingerprint.likeness("00::", "00::") == 1


def test_likeness_outlives_one_wide_character():
    for k, wide in enumerate("\u2019\u2013\u20ac\u4e2d\U0001f44d\u0100"):
        t = fixtures.prose(k, 400)
        p = len(t) // 2
        before, after = t[:p] + "'" + t[p:], t[:p] + wide + t[p:]
        assert (np.delete(fingerprint._classes(after), p) == fingerprint._classes(t)).all()
        assert fingerprint.likeness(*fingerprint.fingerprints([before, after])) > 0.8
    assert len(fingerprint._classes("")) == 0 and fingerprint._classes("\0\xff\u01fe").min() > 0


def test_near_pairs(spark):
    texts = {k: fixtures.prose(k, 300) for k in range(10)} | {20: fixtures.prose(0, 300) + " end", 21: fixtures.prose(1, 300), 30: "", 31: None}
    docs = spark.createDataFrame([(k, t) for k, t in texts.items()], "doc_id long, text string")
    pairs = {(r.a, r.b) for r in fingerprint.near_pairs(fingerprint.digest(docs)).collect()}
    assert pairs == {(0, 20)}


def test_near_pairs_behind_a_strange_head(spark):
    # Document 0 shares its opening, and so its first bands, with all others and is near none of them.
    opening = fixtures.prose(99, 120)
    texts = {0: opening + " " + fixtures.prose(100, 280)}
    for k in range(1, 9):
        own = opening + " " + fixtures.prose(k, 280)
        texts |= {10 * k: own, 10 * k + 1: own + " end", 10 * k + 2: own[:-9] + " last"}
    prints = fingerprint.digest(spark.createDataFrame([*texts.items(), (200, ""), (201, None), (None, opening)], "doc_id long, text string")).cache()
    own = {r.doc_id: r.fingerprint for r in prints.collect() if r.doc_id in texts}
    stands = {d: min(x for x in own if own[x] == own[d]) for d in own}
    heads = {}
    for r in fingerprint.band_rows(prints.where("doc_id < 200")).collect():
        heads[r.level, r.place, r.key] = heads.get((r.level, r.place, r.key), set()) | {r.doc_id}
    met = {(a, b) for band in heads.values() for a in band for b in band if a < b and a == stands[a] and b == stands[b]}
    want = {(a, b): near for a, b in met if (near := fingerprint.likeness(own[a], own[b])) >= 0.8}
    copies = {tuple(sorted((stands[10 * k + i], stands[10 * k + j]))) for k in range(1, 9) for i, j in ((0, 1), (0, 2), (1, 2))}
    assert {(a, b) for a, b in copies if a != b} <= set(want) and len(want) > 12
    assert all(band == {*texts} for band in heads.values() if len(band) > 20) and any(len(band) > 20 for band in heads.values())
    for part in (fingerprint.PART, 4):
        got = [(r.a, r.b, r.likeness) for r in fingerprint.near_pairs(prints, part=part).collect()]
        assert {(a, b): near for a, b, near in got} == want and len(got) == len(want)


def by_links(texts, least=0.8):
    """Each row's class by the likeness of all pairs, and the linked pairs. texts: (id, text)."""
    prints = fingerprint.fingerprints([t or "" for _, t in texts])
    root = list(range(len(texts)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    pairs = [(i, j) for i in range(len(texts)) for j in range(i) if fingerprint.likeness(prints[i], prints[j]) >= least]
    for i, j in pairs:
        root[top(i)] = top(j)
    return [top(i) for i in range(len(texts))], pairs


def test_near_classes_against_all_pairs(spark):
    # 100 texts of unlike lengths, and copies with 1 to 10 % of their words replaced, lost or put in.
    rng, texts = random.Random(11), []
    for k in range(100):
        base = fixtures.prose(k, 80 + 40 * (k % 9)).split(" ")
        texts.append((100 * k, " ".join(base)))
        for c in range(1, 8):
            own = list(base)
            for _ in range(max(1, len(own) * rng.randint(1, 10) // 100)):
                p = rng.randrange(len(own))
                own[p : p + 1] = rng.choice(([], ["other"], [own[p], "more"]))
            texts.append((100 * k + c, " ".join(own)))
    want, pairs = by_links(texts)
    got = {r.doc_id: r.class_id for r in fingerprint.near_classes(spark.createDataFrame(texts, "doc_id long, text string")).collect()}
    found = sum(got[texts[i][0]] == got[texts[j][0]] for i, j in pairs)
    assert len(pairs) > 200 and found >= 0.97 * len(pairs)
    # Whatever is together is linked.
    together = {(w, got[d]) for w, (d, _) in zip(want, texts)}
    assert len(got) == len(texts) and len({c for _, c in together}) == len(together)


def test_near_classes_of_crowded_bands_and_odd_rows(spark):
    opening = fixtures.prose(99, 120)
    texts = [(0, opening + " " + fixtures.prose(100, 280))]
    for k in range(1, 9):
        own = opening + " " + fixtures.prose(k, 280)
        texts += [(10 * k, own), (10 * k + 1, own + " end"), (10 * k + 2, own[:-9] + " last")]
    odd = fixtures.prose(500, 200)
    # Two different texts under one id, a null id near one of them, and no text.
    texts += [(200, ""), (201, None), (202, "ab"), (203, "ab"), (300, odd), (300, fixtures.prose(501, 200)), (None, odd + " end"), (None, fixtures.prose(502, 200))]
    want, _ = by_links(texts)
    least = {w: min((d for v, (d, _) in zip(want, texts) if v == w and d is not None), default=None) for w in want}
    expected = sorted(((d, least[w]) for w, (d, _) in zip(want, texts)), key=str)
    for part in (fingerprint.PART, 4):
        got = fingerprint.near_classes(spark.createDataFrame(texts, "doc_id long, text string").withColumn("name", F.lit("x")), part=part)
        assert sorted(((r.doc_id, r.class_id) for r in got.collect()), key=str) == expected
    assert fingerprint.near_classes(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_near_classes_of_links_that_only_crowded_bands_hold(spark):
    # One long opening, tails of two and two alike but for every ninth word: no part holds the opening's bands.
    rng = random.Random(4)
    words = lambda n: ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(3, 8))) for _ in range(n)]
    head, texts = words(110), []
    for k in range(30):
        tail = words(60)
        texts.append((10 * k, " ".join(head + tail)))
        for at in range(4, len(tail), 9):
            tail[at] = words(1)[0]
        texts.append((10 * k + 1, " ".join(head + tail)))
    want, pairs = by_links(texts)
    # Whatever is linked shares a band here, so nothing may be lost, however bands and crowds are dealt.
    least = {w: min(d for v, (d, _) in zip(want, texts) if v == w) for w in want}
    got = fingerprint.near_classes(spark.createDataFrame(texts, "doc_id long, text string"), part=4)
    assert len(pairs) >= 15 and {r.doc_id: r.class_id for r in got.collect()} == {d: least[w] for w, (d, _) in zip(want, texts)}


def test_crowded_bands_are_compared_whole(spark, monkeypatch):
    prints = list(dict.fromkeys(fingerprint.fingerprints([fixtures.prose(k, 60 + 3 * k) + end for k in range(40) for end in ("", " and five other words more")])))
    level = max(int(f[:2], 16) for f in prints)
    own = [(k, f) for k, f in enumerate(prints) if int(f[:2], 16) >= level - 1]
    want = {(a, b) for a, f in own for b, g in own if a < b and fingerprint.likeness(f, g) >= 0.8}
    frame = spark.createDataFrame([(7, level, k, len(own), f) for k, f in own], "key long, level int, name long, n long, fingerprint string")
    monkeypatch.setattr(fingerprint, "HELD", 5)
    for part, crowd in ((4, 7), (100, 100)):
        got = fingerprint._crowded_links(frame, frame, frame.select("name", "fingerprint"), 0.8, part, crowd)
        assert len(want) >= 10 and sorted(tuple(r) for r in got.collect()) == sorted(want)


# WARC


def test_warc_reconstructs_every_record(spark, tmp_path):
    page = "<p>" + "x" * 1200 + "</p>"
    pages = spark.createDataFrame([(1, "http://a", page), (2, "http://b", page), (5, None, page), (3, "http://c", "small"), (4, "http://d", "small"), (6, "u", None), (7, "u", ""), (None, "http://n", page), (5, "again", page), (8, "é", "é" * 600)], "page_id long, url string, html string").select("*", *[F.lit("x").alias(c) for c in ("header", "payload", "sha256", "n", "share", "number", "keeper", "record")])
    path = f"file://{tmp_path}/w"
    warc.write(pages, path)
    got = warc.read(spark, path).collect()
    kinds = collections.Counter((r.page_id, r.record_type, r.refers_to, r.payload_bytes) for r in got)
    assert kinds == collections.Counter({(1, "revisit", 5, 1207): 1, (2, "revisit", 5, 1207): 1, (None, "revisit", 5, 1207): 1, (5, "response", None, 1207): 2, (3, "response", None, 5): 1, (4, "response", None, 5): 1, (6, "response", None, 0): 1, (7, "response", None, 0): 1, (8, "response", None, 1200): 1})
    assert len({r.record_id for r in got}) == len(got) and {r.target_uri for r in got} == {"http://a", "http://b", "http://c", "http://d", "http://n", "u", "again", "é", None}
    assert all(hashlib.sha1(bytes(r.payload)).hexdigest() == r.payload_digest for r in got if r.record_type == "response")
    assert spark.read.parquet(f"{path}/payloads").count() == 4
    # Hot small payloads in shares.
    warc.write(pages, path + "2", share_rows=1)
    again = collections.Counter((r.page_id, r.record_type, r.refers_to, r.payload_bytes) for r in warc.read(spark, path + "2").collect())
    assert again == kinds and spark.read.parquet(f"{path}2/payloads").count() == 4
    ids = spark.createDataFrame([(x,) for x in (0, 1, -1, 2**63 - 1, -(2**63), 12345678901234, None)], "id long").select("id", warc.record_id(F.col("id"), F.lit(2**55 + 3)).alias("name"))
    assert all(r.id == r.page and re.fullmatch(r"<urn:uuid:[0-9a-f]{8}-[0-9a-f]{4}-8[0-9a-f]{3}-[89][0-9a-f]{3}-[0-9a-f]{12}>", r.name) for r in ids.withColumn("page", warc.page_of(F.col("name"))).collect())
    for r in warc.records(spark, path).collect():
        head, http, body = bytes(r.record).split(b"\r\n\r\n", 2)
        assert head.startswith(b"WARC/1.1\r\n") and body.endswith(b"\r\n\r\n")
        assert int(re.search(rb"Content-Length: (\d+)", head)[1]) == len(http) + 4 + len(body) - 4
    warc.export(spark, path, f"file://{tmp_path}/out")
    data = b"".join(p.read_bytes() for p in sorted((tmp_path / "out").glob("*.txt")))
    seen = 0
    while data:
        head, rest = data.split(b"\r\n\r\n", 1)
        n = int(re.search(rb"Content-Length: (\d+)", head)[1])
        assert rest[n : n + 4] == b"\r\n\r\n"
        data, seen = rest[n + 4 :], seen + 1
    assert seen == 10
    assert warc.round_trip(pages.limit(0)).count() == 0


def test_warc_notices_damage(spark, tmp_path):
    path = f"file://{tmp_path}/w"
    warc.write(spark.createDataFrame([(1, "u", "x" * 2000)], "page_id long, url string, html string"), path)
    bad = spark.createDataFrame([("00", "00", bytearray(b"x"))], "sha256 string, sha1 string, payload binary")
    with pytest.raises(Exception, match="does not match its address"):
        warc._verified(bad).collect()
    record = bytes(warc.records(spark, path).first().record)
    for broken in (record[:-1], record.replace(b"xxx", b"xxy", 1), record.replace(b"Content-Length: 2000", b"Content-Length: 1999", 1), b"", record[5:]):
        with pytest.raises(Exception, match="does not match its header"):
            warc.parse(spark.createDataFrame([(bytearray(broken),)], "record binary")).collect()


# HTML


def test_warc_urls_with_line_breaks(spark):
    odd = ["http://x/a\r\nContent-Length: 5", "http://x/\tä\x00b\x7f", "\r\n\r\nWARC/1.1", "", None, "http://x/%0D plain"]
    pages = spark.createDataFrame([(k, u, "x" * 1500 if k % 2 else "y") for k, u in enumerate(odd)], "page_id long, url string, html string")
    path = f"{common.shared_dir(spark)}/warc-odd"
    warc.write(pages, path)
    got = {r.page_id: (r.target_uri, r.payload_bytes) for r in warc.read(spark, path).collect()}
    coded = ["http://x/a%0D%0AContent-Length: 5", "http://x/%09ä%00b%7F", "%0D%0A%0D%0AWARC/1.1", None, None, "http://x/%0D plain"]
    assert got == {k: (u, 1500 if k % 2 else 1) for k, u in enumerate(coded)}


def test_html_extraction_on_whole_pages(spark):
    import html

    pages = spark.read.parquet(f"{SF}/pages.parquet")
    got = {r.page_id: r for r in html_extract.digest(pages).collect()}
    for r in pages.collect():
        article = re.search(r"<article>(.*?)(</article>|$)", r.html, re.S)[1]
        want = " ".join(html.unescape(re.sub(r"<[^>]*(>|$)", " ", re.sub(r"</?b>", "", article))).split())
        assert got[r.page_id].text == want and got[r.page_id].n_chars == len(want)


PAGE = """<html><body><header><h1>Site</h1></header><nav><a href=x>Home</a></nav><div id="cookie-notice">We use cookies, many of them</div><div class="layout"><div class="main-content"><h2>Head</h2>
<p>First paragraph of text, with commas, and enough length to count.</p><p>Second &amp; last paragraph of the <i>art</i>icle, also long enough.<script>var x = "<p>no</p>";</script></p><p>Short.</p><ul><li><a href=a>more stories here</a><li><a href=b>and there</a></ul></div>
<div class="sidebar"><p>Buy this thing now, it is very good and cheap for all of you.</p></div></div><div class="comments"><p>Great article, thanks, I have read it twice and liked it.</p></div><form><p>Name, mail, and so on for the contact form here</p></form><footer>foot</footer></body></html>"""


def test_html_extraction_without_an_article_element(spark):
    assert html_extract.main_text(PAGE) == "Head First paragraph of text, with commas, and enough length to count. Second & last paragraph of the article, also long enough. Short."
    for page, text in ((None, ""), ("", ""), (" \n", ""), ("<p>", ""), ("a < b", "a < b"), ("<div>x", "x"), ("<script>x", ""), ("<p>hi &lt;there&gt; <b>bo</b>ld<br>x", "hi <there> bold x"), ("<a href='x", ""), ("<p>x</p>" * 20000, " ".join("x" * 20000))):
        assert html_extract.main_text(page) == text
    df = spark.createDataFrame([(1, "u", PAGE), (1, "u", PAGE), (None, None, None)], "page_id long, url string, html string")
    assert html_extract.digest(df).count() == 3 and html_extract.digest(df.limit(0)).count() == 0


LONG = "A sentence of the story itself, long enough to count as a paragraph of its own."


@pytest.mark.parametrize(
    "inside",
    [
        '<a href="x"">link</a> the middle', "<p title=it's>quoted</p><p>more</p>", '<p a"b=c \'d\' = >odd</p>', '<img alt="a > b" src=x/>seen', "<p class='alert-sentence'>alert</p>", '<section class="search-results"><p>found</p></section>',
        '<p class="comment">a remark</p>', '<section class="social-history"><p>old</p></section>', "<h2>Sources</h2><ul><li><a href=a>First source</a></li><li><a href=b>Second source</a></li></ul>", "<table><tr><td>1<td>2</table>", "<br/>after<hr>rule", "<header><h1>Title</h1></header>",
    ],
)
def test_html_extraction_drops_nothing_of_an_article(inside):
    import html

    want = " ".join(re.sub(r"<(?:[^>\"']|\"[^\"]*\"|'[^']*')*>|<[^>]*>", " ", inside.replace('x""', "x").replace("it's", "its").replace('a"b', "ab").replace("alt=\"a > b\"", "")).split())
    page = f"<html><body><nav>menu</nav><article><p>{LONG}</p>{inside}<p>{LONG}</p></article><footer>foot</footer></body></html>"
    assert html_extract.main_text(page) == f"{LONG} {html.unescape(want)} {LONG}"


@pytest.mark.parametrize("inside", ['<div class="comments"><p>nice</p></div>', '<div class="ad">buy</div>', "<section id=comments>x</section>", '<div class="social-share">x</div>', '<aside>x</aside>', '<p class="advert">x</p>', '<div class="related-posts"><p>x</p></div>', "<form>x</form>", "<p hidden>x</p>", "<div class=newsletter-signup-box>x</div>"])
def test_html_extraction_drops_what_is_not_the_article(inside):
    assert html_extract.main_text(f"<article><p>{LONG}</p>{inside}<p>{LONG}</p></article>") == f"{LONG} {LONG}"


def test_html_extraction_keeps_siblings_by_what_they_are():
    best = "".join(f"<p>{LONG}, {k}.</p>" for k in range(6))
    for beside, text in (("<h3>Head</h3>", "Head "), ("<ul><li>one<li>two</ul>", "one two "), ("bare <i>te</i>xt", "bare text "), ("<p><a href=x>short</a></p>", "short "), ("<section><p>small</p></section>", "small "), ("<blockquote>said</blockquote>", "said "), ("<ul><li><a href=a>menu</a></ul>", ""), ("<div class=sidebar>x</div>", "")):
        assert html_extract.main_text(f"<body><div>{beside}<div>{best}</div></div></body>") == text + " ".join(f"{LONG}, {k}." for k in range(6))


@pytest.mark.parametrize("wrapper", ['div class="content has-sidebar"', 'div class="site no-sidebar header-fixed"', 'div id="menu-open"', 'div class="cookie-consent-enabled"', "form", 'div class="sidebar-layout"', 'form id="search"'])
def test_html_extraction_keeps_wrapped_articles(wrapper):
    tag = wrapper.split()[0]
    for inner in (f"<article><p>{LONG}</p></article>", f"<div><p>{LONG}</p><p>{LONG}</p></div>"):
        page = f'<body><nav>Home</nav><{wrapper}>{inner}</{tag}><div class="related"><p>Read this as well, it is another page.</p></div></body>'
        assert html_extract.main_text(page) == " ".join([LONG] * inner.count("<p>"))


def test_html_extraction_leaves_comments_and_fields_out():
    many = "".join(f'<article class="comment"><p>Reader {k} says {LONG}</p></article>' for k in range(5))
    for own in (many, f'<section class="comments">{many}</section>', f'<div id="comments">{many.replace("article", "div")}</div>'):
        assert html_extract.main_text(f"<body><div><p>{LONG}</p><p>Second.</p></div>{own}</body>") == f"{LONG} Second."
    form = "<form><label>Name</label><p>Sign up to our weekly letter here.</p><input></form>"
    assert html_extract.main_text(f"<body><div><p>{LONG}</p>{form}<p>{LONG}</p></div></body>") == f"{LONG} {LONG}"
    assert html_extract.main_text(f'<body><article class="post comments-open"><p>{LONG}</p></article></body>') == LONG


def test_html_extraction_keeps_short_siblings():
    best = "".join(f"<p>{LONG}, {k}.</p>" for k in range(6))
    text = " ".join(f"{LONG}, {k}." for k in range(6))
    assert html_extract.main_text(f"<body><div><div>{best}</div><div><p>Short.</p></div></div></body>") == f"{text} Short."
    assert html_extract.main_text(f"<body><div><div><p>Short.</p></div><div>{best}</div><div><span>Copyright 2020</span></div></div></body>") == f"Short. {text}"
    assert html_extract.main_text(f"<body><div><div>{best}</div><div><span>Middle part</span></div><p>End.</p></div></body>") == f"{text} Middle part End."


def test_html_extraction_is_linear():
    took = {}
    for n in (20_000, 80_000):
        began = time.perf_counter()
        page = "<div>" * n + f"<p>{LONG}" + "</b>" * n + "<i><p>x" * n + "<a href='" * 9
        assert html_extract.main_text(page).startswith(LONG)
        took[n] = time.perf_counter() - began
    assert took[80_000] < 12 * took[20_000] and took[80_000] < 30


# Chat


def test_segments_decode_as_one_viterbi_run(spark, monkeypatch):
    conv = spark.read.parquet(f"{SF}/conversations.parquet")
    parts = chat.as_transcripts(conv)
    model = chat.fit(parts)
    monkeypatch.setattr(chat, "SEGMENT", 2)
    got = collections.defaultdict(list)
    for r in sorted(chat.parse(parts, model).collect(), key=lambda r: (r.conv_id, r.segment, r.row, r.pos)):
        got[r.conv_id].append((r.role, r.begins))
    texts = collections.defaultdict(list)
    for r in parts.collect():
        texts[r.conv_id].append((r.part, r.text))
    right = 0
    for conv_id, own in texts.items():
        seen = [chat.look(line) for _, t in sorted(own) for line in t.split("\n")]
        path, _ = chat.viterbi(model.start, model.move, model.emit(seen))
        assert got[conv_id] == [(chat.ROLES[s // 2], s % 2 == 0) for s in path]
    truth = collections.defaultdict(list)
    for r in conv.orderBy("conv_id", "turn").collect():
        truth[r.conv_id].append(r.role)
    for r in truth:
        right += [role for role, begins in got[r] if begins] == truth[r]
    assert right >= 0.75 * len(truth)
    lines = chat.render(chat.parse(parts, model)).agg(F.sum("n_right"), F.sum("n_lines")).first()
    assert lines[0] > 0.9 * lines[1]


def test_chat_edges(spark):
    df = spark.createDataFrame([(1, 0, "user", "Hello there, how are you?"), (1, 1, "assistant", None), (1, None, "system", ""), (None, 0, "narrator", "x"), (2, 5, None, "a\nb"), (2, 5, None, "a\nb")], "conv_id long, turn long, role string, text string").withColumn("segment", F.lit(1))
    got = chat.digest(df).collect()
    assert sum(r.n_lines for r in got) >= 6 and all(r.rendered.startswith(f"<|{r.role}|>\n") and r.rendered.endswith("\n<|end|>") for r in got)
    # One unmarked transcript of many parts is one turn in chunks, which are the turn when joined.
    parts = spark.createDataFrame([(7, k, "user", ("User:  \n" if not k else "") + f"line {k} of a long talk\nand its end ") for k in range(300)], "conv_id long, turn long, role string, text string")
    model = chat.fit(parts.withColumnRenamed("turn", "part").withColumn("part", F.col("part") * 0))
    lines = chat.parse(parts.withColumnRenamed("turn", "part"), model).withColumn("turn", F.lit(0).cast("long"))
    chunks = sorted(chat.render(lines).collect(), key=lambda r: r.chunk)
    assert len(chunks) == 5 and max(r.n_lines for r in chunks) <= 2 * chat.SEGMENT + 1 and sum(r.n_right for r in chunks) > 0
    whole = "\n".join(r.line for r in sorted(lines.collect(), key=lambda r: (r.segment, r.row, r.pos))).strip(" \t\r\n")
    assert "".join(r.rendered for r in chunks) == f"<|{chunks[0].role}|>\n{whole}\n<|end|>"
    assert chat.digest(df.limit(0)).count() == 0
    assert chat.look("### Human:")[0] == 1 and chat.look("**Context:** x")[3] == "x" and chat.look("That is: so")[0] == 4


# Pipeline


def test_pipeline_stages_keep_what_they_should(spark):
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = docs
    for k, (_, stage) in enumerate(p.STAGES):
        before, kept = kept, common.materialize(stage(spark, kept, SF), "t")
        if k < 4:
            assert kept.columns == docs.columns and kept.dtypes == docs.dtypes
        assert 0 < kept.count() <= before.count()
        if k == 1:
            import pandas as pd

            local = pd.DataFrame([r.asDict() for r in before.collect()])
            want = {r[0]: r[1] for r in expected(f"SELECT doc_id, kept_sha256 FROM ({line_dedup.ORACLE}) t", views={"documents": local})}
            assert {r.doc_id: hashlib.sha256(r.text.encode()).hexdigest() for r in kept.collect()} == want
        if k == 2:
            local = before.collect()
            groups = brute_groups([r.doc_id for r in local], [r.text for r in local])
            assert {r.doc_id for r in kept.collect()} == {c for _, c in groups.values()}
    assert {r.doc_id: r.decoded_sha256 for r in kept.collect()} == {r.doc_id: hashlib.sha256(r.text.encode()).hexdigest() for r in before.collect()}
    assert rows(p.run(spark, SF).select("doc_id", "ids_sha256")) == rows(kept.select("doc_id", "ids_sha256"))


def test_pipeline_on_odd_rows(spark):
    import corpus_pipeline as p

    docs = fixtures.frame(spark)
    for _, stage in p.STAGES:
        docs = common.materialize(stage(spark, docs, SF), "t")
    assert docs.count() > 0
    empty = fixtures.frame(spark, [])
    for _, stage in p.STAGES:
        empty = common.materialize(stage(spark, empty, SF), "t")
    assert empty.count() == 0
