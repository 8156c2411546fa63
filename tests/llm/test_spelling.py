"""Spelling variants against words one edit apart, found by leaving out letters."""

import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from lumenfare.llm import queries, spelling
from tests.llm import fixtures
from tests.oracle import SF

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(docs):
    n = Counter()
    for d, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOW)
            h = zlib.crc32(f"{'' if d is None else d}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    n = {w: k for w, k in n.items() if len(w) >= 5 and k >= 3}
    left = defaultdict(set)
    for w in n:
        for v in {w, *(w[:i] + w[i + 1 :] for i in range(len(w)))}:
            left[v].add(w)

    def near(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b)) == 1
        a, b = sorted((a, b), key=len)
        return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))

    own = {w: {x for v in {w, *(w[:i] + w[i + 1 :] for i in range(len(w)))} for x in left[v] if near(w, x)} for w in n}
    form = {}
    for w, k in n.items():
        best = min(own[w], key=lambda x: (-n[x], x), default=None)
        form[w] = best if best is not None and n[best] >= 2 * k else None

    def root(w):
        while form[w] is not None:
            w = form[w]
        return w

    return {(w, k, len(own[w]), form[w], n.get(form[w]), root(w)) for w, k in n.items()}


def got(df):
    return {(r.word, r.n, r.n_near, r.form, r.form_n, r.root) for r in df.collect()}


def test_query_equals_brute_force_on_the_whole_table(spark):
    sf = SF.replace("sf0.001", "sf0.01")
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    df = queries.QUERIES["op12_spelling"](spark, sf)
    want = brute(docs)
    assert got(df) == want and df.count() == len(want) > 100
    assert any(f for *_, f, _, _ in want)


def vocabulary():
    """Words of few letters, so that many are near, in chains of growing counts."""
    rng = random.Random(4)
    some = {"".join(rng.choice("abé") for _ in range(rng.randrange(5, 9))) for _ in range(250)} | {"aaaaa", "aaaaaa", "aaaaaaa", "àéîõü×÷ÿ", "b" * 3000, "b" * 2999}
    return [(w, 3 + int(rng.expovariate(0.08))) for w in sorted(some)]


@pytest.mark.parametrize("how", [{}, {"frequent": 3, "q_max": 4}, {"frequent": 1, "q_max": 6, "dictionary": 4}, {"most": 0}, {"frequent": 2, "most": 10**6}])
def test_any_dictionary_gives_the_same_pairs(spark, how):
    own = [(k, " ".join([w] * n)) for k, (w, n) in enumerate(vocabulary())]
    df = spelling.variants(fixtures.frame(spark, [(d, t, "en", "s", 0) for d, t in own]), **how)
    assert got(df) == brute(own)


def test_both_ways_take_part(spark):
    words = spark.createDataFrame(vocabulary(), "word string, n long")
    for frequent, some in ((3, True), (10**9, True)):
        known = spelling.frequent_grams(words, frequent=frequent)
        looked = spelling.lookups(spelling.index(words, known)).select(F.expr("count_if(lists is null)"), F.count("*")).first()
        assert bool(known) == (frequent == 3) and looked[0] < looked[1]
    # The dictionary's bound holds whatever `frequent` is.
    assert len(spelling.frequent_grams(words, frequent=1, dictionary=5)) < 32


def test_affected_grams_bound_every_edit():
    rng = random.Random(6)
    known = {"".join(rng.choice("ab") for _ in range(rng.randrange(2, 5))) for _ in range(20)}
    for _ in range(300):
        w = "".join(rng.choice("abc") for _ in range(rng.randrange(5, 10)))
        grams = spelling.decompose(w, known, 2, 6)
        most = spelling.affected(grams, len(w))
        for i in range(len(w) + 1):
            for x in {w[:i] + w[i + 1 :], *(w[:i] + c + w[i:] for c in "abc"), *(w[:i] + c + w[i + 1 :] for c in "abc")} - {w}:
                more = len(x) - len(w)
                there = {(a, x[a:b]) for a, b, _ in spelling.decompose(x, known, 2, 6)}
                lost = sum((a, w[a:b]) not in there and (a + more, w[a:b]) not in there for a, b, _ in grams)
                assert lost <= most


def test_edges(spark):
    own = [(d, t) for d, t, *_ in fixtures.documents()] * 2 + [(None, "Straße straße STRASSE strasse ſtrasse"), (None, "straße strasse")] * 3 + [(1, None), (2, "")]
    df = fixtures.frame(spark, [(d, t, "en", "s", 0) for d, t in own], clash=True)
    assert got(spelling.variants(df)) == brute(own)
    assert spelling.variants(df.limit(0)).count() == 0
    assert spelling.variants(fixtures.frame(spark, [(1, None, "en", "s", 0)])).count() == 0
