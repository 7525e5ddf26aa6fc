import itertools
import random

import pytest

from shelfwright.llm import op01_minhash as op1
from shelfwright.llm.components import components

WORDS = [f"w{k}" for k in range(400)]


def make(seed=3):
    rng = random.Random(seed)
    text = lambda n: " ".join(rng.choice(WORDS) for _ in range(n))
    docs, passage = [], text(60)
    for _ in range(40):
        docs.append(text(rng.randint(1, 120)))
    base = text(150).split()
    for _ in range(70):  # a family of near copies, larger than a rare value's list
        copy = list(base)
        for _ in range(rng.randint(0, 3)):
            copy[rng.randrange(150)] = rng.choice(WORDS)
        docs.append(" ".join(copy))
    for _ in range(60):  # one passage in many documents
        docs.append(text(rng.randint(5, 80)) + "\n" + passage + "\n" + text(rng.randint(5, 40)))
    docs += [docs[0], docs[0].upper(), "", None, "one", "One", "one two", " \t "]
    return list(enumerate(docs))


def brute(rows):
    sets = {k: set(op1.shingles(t).tolist()) for k, t in rows}
    root = {k: k for k in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(sets, 2):
        both = len(sets[a] & sets[b])
        if sets[a] and sets[b] and 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return {k: (len(sets[k]), find(k)) for k in sets}


@pytest.mark.parametrize("rare", [40, 5])
def test_components_match_brute_force(spark, rare):
    rows = make()
    out = op1.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), rare=rare).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in out} == brute(rows)
    assert all(r.kept == (r.doc_id == r.component_id) for r in out)


def two_passages(seed=9):
    rng = random.Random(seed)
    text = lambda n: " ".join(f"v{rng.randrange(10**6)}" for _ in range(n))
    a, b, c, d = (text(40) for _ in range(4))
    docs = [one + " " + text(5) + " " + two for one, two in ((a, c), (b, d)) for _ in range(20)]  # many hold the first and something hotter
    docs += [f"{text(40)} {one}" for one in (c, d) for _ in range(30)]
    return list(enumerate(docs + [f"{a} {text(6)} {b}" for _ in range(3)]))


def test_near_copies_of_two_hot_passages(spark):
    rows = two_passages()
    out = op1.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), rare=5).collect()
    wanted = brute(rows)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in out} == wanted
    assert [wanted[k][1] for k, _ in rows[-3:]] == [rows[-3][0]] * 3


def shared_passage(seed=21):
    """Two families of near copies that share a passage of over half of each text; one is smaller and less central."""
    rng = random.Random(seed)
    text = lambda n: [f"u{rng.randrange(10**6)}" for _ in range(n)]
    passage, docs = text(120), []
    for size, n in ((86, 90), (86, 60), (70, 30)):
        own = text(size)
        for _ in range(n):
            copy = passage + own
            for _ in range(2):
                copy[rng.randrange(len(passage), len(copy))] = rng.choice(own)
            docs.append(" ".join(copy))
    docs += [" ".join((passage + text(86))[rng.randrange(20) :]) for _ in range(30)]  # the passage alone, no copies
    return list(enumerate(docs))


@pytest.mark.parametrize("rare", [40, 5])
def test_families_that_share_a_passage(spark, rare):
    rows = shared_passage()
    out = op1.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), rare=rare).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in out} == brute(rows)


def truncations(seed=22):
    rng = random.Random(seed)
    text = lambda n: [f"t{rng.randrange(10**6)}" for _ in range(n)]
    base = text(300)
    docs = [" ".join(base[: rng.randrange(90, 301)]) for _ in range(40)] + [" ".join(base[rng.randrange(60) :]) for _ in range(20)]
    docs += [" ".join(base[:150] + text(rng.randrange(20, 80))) for _ in range(40)]
    return list(enumerate(docs))


def test_truncated_copies(spark):
    rows = truncations()
    out = op1.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), rare=5).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in out} == brute(rows)


def test_fewest_shared_as_number_and_column(spark):
    from pyspark.sql import functions as F

    sizes = [*range(1, 200), 1000, 10**6]
    got = spark.createDataFrame([(n,) for n in sizes], "n long").select("n", op1._fewest_shared(F.col("n"), 96, 75).alias("t")).collect()
    assert {r.n: r.t for r in got} == {n: op1.fewest_shared(n, 96, 75) for n in sizes}


def test_edges_of_the_input(spark):
    rows = [(1, "a b c d e f", "x"), (1, "a b c d e f", "x"), (None, "a b c d e f", "y"), (2, None, "z"), (3, "", "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, sketch string")
    out = op1.near_duplicates(docs).collect()
    assert len(out) == 5 and all(r.kept for r in out)
    assert op1.near_duplicates(docs.limit(0)).count() == 0
    assert op1.deduplicated(docs).columns == docs.columns and op1.deduplicated(docs).count() == 5


def test_shingles_are_words_between_ascii_space():
    same = lambda a, b: op1.shingles(a).tolist() == op1.shingles(b).tolist()
    assert same("A b\tc\x0bd\ne", "a B c d e") and not same("É b c d e", "é b c d e") and not same("a b c d e f", "a b c d e f")
    assert len(op1.shingles("a b c")) == 1 and len(op1.shingles(" ")) == 0


def test_chain_of_components(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(60)] + [(100, 101), (101, 101), (None, 3)], "a long, b long")
    got = {r.node: r.component for r in components(edges).collect()}
    assert got == {**{k: 0 for k in range(61)}, 100: 100, 101: 100}
    assert components(edges.limit(0)).count() == 0
