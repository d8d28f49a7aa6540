import random
from collections import defaultdict

import pytest

from tests.conftest import SF
from tracewell.llm import ngram_join as N
from tracewell.llm.common import components


def brute(docs, k, percent):
    """doc_id -> (set size, smallest id reachable), from all pairs that share an n-gram."""
    sets, up, by = {}, {}, defaultdict(list)
    for i, t in docs:
        w = (t or "").encode().lower().split()
        sets[i] = set(zip(*(w[j:] for j in range(k)))) if len(w) >= k else ({tuple(w)} if w else set())
        up[i] = i

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in sorted(sets):
        shared = defaultdict(int)
        for g in sets[i]:
            for j in by[g]:
                shared[j] += 1
            by[g].append(i)
        for j, o in shared.items():
            if 100 * o >= percent * (len(sets[i]) + len(sets[j]) - o):
                a, b = find(i), find(j)
                up[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), find(i)) for i in sets}


def got(df):
    return {r.doc_id: (r.n_shingles, r.component_id) for r in df.collect()}


def variants(seed, bases, copies, length, change):
    """Texts around common bases: some words of each copy are replaced, dropped or doubled."""
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choices("abcdefgh", k=rnd.randint(1, 4)))
    out = []
    for _ in range(bases):
        base = [word() for _ in range(rnd.randint(length // 2, length))]
        for _ in range(copies):
            w = list(base)
            for _ in range(rnd.randint(0, change)):
                at = rnd.randrange(len(w))
                w[at : at + 1] = rnd.choice(([word()], [], [w[at], w[at]]))
            out.append(" ".join(w))
    rnd.shuffle(out)
    return list(enumerate(out))


@pytest.mark.parametrize("k,percent", [(3, 90), (5, 80), (1, 50)])
def test_equals_brute_force(spark, k, percent):
    docs = variants(k, 12, 25, 60, 5) + [(1000, "a"), (1001, "a"), (1002, "A"), (1003, ""), (1004, None), (1005, "a b")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert got(N.ngram_jaccard_components(df, k, percent)) == brute(docs, k, percent)


def test_one_large_group_and_common_passages(spark, monkeypatch):
    monkeypatch.setattr(N, "LIGHT", 4)
    monkeypatch.setattr(N, "BLOCK_BYTES", 50 * 90 * 8)
    docs = variants(9, 1, 320, 90, 7)
    shared = " ".join(f"common{i}" for i in range(30))
    docs += [(2000 + i, f"{shared} " + t) for i, t in variants(10, 60, 2, 40, 1)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert got(N.ngram_jaccard_components(df, 3, 90)) == brute(docs, 3, 90)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_chains_of_links_in_long_lists(spark, monkeypatch, seed):
    """Texts drift away from a common base, so that components join only step by step."""
    monkeypatch.setattr(N, "LIGHT", 3)
    monkeypatch.setattr(N, "LIST_ROWS", 10)
    monkeypatch.setattr(N, "HOT_LEAST", 2)
    monkeypatch.setattr(N, "BLOCK_BYTES", 20 * 70 * 8)
    rnd = random.Random(seed)
    base = [f"w{i}" for i in range(70)]
    docs = []
    for _ in range(6):
        w = list(base)
        for _ in range(25):
            for _ in range(rnd.randint(1, 4)):
                w[rnd.randrange(len(w))] = f"n{rnd.randrange(12)}"
            docs.append(" ".join(w))
    rnd.shuffle(docs)
    docs = list(enumerate(docs))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    want = brute(docs, 2, 85)
    assert len({c for _, c in want.values()}) > 1
    assert got(N.ngram_jaccard_components(df, 2, 85)) == want


def test_what_moves_between_blocks_follows_the_pairs(spark, monkeypatch):
    """Sets of one family in many blocks, few of which link: whole sets travel with pairs that may link, not to every block."""
    monkeypatch.setattr(N, "BLOCK_BYTES", 4 * 60 * 8)
    rnd = random.Random(4)
    docs, w = [], [f"w{i}" for i in range(60)]
    for i in range(150):  # each shares much with the one before it, and every seventh links with it
        for at in rnd.sample(range(60), 1 if i % 7 == 0 else 5):
            w[at] = f"n{rnd.randrange(10_000)}"
        docs.append((i, " ".join(w)))
    held, df = [], spark.createDataFrame(docs, "doc_id long, text string")
    assert got(N.ngram_jaccard_components(df, 1, 90, held)) == brute(docs, 1, 90)
    near = [t for t in held if t.columns == ["u", "v"] and "near-" in t.stored_at]
    assert len(near) == 2 and 0 < sum(t.count() for t in near) < 150


def test_only_what_may_meet_is_stored_for_blocks(spark, monkeypatch):
    """Of one large family and many small ones only the large one's sets are stored, and only entries of lists of several blocks are joined with labels."""
    monkeypatch.setattr(N, "BLOCK_BYTES", 4 * 60 * 8)
    rnd = random.Random(5)
    docs, w = [], [f"w{i}" for i in range(60)]
    for i in range(60):
        for at in rnd.sample(range(60), 1 if i % 4 == 0 else 5):
            w[at] = f"n{rnd.randrange(10_000)}"
        docs.append(" ".join(w))
    for i in range(40):
        small = [f"s{i}x{j}" for j in range(30)]
        docs += [" ".join(small), " ".join([*small, f"e{i}"])]
    docs = list(enumerate(docs))
    held, df = [], spark.createDataFrame(docs, "doc_id long, text string")
    assert got(N.ngram_jaccard_components(df, 1, 90, held)) == brute(docs, 1, 90)
    (sets,) = [t for t in held if "/sets-" in t.stored_at]
    assert 0 < sets.select("cls").distinct().count() <= 60
    (entries,) = [t for t in held if "/entries-" in t.stored_at]
    lists = {}
    for r in entries.collect():
        lists.setdefault((r.token, r.part), set()).add(r.block)
    assert lists and all(len(blocks) > 1 for blocks in lists.values())


def test_smallest_tables(spark):
    df = spark.read.parquet(f"{SF}/documents.parquet")
    docs = [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]
    assert got(N.ngram_jaccard_components(df, 3, 90)) == brute(docs, 3, 90)


def test_odd_rows(odd, none):
    rows = N.ngram_jaccard_components(odd, 3, 90).collect()
    assert len(rows) == odd.count()
    assert {r.doc_id: r.n_shingles for r in rows} == {1: 11, 2: 0, 3: 0, 4: 0, 5: 3, None: 6, 6: 6, 7: 1}
    assert all(r.component_id == r.doc_id for r in rows)
    assert N.ngram_jaccard_components(none, 3, 90).count() == 0


def test_one_of_each_group_stays(spark, odd):
    docs = [(i, "same words in each of these texts") for i in (5, 3, 9)] + [(4, "other words stand in this one"), (8, None), (2, "")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert sorted(r.doc_id for r in N.one_per_component(df).collect()) == [2, 3, 4, 8]
    assert N.one_per_component(odd).columns == odd.columns


def test_components_of_chains_and_stars(spark):
    edges = [(i + 1, i) for i in range(40)] + [(100 + i, 100) for i in range(1, 200)] + [(7, 300), (500, 501)]
    found = {r.node: r.component for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert all(found[i] == 0 for i in [*range(41), 300])
    assert all(found[100 + i] == 100 for i in range(200))
    assert found[501] == found[500] == 500
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


@pytest.mark.parametrize("sent", [0, 2_000_000])
def test_rows_that_stay_do_not_depend_on_how_ids_travel(spark, monkeypatch, sent):
    monkeypatch.setattr(N, "SENT_IDS", sent)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    groups = brute([(r.doc_id, r.text) for r in docs.collect()], 5, 80)
    assert sorted(r.doc_id for r in N.one_per_component(docs).collect()) == sorted(i for i, (_, c) in groups.items() if i == c)
