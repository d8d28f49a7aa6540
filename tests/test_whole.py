import random

import pytest
from pyspark.sql import functions as F

from tracewell.functions import text as T
from tracewell.operators import features as X, lsh, simjoin
from tracewell.sources import io
from tracewell.streaming import growing, lookup


def near_copies(seed, n=120):
    """Word lists with near copies of one another, sets of one word, equal sets and frequent words."""
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        if rows and rnd.random() < 0.6:
            words = list(rnd.choice(rows)[1])
            for _ in range(rnd.choice([0, 0, 1, 1, 2, 4])):
                words[rnd.randrange(len(words))] = f"w{rnd.randrange(60)}"
        else:
            words = [f"w{int(rnd.paretovariate(0.4)) % 60}" for _ in range(rnd.choice([1, 2, 5, 12, 30]))]
        rows.append((i, words))
    return rows


@pytest.mark.parametrize("num,den", [(4, 5), (1, 2), (9, 10)])
@pytest.mark.parametrize("share", [1e-6, 0.01])
def test_join_equals_all_pairs(spark, monkeypatch, num, den, share):
    monkeypatch.setattr(simjoin.prefix_entries, "__defaults__", (share,))
    rows = near_copies(num * den)
    sets = simjoin.item_sets(spark.createDataFrame(rows, "id long, w array<string>"), F.col("w"))
    member, reps = simjoin.set_classes(sets)
    got = {(r.i, r.j): r.shared for r in simjoin.jaccard_join(reps.cache(), num, den).collect()}
    plain = {i: set(w) for i, w in rows}
    first = {i: min(j for j in plain if plain[j] == plain[i]) for i in plain}
    heads = sorted(set(first.values()))
    want = {(i, j): len(plain[i] & plain[j]) for i in heads for j in heads if i < j and len(plain[i] & plain[j]) * den >= len(plain[i] | plain[j]) * num}
    assert {r.id: r.rep for r in member.collect()} == first and len(want) >= 3
    assert got == want


def test_sketches_rule_pairs_out_before_sets_move(spark):
    """Sets of 300 of which a third is the same everywhere: they meet in the lists of rare words, and none leaves its task as a pair."""
    rnd = random.Random(3)
    rows = [(i, [f"common{k}" for k in range(100)] + rnd.sample([f"w{k}" for k in range(2000)], 200)) for i in range(60)]
    rows += [(100 + i, [*w, "more"]) for i, w in rows[:5]]
    reps = simjoin.item_sets(spark.createDataFrame(rows, "id long, w array<string>"), F.col("w"))
    entries = simjoin.prefix_entries(reps, 4, 5)
    assert entries.groupBy("item").count().where("count > 1").count() > 500
    assert sorted((r.i, r.j) for r in simjoin.candidate_pairs(entries, 4, 5).collect()) == [(i, 100 + i) for i in range(5)]


def test_odd_sets(spark):
    rows = [(1, None), (2, []), (3, ["a", None]), (4, ["a"]), (4, ["a"]), (5, [None]), (6, ["a", "b", "c", "d", "e"] * 4000), (7, [f"x{k}" for k in range(20_000)])]
    sets = simjoin.item_sets(spark.createDataFrame(rows, "id long, w array<string>"), F.col("w"))
    member, reps = simjoin.set_classes(sets)
    assert sorted((r.id, r.rep) for r in member.collect()) == [(3, 3), (4, 3), (4, 3), (6, 6), (7, 7)]
    assert sorted((r.id, r.copies) for r in reps.collect()) == [(3, 3), (6, 1), (7, 1)]
    assert simjoin.jaccard_join(reps).count() == 0 and simjoin.jaccard_join(reps.where("false")).count() == 0
    with pytest.raises(ValueError):
        simjoin.jaccard_join(reps, 1, 1)


def test_links_count_copies(spark):
    words = [f"w{k}" for k in range(9)]
    rows = [(1, words), (2, words[::-1]), (3, words + ["z"]), (4, ["other"])]
    member, reps = simjoin.set_classes(simjoin.item_sets(spark.createDataFrame(rows, "id long, w array<string>"), F.col("w")))
    out = simjoin.linked_counts(member, reps, simjoin.jaccard_join(reps)).collect()
    assert sorted(tuple(r) for r in out) == [(1, 1, 2, 1), (2, 1, 2, 1), (3, 3, 1, 2), (4, 4, 1, 0)]


def test_size_classes_of_linkable_sizes_are_neighbours(spark):
    rows = spark.range(1, 2000).select(F.col("id").alias("a")).select("a", F.explode(F.sequence("a", F.floor(F.col("a") * 5 / 4))).alias("b"))
    gaps = rows.select(simjoin.size_class(F.col("b"), 4, 5) - simjoin.size_class(F.col("a"), 4, 5)).distinct().collect()
    assert {g[0] for g in gaps} == {0, 1}


# ---- growing index


@pytest.fixture()
def vectors(spark):
    rnd = random.Random(3)
    rows = [(i, [rnd.choice([-1.0, 1.0]) for _ in range(4)]) for i in range(40)]
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>")


def banded(vectors):
    return lsh.bands(lsh.sign_hash(vectors), 2, 2)


def all_links(vectors):
    b = [(r.id, r.band, r.key) for r in banded(vectors).collect()]
    return sorted((x, y, k) for x, k, p in b for y, m, q in b if (k, p) == (m, q) and y < x)


def found(spark, path):
    return sorted((max(r.q, r.nn), min(r.q, r.nn), r.band) for r in growing.links(spark, path).collect())


def test_growth_equals_the_batch_answer_over_restarts(spark, vectors, tmp_path):
    source, path = f"{tmp_path}/in", f"{tmp_path}/grown"
    stream = lambda: banded(lookup.arriving(spark, source, "*.parquet", vectors.schema))
    for part in (vectors.where("vec_id % 3 = 1"), vectors.where("vec_id % 3 = 0")):
        part.coalesce(2).write.mode("append").parquet(source)
    growing.grow(stream(), path)
    vectors.where("vec_id % 3 = 2").coalesce(1).write.mode("append").parquet(source)
    growing.grow(stream(), path)
    growing.grow(stream(), path)  # nothing new
    assert found(spark, path) == all_links(vectors)
    assert growing.index(spark, path).select("gen").distinct().count() >= 3


def test_a_batch_that_failed_after_writing_is_repeated(spark, vectors, tmp_path, monkeypatch):
    source, path, enter, calls = f"{tmp_path}/in", f"{tmp_path}/grown", growing.enter, []
    for k in range(3):
        vectors.where(f"vec_id % 3 = {k}").coalesce(1).write.mode("append").parquet(source)
    stream = lambda: banded(lookup.arriving(spark, source, "*.parquet", vectors.schema))

    def failing(batch, number, to):
        enter(batch, number, to)
        calls.append(number)
        if len(calls) == 2:
            raise RuntimeError("lost after writing")

    monkeypatch.setattr(growing, "enter", failing)
    with pytest.raises(Exception, match="lost after writing"):
        growing.grow(stream(), path)
    growing.grow(stream(), path)
    assert calls.count(calls[1]) == 2
    assert found(spark, path) == all_links(vectors)


def test_null_and_repeated_rows_of_a_batch(spark, tmp_path):
    rows = [(1, 0, "a"), (1, 0, "a"), (None, 0, "a"), (2, 0, None), (3, 0, "a")]
    path = str(tmp_path)
    growing.enter(spark.createDataFrame(rows, "id long, band int, key string"), 0, path)
    growing.enter(spark.createDataFrame([(1, 0, "a")], "id long, band int, key string"), 1, path)
    growing.enter(spark.createDataFrame([], "id long, band int, key string"), 2, path)
    assert sorted(tuple(r) for r in growing.links(spark, path).collect()) == [(1, 3, 0), (3, 1, 0)]


# ---- bucketed index


def test_probe_does_not_shuffle_the_index(spark, vectors, tmp_path):
    b = banded(vectors)
    io.save_buckets(b.where("id < 20"), "held_buckets", f"{tmp_path}/held", 4)
    io.append_buckets(b.where("id >= 20"), "held_buckets", 4)
    got = io.probe_buckets(b, "held_buckets")
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Bucketed: true" in plan
    want = {(x, k, y) for x, y, k in all_links(vectors)}
    assert {tuple(r) for r in got.collect()} == want | {(y, k, x) for x, k, y in want}
    spark.sql("DROP TABLE held_buckets")


def test_rows_count_their_own_terms_and_move_nothing(spark):
    rows = spark.createDataFrame([(1, "B.b a.a\na.a b.b\tc c.c"), (2, ""), (3, "x"), (None, "aa aa aa"), (5, "no dot\n.\n..\na.\n.a\nau.bé.c d\ne.f.g aa.bb\r.cc.dd")], "id int, text string")
    twice = rows.union(spark.createDataFrame([(1, "a.a again")], "id int, text string"))
    assert X.own_ids(rows) and not X.own_ids(twice) and not X.own_ids(rows.union(rows.where("id is null")))
    for kind in (X.frames_of, X.bigrams_of, X.durfex_of):
        own, plain = X.own_counts(*kind(rows)), X.term_counts(*kind(rows))
        assert own.schema.simpleString() == plain.schema.simpleString() and sorted(map(str, own.collect())) == sorted(map(str, plain.collect()))
        assert "Exchange" not in own._jdf.queryExecution().executedPlan().toString()
    old = F.translate(F.array_join(F.transform(T.lines(F.col("text")), lambda x: F.regexp_replace(x, r"(?s)\.?[^.]*$", "")), " "), "$/<>", "")
    assert all(r.a == r.b for r in rows.select(old.alias("a"), T.packages(F.col("text")).alias("b")).collect())


def test_simhash_of_rows_equals_the_join(spark):
    rows = spark.createDataFrame([(1, "a.a bb bb ccc"), (2, ""), (None, "x" * 300 + " bb"), (4, "été zz_z zz_z zz_z 12 12")], "id long, text string")
    docs, terms = X.frames_of(rows)
    got = lsh.simhash_rows(docs.select("id", X.counted(terms).alias("counts")))
    want = lsh.simhash(X.bag_of_frames(rows).withColumn("w", F.col("n").cast("double")))
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect())) and "Exchange" not in got._jdf.queryExecution().executedPlan().toString()


def test_links_are_shuffled_only_where_ids_come_again(spark, vectors, tmp_path, monkeypatch):
    monkeypatch.setattr(growing.lsh, "HOT", 4)  # buckets go in parts
    path = str(tmp_path / "index")
    for gen in range(3):
        growing.enter(banded(vectors.where(F.pmod("vec_id", F.lit(3)) == gen)), gen, path)
    plan = lambda: growing.links(spark, path)._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" not in plan() and found(spark, path) == all_links(vectors)
    assert growing.links(spark, path).count() == growing.links(spark, path).distinct().count()
    growing.enter(banded(vectors.where("vec_id < 20")), 3, path)
    assert "Aggregate" in plan()
    assert growing.links(spark, path).count() == growing.links(spark, path).distinct().count()


def test_stream_leaves_lists_whole(spark, vectors, tmp_path, monkeypatch):
    monkeypatch.setattr(lookup.lsh, "HOT", 4)
    vectors.repartition(3).write.parquet(str(tmp_path / "in"))
    lists, hot = growing.lsh.bucket_lists(banded(vectors))
    assert hot.count() and lists.agg(F.sum(F.size("ids"))).first()[0] == banded(vectors).count()
    stream = lookup.arriving(spark, str(tmp_path / "in"), "*.parquet", vectors.schema)
    out = lookup.run_to_table(lookup.lists_of_stream(stream, lists, hot, 2, 2), str(tmp_path / "out"), str(tmp_path / "state"))
    b = banded(vectors)
    want = b.withColumnRenamed("id", "q").join(b.withColumnRenamed("id", "nn"), ["band", "key"]).groupBy("q").count()
    got = out.groupBy("q").agg(F.sum(F.size("ids")).alias("count"))
    assert {tuple(r) for r in got.collect()} == {tuple(r) for r in want.collect()}
