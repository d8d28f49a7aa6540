import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tests.conftest import SF
from tracewell.llm import langid, mixing, queries
from tracewell.llm.common import words_of


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF.replace('0.001', '0.01')}/documents.parquet")
    rows = langid.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert len(rows) > 100 and np.mean([r.lang == r.lang_pred for r in rows]) > 0.95
    assert all(0 <= r.score <= 1 for r in rows)


def test_predictions_come_from_texts_alone(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    net = langid.train(docs.where(langid.fold() != 0))
    key = lambda df: {r.text: (r.lang_pred, r.score) for r in langid.predict(df, net, ("text",)).collect()}
    assert key(docs) == key(docs.withColumn("lang", F.lit("xx")).withColumn("source", F.lit(None)).withColumn("doc_id", -F.col("doc_id")))


def test_network_learns_a_byte_pattern():
    rnd = np.random.default_rng(0)
    net = langid.Network(["a", "b"])
    x = rnd.integers(1, 255, (1280, langid.WINDOW)).astype(np.uint8)
    x[:640, ::3] = 65
    y = np.repeat([0, 1], 640)
    before = net.probabilities(x, net.compiled())[np.arange(1280), y].mean()
    net.train(x, y)
    after = net.probabilities(x, net.compiled())[np.arange(1280), y].mean()
    assert after > max(before, 0.95)


def test_odd_rows(spark, odd, none):
    rows = langid.identify(odd).collect()
    assert len(rows) == odd.count()
    by = {r.doc_id: r for r in rows}
    assert all(by[i].lang_pred == "und" and by[i].score == 0 for i in (2, 3, 4, 7))
    assert by[None].held_out and by[5].lang_pred in ("en", "fr")
    assert langid.identify(none).count() == 0
    unlabelled = langid.identify(odd.withColumn("lang", F.lit(None).cast("string"))).collect()
    assert {r.lang_pred for r in unlabelled} == {"und"}
    kept = langid.keep_identified(odd)
    assert kept.columns == odd.columns and {r.doc_id for r in kept.collect()} <= {1, 5, 6, None}


FOREIGN = [
    "Все счастливые семьи похожи друг на друга, каждая несчастливая семья несчастлива по-своему. Все смешалось в доме.",
    "Kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan. Heille on annettu järki ja omatunto.",
    "Wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw. Są oni obdarzeni rozumem i sumieniem.",
    "人人生而自由,在尊严和权利上一律平等。他们赋有理性和良心,并应以兄弟关系的精神相对待。",
    "يولد جميع الناس أحرارا متساوين في الكرامة والحقوق وقد وهبوا عقلا وضميرا وعليهم أن يعامل بعضهم بعضا بروح الإخاء",
    "9f86d081884c7d659a2feaa0c55ad015a3bf4f1b2b0b822cd15d6c15b0f00a08" * 3,
    "VGhlIHF1aWNrIGJyb3duIGZveCBqdW1wcyBvdmVyIHRoZSBsYXp5IGRvZyBuZWFyIHRoZSByaXZlciBiYW5r" * 2, "#$% &x* (!) ~~ {q} ^^ <z> ;;" * 5,
]


def test_foreign_and_scrambled_texts_go_and_clean_ones_stay(spark):
    docs = spark.read.parquet(f"{SF.replace('0.001', '0.01')}/documents.parquet")
    rnd = np.random.default_rng(2)
    clean = [r.text for r in docs.where("lang is not null and length(text) > 200").orderBy("doc_id").limit(100).collect()]
    mixed = ["".join(rnd.permutation(list(t[:400]))) for t in clean]
    more = [(10**9 + i, t) for i, t in enumerate([*FOREIGN, *mixed])]
    both = docs.select("doc_id", "text", "lang").union(spark.createDataFrame(more, "doc_id long, text string").withColumn("lang", F.lit(None).cast("string")))
    kept = {r.doc_id for r in langid.keep_identified(both).select("doc_id").collect()}
    n = docs.where("lang is not null and text rlike '[a-z]'").count()
    assert not kept & set(range(10**9, 10**9 + len(FOREIGN))) and len([i for i in kept if i >= 10**9]) <= 5
    assert len([i for i in kept if i < 10**9]) >= 0.99 * n


def test_pipeline_language_learns_from_all_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang")
    many = spark.range(5001).select((F.col("id") + 10**9).alias("doc_id"), F.lit("zug um zug").alias("text"), F.lit("de").alias("lang"))
    both = docs.union(many)
    got = langid.trigram_model(both.where(langid.fold() != 0), both.where(langid.fold() == 0))
    counts = np.zeros((len(got.langs), 1 << langid.TRIGRAM_BITS))
    for r in both.where((langid.fold() != 0) & F.col("lang").isNotNull() & (F.length("text") > 0)).collect():
        np.add.at(counts[got.langs.index(r.lang)], langid.Usual.trigrams([r.text.encode()])[0], 1)
    plain = langid.Usual(got.langs, counts)
    assert np.array_equal(plain.table, got.table) and np.isfinite(got.limit).all()
    texts = [r.text.encode() for r in docs.where("length(text) > 0").collect()]
    top, score, usual = got.judge(texts)
    one = [got.judge([t]) for t in texts]
    assert top.tolist() == [int(x[0][0]) for x in one] and np.allclose(score, [x[1][0] for x in one]) and usual.tolist() == [bool(x[2][0]) for x in one]


def test_rates_against_plain_descent():
    rnd = np.random.default_rng(3)
    p = rnd.dirichlet([0.4] * 3, 500)
    t = rnd.integers(1, 900, 500).astype(float)
    goal = np.array([0.6, 0.3, 0.05]) * t.sum()
    m = (p * t[:, None]).T @ p / t.sum()
    length = 1 / np.linalg.eigvalsh(m)[-1]
    r = np.ones(500)
    for _ in range(5000):
        r = np.maximum(0, r - p @ (length * ((r * t) @ p - goal) / t.sum()))
    assert np.abs((r * t) @ p - goal).sum() / t.sum() < 1e-6  # the targets can be met, and descent meets them
    steps, weight = [], 1.0
    for _ in range(200):
        _, y = mixing.rates(p, steps)
        grown = (1 + np.sqrt(1 + 4 * weight * weight)) / 2
        steps.append((length * ((y * t) @ p - goal) / t.sum(), (weight - 1) / grown))
        weight = grown
    mine = mixing.rates(p, steps)[0]
    assert (mine >= 0).all() and np.abs((mine * t) @ p - goal).sum() / t.sum() < 1e-3


def test_fit_meets_reachable_targets(spark):
    rnd = np.random.default_rng(4)
    p = rnd.dirichlet([0.3] * 3, 400)
    t = rnd.integers(1, 500, 400)
    df = spark.createDataFrame([(int(n), [float(x) for x in q]) for n, q in zip(t, p)], "n_tokens long, p array<double>")
    goal = np.array([0.7, 0.2, 0.1]) * t.sum()
    r = mixing.rates(p, mixing.fit_rates(df, goal))[0]
    assert np.abs((r * t) @ p - goal).sum() / t.sum() < 1e-2


def test_mix_of_the_tables(spark):
    docs, labels = (spark.read.parquet(f"{SF.replace('0.001', '0.01')}/{t}.parquet") for t in ("documents", "labels"))
    rows = mixing.mix_rates(docs, labels).collect()
    assert len(rows) == docs.count() and all(r.rate >= 0 and abs(sum(r.p) - 1) < 1e-9 for r in rows)
    toxic = {r.doc_id for r in labels.where("toxic = 1").collect()}
    clean = {r.doc_id for r in labels.where("toxic = 0 and quality = 1").collect()}
    rate = {r.doc_id: r.rate for r in rows}
    assert np.mean([rate[i] for i in toxic if i in rate]) < 0.3 < 0.8 < np.mean([rate[i] for i in clean if i in rate])
    tokens = np.array([r.n_tokens for r in rows])
    mixed = (tokens * [r.rate for r in rows]) @ np.array([r.p for r in rows])
    share = dict(zip(rows[0].domains, mixed / mixed.sum()))
    assert share["quality=1,toxic=0"] == pytest.approx(0.9, abs=0.03)


def test_mixing_odd_rows(spark, odd, none):
    labels = spark.createDataFrame([(1, 1, 0), (1, 1, 0), (5, 0, 0), (6, 1, None), (None, 1, 1), (99, 0, 1), (7, 0, 1)], "doc_id long, quality int, toxic int")
    rows = mixing.mix_rates(odd, labels).collect()
    assert len(rows) == odd.count() and {r.n_tokens for r in rows if r.doc_id in (2, 3, 4)} == {0}
    assert mixing.mix_rates(none, labels).count() == 0
    assert {r.rate for r in mixing.mix_rates(odd, labels.where("false")).collect()} == {1.0}
    for repeats in (False, True):
        assert mixing.resample(odd, labels, repeats=repeats).columns == odd.columns


def test_predictions_against_plain_loops(spark):
    """op2's columns, worked out again text by text, window by window and filter by filter."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    net = langid.train(docs.where(langid.fold() != 0))
    got = {r.doc_id: r for r in langid.identify(docs).collect()}
    for r in docs.orderBy("doc_id").limit(25).collect():
        raw, total = (r.text or "").encode(), np.zeros(len(net.langs))
        for at in range(0, len(raw), langid.WINDOW):
            part = raw[at : at + langid.WINDOW]
            padded = part + bytes(langid.WINDOW - len(part))
            tops = [max(sum(float(net.tables[w][k, padded[i + k], f]) for k in range(w)) for i in range(langid.WINDOW - w + 1)) for w in langid.WIDTHS for f in range(langid.FILTERS)]
            z = np.maximum(np.array(tops) + net.bias, 0) @ net.dense + net.offset
            p = np.exp(z - z.max())
            total += p / p.sum() * len(part)
        mine = got[r.doc_id]
        if mine.lang_pred != "und":
            assert mine.lang_pred == net.langs[total.argmax()] and mine.score == pytest.approx(total.max() / len(raw), abs=1e-4)


def test_training_takes_windows_of_whole_texts(spark):
    far = "zzzz " * 400 + "qqqq " * 400
    rows = [(i, far if i % 2 else "aaaa " * 800, "x" if i % 2 else "y") for i in range(40)]
    net = langid.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    asked = spark.createDataFrame([(1, "qqqq " * 30), (2, "zzzz " * 30), (3, "aaaa " * 30)], "doc_id long, text string")
    assert [r.lang_pred for r in langid.predict(asked, net, ("doc_id",)).orderBy("doc_id").collect()] == ["x", "x", "y"]


def test_mix_without_repeats_has_its_weights(spark):
    docs, labels = (spark.read.parquet(f"{SF.replace('0.001', '0.01')}/{t}.parquet") for t in ("documents", "labels"))
    mix, members = mixing.fit(docs, labels, most=1.0)
    rows = mixing._rated(members, mix, ("doc_id",)).collect()
    assert max(r.rate for r in rows) <= 1
    total = np.array([r.n_tokens * r.rate for r in rows]) @ np.array([r.p for r in rows])
    assert total[mix.model.domains.index("quality=1,toxic=0")] / total.sum() == pytest.approx(0.9, abs=0.02)
    p = np.array([r.p for r in rows])
    assert np.allclose(mixing.rates(p, mix.steps, 1.0)[0], [r.rate for r in rows])
    drawn = mixing.resample(docs, labels).groupBy("doc_id").count().collect()
    assert max(r["count"] for r in drawn) == 1
    kept = {r.doc_id for r in drawn}
    drawn_total = np.array([r.n_tokens * (r.doc_id in kept) for r in rows]) @ p
    assert drawn_total[mix.model.domains.index("quality=1,toxic=0")] / drawn_total.sum() == pytest.approx(0.9, abs=0.04)


def test_conflicting_labels_and_texts_are_settled(spark):
    docs = spark.createDataFrame([(i % 30, f"word{i % 7} and word{i % 11}", i) for i in range(90)], "doc_id long, text string, part int")
    labels = spark.createDataFrame([(i % 30, i % 2, i % 3 % 2) for i in range(120)], "doc_id long, quality int, toxic int")
    one, two = mixing.fit_classifier(docs, labels), mixing.fit_classifier(docs.orderBy(-docs.part), labels.orderBy("toxic"))
    assert one.domains == two.domains and np.array_equal(one.words, two.words)


def test_mix_with_repeats_keeps_the_heaviest_domain_and_repeats_the_scarce_one(spark):
    docs, labels = (spark.read.parquet(f"{SF.replace('0.001', '0.01')}/{t}.parquet") for t in ("documents", "labels"))
    mix, members = mixing.fit(docs, labels)
    rows = mixing._rated(members, mix, ("doc_id",)).collect()
    p, n, r = np.array([x.p for x in rows]), np.array([x.n_tokens for x in rows]), np.array([x.rate for x in rows])
    good, poor = (mix.model.domains.index(d) for d in ("quality=1,toxic=0", "quality=0,toxic=0"))
    total = (n * r) @ p
    assert total[good] == pytest.approx(n @ p[:, good], rel=0.02) and total[good] / total.sum() == pytest.approx(0.9, abs=0.02)
    drawn = mixing.resample(docs, labels, repeats=True)
    count = {x.doc_id: x["count"] for x in drawn.groupBy("doc_id").count().collect()}
    assert drawn.columns == docs.columns and max(count.values()) > 1
    assert all(abs(count.get(x.doc_id, 0) - x.rate) < 1 for x in rows)
    drawn_total = np.array([count.get(x.doc_id, 0) * x.n_tokens for x in rows]) @ p
    assert drawn_total[poor] / drawn_total.sum() == pytest.approx(0.1, abs=0.03)


def test_rates_of_the_query_against_descent_over_all_rows(spark):
    """op3's columns: the posteriors word by word, and the rates by steps of all rows at once."""
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    rows = sorted(queries.op3_mixing(spark, SF).collect(), key=lambda r: r.doc_id)
    model = mixing.fit_classifier(docs, labels)
    texts = {r.doc_id: r.text for r in docs.collect()}
    p, n = [], []
    for r in rows:
        words = words_of(texts[r.doc_id])
        z = (np.array(mixing.shapes(texts[r.doc_id], len(words), len(set(words)))) - model.mean) / model.scale @ model.shape + model.bias
        for bucket in {xxhash.xxh3_64_intdigest(w) % mixing.BUCKETS for w in words}:
            z = z + model.words[bucket]
        e = np.exp(z - z.max())
        p.append(e / e.sum())
        n.append(len(words))
    p, n = np.array(p), np.array(n, float)
    assert [r.n_tokens for r in rows] == n.tolist() and np.allclose(p, [r.p for r in rows], atol=1e-9) and rows[0].domains == model.domains
    expected, w = n @ p, np.array([mixing.WEIGHTS.get(d, 0.0) for d in model.domains])
    goal = w * expected[w.argmax()] / w.max()
    length = n.sum() / np.linalg.eigvalsh((p * n[:, None]).T @ p)[-1]
    r, y, k, best, kept = np.ones(len(n)), np.ones(len(n)), 1.0, np.inf, None
    for _ in range(mixing.STEPS):
        error = np.abs((r * n) @ p - goal).sum() / n.sum()
        if error < best:
            best, kept = error, r
        if error < mixing.CLOSE:
            break
        new = np.maximum(0, y - length * (p @ ((y * n) @ p - goal)) / n.sum())
        grown = (1 + np.sqrt(1 + 4 * k * k)) / 2
        r, y, k = new, np.maximum(0, new + (k - 1) / grown * (new - r)), grown
    assert np.allclose(kept, [x.rate for x in rows], atol=1e-6)
