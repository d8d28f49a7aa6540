from pyspark.sql import functions as F

from tracewell.functions import hashing as H, text as T


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], list(values)).select(column.alias("x")).first().x


def test_clean_trace_drops_returns_and_leading_a(spark):
    assert one(spark, T.clean_trace(F.col("t")), t="at\r\nat x\nbt\na") == "at\nt x\nbt\n"


def test_word_frames_keep_empty_ones(spark):
    assert one(spark, T.word_frames(F.col("t")), t=" a  b\nc \t") == ["a", "", "b", "c"]
    assert one(spark, T.word_frames(F.col("t")), t="") == [""]


def test_tokens_and_packages(spark):
    assert one(spark, T.tokens(F.col("t")), t="a.b.C$D x Foo.bar. été_1 ..zz".replace("$", "")) == ["a.b.cd", "foo.bar", "zz"]
    assert one(spark, T.packages(F.col("t")), t="a.b.c\nabc\na.\n.x\na..b") == "a.b  a  a."


def test_bigrams_need_two_lines(spark):
    assert one(spark, T.line_bigrams(F.col("t")), t="a\nb\nc") == ["a b", "b c"]
    assert one(spark, T.line_bigrams(F.col("t")), t="a") == []


def test_fnv_of_known_strings(spark):
    for word, want in (("foobar", 0x85944171F73967E8), ("foo", 0xDCB27518FED9D577), ("bar", 0x003934191339461A), ("", 0xCBF29CE484222325)):
        x = one(spark, H.fnv1a64(F.col("t")), t=word)
        assert (x.hi << 32) | x.lo == want


def test_bits_of_a_hash(spark):
    x = one(spark, H.bits(H.fnv1a64(F.col("t"))), t="foobar")
    assert int("".join(map(str, x)), 2) == 0x85944171F73967E8


def test_pair_index_both_ways(spark):
    rows = [(i, j) for i in range(7) for j in range(i + 1, 7)]
    df = spark.createDataFrame(rows, "a long, b long").withColumn("x", H.pair_index(7, F.col("a"), F.col("b")))
    got = df.withColumn("p", H.pair_of_index(7, F.col("x"))).collect()
    assert sorted(r.x for r in got) == list(range(21))
    assert all((r.p.a, r.p.b) == (r.a, r.b) for r in got)


def test_grid_and_collision(spark):
    assert H.band_grid(64) == [(1, 64), (2, 32), (4, 16), (8, 8), (16, 4), (32, 2), (64, 1)]
    assert abs(one(spark, H.collision(F.col("s"), 8, 8), s=0.5) - (1 - (255 / 256) ** 8)) < 1e-12


def test_binarized_and_padded(spark):
    assert one(spark, H.binarized(F.col("v")), v=[0.2, 0.0, -0.1]) == [1, -1, -1]
    assert one(spark, T.padded(F.col("v"), 4), v=[5, 6]) == [5, 6, 0, 0]
    assert one(spark, T.padded(F.col("v"), 1), v=[5, 6]) == [5]
