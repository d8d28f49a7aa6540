"""The registered queries of the similarity-search operators, each with its SQL where one can be written.

The catalog of traces is the 1000 most frequent distinct texts of documents, which is an operator of
its own; everything else reads whole tables and whole texts. Frames of the alignment measures are
the lines of a trace, as in the traces that the measures were made for; set measures use word frames.
"""

from __future__ import annotations

import copy
import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tracewell.functions import hashing as H, text as T
from tracewell.operators import dense, features as X, kernels, learned, lsh, measures as M, metrics as Q, pairs as P, stats
from tracewell.plans import sql as S
from tracewell.sources import io
from tracewell.storage import shared_dir, stored, table
from tracewell.streaming import lookup

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}

#: Bits of the sign hashes and the settings (bands, width) that the metrics go through.
BITS = 64
GRID = H.band_grid(BITS)


def query(sql: str | None = None):
    """Register a query by its function's name."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def rounded(c: Column | str) -> Column:
    """To nine places, without a negative zero."""
    return F.round(F.col(c) if isinstance(c, str) else c, 9) + F.lit(0.0)


def traces(spark: SparkSession, sf: str) -> DataFrame:
    return X.catalog(table(spark, sf, "documents"))


def kept(df: DataFrame) -> tuple[DataFrame, int]:
    """A numbered catalog, written once, and its size."""
    df = stored(df, "catalog")
    return df, df.count()


# ---- catalog, tokens, features


@query(f"WITH {S.CAT} SELECT id, text FROM cat")
def top_traces(spark, sf):
    return traces(spark, sf)


@query(f"SELECT doc_id, len(w) AS n_tokens, md5(array_to_string(w, ' ')) AS digest FROM (SELECT doc_id, {S.tokens('text')} AS w FROM documents WHERE text IS NOT NULL)")
def clean_tokens(spark, sf):
    w = T.tokens(T.vector_text(F.col("text")))
    rows = table(spark, sf, "documents").where("text is not null").select("doc_id", w.alias("w"))
    return rows.select("doc_id", F.size("w").cast("long").alias("n_tokens"), F.md5(F.array_join("w", " ")).alias("digest"))


@query("SELECT doc_id, len(w) AS n_frames, md5(array_to_string(w, chr(1))) AS digest FROM (SELECT doc_id, string_split(trim(replace(text, chr(10), ' '), chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), ' ') AS w FROM documents WHERE text IS NOT NULL)")
def word_frame_lists(spark, sf):
    rows = table(spark, sf, "documents").where("text is not null").select("doc_id", T.word_frames(F.col("text")).alias("w"))
    return rows.select("doc_id", F.size("w").cast("long").alias("n_frames"), F.md5(F.array_join("w", "\x01")).alias("digest"))


@query(f"WITH {S.CAT}, {S.BAG} SELECT id, term, n FROM bag")
def bag_of_frames(spark, sf):
    return X.bag_of_frames(traces(spark, sf))


@query(f"WITH {S.CAT}, {S.BIGRAMS} SELECT id, term, n FROM bigrams")
def bigram_counts(spark, sf):
    return X.bag_of_bigrams(traces(spark, sf))


@query(f"WITH {S.CAT}, {S.BAG}, {S.TFIDF} SELECT id, term, round(w, 9) + 0.0 AS w FROM tfidf")
def tfidf(spark, sf):
    cat, n = kept(traces(spark, sf))
    return X.tfidf(X.bag_of_frames(cat), n).withColumn("w", rounded("w"))


@query(f"WITH {S.CAT}, {S.DURFEX} SELECT id, term, n FROM durfex")
def durfex_counts(spark, sf):
    return X.durfex_counts(traces(spark, sf))


@query(f"WITH {S.CAT}, {S.BAG} SELECT term, total, round(1 + ln(c / total), 9) + 0.0 AS idf, round(total / c, 9) + 0.0 AS share FROM (SELECT term, CAST(sum(n) AS BIGINT) AS total FROM bag GROUP BY term), (SELECT CAST(count(*) AS DOUBLE) AS c FROM cat)")
def frame_idf(spark, sf):
    cat, n = kept(traces(spark, sf))
    return X.frame_statistics(X.bag_of_frames(cat), n).select("term", "total", rounded("idf").alias("idf"), rounded("share").alias("share"))


@query(f"""WITH {S.CAT}, {S.BAG}, b AS (SELECT item_id AS id, unnest({S.tokens('text')}) AS term FROM benchmark WHERE text IS NOT NULL)
SELECT id, term, count(*) AS n FROM b WHERE term IN (SELECT term FROM bag) GROUP BY ALL""")
def transform_unseen(spark, sf):
    unseen = table(spark, sf, "benchmark").where("text is not null").select(F.col("item_id").alias("id"), "text")
    return X.transform_counts(X.bag_of_frames(unseen), X.bag_of_frames(traces(spark, sf)))


@query("""WITH f AS (SELECT doc_id AS id, string_split(text, chr(10)) AS w FROM documents WHERE text IS NOT NULL),
e AS (SELECT id, generate_subscripts(w, 1) AS pos, unnest(w) AS frame FROM f),
d AS (SELECT frame, row_number() OVER (ORDER BY frame) AS rank FROM (SELECT DISTINCT frame FROM e)),
r AS (SELECT id, list(rank ORDER BY pos) AS ranks FROM e JOIN d USING (frame) GROUP BY id)
SELECT id, array_to_string(list_slice(list_concat(ranks, list_transform(range(m), lambda x: CAST(0 AS BIGINT))), 1, m), ' ') AS ranks FROM r, (SELECT max(len(w)) AS m FROM f)""")
def frame_rank_padded(spark, sf):
    rows = table(spark, sf, "documents").where("text is not null").select(F.col("doc_id").alias("id"), T.lines(F.col("text")).alias("frames"))
    ranks = X.ranked_frames(rows, X.frame_dictionary(rows.select("frames")))
    return ranks.select("id", F.array_join(T.padded(F.col("ranks"), X.longest(rows)), " ").alias("ranks"))


# ---- pairs and measures


@query(f"WITH {S.CAT} SELECT a.id AS i, b.id AS j, CAST(row_number() OVER (ORDER BY a.id, b.id) - 1 AS BIGINT) AS place, a.id AS back_i, b.id AS back_j FROM cat a JOIN cat b ON a.id < b.id")
def pair_index(spark, sf):
    n = traces(spark, sf).count()
    placed = P.all_indices(n, spark).withColumn("place", H.pair_index(n, F.col("i"), F.col("j")))
    return placed.withColumn("back", H.pair_of_index(n, F.col("place"))).select("i", "j", "place", F.col("back.a").alias("back_i"), F.col("back.b").alias("back_j"))


def _sim(df: DataFrame) -> DataFrame:
    return df.select("i", "j", rounded("sim").alias("sim"))


def _items(cat: DataFrame, items: Column) -> DataFrame:
    return cat.select("id", F.explode(items).alias("item"))


@query(S.jaccard("string_split(trim(replace(text, chr(10), ' '), chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), ' ')"))
def sim_jaccard(spark, sf, held=None):
    cat, n = held or kept(traces(spark, sf))
    return _sim(M.jaccard(_items(cat, T.word_frames(F.col("text"))), n))


@query(S.jaccard("list_transform(range(1, len(string_split(text, chr(10)))), lambda i: string_split(text, chr(10))[i] || ' ' || string_split(text, chr(10))[i + 1])"))
def sim_jaccard_bigram(spark, sf, held=None):
    cat, n = held or kept(traces(spark, sf))
    return _sim(M.jaccard(_items(cat, T.line_bigrams(F.col("text"))), n))


@query(S.cosine(S.BAG, "bag", "n"))
def sim_cosine(spark, sf, held=None):
    cat, n = held or kept(traces(spark, sf))
    return _sim(M.cosine(X.bag_of_frames(cat).withColumnRenamed("n", "w"), n))


@query(S.cosine(S.BIGRAMS, "bigrams", "n"))
def sim_cosine_bigram(spark, sf, held=None):
    cat, n = held or kept(traces(spark, sf))
    return _sim(M.cosine(X.bag_of_bigrams(cat).withColumnRenamed("n", "w"), n))


@query(S.cosine(f"{S.BAG}, {S.TFIDF}", "tfidf", "w"))
def sim_tfidf(spark, sf, held=None):
    cat, n = held or kept(traces(spark, sf))
    return _sim(M.cosine(X.tfidf(X.bag_of_frames(cat), n), n))


@query(S.cosine(S.DURFEX, "durfex", "n"))
def sim_durfex(spark, sf, held=None):
    cat, n = held or kept(traces(spark, sf))
    return _sim(M.cosine(X.durfex_counts(cat).withColumnRenamed("n", "w"), n))


def _frames(cat: DataFrame, normal: bool = False) -> DataFrame:
    frames = cat.select("id", T.lines(F.col("text")).alias("frames"))
    return M.normalized(frames) if normal else frames


def _weighted(cat: DataFrame, n: int) -> DataFrame:
    frames = _frames(cat, normal=True)
    counts = X.term_counts(frames, F.col("frames"))
    return stored(M.with_statistics(frames, X.frame_statistics(counts, n), n), "weighted")


@query(S.aligned(S.EDITS, "0.0"))
def sim_levenshtein(spark, sf, held=None):
    cat, n = held or kept(traces(spark, sf))
    return _sim(M.aligned_by(_frames(cat), kernels.levenshtein, n, "0D"))


@query(S.aligned(S.PDM, "0.0"))
def sim_pdm(spark, sf, held=None):
    cat, n = held or kept(traces(spark, sf))
    return _sim(M.aligned_by(_frames(cat), kernels.pdm, n, "0D"))


@query(S.aligned(S.PREFIX, "0.0"))
def sim_prefix(spark, sf, held=None):
    cat, n = held or kept(traces(spark, sf))
    return _sim(M.aligned(_frames(cat), M.prefix_sql(), n, "0D"))


@query(S.aligned(S.NW, "-1.0", normal=True))
def sim_nw(spark, sf, held=None):
    cat, n = held or kept(traces(spark, sf))
    return _sim(M.aligned_by(_frames(cat, normal=True), kernels.needleman_wunsch, n, "-1D"))


@query(S.aligned(S.BRODIE, "0.0", normal=True))
def sim_brodie(spark, sf, held=None):
    cat, n = held or kept(traces(spark, sf))
    return _sim(M.aligned_by(_weighted(cat, n), kernels.brodie, n, "0D", arrays=("p",)))


@query(S.aligned(S.LERCH, "0.0", normal=True, swapped=True))
def sim_lerch(spark, sf, held=None):
    cat, n = held or kept(traces(spark, sf))
    return _sim(M.aligned(_weighted(cat, n), M.lerch_sql(), n, "0D", swapped=True))


@query(S.aligned(S.MOROO, "0.0", normal=True, swapped=True))
def sim_moroo(spark, sf, held=None):
    cat, n = held or kept(traces(spark, sf))
    return _sim(M.aligned_by(_weighted(cat, n), kernels.pdm, n, "0D", swapped=True, prepare={"lerch": M.lerch_sql()}, value_sql=M.moroo_sql(pdm="value")))


@query(S.aligned(S.TRACESIM, "0.0", normal=True, swapped=True))
def sim_tracesim(spark, sf, held=None):
    cat, n = held or kept(traces(spark, sf))
    weights = {f"w{s}": M.stack_weights_sql(f"known{s}", 0.5, 0.5, 0.0) for s in "xy"}
    return _sim(M.aligned_by(_weighted(cat, n), kernels.tracesim, n, "0D", swapped=True, arrays=("w",), prepare=weights))


# ---- distributions


@query(f"SELECT * FROM ({ORACLE_SQL['sim_jaccard']}) WHERE sim > 0.1")
def threshold_filter(spark, sf):
    return sim_jaccard(spark, sf).where(F.col("sim") > 0.1)


@query(S.histogram(ORACLE_SQL["sim_cosine"], 30))
def hist_similarity(spark, sf):
    h = stats.histogram(sim_cosine(spark, sf), "sim", 30)
    return h.select(F.col("bin").cast("long").alias("bin"), rounded("low").alias("low"), rounded("high").alias("high"), "n")


@query(S.histogram(f"SELECT * FROM ({ORACLE_SQL['sim_cosine']}) WHERE sim > 0.5", 10))
def hist_above_threshold(spark, sf):
    h = stats.histogram(sim_cosine(spark, sf), "sim", 10, above=0.5)
    return h.select(F.col("bin").cast("long").alias("bin"), rounded("low").alias("low"), rounded("high").alias("high"), "n")


@query(f"""WITH s AS (SELECT a.sim AS a, b.sim AS b FROM ({ORACLE_SQL['sim_jaccard']}) a JOIN ({ORACLE_SQL['sim_cosine']}) b USING (i, j) WHERE a.sim IS NOT NULL AND b.sim IS NOT NULL),
r AS (SELECT rank() OVER (ORDER BY a) + (count(*) OVER (PARTITION BY a) - 1) / 2 AS ra, rank() OVER (ORDER BY b) + (count(*) OVER (PARTITION BY b) - 1) / 2 AS rb FROM s)
SELECT round(corr(ra, rb), 9) + 0.0 AS rho FROM r""")
def spearman(spark, sf):
    both = sim_jaccard(spark, sf).withColumnRenamed("sim", "a").join(sim_cosine(spark, sf).withColumnRenamed("sim", "b"), ["i", "j"])
    return stats.spearman(both, "a", "b").select(rounded("rho").alias("rho"))


#: The twelve measures of the pair table, in its order.
MEASURES = ["jaccard", "jaccard_bigram", "cosine", "cosine_bigram", "tfidf", "levenshtein", "pdm", "brodie", "durfex", "lerch", "moroo", "tracesim"]


@query("SELECT i, j, " + ", ".join(f"m{k}.sim AS {m}" for k, m in enumerate(MEASURES)) + " FROM " + " JOIN ".join(f"({ORACLE_SQL[f'sim_{m}']}) m{k}" + (" USING (i, j)" if k else "") for k, m in enumerate(MEASURES)))
def pair_measures(spark, sf):
    """All pairs of the catalog with all twelve measures."""
    long, held = None, kept(traces(spark, sf))  # the catalog takes a shuffle of all texts
    for k, m in enumerate(MEASURES):
        part = QUERIES[f"sim_{m}"](spark, sf, held).select("i", "j", F.lit(k).alias("k"), "sim")
        long = part if long is None else long.union(part)
    return long.groupBy("i", "j").agg(*(F.max(F.when(F.col("k") == k, F.col("sim"))).alias(m) for k, m in enumerate(MEASURES)))


@query(f"SELECT i, j, place % 5 = 0 AS validation FROM ({ORACLE_SQL['pair_index']})")
def pair_split(spark, sf):
    """Four fifths of the pairs for training, one for validation."""
    return X.split(pair_index(spark, sf), F.col("place")).select("i", "j", "validation")


@query(S.kendall(ORACLE_SQL['pair_measures'], MEASURES))
def kendall(spark, sf):
    """Rank correlations of each two of the twelve measures."""
    wide = stored(pair_measures(spark, sf), "pairs")
    return stats.kendall_matrix(wide, MEASURES).withColumn("tau", rounded("tau"))


# ---- band index over sign hashes


def _hashes(spark, sf) -> DataFrame:
    return lsh.sign_hash(table(spark, sf, "embeddings"))


def _vectors(spark, sf) -> DataFrame:
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))


@query(f"WITH {S.EMB} SELECT id, array_to_string(h, ' ') AS h FROM emb")
def binarize(spark, sf):
    return _hashes(spark, sf).select("id", F.array_join(F.transform("h", lambda x: x.cast("string")), " ").alias("h"))


@query("SELECT * FROM (VALUES (1, 64), (2, 32), (4, 16), (8, 8), (16, 4), (32, 2), (64, 1)) t(bands, width)")
def lsh_grid(spark, sf):
    return spark.createDataFrame(H.band_grid(BITS), "bands int, width int")


@query(f"WITH {S.EMB}, {S.band_cte('VALUES (0, 8, 8)')} SELECT band, key, array_to_string(list(id ORDER BY id), ' ') AS ids FROM held GROUP BY band, key")
def lsh_buckets(spark, sf):
    b = lsh.grouped_buckets(lsh.bands(_hashes(spark, sf), 8, 8))
    return b.select(F.col("band").cast("long").alias("band"), "key", F.array_join(F.transform("ids", lambda x: x.cast("string")), " ").alias("ids"))


@query(f"WITH {S.EMB}, {S.band_cte('VALUES (0, 8, 8)')}, {S.CAND} SELECT q, nn FROM cand")
def lsh_candidates(spark, sf):
    return lsh.code_candidates(_hashes(spark, sf), 8, 8)


@query(f"WITH {S.EMB}, {S.band_cte('VALUES (0, 8, 8)')}, {S.CAND}, {S.SIM}, r AS (SELECT q, nn, s, row_number() OVER (PARTITION BY q ORDER BY s DESC, nn) AS rank FROM cand JOIN sim USING (q, nn)) SELECT q, CAST(rank AS BIGINT) AS rank, nn, s FROM r WHERE rank <= 10")
def lsh_topk(spark, sf):
    """The flagship: sign hash, band index, exact similarity of what shares a bucket, top ten."""
    return dense.nearest_in_buckets(_vectors(spark, sf), 8, 8, 10).withColumn("rank", F.col("rank").cast("long"))


@query(f"""WITH {S.EMB}, {S.band_cte('VALUES (0, 8, 8)')}, cv AS (SELECT vec_id AS q, list_transform(embedding, lambda x: CASE WHEN x > 0.05 THEN 1 ELSE -1 END) AS h FROM embeddings),
qb AS (SELECT q, t.b AS band, array_to_string(list_slice(h, t.b * 8 + 1, t.b * 8 + 8), '') AS key FROM cv, (SELECT unnest(range(8)) AS b) t)
SELECT q, CAST(band AS BIGINT) AS band, array_to_string(list(id ORDER BY id), ' ') AS ids FROM qb JOIN band USING (band, key) GROUP BY q, band""")
def lsh_lookup_external(spark, sf):
    """Queries from outside the index: vectors whose components are shifted before their signs are taken."""
    emb = table(spark, sf, "embeddings")
    outside = emb.select("vec_id", F.transform("embedding", lambda x: x - 0.05).alias("embedding"))
    text = lambda ids: F.array_join(F.transform(ids, lambda x: x.cast("string")), " ")
    found = lsh.lookup(lsh.bands(lsh.sign_hash(outside), 8, 8), lsh.bands(lsh.sign_hash(emb), 8, 8), text)
    return found.select("q", F.col("band").cast("long").alias("band"), "ids")


@query(f"WITH {S.EMB}, {S.band_cte('VALUES (0, 4, 16)')}, {S.CAND} SELECT id FROM emb WHERE id NOT IN (SELECT q FROM cand)")
def dedup_left_anti(spark, sf):
    h = _hashes(spark, sf)
    return lsh.without_candidates(h.select("id"), lsh.candidates(lsh.bands(h, 4, 16)))


@query(f"SELECT bands, width, round(s, 9) + 0.0 AS s, round(1 - pow(1 - pow(s, width), bands), 9) + 0.0 AS p FROM (SELECT x / 99.0::DOUBLE AS s FROM range(100) t(x)), (VALUES {', '.join(map(str, GRID))}) g(bands, width)")
def collision_curve(spark, sf):
    return lsh.collision_curve(spark, GRID).select("bands", "width", rounded("s").alias("s"), rounded("p").alias("p"))


@query(f"WITH {S.EMB} SELECT a.id AS i, b.id AS j, round(list_sum(list_transform(range(8), lambda k: CASE WHEN list_slice(a.h, k * 8 + 1, k * 8 + 8) = list_slice(b.h, k * 8 + 1, k * 8 + 8) THEN 1.0::DOUBLE ELSE 0 END)) / 8, 9) + 0.0 AS agree FROM emb a JOIN emb b ON a.id < b.id")
def segment_hamming(spark, sf):
    return dense.agreeing(_vectors(spark, sf), 8)


@query(f"WITH {S.EMB} SELECT a.id AS i, b.id AS j, round(1 - list_sum(list_transform(range(8), lambda k: list_max(list_transform(range(1, 9), lambda m: abs(a.v[k * 8 + m] - b.v[k * 8 + m]))))) * 8 / 128, 9) + 0.0 AS soft FROM emb a JOIN emb b ON a.id < b.id")
def soft_hamming(spark, sf):
    return dense.soft_agreeing(_vectors(spark, sf), 8)


# ---- retrieval metrics over the whole grid


def _counts(spark, sf, least_similar: bool = False) -> DataFrame:
    return dense.counts(_vectors(spark, sf), GRID, least_similar)


def _tops(spark, sf, k: int):
    """The k most similar candidates at each setting, the k most similar rows, and the grid."""
    rows = _vectors(spark, sf)
    return stored(dense.found_nearest(rows, GRID, k), "found"), stored(dense.nearest(rows, k), "nearest"), _grid(spark)


def _grid(spark) -> DataFrame:
    return spark.createDataFrame([(g, n, k) for g, (n, k) in enumerate(GRID)], "g int, bands int, width int")


def _value(df: DataFrame) -> DataFrame:
    return df.select("bands", "width", "q", rounded("value").alias("value"))


_BASE = f"{S.EMB}, {S.band_cte('VALUES ' + ', '.join(str((g, n, k)) for g, (n, k) in enumerate(GRID)))}, {S.CAND}, {S.SIM}, {S.FOUND}, asked AS (SELECT id AS q FROM emb)"


@query(f"WITH {S.EMB}, {S.SIM} SELECT q, CAST(rank AS BIGINT) AS rank, nn, s FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY s DESC, nn) AS rank FROM sim) WHERE rank <= 5")
def exact_knn(spark, sf):
    return dense.nearest(_vectors(spark, sf), 5).withColumn("rank", F.col("rank").cast("long"))


@query(f"WITH {_BASE} {S.SMALLEST}")
def prob_smallest(spark, sf):
    return _value(Q.smallest_of_counts(_counts(spark, sf, least_similar=True)))


@query(f"WITH {_BASE} {S.MRR}")
def mrr(spark, sf):
    return _value(dense.mean_ranks(_vectors(spark, sf), GRID))


@query(f"WITH {_BASE} {S.PRECISION}")
def precision_lsh(spark, sf):
    return _value(Q.precision_of_counts(_counts(spark, sf)))


@query(f"WITH {_BASE} {S.RECALL}")
def recall_lsh(spark, sf):
    return _value(Q.recall_of_counts(_counts(spark, sf)))


@query(f"WITH {_BASE} {S.FSCORE}")
def fscore_lsh(spark, sf):
    counts = stored(_counts(spark, sf), "counts")
    return _value(Q.f_score(Q.precision_of_counts(counts), Q.recall_of_counts(counts)))


@query(f"WITH {_BASE} {S.recall_one((1, 3, 5))}")
def recall_at_k_one(spark, sf):
    top, best, grid = _tops(spark, sf, 5)
    parts = [Q.recall_of_hits(Q.hits(top, best, k), grid, k) for k in (1, 3, 5)]
    return parts[0].union(parts[1]).union(parts[2]).withColumn("recall", rounded("recall"))


@query(f"WITH {_BASE} {S.recall_cascade((1, 3, 5))}")
def recall_at_k_cascade(spark, sf):
    top, best, _ = _tops(spark, sf, 5)
    asked = _vectors(spark, sf).select(F.col("id").alias("q"))
    parts = [Q.cascade_of_hits(Q.hits(top, best, k), asked, k) for k in (1, 3, 5)]
    return parts[0].union(parts[1]).union(parts[2]).withColumn("recall", rounded("recall"))


@query(f"WITH {_BASE}, m AS ({S.raw(S.PRECISION)}) {S.SUMMARY}")
def metric_summary(spark, sf):
    out = Q.summary(Q.precision_of_counts(_counts(spark, sf)))
    return out.select("bands", "width", *(rounded(c).alias(c) for c in out.columns[2:]))


# ---- MinHash


def _ranked(cat: DataFrame) -> DataFrame:
    words = cat.select("id", F.array_distinct(T.tokens(T.vector_text(F.col("text")))).alias("frames"))
    ranks = X.frame_dictionary(words.select("frames"))
    return words.select("id", F.explode("frames").alias("frame")).join(ranks, "frame").select("id", "rank")


@query(f"WITH {S.CAT}, {S.BAG}, {S.MINHASH} SELECT id, array_to_string(sig, ' ') AS sig FROM minhash")
def minhash_signature(spark, sf):
    cat, _ = kept(traces(spark, sf))
    return lsh.minhash(_ranked(cat)).select("id", F.array_join(F.transform("sig", lambda x: x.cast("string")), " ").alias("sig"))


@query(f"""WITH {S.CAT}, {S.BAG}, {S.MINHASH}, b AS (SELECT id, t.b AS band, array_to_string(list_transform(list_slice(sig, t.b * 8 + 1, t.b * 8 + 8), lambda x: x % 65536), ',') AS key FROM minhash, (SELECT unnest(range(8)) AS b) t)
SELECT DISTINCT x.id AS q, y.id AS nn FROM b x JOIN b y ON x.band = y.band AND x.key = y.key AND x.id <> y.id""")
def minhash_candidates(spark, sf):
    cat, _ = kept(traces(spark, sf))
    bits = lsh.minhash_bits(lsh.minhash(_ranked(cat)))
    return lsh.candidates(lsh.bands(bits, 8, 8, bits=16)).where("q <> nn")


def _min_found(spark, sf):
    cat, n = kept(traces(spark, sf))
    sims = stored(_sim(M.jaccard(_items(cat, T.word_frames(F.col("text"))), n)).where("sim is not null"), "pairs")
    real = P.symmetric(sims, "sim")
    bits = stored(lsh.minhash_bits(lsh.minhash(_ranked(cat))), "bits")
    found = stored(Q.scored(lsh.candidates(lsh.grid_bands(bits, GRID, bits=16)), real), "found")
    grid = spark.createDataFrame([(g, m, k) for g, (m, k) in enumerate(GRID)], "g int, bands int, width int")
    return found, real, grid, cat.select(F.col("id").alias("q"))


_MIN = f"""{S.CAT}, {S.BAG}, {S.MINHASH}, emb AS (SELECT id, list_transform(sig, lambda x: lpad(CAST(x % 65536 AS VARCHAR), 5, '0')) AS h FROM minhash),
{S.band_cte('VALUES ' + ', '.join(str((g, n, k)) for g, (n, k) in enumerate(GRID)))}, {S.CAND}, pair AS (SELECT * FROM ({ORACLE_SQL['sim_jaccard']}) WHERE sim IS NOT NULL),
sim AS (SELECT i AS q, j AS nn, sim AS s FROM pair UNION ALL SELECT j, i, sim FROM pair), {S.FOUND}, asked AS (SELECT id AS q FROM cat)"""


@query(f"WITH {_MIN} {S.SMALLEST}")
def minhash_prob(spark, sf):
    found, _, grid, asked = _min_found(spark, sf)
    return _value(Q.smallest_probability(found, grid, asked))


@query(f"WITH {_MIN} {S.MRR}")
def minhash_mrr(spark, sf):
    found, real, grid, asked = _min_found(spark, sf)
    return _value(Q.reciprocal_ranks(found, real, grid, asked))


@query(f"WITH {_MIN} {S.PRECISION}")
def minhash_precision(spark, sf):
    found, _, grid, asked = _min_found(spark, sf)
    return _value(Q.precision(found, grid, asked))


@query(f"WITH {_MIN} {S.RECALL}")
def minhash_recall(spark, sf):
    found, real, grid, asked = _min_found(spark, sf)
    return _value(Q.recall(found, real, grid, asked))


@query(f"WITH {_MIN} {S.recall_one((1, 3, 5))}")
def minhash_recall_at_k(spark, sf):
    found, real, grid, _ = _min_found(spark, sf)
    parts = [Q.recall_at_k(found, real, grid, k) for k in (1, 3, 5)]
    return parts[0].union(parts[1]).union(parts[2]).withColumn("recall", rounded("recall"))


@query(f"WITH {_MIN} {S.recall_cascade((1, 3, 5))}")
def minhash_recall_cascade(spark, sf):
    found, real, _, asked = _min_found(spark, sf)
    parts = [Q.cascaded_recall_at_k(found, real, asked, k) for k in (1, 3, 5)]
    return parts[0].union(parts[1]).union(parts[2]).withColumn("recall", rounded("recall"))


# ---- SimHash


@query(f"WITH {S.CAT}, {S.BAG}, {S.FNV} SELECT term, CAST(h // 4294967296 AS BIGINT) AS hi, CAST(h % 4294967296 AS BIGINT) AS lo FROM fnv")
def fnv1a64(spark, sf):
    terms = X.bag_of_frames(traces(spark, sf)).select("term").distinct()
    return terms.select("term", H.fnv1a64(F.col("term")).alias("f")).select("term", "f.hi", "f.lo")


def _codes(cat: DataFrame) -> DataFrame:
    return stored(lsh.simhash(X.bag_of_frames(cat).withColumn("w", F.col("n").cast("double"))), "codes")


@query(f"WITH {S.CAT}, {S.BAG}, {S.FNV}, {S.SIMHASH} SELECT id, array_to_string(code, '') AS code FROM simhash")
def simhash_codes(spark, sf):
    cat, _ = kept(traces(spark, sf))
    return _codes(cat).select("id", F.array_join(F.transform("code", lambda x: x.cast("string")), "").alias("code"))


@query(f"WITH {S.CAT}, {S.BAG}, {S.FNV}, {S.SIMHASH}, {S.AGREE} SELECT q, nn FROM agree WHERE c >= 4")
def simhash_candidates_c4(spark, sf):
    cat, _ = kept(traces(spark, sf))
    return lsh.agreeing_slots(_codes(cat)).where("agree >= 4").select("q", "nn")


def _sim_found(spark, sf):
    cat, n = kept(traces(spark, sf))
    counts = X.bag_of_frames(cat).withColumnRenamed("n", "w")
    sims = stored(_sim(M.cosine(counts, n)).where("sim is not null"), "pairs")
    real = P.symmetric(sims, "sim")
    found = stored(Q.scored(lsh.slot_candidates(_codes(cat)), real), "found")
    grid = spark.createDataFrame([(g, m, k) for g, (_, m, k) in enumerate(lsh.slot_grid())], "g int, bands int, width int")
    return found, real, grid, cat.select(F.col("id").alias("q"))


_SLOTS = f"{S.CAT}, {S.BAG}, {S.FNV}, {S.SIMHASH}, {S.AGREE}, {S.slot_found(lsh.slot_grid(), ORACLE_SQL['sim_cosine'])}, asked AS (SELECT id AS q FROM cat)"


@query(f"WITH {_SLOTS} {S.SMALLEST}")
def simhash_prob(spark, sf):
    found, _, grid, asked = _sim_found(spark, sf)
    return _value(Q.smallest_probability(found, grid, asked))


@query(f"WITH {_SLOTS} {S.MRR}")
def simhash_mrr(spark, sf):
    found, real, grid, asked = _sim_found(spark, sf)
    return _value(Q.reciprocal_ranks(found, real, grid, asked))


@query(f"WITH {_SLOTS} {S.PRECISION}")
def simhash_precision(spark, sf):
    found, _, grid, asked = _sim_found(spark, sf)
    return _value(Q.precision(found, grid, asked))


@query(f"WITH {_SLOTS} {S.RECALL}")
def simhash_recall(spark, sf):
    found, real, grid, asked = _sim_found(spark, sf)
    return _value(Q.recall(found, real, grid, asked))


@query(f"WITH {_SLOTS} {S.recall_one((1, 3, 5))}")
def simhash_recall_at_k(spark, sf):
    found, real, grid, _ = _sim_found(spark, sf)
    parts = [Q.recall_at_k(found, real, grid, k) for k in (1, 3, 5)]
    return parts[0].union(parts[1]).union(parts[2]).withColumn("recall", rounded("recall"))


@query(f"WITH {_SLOTS} {S.recall_cascade((1, 3, 5))}")
def simhash_recall_cascade(spark, sf):
    found, real, _, asked = _sim_found(spark, sf)
    parts = [Q.cascaded_recall_at_k(found, real, asked, k) for k in (1, 3, 5)]
    return parts[0].union(parts[1]).union(parts[2]).withColumn("recall", rounded("recall"))


#: Forms of terms besides counts of frames: (terms of a catalog of n texts as (id, term, w), their SQL and its table and weight, the measure's SQL).
_FORMS = {
    "bigram": (lambda cat, n: X.bag_of_bigrams(cat).withColumn("w", F.col("n").cast("double")).drop("n"), S.BIGRAMS, "bigrams", "n", "sim_cosine_bigram"),
    "tfidf": (lambda cat, n: X.tfidf(X.bag_of_frames(cat), n, scale=5.0), f"{S.BAG}, {S.TFIDF}", "tfidf", "5.0::DOUBLE * w", "sim_tfidf"),
}


def _register_form(form: str) -> None:
    """SimHash over bigrams, or over TF-IDF at five times its length: codes, pairs that agree in three slots, recall at k."""
    terms, parts, name, w, measure = _FORMS[form]
    codes_sql = f"{S.CAT}, {parts}, {S.fnv_of(name)}, {S.simhash_of(name, w)}"

    def weighted(spark, sf):
        cat, n = kept(traces(spark, sf))
        weights = stored(terms(cat, n), "weights")
        return weights, n, stored(lsh.simhash(weights), "codes")

    def codes(spark, sf):
        return weighted(spark, sf)[2].select("id", F.array_join(F.transform("code", lambda x: x.cast("string")), "").alias("code"))

    def pairs(spark, sf):
        return lsh.agreeing_slots(weighted(spark, sf)[2]).where("agree >= 3").select("q", "nn")

    def recall(spark, sf):
        weights, n, hashes = weighted(spark, sf)
        real = P.symmetric(stored(_sim(M.cosine(weights, n)).where("sim is not null"), "pairs"), "sim")
        found = stored(Q.scored(lsh.slot_candidates(hashes), real), "found")
        grid = spark.createDataFrame([(g, m, k) for g, (_, m, k) in enumerate(lsh.slot_grid())], "g int, bands int, width int")
        each = [Q.recall_at_k(found, real, grid, k) for k in (1, 3, 5)]
        return each[0].union(each[1]).union(each[2]).withColumn("recall", rounded("recall"))

    slots = f"{codes_sql}, {S.AGREE}, {S.slot_found(lsh.slot_grid(), ORACLE_SQL[measure])}"
    for f, label, sql in (
        (codes, "codes", f"WITH {codes_sql} SELECT id, array_to_string(code, '') AS code FROM simhash"),
        (pairs, "candidates_c3", f"WITH {codes_sql}, {S.AGREE} SELECT q, nn FROM agree WHERE c >= 3"),
        (recall, "recall_at_k", f"WITH {slots} {S.recall_one((1, 3, 5))}"),
    ):
        f.__name__ = f"simhash_{form}_{label}"
        query(sql)(f)


for _form in _FORMS:
    _register_form(_form)


# ---- lookup of traces from outside the catalog


#: Rows of the query workload, an operator of its own.
WORKLOAD = 100_000


@query(f"""WITH {S.CAT}, {S.BAG}, {S.FNV}, {S.SIMHASH},
asked AS (SELECT doc_id AS id, replace(replace(text, chr(13), ''), chr(10) || 'a', chr(10)) AS text FROM documents WHERE text IS NOT NULL ORDER BY doc_id LIMIT {WORKLOAD}),
terms AS (SELECT id, term, count(*) AS n FROM (SELECT id, unnest({S.tokens('text')}) AS term FROM asked) WHERE term IN (SELECT term FROM bag) GROUP BY ALL),
{S.simhash_of('terms', 'n', 'probe')},
held AS (SELECT id, t.b AS slot, array_to_string(list_slice(code, t.b * 8 + 1, t.b * 8 + 8), '') AS val FROM simhash, (SELECT unnest(range(8)) AS b) t),
probes AS (SELECT id, t.b AS slot, array_to_string(list_slice(code, t.b * 8 + 1, t.b * 8 + 8), '') AS val FROM probe, (SELECT unnest(range(8)) AS b) t)
SELECT p.id AS q, h.id AS nn, CAST(count(*) AS INTEGER) AS agree FROM probes p JOIN held h USING (slot, val) GROUP BY ALL HAVING count(*) >= 4""")
def workload_lookup(spark, sf):
    """A limited workload of raw traces: cleaned, counted in the catalog's terms, hashed, looked up in the catalog's slots."""
    cat, _ = kept(traces(spark, sf))
    counts = stored(X.bag_of_frames(cat), "counts")
    asked = _smallest(table(spark, sf, "documents").where("text is not null").select(F.col("doc_id").alias("id"), T.clean_trace(F.col("text")).alias("text")), WORKLOAD)
    weighted = lambda c: lsh.simhash(c.withColumn("w", F.col("n").cast("double")))
    if X.own_ids(asked):
        rows, terms = X.frames_of(asked)
        probes = lsh.simhash_rows(rows.select("id", X.counted(terms).alias("counts")), counts)
    else:
        probes = weighted(X.transform_counts(X.bag_of_frames(asked), counts))
    return lsh.slot_lookup(stored(probes, "probes"), weighted(counts), least=4)


def _smallest(rows: DataFrame, most: int) -> DataFrame:
    """The `most` rows of the smallest ids; ids alone are sorted to find where to cut, and no task gathers rows."""
    first = rows.select("id").orderBy("id").limit(most)
    last = first.agg(F.max("id")).first()[0]
    if last is None:
        return rows.limit(0)
    at_cut = rows.where(F.col("id") == last)
    room = most - rows.where(F.col("id") < last).count()
    if at_cut.count() > room:
        at_cut = at_cut.limit(room)
    return rows.where(F.col("id") < last).union(at_cut)


# ---- learned hashes, storage, streams


#: Most vectors, and pairs of them, that a tower is trained on.
TRAIN_ROWS, TRAIN_PAIRS = 1000, 8192


def _tower(spark, sf) -> learned.Dense:
    emb = table(spark, sf, "embeddings")
    norm = F.sqrt(F.aggregate(F.transform("embedding", lambda x: x.cast("double") * x.cast("double")), F.lit(0.0), lambda a, x: a + x))
    whole = emb.where(F.coalesce((norm > 0) & (norm < float("inf")), F.lit(False)))  # no nulls, no zero vectors, no NaN
    rows = whole.orderBy(F.xxhash64("vec_id"), "vec_id").limit(TRAIN_ROWS).select("embedding").toPandas()
    x = np.array(rows["embedding"].tolist(), float)
    if not len(x):
        return learned.Dense([64, 128, 64])
    rnd = np.random.default_rng(1)
    a, b = rnd.integers(0, len(x), (2, TRAIN_PAIRS))
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    want = np.clip((unit[a] * unit[b]).sum(1), 0, 1)
    tower = learned.Dense([x.shape[1], 128, 64])
    learned.train(tower, x[a], x[b], want, b=8, epochs=5)
    return tower


@query()
def learned_hash(spark, sf):
    rows = table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    out = learned.hashed(rows, _tower(spark, sf), "embedding")
    return out.select("id", F.array_join(F.transform(H.binarized(F.col("h")), lambda x: x.cast("string")), " ").alias("h"))


@query()
def learned_output_shape(spark, sf):
    rows = table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    return stats.output_shape(learned.hashed(rows, _tower(spark, sf), "embedding"))


@query("SELECT doc_id, md5(text) AS digest, n_chars FROM documents")
def csv_round_trip(spark, sf):
    """Documents through a CSV sink and source."""
    docs = table(spark, sf, "documents").select("doc_id", "text", "n_chars")
    path = f"{shared_dir(spark)}/csv-{uuid.uuid4().hex}"
    io.write_csv(docs, path)
    back = io.read_csv(spark, path, "doc_id long, text string, n_chars long")
    return back.select("doc_id", F.md5("text").alias("digest"), "n_chars")


@query(f"WITH {S.CAT} SELECT id, md5(text) AS digest, length(text) AS n_chars FROM cat")
def catalog_sink(spark, sf):
    """The catalog through its CSV sink."""
    path = f"{shared_dir(spark)}/catalog-{uuid.uuid4().hex}"
    io.write_csv(traces(spark, sf), path)
    return io.read_csv(spark, path, "id long, text string").select("id", F.md5("text").alias("digest"), F.length("text").cast("long").alias("n_chars"))


@query(f"SELECT i, j, x.sim AS jaccard, y.sim AS cosine FROM ({ORACLE_SQL['sim_jaccard']}) x JOIN ({ORACLE_SQL['sim_cosine']}) y USING (i, j)")
def pair_sink(spark, sf):
    """Pairs with two measures, one of which may be null, through the sink of pair measures."""
    path = f"{shared_dir(spark)}/measures-{uuid.uuid4().hex}"
    both = sim_jaccard(spark, sf).withColumnRenamed("sim", "jaccard").join(sim_cosine(spark, sf).withColumnRenamed("sim", "cosine"), ["i", "j"])
    io.write_csv(both, path)
    return io.read_csv(spark, path, "i long, j long, jaccard double, cosine double")


@query("SELECT vec_id AS id, true AS same FROM embeddings")
def model_round_trip(spark, sf):
    """Whether a tower read back from its store gives every embedding the outputs of the tower that was trained."""
    tower, path = _tower(spark, sf), f"{shared_dir(spark)}/model-{uuid.uuid4().hex}"
    io.save_model(spark, {f"p{k}": p for k, p in enumerate(tower.params)}, path)
    arrays, back = io.load_model(spark, path), copy.deepcopy(tower)
    for k, p in enumerate(back.params):
        p[...] = 0
        p += arrays[f"p{k}"]
    rows = table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    one, two = (stored(learned.hashed(rows, t, "embedding"), "hashes") for t in (tower, back))
    return one.join(two.withColumnRenamed("h", "other"), "id").select("id", F.col("h").eqNullSafe(F.col("other")).alias("same"))


@query("SELECT round(avg(abs(x)), 9) + 0.0 AS mean_abs, round(avg(CASE WHEN abs(x) = 1 THEN 1.0::DOUBLE ELSE 0.0 END), 9) + 0.0 AS exact FROM (SELECT unnest(list_concat(CAST(embedding AS DOUBLE[]), [1.0::DOUBLE])) AS x FROM embeddings WHERE embedding IS NOT NULL)")
def output_shape(spark, sf):
    """The shape of outputs, taken of given vectors with one component of 1 more, which is neither trained nor approximate."""
    rows = table(spark, sf, "embeddings").where("embedding is not null")
    shape = stats.output_shape(rows.select("vec_id", F.concat(F.col("embedding").cast("array<double>"), F.array(F.lit(1.0))).alias("h")))
    return shape.select(rounded("mean_abs").alias("mean_abs"), rounded("exact").alias("exact"))


@query(f"WITH {S.EMB}, {S.band_cte('VALUES (0, 8, 8)')} SELECT band, count(*) AS n, count(DISTINCT key) AS keys FROM band GROUP BY band")
def index_round_trip(spark, sf):
    """A bucket table through its store."""
    path = f"{shared_dir(spark)}/index-{uuid.uuid4().hex}"
    io.write_index(lsh.bands(_hashes(spark, sf), 8, 8), path)
    return io.read_index(spark, path).groupBy(F.col("band").cast("long").alias("band")).agg(F.count("*").alias("n"), F.countDistinct("key").alias("keys"))


@query(f"WITH {S.EMB}, {S.band_cte('VALUES (0, 8, 8)')} SELECT x.id AS q, x.band, y.id AS nn FROM band x JOIN band y ON x.band = y.band AND x.key = y.key AND x.id <> y.id")
def stream_lookup(spark, sf):
    """Embeddings that arrive as a stream, looked up in the bucket table of all embeddings."""
    emb = table(spark, sf, "embeddings")
    lists, hot = (stored(x, "index") for x in lsh.bucket_lists(stored(lsh.bands(lsh.sign_hash(emb), 8, 8).where("key is not null"), "entries")))
    stream = lookup.arriving(spark, f"{sf}/embeddings.parquet", "*.parquet", emb.schema)
    base = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    found = lookup.run_to_table(lookup.lists_of_stream(stream, lists, hot, 8, 8), f"{base}/out", f"{base}/state")
    return found.select("q", F.col("band").cast("long").alias("band"), F.explode("ids").alias("nn")).where("q <> nn")
