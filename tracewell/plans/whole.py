"""The registered queries that take every document: features and hashes beyond the catalog, the similarity
join of a whole table, and bucket indexes that grow. Ids are the documents' own.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, functions as F

from tracewell.functions import hashing as H, text as T
from tracewell.operators import features as X, lsh, simjoin
from tracewell.plans import sql as S
from tracewell.plans.catalog import _hashes, _ranked, query, rounded
from tracewell.sources import io
from tracewell.storage import shared_dir, stored, table
from tracewell.streaming import growing, lookup

#: All documents in place of the catalog; the fragments that read `cat` then read them.
ALL = "cat AS (SELECT doc_id AS id, replace(replace(text, chr(13), ''), chr(10) || 'a', chr(10)) AS text FROM documents WHERE text IS NOT NULL)"
#: The similarity from which documents are linked, as a fraction.
NUM, DEN = 4, 5


def documents(spark, sf) -> DataFrame:
    """(id, text): every document with a text, cleaned."""
    return table(spark, sf, "documents").where("text is not null").select(F.col("doc_id").alias("id"), T.clean_trace(F.col("text")).alias("text"))


# ---- features and hashes


def _counts(docs: DataFrame, kind) -> DataFrame:
    """(id, term, n) of a kind of terms: row by row where ids don't repeat, else grouped by id."""
    return (X.own_counts if X.own_ids(docs) else X.term_counts)(*kind(docs))


@query(f"WITH {ALL}, {S.BAG} SELECT id, term, n FROM bag")
def all_bag_of_frames(spark, sf):
    return _counts(documents(spark, sf), X.frames_of)


@query(f"WITH {ALL}, {S.BIGRAMS} SELECT id, term, n FROM bigrams")
def all_bigram_counts(spark, sf):
    return _counts(documents(spark, sf), X.bigrams_of)


@query(f"WITH {ALL}, {S.DURFEX} SELECT id, term, n FROM durfex")
def all_durfex_counts(spark, sf):
    return _counts(documents(spark, sf), X.durfex_of)


@query(f"WITH {ALL}, {S.BAG}, {S.TFIDF} SELECT id, term, round(w, 9) + 0.0 AS w FROM tfidf")
def all_tfidf(spark, sf):
    docs = documents(spark, sf)
    return X.tfidf(stored(_counts(docs, X.frames_of), "counts"), docs.count()).withColumn("w", rounded("w"))


@query(f"WITH {ALL}, {S.BAG} SELECT term, total, round(1 + ln(c / total), 9) + 0.0 AS idf, round(total / c, 9) + 0.0 AS share FROM (SELECT term, CAST(sum(n) AS BIGINT) AS total FROM bag GROUP BY term), (SELECT CAST(count(*) AS DOUBLE) AS c FROM cat)")
def all_frame_idf(spark, sf):
    docs = documents(spark, sf)
    return X.frame_statistics(X.bag_of_frames(docs), docs.count()).select("term", "total", rounded("idf").alias("idf"), rounded("share").alias("share"))


@query(f"""WITH {ALL}, {S.BAG}, b AS (SELECT item_id AS id, unnest({S.tokens('text')}) AS term FROM benchmark WHERE text IS NOT NULL)
SELECT id, term, count(*) AS n FROM b WHERE term IN (SELECT term FROM bag) GROUP BY ALL""")
def all_transform_unseen(spark, sf):
    unseen = table(spark, sf, "benchmark").where("text is not null").select(F.col("item_id").alias("id"), "text")
    return X.transform_counts(X.bag_of_frames(unseen), X.bag_of_frames(documents(spark, sf)))


@query(f"WITH {ALL}, {S.BAG}, {S.MINHASH} SELECT id, array_to_string(sig, ' ') AS sig FROM minhash")
def all_minhash_signature(spark, sf):
    return lsh.minhash(_ranked(documents(spark, sf))).select("id", F.array_join(F.transform("sig", lambda x: x.cast("string")), " ").alias("sig"))


@query(f"WITH {ALL}, {S.BAG}, {S.FNV} SELECT term, CAST(h // 4294967296 AS BIGINT) AS hi, CAST(h % 4294967296 AS BIGINT) AS lo FROM fnv")
def all_fnv1a64(spark, sf):
    terms = X.bag_of_frames(documents(spark, sf)).select("term").distinct()
    return terms.select("term", H.fnv1a64(F.col("term")).alias("f")).select("term", "f.hi", "f.lo")


@query(f"WITH {ALL}, {S.BAG}, {S.FNV}, {S.SIMHASH} SELECT id, array_to_string(code, '') AS code FROM simhash")
def all_simhash_codes(spark, sf):
    docs = documents(spark, sf)
    if X.own_ids(docs):
        rows, terms = X.frames_of(docs)
        codes = lsh.simhash_rows(rows.select("id", X.counted(terms).alias("counts")))
    else:
        codes = lsh.simhash(X.bag_of_frames(docs).withColumn("w", F.col("n").cast("double")))
    return codes.select("id", F.array_join(F.transform("code", lambda x: x.cast("string")), "").alias("code"))


# ---- similarity join


_FRAMES = "string_split(trim(replace(text, chr(10), ' '), chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), ' ')"
_JOINED = f"""{ALL}, sets AS (SELECT id, list_sort(list_distinct({_FRAMES})) AS s FROM cat), member AS (SELECT id, min(id) OVER (PARTITION BY s) AS rep FROM sets),
reps AS (SELECT rep AS id, count(*) AS copies FROM member GROUP BY rep), item AS (SELECT id, len(s) AS z, unnest(s) AS item FROM sets WHERE id IN (SELECT id FROM reps)),
links AS (SELECT a.id AS i, b.id AS j, count(*) AS shared, a.z AS size_i, b.z AS size_j FROM item a JOIN item b ON a.item = b.item AND a.id < b.id AND {DEN} * least(a.z, b.z) >= {NUM} * greatest(a.z, b.z)
    GROUP BY ALL HAVING {DEN} * count(*) >= {NUM} * (a.z + b.z - count(*)))"""


def _sets(spark, sf) -> tuple[DataFrame, DataFrame]:
    member, reps = simjoin.set_classes(stored(simjoin.item_sets(documents(spark, sf), T.word_frames(F.col("text"))), "sets"))
    return member, stored(reps, "reps")


@query(f"WITH {_JOINED} SELECT i, j, shared, round(shared / (size_i + size_j - shared)::DOUBLE, 9) + 0.0 AS sim, x.copies AS copies_i, y.copies AS copies_j FROM links JOIN reps x ON x.id = i JOIN reps y ON y.id = j")
def similar_pairs(spark, sf):
    """Pairs of classes of documents whose sets of word frames have a Jaccard similarity of 0.8 or more."""
    _, reps = _sets(spark, sf)
    pairs = simjoin.jaccard_join(reps, NUM, DEN)
    copies = lambda side: reps.select(F.col("id").alias(side), F.col("copies").alias(f"copies_{side}"))
    sim = F.col("shared") / (F.col("size_i") + F.col("size_j") - F.col("shared"))
    return pairs.join(copies("i"), "i").join(copies("j"), "j").select("i", "j", F.col("shared").cast("long").alias("shared"), rounded(sim).alias("sim"), "copies_i", "copies_j")


@query(f"""WITH {_JOINED}, both_ways AS (SELECT i AS id, j AS other FROM links UNION ALL SELECT j, i FROM links),
n AS (SELECT b.id, CAST(sum(copies) AS BIGINT) AS links FROM both_ways b JOIN reps r ON r.id = b.other GROUP BY b.id)
SELECT member.id, rep, copies, coalesce(links, 0) AS links FROM member JOIN reps ON reps.id = rep LEFT JOIN n ON n.id = rep""")
def similar_classes(spark, sf):
    """Every document with its class of equal sets, and how many documents of other classes are similar to it."""
    member, reps = _sets(spark, sf)
    return simjoin.linked_counts(member, reps, simjoin.jaccard_join(reps, NUM, DEN))


# ---- bucket indexes that grow


#: Files that the growing queries read one by one, and buckets of a bucketed table.
ARRIVALS, BUCKETS = 4, 16
_BANDS = f"{S.EMB}, {S.band_cte('VALUES (0, 8, 8)')}"


@query(f"WITH {_BANDS} SELECT x.id AS j, x.band, y.id AS i FROM band x JOIN band y ON x.band = y.band AND x.key = y.key AND y.id < x.id")
def growing_index(spark, sf):
    """Embeddings that arrive in several batches, each looked up among all before it and then entered."""
    base = f"{shared_dir(spark)}/growing-{uuid.uuid4().hex}"
    emb = table(spark, sf, "embeddings").select("vec_id", "embedding")
    emb.repartition(ARRIVALS, "vec_id").write.parquet(f"{base}/in")
    growing.grow(lsh.bands(lsh.sign_hash(lookup.arriving(spark, f"{base}/in", "*.parquet", emb.schema)), 8, 8), base)
    return growing.links(spark, base).select(F.greatest("q", "nn").alias("j"), F.col("band").cast("long").alias("band"), F.least("q", "nn").alias("i"))


@query(f"WITH {_BANDS} SELECT x.id AS q, x.band, y.id AS nn FROM band x JOIN band y ON x.band = y.band AND x.key = y.key AND x.id <> y.id")
def index_append(spark, sf):
    """A bucketed table of two generations, even ids and then odd ones, probed by all embeddings without a shuffle of the table."""
    name = f"buckets_{uuid.uuid4().hex}"
    banded = lsh.bands(_hashes(spark, sf), 8, 8)
    io.save_buckets(banded.where("pmod(id, 2) = 0"), name, f"{shared_dir(spark)}/{name}", BUCKETS)
    io.append_buckets(banded.where("pmod(id, 2) <> 0"), name, BUCKETS)
    return io.probe_buckets(banded, name).select("q", F.col("band").cast("long").alias("band"), "nn")
