"""The registered queries of the word mover's distance; frames are the lines of a trace, as for the alignment measures."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracewell.functions import text as T
from tracewell.operators import features as X, transport
from tracewell.plans.catalog import kept, query, rounded, traces
from tracewell.plans.whole import ALL, documents

#: Nearest traces of each trace.
NEAREST = 5
_AROUND = f"list_slice(w, greatest(1, pos - {transport.REACH}), pos + {transport.REACH})"
_VECTORS = f"""{ALL}, lists AS (SELECT string_split(text, chr(10)) AS w FROM cat), places AS (SELECT unnest(w) AS term, generate_subscripts(w, 1) AS pos, w FROM lists),
met AS (SELECT term, other, count(*) AS n FROM (SELECT term, unnest({_AROUND}) AS other FROM places) GROUP BY ALL), totals AS (SELECT term, sum(n)::DOUBLE AS c FROM met GROUP BY term),
weighted AS (SELECT m.term, m.other, greatest(0.0, ln(n * (SELECT sum(c) FROM totals) / (t.c * o.c))) AS w FROM met m JOIN totals t ON t.term = m.term JOIN totals o ON o.term = m.other),
raw AS (SELECT term, d, sum(w * (CASE WHEN (('0x' || substr(md5(other), 1, {transport.DIMENSIONS // 4}))::BIGINT >> ({transport.DIMENSIONS - 1} - d)) & 1 = 1 THEN 1.0::DOUBLE ELSE -1.0 END)) AS x FROM weighted, range({transport.DIMENSIONS}) r(d) GROUP BY term, d),
vectors AS (SELECT term, d, CASE WHEN sqrt(sum(x * x) OVER (PARTITION BY term)) > 0 THEN x / sqrt(sum(x * x) OVER (PARTITION BY term)) ELSE 0.0 END AS x FROM raw)"""


@query(f"WITH {_VECTORS} SELECT md5(term) AS frame, d, round(x, 9) + 0.0 AS x FROM vectors")
def frame_vectors(spark, sf):
    """A vector for every line that any document holds, one entry a row."""
    frames = documents(spark, sf).select("id", T.lines(F.col("text")).alias("frames"))
    vectors = transport.frame_vectors(frames)
    return vectors.select(F.lower(F.hex("frame")).alias("frame"), F.posexplode("v").alias("d", "x")).select("frame", F.col("d").cast("long").alias("d"), rounded("x").alias("x"))


@query()
def wmd_nearest(spark, sf):
    """The five nearest traces of every trace of the catalog by the word mover's distance, as similarities 1 - d; exact."""
    cat, _ = kept(traces(spark, sf))
    frames = cat.select("id", T.lines(F.col("text")).alias("frames"))
    rows = transport.placed_bags(X.term_counts(frames, F.col("frames")), transport.frame_vectors(frames))
    found, _ = transport.nearest_traces(rows, NEAREST)
    return found.select("q", "rank", "nn", rounded(1 - F.col("d")).alias("sim"))
