"""Parts of the SQL (DuckDB) against which the registered queries are held."""

from __future__ import annotations

CAT = """cat AS (SELECT row_number() OVER (ORDER BY n DESC, text) - 1 AS id, text FROM (
    SELECT replace(replace(text, chr(13), ''), chr(10) || 'a', chr(10)) AS text, count(*) AS n FROM documents WHERE text IS NOT NULL GROUP BY 1 ORDER BY n DESC, 1 LIMIT 1000))"""


def vector_text(text: str) -> str:
    return f"translate({text}, chr(10) || '$/<>', ' ')"


def tokens_of(clean: str) -> str:
    return rf"regexp_extract_all(regexp_replace(lower({clean}), '[^\x00-\x7F\p{{P}}\p{{S}}\p{{Z}}\p{{C}}]', 'X', 'g'), '\b[a-z0-9_.]{{2,}}\b')"


def tokens(text: str) -> str:
    return tokens_of(vector_text(text))


BAG = f"bag AS (SELECT id, term, count(*) AS n FROM (SELECT id, unnest({tokens('text')}) AS term FROM cat) GROUP BY ALL)"
_WORDS = f"(SELECT id, {tokens('text')} AS w FROM cat)"
BIGRAMS = f"bigrams AS (SELECT id, term, count(*) AS n FROM (SELECT id, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS term FROM {_WORDS}) GROUP BY ALL)"
TFIDF = """raw AS (SELECT id, term, n * (ln((1.0 + c) / (1.0 + df)) + 1.0) AS w FROM bag JOIN (SELECT term, count(*) AS df FROM bag GROUP BY term) USING (term), (SELECT count(*) AS c FROM cat)),
tfidf AS (SELECT id, term, w / sqrt(sum(w * w) OVER (PARTITION BY id)) AS w FROM raw)"""
_PACKAGES = r"translate(array_to_string(list_transform(string_split(text, chr(10)), lambda x: regexp_replace(x, '(?s)\.?[^.]*$', '')), ' '), '$/<>', '')"
DURFEX = f"""durfex AS (SELECT id, term, count(*) AS n FROM (SELECT id, unnest(list_concat(w, list_concat(
    list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]), list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])))) AS term
    FROM (SELECT id, {tokens_of(_PACKAGES)} AS w FROM cat)) GROUP BY ALL)"""


def jaccard(items: str) -> str:
    return f"""WITH {CAT}, it AS (SELECT DISTINCT id, unnest({items}) AS item FROM cat), z AS (SELECT id, count(*) AS z FROM it GROUP BY id),
o AS (SELECT a.id AS i, b.id AS j, count(*) AS o FROM it a JOIN it b ON a.item = b.item AND a.id < b.id GROUP BY ALL)
SELECT a.id AS i, b.id AS j, round(CAST(coalesce(o, 0) AS DOUBLE) / nullif(coalesce(x.z, 0) + coalesce(y.z, 0) - coalesce(o, 0), 0), 9) + 0.0 AS sim
FROM cat a JOIN cat b ON a.id < b.id LEFT JOIN o ON o.i = a.id AND o.j = b.id LEFT JOIN z x ON x.id = a.id LEFT JOIN z y ON y.id = b.id"""


def cosine(parts: str, name: str, w: str) -> str:
    return f"""WITH {CAT}, {parts}, n AS (SELECT id, sqrt(sum(CAST({w} AS DOUBLE) * {w})) AS norm FROM {name} GROUP BY id),
d AS (SELECT a.id AS i, b.id AS j, sum(CAST(a.{w} AS DOUBLE) * b.{w}) AS dot FROM {name} a JOIN {name} b ON a.term = b.term AND a.id < b.id GROUP BY ALL)
SELECT a.id AS i, b.id AS j, round(coalesce(dot, 0.0) / nullif(x.norm * y.norm, 0), 9) + 0.0 AS sim
FROM cat a JOIN cat b ON a.id < b.id LEFT JOIN d ON d.i = a.id AND d.j = b.id LEFT JOIN n x ON x.id = a.id LEFT JOIN n y ON y.id = b.id"""


# ---- alignments: x and y are frame lists, px/py shares, gx/gy idf


def _program(first: str, left: str, cell: str) -> str:
    return f"list_reduce(range(1, len(x) + 1), lambda up, i: list_reduce(range(1, len(y) + 1), lambda row, j: list_append(row, {cell}), [{left}]), {first})[len(y) + 1]"


_ZEROS = "list_transform(range(len(y) + 1), lambda k: 0.0::DOUBLE)"
EDITS = "1 - " + _program("list_transform(range(len(y) + 1), lambda k: k::DOUBLE)", "i::DOUBLE", "least(up[j] + CASE WHEN x[i] = y[j] THEN 0 ELSE 1 END, up[j + 1] + 1, row[j] + 1)") + " / greatest(len(x), len(y))"
_PDM_TABLE = _program(_ZEROS, "0.0::DOUBLE", "greatest(up[j] + CASE WHEN x[i] = y[j] THEN exp(-0.1 * (least(i, j) - 1)) * exp(-0.1 * abs(i - j)) ELSE 0.0 END, up[j + 1], row[j])")
PDM = f"CASE WHEN x = y THEN 1.0::DOUBLE ELSE {_PDM_TABLE} / list_sum(list_transform(range(least(len(x), len(y)) + 1), lambda k: exp(-0.1 * k))) END"
PREFIX = "coalesce(list_min(list_filter(range(1, least(len(x), len(y)) + 1), lambda k: x[k] <> y[k])) - 1, 0) / greatest(len(x), len(y))::DOUBLE"
NW = _program("list_transform(range(len(y) + 1), lambda k: -k::DOUBLE)", "-i::DOUBLE", "greatest(up[j] + CASE WHEN x[i] = y[j] THEN 1.0 ELSE -1.0 END, up[j + 1] - 1, row[j] - 1)") + " / greatest(len(x), len(y))"
_SELF = "list_sum(list_transform(range(1, len({p}) + 1), lambda k: (1 - {p}[k]) * (1 - (k - 1) / len(x)::DOUBLE)))"
BRODIE = (
    _program(_ZEROS, "0.0::DOUBLE", "greatest(up[j] + CASE WHEN x[i] = y[j] THEN (1 - px[i]) * (1 - (i - 1) / len(x)::DOUBLE) * exp(-abs(i - j) / 2.0) ELSE -1.0 END, up[j + 1], row[j])")
    + f" / nullif(greatest({_SELF.format(p='px')}, {_SELF.format(p='py')}), 0)")
_IN = "sqrt(len(list_filter({w}, lambda f: f = x[k])))"
LERCH = (
    f"list_sum(list_transform(range(1, len(x) + 1), lambda k: {_IN.format(w='y')} * gx[k] * gx[k]))"
    f" / nullif(list_sum(list_transform(range(1, len(x) + 1), lambda k: CASE WHEN list_contains(y, x[k]) THEN {_IN.format(w='y')} ELSE {_IN.format(w='x')} END * gx[k] * gx[k])), 0)")
MOROO = f"CASE WHEN ({LERCH}) = 0 AND ({PDM}) = 0 THEN 0.0 ELSE ({LERCH}) * ({PDM}) / (0.5 * ({PDM}) + 0.5 * ({LERCH})) END"


def _weights(g: str) -> str:
    return f"list_transform(range(1, len({g}) + 1), lambda k: 1 / sqrt(k) / (1 + exp(-0.5 * {g}[k])))"


def _sum_of(w: str, upto: str) -> str:
    return f"coalesce(list_sum(list_slice({w}, 1, {upto})), 0.0)"


_EDIT_WEIGHTS = _program(
    f"list_transform(range(len(y) + 1), lambda k: {_sum_of('wy', 'k')})", _sum_of("wx", "i"),
    "CASE WHEN x[i] = y[j] THEN up[j] ELSE least(wx[i] + wy[j] + up[j], wx[i] + up[j + 1], wy[j] + row[j]) END")
TRACESIM = f"1 - {_EDIT_WEIGHTS} / (list_sum(wx) + list_sum(wy))"


def aligned(value: str, default: str, normal: bool = False, swapped: bool = False) -> str:
    lines = "string_split(text, chr(10))"
    frames = f"list_transform({lines}, lambda f: translate(lower(f), '$/<>', ''))" if normal else lines
    a, b = ("j", "i") if swapped else ("i", "j")
    return f"""WITH {CAT}, fr AS (SELECT id, {frames} AS f FROM cat),
it AS (SELECT id, generate_subscripts(f, 1) AS pos, unnest(f) AS item FROM fr),
st AS (SELECT item, 1 + ln(c / count(*)) AS g, count(*) / c AS p FROM it, (SELECT CAST(count(*) AS DOUBLE) AS c FROM cat) GROUP BY item, c),
fs AS (SELECT id, list(item ORDER BY pos) AS f, list(g ORDER BY pos) AS g, list(p ORDER BY pos) AS p FROM it JOIN st USING (item) GROUP BY id),
ws AS (SELECT *, {_weights('g')} AS w FROM fs),
near AS (SELECT DISTINCT a.id AS i, b.id AS j FROM it a JOIN it b ON a.item = b.item AND a.id < b.id),
ar AS (SELECT i, j, s.f AS x, t.f AS y, s.g AS gx, t.g AS gy, s.p AS px, t.p AS py, s.w AS wx, t.w AS wy FROM near JOIN ws s ON s.id = {a} JOIN ws t ON t.id = {b}),
done AS (SELECT i, j, true AS ok, {value} AS sim FROM ar)
SELECT a.id AS i, b.id AS j, CASE WHEN ok THEN round(sim, 9) + 0.0 ELSE {default}::DOUBLE END AS sim FROM cat a JOIN cat b ON a.id < b.id LEFT JOIN done ON done.i = a.id AND done.j = b.id"""


def histogram(values: str, bins: int) -> str:
    return f"""WITH v AS (SELECT sim AS v FROM ({values}) WHERE sim IS NOT NULL), e AS (SELECT min(v) AS lo, max(v) AS hi FROM v),
c AS (SELECT least(CAST(floor((v - lo) / ((hi - lo) / {bins})) AS BIGINT), {bins - 1}) AS bin, count(*) AS n FROM v, e GROUP BY 1)
SELECT b AS bin, round(lo + b * ((hi - lo) / {bins}), 9) + 0.0 AS low, round(lo + (b + 1) * ((hi - lo) / {bins}), 9) + 0.0 AS high, coalesce(n, 0) AS n FROM range({bins}) r(b) LEFT JOIN c ON bin = b, e"""


# ---- bands, metrics

EMB = "emb AS (SELECT vec_id AS id, list_transform(embedding, lambda x: CASE WHEN x > 0 THEN 1 ELSE -1 END) AS h, CAST(embedding AS DOUBLE[]) AS v FROM embeddings)"


def band_cte(grid: str) -> str:
    return f"""grid AS (SELECT * FROM ({grid}) t(g, bands, width)),
band AS (SELECT g, bands, width, id, b AS band, array_to_string(list_slice(h, b * width + 1, (b + 1) * width), '') AS key FROM emb, (SELECT g, bands, width, unnest(range(bands)) AS b FROM grid)),
held AS (SELECT * FROM band QUALIFY count(*) OVER (PARTITION BY g, band, key) > 1)"""


CAND = "cand AS (SELECT DISTINCT x.g, x.bands, x.width, x.id AS q, y.id AS nn FROM held x JOIN held y ON x.g = y.g AND x.band = y.band AND x.key = y.key)"
SIM = "sim AS (SELECT a.id AS q, b.id AS nn, round((1 + list_cosine_similarity(a.v, b.v)) / 2, 9) + 0.0 AS s FROM emb a JOIN emb b ON a.id <> b.id)"
FOUND = "found AS (SELECT g, bands, width, q, nn, s FROM cand JOIN sim USING (q, nn))"
_P = "1 - pow(1 - pow(s, width), bands)"
SMALLEST = f"SELECT grid.bands, grid.width, asked.q, round(value, 9) + 0.0 AS value FROM grid CROSS JOIN asked LEFT JOIN (SELECT g, q, 1 - pow(1 - pow(min(s), any_value(width)), any_value(bands)) AS value FROM found GROUP BY g, q) v ON v.g = grid.g AND v.q = asked.q"
MRR = """SELECT grid.bands, grid.width, asked.q, round(value, 9) + 0.0 AS value FROM grid CROSS JOIN asked LEFT JOIN (
    SELECT g, q, avg(CASE WHEN i > r THEN 1.0::DOUBLE ELSE (i + 1) / (r + 1)::DOUBLE END) AS value FROM (SELECT *, row_number() OVER (PARTITION BY g, q ORDER BY s DESC, nn) AS i FROM found) f
    JOIN (SELECT q, nn, rank() OVER (PARTITION BY q ORDER BY s DESC) AS r FROM sim) x USING (q, nn) GROUP BY g, q) v ON v.g = grid.g AND v.q = asked.q"""
PRECISION = f"SELECT grid.bands, grid.width, asked.q, round(value, 9) + 0.0 AS value FROM grid CROSS JOIN asked LEFT JOIN (SELECT g, q, avg(CASE WHEN {_P} >= 0.5 THEN 1.0::DOUBLE ELSE 0 END) AS value FROM found GROUP BY g, q) v ON v.g = grid.g AND v.q = asked.q"
RECALL = f"""SELECT grid.bands, grid.width, asked.q, round(CAST(coalesce(got, 0) AS DOUBLE) / nullif(there, 0), 9) + 0.0 AS value FROM grid CROSS JOIN asked
LEFT JOIN (SELECT g, q, count(*) FILTER ({_P} >= 0.5) AS got FROM found GROUP BY g, q) v ON v.g = grid.g AND v.q = asked.q
LEFT JOIN (SELECT g, q, count(*) FILTER ({_P} >= 0.5) AS there FROM sim, grid GROUP BY g, q) w ON w.g = grid.g AND w.q = asked.q"""


def raw(metric: str) -> str:
    """A metric before it is rounded."""
    return metric.replace("round(value, 9) + 0.0 AS value", "value").replace("round(CAST(coalesce(got, 0) AS DOUBLE) / nullif(there, 0), 9) + 0.0 AS value", "CAST(coalesce(got, 0) AS DOUBLE) / nullif(there, 0) AS value")


FSCORE = f"SELECT bands, width, q, CASE WHEN p.value = 0 OR r.value = 0 THEN 0.0::DOUBLE ELSE round(2 * p.value * r.value / (p.value + r.value), 9) + 0.0 END AS value FROM ({raw(PRECISION)}) p JOIN ({raw(RECALL)}) r USING (bands, width, q)"


def _score(k: int) -> str:
    return f"""SELECT t.g, t.q, count(hit) / {k}::DOUBLE AS score FROM (
        SELECT *, row_number() OVER (PARTITION BY g, q, s ORDER BY nn) AS o FROM (SELECT *, row_number() OVER (PARTITION BY g, q ORDER BY s DESC, nn) AS i, count(*) OVER (PARTITION BY g, q) AS many FROM found) WHERE many >= {k} AND i <= {k}) t
    LEFT JOIN (SELECT q, s, row_number() OVER (PARTITION BY q, s ORDER BY nn) AS o, 1 AS hit FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY s DESC, nn) AS i FROM sim) WHERE i <= {k}) b ON b.q = t.q AND b.s = t.s AND b.o = t.o GROUP BY t.g, t.q"""


def recall_one(ks: tuple[int, ...]) -> str:
    return " UNION ALL ".join(f"SELECT grid.bands, grid.width, {k} AS k, coalesce(queries, 0) AS queries, round(recall, 9) + 0.0 AS recall FROM grid LEFT JOIN (SELECT g, count(*) AS queries, avg(score) AS recall FROM ({_score(k)}) GROUP BY g) v USING (g)" for k in ks)


def recall_cascade(ks: tuple[int, ...]) -> str:
    return " UNION ALL ".join(f"SELECT {k} AS k, round(avg(coalesce(score, 0.0)), 9) + 0.0 AS recall FROM asked LEFT JOIN (SELECT q, arg_min(score, g) AS score FROM ({_score(k)}) GROUP BY q) USING (q)" for k in ks)


SUMMARY = """SELECT bands, width, round(avg(value), 9) + 0.0 AS mean, round(quantile_cont(value, 0.0), 9) + 0.0 AS low, round(quantile_cont(value, 0.25), 9) + 0.0 AS quarter, round(quantile_cont(value, 0.5), 9) + 0.0 AS half,
round(quantile_cont(value, 0.75), 9) + 0.0 AS three_quarters, round(quantile_cont(value, 1.0), 9) + 0.0 AS high FROM m WHERE value IS NOT NULL GROUP BY bands, width"""

# ---- MinHash and SimHash

MINHASH = """ranked AS (SELECT DISTINCT id, rank FROM bag JOIN (SELECT term, row_number() OVER (ORDER BY term) AS rank FROM (SELECT DISTINCT term FROM bag)) USING (term)),
minhash AS (SELECT id, list(m ORDER BY k) AS sig FROM (SELECT id, k, min((((7919 + 1103515245 * (k + 1)) % 2147483646 + 1) * rank + (31 + 1140671485 * (k + 1)) % 2147483647) % 2147483647) AS m FROM ranked, range(64) t(k) GROUP BY id, k) GROUP BY id)"""
def fnv_of(name: str) -> str:
    return f"""fnv AS (SELECT term, list_reduce(list_transform(string_split(term, ''), lambda c: ord(c)::HUGEINT), lambda h, c: (xor(h, c) * 1099511628211) % 18446744073709551616, 14695981039346656037::HUGEINT) AS h FROM (SELECT DISTINCT term FROM {name}))"""


def simhash_of(name: str, w: str, to: str = "simhash") -> str:
    return f"""{to} AS (SELECT id, list(CASE WHEN s > 0 THEN 1 ELSE 0 END ORDER BY k) AS code FROM (
    SELECT id, k, sum(CASE WHEN (h >> (63 - k)::INTEGER) & 1 = 1 THEN {w} ELSE -1 END) AS s FROM {name} JOIN fnv USING (term), range(64) t(k) GROUP BY id, k) GROUP BY id)"""


FNV, SIMHASH = fnv_of("bag"), simhash_of("bag", "n")
AGREE = """slots AS (SELECT id, t.b AS slot, array_to_string(list_slice(code, t.b * 8 + 1, t.b * 8 + 8), '') AS val FROM simhash, (SELECT unnest(range(8)) AS b) t),
agree AS (SELECT x.id AS q, y.id AS nn, count(*) AS c FROM slots x JOIN slots y ON x.slot = y.slot AND x.val = y.val AND x.id <> y.id GROUP BY ALL)"""


def slot_found(grid: list[tuple[int, int, int]], sims: str) -> str:
    rows = ", ".join(str((g, c, n, k)) for g, (c, n, k) in enumerate(grid))
    return f"""grid AS (SELECT * FROM (VALUES {rows}) t(g, c, bands, width)), pair AS (SELECT * FROM ({sims}) WHERE sim IS NOT NULL),
sim AS (SELECT i AS q, j AS nn, sim AS s FROM pair UNION ALL SELECT j, i, sim FROM pair),
found AS (SELECT g, bands, width, q, nn, s FROM agree JOIN grid ON agree.c >= grid.c JOIN sim USING (q, nn))"""


def kendall(measures: str, names: list[str]) -> str:
    """tau-b of each two columns. Discordant pairs are counted bit by bit of the ranks of y, in the order of (x, y): of two ranks that agree above a bit, the larger one has it and comes first."""
    items = ", ".join(f"{{'a': '{a}', 'b': '{b}', 'x': {a}, 'y': {b}}}" for i, a in enumerate(names) for b in names[i + 1 :])
    tied = "SELECT a, b, sum(n * (n - 1) // 2) AS t FROM (SELECT a, b, {c}, sum(n) AS n FROM c GROUP BY ALL) GROUP BY a, b"
    return f"""WITH w AS ({measures}), u AS (SELECT unnest([{items}]) AS m FROM w),
c AS MATERIALIZED (SELECT m.a AS a, m.b AS b, m.x AS x, m.y AS y, count(*) AS n FROM u WHERE m.x IS NOT NULL AND m.y IS NOT NULL AND (m.x <> 0 OR m.y <> 0) GROUP BY ALL),
r AS (SELECT a, b, n, row_number() OVER (PARTITION BY a, b ORDER BY x, y) AS pos, dense_rank() OVER (PARTITION BY a, b ORDER BY y) - 1 AS r FROM c),
z AS (SELECT *, max(r) OVER (PARTITION BY a, b) AS high FROM r),
o AS (SELECT a, b, n, (r >> l) & 1 AS bit, sum(CAST(n * ((r >> l) & 1) AS BIGINT)) OVER (PARTITION BY a, b, l, r >> (l + 1) ORDER BY pos ROWS UNBOUNDED PRECEDING) AS ones FROM z, range(40) t(l) WHERE (high >> l) > 0),
d AS (SELECT a, b, sum(n * ones) FILTER (bit = 0) AS d FROM o GROUP BY a, b),
g AS (SELECT a, b, sum(n) AS n, sum(n * (n - 1) // 2) AS t FROM c GROUP BY a, b), gx AS ({tied.format(c='x')}), gy AS ({tied.format(c='y')}),
s AS (SELECT g.a, g.b, g.n * (g.n - 1) // 2 AS whole, gx.t AS tx, gy.t AS ty, g.t AS txy, coalesce(d, 0) AS d FROM g JOIN gx USING (a, b) JOIN gy USING (a, b) LEFT JOIN d USING (a, b))
SELECT a, b, round(CAST(whole - tx - ty + txy - 2 * d AS DOUBLE) / nullif(sqrt(CAST(whole - tx AS DOUBLE)) * sqrt(CAST(whole - ty AS DOUBLE)), 0), 9) + 0.0 AS tau FROM s"""
