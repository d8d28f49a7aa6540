"""Mixing documents to target weights with soft membership of domains.

A softmax classifier, fitted on a bounded sample of the labelled rows, gives every document its
probabilities p of the domains (the combinations of labels). A document of t tokens adds t * p to
the expected totals. Rates r >= 0 of the documents are fitted so that the totals of r * t * p match
the targets, by accelerated projected gradient on the squared error, from r = 1. Steps are taken in
the norm that weights a document by its tokens: then a step moves r by p . g, with g the same for all
documents, and r is a function of p and of the few numbers g of all steps. So an iteration is one
distributed sum of as many numbers as there are domains, and no rates are kept between iterations.
"""

from __future__ import annotations

from collections.abc import Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tracewell.llm.common import batch, boxed, chunks, numbered_words, small_batches, unboxed, word_hashes
from tracewell.storage import shipped, stored

#: Most labelled rows that the classifier learns from.
SAMPLE_ROWS = 4000
#: Buckets that words are hashed to, whatever their number.
BUCKETS = 8192
EPOCHS, RATE, DECAY = 250, 0.02, 3e-3
STEPS, CLOSE = 60, 1e-4
#: Rows of the sample whose words are floats at a time.
TRAINED_AT_ONCE = 256
#: Share of each domain's tokens in the mix; domains that are not named get 0.
WEIGHTS = {"quality=1,toxic=0": 0.9, "quality=0,toxic=0": 0.1}
#: A mix without repeats has this share of the largest one: domains are known by probabilities only, so rates of 1 at most fall short of it.
SLACK_ONCE = 0.97

# Classes of bytes (0 other, 1 lower case, 2 upper case, 3 digit, 4 white space, 5 punctuation).
_CLASSES = np.zeros(256, np.uint8)
_CLASSES[97:123], _CLASSES[65:91], _CLASSES[48:58] = 1, 2, 3
_CLASSES[[9, 10, 11, 12, 13, 32]] = 4
_CLASSES[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = 5
SHAPE = 8


def shapes(text: str | None, words: int, distinct: int) -> list[float]:
    """Features of a text's form."""
    b = np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)
    share = np.bincount(_CLASSES[b], minlength=6) / max(1, len(b))
    return [*share.tolist(), distinct / max(1, words), np.log1p(words) / 10]


def _bucketed(texts: list):
    """For each run of texts (start, end): tokens and shape features of each text, and its words' buckets as (text, bucket) pairs without repeats."""
    for a, b in chunks(texts):
        words, ids, counts = numbered_words(texts[a:b])
        bucket = (word_hashes(words) & np.uint64(BUCKETS - 1)).astype(np.int64)
        owner = np.repeat(np.arange(b - a), counts)
        every = np.unique(owner * max(1, len(words)) + ids)
        distinct = np.bincount(every // max(1, len(words)), minlength=b - a)
        pairs = np.unique(every // max(1, len(words)) * BUCKETS + bucket[every % max(1, len(words))]) if len(every) else every
        shape = np.array([shapes(t, n, m) for t, n, m in zip(texts[a:b], counts.tolist(), distinct.tolist())])
        yield a, b, counts, shape, pairs // BUCKETS, pairs % BUCKETS


class Classifier:
    def __init__(self, domains: list[str]):
        self.domains = domains
        self.words = np.zeros((BUCKETS, len(domains)))
        self.shape = np.zeros((SHAPE, len(domains)))
        self.bias = np.zeros(len(domains))
        self.mean, self.scale = np.zeros(SHAPE), np.ones(SHAPE)

    def posteriors(self, texts: list):
        """(tokens, probabilities) of texts, run by run."""
        for a, b, counts, shape, doc, word in _bucketed(texts):
            z = (shape - self.mean) / self.scale @ self.shape + self.bias
            if len(doc):
                for k in range(z.shape[1]):
                    z[:, k] += np.bincount(doc, self.words[word, k], minlength=b - a)
            p = np.exp(z - z.max(1, keepdims=True))
            yield a, b, counts, p / p.sum(1, keepdims=True)

    def train(self, shape: np.ndarray, owner: np.ndarray, word: np.ndarray, y: np.ndarray) -> None:
        """Adam on the whole sample, with weight decay. owner, word: rows and buckets that occur together."""
        self.mean, self.scale = shape.mean(0), shape.std(0) + 1e-6
        present = np.zeros((len(y), BUCKETS), np.uint8)  # as floats only a few rows at a time
        present[owner, word] = 1
        form = np.hstack([(shape - self.mean) / self.scale, np.ones((len(y), 1))]).astype(np.float32)
        w, m, v = np.zeros((BUCKETS + SHAPE + 1, len(self.domains)), np.float32), 0.0, 0.0
        want = np.eye(len(self.domains), dtype=np.float32)[y]
        for step in range(1, EPOCHS + 1):
            g = DECAY * w
            for a in range(0, len(y), TRAINED_AT_ONCE):
                part, z = present[a : a + TRAINED_AT_ONCE].astype(np.float32), form[a : a + TRAINED_AT_ONCE]
                p = part @ w[:BUCKETS] + z @ w[BUCKETS:]
                p = np.exp(p - p.max(1, keepdims=True))
                off = (p / p.sum(1, keepdims=True) - want[a : a + TRAINED_AT_ONCE]) / len(y)
                g[:BUCKETS] += part.T @ off
                g[BUCKETS:] += z.T @ off
            m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
            w -= RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        w = w.astype(np.float64)
        self.words, self.shape, self.bias = w[:BUCKETS], w[BUCKETS:-1], w[-1]


def fit_classifier(docs: DataFrame, labels: DataFrame) -> Classifier | None:
    """The classifier of the domains of labels (doc_id, quality, toxic); None if no labelled row has a document.

    Of conflicting labels of a doc_id the smallest counts, and of its texts too.
    """
    names = F.concat(F.lit("quality="), F.col("quality").cast("string"), F.lit(",toxic="), F.col("toxic").cast("string"))
    named = labels.select("doc_id", names.alias("domain")).where("doc_id is not null and domain is not null").groupBy("doc_id").agg(F.min("domain").alias("domain"))
    known = named.join(docs.where("doc_id is not null").select("doc_id").distinct(), "doc_id", "left_semi")
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE_ROWS)
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "domain").agg(F.min("text").alias("text"))

    def featured(batches):
        for rb in batches:
            texts = rb.column("text").to_pylist()
            for a, b, _, shape, doc, word in _bucketed(texts):
                sizes = np.bincount(doc, minlength=b - a)
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(sizes))), pa.int32()), pa.array(word, pa.int64()))
                yield pa.RecordBatch.from_arrays([rb.column("doc_id").slice(a, b - a), rb.column("domain").slice(a, b - a), pa.array(shape.tolist(), pa.list_(pa.float64())), lists], names=["doc_id", "domain", "shape", "words"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    got = rows.mapInArrow(featured, f"doc_id {kind}, domain string, shape array<double>, words array<long>").toArrow().sort_by([("doc_id", "ascending"), ("domain", "ascending")])
    if not got.num_rows:
        return None
    got = got.combine_chunks()
    shape = got.column("shape").combine_chunks().flatten().to_numpy().reshape(got.num_rows, SHAPE)
    words = got.column("words").combine_chunks()
    domains = got.column("domain").to_pylist()
    model = Classifier(sorted(set(domains)))
    owner = np.repeat(np.arange(got.num_rows), words.value_lengths().to_numpy())
    model.train(shape, owner, words.flatten().to_numpy(), np.array([model.domains.index(d) for d in domains]))
    return model


def rates(p: np.ndarray, steps: list[tuple[np.ndarray, float]], most: float = np.inf) -> tuple[np.ndarray, np.ndarray]:
    """(r, y) of documents with probabilities p: the rates (0 to `most`) after all steps, and the point that the next gradient is taken at."""
    r = y = np.ones(len(p))
    for g, momentum in steps:
        new = np.clip(y - p @ g, 0, most)
        r, y = new, np.clip(new + momentum * (new - r), 0, most)
    return r, y


def _rows(column: pa.Array) -> np.ndarray:
    """Equally long lists of doubles as a matrix."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1) if len(column) else np.zeros((0, 1))


def _totals(steps, most):
    schema = pa.schema([("kind", pa.string()), ("v", pa.list_(pa.float64()))])

    def run(batches):
        at_r = at_y = 0.0
        for rb in batches:
            p = _rows(rb.column("p"))
            t = rb.column("n_tokens").to_numpy(zero_copy_only=False).astype(np.float64)
            r, y = rates(p, steps, most)
            at_r, at_y = at_r + (r * t) @ p, at_y + (y * t) @ p
        if not isinstance(at_r, float):
            yield batch(schema, kind=["r", "y"], v=[at_r.tolist(), at_y.tolist()])

    return run


def fit_rates(members: DataFrame, targets: np.ndarray, most: float = np.inf) -> list[tuple[np.ndarray, float]]:
    """The steps of the fit for members (n_tokens, p); targets: expected tokens of each domain; rates are `most` at most."""
    k = len(targets)
    one = members.select(*(F.sum(F.col("n_tokens") * F.get("p", F.lit(i)) * F.get("p", F.lit(j))).alias(f"m{i}_{j}") for i in range(k) for j in range(k)), F.sum("n_tokens").alias("n")).first()
    total = float(one.n or 0)
    if not total:
        return []
    m = np.array([one[f"m{i}_{j}"] for i in range(k) for j in range(k)], float).reshape(k, k) / total
    length = 1 / max(float(np.linalg.eigvalsh(m)[-1]), 1e-12)
    steps: list[tuple[np.ndarray, float]] = []
    weight, best, chosen = 1.0, np.inf, []
    for _ in range(STEPS):
        sums = {"r": np.zeros(k), "y": np.zeros(k)}
        for row in members.select("n_tokens", "p").mapInArrow(_totals(steps, most), "kind string, v array<double>").collect():
            sums[row.kind] = sums[row.kind] + np.array(row.v)
        error = float(np.abs(sums["r"] - targets).sum() / total)
        if error < best:
            best, chosen = error, list(steps)
        if error < CLOSE:
            break
        grown = (1 + np.sqrt(1 + 4 * weight * weight)) / 2
        steps.append((length * (sums["y"] - targets) / total, (weight - 1) / grown))
        weight = grown
    return chosen


def _targets(model: Classifier, expected: np.ndarray, weights: Mapping[str, float], once: bool) -> np.ndarray:
    """Tokens of each domain in the mix: as many as the domain with the largest weight has, with rates near 1, or without repeats as the scarcest one allows."""
    w = np.array([weights.get(d, 0.0) for d in model.domains])
    if not w.sum():
        return expected
    w = w / w.sum()
    if once:
        return SLACK_ONCE * w * min(float(e / x) for e, x in zip(expected, w) if x)
    heaviest = max(range(len(w)), key=lambda i: (w[i], expected[i]))
    return w * float(expected[heaviest] / w[heaviest])


class Mix:
    """A fitted mix: the classifier, the steps of the rates, and the largest rate."""

    def __init__(self, model: Classifier | None, steps: list, most: float = np.inf):
        self.model, self.steps, self.most = model, steps, most

    def apply(self, docs: DataFrame, keep: tuple[str, ...]) -> DataFrame:
        """docs' columns `keep` with n_tokens, p and rate of every row; without a model p is empty and the rate 1."""
        shared = shipped(docs.sparkSession, (self.model, self.steps, self.most))
        schema = "".join(f"`{c}` {docs.schema[c].dataType.simpleString()}, " for c in keep)

        def run(batches):
            model, steps, most = shared()
            for rb in batches:
                texts = rb.column("_text").to_pylist()
                parts = model.posteriors(texts) if model else ((a, b, numbered_words(texts[a:b])[2], np.zeros((b - a, 0))) for a, b in chunks(texts))
                for a, b, counts, p in parts:
                    r = rates(p, steps, most)[0] if model else np.ones(b - a)
                    yield pa.RecordBatch.from_arrays(
                        [*(rb.column(c).slice(a, b - a) for c in keep), pa.array(counts, pa.int64()), pa.array(p.tolist(), pa.list_(pa.float64())), pa.array(r)],
                        names=[*keep, "n_tokens", "p", "rate"])

        return docs.select(*keep, F.col("text").cast("string").alias("_text")).mapInArrow(run, f"{schema}n_tokens long, p array<double>, rate double")


def fit(docs: DataFrame, labels: DataFrame, weights: Mapping[str, float] = WEIGHTS, most: float = np.inf, keep: tuple[str, ...] = ("doc_id",)) -> tuple[Mix, DataFrame]:
    """The mix, and the table (columns `keep`, n_tokens, p, rate 1) of all rows that it was fitted on, so that no text is classified again."""
    small_batches(docs.sparkSession)
    model = fit_classifier(docs.select("doc_id", "text"), labels)
    members = stored(Mix(model, []).apply(docs, keep), "members")
    if model is None:
        return Mix(None, []), members
    expected = members.select(*(F.sum(F.col("n_tokens") * F.get("p", F.lit(i))).alias(f"e{i}") for i in range(len(model.domains)))).first()
    expected = np.array([x or 0.0 for x in expected], float)
    return Mix(model, fit_rates(members, _targets(model, expected, weights, np.isfinite(most)), most), most), members


def _rated(members: DataFrame, mix: Mix, keep: tuple[str, ...]) -> DataFrame:
    """members with the rates of the mix; probabilities are those of the fit, so that no text is read again."""
    if not mix.model:
        return members
    steps, most = mix.steps, mix.most
    names = [*keep, "n_tokens", "p"]

    def run(batches):
        for rb in batches:
            yield pa.RecordBatch.from_arrays([*(rb.column(c) for c in names), pa.array(rates(_rows(rb.column("p")), steps, most)[0])], names=[*names, "rate"])

    schema = "".join(f"`{c}` {members.schema[c].dataType.simpleString()}, " for c in names)
    return members.select(*names).mapInArrow(run, f"{schema}rate double")


def mix_rates(docs: DataFrame, labels: DataFrame, weights: Mapping[str, float] = WEIGHTS) -> DataFrame:
    """(doc_id, n_tokens, domains, p, rate) of every row of docs (doc_id, text).

    Null and empty texts have no tokens; their rate follows from their probabilities all the same.
    Repeated rows count and come each. Labels with nulls, or of unknown documents, teach nothing; of
    conflicting labels of a doc_id the smallest counts. Without labelled documents all rates are 1. An
    empty table gives an empty result. Other columns are ignored.
    """
    mix, members = fit(docs, labels, weights)
    names = F.array(*(F.lit(d) for d in (mix.model.domains if mix.model else []))).cast("array<string>")
    return _rated(members, mix, ("doc_id",)).select("doc_id", "n_tokens", names.alias("domains"), "p", "rate")


def resample(docs: DataFrame, labels: DataFrame, weights: Mapping[str, float] = WEIGHTS, repeats: bool = False) -> DataFrame:
    """Rows of docs drawn by their rates, in docs' own columns: a rate below 1 is the chance to stay, decided by a hash of id and text.

    Without repeats the rates are fitted under a ceiling of 1, so that the rows drawn have the target
    weights (in expectation) although none comes twice; the scarcest domain limits the mix. With repeats there
    is no ceiling: the mix has as many tokens of the domain with the largest weight as docs have, a rate of
    1 or more repeats the row, and so scarcer domains reach their weights. Null and empty texts are drawn like others; equal rows share their draw,
    and null ids are told apart by their texts. Without labelled documents all rows stay once; an empty
    table gives an empty one.
    """
    keep = ("doc_id", "text", "box")
    mix, members = fit(boxed(docs, "doc_id", "text"), labels, weights, np.inf if repeats else 1.0, keep)
    rated = _rated(members, mix, keep)
    chance = F.pmod(F.xxhash64("doc_id", "text", F.lit("mix")), F.lit(1 << 30)) / float(1 << 30)
    copies = F.floor("rate") + F.when(chance < F.col("rate") - F.floor("rate"), 1).otherwise(0)
    drawn = rated.withColumn("copies", copies.cast("int")).where("copies > 0")
    if repeats:
        drawn = drawn.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    return unboxed(drawn, docs, "doc_id", "text")
