"""Personal data by candidate gradient boosting, with DataFrame functions only.

Generators propose spans, many of them wrong and overlapping: the base patterns of each kind,
whether their checks hold or not, and wider patterns (obfuscated e-mail addresses, defanged
addresses, telephone numbers without a plus sign, grouped card numbers). A candidate becomes
twelve yes/no features of its format and context. Boosted trees for each kind learn from base and
wide candidates, for which the checks (octet range, Luhn, digit counts) say what they are, and
the checks are no features. Two kinds have checks that say too little: every base e-mail address
passes, and telephone numbers differ from other numbers by more than digit counts. They learn what is
none from decoys of the same weight in all as the right ones: words on both sides of a sentence's
end, and groups of digits that are no telephone number (addresses, card numbers, codes). Features are
those of a candidate's plain form (@ and . for their marks, no country code), so that base, wide and
decoy candidates share them. A threshold for each kind, calibrated on candidates kept from the training,
selects among the wide candidates that pass their kind's check. Of wide spans that overlap, of whatever
kinds, the one farthest above its threshold stays; none stays that overlaps a base span. Base spans that
pass their checks always stay.

Training sees counts of feature codes (4096 codes, 4 kinds, 2 labels, 2 folds: at most 65,536 rows),
gathered by a group-by over all documents; the trees become a SQL expression.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from tracewell.llm.common import boxed, cut, let as _let, most_before, pieces, sums_before, unboxed

KINDS = ("email", "ip", "card", "phone")

# The patterns of the base kinds, written without backtracking. A match of the first
# two can only begin where a run of its characters begins, or where the match before it ended.
_MAIL = "[A-Za-z0-9._%+-]"
BASE = {
    "email": rf"(?:(?<!{_MAIL})|\G){_MAIL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Wider candidates, with the marks without which a text has none.
_AT = rf"(?<!{_MAIL}){_MAIL}++ ?(?:\[at\]|\(at\)) ?[A-Za-z0-9-]++"
WIDE = {
    "email": (rf"{_AT}(?: ?(?:\.|\[dot\]|\(dot\)) ?[A-Za-z0-9-]++)+", r"[\[(]at[\])]"),
    "ip": (r"(?<![0-9.])[0-9]{1,3}(?:\[\.\][0-9]{1,3}){3}(?![0-9])", r"\[\.\]"),
    "card": (r"(?<![0-9])[0-9]{4}([ .-])[0-9]{4}\1[0-9]{4}\1[0-9]{3,4}(?![0-9])", r"[0-9]{4}[ .-][0-9]{4}"),
    "phone": (r"(?<![0-9A-Za-z+.-])(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[.-][0-9]{4}(?![0-9])", r"[0-9]{3}[.-][0-9]{4}"),
}
#: Addresses once more, ending where a sentence does: the wide pattern runs on into the next one.
ENDED = rf"{_AT}(?:(?:\.| \. | ?\[dot\] ?| ?\(dot\) ?)[A-Za-z0-9-]++)+"
#: What an address is not, as the gap between its first words were an @; and what no telephone number is.
DECOYS = {
    "email": rf"(?<![A-Za-z0-9._%+@-]){_MAIL}++ [A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)*\. [A-Za-z0-9-]++",
    "phone": r"(?<![0-9A-Za-z+.-])[0-9]++(?:[ .-][0-9]++){2,}(?![.-]?[0-9])",
}
#: What a text needs for a base candidate that can pass.
NEEDS = {"email": r"@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9](?:[ -]?[0-9]){11}", "phone": r"\+[0-9]"}
CUES = {"email": "mail|contact|write to|reach", "ip": r"\bip\b|host|server|addr", "card": "card|visa|credit|pay|account", "phone": r"tel|phone|call|fax|mobile|\bcell"}
TYPICAL = {
    "email": r"(?:\.|dot[\])] ?)[A-Za-z]{2,24}$", "ip": r"^(?!0)[0-9]{1,3}[^0-9]",
    "card": r"^[3-6][0-9]{3}([ -]?)[0-9]{4}\1[0-9]{4}\1[0-9]{3,4}$", "phone": r"[0-9]{3}[)]? ?[ .-]?[0-9]{3}[ .-]?[0-9]{4}$",
}
TREES, RATE = 24, 0.3
#: Share of right ones that the threshold of a kind must reach among the candidates kept from the training.
PRECISION = 0.98
_NO_SPANS = "cast(array() as array<struct<start:int,end:int,s:string>>)"


def _spans(text: Column, pattern: str) -> Column:
    """All matches as an array of (start, end, s), code points, in time that grows with the text."""

    def found(h: Column) -> Column:
        def placed(gaps: Column) -> Column:
            sizes = F.transform(h, lambda s, i: F.length(F.get(gaps, i)) + F.length(s))
            return _let(sums_before(sizes), lambda at: F.transform(h, lambda s, i: _let(
                (F.get(at, i) + F.length(F.get(gaps, i))).cast("int"), lambda start: F.struct(start.alias("start"), (start + F.length(s)).alias("end"), s.alias("s")))))

        return F.when(F.size(h) == 0, F.expr(_NO_SPANS)).otherwise(_let(F.split(text, pattern, -1), placed))

    return _let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), found)


def _digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether the check digit of a digit string is right."""
    def value(c: Column, i: Column) -> Column:
        twice = c.cast("int") * 2
        return F.when(i % 2 == 1, F.when(twice > 9, twice - 9).otherwise(twice)).otherwise(c.cast("int"))

    total = F.aggregate(F.transform(F.split(F.reverse(digits), ""), value), F.lit(0), lambda a, x: a + x)
    return total % 10 == 0


def passes(kind: str, s: Column) -> Column:
    """The check of a base match."""
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        return F.forall(F.split(s, r"\."), lambda p: _let(F.regexp_replace(p, "^0+", ""), lambda q: (F.length(q) < 3) | ((F.length(q) == 3) & (q <= "255"))))
    return _let(_digits(s), lambda d: F.length(d).between(12, 19) & luhn(d) if kind == "card" else F.length(d).between(9, 15))


def base_spans(text: Column, kind: str) -> Column:
    return F.when(text.rlike(NEEDS[kind]), F.filter(_spans(text, BASE[kind]), lambda x: passes(kind, x["s"]))).otherwise(F.expr(_NO_SPANS))


def plain(kind: str, s: Column) -> Column:
    """A candidate as the base pattern would have it: @ and . for their marks (and @ for the first gap of a decoy), no country code."""
    if kind == "email":
        s = F.regexp_replace(F.regexp_replace(s, r" ?[\[(]at[\])] ?", "@"), r" ?[\[(]dot[\])] ?| \. ", ".")
        return F.regexp_replace(s, "^([^ @]+) ", "$1@")
    if kind == "ip":
        return F.replace(s, F.lit("[.]"), F.lit("."))
    return F.regexp_replace(s, r"^\+[0-9]{1,3}[ .-]?", "") if kind == "phone" else s


_CANDIDATE = "struct<start:int,kind:int,end:int,s:string,label:int>"


def _candidates(spans: Column, k: int, label) -> Column:
    """Spans of kind number k as candidates (start, kind, end, s in its plain form, label)."""
    return F.transform(spans, lambda x: F.struct(x["start"].alias("start"), F.lit(k).alias("kind"), x["end"].alias("end"), plain(KINDS[k], x["s"]).alias("s"), label(x).cast("int").alias("label")))


def features(parts: Column, x: Column) -> list[Column]:
    """Yes/no features of candidate x in a text cut to parts; none is the check of its kind."""
    s, near, after = x["s"], cut(parts, F.greatest(F.lit(0), x["start"] - 24), x["start"]), cut(parts, x["end"], x["end"] + 1)

    def by_kind(value: Column, patterns: dict[str, str], flags: str = "") -> Column:
        out = F.lit(False)
        for k, kind in enumerate(KINDS):
            out = F.when(x["kind"] == k, value.rlike(f"{flags}(?:{patterns[kind]})")).otherwise(out)
        return out

    n = F.length(_digits(s))
    return [
        F.contains(s, F.lit("_")), n >= 10, n >= 14, F.startswith(s, F.lit("+")), F.contains(s, F.lit("(")), F.contains(s, F.lit(".")),
        F.contains(s, F.lit("-")), F.contains(s, F.lit(" ")), (x["start"] == 0) | near.rlike(r"[\s:=(\"'<]$"), after.rlike(r"^(?:$|[\s.,;:)\"'>])"),
        by_kind(near, CUES, "(?i)"), by_kind(s, TYPICAL),
    ]


def _coded(parts: Column, x: Column) -> Column:
    return sum((f.cast("int") * (1 << i) for i, f in enumerate(features(parts, x))), F.lit(0))


def boost(counts: list[tuple[int, int, float]]) -> list[tuple]:
    """Logistic boosting of depth-2 trees over (code, label, weight); a tree is (feature, (feature, value, value), (feature, value, value))."""
    codes = sorted({c for c, _, _ in counts})
    pos = {c: sum(w for k, y, w in counts if k == c and y) for c in codes}
    all_ = {c: sum(w for k, _, w in counts if k == c) for c in codes}
    score = dict.fromkeys(codes, 0.0)
    trees = []

    def leaf(group, g, h):
        return sum(g[c] for c in group) / (sum(h[c] for c in group) + 1.0)

    def gain(group, g, h):
        return sum(g[c] for c in group) ** 2 / (sum(h[c] for c in group) + 1.0)

    def best(group, g, h):
        options = []
        for f in range(12):
            yes = [c for c in group if c >> f & 1]
            no = [c for c in group if not c >> f & 1]
            options.append((gain(yes, g, h) + gain(no, g, h), -f, f, yes, no))
        return max(options, key=lambda o: o[:2])[2:]

    for _ in range(TREES):
        p = {c: 1 / (1 + math.exp(-score[c])) for c in codes}
        g = {c: pos[c] - all_[c] * p[c] for c in codes}
        h = {c: all_[c] * p[c] * (1 - p[c]) for c in codes}
        f, yes, no = best(codes, g, h)
        sides = []
        for group in (yes, no):
            # a side that no candidate is on says nothing: it has the value of both
            both = group or codes
            f2, y2, n2 = best(both, g, h)
            a, b = RATE * leaf(y2 or both, g, h), RATE * leaf(n2 or both, g, h)
            sides.append((f2, a, b))
            for c in y2 if group else ():
                score[c] += a
            for c in n2 if group else ():
                score[c] += b
        trees.append((f, *sides))
    return trees


def tree_score(trees: list[tuple], code: int) -> float:
    return sum(v[1] if code >> v[0] & 1 else v[2] for f, yes, no in trees for v in (yes if code >> f & 1 else no,))


def _score(trees: list[tuple], code: str) -> str:
    """The trees as a SQL expression over the expression `code`."""
    leaf = lambda v: f"if({code} & {1 << v[0]} != 0, {v[1]!r}D, {v[2]!r}D)"
    return " + ".join(f"if({code} & {1 << f} != 0, {leaf(yes)}, {leaf(no)})" for f, yes, no in trees) or "0D"


def fit(docs: DataFrame) -> dict[str, tuple[list[tuple], float]]:
    """(trees, threshold) of each kind, from all documents with an id and a text; a quarter of them, by a hash of the id, is kept from the training for the thresholds."""
    known = docs.where("doc_id is not null and text is not null").select("doc_id", F.col("text").cast("string").alias("text"))
    t, parts = F.col("text"), F.col("parts")
    found = []
    for k, kind in enumerate(KINDS):
        base = F.when(t.rlike(NEEDS[kind]), _spans(t, BASE[kind])).otherwise(F.expr(_NO_SPANS))
        base = F.filter(base, lambda x: F.length(x["s"]) >= 9) if kind == "card" else base
        found.append(_candidates(base, k, lambda x: passes(kind, x["s"])))
        if kind in ("ip", "card"):
            wide = F.when(t.rlike(WIDE[kind][1]), _spans(t, WIDE[kind][0])).otherwise(F.expr(_NO_SPANS))
            found.append(_candidates(wide, k, lambda x: passes(kind, plain(kind, x["s"]))))
        if kind in DECOYS:
            decoys = F.filter(_spans(t, DECOYS[kind]), lambda x: ~x["s"].rlike(TYPICAL[kind])) if kind == "phone" else _spans(t, DECOYS[kind])
            found.append(_candidates(decoys, k, lambda x: F.lit(0)))
    rows = known.select("doc_id", pieces(t).alias("parts"), F.concat(*found).alias("found"))
    rows = rows.select(F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(4)).alias("part"), F.explode(F.transform("found", lambda x: F.struct(x["kind"].alias("kind"), _coded(parts, x).alias("code"), x["label"].alias("label")))).alias("c")).select("part", "c.*")
    counts = rows.groupBy("kind", "code", "label", (F.col("part") == 0).alias("kept")).count().collect()
    models = {}
    for k, kind in enumerate(KINDS):
        own = sorted((r.code, r.label, r["count"], r.kept) for r in counts if r.kind == k)
        if kind in DECOYS:  # wrong ones weigh as much as right ones, in the training and among the kept
            sums = {(y, kept): sum(r[2] for r in own if r[1] == y and r[3] == kept) for y in (0, 1) for kept in (False, True)}
            own = [(c, y, w if y or not sums[1, kept] else w * sums[1, kept] / sums[0, kept], kept) for c, y, w, kept in own]
        train = [(c, y, w) for c, y, w, kept in own if not kept and w]
        if not train:
            models[kind] = ([], math.inf)
            continue
        trees = boost(train)
        held = sorted(((tree_score(trees, c), y, w) for c, y, w, kept in own if kept), reverse=True)
        # the lowest score above which the kept candidates are right often enough, and likely ones in any case
        least, right, seen = math.inf, 0, 0
        for s, y, w in held:
            right, seen = right + w * y, seen + w
            if s > 0 and right >= PRECISION * seen:
                least = s - 1e-9  # sums in SQL may round otherwise
        models[kind] = (trees, least)
    return models


def find(docs: DataFrame, models: dict, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """docs' columns `keep` with spans: (start, kind number, end, base) by start, kind, end; null texts have none."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    t, parts = F.col("_text"), F.col("_parts")
    marked = t.rlike("|".join(f"(?:{WIDE[k][1]})" for k in KINDS))
    rows = docs.select(*keep, text.alias("_text")).withColumn("_parts", F.when(marked, pieces(t)).otherwise(F.expr("cast(array() as array<string>)")))
    base = F.concat(*(F.transform(base_spans(t, kind), lambda x: F.struct(x["start"].alias("start"), F.lit(k).alias("kind"), x["end"].alias("end"), F.lit(True).alias("base"))) for k, kind in enumerate(KINDS)))

    none = f"cast(array() as array<{_CANDIDATE}>)"

    def proposed(k: int, kind: str) -> Column:
        """Wide spans that pass the check of their kind, as candidates."""
        pattern, mark = WIDE[kind]
        spans = F.array_distinct(F.concat(_spans(t, pattern), _spans(t, ENDED))) if kind == "email" else _spans(t, pattern)
        checked = F.filter(spans, lambda x: passes(kind, plain(kind, x["s"])))
        return F.when(t.rlike(mark), _candidates(checked, k, lambda x: F.lit(1))).otherwise(F.expr(none))

    used = [(k, kind) for k, kind in enumerate(KINDS) if math.isfinite(models[kind][1])]
    over = "".join(f" when x.kind = {k} then {_score(models[kind][0], 'x.code')} - {models[kind][1]!r}D" for k, kind in used)
    # in steps, each over the columns of those before
    rows = rows.withColumn("_base", F.array_sort(base)).withColumn("_wide", F.concat(F.expr(none), *(proposed(k, kind) for k, kind in used)))
    rows = rows.withColumn("_wide", F.transform("_wide", lambda x: F.struct(x["start"].alias("start"), x["kind"].alias("kind"), x["end"].alias("end"), _coded(parts, x).alias("code"))))
    scored = f"transform(_wide, x -> named_struct('start', x.start, 'kind', x.kind, 'end', x.end, 'over', case{over} else -1D end))" if used else _WIDE
    rows = rows.withColumn("_wide", F.expr(scored))
    rows = rows.withColumn("_wide", F.array_sort(F.filter("_wide", lambda x: x["over"] >= 0)))
    rows = _best(_apart(rows))
    wide = F.transform("_wide", lambda x: F.struct(x["start"].alias("start"), x["kind"].alias("kind"), x["end"].alias("end"), F.lit(False).alias("base")))
    return rows.select(*keep, F.array_sort(F.concat("_base", wide)).alias("spans"), F.col("_text").alias("text"))


_WIDE = "cast(array() as array<struct<start:int,kind:int,end:int,over:double>>)"


def _apart(rows: DataFrame) -> DataFrame:
    """rows without the spans of _wide that a span of _base overlaps: none of those that begin before its end goes beyond its start."""
    events = F.concat(
        F.transform("_wide", lambda x: F.struct(x["end"].alias("at"), F.lit(0).alias("is_base"), x.alias("x"), F.lit(-1).alias("reach"))),
        F.transform("_base", lambda x: F.struct(x["start"].alias("at"), F.lit(1).alias("is_base"), F.lit(None).cast("struct<start:int,kind:int,end:int,over:double>").alias("x"), x["end"].alias("reach"))))
    none = F.expr("cast(array() as array<struct<at:int,is_base:int,x:struct<start:int,kind:int,end:int,over:double>,reach:int>>)")
    rows = rows.withColumn("_events", F.when(F.size("_wide") == 0, none).otherwise(F.array_sort(events)))
    rows = rows.withColumn("_reach", most_before(F.transform("_events", lambda x: x["reach"])))
    left = F.filter("_events", lambda x, i: (x["is_base"] == 0) & (F.get("_reach", i) <= x["x"]["start"]))
    return rows.withColumn("_wide", F.array_sort(F.transform(left, lambda x: x["x"]))).drop("_events", "_reach")


def _in_runs(rows: DataFrame, spans: str, out: str) -> DataFrame:
    """rows with a column `out`: the spans (sorted by start) in runs of such as overlap one after the other."""
    rows = rows.withColumn("_reach", most_before(F.transform(spans, lambda x: x["end"])))
    rows = rows.withColumn("_opens", F.when(F.size(spans) > 0, F.filter(F.sequence(F.lit(0), F.size(spans) - 1), lambda i: F.get(spans, i)["start"] >= F.get("_reach", i))).otherwise(F.expr("cast(array() as array<int>)")))
    return rows.withColumn(out, F.transform("_opens", lambda s, j: F.slice(spans, s + 1, F.coalesce(F.get("_opens", j + 1), F.size(spans)) - s))).drop("_reach", "_opens")


def _best(rows: DataFrame) -> DataFrame:
    """rows whose spans of _wide don't overlap: the one farthest above its threshold stays (the first, at a draw), then the best of what is left."""
    overlap = lambda x, y: (x["start"] < y["end"]) & (y["start"] < x["end"])

    def chosen(run: Column) -> Column:
        ranked = F.array_sort(F.transform(run, lambda x: F.struct((-x["over"]).alias("order"), x.alias("x"))))
        return F.aggregate(ranked, F.expr(_WIDE), lambda got, y: F.when(F.exists(got, lambda x: overlap(x, y["x"])), got).otherwise(F.concat(got, F.array(y["x"]))))

    return _in_runs(rows, "_wide", "_runs").withColumn("_wide", F.flatten(F.transform("_runs", chosen))).drop("_runs")


def listed(spans: Column) -> Column:
    """kind:start:end of each span, joined by commas."""
    name = lambda k: F.element_at(F.array(*map(F.lit, KINDS)), k + 1)
    return F.concat_ws(",", F.transform(spans, lambda x: F.concat_ws(":", name(x["kind"]), x["start"].cast("string"), x["end"].cast("string"))))


def detect(docs: DataFrame) -> DataFrame:
    """(doc_id, text, spans) of every row of docs (doc_id, text), by models fitted on docs.

    Null texts count as empty; repeated rows come each; null ids are never in the training sample;
    other columns are ignored. An empty table gives an empty result (and models that add nothing).
    """
    return find(docs.select("doc_id", "text"), fit(docs))


def redact(docs: DataFrame) -> DataFrame:
    """docs with each found span of text replaced by its kind in brackets; overlapping spans become one. Null texts stay null."""
    marked = find(boxed(docs, "text").withColumn("none", F.col("text").isNull()), fit(docs), ("box", "none"))
    name = lambda k: F.concat(F.lit("["), F.upper(F.element_at(F.array(*map(F.lit, KINDS)), k + 1)), F.lit("]"))
    one = lambda run: F.struct(F.get(run, 0)["start"].alias("start"), F.array_max(F.transform(run, lambda x: x["end"])).alias("end"), F.get(run, 0)["kind"].alias("kind"))
    rows = _in_runs(marked, "spans", "_runs").withColumn("gone", F.transform("_runs", one)).withColumn("parts", F.when(F.size("spans") > 0, pieces(F.col("text"))))
    parts, gone = F.col("parts"), F.col("gone")
    kept = F.transform(gone, lambda x, i: F.concat(cut(parts, F.coalesce(F.get(gone, i - 1)["end"], F.lit(0)), x["start"]), name(x["kind"])))
    new = F.concat(F.array_join(kept, ""), cut(parts, F.element_at(gone, -1)["end"], F.length("text")))
    return unboxed(rows.withColumn("text", F.when(F.col("none"), F.lit(None)).when(F.size("spans") == 0, F.col("text")).otherwise(new)), docs, "text")
