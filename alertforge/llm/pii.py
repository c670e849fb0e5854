"""Personal data: format rules, then candidates judged by boosted trees.

*Base spans* follow fixed formats (e-mail, IP, card, phone) with validation.
*Candidates* come from high-recall generators whose spans may overlap each
other: anything around an at sign, runs of digits and separators, long tokens
that mix letters and digits, and values assigned to a secret's name. Gradient
boosted trees score each candidate from format and context features; it is
added where its probability reaches the kind's threshold and it overlaps no
base span and no better candidate.

*Fit*: the candidates of all documents, labelled by validation the features do
not see (Luhn digit, number ranges, a secret's name in front). Candidates with
equal features and label are one example with their number as weight, so the
trees learn from every candidate while their table follows the distinct ones.
A hash of doc_id splits the documents: four fifths train the trees; the others
set each kind's threshold, the lowest one whose accepted candidates are right
at a rate of ``MIN_PRECISION`` or more. The trees are then compiled to one SQL
expression. The texts are searched once: base spans and candidates are stored,
and the fit, the spans and the redaction read them.

Only DataFrame and SQL functions; matching is possessive, so a long run of one
character class costs linear time.

Defined results: a null text is empty and has no spans; offsets are code
points, ends exclusive; rows are judged alone, so repeated rows get equal
spans, and a null doc_id is a value like any other. Without candidates of both
labels nothing is added. An empty table gives no rows. Extra columns pass
through; ``base``, ``spans`` and names starting with ``_pii`` are replaced.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from alertforge.llm.common import freeze, text_of

# FIXED VALUES: kinds in the order in which spans with equal start are listed.
KINDS = ("email", "ip", "card", "phone", "secret")

# The fixed formats, written so that a match can start only where a run starts
# or the last match ended, and without backtracking into a run.
BASE_PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
CANDIDATE_PATTERNS = {
    "email": r"(?:\G|(?<=[\s@<>\"',;()]))[^\s@<>\"',;()]++@[^\s@<>\"',;()]++",
    "number": r"\+?\(?[0-9](?:[\x20().\-/]{0,2}[0-9]){6,}+",
    "token": r"(?<![A-Za-z0-9_/+-])[A-Za-z0-9_/+-]{16,}+",
    "value": r"(?<=[=:]|[=:][\x20\"']|[=:]\x20[\"'])[^\s\"'=:]{6,}+",
}
SECRET_NAME = r"(?i)(password|passwd|pwd|token|secret|api[_-]?key)[\"']?\s{0,2}[=:]\s{0,2}[\"']?$"
CONTEXT_NAME = r"(?i)(password|passwd|pwd|token|secret|key|phone|tel|call|mail|card|account)\W{0,4}$"
CLOUD_KEY = r"^AKIA[0-9A-Z]{16}$"

MIN_PRECISION = 0.98
TREES, DEPTH = 12, 3
# MLlib looks for split points in all examples up to the square of this number
BINS = 1024
CONTEXT = 24
_CHUNK = 256

FEATURES = ("n_chars", "n_digits", "n_letters", "n_others", "n_at", "n_dots", "plus", "n_upper", "n_distinct",
            "named", "bounded", "digit_groups")


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _running(lengths: Column) -> Column:
    """Exclusive running sums; arrays are copied per 256 elements, not per element."""
    zero = F.lit(0).cast("long")

    def total(a: Column) -> Column:
        return F.aggregate(a, zero, lambda s, x: s + x)

    def scan(a: Column) -> Column:
        start = F.struct(zero.alias("sum"), F.array().cast("array<bigint>").alias("out"))
        return F.aggregate(a, start, lambda s, x: F.struct(
            (s["sum"] + x).alias("sum"), F.concat(s["out"], F.array(s["sum"])).alias("out")), lambda s: s["out"])

    chunks = F.transform(F.sequence(F.lit(0), F.floor((F.size(lengths) - 1) / _CHUNK).cast("int")),
                         lambda c: F.slice(lengths, c * _CHUNK + 1, _CHUNK))
    return _let(chunks, lambda cs: F.flatten(F.zip_with(
        F.transform(cs, scan), scan(F.transform(cs, total)), lambda a, b: F.transform(a, lambda x: x + b))))


def matches(text: Column, pattern: str, gate: Column) -> Column:
    """All matches as ``array<struct<start, stop, m>>``; texts that fail the gate are not searched.

    The pieces between matches and the matches themselves add up to the text,
    which gives every position.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    empty = F.array().cast("array<struct<start:bigint,stop:bigint,m:string>>")

    def place(ms: Column) -> Column:
        gaps = F.transform(F.slice(F.split(text, pattern, -1), 1, F.size(ms)), lambda p: F.length(p).cast("long"))
        lengths = F.transform(ms, lambda m: F.length(m).cast("long"))
        return _let(F.struct(gaps.alias("g"), lengths.alias("l")), lambda x: F.zip_with(
            F.zip_with(_running(F.zip_with(x["g"], x["l"], lambda a, b: a + b)), x["g"], lambda a, b: a + b),
            ms, lambda s, m: F.struct(s.alias("start"), (s + F.length(m)).alias("stop"), m.alias("m"))))

    return F.when(gate, _let(found, lambda ms: F.when(F.size(ms) > 0, place(ms)).otherwise(empty))).otherwise(empty)


def digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def _ip_ok(m: Column) -> Column:
    parts = F.transform(F.split(m, r"\."), lambda p: F.regexp_replace(p, "^0+", ""))
    return F.forall(parts, lambda p: (F.length(p) <= 3) & (F.coalesce(p.try_cast("int"), F.lit(0)) <= 255))


def _card_ok(m: Column) -> Column:
    d = digits(m)
    return F.length(d).between(14, 19) & F.call_function("luhn_check", d)


def _phone_ok(m: Column) -> Column:
    return F.length(digits(m)).between(10, 15)


_VALID = {"email": lambda m: F.lit(True), "ip": _ip_ok, "card": _card_ok, "phone": _phone_ok}


def _span(x: Column, kind: Column, rank: Column) -> Column:
    return F.struct(x["start"].alias("start"), rank.alias("rank"), x["stop"].alias("stop"), kind.alias("kind"))


def base_spans(text: Column) -> Column:
    """Sorted ``array<struct<start, rank, stop, kind>>`` of the fixed formats."""
    has_digit = text.rlike("[0-9]")
    gates = {"email": F.contains(text, F.lit("@")), "phone": F.contains(text, F.lit("+")),
             "ip": has_digit & text.rlike(r"[0-9]\.[0-9]"), "card": has_digit}

    def of(rank: int, kind: str) -> Column:
        good = F.filter(matches(text, BASE_PATTERNS[kind], gates[kind]), lambda x: _VALID[kind](x["m"]))
        return F.transform(good, lambda x: _span(x, F.lit(kind), F.lit(rank)))

    return F.sort_array(F.concat(*[of(rank, kind) for rank, kind in enumerate(KINDS[:4])]))


def _features(text: Column, x: Column) -> Column:
    """A candidate with its features and weak label inputs."""
    m = x["m"]
    before = F.substring(text, F.greatest(x["start"] - CONTEXT + 1, F.lit(1)).cast("int"),
                         F.least(x["start"], F.lit(CONTEXT)).cast("int"))
    around = F.concat(F.right(before, F.lit(1)), F.lit("\n"), F.substring(text, (x["stop"] + 1).cast("int"), F.lit(1)))

    def n(pattern: str) -> Column:
        return F.length(F.regexp_replace(m, pattern, "")).cast("double")

    values = {
        "n_chars": F.length(m).cast("double"), "n_digits": n("[^0-9]"), "n_letters": n(r"[^\p{L}]"),
        "n_others": n(r"[\p{L}0-9]"), "n_at": n("[^@]"), "n_dots": n("[^.]"),
        "plus": m.startswith("+").cast("double"), "n_upper": n("[^A-Z]"),
        "n_distinct": F.size(F.array_distinct(F.split(m, ""))).cast("double"),
        "named": before.rlike(CONTEXT_NAME).cast("double"),
        "bounded": around.rlike(r"^\W?\n\W?$").cast("double"),
        "digit_groups": F.size(F.split(F.regexp_replace(m, "[^0-9]+", " "), " ")).cast("double"),
    }
    return F.struct(x["start"].alias("start"), x["stop"].alias("stop"), x["kind"].alias("kind"),
                    (before.rlike(SECRET_NAME) | m.rlike(CLOUD_KEY)).alias("secret"),
                    *[values[f].alias(f) for f in FEATURES])


def _overlaps(a: Column, b: Column) -> Column:
    return (a["start"] < b["stop"]) & (b["start"] < a["stop"])


def candidates(text: Column, base: Column) -> Column:
    """Candidates with features; ``known`` marks those that overlap a base span."""
    gate = text.rlike("[0-9@]")

    def kind_of(name: str, m: Column) -> Column:
        if name == "email":
            return F.lit("email")
        if name == "number":
            return (F.when(m.rlike(r"^[0-9]{1,4}(\.[0-9]{1,4}){3}$"), F.lit("ip"))
                    .when(F.length(digits(m)).between(13, 19) & ~m.startswith("+"), F.lit("card"))
                    .otherwise(F.lit("phone")))
        return F.lit("secret")

    def keep(name: str, m: Column) -> Column:
        if name in ("token", "value"):  # ordinary words are no candidates
            return m.rlike("[0-9]") & m.rlike("[A-Za-z]")
        return F.lit(True)

    def of(name: str) -> Column:
        found = matches(text, CANDIDATE_PATTERNS[name],
                        gate & F.contains(text, F.lit("@")) if name == "email" else gate)
        return F.transform(F.filter(found, lambda x: keep(name, x["m"])), lambda x: F.struct(
            x["start"].alias("start"), x["stop"].alias("stop"), x["m"].alias("m"), kind_of(name, x["m"]).alias("kind")))

    every = F.array_distinct(F.concat(*[of(name) for name in CANDIDATE_PATTERNS]))
    described = F.transform(every, lambda x: _features(text, x))
    return F.transform(described, lambda c: c.withField("known", F.exists(base, lambda b: _overlaps(b, c))))


def with_candidates(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with ``base`` and ``_pii_candidates`` (and ``_pii_text``, the text with null as empty)."""
    own = ("base", "spans")
    df = docs.select(*[c for c in docs.columns if c not in own and not c.startswith("_pii")])
    df = df.withColumn("_pii_text", text_of(text))
    df = df.withColumn("base", base_spans(F.col("_pii_text")))
    return df.withColumn("_pii_candidates", candidates(F.col("_pii_text"), F.col("base")))


class SpanModel:
    """Trees as one expression, and a probability threshold per kind."""

    def __init__(self, margin: Callable[[Column], Column], thresholds: dict[str, float]) -> None:
        self.margin, self.thresholds = margin, thresholds

    def probability(self, c: Column) -> Column:
        return 1.0 / (1.0 + F.exp(-2.0 * self.margin(c)))

    def threshold(self, kind: Column) -> Column:
        out = F.lit(2.0)  # above every probability
        for k, t in self.thresholds.items():
            out = F.when(kind == k, F.lit(t)).otherwise(out)
        return out


def _compile(node, c: Column) -> Column:
    """A fitted tree's node as nested CASE expressions."""
    if node.subtreeDepth() == 0:
        return F.lit(float(node.prediction()))
    split = node.split()
    test = c[FEATURES[split.featureIndex()]] <= F.lit(float(split.threshold()))
    return F.when(test, _compile(node.leftChild(), c)).otherwise(_compile(node.rightChild(), c))


def searched(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with ``base`` and ``_pii_candidates``, stored: whatever reads them does not search again."""
    return freeze(with_candidates(docs, text).drop("_pii_text"), "pii-candidates")


def fit_model(docs: DataFrame) -> SpanModel | None:
    """Fit on the candidates of all documents."""
    return fit_searched(searched(docs.select("doc_id", "text")))


def fit_searched(rows: DataFrame) -> SpanModel | None:
    """Fit on all candidates of ``searched`` documents."""
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.feature import VectorAssembler

    c = F.col("c")
    every = (rows.select("doc_id", F.explode("_pii_candidates").alias("c"))
             .select("c.kind", *[c[f].alias(f) for f in FEATURES],
                     (c["known"] | c["secret"]).cast("double").alias("label"),
                     (F.pmod(F.xxhash64(F.lit(11), "doc_id"), F.lit(5)) == 0).alias("held")))
    examples = freeze(every.groupBy("held", "label", "kind", *FEATURES)
                    .agg(F.count(F.lit(1)).cast("double").alias("weight")), "pii-fit")
    mix = {(r["held"], r["label"]): r["n"] for r in
           examples.groupBy("held", "label").agg(F.sum("weight").alias("n")).collect()}
    if not mix.get((False, 0.0)) or not mix.get((False, 1.0)):
        return None
    data = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(examples)
    gbt = GBTClassifier(maxIter=TREES, maxDepth=DEPTH, stepSize=0.3, maxBins=BINS, seed=7, weightCol="weight")
    fitted = gbt.fit(data.where("not held").select("features", "label", "weight"))
    trees = list(zip(fitted.treeWeights, [t._call_java("rootNode") for t in fitted.trees]))

    def margin(c: Column) -> Column:
        parts = [F.lit(w) * _compile(root, c) for w, root in trees]
        out = parts[0]
        for p in parts[1:]:
            out = out + p
        return out

    model = SpanModel(margin, {})
    scored = examples.where("held").withColumn("c", F.struct(*FEATURES)) \
        .select("kind", "label", "weight", F.round(model.probability(F.col("c")), 3).alias("p"))
    # at most 1,001 probabilities a kind: precision of everything at or above each
    steps = scored.groupBy("kind", "p").agg(F.sum(F.col("label") * F.col("weight")).alias("good"),
                                            F.sum("weight").alias("n")).collect()
    for kind in KINDS:
        good = total = 0.0
        for r in sorted((r for r in steps if r["kind"] == kind), key=lambda r: -r["p"]):
            good, total = good + r["good"], total + r["n"]
            if r["p"] >= 0.5 and good >= MIN_PRECISION * total:
                model.thresholds[kind] = r["p"] - 0.0005
    return model


def find_spans(docs: DataFrame, model: SpanModel | None, text: str = "text") -> DataFrame:
    """``docs`` with ``base`` and ``spans`` (base and added), both sorted."""
    if model is None or not model.thresholds:
        df = docs.withColumn("_pii_text", text_of(text)).withColumn("base", base_spans(F.col("_pii_text")))
        return df.withColumn("spans", F.col("base")).drop("_pii_text", "_pii_candidates")
    return spans_of(with_candidates(docs, text).drop("_pii_text"), model)


def spans_of(df: DataFrame, model: SpanModel | None) -> DataFrame:
    """``searched`` documents with ``spans``."""
    if model is None or not model.thresholds:
        return df.withColumn("spans", F.col("base")).drop("_pii_candidates")
    scored = F.transform(F.filter("_pii_candidates", lambda c: ~c["known"]), lambda c: F.struct(
        c["start"].alias("start"), c["stop"].alias("stop"), c["kind"].alias("kind"),
        model.probability(c).alias("p")))
    df = df.withColumn("_pii_scored", F.when(F.size("_pii_candidates") > 0, F.filter(
        scored, lambda c: c["p"] >= model.threshold(c["kind"]))))

    def better(a: Column, b: Column) -> Column:  # a wins over an overlapping b
        return _overlaps(a, b) & ((a["p"] > b["p"]) | ((a["p"] == b["p"]) & (
            (a["start"] < b["start"]) | ((a["start"] == b["start"]) & (
                (a["stop"] > b["stop"]) | ((a["stop"] == b["stop"]) & (a["kind"] < b["kind"])))))))

    best = F.filter("_pii_scored", lambda c: ~F.exists("_pii_scored", lambda d: better(d, c)))
    rank = F.array(*[F.lit(k) for k in KINDS])
    added = F.transform(best, lambda c: _span(c, c["kind"], (F.array_position(rank, c["kind"]) - 1).cast("int")))
    return df.withColumn("spans", F.when(F.size("_pii_scored") > 0, F.sort_array(F.concat("base", added)))
                         .otherwise(F.col("base"))).drop("_pii_candidates", "_pii_scored")


def span_list(spans: Column) -> Column:
    """``kind:start:end`` joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["stop"])), ",")


def redact(docs: DataFrame, model: SpanModel | None) -> DataFrame:
    """``docs`` with each span of the text replaced by its kind in angle brackets; n_chars follows."""
    return _replaced(find_spans(docs, model), docs.columns)


def fit_and_redact(docs: DataFrame) -> DataFrame:
    """``redact`` by a model fitted on ``docs``, with one search of the texts for both."""
    rows = searched(docs)
    return _replaced(spans_of(rows, fit_searched(rows)), docs.columns)


def _replaced(found: DataFrame, columns: list[str]) -> DataFrame:
    found = found.withColumn("_t", text_of("text"))

    def step(s: Column, x: Column) -> Column:
        fresh = x["start"] >= s["at"]  # a span inside the last one adds no mark of its own
        gap = F.substring(F.col("_t"), (s["at"] + 1).cast("int"), (x["start"] - s["at"]).cast("int"))
        return F.struct(F.greatest(s["at"], x["stop"]).alias("at"),
                        F.when(fresh, F.concat(s["out"], gap, F.lit("<"), F.upper(x["kind"]), F.lit(">")))
                        .otherwise(s["out"]).alias("out"))

    clean = F.aggregate("spans", F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("out")), step,
                        lambda s: F.concat(s["out"], F.substring(F.col("_t"), (s["at"] + 1).cast("int"),
                                                                 F.lit(2147483647))))
    text = F.when(F.size("spans") > 0, clean).otherwise(F.col("text"))
    out = found.withColumn("text", text)
    if "n_chars" in columns:
        out = out.withColumn("n_chars", F.when(F.size("spans") > 0, F.length("text").cast("long"))
                             .otherwise(F.col("n_chars")))
    return out.select(*columns)
