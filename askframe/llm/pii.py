"""Personal data by candidate gradient boosting, with built-in functions only.

A null text is an empty one.  High-recall generators propose overlapping spans;
boosted trees score them from their format and context; a threshold for each
kind selects.  Spans of the base patterns always stay.  The
trees are fitted on the candidates of all documents, or of at most ``max_docs``
where a caller says so, labelled by checks that the features do not see; every
text is scanned whole, and the threshold of each kind is read from the
candidates of all documents.
"""

from __future__ import annotations

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from askframe.llm.common import stored
from askframe.llm.spans import matches, running

PRECISION = 0.95
KINDS = ["email", "ip", "card", "phone"]

# Possessive and anchored forms of the base patterns: the same matches, in linear time and without deep recursion.
LOCAL = r"A-Za-z0-9._%+-"
PATTERNS = {
    "email": rf"(?:\G|(?<![{LOCAL}]))[{LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
# Characters or short patterns without which a text has no match.
NEEDS = {"email": "@", "ip": ".", "card": None, "phone": "+"}
OCTET = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"

# Generators: kind and pattern, from loose to looser.
PROPOSALS = [
    ("secret", r"AKIA[0-9A-Z]{12,}+"),
    ("secret", r"(?i)(?:password|passwd|pwd|secret|token|api[_-]?key)[\x20]?[=:][\x20]?[^\s,;]{6,}+"),
    ("secret", r"(?<![A-Za-z0-9])(?=[a-f]*+[0-9])[0-9a-f]{32,}+(?![A-Za-z0-9])"),
    ("secret", r"(?<![A-Za-z0-9])(?:ghp_|sk-|xox[abp]-|eyJ)[A-Za-z0-9_.-]{12,}+"),
    ("ssn", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"),
    ("iban", r"(?<![A-Z0-9])[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}+(?![A-Z0-9])"),
    ("email", r"(?<![A-Za-z0-9._-])[A-Za-z0-9._-]++ ?[(\[]at[)\]] ?[A-Za-z0-9-]++ ?[(\[]?(?:dot|\.)[)\]]? ?[A-Za-z]{2,}"),
    ("phone", r"(?<![0-9+])\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9])"),
    ("number", r"(?<![0-9])[0-9](?:[\x20().-]{0,2}[0-9]){6,}+"),
]


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]++", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    each = F.transform(F.split(F.reverse(digits), ""), lambda c, i: F.when(i % 2 == 0, c.try_cast("int")).otherwise(F.when(c.try_cast("int") > 4, c.try_cast("int") * 2 - 9).otherwise(c.try_cast("int") * 2)))
    return F.aggregate(each, F.lit(0), lambda a, b: a + F.coalesce(b, F.lit(0))) % 10 == 0


def valid(kind: str, text: Column) -> Column:
    digits = _digits(text)
    if kind == "ip":
        return F.regexp_like(text, F.lit(rf"^{OCTET}\.{OCTET}\.{OCTET}\.{OCTET}$"))
    if kind == "card":
        return F.length(digits).between(16, 19) & luhn(digits)
    if kind == "phone":
        return F.length(digits).between(8, 15)
    return F.lit(True)


def _span(kind, m: Column) -> Column:
    return F.struct(F.lit(kind).alias("kind"), m["start"].alias("start"), m["end"].alias("end"), m["text"].alias("text"))


def _none() -> Column:
    return F.expr("cast(array() as array<struct<kind:string,start:int,end:int,text:string>>)")


def _scan(text: Column, kind: str, pattern: str, gate: Column) -> Column:
    found = F.transform(matches(text, pattern), lambda m: _span(kind, m))
    return F.when(gate, found).otherwise(_none())


def _valid_only(spans: Column, kind: str) -> Column:
    return F.filter(spans, lambda s: valid(kind, s["text"]))


def base_spans(text: Column) -> Column:
    """Valid matches of the base patterns, by kind as listed and then by start."""
    parts = []
    for kind in KINDS:
        need = NEEDS[kind]
        gate = text.contains(need) if need else F.regexp_like(text, F.lit("[0-9][ -]?[0-9]"))
        if kind == "ip":
            gate = F.regexp_like(text, F.lit(r"[0-9]\.[0-9]"))
        parts.append(_valid_only(_scan(text, kind, PATTERNS[kind], gate), kind))
    return F.concat(*parts)


def proposals(text: Column) -> Column:
    """Spans of all generators, overlaps included."""
    return F.concat(*[_scan(text, kind, p, F.regexp_like(text, F.lit(p))) for kind, p in PROPOSALS])


FEATURES = ["length", "digits", "letters", "upper", "marks", "distinct", "hint", "plus", "joined_before", "joined_after", "kind"]
HINT = r"(?i)(?:mail|contact|phone|tel|call|fax|card|visa|pay|account|iban|ssn|password|passwd|secret|token|key|login|user)"


def features(text: Column, s: Column) -> Column:
    """Format of a span and what stands around it, as an array of doubles."""
    t = s["text"]
    n = F.greatest(F.lit(1), F.length(t)).cast("double")
    share = lambda p: F.length(F.regexp_replace(t, p, "")) / n
    before = F.substring(text, F.greatest(F.lit(1), s["start"] - 19), F.least(F.lit(20), s["start"]))
    after = F.substring(text, s["end"] + 1, F.lit(1))
    kinds = sorted({k for k, _ in PROPOSALS} | set(KINDS))
    number = F.element_at(F.create_map(*[x for i, k in enumerate(kinds) for x in (F.lit(k), F.lit(float(i)))]), s["kind"])
    flag = lambda c: c.cast("double")
    return F.array(
        n,
        share("[^0-9]++"),
        share("[^A-Za-z]++"),
        share("[^A-Z]++"),
        share("[A-Za-z0-9]++"),
        F.size(F.array_distinct(F.split(t, ""))) / n,
        flag(F.regexp_like(F.concat(before, t), F.lit(HINT))),
        flag(before.endswith("+") | t.startswith("+")),
        flag(F.regexp_like(before, F.lit("[A-Za-z0-9]$"))),
        flag(F.regexp_like(after, F.lit("^[A-Za-z0-9]"))),
        number,
    )


# Last parts of addresses that count as known; the label of an address follows them.
TOP_DOMAINS = "com|org|net|edu|gov|mil|int|info|biz|io|co|me|dev|app|example|test|uk|de|fr|es|it|nl|ch|at|pl|se|no|dk|fi|pt|be|eu|us|ca|au|nz|in|jp|cn|br|mx|ru"


def checksum_97(text: Column) -> Column:
    """Whether an account number leaves 1 by 97: its first four characters moved behind, letters read as 10 to 35."""
    moved = F.concat(F.substring(text, F.lit(5), F.length(text)), F.substring(text, 1, 4))
    value = lambda c: F.coalesce(c.try_cast("int"), F.ascii(c) - 55)
    step = lambda a, c: F.when(value(c) > 9, (a * 100 + value(c)) % 97).otherwise((a * 10 + value(c)) % 97)
    return F.aggregate(F.split(moved, ""), F.lit(0), step) == 1


def silver(s: Column) -> Column:
    """Label of a candidate by a check of its value for each kind; none of them is a feature.

    Checksums of cards and accounts, numbers that are given out, known ends of
    addresses, and for secrets a value that is no word: it mixes kinds of
    characters and repeats few of them.
    """
    t, k, digits = s["text"], s["kind"], _digits(s["text"])
    value = F.regexp_replace(t, r"(?i)^(?:password|passwd|pwd|secret|token|api[_-]?key)[\x20]?[=:][\x20]?", "")
    kinds_of = sum((F.regexp_like(value, F.lit(p)).cast("int") for p in ("[a-z]", "[A-Z]", "[0-9]", "[^A-Za-z0-9]")), F.lit(0))
    varied = F.size(F.array_distinct(F.split(value, ""))) >= F.least(F.lit(8), F.length(value) * 0.4)
    few = F.size(F.array_distinct(F.split(digits, "")))
    good = (
        ((k == "email") & F.regexp_like(t, F.lit(rf"(?i)[^A-Za-z](?:{TOP_DOMAINS})$")))
        | ((k == "secret") & (kinds_of >= 2) & varied)
        | ((k == "ssn") & F.regexp_like(t, F.lit("^(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}$")))
        | ((k == "iban") & checksum_97(t))
        | ((k == "phone") & F.regexp_like(digits, F.lit("^[2-9][0-9]{9}$")) & (few >= 3))
        | ((k == "number") & F.length(digits).between(13, 19) & luhn(digits) & (few >= 2))
    )
    return F.coalesce(good, F.lit(False)).cast("double")


def _nodes(node) -> float | tuple:
    """A fitted tree's nodes as plain values: a leaf's value, or feature, threshold and both sides."""
    if node.getClass().getSimpleName() == "LeafNode":
        return float(node.prediction())
    split = node.split()
    return int(split.featureIndex()), float(split.threshold()), _nodes(node.leftChild()), _nodes(node.rightChild())


def _tree(node: float | tuple, x: Column) -> Column:
    """A regression tree as a nested conditional over the feature array."""
    if isinstance(node, float):
        return F.lit(node)
    feature, threshold, left, right = node
    return F.when(x[feature] <= threshold, _tree(left, x)).otherwise(_tree(right, x))


def scan(docs: DataFrame) -> DataFrame:
    """``docs`` with ``_base`` and all candidates ``_cands`` with features and label, in one look at ``text``."""
    rows = docs.withColumn("_text", F.coalesce(F.col("text").cast("string"), F.lit("")))
    text = F.col("_text")
    described = F.transform(proposals(text), lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"), features(text, s).alias("f"), silver(s).alias("y")))
    return rows.withColumns({"_base": base_spans(text), "_cands": described}).drop("_text")


def fit(found: DataFrame, max_docs: int | None = None):
    """``margin(feature array)`` as a column function, and for each kind the threshold calibrated on all documents.

    Without both labels among the fitting rows every margin is zero, and kinds
    stand or fall as a whole.
    """
    each = found.select(F.col("doc_id").cast("long").alias("doc_id"), F.explode("_cands").alias("c")).select("doc_id", "c.kind", "c.f", "c.y")
    each = stored(each, "pii-candidates")
    x = each.select("f", "y")
    if max_docs is not None:
        ids = each.select("doc_id").filter(F.col("doc_id").isNotNull()).distinct()
        chosen = stored(ids.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_docs), "pii-ids")
        x = stored(each.join(F.broadcast(chosen), "doc_id").select("f", "y"), "pii-train")
    trees: list[tuple] = []
    if {r[0] for r in x.select("y").distinct().collect()} == {0.0, 1.0}:
        model = GBTClassifier(featuresCol="v", labelCol="y", maxIter=12, maxDepth=3, stepSize=0.3, seed=7).fit(x.select(array_to_vector("f").alias("v"), "y"))
        members = model.trees  # held while their nodes are read
        trees = [(float(w), _nodes(t._java_obj.rootNode())) for w, t in zip(model.treeWeights, members)]

    def margin(f: Column) -> Column:
        total = F.lit(0.0)
        for weight, tree in trees:
            total = total + F.lit(weight) * _tree(tree, f)
        return total

    # Rounded margins: a bounded table, from which each kind's least threshold of the wanted precision is read.
    bins = each.groupBy("kind", F.round(margin(F.col("f")), 2).alias("m")).agg(F.sum("y").alias("good"), F.count("*").alias("n")).orderBy("kind", F.desc("m")).collect()
    thresholds: dict[str, float] = {}
    sums: dict[str, tuple[float, int]] = {}
    for r in bins:
        good, total = sums.get(r["kind"], (0.0, 0))
        sums[r["kind"]] = good, total = good + r["good"], total + r["n"]
        if good / total >= PRECISION:
            thresholds[r["kind"]] = r["m"]
    return margin, thresholds


def find(docs: DataFrame, max_docs: int | None = None) -> DataFrame:
    """``docs`` without ``text``, with ``_base`` and ``_spans``: base spans, and these with the selected candidates."""
    rows = stored(scan(docs).drop("text"), "pii-scan")
    margin, thresholds = fit(rows, max_docs)
    least = F.create_map(*[x for k, m in thresholds.items() for x in (F.lit(k), F.lit(float(m)))]) if thresholds else F.expr("cast(map() as map<string, double>)")

    def chosen(s: Column) -> Column:
        # Compared as rounded, like the counts that the threshold comes from.
        return F.coalesce(F.round(F.transform(F.array(s["f"]), margin)[0], 2) >= F.try_element_at(least, s["kind"]), F.lit(False))

    rows = rows.withColumn("_more", F.filter("_cands", chosen)).drop("_cands")
    # By start, longest first, base before others: what lies inside an earlier span adds nothing.
    order = F.array_sort(F.concat(
        F.transform("_base", lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("back"), F.lit(0).alias("added"), s["kind"].alias("kind"))),
        F.transform("_more", lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("back"), F.lit(1).alias("added"), s["kind"].alias("kind"))),
    ))

    def kept(o: Column) -> Column:
        ends = running(F.transform(o, lambda d: -d["back"]), lambda a, b: F.greatest(a, b))
        return F.transform(F.array(ends), lambda e: F.filter(o, lambda d, i: (d["added"] == 0) | (i == 0) | (F.get(e, i - 1) < -d["back"])))[0]

    spans = F.transform(F.transform(F.array(order), kept)[0], lambda d: F.struct(d["kind"].alias("kind"), d["start"].alias("start"), (-d["back"]).alias("end")))
    return rows.withColumn("_spans", F.when(F.size("_more") == 0, F.transform("_base", lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))).otherwise(spans))


def _rank(kind: Column) -> Column:
    out = F.lit(len(KINDS))
    for i, k in enumerate(KINDS):
        out = F.when(kind == k, i).otherwise(out)
    return out


def listed(spans: Column) -> Column:
    """``kind:start:end``, base kinds as listed before others, then by start."""
    order = F.array_sort(F.transform(spans, lambda s: F.struct(_rank(s["kind"]).alias("rank"), s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"))))
    return F.array_join(F.transform(order, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def report(docs: DataFrame) -> DataFrame:
    """Counts and digests of the base spans, and all spans, for every document."""
    found = find(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
    n = lambda k: F.size(F.filter("_base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    return found.select("doc_id", *[n(k) for k in KINDS], F.sha2(listed(F.col("_base")), 256).alias("base_sha256"), listed(F.col("_spans")).alias("spans"))


def redact(docs: DataFrame) -> DataFrame:
    """The documents with every span replaced by its kind in brackets; ``n_chars``, where present, follows."""
    columns = docs.columns
    found = find(docs.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("_own"), "doc_id", "text"))
    order = F.array_sort(F.transform("_spans", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
    t = F.coalesce(F.col("_own.text").cast("string"), F.lit(""))

    def rebuilt(o: Column) -> Column:
        ends = running(F.transform(o, lambda d: d["end"]), lambda a, b: F.greatest(a, b))

        def joined(e: Column) -> Column:
            before = lambda i: F.when(i == 0, 0).otherwise(F.get(e, i - 1))
            part = lambda d, i: F.when(d["start"] >= before(i), F.concat(F.substring(t, before(i) + 1, d["start"] - before(i)), F.lit("["), F.upper(d["kind"]), F.lit("]"))).otherwise("")
            return F.concat(F.array_join(F.transform(o, part), ""), F.substring(t, F.element_at(e, -1) + 1, F.length(t)))

        return F.transform(F.array(ends), joined)[0]

    new = F.when(F.size("_spans") == 0, F.col("_own.text")).otherwise(F.transform(F.array(order), rebuilt)[0])
    out = found.withColumn("_new", new)
    value = {"text": F.col("_new").alias("text")}
    if "n_chars" in columns:
        value["n_chars"] = F.when(F.size("_spans") == 0, F.col("_own.n_chars")).otherwise(F.length("_new")).cast(docs.schema["n_chars"].dataType).alias("n_chars")
    return out.select(*[value.get(c, F.col("_own")[c].alias(c)) for c in columns])
