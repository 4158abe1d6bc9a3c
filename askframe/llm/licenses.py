"""License detection by ordered signature rules, with built-in functions only.

A null text is an empty one and has no words.  Repeated rows are scanned once each.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from askframe.llm.common import ascii_lower
from askframe.llm.spans import matches, running

# The base phrases and their labels.
BASE = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}

# Families with keywords, a name pattern over plain words and the versions they come in.
# One of the keywords stands in every string that the pattern can match.
FAMILIES = {
    "gpl": (("general public licen", "gpl"), "(?:gnu )?(?:general public licen[sc]e|gpl)", ["1 0", "2 0", "3 0", "2", "3"]),
    "lgpl": (("lesser general public", "library general public", "lgpl"), "(?:gnu )?(?:lesser|library) general public licen[sc]e|lgpl", ["2 0", "2 1", "3 0", "3"]),
    "agpl": (("affero",), "(?:gnu )?affero general public licen[sc]e", ["1 0", "3 0", "3"]),
    "apache": (("apache",), "apache(?: software)? licen[sc]e", ["1 0", "1 1", "2 0"]),
    "mpl": (("mozilla",), "mozilla public licen[sc]e", ["1 0", "1 1", "2 0"]),
    "epl": (("eclipse",), "eclipse public licen[sc]e", ["1 0", "2 0"]),
    "eupl": (("european",), "european union public licen[sc]e", ["1 0", "1 1", "1 2"]),
    "cddl": (("common development",), "common development and distribution licen[sc]e", ["1 0", "1 1"]),
    "cpl": (("common public",), "common public licen[sc]e", ["1 0"]),
    "afl": (("academic",), "academic free licen[sc]e", ["2 0", "2 1", "3 0"]),
    "osl": (("open software",), "open software licen[sc]e", ["1 0", "2 0", "2 1", "3 0"]),
    "artistic": (("artistic",), "(?:perl )?artistic licen[sc]e", ["1 0", "2 0"]),
    "bsl": (("boost",), "boost software licen[sc]e", ["1 0"]),
    "psf": (("python",), "python(?: software foundation)? licen[sc]e", ["2 0"]),
    "zpl": (("zope",), "zope public licen[sc]e", ["2 0", "2 1"]),
    "ofl": (("open font",), "(?:sil )?open font licen[sc]e", ["1 0", "1 1"]),
    "mit": (("mit licen", "expat", "x11"), "(?:mit|expat|x11) licen[sc]e", [""]),
    "isc": (("isc",), "isc licen[sc]e", [""]),
    "zlib": (("zlib",), "zlib(?: libpng)? licen[sc]e", [""]),
    "unlicense": (("unlicense",), "(?:the )?unlicense", [""]),
    "wtfpl": (("wtfpl",), "wtfpl", ["2 0"]),
    "bsd-2-clause": (("bsd",), "(?:bsd 2 clause|2 clause bsd|simplified bsd|freebsd) licen[sc]e", [""]),
    "bsd-3-clause": (("bsd",), "(?:bsd 3 clause|3 clause bsd|modified bsd|new bsd) licen[sc]e", [""]),
    "bsd": (("bsd",), "bsd(?: style)? licen[sc]e", [""]),
    "cc-by": (("cc by", "creative commons"), "(?:cc by|creative commons attribution)", ["1 0", "2 0", "2 5", "3 0", "4 0"]),
    "cc-by-sa": (("cc by", "creative commons"), "(?:cc by sa|creative commons attribution share ?alike)", ["1 0", "2 0", "2 5", "3 0", "4 0"]),
    "cc-by-nc": (("cc by", "creative commons"), "(?:cc by nc|creative commons attribution non ?commercial)", ["1 0", "2 0", "2 5", "3 0", "4 0"]),
    "cc-by-nd": (("cc by", "creative commons"), "(?:cc by nd|creative commons attribution no ?deriv(?:ative)?s?)", ["1 0", "2 0", "2 5", "3 0", "4 0"]),
    "cc-by-nc-sa": (("cc by", "creative commons"), "(?:cc by nc sa|creative commons attribution non ?commercial share ?alike)", ["1 0", "2 0", "2 5", "3 0", "4 0"]),
    "cc-by-nc-nd": (("cc by", "creative commons"), "(?:cc by nc nd|creative commons attribution non ?commercial no ?deriv(?:ative)?s?)", ["1 0", "2 0", "2 5", "3 0", "4 0"]),
    "cc0": (("cc0",), "cc0", ["1 0"]),
}
GRANT = "(?:licensed|released|distributed|available|provided|published) under (?:the )?(?:terms of (?:the )?)?"
# Notices without a family.
NOTICES = {
    "all-rights-reserved": (("reserved",), "all rights reserved"),
    "copyright": (("copyright",), "copyright (?:c )?[0-9]{4}"),
    "public-domain": (("domain",), "(?:in|into|to) the public domain"),
    "proprietary": (("proprietary",), "proprietary and confidential"),
    "no-warranty": (("warrant",), "without (?:any )?warranty|without warranties or conditions"),
    "as-is": (("provided",), "(?:is )?provided as is"),
    "permission-notice": (("permission",), "permission is hereby granted free of charge"),
    "redistribution-notice": (("redistribution",), "redistribution and use in source and binary forms"),
    "spdx-tag": (("spdx",), "spdx licen[sc]e identifier"),
}
# Words of which one stands in every text with a detection.
GATES = ["license", "licence", "unlicense", "wtfpl", "gpl", "cc by", "cc0", "creative commons", "reserved", "copyright", "public domain", "proprietary", "warrant", "provided as is", "permission is", "redistribution and", "spdx"]


def rules() -> list[tuple[int, str, tuple[str, ...], str, float]]:
    """``(priority, label, keywords, pattern, confidence)`` in order; a grant or version outranks a bare name.

    Per family and version: grant with version, name with version, version in
    words; per family: grant, name.  Notices come last.
    """
    out = []
    for label, (keys, name, versions) in FAMILIES.items():
        named = f"(?:{name})"
        for v in versions:
            if v:
                tag = f"{label}-{v.replace(' ', '.')}"
                number = f"(?: v| version)? ?{v}"
                out += [(0, tag, keys, f"{GRANT}{named}{number}", 1.0), (1, tag, keys, f"{named}{number}", 0.9), (1, tag, keys, f"version {v} of the {named}", 0.9), (1, tag, keys, f"{named}{number} (?:or(?: any)? later|only)", 0.95)]
        out += [(2, label, keys, f"{GRANT}{named}", 0.9), (3, label, keys, named, 0.8)]
    out += [(4, label, keys, pattern, 0.4) for label, (keys, pattern) in NOTICES.items()]
    return out


def normal(text: Column) -> Column:
    """Words joined and enclosed by single spaces."""
    plain = F.regexp_replace(ascii_lower(F.coalesce(text.cast("string"), F.lit(""))), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]++", " ")
    return F.concat(F.lit(" "), F.trim(plain), F.lit(" "))


def _spaces(text: Column) -> Column:
    return F.length(text) - F.length(F.translate(text, " ", ""))


def _suppress(found: Column) -> Column:
    """Drop detections inside another of at least their priority.

    Sorted by start, then longest, then priority, a detection is inside an
    earlier one if that ends at or after its end; a scan keeps the furthest end
    seen for each priority.
    """
    order = F.array_sort(F.transform(found, lambda d: F.struct(d["start"].alias("start"), (-d["end"]).alias("back"), d["priority"].alias("priority"), d["label"].alias("label"), d["confidence"].alias("confidence"))))

    def outer(ds: Column) -> Column:
        level = lambda p: F.transform(ds, lambda d: F.when(d["priority"] <= p, -d["back"]).otherwise(-1))
        ends = F.array(*[running(level(p), lambda a, b: F.greatest(a, b)) for p in range(5)])
        return F.transform(F.array(ends), lambda e: F.filter(ds, lambda d, i: (i == 0) | ~(F.get(F.get(e, d["priority"]), i - 1) >= -d["back"])))[0]

    return F.transform(F.array(order), outer)[0]


def detect(words: Column) -> Column:
    """Surviving detections in normal text, as an array of structs."""
    groups: dict[tuple[str, ...], list] = {}
    for priority, label, keys, pattern, confidence in rules():
        groups.setdefault(keys, []).append(F.struct(F.lit(priority).alias("priority"), F.lit(label).alias("label"), F.lit(f"(?<= )(?:{pattern})(?= )").alias("pattern"), F.lit(confidence).alias("confidence")))
    table = F.array(*[F.struct(F.array(*[F.lit(k) for k in keys]).alias("keys"), F.array(*v).alias("rules")) for keys, v in groups.items()])
    ready = F.flatten(F.transform(F.filter(table, lambda g: F.exists(g["keys"], lambda k: words.contains(k))), lambda g: g["rules"]))
    hit = F.filter(ready, lambda r: F.regexp_like(words, r["pattern"]))
    found = F.flatten(F.transform(hit, lambda r: F.transform(matches(words, r["pattern"]), lambda m: F.struct(m["start"].alias("start"), m["end"].alias("end"), r["priority"].alias("priority"), r["label"].alias("label"), r["confidence"].alias("confidence")))))
    return _suppress(found)


def scan(docs: DataFrame) -> DataFrame:
    """Words, base phrases and the labels of surviving signatures for every document."""
    words = docs.select(F.col("doc_id").cast("long").alias("doc_id"), normal(F.col("text")).alias("t"))
    words = words.withColumn("n_words", F.when(F.trim("t") == "", 0).otherwise(_spaces(F.col("t")) - 1).cast("long"))
    t = F.col("t")
    # Base phrases: the words before a place are the spaces before it.
    places = []
    for phrase, label in BASE.items():
        parts = F.split(t, f" {phrase}(?= )")
        first, after = _spaces(F.get(parts, F.lit(0))), _spaces(F.element_at(parts, -1))
        inside = phrase.count(" ") + 1
        entry = F.struct(F.lit(label).alias("label"), (F.size(parts) - 1).cast("long").alias("n"), first.cast("long").alias("first"), (F.col("n_words") - (after - 1) - inside).cast("long").alias("last"))
        places.append(F.when(t.contains(f" {phrase} "), entry))
    base = F.filter(F.array(*places), lambda p: p.isNotNull())
    gated = F.greatest(*[t.contains(g) for g in GATES])
    empty = F.filter(detect(F.lit("  ")), lambda d: F.lit(False))
    found = words.withColumn("base", base).withColumn("found", F.when(gated, detect(t)).otherwise(empty))
    labels = F.transform(F.col("base"), lambda b: b["label"])
    join = lambda a: F.array_join(F.array_sort(F.array_distinct(a)), ",")
    best = F.coalesce(F.array_max(F.transform(F.col("found"), lambda d: d["confidence"])), F.lit(0.0))
    return found.select(
        "doc_id",
        "n_words",
        F.aggregate("base", F.lit(0).cast("long"), lambda a, b: a + b["n"]).alias("n_base"),
        F.array_min(F.transform("base", lambda b: b["first"])).alias("first_word"),
        F.array_max(F.transform("base", lambda b: b["last"])).alias("last_word"),
        join(labels).alias("base_labels"),
        join(F.concat(labels, F.transform("found", lambda d: d["label"]))).alias("labels"),
        F.greatest(best, F.when(F.size("base") > 0, 0.8).otherwise(0.0)).alias("score"),
    )
