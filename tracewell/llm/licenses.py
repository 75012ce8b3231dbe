"""License scans by ordered signature rules (DataFrame functions only).

A rule is a regular expression over a text's lower-cased words, each preceded
by one space; it is tried only on texts that hold its keyword. Rules come from
``FAMILIES`` (names as people write them, with their versions) and ``FRAMES``
(the ways in which a text grants a license). Where detections overlap, inside
each other or in part, the longer one stays, or of two of equal length the one
with the higher priority. Everything is one projection; no row leaves its task.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell.llm.common import LOWER, UPPER, WORD_ANY_CASE, text_of

#: Phrases and the labels they give by themselves.
BASE = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}


@dataclass(frozen=True)
class Family:
    """A license: label, names (alternatives over words), keywords one of which any name holds, and versions."""

    label: str
    name: str
    keywords: tuple[str, ...]
    versions: tuple[str, ...] = ()


L = "licen[cs]e"
FAMILIES = (
    Family("gpl", f"(?:gnu general public {L}|gnu gpl|gpl)", ("gnu", "gpl"), ("1.0", "2.0", "3.0")),
    Family("lgpl", f"(?:gnu (?:lesser|library) general public {L}|gnu lgpl|lgpl)", ("gnu", "lgpl"), ("2.0", "2.1", "3.0")),
    Family("agpl", f"(?:gnu affero general public {L}|gnu agpl|agpl)", ("gnu", "agpl"), ("1.0", "3.0")),
    Family("gfdl", f"(?:gnu free documentation {L}|gfdl)", ("gnu", "gfdl"), ("1.1", "1.2", "1.3")),
    Family("apache", f"apache(?: software)?(?: {L})?", ("apache",), ("1.0", "1.1", "2.0")),
    Family("mit", f"(?:mit|expat|x11)(?: {L})?", ("mit", "expat", "x11")),
    Family("bsd-2-clause", f"(?:bsd 2 clause|2 clause bsd|simplified bsd|freebsd)(?: {L})?", ("bsd", "freebsd")),
    Family("bsd-3-clause", f"(?:bsd 3 clause|3 clause bsd|new bsd|modified bsd|revised bsd)(?: {L})?", ("bsd",)),
    Family("bsd-4-clause", f"(?:bsd 4 clause|4 clause bsd|original bsd)(?: {L})?", ("bsd",)),
    Family("bsd", f"bsd(?: style)? {L}", ("bsd",)),
    Family("0bsd", f"(?:0bsd|zero clause bsd)(?: {L})?", ("0bsd", "bsd")),
    Family("mpl", f"(?:mozilla public {L}|mpl)", ("mozilla", "mpl"), ("1.0", "1.1", "2.0")),
    Family("epl", f"(?:eclipse public {L}|epl)", ("eclipse", "epl"), ("1.0", "2.0")),
    Family("cddl", f"(?:common development and distribution {L}|cddl)", ("development", "cddl"), ("1.0", "1.1")),
    Family("cpl", f"common public {L}", ("common",), ("1.0",)),
    Family("eupl", f"(?:european union public {L}|eupl)", ("european", "eupl"), ("1.0", "1.1", "1.2")),
    Family("artistic", f"artistic {L}", ("artistic",), ("1.0", "2.0")),
    Family("afl", f"academic free {L}", ("academic",), ("2.1", "3.0")),
    Family("osl", f"open software {L}", ("open",), ("2.1", "3.0")),
    Family("bsl", f"boost software {L}", ("boost",), ("1.0",)),
    Family("isc", f"isc {L}", ("isc",)),
    Family("zlib", f"zlib(?: libpng)? {L}", ("zlib",)),
    Family("openssl", f"openssl {L}", ("openssl",)),
    Family("python", f"(?:python software foundation|psf) {L}", ("python", "psf"), ("2.0",)),
    Family("php", f"php {L}", ("php",), ("3.0", "3.01")),
    Family("ofl", f"(?:sil )?open font {L}", ("font",), ("1.0", "1.1")),
    Family("ncsa", f"(?:university of illinois )?ncsa (?:open source )?{L}", ("ncsa",)),
    Family("postgresql", f"postgresql {L}", ("postgresql",)),
    Family("unlicense", "unlicense", ("unlicense",)),
    Family("wtfpl", "wtfpl", ("wtfpl",)),
    Family("odbl", f"(?:open database {L}|odbl)", ("database", "odbl"), ("1.0",)),
    Family("cc0", "(?:cc0|creative commons zero|cc zero)", ("cc0", "zero"), ("1.0",)),
    Family("public-domain", "(?:in|into|to) the public domain", ("domain",)),
    *(
        Family("-".join(("cc", *parts)), f"(?:cc|creative commons) (?:{' '.join(parts)}|{' '.join(WORDS[p] for p in parts)})(?: {L})?", ("cc", "commons"), ("1.0", "2.0", "2.5", "3.0", "4.0"))
        for WORDS in [{"by": "attribution", "nc": "non ?commercial", "sa": "share ?alike", "nd": "no ?deriv(?:ative)?s?"}]
        for parts in (("by",), ("by", "sa"), ("by", "nc"), ("by", "nd"), ("by", "nc", "sa"), ("by", "nc", "nd"))
    ),
)

#: Name of a frame, its words around {x}, the priority it gives, and how sure it makes us.
FRAMES = (
    ("spdx", "spdx licen[cs]e identifier {x}", 4, 1.0),
    ("notice", "(?:this (?:work|file|program|project|software|package|document|text) is )?(?:licen[cs]ed|released|distributed|available|provided|published|redistributed) under (?:the )?(?:terms of (?:the )?)?{x}", 3, 0.95),
    ("header", "licen[cs]e(?: is)? (?:the )?{x}", 2, 0.85),
    ("name", "{x}", 1, 0.6),
)


@dataclass(frozen=True)
class Rule:
    label: str
    keyword: str
    regex: str
    priority: int
    sure: float


def rules() -> list[Rule]:
    """All signatures, those of a version before those without one."""
    out = []
    for f in FAMILIES:
        for version in (*f.versions, ""):
            if version:
                major, minor = version.split(".")
                number = f" v?{major}" + (f"(?: {minor})?" if minor == "0" else f" {minor}")
                name = f"{f.name}(?: version| v)?{number}(?: or (?:any )?later(?: version)?)?"
                label = f"{f.label}-{version}"
            else:
                name, label = f.name, f.label
            for frame, around, priority, sure in FRAMES:
                if frame == "name" and not version and name.endswith(")?") and f.label in ("mit", "apache"):
                    name = name.removesuffix("?")  # these names mean a license only with the word
                body = around.replace("{x}", name)
                out += [Rule(label, k, f" {body}(?= )", 2 * priority + bool(version), sure) for k in f.keywords]
    return out


def _literal(rows: list[Rule]) -> Column:
    return F.array(*(F.struct(F.lit(r.label).alias("label"), F.lit(r.keyword).alias("keyword"), F.lit(r.regex).alias("regex"), F.lit(r.priority).alias("priority"), F.lit(r.sure).alias("sure")) for r in rows))


def _found(words: str, rule: Column) -> Column:
    """Places of a rule in ``words``, as an array of (label, first, after, priority, sure).

    A marker put before each match shows where it starts once words are split.
    """
    marked = F.split(F.regexp_replace(F.col(words), rule["regex"], F.lit(" \x01$0")), " ")
    starts = F.filter(F.transform(marked, lambda w, i: F.when(w == "\x01", i - 1)), lambda i: i.isNotNull())
    starts = F.transform(starts, lambda i, k: i - k)
    sizes = F.transform(F.regexp_extract_all(F.col(words), rule["regex"], F.lit(0)), lambda m: F.length(m) - F.length(F.replace(m, F.lit(" "), F.lit(""))))
    return F.zip_with(starts, sizes, lambda a, n: F.struct(rule["label"].alias("label"), a.alias("first"), (a + n).alias("after"), rule["priority"].alias("priority"), rule["sure"].alias("sure")))


def _resolved(found: str) -> Column:
    """``found`` without what overlaps something better: longer, or as long and of higher priority.

    The best detection stays and hides all that share a word with it, then the
    best of what is left, and so on; of equally good ones the surer, then the
    earlier, then the label that sorts first.
    """
    # sorted from the best on: array_sort takes structs field by field
    ranked = F.array_sort(F.transform(F.array_distinct(F.col(found)), lambda d: F.struct((d["first"] - d["after"]).alias("size"), (-d["priority"]).alias("rank"), (-d["sure"]).alias("doubt"), d["first"].alias("first"), d["label"].alias("label"), d.alias("d"))))

    def add(kept: Column, x: Column) -> Column:
        apart = ~F.exists(kept, lambda k: (k["first"] < x["d"]["after"]) & (x["d"]["first"] < k["after"]))
        return F.when(apart, F.concat(kept, F.array(x["d"]))).otherwise(kept)

    return F.aggregate(ranked, F.slice(F.col(found), 1, 0), add)


def scan(docs: DataFrame) -> DataFrame:
    """One row per document: word count, places of the base phrases, labels, score and the detections.

    Places count words from 0. score is the surest remaining detection's, 0.7
    for a base phrase alone and 0 without any. Ties between detections are
    settled as ``_resolved`` says. Null and empty texts have no words and no
    labels; repeated rows are scanned each; an empty table gives no rows; only
    doc_id and text are read.
    """
    table = rules()
    keywords = sorted({r.keyword for r in table} | {p.split()[0] for p in BASE})
    df = docs.select("doc_id", text_of().alias("_text"))
    df = df.withColumn("_lower", F.lower("_text"))
    df = df.withColumn("_may", reduce(or_, (F.contains("_lower", F.lit(k)) for k in ("licen", "cc", *sorted({k for k in keywords if "cc" not in k and k != "unlicense"})))))
    words = F.array_remove(F.split(F.translate("_text", UPPER, LOWER), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"), "")
    df = df.withColumn("_n", F.regexp_count("_text", F.lit(WORD_ANY_CASE)).cast("long"))
    df = df.withColumn("_words", F.when(F.col("_may"), words))
    df = df.withColumn("_keys", F.array_intersect("_words", F.array(*map(F.lit, keywords))))
    df = df.withColumn("_line", F.when(F.size("_keys") > 0, F.concat(F.lit(" "), F.array_join("_words", " "), F.lit(" "))))
    base = _literal([Rule(label, phrase.split()[0], f" {phrase}(?= )", 0, 0.7) for phrase, label in BASE.items()])
    empty = F.array().cast("array<struct<label:string,first:int,after:int,priority:int,sure:double>>")

    def all_of(table: Column) -> Column:
        fit = F.filter(table, lambda r: F.array_contains("_keys", r["keyword"]) & F.regexp_like("_line", r["regex"]))
        return F.when(F.col("_line").isNull(), empty).otherwise(F.flatten(F.transform(fit, lambda r: _found("_line", r))))

    df = df.withColumn("_base", all_of(base)).withColumn("_all", all_of(_literal(table)))
    df = df.withColumn("_kept", _resolved("_all"))
    names = lambda c: F.transform(F.col(c), lambda d: d["label"])
    starts = F.transform("_base", lambda d: d["first"])
    return df.select(
        "doc_id",
        F.col("_n").alias("n_words"),
        F.size("_base").cast("long").alias("n_base"),
        F.array_min(starts).cast("long").alias("first_word"),
        F.array_max(starts).cast("long").alias("last_word"),
        F.array_join(F.array_sort(F.array_distinct(names("_base"))), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_distinct(F.concat(names("_base"), names("_kept")))), ",").alias("labels"),
        F.coalesce(F.array_max(F.transform(F.concat("_base", "_kept"), lambda d: d["sure"])), F.lit(0.0)).alias("score"),
        F.transform("_kept", lambda d: F.struct(d["label"].alias("label"), d["first"].alias("first"), d["after"].alias("after"))).alias("detections"),
    )
