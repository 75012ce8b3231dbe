"""Personal data by fixed patterns and bootstrapped contexts (DataFrame functions only).

The base finds e-mail addresses, IP addresses, card and phone numbers by their
form. They and strings in the form of secret keys are the seeds; identifier-like
strings are the instances. Patterns are what stands left of an instance (the
last word and the signs after it), what stands right of it (likewise), and its
shape. ``scored`` counts the edges between patterns and instances over all
documents and passes scores between the two sides for some rounds:

* a context is as good as the share of all its places in the corpus that lead
  to good instances, and counts once it has ``min_seeds`` different good ones;
* a shape is as good as the share of its instances that stand in good contexts;
* an instance is as good as its best pattern of ``min_score`` or more.

Instances found in one round are the seeds from which the next one induces new
patterns. ``find`` adds, to the base, the identifier-like strings behind the
patterns that are good in the end. A seed in the form of a key is reported only
where such a pattern leads to it.

The model are all patterns that score high, whatever their number: up to
``LISTED`` of them become part of the plan, more are joined. Instances appear in
the graph as hashes only. Both passes over the text are projections; what is
shuffled are counts by pattern and instance, added up before they move.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell.llm.common import LOWER, SPACE, UPPER, stored, text_of

KINDS = ("email", "ip", "card", "phone")
#: The forms of the base. A card's is written as a whole run of digits with the number of digits it must have.
FORMS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)",
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){12,18}(?![\x20-]?[0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text must hold for a form to be worth trying.
NEEDS = {"email": "@", "phone": "+"}
#: Identifier-like strings: 6 characters at least, with a digit; signs before the first letter or digit stand apart.
IDENTIFIER = r"(?<![A-Za-z0-9_./+-])([_./+-]*+)((?=[A-Za-z_./+-]*+[0-9])[A-Za-z0-9][A-Za-z0-9_./+-]{4,}[A-Za-z0-9])"
LEAST_DIGITS = 2
#: Seeds in the form of keys: long hexadecimal strings, and prefixes that issuers put before theirs.
KEYS = r"^(?:(?=[0-9a-f]*[a-f])(?=[a-f]*[0-9])[0-9a-f]{32,}|(?=[0-9A-F]*[A-F])(?=[A-F]*[0-9])[0-9A-F]{32,}|AKIA[0-9A-Z]{16}|gh[opsu]_[A-Za-z0-9]{36,}|sk-[A-Za-z0-9]{20,}|xox[abp]-[A-Za-z0-9-]{10,}|eyJ[A-Za-z0-9_.-]{20,})$"
MARK, NO_MARK = "\x01", "\x02"
#: Stands for the beginning or the end of a text; runs of letters and digits; how much of a context counts.
EDGE = "\x03"
RUN = r"[\x03a-z0-9\x{80}-\x{10FFFF}]+"
NO_RUN = r"[^\x03a-z0-9\x{80}-\x{10FFFF}]*"
WIDTH = 60
SPAN = "struct<kind:string,start:int,end:int>"
#: Up to so many patterns are looked up in a list, more in a table.
LISTED = 1000
#: Up to so many contexts (8 bytes each) are sent to all tasks that count their places; more are counted with all others.
KEPT = 500_000


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    def part(c: Column, i: Column) -> Column:
        d = c.cast("int")
        return F.when(i % 2 == 0, d).when(d > 4, 2 * d - 9).otherwise(2 * d)

    return F.aggregate(F.transform(F.split(F.reverse(digits), ""), part), F.lit(0), lambda a, d: a + d) % 10 == 0


def _valid(kind: str, x: Column) -> Column:
    if kind == "ip":
        return F.forall(F.split(x, r"\."), lambda p: F.regexp_like(p, F.lit("^0*[0-9]{1,3}$")) & (F.substring(p, -3, 3).cast("int") <= 255))
    if kind == "card":
        return _luhn(_digits(x))
    if kind == "phone":
        return F.length(_digits(x)).between(9, 15)
    return F.lit(True)


def _starts(text: str, form: str, to: str) -> Column:
    """Starts of the matches of ``form`` in code points: a mark is put there (``to``) and the text split into characters."""
    marked = F.split(F.regexp_replace(F.col(text), form, to), "")
    starts = F.filter(F.transform(marked, lambda c, i: F.when(c == MARK, i)), lambda i: i.isNotNull())
    return F.transform(starts, lambda i, k: i - k)


def _matches(text: str, form: str, to: str = f"{MARK}$0", group: int = 0) -> Column:
    """(start, value) of each match of ``form``, in code points; ``text`` holds no MARK."""
    return F.zip_with(_starts(text, form, to), F.regexp_extract_all(F.col(text), F.lit(form), F.lit(group)), lambda s, v: F.struct(s.alias("start"), v.alias("value")))


def _spans(text: str, kind: str) -> Column:
    """Spans of a kind of the base."""
    form, need = FORMS[kind], NEEDS.get(kind)
    there = F.regexp_like(F.col(text), F.lit(form))
    if need:
        there = F.contains(F.col(text), F.lit(need)) & there
    found = F.filter(_matches(text, form), lambda m: _valid(kind, m["value"]))
    found = F.transform(found, lambda m: F.struct(F.lit(kind).alias("kind"), m["start"].alias("start"), (m["start"] + F.length(m["value"])).alias("end"), m["value"].alias("value")))
    return F.when(there, found).otherwise(F.array().cast("array<struct<kind:string,start:int,end:int,value:string>>"))


def _plain(text: Column) -> Column:
    """Lower-cased, with 0 for each number and one space for each gap, and the text's edges named."""
    low = F.translate(F.concat(F.lit(f"{EDGE} "), text, F.lit(f" {EDGE}")), UPPER, LOWER)
    return F.regexp_replace(F.regexp_replace(low, "[0-9]+", "0"), SPACE, " ")


def _pieces(plain: Column, left: bool) -> Column:
    """Each run of letters and digits with the signs after it, or before it: the contexts that ``plain`` holds."""
    return F.regexp_extract_all(plain, F.lit(RUN + NO_RUN if left else NO_RUN + RUN), F.lit(0))


def _named(pieces: Column, left: bool) -> Column:
    """Contexts as patterns; of a long one the end that is nearer counts."""
    if left:
        return F.transform(pieces, lambda p: F.concat(F.lit("left "), F.trim(F.right(p, F.lit(WIDTH)))))
    return F.transform(pieces, lambda p: F.concat(F.lit("right "), F.trim(F.left(p, F.lit(WIDTH)))))


def _contexts(text: str, form: str, to: str = f"{MARK}$0") -> tuple[Column, Column]:
    """The contexts left and right of each match of ``form``, in their order.

    A match has a letter or digit, so that no two marks share a piece.
    """
    before, after = (_plain(F.regexp_replace(F.col(text), form, x)) for x in (to, f"$0{MARK}"))
    left = F.filter(_pieces(before, True), lambda p: F.contains(p, F.lit(MARK)))
    right = F.filter(_pieces(after, False), lambda p: F.contains(p, F.lit(MARK)))
    return _named(F.transform(left, lambda p: F.substring_index(p, MARK, 1)), True), _named(F.transform(right, lambda p: F.substring_index(p, MARK, -1)), False)


def _shape(value: Column) -> Column:
    """What kinds of signs a string has: where it is long, their kinds and number; where not, one by one."""
    hexadecimal = F.regexp_like(value, F.lit("^(?:[0-9a-f]+|[0-9A-F]+)$")) & F.regexp_like(value, F.lit("[A-Fa-f]"))
    each = F.translate(value, UPPER + LOWER + "0123456789", "A" * 26 + "a" * 26 + "0" * 10)
    size = F.length(value).cast("string")
    kinds = F.array_join(F.array_sort(F.array_distinct(F.split(each, ""))), "")
    return F.concat(F.lit("shape "), F.when(hexadecimal, F.concat(F.lit("x*"), size)).when(F.length(value) > 24, F.concat(kinds, F.lit("*"), size)).otherwise(each))


def base(docs: DataFrame) -> DataFrame:
    """``docs`` with _text (no nulls, no marks) and _base, its spans of the base by kind, then start."""
    df = docs.withColumn("_text", F.translate(text_of(), MARK, NO_MARK))
    for kind in KINDS:
        df = df.withColumn(f"_{kind}", _spans("_text", kind))
    return df.withColumn("_base", F.concat(*(f"_{k}" for k in KINDS)))


MORE = "struct<kind:string,start:int,end:int,value:string,patterns:array<string>>"


def identifiers(df: DataFrame) -> DataFrame:
    """``df`` (from ``base``) with _more: identifier-like strings apart from the base's spans, with their patterns."""
    to = f"$1{MARK}$2"
    there = F.regexp_like(F.col("_text"), F.lit("[0-9]")) & F.regexp_like(F.col("_text"), F.lit(IDENTIFIER))
    left, right = _contexts("_text", IDENTIFIER, to)
    around = F.zip_with(left, right, lambda a, b: F.array(a, b))
    seen = F.zip_with(_matches("_text", IDENTIFIER, to, 2), around, lambda m, c: F.struct(m["start"].alias("start"), m["value"].alias("value"), c.alias("around")))

    def apart(m: Column) -> Column:
        return ~F.exists("_base", lambda b: (b["start"] < m["start"] + F.length(m["value"])) & (m["start"] < b["end"]))

    seen = F.filter(seen, lambda m: (F.length(_digits(m["value"])) >= LEAST_DIGITS) & apart(m))
    more = F.transform(seen, lambda m: F.struct(F.lit("id").alias("kind"), m["start"].alias("start"), (m["start"] + F.length(m["value"])).alias("end"), m["value"].alias("value"), F.concat(m["around"], F.array(_shape(m["value"]))).alias("patterns")))
    return df.withColumn("_more", F.when(there, more).otherwise(F.array().cast(f"array<{MORE}>")))


def _seeds(kind: str) -> Column:
    """(patterns, value) of each span of a kind of the base."""
    form = FORMS[kind]
    left, right = _contexts("_text", form)
    values = F.regexp_extract_all(F.col("_text"), F.lit(form), F.lit(0))
    each = F.zip_with(values, F.zip_with(left, right, lambda a, b: F.array(a, b)), lambda v, p: F.struct(p.alias("patterns"), v.alias("value")))
    return F.when(F.size(f"_{kind}") > 0, F.filter(each, lambda x: _valid(kind, x["value"])))


def _places(docs: DataFrame, keys: DataFrame) -> DataFrame:
    """(key, places): how often each context, by its hash, occurs in the corpus, whatever it leads to."""
    plain = _plain(F.translate(text_of(), MARK, NO_MARK))
    contexts = F.concat(_named(_pieces(plain, True), True), _named(_pieces(plain, False), False))
    met = docs.select(F.explode(F.transform(contexts, lambda c: F.xxhash64(c))).alias("key"))
    if keys.limit(KEPT + 1).count() <= KEPT:  # few enough to look each place up before it is counted
        met = met.join(F.broadcast(keys), "key", "left_semi")
    return met.groupBy("key").agg(F.count(F.lit(1)).alias("places"))


def scored(docs: DataFrame, rounds: int = 3, min_seeds: int = 3, min_score: float = 0.5) -> DataFrame:
    """(pattern, score) of the patterns that score ``min_score`` or more after ``rounds`` rounds; see the top of this file.

    Columns other than text are not read; null texts hold nothing. Repeated rows
    count as often as they occur, but only different instances are seeds.
    """
    df = identifiers(base(docs.select("text")))
    none = F.array().cast("array<struct<patterns:array<string>,value:string>>")
    base_seeds = F.transform(F.concat(*(F.coalesce(_seeds(k), none) for k in KINDS)), lambda x: F.struct(x["patterns"].alias("patterns"), x["value"].alias("value"), F.lit(1).alias("seed")))
    others = F.transform("_more", lambda m: F.struct(m["patterns"].alias("patterns"), m["value"].alias("value"), F.regexp_like(m["value"], F.lit(KEYS)).cast("int").alias("seed")))
    rows = df.select(F.explode(F.concat(base_seeds, others)).alias("e")).select(F.explode("e.patterns").alias("pattern"), F.xxhash64("e.value").alias("instance"), "e.seed")
    edges = rows.groupBy("pattern", "instance").agg(F.count(F.lit(1)).alias("n"), F.max("seed").alias("seed"))
    edges = stored(edges.withColumn("is_shape", F.startswith("pattern", F.lit("shape "))), "pii-edges")
    totals = edges.groupBy("pattern", "is_shape").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("instances")).where(F.col("instances") >= min_seeds)
    totals = stored(totals.withColumn("key", F.xxhash64("pattern")), "pii-patterns")
    totals = totals.join(_places(docs, totals.where(~F.col("is_shape")).select("key")), "key", "left")
    reach = F.when(F.col("is_shape"), F.col("n")).otherwise(F.greatest("n", F.coalesce("places", "n")))
    totals = stored(totals.select("pattern", "is_shape", reach.alias("reach")), "pii-patterns")
    edges = stored(edges.join(totals, ["pattern", "is_shape"]), "pii-edges")
    if not edges.limit(1).count():
        return totals.select("pattern", F.lit(0.0).alias("score")).limit(0)

    def score(good: DataFrame, use: str, shapes: bool) -> DataFrame:
        led = edges.where(F.col("is_shape") if shapes else ~F.col("is_shape")).join(good.select("instance", F.col(use).alias("good")), "instance")
        led = led.groupBy("pattern").agg(F.sum(F.col("n") * F.col("good")).alias("led"), F.max("reach").alias("reach"), F.count(F.when(F.col("good") >= min_score, 1)).alias("seeds"))
        return led.where((F.col("seeds") >= min_seeds) & (F.col("led") >= min_score * F.col("reach"))).select("pattern", (F.col("led") / F.col("reach")).alias("score"))

    good, before = edges.groupBy("instance").agg(F.max("seed").cast("double").alias("good")), None
    for _ in range(rounds):
        contexts = stored(score(good, "good", False), "pii-patterns")
        led = edges.join(contexts, "pattern", "left").groupBy("instance").agg(F.max("seed").cast("double").alias("seed"), F.coalesce(F.max("score"), F.lit(0.0)).alias("led"))
        led = stored(led, "pii-instances")
        shapes = stored(score(led, "led", True), "pii-patterns")
        now = contexts.union(shapes).agg(F.count(F.lit(1)), F.sum(F.round("score", 9))).first()
        if now == before:  # nothing more is found
            break
        before = now
        through = edges.join(shapes, "pattern").groupBy("instance").agg(F.max("score").alias("by_shape"))
        good = led.join(through, "instance", "left").select("instance", F.greatest("seed", "led", F.coalesce("by_shape", F.lit(0.0))).alias("good"))
    return contexts.union(shapes)


def learn(docs: DataFrame, rounds: int = 3, min_seeds: int = 3, min_score: float = 0.5) -> list[str]:
    """Patterns that lead to personal data, the best first."""
    return [r["pattern"] for r in scored(docs, rounds, min_seeds, min_score).orderBy(F.desc("score"), "pattern").collect()]


def find(docs: DataFrame, patterns: list[str] | DataFrame) -> DataFrame:
    """``docs`` with _base and _found, the identifier-like strings behind ``patterns`` (a list, or a table with pattern)."""
    df = base(docs)
    if isinstance(patterns, DataFrame):
        names = [r["pattern"] for r in patterns.select("pattern").limit(LISTED + 1).collect()]
        if len(names) > LISTED:
            # the patterns that count, looked up for each distinct text
            df = identifiers(df).withColumn("_key", F.sha2(F.col("_text").cast("binary"), 256))
            met = df.select("_key", F.explode(F.array_distinct(F.flatten(F.transform("_more", lambda m: m["patterns"])))).alias("pattern")).distinct()
            met = met.join(patterns.select("pattern"), "pattern").groupBy("_key").agg(F.collect_set("pattern").alias("_led"))
            df = df.join(met, "_key", "left").withColumn("_led", F.coalesce("_led", F.array().cast("array<string>")))
            return df.withColumn("_found", F.filter("_more", lambda m: F.arrays_overlap(F.col("_led"), m["patterns"]))).drop("_key", "_led")
        patterns = names
    if not patterns:
        return df.withColumn("_found", F.array().cast(f"array<{MORE}>"))
    return identifiers(df).withColumn("_found", F.filter("_more", lambda m: F.exists(m["patterns"], lambda p: p.isin(patterns))))


def _written(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def report(docs: DataFrame) -> DataFrame:
    """Counts and spans of every document; null texts have none, repeated rows are read each, doc_id may be null.

    Texts may hold any characters; a start of heading (U+0001) counts as one
    character like any other. Only doc_id and text are read.
    """
    df = find(docs.select("doc_id", "text"), scored(docs))
    counts = [F.size(f"_{k}").cast("long").alias(f"n_{k}") for k in KINDS]
    bare = lambda c: F.transform(F.col(c), lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
    return df.select(
        "doc_id",
        *counts,
        F.sha2(_written(F.col("_base")).cast("binary"), 256).alias("base_sha256"),
        _written(F.concat(bare("_base"), bare("_found"))).alias("spans"),
        F.size("_found").cast("long").alias("n_found"),
    )


def redact(docs: DataFrame, patterns: list[str] | None = None) -> DataFrame:
    """``docs``, in the columns they came in, with each span replaced by its kind in brackets.

    Spans that overlap are replaced as one, by the kind that starts first; of two
    that start together the shorter one names it. Texts without spans stay as
    they are, nulls too; n_chars, where there is one, follows the text. Every
    row stays, repeated ones too; an empty table stays empty. Other columns,
    whatever they are called, are carried along as they are.
    """
    columns = docs.columns
    docs = docs.select("text", F.struct(*(F.col(f"`{c}`") for c in columns)).alias("_row"))
    df = find(docs, scored(docs) if patterns is None else patterns)
    bare = lambda c: F.transform(F.col(c), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind")))
    df = df.withColumn("_spans", F.array_sort(F.concat(bare("_base"), bare("_found"))))
    # a span that starts inside an earlier one is not written, only its end counts
    step = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def write(acc: Column, s: Column) -> Column:
        gap = F.substring(F.col("text"), acc["at"] + 1, s["start"] - acc["at"])
        new = F.when(s["start"] >= acc["at"], F.concat(acc["out"], gap, F.lit("["), F.upper(s["kind"]), F.lit("]"))).otherwise(acc["out"])
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), new.alias("out"))

    done = F.aggregate("_spans", step, write, lambda acc: F.concat(acc["out"], F.substring(F.col("text"), acc["at"] + 1, F.length("text"))))
    text = F.when(F.size("_spans") > 0, done).otherwise(F.col("text"))
    df = df.select(text.alias("_new"), "_row", (F.size("_spans") > 0).alias("_changed"))

    def column(c: str) -> Column:
        old = F.col("_row")[c]
        if c == "n_chars":
            return F.when(F.col("_changed"), F.length("_new").cast(kinds[c])).otherwise(old).alias(c)
        return F.col("_new").alias(c) if c == "text" else old.alias(c)

    kinds = {f.name: f.dataType for f in df.schema["_row"].dataType}
    return df.select(*map(column, columns))
