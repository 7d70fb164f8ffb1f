"""Secret scans over an incremental ledger of content-addressed blobs."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from hearthstat.llm.common import boxed, stage

FINDING = "array<struct<start:long,stop:long>>"


@dataclass(frozen=True)
class Rule:
    """One kind of secret. A match counts if the given group has at least ``least`` characters."""

    kind: str
    version: int
    pattern: str
    group: int
    least: int


RULES = (
    Rule("assign", 1, r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", 1, r"AKIA[A-Z0-9]+", 0, 20),
    Rule("hex", 1, r"[0-9a-f]{24,}+", 0, 24),
)


def spans(text: Column, rule: Rule) -> Column:
    """Leftmost non-overlapping matches as code point spans, end exclusive.

    The texts between the matches and the matches themselves, in turn, give every position by their lengths. Texts without
    a match are seen once.
    """
    between = F.split(text, rule.pattern, -1)
    found = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
    counted = (lambda m: F.regexp_extract(m, rule.pattern, rule.group)) if rule.group else (lambda m: m)
    parts = F.zip_with(
        F.slice(between, F.lit(1), F.size(found)), found,
        lambda gap, m: F.struct(F.length(gap).cast("long").alias("gap"), F.length(m).cast("long").alias("long"),
                                (F.length(counted(m)) >= rule.least).alias("kept")))

    def placed(p: Column) -> Column:
        ends = prefixes(F.transform(p, lambda x: x["gap"] + x["long"]), 0, lambda x, y: x + y)
        every = F.zip_with(p, ends, lambda x, at: F.struct((at + x["gap"]).alias("start"), (at + x["gap"] + x["long"]).alias("stop"), x["kept"].alias("kept")))
        return F.transform(F.filter(every, lambda x: x["kept"]), lambda x: F.struct(x["start"].alias("start"), x["stop"].alias("stop")))

    return F.when(text.rlike(rule.pattern), once(parts, placed)).otherwise(F.array().cast(FINDING))


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """An expression of a value that is computed once however often it is used."""
    return F.transform(F.array(value), use)[0]


def prefixes(values: Column, zero: int, join: Callable[[Column, Column], Column]) -> Column:
    """For each number of an array, what comes before it joined up (sums, maxima).

    Steps copy what they have gathered, so the array is taken in pieces of about the square root of its length, and the
    pieces' totals are carried on: n numbers cost n times its square root small copies.
    """
    start = F.lit(zero).cast("long")
    first = F.struct(start.alias("at"), F.array().cast("array<long>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        return F.struct(join(acc["at"], x).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out"))

    def gathered(v: Column) -> Column:
        size = F.greatest(F.lit(1), F.ceil(F.sqrt(F.size(v)))).cast("int")
        pieces = F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil(F.size(v) / size).cast("int") - 1)), lambda i: F.slice(v, i * size + 1, size))
        return once(F.transform(pieces, lambda p: F.aggregate(p, first, step)), lambda done: F.flatten(F.zip_with(
            done, F.aggregate(done, first, lambda acc, d: step(acc, d["at"]), lambda acc: acc["out"]),
            lambda d, before: F.transform(d["out"], lambda x: join(before, x)))))

    return once(values, gathered)


def blob_id(text: Column) -> Column:
    """The address of a version's content; a NULL text counts as empty."""
    return F.sha2(F.coalesce(text, F.lit("")), 256)


def scan(versions: DataFrame, ledger: DataFrame | None = None, rules: Sequence[Rule] = RULES, text: str = "text") -> DataFrame:
    """Ledger rows (blob, kind, version, spans) for the blob and rule-version pairs that ``ledger`` does not hold yet.

    Equal contents are one blob, scanned once however many paths and historical versions share it; map-side grouping
    keeps one copy per task before the shuffle, so a hot blob weighs nothing. A pair of the ledger is never scanned
    again; a new version of a rule makes its pairs unseen for all blobs.
    """
    blobs = versions.select(blob_id(F.col(text)).alias("blob"), F.coalesce(F.col(text), F.lit("")).alias("_text"))
    blobs = blobs.groupBy("blob").agg(F.first("_text").alias("_text"))
    names = [f"{r.kind}@{r.version}" for r in rules]
    pending = {r: F.lit(True) for r in names}
    if ledger is not None:
        done = ledger.groupBy("blob").agg(F.collect_set(F.concat_ws("@", "kind", "version")).alias("_done"))
        blobs = blobs.join(done.withColumnRenamed("blob", "_blob"), F.col("blob") == F.col("_blob"), "left").drop("_blob")
        blobs = blobs.where(F.col("_done").isNull() | (F.size(F.array_except(F.array(*map(F.lit, names)), "_done")) > 0))
        pending = {n: F.col("_done").isNull() | ~F.array_contains("_done", n) for n in names}
    rows = [F.when(pending[n], F.struct(F.lit(r.kind).alias("kind"), F.lit(r.version).alias("version"), spans(F.col("_text"), r).alias("spans")))
            for n, r in zip(names, rules, strict=True)]
    found = blobs.select("blob", F.array(*rows).alias("_rows"))
    return found.select("blob", F.explode("_rows").alias("_row")).where("_row is not null").select("blob", "_row.*")


def update(versions: DataFrame, ledger: DataFrame | None = None, rules: Sequence[Rule] = RULES, text: str = "text") -> DataFrame:
    """The ledger after these versions: what it held and what was unseen, written down once."""
    new = scan(versions, ledger, rules, text)
    return stage(new if ledger is None else ledger.select(*new.columns).unionByName(new), "secret-ledger")


def findings(versions: DataFrame, ledger: DataFrame, rules: Sequence[Rule] = RULES, text: str = "text") -> DataFrame:
    """All paths with what the ledger knows of their content: the rows of ``versions`` and ``secrets``.

    ``secrets`` is an array of (start, place, stop, kind) in the order of start and of the rules; ``place`` is the rule's
    number. It is empty where nothing was found. The ledger has one row per blob after grouping; hot blobs make a skewed
    join, which Spark splits.
    """
    place = F.coalesce(*[F.when((F.col("kind") == r.kind) & (F.col("version") == r.version), i) for i, r in enumerate(rules)])
    known = ledger.withColumn("place", place).where("place is not null")
    each = F.transform("spans", lambda s: F.struct(s["start"].alias("start"), F.col("place").alias("place"), s["stop"].alias("stop"), F.col("kind").alias("kind")))
    known = known.groupBy(F.col("blob").alias("_blob")).agg(F.sort_array(F.flatten(F.collect_list(each))).alias("secrets"))
    keyed = versions.withColumn("_version", blob_id(F.col(text)))
    joined = keyed.join(known, keyed["_version"] == known["_blob"], "left")
    return joined.select(*[keyed[c] for c in versions.columns], known["secrets"])


def _marked(body: Column, spans: Column, mark: str) -> Column:
    """A text with its spans, which come by start, replaced; spans that overlap or touch become one mark.

    Texts are cut in an encoding of four bytes a character, so that a place is found without counting from the start.
    """
    wide = F.encode(body, "UTF-32")

    def piece(text: Column, a: Column, b: Column) -> Column:
        part = F.substr(text, (4 * a + 1).cast("int"), (4 * (b - a)).cast("int"))
        return F.decode(F.concat(F.lit(b"\x00\x00\xfe\xff"), part), "UTF-32")  # the order mark goes, one of the text itself stays

    def cut(s: Column) -> Column:
        stops = prefixes(F.transform(s, lambda x: x["stop"]), 0, F.greatest)
        each = F.zip_with(s, stops, lambda x, at: F.struct(at.alias("a"), x["start"].alias("b")))
        fresh = F.filter(each, lambda x, i: (i == 0) | (x["b"] > x["a"]))
        gaps = F.concat(fresh, F.array(F.struct(F.array_max(F.transform(s, lambda x: x["stop"])).alias("a"), F.length(body).cast("long").alias("b"))))
        return once(wide, lambda text: F.array_join(F.transform(gaps, lambda g: piece(text, g["a"], g["b"])), mark))

    return once(spans, cut)


def redact(versions: DataFrame, text: str = "text", mark: str = "[secret]", rules: Sequence[Rule] = RULES) -> DataFrame:
    """The versions with every span of their secrets replaced by ``mark``; other rows stay as they are.

    Spans that overlap or touch become one mark. A NULL text stays NULL.
    """
    ledger = update(versions, None, rules, text)
    hits = ledger.where(F.size("spans") > 0)
    found = findings(boxed(versions, body=text), hits, rules, "body")
    body = F.col("body")

    clean = F.when(F.coalesce(F.size("secrets"), F.lit(0)) > 0, _marked(body, F.col("secrets"), mark)).otherwise(body)
    return found.select("row", clean.alias("clean")).select(*[(F.col("clean") if c == text else F.col(f"row.`{c}`")).alias(c) for c in versions.columns])
