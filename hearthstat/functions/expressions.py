"""Number, share, flag, rule and label expressions (inventory P5, P8-P12, P23-P32, P37, P38)."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

NUMBER_PATTERN = r"^-?\d+(\.\d+)?$"


def as_column(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def safe_number(c: Column | str, sentinels: Iterable[float] = ()) -> Column:
    """Text to double; blanks, symbols, exponents and annotations give NULL, never an error (P5).

    ``sentinels`` lists numeric codes that stand for "no value" and also become NULL.
    """
    text = F.trim(as_column(c).cast("string"))
    number = F.when(text.rlike(NUMBER_PATTERN), text.cast("double"))
    codes = [float(s) for s in sentinels]
    return F.when(~number.isin(codes), number) if codes else number


def has_text(c: Column | str) -> Column:
    c = as_column(c)
    return c.isNotNull() & (F.trim(c.cast("string")) != "")


def is_blank(c: Column | str) -> Column:
    """NULL or only spaces."""
    c = as_column(c)
    return c.isNull() | (F.trim(c.cast("string")) == "")


def digits_of_length(c: Column | str, length: int) -> Column:
    """Key validity: exactly ``length`` digits."""
    return F.coalesce(as_column(c).rlike(f"^[0-9]{{{length}}}$"), F.lit(False))


def optional_column(df: DataFrame, name: str, alias: str, dtype: str = "double") -> Column:
    """The named column, or a typed NULL when this frame does not carry it."""
    found = F.col(name).cast(dtype) if name in df.columns else F.lit(None).cast(dtype)
    return found.alias(alias)


def pct(num: Column | str, den: Column | str, digits: int = 2) -> Column:
    """Guarded percentage: NULL unless the base is positive."""
    num, den = as_column(num), as_column(den)
    return F.when(den > 0, F.round(100.0 * num / den, digits))


def sum_of_parts(parts: Sequence[Column | str]) -> Column:
    """Sum in which a missing part counts as zero."""
    return reduce(lambda a, b: a + b, [F.coalesce(as_column(p), F.lit(0.0)) for p in parts])


def bundle(parts: Sequence[Column | str], digits: int = 2, need_any: bool = False) -> Column:
    """Share bundle (P10). All parts missing gives 0.0, or NULL with ``need_any``."""
    total = F.round(sum_of_parts(parts), digits)
    if not need_any:
        return total
    present = reduce(lambda a, b: a | b, [as_column(p).isNotNull() for p in parts])
    return F.when(present, total)


def complement(share: Column | str, digits: int = 2) -> Column:
    """100 minus a share; NULL stays NULL."""
    return F.round(100.0 - as_column(share), digits)


def all_present(*cols: Column | str) -> Column:
    """1 when every column is present, else 0."""
    test = reduce(lambda a, b: a & b, [as_column(c).isNotNull() for c in cols])
    return F.when(test, 1).otherwise(0)


def flag(condition: Column) -> Column:
    """0/1 integer; an unknown condition counts as 0."""
    return F.when(condition, 1).otherwise(0)


def ratio(num: Column | str, den: Column | str, scale: float = 100.0) -> Column:
    """Zero-safe division times ``scale``."""
    return as_column(num) / F.nullif(as_column(den), F.lit(0)) * F.lit(scale)


def clamp(c: Column | str, low: Column | float, high: Column | float) -> Column:
    """Limit to [low, high]; NULL stays NULL."""
    c = as_column(c)
    bound = F.least(F.greatest(c, _value(low)), _value(high))
    return F.when(c.isNotNull(), bound)


def floored(c: Column | str, floor: float) -> Column:
    """A missing value becomes the floor, a lower value is raised to it."""
    return F.greatest(F.coalesce(as_column(c), F.lit(float(floor))), F.lit(float(floor)))


def _value(v: Column | float) -> Column:
    return v if isinstance(v, Column) else F.lit(float(v))


def first_rule(rules: Sequence[tuple[Column, str]], default: str) -> Column:
    """Label of the first rule that holds (P24); a NULL comparison never holds."""
    return F.coalesce(*[F.when(test, F.lit(label)) for test, label in rules], F.lit(default))


def rule_note(rules: Sequence[tuple[Column, str]], default: str) -> Column:
    """All phrases that hold joined with '; ' as one sentence, or the default (P25)."""
    joined = F.concat_ws("; ", *[F.when(test, F.lit(text)) for test, text in rules])
    sentence = F.concat(F.upper(F.substring(joined, 1, 1)), F.lower(F.substr(joined, F.lit(2))), F.lit("."))
    return F.when(joined == "", F.lit(default)).otherwise(sentence)


def tidy_place(c: Column | str, words: Sequence[str] = (" city", " village", " town")) -> Column:
    """Place name without the legal-form words, wherever they stand."""
    return reduce(lambda acc, w: F.replace(acc, F.lit(w), F.lit("")), words, F.trim(as_column(c)))


def area_label(place: Column | str, name: Column | str, kind: Column | str,
               unknown: str = "Unknown tract") -> Column:
    """'place — kind', falling back to the canonical name."""
    lead = F.coalesce(as_column(place), as_column(name), F.lit(unknown))
    return F.concat(lead, F.lit(" — "), as_column(kind))


def zero_padded(c: Column | str, width: int, digits_only: bool = False) -> Column:
    """Left-pad with zeros, never cutting a longer key."""
    text = F.trim(as_column(c).cast("string"))
    if digits_only:
        text = F.regexp_replace(text, "[^0-9]", "")
    return F.when(F.length(text) >= width, text).otherwise(F.lpad(text, width, "0"))


def metric_kind(name: Column | str, kinds: Mapping[str, str] | None = None, default: str = "derived") -> Column:
    """Kind of a metric from the ending of its name."""
    kinds = kinds or {"_m": "moe", "_e": "estimate"}
    low = F.lower(as_column(name))
    return first_rule([(low.endswith(end), kind) for end, kind in kinds.items()], default)


def tag(c: Column | str, labels: Mapping[str, str], default: str | None = None) -> Column:
    """Label through a literal map."""
    pairs = [F.lit(x) for kv in labels.items() for x in kv]
    found = F.try_element_at(F.create_map(*pairs), as_column(c))
    return F.coalesce(found, F.lit(default)) if default is not None else found


def json_payload(key: Column | str, cols: Sequence[str]) -> Column:
    """The measures as one JSON object, NULL where the joined row is missing."""
    return F.when(as_column(key).isNotNull(), F.to_json(F.struct(*cols), {"ignoreNullFields": "false"}))
