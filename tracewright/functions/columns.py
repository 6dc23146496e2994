"""Column expressions shared by the operators. All of them stay inside the JVM."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import IntegralType

UNKNOWN = "unknown"

# Every character that counts as blank at the ends of a text.
BLANKS = "".join(chr(i) for i in range(0x3001) if chr(i).isspace())

# A text that starts and ends with a visible ASCII character has nothing to strip. Two comparisons of its first and last
# character tell that; they are far cheaper than a regular expression or a trim that knows every blank, and their code is
# small: a generated method beyond 8000 bytes is not compiled by the JVM.
_FIRST_VISIBLE, _AFTER_VISIBLE = "!", "\x7f"
_NOT_BLANK = "[^" + "".join(f"\\u{ord(b):04x}" for b in BLANKS) + "]"

# Words a raw log uses for a missing value.
MISSING_WORDS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
]


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _plain(text: Column) -> Column:
    """Whether the first and the last character are visible ASCII: texts compare by their bytes."""
    last = F.right(text, F.lit(1))
    return (text >= _FIRST_VISIBLE) & (text < _AFTER_VISIBLE) & (last >= _FIRST_VISIBLE) & (last < _AFTER_VISIBLE)


def strip(c: str | Column) -> Column:
    text = col(c).cast("string")
    return F.when(_plain(text), text).otherwise(F.btrim(text, F.lit(BLANKS)))


def norm(c: str | Column, unknown: str = UNKNOWN) -> Column:
    """Stripped text; null and blank become the sentinel."""
    text = col(c).cast("string")
    stripped = F.when(text.rlike(_NOT_BLANK), F.btrim(text, F.lit(BLANKS)))
    return F.when(_plain(text), text).otherwise(F.coalesce(stripped, F.lit(unknown)))


def missing_to_null(c: str | Column) -> Column:
    return F.when(~col(c).isin(MISSING_WORDS), col(c))


def to_number(c: str | Column) -> Column:
    """Double, or null where the text is no finite number."""
    text = strip(c)
    value = text.try_cast("double")
    plain = ~F.lower(F.right(text, F.lit(1))).isin("d", "f", "y", "n")
    return F.when(plain & ~F.isnan(value), value)


def to_long_or(c: str | Column, default: int) -> Column:
    whole = strip(c).try_cast("bigint")
    return F.coalesce(whole, to_number(c).try_cast("bigint"), F.lit(default).cast("bigint"))


def long_or(df: DataFrame, name: str, default: int) -> Column:
    """``to_long_or`` of a column of ``df``; one of whole numbers is not read as text."""
    if isinstance(df.schema[name].dataType, IntegralType):
        return F.coalesce(F.col(name).cast("bigint"), F.lit(default).cast("bigint"))
    return to_long_or(name, default)


def to_double_or(c: str | Column, default: float = 0.0) -> Column:
    return F.coalesce(to_number(c), F.lit(float(default)))


def event_id(prefix: str, part: str, row_number: str | Column) -> Column:
    return F.concat_ws("_", F.lit(prefix), F.lit(part), col(row_number).cast("string"))


def node_key(entity_type: str | Column, entity_name: str | Column, sep: str = "::") -> Column:
    return F.concat(norm(entity_type), F.lit(sep), norm(entity_name))


def edge_type(family: str | Column, kind: str | Column) -> Column:
    return F.concat(norm(family), F.lit(":"), norm(kind))


def contains_any(c: str | Column, markers: list[str]) -> Column:
    """Case-insensitive search for any marker; null never matches."""
    pattern = "(?i)" + "|".join(re.escape(marker) for marker in markers)
    text = col(c).cast("string")
    found = text.rlike(pattern)
    if all(marker.isascii() for marker in markers):
        # What matches also holds a marker in lower case, which is far cheaper to look for in the rows without one.
        lower, maybe = F.lower(text), F.lit(False)
        for marker in markers:
            maybe = maybe | F.contains(lower, F.lit(marker.lower()))
        found = maybe & found
    return F.coalesce(found, F.lit(False))


def clean_double(c: str | Column) -> Column:
    """Double with NaN and infinities turned to null."""
    value = col(c).cast("double")
    return F.when(~F.isnan(value) & (F.abs(value) != F.lit(float("inf"))), value)


def all_finite(columns: list[str]) -> Column:
    cond = F.lit(True)
    for name in columns:
        cond = cond & F.coalesce(clean_double(name).isNotNull(), F.lit(False))
    return cond


def safe_ratio(a: Column, b: Column) -> Column:
    return F.coalesce(a.cast("double") / F.nullif(b.cast("double"), F.lit(0.0)), F.lit(0.0))


def business_hour(hour: str | Column, start: int = 8, end: int = 18, inclusive_end: bool = False) -> Column:
    for name, value in (("start", start), ("end", end)):
        if not 0 <= value <= 23:
            raise ValueError(f"business hour {name} must be between 0 and 23")
    if start >= end:
        raise ValueError("business hour start must be earlier than its end")
    h = col(hour)
    return (h >= start) & ((h <= end) if inclusive_end else (h < end))


def sigmoid(c: str | Column) -> Column:
    return 1.0 / (1.0 + F.exp(-col(c)))


def relu(c: str | Column) -> Column:
    return F.greatest(col(c), F.lit(0.0))


def leaky_relu(c: str | Column, slope: float = 0.2) -> Column:
    return F.when(col(c) > 0, col(c)).otherwise(col(c) * slope)


def elu(c: str | Column) -> Column:
    return F.when(col(c) > 0, col(c)).otherwise(F.exp(col(c)) - 1.0)


def dot(a: str | Column, b: str | Column) -> Column:
    products = F.zip_with(col(a), col(b), lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda acc, x: acc + x)


def hash_key(seed: int | str, *columns: str | Column) -> Column:
    """Repeatable pseudo-random hex text per row, the base of every split and draw."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[col(c).cast("string") for c in columns]))


def raw_draw(seed: int | str, *columns: str | Column) -> Column:
    """Repeatable 48-bit integer per row."""
    return F.conv(F.substring(hash_key(seed, *columns), 1, 12), 16, 10).cast("bigint")


def draw(seed: int | str, k: int, *columns: str | Column) -> Column:
    """Repeatable integer in 0..k-1 per row."""
    return F.pmod(raw_draw(seed, *columns), F.lit(k).cast("bigint"))


def metric_text(c: str | Column) -> Column:
    return F.when(col(c).isNotNull(), F.format_string("%.4f", col(c).cast("double"))).otherwise("N/A")


def interval_text(low: str | Column, high: str | Column) -> Column:
    text = F.format_string("[%.4f, %.4f]", col(low).cast("double"), col(high).cast("double"))
    return F.when(col(low).isNotNull() & col(high).isNotNull(), text).otherwise(F.lit("N/A"))


def first_json_number(doc: str | Column, paths: list[str]) -> Column:
    """The first candidate path of a JSON text that holds a value, as a number; null if it is none."""
    return F.coalesce(*[F.get_json_object(col(doc), f"$.{p}") for p in paths]).try_cast("double")


def normalized_name(name: str) -> str:
    """Lower-case column name: its runs of letters and digits joined by underscores."""
    return "_".join(re.findall("[a-z0-9]+", name.lower().replace("/", " per ")))
