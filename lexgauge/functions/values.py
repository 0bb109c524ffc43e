"""Text cells to typed values: trimming, guarded numbers, tri-state booleans, composite keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

KEY = ["model_name", "run_id", "id", "input_variant"]
KEY_DEFAULTS = {"run_id": "1", "id": "", "input_variant": "standard"}

# The words read as yes and no.
YES = ["true", "1", "yes", "y", "pass", "ok"]
NO = ["false", "0", "no", "n", "fail", "ng"]

#: White space that trimming removes: Unicode's, and the four separators U+001C to U+001F.
_BLANK = r"[\s\x{1C}-\x{1F}\x{85}\x{A0}]"
NUMBER = r"^[+-]?([0-9]+(_[0-9]+)*\.?([0-9]+(_[0-9]+)*)?|\.[0-9]+(_[0-9]+)*)([eE][+-]?[0-9]+(_[0-9]+)*)?$"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def text(c: Column | str) -> Column:
    """A missing cell is the empty text."""
    return F.coalesce(col(c).cast("string"), F.lit(""))


def trimmed(c: Column | str) -> Column:
    """Without white space at both ends, Unicode's included (the built-in trim takes spaces alone)."""
    return F.regexp_replace(text(c), rf"(?U)^{_BLANK}+|{_BLANK}+$", "")


def as_float(c: Column | str) -> Column:
    """A finite number, else null: blanks, words, NaN and infinities are null, digits may be grouped by underscores."""
    t = trimmed(c)
    x = F.when(t.rlike(NUMBER), F.regexp_replace(t, "_", "").try_cast("double"))
    return F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x)


def number_of(df: DataFrame, c: str) -> Column:
    """``as_float`` of a column; one that holds numbers already is not turned into text and back."""
    if not isinstance(df.schema[c].dataType, NumericType):
        return as_float(c)
    x = F.col(c).cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x)


def to_int(c: Column | str) -> Column:
    """A number cut to its whole part, else null; out of range is null."""
    x = as_float(c)
    whole = F.when(x >= 0, F.floor(x)).otherwise(F.ceil(x))
    return F.when(F.abs(x) < 9.2e18, whole).cast("long")


def as_bool(c: Column | str) -> Column:
    """True, false, or null for anything else."""
    t = F.lower(trimmed(c))
    return F.when(t.isin(YES), True).when(t.isin(NO), False)


def is_truthy(c: Column | str) -> Column:
    return F.lower(trimmed(c)).isin(YES)


def bool_text(c: Column) -> Column:
    return F.when(c, "true").otherwise("false")


def rate(n: Column, d: Column) -> Column:
    """n / d, null if d is 0."""
    return F.try_divide(n.cast("double"), d.cast("double"))


def share(condition: Column) -> Column:
    """Aggregate: the share of rows where a never-null condition holds."""
    return F.avg(condition.cast("double"))


def key_or_default(columns: list[str], fallback_model: Column | str = "") -> dict[str, Column]:
    """The composite key's parts; an absent or blank part takes its default."""
    fallback = F.lit(fallback_model) if isinstance(fallback_model, str) else fallback_model
    out = {}
    for k in KEY:
        default = fallback if k == "model_name" else F.lit(KEY_DEFAULTS[k])
        out[k] = F.when(text(k) != "", text(k)).otherwise(default) if k in columns else default
    return out


def key_text(*columns: Column | str) -> Column:
    return F.concat_ws("|", *[text(c) for c in columns])
