"""Column expressions for cleaning and deriving values (all JVM-side built-ins).

Spark 4 runs with ANSI mode on, so every parse goes through ``try_cast`` /
``try_divide`` and nothing raises on dirty input.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Spellings treated as "missing" in a token list, and the
# sentinels that mean "no description" in the material master.
MISSING_LIKE = ["<NA>", "NAN", "NONE", ""]
DESC_SENTINELS = ["0", "?"]
# The token separators of the master's free-text user field.
TOKEN_SPLIT = "[,;/]"
# Scale applied to per-user line-down orders.
LINE_DOWN_SHARE = 0.5833


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def clean_int(c) -> Column:
    """keep digits, '.', '-'; parse; round half-even; bigint (bad -> null)."""
    cleaned = F.regexp_replace(_c(c).cast("string"), r"[^0-9.\-]", "")
    return F.bround(cleaned.try_cast("double"), 0).try_cast("bigint")


def clean_int_commas(c) -> Column:
    """strip commas only, parse to double (bad -> null)."""
    return F.replace(_c(c).cast("string"), F.lit(","), F.lit("")).try_cast("double")


def is_integral(c) -> Column:
    """F2 companion: whole-number check used to reject fractional integer fields."""
    v = _c(c)
    return v.isNull() | (v == F.floor(v))


def clean_float(c, strip_commas: bool = True) -> Column:
    """float cleanup, optionally dropping thousands commas."""
    s = _c(c).cast("string")
    if strip_commas:
        s = F.replace(s, F.lit(","), F.lit(""))
    return s.try_cast("double")


def clean_ts(c) -> Column:
    """timestamp parse, bad values to null."""
    return F.try_to_timestamp(_c(c).cast("string"))


def norm_key(c) -> Column:
    """trim + upper for lookup keys and labels."""
    return F.upper(F.trim(_c(c)))


def desc_or_unknown(c) -> Column:
    """null, '0' and '?' descriptions become 'UNK'."""
    v = _c(c)
    return F.when(v.isNull() | v.isin(*DESC_SENTINELS), F.lit("UNK")).otherwise(v)


def split_tokens(c) -> Column:
    """split on , ; / and trim each token (array<string>)."""
    return F.transform(F.split(_c(c), TOKEN_SPLIT), lambda t: F.trim(t))


def is_missing_like(c) -> Column:
    """F8: null, or a stringified missing marker."""
    v = _c(c)
    return v.isNull() | F.upper(F.trim(v)).isin(*MISSING_LIKE)


def sanitize_name(c) -> Column:
    """upper, runs of non [A-Z0-9_] to '_', strip '_' at both ends (empty -> null)."""
    s = F.regexp_replace(F.upper(F.trim(_c(c))), "[^A-Z0-9_]+", "_")
    s = F.regexp_replace(s, "^_+|_+$", "")
    return F.nullif(s, F.lit(""))


def category_key(priority, movement, size) -> Column:
    """category = priority + movement + size, null parts as empty text."""
    return F.concat(F.coalesce(_c(priority), F.lit("")), F.coalesce(_c(movement), F.lit("")),
                    F.coalesce(_c(size), F.lit("")))


def category_dim(category, pos: int) -> Column:
    """one-letter dimension at position ``pos`` (1-based); absent -> null."""
    return F.nullif(F.substring(_c(category), pos, 1), F.lit(""))


def sku_volume(min_vol, total_stock, total_cuft) -> Column:
    """max(min_vol, stock * cuft); null if either side is null (greatest would skip nulls)."""
    mv, prod = _c(min_vol), _c(total_stock) * _c(total_cuft)
    return F.when(mv.isNull() | prod.isNull(), F.lit(None).cast("double")).otherwise(F.greatest(mv, prod))


def per_user(value, num_users) -> Column:
    """value / num_users, zero or null users -> 0."""
    return F.coalesce(F.try_divide(_c(value).cast("double"), F.nullif(_c(num_users), F.lit(0)).cast("double")),
                      F.lit(0.0))


def line_down_per_user(ldo, num_users) -> Column:
    """F16: ceil(ldo / num_users * share), zero or null users -> 0."""
    q = F.try_divide(_c(ldo).cast("double"), F.nullif(_c(num_users), F.lit(0)).cast("double")) * F.lit(LINE_DOWN_SHARE)
    return F.coalesce(F.ceil(q).cast("double"), F.lit(0.0))


def display_percent(c) -> Column:
    """0 -> null, (0, 0.01) -> 0.01, else rounded half-even to 2 places."""
    v = _c(c)
    return (F.when(v == 0, F.lit(None).cast("double"))
            .when((v > 0) & (v < 0.01), F.lit(0.01))
            .otherwise(F.bround(v, 2)))


def flag(c) -> Column:
    """boolean-like or numeric flag to int 0/1, null -> 0."""
    v = _c(c)
    return F.when(F.coalesce(v.cast("double"), F.lit(0.0)) > 0, F.lit(1)).otherwise(F.lit(0))


def normalize_priority(c) -> Column:
    """upper-case H/M/L kept, anything else (null too) -> L."""
    u = F.upper(_c(c))
    return F.when(u.isin("H", "M", "L"), u).otherwise(F.lit("L"))


def minmax_radius(value, vmin, vmax, lo: float = 10.0, hi: float = 30.0) -> Column:
    """scale to [lo, hi]; a constant column maps to hi."""
    v, a, b = _c(value), _c(vmin), _c(vmax)
    return F.when(a == b, F.lit(hi)).otherwise(F.lit(lo) + (v - a) / (b - a) * F.lit(hi - lo))


def parse_variable(c) -> list[Column]:
    """'Base[i, j, ...]' -> base name plus up to four trimmed indices."""
    v = _c(c)
    base = F.trim(F.regexp_extract(v, r"^([^\[]*)", 1))
    inner = F.regexp_extract(v, r"\[(.*)\]\s*$", 1)
    parts = F.split(inner, ",")
    idx = [F.nullif(F.trim(F.get(parts, i)), F.lit("")) for i in range(4)]
    return [base] + idx
