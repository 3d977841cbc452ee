"""Column functions: cleaning, identities, text and numbers. All stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SEPARATOR = "\u001f"
#: Spellings of a missing value, and of a present but unsupported one.
MISSING = ("", "nan", "none", "null", "<na>", "na")
UNSUPPORTED = ("unknown", "unknown_donor", "unknown_target", "not_applicable", "not applicable", "not_applicable_cell_line", "not_applicable_primary_cell", "__mixed__")
PROMPT_MISSING = ("n/a", "unk", "unknown")
TRUE_TEXT = ("true", "1", "yes", "y", "t")
FALSE_TEXT = ("false", "0", "no", "n", "f")


def clean_value(c: Column) -> Column:
    """Trimmed text; null if it spells a missing value."""
    x = F.trim(c)
    return F.when(F.lower(x).isin(*MISSING), None).otherwise(x)


def supported_value(c: Column) -> Column:
    """``clean_value`` that also nulls placeholders."""
    x = clean_value(c)
    return F.when(F.lower(x).isin(*UNSUPPORTED), None).otherwise(x)


def sentinel_value(c: Column, sentinel: str = "MISSING") -> Column:
    """A missing value as a sentinel that joins to itself."""
    return F.coalesce(clean_value(c), F.lit(sentinel))


def prompt_missing(c: Column) -> Column:
    return clean_value(c).isNull() | F.lower(F.trim(c)).isin(*PROMPT_MISSING)


def tri_state(c: Column) -> Column:
    """Text as boolean; null where it is neither."""
    x = F.lower(F.trim(c))
    return F.when(x.isin(*TRUE_TEXT), True).when(x.isin(*FALSE_TEXT), False)


def joined_hash(*parts: Column, digits: int = 64) -> Column:
    """SHA-256 of the parts joined by the unit separator, cut to ``digits``; a null part counts as empty."""
    return F.substring(F.sha2(F.concat_ws(SEPARATOR, *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]), 256), 1, digits)


def hash_order(seed: int | str, key: Column) -> Column:
    """Deterministic pseudo-random order by SHA-256 of seed and key."""
    return F.sha2(F.concat(F.lit(f"{seed}|"), key.cast("string")), 256)


def hash_index(key: Column, n: Column) -> Column:
    """A pseudo-random index 0..n-1 of a key."""
    return F.conv(F.substring(F.sha2(key, 256), 1, 8), 16, 10).cast("bigint") % n


def squeeze(c: Column) -> Column:
    """White space runs as single spaces, trimmed."""
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def decimal_text(c: Column) -> Column:
    """Plain decimal text without trailing zeros; never by way of a binary float."""
    x = F.regexp_replace(c.cast("decimal(38,18)").cast("string"), r"(\.\d*?)0+$", "$1")
    return F.regexp_replace(x, r"\.$", "")


def ellipsis(c: Column, n: int) -> Column:
    """Cut to ``n`` characters with dots where something was cut."""
    return F.when(F.length(c) > n, F.concat(F.rtrim(F.substring(c, 1, n)), F.lit("..."))).otherwise(c)


def section(text: Column, start: str, end: str | None) -> Column:
    """What stands between two markers (to the end if there is no second); null if the first is absent."""
    tail = F.when(F.instr(text, start) > 0, F.substring_index(text, start, -1) if end is None else F.split_part(text, F.lit(start), F.lit(2)))
    return F.trim(tail if end is None else F.split_part(tail, F.lit(end), F.lit(1)))


def dcg_discount(r: Column) -> Column:
    return 1 / F.log2(r + 1)


def length_cost(a: Column, b: Column) -> Column:
    """Half the absolute log ratio of two lengths, each plus one."""
    return 0.5 * F.abs(F.ln((a + 1) / (b + 1)))


def dot(a: Column, b: Column) -> Column:
    """Dot product, summed from the first element on, so that equal inputs give equal sums."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def unit(v: Column, policy: str = "zero") -> Column:
    """L2-normalised vector. Zero vectors stay zero (``zero``), are divided by a tiny norm (``clamp``), or are null (``null``)."""
    n = norm(v)
    n = F.greatest(n, F.lit(1e-12)) if policy == "clamp" else n
    other = F.transform(v, lambda x: x * 0.0) if policy == "zero" else F.lit(None)
    return F.when(n > 0, F.transform(v, lambda x: x / n)).otherwise(other)


def try_ratio(a: Column, b: Column) -> Column:
    """a / b, null where b is zero or null."""
    return a / F.nullif(b, F.lit(0.0))


def jaccard(a: Column, b: Column, empty: float | None = 1.0) -> Column:
    """Overlap of two sets; ``empty`` for two empty ones (None: null)."""
    u = F.size(F.array_union(a, b))
    return F.when(u > 0, F.size(F.array_intersect(a, b)) / u).otherwise(F.lit(empty))
