"""Column-expression builders.  All JVM-side; nothing here runs Python per row."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Privacy flag name -> substring looked for in the settings text.
# The last token keeps its trailing underscore, so "target_advertising_x" also
# sets privacy_advertising.
PRIVACY_TOKENS: dict[str, str] = {
    "privacy_functional": "functional",
    "privacy_analytics": "analytics",
    "privacy_target_advertising": "target_advertising",
    "privacy_personalisation": "personalisation",
    "privacy_non-personalised_ads": "non-personalised_ads",
    "privacy_marketing": "marketing",
    "privacy_social_media": "social_media",
    "privacy_geo_location": "geo_location",
    "privacy_advertising": "advertising_",
}

# Run-together name boundaries (lower->Upper, or Upper->Upper+lower).
CAMEL_BOUNDARY = "(?<=[a-z])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])"


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def first_nonempty(cols: Sequence[str | Column], default: str | None = "") -> Column:
    """First value that is neither null nor the empty string, else ``default``."""
    parts = [F.nullif(col(c), F.lit("")) for c in cols]
    if default is not None:
        parts.append(F.lit(default))
    return F.coalesce(*parts)


def presence_flag(c: str | Column) -> Column:
    """1 when the value is present (the empty string counts as present), else 0."""
    return col(c).isNotNull().cast("int")


def remove_substring(c: str | Column, text: str) -> Column:
    return F.replace(col(c), F.lit(text), F.lit(""))


def substring_flags(c: str | Column, tokens: Mapping[str, str] = PRIVACY_TOKENS) -> list[Column]:
    """One 0/1 column per token (null where the text itself is null)."""
    return [F.contains(col(c), F.lit(tok)).cast("int").alias(name) for name, tok in tokens.items()]


def time_parts(ts: str | Column, prefix: str = "") -> list[Column]:
    """hour, weekday (Monday = 0), day of month, month."""
    t = col(ts)
    return [
        F.hour(t).alias(f"{prefix}hour"),
        F.weekday(t).alias(f"{prefix}weekday"),
        F.dayofmonth(t).alias(f"{prefix}dayofmonth"),
        F.month(t).alias(f"{prefix}month"),
    ]


def title_case(c: str | Column) -> Column:
    """Capitalise the first letter after any non-letter, lower-case the rest
    (``conceptual/analysis`` -> ``Conceptual/Analysis``)."""
    pieces = F.split(col(c), r"(?<=[^\p{L}])(?=\p{L})")
    return F.array_join(F.transform(pieces, lambda p: F.initcap(p)), "")


def camel_split(c: str | Column) -> Column:
    """``SmallRing`` -> ``[Small, Ring]``; ``ABCDef`` -> ``[ABC, Def]``."""
    return F.split(col(c), CAMEL_BOUNDARY)


def year_start_shift(year: str | Column, months: int = 12) -> Column:
    """Year number -> 1 January of that year, moved by ``months`` calendar months."""
    return F.add_months(F.make_date(col(year).cast("int"), F.lit(1), F.lit(1)), months)


def strip_braces(c: str | Column, default: str = "") -> Column:
    return F.translate(F.coalesce(col(c), F.lit(default)), "{}", "")


def join_names(c: str | Column, sep: str = "; ") -> Column:
    """``A and B and C`` -> ``A; B; C`` (empty string when absent)."""
    return F.coalesce(F.array_join(F.split(F.trim(col(c)), r"\s+and\s+"), sep), F.lit(""))


def row_sum(cols: Sequence[str | Column]) -> Column:
    """Row-wise sum with nulls skipped (all-null gives 0)."""
    return sum((F.coalesce(col(c), F.lit(0)) for c in cols), F.lit(0))


def seeded_hash(c: str | Column, seed: int | str) -> Column:
    """md5 hex of ``value-seed``: a reproducible pseudo-random sort key."""
    return F.md5(F.concat(col(c).cast("string"), F.lit(f"-{seed}")))


def hash_fraction(hex_hash: Column) -> Column:
    """First 15 hex digits of a hash as a fraction in [0, 1); monotone in the
    hex string, so a threshold on it keeps a prefix of the hash order."""
    return F.conv(F.substring(hex_hash, 1, 15), 16, 10).cast("double") / float(16 ** 15)
