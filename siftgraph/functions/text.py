"""Scalar functions over method names, tags and feature sets."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def category(method: Column) -> Column:
    """enhanced, baseline or other by what the name contains, whatever its case."""
    m = F.lower(method)
    return F.when(m.contains("graph_enhanced"), "enhanced").when(m.contains("graph_baseline"), "baseline").otherwise("other")


def method_base(method: Column) -> Column:
    """The name before its last '__post', whatever its case."""
    return F.when(method.rlike(r"(?i)__post"), F.regexp_extract(method, r"(?is)^(.*)__post", 1)).otherwise(method)


def has_post(post_mode: Column) -> Column:
    """Whether a post mode is given: not null, blank or 'nan'."""
    return F.coalesce(~F.lower(F.trim(post_mode)).isin("", "nan"), F.lit(False))


def post_tag(method: Column, post_mode: Column | None = None) -> Column:
    """'post' and the post mode where one is given, else the name in lower case from its last 'post' after '__', else 'nopost'."""
    name = F.lower(method)
    own = F.when(F.coalesce(name.contains("__post"), F.lit(False)), F.concat(F.lit("post"), F.regexp_extract(name, r"(?s)^.*__post(.*)$", 1))).otherwise("nopost")
    return own if post_mode is None else F.when(has_post(post_mode), F.concat(F.lit("post"), F.lower(post_mode))).otherwise(own)


def method_test(method: Column, post_mode: Column) -> Column:
    """The name with '__post' and the post mode in lower case, where one is given."""
    return F.when(has_post(post_mode), F.concat(method, F.lit("__post"), F.lower(post_mode))).otherwise(method)


def safe_tag(name: Column) -> Column:
    """A name for folders; ':' becomes '__', so parts of a name stay apart."""
    for a, b in ((":", "__"), ("/", "_"), ("\\", "_"), (" ", "_")):
        name = F.replace(name, F.lit(a), F.lit(b))
    return name


def float_tag(value: Column) -> Column:
    """0.5 as 0p5, 2.0 as 2, -1.5 as m1p5: six significant digits, an exponent below 1e-4 and from 1e6 on."""
    value = value.cast("double")
    text = F.format_string("%.5e", value)
    exponent = F.regexp_extract(text, r"e([+-]\d+)$", 1).try_cast("int")
    trimmed = lambda x: F.regexp_replace(x, r"\.?0+$", "")
    fixed = F.when(exponent < 0, trimmed(text.try_cast("decimal(38,12)").cast("string"))).otherwise(trimmed(text.try_cast("decimal(38,6)").cast("string")))
    short = F.concat(trimmed(F.regexp_extract(text, r"^(.*)e", 1)), F.regexp_extract(text, r"(e[+-]\d+)$", 1))
    text = F.when(F.isnan(value), "nan").when(F.abs(value) == float("inf"), F.when(value > 0, "inf").otherwise("-inf")).when((exponent >= -4) & (exponent < 6), fixed).otherwise(short)
    return F.replace(F.replace(text, F.lit("-"), F.lit("m")), F.lit("."), F.lit("p"))


def algo_parts(algo: Column) -> list[Column]:
    """family, first and second part of an algorithm's name, split at ':'."""
    parts = F.split(algo, ":", 3)
    return [F.get(parts, F.lit(k)) for k in range(3)]


def join_ids(ids: Column) -> Column:
    return F.array_join(ids.cast("array<string>"), " ")


def parse_ids(text: Column) -> Column:
    return F.filter(F.transform(F.split(F.trim(text), " +"), lambda x: x.try_cast("int")), lambda x: x.isNotNull())


def parse_ratios(text: Column) -> Column:
    return F.transform(F.split(text, ","), lambda x: F.trim(x).cast("double"))


def mean_std(mean: Column, std: Column, digits: int = 3) -> Column:
    return F.format_string(f"%.{digits}f±%.{digits}f", mean, std)


def finite(x: Column) -> Column:
    """x, or 0 where it is null, NaN or infinite."""
    return F.when(x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")), 0.0).otherwise(x)


def is_finite(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))


def lp_distance(pairs: list[tuple[Column, Column]], p: float = 2.0) -> Column:
    total = sum((F.pow(F.abs(a - b), F.lit(p)) for a, b in pairs), F.lit(0.0))
    return F.pow(total, F.lit(1.0 / p))
