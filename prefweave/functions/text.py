"""Scalar functions on strings, scores and names."""

from __future__ import annotations

import ast
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def trailing_rating(text: Column) -> Column:
    """The digit 1 to 5 that the text ends with, whatever signs follow; null if there is none."""
    return F.nullif(F.regexp_extract(text, r"(?U)([1-5])\W*$", 1), F.lit("")).cast("int")


def unswapped(score: Column, swapped: Column) -> Column:
    """A 1..5 rating of an exchanged pair, turned back."""
    return F.when(swapped, 6 - score).otherwise(score)


def coin(key: Column, seed: int = 42) -> Column:
    """A fair bit of the key, the same on every run."""
    return F.substring(F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string"))), 1, 1).isin(*"89abcdef")


def score_bin(score: Column) -> Column:
    """Five bins around 0; scores between whole numbers are ``other``."""
    return F.when(score <= -2, "<=-2").when(score >= 2, ">=2").when(score == F.floor(score), score.cast("int").cast("string")).when(score.isNotNull(), "other")


def protocol_name(model: Column, aliases: dict[str, str], prefix: str = "") -> Column:
    """The training protocol of a model's name: an alias, else without prefix and seed."""
    plain = F.regexp_replace(F.regexp_replace(model, "^" + re.escape(prefix), ""), r"-seed-\d+$", "")
    out = plain
    for name, alias in aliases.items():
        out = F.when(model == name, alias).otherwise(out)
    return out


def parse_list(text: str | None) -> list[str] | None:
    """The list of strings that a text holds, in a code fence or else from the first [ to the last ]; None if there is none."""
    if not text:
        return None
    fenced = re.search(r"```(?:python)?\s*(.*?)```", text, re.S | re.I)
    body = fenced.group(1) if fenced else text
    a, b = body.find("["), body.rfind("]")
    if a < 0 or b < a:
        return None
    try:
        value = ast.literal_eval(body[a : b + 1])
    except (ValueError, SyntaxError, MemoryError, RecursionError):
        return None
    if not isinstance(value, list) or not all(isinstance(x, str) for x in value):
        return None
    return [x.strip() for x in value if x.strip()]


@F.pandas_udf(T.ArrayType(T.StringType()))
def parsed_list(text: pd.Series) -> pd.Series:
    return text.map(parse_list)


def fill(template: str, **values: Column) -> Column:
    """``{name}`` replaced by values; braces within values stay as they are."""
    parts = re.split(r"\{(\w+)\}", template)
    return F.concat(*(values[p].cast("string") if i % 2 else F.lit(p) for i, p in enumerate(parts) if p or i % 2))


def truncated(text: Column, limit: int) -> Column:
    return F.when(F.length(text) > limit, F.concat(F.left(text, F.lit(limit)), F.lit("..."))).otherwise(text)


def squeezed(text: Column) -> Column:
    """White space runs, of any script, as single spaces, like joining Python's ``split()``."""
    return F.trim(F.regexp_replace(text, r"[\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+", " "))


def one_line(text: Column, limit: int) -> Column:
    """The first characters on one line."""
    return F.replace(F.left(text, F.lit(limit)), F.lit("\n"), F.lit(" "))


def episode_key(sample_id: Column, epoch: Column) -> Column:
    return F.format_string("%s_epoch_%s.json", sample_id.cast("string"), epoch.cast("string"))


def score_summary(raw: Column, score: Column, orders: Column) -> Column:
    """Raw score and score; if there are results by order, the averages and each order's two."""
    both = lambda a, b: F.concat(F.lit("raw="), a.cast("string"), F.lit(" sycophancy="), b.cast("string"))
    each = F.transform(orders, lambda o: F.concat(o["order_name"], F.lit(": "), both(o["raw_score"], o["sycophancy_score"])))
    means = F.format_string("avg_raw=%.2f | avg_sycophancy=%.2f", raw, score)
    return F.when(F.coalesce(F.size(orders), F.lit(0)) > 0, F.concat_ws(" | ", means, F.array_join(each, " | "))).otherwise(both(raw, score))


def field_or(raw: Column, inner: str, field: str) -> Column:
    """A field of the object ``inner`` in a JSON text if it has that key, be it null, else of the text's own object."""
    has = F.array_contains(F.json_object_keys(F.get_json_object(raw, f"$.{inner}")), field)
    return F.when(F.coalesce(has, F.lit(False)), F.get_json_object(raw, f"$.{inner}.{field}")).otherwise(F.get_json_object(raw, f"$.{field}"))


@F.pandas_udf(T.StringType())
def three_digits(x: pd.Series) -> pd.Series:
    """Three significant digits in the shorter of plain and scientific notation; for small tables."""
    return x.map(lambda v: None if v is None or v != v else f"{v:.3g}").astype(object)


def slug(name: Column) -> Column:
    """What follows the last slash."""
    return F.element_at(F.split(name, "/"), -1)


def padded(number: Column, digits: int) -> Column:
    return F.lpad(number.cast("string"), digits, "0")


def layer_index(layers: Column, numerator: int = 2, denominator: int = 3) -> Column:
    return F.floor(layers * F.lit(float(numerator)) / denominator).cast("int")


def signed(x: Column, digits: int = 4) -> Column:
    return F.format_string(f"%+.{digits}f", x)


def short_range(low: Column, high: Column) -> Column:
    return F.concat_ws("-", low.cast("string"), high.cast("string"))
