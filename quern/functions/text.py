"""String methods by name, as Column expressions."""

from __future__ import annotations

import re
from collections.abc import Callable
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..core import check_column, col

_WS = r"[\s]"


def _strip(side: str) -> Callable:
    def f(c: Column, to_strip: str | None = None) -> Column:
        s = _WS if to_strip is None else "[" + "".join("\\" + x if not x.isalnum() else x for x in to_strip) + "]"
        left, right = f"^{s}+", f"{s}+$"
        c = F.regexp_replace(c, left, "") if side != "r" else c
        return F.regexp_replace(c, right, "") if side != "l" else c

    return f


def _pad(side: str, fill: str = " ") -> Callable:
    def f(c: Column, width: int, side_: str = side, fillchar: str = fill) -> Column:
        n = F.length(c)
        if side_ == "both":
            left = ((width - n) / 2).cast("int") if width % 2 == 0 else F.floor((width - n + 1) / 2).cast("int")
            both = F.rpad(F.lpad(c, n + F.greatest(left, F.lit(0)), fillchar), F.lit(width), fillchar)
            return F.when(n >= width, c).otherwise(both)
        padded = F.lpad(c, width, fillchar) if side_ == "left" else F.rpad(c, width, fillchar)
        return F.when(n >= width, c).otherwise(padded)

    return f


def _replace(c: Column, pat: str, repl: str, regex: bool = False, case: bool = True, n: int = -1) -> Column:
    if n != -1:
        raise ValueError("all or none are replaced")
    if not regex and case:
        return F.replace(c, F.lit(pat), F.lit(repl))
    pattern = (pat if regex else re.escape(pat)) if case else "(?i)" + (pat if regex else re.escape(pat))
    return F.regexp_replace(c, pattern, re.sub(r"\\(\d)", r"$\1", repl) if regex else repl.replace("$", "\\$"))


def _contains(c: Column, pat: str, case: bool = True, regex: bool = True, na: Any = None) -> Column:
    out = c.rlike(("" if case else "(?i)") + pat) if regex else (c.contains(pat) if case else F.lower(c).contains(pat.lower()))
    return out if na is None else F.coalesce(out, F.lit(na))


def _slice(c: Column, start: int | None = None, stop: int | None = None, step: int | None = None) -> Column:
    if step not in (None, 1):
        raise ValueError("the step must be 1")
    n = F.length(c)
    place = lambda x, default: default if x is None else F.least(F.lit(x), n) if x >= 0 else F.greatest(n + x, F.lit(0))
    a, b = place(start, F.lit(0)), place(stop, n)
    return F.when(c.isNotNull(), F.substring(c, a + 1, F.greatest(b - a, F.lit(0))))


def _slice_replace(c: Column, start: int | None = None, stop: int | None = None, repl: str = "") -> Column:
    return F.concat(_slice(c, 0, start if start is not None else 0), F.lit(repl), _slice(c, stop if stop is not None else 1 << 30))


def _extract(c: Column, pat: str, group: int = 1) -> Column:
    return F.when(c.rlike(pat), F.regexp_extract(c, pat, group))


def _split(c: Column, pat: str | None = None, n: int = -1) -> Column:
    if pat is None:
        return F.filter(F.split(c, r"\s+"), lambda x: x != "")
    return F.split(c, re.escape(pat), n + 1 if n > 0 else -1)


def _get(c: Column, i: int) -> Column:
    return F.try_element_at(c, F.lit(i + 1 if i >= 0 else i))


def _title(c: Column) -> Column:
    # a letter is upper-case if none stands before it
    low = F.lower(c)
    parts = F.regexp_extract_all(low, F.lit(r"(\p{L}+|[^\p{L}]+)"))
    return F.when(c.isNotNull(), F.array_join(F.transform(parts, lambda x: F.concat(F.upper(F.substring(x, 1, 1)), F.substring(x, 2, 1 << 30))), ""))


def _full(pattern: str) -> Callable:
    return lambda c: c.rlike(f"^(?:{pattern})\\z")


_METHODS: dict[str, Callable] = {
    "lower": F.lower, "upper": F.upper, "casefold": F.lower, "title": _title,
    "capitalize": lambda c: F.concat(F.upper(F.substring(c, 1, 1)), F.lower(F.substring(c, 2, 1 << 30))),
    "swapcase": lambda c: F.array_join(F.transform(F.regexp_extract_all(c, F.lit("([\\s\\S])")), lambda x: F.when(x == F.upper(x), F.lower(x)).otherwise(F.upper(x))), ""),
    "strip": _strip("b"), "lstrip": _strip("l"), "rstrip": _strip("r"), "len": F.length, "replace": _replace, "contains": _contains,
    "startswith": lambda c, pat: c.startswith(pat), "endswith": lambda c, pat: c.endswith(pat),
    "find": lambda c, sub: F.locate(sub, c) - 1, "rfind": lambda c, sub: F.when(c.contains(sub), F.length(c) - F.locate(sub[::-1], F.reverse(c)) - len(sub) + 1).when(c.isNotNull(), -1),
    "count": lambda c, pat: F.regexp_count(c, F.lit(pat)), "match": lambda c, pat: c.rlike(f"^(?:{pat})"), "fullmatch": lambda c, pat: c.rlike(f"^(?:{pat})\\z"),
    "extract": _extract, "findall": lambda c, pat: F.regexp_extract_all(c, F.lit(pat), F.lit(1 if re.compile(pat).groups else 0)),
    "split": _split, "rsplit": _split, "join": lambda c, sep: F.array_join(c, sep), "get": _get, "slice": _slice, "slice_replace": _slice_replace,
    "pad": lambda c, width, side="left", fillchar=" ": _pad(side)(c, width, side, fillchar), "ljust": lambda c, width, fillchar=" ": _pad("right")(c, width, "right", fillchar), "rjust": lambda c, width, fillchar=" ": _pad("left")(c, width, "left", fillchar), "center": lambda c, width, fillchar=" ": _pad("both")(c, width, "both", fillchar),
    "zfill": lambda c, width: F.when(c.rlike("^[+-]"), F.concat(F.substring(c, 1, 1), _pad("left")(F.substring(c, 2, 1 << 30), width - 1, "left", "0"))).otherwise(_pad("left")(c, width, "left", "0")),
    "repeat": lambda c, repeats: F.repeat(c, repeats), "cat": lambda c, *others, sep="": F.concat_ws(sep, c, *others),
    "removeprefix": lambda c, prefix: F.when(c.startswith(prefix), F.substring(c, len(prefix) + 1, 1 << 30)).otherwise(c), "removesuffix": lambda c, suffix: F.when(c.endswith(suffix), F.substring(c, F.lit(1), F.length(c) - len(suffix))).otherwise(c),
    "isalpha": _full(r"\p{L}+"), "isdigit": _full(r"\p{Nd}+"), "isdecimal": _full(r"\p{Nd}+"), "isnumeric": _full(r"\p{N}+"), "isalnum": _full(r"[\p{L}\p{N}]+"), "isspace": _full(r"\s+"),
    "islower": lambda c: (c == F.lower(c)) & c.rlike(r"\p{Ll}"), "isupper": lambda c: (c == F.upper(c)) & c.rlike(r"\p{Lu}"), "istitle": lambda c: (c == _title(c)) & c.rlike(r"\p{L}"),
    "encode": lambda c, encoding="utf-8": F.encode(c, encoding), "decode": lambda c, encoding="utf-8": F.decode(c, encoding),
    "translate": lambda c, table: F.translate(c, "".join(chr(k) if isinstance(k, int) else k for k in table), "".join(table.values())),
}
FRAMES = {"partition", "rpartition", "get_dummies"}


def normalize(c: Column, form: str = "NFC") -> Column:
    """Unicode normal form; there is no expression for it, so it goes over Arrow batches."""
    import pandas as pd

    def run(s: pd.Series) -> pd.Series:
        return s.str.normalize(form)

    return F.pandas_udf(run, "string")(c)


def process_text(df: DataFrame, column_name: str, string_function: str, **kwargs: Any) -> DataFrame:
    """A string method, by name, on a column; methods that give several columns are refused."""
    check_column(df, column_name)
    if string_function in FRAMES or kwargs.pop("expand", False):
        raise ValueError(f"{string_function!r} gives several columns")
    f = normalize if string_function == "normalize" else _METHODS.get(string_function)
    if f is None:
        raise KeyError(f"there is no string function {string_function!r}")
    return df.withColumn(column_name, f(col(column_name), **kwargs))
