"""Wide to long and long to wide, by a specification made of the labels when the plan is made."""

from __future__ import annotations

import itertools
import re
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..core import NUMERIC, bounded, categories, check, check_column, col, free, listed, missing, no_stream, resolve
from .select import collapse_labels

VALUE = ".value"


def _common(types: list[T.DataType]) -> T.DataType:
    kinds = list(dict.fromkeys(types))
    if len(kinds) == 1:
        return kinds[0]
    if all(isinstance(t, NUMERIC) for t in kinds):
        if any(isinstance(t, (T.FloatType, T.DoubleType, T.DecimalType)) for t in kinds):
            return T.DoubleType()
        return T.LongType()
    return T.StringType()


def _long(df: DataFrame, index: list[str], rows: list[tuple[dict[str, Any], dict[str, str]]], others: list[str], values: list[str], dropna: bool, sort_by_appearance: bool) -> DataFrame:
    """One output row for each of ``rows`` (labels, {value name: column}) and input row: one pass, no shuffle."""
    types = {v: _common([df.schema[cols[v]].dataType for _, cols in rows if v in cols]) for v in values}
    taken = set(index)
    if taken & set(values + others):
        raise ValueError(f"new columns clash with the index: {sorted(taken & set(values + others))}")
    structs = []
    for labels, cols in rows:
        fields = [F.lit(labels[o]).alias(f"o{i}") for i, o in enumerate(others)]
        fields += [(col(cols[v]).cast(types[v]) if v in cols else F.lit(None).cast(types[v])).alias(f"v{i}") for i, v in enumerate(values)]
        structs.append(F.struct(*fields))
    (x,) = free(df, "x")
    out = df.select(*[col(c) for c in index], F.explode(F.array(*structs)).alias(x))
    out = out.select(*[col(c) for c in index], *[F.col(f"{x}.o{i}").alias(o) for i, o in enumerate(others)], *[F.col(f"{x}.v{i}").alias(v) for i, v in enumerate(values)])
    if dropna:
        some = F.lit(False)
        for v in values:
            some = some | ~missing(out, v)
        out = out.where(some)
    return out


def pivot_longer_spec(df: DataFrame, spec: list[dict] | DataFrame, sort_by_appearance: bool = False, ignore_index: bool = True, dropna: bool = False) -> DataFrame:
    """Long form by a plan: rows with ``.name`` (a column), ``.value`` (where its values go) and further labels."""
    if isinstance(spec, DataFrame):
        spec = [r.asDict() for r in spec.collect()]
    if not spec or list(spec[0])[:2] != [".name", VALUE]:
        raise KeyError("the first two columns of a specification are .name and .value")
    names = [r[".name"] for r in spec]
    if len(set(names)) < len(names):
        raise ValueError(".name must be unique")
    check_column(df, names)
    others = [k for k in spec[0] if k not in (".name", VALUE)]
    index = [c for c in df.columns if c not in set(names)]
    return _from_spec(df, index, spec, others, dropna, sort_by_appearance)


def _from_spec(df, index, spec, others, dropna, by_row) -> DataFrame:
    values = list(dict.fromkeys(r[VALUE] for r in spec))
    if set(values) & set(others):
        raise ValueError("a name is both a value column and a label")
    rows: dict[tuple, tuple[dict, dict]] = {}
    if others:
        for r in spec:
            key = tuple(r[o] for o in others)
            at = rows.setdefault(key, ({o: r[o] for o in others}, {}))
            if r[VALUE] in at[1]:
                raise ValueError(f"two columns go to the same place: {key} {r[VALUE]}")
            at[1][r[VALUE]] = r[".name"]
    else:
        seen: dict[str, int] = {}
        for r in spec:
            k = seen.get(r[VALUE], 0)
            seen[r[VALUE]] = k + 1
            rows.setdefault((k,), ({}, {}))[1][r[VALUE]] = r[".name"]
    return _long(df, index, list(rows.values()), others, values, dropna, by_row)


def _transformed(spec: list[dict], how: Any, others: list[str]) -> list[dict]:
    if how is None:
        return spec
    fs = how if isinstance(how, dict) else {o: how for o in others}
    kinds = {"int": int, "int64": int, "float": float, "float64": float, "str": str, "string": str}
    for o in fs:
        if o not in others:
            raise ValueError(f"{o!r} is no new label column")
    return [{k: (kinds.get(fs[k], fs[k])(v) if k in fs and v is not None else v) for k, v in r.items()} for r in spec]


def _pattern_lists(names_to: Any, pattern: Any) -> tuple[list, list]:
    if isinstance(pattern, dict):
        return list(pattern), list(pattern.values())
    return listed(names_to), list(pattern)


def pivot_longer(df: DataFrame, index: Any = None, column_names: Any = None, names_to: Any = None, values_to: Any = "value", names_sep: str | None = None, names_pattern: Any = None, names_transform: Any = None, dropna: bool = False, sort_by_appearance: bool = False, ignore_index: bool = True) -> DataFrame:
    """Wide to long. Labels go to ``names_to``, whole or in parts (``names_sep``, or groups of ``names_pattern``); the part ``.value`` names the column the values go to.

    ``names_pattern`` may be a list of patterns: a column goes to the name of ``names_to`` whose pattern it is the first to match (with a list
    ``values_to``, labels go to names_to and values to values_to in pairs); a dict {name: pattern}; or one with named groups, of which ``_`` is ``.value``.
    """
    if names_sep is not None and names_pattern is not None:
        raise ValueError("give names_sep or names_pattern")
    idx = resolve(df, index if not isinstance(index, list) else list(index)) if index is not None else None
    cols = resolve(df, column_names) if column_names is not None else None
    if idx is None and cols is None:
        idx, cols = [], df.columns
    elif cols is None:
        cols = [c for c in df.columns if c not in set(idx)]
    elif idx is None:
        idx = [c for c in df.columns if c not in set(cols)]
    if not cols:
        return df
    spec: list[dict] = []
    to = listed(names_to)
    if names_sep is None and names_pattern is None:
        if len(to) > 1:
            raise ValueError("several names_to need names_sep or names_pattern")
        if to == [VALUE]:
            raise ValueError(".value needs names_sep or names_pattern")
        others = to or ["variable"]
        check("values_to", values_to, [str])
        spec = [{".name": c, VALUE: values_to, others[0]: c} for c in cols]
    elif names_sep is not None or isinstance(names_pattern, (str, re.Pattern)):
        parts = []
        if names_sep is not None:
            if not to:
                raise ValueError("names_sep needs names_to")
            parts = [tuple(re.split(names_sep, c)) for c in cols]
        else:
            rx = re.compile(names_pattern)
            found = [rx.search(c) for c in cols]
            if not to:
                if not rx.groupindex:
                    raise ValueError("names_pattern needs names_to or named groups")
                to = [VALUE if set(g) == {"_"} else g for g, _ in sorted(rx.groupindex.items(), key=lambda x: x[1])]
                parts = [tuple(m.group(i) for i in sorted(rx.groupindex.values())) if m else None for m in found]
            else:
                parts = [m.groups() if m else None for m in found]
            if any(p is None for p in parts):
                raise ValueError(f"no match for {[c for c, p in zip(cols, parts) if p is None]}")
        if any(len(p) != len(to) for p in parts):
            raise ValueError(f"labels fall into {sorted({len(p) for p in parts})} parts, names_to has {len(to)}")
        others = [n for n in to if n != VALUE]
        if len(set(others)) < len(others):
            raise ValueError("names_to must be unique")
        for c, p in zip(cols, parts):
            value = "".join(str(x) for x, n in zip(p, to) if n == VALUE) if VALUE in to else values_to
            spec.append({".name": c, VALUE: value, **{n: x for n, x in zip(to, p) if n != VALUE}})
    else:
        nested = isinstance(names_pattern, dict) and any(isinstance(v, dict) for v in names_pattern.values())
        if nested:
            names, pairs = [], []
            for label, inner in names_pattern.items():
                for value, rx in inner.items():
                    names.append((label, value))
                    pairs.append(rx)
            return _value_lists(df, idx, cols, names, pairs, names_transform, dropna, sort_by_appearance)
        names, patterns = _pattern_lists(names_to, names_pattern)
        if len(names) != len(patterns):
            raise ValueError("as many names as patterns are needed")
        if isinstance(values_to, (list, tuple)):
            if len(values_to) != len(patterns):
                raise ValueError("as many values_to as patterns are needed")
            return _value_lists(df, idx, cols, list(zip(names, values_to)), patterns, names_transform, dropna, sort_by_appearance)
        others, hits = [], {i: 0 for i in range(len(patterns))}
        for c in cols:
            i = next((i for i, p in enumerate(patterns) if re.search(p, c)), None)
            if i is not None:
                hits[i] += 1
                spec.append({".name": c, VALUE: names[i]})
        if not all(hits.values()):
            raise ValueError(f"no column for {[patterns[i] for i, n in hits.items() if not n]}")
    spec = _transformed(spec, names_transform, others)
    return _from_spec(df, idx, spec, others, dropna, sort_by_appearance)


def _value_lists(df, idx, cols, names, patterns, transform, dropna, by_row) -> DataFrame:
    """Each pattern's labels go to one column and their values to another; the k-th of each pattern share a row."""
    found = {i: [] for i in range(len(patterns))}
    for c in cols:
        i = next((i for i, p in enumerate(patterns) if re.search(p, c)), None)
        if i is not None:
            found[i].append(c)
    empty = [patterns[i] for i, x in found.items() if not x]
    if empty:
        raise ValueError(f"no column for {empty}")
    rows = []
    others, values = list(dict.fromkeys(n for n, _ in names)), list(dict.fromkeys(v for _, v in names))
    for group in itertools.zip_longest(*found.values()):
        labels, at = {o: None for o in others}, {}
        for (n, v), c in zip(names, group):
            if c is not None:
                labels[n], at[v] = c, c
        rows.append((labels, at))
    rows = [(r, at) for r, at in zip(_transformed([r for r, _ in rows], transform, others), [a for _, a in rows])]
    return _long(df, idx, rows, others, values, dropna, by_row)


def pivot_wider(df: DataFrame, index: Any = None, names_from: Any = None, values_from: Any = None, flatten_levels: bool = True, names_sep: str = "_", names_glue: str | None = None, reset_index: bool = True, names_expand: bool = False, index_expand: bool = False, names_values: list | None = None) -> DataFrame:
    """Long to wide: a column for each combination of ``names_from`` (and of several ``values_from``, whose name comes first).

    Two rows in one place are an error. ``names_expand`` and ``index_expand`` take categories from column metadata, used or not.
    ``names_values`` (tuples) saves the look for the combinations.
    """
    no_stream(df, "pivot_wider")
    if names_from is None:
        raise ValueError("names_from is needed")
    names = resolve(df, *listed(names_from))
    idx = resolve(df, *listed(index)) if index is not None else None
    vals = resolve(df, *listed(values_from)) if values_from is not None else None
    if idx is None:
        idx = [c for c in df.columns if c not in set(names + (vals or []))] if vals is not None else []
    if vals is None:
        vals = [c for c in df.columns if c not in set(idx + names)]
    if set(idx) & set(names) or set(vals) & set(idx + names):
        raise ValueError("a column has two roles")
    if names_values is None:
        found = [tuple(r) for r in bounded(df.select(*[col(c) for c in names]).distinct(), "pivot_wider", 10_000)]
        if names_expand:
            levels = [categories(df, c) or sorted({t[i] for t in found}) for i, c in enumerate(names)]
            found = list(itertools.product(*levels))
        else:
            rank = [{v: k for k, v in enumerate(categories(df, c) or [])} for c in names]
            found.sort(key=lambda t: tuple((v is None, rank[i].get(v, 0), v if v is not None else "") for i, v in enumerate(t)))
    else:
        found = [t if isinstance(t, tuple) else (t,) for t in names_values]
    one = isinstance(values_from, str) and len(vals) == 1

    def label(value: str, t: tuple) -> str:
        if names_glue is not None:
            return names_glue.format(**dict(zip(names, t)), _value=value)
        return collapse_labels([t if one else (value, *t)], names_sep)[0]

    made, aggs, dup = [], [], []
    for k, t in enumerate(found):
        at = F.lit(True)
        for c, v in zip(names, t):
            at = at & col(c).eqNullSafe(F.lit(v))
        dup.append(F.count(F.when(at, 1)).alias(f"n{k}"))
        for j, v in enumerate(vals):
            aggs.append(F.first(F.when(at, col(v)), ignorenulls=True).alias(f"v{j}_{k}"))
    tmp = free(df, "u") if not idx else []
    base = df if idx else df.withColumn(tmp[0], F.lit(1))
    keys = [col(c) for c in idx] or [F.col(tmp[0])]
    wide = base.groupBy(*keys).agg(*dup, *aggs)
    over = F.greatest(*[F.col(f"n{k}") for k in range(len(found))], F.lit(0)) > 1 if found else F.lit(False)
    for j, v in enumerate(vals):
        for k, t in enumerate(found):
            x = F.col(f"v{j}_{k}")
            # the check hangs on every value, so no projection can lose it
            made.append(F.when(over, F.raise_error(F.lit("several rows in one place of pivot_wider")).cast(df.schema[v].dataType)).otherwise(x).alias(label(v, t)))
    out = wide.select(*[col(c) for c in idx], *made)
    if index_expand and idx:
        from .joins import complete

        out = complete(out, *[{c: categories(df, c)} if categories(df, c) else c for c in idx])
    return out


