"""Units, money, and molecules where their library is installed. Nothing here goes to a network: rates come as tables."""

from __future__ import annotations

import ast
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..core import check_column, col

#: (dimension, factor to the base unit, offset of the base unit)
UNITS: dict[str, tuple[str, float, float]] = {
    "m": ("length", 1.0, 0.0), "km": ("length", 1000.0, 0.0), "cm": ("length", 0.01, 0.0), "mm": ("length", 0.001, 0.0), "um": ("length", 1e-6, 0.0), "nm": ("length", 1e-9, 0.0), "mile": ("length", 1609.344, 0.0), "yd": ("length", 0.9144, 0.0), "ft": ("length", 0.3048, 0.0), "inch": ("length", 0.0254, 0.0),
    "kg": ("mass", 1.0, 0.0), "g": ("mass", 0.001, 0.0), "mg": ("mass", 1e-6, 0.0), "t": ("mass", 1000.0, 0.0), "lb": ("mass", 0.45359237, 0.0), "oz": ("mass", 0.028349523125, 0.0),
    "s": ("time", 1.0, 0.0), "ms": ("time", 0.001, 0.0), "us": ("time", 1e-6, 0.0), "min": ("time", 60.0, 0.0), "hr": ("time", 3600.0, 0.0), "day": ("time", 86400.0, 0.0),
    "K": ("temperature", 1.0, 0.0), "degC": ("temperature", 1.0, 273.15), "degF": ("temperature", 5 / 9, 459.67 * 5 / 9), "R": ("temperature", 5 / 9, 0.0),
    "J": ("energy", 1.0, 0.0), "kJ": ("energy", 1000.0, 0.0), "cal": ("energy", 4.184, 0.0), "kcal": ("energy", 4184.0, 0.0), "Wh": ("energy", 3600.0, 0.0), "kWh": ("energy", 3.6e6, 0.0), "eV": ("energy", 1.602176634e-19, 0.0),
    "W": ("power", 1.0, 0.0), "kW": ("power", 1000.0, 0.0), "MW": ("power", 1e6, 0.0), "hp": ("power", 745.6998715822702, 0.0),
    "Pa": ("pressure", 1.0, 0.0), "kPa": ("pressure", 1000.0, 0.0), "bar": ("pressure", 1e5, 0.0), "atm": ("pressure", 101325.0, 0.0), "psi": ("pressure", 6894.757293168361, 0.0),
    "L": ("volume", 0.001, 0.0), "mL": ("volume", 1e-6, 0.0), "m**3": ("volume", 1.0, 0.0), "gal": ("volume", 0.003785411784, 0.0),
    "m/s": ("speed", 1.0, 0.0), "km/hr": ("speed", 1 / 3.6, 0.0), "mile/hr": ("speed", 0.44704, 0.0), "N": ("force", 1.0, 0.0), "kN": ("force", 1000.0, 0.0), "lbf": ("force", 4.4482216152605, 0.0),
    "rad": ("angle", 1.0, 0.0), "degree": ("angle", 0.017453292519943295, 0.0), "m**2": ("area", 1.0, 0.0), "km**2": ("area", 1e6, 0.0), "ft**2": ("area", 0.09290304, 0.0), "acre": ("area", 4046.8564224, 0.0),
}


#: Dimensions in powers of length, mass, time, temperature, current.
_POWERS: dict[str, tuple[int, ...]] = {
    "length": (1, 0, 0, 0, 0), "mass": (0, 1, 0, 0, 0), "time": (0, 0, 1, 0, 0), "temperature": (0, 0, 0, 1, 0), "current": (0, 0, 0, 0, 1), "angle": (0, 0, 0, 0, 0), "energy": (2, 1, -2, 0, 0), "power": (2, 1, -3, 0, 0),
    "pressure": (-1, 1, -2, 0, 0), "volume": (3, 0, 0, 0, 0), "speed": (1, 0, -1, 0, 0), "force": (1, 1, -2, 0, 0), "area": (2, 0, 0, 0, 0), "frequency": (0, 0, -1, 0, 0), "charge": (0, 0, 1, 0, 1), "voltage": (2, 1, -3, 0, -1),
}
UNITS |= {"A": ("current", 1.0, 0.0), "Hz": ("frequency", 1.0, 0.0), "C": ("charge", 1.0, 0.0), "V": ("voltage", 1.0, 0.0), "hour": ("time", 3600.0, 0.0), "week": ("time", 604800.0, 0.0), "year": ("time", 31557600.0, 0.0), "liter": ("volume", 0.001, 0.0)}
_PREFIXES = {"Y": 1e24, "Z": 1e21, "E": 1e18, "P": 1e15, "T": 1e12, "G": 1e9, "M": 1e6, "k": 1e3, "h": 1e2, "da": 1e1, "d": 1e-1, "c": 1e-2, "m": 1e-3, "u": 1e-6, "n": 1e-9, "p": 1e-12, "f": 1e-15}
_PREFIXED = {"m", "g", "s", "J", "W", "Wh", "Pa", "L", "N", "eV", "bar", "cal", "K", "A", "V", "C", "Hz"}


def _unit(text: str) -> tuple[tuple[int, ...], float, float]:
    """(powers, factor, offset) of a unit or of a product of powers of units, with metric prefixes: ``km``, ``kg*m/s**2``."""

    def named(n: str) -> tuple[tuple[int, ...], float, float]:
        if n in UNITS:
            d, f, o = UNITS[n]
            return _POWERS[d], f, o
        for prefix, factor in _PREFIXES.items():
            if n.startswith(prefix) and n[len(prefix) :] in _PREFIXED:
                d, f, _ = UNITS[n[len(prefix) :]]
                return _POWERS[d], f * factor, 0.0
        raise ValueError(f"{n!r} is no known unit")

    def build(e: ast.expr) -> tuple[tuple[int, ...], float]:
        if isinstance(e, ast.Name):
            powers, factor, _ = named(e.id)
            return powers, factor
        if isinstance(e, ast.Constant) and isinstance(e.value, (int, float)):
            return (0,) * 5, float(e.value)
        if isinstance(e, ast.BinOp) and isinstance(e.op, (ast.Mult, ast.Div)):
            (p, f), (r, g) = build(e.left), build(e.right)
            sign = 1 if isinstance(e.op, ast.Mult) else -1
            return tuple(x + sign * y for x, y in zip(p, r)), f * g**sign
        if isinstance(e, ast.BinOp) and isinstance(e.op, ast.Pow):
            n = ast.literal_eval(e.right)
            p, f = build(e.left)
            if isinstance(n, int):
                return tuple(x * n for x in p), f**n
        raise ValueError(f"{text!r} is no unit")

    if text in UNITS or text.isidentifier():
        return named(text)
    try:
        tree = ast.parse(text.replace("^", "**"), mode="eval").body
    except SyntaxError as e:
        raise ValueError(f"{text!r} is no unit") from e
    return (*build(tree), 0.0)


def convert_units(df: DataFrame, column_name: str, existing_units: str, to_units: str, dest_column_name: str) -> DataFrame:
    """Values in other units of the same dimension (see _unit())."""
    check_column(df, column_name)
    check_column(df, dest_column_name, present=False)
    (d1, f1, o1), (d2, f2, o2) = _unit(existing_units), _unit(to_units)
    if d1 != d2:
        raise ValueError(f"{existing_units!r} and {to_units!r} have different dimensions")
    return df.withColumn(dest_column_name, (col(column_name) * f1 + (o1 - o2)) / f2)


def inflate_currency(df: DataFrame, column_name: str, country: str, currency_year: int, to_year: int, cpi: dict[tuple[str, int], float], make_new_column: bool = False) -> DataFrame:
    """Amounts of one year in the money of another, by a price index {(country, year): index}."""
    check_column(df, column_name)
    for y in (currency_year, to_year):
        if (country, y) not in cpi:
            raise ValueError(f"no price index of {country!r} in {y}")
    ratio = cpi[country, to_year] / cpi[country, currency_year]
    return df.withColumn(f"{column_name}_{to_year}" if make_new_column else column_name, col(column_name) * F.lit(ratio))


def convert_currency(df: DataFrame, column_name: str, from_currency: str, to_currency: str, rates: dict[str, float] | None = None, make_new_column: bool = False) -> DataFrame:
    """By a table of what a unit of each currency is worth; without one it is an error, as there is no service to ask."""
    if rates is None:
        raise ConnectionError("no exchange rates: pass rates={currency: worth}")
    check_column(df, column_name)
    v = col(column_name) * F.lit(rates[from_currency] / rates[to_currency])
    return df.withColumn(f"{column_name}_{to_currency}" if make_new_column else column_name, v)


def convert_stock(symbols: DataFrame, companies: DataFrame, symbol_col: str = "symbol", name_col: str = "name") -> DataFrame:
    """Company names of symbols (in any case) from a table of both; an unknown symbol gets null."""
    names = companies.select(F.upper(col(symbol_col)).alias("s_"), col(name_col).alias(name_col)).dropDuplicates(["s_"])
    return symbols.join(names, F.upper(col(symbol_col)) == F.col("s_"), "left").drop("s_")


def get_symbol(symbol: str, companies: dict[str, str]) -> str | None:
    return companies.get(symbol.upper())


def _chemistry():
    try:
        import rdkit.Chem as chem
    except ImportError as e:
        raise ImportError("molecules need the rdkit library") from e
    return chem


def _molecules(df: DataFrame, name: str, f: Any, returns: str, out: str) -> DataFrame:
    check_column(df, name)
    _chemistry()
    return df.withColumn(out, F.udf(f, returns, useArrow=True)(col(name)))


def smiles2mol(df: DataFrame, smiles_column_name: str, mols_column_name: str, drop_nulls: bool = True) -> DataFrame:
    """Molecules in binary form; what can't be read is null, or dropped."""

    def run(s: str | None) -> bytes | None:
        chem = _chemistry()
        m = chem.MolFromSmiles(s) if s is not None else None
        return m.ToBinary() if m is not None else None

    out = _molecules(df, smiles_column_name, run, "binary", mols_column_name)
    return out.where(col(mols_column_name).isNotNull()) if drop_nulls else out


def morgan_fingerprint(df: DataFrame, mols_column_name: str, radius: int = 3, nbits: int = 2048, kind: str = "counts", dest_column_name: str = "fingerprint") -> DataFrame:
    if kind not in ("counts", "bits"):
        raise ValueError("kind is counts or bits")

    def run(b: bytes | None) -> list[int] | None:
        if b is None:
            return None
        from rdkit.Chem import rdFingerprintGenerator as g

        made = g.GetMorganGenerator(radius=radius, fpSize=nbits)
        m = _chemistry().Mol(bytes(b))
        return [int(x) for x in (made.GetCountFingerprintAsNumPy(m) if kind == "counts" else made.GetFingerprintAsNumPy(m))]

    return _molecules(df, mols_column_name, run, "array<int>", dest_column_name)


def maccs_keys_fingerprint(df: DataFrame, mols_column_name: str, dest_column_name: str = "maccs") -> DataFrame:
    def run(b: bytes | None) -> list[int] | None:
        if b is None:
            return None
        from rdkit.Chem import MACCSkeys

        return [int(x) for x in MACCSkeys.GenMACCSKeys(_chemistry().Mol(bytes(b)))]

    return _molecules(df, mols_column_name, run, "array<int>", dest_column_name)


def molecular_descriptors(df: DataFrame, mols_column_name: str, dest_column_name: str = "descriptors") -> DataFrame:
    def run(b: bytes | None) -> dict[str, float] | None:
        if b is None:
            return None
        from rdkit.Chem import Descriptors

        m = _chemistry().Mol(bytes(b))
        return {k: float(f(m)) for k, f in Descriptors.descList}

    return _molecules(df, mols_column_name, run, "map<string,double>", dest_column_name)


def clone_using(grid: DataFrame, values: list, order_by: list[str], value_column: str = "value", new_name: str | None = None) -> DataFrame:
    """A long-form array (dimensions, value) with other values, laid along ``order_by``."""
    from .scalar import add_column

    out = grid.drop(value_column)
    return add_column(out, new_name or value_column, values, order_by=order_by)


def convert_datetime_to_number(df: DataFrame, time_units: str, dim: str = "time") -> DataFrame:
    """A time column as a number of units since 1970."""
    micros = {"D": 86_400_000_000, "h": 3_600_000_000, "m": 60_000_000, "s": 1_000_000, "ms": 1000, "us": 1}
    if time_units not in micros:
        raise ValueError(f"{time_units!r} is no unit of time")
    check_column(df, dim)
    n = F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), col(dim).cast("timestamp_ntz"))
    return df.withColumn(dim, n.cast("double") / micros[time_units])
