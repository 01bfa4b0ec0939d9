"""Engineering functions: radixes, bits, units and the error function as column expressions, complex numbers over Arrow batches."""

from __future__ import annotations

import functools
import math
import re
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from cellflow.functions.core import dbl, fn, only, text, whole

#: Bits of a radix's two's complement.
BITS = {2: 10, 8: 30, 16: 40}


def _shown(n: Column, radix: int, places: int | None) -> Column:
    span = 1 << BITS[radix]
    body = F.conv(F.when(n < 0, n + span).otherwise(n).cast("string"), 10, radix)
    fits = (n >= -(span // 2)) & (n < span // 2)
    if places is not None:
        fits = fits & ((n < 0) | (F.length(body) <= places))
        body = F.when(n < 0, body).otherwise(F.lpad(body, places, "0"))
    return F.when(fits, body)


def _read(x, radix: int) -> Column:
    digits = "0123456789abcdef"[:radix]
    span = 1 << BITS[radix]
    n = F.conv(text(x), radix, 10).try_cast("long")
    return F.when(F.lower(text(x)).rlike(f"^[{digits}]{{1,10}}$"), F.when(n >= span // 2, n - span).otherwise(n))


#: Names of the radixes.
RADIXES = {"BIN": 2, "OCT": 8, "HEX": 16}
for _to, _radix in RADIXES.items():
    fn(f"DEC2{_to}")(lambda x, places=None, r=_radix: _shown(whole(x), r, places))
    fn(f"{_to}2DEC")(lambda x, r=_radix: _read(x, r))
    for _from, _other in RADIXES.items():
        if _from != _to:
            fn(f"{_from}2{_to}")(lambda x, places=None, a=_other, b=_radix: _shown(_read(x, a), b, places))


def _bits(*values) -> tuple[Column, list[Column]]:
    numbers = [dbl(v) for v in values]
    fits = F.lit(True)
    for n in numbers:
        fits = fits & (n >= 0) & (n < float(1 << 48)) & (n == F.floor(n))
    return fits, [n.try_cast("long") for n in numbers]


@fn("BITAND")
def bitand(a, b) -> Column:
    fits, (a, b) = _bits(a, b)
    return only(fits, a.bitwiseAND(b))


@fn("BITOR")
def bitor(a, b) -> Column:
    fits, (a, b) = _bits(a, b)
    return only(fits, a.bitwiseOR(b))


@fn("BITXOR")
def bitxor(a, b) -> Column:
    fits, (a, b) = _bits(a, b)
    return only(fits, a.bitwiseXOR(b))


@fn("BITLSHIFT")
def bitlshift(a, n) -> Column:
    fits, (a,) = _bits(a)
    return only(fits & (F.abs(whole(n)) <= 53), F.floor(a * F.pow(F.lit(2.0), dbl(n))))


@fn("BITRSHIFT")
def bitrshift(a, n) -> Column:
    return bitlshift(a, -dbl(n))


@fn("ERF", "ERF.PRECISE")
def erf(a, b=None) -> Column:
    """The rational approximation of Abramowitz and Stegun 7.1.26."""
    if b is not None:
        return erf(b) - erf(a)
    x = dbl(a)
    t = 1 / (1 + 0.3275911 * F.abs(x))
    series = F.lit(0.0)
    for c in (1.061405429, -1.453152027, 1.421413741, -0.284496736, 0.254829592):
        series = (series + c) * t
    return F.when(F.abs(x) > 6, F.signum(x)).otherwise(F.signum(x) * (1 - series * F.exp(-x * x)))


@fn("ERFC", "ERFC.PRECISE")
def erfc(x) -> Column:
    return 1 - erf(x)


#: Units as multiples of the base unit of what they measure.
UNITS = {
    "g": 1.0, "sg": 14593.9029372064, "lbm": 453.59237, "u": 1.66053906660e-24, "ozm": 28.349523125, "stone": 6350.29318, "ton": 907184.74,
    "m": 1.0, "mi": 1609.344, "Nmi": 1852.0, "in": 0.0254, "ft": 0.3048, "yd": 0.9144, "ang": 1e-10, "ly": 9.46073047258e15,
    "yr": 31557600.0, "day": 86400.0, "hr": 3600.0, "mn": 60.0, "sec": 1.0, "s": 1.0,
    "Pa": 1.0, "atm": 101325.0, "mmHg": 133.322, "psi": 6894.75729316836,
    "N": 1.0, "dyn": 1e-5, "lbf": 4.4482216152605,
    "J": 1.0, "e": 1e-7, "c": 4.184, "cal": 4.1868, "eV": 1.602176634e-19, "HPh": 2684519.53769617, "Wh": 3600.0, "BTU": 1055.05585262,
    "W": 1.0, "HP": 745.69987158227,
    "T": 1.0, "ga": 1e-4,
    "l": 1.0, "tsp": 0.00492892159375, "tbs": 0.01478676478125, "oz": 0.0295735295625, "cup": 0.2365882365, "pt": 0.473176473, "qt": 0.946352946, "gal": 3.785411784,
    "m2": 1.0, "ft2": 0.09290304, "ha": 10000.0, "us_acre": 4046.87260987425,
    "bit": 1.0, "byte": 8.0,
    "m/s": 1.0, "m/h": 1.0 / 3600.0, "mph": 0.44704, "kn": 1852.0 / 3600.0,
}
#: Metric prefixes, and the units that take them.
PREFIXES = {"Y": 24, "Z": 21, "E": 18, "P": 15, "T": 12, "G": 9, "M": 6, "k": 3, "h": 2, "da": 1, "d": -1, "c": -2, "m": -3, "u": -6, "n": -9, "p": -12, "f": -15, "a": -18, "z": -21, "y": -24}
METRIC = {"g", "u", "m", "ang", "sec", "s", "Pa", "atm", "mmHg", "N", "dyn", "J", "e", "c", "cal", "eV", "Wh", "W", "T", "ga", "l", "bit", "byte"}
TEMPERATURES = {"C", "cel", "F", "fah", "K", "kel"}


def unit_factor(unit: str) -> float | None:
    if unit in UNITS:
        return UNITS[unit]
    for prefix, power in PREFIXES.items():
        if unit.startswith(prefix) and unit[len(prefix) :] in METRIC:
            return UNITS[unit[len(prefix) :]] * 10.0**power
    return None


@fn("CONVERT")
def convert(x, source: str, target: str) -> Column:
    """Unknown units are errors; dimensions are not compared."""
    x = dbl(x)
    if source in TEMPERATURES and target in TEMPERATURES:
        kelvin = {"C": x + 273.15, "F": (x - 32) * 5 / 9 + 273.15, "K": x}[source[0].upper()]
        return {"C": kelvin - 273.15, "F": (kelvin - 273.15) * 9 / 5 + 32, "K": kelvin}[target[0].upper()]
    a, b = unit_factor(source), unit_factor(target)
    return F.lit(None).cast("double") if a is None or b is None else x * a / b


@fn("COMPLEX")
def complex_(real, im, suffix: str = "i") -> Column:
    return shown(dbl(real), dbl(im), suffix) if suffix in ("i", "j") else F.lit(None).cast("string")


def _number(x: Column) -> Column:
    """A double as a worksheet shows it: no point where it is whole."""
    return F.when((x == F.floor(x)) & (F.abs(x) < 1e15), x.cast("decimal(38,0)").cast("string")).otherwise(x.cast("string"))


def shown(real: Column, im: Column, suffix: str = "i") -> Column:
    part = F.concat(F.when(im == 1, "").when(im == -1, "-").otherwise(_number(im)), F.lit(suffix))
    return F.when(im == 0, _number(real)).when(real == 0, part).otherwise(F.concat(_number(real), F.when(im > 0, "+").otherwise(""), part))


#: A complex number's text: its real part, and what stands before the i or j.
_DIGITS = r"\d+\.?\d*(?:[eE][+-]?\d+)?|\.\d+(?:[eE][+-]?\d+)?"
_FORM = re.compile(rf"^\s*(?:([+-]?(?:{_DIGITS}))(?![ij.\d]))?(?:([+-]?(?:{_DIGITS})?)([ij]))?\s*$", re.ASCII)
Parts = tuple[np.ndarray, np.ndarray]


def read_complex(texts: pd.Series) -> Parts:
    """Real and imaginary parts of complex numbers' texts, NaN where there is none; equal texts are read once."""
    codes, known = pd.factorize(texts)
    out = np.full((len(known) + 1, 2), np.nan)  # the last for nulls, which have code -1
    for n, one in enumerate(known):
        m = _FORM.match(one)
        if m and one.strip(" "):
            out[n] = float(m[1] or 0), (float(m[2] + "1" if m[2] in ("", "+", "-") else m[2]) if m[3] else 0.0)
    return out[codes, 0], out[codes, 1]


def per_complex(f: Callable[..., Parts], *texts, numbers: tuple = ()) -> Column:
    """A function of complex numbers' parts, then of numbers, over Arrow batches: a struct of ``re`` and ``im``."""
    count = len(texts)

    @F.pandas_udf("re double, im double")
    def run(*columns: pd.Series) -> pd.DataFrame:
        with np.errstate(all="ignore"):
            x, y = f(*[read_complex(c) for c in columns[:count]], *[c.to_numpy(float) for c in columns[count:]])
        return pd.DataFrame({"re": x, "im": y})

    return run(*[text(v) for v in texts], *[dbl(n) for n in numbers])


def shown_of(f: Callable[..., Parts], *texts, numbers: tuple = ()) -> Column:
    z = per_complex(f, *texts, numbers=numbers)
    return shown(z["re"], z["im"])


def _finite(x: np.ndarray, y: np.ndarray) -> Parts:
    return np.where(np.isfinite(x), x, np.nan), np.where(np.isfinite(y), y, np.nan)


def _divide(a, b, c, d) -> Parts:
    size = c * c + d * d
    size = np.where(size == 0, np.nan, size)
    return (a * c + b * d) / size, (b * c - a * d) / size


def _sin(x, y) -> Parts:
    return np.sin(x) * np.cosh(y), np.cos(x) * np.sinh(y)


def _cos(x, y) -> Parts:
    return np.cos(x) * np.cosh(y), -np.sin(x) * np.sinh(y)


def _sinh(x, y) -> Parts:
    return np.sinh(x) * np.cos(y), np.cosh(x) * np.sin(y)


def _cosh(x, y) -> Parts:
    return np.cosh(x) * np.cos(y), np.sinh(x) * np.sin(y)


def _ln(x, y, base=math.e) -> Parts:
    size = np.hypot(x, y)
    size = np.where(size > 0, size, np.nan)
    return np.log(size) / math.log(base), np.where(size > 0, np.arctan2(y, x) / math.log(base), np.nan)


def _power(x, y, n) -> Parts:
    size, angle = np.power(np.hypot(x, y), n), np.arctan2(y, x) * n
    return size * np.cos(angle), size * np.sin(angle)


for _name, _f in {
    "IMCONJUGATE": lambda x, y: (x, -y),
    "IMEXP": lambda x, y: (np.exp(x) * np.cos(y), np.exp(x) * np.sin(y)),
    "IMLN": _ln,
    "IMLOG2": lambda x, y: _ln(x, y, 2),
    "IMLOG10": lambda x, y: _ln(x, y, 10),
    "IMSQRT": lambda x, y: _power(x, y, 0.5),
    "IMSIN": _sin,
    "IMCOS": _cos,
    "IMTAN": lambda x, y: _divide(*_sin(x, y), *_cos(x, y)),
    "IMCOT": lambda x, y: _divide(*_cos(x, y), *_sin(x, y)),
    "IMSINH": _sinh,
    "IMCOSH": _cosh,
    "IMSEC": lambda x, y: _divide(1.0, 0.0, *_cos(x, y)),
    "IMCSC": lambda x, y: _divide(1.0, 0.0, *_sin(x, y)),
    "IMSECH": lambda x, y: _divide(1.0, 0.0, *_cosh(x, y)),
    "IMCSCH": lambda x, y: _divide(1.0, 0.0, *_sinh(x, y)),
}.items():
    fn(_name)(lambda z, f=_f: shown_of(lambda p: _finite(*f(*p)), z))


@functools.cache
def _reader():
    @F.pandas_udf("re double, im double")
    def run(texts: pd.Series) -> pd.DataFrame:
        x, y = read_complex(texts)
        return pd.DataFrame({"re": x, "im": y})

    return run


def parts(z) -> tuple[Column, Column]:
    """Real and imaginary part of a complex number's text, null where it is none; a text is read once for both."""
    found = _reader()(text(z))
    return found["re"], found["im"]


@fn("IMREAL")
def imreal(z) -> Column:
    return parts(z)[0]


@fn("IMAGINARY")
def imaginary(z) -> Column:
    return parts(z)[1]


@fn("IMABS")
def imabs(z) -> Column:
    return F.hypot(*parts(z))


@fn("IMARGUMENT")
def imargument(z) -> Column:
    x, y = parts(z)
    return only((x != 0) | (y != 0), F.atan2(y, x))


@fn("IMSUM")
def imsum(*values) -> Column:
    return shown_of(lambda *pairs: (sum(x for x, _ in pairs), sum(y for _, y in pairs)), *values)


@fn("IMSUB")
def imsub(a, b) -> Column:
    return shown_of(lambda p, q: (p[0] - q[0], p[1] - q[1]), a, b)


@fn("IMPRODUCT")
def improduct(*values) -> Column:
    def run(*pairs: Parts) -> Parts:
        x, y = pairs[0]
        for a, b in pairs[1:]:
            x, y = x * a - y * b, x * b + y * a
        return x, y

    return shown_of(run, *values)


@fn("IMDIV")
def imdiv(a, b) -> Column:
    return shown_of(lambda p, q: _divide(*p, *q), a, b)


@fn("IMPOWER")
def impower(z, n) -> Column:
    return shown_of(lambda p, n: _finite(*_power(*p, n)), z, numbers=(n,))
