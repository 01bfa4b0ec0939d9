"""Mathematical and trigonometric functions as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from cellflow.functions.core import dbl, finite, fn, fold, numbers, only, text, whole


def down(x: Column) -> Column:
    """The largest whole number up to x, also beyond what a long holds."""
    return F.when(F.abs(x) >= 2.0**52, x).otherwise(F.floor(x).cast("double"))


def up(x: Column) -> Column:
    return -down(-x)


def _scaled(x, digits, cut) -> Column:
    power = F.pow(F.lit(10.0), dbl(digits))
    x = dbl(x)
    return F.signum(x) * cut(F.abs(x) * power).cast("double") / power


@fn("ROUND")
def round_half_away(x, digits=0) -> Column:
    """Half away from zero, computed on the binary number."""
    return _scaled(x, digits, lambda v: down(v + 0.5))


@fn("ROUNDUP")
def round_up(x, digits=0) -> Column:
    return _scaled(x, digits, up)


@fn("ROUNDDOWN", "TRUNC")
def round_down(x, digits=0) -> Column:
    return _scaled(x, digits, down)


@fn("MROUND")
def mround(x, multiple) -> Column:
    x, m = dbl(x), dbl(multiple)
    return F.when(m == 0, 0.0).when(x * m >= 0, round_half_away(x / F.nullif(m, F.lit(0.0))) * m)


@fn("INT")
def integer(x) -> Column:
    return down(dbl(x)).cast("double")


def _steps(x: Column, step: Column, cut) -> Column:
    return F.when(step == 0, 0.0).otherwise(cut(x / F.nullif(step, F.lit(0.0))).cast("double") * step)


@fn("CEILING.MATH")
def ceiling_math(x, significance=1, mode=0) -> Column:
    x, s = dbl(x), F.abs(dbl(significance))
    return F.when((x < 0) & (dbl(mode) != 0), _steps(x, s, down)).otherwise(_steps(x, s, up))


@fn("FLOOR.MATH")
def floor_math(x, significance=1, mode=0) -> Column:
    x, s = dbl(x), F.abs(dbl(significance))
    return F.when((x < 0) & (dbl(mode) != 0), _steps(x, s, up)).otherwise(_steps(x, s, down))


@fn("CEILING")
def ceiling(x, significance) -> Column:
    x, s = dbl(x), dbl(significance)
    return only(~((x > 0) & (s < 0)), _steps(x, s, up))


@fn("FLOOR")
def floor(x, significance) -> Column:
    x, s = dbl(x), dbl(significance)
    return only((s != 0) & ~((x > 0) & (s < 0)), _steps(x, s, down))


@fn("CEILING.PRECISE", "ISO.CEILING")
def ceiling_precise(x, significance=1) -> Column:
    return _steps(dbl(x), F.abs(dbl(significance)), up)


@fn("FLOOR.PRECISE")
def floor_precise(x, significance=1) -> Column:
    return _steps(dbl(x), F.abs(dbl(significance)), down)


@fn("EVEN")
def even(x) -> Column:
    return F.signum(dbl(x)) * up(F.abs(dbl(x)) / 2).cast("double") * 2


@fn("ODD")
def odd(x) -> Column:
    x = dbl(x)
    return F.when(x == 0, 1.0).otherwise(F.signum(x) * (up((F.abs(x) - 1) / 2).cast("double") * 2 + 1))


@fn("MOD")
def mod(x, divisor) -> Column:
    """Has the divisor's sign."""
    x, d = dbl(x), F.nullif(dbl(divisor), F.lit(0.0))
    return x - d * down(x / d)


@fn("QUOTIENT")
def quotient(x, divisor) -> Column:
    return round_down(dbl(x) / F.nullif(dbl(divisor), F.lit(0.0)))


@fn("POWER")
def power(x, y) -> Column:
    return finite(F.pow(dbl(x), dbl(y)))


@fn("ATAN2")
def atan2(x, y) -> Column:
    """The x coordinate comes first."""
    x, y = dbl(x), dbl(y)
    return only((x != 0) | (y != 0), F.atan2(y, x))


@fn("LOG")
def log(x, base=10) -> Column:
    x, b = dbl(x), dbl(base)
    return only((x > 0) & (b > 0) & (b != 1), F.ln(x) / F.ln(b))


@fn("PI")
def pi() -> Column:
    return F.lit(math.pi)


def _plain(name: str, f, domain=None) -> None:
    def run(x) -> Column:
        x = dbl(x)
        return finite(f(x) if domain is None else F.when(domain(x), f(x)))

    run.__name__ = name.lower()
    fn(name)(run)


for _name, _f, _domain in (
    ("ABS", F.abs, None),
    ("SIGN", F.signum, None),
    ("SQRT", F.sqrt, lambda x: x >= 0),
    ("SQRTPI", lambda x: F.sqrt(x * math.pi), lambda x: x >= 0),
    ("EXP", F.exp, None),
    ("LN", F.ln, lambda x: x > 0),
    ("LOG10", F.log10, lambda x: x > 0),
    ("SIN", F.sin, None),
    ("COS", F.cos, None),
    ("TAN", F.tan, None),
    ("ASIN", F.asin, lambda x: F.abs(x) <= 1),
    ("ACOS", F.acos, lambda x: F.abs(x) <= 1),
    ("ATAN", F.atan, None),
    ("SINH", F.sinh, None),
    ("COSH", F.cosh, None),
    ("TANH", F.tanh, None),
    ("ASINH", F.asinh, None),
    ("ACOSH", F.acosh, lambda x: x >= 1),
    ("ATANH", F.atanh, lambda x: F.abs(x) < 1),
    ("SEC", lambda x: 1 / F.cos(x), None),
    ("CSC", lambda x: 1 / F.nullif(F.sin(x), F.lit(0.0)), None),
    ("COT", lambda x: 1 / F.nullif(F.tan(x), F.lit(0.0)), None),
    ("SECH", lambda x: 1 / F.cosh(x), None),
    ("CSCH", lambda x: 1 / F.nullif(F.sinh(x), F.lit(0.0)), None),
    ("COTH", lambda x: 1 / F.nullif(F.tanh(x), F.lit(0.0)), None),
    ("ACOT", lambda x: math.pi / 2 - F.atan(x), None),
    ("ACOTH", lambda x: 0.5 * F.ln((x + 1) / F.nullif(x - 1, F.lit(0.0))), lambda x: F.abs(x) > 1),
    ("DEGREES", F.degrees, None),
    ("RADIANS", F.radians, None),
):
    _plain(_name, _f, _domain)


@fn("FACT")
def fact(n) -> Column:
    n = whole(n)
    return F.when((n >= 0) & (n < 171), fold(numbers(1, n), 1.0, lambda a, k: a * k))


@fn("FACTDOUBLE")
def factdouble(n) -> Column:
    n = whole(n)
    odd_or_even = F.filter(numbers(1, n), lambda k: (n - k) % 2 == 0)
    return F.when(n >= -1, finite(fold(odd_or_even, 1.0, lambda a, k: a * k)))


@fn("COMBIN")
def combin(n, k) -> Column:
    n, k = whole(n), whole(k)
    return only((k >= 0) & (n >= k), finite(F.round(fold(numbers(1, k), 1.0, lambda a, i: a * (n - k + i) / i))))


@fn("COMBINA")
def combina(n, k) -> Column:
    n, k = whole(n), whole(k)
    return only((n >= 0) & (k >= 0), F.when((n == 0) & (k == 0), 1.0).otherwise(combin(n + k - 1, k)))


@fn("PERMUT")
def permut(n, k) -> Column:
    n, k = whole(n), whole(k)
    return only((k >= 0) & (n >= k), finite(fold(numbers(n - k + 1, n), 1.0, lambda a, i: a * i)))


@fn("PERMUTATIONA")
def permutationa(n, k) -> Column:
    n, k = whole(n), whole(k)
    return only((n >= 0) & (k >= 0), finite(F.pow(n.cast("double"), k.cast("double"))))


def _gcd(a: Column, b: Column) -> Column:
    """By halving a pair; 96 steps of the remainder rule settle any two longs."""
    start = F.struct(a.alias("a"), b.alias("b"))
    end = F.aggregate(F.sequence(F.lit(1), F.lit(96)), start, lambda s, _: F.when(s["b"] == 0, s).otherwise(F.struct(s["b"].alias("a"), (s["a"] % F.nullif(s["b"], F.lit(0).cast("long"))).alias("b"))))
    return end["a"]


@fn("GCD")
def gcd(*values) -> Column:
    out = whole(values[0])
    for v in values[1:]:
        out = _gcd(out, whole(v))
    return only(F.least(*[whole(v) for v in values], F.lit(0)) >= 0, out)


@fn("LCM")
def lcm(*values) -> Column:
    out = whole(values[0])
    for v in values[1:]:
        v = whole(v)
        out = F.when((out == 0) | (v == 0), F.lit(0).cast("long")).otherwise((out / F.nullif(_gcd(out, v), F.lit(0))).cast("long") * v)
    return only(F.least(*[whole(v) for v in values], F.lit(0)) >= 0, out)


@fn("MULTINOMIAL")
def multinomial(*values) -> Column:
    total, out = F.lit(0), F.lit(1.0)
    for v in values:
        total = total + whole(v)
        out = out * combin(total, v)
    return only(F.least(*[whole(v) for v in values], F.lit(0)) >= 0, finite(out))


@fn("RAND")
def rand() -> Column:
    return F.rand()


@fn("RANDBETWEEN")
def randbetween(low, high) -> Column:
    low, high = F.ceil(dbl(low)), F.floor(dbl(high))
    return only(low <= high, F.floor(F.rand() * (high - low + 1)) + low)


@fn("BASE")
def base(n, radix, width=0) -> Column:
    n, shown = whole(n), F.conv(whole(n).cast("string"), 10, radix)
    return only((n >= 0) & F.lit(2 <= radix <= 36), F.when(F.length(shown) < width, F.lpad(shown, width, "0")).otherwise(shown))


@fn("DECIMAL")
def decimal(x, radix) -> Column:
    digits = "0123456789abcdefghijklmnopqrstuvwxyz"[:radix]
    return F.when(F.lower(text(x)).rlike(f"^[{digits}]+$"), F.conv(text(x), radix, 10).cast("double"))


#: Roman numerals from the largest.
ROMANS = [(1000, "M"), (900, "CM"), (500, "D"), (400, "CD"), (100, "C"), (90, "XC"), (50, "L"), (40, "XL"), (10, "X"), (9, "IX"), (5, "V"), (4, "IV"), (1, "I")]


@fn("ROMAN")
def roman(n, form=0) -> Column:
    n = whole(n)
    # every numeral's count follows from what the larger ones left
    rest, parts = n, []
    for value, sign in ROMANS:
        parts.append(F.repeat(F.lit(sign), F.floor(rest / value).cast("int")))
        rest = rest % value
    return only((n >= 0) & (n < 4000), F.concat(*parts))


@fn("ARABIC")
def arabic(x) -> Column:
    values = F.transform(F.split(F.upper(F.trim(text(x))), ""), lambda c: F.coalesce(F.element_at(F.create_map(*[F.lit(v) for value, sign in ROMANS if len(sign) == 1 for v in (sign, value)]), c), F.lit(0)))
    ahead = F.concat(F.slice(values, F.lit(2), F.size(values)), F.array(F.lit(0)))
    signed = F.zip_with(values, ahead, lambda a, b: F.when(a < b, -a).otherwise(a))
    return only(F.upper(F.trim(text(x))).rlike("^[MDCLXVI]*$"), F.aggregate(signed, F.lit(0), lambda a, b: a + b))


@fn("SERIESSUM")
def seriessum(x, n, m, coefficients: list) -> Column:
    out = F.lit(0.0)
    for i, c in enumerate(coefficients):
        out = out + dbl(c) * F.pow(dbl(x), dbl(n) + i * dbl(m))
    return finite(out)
