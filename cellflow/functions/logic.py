"""Logical and information functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from cellflow.functions.core import FUNCTIONS, col, dbl, fn, text, whole


@fn("IF")
def if_(condition, then, otherwise=False) -> Column:
    return F.when(col(condition), col(then)).when(col(condition).isNotNull(), col(otherwise))


@fn("IFS")
def ifs(*pairs) -> Column:
    out = F
    for condition, value in zip(pairs[::2], pairs[1::2], strict=True):
        out = out.when(col(condition), col(value))
    return out


@fn("SWITCH")
def switch(x, *cases) -> Column:
    out = F
    for value, result in zip(cases[::2], cases[1::2], strict=False):
        out = out.when(equal(x, value), col(result))
    return out.otherwise(col(cases[-1])) if len(cases) % 2 else out


@fn("IFERROR", "IFNA")
def iferror(x, other) -> Column:
    """For a computed value: its null is an error.  A stored blank is a null too, so don't ask for one here."""
    return F.coalesce(col(x), col(other))


def _filled(conditions, value) -> Column:
    """The value where one of the conditions isn't blank; blank ones don't count."""
    return F.when(F.coalesce(*[col(c) for c in conditions]).isNotNull(), value)


@fn("AND")
def and_(*conditions) -> Column:
    out = F.lit(True)
    for c in conditions:
        out = out & F.coalesce(col(c), F.lit(True))
    return _filled(conditions, out)


@fn("OR")
def or_(*conditions) -> Column:
    out = F.lit(False)
    for c in conditions:
        out = out | F.coalesce(col(c), F.lit(False))
    return _filled(conditions, out)


@fn("NOT")
def not_(x) -> Column:
    return ~col(x)


@fn("XOR")
def xor(*conditions) -> Column:
    out = F.lit(0)
    for c in conditions:
        out = out + F.coalesce(col(c).cast("int"), F.lit(0))
    return _filled(conditions, out % 2 == 1)


@fn("TRUE")
def true() -> Column:
    return F.lit(True)


@fn("FALSE")
def false() -> Column:
    return F.lit(False)


@fn("CHOOSE")
def choose(index, *values) -> Column:
    out = F
    for i, v in enumerate(values, 1):
        out = out.when(whole(index) == i, col(v))
    return out


def equal(a, b) -> Column:
    """Worksheet equality: texts without regard to case."""
    if isinstance(b, str):
        return F.lower(text(a)) == b.lower()
    return col(a) == col(b)


@fn("ISBLANK")
def isblank(x) -> Column:
    return col(x).isNull()


@fn("ISERROR", "ISERR", "ISNA")
def iserror(x) -> Column:
    """For a computed value: null is its error."""
    return col(x).isNull()


def _kind(x) -> Column:
    kind = F.typeof(col(x))
    return F.when(kind == "boolean", "b").when(kind == "string", "t").when(kind.rlike("^(tinyint|smallint|int|bigint|float|double|decimal|date|timestamp)"), "n").when(kind.startswith("array"), "a")


@fn("ISNUMBER")
def isnumber(x) -> Column:
    return (_kind(x) == "n") & col(x).isNotNull()


@fn("ISTEXT")
def istext(x) -> Column:
    return (_kind(x) == "t") & col(x).isNotNull()


@fn("ISNONTEXT")
def isnontext(x) -> Column:
    return ~istext(x)


@fn("ISLOGICAL")
def islogical(x) -> Column:
    return (_kind(x) == "b") & col(x).isNotNull()


@fn("ISREF")
def isref(x) -> Column:
    return F.lit(isinstance(x, Column))


@fn("ISFORMULA")
def isformula(x) -> Column:
    return F.lit(False)


@fn("ISEVEN")
def iseven(x) -> Column:
    return whole(x) % 2 == 0


@fn("ISODD")
def isodd(x) -> Column:
    return whole(x) % 2 != 0


@fn("N")
def n(x) -> Column:
    return F.when(_kind(x) == "t", 0.0).otherwise(F.coalesce(col(x).try_cast("double") if not isinstance(x, bool) else F.lit(float(x)), F.lit(0.0)))


@fn("NA")
def na() -> Column:
    return F.lit(None).cast("double")


@fn("TYPE")
def type_(x) -> Column:
    return F.when(col(x).isNull(), 16).otherwise(F.element_at(F.create_map(*[F.lit(v) for pair in (("n", 1), ("t", 2), ("b", 4), ("a", 64)) for v in pair]), _kind(x)))


#: Numbers of the error values.
ERRORS = {"#NULL!": 1, "#DIV/0!": 2, "#VALUE!": 3, "#REF!": 4, "#NAME?": 5, "#NUM!": 6, "#N/A": 7, "#GETTING_DATA": 8, "#SPILL!": 9, "#CALC!": 14}


@fn("ERROR.TYPE")
def error_type(x) -> Column:
    """The number of an error value given as text."""
    return F.element_at(F.create_map(*[F.lit(v) for pair in ERRORS.items() for v in pair]), text(x))


@fn("ROWS")
def rows(x) -> Column:
    """Of an array of rows, or of cells."""
    return F.size(col(x))


@fn("COLUMNS")
def columns(x) -> Column:
    """Of an array of rows."""
    return F.size(F.try_element_at(col(x), F.lit(1)))


@fn("HYPERLINK")
def hyperlink(link, name=None) -> Column:
    """What the cell shows."""
    return text(link) if name is None else F.coalesce(col(name).cast("string"), text(link))


@fn("DELTA")
def delta(a, b=0) -> Column:
    return (dbl(a) == dbl(b)).cast("int")


@fn("GESTEP")
def gestep(x, step=0) -> Column:
    return (dbl(x) >= dbl(step)).cast("int")


#: Names that are known and always give an error.
ALWAYS_ERRORS = """
ASC BAHTTEXT BESSELI BESSELJ BESSELK BESSELY CALL CUBEKPIMEMBER CUBEMEMBER CUBEMEMBERPROPERTY CUBERANKEDMEMBER CUBESET
CUBESETCOUNT CUBEVALUE DBCS DETECTLANGUAGE ENCODEURL FILTERXML FORECAST.ETS FORECAST.ETS.CONFINT FORECAST.ETS.SEASONALITY
FORECAST.ETS.STAT FORMULATEXT GETPIVOTDATA GROUPBY IMAGE ODDFPRICE ODDFYIELD ODDLPRICE ODDLYIELD PHONETIC PIVOTBY
REGISTER.ID RTD STOCKHISTORY TRANSLATE WEBSERVICE
"""
for _name in ALWAYS_ERRORS.split():
    FUNCTIONS[_name] = lambda *args: F.lit(None).cast("double")
