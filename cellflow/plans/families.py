"""Queries of the worksheet functions by family: each calls its functions over a table, beside SQL that states them in closed form."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from cellflow.functions.core import call
from cellflow.operators.ordinal import dealt, materialised
from cellflow.plans.queries import query, table


class _Row:
    """Columns by attribute, made when they are asked for."""

    def __getattr__(self, name: str) -> Column:
        return F.col(name)


t = _Row()
#: A result's name, its column, and its SQL; numbers are rounded on both sides unless the name ends in ``_``.
Cell = tuple[str, Callable[[], Column], str]
#: Results that are dates; both sides give them as text.
DATES = {"date_", "workday_", "workday_intl_", "coupncd_", "couppcd_"}


def f(name: str, *args) -> Callable[[], Column]:
    """A call put off until a session is there; arguments that are functions of nothing are called then."""
    return lambda: call(name, *[a() if callable(a) else a for a in args])


def c(name: str) -> Callable[[], Column]:
    return lambda: F.col(name)


def family(name: str, source: str, columns: str, cells: list[Cell], places: int = 6, costly: bool = False) -> None:
    """Register one query: ``columns`` are expressions that Spark and DuckDB read alike, the first one the key ``k``; rows of ``costly`` functions are dealt out first."""

    def out(n: str, value: Column) -> Column:
        return value.cast("string") if n in DATES else value if n.endswith("_") else F.round(value.cast("double"), places) + 0.0  # no negative zero

    def run(spark, d):
        rows = table(spark, d, source).selectExpr(*[x.strip() for x in columns.split(";")])
        rows = dealt(rows, "k") if costly else rows
        return rows.select("k", *[out(n, make()).alias(n) for n, make, _ in cells])

    shown = ", ".join(f"CAST(CAST({s} AS DATE) AS VARCHAR) AS {n}" if n in DATES else f"{s} AS {n}" if n.endswith("_") else f"round(CAST({s} AS DOUBLE), {places}) + 0 AS {n}" for n, _, s in cells)
    query(name, f"WITH t AS (SELECT {', '.join(columns.split(';'))} FROM {source}) SELECT k, {shown} FROM t")(run)


def plain(names: str, sql: str, arg: str = "x") -> list[Cell]:
    """Functions of one column whose SQL differs only by name: ``NAME=sql`` pairs, ``?`` standing for the column."""
    out = []
    for pair in names.split(";"):
        own, _, body = pair.strip().partition("=")
        out.append((own.lower().replace(".", "_"), f(own, c(arg)), (body or sql).replace("?", arg)))
    return out


family(
    "fn_trigonometry",
    "part",
    "p_partkey AS k; (p_size - 25.5D) / 30 AS x; 1 + p_size / 10D AS u".replace("25.5D", "CAST(25.5 AS DOUBLE)").replace("10D", "CAST(10 AS DOUBLE)"),
    [
        *plain("ABS=abs(?);SIGN=sign(?);ACOS=acos(?);ASIN=asin(?);ATAN=atan(?);COS=cos(?);TAN=tan(?);RADIANS=radians(?)", ""),
        *plain("ACOT=CASE WHEN ? = 0 THEN pi() / 2 WHEN ? < 0 THEN atan(1 / ?) + pi() ELSE atan(1 / ?) END;ATANH=0.5 * ln((1 + ?) / (1 - ?));ASINH=ln(? + sqrt(? * ? + 1))", ""),
        *plain("COSH=(exp(?) + exp(-?)) / 2;SINH=(exp(?) - exp(-?)) / 2;TANH=(exp(?) - exp(-?)) / (exp(?) + exp(-?));SECH=2 / (exp(?) + exp(-?))", ""),
        *plain("CSC=1 / sin(?);SEC=1 / cos(?);COT=1 / tan(?);CSCH=2 / (exp(?) - exp(-?));COTH=(exp(?) + exp(-?)) / (exp(?) - exp(-?))", ""),
        *plain("ACOSH=ln(? + sqrt(? * ? - 1));ACOTH=0.5 * ln((? + 1) / (? - 1));SQRTPI=sqrt(? * pi());LOG10=log10(?)", "", "u"),
        ("log_two", f("LOG", c("u"), 2), "log2(u)"),
        ("power", f("POWER", c("u"), 2.5), "pow(u, 2.5)"),
        ("pi", f("PI"), "pi()"),
    ],
)

family(
    "fn_ceilings",
    "part",
    "p_partkey AS k; p_retailprice - 1000 AS x; p_size AS n",
    [
        *plain("CEILING.MATH=ceil(?);CEILING.PRECISE=ceil(?);ISO.CEILING=ceil(?);FLOOR.MATH=floor(?);FLOOR.PRECISE=floor(?);TRUNC=trunc(?)", ""),
        *plain("EVEN=sign(?) * ceil(abs(?) / 2) * 2;ODD=CASE WHEN ? = 0 THEN 1 ELSE sign(?) * (ceil((abs(?) + 1) / 2) * 2 - 1) END", ""),
        ("ceiling_five", f("CEILING.MATH", c("x"), 5), "ceil(x / 5) * 5"),
        ("ceiling_away", f("CEILING.MATH", c("x"), 5, 1), "CASE WHEN x < 0 THEN floor(x / 5) ELSE ceil(x / 5) END * 5"),
        ("floor_toward", f("FLOOR.MATH", c("x"), 5, 1), "CASE WHEN x < 0 THEN ceil(x / 5) ELSE floor(x / 5) END * 5"),
        ("floor_", lambda: F.round(call("FLOOR", F.abs(t.x), 5), 6), "round(floor(abs(x) / 5) * 5, 6)"),
        ("quotient", f("QUOTIENT", c("x"), 7), "trunc(x / 7) + 0"),
        ("trunc_two", f("TRUNC", c("x"), 2), "trunc(x * 100) / 100"),
        ("gestep", f("GESTEP", c("x"), 100), "CASE WHEN x >= 100 THEN 1 ELSE 0 END"),
        ("delta", f("DELTA", c("n"), 7), "CASE WHEN n = 7 THEN 1 ELSE 0 END"),
        ("huge_int_", lambda: call("INT", t.x * 1e19) == F.expr("x * 1e19"), "true"),
        ("huge_mod", lambda: call("MOD", F.lit(1e20), 3), "1e20 - 3 * floor(1e20 / 3)"),
        ("huge_round_", lambda: call("ROUND", F.lit(1e17), 3) == F.lit(1e17), "true"),
        ("huge_ceiling_", lambda: call("CEILING", F.lit(1e20), 10) == F.lit(1e20), "true"),
    ],
)

family(
    "fn_combinatorics",
    "part",
    "p_partkey AS k; p_size AS n; CAST(p_partkey % 4 AS INT) AS j",
    [
        ("fact", lambda: F.ln(call("FACT", t.n)), "lgamma(n + 1)"),
        ("factdouble", lambda: call("FACTDOUBLE", t.n % 12), "coalesce(list_product(range(n % 12, 0, -2)::DOUBLE[]), 1)"),
        ("combina", f("COMBINA", c("n"), c("j")), "round(exp(lgamma(n + j) - lgamma(j + 1) - lgamma(n)))"),
        ("permut", f("PERMUT", lambda: t.n + 3, c("j")), "round(exp(lgamma(n + 4) - lgamma(n + 4 - j)))"),
        ("permutationa", f("PERMUTATIONA", c("n"), c("j")), "pow(n, j)"),
        ("multinomial", f("MULTINOMIAL", c("j"), 2, 3), "round(exp(lgamma(j + 6) - lgamma(j + 1) - lgamma(3) - lgamma(4)))"),
        ("seriessum", f("SERIESSUM", lambda: t.n / 50, 1, 2, [1.0, 0.5, 0.25]), "n / 50.0 + 0.5 * pow(n / 50.0, 3) + 0.25 * pow(n / 50.0, 5)"),
    ],
)

_ROMAN = "['', 'M', 'MM', 'MMM'][v // 1000 + 1] || ['', 'C', 'CC', 'CCC', 'CD', 'D', 'DC', 'DCC', 'DCCC', 'CM'][v // 100 % 10 + 1] || ['', 'X', 'XX', 'XXX', 'XL', 'L', 'LX', 'LXX', 'LXXX', 'XC'][v // 10 % 10 + 1] || ['', 'I', 'II', 'III', 'IV', 'V', 'VI', 'VII', 'VIII', 'IX'][v % 10 + 1]"
family(
    "fn_number_bases",
    "part",
    "p_partkey AS k; CAST(p_partkey % 500 AS BIGINT) AS v",
    [
        ("base_", f("BASE", c("v"), 7), "to_base(v, 7)"),
        ("decimal_", lambda: call("DECIMAL", F.conv(t.v, 10, 16), 16).cast("long"), "v"),
        *[(f"{a}2{b}_".lower(), (lambda a=a, b=b, r=r, s=s: call(f"{a}2{b}", t.v if r == 10 else F.conv(t.v, 10, r)).cast("string" if s != 10 else "long")), "v" if s == 10 else f"to_base(v, {s})") for a, r in (("BIN", 2), ("OCT", 8), ("HEX", 16), ("DEC", 10)) for b, s in (("BIN", 2), ("OCT", 8), ("HEX", 16), ("DEC", 10)) if a != b],
        ("bitrshift_", lambda: call("BITRSHIFT", t.v, 2).cast("long"), "v >> 2"),
        ("roman_", f("ROMAN", c("v")), _ROMAN),
        ("arabic_", lambda: call("ARABIC", call("ROMAN", t.v)).cast("long"), "v"),
    ],
)

family(
    "fn_texts",
    "part",
    "p_partkey AS k; p_name AS s; p_brand AS b; p_retailprice AS x; p_size AS n",
    [
        ("char_", lambda: call("CHAR", t.n + 40), "chr(n + 40)"),
        ("unichar_", lambda: call("UNICHAR", t.n + 960), "chr(n + 960)"),
        ("code_", lambda: call("CODE", t.s).cast("int"), "ascii(s)"),
        ("unicode_", lambda: call("UNICODE", F.concat(F.lit("ñ"), t.s)).cast("int"), "241"),
        ("concat_", f("CONCAT", c("s"), "-", c("b")), "s || '-' || b"),
        ("concatenate_", f("CONCATENATE", c("b"), c("s")), "b || s"),
        ("textjoin_", f("TEXTJOIN", "+", True, c("s"), "", c("b")), "s || '+' || b"),
        ("textjoin_blank_", f("TEXTJOIN", "+", False, c("s"), "", c("b")), "s || '++' || b"),
        ("lower_", f("LOWER", c("b")), "lower(b)"),
        ("proper_", f("PROPER", lambda: F.upper(t.s)), "array_to_string(list_transform(string_split(lower(s), ' '), lambda w: upper(w[1]) || w[2:]), ' ')"),
        ("trim_", f("TRIM", lambda: F.concat(F.lit("  "), t.s, F.lit("   "), t.b, F.lit(" "))), "s || ' ' || b"),
        ("clean_", f("CLEAN", lambda: F.concat(t.s, F.lit("\x07\n"), t.b)), "s || b"),
        ("leftb_", f("LEFTB", c("s"), 4), "s[:4]"),
        ("rightb_", f("RIGHTB", c("s"), 3), "right(s, 3)"),
        ("midb_", f("MIDB", c("s"), 2, 3), "substr(s, 2, 3)"),
        ("lenb_", lambda: call("LENB", t.s).cast("int"), "strlen(s)"),
        ("search_", lambda: call("SEARCH", "BRAND#?", t.b).cast("int"), "1"),
        ("searchb_", lambda: call("SEARCHB", "d#", t.b).cast("int"), "strpos(lower(b), 'd#')"),
        ("findb_", lambda: call("FINDB", "#", t.b).cast("int"), "strpos(b, '#')"),
        ("replaceb_", f("REPLACEB", c("s"), 1, 2, "zz"), "'zz' || substr(s, 3)"),
        ("textafter_", f("TEXTAFTER", c("b"), "#"), "substr(b, strpos(b, '#') + 1)"),
        ("textsplit_", lambda: F.concat_ws("|", call("TEXTSPLIT", t.b, "#")), "replace(b, '#', '|')"),
        ("t_", f("T", c("s")), "s"),
        ("text_", f("TEXT", c("x"), "0.00"), "printf('%.2f', round(x, 2))"),
        ("valuetotext_", f("VALUETOTEXT", c("s"), 1), "'\"' || s || '\"'"),
        ("arraytotext_", lambda: call("ARRAYTOTEXT", F.array(t.s, t.b)), "s || ', ' || b"),
        ("numbervalue", lambda: call("NUMBERVALUE", F.concat(F.lit("1.2"), t.n.cast("string"), F.lit(",5")), ",", "."), "CAST('12' || n AS DOUBLE) + 0.5"),
        ("dollar_", f("DOLLAR", c("x"), 2), "'$' || format('{:,.2f}', round(x, 2))"),
    ],
)

family(
    "fn_logic",
    "part",
    "p_partkey AS k; p_size AS n; CASE WHEN p_size % 3 = 0 THEN NULL ELSE p_size % 2 = 0 END AS a; p_size > 25 AS b; CASE WHEN p_size % 5 = 0 THEN NULL ELSE p_size END AS m; p_name AS s",
    [
        ("if_", f("IF", c("b"), "high", "low"), "CASE WHEN b THEN 'high' ELSE 'low' END"),
        ("and_", f("AND", c("a"), c("b")), "coalesce(a, true) AND b"),
        ("or_", f("OR", c("a"), c("b")), "coalesce(a, false) OR b"),
        ("xor_", f("XOR", c("a"), c("b")), "coalesce(a, false) <> b"),
        ("not_", f("NOT", c("b")), "NOT b"),
        ("true_", f("TRUE"), "true"),
        ("false_", f("FALSE"), "false"),
        ("iferror_", f("IFERROR", c("m"), -1), "coalesce(m, -1)"),
        ("ifna_", f("IFNA", c("m"), -2), "coalesce(m, -2)"),
        ("iserror_", f("ISERROR", c("m")), "m IS NULL"),
        ("iserr_", f("ISERR", c("m")), "m IS NULL"),
        ("isna_", f("ISNA", c("m")), "m IS NULL"),
        ("islogical_", f("ISLOGICAL", c("b")), "true"),
        ("isnontext_", f("ISNONTEXT", c("n")), "true"),
        ("isref_", f("ISREF", c("n")), "true"),
        ("isformula_", f("ISFORMULA", c("n")), "false"),
        ("choose_", lambda: call("CHOOSE", t.n % 3 + 1, "a", "b", "c"), "['a', 'b', 'c'][n % 3 + 1]"),
        ("n", f("N", c("b")), "CASE WHEN b THEN 1 ELSE 0 END"),
        ("type_", lambda: call("TYPE", t.s).cast("int"), "2"),
        ("error_type_", lambda: call("ERROR.TYPE", "#N/A").cast("int"), "7"),
        ("na_", lambda: call("NA").isNull(), "true"),
        ("rand_", lambda: call("RAND").between(0, 1), "true"),
        ("randbetween_", lambda: call("RANDBETWEEN", 3, 9).between(3, 9), "true"),
        ("now_", lambda: call("NOW").isNotNull(), "true"),
        ("today_", lambda: call("TODAY").isNotNull(), "true"),
    ],
)

_AHEAD = "list_filter(list_transform(range(1, 90), lambda i: d + i::INT), lambda x: {})[n]"
family(
    "fn_calendar",
    "orders",
    "o_orderkey AS k; CAST(o_orderdate AS DATE) AS d; CAST(o_orderkey % 20 + 1 AS INT) AS n",
    [
        ("date_", lambda: call("DATE", F.year("d"), F.month("d"), F.dayofmonth("d") + 40), "d + 40"),
        ("datevalue_", lambda: call("DATEVALUE", F.date_format("d", "yyyy-MM-dd")).cast("int"), "date_diff('day', DATE '1899-12-30', d)"),
        ("day_", lambda: call("DAY", t.d).cast("int"), "day(d)"),
        ("days_", lambda: call("DAYS", F.date_add(t.d, t.n), t.d).cast("int"), "n"),
        ("days360_", lambda: call("DAYS360", t.d, F.date_add(t.d, 100), True).cast("int"), "360 * (year(d + 100) - year(d)) + 30 * (month(d + 100) - month(d)) + least(day(d + 100), 30) - least(day(d), 30)"),
        ("weeknum_", lambda: call("WEEKNUM", t.d, 21).cast("int"), "weekofyear(d)"),
        ("weeknum_sunday_", lambda: call("WEEKNUM", t.d).cast("int"), "(dayofyear(d) + dayofweek(date_trunc('year', d)::DATE) - 1) // 7 + 1"),
        ("workday_", f("WORKDAY", c("d"), c("n")), _AHEAD.format("isodow(x) < 6")),
        ("workday_intl_", f("WORKDAY.INTL", c("d"), c("n"), 7), _AHEAD.format("isodow(x) NOT IN (5, 6)")),
        ("networkdays_intl_", lambda: call("NETWORKDAYS.INTL", t.d, F.date_add(t.d, 30), 11).cast("int"), "len(list_filter(range(0, 31), lambda i: isodow(d + i::INT) <> 7))"),
        ("time", lambda: call("TIME", t.n, 30, 15), "n / 24.0 + 30 / 1440.0 + 15 / 86400.0 - CASE WHEN n >= 24 THEN 1 ELSE 0 END"),
        ("timevalue", lambda: call("TIMEVALUE", F.format_string("%d:45:30", t.n)), "n / 24.0 + 45 / 1440.0 + 30 / 86400.0"),
    ],
)
family(
    "fn_clock",
    "events",
    "event_id AS k; ts AS m",
    [(f"{x.lower()}_", (lambda x=x: call(x, t.m).cast("int")), f"{x.lower()}(m)") for x in ("HOUR", "MINUTE", "SECOND")],
)

_BALANCE = "(v * pow(1 + r, {0}) - p * (pow(1 + r, {0}) - 1) / r)"
family(
    "fn_loans",
    "customer",
    "c_custkey AS k; abs(c_acctbal) * 1.00123457 + 1000 AS v; CAST(c_custkey % 9 + 3 AS INT) AS n; (c_custkey % 7 + 2) / CAST(400 AS DOUBLE) AS r; (abs(c_acctbal) * 1.00123457 + 1000) * ((c_custkey % 7 + 2) / CAST(400 AS DOUBLE)) / (1 - pow(1 + (c_custkey % 7 + 2) / CAST(400 AS DOUBLE), -(c_custkey % 9 + 3))) AS p",
    [
        ("effect", f("EFFECT", c("r"), 4), "pow(1 + r / 4, 4) - 1"),
        ("nominal", f("NOMINAL", c("r"), 4), "4 * (pow(1 + r, 0.25) - 1)"),
        ("rri", f("RRI", c("n"), c("v"), lambda: t.v * 2), "pow(2, 1.0 / n) - 1"),
        ("pduration", f("PDURATION", c("r"), c("v"), lambda: t.v * 2), "ln(2) / ln(1 + r)"),
        ("nper", f("NPER", c("r"), lambda: -t.p, c("v")), "n"),
        ("rate", f("RATE", c("n"), lambda: -t.p, c("v")), "r"),
        ("pv", f("PV", c("r"), c("n"), lambda: -t.p), "v"),
        ("ppmt", f("PPMT", c("r"), 2, c("n"), c("v")), "-p - r * " + _BALANCE.format("1")),
        ("cumprinc", f("CUMPRINC", c("r"), c("n"), c("v"), 1, 3, 0), "list_sum(list_transform(range(0, 3), lambda i: -p - r * " + _BALANCE.format("i") + "))"),
        ("cumipmt", f("CUMIPMT", c("r"), c("n"), c("v"), 1, 3, 0), "list_sum(list_transform(range(0, 3), lambda i: r * " + _BALANCE.format("i") + "))"),
        ("ispmt", f("ISPMT", c("r"), 1, c("n"), c("v")), "-v * r * (1 - 1.0 / n)"),
        ("npv", f("NPV", c("r"), c("v"), c("p")), "v / (1 + r) + p / pow(1 + r, 2)"),
        ("fvschedule", lambda: call("FVSCHEDULE", t.v, F.array(t.r, t.r * 2)), "v * (1 + r) * (1 + 2 * r)"),
        ("dollarde", f("DOLLARDE", lambda: F.floor(t.v) + F.lit(0.05), 16), "floor(v) + 5 / 16.0"),
        ("dollarfr", f("DOLLARFR", lambda: F.floor(t.v) + F.lit(0.25), 16), "floor(v) + 0.04"),
        ("syd", f("SYD", c("v"), lambda: t.v / 10, c("n"), 2), "0.9 * v * (n - 1) * 2 / (n * (n + 1.0))"),
        ("ddb", f("DDB", c("v"), 0, c("n"), 2), "v * pow(1 - 2.0 / n, 1) * 2.0 / n"),
        ("db", f("DB", c("v"), lambda: t.v / 10, c("n"), 2), "v * (1 - round(1 - pow(0.1, 1.0 / n), 3)) * round(1 - pow(0.1, 1.0 / n), 3)"),
        ("vdb", f("VDB", c("v"), 0, c("n"), 0, 2, 2, True), "v * (1 - pow(1 - 2.0 / n, 2))"),
    ],
    4,
)

#: Days are counted as they are, years as 360 days.
_YEARS = "(date_diff('day', s, e) / CAST(360 AS DOUBLE))"
_BACK = "list_filter(list_transform(range(0, 60), lambda i: (e - to_months(6 * i::INT))::DATE), lambda x: x {} s)"
_BOND = {"pcd": _BACK.format("<=") + "[1]", "ncd": _BACK.format(">") + "[-1]", "num": f"len({_BACK.format('>')})"}
#: ... but days of a coupon period by months of 30 days.
_GONE = f"(360 * (year(s) - year({_BOND['pcd']})) + 30 * (month(s) - month({_BOND['pcd']})) + day(s) - day({_BOND['pcd']}))"
_ISSUED = "(date_diff('day', (s - to_months(6))::DATE, s) / CAST(360 AS DOUBLE))"
_WHEN = f"(i - {_GONE} / 180.0)"
_DIRTY = f"(100 / pow(1.03, ({_BOND['num']} - {_GONE} / 180.0)) + list_sum(list_transform(range(1, {_BOND['num']} + 1), lambda i: 2.5 / pow(1.03, {_WHEN}))))"
_PRICE = f"({_DIRTY} - 2.5 * {_GONE} / 180.0)"
_DURATION = f"(({_BOND['num']} - {_GONE} / 180.0) * 100 / pow(1.03, ({_BOND['num']} - {_GONE} / 180.0)) + list_sum(list_transform(range(1, {_BOND['num']} + 1), lambda i: {_WHEN} * 2.5 / pow(1.03, {_WHEN})))) / {_DIRTY} / 2"
family(
    "fn_bonds",
    "supplier",
    "s_suppkey AS k; make_date(CAST(2020 + s_suppkey % 3 AS INT), CAST(s_suppkey % 12 + 1 AS INT), CAST(s_suppkey % 27 + 1 AS INT)) AS s; make_date(CAST(2026 + s_suppkey % 4 AS INT), CAST(s_suppkey % 5 + 3 AS INT), 15) AS e",
    [
        ("couppcd_", f("COUPPCD", c("s"), c("e"), 2), _BOND["pcd"]),
        ("coupncd_", f("COUPNCD", c("s"), c("e"), 2), _BOND["ncd"]),
        ("coupnum_", lambda: call("COUPNUM", t.s, t.e, 2).cast("int"), _BOND["num"]),
        ("coupdaybs", f("COUPDAYBS", c("s"), c("e"), 2), _GONE),
        ("coupdays", f("COUPDAYS", c("s"), c("e"), 2), "180"),
        ("coupdaysnc", f("COUPDAYSNC", c("s"), c("e"), 2), f"180 - {_GONE}"),
        ("price", f("PRICE", c("s"), c("e"), 0.05, 0.06, 100, 2), _PRICE),
        ("yield", lambda: call("YIELD", t.s, t.e, 0.05, call("PRICE", t.s, t.e, 0.05, 0.06, 100, 2), 100, 2), "0.06"),
        ("duration", f("DURATION", c("s"), c("e"), 0.05, 0.06, 2), _DURATION),
        ("mduration", f("MDURATION", c("s"), c("e"), 0.05, 0.06, 2), f"{_DURATION} / 1.03"),
        ("pricedisc", f("PRICEDISC", c("s"), c("e"), 0.05, 100), f"100 - 5 * {_YEARS}"),
        ("yielddisc", f("YIELDDISC", c("s"), c("e"), 80, 100), f"0.25 / {_YEARS}"),
        ("intrate", f("INTRATE", c("s"), c("e"), 1000, 1200), f"0.2 / {_YEARS}"),
        ("received", f("RECEIVED", c("s"), c("e"), 1000, 0.05), f"1000 / (1 - 0.05 * {_YEARS})"),
        ("accrintm", f("ACCRINTM", c("s"), c("e"), 0.05, 1000), f"50 * {_YEARS}"),
        ("yieldmat", lambda: call("YIELDMAT", t.s, t.e, F.add_months(t.s, -6), 0.05, call("PRICEMAT", t.s, t.e, F.add_months(t.s, -6), 0.05, 0.06)), "0.06"),
        ("pricemat", lambda: call("PRICEMAT", t.s, t.e, F.add_months(t.s, -6), 0.05, 0.06), f"(100 + 5 * ({_YEARS} + {_ISSUED})) / (1 + 0.06 * {_YEARS}) - 5 * {_ISSUED}"),
        ("tbilleq", lambda: call("TBILLEQ", t.s, F.date_add(t.s, 91), 0.04), "365 * 0.04 / (360 - 0.04 * 91)"),
        ("tbillyield", lambda: call("TBILLYIELD", t.s, F.date_add(t.s, 91), 98.5), "(100 - 98.5) / 98.5 * 360 / 91"),
        ("euroconvert", f("EUROCONVERT", lambda: t.k * 10.0, "DEM", "EUR"), "k * 10 / 1.95583"),
    ],
    4,
)

#: The rational approximation of Abramowitz and Stegun 7.1.26, which the functions follow.
_SERIES = "((((1.061405429 * {w} - 1.453152027) * {w} + 1.421413741) * {w} - 0.284496736) * {w} + 0.254829592) * {w}"
_ERF = f"(sign({{0}}) * (1 - {_SERIES.format(w='(1 / (1 + 0.3275911 * abs({0})))')} * exp(-{{0}} * {{0}})))"
_NORM = f"(0.5 * (1 + {_ERF.format('(z / sqrt(2))')}))"
_BINOM = "exp(lgamma(13) - lgamma({0} + 1) - lgamma(13 - {0}) + {0} * ln(p) + (12 - {0}) * ln(1 - p))"
family(
    "fn_normal_family",  # inverses are approximations, right to a thousandth
    "part",
    "p_partkey AS k; (p_size - 25) / CAST(10 AS DOUBLE) AS z; p_size / CAST(51 AS DOUBLE) AS p; p_size / CAST(10 AS DOUBLE) AS x",
    [
        ("erf", f("ERF", c("z")), _ERF.format("z")),
        ("erf_precise", f("ERF.PRECISE", c("z")), _ERF.format("z")),
        ("erf_between", f("ERF", 0, c("z")), _ERF.format("z")),
        ("erfc", f("ERFC", c("z")), f"1 - {_ERF.format('z')}"),
        ("erfc_precise", f("ERFC.PRECISE", c("z")), f"1 - {_ERF.format('z')}"),
        ("norm_s_dist", f("NORM.S.DIST", c("z"), True), _NORM),
        ("normsdist", f("NORMSDIST", c("z")), _NORM),
        ("normdist", f("NORMDIST", lambda: 5 + 2 * t.z, 5, 2, True), _NORM),
        ("norm_s_inv_", lambda: F.abs(call("NORM.S.INV", call("NORM.S.DIST", t.z, True)) - t.z) < 1e-3, "true"),
        ("normsinv_", lambda: F.abs(call("NORMSINV", call("NORMSDIST", t.z)) - t.z) < 1e-3, "true"),
        ("norm_inv_", lambda: F.abs(call("NORM.INV", call("NORM.S.DIST", t.z, True), 5, 2) - (5 + 2 * t.z)) < 1e-3, "true"),
        ("norminv_", lambda: F.abs(call("NORMINV", call("NORM.S.DIST", t.z, True), 5, 2) - (5 + 2 * t.z)) < 1e-3, "true"),
        ("gauss", f("GAUSS", c("z")), f"{_NORM} - 0.5"),
        ("phi", f("PHI", c("z")), "exp(-z * z / 2) / sqrt(2 * pi())"),
        ("lognorm_dist", lambda: call("LOGNORM.DIST", F.exp(t.z), 0, 1, True), _NORM),
        ("lognormdist", lambda: call("LOGNORMDIST", F.exp(t.z), 0, 1), _NORM),
        ("lognorm_inv_", lambda: F.abs(F.ln(call("LOGNORM.INV", call("NORM.S.DIST", t.z, True), 0, 1)) - t.z) < 1e-3, "true"),
        ("loginv_", lambda: F.abs(F.ln(call("LOGINV", call("NORM.S.DIST", t.z, True), 0, 1)) - t.z) < 1e-3, "true"),
        ("confidence_", lambda: F.abs(call("CONFIDENCE", 0.05, t.x, 16) - (1.959963984540054 * t.x / 4)) < 1e-3, "true"),
        ("confidence_norm_", lambda: F.abs(call("CONFIDENCE.NORM", 0.05, t.x, 16) - (1.959963984540054 * t.x / 4)) < 1e-3, "true"),
        ("standardize", f("STANDARDIZE", c("x"), 2, 3), "(x - 2) / 3"),
        ("fisher", f("FISHER", lambda: t.p), "0.5 * ln((1 + p) / (1 - p))"),
        ("fisherinv", f("FISHERINV", c("z")), "(exp(2 * z) - 1) / (exp(2 * z) + 1)"),
        ("poisson_dist", f("POISSON.DIST", 3, c("x"), True), "exp(-x) * (1 + x + x * x / 2 + x * x * x / 6)"),
        ("poisson", f("POISSON", 3, c("x"), False), "exp(-x) * x * x * x / 6"),
        ("expondist", f("EXPONDIST", c("x"), 0.5, True), "1 - exp(-x / 2)"),
        ("weibull", f("WEIBULL", c("x"), 2, 3, True), "1 - exp(-pow(x / 3, 2))"),
    ],
)
family(
    "fn_gamma_family",
    "part",
    "p_partkey AS k; p_size / CAST(51 AS DOUBLE) AS p; p_size / CAST(10 AS DOUBLE) AS x; CAST(p_size % 10 AS INT) AS j",
    [
        ("gamma", f("GAMMA", c("x")), "gamma(x)"),
        ("gammaln", f("GAMMALN", c("x")), "lgamma(x)"),
        ("gammaln_precise", f("GAMMALN.PRECISE", c("x")), "lgamma(x)"),
        ("gammadist", f("GAMMADIST", c("x"), 2, 3, True), "1 - exp(-x / 3) * (1 + x / 3)"),
        ("gamma_inv", f("GAMMA.INV", c("p"), 1, 3), "-3 * ln(1 - p)"),
        ("gammainv", f("GAMMAINV", c("p"), 1, 3), "-3 * ln(1 - p)"),
        ("chisq_dist", f("CHISQ.DIST", c("x"), 4, True), "1 - exp(-x / 2) * (1 + x / 2)"),
        ("chidist", f("CHIDIST", c("x"), 4), "exp(-x / 2) * (1 + x / 2)"),
        ("chisq_inv", f("CHISQ.INV", c("p"), 2), "-2 * ln(1 - p)"),
        ("chisq_inv_rt", f("CHISQ.INV.RT", c("p"), 2), "-2 * ln(p)"),
        ("chiinv", f("CHIINV", c("p"), 2), "-2 * ln(p)"),
        ("beta_dist", f("BETA.DIST", c("p"), 2, 3, True), "1 - pow(1 - p, 4) - 4 * p * pow(1 - p, 3)"),
        ("betadist", f("BETADIST", c("p"), 2, 3), "1 - pow(1 - p, 4) - 4 * p * pow(1 - p, 3)"),
        ("beta_inv", f("BETA.INV", c("p"), 1, 3), "1 - pow(1 - p, 1 / 3.0)"),
        ("betainv", f("BETAINV", c("p"), 1, 3), "1 - pow(1 - p, 1 / 3.0)"),
        ("f_dist", f("F.DIST", c("x"), 2, 4, True), "1 - pow(1 + x / 2, -2)"),
        ("f_dist_rt", f("F.DIST.RT", c("x"), 2, 4), "pow(1 + x / 2, -2)"),
        ("fdist", f("FDIST", c("x"), 2, 4), "pow(1 + x / 2, -2)"),
        ("f_inv", f("F.INV", c("p"), 2, 4), "2 * (pow(1 - p, -0.5) - 1)"),
        ("f_inv_rt", f("F.INV.RT", c("p"), 2, 4), "2 * (pow(p, -0.5) - 1)"),
        ("finv", f("FINV", c("p"), 2, 4), "2 * (pow(p, -0.5) - 1)"),
        ("t_dist_rt", f("T.DIST.RT", c("x"), 2), "0.5 - x / (2 * sqrt(2 + x * x))"),
        ("t_dist_2t", f("T.DIST.2T", c("x"), 2), "1 - x / sqrt(2 + x * x)"),
        ("tdist", f("TDIST", c("x"), 2, 2), "1 - x / sqrt(2 + x * x)"),
        ("t_inv", f("T.INV", c("p"), 2), "(2 * p - 1) * sqrt(2 / (1 - pow(2 * p - 1, 2)))"),
        ("tinv", f("TINV", c("p"), 2), "(1 - p) * sqrt(2 / (1 - pow(1 - p, 2)))"),
        ("confidence_t", lambda: call("CONFIDENCE.T", 0.1, t.x, 3), "0.9 * sqrt(2 / (1 - 0.81)) * x / sqrt(3)"),
        ("binomdist", lambda: call("BINOMDIST", t.j, 12, t.p, False), _BINOM.format("j")),
        ("binom_dist_range", lambda: call("BINOM.DIST.RANGE", 12, t.p, 2, 5), "list_sum(list_transform(range(2, 6), lambda i: " + _BINOM.format("i") + "))"),
        ("binom_inv", lambda: call("BINOM.INV", 12, t.p, 0.4), "list_filter(range(0, 13), lambda m: list_sum(list_transform(range(0, m + 1), lambda i: " + _BINOM.format("i") + ")) >= 0.4)[1]"),
        ("critbinom", lambda: call("CRITBINOM", 12, t.p, 0.6), "list_filter(range(0, 13), lambda m: list_sum(list_transform(range(0, m + 1), lambda i: " + _BINOM.format("i") + ")) >= 0.6)[1]"),
        ("negbinomdist", lambda: call("NEGBINOMDIST", t.j, 3, t.p), "(j + 2) * (j + 1) / 2.0 * pow(p, 3) * pow(1 - p, j)"),
        ("negbinom_dist", lambda: call("NEGBINOM.DIST", t.j, 1, t.p, True), "1 - pow(1 - p, j + 1)"),
        ("hypgeomdist", lambda: call("HYPGEOMDIST", 1, 4, t.j + 1, 20), "(j + 1) * exp(lgamma(20 - j) - lgamma(4) - lgamma(17 - j) - lgamma(21) + lgamma(5) + lgamma(17))"),
        ("hypgeom_dist", lambda: call("HYPGEOM.DIST", 0, 4, t.j + 1, 20, True), "exp(lgamma(20 - j) - lgamma(16 - j) - lgamma(21) + lgamma(17))"),
    ],
    costly=True,
)

_POLAR = {"r": "sqrt(a * a + b * b)", "g": "atan2(b, a)"}
_COMPLEX = {
    "IMSUM": ("a + 2", "b - 1", ("2-i",)), "IMSUB": ("a - 2", "b + 1", ("2-i",)), "IMPRODUCT": ("2 * a + b", "2 * b - a", ("2-i",)), "IMDIV": ("(2 * a - b) / 5", "(2 * b + a) / 5", ("2-i",)),
    "IMCONJUGATE": ("a", "-b", ()), "IMEXP": ("exp(a) * cos(b)", "exp(a) * sin(b)", ()), "IMLN": ("ln({r})", "{g}", ()), "IMLOG10": ("log10({r})", "{g} / ln(10)", ()), "IMLOG2": ("log2({r})", "{g} / ln(2)", ()),
    "IMSQRT": ("sqrt({r}) * cos({g} / 2)", "sqrt({r}) * sin({g} / 2)", ()), "IMPOWER": ("pow({r}, 3) * cos(3 * {g})", "pow({r}, 3) * sin(3 * {g})", (3,)),
    "IMSIN": ("sin(a) * (exp(b) + exp(-b)) / 2", "cos(a) * (exp(b) - exp(-b)) / 2", ()), "IMCOS": ("cos(a) * (exp(b) + exp(-b)) / 2", "-sin(a) * (exp(b) - exp(-b)) / 2", ()),
    "IMSINH": ("cos(b) * (exp(a) - exp(-a)) / 2", "sin(b) * (exp(a) + exp(-a)) / 2", ()), "IMCOSH": ("cos(b) * (exp(a) + exp(-a)) / 2", "sin(b) * (exp(a) - exp(-a)) / 2", ()),
}
_TWO = "(cos(2 * a) + (exp(2 * b) + exp(-2 * b)) / 2)"
_COMPLEX["IMTAN"] = (f"sin(2 * a) / {_TWO}", f"(exp(2 * b) - exp(-2 * b)) / 2 / {_TWO}", ())
for _name, _of in (("IMSEC", "IMCOS"), ("IMCSC", "IMSIN"), ("IMSECH", "IMCOSH"), ("IMCSCH", "IMSINH"), ("IMCOT", "IMTAN")):
    _x, _y, _ = _COMPLEX[_of]
    _COMPLEX[_name] = (f"({_x}) / (pow({_x}, 2) + pow({_y}, 2))", f"-({_y}) / (pow({_x}, 2) + pow({_y}, 2))", ())
_PARTS = [(name.lower(), part, take, sql.format(**_POLAR)) for name, (re, im, _) in _COMPLEX.items() for part, take, sql in (("re", "IMREAL", re), ("im", "IMAGINARY", im))]


@query(
    "fn_complex",
    "WITH t AS (SELECT p_partkey AS k, p_size / CAST(17 AS DOUBLE) AS a, (p_partkey % 8 + 1) / CAST(7 AS DOUBLE) AS b FROM part) SELECT k, "
    + ", ".join(f"round({sql}, 4) AS {name}_{part}" for name, part, _, sql in _PARTS)
    + " FROM t",
)
def fn_complex(spark, d):
    rows = dealt(table(spark, d, "part").select("p_partkey", "p_size"), "p_partkey").select(F.col("p_partkey").alias("k"), call("COMPLEX", F.col("p_size") / 17, (F.col("p_partkey") % 8 + 1) / 7).alias("z"))
    values = materialised(rows.select("k", *[call(name, t.z, *more).alias(name.lower()) for name, (_, _, more) in _COMPLEX.items()]))
    return values.select("k", *[F.round(call(take, F.col(name)), 4).alias(f"{name}_{part}") for name, part, take, _ in _PARTS])


family(
    "fn_matrices",
    "part",
    "p_partkey AS k; p_size AS a; CAST(p_partkey % 7 + 1 AS INT) AS b",
    [
        ("mdeterm", lambda: call("MDETERM", F.array(F.array(t.a.cast("double"), F.lit(2.0)), F.array(F.lit(3.0), t.b.cast("double")))), "a * b - 6"),
        ("minverse", lambda: call("MINVERSE", F.array(F.array(t.a.cast("double"), F.lit(1.0)), F.array(F.lit(0.0), t.b.cast("double"))))[0][1], "-1.0 / (a * b)"),
        ("munit", lambda: call("MUNIT", 3)[1][1], "1"),
    ],
)
