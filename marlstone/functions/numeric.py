"""Exact numbers. DECIMAL where 38 digits do; beyond that, text of any length through Python's integers and decimals."""

from __future__ import annotations

import math
from collections.abc import Callable
from decimal import ROUND_CEILING, ROUND_DOWN, ROUND_FLOOR, ROUND_HALF_EVEN, ROUND_HALF_UP, ROUND_UP, Context, Decimal, InvalidOperation, localcontext

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# The rounding rules by name.
RULES = {"up": ROUND_CEILING, "down": ROUND_FLOOR, "toward_zero": ROUND_DOWN, "away_from_zero": ROUND_UP, "nearest_or_away": ROUND_HALF_UP, "nearest_or_even": ROUND_HALF_EVEN}
EXTRA_DIGITS = 10


# -- expressions over DECIMAL -----------------------------------------------------------------


def rounded(value: Column, places: int = 0, rule: str = "nearest_or_even") -> Column:
    """A DECIMAL to places by one of the six rules."""
    half_up, up, down = F.round(value, places), F.ceil(value, F.lit(places)), F.floor(value, F.lit(places))
    return {"nearest_or_away": half_up, "nearest_or_even": F.bround(value, places), "up": up, "down": down, "toward_zero": F.when(value < 0, up).otherwise(down), "away_from_zero": F.when(value < 0, down).otherwise(up)}[rule]


def truncating_remainder(a: Column, b: Column) -> Column:
    return F.when(b != 0, a % F.nullif(b, F.lit(0)))


def nearest_remainder(a: Column, b: Column) -> Column:
    """a less the multiple of b nearest to it, the even one of two: the IEEE remainder."""
    b = F.nullif(b, F.lit(0))
    r = a % b
    twice, size = F.abs(r) * 2, F.abs(b)
    odd = F.abs(F.try_divide(a - r, b).cast("decimal(38,0)")) % 2 == 1
    away = (twice > size) | (twice == size) & odd
    return F.when(away, r - size * F.signum(r).cast("int")).otherwise(r)


def is_multiple(a: Column, b: Column) -> Column:
    """Whether a is a whole multiple of b; of 0, only 0 is."""
    return F.when(b == 0, a == 0).otherwise(a % F.nullif(b, F.lit(0)) == 0)


def is_integer(value: Column) -> Column:
    return value == F.floor(value)


def gcd(a: Column, b: Column) -> Column:
    """Greatest common divisor of two BIGINTs, by Euclid's steps as a fold; 92 steps do for any."""
    start = F.struct(F.abs(a).cast("bigint").alias("x"), F.abs(b).cast("bigint").alias("y"))
    step = lambda s, _: F.struct(F.when(s["y"] == 0, s["x"]).otherwise(s["y"]).alias("x"), F.when(s["y"] == 0, s["y"]).otherwise(s["x"] % F.when(s["y"] == 0, F.lit(1)).otherwise(s["y"])).alias("y"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(92)), start, step)["x"]


def lcm(a: Column, b: Column) -> Column:
    return F.when((a == 0) | (b == 0), F.lit(0).cast("bigint")).otherwise(F.abs(a) * F.floor(F.abs(b) / F.nullif(gcd(a, b), F.lit(0))).cast("bigint"))


def bit_width(value: Column) -> Column:
    """Bits of a non-negative BIGINT without leading zeros; 0 has none."""
    return F.when(value == 0, 0).otherwise(F.length(F.bin(value)))


def leading_zeros(value: Column) -> Column:
    return 64 - bit_width(value)


def trailing_zeros(value: Column) -> Column:
    return F.when(value == 0, 64).otherwise(F.length(F.bin(value)) - F.length(F.rtrim(F.bin(value), F.lit("0"))))


def digit_count(value: Column) -> Column:
    return F.length(F.abs(value).cast("decimal(38,0)").cast("string"))


def shift_left(value: Column, n: int) -> Column:
    return value if n <= 0 else F.shiftleft(value, n)


def shift_right(value: Column, n: int) -> Column:
    return value if n <= 0 else F.shiftright(value, n)


def clamped(value: Column, bits: int, signed: bool = True) -> Column:
    """The nearest value that fits."""
    low, high = (-(2 ** (bits - 1)), 2 ** (bits - 1) - 1) if signed else (0, 2**bits - 1)
    kind = "decimal(38,0)"
    return F.greatest(F.lit(Decimal(low)).cast(kind), F.least(F.lit(Decimal(high)).cast(kind), value.cast(kind)))


def exactly(value: Column, kind: str) -> Column:
    """The value as another type, or null if that changes it."""
    out = value.try_cast(kind)
    back = out.try_cast("decimal(38,18)")
    return F.when(back == value.try_cast("decimal(38,18)"), out)


def parse_decimal(text: Column, kind: str = "decimal(38,18)") -> Column:
    return text.try_cast(kind)


def stripped(value: Column) -> Column:
    """Text of a DECIMAL without trailing zeros, equal for equal values."""
    text = value.cast("string")
    return F.when(text.contains("."), F.rtrim(F.rtrim(text, F.lit("0")), F.lit("."))).otherwise(text)


def grouped(value: Column, places: int = 2) -> Column:
    return F.format_number(value, places)


# -- numbers of any length, as text -----------------------------------------------------------

WIDE = Context(prec=4_000, Emax=999_999, Emin=-999_999)


def plain(value: Decimal) -> str:
    """Digits without exponent or trailing zeros; nan, inf and -inf by name."""
    if not value.is_finite():
        return "nan" if value.is_nan() else "inf" if value > 0 else "-inf"
    text = format(value, "f")
    text = text.rstrip("0").rstrip(".") if "." in text else text
    return "0" if text in ("-0", "") else text


def parse_big(text: str) -> Decimal | None:
    """A decimal of text with sign, fraction, exponent, or nan and inf; None if it is none."""
    try:
        return Decimal(text.strip().replace("_", "x")) if text.strip() else None
    except InvalidOperation:
        return None


def scale(value: Decimal) -> int:
    return max(0, -value.as_tuple().exponent) if value.is_finite() else 0


def divide(a: Decimal, b: Decimal) -> Decimal:
    """Quotient cut to ten places more than the operands have; by zero, infinite or nan."""
    if a.is_nan() or b.is_nan() or a.is_infinite() and b.is_infinite() or not a and b == 0:
        return Decimal("nan")
    if b == 0:
        return Decimal("inf").copy_sign(a)
    if a.is_infinite():
        return Decimal("inf") if (a > 0) == (b > 0) else Decimal("-inf")
    if b.is_infinite():
        return Decimal(0)
    places = max(scale(a), scale(b)) + EXTRA_DIGITS
    return (a / b).quantize(Decimal(1).scaleb(-places), rounding=ROUND_DOWN, context=WIDE)


def _power(a: Decimal, b: Decimal) -> Decimal:
    if b == b.to_integral_value():
        n = int(b)
        return a**n if n >= 0 else divide(Decimal(1), a**-n)
    with localcontext(WIDE) as c:
        c.prec = 60
        return a**b


def _root(a: Decimal) -> Decimal:
    if a < 0:
        return Decimal("nan")
    with localcontext(WIDE) as c:
        c.prec = max(40, len(a.as_tuple().digits) + 2 * EXTRA_DIGITS)
        return a.sqrt()


def _aligned(f: Callable[[int, int], int]) -> Callable[[Decimal, Decimal], Decimal]:
    """An integer function of two decimals' digits at their larger scale."""

    def run(a: Decimal, b: Decimal) -> Decimal:
        s = max(scale(a), scale(b))
        return Decimal(f(int(a.scaleb(s)), int(b.scaleb(s)))).scaleb(-s)

    return run


def _integers(f: Callable[[int, int], int]) -> Callable[[Decimal, Decimal], Decimal]:
    return lambda a, b: Decimal(f(int(a), int(b)))


def _quotient(a: int, b: int) -> int:
    q = abs(a) // abs(b)
    return q if (a < 0) == (b < 0) else -q


BINARY: dict[str, Callable[[Decimal, Decimal], Decimal]] = {
    "add": lambda a, b: a + b,
    "subtract": lambda a, b: a - b,
    "multiply": lambda a, b: a * b,
    "divide": divide,
    "remainder": lambda a, b: a.remainder_near(b),
    "truncating_remainder": lambda a, b: a % b,
    "power": _power,
    "gcd": _aligned(math.gcd),
    "lcm": _aligned(math.lcm),
    "quotient": _integers(_quotient),
    "modulo": _integers(lambda a, b: a - b * _quotient(a, b)),
    "and": _integers(lambda a, b: a & b),
    "or": _integers(lambda a, b: a | b),
    "xor": _integers(lambda a, b: a ^ b),
    "shift_left": _integers(lambda a, n: a << n if n > 0 else a),
    "shift_right": _integers(lambda a, n: a >> n if n > 0 else a),
}
UNARY: dict[str, Callable[[Decimal], Decimal]] = {
    "negate": lambda a: -a,
    "abs": abs,
    "signum": lambda a: Decimal((a > 0) - (a < 0)),
    "square_root": _root,
    "not": lambda a: Decimal(~int(a)),
    "bit_width": lambda a: Decimal(int(a).bit_length()),
    "normalized": lambda a: a,
    "ulp": lambda a: _ulp(a),
    "next_up": lambda a: a + _ulp(a) if a.is_finite() else a,
    "next_down": lambda a: a - _ulp(a) if a.is_finite() else a,
    "exponent": lambda a: Decimal(a.as_tuple().exponent if a.is_finite() else 0),
}


def _ulp(a: Decimal) -> Decimal:
    """One unit of the last digit that is written."""
    return Decimal(1).scaleb(a.as_tuple().exponent) if a.is_finite() else Decimal("nan")


def pi(digits: int = 50) -> Decimal:
    """The ratio of a circle's circumference to its diameter, by Machin's formula."""
    one = 10 ** (digits + 10)

    def arc(n: int) -> int:
        term = total = one // n
        k, sign = 3, -1
        while term:
            term //= n * n
            total += sign * (term // k)
            k, sign = k + 2, -sign
        return total

    return _digits_of(4 * (4 * arc(5) - arc(239)), digits)


def e(digits: int = 50) -> Decimal:
    """The base of natural logarithms, by its series."""
    term = total = 10 ** (digits + 10)
    k = 1
    while term:
        term //= k
        total += term
        k += 1
    return _digits_of(total, digits)


def _digits_of(scaled: int, digits: int) -> Decimal:
    """The leading digits of a number that was scaled by ten places more than that."""
    with localcontext(WIDE):
        return Decimal(scaled // 10**11).scaleb(1 - digits)


def _guard(f: Callable[..., Decimal], *texts: str | None) -> str | None:
    """A function of parsed numbers; null if a text is no number or the function has no value."""
    numbers = [None if t is None else parse_big(t) for t in texts]
    if any(n is None for n in numbers):
        return None
    with localcontext(WIDE):
        try:
            return plain(f(*numbers))
        except (InvalidOperation, ZeroDivisionError, OverflowError, ValueError):
            return "nan"


def big(operation: str, a: Column, b: Column | None = None) -> Column:
    """One of BINARY or UNARY over numbers as text, exact at any length."""
    if b is None:

        @F.pandas_udf("string")
        def one(x: pd.Series) -> pd.Series:
            return pd.Series([_guard(UNARY[operation], s) for s in x], dtype=object)

        return one(a.cast("string"))

    @F.pandas_udf("string")
    def two(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([_guard(BINARY[operation], s, t) for s, t in zip(x, y, strict=True)], dtype=object)

    return two(a.cast("string"), b.cast("string"))


def big_rounded(value: Column, places: int, rule: str = "nearest_or_even") -> Column:
    @F.pandas_udf("string")
    def run(x: pd.Series) -> pd.Series:
        unit = Decimal(1).scaleb(-places)
        return pd.Series([_guard(lambda d: d.quantize(unit, rounding=RULES[rule], context=WIDE), s) for s in x], dtype=object)

    return run(value.cast("string"))


def formatted(value: Column, *, grouping: bool = True, sign: str = "automatic", fraction: tuple[int, int] | None = None, significant: tuple[int, int] | None = None, point: str = "automatic", separators: tuple[str, str] = (",", ".")) -> Column:
    """Text of a number for display.

    sign: automatic (minus only), always, or never. fraction: the least and the most places;
    significant: the least and the most digits; both round halves away from zero, and without
    either the digits are those written. point: automatic, always (also at the end), or never (the
    fraction goes). separators: of groups of three digits, and of the fraction.
    """
    if sign not in ("automatic", "always", "never") or point not in ("automatic", "always", "never"):
        raise ValueError("unknown style")

    def one(text: str | None) -> str | None:
        d = None if text is None else parse_big(text)
        if d is None:
            return None
        if d.is_nan():
            return "NaN"
        lead = "-" if d < 0 and sign != "never" else "+" if d > 0 and sign == "always" else ""
        if d.is_infinite():
            return lead + "\u221e"
        d = abs(d)
        with localcontext(WIDE):
            if significant and d:
                places = significant[1] - 1 - d.adjusted()
                d = d.quantize(Decimal(1).scaleb(-places), rounding=ROUND_HALF_UP) if scale(d) > places else d
                low, high = significant[0] - 1 - d.adjusted(), None
            else:
                low, high = fraction or (0, None)
                d = d.quantize(Decimal(1).scaleb(-high), rounding=ROUND_HALF_UP) if high is not None and scale(d) > high else d
            whole, _, part = format(d, "f").partition(".")
        part = part.ljust(max(0, low), "0")
        if grouping:
            whole = f"{int(whole):,}".replace(",", separators[0])
        part = "" if point == "never" else part
        return lead + whole + (separators[1] + part if part or point == "always" else "")

    @F.pandas_udf("string")
    def run(x: pd.Series) -> pd.Series:
        return pd.Series([one(s) for s in x], dtype=object)

    return run(value.cast("string"))


def big_compare(a: Column, b: Column) -> Column:
    """-1, 0 or 1; null where either is no number or nan."""

    @F.pandas_udf("int")
    def run(x: pd.Series, y: pd.Series) -> pd.Series:
        def one(s: str | None, t: str | None) -> int | None:
            p, q = (None if v is None else parse_big(v) for v in (s, t))
            return None if p is None or q is None or p.is_nan() or q.is_nan() else (p > q) - (p < q)

        return pd.Series([one(s, t) for s, t in zip(x, y, strict=True)], dtype="Int32")

    return run(a.cast("string"), b.cast("string"))


def big_bytes(value: Column, signed: bool = True) -> Column:
    """Big-endian bytes of an integer: two's complement, or unsigned (null below zero)."""

    @F.pandas_udf("binary")
    def run(x: pd.Series) -> pd.Series:
        def one(s: str | None) -> bytes | None:
            d = None if s is None else parse_big(s)
            if d is None or not d.is_finite() or not signed and d < 0:
                return None
            n = int(d)
            size = max(1, ((n if n >= 0 else ~n).bit_length() + signed + 7) // 8)
            return n.to_bytes(size, "big", signed=signed)

        return pd.Series([one(s) for s in x], dtype=object)

    return run(value.cast("string"))


def big_from_bytes(data: Column, signed: bool = True) -> Column:
    @F.pandas_udf("string")
    def run(x: pd.Series) -> pd.Series:
        return x.map(lambda d: str(int.from_bytes(d, "big", signed=signed)), na_action="ignore")

    return run(data)
