"""Column functions of normalization: numbers, times, sides, quantities, identities, level arrays."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import DEC, NS_PER_HOUR

_MULTIPLIER = {"s": 1_000_000_000, "ms": 1_000_000, "us": 1_000, "ns": 1}


def parse_decimal(text: Column) -> Column:
    """DECIMAL(38,18) of a plain or scientific number; null where digits would be lost or the text is no number.

    A mantissa's digits after the point less its exponent must not exceed 18; then the cast is exact or overflows to null.
    """
    body = F.trim(text)
    ok = body.rlike(r"^[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d{1,3})?$")
    mantissa = F.regexp_extract(body, r"^[+-]?([\d.]*)", 1)
    fraction = F.length(F.regexp_replace(F.regexp_extract(mantissa, r"\.(\d*)$", 1), "0+$", ""))
    exponent = F.coalesce(F.regexp_extract(body, r"[eE]([+-]?\d+)$", 1).try_cast("int"), F.lit(0))
    zeros = F.length(F.regexp_extract(F.regexp_replace(mantissa, r"\.$|\.0+$", ""), r"(0+)$", 1))
    digits = F.when(fraction > 0, fraction).otherwise(-zeros)
    return F.when(ok & (digits - exponent <= 18), body.try_cast(DEC))


def to_ns(value: Column, unit: str) -> Column:
    """Integer nanoseconds of an epoch text; fractions of seconds are exact and may not go below a nanosecond."""
    text = F.trim(value.cast("string"))
    whole = F.try_multiply(text.try_cast("long"), F.lit(_MULTIPLIER[unit]))
    if unit != "s":
        return F.when(text.rlike(r"^-?\d+$"), whole)
    fraction = F.regexp_extract(text, r"^-?\d+\.(\d{1,9})0*$", 1)
    seconds = F.regexp_extract(text, r"^(-?\d+)", 1).try_cast("long")
    part = F.rpad(fraction, 9, "0").try_cast("long") * F.when(text.startswith("-"), -1).otherwise(1)
    exact = F.try_add(F.try_multiply(seconds, F.lit(1_000_000_000)), part)
    return F.when(text.rlike(r"^-?\d+$"), whole).when(fraction != "", exact)


def iso_to_ns(text: Column) -> Column:
    """Nanoseconds of an ISO-8601 time with T and a zone, up to 9 digits of fraction; no leap second."""
    ok = text.rlike(r"^\d{4}-\d\d-\d\dT\d\d:\d\d:[0-5]\d(\.\d{1,9})?(Z|[+-]\d\d:\d\d)$")
    fraction = F.regexp_extract(text, r"\.(\d{1,9})", 1)
    seconds = F.try_to_timestamp(F.regexp_replace(text, r"\.\d+", ""))
    return F.when(ok, F.unix_micros(seconds) * 1000 + F.when(fraction == "", F.lit(0)).otherwise(F.rpad(fraction, 9, "0").try_cast("long")))


def ns_to_utc(ns: Column) -> Column:
    """Nine-digit UTC text of nanoseconds."""
    rest = F.pmod(ns, F.lit(1_000_000_000))
    seconds = F.try_divide((ns - rest).cast("decimal(20,0)"), F.lit(1_000_000_000)).cast("long")
    return F.concat(F.date_format(F.timestamp_seconds(seconds), "yyyy-MM-dd'T'HH:mm:ss"), F.lit("."), F.lpad(rest.cast("string"), 9, "0"), F.lit("Z"))


def divide_doubles(a: Column, b: Column) -> Column:
    """a / b as IEEE doubles: by zero it is infinite, or not a number where a is zero too."""
    return F.coalesce(F.try_divide(a, b), a * F.pow(b, F.lit(-1.0)))


def round_double(x: Column, places: int) -> Column:
    """Rounds the scaled double half away from zero, as DuckDB does; F.round takes halves from the shortest decimal text. Doubles too large to scale stay."""
    factor = F.lit(10.0**places)
    return F.when(F.abs(x * factor) < float("inf"), F.round(x * factor) / factor).otherwise(x)


def window_start(ns: Column, width: int = NS_PER_HOUR) -> Column:
    """Start of the tumbling window, right for times before the epoch too."""
    return ns - F.pmod(ns, F.lit(width))


def side_casefold(text: Column) -> Column:
    return F.when(text.isin("Buy", "buy", "BUY"), "buy").when(text.isin("Sell", "sell", "SELL"), "sell")


def side_map(text: Column, mapping: dict[str, str]) -> Column:
    """buy, sell or unknown by the lower-cased key; null where the key is missing."""
    pairs = [F.lit(x) for kv in mapping.items() for x in (kv[0].lower(), kv[1])]
    return F.try_element_at(F.create_map(*pairs), F.lower(text))


def side_of_sign(number: Column, positive: str = "buy", negative: str = "sell") -> Column:
    return F.when(number > 0, positive).when(number < 0, negative)


def parse_bool(text: Column) -> Column:
    low = F.lower(text.cast("string"))
    return F.when(low.isin("true", "1"), True).when(low.isin("false", "0"), False)


def equals(value: Column, wanted: str | bool | int | float) -> Column:
    """Equality with a configured text, number (as decimals) or bool."""
    if isinstance(wanted, bool):
        return parse_bool(value) == F.lit(wanted)
    if isinstance(wanted, str):
        return value.cast("string") == F.lit(wanted)
    return parse_decimal(value.cast("string")) == F.lit(str(wanted)).cast(DEC)


def normalize_quantity(kind: str, quantity: Column, price: Column, contract_value: Column | None = None, inverse: bool = False, any_price: bool = False) -> dict[str, Column]:
    """base, quote and contracts of a quantity given in one of them; null unless price and quantity are positive.

    With any_price only the quantity must be positive, and doubles are divided by a price of zero to infinity.
    """
    ok = (quantity > 0) if any_price else (quantity > 0) & (price > 0)
    div = divide_doubles if any_price else F.try_divide
    if kind == "base":
        base, quote, contracts = quantity, quantity * price, F.lit(None)
    elif kind == "quote":
        base, quote, contracts = div(quantity, price), quantity, F.lit(None)
    elif kind == "contracts" and contract_value is not None and not inverse:
        base, quote, contracts = quantity * contract_value, quantity * contract_value * price, quantity
    elif kind == "contracts" and contract_value is not None:
        base, quote, contracts = div(quantity * contract_value, price), quantity * contract_value, quantity
    else:
        raise ValueError(f"no rule for quantities in {kind}")
    return {k: F.when(ok, v) for k, v in (("quantity_base", base), ("quantity_quote", quote), ("quantity_contracts", contracts))}


def is_currency(code: Column) -> Column:
    return F.coalesce(code.rlike("^[A-Z0-9]+$"), F.lit(False))


def instrument_reference(exchange: Column, market: Column, kind: Column, symbol: Column) -> Column:
    """exchange.market[.kind].symbol; the kind is left out where it is null or repeats the market."""
    return F.concat_ws(".", exchange, market, F.when(kind.isNotNull() & (kind != market), kind), symbol)


def family_of(symbol: Column) -> Column:
    """The part of a dated symbol before its last dash-separated expiry."""
    return F.regexp_extract(symbol, r"^(.+?)(-\d{6})?$", 1)


def native_id_order(text: Column) -> Column:
    """A struct that orders digit strings of any length by value, and before all other texts."""
    digits = text.rlike(r"^\d+$")
    short = F.regexp_replace(text, "^0+(?=.)", "")
    return F.struct(F.when(digits, F.lit(0)).otherwise(F.lit(1)).alias("other"), F.when(digits, F.length(short)).otherwise(F.lit(0)).alias("digits"), F.when(digits, short).otherwise(text).alias("text"))


def level_array(json: Column, fields: tuple[str, str] | None = None) -> Column:
    """ARRAY<STRUCT<price, quantity>> of a JSON array of [price, quantity, ...] or of objects with the named fields; exact."""
    if fields is None:
        raw = F.from_json(json, "array<array<string>>")
        return F.transform(raw, lambda x: F.struct(parse_decimal(F.try_element_at(x, F.lit(1))).alias("price"), parse_decimal(F.try_element_at(x, F.lit(2))).alias("quantity")))
    raw = F.from_json(json, f"array<struct<`{fields[0]}`:string,`{fields[1]}`:string>>")
    return F.transform(raw, lambda x: F.struct(parse_decimal(x[fields[0]]).alias("price"), parse_decimal(x[fields[1]]).alias("quantity")))


def fingerprint(*fields: Column) -> Column:
    """SHA-256 over the fields, each with its length before it; null differs from empty."""
    parts = [F.when(f.isNull(), F.lit("-1:")).otherwise(F.concat(F.octet_length(f.cast("string")).cast("string"), F.lit(":"), f.cast("string"))) for f in fields]
    return F.sha2(F.concat(*parts), 256)
