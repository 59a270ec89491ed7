"""Value-consistent masking by policy.

A masked value is a keyed hash function of (key, domain, value).  Equal values
mask alike in every row, table and run with the same key; columns on both ends
of a foreign key share a domain, so joins survive masking.  No map of values is
built and nothing is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veilwork.functions import draws, names, permutation
from veilwork.operators.policies import ColumnPolicy
from veilwork.operators.profile import STAMPS, is_numeric

FIRST_NAMES = [
    "Ada", "Ben", "Clara", "David", "Elena", "Frank", "Grace", "Hugo", "Iris", "Jonas", "Karin", "Liam",
    "Maria", "Nils", "Olive", "Peter", "Quinn", "Rosa", "Simon", "Tara", "Ugo", "Vera", "Will", "Zoe",
]
LAST_NAMES = [
    "Abbott", "Baker", "Carter", "Dawson", "Ellis", "Foster", "Grant", "Hayes", "Irwin", "Jensen", "Keller",
    "Lopez", "Mason", "Norton", "Owens", "Parker", "Reed", "Stone", "Turner", "Underwood", "Vance", "Ward",
]
STREETS = ["Oak", "Maple", "Cedar", "Elm", "Birch", "Willow", "Chestnut", "Spruce", "Walnut", "Ash"]
CITIES = [
    "Ashford", "Brookside", "Clearwater", "Dunmore", "Eastfield", "Fairview", "Greenville", "Hillcrest",
    "Kingsport", "Lakewood", "Millbrook", "Northgate", "Oakdale", "Pinehurst", "Riverton", "Springdale",
]
STATES = [
    "AL", "AK", "AZ", "AR", "CA", "CO", "CT", "DE", "FL", "GA", "HI", "ID", "IL", "IN", "IA", "KS", "KY",
    "LA", "ME", "MD", "MA", "MI", "MN", "MS", "MO", "MT", "NE", "NV", "NH", "NJ", "NM", "NY", "NC", "ND",
    "OH", "OK", "OR", "PA", "RI", "SC", "SD", "TN", "TX", "UT", "VT", "VA", "WA", "WV", "WI", "WY",
]


def mask_digest(key: str, domain: str, value: Column) -> Column:
    """64 hex digits that depend on the secret key, the domain and the value."""
    return F.sha2(F.concat_ws("|", F.lit(key), F.lit(domain), value), 256)


def _number(digest: Column, index: int, size: int) -> Column:
    return F.pmod(draws.word(digest, index), F.lit(size))


def _choice(digest: Column, index: int, values: Sequence[str]) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (_number(digest, index, len(values)) + 1).cast("int"))


def _padded(digest: Column, index: int, width: int, low: int = 0) -> Column:
    number = _number(digest, index, 10**width - low) + low
    return F.lpad(number.cast("string"), width, "0")


def _letters(digest: Column, index: int, n: int) -> Column:
    alphabet = F.lit("abcdefghijklmnopqrstuvwxyz")
    number = draws.word(digest, index)
    return F.concat(
        *[
            F.substring(alphabet, (F.pmod(F.shiftright(number, 5 * i), F.lit(26)) + 1).cast("int"), F.lit(1))
            for i in range(n)
        ]
    )


def substitute(name: str, digest: Column, substring_tokens: bool = False) -> Column:
    """A realistic value of the kind the column name suggests.

    Short tokens (IP, LN, NM) match whole name parts, so SHIP_MODE is no IP
    column; ``substring_tokens=True`` matches them anywhere.
    """
    upper, parts = name.upper(), names.whole_tokens(name)

    def token(text: str) -> bool:
        return text in upper if substring_tokens else text in parts

    first, last = _choice(digest, 0, FIRST_NAMES), _choice(digest, 1, LAST_NAMES)
    if "FRST_NM" in upper or "FIRST" in upper:
        return first
    if "LST_NM" in upper or "LAST" in upper:
        return last
    if "MID_NM" in upper or "MIDDLE" in upper:
        return first
    if "EMAIL" in upper:
        return F.concat(F.lower(first), F.lit("."), F.lower(last), _padded(digest, 2, 4), F.lit("@example.com"))
    if "PHONE" in upper or "MSISDN" in upper:
        return F.concat(
            _padded(digest, 2, 3, low=200), F.lit("-"), _padded(digest, 3, 3, low=200), F.lit("-"), _padded(digest, 4, 4)
        )
    if "ADDR" in upper and token("LN"):
        return F.concat((_number(digest, 2, 9900) + 100).cast("string"), F.lit(" "), _choice(digest, 3, STREETS), F.lit(" Street"))
    if "CITY" in upper:
        return _choice(digest, 0, CITIES)
    if "ST_CD" in upper or "STATE" in upper:
        return _choice(digest, 0, STATES)
    if "ZIP" in upper:
        return _padded(digest, 0, 5)
    if token("IP"):
        return F.concat_ws(
            ".", F.lit("10"), *[_number(digest, i, 256).cast("string") for i in (0, 1, 2)]
        )
    if "URL" in upper:
        return F.concat(F.lit("https://www.example.com/"), _letters(digest, 0, 6))
    if token("NM") or "NAME" in upper:
        return F.concat(first, F.lit(" "), last)
    return F.concat(_letters(digest, 0, 4), _padded(digest, 1, 4))


def _long_number(digest: Column, digits: int) -> Column:
    """A number of exactly ``digits`` (at most 16) digits without a leading zero."""
    low = 10 ** (digits - 1)
    return (F.pmod(draws.hex_number(digest, 1, 15), F.lit(9 * low)) + low).cast("string")


def format_preserving(name: str, value: Column, key: str, domain: str, substring_tokens: bool = False) -> Column:
    """Digits for digits, letters for letters in the same case, the rest unchanged."""
    upper, parts = name.upper(), names.whole_tokens(name)
    digest = mask_digest(key, domain, value)
    if "SSN" in upper:
        return _long_number(digest, 9)
    if "IMSI" in upper:
        return _long_number(digest, 15)
    if "ICCID" in upper:
        return F.concat(_long_number(digest, 16), F.lpad(F.pmod(draws.hex_number(digest, 17, 8), F.lit(10000)).cast("string"), 4, "0"))
    if "CREDIT_CARD" in upper or (("CC" in upper) if substring_tokens else ("CC" in parts)):
        return _long_number(digest, 16)
    blocks = F.sequence(F.lit(0), F.floor((F.length(value) - 1) / 32).cast("int"))
    stream = F.array_join(
        F.transform(blocks, lambda b: F.sha2(F.concat_ws("|", F.lit(key), F.lit(domain), value, b.cast("string")), 256)), ""
    )
    upper_case, lower_case = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

    def swap(char: Column, i: Column) -> Column:
        number = F.conv(F.substring(stream, i * 2 + 1, F.lit(2)), 16, 10).cast("int")

        def letter(alphabet: str) -> Column:
            return F.substring(F.lit(alphabet), F.pmod(number, F.lit(26)) + 1, F.lit(1))

        return (
            F.when(char.rlike(r"^\p{Nd}$"), F.pmod(number, F.lit(10)).cast("string"))
            .when(char.rlike(r"^\p{Lu}$"), letter(upper_case))
            .when(char.rlike(r"^\p{L}$"), letter(lower_case))
            .otherwise(char)
        )

    chars = F.filter(F.split(value, ""), lambda c: c != "")
    return F.when(F.length(value) == 0, F.lit("")).otherwise(F.array_join(F.transform(chars, swap), ""))


MOST_SYMBOLS = 26  # a half of 13 letters or digits still fits a long
ROUNDS = 8


def _round_number(key: str, domain: str, shape: Column, half: Column, turn: Column) -> Column:
    """60 bits that depend on the secret, the domain, the value's shape, one half and the round, each with its length."""
    parts = [F.lit(f"{len(key)}:{key}{len(domain)}:{domain}"), F.length(shape).cast("string"), F.lit(":"), shape, turn.cast("string"), F.lit(":"), half.cast("string")]
    return draws.hex_number(F.sha2(F.concat(*parts), 256), 1, 15)


def permuted(value: Column, key: str, domain: str) -> Column:
    """A keyed permutation of all values of one shape: digits for digits, letters for letters in the same case.

    The letters and digits of a value are a number of mixed radix, its left and right half.  Each round adds a keyed
    function of one half to the other, modulo the number of values that half can have, so the rounds can be undone
    and no two values share a mask.  All other characters stay, so values of different shapes differ, too.
    A value with letters or digits outside ASCII, or with more than ``MOST_SYMBOLS``, becomes its keyed hash.
    ASCII values are masked in batches, see ``functions/permutation.py``; the expression here masks the others alike.
    """
    is_digit = lambda c: (c >= "0") & (c <= "9")
    is_lower = lambda c: (c >= "a") & (c <= "z")
    is_upper = lambda c: (c >= "A") & (c <= "Z")
    none = F.slice(F.array(F.lit(0).cast("long")), F.lit(1), F.lit(0))
    shape = F.regexp_replace(F.regexp_replace(F.regexp_replace(value, "[0-9]", "0"), "[a-z]", "a"), "[A-Z]", "A")

    def symbol(c: Column) -> Column:
        """Radix, number and first character code of a letter or digit; NULL for others."""
        code = F.ascii(c)
        first = F.when(is_digit(c), 48).when(is_lower(c), 97).when(is_upper(c), 65)
        return F.when(first.isNotNull(), F.struct(F.when(is_digit(c), 10).otherwise(26).cast("long").alias("r"), (code - first).cast("long").alias("v"), first.alias("first")))

    def halves(x: Column) -> Column:
        known = F.filter(x, lambda s: s["s"].isNotNull())
        cut = F.ceil(F.size(known) / 2).cast("int")
        return F.struct(F.slice(known, F.lit(1), cut).alias("left"), F.slice(known, cut + 1, F.size(known) - cut).alias("right"), x.alias("all"))

    read = lambda half: F.aggregate(half, F.lit(0).cast("long"), lambda n, x: n * x["s"]["r"] + x["s"]["v"])
    size = lambda half: F.aggregate(half, F.lit(1).cast("long"), lambda n, x: n * x["s"]["r"])

    def one_round(now: Column, turn: Column) -> Column:
        moved = F.pmod(now["a"] + F.pmod(_round_number(key, domain, now["shape"], now["b"], turn), now["ra"]), now["ra"])
        return F.struct(now["b"].alias("a"), moved.alias("b"), now["rb"].alias("ra"), now["ra"].alias("rb"), now["shape"].alias("shape"))

    def mixed(h: Column) -> Column:
        start = F.struct(read(h["left"]).alias("a"), read(h["right"]).alias("b"), size(h["left"]).alias("ra"), size(h["right"]).alias("rb"), shape.alias("shape"))
        return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, one_round)

    def write(half: Column, whole: Column) -> Column:
        def step(now: Column, x: Column) -> Column:
            digit = F.pmod(now["n"], x["s"]["r"])
            return F.struct(F.call_function("div", now["n"], x["s"]["r"]).alias("n"), F.concat(F.array(digit), now["out"]).alias("out"))

        return F.aggregate(F.reverse(half), F.struct(whole.alias("n"), none.alias("out")), step)["out"]

    def put(numbers: Column):
        def one(now: Column, x: Column) -> Column:
            swapped = F.char(x["s"]["first"] + F.get(numbers, now["k"]))
            return F.struct(
                F.when(x["s"].isNull(), now["k"]).otherwise(now["k"] + 1).alias("k"),
                F.concat(now["text"], F.coalesce(swapped, x["c"])).alias("text"),
            )

        return one

    symbols = F.transform(F.filter(F.split(value, ""), lambda c: c != ""), lambda c: F.struct(c.alias("c"), symbol(c).alias("s")))
    masked = _let(
        _let(symbols, halves),
        lambda h: _let(
            _let(mixed(h), lambda m: F.concat(write(h["left"], m["a"]), write(h["right"], m["b"]))),
            lambda numbers: F.aggregate(h["all"], F.struct(F.lit(0).alias("k"), F.lit("").alias("text")), put(numbers))["text"],
        ),
    )
    count = F.length(F.regexp_replace(value, "[^0-9A-Za-z]", ""))
    plain = (count <= MOST_SYMBOLS) & ~value.rlike(r"[\p{L}\p{N}&&[^0-9A-Za-z]]")
    secret = f"{len(key)}:{key}{len(domain)}:{domain}"
    hashed = F.sha2(F.concat(F.lit(secret), value), 256)

    @F.arrow_udf("string")
    def batch(values: pa.Array) -> pa.Array:
        return permutation.permute(values, secret.encode(), ROUNDS, MOST_SYMBOLS)

    return F.coalesce(batch(value), F.when(plain, masked).otherwise(hashed))


def _let(value: Column, use) -> Column:
    """``use(value)`` with ``value`` computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def generalise(value: Column, numeric: bool) -> Column:
    """Range label of a number, or a constant for text."""
    if not numeric:
        return F.when(value.isNotNull(), F.lit("REDACTED"))
    number = value.cast("double")
    return (
        F.when(number < 0, "NEGATIVE")
        .when(number < 25, "0-25")
        .when(number < 50, "25-50")
        .when(number < 75, "50-75")
        .when(number < 100, "75-100")
        .when(number.isNotNull() & ~F.isnan(number), "100+")
    )


def mask_column(field: T.StructField, policy: ColumnPolicy, key: str, domain: str, substring_tokens: bool = False, is_key: bool = False) -> Column:
    """The masked column; a key (an end of an edge) is permuted, so that distinct keys stay distinct."""
    column = F.col(f"`{field.name}`")
    text = column.cast("string")
    strategy = policy.masking_strategy
    if is_key and strategy in ("substitute_realistic", "format_preserving"):
        masked = permuted(text, key, domain)
    elif strategy == "substitute_realistic":
        masked = substitute(field.name, mask_digest(key, domain, text), substring_tokens)
    elif strategy == "format_preserving":
        masked = format_preserving(field.name, text, key, domain, substring_tokens)
    elif strategy == "generalise":
        return generalise(column, is_numeric(field.dataType))
    else:
        return column
    return F.when(column.isNotNull(), masked)


def mask(
    df: DataFrame,
    policies: Iterable[ColumnPolicy],
    key: str,
    domains: Mapping[str, str] | None = None,
    substring_tokens: bool = False,
) -> DataFrame:
    """Masked copy of a table, one projection over the scan.

    ``domains`` names the value domain of the key columns, see ``key_domains``; their masks are one to one.
    Other columns are a domain of their own name.
    """
    chosen = {p.column_name: p for p in policies}
    out = []
    for field in df.schema.fields:
        policy = chosen.get(field.name)
        if policy is None or policy.masking_strategy == "passthrough":
            out.append(F.col(f"`{field.name}`"))
        elif policy.masking_strategy != "suppress":
            domain = (domains or {}).get(field.name, field.name)
            is_key = field.name in (domains or {})
            out.append(mask_column(field, policy, key, domain, substring_tokens, is_key).alias(field.name))
    return df.select(*out)


def training_frame(df: DataFrame, policies: Iterable[ColumnPolicy], key: str, domains: Mapping[str, str] | None = None) -> DataFrame:
    """What generators may see: source numbers, dates and booleans, masked text.

    Suppressed columns are gone.  Like ``mask`` this is a projection over the scan.
    """
    plain = {f.name for f in df.schema.fields if is_numeric(f.dataType) or isinstance(f.dataType, (*STAMPS, T.BooleanType))}
    used = [p for p in policies if p.masking_strategy == "suppress" or p.column_name not in plain]
    return mask(df, used, key, domains)


def key_domains(edges, table: str) -> dict[str, str]:
    """Shared value domain of every column of ``table`` that is an end of an edge."""
    parent: dict[tuple[str, str], tuple[str, str]] = {}

    def find(end):
        while parent.setdefault(end, end) != end:
            end = parent[end]
        return end

    for e in edges:
        child, target = (e.source_table, e.source_column), (e.target_table, e.target_column)
        roots = sorted([find(child), find(target)])
        parent[roots[1]] = roots[0]
    return {column: ".".join(find((t, column))) for t, column in list(parent) if t == table}
