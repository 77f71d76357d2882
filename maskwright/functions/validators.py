"""Checksums and format rules as Columns: true accepts, false rejects, NULL is neutral."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The alphabets of base58 and bech32, the latter's generator and final constants.
BASE58 = "123456789ABCDEFGHJKLMNPQRSTUVWXYZabcdefghijkmnopqrstuvwxyz"
BECH32 = "qpzry9x8gf2tvdw0s3jn54khce6mua7l"
BECH32_GENERATOR = (0x3B6A57B2, 0x26508E6D, 0x1EA119FA, 0x3D4233DD, 0x2A1462B3)
BECH32_FINAL = (1, 0x2BC830A3)


def let(value: Column, use) -> Column:
    """use(value), with value evaluated once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def characters(text: Column) -> Column:
    return F.filter(F.split(text, ""), lambda c: c != "")


def digit(c: Column) -> Column:
    return F.ascii(c) - 48


def luhn(digits: Column) -> Column:
    return F.coalesce(F.call_function("luhn_check", digits), F.lit(False))


def weighted_sum(digits: Column, weights: list[int]) -> Column:
    """Sum of the first digits times their weights."""
    total = F.lit(0)
    for i, w in enumerate(weights):
        total = total + digit(F.substring(digits, i + 1, 1)) * w
    return total


def without(text: Column, letters: str) -> Column:
    return F.translate(text, letters, "")


def credit_card(match: Column) -> Column:
    d = without(match, "- ")
    return ~((F.length(d) == 13) & d.startswith("1")) & luhn(d)


def mod97(text: Column) -> Column:
    """The number that a text of digits and capitals (A is 10) spells, modulo 97."""
    step = lambda r, c: F.when(c.rlike("[0-9]"), (r * 10 + digit(c)) % 97).otherwise((r * 100 + F.ascii(c) - 55) % 97)
    return F.aggregate(characters(text), F.lit(0), step)


def iban(match: Column) -> Column:
    turned = F.concat(F.substring(match, F.lit(5), F.length(match)), F.substring(match, 1, 4))
    return F.when((F.length(match) < 5) | ~match.rlike("^[0-9A-Z]+$"), False).otherwise(mod97(turned) == 1)


def ip_v4(match: Column) -> Column:
    return F.when(match.rlike(r"^(?:0|[1-9][0-9]*)(?:\.(?:0|[1-9][0-9]*)){3}$"), F.lit(None).cast("boolean")).otherwise(False)


def ip_v6(match: Column) -> Column:
    groups = F.size(F.filter(F.split(match, ":"), lambda x: x != ""))
    gaps = F.size(F.split(match, "::", -1)) - 1
    whole = match.rlike("^[0-9A-Fa-f:]+$") & ~match.rlike("[0-9A-Fa-f]{5}") & ~match.contains(":::") & (match.endswith("::") | ~match.endswith(":")) & (match.startswith("::") | ~match.startswith(":"))
    good = whole & (((gaps == 0) & (groups == 8)) | ((gaps == 1) & (groups <= 7)))
    return F.when(good, F.lit(None).cast("boolean")).otherwise(False)


def ssn(match: Column) -> Column:
    d = F.regexp_replace(match, "[^0-9]", "")
    kinds = F.size(F.array_distinct(F.filter(characters(match), lambda c: c.isin(".", "-", " "))))
    bad = (
        (kinds > 1)
        | ((F.length(d) > 0) & d.rlike(r"^([0-9])\1*$"))
        | ((F.length(d) == 9) & ((F.substring(d, 4, 2) == "00") | (F.substring(d, 6, 4) == "0000")))
        | F.substring(d, 1, 3).isin("000", "666")
        | d.isin("123456789", "987654320", "078051120")
    )
    return F.when(bad, False)


def aba(match: Column) -> Column:
    d = without(match, "- ")
    return d.rlike("^[0-9]{9}$") & (weighted_sum(d, [3, 7, 1] * 3) % 10 == 0)


def npi(match: Column) -> Column:
    d = without(match, "- ")
    return (F.length(d) >= 2) & ~d.rlike(r"^(.)\1*.$") & luhn(F.concat(F.lit("80840"), d))


def dea(match: Column) -> Column:
    d = F.substring(without(match, "- "), 3, 7)
    return d.rlike("^[0-9]{7}$") & (weighted_sum(d, [1, 2] * 3) % 10 == digit(F.substring(d, 7, 1)))


def nir(match: Column) -> Column:
    d = F.upper(without(match, " .-"))
    body = F.regexp_replace(F.substring(d, 1, 13), "^(.*?)2A", "$119")
    body = F.when(F.substring(d, 1, 13).contains("2A"), body).otherwise(F.regexp_replace(F.substring(d, 1, 13), "^(.*?)2B", "$118"))
    number, key = body.try_cast("bigint"), F.substring(d, 14, 2).try_cast("int")
    return F.when(F.length(d) != 15, False).otherwise(F.coalesce(F.lit(97) - F.pmod(number, F.lit(97)) == key, F.lit(False)))


def french_luhn(match: Column) -> Column:
    return luhn(without(match, " .-"))


def base58_check(text: Column) -> Column:
    """Base58 with a checksum of the first four bytes of a double SHA-256; at least five bytes.

    The number is carried in 12 limbs of 32 bits, lowest first, which holds 62 letters; five letters
    are taken in at once.
    """
    limb = F.lit(1 << 32)
    powers = F.array(*[F.lit(58**i).cast("long") for i in range(1, 6)])

    def take(limbs: Column, part: Column) -> Column:
        value = F.aggregate(characters(part), F.lit(0).cast("long"), lambda n, c: n * 58 + (F.instr(F.lit(BASE58), c) - 1))
        carried = lambda x: F.aggregate(
            limbs,
            F.struct(x["value"].alias("carry"), F.array().cast("array<bigint>").alias("out")),
            lambda s, y: let(y * x["power"] + s["carry"], lambda v: F.struct(F.shiftright(v, 32).alias("carry"), F.concat(s["out"], F.array(v % limb)).alias("out"))),
            lambda s: s["out"],
        )
        return let(F.struct(value.alias("value"), F.element_at(powers, F.length(part)).alias("power")), carried)

    parts = F.transform(F.sequence(F.lit(0), F.floor((F.length(text) - 1) / 5).cast("int")), lambda i: F.substring(text, i * 5 + 1, F.lit(5)))
    number = F.aggregate(parts, F.array_repeat(F.lit(0).cast("long"), 12), take)
    digits = F.ltrim(F.array_join(F.transform(F.reverse(number), lambda x: F.lpad(F.hex(x), 8, "0")), ""), F.lit("0"))
    even = let(digits, lambda x: F.when(F.length(x) % 2 == 1, F.concat(F.lit("0"), x)).otherwise(x))
    raw = F.concat(F.repeat(F.lit("00"), F.length(text) - F.length(F.ltrim(text, F.lit("1")))), even)
    checked = lambda raw: (F.length(raw) >= 10) & (
        F.upper(F.substring(F.sha2(F.unhex(F.sha2(F.unhex(F.substring(raw, F.lit(1), F.length(raw) - 8)), 256)), 256), 1, 8)) == F.substring(raw, F.length(raw) - 7, F.lit(8))
    )
    return F.when(~text.rlike(f"^[{BASE58}]{{1,62}}$"), False).otherwise(let(raw, checked))


def bech32(text: Column) -> Column:
    """Bech32 or bech32m: one case, a separator with at least six letters after it, a right checksum."""
    low = F.lower(text)
    cut = F.length(low) - F.instr(F.reverse(low), "1")
    head, data = F.substring(low, F.lit(1), cut), F.substring(low, cut + 2, F.length(low))
    values = F.concat(
        F.transform(characters(head), lambda c: F.shiftright(F.ascii(c), 5)), F.array(F.lit(0)), F.transform(characters(head), lambda c: F.ascii(c).bitwiseAND(31)), F.transform(characters(data), lambda c: F.instr(F.lit(BECH32), c) - 1)
    )

    def step(state: Column, value: Column) -> Column:
        mixed = F.shiftleft(state.bitwiseAND(F.lit(0x1FFFFFF)), 5).bitwiseXOR(value.cast("long"))
        for i, generator in enumerate(BECH32_GENERATOR):
            mixed = mixed.bitwiseXOR(F.shiftright(state, 25 + i).bitwiseAND(F.lit(1)) * F.lit(generator).cast("long"))
        return mixed

    state = F.aggregate(values, F.lit(1).cast("long"), lambda s, v: let(s, lambda x: step(x, v)))
    one_case = (F.lower(text) == text) | (F.upper(text) == text)
    shaped = one_case & low.contains("1") & (cut >= 1) & (cut + 7 <= F.length(low)) & data.rlike(f"^[{BECH32}]*$")
    return F.when(~shaped, False).otherwise(state.isin(*BECH32_FINAL))


def crypto(match: Column) -> Column:
    return F.when(match.startswith("bc1"), bech32(match)).when(match.startswith("1") | match.startswith("3"), base58_check(match)).otherwise(False)
