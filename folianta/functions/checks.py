"""Checks of numbers and secrets."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def luhn(text: Column) -> Column:
    """Mod-10 check of the digits, spaces and hyphens aside."""
    return F.call_function("luhn_check", F.regexp_replace(text, "[ -]", ""))


def iban(text: Column) -> Column:
    """Shape and mod-97 check of an account number."""
    t = F.upper(F.replace(text, F.lit(" "), F.lit("")))
    turned = F.concat(F.substring(t, 5, 40), F.substring(t, 1, 4))

    def step(rest: Column, c: Column) -> Column:
        code = F.ascii(c)
        return F.when(code >= 65, (rest * 100 + code - 55) % 97).otherwise((rest * 10 + code - 48) % 97)

    left = F.aggregate(F.filter(F.split(turned, ""), lambda c: c != ""), F.lit(0), step)
    return t.rlike("^[A-Z]{2}\\d{2}[A-Z0-9]{11,30}$") & (left == 1)


def ssn(text: Column) -> Column:
    area, group, serial = (F.split_part(text, F.lit("-"), F.lit(i)) for i in (1, 2, 3))
    return (area != "000") & (area != "666") & ~area.startswith("9") & (group != "00") & (serial != "0000")


# Words that weaken a password.
COMMON = ("password", "passwort", "qwerty", "letmein", "welcome", "admin", "login", "secret", "iloveyou", "monkey", "dragon", "abc", "123")


def password_bits(text: Column) -> Column:
    """Guessing entropy: characters that go on a run or sequence count a quarter; common words and digits alone weaken."""
    has = lambda p, n: F.when(text.rlike(p), n).otherwise(0)
    pool = F.greatest(has("[a-z]", 26) + has("[A-Z]", 26) + has("[0-9]", 10) + has("[^0-9a-zA-Z]", 33), F.lit(1))
    codes = F.transform(F.filter(F.split(text, ""), lambda c: c != ""), lambda c: F.ascii(c))
    pairs = F.zip_with(F.slice(codes, 2, F.greatest(F.size(codes) - 1, F.lit(0))), codes, lambda b, a: F.when(b.isNull(), 0.0).when(F.abs(b - a) <= 1, 0.25).otherwise(1.0))
    length = F.lit(1.0) + F.aggregate(pairs, F.lit(0.0), lambda n, x: n + x)
    bits = length * F.log2(pool.cast("double"))
    found = F.lit(None).cast("string")
    for word in reversed(COMMON):
        found = F.when(F.contains(F.lower(text), F.lit(word)), F.lit(word)).otherwise(found)
    bits = bits - F.coalesce(F.length(found) * 3, F.lit(0))
    bits = F.when(text.rlike("^[0-9]+$"), F.least(bits, F.lit(20.0))).otherwise(bits)
    return F.when(text == "", 0).otherwise(F.greatest(F.lit(0), F.floor(bits + 0.5).cast("int")))


def password_label(bits: Column) -> Column:
    return F.when(bits < 28, "Very weak").when(bits < 36, "Weak").when(bits < 60, "Fair").when(bits < 80, "Good").otherwise("Strong")
