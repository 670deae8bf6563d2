"""Personal-data scan of texts before they are embedded or stored."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# ---- fixed values: what is found, in the order it is replaced -------------------------------
PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}",
    "phone": r"(\+[0-9]{1,3}[ .-]?)?(\([0-9]{3}\) ?|[0-9]{3}[.-])[0-9]{3}[ .-][0-9]{4}",
    "address": r"[0-9]{1,3}(\.[0-9]{1,3}){3}",
    "number": r"[0-9]{3}-[0-9]{2}-[0-9]{4}|[0-9]{9,}",
}


def pii_scan(docs: DataFrame, column: str = "text") -> DataFrame:
    """Adds ``n_email, n_phone, n_address, n_number`` and ``redacted``.

    Kinds are looked for in turn, each in what the earlier ones left, so the digits of an
    e-mail address are not counted again as a number. Built-in expressions only; NULL text
    counts nothing and stays NULL.
    """
    out = docs.withColumn("redacted", F.col(column))
    for kind, pattern in PATTERNS.items():
        found = F.coalesce(F.regexp_count("redacted", F.lit(pattern)), F.lit(0))
        out = out.withColumn(f"n_{kind}", found.cast("bigint")).withColumn(
            "redacted", F.regexp_replace("redacted", pattern, f"[{kind}]"))
    return out


def holds_pii():
    """True for scanned rows in which anything was found."""
    return sum((F.col(f"n_{kind}") for kind in PATTERNS), F.lit(0)) > 0


# ---- checked kinds ----------------------------------------------------------------------------

#: Candidates of kinds whose digits can be checked.
_WORD = (r"(?<![0-9A-Za-z])", r"(?![0-9A-Za-z])")
_DOTTED = (r"(?<![0-9A-Za-z]|[0-9][.])", r"(?![0-9A-Za-z]|[.][0-9])")
CARD = (r"[0-9](?:[ -]?[0-9]){12,18}", _WORD)
ADDRESS = (r"[0-9]{1,3}(?:[.][0-9]{1,3}){3}", _DOTTED)
ACCOUNT = (r"[A-Z]{2}[0-9]{2}(?: ?[0-9A-Z]){11,30}", _WORD)


def _account_holds(account: Column) -> Column:
    """Whether an account number leaves 1 on division by 97, its first four characters last and
    letters as the numbers 10 to 35."""
    plain = F.replace(account, F.lit(" "), F.lit(""))
    turned = F.concat(F.substring(plain, F.lit(5), F.char_length(plain)), F.substring(plain, 1, 4))
    digits = F.transform(F.split(turned, ""), lambda c: F.when(
        c.between("A", "Z"), F.ascii(c) - 55).otherwise(c.cast("int")))
    rest = F.aggregate(F.filter(digits, lambda d: d.isNotNull()), F.lit(0), lambda a, d: F.when(
        d > 9, (a * 100 + d) % 97).otherwise((a * 10 + d) % 97))
    return rest == 1


def checked_pii(docs: DataFrame, column: str = "text") -> DataFrame:
    """Adds ``n_card, n_ipv4, n_account`` and ``masked``: finds whose digits hold.

    A card number has 13 to 19 digits, single blanks or hyphens between them, and a right check digit;
    an address four numbers up to 255 without leading zeros, not part of a longer dotted number; an
    account number two letters, two check digits and 11 to 30 characters, and leaves 1 modulo 97.
    Candidates that fail the check are neither counted nor masked. ``masked`` has the checked finds
    replaced by their kind in square brackets, cards first. Null texts count nothing and stay null;
    other columns are kept. Built-in expressions only, one pass.
    """
    octets = lambda a: F.forall(F.split(a, "[.]"), lambda o: (o.cast("int") <= 255) & (
        (o == "0") | ~o.startswith("0")))
    kinds = {
        "card": (CARD, lambda c: F.call_function("luhn_check", F.regexp_replace(c, "[ -]", ""))),
        "ipv4": (ADDRESS, octets),
        "account": (ACCOUNT, _account_holds)}
    out = docs.withColumn("masked", F.col(f"`{column}`"))
    for kind, ((pattern, (before, after)), holds) in kinds.items():
        whole = F.lit(before + pattern + after)
        found = F.regexp_extract_all(F.coalesce("masked", F.lit("")), whole, F.lit(0))
        out = out.withColumn("_held", F.transform(found, lambda f: F.struct(f.alias("f"), holds(f).alias("good"))))
        # what stands between the finds, each followed by its find or its kind
        parts = F.zip_with(F.split("masked", before + pattern + after, -1), "_held", lambda between, h: F.concat(
            between, F.when(h["good"], F.lit(f"[{kind}]")).otherwise(F.coalesce(h["f"], F.lit("")))))
        held = F.filter("_held", lambda h: h["good"])
        out = (out.withColumn(f"n_{kind}", F.size(held).cast("bigint"))
               .withColumn("masked", F.when(F.size(held) > 0, F.array_join(parts, "")).otherwise(F.col("masked")))
               .drop("_held"))
    return out
