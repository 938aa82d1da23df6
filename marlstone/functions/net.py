"""Network names: host names, addresses, e-mail; validity as expressions, internationalised forms in Python."""

from __future__ import annotations

import ipaddress
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StringType

_LABEL = r"[A-Za-z0-9](?:[A-Za-z0-9\-]{0,61}[A-Za-z0-9])?"
_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
_IPV4 = rf"{_OCTET}(?:\.{_OCTET}){{3}}"
_ATOM = r"[A-Za-z0-9!#$%&'*+/=?^_`{|}~\-]+"
_LOCAL = rf'(?:{_ATOM}(?:\.{_ATOM})*|"(?:[ !#-\[\]-~]|\\[ -~])*")'


def _ipv6_pattern() -> str:
    """Forms of an IPv6 address: eight groups, or fewer around one ::, the last two perhaps dotted."""
    h = r"[0-9A-Fa-f]{1,4}"
    tail = rf"(?:{h}:{h}|{_IPV4})"
    forms = [rf"(?:{h}:){{6}}{tail}"]
    for before in range(0, 8):
        after = 7 - before
        for k in range(0, after + 1):
            if before + k > 7:
                continue
            end = "" if k == 0 else h if k == 1 else rf"(?:{h}:){{{k - 2}}}{tail}"
            exact = "" if before == 0 else rf"(?:{h}:){{{before - 1}}}{h}"
            forms.append(f"{exact}::{end}" if k else f"{exact}::")
            # a dotted end alone stands for two groups
            if k == 2:
                forms.append(f"{exact}::{_IPV4}")
    return "^(?:" + "|".join(forms) + r")\z"


_IPV6 = _ipv6_pattern()


def is_ipv4(text: Column) -> Column:
    """Four decimal octets without leading zeros."""
    return F.coalesce(text.rlike(rf"^{_IPV4}\z"), F.lit(False))


def ipv4_number(text: Column) -> Column:
    """The address as an unsigned integer; null if it is none."""
    return F.when(is_ipv4(text), F.aggregate(F.split(text, r"\."), F.lit(0).cast("bigint"), lambda n, s: n * 256 + s.cast("bigint")))


def is_ipv6(text: Column) -> Column:
    return F.coalesce(text.rlike(_IPV6), F.lit(False))


def ipv6_groups(number: Column) -> Column:
    """The last groups of an address that ends in a number: hexadecimal, four digits to a group, as many as it takes."""
    return F.regexp_replace(F.hex(number), r"(?<=.)(?=(?:.{4})+\z)", ":")


@F.pandas_udf(StringType())
def ipv6_canonical(text: pd.Series) -> pd.Series:
    """Shortest lower-case form of RFC 5952; null if the text is no address."""

    def one(t: str) -> str | None:
        try:
            return None if "%" in t else str(ipaddress.IPv6Address(t))
        except ValueError:
            return None

    return text.map(one, na_action="ignore")


def is_hostname(text: Column) -> Column:
    """LDH labels of 1 to 63, at most 255 without dots, a trailing dot or the root allowed; xn-- labels must have a body."""
    name = F.regexp_replace(text, r"\.\z", "")
    labels = F.split(name, r"\.")
    fine = F.forall(labels, lambda s: s.rlike(rf"^{_LABEL}\z") & (~F.substring(s, 3, 2).eqNullSafe("--") | s.rlike(r"^(?i)xn--[a-z0-9\-]*[a-z0-9]\z")))
    return F.coalesce((text == ".") | fine & (F.length(F.replace(name, F.lit("."), F.lit(""))) <= 255), F.lit(False))


def is_punycode(label: Column) -> Column:
    return F.coalesce(label.rlike(r"^(?i)xn--[a-z0-9\-]*[a-z0-9]\z"), F.lit(False))


def email_parts(text: Column) -> Column:
    """struct<local, domain> of a mailbox by RFC 5321; null if the text is none."""
    local, domain = F.regexp_extract(text, rf"^({_LOCAL})@(?s:(.+))\z", 1), F.regexp_extract(text, rf"^({_LOCAL})@(?s:(.+))\z", 2)
    inner = F.regexp_extract(domain, r"^\[(.*)\]\z", 1)
    literal = is_ipv4(inner) | inner.rlike("^(?i)IPv6:") & is_ipv6(F.substring(inner, F.lit(6), F.length(inner))) | inner.rlike(r"^(?!(?i)IPv6:)[A-Za-z0-9\-]*[A-Za-z0-9]:[\x21-\x5A\x5E-\x7E]+\z")
    fine = (local != "") & (F.octet_length(local) <= 64) & F.when(inner != "", literal).otherwise(is_hostname(domain) & ~domain.endswith("."))
    return F.when(F.coalesce(fine, F.lit(False)), F.struct(local.alias("local"), domain.alias("domain")))


def is_email(text: Column) -> Column:
    return email_parts(text).isNotNull()


def _joiner_ok(label: str, i: int) -> bool:
    """RFC 5892, appendix A: a joiner follows a virama; the non-joiner may also stand between joining letters."""
    if i and unicodedata.combining(label[i - 1]) == 9:
        return True
    if label[i] == "\u200d":
        return False
    cursive = lambda c: unicodedata.category(c) == "Lo" and any(s in unicodedata.name(c, "") for s in ("ARABIC", "SYRIAC", "MONGOLIAN", "NKO", "MANDAIC"))
    left = [c for c in label[:i] if not unicodedata.combining(c)]
    right = [c for c in label[i + 1 :] if not unicodedata.combining(c)]
    return bool(left and right and cursive(left[-1]) and cursive(right[0]))


def idn_label(label: str) -> bool:
    """Whether a label holds only letters, marks and digits that IDNA 2008 allows, each in its context."""
    if not label or label != unicodedata.normalize("NFC", label) or label[0] == "-" or label[-1] == "-" or label[2:4] == "--" and not label.lower().startswith("xn--"):
        return False
    if label.isascii():
        return all(c.isalnum() or c == "-" for c in label) and len(label) <= 63
    if unicodedata.category(label[0]).startswith("M"):
        return False
    arabic = any("٠" <= c <= "٩" for c in label)
    for i, c in enumerate(label):
        if c == "·":
            if not (0 < i < len(label) - 1 and label[i - 1] == label[i + 1] == "l"):
                return False
        elif c == "͵":
            if i + 1 >= len(label) or "GREEK" not in unicodedata.name(label[i + 1], ""):
                return False
        elif c in "׳״":
            if not i or "HEBREW" not in unicodedata.name(label[i - 1], ""):
                return False
        elif c == "・":
            if not any(unicodedata.name(x, "").startswith(("HIRAGANA", "KATAKANA LETTER", "CJK")) for x in label):
                return False
        elif c in "\u200c\u200d":
            if not _joiner_ok(label, i):
                return False
        elif c in "〮〯ـߺ〱〲〳〴〵〻":
            return False
        elif "۰" <= c <= "۹":
            if arabic:
                return False
        elif unicodedata.category(c) not in ("Ll", "Lo", "Lm", "Mn", "Mc", "Nd") and c not in "-ßς۽۾་〇":
            return False
    try:
        return len(label.encode("punycode")) + 4 <= 63
    except UnicodeError:
        return False


def idn_host(text: str) -> bool:
    name = text
    for dot in "。．｡":
        name = name.replace(dot, ".")
    name = name.removesuffix(".")
    return bool(name) and all(map(idn_label, name.split("."))) and len(name) <= 255


@F.pandas_udf(BooleanType())
def is_idn_hostname(text: pd.Series) -> pd.Series:
    return text.map(lambda t: t is not None and idn_host(t)).astype(bool)


@F.pandas_udf(BooleanType())
def is_idn_email(text: pd.Series) -> pd.Series:
    """A mailbox whose local part and domain may hold letters beyond ASCII."""
    import re

    atom = re.compile(r"(?:[A-Za-z0-9!#$%&'*+/=?^_`{|}~\-]|[^\x00-\x9f\s])+(?:\.(?:[A-Za-z0-9!#$%&'*+/=?^_`{|}~\-]|[^\x00-\x9f\s])+)*|\"(?:[^\"\\\x00-\x1f]|\\[ -~])*\"")

    def one(t: str | None) -> bool:
        local, at, domain = (t or "").rpartition("@")
        return bool(at and len(local.encode()) <= 64 and atom.fullmatch(local) and idn_host(domain))

    return text.map(one).astype(bool)
