"""The `format` values of JSON Schema as checks of Python strings."""

from __future__ import annotations

import ipaddress
import re
from collections.abc import Callable
from datetime import date

from marlstone.functions import net, uri
from marlstone.operators.pointer import Pointer, PointerError, RelativePointer

_TIME = re.compile(r"(\d{2}):(\d{2}):(\d{2})(?:\.\d+)?(?:[Zz]|([+-])(\d{2}):(\d{2}))", re.ASCII)
_DURATION = re.compile(r"P(?:\d+W|(?=\d|T\d)(?:\d+Y)?(?:\d+M)?(?:\d+D)?(?:T(?=\d)(?:\d+H)?(?:\d+M)?(?:\d+(?:\.\d+)?S)?)?)", re.ASCII)
_UUID = re.compile(r"[0-9A-Fa-f]{8}(?:-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}")
_HOST = re.compile(net._LABEL)
_LOCAL = re.compile(net._LOCAL)


def is_date(t: str) -> bool:
    if not re.fullmatch(r"\d{4}-\d{2}-\d{2}", t, re.ASCII):
        return False
    try:
        date.fromisoformat(t)
    except ValueError:
        return False
    return True


def is_time(t: str) -> bool:
    m = _TIME.fullmatch(t)
    if not m:
        return False
    h, mi, s = int(m[1]), int(m[2]), int(m[3])
    oh, om = int(m[5] or 0), int(m[6] or 0)
    if h > 23 or mi > 59 or s > 60 or oh > 23 or om > 59:
        return False
    shift = (oh * 60 + om) * (-1 if m[4] == "-" else 1)
    return s < 60 or (h * 60 + mi - shift) % 1440 == 1439


def is_date_time(t: str) -> bool:
    return len(t) > 11 and t[10] in "Tt" and is_date(t[:10]) and is_time(t[11:])


def is_ipv6(t: str) -> bool:
    try:
        ipaddress.IPv6Address(t)
    except ValueError:
        return False
    return "%" not in t


def is_ipv4(t: str) -> bool:
    return re.fullmatch(net._IPV4, t, re.ASCII) is not None


def is_hostname(t: str) -> bool:
    if t == ".":
        return True
    labels = t.removesuffix(".").split(".")
    fine = lambda s: _HOST.fullmatch(s) and (s[2:4] != "--" or re.fullmatch(r"(?i)xn--[a-z0-9-]*[a-z0-9]", s))
    return all(map(fine, labels)) and sum(map(len, labels)) <= 255


def is_email(t: str) -> bool:
    local, at, domain = t.rpartition("@")
    if not at or len(local) > 64 or not _LOCAL.fullmatch(local):
        return False
    if domain.startswith("[") and domain.endswith("]"):
        inner = domain[1:-1]
        return is_ipv4(inner) or inner[:5].lower() == "ipv6:" and is_ipv6(inner[5:]) or inner[:5].lower() != "ipv6:" and re.fullmatch(r"[A-Za-z0-9\-]*[A-Za-z0-9]:[\x21-\x5A\x5E-\x7E]+", inner) is not None
    return not domain.endswith(".") and is_hostname(domain)


def is_idn_email(t: str) -> bool:
    local, at, domain = t.rpartition("@")
    return bool(at and local and len(local.encode()) <= 64 and not re.search(r"[\s@\x00-\x1f]", local) and net.idn_host(domain))


_PARTS = re.compile(uri.PATTERN, re.S)
_ASCII = re.compile(uri._CHARS + "*(?:#" + uri._CHARS + "*)?")
_WIDE = re.compile(re.sub(r"\\x\{([0-9A-F]+)\}", lambda m: f"\\U{int(m[1], 16):08X}", uri._ICHARS) + "*(?:#" + re.sub(r"\\x\{([0-9A-F]+)\}", lambda m: f"\\U{int(m[1], 16):08X}", uri._ICHARS) + "*)?")


def _reference(t: str, wide: bool, absolute: bool) -> bool:
    m = _PARTS.match(t)
    scheme, authority, path = m[2], m[4] if m[3] else None, m[5]
    if not (_WIDE if wide else _ASCII).fullmatch(t) or absolute and not scheme:
        return False
    if scheme and not re.fullmatch(r"[A-Za-z][A-Za-z0-9+.\-]*", scheme) or authority is not None and not re.match(uri._AUTHORITY, authority):
        return False
    return not re.search(r"[\[\]]", path + (m[7] or "") + (m[9] or "")) and (bool(scheme) or authority is not None or ":" not in path.split("/")[0])


def is_template(t: str) -> bool:
    from marlstone.functions.uri_template import Template, TemplateError

    try:
        Template(t)
    except TemplateError:
        return False
    return True


def _parses(f: Callable[[str], object]) -> Callable[[str], bool]:
    def run(t: str) -> bool:
        try:
            f(t)
        except (PointerError, ValueError):
            return False
        return True

    return run


def is_regex(t: str) -> bool:
    from marlstone.plans.jsonpath import pattern

    return pattern(t) is not None and not re.search(r"(?<!\\)(?:\\\\)*\\[aZzAGQE]", t)


CHECKS: dict[str, Callable[[str], bool]] = {
    "date-time": is_date_time,
    "date": is_date,
    "time": is_time,
    "duration": lambda t: _DURATION.fullmatch(t) is not None,
    "email": is_email,
    "idn-email": is_idn_email,
    "hostname": is_hostname,
    "idn-hostname": net.idn_host,
    "ipv4": is_ipv4,
    "ipv6": is_ipv6,
    "uri": lambda t: _reference(t, False, True),
    "uri-reference": lambda t: _reference(t, False, False),
    "iri": lambda t: _reference(t, True, True),
    "iri-reference": lambda t: _reference(t, True, False),
    "uri-template": is_template,
    "uuid": lambda t: _UUID.fullmatch(t) is not None,
    "json-pointer": _parses(Pointer.parse),
    "relative-json-pointer": _parses(RelativePointer.parse),
    "regex": is_regex,
}
