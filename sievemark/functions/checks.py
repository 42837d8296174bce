"""Validators of candidate values in plain Python, for masking inside Arrow batches; the SQL ones of ``validators`` agree."""

from __future__ import annotations

import base64
import binascii
import datetime
import ipaddress
import re

from . import validators as V


def digits(value: str) -> str:
    return _OTHER.sub("", value)


def bare(value: str) -> str:
    """Digits without the country's code."""
    return _COUNTRY.sub("", digits(value))


_OTHER, _COUNTRY, _MOBILE, _NUMBERS = (re.compile(p) for p in ("[^0-9]", r"\A(?:0086|86)", "1[3-9][0-9]{9}", r"(?:[0-9]+\.){2,}[^.]*"))


def luhn(value: str) -> bool:
    d = [int(c) for c in reversed(digits(value))]
    return 13 <= len(d) <= 19 and (sum(d[::2]) + sum(2 * x - 9 * (x > 4) for x in d[1::2])) % 10 == 0


def phone(value: str) -> bool:
    d = bare(value)
    return bool(_MOBILE.fullmatch(d)) and len(set(d)) > 1


def landline(value: str) -> bool:
    d = bare(value)
    return 10 <= len(d) <= 17 and bool(re.match("0(?:[12][0-9]|[3-9][0-9]{2})[2-9]", d))


def real_date(year: str, month: str, day: str) -> bool:
    try:
        datetime.date(int(year), int(month), int(day))
    except ValueError:
        return False
    return True


def idcard(value: str, year: int = 2026) -> bool:
    if value[:2] not in V.PROVINCES:
        return False
    if len(value) == 15:
        return real_date("19" + value[6:8], value[8:10], value[10:12])
    if len(value) != 18 or not real_date(value[6:10], value[10:12], value[12:14]) or not 1880 <= int(value[6:10]) <= year:
        return False
    return V.IDCARD_CHECKS[sum(int(c) * w for c, w in zip(value, V.IDCARD_WEIGHTS)) % 11] == value[17].upper()


def uscc(value: str) -> bool:
    at = [V.USCC_CHARS.find(c) for c in value]
    return len(at) == 18 and min(at) >= 0 and at[17] == (31 - sum(a * w for a, w in zip(at, V.USCC_WEIGHTS)) % 31) % 31


def iban(value: str) -> bool:
    return int("".join(str(int(c, 36)) for c in value[4:] + value[:4])) % 97 == 1


def email(value: str) -> bool:
    local, _, domain = value.rpartition("@")
    top = domain.rpartition(".")[2]
    return (
        "@" not in local and len(domain) >= 3 and "." in domain and ".." not in value and not local.startswith(".") and not local.endswith(".")
        and len(top) >= 2 and not _NUMBERS.fullmatch(domain) and top.lower() not in V.EMAIL_FILE_ENDINGS
    )


#: IPv4 networks that no public address lies in.
_LOCAL = [ipaddress.ip_network(n) for n in ("0.0.0.0/8", "10.0.0.0/8", "127.0.0.0/8", "224.0.0.0/3", "172.16.0.0/12", "192.168.0.0/16", "169.254.0.0/16", "100.64.0.0/10", "192.0.0.0/24", "192.0.2.0/24", "198.51.100.0/24", "203.0.113.0/24", "192.88.99.0/24", "198.18.0.0/15")]


def ip_public(value: str) -> bool:
    if value in V.PUBLIC_DNS or re.fullmatch(r"[0-9](?:\.[0-9]){3}|[0-9]\.[0-9]+\.0\.[0-9]{3}", value):
        return False
    return not any(ipaddress.IPv4Address(value) in n for n in _LOCAL)


def ipv6(value: str, private: bool) -> bool:
    try:
        n = int(ipaddress.IPv6Address(value))
    except ValueError:
        return False
    if private:
        return n >> 118 == 0xFE80 >> 6 or n >> 121 == 0xFC00 >> 9
    return n >> 125 == 1 and n >> 96 != 0x20010DB8


def jwt(value: str) -> bool:
    head = value.partition(".")[0]
    try:
        return b'"alg"' in base64.b64decode(head + "=" * (-len(head) % 4), b"-_")
    except (binascii.Error, ValueError):
        return False


def ssh_key(value: str) -> bool:
    kind, blob = value.split()[:2]
    head = base64.b64decode(blob[:52])
    return head.startswith(len(kind).to_bytes(4, "big") + kind.encode())


#: Passwords that are templates.
_TEMPLATE = re.compile(r"\{[A-Za-z_]\w*\}|<[A-Za-z_]\w*>|\[[A-Za-z_]\w*\]|\$\{[A-Za-z_]\w*\}|\$[A-Za-z_]\w+|%[A-Za-z_]\w*%", re.ASCII)
_AUTHORITY = re.compile(r"[^ \t\r\n/?#\"'`)>},;]*")


def connstr(password: str, whole: str, right: str) -> bool:
    """A real password: no wildcard, no template, no known dummy combination."""
    if re.fullmatch("[xX*.]+", password) or _TEMPLATE.fullmatch(password):
        return False
    user = re.search("://([^ \t\r\n:@/]+):", whole)[1].lower()
    authority = _AUTHORITY.match(right[:256])[0]
    host = re.match(r"\[?([^\]:]*)", authority)[1].lower()
    port = (re.search(r":([^:\]]*)\Z", authority) or ["", ""])[1]
    user_dummy, pass_dummy = user in V.DUMMY_USERS, password.lower() in V.DUMMY_PASSWORDS
    host_dummy = host in V.DUMMY_HOSTS or host.endswith((".example", ".invalid"))
    if port and not re.search("[0-9]", port) and (user_dummy or pass_dummy):
        return False
    return not (pass_dummy and (host_dummy or user_dummy))


def exempt_stretch(text: str, start: int, end: int) -> str:
    """A rejected connection string up to the end of its authority: e-mail addresses within it are none."""
    stop = re.compile(r"[\s/?#;`\"',}\])<>]").search(text, end)
    return text[start : stop.start() if stop else len(text)][:256]
