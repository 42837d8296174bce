"""Validators of candidate values as SQL expressions; each takes the dialect and the value's expression."""

from __future__ import annotations

# Check weights and alphabets of public standards, and lists that the results depend on.
IDCARD_WEIGHTS = [7, 9, 10, 5, 8, 4, 2, 1, 6, 3, 7, 9, 10, 5, 8, 4, 2]
IDCARD_CHECKS = "10X98765432"
PROVINCES = "11 12 13 14 15 21 22 23 31 32 33 34 35 36 37 41 42 43 44 45 46 50 51 52 53 54 61 62 63 64 65 71 81 82".split()
USCC_CHARS = "0123456789ABCDEFGHJKLMNPQRTUWXY"
USCC_WEIGHTS = [3**i % 31 for i in range(17)]
EMAIL_FILE_ENDINGS = (
    "patch diff tgz whl lock tar gz bz2 xz zst rar 7z rpm deb msi exe dll dylib jar war class rb js ts jsx tsx css scss less html htm xml json yml yaml toml ini cfg "
    "conf txt csv log sql png jpg jpeg gif bmp webp svg ico pdf woff woff2 ttf otf eot mp3 mp4 avi mkv wav flac swp tmp bak orig rej min"
).split()
PUBLIC_DNS = (
    "8.8.8.8 8.8.4.4 1.1.1.1 1.0.0.1 4.2.2.1 4.2.2.2 4.2.2.3 114.114.114.114 114.114.115.115 223.5.5.5 223.6.6.6 119.29.29.29 180.76.76.76 9.9.9.9 208.67.222.222 208.67.220.220"
).split()
DUMMY_HOSTS = "host hostname myhost server myserver example.com example.org example.net test.com sample.com your-host yourhost yourdomain.com".split()
DUMMY_USERS = "user username your_username yourusername usr guest".split()
DUMMY_PASSWORDS = "pass password passwd your_password yourpassword changeme change_me guest".split()


def _in(x: str, values: list[str]) -> str:
    return f"({x} IN ({', '.join(f"'{v}'" for v in values)}))"


def _at(d, x: str, i: int) -> str:
    return d.num(f"substr({x}, {i}, 1)")


def luhn(d, x: str) -> str:
    """Luhn over the digits of a value of 13 to 19 digits; other characters are dropped."""
    digits = d.sub(x, "[^0-9]", "")
    padded = f"lpad({digits}, 19, '0')"
    terms = []
    for i in range(1, 20):
        n = _at(d, padded, i)
        terms.append(n if i % 2 else f"CASE WHEN {n} > 4 THEN {n} * 2 - 9 ELSE {n} * 2 END")
    return f"(length({digits}) BETWEEN 13 AND 19 AND ({' + '.join(terms)}) % 10 = 0)"


def phone(d, x: str) -> str:
    digits = d.sub(x, "[^0-9]", "")
    bare = d.sub(digits, r"\A(0086|86)", "")
    return f"({d.has(bare, r'\A1[3-9][0-9]{9}\z')} AND NOT {d.has(bare, r'\A(1{11}|3{11})\z')})"


def landline(d, x: str) -> str:
    digits = d.sub(d.sub(x, "[^0-9]", ""), r"\A(0086|86)", "")
    return f"(length({digits}) BETWEEN 10 AND 17 AND {d.has(digits, r'\A0([12][0-9]|[3-9][0-9]{2})[2-9]')})"


def idcard(d, x: str, year: int = 2026) -> str:
    """18 characters with a check, or 15 digits; ``year`` is the last birth year that counts."""
    total = " + ".join(f"{_at(d, x, i + 1)} * {w}" for i, w in enumerate(IDCARD_WEIGHTS))
    long_ = (
        f"length({x}) = 18 AND {d.date(f'substr({x}, 7, 4)', f'substr({x}, 11, 2)', f'substr({x}, 13, 2)')} AND {d.num(f'substr({x}, 7, 4)')} BETWEEN 1880 AND {year}"
        f" AND upper(substr({x}, 18, 1)) = substr('{IDCARD_CHECKS}', CAST(({total}) % 11 + 1 AS INT), 1)"
    )
    short = f"length({x}) = 15 AND {d.date(f"'19' || substr({x}, 7, 2)", f'substr({x}, 9, 2)', f'substr({x}, 11, 2)')}"
    return f"({_in(f'substr({x}, 1, 2)', PROVINCES)} AND (({long_}) OR ({short})))"


def uscc(d, x: str) -> str:
    total = " + ".join(f"(instr('{USCC_CHARS}', substr({x}, {i + 1}, 1)) - 1) * {w}" for i, w in enumerate(USCC_WEIGHTS))
    return f"(length({x}) = 18 AND {d.has(x, f'\\A[{USCC_CHARS}]+\\z')} AND instr('{USCC_CHARS}', substr({x}, 18, 1)) - 1 = (31 - ({total}) % 31) % 31)"


def iban(d, x: str) -> str:
    """Remainder 1 modulo 97 of the rearranged value, letters as 10 to 35, by runs of nine digits."""
    moved = f"substr({x}, 5) || substr({x}, 1, 4)"
    for i in range(26):
        moved = f"replace({moved}, '{chr(65 + i)}', '{10 + i}')"
    padded, rest = f"lpad({moved}, 72, '0')", "CAST(0 AS BIGINT)"
    for k in range(8):
        rest = f"(({rest} * 1000000000 + {d.num(f'substr({padded}, {9 * k + 1}, 9)')}) % 97)"
    return f"({d.has(x, r'\A[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}\z')} AND {rest} = 1)"


def email(d, x: str) -> str:
    local, domain = d.first(x, r"\A([^@]*)@", 1), d.first(x, r"@([^@]*)\z", 1)
    tld = d.first(x, r"\.([^.@]*)\z", 1)
    return (
        f"({d.has(x, r'\A[^@]+@[^@]+\z')} AND length({domain}) >= 3 AND {domain} LIKE '%.%' AND NOT {d.has(local, r'\A\.|\.\z|\.\.')} AND {domain} NOT LIKE '%..%'"
        f" AND length({tld}) >= 2 AND NOT {d.has(domain, r'\A([0-9]+\.){2,}[^.]*\z')} AND NOT {_in(f'lower({tld})', EMAIL_FILE_ENDINGS)})"
    )


def ip_public(d, x: str) -> str:
    a, b, c = (d.num(d.first(x, r"\A([0-9]+)\.([0-9]+)\.([0-9]+)\.([0-9]+)\z", g)) for g in (1, 2, 3))
    local = (
        f"{a} IN (0, 10, 127) OR {a} >= 224 OR ({a} = 172 AND {b} BETWEEN 16 AND 31) OR ({a} = 192 AND {b} = 168) OR ({a} = 169 AND {b} = 254) OR ({a} = 100 AND {b} BETWEEN 64 AND 127)"
        f" OR ({a} = 192 AND {b} = 0 AND {c} IN (0, 2)) OR ({a} = 198 AND {b} = 51 AND {c} = 100) OR ({a} = 203 AND {b} = 0 AND {c} = 113) OR ({a} = 192 AND {b} = 88 AND {c} = 99) OR ({a} = 198 AND {b} IN (18, 19))"
    )
    version = d.has(x, r"\A[0-9](\.[0-9]){3}\z|\A[0-9]\.[0-9]+\.0\.[0-9]{3}\z")
    return f"(NOT {_in(x, PUBLIC_DNS)} AND NOT {version} AND NOT ({local}))"


def ipv6(d, x: str, scope: str) -> str:
    """A well-formed IPv6 address in the link-local or unique local ranges, or the global one without 2001:db8."""
    groups = d.count(x, "[0-9A-Fa-f]+")
    doubles = d.count(x, "::")
    formed = (
        f"length({x}) - length(replace({x}, ':', '')) >= 2 AND NOT {d.has(x, '[0-9A-Fa-f]{5}|:::')} AND NOT {d.has(x, r'\A:[^:]|[^:]:\z')}"
        f" AND (({doubles} = 1 AND {groups} <= 7) OR ({doubles} = 0 AND {groups} = 8))"
    )
    ranges = r"\A([Ff][Ee][89ABab][0-9A-Fa-f]|[Ff][CDcd][0-9A-Fa-f]{2}):" if scope == "private" else r"\A[23][0-9A-Fa-f]{3}:"
    more = "" if scope == "private" else f" AND NOT {d.has(x, r'\A2001:0?[dD][bB]8(:|\z)')}"
    return f"({formed} AND {d.has(x, ranges)}{more})"


def jwt(d, x: str) -> str:
    head = f"translate({d.first(x, r'\A([^.]*)\.', 1)}, '-_', '+/')"
    whole = f"rpad({head}, CAST(length({head}) + (4 - length({head}) % 4) % 4 AS INT), '=')"
    return f"CASE WHEN length({head}) % 4 = 1 THEN FALSE ELSE {d.hexed(whole)} LIKE '%22616C6722%' END"


def ssh_key(d, x: str) -> str:
    kind, blob = d.first(x, r"\A([^ \t\r\n]+)[ \t\r\n]+(AAAA[A-Za-z0-9+/]+)", 1), d.first(x, r"\A([^ \t\r\n]+)[ \t\r\n]+(AAAA[A-Za-z0-9+/]+)", 2)
    head = d.hexed(f"substr({blob}, 1, 52)")
    return f"({head} LIKE '000000' || lpad({d.hex(f'CAST(length({kind}) AS BIGINT)')}, 2, '0') || {d.hex(kind)} || '%')"


def connstr(d, password: str, whole: str, right: str) -> str:
    """A real password in a connection string: no wildcard, no template, no known dummy combination."""
    user = f"lower({d.first(whole, r'://([^ \t\r\n:@/]+):', 1)})"
    auth = d.first(f"substr({right}, 1, 256)", "\\A[^ \\t\\r\\n/?#\"'`)>},;]*", 0)
    host = f"lower({d.first(auth, r'\A\[?([^\]:]*)', 1)})"
    port = d.first(auth, r":([^:\]]*)\z", 1)
    template = r"\A(\{[A-Za-z_][A-Za-z0-9_]*\}|<[A-Za-z_][A-Za-z0-9_]*>|\[[A-Za-z_][A-Za-z0-9_]*\]|\$\{[A-Za-z_][A-Za-z0-9_]*\}|\$[A-Za-z_][A-Za-z0-9_]+|%[A-Za-z_][A-Za-z0-9_]*%)\z"
    user_dummy, pass_dummy = _in(user, DUMMY_USERS), _in(f"lower({password})", DUMMY_PASSWORDS)
    host_dummy = f"({_in(host, DUMMY_HOSTS)} OR {d.has(host, r'\.(example|invalid)\z')})"
    return (
        f"(NOT {d.has(password, r'\A[xX*.]+\z')} AND NOT {d.has(password, template)} AND NOT ({port} <> '' AND NOT {d.has(port, '[0-9]')} AND ({user_dummy} OR {pass_dummy}))"
        f" AND NOT ({host_dummy} AND {pass_dummy}) AND NOT ({user_dummy} AND {pass_dummy}))"
    )
