"""Detectors of sensitive values: candidate pattern, boundary checks on both sides, validator.

A candidate that a check rejects still uses up its text, as scanning goes on after it; so candidates are cut
out of the text together with the gaps between them, and checks look at what lies left and right.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from . import validators as V

# Candidate shapes on which results depend.
_KEY = "[A-Za-z0-9_-]"
_PROVINCE = "(?:1[1-5]|2[1-3]|3[1-7]|4[1-6]|5[0-4]|6[1-5]|71|8[12])"
_B64URL = r"[A-Za-z0-9_-]{8,}"
_WS = r"[ \t\r\n]"
_CN_PREFIX = r"(?:\+?86|0086|[(（]\+?86[)）])"
_SECRET_WORDS = "(?:password|passwd|pwd|secret|token|api[_-]?key|access[_-]?key|private[_-]?key|(?:密码|口令|令牌|密钥|秘钥|密匙|凭据|凭证|私钥|授权码|访问密钥|接口密钥))"
_QUOTES = "[\"'“”「」]?"


@dataclass(frozen=True)
class Rule:
    """left/right: what must not stand there (``\\z`` and ``\\A`` mark the side of the value).

    markers: a text without any of these holds no candidate; words: nor does one whose lower case has none of these; digits: nor
    does one without ten digits in close order. after: number of characters of a candidate after its value.
    """

    key: str
    label: str
    pattern: str
    left: str = ""
    right: str = ""
    group: int = 0
    check: Callable | None = None
    on: bool = True
    markers: tuple[str, ...] = ()
    digits: bool = False
    after: int = 0
    words: tuple[str, ...] = ()


def _mixed(sep1: str, sep2: str):
    return lambda d, v, w, lft, r: f"NOT ({v} LIKE '%{sep1}%' AND {v} LIKE '%{sep2}%')"


def _both(*checks):
    return lambda d, v, w, lft, r: " AND ".join(c(d, v, w, lft, r) for c in checks)


def _plain(f, *more):
    return lambda d, v, w, lft, r: f(d, v, *more)


_L, _R = _KEY + r"\z", r"\A" + _KEY
_WORD_L, _WORD_R = r"[A-Za-z0-9_]\z", r"\A[A-Za-z0-9_]"
_IP_L, _IP_R = r"[A-Za-z0-9]\z", r"\A([A-Za-z0-9]|\.[0-9])"

RULES = [
    Rule("det00_prefix_key", "API_KEY", r"(?:sk|ah)[-_][A-Za-z0-9][A-Za-z0-9_-]{7,}", _L, r"\A@openssh\.com", 0,
         lambda d, v, w, lft, r: f"(length({v}) > 22 OR {d.has(f'substr({v}, 4)', '[0-9]')})", markers=("sk-", "sk_", "ah-", "ah_")),
    Rule("det01_private_key", "PRIVATE_KEY", r"-----BEGIN (?:RSA |EC |DSA |OPENSSH |PGP |ENCRYPTED )?PRIVATE KEY-----[\s\S]{20,}?-----END[^-]*PRIVATE KEY-----", on=False, markers=("PRIVATE KEY",)),
    Rule("det02_ssh_pubkey", "SSH_PUBKEY", r"(?:ssh-(?:rsa|dss|ed25519|ed448)|ecdsa-sha2-nistp(?:256|384|521)|sk-(?:ssh-ed25519|ecdsa-sha2-nistp256)@openssh\.com)" + _WS + r"+AAAA[A-Za-z0-9+/]{50,}={0,3}",
         r"[A-Za-z0-9+/=_@.-]\z", r"\A[A-Za-z0-9+/=]", 0, _plain(V.ssh_key), markers=("AAAA",)),
    Rule("det03_github_token", "API_KEY", "gh[pousr]_[A-Za-z0-9_]{20,}", _L, _R, markers=("gh",)),
    Rule("det04_github_pat", "API_KEY", "github_pat_[A-Za-z0-9_]{50,}", _L, _R, markers=("github_pat_",)),
    Rule("det05_google_key", "API_KEY", "AIza[A-Za-z0-9_-]{35,38}", _L, _R, markers=("AIza",)),
    Rule("det06_aliyun_key", "ACCESS_KEY", "LTAI[A-Za-z0-9]{12,20}", _L, _R, on=False, markers=("LTAI",)),
    Rule("det07_tencent_key", "ACCESS_KEY", "AKID[A-Za-z0-9]{13,32}", _L, _R, on=False, markers=("AKID",)),
    Rule("det08_slack_token", "API_KEY", "xox[baprs]-[A-Za-z0-9-]{10,}", _L, _R, markers=("xox",)),
    Rule("det09_stripe_key", "API_KEY", "[sr]k_(?:live|test)_[A-Za-z0-9]{20,}", _L, r"\A[A-Za-z0-9]", markers=("k_live_", "k_test_")),
    Rule("det10_feishu_app", "API_KEY", "cli_[a-z0-9]{16,}", _L, r"\A[a-z0-9]", markers=("cli_",)),
    Rule("det11_dingtalk_key", "API_KEY", "ding[a-z0-9]{12,}", r"[A-Za-z]\z", r"\A[a-z0-9]", 0, lambda d, v, w, lft, r: d.has(v, "[0-9]"), markers=("ding",)),
    Rule("det12_aws_key_id", "ACCESS_KEY", "(?:AKIA|ASIA)[A-Z0-9]{16}", r"[A-Z0-9]\z", r"\A[A-Z0-9]", on=False, markers=("AKIA", "ASIA")),
    Rule("det13_aws_secret", "ACCESS_KEY", "(?i:aws[_-]?secret[_-]?access[_-]?key[\"']?" + _WS + "*[:=]" + _WS + "*[\"']?)([A-Za-z0-9/+=]{40})", "", r"\A[A-Za-z0-9/+=]", 1, on=False, words=("aws",)),
    Rule("det14_jwt", "JWT", rf"eyJ{_B64URL}\.{_B64URL}\.{_B64URL}", _L, _R, 0, _plain(V.jwt), False, markers=("eyJ",)),
    Rule("det15_bearer", "TOKEN", "(?i:Bearer)" + _WS + "+([A-Za-z0-9._~+/=-]{20,})", _WORD_L, "", 1, lambda d, v, w, lft, r: d.has(v, "[^A-Za-z]"), False, words=("bearer",)),
    Rule("det16_secret_pair", "SECRET", f"(?i:{_SECRET_WORDS}){_QUOTES}{_WS}*[:=：＝]{_WS}*{_QUOTES}([A-Za-z0-9!@#$%^&*_~+=.:/#-]{{6,64}})", r"[A-Za-z0-9]\z", r"\A[A-Za-z0-9!@#$%^&*_~+=.:/#-]", 1,
         lambda d, v, w, lft, r: f"({v} NOT LIKE '/%' AND ({d.has(v, '[0-9!@#$%^&*]')} OR (length({v}) >= 8 AND {d.has(v, '[._-]')} AND {d.has(v, r'\A[a-z._-]+\z')})))", False,
         words=("passw", "pwd", "secret", "token", "key", "密码", "口令", "令牌", "密钥", "秘钥", "密匙", "凭据", "凭证", "私钥", "授权码")),
    Rule("det17_connection_string", "CONNSTR", rf"[A-Za-z][A-Za-z0-9+.-]{{0,63}}://[^ \t\r\n:@/]+:([^ \t\r\n@/]{{4,}})@", r"[A-Za-z0-9_]\z", "", 1,
         lambda d, v, w, lft, r: V.connstr(d, v, w, r), markers=("://",), after=1),
    Rule("det18_mobile", "PHONE", _CN_PREFIX + r"[ \t-]?1[3-9][0-9]{9}|1[3-9][0-9]{9}|1[3-9][0-9][- ][0-9]{4}[- ][0-9]{4}", r"[A-Za-z0-9+]\z", _WORD_R, 0,
         _both(_plain(V.phone), lambda d, v, w, lft, r: f"NOT ({d.has(v, r'[0-9]-[0-9]')} AND {d.has(v, r'[0-9] [0-9]')})"), digits=True),
    Rule("det19_email", "EMAIL", r"[A-Za-z0-9_\x{4e00}-\x{9fff}][\x{4e00}-\x{9fff}A-Za-z0-9._%+-]{0,63}@[A-Za-z0-9-][A-Za-z0-9.-]*\.(?:[A-Za-z]{2,}|[\x{4e00}-\x{9fff}]{2,})",
         r"[A-Za-z0-9_.]\z|://[^ \t\r\n]{0,252}:\z", r"\A([A-Za-z0-9]|[._%+-][A-Za-z0-9])", 0, _plain(V.email), markers=("@",)),
    Rule("det20_landline", "LANDLINE", rf"(?:{_CN_PREFIX}[ \t-]?)?(?:[(（]0(?:10|2[0-9]|[3-9][0-9]{{2}})[)）][ \t-]?[2-9][0-9]{{6,7}}|0(?:10|2[0-9]|[3-9][0-9]{{2}})[- \t][2-9][0-9]{{6,7}})(?:[- \t]?(?:转|分机|ext|x|#)[- \t]?[0-9]{{1,5}})?",
         _WORD_L, _WORD_R, 0, _plain(V.landline), digits=True),
    Rule("det21_plate", "PLATE", "[京津沪渝冀豫云辽黑湘皖鲁新苏浙赣鄂桂甘晋蒙陕吉闽贵粤青藏川宁琼使领][A-Z][A-Z0-9]{5,6}", r"[A-Za-z0-9]\z", r"\A[A-Z0-9]", 0, lambda d, v, w, lft, r: d.has(f"substr({v}, 3)", "[0-9]"), False),
    Rule("det22_hkid", "HKID", "H[0-9]{8}", _WORD_L, _WORD_R, on=False),
    Rule("det23_idcard_15", "IDCARD", _PROVINCE + "[0-9]{13}", _WORD_L, _WORD_R, 0, _plain(V.idcard), digits=True),
    Rule("det24_idcard_18", "IDCARD", _PROVINCE + "[0-9]{15}[0-9Xx]", _WORD_L, _WORD_R, 0, _plain(V.idcard), digits=True),
    Rule("det25_ip_local", "IP_PRIVATE", r"(?:192\.168|169\.254)\.[0-9]{1,3}\.[0-9]{1,3}", _IP_L, _IP_R, on=False, markers=("192.168.", "169.254.")),
    Rule("det26_ip_shared", "IP_PRIVATE", r"100\.(?:6[4-9]|[7-9][0-9]|1[01][0-9]|12[0-7])\.[0-9]{1,3}\.[0-9]{1,3}", _IP_L, _IP_R, on=False, markers=("100.",)),
    Rule("det27_ip_internal", "IP_INTERNAL", r"10\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}|172\.(?:1[6-9]|2[0-9]|3[01])\.[0-9]{1,3}\.[0-9]{1,3}", _IP_L, _IP_R, on=False),
    Rule("det28_ipv6_private", "IPV6_PRIVATE", "[0-9A-Fa-f:]{2,45}", r"[0-9A-Fa-f.]\z", r"\A[0-9A-Fa-f:]", 0, _plain(V.ipv6, "private"), False, markers=(":",)),
    Rule("det29_ipv6_public", "IPV6_PUBLIC", "[23][0-9A-Fa-f]{3}(?::[0-9A-Fa-f]{0,4}){2,7}", r"[0-9A-Fa-f.]\z", r"\A[0-9A-Fa-f:]", 0, _plain(V.ipv6, "public"), False, markers=(":",)),
    Rule("det30_ip_public", "IP_PUBLIC", r"(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9][0-9]?)(?:\.(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])){3}", r"[A-Za-z0-9]\z|[A-Za-z0-9][-_.]\z", r"\A([A-Za-z0-9]|[._-][A-Za-z0-9])", 0, _plain(V.ip_public), False, markers=(".",)),
    Rule("det31_card", "CARD", r"[3-6][0-9]{12,18}|[3-6][0-9]{2,5}(?:[ -][0-9]{1,6}){1,4}", _WORD_L, _WORD_R, 0, _both(_mixed(" ", "-"), _plain(V.luhn)), digits=True),
    Rule("det32_iban", "IBAN", "[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}", _WORD_L, _WORD_R, 0, _plain(V.iban), False),
    Rule("det33_uscc", "USCC", "[0-9A-HJ-NPQRTUWXY]{2}[0-9]{6}[0-9A-HJ-NPQRTUWXY]{10}", _WORD_L, _WORD_R, 0, _plain(V.uscc), False),
    Rule("det34_mac", "MAC", "(?:[0-9A-Fa-f]{2}:){5}[0-9A-Fa-f]{2}|(?:[0-9A-Fa-f]{2}-){5}[0-9A-Fa-f]{2}", r"[0-9A-Fa-f:.-]\z", r"\A[0-9A-Fa-f:-]", on=False),
]

#: Labels whose values are credentials.
CREDENTIALS = ("PRIVATE_KEY", "API_KEY", "ACCESS_KEY", "JWT", "TOKEN", "SECRET", "CONNSTR")


def conditions(rule: Rule, d, value: str = "value", whole: str = "whole", left: str = "lft", right: str = "rgt") -> str:
    """Whether a candidate survives, as SQL."""
    parts = []
    if rule.left:
        parts.append(f"NOT {d.has(left, rule.left)}")
    if rule.right:
        parts.append(f"NOT {d.has(right, rule.right)}")
    if rule.check:
        parts.append(f"({rule.check(d, value, whole, left, right)})")
    return " AND ".join(parts) or "TRUE"
