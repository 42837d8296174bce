"""Masking and restoring of one text, for Arrow batches: rules in order, each on what the one before it left."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import lru_cache

from . import checks as C
from .detectors import RULES, Rule
from .matching import WORD_CHARS, Dictionary, Pattern

# The placeholder's format, and how models are known to deform it.
CONSONANTS = "bcdfghjkmnpqrstvwxz"
SUFFIX = f"(?:[0-9a-f]{{6}}|[{CONSONANTS}]{{6}})"
PLACEHOLDER = rf"\{{\{{[A-Z0-9]{{1,12}}_{SUFFIX}\}}\}}"
BRACED = rf"\{{\{{\s*([A-Za-z0-9_]{{1,12}})_((?i:{SUFFIX}))\s*\}}\}}"
ESCAPED = rf"(?i)(?:\\{{0,3}}\{{){{1,3}}(?:\\{{0,3}})\s*([A-Za-z0-9_]{{1,12}})_({SUFFIX})\s*(?:\\{{0,3}}\}}){{1,3}}"
LOOSE = rf"\{{{{1,2}}\s*([A-Za-z0-9_]{{1,12}}_(?i:{SUFFIX}))\s*\}}{{0,2}}|([A-Z0-9]{{1,12}}_(?i:{SUFFIX}))"
PREFIXES = ("sk-", "ah-")

_PLACEHOLDER, _BRACED, _ESCAPED, _LOOSE, _ENDED = (re.compile(p) for p in (PLACEHOLDER, BRACED, ESCAPED, LOOSE, f"_(?i:{SUFFIX})"))
_CREDENTIAL = frozenset(("PRIVATE_KEY", "API_KEY", "ACCESS_KEY", "JWT", "TOKEN", "SECRET", "CONNSTR"))
_TEN_DIGITS = re.compile("[0-9](?:[^0-9]{0,2}[0-9]){9}")


@dataclass(frozen=True)
class Settings:
    """What is masked, and how.

    labels: those that are on (default: the rules' own switch); rules: keys of the only rules that run; prefixes: of
    secret keys, ``-`` and ``_`` alike; words: (word, label) of the dictionary, ASCII letters in any case, the longest
    first, at most 200 characters, single letters only where no word character or Chinese one adjoins; a word
    that begins with ``re:`` is a pattern; whole: words (any case) that no ASCII word character may adjoin; labels_off and
    words_off ((label, word)) are skipped; patterns: (name, pattern) of the user, bad ones are skipped;
    actions: (label, ``mask``, ``warn`` or ``block``): warned values stay and count, unless they are credentials; blocked
    ones are masked and reported; allow: values that stay, by trimmed lower case.
    """

    labels: frozenset[str] | None = None
    rules: frozenset[str] | None = None
    prefixes: tuple[str, ...] = PREFIXES
    words: tuple[tuple[str, str], ...] = ()
    whole: frozenset[str] = frozenset()
    labels_off: frozenset[str] = frozenset()
    words_off: frozenset[tuple[str, str]] = frozenset()
    patterns: tuple[tuple[str, str], ...] = ()
    actions: tuple[tuple[str, str], ...] = ()
    allow: frozenset[str] = frozenset()

    def runs(self, rule: Rule) -> bool:
        if self.rules is not None:
            return rule.key in self.rules
        return rule.label in self.labels if self.labels is not None else rule.on


@lru_cache(1 << 12)
def safe_label(label: str) -> str:
    return re.sub("[^A-Z0-9]", "", label.upper())[:12] or "TERM"


def token_of(key: str, label: str, value: str, counter: int = 0) -> str:
    """``{{LABEL_suffix}}`` with a keyed suffix of six consonants."""
    digest = hashlib.sha256(f"{key}|{counter}|{value}".encode()).digest()
    return "{{%s_%s}}" % (safe_label(label), digest[:6].translate(_LETTERS).decode())


_LETTERS = bytes(ord(CONSONANTS[b % 19]) for b in range(256))


@dataclass
class Masked:
    """A masked text; hits: token of each (label, value) that it replaces, in order of first replacement."""

    text: str
    hits: dict[tuple[str, str], str] = field(default_factory=dict)
    warned: int = 0
    warned_labels: set[str] = field(default_factory=set)
    blocked_labels: set[str] = field(default_factory=set)


#: By rule: whether a candidate's value is one, given the match and the text.
_VALID: dict[str, Callable[[str, re.Match, str], bool]] = {
    "det02_ssh_pubkey": lambda v, m, t: C.ssh_key(v),
    "det11_dingtalk_key": lambda v, m, t: bool(re.search("[0-9]", v)),
    "det14_jwt": lambda v, m, t: C.jwt(v),
    "det15_bearer": lambda v, m, t: bool(re.search("[^A-Za-z]", v)),
    "det16_secret_pair": lambda v, m, t: not v.startswith("/") and bool(re.search("[0-9!@#$%^&*]", v) or (len(v) >= 8 and re.search("[._-]", v) and re.fullmatch("[a-z._-]+", v))),
    "det17_connection_string": lambda v, m, t: C.connstr(v, m[0], t[m.end() : m.end() + 256]),
    "det18_mobile": lambda v, m, t: C.phone(v) and not (re.search("[0-9]-[0-9]", v) and re.search("[0-9] [0-9]", v)),
    "det19_email": lambda v, m, t: C.email(v),
    "det20_landline": lambda v, m, t: C.landline(v),
    "det21_plate": lambda v, m, t: bool(re.search("[0-9]", v[2:])),
    "det23_idcard_15": lambda v, m, t: C.idcard(v),
    "det24_idcard_18": lambda v, m, t: C.idcard(v),
    "det28_ipv6_private": lambda v, m, t: v.count(":") >= 2 and C.ipv6(v, True),
    "det29_ipv6_public": lambda v, m, t: C.ipv6(v, False),
    "det30_ip_public": lambda v, m, t: C.ip_public(v),
    "det31_card": lambda v, m, t: not (" " in v and "-" in v) and C.luhn(v),
    "det32_iban": lambda v, m, t: C.iban(v),
    "det33_uscc": lambda v, m, t: C.uscc(v),
}


def compiled(pattern: str) -> re.Pattern:
    """A rule's pattern, which keeps to what the engines of SQL share, for Python."""
    return re.compile(re.sub(r"\\x\{([0-9a-f]{4})\}", r"\\u\1", pattern).replace(r"\z", r"\Z"))


class Masker:
    """Compiled settings; one for each worker."""

    def __init__(self, settings: Settings, key: str):
        self.key, self.settings = key, settings
        self.actions = {a.strip().upper(): b.strip().lower() for a, b in settings.actions}
        self.allow = {v.strip().lower() for v in settings.allow}
        self.prefixes = [p for p in settings.prefixes if p]
        alike = lambda p: re.sub(r"\\?[-_]", "[-_]", re.escape(p))
        self.prefix = re.compile(f"(?:{'|'.join(map(alike, self.prefixes))})[A-Za-z0-9][A-Za-z0-9_-]{{7,}}") if self.prefixes else None
        api_key_on = "API_KEY" in settings.labels if settings.labels is not None else settings.rules is None or "det00_prefix_key" in settings.rules
        self.prefix = self.prefix if api_key_on else None
        kept = sorted({(w, n) for w, n in settings.words if 0 < len(w) <= WORD_CHARS}, key=lambda r: (-len(r[0]), r[0]))
        self.words: dict[str, tuple[str, str]] = {}
        for w, label in kept:
            if not w.startswith("re:"):
                self.words.setdefault(_lower(w), (w, label))
        self.dictionary = Dictionary(list(self.words)).find if self.words else None
        self.whole = {w.lower() for w in settings.whole}
        self.patterns = []
        for label, pattern in [*((n, w[3:]) for w, n in kept if w.startswith("re:")), *((safe_label(n.strip() or "CUSTOM"), p) for n, p in settings.patterns if p.strip())]:
            try:
                self.patterns.append((label, Pattern(pattern)))
            except ValueError:
                continue
        self.stages = [*([self.prefix_spans] if self.prefix else []), *([self.word_spans] if self.dictionary else []), *(self._pattern_spans(*p) for p in self.patterns)]
        self.rules = [(r, compiled(r.pattern), compiled(r.left) if r.left else None, compiled(r.right) if r.right else None, _VALID.get(r.key)) for r in RULES[1:] if settings.runs(r)]

    def token(self, out: Masked, late: dict, value: str, label: str) -> str | None:
        """The value's token, or None where policy lets it stay."""
        if self.allow and value.strip().lower() in self.allow:
            return None
        action = self.actions.get(label)
        if action == "warn" and label not in _CREDENTIAL:
            out.warned += 1
            out.warned_labels.add(label)
            return None
        if action == "block":
            out.blocked_labels.add(label)
        name = safe_label(label)
        if (name, value) not in out.hits:
            out.hits[name, value] = late.get((name, value)) or token_of(self.key, label, value)
        return out.hits[name, value]

    def run(self, text: str, late: dict | None = None) -> Masked:
        """``text`` masked; ``late`` holds the tokens of values whose first one belongs to another value."""
        out, late = Masked(text), late or {}
        for spans in self.stages:
            out.text = spliced(out.text, [(a, b, t) for a, b, value, label in spans(out.text) if (t := self.token(out, late, value, label))])
        exempt: list[str] = []
        ten = None
        for rule, pattern, left, right, valid in self.rules:
            if rule.digits:
                ten = bool(_TEN_DIGITS.search(out.text)) if ten is None else ten
                if not ten:
                    continue
            elif rule.markers:
                for m in rule.markers:
                    if m in out.text:
                        break
                else:
                    continue
            if not pattern.search(out.text):
                continue
            found = self.rule_spans(out.text, rule, pattern, left, right, valid, exempt)
            spans_ = [(a, b, t) for a, b, value, label in found if (t := self.token(out, late, value, label))]
            if spans_:
                out.text, ten = spliced(out.text, spans_), None
        return out

    def prefix_spans(self, text: str) -> Iterator[tuple[int, int, str, str]]:
        if not self.prefix or not any(p[:-1] in text for p in self.prefixes):
            return
        for m in self.prefix.finditer(text):
            tail = next(len(m[0]) - len(p) for p in self.prefixes if re.sub("_", "-", m[0]).startswith(re.sub("_", "-", p)))
            named = re.match("[A-Za-z0-9_-]", text[m.start() - 1 : m.start()]) if m.start() else None
            if named or text.startswith("@openssh.com", m.end()) or (tail <= 19 and not re.search("[0-9]", m[0][-tail:])):
                continue
            yield m.start(), m.end(), m[0], "API_KEY"

    def word_spans(self, text: str) -> Iterator[tuple[int, int, str, str]]:
        if not self.dictionary:
            return
        held = [m.span() for m in _PLACEHOLDER.finditer(text)] if "{{" in text else []
        for a, b, key in self.dictionary(_lower(text)):
            word, label = self.words[key]
            if label in self.settings.labels_off or (label, word) in self.settings.words_off:
                continue
            single = len(word) == 1
            if single or word.lower() in self.whole:
                near = r"[A-Za-z0-9_\u4e00-\u9fff]" if single else "[A-Za-z0-9_]"
                if (a and re.match(near, text[a - 1])) or re.match(near, text[b : b + 1]):
                    continue
            if not any(s <= a and b <= e for s, e in held):
                yield a, b, word, label

    def _pattern_spans(self, label: str, pattern: Pattern):
        def spans(text: str) -> Iterator[tuple[int, int, str, str]]:
            held = [m.span() for m in _PLACEHOLDER.finditer(text)] if "{{" in text else []
            for a, b in pattern.find(text):
                if not any(s <= a and b <= e for s, e in held):
                    yield a, b, text[a:b], label

        return spans

    def rule_spans(self, text: str, rule: Rule, pattern, left, right, valid, exempt: list[str]) -> Iterator[tuple[int, int, str, str]]:
        """Values of one rule: candidates from left to right that touch no placeholder, whose neighbours fit and that are valid."""
        held = _PLACEHOLDER.finditer(text) if "{{" in text else iter(())
        at = next(held, None)
        for m in pattern.finditer(text):
            while at and at.end() <= m.start():
                at = next(held, None)
            if at and at.start() < m.end():
                continue
            if (left and left.search(text[max(0, m.start() - 256) : m.start()])) or (right and right.match(text[m.end() : m.end() + 16])):
                continue
            a, b = m.span(rule.group)
            if valid and not valid(text[a:b], m, text):
                if rule.key == "det17_connection_string" and len(exempt) < 512:
                    exempt.append(C.exempt_stretch(text, m.start(), m.end()))
                continue
            if rule.key == "det19_email" and any(m[0] in x or x in m[0] for x in exempt):
                continue
            yield a, b, text[a:b], rule.label


def _lower(text: str) -> str:
    """A-Z in lower case; no other letter changes, so positions stay."""
    return text.translate(_FOLD)


_FOLD = {c: c + 32 for c in range(65, 91)}


def spliced(text: str, spans: list[tuple[int, int, str]]) -> str:
    """``text`` with each span, in order, replaced."""
    if not spans:
        return text
    out, last = [], 0
    for a, b, by in spans:
        if a >= last:
            out += [text[last:a], by]
            last = b
    return "".join([*out, text[last:]])


def suffixes(text: str) -> set[str]:
    """Suffixes of all that may be a placeholder, in lower case."""
    if "_" not in text:
        return set()
    return {m[0][1:].lower() for m in re.finditer(f"_(?i:{SUFFIX})", text)}


def may_hold(text: str) -> bool:
    """Whether a text may hold a placeholder, however deformed: each form has a suffix."""
    return "_" in text and _ENDED.search(text) is not None


class Asked(dict):
    """Known tokens of which there are none: it keeps the suffixes that it is asked for."""

    def get(self, key, default=None):
        self[key] = default
        return default


@dataclass
class Restored:
    text: str
    restored: int = 0
    degraded: int = 0
    unresolved: int = 0
    samples: list[str] = field(default_factory=list)

    def missing(self, sample: str) -> str:
        self.unresolved += 1
        if len(self.samples) < 5 and sample not in self.samples:
            self.samples.append(sample)
        return sample


def json_escaped(value: str) -> str:
    short = {'"': '\\"', "\\": "\\\\", "\n": "\\n", "\r": "\\r", "\t": "\\t"}
    return re.sub(r'["\\\x00-\x1f]', lambda m: short.get(m[0]) or f"\\u{ord(m[0]):04x}", value)


def canonical(label: str, suffix: str) -> str:
    return "{{%s_%s}}" % (safe_label(label), suffix.lower())


def restored(text: str, known: dict[str, dict[str, str]], escape: bool = False, session: bool = True) -> Restored:
    """``text`` with placeholders put back, in passes: braced ones, escaped ones, then bare or half-braced ones.

    ``known``: by suffix, the tokens that have it and their values. Without a session nothing is restored and
    braced placeholders are counted. A bare one counts as unresolved only if its suffix is known.
    """
    out = Restored(text)
    if not may_hold(text):
        return out
    if not session:
        for m in _BRACED.finditer(text):
            out.missing(m[0])
        return out
    shown = json_escaped if escape else lambda v: v

    def found(token: str) -> str | None:
        return known.get(token[:-2].rpartition("_")[2].lower(), {}).get(token)

    def put(m: re.Match, value: str, changed: bool) -> str:
        out.restored += 1
        out.degraded += changed
        return shown(value)

    def braced(m: re.Match) -> str:
        token = canonical(m[1], m[2])
        value = found(token)
        return put(m, value, m[0] != token) if value is not None else out.missing(m[0])

    def escaped(m: re.Match) -> str:
        value = found(canonical(m[1], m[2]))
        if value is not None:
            return put(m, value, True)
        return out.missing(m[0]) if "\\" in m[0] else m[0]

    def loose(m: re.Match) -> str:
        whole = m[0]
        if whole.startswith("{{") and whole.endswith("}}"):
            return whole
        body = (m[1] or m[2]).strip()
        label, _, suffix = body.rpartition("_")
        own = known.get(suffix.lower(), {})
        value = own.get("{{%s}}" % body)
        if value is None and len(own) == 1 and set(suffix.lower()) <= set(CONSONANTS):
            token, only = next(iter(own.items()))
            value = only if safe_label(label) == safe_label(token[2:-2].rpartition("_")[0]) else None
        if value is not None:
            return put(m, value, True)
        credible = whole.startswith("{") or bool(own)
        return out.missing(whole) if credible and not m.string[: m.start()].endswith("\\") else whole

    out.text = _BRACED.sub(braced, out.text)
    if "\\" in out.text:
        out.text = _ESCAPED.sub(escaped, out.text)
    if may_hold(out.text):
        out.text = _LOOSE.sub(loose, out.text)
    return out
