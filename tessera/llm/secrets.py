"""Secret scans: base patterns, and a lexer of assignments that folds values and follows constants to sensitive names."""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter, defaultdict

from pyspark.sql import DataFrame

from .common import with_arrays

#: Base patterns (fixed values of the contract), with ASCII letters in either case for assign alone.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")  # a run of 32 or more: shorter runs are dropped whole
KINDS = ("assign", "access", "hex", "literal")
MIN_ASSIGN, MIN_ACCESS = 8, 16

#: What names of secrets contain, joined lower-case parts, with scores.
SENSITIVE = {
    "password": 3, "passwd": 3, "passphrase": 3, "pwd": 2, "secret": 3, "token": 2, "apikey": 3, "accesskey": 3, "privatekey": 3, "credential": 3,
    "credentials": 3, "bearer": 2, "authkey": 3, "signingkey": 3, "encryptionkey": 3, "clientsecret": 3, "connectionstring": 2, "pass": 2, "auth": 1,
}
#: Parts that say the value is about a secret, not one.
HARMLESS = frozenset("count length len size limit max min type name field label path file url uri hint prompt policy expiry expires ttl id regex pattern rate".split())
PLACEHOLDERS = frozenset("changeme change_me password secret token example placeholder undefined none null true false redacted your_password your_token".split())
NAME_PART = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+")

#: What leads to a value: a name and an operator, as source and configuration write them, or an element's tag.
TARGET = re.compile(
    r"""(?<![A-Za-z0-9_.\-])(["']?)([A-Za-z_][A-Za-z0-9_.\-]*+)\1[\x20\t]*(?::[\x20\t]*(?:str|string|String)[\x20\t]*=|:=|=>|=(?![=>])|:(?![:/]))[\x20\t]*"""
    r"""|<([A-Za-z_][A-Za-z0-9_.\-]*+)(?:\x20[^<>\n]*+)?(?<!/)>"""
)
TERM = re.compile(
    r"""[bBrRuUfF]{0,2}(?:"{3}([^"\\]*+(?:(?:\\.|"(?!""))[^"\\]*+)*+)"{3}|'{3}([^'\\]*+(?:(?:\\.|'(?!''))[^'\\]*+)*+)'{3}"""
    r"""|"([^"\\]*+(?:\\.[^"\\]*+)*+)"|'([^'\\]*+(?:\\.[^'\\]*+)*+)'|`([^`]*+)`)|([A-Za-z0-9+/_.=\-]++)""",
    re.S,
)
TRIPLE, BARE = 2, 6  # groups of TERM: up to the one, after the quoted ones
#: What joins terms: an operator, or nothing between quoted strings, which a backslash may break into lines.
JOIN = re.compile(r"[\x20\t]*(?:[+&.]|\.\.)[\x20\t]*(?=[\"'`A-Za-z_])")
ADJACENT = re.compile(r"[\x20\t]*(?:\\\n[\x20\t]*)?(?=[\"'])")
#: A block scalar: its mark behind the operator, then lines deeper than the name's own.
BLOCK = re.compile(r"[|>][0-9+\-]{0,2}[\x20\t]*\n((?:[\x20\t]*\n)*+)([\x20]++)")
ELEMENT = re.compile(r"[\x20\t\n]*([^<>]*?)[\x20\t\n]*</")
IDENTIFIER = re.compile(r"[A-Za-z_][A-Za-z0-9_.\-]*+\Z")
ARMOUR = re.compile(r"-----(?:BEGIN|END) [A-Z0-9 ]+-----")


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the base patterns, leftmost and non-overlapping in each kind, by start and kind."""
    found = []
    if "=" in text or ":" in text:
        found += [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= MIN_ASSIGN]
    if "AKIA" in text:
        found += [("access", m.start(), m.end()) for m in ACCESS.finditer(text) if len(m[0]) >= MIN_ACCESS]
    found += [("hex", m.start(), m.end()) for m in HEX.finditer(text)]
    return in_order(found)


def in_order(spans):
    return sorted(spans, key=lambda x: (x[1], KINDS.index(x[0]), x[2]))


def name_score(name: str) -> int:
    parts = [p.lower() for p in NAME_PART.findall(name)]
    if not parts or parts[-1] in HARMLESS:
        return 0
    pairs = [a + b for a, b in zip(parts, parts[1:], strict=False)]
    return max((SENSITIVE.get(x, 0) for x in [*parts, *pairs]), default=0)


def literal_score(value: str) -> int:
    """0 for what can't be a secret: short, with spaces, a placeholder, or of little entropy. Lines count as one value, without armour and indents."""
    if "\n" in value:
        value = "".join(x for line in value.split("\n") if not ARMOUR.fullmatch(x := line.strip()))
    low = value.lower()
    if len(value) < 8 or any(c.isspace() for c in value) or low in PLACEHOLDERS or re.match(r"\$|<|%[({]|\{\{|https?:|/|\*+$|x+$", low):
        return 0
    n = len(value)
    entropy = -sum(k / n * math.log2(k / n) for k in Counter(value).values())
    kinds = sum(any(f(c) for c in value) for f in (str.islower, str.isupper, str.isdigit)) + any(not c.isalnum() for c in value)
    return (entropy >= 2.5) + (entropy >= 3.2) + (kinds >= 2)


def _trimmed(text: str, a: int, b: int) -> tuple[int, int, str]:
    """A span without the white space around it."""
    value = text[a:b]
    a += len(value) - len(value.lstrip())
    value = value.strip()
    return a, a + len(value), value


def _block(text: str, name: int, m: re.Match) -> tuple[int, int]:
    """The lines of a block scalar: those as deep as its first one, which must be deeper than the name's own line."""
    depth, line = len(m[2]), text.rfind("\n", 0, name) + 1
    own = len(text[line:name]) - len(text[line:name].lstrip(" "))
    at = end = m.start(2)
    while depth > own and at < len(text):
        stop = text.find("\n", at)
        stop = len(text) if stop < 0 else stop
        if text.startswith(" " * depth, at):
            end = stop
        elif text[at:stop].strip():
            break
        at = stop + 1
    return m.start(2), end


def assignments(text: str):
    """(name, terms) of each assignment; terms are those that make up its value, joined by operators or adjacent as strings: (start, end,
    value, whether it is bare), all terms of one value in a row. Quoted strings, block scalars and the text of elements are literals.

    Strings of several lines or in triple quotes are taken without the white space around them; what they hold is searched for assignments
    too, whose values are single terms."""
    at = horizon = 0  # up to the horizon terms have been joined already
    while m := TARGET.search(text, at):
        where = at = m.end()
        joins = m.start() >= horizon
        inside, terms = None, []
        if m[3]:
            inside = m.end(3)  # attributes are assignments
            if (e := ELEMENT.match(text, where)) and e[1]:
                terms = [(*_trimmed(text, e.start(1), e.end(1)), False)]
        elif k := BLOCK.match(text, where):
            a, b = _block(text, m.start(), k)
            if a < b:
                terms, inside = [(*_trimmed(text, a, b), False)], a
        else:
            while t := TERM.match(text, where):
                k, at = t.lastindex, t.end()
                a, b, value = t.start(k), t.end(k), t[k]
                if k != BARE and (k <= TRIPLE or "\n" in value):
                    inside = a if inside is None else inside
                    a, b, value = _trimmed(text, a, b)
                terms.append((a, b, value, k == BARE))
                j = joins and (JOIN.match(text, at) or k != BARE and ADJACENT.match(text, at))
                if not j:
                    break
                where = j.end()
        horizon = max(horizon, at)
        at = at if inside is None else inside
        if terms:
            yield m[2] or m[3], terms


def literal_spans(text: str, threshold: int = 4) -> list[tuple[str, int, int]]:
    """Literals that reach a sensitive name, directly or by names that hold them, with a high enough joint score.

    An unquoted term is a reference if the text assigns its name; other names without digits are no literals. A value of several
    terms is folded, references replaced by the values first assigned to them, and scored as a whole: if it is a secret so are all literals in it."""
    if "=" not in text and ":" not in text and "</" not in text:
        return []
    found = list(assignments(text))
    names = {name for name, _ in found}
    values, score = defaultdict(list), {}
    for name, terms in found:
        values[name].append([(a, b, v, bare and v in names) for a, b, v, bare in terms if not bare or v in names or not IDENTIFIER.match(v) or any(c.isdigit() for c in v)])
        score[name] = max(score.get(name, 0), name_score(name))
    queue = [n for n in score if score[n]]
    while queue:  # from sensitive targets back to the constants that they take
        name = queue.pop()
        for _, _, v, is_name in (t for terms in values[name] for t in terms):
            if is_name and score[v] < score[name]:
                score[v] = score[name]
                queue.append(v)
    sensitive = [n for n in score if score[n]]
    out = {(a, b) for n in sensitive for terms in values[n] for a, b, v, is_name in terms if not is_name and (k := literal_score(v)) and score[n] + k >= threshold}
    for n in sensitive:
        for terms in values[n]:
            if len(terms) > 1 and (folded := _folded(terms, values, len(text))):
                whole, parts = folded
                if (k := literal_score(whole)) and score[n] + k >= threshold:
                    out.update(parts)
    return in_order(("literal", a, b) for a, b in out)


def _folded(terms, values, limit: int) -> tuple[str, list] | None:
    """(the value of joined terms, spans of the literals in it); None where it has references in a circle or is longer than the whole text."""
    whole, parts, size = [], [], 0
    todo = [(t, ()) for t in reversed(terms)]
    while todo:
        (a, b, v, is_name), via = todo.pop()
        if is_name:
            if v in via or len(via) > 50:
                return None
            todo += [(t, (*via, v)) for t in reversed(values[v][0])]
        else:
            whole.append(v)
            if a < b:
                parts.append((a, b))
            size += len(v) + 1
        if size > limit or len(todo) > limit:
            return None
    return "".join(whole), parts


def spans(text: str | None) -> tuple[list, list]:
    """(base spans, all spans): the lexer's literals join where no base span covers a part of them."""
    if not text:
        return [], []
    base = base_spans(text)
    more = [s for s in literal_spans(text) if not any(s[1] < b and a < s[2] for _, a, b in base)]
    return base, in_order(base + more)


def joined(found) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in found)


def redact(text: str | None, found, mark: str = "[SECRET]") -> str | None:
    """The text with each span, overlapping ones as one, replaced."""
    if not found:
        return text
    out, at = [], 0
    for _, a, b in found:
        if a >= at:
            out += [text[at:a], mark]
        at = max(at, b)
    return "".join(out) + text[at:]


def scan(docs: DataFrame) -> DataFrame:
    """docs with n_assign, n_access, n_hex, base_sha256, spans and clean_text (spans replaced by a mark).

    A null or empty text has no spans (and a clean_text like it). Rows are independent: nothing is shuffled, equal
    rows get equal results, an empty table gives an empty one. Spans are in code points, end exclusive."""
    import pyarrow as pa

    def make():
        def of(b):
            rows = []
            for text in b.column("text").to_pylist():
                base, every = spans(text)
                n = Counter(k for k, _, _ in base)
                rows.append((n["assign"], n["access"], n["hex"], hashlib.sha256(joined(base).encode()).hexdigest(), joined(every), redact(text, every)))
            return [pa.array(x, t) for x, t in zip(zip(*rows, strict=True), [pa.int64()] * 3 + [pa.string()] * 3, strict=True)]

        return of

    return with_arrays(docs, make, "n_assign long, n_access long, n_hex long, base_sha256 string, spans string, clean_text string")
