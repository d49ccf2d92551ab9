"""Secret scans by assignment-aware lexing.

A text is read as source and configuration syntax: assignments ``name = literal``, ``name: literal``,
``name => literal``, ``"name": literal`` and ``<name>literal</name>`` become name-literal pairs. Names
assigned from other names or joined literals (``a = b``, ``a = "x" + b``) take over the constants they
stand for. A literal is scored by how sensitive the target names are that it reaches and by whether it
looks like a placeholder. An unquoted value that is no name is one literal up to white space, a quote, a
bracket, a comma or a semicolon, so ``- / + = & #`` belong to it. Three fixed kinds (assign, access, hex) are found besides, whatever the score.

Spans count code points, end exclusive. Defined results: a null or empty text has no spans; a span found
as several kinds is listed once per kind; repeated rows are scanned each by itself; extra columns stay
untouched; the whole text is read, however long.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from serploom.llm.common import bytes_of, fresh

#: fixed kinds, in the order in which equal starts are listed; "named" is what the lexing adds
KINDS = ("assign", "access", "hex", "named")
ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
MIN_ASSIGNED, MIN_ACCESS = 8, 16
MASK = "[secret]"

#: sensitivity of name parts, 0 to 1 (fixed values)
NAME_PARTS = {
    "password": 1.0, "passwd": 1.0, "passphrase": 1.0, "pwd": 0.9, "pass": 0.6, "secret": 1.0, "token": 0.9,
    "apikey": 1.0, "credential": 0.9, "credentials": 0.9, "privatekey": 1.0, "accesskey": 1.0, "authkey": 0.9,
    "signingkey": 0.9, "encryptionkey": 0.9, "bearer": 0.8, "auth": 0.6, "key": 0.4, "private": 0.3, "access": 0.2,
    "api": 0.2, "client": 0.1, "session": 0.2, "salt": 0.5, "cookie": 0.4, "dsn": 0.6, "connectionstring": 0.8,
}
#: words that mark a placeholder (fixed values)
PLACEHOLDERS = ("example", "changeme", "change_me", "placeholder", "dummy", "sample", "your", "xxxx", "todo", "none", "null", "redacted", "[secret]")
MIN_SCORE = 0.75
MIN_LITERAL = 8

_NAME = r"[A-Za-z_$@][A-Za-z0-9_$.@-]{0,99}"
_STOP = r"\s\"';,{}()<>\[\]"
_REFERENCE = r"[A-Za-z_$][A-Za-z0-9_$.]*+"
_HEAD = rf"""(?P<q>["']?)(?P<name>{_NAME})(?P=q)(?:\[["'](?P<sub>[A-Za-z0-9_.-]+)["']\])?[\x20\t]*(?P<op>:=|=>|[=:](?!=))[\x20\t]*"""
# an unquoted value is a reference, or some joined, only if nothing else stands before its end; else it is one literal
_PAIR = re.compile(
    rf"""{_HEAD}(?:(?!{_REFERENCE}(?:[+]{_REFERENCE})*+[+]?(?![^{_STOP}]))(?P<whole>[^#{_STOP}][^{_STOP}]*)"""
    rf"""|(?P<value>(?:(?:"(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.)*'|{_REFERENCE})(?:[\x20\t]*[+][\x20\t]*)?)+))""",
    re.ASCII,
)
#: pairs inside an unquoted literal, as in ``url=http://h/?user=u&token=t``
_INNER = re.compile(rf"(?<=(?P<by>[&?|/:!*%^~\\+-]))(?P<name>{_NAME}):?=(?!=)", re.ASCII)
_ELEMENT = re.compile(rf"<(?P<name>{_NAME})>(?P<value>[^<>\s]+)</(?P=name)>", re.ASCII)
_PIECE = re.compile(r""""((?:[^"\\\n]|\\.)*)"|'((?:[^'\\\n]|\\.)*)'|([A-Za-z_$][A-Za-z0-9_$.]*)""", re.ASCII)
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|[0-9]+")

SPAN = "struct<kind:string,start:bigint,end:bigint,value_start:bigint,value_end:bigint,name:string,score:double>"


def name_score(name: str) -> float:
    """How sensitive a target name is: its best part, or its best pair of neighbours written together."""
    parts = [p.lower() for p in _WORD.findall(name)]
    both = [a + b for a, b in zip(parts, parts[1:], strict=False)]
    known = [NAME_PARTS[p] for p in [*parts, *both] if p in NAME_PARTS]
    return min(1.0, max(known) + 0.1 * (len(known) - 1)) if known else 0.0


def literal_score(value: str) -> float:
    """1 for a literal that can be a secret, towards 0 for placeholders, references and flat strings."""
    low = value.lower()
    if len(value) < MIN_LITERAL or any(p in low for p in PLACEHOLDERS) or re.search(r"\$\{|\{\{|%\(|<\w|\s", value):
        return 0.0
    entropy = -sum(c / len(value) * math.log2(c / len(value)) for c in Counter(value).values())
    kinds = sum(bool(re.search(p, value)) for p in ("[a-z]", "[A-Z]", "[0-9]", "[^A-Za-z0-9]"))
    return min(1.0, entropy / 2.5) if kinds > 1 or entropy > 3.2 else 0.3


def _inner(text: str, start: int, end: int) -> list[tuple]:
    """Pairs inside an unquoted literal; a value ends where the next pair behind the same separator begins."""
    out, last = [], {}
    for m in reversed(list(_INNER.finditer(text, start, end))):
        by = "&" if m["by"] == "?" else m["by"]
        to = last.get(by, end + 1) - 1
        if m.end() < to:
            value = text[m.end() : to]
            out.append((m["name"], [(value, m.end(), to, [value])], [value]))
        last[by] = m.start()
    return out[::-1]


def _pairs(text: str) -> list[tuple[str, list[tuple[str, int, int, list[str]]], list[str]]]:
    """Per assignment: name, its literals with places and the names they may be instead, and the names it refers to."""
    out = []
    for m in _PAIR.finditer(text):
        name = f"{m['name']}.{m['sub']}" if m["sub"] else m["name"]
        literals, names, part = [], [], "value" if m["whole"] is None else "whole"
        value, at = m[part], m.start(part)
        if part == "whole":
            out += _inner(text, at, m.end(part))
        if m["op"] == ":" and value[0] not in "\"'" and not m["q"] and text[max(0, m.start() - 1)] not in "\n{, \t":
            continue
        quoted = list(_PIECE.finditer(value)) if part == "value" and (value[0] in "\"'" or "+" in value) else []
        for p in quoted:
            if p[3] is not None:
                names.append(p[3])
            else:
                k = 1 if p[1] is not None else 2
                literals.append((p[k], at + p.start(k), at + p.end(k), [p[k]]))
        if not quoted:
            names.append(value)
        if len(names) and not literals and not re.search(r"\s", value):  # also +, which base64 has as well
            literals.append((value, at, at + len(value), list(names)))
        out.append((name, literals, names))
    for m in _ELEMENT.finditer(text):
        out.append((m["name"], [(m["value"], m.start("value"), m.end("value"), [m["value"]])], []))
    return out


def named_literals(text: str) -> list[tuple[int, int, str, float]]:
    """Literals that reach a sensitive name, directly or through constants: start, end, name, score."""
    pairs = _pairs(text)
    if not pairs:
        return []
    held: dict[str, list[tuple[str, int, int, list[str]]]] = {}
    fed_by: dict[str, list[str]] = {}
    for name, literals, names in pairs:
        held.setdefault(name, []).extend(literals)
        fed_by.setdefault(name, []).extend(names)
    # the most sensitive name that each constant flows into: from the best target back, each name is met once
    reached: dict[str, tuple[float, str]] = {}
    for top, name in sorted(((name_score(n), n) for n in held), reverse=True):
        todo = [name] if top else []
        while todo:
            if (source := todo.pop()) not in reached:
                reached[source] = (top, name)
                todo += fed_by.get(source, ())
    best: dict[tuple[int, int], tuple[float, str]] = {}
    for source, literals in held.items():
        top, name = reached.get(source, (0.0, ""))
        if not top:
            continue
        for value, start, end, also in literals:
            score = top * literal_score(value)
            if score >= MIN_SCORE and not any(n in held for n in also) and (score, name) > best.get((start, end), (0.0, "")):
                best[(start, end)] = (score, name)
    return [(s, e, name, round(score, 6)) for (s, e), (score, name) in sorted(best.items())]


def base_spans(text: str, low: str | None = None) -> list[tuple]:
    """Spans of the three fixed kinds."""
    low = text.lower() if low is None else low
    out = []
    if any(w in low for w in ("passw", "secret", "token", "apikey", "api_key")):
        for m in ASSIGN.finditer(text):
            if m.end(2) - m.start(2) >= MIN_ASSIGNED:
                out.append(("assign", m.start(), m.end(), m.start(2), m.end(2), m[1], 1.0))
    if "AKIA" in text:
        out += [("access", m.start(), m.end(), m.start(), m.end(), None, 1.0) for m in ACCESS.finditer(text) if m.end() - m.start() >= MIN_ACCESS]
    return out


_HEX_MAP = bytes(104 if c in b"0123456789abcdef" else 32 for c in range(256))


def spans_of(raw: bytes) -> list[tuple]:
    """All spans of a whole text, by start and then kind."""
    text = None
    low = raw.lower()
    out: list[tuple] = []
    if any(w in low for w in (b"passw", b"secret", b"token", b"apikey", b"api_key", b"akia")):
        text = raw.decode()
        out += base_spans(text)
    if b"h" * 32 in raw.translate(_HEX_MAP):
        text = raw.decode() if text is None else text
        out += [("hex", m.start(), m.end(), m.start(), m.end(), None, 1.0) for m in HEX.finditer(text)]
    if b"=" in raw or b":" in raw or b"</" in raw:
        text = raw.decode() if text is None else text
        taken = [(x[3], x[4]) for x in out if x[0] == "assign"]
        out += [("named", s, e, s, e, n, v) for s, e, n, v in named_literals(text) if (s, e) not in taken]
    return sorted(out, key=lambda x: (x[1], KINDS.index(x[0]), x[2]))


def masked(raw: bytes, spans: list[tuple]) -> str:
    """The text with each secret value replaced; overlapping values become one mask."""
    text, out, at = raw.decode(), [], 0
    for start, end in sorted((x[3], x[4]) for x in spans):
        if start >= at:
            out += [text[at:start], MASK]
        at = max(at, end)
    return "".join([*out, text[at:]])


_FIELDS = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("value_start", pa.int64()),
                     ("value_end", pa.int64()), ("name", pa.string()), ("score", pa.float64())])


def secret_spans(text: Column) -> Column:
    """All spans of a whole text as array<SPAN>."""

    @F.arrow_udf(returnType=f"array<{SPAN}>")
    def found(texts: pa.Array) -> pa.Array:
        names = [f.name for f in _FIELDS]
        return pa.array([[dict(zip(names, x, strict=True)) for x in spans_of(t.as_py())] for t in texts], pa.list_(_FIELDS))

    return found.asNondeterministic()(bytes_of(text))


def mask_secrets(docs: DataFrame, text: str = "text", length: str | None = "n_chars") -> DataFrame:
    """Replaces secret values in the texts; other texts, and nulls, stay as they are."""

    @F.arrow_udf(returnType="string")
    def cleaned(texts: pa.Array) -> pa.Array:
        out = []
        for t in texts:
            raw = t.as_py()
            spans = spans_of(raw)
            out.append(masked(raw, spans) if spans else None)  # null: nothing to replace
        return pa.array(out, pa.string())

    (name,) = fresh(docs, "cleaned")
    table = docs.withColumn(name, cleaned.asNondeterministic()(bytes_of(F.col(text))))
    columns = []
    for c in docs.columns:
        if c == text:
            columns.append(F.coalesce(F.col(name), F.col(text)).alias(text))
        elif c == length:
            columns.append(F.when(F.col(name).isNotNull(), F.length(name)).otherwise(F.col(c)).cast(docs.schema[c].dataType).alias(c))
        else:
            columns.append(F.col(f"`{c}`"))
    return table.select(columns)
