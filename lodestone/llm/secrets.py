"""Secret scan: fixed patterns, and assignment-aware lexing.

The lexer reads source and configuration syntax into name-literal pairs: ``name = "literal"``,
``name: value``, ``"name": "value"``, ``name := ...``, ``name => ...``, ``export
NAME=value``, elements of lists, keys inside objects, blocks below ``name: |`` and
``name: >``, ``<name>value</name>``, ``name="key" value="literal"``, ``${NAME:-value}``,
``set_name("literal")``, ``put("name", "literal")`` and ``--name literal``; comments are lexed
as text of their own. The literals of an object also go to the object's name, those in the
arguments of a call that decodes them or has them as defaults (PASSES) to the name that the
call is assigned to; the called name is no literal, nor are names of environment variables
and bare words among the arguments. A string with a prefix
(``f"..."``) is one, and takes the names in its braces along. A name assigned from other names or joined from parts (``+`` or juxtaposed strings)
takes their literals, wherever in the text those are written, so ``k = "..."`` and later
``password = k`` reports the literal of ``k``. A literal is scored by how sensitive the names
are that it reaches and by how much it, or the value that it is joined into, looks like a
credential. Spans are code points, ends exclusive. Null and empty texts have none. Every
row is scanned by itself, so repeated rows have equal findings.
"""

from __future__ import annotations

import heapq
import math
import re
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

KINDS = ("assign", "access", "hex", "literal")
# Fixed patterns; in "assign" letters of the names match in either case.
ASSIGN = re.compile(r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")  # the longest run of 16 or more: a shorter run fails whole
HEX = re.compile(r"[0-9a-f]{32,}")
LEAST = 8

# How sensitive a name is by the part that it holds.
SENSITIVE = {"password": 1.0, "passwd": 1.0, "passphrase": 1.0, "pwd": 0.8, "secret": 1.0, "token": 0.9, "apikey": 1.0, "privatekey": 1.0, "accesskey": 1.0, "credential": 0.8, "auth": 0.5}
LEX = re.compile(
    r"""(?P<comment>(?:(?<=^)|(?<=\s))(?:\#|//)(?=\s)[^\n]*)
    |(?P<shell>\$\{[A-Za-z_]\w*:?[-=][^{}\s]*\})
    |(?P<string>"(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.)*'|`[^`\n]*`)
    |(?P<assign>:=|=>|=(?!=)|:(?!:))
    |(?P<plus>\+|\.\.(?=\s))
    |(?P<word>[^\s"'`=:,;(){}\[\]+\#<>|&]+)
    |(?P<line>\n)
    |(?P<end>[,;)}\]])
    |(?P<other>[^\s])""",
    re.X | re.A,
)
NAME = re.compile(r"[A-Za-z_][\w.-]*", re.A)
PLACEHOLDER = re.compile(r"\$\{|\{\{|<[a-z]|^%|^\$|example|changeme|placeholder|x{4,}|\*{3,}|^(?:none|null|true|false|undefined)$", re.I)
LITERAL_SCORE = 0.5
# Syntax that the lexer's assignments do not cover.
ELEMENT = re.compile(r"<([A-Za-z_][\w.:-]*)(?:\s[^<>]*)?>([^<>]+)</\1\s*>", re.A)
KEYED = re.compile(r"""\b(?:key|name)\s*=\s*(["'])([\w.:-]+)\1\s+value\s*=\s*(["'])([^"'\n]+)\3""", re.A | re.I)
DEFAULT = re.compile(r"\$\{([A-Za-z_]\w*):?[-=]([^{}\s]+)\}", re.A)
CALL = re.compile(r"""(?<![\w.])([A-Za-z_][\w.]*+)\(\s*(["'])([^"'\n]*)\2\s*(?:,\s*(["'])([^"'\n]*)\4\s*)?(?=[,)])""", re.A)
HANGING = re.compile(r"""^([ \t]*)(?:-[ \t]+)?["']?([\w.-]+)["']?[ \t]*:[ \t]*[|>][+-]?[0-9]*[ \t]*\n((?:[ \t]*\n)*(\1[ \t]+)[^\s][^\n]*(?:\n(?:\4[^\n]*|[ \t]*(?=\n|\Z)))*)""", re.A | re.M)
FLAG = re.compile(r"""(?<![\w-])--([A-Za-z][\w-]*)[ \t]+(["']?)([^\s"'=-][^\s"']*)\2(?!\S)""", re.A)
#: Flags that tell where something is, and strings that are names of environment variables.
WHERE, VARIABLE = re.compile(r"(?:file|path|dir|url|uri|name|type|ttl|size|length)$", re.I), re.compile(r"[A-Z]+(?:_[A-Z0-9]+)*")
#: Calls whose result is one of their arguments, decoded or as it is: of others, arguments
#: say where a value is, not what it is.
PASSES = re.compile(r"(?:^|[._])(?:getenv|env|environ\.get|\w*decode\w*|\w*encode|fromhex|unhexlify|bytes|bytearray|str|string|strip|trim|unquote|secretstr|secret|buffer\.from|atob)$", re.I | re.A)
PREFIX, BRACES = re.compile(r"[rRbBfFuU]{1,2}"), re.compile(r"(?<!\{)\{([A-Za-z_][\w.]*)[^{}]*\}", re.A)
SETTER = re.compile(r"^(?:set|with|put|use|add)[_A-Z]|(?:^|[._])set[A-Z_]")


def sensitivity(name: str) -> float:
    """Of a whole text: no less than that of any name in it."""
    flat = name.lower().replace("_", "").replace(".", "").replace("-", "")
    return max((v for k, v in SENSITIVE.items() if k in flat), default=0.0)


class Value:
    """What scoring needs to know of a value: it joins with others without being built."""

    __slots__ = ("counts", "open", "quoted")

    def __init__(self, counts: Counter, quoted: bool, open: bool):
        self.counts, self.quoted, self.open = counts, quoted, open

    @classmethod
    def of(cls, text: str, quoted: bool) -> Value:
        return cls(Counter(text), quoted, not PLACEHOLDER.search(text) and not any(c.isspace() for c in text))

    def plausibility(self) -> float:
        """From 0 to 1: length, kinds of characters and entropy of what may be a credential."""
        size = sum(self.counts.values())
        if size < LEAST or not self.open:
            return 0.0
        kinds = {0 if "a" <= c <= "z" else 1 if "A" <= c <= "Z" else 2 if "0" <= c <= "9" else 3 for c in self.counts}
        if not self.quoted and 2 not in kinds:
            return 0.0  # prose after a colon
        entropy = -sum(n / size * math.log2(n / size) for n in self.counts.values())
        return min(1.0, 0.35 + 0.1 * len(kinds) + 0.1 * min(entropy, 4.0))


Part = tuple
Pairs = Iterator[tuple[str, list[Part]]]


def pairs(text: str) -> Pairs:
    """(name, [parts]) of each name-literal pair of a text; a part is ("literal", start,
    end, quoted) or ("name", name, start, end)."""
    yield from assignments(text, 0, len(text), True)
    if "<" in text:
        for m in ELEMENT.finditer(text):
            if value := m[2].strip():
                at = m.start(2) + m[2].index(value)
                yield m[1], [("literal", at, at + len(value), False)]
        for m in KEYED.finditer(text):
            yield m[2], [("literal", m.start(4), m.end(4), True)]
    for m in DEFAULT.finditer(text):
        yield m[1], [("literal", m.start(2), m.end(2), False)]
    for m in CALL.finditer(text):
        value = [("literal", m.start(5), m.end(5), True)] if m[4] else [("literal", m.start(3), m.end(3), True)]
        if m[4] and NAME.fullmatch(m[3]):
            yield m[3], value
        if SETTER.search(m[1]):
            yield m[1], value
    if "--" in text:
        for m in FLAG.finditer(text):
            if not WHERE.search(m[1]):
                yield m[1], [("literal", m.start(3), m.end(3), bool(m[2]))]
    for m in HANGING.finditer(text):
        lines = [("literal", m.start(3) + x.start(), m.start(3) + x.end(), False) for x in re.finditer(r"[^\s](?:[^\n]*[^\s])?", m[3])]
        yield m[2], lines


class Bracket(NamedTuple):
    """An open bracket: the name that its elements go to after a comma, the name of the object
    that it is, and whether it holds a call's arguments."""

    sign: str
    elements: str | None = None
    whole: str | None = None
    call: bool = False


def assignments(text: str, begin: int, stop: int, code: bool) -> Pairs:
    """Those of the assignments between two places, of ``code`` or of a comment. Each
    element of a list in [ ] or ( ), and each argument of a call, is an assignment to the
    list's name, and each value of an object in { } one to its key and to the object's name."""
    name = kind = None  # what stands before an assignment sign
    target, parts, joined, sign = None, [], False, ""
    opened: list[Bracket] = []
    element = False  # the target is that of a list, after a comma

    def done() -> Pairs:
        if target and parts:
            yield target, parts
            for whole in dict.fromkeys(o.whole for o in opened if o.whole and o.whole != target):
                yield whole, parts

    for m in LEX.finditer(text, begin, stop):
        kind = m.lastgroup
        if kind == "comment":
            if code:
                yield from assignments(text, m.end() - len(m[0].lstrip("#/ \t")), m.end(), False)
            continue
        if kind == "shell":
            continue
        if kind == "assign" and name and element and parts:
            # a key or keyword inside a list is a name of its own
            target, parts, joined, name, element, sign = name, [], True, None, False, m[0]
        elif kind == "assign" and name and (not target or not parts or (m[0] != ":" and parts[-1][0] == "name")):
            # "name: Type = ..." keeps the first name
            if not (target and parts and m[0] == "="):
                yield from done()
                target = name
            parts, joined, name, element, sign = [], True, None, False, m[0]
        elif kind in ("line", "end"):
            inside = opened[-1].elements if opened else None
            if kind == "line" and target and (inside or (parts and joined)):
                continue  # a list or a join that goes on in the next line
            yield from done()
            target, parts, element = None, [], False
            if m[0] != "]":  # as in names["KEY"] = ...
                name = None
            if m[0] == "," and inside:
                target, joined, element = inside, True, True
            elif opened and opened[-1].sign + m[0] in ("[]", "()", "{}"):
                opened.pop()
        elif kind == "plus":
            joined = True
        elif kind == "string":
            told = m[0][1:-1]
            if target and parts and parts[-1][0] == "name" and parts[-1][3] in (m.start(), -m.start()) and PREFIX.fullmatch(parts[-1][1]):
                inner = BRACES.finditer(told) if "f" in parts[-1][1].lower() else ()
                parts[-1:] = [("name", x[1], 0, 0) for x in inner]
                joined = True
            if target and (joined or (parts and parts[-1][0] == "literal")):
                if not (opened and opened[-1].call and VARIABLE.fullmatch(told)):
                    parts.append(("literal", m.start() + 1, m.end() - 1, True))
                joined = False
            name = told if NAME.fullmatch(told) else None
        elif kind == "word":
            if target and joined:
                if NAME.fullmatch(m[0]):
                    # what a call is given by name has no literal of its own: an empty span
                    parts.append(("name", m[0], m.end(), -m.end()) if opened and opened[-1].call else ("name", m[0], m.start(), m.end()))
                elif not (opened and opened[-1].call):
                    parts.append(("literal", m.start(), m.end(), False))
                joined = False
            elif target and parts:
                yield from done()
                target, parts, element = None, [], False
            name = m[0] if NAME.fullmatch(m[0]) else None
        elif kind == "other":
            if m[0] == "(" and target and parts and parts[-1][0] == "name" and parts[-1][3] in (m.start(), -m.start()):
                # a call: what it passes on stands for the name that is called
                passes = bool(PASSES.search(parts.pop()[1]))
                opened.append(Bracket("(", target if passes else None, None, True))
                joined = passes
            elif m[0] == "{" and target and joined:
                opened.append(Bracket("{", None, target if sign != "=>" else None))
                target, parts, joined, element = None, [], False, False
            elif m[0] in "[({":
                # a list where a value is due; what follows a name is a place
                opened.append(Bracket(m[0], target if joined and m[0] != "{" else None))
            elif m[0] not in "$@":
                yield from done()
                target, parts, element = None, [], False
    yield from done()


def literals(text: str) -> list[tuple[int, int, float]]:
    """Literals that reach sensitive names, with their scores."""
    held: dict[str, list[list]] = {}  # of each name its assignments, as lists of parts
    for name, parts in pairs(text):
        held.setdefault(name, []).append(parts)
    values: dict[str, Value | None] = {}

    def value(parts: list) -> Value:
        """What the parts join to; names that lead back, or have several values, are empty."""
        counts, quoted, good = Counter(), False, True
        for part in parts:
            if part[0] == "name" and part[1] in held:
                got = values.get(part[1])
            else:
                a, b, q = span(part)
                got = Value.of(text[a:b], q)
            if got:
                counts, quoted, good = counts + got.counts, quoted or got.quoted, good and got.open
        return Value(counts, quoted, good)

    def span(part: Part) -> tuple[int, int, bool]:
        """Of a literal, or of a bare word that no assignment defines and so is a value; an
        argument's is empty."""
        return part[1:] if part[0] == "literal" else (part[2], max(part[2], part[3]), False)

    def evaluate(first: str) -> None:
        """Values of a name and of those that it is made of, these first."""
        todo = [first]
        while todo:
            name = todo[-1]
            if name not in values:
                values[name] = None  # until it is known: a name inside itself is empty
                todo += [p[1] for parts in held[name] for p in parts if p[0] == "name" and p[1] in held and p[1] not in values]
            else:
                todo.pop()
                if values[name] is None and len(held[name]) == 1:
                    values[name] = value(held[name][0])

    found: dict[tuple[int, int], float] = {}
    # names by the sensitivity that they take over, most first, and whether what they are
    # joined into looks like a credential: few values, so a name is walked a few times at most
    todo = [(-w, True, 0.0, name) for name in held if (w := sensitivity(name))]
    heapq.heapify(todo)
    seen: dict[str, bool] = {}
    while todo:
        weight, alone, joint, name = heapq.heappop(todo)
        if name in seen and (alone or not seen[name]):
            continue
        seen[name], weight = alone, -weight
        evaluate(name)
        for parts in held[name]:
            whole = max(joint, value(parts).plausibility() if len(parts) > 1 else 0.0)
            for part in parts:
                if part[0] == "name" and part[1] in held:
                    if part[1] != name:
                        heapq.heappush(todo, (-weight, whole * weight < LITERAL_SCORE, whole, part[1]))
                    continue
                a, b, quoted = span(part)
                score = weight * max(Value.of(text[a:b], quoted).plausibility(), whole)
                if score >= LITERAL_SCORE and b > a:
                    found[a, b] = max(score, found.get((a, b), 0))
    return [(a, b, s) for (a, b), s in found.items()]


def scan(text: str) -> list[tuple[str, int, int, int, float]]:
    """(kind, start, end, where the value starts, score) by start, then kind as listed."""
    out = []
    lower = text.lower()
    if any(k in lower for k in ("password", "passwd", "secret", "token", "apikey", "api_key")):
        out += [("assign", m.start(), m.end(), m.start(2), 1.0) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= LEAST]
    if "AKIA" in text:
        out += [("access", m.start(), m.end(), m.start(), 1.0) for m in ACCESS.finditer(text)]
    out += [("hex", m.start(), m.end(), m.start(), 1.0) for m in HEX.finditer(text)]
    if (any(c in text for c in "=:(<") or "--" in text) and sensitivity(text):  # else no literal reaches a sensitive name
        out += [("literal", a, b, a, s) for a, b, s in literals(text)]
    return sorted(out, key=lambda x: (x[1], KINDS.index(x[0]), x[2]))


def redact(text: str, found: list, mark: str = "[SECRET]") -> str:
    """The text with the values of all findings replaced, overlapping ones once."""
    out, at = [], 0
    for a, b in sorted((f[3], f[2]) for f in found):
        if b <= at:
            continue
        if a >= at:
            out += [text[at:a], mark]
        at = b
    return "".join(out) + text[at:]


FINDINGS = "array<struct<kind:string,start:int,end:int,value:int,score:double>>"
_STRUCT = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("value", pa.int32()), ("score", pa.float64())]))


def find(df: DataFrame, text_col: str = "text", name: str = "findings") -> DataFrame:
    """df's other columns with the findings of its text in a column ``name``: a column of
    df that has that name already is replaced. Texts themselves are not returned."""
    kept = [c for c in df.columns if c not in (text_col, name)]
    source = df.select(*[F.col(f"`{c}`") for c in kept], F.col(text_col).alias("__text"))

    def run(batches):
        for batch in batches:
            for a in range(0, batch.num_rows, 1024):
                part = batch.slice(a, 1024)
                texts = part.column(part.num_columns - 1).to_pylist()
                rows = [[dict(zip(("kind", "start", "end", "value", "score"), f, strict=True)) for f in scan(t)] if t else [] for t in texts]
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(rows, _STRUCT)], [*kept, name])

    schema = ", ".join(f"`{c}` {t}" for c, t in df.select(*[F.col(f"`{c}`") for c in kept]).dtypes)
    return source.mapInArrow(run, f"{schema}{', ' if schema else ''}`{name}` {FINDINGS}")


def masked(df: DataFrame, text_col: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """df with the values of findings in its text replaced; all columns and rows stay."""

    @F.arrow_udf("string")
    def clean(texts: pa.Array) -> pa.Array:
        out = []
        for a in range(0, len(texts), 256):
            out += [redact(t, f, mark) if t and (f := scan(t)) else t for t in texts.slice(a, 256).to_pylist()]
        return pa.array(out, pa.string())

    return df.withColumn(text_col, clean(text_col))
