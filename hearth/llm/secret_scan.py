"""Secret scans by assignment-aware lexing.

Base spans (the whole match, code points, end exclusive): ``assign``, ``access`` and
``hex`` patterns, leftmost and non-overlapping per kind.

Method: a lexer finds assignment sites of source and configuration syntax (``name =``,
``name:``, ``"name":``, ``name =>``, ``name :=``, ``<name>..</name>``) and parses what
stands right of them: string literals in any quotes, bare words, names of constants, and
their concatenations. Constants are propagated: ``a = "x"; password = a + "y"`` gives
password the joined literal and reports the literals that made it. A pair's score is
the sensitivity of its target name times the strength of its literal (length, entropy,
character classes; placeholders and references score nothing); at ``MIN_SCORE`` its
literals become spans of kind ``pair``, unless an ``assign`` span covers them already. A
constant's value is kept as references to what made it: its length, characters and class of
placeholder are summed up over the graph, so constants that double from line to line cost a
line each.

Cases: a null text is empty. Repeated rows are scanned one by one. Names, literals and
texts of any length are read whole; a document's constants are its own.
"""

from __future__ import annotations

import hashlib
import math
import re
import string
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession

from hearth.llm.common import map_batches, prepare

KINDS = ("assign", "access", "hex", "pair")
MIN_SCORE = 0.5
ASSIGN = re.compile(r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")  # a run that is shorter has no longer one inside

#: How sensitive a part of a target name is.
SENSITIVE = {"password": 1.0, "passwd": 1.0, "passphrase": 1.0, "pwd": 0.9, "pass": 0.6, "secret": 1.0, "token": 0.9, "apikey": 1.0,
             "credential": 0.9, "credentials": 0.9, "auth": 0.7, "bearer": 0.9, "private": 0.6, "access": 0.4, "api": 0.3, "key": 0.6,
             "signing": 0.6, "signature": 0.5, "session": 0.4, "salt": 0.4, "cert": 0.4, "connection": 0.3, "client": 0.2}
PLACEHOLDER = re.compile(r"(?ai)x{4,}|\*{3,}|change_?me|example|placeholder|your[_-]|dummy|<.*>|\$\{.*\}|%\(.*\)|\{\{.*\}\}")

_OPERATOR = re.compile(r"=>|:=|(?<![=!<>:+])=(?!=)|:(?![:=/])")
_NAME_FIRST = frozenset(string.ascii_letters + "_$")
_NAME_CHARS = string.ascii_letters + string.digits + "_$.-"
_TERM = re.compile(r"""(?a)"((?:[^"\\\n]|\\.)*)"|'((?:[^'\\\n]|\\.)*)'|`((?:[^`\\]|\\.)*)`|([^\s"'`,;(){}\[\]<>#]+)""")
_JOIN = re.compile(r"[ \t]*(?:\+|\.\.|&)[ \t]*|[ \t]+(?=[\"'])")
_BLANK = re.compile(r"[ \t]*")
_XML = re.compile(r"(?a)<([A-Za-z_][\w.-]*)>([^<\s]+)</\1>")
_PARTS = re.compile(r"(?a)[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+")


class Literal:
    """A value in parts: slices of the text, as (string, start, end), and other literals. A constant that
    is used again is the same object, so values form a graph and are never copied out."""

    __slots__ = ("parts", "length", "_counts")

    def __init__(self, parts: Iterable):
        self.parts = tuple(parts)
        self.length = sum(p.length if isinstance(p, Literal) else len(p[0]) for p in self.parts)
        self._counts: Counter | None = None

    @property
    def value(self) -> str:
        """The value written out; its length may be far over the text's."""
        out, work = [], [self]
        while work:
            part = work.pop()
            if isinstance(part, Literal):
                work.extend(reversed(part.parts))
            else:
                out.append(part[0])
        return "".join(out)

    def spans(self, seen: set) -> list[tuple[int, int]]:
        """The slices that made the value; literals in ``seen`` are passed over, those met are added."""
        out, work = [], [self]
        while work:
            part = work.pop()
            if not isinstance(part, Literal):
                out.append(part[1:])
            elif part not in seen:
                seen.add(part)
                work.extend(part.parts)
        return out

    def counts(self) -> Counter:
        """Its characters, from those of its parts; every literal is counted once."""
        work = [self]
        while work:
            one = work[-1]
            todo = [p for p in one.parts if isinstance(p, Literal) and p._counts is None] if one._counts is None else []
            if todo:
                work.extend(todo)
                continue
            if one._counts is None:
                one._counts = Counter()
                for p in one.parts:
                    one._counts.update(p._counts if isinstance(p, Literal) else p[0])
            work.pop()
        return self._counts


def joined(parts: list) -> Literal:
    """A literal of the parts that hold a character; one literal alone is itself, so no chain of
    literals is longer than its value."""
    held = [p for p in parts if (p.length if isinstance(p, Literal) else p[0])]
    return held[0] if len(held) == 1 and isinstance(held[0], Literal) else Literal(held)


# --- placeholders in values that are not written out ---------------------------------

_WORDS = ("xxxx", "***", "changeme", "change_me", "example", "placeholder", "your_", "your-", "dummy")
_BEGUN = frozenset(w[:k] for w in _WORDS for k in range(len(w)))
_LONGEST = max(map(len, _WORDS)) - 1
_FIND_WORD = re.compile("|".join(map(re.escape, _WORDS)))
_BRACKET = re.compile(r"[<>${}%()\n]")
_ASCII_LOWER = {c: c + 32 for c in range(65, 91)}
#: State of the search: the begun word, a begun bracket sign, the brackets open in this line.
_NOTHING, _FOUND = ("", "", 0), ("found",)


def _read(state: tuple, text: str) -> tuple:
    """The state behind one more piece of the value: a finite automaton for ``PLACEHOLDER``."""
    begun, sign, open_ = state
    low = begun + text.translate(_ASCII_LOWER)
    if _FIND_WORD.search(low):
        return _FOUND
    tail = low[-_LONGEST:]
    begun = next(tail[k:] for k in range(len(tail) + 1) if tail[k:] in _BEGUN)
    whole = sign + text
    for m in _BRACKET.finditer(whole, len(sign)):
        c, at = m.group(), m.start()
        before = whole[at - 1] if at else ""
        if c == "\n":
            open_ = 0
        elif c == "<":
            open_ |= 1
        elif c == "{":
            open_ |= 2 * (before == "$") | 8 * (before == "{")
        elif c == "(":
            open_ |= 4 * (before == "%")
        elif (c == ">" and open_ & 1) or (c == ")" and open_ & 4) or (c == "}" and (open_ & 2 or (open_ & 8 and before == "}"))):
            return _FOUND
    return begun, whole[-1] if whole and whole[-1] in "$%{}" else "", open_


def is_placeholder(literal: Literal, known: dict) -> bool:
    """Whether ``PLACEHOLDER`` matches in the value. Short values are written out; else the automaton walks
    the graph, and what a literal does to a state is kept in ``known``, so each is read once a state."""
    if literal.length <= 256:
        return bool(PLACEHOLDER.search(literal.value))
    work = [[literal, _NOTHING, 0, _NOTHING]]  # literal, state before it, next part, state there
    while work:
        one = work[-1]
        node, before, i, state = one
        while i < len(node.parts) and state is not _FOUND:
            part = node.parts[i]
            if isinstance(part, Literal):
                after = known.get((part, state))
                if after is None:
                    break
                state = after
            else:
                state = _read(state, part[0])
            i += 1
        one[2:] = i, state
        if i < len(node.parts) and state is not _FOUND:
            work.append([node.parts[i], state, 0, state])
        else:
            known[node, before] = state
            work.pop()
    return known[literal, _NOTHING] is _FOUND


def sensitivity(name: str) -> float:
    """0 to 1: the most telling part of a name, with a share of the next."""
    parts = sorted((SENSITIVE.get(p.lower(), 0.0) for p in _PARTS.findall(name)), reverse=True)
    joined = SENSITIVE.get(re.sub(r"[^a-z]", "", name.lower()), 0.0)
    best = max([joined, *parts[:1]], default=0.0)
    return min(1.0, best + 0.5 * sum(parts[1:2])) if best else 0.0


def strength(literal: Literal, known: dict) -> float:
    """0 to 1: how much a literal looks like a secret rather than a word or a setting. From its length,
    its character counts and the placeholder search alone."""
    n = literal.length
    if n < 8:
        return 0.0
    counts = literal.counts()
    if " " in counts or is_placeholder(literal, known):
        return 0.0
    entropy = -sum(c / n * math.log2(c / n) for c in counts.values())
    classes = sum((any(c.islower() for c in counts), any(c.isupper() for c in counts), any(c.isdigit() for c in counts), not all(c.isalnum() for c in counts)))
    return (1.0 if n >= 20 else n / 20) * 0.3 + min(1.0, entropy / 4) * 0.4 + min(1.0, (classes - 1) / 2) * 0.3


def _terms(text: str, at: int, known: dict[str, Literal]) -> Literal | None:
    """The joined literal that starts at ``at``."""
    parts: list = []
    while m := _TERM.match(text, at):
        quoted = next((g for g in (1, 2, 3) if m.group(g) is not None), None)
        if quoted:
            parts.append((m.group(quoted), *m.span(quoted)))
            at = m.end()
        else:
            bare = m.group(4)
            head = bare.split("+", 1)[0]
            if head in known:
                parts.append(known[head])
                at += len(head)
            else:
                parts.append((bare, *m.span(4)))
                at = m.end()
        glue = _JOIN.match(text, at)
        if not glue:
            break
        at = glue.end()
    return joined(parts) if parts else None


def _name_left(left: str) -> str | None:
    """The name at the end of ``left``, what stands between two operators: an optional quote
    and blanks may follow it, and name and gap may have any length."""
    left = left.rstrip(" \t")
    if left.endswith(('"', "'", "`")):
        left = left[:-1]
    name = left[len(left.rstrip(_NAME_CHARS)):]
    return name if name[:1] in _NAME_FIRST else None


def pairs(text: str) -> list[tuple[str, Literal]]:
    """(target name, literal) of every assignment, constants propagated, in text order."""
    found: list[tuple[int, str, Literal]] = []
    known: dict[str, Literal] = {}
    last = 0
    for op in _OPERATOR.finditer(text):
        end = op.start()
        name, last = _name_left(text[last:end]), op.end()  # no name holds an operator
        if not name:
            continue
        literal = _terms(text, _BLANK.match(text, op.end()).end(), known)
        if literal:
            known[name] = literal
            found.append((end, name, literal))
    if "</" in text:
        found += [(m.start(), m.group(1), Literal([(m.group(2), *m.span(2))])) for m in _XML.finditer(text)]
    return [(n, x) for _, n, x in sorted(found, key=lambda f: f[0])]


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of the base patterns, sorted."""
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m.group(2)) >= 12]
    out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 18]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def pair_spans(text: str, base: list[tuple[int, int, int]], min_score: float = MIN_SCORE) -> list[tuple[int, int, int]]:
    """Spans that the lexer adds to the base ones."""
    starts, ends = [s for s, k, _ in base if k == 0], [e for _, k, e in base if k == 0]  # sorted, apart

    def covered(s: int, e: int) -> bool:
        i = bisect_right(starts, s) - 1
        return i >= 0 and e <= ends[i]

    out, seen, known = set(), set(), {}
    for name, literal in pairs(text):
        weight = sensitivity(name)
        if weight >= min_score and weight * strength(literal, known) >= min_score:  # no strength is over 1
            out.update((s, 3, e) for s, e in literal.spans(seen) if not covered(s, e))
    return sorted(out)


def _written(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


COLUMNS = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_pair long"


def scan_text(text: str | None) -> tuple:
    text = text or ""
    base = base_spans(text)
    added = pair_spans(text, base) if "=" in text or ":" in text or "</" in text else []
    n = Counter(k for _, k, _ in base)
    return n[0], n[1], n[2], hashlib.sha256(_written(base).encode()).hexdigest(), _written(sorted(base + added)), len(added)


def scan(docs: DataFrame) -> DataFrame:
    """One row per document: counts, the base digest, all spans."""
    names = [f.split()[0] for f in COLUMNS.split(", ")]

    def make():
        def step(cols):
            return dict(zip(names, [cols["doc_id"], *map(list, zip(*map(scan_text, cols["text"])))]))
        return step

    return map_batches(docs.select("doc_id", "text"), make, COLUMNS)


def op2(spark: SparkSession, docs: DataFrame) -> DataFrame:
    prepare(spark)
    return scan(docs)
