"""Detection patterns are written in Python's regex dialect; Spark runs Java's.

``compile_pattern`` turns one into the other and derives the literals every match must contain,
which become cheap ``contains`` tests in front of the regex.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass
from re import _constants as C
from re import _parser

# (?i) ignore case, (?u) Unicode case folding, (?U) Unicode classes, (?d) only \n ends a line
FLAGS = "(?iuUd)"

MAX_CLAUSES = 2
SHARED_USES = 4  # a clause this many patterns need is evaluated once per row
SHARED_LIMIT = 24
WIDTH_TEST = 64  # patterns no shorter text can match also test its length
# Words and signs so frequent in logs that a test on them rejects little.
COMMON = ("http", "get", "post", "head", "put", "from", "user", "for", "php", "error", "log", "www")
RARE_SIGNS = set("{};#<>$|~^`%()!*+'\\@&?")


@dataclass(frozen=True)
class Pattern:
    source: str
    java: str
    groups: tuple  # ((name, index), ...)
    required: tuple  # AND of ORs: ((literal, ...), ...), lower case, most selective first
    min_length: int  # of any match, in characters


def compile_pattern(source: str) -> Pattern:
    """Raise ``re.error`` when the pattern is not valid, ``ValueError`` when Java has no equivalent."""
    compiled = re.compile(source, re.IGNORECASE)
    return Pattern(
        source,
        to_java(source, compiled.groupindex),
        tuple(sorted(compiled.groupindex.items(), key=lambda kv: kv[1])),
        required_literals(source),
        _parser.parse(source, re.IGNORECASE).getwidth()[0],
    )


def to_java(source: str, groupindex: dict) -> str:
    """Rewrite the spots where the two dialects differ; everything else is copied."""
    out, i, in_class, class_start = [], 0, False, -1
    while i < len(source):
        c = source[i]
        if c == "\\":
            pair = source[i : i + 2]
            if pair == "\\Z":
                pair = "\\z"
            elif pair == "\\b" and in_class:
                pair = "\\x08"
            out.append(pair)
            i += 2
            continue
        if in_class:
            if c == "]" and i > class_start:
                in_class = False
                out.append(c)
            elif c in "[]" or source.startswith("&&", i):
                out.append("\\" + c)  # Java would read a nested class or an intersection
            else:
                out.append(c)
        elif c == "[":
            in_class = True
            negated = source.startswith("^", i + 1)
            out.append("[^" if negated else "[")
            i += 1 if negated else 0
            class_start = i + 1  # a ] right here is a plain character
        elif source.startswith("(?P<", i):
            out.append("(")
            i = source.index(">", i)
        elif source.startswith("(?P=", i):
            end = source.index(")", i)
            out.append(f"(?:\\{groupindex[source[i + 4 : end]]})")
            i = end
        elif source.startswith("(?(", i):
            raise ValueError("conditional groups have no Java equivalent")
        elif c == "{":
            quantifier = re.match(r"\{(\d*)(,?)(\d*)\}", source[i:])
            if quantifier and (quantifier[1] or quantifier[3]):
                low, comma, high = quantifier.groups()
                out.append("{" + (low or "0") + comma + high + "}")
                i += quantifier.end() - 1
            else:
                out.append("\\{")
        elif c == "}":
            out.append("\\}")
        else:
            out.append(c)
        i += 1
    return "".join(out)


def required_literals(source: str) -> tuple:
    """Literal clauses, each of which every match satisfies."""
    return tuple(sorted(set(_clauses(_parser.parse(source, re.IGNORECASE))), key=_weakness))


def _weakness(clause: tuple) -> tuple:
    shortest = min(len(lit) for lit in clause)
    common = any(lit.strip(' ./:"') in COMMON for lit in clause)
    return (common, -min(shortest, 12), len(clause), clause)


def _usable(literal: str) -> bool:
    return len(literal) > 1 and literal.strip() != "" or literal in RARE_SIGNS


def _clauses(tree) -> list:
    """All clauses of a parsed sequence; groups are read in line so that runs span them."""
    found, run = [], []

    def flush():
        literal = "".join(run)
        if _usable(literal):
            found.append((literal,))
        run.clear()

    def walk(items):
        for op, arg in items:
            if op is C.LITERAL and arg < 128:
                run.append(chr(arg).lower())
            elif op is C.SUBPATTERN:
                walk(arg[3])
            elif op is C.ATOMIC_GROUP:
                walk(arg)
            elif op is C.AT:
                continue
            else:
                # A run too short for a test of its own is joined with what may follow it.
                if op is C.BRANCH and run and not _usable("".join(run)):
                    starts = _starts([(op, arg)])
                    if all(starts):
                        found.append(tuple(sorted({"".join(run) + s for s in starts})))
                flush()
                if op in (C.MAX_REPEAT, C.MIN_REPEAT, C.POSSESSIVE_REPEAT) and arg[0] >= 1:
                    found.extend(_clauses(arg[2]))
                elif op is C.ASSERT:
                    found.extend(_clauses(arg[1]))
                elif op is C.BRANCH:
                    best = [min(_clauses(b), key=_weakness, default=None) for b in arg[1]]
                    if all(best):
                        found.append(tuple(sorted({lit for clause in best for lit in clause})))

    walk(tree)
    flush()
    return found


def _starts(tree) -> list[str]:
    """The literals a sequence may begin with, one per way through it."""
    prefix = ""
    for op, arg in tree:
        if op is C.LITERAL and arg < 128:
            prefix += chr(arg).lower()
        elif op is C.BRANCH:
            return [prefix + s for branch in arg[1] for s in _starts(branch)]
        elif op is not C.AT:
            break
    return [prefix]


def sql_string(text: str) -> str:
    """A Spark SQL string literal (``spark.sql.parser.escapedStringLiterals`` off)."""
    escaped = text.replace("\\", "\\\\").replace("'", "\\'").replace("\n", "\\n")
    return f"'{escaped}'"


def prefilter_text(message: str) -> str:
    """SQL: lower case of a column, folding also the letters that match i, k and s ignoring case."""
    return (
        f"CASE WHEN octet_length({message}) = char_length({message}) THEN lower({message}) "
        f"ELSE lower(translate({message}, '\u017f\u0131\u0130\u212a', 'siik')) END"
    )


def search(message: str, pattern: Pattern) -> str:
    """SQL: the pattern occurs in the column, as Python's ``re.search`` with IGNORECASE decides."""
    return f"{message} RLIKE {sql_string(FLAGS + pattern.java)}"


def capture(message: str, pattern: Pattern) -> str:
    """SQL: map of the named groups; a group that took no part in the match gives ''."""
    pairs = ", ".join(
        f"{sql_string(name)}, regexp_extract({message}, {sql_string(FLAGS + pattern.java)}, {index})"
        for name, index in pattern.groups
    )
    return f"map({pairs})" if pairs else "CAST(map() AS map<string,string>)"


def shared_clauses(patterns) -> dict:
    """Clauses that many of the patterns need -> name of a column holding the outcome."""
    uses = Counter(clause for p in patterns for clause in p.required)
    frequent = [c for c, n in uses.most_common() if n >= SHARED_USES][:SHARED_LIMIT]
    return {clause: f"_f{i}" for i, clause in enumerate(frequent)}


def contains_any(lowered: str, clause: tuple) -> str:
    return "(" + " OR ".join(f"contains({lowered}, {sql_string(lit)})" for lit in clause) + ")"


def gates(pattern: Pattern) -> tuple:
    """The clauses that are tested before a pattern."""
    return pattern.required[:MAX_CLAUSES]


def prefilter(lowered: str, pattern: Pattern, shared: dict, any_of=contains_any) -> str:
    """SQL: conditions every match meets. Those held in a column come first, they cost nothing.

    ``any_of(lowered, clause)`` says in SQL that a clause holds.
    """
    tests = [shared[c] for c in pattern.required if c in shared]
    tests += [any_of(lowered, c) for c in gates(pattern) if c not in shared]
    if pattern.min_length >= WIDTH_TEST:
        tests.append(f"char_length({lowered}) >= {pattern.min_length}")
    return " AND ".join(tests) or "true"
