"""Python regular expressions in Java's dialect.

Profiles write exclude patterns for Python's ``re``; Spark matches with Java's
``Pattern``. A pattern is parsed by Python and its tree is written out again in
Java's syntax, so what Python reads as a literal brace, an open-ended repeat, a
class with a bracket in it or a test of a group means the same there:

* literals are escaped by code point, ``.`` and ``$`` and ``^`` are spelled out (Python
  knows one line end, Java five), ``\\w \\d \\s \\b`` become the Unicode classes that Python uses, or ASCII under ``(?a)``;
* only groups that are referred to capture, numbered from ``first`` on, so several
  patterns can stand in one alternation;
* ``(?(1)yes|no)`` tests an empty group that follows group 1 and so takes part exactly if that does.

``translate`` raises ``PatternError`` for a pattern that Python refuses, and for the few
that Java cannot hold (repeat counts beyond its integers).
"""

from __future__ import annotations

import re
from re import _constants as K
from re import _parser
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

MOST_REPEAT = (1 << 31) - 1
ANY = r"[\x{0}-\x{10FFFF}]"
#: Members of the classes, for Unicode and for ASCII patterns.
WORD = {False: r"\p{L}\p{N}_", True: "A-Za-z0-9_"}
DIGIT = {False: r"\p{Nd}", True: "0-9"}
SPACE = {False: r"\t-\r\x{1c}-\x{20}\x{85}\p{Z}", True: r"\t-\r\x{20}"}
_CATEGORIES = {K.CATEGORY_WORD: (WORD, False), K.CATEGORY_NOT_WORD: (WORD, True), K.CATEGORY_DIGIT: (DIGIT, False),
               K.CATEGORY_NOT_DIGIT: (DIGIT, True), K.CATEGORY_SPACE: (SPACE, False), K.CATEGORY_NOT_SPACE: (SPACE, True)}


class PatternError(ValueError):
    """The pattern is none in Python, or has no form in Java."""


class Pattern(NamedTuple):
    """A pattern as written, and in Java's dialect."""

    text: str
    java: str


def translate(pattern: str, first: int = 1) -> tuple[str, int]:
    """The pattern for Java with groups numbered from ``first`` on, and the next free number."""
    try:
        re.compile(pattern)
        tree = _parser.parse(pattern)
    except (re.error, OverflowError, RecursionError) as e:
        raise PatternError(str(e)) from e
    writer = _Writer(tree, first)
    try:
        return writer.sequence(tree, tree.state.flags), writer.next
    except RecursionError as e:
        raise PatternError("nested too deeply") from e


def compiled(patterns: list[str] | None) -> list[Pattern]:
    """The patterns that have a Java form; others are ignored at match time (they are violations of their profile)."""
    out = []
    for p in patterns if patterns is not None else []:
        try:
            out.append(Pattern(p, translate(p)[0]))
        except PatternError:
            continue
    return out


def joined(patterns: list[Pattern]) -> str:
    """One Java pattern that matches where any of the patterns does."""
    parts, first = [], 1
    for p in patterns:
        java, first = translate(p.text, first)
        parts.append(f"(?:{java})")
    return "|".join(parts)


def compiled_array(lists) -> Column:
    """Per row of a small table (profiles): its patterns that have a Java form, in order."""
    @F.pandas_udf("array<struct<text:string,java:string>>")
    def run(lists: pd.Series) -> pd.Series:
        return lists.map(lambda ps: None if ps is None else [{"text": p.text, "java": p.java} for p in compiled([x for x in ps if x is not None])])
    return run(lists)


def first_match(text: Column, patterns: list[Pattern] | Column) -> Column:
    """The first pattern, as written, that matches anywhere in the text, else null. ``patterns`` is a list, or an array column as of ``compiled_array``."""
    if isinstance(patterns, Column):
        return F.try_element_at(F.filter(patterns, lambda p: F.regexp_like(text, p["java"])), F.lit(1))["text"]
    out = F.lit(None).cast("string")
    for p in reversed(patterns):
        out = F.when(text.rlike(p.java), F.lit(p.text)).otherwise(out)
    return out


def any_match(text: Column, patterns: list[Pattern]) -> Column:
    """Whether any pattern matches anywhere in the text, in one pass."""
    return text.rlike(joined(patterns)) if patterns else F.lit(False)


class _Writer:
    def __init__(self, tree, first: int):
        self.next = first
        self.referred, self.tested = set(), set()
        self._find(tree)
        self.number: dict[int, int] = {}  # Python's group -> Java's
        self.mark: dict[int, int] = {}  # Python's group -> the empty group behind it
        self._count(tree)

    def _find(self, tree):
        for op, arg in tree:
            if op in (K.GROUPREF, K.GROUPREF_IGNORE, K.GROUPREF_LOC_IGNORE, K.GROUPREF_UNI_IGNORE):
                self.referred.add(arg)
            elif op is K.GROUPREF_EXISTS:
                self.tested.add(arg[0])
            for part in _parts(op, arg):
                self._find(part)

    def _count(self, tree):
        for op, arg in tree:
            group = arg[0] if op is K.SUBPATTERN else None
            if group in self.referred:
                self.number[group] = self.next
                self.next += 1
            for part in _parts(op, arg):
                self._count(part)
            if group in self.tested:
                self.mark[group] = self.next
                self.next += 1

    def sequence(self, tree, flags: int) -> str:
        return "".join(self.item(op, arg, flags) for op, arg in tree)

    def cased(self, java: str, flags: int) -> str:
        if not flags & re.IGNORECASE:
            return java
        return f"(?i:{java})" if flags & re.ASCII else f"(?iu:{java})"

    def item(self, op, arg, flags: int) -> str:
        ascii_ = bool(flags & re.ASCII)
        if op is K.LITERAL:
            return self.cased(_char(arg), flags)
        if op is K.NOT_LITERAL:
            return self.cased(f"[^{_char(arg)}]", flags)
        if op is K.ANY:
            return ANY if flags & re.DOTALL else r"[^\n]"
        if op is K.IN:
            return self.cased(_class(arg, ascii_), flags)
        if op is K.BRANCH:
            return "(?:" + "|".join(self.sequence(x, flags) for x in arg[1]) + ")"
        if op is K.SUBPATTERN:
            group, add, drop, body = arg
            java = self.sequence(body, (flags | add) & ~drop)
            java = f"({java})" if group in self.number else f"(?:{java})"
            return f"(?:{java}())" if group in self.mark else java
        if op in _REPEATS:
            least, most, body = arg
            return f"(?:{self.sequence(body, flags)}){_repeat(least, most)}{_REPEATS[op]}"
        if op is K.ATOMIC_GROUP:
            return f"(?>{self.sequence(arg, flags)})"
        if op in (K.ASSERT, K.ASSERT_NOT):
            behind, body = arg
            return f"(?{'<' if behind < 0 else ''}{'=' if op is K.ASSERT else '!'}{self.sequence(body, flags)})"
        if op is K.AT:
            return _place(arg, flags, WORD[ascii_])
        if op is K.GROUPREF:
            return self.cased(f"(?:\\{self.number[arg]})", flags)
        if op is K.GROUPREF_EXISTS:
            group, yes, no = arg
            mark = self.mark[group]
            return f"(?:(?:\\{mark}){self.sequence(yes, flags)}|(?!\\{mark}){self.sequence(no, flags) if no else ''})"
        if op is K.FAILURE:
            return "(?!)"
        raise PatternError(f"no Java form of {op}")


_REPEATS = {K.MAX_REPEAT: "", K.MIN_REPEAT: "?", K.POSSESSIVE_REPEAT: "+"}


def _parts(op, arg) -> list:
    """The patterns inside an item."""
    if op is K.BRANCH:
        return list(arg[1])
    if op is K.SUBPATTERN:
        return [arg[3]]
    if op in _REPEATS:
        return [arg[2]]
    if op is K.ATOMIC_GROUP:
        return [arg]
    if op in (K.ASSERT, K.ASSERT_NOT):
        return [arg[1]]
    if op is K.GROUPREF_EXISTS:
        return [x for x in arg[1:] if x]
    return []


def _char(code: int) -> str:
    c = chr(code)
    return c if c.isascii() and c.isalnum() else f"\\x{{{code:x}}}"


def _repeat(least: int, most) -> str:
    if least > MOST_REPEAT or (most is not K.MAXREPEAT and most > MOST_REPEAT):
        raise PatternError("a repeat count beyond Java's integers")
    return f"{{{least},}}" if most is K.MAXREPEAT else f"{{{least},{most}}}"


def _class(items, ascii_: bool) -> str:
    """A class; negated categories stand beside it, as Java's nested classes mean other things when negated."""
    items = list(items)
    negated = items[0][0] is K.NEGATE
    inside, others = [], []
    for op, arg in items[1:] if negated else items:
        if op is K.LITERAL:
            inside.append(_char(arg))
        elif op is K.RANGE:
            inside.append(f"{_char(arg[0])}-{_char(arg[1])}")
        elif op is K.CATEGORY:
            members, outside = _CATEGORIES[arg]
            (others if outside else inside).append(f"[^{members[ascii_]}]" if outside else members[ascii_])
        else:
            raise PatternError(f"no Java form of {op} in a class")
    if not others:
        return f"[{'^' if negated else ''}{''.join(inside)}]"
    either = "|".join(([f"[{''.join(inside)}]"] if inside else []) + others)
    return f"(?:(?!{either}){ANY})" if negated else f"(?:{either})"


def _place(at, flags: int, word: str) -> str:
    if at is K.AT_BEGINNING:
        return r"(?:\A|(?<=\n))" if flags & re.MULTILINE else r"\A"
    if at is K.AT_BEGINNING_STRING:
        return r"\A"
    if at is K.AT_END:
        return r"(?=\n|\z)" if flags & re.MULTILINE else r"(?=\n?\z)"
    if at is K.AT_END_STRING:
        return r"\z"
    if at is K.AT_BOUNDARY:
        return f"(?:(?<=[{word}])(?![{word}])|(?<![{word}])(?=[{word}]))"
    if at is K.AT_NON_BOUNDARY:  # never in an empty text
        return f"(?:(?<=[{word}])(?=[{word}])|(?<![{word}])(?![{word}])(?!\\A\\z))"
    raise PatternError(f"no Java form of {at}")
