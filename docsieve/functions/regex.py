"""Regular expressions: Python dialect to Java dialect, and one-pass keyword patterns."""

from __future__ import annotations

import re
import sys
from collections.abc import Iterable
from functools import lru_cache

import pandas as pd
from py4j.protocol import Py4JJavaError
from pyspark import SparkContext, cloudpickle
from pyspark.errors import IllegalArgumentException
from pyspark.sql import Column
from pyspark.sql import functions as F

cloudpickle.register_pickle_by_value(sys.modules[__name__])

# The characters Python counts as whitespace, also in str.strip().
PY_WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)

# What Python's Unicode classes mean, spelled for Java character classes.
_CLASS_BODY = {
    "s": r"\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000",
    "d": r"\p{Nd}",
    "w": r"\p{L}\p{N}_",
}

# The non-ASCII characters that Python takes for an ASCII letter when case is ignored.
_ALSO = {"i": r"\u0130\u0131", "k": r"\u212a", "s": r"\u017f"}

_TOKEN = re.compile(r"\\.|\(\?P<\w+>|\(\?P=(\w+)\)|\(\?[a-zA-Z-]*[:)]|\[|\]|[a-zA-Z]-[a-zA-Z]|&&|.", re.DOTALL)


def java_regex(pattern: str, ignore_case: bool = True) -> str:
    """Spell a Python pattern for Java's engine.

    Only a line feed ends a line (flag ``d``). Unicode case folding (flag ``u``) makes every letter
    comparison several times slower in Java, so it is used only for patterns that need it; in others
    the few non-ASCII characters that fold to an ASCII letter are spelled out.
    """
    folds = ignore_case and (
        "(?P=" in pattern or re.search(r"\\[1-9]", pattern) is not None
        or any(c > "\x7f" and c.lower() != c.upper() for c in pattern))
    spell = ignore_case and not folds
    out, in_class, start = [], False, -1
    for match in _TOKEN.finditer(pattern):
        token, at = match.group(), match.start()
        if len(token) == 2 and token[0] == "\\":
            kind = token[1]
            body = _CLASS_BODY.get(kind.lower())
            if body and kind.islower():
                token = body if in_class else f"[{body}]"
            elif body:
                token = f"[^{body}]"
            elif kind == "Z":
                token = r"\z"
            elif kind == "b" and not in_class:
                word = f"[{_CLASS_BODY['w']}]"
                token = f"(?:(?<={word})(?!{word})|(?<!{word})(?={word}))"
        elif in_class:
            first = at == start + 1 or (at == start + 2 and pattern[start + 1] == "^")
            if token == "]" and not first:
                in_class = False
            elif token in ("[", "]"):
                token = "\\" + token
            elif token == "&&":
                token = r"&\&"
            elif len(token) == 3 and ignore_case:
                inside = [c for c in _ALSO if token[0].lower() <= c <= token[2].lower()]
                token += "".join(_ALSO[c] for c in inside)
            elif spell:
                token += _ALSO.get(token.lower(), "")
        elif token == "[":
            in_class, start = True, at
        elif token.startswith("(?P<"):
            token = "(?<" + token[4:]
        elif match.group(1):
            token = rf"\k<{match.group(1)}>"
        elif spell and not token.startswith("("):
            token = re.sub("[iksIKS]", lambda m: f"[{m.group()}{_ALSO[m.group().lower()]}]", token)
        out.append(token)
    flags = "(?iud)" if folds else "(?id)" if ignore_case else "(?d)"
    return flags + "".join(out)


_HEAD = re.compile(r"(\(\?i\))?\((?:\?:|(?!\?))")
_OPTIONAL_NEXT = ("?", "*", "{")


def _first_letters(pattern: str) -> tuple[int, str, str, bool] | None:
    """Where a leading group of alternatives begins, the classes of its first and of its second letters (empty if one
    has none that is sure), and whether one is anchored; None for a head that is not plain words."""
    head = _HEAD.match(pattern)
    if not head:
        return None
    letters, seconds, sure, anchored, depth, at_start = set(), set(), True, False, 1, True
    tokens = list(_TOKEN.finditer(pattern, head.end()))
    skip_class = False
    for n, match in enumerate(tokens):
        token = match.group()
        following = tokens[n + 1].group() if n + 1 < len(tokens) else ""
        if at_start and depth == 1:
            if token == "^":
                anchored = True
            elif token.isalpha() and len(token) == 1 and following not in _OPTIONAL_NEXT:
                letters.add(token.lower())
                after = tokens[n + 2].group() if n + 2 < len(tokens) else ""
                sure = sure and following.isalpha() and len(following) == 1 and after not in _OPTIONAL_NEXT
                seconds.add(following.lower())
            else:
                return None
            at_start = False
        elif skip_class:
            skip_class = token != "]"
        elif token == "[":
            skip_class = True
        elif token.startswith("("):
            depth += 1
        elif token == "|" and depth == 1:
            at_start = True
        elif token == ")":
            depth -= 1
            if depth == 0:
                if following in _OPTIONAL_NEXT or not letters:
                    return None
                first, second = (f"[{''.join(sorted(x))}]" for x in (letters, seconds))
                return len(head.group(1) or ""), first, second if sure else "", anchored
    return None


def with_first_letter_guard(pattern: str) -> str:
    """Put a look-ahead on the first letters before a leading group of alternatives.

    ``(?:due|pay|terms)`` is tried word by word at every position; ``(?=[dpt])`` rejects most
    positions in one step. Nothing else changes, and a head that is not plain words is left alone.
    """
    found = _first_letters(pattern)
    if not found:
        return pattern
    start, letters, _, anchored = found
    guard = f"(?:^|(?={letters}))" if anchored else f"(?={letters})"
    return pattern[:start] + guard + pattern[start:]


def from_first_letter(pattern: str) -> str | None:
    """The same for searches that read a group and not the match, which is the first letter alone: it is consumed
    before anything else is looked at, the cheapest step through a text. None where the guard does not apply."""
    found = _first_letters(pattern)
    if not found or found[3] or _alternatives(pattern):
        return None
    start, letters, seconds, _ = found
    guard = f"(?={seconds})" if seconds else ""
    return f"{pattern[:start]}{letters}{guard}(?<=(?:(?={pattern[start:]}).))"


_BACK_REFERENCE = re.compile(r"\\[1-9]|\(\?P=")
_RUN_HEAD = re.compile(r"(\(\?i\))?\(?(\[\^?(?:\\.|[^\]\\])+\])\+(?![?+])")


def with_run_guard(java: str, pattern: str) -> str:
    """Let a pattern that begins with a run of one class start at the beginning of that run only.

    If it matches from inside a run it also matches from the run's start, so nothing is lost, and a
    long run without a match is scanned once in place of once per character. A back-reference may need a part
    of the run only, so such patterns are left alone.
    """
    head = _RUN_HEAD.match(pattern)
    if not head or "|" in pattern or _BACK_REFERENCE.search(pattern):
        return java
    flags, rest = re.match(r"(\(\?[a-z]+\))(.*)", java, re.DOTALL).groups()
    run = java_regex(head.group(2), ignore_case="i" in flags)
    return f"{flags}(?:\\G|(?<!{run[run.index(')') + 1:]})){rest}"


_GROUP_LOOP = re.compile(r"\)(?:\*|\+|\{\d+,\})(?![?+])")
#: Loops over a group with a count: the most, and whether they are lazy. Java recurses once per round.
_COUNTED_LOOP = re.compile(r"\)\{\d*,?(\d+)\}(\??)|\)\{\d+,\}(\?)")
_RECURSED = 200
_PYTHON_FLAGS = re.compile(r"\(\?[a-zA-Z]*[aLux]")
_OPTIONAL_TAIL = re.compile(r"\)*(?:\(\?:[^()|]*\)\?)?\)*$")


def _mask(pattern: str) -> str:
    """The pattern with escapes and classes blanked, so that only its structure is left."""
    return re.sub(r"\\.|\[\^?\]?(?:\\.|[^\]\\])*\]", lambda m: "_" * len(m.group()), pattern)


def _alternatives(pattern: str) -> bool:
    """Whether the pattern as a whole is a choice."""
    depth = 0
    for c in _mask(pattern):
        depth += (c == "(") - (c == ")")
        if c == "|" and not depth:
            return True
    return False


def recursive_loops(pattern: str) -> tuple[list[int], bool]:
    """Ends of unbounded group loops that only optional parts follow, and whether others exist.

    Java runs such loops by recursion, so a long enough text overflows the stack of the whole
    executor. A loop that is never backtracked into can be made possessive, which Java iterates.
    """
    structure, tails, others = _mask(pattern), [], "*?" in _mask(pattern) and ")*?" in _mask(pattern)
    for loop in _GROUP_LOOP.finditer(structure):
        if _OPTIONAL_TAIL.match(structure[loop.end():]):
            tails.append(loop.end())
        else:
            others = True
    counted = any(lazy or open_lazy or int(most) > _RECURSED
                  for most, lazy, open_lazy in _COUNTED_LOOP.findall(structure))
    return tails, others or counted or ")+?" in structure


def _accepted(java: str) -> bool:
    """Whether Java compiles the pattern; asked on the driver, so that no task fails on it."""
    try:
        SparkContext._active_spark_context._jvm.java.util.regex.Pattern.compile(java)
    except (IllegalArgumentException, Py4JJavaError):
        return False
    return True


@lru_cache(maxsize=10_000)
def java_search(pattern: str, ignore_case: bool = True, group_only: bool = False) -> str | None:
    """A Python pattern in a form that Java runs safely and alike, or None if it must be searched in Python.

    That is so for loops Java would recurse into, flags of another meaning, and syntax Java has not:
    conditionals, names with an underscore, ``{,n}`` and bare braces. With ``group_only`` the groups are those of
    the pattern's first match, but the match itself may be shorter.
    """
    tails, others = recursive_loops(pattern)
    if others or _PYTHON_FLAGS.search(_mask(pattern)):
        return None
    safe = pattern
    for end in reversed(tails):
        safe = safe[:end] + "+" + safe[end:]
    led = from_first_letter(safe) if group_only and ignore_case else None
    if led and _accepted(java := java_regex(led)):
        return java
    guarded = with_first_letter_guard(safe) if ignore_case else safe
    java = with_run_guard(java_regex(guarded, ignore_case), pattern)
    return java if _accepted(java) else None


def _python_search(text: Column, pattern: str, group: int) -> Column:
    @F.pandas_udf("string")
    def search(texts: pd.Series) -> pd.Series:
        compiled = re.compile(pattern, re.IGNORECASE)
        found = (None if t is None else compiled.search(t) for t in texts)
        return pd.Series([(m.group(group) or "").strip() if m else "" for m in found], dtype=object)

    return search(text)


def python_replace(text: Column, pattern: str, replacement: str) -> Column:
    @F.pandas_udf("string")
    def replaced(texts: pd.Series) -> pd.Series:
        compiled = re.compile(pattern)
        return pd.Series([None if t is None else compiled.sub(lambda _: replacement, t) for t in texts], dtype=object)

    return replaced(text)


def python_count(text: Column, pattern: str) -> Column:
    @F.pandas_udf("int")
    def counted(texts: pd.Series) -> pd.Series:
        compiled = re.compile(pattern)
        return pd.Series([None if t is None else sum(1 for _ in compiled.finditer(t)) for t in texts], dtype="Int32")

    return counted(text)


def py_strip(value: Column) -> Column:
    """``str.strip()``: ``trim`` alone removes only spaces."""
    return F.btrim(value, F.lit(PY_WHITESPACE))


def first_match(text: Column, pattern: str, group: int = 1) -> Column:
    """First match of a Python pattern, stripped; '' when nothing usable was captured.

    Callers filter on '' themselves: ``nullif`` here would be expanded to two evaluations. Only a
    pattern that Java cannot run (``java_search``) is searched in Python.
    """
    java = java_search(pattern, group_only=group > 0)
    if java is None:
        return _python_search(text, pattern, group)
    return py_strip(F.regexp_extract(text, java, group))


def _quote(char: str) -> str:
    return char if char.isalnum() or char == " " else "\\" + char


def _char_class(chars: Iterable[str]) -> str:
    return "[" + "".join(map(_quote, sorted(set(chars)))) + "]"


def _trie(words: Iterable[str], guard_from: int = 4) -> str:
    """Words as nested alternatives; wide branches first check the next letter in one step."""
    branches: dict[str, list[str]] = {}
    ends = False
    for word in words:
        if word:
            branches.setdefault(word[0], []).append(word[1:])
        else:
            ends = True
    if not branches:
        return ""
    body = "|".join(_quote(c) + _trie(rest) for c, rest in sorted(branches.items()))
    if len(branches) > 1:
        guard = f"(?={_char_class(branches)})" if len(branches) >= guard_from else ""
        body = f"{guard}(?:{body})"
    return f"(?:{body})?" if ends else body


def any_word_pattern(words: Iterable[str], letters_per_group: int = 8) -> str:
    """Pattern whose group 1 is, at every position, the longest of the words that starts there.

    The match itself is empty, so overlapping words are all seen in a single pass whose cost does
    not grow with the number of words. Words are grouped by first letter behind a look-ahead on the
    first two letters, because Java tries alternatives one after the other.
    """
    words = sorted({w for w in words if w})
    if not words:
        return r"(?!)()"
    letters = sorted({w[0] for w in words})
    groups = []
    for i in range(0, len(letters), letters_per_group):
        chosen = letters[i:i + letters_per_group]
        members = [w for w in words if w[0] in chosen]
        guard = _char_class(chosen)
        if all(len(w) > 1 for w in members):
            guard += _char_class(w[1] for w in members)
        groups.append(f"(?={guard}){_trie(members)}")
    return "(?=(" + "|".join(groups) + "))"


# How often a letter stands in English text, per thousand letters, and the space.
_PER_MILLE = {
    " ": 180, "e": 127, "t": 91, "a": 82, "o": 75, "i": 70, "n": 67, "s": 63, "h": 61, "r": 60, "d": 43, "l": 40, "c": 28,
    "u": 28, "m": 24, "w": 24, "f": 22, "g": 20, "y": 20, "p": 19, "b": 15, "v": 10, "k": 8, "j": 2, "x": 2, "q": 1, "z": 1}


def _often(char: str) -> int:
    return _PER_MILLE.get(char, 5)


def _anchor_letters(words: list[str]) -> set[str]:
    """Few and rare letters of which each word has one before its last place: the cheapest letter per word, in turn."""
    open_words, chosen = list(words), set()
    while open_words:
        covers: dict[str, int] = {}
        for word in open_words:
            for c in set(word[:-1]):
                covers[c] = covers.get(c, 0) + 1
        best = min(sorted(covers), key=lambda c: _often(c) / covers[c])
        chosen.add(best)
        open_words = [w for w in open_words if best not in w[:-1]]
    for c in sorted(chosen, key=lambda c: (-_often(c), c)):
        if all((chosen - {c}) & set(w[:-1]) for w in words):
            chosen -= {c}
    return chosen


def anchored_pattern(words: Iterable[str]) -> tuple[str, dict[str, str]]:
    """A pattern for a first pass over a text, and the tail of each word from its anchor on.

    The anchor is a rare letter of the word, one of few for all words. Nearly all positions of a text fail one look
    at a letter, so this pass costs a fraction of one that names the words. Where a whole word stands around an
    anchor, group 1 is its tail, the longest of several. So a word occurs only if its tail begins some tail found.
    Words of one letter or none have no anchor and are left out.
    """
    words = sorted({w for w in words if len(w) > 1})
    if not words:
        return "(?!)()", {}
    letters = _anchor_letters(words)
    heads: dict[str, set[str]] = {}
    tails: dict[str, str] = {}
    for word in words:
        at = min((i for i in range(len(word) - 1) if word[i] in letters),
                 key=lambda i: (_often(word[i]) * _often(word[i + 1]), i))
        tails[word] = word[at:]
        heads.setdefault(word[at:], set()).add(word[:at])

    def literal(text: str) -> str:
        return "".join(map(_quote, text))

    def surrounded(tail: str) -> str:
        before = sorted(heads[tail])
        behind = "" if "" in before else "(?:" + "|".join(f"(?<={literal(b + tail)})" for b in before) + ")"
        return literal(tail[2:]) + behind

    by_pair: dict[str, list[str]] = {}
    for tail in sorted(heads, key=lambda t: (-len(t), t)):
        by_pair.setdefault(tail[:2], []).append(tail)
    by_first: dict[str, list[str]] = {}
    for pair in sorted(by_pair):
        by_first.setdefault(pair[0], []).append(
            _quote(pair[1]) + "(?:" + "|".join(map(surrounded, by_pair[pair])) + ")")
    seconds = {first: {p[1] for p in by_pair if p[0] == first} for first in by_first}
    body = "|".join(f"{_quote(first)}(?={_char_class(seconds[first])})(?:{'|'.join(ways)})"
                    for first, ways in by_first.items())
    # The letter is consumed before anything else is looked at: that is the fast path through a text.
    return f"{_char_class(by_first)}(?={_char_class(p[1] for p in by_pair)})(?<=(?=({body})).)", tails
