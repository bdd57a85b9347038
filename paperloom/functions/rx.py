"""Regular expressions that mean the same to Java and RE2 as the published ones do.

Classes are spelled out, since the engines disagree about Unicode; a Java
pattern gets (?d), so that only a line feed ends a line.
"""

import re

# Latin-1 members one by one: Java keeps those in one bit set.
SPACE = r"\t\n\x0b\f\r\x1c\x1d\x1e\x1f\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
WORD = r"\p{L}\p{N}_"


def portable(pattern: str) -> str:
    """Shorthand classes written out, inside and outside of brackets."""
    out, in_class, i = [], False, 0
    while i < len(pattern):
        two = pattern[i : i + 2]
        if two[:1] == "\\" and len(two) == 2:
            inner = {"\\s": SPACE, "\\w": WORD, "\\d": r"\p{Nd}"}.get(two)
            outer = {"\\S": f"[^{SPACE}]", "\\W": f"[^{WORD}]"}.get(two)
            out.append((inner if in_class else f"[{inner}]") if inner else outer or two)
            i += 2
            continue
        if two[:1] == "[" and not in_class:
            in_class = True
        elif two[:1] == "]" and in_class and out[-1] not in ("[", "[^"):
            in_class = False
        out.append(pattern[i])
        i += 1
    return "".join(out)


#: A backtracking engine tries these from every character of a long run without
#: white space; anchored at the run's start they match the same in linear time.
_LINEAR = {
    r"\S+@\S+\.\S+": r"(?<!\S)\S+@\S+\.\S+",
    r"\S+@\S+": r"(?<!\S)\S+@\S+",
    r"\[?\w+@[\w.]+\]?\(?mailto:[\w@.]+\)?": r"(?:\[|(?<!\w))\w+@[\w.]+\]?\(?mailto:[\w@.]+\)?",
}


def java(pattern: str) -> str:
    """For Spark."""
    pattern = _LINEAR.get(pattern, pattern)
    m = re.match(r"\(\?([a-z]+)\)", pattern)
    flags, rest = (m[1], pattern[m.end() :]) if m else ("", pattern)
    return f"(?d{flags})" + portable(rest)


def sql(pattern: str) -> str:
    """As an SQL literal for an RE2 engine."""
    return "'" + portable(pattern).replace("'", "''") + "'"
