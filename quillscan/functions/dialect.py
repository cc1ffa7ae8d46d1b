"""Translation of RE2-style patterns to java.util.regex.

``$`` without (?m) is the very end; \\s, \\w, \\d and \\b are ASCII; ``.`` stops at line feeds only; a brace that is no repeat
is a literal; classes know no set operations; (?P<n>) is a plain named group; case folding is Unicode's simple one.
Look-around, back-references, atomic groups and possessive repeats don't exist and are refused.
"""

from __future__ import annotations

import re

_REPEAT = re.compile(r"\{(0|[1-9][0-9]*)(,(0|[1-9][0-9]*)?)?\}")
_WORD = "[A-Za-z0-9_]"
_EDGE = rf"(?:(?<={_WORD})(?!{_WORD})|(?<!{_WORD})(?={_WORD}))"
_INNER = rf"(?:(?<={_WORD})(?={_WORD})|(?<!{_WORD})(?!{_WORD}))"
_OUT = {"d": "[0-9]", "D": "[^0-9]", "s": r"[\t\n\f\r ]", "S": r"[^\t\n\f\r ]", "w": _WORD, "W": "[^A-Za-z0-9_]", "b": _EDGE, "B": _INNER, "z": r"\z", "A": r"\A"}
_IN = {"d": "0-9", "s": r"\t\n\f\r ", "w": "A-Za-z0-9_", "D": "[^0-9]", "S": r"[^\t\n\f\r ]", "W": "[^A-Za-z0-9_]"}
_POSIX = {"alnum": "A-Za-z0-9", "alpha": "A-Za-z", "ascii": r"\x00-\x7F", "blank": r"\t ", "cntrl": r"\x00-\x1F\x7F", "digit": "0-9", "graph": "!-~", "lower": "a-z", "print": " -~", "punct": r"!-/:-@\[-`{-~", "space": r"\t\n\x0B\f\r ", "upper": "A-Z", "word": "A-Za-z0-9_", "xdigit": "0-9A-Fa-f"}
MAX_REPEAT = 1000


class PatternError(ValueError):
    pass


def to_java(pattern: str) -> str:
    """The Java pattern with the same matches; PatternError if RE2 wouldn't take it."""
    out, i, n = ["(?d)"], 0, len(pattern)
    stack: list[bool] = []
    multiline = False
    repeatable = False
    while i < n:
        c = pattern[i]
        if c == "\\":
            text, i = _escape(pattern, i, _OUT)
            out.append(text)
            repeatable = True
        elif c == "[":
            text, i = _class(pattern, i)
            out.append(text)
            repeatable = True
        elif c == "(":
            stack.append(multiline)
            repeatable = False
            if pattern.startswith("(?", i):
                m = re.match(r"\(\?(?:P?<([A-Za-z_][A-Za-z0-9_]*)>|([imsU]*)(?:-([imsU]+))?([:)]))", pattern[i:])
                if not m:
                    raise PatternError(f"unsupported group at {i}: {pattern[i : i + 5]}")
                if m[1]:
                    out.append(f"(?<g{sum(1 for x in out if x.startswith('(?<g')) + 1}x>")
                else:
                    if "U" in (m[2] or "") + (m[3] or ""):
                        raise PatternError("the flag U isn't supported")
                    on, off = m[2] or "", m[3] or ""
                    multiline = (multiline or "m" in on) and "m" not in off
                    flags = on.replace("i", "iu") + (f"-{off.replace('i', 'iu')}" if off else "")
                    out.append(f"(?{flags}{m[4]}")
                    if m[4] == ")":
                        stack.pop()
                i += m.end()
            else:
                out.append("(")
                i += 1
        elif c == ")":
            if not stack:
                raise PatternError("unmatched )")
            multiline = stack.pop()
            out.append(")")
            i, repeatable = i + 1, True
        elif c == "$":
            out.append("$" if multiline else r"\z")
            i, repeatable = i + 1, False
        elif c in "*+?" or c == "{" and _REPEAT.match(pattern, i):
            m = _REPEAT.match(pattern, i)
            text = m.group() if m else c
            if not repeatable:
                raise PatternError(f"nothing to repeat at {i}")
            if m and max(int(x) for x in (m[1], m[3]) if x) > MAX_REPEAT:
                raise PatternError("a repeat over 1000")
            i += len(text)
            if pattern.startswith("?", i):
                text, i = text + "?", i + 1
            out.append(text)
            repeatable = False
        elif c in "{}":
            out.append("\\" + c)
            i, repeatable = i + 1, True
        elif c == "^" or c == "|":
            out.append(c)
            i, repeatable = i + 1, False
        elif c == "]":
            out.append(r"\]")
            i, repeatable = i + 1, True
        else:
            out.append(c)
            i, repeatable = i + 1, True
    if stack:
        raise PatternError("missing )")
    return "".join(out)


def _escape(p: str, i: int, table: dict[str, str]) -> tuple[str, int]:
    if i + 1 >= len(p):
        raise PatternError("trailing backslash")
    c = p[i + 1]
    if c in table:
        return table[c], i + 2
    if c == "Q":
        end = p.find(r"\E", i + 2)
        text = p[i + 2 :] if end < 0 else p[i + 2 : end]
        return "".join("\\" + x if not x.isalnum() and x.isascii() else x for x in text), len(p) if end < 0 else end + 2
    if c == "x":
        m = re.match(r"\\x(?:\{([0-9A-Fa-f]{1,6})\}|([0-9A-Fa-f]{2}))", p[i:])
        if not m:
            raise PatternError("bad \\x")
        return rf"\x{{{m[1] or m[2]}}}", i + m.end()
    if c in "pP":
        m = re.match(r"\\[pP](?:\{\^?[A-Za-z_]+\}|[A-Z])", p[i:])
        if not m:
            raise PatternError("bad \\p")
        return m.group(), i + m.end()
    if c in "tnrfav":
        return {"a": r"\x07", "v": r"\x0B"}.get(c, "\\" + c), i + 2
    if c.isalnum():
        raise PatternError(f"unknown escape \\{c}")
    return "\\" + c, i + 2


def _class(p: str, i: int) -> tuple[str, int]:
    j, out = i + 1, "["
    if p.startswith("^", j):
        out, j = "[^", j + 1
    first = True
    while True:
        if j >= len(p):
            raise PatternError("missing ]")
        c = p[j]
        if c == "]" and not first:
            return out + "]", j + 1
        first = False
        if m := re.match(r"\[:(\^?)([a-z]+):\]", p[j:]):
            if m[2] not in _POSIX:
                raise PatternError(f"unknown class {m[2]}")
            out += f"[^{_POSIX[m[2]]}]" if m[1] else _POSIX[m[2]]
            j += m.end()
        elif c == "\\":
            text, j = _escape(p, j, _IN)
            out += text
        elif c in "[&~]" or c == "^":
            out, j = out + "\\" + c, j + 1
        else:
            out, j = out + c, j + 1


def group_count(pattern: str) -> int:
    """How many capturing groups a pattern has."""
    java = re.sub(r"\\.", "", to_java(pattern))
    java = re.sub(r"\[[^\]]*\]", "", java)
    return len(re.findall(r"\((?!\?)|\(\?<g", java))
