"""Patterns in RE2 syntax for Java's engine, with RE2's results.

Three things differ: case folding beyond ASCII, which characters count for ``\\b``, and a vertical tab in ``\\s``.
"""

from __future__ import annotations

_SPACE = r"\t\n\f\r "
_WORD = "0-9A-Za-z_"
_BOUNDARY = rf"(?:(?<=[{_WORD}])(?![{_WORD}])|(?<![{_WORD}])(?=[{_WORD}]))"


def to_java(pattern: str) -> str:
    """The Java pattern that matches what RE2 matches; covers the constructs that the rules use."""
    out, i, inside = [], 0, False
    while i < len(pattern):
        two = pattern[i : i + 2]
        if two == "\\s":
            out.append(_SPACE if inside else f"[{_SPACE}]")
        elif two == "\\w":
            out.append(_WORD if inside else f"[{_WORD}]")
        elif two == "\\b" and not inside:
            out.append(_BOUNDARY)
        elif two[0] == "\\":
            out.append(two)
        else:
            if two[0] == "[" and not inside:
                inside = True
            elif two[0] == "]" and inside:
                inside = False
            out.append(two[0])
            i -= 1
        i += 2
    return "".join(out).replace("(?i)", "(?iu)")
