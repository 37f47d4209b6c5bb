"""One spelling of a LaTeX answer: the answer is read into nested groups once, and written again without what has no meaning."""

from __future__ import annotations

import re

#: Wrappers without mathematical content, marks and space that are dropped, fractions of other sizes, and pairs around a formula.
WRAPPERS = frozenset(("\\text", "\\mbox", "\\textbf", "\\textit", "\\mathrm", "\\mathbf"))
DROPPED = frozenset(("\\left", "\\right", "\\!", "\\,", "\\;", "\\:", "\\ ", "~", "\\$", "$", "\\%", "%"))
FRACTIONS = frozenset(("\\frac", "\\dfrac", "\\tfrac"))
AROUND = (("\\(", "\\)"), ("\\[", "\\]"))

_PIECE = re.compile(r"\\[A-Za-z]+|\\.|\s+|.", re.S)


class _Group(list):
    """What stands between two braces; `open` if the second is missing."""

    open = False


def _read(text: str) -> _Group:
    """Pieces (commands, characters, runs of white space) and groups of them. A closing brace that closes nothing is a character."""
    whole = _Group()
    inside = [whole]
    for piece in _PIECE.findall(text):
        if piece == "{":
            group = _Group()
            inside[-1].append(group)
            inside.append(group)
        elif piece == "}" and len(inside) > 1:
            inside.pop()
        else:
            inside[-1].append(piece)
    for group in inside[1:]:
        group.open = True
    return whole


def _bare(pieces: list) -> list:
    """`pieces` without white space and dollars at the ends and without the pairs around them."""
    first, last = 0, len(pieces)
    while first < last:
        if isinstance(pieces[first], str) and (pieces[first].isspace() or pieces[first] == "$"):
            first += 1
        elif isinstance(pieces[last - 1], str) and (pieces[last - 1].isspace() or pieces[last - 1] == "$"):
            last -= 1
        elif last - first > 1 and any(pieces[first] == a and pieces[last - 1] == b for a, b in AROUND):
            first, last = first + 1, last - 1
        else:
            break
    return pieces[first:last]


def _argument(piece) -> str | None:
    """A group or a digit, written as an argument in braces."""
    if isinstance(piece, _Group):
        return None if piece.open else "{" + _write(piece) + "}"
    return "{" + piece + "}" if piece.isdigit() else None


def _write(pieces: list, top: bool = False) -> str:
    out: list[str] = []
    at = 0
    while at < len(pieces):
        piece, after = pieces[at], pieces[at + 1 : at + 3]
        at += 1
        if isinstance(piece, _Group):
            if piece != [","]:
                out.append("{" + _write(piece) + ("" if piece.open else "}"))
        elif piece.isspace() or piece in DROPPED:
            continue
        elif piece == "^" and after and after[0] in ("\\circ", ["\\circ"]):
            at += 1
        elif piece in WRAPPERS and after and isinstance(after[0], _Group) and not after[0].open:
            if top and out and after[0] and str(after[0][0]).isspace():
                break  # a unit: it and what follows say nothing about the value
            out.append(_write(_bare(after[0])))
            at += 1
        elif piece in FRACTIONS:
            arguments = [_argument(x) for x in after]
            out.append("\\frac")
            if len(arguments) == 2 and None not in arguments:
                out += arguments
                at += 2
        elif piece == "\\sqrt" and after and isinstance(after[0], str) and after[0].isdigit():
            out.append("\\sqrt{" + after[0] + "}")
            at += 1
        else:
            out.append(piece)
    return "".join(out)


def spelled(value: str | None) -> str:
    """The one spelling, without white space; '' for a missing answer. What can be told by pattern (a name before =, separators) is left to expressions."""
    return _write(_bare(_read(value or "")), top=True)
