"""Elements of a page by their nesting: cards, and fields inside cards, found by selectors.

Patterns can't tell which end tag closes an element, so that is read by a scanner with a stack of open elements. It is
Python, run by Spark as a table function over Arrow batches; what the fields mean is read by column expressions.

A page's end tags close the nearest open element of their name, and with it all inside; an end tag without one is
ignored. Elements without content never stay open; a list item, paragraph, cell, row or option ends where the next begins.
What is left open ends with its parent, or with the page. Comments, scripts and styles have no elements in them.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache
from html import unescape

#: Fixed values of HTML: elements without content, and those that end where the next of them begins.
EMPTY = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
NEXT_ENDS = {"li", "p", "td", "th", "tr", "option", "dd", "dt"}

_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<(?P<raw>script|style)\b[^>]*+>.*?(?:</(?P=raw)\s*+>|\Z)|<(?P<end>/?)(?P<name>[a-z][a-z0-9:-]*+)(?P<attrs>(?:[^<>"']|"[^"]*"|'[^']*')*+)>""", re.S | re.I)
_ATTR = re.compile(r"""([^\s=/"']+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_STEP = re.compile(r"([a-z][a-z0-9]*)?((?:\.[\w-]+|\[[^\]]+\])*)", re.I)
_TEST = re.compile(r"\.([\w-]+)|\[([\w-]+)(?:(\*?=)([^\]]+))?\]")


class Element:
    __slots__ = ("name", "raw", "parent", "start", "end", "last", "_attrs")

    def __init__(self, name: str, raw: str, parent: Element | None, start: int):
        self.name, self.raw, self.parent, self.start, self.end = name, raw, parent, start, start  # content: html[start:end]
        self.last, self._attrs = 0, None  # last: number of the last element inside

    def get(self, attr: str) -> str | None:
        if self._attrs is None:
            self._attrs = {m[1].lower(): unescape(next((g for g in m.groups()[1:] if g is not None), "")) for m in _ATTR.finditer(self.raw)}
        return self._attrs.get(attr)


def elements(html: str) -> list[Element]:
    """All elements in the order of their start tags."""
    found: list[Element] = []
    stack: list[Element] = []

    def close(upto: int, at: int) -> None:
        while len(stack) > upto:
            own = stack.pop()
            own.end, own.last = at, len(found) - 1

    for m in _TAG.finditer(html):
        _, ending, name, attrs = m.groups()
        if not name:
            continue
        name = name.lower()
        if ending:
            nearest = next((k for k in range(len(stack) - 1, -1, -1) if stack[k].name == name), None)
            if nearest is not None:
                close(nearest, m.start())
            continue
        if name in NEXT_ENDS and stack and stack[-1].name == name:
            close(len(stack) - 1, m.start())
        own = Element(name, attrs, stack[-1] if stack else None, m.end())
        found.append(own)
        own.last = len(found) - 1
        if name not in EMPTY and not attrs.endswith("/"):
            stack.append(own)
    close(0, len(html))
    return found


@cache
def _steps(selector: str) -> list[tuple[str, list[tuple[str, str, str]]]]:
    out = []
    for step in selector.split():
        m = _STEP.fullmatch(step)
        if not m:
            raise ValueError(f"not a selector: {selector}")
        out.append((m[1] or "", [("class", "word", t[1]) if t[1] else (t[2], t[3] or "", (t[4] or "").strip("\"'")) for t in _TEST.finditer(m[2])]))
    return out


def _fits(own: Element, step: tuple) -> bool:
    name, tests = step
    if name and own.name != name:
        return False
    for attr, how, value in tests:
        if value not in own.raw and "&" not in own.raw:  # most elements; an entity may stand for what is looked for
            return False
        has = own.get(attr)
        if has is None or how == "word" and value not in has.split() or how == "=" and has != value or how == "*=" and value not in has:
            return False
    return True


def selects(own: Element, selector: str, inside: Element | None = None) -> bool:
    """Whether own fits a selector of names, .classes, [attributes], [attribute=value], [attribute*=part], and such
    elements that it is in, separated by spaces; they have to be in `inside`."""
    steps = _steps(selector)
    if not _fits(own, steps[-1]):
        return False
    above = steps[:-1]
    while above and (own := own.parent) is not None and own is not inside:
        if _fits(own, above[-1]):
            above.pop()
    return not above


@dataclass(frozen=True)
class Pick:
    """A field of a card: the first element that fits, whose text and the text of the element after it match patterns
    where these are given. Its value is the element's visible text, or an attribute of it."""

    select: str
    attr: str = ""
    text: str = ""
    after: str = ""


def _text(html: str, own: Element) -> str:
    """What of an element can be read: without tags, scripts and styles, one space between words."""
    return " ".join(unescape(_TAG.sub(" ", html[own.start : own.end])).split())


def _value(html: str, found: list[Element], at: int, pick: Pick) -> str | None:
    card, last = found[at], _steps(pick.select)[-1]
    for k in range(at + 1, card.last + 1):
        own = found[k]
        if not _fits(own, last) or not selects(own, pick.select, card) or pick.text and not re.search(pick.text, _text(html, own)):
            continue
        if pick.after:
            sibling = found[own.last + 1] if own.last < card.last else None
            if sibling is None or sibling.parent is not own.parent or not re.search(pick.after, _text(html, sibling)):
                continue
        return own.get(pick.attr) if pick.attr else _text(html, own)
    return None


def cards(html: str | None, marks: tuple[str, ...], picks: dict[str, tuple[Pick, ...]]) -> Iterator[tuple[int, str, str, dict[str, str]]]:
    """Number, content, text and fields of each element that fits one of marks, nested ones too. A field is the first of its picks
    that finds something."""
    if not html:
        return
    found, nth = elements(html), 0
    last = [(mark, _steps(mark)[-1]) for mark in marks]
    for at, own in enumerate(found):
        if any(_fits(own, step) and selects(own, mark) for mark, step in last):
            values = {name: next((v for p in each if (v := _value(html, found, at, p)) is not None), None) for name, each in picks.items()}
            yield nth, html[own.start : own.end], _text(html, own), {k: v for k, v in values.items() if v is not None}
            nth += 1
