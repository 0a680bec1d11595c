"""A subset of RFC 9535 JSONPath: names, indices, slices, wildcards, unions and descendants; no filters."""

from __future__ import annotations

import re
from functools import lru_cache

_NAME = re.compile(r"[A-Za-z_\u0080-\U0010FFFF][\w\u0080-\U0010FFFF-]*")
_INT = re.compile(r"-?(?:0|[1-9]\d*)")
_SLICE = re.compile(r"(-?\d+)?\s*:\s*(-?\d+)?(?:\s*:\s*(-?\d+)?)?")


class JsonPathError(ValueError):
    """The text is not a path of the supported subset."""


def _string(text: str, at: int) -> tuple[str, int]:
    quote, out, i = text[at], [], at + 1
    while i < len(text):
        c = text[i]
        if c == quote:
            return "".join(out), i + 1
        if c == "\\":
            i += 1
            c = text[i : i + 1]
            if c == "u":
                out.append(chr(int(text[i + 1 : i + 5], 16)))
                i += 5
                continue
            known = {"n": "\n", "t": "\t", "r": "\r", "b": "\b", "f": "\f", "/": "/", "\\": "\\", '"': '"', "'": "'"}
            if c not in known:
                raise JsonPathError(f"bad escape in {text!r}")
            c = known[c]
        out.append(c)
        i += 1
    raise JsonPathError(f"open string in {text!r}")


def _bracket(text: str, at: int) -> tuple[list, int]:
    found = []
    while True:
        while text[at : at + 1] == " ":
            at += 1
        c = text[at : at + 1]
        if c == "*":
            found.append(("all",))
            at += 1
        elif c and c in "'\"":
            name, at = _string(text, at)
            found.append(("name", name))
        else:
            m = _SLICE.match(text, at)
            if m:
                start, stop, step = (None if g is None else int(g) for g in m.groups())
                found.append(("slice", start, stop, 1 if step is None else step))
            else:
                m = _INT.match(text, at)
                if not m:
                    raise JsonPathError(f"unsupported selector in {text!r}")
                found.append(("index", int(m[0])))
            at = m.end()
        while text[at : at + 1] == " ":
            at += 1
        if text[at : at + 1] == "]":
            return found, at + 1
        if text[at : at + 1] != ",":
            raise JsonPathError(f"unsupported selector in {text!r}")
        at += 1


@lru_cache(maxsize=4096)
def parse(text: str) -> tuple:
    """((descend, selectors), ...); raises JsonPathError."""
    if not text.startswith("$"):
        raise JsonPathError(f"a path starts with $: {text!r}")
    at, steps = 1, []
    while at < len(text):
        descend = text.startswith("..", at)
        if descend:
            at += 2
        elif text[at] == ".":
            at += 1
        elif text[at] != "[":
            raise JsonPathError(f"unexpected {text[at]!r} in {text!r}")
        if text[at : at + 1] == "[":
            if not descend and text[at - 1] == ".":
                raise JsonPathError(f"unexpected '[' in {text!r}")
            selectors, at = _bracket(text, at + 1)
        elif text[at : at + 1] == "*":
            selectors, at = [("all",)], at + 1
        else:
            m = _NAME.match(text, at)
            if not m:
                raise JsonPathError(f"a name is missing in {text!r}")
            selectors, at = [("name", m[0])], m.end()
        steps.append((descend, tuple(selectors)))
    return tuple(steps)


def _descendants(node):
    yield node
    for child in node.values() if isinstance(node, dict) else node if isinstance(node, list) else ():
        yield from _descendants(child)


def _pick(node, selector):
    kind = selector[0]
    if kind == "name":
        if isinstance(node, dict) and selector[1] in node:
            yield node[selector[1]]
    elif kind == "all":
        yield from node.values() if isinstance(node, dict) else node if isinstance(node, list) else ()
    elif isinstance(node, list):
        if kind == "index":
            if -len(node) <= selector[1] < len(node):
                yield node[selector[1]]
        elif selector[3]:
            yield from node[selector[1] : selector[2] : selector[3]]


def find(path: str, value) -> list:
    """All nodes of value that the path selects, in order."""
    nodes = [value]
    for descend, selectors in parse(path):
        if descend:
            nodes = [d for n in nodes for d in _descendants(n)]
        nodes = [x for n in nodes for s in selectors for x in _pick(n, s)]
    return nodes


MISSING = object()


def first(path: str, value, default=None):
    """The first node the path selects."""
    node = value
    for descend, selectors in parse(path):  # the usual path of names and indices needs no lists
        if descend or len(selectors) > 1 or selectors[0][0] not in ("name", "index"):
            found = find(path, value)
            return found[0] if found else default
        node = next(_pick(node, selectors[0]), MISSING)
        if node is MISSING:
            return default
    return node


def getter(path: str):
    """first() of one path as a function of the value; quick for a plain member of an object."""
    steps = parse(path)
    if len(steps) == 1 and not steps[0][0] and len(steps[0][1]) == 1 and steps[0][1][0][0] == "name":
        name = steps[0][1][0][1]
        return lambda value: value.get(name) if isinstance(value, dict) else None
    return lambda value: first(path, value)
