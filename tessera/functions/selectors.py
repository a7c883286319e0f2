"""CSS selectors over parsed trees. A selector that can't be read matches nothing."""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import lru_cache

from tessera.functions.html import Node

Test = Callable[[Node], bool]
_NAME = r"-?(?:[A-Za-z_\u0080-\U0010ffff]|\\.)(?:[\w\-\u0080-\U0010ffff]|\\.)*"
_ATTRIBUTE = re.compile(rf"\[\s*({_NAME})\s*(?:([~|^$*!]?=)\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\]]+))\s*([iI])?\s*)?\]")
_NTH = re.compile(r"^(?:(odd|even)|([+-]?\d*)n\s*(?:([+-])\s*(\d+))?|([+-]?\d+))$")


class Bad(ValueError):
    """A selector that can't be read."""


def _siblings(n: Node) -> list[Node]:
    return [c for c in n.parent.children if c.element] if n.parent is not None else [n]


def _nth(text: str) -> tuple[int, int]:
    m = _NTH.match(text.strip().lower())
    if not m:
        raise Bad(text)
    if m[1]:
        return 2, int(m[1] == "odd")
    if m[5]:
        return 0, int(m[5])
    a = int(m[2] + "1") if m[2] in ("", "+", "-") else int(m[2])
    return a, int((m[3] or "+") + m[4]) if m[4] else 0


def _at(k: int, a: int, b: int) -> bool:
    return k == b if a == 0 else (k - b) % a == 0 and (k - b) // a >= 0


def _attribute(m: re.Match) -> Test:
    name, op, fold = m[1].lower(), m[2], bool(m[6])
    want = next((v for v in m.groups()[2:5] if v is not None), "")
    want = want.lower() if fold else want

    def test(n: Node) -> bool:
        v = n.attrs.get(name)
        if op == "!=":
            return v != want
        if v is None:
            return False
        v = v.lower() if fold else v
        if op is None:
            return True
        if op == "=":
            return v == want
        if op == "~=":
            return bool(want) and want in v.split()
        if op == "|=":
            return v == want or v.startswith(want + "-")
        return bool(want) and {"^=": v.startswith, "$=": v.endswith, "*=": v.__contains__}[op](want)

    return test


def _argument(s: str, at: int) -> tuple[str, int]:
    """The text in the parentheses that open at ``at``, and where they end."""
    depth, k, quote = 0, at, ""
    while k < len(s):
        c = s[k]
        if quote:
            quote = "" if c == quote else quote
        elif c in "\"'":
            quote = c
        elif c == "(":
            depth += 1
        elif c == ")":
            depth -= 1
            if not depth:
                return s[at + 1 : k], k + 1
        k += 1
    raise Bad(s)


def _pseudo(name: str, arg: str | None) -> Test:
    def place(of_type: bool, last: bool, a: int, b: int) -> Test:
        def test(n: Node) -> bool:
            if n.parent is None or n.parent.tag == "#document":
                return False
            same = [c for c in _siblings(n) if not of_type or c.tag == n.tag]
            k = next(i for i, c in enumerate(same) if c is n)
            return _at(len(same) - k if last else k + 1, a, b)

        return test

    m = re.match(r"^(nth|first|last|only)-(last-)?(child|of-type)$", name)
    if m:
        of_type = m[3] == "of-type"
        if m[1] == "nth":
            return place(of_type, bool(m[2]), *_nth(arg or ""))
        first, last = place(of_type, False, 0, 1), place(of_type, True, 0, 1)
        return {"first": first, "last": last, "only": lambda n: first(n) and last(n)}[m[1]]
    if name in ("not", "is", "where", "has") and arg is not None:
        inner = compiled(arg)
        if name == "not":
            return lambda n: not inner(n)
        if name == "has":
            return lambda n: any(inner(x) for x in n.elements())
        return inner
    if name in ("contains", "containsown") and arg is not None:
        want = arg.strip().strip("\"'")
        own = name == "containsown"
        return lambda n: want in ("".join(c.data for c in n.children if c.tag == "#text") if own else n.text())
    if name == "empty":
        return lambda n: not any(c.element or c.tag == "#text" for c in n.children)
    if name == "root":
        return lambda n: n.parent is not None and n.parent.tag == "#document"
    raise Bad(name)


def _compound(s: str, at: int) -> tuple[Test, int]:
    tests: list[Test] = []
    begin = at
    m = re.compile(rf"\*|{_NAME}").match(s, at)
    if m:
        if m[0] != "*":
            tests.append(lambda n, t=m[0].lower(): n.tag == t)
        at = m.end()
    while at < len(s):
        c = s[at]
        if c in ".#":
            m = re.compile(_NAME if c == "." else r"(?:[\w\-\u0080-\U0010ffff]|\\.)+").match(s, at + 1)
            if not m:
                raise Bad(s)
            name, at = m[0].replace("\\", ""), m.end()
            tests.append((lambda n, x=name: x in n.attrs.get("class", "").split()) if c == "." else (lambda n, x=name: n.attrs.get("id") == x))
        elif c == "[":
            m = _ATTRIBUTE.match(s, at)
            if not m:
                raise Bad(s)
            tests.append(_attribute(m))
            at = m.end()
        elif c == ":":
            m = re.compile(r"::?([A-Za-z-]+)").match(s, at)
            if not m or m[0].startswith("::"):
                raise Bad(s)
            at, arg = m.end(), None
            if s.startswith("(", at):
                arg, at = _argument(s, at)
            tests.append(_pseudo(m[1].lower(), arg))
        else:
            break
    if at == begin:
        raise Bad(s)
    return (tests[0] if len(tests) == 1 else (lambda n: all(t(n) for t in tests))), at


def _joined(left: Test, how: str, right: Test) -> Test:
    def up(n: Node) -> bool:
        p = n.parent
        while p is not None and p.element:
            if left(p):
                return True
            p = p.parent
        return False

    def before(n: Node) -> list[Node]:
        out = []
        for c in _siblings(n):
            if c is n:
                break
            out.append(c)
        return out

    if how == ">":
        return lambda n: right(n) and n.parent is not None and n.parent.element and left(n.parent)
    if how == "+":
        return lambda n: right(n) and bool(b := before(n)) and left(b[-1])
    if how == "~":
        return lambda n: right(n) and any(left(b) for b in before(n))
    return lambda n: right(n) and up(n)


def _complex(s: str, at: int) -> tuple[Test, int]:
    test, at = _compound(s, at)
    while True:
        m = re.compile(r"\s*([>+~])\s*|\s+(?![,\s]|$)").match(s, at)
        if not m:
            return test, at
        right, at = _compound(s, m.end())
        test = _joined(test, m[1] or " ", right)


@lru_cache(4096)
def compiled(selector: str) -> Test:
    """The test of a selector; ``Bad`` if it can't be read."""
    s, at, tests = selector.strip(), 0, []
    while True:
        while at < len(s) and s[at].isspace():
            at += 1
        test, at = _complex(s, at)
        tests.append(test)
        while at < len(s) and s[at].isspace():
            at += 1
        if at == len(s):
            break
        if s[at] != ",":
            raise Bad(selector)
        at += 1
    return tests[0] if len(tests) == 1 else (lambda n: any(t(n) for t in tests))


_SIMPLE = re.compile(rf"^(?:({_NAME})|([.#])({_NAME})|\[\s*({_NAME})\s*(?:(\*?=)\s*['\"]([^'\"]+)['\"]\s*)?\])$")


class Traits:
    """What the elements of a tree have, to rule out simple selectors without a look at each element."""

    def __init__(self, elements: list[Node]):
        self.tags, self.values = set(), {}
        for n in elements:
            self.tags.add(n.tag)
            for k, v in n.attrs.items():
                if k in self.values:
                    self.values[k].append(v)
                else:
                    self.values[k] = [v]
        self.classes = {c for v in self.values.get("class", ()) for c in v.split()}
        self.ids = set(self.values.get("id", ()))

    def may_match(self, selector: str) -> bool:
        """False only if no element matches."""
        tag, mark, name, attribute, op, want = _simple(selector)
        if tag:
            return tag in self.tags
        if mark:
            return name in (self.classes if mark == "." else self.ids)
        if attribute:
            values = self.values.get(attribute, ())
            return bool(values) if not op else any(want in v for v in values)
        return True


@lru_cache(4096)
def _simple(selector: str) -> tuple:
    m = _SIMPLE.match(selector)
    if not m or "\\" in selector:
        return (None,) * 6
    return m[1] and m[1].lower(), m[2], m[3], m[4] and m[4].lower(), m[5], m[6]


@lru_cache(4096)
def matcher(selector: str) -> Test:
    """The test of a selector; one that can't be read matches nothing."""
    try:
        return compiled(selector)
    except Bad:
        return lambda n: False


def select(root: Node, selector: str) -> list[Node]:
    """The elements below ``root`` that match, in document order."""
    test = matcher(selector)
    return [n for n in root.elements() if test(n)]
