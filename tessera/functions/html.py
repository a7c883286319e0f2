"""HTML parsing by the rules of the HTML Standard, and serialising.

A small tree builder in pure Python: it runs in Arrow functions on executors, where no
HTML library can be taken for granted. It follows the standard's tree construction
with scripting on: implied elements, raw text, void elements, active formatting
elements with reconstruction and the adoption agency, and foster parenting in tables.
"""

from __future__ import annotations

import html as _entities
import re
from collections.abc import Iterator

VOID = frozenset("area base br col embed hr img input keygen link meta param source track wbr".split())
RAW = frozenset("script style xmp iframe noembed noframes noscript plaintext".split())
RCDATA = frozenset(("title", "textarea"))
FORMATTING = frozenset("a b big code em font i nobr s small strike strong tt u".split())
HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))
SPECIAL = frozenset(
    """address applet area article aside base basefont bgsound blockquote body br button caption center col colgroup dd
    details dir div dl dt embed fieldset figcaption figure footer form frame frameset h1 h2 h3 h4 h5 h6 head header hgroup hr
    html iframe img input keygen li link listing main marquee menu meta nav noembed noframes noscript object ol p param
    plaintext pre script search section select source style summary table tbody td template textarea tfoot th thead title tr track
    ul wbr xmp""".split()
)
CLOSES_P = frozenset(
    """address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer header hgroup
    main menu nav ol p search section summary ul""".split()
)
HEAD_ONLY = frozenset("base basefont bgsound link meta noframes script style template title".split())
SCOPE = frozenset("applet caption html table td th marquee object template".split())
IMPLIED_END = frozenset("dd dt li optgroup option p rb rp rt rtc".split())
TABLE_PARTS = frozenset(("table", "tbody", "tfoot", "thead", "tr"))
SPACES = " \t\n\f\r"


class Node:
    """An element, or a text ('#text'), comment ('#comment'), doctype ('#doctype') or the document ('#document')."""

    __slots__ = ("tag", "attrs", "children", "parent", "data")

    def __init__(self, tag: str, attrs: dict[str, str] | None = None, data: str = ""):
        self.tag, self.attrs, self.children, self.parent, self.data = tag, attrs or {}, [], None, data

    @property
    def element(self) -> bool:
        return self.tag[0] != "#"

    def append(self, node: Node) -> None:
        node.parent = self
        self.children.append(node)

    def insert_before(self, node: Node, before: Node) -> None:
        node.parent = self
        self.children.insert(next(k for k, c in enumerate(self.children) if c is before), node)

    def detach(self) -> None:
        if self.parent is not None:
            self.parent.children = [c for c in self.parent.children if c is not self]
            self.parent = None

    def replace(self, nodes: list[Node]) -> None:
        """Put ``nodes`` where this node is."""
        up, at = self.parent, next(k for k, c in enumerate(self.parent.children) if c is self)
        for n in nodes:
            n.parent = up
        up.children[at : at + 1] = nodes
        self.parent = None

    def walk(self) -> Iterator[Node]:
        """All nodes below this one in document order. What is removed meanwhile is still visited."""
        todo = list(reversed(self.children))
        while todo:
            n = todo.pop()
            yield n
            if n.children:
                todo.extend(reversed(n.children))

    # These three are where most visits are, so they have loops of their own.
    def elements(self) -> list[Node]:
        out, todo = [], self.children[::-1]
        while todo:
            n = todo.pop()
            if n.tag[0] != "#":
                out.append(n)
                if n.children:
                    todo += n.children[::-1]
        return out

    def text(self) -> str:
        if self.tag == "#text":
            return self.data
        out, todo = [], self.children[::-1]
        while todo:
            n = todo.pop()
            if n.tag == "#text":
                out.append(n.data)
            elif n.children:
                todo += n.children[::-1]
        return "".join(out)

    def first(self, tag: str) -> Node | None:
        todo = self.children[::-1]
        while todo:
            n = todo.pop()
            if n.tag == tag:
                return n
            if n.children:
                todo += n.children[::-1]
        return None


_TAG = re.compile(r"<(?:(!--)|(!)|(\?)|(/)?([A-Za-z][^\s/>]*))")
_ATTR = re.compile(r"[\s/]*(?:([^\s/>=][^\s/>=]*|=[^\s/>=]*)\s*(?:=\s*(?:\"([^\"]*)(?:\"|$)|'([^']*)(?:'|$)|([^\s>]*)))?)")
# Tags as they are mostly written: an end tag, or a start tag with double-quoted values or none.
_PLAIN = re.compile(r"<(?:/([A-Za-z][^\s/>]*)\s*>|([A-Za-z][A-Za-z0-9\-]*)((?:\s+[A-Za-z_:@][^\s\"'<>/=]*(?:=\"[^\"]*\")?(?=[\s>]))*)\s*>)")
_PAIR = re.compile(r"([A-Za-z_:@][^\s\"'<>/=]*)(?:=\"([^\"]*)\")?")
_COMMENT_END = re.compile(r"--!?>")


def _unescape(s: str, attribute: bool = False) -> str:
    if "&" not in s:
        return s
    if not attribute:
        return _entities.unescape(s)
    # In attributes, a name without semicolon before = or an alphanumeric sign stays as it is.
    return re.sub(r"&(?:#[0-9]+;?|#[xX][0-9A-Fa-f]+;?|[A-Za-z][A-Za-z0-9]*(?:;|(?![=A-Za-z0-9])))", lambda m: _entities.unescape(m[0]), s)


def tokenize(src: str) -> Iterator[tuple]:
    """('text', s), ('comment', s), ('doctype', s), ('start', tag, attrs, self_closing), ('end', tag).

    After a start tag the consumer may send 'raw' tags by way of ``RAW`` and ``RCDATA``:
    their content is taken up to the matching end tag."""
    src = src.replace("\r\n", "\n").replace("\r", "\n")
    at, n, held = 0, len(src), 0
    while at < n:
        lt = src.find("<", at)
        if lt < 0:
            break
        m = _PLAIN.match(src, lt)
        if m:
            if lt > held:
                yield "text", _unescape(src[held:lt])
            held = at = m.end()
            if m.group(1):
                yield "end", m.group(1).lower()
                continue
            tag, attrs = m.group(2).lower(), {}
            if m.group(3):
                for k, v in _PAIR.findall(m.group(3)):
                    attrs.setdefault(k.lower(), _unescape(v, True) if "&" in v else v)
            yield "start", tag, attrs, False
            if tag in RAW or tag in RCDATA:
                held = at = yield from _raw(src, tag, at)
            continue
        m = _TAG.match(src, lt)
        if not m:
            at = lt + 1
            continue
        if m.start() > held:
            yield "text", _unescape(src[held : m.start()])
        if m.group(1):
            body = m.end()
            if src.startswith(">", body) or src.startswith("->", body):
                held = at = body + (1 if src[body] == ">" else 2)
                yield "comment", ""
                continue
            e = _COMMENT_END.search(src, body)
            yield "comment", src[body : e.start() if e else n]
            held = at = e.end() if e else n
        elif m.group(2) or m.group(3):
            e = src.find(">", m.end())
            e = n if e < 0 else e
            body = src[m.end() : e]
            if m.group(2) and body[:7].lower() == "doctype":
                yield "doctype", body[7:].strip()
            else:
                yield "comment", body if m.group(2) else "?" + body
            held = at = min(e + 1, n)
        else:
            tag, pos, attrs, closed = m.group(5).lower(), m.end(), {}, False
            while True:
                while pos < n and (src[pos] in SPACES or src[pos] == "/"):
                    closed = src[pos] == "/"
                    pos += 1
                if pos >= n or src[pos] == ">":
                    break
                closed = False
                a = _ATTR.match(src, pos)
                value = next((v for v in a.groups()[1:] if v is not None), "")
                attrs.setdefault(a.group(1).lower(), _unescape(value, True))
                pos = max(a.end(), pos + 1)
            if pos >= n:  # a tag that doesn't end is dropped
                return
            held = at = pos + 1
            if m.group(4):
                yield "end", tag
                continue
            yield "start", tag, attrs, closed
            if tag in RAW or tag in RCDATA:
                held = at = yield from _raw(src, tag, at)
    if held < n:
        yield "text", _unescape(src[held:])


_ENDS = {t: re.compile(rf"</{t}(?=[\s/>])", re.I) for t in (RAW | RCDATA) - {"plaintext"}}


def _raw(src: str, tag: str, at: int) -> Iterator[tuple]:
    """The content of a raw element as a token; returns where its end tag is."""
    e = _ENDS[tag].search(src, at) if tag in _ENDS else None
    stop = e.start() if e else len(src)
    if stop > at:
        body = src[at:stop]
        yield "raw", _unescape(body) if tag in RCDATA else body
    return stop


MODES = "initial before_html before_head head after_head body after_body table table_body row cell caption colgroup select".split()


class Builder:
    """Tree construction. ``parse`` and ``parse_fragment`` are its uses."""

    def __init__(self) -> None:
        self.doc = Node("#document")
        self.stack: list[Node] = []
        self.active: list[Node | None] = []
        self.head: Node | None = None
        self.form: Node | None = None
        self.mode = "initial"
        self.foster = False
        self.frameset_ok = True
        self.drop_newline = False

    # -- where nodes go
    @property
    def top(self) -> Node:
        return self.stack[-1]

    def _place(self, override: Node | None = None) -> tuple[Node, Node | None]:
        target = override or self.top
        if self.foster and target.tag in TABLE_PARTS:
            table = next((n for n in reversed(self.stack) if n.tag == "table"), None)
            if table is None:
                return self.stack[0], None
            if table.parent is not None:
                return table.parent, table
            return self.stack[self.stack.index(table) - 1], None
        return target, None

    def put(self, node: Node, override: Node | None = None) -> None:
        where, before = self._place(override)
        if before is None:
            where.append(node)
        else:
            where.insert_before(node, before)

    def put_text(self, s: str) -> None:
        if not s:
            return
        where, before = self._place() if self.foster else (self.stack[-1], None)
        if before is None:
            last = where.children[-1] if where.children else None
        else:
            k = next(k for k, c in enumerate(where.children) if c is before)
            last = where.children[k - 1] if k else None
        if last is not None and last.tag == "#text":
            last.data += s
        else:
            self.put(Node("#text", data=s))

    def open(self, tag: str, attrs: dict[str, str] | None = None) -> Node:
        node = Node(tag, attrs)
        if self.foster:
            self.put(node)
        else:
            node.parent = top = self.stack[-1]
            top.children.append(node)
        self.stack.append(node)
        return node

    # -- the stack
    def in_scope(self, tags, extra: frozenset = frozenset()) -> bool:
        tags = (tags,) if isinstance(tags, str) else tags
        for n in reversed(self.stack):
            if n.tag in tags:
                return True
            if n.tag in SCOPE or n.tag in extra:
                return False
        return False

    def in_table_scope(self, tags) -> bool:
        tags = (tags,) if isinstance(tags, str) else tags
        for n in reversed(self.stack):
            if n.tag in tags:
                return True
            if n.tag in ("html", "table", "template"):
                return False
        return False

    def imply_ends(self, but: str = "") -> None:
        while self.top.tag in IMPLIED_END and self.top.tag != but:
            self.stack.pop()

    def pop_to(self, tags) -> None:
        tags = (tags,) if isinstance(tags, str) else tags
        while self.stack:
            if self.stack.pop().tag in tags:
                return

    def pop_down_to(self, tags) -> None:
        while self.top.tag not in tags:
            self.stack.pop()

    def close_p(self) -> None:
        if self.in_scope("p", frozenset(("button",))):
            self.imply_ends("p")
            self.pop_to("p")

    # -- active formatting
    def remember(self, node: Node) -> None:
        same = []
        for k in range(len(self.active) - 1, -1, -1):
            n = self.active[k]
            if n is None:
                break
            if n.tag == node.tag and n.attrs == node.attrs:
                same.append(k)
        if len(same) >= 3:
            del self.active[same[-1]]
        self.active.append(node)

    def reconstruct(self) -> None:
        if not self.active or self.active[-1] is None or self.active[-1] in self.stack:
            return
        k = len(self.active) - 1
        while k > 0 and self.active[k - 1] is not None and self.active[k - 1] not in self.stack:
            k -= 1
        for k in range(k, len(self.active)):
            old = self.active[k]
            self.active[k] = self.open(old.tag, dict(old.attrs))

    def clear_to_marker(self) -> None:
        while self.active and self.active.pop() is not None:
            pass

    def adopt(self, tag: str) -> None:
        if self.top.tag == tag and self.top not in self.active:
            self.stack.pop()
            return
        for _ in range(8):
            fmt = None
            for n in reversed(self.active):
                if n is None:
                    break
                if n.tag == tag:
                    fmt = n
                    break
            if fmt is None:
                self.any_end(tag)
                return
            if fmt not in self.stack:
                self.active.remove(fmt)
                return
            if not self.in_scope_node(fmt):
                return
            at = self.stack.index(fmt)
            furthest = next((n for n in self.stack[at + 1 :] if n.tag in SPECIAL), None)
            if furthest is None:
                del self.stack[at:]
                self.active.remove(fmt)
                return
            ancestor = self.stack[at - 1]
            bookmark = self.active.index(fmt)
            node_at = self.stack.index(furthest)
            last, inner = furthest, 0
            while True:
                inner += 1
                node_at -= 1
                node = self.stack[node_at]
                if node is fmt:
                    break
                if inner > 3 and node in self.active:
                    k = self.active.index(node)
                    del self.active[k]
                    bookmark -= k < bookmark
                if node not in self.active:
                    del self.stack[node_at]
                    continue
                new = Node(node.tag, dict(node.attrs))
                self.active[self.active.index(node)] = new
                self.stack[node_at] = new
                if last is furthest:
                    bookmark = self.active.index(new) + 1
                last.detach()
                new.append(last)
                last = new
            last.detach()
            kept, self.foster = self.foster, True
            self.put(last, ancestor)
            self.foster = kept
            new = Node(fmt.tag, dict(fmt.attrs))
            for c in furthest.children:
                new.append(c)
            furthest.children = []
            furthest.append(new)
            k = self.active.index(fmt)
            del self.active[k]
            self.active.insert(bookmark - (k < bookmark), new)
            self.stack.remove(fmt)
            self.stack.insert(self.stack.index(furthest) + 1, new)

    def in_scope_node(self, node: Node) -> bool:
        for n in reversed(self.stack):
            if n is node:
                return True
            if n.tag in SCOPE:
                return False
        return False

    def any_end(self, tag: str) -> None:
        for k in range(len(self.stack) - 1, -1, -1):
            n = self.stack[k]
            if n.tag == tag:
                self.imply_ends(tag)
                del self.stack[k:]
                return
            if n.tag in SPECIAL:
                return

    # -- modes
    def feed(self, src: str) -> Node:
        modes = {m: getattr(self, "in_" + m) for m in MODES}
        for token in tokenize(src.replace("\x00", "")):
            kind = token[0]
            if kind == "raw":
                s = token[1]
                if self.drop_newline and s.startswith("\n"):
                    s = s[1:]
                self.drop_newline = False
                if self.raw_ok:
                    self.put_text_raw(s)
                continue
            if kind == "text" and self.drop_newline and token[1].startswith("\n"):
                token = ("text", token[1][1:])
            self.drop_newline = False
            self.raw_ok = True
            modes[self.mode](token)
        self.finish()
        return self.doc

    raw_ok = True

    def put_text_raw(self, s: str) -> None:
        if s:
            self.top.append(Node("#text", data=s))

    def finish(self) -> None:
        if self.mode in ("initial", "before_html", "before_head", "in_head", "after_head", "head"):
            self.need_body()

    def need_html(self) -> None:
        if not self.stack:
            self.open_root({})
        if self.mode in ("initial", "before_html"):
            self.mode = "before_head"

    def open_root(self, attrs: dict[str, str]) -> None:
        root = Node("html", attrs)
        self.doc.append(root)
        self.stack.append(root)

    def need_head(self) -> None:
        self.need_html()
        if self.head is None:
            self.head = self.open("head")
            self.mode = "head"

    def need_body(self) -> None:
        self.need_head()
        if self.mode == "head":
            self.stack.pop()
            self.mode = "after_head"
        if self.mode == "after_head":
            self.open("body")
            self.mode = "body"

    def in_initial(self, t: tuple) -> None:
        if t[0] == "text" and not t[1].strip(SPACES):
            return
        if t[0] == "comment":
            self.doc.append(Node("#comment", data=t[1]))
        elif t[0] == "doctype":
            self.doc.append(Node("#doctype", data=t[1]))
            self.mode = "before_html"
        else:
            self.mode = "before_html"
            self.in_before_html(t)

    def in_before_html(self, t: tuple) -> None:
        if t[0] == "doctype" or (t[0] == "text" and not t[1].strip(SPACES)):
            return
        if t[0] == "comment":
            self.doc.append(Node("#comment", data=t[1]))
        elif t[0] == "start" and t[1] == "html":
            self.open_root(t[2])
            self.mode = "before_head"
        elif t[0] == "end" and t[1] not in ("head", "body", "html", "br"):
            return
        else:
            self.need_html()
            self.in_before_head(t)

    def in_before_head(self, t: tuple) -> None:
        if t[0] == "text":
            t = ("text", t[1].lstrip(SPACES))
            if not t[1]:
                return
        if t[0] == "doctype":
            return
        if t[0] == "comment":
            self.put(Node("#comment", data=t[1]))
        elif t[0] == "start" and t[1] == "html":
            self.merge(self.stack[0], t[2])
        elif t[0] == "start" and t[1] == "head":
            self.head = self.open("head", t[2])
            self.mode = "head"
        elif t[0] == "end" and t[1] not in ("head", "body", "html", "br"):
            return
        else:
            self.need_head()
            self.in_head(t)

    @staticmethod
    def merge(node: Node, attrs: dict[str, str]) -> None:
        for k, v in attrs.items():
            node.attrs.setdefault(k, v)

    def in_head(self, t: tuple) -> None:
        if t[0] == "text":
            lead = t[1][: len(t[1]) - len(t[1].lstrip(SPACES))]
            if lead:
                self.put_text(lead)
            t = ("text", t[1][len(lead) :])
            if not t[1]:
                return
        if t[0] == "comment":
            self.put(Node("#comment", data=t[1]))
        elif t[0] == "doctype":
            return
        elif t[0] == "start" and t[1] == "html":
            self.merge(self.stack[0], t[2])
        elif t[0] == "start" and (t[1] in HEAD_ONLY or t[1] == "noscript"):
            self.head_element(t)
        elif t[0] == "start" and t[1] == "head":
            self.raw_ok = False
        elif t[0] == "end" and t[1] in RAW | RCDATA | {"template"} and self.top.tag == t[1]:
            self.stack.pop()
        elif t[0] == "end" and t[1] == "head":
            self.pop_to("head")
            self.mode = "after_head"
        elif t[0] == "end" and t[1] not in ("body", "html", "br"):
            return
        else:
            if self.top.tag != "head":  # text after an element that never ended
                self.pop_down_to(("head",))
            self.stack.pop()
            self.mode = "after_head"
            self.in_after_head(t)

    def head_element(self, t: tuple) -> None:
        self.open(t[1], t[2])
        if t[1] in VOID or t[1] in ("basefont", "bgsound"):
            self.stack.pop()

    def in_after_head(self, t: tuple) -> None:
        if t[0] == "end" and self.top.tag == t[1] and t[1] in RAW | RCDATA | {"template"}:
            self.stack.pop()
            if self.top.tag == "head":
                self.stack.pop()
            return
        if t[0] == "text":
            lead = t[1][: len(t[1]) - len(t[1].lstrip(SPACES))]
            if lead:
                self.put_text(lead)
            t = ("text", t[1][len(lead) :])
            if not t[1]:
                return
        if t[0] == "comment":
            self.put(Node("#comment", data=t[1]))
        elif t[0] == "doctype":
            return
        elif t[0] == "start" and t[1] == "html":
            self.merge(self.stack[0], t[2])
        elif t[0] == "start" and t[1] == "body":
            self.open("body", t[2])
            self.mode = "body"
        elif t[0] == "start" and t[1] in HEAD_ONLY:
            self.stack.append(self.head)
            self.head_element(t)
            if self.top is self.head:
                self.stack.pop()
        elif (t[0] == "start" and t[1] == "head") or (t[0] == "end" and t[1] not in ("body", "html", "br")):
            self.raw_ok = False
        else:
            self.open("body")
            self.mode = "body"
            self.in_body(t)

    def in_body(self, t: tuple) -> None:
        kind = t[0]
        if kind == "text":
            self.reconstruct()
            self.put_text(t[1])
        elif kind == "comment":
            self.put(Node("#comment", data=t[1]))
        elif kind == "start":
            self.body_start(t[1], t[2], t[3])
        elif kind == "end":
            self.body_end(t[1])

    def body_start(self, tag: str, attrs: dict[str, str], closed: bool) -> None:
        if tag == "html":
            self.merge(self.stack[0], attrs)
        elif tag == "body":
            if len(self.stack) > 1 and self.stack[1].tag == "body":
                self.merge(self.stack[1], attrs)
        elif tag in HEAD_ONLY:
            self.head_element((None, tag, attrs))
        elif tag in CLOSES_P:
            self.close_p()
            self.open(tag, attrs)
        elif tag in HEADINGS:
            self.close_p()
            if self.top.tag in HEADINGS:
                self.stack.pop()
            self.open(tag, attrs)
        elif tag in ("pre", "listing"):
            self.close_p()
            self.open(tag, attrs)
            self.drop_newline = True
        elif tag == "form":
            if self.form is None:
                self.close_p()
                self.form = self.open(tag, attrs)
        elif tag in ("li", "dd", "dt"):
            self.close_item(("li",) if tag == "li" else ("dd", "dt"))
            self.close_p()
            self.open(tag, attrs)
        elif tag == "plaintext":
            self.close_p()
            self.open(tag, attrs)
        elif tag == "button":
            if self.in_scope("button"):
                self.imply_ends()
                self.pop_to("button")
            self.reconstruct()
            self.open(tag, attrs)
        elif tag == "a":
            for n in reversed(self.active):
                if n is None:
                    break
                if n.tag == "a":
                    self.adopt("a")
                    if n in self.active:
                        self.active.remove(n)
                    if n in self.stack:
                        self.stack.remove(n)
                    break
            self.reconstruct()
            self.remember(self.open(tag, attrs))
        elif tag == "nobr":
            self.reconstruct()
            if self.in_scope("nobr"):
                self.adopt("nobr")
                self.reconstruct()
            self.remember(self.open(tag, attrs))
        elif tag in FORMATTING:
            self.reconstruct()
            self.remember(self.open(tag, attrs))
        elif tag in ("applet", "marquee", "object"):
            self.reconstruct()
            self.open(tag, attrs)
            self.active.append(None)
        elif tag == "table":
            self.close_p()
            self.open(tag, attrs)
            self.mode = "table"
        elif tag in VOID or tag == "image":
            if tag in ("hr",):
                self.close_p()
            elif tag not in ("param", "source", "track"):
                self.reconstruct()
            self.put(Node("img" if tag == "image" else tag, attrs))
        elif tag == "textarea":
            self.open(tag, attrs)
            self.drop_newline = True
        elif tag in RAW:
            if tag == "xmp":
                self.close_p()
                self.reconstruct()
            self.open(tag, attrs)
        elif tag == "select":
            self.reconstruct()
            self.open(tag, attrs)
            self.return_to, self.mode = self.mode, "select"
        elif tag in ("optgroup", "option"):
            if self.top.tag == "option":
                self.stack.pop()
            self.reconstruct()
            self.open(tag, attrs)
        elif tag in ("rb", "rtc", "rp", "rt"):
            if self.in_scope("ruby"):
                self.imply_ends("rtc" if tag in ("rp", "rt") else "")
            self.open(tag, attrs)
        elif tag in ("caption", "col", "colgroup", "frame", "frameset", "head", "tbody", "td", "tfoot", "th", "thead", "tr"):
            self.raw_ok = tag not in RAW
        else:
            self.reconstruct()
            self.open(tag, attrs)
            if closed and (tag in ("math", "svg") or any(n.tag in ("math", "svg") for n in self.stack[:-1])):
                self.stack.pop()

    def close_item(self, tags: tuple) -> None:
        for n in reversed(self.stack):
            if n.tag in tags:
                self.imply_ends(n.tag)
                self.pop_to(n.tag)
                return
            if n.tag in SPECIAL and n.tag not in ("address", "div", "p"):
                return

    def body_end(self, tag: str) -> None:
        if tag in ("body", "html"):
            if self.in_scope("body"):
                self.mode = "after_body"
        elif tag in CLOSES_P - {"p"} or tag in ("pre", "listing", "button"):
            if self.in_scope(tag):
                self.imply_ends()
                self.pop_to(tag)
        elif tag == "form":
            node, self.form = self.form, None
            if node is not None and self.in_scope_node(node):
                self.imply_ends()
                self.stack.remove(node)
        elif tag == "p":
            if not self.in_scope("p", frozenset(("button",))):
                self.open("p")
            self.close_p()
        elif tag == "li":
            if self.in_scope("li", frozenset(("ol", "ul"))):
                self.imply_ends("li")
                self.pop_to("li")
        elif tag in ("dd", "dt"):
            if self.in_scope(tag):
                self.imply_ends(tag)
                self.pop_to(tag)
        elif tag in HEADINGS:
            if self.in_scope(HEADINGS):
                self.imply_ends()
                self.pop_to(HEADINGS)
        elif tag in FORMATTING:
            self.adopt(tag)
        elif tag in ("applet", "marquee", "object"):
            if self.in_scope(tag):
                self.imply_ends()
                self.pop_to(tag)
                self.clear_to_marker()
        elif tag == "br":
            self.reconstruct()
            self.put(Node("br"))
        elif tag in RAW or tag in RCDATA or tag == "template":
            if self.top.tag == tag:
                self.stack.pop()
        else:
            self.any_end(tag)

    def in_after_body(self, t: tuple) -> None:
        if t[0] == "comment":
            (self.stack[0] if self.stack else self.doc).append(Node("#comment", data=t[1]))
        elif t[0] == "text" and not t[1].strip(SPACES):
            self.in_body(t)
        elif t[0] == "end" and t[1] in ("html", "body") or t[0] == "doctype":
            return
        else:
            self.mode = "body"
            self.in_body(t)

    # -- tables
    def in_table(self, t: tuple) -> None:
        kind, tag = t[0], t[1]
        if kind == "text" and self.top.tag in TABLE_PARTS:
            if t[1].strip(SPACES):
                self.foster = True
                self.in_body(t)
                self.foster = False
            else:
                self.put_text(t[1])
            return
        if kind == "comment":
            self.put(Node("#comment", data=t[1]))
        elif kind == "doctype":
            return
        elif kind == "start" and tag == "caption":
            self.pop_down_to(("table", "template", "html"))
            self.active.append(None)
            self.open(tag, t[2])
            self.mode = "caption"
        elif kind == "start" and tag in ("colgroup", "col"):
            self.pop_down_to(("table", "template", "html"))
            if tag == "col":
                self.open("colgroup")
                self.put(Node("col", t[2]))
            else:
                self.open("colgroup", t[2])
            self.mode = "colgroup"
        elif kind == "start" and tag in ("tbody", "tfoot", "thead"):
            self.pop_down_to(("table", "template", "html"))
            self.open(tag, t[2])
            self.mode = "table_body"
        elif kind == "start" and tag in ("td", "th", "tr"):
            self.pop_down_to(("table", "template", "html"))
            self.open("tbody")
            self.mode = "table_body"
            self.in_table_body(t)
        elif kind == "start" and tag == "table":
            if self.in_table_scope("table"):
                self.pop_to("table")
                self.reset()
                getattr(self, "in_" + self.mode)(t)
        elif kind == "end" and tag == "table":
            if self.in_table_scope("table"):
                self.pop_to("table")
                self.reset()
        elif kind == "end" and tag in ("body", "caption", "col", "colgroup", "html", "tbody", "td", "tfoot", "th", "thead", "tr"):
            return
        elif kind == "start" and tag in ("style", "script", "template"):
            self.head_element(t)
        elif kind == "end" and tag in ("style", "script", "template"):
            if self.top.tag == tag:
                self.stack.pop()
        elif kind == "start" and tag == "input" and t[2].get("type", "").lower() == "hidden":
            self.put(Node("input", t[2]))
        else:
            mode = self.mode
            self.foster = True
            self.in_body(t)
            self.foster = False
            if self.mode == "body":
                self.mode = mode

    def in_table_body(self, t: tuple) -> None:
        kind, tag = t[0], t[1]
        rows = ("tbody", "tfoot", "thead", "template", "html")
        if kind == "start" and tag == "tr":
            self.pop_down_to(rows)
            self.open("tr", t[2])
            self.mode = "row"
        elif kind == "start" and tag in ("th", "td"):
            self.pop_down_to(rows)
            self.open("tr")
            self.mode = "row"
            self.in_row(t)
        elif kind == "end" and tag in ("tbody", "tfoot", "thead"):
            if self.in_table_scope(tag):
                self.pop_down_to(rows)
                self.stack.pop()
                self.mode = "table"
        elif (kind == "start" and tag in ("caption", "col", "colgroup", "tbody", "tfoot", "thead")) or (kind == "end" and tag == "table"):
            if self.in_table_scope(("tbody", "thead", "tfoot")):
                self.pop_down_to(rows)
                self.stack.pop()
                self.mode = "table"
                self.in_table(t)
        elif kind == "end" and tag in ("body", "caption", "col", "colgroup", "html", "td", "th", "tr"):
            return
        else:
            self.in_table(t)

    def in_row(self, t: tuple) -> None:
        kind, tag = t[0], t[1]
        if kind == "start" and tag in ("th", "td"):
            self.pop_down_to(("tr", "template", "html"))
            self.open(tag, t[2])
            self.mode = "cell"
            self.active.append(None)
        elif kind == "end" and tag == "tr":
            self.end_row()
        elif (kind == "start" and tag in ("caption", "col", "colgroup", "tbody", "tfoot", "thead", "tr")) or (kind == "end" and tag == "table"):
            if self.end_row():
                self.in_table_body(t)
        elif kind == "end" and tag in ("tbody", "tfoot", "thead"):
            if self.in_table_scope(tag) and self.end_row():
                self.in_table_body(t)
        elif kind == "end" and tag in ("body", "caption", "col", "colgroup", "html", "td", "th"):
            return
        else:
            self.in_table(t)

    def end_row(self) -> bool:
        if not self.in_table_scope("tr"):
            return False
        self.pop_down_to(("tr", "template", "html"))
        self.stack.pop()
        self.mode = "table_body"
        return True

    def in_cell(self, t: tuple) -> None:
        kind, tag = t[0], t[1]
        if kind == "end" and tag in ("td", "th"):
            if self.in_table_scope(tag):
                self.imply_ends()
                self.pop_to(tag)
                self.clear_to_marker()
                self.mode = "row"
        elif kind == "start" and tag in ("caption", "col", "colgroup", "tbody", "td", "tfoot", "th", "thead", "tr"):
            if self.in_table_scope(("td", "th")):
                self.end_cell()
                self.in_row(t)
        elif kind == "end" and tag in ("table", "tbody", "tfoot", "thead", "tr"):
            if self.in_table_scope(tag):
                self.end_cell()
                self.in_row(t)
        elif kind == "end" and tag in ("body", "caption", "col", "colgroup", "html"):
            return
        else:
            self.in_body(t)

    def end_cell(self) -> None:
        self.imply_ends()
        self.pop_to(("td", "th"))
        self.clear_to_marker()
        self.mode = "row"

    def in_caption(self, t: tuple) -> None:
        kind, tag = t[0], t[1]
        done = kind == "end" and tag in ("caption", "table")
        done |= kind == "start" and tag in ("caption", "col", "colgroup", "tbody", "td", "tfoot", "th", "thead", "tr")
        if done:
            if self.in_table_scope("caption"):
                self.imply_ends()
                self.pop_to("caption")
                self.clear_to_marker()
                self.mode = "table"
                if (kind, tag) != ("end", "caption"):
                    self.in_table(t)
        else:
            self.in_body(t)

    def in_colgroup(self, t: tuple) -> None:
        if t[0] == "text" and not t[1].strip(SPACES):
            self.put_text(t[1])
        elif t[0] == "comment":
            self.put(Node("#comment", data=t[1]))
        elif t[0] == "start" and t[1] == "col":
            self.put(Node("col", t[2]))
        elif t[0] == "end" and t[1] == "col":
            return
        else:
            if self.top.tag == "colgroup":
                self.stack.pop()
            self.mode = "table"
            if (t[0], t[1]) != ("end", "colgroup"):
                self.in_table(t)

    def in_select(self, t: tuple) -> None:
        kind, tag = t[0], t[1]
        if kind == "text":
            self.put_text(t[1])
        elif kind == "comment":
            self.put(Node("#comment", data=t[1]))
        elif kind == "start" and tag in ("option", "optgroup", "hr"):
            if self.top.tag == "option":
                self.stack.pop()
            if tag != "option" and self.top.tag == "optgroup":
                self.stack.pop()
            if tag == "hr":
                self.put(Node("hr", t[2]))
            else:
                self.open(tag, t[2])
        elif kind == "end" and tag in ("option", "optgroup"):
            if tag == "optgroup" and self.top.tag == "option" and self.stack[-2].tag == "optgroup":
                self.stack.pop()
            if self.top.tag == tag:
                self.stack.pop()
        elif (kind == "end" and tag == "select") or (kind == "start" and tag in ("select", "input", "textarea")):
            self.end_select()
            if kind == "start" and tag != "select":
                getattr(self, "in_" + self.mode)(t)
        elif tag in ("caption", "table", "tbody", "tfoot", "thead", "tr", "td", "th") and kind in ("start", "end") and self.return_to != "body":
            self.end_select()
            getattr(self, "in_" + self.mode)(t)
        elif kind == "start" and tag == "script":
            self.head_element(t)
        elif kind == "end" and tag == "script":
            if self.top.tag == tag:
                self.stack.pop()
        elif kind == "start":
            self.raw_ok = False

    return_to = "body"

    def end_select(self) -> None:
        self.pop_to("select")
        self.reset()

    def reset(self) -> None:
        for n in reversed(self.stack):
            mode = {"td": "cell", "th": "cell", "tr": "row", "tbody": "table_body", "thead": "table_body", "tfoot": "table_body", "caption": "caption", "colgroup": "colgroup", "table": "table", "body": "body", "select": "select"}.get(n.tag)
            if mode:
                self.mode = mode
                return
        self.mode = "body"


def parse(src: str) -> Node:
    """The document of ``src``; it always has html, head and body."""
    return Builder().feed(src)


def parse_fragment(src: str) -> list[Node]:
    """The nodes of ``src`` as content of a body."""
    body = parse("<body>" + src).first("body")
    nodes = body.children
    for n in nodes:
        n.parent = None
    return nodes


def _escape(s: str) -> str:
    return s.replace("&", "&amp;").replace("'", "&#39;").replace("<", "&lt;").replace(">", "&gt;").replace('"', "&#34;")


def inner_html(node: Node) -> str:
    """The HTML of a node's children."""
    out: list[str] = []
    todo: list = list(reversed(node.children))
    while todo:
        n = todo.pop()
        if isinstance(n, str):
            out.append(n)
        elif n.tag == "#text":
            out.append(n.data if n.parent is not None and n.parent.tag in RAW else _escape(n.data))
        elif n.tag == "#comment":
            out.append(f"<!--{n.data}-->")
        elif n.tag == "#doctype":
            out.append(f"<!DOCTYPE {n.data}>")
        else:
            attrs = "".join(f' {k}="{_escape(v)}"' for k, v in n.attrs.items())
            if n.tag in VOID:
                out.append(f"<{n.tag}{attrs}/>")
                continue
            out.append(f"<{n.tag}{attrs}>")
            if n.tag in ("pre", "listing", "textarea") and n.children and n.children[0].data.startswith("\n"):
                out.append("\n")
            todo.append(f"</{n.tag}>")
            todo.extend(reversed(n.children))
    return "".join(out)
