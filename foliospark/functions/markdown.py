"""CommonMark with tables, task items and strikethrough: blocks, inlines, HTML; and a table function over texts."""

from __future__ import annotations

import html as _html
import html.entities
import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass, field
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame


@dataclass
class Node:
    kind: str
    children: list[Node] = field(default_factory=list)
    text: str = ""
    level: int = 0
    info: str = ""
    title: str = ""
    tight: bool = True
    align: list[str] = field(default_factory=list)
    open: bool = True
    # of lists and items
    marker: str = ""
    start: int = 1
    offset: int = 0
    checked: bool | None = None
    # the lines it stands on
    first: int = 0
    last: int = 0
    # of code and HTML
    fence: str = ""
    indent: int = 0
    html_kind: int = 0


CONTAINERS = frozenset(("document", "quote", "list", "item"))
_ENTITY = r"&(?:#[xX][0-9a-fA-F]{1,6}|#[0-9]{1,7}|[A-Za-z][A-Za-z0-9]{1,31});"
_PUNCT = r"!\"#$%&'()*+,\-./:;<=>?@\[\\\]^_`{|}~"
_ESCAPED = re.compile(rf"\\([{_PUNCT}])|({_ENTITY})")
_RULE = re.compile(r"^(?:\*[ \t]*){3,}$|^(?:_[ \t]*){3,}$|^(?:-[ \t]*){3,}$")
_ATX = re.compile(r"^(#{1,6})(?:[ \t]+|$)")
_FENCE = re.compile(r"^(`{3,})([^`]*)$|^(~{3,})(.*)$")
_SETEXT = re.compile(r"^(=+|-+)[ \t]*$")
_BULLET = re.compile(r"^[*+-]")
_ORDERED = re.compile(r"^(\d{1,9})([.)])")
_ATTR = r"\s+[A-Za-z_:][\w:.-]*(?:\s*=\s*(?:[^\s\"'=<>`]+|'[^']*'|\"[^\"]*\"))?"
_OPEN_TAG = rf"<[A-Za-z][A-Za-z0-9-]*(?:{_ATTR})*\s*/?>"
_CLOSE_TAG = r"</[A-Za-z][A-Za-z0-9-]*\s*>"
_HTML_TAG = re.compile(rf"{_OPEN_TAG}|{_CLOSE_TAG}|<!-->|<!--->|<!--[\s\S]*?-->|<\?[\s\S]*?\?>|<![A-Za-z][^>]*>|<!\[CDATA\[[\s\S]*?\]\]>")
#: Block-level names that begin an HTML block of the sixth kind. Fixed values.
_HTML_NAMES = "address|article|aside|base|basefont|blockquote|body|caption|center|col|colgroup|dd|details|dialog|dir|div|dl|dt|fieldset|figcaption|figure|footer|form|frame|frameset|h[123456]|head|header|hr|html|iframe|legend|li|link|main|menu|menuitem|nav|noframes|ol|optgroup|option|p|param|search|section|summary|table|tbody|td|tfoot|th|thead|title|tr|track|ul"
_HTML_OPEN = [re.compile(p, re.I) for p in (r"^<(?:script|pre|textarea|style)(?:\s|>|$)", r"^<!--", r"^<\?", r"^<![A-Za-z]", r"^<!\[CDATA\[", rf"^</?(?:{_HTML_NAMES})(?:\s|/?>|$)", rf"^(?:{_OPEN_TAG}|{_CLOSE_TAG})\s*$")]
_HTML_CLOSE = [re.compile(p, re.I) for p in (r"</(?:script|pre|textarea|style)>", r"-->", r"\?>", r">", r"\]\]>")]
_DELIMITER_CELL = re.compile(r"^:?-+:?$")


def entity(text: str) -> str:
    if text.startswith("&#"):
        code = int(text[3:-1], 16) if text[2] in "xX" else int(text[2:-1])
        return "\ufffd" if code == 0 or code > 0x10FFFF or 0xD800 <= code < 0xE000 else chr(code)
    return html.entities.html5.get(text[1:], text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(lambda m: m[1] or entity(m[2]), text)


def label_key(label: str) -> str:
    return re.sub(r"\s+", " ", label.strip()).casefold()


def split_row(line: str) -> list[str]:
    """Cells between pipes that aren't escaped; outer pipes are optional."""
    line = line.strip()
    line = line[1:] if line.startswith("|") else line
    cells, now, k = [], [], 0
    while k < len(line):
        if line[k] == "\\" and line[k + 1 : k + 2] == "|":
            now.append("|")
            k += 2
            continue
        if line[k] == "|":
            cells.append("".join(now).strip())
            now = []
        else:
            now.append(line[k])
            k += 1
            continue
        k += 1
    return cells + ["".join(now).strip()] if "".join(now).strip() or not cells else cells


class Blocks:
    """Reads lines into a tree of blocks."""

    def __init__(self):
        self.document = Node("document")
        self.refs: dict[str, tuple[str, str]] = {}
        self.number = 0

    # the line under way: text, position, column, and how much of a tab is left

    def _set(self, line: str) -> None:
        self.line, self.at, self.column, self.tab = line, 0, 0, 0
        self._look()

    def _look(self) -> None:
        k, column = self.at, self.column
        while k < len(self.line) and self.line[k] in " \t":
            column += 1 if self.line[k] == " " else 4 - column % 4
            k += 1
        self.start, self.start_column = k, column
        self.blank = k >= len(self.line)
        self.indent = column - self.column

    def _advance(self, columns: int) -> None:
        while columns and self.at < len(self.line):
            if self.line[self.at] == "\t":
                wide = 4 - self.column % 4
                step = min(columns, wide)
                self.column += step
                columns -= step
                self.tab = wide - step
                if not self.tab:
                    self.at += 1
            else:
                self.at, self.column, self.tab = self.at + 1, self.column + 1, 0
                columns -= 1
        self._look()

    def _to_start(self) -> None:
        self.at, self.column, self.tab = self.start, self.start_column, 0
        self._look()

    def _rest(self) -> str:
        return " " * self.tab + self.line[self.at + 1 :] if self.tab else self.line[self.at :]

    # blocks

    def parse(self, text: str) -> Node:
        text = text.replace("\r\n", "\n").replace("\r", "\n").replace("\0", "\ufffd")
        lines = text.split("\n")
        if lines[-1] == "":
            lines.pop()
        for line in lines:
            self._line(line)
        for block in reversed(self._open_blocks()):
            self._close(block)
        return self.document

    def _open_blocks(self) -> list[Node]:
        out = [self.document]
        while out[-1].children and out[-1].children[-1].open:
            out.append(out[-1].children[-1])
        return out

    def _continues(self, b: Node) -> str:
        """yes, no, or done (the line is used up)."""
        if b.kind == "quote":
            if self.indent <= 3 and self.line[self.start : self.start + 1] == ">":
                self._to_start()
                self._advance(1)
                if self.line[self.at : self.at + 1] in (" ", "\t") and self.at < len(self.line):
                    self._advance(1)
                return "yes"
            return "no"
        if b.kind == "item":
            if self.blank:
                if not b.children:
                    return "no"
                self._to_start()
                return "yes"
            if self.indent >= b.offset:
                self._advance(b.offset)
                return "yes"
            return "no"
        if b.kind == "code":
            if b.fence:
                if self.indent <= 3 and re.match(rf"^{re.escape(b.fence[0])}{{{len(b.fence)},}}[ \t]*$", self.line[self.start :]):
                    b.open = False
                    return "done"
                skip = min(b.indent, self.indent)
                self._advance(skip)
                return "yes"
            if self.indent >= 4:
                self._advance(4)
                return "yes"
            if self.blank:
                self._to_start()
                return "yes"
            return "no"
        if b.kind == "html":
            return "no" if self.blank and b.html_kind >= 6 else "yes"
        if b.kind == "table":
            return "no" if self.blank else "yes"
        if b.kind == "paragraph":
            return "no" if self.blank else "yes"
        return "no" if b.kind in ("heading", "rule") else "yes"

    def _line(self, line: str) -> None:
        self.number += 1
        self._set(line)
        stack = self._open_blocks()
        depth = 1
        while depth < len(stack):
            how = self._continues(stack[depth])
            if how == "done":
                self._stand(stack[: depth + 1])
                self._close(stack[depth])
                return
            if how == "no":
                break
            if stack[depth].kind == "quote":
                self._stand(stack[: depth + 1])  # its mark makes the line no blank one
            depth += 1
        matched, unmatched = stack[:depth], stack[depth:]
        tip = matched[-1]
        lazy = bool(unmatched) and unmatched[-1].kind == "paragraph"
        para = tip if tip.kind == "paragraph" else None
        if tip.kind in ("paragraph", "table"):
            tip = matched[-2]
        leaf = matched[-1] if matched[-1].kind in ("code", "html") else None
        opened = False
        while not leaf:
            new = self._start(tip, para if not opened else None, lazy and not opened)
            if new is None:
                break
            if not opened:
                for b in reversed(unmatched):
                    self._close(b)
                if matched[-1] is not tip and matched[-1].open and matched[-1] is not new and new not in matched:
                    self._close(matched[-1])
                unmatched, opened = [], True
            if new.kind in CONTAINERS:
                tip = new
                continue
            leaf = new
        if leaf and leaf.kind in ("heading", "rule", "setext"):
            return
        text = self._rest()
        if leaf:
            if leaf.kind == "code" and leaf.fence and leaf.text is None:
                leaf.text = ""
                return
            if leaf.kind == "table":
                return
            leaf.text += text + "\n"
            if not self.blank or leaf.fence or leaf.html_kind:
                self._stand(self._open_blocks())
            if leaf.kind == "html" and leaf.html_kind <= 5 and _HTML_CLOSE[leaf.html_kind - 1].search(text):
                self._close(leaf)
            return
        if not opened and lazy and not self.blank:
            unmatched[-1].text += text.lstrip(" \t") + "\n"
            self._stand(stack)
            return
        if not opened:
            for b in reversed(unmatched):
                self._close(b)
        last = matched[-1] if not opened else None
        if self.blank:
            return
        if last is not None and last.kind == "table" and last.open:
            last.children.append(Node("row", text=self.line[self.start :], open=False))
            self._stand(matched)
            return
        if last is not None and last.kind == "paragraph" and last.open:
            last.text += text.lstrip(" \t") + "\n"
            self._stand(matched)
            return
        self._add(self._out(tip), Node("paragraph", text=text.lstrip(" \t") + "\n"))

    def _stand(self, blocks: list[Node]) -> None:
        for b in blocks:
            b.last = self.number

    def _add(self, parent: Node, node: Node) -> Node:
        if parent.children and parent.children[-1].open and parent.children[-1] is not node:
            self._close_deep(parent.children[-1])
        parent.children.append(node)
        node.first = self.number
        self._stand([*self._open_blocks(), node])
        return node

    def _close_deep(self, b: Node) -> None:
        if b.children and b.children[-1].open:
            self._close_deep(b.children[-1])
        self._close(b)

    def _start(self, tip: Node, para: Node | None, lazy: bool) -> Node | None:
        """Opens the block that begins here inside ``tip``, which isn't a leaf."""
        if self.blank:
            return None
        rest = self.line[self.start :]
        if self.indent >= 4:
            if para is None and not lazy:
                self._advance(4)
                return self._add(self._out(tip), Node("code"))
            return None
        parent = tip
        if rest[0] == ">":
            self._to_start()
            self._advance(1)
            if self.at < len(self.line) and self.line[self.at] in " \t":
                self._advance(1)
            return self._add(self._out(parent), Node("quote"))
        m = _ATX.match(rest)
        if m:
            body = re.sub(r"^#+[ \t]*$|[ \t]+#+[ \t]*$", "", rest[m.end() :].rstrip(" \t"))
            node = self._add(self._out(parent), Node("heading", text=body.strip(" \t"), level=len(m[1]), open=False))
            return node
        m = _FENCE.match(rest)
        if m:
            node = Node("code", text=None, fence=m[1] or m[3], indent=self.indent, info=unescape((m[2] or m[4] or "").strip()))
            return self._add(self._out(parent), node)
        if rest[0] == "<":
            for kind, p in enumerate(_HTML_OPEN, 1):
                if p.match(rest) and (kind < 7 or (para is None and not lazy)):
                    return self._add(self._out(parent), Node("html", html_kind=kind))
        if para is not None and _SETEXT.match(rest):
            body = self._definitions(para)
            if body.strip():
                para.kind, para.level, para.text, para.open = "heading", 1 if rest[0] == "=" else 2, body.strip(), False
                self._stand([*self._open_blocks(), para])
                return Node("setext")
            para.text = body
        if para is not None and "\n" == para.text[-1:] and para.text.count("\n") >= 1:
            table = self._table(para, rest)
            if table:
                return table
        if _RULE.match(rest):
            return self._add(self._out(parent), Node("rule", open=False))
        item = self._item(rest, para is not None)
        if item:
            outer = parent if parent.kind == "list" else None
            if outer is None and parent.children and parent.children[-1].kind == "list" and parent.children[-1].open:
                outer = parent.children[-1]
            if outer is None or outer.marker != item.marker:
                holder = self._out(parent)
                outer = self._add(holder, Node("list", marker=item.marker, start=item.start))
            return self._add(outer, item)
        return None

    def _out(self, parent: Node) -> Node:
        """The parent for a block that is no item: a list's own parent."""
        if parent.kind != "list":
            return parent
        path = self._open_blocks()
        where = next(k for k, b in enumerate(path) if b is parent)
        self._close_deep(parent)
        return path[where - 1]

    def _item(self, rest: str, in_paragraph: bool) -> Node | None:
        m = _BULLET.match(rest) or _ORDERED.match(rest)
        if not m:
            return None
        after = rest[m.end() :]
        if after and after[0] not in " \t":
            return None
        if in_paragraph and (not after.strip() or (m.re is _ORDERED and m[1] != "1")):
            return None
        outer = self.indent
        self._to_start()
        self._advance(m.end())
        wide = self.indent
        if self.blank or wide >= 5:
            offset = outer + m.end() + 1
            if not self.blank:
                self._advance(1)
        else:
            self._advance(wide)
            offset = outer + m.end() + wide
        ordered = m.re is _ORDERED
        return Node("item", marker=m[2] if ordered else m[0], start=int(m[1]) if ordered else 1, offset=offset, level=int(ordered))

    def _table(self, para: Node, rest: str) -> Node | None:
        """Turns a paragraph's last line into the head of a table, if this line is its rule."""
        if "|" not in rest and ":" not in rest and not re.match(r"^-+$", rest.strip()):
            return None
        rule = split_row(rest)
        if not all(_DELIMITER_CELL.match(c) for c in rule) or ("|" not in rest and "|" not in para.text.rstrip("\n").rpartition("\n")[2]):
            return None
        before, _, head = para.text.rstrip("\n").rpartition("\n")
        if len(split_row(head)) != len(rule):
            return None
        para.text = before + "\n" if before else ""
        parent = self._open_blocks()
        holder = parent[next(k for k, b in enumerate(parent) if b is para) - 1]
        align = ["center" if c[0] == c[-1] == ":" else "left" if c[0] == ":" else "right" if c[-1] == ":" else "" for c in rule]
        table = Node("table", align=align, first=para.first, last=self.number)
        table.children.append(Node("row", text=head, level=1, open=False))
        self._close(para)
        if not para.text.strip():
            holder.children.remove(para)
        holder.children.append(table)
        return table

    def _definitions(self, para: Node) -> str:
        """Takes link definitions off the start of a paragraph and returns what is left."""
        text = para.text
        while text.startswith("["):
            m = re.match(r"\[((?:[^\[\]\\]|\\.){1,999})\]:", text, re.S)
            if not m or not m[1].strip():
                break
            k = re.compile(r"[ \t]*\n?[ \t]*").match(text, m.end()).end()
            found = destination(text, k)
            if not found:
                break
            url, k = found
            end = re.compile(r"[ \t]*(?:\n|$)").match(text, k)
            gap = re.compile(r"[ \t]*\n?[ \t]*").match(text, k).end()
            titled = link_title(text, gap) if gap > k else None
            title = ""
            if titled and (after := re.compile(r"[ \t]*(?:\n|$)").match(text, titled[1])):
                title, end = titled[0], after
            if not end:
                break
            self.refs.setdefault(label_key(m[1]), (url, title))
            text = text[end.end() :]
        return text

    def _close(self, b: Node) -> None:
        if not b.open and b.kind not in ("code",):
            return
        b.open = False
        if b.kind == "paragraph":
            b.text = self._definitions(b)
            if not b.text.strip():
                b.text = ""
        elif b.kind == "code":
            if b.text is None:
                b.text = ""
            if not b.fence:
                b.text = re.sub(r"(?:[ \t]*\n)+\Z", "\n", b.text)
        elif b.kind == "html":
            b.text = re.sub(r"(?:[ \t]*\n)+\Z", "\n", b.text) if b.html_kind >= 6 else b.text
        elif b.kind == "list":
            apart = lambda nodes: any(x.last + 1 < y.first for x, y in zip(nodes, nodes[1:]))
            b.tight = not apart(b.children) and not any(apart(i.children) for i in b.children)


def destination(text: str, k: int) -> tuple[str, int] | None:
    """A link's destination at ``k``, and where it ends."""
    m = re.compile(r"<((?:[^<>\n\\]|\\.)*)>").match(text, k)
    if m:
        return unescape(m[1]), m.end()
    if text[k : k + 1] in ("<", ""):
        return None
    depth, start = 0, k
    while k < len(text):
        c = text[k]
        if c == "\\" and re.match(rf"[{_PUNCT}]", text[k + 1 : k + 2]):
            k += 2
            continue
        if c == "(":
            depth += 1
        elif c == ")":
            if not depth:
                break
            depth -= 1
        elif c <= " " or c == "\x7f":
            break
        k += 1
    return (unescape(text[start:k]), k) if not depth and k > start else None


def link_title(text: str, k: int) -> tuple[str, int] | None:
    m = re.compile(r'"((?:[^"\\]|\\.)*)"|\'((?:[^\'\\]|\\.)*)\'|\(((?:[^()\\]|\\.)*)\)', re.S).match(text, k)
    return (unescape(next(g for g in m.groups() if g is not None)), m.end()) if m else None


# --- inlines


@dataclass
class _Run:
    node: Node
    char: str
    count: int
    first: int
    opens: bool
    closes: bool


class Inlines:
    """Reads a block's text into inline nodes: text, code, emphasis, strong, strike, link, image, html, break, softbreak."""

    def __init__(self, refs: dict[str, tuple[str, str]]):
        self.refs = refs

    def parse(self, text: str) -> list[Node]:
        self.text, self.at = text, 0
        self.out: list[Node] = []
        self.runs: list[_Run] = []
        self.brackets: list[tuple[int, int, int, bool, bool]] = []  # place in out, in runs, in text; image; active
        self.dead: set[int] = set()
        plain = re.compile(r"[^\n`\[\]\\!<&*_~]+")
        while self.at < len(text):
            c = text[self.at]
            m = plain.match(text, self.at)
            if m:
                self._text(m[0])
                self.at = m.end()
            elif c == "\n":
                self._newline()
            elif c == "\\":
                self._escape()
            elif c == "`":
                self._code()
            elif c in "*_~":
                self._delimiters(c)
            elif c == "[" or (c == "!" and text[self.at + 1 : self.at + 2] == "["):
                image = c == "!"
                self.out.append(Node("text", text="![" if image else "["))
                self.at += 1 + image
                self.brackets.append((len(self.out) - 1, len(self.runs), self.at, image, True))
            elif c == "]":
                self._bracket()
            elif c == "<":
                self._angle()
            elif c == "&" and (m := re.compile(_ENTITY).match(text, self.at)):
                self._text(entity(m[0]))
                self.at = m.end()
            else:
                self._text(c)
                self.at += 1
        self._emphasis(0)
        return self._joined(self.out)

    def _text(self, s: str) -> None:
        self.out.append(Node("text", text=s))

    @staticmethod
    def _joined(nodes: list[Node]) -> list[Node]:
        out: list[Node] = []
        for n in nodes:
            if n.kind == "text" and not n.text:
                continue
            if n.kind == "text" and out and out[-1].kind == "text":
                out[-1] = Node("text", text=out[-1].text + n.text)
            else:
                out.append(n)
        return out

    def _newline(self) -> None:
        hard = False
        if self.out and self.out[-1].kind == "text":
            t = self.out[-1].text
            hard = t.endswith("  ")
            self.out[-1].text = t.rstrip(" ")
        self.out.append(Node("break" if hard else "softbreak"))
        self.at = re.compile(r"\n[ \t]*").match(self.text, self.at).end()

    def _escape(self) -> None:
        nxt = self.text[self.at + 1 : self.at + 2]
        if nxt == "\n":
            self.out.append(Node("break"))
            self.at = re.compile(r"\\\n[ \t]*").match(self.text, self.at).end()
        elif nxt and re.match(rf"[{_PUNCT}]", nxt):
            self._text(nxt)
            self.at += 2
        else:
            self._text("\\")
            self.at += 1

    def _code(self) -> None:
        ticks = re.compile(r"`+").match(self.text, self.at)[0]
        end = re.compile(rf"(?<!`){ticks}(?!`)").search(self.text, self.at + len(ticks))
        if not end:
            self._text(ticks)
            self.at += len(ticks)
            return
        body = self.text[self.at + len(ticks) : end.start()].replace("\n", " ")
        if body.strip(" ") and body[0] == body[-1] == " ":
            body = body[1:-1]
        self.out.append(Node("code", text=body))
        self.at = end.end()

    def _angle(self) -> None:
        m = re.compile(r"<([A-Za-z][A-Za-z0-9+.-]{1,31}:[^\s<>\x00-\x1f]*)>").match(self.text, self.at)
        mail = None if m else re.compile(r"<([A-Za-z0-9.!#$%&'*+/=?^_`{|}~-]+@[A-Za-z0-9](?:[A-Za-z0-9-]{0,61}[A-Za-z0-9])?(?:\.[A-Za-z0-9](?:[A-Za-z0-9-]{0,61}[A-Za-z0-9])?)*)>").match(self.text, self.at)
        if m or mail:
            found = m or mail
            self.out.append(Node("link", [Node("text", text=found[1])], info=("" if m else "mailto:") + found[1]))
            self.at = found.end()
            return
        m = _HTML_TAG.match(self.text, self.at)
        if m:
            self.out.append(Node("html", text=m[0]))
            self.at = m.end()
        else:
            self._text("<")
            self.at += 1

    def _delimiters(self, c: str) -> None:
        m = re.compile(re.escape(c) + "+").match(self.text, self.at)
        before, after = self.text[self.at - 1 : self.at] or "\n", self.text[m.end() : m.end() + 1] or "\n"
        blank = lambda x: x.isspace()
        mark = lambda x: unicodedata.category(x)[0] in "PS"
        left = not blank(after) and (not mark(after) or blank(before) or mark(before))
        right = not blank(before) and (not mark(before) or blank(after) or mark(after))
        opens = left and (c != "_" or not right or mark(before))
        closes = right and (c != "_" or not left or mark(after))
        node = Node("text", text=m[0])
        self.out.append(node)
        self.at = m.end()
        if c != "~" or len(m[0]) <= 2:
            self.runs.append(_Run(node, c, len(m[0]), len(m[0]), opens, closes))

    def _bracket(self) -> None:
        self.at += 1
        if not self.brackets:
            self._text("]")
            return
        place, run, start, image, active = self.brackets.pop()
        if not active:
            self._text("]")
            return
        found = self._inline_link() or self._reference(start)
        if not found:
            self._text("]")
            return
        url, title, self.at = found
        self._emphasis(run)
        inner = self._joined(self.out[place + 1 :])
        del self.out[place:]
        self.out.append(Node("image" if image else "link", inner, info=url, title=title))
        if not image:  # links hold no links
            self.brackets = [(*b[:4], b[4] and b[3]) for b in self.brackets]

    def _inline_link(self) -> tuple[str, str, int] | None:
        if self.text[self.at : self.at + 1] != "(":
            return None
        blank = re.compile(r"[ \t]*\n?[ \t]*")
        k = blank.match(self.text, self.at + 1).end()
        url, title = "", ""
        found = destination(self.text, k)
        if found:
            url, k = found
            gap = blank.match(self.text, k).end()
            titled = link_title(self.text, gap) if gap > k else None
            title, k = titled or ("", k)
        k = blank.match(self.text, k).end()
        return (url, title, k + 1) if self.text[k : k + 1] == ")" else None

    def _reference(self, start: int) -> tuple[str, str, int] | None:
        m = re.compile(r"\[((?:[^\[\]\\]|\\.){0,999})\]", re.S).match(self.text, self.at)
        own = self.text[start : self.at - 1]
        if m and m[1].strip():
            found = self.refs.get(label_key(m[1]))
            return (*found, m.end()) if found else None
        if re.search(r"(?<!\\)(?:\\\\)*\[", own):
            return None
        found = self.refs.get(label_key(own)) if own.strip() else None
        return (*found, m.end() if m else self.at) if found else None

    def _emphasis(self, bottom: int) -> None:
        """Pairs the delimiter runs above ``bottom``, and takes them away."""
        k = bottom
        while k < len(self.runs):
            closer = self.runs[k]
            if not closer.closes or not closer.count:
                k += 1
                continue
            j = k - 1
            while j >= bottom:
                opener = self.runs[j]
                odd = (opener.closes or closer.opens) and (opener.first + closer.first) % 3 == 0 and not (opener.first % 3 == 0 and closer.first % 3 == 0)
                if opener.opens and opener.char == closer.char and opener.count and (closer.char == "~" and opener.count == closer.count or closer.char != "~" and not odd):
                    break
                j -= 1
            if j < bottom:
                k += 1
                continue
            used = closer.count if closer.char == "~" else 2 if opener.count >= 2 and closer.count >= 2 else 1
            a, b = (next(i for i, n in enumerate(self.out) if n is r.node) for r in (opener, closer))
            kind = "strike" if closer.char == "~" else "strong" if used == 2 else "emphasis"
            made = Node(kind, self._joined(self.out[a + 1 : b]))
            self.out[a + 1 : b] = [made]
            for r in (opener, closer):
                r.count -= used
                r.node.text = r.char * r.count
            del self.runs[j + 1 : k]
            k = j + 1
            if not opener.count:
                del self.runs[j]
                k -= 1
        del self.runs[bottom:]


def parse(text: str) -> Node:
    """The tree of a text, with inlines in headings, paragraphs and cells."""
    blocks = Blocks()
    root = blocks.parse(text)
    inlines = Inlines(blocks.refs)

    def walk(b: Node) -> None:
        b.children = [c for c in b.children if not (c.kind == "paragraph" and not c.text.strip())]
        if b.kind in ("paragraph", "heading"):
            body = b.text.strip(" \t\n") if b.kind == "paragraph" else b.text
            b.children = inlines.parse(re.sub(r"[ \t]+\Z", "", body))
            return
        if b.kind == "table":
            width = len(b.align)
            for r in b.children:
                cells = (split_row(r.text) + [""] * width)[:width]
                r.children = [Node("cell", inlines.parse(c), text=c, info=b.align[k]) for k, c in enumerate(cells)]
            return
        for c in b.children:
            walk(c)
        if b.kind == "item" and b.children and b.children[0].kind == "paragraph":
            first = b.children[0].children
            if first and first[0].kind == "text" and (m := re.match(r"\[([ xX])\][ \t]+(?=\S)", first[0].text)):
                b.checked, first[0].text = m[1] != " ", first[0].text[m.end() :]

    walk(root)
    return root


def plain(nodes: list[Node]) -> str:
    """The text of inline nodes."""
    return "".join("\n" if n.kind in ("break", "softbreak") else n.text if n.kind in ("text", "code") else "" if n.kind == "html" else plain(n.children) for n in nodes)


def _url(u: str) -> str:
    return _html.escape(quote(u, safe="!#$%&'()*+,-./:;=?@_~[]"), True).replace("&#x27;", "'").replace("[", "%5B").replace("]", "%5D")


def _esc(t: str) -> str:
    return t.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;").replace('"', "&quot;")


def inline_html(nodes: list[Node]) -> str:
    out = []
    for n in nodes:
        inner = inline_html(n.children)
        title = f' title="{_esc(n.title)}"' if n.title else ""
        out.append(
            {
                "text": lambda: _esc(n.text), "code": lambda: f"<code>{_esc(n.text)}</code>", "html": lambda: n.text, "break": lambda: "<br />\n", "softbreak": lambda: "\n", "emphasis": lambda: f"<em>{inner}</em>", "strong": lambda: f"<strong>{inner}</strong>",
                "strike": lambda: f"<del>{inner}</del>", "link": lambda: f'<a href="{_url(n.info)}"{title}>{inner}</a>', "image": lambda: f'<img src="{_url(n.info)}" alt="{_esc(plain(n.children))}"{title} />',
            }[n.kind]()
        )
    return "".join(out)


def to_html(node: Node, tight: bool = False) -> str:
    """HTML in the form of the specification's examples."""
    inside = lambda: "".join(to_html(c) for c in node.children)
    if node.kind == "document":
        return inside()
    if node.kind == "paragraph":
        return inline_html(node.children) if tight else f"<p>{inline_html(node.children)}</p>\n"
    if node.kind == "heading":
        return f"<h{node.level}>{inline_html(node.children)}</h{node.level}>\n"
    if node.kind == "rule":
        return "<hr />\n"
    if node.kind == "code":
        name = node.info.split()[0] if node.info.split() else ""
        return f"<pre><code{f' class={chr(34)}language-{_esc(name)}{chr(34)}' if name else ''}>{_esc(node.text)}</code></pre>\n"
    if node.kind == "html":
        return node.text
    if node.kind == "quote":
        return f"<blockquote>\n{inside()}</blockquote>\n"
    if node.kind == "list":
        ordered = node.marker in ".)"
        start = f' start="{node.start}"' if ordered and node.start != 1 else ""
        items = []
        for i in node.children:
            box = "" if i.checked is None else f'<input type="checkbox" disabled=""{" checked=" + chr(34) * 2 if i.checked else ""} /> '
            body = ""
            for c in i.children:
                part = to_html(c, node.tight)
                body += ("\n" if body and not body.endswith("\n") else "\n" if not body and not (node.tight and c.kind == "paragraph") else "") + part
            items.append(f"<li>{box}{body}</li>\n")
        tag = "ol" if ordered else "ul"
        return f"<{tag}{start}>\n{''.join(items)}</{tag}>\n"
    if node.kind == "table":
        def row(r: Node, tag: str) -> str:
            return "<tr>\n" + "".join(f"<{tag}{f' align={chr(34)}{c.info}{chr(34)}' if c.info else ''}>{inline_html(c.children)}</{tag}>\n" for c in r.children) + "</tr>\n"

        body = "".join(row(r, "td") for r in node.children[1:])
        return f"<table>\n<thead>\n{row(node.children[0], 'th')}</thead>\n" + (f"<tbody>\n{body}</tbody>\n" if body else "") + "</table>\n"
    raise ValueError(node.kind)


def block_rows(text: str | None) -> list[tuple[int, int, str, int, str, str]]:
    """(seq, depth, kind, level, info, text) of each block in order. ``level`` is a heading's, or a list's first number."""
    out: list[tuple[int, int, str, int, str, str]] = []

    def walk(b: Node, depth: int) -> None:
        level = b.level if b.kind == "heading" else b.start if b.kind == "list" and b.marker in ".)" else 0
        info = b.info or ({True: "done", False: "open"}.get(b.checked, "") if b.kind == "item" else ",".join(b.align) if b.kind == "table" else "")
        body = plain(b.children) if b.kind in ("paragraph", "heading") else " | ".join(plain(c.children) for c in b.children) if b.kind == "row" else b.text if b.kind in ("code", "html") else ""
        out.append((len(out), depth, b.kind, level, info, body))
        if b.kind not in ("paragraph", "heading", "row"):
            for c in b.children:
                walk(c, depth + 1)

    for c in parse(text or "").children:
        walk(c, 0)
    return out


BLOCKS = "seq int, depth int, kind string, level int, info string, text string"


def blocks(df: DataFrame, by: list[str], text_col: str) -> DataFrame:
    """A row for each block of each text. A null has none."""
    rows = df.select(*by, text_col)
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[: len(by)]), BLOCKS.replace("text string", "`block_text` string")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int32(), pa.int32(), pa.string(), pa.int32(), pa.string(), pa.string()]
        for b in batches:
            at, found = [], []
            for k, text in enumerate(b.column(len(by)).to_pylist()):
                made = block_rows(text) if text else []
                at += [k] * len(made)
                found += made
            if found:
                keys = b.take(pa.array(at, pa.int64()))
                yield pa.RecordBatch.from_arrays([*keys.columns[: len(by)], *(pa.array(c, t) for c, t in zip(zip(*found), kinds))], names=[*by, "seq", "depth", "kind", "level", "info", "block_text"])

    return rows.mapInArrow(run, schema)


def escape(text: str) -> str:
    """Plain text as Markdown."""
    return re.sub(r"([\\`*_\[\]<>|#])", r"\\\1", text)


def register(spark) -> None:
    """Makes ``md_blocks(text)`` a table function of the session's SQL."""
    from pyspark.sql.functions import udtf

    class MdBlocks:
        def eval(self, text: str):
            yield from block_rows(text)

    spark.udtf.register("md_blocks", udtf(MdBlocks, returnType=BLOCKS))
