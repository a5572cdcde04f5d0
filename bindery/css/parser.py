"""An error-tolerant CSS reader: a tree of rules, selectors, properties and values, with search, edits and rendering.

Nothing is fatal: what can't be read becomes a broken node with an error, and reading goes on after it.
Offsets are places in the given text; comments count as white space.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

#: Rendering modes: what was understood; without nodes with errors; without invalid nodes too; the source text for both.
UNDERSTOOD, REMOVE_ERRORS, REMOVE_INVALID, ORIGINAL = "understood", "remove_errors", "remove_invalid", "original"

#: Directives whose body holds rules, or properties; all others have none.
RULE_DIRECTIVES = ["media", "supports", "document", "-moz-document", "host", "keyframes", "-webkit-keyframes", "-moz-keyframes", "-o-keyframes", "-ms-keyframes"]
PROPERTY_DIRECTIVES = [
    "font-face", "page", "viewport", "-ms-viewport", "-moz-viewport", "-o-viewport", "-webkit-viewport", "counter", "counter-style", "string",
    "top-left-corner", "top-left", "top-center", "top-right", "top-right-corner", "bottom-left-corner", "bottom-left", "bottom-center", "bottom-right", "bottom-right-corner",
    "left-top", "left-middle", "left-bottom", "right-top", "right-middle", "right-bottom",
]

NAME = re.compile(r"-{0,2}[A-Za-zÀ-ÿ_\\][\w\-\\À-ÿ]*")
NUMBER = re.compile(r"[+-]?(?:\d+\.?\d*|\.\d+)(?:%|[A-Za-z]+)?")
HEX = re.compile(r"#[\w-]*")
STRING = re.compile(r"\"(?:[^\"\\]|\\.)*\"|'(?:[^'\\]|\\.)*'", re.S)
COMMENT = re.compile(r"/\*.*?(?:\*/|\Z)", re.S)
VALID_HEX = re.compile(r"#(?:[0-9a-fA-F]{3}){1,2}$")


@dataclass
class Error:
    code: str
    details: str
    at: int
    around: str = ""


@dataclass
class Node:
    kind: str
    name: str = ""
    start: int = 0
    end: int = 0
    source: str = ""
    valid: bool = True
    errors: list[Error] = field(default_factory=list)
    selectors: list[Node] = field(default_factory=list)
    properties: list[Node] = field(default_factory=list)
    rules: list[Node] = field(default_factory=list)
    values: list[Node] = field(default_factory=list)
    separators: list[str] = field(default_factory=list)
    flags: dict = field(default_factory=dict)

    def children(self) -> Iterator[tuple[str, list[Node]]]:
        yield "property", self.properties
        yield "rule", self.rules
        yield "selector", self.selectors
        yield "value", self.values

    def walk(self) -> Iterator[Node]:
        yield self
        for _, nodes in self.children():
            for n in nodes:
                yield from n.walk()

    @property
    def has_error(self) -> bool:
        return bool(self.errors) or any(n.errors for n in self.walk())

    @property
    def is_valid(self) -> bool:
        return self.valid and all(n.is_valid for _, nodes in self.children() for n in nodes)

    def render(self, mode: str = UNDERSTOOD) -> str:
        return _render(self, mode)

    def __str__(self) -> str:
        return self.render()


def _render(n: Node, mode: str) -> str:
    if mode == ORIGINAL and n.kind in ("property", "broken_property", "broken_rule", "orphan_block") and (n.errors or not n.is_valid):
        return n.source if n.kind == "broken_rule" else n.source.strip()
    if n.kind == "stylesheet":
        return "".join(_render(x, mode) for x in n.rules)
    if n.kind in ("broken_rule", "broken_property", "orphan_block"):
        return ""
    if n.kind == "class_rule":
        head = _original_selector(n) if mode == ORIGINAL and (n.selectors[0].has_error or not n.selectors[0].is_valid) else _render(n.selectors[0], mode)
        return head + "{" + "".join(_render(p, mode) for p in n.properties if _wanted(p, mode)) + "}"
    if n.kind == "directive_rule":
        head = "@" + n.name + (" " + n.flags["arguments"] if n.flags.get("arguments") else "")
        if n.flags["body"] == "rules":
            return head + "{" + "".join(_render(x, UNDERSTOOD) for x in n.rules) + "}"
        if n.flags["body"] == "properties":
            return head + "{" + "".join(_render(x, UNDERSTOOD) for x in n.properties) + "}"
        return head + ";"
    if n.kind == "property":
        out = ("*" if n.flags.get("star") else "") + n.name + ":" + _joined(n, mode)
        out += "!important" if n.flags.get("important") else ""
        out += "!" + n.flags["bang"] if n.flags.get("bang") else ""
        return out + n.flags.get("slash", "") + ";"
    if n.kind == "arithmetic":
        return n.flags.get("open", "") + _render(n.values[0], mode) + n.name + _render(n.values[1], mode) + n.flags.get("close", "")
    if n.kind == "function":
        return n.name + "(" + (n.flags["raw"] if "raw" in n.flags else _joined(n, mode)) + ")"
    if n.kind == "literal":
        return n.name
    if n.kind == "selector_list":
        return ",".join(_render(x, mode) for x in n.selectors)
    if n.kind == "child_selector":
        return _render(n.selectors[0], mode) + n.name + _render(n.selectors[1], mode)
    if n.kind == "multi_selector":
        return "".join(_render(x, mode) for x in n.selectors)
    if n.kind == "attribute":
        return "[" + n.name + n.flags.get("operator", "") + n.flags.get("value", "") + "]"
    if n.kind == "simple_selector":
        return n.flags["mark"] + n.name + ("(" + n.flags["argument"] + ")" if "argument" in n.flags else "")
    return n.flags.get("text", "")  # invalid_selector


def _original_selector(rule: Node) -> str:
    parts = split_top(rule.selectors[0].source, ",")
    return ",".join(re.sub(r"\s+", " ", p).strip() for p in parts)


def _wanted(p: Node, mode: str) -> bool:
    return not (mode == REMOVE_ERRORS and p.has_error or mode == REMOVE_INVALID and (p.has_error or not p.is_valid))


def _joined(n: Node, mode: str) -> str:
    out = ""
    for i, v in enumerate(n.values):
        out += _render(v, mode) + (n.separators[i] if i < len(n.separators) else "")
    return out


def split_top(text: str, mark: str) -> list[str]:
    """Parts at ``mark`` outside brackets and strings."""
    parts, depth, i, last = [], 0, 0, 0
    while i < len(text):
        c = text[i]
        if c in "\"'" and (m := STRING.match(text, i)):
            i = m.end()
            continue
        depth += (c in "([") - (c in ")]")
        if c == mark and depth <= 0:
            parts.append(text[last:i])
            last = i + 1
        i += 1
    return [*parts, text[last:]]


class _Reader:
    def __init__(self, css: str):
        self.css = css
        self.text = COMMENT.sub(lambda m: " " * len(m[0]), css)
        self.errors: list[Error] = []
        if (m := re.search(r"/\*(?:(?!\*/).)*\Z", css, re.S)) and COMMENT.search(css, m.start()):
            self.error("expecting_token", "*/", len(css))

    def error(self, code: str, details: str, at: int) -> Error:
        e = Error(code, details, at, self.css[max(0, at - 75) : at + 75])
        self.errors.append(e)
        return e

    def node(self, kind: str, start: int, end: int, **more) -> Node:
        return Node(kind, start=start, end=end, source=self.css[start:end], **more)

    def space(self, i: int, end: int) -> int:
        while i < end and self.text[i].isspace():
            i += 1
        return i

    def until(self, i: int, end: int, marks: str) -> int:
        """The next of ``marks`` outside brackets and strings."""
        depth = 0
        while i < end:
            c = self.text[i]
            if c in "\"'":
                m = STRING.match(self.text, i, end)
                if m:
                    i = m.end()
                    continue
            elif c == "\\" and c not in marks:
                i += 2
                continue
            elif c in marks and (depth <= 0 or c in "{}"):
                return i
            depth += (c in "([") - (c in ")]")
            i += 1
        return end

    def block_end(self, i: int, end: int) -> int:
        """The place of the brace that closes the one at ``i``, or ``end``."""
        depth = 0
        while i < end:
            c = self.text[i]
            if c in "\"'" and (m := STRING.match(self.text, i, end)):
                i = m.end()
                continue
            depth += (c == "{") - (c == "}")
            if depth == 0:
                return i
            i += 1
        self.error("expecting_token", "}", end)
        return end

    # ------------------------------------------------------------------ rules

    def rules(self, i: int, end: int) -> list[Node]:
        out: list[Node] = []

        def broken(a: int, b: int, code: str, details: str) -> None:
            e = self.error(code, details, a)
            out.append(self.node("broken_rule", a, b, valid=False, errors=[e]))

        while (i := self.space(i, end)) < end:
            if self.text[i] == "}":
                broken(i, i + 1, "unexpected_token", "}")
                i += 1
            elif self.text.startswith(("<!--", "-->"), i):
                n = 4 if self.text[i] == "<" else 3
                broken(i, i + n, "unexpected_token", self.text[i : i + n])
                if n == 4:  # keep the space that follows in the source
                    out[-1].source += " " if i + 4 < end and self.text[i + 4].isspace() else ""
                i += n
            elif self.text[i] == "@":
                node, i = self.directive(i, end)
                out.append(node)
            elif self.text[i] == "{":
                close = self.block_end(i, end)
                e = self.error("unexpected_token", "{", i)
                node = self.node("orphan_block", i, min(close + 1, end), valid=False, errors=[e])
                node.properties = self.properties(i + 1, close)
                out.append(node)
                i = close + 1
            else:
                brace = self.until(i, end, "{};")
                if brace == end or self.text[brace] != "{":
                    stop = brace if brace == end or self.text[brace] == "}" else brace + 1
                    broken(i, stop, "unexpected_end" if brace == end else "unexpected_token", self.css[i:stop])
                    i = stop
                    continue
                close = self.block_end(brace, end)
                node = self.node("class_rule", i, min(close + 1, end))
                node.selectors = [self.selector(i, brace)]
                node.properties = self.properties(brace + 1, close)
                node.name = node.selectors[0].render()
                out.append(node)
                i = close + 1
        return out

    def directive(self, i: int, end: int) -> tuple[Node, int]:
        m = NAME.match(self.text, i + 1)
        name = m[0] if m else ""
        at = m.end() if m else i + 1
        brace = self.until(at, end, "{;}")
        arguments = re.sub(r"\s+", " ", self.text[at:brace]).strip()
        opened = brace < end and self.text[brace] == "{"
        close = self.block_end(brace, end) if opened else brace
        stop = min(close + 1, end) if opened or brace < end and self.text[brace] == ";" else brace
        node = self.node("directive_rule", i, stop, name=name)
        body = "rules" if name.lower() in RULE_DIRECTIVES else "properties" if name.lower() in PROPERTY_DIRECTIVES else "none"
        node.flags = {"arguments": arguments, "body": body if opened else "none"}
        if opened and body == "rules":
            node.rules = self.rules(brace + 1, close)
        elif opened and body == "properties":
            node.properties = self.properties(brace + 1, close)
        elif opened:
            node.errors = [self.error("unexpected_token", "{", brace)]
        if not name:
            node.valid = False
            node.errors.append(self.error("expecting_token", "name", i + 1))
        return node, stop

    # ------------------------------------------------------------------ properties

    def properties(self, i: int, end: int) -> list[Node]:
        out = []
        while (i := self.space(i, end)) < end:
            if self.text[i] == "@":
                node, i = self.directive(i, end)
                out.append(node)
                continue
            stop = self.until(i, end, ";{")
            if stop < end and self.text[stop] == "{":
                close = min(self.block_end(stop, end) + 1, end)
                out.append(self.node("broken_property", i, close, valid=False, errors=[self.error("block_mismatch", "unexpected block token", stop)]))
                i = close
                continue
            if stop > i:
                out.append(self.property(i, stop, min(stop + 1, end)))
            i = stop + 1
        return out

    def property(self, i: int, stop: int, full: int) -> Node:
        star = self.text[i] == "*"
        m = NAME.match(self.text, i + star, stop)
        colon = self.space(m.end(), stop) if m else stop
        if not m or colon >= stop or self.text[colon] != ":":
            return self.node("broken_property", i, full, valid=False, errors=[self.error("expecting_token", ":", min(colon, stop))])
        node = self.node("property", i, full, name=m[0])
        node.flags["star"] = star
        text = self.text[colon + 1 : stop].rstrip()
        if h := re.search(r"\s*(\\9|\\0/?)$", text):
            node.flags["slash"] = h[1]
            text = text[: h.start()]
        if h := re.search(r"\s*!\s*([\w-]+)$", text):
            if h[1].lower() == "important":
                node.flags["important"] = True
            else:
                node.flags["bang"] = h[1]
            text = text[: h.start()]
        node.values, node.separators = self.values(text, colon + 1, node)
        if not node.values:
            node.valid = False
        return node

    def values(self, text: str, base: int, owner: Node) -> tuple[list[Node], list[str]]:
        nodes, separators, i = [], [], 0
        while i < len(text):
            while i < len(text) and text[i].isspace():
                i += 1
            if i >= len(text):
                break
            value, i = self.arithmetic(text, i, base, owner, 0)
            if value is None:
                owner.errors.append(self.error("unexpected_token", text[i : i + 1], base + i))
                owner.valid = False
                i += 1
                continue
            nodes.append(value)
            k = i
            while k < len(text) and text[k].isspace():
                k += 1
            if k < len(text) and text[k] == ",":
                separators.append(",")
                i = k + 1
            elif k < len(text):
                separators.append(" ")
        return nodes, separators[: max(0, len(nodes) - 1)] if len(separators) >= len(nodes) else separators

    def arithmetic(self, text: str, i: int, base: int, owner: Node, level: int) -> tuple[Node | None, int]:
        """Operators by strength: = weakest, then + and -, then * and /; equals lean to the right."""
        levels = ("=", "+-", "*/")
        if level == len(levels):
            return self.operand(text, i, base, owner)
        start = i
        left, i = self.arithmetic(text, i, base, owner, level + 1)
        if left is None:
            return None, i
        k = i
        while k < len(text) and text[k].isspace():
            k += 1
        spaced = k > i
        if k < len(text) and text[k] in levels[level]:
            after = k + 1
            apart = after < len(text) and text[after].isspace()
            # a sign after a space and before a value begins the next value
            if not (text[k] in "+-" and spaced and not apart):
                while after < len(text) and text[after].isspace():
                    after += 1
                right, j = self.arithmetic(text, after, base, owner, level)
                if right is not None:
                    node = Node("arithmetic", text[k], base + start, base + j, text[start:j], values=[left, right])
                    return node, j
        return left, i

    def operand(self, text: str, i: int, base: int, owner: Node) -> tuple[Node | None, int]:
        if m := STRING.match(text, i):
            return Node("literal", m[0], base + i, base + m.end(), m[0]), m.end()
        if text[i] in "\"'":
            owner.errors.append(self.error("unexpected_end", "string", base + i))
            return Node("literal", text[i:].rstrip(), base + i, base + len(text), text[i:], valid=False), len(text)
        if text[i] == "(":
            close = self._close(text, i)
            inner, _ = self.arithmetic(text[:close], self._skip(text, i + 1), base, owner, 0)
            if inner is None:
                return None, i
            if inner.kind == "arithmetic":
                inner.flags |= {"open": "(" + inner.flags.get("open", ""), "close": inner.flags.get("close", "") + ")"}
            else:
                inner = Node("literal", "(" + inner.render() + ")", inner.start, inner.end, inner.source)
            return inner, min(close + 1, len(text))
        if m := re.compile(r"progid:[\w.]+").match(text, i):
            end = m.end()
            if end < len(text) and text[end] == "(":
                close = self._close(text, end)
                node = Node("function", m[0], base + i, base + close + 1, text[i : close + 1], flags={"raw": text[end + 1 : close].strip()})
                return node, min(close + 1, len(text))
            return Node("literal", m[0], base + i, base + end, m[0]), end
        if m := HEX.match(text, i):
            return Node("literal", m[0], base + i, base + m.end(), m[0], valid=bool(VALID_HEX.match(m[0]))), m.end()
        if m := NUMBER.match(text, i):
            shown = re.sub(r"^([+-]?)\.", r"\g<1>0.", m[0])
            return Node("literal", shown, base + i, base + m.end(), m[0]), m.end()
        if m := NAME.match(text, i):
            end = m.end()
            if end < len(text) and text[end] == "(":
                close = self._close(text, end)
                node = Node("function", m[0], base + i, base + close + 1, text[i : close + 1])
                if m[0].lower() == "url":
                    node.flags["raw"] = text[end + 1 : close].strip()
                    node.valid = bool(node.flags["raw"])
                else:
                    node.values, node.separators = self.values(text[end + 1 : close], base + end + 1, node)
                if close >= len(text):
                    owner.errors.append(self.error("expecting_token", ")", base + len(text)))
                return node, min(close + 1, len(text))
            if text[end : end + 1] in (":", ".") and re.match(r"[:.][\w.]+", text[end:]):
                end += re.match(r"[:.][\w.:]+", text[end:]).end()
                return Node("literal", text[i:end], base + i, base + end, text[i:end]), end
            return Node("literal", m[0], base + i, base + end, m[0]), end
        return None, i

    @staticmethod
    def _skip(text: str, i: int) -> int:
        while i < len(text) and text[i].isspace():
            i += 1
        return i

    @staticmethod
    def _close(text: str, i: int) -> int:
        depth = 0
        while i < len(text):
            if text[i] in "\"'" and (m := STRING.match(text, i)):
                i = m.end()
                continue
            depth += (text[i] == "(") - (text[i] == ")")
            if depth == 0:
                return i
            i += 1
        return i

    # ------------------------------------------------------------------ selectors

    def selector(self, i: int, end: int) -> Node:
        text = self.text[i:end]
        parts, at = [], i
        for part in split_top(text, ","):
            parts.append(self.complex(part, at))
            at += len(part) + 1
        if len(parts) == 1:
            parts[0].source = self.css[i:end]
            return parts[0]
        return self.node("selector_list", i, end, selectors=parts)

    def complex(self, text: str, base: int) -> Node:
        items: list[Node] = []
        marks: list[str] = []
        i, mark = 0, ""
        errors: list[Error] = []
        while i < len(text):
            k = self._skip(text, i)
            if k >= len(text):
                break
            if text[k] in ">+~":
                if not items or mark in tuple(">+~"):
                    errors.append(self.error("unexpected_token", text[k], base + k))
                    break
                mark, i = text[k], k + 1
                continue
            if items and not mark:
                mark = " " if k > i else ""
            node, j = self.compound(text, k, base)
            if node is None:
                errors.append(self.error("unexpected_token", text[k : k + 1], base + k))
                break
            if items:
                marks.append(mark or " ")
            items.append(node)
            mark, i = "", j
            if node.errors:
                break
            if j < len(text) and not text[j].isspace() and text[j] not in ">+~":
                errors.append(self.error("unexpected_token", text[j], base + j))
                break
        if not items:
            source = text.strip()
            e = errors or [self.error("expecting_token", "selector", base)]
            return Node("invalid_selector", source, base, base + len(text), text, False, e, flags={"text": ""})
        if mark in tuple(">+~"):
            errors.append(self.error("unexpected_end", "selector", base + len(text)))
        out = items[-1]
        for left, m in zip(reversed(items[:-1]), reversed(marks)):
            out = Node("child_selector", m, left.start, out.end, text[left.start - base : out.end - base], selectors=[left, out])
        out.errors += errors
        out.valid = out.valid and not errors
        return out

    def compound(self, text: str, i: int, base: int) -> tuple[Node | None, int]:
        parts: list[Node] = []
        start = i
        errors: list[Error] = []
        while i < len(text) and not text[i].isspace() and text[i] not in ">+~,":
            begin = i
            if text[i] == "[":
                close = text.find("]", i)
                m = re.match(r"\s*([\w-]+)\s*(?:([~|^$*!]?=)\s*(.+?)\s*)?$", text[i + 1 : close if close > 0 else len(text)], re.S)
                if close < 0 or not m:
                    errors.append(self.error("unexpected_token", text[i + 1 : i + 2], base + i + 1))
                    i = len(text) if close < 0 else close + 1
                    break
                flags = {"operator": m[2], "value": m[3]} if m[2] else {}
                parts.append(Node("attribute", m[1], base + i, base + close + 1, text[i : close + 1], flags=flags))
                i = close + 1
                continue
            mark = "::" if text.startswith("::", i) else text[i] if text[i] in ".#:" else ""
            i += len(mark)
            m = re.compile(r"\*" if not mark else r"[\w\-\\À-ÿ]+").match(text, i) or (NAME.match(text, i) if not mark else None) or (re.compile(r"\d+(?:\.\d+)?%").match(text, i) if not mark else None)
            if not m:
                if parts:
                    i = begin
                    errors.append(self.error("unexpected_token", text[begin], base + begin))
                    break
                return None, begin
            i = m.end()
            node = Node("simple_selector", m[0], base + begin, base + i, text[begin:i], flags={"mark": mark})
            if i < len(text) and text[i] == "(":
                close = self._close(text, i)
                argument = text[i + 1 : close].strip()
                if m[0].lower() == "not":
                    inner = _Reader(argument)
                    node.selectors = [inner.selector(0, len(argument))]
                    argument = node.selectors[0].render()
                    errors += inner.errors
                node.flags["argument"] = argument
                i = min(close + 1, len(text))
                node.end, node.source = base + i, text[begin:i]
            parts.append(node)
        if not parts:
            return None, start
        out = parts[0] if len(parts) == 1 else Node("multi_selector", "", base + start, base + i, text[start:i], selectors=parts)
        out.errors += errors
        out.valid = not errors
        return out, i


def parse(css: str | None) -> Node:
    reader = _Reader(css or "")
    sheet = reader.node("stylesheet", 0, len(reader.css))
    sheet.rules = reader.rules(0, len(reader.css))
    sheet.errors = reader.errors
    return sheet


# ------------------------------------------------------------------ queries and edits

SCOPES = ("rules", "selectors", "properties", "values")


@dataclass
class Found:
    node: Node
    owner: list[Node]

    def replace(self, css_or_node: str | Node) -> None:
        new = css_or_node if isinstance(css_or_node, Node) else fragment(css_or_node, self.node.kind)
        self.owner[[id(x) for x in self.owner].index(id(self.node))] = new

    def remove(self) -> None:
        del self.owner[[id(x) for x in self.owner].index(id(self.node))]


def fragment(css: str, kind: str) -> Node:
    """A node of the kind of ``kind`` from its text."""
    if kind in ("property", "broken_property"):
        return parse("x{" + css + "}").rules[0].properties[0]
    if kind in ("literal", "function", "arithmetic"):
        return parse("x{x:" + css + "}").rules[0].properties[0].values[0]
    if kind.endswith(("_rule", "_block")):
        return parse(css).rules[0]
    return _Reader(css).selector(0, len(css))


def find(sheet: Node, kinds: str | tuple[str, ...], predicate: Callable[[Node], bool] = lambda n: True, scopes: tuple[str, ...] = SCOPES) -> list[Found]:
    """Nodes of the given kinds that satisfy the predicate; not below another match."""
    kinds = (kinds,) if isinstance(kinds, str) else kinds
    out: list[Found] = []
    need = {"property": "properties", "rule": "rules", "selector": "selectors", "value": "values"}

    def visit(n: Node) -> None:
        for role, nodes in n.children():
            if need[role] not in scopes and not (role == "rule" or role == "property" and "values" in scopes):
                continue
            for x in list(nodes):
                if x.kind in kinds and predicate(x):
                    out.append(Found(x, nodes))
                else:
                    visit(x)

    visit(sheet)
    return out


SELECTORS = ("selector_list", "child_selector", "multi_selector", "simple_selector", "attribute", "invalid_selector")


def clone(sheet: Node, keep: Callable[[Node], bool] | None = None) -> Node:
    """A copy with the class rules whose selectors, or some members of a list, satisfy ``keep``.

    A member is kept if it or any part of it satisfies ``keep``. Lists of one are unwrapped. Directives stay only
    with rules that stay, so those of properties go.
    """
    import copy

    out = copy.deepcopy(sheet)
    if keep is None:
        return out

    def selector(n: Node) -> Node | None:
        if n.kind == "selector_list":
            n.selectors = [x for x in map(selector, n.selectors) if x]
            return (n if len(n.selectors) > 1 else n.selectors[0]) if n.selectors else None
        return n if any(keep(x) for x in n.walk() if x.kind in SELECTORS) else None

    def rules(nodes: list[Node]) -> list[Node]:
        left = []
        for n in nodes:
            if n.kind == "class_rule":
                if s := selector(n.selectors[0]):
                    n.selectors = [s]
                    left.append(n)
            elif n.kind == "directive_rule" and n.rules:
                n.rules = rules(n.rules)
                if n.rules:
                    left.append(n)
        return left

    out.rules = rules(out.rules)
    return out


def rows(css: str | None) -> list[tuple]:
    """(node_no, parent_no, role, kind, name, text, from_idx, to_idx, is_valid, has_error, ord) of all nodes, depth first."""
    out: list[tuple] = []

    def visit(n: Node, parent: int | None, role: str, order: int) -> None:
        number = len(out)
        out.append((number, parent, role, n.kind, n.name, n.render(), n.start, n.end, n.is_valid, n.has_error, order))
        for r, nodes in n.children():
            for k, x in enumerate(nodes):
                visit(x, number, r, k)

    visit(parse(css), None, "sheet", 0)
    return out


# ------------------------------------------------------------------ building


def rule(selector: str, properties: dict[str, str]) -> Node:
    """A class rule from its parts."""
    return parse(selector + "{" + "".join(f"{k}:{v};" for k, v in properties.items()) + "}").rules[0]


def stylesheet(*rules_: Node) -> Node:
    return Node("stylesheet", rules=list(rules_))
