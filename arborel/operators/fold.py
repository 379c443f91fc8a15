"""One pass over an XML document: bytes in, raw rows of the wanted tables out."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

from ..errors import LevelFault, SyntaxFault, ValueFault
from ..plans.program import Node, Program

#: A start tag up to its end, with quoted values that may hold ">" or "<".
_TAG = re.compile(rb"""[^>"']*+(?:"[^"]*+"[^>"']*+|'[^']*+'[^>"']*+)*+>""")
_ATTRIBUTE = re.compile(rb"""\s*+([^\s=/>"'<]++)\s*+=\s*+(?:"([^"]*+)"|'([^']*+)')""")
_REFERENCE = re.compile(rb"&([^;&<]*+);")
_BLANK = b" \t\r\n"
#: The entities that XML itself defines.
_ENTITIES = {b"amp": b"&", b"lt": b"<", b"gt": b">", b"quot": b'"', b"apos": b"'"}
_STEP = 1 << 20


def _pieces(data: bytes) -> Iterator[bytes]:
    """The document cut at every "<", the first piece being what precedes any tag."""
    at, size = 0, len(data)
    while at <= size:
        cut = data.find(b"<", at + _STEP) if at + _STEP < size else -1
        if cut < 0:
            yield from data[at:].split(b"<")
            return
        yield from data[at:cut].split(b"<")
        at = cut + 1


def _character(name: bytes) -> bytes:
    try:
        code = int(name[2:], 16) if name[1:2] in (b"x", b"X") else int(name[1:])
        if name[1:2] in b"+-" or name[2:3] in (b"+", b"-") or b"_" in name or not code:
            raise ValueError
        return chr(code).encode()
    except (ValueError, OverflowError, UnicodeEncodeError):
        raise SyntaxFault(f"Invalid character reference &{name.decode('utf-8', 'replace')};", reference=name.decode("utf-8", "replace")) from None


def _attribute_value(raw: bytes) -> bytes:
    """Literal white space becomes spaces; references are resolved."""
    raw = raw.replace(b"\r\n", b" ").replace(b"\t", b" ").replace(b"\r", b" ").replace(b"\n", b" ")
    if b"&" not in raw:
        return raw

    def resolved(m: re.Match) -> bytes:
        name = m[1]
        if name[:1] == b"#":
            return _character(name)
        if name not in _ENTITIES:
            raise SyntaxFault(f"Unknown entity &{name.decode('utf-8', 'replace')}; in an attribute", reference=name.decode("utf-8", "replace"))
        return _ENTITIES[name]

    out = _REFERENCE.sub(resolved, raw)
    if b"&" in _REFERENCE.sub(b"", raw):
        raise SyntaxFault("An attribute holds & without a reference")
    return out


class Fold:
    """The stack machine of one document.

    emit(table index, position, levels, cells) gets each finished row of the
    wanted tables; cells are bytes, or None where nothing was captured.
    """

    def __init__(self, program: Program, wanted: set[int], emit: Callable):
        self.program, self.wanted, self.emit = program, wanted, emit
        self.cells: list[bytes | None] = [None] * program.cells
        self.rows = [0] * len(program.plans)
        self.position = 0
        o = program.mapping.parser_options
        self.trim, self.strip, self.tags, self.twice = o.trim_text, o.strip_namespaces, o.validate_closing_tags, o.validate_attributes

    def run(self, data: bytes) -> None:
        if data.startswith(b"\xef\xbb\xbf"):
            data = data[3:]
        pieces = _pieces(data)
        node: Node | None = self.program.root
        stack: list[tuple[bytes, Node | None]] = []
        strip, tags, attributes, cells, rows = self.strip, self.tags, self.program.attributes, self.cells, self.rows
        text = next(pieces)
        while True:
            if text:
                if b"&" in text:
                    self.references(text, node)
                elif node is not None and node.slots:
                    if self.trim:
                        text = text.strip(_BLANK)
                    if text:
                        for c in node.slots:
                            v = cells[c]
                            cells[c] = text if v is None else v + text
            piece = next(pieces, None)
            if piece is None:
                return
            mark = piece[:1]
            if mark == b"/":
                end = piece.find(b">")
                if end < 0:
                    raise SyntaxFault("A closing tag does not end")
                text = piece[end + 1 :]
                name = piece[1:end].rstrip()
                if not stack:
                    if tags:
                        raise SyntaxFault(f"Closing tag {name.decode('utf-8', 'replace')!r} without an opening one")
                    continue
                opened, left = stack.pop()
                if tags and opened != name:
                    raise SyntaxFault(f"Closing tag {name.decode('utf-8', 'replace')!r} does not match {opened.decode('utf-8', 'replace')!r}", opened=opened.decode("utf-8", "replace"), closed=name.decode("utf-8", "replace"))
                node = stack[-1][1] if stack else self.program.root
                if left is not None:
                    if left.row_of >= 0:
                        self.end_row(left.row_of)
                    if left.stop:
                        return
                continue
            if mark == b"!" or mark == b"?":
                text = self.special(piece, pieces, node)
                continue
            end = piece.find(b">")
            body = piece[:end]
            if end < 0 or body.count(b'"') & 1 or b"'" in body:
                m = _TAG.match(piece)
                while m is None:
                    more = next(pieces, None)
                    if more is None:
                        raise SyntaxFault("A tag does not end")
                    piece = piece + b"<" + more
                    m = _TAG.match(piece)
                end = m.end() - 1
                body = piece[:end]
            text = piece[end + 1 :]
            closed = body[-1:] == b"/"
            if closed:
                body = body[:-1]
            parts = body.split(None, 1)
            if not parts or body[:1].isspace():
                raise SyntaxFault("A tag has no name")
            name = parts[0]
            inner = None
            if node is not None:
                inner = node.children.get(name.partition(b":")[2] if strip and b":" in name else name)
                if inner is not None:
                    for c in inner.guard:
                        if cells[c] is not None:
                            raise self.fault(c, cells[c], "duplicate value", "has a value more than once in a row")
                    if inner.table >= 0:
                        rows[inner.table] = 0
                    if attributes and inner.attributes and len(parts) > 1:
                        self.attributes(parts[1], inner)
            if not closed:
                stack.append((name, inner))
                node = inner
            elif inner is not None:
                if inner.row_of >= 0:
                    self.end_row(inner.row_of)
                if inner.stop:
                    return

    def end_row(self, table: int) -> None:
        plan, rows, cells = self.program.plans[table], self.rows, self.cells
        if plan.end > plan.first:
            if table in self.wanted:
                if len(plan.table.levels) > len(plan.chain):
                    raise LevelFault(f"Table {plan.table.name!r} has more levels than its rows have", table=plan.table.name)
                self.emit(table, self.position, [rows[t] for t in plan.chain[: plan.levels]], cells[plan.first : plan.end])
                self.position += 1
            cells[plan.first : plan.end] = [None] * (plan.end - plan.first)
        rows[table] += 1

    def fault(self, cell: int, value: bytes, kind: str, says: str) -> ValueFault:
        name, path = self.program.names[cell]
        shown = value.decode("utf-8", "replace")
        return ValueFault(f"Field {name!r} at {path} {says}: {shown!r}", field=name, path=path, value=shown, kind=kind)

    def capture(self, node: Node | None, value: bytes) -> None:
        if node is not None:
            for c in node.slots:
                v = self.cells[c]
                self.cells[c] = value if v is None else v + value

    def references(self, text: bytes, node: Node | None) -> None:
        """Text with references: each stretch between them is a text of its own."""
        at = 0
        while True:
            mark = text.find(b"&", at)
            part = text[at:] if mark < 0 else text[at:mark]
            if self.trim:
                part = part.strip(_BLANK)
            if part:
                self.capture(node, part)
            if mark < 0:
                return
            m = _REFERENCE.match(text, mark)
            if m is None:
                raise SyntaxFault("& begins no reference")
            at = m.end()
            if node is None:
                continue
            name = m[1]
            if name[:1] == b"#":
                self.capture(node, _character(name))
            elif name in _ENTITIES:
                self.capture(node, _ENTITIES[name])
            elif node.slots:
                raise self.fault(node.slots[0], name, "unresolved entity", "has an entity that can't be resolved")

    def special(self, piece: bytes, pieces: Iterator[bytes], node: Node | None) -> bytes:
        """Comments, CDATA, instructions, declarations; returns the text after."""
        if piece.startswith(b"!--"):
            close, begin = b"-->", 3
        elif piece.startswith(b"![CDATA["):
            close, begin = b"]]>", 8
        elif piece.startswith(b"?"):
            close, begin = b"?>", 1
        else:  # a document type, with declarations inside
            depth = 1
            while True:
                for i, c in enumerate(piece):
                    if c == 0x3E:
                        depth -= 1
                        if not depth:
                            return piece[i + 1 :]
                piece = next(pieces, None)
                if piece is None:
                    raise SyntaxFault("A declaration does not end")
                depth += 1
        held = []
        end = piece.find(close, begin)
        while end < 0:
            held.append(piece[begin:])
            piece = next(pieces, None)
            if piece is None:
                raise SyntaxFault("A comment, CDATA section or instruction does not end")
            begin = 0
            end = piece.find(close)
        if close == b"]]>" and node is not None and node.slots:
            held.append(piece[begin:end])
            self.capture(node, b"<".join(held))
        return piece[end + len(close) :]

    def attributes(self, raw: bytes, element: Node) -> None:
        at, seen = 0, set()
        raw = raw.rstrip()
        while at < len(raw):
            m = _ATTRIBUTE.match(raw, at)
            if m is None:
                raise SyntaxFault(f"Malformed attribute: {raw[at:].decode('utf-8', 'replace')!r}")
            at = m.end()
            key = m[1]
            if self.twice:
                if key in seen:
                    raise SyntaxFault(f"Attribute {key.decode('utf-8', 'replace')!r} is there more than once", attribute=key.decode("utf-8", "replace"))
                seen.add(key)
            node = element.attributes.get(key.partition(b":")[2] if self.strip and b":" in key else key)
            if node is not None:
                value = m[2] if m[2] is not None else m[3]
                if b"&" in value or b"\t" in value or b"\n" in value or b"\r" in value:
                    value = _attribute_value(value)
                self.capture(node, value)
