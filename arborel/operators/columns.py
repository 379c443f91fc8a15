"""Shredding many plain documents at a time with array operations.

Most documents use a plain part of XML: tags, attributes in double quotes,
text, references.  For those, positions of markup in a whole batch give the
tokens, their depths, their nodes level by level, and for one table the cells
as spans of the batch: no object is made for a tag or a value.  Counts of
closed rows before a place give rows and levels:

* a value at place p goes to the row number (closes of its table before p);
* a level is (closes of that table before p) - (those before its last opening).

A document with comments, CDATA, instructions or single quotes is rewritten to
plain form first, where that is sure to mean the same.  A document with
anything else (repeated values, mixed content, faults of any kind) is left to
the fold, which has the last word.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

from ..errors import ShredError
from ..plans.program import Node, Plan, Program
from .fold import _BLANK, _ENTITIES, _REFERENCE, _attribute_value, _character

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_TURNED = np.zeros(256, bool)  # white space that becomes a space in an attribute's value
_TURNED[[0x09, 0x0A, 0x0D]] = True
_MASKS = np.array([(1 << (8 * n)) - 1 for n in range(9)], np.uint64)
_M1, _M2, _S = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53), np.uint64(33)
#: Names up to this length are hashed by words of eight bytes, longer ones one by one.
_NAME = 32
_SOLID = np.ones(256, bool)
_SOLID[list(_BLANK)] = False
#: What plain documents do not have: comments, CDATA, instructions, short document types.
_SPECIAL = re.compile(rb"<!--.*?-->|<!\[CDATA\[(.*?)\]\]>|<\?.*?\?>|<!DOCTYPE[^<>\[]*>", re.S)
#: A tag with single quotes.
_SINGLE = re.compile(rb"""<[^<>!?/'"][^<>'"]*'[^<>"]*>""")
#: A longer document goes to the fold, which needs less memory.
LONGEST = 16 << 20


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> _S)
    x = x * _M1
    x = x ^ (x >> _S)
    x = x * _M2
    return x ^ (x >> _S)


def name_hashes(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """64-bit hashes of names; data must go on for 32 bytes after the last one."""
    words = np.ndarray((len(data) - 7,), "<u8", data, strides=(1,))
    h = size.astype(np.uint64) * _M2
    for k in range(0, _NAME, 8):
        on = np.flatnonzero(size > k) if k else slice(None)
        part = words[start[on] + k] & _MASKS[np.clip(size[on] - k, 0, 8)]
        h[on] = _mix(h[on] + part)
        if k and not len(on):
            break
    for i in np.flatnonzero(size > _NAME).tolist():
        raw = data[start[i] : start[i] + size[i]].tobytes()
        h[i] = int.from_bytes(hashlib.blake2b(raw, digest_size=8).digest(), "little")
    return h


def _hash_of(name: bytes) -> int:
    data = np.frombuffer(name + b"\0" * 40, np.uint8)
    return int(name_hashes(data, np.array([0]), np.array([len(name)]))[0])


class Edges:
    """(node, name) -> node, by sorted keys."""

    def __init__(self, edges: list[tuple[int, int, int]]):
        keys = np.array([(h + n * int(_M1)) & (1 << 64) - 1 for n, h, _ in edges], np.uint64)
        order = np.argsort(keys)
        self.keys, self.to = keys[order], np.array([t for _, _, t in edges], np.int32)[order]

    def follow(self, node: np.ndarray, name: np.ndarray) -> np.ndarray:
        if not len(self.keys):
            return np.full(len(node), -1, np.int32)
        with np.errstate(over="ignore"):
            key = name + node.astype(np.uint64) * _M1
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where((self.keys[at] == key) & (node >= 0), self.to[at], -1)


@dataclass
class Shape:
    """A program's path tree as arrays."""

    elements: Edges
    attributes: Edges
    row_of: np.ndarray
    table: np.ndarray
    attributed: np.ndarray
    slotted: np.ndarray
    stops: np.ndarray
    guarded: list[tuple[int, int]]  # node, its table
    places: dict[int, list[tuple[int, bool]]]  # cell -> nodes (number, is an attribute)


def shape_of(program: Program) -> Shape | None:
    """None for mappings that only the fold can run."""
    if program.root.slots or any(len(p.table.levels) > len(p.chain) for p in program.plans):
        return None
    nodes: list[Node] = [program.root]
    elements, attributes, is_attribute = [], [], {0: False}
    at = 0
    while at < len(nodes):
        for place, edges in ((nodes[at].children, elements), (nodes[at].attributes, attributes)):
            for name, child in place.items():
                is_attribute[len(nodes)] = edges is attributes
                edges.append((at, _hash_of(name), len(nodes)))
                nodes.append(child)
        at += 1
    owner = {c: p.index for p in program.plans for c in range(p.first, p.end)}
    places: dict[int, list[tuple[int, bool]]] = {}
    for i, n in enumerate(nodes):
        for c in n.slots:
            places.setdefault(c, []).append((i, is_attribute[i]))
    return Shape(
        Edges(elements),
        Edges(attributes),
        np.array([-1 if is_attribute[i] else n.row_of for i, n in enumerate(nodes)] + [-1]),
        np.array([n.table for n in nodes] + [-1]),
        np.array([bool(n.attributes) and program.attributes for n in nodes] + [False]),
        np.array([bool(n.slots) for n in nodes] + [False]),
        np.array([n.stop for n in nodes] + [False]),
        [(i, owner[n.guard[0]]) for i, n in enumerate(nodes) if n.guard],
        places,
    )


def _resolved(raw: bytes, trim: bool) -> bytes | None:
    """Text with its references resolved, or None where the fold must decide; with trim, texts between them are trimmed."""
    parts = _REFERENCE.split(raw)
    try:
        parts[1::2] = [_character(name) if name[:1] == b"#" else _ENTITIES[name] for name in parts[1::2]]
    except (KeyError, ShredError):
        return None
    if any(b"&" in p for p in parts[::2]):
        return None
    if trim:
        parts[::2] = [p.strip(_BLANK) for p in parts[::2]]
    return b"".join(parts)


def _normalised(raw: bytes) -> bytes | None:
    """An attribute's value, or None where the fold must decide."""
    try:
        return _attribute_value(raw)
    except ShredError:
        return None


def simplified(document: bytes, trim: bool) -> bytes | None:
    """The document in plain form; None where it is plain, or where only the fold can tell what it means.

    Comments, instructions and short document types go, CDATA becomes text
    with references, and single quotes around attributes become double ones.
    With trim, texts on both sides of a comment are trimmed apart, so that
    such documents are the fold's.
    """
    out = document
    if b"<!" in out or b"<?" in out:
        if trim and (b"<!--" in out or b"<![CDATA[" in out or out.count(b"<?") > 1):
            return None
        parts, at = [], 0
        for m in _SPECIAL.finditer(out):
            head = out[at : m.start()]
            # It must stand between whole tags, and not within a reference.
            last = head.rfind(b"<")
            tag, closed, _ = head[last + 1 :].partition(b">") if last >= 0 else (b"", b">", b"")
            if not closed or tag.count(b'"') & 1 or tag.count(b"'") & 1 or head.rfind(b"&") > head.rfind(b";") or m[1] == b"":
                return None
            parts.append(head)
            if m[1] is not None:
                parts.append(m[1].replace(b"&", b"&amp;").replace(b"<", b"&lt;").replace(b">", b"&gt;"))
            at = m.end()
        out = b"".join(parts) + out[at:]
    if b"'" in out:
        out = _SINGLE.sub(lambda m: m[0].replace(b"'", b'"'), out)
    return None if out is document or out == document else out


class Rows:
    """Rows of one table: row i belongs to document doc[i]."""

    def __init__(self, doc, position, levels, cells):
        self.doc, self.position, self.levels, self.cells = doc, position, levels, cells


class Columns:
    """Rows of the tables of some plans."""

    def __init__(self, program: Program, plans: list[Plan]):
        self.program, self.plans, self.shape = program, plans, shape_of(program)
        o = program.mapping.parser_options
        self.strip, self.twice, self.trim = o.strip_namespaces, o.validate_attributes, o.trim_text

    def run(self, data: np.ndarray, offsets: np.ndarray) -> tuple[dict[int, Rows], np.ndarray]:
        """Rows by table of the documents that could be done here, and which could not (mask)."""
        n_docs, shape = len(offsets) - 1, self.shape
        bad = np.diff(offsets) > LONGEST
        if shape is None:
            return {}, np.ones(n_docs, bool)
        size = len(data)
        data = np.concatenate([data, np.zeros(48, np.uint8)])
        lt, gt = np.flatnonzero(data == 0x3C), np.flatnonzero(data == 0x3E)
        n_lt, n_gt = (np.diff(np.searchsorted(x, offsets)) for x in (lt, gt))
        bad |= n_lt != n_gt
        doc_of = lambda x: np.searchsorted(offsets, x, side="right") - 1
        doc = np.repeat(np.arange(n_docs), n_lt)
        if bad.any():
            lt, gt = lt[~bad[doc]], gt[~bad[np.repeat(np.arange(n_docs), n_gt)]]
            doc = doc[~bad[doc]]
        if len(lt):
            wrong = lt > gt
            wrong[:-1] |= (gt[:-1] > lt[1:]) & (doc[:-1] == doc[1:])
            bad[doc[wrong]] = True
        first = np.ones(len(lt), bool)
        first[1:] = doc[1:] != doc[:-1]
        mark = data[lt + 1]
        declared = first & (mark == 0x3F) & (data[gt - 1] == 0x3F)  # the XML declaration
        bad[doc[((mark == 0x21) | (mark == 0x3F)) & ~declared]] = True
        # Quotes must pair up within tags.
        dq, sq, amp = (np.flatnonzero(data == b) for b in (0x22, 0x27, 0x26))
        every_amp = amp
        holds = np.diff(np.searchsorted(amp, offsets)) > 0  # without tags, an & is for the fold
        in_tag = lambda x: np.searchsorted(x, gt) - np.searchsorted(x, lt)
        quotes = in_tag(dq) if len(dq) else np.zeros(len(lt), int)
        for odd in (quotes & 1 > 0, in_tag(sq) > 0):
            bad[doc[odd & ~declared]] = True
        ok = ~bad[doc] & ~declared
        lt, gt, doc, mark, quotes = lt[ok], gt[ok], doc[ok], mark[ok], quotes[ok]
        if not len(lt):
            return {}, bad | holds

        ends = mark == 0x2F
        alone = ~ends & (data[gt - 1] == 0x2F)
        begin = lt + 1 + ends
        stop = gt - alone
        low = np.flatnonzero(data[:size] <= 0x20)  # few bytes are looked at one by one
        space = np.append(low[_SPACE[data[low]]], size)
        until = np.minimum(space[np.searchsorted(space, begin)], stop)
        bad[doc[(until == begin) | ends & (until != stop)]] = True
        name = name_hashes(data, begin, until - begin)
        local = name
        if self.strip:
            colon = np.append(np.flatnonzero(data == 0x3A), len(data))
            at = colon[np.searchsorted(colon, begin)]
            some = np.flatnonzero(at < until)
            if len(some):
                local = name.copy()
                local[some] = name_hashes(data, at[some] + 1, until[some] - at[some] - 1)

        # Depths; each element's start and end are neighbours among the tokens of their depth.
        opens = ~ends & ~alone
        step = opens.astype(np.int32) - ends
        depth = np.cumsum(step)
        head = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]]))
        last = np.append(head[1:], len(doc)) - 1
        base = np.repeat(depth[head] - step[head], np.diff(np.append(head, len(doc))))
        depth -= base
        bad[doc[depth < 0]] = True
        bad[doc[last][depth[last] != 0]] = True
        own = depth + ~opens  # the depth of the token's element, from 1
        if bad[doc].any():
            ok = ~bad[doc]
            lt, gt, doc, quotes, ends, alone, opens, begin, stop, until, name, local, own = (x[ok] for x in (lt, gt, doc, quotes, ends, alone, opens, begin, stop, until, name, local, own))
        n = len(lt)
        if not n:
            return {}, bad | holds
        paired = np.flatnonzero(~alone)
        paired = paired[np.argsort(own[paired].astype(np.int16) if own.max() < 32000 else own[paired], kind="stable")]
        starts, closes = paired[0::2], paired[1::2]
        bad[doc[starts[name[starts] != name[closes]]]] = True
        start_of = np.arange(n)
        start_of[closes] = starts

        # Nodes level by level; -1 is unknown, and everything below it.
        node = np.full(n, -1, np.int32)
        parent = np.full(n, -1, np.int32)  # the parent element's node
        heads = np.flatnonzero(~ends)
        heads = heads[np.argsort(own[heads], kind="stable")]
        cuts = np.searchsorted(own[heads], np.arange(1, int(own.max()) + 2))
        above = np.zeros(0, int)
        for level in range(1, int(own.max()) + 1):
            here = heads[cuts[level - 1] : cuts[level]]
            if level == 1:
                parent[here] = 0
            else:
                parent[here] = node[above[np.searchsorted(above, here) - 1]]
            known = here[parent[here] >= 0]
            node[known] = shape.elements.follow(parent[known], local[known])
            above = here[opens[here]]
            if not (node[above] >= 0).any():
                break
        node, parent = node[start_of], parent[start_of]
        halts = np.flatnonzero(shape.stops[node] & ~opens) if shape.stops.any() else ()
        if len(halts):  # nothing after the first end of a stop path is known
            whose, at = np.unique(doc[halts], return_index=True)
            halt = np.full(n_docs, n)
            halt[whose] = halts[at]
            parent[halts[at]] = -1
            late = np.arange(n) > halt[doc]
            node[late] = parent[late] = -1

        # Places in order: at each token it opens, has attributes, closes a row; then comes text.
        keys = np.arange(n) * 4
        row_of = np.where(opens, -1, shape.row_of[node])
        closing: dict[int, np.ndarray] = {}

        def closes_of(table: int) -> np.ndarray:
            if table not in closing:
                closing[table] = keys[row_of == table] + 2
            return closing[table]

        for guarded, table in shape.guarded:
            entry = np.flatnonzero((node == guarded) & ~ends)
            row = np.searchsorted(closes_of(table), keys[entry])
            twice = (row[1:] == row[:-1]) & (doc[entry[1:]] == doc[entry[:-1]])
            bad[doc[entry[1:][twice]]] = True

        values: dict[int, list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]] = {}
        more: list[bytes] = []
        extra = len(data)

        def put(cell: int, key: np.ndarray, whose: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
            values.setdefault(cell, []).append((key, whose, a, b))

        def replaced(a: np.ndarray, b: np.ndarray, which: np.ndarray, make) -> tuple[np.ndarray, np.ndarray]:
            nonlocal extra
            a, b = a.copy(), b.copy()
            for i in which.tolist():
                made = make(data[a[i] : b[i]].tobytes())
                if made is None:
                    bad[doc_of(a[i])] = True
                    continue
                more.append(made)
                a[i], b[i] = extra, extra + len(made)
                extra += len(made)
            return a, b

        # Text: from each token to the next belongs to the element then open.
        owner = np.where(opens, node, parent)
        a, b = gt + 1, np.append(lt[1:], size)
        same = np.append(doc[1:] == doc[:-1], False)
        b = np.where(same, b, offsets[doc + 1])
        if len(amp):  # outside of tags, references must stand in text that is captured
            tag = np.searchsorted(lt, amp) - 1
            amp = amp[(tag < 0) | (amp > gt[tag])]
            tag = np.searchsorted(lt, amp) - 1
            loose = (tag < 0) | (amp >= b[tag]) | ~shape.slotted[owner[tag]]
            bad[doc_of(amp[loose])] = True
        filled = np.flatnonzero((a < b) & shape.slotted[owner])
        if self.trim and len(filled):
            solid = np.append(np.flatnonzero(_SOLID[data[:size]]), size)
            at, until_ = np.searchsorted(solid, a[filled]), np.searchsorted(solid, b[filled])
            filled, at, until_ = (x[until_ > at] for x in (filled, at, until_))
            a, b = a.copy(), b.copy()
            a[filled], b[filled] = solid[at], solid[until_ - 1] + 1
        refs = np.searchsorted(amp, b[filled]) - np.searchsorted(amp, a[filled]) if len(amp) else np.zeros(len(filled), int)
        fa, fb = replaced(a[filled], b[filled], np.flatnonzero((refs > 0) & ~bad[doc[filled]]), lambda raw: _resolved(raw, self.trim))
        mine = {c: p for p in self.plans for c in range(p.first, p.end)}
        for cell in mine:
            for at, is_attribute in shape.places.get(cell, ()):
                if not is_attribute:
                    hit = owner[filled] == at
                    put(cell, keys[filled[hit]] + 3, doc[filled[hit]], fa[hit], fb[hit])

        # Attributes: key="value" after single spaces.
        tagged = np.flatnonzero(shape.attributed[node] & ~ends & (until < stop))
        if len(tagged):
            k = quotes[tagged] // 2
            flat = np.repeat(np.searchsorted(dq, lt[tagged]) - 2 * (np.cumsum(k) - k), k) + 2 * np.arange(int(k.sum()))
            token = np.repeat(tagged, k)
            open_, close = dq[flat], dq[flat + 1]
            leading = np.ones(len(token), bool)
            leading[1:] = token[1:] != token[:-1]
            before = np.where(leading, until[token], np.concatenate([[0], close[:-1] + 1]))
            ka, kb = before + 1, open_ - 1
            trailing = np.append(leading[1:], True)
            wrong = (data[kb] != 0x3D) | ~_SPACE[data[before]] | (ka >= kb) | trailing & (close + 1 != stop[token])
            parting = data == 0x3D
            parting[space[:-1]] = True
            parting = np.flatnonzero(parting)
            wrong |= np.searchsorted(parting, kb) != np.searchsorted(parting, ka)
            bad[doc[token[wrong]]] = True
            bad[doc[tagged[k == 0]]] = True
            keep = ~bad[doc[token]]
            token, ka, kb, open_, close = token[keep], ka[keep], kb[keep], open_[keep], close[keep]
            raw = name_hashes(data, ka, kb - ka)
            if self.twice and len(token):
                order = np.lexsort((raw, token))
                again = (raw[order][1:] == raw[order][:-1]) & (token[order][1:] == token[order][:-1])
                bad[doc[token[order[1:][again]]]] = True
            if self.strip:
                at = colon[np.searchsorted(colon, ka)]
                some = np.flatnonzero(at < kb)
                raw[some] = name_hashes(data, at[some] + 1, kb[some] - at[some] - 1)
            to = shape.attributes.follow(node[token], raw)
            hit = np.flatnonzero(to >= 0)
            va, vb = open_[hit] + 1, close[hit]
            turned = low[_TURNED[data[low]]]
            within = lambda x: np.searchsorted(x, vb) != np.searchsorted(x, va) if len(x) else np.zeros(len(va), bool)
            odd = np.flatnonzero(within(turned) | within(every_amp))

            va, vb = replaced(va, vb, odd, _normalised)
            for cell in mine:
                for at, is_attribute in shape.places.get(cell, ()):
                    if is_attribute:
                        own_ = to[hit] == at
                        put(cell, keys[token[hit[own_]]] + 1, doc[token[hit[own_]]], va[own_], vb[own_])
            # Other tables' repeated attributes concatenate without error; this table's are seen below.

        if more:
            data = np.concatenate([data, np.frombuffer(b"".join(more), np.uint8)])
        placed = {}
        for cell, found in values.items():
            row_keys = closes_of(mine[cell].index)
            key, whose, a, b = (np.concatenate(x) for x in zip(*found, strict=True))
            row = np.searchsorted(row_keys, key)
            inside = row < len(row_keys)
            inside[inside] = doc[row_keys[row[inside]] >> 2] == whose[inside]
            row, a, b, whose = row[inside], a[inside], b[inside], whose[inside]
            order = np.argsort(row, kind="stable")
            row, a, b, whose = row[order], a[order], b[order], whose[order]
            bad[whose[1:][row[1:] == row[:-1]]] = True  # several pieces of one value
            placed[cell] = row, a, b

        made: dict[int, Rows] = {}
        for plan in self.plans:
            row_keys = closes_of(plan.index)
            whose = doc[row_keys >> 2]
            keep = ~bad[whose]
            number = np.cumsum(keep) - 1
            row_keys, whose, total = row_keys[keep], whose[keep], int(keep.sum())
            if not total:
                continue
            levels = []
            for table in plan.chain[: plan.levels]:
                opened = keys[(shape.table[node] == table) & ~ends]
                done = closes_of(table)
                at = opened[np.searchsorted(opened, row_keys) - 1]
                levels.append(np.searchsorted(done, row_keys) - np.searchsorted(done, at))
            cells = []
            for cell in range(plan.first, plan.end):
                row, a, b = placed.get(cell, (np.zeros(0, int),) * 3)
                ok = keep[row]
                cells.append(self._array(data, number[row[ok]], a[ok], b[ok], total))
            heads = np.flatnonzero(np.concatenate([[True], whose[1:] != whose[:-1]]))
            position = np.arange(total) - np.repeat(heads, np.diff(np.append(heads, total)))
            made[plan.index] = Rows(whose, position, levels, cells)
        return made, bad

    @staticmethod
    def _array(data: np.ndarray, row: np.ndarray, a: np.ndarray, b: np.ndarray, n: int) -> pa.Array:
        """A binary column with the given spans in some rows and null in the others."""
        size = np.zeros(n, np.int64)
        size[row] = b - a
        offsets = np.concatenate([[0], np.cumsum(size)])
        place = np.repeat(a - offsets[row], b - a) + np.arange(int(offsets[-1]))
        valid = np.zeros(n, bool)
        valid[row] = True
        mask = None if len(row) == n else pa.py_buffer(np.packbits(valid, bitorder="little").tobytes())
        return pa.Array.from_buffers(pa.binary(), n, [mask, pa.py_buffer(offsets.astype(np.int32).tobytes()), pa.py_buffer(data[place].tobytes())])
