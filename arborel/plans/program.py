"""Compiling a mapping: everything about paths that no document can change."""

from __future__ import annotations

from dataclasses import dataclass, field

from .mapping import Mapping, Table, segments


class Node:
    """One known element or attribute."""

    __slots__ = ("name", "children", "attributes", "table", "row_of", "slots", "guard", "stop")

    def __init__(self, name: str):
        self.name = name
        self.children: dict[bytes, Node] = {}
        self.attributes: dict[bytes, Node] = {}
        self.table = -1  # the table that opens here
        self.row_of = -1  # the table of which a row ends when this element closes
        self.slots: tuple[int, ...] = ()  # cells that capture here
        self.guard: tuple[int, ...] = ()  # cells that must be empty on entry
        self.stop = False


@dataclass
class Plan:
    """What one table's rows need."""

    table: Table
    index: int
    first: int  # its cells are first to end of all cells
    end: int
    chain: tuple[int, ...]  # open tables around a row, outermost first, itself last
    levels: int  # level columns that rows can fill
    open: bool  # whether it is ever on the stack


@dataclass
class Program:
    mapping: Mapping
    root: Node
    plans: list[Plan]
    cells: int
    attributes: bool
    warnings: list[str] = field(default_factory=list)
    #: (field name, path) of each cell
    names: list[tuple[str, str]] = field(default_factory=list)


def compile_mapping(mapping: Mapping) -> Program:
    """Check the mapping, build its path tree and settle where each value goes."""
    mapping.check()
    root = Node("")

    def reach(path: tuple[str, ...]) -> list[Node]:
        way = [root]
        for step in path:
            place = way[-1].attributes if step.startswith("@") else way[-1].children
            key = step.removeprefix("@").encode() if step.startswith("@") else step.encode()
            way.append(place.setdefault(key, Node(step)))
        return way

    paths = [segments(t.xml_path) for t in mapping.tables]
    for i, path in enumerate(paths):
        node = reach(path)[-1]
        # Attributes never open a table; the root does only if it has fields.
        if not any(s.startswith("@") for s in path) and (path or mapping.tables[i].fields):
            node.table = i
    cells, plans, names, warnings = 0, [], [], []
    owners: dict[Node, list[tuple[int, int]]] = {}
    for i, (table, path) in enumerate(zip(mapping.tables, paths, strict=True)):
        first = cells
        for f in table.fields:
            owners.setdefault(reach(segments(f.xml_path))[-1], []).append((i, cells))
            names.append((f.name, f.xml_path))
            cells += 1
        way = reach(path)
        chain = tuple(n.table for n in way if n.table >= 0 and n is not root)
        plans.append(Plan(table, i, first, cells, chain, min(len(chain), len(table.levels)), way[-1].table == i))
    for stop in mapping.parser_options.stop_at_paths:
        reach(segments(stop))[-1].stop = True

    def settle(node: Node, innermost: int, parent: Node | None, attribute: bool) -> None:
        inside = innermost if attribute or node.table < 0 else node.table
        own = owners.get(node, [])
        node.slots = tuple(c for t, c in own if t == inside)
        for t, c in own:
            if t != inside:
                warnings.append(f"Field {names[c][0]!r} of table {mapping.tables[t].name!r} is never filled: another table is open at {names[c][1]}")
        if parent is not None and not attribute:
            node.row_of = parent.table
            node.guard = node.slots if node.table < 0 else ()
        for child in node.children.values():
            settle(child, inside, node, False)
        for child in node.attributes.values():
            settle(child, inside, node, True)

    settle(root, root.table, None, False)
    for plan, path in zip(plans, paths, strict=True):
        table, ends = plan.table, reach(path)[-1].children
        if len(table.levels) > len(plan.chain):
            warnings.append(f"Table {table.name!r} has {len(table.levels)} levels, its rows only {len(plan.chain)}: any row is an error")
        if not ends:
            warnings.append(f"Table {table.name!r} never has a row: no child of {table.xml_path!r} is known")
        elif len(ends) > 1 and table.fields:
            warnings.append(f"Table {table.name!r} has a row for each of several children: {', '.join(sorted(n.name for n in ends.values()))}")
    needs = any(s.startswith("@") for t in mapping.tables for f in t.fields for s in segments(f.xml_path))
    return Program(mapping, root, plans, cells, needs, warnings, names)
