"""Paths, table stack, row delimiting, levels, stop paths."""

import pytest

from arborel import Field, Mapping, Options, Table
from arborel.errors import LevelFault
from arborel.plans.program import compile_mapping

from .shredding import number, one, shred, text


@pytest.mark.parametrize("path", ["/d", "d", "d/", "//d//"])
def test_slashes_mean_nothing(path):
    assert one("<d><r><v>1</v></r></d>", number(), path=path) == [(1,)]


def test_levels_restart_in_each_instance():
    xml = "<d>" + "".join(f"<g><i><x><v>{a}</v></x>" + f"<x><v>{b}</v></x></i></g>" for a, b in ((1, 2), (3, 4))) + "</d>"
    m = Mapping([Table("g", "/d", ["g"], []), Table("x", "/d/g/i", ["g", "x"], [Field("v", "/d/g/i/x/v", "Int32")])])
    assert shred(xml, m) == {"x": [((0, 0), (1,)), ((0, 1), (2,)), ((1, 0), (3,)), ((1, 1), (4,))]}


def test_four_levels():
    xml = "<r><a><b><c><d>1</d><d>2</d></c><c><d>3</d></c></b><b><c><d>4</d></c></b></a><a><b><c><d>5</d></c></b></a></r>"
    paths = ["/r", "/r/a", "/r/a/b", "/r/a/b/c"]
    tables = [Table(f"t{i}", p, [f"l{j}" for j in range(i + 1)], []) for i, p in enumerate(paths[:3])]
    tables.append(Table("d", paths[3], ["l0", "l1", "l2", "l3"], [Field("d", "/r/a/b/c/d", "Int32")]))
    assert [levels for levels, _ in shred(xml, Mapping(tables))["d"]] == [(0, 0, 0, 0), (0, 0, 0, 1), (0, 0, 1, 0), (0, 1, 0, 0), (1, 0, 0, 0)]


def test_siblings_share_a_parent():
    xml = "<d><g><i><x>1</x><x>2</x></i><t><y>a</y></t></g><g><i><x>3</x></i><t><y>b</y><y>c</y></t></g></d>"
    m = Mapping([Table("g", "/d", ["g"], []), Table("x", "/d/g/i", ["g", "x"], [Field("x", "/d/g/i/x", "Int32")]), Table("y", "/d/g/t", ["g", "y"], [Field("y", "/d/g/t/y")])])
    made = shred(xml, m)
    assert [k for k, _ in made["x"]] == [(0, 0), (0, 1), (1, 0)]
    assert [k for k, _ in made["y"]] == [(0, 0), (1, 0), (1, 1)]


def test_unknown_children_end_no_row_but_known_ones_do():
    assert one("<d><x/><r><v>1</v><y>z</y></r><x><v>9</v></x></d>", number()) == [(1,)]
    fields = [text("a", "/d/a"), text("b", "/d/b")]
    assert one("<d><a>1</a><b>2</b><a>3</a></d>", *fields) == [("1", None), (None, "2"), ("3", None)]


def test_self_closing_rows():
    assert one('<d><r v="1"/><r v="2"/></d>', number(path="/d/r/@v")) == [(1,), (2,)]


def test_root_table():
    assert one("<d><h><v>x</v></h></d>", text(path="/d/h/v"), path="/") == [("x",)]
    assert one("<d><v>x</v></d><d><v>y</v></d>", text(path="/d/v"), path="/") == [("x",), ("y",)]
    m = Mapping([Table("root", "/", [], []), Table("t", "/d", ["r"], [number()])])
    assert shred("<d><r><v>1</v></r></d>", m) == {"t": [((0,), (1,))]}


def test_empty_tables_are_there_and_columnless_ones_not():
    m = Mapping([Table("a", "/d", [], []), Table("t", "/d/e", [], [number(path="/d/e/r/v")])])
    assert shred("<d/>", m) == {"t": []}
    assert shred("", m) == {"t": []}
    assert shred("  \n ", m) == {"t": []}


def test_attributes_of_a_table_element_are_its_own():
    m = Mapping([Table("o", "/d", ["o"], [text("id", "/d/g/@id")]), Table("t", "/d/g", ["o", "r"], [text(path="/d/g/r/v")])])
    made = shred('<d><g id="7"><r><v>x</v></r></g></d>', m)
    assert made["o"] == [((0,), (None,))] and made["t"] == [((0, 0), ("x",))]
    assert any("never filled" in w for w in compile_mapping(m).warnings)


def test_own_text_joins_the_next_row():
    fields = [text("a", "/d/g/@a"), text("own", "/d/g")]
    assert one('<d><g a="1">x<r/>y<r/>z</g><g a="2"><r/></g></d>', *fields, text("v", "/d/g/r/v"), path="/d/g") == [("1", "x", None), (None, "y", None), ("2", "z", None)]


def test_fewer_levels_keep_the_outer_and_more_are_an_error():
    xml = "<d><g><r><v>1</v></r></g></d>"
    outer = Table("o", "/d", ["o"], [])
    assert shred(xml, Mapping([outer, Table("t", "/d/g", ["o"], [number(path="/d/g/r/v")])]))["t"] == [((0,), (1,))]
    deep = Mapping([outer, Table("t", "/d/g", ["o", "r", "z"], [number(path="/d/g/r/v")])])
    with pytest.raises(LevelFault):
        shred(xml, deep)
    assert shred("<d/>", deep) == {"t": []}


def test_stop_paths():
    m = Mapping([Table("h", "/d", [], [text("t", "/d/h/t")]), Table("b", "/d/b", [], [number(path="/d/b/r/v")])], Options(stop_at_paths=["/d/h", "/d/b"]))
    assert shred("<d><h><t>x</t></h><b><r><v>1</v></r></b></wrong>", m) == {"h": [((), ("x",))], "b": []}
    m = Mapping([Table("t", "/", [], [text("t", "/d/h/t")])], Options(stop_at_paths=["/d/h"]))
    assert shred("<d><h><t>x</t></h></d>", m) == {"t": []}  # the row in progress is lost


def test_no_row_at_the_end_of_an_unfinished_document():
    assert one("<d><r><v>1</v></r><r><v>2", number()) == [(1,)]


def test_one_node_feeds_several_fields():
    assert one("<d><r><v>1</v></r></d>", number("a"), text("b"), number("c", kind="Float64")) == [(1, "1", 1.0)]


def test_namespaces():
    xml = '<a:d xmlns:a="u"><a:r b:k="1"><a:v>1</a:v><b:v>2</b:v></a:r></a:d>'
    assert one(xml, text("k", "/d/r/@k"), text("ns", "/d/@a"), path="/d") [0][0] == "1"
    assert one(xml, text("v", "/a:d/a:r/a:v"), path="/a:d", strip_namespaces=False) == [("1",)]
    assert one('<d><r a:id="1" b:id="2"/></d>', text("id", "/d/r/@id")) == [("12",)]


def test_state_does_not_leak_between_documents():
    m = Mapping([Table("t", "/d", ["r"], [text()])])
    assert shred("<d>x<r>", m) == {"t": []}
    assert shred("<d><r><v>1</v></r></d>", m) == {"t": [((0,), ("1",))]}
