"""Array shredding against the fold: equal rows where it answers, and it answers where it should."""

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from arborel import Field, Mapping, Options, Table
from arborel.errors import ShredError
from arborel.operators.columns import Columns, simplified
from arborel.operators.fold import Fold
from arborel.plans.program import compile_mapping

MAPPINGS = [
    Mapping([Table("g", "/d", ["g"], []), Table("r", "/d/g", ["g", "r"], [Field("a", "/d/g/r/a"), Field("k", "/d/g/r/@k"), Field("b", "/d/g/r/a/@b")])]),
    Mapping([Table("d", "/d", ["x", "y"][:1], [Field("a", "/d/g/a"), Field("own", "/d/g"), Field("k", "/d/g/@k"), Field("b", "/d/g/b/@k")]), Table("g", "/d/g", ["x", "y"], [Field("v", "/d/g/r"), Field("w", "/d/g/r/a"), Field("o", "/d/g/@b")])]),
    Mapping([Table("root", "/", [], [Field("a", "/d/a"), Field("k", "/d/@k"), Field("deep", "/d/g/r/a")]), Table("r", "/d/g", [], [Field("k", "/d/g/r/@k")])], Options(validate_attributes=False, validate_closing_tags=False)),
    Mapping([Table("r", "/x:d/g", ["r"], [Field("k", "/x:d/g/r/@x:k"), Field("a", "/x:d/g/x:a")])], Options(strip_namespaces=False)),
]


def by_fold(mapping, table, documents):
    program = compile_mapping(mapping)
    rows, faults = [], set()
    for i, d in enumerate(documents):
        own = []
        try:
            Fold(program, {table}, lambda t, pos, levels, cells, own=own, i=i: own.append((i, pos, tuple(levels), tuple(cells)))).run(d)
            rows += own
        except ShredError:
            faults.add(i)
    return rows, faults


def by_columns(mapping, table, documents):
    program = compile_mapping(mapping)
    data = np.frombuffer(b"".join(documents), np.uint8)
    rows, left = Columns(program, [program.plans[table]]).run(data, np.cumsum([0] + [len(d) for d in documents]))
    rows = rows.get(table)
    if rows is None:
        return [], set(np.flatnonzero(left).tolist())
    levels = list(zip(*(x.tolist() for x in rows.levels), strict=True)) or [()] * len(rows.doc)
    cells = list(zip(*(c.to_pylist() for c in rows.cells), strict=True))
    return list(zip(rows.doc.tolist(), rows.position.tolist(), levels, cells, strict=True)), set(np.flatnonzero(left).tolist())


MAPPINGS += [Mapping(MAPPINGS[1].tables, o) for o in (Options(trim_text=True), Options(stop_at_paths=["/d/g/r", "/d/b"]), Options(trim_text=True, stop_at_paths=["/d/g"], validate_attributes=False))]

names = st.sampled_from(["d", "g", "r", "a", "b", "x:a", "x:d", "an_element_name_beyond_thirty_two_bytes"])
texts = st.sampled_from(["", "", "t", " ", "a &amp; b", "&#65;", "&nope;", "é", "<!-- c -->", "<!--<a>&-->", "<![CDATA[x]]>", "<![CDATA[<&>]]>", "<![CDATA[]]>", "<?p i?>", "&", "amp;", " x ", " &lt; y ", ">", "'", '"', "\n", "x:y", "a=b"])
values = st.sampled_from(["", "v", " ", "a>b", "&lt;", "\t", "it's", "é", "a=b", "&bad;", "<!-- c -->", "x>y<!-- c -->"])
attributes = st.lists(st.tuples(st.sampled_from(["k", "b", "x:k", "long_attribute_name_here"]), values, st.sampled_from(['"', '"', '"', "'"]), st.sampled_from([" ", " ", " ", "  ", "\n"])), max_size=3)


def element(children):
    def made(parts):
        name, attrs, inside, alone = parts
        head = name + "".join(f"{s}{k}={q}{v}{q}" for k, v, q, s in attrs if q not in v)
        return f"<{head}/>" if alone and not inside else f"<{head}>" + "".join(inside) + f"</{name}>"

    return st.tuples(names, attributes, st.lists(children, max_size=4), st.booleans()).map(made)


trees = st.recursive(texts, element, max_leaves=12)
nested = st.lists(trees, max_size=4).map(lambda t: "<d><g>" + "".join(t) + "</g></d>")
documents = st.lists(st.one_of(nested, trees, st.sampled_from(["", " ", "<d>", "</d>", "<d><g></d></g>", "<?xml version='1.0'?>\n<d k=\"1\"><a>x</a></d>", "<d", "<d><>", "﻿<d><a>1</a></d>"])), min_size=1, max_size=6)


@settings(max_examples=400, deadline=None)
@given(documents, st.sampled_from(range(len(MAPPINGS))), st.integers(0, 1))
def test_agrees_with_the_fold(docs, which, table):
    mapping = MAPPINGS[which]
    plans = [p for p in compile_mapping(mapping).plans if p.end > p.first]
    table = plans[table % len(plans)].index
    raw = [d.encode() for d in docs]
    want, faults = by_fold(mapping, table, raw)
    got, left = by_columns(mapping, table, raw)
    assert faults <= left
    assert sorted(got) == sorted(r for r in want if r[0] not in left)


def test_plain_documents_do_not_need_the_fold():
    row = '<r k="1" b=""><a b="x:y &amp; z">a &lt; b</a></r>'
    docs = [f"<?xml version=\"1.0\"?>\n<d>\n <g>{row * n}</g>\n <g/><g>{row}</g></d>".encode() for n in range(20)]
    got, left = by_columns(MAPPINGS[0], 1, docs)
    assert not left and len(got) == sum(range(20)) + 20
    assert got == by_fold(MAPPINGS[0], 1, docs)[0]


@settings(max_examples=600, deadline=None)
@given(documents, st.sampled_from(range(len(MAPPINGS))), st.integers(0, 1))
def test_plain_forms_mean_the_same(docs, which, table):
    """Documents that are rewritten to plain form give the rows that the fold gives the original."""
    mapping = MAPPINGS[which]
    plans = [p for p in compile_mapping(mapping).plans if p.end > p.first]
    table = plans[table % len(plans)].index
    for raw in (d.encode() for d in docs):
        plain = simplified(raw, mapping.parser_options.trim_text)
        if plain is not None:
            got, left = by_columns(mapping, table, [plain])
            want, faults = by_fold(mapping, table, [raw])
            assert left or not faults and got == want


@pytest.mark.parametrize("options", [Options(), Options(trim_text=True), Options(stop_at_paths=["/d/g"])])
def test_usual_documents_do_not_need_the_fold(options):
    mapping = Mapping(MAPPINGS[0].tables, options)
    rows = "".join(f"<r k='{i}' b=\"2\"><a b='x'> a{i} </a></r>" for i in range(5)).replace('"', "'")
    odd = [] if options.trim_text else [f"<!DOCTYPE d><d><!-- <g> --><g>{rows}<?go on?><r><a><![CDATA[1 < 2 & 3]]></a></r></g></d>", "<d><g><r><a>x<!-- y -->z</a></r></g></d>"]
    docs = [d.encode() for d in (f"<?xml version='1.0'?><d><g>{rows}</g></d>", f"<d>\n <g>{rows}</g> <g>{rows}</g></d>", *odd)]
    got, left = by_columns(mapping, 1, [simplified(d, options.trim_text) or d for d in docs])
    assert not left and got == by_fold(mapping, 1, docs)[0]


@settings(max_examples=60, deadline=None)
@given(documents)
def test_tables_together_are_as_alone(docs):
    raw = [d.encode() for d in docs]
    program = compile_mapping(MAPPINGS[1])
    data, offsets = np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0] + [len(d) for d in raw])
    rows, left = Columns(program, program.plans).run(data, offsets)
    for t in (0, 1):
        alone, _ = by_columns(MAPPINGS[1], t, raw)
        found = rows.get(t)
        together = [] if found is None else list(zip(found.doc.tolist(), zip(*(c.to_pylist() for c in found.cells), strict=True), strict=True))
        assert together == [(d, c) for d, _, _, c in alone if d not in set(np.flatnonzero(left).tolist())]
