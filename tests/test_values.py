"""Value capture, references, attributes, conversions, faults."""

import math

import pytest

from arborel.errors import MissingValue, SyntaxFault, ValueFault

from .shredding import number, one, text


@pytest.mark.parametrize(
    ("inside", "value"),
    [
        ("<v>a<!-- no -->b</v>", "ab"),
        ("<v>a<![CDATA[<&>]]>b</v>", "a<&>b"),
        ("<v><![CDATA[a < b <x> ]] ]]></v>", "a < b <x> ]] "),
        ("<v>Before <c>inner</c> After</v>", "Before  After"),
        ("<v>&lt;&amp;&gt;&quot;&apos;&#66;&#x41;&#x1F600;</v>", "<&>\"'BA\U0001f600"),
        ("<v> \t\r\n</v>", " \t\r\n"),
        ("<v></v>", None),
        ("<v/>", None),
        ("<v><![CDATA[]]></v>", ""),
        ("<v><?pi x?>é日</v>", "é日"),
        ("", None),
    ],
)
def test_text(inside, value):
    assert one(f"<d><r>{inside}</r></d>", text()) == [(value,)]


@pytest.mark.parametrize(("raw", "value"), [("", ""), ("  a  ", "  a  "), ("a\tb\nc\r\nd", "a b c d"), ("&#9;&#10;x", "\t\nx"), ("&lt;&amp;", "<&"), ("it's > 1", "it's > 1")])
def test_attributes(raw, value):
    assert one(f'<d><r v="{raw}"/></d>', text(path="/d/r/@v")) == [(value,)]
    if "'" not in raw:
        assert one(f"<d><r v = '{raw}'></r></d>", text(path="/d/r/@v")) == [(value,)]


def test_attribute_checks():
    with pytest.raises(SyntaxFault):
        one('<d><r v="1" v="2"/></d>', text(path="/d/r/@v"))
    assert one('<d><r v="1" v="2"/></d>', text(path="/d/r/@v"), validate_attributes=False) == [("12",)]
    assert one('<d><x a="1" a="2"/><r><v>1</v></r></d>', text()) == [("1",)]  # not looked at
    assert one('<d><r><t u="C"/><t u="F"/></r></d>', text(path="/d/r/t/@u")) == [("CF",)]
    with pytest.raises(SyntaxFault):
        one("<d><r v=1/></d>", text(path="/d/r/@v"))
    with pytest.raises(SyntaxFault):
        one('<d><r v="&nope;"/></d>', text(path="/d/r/@v"))


def test_faults_of_references():
    with pytest.raises(ValueFault) as e:
        one("<d><r><v>&nbsp;</v></r></d>", text())
    assert e.value.kind == "unresolved entity" and e.value.field == "v"
    assert one("<d><r>&nbsp;<v>1</v><x>&nbsp;</x></r></d>", text()) == [("1",)]
    for bad in ("&#xZZ;", "&#;", "&#0;", "&#x110000;"):
        with pytest.raises(SyntaxFault):
            one(f"<d><r><v>{bad}</v></r></d>", text())


def test_repeated_values():
    with pytest.raises(ValueFault) as e:
        one("<d><r><v>1</v><v/></r></d>", text())
    assert e.value.kind == "duplicate value"
    assert one("<d><r><v></v><v>2</v></r></d>", text()) == [("2",)]


def test_trim_text():
    assert one("<d><r><v>\n a b \t</v></r></d>", text(), trim_text=True) == [("a b",)]
    assert one('<d><r v=" a "/></d>', text(path="/d/r/@v"), trim_text=True) == [(" a ",)]
    assert one("<d><r><v>  </v></r></d>", text(), trim_text=True) == [(None,)]


def test_closing_tags():
    with pytest.raises(SyntaxFault):
        one("<d><r><v>1</w></r></d>", text())
    assert one("<d><r><v>1</w></r></d>", text(), validate_closing_tags=False) == [("1",)]
    assert one("<d><r><v>1</v ></r ></d>", text()) == [("1",)]
    for broken in ("<d><r", "<d><r a='x>", "<d><!-- x", "<d></d", "</d>"):
        with pytest.raises(SyntaxFault):
            one(broken, text())


def test_tolerated_input():
    row = "<d><r><v>1</v></r></d>"
    for xml in (b"\xef\xbb\xbf" + row.encode(), f' \n<?xml version="1.0"?>{row}<!-- end -->', f"<!DOCTYPE d [<!ELEMENT d (r)> <!ENTITY x 'y'>]>{row}"):
        assert one(xml, text()) == [("1",)]


@pytest.mark.parametrize("word", ["true", "YES", "y", "T", " on\n", "1"])
def test_true(word):
    assert one(f"<d><r><v>{word}</v></r></d>", number(kind="Boolean")) == [(True,)]


@pytest.mark.parametrize(
    ("kind", "raw", "value"),
    [
        *[(f"Int{b}", str(s * 2 ** (b - 1) - (s > 0)), s * 2 ** (b - 1) - (s > 0)) for b in (8, 16, 32, 64) for s in (-1, 1)],
        *[(f"UInt{b}", str(2**b - 1), 2**b - 1) for b in (8, 16, 32, 64)],
        ("Int32", " \t+42\n", 42),
        ("Float64", "1e-3", 0.001),
        ("Float64", ".5", 0.5),
        ("Float64", "1e999", math.inf),
        ("Float64", "-inf", -math.inf),
        ("Float32", "0.1", 0.10000000149011612),
    ],
)
def test_numbers(kind, raw, value):
    assert one(f"<d><r><v>{raw}</v></r></d>", number(kind=kind)) == [(value,)]


@pytest.mark.parametrize(("kind", "raw"), [("Int32", x) for x in ("3x", "30 units", "1.5", "1 2", "2147483648", "+", "-", "1_0", "٣")] + [("UInt8", "-1"), ("UInt8", "256"), ("UInt64", "18446744073709551616"), ("Float64", "1d"), ("Float64", "0x1p3"), ("Float64", "1,5"), ("Boolean", "maybe")])
def test_wrong_values(kind, raw):
    with pytest.raises(ValueFault) as e:
        one(f"<d><r><v>{raw} </v></r></d>", number(kind=kind))
    assert e.value.value == raw + " "


@pytest.mark.parametrize("kind", ["Boolean", "Int8", "UInt64", "Float32"])
@pytest.mark.parametrize("inside", ["", "<v/>", "<v> \n</v>"])
def test_missing(kind, inside):
    with pytest.raises(MissingValue):
        one(f"<d><r>{inside}</r></d>", number(kind=kind))
    assert one(f"<d><r>{inside}</r></d>", number(kind=kind, nullable=True)) == [(None,)]


def test_missing_text_is_empty_unless_nullable():
    assert one("<d><r/></d>", text(nullable=False)) == [("",)]
    assert one("<d><r/></d>", text()) == [(None,)]


def test_scale_and_offset():
    assert one("<d><r><v>2</v></r></d>", number(kind="Float64", scale=0.1, offset=10.0)) == [(2 * 0.1 + 10.0,)]
    assert one("<d><r><v>1e308</v></r></d>", number(kind="Float64", scale=100.0)) == [(math.inf,)]
    assert one("<d><r/></d>", number(kind="Float32", nullable=True, scale=2.0, offset=1.0)) == [(None,)]


def test_long_documents_are_cut_at_any_place():
    rows = "".join(f"<r a='{'<' * (i % 3)}>{i}'><!-- <x> --><v>{i}</v></r>" for i in range(60_000))
    assert one(f"<d>{rows}</d>", number()) == [(i,) for i in range(60_000)]


def test_many_attributes_and_deep_nesting():
    attributes = " ".join(f'a{i}="{i}"' for i in range(20_000))
    assert one(f"<d><r {attributes} v='7'/></d>", text(path="/d/r/@v")) == [("7",)]
    assert one("<d><r>" + "<x>" * 20_000 + "</x>" * 20_000 + "<v>1</v></r></d>", text()) == [("1",)]
