import pytest

from arborel import Field, FieldBuilder, Mapping, Options, Table
from arborel.catalog import _INVALID
from arborel.errors import InvalidMapping, MappingFault, ShredError, UnsupportedTransform, recovered

YAML = """
tables:
  - name: no
    xml_path: /a
    levels: [on]
    extra: ignored
    fields:
      - name: 2024-01-01
        xml_path: /a/b
        data_type: Float64
        scale: 1e-9
        offset: 3
        other: x
parser_options: {trim_text: true, stop_at_paths: [/a/c], unknown: 1}
"""


def test_yaml_scalars_and_unknown_keys():
    m = Mapping.from_yaml_text(YAML)
    f = m.tables[0].fields[0]
    assert (m.tables[0].name, m.tables[0].levels, f.name, f.scale, f.offset) == ("no", ("on",), "2024-01-01", 1e-9, 3.0)
    assert m.parser_options == Options(trim_text=True, stop_at_paths=["/a/c"])


def test_round_trip(tmp_path):
    m = Mapping([Table("yes", "/", ["a", "null"], [Field("1", "/x/@y", "UInt64", True), Field("f", "/x/é", "Float32", scale=0.5, offset=-1.0)])], Options(True, ["/x"], False, False, False))
    m.to_yaml_file(tmp_path / "m.yaml")
    assert Mapping.from_yaml_file(tmp_path / "m.yaml") == m
    assert Mapping.from_yaml_text("tables: []") == Mapping()
    with pytest.raises(OSError):
        m.to_yaml_file(tmp_path / "none" / "m.yaml")
    with pytest.raises(OSError):
        Mapping.from_yaml_file(tmp_path / "none.yaml")


@pytest.mark.parametrize("text", ["tables: [", "a: 1", "tables: {}", "tables: [{name: x, xml_path: /, fields: []}]", "tables: [{name: 1, xml_path: /, levels: [], fields: []}]", "tables: [{name: t, xml_path: /, levels: [], fields: [{name: f, xml_path: /f, data_type: Date}]}]"])
def test_unreadable(text):
    with pytest.raises(MappingFault):
        Mapping.from_yaml_text(text)


@pytest.mark.parametrize("issue", list(_INVALID))
def test_contradictions(issue):
    tables = [Table(**({"name": "t", "xml_path": "/a", "levels": [], "fields": []} | t)) for t in _INVALID[issue]]
    with pytest.raises((InvalidMapping, UnsupportedTransform)) as e:
        Mapping(tables).check()
    assert issue in (e.value.facts.get("issue"), e.value.facts.get("transform"))


def test_accepted_paths():
    Mapping([Table("t", "/a", [], [Field("own", "/a"), Field("x", "a/b/")]), Table("r", "/", [], [Field("y", "/z")])]).check()


def test_builder():
    assert FieldBuilder("f", "/a", "Float32").nullable().scaled(2).shifted(1).build() == Field("f", "/a", "Float32", True, 2.0, 1.0)
    with pytest.raises(UnsupportedTransform):
        FieldBuilder("f", "/a", "Int8").shifted(1).build()


def test_errors_travel_as_text():
    e = InvalidMapping("Two tables share", issue="x", name="t")
    back = recovered(RuntimeError(f"An exception was thrown:\n{e}\n\tat somewhere"))
    assert isinstance(back, InvalidMapping) and back.name == "t" and back.__cause__ is not None
    assert recovered(ValueError("x")).args == ("x",) and issubclass(InvalidMapping, ShredError)
