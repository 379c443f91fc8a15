"""The engine on Spark: conversions against their plain twins, documents, files, streams, sources."""

import json

import pyarrow as pa
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F, types as T

from arborel import Field, Mapping, Shredder, Table, relinked, shred_files, shred_text
from arborel.errors import EncodingFault, MissingValue, ShredError, ValueFault, recovered
from arborel.functions.convert import converted
from arborel.functions.plain import convert
from arborel.functions.quick import quick, typed
from arborel.plans.mapping import TYPES

from .shredding import number, shred, text

STATIONS = """<report><header><title>T</title></header><stations>
<s id="A"><lat>-61.5</lat><ms><m><t>1</t><k>10.5</k></m><m><t>2</t><k>11.5</k></m></ms></s>
<s id="B"><lat>11.25</lat><ms><m><t>3</t><k>1.0</k></m></ms></s></stations></report>"""
MAPPING = Mapping(
    [
        Table("report", "/", [], [Field("title", "/report/header/title")]),
        Table("stations", "/report/stations", ["station"], [Field("id", "/report/stations/s/@id"), Field("lat", "/report/stations/s/lat", "Float32")]),
        Table("measures", "/report/stations/s/ms", ["station", "measure"], [Field("t", "/report/stations/s/ms/m/t"), Field("k", "/report/stations/s/ms/m/k", "Float64", offset=273.15)]),
    ]
)


def test_stations(spark):
    made = shred_text(spark, STATIONS, MAPPING)
    assert list(made) == ["report", "stations", "measures"]
    assert made["report"].collect() == [("T",)]
    assert sorted(made["stations"].collect()) == [(0, "A", -61.5), (1, "B", 11.25)]
    both = relinked(made["measures"], made["stations"], ["station"])
    means = both.groupBy("id").agg(F.avg("k").alias("k"), F.count("*").alias("n")).orderBy("id").collect()
    assert [(r.id, r.n, round(r.k, 6)) for r in means] == [("A", 2, 284.15), ("B", 1, 274.15)]
    assert made["measures"].schema == MAPPING.table("measures").schema()


def test_schema_keeps_nullability(spark):
    fields = [Field(f"{k}{n}", f"/d/r/{k}", k, n) for k in TYPES for n in (False, True)]
    engine = Shredder(Mapping([Table("t", "/d", ["r"], fields)]))
    made = engine.table(spark.createDataFrame([], "content string"), "t")
    assert {f.name: (f.dataType, f.nullable) for f in made.schema if not f.name.startswith("Utf8False")} == {f.name: (f.dataType, f.nullable) for f in engine.mapping.tables[0].schema() if not f.name.startswith("Utf8False")}


RAW = [None, "", " ", " \t\n", "0", "1", "-1", "+7", "127", "128", "-128", "255", "256", "65535", "65536", "2147483647", "2147483648", "4294967296", "9223372036854775807", "9223372036854775808", "18446744073709551615", "18446744073709551616", "1.5", ".5", "5.", "1e3", "1E-400", "1e400", "inf", "-Infinity", "NaN", "1d", "0x10", "1e", "+", "-", "true", "OFF", "y", "maybe", "\x0b1", " 1 ", "00012", "٣", "on ", "1_000", "\x7f1", "0X1P3", "1f", "-0", "--1", "1 1", ".", "-.5e-1"]


@pytest.mark.parametrize("kind", list(TYPES))
@pytest.mark.parametrize("nullable", [True, False])
def test_conversions_agree(spark, kind, nullable):
    field = Field("v", "/v", kind, nullable, 0.5 if kind.startswith("Float") else None, 1.0 if kind.startswith("Float") else None)
    fine, wrong = [], []
    for raw in RAW:
        try:
            fine.append((raw, convert(field, raw)))
        except ValueFault as e:
            wrong.append((raw, type(e)))
    rows = spark.createDataFrame([(r,) for r, _ in fine], "raw string").coalesce(1)
    got = [r[0] for r in rows.select(converted(field, F.col("raw")).alias("v")).collect()]
    assert [str(x) for x in got] == [str(v) for _, v in fine]
    assert [str(x) for x in typed(field, pa.array([r for r, _ in fine], pa.string()))] == [str(v) for _, v in fine]
    for raw, error in wrong:
        with pytest.raises(error) as e:
            typed(field, pa.array([raw, raw], pa.string()))
        assert e.value.field == "v" and e.value.row == 0
    for raw, error in wrong[:: max(1, len(wrong) // 4)]:
        with pytest.raises(Exception) as e:  # noqa: PT011
            spark.createDataFrame([(raw,)], "raw string").select(converted(field, F.col("raw"))).collect()
        found = recovered(e.value)
        assert type(found) is error and found.field == "v"


@settings(max_examples=300, deadline=None)
@given(st.sampled_from([k for k in TYPES if k != "Utf8"]), st.lists(st.one_of(st.sampled_from(RAW), st.integers(-300, 70_000).map(str), st.floats().map(str), st.text(" +-.0123456789eExXinfa(", max_size=6)), max_size=8))
def test_usual_spellings_agree(kind, texts):
    """What is converted a column at a time has the value that the plain conversion gives; all else is left as it is."""
    field = Field("v", "/v", kind, True, 0.5 if kind.startswith("Float") else None, 1.0 if kind.startswith("Float") else None)
    values, rest = (x.to_pylist() for x in quick(field, pa.array(texts, pa.string())))
    for raw, value, left in zip(texts, values, rest, strict=True):
        if value is None:
            assert left == raw
        else:
            assert left is None and str(convert(field, raw)) == str(value)
    plain = [t for t in texts if t is not None and t.isascii() and t.isdigit() and len(t) < 3]
    assert quick(field, pa.array(plain, pa.string()))[0].null_count == 0 or kind == "Boolean"


@settings(max_examples=40, deadline=None)
@given(st.lists(st.lists(st.tuples(st.sampled_from("abx"), st.text("ab& <\n", max_size=4)), max_size=5), max_size=4))
def test_random_documents_against_a_tree(spark, groups):
    """Rows and levels as a tree walk with another parser gives them."""
    import xml.etree.ElementTree as ET

    root = ET.Element("d")
    for g in groups:
        node = ET.SubElement(root, "g")
        for tag, said in g:
            ET.SubElement(ET.SubElement(node, "r"), tag).text = said
    data = ET.tostring(root)
    m = Mapping([Table("g", "/d", ["g"], []), Table("r", "/d/g", ["g", "r"], [text("a", "/d/g/r/a"), text("b", "/d/g/r/b")])])
    want = [((i, j), tuple((r.find(x).text or None) if r.find(x) is not None else None for x in "ab")) for i, g in enumerate(ET.fromstring(data)) for j, r in enumerate(g)]
    assert shred(data, m)["r"] == want


def test_many_documents_and_keys(spark):
    docs = spark.createDataFrame([(i, f"<d>{''.join(f'<r><v>{i * 10 + k}</v></r>' for k in range(i % 4))}</d>") for i in range(50)] + [(99, None), (98, "")], "id long, content string").repartition(5)
    made = Shredder(Mapping([Table("t", "/d", ["r"], [number()])])).table(docs, "t", keys=["id"], position=True)
    assert sorted(map(tuple, made.collect())) == [(i, k, k, i * 10 + k) for i in range(50) for k in range(i % 4)]


def test_clashing_and_odd_columns(spark):
    docs = spark.createDataFrame([("x", "<d><r><v>1</v></r></d>", 5)], ["_f0 a", "my.xml", "v"])
    made = Shredder(Mapping([Table("t", "/d", ["r"], [number()])])).table(docs, "t", content="my.xml", keys=["_f0 a"])
    assert made.collect() == [("x", 0, 1)]


def test_check_raises_structured_errors(spark):
    engine = Shredder(Mapping([Table("t", "/d", [], [number()])]))
    one = lambda xml: spark.createDataFrame([(7, xml)], "id long, content string")
    engine.check(one("<d><r><v>1</v></r></d>"))
    with pytest.raises(ValueFault) as e:
        engine.check(one("<d><r><v>3x</v></r></d>"), keys=["id"])
    assert e.value.value == "3x" and e.value.document_id == "7" and json.dumps(e.value.facts)
    with pytest.raises(MissingValue):
        engine.check(one("<d><r/></d>"))
    with pytest.raises(ShredError):
        engine.check(one("<d><r></d>"))


def test_invalid_utf8(spark):
    docs = spark.createDataFrame([(bytearray(b"<d><r><v>\xff</v><x>\xff</x></r></d>"),)], "content binary")
    with pytest.raises(EncodingFault):
        Shredder(Mapping([Table("t", "/d", [], [text()])])).check(docs)
    Shredder(Mapping([Table("t", "/d", [], [text("y", "/d/r/y")])])).check(docs)


def test_files_source_and_stream(spark, tmp_path):
    from arborel.sources.datasource import register
    from arborel.streaming.stream import read_stream, shred_stream

    (tmp_path / "in").mkdir()
    for i in range(3):
        (tmp_path / "in" / f"{i}.xml").write_text(f"﻿<d><r><v>{i}</v></r></d>")
    mapping = Mapping([Table("t", "/d", ["r"], [number()])])
    made = shred_files(spark, str(tmp_path / "in"), mapping)["t"]
    assert sorted(r.v for r in made.collect()) == [0, 1, 2] and made.columns[0] == "path"
    register(spark)
    for path in (str(tmp_path / "in"), str(tmp_path / "in" / "*.xml")):
        frame = spark.read.format("arborel_xml").option("mapping", mapping.to_yaml_text()).load(path)
        assert sorted(map(tuple, frame.collect())) == [(0, 0), (0, 1), (0, 2)]
    stream = shred_stream(read_stream(spark, str(tmp_path / "in"), files_per_trigger=1), mapping, "t")
    stream.writeStream.format("memory").queryName("shredded").trigger(availableNow=True).start().awaitTermination()
    assert sorted(r.v for r in spark.table("shredded").collect()) == [0, 1, 2]


def test_plan_is_one_narrow_pass(spark):
    made = Shredder(MAPPING).table(spark.createDataFrame([(STATIONS,)], "content string"), "measures").select("t")
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "try_cast" not in plan and "MapInArrow" in plan
    assert isinstance(made.schema["t"].dataType, T.StringType)


def test_one_pass_for_all_tables(spark, tmp_path):
    engine = Shredder(MAPPING)
    odd = STATIONS.replace("<lat>", "<!-- north --><lat>")
    docs = spark.createDataFrame([(1, STATIONS), (2, odd), (3, "<report/>")], "id long, content string").repartition(2)
    engine.write_raw(docs, f"{tmp_path}/raw", keys=["id"])
    made = engine.stored(spark, f"{tmp_path}/raw", keys=["id"], position=True)
    assert list(made) == engine.names
    none = engine.write_raw(docs.where("id > 3"), f"{tmp_path}/none", keys=["id"])
    assert [f.count() for f in none.values()] == [0, 0, 0]
    for name, frame in made.items():
        alone = engine.table(docs, name, keys=["id"])
        assert sorted(map(repr, map(tuple, frame.drop("_pos").collect()))) == sorted(map(repr, map(tuple, alone.collect())))
