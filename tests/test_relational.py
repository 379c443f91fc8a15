"""The fold against the relational formulation, on random plain documents."""

import random

from arborel import Field, Mapping, Shredder, Table
from arborel.operators.relational import shred_by_windows

MAPPINGS = [
    Mapping([Table("g", "/d", ["g"], [Field("k", "/d/g/@k", "Utf8", True)]), Table("r", "/d/g", ["g", "r"], [Field("a", "/d/g/r/a", "Utf8", True), Field("k", "/d/g/r/@k", "Utf8", True), Field("own", "/d/g", "Utf8", True)])]),
    Mapping([Table("root", "/", [], [Field("t", "/d/t", "Utf8", True)]), Table("g", "/d/g", ["g"], []), Table("r", "/d/g/r", ["g", "r"], [Field("a", "/d/g/r/a", "Utf8", True), Field("b", "/d/g/r/b/c", "Utf8", True)])]),
]


def document(rng, depth=0):
    out = []
    for _ in range(rng.randrange(4)):
        name = "dgrabctx"[min(7, depth + rng.choice([0, 0, 0, 1, 2]))]
        attrs = f' k="{rng.randrange(9)}&lt;"' if rng.random() < 0.4 else ""
        inside = document(rng, depth + 1) if depth < 4 and rng.random() < 0.8 else rng.choice(["", "x &amp; y", " ", "z"])
        out.append(f"<{name}{attrs}/>" if not inside and rng.random() < 0.5 else f"<{name}{attrs}>{inside}</{name}>")
    return "".join(out)


def test_agrees_with_windows(spark):
    rng = random.Random(4)
    for mapping in MAPPINGS:
        engine = Shredder(mapping)
        docs = []
        while len(docs) < 120:
            d = "<d>" + document(rng, 1) + document(rng, 1) + "</d>"
            try:
                from .shredding import shred

                shred(d, mapping)  # without repeated values
                docs.append((len(docs), d))
            except Exception:  # noqa: BLE001, S112
                continue
        frame = spark.createDataFrame(docs, "id long, content string").repartition(2)
        for name in engine.names:
            got = sorted(map(repr, map(tuple, engine.table(frame, name, keys=["id"]).collect())))
            want = sorted(map(repr, map(tuple, shred_by_windows(frame, mapping, name, key="id").collect())))
            assert got == want and len(got) > 20
