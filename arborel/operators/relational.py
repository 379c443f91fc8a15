"""Shredding as relational algebra: tokens, window sums, and a grouping by row.

A second formulation without Python on the executors, for plain documents
(tags with double-quoted attributes, text, the five entities).  It states the
rules once more, independently: rows are the closings of known children of a
table's element; a value joins forward to the next row of its table; levels
count the closings since the table's last opening.  Tests hold the fold
against it.  It shuffles by document and explodes tokens, so the fold is the
one to use on large data.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.convert import converted
from ..plans.mapping import Mapping, segments

_TOKEN = r"<[^>]*>|[^<]+"


def _plain(text: Column) -> Column:
    for entity, plain in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&amp;", "&")):
        text = F.replace(text, F.lit(entity), F.lit(plain))
    return text


def tokens(docs: DataFrame, key: str, content: str, deepest: int) -> DataFrame:
    """key, pos, kind (open, close, alone, text), raw, depth of the element, path of the element.

    A text's element is the one around it.  Deeper paths than `deepest` are null.
    """
    t = docs.select(F.col(key).alias("key"), F.posexplode(F.regexp_extract_all(F.regexp_replace(content, r"^\s*<\?xml[^>]*\?>", ""), F.lit(_TOKEN), F.lit(0))).alias("pos", "raw"))
    kind = F.when(~F.col("raw").startswith("<"), "text").when(F.col("raw").startswith("</"), "close").when(F.col("raw").endswith("/>"), "alone").otherwise("open")
    t = t.withColumn("kind", kind).withColumn("name", F.regexp_extract("raw", r"^</?(?:[^\s/>:]*:)?([^\s/>]+)", 1))
    step = F.when(F.col("kind") == "open", 1).when(F.col("kind") == "close", -1).otherwise(0)
    so_far = Window.partitionBy("key").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    t = t.withColumn("depth", F.sum(step).over(so_far) + F.when(F.col("kind").isin("close", "alone"), 1).otherwise(0))
    heads = F.col("kind").isin("open", "alone")
    names = [F.last(F.when(heads & (F.col("depth") == d), F.col("name")), ignorenulls=True).over(so_far) for d in range(1, deepest + 1)]
    t = t.withColumn("names", F.array(*names))
    return t.withColumn("path", F.when(F.col("depth") <= deepest, F.concat(F.lit("/"), F.array_join(F.slice("names", F.lit(1), F.col("depth").cast("int")), "/")))).drop("names")


def shred_by_windows(docs: DataFrame, mapping: Mapping, name: str, *, key: str, content: str = "content") -> DataFrame:
    """One typed table of plain documents: key, level columns, fields."""
    mapping.check()
    table = mapping.table(name)
    place = lambda path: "/" + "/".join(segments(path))
    # Known elements are the prefixes of every path of the mapping, attributes aside.
    known = {"/"}
    for path in [t.xml_path for t in mapping.tables] + [f.xml_path for t in mapping.tables for f in t.fields]:
        steps = [s for s in segments(path) if not s.startswith("@")]
        known |= {"/" + "/".join(steps[:i]) for i in range(1, len(steps) + 1)}
    tables = {place(t.xml_path) for t in mapping.tables if segments(t.xml_path) or t.fields}

    def innermost(element: str) -> str:
        steps = segments(element)
        return max((p for p in tables if segments(p) == steps[: len(segments(p))]), key=len, default="")

    t = tokens(docs, key, content, max(len(segments(p)) for p in known))
    before = Window.partitionBy("key").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    so_far = Window.partitionBy("key").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)

    def rows_of(path: str) -> Column:
        children = [k for k in known if len(segments(k)) == len(segments(path)) + 1 and segments(k)[:-1] == segments(path)]
        return F.col("kind").isin("close", "alone") & F.col("path").isin(*children) if children else F.lit(False)

    own = place(table.xml_path)
    chain = sorted((p for p in tables if p != "/" and segments(p) == segments(own)[: len(segments(p))]), key=len)
    columns = {"closes": rows_of(own), "fill": F.coalesce(F.sum(rows_of(own).cast("long")).over(before), F.lit(0))}
    for i, path in enumerate(chain[: len(table.levels)]):
        done = F.coalesce(F.sum(rows_of(path).cast("long")).over(before), F.lit(0))
        opens = F.col("kind").isin("open", "alone") & (F.col("path") == path)
        columns[f"level{i}"] = done
        columns[f"opened{i}"] = opens
    t = t.withColumns(columns)
    for i in range(min(len(chain), len(table.levels))):
        t = t.withColumn(f"level{i}", F.col(f"level{i}") - F.last(F.when(F.col(f"opened{i}"), F.col(f"level{i}")), ignorenulls=True).over(so_far))

    cells = []
    for j, f in enumerate(table.fields):
        steps = segments(f.xml_path)
        attribute = steps[-1][1:] if steps and steps[-1].startswith("@") else None
        element = "/" + "/".join(steps[:-1] if attribute else steps)
        if innermost(element) != own:
            value = F.lit(None).cast("string")
        elif attribute:
            found = F.regexp_extract("raw", rf'\s(?:[^\s=:"]*:)?{attribute}="([^"]*)"', 1)
            there = F.col("raw").rlike(rf'\s(?:[^\s=:"]*:)?{attribute}="')
            value = F.when(F.col("kind").isin("open", "alone") & (F.col("path") == element) & there, _plain(F.translate(found, "\t\n\r", "   ")))
        else:
            value = F.when((F.col("kind") == "text") & (F.col("path") == element), _plain(F.col("raw")))
        pieces = F.sort_array(F.collect_list(F.when(value.isNotNull(), F.struct("pos", value.alias("v")))))
        cells.append(F.when(F.size(pieces) > 0, F.array_join(F.transform(pieces, lambda p: p["v"]), "")).alias(f"_f{j}"))
    levels = [F.max(F.when(F.col("closes"), F.col(f"level{i}"))).alias(f"<{table.levels[i]}>") for i in range(min(len(chain), len(table.levels)))]
    grouped = t.groupBy("key", "fill").agg(F.max("closes").alias("whole"), *levels, *cells).where("whole")
    return grouped.select(F.col("key").alias(key), *[F.col(f"`<{x}>`") for x in table.levels[: len(levels)]], *[converted(f, F.col(f"_f{j}")).alias(f.name) for j, f in enumerate(table.fields)])
