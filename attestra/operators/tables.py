"""Tables inside documents: parsed to cells, and rendered."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import HTML_ENTITIES, markdown_row
from ..session import ship

_FIELDS = (("table_no", T.IntegerType()), ("kind", T.StringType()), ("header_ref", T.IntegerType()), ("header", T.StringType()), ("col", T.IntegerType()), ("ref", T.IntegerType()), ("row_no", T.IntegerType()), ("cell", T.StringType()))
_TABLE, _ROW, _CELL = re.compile(r"(?is)<table[^>]*>(.*?)</table>"), re.compile(r"(?is)<tr[^>]*>(.*?)</tr>"), re.compile(r"(?is)<(t[hd])[^>]*>(.*?)</t[hd]>")


def _cells(line: str) -> list[str] | None:
    if "|" not in line:
        return None
    body = re.sub(r"^[-*+]\s+", "", line.strip()).removeprefix("|")
    if body.endswith("|") and not body.endswith("\\|"):
        body = body[:-1]
    cells = [c.replace("\\|", "|").strip() for c in re.split(r"(?<!\\)\|", body)]
    return cells if len(cells) > 1 else None


def _markdown(text: str) -> list[dict]:
    """Header and delimiter of one width, then rows of that width; what one table took is not looked at again."""
    rows = [_cells(x) for x in text.split("\n")]
    rule = [bool(r) and all(re.fullmatch(r":?-{3,}:?", c) for c in r) for r in rows]
    out, i, number = [], 0, 0
    while i + 1 < len(rows):
        head = rows[i]
        if not head or not rule[i + 1] or len(rows[i + 1]) != len(head):
            i += 1
            continue
        j = i + 2
        while j < len(rows) and rows[j] and len(rows[j]) == len(head) and not rule[j]:
            out += [{"table_no": number, "kind": "md", "header_ref": i + 1, "header": h, "col": c, "ref": j + 1, "row_no": j - i - 2, "cell": v} for c, (h, v) in enumerate(zip(head, rows[j]))]
            j += 1
        number, i = number + 1, j
    return out


_ENTITY = re.compile(r"(?i)&(#x[0-9a-f]+|#[0-9]+|[a-z]+);")


def _decoded(m: re.Match) -> str:
    """An entity by number or name; unknown ones are blanks."""
    body = m[1].lower()
    if body[0] != "#":
        return HTML_ENTITIES.get(body, " ")
    code = int(body[2:], 16) if body[1] == "x" else int(body[1:])
    return chr(code) if 0 < code <= 0x10FFFF and not 0xD800 <= code <= 0xDFFF else " "


def _html(text: str, number: int) -> list[dict]:
    """A part for each row of headings, with the rows below that have its width; each cell has the line that it begins on."""
    out = []
    clean = lambda x: " ".join(_ENTITY.sub(_decoded, re.sub(r"<[^>]*>", " ", x)).split())
    for t in _TABLE.finditer(text):
        head, head_ref, row_no = None, 0, 0
        for r in _ROW.finditer(t[1]):
            start = t.start(1) + r.start(1)
            found = [(m[1].lower(), clean(m[2]), text.count("\n", 0, start + m.start()) + 1) for m in _CELL.finditer(r[1])]
            if found and all(k == "th" for k, _, _ in found):
                head, head_ref, row_no, number = [v for _, v, _ in found], found[0][2], 0, number + 1
            elif head and len(found) == len(head):
                out += [{"table_no": number - 1, "kind": "html", "header_ref": head_ref, "header": h, "col": c, "ref": ref, "row_no": row_no, "cell": v} for c, (h, (_, v, ref)) in enumerate(zip(head, found))]
                row_no += 1
    return out


#: So many documents are parsed before their cells are handed on, so that a task holds few of them at a time.
AT_ONCE = 64


def table_cells(docs: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """A row for each cell of every Markdown and HTML table; each document is parsed once, and one without a table not at all."""
    ship(docs.sparkSession)
    some = docs.where(F.col(text).contains("|") | F.lower(F.col(text)).contains("<table")).select(*keys, F.col(text).alias("_text"))
    kinds = [(n, pa.int32() if isinstance(k, T.IntegerType) else pa.string()) for n, k in _FIELDS]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, AT_ONCE):
                b = whole.slice(start, AT_ONCE)
                at, cells = [], []
                for i, t in enumerate(b.column(b.num_columns - 1).to_pylist()):
                    md = _markdown(t)
                    found = md + _html(t, 1 + max((x["table_no"] for x in md), default=-1))
                    at += [i] * len(found)
                    cells += found
                if cells:
                    own = [b.column(i).take(pa.array(at, pa.int32())) for i in range(b.num_columns - 1)]
                    yield pa.RecordBatch.from_arrays([*own, *(pa.array([c[n] for c in cells], k) for n, k in kinds)], names=[*b.schema.names[:-1], *(n for n, _ in kinds)])

    schema = T.StructType([*some.schema.fields[:-1], *(T.StructField(n, k) for n, k in _FIELDS)])
    return some.mapInArrow(run, schema)


def rendered(rows: DataFrame, keys: list[str], columns: dict[str, str], order: str) -> DataFrame:
    """(keys, text): the rows of each key as a Markdown table; ``columns``: heading by column."""
    lines = rows.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), markdown_row(*map(F.col, columns)).alias("line")))).alias("rows"))
    head = "| " + " | ".join(columns.values()) + " |\n|" + " --- |" * len(columns)
    return lines.select(*keys, F.concat(F.lit(head + "\n"), F.array_join(F.transform("rows", lambda r: r["line"]), "\n")).alias("text"))


def column_sets(cells: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, table_no, col, header, members): each column's distinct members, sorted."""
    return cells.groupBy(*keys, "table_no", "col", "header").agg(F.array_sort(F.collect_set("cell")).alias("members"))


def table_leaves(cells: DataFrame, keys: list[str], key_col: int = 0) -> DataFrame:
    """Obligations that a table makes: for each cell but the key's, its row's key, column and value."""
    at = Window.partitionBy(*keys, "table_no", "row_no")
    rows = cells.withColumn("row_key", F.max(F.when(F.col("col") == key_col, F.col("cell"))).over(at))
    return rows.where(F.col("col") != key_col).select(*keys, "table_no", "row_no", "row_key", F.col("header").alias("column"), F.col("cell").alias("value"))
