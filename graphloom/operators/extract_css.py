"""Stylesheets: the classes, ids and elements that their selectors name."""

from __future__ import annotations

import re
from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

_COMMENT = re.compile(r"/\*.*?\*/", re.S)
_STRING = re.compile(r"\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'", re.S)
_STOP = re.compile(r"[;{}()\[\]]")
#: At-rules whose blocks hold rules, and functions whose arguments are selectors.
_NESTING = frozenset("container document layer media scope starting-style supports".split())
_SELECTING = frozenset("has host is matches not slotted where".split())
_FUNCTION = re.compile(r":([A-Za-z-]+)\(")
_KINDS = (("StyleClass", re.compile(r"\.(-?[^\W\d][\w-]*)(?![\w\\-])")), ("StyleID", re.compile(r"#(-?[^\W\d][\w-]*)(?![\w\\-])")), ("StyleElement", re.compile(r"(?:^|(?<=[\s,>+~(|&]))([A-Za-z][\w-]*)")))
_STATE = re.compile(r":([A-Za-z-]+)")
#: How the historical builder reads names: anywhere in the sheet, so of properties and values too.
_ANYWHERE = (
    ("StyleClass", re.compile(r"\.([A-Za-z_-][\w-]*)(?=[\s,{:])", re.A)),
    ("StyleID", re.compile(r"#(?!(?:[\da-fA-F]{3}){1,2}\b)([A-Za-z][\w-]*)", re.A)),
    ("StyleElement", re.compile(r"(?<![#.-])\b([A-Za-z][\w-]*)(?=[\s:{])", re.A)),
)
MEDIA, FRAMES, IMPORT = r"@media\s*\([^)]+\)", r"@keyframes\s+[a-zA-Z][a-zA-Z0-9_-]*", r"@import\s+['\"](.*?)['\"]"


def strip_comments(text: str) -> str:
    """Without comments; their line breaks stay, so lines keep their numbers."""
    return _COMMENT.sub(lambda m: "\n" * m[0].count("\n"), text)


def _blank(m: re.Match) -> str:
    return re.sub(r"[^\n]", " ", m[0])


def preludes(text: str) -> list[tuple[int, str]]:
    """(offset, selector list) of each style rule of a sheet without comments, nested ones too.  What is
    no selector in them (strings, attribute tests, arguments like 2n+1) is blanked."""
    text = _STRING.sub(_blank, text)
    out: list[tuple[int, str]] = []
    blocks: list[bool] = []  # of each open block, whether rules can be in it
    begin, brackets = 0, 0
    for m in _STOP.finditer(text):
        ch = m[0]
        if ch in "([":
            brackets += 1
        elif ch in ")]":
            brackets = max(0, brackets - 1)
        elif ch == ";" and brackets:
            continue
        else:
            segment = text[begin : m.start()]
            if ch == "{":
                head = segment.lstrip()
                if head.startswith("@"):
                    name = re.match(r"@(?:-\w+-)?([\w-]*)", head)[1].lower()
                    blocks.append(name in _NESTING and all(blocks))
                else:
                    if all(blocks):
                        out.append((begin, _selectors_only(segment)))
                    blocks.append(all(blocks))
            elif ch == "}" and blocks:
                blocks.pop()
            begin, brackets = m.end(), 0
    return out


def _selectors_only(text: str) -> str:
    text = re.sub(r"\[[^\]]*\]", _blank, text)
    keep = list(text)
    for m in _FUNCTION.finditer(text):
        if m[1].lower() not in _SELECTING:
            depth, i = 1, m.end()
            while i < len(text) and depth:
                depth += (text[i] == "(") - (text[i] == ")")
                if depth and text[i] != "\n":
                    keep[i] = " "
                i += 1
            keep[m.end() - 1] = " "
    return "".join(keep)


def names(text: str, compat: bool = False) -> list[tuple[str, str, int, str | None]]:
    """(node_type, name, line, pseudo_state) of a sheet, in the order classes, ids, elements."""
    clean = strip_comments(text)
    parts = [(0, clean)] if compat else preludes(clean)
    out = []
    for kind, pattern in _ANYWHERE if compat else _KINDS:
        line, seen = 1, 0
        for begin, part in parts:
            for m in pattern.finditer(part):
                at = begin + m.start(1)
                line, seen = line + clean.count("\n", seen, at), at
                state = _STATE.match(part, m.end())
                out.append((kind, m[1], line, state and state[1]))
    return out


def selectors(files: DataFrame, compat: bool = False) -> DataFrame:
    """One row (path, at, node_type, name, line, pseudo_state) for each name in a selector, in the order
    classes, ids, elements.  compat: names are taken from the whole sheet, which makes elements of
    properties and values."""
    kinds = (("path", pa.string()), ("at", pa.int32()), ("node_type", pa.string()), ("name", pa.string()), ("line", pa.int32()), ("pseudo_state", pa.string()))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        for b in batches:
            rows = [(path, at, *found) for path, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) for at, found in enumerate(names(text, compat))]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, (_, t) in enumerate(kinds)], [n for n, _ in kinds])

    return _own(files).mapInArrow(run, "path string, at int, node_type string, name string, line int, pseudo_state string")


def _own(files: DataFrame) -> DataFrame:
    return files.where("path IS NOT NULL AND content IS NOT NULL").select("path", "content")


def ambiguities(files: DataFrame) -> DataFrame:
    """Breakpoints and animations (comments count), and imports (they don't): path, kind, expression."""
    found = lambda kind, c, pattern, group: F.transform(F.regexp_extract_all(c, F.lit(pattern), F.lit(group)), lambda x: F.struct(F.lit(kind).alias("kind"), x.alias("expression")))
    bare = F.regexp_replace("content", r"(?s)/\*.*?\*/", "")
    every = F.concat(found("responsive_breakpoint", "content", MEDIA, 0), found("css_animation_defined", "content", FRAMES, 0), found("import_target_unresolved", bare, IMPORT, 1))
    return _own(files).select("path", F.posexplode(every).alias("at", "a")).select("path", "at", "a.kind", "a.expression")


def extract(files: DataFrame, compat: bool = False, found: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes, edges, ambiguities); of equal ids the first one stays, with its pseudo state.  found:
    selectors() of the files, where that is known."""
    each = (selectors(files, compat) if found is None else found).withColumn("id", F.concat_ws("::", "path", "node_type", "name"))
    each = each.withColumn("nth", F.row_number().over(Window.partitionBy("id").orderBy("at"))).where("nth = 1")
    state = F.when(F.col("pseudo_state").isNotNull(), F.create_map(F.lit("pseudo_state"), "pseudo_state"))
    sheets = _own(files).select(
        F.lit(0).cast("long").alias("at"), F.col("path").alias("id"), F.lit("Stylesheet").alias("node_type"), F.col("path").alias("name"), F.md5(F.col("content").cast("binary")).alias("hash"),
        F.lit(None).cast("int").alias("line_start"), F.lit("structural").alias("analysis_confidence"), F.lit(None).cast("map<string,string>").alias("attributes"),
    )
    nodes = sheets.unionByName(each.select((F.col("at").cast("long") + 1).alias("at"), "id", "node_type", "name", F.lit(None).cast("string").alias("hash"), F.col("line").alias("line_start"), F.lit("heuristic").alias("analysis_confidence"), state.alias("attributes")))
    edges = each.select(F.lit("defines").alias("edge"), F.col("path").alias("from"), F.col("id").alias("to"), F.lit(None).cast("int").alias("call_line"), "at")
    doubts = ambiguities(files).select(
        F.sha2(F.concat_ws("\x1f", "path", "kind", "expression", F.col("at").cast("string")), 256).alias("id"), "kind", F.col("path").alias("source_file"), F.col("path").alias("source_scope"), "expression",
        F.lit("Not modelled").alias("reason"), F.lit("unresolved").alias("confidence"), F.lit("agent").alias("resolver"),
    )
    return nodes, edges, doubts
