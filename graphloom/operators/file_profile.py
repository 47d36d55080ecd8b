"""A flat profile of each Python file: imports, calls, classes with their methods, functions."""

from __future__ import annotations

import ast
import hashlib
from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

from ..functions.text import layer

_DDL = "path string, file_name string, file_hash string, purpose string, imports array<string>, calls array<string>, classes array<struct<name:string,purpose:string,methods:array<struct<name:string,purpose:string>>>>, functions array<struct<name:string,purpose:string>>, error string"


def _about(node: ast.AST) -> dict:
    return {"name": node.name, "purpose": ast.get_docstring(node) or "No docstring provided"}


def _called(func: ast.expr) -> str | None:
    match func:
        case ast.Name(id=name):
            return name
        case ast.Attribute(value=ast.Name(id=owner), attr=name):
            return f"{owner}.{name}"
        case ast.Attribute(attr=name):
            return name
    return None


def profile(path: str, text: str) -> dict:
    """Imports and calls are distinct and sorted; bodies of plain functions aren't entered, those of
    classes are, except their plain methods."""
    tree = ast.parse(text)
    imports, calls, classes = set(), set(), []

    def walk(node: ast.AST) -> None:
        match node:
            case ast.FunctionDef():
                return
            case ast.Import(names=names):
                imports.update(a.name for a in names)
            case ast.ImportFrom(module=module, names=names):
                imports.update(f"{module}.{a.name}" if module else a.name for a in names)
            case ast.Call(func=func) if name := _called(func):
                calls.add(name)
            case ast.ClassDef(body=body):
                classes.append({**_about(node), "methods": [_about(m) for m in body if isinstance(m, ast.FunctionDef)]})
        for child in ast.iter_child_nodes(node):
            walk(child)

    for node in tree.body:
        walk(node)
    return {
        "path": path, "file_name": path.rpartition("/")[2], "file_hash": hashlib.md5(text.encode()).hexdigest(), "purpose": ast.get_docstring(tree) or "Analyzed file",
        "imports": sorted(imports), "calls": sorted(calls), "classes": classes, "functions": [_about(n) for n in tree.body if isinstance(n, ast.FunctionDef)], "error": None,
    }


def profiles(files: DataFrame) -> DataFrame:
    """profile() of each file (path, content), with its layer; a file that can't be parsed has only
    path and error."""
    schema = to_arrow_schema(_parse_datatype_string(_DDL))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        for b in batches:
            rows = []
            for path, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                try:
                    rows.append(profile(path, text))
                except (SyntaxError, ValueError, RecursionError) as e:
                    rows.append({n: None for n in schema.names} | {"path": path, "error": str(e)})
            yield pa.RecordBatch.from_pylist(rows, schema=schema)

    own = files.where("path IS NOT NULL AND content IS NOT NULL").select("path", "content")
    return own.mapInArrow(run, _DDL).withColumn("layer", layer("path"))


def files_importing(found: DataFrame, module: str) -> DataFrame:
    return found.where(F.array_contains("imports", module)).select("path")
