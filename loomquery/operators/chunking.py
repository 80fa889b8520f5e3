"""Chunking of source files and texts, and the facts that a parser yields."""

from __future__ import annotations

import ast
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CHUNK = "path string, chunk_no int, chunk_type string, name string, start_line int, end_line int, signature string, docstring string, imports array<string>, calls array<string>, content string"


def pages(text: Column, length: int, overlap: int) -> Column:
    """An array of text windows of ``length`` characters that overlap by ``overlap``; the last ends with the text."""
    step = length - overlap
    n = F.greatest(F.lit(1), F.ceil((F.length(text) - overlap) / step)).cast("int")
    return F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.substring(text, i * step + 1, F.lit(length)))


def python_chunks(source: str) -> list[dict]:
    """Functions and classes, nested ones too, in order of place; a file that doesn't parse is one chunk."""
    lines = source.split("\n")
    try:
        tree = ast.parse(source)
    except (SyntaxError, ValueError):
        return [_whole(source, lines)]
    imports = sorted({a.name for n in ast.walk(tree) if isinstance(n, ast.Import) for a in n.names} | {n.module or "" for n in ast.walk(tree) if isinstance(n, ast.ImportFrom)})
    out = []
    for node in ast.walk(tree):
        if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
            is_class = isinstance(node, ast.ClassDef)
            heads = ", ".join(map(ast.unparse, node.bases)) if is_class else ast.unparse(node.args)
            calls = sorted({ast.unparse(c.func) for c in ast.walk(node) if isinstance(c, ast.Call)})
            out.append(
                {
                    "chunk_type": "class" if is_class else "function",
                    "name": node.name,
                    "start_line": node.lineno,
                    "end_line": node.end_lineno,
                    "signature": f"{'class' if is_class else 'async def' if isinstance(node, ast.AsyncFunctionDef) else 'def'} {node.name}({heads})",
                    "docstring": ast.get_docstring(node),
                    "imports": imports,
                    "calls": calls,
                    "content": "\n".join(lines[node.lineno - 1 : node.end_lineno]),
                }
            )
    return sorted(out, key=lambda c: (c["start_line"], -c["end_line"])) or [_whole(source, lines)]


_JS_HEAD = re.compile(r"^\s*(?:export\s+)?(?:default\s+)?(?:(async\s+)?function\s+(\w+)\s*\(([^)]*)\)|class\s+(\w+)|(?:const|let|var)\s+(\w+)\s*=\s*(?:async\s*)?\(([^)]*)\)\s*=>)", re.M)
_JS_IMPORT = re.compile(r"""(?:import\s[^'"]*?from\s+|import\s+|require\()\s*['"]([^'"]+)['"]""")


def script_chunks(source: str) -> list[dict]:
    """Functions, classes and arrow functions of JavaScript or TypeScript, up to the brace that closes them."""
    lines = source.split("\n")
    imports = sorted(set(_JS_IMPORT.findall(source)))
    out = []
    for m in _JS_HEAD.finditer(source):
        depth, end = 0, len(source)
        for i in range(m.end(), len(source)):
            if source[i] == "{":
                depth += 1
            elif source[i] == "}":
                depth -= 1
                if depth <= 0:
                    end = i + 1
                    break
        body = source[m.start() : end]
        name = m[2] or m[4] or m[5]
        start = source.count("\n", 0, m.start(m.lastindex or 0)) + 1
        calls = sorted(set(re.findall(r"\b([A-Za-z_$][\w$.]*)\s*\(", source[m.end() : end])) - {"if", "for", "while", "switch", "return", "function"})
        out.append({"chunk_type": "class" if m[4] else "function", "name": name, "start_line": start, "end_line": start + body.strip("\n").count("\n"), "signature": m[0].strip(), "docstring": None, "imports": imports, "calls": calls, "content": body.strip("\n")})
    return out or [_whole(source, lines)]


def _whole(source: str, lines: list[str]) -> dict:
    return {"chunk_type": "file", "name": None, "start_line": 1, "end_line": len(lines), "signature": None, "docstring": None, "imports": [], "calls": [], "content": source}


def chunk_files(files: DataFrame, path: str = "path", content: str = "content", language: str = "language") -> DataFrame:
    """Chunks of every file, parsed where the files are: no shuffle, a row for each chunk."""

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        by_language = {"python": python_chunks, "javascript": script_chunks, "typescript": script_chunks}
        for batch in batches:
            rows = []
            for name, text, kind in zip(batch["path"], batch["content"], batch["language"]):
                text = text or ""
                found = by_language.get(kind, lambda s: [_whole(s, s.split("\n"))])(text)
                rows += [{"path": name, "chunk_no": i, **c} for i, c in enumerate(found)]
            yield pd.DataFrame(rows, columns=[f.split(" ")[0] for f in CHUNK.split(", ")])

    return files.select(F.col(path).alias("path"), F.col(content).alias("content"), F.col(language).alias("language")).mapInPandas(parse, CHUNK)


def chunk_id(repository: Column, path: Column, number: Column) -> Column:
    """The document id of a chunk: 16 hex digits of SHA-256."""
    return F.substring(F.sha2(F.concat_ws(":", repository, path, number.cast("string")), 256), 1, 16)
