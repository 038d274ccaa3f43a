"""Code chunks: functions, methods, classes without their methods, and what is left (the preamble).

Python is read with its own parser; languages of braces with a scanner that skips strings and comments. A source that
can't be read is one code_block. This replaces a grammar library, so names in brace languages are found by pattern.
"""

from __future__ import annotations

import ast
import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame

SCHEMA = "doc_id long, chunk_ix long, kind string, name string, start_line int, end_line int, text string, sha1 string"
BRACES = {"java", "javascript", "typescript", "c"}


def _python(text: str) -> list[tuple[str, str, int, int]]:
    """(kind, name, first line, last line), from 1, both included."""
    out = []
    lead = lambda n: min([n.lineno, *(d.lineno for d in n.decorator_list)])

    def walk(body, prefix=""):
        for n in body:
            if isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef)):
                out.append(("method" if prefix else "function", prefix + n.name, lead(n), n.end_lineno))
            elif isinstance(n, ast.ClassDef):
                methods = [m for m in n.body if isinstance(m, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef))]
                if methods:
                    walk(methods, f"{prefix}{n.name}.")
                else:
                    out.append(("class", prefix + n.name, lead(n), n.end_lineno))

    walk(ast.parse(text).body)
    return out


_SKIP = re.compile(r"""//[^\n]*|/\*.*?\*/|"(?:\\.|[^"\\\n])*"|'(?:\\.|[^'\\\n])*'|`(?:\\.|[^`\\])*`""", re.S)
_HEAD = re.compile(r"(?:class|interface|enum|struct|record)\s+(\w+)[^;{}()]*$|(\w+)\s*\([^;{}]*\)\s*(?:throws [\w., ]+|:\s*[\w<>\[\]| ]+|const)?\s*$")
_NOT_NAMES = {"if", "for", "while", "switch", "catch", "return", "else", "do", "try", "synchronized"}


def _braces(text: str) -> list[tuple[str, str, int, int]]:
    clean = _SKIP.sub(lambda m: re.sub(r"[^\n]", " ", m[0]), text)
    out, stack, since = [], [], 0
    for m in re.finditer(r"[{};]", clean):
        at = m.start()
        if m[0] == "{":
            head = clean[since:at].strip()
            found = _HEAD.search(head)
            kind, name = "", ""
            if found and (found[1] or found[2]) and (found[2] or "") not in _NOT_NAMES:
                kind, name = ("class", found[1]) if found[1] else ("function", found[2])
            first = since + len(clean[since:at]) - len(clean[since:at].lstrip())
            stack.append((kind, name, first, any(k == "function" for k, *_ in stack)))
        elif m[0] == "}" and stack:
            kind, name, first, inner = stack.pop()
            if kind and not inner:
                outer = [n for k, n, *_ in stack if k == "class"]
                label = "method" if kind == "function" and outer else kind
                lines = (text.count("\n", 0, first) + 1, text.count("\n", 0, at) + 1)
                if kind == "function" or not any(a >= lines[0] and b <= lines[1] for _, _, a, b in out):
                    out.append((label, ".".join([*outer, name]), *lines))
        since = at + 1
    return sorted(out, key=lambda x: x[2])


def chunks_of(text: str, language: str, max_tokens: int = 5000) -> list[tuple[str, str, int, int, str]]:
    try:
        lang = (language or "").lower()
        found = _python(text) if lang == "python" else _braces(text) if lang in BRACES else None
    except (SyntaxError, ValueError, RecursionError):
        found = None
    lines = text.splitlines(True)
    if found is None:
        return [("code_block", "", 1, len(lines), text)] if text else []
    used, out = [False] * len(lines), []
    for kind, name, a, b in found:
        out.append((kind, name, a, b, "".join(lines[a - 1 : b])))
        used[a - 1 : b] = [True] * (b - a + 1)
    left = [i for i, u in enumerate(used) if not u and lines[i].strip()]
    if left:
        out.insert(0, ("preamble", "", left[0] + 1, left[-1] + 1, "".join(lines[i] for i in left)))
    return [p for c in out for p in _split(c, max_tokens)]


def _split(chunk, limit: int):
    """Chunks of too many words are cut between lines."""
    kind, name, a, b, text = chunk
    if len(text.split()) <= limit:
        return [chunk]
    out, now, first, n = [], [], a, 0
    for i, line in enumerate(text.splitlines(True)):
        w = len(line.split())
        if now and n + w > limit:
            out.append((kind, name, first, a + i - 1, "".join(now)))
            now, first, n = [], a + i, 0
        now.append(line)
        n += w
    return [*out, (kind, name, first, b, "".join(now))]


def code_chunks(sources: DataFrame, max_tokens: int = 5000) -> DataFrame:
    """Chunks of sources(doc_id, text, language), a narrow pass; ``sha1`` is that of the text."""

    def run(batches):
        for b in batches:
            rows = {k: [] for k in ("doc_id", "chunk_ix", "kind", "name", "start_line", "end_line", "text", "sha1")}
            for d, t, lang in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                for i, (kind, name, a, z, body) in enumerate(chunks_of(t or "", lang, max_tokens)):
                    for k, v in zip(rows, (d, i, kind, name, a, z, body, hashlib.sha1(body.encode()).hexdigest()), strict=True):
                        rows[k].append(v)
            types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(rows.values(), types, strict=True)], names=list(rows))

    return sources.select("doc_id", "text", "language").mapInArrow(run, SCHEMA)
