"""Physical lines by kind: source, comment or blank.

The lexers carry strings and block comments across lines, which no window over lines can, so whole files
go through one Arrow-batched Python stage.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

WHITE = b" \t\n\f\r"
_PY_PLAIN = re.compile(rb"[^'\"#]+")
_C_PLAIN = re.compile(rb"(?:[^'\"/rR]++|r(?![r#\"])|R(?!\"))+")
_C_BLOCK = re.compile(rb"/\*|\*/")
#: By opening quote: an escaped byte, or the closing quote.
_CLOSING = {q: re.compile(rb"\\.|" + q, re.S) for q in (b"'", b'"', b"'''", b'"""')}
_C_RAW = re.compile(rb"r(r|#)*\"")
_CPP_RAW = re.compile(rb"R\"([^ \t\n\f\r()]{0,16})\(")


def _marks(data: bytes, source: list[tuple[int, int]], comment: list[tuple[int, int]]) -> tuple[int, int, int, int]:
    """(total, source, comment, blank) from the byte ranges of code and of comments."""
    starts = [0]
    at = data.find(b"\n")
    while at >= 0:
        starts.append(at + 1)
        at = data.find(b"\n", at + 1)
    if starts[-1] == len(data):
        starts.pop()
    kinds = bytearray(len(starts))

    def paint(ranges: list[tuple[int, int]], kind: int) -> None:
        line = 0
        for a, b in ranges:
            while line + 1 < len(starts) and starts[line + 1] <= a:
                line += 1
            k = line
            while k < len(starts) and starts[k] < b:
                kinds[k] = max(kinds[k], kind)
                k += 1

    paint(comment, 1)
    paint(source, 2)
    return len(starts), kinds.count(2), kinds.count(1), kinds.count(0)


def _string_end(data: bytes, at: int, quote: bytes) -> int:
    """End of a string opened before ``at``: past the first closing quote that isn't escaped."""
    for m in _CLOSING[quote].finditer(data, at):
        if m[0] == quote:
            return m.end()
    return len(data)


def _code(data: bytes, a: int, b: int) -> list[tuple[int, int]]:
    """Ranges of ``data[a:b]`` that hold anything but white space, line by line."""
    out = []
    for m in re.finditer(rb"[^ \t\n\f\r][^\n]*", data[a:b]):
        out.append((a + m.start(), a + m.end()))
    return out


def python_lines(data: bytes) -> tuple[int, int, int, int]:
    """(total, source, comment, blank) of Python source; strings, docstrings too, are source."""
    source, comment, at = [], [], 0
    while at < len(data):
        if m := _PY_PLAIN.match(data, at):
            source += _code(data, at, m.end())
            at = m.end()
        elif data[at] == 0x23:
            end = data.find(b"\n", at)
            end = len(data) if end < 0 else end
            comment.append((at, end))
            at = end
        else:
            quote = data[at : at + 3] if data[at : at + 3] == data[at : at + 1] * 3 else data[at : at + 1]
            end = _string_end(data, at + len(quote), quote)
            source.append((at, end))
            at = end
    return _marks(data, source, comment)


def c_lines(data: bytes) -> tuple[int, int, int, int]:
    """(total, source, comment, blank) of C, C++ or Rust; block comments nest, raw strings have no escapes."""
    source, comment, at = [], [], 0
    while at < len(data):
        if m := _C_PLAIN.match(data, at):
            source += _code(data, at, m.end())
            at = m.end()
        elif data.startswith(b"//", at):
            end = data.find(b"\n", at)
            end = len(data) if end < 0 else end
            comment.append((at, end))
            at = end
        elif data.startswith(b"/*", at):
            depth, end = 1, at + 2
            while depth and end < len(data):
                m = _C_BLOCK.search(data, end)
                end = m.end() if m else len(data)
                depth += (1 if m[0] == b"/*" else -1) if m else 0
            comment.append((at, end))
            at = end
        elif (m := _C_RAW.match(data, at)) or (m := _CPP_RAW.match(data, at)):
            close = b'"' + m[0][1:-1] if data[at] == 0x72 else b")" + m[1] + b'"'
            end = data.find(close, m.end())
            end = len(data) if end < 0 else end + len(close)
            source.append((at, end))
            at = end
        elif data[at] in b"'\"":
            end = _string_end(data, at + 1, data[at : at + 1])
            source.append((at, end))
            at = end
        else:
            source.append((at, at + 1))
            at += 1
    return _marks(data, source, comment)


LEXERS = {"python": python_lines, "rust": c_lines, "c": c_lines, "cpp": c_lines}


def line_counts(files: DataFrame, key: str = "path", content: str = "bytes", language: str = "language") -> DataFrame:
    """(key, language, total, source, comment, blank) of the files in a language with a lexer; total is the sum of the rest."""
    kind = dict(files.dtypes)[key]
    known = files.where(files[language].isin(*LEXERS)).select(key, language, content)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [LEXERS[lang](data or b"") for lang, data in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())]
            columns = [pa.array([f[k] for f in found], pa.int64()) for k in range(4)]
            yield pa.record_batch([batch.column(0), batch.column(1), *columns], names=[key, language, "total", "source", "comment", "blank"])

    return known.mapInArrow(run, f"`{key}` {kind}, `{language}` string, total long, source long, comment long, blank long")
