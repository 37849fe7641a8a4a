"""Text items of simple PDF files, read by Spark as binary files.

Best effort, for files with plain or Flate-compressed streams and single-byte text: each page's content gives its shown strings with place and size. Encrypted files, object streams and fonts with
encodings of their own are not resolved. A file that can't be read gives one row with the error.
"""

from __future__ import annotations

import re
import zlib

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ITEMS = "path string, page int, seq int, str string, x double, y double, size double, font_name string, error string"
_TOKEN = re.compile(rb"\((?:\\.|[^\\()]|\((?:\\.|[^\\()])*\))*\)|<[0-9A-Fa-f\s]*>|\[|\]|/[^\s/\[\]()<>]+|[-+]?\d*\.?\d+|[A-Za-z'\"*]+")
_ESCAPES = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}
MOST_BYTES = 1 << 30


def _string(token: bytes) -> str:
    if token[:1] == b"<":
        digits = re.sub(rb"\s", b"", token[1:-1])
        return bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode()).decode("latin-1")
    put = lambda m: bytes([int(m[1], 8) & 255]) if m[1][:1].isdigit() else _ESCAPES.get(m[1], m[1])
    return re.sub(rb"\\([0-7]{1,3}|.)", put, token[1:-1], flags=re.S).decode("latin-1")


def _objects(data: bytes) -> dict[int, bytes]:
    return {int(m[1]): m[2] for m in re.finditer(rb"(?s)\b(\d+)\s+\d+\s+obj\b(.*?)\bendobj", data)}


def _stream(body: bytes) -> bytes:
    m = re.search(rb"(?s)stream\r?\n(.*?)\r?\n?endstream", body)
    raw = m[1] if m else b""
    return zlib.decompressobj().decompress(raw) if b"/FlateDecode" in body[: m.start() if m else 0] else raw


def _refs(body: bytes, key: bytes) -> list[int]:
    m = re.search(re.escape(key) + rb"\s*(\[[^\]]*\]|\d+\s+\d+\s+R)", body)
    return [int(x) for x in re.findall(rb"(\d+)\s+\d+\s+R", m[1])] if m else []


def _page_order(objects: dict[int, bytes]) -> list[int]:
    root = next((k for k, b in objects.items() if re.search(rb"/Type\s*/Pages\b", b) and b"/Parent" not in b), None)
    out, todo, seen = [], [root] if root else [], set()
    while todo:
        k = todo.pop(0)
        if k in seen or k not in objects:
            continue
        seen.add(k)
        if re.search(rb"/Type\s*/Page\b(?!s)", objects[k]):
            out.append(k)
        todo = _refs(objects[k], b"/Kids") + todo
    return out


def content_items(content: bytes) -> list[tuple[str, float, float, float, str]]:
    """(string, x, y, size, font) of the strings that a content stream shows."""
    out, stack, saved = [], [], []
    here = {"ctm": (1.0, 0, 0, 1, 0, 0), "font": "", "size": 0.0, "lead": 0.0}
    line = text = (1.0, 0, 0, 1, 0, 0)
    times = lambda a, b: (a[0] * b[0] + a[1] * b[2], a[0] * b[1] + a[1] * b[3], a[2] * b[0] + a[3] * b[2], a[2] * b[1] + a[3] * b[3], a[4] * b[0] + a[5] * b[2] + b[4], a[4] * b[1] + a[5] * b[3] + b[5])
    for token in _TOKEN.findall(content):
        if token[:1] in b"(<[]/" or re.fullmatch(rb"[-+]?\d*\.?\d+", token):
            stack.append(token)
            continue
        nums = [float(t) for t in stack if re.fullmatch(rb"[-+]?\d*\.?\d+", t)]
        strings = [_string(t) for t in stack if t[:1] in b"(<"]
        if token == b"q":
            saved.append(dict(here))
        elif token == b"Q" and saved:
            here = saved.pop()
        elif token == b"cm" and len(nums) >= 6:
            here["ctm"] = times(tuple(nums[-6:]), here["ctm"])
        elif token == b"BT":
            line = text = (1.0, 0, 0, 1, 0, 0)
        elif token == b"Tf" and nums:
            here["font"], here["size"] = next((t[1:].decode("latin-1") for t in stack if t[:1] == b"/"), ""), nums[-1]
        elif token == b"TL" and nums:
            here["lead"] = nums[-1]
        elif token == b"Tm" and len(nums) >= 6:
            line = text = tuple(nums[-6:])
        elif token in (b"Td", b"TD") and len(nums) >= 2:
            here["lead"] = -nums[-1] if token == b"TD" else here["lead"]
            line = text = times((1, 0, 0, 1, nums[-2], nums[-1]), line)
        elif token == b"T*":
            line = text = times((1, 0, 0, 1, 0, -here["lead"]), line)
        if token in (b"Tj", b"TJ", b"'", b'"'):
            if token in (b"'", b'"'):
                line = text = times((1, 0, 0, 1, 0, -here["lead"]), line)
            m = times(text, here["ctm"])
            out.append(("".join(strings), m[4], m[5], here["size"] * (m[2] ** 2 + m[3] ** 2) ** 0.5, here["font"]))
        stack = []
    return out


def pdf_items(path: str, data: bytes) -> list[tuple]:
    if not data.startswith(b"%PDF-"):
        return [(path, None, None, None, None, None, None, None, "not a PDF")]
    try:
        objects, rows = _objects(data), []
        for page, k in enumerate(_page_order(objects), 1):
            content = b"\n".join(_stream(objects[r]) for r in _refs(objects[k], b"/Contents") if r in objects)
            rows += [(path, page, seq, s, x, y, size, font, None) for seq, (s, x, y, size, font) in enumerate(content_items(content), 1)]
        return rows or [(path, None, None, None, None, None, None, None, "no text")]
    except (ValueError, zlib.error) as e:
        return [(path, None, None, None, None, None, None, None, f"unreadable: {e}")]


def items(files: DataFrame) -> DataFrame:
    """Text items of files (path, content), one file at a time."""

    def read(batches):
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"], strict=True):
                yield pd.DataFrame(pdf_items(path, bytes(content)), columns=[c.split()[0] for c in ITEMS.split(", ")]).astype({"page": "Int32", "seq": "Int32"})

    return files.select("path", "content").mapInPandas(read, ITEMS)


def read_items(spark: SparkSession, path: str) -> DataFrame:
    """Text items of the PDF files under a path; a file over 1 GiB gives a row that says so."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.pdf").option("recursiveFileLookup", "true").load(path)
    large = files.where(f"length > {MOST_BYTES}").select("path")
    small = items(files.where(f"length <= {MOST_BYTES}"))
    empty = [F.lit("larger than 1 GiB" if f.name == "error" else None).cast(f.dataType).alias(f.name) for f in small.schema.fields[1:]]
    return small.unionByName(large.select("path", *empty))
