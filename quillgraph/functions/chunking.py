"""Chunks of documents: list items one by one, prose by sentences, short headings with what follows them."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from quillgraph.functions.text import stripped_text


def chunks(text: str | None, size: int = 512, least: int = 80) -> list[str]:
    out: list[str] = []
    heading = ""
    ends = lambda s: s[-1:] in {".", "!", "?"}

    def add(part: str) -> None:
        nonlocal heading
        part, heading = f"{heading} {part.strip()}" if heading else part.strip(), ""
        pieces = [part[i : i + size].strip() for i in range(0, len(part), size)]
        out.extend(p for i, p in enumerate(pieces) if p or i < len(pieces) - 1)

    def hold(part: str) -> None:
        nonlocal heading
        heading = f"{heading} {part}" if heading else part

    for block in filter(None, (b.strip() for b in re.split(r"\n\s*\n", text or ""))):
        lines = [x for x in (y.strip() for y in block.split("\n")) if x]
        widths = sorted(map(len, lines))
        if len(lines) >= 4 and widths[len(widths) // 2] < 120:
            for line in lines:
                hold(line) if len(line) < 30 and not ends(line) else add(line)
        elif len(block) < least and not ends(block):
            hold(block)
        else:
            packed = ""
            for sentence in filter(None, (s.strip() for s in re.split(r"(?<=[.!?])\s+", block))):
                if packed and len(packed) + len(sentence) + 1 > size:
                    add(packed)
                    packed = sentence
                else:
                    packed = f"{packed} {sentence}" if packed else sentence
            if packed:
                add(packed)
    if heading:
        out.append(heading)
    return out or [t for t in [(text or "").strip()] if t]


def chunk_text(c: Column, size: int = 512, least: int = 80, strip: bool = False) -> Column:
    """Chunks of a text column; with strip those of strip_boilerplate(c), in the same pass."""

    @F.arrow_udf("array<string>")
    def cut(texts: pa.Array) -> pa.Array:
        return pa.array([chunks(stripped_text(t) if strip and t else t, size, least) for t in texts.to_pylist()], pa.list_(pa.string()))

    return cut(c)
