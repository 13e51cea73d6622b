"""Order-dependent text packing as small pure functions, and their pandas UDFs (one document is one row)."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Marks to cut after, and a path in front of a piece.
HARD, SOFT = "。！？!?；;\n", "，、,)）」】；; "
PATH = re.compile(r"【[^】]{1,200}】\n")


def cut_windows(text: str, size: int, overlap: int) -> list[str]:
    """Pieces of at most ``size`` characters; a cut looks in the last three tenths for a sentence mark, then
    for a softer one; the next piece starts ``overlap`` characters back."""
    pieces, at = [], 0
    while at < len(text):
        end = min(at + size, len(text))
        if end < len(text):
            low = at + int(size * 0.7)
            for marks in (HARD, SOFT):
                place = max(text.rfind(m, low, end) for m in marks)
                if place >= low:
                    end = place + 1
                    break
        if piece := text[at:end].strip():
            pieces.append(piece)
        if end == len(text):
            break
        at = max(end - overlap, at + 1)
    return pieces


def _limits(size: int, overlap: int) -> tuple[int, int]:
    size = max(100, size)
    return size, max(0, min(overlap, size // 2))


def chunk_text(text: str | None, size: int = 600, overlap: int = 100, min_fill: int | None = None) -> list[str]:
    """Paragraphs, joined only until ``min_fill`` characters are there; a new chunk opens with the tail of
    the one before, a paragraph over ``size`` is cut into windows."""
    size, overlap = _limits(size, overlap)
    fill = max(0, min(size // 3 if min_fill is None else min_fill, size))
    done: list[str] = []
    held = ""
    for block in filter(None, (b.strip() for b in re.split(r"\n\s*\n", text or ""))):
        if len(block) > size:
            done += [held] if held else []
            done += cut_windows(block, size, overlap)
            held = ""
        elif held and (len(held) >= fill or len(held) + 1 + len(block) > size):
            done.append(held)
            tail = held[len(held) - overlap :] if overlap and overlap < len(held) else held if overlap else ""
            held = f"{tail}\n{block}" if tail else block
        else:
            held = f"{held}\n{block}" if held else block
    return [c for c in [*done, held] if c.strip()]


def chunk_blocks(blocks: list[str], size: int = 600, overlap: int = 100) -> list[str]:
    """Blocks as they are; one over ``size`` is cut, and its path prefix is put before every piece."""
    size, overlap = _limits(size, overlap)
    out: list[str] = []
    for block in filter(None, ((b or "").strip() for b in blocks)):
        if len(block) <= size:
            out.append(block)
            continue
        prefix = m.group() if (m := PATH.match(block)) else ""
        pieces = cut_windows(block, size, overlap)
        out += [p if k == 0 or p.startswith(prefix) else prefix + p for k, p in enumerate(pieces)]
    return out


def pack_items(header: str, items: list[str], size: int = 600) -> list[str]:
    """Items behind a header that every piece repeats, each piece at most ``size`` long where one can."""
    pieces: list[list[str]] = []
    room = 0
    for item in items:
        if not pieces or room < len(item):
            pieces.append([])
            room = size - len(header)
        pieces[-1].append(item)
        room -= len(item)
    return [header + "".join(p).rstrip("；") for p in pieces]


def merge_blocks(blocks: list[tuple[list[str], str, str, bool]], max_chars: int = 600, min_merge: int = 120, depth: int = 4) -> list[str]:
    """Texts of (path, title, body, atomic) blocks under '【path】'. Untitled neighbours join, those of one
    parent below the top level join, top-level ones never; a text stops growing at ``min_merge``."""

    def prefix(path: list[str]) -> str:
        return f"【{' > '.join(path[-depth:])}】\n" if path else ""

    out: list[str] = []
    group: list[tuple[str, str]] = []
    parent: list[str] = []
    kind: tuple = ()

    def close() -> None:
        if len(group) == 1:
            title, body = group[0]
            out.append((prefix(parent + ([title] if title else [])) + body).strip())
        elif group:
            out.append((prefix(parent) + "\n\n".join(f"{t}\n{b}" if t else b for t, b in group)).strip())
        group.clear()

    for path, title, body, atomic in blocks:
        body = (body or "").strip()
        if not body and not title:
            continue
        if atomic:
            close()
            out.append((prefix(path) + body).strip())
            continue
        item = ((path[-1] if path else title or "").strip(), body)
        own = () if len(path) == 1 else (len(path) > 1, tuple(path[:-1]))
        size = sum(len(t) + len(b) for t, b in group)
        if not (group and own and own == kind and size < min_merge and size + len(item[0]) + len(item[1]) <= max_chars):
            close()
        if not group:
            parent, kind = list(path[:-1]), own
        group.append(item)
    close()
    return [t for t in out if t]


def chunk_udf(size: int = 600, overlap: int = 100, min_fill: int | None = None):
    @F.pandas_udf("array<string>")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: chunk_text(t, size, overlap, min_fill))

    return run


def chunk_blocks_udf(size: int = 600, overlap: int = 100):
    @F.pandas_udf("array<string>")
    def run(blocks: pd.Series) -> pd.Series:
        return blocks.map(lambda b: chunk_blocks(list(b) if b is not None else [], size, overlap))

    return run


def pack_udf(size: int = 600):
    @F.pandas_udf("array<string>")
    def run(header: pd.Series, items: pd.Series) -> pd.Series:
        return pd.Series([pack_items(h, list(i) if i is not None else [], size) for h, i in zip(header, items)])

    return run


def merge_udf(max_chars: int = 600, min_merge: int = 120, depth: int = 4):
    @F.pandas_udf("array<string>")
    def run(blocks: pd.Series) -> pd.Series:
        return blocks.map(lambda own: merge_blocks([(list(b["path"]), b["title"], b["body"], bool(b["atomic"])) for b in own], max_chars, min_merge, depth))

    return run


def chunks_of(rows, text: str, size: int = 600, overlap: int = 100, min_fill: int | None = None):
    """(doc_id, seq, text) chunks of each document, map-side."""
    pieces: Column = chunk_udf(size, overlap, min_fill)(F.col(text))
    return rows.select("doc_id", F.posexplode(pieces).alias("seq", "text"))
