"""Cutting bodies into passages under a budget, with the bytes each passage comes from."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import partial
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from sieveline.errors import SchemaError
from sieveline.functions.analysis import passage_text
from sieveline.storage import refuse_clash

#: White space of the chunker, as a fixed list of code points.
WHITE = "\t\n\x0b\x0c\r \x85\xa0     　" + "".join(map(chr, range(0x2000, 0x200B)))
_RUN, _WORD = re.compile(f"[{WHITE}]+"), re.compile(f"[^{WHITE}]+")
_BLANK, _STOP = re.compile(r"\n[ \t\r]*\n"), re.compile(f"(?<=[.!?])(?=[{WHITE}])")
#: Positions of the window that title and passage share.
TITLE_WINDOW = 256

Cost = Callable[[str], int]


@dataclass(frozen=True)
class Passage:
    text: str
    byte_start: int
    byte_end: int
    cost: int


_POSITION = re.compile(r"[^\W_]+|[^\w\s]|_")


def position_cost(text: str) -> int:
    """Content positions of a text, without the two marks of the window."""
    return len(_POSITION.findall(text))


def word_cost(text: str) -> int:
    return len(_WORD.findall(text))


def _trimmed(body: str, start: int, end: int) -> tuple[int, int]:
    while start < end and body[start] in WHITE:
        start += 1
    while end > start and body[end - 1] in WHITE:
        end -= 1
    return start, end


def _between(body: str, start: int, end: int, stops: Iterator[tuple[int, int]]) -> Iterator[tuple[int, int]]:
    at = start
    for a, b in [*stops, (end, end)]:
        span = _trimmed(body, at, a)
        if span[0] < span[1]:
            yield span
        at = b


def _finer(body: str, level: int, start: int, end: int) -> Iterator[tuple[int, int]]:
    """The spans a unit is replaced by: of a paragraph its sentences, of these their words, of these halves."""
    if level == 0:
        yield from _between(body, start, end, ((m.start(), m.end()) for m in _STOP.finditer(body, start, end)))
    elif level == 1:
        yield from (m.span() for m in _WORD.finditer(body, start, end))
    else:
        half, at, used = len(body[start:end].encode()) // 2, start, 0
        while used < half or at == start:
            used += len(body[at].encode())
            at += 1
        yield from ((start, at), (at, end)) if at < end else ((start, end),)


def chunk(body: str | None, budget: int, cost: Cost = word_cost) -> list[Passage]:
    """Passages of a body whose units cost at most `budget` together.

    Units are paragraphs; one that does not fit alone gives way to its sentences, these to their words, these to
    halves. A part whose half has no character border within it stands even if it does not fit. Units are packed in order: one that does
    not fit beside what the passage has opens the next. Text: units with white space collapsed, joined by a space, or
    by a line feed where a paragraph begins. No body or budget 0: no passage.
    """
    if not body or budget <= 0:
        return []
    done: list[list] = []
    pack: list[tuple[int, int, str, bool]] = []
    spent = 0

    def place(level: int, start: int, end: int, opens: bool) -> None:
        nonlocal spent, pack
        text = body[start:end] if level >= 2 else _RUN.sub(" ", body[start:end])
        price = cost(text)
        if price > budget:
            finer = list(_finer(body, min(level, 2), start, end))
            if level < 2 or len(finer) > 1:
                for i, (a, b) in enumerate(finer):
                    place(level + 1, a, b, opens and i == 0)
                return
        if pack and spent + price > budget:
            done.append([pack, spent])
            pack, spent = [], 0
        pack.append((start, end, text, opens))
        spent += price

    for start, end in _between(body, 0, len(body), ((m.start(), m.end()) for m in _BLANK.finditer(body))):
        place(0, start, end, True)
    if pack:
        done.append([pack, spent])
    passages, seen, byte = [], 0, 0
    for units, price in done:
        first, last = units[0][0], units[-1][1]
        byte += len(body[seen:first].encode())
        begin = byte
        byte += len(body[first:last].encode())
        seen = last
        text = units[0][2] + "".join(("\n" if opens else " ") + t for _, _, t, opens in units[1:])
        passages.append(Passage(text, begin, byte, price))
    return passages


MADE = "ordinal int, passage string, byte_start long, byte_end long, cost int"


def _chunk_batches(batches: Iterator[pd.DataFrame], cost: Cost) -> Iterator[pd.DataFrame]:
    for rows in batches:
        keys = [c for c in rows.columns if c not in ("__body", "__budget")]
        owners, made = [], []
        for i, (body, most) in enumerate(zip(rows["__body"], rows["__budget"])):
            for ordinal, p in enumerate(chunk(body, int(most), cost) if most == most and most is not None else []):
                owners.append(i)
                made.append((ordinal, p.text, p.byte_start, p.byte_end, p.cost))
        out = rows[keys].iloc[owners].reset_index(drop=True)
        for j, (name, kind) in enumerate((("ordinal", "int32"), ("passage", "object"), ("byte_start", "int64"), ("byte_end", "int64"), ("cost", "int32"))):
            out[name] = pd.Series([m[j] for m in made], dtype=kind)
        yield out


def chunk_table(df: DataFrame, keys: list[str], body: str, budget: int | Column, cost: Cost = word_cost) -> DataFrame:
    """keys and the columns of MADE for each passage of each body; no shuffle."""
    refuse_clash(keys, ["ordinal", "passage", "byte_start", "byte_end", "cost"])
    rows = df.select(*keys, F.col(body).alias("__body"), (budget if isinstance(budget, Column) else F.lit(budget)).cast("int").alias("__budget"))
    schema = StructType([*rows.schema.fields[:-2], *StructType.fromDDL(MADE).fields])
    return rows.where(F.col("__body").isNotNull()).mapInPandas(partial(_chunk_batches, cost=cost), schema)


def article_documents(articles: DataFrame, window: int = TITLE_WINDOW, cost: Cost = position_cost) -> DataFrame:
    """Passages of articles (id, title, text) as documents with provenance.

    The budget of an article is the window less the positions of its title with two marks. external_id is
    <id>#<ordinal>, the text is title, blank line, passage. An article whose title fills the window is an error.
    """

    def titles(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            used = [cost(t or "") + 2 for t in rows["title"]]
            if any(u >= window for u in used):
                raise SchemaError("a title alone fills the window")
            yield rows.assign(budget=[window - u for u in used])

    kinds = dict(articles.dtypes)
    priced = articles.select("id", "title", "text").mapInPandas(titles, f"id {kinds['id']}, title string, text string, budget int")
    parts = chunk_table(priced, ["id", "title"], "text", F.col("budget"), cost)
    parent = F.col("id").cast("string")
    return parts.select(F.concat(parent, F.lit("#"), F.col("ordinal").cast("string")).alias("external_id"), "title", passage_text(F.col("title"), F.col("passage")).alias("text"), F.struct(parent.alias("parent"), "ordinal", "byte_start", "byte_end").alias("chunk"))


class Splitter(Protocol):
    def split(self, text: str) -> list[str]: ...


def bound_and_merge(pieces: list[str], text: str, window: int, least: int = 16, cost: Cost = position_cost) -> list[str]:
    """Pieces of a pluggable splitter made fit: they must tile the text; small ones join the next (the last one the
    one before), those over the window are chunked."""
    if "".join(pieces) != text:
        raise SchemaError("the splitter's pieces are not the text")
    merged: list[str] = []
    held = ""
    for p in pieces:
        held += p
        if cost(held) >= least:
            merged.append(held)
            held = ""
    if held.strip():
        merged = [*merged[:-1], merged[-1] + held] if merged else [held]
    out: list[str] = []
    for m in merged:
        out += [m.strip()] if cost(m) <= window else [p.text for p in chunk(m, window, cost)]
    return [o for o in out if o]


def split_table(df: DataFrame, keys: list[str], text: str, splitter: Splitter, window: int, least: int = 16, cost: Cost = position_cost) -> DataFrame:
    """keys, ordinal and passage: each text through a pluggable splitter, made fit by bound_and_merge; no shuffle.

    Null and blank texts: no row. A splitter whose pieces are not the text is an error.
    """
    refuse_clash(keys, ["ordinal", "passage"])
    rows = df.select(*keys, F.col(text).alias("__text")).where(F.col("__text").isNotNull())
    schema = StructType([*rows.schema.fields[:-1], *StructType.fromDDL("ordinal int, passage string").fields])

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            parts = [bound_and_merge(splitter.split(t), t, window, least, cost) for t in batch["__text"]]
            owners = [i for i, p in enumerate(parts) for _ in p]
            out = batch[keys].iloc[owners].reset_index(drop=True)
            out["ordinal"] = pd.Series([j for p in parts for j in range(len(p))], dtype="int32")
            out["passage"] = pd.Series([x for p in parts for x in p], dtype="object")
            yield out

    return rows.mapInPandas(work, schema)


def verify_passages(passages: DataFrame, window: int, positions: Column, url_matches: Column) -> DataFrame:
    """One row of counts: passages, those above the window, those whose URL does not match."""
    return passages.agg(F.count("*").alias("passages"), F.coalesce(F.sum((positions > window).cast("long")), F.lit(0)).alias("passages_over_window"), F.coalesce(F.sum((~url_matches).cast("long")), F.lit(0)).alias("url_mismatches"))
