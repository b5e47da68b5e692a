"""Cutting long texts into pieces for structured import."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gradeloom import fixed as V
from gradeloom.functions.text import bind


def _trim(text: Column, spaces: str) -> Column:
    return F.btrim(text, F.lit(spaces))


def _normal(text: Column, spaces: str) -> Column:
    return _trim(F.translate(text, "\r", ""), spaces)


#: Characters of a block; long texts are read by block, since every ``substring`` counts from its text's start.
BLOCK = 1024


def _blocks(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{BLOCK}}}"), F.lit(0))


def _take(blocks: Column, start: Column, count: Column) -> Column:
    """``count`` characters from ``start`` (0-based) of a text in blocks."""
    first = F.floor(start / BLOCK).cast("int")
    few = F.slice(blocks, first + 1, F.floor((start + count) / BLOCK).cast("int") - first + 1)
    return F.substring(F.array_join(few, ""), start - first * BLOCK + 1, count)


def overlapping_chunks(text: Column, size: int = V.CHUNK_CHARS, overlap: int = V.CHUNK_OVERLAP,
                       max_chunks: int | None = None, spaces: str = V.ALL_SPACES, blank: bool = False) -> Column:
    """Pieces of at most ``size`` characters, cut at a late line end, overlapping.

    The whole text is cut unless ``max_chunks`` is given.  ``spaces`` are the characters trimmed off a piece.  ``blank``
    keeps pieces without anything else, so that a place in the result is the number of the cut.
    """
    return bind(_normal(text, spaces), lambda body: bind(F.length(body), lambda n: F.when(n <= size, F.array(body)).otherwise(
        bind(_blocks(body), lambda blocks: _cut(blocks, n, size, overlap, max_chunks, spaces, blank)))))


def _cut(blocks: Column, n: Column, size: int, overlap: int, max_chunks: int | None, spaces: str, blank: bool) -> Column:
    shortest = max(1, int(size * V.CHUNK_BOUNDARY) - overlap)
    rounds = F.greatest(F.lit(1), F.ceil(n / shortest)).cast("int") + 1
    if max_chunks is not None:
        rounds = F.least(rounds, F.lit(max_chunks))
    empty = F.array().cast("array<struct<start:int,end:int>>")

    def step(acc: Column, _: Column) -> Column:
        start = acc["cursor"]
        stop = F.least(n, start + size)

        def cut_at(end: Column) -> Column:
            following = F.when(end < n, F.greatest(start + 1, end - overlap)).otherwise(end).cast("int")
            return F.struct(following.alias("cursor"), F.array_append(
                acc["cuts"], F.struct(start.alias("start"), end.alias("end"))).alias("cuts"))

        def late_line_end(piece: Column) -> Column:
            # last line end at or before ``stop`` (0-based), when late enough
            return bind(F.length(piece) - F.locate("\n", F.reverse(piece)), lambda at: F.when(
                (at < F.length(piece)) & (at > size * V.CHUNK_BOUNDARY), at))

        end = F.when(stop < n, start + F.coalesce(
            bind(_take(blocks, start, F.lit(size + 1)), late_line_end), F.lit(size))).otherwise(stop).cast("int")
        return F.when(start >= n, acc).otherwise(bind(end, cut_at))

    state = F.struct(F.lit(0).alias("cursor"), empty.alias("cuts"))
    cuts = F.aggregate(F.sequence(F.lit(1), rounds), state, step)["cuts"]
    pieces = F.transform(cuts, lambda c: _trim(_take(blocks, c["start"], c["end"] - c["start"]), spaces))
    return pieces if blank else F.filter(pieces, lambda p: p != "")


def _greedy(lengths: Column, limit: Column, max_units: int | None) -> Column:
    """Start index (0-based) of every pack when units are packed in order.

    Joining adds one line break per unit after the first.
    """
    state = F.struct(F.lit(0).alias("used"), F.lit(0).alias("units"), F.lit(0).alias("i"),
                     F.array(F.lit(0)).alias("starts"))

    def step(acc: Column, size: Column) -> Column:
        full = acc["used"] + size > limit
        if max_units is not None:
            full = full | (acc["units"] >= max_units)
        fresh = (acc["used"] > 0) & full
        return F.struct(
            F.when(fresh, size).when(acc["used"] > 0, acc["used"] + 1 + size).otherwise(size).alias("used"),
            F.when(fresh, F.lit(1)).otherwise(acc["units"] + 1).alias("units"), (acc["i"] + 1).alias("i"),
            F.when(fresh, F.array_append(acc["starts"], acc["i"])).otherwise(acc["starts"]).alias("starts"))

    return F.aggregate(lengths, state, step)["starts"]


def _packs(units: Column, starts: Column, max_chunks: int | None, spaces: str) -> Column:
    def pack(s: Column, i: Column) -> Column:
        stop = F.coalesce(F.get(starts, i + 1), F.size(units))
        count = stop - s
        if max_chunks is not None:  # the last allowed pack takes a single unit
            count = F.when(i == max_chunks - 1, F.lit(1)).otherwise(count)
        return _trim(F.array_join(F.slice(units, s + 1, count), "\n"), spaces)
    out = F.filter(F.transform(starts, pack), lambda p: p != "")
    return out if max_chunks is None else F.slice(out, 1, max_chunks)


def pack_pages(documents: DataFrame, doc: str, text: str, size: int = V.PACK_CHARS, max_chunks: int | None = None,
               split: bool = False, spaces: str = V.ALL_SPACES, anchor: str = V.ANCHOR) -> DataFrame:
    """Chunks per document, pages packed greedily; seams rejoin questions cut by a page end.

    Without page marks, texts with enough numbered questions are packed by question;
    the rest is cut with overlap.  Output: ``doc, kind, pos, chunk``.
    With ``split`` the column holds the pages themselves, as an array, and marks inside a page do not cut it.  ``spaces`` are
    the characters trimmed off chunks, ``anchor`` finds the beginnings of questions.
    """
    limit = max(V.PACK_MIN, min(size, V.PACK_MAX))
    if split:
        base = documents.select(doc, F.transform(text, lambda p: F.translate(p, "\r", "")).alias("pages"))
        base = base.withColumn("starts", _greedy(F.transform("pages", F.length), F.lit(limit), None))
        chunks = bind(F.col("pages"), lambda pages: bind(F.col("starts"), lambda starts: _packs(pages, starts, max_chunks, spaces)))
        return _with_seams(base.withColumn("kind", F.lit("pages")), doc, chunks, F.lit(True), spaces, anchor)
    base = documents.select(doc, _normal(F.col(text), spaces).alias("body"))
    base = base.withColumn("pages", F.filter(F.split("body", rf"(?={V.PAGE_MARK})"), lambda p: _trim(p, spaces) != ""))
    units = F.split(F.regexp_replace("body", f"({anchor})", "\u0001$1"), "\u0001")
    paged = F.size("pages") > 1
    base = base.withColumn("cut", F.when(~paged, bind(units, lambda u: F.slice(u, F.lit(2), F.size(u)))))
    base = base.withColumn("units", F.filter(F.transform("cut", lambda u: _trim(u, spaces)), lambda u: u != ""))
    by_question = F.size("cut") >= V.PACK_ANCHORS
    base = base.withColumn("kind", F.when(paged, "pages").when(by_question, "questions").otherwise("overlap"))
    base = base.withColumn("parts", F.when(paged, F.col("pages")).when(by_question, F.col("units")))
    lengths = F.transform("parts", lambda p: F.length(p))
    base = base.withColumn("starts", F.when(paged, _greedy(lengths, F.lit(limit), None)).when(
        by_question, _greedy(lengths, F.lit(limit), V.PACK_QUESTIONS)))
    chunks = F.when(F.col("kind") == "overlap", overlapping_chunks(F.col("body"), min(limit, V.PACK_FALLBACK), max_chunks=max_chunks, spaces=spaces)
                    ).otherwise(bind(F.col("parts"), lambda units: bind(
                        F.col("starts"), lambda starts: _packs(units, starts, max_chunks, spaces))))
    return _with_seams(base, doc, chunks, paged, spaces, anchor)


def _with_seams(base: DataFrame, doc: str, chunks: Column, paged: Column, spaces: str, anchor: str) -> DataFrame:
    plain = F.transform(chunks, lambda c, i: F.struct(F.col("kind").alias("kind"), i.alias("pos"), c.alias("chunk")))
    seams = F.when(paged, bind(F.col("pages"), lambda pages: F.transform(
        F.slice("starts", F.lit(2), F.size("starts")), lambda b: _seam(b, F.get(pages, b - 1), F.get(pages, b), spaces, anchor))))
    found = F.concat(plain, F.coalesce(F.filter(seams, lambda s: s.isNotNull()), F.slice(plain, 1, 0)))
    # Outer: an inner explode would work the array out again to filter empty ones beforehand.
    return base.select(doc, F.explode_outer(found).alias("c")).where("c is not null").select(doc, "c.*")


def _seam(b: Column, left: Column, right: Column, spaces: str, anchor: str) -> Column:
    """The question that a page end cuts: its tail on one page and its head on the next; null when none is cut."""
    pieces = F.split(F.regexp_replace(left, f"({anchor})", "\u0001$1"), "\u0001")
    next_start = rf"\A([\s\S]{{21,}}?){anchor}"
    head = _trim(F.when(right.rlike(next_start), F.regexp_extract(right, next_start, 1)).otherwise(F.substring(right, 1, V.SEAM_HEAD)), spaces)

    def joined(tail: Column, head: Column) -> Column:
        cut = (F.regexp_count(tail, F.lit(V.OPTION_LINE)) < 2) & (F.regexp_count(F.concat_ws("\n", tail, head), F.lit(V.OPTION_LINE)) >= 2)
        name = F.format_string("[[CROSS_PAGE_SEAM %d-%d]]", b, b + 1)
        return F.when(cut, F.struct(F.lit("seam").alias("kind"), b.alias("pos"), F.concat_ws("\n", name, tail, head).alias("chunk")))
    return F.when(left.rlike(anchor), bind(_trim(F.element_at(pieces, -1), spaces), lambda tail: bind(head, lambda head: joined(tail, head))))


def answer_reference(text: Column, size: int | None = None, lines: int | None = None) -> Column:
    """The text from its first answer mention on; the whole text where there is none.

    ``lines`` takes so many lines from every mention instead, ``size`` bounds the result; both are off by default.
    """
    return bind(F.translate(text, "\r", ""), lambda body: bind(
        F.split(body, "\n"), lambda rows: _mentions(body, rows, size, lines)))


def _mentions(body: Column, rows: Column, size: int | None, lines: int | None) -> Column:
    hits = F.filter(F.transform(rows, lambda r, i: F.when(r.rlike(V.ANSWER_HINT), i)), lambda i: i.isNotNull())
    if lines is None:
        joined = F.array_join(F.slice(rows, F.get(hits, F.lit(0)) + 1, F.size(rows)), "\n")
    else:
        joined = F.array_join(F.transform(hits, lambda i: F.array_join(F.slice(rows, i + 1, F.lit(lines)), "\n")), "\n---\n")
    if size is None:
        return F.when(F.size(hits) > 0, joined).otherwise(body)
    return F.when(F.size(hits) > 0, F.substring(joined, 1, size)).otherwise(F.right(body, F.lit(size)))
