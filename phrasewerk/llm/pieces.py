"""Problem 4: oversized items cut at natural boundaries, by ranges with halos.

Every item, a line of a table or a giant file, is cut in ranges; a range knows its own text and a halo to its right.
Where a piece begins decides all that follows, so each range with another one behind it works out, for every place at
which a piece may enter it, where the first piece of the next range begins and how many pieces it holds. These short
boundary tables are composed as a tree, blocks of ranges to one table each, and read back downwards: that stitches the
ranges and gives each its entry, and the prefix sums of lengths and of piece numbers before it. Then every range emits
its pieces by offset. No worker holds more of a file than a range, and no more of the tables than a block.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from phrasewerk.llm.common import written

#: Characters of a piece at most, shared by consecutive pieces at most, of an item's range, and bytes of a file's range.
LIMIT, OVERLAP, RANGE, FILE_RANGE = 400, 100, 2_048, 1 << 18
#: Boundary tables that are composed to one.
BLOCK = 64
_SENTENCE = re.compile(r"[.!?;:…。][\"')\]’”»]*(?=\s)|(?=[\r\n])")
_RUN = re.compile(r"\S+")


class Cuts:
    """The natural boundaries of a text, found once: words (runs without whitespace) and ends of lines and sentences."""

    def __init__(self, text: str, limit: int, overlap: int, ends_here: bool):
        self.size, self.limit, self.overlap, self.ends_here = len(text), limit, overlap, ends_here
        runs = [m.span() for m in _RUN.finditer(text)]
        self.begins, self.ends = [b for b, _ in runs], [e for _, e in runs]
        marks = [m.span() for m in _SENTENCE.finditer(text)]
        self.marks, self.mark_ends = [b for b, _ in marks], [e for _, e in marks]

    def next_piece(self, start: int) -> tuple[int, int, int, bool] | None:
        """(begin, end, next start, hard) of the piece that begins at or after *start*; None if only whitespace is left.

        The end is the last line or sentence end in the second half of the window, else its last whitespace, else
        *limit* characters (hard). The next piece begins at the first word within *overlap* characters before the end
        if it gets beyond that end, else at the next word; after a hard cut, *overlap* characters before it. The text
        must reach 2 * limit + overlap beyond start unless the item ends with it.
        """
        j = bisect_right(self.ends, start)
        if j == len(self.ends):
            return None
        begin = max(start, self.begins[j])
        end, hard = self.end_of(begin)
        if end >= self.size and self.ends_here:
            return begin, end, self.size, hard
        if hard:
            return begin, end, end - self.overlap, hard
        if self.overlap:
            t = bisect_left(self.begins, max(begin + 1, end - self.overlap))
            if t < len(self.begins) and self.begins[t] < end and self.end_of(self.begins[t])[0] > end:
                return begin, end, self.begins[t], hard
        return begin, end, end, hard

    def end_of(self, begin: int) -> tuple[int, bool]:
        stop = begin + self.limit
        if stop >= self.size and self.ends_here:
            return self.ends[-1], False
        i = bisect_right(self.mark_ends, stop) - 1
        if i >= 0 and self.marks[i] >= begin + self.limit // 2:
            return self.mark_ends[i], False
        i = bisect_right(self.begins, stop) - 1
        if self.ends[i] <= stop < self.size:  # whitespace at the stop
            return self.ends[i], False
        return (self.ends[i - 1], False) if self.begins[i] > begin else (stop, True)


def pieces_of(text: str, limit: int = LIMIT, overlap: int = OVERLAP) -> list[tuple[int, int, bool]]:
    """(begin, end, hard) of every piece of an item that is one range; within the limit it is one piece, unchanged; a longer one of whitespace has none."""
    if len(text) <= limit:
        return [(0, len(text), False)]
    return _pieces_from(Cuts(text, limit, overlap, True), len(text), 0)


def _table(text: str, core: int, limit: int, overlap: int, last: bool) -> tuple[list[int], list[int]]:
    """For each entry 0..limit+1 of a range of *core* characters: the entry of the next range, and the pieces that begin in the range."""
    cuts = Cuts(text, limit, overlap, last)
    known: dict[int, tuple[int, int]] = {}
    exits, counts = [], []
    for entry in range(limit + 2):
        path, at = [], entry
        while at < core and at not in known:
            p = cuts.next_piece(at)
            if not p or p[0] >= core:  # up to the next range's first word there is only whitespace
                known[at] = (0, 0)
                break
            path.append(at)
            at = p[2]
        exit_, n = known[at] if at in known else (at - core, 0)
        for x in reversed(path):
            n += 1
            known[x] = (exit_, n)
        exits.append(exit_)
        counts.append(n)
    return exits, counts


def _pieces_from(cuts: Cuts, core: int, entry: int) -> list[tuple[int, int, bool]]:
    out, at = [], entry
    while at < core and (p := cuts.next_piece(at)):
        if p[0] >= core:  # it begins behind leading whitespace in the next range
            break
        out.append((p[0], p[1], p[3]))
        at = p[2]
    return out


_TABLE = "item string, nr long, core long, exits array<int>, counts array<long>"
_ENTRY = "item string, nr long, base long, entry int, before long"


def _blocks(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[tuple, object, bool]]:
    """(item and block, row, whether the block begins with it) of rows in order; a block may go on in the next batch."""
    now = None
    for pdf in batches:
        for r in pdf.itertuples():
            key = (r.item, r.block)
            yield key, r, key != now
            now = key


def _composed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The tables of each block in order as one."""
    held: list = []

    def done() -> pd.DataFrame:
        (item, block), core, exits, counts = held
        return pd.DataFrame({"item": [item], "nr": [block], "core": [core], "exits": [exits.astype(np.int32)], "counts": [counts]})

    for key, r, first in _blocks(batches):
        if first:
            if held:
                yield done()
            held = [key, 0, np.arange(len(r.exits)), np.zeros(len(r.exits), np.int64)]
        held[1] += int(r.core)
        held[3] = held[3] + np.asarray(r.counts)[held[2]]
        held[2] = np.asarray(r.exits)[held[2]]
    if held:
        yield done()


def _descended(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(item, nr, base, entry, before) of the range behind each of a block, from where the block begins."""
    rows, base, entry, before = [], 0, 0, 0
    for (item, _), r, first in _blocks(batches):
        if first:
            base, entry, before = int(r.b0), int(r.e0), int(r.n0)
        before += int(r.counts[entry])
        entry = int(r.exits[entry])
        base += int(r.core)
        rows.append((item, r.nr + 1, base, entry, before))
        if len(rows) == 10_000:
            yield pd.DataFrame(rows, columns=["item", "nr", "base", "entry", "before"])
            rows = []
    yield pd.DataFrame(rows, columns=["item", "nr", "base", "entry", "before"])


def stitched(tables: DataFrame) -> DataFrame:
    """(item, nr, base, entry, before) of every range but an item's first, from the boundary tables of all but its last.

    base is the prefix sum of the ranges' lengths, entry the place of the range's first piece in it, before the prefix
    sum of the pieces. Levels of the tree: the logarithm of the ranges of the longest item to the base BLOCK.
    """
    level = written(tables, "tables")
    levels = [level]
    most = level.agg(F.max("nr")).first()[0] or 0
    n = BLOCK
    block = F.floor(F.col("nr") / n)
    in_order = lambda rows: rows.repartition("item", "block").sortWithinPartitions("item", "block", "nr")
    while most >= n:
        level = written(in_order(level.withColumn("block", block)).mapInPandas(_composed, _TABLE), "tables")
        levels.append(level)
        most //= n
    starts = None
    for level in reversed(levels):
        rows = level.withColumn("block", block)
        if starts is not None:
            rows = rows.join(starts.select("item", F.col("nr").alias("block"), F.col("base").alias("b0"), F.col("entry").alias("e0"), F.col("before").alias("n0")), ["item", "block"], "left")
        else:
            rows = rows.withColumns({"b0": F.lit(0), "e0": F.lit(0), "n0": F.lit(0)})
        rows = rows.fillna(0, ["b0", "e0", "n0"])  # an item's first block
        starts = in_order(rows).mapInPandas(_descended, _ENTRY)
        if level is not levels[0]:
            starts = written(starts, "starts")
    return starts


def _halo(limit: int, overlap: int) -> int:
    return 2 * limit + overlap + 1


def split_items(items: DataFrame, keys: list[str], text: str, limit: int = LIMIT, overlap: int = OVERLAP, size: int = RANGE) -> DataFrame:
    """(keys, piece_no, begin, end, hard, piece): the pieces of every item, in characters from 0, ends exclusive.

    An item within the limit is one piece, also an empty one; a longer one of mere whitespace and a null text have
    none; rows repeated under equal keys (null keys included) count once, the smallest text staying. A piece has at
    most *limit* characters; whitespace between pieces belongs to none. hard marks a cut inside a stretch of more than
    *limit* characters without whitespace. Items are cut in ranges of *size* characters.
    """
    if not 0 <= overlap < limit or size < 4 * limit:
        raise ValueError("0 <= overlap < limit and size >= 4 * limit are needed")
    named = items.where(F.col(text).isNotNull()).select(*keys, F.col(text).alias("_text"))
    once = named.groupBy(*keys).agg(F.min("_text").alias("_text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in once.select(*keys).schema)
    halo = _halo(limit, overlap)

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows, held = [], 0
            for i, t in zip(pdf["item"], pdf["_text"]):
                for nr, a in enumerate(range(0, max(1, len(t)), size)):
                    rows.append((i, nr, min(size, len(t) - a), a + size < len(t), a + size + halo >= len(t), t[a : a + size + halo]))
                    held += size
                    if held > 16_000_000:  # characters
                        yield pd.DataFrame(rows, columns=["item", "nr", "core", "more", "last", "body"])
                        rows, held = [], 0
            yield pd.DataFrame(rows, columns=["item", "nr", "core", "more", "last", "body"])

    item = F.to_json(F.struct(*keys), {"ignoreNullFields": "false"}).alias("item")
    ranges = written(once.select(item, "_text").mapInPandas(cut, "item string, nr long, core int, more boolean, last boolean, body string"), "ranges")

    def tables(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            made = [_table(t, c, limit, overlap, x) for t, c, x in zip(pdf["body"], pdf["core"], pdf["last"])]
            yield pdf[["item", "nr", "core"]].assign(exits=[x for x, _ in made], counts=[n for _, n in made])

    entries = stitched(ranges.where("more").mapInPandas(tables, _TABLE))

    def emit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for item, base, entry, before, core, last, single, t in zip(pdf["item"], pdf["base"], pdf["entry"], pdf["before"], pdf["core"], pdf["last"], pdf["single"], pdf["body"]):
                got = pieces_of(t, limit, overlap) if single else _pieces_from(Cuts(t, limit, overlap, last), core, entry)
                out += [(item, before + k, base + b, base + e, h, t[b:e]) for k, (b, e, h) in enumerate(got)]
            yield pd.DataFrame(out, columns=["item", "piece_no", "begin", "end", "hard", "piece"])

    zero = {"base": F.lit(0).cast("long"), "entry": F.lit(0), "before": F.lit(0).cast("long")}
    heads = ranges.where("nr = 0").withColumns(zero).withColumn("single", ~F.col("more"))  # they begin at 0: nothing to join
    tails = ranges.where("nr > 0").join(entries, ["item", "nr"]).withColumn("single", F.lit(False))
    cols = ["item", "base", "entry", "before", "core", "last", "single", "body"]
    pieces = heads.select(*cols).unionByName(tails.select(*cols)).mapInPandas(emit, "item string, piece_no long, begin long, end long, hard boolean, piece string")
    struct = F.from_json("item", schema).alias("_k")
    return pieces.select(struct, "*").select(*[F.col("_k")[k].alias(k) for k in keys], "piece_no", "begin", "end", "hard", "piece")


def _range_of_file(path: str, nr: int, size: int, halo: int) -> tuple[str, int, bool, bool]:
    """The text of a byte range with its halo, the characters that begin in the range itself, whether more of them follow, and whether the file ends in the halo."""
    from pyarrow import fs

    where, name = fs.FileSystem.from_uri(path)
    with where.open_input_file(name) as f:
        f.seek(nr * size)
        raw = f.read(size + 4 * halo)
        last, more = nr * size + len(raw) >= f.size(), (nr + 1) * size < f.size()
    skip = 0
    while skip < min(3, len(raw)) and raw[skip] & 0xC0 == 0x80:  # a character that began in the range before
        skip += 1
    core = raw[skip:size]
    tail = size
    while tail < len(raw) and raw[tail] & 0xC0 == 0x80:  # one that ends in the next
        core += raw[tail : tail + 1]
        tail += 1
    text = raw[skip:].decode("utf-8", "replace" if last else "ignore")
    return text, len(core.decode("utf-8", "replace")), more, last


def split_files(spark: SparkSession, path: str, limit: int = LIMIT, overlap: int = OVERLAP, size: int = FILE_RANGE) -> DataFrame:
    """(item, piece_no, begin, end, hard, piece): the pieces of every UTF-8 file of *path*, item being the file's URI.

    Files are listed without reading them and read by byte ranges, once for the boundary tables and once for the
    pieces; no worker holds more than a range of a file. An empty file has no piece. Broken bytes become U+FFFD.
    """
    files = spark.read.format("binaryFile").load(path).select(F.col("path").alias("item"), "length").where("length > 0")
    ranges = files.select("item", F.explode(F.sequence(F.lit(0), F.floor((F.col("length") - 1) / size))).alias("nr")).repartition("item", "nr")
    halo = _halo(limit, overlap)

    def tables(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for r in pdf.itertuples():
                text, core, more, last = _range_of_file(r.item, r.nr, size, halo)
                if more:
                    exits, counts = _table(text, core, limit, overlap, last)
                    yield pd.DataFrame({"item": [r.item], "nr": [r.nr], "core": [core], "exits": [exits], "counts": [counts]})

    entries = stitched(ranges.mapInPandas(tables, _TABLE))
    heads = files.select("item", F.lit(0).cast("long").alias("nr"), F.lit(0).cast("long").alias("base"), F.lit(0).alias("entry"), F.lit(0).cast("long").alias("before"))

    def emit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for r in pdf.itertuples():
                text, core, more, last = _range_of_file(r.item, r.nr, size, halo)
                got = pieces_of(text, limit, overlap) if not more and not r.nr else _pieces_from(Cuts(text, limit, overlap, last), core, r.entry)
                if got:
                    yield pd.DataFrame([(r.item, r.before + k, r.base + b, r.base + e, h, text[b:e]) for k, (b, e, h) in enumerate(got)], columns=["item", "piece_no", "begin", "end", "hard", "piece"])

    starts = heads.unionByName(entries).repartition("item", "nr")
    return starts.mapInPandas(emit, "item string, piece_no long, begin long, end long, hard boolean, piece string")
