"""Operator 8, repeated passages: interleaving shards' Burrows-Wheeler rows by iterative refinement.

A byte goes if a ``WINDOW``-byte string over it also starts in a document with a smaller id.

1. Candidates. Equal windows hold equal anchors (see ``anchors``) at equal places. Each step of a task names its anchors;
   those whose whole segment already stood in a smaller document of the step are decided there, so copies and common
   passages send one row a step and not one an occurrence.
2. Anchors meet by key. Where all segments are equal they are one repeated interval, decided at once. Where they
   differ, their strings are fetched and meet by the 33 bytes around the anchor that every window on that side shares.
3. The strings of the batches that meet are dealt into shards. Each shard sorts its suffixes, which gives its
   Burrows-Wheeler transform and its common prefixes. The transforms are merged by iterative interleave refinement: all rows
   start in one interval, shard after shard; each round moves every row to the row of the symbol before it (the transform's
   last-to-first step) and deals the rows out by that symbol, stably. After round h the merged rows stand in the order of
   their next h symbols and an interval ends where two neighbours' common prefix is shorter than h. No suffixes of different
   shards are compared or sorted anew. An interval of one row cannot grow and one of a single shard's rows is decided by
   that shard's common prefixes, so both leave the merge. Intervals that last for all ``WINDOW`` rounds are the repeated
   windows; each removes its bytes in all documents but the smallest.

Null texts are empty; a row with a null id loses nothing and causes no removal. Rows that share an id are one document:
they remove nothing from each other, and should their texts differ, what goes from one goes from each, within its
length. Texts under ``WINDOW`` bytes stay whole. Long texts are scanned in overlapping pieces. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from normalog.llm.anchors import GRAM, REACH, WINDOW, Anchored
from normalog.llm.common import cut, small_batches, steps, table

STEP, PIECE, OVERLAP = 3 << 20, 2 << 20, 4 * WINDOW
HALF = REACH // 2
ROWS = 200_000
#: Symbols in a suffix's first sort key.
HEAD = 7


def merged(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The union of intervals as maximal runs, ascending."""
    at = np.argsort(start, kind="stable")
    start, end = start[at], np.maximum.accumulate(end[at])
    first = np.r_[True, start[1:] > end[:-1]]
    return start[first], end[np.r_[np.flatnonzero(first)[1:] - 1, len(end) - 1]] if len(start) else end


def anchors_of(ids: np.ndarray, texts: list[bytes]) -> tuple[np.ndarray, ...]:
    """doc, place, left, right, key, segment of all anchors; long texts in pieces."""
    doc, offset, piece, whole = [], [], [], []
    for i, t in zip(ids, texts, strict=True):
        for a in range(0, max(1, len(t) - OVERLAP), PIECE):
            doc.append(i)
            offset.append(a)
            piece.append(t[a : a + PIECE + OVERLAP])
            whole.append((a == 0, a + PIECE + OVERLAP >= len(t)))
    x = Anchored(piece)
    doc, offset, whole = np.array(doc), np.array(offset, np.int64), np.array(whole)
    d = x.doc
    # a segment cut by a piece's border, not its text's, is whole in the neighbouring piece
    good = (whole[d, 0] | (x.place - x.left == REACH)) & (whole[d, 1] | (x.right - x.place == WINDOW)) if len(d) else d.astype(bool)
    shift = (offset - x.start)[d]
    return tuple(v[good] for v in (doc[d] if len(d) else d, x.place + shift, x.left + shift, x.right + shift, x.key, x.segment))


def name_anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, doc, seg, pos, n): n = 0 for an anchor that must meet others; else [pos, pos + n) goes."""
    for batch in batches:
        for a, b in steps(batch.column(2).to_pylist(), STEP):
            ids = batch.column(0).slice(a, b - a).to_numpy()
            doc, place, left, right, key, seg = anchors_of(ids, batch.column(1).slice(a, b - a).to_pylist())
            at = np.lexsort((place, doc, seg, key))
            doc, place, left, right, key, seg = (v[at] for v in (doc, place, left, right, key, seg))
            if not len(key):
                continue
            first = np.r_[True, (key[1:] != key[:-1]) | (seg[1:] != seg[:-1])]
            leads = doc == doc[np.flatnonzero(first)[np.cumsum(first) - 1]]
            out = [[key[leads], doc[leads], seg[leads] >> 32, place[leads], np.zeros(leads.sum(), np.int64)]]
            doc, left, right = doc[~leads], left[~leads], right[~leads]
            if len(doc):
                # runs of each document: documents are set apart on one line
                names, of = np.unique(doc, return_inverse=True)
                line = 1 << 34
                s, e = merged(of * line + left, of * line + right)
                d = names[s // line]
                out.append([(s * 0x9E3779B97F4A7C1 ^ d * 0x2545F491) & (2**62 - 1), d, s * 0, s % line, e - s])
            key, doc, seg, pos, n = (np.concatenate(v) for v in zip(*out, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(doc), pa.array(seg.astype(np.int32)), pa.array(pos.astype(np.int32)), pa.array(n.astype(np.int32))], ["key", "doc", "seg", "pos", "n"])


def blocks(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.Table]:
    """Tables of about ``rows`` rows."""
    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += len(batch)
        if n >= rows:
            yield pa.Table.from_batches(held)
            held, n = [], 0
    if n:
        yield pa.Table.from_batches(held)


def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Anchors sorted by (key, doc) to (doc, pos, n): n > 0 goes; n = 0 needs its string compared."""
    last = None
    for t in blocks(batches, 4 * ROWS):
        key, doc, seg, pos, n = (t.column(i).to_numpy() for i in range(5))
        head = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        size = np.diff(np.r_[head, len(key)])
        lead_doc, lead_seg = doc[head].copy(), seg[head].copy()
        opened = np.zeros(len(head), bool)
        if last and last[0] == key[0]:
            lead_doc[0], lead_seg[0] = last[1:]
        # a key that may go on in the next block keeps its smallest document's rows in the game, be it one row
        opened[-1] = True
        last = key[-1], lead_doc[-1], lead_seg[-1]
        later = doc > np.repeat(lead_doc, size)
        same = seg == np.repeat(lead_seg, size)
        differs = np.add.reduceat((later & ~same).astype(np.int64), head) > 0
        ask = (n == 0) & ((later & ~same) | (~later & np.repeat(differs | opened, size)))
        goes = (n > 0) | (later & same)
        keep = ask | goes
        # a decided anchor stands for its segment, which its text's borders cut
        n = np.where(n > 0, n, np.where(goes, -1, 0))
        if keep.any():
            yield pa.RecordBatch.from_arrays([pa.array(doc[keep]), pa.array(pos[keep]), pa.array(n[keep].astype(np.int32))], ["doc", "pos", "n"])


def strings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each asked anchor its string left and right of it: (sub, doc, at, s)."""
    import xxhash

    for batch in batches:
        out = []
        for doc, text, places in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            for p in places:
                if p - HALF >= 0 and p + GRAM <= len(text):
                    s = text[max(0, p - REACH) : p + GRAM + HALF]
                    if len(s) >= WINDOW:
                        out.append((xxhash.xxh64_intdigest(text[p - HALF : p + GRAM], 1) - (1 << 63), doc, max(0, p - REACH), s))
                s = text[max(0, p - HALF + 1) : p + WINDOW]
                if p + GRAM + HALF <= len(text) and len(s) >= WINDOW:
                    out.append((xxhash.xxh64_intdigest(text[p : p + GRAM + HALF], 2) - (1 << 63), doc, max(0, p - HALF + 1), s))
        for i in range(0, len(out), ROWS // 4):
            sub, doc, at, s = zip(*out[i : i + ROWS // 4], strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(sub, pa.int64()), pa.array(doc, pa.int64()), pa.array(at, pa.int32()), pa.array(s, pa.binary())], ["sub", "doc", "at", "s"])


class Shard:
    """Suffixes of a shard's strings in order, each string ended by a terminator of its own, which sorts first.

    By row: ``place`` in the text, ``symbol`` before it (the Burrows-Wheeler transform; -1 before a string's start), ``back``,
    the row of the suffix one symbol longer. ``full`` are the rows of whole windows, ``common`` their common prefix with the
    row above in ``full``, up to a window.
    """

    def __init__(self, strings: list[bytes], window: int = WINDOW):
        self.size = np.array([len(s) for s in strings], np.int64)
        last = np.cumsum(self.size + 1) - 1
        self.start = last - self.size
        n = last[-1] + 1 if len(last) else 0
        self.text = text = np.frombuffer(b"\0".join(strings) + b"\0", np.uint8)[:n]
        self.of = np.repeat(np.arange(len(strings), dtype=np.int32), self.size + 1)
        self.left = left = (last[self.of] - np.arange(n)).astype(np.int32)
        code = text.astype(np.int64) + 1
        code[last] = 0
        key = code.copy()
        for i in range(1, min(HEAD, n)):
            key[:-1] = code[:-1] * 257**i + key[1:]
            key[last] = 0
        # rows with equal keys stand in any order for now, but those that end within the key, which are done
        self.place = place = np.argsort(key).astype(np.int32)
        short = np.flatnonzero(left[place] < HEAD)
        place[short] = place[short][np.lexsort((place[short], key[place[short]]))]
        key = key[place]
        edge = np.r_[n > 0, key[1:] != key[:-1]][:n]
        edge[short] = True
        lead = lambda edge, rows: rows[np.maximum.accumulate(np.where(edge, np.arange(len(rows)), 0))]
        rank = np.empty(n, np.int64)
        rank[place] = lead(edge, np.arange(n))
        h = HEAD
        # twice as many symbols a round; only rows not yet alone are dealt anew
        while len(tied := np.flatnonzero(~(edge & np.r_[edge[1:], True][:n]))):
            p = place[tied]
            key = rank[p] * n + rank[p + h]
            turn = np.argsort(key)
            place[tied], key = p[turn], key[turn]
            edge[tied] = np.r_[True, key[1:] != key[:-1]]
            rank[place[tied]] = lead(edge[tied], tied)
            h *= 2
        self.symbol = (code[place - 1] - 1).astype(np.int16)
        self.row = np.empty(n, np.int32)
        self.row[place] = np.arange(n)
        self.back = self.row[place - 1]
        self.full = np.flatnonzero(left[place] >= window)
        self.common = np.zeros(len(self.full), np.int32)
        above, below = place[self.full[:-1]], place[self.full[1:]]
        going = np.arange(len(below))
        for h in range(window):
            going = going[text[above[going] + h] == text[below[going] + h]]
            self.common[going + 1] = h + 1


def interleave(shards: list[Shard]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The merged transform of all shards: by merged row its shard, symbol and common prefix with the row above."""
    count = np.array([len(x.place) for x in shards], np.int64)
    base = np.cumsum(count) - count
    home = np.repeat(np.arange(len(shards)), count)
    symbol = np.concatenate([x.symbol for x in shards])
    back = np.concatenate([x.back + b for x, b in zip(shards, base, strict=True)])
    ends = np.concatenate([b + np.arange(len(x.size)) for x, b in zip(shards, base, strict=True)])
    row, common, h = np.arange(len(home)), np.full(len(home), -1), 0
    interval = np.zeros(len(home), np.int64)
    while (common[1:] < 0).any():
        move = symbol[row] >= 0
        at, into = row[move], interval[move]
        turn = np.argsort(symbol[at], kind="stable")
        first, into = symbol[at][turn], into[turn]
        # every terminator is an interval of its own, before all symbols
        row = np.r_[ends, back[at][turn]]
        edge = np.r_[np.ones(len(ends) + 1, bool), (first[1:] != first[:-1]) | (into[1:] != into[:-1])][: len(row)]
        common[edge & (common < 0)] = h
        interval = np.cumsum(edge)
        h += 1
    common[:1] = 0
    return home[row], symbol[row], common


def refine(shards: list[list[bytes]], window: int = WINDOW) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(string, offset, interval) of all windows of the shards' strings that stand twice or more; intervals number equal windows.

    The interleave of the shards' transforms, without what needs no more rounds: rows that no whole window leads to, rows
    alone in their interval, and intervals of one shard, whose own common prefixes say what is equal.
    """
    held: dict[str, list[np.ndarray]] = {k: [] for k in ("place", "back", "to", "symbol", "own", "of", "start", "row", "home")}
    base = strings = groups = 0
    for x in (Shard(s, window) for s in shards if s):
        # own[r]: a number for the window at row r, equal for equal windows of the shard; 0 where it stands once
        own = np.zeros(len(x.place), np.int32)
        if len(x.full):
            new = x.common < window
            new[0] = True
            group = np.cumsum(new)
            own[x.full] = np.where(np.bincount(group)[group] > 1, group + groups, 0)
            groups += group[-1]
        row = np.flatnonzero((x.size[x.of] - x.left >= window)[x.place]) + base
        home = np.full(len(row), len(held["home"]))
        some = x.place + base, x.back + base, x.row + base, x.symbol.astype(np.uint8), own, x.of + strings, x.start + base, row, home
        for v, y in zip(held.values(), some, strict=True):
            v.append(y if y.dtype == np.uint8 else y.astype(np.int32))
        base, strings = base + len(x.place), strings + len(x.size)
    if not base:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    place, back, to, symbol, own, of, start, row, home = (np.concatenate(held.pop(k)) for k in list(held))
    interval = np.zeros(len(row), np.int32)
    settled = []
    for h in range(window + 1):
        if len(row):
            edge = np.r_[True, interval[1:] != interval[:-1], True]
            alone = edge[:-1] & edge[1:]
            # rows of an interval stand shard after shard, so its ends tell whether it is one shard's
            head, number = np.flatnonzero(edge), np.cumsum(edge[:-1]) - 1
            one = (home[head[:-1]] == home[head[1:] - 1])[number]
            if one.any():
                settled.append(to[place[row[one & ~alone]] - (window - h)])
                row, home, interval = row[~one], home[~one], interval[~one]
        if h == window or not len(row):
            break
        first, row = symbol[row], back[row]
        turn = np.argsort(first, kind="stable")
        first, row, home, interval = first[turn], row[turn], home[turn], interval[turn]
        interval = np.cumsum(np.r_[True, (first[1:] != first[:-1]) | (interval[1:] != interval[:-1])][: len(row)], dtype=np.int32)
    alike = np.sort(np.concatenate(settled)) if settled else row[:0]
    alike = alike[own[alike] > 0]
    # intervals of several shards stand until the last round; row numbers keep the others' groups together
    rows = np.r_[row, alike]
    p = place[rows]
    string = of[p]
    return string, p - start[string], np.r_[interval[: len(row)], own[alike] + (interval.max() if len(row) else 0)]


def resolve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Strings sorted by sub to (doc, pos, n): [pos, pos + n) goes."""
    held: pa.Table | None = None
    for t in blocks(batches, ROWS // 8):
        held = pa.concat_tables([held, t]) if held is not None else t
        sub = held.column("sub").to_numpy()
        border = np.flatnonzero(sub[1:] != sub[:-1])
        if len(border):
            yield from resolve_groups(held.slice(0, border[-1] + 1))
            held = held.slice(border[-1] + 1)
    if held is not None and len(held):
        yield from resolve_groups(held)


def resolve_groups(t: pa.Table) -> Iterator[pa.RecordBatch]:
    import pandas as pd

    sub, doc, at = (t.column(i).to_numpy() for i in range(3))
    head = np.flatnonzero(np.r_[True, sub[1:] != sub[:-1]])
    size = np.diff(np.r_[head, len(sub)])
    several = np.repeat(np.minimum.reduceat(doc, head) < np.maximum.reduceat(doc, head), size)
    if not several.any():
        return
    t, doc, at = t.filter(pa.array(several)), doc[several], at[several]
    which, kinds = pd.factorize(np.array(t.column("s").to_pylist(), object))
    low = np.full(len(kinds), np.iinfo(np.int64).max)
    np.minimum.at(low, which, doc)
    kinds = list(kinds)
    of, offset, interval = refine([kinds[i : i + 4096] for i in range(0, len(kinds), 4096)])
    width = WINDOW
    smallest = np.full((len(kinds), 2 * width), np.iinfo(np.int64).max)
    if len(of):
        head = np.flatnonzero(np.r_[True, interval[1:] != interval[:-1]])
        least = np.minimum.reduceat(low[of], head)
        smallest[of, offset] = np.repeat(least, np.diff(np.r_[head, len(of)]))
    # a string that stands in several documents is an interval of its own
    windows = np.array([len(s) for s in kinds]) - width + 1
    inside = np.arange(2 * width) < windows[:, None]
    smallest = np.where(inside, np.minimum(smallest, low[:, None]), np.iinfo(np.int64).max)
    r, o = np.nonzero(smallest[which] < doc[:, None])
    if len(r):
        # neighbouring windows of a row are one interval
        first = np.r_[True, (r[1:] != r[:-1]) | (o[1:] != o[:-1] + 1)]
        i = np.flatnonzero(first)
        j = np.r_[i[1:] - 1, len(r) - 1]
        yield pa.RecordBatch.from_arrays([pa.array(doc[r[i]]), pa.array((at[r[i]] + o[i]).astype(np.int32)), pa.array((o[j] - o[i] + width).astype(np.int32))], ["doc", "pos", "n"])


def find_repeats(docs: DataFrame, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(doc, pos, n): byte ranges that go, overlapping and in any order."""
    spark = docs.sparkSession
    small_batches(spark, 3 * STEP)
    body = F.coalesce(F.col(text), F.lit(""))
    rows = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("doc"), body.cast("binary").alias("b"), F.octet_length(body).alias("n"))
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    named = rows.mapInArrow(name_anchors, "key long, doc long, seg int, pos int, n int")
    # one row for each step that holds an anchor's segment: a passage in very many documents is no hot key
    met = cut(named.repartition(tasks, "key").sortWithinPartitions("key", "doc").mapInArrow(meet, "doc long, pos int, n int"))
    asked = met.where("n = 0").groupBy("doc").agg(F.collect_set("pos").alias("places"))
    fetched = rows.join(asked, "doc").select("doc", "b", "places").mapInArrow(strings, "sub long, doc long, at int, s binary")
    compared = fetched.repartition(tasks, "sub").sortWithinPartitions("sub").mapInArrow(resolve, "doc long, pos int, n int")
    return met.where("n <> 0").unionByName(compared)


def without_repeats(docs: DataFrame, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept (bytes) of every row."""
    gone = cut(find_repeats(docs, text, id_col)).groupBy("doc").agg(F.collect_set(F.struct("pos", "n")).alias("gone"))
    body = F.coalesce(F.col(text), F.lit("")).cast("binary")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), body.alias("b")).join(gone, F.col("doc_id") == F.col("doc"), "left").select("doc_id", "b", "gone.pos", "gone.n")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in steps([len(x) for x in batch.column(1).to_pylist()]):
                out = []
                for doc, text, pos, n in zip(*(batch.column(i).slice(a, b - a).to_pylist() for i in range(4)), strict=True):
                    if not pos:
                        out.append((doc, len(text), 0, 0, text))
                        continue
                    pos, n = np.array(pos, np.int64), np.array(n, np.int64)
                    start, end = np.where(n < 0, np.maximum(pos - REACH, 0), pos), pos + np.where(n < 0, WINDOW, n)
                    s, e = merged(np.minimum(start, len(text)), np.minimum(end, len(text)))
                    s, e = s[s < e], e[s < e]
                    kept = b"".join(text[x:y] for x, y in zip(np.r_[0, e], np.r_[s, len(text)], strict=True))
                    out.append((doc, len(text), len(text) - len(kept), len(s), kept))
                yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(zip(*out, strict=True), kinds, strict=True)], names)

    names, kinds = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"], [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
    return rows.mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")


def op8_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = without_repeats(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
