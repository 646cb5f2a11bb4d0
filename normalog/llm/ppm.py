"""Operator 5, LM scoring: prediction by partial matching over a pretrained byte-context trie.

Texts are lower-cased (A-Z) and coded byte by byte, with one end symbol. Training counts every context of ``order``
bytes and the symbol after it; shorter contexts count in how many longer ones they were followed by a symbol (update
exclusion). A symbol not seen in its longest known context costs an escape, estimated by method D (half a count per
seen symbol), and is sought in the next shorter context, where the symbols already ruled out are excluded from all
sums; below order 0 the symbols left are equally likely. Scores are log10 probabilities and add up to one over all texts.

Neither the driver nor any worker ever holds the trie. Texts are dealt into steps of a few MB. A step names its distinct
(context, symbol) codes and its distinct words once, with their training counts, in buckets: by the last two symbols of
the context, so that a bucket's trie has every context of order 2 and more whole, and by the word's hash. Counts are
added up by bucket (first by bucket and group of steps, so a frequent pair or word is no hot key), each bucket answers
the codes and words of the steps, again by group of steps, and the answers return to their step, which adds them up text
by text. The contexts of order 1 and 0, at most 257 * 258 edges, go to every bucket. All of this grows with the texts'
distinct codes, and no piece of it with the corpus but the trie's own edges in a bucket.

Null texts are empty (the end symbol alone). A null id is trained on. Repeated rows count and score each by itself;
without training rows every symbol has probability 1/257. Empty tables give no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from normalog.llm.common import cut, table

END, START, SYMBOLS, BITS = 256, 257, 257, 9
#: Text bytes of a step on average, and of the slices it works through.
STEP, SLICE = 12 << 20, 2 << 20
#: Steps whose codes one task counts or answers together, and text bytes for each bucket (between 8 and 4096 of them).
STEPS_A_GROUP, BUCKET_BYTES = 1024, 1 << 20
CODE, WORD = 0, 1
NAMED = "step long, kind int, bucket int, keys binary, n binary"


def contexts(texts: list[bytes], order: int, before: bytes = b"", ends: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """All symbols of the texts with their ``order`` predecessors, packed in longs, and where each text starts.

    before: what precedes the first text (at least ``order`` bytes, or none); ends: whether the last text ends here.
    """
    pad = np.full(order, START, np.int16)
    parts: list[np.ndarray] = []
    for t in texts:
        parts += [pad, np.frombuffer(t, np.uint8).astype(np.int16), np.array([END], np.int16)]
    sizes = np.array([len(t) + 1 for t in texts], np.int64)
    if not len(sizes):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    if before:
        parts[0] = np.frombuffer(before[-order:], np.uint8).astype(np.int16)
    if not ends:
        sizes[-1] -= 1
        parts.pop()
    flat = np.concatenate(parts)
    gram = np.zeros(len(flat) - order, np.int64)
    for j in range(order + 1):
        gram <<= BITS
        gram |= flat[j : len(flat) - order + j]
    start = np.cumsum(sizes + order) - sizes - order
    keep = np.ones(len(gram), bool)
    # grams that end in the next text's padding
    for s in start[1:]:
        keep[s - order : s] = False
    return gram[keep], np.cumsum(sizes) - sizes


def sliced(texts: list[bytes], order: int) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """contexts() of the texts by slices of about SLICE bytes, and the slice's first text; a long text takes several slices."""
    held: list[bytes] = []
    size = 0
    for i, t in enumerate(texts):
        if held and size + len(t) > SLICE:
            yield *contexts(held, order), i - len(held)
            held, size = [], 0
        if len(t) > SLICE:
            for a in range(0, len(t), SLICE):
                yield *contexts([t[a : a + SLICE]], order, t[max(0, a - order) : a], a + SLICE >= len(t)), i
        else:
            held.append(t)
            size += len(t)
    if held:
        yield *contexts(held, order), len(texts) - len(held)


class Trie:
    """Edges of every order, ascending: (context, symbol) packed, count, and each context's sums."""

    def __init__(self, gram: np.ndarray, count: np.ndarray, order: int, low: tuple[np.ndarray, np.ndarray] | None = None):
        """low: the edges of order 1 and their counts, where gram is only a part of the trie."""
        self.order, self.levels = order, []
        at = np.argsort(gram)
        keys, n = gram[at], count[at].astype(np.float64)
        for k in range(order, -1, -1):
            ctx, where = np.unique(keys >> BITS, return_inverse=True)
            self.levels.append({"keys": keys, "n": n, "ctx": ctx, "total": np.bincount(where, n, len(ctx)), "kinds": np.bincount(where, minlength=len(ctx)).astype(np.float64), "where": where})
            if k:
                keys, back = np.unique(keys & ((1 << (BITS * k)) - 1), return_inverse=True)
                # what the shorter context counts of the symbols seen in this one
                n = np.bincount(back).astype(np.float64)
                if low and k == 2:
                    back, (keys, n) = np.searchsorted(low[0], keys)[back], low
                self.levels[-1]["below"] = np.bincount(where, n[back], len(ctx))
        for level in self.levels:
            del level["where"]

    def log10(self, gram: np.ndarray) -> np.ndarray:
        """log10 probability of each packed (context, symbol)."""
        out, open_, deeper = np.zeros(len(gram)), np.arange(len(gram)), np.full(len(gram), -1)
        for i, level in enumerate(self.levels):
            if not len(open_):
                break
            if not len(level["keys"]):
                continue
            key = gram[open_] & ((1 << (BITS * (self.order - i + 1))) - 1)
            c = np.minimum(np.searchsorted(level["ctx"], key >> BITS), len(level["ctx"]) - 1)
            known = level["ctx"][c] == key >> BITS
            total, kinds = level["total"][c], level["kinds"][c]
            if i and len(up := self.levels[i - 1]["kinds"]):
                was, deep = deeper[open_] >= 0, deeper[open_]
                total = total - np.where(was, self.levels[i - 1]["below"][deep], 0)
                kinds = kinds - np.where(was, up[deep], 0)
            e = np.minimum(np.searchsorted(level["keys"], key), len(level["keys"]) - 1)
            seen = known & (level["keys"][e] == key)
            out[open_[seen]] += np.log10((2 * level["n"][e[seen]] - 1) / (2 * total[seen]))
            escape = known & ~seen & (kinds > 0)
            out[open_[escape]] += np.log10(kinds[escape] / (2 * total[escape]))
            deeper[open_] = np.where(known, c, -1)
            open_ = open_[~seen]
        used = self.levels[-1]["kinds"][0] if len(self.levels[-1]["keys"]) else 0
        out[open_] -= np.log10(max(1, SYMBOLS - used))
        return out


def held_out(id_col: Column) -> Column:
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 5 == 1, F.lit(False))


def packed(a: np.ndarray) -> bytes:
    """Numbers by planes of bytes, compressed."""
    planes = np.ascontiguousarray(a.view(np.uint8).reshape(-1, a.itemsize).T)
    return len(a).to_bytes(8, "little") + pa.compress(planes.tobytes(), "zstd", asbytes=True)


def unpacked(x: bytes, kind: type) -> np.ndarray:
    n, size = int.from_bytes(x[:8], "little"), np.dtype(kind).itemsize
    planes = np.frombuffer(pa.decompress(x[8:], n * size, "zstd", asbytes=True), np.uint8).reshape(size, n)
    return np.ascontiguousarray(planes.T).view(kind).ravel()


def packed_codes(keys: np.ndarray, order: int) -> bytes:
    """Codes symbol by symbol, so that the places that sorted codes share cost next to nothing."""
    return packed(((keys >> (np.arange(order, -1, -1) * BITS)[:, None]) & ((1 << BITS) - 1)).astype(np.uint16).ravel())


def unpacked_codes(x: bytes, order: int) -> np.ndarray:
    symbols, out = unpacked(x, np.uint16).reshape(order + 1, -1), 0
    for column in symbols:
        out = (out << BITS) | column.astype(np.int64)
    return out


def joined(parts: list[np.ndarray], kind: type = np.int64) -> np.ndarray:
    return np.concatenate([np.zeros(0, kind), *parts])


def bucket_of(keys: np.ndarray, buckets: int) -> np.ndarray:
    """A code's bucket: by the last two symbols of its context."""
    pair = (keys >> BITS) & ((1 << (2 * BITS)) - 1)
    return (pair * 0x9E3779B1 >> 7) % buckets


def summed(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, ascending, and the sums of their n."""
    if not len(keys):
        return keys, n
    at = np.argsort(keys, kind="stable")
    keys, n = keys[at], n[at]
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    return keys[first], np.add.reduceat(n, first)


def codes_of(texts: list[bytes], order: int) -> tuple[np.ndarray, np.ndarray]:
    """The texts' distinct codes, ascending, and how often each stands in them."""
    import pandas as pd

    keys, n = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for gram, _, _ in sliced(texts, order):
        code, kinds = pd.factorize(gram)
        keys.append(kinds)
        n.append(np.bincount(code, minlength=len(kinds)))
    return summed(np.concatenate(keys), np.concatenate(n))


def dealt(bucket: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(bucket, its places) of all buckets that have some."""
    at = np.argsort(bucket, kind="stable")
    first = np.flatnonzero(np.r_[True, bucket[at][1:] != bucket[at][:-1]]) if len(at) else []
    for a, b in zip(first, [*first[1:], len(at)], strict=True):
        yield int(bucket[at[a]]), at[a:b]


def name_step(t: pa.Table, order: int, buckets: int) -> pa.Table:
    """A step's codes and words by bucket, with their training counts (0: in held-out texts only)."""
    import xxhash

    step, held = t.column("step")[0].as_py(), np.array(t.column("held").to_pylist())
    texts = [x.lower() for x in t.column("b").to_pylist()]
    out: list[tuple] = []
    taught, rest = ([x for x, h in zip(texts, held, strict=True) if h == kind] for kind in (False, True))
    (g1, n1), (g2, n2) = codes_of(taught, order), codes_of(rest, order)
    keys, n = summed(joined([g1, g2]), joined([n1, n2 * 0]))
    for b, at in dealt(bucket_of(keys, buckets)):
        out.append((step, CODE, b, packed_codes(keys[at], order), packed(n[at])))
    known: dict[bytes, int] = {}
    for x in taught:
        for w in x.split():
            known[w] = known.get(w, 0) + 1
    for x in rest:
        for w in x.split():
            known.setdefault(w, 0)
    words, counts = list(known), np.fromiter(known.values(), np.int64, len(known))
    for b, at in dealt(np.fromiter((xxhash.xxh32_intdigest(w) % buckets for w in words), np.int64, len(words))):
        out.append((step, WORD, b, b" ".join(words[i] for i in at), packed(counts[at])))
    return pa.table([pa.array(v, k) for v, k in zip(zip(*out, strict=True), (pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary()), strict=True)], ["step", "kind", "bucket", "keys", "n"])


def merge_counts(t: pa.Table, order: int) -> pa.Table:
    """One row for the bucket: the sums of all rows' counts, without what was never trained on."""
    kind, bucket = t.column("kind")[0].as_py(), t.column("bucket")[0].as_py()
    n = joined([unpacked(x, np.int64) for x in t.column("n").to_pylist()])
    low = np.zeros(0, np.int64)
    lows = low
    if kind == CODE:
        keys, n = summed(joined([unpacked_codes(x, order) for x in t.column("keys").to_pylist()]), n)
        keys, n = keys[n > 0], n[n > 0]
        low, lows = np.unique(np.unique(keys & ((1 << (3 * BITS)) - 1)) & ((1 << (2 * BITS)) - 1), return_counts=True)
        names = packed_codes(keys, order)
    else:
        known: dict[bytes, int] = {}
        for w, c in zip((w for x in t.column("keys").to_pylist() for w in x.split()), n.tolist(), strict=True):
            if c:
                known[w] = known.get(w, 0) + c
        names, n = b" ".join(known), np.fromiter(known.values(), np.int64, len(known))
    return pa.table([pa.array([kind], pa.int32()), pa.array([bucket], pa.int32()), pa.array([names], pa.binary()), pa.array([packed(n)], pa.binary()), pa.array([len(n)], pa.int64()), pa.array([int(n.sum())], pa.int64()), pa.array([low.tolist()], pa.list_(pa.int64())), pa.array([lows.tolist()], pa.list_(pa.int64()))], ["kind", "bucket", "keys", "n", "kinds", "total", "low", "lows"])


def answer(asked: pa.Table, model: pa.Table, order: int, low: tuple[np.ndarray, np.ndarray]) -> pa.Table:
    """To a bucket's codes their log10 probabilities, in the codes' order, to its words their training counts, step by step."""
    if not len(asked):
        return pa.table([pa.array([], x) for x in (pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary())], ["step", "kind", "bucket", "keys", "n"])
    keys, n = asked.column("keys").to_pylist(), joined([unpacked(x, np.int64) for x in model.column("n").to_pylist()])
    if asked.column("kind")[0].as_py() == CODE:
        trie = Trie(joined([unpacked_codes(x, order) for x in model.column("keys").to_pylist()]), n, order, low)
        each = [unpacked_codes(x, order) for x in keys]
        kinds, where = np.unique(joined(each), return_inverse=True)
        value = trie.log10(kinds)[where]
        ends = np.cumsum([0, *map(len, each)])
        # the step knows its codes; words come back, as their order is no one's
        keys, out = [b""] * len(keys), [packed(value[a:b]) for a, b in zip(ends, ends[1:], strict=False)]
    else:
        known = dict(zip((w for x in model.column("keys").to_pylist() for w in x.split()), n.tolist(), strict=True))
        out = [packed(np.array([known.get(w, 0) for w in x.split()], np.int64)) for x in keys]
    return asked.select(["step", "kind", "bucket"]).append_column("keys", pa.array(keys, pa.binary())).append_column("n", pa.array(out, pa.binary()))


def finish_step(t: pa.Table, answers: pa.Table, order: int, buckets: int, n_all: int, n_end: int, floor: float) -> pa.Table:
    """The scores of a step's texts from the answers to its codes and words."""
    import pandas as pd

    texts = [x.lower() for x in t.column("b").to_pylist()]
    rows = sorted(zip(*(answers.column(c).to_pylist() for c in ("kind", "bucket", "keys", "n")), strict=True), key=lambda x: x[:2])
    slices = []
    for gram, start, first in sliced(texts, order):
        which, kinds = pd.factorize(gram)
        slices.append((which.astype(np.int32), kinds, start, first))
    code = np.unique(joined([x[1] for x in slices]))
    # as the step named them: by bucket, then ascending
    value = np.empty(len(code))
    value[np.argsort(bucket_of(code, buckets), kind="stable")] = joined([unpacked(n, np.float64) for kind, _, _, n in rows if kind == CODE], np.float64)
    total = np.zeros(len(texts))
    for which, kinds, start, first in slices:
        total[first : first + len(start)] += np.add.reduceat(value[np.searchsorted(code, kinds)][which], start)
    words = [w for kind, _, k, _ in rows if kind == WORD for w in k.split()]
    count = joined([unpacked(n, np.int64) for kind, _, _, n in rows if kind == WORD])
    place, logs = {w: i for i, w in enumerate(words)}, np.log10(count + 0.5)
    n_tokens, n_known, base = (np.zeros(len(texts), k) for k in (np.int64, np.int64, np.float64))
    for i, x in enumerate(texts):
        own = np.array([place[w] for w in x.split()], np.int64)
        n_tokens[i], n_known[i] = len(own) + 1, (count[own] > 0).sum() + (n_end > 0)
        base[i] = logs[own].sum() + np.log10(n_end + 0.5) - (len(own) + 1) * floor
    return pa.table({"doc_id": t.column("doc_id"), "held_out": t.column("held"), "n_tokens": n_tokens, "n_known": n_known, "train_tokens": np.full(len(texts), n_all), "base_score": base, "score": total})


def score(docs: DataFrame, text: str = "text", id_col: str = "doc_id", order: int = 5, step_bytes: int = STEP, steps_a_group: int = STEPS_A_GROUP) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row. order: 2 to 6."""
    body = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), held_out(F.col(id_col)).alias("held"), body.cast("binary").alias("b"))
    facts = rows.agg(F.sum(F.octet_length("b").cast("long")).alias("bytes"), F.sum(F.when(F.col("held"), 0).otherwise(1)).alias("taught")).first()
    size, n_end = facts["bytes"] or 0, facts["taught"] or 0
    n_steps, buckets = int(-(-size // step_bytes) or 1), int(min(max(size // BUCKET_BYTES, 8), 4096))
    groups = -(-n_steps // steps_a_group)
    rows = rows.withColumn("step", F.pmod(F.xxhash64("doc_id", "b"), F.lit(n_steps)))
    named = cut(rows.groupBy("step").applyInArrow(lambda t: name_step(t, order, buckets), NAMED)).withColumn("salt", F.pmod("step", F.lit(groups).cast("long")))
    merged = "kind int, bucket int, keys binary, n binary, kinds long, total long, low array<long>, lows array<long>"
    model = named.select("kind", "bucket", "salt", "keys", "n").groupBy("kind", "bucket", "salt").applyInArrow(lambda t: merge_counts(t, order), merged)
    if groups > 1:
        model = model.select("kind", "bucket", "keys", "n").groupBy("kind", "bucket").applyInArrow(lambda t: merge_counts(t, order), merged)
    model = cut(model)
    spoken = model.where(F.col("kind") == WORD).agg(F.sum("total").alias("words"), F.sum("kinds").alias("kinds")).first()
    n_all, kinds = n_end + (spoken["words"] or 0), (spoken["kinds"] or 0) + (n_end > 0)
    floor = float(np.log10(n_all + 0.5 * (kinds + 1)))
    # at most 257 * 258 rows: a symbol and the one before it
    pairs = model.where(F.col("kind") == CODE).select(F.explode(F.arrays_zip("low", "lows")).alias("x")).groupBy("x.low").agg(F.sum("x.lows").alias("n")).orderBy("low").toArrow()
    low = pairs.column("low").to_numpy(), pairs.column("n").to_numpy().astype(np.float64)
    spread = model.select("kind", "bucket", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(groups - 1).cast("long"))).alias("salt"), "keys", "n")
    found = named.select("step", "kind", "bucket", "salt", "keys").groupBy("kind", "bucket", "salt").cogroup(spread.groupBy("kind", "bucket", "salt"))
    answers = found.applyInArrow(lambda a, m: answer(a, m, order, low), NAMED)
    out = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return rows.groupBy("step").cogroup(answers.groupBy("step")).applyInArrow(lambda t, a: finish_step(t, a, order, buckets, n_all, n_end, floor), out)


def op5_ppm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents"))
