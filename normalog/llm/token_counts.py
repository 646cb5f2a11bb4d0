"""Operator 1, token counts: rank-synchronous array merging.

Texts are cut at ASCII white space, which no token of this tokenizer crosses. Each piece not yet known is
normalised and split into pre-tokens by the tokenizer's own components; all their symbols stand in one ragged
numpy array, and each round applies every sequence's lowest-rank pair at once, left to right. What survives is
counted. Counts of pieces are kept in a memo of bounded size, which saves work and changes no result.

Null texts count as empty (0 tokens); repeated rows are counted each by itself; other columns are not read.
A special token's string inside a text counts as that one token, as the library does by default.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from normalog.llm.bpe_codec import byte_alphabet
from normalog.llm.common import small_batches, steps, table

#: A word of Latin letters and ASCII marks around it (no apostrophe): normal already but for case, three pre-tokens at most.
PLAIN = re.compile(r"([!-&(-/:-@\[-`{-~]*)([A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\xff]+)([!-&(-/:-@\[-`{-~]*)")
LETTERS = {b: c for c, b in byte_alphabet().items()}
NONE = np.iinfo(np.int64).max
MEMO = 300_000


class RankMerger:
    """Counts tokens of byte pieces under a BPE file whose words end in a suffix."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        spec = json.loads(open(path, encoding="utf-8").read())
        self.lib = Tokenizer.from_file(path)
        self.suffix = spec["model"]["end_of_word_suffix"] or ""
        self.vocab = spec["model"]["vocab"]
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in spec["model"]["merges"]]
        key = np.array([self.vocab[a] << 32 | self.vocab[b] for a, b in merges], np.int64)
        order = np.argsort(key, kind="stable")
        self.keys, self.ranks = key[order], order.astype(np.int64)
        self.made = np.array([self.vocab[a + b] for a, b in merges], np.int64)[order]
        special = [t["content"].encode() for t in spec["added_tokens"]]
        self.special = re.compile(b"|".join(map(re.escape, sorted(special, key=len, reverse=True)))) if special else None
        # two generations of known pieces: what is still in use moves from the older one to the younger
        self.memo: dict[bytes, int] = {}
        self.older: dict[bytes, int] = {}

    def pretokens(self, piece: bytes) -> list[str]:
        if m := PLAIN.fullmatch(piece.decode("utf-8", "replace")):
            return [p.lower().encode().decode("latin-1").translate(LETTERS) for p in m.groups() if p]
        text = self.lib.normalizer.normalize_str(piece.decode("utf-8", "replace"))
        return [t for t, _ in self.lib.pre_tokenizer.pre_tokenize_str(text)]

    def symbols(self, pretoken: str) -> list[int]:
        return [self.vocab[c] for c in pretoken[:-1]] + [self.vocab[pretoken[-1] + self.suffix]]

    def surviving(self, sequences: list[list[int]]) -> np.ndarray:
        """Symbols left of each sequence when no pair can be merged any more."""
        lengths = np.array([len(s) for s in sequences], np.int64)
        out = lengths.copy()
        sym = np.fromiter((x for s in sequences for x in s), np.int64, int(lengths.sum()))
        owner = np.repeat(np.arange(len(sequences)), lengths)
        while len(sym) > 1:
            rank, at = np.full(len(sym), NONE), np.zeros(len(sym), np.int64)
            pair = sym[:-1] << 32 | sym[1:]
            found = np.minimum(np.searchsorted(self.keys, pair), len(self.keys) - 1)
            ok = (self.keys[found] == pair) & (owner[:-1] == owner[1:])
            rank[:-1][ok], at[:-1] = self.ranks[found[ok]], found
            start = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            size = np.diff(np.r_[start, len(sym)])
            lowest = np.minimum.reduceat(rank, start)
            hit = (rank == np.repeat(lowest, size)) & (rank != NONE)
            # equal neighbours overlap: of a run of hits every other one counts, from its left end
            i = np.flatnonzero(hit)
            first = np.r_[True, np.diff(i) != 1] if len(i) else np.zeros(0, bool)
            run = np.flatnonzero(first)
            i = i[(np.arange(len(i)) - np.repeat(run, np.diff(np.r_[run, len(i)]))) % 2 == 0]
            sym[i] = self.made[at[i]]
            keep = np.ones(len(sym), bool)
            keep[i + 1] = False
            done = lowest == NONE
            out[owner[start[done]]] = size[done]
            keep &= np.repeat(~done, size)
            sym, owner = sym[keep], owner[keep]
        if len(sym):
            out[owner] = 1
        return out

    def learn(self, pieces: set[bytes]) -> None:
        names, extra, sequences, of = list(pieces), [], [], []
        for k, piece in enumerate(names):
            parts = self.special.split(piece) if self.special else [piece]
            extra.append(len(parts) - 1)
            for part in parts:
                for pretoken in self.pretokens(part) if part else ():
                    sequences.append(self.symbols(pretoken))
                    of.append(k)
        total = np.array(extra, np.int64)
        if sequences:
            total += np.bincount(of, self.surviving(sequences), len(names)).astype(np.int64)
        self.memo.update(zip(names, total.tolist(), strict=True))

    def counts(self, texts: list[bytes]) -> list[int]:
        split = [t.split() for t in texts]
        new = set().union(*split) if split else set()
        if len(self.memo) + len(new) > MEMO:
            self.older, self.memo = self.memo, {}
        memo, older = self.memo, self.older
        new -= memo.keys()
        memo.update((p, older[p]) for p in new if p in older)
        self.learn({p for p in new if p not in memo})
        return [sum(map(self.memo.__getitem__, pieces)) for pieces in split]


@lru_cache(1)
def merger_of(path: str) -> RankMerger:
    """A worker process keeps its merger, and what it has met, from task to task."""
    return RankMerger(path)


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def token_counts(docs: DataFrame, text: str = "text", id_col: str = "doc_id", path: str | None = None, limit: int = 2048) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit (n_tokens > limit) for every row of docs. No shuffle."""

    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merger = merger_of(path or default_path())
        for batch in batches:
            sizes = batch.column(2).to_pylist()
            for a, b in steps(sizes):
                n = merger.counts(batch.column(1).slice(a, b - a).to_pylist())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(sizes[a:b], pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    body = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), body.cast("binary").alias("b"), F.octet_length(body).cast("long").alias("n"))
    return rows.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"))
