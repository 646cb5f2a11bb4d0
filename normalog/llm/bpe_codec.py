"""Operator 10, BPE encoding and decoding: per-prefix dynamic programming.

For every prefix of a pre-token, BPE's encoding ends in one token. Its candidates are the vocabulary's entries
that are suffixes of the prefix, which an automaton with suffix links (Aho-Corasick) reports in one scan; the
right one is the only candidate compatible with the last token stored for the prefix before it. Back-pointers
then give the ids. Two tokens are compatible if no merge across their border comes before the merges that
build them, which is read off the right spine of the one and the left spine of the other.

Texts are cut where ASCII white space lets the pre-tokenizer cut too; texts with other white space go through
the library's pre-tokenizer whole. Null texts are empty (0 ids); every row is encoded by itself, ties and
repeated rows included; other columns are not read.
"""

from __future__ import annotations

import hashlib
import json
import re
import struct
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from normalog.llm.common import small_batches, steps, table

MEMO, FITS = 120_000, 250_000
#: Fixed value: the pieces that the byte-level pre-tokenizer's white space rules make of ASCII texts. The first form takes
#: a word of Latin letters without the marks that end it, which are a pre-token of their own.
PIECE = re.compile(rb" ?(?:[A-Za-z]+|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf]|[\xc4-\xc8][\x80-\xbf]|\xc9[\x80-\x8f])++(?=[!-&(-/:-@\[-`{-~]*+(?:[ \t\n\r\f\v]|\Z))| ?[^ \t\n\r\f\v]+|[ \t\n\r\f\v]+(?![^ \t\n\r\f\v])|[ \t\n\r\f\v]+")
#: White space, or what may count as such, beyond ASCII's six characters.
ODD_SPACE = re.compile("[\x1c-\x1f\x85\xa0\u1680\u180e\u2000-\u200d\u2028\u2029\u202f\u205f\u2060\u3000\ufeff]")
#: Pieces of one word of Latin letters and ASCII marks after it (no apostrophe): two pre-tokens at most.
PLAIN = re.compile(r"( ?[A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\u024f]+)([!-&(-/:-@\[-`{-~]*)")
FOREVER = 1 << 60


def byte_alphabet() -> dict[str, int]:
    """Byte-level BPE writes printable bytes as themselves and the others from U+0100 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class PrefixCodec:
    def __init__(self, path: str):
        import ahocorasick
        from tokenizers import Tokenizer

        spec = json.loads(open(path, encoding="utf-8").read())
        vocab = spec["model"]["vocab"]
        self.lib = Tokenizer.from_file(path)
        self.added = {t["content"].encode(): t["id"] for t in spec["added_tokens"]}
        self.special = re.compile(b"(" + b"|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + b")") if self.added else None
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in spec["model"]["merges"]]
        self.rank: dict[tuple[int, int], int] = {}
        self.parts: dict[int, tuple[int, int, int]] = {}
        for r, (a, b) in enumerate(merges):
            pair = vocab[a], vocab[b]
            self.rank.setdefault(pair, r)
            self.parts.setdefault(vocab[a + b], (*pair, r))
        to_byte = byte_alphabet()
        self.token_bytes = {i: bytes(to_byte[c] for c in t) for t, i in vocab.items()} | {i: t for t, i in self.added.items()}
        self.letters = {b: c for c, b in to_byte.items()}
        self.tokens = {t: i for t, i in vocab.items() if len(t) == 1 or i in self.parts}
        self.automaton = ahocorasick.Automaton()
        for t, i in self.tokens.items():
            self.automaton.add_word(t, (len(t), i))
        self.automaton.make_automaton()
        self.spines: tuple[dict, dict] = ({}, {})
        self.fits: dict[int, bool] = {}
        # two generations of known pieces: what is still in use moves from the older one to the younger
        self.memo: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}

    def spine(self, token: int, side: int) -> list[tuple[int, int]]:
        """Symbols at the token's left (0) or right (1) edge, each with the rank of the merge that takes it up."""
        known = self.spines[side]
        if token not in known:
            out, x, taken = [], token, FOREVER
            while True:
                out.append((x, taken))
                if x not in self.parts:
                    break
                taken = self.parts[x][2]
                x = self.parts[x][side]
            known[token] = out
        return known[token]

    def compatible(self, a: int, b: int) -> bool:
        pair = a << 20 | b
        if pair not in self.fits:
            if len(self.fits) > FITS:
                self.fits.clear()
            left = self.spine(b, 0)
            # a merge inside a of the same rank lies further left and goes first; one inside b goes later
            self.fits[pair] = not any((r := self.rank.get((x, y))) is not None and r < gone_x and r <= gone_y for x, gone_x in self.spine(a, 1) for y, gone_y in left)
        return self.fits[pair]

    def ids(self, pretoken: str) -> list[int]:
        known = self.tokens.get(pretoken)
        if known is not None:
            return [known]
        n, fits = len(pretoken), self.fits
        last, back, at = [-1] * (n + 1), [0] * (n + 1), -1
        for end, (size, token) in self.automaton.iter(pretoken):
            if end == at:
                continue
            start = end + 1 - size
            if start:
                before = last[start]
                fit = fits.get(before << 20 | token)
                if not (self.compatible(before, token) if fit is None else fit):
                    continue
            at = end
            last[end + 1], back[end + 1] = token, start
        out = []
        while n:
            out.append(last[n])
            n = back[n]
        return out[::-1]

    def whole(self, segment: bytes) -> bytes:
        text = segment.decode("utf-8", "replace")
        if m := PLAIN.fullmatch(text):
            tokens = [m[k].encode().decode("latin-1").translate(self.letters) for k in (1, 2) if m[k]]
        else:
            tokens = [t for t, _ in self.lib.pre_tokenizer.pre_tokenize_str(text)]
        out: list[int] = []
        for t in tokens:
            out += self.ids(t)
        return struct.pack(f"<{len(out)}I", *out)

    def segment(self, segment: bytes) -> bytes:
        if not segment.isascii() and ODD_SPACE.search(segment.decode("utf-8", "replace")) or segment.isascii() and any(c in segment for c in b"\x1c\x1d\x1e\x1f"):
            return self.whole(segment)
        memo, out = self.memo, []
        for piece in PIECE.findall(segment):
            ids = memo.get(piece)
            if ids is None:
                if len(memo) >= MEMO:
                    self.older, self.memo = memo, {}
                    memo = self.memo
                ids = memo[piece] = self.older.get(piece) or self.whole(piece)
            out.append(ids)
        return b"".join(out)

    def encode(self, text: bytes) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        if not self.special:
            return self.segment(text)
        return b"".join(self.added[p].to_bytes(4, "little") if k % 2 else self.segment(p) for k, p in enumerate(self.special.split(text)) if p)

    def decode(self, ids: bytes) -> bytes:
        found = b"".join(map(self.token_bytes.__getitem__, memoryview(ids).cast("I").tolist()))
        return found.decode("utf-8", "replace").encode()


@lru_cache(1)
def codec_of(path: str) -> PrefixCodec:
    """A worker process keeps its codec, and what it has met, from task to task."""
    return PrefixCodec(path)


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def bpe_encode(docs: DataFrame, text: str = "text", id_col: str = "doc_id", path: str | None = None, digests: bool = True) -> DataFrame:
    """Encode and decode every row's text. digests: n_tokens, ids_sha256, decoded_sha256; else ids and decoded."""

    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_of(path or default_path())
        sha = lambda b: hashlib.sha256(b).hexdigest()
        for batch in batches:
            for a, b in steps(batch.column(2).to_pylist()):
                ids = [codec.encode(t) for t in batch.column(1).slice(a, b - a).to_pylist()]
                n = pa.array([len(x) // 4 for x in ids], pa.int64())
                if digests:
                    more = [pa.array([sha(x) for x in ids]), pa.array([sha(codec.decode(x)) for x in ids])]
                else:
                    more = [pa.array([memoryview(x).cast("I").tolist() for x in ids], pa.list_(pa.int32())), pa.array([codec.decode(x).decode() for x in ids])]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), n, *more], names)

    names = ["doc_id", "n_tokens", *(("ids_sha256", "decoded_sha256") if digests else ("ids", "decoded"))]
    body = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), body.cast("binary").alias("b"), F.octet_length(body).cast("long").alias("n"))
    kinds = "ids_sha256 string, decoded_sha256 string" if digests else "ids array<int>, decoded string"
    return rows.mapInArrow(run, f"doc_id long, n_tokens long, {kinds}")


def op10_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_encode(table(spark, sf_dir, "documents"))
