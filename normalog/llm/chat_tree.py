"""Operator 9, chat formatting: a prefix tree over conversations that share their initial turns.

Template: ``<s>`` opens a conversation; a user's turn is ``[INST] text [/INST]``, an assistant's `` text</s>``,
any other role's ``<<SYS>>role\\ntext<</SYS>>``. Control strings inside texts get a backslash after their first
character and backslashes are doubled, which ``unescape`` undoes.

Conversations whose first turn is equal meet in one pack; where more than ``pack_limit`` of them or ``PACK_CHARS`` of
their text share it, they are dealt over several packs by conv_id, each with its own copy of the shared turns, so no pack
is unbounded (but by one conversation's length), and packs of one first turn lie in several tasks. In a pack
every tree node (a turn after its ancestors) is written once, depth first. Tokens are code points here; each
segment has its place in the pack, the position id of its first token (its offset in the conversation), and the
index of its parent, whose chain gives the intervals that the segment may attend to.

Null texts and roles are empty. Turns are ordered by turn, then role and text; repeated rows are repeated turns.
Rows with a null conv_id form one conversation. An empty table gives no packs. Other columns are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from normalog.llm.common import table

CONTROL = re.compile(r"\\|<(?=/?s>|<SYS>>|</SYS>>)|\[(?=/?INST\])")
#: A turn of the template; what it marks cannot occur inside an escaped text.
TURN = re.compile(r"\[INST\] (?P<user>.*?) \[/INST\]|<<SYS>>(?P<role>.*?)\n(?P<text>.*?)<</SYS>>| (?P<assistant>.*?)</s>", re.S)
PACK = "pack array<struct<part:string,conv_ids:array<bigint>,parent:int,start:int,size:int,position:int,loss_start:int,loss_size:int,attends:array<struct<start:int,end:int>>>>"
BUNDLE_BYTES = 8 << 20
#: Characters of a pack's conversations, on average, at most.
PACK_CHARS = 8 << 20


def escape(text: str) -> str:
    return CONTROL.sub(lambda m: m[0] + "\\", text)


def unescape(text: str) -> str:
    """A backslash after a backslash stands for one; after any other character it goes."""
    return re.sub(r"\\\\|\\", lambda m: "\\" if len(m[0]) == 2 else "", text)


def render(role: str, text: str) -> tuple[str, int, int]:
    """The turn's marked form, and where in it the text under the loss mask lies."""
    body = escape(text)
    if role == "user":
        return f"[INST] {body} [/INST]", 0, 0
    if role == "assistant":
        return f" {body}</s>", 1, len(body)
    return f"<<SYS>>{escape(role).replace('\n', chr(92) + 'n')}\n{body}<</SYS>>", 0, 0


def parse(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of each turn of a formatted conversation."""
    turns, at = [], len("<s>")
    while at < len(formatted):
        m = TURN.match(formatted, at)
        if m["user"] is not None:
            turns.append(("user", unescape(m["user"])))
        elif m["assistant"] is not None:
            turns.append(("assistant", unescape(m["assistant"])))
        else:
            turns.append((re.sub(r"\\(.)", lambda x: "\n" if x[1] == "n" else x[1], re.sub(r"([<\[])\\", r"\1", m["role"])), unescape(m["text"])))
        at = m.end()
    return turns


def build_pack(conversations: list[tuple[int | None, list[tuple[str, str]]]]) -> list[dict]:
    """Segments of one pack in depth-first order; conv_ids lists the conversations that end at a segment."""
    root: dict = {"kids": {}, "convs": []}
    for conv, turns in conversations:
        node = root
        for turn in turns:
            node = node["kids"].setdefault(turn, {"kids": {}, "convs": []})
        node["convs"].append(conv)
    out = [{"part": "<s>", "conv_ids": root["convs"], "parent": -1, "start": 0, "size": 3, "position": 0, "loss_start": 0, "loss_size": 0, "attends": []}]
    at, stack = 3, [(kid, turn, 0) for turn, kid in sorted(root["kids"].items(), key=lambda x: x[0], reverse=True)]
    while stack:
        node, turn, parent = stack.pop()
        text, loss, size = render(*turn)
        up = out[parent]
        spans = [dict(x) for x in up["attends"]]
        if spans and spans[-1]["end"] == up["start"]:
            spans[-1]["end"] += up["size"]
        else:
            spans.append({"start": up["start"], "end": up["start"] + up["size"]})
        out.append({"part": text, "conv_ids": node["convs"], "parent": parent, "start": at, "size": len(text), "position": up["position"] + up["size"], "loss_start": loss, "loss_size": size, "attends": spans})
        at += len(text)
        own = len(out) - 1
        stack += [(kid, t, own) for t, kid in sorted(node["kids"].items(), key=lambda x: x[0], reverse=True)]
    return out


def chat_packs(turns: DataFrame, pack_limit: int = 256) -> DataFrame:
    """One row per pack: its segments depth first. turns: conv_id, turn, role, text."""
    t = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.struct(F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).alias("t"))
    conv = t.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    first = F.xxhash64(F.col("turns")[0]["role"], F.col("turns")[0]["text"])
    conv = conv.select("conv_id", "turns", first.alias("root"))
    chars = F.sum(F.length("t.text") + 32)
    heads = t.groupBy("conv_id").agg(F.min("t").alias("t"), chars.alias("chars")).groupBy(F.xxhash64("t.role", "t.text").alias("root"))
    hot = heads.agg(F.ceil(F.greatest(F.count(F.lit(1)) / pack_limit, F.sum("chars") / PACK_CHARS)).alias("parts")).where("parts > 1")
    conv = conv.join(hot, "root", "left").withColumn("pack", F.coalesce(F.pmod(F.xxhash64("conv_id"), F.col("parts")), F.lit(0)))
    size = t.agg(chars.alias("n")).first()["n"] or 0
    bundles = max(1, -(-int(size) // BUNDLE_BYTES))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (x for batch in batches for x in batch.to_pylist())
        for (root, pack), found in groupby(rows, lambda x: (x["root"], x["pack"])):
            made = build_pack([(x["conv_id"], [(y["role"], y["text"]) for y in x["turns"]]) for x in found])
            yield pa.RecordBatch.from_pylist([{"root": root, "part": pack, "pack": made}], schema)

    spans = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
    segment = pa.struct([("part", pa.string()), ("conv_ids", pa.list_(pa.int64())), *((n, pa.int32()) for n in ("parent", "start", "size", "position", "loss_start", "loss_size")), ("attends", spans)])
    schema = pa.schema([("root", pa.int64()), ("part", pa.int64()), ("pack", pa.list_(segment))])
    # a task gets whole packs, one after another
    dealt = conv.select("conv_id", "turns", "root", F.col("pack").cast("long").alias("pack")).repartition(bundles, "root", "pack").sortWithinPartitions("root", "pack", "conv_id")
    return dealt.mapInArrow(run, f"root long, part long, {PACK}")


def conversations_of(packs: DataFrame) -> DataFrame:
    """Each conversation read back from its pack through the parents' chain: formatted text, turns, text under the loss mask."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sha = lambda s: hashlib.sha256(s.encode("utf-8", "surrogatepass")).hexdigest()
        for batch in batches:
            for pack in batch.column(0):
                rows, text = pack.as_py(), ""
                text = "".join(x["part"] for x in rows)
                out = []
                for x in rows:
                    if not x["conv_ids"]:
                        continue
                    chain, at = [], x
                    while at["parent"] >= 0:
                        chain.append(at)
                        at = rows[at["parent"]]
                    chain.append(at)
                    chain.reverse()
                    formatted = "".join(text[s["start"] : s["end"]] for s in x["attends"]) + text[x["start"] : x["start"] + x["size"]]
                    turns = parse(formatted)
                    loss = "".join(unescape(text[y["start"] + y["loss_start"] :][: y["loss_size"]]) for y in chain)
                    turned = "".join(f"{r}\n{t}\n" for r, t in turns)
                    out += [(c, len(turns), sha(turned), len(loss), sha(loss), len(formatted)) for c in x["conv_ids"]]
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(zip(*out, strict=True), kinds, strict=True)], names)

    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
    return packs.select("pack").mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def op9_chat_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    talk = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-1, 0, "user", talk), (-1, 1, "assistant", talk)], "conv_id long, turn long, role string, text string")
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    return conversations_of(chat_packs(rows.unionByName(extra)))
