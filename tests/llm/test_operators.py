"""The ten operators against the libraries, brute force and held-out text, with the edge cases of their docstrings."""

from __future__ import annotations

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from normalog.llm import bpe_codec, chat_tree, disclosure, fingerprint_sketch, mixing, ppm, quality_hosts, repeats, simhash, token_counts
from normalog.llm.components import components

WORD = re.compile("[^\x20\x09-\x0d]+")
EDGE = ["", None, "   ", " \n\t", "a", "é ́e İI ß ſ", "ΑΣ Σ ΟΔΟΣ don't WE'LL 's", "<|endoftext|>a <|startoftext|>", "x" * 3000, "the the the " * 200, "\x85 x\x0bb\x1c   c", "中文 123456 ½ 👩‍👩‍👧‍👦"]
SCHEMA = "doc_id long, text string, source string, b binary, n long, key string"


@pytest.fixture(scope="module")
def texts():
    rnd = random.Random(1)
    parts = ["ab", "thein", "'s", "T", " ", "  ", "\n", "\t", "é", "́", "中", "1", "<|endoftext|>", "!?", ". "]
    return EDGE + ["".join(rnd.choice(parts) for _ in range(rnd.randint(1, 60))) for _ in range(150)]


@pytest.fixture(scope="module")
def docs(spark, texts):
    """Repeated rows, a null id and source, and columns whose names operators use themselves."""
    rows = [(i, t, f"s{i % 3}", b"x", 1, "k") for i, t in enumerate(texts)] + [(0, texts[0], "s0", b"x", 1, "k"), (None, "null id", None, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA)


def tokenizer(name):
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path(name))


def test_token_counts_are_the_librarys(docs):
    lib = tokenizer("word_bpe_49k.json")
    want = sorted((r.doc_id or -1, len((r.text or "").encode()), len(lib.encode(r.text or "", add_special_tokens=False).ids)) for r in docs.collect())
    got = token_counts.token_counts(docs).collect()
    assert sorted((r.doc_id or -1, r.n_bytes, r.n_tokens) for r in got) == want
    assert all(r.over_limit == (r.n_tokens > 2048) for r in got)


def test_codec_is_the_librarys(docs):
    lib = tokenizer("byte_bpe_50k.json")
    want = []
    for r in docs.collect():
        ids = lib.encode(r.text or "", add_special_tokens=False).ids
        want.append((r.doc_id or -1, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(lib.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    got = [(r.doc_id or -1, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe_codec.bpe_encode(docs).collect()]
    assert sorted(got) == sorted(want)


def shingle_set(t, k=5):
    w = WORD.findall(t or "")
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def test_fingerprints(spark, tiny):
    docs = spark.read.parquet(f"{tiny}/documents.parquet")
    text = {r.doc_id: r.text or "" for r in docs.collect()}
    ids = sorted(text)
    for r in fingerprint_sketch.fingerprints(docs).collect():
        t, after = text[r.doc_id], text[ids[(ids.index(r.doc_id) + 1) % len(ids)]]
        half = len(t) // 2
        edited = t[: len(t) - half] + after[:half]
        assert r.n_chars == len(t) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        for other, near in ((edited, r.near_edited), (after, r.near_next)):
            a, b = shingle_set(t), shingle_set(other)
            assert abs(near - (len(a & b) / len(a | b) if a | b else 1)) < 0.2


def test_fingerprint_edges_and_merging(spark, docs):
    assert fingerprint_sketch.fingerprints(docs).count() == docs.count()
    assert fingerprint_sketch.fingerprints(docs.limit(0)).count() == 0
    one = fingerprint_sketch.fingerprints(spark.createDataFrame([(1, "a b c d e f")], "doc_id long, text string")).first()
    assert one.near_next == 1.0
    long = " ".join(f"w{i}" for i in range(5000))
    r = spark.createDataFrame([(1, long, "s"), (2, " ".join(long.split()[:2500]), "s")], "doc_id long, text string, source string")
    s = r.withColumn("s", fingerprint_sketch.sketch(F.col("text")))
    a, b = (F.max(F.when(F.col("doc_id") == i, F.col("s"))) for i in (1, 2))
    x = s.agg(a.alias("a"), b.alias("b")).select(fingerprint_sketch.containment(F.col("b"), F.col("a")).alias("c"), fingerprint_sketch.distinct_shingles(F.col("a")).alias("n"), F.col("a")).first()
    assert x.c > 0.75 and abs(x.n / 4996 - 1) < 0.3
    assert fingerprint_sketch.sketch_groups(r, "source").first().sketch == x.a


def classes(nodes, linked):
    label = {n: n for n in nodes}

    def root(n):
        while label[n] != n:
            n = label[n]
        return n

    for a, b in linked:
        a, b = sorted((root(a), root(b)))
        label[b] = a
    return {n: root(n) for n in nodes}


@pytest.mark.parametrize("limit", [8192, 16])
def test_simhash_links(spark, limit):
    rnd, points = random.Random(3), set()
    for _ in range(40):
        x = rnd.getrandbits(64)
        for _ in range(rnd.choice([1, 2, 10, 60])):
            y = x
            for _ in range(rnd.randint(0, 6)):
                y ^= 1 << rnd.randrange(64)
            points.add(y)
    a = np.array(sorted(points), np.uint64)
    near = np.argwhere(np.bitwise_count(a[:, None] ^ a[None, :]) <= 3)
    s = a.view(np.int64).tolist()
    want = classes(s, [(s[i], s[j]) for i, j in near])
    want = {k: v for k, v in want.items() if sum(x == v for x in want.values()) > 1}
    fps = spark.createDataFrame([(x,) for x in s], "fp long")
    assert {r.node: r.root for r in components(simhash.links(fps, 3, limit)).collect()} == want


def test_simhash_components(docs):
    own = {}
    import xxhash

    for r in docs.collect():
        w = (r.text or "").encode().lower().split()
        sh = [b" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
        h = [xxhash.xxh64_intdigest(x, 42) for x in sh]
        own[r.doc_id] = sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))
    ids = [i for i in own if i is not None]
    want = classes(ids, [(i, j) for i in ids for j in ids if (own[i] ^ own[j]).bit_count() <= 3])
    got = simhash.near_duplicates(docs).collect()
    assert {r.doc_id: r.fp % 2**64 for r in got} == own
    assert {r.doc_id: r.component_id for r in got if r.doc_id is not None} == want
    assert len(got) == docs.count()
    assert simhash.near_duplicates(docs.limit(0)).count() == 0


def brute_near_copies(rows):
    """The smallest id of each text's component, by all pairs of wide fingerprints. rows: (id, text)."""
    f = [(i, simhash.wide_fingerprint(simhash.shingle_hashes((t or "").encode(), 5))) for i, t in rows if i is not None]
    ids = np.array([i for i, _ in f])
    every = np.array([x for _, x in f])
    near = np.argwhere(simhash.distance(every[:, None], every[None, :]) <= simhash.NEAR)
    return classes(sorted(set(ids.tolist())), [(int(ids[i]), int(ids[j])) for i, j in near if ids[i] < ids[j]])


@pytest.fixture(scope="module")
def near_texts():
    rnd, rows = random.Random(8), {}
    for g in range(12):
        base = [f"g{g}w{rnd.randrange(400)}" for _ in range(rnd.choice([4, 9, 40, 120]))]
        for _ in range(rnd.choice([1, 2, 9])):
            w = list(base)
            for _ in range(rnd.randrange(1 + len(w) // 25)):
                w[rnd.randrange(len(w))] = rnd.choice(["new", "New", "other"])
            rows[len(rows) * 7 % 97 + 100 * g] = " ".join(w)
    return rows


@pytest.mark.parametrize("limit", [8192, 3])
def test_near_copies_are_all_pairs(spark, near_texts, limit):
    d = spark.createDataFrame(list(near_texts.items()), "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in simhash.near_copies(d, shard_limit=limit).collect()} == brute_near_copies(near_texts.items())
    assert simhash.near_copies(d.limit(0)).count() == 0


def test_near_copies_find_likeness(spark):
    """Of all pairs of different texts with a five-word likeness of 0.8 or more, at least 9 of 10 share a component."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    sets = {}
    for r in docs.collect():
        sets.setdefault(frozenset(shingle_set(re.sub("[A-Z]+", lambda m: m[0].lower(), r.text or ""))), r.doc_id)
    holders = collections.defaultdict(list)
    for h, i in sets.items():
        for x in h:
            holders[x].append(i)
    shared = collections.Counter((a, b) for own in holders.values() for a in own for b in own if a < b)
    size = {i: len(h) for h, i in sets.items()}
    pairs = [p for p, c in shared.items() if 5 * c >= 4 * (size[p[0]] + size[p[1]] - c)]
    own = {r.doc_id: r.component_id for r in simhash.near_copies(docs).collect()}
    assert pairs and sum(own[a] == own[b] for a, b in pairs) >= 0.9 * len(pairs)


#: Names that operators use themselves.
CLASH = ["key", "_key", "_marks", "marks", "_id", "id", "row", "_row", "fp", "pack", "t", "n", "node", "m", "_m", "_source", "_text", "size", "block", "shard", "placements"]


def test_stages_keep_every_row_and_column(spark, near_texts):
    """Columns of any name, null and repeated ids, repeated ids with different texts, empty tables."""
    import corpus_pipeline

    text = {**{i: f"{t} me{i % 3}@corp.example " * 3 + " ".join(f"w{i}x{j}" for j in range(60)) for i, t in near_texts.items()}, 9000: None, 9001: "", 9002: " ".join(f"u{j}" for j in range(70))}
    rows = [(i, t, "en", f"s{i % 2}", 1) for i, t in text.items()] + [(9002, text[9002], "en", None, 1), (9002, "other text " + text[9002][::-1], "en", "s1", 2), (None, text[9002], "en", "s0", 1)]
    d = spark.createDataFrame([(*r, *(f"{c}{r[4]}" for c in CLASH)) for r in rows], "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in CLASH))
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, d, "")
        got = out.collect()
        assert stage(spark, d.limit(0), "").count() == 0, name
        if name == "BPE encoding":
            assert len(got) == len(rows)
            continue
        assert out.columns == d.columns and got, name
        assert all(r[c] == f"{c}{r.n_chars}" for r in got for c in CLASH), name
        if name == "near-dedup":
            stays = brute_near_copies([r[:2] for r in rows])
            # one id with two texts stays if either is its component's first
            assert {r.doc_id for r in got if r.doc_id is not None} == {i for i, c in stays.items() if i == c}
            assert sum(r.doc_id is None for r in got) == 1 and sum(r.doc_id == 9002 for r in got) == 2
        if name == "PII":
            assert len(got) == len(rows) and not any("@" in (r.text or "") for r in got)


def brute_targets(words):
    names = sorted(words, key=lambda s: (s is None, s or ""))
    weight = {s: i % 3 + 1 for i, s in enumerate(names)}
    out, left, open_ = {}, sum(words.values()), set(names)
    while open_:
        level = left / sum(weight[s] for s in open_)
        over = {s for s in open_ if level * weight[s] > 3 * words[s]}
        if not over:
            return out | {s: level * weight[s] for s in open_}
        out |= {s: 3 * words[s] for s in over}
        left -= sum(out[s] for s in over)
        open_ -= over
    return out


def test_mixing(spark, tiny, docs):
    for d in (spark.read.parquet(f"{tiny}/documents.parquet"), docs):
        size, source = {}, {}
        words = collections.Counter()
        for r in d.collect():
            size[r.doc_id], source[r.doc_id] = len(WORD.findall(r.text or "")), r.source
            words[r.source] += size[r.doc_id]
        want, taken = brute_targets(words), collections.Counter()
        first = mixing.mix(d).collect()
        for r in first:
            assert r.size == size[r.doc_id] and r.source_size == words[source[r.doc_id]]
            assert r.target == pytest.approx(want[source[r.doc_id]])
            assert 0 <= r.taken <= 3 * r.size
            taken[source[r.doc_id]] += r.taken
        for s, t in want.items():
            left = [size[i] for i in size if source[i] == s and size[i]]
            assert t - 3 * max(left, default=0) <= taken[s] <= t + 1e-6
        again = mixing.mix(d.repartition(7)).collect()
        key = lambda r: (r.doc_id is not None, r.doc_id or 0, r.taken)
        assert sorted(first, key=key) == sorted(again, key=key)
        full = mixing.mixed(d)
        assert full.columns == d.columns and sum(len(WORD.findall(r.text or "")) for r in full.collect()) == sum(taken.values())
    assert mixing.mix(docs.limit(0)).count() == 0


def test_splitting_tree_is_exact_and_fair(spark):
    q = spark.createDataFrame([(False, f"s{i}", 40 + i) for i in range(5)], "_null boolean, _source string, q long")
    got = mixing.split(q, 8, 1).collect()
    by_source = collections.Counter()
    by_shard = collections.Counter()
    for r in got:
        by_source[r._source] += r.q
        by_shard[r.shard] += r.q
    assert by_source == {f"s{i}": 40 + i for i in range(5)} and max(by_shard.values()) - min(by_shard.values()) <= 1


def test_scoring(spark, tiny):
    docs = spark.read.parquet(f"{tiny}/documents.parquet")
    text = {r.doc_id: (r.text or "").encode().lower() for r in docs.collect()}
    held = lambda i: zlib.crc32(str(i).encode()) % 5 == 1
    c = collections.Counter()
    for i, t in text.items():
        if not held(i):
            c.update([*t.split(), None])
    n, v = sum(c.values()), len(c)
    got = ppm.score(docs).collect()
    assert len(got) == len(text)
    for r in got:
        w = [*text[r.doc_id].split(), None]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held(r.doc_id), len(w), sum(c[x] > 0 for x in w), n)
        assert r.base_score == pytest.approx(sum(math.log10((c[x] + 0.5) / (n + 0.5 * (v + 1))) for x in w))
    out = [r for r in got if r.held_out]
    chars = sum(len(text[r.doc_id]) + 1 for r in out)
    assert -sum(r.score for r in out) / chars / math.log10(2) < 3.2


def plain_walk(taught, order):
    """PPM's log10 probability of a text, symbol by symbol over dictionaries: method D, update exclusion, exclusion."""
    seen = [collections.defaultdict(collections.Counter) for _ in range(order + 1)]
    for t in taught:
        s = [257] * order + list(t) + [256]
        for i in range(order, len(s)):
            seen[order][tuple(s[i - order : i])][s[i]] += 1
    for k in range(order, 0, -1):
        for ctx, after in seen[k].items():
            for x in after:
                seen[k - 1][ctx[1:]][x] += 1

    def symbol(ctx, x):
        out, ruled = 0.0, set()
        for k in range(order, -1, -1):
            after = seen[k].get(ctx[order - k :])
            if not after:
                continue
            left = {y: c for y, c in after.items() if y not in ruled}
            if x in left:
                return out + math.log10((left[x] - 0.5) / sum(left.values()))
            if left:
                out += math.log10(0.5 * len(left) / sum(left.values()))
            ruled |= set(after)
        return out - math.log10(257 - len(ruled))

    def score(t):
        s = [257] * order + list(t) + [256]
        return sum(symbol(tuple(s[i - order : i]), s[i]) for i in range(order, len(s)))

    return score


@pytest.mark.parametrize("order", [2, 5])
def test_scores_are_a_plain_walks(spark, docs, monkeypatch, order):
    """In one step and in many; long texts in slices."""
    monkeypatch.setattr(ppm, "SLICE", 700)
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 5 == 1
    lower = lambda t: (t or "").encode().lower()
    rows = docs.collect()
    walk = plain_walk([lower(r.text) for r in rows if not held(r.doc_id)], order)
    want = sorted((r.doc_id or -1, round(walk(lower(r.text)), 6)) for r in rows)
    for size, group in ((ppm.STEP, 1024), (3000, 2)):
        got = ppm.score(docs, order=order, step_bytes=size, steps_a_group=group).collect()
        got = sorted((r.doc_id or -1, round(r.score, 6)) for r in got)
        assert [i for i, _ in got] == [i for i, _ in want] and [x for _, x in got] == pytest.approx([x for _, x in want], abs=1e-5)


def test_slices_are_the_whole_text(monkeypatch):
    texts = [b"the cat sat on the mat", b"", b"aaaa", bytes(range(256)) * 3, b"x"]
    whole, _ = ppm.contexts(texts, 4)
    monkeypatch.setattr(ppm, "SLICE", 10)
    assert np.concatenate([g for g, _, _ in ppm.sliced(texts, 4)]).tolist() == whole.tolist()


def test_trie_is_a_distribution(spark, docs):
    data = [b"the cat sat on the mat", b"the dog", b"", b"aaaa"]
    g, start = ppm.contexts(data, 3)
    assert len(g) == sum(len(t) + 1 for t in data) and list(start) == [0, 23, 31, 32]
    key, n = np.unique(g, return_counts=True)
    trie = ppm.Trie(key, n, 3)
    for ctx in ([257, 257, 257], [116, 104, 101], [200, 1, 32], [97, 97, 97]):
        packed = 0
        for s in ctx:
            packed = packed << 9 | s
        assert (10 ** trie.log10(np.array([packed << 9 | y for y in range(257)]))).sum() == pytest.approx(1)
    assert ppm.score(docs.limit(0)).count() == 0
    # nothing to train on: all symbols alike
    only = docs.where("doc_id % 5 = 0").limit(1).selectExpr("CAST(6 AS BIGINT) AS doc_id", "'abc' AS text")
    i = next(i for i in range(50) if zlib.crc32(str(i).encode()) % 5 == 1)
    assert ppm.score(only.withColumn("doc_id", F.lit(i))).first().score == pytest.approx(-4 * math.log10(257))


def brute_hosts(docs):
    """Rejected hosts. docs: (text, host)."""
    by_host = collections.defaultdict(list)
    for text, host in docs:
        w = WORD.findall(text or "")
        grams = collections.Counter(zip(w, w[1:], w[2:], strict=False))
        again = {i + k for i in range(len(w) - 2) if grams[tuple(w[i : i + 3])] > 1 for k in range(3)}
        lines = [x for x in (text or "").split("\n") if WORD.search(x)]
        symbols = sum(c in "#*$%&|<>" for c in text or "")
        by_host[host].append((len(w) < 50, 100 * len(again) > 50 * len(w), 10 * symbols > len(w), 10 * (len(lines) - len(set(lines))) > 3 * len(lines)))
    out = set()
    for rule in range(4):
        bad = {h: (sum(x[rule] for x in own), len(own)) for h, own in by_host.items()}
        low, m, high = np.quantile([f / n for f, n in bad.values()], [0.25, 0.5, 0.75])
        sd = (high - low) / 1.349
        weight = min(max(m * (1 - m) / sd**2 - 1, 1), 20) if sd > 0 else 20
        for h, (f, n) in bad.items():
            rate = (f + m * weight) / (n + weight)
            if rate - 2 * math.sqrt(rate * (1 - rate) / (n + weight + 1)) > max(m + 3 * sd, 0.5):
                out.add(h)
    return out


def test_quality(spark, docs):
    """Hosts that mostly fail one rule go as a whole; the SQL and a plain count agree."""
    duckdb = pytest.importorskip("duckdb")
    good = lambda i: " ".join(f"w{i}x{j}" for j in range(60))
    rows = [(i, r.text, r.source) for i, r in enumerate(docs.collect())] + [(1000 + i, good(i), f"good{i % 30}") for i in range(240)]
    rows += [(2000 + i, "bad page" if i % 4 else good(i), "spam") for i in range(300)] + [(3000 + i, good(i) + " # * | <" * (4 if i % 5 else 0), "signs") for i in range(300)]
    rows += [(4000 + i, good(i) + "\nbuy now\nbuy now\nbuy now" * (i % 3 > 0), "lines") for i in range(300)] + [(5000, "one bad page", "few")]
    d = spark.createDataFrame(rows, "doc_id long, text string, source string")
    pdf = d.toPandas()
    con = duckdb.connect()
    con.register("documents", pdf.astype(object).where(pdf.notna(), None))
    rel = con.sql(quality_hosts.ORACLE)
    got = quality_hosts.quality(d).select(*rel.columns).collect()
    assert sorted(map(tuple, got)) == sorted(rel.fetchall())
    assert {r.doc_id for r in quality_hosts.keep_good(d).collect()} == {r.doc_id for r in got if r.kept}
    gone, host = brute_hosts([r[1:] for r in rows]), {r[0]: r[2] for r in rows}
    assert gone >= {"spam", "signs", "lines"} and not gone & {"few", *(f"good{i}" for i in range(30))}
    assert {r.doc_id for r in got if r.kept} == {r.doc_id for r in got if not r.base_failed and host[r.doc_id] not in gone}
    assert quality_hosts.quality(d.limit(0)).count() == 0


def luhn(d):
    return sum((x - 9 if x > 9 else x) for x in (int(c) * (1 + i % 2) for i, c in enumerate(reversed(d)))) % 10 == 0


#: The contract's patterns and tests.
KINDS = {
    "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
    "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m.split("."))),
    "card": (r"[0-9]([\x20-]?[0-9])+", lambda m: 13 <= len(d := re.sub("[^0-9]", "", m)) <= 19 and luhn(d)),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 9 <= len(re.sub("[^0-9]", "", m)) <= 15),
}


def test_personal_data(spark):
    rnd = random.Random(5)
    pool = ["a@b.c", "_d@e.f", "1.2.3.4", "1.2.3.4.5.6.7.8", "256.1.1.1", "001.2.3.0255", "4111 1111 1111 1111", "4111-1111-1111-1111", "+1 (555) 123-4567", "+1", "@x.y", " ", "é", "a.b-c@d-e.f-g.h", "9", " 4", "-", "\n", "x@y"]
    text = {i: "".join(rnd.choice(pool) for _ in range(rnd.randint(1, 12))) for i in range(200)}
    text |= {900: "9" * 20000, 901: "a" * 30000 + "@", 902: None, 903: "1.2." * 5000, 904: "", 905: "clean words only"}
    d = spark.createDataFrame(list(text.items()), "doc_id long, text string")
    for r in disclosure.find(d).collect():
        want = [(k, m.start(), m.end()) for k, (p, f) in KINDS.items() for m in re.finditer(p, text[r.doc_id] or "") if f(m[0])]
        assert [(x.kind, x.s, x.e) for x in r.base] == want
        assert r.base_sha256 == hashlib.sha256(",".join(f"{k}:{s}:{e}" for k, s, e in want).encode()).hexdigest()
    assert disclosure.find(d.limit(0)).count() == 0


def brute_terms(rows, support=2, share=0.8, part=0.9):
    """(row, start, end) of every disclosing term. rows: texts."""
    punct = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
    held, words, where = [], [], []
    for t in rows:
        spans = [(k, m.start(), m.end()) for k, (p, f) in KINDS.items() for m in re.finditer(p, t) if f(m[0])]
        held.append({f"{k}:{t[s:e].lower()}" for k, s, e in spans})
        places = collections.defaultdict(set)
        for m in WORD.finditer(t):
            w = m[0].strip(punct)
            if w and not any(s < m.end() and m.start() < e for _, s, e in spans):
                at = m.start() + len(m[0]) - len(m[0].lstrip(punct))
                places[w.lower()].add((at, at + len(w)))
        where.append(places)
        words.append({m[0].strip(punct).lower() for m in WORD.finditer(t)})
    n, out = len(rows), set()
    for e in set().union(*held):
        own = [i for i in range(n) if e in held[i]]
        if len({rows[i] for i in own}) < support:
            continue
        for w in set().union(*(where[i] for i in own)):
            both = [i for i in own if w in where[i]]
            df = max(len(both), sum(w in x for x in words))
            p, ic = len(both) / df, -math.log2(len(own) / n)
            pmi = math.log2(p * n / len(own))
            if len({rows[i] for i in both}) >= support and sum(w in x for x in words) >= support and p >= share and pmi > 0 and pmi >= part * ic:
                out |= {(i, *x) for i in both for x in where[i][w]}
    return out


def test_disclosing_terms(spark):
    """At the default thresholds, against all pairs; a code name far from a shared address is found, common words are not."""
    rnd = random.Random(11)
    common = [f"common{i}" for i in range(30)]
    filler = lambda n: " ".join(rnd.choice(common) for _ in range(n))
    rows = [f"{filler(20)} (Zorblax), {filler(30)} zorblax {filler(5)} me@corp.example {filler(9)} unique{i}" for i in range(5)]
    rows += [f"{filler(12)} call +49 (30) 1234-{5678 + i % 2} tel:10.0.0.{i % 3} {filler(4)} rare{i % 4}! {filler(3)}" for i in range(12)]
    rows += [filler(20) for _ in range(40)] + ["zorblax alone? no", "", rows[0]]
    d = spark.createDataFrame([(i, t, i) for i, t in enumerate(rows)], "doc_id long, text string, term long")
    found = {r.doc_id: [(x.s, x.e) for x in r.terms] for r in disclosure.find(d).collect()}
    want = brute_terms(rows)
    assert {(i, *x) for i, own in found.items() for x in own} == want
    assert all("Zorblax" in {rows[i][s:e] for s, e in found[i]} for i in range(5)) and "unique3" not in {rows[3][s:e] for s, e in found[3]}
    clean = disclosure.sanitise(d)
    assert clean.columns == d.columns
    for r in clean.collect():
        assert "@" not in r.text and (r.doc_id >= 17 or r.doc_id >= 5 or "orblax" not in r.text)
        if 17 <= r.doc_id < 58:
            assert r.text == rows[r.doc_id]


def test_many_spans_in_one_text(spark):
    """Thousands of entities in one text: places stay right across the scans' chunks."""
    text = " ".join(f"user{i}@host{i % 7}.example and 10.0.{i % 250}.{i % 200}" for i in range(3000))
    r = disclosure.find(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    want = [(k, m.start(), m.end()) for k, (p, f) in KINDS.items() for m in re.finditer(p, text) if f(m[0])]
    assert [(x.kind, x.s, x.e) for x in r.base] == want and len(want) == 6000
    clean = disclosure.sanitise(spark.createDataFrame([(1, text)], "doc_id long, text string")).first().text
    assert clean == " ".join("[EMAIL] and [IP]" for _ in range(3000))


def brute_repeats(docs):
    first, out = {}, {}
    for i, t in sorted(docs.items()):
        for j in range(len(t) - 49):
            first.setdefault(t[j : j + 50], i)
    for i, t in docs.items():
        gone = bytearray(len(t))
        for j in range(len(t) - 49):
            if first[t[j : j + 50]] < i:
                gone[j : j + 50] = b"\1" * 50
        out[i] = (len(t), sum(gone), sum(1 for k in range(len(t)) if gone[k] and (not k or not gone[k - 1])), bytes(c for c, g in zip(t, gone, strict=True) if not g))
    return out


def test_repeats(spark, monkeypatch):
    rnd = random.Random(2)
    passages = ["".join(rnd.choice("abcd e") for _ in range(rnd.choice([49, 50, 51, 60, 83, 100, 400]))) for _ in range(20)]
    text = {}
    for i in range(150):
        t = ""
        for _ in range(rnd.randint(0, 5)):
            p, x = rnd.choice(passages), rnd.random()
            a, b = (rnd.randint(0, len(p) // 3) if rnd.random() < 0.5 else 0 for _ in range(2))
            t += p[a : len(p) - b] if x < 0.6 else "".join(rnd.choice("abcdefgh ") for _ in range(rnd.randint(0, 80))) if x < 0.8 else rnd.choice(["ab", "é", "the ", "a"]) * rnd.randint(1, 80)
        text[i * 3 - 50] = t
    want = brute_repeats({i: t.encode() for i, t in text.items()})
    d = spark.createDataFrame([*text.items(), (-50, text[-50]), (None, "x" * 100), (10**9, None)], "doc_id long, text string").repartition(5)
    got = repeats.without_repeats(d).collect()
    assert len(got) == 153
    for r in got:
        if r.doc_id in want:
            assert (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) == want[r.doc_id]
        else:
            assert r.n_removed == 0
    assert repeats.without_repeats(d.limit(0)).count() == 0


def test_anchors_meet_across_blocks(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(repeats, "ROWS", 0)
    rows = [(1, 9, 5, 0, 0), (7, 2, 5, 10, 0), (7, 3, 6, 20, 0), (8, 4, 5, 30, 0)]
    names = ["key", "doc", "seg", "pos", "n"]
    for border in range(1, len(rows)):
        parts = [pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in x]) for x in (rows[:border], rows[border:])]
        asked = {(r["doc"], r["pos"]) for b in repeats.meet(iter(parts)) for r in b.to_pylist() if r["n"] == 0}
        assert asked >= {(2, 10), (3, 20)}, border


def test_pieces_of_long_texts_agree(monkeypatch):
    rnd = random.Random(4)
    text = bytes(rnd.choice(b"abc ") for _ in range(5000))
    whole = repeats.anchors_of(np.array([1]), [text])
    monkeypatch.setattr(repeats, "PIECE", 600)
    parts = repeats.anchors_of(np.array([1]), [text])
    seen = lambda a: set(zip(*(x.tolist() for x in a), strict=True))
    assert seen(parts) == seen(whole)


def test_refinement_numbers_equal_windows():
    shards = [[b"abcabcabd", b"xxabca"], [b"abcabc", b""]]
    of, at, interval = repeats.refine(shards, 4)
    every = [s for sh in shards for s in sh]
    groups = collections.defaultdict(set)
    for o, a, i in zip(of, at, interval, strict=True):
        groups[i].add((o, a))
    want = collections.defaultdict(set)
    for o, s in enumerate(every):
        for a in range(len(s) - 3):
            want[s[a : a + 4]].add((o, a))
    assert sorted(map(sorted, groups.values())) == sorted(sorted(v) for v in want.values() if len(v) > 1)


def plain_transform(strings):
    """(string, place, symbol before, common prefix) of all suffixes in order; terminators differ and sort by string."""
    rows = sorted((tuple(s[j:]), i, j) for i, s in enumerate(strings) for j in range(len(s) + 1))
    # a terminator sorts before any symbol, so shorter first and then by string: tuples do just that
    out, above = [], None
    for t, i, j in rows:
        same = 0
        if above is not None:
            while same < min(len(t), len(above)) and t[same] == above[same]:
                same += 1
        out.append((i, j, strings[i][j - 1] if j else -1, same))
        above = t
    return out


def test_interleave_is_the_unions_transform():
    rnd = random.Random(8)
    for trial in range(30):
        strings = [bytes(rnd.choice(b"ab" if trial % 2 else b"abc\x00\xff") for _ in range(rnd.randint(0, 25))) for _ in range(rnd.randint(1, 9))]
        cuts = sorted(rnd.randint(0, len(strings)) for _ in range(trial % 4))
        shards = [x for x in (strings[a:b] for a, b in zip([0, *cuts], [*cuts, len(strings)], strict=True)) if x]
        home, symbol, common = repeats.interleave([repeats.Shard(x, 4) for x in shards])
        want = plain_transform(strings)
        shard_of = [k for k, x in enumerate(shards) for _ in x]
        assert list(home) == [shard_of[i] for i, *_ in want]
        assert list(symbol) == [s for _, _, s, _ in want]
        assert list(common) == [c for *_, c in want]
        alone = repeats.Shard(strings, 4)
        assert [(alone.of[p], p - alone.start[alone.of[p]], s) for p, s in zip(alone.place, alone.symbol, strict=True)] == [(i, j, s) for i, j, s, _ in want]


def test_refinement_is_alike_for_any_shards():
    rnd = random.Random(9)
    bits = [bytes(rnd.choice(b"abc \x00\xff") for _ in range(rnd.randint(3, 30))) for _ in range(12)]
    strings = sorted({b"".join(rnd.choice(bits) for _ in range(rnd.randint(0, 6))) for _ in range(120)})
    rnd.shuffle(strings)
    for window in (1, 4, 9, 50):
        want = collections.defaultdict(set)
        for o, s in enumerate(strings):
            for a in range(len(s) - window + 1):
                want[s[a : a + window]].add((o, a))
        want = sorted(sorted(v) for v in want.values() if len(v) > 1)
        for width in (1, 7, 50, 500):
            shards = [strings[i : i + width] for i in range(0, len(strings), width)]
            of, at, interval = repeats.refine([[], *shards, []], window)
            assert list(interval) == sorted(interval)
            groups = collections.defaultdict(set)
            for o, a, i in zip(of, at, interval, strict=True):
                groups[i].add((o, a))
            assert sorted(map(sorted, groups.values())) == want, (window, width)
    assert all(len(x) == 0 for x in repeats.refine([], 4)) and all(len(x) == 0 for x in repeats.refine([[b""]], 4))


def test_chat(spark):
    rnd = random.Random(6)
    bits = ["</s>", "[INST] ", " [/INST]", "<s>", "\\", "<<SYS>>", "<</SYS>>", "a", "\n", "é", " "]
    make = lambda: "".join(rnd.choice(bits) for _ in range(rnd.randint(0, 6)))
    rows = []
    for c in range(60):
        rows += [(c, t, rnd.choice(["user", "assistant", "system", "tool\nx\\", None]), rnd.choice([None, "same", make()])) for t in range(rnd.randint(1, 6))]
    rows += [(100 + c, t, r, x) for c in range(40) for t, r, x in ((0, "user", "hot"), (1, "assistant", "hi"), (2, "user", f"q{c % 7}"))]
    rows += [(5, 0, "user", "twice"), (5, 0, "user", "twice"), (None, 0, "user", "nobody")]
    d = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("pack", F.lit(1))
    want = collections.defaultdict(list)
    for c, t, r, x in rows:
        want[c].append((t, r or "", x or ""))
    packs = chat_tree.chat_packs(d, pack_limit=8)
    got = {r.conv_id: r for r in chat_tree.conversations_of(packs).collect()}
    assert set(got) == set(want)
    for c, turns in want.items():
        turns.sort()
        said = "".join(x for _, r, x in turns if r == "assistant")
        r = got[c]
        assert (r.n_turns, r.loss_chars) == (len(turns), len(said))
        assert r.turns_sha256 == hashlib.sha256("".join(f"{r}\n{x}\n" for _, r, x in turns).encode()).hexdigest()
        assert r.loss_sha256 == hashlib.sha256(said.encode()).hexdigest()
    for p in packs.collect():
        at = 0
        for s in p.pack:
            assert s.start == at and s.size == len(s.part)
            at += s.size
            assert s.position == sum(x.end - x.start for x in s.attends)
    assert chat_tree.chat_packs(d.limit(0)).count() == 0


def test_pipeline_stages(spark, tiny):
    import corpus_pipeline

    docs = spark.read.parquet(f"{tiny}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert len(names) == 5
    seen = docs
    for (_, stage), last in zip(corpus_pipeline.STAGES, [False] * 4 + [True], strict=True):
        out = stage(spark, seen, tiny)
        assert last or out.columns == docs.columns
        seen = out
    assert 0 < seen.count() <= 3 * docs.count()
