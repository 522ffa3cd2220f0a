"""Suffix dedup, source divergence and the conversation trie, against brute force and SQL."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from turnlake.llm import divergence, prefix_trie, queries, shared, simhash, suffix_dedup, topk

# -- op11


def without_repeats(texts, size=suffix_dedup.WINDOW):
    raw = [(t or "").encode() for t in texts]
    seen = Counter(r[k : k + size] for r in raw for k in range(len(r) - size + 1))
    out = []
    for r in raw:
        gone = bytearray(len(r))
        for k in range(len(r) - size + 1):
            if seen[r[k : k + size]] > 1:
                gone[k : k + size] = b"\1" * size
        spans = len(re.findall(rb"\x01+", bytes(gone)))
        out.append((len(r), sum(gone), spans, bytes(b for b, g in zip(r, gone, strict=True) if not g)))
    return out


@pytest.mark.parametrize("alphabet", ["a", "ab", "abcdefghij"])
def test_suffixes_are_sorted_to_the_window(alphabet):
    rng = random.Random(alphabet)
    for _ in range(8):
        base = "".join(rng.choice(alphabet) for _ in range(700))
        raw = "".join(base[rng.randint(0, 300) :][: rng.randint(200, 400)] + "".join(rng.choice(alphabet) for _ in range(90)) for _ in range(6)).encode()
        places = np.array([k for k in range(len(raw) - 199) if rng.random() < 0.8])
        order, group = suffix_dedup.sorted_suffixes(np.frombuffer(raw, np.uint8), places)
        windows = [raw[p : p + 200] for p in places[order]]
        assert windows == sorted(windows)
        assert [a == b for a, b in zip(windows, windows[1:], strict=False)] == (np.diff(group) == 0).tolist()
    assert len(suffix_dedup.sorted_suffixes(np.zeros(0, np.uint8), np.zeros(0, np.int64))[0]) == 0


def test_equal_windows_share_their_anchor():
    rng = random.Random(5)
    shared = bytes(rng.randrange(97, 105) for _ in range(260))
    keys = []
    for _ in range(3):
        around = [bytes(rng.randrange(97, 105) for _ in range(rng.randint(0, 300))) for _ in range(2)]
        data = np.frombuffer(around[0] + shared + around[1], np.uint8)
        runs = suffix_dedup.anchor_runs(data, np.array([0, len(data)]))
        assert runs.n.sum() == len(data) - 199
        of = {int(s) + k: int(key) for s, n, key in zip(runs.start, runs.n, runs.key, strict=True) for k in range(n)}
        keys.append([of[len(around[0]) + k] for k in range(61)])
    assert keys[0] == keys[1] == keys[2]


@pytest.fixture(scope="module")
def passages(spark):
    rng = random.Random(11)
    prose = lambda n: "".join(rng.choice("abcde éß\n") for _ in range(n))
    p, q, edge = prose(420), prose(230), prose(199)
    texts = [None, "", "short", p, p[:200], p[1:201] + "x" + p[150:], prose(300) + q + prose(50) + q, "z" * 900, "zz" * 150, edge + "1", edge + "2", prose(1000)]
    texts += [prose(rng.randint(0, 120)) + p[rng.randint(0, 100) :] + prose(rng.randint(0, 120)) for _ in range(12)]
    texts += [texts[-1], prose(900) + texts[-2]]
    rows = [(k, t) for k, t in enumerate(texts)] + [(None, q + "!"), (None, q + "?"), (3, p), (4, "other " + prose(50)), (99, prose(3000) + p[:210]), (100, "é" * 150 + "x"), (101, "y" + "é" * 150)]
    frame = spark.createDataFrame([(i, t, 1, "x", "y", "z") for i, t in rows], "doc_id long, text string, key int, keys string, _id string, bucket string")
    return rows, frame


@pytest.mark.parametrize(("hot", "flush", "part"), [(1 << 16, 200_000, 1 << 20), (2, 5, 1 << 20), (1 << 16, 40, 500)])
def test_suffix_dedup(passages, monkeypatch, hot, flush, part):
    rows, frame = passages
    monkeypatch.setattr(suffix_dedup, "HOT", hot)
    want = [(i, *r) for (i, _), r in zip(rows, without_repeats([t for _, t in rows]), strict=True)]
    got = [(r[0], r[1], r[2], r[3], bytes(r[4])) for r in suffix_dedup.remove_repeated_bytes(frame).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    # the tasks' own parts again with small limits, without workers
    import pyarrow as pa

    monkeypatch.setattr(suffix_dedup, "FLUSH_KEYS", flush)
    monkeypatch.setattr(suffix_dedup, "FLUSH_SEGMENTS", flush)
    monkeypatch.setattr(suffix_dedup, "SLICE", part)
    monkeypatch.setattr(suffix_dedup.tx, "CHUNK_BYTES", part)
    monkeypatch.setattr(suffix_dedup, "_tables", {})
    texts = pa.array([t or "" for _, t in rows])
    ids, sums = pa.array(range(len(rows)), pa.int64()), pa.array([0] * len(rows), pa.int64())

    def reduce(sent, decide):
        entries = sorted((r for b in sent for r in b.to_pylist()), key=lambda r: (r["bucket"], r["kind"]))
        table = pa.Table.from_pylist(entries, schema=sent[0].schema)
        keys = defaultdict(list)
        for b in decide(iter(table.to_batches())):
            for r in b.to_pylist():
                keys[r["_id"]].append(r["key"])
        return pa.array([keys.get(k) for k in range(len(rows))], pa.list_(pa.int64()))

    asked = list(suffix_dedup._anchor_entries(6)(iter([pa.RecordBatch.from_arrays([ids, sums, texts], names="abc")])))
    shared = reduce(asked, suffix_dedup._shared_anchors(hot))
    sent = list(suffix_dedup._segment_entries(6)(iter([pa.RecordBatch.from_arrays([ids, sums, texts, shared], names="abcd")])))
    found = reduce(sent, suffix_dedup._repeats)
    (kept,) = suffix_dedup._kept_rows(iter([pa.RecordBatch.from_arrays([pa.array([i for i, _ in rows]), texts, found], names="abc")]))
    assert [tuple(r.values()) for r in kept.to_pylist()] == want


def test_op11_on_the_table(spark, data, duck, passages):
    rows = duck.sql("select doc_id, text from documents").fetchall()
    want = [(i, n, g, s, hashlib.sha256(k).hexdigest()) for (i, _), (n, g, s, k) in zip(rows, without_repeats([t for _, t in rows]), strict=True)]
    assert sorted(tuple(r) for r in queries.op11_suffix_dedup(spark, data).collect()) == sorted(want)
    assert suffix_dedup.remove_repeated_bytes(passages[1].limit(0)).count() == 0


# -- op12


def audited(rows, min_docs, top):
    rows = [tuple(x or "" for x in r) for r in rows]
    word = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
    fold = str.maketrans({chr(k): chr(k + 32) for k in range(65, 91)})
    count, docs = defaultdict(Counter), defaultdict(Counter)
    for text, lang, source in rows:
        found = Counter(word.findall(text.translate(fold)))
        count[lang, source].update(found)
        docs[lang].update(found.keys())
    out = []
    for lang in docs:
        kept = [t for t, n in docs[lang].items() if n >= min_docs]
        groups = [g for g in count if g[0] == lang]
        p = {}
        whole = sum((count[g] for g in groups), Counter())
        for name, c in [*((g[1], count[g]) for g in groups), (None, whole)]:
            n = sum(c[t] for t in kept)
            p[name] = {t: 1 + 10**9 * (c[t] + 5) // (n + 5 * len(kept)) for t in kept}
        for _, s in groups:
            pairs = [(o, sum(abs(p[s][t] - p[o][t]) for t in kept)) for _, o in groups if o != s]
            terms = [(t, p[s][t] - p[None][t]) for t in kept if count[lang, s][t] and p[s][t] > p[None][t]]
            for part, items, most in (("pair", pairs, None), ("term", terms, top)):
                items.sort(key=lambda x: (-x[1], x[0].encode()))
                out += [(lang, s, part, i, v, k) for k, (i, v) in enumerate(items[:most], 1)]
    return sorted(out)


@pytest.fixture(scope="module")
def sourced(spark):
    rng = random.Random(12)
    words = ["Alpha", "beta", "Éa", "é", "x1y", "don't", "同", "ß-z"] + [f"w{chr(97 + k)}" for k in range(20)]
    rows = [(" ".join(rng.choice(words) for _ in range(rng.randint(0, 30))), rng.choice(["en", "de", None]), rng.choice(["a", "b", "B", "é", None])) for _ in range(160)]
    rows += [(None, "en", "only null"), ("...", "xx", "s1"), ("rare", "xx", "s2"), ("word " * 5000, "en", "a")] + [rows[0]] * 3
    return rows, spark.createDataFrame([(k, *r, "x", 1) for k, r in enumerate(rows)], "doc_id long, text string, lang string, source string, term string, n int")


def test_source_divergence(sourced, monkeypatch):
    rows, frame = sourced
    for min_docs, top in ((5, 4), (30, 50), (10_000, 3)):
        assert sorted(tuple(r) for r in divergence.audit(frame, min_docs, top).collect()) == audited(rows, min_docs, top)
    assert divergence.audit(frame.limit(0)).count() == 0


def test_terms_of_long_texts(monkeypatch):
    rng = random.Random(3)
    text = "".join(rng.choice("aB é-1") for _ in range(5000)).encode()
    whole = divergence.terms(text)
    monkeypatch.setattr(divergence, "PIECE", 64)
    assert divergence.terms(text) == whole
    assert divergence.terms(b"a" * 1000) == {b"a" * 1000: 1}


def test_pairs_do_not_depend_on_tiles(sourced, monkeypatch):
    import pyarrow as pa

    rng = np.random.default_rng(4)
    names, whole = [f"s{k}" for k in range(7)], rng.integers(50, 90, 7)
    columns = [[{"source": names[k], "n": int(c)} for k, c in enumerate(rng.integers(0, 4, 7)) if c] for _ in range(40)]
    times = rng.integers(1, 5, 40)
    dense = np.array([[next((e["n"] for e in c if e["source"] == s), 0) for s in names] for c in columns])
    p = 1 + 10**9 * (dense + 5) // whole
    for tile in range(2):
        left = pa.table({"lang": ["en"] * 40, "tile": [tile] * 40, "slice": [0] * 40, "column": pa.array(columns), "terms": times})
        right = pa.table({"of_lang": ["en"] * 7, "of_tile": [tile] * 7, "of_slice": [0] * 7, "source": names, "whole": whole, "own": [k // 4 for k in range(7)]})
        got = {(r["source"], r["item"]): r["value"] for r in divergence._pair_sums(left, right).to_pylist()}
        assert got == {(names[a], names[b]): int((times * np.abs(p[:, a] - p[:, b])).sum()) for a in range(7) if a // 4 == tile for b in range(7)}


def test_op12_on_the_table(compare):
    compare(queries.op12_source_divergence, queries.ORACLE["op12_source_divergence"])


# -- op13


def trie(rows):
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            own[conv].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(v)] for c, v in own.items()}
    new = {}
    for c in own:
        h, base = zlib.crc32(str(c).encode()) % 9, c - (abs(c) % 5 * (1 if c >= 0 else -1))
        new[c] = own.get(base, [])[:h] + own[c][h:]
    members = defaultdict(list)
    for c, turns in new.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    children = Counter(k[:-1] for k in members if k)
    leaves, saved = Counter(), Counter()
    for k, m in members.items():
        for d in range(len(k) + 1):
            leaves[k[:d]] += children[k] == 0
            saved[k[:d]] += (len(m) - 1) * len(k[-1][1].encode()) if k else 0
    out = []
    for k, m in members.items():
        ends = ",".join(str(c) for c in sorted(m) if len(new[c]) == len(k))
        out.append((min(m), len(k), min(members[k[:-1]]) if k else None, len(m), children[k], leaves[k], saved[k], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


def test_prefix_trie(spark, monkeypatch):
    rng = random.Random(13)
    turn = lambda: (rng.choice(["user", "assistant", None]), rng.choice(["a", "b", "é", None, "same", "long " * 300]))
    rows = []
    start = [turn() for _ in range(40)]
    for conv in [*range(60), -1, -5, -6, 1003, 4_000_000_000]:
        n, keep = rng.choice([1, 2, 3, 9, 17, 33, 40]), rng.randint(0, 40)
        rows += [(conv, t if rng.random() < 0.95 else None, *(start[t] if t < keep else turn())) for t in range(n)]
    rows += [(70, 1, "user", "tie"), (70, 1, "user", "a tie"), (70, None, "user", "first"), (71, 1, "user", "x"), (71, 1, "user", "x"), (None, 1, "user", "lost")]
    rng.shuffle(rows)
    frame = spark.createDataFrame([(*r, "x", 1) for r in rows], "conv_id long, turn long, role string, text string, name string, depth int")
    assert sorted((tuple(r) for r in prefix_trie.build(frame).collect()), key=repr) == trie(rows)
    assert prefix_trie.build(frame.limit(0)).count() == 0


def test_ids_are_hashed_as_they_come(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(prefix_trie, "PACKED", 60)
    rows = [(d, r, c) for d, r in ((0, 1), (3, 1), (3, 2)) for c in range(1, 30 * r)]
    batches = [pa.RecordBatch.from_pydict({k: [x[i] for x in rows[a : a + 7]] for i, k in enumerate(("depth", "rep", "conv"))}) for a in range(0, len(rows), 7)]
    packed = [r for b in prefix_trie._packed(iter(batches)) for r in b.to_pylist()]
    assert len(packed) > 20
    again = [pa.RecordBatch.from_pydict({k: [x[k] for x in packed[a : a + 4]] for k in ("depth", "rep", "ids")}) for a in range(0, len(packed), 4)]
    got = {(r["depth"], r["rep"]): r["ends"] for b in prefix_trie._hashed(iter(again)) for r in b.to_pylist()}
    assert got == {(d, r): hashlib.sha256(",".join(str(c) for c in range(1, 30 * r)).encode()).hexdigest() for d, r in ((0, 1), (3, 1), (3, 2))}


def test_op13_on_the_table(compare):
    compare(queries.op13_prefix_trie, queries.ORACLE["op13_prefix_trie"])


# -- repairs of earlier operators


def test_composition_is_the_librarys():
    import unicodedata

    from tokenizers.normalizers import NFC

    from turnlake.llm import bpe

    library = NFC()
    marks = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000 and unicodedata.combining(chr(c))]
    assert len(marks) > 900
    for mark in marks:
        for other in "\u0324\u0301\u0345\u05b0":
            for text in ("a" + mark + other, "a" + other + mark, "e" + mark + other + mark + "\u0301x"):
                assert bpe.composed(text) == library.normalize_str(text), [hex(ord(c)) for c in text]
    for text in ("\U00011935\U00011930", "e\u0301\U00011930\u0301e\u0301", "", "plain"):
        assert bpe.composed(text) == library.normalize_str(text)


def test_a_text_too_long_to_learn_from_ends_no_sample(spark, monkeypatch):
    from pyspark.sql import functions as F

    from turnlake.llm import toxicity

    rows = [(k, f"word{k % 7} {'vile' if k % 3 == 0 else 'kind'}", int(k % 3 == 0)) for k in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    least = docs.filter(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0).orderBy(F.xxhash64("doc_id")).first().doc_id
    monkeypatch.setattr(toxicity, "MAX_BYTES", 40_000)
    huge = docs.withColumn("text", F.when(F.col("doc_id") == least, F.repeat(F.lit("long "), 20_000)).otherwise(F.col("text")))
    model = toxicity.train(huge.drop("toxic"), docs.drop("text"))
    assert len(model.index)
    judged = toxicity.score(docs, model).join(docs, "doc_id").collect()
    assert all((r.score >= 0.5) == bool(r.toxic) for r in judged)


# -- op9


def test_hosts_of_many_labels_cost_as_many_as_the_rules_have(spark):
    from turnlake.llm import urlfilter

    junk = "." * 300_000
    urls = [(1, f"http://{junk}org/x"), (2, f"http://{junk}a.example.org/es/1"), (3, f"http://{junk}"), (4, "http://org/"), (5, "http://es.example.org/en/1"), (6, "http://.fr.com/de/")]
    rules = urlfilter.rules_frame(spark, queries.URL_RULES)
    got = {r.page_id: (r.rule, r.verdict) for r in urlfilter.judge_urls(spark.createDataFrame(urls, "page_id long, url string"), rules).collect()}
    assert got == {1: ("org/", "allow"), 2: ("example.org/es/", "block"), 3: (None, "allow"), 4: ("org/", "allow"), 5: ("example.org/en/1", "block"), 6: ("com/de/", "block")}
    deep = urlfilter.rules_frame(spark, [("a.b.c.d", "/", "block"), ("d", "/", "allow"), ("", "/", "block")])
    got = {r.page_id: r.rule for r in urlfilter.judge_urls(spark.createDataFrame([(1, "x://z.a.b.c.d/"), (2, "x://b.c.d/"), (3, "x:///")], "page_id long, url string"), deep).collect()}
    assert got == {1: "a.b.c.d/", 2: "d/", 3: "/"}


# -- op7


def test_pages_without_written_heads_and_quoted_ends():
    from turnlake.llm import warc

    assert warc.plain_text("<html><head><title>T</title><p>visible") == "visible"
    assert warc.plain_text("<title>T</title>no tags <b>at all") == "no tags at all"
    assert warc.plain_text("<head><meta name=x><link rel=y>seen</head><body>too") == "seen\ntoo"
    assert warc.plain_text("<p title='a>b'>c<p data-x=\"d>e\">f") == "c\nf"
    assert warc.plain_text("<p it's>plain</p>don't") == "plain\ndon't"
    assert warc.plain_text("<p title='never closed>x</p>y") == "x\ny"
    assert warc.plain_text("a<script>no</script x>b<template-like>c</template-like><TITLE>n</TiTlE >d") == "ab\nc\nd"
    assert warc.plain_text("") == warc.plain_text("<script>") == warc.plain_text("<title>open") == ""
    page = "<html data-lang=no xml:lang='de'><title >a &amp;\n <b></title><title>second</title><a title='>' href=\"/x?a=1&amp;b\">l</a><a href=/x?a=1&b>m</a>"
    assert warc.page_facts(page, "http://h/") == ("a & <b>", "de", ["http://h/x?a=1&b"])


@pytest.mark.parametrize("unit", ["<title>", "<html ", "<a href='", '<p title=">', "<script>", "</script ", "<!--", "<a =", "</title", "<", "=\"", "<html lang  ", "x&"])
def test_long_pages_take_linear_time(unit):
    import time

    from turnlake.llm import warc

    page = unit * (2_000_000 // len(unit))
    start = time.monotonic()
    warc.plain_text(page), warc.page_facts(page, "http://h/")
    assert time.monotonic() - start < 20


def test_codings_of_responses_are_undone():
    import gzip
    import zlib

    from turnlake.llm import warc

    page = "<p>caf\u00e9 " + "word " * 40_000
    plain = page.encode()
    chunks = lambda b, n=1000: b"".join(b"%x;note=1\r\n%s\r\n" % (len(b[i : i + n]), b[i : i + n]) for i in range(0, len(b), n)) + b"0\r\nTrailer: x\r\n\r\n"
    raw = zlib.compressobj(wbits=-15)
    cases = [
        ("X-None: 1", plain), ("Content-Encoding: gzip", gzip.compress(plain)), ("content-encoding: x-gzip", gzip.compress(plain[:99]) + b"\0" * 40_000 + gzip.compress(plain[99:])),
        ("Content-Encoding: deflate", zlib.compress(plain)), ("Content-Encoding: deflate", raw.compress(plain) + raw.flush()), ("Transfer-Encoding: chunked", chunks(plain)),
        ("Transfer-Encoding: chunked\r\nContent-Encoding: gzip", chunks(gzip.compress(plain), 7)), ("Content-Encoding: deflate, gzip", gzip.compress(zlib.compress(plain))),
        # not coded as named, or in a way that is not known
        ("Content-Encoding: gzip\r\nTransfer-Encoding: chunked", plain), ("Content-Encoding: other", plain), ("Content-Encoding: deflate", plain),
    ]
    for header, payload in cases:
        block = f"HTTP/1.1 200 OK\r\n{header}\r\nContent-Type: text/html; charset=utf-8\r\n\r\n".encode() + payload
        source = dict.fromkeys(warc._ARROW.names) | {"record_id": "r", "fields": [], "block": block}
        metadata, conversion = warc.derivatives(source)
        assert conversion["block"].decode() == warc.plain_text(page), header
        assert {f["value"] for f in metadata["fields"]} == {warc.digest(payload)}
    # what a cut-off response holds is kept
    assert len(warc.body(gzip.compress(plain)[:-20], [("Content-Encoding", "gzip")])) > 1000
    assert warc.unchunked(chunks(plain)[:-3000]) in plain and warc.unchunked(b"") == b"" == warc.unzipped(b"")
    # many members take one pass
    assert warc.unzipped(gzip.compress(b"x" * 500) * 50_000) == b"x" * 25_000_000


def test_simhash_deals_no_more_parts_than_pairs(spark):
    rows = [(k * 7919 % 1009 << 20 | k, k) for k in range(300)]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "32")
        found = simhash.links(spark.createDataFrame(rows, "fp long, rep long"))
        assert found.rdd.getNumPartitions() == 1  # one block, one pair
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_top_k_copies_shards_for_few_blocks(spark, monkeypatch):
    for name, value in (("SHARD_ROWS", 60), ("BLOCK_ROWS", 50), ("CELL_ROWS", 20), ("LEAF", 16), ("STRIP", 7)):
        monkeypatch.setattr(topk, name, value)
    rng, asked, search = np.random.default_rng(3), [], topk._searched
    monkeypatch.setattr(topk, "_searched", lambda asks, *rest: asked.append(asks) or search(asks, *rest))
    vectors = rng.normal(size=(600, 6)) * np.array([0.2, 200.0, 0.2])[rng.integers(0, 3, 600)][:, None] * 10.0 ** rng.integers(0, 6, (600, 1))
    frame = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(vectors)], "vec_id long, embedding array<double>")
    got = {tuple(r) for r in topk.top_k(frame, frame.filter("vec_id % 6 = 0"), 5).collect()}
    whole = np.floor(vectors * 64).astype(np.int64)
    want = set()
    for i in range(0, 600, 6):
        score = whole @ whole[i]
        order = [k for k in np.lexsort((np.arange(600), -score)) if k != i][:5]
        want |= {(i, n + 1, int(k), int(score[k])) for n, k in enumerate(order)}
    assert got == want
    assert asked[1].select("block").distinct().count() <= 2  # 100 queries in blocks of 50, from about 30 home cells


def _edited(rng, count, words, change):
    """(id, text): families of texts with a few words changed, some by drift, and texts that share nothing."""
    rows, base = [], []
    for k in rng.sample(range(10 * count), count):
        if not base or rng.random() < 0.1:
            base = [f"w{rng.randrange(10**6)}" for _ in range(words)]
        text = list(base)
        for at in rng.sample(range(words), rng.randrange(change + 1)):
            text[at] = f"x{rng.randrange(10**6)}"
        if rng.random() < 0.3:
            base = text
        rows.append((k, " ".join(text)))
    return rows


@pytest.mark.parametrize("settled", [500_000, 2])
def test_copies_in_large_groups_are_the_first_by_id(spark, monkeypatch, settled):
    for name, value in (("SMALL", 6), ("LEADERS", 3), ("SALTS", 2), ("PAIRS", settled)):
        monkeypatch.setattr(simhash, name, value)
    rows = _edited(random.Random(12), 250, 120, 6)
    sets = {i: np.unique(np.array(simhash.shingle_hashes(t, 5), np.uint64)) for i, t in rows}
    stay, gone = [], {}
    for i in sorted(sets):
        like = next((j for j in stay if simhash.similar(sets[i], sets[j], 0.8)), None)
        if like is None:
            stay.append(i)
        else:
            gone[i] = like
    # every text is linked, so that there is one group
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.copy_of for r in simhash.copies(frame, radius=64, wide_radius=256).collect()}
    assert set(got) == set(gone) and 60 < len(gone) < 200
    # texts of one shingle set are copies of the least id, which may itself go
    near = {i: j for i, j in got.items() if not np.array_equal(sets[i], sets[j])}
    assert all(j in set(stay) and j < i and simhash.similar(sets[i], sets[j], 0.8) for i, j in near.items())
    assert len(near) > 30 and (settled < len(rows) ** 2 or all(gone[i] == j for i, j in near.items()))


def test_steps_over_a_large_group_do_not_grow_with_it(spark, monkeypatch):
    for name, value in (("SMALL", 6), ("LEADERS", 6)):
        monkeypatch.setattr(simhash, name, value)
    rng, steps, store = random.Random(3), [], simhash.stored
    monkeypatch.setattr(simhash, "stored", lambda frame: steps.append(1) or store(frame))
    base = [f"w{k}" for k in range(60)]
    taken = []
    for count in (9, 18):
        # all stay: half share nothing, half have a third of their shingles in common with the others
        rows = [(2 * k, " ".join(f"v{k}.{n}" for n in range(9))) for k in range(count)]
        rows += [(2 * k + 1, " ".join(base + [f"u{k}.{n}" for n in range(40)])) for k in range(count)]
        rng.shuffle(rows)
        steps.clear()
        assert simhash.copies(spark.createDataFrame(rows, "doc_id long, text string"), radius=64, wide_radius=256).count() == 0
        taken.append(len(steps))
    assert taken[0] == taken[1]


def test_similar_sets_share_one_of_their_first_hashes():
    rng = np.random.default_rng(9)
    for n in (1, 2, 4, 5, 9, 10, 63, 400):
        for _ in range(60):
            a = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64))
            b = np.unique(np.concatenate((a[rng.random(n) < 0.9], rng.integers(0, 1 << 63, n // 9 + 1, dtype=np.uint64))))
            rows = [pa.RecordBatch.from_pylist([{"root": 7, "_id": k, "shingles": s.tobytes()}]) for k, s in enumerate((a, b, a[:0]))]
            first = pa.Table.from_batches(simhash._prefixes(0.8)(rows)).to_pylist()
            held = [{r["hash"] for r in first if r["u"] == k} for k in range(3)]
            assert not held[2] and (held[0] & held[1] or not simhash.similar(a, b, 0.8))
            # in one batch a hash gets one row, and its other holders a link
            both = pa.Table.from_batches(simhash._prefixes(0.8)([pa.Table.from_batches(rows).combine_chunks().to_batches()[0]])).to_pylist()
            assert {r["hash"] for r in both if r["v"] is None} == held[0] | held[1] and sum(r["v"] is None for r in both) == len(held[0] | held[1])
            assert [(r["u"], r["v"]) for r in both if r["v"] is not None] == [(1, 0)] * bool(held[0] & held[1])


@pytest.mark.parametrize("again, more", [(0, True), (3600, False)])
def test_stored_lets_go_of_the_drivers_garbage(spark, monkeypatch, again, more):
    monkeypatch.setattr(shared, "LET_GO_S", again)
    beans = spark._jvm.java.lang.management.ManagementFactory.getGarbageCollectorMXBeans()
    old = lambda: sum(b.getCollectionCount() for b in beans if "Old" in b.getName() or "MarkSweep" in b.getName())
    before = old()
    assert shared.stored(spark.range(3)).count() == 3
    assert (old() > before) == more
