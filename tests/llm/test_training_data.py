"""The training-data operators against brute force, exact round trips and held-out accuracy."""

from __future__ import annotations

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tessella.llm import chat, decontaminate, htmltext, langid, maxent, media, packing, sharding, simhash, suffixdedup
from tessella.llm.components import component_roots
from tessella.llm.queries import QUERIES

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def low(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def split(text):
    return (text or "").encode().split()


@pytest.fixture(scope="module")
def texts():
    rnd = random.Random(5)
    vocab = ["".join(rnd.choice("aeiouxyzrst") for _ in range(rnd.randint(1, 9))) for _ in range(60)] + ["é", "Ünd", "THE", "a\x0bb"]
    out = [" ".join(rnd.choice(vocab) for _ in range(rnd.randint(0, 90))) for _ in range(60)]
    passage = " ".join(vocab[:25])
    out += [out[3], out[3], out[4] + " " + passage, passage + out[5], "x" + passage, None, "", " \t\n", "ab " * 400, "ab " * 300, "z" * 49, "z" * 50, "z" * 51, out[7][:-3] + "qqq"]
    return out


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(i * 3 - 20, t, ["en", "de", None][i % 3], "src0" if i % 3 else f"s{i % 7}", len(t or "")) for i, t in enumerate(texts)] + [(None, "null id " * 9, None, None, None), (1, texts[1], "en", "src0", 1), (1, texts[1], "en", "src0", 1)]
    return spark.createDataFrame(rows, DOCS)


def clashing(df):
    """Extra columns whose names the operators use inside."""
    for name in ("id", "fp", "b", "blob", "h", "w", "starts", "size", "_id", "digest", "kind", "rank"):
        df = df.withColumn(name, F.lit("extra"))
    return df


def test_queries_name_all_thirteen():
    assert {int(n[2:].split("_")[0]) for n in QUERIES} == set(range(1, 14))


def test_media(spark, docs):
    items = media.parse_sequences(media.illustrated(clashing(docs)), "doc_id", "html")
    out = media.resolve(items, media.media_features(media.store_media(docs))).where("kind = 'media'").collect()
    want = Counter()
    for r in docs.collect():
        data = (r.text or "").encode()
        p = data + bytes(-len(data) % 64 if data else 64)
        want[(r.doc_id, len(data), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]), 1)] += 1
    assert Counter((r.doc_id, r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32, r.position) for r in out) == want
    assert media.decode_png(media.encode_png(bytes(range(256)))) == bytes(range(256))
    with pytest.raises(ValueError):
        media.decode_png(media.encode_png(bytes(64))[:-20] + bytes(20))


def test_media_sequence_order():
    items = media.sequence('<p>one<img src="sha256:aa" alt="A">two</p><figure><img src="bb" data-bytes="7"><figcaption>cap <b>x</b></figcaption></figure>tail<script>no</script>')
    assert [(i[0], i[1], i[2], i[3]) for i in items] == [("text", "one", None, None), ("media", None, "aa", "A"), ("text", "two", None, None), ("media", None, "bb", "cap x"), ("text", "tail", None, None)]
    assert media.sequence(None) == [] and items[3][4] == 7


def brute_repeats(rows, window=50):
    first = {}
    for d, t in rows:
        for i in range(len(t) - window + 1):
            w = t[i : i + window]
            first[w] = min(first.get(w, d), d)
    out = []
    for d, t in rows:
        gone = np.zeros(len(t), bool)
        for i in range(len(t) - window + 1):
            if first[t[i : i + window]] < d:
                gone[i : i + window] = True
        kept = np.frombuffer(t, np.uint8)[~gone].tobytes()
        out.append((d, len(t), int(gone.sum()), int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize(("rows_per_batch", "hot"), [("2000", 1000), ("3", 1000), ("3", 2), ("2000", 0)])
def test_suffix_dedup(spark, docs, rows_per_batch, hot, monkeypatch):
    """With `hot` low, strings are dealt by the longer ones around them, and give the same."""
    monkeypatch.setattr(suffixdedup.shared_anchors, "__defaults__", (suffixdedup.BUCKETS, hot))
    monkeypatch.setattr(suffixdedup, "_gathered", suffixdedup._gathered if hot else lambda batches, text_at, buckets: batches)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows_per_batch)
    rows = [(suffixdedup.FIRST_ID if r.doc_id is None else r.doc_id, (r.text or "").encode()) for r in docs.collect()]
    got = [(suffixdedup.FIRST_ID if r[0] is None else r[0], *r[1:]) for r in suffixdedup.dedup_digests(clashing(docs)).collect()]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
    assert Counter(got) == Counter(brute_repeats(rows))


def test_suffix_dedup_text(docs):
    out = suffixdedup.without_repeats(clashing(docs))
    assert out.columns == clashing(docs).columns and out.count() == docs.count()
    assert out.where("doc_id = 160").select("text").first()[0] == ""  # a later copy of text 3


def test_suffix_buckets_follow_the_input(spark):
    df = spark.range(3).select(F.repeat(F.lit("x"), 10).alias("text"))
    assert suffixdedup.buckets_for(df) == 1024 and suffixdedup.buckets_for(df.limit(0)) == 1024
    big = spark.range(3).select(F.repeat(F.lit("x"), 20_000_000).alias("text"))
    assert 1 << (60_000_000 * 1000 // suffixdedup.BUCKET_BYTES).bit_length() == 4096 and suffixdedup.buckets_for(big) == 1024


def test_loser_tree_merges_like_sort():
    rnd = random.Random(1)
    for n in (0, 1, 2, 5, 9):
        runs, every = [], []
        for i in range(n):
            keys = sorted(bytes(rnd.choice(b"ab") for _ in range(rnd.randint(0, 12))) for _ in range(rnd.randint(0, 30)))
            every += keys
            runs.append(suffixdedup.Run(*suffixdedup.front_code(keys), [i] * len(keys)))
        merged = list(suffixdedup.merge_runs(runs))
        assert [k for k, _, _ in merged] == sorted(every)
        for (a, _, _), (b, shared, _) in zip(merged, merged[1:]):
            assert shared == suffixdedup.common_prefix(a, b, 0)


def test_anchors_by_segments(monkeypatch):
    data = np.frombuffer(random.Random(2).randbytes(3000), np.uint8) % 5
    monkeypatch.setattr(suffixdedup, "SEGMENT", 400)
    h, x, first, last = suffixdedup.anchors(data)
    grams = suffixdedup.gram_hashes(data, 20)
    assert np.concatenate([np.arange(a, z + 1) for a, z in zip(first, last)]).tolist() == list(range(2951))
    for k, a, z in zip(x, first, last):
        for p in (a, z):
            assert k == p + int(np.argmin(grams[p : p + 31]))


def test_sharding(docs):
    out = sharding.interleaved_shards(clashing(docs).drop("size"), ranges=16).collect()
    counts = Counter(r.shard for r in out)
    assert len(out) == docs.count() and max(counts.values()) - min(counts.values()) <= 1 and set(counts) <= set(range(8))
    for s in counts:
        assert sorted(r.slot for r in out if r.shard == s) == list(range(counts[s]))
        hot = sum(r.source == "src0" for r in out if r.shard == s)
        assert abs(hot - counts[s] * sum(r.source == "src0" for r in out) / len(out)) <= 2
    want = Counter((r.doc_id, len((r.text or "").encode()) + 1, zlib.crc32((r.text or "").encode())) for r in docs.collect())
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in out) == want
    again = sharding.interleaved_shards(docs.repartition(5), ranges=16).collect()
    assert Counter((r.doc_id, r.shard) for r in again if r.doc_id not in (1,)) == Counter((r.doc_id, r.shard) for r in out if r.doc_id not in (1,))


def test_packing(docs):
    from tokenizers import Tokenizer

    path = packing.default_vocabulary()
    tok = Tokenizer.from_file(path)
    control = ["x <|endoftext|> y", "a<|startoftext|>b<|endoftext|>", "<|ENDOFTEXT|> <|end oftext|>", "<|endoftext|>" * 3 + "\n<|endoftext|>"]
    docs = docs.unionByName(docs.sparkSession.createDataFrame([(9000 + i, t, None, None, None) for i, t in enumerate(control)] + [(9100, "long words, " * 60_000, None, None, None)], DOCS))
    out = packing.pack(clashing(docs), path).collect()
    got = Counter()
    by = {}
    for r in out:
        assert r.length & (r.length - 1) == 0 and r.length <= 2048 and len(r.ids) == r.length and r.offset == 0
        assert zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32
        by.setdefault(r.doc_id, []).append(r)
    for r in docs.where("doc_id != 1").collect():
        ids = tok.encode(r.text or "", add_special_tokens=False).ids + [1]
        pieces = sorted(by[r.doc_id], key=lambda p: p.start)
        assert sum((p.ids for p in pieces), []) == ids and pieces[0].doc_tokens == len(ids)
        got[r.doc_id] += 1
    assert len({r.sequence_id for r in out}) == len(out)
    by_batch = {}
    for r in out:
        by_batch.setdefault(r.batch_id, []).append(r)
    for rows in by_batch.values():  # one length, no gaps, no more tokens than a batch holds
        assert len({r.length for r in rows}) == 1 and sorted(r.batch_slot for r in rows) == list(range(len(rows)))
        assert len(rows) * rows[0].length <= packing.BATCH_TOKENS
    assert 1 < len(by_batch) < len(out) / 4
    assert packing.binary_pieces(4097 + 6) == [2048, 2048, 4, 2, 1]


def brute_fingerprint(text, k=3):
    w = [x.decode() for x in split(low(text))]
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + k]).encode(), 42) for i in range(max(1, len(w) - k + 1))] if w else []
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_shingles(text, k=5):
    w = [x.decode() for x in split(low(text))]
    return {" ".join(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def brute_components(ids, fps, sets=None):
    parent = list(range(len(ids)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(ids)):
        for j in range(i):
            alike = sets and 10 * len(sets[i] & sets[j]) >= 8 * len(sets[i] | sets[j])
            if (fps[i] ^ fps[j]).bit_count() <= 3 or alike:
                parent[max(find(i), find(j))] = min(find(i), find(j))
    least = {}
    for i, d in enumerate(ids):
        least[find(i)] = min(least.get(find(i), d), d)
    return [least[find(i)] for i in range(len(ids))]


@pytest.mark.parametrize("limit", [4096, 1])
def test_simhash(docs, limit):
    rows = [(simhash.FIRST_ID if r.doc_id is None else r.doc_id, brute_fingerprint(r.text)) for r in docs.collect()]
    got = simhash.near_duplicate_components(clashing(docs.limit(12) if limit == 1 else docs), cell_limit=limit).collect()
    if limit == 1:
        rows = [(simhash.FIRST_ID if r.doc_id is None else r.doc_id, brute_fingerprint(r.text)) for r in docs.limit(12).collect()]
    want = brute_components([d for d, _ in rows], [f for _, f in rows])
    assert Counter((r.id, r.fp & (1 << 64) - 1, r.component) for r in got) == Counter((d, f, c) for (d, f), c in zip(rows, want))


def test_forest_and_grid_lose_no_link():
    rnd = random.Random(3)
    base = rnd.getrandbits(64)
    fps = list({base ^ sum(1 << b for b in rnd.sample(range(64), rnd.randint(0, 4))) for _ in range(80)})
    for some in (fps, fps[:20]):
        edges = simhash.forest(some)
        assert len(edges) < len(some) and all((a ^ b).bit_count() <= 3 for a, b in edges)
        want = brute_components(list(range(len(some))), some)
        label = {f: i for i, f in enumerate(some)}
        for _ in some:
            for a, b in edges:
                label[a] = label[b] = min(label[a], label[b])
        assert [label[f] for f in some] == want
    masks = simhash.block_masks()
    for _ in range(200):
        x = rnd.getrandbits(64)
        y = x ^ sum(1 << b for b in rnd.sample(range(64), 3))
        p, q = simhash._points(x), simhash._points(y)
        assert (p ^ q).bit_count() <= (x ^ y).bit_count() and any(p & m == q & m for m in masks)


def test_similar_texts_are_linked(spark):
    """Near copies of all sizes, some just at the similarity, beside texts that share a long passage; with nulls, empty texts and repeated rows."""
    rnd = random.Random(11)
    vocab = ["".join(rnd.choice("abcdefgh") for _ in range(5)) for _ in range(3000)]
    shared, texts = [rnd.choice(vocab) for _ in range(60)], [None, "", "one", "one", "two words"]
    for n in (4, 5, 8, 9, 14, 30, 60, 61, 120, 300, 700, 2000) * 3:
        words = [rnd.choice(vocab) for _ in range(n)]
        texts.append(" ".join(words))
        for edits in {1, max(1, n // 60), max(1, n // 45)}:
            copy = list(words)
            for at in rnd.sample(range(n), edits):
                copy[at] = rnd.choice(vocab)
            texts.append(" ".join(copy))
        texts += [" ".join(words[: -(n // 6) or None]), " ".join(shared + words[:40]), "Extra " + " ".join(words).upper()]
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, texts[9]), (7, texts[7])]
    got = simhash.near_duplicate_components(clashing(spark.createDataFrame(rows, "doc_id long, text string")), shingle=5, similarity=0.8).collect()
    ids = [simhash.FIRST_ID if i is None else i for i, _ in rows]
    want = brute_components(ids, [brute_fingerprint(t, 5) for _, t in rows], [brute_shingles(t) for _, t in rows])
    alone = brute_components(ids, [brute_fingerprint(t, 5) for _, t in rows])
    assert Counter((r.id, r.component) for r in got) == Counter(zip(ids, want)) and len(set(want)) < len(set(alone)) - 20
    assert simhash.near_duplicate_components(spark.createDataFrame([], "doc_id long, text string"), similarity=0.8).count() == 0


def crowd_texts(rnd, size, planted):
    """Texts that share a passage of 300 words beside 45 of their own (0.77 to each other), and near copies of some of them."""
    vocab = ["".join(rnd.choice("abcdefgh") for _ in range(6)) for _ in range(20000)]
    shared = [rnd.choice(vocab) for _ in range(300)]
    texts = [shared + rnd.sample(vocab, 45) for _ in range(size)]
    for words in texts[:planted]:
        copy = list(words)
        for at in rnd.sample(range(10, 330), rnd.randint(3, 6)):
            copy[at] = "changed" + str(at)
        texts.append(copy)
    return [" ".join(t) for t in texts]


def pairs_and_roots(spark, texts, similarity=0.8):
    """Brute-force components of texts by their sets, and those of the operator, both as groups of indexes."""
    sets = [brute_shingles(t) for t in texts]
    want = brute_components(list(range(len(texts))), [xxhash.xxh64_intdigest(str(i).encode()) for i in range(len(texts))], sets)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = simhash.set_rows(df, "doc_id", "text", 5)
    label = {r.node: r.root for r in simhash.similar_roots(df, rows, "text", 5, similarity).collect()}
    got, least = [], {}
    for i, h in sorted((r.id, r.set_hash) for r in rows.collect()):
        got.append(least.setdefault(label.get(h, h), i))
    return want, got


def test_similar_sets_in_crowded_cells(spark):
    want, got = pairs_and_roots(spark, crowd_texts(random.Random(4), 120, 40))
    assert got == want and 5 < 160 - len(set(want)) < 80


def test_repeated_lines_do_not_hide_similar_sets(spark):
    rnd = random.Random(6)
    texts = []
    for n in (100, 200, 300, 400, 600, 900) * 4:
        words = ["".join(rnd.choice("abcdefgh") for _ in range(6)) for _ in range(n)]
        texts += [" ".join(words), " ".join(words[:32] + words[20:32] * rnd.randint(20, 100) + words[32:])]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.id: r.component for r in simhash.near_duplicate_components(df, shingle=5, similarity=0.8).collect()}
    assert all(got[i] == i - i % 2 for i in got)
    assert max((brute_fingerprint(texts[i], 5) ^ brute_fingerprint(texts[i + 1], 5)).bit_count() for i in range(0, len(texts), 2)) > 24


def test_sketches_never_hide_a_similar_pair():
    rnd = np.random.default_rng(8)
    ruled_out = 0
    for n in (0, 1, 5, 8, 60, 500, 3000) * 6:
        a = np.unique(rnd.integers(0, 1 << 64, n, dtype=np.uint64))
        b = np.unique(np.concatenate([a[: len(a) - rnd.integers(0, len(a) + 1)], rnd.integers(0, 1 << 64, rnd.integers(0, n + 1), dtype=np.uint64)]))
        common = len(np.intersect1d(a, b))
        assert simhash.most_common(simhash.sketch(a), simhash.sketch(b)) >= common
        ruled_out += simhash.most_common(simhash.sketch(a), simhash.sketch(b)) < 0.8 / 1.8 * (len(a) + len(b))
    some = [simhash.sketch(np.unique(rnd.integers(0, 1 << 64, n, dtype=np.uint64))) for n in (20, 22, 20, 90, 60, 0)] + [b""]
    bounds = simhash.Sketches(some)
    assert all(bounds.most_common(i, np.arange(7)).tolist() == [simhash.most_common(some[i], x) for x in some] for i in range(7))
    assert ruled_out > 5 and simhash.sketch(np.arange(300, dtype=np.uint64)) == b"" and simhash.most_common(b"", b"\x01") == float("inf")


def test_prefixes_of_similar_sets_meet_in_any_order():
    rnd = np.random.default_rng(3)
    for n in range(1, 60):
        a = np.unique(rnd.integers(0, 1 << 63, n, dtype=np.uint64))
        for gone in range(n // 5 + 1):
            b = np.delete(a, rnd.choice(len(a), gone, replace=False))
            common = np.sort(rnd.choice(a, n // 2, replace=False))
            rank = rnd.permutation(len(common)) + 1
            if len(b) >= 0.8 * len(a):
                assert np.intersect1d(simhash.ordered_prefix(a, common, rank, None, 0.8), simhash.ordered_prefix(b, common, rank, None, 0.8)).size


def test_components_of_chains(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 60), (60, 80), (7, 7)]
    out = {r.node: r.root for r in component_roots(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert out == {i: 0 for i in range(1, 41)} | {100: 60, 80: 60}
    assert component_roots(spark.createDataFrame([], "u long, v long")).count() == 0


@pytest.mark.parametrize("block_words", [decontaminate.BLOCK_WORDS, 30])
def test_decontamination(spark, docs, texts, block_words):
    items = [(1, " ".join(texts[0].split()[:14])), (2, "the"), (10, "AB, ab!"), (3, ""), (4, None), (5, texts[8]), (6, "é Ünd"), (7, " ".join(texts[0].split()[2:14]))]
    bench = spark.createDataFrame(items, "item_id long, text string")

    def words(t):
        return "".join(c if c.isdigit() and c.isascii() or "a" <= c <= "z" or ord(c) >= 128 else " " for c in low(t)).split(" ") if t else []

    pats = []
    for i, t in items:
        w = [x for x in words(t) if x]
        m = min(10, len(w))
        pats += [(str(i), w[k : k + m]) for k in range(len(w) - m + 1 if m else 0)]
    want = Counter()
    for r in docs.collect():
        w = [x for x in words(r.text) if x]
        hit, found = set(), set()
        for i, p in pats:
            for k in range(len(w) - len(p) + 1):
                if w[k : k + len(p)] == p:
                    hit.update(range(k, k + len(p)))
                    found.add(i)
        want[(r.doc_id, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit))] += 1
    got = decontaminate.find_contamination(clashing(docs), bench, ["doc_id"], block_words=block_words)
    assert Counter(tuple(r) for r in got.collect()) == want
    none = decontaminate.find_contamination(docs, bench.limit(0), ["doc_id"])
    assert none.where("contaminated").count() == 0 and none.count() == docs.count()


def test_decontamination_cuts_long_items(spark):
    rnd = random.Random(2)
    words = [rnd.choice("abcdefgh") + str(rnd.randint(0, 40)) for _ in range(400)]
    bench = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(words[30:60]))], "item_id long, text string")
    got = [tuple(r) for r in decontaminate.parts_of_items(bench, "item_id", "text", 10, part=25).collect()]
    windows = Counter((i, " ".join(w[k : k + 10])) for i, t, n in got for w in [t.split()] for k in range(len(w) - 9))
    want = Counter((str(i), " ".join(w[k : k + 10])) for i, w in ((1, words), (2, words[30:60])) for k in range(len(w) - 9))
    assert windows == want and all(len(t.split()) == n <= 34 for _, t, n in got) and len(got) > 15


def test_decontamination_tables_are_small():
    import os
    import subprocess
    import sys

    code = """
import resource, random, pickle
from tessella.llm import decontaminate as D
rnd = random.Random(1)
words = [f"w{rnd.randint(0, 400_000)}x".encode() for _ in range(D.BLOCK_WORDS)]
base = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
s = D.WindowSearch([(str(i), b" ".join(words[i : i + 10_000])) for i in range(0, len(words), 10_000)])
sent = pickle.dumps(s)
s.mark(words[:2000], bytearray(2000), found := set())
assert found == {"0"}
print(len(sent) / 1e6)
"""
    run = lambda code: subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True, cwd=os.path.dirname(os.path.dirname(os.path.dirname(__file__))))
    assert float(run(code).stdout) < 150
    task = code.split("base =")[0] + """
s = pickle.loads(pickle.dumps(D.WindowSearch([(str(i), b" ".join(words[i : i + 10_000])) for i in range(0, len(words), 10_000)])))
del words
import gc, os
gc.collect()
rss = lambda: int(open("/proc/self/statm").read().split()[1]) * os.sysconf("SC_PAGE_SIZE") / 1e6
before = rss()
s.mark([b"a"] * 20, bytearray(20), set())
print(rss() - before)
"""
    assert float(run(task).stdout) < 500


def tiny_model(docs):
    counts, vocabulary = maxent.learn_vocabulary(docs, head=20)
    weights = vocabulary.value.start()
    weights[: maxent.BIAS] += np.random.default_rng(0).normal(size=(maxent.BIAS, maxent.WIDTH)).astype(np.float32) * 0.5
    return counts, vocabulary, weights


def brute_outcomes(v, w, before):
    """log10 of each head word's probability and of each tail class's, after `before` (the token before and the one before that)."""
    m = (1 << 64) - 1
    one, two = (zlib.crc32(x) if x is not None else 0x9E3779B9 for x in before)
    feats = [one + 1, one * 0xC2B2AE3D27D4EB4F + two + 7, two + 3]

    def factor(level, node):
        rows = [((f + (node * 0x165667B19E3779F9 if level else 0)) * 0x9E3779B97F4A7C15 & m) >> 50 for f in feats]
        z = w[maxent.BIAS + node].astype(float) + sum(w[(level * 3 + k) * maxent.FEATURE_ROWS + r] for k, r in enumerate(rows))
        return (z - np.log(np.exp(z).sum())) / np.log(10)

    root = factor(0, 0)
    head = {x: root[leaf // 256] + factor(1, 1 + leaf // 256)[leaf // 16 % 16] + factor(2, 13 + leaf // 16)[leaf % 16] + v.inner[i] for x, i in v.index.items() for leaf in [int(v.leaf[i])]}
    return head, root[maxent.HEAD_CLASSES :]


def test_lm_scores(spark, docs):
    import math

    train = docs.where("doc_id % 2 = 0")
    for counts, vocabulary, weights in (maxent.fit(train, head=20), tiny_model(train)):
        v = vocabulary.value
        got = maxent.score(clashing(docs), (counts, vocabulary, weights), ["doc_id"]).collect()
        c = Counter()
        for r in train.collect():
            c.update([*split(low(r.text)), b"\n"])
        n, want = sum(c.values()), Counter()
        for r in docs.where("doc_id < 40").collect():
            t = [*split(low(r.text)), b"\n"]
            score = 0.0
            for i, x in enumerate(t):
                head, tail = brute_outcomes(v, weights, (t[i - 1] if i else None, t[i - 2] if i > 1 else None))
                if x in head:
                    score += head[x]
                else:
                    k, mine = maxent.tail_class(x), [(y, m) for y, m in c.items() if y not in head and maxent.tail_class(y) == maxent.tail_class(x)]
                    once = 1 + sum(m == 1 for _, m in mine)
                    score += tail[k] + math.log10(c.get(x, once) / (once + sum(m for _, m in mine)))
            want[(r.doc_id, len(t), sum(x in c for x in t), n, round(sum(math.log10((c[x] + 1) / (n + len(c) + 1)) for x in t), 5), round(score, 2))] += 1
        assert Counter((r.doc_id, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 5), round(r.score, 2)) for r in got if r.doc_id is not None and r.doc_id < 40) == want
        assert 0 < len(v.index) <= 20
    empty = maxent.fit(docs.limit(0))
    assert maxent.score(docs, empty, ["doc_id"]).count() == docs.count()


def test_lm_probabilities_sum_to_one(docs):
    _, vocabulary, weights = tiny_model(docs)
    for before in ((None, None), (b"the", None), (b"zzz", b"\n")):
        head, tail = brute_outcomes(vocabulary.value, weights, before)
        assert abs(sum(10**x for x in head.values()) + sum(10**tail) - 1) < 1e-6


def test_lm_is_better_than_counts_on_held_out_text(spark):
    """The model against its own start, which is the counts of words without any feature."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    counts, vocabulary = maxent.learn_vocabulary(docs.where("doc_id % 7 != 2"))
    rows = maxent.encode(docs.withColumn("held_out", F.expr("doc_id % 7 = 2")), vocabulary, ["doc_id", "held_out"])
    held = rows.where("kept.held_out")
    total = lambda w: maxent.score_encoded(held, counts, vocabulary, w).agg(F.sum("score"), F.sum("n_tokens")).first()
    (start, n), (trained, _) = total(vocabulary.value.start()), total(maxent.train(rows.where("NOT kept.held_out"), vocabulary))
    assert trained / n > start / n + 0.1


def test_language_id(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    out = QUERIES["op8_language_id"](spark, "/root/testdata/sf0.01").join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert sum(r.lang_pred == r.lang for r in out) / len(out) > 0.97 and all(0 <= r.score <= 1 for r in out)


def test_language_id_is_the_smallest_size_and_rejects_narrow_margins(spark):
    import zstandard

    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    d = langid.fit_dictionaries(langid.training_rows(docs))
    got = {r.doc_id: r for r in langid.identify(docs, d, ["doc_id", "lang"]).collect()}
    made = {x: zstandard.ZstdCompressionDict(c, dict_type=zstandard.DICT_TYPE_RAWCONTENT) for x, (c, _) in d.items()}
    wrong = {True: [], False: []}
    for r in docs.collect():
        g = got[r.doc_id]
        if g.lang_pred == "und":
            continue
        data = langid.letters(r.text)
        sizes = {x: sum(len(zstandard.ZstdCompressor(level=langid.LEVEL, dict_data=m, write_content_size=False).compress(data[i : i + langid.BLOCK_BYTES])) - 0 for i in range(0, len(data), langid.BLOCK_BYTES)) for x, m in made.items()}
        least, second = sorted(sizes.values())[:2]
        assert sizes[g.lang_pred] - least <= 0.02 * least + 4
        if second - least > 0.05 * least + 8:
            assert sizes[g.lang_pred] == least and not g.rejected
        wrong[g.rejected].append(g.lang_pred != g.lang)
    assert wrong[True] and len(wrong[True]) < 0.03 * len(got) and np.mean(wrong[True]) >= np.mean(wrong[False])


def test_language_id_edges(spark, docs):
    d = {"en": (b"the of and with that this from have", 0.6), "de": (b"der die und nicht ein auf dem ist", 0.4)}
    out = {r.doc_id: r for r in langid.identify(clashing(docs).withColumn("kept", F.lit(1)).withColumn("score", F.lit(2)), d, ["doc_id"]).collect()}
    odd = [r.doc_id for r in docs.collect() if not any(c.isalpha() for c in r.text or "")]
    assert all(out[i].lang_pred == "und" and out[i].rejected for i in odd)
    assert langid.identify(docs, langid.fit_dictionaries(docs.limit(0)), ["doc_id"]).where("lang_pred != 'und'").count() == 0
    c = langid.CompressionClassifier({"aa": (b"x", 0.2), "bb": (b"x", 0.8)})
    assert c.predict("same sizes", 0.02) == ("bb", 0.5, True) and c.predict("Longer text. " * 30_000, 0.02)[0] == "bb"
    assert langid.CompressionClassifier({"aa": (b"x", 1.0)}).predict("text", 0.02) == ("aa", 1.0, False)


def test_chat(spark):
    rows = [(1, 0, "user", "a</turn>\n### b: \\# \\\\< \\"), (1, 1, "assistant", None), (1, 2, None, "x"), (2, 0, "as: s\\", "### user: </turn>"), (2, 0, "assistant", "é\n"), (2, None, "assistant", "first"), (None, 1, "assistant", "n")] + [(3, i, "assistant", "\\" * (i % 5) + "#" * (i % 4) + "</turn>") for i in range(50)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r.conv_id: r for r in chat.conversation_digests(clashing(df)).collect()}
    for conv in (1, 2, 3, None):
        mine = sorted((r for r in rows if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, r[2] is not None, r[2] or "", r[3] or ""))
        loss = "".join(t or "" for _, _, r, t in mine if r == "assistant")
        r = got[conv]
        assert (r.n_turns, r.loss_chars) == (len(mine), len(loss)) and r.loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
        assert r.turns_sha256 == hashlib.sha256("".join(f"{x or ''}\n{t or ''}\n" for _, _, x, t in mine).encode()).hexdigest()
        whole = "".join(chat.format_turn(x, t)[0] for _, _, x, t in mine)
        assert [p[:2] for p in chat.parse(whole)] == [(x or "", t or "") for _, _, x, t in mine] and len(whole) == r.formatted_chars
    assert chat.parse("### user hello</turn>\n") is None and chat.parse("### user: x</turn>") is None
    assert chat.conversation_digests(df.limit(0)).count() == 0 and chat.format_turns(df).count() == len(rows)


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="</p>";</script></head><body><header><h1>Site</h1></header>
<nav><ul><li><a href="/a">Menu</a></ul></nav><div class="cookie-notice">We use cookies</div><main><article class="post"><h1>Head &amp; line</h1><p>First   para <b>bold<br>
more</b> text that is long enough to count as content of the page, surely it is.<p>Ok.</p><blockquote>Quoted words that are long too, long enough for content.</blockquote><form><p>Sign up</p></form>
<div class="ad">Buy now</div><ul><li>item one<li>item two</ul><p>Last paragraph that goes on for a while so that it is content again.</p></article>
<section id="comments"><p>Reader comment that is long enough to look like content, but it is a comment all the same.</p></section></main>
<aside class="sidebar"><p>Related</p></aside><footer>&copy; x</footer></body></html>"""


def test_html_text():
    assert htmltext.main_lines(PAGE) == [
        "Head & line", "First para bold more text that is long enough to count as content of the page, surely it is.", "Ok.", "Quoted words that are long too, long enough for content.", "item one", "item two", "Last paragraph that goes on for a while so that it is content again."
    ]
    assert htmltext.main_text(None) == "" and htmltext.main_text("<p>") == "" and htmltext.main_text("plain &lt; text") == "plain < text"
    assert htmltext.main_text("<article><p>a<p>b</article><footer>f") == "a\nb"


def test_html_of_given_pages(spark):
    import re

    for r in QUERIES["op10_html_extraction"](spark, "/root/testdata/sf0.001").join(spark.read.parquet("/root/testdata/sf0.001/pages.parquet").select("page_id", "html"), "page_id").collect():
        import html as H

        body = re.search(r"<article>(.*?)</article>", r.html, re.S)[1]
        want = [" ".join(H.unescape(re.sub(r"<[^>]+>", "", x)).split()) for x in re.split(r"</?p>|</?h1>", body)]
        assert r.text == "\n".join(x for x in want if x) and r.n_chars == len(r.text)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_queries_on_empty_tables(spark, tmp_path, name):
    for t in ("documents", "pages", "benchmark", "conversations", "embeddings"):
        spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet").limit(0).write.parquet(f"{tmp_path}/{t}.parquet")
    assert QUERIES[name](spark, str(tmp_path)).count() == (name == "op9_chat_formatting")


def test_pipeline(spark):
    import corpus_pipeline as P
    from tessella.llm.common import read, table

    sf = "/root/testdata/sf0.001"
    docs = read(spark, sf, "documents")
    for name, stage in P.STAGES:
        out = table(stage(spark, docs, sf), name)
        before = {r.doc_id: r for r in docs.collect()}
        if name != "packing":
            assert out.columns == docs.columns
            after = {r.doc_id: r for r in out.collect()}
        if name == "language_id":
            assert all(before[i] == after[i] for i in after) and len(after) >= 0.97 * len(before)
        elif name == "near_dedup":
            ids = sorted(before)
            want = brute_components(ids, [brute_fingerprint(before[i].text, 5) for i in ids], [brute_shingles(before[i].text) for i in ids])
            assert set(after) == set(want) and all(before[i] == after[i] for i in after)
        elif name == "suffix_dedup":
            want = {r[0]: r for r in brute_repeats([(i, (before[i].text or "").encode()) for i in sorted(before)])}
            assert set(after) == set(before) and all((after[i].text == before[i].text) == (want[i][2] == 0) and after[i].n_chars == len(after[i].text) for i in after)
        elif name == "decontamination":
            bad = {r.doc_id for r in decontaminate.find_contamination(docs, read(spark, sf, "benchmark"), ["doc_id"]).where("contaminated").collect()}
            assert set(after) == set(before) - bad
        else:
            assert {r.doc_id for r in out.select("doc_id").collect()} == set(before)
        docs = out


def test_near_dedup_keeps_texts_that_only_share_a_passage(spark):
    import corpus_pipeline as P

    rnd = random.Random(4)
    texts = crowd_texts(rnd, 300, 5) + [None, "", "one"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    bits = [brute_fingerprint(t, 5) for t in texts[:300]]
    assert any((a ^ b).bit_count() <= 3 for i, a in enumerate(bits) for b in bits[:i])
    want = brute_components(list(range(305)), [xxhash.xxh64_intdigest(str(i).encode()) for i in range(305)], [brute_shingles(t) for t in texts[:305]])
    assert {r.doc_id for r in P.near_dedup(spark, df, "").collect()} == {*want, 305, 307}


def test_near_dedup_of_null_and_repeated_ids(spark):
    import corpus_pipeline as P

    texts = [" ".join(f"{w}{i}" for i in range(40)) for w in "abcdef"]
    rows = [(None, texts[0]), (None, texts[1]), (None, texts[1]), (3, texts[2]), (3, texts[3]), (3, texts[3] + " more"), (4, texts[4]), (5, texts[4] + " end"), (6, texts[0] + " end"), (7, None), (8, "")]
    got = P.near_dedup(spark, spark.createDataFrame(rows, "doc_id long, text string"), "").collect()
    kept = [(r.doc_id, (r.text or "").split(" more")[0]) for r in got]
    assert Counter(kept) == Counter([(None, texts[0]), (None, texts[1]), (3, texts[2]), (3, texts[3]), (4, texts[4]), (7, "")])


@pytest.mark.parametrize("block_words", [decontaminate.BLOCK_WORDS, 3])
def test_decontamination_by_items_without_id(spark, block_words):
    bench = spark.createDataFrame([(None, "one two three"), (None, "four five"), (1, "six")], "item_id long, text string")
    docs = spark.createDataFrame([(1, "a one two three b"), (2, "six four five"), (3, "one two")], "doc_id long, text string")
    got = {r.doc_id: (r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in decontaminate.find_contamination(docs, bench, ["doc_id"], block_words=block_words).collect()}
    none, six = (hashlib.sha256(x).hexdigest() for x in (b"", b"1"))
    assert got == {1: (3, 0, none, True), 2: (3, 1, six, True), 3: (0, 0, none, False)}


def test_language_id_learns_from_distinct_texts(spark):
    rows = [("en", "".join(chr(97 + int(c)) for c in f"{i:04d}")) for i in range(600)] + [("en", "copied")] * 3000 + [(x, f"only {x}") for x in ("da", "de", "fi", "fr", "sv") for _ in range(3000)] + [("no", "")]
    got = langid.fit_dictionaries(spark.createDataFrame(rows, "lang string, text string"))
    assert set(got) == {"da", "de", "en", "fi", "fr", "sv"} and got["sv"] == (b"only sv", 3000 / len(rows))
    words = got["en"][0].split()
    assert len(words) == len(set(words)) == 300 and got["en"][1] == 3600 / len(rows)


LONG = "Words of a paragraph that is long enough to be taken for content, since it has many characters and hardly a tag in it, number {}."
LINKS = "<ul>" + "".join(f'<li><a href="/{i}">Go <b>{i}</b></a></li>' for i in range(12)) + "</ul>"


@pytest.mark.parametrize("around", ["<div>{}</div>", "<section>{}</section>", "<table><tr><td>{}</td></tr></table>", "{}"])
def test_html_without_article_or_main(around):
    paragraphs = [LONG.format(i) for i in range(4)]
    body = "<h2>Heading</h2>" + "<p>".join(["", *paragraphs[:2]]) + "<p>Ok.</p>" + "<p>".join(["", *paragraphs[2:]])
    page = "<html><body><div>" + LINKS + "</div>" + around.format(body) + "<div>" + LINKS + "</div></body></html>"
    got = htmltext.main_lines(page)
    want = ["Heading", *paragraphs[:2], "Ok.", *paragraphs[2:]]
    assert got == want


def test_html_of_several_articles():
    page = "<body><div>" + LINKS + "</div><div>" + "".join(f"<article><h2>Part {i}</h2><p>{LONG.format(i)}</p></article>" for i in range(4)) + "</div><div>" + LINKS + "</div></body>"
    assert htmltext.main_lines(page) == [x for i in range(4) for x in (f"Part {i}", LONG.format(i))]


def test_html_headings_and_paragraphs_stay_whatever_their_names():
    page = f"""<body><div class="menu">{LINKS}</div><article><div class="post-header"><h1 id="login">Title</h1></div><h2 id="search">Search</h2><p id="related-work">{LONG.format(1)}</p>
    <p>See <b class="login">login</b> for more.</p><p class="notice">{LONG.format(2)}</p><div class="advert">Buy</div><section id="comments"><p>{LONG.format(3)}</p></section></article></body>"""
    assert htmltext.main_lines(page) == ["Title", "Search", LONG.format(1), "See login for more.", LONG.format(2)]


def test_html_ratios_decide(monkeypatch):
    page = "<html><body><div>" + LINKS + "</div><div>" + "".join(f"<p>{LONG.format(i)}</p>" for i in range(4)) + "</div><div>" + LINKS + "</div></body></html>"
    assert htmltext.main_lines(page) == [LONG.format(i) for i in range(4)]
    two = f"<body><main>{LINKS}<p>Go on</p></main><div><article><h1>T</h1>" + "".join(f"<p>{LONG.format(i)}</p>" for i in range(3)) + "</article></div></body>"
    assert htmltext.main_lines(two) == ["T", *(LONG.format(i) for i in range(3))]
    monkeypatch.setattr(htmltext, "smoothed", lambda values, sigma=1.0: [1.0] * len(values))
    assert htmltext.main_lines(page) != [LONG.format(i) for i in range(4)]  # link lists come along where all ratios are alike


def test_html_of_a_very_long_page():
    page = "<body><nav>x</nav><article>" + f"<p>{LONG.format(0)}</p>" * 30_000 + "</article></body>"
    assert len(htmltext.main_lines(page)) == 30_000


CLASHING = "_body _id _first _text_hash _hash _rows _starts _ends lang_pred rejected score contaminated n_words n_hit kept id row text_hash rows starts ends set_hash root node component hits items first".split()


def test_pipeline_carries_columns_of_any_name(spark, tmp_path):
    """Nulls, repeated ids and rows, and extra columns with names that stages use inside: values stay with their rows."""
    import corpus_pipeline as P

    base = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(60)
    odd = spark.createDataFrame([(None, "The words of this text are not in any other text here.", "en", "a", 5), (None, None, None, None, None), (7, "Another text with the id of seven and some words of its own.", "en", "b", 5), (7, "", None, "b", 0)], base.schema)
    docs = base.unionByName(odd).select("*", *(F.concat(F.lit(n + ":"), F.coalesce(F.col("doc_id").cast("string"), F.lit("none")), F.lit("/"), F.coalesce("source", F.lit("none"))).alias(n) for n in CLASHING), F.lit(1).alias("odd name"))
    spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").write.parquet(f"{tmp_path}/benchmark.parquet")
    for name, stage in P.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns, name
        rows = out.collect()
        assert rows and all(r[n] == f"{n}:{'none' if r.doc_id is None else r.doc_id}/{r.source or 'none'}" for r in rows for n in CLASHING), name
        assert {r.doc_id for r in rows} <= {r.doc_id for r in docs.select("doc_id").collect()}
    assert P.packing(spark, docs, "").select("doc_id").distinct().count() == docs.select("doc_id").distinct().count()


def test_pipeline_on_empty_tables(spark, tmp_path):
    import corpus_pipeline as P

    for t in ("documents", "benchmark"):
        spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet").limit(0).write.parquet(f"{tmp_path}/{t}.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for _, stage in P.STAGES:
        assert stage(spark, docs, str(tmp_path)).count() == 0
    assert P.run(spark, str(tmp_path)).count() == 0
    full = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    assert P.decontamination(spark, full, str(tmp_path)).count() == full.count()  # no items, nothing goes


def test_shared_folder_must_be_named_on_a_cluster():
    from types import SimpleNamespace as N

    from tessella.llm.common import shared_dir

    cluster = N(conf=N(get=lambda *_: None), sparkContext=N(getCheckpointDir=lambda: None, master="spark://host:7077"))
    with pytest.raises(RuntimeError):
        shared_dir(cluster)


@pytest.mark.parametrize("name", ["op2_suffix_dedup", "op3_sharding", "op6_benchmark_decontamination", "op9_chat_formatting", "op12_substring_dedup", "op13_phrase_collocations"])
def test_queries_equal_their_sql(spark, name):
    import duckdb

    from tessella.llm.queries import ORACLES

    con = duckdb.connect()
    for t in ("documents", "benchmark", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '/root/testdata/sf0.001/{t}.parquet'")
    out = QUERIES[name](spark, "/root/testdata/sf0.001")
    cur = con.execute(ORACLES[name])
    names = [x[0] for x in cur.description]
    assert sorted(names) == sorted(out.columns)
    assert Counter(map(tuple, out.select(*names).collect())) == Counter(cur.fetchall())


def test_media_features_by_another_way(spark, docs):
    import statistics

    media_table = media.store_media(docs)
    stored = {r.digest: bytes(r.media) for r in media_table.collect()}
    for r in media.media_features(media_table).collect():
        png, at, data = stored[r.digest], 8, b""
        while at < len(png):  # chunk by chunk
            n, kind = int.from_bytes(png[at : at + 4], "big"), png[at + 4 : at + 8]
            data += png[at + 8 : at + 8 + n] if kind == b"IDAT" else b""
            at += 12 + n
        raw = zlib.decompress(data)
        rows = [raw[i + 1 : i + 65] for i in range(0, len(raw), 65)]
        pixels = b"".join(rows)
        assert hashlib.sha256(pixels).hexdigest() == r.digest == r.payload_sha256 and hashlib.sha256(png).hexdigest() == r.media_sha256 and len(png) == r.media_bytes
        levels = ".".join(str(sum(p >> 4 == k for p in pixels)) for k in range(16))
        columns = "".join("1" if sum(row[c] for row in rows) * 64 > sum(pixels) else "0" for c in range(64))
        size, mean, sd, got_levels, got_columns = (x.split("=")[-1] for x in r.feature.split(";"))
        assert (size, got_levels, int(got_columns, 16)) == (f"64x{len(rows)}", levels, int(columns, 2))
        assert abs(float(mean) - statistics.fmean(pixels)) < 1e-3 and abs(float(sd) - statistics.pstdev(pixels)) < 1e-2


def test_sequences_of_real_pages_with_pictures(spark):
    """Two figures set into each given page: items stay in the page's order, payloads come from the join, captions stay with their own picture."""
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet").select("page_id", "html")
    payload = lambda n: F.concat(F.lit(f"picture {n} of "), F.col("page_id").cast("string"))
    figure = lambda n: F.concat(F.lit('<figure><img src="sha256:'), media.payload_digest("p"), F.lit(f'"><figcaption>Caption {n}</figcaption></figure>'))
    html = pages.withColumn("p", payload(1)).withColumn("one", figure(1)).withColumn("p", payload(2)).withColumn("two", figure(2))
    html = html.withColumn("html", F.replace(F.regexp_replace("html", "</h1>", "</h1>@@1"), F.lit("</article>"), F.lit("@@2</article>")))
    html = html.withColumn("html", F.replace(F.replace("html", F.lit("@@1"), F.col("one")), F.lit("@@2"), F.col("two"))).select("page_id", "html")
    store = media.store_media(pages.select(payload(1).alias("text")).unionByName(pages.select(payload(2).alias("text"))))
    items = media.resolve(media.parse_sequences(html, "page_id", "html"), store).orderBy("page_id", "position").collect()
    by_page = {}
    for r in items:
        by_page.setdefault(r.page_id, []).append(r)
    assert len(by_page) == pages.count()
    for page, rows in by_page.items():
        assert [r.position for r in rows] == list(range(len(rows)))
        shown = [r for r in rows if r.kind == "media"]
        assert [(r.caption, media.decode_png(bytes(r.media)).rstrip(b"\0")) for r in shown] == [(f"Caption {n}", f"picture {n} of {page}".encode()) for n in (1, 2)]
        first, second = (rows.index(r) for r in shown)
        assert all(r.text and r.media is None for r in rows if r.kind == "text") and any(r.kind == "text" for r in rows[first + 1 : second])


def test_near_dedup_tries_pairs_of_near_fingerprints(spark, monkeypatch):
    import corpus_pipeline as P

    data = [(1, 10, 5), (1, 11, 5), (2, 20, 5 ^ 7), (3, 30, 5 ^ (0b1111 << 20)), (4, 40, -1), (5, 50, 5)]
    df = spark.createDataFrame([(i, s, fp, 0 if s == 50 else 3) for i, s, fp in data], "id long, set_hash long, fp long, n int")
    assert {tuple(r) for r in simhash._pairs_by_fingerprint(df).select("a", "b").collect()} == {(10, 11), (10, 20)}
    tried = []
    find = simhash._pairs_by_fingerprint
    monkeypatch.setattr(simhash, "_pairs_by_fingerprint", lambda rows: tried.append(rows.columns) or find(rows))
    text = " ".join(f"w{i}" for i in range(60))
    docs = spark.createDataFrame([(1, text), (2, text + " end"), (3, "other words " * 9)], "doc_id long, text string")
    assert {r.doc_id for r in P.near_dedup(spark, docs, "").collect()} == {1, 3} and "fp" in tried[0]


def test_suffix_buckets_have_equal_shares():
    """Anchors are least hashes; the first bucket still gets no more than the others, and the merge holds few of a run's numbers as Python's."""
    h = suffixdedup.anchors(np.frombuffer(random.Random(8).randbytes(400_000), np.uint8))[0]
    counts = np.bincount((h >> np.uint64(58)).astype(int), minlength=64)
    assert counts.max() < 1.3 * counts.mean()
    packed = [h, np.zeros(0, "<i8"), np.arange(5, dtype="u1"), np.array([-1], "<i8")]
    assert all((a == b).all() and len(a) == len(b) for a, b in zip(packed, suffixdedup._unpack(suffixdedup._pack(*packed), "<u8", "<i8", "u1", "<i8"), strict=True))
    assert list(suffixdedup._few(np.arange(150), np.arange(150) + 1)) == [(i, i + 1) for i in range(150)]
