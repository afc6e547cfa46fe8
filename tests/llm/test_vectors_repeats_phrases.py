"""Whitening, seed-and-extend dedup and collocations against versions by brute force."""

import hashlib
import random
from collections import Counter
from decimal import Decimal

import numpy as np
import pytest

from tessella.llm import collocations as C
from tessella.llm import membership as M
from tessella.llm import seedextend as S
from tessella.llm import whitening as W

SF = "/root/testdata/sf0.001"


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def whitened_by_numpy(vectors):
    x = np.floor(256 * np.array(vectors))
    u = np.unique(x, axis=0)
    e, v = np.linalg.eigh(np.cov(u.T, bias=True).reshape(x.shape[1], -1))
    z = (x - u.mean(0)) @ v[:, ::-1] / np.sqrt(np.maximum(e[::-1], 1e-300))
    return u, e[::-1], z


def test_whitening_of_the_given_vectors(spark):
    got = W.op11_embedding_whitening(spark, SF).toPandas()
    given = spark.read.parquet(f"{SF}/embeddings.parquet").toPandas()
    u, e, z = whitened_by_numpy(given.embedding.tolist())
    assert len(got) == 4 * len(given) and set(got.n) == {len(u)} and got.identity_error.max() <= 1e-9
    exact = {i: sum((len(u) * int(a) - int(s)) ** 2 for a, s in zip(np.floor(256 * np.array(v)), u.sum(0), strict=True)) for i, v in zip(given.vec_id, given.embedding, strict=True)}
    for c in range(4):
        own = got[got.component == c + 1].set_index("vec_id").loc[given.vec_id]
        assert min(np.abs(own.whitened - z[:, c]).max(), np.abs(own.whitened + z[:, c]).max()) < 1e-9
        assert own.explained.iloc[0] == pytest.approx(e[c] / e.sum(), rel=1e-9) and own.deviation.to_dict() == exact


def test_whitening_of_odd_rows(spark):
    good = [[1.0, 0.0], [-1.0, 0.0], [0.0, 1.0], [0.0, -1.0]]  # equal eigenvalues
    odd = [None, [1.0, None], [float("nan"), 1.0], [float("inf"), 1.0], [1.0, 2.0, 3.0], []]
    df = spark.createDataFrame([(i, v, "x", 1) for i, v in enumerate(good + odd + [good[0]])] + [(None, good[1], "y", 2)], "vec_id long, embedding array<double>, component string, n int")
    got = W.whiten(df, W.fit_whitening(df))
    assert {r.vec_id for r in got.collect()} == {0, 1, 2, 3, 10, None} and {r.n for r in got.collect()} == {4}
    by = {(r.vec_id, r.component): r for r in got.collect()}
    assert by[0, 1].whitened == by[10, 1].whitened and by[1, 2].whitened == by[None, 2].whitened and {r.explained for r in by.values()} == {0.5}
    for i in range(4):  # any orthonormal basis: lengths are the same
        assert by[i, 1].whitened ** 2 + by[i, 2].whitened ** 2 == pytest.approx(2.0)
    assert {r.deviation for r in by.values()} == {(4 * 256) ** 2} and max(r.identity_error for r in by.values()) < 1e-12
    for some in ([], [[1.0, 2.0]], [[1.0, 2.0]] * 3, [[], []]):
        e = spark.createDataFrame([(i, v) for i, v in enumerate(some)], "vec_id long, embedding array<float>")
        assert rows(W.whiten(e, W.fit_whitening(e))) == []
    line = spark.createDataFrame([(i, [float(i), 2.0 * i, 5.0]) for i in range(5)], "vec_id long, embedding array<double>")  # rank one
    assert {r.component for r in W.whiten(line, W.fit_whitening(line)).collect()} == {1}
    huge = spark.createDataFrame([(0, [1e300, 1.0]), (1, [-1e300, 2.0]), (2, [3.0, 4.0])], "vec_id long, embedding array<double>")
    assert {r.deviation for r in W.whiten(huge, W.fit_whitening(huge)).where("vec_id < 2").collect()} == {None}


def test_characteristic_polynomials_and_roots(spark):
    rnd = np.random.default_rng(5)
    for d in (1, 2, 5, 9):
        a = rnd.integers(-9, 9, (d, d + 2))
        m = [[int(v) for v in r] for r in a @ a.T]
        poly = W.characteristic_polynomial(spark, m)
        assert np.allclose(np.array(poly[::-1], float), np.poly(np.array(m, float)), rtol=1e-6, atol=1e-3) and poly[-1] == 1
        found = W.largest_roots(poly, 4, sum(m[i][i] for i in range(d)))
        assert np.allclose([float(Decimal(t) / (1 << s)) for t, s in found], np.linalg.eigvalsh(np.array(m, float))[::-1][: len(found)], rtol=1e-9)
    m = [[0, 0, 4], [0, 4, 0], [4, 0, 0]]  # pivots that are zero
    for p in W.primes_beyond(10**9):
        assert W.polynomial_mod(m, p) == [64 % p, -16 % p, -4 % p, 1]
    assert [W.roots_beyond([-6, 11, -6, 1], x, 0) for x in (0, 1, 2, 3)] == [3, 2, 1, 0] and W.roots_beyond([1, -2, 1], 1, 1) == 2
    assert W.integers(np.array([-0.0, 0.999, -0.001, 1e300, -1e300])).tolist() == [0, 255, -1, (1 << 63) - 1, -(1 << 63)]
    x = np.array([[1, -128], [127, 128], [40000, 0], [1 << 40, -5]])
    assert W.unpacked(W.packed(x), 2).tolist() == x.tolist() and [len(b) for b in W.packed(x)] == [3, 5, 9, 17]


def removed(texts, length):
    words = [(k, (t or "").encode().split()) for k, t in texts]
    c = Counter(tuple(w[i : i + length]) for _, w in words for i in range(len(w) - length + 1))
    out = []
    for k, w in words:
        hit = [False] * len(w)
        for i in range(len(w) - length + 1):
            if c[tuple(w[i : i + length])] > 1:
                hit[i : i + length] = [True] * length
        out.append((k, w, hit))
    return out


def test_repeats_of_words_by_brute_force(spark, monkeypatch):
    rnd = random.Random(3)
    monkeypatch.setattr(S, "SEGMENT", 300)
    word = lambda v: " ".join(rnd.choice(v) for _ in range(rnd.choice([0, 34, 35, 36, 90, 300])))
    base = [word(rnd.choice([["a"], ["a", "b"], list("abcdefgh"), [str(i) for i in range(200)]])) for _ in range(30)]
    texts = list(enumerate(base)) + [(None, None), (None, base[3]), (7, base[9] + " x \t\n" + base[4]), (8, "")]
    texts += [(100 + i, " ".join(base[5].split()[i:] + base[6].split()[: -i or None])) for i in range(20)]  # a hot passage in many contexts
    df = spark.createDataFrame([(k, t, "x", 1) for k, t in texts], "doc_id long, text string, h string, runs int")
    for length, anchor in ((35, 10), (12, 5)):
        want = removed(texts, length)
        digests = [(k, len(w), sum(hit), hashlib.sha256(b" ".join(x for x, y in zip(w, hit, strict=True) if not y)).hexdigest()) for k, w, hit in want]
        assert rows(S.repeat_digests(df, length=length, anchor=anchor)) == sorted(digests, key=repr)
        spans = []
        for k, _, hit in want:
            edges = [i for i in range(len(hit) + 1) if (i < len(hit) and hit[i]) != (i > 0 and hit[i - 1])]
            spans += [(k, a, z) for a, z in zip(edges[::2], edges[1::2], strict=True)]
        assert rows(S.maximal_repeats(df, length=length, anchor=anchor)) == sorted(spans, key=repr)
        kept = [(k, t if not any(hit) else b" ".join(x for x, y in zip(w, hit, strict=True) if not y).decode(), "x", 1) for (k, t), (_, w, hit) in zip(texts, want, strict=True)]
        assert rows(S.without_repeated_windows(df, length=length, anchor=anchor)) == sorted(kept, key=repr)
    assert rows(S.repeat_digests(df.limit(0))) == []


def test_places_of_least_values_and_filters(spark):
    v = np.array([5, 3, 3, 9, 1, 1, 7, 2], np.uint64)
    for width in (1, 2, 3, 5, 8):
        assert S.least_places(v, width).tolist() == [max(range(i, i + width), key=lambda j: (-int(v[j]), j)) for i in range(len(v) - width + 1)]
    keys = np.random.default_rng(1).integers(-(2**63), 2**63 - 1, 3000)
    found = M.filter_of(spark.createDataFrame([(int(k),) for k in keys], "k long"), "k", 20)
    assert M.held(found, keys.view(np.uint64)).all()
    others = np.random.default_rng(2).integers(-(2**63), 2**63 - 1, 3000)
    assert M.held(found, others.view(np.uint64)).mean() < 0.01 and not M.held(M.filter_of(spark.createDataFrame([], "k long"), "k", 20), keys.view(np.uint64)).any()


def collocated(texts, least, top):
    n, f = Counter(), Counter()
    for lang, t in texts:
        lang = lang or "und"
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
        for mark in ".,;:!?\n\x0b\x0c\r":
            low = low.replace(mark, "\n")
        for piece in low.split("\n"):
            w = [x for x in piece.replace("\t", " ").split(" ") if x]
            n[lang] += len(w)
            f.update((lang, tuple(w[i : i + k])) for k in range(1, 6) for i in range(len(w) - k + 1))
    f = {k: c for k, c in f.items() if c >= least}
    out = []
    for (lang, p), a in f.items():
        if len(p) > 1 and not any(c >= a and q[0] == lang and len(q[1]) > len(p) and any(q[1][i : i + len(p)] == p for i in range(len(q[1]))) for q, c in f.items()):
            score, _, left, right = min((1000 * a * n[lang] // (f[lang, p[:k]] * f[lang, p[k:]]), k, f[lang, p[:k]], f[lang, p[k:]]) for k in range(1, len(p)))
            out.append((lang, " ".join(p), a, left, right, n[lang], score))
    ranked = []
    for lang in n:
        own = sorted((r for r in out if r[0] == lang), key=lambda r: (-r[6], -r[2], r[1].encode()))[:top]
        ranked += [(lang, i + 1, *r[1:]) for i, r in enumerate(own)]
    return sorted(ranked, key=repr)


def test_collocations_by_brute_force(spark, monkeypatch):
    rnd = random.Random(9)
    words = "the of New York é naïve x y a b c".split(" ")
    text = lambda: "".join(rnd.choice(words[:4] if rnd.random() < 0.5 else words) + rnd.choice([" ", " ", " ", "\t", ", ", ".", "\n"]) for _ in range(rnd.randint(0, 60)))
    texts = [(rnd.choice(["en", "de", None, "und"]), text()) for _ in range(250)] + [("fr", None), ("fr", " ., "), ("es", "one two"), ("en", "New York " * 500), (None, "a b c a b " * 200)]
    df = spark.createDataFrame([(i, t, g, 1) for i, (g, t) in enumerate(texts)], "doc_id long, text string, lang string, a int")
    for segment, run in ((1 << 20, 4_000_000), (40, 50)):
        monkeypatch.setattr(C, "SEGMENT", segment)
        monkeypatch.setattr(C, "RUN", run)
        for least, top in ((5, 2000), (40, 3)):
            assert rows(C.collocations(df, least=least, top=top)) == collocated(texts, least, top)
    assert rows(C.collocations(df.limit(0))) == []


def test_hat_tries_burst_and_spill_whole_subtrees():
    rnd = random.Random(1)
    for width in (2, 3, 5):
        trie, want, got, spilt = C.HatTrie(width, full=60, burst=10), Counter(), Counter(), []
        for _ in range(30):
            some = Counter(tuple(rnd.choice([1, 2, 1 << 63, 700]) for _ in range(width)) for _ in range(20))
            want.update(some)
            trie.add(np.array(list(some), np.uint64), np.array(list(some.values())))
            if sum(trie.sizes.values()) > trie.full:
                spilt += list(trie.spilled(trie.full // 2))
                assert sum(trie.sizes.values()) <= 30
        spilt += list(trie.spilled(0))
        for *ids, c in spilt:
            keys = list(zip(*(i.view(np.uint64).tolist() for i in ids), strict=True))
            starts = list(dict.fromkeys(k[0] for k in keys))
            assert all([k for k in keys if k[0] == s] == sorted(k for k in keys if k[0] == s) for s in starts)
            got.update(dict(zip(keys, c.tolist(), strict=True)))
        assert got == want and not trie.root and not trie.burst


def test_markup_of_any_kind_is_read():
    from tessella.llm.htmltext import main_text
    from tessella.llm.media import sequence

    rnd = random.Random(1)
    parts = ["<![foo[ bar", "<!", "<![", "]]>", "<div", '<p class="', "'", ">", "&#" + "9" * 5000 + ";", "&#x", "<script>", "</script>", "text", "<!--", "-->", "<?", "<img src=a data-bytes=²>", "\x00", "<![CDATA[", "]>", "/>", "</", "<b hidden>", "</i>"]
    for _ in range(1500):
        page = "".join(rnd.choice(parts) for _ in range(rnd.randint(1, 40)))
        main_text(page), sequence(page)
    assert main_text("<p>a &#0000065; <![foo[ bar> b</p><p hidden>no</p>") == "a A b"
    assert [sequence(f'<img src="x" data-bytes="{n}">')[0][4] for n in ("²", "12", "9" * 30, "-1", "")] == [None, 12, None, None, None]
    assert main_text("<div>" * 10_000 + "deep " * 20 + "</div>" * 10_000) == ("deep " * 20).strip()
    assert main_text("<b>x" * 10_000 + "</i>" * 10_000).count("x") == 10_000


def test_without_article_the_ratio_finds_the_same_text(spark):
    from tessella.llm.htmltext import main_text

    pages = [r.html or "" for r in spark.read.parquet("/root/testdata/sf0.001/pages.parquet").select("html").collect()]
    for page in pages:
        other = page
        for tag in ("article", "main"):
            other = other.replace(f"<{tag}", "<div").replace(f"</{tag}", "</div")
        assert main_text(other) == main_text(page)


def test_shingles_of_long_texts_take_bounded_memory(monkeypatch):
    import tracemalloc

    from tessella.llm import simhash as H

    long = b" ".join(b"w%d" % (i % 5000) for i in range(1_500_000))
    tracemalloc.start()
    whole = H.fingerprint(long)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 80_000_000
    monkeypatch.setattr(H, "SEGMENT", 70_000)
    assert H.fingerprint(long) == whole
    words = b"A b C d e f g".split()
    for k in (1, 3, 7, 9):
        monkeypatch.setattr(H, "SEGMENT", 3)
        few = np.concatenate(list(H.shingle_hashes(b" ".join(words), k)))
        monkeypatch.setattr(H, "SEGMENT", 1 << 20)
        assert (few == np.concatenate(list(H.shingle_hashes(b" ".join(words), k)))).all() and len(few) == max(1, len(words) - k + 1)
