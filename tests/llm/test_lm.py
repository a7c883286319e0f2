import numpy as np
import pyarrow as pa

from tessera.llm import lm
from tessera.llm.words import tokens, word_hash


def grammar(rng, n):
    out = []
    for _ in range(n):
        a = rng.integers(0, 8)
        out += [f"a{a}", f"b{a}", f"c{rng.integers(0, 4)}"]
    return " ".join(out)


def model(spark, size=40, head=12, groups=3):
    rng = np.random.default_rng(1)
    rows = [(k, grammar(rng, 900)) for k in range(24)]
    docs = spark.createDataFrame(rows, "d long, t string").select("t").repartition(2)
    vocab, _ = lm.symbols_of(lm.count_words(docs, 4), size, 4, head, groups)
    return vocab, lm.train(docs, vocab, dims=8, rate=0.3), grammar(rng, 800) + " unheard of"


def every_probability(p, v, before):
    """Of every id after one context, by brute force."""
    h = sum(p.context[before[j]] @ p.turn[j] for j in range(lm.CONTEXT))
    s = np.exp(h @ p.symbol.T + p.symbol_bias)
    s /= s.sum()
    out = np.zeros(len(v.share))
    out[1 : 1 + v.head], out[1 + v.words :] = s[: v.head], s[len(s) - v.classes :]
    for g in range(len(v.edges) - 1):
        lo, hi = v.edges[g], v.edges[g + 1]
        w = np.exp(h @ p.word[lo:hi].T + p.word_bias[lo:hi])
        out[1 + v.head + lo : 1 + v.head + hi] = s[v.head + g] * w / w.sum()
    return out


def test_probabilities_are_normalised_and_equal_brute_force(spark):
    vocab, p, held = model(spark)
    x, before, _ = vocab.stream(pa.array([held]))
    got = lm.Scorer(p, vocab).log_probs(x, before)
    assert (x > vocab.words).sum() == 2 and ((x > vocab.head) & (x <= vocab.words)).any()
    for k in [*range(0, len(x), 97), len(x) - 1]:
        want = every_probability(p, vocab, before[k])
        assert np.isclose(want.sum(), 1) and np.isclose(np.exp(got[k]), want[x[k]], rtol=1e-3)


def test_held_out_text_is_better_predicted_than_by_frequency(spark):
    vocab, p, held = model(spark)
    x, before, _ = vocab.stream(pa.array([held]))
    unigram = -np.log(vocab.share[x]).mean()
    assert -lm.Scorer(p, vocab).log_probs(x, before).mean() < unigram - 0.4


def test_vocabulary_counts_all_documents(spark):
    docs = spark.createDataFrame([("b a a",), ("a c b",), (None,)], "t string").filter("t is not null")
    v, _ = lm.symbols_of(lm.count_words(docs, 1), 2, 1, head=1)
    assert v.ids_of(word_hash("a b")).tolist() == [1, 2] and v.ids_of(word_hash("c"))[0] == -1
    assert v.share[1] > v.share[2] > 0 and v.symbols == 3


def test_ids_beyond_two_bytes_are_told_apart():
    top = [(int(h), 1000 - k // 100, b"w%d" % k) for k, h in enumerate(np.random.default_rng(2).choice(1 << 40, 70_000, replace=False))]
    v = lm.Vocabulary(top, np.ones(4))
    assert v.words == 70_000 and len(set(v.ids.tolist())) == 70_000 and (np.diff(v.edges) > 0).all()
    ids, sums = lm._sums(np.array([5, 65_541, 5, 65_541]), np.ones((4, 1), np.float32))
    assert ids.tolist() == [5, 65_541] and sums[:, 0].tolist() == [2, 2]
    p = lm.Parameters.start(v, 4)
    x = np.array([3, 66_000, 69_999])
    before = np.array([[0, 0], [69_000, 5], [66_000, 69_000]])
    trainer = lm.Trainer(p, v)
    old = lm.Scorer(p, v).log_probs(x, before)
    for _ in range(20):
        trainer.step(x, before)
    assert (lm.Scorer(trainer.p, v).log_probs(x, before) > old).all()
    assert np.isclose(every_probability(trainer.p, v, before[1]).sum(), 1, atol=1e-4)


def test_odd_rows(odd_docs):
    wide = odd_docs.selectExpr("*", "1 as d", "2 as t")
    rows = lm.score(wide).collect()
    assert len(rows) == wide.count()
    assert all((r.n_tokens is None) == (r.log_prob is None) for r in rows) and sum(r.n_tokens is None for r in rows) == 2
    assert all(r.perplexity is None for r in rows if not r.n_tokens)
    assert [r for r in rows if r.n_tokens == 30_000][0].log_prob < 0


def test_empty(docs_of):
    assert lm.score(docs_of([])).count() == 0


def test_rare_words_have_probabilities_of_their_own(spark):
    rows = [(1, "the cat " * 200 + "zebra " * 20 + "quagga"), (2, "zebra zebra"), (3, "quagga quagga"), (4, "xqjzkvw xqjzkvw"), (5, "the cat")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.log_prob for r in lm.score(docs, vocabulary_size=2, classes=1, least=5).collect()}
    # All but "the" and "cat" is beyond the symbols: one word of one probability, once.
    assert got[5] > got[2] > got[3] + 1 > got[4] + 2


def test_words_of_a_class_share_one(spark):
    rng = np.random.default_rng(3)
    made = ["".join(rng.choice(list("abc"), rng.integers(1, 4))) for _ in range(400)]
    docs = spark.createDataFrame([(" ".join(made[:200]),), (" ".join(made[200:]),)], "t string")
    vocab, marked = lm.symbols_of(lm.count_words(docs, 3), 4, 3)
    rows = {r["k"]: r for r in marked.collect()}
    assert sum(r["top"] for r in rows.values()) == 4 and sum(r["c"] for r in rows.values()) == 400
    assert np.isclose(vocab.share.sum(), 1) and len(vocab.share) == 8 and vocab.symbols == 7
    lp = {r["k"]: r["lp"] for r in lm.word_probs(marked, 3, 5).collect()}
    assert set(lp) == {k for k, r in rows.items() if not r["top"]}
    # Words of the vocabulary have their counts' shares; with the words of the class that were never seen, all make 1.
    for g in range(3):
        own = [r for k, r in rows.items() if r["g"] == g and k in lp]
        n = sum(r["c"] for r in own) + 1
        assert all(np.isclose(lp[r["k"]], np.log(r["c"] / n)) for r in own if r["c"] >= 5)
        assert sum(np.exp(lp[r["k"]]) for r in own) < 1


def test_spellings_are_normalised():
    words = pa.array([b"ab", b"ba", b"aab", b"b", "é".encode()])
    key, _ = lm.spelling_keys(words)
    k, c = np.unique(key, return_counts=True)
    s = lm.Spelling(k, c)
    n = lm.EDGE + 1
    for context in (n * lm.EDGE + n * n * lm.EDGE, n * 97 + n * n * 98, n * 120 + n * n * 121):
        assert np.isclose(np.nansum(np.exp(np.where(s.pair[context // n % n] > 0, s.log_probs(np.arange(n) + context), -np.inf))), 1)
    empty = np.exp(s.log_probs(np.array([lm.EDGE * (1 + n + n * n)])))[0]
    assert np.isclose(s.class_mass(7).sum(), 1 - empty)


def test_only_ends_of_words_beyond_the_vocabulary_are_folded(monkeypatch):
    texts = pa.array(["the end " * 500 + "Ünder ÉÉ ΩΣ Ẁ x ЖЖ 日本 don’t aẞ naïVE \U0001f600Ab A", None, "", "Zq", "É", "the" + "é" * 9])
    w = tokens(texts)
    top = [(int(h), 5, b"e") for h in np.unique(w.hash[:2]).view(np.int64)]
    v = lm.Vocabulary(top, np.ones(32))
    data, start, end = lm.folded(texts, w)
    rest = np.flatnonzero(v.ids_of(w.hash) < 0)
    assert 8 < len(rest) < 30
    seen, real = [], lm._classes
    monkeypatch.setattr(lm, "_classes", lambda d: seen.append(len(d)) or real(d))
    x, _, _ = v.stream(texts)
    assert np.array_equal(x[rest], 1 + v.words + lm.class_of(data, start[rest], end[rest], 32))
    assert sum(seen) <= 5 * len(rest) + 1


def test_words_whose_hashes_end_alike_are_told_apart():
    low = int(lm.SLOTS) + 1
    held = [7, 7 + low, 7 + 9 * low, 8, -low + 3]
    v = lm.Vocabulary([(h, 5, b"e") for h in held], np.ones(4))
    probe = np.array([*held, 7 + 2 * low, 8 + low, 0, 9], np.int64).view(np.uint64)
    by_hash = dict(zip(v.hashes.tolist(), v.ids.tolist(), strict=True))
    assert v.ids_of(probe).tolist() == [by_hash.get(int(h), -1) for h in probe]


def test_sums_by_pairs_of_columns_equal_plain_ones():
    rng = np.random.default_rng(1)
    ids, rows = rng.integers(0, 9, 300), rng.normal(size=(300, 18)).astype(np.float32)
    at, got = lm._sums(ids, rows)
    assert np.array_equal(at, np.arange(9)) and got.dtype == np.float32
    assert np.allclose(got, np.stack([rows[ids == k].sum(axis=0) for k in at]), atol=1e-4)
