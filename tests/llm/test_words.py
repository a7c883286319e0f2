import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm.words import pieces, shingles, tokens, word_hash


def plain(text):
    return re.findall(r"[A-Za-z0-9_éüßñ]+", text)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet="ab zÉé_1.,\n-ü", max_size=60)), max_size=8))
def test_tokens_are_the_words(texts):
    w = tokens(pa.array(texts, pa.string()))
    got = [(int(r), texts[r].encode()[s:e].decode()) for r, s, e in zip(w.row, w.start, w.end)]
    want = [(k, x) for k, t in enumerate(texts) for x in re.findall(r"[ab z]*?([A-Za-zÉéü0-9_]+)", t or "")]
    assert got == want


def test_case_and_slices():
    assert (word_hash("École TEST Straße") == word_hash("école test straße")).all()
    assert (word_hash("ПРИВЕТ ΣΟΦ Ẁ Ａ") == word_hash("привет σοφ ẁ ａ")).all()
    col = pa.array(["a b", None, "c", "a b"]).slice(1)
    w = tokens(col)
    assert w.row.tolist() == [1, 2, 2] and w.counts().tolist() == [0, 1, 2]
    assert tokens(pa.array([], pa.string())).rows == 0


def test_long_text_has_the_same_hashes():
    text = " ".join(f"w{k % 1000}" for k in range(200_000))
    h = tokens(pa.array([text])).hash
    assert (h[:1000] == h[1000:2000]).all() and len(np.unique(h)) == 1000


def test_shingles():
    w = tokens(pa.array(["a b c d", "a b", "", "b c d"]))
    s, r = shingles(w, 3)
    assert r.tolist() == [0, 0, 1, 3] and s[1] == s[3] and len(set(s.tolist())) == 3


def test_pieces_keep_all_rows():
    b = pa.record_batch([pa.array(["x" * 50] * 10 + ["y" * 500])], ["t"])
    out = list(pieces(b, "t", 120))
    assert sum(p.num_rows for p in out) == 11 and max(p.num_rows for p in out) == 2
