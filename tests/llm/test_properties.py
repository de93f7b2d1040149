"""Random inputs against the library or plain Python."""

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from nexuloom.llm import chat, queries, simhash, suffix, tokens

from . import brute

TEXT = st.lists(st.sampled_from(["the", " ", " ", " ", "\n", "\t", ",", ".", "!", "'s", "don't", "é", "ß", "12", "3.5", "  ", " ", " ", "|", "<|endoftext|>", "日本", "🙂", "A", "_", "\r", "\x0b", "x,", "́"]), max_size=30).map("".join)


@settings(max_examples=400, deadline=None)
@given(st.lists(TEXT, min_size=1, max_size=4))
def test_encoder_is_the_library(texts):
    e = tokens.encoder(queries.vocabulary())
    got = [np.frombuffer(b, e.dtype).tolist() for b in e(texts)]
    assert got == [x.ids for x in e.t.encode_batch(texts, add_special_tokens=False)]


@settings(max_examples=200, deadline=None)
@given(TEXT)
def test_fingerprint_and_escapes(text):
    assert int(simhash.fold_bits([simhash.shingle_hashes(text, 3)])[0]) == brute.simhash(text)
    assert chat.parse(chat.render(text, text)[0]) == (text, text)


@settings(max_examples=100, deadline=None)
@given(st.text("ab", min_size=90, max_size=400), st.integers(1, 300), st.booleans())
def test_each_string_has_one_anchor_at_its_offset(text, at, some):
    raw = (text + text[:at] + text).encode()
    frequent = suffix.Frequent(suffix.gram_hashes(raw)[: at if some else 0].view(np.int64)) if len(raw) >= suffix.GRAM else None
    _, place, low, high, _ = suffix.anchors(raw, 100, frequent)
    where = {}
    for p, a, z in zip(place.tolist(), low.tolist(), high.tolist()):
        for o in range(a, z + 1):
            assert p - o not in where
            where[p - o] = o
    assert sorted(where) == list(range(max(0, len(raw) - 99)))
    seen = {}
    for s, o in where.items():
        assert seen.setdefault(raw[s : s + 100], o) == o


@settings(max_examples=50, deadline=None)
@given(st.lists(st.integers(0, 2**64 - 1), min_size=1, max_size=300, unique=True))
def test_gray_rank_orders_all_patterns(xs):
    r = simhash.gray_rank(np.array(xs, np.uint64))
    assert len(set(r.tolist())) == len(xs)
    back = r ^ (r >> np.uint64(1))
    assert back.tolist() == xs


def test_words_of_letters_skip_the_pre_tokenizer(monkeypatch):
    """Latin words go to the merges alone, with the library's ids; other pieces are pre-tokenized."""
    e = tokens.Encoder(queries.vocabulary())
    words = ["the", "Straße", "ÀÉÎõü", "ciónñgaco", "ÿþæ", "x" * 300, "ªº", "ıİſ", "ɏ", "ll", "s"]
    other = ["日本", "ɐa", "a1", "don't", "é", "—", "ՠ", "ﬁn", "|"]
    text = " ".join(["first", *words, *other])
    want, seen = e.whole([text]), []
    whole = type(e)._keep
    monkeypatch.setattr(type(e), "_keep", lambda self, pieces, ids: seen.append(list(pieces)) or whole(self, pieces, ids))
    assert e([text]) == want
    assert sorted(seen[0]) == sorted(words) and sorted(seen[1]) == sorted(other)
