"""The numpy parts against plain Python."""

import random
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sigmaflow.llm import decontaminate, hnsw, kit, order, repeats

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="aB .,é漢9\n", max_size=40), max_size=8))
def test_word_codes_are_words(texts):
    codes, counts = kit.word_codes([t.encode() for t in texts])
    words = [WORD.findall(lower(t)) for t in texts]
    assert counts.tolist() == [len(w) for w in words]
    flat = [w for ws in words for w in ws]
    assert [[a == b for b in flat] for a in flat] == (codes[:, None] == codes[None]).tolist()


def test_word_codes_across_slices(monkeypatch):
    texts = [b"one two three four five six seven eight nine ten " * 20, b"two", b""]
    want = kit.word_codes(texts)
    monkeypatch.setattr(kit, "SLICE", 37)
    got = kit.word_codes(texts)
    assert (got[0] == want[0]).all() and (got[1] == want[1]).all()


def test_shingles():
    codes, counts = kit.word_codes([b"a b c d e f", b"a b", b"", b"b c d e f"])
    sh, n = kit.shingle_codes(codes, counts, 5)
    assert n.tolist() == [2, 1, 0, 1] and sh[1] == sh[3] and sh[0] != sh[2]


@pytest.mark.parametrize("width", [1, 2, 3, 10])
def test_window_search_finds_all(width):
    rng = random.Random(width)
    word = lambda: rng.choice("abcd")
    items = [" ".join(word() for _ in range(rng.randint(0, 14))) for _ in range(6)]
    docs = [" ".join(word() for _ in range(rng.choice([0, 3, 2000]))) for _ in range(8)]
    sets = decontaminate.window_sets([t.encode() for t in items], width)
    codes, counts = kit.word_codes([t.encode() for t in docs])
    begin = np.cumsum(counts) - counts
    got = set()
    for s in sets:
        pos, window = s.search(codes, begin, begin + counts)
        for p, w in zip(pos.tolist(), window.tolist(), strict=True):
            d = int(np.searchsorted(begin + counts, p, side="right"))
            got |= {(d, p - s.length + 1 - int(begin[d]), int(i)) for i in s.items[s.item_at[w] : s.item_at[w + 1]]}
    want = set()
    for i, t in enumerate(items):
        ws = t.split()
        m = min(width, len(ws))
        wins = {tuple(ws[k : k + m]) for k in range(len(ws) - m + 1)} if m else set()
        for d, text in enumerate(docs):
            dw = text.split()
            want |= {(d, k, i) for k in range(len(dw) - m + 1) if m and tuple(dw[k : k + m]) in wins}
    assert got == want


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="ab", min_size=1, max_size=30), min_size=1, max_size=6))
def test_run_index_statistics(texts):
    pieces = [t.encode() for t in texts]
    index = repeats.RunIndex(pieces)
    got, begin = index.statistics(), np.concatenate([[0], index.ends[:-1] + 1])
    suffixes = [(i, a, p[a:]) for i, p in enumerate(pieces) for a in range(len(p))]
    for i, a, s in suffixes:
        best = 0
        for j, b, o in suffixes:
            if (i, a) != (j, b):
                n = 0
                while n < min(len(s), len(o)) and s[n] == o[n]:
                    n += 1
                best = max(best, n)
        assert got[begin[i] + a] == best


def test_long_repeats_have_full_statistics():
    rng = random.Random(3)
    body = bytes(rng.choice(b"abcdef") for _ in range(5000))
    index = repeats.RunIndex([b"x" + body + b"y", b"z" + body + b"q"])
    assert index.statistics()[1] == 5000 and index.statistics()[4000] == 1001


def test_anchors_cover_all_windows_alike():
    rng = random.Random(4)
    body = bytes(rng.choice(b"abcdefgh ") for _ in range(900))
    texts = [b"p" * 333 + body, body + b"tail", b"ab" * 700, b"short"]
    got = repeats.anchors(texts)
    for r, t in enumerate(texts):
        mine = sorted((a, b) for a, b in zip(got["a"][got["row"] == r].tolist(), got["b"][got["row"] == r].tolist(), strict=True))
        assert [x for a, b in mine for x in range(a, b + 1)] == list(range(max(0, len(t) - repeats.LENGTH + 1)))
    where = lambda r, w: next(int(h) for h, a, b, x in zip(got["h"], got["a"], got["b"], got["row"], strict=True) if x == r and a <= w <= b)
    assert all(where(0, 333 + s) == where(1, s) for s in range(501))


def test_anchors_in_long_texts(monkeypatch):
    text = bytes(random.Random(5).choice(b"abcdefgh ") for _ in range(5000))
    monkeypatch.setattr(repeats, "CHUNK", 700)
    got = repeats.anchors([text, text[:450]])
    spans = sorted(zip(got["a"][got["row"] == 0].tolist(), got["b"][got["row"] == 0].tolist(), strict=True))
    assert [x for a, b in spans for x in range(a, b + 1)] == list(range(4601))


def test_context_digests_stand_for_bytes():
    rng = random.Random(6)
    body = bytes(rng.choice(b"abcdefgh ") for _ in range(2000))
    other = body[:700] + b"#" + body[701:]
    got = repeats.anchors([body, body, other])
    digest = {}
    for r, a, b, c, d in zip(got["row"].tolist(), got["a"].tolist(), got["b"].tolist(), got["c"].tolist(), got["d"].tolist(), strict=True):
        digest.setdefault((c, d), set()).add((body, body, other)[r][a : b + repeats.LENGTH])
    assert all(len(v) == 1 for v in digest.values())
    assert len(digest) == len({x for v in digest.values() for x in v})


@pytest.mark.parametrize("n", [1, 2, 3, 17, 1000, 4097])
def test_slots_are_a_permutation(n):
    assert sorted(order.slots(np.arange(n), n).tolist()) == list(range(n))
    assert n < 17 or (order.slots(np.arange(n), n, "other") != order.slots(np.arange(n), n)).any()


def test_graph_recall():
    rng = np.random.default_rng(0)
    v = rng.normal(size=(3000, 24)) * rng.uniform(0.2, 3, (3000, 1))
    graph, at = hnsw.Graph.build(v)
    q = rng.normal(size=(100, 24))
    near, _ = graph.search(np.concatenate([q, np.zeros((100, 1))], axis=1).astype(np.float32))
    best = np.argsort(-(q @ v.T), axis=1)[:, :20]
    assert np.mean([len(set(at[n[n >= 0]][:20]) & set(b)) / 20 for n, b in zip(near, best, strict=True)]) >= 0.9
    assert all(len(x) == s for x, s in zip(graph.links, graph.sizes, strict=True))


@pytest.mark.parametrize("n", [1, 2, 5])
def test_tiny_graphs(n):
    graph, _ = hnsw.Graph.build(np.eye(n, 4))
    near, _ = graph.search(np.ones((1, 5), np.float32), ef=n)
    assert sorted(near[0].tolist()) == list(range(n))
