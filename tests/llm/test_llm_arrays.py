"""Operators' cores without Spark, against plain forms."""

import random
import struct

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quern.llm import jaccard, ppm
from quern.llm.feistel import permute_array
from quern.llm.jaccard import bands, signatures
from quern.llm.packing import pack_items
from quern.llm.sentencepiece_trie import MODEL_PATH, Model, Tokenizer, read_model
from quern.llm.shingles import parity, set_keys, shingle_set, shingle_sets
from quern.llm.stringkernel import fit, predict, presence


@given(st.integers(1, 5000), st.integers(0, 2**63))
@settings(max_examples=60, deadline=None)
def test_feistel_is_a_permutation(n, key):
    assert sorted(permute_array(np.arange(n), n, key)) == list(range(n))


@given(st.integers(0, 10_000))
@settings(max_examples=120, deadline=None)
def test_packing_takes_the_tightest_compatible_bin(seed):
    r = random.Random(seed)
    capacity, n = r.choice([5, 16, 100]), r.randint(1, 60)
    sizes = sorted((r.randint(0, capacity) for _ in range(n)), reverse=True)
    sources = [r.choice([None, "a", "a", "b", "c"]) for _ in range(n)]
    clusters = [r.choice([None, 1, 2, *range(9, 30)]) for _ in range(n)]
    bins = {}
    for (b, offset), size, source, cluster in zip(pack_items(sizes, sources, clusters, capacity), sizes, sources, clusters, strict=True):
        fits = lambda held: held[0] and held[0] >= size and (source is None or source not in held[1]) and (cluster is None or cluster not in held[2])
        best = min((held[0] for held in bins.values() if fits(held)), default=None)
        if b in bins:
            assert fits(bins[b]) and bins[b][0] == best and offset == capacity - best
        else:
            assert best is None and offset == 0
            bins[b] = [capacity, set(), set()]
        bins[b][0] -= size
        bins[b][1].add(source)
        bins[b][2].add(cluster)


def key_of(text):
    return int(set_keys(*shingle_sets([text.encode()]))[0])


def test_words_and_shingles_match_their_definition():
    text = "A b\tC d\x0be  f\ng A b C d e f G"
    words = text.encode().lower().split()
    wanted = {tuple(words[i : i + 5]) for i in range(len(words) - 4)}
    assert len(shingle_set(text)) == len(wanted)
    assert len(shingle_set("one two")) == 1 and len(shingle_set(" \n")) == 0 and len(shingle_set(None)) == 0
    assert key_of("x y") == key_of("X  y") != key_of("y x")


def test_texts_taken_together_or_in_pieces_have_the_same_sets(monkeypatch):
    from quern.llm import shingles

    texts = [" ".join(f"w{i}" for i in range(n)).encode() for n in (0, 3000, 1, 4, 5, 0, 6)]
    found, at = shingle_sets(texts)
    alone = [shingle_sets([t])[0] for t in texts]
    assert [found[x:y].tolist() for x, y in zip(at[:-1], at[1:], strict=True)] == [x.tolist() for x in alone]
    monkeypatch.setattr(shingles, "_CHUNK", 100)
    pieces, where = shingle_sets(texts)
    assert (pieces == found).all() and (where == at).all()


def sets_together(*sets):
    return np.concatenate(sets), np.concatenate(([0], np.cumsum([len(x) for x in sets])))


@given(st.integers(0, 10_000), st.sampled_from([4, 5, 9, 16, 24, 60, 204, 206, 257, 400, 520, 1100, 5000]))
@settings(max_examples=150, deadline=None)
def test_linked_sets_share_a_signature(seed, size):
    rng = np.random.default_rng(seed)
    x = np.unique(rng.integers(0, 2**64, size, np.uint64))
    common = np.sort(x[rng.random(len(x)) < rng.choice([0.0, 0.2, 0.9])])
    gone = rng.integers(0, len(x) // 5 + 1)
    left = rng.permutation(x)[gone:]
    new = rng.integers(0, max(1, int(len(left) / 0.8 - len(x)) + 1))
    y = np.unique(np.concatenate([left, rng.integers(0, 2**64, new, np.uint64)]))
    both = len(np.intersect1d(x, y))
    if 100 * both >= 80 * (len(x) + len(y) - both) and len(x) + len(y) > 2 * both:
        alone = [set(signatures(*sets_together(s), common)[0].tolist()) for s in (x, y)]
        assert alone[0] & alone[1]
        sig, own = signatures(*sets_together(x, y, x[:3]), common)
        assert [set(sig[own == k].tolist()) for k in (0, 1, 2)] == [*alone, set()]


def test_bands_hold_partners_in_neighbours():
    starts = bands(100_000)
    for size in range(4, 50_000, 7):
        own, partner = np.searchsorted(starts, [size, size * 5 // 4], side="right")
        assert partner - own <= 1


def test_bounds_keep_linked_pairs():
    rng = np.random.default_rng(3)
    base = np.unique(rng.integers(0, 2**64, 600, np.uint64))
    sets = [np.unique(np.concatenate([rng.permutation(base)[gone:], rng.integers(0, 2**64, gone // 3, np.uint64)])) for gone in (0, 20, 50, 60, 90, 200, 400)]
    rows = jaccard._Rows(pa.table({"node": range(len(sets)), "root": range(len(sets)), "n": [len(s) for s in sets], "bits": [parity(s) for s in sets]}))
    near = {(int(x), int(y)) for xs, ys, _ in rows.near() for x, y in zip(xs, ys, strict=True)}
    for i, x in enumerate(sets):
        for j, y in enumerate(sets):
            both = len(np.intersect1d(x, y))
            if i != j and 100 * both >= 80 * (len(x) + len(y) - both):
                assert (i, j) in near
    assert (0, 6) not in near


def test_unfolded_model_equals_the_plain_trie():
    texts = ["abracadabra", "a\x00b", "", "caba caba dé", "zz"]
    plain, codes = ppm.CountTrie(), []
    for t in texts:
        codes.append(ppm.gram_codes(t.encode()))
        for before, symbol in ppm._walk(t, ppm.ORDER):
            plain.add(before, symbol)
    codes = np.concatenate(codes)
    grams = [np.unique(codes & ((1 << 9 * (k + 1)) - 1), return_counts=True) for k in range(4)]
    model = ppm.Unfolded(grams)
    for t in [*texts, "abba", "qq", "dabré"]:
        assert model.score(t.encode()) == pytest.approx(sum(plain.log10(b, s) for b, s in ppm._walk(t, ppm.ORDER)), rel=1e-5)
    for before in ((256, 256, 256), (97, 98, 114), (1, 2, 3)):
        assert sum(10 ** plain.log10(before, s) for s in range(257)) == pytest.approx(1)


def test_scores_do_not_depend_on_the_piece_size(monkeypatch):
    codes = ppm.gram_codes(b"some text to learn from")
    model = ppm.Unfolded([np.unique(codes & ((1 << 9 * (k + 1)) - 1), return_counts=True) for k in range(4)])
    text = b"another text, some from here" * 5
    whole = model.score(text)
    monkeypatch.setattr(ppm, "_CHUNK", 7)
    assert model.score(text) == pytest.approx(whole)


def test_untrained_and_adaptive_models():
    empty = (np.empty(0, np.int64), np.empty(0, np.int64))
    model = ppm.Unfolded([empty] * 4)
    assert model.score(b"ab") == pytest.approx(-3 * np.log10(257), rel=1e-5)
    assert ppm.adaptive_code_length("ab" * 200) < ppm.adaptive_code_length("".join(random.Random(1).choices("abcdefgh", k=400)))


def test_bpe_equals_the_library():
    sentencepiece = pytest.importorskip("sentencepiece")
    library = sentencepiece.SentencePieceProcessor(model_file=MODEL_PATH)
    ours = Tokenizer(Model.parse(read_model()))
    r = random.Random(3)
    texts = ["", " ", "  a  b ", "\n\n", "é▁x", "日本語 😀\t tab", "a" * 50, "▁", "x \n y  "]
    texts += ["".join(r.choice("abcdeinorst  .\néß1☃") for _ in range(r.randint(1, 80))) for _ in range(300)]
    ids, offsets = ours.encode_batch(texts)
    got = [ids[a:b].tolist() for a, b in zip(offsets, offsets[1:], strict=False)]
    assert got == library.encode(texts)
    assert [ours.decode(x) for x in got] == [library.decode(x) for x in got]


def _piece(text: str, score: float, kind: int = 1) -> bytes:
    body = b"\x0a" + bytes([len(text.encode())]) + text.encode() + b"\x15" + struct.pack("<f", score) + b"\x18" + bytes([kind])
    return b"\x0a" + bytes([len(body)]) + body


def test_unigram_equals_the_library():
    sentencepiece = pytest.importorskip("sentencepiece")
    pieces = _piece("<unk>", 0, 2) + _piece("<s>", 0, 3) + _piece("</s>", 0, 3)
    for i, p in enumerate(["▁", "a", "b", "c", "▁a", "ab", "abc", "bc", "▁ab", "ca", "cab"]):
        pieces += _piece(p, -1.0 - 3 * abs(np.sin(i + 1.0)))  # no two ways have equal sums
    trainer = b"\x18\x01"  # unigram
    normalizer = b"\x0a\x08identity"
    proto = pieces + b"\x12" + bytes([len(trainer)]) + trainer + b"\x1a" + bytes([len(normalizer)]) + normalizer
    library = sentencepiece.SentencePieceProcessor(model_proto=proto)
    ours = Tokenizer(Model.parse(proto))
    r = random.Random(5)
    texts = ["".join(r.choice("abc ") for _ in range(r.randint(1, 30))) for _ in range(200)] + ["axb", "xx a", ""]
    ids, offsets = ours.encode_batch(texts)
    assert [ids[a:b].tolist() for a, b in zip(offsets, offsets[1:], strict=False)] == library.encode(texts)


def test_string_kernel_tells_alphabets_apart():
    texts = [" ".join(random.Random(i).choices(["ab", "ba", "abba"], k=9)) for i in range(12)] + [" ".join(random.Random(i).choices(["xy", "yx", "xyyx"], k=9)) for i in range(12)]
    names, weights = fit(presence(texts)[0], ["p"] * 12 + ["q"] * 12, 6)
    langs, scores = predict(names, weights, ["ABBA ab!", "xy yx", None, "", "12 ?", "x" * 100_000])
    assert langs[:2] == ["p", "q"] and langs[2:5] == ["und"] * 3 and all(0 <= s <= 1 for s in scores)
    assert predict([], np.zeros((weights.shape[0], 0), np.float32), ["abc"]) == (["und"], [0.0])


def test_kernel_ridge_equals_a_dense_solve():
    rng = np.random.default_rng(2)
    bits = (rng.random((24, 1 << 15)) < 0.01).astype(np.float32)
    langs = ["a", "b", "c"] * 8
    names, weights = fit(bits, langs, landmarks=8, ridge=0.5)
    # With every row a landmark the Nystrom map is exact, so this is ridge regression on the whole kernel with an intercept.
    unit = bits / np.sqrt(bits.sum(1, keepdims=True))
    order = np.concatenate([[i for i, x in enumerate(langs) if x == n] for n in names])
    kernel = (unit @ unit.T).astype(float)
    values, vectors = np.linalg.eigh(kernel[np.ix_(order, order)])
    root = vectors / np.sqrt(values)
    z = np.concatenate([kernel[:, order] @ root, np.ones((24, 1))], 1)
    target = np.where(np.array(langs)[:, None] == np.array(names)[None], 1.0, -1.0)
    wanted = z @ np.linalg.solve(z.T @ z + 0.5 * np.eye(z.shape[1]), z.T @ target)
    assert np.allclose(unit @ weights[:-1] + weights[-1], wanted, atol=1e-4)
    assert np.allclose(z[:, :-1] @ z[:, :-1].T, kernel, atol=1e-4)
