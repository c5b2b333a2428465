"""Pieces of the recurrent model that are worked out in other ways than they read."""

import numpy as np

from sheaf.llm import recurrent as R


def test_row_max():
    rng = np.random.default_rng(1)
    for rows, width in ((3, 40), (512, 1), (700, 6), (700, 7), (900, 64), (512, 77)):
        x = rng.normal(size=(rows, width)).astype(np.float32)
        assert (R._row_max(x) == x.max(axis=1, keepdims=True)).all()


def test_words_get_the_next_number():
    known = R._numbers()
    words = b"b a b c a d".split()
    assert [known[w] for w in words] == [0, 1, 0, 2, 1, 3] and list(known) == [b"b", b"a", b"c", b"d"]


def test_head_by_class():
    codes = np.random.default_rng(2).integers(0, 700, 5000).astype(np.int32)
    found = dict(R._by_class(codes, 512))
    assert sorted(found) == list(range(16))
    for c, places in found.items():
        assert places.tolist() == [i for i in range(5000) if codes[i] < 512 and codes[i] // R.CLASS_WORDS == c]


def test_words_of_a_frame():
    texts = [None, "", " \t", "\x1cB\x85b  É x\x0b", "x lead B\n", "b\fİ"]
    words = [(t or "").encode().lower().split() for t in texts]
    distinct, which, lengths = R._tokens(texts)
    assert distinct == [w.decode() for w in dict.fromkeys(w for own in words for w in own)]
    assert [distinct[i].encode() for i in which] == [w for own in words for w in own]
    assert lengths.tolist() == [len(own) for own in words]
    assert [len(x) for x in R._tokens([None, " "])] == [0, 0, 2]


def test_one_place_of_a_softmax():
    x = np.random.default_rng(3).normal(0, 9, (600, 48)).astype(np.float32)
    at = np.arange(600) % 48
    assert (R._softmax_at(x.copy(), at) == R._softmax(x.copy())[np.arange(600), at]).all()


def test_states_by_feature():
    """Each lane's states are those of the plain formula, from a new state where a document starts."""
    classes = R.Classes(100, 40, 10, [9] * 40, {(1, 0): (5, 5), (2, 0): (8, 1)})
    m, n = R.initial(classes), R.STATE
    rng = np.random.default_rng(5)
    lanes = R.Lanes([rng.integers(0, classes.n_codes, size=k) for k in (13, 7, 20, 4, 16)], 3)
    at, _ = next(lanes.windows())
    h = rng.normal(0, 0.5, (n, at.shape[1])).astype(np.float32)
    kept: list = []
    got = R._states(m, lanes, at, h, kept)
    assert got.shape == (len(at), n, at.shape[1]) and [k.shape for k in kept] == [got.shape, got.shape, (len(at), 3 * n, at.shape[1])]
    for lane in range(at.shape[1]):
        state = h[:, lane].astype(np.float64)
        for t, place in enumerate(at[:, lane]):
            state = np.zeros(n) if lanes.start[place] else state
            given, own = m["inputs"][lanes.given[place]].astype(np.float64), state @ m["state"]
            z, r = np.split(1 / (1 + np.exp(-2 * (given + own)[: 2 * n])), 2)
            new = np.tanh(given[2 * n:] + r * own[2 * n:])
            assert np.allclose(kept[0][t, :, lane], state, atol=1e-5) and np.allclose(kept[2][t, :, lane], [*z, *r, *new], atol=1e-5)
            state = new + z * (state - new)
            assert np.allclose(got[t, :, lane], state, atol=1e-5)


def test_gates_of_any_size():
    with np.errstate(over="ignore"):
        assert np.allclose(R._gates(np.array([-1e4, -200, 0, 200, 1e4], dtype=np.float32)), [1, 1, 0.5, 0, 0])


def test_bounded_powers():
    """What is taken off a bias changes no probability, and large weights are not taken for bounded."""
    rng = np.random.default_rng(6)
    s = rng.uniform(-1, 1, (R.STATE, 700)).astype(np.float32)
    for scale, expected in ((0.5, True), (30, False)):
        weights, bias = rng.normal(0, scale, (R.STATE, 57)).astype(np.float32), rng.normal(90, 9, 57).astype(np.float32)
        lower, bounded = R._bounded(weights, bias)
        assert bounded == expected and lower.max() == 0
        at = np.arange(700) % 57
        got = R._softmax_at((weights.T @ s).T + lower, at, bounded)
        plain = R._softmax((weights.T @ s).T.astype(np.float64) + bias)[np.arange(700), at]
        assert np.isfinite(got).all() and np.allclose(got, plain, rtol=1e-3, atol=1e-7)
    _, bounded = R._bounded(np.stack([weights, 0 * weights]), np.stack([bias, bias]))
    assert not bounded


def test_tokens_of_a_window_by_class():
    """A window's tokens, those of the head first, each with its own state; places behind the ends of lanes are left out."""
    rng = np.random.default_rng(7)
    lanes = R.Lanes([rng.integers(0, 553, size=k).astype(np.int32) for k in (18, 9, 3)])
    at, present = next(lanes.windows())
    states = rng.normal(size=(len(at), R.STATE, at.shape[1])).astype(np.float32)
    model = R.Model({}, 512, 16)
    s, codes, own, groups = model._laid(lanes, states, at, present)
    assert sorted(own.tolist()) == np.flatnonzero(present).tolist() and (codes == lanes.target[at.ravel()[own]]).all()
    assert all((codes[rows] // R.CLASS_WORDS == c).all() for c, rows in groups)
    assert sum(rows.stop - rows.start for _, rows in groups) == (codes < 512).sum()
    for i, place in enumerate(own):
        t, lane = divmod(place, at.shape[1])
        assert (s[:, i] == states[t, :, lane]).all()
