"""The operators' cores against brute force, without Spark."""

import dataclasses
import hashlib
import random
import zlib

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from axisloom.llm import decontaminate, licenses, media, passages, pieces, quality, quotes, simhash
from axisloom.llm.common import blank_words, plain_words
from axisloom.llm.queries import PIECES

WORDS = st.lists(st.sampled_from([b"a", b"b", b"c"]), max_size=30)


@given(st.lists(st.lists(st.sampled_from([b"a", b"b", b"c"]), min_size=1, max_size=12), min_size=1, max_size=5), WORDS, st.integers(1, 6))
@settings(max_examples=300, deadline=None)
def test_automaton(items, words, window):
    spans, found = decontaminate.Automaton([(str(i), w) for i, w in enumerate(items)], window).match(words)
    hit, names = set(), set()
    for i, w in enumerate(items):
        n = min(window, len(w))
        for k in range(len(w) - n + 1):
            for j in range(len(words) - n + 1):
                if words[j : j + n] == w[k : k + n]:
                    hit |= set(range(j, j + n))
                    names.add(str(i))
    assert {x for a, b in spans for x in range(a, b)} == hit and found == names


def test_cut_keeps_the_rest():
    text = "Ab, cd! EF gh\n ij éè".encode()
    assert decontaminate.cut(text, [(1, 3)]) == "Ab,  gh\n ij éè".encode()
    assert decontaminate.cut(text, []) == text


def test_golay_code_is_perfect():
    table, count = simhash._near()
    assert sorted(set(count)) == [1, 6] and (count == 1).sum() == 277
    words = np.arange(0, 1 << 23, 4099)
    at, index = simhash.golay_indices(words)
    assert len(index) == count[simhash._syndromes(words)].sum() and index.max() < 4096


@given(st.integers(0, 2**64 - 1), st.sets(st.integers(0, 63), max_size=2))
@settings(max_examples=300, deadline=None)
def test_close_fingerprints_share_a_key(x, flips):
    y = x
    for b in flips:
        y ^= 1 << b
    of = lambda v: set(simhash.fuzzy_keys(np.array([v], np.uint64).view(np.int64))[1].tolist())
    assert of(x) & of(y)


@pytest.mark.parametrize("text", [b"", b"One", b"one two", b"a b c", b"x " * 9000, "é ü\tz\x0bq A b C".encode()])
def test_fingerprint(text):
    words = blank_words(text)
    parts = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([b" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(p, seed=42) for p in parts]
    want = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))
    assert simhash.fingerprint(text) % (1 << 64) == want


@given(st.integers(0, 60), st.integers(1, 12), st.integers(2, 1000), st.randoms())
@settings(max_examples=200, deadline=None)
def test_compact_windows(n, width, kinds, rnd):
    h = np.array([rnd.randrange(kinds) for _ in range(n)], np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    values = h[None, :] * passages._MULTIPLY[:, None]
    values ^= values >> np.uint64(32)
    values = (values & ~np.uint64((1 << 28) - 1)) | np.arange(n, dtype=np.uint64)
    want = set()

    def cut(k, v, low, high):
        if high - low + 1 >= width:
            c = min(range(low, high + 1), key=v.__getitem__)
            want.add((k, low, c, high))
            cut(k, v, low, c - 1)
            cut(k, v, c + 1, high)

    for k, v in enumerate(values.tolist()):
        cut(k, v, 0, n - 1)
    assert set(passages.windows(h, width)) == want


def test_passage_verification():
    rnd = random.Random(1)
    words = [f"w{rnd.randrange(10**6)}".encode() for _ in range(60)]
    other = list(words)
    other[30] = b"changed"
    left, right = [b"x"] * 7 + words + [b"y"] * 5, [b"z"] * 3 + other
    shared = lambda a, b: passages.passages(licenses.shingle_hashes(a), licenses.shingle_hashes(b))
    assert shared(left, right) == ([(7, 67)], [(3, 63)])
    assert shared(left, other[:49]) == ([], [])
    assert shared([], []) == ([], [])


def test_minhash_bands():
    rnd = random.Random(2)
    words = [f"w{rnd.randrange(10**6)}" for _ in range(400)]
    a = " ".join(words).encode()
    found = 0
    for _ in range(50):
        w = list(words)
        for i in rnd.sample(range(400), 6):
            w[i] = "z"
        b = " ".join(w).encode()
        similar = simhash._similarities([a], [b], 5)[0]
        found += any(x == y for x, y in zip(simhash.signature(a, 5), simhash.signature(b, 5), strict=True)) or similar < 0.8
    assert found >= 49
    assert simhash.signature(b"", 5) == [0] * simhash.BANDS


@pytest.fixture(scope="module")
def coder():
    return pieces.Coder(pieces.Vocabulary.read(PIECES()))


@given(st.text(max_size=40) | st.text(alphabet="ab \n▁é", max_size=30))
@settings(max_examples=300, deadline=None)
def test_pieces_round_trip(coder, text):
    ids = coder.encode(text)
    assert coder.decode(ids) == text.encode()
    assert coder.best(" " + text) == ids.tolist() or not text  # by words as well as in one go


def test_pieces_are_the_best():
    v = dataclasses.replace(pieces.Vocabulary.read(PIECES()), merging=False)  # taken as log-probabilities
    coder = pieces.Coder(v)
    gain = {p: (s, i) for i, (p, s, k) in enumerate(zip(v.pieces, v.scores, v.kinds, strict=True)) if k == "n"}

    def brute(text):
        best = [(0.0, [])]
        for end in range(1, len(text) + 1):
            found = None
            for start in range(max(0, end - 20), end):
                part = text[start:end]
                if "▁" not in part and (g := gain.get(part.replace(" ", "▁"))) and (found is None or best[start][0] + g[0] > found[0]):
                    found = (best[start][0] + g[0], [*best[start][1], g[1]])
            spelled = (best[-1][0] + coder.below, best[-1][1] + coder._spell(text[end - 1]))
            best.append(found if found and found[0] >= spelled[0] else spelled)
        return best[-1][1]

    for text in ("Hello  wörld", "retitioning ouen\n\nthe▁ of 日本", "  a", "x" * 50):
        assert coder.encode(text).tolist() == brute(" " + text)


def test_pieces_without_bytes():
    c = pieces.Coder(pieces.Vocabulary(("<unk>", "▁a", "b", "▁"), (0.0, -1.0, -2.0, -3.0), "-nnn"))
    assert c.encode("ab z").tolist() == [1, 2, 3, 0]


@given(st.binary(max_size=400))
@settings(max_examples=100, deadline=None)
def test_pictures(data):
    p = media.payload(data)
    assert len(p) % 64 == 0 and len(p) >= 64 and p.startswith(data) and not p[len(data) :].strip(b"\0")
    image = media.picture(p)
    assert media.pixels(image) == p and media.metadata(image[: media.HEADER]) == (64, len(p) // 64, 8)


def test_broken_pictures():
    image = bytearray(media.picture(bytes(64)))
    image[20] ^= 1
    with pytest.raises(ValueError, match="PNG"):
        media.pixels(bytes(image))


def test_statistics():
    for text in (b"", b" ", b"\n\n", b"word", b"A B!! c | d", b"x" * 100_000, bytes(range(256))):
        x = quality.measure(text)
        assert x.shape == (len(quality.NAMES),) and np.isfinite(x).all()


def test_discriminant():
    rng = np.random.default_rng(0)
    a, b = rng.normal(0, 1, (400, 3)), rng.normal(1.5, 0.5, (600, 3))
    m = quality.discriminant([400.0, 600.0], [a.sum(0), b.sum(0)], [a.T @ a, b.T @ b], shrink=0.0, ridge=0.0)
    scores = m.scores(np.vstack([a, b]))
    assert ((scores > 0.5) == np.repeat([False, True], [400, 600])).mean() > 0.95
    own = [np.cov(x.T, bias=True) + 1e-6 * np.eye(3) for x in (a, b)]
    x = rng.normal(0, 1, 3)
    log = [np.log(n / 1000) - 0.5 * (np.linalg.slogdet(c)[1] + (x - y.mean(0)) @ np.linalg.inv(c) @ (x - y.mean(0))) for n, c, y in ((400, own[0], a), (600, own[1], b))]
    # With few rows the covariance leans on the pooled one, so only the order of magnitude is the textbook's.
    assert abs(np.log(m.scores(x[None])[0] / (1 - m.scores(x[None])[0])) - (log[1] - log[0])) < 0.5
    assert quality.discriminant([2.0, 1.0], [a.sum(0), b.sum(0)], [a.T @ a, b.T @ b]).scores(np.zeros((1, 3)))[0] == pytest.approx(0.4)


def test_quotes():
    text = "Hi\nX wrote:\n> > deep line\n> near line\n>more\nreply"
    assert quotes.passages(text) == [(0, ["Hi"]), (2, ["deep line"]), (1, ["near line", "more"]), (0, ["reply"])]
    assert quotes.own_text(text) == "Hi\nreply" and quotes.own_text("") == "" and quotes.units("") == []


def test_license_windows():
    s = licenses.Scanner(licenses.TEMPLATES)
    rnd = random.Random(3)
    for name, text in licenses.TEMPLATES.items():
        for _ in range(5):
            before = " ".join(f"w{rnd.randrange(999)}" for _ in range(rnd.randrange(400)))
            found = {m[0]: m for m in s.scan(f"{before} {text} tail words here".encode())}
            assert name in found and found[name][3] == 1.0
            words = plain_words(f"{before} {text}".encode())
            assert words[found[name][1] : found[name][2]] == plain_words(text.encode())
    assert s.scan(b"") == [] and s.scan(b"licensed under") == []
    with pytest.raises(ValueError, match="words"):
        licenses.Scanner({"x": "a " * (licenses.MAX_WORDS + 1)})


def test_digest_of_no_items():
    assert hashlib.sha256(b"").hexdigest() == decontaminate.digest(set())


def test_many_pairs_are_compared_like_each(monkeypatch):
    """Spans of pairs compared at once are those of each pair alone: changed, verbatim, moved, repeated, short and empty rows, within stretches of their texts."""
    rng = np.random.default_rng(8)
    base = [rng.integers(0, 1 << 63, 400, dtype=np.uint64) for _ in range(6)]
    texts = [np.zeros(0, np.uint64), base[0][:20], np.tile(base[1][:7], 60), np.concatenate([base[2][:60], base[3][:90], base[2][:60]])]
    for b in base:
        for share in (0, 0.03, 0.08, 0.12):
            t = np.where(rng.random(len(b)) < share, rng.integers(0, 1 << 63, len(b), dtype=np.uint64), b)
            texts += [t, np.concatenate([t[200:290], rng.integers(0, 1 << 63, 70, dtype=np.uint64), t[20:180], t[20:180]]), np.delete(t, slice(100, 109))]
    pairs = []
    for y in texts:
        for x in texts:
            pairs.append((x[int(rng.integers(0, 30)) : int(rng.integers(60, 420))], (y, int(rng.integers(0, 30)), int(rng.integers(60, 420)))))
    want = [passages.passages(x, y[i:j]) if len(x) and len(y[i:j]) else ([], []) for x, (y, i, j) in pairs]
    assert sum(bool(a and b) for a, b in want) > 200 and any(len(a) > 2 for a, _ in want)
    for at_once in (1 << 17, 3000):
        monkeypatch.setattr(passages, "_AT_ONCE", at_once)
        assert passages.compare([x for x, _ in pairs], [y for _, y in pairs]) == want


def test_passages_meet_at_the_rarest_shingle_they_share():
    rnd = np.random.default_rng(2)
    width = passages.WIDTH
    order = np.concatenate([rnd.integers(0, 1000, 150), rnd.integers(900, 1000, 200)]).astype(np.uint64)
    place, first, last = passages.rarest(order)
    reach = dict(zip(place.tolist(), zip(first.tolist(), last.tolist(), strict=True), strict=True))
    for n in range(width, 2 * width + 1):
        for a in range(0, len(order) - n + 1, 3):
            part = order[a : a + n]
            for at in np.flatnonzero((part[:, None] > part[None, :]).sum(1) <= n // 9).tolist():
                own = np.flatnonzero(part >= part[at]) + a
                if own[-1] - own[0] + 1 >= width:
                    assert reach[a + at][0] <= own[0] and reach[a + at][1] >= own[-1]
    assert 0 < len(place) < 300
    long = rnd.integers(0, 1 << 40, 20_000).astype(np.uint64)
    whole = passages._rarest(long, 2 * width + 8)
    assert all((a == b).all() for a, b in zip(passages.rarest(long), whole, strict=True))


def test_passages_never_meet_at_a_shingle_of_one_text():
    rnd = np.random.default_rng(4)
    for alone in (0.02, 0.08, 0.12):
        order = rnd.integers(1, 1 << 40, 9000).astype(np.uint64)
        order[rnd.random(9000) < alone] = 0
        order[3000:6000][rnd.random(3000) < 0.7] = 0
        place, first, last = passages.rarest(order)
        shared = order[place] > 0
        assert len(place) and all((a == b[shared]).all() for a, b in zip(passages.meeting(order), (place, first, last), strict=True))
    assert not any(len(x) for x in passages.meeting(np.zeros(500, np.uint64)))
    assert not any(len(x) for x in passages.meeting(np.ones(20, np.uint64)))
