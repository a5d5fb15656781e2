"""Operators that SQL cannot express against plain loops over dicts and lists."""

import math
import random
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pytest

from cadaspark.llm import media, mixing, packing, quality, toxicity
from cadaspark.llm.words import mix


def sigmoid(x):
    return 1 / (1 + math.exp(-max(-35.0, min(35.0, x))))


def sample(seed, n, bad):
    rnd = random.Random(seed)
    syllables = ["lo", "mi", "ta", "re", "no", "ka", "sel", "dun"]
    texts, label = [], []
    for i in range(n):
        words = ["".join(rnd.choice(syllables) for _ in range(rnd.randrange(1, 4))) for _ in range(rnd.randrange(3, 30))]
        if y := int(rnd.random() < 0.4):
            words.insert(rnd.randrange(len(words)), rnd.choice(bad))
        texts.append(" ".join(words))
        label.append(y)
    return texts, np.array(label)


def character_grams(text):
    """Hashes of the distinct runs of 3 to 6 characters, by a loop over each run."""
    out, c = set(), f" {text.lower()} "
    for n in toxicity.SIZES:
        for i in range(len(c) - n + 1):
            h = 0
            for x in c[i : i + n]:
                h = (h * 0x01000193 + ord(x) + 1) % 2**32
            out.add(((h ^ h >> 15) * (0x2C1B3C6D + 2 * n)) % 2**32 >> 32 - toxicity.BITS)
    return out


def test_toxicity_weights_equal_a_plain_loop():
    texts, label = sample(1, 90, ["grobzok", "Snarfle!"])
    got = toxicity.fit(texts, label)
    grams = [sorted(character_grams(t)) for t in texts]
    assert [sorted(toxicity.NGrams().of(t).tolist()) for t in texts] == grams
    counts = [Counter(f for g, y in zip(grams, label, strict=True) if y == k for f in g) for k in (0, 1)]
    n = [int((label == k).sum()) for k in (0, 1)]
    ratio = {}
    for f in set(counts[0]) | set(counts[1]):
        if counts[0][f] + counts[1][f] >= toxicity.LEAST_DOCS:
            r = math.log(((counts[1][f] + toxicity.SMOOTH) / (n[1] + 2 * toxicity.SMOOTH)) / ((counts[0][f] + toxicity.SMOOTH) / (n[0] + 2 * toxicity.SMOOTH)))
            if r:
                ratio[f] = r
    weight, square, bias, bias_square = defaultdict(float), defaultdict(lambda: 1.0), 0.0, 1.0
    order = np.random.default_rng(7)
    for _ in range(toxicity.EPOCHS):
        for i in order.permutation(len(texts)):
            held = [f for f in grams[i] if f in ratio]
            g = sigmoid(bias + sum(weight[f] * ratio[f] for f in held)) - label[i]
            for f in held:
                step = g * ratio[f] + toxicity.DECAY * weight[f]
                square[f] += step * step
                weight[f] -= toxicity.RATE * step / math.sqrt(square[f]) / math.sqrt(max(1, len(held)))
            bias_square += g * g
            bias -= toxicity.RATE * g / math.sqrt(bias_square)
    want = np.zeros(toxicity.DIM + 1)
    for f, r in ratio.items():
        want[f] = weight[f] * r
    want[-1] = bias
    np.testing.assert_allclose(got, want, atol=2e-4)
    plain = [sigmoid(sum(want[f] for f in g) + bias) for g in grams]
    np.testing.assert_allclose(toxicity.score(texts, got), plain, atol=2e-3)
    assert toxicity.score(["", "x"], got).tolist() == pytest.approx([sigmoid(sum(want[f] for f in character_grams(t)) + bias) for t in ("", "x")], abs=1e-3)


def test_quality_weights_equal_a_plain_loop():
    texts, label = sample(2, 80, ["$$ 99%", "CLICK HERE!!"])
    got = quality.fit(texts, label)
    rows = []
    for t in texts:
        f, first = quality.features([t])
        words = first[1] - first[0]
        rows.append({int(k): quality.SCALE / max(1, words) * c for k, c in Counter(f.ravel().tolist()).items()})
    z, square, bias, bias_square = defaultdict(float), defaultdict(float), 0.0, 1.0

    def weight(f):
        if abs(z[f]) <= quality.LASSO:
            return 0.0
        return -(z[f] - math.copysign(quality.LASSO, z[f])) / ((quality.BETA + math.sqrt(square[f])) / quality.ALPHA + quality.RIDGE)

    pull = [len(label) / (2 * int((label == k).sum())) for k in (0, 1)]
    order = np.random.default_rng(7)
    for _ in range(quality.EPOCHS):
        for i in order.permutation(len(rows)):
            w = {f: weight(f) for f in rows[i]}
            g = (sigmoid(bias + sum(w[f] * x for f, x in rows[i].items())) - label[i]) * pull[label[i]]
            for f, x in rows[i].items():
                step = g * x
                z[f] += step - (math.sqrt(square[f] + step * step) - math.sqrt(square[f])) / quality.ALPHA * w[f]
                square[f] += step * step
            bias_square += g * g
            bias -= quality.ALPHA * g / math.sqrt(bias_square)
    want = np.zeros(quality.DIM + 1)
    for f in list(z):
        want[f] = weight(f)
    want[-1] = bias
    np.testing.assert_allclose(got, want, atol=2e-3)
    plain = [sigmoid(sum(want[f] * x for f, x in r.items()) + bias) for r in rows]
    np.testing.assert_allclose(quality.score(texts, got), plain, atol=3e-3)


def test_quality_features_are_words_pairs_and_shapes():
    """Hashed unigrams and bigrams of a text do not hang on the texts around it."""
    texts = ["Ab ab  12", "x", "", "x y x y"]
    together, first = quality.features(texts)
    for k, t in enumerate(texts):
        alone, _ = quality.features([t])
        assert (together[:, first[k] : first[k + 1]] == alone).all()
    f, _ = quality.features(["x y x y"])
    assert f[0, 0] == f[0, 2] and f[1, 1] == f[1, 3] and f[1, 0] != f[1, 2]
    assert int(mix(np.array([0], np.uint64))[0]) == 0


def edf(sources):
    """Earliest deadline first, slot by slot in exact fractions, over all phases: source of each slot."""
    total = sum(n for _, n, _ in sources)
    done, out, v = {s: 0 for s, _, _ in sources}, [], Fraction(0)
    left = {s: Fraction(w) for s, _, w in sources}
    size = {s: n for s, n, _ in sources}
    weight = dict(left)
    for _ in range(total):
        rest, here = Fraction(1), v
        while left and rest:
            s = min(left, key=lambda k: (Fraction(size[k]) / weight[k], k))
            need = (Fraction(size[s]) / weight[s] - here) * sum(left.values())
            if need <= rest:
                rest, here = rest - need, Fraction(size[s]) / weight[s]
                del left[s]
            else:
                here, rest = here + rest / sum(left.values()), Fraction(0)
        v = here
        released = [(Fraction(done[s] + 1) / weight[s], s) for s in size if done[s] < size[s] and Fraction(done[s]) < weight[s] * v]
        _, s = min(released)
        done[s] += 1
        out.append(s)
    return out


def test_schedule_equals_a_plain_loop(spark):
    for sources in ([("a", 40, 0.5), ("b", 25, 0.25), ("c", 9, 0.125), ("d", 2, 1.0)], [("p", 31, 3.0), ("q", 31, 3.0), ("r", 7, 0.5)], [("only", 5, 2.0)]):
        frame = spark.createDataFrame(sources, "source string, blocks bigint, weight double")
        got = [r.source for r in mixing.schedule(frame, 16).orderBy("slot").collect()]
        assert got == edf(sources)


def test_schedule_runs_frames_side_by_side(spark, monkeypatch):
    """Frames that begin in expected states, many of them wrong at first, give the order of one run."""
    monkeypatch.setattr(mixing, "FRAME", 12)
    for sources in (
        [("a", 40, 0.5), ("b", 25, 0.25), ("c", 9, 0.125), ("d", 2, 1.0)],
        [(f"s{i}", 3 + 5 * i % 17, float(1 + i * i % 7)) for i in range(11)],
    ):
        frame = spark.createDataFrame(sources, "source string, blocks bigint, weight double")
        rows = mixing.schedule(frame, 4).orderBy("slot").collect()
        assert [r.slot for r in rows] == list(range(sum(n for _, n, _ in sources)))
        assert [r.source for r in rows] == edf(sources)


def best_fit(sizes, lengths, prefer):
    """Best fit, bin by bin: longest pieces first, each to the bin that it leaves least room in."""
    bins, place, rest = [], {}, sum(sizes)
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        rest -= sizes[i]
        open_ = [(b["room"] - sizes[i], k) for k, b in enumerate(bins) if b["room"] >= sizes[i] and b["room"] > 0]
        if open_:
            k = min(open_)[1]
        else:
            fits = [c for c in lengths if c >= sizes[i]]
            room = min(fits, key=lambda c: (packing.cost(c) / max(1, min(c, sizes[i] + rest)), c)) if prefer is None else max(fits[0], prefer) if prefer >= sizes[i] else fits[0]
            bins.append({"room": room, "used": 0})
            k = len(bins) - 1
        place[i] = (k, bins[k]["used"])
        bins[k]["room"] -= sizes[i]
        bins[k]["used"] += sizes[i]
    final = [next(c for c in lengths if c >= b["used"]) for b in bins]
    return [place[i] for i in range(len(sizes))], final, sum(map(packing.cost, final))


def test_packing_equals_a_plain_loop():
    rng = np.random.default_rng(3)
    for sizes in (rng.integers(1, 4097, 60), rng.integers(1, 300, 200), np.array([4096, 1, 1, 2048, 2048, 512, 511, 1]), np.array([], np.int64), np.full(30, 700)):
        plans = []
        for prefer in (None, *packing.LENGTHS):
            bins, offsets, final, cost = packing.pack(sizes.astype(np.int64), packing.LENGTHS, prefer)
            want = best_fit(sizes.tolist(), packing.LENGTHS, prefer)
            assert list(zip(bins.tolist(), offsets.tolist(), strict=True)) == want[0] and final.tolist() == want[1] and cost == pytest.approx(want[2])
            plans.append(want[2])
        assert packing.best_plan(sizes.astype(np.int64), packing.LENGTHS)[3] == pytest.approx(min(plans))


def test_peaks_equal_a_direct_transform():
    rng = np.random.default_rng(4)
    samples = bytes(rng.integers(0, 256, 128 * 9 + 40).astype(np.uint8))
    x = np.frombuffer(samples, np.uint8).astype(float) - 128
    x = np.append(x, np.zeros(-(len(x) - media.WINDOW) % media.HOP))
    window = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(media.WINDOW) / (media.WINDOW - 1))
    want = []
    for t in range((len(x) - media.WINDOW) // media.HOP + 1):
        part = x[t * media.HOP : t * media.HOP + media.WINDOW] * window
        size = [abs(sum(part[k] * complex(math.cos(2 * math.pi * f * k / media.WINDOW), -math.sin(2 * math.pi * f * k / media.WINDOW)) for k in range(media.WINDOW))) for f in range(media.WINDOW // 2 + 1)]
        for a, b in media.BANDS:
            top = max(range(a, b), key=lambda f: size[f])
            if size[top] > media.LOUD * sum(size) / len(size):
                want.append((t, top))
    at, bins = media.peaks(samples)
    assert list(zip(at.tolist(), bins.tolist(), strict=True)) == want
    times, codes = media.peak_pairs(at, bins)
    near = [p for i, p in enumerate(want) for _ in (0,)]
    pairs = sorted((t, f << 10 | g << 2 | u - t) for i, (t, f) in enumerate(near) for j, (u, g) in enumerate(near) if 1 <= u - t <= media.REACH and 0 < j - i < len(media.BANDS) * (media.REACH + 1))
    assert list(zip(times.tolist(), codes.tolist(), strict=True)) == pairs
