"""Operators on texts against plain Python, with nulls, empties, long texts, ties, repeats and odd columns."""

import hashlib
import io
import random
import re
import tracemalloc
import wave
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from cadaspark.llm import exact_dedup, line_dedup, media, mixing, near_dedup, packing, quality, token_counts, token_files, toxicity
from cadaspark.llm.common import shared_dir
from cadaspark.llm.words import shingles, word_hashes

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, kept boolean"
LONG = " ".join(f"word{i % 977} it's" for i in range(20000))
TEXTS = [None, "", " \t\n", "Hello  world", "hello world", "Hello\tworld", "a", "It's 12 o'clock!!  \n\n we'll see <|endoftext|> x", "ß漢字 é😀 　x", LONG, LONG + " ", "\0\0a"]


def table(spark, texts=TEXTS, start=0):
    rows = [(i + start, t, "en", f"s{i % 3}" if i % 5 else None, 7, True) for i, t in enumerate(texts)]
    rows += [(None, "null id", None, None, None, None), (3, texts[3], "en", "s0", 7, True)]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="module")
def docs(spark):
    return table(spark).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(TOKENIZER)


def plain(rows):
    return [(r.doc_id, r.text or "") for r in rows.collect()]


def odd_texts(seed, n):
    rnd = random.Random(seed)
    letters = "abcdefrstlvemd''''   \n\t 　012٣!?$#中é😀<|endoftext|>"
    return ["".join(rnd.choice(letters) for _ in range(rnd.randrange(40))) for _ in range(n)] + [
        "".join(chr(rnd.choice([rnd.randrange(1, 0x250), rnd.randrange(0x250, 0xD7FF), rnd.randrange(0xE000, 0x110000)])) for _ in range(30)) for _ in range(n // 4)
    ]


def test_counting_quotient_filter_is_lossless():
    rng = np.random.default_rng(1)
    parts = [rng.integers(0, 50, 40, np.uint64) << np.uint64(rng.integers(0, 60)) for _ in range(9)]
    built = [exact_dedup.CountingQuotientFilter.build(p) for p in parts]
    merged = exact_dedup.CountingQuotientFilter.merge([exact_dedup.CountingQuotientFilter.load(f.dump()) for f in built])
    assert dict(zip(merged.prints().tolist(), merged.counts.tolist(), strict=True)) == Counter(np.concatenate(parts).tolist())


def test_exact_groups(docs, empty):
    got = exact_dedup.exact_groups(docs).collect()
    rows = plain(docs)
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]", "", t)
    groups = {}
    for i, t in rows:
        groups.setdefault(norm(t), []).append((-len(t), -1 if i is None else i, i))
    want = sorted((str(i), str(min(groups[norm(t)])[2]), len(groups[norm(t)]), min(groups[norm(t)])[2] == i, hashlib.sha256(norm(t).encode()).hexdigest()) for i, t in rows)
    assert sorted((str(r.doc_id), str(r.keep_id), r.group_size, r.kept, r.text_sha256) for r in got) == want
    assert exact_dedup.exact_groups(empty).count() == 0
    left = exact_dedup.drop_exact_copies(docs)
    assert left.columns == docs.columns
    assert sorted(norm(r.text or "") for r in left.collect()) == sorted(groups)
    assert exact_dedup.drop_exact_copies(empty).count() == 0


def test_token_counts(docs, empty, library):
    got = token_counts.token_counts(docs.withColumnRenamed("n_chars", "n_tokens"), TOKENIZER)
    assert got.columns[-3:] == ["n_bytes", "n_tokens", "over_limit"] and got.columns.count("n_tokens") == 1
    texts = [t for _, t in plain(docs)]
    want = Counter((len(t.encode()), len(library.encode(t, add_special_tokens=False).ids)) for t in texts)
    assert Counter((r.n_bytes, r.n_tokens) for r in got.collect()) == want
    assert token_counts.token_counts(empty, TOKENIZER).count() == 0


def test_transducer_equals_the_library(library):
    machine = token_counts.Transducer(TOKENIZER)
    texts = odd_texts(5, 1500) + ["a" * 5000, " " * 3000, "=-" * 3000, "x" * 700 + "\n" * 700]
    assert machine.counts(texts).tolist() == [len(e.ids) for e in library.encode_batch(texts, add_special_tokens=False)]
    assert machine.counts([]).tolist() == []


def test_token_files(spark, docs, empty, library):
    folder = shared_dir(spark, "test-files")
    manifest = token_files.write_token_files(docs, TOKENIZER, folder, sequence=64)
    rows = sorted(plain(docs), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    ids = [library.encode(t, add_special_tokens=False).ids + [0] for _, t in rows]
    got = sorted(token_files.read_token_files(spark, folder).collect(), key=lambda r: r.start)
    starts = np.cumsum([0, *map(len, ids)])[:-1].tolist()
    assert [(r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in got] == [(i, s, len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for (i, _), s, x in zip(rows, starts, ids, strict=True)]
    shard = manifest.orderBy("shard").first()
    first, mask = token_files.sequence_at(folder, shard["name"], 0)
    n = min(64, shard["n_tokens"])
    assert first[:n].tolist() == [i for x in ids for i in x][:n] and mask.sum() == n and len(first) == 64
    folder = shared_dir(spark, "test-files")
    assert token_files.write_token_files(empty, TOKENIZER, folder).count() == 0 and token_files.read_token_files(spark, folder).count() == 0


def test_media(docs, empty):
    stored = media.media_column(docs.select("doc_id", "text"))
    got = media.media_features(stored).collect()
    texts = {(i, t) for i, t in plain(docs)}
    for r in got:
        t = next(t for i, t in texts if i == r.doc_id and len(t.encode()) == r.n_bytes)
        payload = t.encode() + bytes(-len(t.encode()) % 64 or (64 if not t else 0))
        assert (r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        with wave.open(io.BytesIO(media.wav_bytes(payload))) as w:
            assert w.getsampwidth() == 1 and w.readframes(w.getnframes()) == payload
        assert len(r.times) == len(r.codes) and list(r.times) == sorted(r.times)
    assert media.media_features(media.media_column(empty)).count() == 0
    broken = docs.sparkSession.createDataFrame([(1, b"no wav"), (2, None)], "doc_id bigint, media binary")
    assert [r.payload_bytes for r in media.media_features(broken).collect()] == [None, None]


def test_media_of_a_long_text(spark):
    """Frames from 8192 on give pairs like others."""
    rnd = random.Random(5)
    text = "".join(chr(rnd.randrange(32, 127)) for _ in range(2 << 20))
    features = media.media_features(media.media_column(spark.createDataFrame([(1, text)], "doc_id bigint, text string")))
    row = features.select("times", "codes", media.feature().alias("feature")).first()
    assert max(row.times) > 8192
    pairs = ",".join(str(t * 65536 * 4 + c) for t, c in zip(row.times, row.codes, strict=True))
    assert row.feature == f"{len(row.codes)}:{hashlib.md5(pairs.encode()).hexdigest()}"


def test_fingerprints_find_a_shifted_passage():
    passage = bytes(random.Random(1).randrange(256) for _ in range(128 * 40))
    a = media.peak_pairs(*media.peaks(passage))
    b = media.peak_pairs(*media.peaks(bytes(128 * 10) + passage))
    shifted = set(zip((a[0] + 10).tolist(), a[1].tolist(), strict=True)) & set(zip(b[0].tolist(), b[1].tolist(), strict=True))
    assert len(shifted) > 0.8 * len(a[0])


def brute_components(rows, size, similarity):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = []
    for _, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", t.translate(lower))
        sets.append({tuple(w[k : k + size]) for k in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} if w else set())
    root = list(range(len(rows)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= similarity * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[find(k)] = min(least.get(find(k), i), i)
    return [(i, len(sets[k]), least.get(find(k)) if sets[k] else i) for k, (i, _) in enumerate(rows)]


def near_texts(seed=7):
    rnd = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    out = []
    for size in (5, 40, 160):
        base = [rnd.choice(words) for _ in range(size)]
        for edits in (0, 1, 2, 4, 6, 8, 10, 12, 14):
            for _ in range(4):
                copy = list(base)
                for _ in range(min(edits, size)):
                    copy[rnd.randrange(size)] = rnd.choice(words)
                out.append(" ".join(copy))
    return out


def test_near_groups(spark, docs, empty):
    for frame in (docs, table(spark, near_texts(), 100)):
        rows = plain(frame)
        got = near_dedup.near_groups(frame).collect()
        assert sorted(map(str, [(r.doc_id, r.n_shingles, r.component_id) for r in got])) == sorted(map(str, brute_components(rows, 4, 80)))
        assert all(r.kept == (r.doc_id == r.component_id) for r in got)
    assert near_dedup.near_groups(empty).count() == 0
    left = near_dedup.drop_near_copies(table(spark, near_texts(), 100), shingle=5)
    want = [i for i, _, c in brute_components(plain(table(spark, near_texts(), 100)), 5, 80) if i == c]
    assert sorted(map(str, (r.doc_id for r in left.collect()))) == sorted(map(str, want)) and left.columns == docs.columns


def test_residual_families_are_compared_in_blocks(spark, monkeypatch):
    """Points of a star that are only linked with each other are found, over block borders too."""
    monkeypatch.setattr(near_dedup, "BLOCK", 7)
    frame = table(spark, near_texts(11), 500)
    got = near_dedup.near_groups(frame).collect()
    assert sorted(map(str, [(r.doc_id, r.n_shingles, r.component_id) for r in got])) == sorted(map(str, brute_components(plain(frame), 4, 80)))


@pytest.mark.parametrize("most", [200_000, 150])
def test_components_of_a_path_a_star_and_random_edges(spark, monkeypatch, most):
    """Edges of one task are contracted at once; those of several need rounds of stars."""
    monkeypatch.setattr(near_dedup, "EDGES_A_TASK", most)
    rnd = random.Random(most)
    edges = [(i, i + 1) for i in range(-300, 0)] + [(1000, 1000 + k) for k in range(1, 400)] + [(rnd.randrange(5000, 5600), rnd.randrange(5000, 5600)) for _ in range(260)]
    rnd.shuffle(edges)
    near = {}
    for a, b in edges:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    want, seen = {}, set()
    for start in sorted(near):
        if start in seen:
            continue
        todo, seen = [start], seen | {start}
        while todo:
            node = todo.pop()
            want[node] = start
            todo += near[node] - seen
            seen |= near[node]
    got = near_dedup.components(spark.createDataFrame(edges, "a bigint, b bigint").repartition(8)).collect()
    alone = {n for n in near if near[n] == {n}}
    assert {r.node: r.component for r in got} == {n: c for n, c in want.items() if n not in alone} and len(got) == len(want) - len(alone)
    assert near_dedup.components(spark.createDataFrame([], "a bigint, b bigint")).isEmpty()


def test_signatures_estimate_the_similarity():
    rng = np.random.default_rng(2)
    for n in (6, 60, 2000):
        errors = []
        for _ in range(40):
            whole = np.unique(rng.integers(0, 1 << 63, n, np.uint64))
            a, b = whole[: int(0.9 * n)], whole[int(0.1 * n) :]
            s = near_dedup.signatures([a, b])
            errors.append((s[0] == s[1]).mean() - len(np.intersect1d(a, b)) / len(whole))
        assert abs(np.mean(errors)) < 0.06
    words, first = word_hashes(["A b c", "a B c d e"])
    assert len(shingles(words[first[0] : first[1]], 4)) == 1 and len(shingles(words[first[1] : first[2]], 4)) == 2


def test_shingles_tell_all_places_apart():
    for size in (5, 9):
        words = np.random.default_rng(size).integers(0, 1 << 63, size, np.uint64)
        for i in range(size):
            for j in range(i):
                swapped = words.copy()
                swapped[[i, j]] = words[[j, i]]
                assert shingles(words, size).tolist() != shingles(swapped, size).tolist()
        assert len({int(shingles(words[:n], size)[0]) for n in range(1, size + 1)}) == size


def test_packing(spark, empty):
    rng = np.random.default_rng(4)
    sizes = [None, 0, -3, 1, 4096, 4097, 20000, *rng.integers(1, 3000, 800).tolist()]
    frame = spark.createDataFrame([(i if i else None, n, "x") for i, n in enumerate(sizes)], "doc_id bigint, size bigint, piece string")
    got = packing.best_fit(frame, "size", window=256).toPandas()
    assert got["length"].sum() == sum(max(0, n or 0) for n in sizes) and got["doc_id"].isna().sum() == 1
    for _, b in got.groupby("bin_id"):
        used = b["length"].sum()
        cap = b["capacity"].iloc[0]
        assert used <= cap and cap == next(c for c in packing.LENGTHS if c >= used)
        ends = b.sort_values(["offset", "length"])
        assert (ends["offset"].to_numpy() == np.concatenate([[0], np.cumsum(ends["length"])[:-1]])).all()
    assert got["length"].sum() / got.groupby("bin_id")["capacity"].first().sum() > 0.95
    plan = packing.best_plan(np.array(sizes[7:300]), packing.LENGTHS)[3]
    assert all(plan <= packing.pack(np.array(sizes[7:300]), packing.LENGTHS, c)[3] for c in packing.LENGTHS)
    assert packing.best_fit(empty, "n_chars").count() == 0


def test_line_dedup(spark, docs, empty):
    rnd = random.Random(3)
    shared = "\n".join(f"shared line {i} {rnd.random()}" for i in range(12))
    texts = [None, "", "one\ntwo\n", *("\n".join([*(f"own {k} {i}" for i in range(k % 4)), shared, f"end {k}"]) for k in range(8)), "short\nshort\nshort"]
    frame = table(spark, texts)
    got = {(r.doc_id, r.n_lines): r for r in line_dedup.without_repeats(frame).collect()}
    lines = shared.split("\n")
    kept = Counter(x for r in got.values() for x in (r.text or "").split("\n") if x in set(lines))
    assert sum(1 for x in lines if kept[x] == 1) >= 6 and all(kept[x] >= 1 for x in lines)
    for r in got.values():
        assert r.n_lines - r.n_removed_lines == (0 if r.n_removed_lines == r.n_lines else len((r.text or "").split("\n")))
    assert line_dedup.without_repeats(frame).columns == [*frame.columns, "n_lines", "n_removed_lines"]
    assert line_dedup.without_repeats(empty).count() == 0


def test_line_dedup_removes_whole_passages(spark):
    """A passage with a chunk of its own goes to its first and last line, in every later copy, and no other line goes."""
    rnd = random.Random(9)
    word = lambda: "".join(rnd.choice("abcdefghij") for _ in range(9))
    passages = {size: [[f"{word()} {word()}" for _ in range(size)] for _ in range(12)] for size in (2, 3, 12, 40)}
    texts = ["\n".join(x for p in rnd.sample(passages[size], 12) for x in [*p, *(word() for _ in range(3))]) for size in passages for _ in range(4)]
    got = line_dedup.without_repeats(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")).collect()
    left = Counter(x for r in got for x in r.text.split("\n"))
    alone = Counter(x for t in texts for x in t.split("\n"))
    assert all(left[x] == 1 for x, n in alone.items() if n == 1) and all(left[x] >= 1 for x in alone)
    whole = {size: sum(all(left[x] == 1 for x in p) for p in ps) for size, ps in passages.items()}
    assert whole[12] >= 10 and whole[40] == 12, whole


def test_line_dedup_odd_rows(spark):
    """One id with two texts keeps a passage once; equal rows are treated alike; very long texts and clashing names pass."""
    shared = "\n".join(f"line {i} of the passage {i * 7919 % 1000}" for i in range(29))
    removed = {}
    for ids in ((1, 1), (1, 2)):
        frame = spark.createDataFrame([(ids[0], shared + "\nfirst end", 3), (ids[1], shared + "\nother end", 3)], "doc_id bigint, text string, hash int")
        out = line_dedup.without_repeats(frame)
        assert out.columns == ["doc_id", "text", "hash", "n_lines", "n_removed_lines"]
        removed[ids] = sorted(r.n_removed_lines for r in out.collect())
    assert removed[1, 1] == removed[1, 2] and removed[1, 2][0] == 0 and removed[1, 2][1] >= 29
    same = spark.createDataFrame([(1, shared), (1, shared)], "doc_id bigint, text string")
    assert [r.n_removed_lines for r in line_dedup.without_repeats(same).collect()] == [0, 0]
    long = "\n".join(f"{i} {i * 31 % 1009}" for i in range(60000))
    rows = spark.createDataFrame([(1, long), (2, "x\n" + long), (None, None)], "doc_id bigint, text string")
    got = {r.doc_id: (r.n_lines, r.n_removed_lines) for r in line_dedup.without_repeats(rows).collect()}
    assert got[1] == (60000, 0) and got[None] == (1, 0) and got[2][0] == 60001 and got[2][1] >= 59990


def lags(order, counts, weights, period):
    """The greatest deviation of a phase's prefix from its shares, in blocks."""
    seen, worst = Counter(), 0.0
    for t, s in enumerate(order, 1):
        seen[s] += 1
        worst = max(worst, *(abs(seen[k] - t * weights[k] / period) for k in weights))
    return worst


def test_mixing(spark, empty):
    rows = [(i, f"t{i}", "en", s, 1, True) for i, s in enumerate([*["big"] * 900, *["mid"] * 300, *["small"] * 60, *[None] * 17])]
    frame = spark.createDataFrame(rows, DOCS)
    weights = spark.createDataFrame([("big", 0.5), ("mid", 0.3), ("small", 0.15), (None, 0.05)], "source string, weight double")
    got = mixing.mixed(frame, weights=weights, block=1, period=100).toPandas()
    assert sorted(got["doc_id"]) == list(range(len(rows))) and sorted(got["__slot"]) == list(range(len(rows)))
    first = got[got["__phase"] == 0].sort_values("__slot")
    names = first["source"].fillna("-").tolist()
    share = Counter(names[:100])
    assert abs(share["big"] - 50) <= 2 and abs(share["mid"] - 30) <= 2 and abs(share["small"] - 15) <= 2 and abs(share["-"] - 5) <= 2
    assert lags(names, None, dict(share), 100) < 1
    assert mixing.mixed(empty).count() == 0
    again = mixing.mixture(frame)
    assert again.columns == frame.columns and again.count() == len(rows)
    with pytest.raises(ValueError):
        mixing.mixed(frame, period=3)


def flow_lag(got, weights):
    """The greatest deviation of any prefix from the fluid mixture of the given weights, in blocks."""
    blocks = Counter(got["source"])
    order = got.sort_values("slot")["source"].tolist()
    ends = sorted((blocks[s] / weights[s], s) for s in blocks)
    seen, worst, v, t, k = Counter(), 0.0, 0.0, 0, 0
    left = sum(weights[s] for s in blocks)
    for s in order:
        seen[s] += 1
        rest = 1.0  # the flow of one slot, over the ends of sources
        while k < len(ends) and (ends[k][0] - v) * left <= rest:
            rest -= (ends[k][0] - v) * left
            v, left, k = ends[k][0], left - weights[ends[k][1]], k + 1
        v += rest / left if k < len(ends) else 0
        worst = max(worst, *(abs(seen[x] - min(weights[x] * v, blocks[x])) for x in blocks))
    return worst


def test_mixing_keeps_the_given_weights(spark):
    """Every prefix of many periods is less than a block off the weights, which are no whole slots of a period."""
    for sources in (
        [("large", 4000, 4000**0.5), *((f"s{i:02}", 400, 400**0.5) for i in range(20))],
        [("rare", 3, 0.0001), ("a", 3000, 0.61803), ("b", 2500, 0.38187)],
        [("u", 700, 1.0), ("v", 700, 1.0), ("w", 350, 0.5), ("x", 1, 3.0)],
    ):
        weights = {s: w for s, _, w in sources}
        got = mixing.schedule(spark.createDataFrame(sources, "source string, blocks bigint, weight double")).toPandas()
        assert sorted(got["slot"]) == list(range(sum(n for _, n, _ in sources)))
        assert all(sorted(got[got["source"] == s].sort_values("slot")["block"]) == got[got["source"] == s].sort_values("slot")["block"].tolist() == list(range(n)) for s, n, _ in sources)
        assert flow_lag(got, weights) < 1 + 1e-6


def test_mixing_of_many_sources(spark):
    """More sources than slots of a period; the steps' length does not alter the order."""
    rows = [(i, f"t{i}", "en", f"s{i % 1500}" if i < 2400 else "s7", 1, True) for i in range(2600)]
    got = mixing.mixed(spark.createDataFrame(rows, DOCS), block=1).toPandas()
    assert sorted(got["doc_id"]) == list(range(2600)) and sorted(got["__slot"]) == list(range(2600))
    counts = Counter(got["source"])
    assert flow_lag(got.rename(columns={"__slot": "slot"}), {s: n**0.5 for s, n in counts.items()}) < 1 + 1e-6
    sources = spark.createDataFrame([(f"s{i:03}", 1 + i % 7, 1.0 + i % 5) for i in range(120)], "source string, blocks bigint, weight double")
    orders = [mixing.schedule(sources, step).orderBy("slot").toPandas()["source"].tolist() for step in (10, 1000)]
    assert orders[0] == orders[1]


def test_mixing_plans_stay_small(spark, empty, monkeypatch):
    """Blocks grow with the table; equal rows, null sources and clashing names pass, and the order holds."""
    monkeypatch.setattr(mixing, "MOST_BLOCKS", 20)
    rows = [(i % 50, "same", None if i % 7 == 0 else f"s{i % 3}", 5) for i in range(900)]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string, source string, __slot int")
    got = mixing.mixed(frame).toPandas()
    assert len(got) == 900 and got["__size"].unique().tolist() == [45] and got["__slot"].nunique() <= 24
    assert got.groupby(["__slot", "__place"]).size().max() == 1 and got.groupby("__slot")["source"].nunique(dropna=False).max() == 1
    out = mixing.mixture(frame)
    assert out.columns == frame.columns and out.exceptAll(frame).isEmpty() and out.count() == 900
    assert mixing.mixture(empty).count() == 0


def test_token_counter_stays_small():
    """A state and its pairs take less than 250 bytes: a worker holds hundreds of thousands of them."""
    machine, rng = token_counts.Transducer(TOKENIZER), np.random.default_rng(3)
    words = [rng.integers(97, 123, k).astype(np.uint8).tobytes() for k in rng.integers(3, 12, 4000)]
    tracemalloc.start()
    machine.walk(np.frombuffer(b"".join(words), np.uint8), np.cumsum([0, *map(len, words[:-1])]), np.array([len(w) for w in words]))
    machine.edges = {}
    snapshot = tracemalloc.take_snapshot().filter_traces([tracemalloc.Filter(True, token_counts.__file__)])
    tracemalloc.stop()
    held = sum(x.size for x in snapshot.statistics("filename")) - machine.steps.keys.nbytes - machine.steps.values.nbytes
    assert len(machine.states) > 5000 and held < 250 * len(machine.states)


def test_classifiers(spark, docs, empty):
    rnd = random.Random(6)
    words = [f"{a}{b}" for a in ("lo", "mi", "ta", "re") for b in ("no", "ka", "sel", "dun")]
    rows, marks = [], []
    for i in range(600):
        text = [rnd.choice(words) for _ in range(rnd.randrange(5, 120))]
        bad = i % 4 == 0
        if bad:
            text.insert(rnd.randrange(len(text)), "grobzok")
        rows.append((i, " ".join(text) if i % 3 or bad else " ".join(text).upper() + " !! $$$", "en", "s", 1, True))
        marks.append((i, int(not (i % 3 == 0 and not bad)), int(bad)))
    frame, labels = spark.createDataFrame(rows, DOCS), spark.createDataFrame([*marks, (None, 1, 1), (9999, None, None)], "doc_id bigint, quality int, toxic int")
    truth = {i: (q, t) for i, q, t in marks}
    for got, at, modulus, held in ((toxicity.toxicity(frame, labels), 1, 5, 0), (quality.quality(frame, labels), 0, 3, 1)):
        out = got.collect()
        assert len(out) == 600 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in out)
        assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % modulus == held) for r in out)
        tested = [r for r in out if r.held_out]
        assert sum(r.predicted == truth[r.doc_id][at] for r in tested) > 0.95 * len(tested)
    assert toxicity.toxicity(docs, labels).count() == docs.count()  # nulls, empty and long texts
    assert quality.quality(docs, labels).count() == docs.count()
    none = labels.filter("doc_id < 0")
    assert {r.predicted for r in toxicity.toxicity(docs, none).collect()} == {0}
    assert toxicity.toxicity(empty, labels).count() == 0 and quality.quality(empty, labels).count() == 0
    left = toxicity.drop_toxic(frame, labels)
    assert left.columns == frame.columns and sum("grobzok" in r.text for r in left.collect()) <= 3 and left.count() >= 440
