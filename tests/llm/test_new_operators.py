"""Conversation repair, URL filter and phrases against plain Python, with the cases that tables may hold."""

import hashlib
import itertools
import math
import random
import zlib
from collections import Counter, defaultdict

import pytest

from cadaspark.llm import conversations, phrases, url_filter

# ---- conversations


def damage(rows):
    """Rows (conv, turn, role, text) after damage, in order, by conversation."""
    out = defaultdict(list)
    for conv, turn, role, text in rows:
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        out[conv]
        if kind:
            text = "" if kind == 1 else text.translate({ord(c): None for c in ".!?"}) if kind == 2 else text
            out[conv] += [(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    return {c: sorted(v, key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode())) for c, v in out.items()}


def faults(rows):
    seen, out = set(), []
    for _, role, text in rows:
        shown = text.rstrip(" \t\n\x0b\x0c\r")
        out.append("blank" if not shown else "duplicate" if (role, text) in seen else "truncated" if shown[-1] not in ".!?" else None)
        seen.add((role, text))
    return out


def cheapest(rows, costs=conversations.EditCosts()):
    """(cost, audit, lines) of the cheapest edits, ties by the audit: every path of a plain search."""
    accepts = {0: {"s": 1, "u": 2}, 1: {"u": 2}, 2: {"a": 3}, 3: {"u": 2}}
    best = {(0, 0): (0, "", ())}
    marks = faults(rows)

    def offer(table, key, value):
        if key not in table or value < table[key]:
            table[key] = value
            return True
        return False

    for i in range(len(rows) + 1):
        todo = [k for k in best if k[0] == i]
        while todo:  # insertions
            at, q = todo.pop()
            for letter, to in accepts[q].items():
                cost, audit, lines = best[at, q]
                role = {"u": "user", "a": "assistant"}.get(letter)
                if role and offer(best, (at, to), (cost + costs.insert, audit + "I", (*lines, f"{role}:"))):
                    todo.append((at, to))
        if i == len(rows):
            break
        _, role, text = rows[i]
        extra = costs.truncated if marks[i] == "truncated" else 0
        for q in range(4):
            if (i, q) not in best:
                continue
            cost, audit, lines = best[i, q]
            offer(best, (i + 1, q), (cost + costs.delete, audit + "D", lines))
            if marks[i] in ("blank", "duplicate"):
                continue
            for letter, to in accepts[q].items():
                if role[:1] == letter:
                    offer(best, (i + 1, to), (cost + extra, audit + "K", (*lines, f"{role}:{text}")))
                if letter != "s":
                    name = "user" if letter == "u" else "assistant"
                    offer(best, (i + 1, to), (cost + extra + costs.rerole, audit + "R", (*lines, f"{name}:{text}")))
    return min(best[len(rows), q] for q in (0, 3) if (len(rows), q) in best)


def expected(rows):
    out = {}
    for conv, rs in damage(rows).items():
        turns = [t for t, _, _ in rs if t is not None]
        marks = Counter(faults(rs))
        initials = "".join(r[:1] or "-" for _, r, _ in rs)
        cost, audit, lines = cheapest(rs)
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(p not in ("su", "ua", "au") for p in map("".join, itertools.pairwise(initials)))
        out[conv] = (gaps, marks["blank"], marks["duplicate"], marks["truncated"], illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def random_rows(seed, convs, turns):
    rnd = random.Random(seed)
    rows = []
    for c in range(convs):
        for t in range(rnd.randrange(1, turns)):
            role = rnd.choice(["user", "assistant", "user", "assistant", "system", "tool", "Umpire", "", None])
            text = rnd.choice(["Yes.", "No!", "What?", "cut off", "", " \t", None, f"Turn {t}.", f"ends {t}\x0b\n", "x. \x1f"])
            rows.append((c if c else None, rnd.choice([t, t, t, 2 * t, None]), role, text))
    return rows + rows[:7]


CONV = "conv_id bigint, turn bigint, role string, text string, key string, pos bigint, n int"


def run_op11(spark, rows, tmp_path):
    spark.createDataFrame([(*r, "k", 1, 2) for r in rows], CONV).write.parquet(f"{tmp_path}/conversations.parquet")
    out = conversations.op11(spark, str(tmp_path)).collect()
    assert len(out) == len({r[0] for r in rows})
    return {r.conv_id: tuple(r)[1:] for r in out}


def test_conversations_equal_a_plain_search(spark, tmp_path):
    rows = random_rows(1, 60, 12)
    assert run_op11(spark, rows, tmp_path) == expected(rows)


def test_conversations_in_blocks_equal_the_whole(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(conversations, "BLOCK_BITS", 2)  # four rows a block
    monkeypatch.setattr(conversations, "AT_ONCE", 9)
    rows = [r for r in random_rows(2, 12, 40)]
    assert run_op11(spark, rows, tmp_path) == expected(rows)


def test_one_long_conversation_of_repeats(spark, tmp_path):
    rows = [(7, t % 900, "user" if t % 2 else "assistant", "ok." if t % 3 else f"Turn {t}.") for t in range(3000)]
    assert run_op11(spark, rows, tmp_path) == expected(rows)


def test_insertions_and_other_costs(spark):
    costs = conversations.EditCosts(rerole=7, delete=9, insert=2, truncated=1)
    rnd = random.Random(3)
    rows = [(c, t, rnd.choice(["user", "assistant", "system"]), f"Turn {t}" + rnd.choice([".", ""]), 1) for c in range(40) for t in range(rnd.randrange(1, 7))]
    table = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string, copies int")
    report, repaired = conversations.repaired_conversations(table, costs)
    lines = defaultdict(list)
    for r in repaired.orderBy("conv_id", "pos", "k").collect():
        lines[r.conv_id].append(f"{r.role}:{r.text}")
    got = {r.conv_id: (r.cost, r.audit, tuple(lines[r.conv_id])) for r in report.collect()}
    want = {c: cheapest([(t, r, x) for cc, t, r, x, _ in rows if cc == c], costs) for c in {r[0] for r in rows}}
    assert got == want
    assert any("I" in audit for _, audit, _ in want.values())


def test_conversations_of_empty_and_vanished_tables(spark, tmp_path):
    assert run_op11(spark, [], tmp_path / "none") == {}
    gone = next(t for t in range(1000) if zlib.crc32(f"5:{t}".encode()) % 20 == 0)
    nothing = hashlib.sha256(b"").hexdigest()
    assert run_op11(spark, [(5, gone, "user", "Hi.")], tmp_path / "gone") == {5: (0, 0, 0, 0, 0, 0, "", nothing)}


# ---- URLs

PAGES = "page_id bigint, url string, html string, verdict string, gram string, row int"


def plain_url(url):
    """host, path, rule and the rule's verdict by string methods."""
    host = path = ""
    if url and "://" in url:
        rest = url[url.index("://") + 3 :]
        end = min([rest.index(c) for c in "/?#" if c in rest] or [len(rest)])
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:end])
        path = rest[end:].split("?")[0].split("#")[0]
    fits = [r for r in url_filter.RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    r = max(fits, key=lambda r: len(r.host + r.path), default=None)
    return host, path, r and r.host + r.path, r and r.verdict


def plain_scores(urls):
    """Score of each URL by interpolation over dicts; decided URLs outside the fold train."""
    order = url_filter.ORDER
    counts = {"allow": Counter(), "block": Counter()}
    for u in urls:
        verdict = plain_url(u)[3]
        if verdict and zlib.crc32((u or "").encode()) % url_filter.FOLDS != url_filter.FOLD:
            p = url_filter.START * order + u + url_filter.END
            for i in range(order, len(p)):
                for k in range(order + 1):
                    counts[verdict][p[i - k : i], p[i]] += 1
    sums, kinds = {v: Counter() for v in counts}, {v: Counter() for v in counts}
    for v, c in counts.items():
        for (h, _), n in c.items():
            sums[v][h] += n
            kinds[v][h] += 1

    def p(v, h, c):
        below = p(v, h[1:], c) if h else 1 / 256
        return (counts[v][h, c] + kinds[v][h] * below) / (sums[v][h] + kinds[v][h]) if sums[v][h] else below

    out = {}
    for u in urls:
        x = url_filter.START * order + (u or "") + url_filter.END
        diffs = [math.log(p("allow", x[i - order : i], x[i]) / p("block", x[i - order : i], x[i])) for i in range(order, len(x))]
        out[u] = sum(diffs) / len(diffs)
    return out


def urls(seed, n):
    rnd = random.Random(seed)
    hosts = ["a.example.org", "example.org", "B.Example.COM", "com", "shop.net", "xorg", "m.org", "cheap.example.com", "u@h.com:80"]
    ways = ["", "/", "/es/", "/en/1", "/en/12", "/fr/a", "/de/x", "/fr", "/EN/1", "/de/y/z"]
    out = [f"{rnd.choice(['http', 'https', 'ftp', ''])}://{rnd.choice(hosts)}{rnd.choice(ways)}{rnd.choice(['', '?q=1', '#top', '?a=/fr/#x', '/é漢'])}" for _ in range(n)]
    return out + [None, "", "no scheme/de/", "://", "a://b://c.org/", "http://org?x", "http://x.org/\n/y", *out[:5]]


@pytest.mark.parametrize("most", [url_filter.BROADCAST_ROWS, 0])
def test_urls_equal_plain_python(spark, monkeypatch, most):
    monkeypatch.setattr(url_filter, "BROADCAST_ROWS", most)
    own = urls(4, 150)
    table = spark.createDataFrame([(i, u, "<html>", "x", "y", 3) for i, u in enumerate(own)], PAGES)
    got = {r.page_id: r for r in url_filter.judged_urls(table).collect()}
    want = plain_scores(own)
    assert len(got) == len(own)
    for i, u in enumerate(own):
        host, path, rule, verdict = plain_url(u)
        assert (got[i].host, got[i].path, got[i].rule) == (host, path, rule), u
        if rule:
            assert got[i].verdict == verdict
        else:
            assert got[i].score == pytest.approx(want[u], abs=1e-8)
            assert got[i].verdict == ("allow" if got[i].odds >= 0 else "block")


def test_models_tell_kept_out_urls(spark):
    """URLs of the fold, which train nothing, are told apart by what the rules' URLs look like."""
    rnd = random.Random(5)
    rules = (url_filter.Rule("allow", "good.org", "/"), url_filter.Rule("block", "bad.org", "/"))
    word = lambda s: "".join(rnd.choice(s) for _ in range(3))
    rows = [(i, f"http://{'good' if i % 2 else 'bad'}.org/{word(['read', 'news', 'book'] if i % 2 else ['pill', 'spin', 'luck'])}/{i}", "") for i in range(400)]
    rows += [(1000 + i, f"http://other.net/{word(['read', 'news', 'book'] if i % 2 else ['pill', 'spin', 'luck'])}/{i}", "") for i in range(60)]
    got = url_filter.judged_urls(spark.createDataFrame(rows, "page_id bigint, url string, html string"), rules=rules).filter("rule is null").collect()
    assert len(got) == 60
    assert sum(r.verdict == ("allow" if r.page_id % 2 else "block") for r in got) == 60


def test_urls_of_odd_tables(spark):
    empty = spark.createDataFrame([], PAGES)
    assert url_filter.judged_urls(empty).collect() == []
    alone = spark.createDataFrame([(1, None, None, None, None, None), (2, "x" * 30000, "", "", "", 1), (2, "x" * 30000, "", "", "", 1)], PAGES)
    got = url_filter.judged_urls(alone).collect()
    assert [(r.page_id, r.host, r.rule, r.score, r.verdict) for r in sorted(got, key=lambda r: r.page_id)] == [(1, "", None, 0.0, "allow")] + [(2, "", None, 0.0, "allow")] * 2


# ---- phrases

TEXT_ROWS = "doc_id bigint, text string, lang string, phrase string, n bigint, id int"


def plain_phrases(rows, least, longest=5):
    """lang, phrase -> (a, l, r, n, score) by counting every phrase."""
    counts, total = defaultdict(Counter), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for c in ".,;:!?\n\x0b\x0c\r":
            low = low.replace(c, "\n")
        for piece in low.split("\n"):
            words = [w for w in piece.replace("\t", " ").split(" ") if w]
            total[lang] += len(words)
            for m in range(1, longest + 1):
                counts[lang].update(tuple(words[i : i + m]) for i in range(len(words) - m + 1))
    out = {}
    for lang, c in counts.items():
        often = {p: a for p, a in c.items() if a >= least and len(p) > 1}
        inside = {(part, a) for p, a in often.items() for part in (p[:-1], p[1:])}
        for p, a in often.items():
            if (p, a) not in inside:
                score, k = min((1000 * a * total[lang] // (c[p[:k]] * c[p[k:]]), k) for k in range(1, len(p)))
                out[lang, " ".join(p)] = (a, c[p[:k]], c[p[k:]], total[lang], score)
    return out


def phrase_rows(seed, n):
    rnd = random.Random(seed)
    words = ["An", "an", "la", "ÉTÉ", "été", "x\u00a0y", "x.y", "b", "c"] + [f"w{i}" for i in range(30)]
    rows = [None, "", " \t", ".,;", "b " * 400, "one two three four five six. " * 30, "B\tc\x0bB c\u2028b c"]
    rows += [" ".join(rnd.choice(words[: rnd.choice([4, 39])]) + rnd.choice(["", "", "", ",", "\n", "\x0c"]) for _ in range(rnd.randrange(60))) for _ in range(n)]
    return [(t, rnd.choice(["fr", "fr", "de", None, "und"])) for t in rows]


@pytest.mark.parametrize("most, tiles, dense", [(phrases.BROADCAST_ROWS, phrases.TILES, phrases.DENSE), (0, 1, 20), (10**6, 2, 1)])
def test_phrases_equal_plain_counts(spark, monkeypatch, most, tiles, dense):
    monkeypatch.setattr(phrases, "BROADCAST_ROWS", most)
    monkeypatch.setattr(phrases, "TILES", tiles)
    monkeypatch.setattr(phrases, "DENSE", dense)
    monkeypatch.setattr(phrases, "SIDE_BITS", 3)
    monkeypatch.setattr(phrases, "SIDE", 8)
    monkeypatch.setattr(phrases, "HELD", 50)
    monkeypatch.setattr(phrases, "PART_BYTES", 2000)
    rows = phrase_rows(6, 120)
    table = spark.createDataFrame([(i % 50, t, lang, "p", 1, 2) for i, (t, lang) in enumerate(rows)], TEXT_ROWS)
    got = {(r["lang"], r["phrase"]): (r["a"], r["l"], r["r"], r["n"], r["score"]) for r in phrases.phrase_table(table, least=8).collect()}
    assert got == plain_phrases(rows, 8)
    assert len(got) > 20


def test_top_phrases_and_ties(spark):
    rows = [("fr", p, a, s) for p, a, s in [("b a", 9, 5), ("a b", 9, 5), ("é a", 9, 5), ("z z", 8, 5), ("q q", 1, 7)]]
    table = spark.createDataFrame(rows, "lang string, phrase string, a bigint, score bigint")
    got = [r.phrase for r in phrases.top_phrases(table, 4).orderBy("rank").collect()]
    assert got == ["q q", "a b", "b a", "é a"]


def test_products_beyond_64_bits(spark):
    big = 3_000_000_019
    row = spark.createDataFrame([(big, 10**13 + 37, [big + 1, big], [big + 2, big])], "a bigint, n bigint, f array<bigint>, g array<bigint>")
    out = row.select(phrases.cut_scores(*map(row.__getitem__, "anfg"), 2).alias("c")).first().c
    assert (out.score, out.k, out.l, out.r) == (1000 * big * (10**13 + 37) // ((big + 1) * (big + 2)), 1, big + 1, big + 2)


def test_phrases_of_an_empty_table(spark):
    assert phrases.phrase_table(spark.createDataFrame([], TEXT_ROWS)).collect() == []


# ---- column names and short passages

NAMES = ("keep", "rest", "__sha", "__norm", "__text", "__hash", "__row", "__id", "__key", "__print", "c0", "bytes", "n", "a", "lines")


def named_table(spark, texts):
    rows = [(i, t, *(f"{c} {i}" for c in NAMES)) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id bigint, text string, " + ", ".join(f"`{c}` string" for c in NAMES))


@pytest.mark.parametrize("name", ["exact", "lines", "tokens", "media", "features"])
def test_columns_of_any_name_stay(spark, name):
    import public_tokenizers

    from cadaspark.llm import exact_dedup, line_dedup, media, token_counts

    frame = named_table(spark, ["one\ntwo\nthree", "other text", None, "zero\none\ntwo\nthree"])
    run = {
        "exact": lambda: exact_dedup.drop_exact_copies(frame.unionByName(frame.filter("doc_id = 1"))),
        "lines": lambda: line_dedup.without_repeats(frame),
        "tokens": lambda: token_counts.token_counts(frame, public_tokenizers.path("byte_bpe_50k.json")),
        "media": lambda: media.media_column(frame),
        "features": lambda: media.media_features(media.media_column(frame)),
    }[name]
    rows = run().collect()
    assert len(rows) == 4
    for r in rows:
        assert all(r[c] == f"{c} {r.doc_id}" for c in NAMES)


def test_pipeline_stages_keep_columns_of_any_name(spark):
    import corpus_pipeline
    from cadaspark.llm.common import documents, stored
    from pyspark.sql import functions as F

    docs = documents(spark, "/root/testdata/sf0.001")
    docs = docs.select("*", *[F.concat(F.lit(f"{c} "), F.col("doc_id").cast("string")).alias(c) for c in NAMES])
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stored(stage(spark, docs, "/root/testdata/sf0.001"), "named-stage")
    rows = docs.collect()
    assert len(rows) > 100 and all(r[c] == f"{c} {r.doc_id}" for r in rows for c in NAMES)


def test_short_passages_go(spark):
    """Every later copy of a passage of 2, 3 or 12 lines goes, blank lines inside it included; other lines stay."""
    from cadaspark.llm import line_dedup

    rnd = random.Random(21)
    word = lambda: "".join(rnd.choice("abcdefghij") for _ in range(9))
    passages = [[f"{word()} {word()}" for _ in range(size)] for size in (2, 3, 12) for _ in range(10)] + [[word(), "", word()] for _ in range(5)]
    texts = ["\n".join(x for p in rnd.sample(passages, len(passages)) for x in [word(), *p, word()]) for _ in range(4)]
    got = line_dedup.without_repeats(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")).collect()
    left = Counter(x for r in got for x in r.text.split("\n") if x)
    assert all(n == 1 for n in left.values()) and set(left) == {x for t in texts for x in t.split("\n") if x}
    licence = "Permission is granted\nto use this text\nfor any purpose"
    docs = [(i, f"start {i}\n{licence}\nend {i}") for i in range(200)]
    out = line_dedup.without_repeats(spark.createDataFrame(docs, "doc_id bigint, text string")).agg({"n_removed_lines": "sum"}).first()
    assert out[0] == 597


def test_a_line_repeated_in_one_text(spark):
    from cadaspark.llm import line_dedup

    rows = spark.createDataFrame([(1, "\n".join(["again and again"] * 90)), (2, "x\nagain and again\ny")], "doc_id bigint, text string")
    got = {r.doc_id: r.text for r in line_dedup.without_repeats(rows).collect()}
    assert got == {1: "again and again\nagain and again", 2: "x\nagain and again\ny"}
