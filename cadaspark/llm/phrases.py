"""Collocations: phrases of two to five words that occur more often than their parts let expect.

Frequent words get ids by rank of frequency, and the table of all pairs of ids is cut into square
tiles.  A task adds pairs of a crowded tile with a dense ``bincount`` over the tile's cells; pairs of
sparse tiles are kept as sorted coordinates with counts.  Spark sums the tasks' coordinates, and
pairs that are frequent enough are ranked and get ids in turn.  Pairs of neighbouring ids of that
level are phrases of three words, and so on: each level is the same job on shorter tables, since a
phrase can be frequent only where both its parts are.

Texts are read twice (to count words, then to write them as ids); later levels read ids alone.  Ids
of a level reach the tasks by broadcast while they are few, beyond that by a join on the distinct
pairs of a part of the corpus.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cadaspark.llm.common import documents, freed, groups, stored
from cadaspark.operators.numbering import ranked

LONGEST, LEAST, TOP = 5, 100, 2000
#: Side of a tile in ids, and places in a tile, in one batch, from which it is counted densely.
SIDE_BITS, DENSE = 10, 4096
SIDE = 1 << SIDE_BITS
#: Dense tiles (8 MB each) and coordinates (16 bytes each) that a task holds at once.
TILES, HELD = 6, 2_000_000
#: UTF-8 bytes of texts that are coded together, and ids that stand in a row of the coded corpus.
PART_BYTES = 1 << 22
#: Ids of a level (about 24 bytes each) that may be broadcast; more are joined.
BROADCAST_ROWS = 1_000_000

_GAP, _CUT = np.zeros(256, bool), np.zeros(256, bool)
_GAP[[0x20, 9]] = True
_CUT[[*b".,;:!?", 10, 11, 12, 13]] = True


def coded(texts: list[str]) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Distinct words of the texts, the word at each place, and whether a place begins a piece."""
    joined = np.frombuffer("\n".join(texts).encode().lower() + b"\n", np.uint8)  # bytes.lower changes A-Z alone
    cut = _CUT[joined]
    ink = ~(cut | _GAP[joined])
    begins = np.flatnonzero(ink & np.append(True, ~ink[:-1]))
    ends = np.flatnonzero(ink & np.append(~ink[1:], True)) + 1
    pieces = np.cumsum(cut, dtype=np.int32)[begins]
    data = joined[ink]
    offsets = np.append(0, np.cumsum(ends - begins)).astype(np.int64)
    words = pa.LargeStringArray.from_buffers(len(begins), pa.py_buffer(offsets), pa.py_buffer(data)).dictionary_encode()
    starts = np.append(True, pieces[1:] != pieces[:-1])[: len(begins)]
    return words.dictionary, words.indices.to_numpy(), starts


def language_parts(batch: pa.RecordBatch) -> Iterator[tuple[str, list[str]]]:
    """Texts of a batch by language, a part of each at a time."""
    for part in groups(batch, most=PART_BYTES):
        langs, texts = part.column("lang").to_pylist(), part.column("text").to_pylist()
        for lang in sorted(set(langs)):
            yield lang, [t for t, x in zip(texts, langs, strict=True) if x == lang]


def word_counts(rows: DataFrame) -> DataFrame:
    """lang, word, n of all words."""

    @freed
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lang, texts in language_parts(batch):
                words, places, _ = coded(texts)
                n = np.bincount(places, minlength=len(words))
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(words), pa.string()), words.cast(pa.string()), pa.array(n)], names=["lang", "word", "n"])

    return rows.mapInArrow(count, "lang string, word string, n bigint").groupBy("lang", "word").agg(F.sum("n").alias("n"))


class Tiles:
    """Counts of pairs of ids of one language: dense tiles, and sorted coordinates for the rest."""

    def __init__(self) -> None:
        self.dense: dict[tuple[str, int], np.ndarray] = {}
        self.sparse: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}
        self.size = 0

    def add(self, lang: str, left: np.ndarray, right: np.ndarray) -> Iterator[pa.RecordBatch]:
        """Counts pairs; yields what no longer fits."""
        tile = (left >> SIDE_BITS) << 32 | (right >> SIDE_BITS)
        order = np.argsort(tile, kind="stable")
        cuts = np.flatnonzero(np.diff(tile[order], prepend=-1, append=-1))
        rest = np.ones(len(left), bool)
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            key = (lang, int(tile[order[a]]))
            if b - a < DENSE and key not in self.dense:
                continue
            if key not in self.dense:
                if len(self.dense) >= TILES:
                    continue
                self.dense[key] = np.zeros(SIDE * SIDE, np.int64)
            own = order[a:b]
            cell = (left[own] & (SIDE - 1)) << SIDE_BITS | (right[own] & (SIDE - 1))
            self.dense[key] += np.bincount(cell, minlength=SIDE * SIDE)
            rest[own] = False
        keys, n = np.unique(left[rest] << 32 | right[rest], return_counts=True)
        self.sparse.setdefault(lang, []).append((keys, n))
        self.size += len(keys)
        if self.size > HELD:
            yield from self.flush_sparse()

    def flush_sparse(self) -> Iterator[pa.RecordBatch]:
        for lang, parts in self.sparse.items():
            keys = np.concatenate([k for k, _ in parts])
            order = np.argsort(keys, kind="stable")
            keys, n = keys[order], np.concatenate([n for _, n in parts])[order]
            first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.intp)
            if len(first):
                yield from rows_of(lang, keys[first], np.add.reduceat(n, first))
        self.sparse, self.size = {}, 0

    def flush(self) -> Iterator[pa.RecordBatch]:
        yield from self.flush_sparse()
        for (lang, tile), cells in self.dense.items():
            at = np.flatnonzero(cells)
            left = (tile >> 32 << SIDE_BITS) + (at >> SIDE_BITS)
            right = ((tile & 0xFFFFFFFF) << SIDE_BITS) + (at & (SIDE - 1))
            yield from rows_of(lang, left << 32 | right, cells[at])
        self.dense = {}


def rows_of(lang: str, keys: np.ndarray, n: np.ndarray, at_once: int = 100_000) -> Iterator[pa.RecordBatch]:
    for i in range(0, len(keys), at_once):
        k = keys[i : i + at_once]
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(k), pa.string()), pa.array(k), pa.array(n[i : i + at_once])], names=["lang", "pair", "n"])


def pairs_of(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places where an id and the next are both known, and their pairs (left id in the high bits)."""
    at = np.flatnonzero((ids[:-1] >= 0) & (ids[1:] >= 0))
    return at, ids[at] << 32 | ids[at + 1]


def ids_of(row: bytes) -> np.ndarray:
    return np.frombuffer(row, np.int32).astype(np.int64)


def packed(ids: np.ndarray) -> bytes:
    """Ids as bytes; of unknown ones (-1) only those that part known ones stay."""
    known = ids >= 0
    return ids[known | np.append(known[1:], False)].astype(np.int32).tobytes()


def pair_counts(level: DataFrame) -> DataFrame:
    """lang, pair, n of neighbouring ids in ``level`` (lang, ids)."""

    @freed
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tiles = Tiles()
        for batch in batches:
            for lang, ids in zip(batch.column("lang").to_pylist(), batch.column("ids").to_pylist(), strict=True):
                _, pairs = pairs_of(ids_of(ids))
                yield from tiles.add(lang, pairs >> 32, pairs & 0xFFFFFFFF)
        yield from tiles.flush()

    return level.select("lang", "ids").mapInArrow(count, "lang string, pair bigint, n bigint").groupBy("lang", "pair").agg(F.sum("n").alias("n"))


def numbered(counts: DataFrame, item: str, least: int, name: str) -> DataFrame:
    """Items that occur ``least`` times or more, with ``id``: their rank by frequency within the language, from 0."""
    often = stored(counts.filter(F.col("n") >= least), f"{name}-often")
    out = ranked(often, "lang", [F.desc("n"), F.col(item)], "id", -F.col("n"))
    return stored(out.select("lang", item, "n", (F.col("id") - 1).cast("bigint").alias("id")), name)


def known_items(level: DataFrame, item: str) -> dict[str, tuple[pa.Array | np.ndarray, np.ndarray]] | None:
    """Items (sorted, if pairs) and ids by language, or none where they are too many to broadcast."""
    if level.count() > BROADCAST_ROWS:
        return None
    table = level.select("lang", item, "id").toArrow().combine_chunks()  # BROADCAST_ROWS at most
    out, langs = {}, np.array(table.column("lang").to_pylist(), object)
    for lang in sorted(set(langs)):
        own = table.filter(pa.array(langs == lang))
        values, ids = own.column(item).combine_chunks(), own.column("id").to_numpy()
        if item == "pair":
            values = values.to_numpy()
            order = np.argsort(values)
            values, ids = values[order], ids[order]
        out[lang] = (values, ids)
    return out


def looked_up(pairs: np.ndarray, known: tuple[np.ndarray, np.ndarray] | None) -> np.ndarray:
    """The id of each pair, -1 where it has none."""
    if known is None or not len(known[0]):
        return np.full(len(pairs), -1, np.int64)
    at = np.minimum(np.searchsorted(known[0], pairs), len(known[0]) - 1)
    return np.where(known[0][at] == pairs, known[1][at], -1)


def word_ids(words: pa.Array, known: tuple[pa.Array, np.ndarray] | None) -> np.ndarray:
    if known is None:
        return np.full(len(words), -1, np.int64)
    import pyarrow.compute as pc

    at = pc.fill_null(pc.index_in(words.cast(pa.string()), value_set=known[0]), -1).to_numpy(zero_copy_only=False).astype(np.int64)
    return np.where(at >= 0, known[1][at], -1)


def spaced(ids: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """``ids`` with a -1 before each piece, so that no pair reaches over a border."""
    at = np.flatnonzero(starts)
    return np.insert(ids, at, -1) if len(at) else ids


def level_of_words(rows: DataFrame, level: DataFrame) -> DataFrame:
    """lang, ids: the corpus with its words as ids (4 bytes each)."""
    known = known_items(level, "word")
    if known is not None:
        shared = rows.sparkSession.sparkContext.broadcast(known)

        @freed
        def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for lang, texts in language_parts(batch):
                    words, places, starts = coded(texts)
                    ids = word_ids(words, shared.value.get(lang))
                    yield pa.RecordBatch.from_arrays([pa.array([lang]), pa.array([packed(spaced(ids[places] if len(places) else places.astype(np.int64), starts))], pa.binary())], names=["lang", "ids"])

        return rows.mapInArrow(code, "lang string, ids binary")

    @freed
    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lang, texts in language_parts(batch):
                words, places, starts = coded(texts)
                at = spaced(places.astype(np.int64), starts)
                yield pa.RecordBatch.from_arrays([pa.array([lang]), pa.array([words.to_pylist()], pa.list_(pa.string())), pa.array([at.astype(np.int32).tobytes()], pa.binary())], names=["lang", "items", "ids"])

    return renumbered(rows.mapInArrow(local, "lang string, items array<string>, ids binary"), level, "word")


def level_of_pairs(before: DataFrame, level: DataFrame) -> DataFrame:
    """lang, ids: neighbouring ids of ``before`` as ids of pairs, at the place of the left one."""
    known = known_items(level, "pair")
    if known is not None:
        shared = before.sparkSession.sparkContext.broadcast(known)

        @freed
        def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for lang, row in zip(batch.column("lang").to_pylist(), batch.column("ids").to_pylist(), strict=True):
                    ids = ids_of(row)
                    at, pairs = pairs_of(ids)
                    out = np.full(len(ids), -1, np.int64)
                    out[at] = looked_up(pairs, shared.value.get(lang))
                    yield pa.RecordBatch.from_arrays([pa.array([lang]), pa.array([packed(out)], pa.binary())], names=["lang", "ids"])

        return before.select("lang", "ids").mapInArrow(code, "lang string, ids binary")

    @freed
    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lang, row in zip(batch.column("lang").to_pylist(), batch.column("ids").to_pylist(), strict=True):
                ids = ids_of(row)
                at, pairs = pairs_of(ids)
                items, codes = np.unique(pairs, return_inverse=True)
                out = np.full(len(ids), -1, np.int64)
                out[at] = codes
                yield pa.RecordBatch.from_arrays([pa.array([lang]), pa.array([items], pa.list_(pa.int64())), pa.array([out.astype(np.int32).tobytes()], pa.binary())], names=["lang", "items", "ids"])

    return renumbered(before.select("lang", "ids").mapInArrow(local, "lang string, items array<bigint>, ids binary"), level, "pair")


def renumbered(parts: DataFrame, level: DataFrame, item: str) -> DataFrame:
    """Parts of the corpus that name items by their place in a list of their own, with the level's ids in place.

    Each part's distinct items are joined with the level, so nothing but one part is ever held whole.
    """
    parts = stored(parts.withColumn("part", F.monotonically_increasing_id()), "phrase-parts")
    met = parts.select("part", "lang", F.posexplode("items").alias("code", item)).join(level.select("lang", item, "id"), ["lang", item])
    found = met.groupBy("part").agg(F.collect_list(F.struct("code", "id")).alias("found"))  # a part's distinct items at most

    @freed
    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lang, size, row, pairs in zip(*(batch.column(c).to_pylist() for c in ("lang", "size", "ids", "found")), strict=True):
                to = np.full(size + 1, -1, np.int64)  # the last one stands for -1
                for p in pairs or ():
                    to[p["code"]] = p["id"]
                yield pa.RecordBatch.from_arrays([pa.array([lang]), pa.array([packed(to[np.frombuffer(row, np.int32)])], pa.binary())], names=["lang", "ids"])

    whole = parts.select("part", "lang", F.size("items").alias("size"), "ids").join(found, "part", "left")
    return whole.select("lang", "size", "ids", "found").mapInArrow(code, "lang string, ids binary")


def cut_scores(a: Column, n: Column, firsts: Column, lasts: Column, size: int) -> Column:
    """The least of floor(1000 a n / (l r)) over all cuts with its k, l and r; exact to 38 digits."""
    big = lambda c: c.cast("decimal(19,0)")
    cuts = []
    for k in range(1, size):
        left, right = firsts[k - 1], lasts[size - k - 1]
        top = (big(F.lit(1000)) * big(a)).cast("decimal(22,0)") * n.cast("decimal(16,0)")
        score = F.call_function("div", top, (big(left) * big(right)).cast("decimal(38,0)"))
        cuts.append(F.struct(score.alias("score"), F.lit(k).alias("k"), left.alias("l"), right.alias("r")))
    return F.least(*cuts) if len(cuts) > 1 else cuts[0]


def phrase_table(docs: DataFrame, lang: str = "lang", text: str = "text", longest: int = LONGEST, least: int = LEAST) -> DataFrame:
    """Phrases of 2 to ``longest`` words that occur ``least`` times or more: lang, phrase, a, l, r, n, score, cut.

    A-Z are lower-cased; ``[.,;:!?\\x0A-\\x0D]`` part pieces and ``[\\x20\\x09]`` words.  All counts
    are those of a language (null: ``und``): ``a`` of the phrase, ``n`` of all words, ``l`` and ``r`` of
    the two parts of the cut with the least score (ties: the shortest first part).  Phrases inside a
    longer one that occurs as often are left out.  Null and empty texts have no words; very long texts
    are counted whole; repeated rows count each time; an empty table gives an empty result; other
    columns are not read, whatever their names.
    """
    rows = docs.select(F.coalesce(docs[lang].cast("string"), F.lit("und")).alias("lang"), F.coalesce(docs[text], F.lit("")).alias("text"))
    words = stored(word_counts(rows), "phrase-words")
    totals = stored(words.groupBy("lang").agg(F.sum("n").alias("total")), "phrase-totals")
    level = numbered(words, "word", least, "phrase-level-1")
    corpus = stored(level_of_words(rows, level), "phrase-ids-1")
    counts = F.array("n")
    items = level.select("lang", "id", F.col("word").alias("phrase"), F.col("word").alias("last"), "n", counts.alias("firsts"), counts.alias("lasts"))
    found = []
    for size in range(2, longest + 1):
        level = numbered(pair_counts(corpus), "pair", least, f"phrase-level-{size}")
        if size < longest:
            corpus = stored(level_of_pairs(corpus, level), f"phrase-ids-{size}")
        ends = level.select("lang", "id", "n", F.shiftright("pair", 32).alias("left"), F.col("pair").bitwiseAND(0xFFFFFFFF).alias("right"))
        left = items.select("lang", F.col("id").alias("left"), F.col("phrase").alias("head"), F.col("firsts").alias("left_firsts"))
        right = items.select("lang", F.col("id").alias("right"), "last", F.col("lasts").alias("right_lasts"))
        whole = ends.join(left, ["lang", "left"]).join(right, ["lang", "right"])
        # a part that occurs as often as the whole is left out
        inside = ends.select("lang", F.explode(F.array("left", "right")).alias("id"), "n").distinct().withColumn("inside", F.lit(True))
        if size > 2:
            found.append(items.join(inside, ["lang", "id", "n"], "left").filter("inside is null").select("lang", "phrase", "n", "firsts", "lasts", F.lit(size - 1).alias("size")))
        items = whole.select(
            "lang", "id", F.concat_ws(" ", "head", "last").alias("phrase"), "last", "n",
            F.concat("left_firsts", F.array("n")).alias("firsts"), F.concat("right_lasts", F.array("n")).alias("lasts"),
        )
        items = stored(items, f"phrase-items-{size}")
    found.append(items.select("lang", "phrase", "n", "firsts", "lasts", F.lit(longest).alias("size")))
    every = reduce(DataFrame.unionByName, found).join(totals, "lang")
    cut = F.lit(None).cast("struct<score: bigint, k: int, l: bigint, r: bigint>")
    for size in range(2, longest + 1):
        cut = F.when(F.col("size") == size, cut_scores(F.col("n"), F.col("total"), F.col("firsts"), F.col("lasts"), size)).otherwise(cut)
    return every.withColumn("cut", cut).select(
        "lang", "phrase", F.col("n").alias("a"), F.col("cut.l").alias("l"), F.col("cut.r").alias("r"),
        F.col("total").alias("n"), F.col("cut.score").alias("score"), F.col("cut.k").alias("cut"),
    )


def top_phrases(phrases: DataFrame, top: int = TOP) -> DataFrame:
    """The first ``top`` phrases of each language by score, then frequency, then their bytes: ``rank`` from 1."""
    order = W.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    return phrases.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)  # tasks send their own first ones alone


def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = top_phrases(phrase_table(documents(spark, sf_dir)))
    return out.select("lang", F.col("rank").cast("bigint").alias("rank"), "phrase", "a", "l", "r", "n", "score")


OP13_SQL = f"""
with p as (
  select coalesce(lang, 'und') as lang, doc_id, t, regexp_extract_all(piece, '[^ \\t]+') as w
  from (select lang, doc_id, unnest(regexp_split_to_array(translate(coalesce(text, ''), '{"ABCDEFGHIJKLMNOPQRSTUVWXYZ"}', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) as piece,
               1 as t from documents)),
total as (select lang, sum(len(w))::bigint as n from p group by lang),
g as (select lang, unnest(flatten(list_transform(range(1, {LONGEST + 1}), lambda m: list_transform(range(1, len(w) - m + 2), lambda i: w[i:i + m - 1])))) as ws from p),
f as (select lang, ws, count(*) as a from g group by lang, ws having count(*) >= {LEAST}),
c as (select f.*, k from f, unnest(generate_series(1, {LONGEST - 1})) as u(k) where k < len(ws)),
s as (select c.lang, c.ws, c.a, x.a as l, y.a as r, total.n, k, ((1000::hugeint * c.a * total.n) // (x.a::hugeint * y.a)) as score
  from c join f x on x.lang = c.lang and x.ws = c.ws[1:k] join f y on y.lang = c.lang and y.ws = c.ws[k + 1:len(c.ws)] join total on total.lang = c.lang),
b as (select * from s qualify row_number() over (partition by lang, ws order by score, k) = 1),
i as (select lang, ws[1:len(ws) - 1] as ws, a from f where len(ws) > 1 union select lang, ws[2:len(ws)], a from f where len(ws) > 1)
select lang, rank, phrase, a, l, r, n, score from (
  select lang, row_number() over (partition by lang order by score desc, a desc, phrase) as rank, phrase, a, l, r, n, score
  from (select lang, array_to_string(ws, ' ') as phrase, a, l, r, n, score::bigint as score from b anti join i using (lang, ws, a)))
where rank <= {TOP}
"""
