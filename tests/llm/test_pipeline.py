"""The pipeline's stages and the thin queries on the smallest tables."""

from collections import Counter

import duckdb
import pytest

import corpus_pipeline
from cadaspark.llm import mixing, packing, queries
from cadaspark.llm.common import documents, stored

SF = "/root/testdata/sf0.001"


def test_stages_keep_the_columns_and_take_effect(spark):
    docs = documents(spark, SF)
    names, sizes = docs.columns, [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stored(stage(spark, docs, SF), "test-stage")
        assert docs.columns == names
        sizes.append(docs.count())
    assert sizes[0] > sizes[1] > sizes[2] >= sizes[3] == sizes[4] > 0.8 * sizes[0]
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert packed.select("doc_id").distinct().count() == sizes[-1]


def test_packing_follows_the_mixture(spark, monkeypatch):
    """Bins ascend with the slots, however the mixed table's files are read."""
    monkeypatch.setattr(packing.best_fit, "__defaults__", (*packing.best_fit.__defaults__[:2], 64, ()))  # small windows
    docs = stored(documents(spark, SF).repartition(7), "test-mixed")
    slots = {r.doc_id: (r["__slot"], r["__place"]) for r in mixing.mixed(docs).collect()}
    files = stored(mixing.mixture(docs).repartition(5), "test-files")  # reread in any order
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # several partitions of a small table
    try:
        packed = corpus_pipeline.STAGES[-1][1](spark, files, SF).toPandas()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert packed["doc_id"].nunique() == len(slots)
    packed["at"] = packed["doc_id"].map(slots)
    firsts = packed.groupby("bin_id")["at"].min().sort_index().tolist()
    # the bins of a window follow one another by their first rows, and windows by theirs
    whole = packed.sort_values(["at", "piece"]).reset_index(drop=True)
    assert len(firsts) > 64 and packed["bin_id"].map(lambda x: x >> 40).nunique() > 1
    rank = whole["bin_id"].rank(method="dense")
    assert all(whole["at"][i] >= firsts[int(k) - 1] for i, k in enumerate(rank))
    parts = whole["bin_id"].map(lambda x: x >> 40)
    assert parts.is_monotonic_increasing
    for _, rows in whole.groupby(parts):
        windows = [rows["bin_id"][k : k + 64] for k in range(0, len(rows), 64)]
        assert all(a.max() < b.min() for a, b in zip(windows, windows[1:]))
        assert all(w.drop_duplicates().is_monotonic_increasing for w in windows)


def test_packing_has_the_order_that_mixing_gave(spark, monkeypatch):
    """Other weights of the mixture give other bins; without a mixture rows are packed where they lie."""
    monkeypatch.setattr(packing.best_fit, "__defaults__", (*packing.best_fit.__defaults__[:2], 64, ()))  # small windows
    rows = [(i, f"text {i}", "one" if i % 2 else "two") for i in range(400)] + [(7, "text 7", "one")] * 3
    docs = stored(spark.createDataFrame(rows, "doc_id bigint, text string, source string"), "test-rows")
    weights = spark.createDataFrame([("one", 1000.0), ("two", 1.0)], "source string, weight double")
    files = stored(mixing.mixture(docs, weights=weights).repartition(3), "test-files")
    got = corpus_pipeline.pack(spark, files, SF).toPandas()
    slots = {r.doc_id: r["__slot"] for r in mixing.mixed(docs, weights=weights).collect() if r.doc_id != 7}
    assert len(got) == 403 and (got["doc_id"] == 7).sum() == 4
    got = got[got["doc_id"] != 7].sort_values(["bin_id", "offset"])
    bins = got.assign(slot=got["doc_id"].map(slots)).groupby("bin_id")["slot"].min()
    assert bins.is_monotonic_increasing
    odd = got.groupby("bin_id", sort=True)["doc_id"].apply(lambda x: (x % 2).mean()).tolist()
    assert odd[0] == 1.0 and odd[-1] == 0.0
    assert mixing.order_of(docs) is None and corpus_pipeline.pack(spark, docs, SF).count() == 403


def test_mixing_has_no_switch_by_size(spark, monkeypatch, tmp_path):
    """op7's order does not depend on how many blocks or bucketed rows count as many."""
    spark.createDataFrame([(i, f"s{i % 7 % 3}") for i in range(900)], "doc_id bigint, source string").write.parquet(f"{tmp_path}/documents.parquet")
    rows = lambda: sorted(map(tuple, mixing.op7(spark, str(tmp_path)).collect()))
    want = rows()
    assert len(want) == 900 and max(Counter(r[3] for r in want).values()) == 16
    for name, value in (("MOST_BLOCKS", 20), ("BUCKET", 50)):
        monkeypatch.setattr(mixing, name, value)
        assert rows() == want, name


ODD = "doc_id bigint, text string, lang string, source string, n_chars bigint, kept boolean, slot int, n_tokens bigint, media string, score double"


def test_stages_on_odd_tables(spark):
    """Every stage takes an empty table, and nulls, empties, ties, repeats, a long text and clashing names."""
    long = " ".join(f"w{i} it's" for i in range(60000))
    texts = [None, "", " \t\n", "a", "a", "same words in both of these two rows here", "same words in both of these two rows here", long, long + " x"]
    rows = [(i, t, "en", f"s{i % 2}" if i % 3 else None, 7, True, 1, 2, "m", 0.5) for i, t in enumerate(texts)]
    rows += [(5, texts[5], "en", "s1", 7, True, 1, 2, "m", 0.5), (None, "no id", None, None, None, None, None, None, None, None), (None, None, None, None, None, None, None, None, None, None)]
    for docs in (spark.createDataFrame([], ODD), spark.createDataFrame(rows, ODD)):
        n = docs.count()
        for name, stage in corpus_pipeline.STAGES[:-1]:
            left = stored(stage(spark, docs, SF), "test-odd")
            assert left.columns == docs.columns and left.exceptAll(docs).isEmpty(), name
            assert (left.count() == n) if name == "mixing" else left.count() <= n, name
        packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
        pieces = packed.collect()
        assert sum(r.piece == 0 for r in pieces) == n and all(r.offset + r.length <= r.capacity for r in pieces)
    empties = [r for r in pieces if r.doc_id in (0, 1)]
    assert [r.length for r in empties] == [1, 1]


def test_packing_keeps_repeated_rows(spark):
    frame = spark.createDataFrame([(7, 900)] * 40 + [(8, 5000)] * 3, "doc_id bigint, size bigint")
    got = packing.best_fit(frame, "size").toPandas()
    assert got["length"].sum() == 40 * 900 + 3 * 5000 and (got["doc_id"] == 8).sum() == 6
    assert (got.groupby("bin_id")["length"].sum() <= got.groupby("bin_id")["capacity"].first()).all()


#: Queries on other tables than documents, and the key that they keep; phrases keep no rows of theirs.
TABLES = {"op11_conversations": ("conversations", "conv_id"), "op12_url_filter": ("pages", "page_id")}


@pytest.mark.parametrize("name", sorted(set(queries.queries()) - {"op13_phrases"}))
def test_queries_cover_the_table(spark, name):
    table, key = TABLES.get(name, ("documents", "doc_id"))
    got = queries.queries()[name](spark, SF)
    assert got.select(key).distinct().count() == spark.read.parquet(f"{SF}/{table}.parquet").select(key).distinct().count()


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_oracles(spark, name):
    con = duckdb.connect()
    for table in ("documents", "conversations", "pages"):
        con.sql(f"create view {table} as select * from '{SF}/{table}.parquet'")
    want = con.sql(queries.oracle_sql()[name]).df()
    got = queries.queries()[name](spark, SF).toPandas()[list(want.columns)]
    key = lambda f: sorted(map(repr, f.astype(str).itertuples(index=False, name=None)))
    assert key(got) == key(want)
