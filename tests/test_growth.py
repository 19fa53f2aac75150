"""Queries grow with their input: no step reads a table in one task, keeps a group whole or makes rows again that are there."""

from pyspark.sql import functions as F

from lorewright.operators import graph as G


def _plan(df):
    return df._jdf.queryExecution().toString()


def test_weights_of_pairs_are_those_of_the_edges(spark):
    pairs = spark.createDataFrame([(1, 2), (1, 2), (2, 1), (2, 3), (4, 3), (4, 3), (5, 5)], "source long, target long")
    once = pairs.distinct()
    want = {tuple(r) for r in G.cluster_weights(once, once.where("source % 2 = 0")).collect()}
    assert {tuple(r) for r in G.pair_weights(pairs, F.col("source") % 2 == 0).collect()} == want == {(1, 2, 4.0), (2, 3, 3.0), (3, 4, 3.0)}


def test_lists_of_neighbours_hold_each_edge_both_ways(spark):
    edges = [(1, i, float(i)) for i in range(2, 30)] + [(2, 3, 0.5)]
    rows = G._near_lists(spark.createDataFrame(edges, "a long, b long, w double")).select("v", F.explode(F.arrays_zip("u", "w")).alias("e")).select("v", "e.u", "e.w")
    assert sorted(tuple(r) for r in rows.collect()) == sorted([*edges, *[(b, a, w) for a, b, w in edges]])


def test_modularity_does_not_make_the_edges_again(spark, sf_dir):
    from lorewright.plans import graphs as P

    assert "lineitem" not in _plan(P.gra_modularity(spark, sf_dir))


def test_dossier_shuffles_no_texts(spark, sf_dir):
    """Texts are joined by a broadcast of the few notes that were found."""
    from lorewright.operators import reports as R
    from lorewright.sources.tables import mentions, notes

    n = notes(spark, sf_dir)
    rows = R.dossier(n, n.select("id", F.lit(1.0).alias("score")).orderBy("id").limit(5), "src7", mentions(spark, sf_dir))
    rows.collect()
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan and "Exchange hashpartitioning" not in plan


def test_batches_are_carried_over_ranges(spark):
    from lorewright.operators import similar as M

    rows = [(p, n, (n * 37 + len(p)) % 90) for p in ("a", "bb", "ccc") for n in range(1 + 90 * len(p))]
    want, seen = set(), {}
    for p, n, length in rows:
        i, c, cut, batch = seen.get(p, (0, 0, None, 0))
        now = (i // 7, c // 400)
        batch += now != cut
        want.add((p, n, batch))
        seen[p] = (i + 1, c + length, now, batch)
    df = spark.createDataFrame([(p, n, "x" * length) for p, n, length in rows], "part string, n long, text string")
    by_length = df.select("part", "n", F.length("text").alias("length"))
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # else so few rows are one range
    try:
        ranges = by_length.repartitionByRange("part", "n").select("part", F.spark_partition_id().alias("r")).distinct()
        assert ranges.where("part = 'ccc'").count() > 1
        for source in (df, by_length):
            assert {(r.part, r.n, r.batch) for r in M.batches(source, 7, 400).collect()} == want
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_streams_are_written_by_many_tasks(spark, sf_dir, monkeypatch):
    """A stream's folder has a file of each task that wrote it; one file for all would be read and written by one task."""
    from lorewright.plans import extras
    from lorewright.streaming import events

    files = {}
    made = events.file_stream

    def seen(session, schema, path, *more):
        files[path] = len(session.read.schema(schema).parquet(path).inputFiles())
        return made(session, schema, path, *more)

    monkeypatch.setattr(events, "file_stream", seen)
    assert extras.stm_restored(spark, sf_dir).count() > 100
    assert extras.stm_inbox(spark, sf_dir).count() > 100
    assert len(files) == 2 and min(files.values()) >= 4


_LOG = "actor string, id long, at long, action string, target string, detail string"


def test_chains_are_walked_over_many_batches_and_go_on_from_heads(spark):
    import pandas as pd

    from lorewright.operators import secure as Q

    rows = [(f"c{i % 3}", i, i * 10, "a", None if i % 4 else "t", f'd"{i}\\') for i in range(60)]
    want = {}
    for actor in ("c0", "c1", "c2"):
        one = Q.seal_rows(pd.DataFrame([r for r in rows if r[0] == actor], columns=["actor", "id", "at", "action", "target", "detail"]))
        want |= dict(zip(one["id"], one["hash"], strict=True))
    log = spark.createDataFrame(rows, _LOG)
    size = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "4")
    try:
        done = Q.chain(log)
        assert "FlatMapGroupsInPandas" not in _plan(done)  # no chain is held whole
        assert {r.id: r.hash for r in done.collect()} == want
        heads = Q.chain(log.where("id < 31")).groupBy("actor").agg(F.max_by("hash", "id").alias("hash"))
        assert {r.id: r.hash for r in Q.chain(log.where("id >= 31"), heads=heads).collect()} == {i: h for i, h in want.items() if i >= 31}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
    checked = Q.verify(done).collect()
    assert {(r.actor, r.entries, r.broken_at) for r in checked} == {(f"c{i}", 20, None) for i in range(3)}


def test_sealed_folder_goes_on_after_a_stop(spark, tmp_path):
    from lorewright.operators import secure as Q
    from lorewright.streaming import events as E

    for part in ([("x", 1, 1, "a", None, "d"), ("z", 2, 2, "a", None, "d")], [("x", 3, 3, "a", "t", "d"), ("y", 4, 4, "a", None, "d")], [("x", 5, 5, "b", "t", "d"), ("z", 6, 6, "a", None, "d")]):
        spark.createDataFrame(part, _LOG).write.mode("append").parquet(str(tmp_path / "in"))
        E.sealed_into(E.file_stream(spark, spark.createDataFrame([], _LOG).schema, str(tmp_path / "in"), 100), str(tmp_path / "out"), str(tmp_path / "check"))
    out = spark.read.option("recursiveFileLookup", True).parquet(str(tmp_path / "out"))
    assert {r.actor: (r.entries, r.broken_at) for r in Q.verify(out).collect()} == {"x": (3, None), "y": (1, None), "z": (2, None)}


def test_postings_are_counted_without_a_shuffle(spark):
    from lorewright.operators.index import postings

    rows = postings(spark.createDataFrame([("a", "one", "red red", ["t"]), ("b", None, None, None)], "id string, title string, content string, tags array<string>"))
    assert "Exchange" not in _plan(rows)
    assert {(r.term, r.id, r.length, r.tf) for r in rows.collect()} == {("one", "a", 4, 1), ("red", "a", 4, 2), ("t", "a", 4, 1)}


def test_words_of_a_text_are_cut_once(spark):
    from lorewright.functions import text as X
    from lorewright.operators.secure import mask

    rows = spark.createDataFrame([("one two three",)], "t string")
    for made, pattern in ((X.client_tokens(F.col("t"), 2), "regexp_replace("), (X.shingles(F.col("t"), F.col("t")), "split("), (mask(F.col("t")), "sk-ant-[")):
        assert rows.select(made.alias("x"))._jdf.queryExecution().optimizedPlan().toString().count(pattern) == 1


def test_topics_are_those_of_the_patterns_alone(spark):
    from lorewright.functions import classify as C

    texts = ["GITHUB", "a gıthub b", "gİthub", "Kontakt", "ſhop", "workshop", "on 2024-05-06", "1.2.2024", "1.2", "call x+49 1", "+49", "MUSS NOCH", "FÄLLIG", "e-mail: x", "how-to", "step 3", "schritt x", "see https://a", "", None, "Kundin", "Millers", "ttodo"]
    rows = spark.createDataFrame(list(enumerate(texts)), "n int, t string")
    plain = F.array(*[F.when(F.coalesce("t", F.lit("")).rlike(f"(?iu){C.EDGE}({words}){C.EDGE}"), name) for name, words in C.TOPICS.items()])
    got = rows.select("n", C.topics(F.lit(""), F.col("t"), F.lit("notes")).alias("x"), F.array_compact(plain).alias("y")).collect()
    assert [r.x for r in got] == [r.y for r in got] and sum(bool(r.x) for r in got) > 12
    assert rows.select(C.topics(F.lit(""), F.col("t"), F.lit("code")).alias("x")).where("size(x) > 0").count() == 0
    assert "contains(" in _plan(rows.select(C.topics(F.lit(""), F.col("t"), F.lit("notes")))).lower()


def test_rerank_stems_only_words_that_can_count(spark):
    from lorewright.operators import search as S

    made = S.rerank("apache license en", F.col("t"), F.col("c"), F.array(F.lit("x")))
    rows = spark.createDataFrame([("Title", "an apachen licensing es"), ("apache", "zebra"), ("zebra", "ap other"), ("e", "apaches a"), (None, None)], "t string, c string").select(F.round(made, 6).alias("r"))
    assert [r.r for r in rows.collect()] == [0.52, 0.266667, 0.12, 0.586667, 0.2]  # as when all words are stemmed
    assert "startswith" in _plan(rows).lower()
