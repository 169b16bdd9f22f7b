"""Small cases of the core operators."""

import json
import random
import statistics

import pytest
from pyspark.sql import functions as F

from lodestrata.functions import code, markdown
from lodestrata.functions import text as T
from lodestrata.functions.columns import stored_seconds
from lodestrata.operators import caches, evaluation, governance, ingest, knn, ranks, retrieval, store, usage
from lodestrata.operators.components import connected_components
from lodestrata.operators.sessions import merge_sessions
from lodestrata.sources import files
from lodestrata.streaming import log


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def column(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(f(F.col("x")).alias("y")).first()["y"]


def test_sessions_gap_duplicates_and_nulls(spark):
    events = [("a", 0.0, 1, "q"), ("a", 1800.0, 2, "q"), ("a", 3600.000001, 3, "r"), ("a", 0.0, 1, "q"), (None, 5.0, 9, "q"), ("b", None, 10, "q"), ("b", float("nan"), 11, "q"), ("b", 7.0, 12, None), ("c", 5.0, None, "q")]
    df = spark.createDataFrame(events, "actor string, at double, event_id long, item string").withColumn("slice", F.lit("clash")).withColumn("session_no", F.lit("clash"))
    assert rows(merge_sessions(df)) == [("a", 0, 0.0, 1800.0, 1800.0, 2, 1, 1, 2), ("a", 1, 3600.000001, 3600.000001, 0.0, 1, 1, 3, 3), ("b", 0, 7.0, 7.0, 0.0, 1, 0, 12, 12)]
    assert merge_sessions(df.limit(0)).count() == 0


def test_sessions_like_brute_force(spark):
    rng = random.Random(5)
    events = [(rng.choice("ab"), rng.randrange(200_000) / 10, i, rng.choice("xyz")) for i in range(400)]
    got = rows(merge_sessions(spark.createDataFrame(events, "actor string, at double, event_id long, item string"), gap=60).select("actor", "start", "end", "n_events", "n_items"))
    want = []
    for actor in "ab":
        own = sorted((t, i, x) for a, t, i, x in events if a == actor)
        cut = [0, *[k for k in range(1, len(own)) if own[k][0] - own[k - 1][0] > 60], len(own)]
        want += [(actor, own[a][0], own[b - 1][0], b - a, len({x for _, _, x in own[a:b]})) for a, b in zip(cut, cut[1:])]
    assert got == sorted(want)


def test_components_chain_star_and_nulls(spark):
    edges = [(k, k + 1) for k in range(40)] + [(100, k) for k in range(101, 120)] + [(7, 7), (None, 3), (200, None)]
    got = dict(rows(connected_components(spark.createDataFrame(edges, "src long, dst long"))))
    assert got == {**{k: 0 for k in range(41)}, **{k: 100 for k in range(100, 120)}}
    assert connected_components(spark.createDataFrame([], "src long, dst long")).count() == 0


def test_spread_rank_is_gapless(spark):
    df = spark.createDataFrame([("a", i) for i in range(50)] + [("b", 1), ("b", 1)], "g string, i int")
    got = rows(ranks.spread_rank(df, "g", F.col("i"), "r", salts=8).select("g", "r"))
    assert got == [("a", i) for i in range(50)] + [("b", 0), ("b", 1)]


@pytest.mark.parametrize(("stored", "want"), [(1.6e9, 1.6e9), (1.6e12, 1.6e9), (1.6e15, 1.6e9), (-1.0, None), (None, None), (float("nan"), None)])
def test_stored_seconds(spark, stored, want):
    assert column(spark, stored, stored_seconds, "double") == want


def test_text_functions(spark):
    assert column(spark, "  Hello, World! ", T.slug) == "hello-world"
    assert column(spark, "!!", T.slug) is None
    assert column(spark, "# Alpha\n\nx", T.document_title) == "Alpha"
    assert column(spark, "---\ntitle: 'T'\n---\n\nplain", T.document_title) == "T"
    assert column(spark, "", T.document_title) == "Untitled"
    assert column(spark, "a/b/read_me-2nd.md", T.name_title) == "Read Me 2Nd"
    secret = "mail a.b@example.org key sk-" + "a" * 20 + " token=xyz plain"
    assert column(spark, secret, T.redacted) == "mail [redacted] key [redacted] [redacted] plain"
    assert column(spark, "a < b & plan", lambda c: T.highlighted(c, ["plan"])) == 'a &lt; b &amp; <mark class="hl">plan</mark>'
    assert column(spark, "100%_x", lambda c: T.contains_literal(c, F.lit("%_"))) is True
    assert column(spark, "100x", lambda c: T.contains_literal(c, F.lit("%"))) is False
    assert column(spark, 1_234_567, T.short_number, "long") == "1.2M"
    assert column(spark, 0.5, T.fresh_label, "double") == "fresh"
    assert column(spark, 400.0, T.fresh_label, "double") == "1y"


def test_packed(spark):
    para = " ".join(["word"] * 100)
    got = column(spark, "\n\n".join([para] * 6), lambda c: T.packed(c, 260))
    assert len(got) == 3 and all(len(p) // 4 <= 260 for p in got)
    assert column(spark, "x" * 4000 + "\n\ny", lambda c: T.packed(c, 450)) == ["x" * 4000, "y"]
    assert column(spark, "", lambda c: T.packed(c, 450)) == []


DOC = "---\nk: v\n---\nintro\n# A\none\n```\n# not a heading\n```\n## B ##\ntwo\n# C\n\n## D\nfour"


def test_markdown_sections_and_edits(spark):
    docs = spark.createDataFrame([(1, DOC), (2, None), (3, "plain\r\ntext"), (4, "")], "id long, content string")
    assert rows(markdown.sections(docs)) == [(1, 0, "", "intro"), (1, 1, "A", "one\n```\n# not a heading\n```"), (1, 2, "A > B", "two"), (1, 3, "C > D", "four"), (3, 0, "", "plain\ntext")]
    assert rows(markdown.extract_section(docs, "a")) == [(1, "# A\none\n```\n# not a heading\n```\n## B ##\ntwo")]
    assert rows(markdown.replace_section(docs, "B", "## B\nnew")) == [(1, "intro\n# A\none\n```\n# not a heading\n```\n## B\nnew\n# C\n\n## D\nfour\n")]
    assert markdown.replace_section(docs, "nowhere", "x").count() == 0
    assert [r.anchor for r in markdown.table_of_contents(spark.createDataFrame([(1, "# X\n# X\n# !\n")], "id long, content string")).orderBy("n").collect()] == ["x", "x-2", "section"]


PY = "import os\n\n\nclass A:\n    def f(self):\n        return 1\n\n    def g(self):\n        return 2\n\n\n@dec\ndef h():\n    pass\n"
GO = "package m\n\nfunc A() {\n\tx := 1\n\treturn\n}\n\nfunc B() {\n}\n"


@pytest.mark.parametrize(("lang", "source"), [("python", PY), ("go", GO), ("rust", "fn a() {\n  b();\n}\nimpl C {\n  fn d() {}\n}\n"), ("ts", "export class A {\n  b() {}\n}\nconst c = 1;\n"), ("", "a\n  b\nc\n"), ("python", "def broken(:\n  x\n")])
@pytest.mark.parametrize("most", [1, 5, 450])
def test_code_chunks_cover(lang, source, most):
    text = source.splitlines(keepends=True)
    parts = code.chunk_source(source, lang, most)
    assert "".join("".join(text[a - 1 : b]) for a, b, _ in parts) == source
    assert all(label for _, _, label in parts)


def test_ignored(spark):
    df = spark.createDataFrame([("a/b.md", 5), ("gen/x.md", 5), ("a/c.min.js", 5), ("a/../z.md", 5), ("big.md", 10**7), ("a/K.MD", None)], "path string, size_bytes long")
    assert rows(ingest.accepted(df, ["gen", "*.min.*"], ["node_modules"]).select("path")) == [("a/K.MD",), ("a/b.md",)]


def test_incremental_changes(spark):
    kind = "source_id string, path string, mtime double, content_hash string"
    old = spark.createDataFrame([("s", "same", 1.0, "h"), ("s", "touched", 1.0, "h"), ("s", "edited", 1.0, "h"), ("s", "gone", 1.0, "h"), ("s", "sly", 1.0, "h")], kind)
    new = spark.createDataFrame([("s", "same", 1.0, "h"), ("s", "touched", 2.0, "h"), ("s", "edited", 2.0, "i"), ("s", "new", 1.0, "h"), ("s", "sly", 1.0, "i")], kind)
    assert dict(rows(ingest.changes(new, old).select("path", "action"))) == {"same": "unchanged", "touched": "unchanged", "edited": "updated", "gone": "removed", "new": "added", "sly": "unchanged"}
    paths = spark.createDataFrame([("s", "sly"), ("s", "sly"), ("s", "gone")], "source_id string, path string")
    assert dict(rows(ingest.changed_paths(new, old, paths).select("path", "action"))) == {"sly": "updated", "gone": "removed"}


def test_chunk_changes_reuse_equal_text_once(spark):
    old = spark.createDataFrame([(1, 7, "a", 0), (2, 7, "a", 1), (3, 7, "b", 2)], "id long, doc_id long, text string, chunk_index int")
    new = spark.createDataFrame([(7, "c", 0), (7, "a", 1)], "doc_id long, text string, chunk_index int")
    assert rows(ingest.chunk_changes(old, new).select("action", F.coalesce("id", F.lit(0)))) == [("delete", 2), ("delete", 3), ("insert", 0), ("reuse", 1)]


def test_importance(spark):
    df = spark.createDataFrame([("canonical", 0, 0), ("duplicate", 0, 0), ("canonical", 1, 0), ("plan", 0, 100), ("canonical", 0, 5)], "s string, p int, h long")
    assert [r[0] for r in df.select(governance.importance(F.col("s"), F.col("p"), F.col("h"))).collect()] == [1.0, 0.0, 2.0, 1.1, 1.25]


def test_owner_forks(spark):
    tags = spark.createDataFrame([(1, "owner/a"), (2, "owner/a-1"), (3, "owner/b-1"), (4, "owner/b-3"), (5, "owner/b-1"), (5, "owner/a")], "doc_id long, tag string")
    assert rows(governance.collapsed_owners(tags)) == [(2,), (3,)]


def test_duplicates_rule_and_greedy(spark):
    pairs = spark.createDataFrame([(1, 2, 0.9), (2, 3, 0.95), (4, 5, 0.99)], "id_a long, id_b long, cosine double")
    docs = spark.createDataFrame([(1, 10.0, "plan"), (2, 20.0, "canonical"), (3, 30.0, "canonical"), (4, None, "plan"), (5, None, "canonical"), (6, 99.0, "stale")], "id long, at double, status string")
    # Pairs with a document that no longer stands count for nothing.
    pairs = pairs.unionByName(spark.createDataFrame([(3, 6, 0.999), (1, 6, 1.0)], pairs.schema))
    alone = docs.select("id", F.col("id").alias("class_id"))
    assert rows(governance.duplicate_rule(pairs, alone, docs).select("id", "dup_of")) == [(1, 2), (2, 3), (4, 5)]
    assert rows(governance.duplicate_greedy(pairs, docs)) == [(1, 2), (2, 3), (4, 5)]


def test_topics(spark):
    docs = spark.createDataFrame([(1, "w", "t", "x", "canonical", 1.0, "active"), (2, "w", "t", "x", "canonical", 5.0, "active"), (3, "w", "t", "x", "stale", 9.0, "active"), (4, "w", None, None, "canonical", 1.0, "active")], "id long, workspace_id string, canonical_topic string, title string, status string, at double, lifecycle string")
    assert rows(governance.topic_winners(docs).select("id", "winner", "new_status")) == [(1, 2, "duplicate"), (2, 2, "canonical"), (3, 2, "duplicate")]
    assert rows(governance.superseded(docs).select("id")) == [(1,)]


def test_hybrid_finds_words_that_vectors_miss(spark):
    kind = "id long, title string, content string, source_id string, kind string, lifecycle string, status string, mtime double, importance double, tokens_est long, path string, ext_id string"
    texts = ["sign in with a token", "ship with flag BLUE-42", "invoice and price", "settings file"]
    docs = retrieval.searchable(spark.createDataFrame([(i, None, t, "s", None, None, None, None, None, None, f"{i}.md", None) for i, t in enumerate(texts)], kind))
    queries = retrieval.query_frame(spark, ["blue 42", "invoice", "", "zzzz"])
    got = retrieval.hybrid(retrieval.visible(docs), queries, 1767225600, 1)
    assert rows(got.select("qid", "id").where("qid < 3")) == [(1, 1), (2, 2)]
    assert rows(retrieval.bm25(docs, queries, 3).where("qid > 2")) == []


def test_visible(spark):
    docs = spark.createDataFrame([(1, "active", "canonical", "doc", "a"), (2, "archived", "canonical", "doc", "a"), (3, "active", "duplicate", "doc", "b"), (4, "pending_delete", "canonical", "doc", "b")], "id long, lifecycle string, status string, kind string, source_id string")
    ids = lambda d: [r[0] for r in d.select("id").orderBy("id").collect()]
    assert ids(retrieval.visible(docs)) == [1]
    assert ids(retrieval.visible(docs, archived=True, duplicates=True)) == [1, 2, 3]
    assert ids(retrieval.visible(docs, duplicates=True, sources=["b"])) == [3]
    with pytest.raises(ValueError):
        retrieval.resolve_scope(["a"], "nowhere")
    assert retrieval.resolve_scope(["a"], "*") is None


def test_rrf_is_symmetric(spark):
    a = spark.createDataFrame([(1, 10, 0), (1, 11, 1)], "qid int, id long, rank int")
    b = spark.createDataFrame([(1, 11, 0), (1, 12, 1)], "qid int, id long, rank int")
    assert rows(retrieval.fuse(a, b)) == rows(retrieval.fuse(b, a))
    assert dict((i, s) for _, i, s in rows(retrieval.fuse(a, b)))[11] == pytest.approx(1 / 60 + 1 / 61)


def test_rerank_keeps_short_lists(spark):
    hits = spark.createDataFrame([(1, 5, 0, "x", "no"), (1, 6, 1, "x", "xx x1")], "qid int, id long, rank int, query string, text string")
    assert rows(retrieval.rerank(hits, "query", "text", 2).select("id", "place")) == [(5, 0), (6, 1)]


def test_vectors(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, [0.0, 1.0]), (4, [0.0, 0.0]), (5, None), (6, [1.0, None]), (7, [float("nan"), 1.0]), (None, [1.0, 1.0])], "id long, embedding array<double>")
    u = knn.usable(v, dim=2)
    assert rows(knn.nearest(u, u.where("id = 1"), 5)) == [(1, 2, 1.0, 0), (1, 3, 0.0, 1)]
    assert rows(knn.similar_pairs(u.withColumn("b", F.lit(None).cast("string")), ["b"], 0.9, part=1)) == [(1, 2, 1.0)]
    assert knn.nearest(u.limit(0), u, 3).count() == 0


def test_store(spark):
    kind = "ext_id string, title string, content string, mtime double"
    old = spark.createDataFrame([("a", "A", "x", 1.0), ("b", "B", "y", 1.0), ("c", "C", "z", 1.0)], kind)
    new = spark.createDataFrame([("a", "A", "x", 9.0), ("b", "B", "new", None), ("b", "B", "old", None), ("d", "D", None, 2.0)], kind).where("content is null or content <> 'old'")
    assert rows(store.upsert(old, new).select("ext_id", "action", "mtime")) == [("a", "unchanged", 1.0), ("b", "updated", 1.0), ("c", "kept", 1.0), ("d", "added", 2.0)]
    turns = spark.createDataFrame([("s", i, "t" * 10) for i in range(20)] + [("short", 0, "hi")], "s string, i int, text string")
    assert [len(r.transcript) for r in store.captured(turns, "s", ["i"], "text", 20, 50).collect()] == [50]


def test_quantiles_like_python(spark):
    values = [0.1, 0.4, 0.4, 0.5, 0.7, 0.9, 0.2]
    df = spark.createDataFrame([("g", v) for v in values] + [("one", 3.0), ("one", None)], "g string, v double")
    got = {(g, q): v for g, q, v in rows(evaluation.exclusive_quantiles(df, "v", [0.25, 0.5, 0.75], "g"))}
    assert [got["g", q] for q in (0.25, 0.5, 0.75)] == pytest.approx(statistics.quantiles(values, n=4))
    assert got["one", 0.5] == 3.0


def test_rank_metrics(spark):
    ranked = spark.createDataFrame([("q1", "a", 0), ("q1", "b", 1), ("q2", "x", 0)], "qid string, id string, rank int")
    labels = spark.createDataFrame([("q1", "b"), ("q1", "z"), ("q2", "y"), ("q2", "y")], "qid string, id string")
    assert rows(evaluation.rank_metrics(ranked, labels, 5)) == [("q1", 0, 1, 0.5, 0.5, False), ("q2", 0, 0, 0.0, 0.0, True)]
    empty = evaluation.mean_metrics(evaluation.rank_metrics(ranked, labels.limit(0), 5))
    assert evaluation.gate(empty, 0.5, 1).first().passed is False


def test_budget_and_resume(spark):
    cases = spark.createDataFrame([(1, 0.002), (2, 0.002), (3, 0.002)], "idx int, cost double")
    assert [r.runs for r in evaluation.within_budget(cases, "cost", 0.002).orderBy("idx").collect()] == [True, False, False]
    assert evaluation.within_budget(cases, "cost", 1, cases.limit(1)).count() == 2


def test_savings_and_lift(spark):
    kind = "actor string, would_have_read_tokens long, top_result_tokens long, response_tokens_est long"
    df = spark.createDataFrame([("a", 1000, 200, 50), ("b", 10, 5, 9999), ("c", None, None, None)], kind)
    assert {r.actor: r.saved for r in usage.savings(df, "actor").collect()} == {"a": 750, "b": 0, "c": 0}
    lifts = spark.createDataFrame([(1, 0), (1, 5), (1, 19), (1, 25), (0, 3), (1, -2)], "reranked int, top1_lift int")
    got = {r.lift: r.n for r in usage.lift_histogram(lifts).collect()}
    assert len(got) == 20 and got[19] == 2 and got[0] == 2 and got[5] == 1


def test_cache(spark):
    cache = spark.createDataFrame([("k", "v1", 100.0), ("old", "v1", 1.0)], "key string, version string, created_at double")
    asked = spark.createDataFrame([(1, "k", "v1"), (2, "k", "v2"), (3, "old", "v1")], "id int, key string, version string")
    assert [r.hit for r in caches.hits(cache, asked, 150, ttl=60).orderBy("id").collect()] == [True, False, False]


def test_files(spark, tmp_path):
    root = tmp_path / "root"
    (root / "sub").mkdir(parents=True)
    (root / "a.md").write_text("# A\n")
    (root / "sub" / "b.py").write_text("x = 1\n")
    (root / "sub" / "c.min.ts").write_text("x")
    (root / "d.txt").write_text("no")
    (root / "large.md").write_text("x" * 1_000_001)
    (tmp_path / "secret.md").write_text("outside")
    (root / "link.md").symlink_to(tmp_path / "secret.md")
    assert rows(files.scan(spark, str(root), "s").select("path", "content")) == [("a.md", "# A\n"), ("sub/b.py", "x = 1\n")]
    (tmp_path / "labels").write_text("# c\n\nhow to\tx.md, y.md\nother | z.md\nbad\n")
    assert rows(files.read_labels(spark, str(tmp_path / "labels"))) == [("how to", "x.md"), ("how to", "y.md"), ("other", "z.md")]
    (tmp_path / "log").write_text('{"ts": "t", "path": "p", "tokens_est": 3}\nnot json\n')
    assert files.read_log(spark, str(tmp_path / "log")).where("path is not null").count() == 1
    for k in range(4):
        files.snapshot(spark.range(k), str(tmp_path / "snap"), f"2024-0{k + 1}")
    assert files.prune_snapshots(spark, str(tmp_path / "snap"), 3) == ["2024-01"]
    assert files.snapshots(spark, str(tmp_path / "snap")) == ["2024-04", "2024-03", "2024-02"]
    assert rows(files.configured(spark, [{"id": "own", "root": "/x"}, {"id": "a", "root": "/a"}], "own")) == [("a", "a", "/a")]


def test_streamed_windows_equal_batch(spark, data, tmp_path):
    events = spark.read.parquet(f"{data}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    source = log.events_stream(spark, f"{data}/events.parquet")
    batch = events.groupBy(F.window("ts", "1 day"), "event_type").agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), "event_type", "n")
    stream = log.closing(source, f"file://{tmp_path}/end")
    got = log.drained(log.tumbling(stream).select("start", "event_type", "n"), "t", f"file://{tmp_path}", finish=lambda: log.end(source, f"file://{tmp_path}/end"))
    assert rows(got) == rows(batch)
    # Without being told of the end, the last window stays open.
    still = log.drained(log.tumbling(source).select("start", "event_type", "n"), "u", f"file://{tmp_path}")
    last = batch.agg(F.max("start")).first()[0]
    assert rows(still) == rows(batch.where(F.col("start") < last))


def test_stream_sessions_split_only_beyond_the_gap(spark, tmp_path):
    import datetime as dt

    start = dt.datetime(2024, 1, 1)
    at = lambda s: start + dt.timedelta(seconds=s)
    events = [(1, "a", at(0)), (2, "a", at(1800)), (2, "a", at(1800)), (3, "a", at(3600.000001)), (4, "b", at(5)), (5, None, at(5)), (None, "b", at(6)), (6, "b", None)]
    spark.createDataFrame(events, "event_id long, actor string, ts timestamp").coalesce(1).write.parquet(f"{tmp_path}/in")
    source = log.events_stream(spark, f"{tmp_path}/in")
    found = log.log_sessions(log.closing(source, f"{tmp_path}/end"))
    got = log.drained(found, "s", f"{tmp_path}/work", finish=lambda: log.end(source, f"{tmp_path}/end"))
    assert rows(got.select("actor", "duration", "n_events", "first_id", "last_id")) == [("a", 0.0, 1, 3, 3), ("a", 1800.0, 2, 1, 2), ("b", 0.0, 1, 4, 4)]


def test_stream_repeats_forget_after_the_idle_time(spark, tmp_path):
    import datetime as dt

    start = dt.datetime(2024, 1, 1)
    for k, part in enumerate(([(1, 0), (1, 1)], [(9, 60)], [(9, 61)], [(1, 62)])):
        part = [(user, "x", start + dt.timedelta(minutes=m)) for user, m in part]
        spark.createDataFrame(part, "user_id long, item string, ts timestamp").coalesce(1).write.parquet(f"{tmp_path}/in/{k}.parquet")
    source = lambda: spark.readStream.schema("user_id long, item string, ts timestamp").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*.parquet")
    short = log.drained(log.repeats(source(), "user_id", "item", idle=60), "short", f"{tmp_path}/a")
    long = log.drained(log.repeats(source(), "user_id", "item", idle=36000), "long", f"{tmp_path}/b")
    assert max(r[2] for r in rows(long) if r[0] == 1) == 3
    assert max(r[2] for r in rows(short) if r[0] == 1) == 2


def test_packed_paragraphs_keep_any_character(spark):
    from lodestrata.functions.text import packed

    text = "a\u001eb\n\n" + "word " * 20 + "\n \n" + "tail" * 3
    got = column(spark, text, lambda c: F.to_json(packed(c, 10)))
    assert json.loads(got) == ["a\u001eb", ("word " * 20).strip(), "tail" * 3]
    assert column(spark, " \n", lambda c: F.to_json(packed(c, 10))) == "[]" and column(spark, None, lambda c: packed(c, 10)) is None
    assert json.loads(column(spark, "ab\n\n" * 20_000, lambda c: F.to_json(packed(c, 5))))[0] == "ab\n\nab\n\nab\n\nab\n\nab"


def test_sections_of_odd_markdown():
    from lodestrata.functions.markdown import parse

    assert parse("---\nx: 1\n---\nintro\n# A ##\n\n## B\ntext\r\n  ```\n# no\n```\n#### C\nc\n## D#\nd\n#nospace\n####### seven\n# #\nlast") == [
        ("", "intro"), ("A > B", "text\n  ```\n# no\n```"), ("A > B > C", "c"), ("A > D", "d\n#nospace\n####### seven\n# #\nlast"),
    ]
    assert parse("---\nno end\n# H\nx") == [("", "---\nno end"), ("H", "x")] and parse("```\n# H\nx") == [("", "```\n# H\nx")] and parse("") == []


def test_knn_limits_within_tasks(spark):
    df = spark.range(10).select(F.col("id").alias("a"), F.col("id").alias("b"), F.rand(1).alias("similarity"))
    assert "WindowGroupLimit" in knn.best(df, "a", "b", 3)._jdf.queryExecution().toString()


def test_spread_and_materialize(spark):
    from lodestrata.session import discard, materialize, shared_folder, spread

    many = spark.range(100).repartition(9)
    assert spread(many) is many
    assert spread(spark.range(100).coalesce(1)).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    kept = materialize(many.where("id < 5"))
    folder = kept.inputFiles()[0].rsplit("/", 1)[0]
    assert shared_folder(spark).split(":", 1)[-1].strip("/") in folder and kept.count() == 5
    discard(kept)
    from pathlib import Path

    assert not Path(folder.removeprefix("file://")).exists()


def test_clean_names_and_log_actors(spark):
    from lodestrata.operators.sessions import log_actors

    log_rows = [(1, " Ann.B\t", "s", 1.6e9), (2, None, "S-1", 1.6e12), (3, "UNKNOWN", "unknown", 1.6e9), (4, "", None, 1.6e9), (5, '"x_1"', "s", -1.0)]
    df = spark.createDataFrame(log_rows, "id long, user string, session_id string, ts double").withColumn("query", F.lit("q"))
    assert [(r.event_id, r.actor, r["at"]) for r in log_actors(df).orderBy("event_id").collect()] == [(1, "ann.b", 1.6e9), (2, "s-1", 1.6e9), (3, None, 1.6e9), (4, None, 1.6e9), (5, "x_1", None)]


def test_stream_of_sessions_merges_late_events(spark, tmp_path):
    import datetime as dt

    start = dt.datetime(2024, 1, 1)
    first = [(1, start), (1, start + dt.timedelta(minutes=40)), (2, start)]
    # Late, but within the watermark: it joins the two intervals of key 1.
    late = [(1, start + dt.timedelta(minutes=20)), (9, start + dt.timedelta(days=2))]
    for k, part in enumerate((first, late)):
        spark.createDataFrame(part, "user_id long, ts timestamp").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = log.sessions(log.events_stream(spark, f"{tmp_path}/in"), "user_id")
    got = log.drained(stream, "s", f"file://{tmp_path}/work")
    assert sorted((r.user_id, r.n) for r in got.collect() if r.user_id != 9) == [(1, 3), (2, 1)]


def test_embedded_equals_the_relational_form(spark):
    docs = spark.createDataFrame([(1, "Alpha beta beta"), (2, ""), (3, None), (4, "x")], "id long, text string")
    sparse = {(r.id, r.dim): r.weight for r in retrieval.hashed_terms(docs).collect()}
    for r in retrieval.embedded(docs).collect():
        norm = sum(v * v for v in r.v) ** 0.5
        assert {(r.id, d): pytest.approx(v / norm) for d, v in enumerate(r.v) if v} == {k: w for k, w in sparse.items() if k[0] == r.id}
    assert {r.id for r in retrieval.embedded(docs).collect()} == {1}


def test_fresh_labels_and_cache_hits_read_every_unit(spark, tmp_path):
    from lodestrata.plans import corpus, text

    at = 1767225600 - 3 * 86400.0
    docs = [(1, at), (2, at * 1e3), (3, at * 1e6), (4, 1767225600 - 7200.0), (5, None), (6, -1.0), (7, 1767225600.0)]
    spark.createDataFrame(docs, "id long, mtime double").write.parquet(f"{tmp_path}/docs.parquet")
    assert rows(text.fresh_labels(spark, str(tmp_path))) == [(1, "fresh 3d", "3d ago"), (2, "fresh 3d", "3d ago"), (3, "fresh 3d", "3d ago"), (4, "fresh", "2h ago")]
    now = 1583798400.0
    asked = [(1, "Alpha", now - 60), (2, "beta ", (now - 60) * 1e3), (3, "BETA", now - 90000), (4, "gamma", (now - 90000) * 1e6), (5, "alpha", (now + 60) * 1e3), (6, "beta", None)]
    spark.createDataFrame(asked, "id long, query string, ts double").write.parquet(f"{tmp_path}/mcp_queries.parquet")
    assert rows(corpus.cache_hits(spark, str(tmp_path)).select("id", "key", "hit")) == [(1, "alpha", True), (2, "beta", True), (3, "beta", True), (4, "gamma", False)]


def test_fixed_values():
    """Values that results must agree on, written out here and not read from the engine."""
    from lodestrata.operators import evaluation, retrieval

    assert retrieval.STATUS_WEIGHTS == {"canonical": 1.0, "plan": 0.85, "stale": 0.5, "duplicate": 0.6, "superseded": 0.3}
    assert retrieval.STATUS_MARKS == {"canonical": "★", "plan": "◯", "stale": "✗", "duplicate": "⚠", "superseded": "⤺"}
    assert evaluation.WEIGHTS == {"correctness": 0.35, "autonomy": 0.25, "actionability": 0.20, "safety": 0.10, "concision": 0.10}
    assert (retrieval.RRF, retrieval.HALF_LIFE_DAYS, retrieval.IMPORTANCE) == (60, 90.0, 0.35)


def test_nearest_in_passes_and_within_groups(spark, monkeypatch):
    import numpy as np

    rng = np.random.default_rng(4)
    x = rng.normal(size=(300, 64)).astype(np.float32)
    x[100:140] = x[7]
    groups = [None if i % 5 == 0 else f"g{i % 3}" for i in range(300)]
    df = knn.usable(spark.createDataFrame([(i, v.tolist(), g) for i, (v, g) in enumerate(zip(x, groups))], "id long, embedding array<float>, g string"), "id", "embedding", 64, "g").repartition(3)
    u = knn.unit(x)
    s = np.round(u @ u.T, 6)
    np.fill_diagonal(s, -9)
    for passes in (1, 4):
        monkeypatch.setattr(knn, "SENT", 64 << 20 if passes == 1 else 30 * 64)
        asked = df.where("id % 10 = 7")
        for within in (None, "g"):
            got = {}
            for r in knn.nearest(df, asked, 5, within=within).collect():
                got.setdefault(r.id, {})[r["rank"]] = r.neighbour
            for i in range(7, 300, 10):
                able = [j for j in range(300) if j != i and (within is None or groups[j] == groups[i])]
                want = sorted(able, key=lambda j: (-s[i, j], j))[:5]
                assert [got[i][k] for k in range(5)] == want
    assert knn.nearest(df, df.limit(0)).count() == 0 and knn.nearest(df.limit(0), df).count() == 0


def test_rate_limits_of_a_hot_key_like_brute_force(spark):
    rng = random.Random(3)
    events = [("hot" if rng.random() < 0.8 else "cold", rng.randrange(0, 5000), i) for i in range(400)] + [("hot", None, 400), (None, 3, 401), ("hot", 100, 402), ("hot", 100, 403)]
    df = spark.createDataFrame(events, "k string, t long, i long").withColumn("_x", F.lit("clash"))
    got = {r.i: r.recent for r in usage.rate_limited(df, "k", F.col("t"), 5, 60).collect()}
    for k, t, i in events:
        assert got[i] == (None if t is None else sum(a == k and b is not None and t - 59 <= b <= t for a, b, _ in events))


def test_budget_over_blocks(spark):
    cases = spark.createDataFrame([(i * 30_000, 1.0) for i in range(10)], "idx long, cost double")
    assert [(r.spent, r.runs) for r in evaluation.within_budget(cases, "cost", 7.0).orderBy("idx").collect()] == [(float(k + 1), k < 7) for k in range(10)]


def test_versions_and_tombstones(spark):
    kept = spark.createDataFrame([("a", "A", "now"), ("b", "B", None), ("c", "C", "c")], "ext_id string, title string, content string")
    old = spark.createDataFrame([(1, "a", "A0", "first", 1.0), (2, "a", "A1", "second", 2.0), (3, "b", "B0", "b0", 1.0), (4, "c", "C0", None, 1.0)], "version_id long, ext_id string, title string, content string, ts double")
    assert [(r.ext_id, r.version_id, r.size) for r in store.version_listing(old).where("place = 0").orderBy("ext_id").collect()] == [("a", 2, 6), ("b", 3, 2), ("c", 4, None)]
    picks = spark.createDataFrame([("a", 1), ("a", 1), ("b", 3), ("c", 4), ("a", 0), ("c", 1)], "ext_id string, version_id long")
    out, snapshots = store.restored(kept, old, picks)
    assert rows(out.select("ext_id", "title", "content", "action")) == [("a", "A", "first", "restored"), ("b", "B", "b0", "restored"), ("c", "C", "c", "kept")]
    assert sorted((r.ext_id, r.content or "") for r in snapshots.collect()) == [("a", "now"), ("b", "")]
    dead = spark.createDataFrame([(1, "a", "A", "x", "note", ["kind/note", "k"], 1.0), (2, "a", "A2", "y", "note", None, 1.0), (3, "b", "B", "z", None, [], 9.0)], "id long, ext_id string, title string, content string, kind string, tags array<string>, deleted_at double")
    wanted = spark.createDataFrame([("a",), ("a",), ("zz",)], "ext_id string")
    assert [(r.ext_id, r.title, r.tags) for r in store.undeleted(dead, wanted).collect()] == [("a", "A2", None)]
    assert [r.id for r in store.newest_of_all(dead, "deleted_at", 2, "id").collect()] == [3, 2]


def test_index_of_more_than_is_searched(spark):
    docs = spark.createDataFrame([(1, "alpha beta"), (2, "alpha alpha gamma"), (3, ""), (4, None), (5, "beta delta"), (None, "alpha")], "id long, text string")
    queries = retrieval.query_frame(spark, ["alpha beta", ""])
    index = retrieval.indexed(docs)
    some = docs.where("id in (1, 2, 3)")
    assert rows(retrieval.bm25(some, queries, 5, index)) == rows(retrieval.bm25(some, queries, 5)) != rows(retrieval.bm25(docs, queries, 5, index))
    assert rows(retrieval.dense(some, queries, 5, index)) == rows(retrieval.dense(some, queries, 5))
    assert index.lengths.count() == 5 and index.vectors.count() == 3
    for words in ([], ["", "!"]):
        asked = retrieval.query_frame(spark, words)
        assert retrieval.bm25(docs, asked, 5, index).count() == 0 and retrieval.dense(docs, asked, 5, index).count() == 0
    none = retrieval.indexed(docs.limit(0))
    assert retrieval.bm25(docs.limit(0), queries, 5, none).count() == 0


def test_many_queries_stay_tables(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "alpha beta"), (2, "alpha alpha gamma"), (3, "Beta delta")], "id long, text string")
    queries = retrieval.query_frame(spark, ["alpha beta", "delta", "beta beta alpha", ""])
    few = [rows(f(docs, queries, 5)) for f in (retrieval.bm25, retrieval.dense)]
    monkeypatch.setattr(retrieval, "TOLD", 2)
    assert [rows(f(docs, queries, 5)) for f in (retrieval.bm25, retrieval.dense)] == few and len(few[0]) == 7


def test_run_cases_without_hits(spark):
    cases = spark.createDataFrame([(1, "alpha", "c"), (2, "beta", "c")], "qid int, query string, category string")
    hits = spark.createDataFrame([(1, 10, 0), (1, 11, 1)], "qid int, id long, rank int")
    texts = spark.createDataFrame([(10, "x" * 40 + "alpha", "a.md"), (11, None, None)], "id long, text string, line string")
    got = evaluation.run_cases(cases, hits, texts, lambda q, context: F.right(context, F.lit(5)), lambda row, said: F.contains(said, row["query"]))
    # The other arm reads the second hit too, an empty text after a blank line.
    assert rows(got.select("qid", "base_ok", "ok", "tokens")) == [(1, False, True, 11 + 1 + 1), (2, False, False, 0)]


def test_clear_deletes_what_was_written(spark):
    from pathlib import Path

    from lodestrata.session import clear, materialize, work_folder

    kept = materialize(spark.range(3))
    folder = Path(work_folder(spark).removeprefix("file://"))
    assert kept.count() == 3 and folder.exists()
    clear(spark)
    assert not folder.exists()
    assert materialize(spark.range(3)).count() == 3


def test_polyline_and_receipts_of_nothing(spark):
    from lodestrata.functions.text import polyline

    points = lambda v: column(spark, v, polyline, "array<double>")
    assert points([0.0, 1.0, 2.0]) == "3.0,27.0 50.0,15.0 97.0,3.0" and points([5.0]) == "50.0,3.0"
    assert points([]) is None and points([0.0, 0.0]) is None and points(None) is None
    runs = spark.createDataFrame([(1.0, 0.9), (2.0, 0.5), (3.0, None), (None, 0.1)], "ts double, hit_1 double")
    saved = spark.createDataFrame([(101,)], "saved long")
    assert rows(evaluation.at_precision(saved, evaluation.newest_run(runs)).select("ts", "at_precision")) == [(2.0, 50)]
    assert rows(evaluation.at_precision(saved, evaluation.newest_run(runs.limit(0))).select("ts", "at_precision")) == [(None, None)]


def test_store_only_and_summaries(spark):
    docs = spark.createDataFrame([(1, "record", "h"), (2, None, "h"), (3, "note", None)], "id long, kind string, content_hash string")
    assert sorted((r.id, r.embeds, r.content_hash) for r in store.store_only(docs, ["record"]).collect()) == [(1, False, ""), (2, True, "h"), (3, True, None)]
    kind = "id long, path string, status string, at double, tokens_est long, content string"
    listed = spark.createDataFrame([(1, "a.md", "stale", 86400.0 * 9, 12, "# T\nsome text"), (2, "b.md", "odd", None, 0, None)], kind)
    assert rows(retrieval.summaries(listed, 86400.0 * 10)) == [(1, "a.md  ✗ fresh 1d  ~12tok\n  T some text"), (2, "b.md" + " " * 5 + "~0tok")]


def test_bursts_of_changes(spark, tmp_path):
    import datetime as dt

    start = dt.datetime(2024, 1, 1)
    changes = [("s", "b.md", 0.0), ("s", "a.md", 0.3), ("s", "b.md", 0.7), ("s", "c.md", 2.0), ("t", "a.md", 0.1), (None, "x", 0.0), ("t", None, 0.2)]
    spark.createDataFrame([(s, p, start + dt.timedelta(seconds=at)) for s, p, at in changes], "source string, path string, ts timestamp").coalesce(1).write.parquet(f"{tmp_path}/in")
    source = log.events_stream(spark, f"{tmp_path}/in")
    found = log.bursts(log.closing(source, f"{tmp_path}/end"), "source", "path")
    got = log.drained(found, "b", f"{tmp_path}/work", finish=lambda: log.end(source, f"{tmp_path}/end"))
    assert sorted((r.source, r.n, tuple(r.paths)) for r in got.collect()) == [("s", 1, ("c.md",)), ("s", 3, ("a.md", "b.md")), ("t", 1, ("a.md",))]


def test_copies_are_one_class_and_the_rule_sees_them_all(spark):
    import numpy as np

    rng = np.random.default_rng(9)
    base = rng.normal(size=(12, 64))
    x = np.concatenate([base, base[:4] + 0.1 * rng.normal(size=(4, 64)), np.repeat(base[:2], 15, 0)]).astype(np.float32)
    x[16:46] = np.repeat(x[:2], 15, 0)
    data = [(i, v.tolist(), "b") for i, v in enumerate(x)]
    pairs, members = knn.similar_classes(knn.usable(spark.createDataFrame(data, "id long, embedding array<float>, b string"), "id", "embedding", 64, "b"), ["b"], 0.8)
    ids = {r.id: r.class_id for r in members.collect()}
    assert len(ids) == len(x) and all(ids[i] == (i if i < 16 else (i - 16) // 15) for i in ids)
    u = knn.unit(x)
    s = np.round(u @ u.T, 6)
    want = {(i, j) for i in range(len(x)) for j in range(i + 1, len(x)) if s[i, j] >= 0.8}
    assert {(r.id_a, r.id_b) for r in knn.expanded(pairs, members).collect()} == want
    at = [float(rng.integers(0, 5)) if i % 7 else None for i in range(len(x))]
    status = ["stale" if i % 11 == 3 else "plan" for i in range(len(x))]
    docs = spark.createDataFrame(list(zip(range(len(x)), at, status)), "id long, at double, status string")
    age = lambda i: (-1.0 if at[i] is None else at[i], i)
    near = {i: [j for j in range(len(x)) if (min(i, j), max(i, j)) in want and i != j and status[j] == "plan" and age(j) > age(i)] for i in range(len(x)) if status[i] == "plan"}
    best = {(i, max(js, key=lambda j: (s[i, j], age(j)))) for i, js in near.items() if js}
    assert set(rows(governance.duplicate_rule(pairs, members, docs).select("id", "dup_of"))) == best
