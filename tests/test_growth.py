"""Queries that have to grow no faster than their tables: what their plans send around, and the steps they now take."""

import os
import random
import re

import pytest
from pyspark.sql import functions as F

from foliant.operators import blocks, hints, nodes, stats, tables


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_pages_are_made_behind_the_last_shuffle(spark):
    rng = random.Random(5)
    rows = [(d, i, a, a + rng.randrange(-2, 9), f"l{i % 3}") for d in range(40) for i, a in enumerate((rng.randrange(30) for _ in range(rng.randrange(1, 8))), 1)]
    want = {}
    for d, i, a, b, x in rows:
        for page in range(min(a, b), max(a, b) + 1):
            want[d, page] = max(want.get((d, page), (0, "")), (i, x))
    got = nodes.section_of_pages(spark.createDataFrame(rows, "doc int, reading_order int, start_page int, end_page int, language string"), "doc")
    told = [tuple(r) for r in got.collect()]
    assert len(told) == len(want) and {(d, p): (i, x) for d, p, i, x in told} == want
    assert 0 <= plan(got).find("Generate") < plan(got).find("Exchange")


FLOW = "doc int, ord int, page int, text string, size double, box array<double>, has_text boolean"


def test_flows_of_icons_are_not_joined(spark):
    flow = spark.createDataFrame([(1, 0, 0, "Press ", 10.0, None, None), (1, 1, 0, None, None, [0.0, 0.0, 10.0, 10.0], False), (1, 2, 0, " now.", 10.0, None, None)], FLOW)
    icons = hints.inline_icons(flow, ["doc"])
    planned = plan(icons)
    assert [tuple(r) for r in icons.collect()] == [(1, 1, hints.GENERIC_ICON, 10.0, 1.0, 1.0, None, None)]
    assert planned.count("Exchange hash") <= 3 and planned.count("ArrowEvalPython") == 1 and "Join" not in planned


def test_a_long_flow_is_read_once_for_all_its_figures(monkeypatch):
    reads = []
    bounds = hints.route_bounds
    monkeypatch.setattr(hints, "route_bounds", lambda text: reads.append(text) or bounds(text))
    items = ["Go to ", None, " > A > B. "] * 500
    assert hints.route_evidences(items)[1::3] == [(2, False, [*([3 * i - 1] if i else []), 3 * i, 3 * i + 2]) for i in range(500)]
    assert len(reads) == 1


def test_bounded_robust_medians_are_those_of_any_size(spark):
    rng = random.Random(6)
    rows = [(k, rng.choice([1.0, 2.5, 0.0, None, rng.random() * 100]), rng.randrange(1, 4)) for k in "abcd" for _ in range(rng.randrange(1, 60))]
    df = spark.createDataFrame(rows, "k string, v double, w int")
    for distinct in (True, False):
        told = [{r.k: r.median for r in stats.robust_median(df, ["k"], "v", "w", distinct=distinct, bounded=b).collect()} for b in (True, False)]
        assert told[0] == told[1] and set(told[0]) == set("abcd")
    assert "Join" not in plan(stats.robust_median(df.withColumn("v", F.col("v") + 1), ["k"], "v", "w", bounded=True))


def test_tables_are_dealt_into_more_tasks_as_they_grow(spark, tmp_path, monkeypatch):
    from foliant.sources import places

    spark.range(100_000).select("id", (F.col("id") % 7).alias("k")).write.parquet(str(tmp_path / "t"))
    t = spark.read.parquet(str(tmp_path / "t"))
    assert places.dealt(t, "k").rdd.getNumPartitions() == 4
    monkeypatch.setattr(places, "DEAL_BYTES", 10_000)
    n = places.dealt(t, "k").rdd.getNumPartitions()
    assert n > 20 and places.dealt(t.select("k"), "k").count() == 100_000


def test_nodes_keep_their_columns_in_intervals_without_a_join(spark):
    n = spark.createDataFrame([(1, [0], "a"), (1, [0, 1], "b"), (1, [1], "c"), (1, [2], "d"), (1, [2], "e"), (2, [0], "f")], "doc int, path array<int>, x string")
    i = spark.createDataFrame([(1, 7, [0], [0]), (1, 8, [2], [2])], "doc int, ordinal int, start_path array<int>, end_path array<int>")
    got = nodes.in_path_intervals(n, i, ["doc"])
    assert "Join" not in plan(got)
    assert {r.x: r.ordinal for r in got.collect()} == {"a": 7, "b": 7, "c": None, "d": 8, "e": 8, "f": None}


def test_pieces_are_made_by_compiled_steps(spark):
    from foliant.operators import rewrites

    rows = spark.createDataFrame([(1, 0, "body", "(QX12 only) Hold it."), (1, 1, "body", "plain"), (1, 2, "body", ""), (1, 3, "body", "gone")], "doc int, ord int, kind string, text string")
    p = rewrites.piece
    got = rewrites.split(rows, ["doc"], F.col("text") == "gone", F.array(p(F.lit("a"), F.lit(" ")), p(F.lit("a"), F.lit(""))))
    assert "filter(" not in plan(got) and [r.text for r in got.orderBy("ord").collect()] == ["(QX12 only) Hold it.", "plain", ""]
    scoped = rewrites.model_scopes(rows, ["doc"])
    assert plan(scoped).count("aggregate(") <= 2
    assert [(r.kind, r.text) for r in scoped.orderBy("ord").collect()][:2] == [("condition_label", "(QX12 only)"), ("body", "Hold it.")]


def test_closing_parentheses_against_a_plain_reading(spark):
    from foliant.functions import review

    rng = random.Random(9)
    rows = [("".join(rng.choice("(()))aé ") for _ in range(rng.randrange(12))), rng.randrange(-1, 12)) for _ in range(1500)]

    def plain(x, at):
        if at < 1 or x[at - 1 : at] != "(":
            return 0
        depth = 0
        for i, c in enumerate(x[at - 1 :], at):
            depth += (c == "(") - (c == ")")
            if depth == 0:
                return i
        return 0

    got = spark.createDataFrame(rows, "x string, at int").select("x", "at", review.closing(F.col("x"), F.col("at")).alias("c")).collect()
    assert all(r.c == plain(r.x, r.at) for r in got) and sum(r.c > 0 for r in got) > 30


def test_items_without_regulations_make_no_notes(spark):
    from foliant.functions import review

    notes = spark.range(1).select(review.regulatory_topics(F.col("id").cast("string"), F.lit(False)).alias("n"))
    assert notes.first().n == [] and "filter(" not in plan(spark.range(1).select(review.regulatory_topics(F.col("id").cast("string"), F.lit(False))))


def test_subtitles_broadcast_nothing_and_repeat_no_table(spark):
    import os

    import pytest

    from foliant.plans import registry

    if not os.path.isdir("/root/testdata/sf0.001"):
        pytest.skip("no test tables")
    planned = plan(registry.QUERIES["table_subtitles"](spark, "/root/testdata/sf0.001"))
    assert "Broadcast" not in planned and "SortMergeJoin" in planned and planned.count("Scan parquet") < 15


def test_form_clusters_make_their_inputs_once(spark, monkeypatch):
    from foliant.operators import clusters

    named = []
    kept = clusters.written
    monkeypatch.setattr(clusters, "written", lambda df, name: named.append(name) or kept(df, name))
    n = spark.createDataFrame([(1, [0], "section", "Sect", None)], "doc int, path array<int>, role string, source_role string, actual_text string")
    f = spark.createDataFrame([(1, [0, 0], "x", 400, 9.0, 0, 1)], "doc int, path array<int>, text string, weight int, size double, page int, mcid int")
    assert clusters.form_clusters(n, f, n.select("doc", "path").limit(0), ["doc"]).count() == 0
    assert named[:2] == ["cluster-nodes", "cluster-fragments"]


def test_tables_with_spans_are_made_once_and_not_joined(spark):
    rows = [(1, 2, 0, 2, 1, "a"), (1, 2, 1, 1, 1, "b"), (1, 3, 0, 1, 2, "c"), (1, 7, 0, 1, 1, "d"), (1, 7, 3, 1, 3, None), (2, 0, 0, 1, 1, "e")]
    cells = spark.createDataFrame(rows, "doc int, row int, ord int, row_span int, col_span int, text string")
    grid = tables.placed(cells, ["doc"])
    assert "Join" not in plan(grid) and plan(grid).count("Exchange") == 1
    told = tables.pipes(grid, ["doc"])
    assert "Join" not in plan(told) and plan(told).count("Exchange") == 2 and "lambda" not in plan(told)
    got = {r.doc: r.markdown.split("\n") for r in told.collect()}
    assert got == {1: ["| a | b |  |  |", "| --- | --- | --- | --- |", "|  | c |  |  |", "| d |  |  |  |"], 2: ["| e |", "| --- |"]}
    assert sorted((r.row, r.ord, r.column, r.text) for r in grid.where("doc = 1").collect()) == [(2, 0, 0, "a"), (2, 1, 1, "b"), (3, 0, 1, "c"), (7, 0, 0, "d"), (7, 3, 1, None)]


def test_items_are_expanded_in_few_orders(spark):
    fields = blocks.COMMON_FIELDS
    told = [*fields[:3], "10 %", fields[0], fields[1], "plain", fields[2]]
    rows = [(1, 0, 0, i, "heading" if x in fields else "body", x) for i, x in enumerate(told)]
    got = blocks.expanded(spark.createDataFrame(rows, "doc int, page int, cell_order int, ord int, kind string, text string"))
    assert plan(got).count("Sort [") <= 4
    assert [(r.kind, r.text) for r in got.orderBy("ord").collect()] == [
        ("heading", fields[0]), ("spec_table", f"{fields[0]} {fields[1]}"), ("heading", fields[2]), ("spec_table", f"{fields[2]} 10 %"),
        ("heading", fields[0]), ("spec_table", f"{fields[0]} {fields[1]}"), ("body", "plain"), ("heading", fields[2]),
    ]


def test_content_items_are_dealt_by_rows_however_well_they_pack(spark, tmp_path, monkeypatch):
    from foliant.plans import blockviews
    from foliant.sources import places

    c = F.col("id")
    rows = spark.range(20_000).select((c % 5000).alias("l_orderkey"), (c * 0).alias("l_suppkey"), (c * 0).alias("l_partkey"), (c * 0 + c % 7).cast("int").alias("l_linenumber"))
    rows.write.parquet(str(tmp_path / "lineitem"))
    monkeypatch.setattr(places, "DEAL_ROWS", 1000)
    items = blockviews._items(lambda name: spark.read.parquet(str(tmp_path / name)))
    sizes = [len(p) for p in items.rdd.glom().collect()]
    assert len(sizes) == 20 and max(sizes) <= 2000


def test_items_are_expanded_in_two_orders_without_a_grouping(spark):
    sound, field = "Sound (Output)", blocks.COMMON_FIELDS[3]
    told = [("body", "a"), ("heading", sound), ("body", ""), ("body", "20 W"), ("heading", f"{sound} 5 W"), ("body", f"10 W {field}"), ("body", "dry"), ("heading", blocks.COMPOUND), ("body", "1 x 2"), ("navigation", "> All")]
    items = spark.createDataFrame([(1, 0, 0, i * 10, k, x) for i, (k, x) in enumerate(told)], "doc int, page int, cell_order int, ord int, kind string, text string")
    got = blocks.expanded(items)
    assert plan(got).count("Sort [") <= 2 and "Aggregate" not in plan(got)
    assert [(r.ord, r.kind, r.text) for r in got.orderBy("ord").collect()] == [
        (0, "body", "a"), (1, "heading", sound), (2, "spec_table", f"{sound} 20 W {sound} 5 W 10 W"), (3, "body", field), (4, "body", "dry"), (5, "heading", blocks.COMPOUND_PARTS[0]),
        (6, "heading", blocks.COMPOUND_PARTS[1]), (7, "spec_table", "Display Resolution 1 x 2"), (8, "navigation", "> All"),
    ]
    views = blocks.content_blocks(got)
    assert plan(views).count("Sort [") <= 3 and [(r.block_order, r.section_heading) for r in blocks.navigation_view(views).collect()] == [(9, blocks.COMPOUND_PARTS[1])]
    assert [(r.block_order, r.field) for r in blocks.spec_view(views).orderBy("block_order").collect() if r.row_order == 1] == [(3, sound), (8, "Display Resolution")]


def test_navigation_views_sort_thrice_in_tasks_told_by_rows(spark, tmp_path, monkeypatch):
    from foliant.plans import blockviews
    from foliant.sources import places

    c = F.col("id")
    rows = spark.range(1400).select((c % 200).alias("l_orderkey"), (c * 0).alias("l_suppkey"), (c % 35).alias("l_partkey"), (c % 7).cast("int").alias("l_linenumber"))
    rows.write.parquet(str(tmp_path / "lineitem"))
    monkeypatch.setattr(places, "DEAL_ROWS", 100)
    view = blockviews.content_navigation_view(lambda name: spark.read.parquet(str(tmp_path / name)))
    planned = plan(view)
    assert planned.count("Sort [") <= 3 and "ObjectHashAggregate" not in planned and planned.count("Exchange") == 1
    assert view.rdd.getNumPartitions() == 14
    assert view.count() > 0 and {r.text for r in view.select("text").distinct().collect()} <= {"> All Settings", "Update Now"}


def test_a_table_for_many_tasks_is_dealt_twice_so_that_no_split_stays_in_memory(spark, tmp_path, monkeypatch):
    from foliant.plans import blockviews
    from foliant.sources import places

    c = F.col("id")
    rows = spark.range(6000).select((c % 1500).alias("l_orderkey"), (c % 11).alias("l_suppkey"), c.alias("l_partkey"), (c % 7).cast("int").alias("l_linenumber"))
    rows.write.parquet(str(tmp_path / "lineitem"))
    read = lambda name: spark.read.parquet(str(tmp_path / name))
    shuffles = lambda df: [int(n) for n in re.findall(r"Exchange hashpartitioning\([^)]*, (\d+)\)", plan(df))]
    once = blockviews.content_navigation_view(read)
    assert shuffles(once) == [4]
    want = sorted(map(str, once.collect()))
    monkeypatch.setattr(places, "DEAL_ROWS", 29)  # 207 tasks, which a shuffle writes only behind all rows of a split
    assert shuffles(blockviews.content_navigation_view(read)) == [400, 200]
    monkeypatch.setattr(places, "DEAL_FIRST", 3)
    monkeypatch.setattr(places, "DEAL_ROWS", 600)
    twice = blockviews.content_navigation_view(read)
    assert shuffles(twice) == [12, 3] and len(want) > 300 and sorted(map(str, twice.collect())) == want
    dealt = places.dealt(read("lineitem"), "l_orderkey", table=read("lineitem"))
    tasks = dealt.select("l_orderkey", F.spark_partition_id().alias("p")).distinct()
    assert dealt.columns == read("lineitem").columns and tasks.count() == 1500 and tasks.select("p").distinct().count() == 12
    assert shuffles(places.dealt(read("lineitem"), "l_orderkey", table=read("lineitem"), read=False)) == [10]


def test_pages_of_documents_pack_into_a_small_file(spark, tmp_path):
    rows = [(d, i, a, a + 700, f"l{i % 3}") for d in range(120) for i, a in enumerate(range(d % 7, 6000, 500), 1)]
    got = nodes.section_of_pages(spark.createDataFrame(rows, "doc int, reading_order int, start_page int, end_page int, language string"), "doc")
    got.write.parquet(str(tmp_path / "pages"))
    told = spark.read.parquet(str(tmp_path / "pages"))
    want = sum(max(a for _, _, a, _, _ in rows[d * 12 : d * 12 + 12]) + 701 - d % 7 for d in range(120))
    assert told.count() == want == told.select("doc", "page").distinct().count()
    assert told.groupBy("page").agg(F.count("*").alias("n")).where("page between 6 and 6200").where("n <> 120").count() == 0
    assert sum(f.stat().st_size for f in (tmp_path / "pages").glob("*.parquet")) < want // 2  # four bytes a row and more, a document behind another
    assert told.where(F.col("reading_order") != F.least(F.floor((F.col("page") - F.col("doc") % 7) / 500) + 1, F.lit(12))).count() == 0


def test_every_specification_is_told(spark, tmp_path):
    import duckdb

    from foliant.plans import blockviews, registry

    c = F.col("id")
    rows = spark.range(4000).select((c % 300).alias("l_orderkey"), (c % 13).alias("l_suppkey"), (c * 37 % 1009).alias("l_partkey"), (c % 7).cast("int").alias("l_linenumber"))
    rows.write.parquet(str(tmp_path / "lineitem"))
    read = lambda name: spark.read.parquet(str(tmp_path / name))
    view = blockviews.content_spec_view(read)
    got = [tuple(r) for r in view.collect()]
    specs = blockviews._blocks(read).where("block_type = 'spec_table'")
    assert {r[:2] for r in got} == {tuple(r) for r in specs.select("doc", "block_order").collect()} and specs.select("text").distinct().count() > 20
    db = duckdb.connect()
    db.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{tmp_path}/lineitem/*.parquet'")
    told = db.execute(registry.SQL["content_spec_view"])
    assert [d[0] for d in told.description] == view.columns and sorted(told.fetchall()) == sorted(got)
    assert any(r[4] > 1 for r in got) and any(r[6] == "" for r in got)


def sent(df):
    """The shuffles of a query that has run, without those that are read again."""
    df.collect()
    return re.findall(r"^[\s:|+*()\d-]*Exchange (.*)", plan(df).split("== Initial Plan ==")[0], re.M)


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no test tables")
@pytest.mark.parametrize(("name", "most"), [("hint_faults", 1), ("tree_counts", 1), ("hard_gates", 5), ("quality_reports", 5)])
def test_branches_over_lines_share_one_shuffle(spark, name, most):
    from foliant.plans import registry

    assert len(sent(registry.QUERIES[name](spark, "/root/testdata/sf0.001"))) <= most


def test_faults_of_repeated_and_unknown_hints(spark):
    from foliant.operators import validation

    inf, nan = float("inf"), float("nan")
    h = "doc int, kind string, path array<int>, size double, weight int"
    hints = [(1, "subtitle", [0], 1.0, 5), (1, "subtitle", [0], 1.0, 6), (1, "line_break", [1], inf, None), (1, "line_break", [2], nan, 1), (1, "line_break", [3], None, 1), (1, "line_break", [4], 2.0, 1), (1, "strong_label", [0, 1], 1.0, 1), (None, "line_break", [5], 1.0, 1), (1, None, [6], 1.0, 1)]
    found = [(1, "subtitle", [0], 1.0, 5), (1, "line_break", [1], inf, None), (1, "line_break", [2], nan, 1), (1, "line_break", [3], 1.0, 1), (1, "line_break", [4], 2.0 + 1e-7, 1), (1, "line_break", [7], 1.0, 1), (None, "line_break", [5], 1.0, 1)]
    targets = [(1, k, [i]) for k in ("subtitle", "line_break", None) for i in range(8)] + [(None, "line_break", [5]), (1, "strong_label", [0, 1])]
    got = validation.hint_faults(spark.createDataFrame(hints, h), spark.createDataFrame(found, h), spark.createDataFrame(targets, "doc int, kind string, path array<int>"), ["doc"], ["size"], ["weight"])
    assert "Join" not in plan(got)
    assert sorted((str(r.doc), str(r.kind), r.path, r.fault) for r in got.collect()) == sorted([
        ("1", "subtitle", [0], "repeated"), ("1", "subtitle", [0], "evidence:weight"), ("1", "line_break", [3], "evidence:size"), ("1", "strong_label", [0, 1], "extra"), ("1", "strong_label", [0, 1], "overlap"), ("1", "line_break", [7], "missing"),
        ("None", "line_break", [5], "unresolved"), ("None", "line_break", [5], "missing"), ("None", "line_break", [5], "extra"), ("1", "None", [6], "unresolved"), ("1", "None", [6], "extra"),
    ])


def test_cover_regions_are_worked_out_once(spark):
    from foliant.operators import cover

    texts = ["Acme Service Center", "call 1-800-ACME 5", "www.a.example www.b.example", "www.a.example", "12 Long Road", "body", "more", "Figures and illustrations differ", "Product design and specifications may change", "BN68-01234A-00", "Address"]
    rows = [(p, i % 2, i, x, 25.0 if x == "body" and p == 2 else 9.0, i == 3, False, False, float(i % 3), float(i), float(i + 4), float(i + 1)) for p in (1, 2) for i, x in enumerate(texts)] + [(3, 0, 0, "Website", 9.0, False, False, False, 0.0, 0.0, 1.0, 1.0), (3, 0, 1, "plain", 9.0, False, False, False, 0.0, 1.0, 1.0, 2.0), (3, 0, 2, "body", 9.0, True, False, False, 0.0, 2.0, 1.0, 3.0)]
    spans = spark.createDataFrame(rows, "page int, cell_order int, ord int, text string, size double, bold boolean, italic boolean, underline boolean, x0 double, y0 double, x1 double, y1 double").repartition(4, "page")
    found = cover.regions(spans, cover.Rules("Acme", ("Long Road",)))
    planned = plan(found)
    assert "Join" not in planned and "Union" not in planned and "Aggregate" not in planned and planned.count("Sort [") <= 3 and planned.count("Exchange") <= 2
    got = {}
    for r in found.orderBy("page", "region_order").collect():
        got.setdefault(r.page, []).append(r)
    table = next(r for r in got[1] if r.region_type == "contact_table")
    assert (table.service_center, table.websites, table.address) == ("call 1-800-ACME 5", "www.a.example\nwww.b.example", "12 Long Road more") and table.n_spans is None and (table.x0, table.y0, table.x1, table.y1) == (0.0, 0.0, 14.0, 11.0)
    note = next(r for r in got[1] if r.region_type == "disclaimer")
    assert note.text == "Figures and illustrations differ Product design and specifications may change" and (note.y0, note.y1) == (7.0, 9.0)
    assert [r.region_type for r in got[1]][-1] == "document_code" and sum(r.region_type == "contact_table" for r in got[2]) == 1 and any(r.region_type == "title" for r in got[2])
    assert [(r.region_type, r.text, r.n_spans, r.bold) for r in got[3]] == [("table_heading", "Website", 1, False), ("body", "plain body", 2, True)]


def test_inline_paragraphs_are_told_by_one_grouping(spark):
    n = "doc int, path array<int>, role string, actual_text string"
    rows = [(1, [0], "paragraph", None), (1, [0, 0], "span", None), (1, [1], "paragraph", None), (1, [1, 0], "figure", None), (1, [2], "paragraph", None), (1, [2, 0], "link", "said"), (1, [3], "paragraph", None), (1, [4], "heading", None), (None, [5], "paragraph", None)]
    found = nodes.inline_paragraphs(spark.createDataFrame(rows, n), spark.createDataFrame([(1, [0, 0, 0], "x"), (1, [1, 0, 0], "x"), (1, [3, 0], " "), (1, [4, 0], "x"), (None, [5, 0], "x")], "doc int, path array<int>, text string"), ["doc"])
    assert "Join" not in plan(found) and sorted(r.path for r in found.collect()) == [[0], [2]]


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no test tables")
def test_form_paragraphs_are_written_once(spark, monkeypatch):
    from foliant.plans import forms

    reads = []
    forms.form_clusters(lambda name: reads.append(name) or spark.read.parquet(f"/root/testdata/sf0.001/{name}.parquet"))
    assert reads == ["lineitem"]
