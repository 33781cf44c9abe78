"""Review items against a walk with explicit loops, and tables whose cells span."""

import random

from pyspark.sql import functions as F

from foliant.operators import items, tables


def kinds_of(spark, text, spans=None):
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    if spans is not None:
        spans = spark.createDataFrame([(1, i, *s) for i, s in enumerate(spans)], "doc_id long, ord int, text string, size double, bold boolean, underline boolean, y0 double, y1 double")
    return [(r.kind, r.text) for r in items.review_items(docs, F.lit(True), spans).orderBy("item_order").collect()]


def test_bullets_take_plain_lines_and_blanks_do_not_part(spark):
    assert kinds_of(spark, "• one\nmore of one\n\nstill more words here\n• two\n2. three") == [("bullet", "• one more of one still more words here"), ("bullet", "• two"), ("bullet", "2. three")]
    assert kinds_of(spark, "•\nfirst part\nsecond part\n•\n•\nthird") == [("bullet", "first part second part"), ("bullet", "third")]
    assert kinds_of(spark, "it begins\n\nwhich then proceeds\r\ntowards its end") == [("body", "it begins which then proceeds towards its end")]


def test_headings_join_up_to_their_length_and_notes_go_on(spark):
    long = "A Title Of Forty Characters Or A Bit"
    assert kinds_of(spark, f"{long}\n{long}\n{long}\nbody text here is plain") == [("heading", f"{long} {long} {long}"), ("body", "body text here is plain")]
    longer = "A Considerably Lengthier Heading Without Compromise"
    assert kinds_of(spark, f"{longer}\n{longer}") == [("heading", longer)] * 2
    assert kinds_of(spark, "*: only here and there\nit goes on\nbut not twice") == [("list_item", "*: only here and there it goes on"), ("body", "but not twice")]
    assert kinds_of(spark, "*Wireless One Connect Box (apart)\n*: not with all of them\n*other") == [("list_item", "*Wireless One Connect Box (apart) *: not with all of them"), ("list_item", "*other")]


def test_runs_of_menus_labels_and_warnings(spark):
    assert kinds_of(spark, "Settings\n> Sound >\nPower button\nMotion sensor\nCAUTION: hot\nDO NOT OPEN it\nplain words") == [
        ("navigation", "Settings > Sound >"), ("ui_label", "Power button Motion sensor"), ("warning", "CAUTION: hot DO NOT OPEN it"), ("body", "plain words")]


def test_styles_override_text_rules(spark):
    plain = lambda t, y, size=10.0, bold=False: (t, size, bold, False, float(y), y + 10.0)
    text = "plain line one\nplain line two\nplain line three\nplain line four"
    spans = [plain("plain line one", 0), plain("plain line two", 14, 10.0, True), plain("plain line three", 31.4, 9.5, True), plain("plain line four", 60)]
    assert kinds_of(spark, text, spans) == [("body", "plain line one"), ("heading", "plain line two plain line three"), ("body", "plain line four")]
    far = [*spans[:2], plain("plain line three", 31.6, 9.5, True), spans[3]]
    assert kinds_of(spark, text, far) == [("body", "plain line one"), ("heading", "plain line two"), ("heading", "plain line three"), ("body", "plain line four")]
    small = [plain("Getting Started", 0, 7.25), plain('"Quick Help"', 14, 8.0)]
    assert kinds_of(spark, 'Getting Started\n"Quick Help"', small) == [("body", "Getting Started"), ("body", '"Quick Help"')]
    # a line without a span uses up the rest, and a bullet's text takes a styled line in
    assert kinds_of(spark, "no span\nGetting Started", small[:1]) == [("body", "no span"), ("heading", "Getting Started")]
    assert kinds_of(spark, "• one\nplain line two", [plain("• one", 0), plain("plain line two", 14, 10.0, True)]) == [("bullet", "• one plain line two")]


def test_other_languages_nulls_and_sentences(spark):
    docs = spark.createDataFrame([(1, "Eins. Zwei\n• drei", "de"), (2, None, "en"), (3, " \n ", "en"), (4, "One is here. Two is there", "en"), (5, "x", None), (4, "Title Here", "en")], "doc_id long, text string, lang string")
    rows = sorted(items.review_items(docs, F.col("lang") == "en").collect())
    assert [(r.doc_id, r.kind, r.text, r.sentences) for r in rows] == [
        (1, "body", "Eins. Zwei • drei", ["Eins. Zwei • drei"]), (4, "body", "One is here. Two is there", ["One is here.", "Two is there"]), (4, "heading", "Title Here", []), (5, "body", "x", ["x"])]
    assert items.review_items(docs.limit(0), F.lit(True)).count() == 0


def test_long_texts_are_walked_once(spark):
    docs = spark.createDataFrame([(1, "• point\nwith more words\n" * 30_000)], "doc_id long, text string")
    assert items.review_items(docs, F.lit(True)).count() == 30_000


def test_cells_are_placed_as_a_grid_of_slots_would(spark):
    """Against a dictionary of slots, filled one by one."""
    rng = random.Random(2)
    rows, want = [], set()
    for doc in range(40):
        taken = set()
        for row in range(rng.randrange(1, 8)):
            at = 0
            for ord_ in range(rng.randrange(1, 5)):
                down, across = rng.choice([1, 1, 1, 2, 3]), rng.choice([1, 1, 1, 2, 3])
                while (row, at) in taken:
                    at += 1
                covers = {(row + r, at + c) for r in range(down) for c in range(across)}
                want.add((doc, row, ord_, at, bool(covers & taken & {(row, at + c) for c in range(across)})))
                taken |= covers
                rows.append((doc, row, ord_, down, across, None))
                at += across
    df = spark.createDataFrame(rows, "doc int, row int, ord int, row_span int, col_span int, text string").repartition(4)
    grid = tables.placed(df, ["doc"])
    assert {(r.doc, r.row, r.ord, r.column, r.clash) for r in grid.collect()} == want
    assert tables.placed(df.limit(0), ["doc"]).count() == 0


def test_a_spanning_table_in_all_forms(spark):
    rows = [(1, 0, 0, True, 1, 2, "Head <1>"), (1, 0, 1, True, 2, 1, "Side"), (1, 1, 0, False, 1, 1, "a|b"), (1, 1, 1, False, 1, 1, "two\nlines"), (1, 2, 0, False, 3, 1, "")]
    df = spark.createDataFrame(rows, "doc int, row int, ord int, header boolean, row_span int, col_span int, text string").withColumn("blocks", F.lit(False))
    grid = tables.placed(df, ["doc"])
    assert tables.html(df, ["doc"]).first().html.replace("\n", "") == '<table><tr><th colspan="2">Head &lt;1&gt;</th><th rowspan="2">Side</th></tr><tr><td>a|b</td><td>two<br>lines</td></tr><tr><td rowspan="3"></td></tr></table>'
    assert tables.pipes(grid, ["doc"]).first().markdown.split("\n") == [r"| Head \<1\> |  | Side |", "| --- | --- | --- |", r"| a\|b | two<br>lines |  |", "|  |  |  |"]
    assert sorted((r.row, r.ord, r.fault) for r in tables.faults(grid, ["doc"]).collect() if r.ord is not None) == [(2, 0, "overrun")]
    assert [r.row for r in tables.faults(grid, ["doc"]).where("fault = 'gap'").collect()] == [2]
    assert tables.forms(df, ["doc"]).first().form == "html"
