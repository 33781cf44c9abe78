"""Operators on micro-fixtures that the driver's tables do not hold."""

import itertools
import random
import re

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from foliant.functions import text as T
from foliant.operators import align, sequences, signals, stats, tree
from foliant.sources import profiles
from foliant.streaming import kinds as streaming


def column(spark, fn, values):
    return [r[0] for r in spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, x string").orderBy("i").select(fn(F.col("x"))).collect()]


def test_line_kinds(spark):
    cases = {"": "blank", "Getting Started": "heading", "01 Connect": "heading", "• one": "bullet", "2) two": "bullet", "> Menu": "navigation", "Update Now": "ui_label", "* note": "list_item", "x 2": "list_item", "CAUTION: hot": "warning", "KEEP THIS AWAY FROM WATER AND FIRE": "warning", "this is plain running text.": "body"}
    assert column(spark, T.line_kind, list(cases)) == list(cases.values())


def test_font_weights_and_roles(spark):
    assert column(spark, T.font_weight, ["ABC+Sans-700", "Sans-Bold", "Sans SemiBold", "Sans", ""]) == [700, 700, 600, None, None]
    assert column(spark, T.font_weight, ["Sans-SemiBold", "Sans_light"]) == [600, 300]
    assert column(spark, T.semantic_role, ["H", "H3", "Title", "LBody", "Zz"]) == ["heading", "heading", "heading", "list_body", "unknown"]
    assert column(spark, T.heading_level, ["H", "H3", "Title"]) == [None, 3, 1]


def test_scalars(spark):
    assert column(spark, T.inline_tokens, ["{btn_a} x {icn_b} {btn_a}"]) == [["btn_a", "icn_b"]]
    assert column(spark, lambda x: T.segment(x, "[", "]"), ["a [b] c", "a [b", "a"]) == ["[b", "[b", ""]
    assert column(spark, T.unit_of, ["10 W", "5 °C", "7 %", "x"]) == ["W", "temperature_range", "%", ""]
    assert column(spark, T.collapsed, [" a  b\n"]) == ["a b"]
    assert column(spark, T.is_safety_table, ["AC voltage DC voltage Class II product", "AC voltage"]) == [True, False]
    assert column(spark, T.is_fragment, ["or", "a b", "A full sentence ends here."]) == [True, True, False]
    got = column(spark, T.file_fields, ["x/A_B_C_D_E_F.pdf", "A_B_C_D_X_E_F.0.pdf", "bad.pdf", "A_B_C__E_F"])
    assert got[0].buyer == "D" and got[0].language == "E" and got[1].source_token == "D_X_E" and [r.error for r in got] == [None, None, "too_few_parts", "token_missing"]


def test_profiles(spark):
    rows = [("T1", "R", "a; b;", "ENG;FRA", "A2", 2), ("t1", "R", "", "ENG", "A9", 2), (" T2", "R", "", "eng", "BOOK", 1)]
    df = spark.createDataFrame(rows, profiles.SCHEMA).withColumns({c: profiles.items(F.col(c)) for c in ("buyer_codes", "languages")})
    got = {r.source_token: r for r in profiles.errors(df).collect()}
    assert got["T1"].buyer_codes == ["a", "b"] and got["T1"].errors == ["token_repeated"]
    assert got["t1"].errors == ["token_repeated", "count_differs", "type_unknown"]
    assert got[" T2"].errors == ["token_untrimmed", "language_shape"]
    files = spark.createDataFrame([("T1",), ("zz",)], "source_token string")
    assert {r.source_token: r.found for r in profiles.lookup(files, df.where("doc_type = 'A2'")).collect()} == {"T1": True, "zz": False}
    assert column(spark, profiles.language_token, ["L05", "LXX", "ENG", "C-FRA", "MENA", "x"]) == ["numbered", "invalid", "single", "single", "named", "invalid"]


def test_lcs_against_dynamic_programming():
    random.seed(2)
    for _ in range(60):
        a, b = ("".join(random.choice("ab🎉\x01") for _ in range(random.randrange(12))) for _ in range(2))
        best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, j in itertools.product(range(len(a)), range(len(b))):
            best[i + 1][j + 1] = best[i][j] + 1 if a[i] == b[j] else max(best[i][j + 1], best[i + 1][j])
        assert align.lcs_length(a, b) == best[-1][-1]


def test_joins_and_sentences(spark):
    assert align.joined(["a", "b", " c", "d ", "e", "日", "本", "("]) == ("a b c d e 日本 (", ["insert_space", "trim_left", "insert_space", "normalize_existing_space", "insert_space", "keep_adjacent", "insert_space"])
    assert align.joined(["a.", "b", "(c)", "d", ""]) == ("a.b (c) d", ["keep_adjacent", "insert_space", "insert_space", "keep_adjacent"])
    assert align.joined([]) == ("", [])


def test_joined_against_plain_concatenation():
    rng = random.Random(5)
    for _ in range(3000):
        parts = ["".join(rng.choice("ab .)日本(\t") for _ in range(rng.randrange(4))) for _ in range(rng.randrange(6))]
        out = parts[0] if parts else ""
        for p in parts[1:]:
            what = align.seam(out[-1:], p[:1])
            out = {"normalize_existing_space": f"{out.rstrip()} {p.lstrip()}", "trim_left": f"{out} {p.lstrip()}", "insert_space": f"{out} {p}", "keep_adjacent": out + p}[what]
        assert align.joined(parts)[0] == out


def test_split_sentences_against_plain_python(spark):
    import re

    marks = {"e.g.": "e__g__", "i.e.": "i__e__", "etc.": "etc__", "No.": "No__", "Fig.": "Fig__", "Mr.": "Mr__", "Ms.": "Ms__", "Dr.": "Dr__"}
    normal = lambda s: re.sub(r"\s+", " ", s).strip()

    def plain(text, english):
        if not english:
            return [normal(text)] if text.strip() else []
        paragraphs, out = [[]], []
        for line in map(str.strip, text.splitlines()):
            if not line or line.startswith(("•", "-", "–")) or re.match(r"^\d+[.)]\s+", normal(line)):
                paragraphs.append([])
            if line:
                paragraphs[-1].append(line)
        for p in map(" ".join, paragraphs):
            for a, b in marks.items():
                p = p.replace(a, b)
            for s in map(normal, re.split(r"(?<=[.!?])\s+(?=[A-Z0-9\"'(\[])", p)):
                for a, b in marks.items():
                    s = s.replace(b, a)
                out += [s] if s else []
        return out

    texts = ["Title\n\nOne line\nruns on. Next one! 3 left", "See Fig. 2 and No. 7. Ask Mr. X, e.g. Ms. Y. Dr. Z etc. All", "a\n• b\n- c\n1. d\n2) E. F\n3.g\r\nh\r\n\r\nI", "a.\u00a0B.\x1fC.\u2028d\x85\x85E", "", " \n\t ", "x. \n y. Z", "Hé. Ça va? Oui"]
    rows = [(i, t, e) for i, (t, e) in enumerate((t, e) for t in texts for e in (True, False, None))]
    got = {r.i: r.s for r in spark.createDataFrame(rows, "i int, t string, e boolean").select("i", T.split_sentences(F.col("t"), F.col("e")).alias("s")).collect()}
    assert got == {i: plain(t, e) for i, t, e in rows}


def test_sequences(spark):
    rows = spark.createDataFrame([(1, 1), (1, 2), (2, 1), (2, 3), (3, 1)], "k int, n int")
    assert {r.k: (r.valid, r.first_gap) for r in sequences.series_audit(rows, ["k"], "n").collect()} == {1: (True, None), 2: (False, 2), 3: (False, None)}
    flags = spark.createDataFrame([(1, t, f) for t, f in [(1, True), (2, True), (3, True), (5, True), (6, True), (7, False), (8, True)]], "k int, t long, f boolean")
    assert [(r.start, r.confirmed, r.length) for r in sequences.confirmed_runs(flags, ["k"], "t", "f", F.lit(1), 2).orderBy("start").collect()] == [(1, 2, 3), (5, 6, 2)]


def test_medians(spark):
    rows = spark.createDataFrame([("a", 1.0, 3), ("a", 10.0, 3), ("b", 1.0, 1), ("b", 2.0, 5)], "k string, v double, w int")
    assert {r.k: r.median for r in stats.weighted_median_lower(rows, ["k"], "v", "w").collect()} == {"a": 1.0, "b": 2.0}
    assert {r.k: r.median for r in stats.weighted_median_mid(rows, ["k"], "v", "w").collect()} == {"a": 5.5, "b": 2.0}


def test_paths(spark):
    nodes = spark.createDataFrame([(1, [1]), (1, [1, 2]), (1, [12]), (1, [2, 1])], "d int, path array<int>")
    barred = spark.createDataFrame([(1, [1])], "d int, path array<int>")
    assert sorted(r.path for r in tree.outside(nodes, barred, ["d"]).collect()) == [[2, 1], [12]]


def test_best_lag(spark):
    pair = spark.createDataFrame([(i, float(i * i % 7), float((i - 2) * (i - 2) % 7)) for i in range(40)], "hour long, a double, b double")
    assert signals.best_lag(pair, 3).first().lag == 2


def test_stream(spark, tmp_path):
    spark.createDataFrame([(1, "Getting Started\nplain text here.")], "doc_id long, text string").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("doc_id long, text string").parquet(str(tmp_path / "in"))
    q = streaming.kinds_stream(stream).writeStream.format("memory").queryName("kinds_out").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert {r.kind for r in spark.table("kinds_out").collect()} == {"heading", "body"}


def items(spark, pairs):
    return spark.createDataFrame([(1, i, k, x) for i, (k, x) in enumerate(pairs)], "doc int, ord int, kind string, text string")


def told(df):
    return [(r.kind, r.text) for r in df.orderBy("doc", "ord").collect()]


def test_prepared_items(spark):
    from foliant.operators import rewrites

    got = told(rewrites.prepared(items(spark, [
        ("bullet", "–"), ("warning", "CAUTION"), ("body", ": hot. WARNING - sharp"), ("body", "(QX12 only) Hold it."), ("body", "(see (a) below) text"),
        ("body", rewrites.ACTION_INTRO + "."), ("body", "Bending"), ("body", "Pulling"), ("body", "Bending it is fine."),
        ("body", "upgrade to the latest"), ("body", "software. Use the keys."), ("body", "Try pressing the"), ("ui_label", "Power"), ("body", "button ."), ("body", "After."),
        ("body", "Now go to"), ("navigation", ">"), ("ui_label", "All Settings"), ("body", "."), ("body", "End."),
        ("heading", rewrites.PACKAGE_HEADING), ("list_item", "* Cable"), ("list_item", "Stand"), ("heading", "02 Other"), ("list_item", "* Kept"),
        ("body", rewrites.CONDITION_START + "AB1/"), ("body", "CD2/The"), ("body", "Frame."), ("body", "tail 1."),
    ]), ["doc"]))
    assert got == [
        ("bullet", "CAUTION: hot."), ("bullet", "WARNING - sharp"), ("condition_label", "(QX12 only)"), ("body", "Hold it."), ("body", "(see (a) below) text"),
        ("body", rewrites.ACTION_INTRO + "."), ("figure_action_labels", "Bending\nPulling"), ("body", "Bending it is fine."),
        ("body", "upgrade to the latest software. Use the keys."), ("body", "Try pressing the Power button ."), ("body", "After."),
        ("body", "Now go to"), ("navigation", "(> All Settings)"), ("body", "End."),
        ("heading", rewrites.PACKAGE_HEADING), ("item_list", "Cable"), ("list_item", "Stand"), ("heading", "02 Other"), ("item_list", "Kept"),
        ("model_condition", rewrites.CONDITION_START + "AB1/CD2/The Frame."), ("body", "tail"),
    ]


def test_rewrites_of_empty_items_and_nulls(spark):
    from foliant.operators import rewrites

    assert told(rewrites.prepared(items(spark, []), ["doc"])) == []
    assert told(rewrites.prepared(items(spark, [("body", None), ("body", "")]), ["doc"])) == [("body", ""), ("body", "")]


def test_items_that_no_rule_begins_with_go_past_the_chain(spark):
    from foliant.operators import rewrites
    from foliant.plans import rewriting

    snippets = [s for name, s in rewriting.SNIPPETS.items() for s in s if name != "embedded_headings"]
    rows = [(d, i, k, x) for d, s in enumerate(snippets) for i, (k, x) in enumerate(s)]
    df = spark.createDataFrame(rows, "doc int, ord int, kind string, text string")
    plain = rewrites.renumbered(df.withColumn("text", T.collapsed(F.col("text"))), ["doc"], "ord")
    still = plain.withColumn("may", F.bool_or(rewrites.may_change(F.col("kind"), F.col("text"))).over(Window.partitionBy("doc"))).where("not may").drop("may")
    want = {tuple(r) for r in still.collect()}
    docs = [r.doc for r in still.select("doc").distinct().collect()]
    for rule in rewrites.CHAIN:
        out = rule(still, ["doc"], "Acme") if rule is rewrites.remote_icons else rule(still, ["doc"])
        assert {tuple(r) for r in out.collect()} == want, rule.__name__
    assert rewrites.prepared(df, ["doc"], "Acme").count() > len(want)
    assert 0 < len(docs) < len(snippets)


def test_embedded_headings_and_precautions(spark):
    from foliant.operators import rewrites

    got = told(rewrites.embedded_headings(items(spark, [("body", 'See "Notes" now. Notes Keep dry. LicenseNotes'), ("heading", "Notes")]), ["doc"], {"Notes": "Notes", "License": "License"}))
    assert got == [("body", 'See "Notes" now.'), ("heading", "Notes"), ("body", "Keep dry."), ("heading", "License"), ("heading", "Notes"), ("heading", "Notes")]
    got = told(rewrites.prepared(items(spark, [("body", f"Mind. {rewrites.PRECAUTION_INTRO} Always ensure it stands. Never place it high.")]), ["doc"]))
    assert got == [("body", f"Mind. {rewrites.PRECAUTION_INTRO}"), ("bullet", "Always ensure it stands."), ("bullet", "Never place it high.")]


@pytest.mark.parametrize("seed", range(4))
def test_joined_runs_follow_the_automaton(spark, seed):
    from foliant.operators import rewrites

    rng = random.Random(seed)
    flags = [(d, i, rng.random() < 0.3, rng.random() < 0.7, rng.random() < 0.3) for d in range(5) for i in range(rng.randrange(1, 40))]
    df = spark.createDataFrame([(d, i, "k", f"{i}", o, f, e) for d, i, o, f, e in flags], "doc int, ord int, kind string, text string, o boolean, f boolean, e boolean")
    runs = rewrites.joined_runs(df, ["doc"], F.col("o"), F.col("f"), F.col("e"), F.lit("run"), lambda p: F.array_join(p, " "))
    got = sorted((r.doc, r.ord, r.text) for r in rewrites.renumbered(runs, ["doc"], "ord").collect())
    want, run, doc = [], None, None
    for d, i, o, f, e in flags:
        if d != doc:
            run, doc, n = None, d, 0
        if run is not None and f:
            want[-1][2].append(str(i))
            run = None if e and not o else run
            continue
        want.append([d, n, [str(i)]])
        n += 1
        run = i if o else None
    assert got == sorted((d, n, " ".join(x)) for d, n, x in want)


def test_chapter_policy_boundaries(spark):
    from foliant.operators import chapters

    rows = [(0, 20.0, 18.0, 12.0), (1, 20.0, 17.9, 10.0), (2, 15.0, 15.0, 10.0), (3, 14.9, 14.9, 10.0), (4, None, 15.0, 10.0)]
    df = spark.createDataFrame(rows, "i int, a double, b double, body double").orderBy("i")
    assert [r[0] for r in df.select(chapters.outcome(F.col("a"), F.col("b"), F.col("body"))).collect()] == ["promoted", "label_body_size_mismatch", "promoted", "font_ratio_below_threshold", "typography_insufficient"]
    series = spark.createDataFrame([(1, i, x) for i, x in enumerate(["02", "01", "02", "01", "03", "01", "02"])], "doc int, at int, label string")
    audits = chapters.audit(chapters.with_series(series, "doc", "at"), "doc", "at")
    assert [(r.series, r.n, r.valid, r.next_start) for r in audits.orderBy("series").collect()] == [(0, 1, False, 1), (1, 2, True, 3), (2, 2, False, 5), (3, 2, True, None)]
    assert chapters.consistency(audits, "doc").collect()[0].consistent is True
    kids = [(1, "label", "01", 9.0), (1, "list_body", "Start", 9.0), (2, "label", "1", 9.0), (2, "list_body", "x", 9.0), (3, "label", "02", 9.0), (3, "label", "03", 9.0), (3, "list_body", "y", 9.0)]
    assert [r.title for r in chapters.candidates(spark.createDataFrame(kids, "k int, role string, text string, size double"), ["k"]).collect()] == ["Start"]


def test_phrases_structure_and_sinks(spark, tmp_path):
    from foliant.operators import checks
    from foliant.sources import sinks

    docs = spark.createDataFrame([(1, "Keep  dry.\nSerial numbr"), (2, None)], "doc_id int, text string")
    rules = [checks.Phrase("dry", "exact", "Keep dry."), checks.Phrase("serial", "similarity", "Serial number", least=0.9), checks.Phrase("oil", "partial", "oil", required=False)]
    got = {(r.doc_id, r.rule): r.status for r in checks.phrases(docs, rules).collect()}
    assert got == {(1, "dry"): "PASS", (1, "serial"): "PASS", (1, "oil"): "PASS", (2, "dry"): "FAIL", (2, "serial"): "FAIL", (2, "oil"): "PASS"}
    with pytest.raises(ValueError):
        checks.Phrase("x", "vague").found(F.col("text"))
    e = sinks.encoded(F.col("x"))
    texts = ["plain", "bell \x07", "", None, "é😀".encode("utf-16", "surrogatepass").decode("utf-16")]
    df = spark.createDataFrame([(x,) for x in texts], "x string")
    assert [r[0] for r in df.select(sinks.decoded(e)).collect()] == texts
    back = sinks.write_verified(docs, str(tmp_path / "out"))
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, docs.collect()))
    assert sinks.differences(docs, docs.limit(1)).count() == 1
    types = spark.createDataFrame([(0, ["A5", "A5"]), (1, ["A5", "A3"]), (2, ["A3", "A2"]), (3, ["X"])], "i int, s array<string>").orderBy("i")
    assert [r[0] for r in types.select(checks.document_type(F.col("s"))).collect()] == ["BOOK", "A3", "A2", "UNKNOWN"]


def test_more_scalars(spark):
    assert column(spark, T.navigation_path, ["A>B  > Software Update > Update"]) == ["(A > B > Software Update > Auto Update)"]
    assert column(spark, lambda x: T.pieces_from(x, ("One", "Two")), ["a One b Two c", "none"]) == [["One b", "Two c"], ["none"]]
    assert column(spark, T.list_marker, ["1.", "(2)", "3", "iv.", "b)", "※", "word"]) == ["decimal", "parenthesised", "number", "roman", "letter", "note", "none"]
    assert column(spark, T.after_parenthesis, ["). More", ")", "x"]) == ["More", "", "x"]
    assert column(spark, T.phone_tokens, ["call 1-800-ABC or 1-800-abc or 555-1234"]) == [["1-800-ABC", "555-1234"]]
    assert column(spark, lambda x: T.characters_in(x, ((0x0600, 0x06FF),)), ["aسلام", ""]) == [4, 0]
    assert column(spark, T.escaped, ["# a*b", "1. x", "plain"]) == [r"\# a\*b", r"1\. x", "plain"]
    assert tuple(column(spark, T.website, ["www.example.org (home)"])[0]) == ("www.example.org", "home")
