"""Sources, sinks and operators that the driver's tables cannot show: files, bundles, limits."""

import json
import os
import xml.etree.ElementTree as ET

import pytest
from pyspark.sql import functions as F

from foliant.operators import align, hints, nodes, repairs, stats
from foliant.sources import profiles, sinks


def profile(token, languages="ENG;FRA", kind="BOOK", count=2, **more):
    return {"source_token": token, "languages": languages, "doc_type": kind, "language_count": count, **more}


def saved(tmp_path, rows):
    path = tmp_path / "profiles.json"
    path.write_text(json.dumps(rows))
    return str(path)


def test_load_takes_the_last_row_of_a_token(spark, tmp_path):
    path = saved(tmp_path, [profile("A_L02", region="R", buyer_codes="a; b;"), profile("B_L02"), profile("A_L02", "SPA; ENG ;", region="S", buyer_codes="")])
    got = {r.source_token: r for r in profiles.load(spark, path).collect()}
    assert set(got) == {"A_L02", "B_L02"} and got["A_L02"].languages == ["SPA", "ENG"] and got["A_L02"].region == "S" and got["A_L02"].buyer_codes == []


def test_strict_load_names_the_first_fault(spark, tmp_path):
    fine = [profile("ZA_L02"), profile("ZB_ENG", "ENG", "A2", 1), profile("ZC_MENA", "ENG;ARA")]
    got = {r.source_token: r.languages for r in profiles.strict_load(spark, saved(tmp_path, fine)).collect()}
    assert got == {"ZA_L02": ["ENG", "FRA"], "ZB_ENG": ["ENG"], "ZC_MENA": ["ENG", "ARA"]}
    for row, fault in ((profile("za_l02"), "token_shape"), (profile("ZA_L02"), "token_repeated"), (profile("ZD_MENA", "ARA;ENG"), "combination_differs"), (profile("ZD_L03"), "token_contradicts"), (profile("ZD_L02", count="2"), "count_not_a_number"), (profile("ZD_L02", colour=1), "field_unexpected"), ("text", "not_an_object")):
        with pytest.raises(ValueError, match=fault):
            profiles.strict_load(spark, saved(tmp_path, [*fine, row]))
    with pytest.raises(ValueError, match="at least one"):
        profiles.strict_load(spark, saved(tmp_path, []))


def test_bundle_is_published_whole_or_not_at_all(spark, tmp_path):
    path = str(tmp_path / "out" / "bundle")
    a, b = spark.createDataFrame([(1, "x"), (1, "x"), (2, None)], "i int, s string"), spark.range(5).toDF("n")
    prints = sinks.write_bundle({"a": a, "b": b}, path)
    assert set(prints) == {"a", "b"} and sorted(os.listdir(path)) == ["_COMMITTED", "a", "b"]
    back = sinks.read_bundle(spark, path)
    assert sorted(map(tuple, back["a"].collect()), key=str) == sorted(map(tuple, a.collect()), key=str) and back["b"].count() == 5
    with pytest.raises(FileExistsError):
        sinks.write_bundle({"a": a}, path)
    broken = spark.range(3).select(F.raise_error(F.lit("no")).cast("int").alias("x"))
    with pytest.raises(Exception, match="no"):
        sinks.write_bundle({"a": a, "c": broken}, str(tmp_path / "out" / "second"))
    assert os.listdir(tmp_path / "out") == ["bundle"]
    spark.createDataFrame([(9, "y")], "i int, s string").write.mode("append").parquet(f"{path}/a")
    with pytest.raises(ValueError, match="not what was committed"):
        sinks.read_bundle(spark, path)


def test_fingerprints_do_not_depend_on_order(spark):
    rows = [(i % 7, f"t{i % 5}") for i in range(100)]
    df = spark.createDataFrame(rows, "a int, b string")
    assert sinks.fingerprint(df) == sinks.fingerprint(spark.createDataFrame(rows[::-1], "a int, b string").repartition(3))
    assert sinks.fingerprint(df) != sinks.fingerprint(df.limit(99)) and sinks.fingerprint(df.limit(0)).startswith("0")


def test_xml_reads_back_with_another_parser(spark):
    texts = ["a < b & c > d", 'say "x"', "bell \x07", "line\nend\ttab\rcr", "é日😀", ""]
    attribute = "array<struct<name: string, value: string>>"
    rows = [(1, [0], "section", [(f"t{i}", x) for i, x in enumerate(texts[:2])] + [("none", None)]), (1, [0, 1], "p", [("q", texts[3])]), (1, [1], "p", [("odd", texts[2])])]
    n = spark.createDataFrame(rows, f"doc int, path array<int>, tag string, attributes {attribute}")
    f = spark.createDataFrame([(1, [0, 0], texts[0]), (1, [0, 1, 0], texts[4]), (1, [0, 1, 1], texts[3]), (1, [1, 0], texts[2]), (1, [1, 1], "")], "doc int, path array<int>, text string")
    xml = sinks.xml_documents(n, f, ["doc"])
    root = ET.fromstring(xml.first().xml)
    assert [e.tag for e in root.iter()] == ["document", "section", "text", "p", "text", "text", "p", "text", "text"]
    assert [e.text for e in root.iter("text")][:3] == [texts[0], texts[4], texts[3]] and root.find("section/p").get("q") == texts[3] and root.findall("p")[0].get("odd-base64")
    assert [r.text for r in sinks.xml_texts(xml, ["doc"]).orderBy("nth").collect()] == [texts[0], texts[4], texts[3], texts[2], ""]


def test_json_keeps_nulls_and_no_odd_numbers(spark):
    df = spark.createDataFrame([(1, None, 1.5), (2, "x", float("nan")), (3, "y", float("inf"))], "i int, s string, v double")
    got = {r.i: json.loads(r.json) for r in sinks.json_lines(df, ["i"]).collect()}
    assert got == {1: {"s": None, "v": 1.5}, 2: {"s": "x", "v": None}, 3: {"s": "y", "v": None}}


def test_medians_of_large_groups_against_plain_python(spark):
    import random
    import statistics

    rng = random.Random(4)
    rows = [(k, rng.choice([1.0, 2.5, rng.random() * 1000]), rng.randrange(1, 4)) for k in ("a", "b", None) for _ in range(rng.randrange(1, 900))] + [("c", 5.0, 2), ("d", None, 1)]
    df = spark.createDataFrame(rows, "k string, v double, w int")
    groups = {}
    for k, v, w in rows:
        if v is not None:
            groups.setdefault(k, []).extend([v] * w)
    low = {r.k: r.median for r in stats.weighted_median_lower(df, ["k"], "v", "w").collect()}
    mid = {r.k: r.median for r in stats.weighted_median_mid(df, ["k"], "v", "w").collect()}
    assert low == {k: statistics.median_low(v) for k, v in groups.items()} and mid == {k: statistics.median(v) for k, v in groups.items()}


def test_routes_and_breaks():
    items = ["Go to (Home > ", None, " Settings > Sound). Then"]
    assert hints.route_evidence(items, 1) == (2, True, [0, 2])
    assert hints.route_evidence(["a > b", None, "c"], 1) is None and hints.route_evidence(items, 0) is None and hints.route_evidence(["no mark ", None, " here"], 1) is None
    assert hints.route_evidence(["x. ", None, " > A > B"], 1) == (2, False, [0, 2])
    assert hints.route_bounds("a. b! > c. No. d e.g. x") == [10]
    assert hints.flow_breaks(["One. Two", "goes on. Three", ""]) == [[], [9], []]
    assert hints.flow_breaks([]) == []


def earliest(a, b):
    """The expected places of a longest common subsequence that come first of all, by trying every choice."""
    from itertools import combinations

    def within(x):
        rest = iter(b)
        return all(y in rest for y in x)

    for n in range(len(a), -1, -1):
        for chosen in combinations(range(len(a)), n):
            if within([a[i] for i in chosen]):
                return list(chosen)


def test_routes_against_a_plain_reading():
    """One character after the other, on random flows."""
    import random

    rng = random.Random(8)

    def plain(items, at):
        flat, spot = "", 0
        for i, t in enumerate(items):
            spot = len(flat) if i == at else spot
            flat += hints.FIGURE if t is None else t
        cuts = [0, *hints.route_bounds(flat), len(flat)]
        lo, hi = max(c for c in cuts if c <= spot), min(c for c in cuts if c > spot)
        near = []
        for step in (-1, 1):
            i = at + step
            while 0 <= i < len(items) and items[i] is not None and not items[i].strip():
                i += step
            near.append((items[i] or "").strip() if 0 <= i < len(items) else "")
        label = hints.labelled(flat[spot + 1 :].split(">")[0].split(hints.FIGURE)[0])
        if flat.count(">", lo, hi) < 2 or not any(c.isalnum() for c in flat[lo:hi]) or not (label or any(">" in (t[:1], t[-1:]) for t in near)):
            return None
        level, levels = 0, []
        for c in flat[lo:hi]:
            level += {"(": 1, ")": -1}.get(c, 0)
            levels.append(level)
        return flat.count(">", lo, hi), label or (min(levels) >= 0 and level == 0 and levels[spot - lo] > 0)

    hits = 0
    for _ in range(3000):
        items = [None if rng.random() < 0.3 else "".join(rng.choice("> > > ab( ) .") for _ in range(rng.randrange(7))) for _ in range(rng.randrange(1, 6))]
        for at in [i for i, t in enumerate(items) if t is None]:
            got = hints.route_evidence(items, at)
            assert (got and got[:2]) == plain(items, at), (items, at)
            hits += got is not None
    assert hits > 50


def test_alignment_covers_both_sequences():
    import random

    rng = random.Random(3)
    for _ in range(300):
        a, b = (["xyz"[rng.randrange(3)] for _ in range(rng.randrange(7))] for _ in range(2))
        pairs = hints.aligned(a, b)
        assert [i for i, _ in pairs if i is not None] == list(range(len(a))) and [j for _, j in pairs if j is not None] == list(range(len(b)))
        common = hints.anchors(a, b)
        assert [i for i, _ in common] == earliest(a, b)
        assert len(common) == align.lcs_length("".join(a), "".join(b)) and all(a[i] == b[j] for i, j in common)


def test_boxes_and_cycles(spark):
    boxes = [[1.0, 2.0, 3.0, 4.0], [1.0, 2.0, 1.0, 4.0], [1.0, 2.0, 3.0, float("nan")], [1.0, 2.0, 3.0], None]
    df = spark.createDataFrame([(i, b) for i, b in enumerate(boxes)], "i int, b array<double>").orderBy("i")
    assert [r[0] for r in df.select(nodes.is_box(F.col("b"))).collect()] == [True, False, False, False, False]
    edges = spark.createDataFrame([(1, 10, 0, 11, None), (1, 11, 0, 10, None), (1, 11, 1, 12, 5)], "doc int, ref int, ord int, child int, page int")
    found, faults = repairs.walked(edges, spark.createDataFrame([(1, 10, 3)], "doc int, ref int, page int"), ["doc"])
    assert {(tuple(r.path), r.ref, r.page) for r in found.collect()} == {((0,), 10, 3), ((0, 0), 11, 3), ((0, 0, 1), 12, 5)}
    assert [(tuple(r.path), r.code) for r in faults.collect()] == [((0, 0, 0), "structure_cycle")]


def test_comparisons_within_their_limits():
    import random

    rng = random.Random(9)
    for _ in range(200):
        a, b = ("".join(rng.choice("abc ") for _ in range(rng.randrange(30))) for _ in range(2))
        n = align.lcs_length(a, b)
        assert align.sparse_lcs_length(a, b) == n
        want = n / len(a) if a else float(not b)
        assert align.comparison(a, b) == (want, "masks")
        if a and b:
            assert align.comparison(a, b, mask_bytes=0) == (want, "places")
            assert align.comparison(a, b, mask_bytes=0, pair_bytes=0) == (None, "beyond_limits")


def test_saved_reviews(spark, tmp_path):
    from foliant.sources import reviews

    cell = {"row": 1, "column": 2, "role": "content", "reading_order": 2, "text": "a", "review_items": [{"item_order": 1, "kind": "body", "text": "a"}, {"kind": "body", "text": "b"}]}
    page = {"page_number": 3, "review_order": 1, "language": "ENG", "page_role": "content", "cells": [cell, {**cell, "review_items": []}]}
    (tmp_path / "r.json").write_text(json.dumps({"file_name": "f", "source_token": "t", "language": "ENG", "doc_type": "A2", "pages": [page]}))
    got = reviews.read(spark, str(tmp_path / "r.json"))
    assert reviews.cells(got).count() == 2
    assert [(r.page_number, r.cell_order, r.item_order, r.text) for r in reviews.items(got).orderBy("item_order").collect()] == [(3, 2, 1, "a"), (3, 2, 2, "b")]
    pages = spark.createDataFrame([(1, 2, "b"), (1, 1, "a"), (1, 3, None)], "doc int, page int, text string")
    assert reviews.baselines(pages, ["doc"]).first().text == "a\nb\n"


def test_mapping_file_is_found_once(tmp_path):
    deep = tmp_path / "a" / "b"
    deep.mkdir(parents=True)
    with pytest.raises(FileNotFoundError, match="0 files"):
        profiles.find_mapping(str(deep), "odd-mapping.json")
    (tmp_path / "odd-mapping.json").write_text("[]")
    assert profiles.find_mapping(str(deep / "file.pdf"), "odd-mapping.json") == str(tmp_path / "odd-mapping.json")
    (deep / "odd-mapping.json").write_text("[]")
    with pytest.raises(FileNotFoundError, match="2 files"):
        profiles.find_mapping(str(deep), "odd-mapping.json")
