"""run() against the stages' operators applied by brute force to the smallest tables."""

from foliant.llm import bpe, queries, secrets
from tests.llm.test_edges import brute


def test_pipeline(spark):
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    docs = queries.table(spark, sf, "documents")
    good = corpus_pipeline.good_quality(spark, docs, sf)
    assert good.columns == docs.columns
    texts = {r.doc_id: r.text for r in good.collect()}
    first = {i for i, c in brute(list(texts.items()), 5).items() if i == c}
    net = secrets.train(secrets.findings())
    codec = bpe.tokenizer(*queries.vocabulary())
    want = {i: codec.encode(secrets.redacted(texts[i], net)) for i in first}
    out = corpus_pipeline.run(spark, sf).collect()
    assert {r.doc_id for r in out} == first and len(out) > len(first)
    assert all(r.ids == want[r.doc_id] and r.n_tokens == len(r.ids) for r in out)


ODD = [
    (1, "good words make a long and useful text about the of and things", "en", "s", 60), (1, "good words make a long and useful text about the of and things", "en", "s", 60), (1, "another text of id one", "de", None, None),
    (2, None, None, None, None), (3, "", "fr", "s", 0), (None, "no id here but some words", "en", "s", 25), (None, None, None, None, None), (4, "token = abcdefgh12345678 " + "word wörd " * 20_000, "en", "s", 200_025), (5, " \n ", "xx", "s", 3),
]


def test_stages_on_odd_rows(spark):
    """Every stage on nulls, empty and long texts, repeats and clashing columns keeps its columns and what it must keep."""
    import corpus_pipeline
    from pyspark.sql import functions as F

    sf = "/root/testdata/sf0.001"
    docs = spark.createDataFrame(ODD, "doc_id long, text string, lang string, source string, n_chars long")
    wide = docs.select("*", *[F.lit(f"{c}!").alias(c) for c in ("label", "score", "kept", "_once", "_times", "domain", "tokens", "id", "a.b")])
    good = corpus_pipeline.good_quality(spark, wide, sf)
    assert good.columns == wide.columns and 0 < good.count() <= len(ODD)
    single = corpus_pipeline.without_copies(spark, wide, sf)
    assert single.columns == wide.columns
    assert sorted(r.doc_id or 0 for r in single.collect()) == [0, 0, 1, 2, 3, 4, 5]
    clean = corpus_pipeline.without_secrets(spark, wide, sf)
    rows = clean.collect()
    assert clean.columns == wide.columns and len(rows) == len(ODD) and sum(r.text is None for r in rows) == 2
    long = next(r for r in rows if r.doc_id == 4)
    assert long.text.startswith("[secret] word") and long.n_chars == len(long.text)
    mixed = corpus_pipeline.to_weights(spark, wide, sf)
    assert mixed.columns == wide.columns and {r.doc_id for r in mixed.collect()} == {r[0] for r in ODD}
    told = corpus_pipeline.to_tokens(spark, wide, sf).collect()
    assert len(told) == len(ODD) and all(r.n_tokens == len(r.ids) for r in told) and sum(r.n_tokens == 0 for r in told) == 3
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, wide.limit(0), sf).count() == 0


def test_mixing_stage_moves_languages_towards_their_weights(spark):
    import corpus_pipeline
    from pyspark.sql import functions as F

    sf = "/root/testdata/sf0.01"
    docs = queries.table(spark, sf, "documents")
    out = corpus_pipeline.to_weights(spark, docs, sf)

    def shares(df):
        n = {r.lang: r.n for r in df.groupBy("lang").agg(F.sum(F.size(F.split("text", r"\\s+"))).alias("n")).collect() if r.lang in queries.WEIGHTS}
        return {k: v / sum(n.values()) for k, v in n.items()}

    off = lambda s: sum(abs(s[k] - w) for k, w in queries.WEIGHTS.items())
    assert off(shares(out)) < 0.5 * off(shares(docs))
    assert out.select("doc_id").distinct().count() == docs.select("doc_id").distinct().count()
