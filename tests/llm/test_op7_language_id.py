import numpy as np
from pyspark.sql import functions as F
from texts import prose

from pagelens.llm import common as C
from pagelens.llm import language_id as L
from pagelens.llm.queries import QUERIES

LEX = {"en": "the of and that with this which have".split(), "de": "der die und nicht mit ist ein auch".split(), "fr": "le les dans avec pour est une été".split(), "es": "el los con para que una está niño".split()}


def corpus(spark):
    rows = [(i, prose(i, 5 + i % 40, LEX[lang]), lang) for i, lang in ((k, list(LEX)[k % 4]) for k in range(400))]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string")


def test_held_out_accuracy(spark):
    got = L.identify(corpus(spark)).collect()
    held = [r for r in got if r.held_out]
    assert np.mean([r.lang_pred == list(LEX)[r.doc_id % 4] for r in held]) > 0.98
    assert all(0 <= r.score <= 1 for r in got)
    table = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang")
    out = QUERIES["op7_language_id"](spark, "/root/testdata/sf0.01").join(table, "doc_id").where("held_out")
    assert out.where("lang = lang_pred").count() >= 0.98 * out.count() > 0


def test_predictions_do_not_depend_on_the_batch(spark):
    df = corpus(spark)
    one = {r.doc_id: (r.lang_pred, r.score) for r in L.identify(df.coalesce(1)).collect()}
    assert one == {r.doc_id: (r.lang_pred, r.score) for r in L.identify(df.repartition(7)).collect()}


def test_odd_rows(spark, odd, empty):
    got = L.identify(odd)
    rows = {r.doc_id: r for r in got.collect()}
    assert got.count() == odd.count()
    assert all(rows[i].lang_pred == "und" and rows[i].score == 0 for i in (0, 1, 2)) and rows[3].lang_pred in ("en", "fr")
    assert L.identify(empty).count() == 0
    assert {r.lang_pred for r in L.identify(odd.withColumn("lang", odd.lang.substr(1, 0)).where("false").union(odd).selectExpr("doc_id", "text", "cast(null as string) lang")).collect()} == {"und"}


def test_family_comes_first():
    x = [(np.array([k], np.uint16), np.ones(1, np.float16)) for k in range(6)]
    model = L.fitted(x, ["en", "de", "fr", "es", "xx", "en"])
    assert model.levels[""] == ("germanic", "romance", "xx") and model.levels["germanic"] == ("de", "en") and ("romance", "es", "fr") in model.pairs


def test_sampling_draws_at_any_number_of_rows(spark):
    for rows, of in ((300, 1_000_000), (300, 10**10), (3000, 10**13), (1, 10**15)):
        assert 0 < C.limit_for(rows, of) / C.SHARES * of <= rows
    assert C.limit_for(300, 200) == C.SHARES
    df = spark.range(200_000)
    assert 200 < df.where(C.drawn(F.lit(C.limit_for(300, 200_000)), "language", "id")).count() < 400
    # as if there were 10**10 rows of each language: a table of 2 * 10**5 of them draws next to none, but the share isn't 0
    assert df.where(C.drawn(F.lit(C.limit_for(300, 10**10)) * 10**5, "language", "id")).count() > 0


def test_more_than_64_languages(spark):
    rows = [(k * 100 + i, f"{chr(97 + k % 26)}{chr(97 + k // 26)}x{chr(97 + k % 26)}q " * 12, f"l{k:02}") for k in range(70) for i in range(5)]
    got = L.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()
    assert {r.lang_pred for r in got} == {r[2] for r in rows} and all(r.lang_pred == f"l{r.doc_id // 100:02}" for r in got)
