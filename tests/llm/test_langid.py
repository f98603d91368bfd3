import random

from pyspark.sql import functions as F

from loomwright.llm import langid

SYLLABLES = {"en": "th er on an re he in ed nd".split(), "de": "sch en er ung ich ein ge ver".split(), "fr": "ou ai eau que é tion ment".split(), "es": "ción os la ado ar es ñ".split()}


def texts(n):
    rng = random.Random(7)
    rows = []
    for i in range(n):
        lang = list(SYLLABLES)[i % 4]
        rows.append((i, " ".join("".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randint(1, 4))) for _ in range(40)), lang))
    return rows


def test_held_out_accuracy(spark):
    rows = texts(240)
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    held = langid.fold(F.col("doc_id"), 3) == 1
    model = langid.train(df.where(~held), 400)
    assert model.families == ["germanic", "romance"]
    out = langid.identify(df.where(held).drop("lang"), model).collect()
    truth = {r[0]: r[2] for r in rows}
    assert out and all(r.lang_pred == truth[r.doc_id] for r in out)
    assert all(0 <= r.score <= 1 for r in out)


def test_texts_without_letters_and_clashing_columns(spark):
    df = spark.createDataFrame(texts(40), "doc_id long, text string, lang string")
    model = langid.train(df, 100)
    odd = spark.createDataFrame([(1, None, 5), (2, "", 5), (3, "12 ... !", 5), (3, "12 ... !", 5), (None, "th er on an the", 5)], "doc_id long, text string, score int")
    out = langid.identify(odd, model).orderBy("doc_id").collect()
    assert [(r.lang_pred, r.score) for r in out[1:]] == [("und", 0.0)] * 4
    assert out[0].lang_pred == "en" and len(out) == 5


def test_nothing_to_learn_from(spark):
    none = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert langid.train(none) is None
    one = spark.createDataFrame([(1, "abc")], "doc_id long, text string")
    assert langid.identify(one, None).first().lang_pred == "und"
    single = langid.train(spark.createDataFrame([(1, "abc abc", "xx"), (2, "abd", "xx")], "doc_id long, text string, lang string"))
    assert langid.identify(one, single).first().lang_pred == "xx"


def test_unknown_language_joins_the_nearest_family(spark):
    rows = [(i, t, "zz" if lang == "de" and i % 8 == 1 else lang) for i, t, lang in texts(160)]
    model = langid.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert "zz" in model.languages[model.families.index("germanic")]


def test_sample_stays_bounded(spark, monkeypatch):
    sizes, fit = [], langid.fit
    monkeypatch.setattr(langid, "fit", lambda x, langs: sizes.append(len(langs)) or fit(x, langs))
    own = spark.createDataFrame(texts(400), "doc_id long, text string, lang string")
    no_id = own.selectExpr("cast(null as long)", "concat(text, ' x')", "lang")
    same = spark.range(400).selectExpr("cast(7 as long)", "'th er on'", "'en'")
    assert langid.train(own.union(no_id).union(same), 200) is not None
    assert 130 < sizes[0] < 270
