"""Texts without a letter have no language."""

from auditloom.llm import language_id


def test_numbers_are_no_letters(spark):
    docs = spark.createDataFrame([(1, "plain words of a text", "en"), (2, "des mots de la langue", "fr")], "doc_id long, text string, lang string")
    odd = spark.createDataFrame([(1, "½ ² ①"), (2, "Ⅷ"), (3, "12 _ !"), (4, None), (5, ""), (6, "words ½")], "doc_id long, text string")
    got = {r.doc_id: r for r in language_id.identify(odd, language_id.fit(docs)).collect()}
    assert [got[i].lang_pred for i in range(1, 7)] == ["und"] * 5 + ["en"]
    assert all(got[i].rejected and got[i].score == 0 for i in range(1, 6))


def test_scores_are_exact_cosines_to_the_nearest_centroid(spark):
    import numpy as np

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    model = language_id.corpus_model(docs)
    units = model.centroids / np.maximum(np.linalg.norm(model.centroids, axis=0), 1e-12)
    for r in language_id.identify(docs.select("doc_id", "text"), model).collect():
        if not any(c.isalpha() for c in r.text or ""):
            assert r.lang_pred == "und"
            continue
        at, counts = language_id.grams(r.text)
        dense = np.zeros(1 << language_id.BITS)
        dense[at] = np.sqrt(counts) * model.idf[at]
        cosines = dense / np.linalg.norm(dense) @ units
        assert abs(cosines.max() - r.score) < 1e-4 and cosines[model.owner == model.langs.index(r.lang_pred)].max() > cosines.max() - 1e-4
