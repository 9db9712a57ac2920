import zlib

from foliospark.llm import langid as G

EN = "the weather in the north of the country was cold and the people who lived there stayed inside their houses with the windows closed"
DE = "das wetter im norden des landes war kalt und die menschen die dort lebten blieben in ihren häusern bei geschlossenen fenstern"


def test_held_out_accuracy_and_cases(spark, odd):
    def cut(s, i):
        w = s.split()
        return " ".join(w[i % len(w) :] + w[: i % len(w)])

    rows = [(i, cut(EN if i % 2 else DE, i), "en" if i % 2 else "de") for i in range(200)]
    rows += [(900, "1234 !!", "en"), (901, None, "de"), (902, "", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    dictionaries = G.learn_dictionaries(docs)
    assert set(dictionaries) == {"en", "de"}
    got = {r.doc_id: r for r in G.identify(docs, dictionaries).collect()}
    assert all(got[i].lang_pred == lang for i, _, lang in rows[:200])
    assert all((got[k].lang_pred, got[k].score, got[k].rejected) == ("und", 0.0, True) for k in (900, 901, 902))
    assert all(r.held_out == (zlib.crc32(str(k).encode()) % 3 == 1) and 0 <= r.score <= 1 for k, r in got.items())
    assert len(G.identify(odd, dictionaries).collect()) == odd.count()
    assert G.identify(odd, G.learn_dictionaries(odd.limit(0))).where("lang_pred <> 'und'").count() == 0
    assert G.identify(odd.limit(0), dictionaries).count() == 0


def test_narrow_margins_are_rejected():
    c = G.Classifier({"a": EN.encode(), "b": EN.encode()})
    assert c("the weather was cold") == ("a", 0.0)
    assert G.Classifier({"a": EN.encode()})("the")[1] == 1.0
