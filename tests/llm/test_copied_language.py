"""Languages of few texts in many copies are learned like others."""

from gridspan.llm import language


def test_copies_do_not_crowd_out_a_language(spark):
    rows = [(n, f"the cat and the dog number {n} went home again", "en") for n in range(4000)]
    rows += [(10000 + n, f"der hund und die katze gehen heim {'abcdefghijklmnopqrst'[n % 20] * 3}", "de") for n in range(60000)]
    rows += [(100000 + n, "le chat et le chien rentrent chez eux ce soir", "fr") for n in range(10000)]
    rows += [(200000 + n, "il gatto e il cane tornano a casa insieme" if n == 4999 else f"{n} !?", "it") for n in range(5000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4)
    sample = language.training_sample(docs, "doc_id", "text", "lang")
    assert {lang: len(xs) for lang, xs in sample.items()} == {"de": 20, "en": 512, "fr": 1, "it": 1}
    asked = spark.createDataFrame([(1, "die katze und der hund", None), (2, "le chien et le chat", None)], "doc_id long, text string, lang string")
    got = {r.doc_id: r.lang_pred for r in language.identify(docs.unionByName(asked)).filter("doc_id < 3").collect()}
    assert got[2] == "fr"
