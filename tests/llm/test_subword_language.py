import random

from windrow.llm import subword_language as sl

WORDS = {
    "en": "the of and thing house water ship bright with this".split(),
    "de": "der die und nicht zwischen Haus über schön mit dem".split(),
    "fr": "le la et maison être où très avec ceux château".split(),
}


def corpus(make_docs, n=150):
    r = random.Random(4)
    rows = []
    for k in range(n):
        lang = list(WORDS)[k % 3]
        rows.append((k, " ".join(r.choice(WORDS[lang]) for _ in range(r.randint(4, 50))), lang, "s", None, 0, "", 0.0, 0))
    return make_docs(rows), {r[0]: r[2] for r in rows}


def test_held_out_accuracy(make_docs, crc_of):
    docs, langs = corpus(make_docs)
    got = sl.identified(docs).collect()
    assert all(r.held_out == (crc_of(r.doc_id) % 4 == 2) for r in got)
    assert all(r.lang_pred == langs[r.doc_id] for r in got if r.held_out)


def test_messy_rows_and_stage(messy, messy_rows, make_docs):
    docs, _ = corpus(make_docs, 60)
    both = docs.unionByName(messy.where("doc_id is null or doc_id > 12").withColumn("doc_id", messy.doc_id + 1000))
    got = sl.identified(both).collect()
    assert len(got) == both.count()
    by_id = {r.doc_id: r for r in got}
    for k in (1013, 1014, 1015, 1016):  # null and letterless
        assert (by_id[k].lang_pred, by_id[k].score, by_id[k].accepted) == ("und", 0.0, False)
    assert by_id[1022].lang_pred != "und"  # letters beyond Latin
    kept = sl.accepted(both)
    assert kept.columns == messy.columns and kept.count() == sum(r.accepted for r in got)


def test_no_language_and_no_rows(messy, no_docs):
    from pyspark.sql import functions as F

    got = sl.identified(messy.withColumn("lang", F.lit(None).cast("string"))).collect()
    assert {(r.lang_pred, r.score) for r in got} == {("und", 0.0)}
    assert sl.identified(no_docs).count() == 0
