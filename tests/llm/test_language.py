import random
import zlib

import numpy as np
from corpus import SMALL, documents, edge_texts, sentence, small

from regimen.llm import language, queries


def plain_grams(text):
    out = ""
    for ch in " " + (text or "").lower() + " ":
        if ch.isalpha():
            out += ch
        elif not out.endswith(" "):
            out += " "
    return [out[i:i + language.GRAM] for i in range(len(out) - language.GRAM + 1)]


def test_grams_are_those_of_the_plain_way():
    texts = ["Abc  de!! f", None, "", "12 34", "é", "Éa b", "  x", "hello wörld 9 it", *[x for _, x in edge_texts() if x and len(x) < 5000]]
    hashes, first, has = language.gram_hashes(texts)
    seen = {}
    for k, text in enumerate(texts):
        grams = plain_grams(text)
        assert len(grams) == first[k + 1] - first[k]
        assert all(seen.setdefault(g, h) == h for g, h in zip(grams, hashes[first[k]:first[k + 1]].tolist()))
        assert has[k] == any(c.isalpha() for c in text or "")
    assert len(set(seen.values())) == len(seen)


def test_filters_of_more_than_64_languages():
    names = [f"l{k:02d}" for k in range(70)]
    model = language.Filters(names, [language.gram_hashes([sentence(k, 200)])[0] for k in range(70)])
    got, scores = model.predict([sentence(k, 200) for k in range(70)] + ["12 !", None])
    assert got == names + ["und", "und"] and min(scores[:70]) > 0.99 and scores[70:] == [0.0, 0.0]


def test_held_out_accuracy(spark):
    got = {r["doc_id"]: r for r in queries.op10_language_id(spark, SMALL).collect()}
    lang = {r["doc_id"]: r["lang"] for r in small(spark, "documents").collect()}
    assert got.keys() == lang.keys()
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) and 0 <= r["score"] <= 1 for i, r in got.items())
    held = [i for i in got if got[i]["held_out"]]
    assert held and np.mean([got[i]["lang_pred"] == lang[i] for i in held]) >= 0.95


def test_edges(spark):
    rows = edge_texts()
    docs = documents(spark, rows, ["aa" if k % 2 else None for k in range(len(rows))])
    got = language.identify(docs)
    assert set(docs.columns) <= set(got.columns)
    seen = [(r["text"], r["lang_pred"], r["score"]) for r in got.collect()]
    assert len(seen) == len(rows)
    for text, lang, score in seen:
        assert (lang == "und") == (not any(c.isalpha() for c in text or "")) and (lang != "und" or score == 0)
    assert {r["lang_pred"] for r in language.identify(documents(spark, rows)).collect()} == {"und"}      # nothing to learn from
    assert language.identify(docs.where("false")).collect() == []


def _told(docs, **more):
    return {r["doc_id"]: (r["lang_pred"], r["score"]) for r in language.identify(docs, **more).collect()}


def test_language_of_one_row(spark):
    """One labelled row is enough to learn from, also beside a language of very many rows."""
    ids = [k for k in range(600) if zlib.crc32(str(k).encode()) % 5]
    rare, mixed, many = ids[0], ids[1], ids[2:302]
    words = sentence(1, 300).split()                       # a language has a vocabulary; random letters have none
    rows = [(k, " ".join(random.Random(k).choices(words, k=90))) for k in many]
    rows += [(rare, "ukuthi abantu bayakwazi ngempela lapho kusihlwa"), (mixed, rows[0][1]), (900, "lapho abantu bayakwazi ukuthi"), (901, rows[5][1])]
    langs = ["aa"] * len(many) + ["zu", "xx", None, None]
    for max_rows in (5_000, 20):
        told = _told(documents(spark, rows, langs), max_rows=max_rows)
        assert told[900][0] == "zu" and told[900][1] > 0.5 and told[rare][0] == "zu"
        assert told[901][0] == "aa" and told[901][1] > 0.9
        assert sum(told[k][0] == "aa" for k in many) >= len(many) - 1


def test_sample_is_bounded_by_language(spark):
    rows = [(k, sentence(k, 5)) for k in range(400)] + [(7, "copy")] * 300
    langs = ["aa" if k % 50 else "bb" for k in range(400)] + ["aa"] * 300
    docs = documents(spark, rows, langs)
    usable = [lang for (k, _), lang in zip(rows, langs) if zlib.crc32(str(k).encode()) % 5]
    sample, sizes = language.sampled(docs, 30)
    got = [r["lang"] for r in sample.collect()]
    assert sizes == {x: usable.count(x) for x in ("aa", "bb")}
    assert got.count("bb") == min(30, sizes["bb"]) and 0 < got.count("aa") <= 30
