import random
import zlib

import numpy as np

from lodeglass.llm import language_id, queries

ALPHABETS = {"aa": "abcdefghij", "bb": "fghijklmno", "cc": "αβγδεζηθ", "zh": "天地玄黄宇宙洪荒"}


def corpus(n=160):
    rng = random.Random(5)
    rows = []
    for i in range(n):
        lang = list(ALPHABETS)[i % 4]
        rows.append((i, " ".join("".join(rng.choice(ALPHABETS[lang]) for _ in range(rng.randint(1, 9))) for _ in range(30)), lang))
    return rows


def vectors(dim, n):
    letters = {}

    def of(gram):
        out = np.ones(dim, int)
        for k, c in enumerate(gram):
            if c not in letters:
                letters[c] = 2 * np.random.Generator(np.random.Philox(key=ord(c))).integers(0, 2, dim) - 1
            out = out * np.roll(letters[c], n - 1 - k)
        return out

    return of


def brute(rows, texts, dim=256, n=3):
    """The same prediction with plain loops over every n-gram's occurrence."""
    of = vectors(dim, n)

    def bundle(text):
        out = np.zeros(dim, int)
        for w in "".join(c if c.isalpha() else " " for c in text.lower()).split():
            for i in range(len(w) + 3 - n):
                out += of(f" {w} "[i : i + n])
        return out

    known = {}
    for _, text, lang in rows:
        known[lang] = known.get(lang, 0) + bundle(text)
    out = []
    for text in texts:
        v = bundle(text or "")
        size = np.linalg.norm(v)
        near = {x: round(float(v @ p) / size / np.linalg.norm(p), 9) if size else 0 for x, p in known.items()}
        best = min(near, key=lambda x: (-near[x], x))
        out.append((best, max(0.0, near[best])) if size else ("und", 0.0))
    return out


def test_predictions_equal_brute_force(spark):
    rows = corpus(80)
    texts = [t for _, t, _ in corpus(120)] + ["x²y Ab½c", "ÀÉ straße", "a", None, "", "12 _ ?", "天地" * 50]
    learnt = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = language_id.with_language(docs, learnt, "found", dim=256).orderBy("doc_id").collect()
    assert [(r.found.lang, round(r.found.score, 9)) for r in got] == brute(rows, texts)


def test_vectors_beyond_those_kept_are_the_same():
    texts = [t for _, t, _ in corpus(30)]
    few, many = language_id.Profiles(64, 3, most=20), language_id.Profiles(64, 3)
    for _ in range(3):
        assert (few.bundles(texts, list(range(30)), 30) == many.bundles(texts, list(range(30)), 30)).all()


def test_held_out_accuracy_and_what_is_learnt_from(spark, tmp_path):
    rows = corpus()
    turned = [(i, t, "zz" if zlib.crc32(str(i).encode()) % 4 == 2 else lang) for i, t, lang in rows]
    found = []
    for name, table in (("a", rows), ("b", turned)):
        spark.createDataFrame(table, "doc_id bigint, text string, lang string").write.parquet(f"{tmp_path}/{name}/documents.parquet")
        found.append(sorted(tuple(r) for r in queries.op11_language_id(spark, f"{tmp_path}/{name}").collect()))
    assert found[0] == found[1]
    held = [r for r in found[0] if r[1]]
    assert len(held) > 20 and all(r[1] == (zlib.crc32(str(r[0]).encode()) % 4 == 2) for r in found[0])
    assert np.mean([lang == rows[i][2] for i, _, lang, _ in held]) > 0.95


def test_odd_rows(spark, docs_of):
    texts = [None, "", "123 ...", "same text", "same text", "long " * 200_000, "x" * 300_000]
    docs = docs_of(texts, ids=[1, 1, None, 3, 3, 4, None])
    learnt = spark.createDataFrame([(1, None, "aa"), (2, "some text", None), (3, "same text long", "aa"), (4, "qqq www", "bb"), (5, "123", "cc")], "doc_id bigint, text string, lang string")
    got = language_id.with_language(docs, learnt, "lang").collect()
    assert [r.lang.lang for r in got][:3] == ["und"] * 3 and got[3].lang == got[4].lang and got[3].lang.lang == "aa"
    assert [c for c in docs.columns if c != "lang"] == [c for c in language_id.with_language(docs, learnt, "lang").columns if c != "lang"]
    nothing = language_id.with_language(docs, learnt.filter("false")).collect()
    assert {tuple(r.language) for r in nothing} == {("und", 0.0)}
    assert language_id.with_language(docs.filter("false"), learnt).count() == 0


def test_languages_are_summed_in_parts_alike(spark):
    rows = corpus(60)
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    one, many = (sorted((r.lang, r.vector) for r in language_id.prototypes(docs.repartition(k), dim=128).collect()) for k in (1, 13))
    assert one == many
