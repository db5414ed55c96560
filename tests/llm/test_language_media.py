import hashlib
import zlib

import pytest

from quadrille.llm import common, langid, media


def test_held_out_accuracy(spark, sf):
    df = spark.read.parquet(f"{sf.replace('0.001', '0.01')}/documents.parquet")
    got = langid.languages(df).join(df.selectExpr("doc_id as id", "lang"), "id").collect()
    held = [r for r in got if r["held_out"]]
    assert {r["held_out"] for r in got if zlib.crc32(str(r["id"]).encode()) % 5 == 0} == {True}
    assert sum(r["lang"] == r["lang_pred"] for r in held) >= 0.97 * len(held)


def test_words_then_shorter_grams():
    m = langid.Model([("en", "the house the house"), ("fr", "la maison la maison")])
    assert m.predict("the house")[0] == "en" and m.predict("houses")[0] == "en" and m.predict("maisonnette")[0] == "fr"
    assert m.predict("123 !") == ("und", 0.0) and m.predict(None) == ("und", 0.0) and langid.Model([]).predict("word") == ("und", 0.0)
    assert all(0 <= m.predict(t)[1] <= 1 for t in ("a", "zzz", "é", "the la"))


def test_number_signs_are_no_letters():
    m = langid.Model([("en", "the house the house"), ("fr", "la maison la maison")])
    assert all(m.predict(t) == ("und", 0.0) for t in ("½", "²", "Ⅷ", "①② 3", "_ ٣", "\u0301"))
    assert all(m.predict(t)[0] != "und" for t in ("½ a", "ª", "中", "一", "x²"))
    for c in map(chr, range(0x3000)):
        assert bool(langid._words(c)) == any(x.isalpha() for x in c.lower())


def test_every_labelled_language_is_learnt(docs):
    long = "zum beispiel " * 30_000
    rows = [(i, f"word{i} " * 3, f"l{i:04d}", "s") for i in range(1500) if zlib.crc32(str(i).encode()) % 5] + [(2001, long, "de", "s")]
    m = langid.train(docs(rows), docs=100)
    assert len(m.langs) == len(rows) and m.predict("beispiel")[0] == "de"


def test_batches_and_full_caches_change_nothing(monkeypatch):
    monkeypatch.setattr(langid, "_CACHE", 5)
    m = langid.Model([("en", "the house the house"), ("fr", "la maison la maison")])
    texts = [None, "", "12", *(f"the maison h{'o' * k}use ma{chr(97 + k)}" for k in range(20)), "the house " * 100_000]
    lang, score = m.predict_all(texts)
    one = [m.predict(t) for t in texts]
    assert [a for a, _ in one] == m.names(lang) and [b for _, b in one] == score.tolist()


def test_odd_rows(docs, odd):
    got = langid.languages(docs(odd)).collect()
    assert len(got) == len(odd) and {r["lang_pred"] for r in got if r["id"] in (1, 2, 3, 4)} == {"und"}
    assert [r["held_out"] for r in got if r["id"] is None] == [False]
    kept = langid.identified(docs(odd))
    assert sorted(r["doc_id"] or 0 for r in kept.collect()) == [0, 5, 6, 6, 7, 8, 9]
    assert langid.languages(docs([])).count() == 0 and langid.identified(docs([])).count() == 0


def payload(text):
    data = (text or "").encode()
    return data + b" " * (192 * max(1, -(-len(data) // 192)) - len(data))


def test_round_trip(spark, docs, odd, tmp_path):
    folder = f"file://{tmp_path}/a"
    archives = media.store(docs(odd), folder)
    members = media.load(spark, archives, folder, split=1000)
    want = sorted((r[0] or 0, len((r[1] or "").encode()), payload(r[1])) for r in odd)
    assert sorted((r["id"] or 0, r["n_bytes"], bytes(r["payload"])) for r in members.collect()) == want
    for r in media.described(members).collect():
        p = next(x[2] for x in want if x[0] == (r["id"] or 0))
        assert (r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-16:]))
    empty = media.store(docs([]), f"file://{tmp_path}/b")
    assert media.load(spark, empty, f"file://{tmp_path}/b").count() == 0


def test_members_are_retried_by_offset(tmp_path):
    a = media._Archive(f"file://{tmp_path}/x.arc")
    pictures = [media.encode(payload(t)) for t in ("one", "two" * 300)]
    for k, p in enumerate(pictures):
        a.add(k, 3, p)
    a.close()
    reader = media._Reader({"listing": "", "retries": "2"})
    fs, path = media.pafs.FileSystem.from_uri(f"file://{tmp_path}/x.arc")
    real, calls = media.zlib.crc32, []

    def flaky(data, *rest):
        calls.append(1)
        return 0 if len(calls) == 1 else real(data, *rest)

    media.zlib.crc32 = flaky
    try:
        got, tries = reader._member(fs, path, len(pictures[0]), len(pictures[1]), real(pictures[1]))
    finally:
        media.zlib.crc32 = real
    assert (got, tries) == (pictures[1], 2)
    with pytest.raises(OSError):
        reader._member(fs, path, 1, 5, 0)
    with pytest.raises(ValueError):
        media.decode(pictures[0][:-1] + b"x")


def test_shared_folder_is_the_one_named(spark, tmp_path):
    spark.conf.set("spark.checkpoint.dir", f"file://{tmp_path}") if spark.conf.isModifiable("spark.checkpoint.dir") else None
    assert common.shared_dir(spark)


def test_texts_stay_without_a_labelled_row(docs):
    rows = [(i, t, None, "s") for i, t in enumerate(["some words", "more words", "12 34", None])]
    got = {r["doc_id"]: r["lang"] for r in langid.identified(docs(rows)).collect()}
    assert got == {0: None, 1: None}
