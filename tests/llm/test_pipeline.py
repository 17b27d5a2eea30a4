"""The pipeline's stages one after another on a small corpus with planted cases."""

from __future__ import annotations

import random

import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from tests.llm.test_operators import _labelled, _prose, _repeats


def test_stages_take_effect_and_keep_clean_documents(spark, tmp_path):
    rows, labels = _labelled(spark)
    rows = [r for r in rows if r[0] < 900 and r[1] != "twice"]
    junk = [(3000 + k, "BUY!! " * 3 + " ".join(w.upper() + "!!" for w in _prose(k, 40).split())) for k in range(150)]
    long = _prose(77, 400)
    near = long.split()
    near[200] = "other"
    passage = _prose(78, 60)
    copies = [(4000, long), (4001, long), (4002, " ".join(near))]
    shared = [(4010 + k, f"{_prose(500 + k, 120)} {passage} {_prose(600 + k, 90)}") for k in range(3)]
    table = [(k, t, "en", "src0", len(t or "")) for k, t in [*rows, *junk, *copies, *shared, (4100, None), (4101, "")]]
    spark.createDataFrame(table, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")

    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    seen = []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, str(tmp_path))
        out.write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        if k < 4:
            assert docs.columns == corpus_pipeline.COLUMNS
            seen.append({r["doc_id"]: r["text"] for r in docs.collect()})
    toxic = {k for k, _ in rows if k % 4 == 0}
    clean = {k for k, _ in rows if k % 4} | {4000, 4001, 4002, 4010, 4011, 4012}
    assert len(toxic & set(seen[0])) <= 0.02 * len(toxic) and len(clean - set(seen[0])) <= 0.01 * len(clean)
    assert len({k for k, _ in junk} & set(seen[1])) <= 8 and len(clean - set(seen[1])) <= 0.03 * len(clean)
    assert {4001, 4002}.isdisjoint(seen[2]) and 4000 in seen[2] and set(seen[1]) - set(seen[2]) == {4001, 4002}
    want = _repeats([(t or "").encode() for t in seen[2].values()], corpus_pipeline.PASSAGE)
    assert seen[3] == {k: (w[4].decode("utf-8", "ignore") if w[1] else t) for (k, t), w in zip(seen[2].items(), want)}
    assert all(passage not in seen[3][k] and len(seen[3][k]) > 500 for k in (4010, 4011, 4012))
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    pieces = {}
    for r in sorted(docs.collect(), key=lambda r: r["start"]):
        pieces.setdefault(r["doc_id"], []).extend(r["ids"])
    assert pieces == {k: [*library.encode(t or "", add_special_tokens=False).ids, 1] for k, t in seen[3].items()}


def test_an_empty_corpus_passes_through(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


DOCUMENT = "doc_id long, text string, lang string, source string, n_chars long"


def _short_words(seed, n):
    rng = random.Random(seed)
    return " ".join("".join(rng.choice("abcdefghijklmnop") for _ in range(rng.choice([2, 3]))) for _ in range(n))


def test_passages_of_over_fifty_short_words_go(spark):
    passage, below = _short_words(1, 51), _short_words(2, 50)
    assert len(passage) < corpus_pipeline.PASSAGE
    texts = {k: (f"Q{k} {_prose(700 + k, 90)} K{k}", f"Z{k} {_prose(800 + k, 40)}é") for k in range(4)}
    rows = [(k, f"{a} {passage if k < 2 else below} {b}", "en", "s", 9) for k, (a, b) in texts.items()]
    rows += [(10, "no " * 60, "en", "s", 9), (11, _short_words(3, 51), "en", "s", 9)]
    got = {r["doc_id"]: r for r in corpus_pipeline.without_repeats(spark, spark.createDataFrame(rows, DOCUMENT), "").collect()}
    want = {r[0]: r[1] for r in rows} | {k: f"{texts[k][0]}  {texts[k][1]}" for k in range(2)} | {10: " "}
    assert {k: r["text"] for k, r in got.items()} == want
    assert all(got[k]["n_chars"] == len(want[k]) for k in (0, 1, 10))


def test_repeated_and_null_ids_keep_their_clean_texts(spark):
    a, b, c, d, e, near = (_prose(900 + k, 120) for k in range(6))
    copy = near.split()
    copy[60] = "other"
    copy = " ".join(copy)
    rows = [(1, near), (5, a), (5, copy), (6, b), (6, c), (None, d), (None, e), (None, copy), (None, d), (7, a), (8, None), (8, ""), (None, ""), (None, "")]
    docs = spark.createDataFrame([(k, t, "en", f"s{n}", n) for n, (k, t) in enumerate(rows)], DOCUMENT)
    out = corpus_pipeline.without_near_copies(spark, docs, "")
    assert out.columns == corpus_pipeline.COLUMNS
    want = [(1, near), (5, a), (6, b), (6, c), (None, d), (None, e), (8, None), (8, ""), (None, ""), (None, "")]
    assert sorted(map(repr, ((r["doc_id"], r["text"]) for r in out.collect()))) == sorted(map(repr, want))

    passage = _prose(950, 60)
    rows = [(k, t, f"s{n}", n) for n, (k, t) in enumerate(
        [(5, f"{a} {passage} {b}"), (5, c), (5, None), (6, f"{d} {passage} {e}"), (None, near), (None, ""), (None, f"{_prose(951, 50)} {passage}")])]
    out = corpus_pipeline.without_repeats(spark, spark.createDataFrame([(k, t, "en", s, n) for k, t, s, n in rows], DOCUMENT), "")
    assert out.columns == corpus_pipeline.COLUMNS
    got = {r["source"]: r for r in out.collect()}
    assert len(got) == out.count() == len(rows)
    for k, t, s, n in rows:
        assert got[s]["doc_id"] == k
        if t and passage in t:
            assert passage not in got[s]["text"] and len(got[s]["text"]) < len(t) - len(passage) + 1 and got[s]["n_chars"] == len(got[s]["text"])
        else:
            assert (got[s]["text"], got[s]["n_chars"]) == (t, n)
