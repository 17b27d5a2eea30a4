"""Vector codes, language profiles and periodic runs against brute force on small tables with odd rows."""

from __future__ import annotations

import hashlib
import random
import zlib
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from ringwatch.llm import language, periodic_runs, vector_codes

DOC = "doc_id long, text string, lang string, score double, runs string, n long, `__text` string"


def _docs(spark, rows):
    """Rows (id, text, lang) with columns whose names the operators use themselves."""
    return spark.createDataFrame([(k, t, g, 0.5, "x", 7, "y") for k, t, g in rows], DOC)


# vector codes


def _codes(rows, parts=8, entries=16, rounds=6):
    """Codes and errors by full search in whole Python numbers."""
    kept = sorted(((i, [int(np.floor(4096 * float(x))) for x in v]) for i, v in rows), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    width = len(kept[0][1]) // parts
    cut = [(i, [tuple(v[p * width : (p + 1) * width]) for p in range(parts)]) for i, v in kept]
    books = [[list(v[p]) for _, v in cut[:entries]] for p in range(parts)]

    def nearest(p, part):
        return min((sum((a - b) ** 2 for a, b in zip(part, entry)), e) for e, entry in enumerate(books[p]))

    for _ in range(rounds):
        for p in range(parts):
            falls = [nearest(p, v[p])[1] for _, v in cut]
            for e in set(falls):
                mine = [v[p] for (_, v), f in zip(cut, falls) if f == e]
                books[p][e] = [sum(x) // len(mine) for x in zip(*mine)]
    out = []
    for i, v in cut:
        found = [nearest(p, v[p]) for p in range(parts)]
        out.append((i, "".join(f"{e:02x}" for _, e in found), sum(d for d, _ in found)))
    text = ",".join(str(x) for book in books for entry in book for x in entry)
    return out, hashlib.sha256(text.encode()).hexdigest()


def _vectors(n, width=32, seed=3):
    rng = np.random.default_rng(seed)
    middle = rng.normal(size=(12, width))
    return [(k, (middle[k % 12] + 0.2 * rng.normal(size=width)).astype(np.float32).tolist()) for k in range(n)]


def test_vector_codes_equal_a_full_search(spark):
    rows = _vectors(300)
    rows += [(400, [0.0] * 32), (401, rows[5][1]), (5, rows[9][1]), (-3, [-2.5] * 32), (402, [1e30] + [0.0] * 31), (None, [0.25] * 32)]
    odd = [(500, None), (501, [float("nan")] * 32), (502, [1.0] * 31 + [None]), (503, [float("inf")] + [0.0] * 31), (504, []), (505, [1.0] * 8)]
    frame = spark.createDataFrame([(i, v, "c", 1.0, k % 3 if k % 5 else None) for k, (i, v) in enumerate(rows + odd)],
                                  "vec_id long, embedding array<float>, code string, error double, label int").repartition(7)
    coded, books = vector_codes.compress(frame, columns=("label",))
    got = vector_codes.with_label_error(coded).collect()
    held = [(i, [min(x, 2**30 // 4 / 4096) for x in v]) for i, v in rows]
    want, digest = _codes(held)
    assert sorted(((r["vec_id"], r["code"], r["error"]) for r in got), key=repr) == sorted(want, key=repr)
    assert books.digest() == digest
    total = {}
    for r in got:
        total[r["label"]] = total.get(r["label"], 0) + r["error"]
    assert None in total and all(r["label_error"] == total[r["label"]] for r in got)


def test_vector_codes_of_few_no_and_uneven_vectors(spark, monkeypatch):
    schema = "vec_id long, embedding array<float>, label int"
    coded, books = vector_codes.compress(spark.createDataFrame([], schema), columns=("label",))
    assert vector_codes.with_label_error(coded).count() == 0 and books.entries.size == 0
    few = spark.createDataFrame([(1, [1.0, 2.0, 3.0], 4), (2, [1.0, 2.0, 3.0], None), (2, [5.0, 2.0, 3.0], None)], schema)
    monkeypatch.setattr(vector_codes, "FEW_LABELS", 0)  # the salted join
    coded, books = vector_codes.compress(few, columns=("label",))
    got = sorted((r["vec_id"], r["code"], r["error"], r["label_error"]) for r in vector_codes.with_label_error(coded).collect())
    assert got == [(1, "00" * 8, 0, 0), (2, "00" * 8, 0, 0), (2, "02" + "00" * 7, 0, 0)]


def test_equal_average_search_takes_the_first_of_equal_entries():
    rng = np.random.default_rng(1)
    for width in (1, 3, 8):
        parts, entries = rng.integers(-6, 7, (500, width)), rng.integers(-6, 7, (16, width))
        far = ((parts[:, None] - entries[None]) ** 2).sum(axis=2)
        chosen, best = vector_codes.nearest_entries(parts, entries)
        assert (chosen == far.argmin(axis=1)).all() and (best == far.min(axis=1)).all()


# languages


def _speech(seed, sounds, n):
    rng = random.Random(seed)
    return " ".join("".join(rng.choice(sounds) for _ in range(rng.randrange(2, 4))) for _ in range(n))


TONGUES = {"aa": "ba be lo ru mi ten".split(), "bb": "sch ung ei ver ich lau".split(), "cc": "да не ло ру ми тен".split()}


def _profile(texts, width):
    """Prototype by the definition: rotate, multiply, add up, letter by letter."""
    total = np.zeros(width, dtype=np.int64)
    letters = language.Letters(width)

    def vector(c):
        place = int(letters.places(np.array([ord(c)]))[0])
        return letters.rows[0, place].astype(np.int64)

    for text in texts:
        plain = " " + "".join(c if c.isalpha() else " " for c in text.lower()) + " "
        plain = " " + " ".join(plain.split()) + " "
        for a, b, c in zip(plain, plain[1:], plain[2:]):
            total += np.roll(vector(a), 2) * np.roll(vector(b), 1) * vector(c)
    return total


def test_profiles_follow_the_definition(spark):
    texts = [(k, _speech(k, TONGUES[g], 30 + k), g) for k, g in enumerate(["aa", "bb", "cc", "aa", "bb"])]
    model = language.train(_docs(spark, texts).repartition(3), width=256)
    assert model.languages == ["aa", "bb", "cc"]
    for k, g in enumerate(model.languages):
        own = _profile([t for _, t, h in texts if h == g], 256)
        assert np.allclose(model.prototypes[k], own / np.linalg.norm(own))
    long = _speech(9, TONGUES["aa"], 400) + " 12 -- " + _speech(8, TONGUES["cc"], 10)
    letters = language.Letters(256, known=4000)
    parts = sum(letters.bundle(t, c) for t, c in language.sequences(long, letters, piece=64))
    assert (parts == _profile([long], 256)).all() and (parts == language.text_vector(long, letters)).all()
    got = {r["doc_id"]: r for r in language.identify(_docs(spark, [(1, long, None)]), model).collect()}[1]
    cosine = model.prototypes @ parts / np.linalg.norm(parts)
    assert got["lang_pred"] == "aa" and got["score"] == pytest.approx(cosine.max(), abs=1e-12)


def test_languages_of_unseen_and_odd_texts(spark):
    known = [(k, _speech(k, TONGUES[g], 60), g) for k, g in enumerate(list(TONGUES) * 20)]
    known += [(900, None, "aa"), (901, "12", "zz"), (902, _speech(1, TONGUES["aa"], 5), None), (None, None, None)]
    model = language.train(_docs(spark, known))
    assert model.languages == list(TONGUES)
    new = [(k, _speech(1000 + k, TONGUES[g], 12), g) for k, g in enumerate(list(TONGUES) * 20)]
    odd = [(200, None), (201, ""), (202, "  12 ... \n"), (203, "一二三" * 3000), (204, "ß"), (204, "ß"), (None, "ba be"), (205, _speech(5, TONGUES["bb"], 90_000))]
    got = language.identify(_docs(spark, [(k, t, "x") for k, t, _ in new] + [(k, t, "x") for k, t in odd]), model).collect()
    by = {r["doc_id"]: r for r in got}
    assert len(got) == len(new) + len(odd) and all(0 <= r["score"] <= 1 for r in got)
    assert sum(by[k]["lang_pred"] == g for k, _, g in new) == len(new)
    assert [(by[k]["lang_pred"], by[k]["score"]) for k in (200, 201, 202)] == [("und", 0.0)] * 3
    assert by[205]["lang_pred"] == "bb" and by[None]["lang_pred"] == "aa" and all(by[k]["lang_pred"] != "und" for k in (203, 204))
    none = language.train(_docs(spark, []))
    assert language.identify(_docs(spark, []), none).count() == 0
    assert [r["lang_pred"] for r in language.identify(_docs(spark, [(1, "ba", "aa")]), none).collect()] == ["und"]


def test_more_letters_than_are_remembered():
    text = "".join(chr(0x4E00 + k * 7 % 9000) for k in range(30_000))
    little, much = language.Letters(128, known=3072), language.Letters(128, known=20_000)
    assert (language.text_vector(text, little) == language.text_vector(text, much)).all()


# periodic runs


def _runs(words, least=24, periods=3):
    out = []
    for q in range(1, len(words) // 2 + 1):
        i = 0
        while i < len(words) - q:
            start = i
            while i < len(words) - q and words[i] == words[i + q]:
                i += 1
            length = i + q - start
            if i > start and length >= max(least, periods * q):
                smaller = any(all(words[k] == words[k + d] for k in range(start, start + length - d)) for d in range(1, q))
                out += [] if smaller else [(start, length, q)]
            i += i == start
    return sorted(out, key=lambda r: (r[0], r[2]))


def test_runs_of_random_words_equal_brute_force():
    rng = random.Random(4)
    for _ in range(1500):
        words = [b"w%d" % rng.randrange(rng.choice([1, 2, 3, 30])) for _ in range(rng.randrange(90))]
        if rng.random() < 0.7 and len(words) > 10:
            a, p = rng.randrange(len(words)), rng.randrange(1, 9)
            for i in range(a + p, min(len(words), a + rng.randrange(5, 70))):
                words[i] = words[i - p]
        least, periods = rng.choice([(24, 3), (6, 3), (4, 2), (12, 2), (9, 4), (3, 3)])
        assert periodic_runs.text_runs(words, least, periods) == _runs(words, least, periods)
    a, b = [b"a"], [b"a", b"b"]
    while len(b) < 400:
        a, b = b, b + a
    assert periodic_runs.text_runs(b, 6, 3) == _runs(b, 6, 3)


def _expected(doc_id, text):
    words = (text or "").encode().split()
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    n, g = len(words), h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = words[:a] + [words[a + (i - a) % p] for i in range(a, n)]
    runs = _runs(words)
    gone = {k for s, length, q in runs for k in range(s + q, s + length)}
    rest = b" ".join(w for k, w in enumerate(words) if k not in gone)
    best = max(runs, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=None)
    told = "".join(f"{s},{length},{q}\n" for s, length, q in runs)
    return (doc_id, len(runs), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None,
            hashlib.sha256(told.encode()).hexdigest(), hashlib.sha256(rest).hexdigest())


def test_periodic_runs_of_documents_equal_brute_force(spark, tmp_path):
    rng = random.Random(8)
    made = [k for k in range(4000) if zlib.crc32(str(k).encode()) % 10 == 0][:40]
    texts = [(k, " ".join(f"w{rng.randrange(400)}" for _ in range(rng.choice([1, 3, 90, 180, 250]))), None) for k in [*made, *range(5001, 5040)]]
    words = texts[-1][1].split()
    texts += [(6000, "a  b\tc\n" * 40 + "\x85 é\xa0x", None), (6001, None, None), (made[0], "", None), (made[1], None, None), (6002, " \n", None),
              (None, "x " * 50, None), (6003, "x " * 50 + "y " * 30, None), (6003, "x " * 50 + "y " * 30, None),
              (6004, " ".join(words + words[:40] * 3 + words), None), (6005, "ab " * 3000, None)]
    _docs(spark, texts).repartition(5).write.parquet(str(tmp_path / "documents.parquet"))
    got = periodic_runs.op13_periodic_runs(spark, str(tmp_path)).collect()
    assert sorted(map(tuple, got), key=repr) == sorted((_expected(k, t) for k, t, _ in texts), key=repr)
    assert sum(r["n_runs"] > 0 for r in got) > 15
    none = periodic_runs.periodic_runs(_docs(spark, []))
    assert none.count() == 0
    with pytest.raises(ValueError):
        periodic_runs.periodic_runs(_docs(spark, []), periods=1)


def test_long_periodic_texts_end_soon():
    rng = random.Random(2)
    part = [b"w%d" % rng.randrange(50) for _ in range(15_000)]
    assert periodic_runs.text_runs(part * 4) == [(0, 60_000, 15_000)]
    assert periodic_runs.text_runs([b"x"] * 60_000) == [(0, 60_000, 1)]


def _packed(headers, payload, told=True):
    import gzip

    from ringwatch.llm import warc

    data = warc.record(headers, payload)
    return warc.member(data) if told else gzip.compress(data)


def test_large_payloads_are_read_in_linear_time_and_rejected_ones_are_not_inflated():
    import io
    import os
    import time

    from ringwatch.llm import warc

    big = os.urandom(1 << 20) * 64
    for packed in (True, False):
        make = _packed if packed else lambda h, p: warc.record(h, p)
        data = make({"WARC-Type": "response"}, big) + make({"WARC-Type": "last"}, b"x")
        begin = time.time()
        got = [(h["warc-type"], p) for h, p in warc.records(io.BytesIO(data), packed, None, lambda h: True, True)]
        assert got == [("response", big), ("last", b"x")] and time.time() - begin < 20
    noise = os.urandom(400_000)
    spoilt = bytearray(_packed({"WARC-Type": "response", "A": "1"}, noise))
    spoilt[200_000:200_400] = os.urandom(400)
    for told in (True, False):
        body = bytes(spoilt) if told else _packed({"WARC-Type": "response", "A": "1"}, noise, False)
        data = _packed({"WARC-Type": "info"}, b"", told) + body + _packed({"WARC-Type": "revisit"}, b"y" * 70_000, told) + body + _packed({"WARC-Type": "end"}, b"z")
        got = [(h["warc-type"], p) for h, p in warc.records(io.BytesIO(data), True, None, lambda h: h["warc-type"] != "response", True)]
        assert got == [("info", b""), ("revisit", b"y" * 70_000), ("end", b"z")]
        heads = [h["warc-type"] for h, _ in warc.records(io.BytesIO(data), True, None, lambda h: True, False)]
        assert heads == ["info", "response", "revisit", "response", "end"]
    cut = _packed({"WARC-Type": "info"}, b"a") + _packed({"WARC-Type": "response"}, noise)[:300_000]
    assert [h["warc-type"] for h, _ in warc.records(io.BytesIO(cut), True, None, lambda h: True, True)] == ["info"]
    import gzip

    assert gzip.decompress(_packed({"A": "b"}, noise)) == warc.record({"A": "b"}, noise)


def test_revisits_of_a_page_that_a_third_of_all_rows_share(spark, tmp_path):
    from ringwatch.llm import warc

    hot = "h" * 1200
    rows = [(k, f"http://a/{k}", hot if k % 3 == 0 else f"{k}" * 400) for k in range(600)] + [(None, "http://n", hot), (0, "http://again", hot), (300, "http://other", "o" * 1500)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = warc.archive_rows(pages).select(F.col("headers")["WARC-Target-URI"].alias("url"), F.col("headers")["WARC-Refers-To"].alias("to"), F.length("payload").alias("n")).collect()
    assert len(got) == len(rows)
    by = {r["url"]: (r["to"], r["n"]) for r in got}
    for page_id, url, html in rows:
        again = html == hot and page_id is not None and page_id != 597
        assert by[url] == (("<urn:page:597>", 0) if again else (None, len(html)))
