"""The operators of the training-data part against brute force on small tables with odd rows."""

from __future__ import annotations

import hashlib
import math
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from ringwatch.llm import byte_bpe, components, embedding_dedup, licenses, minhash, nearest, packing, quality, suffix_dedup, tokens, toxicity, warc

DOC = "doc_id long, text string, score double, bucket string, n long, spans string"
WORDS = "the of and river stone green house walks under bright long winter summer field open gate slow fast bird tree".split()


def _prose(seed: int, n: int) -> str:
    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) + rng.choice(["", "", "s", "ing", "ed"]) + str(rng.randrange(40)) for _ in range(n))


def _docs(spark, texts):
    """Texts as documents, with columns whose names the operators use themselves."""
    return spark.createDataFrame([(k, t, 0.5, "b", 7, "x") for k, t in texts], DOC)


def _odd():
    base = _prose(1, 300)
    near = base.split()
    near[150] = "changed"
    rows = [(1, None), (2, ""), (3, "  \n "), (4, "one"), (5, "one"), (6, base), (7, base), (8, " ".join(near)), (9, _prose(2, 200)),
            (10, _prose(3, 120) + " " + _prose(1, 300)[:600] + " " + _prose(4, 50)), (11, "a" * 2000), (12, "é" * 700), (7, base),
            (13, _prose(5, 4000)), (14, "One"), (15, "two words"), (16, "Two  words")]
    return rows


def _components(n, links):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return [find(x) for x in range(n)]


def test_components_of_chains_stars_and_loops(spark):
    links = [(k, k + 1) for k in range(60)] + [(100, k) for k in range(101, 160)] + [(200, 200), (300, 301), (301, 300), (None, 4)]
    got = components.components(spark.createDataFrame(links, "a long, b long")).collect()
    groups = {}
    for r in got:
        groups.setdefault(r["root"], set()).add(r["node"])
    assert sorted(map(len, groups.values())) == [2, 60, 61]
    assert all(root in nodes for root, nodes in groups.items())
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("crowd", [minhash.CROWD, 1])
def test_minhash_finds_the_links_of_brute_force(spark, monkeypatch, crowd):
    monkeypatch.setattr(minhash, "CROWD", crowd)
    rng = random.Random(5)
    base = _prose(9, 150).split()
    rows = _odd()
    for k in range(20, 50):  # near copies of growing distance
        words = list(base)
        for _ in range(rng.randrange(1, 25)):
            words[rng.randrange(len(words))] = f"w{rng.randrange(9999)}"
        rows.append((k, " ".join(words)))

    def shingles(text):
        w = (text or "").encode().lower().split()
        return {tuple(w[i : i + 2]) for i in range(len(w) - 1)} if len(w) > 1 else {tuple(w)} - {()}

    sets = [shingles(t) for _, t in rows]
    links = [(i, j) for i in range(len(rows)) for j in range(i) if sets[i] and sets[j]
             and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])]
    place = _components(len(rows), links)
    smallest = {}
    for k, p in enumerate(place):
        smallest[p] = min(smallest.get(p, math.inf), rows[k][0])
    want = sorted((rows[k][0], len(sets[k]), smallest[p], rows[k][0] == smallest[p]) for k, p in enumerate(place))
    got = minhash.near_duplicates(_docs(spark, rows), words=2, percent=80).collect()
    assert sorted(map(tuple, got)) == want
    assert minhash.near_duplicates(_docs(spark, []), words=2).count() == 0


def _repeats(texts, length):
    seen = {}
    for t in texts:
        for i in range(len(t) - length + 1):
            seen[t[i : i + length]] = seen.get(t[i : i + length], 0) + 1
    out = []
    for t in texts:
        cover = np.zeros(len(t) + 1, dtype=int)
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                cover[i] += 1
                cover[i + length] -= 1
        gone = np.cumsum(cover)[: len(t)] > 0
        runs = int((np.diff(np.concatenate(([0], gone.astype(int)))) == 1).sum())
        kept = bytes(np.frombuffer(t, dtype=np.uint8)[~gone])
        out.append((len(t), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest(), kept))
    return out


@pytest.mark.parametrize("most", [suffix_dedup.MOST, 1])
def test_repeated_passages_equal_brute_force(spark, most):
    rows = _odd() + [(60, "ab" * 500), (61, "b" + "ab" * 300)]
    want = _repeats([(t or "").encode() for _, t in rows], 400)
    got = suffix_dedup.remove_repeats(_docs(spark, rows), 400, most=most).collect()
    assert sorted((r["doc_id"], *tuple(r)[1:5], bytes(r["kept"])) for r in got) == sorted((k, *w) for (k, _), w in zip(rows, want))
    assert suffix_dedup.remove_repeats(_docs(spark, [])).count() == 0


@pytest.mark.parametrize("most, piece", [(1, None), (7, 1 << 13), (40, None)])
def test_passages_around_one_frequent_seed(spark, monkeypatch, most, piece):
    if piece:
        monkeypatch.setattr(suffix_dedup, "_PIECE", piece)
    rng = random.Random(6)
    core, left, right = _prose(21, 14), [_prose(k, 60) for k in range(22, 26)], [_prose(k, 60) for k in range(26, 30)]
    rows = []
    for k in range(90):  # one passage that all have, with more or less of a few surroundings
        before, after = rng.choice(left)[-rng.randrange(330):], rng.choice(right)[: rng.randrange(330)]
        rows.append((k, f"{_prose(200 + k, 60)} {before}{core}{after} {_prose(400 + k, 60)}"))
    rows += [(200, _prose(31, 9000) + rows[3][1] + _prose(32, 3000)), (None, rows[5][1]), (201, _prose(31, 9000)), (None, None)]
    want = _repeats([(t or "").encode() for _, t in rows], 400)
    got = suffix_dedup.remove_repeats(_docs(spark, rows), 400, most=most).collect()
    assert sorted(((r["doc_id"], *tuple(r)[1:5], bytes(r["kept"])) for r in got), key=repr) == sorted(((k, *w) for (k, _), w in zip(rows, want)), key=repr)


def test_strings_of_frequent_seeds_are_told_without_a_shuffle(spark, monkeypatch):
    plans, stored, threshold = {}, suffix_dedup.stored, spark.conf.get("spark.sql.autoBroadcastJoinThreshold")

    def told(df, name):
        plans.setdefault(name, df._jdf.queryExecution().executedPlan().toString())
        return stored(df, name)

    monkeypatch.setattr(suffix_dedup, "stored", told)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)  # as if there were many seeds
    try:
        core, pair = _prose(41, 60), _prose(42, 60)
        rows = [(k, f"{_prose(500 + k, 60)} {core}{_prose(600 + k, 60)}") for k in range(12)]  # one seed of 12 strings
        rows += [(50 + k, f"{_prose(700 + k, 60)} {pair}{_prose(800 + k, 60)}") for k in range(2)]  # and one of two
        want = _repeats([t.encode() for _, t in rows], 400)
        got = suffix_dedup.remove_repeats(_docs(spark, rows), 400, most=4).collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    assert sorted((r["doc_id"], *tuple(r)[1:5], bytes(r["kept"])) for r in got) == sorted((k, *w) for (k, _), w in zip(rows, want))
    assert all(w[1] for w in want)
    assert not any(x in plans["suffix-halves"] for x in ("Exchange", "Join"))
    assert "LeftAnti" not in plans["suffix-spans"]


def test_sorted_columns_mark_recurring_strings():
    rng = np.random.default_rng(2)
    rows = rng.integers(97, 99, (40, 14), dtype=np.uint8)
    rows[3, 5:] = 255
    rows[9, 5:] = 255
    found = suffix_dedup.repeated_columns(rows, 6)
    for c in range(found.shape[1]):
        cells = [bytes(r[c : c + 6]) for r in rows]
        assert list(found[:, c]) == [255 not in x and cells.count(x) > 1 for x in cells]


def test_embedding_links_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "CHUNK", 8)
    rng = np.random.default_rng(4)
    rows = []
    for k in range(12):
        centre = rng.standard_normal(16)
        rows += [centre + rng.standard_normal(16) * s for s in (0, 0.05, 0.1, 0.2, 0.25)]
    rows += [rows[0], rows[0] * 3, -rows[0], np.zeros(16), np.full(16, 1e-30), np.full(16, 1e300)]
    vectors = [[float(x) for x in r] for r in rows] + [None, [], [math.nan] * 16, [math.inf] + [1.0] * 15, [None] + [1.0] * 15]
    table = [(k, v, 1, "x") for k, v in enumerate(vectors)]
    ok = [v is not None and len(v) > 0 and all(x is not None and math.isfinite(x) for x in v) and any(v) for v in vectors]
    unit = [np.array(v) / max(map(abs, v)) if good else None for v, good in zip(vectors, ok)]
    links = [(i, j) for i in range(len(rows)) for j in range(i) if ok[i] and ok[j]
             and unit[i] @ unit[j] / (np.linalg.norm(unit[i]) * np.linalg.norm(unit[j])) >= 0.95]
    place = _components(len(vectors), links)
    degree = [sum(k in x for x in links) for k in range(len(vectors))]
    got = embedding_dedup.near_duplicate_vectors(spark.createDataFrame(table, "vec_id long, embedding array<double>, label int, links string")).collect()
    assert sorted(map(tuple, got)) == [(k, degree[k], p, p == k) for k, p in enumerate(place)]
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert embedding_dedup.near_duplicate_vectors(empty).count() == 0


def test_nearest_neighbours_have_recall_and_exact_scores(spark):
    rng = np.random.default_rng(8)
    rows = rng.standard_normal((3000, 24)) + rng.standard_normal((30, 24))[rng.integers(0, 30, 3000)] * 2
    rows[5] = rows[0]
    rows[6] = rows[0]
    table = [(k, [float(x) for x in r], "x") for k, r in enumerate(rows)] + [(5000, None, "x"), (5001, [0.0] * 24, "x"), (5002, [math.nan] * 24, "x"), (5003, [1.0, 2.0], "x")]
    vectors = spark.createDataFrame(table, "vec_id long, embedding array<double>, rank string")
    got = nearest.nearest(vectors, vectors.where("vec_id % 100 = 0"), 10).collect()
    hits = 0
    for q in range(0, 3000, 100):
        far = np.sqrt(((rows - rows[q]) ** 2).sum(axis=1))
        far[q] = np.inf
        best = np.lexsort((np.arange(3000), far))[:10]
        own = sorted((r["rank"], r["vec_id"], r["score"]) for r in got if r["query_id"] == q)
        assert [r[0] for r in own] == list(range(1, len(own) + 1))
        assert all(abs(far[v] - s) < 1e-12 for _, v, s in own)
        hits += len({v for _, v, _ in own} & set(best.tolist()))
    assert hits >= 0.9 * 300
    assert [r["vec_id"] for r in sorted(got, key=lambda r: r["rank"]) if r["query_id"] == 0][:2] == [5, 6]
    few = vectors.where("vec_id < 4")
    assert nearest.nearest(few, few.where("vec_id = 0"), 10).count() == 3
    assert nearest.nearest(vectors.where("vec_id BETWEEN 4999 AND 5002"), vectors, 10).count() == 0


def test_queries_far_from_the_others_have_all_neighbours(spark):
    rng = np.random.default_rng(9)
    rows = rng.standard_normal((3000, 16))
    rows[:5] *= np.array([30, 60, 90, 200, 1000])[:, None]
    for count in (3000, 11, 6):
        vectors = spark.createDataFrame([(k, [float(x) for x in r]) for k, r in enumerate(rows[:count])], "vec_id long, embedding array<double>")
        got = nearest.nearest(vectors, vectors.where("vec_id < 5"), 10).collect()
        for q in range(5):
            far = np.sqrt(((rows[:count] - rows[q]) ** 2).sum(axis=1))
            far[q] = np.inf
            best = np.lexsort((np.arange(count), far))[: min(10, count - 1)]
            assert [r["vec_id"] for r in sorted(got, key=lambda r: r["rank"]) if r["query_id"] == q] == best.tolist()


def test_byte_tokens_equal_the_library(spark):
    path = public_tokenizers.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    rows = _odd() + [(70, "x'll say <|endoftext|> now " * 20), (71, "tab\tand  blanks \n\n end "), (72, "日本語" * 300 + "!?" * 100)]
    got = byte_bpe.encode_decode(_docs(spark, rows), path, leaf=200).collect()
    want = []
    for k, t in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids
        decoded = library.decode(ids, skip_special_tokens=False)
        want.append((k, ids, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), decoded, hashlib.sha256(decoded.encode()).hexdigest()))
    assert sorted(map(tuple, got)) == sorted(want)


def test_joined_halves_equal_the_whole():
    path = public_tokenizers.path("byte_bpe_50k.json")
    bpe = tokens.byte_tokens(path)
    words = tokens.word_tokens(public_tokenizers.path("word_bpe_49k.json"))
    letters = [". ", ",", "a", "b", "é", "1", "'", "'s", "'re", "!", "😀", "<|endoftext|>", " ", "\n", "\xa0", "the", "tion", "中", "aaaa", "Σ", "_.", "\0"]
    rng = random.Random(7)
    for turn in range(300):
        weights = [rng.random() ** 3 for _ in letters]
        if turn % 3:
            weights[0] = weights[12] = weights[13] = weights[14] = 0
        text = "".join(rng.choices(letters, weights, k=rng.randint(1, 200)))
        want = bpe.tokenizer.encode(text, add_special_tokens=False).ids
        halves = bpe.halves(text, rng.choice([5, 17, 60]))
        assert "".join(halves) == text
        assert bpe.join_all([bpe.encode(h) for h in halves]) == want == bpe.encode(text)
        assert bpe.decode(want) == text
        assert np.frombuffer(next(words.encode_all([text])), dtype="<u4").tolist() == words.tokenizer.encode(text, add_special_tokens=False).ids


def test_packing_places_every_token_once(spark):
    path = public_tokenizers.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    rows = [r for k, r in enumerate(_odd()) if k != 12] + [(100 + k, _prose(k, 10 + 7 * k)) for k in range(60)]
    got = packing.pack(_docs(spark, rows), path, window=512).collect()
    ids = {k: [*library.encode(t or "", add_special_tokens=False).ids, 1] for k, t in rows}
    seen = {k: 0 for k in ids}
    for r in sorted(got, key=lambda r: (r["doc_id"], r["start"])):
        own = ids[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert r["start"] == seen[r["doc_id"]] and r["ids"] == own and r["doc_tokens"] == len(ids[r["doc_id"]])
        assert r["ids_crc32"] == zlib.crc32(np.array(own, dtype="<u4").tobytes())
        seen[r["doc_id"]] += r["length"]
    assert seen == {k: len(v) for k, v in ids.items()}
    used = {}
    for r in sorted(got, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == used.get(r["sequence_id"], 0)
        used[r["sequence_id"]] = r["offset"] + r["length"]
    total = sum(seen.values())
    assert max(used.values()) <= 512 and len(used) <= total / 512 * 1.03 + 1
    assert packing.pack(_docs(spark, []), path).count() == 0


def test_best_fill_is_the_closest_sum():
    rng = random.Random(3)
    for _ in range(200):
        counts = {rng.randint(1, 40): rng.randint(1, 4) for _ in range(rng.randint(1, 6))}
        room = rng.randint(0, 90)
        sums = {0}
        for length, n in counts.items():
            sums = {s + length * k for s in sums for k in range(n + 1)}
        fill = packing.best_fill(counts, room)
        assert sum(k * v for k, v in fill.items()) == max(s for s in sums if s <= room)
        assert all(v <= counts[k] for k, v in fill.items())


def _labelled(spark):
    rows, marks = [], []
    rng = random.Random(11)
    for k in range(900):
        text = ". ".join(_prose(1000 * k + j, 8) for j in range(rng.randint(1, 6)))
        toxic = k % 4 == 0
        if toxic:
            text += f". You {rng.choice(['vile', 'nasty', 'awful'])} creature {k}. " + _prose(k + 7, 5)
        rows.append((k, text))
        marks.append((k, 1, int(toxic)))
    rows += [(2000, None), (2001, ""), (2002, "!!!"), (2003, _prose(1, 20_000)), (3, "twice")]
    return rows, spark.createDataFrame(marks, "doc_id long, quality int, toxic int")


def test_toxicity_of_held_out_documents_and_sentences(spark):
    rows, labels = _labelled(spark)
    docs = _docs(spark, rows)
    model = toxicity.train_on(docs, labels)
    got = toxicity.score(docs, model, columns=("doc_id", "text", "n")).collect()
    assert len(got) == len(rows)
    held = {r["doc_id"] for r in docs.where(toxicity.held_out()).collect()}
    judged = [r for r in got if r["doc_id"] in held and r["doc_id"] < 900 and r["text"] != "twice"]
    wrong = sum((r["score"] >= 0.3) != (r["doc_id"] % 4 == 0) for r in judged)
    assert len(judged) > 150 and wrong <= 0.03 * len(judged)
    for r in judged:
        for s in r["sentences"]:
            assert "creature" in r["text"].encode()[s["begin"] : s["end"]].decode()
    scores = {r["doc_id"]: r["score"] for r in got}
    assert scores[2000] == scores[2001] == scores[2002] == 0 and scores[2003] < 0.3
    none = toxicity.train_on(docs, labels.where("toxic = 0"))
    assert toxicity.score(docs, none).where("score > 0.01").count() == 0
    assert toxicity.score(_docs(spark, []), model).count() == 0


def test_quality_of_held_out_documents(spark):
    rows, labels = _labelled(spark)
    junk = [(3000 + k, " ".join(w.upper() + "!!" for w in _prose(k, 40).split()) if k % 2 else "buy buy buy now now now " * (5 + k % 9)) for k in range(200)]
    docs = _docs(spark, rows + junk)
    model = quality.train_on(docs, labels)
    got = {r["doc_id"]: r["score"] for r in quality.score(docs, model).collect()}
    assert all(0 <= s <= 1 for s in got.values()) and set(got) == {k for k, _ in rows + junk}
    held = [k for k in range(900) if zlib.crc32(str(k).encode()) % 5 == 0]
    assert sum(got[k] < 0.3 for k in held) <= 0.05 * len(held)
    assert sum(got[k] >= 0.3 for k, _ in junk) <= 0.05 * len(junk)
    assert 0.6 <= model.prior <= 0.95  # 905 of 1105 texts
    assert quality.score(_docs(spark, []), model).count() == 0
    assert quality.score(docs, quality.train_on(_docs(spark, []), labels)).count() == len(rows) + 200


def test_archive_round_trip_revisits_and_push_down(spark, tmp_path):
    big, other = "<p>é</p>" * 300, "x" * 999
    pages = spark.createDataFrame(
        [(1, "http://a/1", big, "k"), (2, "http://a/2", big, "k"), (9, None, big, "k"), (9, "http://b/9", big, "k"), (3, "http://a/3", other, "k"),
         (4, "http://b/4", other, "k"), (5, "http://b/5", None, "k"), (6, "http://b/6", "", "k"), (7, "http://b/7\n", "\r\n\r\nWARC/1.1\r\n", "k"),
         (8, "http://b/8", "y" * 300_000, "k")], "page_id long, url string, html string, headers string")
    for compression in ("gzip", "none"):
        path = f"{tmp_path}/{compression}"
        warc.write_archive(warc.archive_rows(pages).coalesce(1), path, compression, split=1000)
        read = warc.read_archive(spark, path)
        assert read.rdd.getNumPartitions() > 2
        rows = {}
        for r in read.collect():
            rows.setdefault(r["record_id"], []).append(r)
        assert sorted(len(v) for v in rows.values()) == [1] * 8 + [2]
        assert bytes(rows["<urn:page:8>"][0]["payload"]) == b"y" * 300_000
        assert bytes(rows["<urn:page:7>"][0]["payload"]) == b"\r\n\r\nWARC/1.1\r\n"
        assert rows["<urn:page:9>"][0]["record_type"] == "response" and bytes(rows["<urn:page:9>"][0]["payload"]).decode() == big
        assert rows["<urn:page:1>"][0]["record_type"] == "revisit" and rows["<urn:page:1>"][0]["refers_to"] == "<urn:page:9>"
        assert rows["<urn:page:3>"][0]["record_type"] == "response"
        part = read.where("record_type = 'revisit' AND target_uri LIKE 'http://a/%'")
        assert sorted(r["record_id"] for r in part.collect()) == ["<urn:page:1>", "<urn:page:2>"]
        digest = hashlib.sha1(big.encode()).hexdigest()
        got = read.where("record_id = '<urn:page:1>'").select(warc._hex(F.col("payload_digest")).alias("d")).collect()
        assert [r["d"] for r in got] == [digest]
    empty = f"{tmp_path}/empty"
    warc.write_archive(warc.archive_rows(pages.where("page_id < 0")), empty)
    assert warc.read_archive(spark, empty).count() == 0


def test_licence_notices_are_found_and_mentions_are_not(spark):
    plain = [(k, "\n".join(_prose(50 * k + j, 12) for j in range(4))) for k in range(40)]
    rows = plain + [(100, "Intro text.\nReleased under the MIT License.\nMore."), (101, "Licensed under CC BY-NC 4.0."),
                    (102, "Licensed under the Apache License, Version 2.0.\nThis work is licensed under the GNU General Public License, version 3."),
                    (103, "The band was licensed under the GPL-friendly label, version one."), (107, "My fishing license expired."), (104, None), (105, ""), (106, "\n\n")]
    docs = _docs(spark, rows)
    got = {r["doc_id"]: r for r in licenses.scan(docs, licenses.train(docs)).collect()}
    families = {k: [(n["paragraph"], n["family"]) for n in r["notices"] if n["confirmed"]] for k, r in got.items()}
    assert families[100] == [(1, "mit")] and families[101] == [(0, "cc-by-nc")]
    assert families[102] == [(0, "apache"), (1, "gpl")]
    assert all(not v for k, v in families.items() if k not in (100, 101, 102))
    assert [n["confirmed"] for n in got[103]["notices"]] == [False] and not got[107]["notices"]
    assert [got[k]["n_paragraphs"] for k in (104, 105, 106)] == [0, 0, 3]
    for notices in licenses.NOTICES.values():
        assert all(any(w in " ".join(licenses._plain(n)) for w in licenses.needed_words(licenses.CONFIRM)) for n in notices)


def test_licence_notices_in_other_spelling_and_spacing(spark):
    rows = [(k, "\n".join(_prose(50 * k + j, 12) for j in range(4))) for k in range(40)]
    rows += [(100, "Released under the MIT Licence."), (101, "This is free and unencumbered software released into the  public\tdomain."),
             (102, "Permission  is\thereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files.")]
    docs = _docs(spark, rows)
    got = {r["doc_id"]: [n["family"] for n in r["notices"] if n["confirmed"]] for r in licenses.scan(docs, licenses.train(docs)).collect()}
    assert {k: v for k, v in got.items() if v} == {100: ["mit"], 101: ["unlicense"], 102: ["mit"]}


MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction."""
BSD = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions
are met:"""
GPL = """// This program is free software; you can redistribute it and/or modify
// it under the terms of the GNU General Public License as published by
// the Free Software Foundation; either version 2 of the License."""


def test_licence_notices_over_several_lines_and_side_by_side(spark):
    plain = [(k, "\n".join(_prose(50 * k + j, 12) for j in range(4))) for k in range(40)]
    long = _prose(77, 3000)
    rows = plain + [
        (100, f"Head\n\n{MIT}\nMore."), (101, BSD), (102, GPL), (103, "Released under the MIT License. Licensed under the Apache License, Version 2.0."),
        (104, "released under the mit license and licensed under the apache license version 2.0"),
        (105, "Licensed under the\r\nGNU Lesser General\r\nPublic License, version 2.1"), (106, f"{long} Licensed under the MIT License {long}"),
        (107, "Released under the MIT License\nApache\nLicensed under CC BY-SA 4.0"), (108, "Licensed under\n\nthe MIT License"),
        (109, "Licensed under CC BY-NC 4.0."), (110, "Licensed under CC BY 4.0."), (None, "Released under the BSD License."), (None, "Released under the BSD License."),
        (113, "of " * 28 + "Licensed under CC BY-NC 4.0"), (111, "This work is licensed under the GNU General Public License, version 3."), (112, "public license " * 20_000)]
    docs = _docs(spark, rows)
    model = licenses.train(docs)
    got = licenses.scan(docs, model).collect()
    by = {}
    for r in got:
        by.setdefault(r["doc_id"], []).append([(n["paragraph"], n["family"]) for n in r["notices"] if n["confirmed"]])
    assert len(got) == len(rows)
    assert by[100] == [[(2, "mit")]] and by[101] == [[(0, "bsd")]] and by[102] == [[(0, "gpl")]]
    assert by[103] == [[(0, "apache"), (0, "mit")]] and by[104] == [[(0, "apache"), (0, "mit")]]
    assert by[105] == [[(0, "lgpl")]] and by[106] == [[(0, "mit")]] and by[107] == [[(0, "mit"), (2, "cc-by-sa")]] and by[108] == [[]]
    assert by[109] == [[(0, "cc-by-nc")]] and by[110] == [[(0, "cc-by")]] and by[111] == [[(0, "gpl")]]
    assert by[None] == [[(0, "bsd")]] * 2 and by[112] == [[]]
    assert by[113] == [[(0, "cc-by-nc")]]
    assert all(by[k] == [[]] for k, _ in plain)
    empty = _docs(spark, [])
    assert licenses.scan(empty, licenses.train(empty)).count() == 0
