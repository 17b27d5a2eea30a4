"""Licence notices in documents; DataFrame and SQL functions only.

A multinomial logistic regression over words and word pairs names the licence family of a piece of
text or ``unknown``. It trains on the notices below, whole, with one word missing and beside ordinary
text, against sentences of the corpus and sentences that merely mention licences. The bound on the
probability of a family, against unknown, is calibrated on unknown pieces that trained nothing. A
prediction counts once a notice of that family confirms it by the share of its words and pairs.

Paragraphs are lines; a notice may run over several. Texts are therefore judged by sentences, which
go on over line ends and stop at blank lines, and by their pieces: the sentence, or windows of
``WINDOW`` words that overlap by half if it is longer, and its lines. A sentence can hold notices of
several families: a less likely one counts if it holds enough of what its notice has apart from
the likelier one's notice.

A search for pairs of words, one of which every confirmed notice needs, goes first over the whole texts, once; only the
texts that pass it are cut up. Weights and notices are small tables, joined by words and pairs, so
that the plan stays small and no row meets all notices.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizerModel
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ringwatch.llm.base import stored, table

# Notices as licensors ask for them, by family.
NOTICES = {
    "agpl": [
        "This program is licensed under the GNU Affero General Public License, version 3.",
        "Licensed under the AGPL, version 3 or later.",
    ],
    "apache": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
        "You may obtain a copy of the Apache License at http://www.apache.org/licenses/LICENSE-2.0",
    ],
    "bsd": [
        "Released under the BSD License.",
        "Licensed under the 3-clause BSD License.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    ],
    "cc-by": [
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    ],
    "cc-by-nc": [
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    ],
    "cc-by-sa": [
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    ],
    "gpl": [
        "This work is licensed under the GNU General Public License, version 3.",
        "Licensed under the GPL, version 2 or later.",
        "You can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation.",
    ],
    "lgpl": [
        "This library is licensed under the GNU Lesser General Public License, version 2.1.",
        "Licensed under the LGPL, version 3.",
    ],
    "mit": [
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files.",
    ],
    "mpl": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "Licensed under the Mozilla Public License 2.0.",
    ],
    "unlicense": [
        "This is free and unencumbered software released into the public domain.",
        "Released under the Unlicense.",
    ],
}
# Sentences that mention licences without granting one.
MENTIONS = [
    "A driving licence is needed for this job.",
    "The restaurant lost its license last year.",
    "All our doctors are licensed and insured.",
    "The series was licensed to a broadcaster abroad.",
    "Permission from the owner is needed to enter the garden.",
    "The redistribution of land took many years.",
    "She renewed her fishing license at the town hall.",
    "Copyright is a hard subject for beginners.",
    "The old songs are in the public domain now.",
    "Please read the license before you install the program.",
    "The terms of the public inquiry were published under pressure.",
    "The city issued a new license under the general rules, version after version.",
]
UNKNOWN = "unknown"
#: Documents whose sentences stand for ordinary text, and pieces of them, at most about.
SAMPLE_DOCS = 400
SAMPLE_PIECES = 2000
#: Share of a notice's words and pairs that a piece has to hold.
CONFIRM = 0.75
#: Words of a window in a long sentence; twice as many as the longest notice has.
WINDOW = 64
_BREAK, _LINE = "\uffff", "\ufffe"


@dataclass(frozen=True)
class LicenceModel:
    """Families in the order of the weights; a weight for each family by word or pair; the bound."""

    families: list[str]
    weights: dict[str, list[float]]
    intercept: list[float]
    least: float


def _plain(notice: str) -> list[str]:
    """Words of a notice as ``words_of`` gives them."""
    spelt = re.sub("licenc", "licens", re.sub(r"[0-9]+([.][0-9]+)*", " # ", notice.lower()))
    return re.sub("[^a-z#]+", " ", spelt).split()


def _grams(words: list[str]) -> list[str]:
    return sorted({*words, *(f"{a} {b}" for a, b in zip(words, words[1:]))})


def words_of(text: Column) -> Column:
    """Words in lower case; numbers, versions too, are ``#``; both spellings of licence are one."""
    plain = F.regexp_replace(F.regexp_replace(F.lower(text), r"[0-9]+([.][0-9]+)*", " # "), "licenc", "licens")
    return F.filter(F.split(F.regexp_replace(plain, "[^a-z#]+", " "), " "), lambda w: w != "")


def grams_of(words: Column) -> Column:
    """Distinct words and pairs of neighbouring words."""
    most = F.greatest(F.size(words) - 1, F.lit(0))
    pairs = F.zip_with(F.slice(words, F.lit(1), most), F.slice(words, F.lit(2), most), lambda a, b: F.concat(a, F.lit(" "), b))
    return F.array_distinct(F.concat(words, pairs))


_COMMON = {"a", "and", "are", "as", "at", "by", "in", "into", "is", "it", "may", "of", "or", "that", "the", "this", "to", "under", "use", "with", "you"}


def needed_words(confirm: float) -> list[str]:
    """Strings of which every text, as ``letters_of`` gives it, that a notice could confirm holds one.

    A text may lack ``m`` of a notice's words and pairs, so it holds one of any ``m + 1``, and of strings that
    stand in so many of them. Most texts hold none of these few strings.
    """
    found = ["licens"]
    for notice in (n for notices in NOTICES.values() for n in notices):
        grams = [g for g in _grams(_plain(notice)) if "#" not in g]
        most = math.floor(len(_grams(_plain(notice))) * (1 - confirm) + 1e-6)
        for more in sorted(grams, key=lambda g: (len(g) < 5, len(_COMMON & {*g.split()}), -sum(g in h for h in grams), -len(g), g)):
            if sum(any(f in g for f in found) for g in grams) > most:
                break
            if not any(f in more for f in found):
                found.append(more)
        else:
            if sum(any(f in g for f in found) for g in grams) <= most:
                return [""]
    return found


def needed_pairs(confirm: float) -> list[tuple[list[str], int]]:
    """For each notice its pairs of neighbouring words, and how many of them a text that it confirms holds at least."""
    out = []
    for notice in (n for notices in NOTICES.values() for n in notices):
        words = _plain(notice)
        pairs = sorted({f"{a} {b}" for a, b in zip(words, words[1:]) if "#" not in (a, b)})
        out.append((pairs, len(pairs) - math.floor(len(_grams(words)) * (1 - confirm) + 1e-6)))
    return out


def may_confirm(plain: Column, confirm: float) -> Column:
    """True for every text, as ``letters_of`` gives it, that a notice could confirm, and for few others.

    Most texts hold none of the needed words. The others are asked how many pairs of each notice they hold.
    """
    one = F.exists(F.array(*[F.lit(w) for w in needed_words(confirm)]), lambda w: F.contains(plain, w))
    notices = F.array(*[F.struct(F.array(*[F.lit(p) for p in pairs]).alias("pairs"), F.lit(least).alias("least")) for pairs, least in needed_pairs(confirm)])
    enough = F.exists(notices, lambda n: F.size(F.filter(n["pairs"], lambda p: F.contains(plain, p))) >= n["least"])
    return F.coalesce(one & enough, F.lit(False))


def letters_of(text: Column) -> Column:
    """A text in lower case with single blanks for all that lies between its words; one spelling of licence."""
    return F.replace(F.regexp_replace(F.lower(text), "[^a-z]+", " "), F.lit("licenc"), F.lit("licens"))


def sentences_of(text: Column) -> Column:
    """Sentences (``line``, ``part``) with the number of the line where they begin; blank lines end one, too."""
    clean = F.replace(F.replace(text, F.lit(_BREAK), F.lit(" ")), F.lit(_LINE), F.lit(" "))
    marked = F.regexp_replace(clean, "([.!?][\"')\\]]*\\s+)(?=[\"'(\\[]*\\p{Lu})", f"$1{_BREAK}")
    marked = F.regexp_replace(marked, "(\n[ \t\r\x0b\f]*\n\\s*)", f"$1{_BREAK}")
    lines = F.transform(F.split(marked, "\n"), lambda x, i: F.replace(x, F.lit(_BREAK), F.concat(F.lit(_BREAK), i.cast("string"), F.lit(_LINE))))
    parts = F.split(F.concat(F.lit(f"0{_LINE}"), F.array_join(lines, "\n")), _BREAK)
    return F.transform(parts, lambda x: F.struct(
        F.substring_index(x, _LINE, 1).cast("int").alias("line"), F.substring_index(x, _LINE, -1).alias("part")))


def pieces_of(sentence: Column) -> Column:
    """Pieces of a sentence, each with its line in it and its words; those without words left out."""
    words, lines = words_of(sentence), F.split(sentence, "\n")
    kind = "array<struct<line:int,words:array<string>>>"
    starts = F.sequence(F.lit(0), F.greatest(F.size(words) - WINDOW // 2 - 1, F.lit(0)), F.lit(WINDOW // 2))
    windows = F.transform(starts, lambda at: F.struct(F.lit(0).alias("line"), F.slice(words, at + 1, F.lit(WINDOW)).alias("words"))).cast(kind)
    by_line = F.transform(lines, lambda x, i: F.struct(i.alias("line"), words_of(x).alias("words"))).cast(kind)
    none = F.array().cast(kind)
    return F.filter(F.concat(windows, F.when(F.size(lines) > 1, by_line).otherwise(none)), lambda x: F.size(x["words"]) > 0)


def _notices(spark: SparkSession) -> DataFrame:
    """Family, number and words and pairs of each notice."""
    rows = [(f, k, _grams(_plain(n))) for f in sorted(NOTICES) for k, n in enumerate(NOTICES[f])]
    return spark.createDataFrame(rows, "family string, notice int, notice_grams array<string>")


def _shares(pieces: DataFrame) -> DataFrame:
    """For each piece (``id``, ``grams``) and notice with common words: the share of the notice's words and pairs held."""
    notices = _notices(pieces.sparkSession)
    by_gram = F.broadcast(notices.select("family", "notice", F.size("notice_grams").alias("size"), F.explode("notice_grams").alias("gram")))
    met = pieces.select("id", F.explode("grams").alias("gram")).join(by_gram, "gram")
    return met.groupBy("id", "family", "notice").agg((F.count("*") / F.first("size")).alias("share"))


def _probabilities(pieces: DataFrame, model: LicenceModel) -> DataFrame:
    """``id, odds`` of each piece (``id``, ``grams``): for each family of the model, exp(logit)."""
    n = len(model.families)
    rows = [(g, w) for g, w in model.weights.items()]
    weights = F.broadcast(pieces.sparkSession.createDataFrame(rows, "gram string, w array<double>"))
    met = pieces.select("id", F.explode("grams").alias("gram")).join(weights, "gram", "left")
    sums = met.groupBy("id").agg(F.array(*[F.coalesce(F.sum(F.col("w")[k]), F.lit(0.0)) + model.intercept[k] for k in range(n)]).alias("z"))
    return sums.select("id", F.transform("z", lambda z: F.exp(z - F.array_max("z"))).alias("odds"))


def _cut(texts: DataFrame, confirm: float | None) -> DataFrame:
    """Pieces of the texts (``row``, ``text``): ``row, sentence, line, id, grams``; ``confirm`` leaves sentences out that can't be confirmed.

    ``line`` is the number of the piece's line in the text. ``id`` tells pieces apart.
    """
    cut = texts.select("row", F.posexplode(sentences_of(F.col("text"))).alias("sentence", "x")).select(
        "row", "sentence", F.col("x.line").alias("first"), F.col("x.part").alias("part"), letters_of(F.col("x.part")).alias("plain"))
    if confirm is not None:
        cut = cut.where(may_confirm(F.col("plain"), confirm))
    # blanks before the first word of a sentence don't count for its line
    lead = F.regexp_extract("part", "^\\s*", 0)
    skip = F.length(lead) - F.length(F.replace(lead, F.lit("\n"), F.lit("")))
    cut = cut.withColumn("part", F.regexp_replace("part", "^\\s+", "")).withColumn("first", F.col("first") + skip)
    cut = cut.select("row", "sentence", "first", F.posexplode(pieces_of(F.col("part"))).alias("piece", "x"))
    return cut.select("row", "sentence", (F.col("first") + F.col("x.line")).alias("line"),
                      F.struct("row", "sentence", "piece").alias("id"), grams_of(F.col("x.words")).alias("grams"))


def train(docs: DataFrame, confirm: float = CONFIRM, sample_docs: int = SAMPLE_DOCS, sample_pieces: int = SAMPLE_PIECES) -> LicenceModel:
    """A model from the notices and a bounded sample of the documents' pieces, whole ones.

    Documents are picked by a hash of id and text, pieces by a hash of their words. Pieces that hold most
    of a notice are not taken as unknown. Without documents the mentions alone stand for unknown text.
    """
    spark = docs.sparkSession
    families = [UNKNOWN, *sorted(NOTICES)]
    notices = spark.createDataFrame([(families.index(f), _plain(n)) for f in sorted(NOTICES) for n in NOTICES[f]], "label int, words array<string>")
    mentions = spark.createDataFrame([(0, _plain(m)) for m in MENTIONS], "label int, words array<string>")
    total = docs.count()
    texts = docs.select(F.col("doc_id").cast("string").alias("doc_id"), F.col("text").cast("string").alias("text")).where("text IS NOT NULL")
    place = F.pmod(F.xxhash64("doc_id", "text", F.lit(1)), F.lit(1_000_000_000))
    some = texts.where(place < max(1, int(1_000_000_000 * min(1.0, sample_docs / max(total, 1)))))
    pieces = some.select(F.explode(sentences_of(F.col("text"))).alias("x")).select(F.explode(pieces_of(F.col("x.part"))).alias("x"))
    pieces = pieces.select(F.col("x.words").alias("words")).distinct().orderBy(F.xxhash64("words", F.lit(2)), "words").limit(sample_pieces)
    pieces = pieces.select("words", F.struct("words").alias("id"), grams_of(F.col("words")).alias("grams"))
    like = _shares(pieces).where(F.col("share") >= confirm).select("id").distinct()
    plain = pieces.join(like, "id", "left_anti").select("id", "words", "grams", F.lit(0).alias("label"))
    plain = stored(plain.withColumn("held", F.pmod(F.xxhash64("words", F.lit(3)), F.lit(4)) == 0), "licence-pieces")

    without = notices.select("label", F.explode(F.sequence(F.lit(1), F.size("words"))).alias("k"), F.col("words").alias("w"))
    without = without.select("label", F.concat(F.slice("w", F.lit(1), F.col("k") - 1), F.slice("w", F.col("k") + 1, F.size("w"))).alias("words"))
    texts = plain.where("NOT held").orderBy(F.xxhash64("words", F.lit(4))).limit(5)
    beside = [F.array(*[F.lit(w) for w in r["words"]]) for r in texts.select("words").collect()]
    more = F.array(*beside) if beside else F.array().cast("array<array<string>>")
    beside = notices.select("label", F.explode(F.transform(more, lambda m: F.concat("words", m))).alias("words"))
    rows = notices.unionByName(without).unionByName(beside).unionByName(mentions).unionByName(plain.where("NOT held").select("label", "words"))
    rows = rows.select(F.col("label").cast("double").alias("label"), grams_of(F.col("words")).alias("grams"))

    vocabulary = sorted({g for n in [*(n for f in NOTICES.values() for n in f), *MENTIONS] for g in _grams(_plain(n))})
    counts = CountVectorizerModel.from_vocabulary(vocabulary, inputCol="grams", outputCol="features", minTF=1.0)
    rows = stored(rows.coalesce(2), "licence-rows")
    sizes = rows.groupBy("label").agg(F.count("*").alias("n"))
    rows = counts.transform(rows).join(F.broadcast(sizes), "label").withColumn("weight", 1 / F.sqrt("n")).select("label", "features", "weight").cache()
    fitted = LogisticRegression(family="multinomial", regParam=2e-4, maxIter=60, weightCol="weight", standardization=False).fit(rows)
    rows.unpersist()
    matrix = fitted.coefficientMatrix.toArray()
    weights = {g: [float(x) for x in matrix[:, k]] for k, g in enumerate(vocabulary)}
    model = LicenceModel(families, weights, [float(x) for x in fitted.interceptVector], 0.0)

    odds = _probabilities(plain.where("held"), model)
    best = F.array_max(F.slice("odds", 2, len(families) - 1))
    high = odds.agg(F.percentile(best / (best + F.col("odds")[0]), 0.999)).first()[0] or 0.0
    return LicenceModel(families, weights, model.intercept, max(0.5, high))


_NOTICES = "array<struct<paragraph:int,family:string,probability:double,share:double,confirmed:boolean>>"


def _judged(pieces: DataFrame, model: LicenceModel, confirm: float) -> DataFrame:
    """``row, found``: an array of the notices of each text, in order of their lines."""
    odds = _probabilities(pieces, model)
    names = F.array(*[F.lit(f) for f in model.families])
    place = F.col("odds")[F.array_position(names, F.col("family")).cast("int") - 1]
    shares = _shares(pieces).join(F.broadcast(_notices(pieces.sparkSession)), ["family", "notice"])
    graded = shares.join(odds, "id").withColumn("p", place / (place + F.col("odds")[0]))
    # of the notices of a family the one held most
    graded = graded.groupBy("id", "family").agg(F.max_by(F.struct("share", "p", "notice_grams"), F.struct("share", F.size("notice_grams"))).alias("n"))
    item = F.struct((-F.col("n.p")).alias("order"), "family", F.col("n.share").alias("share"), F.col("n.notice_grams").alias("own"))
    by_piece = graded.groupBy("id").agg(F.array_sort(F.collect_list(item)).alias("all"))
    by_piece = by_piece.join(pieces.select("id", "line", "grams"), "id")

    def sure(x: Column) -> Column:
        return (x["share"] >= confirm) & (-x["order"] >= model.least)

    def apart(x: Column, y: Column) -> Column:  # what x's notice has and y's has not, is it there?
        rest = F.array_except(x["own"], y["own"])
        return F.size(F.array_intersect(rest, F.col("grams"))) >= confirm * F.size(rest)

    confirmed = F.filter("all", sure)
    explained = lambda x: F.exists(
        confirmed, lambda y: ((y["order"] < x["order"]) | ((y["order"] == x["order"]) & (y["family"] < x["family"]))) & ~apart(x, y))
    told = F.transform("all", lambda x: F.struct(
        x["family"].alias("family"), (-x["order"]).alias("probability"), x["share"].alias("share"), (sure(x) & ~explained(x)).alias("confirmed")))
    found = by_piece.select("id", "line", F.explode(told).alias("n")).select(
        F.col("id.row").alias("row"), F.col("id.sentence").alias("sentence"), "line", "n.*")
    # a window can end within a notice and show a part that resembles another one: of a family's pieces, the
    # one that holds most decides; of equal ones an unconfirmed one, then the one that begins last
    once = found.groupBy("row", "sentence", "family").agg(F.max_by(
        F.struct("line", "probability", "share", "confirmed"), F.struct("share", ~F.col("confirmed"), "line", "probability")).alias("n"))
    once = once.withColumn("any", F.max("n.confirmed").over(_sentences()))
    once = once.withColumn("turn", F.row_number().over(_sentences().orderBy(F.desc("n.probability"), "family")))
    once = once.where("n.confirmed OR (NOT any AND turn = 1)")
    name = F.when(F.col("n.probability") >= model.least, F.col("family")).otherwise(UNKNOWN)
    told = F.struct(F.col("n.line").alias("paragraph"), name.alias("family"), F.col("n.probability").alias("probability"),
                    F.col("n.share").alias("share"), F.col("n.confirmed").alias("confirmed"))
    return once.groupBy("row").agg(F.array_sort(F.collect_list(told)).cast(_NOTICES).alias("found"))


def _sentences():
    return Window.partitionBy("row", "sentence")


def scan(docs: DataFrame, model: LicenceModel, confirm: float = CONFIRM) -> DataFrame:
    """``doc_id, n_paragraphs, notices`` for each row of ``docs``.

    ``n_paragraphs`` counts lines. ``notices`` is an array of ``struct<paragraph, family, probability,
    share, confirmed>``, where ``paragraph`` is the number, from 0, of the line where the notice's sentence
    or line begins: every confirmed family of a sentence or, for sentences that could be confirmed but are
    not, the likeliest family, ``unknown`` below the calibrated bound. ``probability`` is that of the
    family against unknown. Null and empty texts have no paragraphs. Rows that repeat others, and rows
    without a doc_id, all come back. Further columns are ignored. Texts are scanned once; rows that pass
    the search are numbered, so that equal rows don't meet.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), letters_of(text).alias("plain"))
    paragraphs = F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit(""))) + 1
    rows = rows.select(F.monotonically_increasing_id().alias("row"), "doc_id", F.when(F.col("text") == "", 0).otherwise(paragraphs).alias("n_paragraphs"),
                       F.when(may_confirm(F.col("plain"), confirm), F.col("text")).alias("text"))
    rows = stored(rows, "licence-texts")
    pieces = stored(_cut(rows.where("text IS NOT NULL").select("row", "text"), confirm), "licence-cut")
    found = _judged(pieces, model, confirm)
    none = F.array().cast(_NOTICES)
    with_text = rows.where("text IS NOT NULL").select("row", "doc_id", "n_paragraphs").join(found, "row", "left")
    return with_text.select("doc_id", "n_paragraphs", F.coalesce("found", none).alias("notices")).unionByName(
        rows.where("text IS NULL").select("doc_id", "n_paragraphs", none.alias("notices")))


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paragraphs of all documents, those that are licence notices, and their families."""
    docs = table(spark, sf_dir, "documents")
    found = scan(docs, train(docs))
    sure = F.filter("notices", lambda x: x["confirmed"])
    return found.select(
        "doc_id", F.col("n_paragraphs").cast("long").alias("n_paragraphs"), F.size(sure).cast("long").alias("n_notices"),
        F.array_join(F.array_sort(F.array_distinct(F.transform(sure, lambda x: x["family"]))), ",").alias("families"))


OP1_SQL = """
WITH p AS (
  SELECT doc_id, CASE WHEN coalesce(text, '') = '' THEN [] ELSE string_split(text, chr(10)) END AS lines FROM documents),
f AS (
  SELECT doc_id, lines, list_filter(list_transform(lines, lambda x: CASE
    WHEN regexp_matches(x, 'Licensed under the Apache License, Version [0-9.]+') THEN 'apache'
    WHEN regexp_matches(x, 'Licensed under CC BY-NC [0-9.]+') THEN 'cc-by-nc'
    WHEN regexp_matches(x, 'This work is licensed under the GNU General Public License, version [0-9.]+') THEN 'gpl'
    WHEN regexp_matches(x, 'Released under the MIT License') THEN 'mit' END), lambda x: x IS NOT NULL) AS found FROM p)
SELECT doc_id, CAST(len(lines) AS BIGINT) AS n_paragraphs, CAST(len(found) AS BIGINT) AS n_notices,
       array_to_string(list_sort(list_distinct(found)), ',') AS families
FROM f
"""
