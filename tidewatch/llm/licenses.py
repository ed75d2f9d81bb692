"""License scans by diagonal voting.

Hashes of all rolling word K-grams of every text are joined to those of the templates. A hit votes
for its diagonal (text position - template position); hits on one diagonal at most GAP words apart
are a segment. Segments of a long template with two hits or more are merged where their diagonals
neighbour (SLIP apart at most) and GAP words at most lie between. A merged span is verified:
the distinct template positions hit must be SHARE of the template's, however often one repeats, and
the span no longer than the template and a quarter. The base phrases must stand whole.

Before the join a constant table of BITS entries sifts out the K-grams that no template can have, so
only likely hits become rows. Null text counts as empty. Rows are told apart by (doc_id, text hash);
equal rows give equal rows; other columns are ignored; an empty table gives an empty one. The
template table is fixed below, which bounds its broadcast.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import table

# fixed values: phrase, label
BASE = (("gnu general public license", "gpl"), ("apache license", "apache"), ("cc by", "cc-by"), ("mit license", "mit"))
#: Passages and whole notices, and the labels this method adds.
LONG = (
    ("permission is hereby granted free of charge to any person obtaining a copy of this software", "mit-text"),
    ("licensed under the apache license version 2 0", "apache-2.0"),
    ("redistribution and use in source and binary forms with or without modification are permitted", "bsd"),
    ("all rights reserved no part of this", "all-rights-reserved"),
    ("released under the mit license", "mit-notice"),
    ("this work is licensed under the gnu general public license version 3", "gpl-3.0"),
    ("this program is free software you can redistribute it and or modify it under the terms of the gnu general public license"
     " as published by the free software foundation", "gpl-notice"),
    ("permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"
     " provided that the above copyright notice and this permission notice appear in all copies", "isc"),
    ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation"
     " files the software to deal in the software without restriction including without limitation the rights to use copy modify"
     " merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is"
     " furnished to do so subject to the following conditions the above copyright notice and this permission notice shall be"
     " included in all copies or substantial portions of the software the software is provided as is without warranty of any"
     " kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose"
     " and noninfringement in no event shall the authors or copyright holders be liable for any claim damages or other liability"
     " whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or"
     " other dealings in the software", "mit-full"),
    ("redistribution and use in source and binary forms with or without modification are permitted provided that the following"
     " conditions are met redistributions of source code must retain the above copyright notice this list of conditions and the"
     " following disclaimer redistributions in binary form must reproduce the above copyright notice this list of conditions and"
     " the following disclaimer in the documentation and or other materials provided with the distribution", "bsd-2-clause"),
    ("this work is licensed under a creative commons attribution 4 0 international license", "cc-by-4.0"),
)
K, SHARE, SLIP, GAP, BITS = 2, 0.8, 2, 8, 1 << 14
_SPLIT = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def templates(spark) -> DataFrame:
    """(g, t, label, j, grams, base): a row per K-gram of every template."""
    rows = []
    for t, (phrase, label) in enumerate(BASE + LONG):
        w = phrase.split(" ")
        rows += [(*w[j : j + K], t, label, j, len(w) - K + 1, t < len(BASE)) for j in range(len(w) - K + 1)]
    names = [f"w{k}" for k in range(K)]
    d = spark.createDataFrame(rows, ", ".join(f"{n} string" for n in names) + ", t int, label string, j int, grams int, base boolean")
    return d.select(F.xxhash64(*[F.xxhash64(n) for n in names]).alias("g"), "t", "label", "j", "grams", "base")


def words(text):
    """Words of a text; the Kelvin sign is the one other character whose lower case is in a-z, so it is hidden from lower()."""
    return F.filter(F.split(F.replace(F.coalesce(text, F.lit("")), F.lit("\u212a"), F.lit("é")), _SPLIT), lambda w: w != "")


def hits(docs: DataFrame) -> DataFrame:
    """(doc_id, x, i, t, label, j, grams, base): K-grams of the texts, at word i, that stand in a template."""
    t = templates(docs.sparkSession)
    at = {r[0] % BITS for r in t.select("g").distinct().collect()}
    sieve = F.split(F.lit(",".join("1" if k in at else "0" for k in range(BITS))), ",").cast("array<int>")  # folds to a constant
    d = docs.select("doc_id", F.xxhash64("text").alias("x"), F.transform(words(F.col("text")), lambda w: F.xxhash64(F.lower(w))).alias("_h"))
    gram = F.transform("_h", lambda h, i: F.struct(i.alias("i"), F.xxhash64(h, *[F.get(F.col("_h"), i + k) for k in range(1, K)]).alias("g")))
    likely = F.filter(gram, lambda y: F.get(sieve, F.pmod(y["g"], F.lit(BITS)).cast("int")) == 1)
    # from a generator, or the filter of explode would work the hashes out again for every word
    d = d.select("doc_id", "x", F.inline(F.array(F.struct(likely.alias("ys"))))).select("doc_id", "x", F.explode("ys").alias("y"))
    return d.select("doc_id", "x", "y.i", "y.g").join(F.broadcast(t), "g").drop("g")


def scan(docs: DataFrame) -> DataFrame:
    """(doc_id, x, t, label, base, first, last, share): verified spans in words; x hashes the text."""
    h = hits(docs).distinct().withColumn("diag", F.col("i") - F.col("j"))
    key = ["doc_id", "x", "t", "label", "base", "grams"]
    line = Window.partitionBy("doc_id", "x", "t", "diag").orderBy("i")
    h = h.withColumn("new", F.coalesce((F.col("i") - F.lag("i").over(line) > GAP).cast("int"), F.lit(0)))
    h = h.withColumn("part", F.when(F.col("base"), 0).otherwise(F.sum("new").over(line)))
    seg = h.groupBy(*key, "diag", "part").agg(F.collect_set("j").alias("js"), F.min("i").alias("first"), (F.max("i") + K).alias("last"))
    whole = seg.where("base and size(js) = grams").select(*key, "first", "last", F.lit(1.0).alias("share"))
    # segments on neighbouring diagonals are a band; within it, those close to each other in the text are one span
    by = Window.partitionBy("doc_id", "x", "t").orderBy("diag", "first")
    long = seg.where("not base and size(js) > 1").withColumn("new", F.coalesce((F.col("diag") - F.lag("diag").over(by) > SLIP).cast("int"), F.lit(0)))
    long = long.withColumn("band", F.sum("new").over(by.rowsBetween(Window.unboundedPreceding, 0)))
    by = Window.partitionBy("doc_id", "x", "t", "band").orderBy("first", "diag")
    before = F.max("last").over(by.rowsBetween(Window.unboundedPreceding, -1))
    long = long.withColumn("new", F.coalesce((F.col("first") - before > GAP).cast("int"), F.lit(0)))
    long = long.withColumn("span", F.sum("new").over(by.rowsBetween(Window.unboundedPreceding, 0)))
    spans = long.groupBy(*key, "band", "span").agg(F.array_distinct(F.flatten(F.collect_list("js"))).alias("js"), F.min("first").alias("first"), F.max("last").alias("last"))
    share = F.size("js") / F.col("grams")
    spans = spans.where((share >= SHARE - 1e-9) & (F.col("last") - F.col("first") <= 1.25 * (F.col("grams") + K - 1) + SLIP))
    return whole.unionByName(spans.select(*key, "first", "last", share.alias("share"))).drop("grams")


def op6_license(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    s = scan(docs).groupBy(F.col("doc_id").alias("_d"), F.col("x").alias("_x")).agg(
        F.count_if("base").alias("n_base"), F.min(F.when(F.col("base"), F.col("first"))).cast("long").alias("first_word"),
        F.max(F.when(F.col("base"), F.col("first"))).cast("long").alias("last_word"),
        F.array_join(F.array_sort(F.collect_set(F.when(F.col("base"), F.col("label")))), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.collect_set("label")), ",").alias("labels"), F.max("share").alias("score"))
    d = docs.select("doc_id", F.xxhash64("text").alias("x"), F.size(words(F.col("text"))).cast("long").alias("n_words"))
    out = d.join(s, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("x") == F.col("_x")), "left")
    return out.select("doc_id", "n_words", F.coalesce("n_base", F.lit(0)).alias("n_base"), "first_word", "last_word",
                      F.coalesce("base_labels", F.lit("")).alias("base_labels"), F.coalesce("labels", F.lit("")).alias("labels"), F.coalesce("score", F.lit(0.0)).alias("score"))


def license_base(spark, sf_dir):
    """The columns of op6_license that the base phrases decide, which SQL can express."""
    return op6_license(spark, sf_dir).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels")


ORACLES = {"license_base": r"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS w FROM documents),
 p AS (SELECT doc_id, len(w) AS n,
  list_filter(range(1, len(w) + 1), lambda i: w[i] = 'gnu' AND w[i + 1] = 'general' AND w[i + 2] = 'public' AND w[i + 3] = 'license') AS gpl,
  list_filter(range(1, len(w) + 1), lambda i: w[i] = 'apache' AND w[i + 1] = 'license') AS apache,
  list_filter(range(1, len(w) + 1), lambda i: w[i] = 'cc' AND w[i + 1] = 'by') AS cc,
  list_filter(range(1, len(w) + 1), lambda i: w[i] = 'mit' AND w[i + 1] = 'license') AS mit FROM d),
 q AS (SELECT *, list_concat(gpl, apache, cc, mit) AS every FROM p)
SELECT doc_id, CAST(n AS BIGINT) AS n_words, CAST(len(every) AS BIGINT) AS n_base, list_min(every) - 1 AS first_word, list_max(every) - 1 AS last_word,
 array_to_string(list_filter([CASE WHEN len(apache) > 0 THEN 'apache' END, CASE WHEN len(cc) > 0 THEN 'cc-by' END, CASE WHEN len(gpl) > 0 THEN 'gpl' END, CASE WHEN len(mit) > 0 THEN 'mit' END], lambda x: x IS NOT NULL), ',') AS base_labels FROM q"""}
