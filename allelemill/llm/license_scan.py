"""License scans by diagonal voting, in DataFrame operations only.

All rolling word pairs of every text are hashed and joined to the pairs of the license templates (a fixed list of known
size, broadcast). A hit lies on the diagonal `word position - template position`; hits are counted by diagonal. A
diagonal that has all pairs of a phrase is a place of that phrase (base). Neighbouring diagonals of a template (words
were inserted or dropped in between) are merged into spans, and a span that covers enough of the template's pairs is
verified and gives its label.

Defined results: null texts are empty; an empty text has no words, no labels and score 0. Rows that repeat a doc_id are
kept apart by their texts; wholly repeated rows give as many equal results. Null doc_ids keep their row. An empty table
gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import ascii_lower, stored

#: The base phrases and the label of each.
BASE = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}

#: Further templates of the method, sentences of well-known licenses, and their labels.
NOTICES = {
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files": "mit",
    "licensed under the apache license version 2 0": "apache",
    "you may not use this file except in compliance with the license": "apache",
    "this work is licensed under the gnu general public license version 3": "gpl",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license": "gpl",
    "redistribution and use in source and binary forms with or without modification are permitted": "bsd",
    "this work is licensed under a creative commons attribution 4 0 international license": "cc-by",
    "this source code form is subject to the terms of the mozilla public license": "mpl",
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted": "isc",
    "this is free and unencumbered software released into the public domain": "unlicense",
    "licensed under cc by nc 4 0": "cc-by-nc",
}

NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Diagonals at most DRIFT apart, with at most GAP words between their hits, are one span; COVER of the pairs verify it.
DRIFT, GAP, COVER = 4, 8, 0.6
#: Stands before a text's first word; no word holds a space.
_HEAD = " "


def words(text: Column) -> Column:
    return F.array_remove(F.split(ascii_lower(text), NOT_WORD), "")


def templates(spark, base: dict[str, str] = BASE, notices: dict[str, str] = NOTICES) -> DataFrame:
    """One row for each word pair of each template."""
    rows = []
    for t, (text, label, exact) in enumerate([(p, x, True) for p, x in base.items()] + [(p, x, False) for p, x in notices.items()]):
        w = text.split()
        rows += [(t, i, w[i], w[i + 1], len(w) - 1, label, exact) for i in range(len(w) - 1)]
    schema = "template int, at int, left string, right string, pairs int, label string, exact boolean"
    table = spark.createDataFrame(rows, schema)
    return table.withColumn("gram", F.xxhash64("left", "right"))


def hits(docs: DataFrame, base: dict[str, str] = BASE, notices: dict[str, str] = NOTICES) -> DataFrame:
    """One row for each word pair that is in a template, and one with null template at the head of each text."""
    first = sorted({w for text in [*base, *notices] for w in text.split()[:-1]})
    split = docs.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_hash"), F.concat(F.array(F.lit(_HEAD)), words(F.col("text"))).alias("w"))
    n = F.size("w")
    pairs = split.select("doc_id", "text_hash", (n - 1).alias("n_words"), F.posexplode(F.arrays_zip(F.col("w").alias("a"), F.slice("w", F.lit(2), n).alias("b"))).alias("pos", "pair"))
    pairs = pairs.select("doc_id", "text_hash", "n_words", (F.col("pos") - 1).cast("long").alias("pos"), F.col("pair.a").alias("a"), F.col("pair.b").alias("b")).where(F.col("a").isin(_HEAD, *first))
    grams = F.broadcast(templates(docs.sparkSession, base, notices))
    same = (F.xxhash64("a", "b") == grams["gram"]) & (F.col("a") == grams["left"]) & (F.col("b") == grams["right"])
    return pairs.join(grams, same, "left").where((F.col("a") == _HEAD) | F.col("template").isNotNull()).select("doc_id", "text_hash", "n_words", "pos", "template", "at", "pairs", "label", "exact")


KEY = ["doc_id", "text_hash", "n_words"]


def spans(found: DataFrame, drift: int = DRIFT, gap: int = GAP, cover: float = COVER) -> DataFrame:
    """Verified spans: KEY, template, label, exact, start, end (words), coverage. Repeated rows count once here."""
    diagonal = F.col("pos") - F.col("at")
    voted = found.where("template is not null").groupBy(*KEY, "template", "pairs", "label", "exact", diagonal.alias("diagonal")).agg(F.min("pos").alias("low"), F.max("pos").alias("high"), F.collect_set("at").alias("ats"))
    base = voted.where(F.col("exact") & (F.size("ats") == F.col("pairs"))).select(*KEY, "template", "label", "exact", F.col("diagonal").alias("start"), (F.col("diagonal") + F.col("pairs")).alias("end"), F.lit(1.0).alias("coverage"))
    # First places: hits further than GAP from all before begin a new one. Within a place neighbouring diagonals are one span,
    # whatever strays between them lies on.
    order = Window.partitionBy(*KEY, "template").orderBy("low", "diagonal")
    reach = F.max("high").over(order.rowsBetween(Window.unboundedPreceding, -1))
    placed = voted.where(~F.col("exact")).withColumn("far", F.coalesce(F.col("low") > reach + gap, F.lit(True)).cast("int")).withColumn("place", F.sum("far").over(order))
    beside = Window.partitionBy(*KEY, "template", "place").orderBy("diagonal")
    apart = F.coalesce(F.col("diagonal") - F.lag("diagonal").over(beside) > drift, F.lit(True))
    chained = placed.withColumn("new", apart.cast("int")).withColumn("span", F.concat_ws(":", "place", F.sum("new").over(beside)))
    merged = chained.groupBy(*KEY, "template", "pairs", "label", "exact", "span").agg(F.min("low").alias("start"), (F.max("high") + 1).alias("end"), F.array_distinct(F.flatten(F.collect_list("ats"))).alias("ats"))
    coverage = F.size("ats") / F.col("pairs")
    return base.unionByName(merged.where(coverage >= cover).select(*KEY, "template", "label", "exact", "start", "end", coverage.alias("coverage")))


def scan(docs: DataFrame, base: dict[str, str] = BASE, notices: dict[str, str] = NOTICES) -> DataFrame:
    """One row for each row of docs: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score."""
    found = hits(docs, base, notices)
    # Few rows of a text are hits, so this carries little; the heads carry the texts without any.
    once = stored(found.groupBy(*KEY, "template", "pos", "at", "pairs", "label", "exact").agg(F.count("*").alias("copies")), "hits")
    heads = once.where("template is null").select(*KEY, F.col("copies"), *(F.lit(None).cast(t).alias(c) for c, t in (("label", "string"), ("exact", "boolean"), ("start", "long"), ("coverage", "double"))))
    verified = spans(once).select(*KEY, F.lit(None).cast("long").alias("copies"), "label", "exact", "start", "coverage")
    exact = F.col("exact") & F.col("start").isNotNull()
    labels = lambda c: F.array_join(F.array_sort(F.collect_set(c)), ",")
    out = heads.unionByName(verified).groupBy(*KEY).agg(
        F.max("copies").alias("copies"),
        F.count(F.when(exact, 1)).alias("n_base"),
        F.min(F.when(exact, F.col("start"))).alias("first_word"),
        F.max(F.when(exact, F.col("start"))).alias("last_word"),
        labels(F.when(exact, F.col("label"))).alias("base_labels"),
        labels("label").alias("labels"),
        F.coalesce(F.max("coverage"), F.lit(0.0)).alias("score"),
    )
    return out.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("doc_id", F.col("n_words").cast("long").alias("n_words"), "n_base", "first_word", "last_word", "base_labels", "labels", "score")
