"""License scan by diagonal voting, DataFrame operations only.

Every text is cut into words once and rolled into word 2-grams (for the base phrases) and 3-grams (for the templates).  The grams are joined by hash (and, so that a
collision can't vote, by their words) to the positions of the same grams in phrases and templates.  A match votes for the diagonal `word - template position`.  A base
phrase stands where a diagonal has every gram of the phrase.  For templates, a diagonal is merged with those up to `drift` words beyond it, which bridges inserted and
missing words and bounds a span by the template's length plus the drift.  A span is verified in order: what counts is the longest chain of its votes that rises in the
text and in the template, so scattered or reversed words of a template prove nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from quantloom.llm.common import ascii_lower, checkpointed, pick_columns

WORD_BREAK = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"      # what lies between words, fixed by the contract
#: Base phrases, fixed by the contract.
BASE = [("cc-by", "cc by"), ("gpl", "general public license"), ("reserved", "all rights reserved")]
#: Templates of the method, in words: notices and bodies of public licenses.
TEMPLATES = [
    ("apache-2.0", "licensed under the apache license version 2 0"),
    ("apache-2.0", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions "
                   "of any kind either express or implied see the license for the specific language governing permissions and limitations under the license"),
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("mit", "to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the "
            "software and to permit persons to whom the software is furnished to do so subject to the following conditions"),
    ("mit", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software the software is provided as is without "
            "warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement"),
    ("gpl-3.0", "licensed under the gnu general public license version 3"),
    ("gpl-3.0", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    ("cc-by-nc-4.0", "licensed under cc by nc 4 0"),
    ("cc-by-4.0", "licensed under a creative commons attribution 4 0 international license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided"),
    ("bsd", "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"),
    ("bsd", "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other "
            "materials provided with the distribution"),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("cc0-1.0", "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work"),
]
BASE_GRAM, GRAM = 2, 3
END = "vote.template = -1"      # each text has one such row, at the place after its last word


def words(text: str) -> Column:
    low = ascii_lower(F.coalesce(F.col(text), F.lit("")))
    return F.filter(F.split(low, WORD_BREAK), lambda w: w != "")


def gram_rows(phrases, k: int, first: int = 0) -> list[tuple]:
    """(template, label, grams, tpos, the gram's words) of every gram."""
    rows = []
    for at, (label, phrase) in enumerate(phrases, first):
        w = phrase.split()
        if len(w) < k:
            raise ValueError(f"{phrase!r} has fewer than {k} words")
        rows += [(at, label, len(w) - k + 1, i, *w[i:i + k]) for i in range(len(w) - k + 1)]
    return rows


def gram_table(spark, rows: list[tuple], k: int, is_base: bool, name: str) -> DataFrame:
    """One row for each different gram, with the array `name` of its places; as many rows as the phrases have words, whatever the corpus."""
    values = ", ".join("(" + ", ".join([str(r[0]), f"'{r[1]}'", str(r[2]), str(r[3]), *(f"'{w}'" for w in r[4:])]) + ")" for r in rows)
    ws = [f"{name}{i}" for i in range(k)]
    t = spark.sql(f"SELECT * FROM VALUES {values} AS t(template, label, grams, tpos, {', '.join(ws)})")
    place = F.struct("template", "label", F.lit(is_base).alias("is_base"), "grams", "tpos")
    return t.groupBy(*ws).agg(F.collect_list(place).alias(name)).withColumn(f"{name}h", F.xxhash64(*ws))


def votes(df: DataFrame, key: str = "doc_id", text: str = "text", base=None, templates=None) -> DataFrame:
    """(rid, digest, word, vote, copies): each gram of a text that stands in a phrase or template, once for equal rows, of which there are `copies`; and a text's END row.

    `vote` is (template, label, is_base, grams, tpos).
    """
    base, templates = base or BASE, templates or TEMPLATES
    spark = df.sparkSession
    docs = pick_columns(df, key, text).select(F.col(key).alias("rid"), F.xxhash64(text).alias("digest"), words(text).alias("w"))
    gram = lambda w, i: F.struct(w.alias("w0"), F.get("w", i + 1).alias("w1"), F.get("w", i + 2).alias("w2"))
    grams = docs.select("rid", "digest", F.posexplode(F.transform(F.concat("w", F.array(F.lit(""))), gram)).alias("word", "g")).select("rid", "digest", "word", "g.*")
    for name, k, rows, is_base in (("b", BASE_GRAM, gram_rows(base, BASE_GRAM), True), ("t", GRAM, gram_rows(templates, GRAM, len(base)), False)):
        table = F.broadcast(gram_table(spark, rows, k, is_base, name))             # some hundred rows, fixed by the templates
        on = F.xxhash64(*[f"w{i}" for i in range(k)]) == F.col(f"{name}h")
        for i in range(k):
            on = on & (F.col(f"w{i}") == F.col(f"{name}{i}"))
        grams = grams.join(table, on, "left")
    none = F.array().cast(grams.schema["b"].dataType)
    end = F.array(F.struct(F.lit(-1).alias("template"), F.lit("").alias("label"), F.lit(False).alias("is_base"), F.lit(0).alias("grams"), F.lit(0).alias("tpos")))
    hits = grams.where("b IS NOT NULL OR t IS NOT NULL OR w0 = ''").select(
        "rid", "digest", F.col("word").cast("long").alias("word"), F.explode(F.concat(F.coalesce("b", none), F.coalesce("t", none), F.when(F.col("w0") == "", end).otherwise(none))).alias("vote"))
    return hits.groupBy("rid", "digest", "word", "vote").agg(F.count("*").alias("copies"))


def longest_chain(tpos: Column) -> Column:
    """Length of the longest strictly rising subsequence of an array: `ends` holds the least last value of the chains of each length."""
    def put(ends, t):
        shorter = F.size(F.filter(ends, lambda e: e < t))
        return F.concat(F.slice(ends, F.lit(1), shorter), F.array(t), F.slice(ends, shorter + 2, F.size(ends)))
    return F.size(F.aggregate(tpos, F.array().cast("array<int>"), put))


def spans(hits: DataFrame, drift: int = 8) -> DataFrame:
    """Merged and verified diagonals: (rid, digest, template, label, grams, start, last, covered), one for each diagonal that begins a span.

    `covered` is the longest chain of votes on the diagonals start to start + drift that rises in text and template; `last` is the last voting word.
    """
    by = ["rid", "digest", "template", "label", "grams"]
    v = hits.select("rid", "digest", "word", "vote.*")
    lines = v.groupBy(*by, (F.col("word") - F.col("tpos")).alias("diagonal")).agg(F.collect_list(F.struct("word", (-F.col("tpos")).alias("back"))).alias("points"))
    band = Window.partitionBy("rid", "digest", "template").orderBy("diagonal").rangeBetween(0, drift)
    lines = lines.withColumn("points", F.array_sort(F.flatten(F.collect_list("points").over(band))))      # a word counts once: its later positions come first
    return lines.select(*by, F.col("diagonal").alias("start"), F.element_at("points", -1)["word"].alias("last"),
                        longest_chain(F.transform("points", lambda p: -p["back"])).alias("covered"))


def scan(df: DataFrame, key: str = "doc_id", text: str = "text", drift: int = 8, least: float = 0.75, base=None, templates=None) -> DataFrame:
    """One row per input row: key, n_words, n_base, first_word, last_word, base_labels, labels, score.

    n_base counts all places of base phrases, first_word and last_word are their smallest and largest start.  labels also has those of templates of
    which a verified span covers `least` or more of the 3-grams; score is the largest covered share of any template (1 with a base phrase, 0 without a match).
    Null and empty texts have no words, labels "" and score 0.  Equal rows (same key and text) get equal rows; null keys are kept; an empty table gives an empty result.
    """
    me = ["rid", "digest"]
    hits = checkpointed(votes(df, key, text, base, templates))           # the texts are read and cut once
    docs = hits.where(END).select(*me, F.col("word").alias("n_words"), "copies")
    hits = hits.where(f"NOT {END}")
    full = (hits.where("vote.is_base").groupBy(*me, "vote.template", "vote.label", "vote.grams", (F.col("word") - F.col("vote.tpos")).alias("place"))
            .agg(F.count("*").alias("n")).where("n = grams"))
    places = full.select(*me, "label", "place", F.lit(None).cast("string").alias("own"), F.lit(1.0).alias("share"))
    merged = spans(hits.where("NOT vote.is_base"), drift).withColumn("share", F.col("covered") / F.col("grams"))
    merged = merged.select(*me, F.lit(None).cast("string").alias("label"), F.lit(None).cast("long").alias("place"),
                           F.when(F.col("share") >= least, F.col("label")).alias("own"), "share")
    found = places.unionByName(merged).groupBy(*me).agg(
        F.count("place").alias("n_base"), F.min("place").alias("first_word"), F.max("place").alias("last_word"),
        F.array_sort(F.collect_set("label")).alias("base"), F.collect_set("own").alias("own"), F.max("share").alias("score"))
    out = docs.join(found, [docs["rid"].eqNullSafe(found["rid"]), docs["digest"].eqNullSafe(found["digest"])], "left")
    none = F.array().cast("array<string>")
    names = lambda c: F.array_join(F.coalesce(c, none), ",")
    both = F.array_sort(F.array_union(F.coalesce("base", none), F.coalesce("own", none)))
    out = out.select(docs["rid"].alias(key), "n_words", F.coalesce("n_base", F.lit(0)).cast("long").alias("n_base"), "first_word", "last_word",
                     names(F.col("base")).alias("base_labels"), F.array_join(both, ",").alias("labels"), F.coalesce("score", F.lit(0.0)).alias("score"), "copies")
    return out.withColumn("copies", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).drop("copies")
