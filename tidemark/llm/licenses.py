"""Licence scan by diagonal voting, with built-in functions only.

Every ``k``-word window of every text is hashed and joined to the windows of the template texts. A
hit votes for the diagonal "place in the text minus place in the template"; diagonals a few words
apart belong to one occurrence with words put in or left out. A span stands when enough of the
template's windows lie in it. Only hits are shuffled; the template side is at most
``TEMPLATE_WINDOWS`` rows, which is why it may be broadcast.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import LOWER, UPPER, stored

TEMPLATE_WINDOWS = 20_000
_GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Phrases that name a licence, and their labels (fixed values of the contract).
PHRASES = (("gnu general public license", "gpl"), ("apache license", "apache"), ("cc by", "cc-by"),
           ("mit license", "mit"))
#: Opening sentences of licence notices.
TEMPLATES = (
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
            "associated documentation files (the Software), to deal in the Software without restriction"),
    ("apache", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in "
               "compliance with the License"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU "
            "General Public License as published by the Free Software Foundation"),
    ("gpl", "This work is licensed under the GNU General Public License, version 3"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted "
            "provided that the following conditions are met"),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0"),
    ("mit", "Released under the MIT License"),
)


def _words(text):
    return F.array_remove(F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), _GAP), "")


def _windows(words, k: int):
    """Hashes of all windows of ``k`` words."""
    return F.when(F.size(words) >= k, F.transform(
        F.sequence(F.lit(0), F.size(words) - k),
        lambda i: F.xxhash64(*[F.get(words, i + d) for d in range(k)]))).otherwise(F.array().cast("array<bigint>"))


def _row(text: str):
    """With the id, what tells a row from others: rows alike in both get the same answer."""
    return F.xxhash64(F.col(text)).alias("row")


def _places(words, phrase: str):
    """Where the words of a phrase stand one after the other."""
    parts = phrase.split()

    def here(i):
        out = F.get(words, i) == parts[0]
        for d, x in enumerate(parts[1:], 1):
            out = out & (F.get(words, i + d) == x)
        return F.coalesce(out, F.lit(False))

    return F.filter(F.sequence(F.lit(0), F.size(words) - 1), here)


def base(docs: DataFrame, key: str, text: str, phrases=PHRASES) -> DataFrame:
    """Word count, phrase places and their labels; most texts fail the search for the first word."""
    w = F.col("__lic_w")
    df = docs.select(F.col(key).alias("doc_id"), _row(text), _words(F.col(text)).alias("__lic_w"))
    joined = F.concat_ws(" ", F.lit(""), w, F.lit(""))
    df = df.withColumn("__lic_s", joined)
    none = F.array().cast("array<int>")
    found = [F.when(F.instr("__lic_s", f" {p} ") > 0, _places(w, p)).otherwise(none) for p, _ in phrases]
    df = df.select("doc_id", "row", F.size(w).cast("long").alias("n_words"),
                   *[x.alias(f"__lic_{i}") for i, x in enumerate(found)])
    at = F.flatten(F.array(*[F.col(f"__lic_{i}") for i in range(len(phrases))]))
    labels = F.array(*[F.when(F.size(f"__lic_{i}") > 0, F.lit(label)) for i, (_, label) in enumerate(phrases)])
    return df.select("doc_id", "row", "n_words", F.size(at).cast("long").alias("n_base"),
                     F.array_min(at).cast("long").alias("first_word"),
                     F.array_max(at).cast("long").alias("last_word"),
                     F.array_sort(F.array_distinct(F.array_compact(labels))).alias("base_list"))


def spans(docs: DataFrame, key: str = "doc_id", text: str = "text", templates=TEMPLATES, k: int = 4,
          drift: int = 3, least: float = 0.6) -> DataFrame:
    """``(doc_id, row, template, label, first_word, last_word, coverage)`` of template occurrences.

    Windows that hit diagonals at most ``drift`` apart, each with the next, are one occurrence; it
    stands when it holds at least ``least`` of the template's distinct windows, and that share is
    its coverage. A template below ``k`` words is not looked for. Each row votes for itself:
    ``row``, a hash of the text, tells rows with the same id, or with none, apart.
    """
    spark = docs.sparkSession
    given = spark.createDataFrame([(i, label, t) for i, (label, t) in enumerate(templates)],
                                  "template int, label string, t string")
    given = given.withColumn("w", _words(F.col("t"))).withColumn("size", F.size("w") - (k - 1))
    marks = given.select("template", "label", "size", F.posexplode(_windows(F.col("w"), k)).alias("t_at", "h"))
    if sum(len(t.split()) for _, t in templates) <= TEMPLATE_WINDOWS:
        marks = F.broadcast(marks)
    df = docs.select(F.col(key).alias("doc_id"), _row(text), _words(F.col(text)).alias("w"))
    df = df.select("doc_id", "row", F.posexplode(_windows(F.col("w"), k)).alias("at", "h"))
    hits = (df.join(marks, "h").groupBy("doc_id", "row", "template", "label", "size",
                                        (F.col("at") - F.col("t_at")).alias("diagonal"))
            .agg(F.collect_set("t_at").alias("seen"), F.min("at").alias("low"), F.max("at").alias("high")))
    order = Window.partitionBy("doc_id", "row", "template").orderBy("diagonal")
    cut = (F.col("diagonal") - F.lag("diagonal").over(order) > drift).cast("int")
    runs = (hits.withColumn("cut", F.coalesce(cut, F.lit(0)))
            .withColumn("run", F.sum("cut").over(order))
            .groupBy("doc_id", "row", "template", "label", "size", "run")
            .agg(F.size(F.array_distinct(F.flatten(F.collect_list("seen")))).alias("n"),
                 F.min("low").alias("low"), F.max("high").alias("high")))
    share = F.col("n") / F.col("size")
    return runs.where(share >= least).select(
        "doc_id", "row", "template", "label", F.col("low").cast("long").alias("first_word"),
        (F.col("high") + k - 1).cast("long").alias("last_word"), share.alias("coverage"))


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text", phrases=PHRASES, templates=TEMPLATES,
         k: int = 4, drift: int = 3, least: float = 0.6) -> DataFrame:
    """Phrase places, labels and score, one row per row of ``docs``.

    Words are lower-cased runs of ASCII letters and digits and of all characters above U+007F. The
    score is 1 for a document with a phrase, else its best template coverage, else 0. Null and empty
    texts have no words, no labels and score 0. Rows that share an id, or have none, are judged each
    by their own text.
    """
    docs = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"))
    found = (spans(docs, "doc_id", "text", templates, k, drift, least).groupBy("doc_id", "row")
             .agg(F.collect_set("label").alias("more"), F.max("coverage").alias("best")))
    found = stored(found, "licences").withColumnsRenamed({"doc_id": "found_id", "row": "found_row"})
    rows = base(docs, "doc_id", "text", phrases)
    rows = rows.join(found, F.col("doc_id").eqNullSafe(F.col("found_id")) & (F.col("row") == F.col("found_row")), "left")
    return rows.select(
        "doc_id", "n_words", "n_base", "first_word", "last_word",
        F.concat_ws(",", "base_list").alias("base_labels"),
        F.concat_ws(",", F.array_sort(F.array_distinct(F.concat(
            "base_list", F.coalesce("more", F.array().cast("array<string>")))))).alias("labels"),
        F.when(F.col("n_base") > 0, F.lit(1.0)).otherwise(F.coalesce("best", F.lit(0.0))).alias("score"))


def _sql_text(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def scan_sql(k: int = 4, drift: int = 3, least: float = 0.6) -> str:
    """The DuckDB twin of ``scan`` with its default phrases and templates."""
    word = r"regexp_extract_all(translate(coalesce({}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', " \
           r"'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
    leads = " || ' ' || ".join(["x", *[f"lead(x, {d}) over o" for d in range(1, k)]])
    phrases = ", ".join(f"({_sql_text(p)}, {_sql_text(label)}, {len(p.split())})" for p, label in PHRASES)
    templates = ", ".join(f"({i}, {_sql_text(label)}, {_sql_text(t)})" for i, (label, t) in enumerate(TEMPLATES))
    grams = {n: " || ' ' || ".join(["x", *[f"lead(x, {d}) over o" for d in range(1, n)]])
             for n in sorted({len(p.split()) for p, _ in PHRASES})}
    runs = ", ".join(f"{g} g{n}" for n, g in grams.items())
    cases = " or ".join(f"(p.n = {n} and g{n} = p.phrase)" for n in grams)
    return f"""
with d as (select doc_id, {word.format('text')} w from documents),
e as (select doc_id, unnest(w) x, unnest(range(0, len(w))) i from d),
n as (select doc_id, i, {runs}, {leads} gk from e window o as (partition by doc_id order by i)),
phrases(phrase, label, n) as (values {phrases}),
b as (select doc_id, count(*) n_base, min(i) first_word, max(i) last_word, list(distinct label) base_list
      from n join phrases p on {cases} group by doc_id),
templates(template, label, t) as (values {templates}),
tw as (select template, label, {word.format('t')} w from templates),
te as (select template, label, len(w) - {k - 1} size, unnest(w) x, unnest(range(0, len(w))) i from tw),
tg as (select template, label, size, i, {leads} g from te window o as (partition by template order by i)),
h as (select doc_id, template, label, size, n.i - tg.i diagonal, tg.i t_at from n join tg on n.gk = tg.g),
c as (select *, case when diagonal - lag(diagonal) over (partition by doc_id, template order by diagonal) > {drift}
                then 1 else 0 end cut from h),
r as (select *, sum(cut) over (partition by doc_id, template order by diagonal) run from c),
s as (select doc_id, label, count(distinct t_at) / any_value(size) coverage from r
      group by doc_id, template, label, run),
m as (select doc_id, list(distinct label) more, max(coverage) best from s where coverage >= {least} group by doc_id)
select d.doc_id, len(w)::bigint n_words, coalesce(n_base, 0)::bigint n_base, first_word::bigint first_word,
       last_word::bigint last_word, array_to_string(list_sort(coalesce(base_list, [])), ',') base_labels,
       array_to_string(list_sort(list_distinct(list_concat(coalesce(base_list, []), coalesce(more, [])))), ',') labels,
       case when n_base > 0 then 1.0 else coalesce(best, 0.0) end::double score
from d left join b on b.doc_id = d.doc_id left join m on m.doc_id = d.doc_id
"""
