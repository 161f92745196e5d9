r"""Licence scan: Dice coefficient over word bigrams against licence templates.

Texts are lower-cased, everything but letters and digits separates words. Units of a text
are its lines, the whole text and its passages (below). A unit of n distinct bigrams is held against a template
of m only if 2 min(n, m) / (n + m) reaches the threshold; then their Dice coefficient is
taken. To be near enough, a unit must hold over half of a template's bigrams, so it must
hold one of a fixed part of them (its anchors): documents without any anchor are left out
before their units are looked at, and nothing is lost.

Defined cases: null text and texts without a bigram match nothing; a unit that matches
several templates gets the best, and of equal ones the smaller name; the first of repeated
lines of a document stands for all of them, with their number; rows with equal ids and text
give equal rows; an empty table gives no rows; other columns are not read.

A notice that is wrapped over lines, or shares its line with other words, is a passage: a
run of words that starts and ends with a bigram of the template and has at most 1.5 times
(the Dice size bound) its bigrams. ``passages`` scores all of them. Only places where enough
of a template's bigrams lie close together are looked at, and nothing is lost. Of passages
that share a word the best stands: higher Dice, more bigrams, smaller name, earlier start.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from math import ceil

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomdoc.llm.common import table

THRESHOLD = 0.8

_MIT = (
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), "
    "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, "
    "and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: "
)
_MIT_KEEP = "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. "
_MIT_AS_IS = (
    "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, "
    "FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER "
    "LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
_ISC = (
    "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above "
    "copyright notice and this permission notice appear in all copies."
)
_APACHE = (
    "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy "
    "of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the "
    "License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific "
    "language governing permissions and limitations under the License."
)
_GPL = (
    "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free "
    "Software Foundation, either version 3 of the License, or (at your option) any later version."
)
_MPL = (
    "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can "
    "obtain one at https://mozilla.org/MPL/2.0/."
)
_BSD = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
    "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
    "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation "
    "and/or other materials provided with the distribution."
)

#: Notices and texts of public licences, by a name of this module's own.
TEMPLATES: dict[str, str] = {
    "apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0-header": _APACHE,
    "bsd-2-clause": _BSD,
    "bsd-3-clause-notice": "Redistributed under the terms of the BSD 3-Clause License.",
    "cc-by-4.0-notice": "Licensed under CC BY 4.0.",
    "cc-by-work-notice": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc-by-nc-4.0-notice": "Licensed under CC BY-NC 4.0.",
    "cc-by-sa-4.0-notice": "Licensed under CC BY-SA 4.0.",
    "gpl-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-3.0-header": _GPL,
    "isc": _ISC,
    "lgpl-3.0-header": _GPL.replace("GNU General Public License", "GNU Lesser General Public License"),
    "mit-notice": "Released under the MIT License.",
    "mit": _MIT + _MIT_KEEP + _MIT_AS_IS,
    "mit-grant": _MIT,
    "mit-warranty": _MIT_AS_IS,
    "mpl-2.0-header": _MPL,
    "unlicense-notice": "This is free and unencumbered software released into the public domain.",
}


def normal(text: str) -> list[str]:
    return re.findall(r"[^\W_]+", text.lower())


def bigrams(text: str) -> list[tuple[str, str]]:
    words = normal(text)
    return sorted(set(zip(words, words[1:], strict=False)))


def anchors(pairs: list[tuple[str, str]], threshold: float) -> list[tuple[str, str]]:
    """Bigrams of which each unit that reaches the threshold holds one: all but the fewest it must share, plus one; long words first, as they are rare."""
    least = ceil(threshold / (2 - threshold) * len(pairs) - 1e-9)
    return sorted(pairs, key=lambda p: (-len(p[0] + p[1]), p))[: len(pairs) - least + 1]


def words_of(text: Column) -> Column:
    """The words of a text; an array with one empty word if there is none."""
    return F.split(F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " ")), " ")


def hashes_of(words: Column) -> Column:
    """The hashes of neighbouring words."""
    return F.zip_with(F.slice(words, 1, F.greatest(F.size(words) - 1, F.lit(0))), F.slice(words, 2, F.size(words)), lambda a, b: F.xxhash64(a, b))


def once(c: Column) -> Column:
    """Makes words and hashes once; as plain columns they would be made again wherever they are used."""
    return F.explode(F.array(c))


def let(c: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that is made once, within a lambda."""
    return F.get(F.transform(F.array(c), f), F.lit(0))


def _constants(spark: SparkSession, templates: dict[str, str] | None, threshold: float) -> tuple[Column, Column]:
    """Hashes of all anchors, and (name, m, h, a, least, span) of each template: its distinct bigrams, their hashes and anchors, how many a match shares at least, and the most bigrams of a passage."""
    known = {k: p for k, v in sorted((templates or TEMPLATES).items()) if (p := bigrams(v))}

    def hashed(pairs: list[tuple[str, str]]) -> Column:
        return F.array(*(F.xxhash64(F.lit(a), F.lit(b)) for a, b in pairs))

    # Templates are a parameter: their hashes are constants of the plan.
    made = spark.range(1).select(hashed(sorted({a for p in known.values() for a in anchors(p, threshold)})).alias("a"), *(x for i, p in enumerate(known.values()) for x in (hashed(p).alias(f"t{i}"), hashed(anchors(p, threshold)).alias(f"a{i}")))).first()
    of = lambda k, i, p: {
        "name": k, "m": len(p), "h": list(made[f"t{i}"]), "a": list(made[f"a{i}"]), "least": ceil(threshold / (2 - threshold) * len(p) - 1e-9),
        "span": int((2 - threshold) / threshold * (len(normal((templates or TEMPLATES)[k])) - 1) + 1e-9),
    }
    return F.lit(list(made["a"])), F.array(*(F.struct(*(F.lit(v).alias(n) for n, v in of(k, i, p).items())) for i, (k, p) in enumerate(known.items())))


def scan(docs: DataFrame, templates: dict[str, str] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, unit (line or text), unit_no (from 1), copies, template, dice, n_bigrams of each match."""
    spark = docs.sparkSession
    first, against = _constants(spark, templates, threshold)

    text = F.col("text").cast("string")
    held = docs.select("doc_id", text.alias("text")).where("text is not null").select("doc_id", "text", once(words_of(F.col("text"))).alias("w")).where(F.arrays_overlap(hashes_of(F.col("w")), first))
    lines = F.transform(F.split("text", "\n"), lambda x, i: F.struct(F.lit("line").alias("unit"), (i + 1).alias("unit_no"), x.alias("body")))
    whole = F.array(F.struct(F.lit("text").alias("unit"), F.lit(1).alias("unit_no"), F.col("text").alias("body")))
    units = held.select("doc_id", F.explode(F.concat(lines, F.when(F.instr("text", "\n") > 0, whole).otherwise(F.slice(whole, 1, 0)))).alias("u")).select("doc_id", "u.*")
    units = units.select("*", once(words_of(F.col("body"))).alias("w")).select("doc_id", "unit", "unit_no", "body", once(F.array_distinct(hashes_of(F.col("w")))).alias("h"))
    units = units.where(F.arrays_overlap("h", first)).withColumn("n", F.size("h"))

    def near(t: Column) -> Column:
        return (2.0 * F.least(F.col("n"), t["m"]) >= threshold * (F.col("n") + t["m"])) & (2.0 * F.size(F.array_intersect("h", t["h"])) >= threshold * (F.col("n") + t["m"]))

    found = F.transform(F.filter(against, near), lambda t: F.struct((-2.0 * F.size(F.array_intersect("h", t["h"])) / (F.col("n") + t["m"])).alias("less"), t["name"].alias("name")))
    return (
        units.withColumn("best", F.array_min(found))
        .where("best is not null")
        .groupBy("doc_id", "unit", F.xxhash64("body").alias("_body"))
        .agg(F.min("unit_no").cast("long").alias("unit_no"), F.count("*").alias("copies"), F.min("best.name").alias("template"), F.min(-F.col("best.less")).alias("dice"), F.min("n").cast("long").alias("n_bigrams"))
        .drop("_body")
    )


def passages(docs: DataFrame, templates: dict[str, str] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, first_word (from 1), n_words, template, dice, n_bigrams of each passage that matches, wherever lines begin and end."""
    first, against = _constants(docs.sparkSession, templates, threshold)
    held = docs.select("doc_id", F.col("text").cast("string").alias("text")).where("text is not null").select("doc_id", once(words_of(F.col("text"))).alias("w"))
    held = held.select("doc_id", once(hashes_of(F.col("w"))).alias("h")).where(F.arrays_overlap("h", first))

    def places(t: Column) -> Column:
        """Where the text has bigrams of the template."""
        return F.filter(F.transform("h", lambda x, i: F.when(F.array_contains(t["h"], x), i)), lambda i: i.isNotNull())

    def starts(t: Column, at: Column) -> Column:
        """Places after which enough others follow within a passage's length."""
        every = F.when(F.size(at) >= t["least"], F.sequence(F.lit(0), F.size(at) - t["least"])).otherwise(F.array().cast("array<int>"))
        return F.filter(every, lambda j: F.get(at, j + t["least"] - 1) - F.get(at, j) < t["span"])

    def best(t: Column, at: Column, j: Column) -> Column:
        """The best passage from the j-th place on; null if none is near enough."""
        ends = F.filter(F.sequence(j + t["least"] - 1, F.least(F.size(at), j + t["span"]) - 1), lambda e: F.get(at, e) - F.get(at, j) < t["span"])

        def scored(e: Column) -> Column:
            return let(
                F.array_distinct(F.slice("h", F.get(at, j) + 1, F.get(at, e) - F.get(at, j) + 1)),
                lambda g: let(
                    F.size(F.array_intersect(g, t["h"])),
                    lambda c: F.when(
                        2.0 * c >= threshold * (F.size(g) + t["m"]),
                        F.struct((-2.0 * c / (F.size(g) + t["m"])).alias("less"), (-F.size(g)).alias("fewer"), t["name"].alias("name"), F.get(at, j).alias("start"), (F.get(at, e) + 1).alias("end")),
                    ),
                ),
            )

        return F.array_min(F.transform(ends, scored))

    def found(t: Column) -> Column:
        return let(places(t), lambda at: F.filter(F.transform(starts(t, at), lambda j: best(t, at, j)), lambda x: x.isNotNull()))

    near = held.select("doc_id", once(F.flatten(F.transform(F.filter(against, lambda t: F.arrays_overlap("h", t["a"])), found))).alias("near")).where("size(near) > 0")
    apart = F.aggregate(
        F.array_sort("near"), F.slice("near", 1, 0), lambda kept, x: F.when(F.exists(kept, lambda k: (k["start"] <= x["end"]) & (x["start"] <= k["end"])), kept).otherwise(F.concat(kept, F.array(x)))
    )
    return near.select("doc_id", F.explode(apart).alias("x")).select(
        "doc_id", (F.col("x.start") + 1).cast("long").alias("first_word"), (F.col("x.end") - F.col("x.start") + 1).cast("long").alias("n_words"), F.col("x.name").alias("template"), (-F.col("x.less")).alias("dice"), (-F.col("x.fewer")).cast("long").alias("n_bigrams")
    )


def op2_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines and whole texts that match, and passages, of which unit_no is the first word."""
    docs = table(spark, sf_dir, "documents")
    units = scan(docs).select("doc_id", "unit", "unit_no", "copies", "template", "dice", "n_bigrams")
    runs = passages(docs).select("doc_id", F.lit("passage").alias("unit"), F.col("first_word").alias("unit_no"), F.lit(1).cast("long").alias("copies"), "template", "dice", "n_bigrams")
    return units.unionByName(runs).withColumn("dice", F.round("dice", 9))


def _oracle() -> str:
    rows = ", ".join("('{}', '{}')".format(k, v.replace("'", "''")) for k, v in TEMPLATES.items())
    grams = r"list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))"
    words = r"string_split(trim(regexp_replace(lower({}), '[^\p{{L}}\p{{N}}]+', ' ', 'g')), ' ')"
    dice = f"{THRESHOLD}::double"
    return f"""
with templates(name, body) as (values {rows}),
t as (select name, {grams} as h, len(w) as words from (select name, {words.format("body")} as w from templates)),
units as (
    select doc_id, 'line' as unit, unnest(range(1, len(l) + 1)) as unit_no, unnest(l) as body from (select doc_id, string_split(text, chr(10)) as l from documents)
    union all select doc_id, 'text', 1, text from documents where contains(text, chr(10))),
u as (select doc_id, unit, unit_no, body, {grams} as h from (select *, {words.format("body")} as w from units)),
hits as (
    select u.*, name, len(u.h) as n, 2.0 * len(list_intersect(u.h, t.h)) / (len(u.h) + len(t.h)) as dice
    from u join t on 2.0 * least(len(u.h), len(t.h)) >= {THRESHOLD} * (len(u.h) + len(t.h)) and 2.0 * len(list_intersect(u.h, t.h)) >= {THRESHOLD} * (len(u.h) + len(t.h))),
best as (select *, row_number() over (partition by doc_id, unit, unit_no order by dice desc, name) as r from hits),
sized as (select name, h, len(h) as m, ceil({dice} / (2 - {dice}) * len(h) - 1e-9)::bigint as least, floor((2 - {dice}) / {dice} * (words - 1) + 1e-9)::bigint as span from t),
texts as (select row_number() over () as r, doc_id, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) as h from (select doc_id, {words.format("text")} as w from documents where text is not null)),
marks as (select r, name, i, least, span from (select r, unnest(h) as g, generate_subscripts(h, 1) as i from texts) join (select name, least, span, unnest(h) as g from sized) using (g)),
placed as (select *, row_number() over (partition by r, name order by i) as j from marks),
starts as (select * from (select *, lead(i, (least - 1)::int) over (partition by r, name order by i) as reach from placed) where reach - i < span),
runs as (
    select s.r, s.name, s.i as a, e.i as b, list_distinct(list_slice(x.h, s.i, e.i)) as g
    from starts s join placed e on s.r = e.r and s.name = e.name and e.j >= s.j + s.least - 1 and e.i - s.i < s.span join texts x on x.r = s.r),
scored as (
    select r, {{'less': -2.0::double * c / (n + m), 'fewer': -n, 'name': name, 'start': a - 1, 'stop': b}} as x
    from (select r, name, a, b, m, len(g) as n, len(list_intersect(g, sized.h)) as c from runs join sized using (name)) where 2.0::double * c >= {dice} * (n + m)),
near as (select r, min(x) as x from scored group by r, x.name, x.start),
apart as (
    select r, list_reduce(list([x] order by x), lambda kept, y: case when len(list_filter(kept, lambda k: k.start <= y[1].stop and y[1].start <= k.stop)) > 0 then kept else list_concat(kept, y) end) as kept
    from near group by r)
select doc_id, unit, min(unit_no)::bigint as unit_no, count(*)::bigint as copies, min(name) as template, round(min(dice), 9)::double as dice, min(n)::bigint as n_bigrams
from best where r = 1 group by doc_id, unit, body
union all
select doc_id, 'passage', (x.start + 1)::bigint, 1::bigint, x.name, round(-x.less, 9)::double, (-x.fewer)::bigint from (select doc_id, unnest(kept) as x from apart join texts using (r))
"""


ORACLE = _oracle()
