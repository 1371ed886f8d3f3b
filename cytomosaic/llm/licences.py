"""Licence scan by sentence rules: normalised sentences become identifiers, identifier sequences meet ordered licence rules.

A text is cut into sentences; each is normalised and looked up among the known licence sentences. Adjacent known sentences form
a sequence, and every sequence is matched against the rules in their order: a rule consumes its sentences, so that the long
rules see a sentence before the short ones do. What no rule consumes is reported as an unmatched sentence.
"""

from __future__ import annotations

import functools
import itertools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# ---- fixed values: wording of well-known licences ---------------------------------------------------------------

#: Licence names as they are written in grants, and their identifier.
NAMES = {
    "mit license": "MIT", "apache license version 2 0": "Apache-2.0", "apache license 2 0": "Apache-2.0",
    "gnu general public license version 2": "GPL-2.0", "gnu general public license version 3": "GPL-3.0",
    "gnu general public license version 2 or later": "GPL-2.0-or-later", "gnu general public license version 3 or later": "GPL-3.0-or-later",
    "gnu lesser general public license version 2 1": "LGPL-2.1", "gnu lesser general public license version 3": "LGPL-3.0",
    "gnu affero general public license version 3": "AGPL-3.0", "mozilla public license version 2 0": "MPL-2.0",
    "bsd 2 clause license": "BSD-2-Clause", "bsd 3 clause license": "BSD-3-Clause", "isc license": "ISC",
    "cc by 4 0": "CC-BY-4.0", "cc by sa 4 0": "CC-BY-SA-4.0", "cc by nc 4 0": "CC-BY-NC-4.0", "cc by nd 4 0": "CC-BY-ND-4.0",
    "cc by nc sa 4 0": "CC-BY-NC-SA-4.0", "cc0 1 0": "CC0-1.0",
    "creative commons attribution 4 0 international license": "CC-BY-4.0",
    "creative commons attribution sharealike 4 0 international license": "CC-BY-SA-4.0",
    "creative commons attribution noncommercial 4 0 international license": "CC-BY-NC-4.0",
}
#: Openings of a grant; each is followed by a licence name.
GRANTS = ["released under", "licensed under", "distributed under", "available under", "this work is licensed under", "this project is licensed under",
          "this software is licensed under", "this file is licensed under", "this program is licensed under", "released under the terms of",
          "licensed under the terms of", "distributed under the terms of"]
#: Sentences of longer licence texts; "|" marks where their published forms have a ; or : or a blank line, which cuts them.
SENTENCES = {
    "MITgrant": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions",
    "MITnotice": "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
    "ASIS": "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement",
    "MITliable": "in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software",
    "ApacheMayNot": "you may not use this file except in compliance with the license",
    "ApacheCopy": "you may obtain a copy of the license at | http www apache org licenses license 2 0",
    "ApacheBasis": "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied",
    "ApacheSee": "see the license for the specific language governing permissions and limitations under the license",
    "GPLfree3+": "this program is free software | you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation | either version 3 of the license or at your option any later version",
    "GPLfree2+": "this program is free software | you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation | either version 2 of the license or at your option any later version",
    "GPLhope": "this program is distributed in the hope that it will be useful but without any warranty | without even the implied warranty of merchantability or fitness for a particular purpose",
    "GPLdetails": "see the gnu general public license for more details",
    "BSDgrant": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "BSDsource": "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
    "BSDbinary": "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
    "BSDnames": "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "MPLsubject": "this source code form is subject to the terms of the mozilla public license v 2 0",
    "MPLsubject2": "this source code form is subject to the terms of the mozilla public license v",  # cut in "v. 2.0"; no other version has a "Source Code Form"
    "ApacheCopys": "you may obtain a copy of the license at | https www apache org licenses license 2 0",
    "Unlicense": "this is free and unencumbered software released into the public domain",
    "PublicDomain": "this work is in the public domain",
    "AllRights": "all rights reserved",
}
#: Sentences that say the same as another one.
SAME = {"MPLsubject2": "MPLsubject", "ApacheCopys": "ApacheCopy"}
#: Rules in the order of their trial: licence, sentence identifiers that must follow each other.
WHOLE_RULES = [
    ("MIT", ["MITgrant", "MITnotice", "ASIS", "MITliable"]), ("MIT", ["MITgrant", "MITnotice"]), ("MIT", ["MITgrant"]),
    ("Apache-2.0", ["Grant:Apache-2.0", "ApacheMayNot", "ApacheCopy", "ApacheBasis", "ApacheSee"]), ("Apache-2.0", ["ApacheMayNot", "ApacheCopy"]),
    ("GPL-3.0-or-later", ["GPLfree3+", "GPLhope", "GPLdetails"]), ("GPL-2.0-or-later", ["GPLfree2+", "GPLhope", "GPLdetails"]),
    ("GPL-3.0-or-later", ["GPLfree3+"]), ("GPL-2.0-or-later", ["GPLfree2+"]),
    ("BSD-3-Clause", ["BSDgrant", "BSDsource", "BSDbinary", "BSDnames"]), ("BSD-2-Clause", ["BSDgrant", "BSDsource", "BSDbinary"]),
    ("MPL-2.0", ["MPLsubject"]), ("Unlicense", ["Unlicense"]), ("LicenseRef-Public-Domain", ["PublicDomain"]),
    *[(licence, [f"Grant:{licence}"]) for licence in sorted(set(NAMES.values()))],
    ("LicenseRef-All-Rights-Reserved", ["AllRights"]),
]
# ---- end of fixed values -----------------------------------------------------------------------------------------

_MARKS = r"[\x09-\x2F\x3A-\x40\x5B-\x60\x7B-\x7E]*"
_NUMBER = rf"(?:{_MARKS}[0-9]{{1,2}}[.)][\x20\x09-\x0D]+)?"
#: A sentence ends at . ! ? ; : before white space, or at a line without letters and digits; the number of a list item after it
#: belongs to the break. Other line feeds end it unless it is known with the lines that follow: licence texts are often wrapped.
BREAK = rf"(?:[.!?;:]+[\x20\x09-\x0D]+|\n{_MARKS}\n){_NUMBER}"


def spellings(name: str) -> list[dict[str, str]]:
    """The ways to cut a sentence at its marks, each as normalised part -> identifier; the uncut sentence comes first."""
    pieces = SENTENCES[name].split(" | ")
    ways = []
    for cuts in range(1 << len(pieces) - 1):
        parts = [pieces[0]]
        for i, piece in enumerate(pieces[1:]):
            if cuts >> i & 1:
                parts.append(piece)
            else:
                parts[-1] += " " + piece
        ways.append({p: SAME.get(name, name) if len(parts) == 1 else _part_names()[p] for p in parts})
    return ways


@functools.cache
def _part_names() -> dict[str, str]:
    """Identifier of every proper part of a sentence; sentences that begin or end alike share the part and its name."""
    names: dict[str, str] = {}
    for name, text in SENTENCES.items():
        pieces = text.split(" | ")
        for a in range(len(pieces)):
            for b in range(a + 1, len(pieces) + 1):
                if b - a < len(pieces):
                    names.setdefault(" ".join(pieces[a:b]), f"{SAME.get(name, name)}:{a + 1}-{b}" + ("s" if name == "ApacheCopys" else ""))
    return names


def _spelled(rules: list[tuple[str, list[str]]]) -> list[tuple[str, list[str]]]:
    """Every rule with each way to cut its sentences, in the order of the rules."""
    same = {name: [name, *[n for n, first in SAME.items() if first == name]] for name in SENTENCES}
    ways = {name: list(dict.fromkeys(tuple(way.values()) for n in names for way in spellings(n))) for name, names in same.items()}
    return list(dict.fromkeys((licence, sum(choice, ())) for licence, needed in rules for choice in itertools.product(*[ways.get(n, [(n,)]) for n in needed])))


RULES = [(licence, list(needed)) for licence, needed in _spelled(WHOLE_RULES)]


def known_sentences() -> dict[str, str]:
    """Normalised sentence -> identifier: the wording above, whole and cut, and every grant with every licence name, with and without
    article, also where the name is then defined as (the "License")."""
    known = {part: sid for name in SENTENCES for way in spellings(name) for part, sid in way.items()}
    for grant in GRANTS:
        for name, licence in NAMES.items():
            for article in ("", "the ", "a "):
                for defined in ("", " the license"):
                    known[f"{grant} {article}{name}{defined}"] = f"Grant:{licence}"
    return known


def normalised(sentence: Column) -> Column:
    """Lower-cased (A-Z) words of letters and digits, one blank between them."""
    folded = F.translate(sentence, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.trim(F.regexp_replace(folded, "[^a-z0-9]+", " "))


def identified(docs: DataFrame) -> DataFrame:
    """(doc_id, mark, at, sid): known sentences of every row with their number in the text; mark is a hash of the text."""
    spark = docs.sparkSession
    pairs = sorted(known_sentences().items())
    known = spark.createDataFrame(pairs, "sentence string, sid string")  # a fixed list: safe to broadcast
    rows = docs.select(F.col("doc_id"), F.xxhash64(F.col("text").cast("string")).alias("mark"), F.col("text").cast("string").alias("text"))
    names = [sentence for sentence, _ in pairs]
    lines = F.transform(F.split("text", BREAK), lambda p: F.when(p.contains("\n") & ~normalised(p).isin(names), F.split(p, "\n")).otherwise(F.array(p)))
    parts = rows.select("doc_id", "mark", F.posexplode(F.flatten(lines)).alias("at", "part"))
    sentences = parts.select("doc_id", "mark", "at", normalised(F.col("part")).alias("sentence"))
    return sentences.join(F.broadcast(known), "sentence").select("doc_id", "mark", "at", "sid")


def sequences(found: DataFrame) -> DataFrame:
    """(doc_id, mark, first, sids): maximal runs of adjacent known sentences as one string ``,id,id,``.

    Any other sentence between two known ones breaks a run; repeated rows of a document count once.
    """
    rows = found.distinct()
    order = Window.partitionBy("doc_id", "mark").orderBy("at")
    runs = rows.withColumn("run", F.col("at") - F.row_number().over(order))
    return runs.groupBy("doc_id", "mark", "run").agg(F.min("at").alias("first"), F.array_sort(F.collect_list(F.struct("at", "sid"))).alias("s")).select(
        "doc_id", "mark", "first", F.concat(F.lit(","), F.array_join(F.col("s.sid"), ",,"), F.lit(",")).alias("sids"))


def apply_rules(runs: DataFrame) -> DataFrame:
    """(doc_id, licence, n): how often the rules of each licence consumed their sentences; leftovers as ``unmatched:<identifier>``."""
    rules = F.array(*[F.struct(F.lit(licence).alias("licence"), F.lit("".join(f",{sid}," for sid in needed)).alias("needed")) for licence, needed in RULES])
    start = F.struct(F.col("sids").alias("left"), F.array().cast("array<struct<licence: string, n: long>>").alias("found"))

    def apply(state, rule):
        left = F.replace(state["left"], rule["needed"], F.lit("|"))
        n = F.floor((F.length(state["left"]) - F.length(left)) / (F.length(rule["needed"]) - 1))
        hit = F.array(F.struct(rule["licence"].alias("licence"), n.alias("n")))
        return F.struct(left.alias("left"), F.when(n > 0, F.concat(state["found"], hit)).otherwise(state["found"]).alias("found"))

    done = runs.select("doc_id", F.aggregate(rules, start, apply).alias("end"))
    matched = done.select("doc_id", F.inline("end.found"))
    unmatched = done.select("doc_id", F.explode(F.regexp_extract_all("end.left", F.lit("[^,|]+"), F.lit(0))).alias("sid")).select(
        "doc_id", F.concat(F.lit("unmatched:"), "sid").alias("licence"), F.lit(1).cast("long").alias("n"))
    return matched.union(unmatched).groupBy("doc_id", "licence").agg(F.sum("n").alias("n"))


def scan(docs: DataFrame) -> DataFrame:
    """(doc_id, licence, n) of every licence found in ``docs`` (columns doc_id and text; others are ignored).

    Null and empty texts hold no licence and give no row. Repeated rows count once; rows that share a doc_id but not their text
    are read apart and reported together.
    """
    return apply_rules(sequences(identified(docs)))
