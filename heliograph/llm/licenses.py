"""License scan by sentence rules, on DataFrame functions only.

A text is normalised to words (lower case, letters and digits only) with marks between them where a line or a sentence
ends. A known licence sentence, which has an identifier, begins and ends at such marks and may run over line ends, with or
without comment leaders, and over semicolons and colons, but not over full stops and blank lines. The identifiers of a text, in order, are then matched against an ordered list of rules, each
a sequence of identifiers; what a rule has matched is taken out, so that long rules come before the references they hold.
Identifiers that no rule takes are reported as remaining.

Defined results: a null or empty text has no sentences; a null doc_id is kept; repeated rows give repeated results; an
empty table gives no rows. Everything happens within the row: nothing is shuffled, whatever a source or group holds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

#: Known sentences, normalised, by identifier.
SENTENCES = {
    "MITref": ["released under the mit license", "licensed under the mit license", "this project is licensed under the mit license", "distributed under the mit license"],
    "MITgrant": ["permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions"],
    "MITnotice": ["the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"],
    "MITasis": ["the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement"],
    "MITliable": ["in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software"],
    "Apache2ref": ["licensed under the apache license version 2 0", "licensed under the apache license version 2 0 the license", "this project is licensed under the apache license 2 0"],
    "Apache2use": ["you may not use this file except in compliance with the license"],
    "Apache2copy": ["you may obtain a copy of the license at http www apache org licenses license 2 0", "you may obtain a copy of the license at"],
    "Apache2asis": ["unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied"],
    "Apache2see": ["see the license for the specific language governing permissions and limitations under the license"],
    "GPL3ref": ["this work is licensed under the gnu general public license version 3", "licensed under the gnu general public license version 3", "released under the gnu general public license version 3"],
    "GPL2ref": ["this work is licensed under the gnu general public license version 2", "licensed under the gnu general public license version 2"],
    "GPLfree": ["this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version"],
    "GPL2free": ["this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version"],
    "GPLhope": ["this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose"],
    "GPLsee": ["see the gnu general public license for more details"],
    "GPLcopy": ["you should have received a copy of the gnu general public license along with this program", "you should have received a copy of the gnu general public license along with this program if not see https www gnu org licenses"],
    "LGPL3ref": ["licensed under the gnu lesser general public license version 3"],
    "AGPL3ref": ["licensed under the gnu affero general public license version 3"],
    "BSDgrant": ["redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"],
    "BSDsource": ["redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"],
    "BSDbinary": ["redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution"],
    "BSDendorse": ["neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"],
    "BSDref": ["licensed under the bsd 3 clause license", "released under the bsd 3 clause license"],
    "BSD2ref": ["licensed under the bsd 2 clause license", "released under the bsd 2 clause license"],
    "ISCgrant": ["permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"],
    "MPL2ref": ["this source code form is subject to the terms of the mozilla public license v 2 0", "licensed under the mozilla public license version 2 0"],
    "CCBY4ref": ["licensed under cc by 4 0", "this work is licensed under a creative commons attribution 4 0 international license"],
    "CCBYNC4ref": ["licensed under cc by nc 4 0", "this work is licensed under a creative commons attribution noncommercial 4 0 international license"],
    "CCBYSA4ref": ["licensed under cc by sa 4 0", "this work is licensed under a creative commons attribution sharealike 4 0 international license"],
    "CC0ref": ["licensed under cc0 1 0", "this work has been dedicated to the public domain under cc0 1 0"],
    "Unlicense": ["this is free and unencumbered software released into the public domain"],
    "AllRights": ["all rights reserved"],
    "GPL1title": ["gnu general public license version 1 february 1989"],
    "GPL2title": ["gnu general public license version 2 june 1991"],
    "GPL3title": ["gnu general public license version 3 29 june 2007"],
    "LGPL2title": ["gnu library general public license version 2 june 1991"],
    "LGPL21title": ["gnu lesser general public license version 2 1 february 1999"],
    "LGPL3title": ["gnu lesser general public license version 3 29 june 2007"],
    "AGPL3title": ["gnu affero general public license version 3 19 november 2007"],
    "GFDL12title": ["gnu free documentation license version 1 2 november 2002"],
    "GFDL13title": ["gnu free documentation license version 1 3 3 november 2008"],
    "Apache2title": ["apache license version 2 0 january 2004", "apache license version 2 0 january 2004 http www apache org licenses"],
    "MPL11title": ["mozilla public license version 1 1"],
    "MPL2title": ["mozilla public license version 2 0"],
    "CC0title": ["creative commons legal code cc0 1 0 universal", "cc0 1 0 universal"],
    "Artistic1": ["the intent of this document is to state the conditions under which a package may be copied such that the copyright holder maintains some semblance of artistic control over the development of the package while giving the users of the package the right to use and distribute the package in a more or less customary fashion plus the right to make reasonable modifications"],
    "PSF2title": ["python software foundation license version 2"],
}

#: Sentences with slots, as patterns over normalised words; what matches is known as the identifier's sentence.
SLOTS = {"BSDendorse": [r"(?:neither|the|no|nor|use) (?:[a-z0-9]+ ){1,60}?endorse or promote products derived from this software(?: [a-z0-9]+){0,12}"]}

#: Ordered rules, each a licence and the sequence of identifiers that states it.
RULES = [
    ("GPL-2.0", ["GPL2title", "GPL2free", "GPLhope", "GPLsee", "GPLcopy"]),
    ("GPL-3.0", ["GPL3title", "GPLfree", "GPLhope", "GPLsee", "GPLcopy"]),
    ("GPL-2.0", ["GPL2title"]),
    ("GPL-3.0", ["GPL3title"]),
    ("GPL-1.0", ["GPL1title"]),
    ("LGPL-2.0", ["LGPL2title"]),
    ("LGPL-2.1", ["LGPL21title"]),
    ("LGPL-3.0", ["LGPL3title"]),
    ("AGPL-3.0", ["AGPL3title"]),
    ("GFDL-1.2", ["GFDL12title"]),
    ("GFDL-1.3", ["GFDL13title"]),
    ("Apache-2.0", ["Apache2title", "Apache2ref", "Apache2use", "Apache2copy", "Apache2asis", "Apache2see"]),
    ("Apache-2.0", ["Apache2title"]),
    ("MPL-1.1", ["MPL11title"]),
    ("MPL-2.0", ["MPL2title", "MPL2ref"]),
    ("MPL-2.0", ["MPL2title"]),
    ("CC0-1.0", ["CC0title"]),
    ("Artistic-1.0", ["Artistic1"]),
    ("PSF-2.0", ["PSF2title"]),
    ("MIT", ["MITgrant", "MITnotice", "MITasis", "MITliable"]),
    ("MIT", ["MITgrant", "MITnotice", "MITasis"]),
    ("Apache-2.0", ["Apache2ref", "Apache2use", "Apache2copy", "Apache2asis", "Apache2see"]),
    ("Apache-2.0", ["Apache2ref", "Apache2use", "Apache2copy"]),
    ("GPL-3.0-or-later", ["GPLfree", "GPLhope", "GPLsee", "GPLcopy"]),
    ("GPL-3.0-or-later", ["GPLfree"]),
    ("GPL-2.0-or-later", ["GPL2free", "GPLhope", "GPLsee", "GPLcopy"]),
    ("GPL-2.0-or-later", ["GPL2free"]),
    ("BSD-3-Clause", ["BSDgrant", "BSDsource", "BSDbinary", "BSDendorse"]),
    ("BSD-2-Clause", ["BSDgrant", "BSDsource", "BSDbinary"]),
    ("ISC", ["ISCgrant"]),
    ("MIT", ["MITref"]),
    ("Apache-2.0", ["Apache2ref"]),
    ("GPL-3.0", ["GPL3ref"]),
    ("GPL-2.0", ["GPL2ref"]),
    ("LGPL-3.0", ["LGPL3ref"]),
    ("AGPL-3.0", ["AGPL3ref"]),
    ("BSD-3-Clause", ["BSDref"]),
    ("BSD-2-Clause", ["BSD2ref"]),
    ("MPL-2.0", ["MPL2ref"]),
    ("CC-BY-4.0", ["CCBY4ref"]),
    ("CC-BY-NC-4.0", ["CCBYNC4ref"]),
    ("CC-BY-SA-4.0", ["CCBYSA4ref"]),
    ("CC0-1.0", ["CC0ref"]),
    ("Unlicense", ["Unlicense"]),
]

#: What begins a line and isn't part of its sentence: signs, words that begin comments, the letter or number of an item.
LEADER = r"(?<![^\n])[^a-z0-9\n]*+(?:(?:rem|dnl|c)(?![^ \t\r\n])[^a-z0-9\n]*+)?(?:(?:[a-z]|[0-9]{1,2}|[ivx]{2,4})\)[ \t]++)?"
#: The marks X, S and N (texts are in lower case): a full stop, a semicolon or colon, and a line end; then, of all between two words, X or N.
MARKS = [(LEADER, ""), (r"[.!?](?=[ \t\r\n])", "X"), (r"[;:](?=[ \t\r\n])", "S"), (r"\n", "N"), ("[^a-z0-9XSN]+", " "), (r"(?<![ XSN])[ S]*+(?:N[ S]*+)?+[XN][ XSN]*+", "X"), (r"(?<![ XSN]) *+[SN][ SN]*+", "N")]
#: Sentence ends of the SQL, which reads lines one by one.
SENTENCE_END = r"[.!?;:]+[ \t\r]*\n|[.!?;:]+[ \t\r]+|\n[ \t\r]*\n|\n"
#: Words that every known sentence has one of; a cheap test before sentences are normalised.
TELLING = sorted({"licen", "permission", "redistribut", "warrant", "copy", "rights", "public", "provided", "mozilla", "cc0", "free software", "liable", "endorse", "bsd", "agreed", "granted", "universal"})


def known() -> dict[str, str]:
    """Normalised sentence -> identifier."""
    return {s: i for i, sentences in SENTENCES.items() for s in sentences}


def sequence(ids: list[str]) -> str:
    return "".join(f"<{i}>" for i in ids)


def marked(text: Column) -> Column:
    """The words of a text with one character between two of them: a space, N for an end that sentences may run over, or X."""
    text = F.concat(F.lit("\n\n"), F.lower(text), F.lit("\n\n"))
    for pattern, mark in MARKS:
        text = F.regexp_replace(text, pattern, mark)
    return text


def pattern() -> str:
    """Any known sentence, the longest first, in a marked text; the stop of "v. 2.0" ends nothing."""
    words = [s.replace(" ", "[ N]").replace("v[ N]2", "v[ NX]2") for s in sorted(known(), key=len, reverse=True)]
    slots = [p.replace(" ", "[ N]") for patterns in SLOTS.values() for p in patterns]
    return f"(?<=[NX])(?:{'|'.join(words + slots)})(?=[NX])"


def plain(sentence: Column) -> Column:
    """A sentence as it is known: without marks, and without what stands in slots."""
    sentence = F.translate(sentence, "NX", "  ")
    for name, patterns in SLOTS.items():
        for p in patterns:
            sentence = F.regexp_replace(sentence, f"^{p}$", SENTENCES[name][0])
    return sentence


def scan(df: DataFrame) -> DataFrame:
    """doc_id, licenses (array, one entry for each rule match kind in rule order), sentence_ids (array, in order) and remaining (array)."""
    table = F.create_map(*(F.lit(x) for pair in known().items() for x in pair))
    telling = "(?i)" + "|".join(TELLING)
    rules = F.array(*(F.struct(F.lit(name).alias("name"), F.lit(sequence(ids)).alias("ids")) for name, ids in RULES))
    start = lambda ids: F.struct(F.concat_ws("", F.transform(ids, lambda i: F.concat(F.lit("<"), i, F.lit(">")))).alias("left"), F.array().cast("array<string>").alias("found"))
    step = lambda acc, rule: F.struct(
        F.replace(acc["left"], rule["ids"], F.lit("")).alias("left"),
        F.when(F.contains(acc["left"], rule["ids"]), F.concat(acc["found"], F.array(rule["name"]))).otherwise(acc["found"]).alias("found"),
    )
    ids = F.transform(F.regexp_extract_all(marked(F.col("text")), F.lit(pattern()), F.lit(0)), lambda s: F.element_at(table, plain(s)))
    matched = common.texts(df).select("doc_id", F.when(F.col("text").rlike(telling), ids).otherwise(F.array().cast("array<string>")).alias("sentence_ids"))
    done = matched.select("doc_id", "sentence_ids", F.aggregate(rules, start(F.col("sentence_ids")), step).alias("m"))
    return done.select("doc_id", "sentence_ids", F.array_distinct("m.found").alias("licenses"), F.filter(F.split(F.regexp_replace("m.left", "[<>]+", " "), " "), lambda x: x != "").alias("remaining"))


def oracle_sql() -> str:
    """DuckDB SQL for the digest columns of ``scan`` over documents."""
    pairs = ", ".join(f"('{s}', '{i}')" for s, i in known().items())
    steps, last = [], "s0"
    for k, (name, ids) in enumerate(RULES, 1):
        steps.append(f"s{k} AS (SELECT doc_id, sentence_ids, replace(rest, '{sequence(ids)}', '') AS rest, CASE WHEN contains(rest, '{sequence(ids)}') THEN list_append(found, '{name}') ELSE found END AS found FROM {last})")
        last = f"s{k}"
    end, sentence = SENTENCE_END, "trim(regexp_replace(lower(part), '[^a-z0-9]+', ' ', 'g'))"
    for name, patterns in SLOTS.items():
        for p in patterns:
            sentence = f"regexp_replace({sentence}, '^{p}$', '{SENTENCES[name][0]}')"
    return f"""WITH known(sentence, id) AS (VALUES {pairs}),
parts AS (SELECT doc_id, unnest(regexp_split_to_array(coalesce(text, ''), '{end}')) AS part, generate_subscripts(regexp_split_to_array(coalesce(text, ''), '{end}'), 1) AS pos FROM documents),
hits AS (SELECT doc_id, pos, id FROM (SELECT doc_id, pos, {sentence} AS sentence FROM parts) JOIN known USING (sentence)),
grouped AS (SELECT doc_id, string_agg(id, ',' ORDER BY pos) AS sentence_ids, string_agg('<' || id || '>', '' ORDER BY pos) AS rest FROM hits GROUP BY doc_id),
s0 AS (SELECT d.doc_id, coalesce(g.sentence_ids, '') AS sentence_ids, coalesce(g.rest, '') AS rest, CAST([] AS VARCHAR[]) AS found FROM documents d LEFT JOIN grouped g USING (doc_id)),
{", ".join(steps)}
SELECT doc_id, sentence_ids, array_to_string([x FOR x, i IN found IF i = list_position(found, x)], ',') AS licenses, array_to_string([x FOR x IN string_split(regexp_replace(rest, '[<>]+', ' ', 'g'), ' ') IF x <> ''], ',') AS remaining FROM {last}"""
