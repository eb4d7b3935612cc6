"""License recognition by sentence rules, with DataFrame functions only.

Texts are normalised (lower case, runs of letters and digits) with their breaks marked: hard ones at the end of a
sentence or paragraph, soft ones at a bare line end. A known license sentence is found where it stands between two
breaks of either kind and holds soft ones only: on a line of its own, or wrapped over lines, also behind comment signs.
A known sentence that makes up the first or last lines of a longer one counts besides it, as it may be a notice.
Their identifiers, in text order, form a sequence; a rule is an ordered list of identifiers and matches where the
sequence holds them in that order, other known sentences between them allowed. The rule tables are a fixed part of the
library, so mapping and matching happen in place and nothing is shuffled or broadcast per corpus.

The SQL cuts at every line end, so it gives the same rows for texts whose known sentences are not wrapped.

Defined results: null text counts as empty and matches nothing; a rule is reported once per row, however often it
occurs; rows that repeat an id are reported each; very long texts are searched whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Sentences of public license texts and notices, normalised.
SENTENCES = {
    "mit.released": "released under the mit license",
    "mit.licensed": "licensed under the mit license",
    "mit.project": "this project is licensed under the mit license",
    "mit.grant": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions",
    "mit.notice": "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
    "mit.warranty": "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement",
    "mit.liability": "in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software",
    "apache2.licensed": "licensed under the apache license version 2 0",
    "apache2.header": "licensed under the apache license version 2 0 the license",
    "apache2.comply": "you may not use this file except in compliance with the license",
    "apache2.obtain": "you may obtain a copy of the license at",
    "apache2.asis": "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied",
    "apache2.see": "see the license for the specific language governing permissions and limitations under the license",
    "gpl3.work": "this work is licensed under the gnu general public license version 3",
    "gpl3.licensed": "licensed under the gnu general public license version 3",
    "gpl.free": "this program is free software",
    "gpl3.redistribute": "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "gpl2.redistribute": "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version",
    "gpl.hope": "this program is distributed in the hope that it will be useful but without any warranty",
    "gpl.details": "see the gnu general public license for more details",
    "bsd.redistribution": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "bsd.source": "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
    "bsd.binary": "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
    "bsd.endorse": "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "isc.grant": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
    "ccbync4": "licensed under cc by nc 4 0",
    "ccby4": "licensed under cc by 4 0",
    "ccbysa4": "licensed under cc by sa 4 0",
    "ccby4.work": "this work is licensed under a creative commons attribution 4 0 international license",
    "ccbysa4.work": "this work is licensed under a creative commons attribution sharealike 4 0 international license",
    "ccbync4.work": "this work is licensed under a creative commons attribution noncommercial 4 0 international license",
    "cc0": "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work",
    "unlicense": "this is free and unencumbered software released into the public domain",
}
# Ordered rules (license, sentence identifiers).
RULES = {
    "mit-released": ("MIT", ["mit.released"]),
    "mit-licensed": ("MIT", ["mit.licensed"]),
    "mit-project": ("MIT", ["mit.project"]),
    "mit-text": ("MIT", ["mit.grant", "mit.notice", "mit.warranty", "mit.liability"]),
    "apache2-licensed": ("Apache-2.0", ["apache2.licensed"]),
    "apache2-header": ("Apache-2.0", ["apache2.header", "apache2.comply", "apache2.obtain", "apache2.asis", "apache2.see"]),
    "gpl3-work": ("GPL-3.0", ["gpl3.work"]),
    "gpl3-licensed": ("GPL-3.0", ["gpl3.licensed"]),
    "gpl3-header": ("GPL-3.0-or-later", ["gpl.free", "gpl3.redistribute", "gpl.hope", "gpl.details"]),
    "gpl2-header": ("GPL-2.0-or-later", ["gpl.free", "gpl2.redistribute", "gpl.hope", "gpl.details"]),
    "bsd2-text": ("BSD-2-Clause", ["bsd.redistribution", "bsd.source", "bsd.binary"]),
    "bsd3-text": ("BSD-3-Clause", ["bsd.redistribution", "bsd.source", "bsd.binary", "bsd.endorse"]),
    "isc-text": ("ISC", ["isc.grant"]),
    "ccbync4-notice": ("CC-BY-NC-4.0", ["ccbync4"]),
    "ccby4-notice": ("CC-BY-4.0", ["ccby4"]),
    "ccbysa4-notice": ("CC-BY-SA-4.0", ["ccbysa4"]),
    "ccby4-work": ("CC-BY-4.0", ["ccby4.work"]),
    "ccbysa4-work": ("CC-BY-SA-4.0", ["ccbysa4.work"]),
    "ccbync4-work": ("CC-BY-NC-4.0", ["ccbync4.work"]),
    "cc0-waiver": ("CC0-1.0", ["cc0"]),
    "unlicense-text": ("Unlicense", ["unlicense"]),
}
#: Where the SQL cuts: at a mark followed by white space and at every line end.
BREAK = r"[.!?;:]+[\s\"')\]]+|\n\s*\n|\n"
#: Where no sentence goes on: a mark followed by white space, or lines without letters and digits.
HARD_BREAK = r"[.!?;:]+[\s\"')\]]+|\n[^\p{L}\p{N}]*\n"
HARD, SOFT = "\x01", "\x02"


def _numbers() -> dict[str, int]:
    return {name: k for k, name in enumerate(SENTENCES)}


def _pattern(names: list[str]) -> str:
    number = _numbers()
    return r"\|(\d+\|)*".join(f"{number[n]}" for n in names)


def _rules() -> list[tuple[str, str, int, str]]:
    return [(rule, name, len(ids), r"\|" + _pattern(ids) + r"\|") for rule, (name, ids) in RULES.items()]


def _finder() -> str:
    """A break with a known sentence after it: group 1 is the shortest one, group 2 one that goes on from another."""
    one_of = lambda known: "|".join(s.replace(" ", f"[ {SOFT}]++") for s in sorted(known, key=len))
    longer = [s for s in SENTENCES.values() if any(s.startswith(t + " ") for t in SENTENCES.values())]
    end = f" ?[{HARD}{SOFT}]"
    return f"[{HARD}{SOFT}] ?(?=({one_of(SENTENCES.values())}){end})(?:(?=({one_of(longer)}){end})|)"


def _sentences(text):
    """The known sentences of a text, normalised, in text order."""
    plain = F.translate(F.lower(F.coalesce(text.cast("string"), F.lit(""))), HARD + SOFT, "--")
    marked = F.translate(F.regexp_replace(plain, HARD_BREAK, HARD), "\n", SOFT)
    stream = F.concat(F.lit(HARD), F.regexp_replace(marked, rf"[^\p{{L}}\p{{N}}{HARD}{SOFT}]+", " "), F.lit(HARD))
    first, more = (F.regexp_extract_all(stream, F.lit(_finder()), F.lit(k)) for k in (1, 2))
    both = F.when(F.size(first) > 0, F.flatten(F.zip_with(first, more, lambda a, b: F.array_distinct(F.array(a, b)))))
    return F.transform(F.filter(both, lambda s: s != ""), lambda s: F.regexp_replace(s, f"[ {SOFT}]+", " "))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, license, rule, n_sentences, n_known): the rules that each text matches."""
    known = F.create_map(*[F.lit(x) for name, k in _numbers().items() for x in (SENTENCES[name], k)])
    ids = F.transform(_sentences(docs[text_col]), lambda s: F.element_at(known, s))
    found = docs.select(docs[id_col].alias("id"), ids.alias("ids")).filter(F.size("ids") > 0)
    found = found.select("id", F.size("ids").alias("n_known"), F.concat(F.lit("|"), F.array_join(F.col("ids").cast("array<string>"), "|"), F.lit("|")).alias("seq"))
    rules = F.array(*[F.struct(F.lit(a).alias("rule"), F.lit(b).alias("license"), F.lit(n).alias("n_sentences"), F.lit(p).alias("pattern")) for a, b, n, p in _rules()])
    hit = found.select("id", "n_known", "seq", F.explode(rules).alias("r")).filter(F.expr("rlike(seq, r.pattern)"))
    return hit.select(F.col("id").alias(id_col), "r.license", "r.rule", "r.n_sentences", "n_known")


def _oracle() -> str:
    text = lambda s: "'" + s.replace("'", "''") + "'"
    known = ", ".join(f"({k}, {text(SENTENCES[n])})" for n, k in _numbers().items())
    rules = ", ".join(f"({text(a)}, {text(b)}, {n}, {text(p)})" for a, b, n, p in _rules())
    return f"""
WITH known(k, s) AS (VALUES {known}), rules(rule, license, n_sentences, pattern) AS (VALUES {rules}),
cut AS (SELECT doc_id, unnest(parts) AS part, generate_subscripts(parts, 1) AS i
        FROM (SELECT doc_id, regexp_split_to_array(coalesce(text, ''), {text(BREAK)}) AS parts FROM documents)),
ids AS (SELECT doc_id, i, k FROM cut JOIN known ON trim(regexp_replace(lower(part), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')) = s),
seqs AS (SELECT doc_id, CAST(count(*) AS INTEGER) AS n_known, '|' || string_agg(CAST(k AS VARCHAR), '|' ORDER BY i) || '|' AS seq FROM ids GROUP BY 1)
SELECT doc_id, license, rule, n_sentences, n_known FROM seqs JOIN rules ON regexp_matches(seq, pattern)
"""


ORACLE = _oracle()


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
