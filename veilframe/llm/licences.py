"""Licence scans by sentence rules, with DataFrame expressions alone.

A text is cut into sentences, sentences are normalised, and those that a table knows become licence-sentence identifiers.
Rules are ordered: each asks for a sequence of identifiers in that order, not broken by another licence sentence; the
first rule that holds at a place wins and takes its sentences with it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

# Sentences of public licences and notices as normalised (lower case, words parted by one space, full stops
# inside versions as spaces). A pattern stands for the whole sentence; Q is any quotation mark or none.
Q = "[\"'“”‘’`]{0,2}"
_CC = {"by": "attribution", "by-sa": "attribution-sharealike", "by-nd": "attribution-noderiv(?:s|atives)", "by-nc": "attribution-noncommercial", "by-nc-sa": "attribution-noncommercial-sharealike", "by-nc-nd": "attribution-noncommercial-noderiv(?:s|atives)"}
_UNDER = r"(?:this \w+ is |it is |are |is )?(?:released|licensed|distributed|available|made available) under (?:the |a )?(?:terms of )?(?:the |a )?"
_GNU = r"(?:this program|this library|this file|this software|\S+) is free software[:;,] you can redistribute it and/or modify it under the terms of the gnu {} as published by the free software foundation[;,:] (?:either )?version {}.*"
SENTENCES: dict[str, str] = {
    "apache-notice": rf"(?:this \w+ is )?licensed under the apache license,? version 2(?: 0)?(?: \(the {Q}license{Q}\);?.*)?",
    "apache-use": "you may not use this file except in compliance with the license",
    "apache-copy": "you may obtain a copy of the license at.*",
    "apache-basis": rf"unless required by applicable law or agreed to in writing, software distributed under the license is distributed on an {Q}as is{Q} basis.*",
    "apache-title": "apache license,? version 2 0(?:, january 2004)?(?: http.*)?",
    "mit-notice": _UNDER + "mit license",
    "mit-title": "(?:the )?mit license(?: \\(mit\\))?",
    "mit-grant": "permission is hereby granted, free of charge, to any person obtaining a copy.*",
    "mit-condition": "the above copyright notice and this permission notice (?:\\(including the next paragraph\\) )?shall be included in all copies or substantial portions of the software",
    "as-is-warranty": rf"the software is provided {Q}as is{Q},? without warranty of any kind.*",
    "x11-name": "except as contained in this notice, the name.*shall not be used in advertising or otherwise.*",
    "mit-0-title": "mit no attribution",
    "isc-title": "isc license(?: \\(isc\\))?",
    "isc-grant": "permission to use, copy, modify,? and(?:/or)? distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies",
    "0bsd-grant": "permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",
    "isc-warranty": rf"the software is provided {Q}as is{Q} and (?:the author|isc|.* )disclaims all warranties.*",
    "bsd-redistribution": "redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:?",
    "bsd-source": "(?:\\(?[0-9a-z]\\)? )?redistributions of source code must retain the above copyright notice,.*",
    "bsd-binary": "(?:\\(?[0-9a-z]\\)? )?redistributions in binary form must reproduce the above copyright notice,.*",
    "bsd-advertising": "(?:\\(?[0-9a-z]\\)? )?all advertising materials mentioning features or use of this software must display the following acknowledgment.*",
    "bsd-no-endorse": "(?:\\(?[0-9a-z]\\)? )?neither the name.*may be used to endorse or promote products derived from this software.*",
    "bsd-warranty": rf"this software is provided by (?:the )?.*{Q}as is{Q} and any express(?:ed)? or implied warranties.*",
    "openssl-form": "(?:\\(?[0-9]\\)? )?redistributions of any form whatsoever must retain the following acknowledgment.*",
    "gpl-2-notice": _UNDER + "gnu general public license,? (?:version |v ?)?2(?: 0)?(?: only| or later)?", "gpl-3-notice": _UNDER + "gnu general public license,? (?:version |v ?)?3(?: 0)?(?: only| or later)?",
    "lgpl-2.1-notice": _UNDER + "gnu lesser general public license,? (?:version |v ?)?2 1(?: only| or later)?", "lgpl-3-notice": _UNDER + "gnu lesser general public license,? (?:version |v ?)?3(?: 0)?(?: only| or later)?", "agpl-3-notice": _UNDER + "gnu affero general public license,? (?:version |v ?)?3(?: 0)?(?: only| or later)?",
    "gpl-2-redistribute": _GNU.format("general public license", "2(?! 1)"), "gpl-3-redistribute": _GNU.format("general public license", "3"), "lgpl-2.1-redistribute": _GNU.format("lesser general public license", "2 1"), "lgpl-3-redistribute": _GNU.format("lesser general public license", "3"), "agpl-3-redistribute": _GNU.format("affero general public license", "3"),
    "gnu-warranty": "(?:this program|this library|this file|\\S+) is distributed in the hope that it will be useful, but without any warranty.*",
    "gfdl-notice": "permission is granted to copy, distribute and/or modify this document under the terms of the gnu free documentation license, version 1 [123].*",
    **{f"cc-{k}-{v}-notice": rf"(?:this work is |this \w+ is |content is )?licensed under (?:a |the )?(?:cc {k}|creative commons {n}) {v}(?: 0)?(?: international| unported| generic)?(?: licen[sc]e)?" for k, n in _CC.items() for v in "34"},
    "cc0-waiver": "to the extent possible under law,.*has waived all copyright and related or neighboring rights to.*", "cc0-title": "(?:creative commons legal code )?cc0 1 0 universal.*",
    "mpl-2-notice": "this source code form is subject to the terms of the mozilla public license, v(?:ersion)? 2(?: 0)?", "mpl-1.1-notice": "the contents of this file are subject to the mozilla public license version 1 1.*",
    "epl-1-notice": "this program and the accompanying materials are made available under the terms of the eclipse public license v(?:ersion)? ?1 0.*", "epl-2-notice": "this program and the accompanying materials are made available under the terms of the eclipse public license v?(?:ersion)? ?2 0.*",
    "cddl-notice": "the contents of this file are subject to the terms of (?:either the gnu.*or )?the common development and distribution license.*",
    "unlicense-release": "this is free and unencumbered software released into the public domain", "wtfpl-title": "do what the fuck you want to public license.*",
    "zlib-warranty": rf"this software is provided {Q}as-is{Q}, without any express or implied warranty", "zlib-grant": "permission is granted to anyone to use this software for any purpose,.*", "zlib-origin": "(?:\\(?[0-9]\\)? )?the origin of this software must not be misrepresented.*",
    "boost-notice": "(?:use, modification,? and distribution (?:is|are) subject to|distributed under) the boost software license, version 1 0.*", "boost-grant": "permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software.*",
    "artistic-2-notice": "(?:[^\\n]* )?(?:under )?(?:the terms of )?the artistic license(?: \\(?version)? 2 0\\)?", "ofl-notice": "this font software is licensed under the sil open font license, version 1 1", "ncsa-title": "university of illinois/ncsa open source license",
    "postgresql-grant": "permission to use, copy, modify, and distribute this software and its documentation for any purpose, without fee, and without a written agreement is hereby granted,.*",
    "psf-title": "python software foundation license version 2", "ms-pl-title": "microsoft public license(?: \\(ms-pl\\))?", "ms-rl-title": "microsoft reciprocal license(?: \\(ms-rl\\))?", "eupl-notice": _UNDER + "(?:eupl|european union public licen[sc]e),? ?(?:version |v ?)?1 2.*",
    "upl-title": "the universal permissive license(?: \\(upl\\))?, version 1 0", "odbl-notice": "[^\\n]*made available under the open database license.*", "php-notice": "this source file is subject to version 3 01? of the php license.*", "afl-notice": _UNDER + "academic free license,? (?:version |v ?)?3 0",
    "busl-title": "business source license 1 1", "sspl-notice": "[^\\n]*under the terms of the server side public license.*", "elastic-notice": "[^\\n]*(?:licensed under|subject to) the elastic license 2 0.*",
}
#: Ordered rules: the first that fits at a place wins. (licence, sentences in sequence; those with ? may be missing)
RULES: list[tuple[str, str]] = [
    ("Apache-2.0", "apache-notice apache-use apache-copy apache-basis?"), ("Apache-2.0", "apache-notice apache-copy? apache-basis?"), ("Apache-2.0", "apache-title"),
    ("X11", "mit-title? mit-grant mit-condition as-is-warranty x11-name"), ("MIT", "mit-title? mit-grant mit-condition as-is-warranty"), ("MIT-0", "mit-0-title mit-grant? as-is-warranty?"), ("NCSA", "ncsa-title mit-grant? as-is-warranty?"),
    ("MIT", "mit-title? mit-grant"), ("MIT", "mit-notice"),
    ("ISC", "isc-title? isc-grant isc-warranty?"), ("0BSD", "0bsd-grant isc-warranty?"),
    ("OpenSSL", "bsd-redistribution bsd-source? bsd-binary? bsd-advertising? bsd-no-endorse? openssl-form bsd-warranty?"),
    ("BSD-4-Clause", "bsd-redistribution bsd-source? bsd-binary? bsd-advertising bsd-no-endorse? bsd-warranty?"), ("BSD-3-Clause", "bsd-redistribution bsd-source? bsd-binary? bsd-no-endorse bsd-warranty?"), ("BSD-2-Clause", "bsd-redistribution bsd-source? bsd-binary? bsd-warranty"), ("BSD-2-Clause", "bsd-redistribution bsd-source bsd-binary"),
    *((name, f"{family}-redistribute gnu-warranty?") for name, family in (("GPL-2.0", "gpl-2"), ("GPL-3.0", "gpl-3"), ("LGPL-2.1", "lgpl-2.1"), ("LGPL-3.0", "lgpl-3"), ("AGPL-3.0", "agpl-3"))),
    *((name, f"{family}-notice") for name, family in (("GPL-2.0", "gpl-2"), ("GPL-3.0", "gpl-3"), ("LGPL-2.1", "lgpl-2.1"), ("LGPL-3.0", "lgpl-3"), ("AGPL-3.0", "agpl-3"), ("GFDL-1.3", "gfdl"))),
    *((f"CC-{k.upper()}-{v}.0", f"cc-{k}-{v}-notice") for k in _CC for v in "34"), ("CC0-1.0", "cc0-title? cc0-waiver"), ("CC0-1.0", "cc0-title"),
    ("MPL-2.0", "mpl-2-notice"), ("MPL-1.1", "mpl-1.1-notice"), ("EPL-1.0", "epl-1-notice"), ("EPL-2.0", "epl-2-notice"), ("CDDL-1.0", "cddl-notice"), ("Unlicense", "unlicense-release as-is-warranty?"), ("WTFPL", "wtfpl-title"), ("Zlib", "zlib-warranty zlib-grant? zlib-origin?"), ("Zlib", "zlib-grant? zlib-origin"),
    ("BSL-1.0", "boost-notice? boost-grant as-is-warranty?"), ("BSL-1.0", "boost-notice"), ("Artistic-2.0", "artistic-2-notice"), ("OFL-1.1", "ofl-notice"), ("PostgreSQL", "postgresql-grant"), ("Python-2.0", "psf-title"), ("MS-PL", "ms-pl-title"), ("MS-RL", "ms-rl-title"), ("EUPL-1.2", "eupl-notice"),
    ("UPL-1.0", "upl-title mit-grant? mit-condition? as-is-warranty?"), ("ODbL-1.0", "odbl-notice"), ("PHP-3.01", "php-notice"), ("AFL-3.0", "afl-notice"), ("BUSL-1.1", "busl-title"), ("SSPL-1.0", "sspl-notice"), ("Elastic-2.0", "elastic-notice"),
]
#: A line that names a licence by its identifier.
for _name in dict.fromkeys(name for name, _ in RULES):
    SENTENCES[f"spdx {_name}"] = "spdx-license-identifier: " + _name.lower().replace(".", " ").replace("+", "\\+") + "(?:-only|-or-later)?(?: .*)?"
    RULES.append((_name, f"spdx {_name}".replace(" ", "_")))
#: A letter for each identifier.
LETTERS = {name.replace(" ", "_"): chr(0x100 + i) for i, name in enumerate(SENTENCES)}
#: Only sentences that hold one of these words can be licence sentences; the others aren't matched.
HINT = "licen[sc]e|permission|warrant|redistribut|copyright notice|endorse|public domain|free software|creative commons|cc by|cc0|misrepresented|advertising|eupl"


#: What stands before and after the text of a line in comments, as box drawing or as a list's bullet.
MARKS_BEFORE, MARKS_AFTER = r"(?md)^[ \t\r/*#;%>|!<\"'•-]++(?:(?:rem|dnl)[ \t]+)?|^(?:rem|dnl)[ \t]+", r"(?md)(?:(?<!\*)\*++/?|(?<!#)#++|-->|(?<!\|)\|++)[ \t\r]*+$"
#: A full stop that belongs to a version, before or after a line break.
VERSION_STOP = r"\b(v|ver|vers)\.[ \t\r\n]*+(?=[0-9])"


def sentences(text: Column) -> Column:
    """Normalised sentences that hold a hint: cut at empty lines and at . ! ? before white space or the end; full stops inside versions become spaces.

    Comment marks are taken off the lines first. A line break inside a sentence stays one, as the sentence may go on behind it or end there.
    """
    low = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.lower(text), MARKS_BEFORE, ""), MARKS_AFTER, ""), VERSION_STOP, "$1 ")
    cut = F.split(F.regexp_replace(low, r"[.!?]+([ \t\r\n]|\z)", "\n\n"), r"\n[ \t\r\n]*\n")
    return F.transform(F.filter(cut, lambda s: s.rlike(f"{HINT}|spdx")), lambda s: F.trim(F.regexp_replace(F.regexp_replace(s, r"[ \t\r.]+", " "), " ?\n ?", "\n")))


def _wrapped(pattern: str) -> str:
    """A sentence's pattern with a line break for any space; what follows its fixed words goes no farther than it must."""
    return pattern.replace(" ", "[ \\n]").replace(".*", ".*?")


#: A known sentence from the beginning of a line to the end of one.
KNOWN = r"(?s)(?:^|\n)(" + "|".join(f"(?:{_wrapped(p)})" for p in SENTENCES.values()) + r")(?=\n|\z)"
#: The rules over letters; the first that fits at a place wins, and what may be missing is taken where it stands.
SEQUENCES = [(name, "".join(LETTERS[x.rstrip("?")] + "?" * x.endswith("?") for x in seq.split())) for name, seq in RULES]


def identifiers(sentence: Column) -> Column:
    """The letters of the known sentences that a sentence's lines hold, in order."""
    return F.array_join(F.transform(F.regexp_extract_all(sentence, F.lit(KNOWN), F.lit(1)), identifier), "")


def identifier(sentence: Column) -> Column:
    """The letter of a known sentence, or '' for another."""
    out = F.lit("")
    for letter, pattern in reversed(list(zip(LETTERS.values(), SENTENCES.values(), strict=True))):
        out = F.when(sentence.rlike(rf"(?s)^({_wrapped(pattern)})\z"), F.lit(letter)).otherwise(out)
    return out


def scan(docs: DataFrame) -> DataFrame:
    """(doc_id, licence_sentences, licence_matches, licences) of every row; licences: distinct names, sorted, joined by ', ' ('' if none).

    Null and empty texts have none; very long ones are read whole; ties (several rules at one place) go to the first rule.
    Repeated rows stay, extra columns are left behind, an empty table has no rows. A text is scanned only if it holds a hint.
    """
    rule = "|".join(f"(?:{seq})" for _, seq in SEQUENCES)
    ids = F.when(F.lower("text").rlike(f"{HINT}|spdx"), F.array_join(F.transform(sentences(F.col("text")), identifiers), "")).otherwise("")
    found = docs.select("doc_id", ids.alias("ids")).select("doc_id", "ids", F.regexp_extract_all("ids", F.lit(rule), F.lit(0)).alias("matches"))

    def name_of(m: Column) -> Column:
        out = F.lit("")
        for name, seq in reversed(SEQUENCES):
            out = F.when(m.rlike(f"^(?:{seq})$"), name).otherwise(out)
        return out

    return found.select(
        "doc_id", F.length("ids").cast("long").alias("licence_sentences"), F.size("matches").cast("long").alias("licence_matches"),
        F.array_join(F.array_sort(F.array_distinct(F.transform("matches", name_of))), ", ").alias("licences"),
    )


def op7_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licences that every whole text names, by sentence rules."""
    return scan(common.table(spark, sf_dir, "documents"))


#: Whole sentences and what they name, written apart from the rules: each is a notice that stands by itself. Texts with other licence sentences are not told rightly by this SQL.
_SQL = """
WITH cut AS (
  SELECT row_number() OVER () AS r, doc_id, string_split_regex(lower(coalesce(text, '')), '[.!?]+([ \t\r\n]|$)|\n') AS parts FROM documents
), named AS (
  SELECT r, doc_id, list_filter(list_transform(parts, lambda s: CASE regexp_replace(trim(s, ' ' || chr(9) || chr(13)), '^this work is ', '')
      WHEN 'licensed under the apache license, version 2.0' THEN 'Apache-2.0'
      WHEN 'released under the mit license' THEN 'MIT' WHEN 'licensed under the mit license' THEN 'MIT' WHEN 'distributed under the mit license' THEN 'MIT'
      WHEN 'licensed under the gnu general public license, version 3' THEN 'GPL-3.0' WHEN 'licensed under the gnu general public license, version 2' THEN 'GPL-2.0'
      WHEN 'licensed under cc by-nc 4.0' THEN 'CC-BY-NC-4.0' WHEN 'licensed under cc by 4.0' THEN 'CC-BY-4.0' WHEN 'licensed under cc by-sa 4.0' THEN 'CC-BY-SA-4.0' END), lambda n: n IS NOT NULL) AS names FROM cut
)
SELECT doc_id, len(names)::BIGINT AS licence_sentences, len(names)::BIGINT AS licence_matches, array_to_string(list_sort(list_distinct(names)), ', ') AS licences FROM named"""
ORACLE = {"op7_licence_scan": _SQL}
