"""Licence scan by sentences.

A text is normalised: letters and digits stay, the rest is space, and line ends and
sentence marks are breaks.  A known sentence is found where it begins and ends at a
break, and may run over breaks, so it is the same in hard-wrapped lines, behind comment
leaders and list labels.  A table gives its identifier.  A document's identifiers, in their order, are matched
against an ordered list of rules: each rule is a run of identifiers, takes what it
matches out of the sequence, and so a full grant is found before the short notice
that it holds.  Only DataFrame operations.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from blastradius.llm.common import whole

_GPL = "this {0} is free software you can redistribute it and or modify it under the terms of the gnu {1}general public license as published by the free software foundation"
_LATER = "either version {0} of the license or at your option any later version"
_HOPE = "this {0} is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose"
_THINGS = ("program", "library", "file", "software")


def _granted(kind: str, version: str, later: bool = True) -> tuple[str, ...]:
    rest = (_LATER.format(version),) if later else (f"version {version} of the license", f"version {version}", f"version {version} only")
    return tuple(f"{_GPL.format(thing, kind)} {r}" for thing in _THINGS for r in rest)


# Sentences of public licences and notices, normalised, by identifier; some have variants.
SENTENCES = {
    "ApacheNotice": ("licensed under the apache license version 2 0", "licensed under the apache license version 2 0 the license"),
    "ApacheTitle": "apache license version 2 0 january 2004",
    "ApacheObey": "you may not use this file except in compliance with the license",
    "ApacheCopy": "you may obtain a copy of the license at",
    "ApacheAsIs": "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied",
    "ApacheSee": "see the license for the specific language governing permissions and limitations under the license",
    "MitNotice": "released under the mit license",
    "MitLicensed": "licensed under the mit license",
    "MitTitle": ("the mit license mit", "the mit license", "mit license"),
    "MitGrant": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions",
    "MitKeep": (
        "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
        "the above copyright notice and this permission notice including the next paragraph shall be included in all copies or substantial portions of the software",
    ),
    "MitLiable": "in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software",
    "AsIs": "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement",
    "GplNotice": "this work is licensed under the gnu general public license version 3",
    "GplFree": _granted("", "3"),
    "Gpl2Free": _granted("", "2"),
    "Gpl3Only": _granted("", "3", False),
    "Gpl2Only": _granted("", "2", False),
    "Lgpl3Free": _granted("lesser ", "3"),
    "Lgpl21Free": _granted("lesser ", "2 1"),
    "Agpl3Free": _granted("affero ", "3"),
    "GplHope": tuple(_HOPE.format(thing) for thing in _THINGS),
    "GplSee": ("see the gnu general public license for more details", "see the gnu lesser general public license for more details", "see the gnu affero general public license for more details"),
    "Gpl3Title": "gnu general public license version 3 29 june 2007",
    "Gpl2Title": "gnu general public license version 2 june 1991",
    "Lgpl3Title": "gnu lesser general public license version 3 29 june 2007",
    "Lgpl21Title": "gnu lesser general public license version 2 1 february 1999",
    "Agpl3Title": "gnu affero general public license version 3 19 november 2007",
    "Mpl2Notice": "this source code form is subject to the terms of the mozilla public license v 2 0",
    "Mpl2Title": ("mozilla public license version 2 0", "mozilla public license 2 0"),
    "IscGrant": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
    "Unlicense": "this is free and unencumbered software released into the public domain",
    "BoostTitle": "boost software license version 1 0 august 17th 2003",
    "BoostNotice": "distributed under the boost software license version 1 0",
    "Cc0Title": "cc0 1 0 universal",
    "CcByNc4": "licensed under cc by nc 4 0",
    "CcBy4": "licensed under cc by 4 0",
    "CcBySa4": "licensed under cc by sa 4 0",
    "CcByWork": "this work is licensed under a creative commons attribution 4 0 international license",
    "BsdForms": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "BsdSource": "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
    "BsdBinary": "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
    "BsdNames": (
        "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
        "neither the name of the copyright holder nor the names of contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    ),
    "BsdAsIs": "this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed",
    "BsdLiable": tuple(
        f"in no event shall the {who} or contributors be liable for any direct indirect incidental special exemplary or consequential damages including but not limited to procurement of substitute goods or services loss of use data or profits or business interruption however caused and on any theory of liability whether in contract strict liability or tort including negligence or otherwise arising in any way out of the use of this software even if advised of the possibility of such damage"
        for who in ("copyright holder", "copyright owner", "copyright holders")
    ),
    "SpdxApache": "spdx license identifier apache 2 0",
    "SpdxMit": "spdx license identifier mit",
    "SpdxGpl3": "spdx license identifier gpl 3 0 or later",
    "SpdxGpl3Only": ("spdx license identifier gpl 3 0 only", "spdx license identifier gpl 3 0"),
    "SpdxGpl2": "spdx license identifier gpl 2 0 or later",
    "SpdxGpl2Only": ("spdx license identifier gpl 2 0 only", "spdx license identifier gpl 2 0"),
    "SpdxBsd3": "spdx license identifier bsd 3 clause",
    "SpdxBsd2": "spdx license identifier bsd 2 clause",
    "SpdxIsc": "spdx license identifier isc",
    "SpdxMpl2": "spdx license identifier mpl 2 0",
    "Reserved": "all rights reserved",
}
#: (licence, identifiers in their order); earlier rules go first.
RULES = (
    ("Apache-2.0", ("ApacheNotice", "ApacheObey", "ApacheCopy", "ApacheAsIs", "ApacheSee")),
    ("Apache-2.0", ("ApacheNotice", "ApacheObey", "ApacheCopy")),
    ("Apache-2.0", ("ApacheTitle",)),
    ("MIT", ("MitTitle", "Reserved", "MitGrant", "MitKeep", "AsIs", "MitLiable")),
    ("MIT", ("MitTitle", "MitGrant", "MitKeep", "AsIs", "MitLiable")),
    ("MIT", ("MitGrant", "MitKeep", "AsIs", "MitLiable")),
    ("MIT", ("MitGrant", "MitKeep", "AsIs")),
    *[
        (licence, (*first, *run, *last))
        for licence, run in (("BSD-3-Clause", ("BsdForms", "BsdSource", "BsdBinary", "BsdNames")), ("BSD-2-Clause", ("BsdForms", "BsdSource", "BsdBinary")))
        for first in (("Reserved",), ())
        for last in (("BsdAsIs", "BsdLiable"), ())
    ],
    *[
        (licence, run)
        for licence, grant in (
            ("GPL-3.0-or-later", "GplFree"),
            ("GPL-2.0-or-later", "Gpl2Free"),
            ("GPL-3.0-only", "Gpl3Only"),
            ("GPL-2.0-only", "Gpl2Only"),
            ("LGPL-3.0-or-later", "Lgpl3Free"),
            ("LGPL-2.1-or-later", "Lgpl21Free"),
            ("AGPL-3.0-or-later", "Agpl3Free"),
        )
        for run in ((grant, "GplHope", "GplSee"), (grant,))
    ],
    ("GPL-3.0", ("Gpl3Title",)),
    ("GPL-2.0", ("Gpl2Title",)),
    ("LGPL-3.0", ("Lgpl3Title",)),
    ("LGPL-2.1", ("Lgpl21Title",)),
    ("AGPL-3.0", ("Agpl3Title",)),
    ("MPL-2.0", ("Mpl2Notice",)),
    ("MPL-2.0", ("Mpl2Title",)),
    ("ISC", ("IscGrant",)),
    ("Unlicense", ("Unlicense",)),
    ("BSL-1.0", ("BoostTitle",)),
    ("BSL-1.0", ("BoostNotice",)),
    ("CC0-1.0", ("Cc0Title",)),
    ("Apache-2.0", ("ApacheNotice",)),
    ("MIT", ("MitNotice",)),
    ("MIT", ("MitLicensed",)),
    ("MIT", ("MitTitle",)),
    ("GPL-3.0", ("GplNotice",)),
    ("CC-BY-NC-4.0", ("CcByNc4",)),
    ("CC-BY-4.0", ("CcBy4",)),
    ("CC-BY-SA-4.0", ("CcBySa4",)),
    ("CC-BY-4.0", ("CcByWork",)),
    ("Apache-2.0", ("SpdxApache",)),
    ("MIT", ("SpdxMit",)),
    ("GPL-3.0-or-later", ("SpdxGpl3",)),
    ("GPL-3.0-only", ("SpdxGpl3Only",)),
    ("GPL-2.0-or-later", ("SpdxGpl2",)),
    ("GPL-2.0-only", ("SpdxGpl2Only",)),
    ("BSD-3-Clause", ("SpdxBsd3",)),
    ("BSD-2-Clause", ("SpdxBsd2",)),
    ("ISC", ("SpdxIsc",)),
    ("MPL-2.0", ("SpdxMpl2",)),
    ("LicenseRef-proprietary", ("Reserved",)),
)
#: A text with a known sentence holds one of these, so other texts are not normalised.
_HINT = r"(?i)licen[sc]e|permi|redistribut|warrant|in no event shall|notice\s+shall|rights\W+reserved|neither\s+the\s+name|spdx|required by applicable law|the software is|public\W+domain|cc0"
_HOLDER = "the copyright holder"


def normal(text: Column) -> Column:
    """Words apart by a space, or by a line end where a line or sentence ends; line ends outside."""
    text = F.regexp_replace(F.lower(text), r"(?m)^[ \t]*(?:dnl|rem)\b", "")
    text = F.regexp_replace(F.regexp_replace(text, r"[.!?;:](?=\s)", "\n"), r"[^a-z0-9\n]+", " ")
    return F.concat(F.lit("\n"), F.regexp_replace(text, r" ?+\n[ \n]*+", "\n"), F.lit("\n"))


def sentences(text: Column, known: list[str]) -> Column:
    """The known sentences of a text, in their order; the longest of those that begin at a place."""
    # A sentence that names the holder holds for any.
    names = r"(?:[a-z0-9]+[ \n]){1,20}?"
    either = "|".join(s.replace(f"the name of {_HOLDER} ", "the name of \0").replace(" ", r"[ \n]").replace("\0", names) for s in sorted(known, key=len, reverse=True))
    found = F.regexp_extract_all(normal(text), F.lit(rf"(?<=\n) ?(?:(?:[0-9]{{1,2}}|[a-d]|[ivx]{{1,4}}) )?({either}) ?(?=\n)"), F.lit(1))
    return F.transform(found, lambda s: F.regexp_replace(F.translate(s, "\n", " "), "^(neither the name of ).+?( nor the names )", f"$1{_HOLDER}$2"))


def matched(sequence: Column) -> tuple[Column, Column]:
    """(licences in the order of the rules, identifiers no rule took) of ``|A||B|`` sequences."""
    taken, left = [], sequence
    for licence, ids in RULES:
        run = "".join(f"|{i}|" for i in ids)
        taken.append(F.when(F.contains(left, F.lit(run)), F.lit(licence)))
        left = F.replace(left, F.lit(run), F.lit("#"))
    return F.array_join(F.array_distinct(F.array_compact(F.array(*taken))), ","), F.replace(left, F.lit("#"), F.lit(""))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", known: dict[str, str | tuple[str, ...]] = SENTENCES) -> DataFrame:
    """Per row: doc_id, licences (comma-joined, empty if none), sentence_ids, unmatched_ids, n_sentences.

    Null text is empty and has no sentence known.  Each row of a repeated id gives
    its own row.  The table of known sentences is a literal of fixed size, looked up
    in the row itself: nothing is shuffled.
    """
    named = {s: i for i, each in known.items() for s in ((each,) if isinstance(each, str) else each)}
    table = F.create_map(*[F.lit(x) for pair in named.items() for x in pair])
    ids = F.array_compact(F.transform(sentences(F.col("_t"), list(named)), lambda s: F.try_element_at(table, s)))
    # Most texts hold no word of a licence at all and are not cut up.
    seen = F.when(F.col("_t").rlike(_HINT), ids).otherwise(F.array().cast("array<string>"))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), whole(text_col).alias("_t")).select("doc_id", seen.alias("_ids"))
    sequence = F.array_join(F.transform("_ids", lambda x: F.concat(F.lit("|"), x, F.lit("|"))), "")
    licences, left = matched(F.col("_s"))
    rows = rows.withColumn("_s", sequence)
    return rows.select("doc_id", licences.alias("licences"), F.col("_s").alias("sentence_ids"), left.alias("unmatched_ids"), F.size("_ids").cast("long").alias("n_sentences"))
