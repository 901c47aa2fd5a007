"""Licence scan by sentence rules: sentences get identifiers, ordered rules match identifier sequences.

Comment signs at line starts go, the lines of a paragraph are joined, and a paragraph falls into sentences after . ; ! ? before white space (but not before `either version`, which says more of the licence named), and where `but` follows what is not licensed. Only sentences with a critical word are looked at; they are lower-cased, without quotes, slashes and repeated spaces. A sentence yields the identifiers of all patterns of SENTENCES that it holds, from left to right, of those that begin at one place the one listed first (UNKNOWN if it holds none). What is said not to be licensed so yields NotLicensed, and nothing else up to its end. Identifiers in NEUTRAL are left out of the sequence that RULES are matched with; rules are tried in order, longest sequences first; one that fits takes its identifiers out, so that a long notice isn't reported again by the shorter rule that it contains. A licence that an SPDX line names is reported as such.

All in column expressions. Defined results: null or empty text, or text without critical words, has no sentence and no licence; a licence found twice in a text counts once; repeated rows are reported each; an empty table gives no rows. Columns besides doc_id and text are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import LOWER, UPPER, ascii_lower, let

# Words that make a sentence worth a look.
CRITICAL = "licen[cs]e|gpl|copyright|spdx|permission|redistribut|warrant|as[ -]is|liab|public domain|all rights reserved|creative commons|cc by|cc0|unencumbered"
# How the licence versions that a sentence names may be written.
_OF = r"gnu general public license[^;]{0,120}?"
_LATER = r"[^;]{0,80}?any later version"
# Sentence identifiers and the normalised sentences that they stand for. A space precedes and ends each sentence.
SENTENCES = [
    ("NotLicensed", r"(not|never|no longer) (be )?(licensed|released|distributed|available|covered) [^;]*"),
    ("SpdxId", r"spdx-license-identifier: *[(]?[a-z0-9.+-]+( (or|and|with) [a-z0-9.+-]+)*"),
    ("Copyright", r"copyright *([(]c[)]|©)? *[0-9]{4}"),
    ("AllRights", r"all rights reserved"),
    ("CcByNcSa", r"([ (]cc by-nc-sa|attribution-noncommercial-sharealike)"),
    ("CcByNcNd", r"([ (]cc by-nc-nd|attribution-noncommercial-noderiv)"),
    ("CcByNc", r"([ (]cc by-nc|attribution-noncommercial)"),
    ("CcBySa", r"([ (]cc by-sa|attribution-sharealike)"),
    ("CcByNd", r"([ (]cc by-nd|attribution-noderiv)"),
    ("CcBy", r"([ (]cc by|creative commons attribution)"),
    ("Cc0", r"([ (]cc0|creative commons zero)"),
    ("Unlicense", r"free and unencumbered software released into the public domain"),
    ("PublicDomain", r"public domain"),
    ("ApacheVer2", r"(licensed under the )?(apache( software)? license,? *-? *(version|v[.]?)? *2[.]0|[ (]apache-2[.]0)"),
    ("ApacheNote", r"you may not use this file except in compliance with the license"),
    ("ApacheCopy", r"you may obtain a copy of the license at"),
    ("ApacheAsIs", r"unless required by applicable law or agreed to in writing, software distributed under the license is distributed on an as is"),
    ("AgplLater3", r"gnu affero general public license[^;]{0,120}?version 3" + _LATER),
    ("Agpl3", r"gnu affero general public license[^;]{0,120}?(version 3|v3)"),
    ("AgplAny", r"gnu affero general public license"),
    ("LgplLater21", r"gnu (lesser|library) general public license[^;]{0,120}?version 2[.]1" + _LATER),
    ("Lgpl21", r"gnu (lesser|library) general public license[^;]{0,120}?(version 2[.]1|v2[.]1)"),
    ("LgplLater3", r"gnu (lesser|library) general public license[^;]{0,120}?version 3" + _LATER),
    ("Lgpl3", r"gnu (lesser|library) general public license[^;]{0,120}?(version 3|v3)"),
    ("LgplAny", r"gnu (lesser|library) general public license"),
    ("GplLater3", _OF + "version 3" + _LATER),
    ("Gpl3", _OF + "(version 3|v3)"),
    ("GplLater2", _OF + "version 2" + _LATER),
    ("Gpl2", _OF + "(version 2|v2)"),
    ("GplAny", r"gnu general public license"),
    ("MplVer2", r"mozilla public license,? (version 2[.]0|v[.]? ?2[.]0)"),
    ("EplVer2", r"eclipse public license,? (-|version|v)?[.]? ?v?2[.]0"),
    ("BoostVer1", r"boost software license,? ?-? ?(version )?1[.]0"),
    ("OflVer1", r"open font license,? *-? *(version |v[.]?)? *1[.]1|[ (]ofl-1[.]1"),
    ("ArtisticVer2", r"artistic license,? *-? *(version |v[.]?)? *2[.]0|[ (]artistic-2[.]0"),
    ("Agpl3Later", r"[ (]agpl[ -]?v?3([.]0)?( or later|-or-later|[+])"),
    ("Agpl3Name", r"[ (]agpl[ -]?v?3([.]0)?"),
    ("Lgpl21Later", r"[ (]lgpl[ -]?v?2[.]1( or later|-or-later|[+])"),
    ("Lgpl21Name", r"[ (]lgpl[ -]?v?2[.]1"),
    ("Lgpl3Later", r"[ (]lgpl[ -]?v?3([.]0)?( or later|-or-later|[+])"),
    ("Lgpl3Name", r"[ (]lgpl[ -]?v?3([.]0)?"),
    ("Gpl3Later", r"[ (]gpl[ -]?v?3([.]0)?( or later|-or-later|[+])"),
    ("Gpl3Name", r"[ (]gpl[ -]?v?3([.]0)?"),
    ("Gpl2Later", r"[ (]gpl[ -]?v?2([.]0)?( or later|-or-later|[+])"),
    ("Gpl2Name", r"[ (]gpl[ -]?v?2([.]0)?"),
    ("Bsd3Name", r"[ (](bsd[ -]3[ -]clause|3[ -]clause bsd|new bsd|modified bsd|revised bsd)"),
    ("Bsd2Name", r"[ (](bsd[ -]2[ -]clause|2[ -]clause bsd|simplified bsd|freebsd license)"),
    ("MitName", r"(released|licensed|distributed|available) under the (terms of the )?mit license|[ (]mit[ -]licen[sc]ed?"),
    ("MitPerm", r"permission is hereby granted, free of charge, to any person obtaining a copy"),
    ("MitCond", r"the above copyright notice and this permission notice shall be included"),
    ("MitAsIs", r"the software is provided as is"),
    ("BsdPerm", r"redistribution and use in source and binary forms, with or without modification, are permitted"),
    ("BsdSrc", r"redistributions of source code must retain the above copyright notice"),
    ("BsdBin", r"redistributions in binary form must reproduce the above copyright notice"),
    ("BsdAdvert", r"all advertising materials mentioning features or use of this software must display"),
    ("BsdEndorse", r"neither the names? of .{0,200}?may be used to endorse or promote products"),
    ("BsdAsIs", r"this software is provided by .{0,200}?as is"),
    ("IscPerm", r"permission to use, copy, modify, and( or)? distribute this software for any purpose"),
    ("IscCond", r"provided that the above copyright notice and this permission notice appear in all copies"),
    ("IscAsIs", r"the software is provided as is and the author disclaims all warranties"),
    ("ZlibAsIs", r"this software is provided as-is, without any express or implied warranty"),
    ("ZlibPerm", r"permission is granted to anyone to use this software for any purpose"),
    ("NoWarranty", r"without even the implied warranty"),
    ("Liability", r"in no event (shall|will) "),
    ("GplCopy", r"you should have received a copy of the gnu [a-z ]*license"),
]
# Identifiers that say nothing of which licence it is.
NEUTRAL = ["UNKNOWN", "NotLicensed", "SpdxId", "Copyright", "AllRights", "NoWarranty", "Liability", "GplCopy", "BsdAsIs", "IscCond", "IscAsIs"]
# Licences in the order in which their sentence sequences are tried.
RULES = [
    ("BSD-4-Clause", ["BsdPerm", "BsdSrc", "BsdBin", "BsdAdvert", "BsdEndorse"]),
    ("Apache-2.0", ["ApacheVer2", "ApacheNote", "ApacheCopy", "ApacheAsIs"]),
    ("BSD-3-Clause", ["BsdPerm", "BsdSrc", "BsdBin", "BsdEndorse"]),
    ("BSD-2-Clause", ["BsdPerm", "BsdSrc", "BsdBin"]),
    ("MIT", ["MitPerm", "MitCond", "MitAsIs"]),
    ("MIT", ["MitPerm", "MitCond"]),
    ("ISC", ["IscPerm", "MitAsIs"]),
    ("Zlib", ["ZlibAsIs", "ZlibPerm"]),
    ("Apache-2.0", ["ApacheVer2", "ApacheNote"]),
    ("Apache-2.0", ["ApacheVer2"]),
    ("MIT", ["MitName"]),
    ("ISC", ["IscPerm"]),
    ("BSD-3-Clause", ["Bsd3Name"]),
    ("BSD-2-Clause", ["Bsd2Name"]),
    ("OFL-1.1", ["OflVer1"]),
    ("Artistic-2.0", ["ArtisticVer2"]),
    ("AGPL-3.0-or-later", ["Agpl3Later"]),
    ("AGPL-3.0", ["Agpl3Name"]),
    ("LGPL-2.1-or-later", ["Lgpl21Later"]),
    ("LGPL-2.1", ["Lgpl21Name"]),
    ("LGPL-3.0-or-later", ["Lgpl3Later"]),
    ("LGPL-3.0", ["Lgpl3Name"]),
    ("GPL-3.0-or-later", ["Gpl3Later"]),
    ("GPL-3.0", ["Gpl3Name"]),
    ("GPL-2.0-or-later", ["Gpl2Later"]),
    ("GPL-2.0", ["Gpl2Name"]),
    ("AGPL-3.0-or-later", ["AgplLater3"]),
    ("AGPL-3.0", ["Agpl3"]),
    ("AGPL", ["AgplAny"]),
    ("LGPL-2.1-or-later", ["LgplLater21"]),
    ("LGPL-2.1", ["Lgpl21"]),
    ("LGPL-3.0-or-later", ["LgplLater3"]),
    ("LGPL-3.0", ["Lgpl3"]),
    ("LGPL", ["LgplAny"]),
    ("GPL-3.0-or-later", ["GplLater3"]),
    ("GPL-3.0", ["Gpl3"]),
    ("GPL-2.0-or-later", ["GplLater2"]),
    ("GPL-2.0", ["Gpl2"]),
    ("GPL", ["GplAny"]),
    ("MPL-2.0", ["MplVer2"]),
    ("EPL-2.0", ["EplVer2"]),
    ("BSL-1.0", ["BoostVer1"]),
    ("CC-BY-NC-SA", ["CcByNcSa"]),
    ("CC-BY-NC-ND", ["CcByNcNd"]),
    ("CC-BY-NC", ["CcByNc"]),
    ("CC-BY-SA", ["CcBySa"]),
    ("CC-BY-ND", ["CcByNd"]),
    ("CC-BY", ["CcBy"]),
    ("CC0-1.0", ["Cc0"]),
    ("Unlicense", ["Unlicense"]),
    ("Public-Domain", ["PublicDomain"]),
]
ANY = "|".join(p for _, p in SENTENCES)
SPDX = r"spdx-license-identifier: *[(]?([a-z0-9.+-]+( (or|and|with) [a-z0-9.+-]+)*)"
#: Applied to the lower-cased text one after the other: pattern and what replaces it. \x1e stands between sentences.
STEPS = [
    (r"\r", ""),
    (r"(^|\n)[ \t]*[/*#;%>!-]+", "\n"),
    (r"\n[ \t]*(\n[ \t]*)+", "\x1e"),
    (r"[ \t\n\"'`*#/]+", " "),
    (r" v[.] +([0-9])", " v.{1}"),
    (r"; (either version )", " {1}"),
    (r"((not|never|no longer) (be )?(licensed|released|distributed|available|covered) [^;.!?\x1e]{0,200}?),? but ", "{1}\x1e"),
    (r"([.;!?]) ", "{1}\x1e"),
]


def _named(match: Column) -> Column:
    out = None
    for name, pattern in SENTENCES:
        hit = match.rlike(f"^({pattern})")
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out.otherwise("UNKNOWN")


def sentences(text: Column) -> Column:
    """The text's critical sentences, normalised, in order."""
    for pattern, by in STEPS:
        text = F.regexp_replace(text, pattern, by.replace("{1}", "$1"))
    return F.filter(F.split(text, "\x1e"), lambda s: s.rlike(CRITICAL))


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_sentences, sentence_ids, licences, n_unmatched of every row."""
    low = ascii_lower(F.coalesce(F.col("text").cast("string"), F.lit("")))
    none = F.array().cast("array<string>")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.when(low.rlike(CRITICAL), sentences(low)).otherwise(none).alias("said"))
    names = lambda s: let(F.regexp_extract_all(F.concat(F.lit(" "), s, F.lit(" ")), F.lit(f"({ANY})"), F.lit(0)), lambda m: F.when(F.size(m) == 0, F.array(F.lit("UNKNOWN"))).otherwise(F.transform(m, _named)))
    spdx = F.flatten(F.transform("said", lambda s: F.flatten(F.transform(F.regexp_extract_all(s, F.lit(SPDX), F.lit(1)), lambda x: F.split(x, " (or|and|with) ")))))
    rows = rows.select("doc_id", F.size("said").cast("long").alias("n_sentences"), F.flatten(F.transform("said", names)).alias("ids"), spdx.alias("spdx"))
    rules = F.array(*[F.struct(F.lit(name).alias("name"), F.lit(f" {'  '.join(ids)} ").alias("seq")) for name, ids in RULES])
    telling = F.filter("ids", lambda x: ~x.isin(*NEUTRAL))
    start = F.struct(F.concat_ws("", F.transform(telling, lambda x: F.concat(F.lit(" "), x, F.lit(" ")))).alias("seq"), none.alias("found"))
    step = lambda acc, r: F.when(F.contains(acc["seq"], r["seq"]), F.struct(F.replace(acc["seq"], r["seq"], F.lit("|")).alias("seq"), F.array_union(acc["found"], F.array(r["name"])).alias("found"))).otherwise(acc)
    known = F.create_map(*[F.lit(x) for name in dict.fromkeys(n for n, _ in RULES) for x in (name.lower(), name)])
    named = F.transform("spdx", lambda x: F.coalesce(F.element_at(known, x), x))
    rows = rows.select("doc_id", "n_sentences", "ids", named.alias("spdx"), F.when(F.size("ids") > 0, F.aggregate(rules, start, step)).alias("m"))
    return rows.select(
        "doc_id",
        "n_sentences",
        F.concat_ws(",", "ids").alias("sentence_ids"),
        F.concat_ws(",", F.array_sort(F.array_union(F.coalesce("m.found", none), "spdx"))).alias("licences"),
        (F.size(F.filter("ids", lambda x: x == "UNKNOWN")) + F.coalesce(F.size(F.filter(F.split("m.seq", " +"), lambda x: ~x.isin("", "|") & ~x.startswith("|"))), F.lit(0))).cast("long").alias("n_unmatched"),
    )


def _sql() -> str:
    q = lambda s: s.replace("'", "''")
    names = " ".join(f"WHEN regexp_matches(x, '^({q(p)})') THEN '{n}'" for n, p in SENTENCES)
    whole = f"translate(coalesce(text, ''), '{UPPER}', '{LOWER}')"
    for pattern, by in STEPS:
        whole = f"regexp_replace({whole}, '{q(pattern)}', '{q(by.replace('{1}', chr(92) + '1'))}', 'g')"
    canonical = " ".join(f"WHEN '{n.lower()}' THEN '{n}'" for n in dict.fromkeys(n for n, _ in RULES))
    steps, prev = [], "r0"
    for k, (name, ids) in enumerate(RULES, 1):
        seq = f" {'  '.join(ids)} "
        steps.append(f"r{k} AS MATERIALIZED (SELECT rid, doc_id, n, ids, spdx, replace(seq, '{seq}', '|') AS seq, CASE WHEN contains(seq, '{seq}') AND NOT list_contains(found, '{name}') THEN list_append(found, '{name}') ELSE found END AS found FROM {prev})")
        prev = f"r{k}"
    neutral = ", ".join(f"'{n}'" for n in NEUTRAL)
    return f"""
WITH d AS (SELECT row_number() OVER () AS rid, CAST(doc_id AS BIGINT) AS doc_id, {whole} AS whole FROM documents),
s AS (SELECT rid, doc_id, list_filter(string_split(whole, chr(30)), lambda s: regexp_matches(s, '{q(CRITICAL)}')) AS said FROM d),
i AS (SELECT rid, doc_id, CAST(len(said) AS BIGINT) AS n,
  flatten(list_transform(said, lambda s: CASE WHEN len(regexp_extract_all(' ' || s || ' ', '{q(ANY)}')) = 0 THEN ['UNKNOWN'] ELSE list_transform(regexp_extract_all(' ' || s || ' ', '{q(ANY)}'), lambda x: CASE {names} ELSE 'UNKNOWN' END) END)) AS ids,
  flatten(list_transform(said, lambda s: flatten(list_transform(regexp_extract_all(s, '{q(SPDX)}', 1), lambda x: regexp_split_to_array(x, ' (or|and|with) '))))) AS spdx FROM s),
r0 AS (SELECT rid, doc_id, n, ids, list_transform(spdx, lambda x: CASE x {canonical} ELSE x END) AS spdx, array_to_string(list_transform(list_filter(ids, lambda x: x NOT IN ({neutral})), lambda x: ' ' || x || ' '), '') AS seq, CAST([] AS VARCHAR[]) AS found FROM i),
{','.join(steps)}
SELECT doc_id, n AS n_sentences, coalesce(array_to_string(ids, ','), '') AS sentence_ids, coalesce(array_to_string(list_sort(list_distinct(list_concat(found, spdx))), ','), '') AS licences,
  CAST(len(list_filter(ids, lambda x: x = 'UNKNOWN')) + len(list_filter(regexp_split_to_array(coalesce(seq, ''), ' +'), lambda x: x <> '' AND NOT starts_with(x, '|'))) AS BIGINT) AS n_unmatched FROM {prev}"""


ORACLE_SQL = _sql()
