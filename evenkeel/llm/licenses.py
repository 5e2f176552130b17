"""Licence scan by sentence rules.

Sentences are normalised to lower-case words and digits and mapped to identifiers of known licence
sentences; the sequence of identifiers is then matched against ordered rules, each of which takes
what it matches out of the sequence.  Built-in functions only.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Identifiers of licence sentences and patterns of the whole normalised sentence.
_REF = r"(.* )?(licensed|released|distributed|available|published|provided|covered)( [a-z]+)? (under|by) (the )?(terms of )?(the )?"
SENTENCES: tuple[tuple[str, str], ...] = (
    ("mit_grant", r"(.* )?permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files.*"),
    ("mit_notice", r"the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    ("as_is", r"the software is provided as is without warranty of any kind.*"),
    ("isc_grant", r"(.* )?permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted.*"),
    ("bsd_grant", r"(.* )?redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("bsd_source", r"(.* )?redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"),
    ("bsd_binary", r"(.* )?redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer.*"),
    ("bsd_endorse", r"(.* )?neither the name of .* may be used to endorse or promote products derived from this software.*"),
    ("bsd_disclaimer", r"this software is provided by .* as is and any express or implied warranties.*"),
    ("lgpl_ref", _REF + r"gnu (lesser|library) general public licen[sc]e.*"),
    ("agpl_ref", _REF + r"gnu affero general public licen[sc]e.*"),
    ("gpl3_ref", _REF + r"gnu general public licen[sc]e (version |v )?3.*"),
    ("gpl2_ref", _REF + r"gnu general public licen[sc]e (version |v )?2.*"),
    ("gpl_ref", _REF + r"gnu general public licen[sc]e"),
    ("gpl_later", r"(.* )?either version [23]( 0)? of the licen[sc]e or at your option any later version"),
    ("apache2_ref", _REF + r"apache licen[sc]e( version)? 2( 0)?( the licen[sc]e)?"),
    ("mit_ref", _REF + r"(mit|expat) licen[sc]e.*"),
    ("bsd3_ref", _REF + r"(bsd 3 clause|3 clause bsd|new bsd)( licen[sc]e)?.*"),
    ("bsd2_ref", _REF + r"(bsd 2 clause|2 clause bsd|simplified bsd)( licen[sc]e)?.*"),
    ("mpl2_ref", _REF + r"mozilla public licen[sc]e( version| v)? 2( 0)?.*"),
    ("cc_by_nc_nd_ref", _REF + r"(cc by nc nd|creative commons attribution non ?commercial no ?deriv[a-z]*) ?(licen[sc]e )?4 0.*"),
    ("cc_by_nc_sa_ref", _REF + r"(cc by nc sa|creative commons attribution non ?commercial share ?alike) ?(licen[sc]e )?4 0.*"),
    ("cc_by_nc_ref", _REF + r"(cc by nc|creative commons attribution non ?commercial) ?(licen[sc]e )?4 0.*"),
    ("cc_by_sa_ref", _REF + r"(cc by sa|creative commons attribution share ?alike) ?(licen[sc]e )?4 0.*"),
    ("cc_by_ref", _REF + r"(cc by|creative commons attribution) ?(licen[sc]e )?4 0.*"),
    ("cc0_ref", r"(.* )?(cc0|creative commons zero)( .*)?"),
    ("unlicense", r"this is free and unencumbered software released into the public domain"),
    ("reserved", r"(.* )?all rights reserved"),
)

# The standard notices of the GNU licences and the MPL, looked at before the others.
_TERMS = r"(.* )?(modify|redistribute|distribute|copy|use)( it| them| this [a-z]+)? (under|according to) (the )?terms( and conditions)? of (the )?"
_VERSION_OF = r"(version [0-9]( [0-9])? of (the )?)?"
_GPL, _FSF = r"gnu general public licen[sc]e", r"( as published by the free software foundation( inc)?)?"


def _gpl(v: int) -> str:
    return f"{_TERMS}(version {v}( 0)? of (the )?{_GPL}{_FSF}|{_GPL}{_FSF} (either )?(version |v )?{v}( 0)?( of the licen[sc]e)?{_FSF})"


NOTICES: tuple[tuple[str, str], ...] = (
    ("agpl_notice", _TERMS + _VERSION_OF + r"gnu affero general public licen[sc]e.*"),
    ("lgpl_notice", _TERMS + _VERSION_OF + r"gnu (lesser|library) general public licen[sc]e.*"),
    ("gpl3_later_notice", _gpl(3) + r" or (at your option )?(any )?later( version)?.*"),
    ("gpl2_later_notice", _gpl(2) + r" or (at your option )?(any )?later( version)?.*"),
    ("gpl3_notice", _gpl(3) + r"( .*)?"),
    ("gpl2_notice", _gpl(2) + r"( .*)?"),
    ("gpl_notice", f"{_TERMS}{_GPL}( .*)?"),
    ("gpl2_later", r"(.* )?either version 2( 0)? of the licen[sc]e or at your option any later version"),
    ("gpl3_only", r"(only )?version 3( 0)? of the licen[sc]e( only)?"),
    ("gpl2_only", r"(only )?version 2( 0)? of the licen[sc]e( only)?"),
    ("mpl2_notice", r"(.* )?subject to (the terms( and conditions)? of )?(the )?mozilla public licen[sc]e( version| v)? 2( 0)?.*"),
)

# Sentences from the full texts of licences.
_CC = r"(.* )?accept and agree to be bound by the terms and conditions of this creative commons attribution "
_CC_END = r" ?4 0 international public licen[sc]e.*"
_GRANTS = r"(.* )?subject to the terms and conditions of this licen[sc]e each contributor hereby grants to you a perpetual worldwide non exclusive no charge royalty free irrevocable "
BODIES: tuple[tuple[str, str], ...] = (
    ("apache2_copyright", _GRANTS + r"copyright licen[sc]e to reproduce prepare derivative works of.*"),
    ("apache2_patent", _GRANTS + r"except as stated in this section patent licen[sc]e to make have made use offer to sell sell import and otherwise transfer the work.*"),
    ("gpl3_preamble", r"(.* )?the gnu general public licen[sc]e is a free copyleft licen[sc]e for software and other kinds of works"),
    ("agpl3_preamble", r"(.* )?the gnu affero general public licen[sc]e is a free copyleft licen[sc]e for software and other kinds of works.*"),
    ("gnu3_rights", r"(.* )?all rights granted under this licen[sc]e are granted for the term of copyright on the program and are irrevocable provided the stated conditions are met"),
    ("gnu2_preamble", r"(.* )?the licen[sc]es for most software are designed to take away your freedom to share and change it"),
    ("gpl2_contrast", r"by contrast the gnu general public licen[sc]e is intended to guarantee your freedom to share and change free software.*"),
    ("lgpl2_contrast", r"by contrast the gnu general public licen[sc]es are intended to guarantee your freedom to share and change free software.*"),
    ("lgpl3_body", r"(.* )?this version of the gnu lesser general public licen[sc]e incorporates the terms and conditions of version 3 of the gnu general public licen[sc]e.*"),
    ("mpl2_grants", r"(.* )?each contributor hereby grants you a world wide royalty free non exclusive licen[sc]e"),
    ("mpl2_source", r"(.* )?all distribution of covered software in source code form including any modifications that you create or to which you contribute must be under the terms of this licen[sc]e"),
    ("cc_by_body", _CC[:-1] + _CC_END),
    ("cc_by_sa_body", _CC + "share ?alike" + _CC_END),
    ("cc_by_nd_body", _CC + "no ?derivatives" + _CC_END),
    ("cc_by_nc_body", _CC + "non ?commercial" + _CC_END),
    ("cc_by_nc_sa_body", _CC + "non ?commercial share ?alike" + _CC_END),
    ("cc_by_nc_nd_body", _CC + "non ?commercial no ?derivatives" + _CC_END),
    ("cc_by_nd_ref", _REF + r"(cc by nd|creative commons attribution no ?deriv[a-z]*) ?(licen[sc]e )?4 0.*"),
)
#: The table of sentences; the first that matches names a sentence.
KNOWN = NOTICES + BODIES + SENTENCES

# Rules in the order in which they are tried; other sentences may lie between those of a rule.
RULES: tuple[tuple[str, tuple[str, ...]], ...] = (
    ("BSD-3-Clause", ("bsd_grant", "bsd_source", "bsd_binary", "bsd_endorse", "bsd_disclaimer")),
    ("BSD-2-Clause", ("bsd_grant", "bsd_source", "bsd_binary", "bsd_disclaimer")),
    ("MIT", ("mit_grant", "mit_notice", "as_is")),
    ("ISC", ("isc_grant", "as_is")),
    ("ISC", ("isc_grant",)),
    ("Apache-2.0", ("apache2_ref",)),
    ("AGPL-3.0", ("agpl_ref",)),
    ("LGPL", ("lgpl_ref",)),
    ("GPL-3.0-or-later", ("gpl3_ref", "gpl_later")),
    ("GPL-2.0-or-later", ("gpl2_ref", "gpl_later")),
    ("GPL-3.0", ("gpl3_ref",)),
    ("GPL-2.0", ("gpl2_ref",)),
    ("GPL", ("gpl_ref",)),
    ("MIT", ("mit_ref",)),
    ("BSD-3-Clause", ("bsd3_ref",)),
    ("BSD-2-Clause", ("bsd2_ref",)),
    ("MPL-2.0", ("mpl2_ref",)),
    ("CC-BY-NC-ND-4.0", ("cc_by_nc_nd_ref",)),
    ("CC-BY-NC-SA-4.0", ("cc_by_nc_sa_ref",)),
    ("CC-BY-NC-4.0", ("cc_by_nc_ref",)),
    ("CC-BY-SA-4.0", ("cc_by_sa_ref",)),
    ("CC-BY-4.0", ("cc_by_ref",)),
    ("CC0-1.0", ("cc0_ref",)),
    ("Unlicense", ("unlicense",)),
    ("Proprietary", ("reserved",)),
)

# Rules with the notices; those that end with a version come first, while all that it may belong to is there.
NOTICE_RULES: tuple[tuple[str, tuple[str, ...]], ...] = (
    ("GPL-3.0-or-later", ("gpl3_ref", "gpl_later")),
    ("GPL-3.0-or-later", ("gpl3_notice", "gpl_later")),
    ("GPL-3.0-or-later", ("gpl_notice", "gpl_later")),
    ("GPL-2.0-or-later", ("gpl2_ref", "gpl2_later")),
    ("GPL-2.0-or-later", ("gpl2_notice", "gpl2_later")),
    ("GPL-2.0-or-later", ("gpl_notice", "gpl2_later")),
    ("GPL-3.0", ("gpl_notice", "gpl3_only")),
    ("GPL-2.0", ("gpl_notice", "gpl2_only")),
    ("AGPL-3.0", ("agpl_notice",)),
    ("LGPL", ("lgpl_notice",)),
    ("GPL-3.0-or-later", ("gpl3_later_notice",)),
    ("GPL-2.0-or-later", ("gpl2_later_notice",)),
    ("GPL-3.0", ("gpl3_notice",)),
    ("GPL-2.0", ("gpl2_notice",)),
    ("GPL", ("gpl_notice",)),
    ("MPL-2.0", ("mpl2_notice",)),
    ("Apache-2.0", ("apache2_copyright", "apache2_patent")),
    ("AGPL-3.0", ("agpl3_preamble", "gnu3_rights")),
    ("GPL-3.0", ("gpl3_preamble", "gnu3_rights")),
    ("GPL-2.0", ("gnu2_preamble", "gpl2_contrast")),
    ("LGPL", ("gnu2_preamble", "lgpl2_contrast")),
    ("LGPL", ("lgpl3_body",)),
    ("MPL-2.0", ("mpl2_grants", "mpl2_source")),
    ("CC-BY-NC-ND-4.0", ("cc_by_nc_nd_body",)),
    ("CC-BY-NC-SA-4.0", ("cc_by_nc_sa_body",)),
    ("CC-BY-NC-4.0", ("cc_by_nc_body",)),
    ("CC-BY-ND-4.0", ("cc_by_nd_body",)),
    ("CC-BY-SA-4.0", ("cc_by_sa_body",)),
    ("CC-BY-4.0", ("cc_by_body",)),
    ("CC-BY-ND-4.0", ("cc_by_nd_ref",)),
    *(rule for rule in RULES if rule[1][-1] != "gpl_later"),
)

#: Every known sentence has one of these words, those that leave out the word licence too.
HINTS = (
    r"licen[sc]|copyright|permission|redistribut|public domain|rights reserved|cc0|creative commons|warrant|endorse|later version"
    r"|bsd [23] clause|[23] clause bsd|new bsd|simplified bsd|cc by"
)
# runs are taken whole from their first character, so that long ones cost no more than their length
_END = r"(?<![.!?;:])[.!?;:]++[ \t\r]++|\n++"
_WRAP = r"(?:(?<![ \t\r])[ \t\r]++)?+\n[ \t\r]*+"


#: References to a GNU licence; a sentence on its version alone belongs to the nearest one before it.
_GNU = tuple(i for i, _ in KNOWN if re.fullmatch(r"[al]?gpl[23]?(_later)?_(ref|notice)", i))


def own_parts(parts: tuple[str, ...]) -> str:
    """Over the same sequence: the parts in order, each the first of its kind, with what lies between in groups.

    Nothing between is another start of the rule, and for a version, no other GNU licence.  A match ends before
    its last comma, and the groups put in its place leave the rest of the sequence as it was.
    """
    out = f",{parts[0]}"
    for part in parts[1:]:
        stop = "|".join(dict.fromkeys((parts[0], part, *(_GNU if parts[-1].endswith(("_later", "_only")) else ()))))
        out += f"((?:,(?!(?:{stop}),)[a-z0-9_]+)*+),{part}"
    return out + "(?=,)"


def _sentences(text: Column, lines: bool) -> Column:
    """Normalised sentences; with lines, a line end ends a sentence too."""
    if not lines:
        text = F.regexp_replace(text, _WRAP, " ")
    parts = F.split(F.regexp_replace(F.lower(text), r"\bv\.[ \t\r]+(?=[0-9])", "v "), _END)  # the point of "v. 2.0" ends no sentence
    return F.transform(parts, lambda s: F.trim(F.regexp_replace(s, r"[^a-z0-9]+", " ")))


def _identify(sentences: Column) -> Column:
    table = F.array(*[F.struct(F.lit(i).alias("id"), F.lit(f"^{p}$").alias("p")) for i, p in KNOWN])
    one = lambda s: F.get(F.filter(table, lambda k: F.call_function("rlike", s, k["p"])), F.lit(0))["id"]
    return F.filter(F.transform(F.filter(sentences, lambda s: s.rlike(HINTS)), one), lambda x: x.isNotNull())


def match_rules(ids: Column) -> Column:
    """The licences of a sequence of identifiers, comma-separated, in the order of the rules; empty for an empty or null one.

    A rule takes its own parts out, wherever it matches; what lies between stays for the rules after it.  The
    pattern never goes back over what it passed, so that a sequence may be of any length.
    """
    seq = F.when(F.size(ids) > 0, F.concat(F.lit(","), F.array_join(ids, ","), F.lit(",")))
    between = lambda p: "".join(f"${k}" for k in range(1, len(p)))
    rules = F.array(*[F.struct(F.lit(n).alias("name"), F.lit(own_parts(p)).alias("p"), F.lit(between(p)).alias("b")) for n, p in NOTICE_RULES])
    start = F.struct(seq.alias("seq"), F.array().cast("array<string>").alias("out"))

    def apply(acc, rule):
        hit = F.call_function("rlike", acc["seq"], rule["p"])
        return F.struct(
            F.when(hit, F.call_function("regexp_replace", acc["seq"], rule["p"], rule["b"])).otherwise(acc["seq"]).alias("seq"),
            F.when(hit, F.concat(acc["out"], F.array(rule["name"]))).otherwise(acc["out"]).alias("out"),
        )

    found = F.when(F.size(ids) > 0, F.array_join(F.array_distinct(F.aggregate(rules, start, apply)["out"]), ","))
    return F.coalesce(found, F.lit(""))


def scan_licenses(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """doc_id, sentence_ids and licences (both comma-separated, empty if none) and n_hints for each row.

    Sentences are taken line by line and across line ends, for those that are wrapped; the sequence is that
    of the way that knows more, the wrapped one of equals, then what only the other knows.  n_hints counts the
    sentences of the first kind that speak of licensing, known or not.  A null or empty text has none of
    them.  Rows are judged by themselves; null and repeated ids are kept as they are.  Only the id and text columns
    are read, so that others may have any name; an empty table gives no rows.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.when(F.lower(text).rlike(HINTS.replace(" ", "[^a-z0-9]+")), text).alias("t"))
    none = F.lit(None).cast("array<string>")
    seen = src.select(
        "doc_id",
        F.when(F.col("t").isNotNull(), _sentences(F.col("t"), True)).otherwise(none).alias("s"),
        F.when(F.col("t").isNotNull(), _sentences(F.col("t"), False)).otherwise(none).alias("wrapped"),
    )
    ids = seen.select("doc_id", F.size(F.filter("s", lambda s: s.rlike(HINTS))).alias("n"), _identify(F.col("s")).alias("a"), _identify(F.col("wrapped")).alias("b"))
    rest = lambda x, y: F.concat(x, F.filter(y, lambda v: ~F.array_contains(x, v)))
    both = F.when(F.size("b") >= F.size("a"), rest(F.col("b"), F.col("a"))).otherwise(rest(F.col("a"), F.col("b")))
    ids = ids.select("doc_id", F.greatest("n", F.lit(0)).cast("long").alias("n_hints"), both.alias("ids"))
    return ids.select("doc_id", "n_hints", F.coalesce(F.array_join("ids", ","), F.lit("")).alias("sentence_ids"), match_rules(F.col("ids")).alias("licences"))


def oracle(table: str = "documents") -> str:
    """The same rows in DuckDB SQL, by list functions: every sentence is compared with the whole table, and a rule looks for the
    places of its parts in the list of identifiers."""
    q = lambda s: "'" + s.replace("'", "''") + "'"
    version = rf"regexp_replace(lower({{}}), '\bv\.[ \t\r]+([0-9])', 'v \1', 'g')"
    norm = lambda t: (
        rf"list_transform(string_split_regex({version.format(t)}, '[.!?;:]+[ \t\r]+|\n+'), lambda s: trim(regexp_replace(s, '[^a-z0-9]+', ' ', 'g')))"
    )
    case = "CASE " + " ".join(f"WHEN regexp_full_match(s, {q(p)}) THEN {q(i)}" for i, p in KNOWN) + " END"
    ident = lambda c: f"list_filter(list_transform({c}, lambda s: {case}), lambda x: x IS NOT NULL)"
    sql = (
        f"WITH t AS (SELECT doc_id, coalesce(text, '') AS t FROM {table}), "
        rf"s AS MATERIALIZED (SELECT doc_id, {norm('t')} AS s, {norm(r"regexp_replace(t, '[ \t\r]*\n[ \t\r]*', ' ', 'g')")} AS w FROM t), "
        f"i AS MATERIALIZED (SELECT doc_id, len(list_filter(s, lambda x: regexp_matches(x, {q(HINTS)}))) AS n_hints, {ident('s')} AS a, {ident('w')} AS b FROM s), "
        "c AS (SELECT doc_id, n_hints, CASE WHEN len(b) >= len(a) THEN list_concat(b, list_filter(a, lambda x: NOT list_contains(b, x))) "
        "ELSE list_concat(a, list_filter(b, lambda x: NOT list_contains(a, x))) END AS ids FROM i), "
        "r0 AS MATERIALIZED (SELECT doc_id, n_hints, array_to_string(ids, ',') AS sentence_ids, ids, CAST([] AS VARCHAR[]) AS out FROM c)"
    )
    for k, (name, parts) in enumerate(NOTICE_RULES):
        # places of the first part, each with the place of the next one; then of each further part, the first before that
        found = f"list_filter(range(1, len(ids) + 1), lambda i: ids[i] = {q(parts[0])})"
        found = f"list_transform({found}, lambda i: [i, coalesce(list_min(list_filter(range(i + 1, len(ids) + 1), lambda j: ids[j] = {q(parts[0])})), len(ids) + 1)])"
        stops = "[" + ", ".join(map(q, _GNU)) + "]" if len(parts) > 1 and parts[-1].endswith(("_later", "_only")) else ""
        for n, part in enumerate(parts[1:], 2):
            at = f"list_min(list_filter(range(m[{n - 1 if n == 2 else n}] + 1, m[2]), lambda j: ids[j] = {q(part)}))"
            found = f"list_filter(list_transform({found}, lambda m: list_append(m, {at})), lambda m: m[{n + 1}] IS NOT NULL)"
            if stops:
                found = f"list_filter({found}, lambda m: len(list_filter(range(m[{n - 1 if n == 2 else n}] + 1, m[{n + 1}]), lambda j: list_contains({stops}, ids[j]))) = 0)"
        sql += (
            f", m{k} AS MATERIALIZED (SELECT *, CASE WHEN list_has_all(ids, [{', '.join(map(q, parts))}]) THEN {found} ELSE [] END AS m FROM r{k}), "
            f"g{k} AS MATERIALIZED (SELECT *, flatten(list_transform(m, lambda x: list_concat([x[1]], x[3:]))) AS gone FROM m{k}), "
            f"r{k + 1} AS MATERIALIZED (SELECT doc_id, n_hints, sentence_ids, CASE WHEN len(m) = 0 THEN ids ELSE list_filter(ids, lambda x, i: NOT list_contains(gone, i)) END AS ids, "
            f"CASE WHEN len(m) > 0 AND NOT list_contains(out, {q(name)}) THEN list_append(out, {q(name)}) ELSE out END AS out FROM g{k})"
        )
    return sql + f" SELECT doc_id, CAST(n_hints AS BIGINT) AS n_hints, sentence_ids, array_to_string(out, ',') AS licences FROM r{len(NOTICE_RULES)}"
