"""License detection by ordered signature rules, with DataFrame functions only.

A text is lower-cased and reduced to its words, one space apart. Signature rules are regular
expressions over that word string; each names a keyword (or several, one of which any match holds),
and a rule is tried only on texts that have it among their words. One set intersection finds the
keywords of a text, so that most texts meet no rule at all. All places of all rules are intervals of
words. An interval that lies within one of the same or a higher priority is suppressed, so that a
versioned or fully spelled name silences the short names inside it. Everything is linear in the
text and its places: a text is split once a rule, positions come from running sums, suppression from
running maxima, per text. Of equal intervals of one priority the rule listed first stays.

Defined cases: null text counts as empty; an empty text has no words, no places, null positions,
empty labels and score 0; an empty table gives an empty result; very long texts are scanned whole;
each row is scanned by itself, so repeated rows and ids, null ids too, give repeated results; extra
columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: ASCII bytes that are neither letters nor digits, after lower-casing.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
KELVIN = chr(0x212A)


@dataclass(frozen=True)
class Rule:
    """pattern: over words one space apart; priority: 1 short name, 2 full name or notice, 3 with a version."""

    label: str
    keyword: str
    pattern: str
    priority: int
    base: bool = False


#: Phrases that always count, whatever suppresses them.
BASE_RULES = (
    Rule("mit", "license", "mit license", 2, True),
    Rule("apache", "license", "apache license", 2, True),
    Rule("gpl", "license", "general public license", 2, True),
)

#: label, keyword, pattern of the name, versions that exist.
FAMILIES = (
    ("gpl", "general", "(?:gnu )?general public licen[cs]e", ("1", "2", "3")),
    ("gpl", "gpl", "(?:gnu )?gpl", ("1", "2", "3")),
    ("lgpl", "general", "(?:gnu )?(?:lesser|library) general public licen[cs]e", ("2", "2 1", "3")),
    ("lgpl", "lgpl", "(?:gnu )?lgpl", ("2", "2 1", "3")),
    ("agpl", "affero", "(?:gnu )?affero general public licen[cs]e", ("1", "3")),
    ("agpl", "agpl", "(?:gnu )?agpl", ("1", "3")),
    ("gfdl", "documentation", "(?:gnu )?free documentation licen[cs]e", ("1 1", "1 2", "1 3")),
    ("apache", "apache", "apache(?: software)?(?: licen[cs]e)?", ("1 0", "1 1", "2 0", "2")),
    ("mpl", "mozilla", "mozilla public licen[cs]e", ("1 0", "1 1", "2 0")),
    ("mpl", "mpl", "mpl", ("1 0", "1 1", "2 0")),
    ("epl", "eclipse", "eclipse public licen[cs]e", ("1 0", "2 0")),
    ("eupl", "european", "european union public licen[cs]e", ("1 0", "1 1", "1 2")),
    ("cddl", "distribution", "common development and distribution licen[cs]e", ("1 0", "1 1")),
    ("artistic", "artistic", "artistic licen[cs]e", ("1 0", "2 0")),
    ("boost", "boost", "boost software licen[cs]e", ("1 0",)),
    ("ofl", "font", "(?:sil )?open font licen[cs]e", ("1 0", "1 1")),
    ("osl", "open", "open software licen[cs]e", ("1 0", "2 0", "2 1", "3 0")),
    ("afl", "academic", "academic free licen[cs]e", ("1 1", "1 2", "2 0", "2 1", "3 0")),
    ("zpl", "zope", "zope public licen[cs]e", ("1 1", "2 0", "2 1")),
    ("lppl", "latex", "latex project public licen[cs]e", ("1 0", "1 1", "1 2", "1 3")),
    ("php", "php", "php licen[cs]e", ("3 0", "3 01")),
    ("python", "python", "python(?: software foundation)? licen[cs]e", ("2", "2 0")),
    ("cecill", "cecill", "cecill(?: free software licen[cs]e)?", ("1 0", "2 0", "2 1")),
    ("odbl", "database", "open database licen[cs]e", ("1 0",)),
)
#: Ways to write a version after a name.
VERSION_FORMS = ("version {v}", "v {v}", "v{v}", "{v}", "version {v} or (?:any )?later")
#: Creative Commons: clauses and their versions.
CC_CLAUSES = ("by", "by sa", "by nc", "by nd", "by nc sa", "by nc nd")
CC_VERSIONS = ("1 0", "2 0", "2 5", "3 0", "4 0")
#: Names, notices and headers, written by hand: label, keyword, pattern, priority.
SINGLE = (
    ("mit", "mit", "(?:the )?mit licen[cs]e", 2),
    ("mit", "mit", "(?:released|licensed|distributed|available) under (?:the )?(?:terms of (?:the )?)?mit", 2),
    ("mit", "expat", "expat licen[cs]e", 2),
    ("mit", "spdx", "spdx license identifier mit", 3),
    ("mit", "hereby", "permission is hereby granted free of charge to any person obtaining a copy", 3),
    ("mit", "notice", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software", 3),
    ("mit", "merchantability", "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability", 3),
    ("mit-0", "attribution", "mit no attribution", 3),
    ("mit-0", "spdx", "spdx license identifier mit 0", 3),
    ("x11", "consortium", "the name of the x consortium shall not be used in advertising", 3),
    ("x11", "x11", "x11 licen[cs]e", 2),
    ("bsd", "bsd", "(?:new |modified |simplified |revised |[234] clause )?bsd(?: [0234] clause)?(?: licen[cs]e)?", 1),
    ("bsd", "berkeley", "berkeley software distribution", 2),
    ("bsd", "bsd", "bsd style licen[cs]e", 2),
    ("bsd", "redistribution", "redistribution and use in source and binary forms", 3),
    ("bsd", "redistributions", "redistributions of source code must retain the above copyright notice", 3),
    ("bsd", "redistributions", "redistributions in binary form must reproduce the above copyright notice", 3),
    ("bsd", "provided", "this software is provided by the (?:copyright holders and contributors|regents and contributors|authors?) as is", 3),
    ("bsd-3-clause", "endorse", "neither the names? of .{1,80} (?:may|nor the names of its contributors may) be used to endorse or promote products", 3),
    ("bsd-4-clause", "advertising", "all advertising materials mentioning features or use of this software must display", 3),
    ("bsd-2-clause", "spdx", "spdx license identifier bsd 2 clause", 3),
    ("bsd-3-clause", "spdx", "spdx license identifier bsd 3 clause", 3),
    ("0bsd", "0bsd", "0bsd", 1),
    ("0bsd", "zero", "zero clause bsd", 2),
    ("0bsd", "fee", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted(?! provided)", 3),
    ("apache", "apache", "licensed under the apache licen[cs]e", 2),
    ("apache-2.0", "compliance", "you may not use this (?:file|software|work) except in compliance with the licen[cs]e", 3),
    ("apache-2.0", "applicable", "unless required by applicable law or agreed to in writing software distributed under the licen[cs]e is distributed on an as is basis", 3),
    ("apache-2.0", "contributor", "licensed to the apache software foundation asf under one or more contributor licen[cs]e agreements", 3),
    ("apache-2.0", "apache", "apache org licenses license 2 0", 3),
    ("apache-2.0", "spdx", "spdx license identifier apache 2 0", 3),
    ("apache-1.1", "apache", "this product includes software developed by the apache (?:software foundation|group)", 3),
    ("gpl", "warranty", "this program is distributed in the hope that it will be useful but without any warranty", 3),
    ("gpl", "foundation", "gnu general public licen[cs]e as published by the free software foundation", 3),
    ("gpl", "redistribute", "this program is free software you can redistribute it and or modify it", 3),
    ("gpl", "received", "you should have received a copy of the gnu general public licen[cs]e", 3),
    ("gpl", "copyleft", "copyleft", 1),
    ("gpl-2-or-later", "version", "either version 2 of the licen[cs]e or at your option any later version", 3),
    ("gpl-2-only", "spdx", "spdx license identifier gpl 2 0(?: only)?(?! or)", 3),
    ("gpl-2-or-later", "spdx", "spdx license identifier gpl 2 0 or later", 3),
    ("gpl-3-or-later", "version", "either version 3 of the licen[cs]e or at your option any later version", 3),
    ("gpl-3-only", "spdx", "spdx license identifier gpl 3 0(?: only)?(?! or)", 3),
    ("gpl-3-or-later", "spdx", "spdx license identifier gpl 3 0 or later", 3),
    ("gpl-classpath-exception", "classpath", "classpath exception", 3),
    ("gpl-classpath-exception", "linking", "linking this library statically or dynamically with other modules is making a combined work based on this library", 3),
    ("gpl-font-exception", "font", "gpl font exception|document which uses this font and embed this font", 3),
    ("gcc-exception", "gcc", "gcc runtime library exception", 3),
    ("autoconf-exception", "autoconf", "configuration script generated by autoconf", 3),
    ("bison-exception", "bison", "as a special exception you may create a larger work that contains part or all of the bison parser skeleton", 3),
    ("lgpl", "library", "this library is free software you can redistribute it and or modify it", 3),
    ("lgpl", "library", "this library is distributed in the hope that it will be useful but without any warranty", 3),
    ("lgpl", "lesser", "gnu lesser general public licen[cs]e as published by the free software foundation", 3),
    ("lgpl-2.1", "spdx", "spdx license identifier lgpl 2 1(?: only| or later)?", 3),
    ("lgpl-3", "spdx", "spdx license identifier lgpl 3 0(?: only| or later)?", 3),
    ("agpl", "affero", "gnu affero general public licen[cs]e as published by the free software foundation", 3),
    ("agpl", "network", "if your software can interact with users remotely through a (?:computer )?network", 3),
    ("agpl-3", "spdx", "spdx license identifier agpl 3 0(?: only| or later)?", 3),
    ("gfdl", "invariant", "with no invariant sections no front cover texts and no back cover texts", 3),
    ("gfdl", "document", "permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation licen[cs]e", 3),
    ("mpl", "mozilla", "the contents of this file are subject to the mozilla public licen[cs]e", 3),
    ("mpl-2.0", "mozilla", "this source code form is subject to the terms of the mozilla public licen[cs]e v 2 0", 3),
    ("mpl-2.0", "obtain", "if a copy of the mpl was not distributed with this file you can obtain one at", 3),
    ("mpl-2.0", "spdx", "spdx license identifier mpl 2 0", 3),
    ("mpl-2.0", "secondary", "incompatible with secondary licen[cs]es", 2),
    ("npl", "netscape", "netscape public licen[cs]e", 2),
    ("epl", "eclipse", "this program and the accompanying materials are made available under the terms of the eclipse public licen[cs]e", 3),
    ("epl-1.0", "eclipse", "eclipse org legal epl v10", 3),
    ("epl-2.0", "eclipse", "eclipse org legal epl 2 0", 3),
    ("epl-2.0", "spdx", "spdx license identifier epl 2 0", 3),
    ("edl-1.0", "eclipse", "eclipse distribution licen[cs]e", 2),
    ("cpl-1.0", "common", "common public licen[cs]e", 2),
    ("ipl-1.0", "ibm", "ibm public licen[cs]e", 2),
    ("cddl", "cddl", "cddl", 1),
    ("cddl", "cddl", "the contents of this file are subject to the terms of the common development and distribution licen[cs]e", 3),
    ("cpal-1.0", "attribution", "common public attribution licen[cs]e", 2),
    ("eupl", "eupl", "eupl", 1),
    ("eupl", "eupl", "licensed under the eupl", 2),
    ("isc", "isc", "isc licen[cs]e", 2),
    ("isc", "permission", "permission to use copy modify and or distribute this software for any purpose", 2),
    ("isc", "fee", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that", 3),
    ("isc", "disclaims", "the author disclaims all warranties with regard to this software", 3),
    ("ntp", "ntp", "ntp licen[cs]e", 2),
    ("hpnd", "historical", "historical permission notice and disclaimer", 2),
    ("zlib", "zlib", "zlib(?: libpng)? licen[cs]e", 2),
    ("zlib", "altered", "altered source versions must be plainly marked as such", 3),
    ("zlib", "misrepresented", "the origin of this software must not be misrepresented", 3),
    ("zlib", "damages", "in no event will the authors be held liable for any damages arising from the use of this software", 3),
    ("libpng", "libpng", "libpng licen[cs]e", 2),
    ("ijg", "jpeg", "this software is based in part on the work of the independent jpeg group", 3),
    ("freetype", "freetype", "freetype (?:project )?licen[cs]e|portions of this software are copyright .{1,40} the freetype project", 2),
    ("imagemagick", "imagemagick", "imagemagick licen[cs]e", 2),
    ("curl", "curl", "curl licen[cs]e", 2),
    ("boost", "accompanying", "obtaining a copy of the software and accompanying documentation covered by this licen[cs]e", 3),
    ("boost-1.0", "boost", "distributed under the boost software licen[cs]e version 1 0", 3),
    ("boost-1.0", "spdx", "spdx license identifier bsl 1 0", 3),
    ("unlicense", "unlicense", "(?:the )?unlicense", 1),
    ("unlicense", "unencumbered", "free and unencumbered software released into the public domain", 3),
    ("unlicense", "anyone", "anyone is free to copy modify publish use compile sell or distribute this software", 3),
    ("wtfpl", "wtfpl", "wtfpl", 1),
    ("wtfpl", "want", "do what (?:the fuck )?you want to public licen[cs]e", 3),
    ("beerware", "beer|beerware", "(?:the )?beer ?ware licen[cs]e", 2),
    ("beerware", "beer", "you can buy me a beer in return", 3),
    ("json", "evil", "the software shall be used for good not evil", 3),
    ("openssl", "openssl", "openssl licen[cs]e", 2),
    ("openssl", "openssl", "this product includes software developed by the openssl project", 3),
    ("ssleay", "eric", "this product includes cryptographic software written by eric young", 3),
    ("openldap", "openldap", "openldap public licen[cs]e", 2),
    ("postgresql", "postgresql", "postgresql licen[cs]e", 2),
    ("psf", "psf", "psf licen[cs]e agreement", 3),
    ("psf", "python", "python software foundation licen[cs]e agreement", 3),
    ("php", "php", "this product includes php software freely available", 3),
    ("ruby", "ruby", "ruby licen[cs]e|licensed under the same terms as ruby", 2),
    ("perl", "perl", "under the same terms as perl(?: itself)?", 2),
    ("artistic", "intent", "the intent of this document is to state the conditions under which a package may be copied", 2),
    ("clarified-artistic", "clarified", "clarified artistic licen[cs]e", 2),
    ("tcl", "tcl", "tcl tk licen[cs]e", 2),
    ("vim", "vim", "vim licen[cs]e", 2),
    ("w3c", "w3c", "w3c software (?:notice and )?(?:document )?licen[cs]e", 2),
    ("unicode", "unicode", "unicode (?:inc )?licen[cs]e agreement", 2),
    ("icu", "icu", "icu licen[cs]e", 2),
    ("ncsa", "illinois", "university of illinois (?:ncsa )?open source licen[cs]e", 2),
    ("ecl-2.0", "educational", "educational community licen[cs]e", 2),
    ("ms-pl", "microsoft", "microsoft public licen[cs]e", 2),
    ("ms-rl", "microsoft", "microsoft reciprocal licen[cs]e", 2),
    ("apsl", "apple", "apple public source licen[cs]e", 2),
    ("qpl-1.0", "q", "q public licen[cs]e", 2),
    ("sleepycat", "sleepycat", "sleepycat licen[cs]e", 2),
    ("nasa-1.3", "nasa", "nasa open source agreement", 2),
    ("watcom-1.0", "sybase", "sybase open watcom public licen[cs]e", 2),
    ("rpl", "reciprocal", "reciprocal public licen[cs]e", 2),
    ("upl-1.0", "universal", "universal permissive licen[cs]e", 2),
    ("blueoak-1.0.0", "oak", "blue oak model licen[cs]e", 2),
    ("mulan", "mulan", "mulan (?:psl|permissive software licen[cs]e)", 2),
    ("afl", "academic", "licensed under the academic free licen[cs]e", 2),
    ("ofl", "reserved", "with reserved font name", 2),
    ("ofl", "font", "this font software is licensed under the sil open font licen[cs]e", 3),
    ("bitstream-vera", "bitstream", "bitstream vera fonts copyright", 3),
    ("ubuntu-font", "ubuntu", "ubuntu font licen[cs]e", 2),
    ("odc-by", "commons", "open data commons attribution licen[cs]e", 2),
    ("pddl", "dedication", "public domain dedication and licen[cs]e", 2),
    ("odbl", "odbl", "odbl", 1),
    ("cc0", "cc0", "cc0(?: 1 0)?(?: universal)?", 2),
    ("cc0", "dedication", "public domain dedication", 2),
    ("cc0", "extent", "to the extent possible under law .{1,80} has waived all copyright and related or neighboring rights", 3),
    ("cc", "commons", "licensed under a creative commons", 2),
    ("cc", "commons", "creative commons", 1),
    ("cc-by", "creativecommons", "creativecommons org licenses by(?! (?:sa|nc|nd))", 3),
    ("cc-by-sa", "creativecommons", "creativecommons org licenses by sa", 3),
    ("cc-by-nc", "creativecommons", "creativecommons org licenses by nc(?! (?:sa|nd))", 3),
    ("cc-by-nd", "creativecommons", "creativecommons org licenses by nd", 3),
    ("cc-by-nc-sa", "creativecommons", "creativecommons org licenses by nc sa", 3),
    ("cc-by-nc-nd", "creativecommons", "creativecommons org licenses by nc nd", 3),
    ("public-domain", "domain", "(?:in|into|to) the public domain", 1),
    ("public-domain", "domain", "this (?:work|file|code|software) is in the public domain", 2),
    ("public-domain", "disclaims", "the author disclaims copyright to this source code", 3),
    ("sspl-1.0", "server", "server side public licen[cs]e", 2),
    ("busl-1.1", "business", "business source licen[cs]e", 2),
    ("elastic-2.0", "elastic", "elastic licen[cs]e", 2),
    ("commons-clause", "commons", "commons clause", 2),
    ("polyform", "polyform", "polyform (?:noncommercial|small business|shield|strict|free trial|perimeter|internal use) licen[cs]e", 2),
    ("openrail", "open|openrail", "(?:creativeml )?open ?rail(?: m)?(?: licen[cs]e)?", 2),
    ("hippocratic", "hippocratic", "hippocratic licen[cs]e", 2),
    ("all-rights-reserved", "rights", "all rights reserved", 1),
    ("proprietary", "proprietary", "proprietary and confidential", 1),
    ("proprietary", "unauthorized", "unauthorized (?:copying|use|reproduction) of this (?:file|software|material) .{0,40}is strictly prohibited", 2),
    ("proprietary", "trade", "contains trade secrets", 1),
    ("noncommercial", "non|noncommercial", "for non ?commercial (?:use|purposes) only", 1),
    ("evaluation", "evaluation", "for evaluation purposes only", 1),
)


def signature_rules() -> list[Rule]:
    """Every rule: the base phrases, then single rules, then names with and without versions."""
    rules = [*BASE_RULES, *(Rule(*row) for row in SINGLE)]
    for label, keyword, name, versions in FAMILIES:
        rules.append(Rule(label, keyword, name, 1 if " " not in name else 2))
        rules += [Rule(f"{label}-{v.replace(' ', '.')}", keyword, f"{name} (?:licen[cs]e )?{form.format(v=v)}", 3) for v in versions for form in VERSION_FORMS]
    for clause in CC_CLAUSES:
        spelled = clause.replace("by", "attribution").replace("sa", "share ?alike").replace("nc", "non ?commercial").replace("nd", "no ?deriv(?:ative)?s?")
        label = "cc-" + clause.replace(" ", "-")
        rules.append(Rule(label, "cc", f"cc {clause}", 2))
        rules.append(Rule(label, "commons", f"creative commons {spelled}(?: licen[cs]e)?", 2))
        for v in CC_VERSIONS:
            rules.append(Rule(f"{label}-{v.replace(' ', '.')}", "cc", f"cc {clause} {v}", 3))
            rules.append(Rule(f"{label}-{v.replace(' ', '.')}", "commons", f"creative commons {spelled}(?: licen[cs]e)? (?:version )?{v}(?: international| unported| generic)?", 3))
    return rules


def scan(docs: DataFrame, *, rules: list[Rule] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of ``docs``.

    n_words, n_base (places of base rules), first_word and last_word (their smallest and largest
    start), base_labels, labels (those not suppressed and the base ones; sorted and joined), score
    (1 - 2 ** -(sum of the priorities left)), and detections: start, end, label of each place left.
    """
    rules = signature_rules() if rules is None else rules
    quote = lambda s: "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"
    keywords: dict[str, list[str]] = {}
    for k, rule in enumerate(rules):
        keywords.setdefault(rule.keyword, []).append(f"named_struct('k', {k}, 're', {quote(f'(?<= )(?:{rule.pattern})(?= )')})")
    listed = lambda names: f"array({', '.join(map(quote, names))})"
    table = ", ".join(f"named_struct('words', {listed(word.split('|'))}, 'rules', array({', '.join(of)}))" for word, of in sorted(keywords.items()))
    # lower() maps one character outside A-Z to a letter from a to z, the Kelvin sign.
    text = F.lower(F.replace(F.coalesce(F.col(text_col).cast("string"), F.lit("")), F.lit(KELVIN), F.lit(chr(0xFFFD))))
    every = sorted({w for word in keywords for w in word.split("|")})
    spaces = lambda x: f"length({x}) - length(replace({x}, ' ', ''))"
    # The text is split once a rule; the array of one binds the parts for all places of the rule.
    places = F.expr(
        f"""flatten(transform(flatten(transform(filter(array({table}), g -> arrays_overlap(g.words, found)), g -> g.rules)), r ->
            get(transform(array(named_struct('found', regexp_extract_all(w, r.re, 0), 'parts', split(w, r.re, -1))), x ->
             transform(x.found, (m, i) -> named_struct('k', r.k, 'i', i, 'gap', {spaces('get(x.parts, i)')}, 'inner', {spaces('m')}))), 0)))"""
    )
    base = docs.select(F.col(id_col).alias("id"), F.array_remove(F.split(text, SEPARATORS), "").alias("ws"))
    base = base.select("id", F.monotonically_increasing_id().alias("row"), "ws", F.array_intersect("ws", F.expr(listed(every))).alias("found"))
    base = base.select("id", "row", F.size("ws").cast("long").alias("n_words"), "found", F.when(F.size("found") > 0, F.concat(F.lit(" "), F.array_join("ws", " "), F.lit(" "))).alias("w"))
    base = base.select("id", "row", "n_words", F.when(F.col("w").isNotNull(), places).alias("places"))
    each = base.select("id", "row", "n_words", F.explode_outer("places").alias("p")).select("id", "row", "n_words", "p.k", "p.i", "p.gap", "p.inner")
    order = Window.partitionBy("row", "k").orderBy("i")
    start = F.sum(F.col("gap")).over(order) + F.coalesce(F.sum("inner").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) - 1
    each = each.withColumn("start", start).withColumn("end", F.col("start") + F.col("inner") + 1)
    pick = lambda values: F.element_at(F.array(*map(F.lit, values)), F.col("k") + 1)
    each = each.withColumns({"label": pick([r.label for r in rules]), "priority": pick([r.priority for r in rules]), "is_base": F.coalesce(pick([r.base for r in rules]), F.lit(False))})
    before = Window.partitionBy("row").orderBy("start", F.desc("end"), F.desc("priority"), "k").rowsBetween(Window.unboundedPreceding, -1)
    covered = F.lit(False)
    for level in (1, 2, 3):
        covered = covered | ((F.col("priority") == level) & F.coalesce(F.max(F.when(F.col("priority") >= level, F.col("end"))).over(before) >= F.col("end"), F.lit(False)))
    each = each.withColumn("left", F.col("k").isNotNull() & ~covered)
    joined = lambda condition: F.array_join(F.array_sort(F.collect_set(F.when(condition, F.col("label")))), ",")
    out = each.groupBy("row", "id", "n_words").agg(
        F.count(F.when(F.col("is_base"), 1)).alias("n_base"),
        F.min(F.when(F.col("is_base"), F.col("start"))).cast("long").alias("first_word"),
        F.max(F.when(F.col("is_base"), F.col("start"))).cast("long").alias("last_word"),
        joined(F.col("is_base")).alias("base_labels"),
        joined(F.col("is_base") | F.col("left")).alias("labels"),
        (1 - F.pow(F.lit(2.0), -F.coalesce(F.sum(F.when(F.col("left"), F.col("priority"))), F.lit(0)))).alias("score"),
        F.array_sort(F.collect_list(F.when(F.col("left"), F.struct("start", "end", "label")))).alias("detections"),
    )
    return out.drop("row").withColumnRenamed("id", id_col)
