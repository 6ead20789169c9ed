"""License scan: ordered signature rules over word-normalised text. DataFrame functions only.

A text is lower-cased (A-Z) and its words joined by single blanks. Every rule has a keyword, a
pattern, a label and a priority; a rule's pattern is tried only on texts that hold its keyword. Of
the detections, taken by start and then longest first, one that lies inside another of the same or
a higher priority is suppressed. The labels of the rest, with those of the three base phrases, and
the score of the strongest rule left are returned.

Defined results: null, empty and wordless texts have no words, labels '' and score 0; positions
count words from 0; repeated rows repeat their result; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .native import LOWER, UPPER, let, running_sum

BASE = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Score by priority: 5 identifier tags and full grants, 4 named and versioned, 3 named, 2 conditions and disclaimers, 1 notices.
SCORES = {5: 1.0, 4: 0.9, 3: 0.75, 2: 0.5, 1: 0.3}

# (priority, label, keyword, pattern); V stands for an optional "version" or "v" before a number.
_V = r"(?:version |v |v)?"
RULES_BY_HAND = [
    # Identifier tags
    (5, "mit", "spdx", r"spdx license identifier mit"),
    (5, "apache-2.0", "spdx", r"spdx license identifier apache 2 0"),
    (5, "bsd-2-clause", "spdx", r"spdx license identifier bsd 2 clause(?: patent| views)?"),
    (5, "bsd-3-clause", "spdx", r"spdx license identifier bsd 3 clause(?: clear| lbnl)?"),
    (5, "isc", "spdx", r"spdx license identifier isc"),
    (5, "mpl-2.0", "spdx", r"spdx license identifier mpl 2 0"),
    (5, "gpl-2.0", "spdx", r"spdx license identifier gpl 2 0(?: only| or later)?"),
    (5, "gpl-3.0", "spdx", r"spdx license identifier gpl 3 0(?: only| or later)?"),
    (5, "lgpl-2.1", "spdx", r"spdx license identifier lgpl 2 1(?: only| or later)?"),
    (5, "lgpl-3.0", "spdx", r"spdx license identifier lgpl 3 0(?: only| or later)?"),
    (5, "agpl-3.0", "spdx", r"spdx license identifier agpl 3 0(?: only| or later)?"),
    (5, "unlicense", "spdx", r"spdx license identifier unlicense"),
    (5, "cc0-1.0", "spdx", r"spdx license identifier cc0 1 0"),
    (5, "epl-2.0", "spdx", r"spdx license identifier epl 2 0"),
    (5, "bsl-1.0", "spdx", r"spdx license identifier bsl 1 0"),
    (5, "zlib", "spdx", r"spdx license identifier zlib"),
    (1, "spdx-tag", "spdx", r"spdx license identifier [^ ]+"),
    # MIT family
    (4, "mit", "mit", r"(?:released|licensed|distributed|available|provided) under (?:the )?(?:terms of the )?mit (?:license|licence)"),
    (3, "mit", "mit", r"(?:the )?mit (?:license|licence)"),
    (3, "mit", "mit", r"license mit"),
    (3, "mit", "mit", r"mit licensed"),
    (4, "mit", "permission", r"permission is hereby granted free of charge to any person obtaining a copy of this software"),
    (4, "mit-0", "mit", r"mit no attribution(?: license)?"),
    (3, "x11", "x11", r"x11 (?:license|licence)"),
    (3, "expat", "expat", r"expat (?:license|licence)"),
    (4, "isc", "isc", r"(?:under|under the|the) isc (?:license|licence)"),
    (4, "isc", "permission", r"permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    (4, "ntp", "permission", r"permission to use copy modify and distribute this software and its documentation for any purpose"),
    # Apache
    (4, "apache-2.0", "apache", r"(?:licensed|released|distributed) under (?:the )?(?:terms of the )?apache (?:license|licence) " + _V + r"2(?: 0)?"),
    (4, "apache-2.0", "apache", r"apache (?:license|licence) " + _V + r"2(?: 0)?"),
    (4, "apache-2.0", "apache", r"apache 2(?: 0)? (?:license|licence|licensed)"),
    (4, "apache-2.0", "apache", r"apache org licenses license 2 0"),
    (4, "apache-1.1", "apache", r"apache (?:software )?(?:license|licence) " + _V + r"1 1"),
    (4, "apache-1.0", "apache", r"apache (?:software )?(?:license|licence) " + _V + r"1 0"),
    (3, "apache", "apache", r"apache (?:software )?(?:foundation )?(?:license|licence)"),
    (3, "apache", "apache", r"licensed to the apache software foundation(?: asf)?"),
    # BSD family
    (4, "bsd-2-clause", "bsd", r"(?:bsd 2 clause|2 clause bsd|two clause bsd|simplified bsd|freebsd)(?: license| licence)"),
    (4, "bsd-3-clause", "bsd", r"(?:bsd 3 clause|3 clause bsd|three clause bsd|new bsd|modified bsd|revised bsd)(?: license| licence)"),
    (4, "bsd-4-clause", "bsd", r"(?:bsd 4 clause|4 clause bsd|four clause bsd|original bsd|old bsd)(?: license| licence)"),
    (4, "0bsd", "bsd", r"(?:0bsd|bsd zero clause|zero clause bsd)(?: license| licence)?"),
    (3, "bsd", "bsd", r"(?:the )?bsd (?:style )?(?:license|licence)"),
    (3, "bsd", "bsd", r"license bsd"),
    (2, "bsd", "redistribution", r"redistribution and use in source and binary forms with or without modification are permitted"),
    (2, "bsd-3-clause", "endorse", r"may be used to endorse or promote products derived from this software"),
    (2, "bsd-4-clause", "advertising", r"all advertising materials mentioning features or use of this software"),
    # Mozilla, Eclipse, CDDL and other file-level copyleft
    (4, "mpl-1.0", "mozilla", r"mozilla public (?:license|licence) " + _V + r"1 0"),
    (4, "mpl-1.1", "mozilla", r"mozilla public (?:license|licence) " + _V + r"1 1"),
    (4, "mpl-2.0", "mozilla", r"mozilla public (?:license|licence) " + _V + r"2(?: 0)?"),
    (3, "mpl", "mozilla", r"mozilla public (?:license|licence)"),
    (4, "mpl-2.0", "mpl", r"mpl " + _V + r"2(?: 0)?"),
    (4, "mpl-1.1", "mpl", r"mpl " + _V + r"1 1"),
    (4, "epl-1.0", "eclipse", r"eclipse public (?:license|licence) " + _V + r"1 0"),
    (4, "epl-2.0", "eclipse", r"eclipse public (?:license|licence) " + _V + r"2 0"),
    (3, "epl", "eclipse", r"eclipse public (?:license|licence)"),
    (3, "edl", "eclipse", r"eclipse distribution (?:license|licence)"),
    (4, "cddl-1.0", "cddl", r"cddl " + _V + r"1 0"),
    (4, "cddl-1.1", "cddl", r"cddl " + _V + r"1 1"),
    (3, "cddl", "common development", r"common development and distribution (?:license|licence)"),
    (3, "cpl", "common public", r"common public (?:license|licence)"),
    (4, "cpl-1.0", "common public", r"common public (?:license|licence) " + _V + r"1 0"),
    (4, "cpal-1.0", "common public", r"common public attribution (?:license|licence)(?: " + _V + r"1 0)?"),
    (3, "ibm-pl", "ibm public", r"ibm public (?:license|licence)"),
    (3, "apsl", "apple public", r"apple public source (?:license|licence)"),
    (3, "ms-pl", "microsoft", r"microsoft public (?:license|licence)"),
    (3, "ms-rl", "microsoft", r"microsoft reciprocal (?:license|licence)"),
    (4, "eupl-1.1", "european union", r"european union public (?:license|licence) " + _V + r"1 1"),
    (4, "eupl-1.2", "european union", r"european union public (?:license|licence) " + _V + r"1 2"),
    (3, "eupl", "european union", r"european union public (?:license|licence)"),
    (3, "cecill", "cecill", r"cecill(?: free software)?(?: license(?: agreement)?)?"),
    (3, "osl-3.0", "open software", r"open software (?:license|licence)(?: " + _V + r"3 0)?"),
    (3, "afl-3.0", "academic free", r"academic free (?:license|licence)(?: " + _V + r"3 0)?"),
    # Other permissive
    (4, "bsl-1.0", "boost", r"boost software (?:license|licence)(?: " + _V + r"1 0)?"),
    (3, "zlib", "zlib", r"zlib(?: libpng)? (?:license|licence)"),
    (3, "libpng", "libpng", r"libpng (?:license|licence)"),
    (3, "artistic", "artistic", r"artistic (?:license|licence)"),
    (4, "artistic-1.0", "artistic", r"artistic (?:license|licence) " + _V + r"1 0"),
    (4, "artistic-2.0", "artistic", r"artistic (?:license|licence) " + _V + r"2 0"),
    (3, "perl", "perl", r"under the same terms as perl(?: itself)?"),
    (3, "psf-2.0", "python software", r"python software foundation (?:license|licence)(?: " + _V + r"2)?"),
    (3, "php-3.01", "php", r"php (?:license|licence)(?: " + _V + r"3 01)?"),
    (3, "ruby", "ruby", r"ruby (?:license|licence)"),
    (3, "postgresql", "postgresql", r"postgresql (?:license|licence)"),
    (3, "openssl", "openssl", r"openssl (?:license|licence)"),
    (3, "ncsa", "ncsa", r"(?:university of illinois )?ncsa(?: open source)? (?:license|licence)"),
    (3, "upl-1.0", "universal permissive", r"universal permissive (?:license|licence)(?: " + _V + r"1 0)?"),
    (3, "w3c", "w3c", r"w3c software(?: notice and)? (?:license|licence)"),
    (3, "unicode", "unicode", r"unicode (?:license|licence)(?: agreement)?"),
    (3, "ofl-1.1", "sil open", r"sil open font (?:license|licence)(?: " + _V + r"1 1)?"),
    (3, "wtfpl", "wtfpl", r"wtfpl(?: " + _V + r"2)?"),
    (3, "beerware", "beer", r"beer ?ware (?:license|licence)"),
    (3, "json", "not evil", r"software shall be used for good not evil"),
    # Public domain
    (4, "unlicense", "unlicense", r"(?:the )?unlicense"),
    (4, "unlicense", "unencumbered", r"this is free and unencumbered software released into the public domain"),
    (2, "public-domain", "public domain", r"(?:released|placed|dedicated|put) (?:in|into|to) the public domain"),
    (1, "public-domain", "public domain", r"public domain"),
    (4, "cc0-1.0", "cc0", r"cc0(?: 1 0)?(?: universal)?"),
    (4, "cc0-1.0", "creative commons", r"creative commons (?:cc0|zero)(?: 1 0)?(?: universal)?"),
    (4, "pddl", "public domain", r"public domain dedication and (?:license|licence)"),
    # GNU, without versions (the versioned ones follow by rule)
    (3, "gpl", "general public", r"(?:gnu )?general public (?:license|licence)"),
    (3, "lgpl", "general public", r"(?:gnu )?(?:lesser|library) general public (?:license|licence)"),
    (3, "agpl", "general public", r"(?:gnu )?affero general public (?:license|licence)"),
    (3, "gfdl", "free documentation", r"(?:gnu )?free documentation (?:license|licence)"),
    (3, "gpl", "gnu gpl", r"(?:the )?gnu gpl"),
    (3, "lgpl", "lgpl", r"(?:the )?(?:gnu )?lgpl"),
    (3, "agpl", "agpl", r"(?:the )?(?:gnu )?agpl"),
    (2, "copyleft", "copyleft", r"copyleft"),
    (2, "gpl", "free software foundation", r"as published by the free software foundation(?: either " + _V + r"[0-9](?: [0-9])? of the license or at your option any later version)?"),
    # Creative Commons, without kinds (those follow by rule)
    (2, "cc", "creative commons", r"creative commons(?: license| licence)?"),
    (3, "cc-by", "creative commons", r"creative commons attribution(?: [1-4] [05])?"),
    # Data
    (3, "odbl", "open data", r"open (?:data commons open )?database (?:license|licence)"),
    (3, "odbl", "odbl", r"odbl(?: 1 0)?"),
    (3, "odc-by", "open data", r"open data commons attribution (?:license|licence)"),
    (3, "cdla", "community data", r"community data (?:license|licence) agreement"),
    (3, "ogl", "open government", r"open government (?:license|licence)(?: v?[1-3](?: 0)?)?"),
    (3, "openrail", "rail", r"(?:open ?rail|responsible ai)(?: m)? (?:license|licence)"),
    # Source-available and proprietary
    (4, "sspl-1.0", "server side", r"server side public (?:license|licence)(?: " + _V + r"1)?"),
    (4, "busl-1.1", "business source", r"business source (?:license|licence)(?: " + _V + r"1 1)?"),
    (4, "elastic-2.0", "elastic", r"elastic (?:license|licence)(?: " + _V + r"2(?: 0)?)?"),
    (3, "commons-clause", "commons clause", r"commons clause(?: license condition)?"),
    (3, "polyform", "polyform", r"polyform (?:noncommercial|strict|shield|perimeter|small business|internal use) (?:license|licence)"),
    (2, "proprietary", "proprietary", r"proprietary and confidential"),
    (2, "proprietary", "proprietary", r"proprietary (?:license|licence|software)"),
    (2, "proprietary", "end user", r"end user (?:license|licence) agreement"),
    (2, "proprietary", "unauthorized", r"unauthorized (?:copying|reproduction|use|distribution)(?: of this (?:file|work|material))?"),
    (2, "no-redistribution", "redistribut", r"may not be (?:reproduced|redistributed|copied)"),
    (2, "non-commercial", "commercial", r"(?:for )?non ?commercial use only"),
    (2, "non-commercial", "commercial", r"not for commercial use"),
    (2, "attribution", "attribution", r"attribution (?:is )?required"),
    # Disclaimers and notices
    (2, "warranty-disclaimer", "warrant", r"without warranty of any kind(?: express or implied)?"),
    (2, "warranty-disclaimer", "warrant", r"without warranties or conditions of any kind"),
    (2, "warranty-disclaimer", "as is", r"provided (?:by the copyright holders and contributors )?as is"),
    (2, "warranty-disclaimer", "warrant", r"(?:merchantability|fitness for a particular purpose) (?:and|or) (?:fitness for a particular purpose|non ?infringement)"),
    (2, "reserved", "rights reserved", r"all rights (?:are )?reserved"),
    (2, "reserved", "rights reserved", r"copyright (?:c )?(?:[12][0-9]{3} )?(?:[^ ]+ ){0,6}all rights reserved"),
    (1, "reserved", "rights reserved", r"some rights reserved"),
    (1, "copyright", "copyright", r"copyright (?:c )?(?:by )?(?:19|20)[0-9]{2}"),
    (1, "copyright", "copyright", r"copyright (?:holder|holders|owner|owners|notice)"),
    (1, "copyright", "copyrighted", r"copyrighted (?:material|work)"),
    (1, "licensed", "licensed", r"(?:this (?:work|software|file|document|content) is )?licensed under"),
    (1, "license-text", "license", r"license agreement"),
]


def rules() -> list[tuple[int, str, str, str]]:
    """The rules by hand and the versioned families built from one rule each."""
    out = list(RULES_BY_HAND)
    gnu = (("gpl", "general public", "gnu general public|general public", ("1", "2", "3")), ("lgpl", "general public", "(?:gnu )?(?:lesser|library) general public", ("2", "2 1", "3")),
           ("agpl", "general public", "(?:gnu )?affero general public", ("1", "3")), ("gfdl", "free documentation", "(?:gnu )?free documentation", ("1 1", "1 2", "1 3")))
    for short, keyword, name, versions in gnu:
        for v in versions:
            label = f"{short}-{v.replace(' ', '.') if ' ' in v else v + '.0'}"
            tail = "" if " " in v else "(?: 0)?"
            out.append((4, label, keyword, rf"(?:{name}) (?:license|licence) {_V}{v}{tail}"))
            out.append((4, f"{label}-or-later", keyword, rf"(?:{name}) (?:license|licence) (?:either )?{_V}{v}{tail} (?:of the license )?or (?:at your option )?(?:any )?later(?: version)?"))
            if short != "gfdl":
                out.append((4, label, short, rf"(?:gnu )?{short} ?{_V}{v}{tail}(?: only)?"))
                out.append((4, f"{label}-or-later", short, rf"(?:gnu )?{short} ?{_V}{v}{tail} or later"))
    kinds = (("by", "attribution"), ("by sa", "attribution share ?alike"), ("by nc", "attribution non ?commercial"), ("by nd", "attribution no ?deriv(?:ative)?s"),
             ("by nc sa", "attribution non ?commercial share ?alike"), ("by nc nd", "attribution non ?commercial no ?deriv(?:ative)?s"))
    for short, name in kinds:
        label = "cc-" + short.replace(" ", "-")
        out.append((3, label, "cc " + short, rf"cc {short}"))
        out.append((3, label, "creative commons", rf"creative commons {name}"))
        out.append((4, label, "licenses " + short, rf"creativecommons org licenses {short}"))
        for v in ("1 0", "2 0", "2 5", "3 0", "4 0"):
            out.append((4, f"{label}-{v.replace(' ', '.')}", "cc " + short, rf"cc {short} {v}(?: international| unported)?"))
            out.append((4, f"{label}-{v.replace(' ', '.')}", "creative commons", rf"creative commons {name} {v}(?: international| unported)?(?: license| licence)?"))
    return out


def _blanks(x: Column) -> Column:
    return F.length(x) - F.length(F.replace(x, F.lit(" "), F.lit("")))


def word_places(words: Column, pattern: Column) -> Column:
    """array<struct<start long, end long>> of a pattern's matches at word borders, in words, end exclusive."""
    whole = F.concat(F.lit("(?<![^ ])(?:"), pattern, F.lit(")(?![^ ])"))

    def place(m: Column) -> Column:
        steps = let(F.split(words, whole, -1), lambda g: F.transform(m, lambda x, i: (_blanks(F.element_at(g, i + 1)) + F.when(i > 0, _blanks(F.element_at(m, F.greatest(i, F.lit(1))))).otherwise(0)).cast("long")))
        return let(running_sum(steps), lambda at: F.transform(m, lambda x, i: F.struct(F.element_at(at, i + 1).alias("start"), (F.element_at(at, i + 1) + _blanks(x) + 1).alias("end"))))

    empty = F.array().cast("array<struct<start:bigint,end:bigint>>")
    return let(F.regexp_extract_all(words, whole, F.lit(0)), lambda m: F.when(F.size(m) == 0, empty).otherwise(place(m)))


def detect(docs: DataFrame) -> DataFrame:
    """``docs`` (doc_id, text) as doc_id, n_words, base (label, start, end), detections, labels left and score."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    out = docs.select("doc_id", F.trim(F.regexp_replace(F.translate(text, UPPER, LOWER), SEPARATORS, " ")).alias("words"))
    size = F.when(F.col("words") == "", 0).otherwise(_blanks(F.col("words")) + 1).cast("long")

    groups: dict[str, list] = {}
    for no, (priority, label, keyword, pattern) in enumerate(rules()):
        groups.setdefault(keyword, []).append((priority, no, label, pattern))
    quote = lambda s: "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"
    table = F.expr("array(" + ",".join(
        f"named_struct('keyword',{quote(k)},'rules',array(" + ",".join(f"named_struct('priority',{p},'no',{no},'label',{quote(lab)},'pattern',{quote(r)})" for p, no, lab, r in g) + "))"
        for k, g in groups.items()) + ")")

    def phrase(words: str, label: str) -> Column:
        named = lambda s: F.struct(F.lit(label).alias("label"), s["start"].alias("start"), s["end"].alias("end"))
        places = F.transform(word_places(F.col("words"), F.lit(words)), named)
        return F.when(F.col("words").contains(words), places).otherwise(F.array().cast("array<struct<label:string,start:bigint,end:bigint>>"))

    base = F.concat(*[phrase(p, label) for p, label in BASE])
    tried = F.flatten(F.transform(F.filter(table, lambda g: F.col("words").contains(g["keyword"])), lambda g: g["rules"]))
    hits = F.flatten(F.transform(tried, lambda r: F.transform(word_places(F.col("words"), r["pattern"]), lambda s: F.struct(
        s["start"].alias("start"), (-s["end"]).alias("neg_end"), (-r["priority"]).alias("neg_priority"), r["no"].alias("no"), r["label"].alias("label")))))
    out = out.select("doc_id", size.alias("n_words"), base.alias("base"), F.array_sort(hits).alias("detections"))

    reach = F.array_repeat(F.lit(-1).cast("long"), 5)
    start = F.struct(reach.alias("reach"), F.array().cast("array<string>").alias("labels"), F.lit(0).alias("top"))

    def step(a: Column, d: Column) -> Column:
        priority, end = -d["neg_priority"], -d["neg_end"]
        inside = F.exists(F.slice(a["reach"], priority, 6 - priority), lambda e: e >= end)
        return F.when(inside, a).otherwise(F.struct(
            F.transform(a["reach"], lambda e, i: F.when(i + 1 == priority, F.greatest(e, end)).otherwise(e)).alias("reach"),
            F.array_union(a["labels"], F.array(d["label"])).alias("labels"), F.greatest(a["top"], priority).alias("top")))

    score = F.element_at(F.array(F.lit(0.0), *[F.lit(SCORES[p]) for p in range(1, 6)]), F.col("left.top") + 1)
    out = out.withColumn("left", F.aggregate("detections", start, step))
    return out.select("doc_id", "n_words", "base", "detections", F.col("left.labels").alias("method_labels"), F.greatest(score, F.when(F.size("base") > 0, 0.5).otherwise(0.0)).alias("score"))


def license_digest(found: DataFrame) -> DataFrame:
    own = F.transform("base", lambda b: b["label"])
    starts = F.transform("base", lambda b: b["start"])
    return found.select("doc_id", "n_words", F.size("base").cast("long").alias("n_base"), F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
                        F.concat_ws(",", F.array_sort(F.array_distinct(own))).alias("base_labels"),
                        F.concat_ws(",", F.array_sort(F.array_distinct(F.concat(own, "method_labels")))).alias("labels"), "score")
