"""License scans by ordered signature rules.

Texts become lower-case words with one space around each.  A rule is a regular expression over such words with a literal
keyword that each of its matches holds: only rules whose keyword occurs in a text are tried on it.  A match is an interval
of words.  An interval that lies within another one of the same or a stronger kind is suppressed, so a long name
beats the shorter names inside it and a notice beats the name it quotes.  Rules are ordered: of equal intervals of one kind the earlier
rule's stays.

DataFrame functions only.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import stored, table

#: What separates words once A-Z are lower case.
NO_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Phrases of the base scan with their labels.
BASE = (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))
#: Kinds of rules, the strongest first, and how sure a match of the kind is.
KINDS = {"tag": 1.0, "text": 0.95, "notice": 0.9, "address": 0.85, "title": 0.8}
BASE_SCORE = 0.9

#: Label, keyword, name in words, short identifier in words ("" where there is none).
NAMES = (
    ("0bsd", "bsd", "(?:zero clause bsd|bsd zero clause)(?: license)?", "0bsd"),
    ("afl-3", "academic", "academic free license(?: version| v)? 3(?: 0)?", "afl 3 0"),
    ("agpl-3", "affero", "(?:gnu )?affero general public license(?: version| v)? 3(?: 0)?", "agpl 3 0(?: only| or later)?"),
    ("agpl", "affero", "(?:gnu )?affero general public license", ""),
    ("apache-1", "apache", "apache (?:software )?license(?: version| v)? 1(?: [01])?", "apache 1 [01]"),
    ("apache-2", "apache", "apache (?:software )?license(?: version| v)? 2(?: 0)?", "apache 2 0"),
    ("apache", "apache", "apache (?:software )?license", ""),
    ("apsl-2", "apple", "apple public source license(?: version| v)? 2(?: 0)?", "apsl 2 0"),
    ("artistic-1", "artistic", "artistic license(?: version| v)? 1(?: 0)?", "artistic 1 0"),
    ("artistic-2", "artistic", "artistic license(?: version| v)? 2(?: 0)?", "artistic 2 0"),
    ("artistic", "artistic", "(?:perl )?artistic license", ""),
    ("bsd-2", "bsd", "(?:(?:2|two) clause bsd license|bsd (?:2|two) clause(?: license)?|simplified bsd license)", "bsd 2 clause"),
    ("bsd-2", "freebsd", "freebsd license", ""),
    ("bsd-3", "bsd", "(?:(?:3|three) clause bsd license|bsd (?:3|three) clause(?: license)?|(?:new|modified|revised) bsd license)", "bsd 3 clause"),
    ("bsd-4", "bsd", "(?:(?:4|four) clause bsd license|bsd (?:4|four) clause(?: license)?|original bsd license)", "bsd 4 clause"),
    ("bsd", "bsd", "(?:berkeley )?bsd (?:style )?license", ""),
    ("boost-1", "boost", "boost software license(?: version| v)?(?: 1(?: 0)?)?", "bsl 1 0"),
    ("business-source", "business", "business source license(?: version| v)?(?: 1 1)?", "busl 1 1"),
    ("cc0", "cc0", "cc0(?: 1 0)?(?: universal)?(?: public domain dedication)?", "cc0 1 0"),
    ("cc0", "zero", "creative commons zero(?: v1 0| 1 0)?(?: universal)?", ""),
    ("cc-by", "creative", "creative commons attribution(?: [1234] 0)?(?: international| unported| generic)? license", "cc by [1234] [05]"),
    ("cc-by-sa", "creative", "creative commons attribution share ?alike(?: [1234] 0)?(?: international| unported| generic)? license", "cc by sa [1234] [05]"),
    ("cc-by-nd", "creative", "creative commons attribution no ?deriv(?:ative|ative works|atives|s)(?: [1234] 0)?(?: international| unported)? license", "cc by nd [1234] [05]"),
    ("cc-by-nc", "creative", "creative commons attribution non ?commercial(?: [1234] 0)?(?: international| unported| generic)? license", "cc by nc [1234] [05]"),
    ("cc-by-nc-sa", "creative", "creative commons attribution non ?commercial share ?alike(?: [1234] 0)?(?: international| unported| generic)? license", "cc by nc sa [1234] [05]"),
    ("cc-by-nc-nd", "creative", "creative commons attribution non ?commercial no ?deriv(?:atives|ative works|s)(?: [1234] 0)?(?: international| unported)? license", "cc by nc nd [1234] [05]"),
    ("cddl-1", "distribution", "common development and distribution license(?: version| v)?(?: 1 [01])?", "cddl 1 [01]"),
    ("cecill-2", "cecill", "cecill(?: free software)? license(?: agreement)?(?: version| v)?(?: 2 [01])?", "cecill 2 [01]"),
    ("cpal-1", "attribution", "common public attribution license(?: version| v)?(?: 1 0)?", "cpal 1 0"),
    ("cpl-1", "common", "common public license(?: version| v)?(?: 1 0)?", "cpl 1 0"),
    ("ecl-2", "community", "educational community license(?: version| v)?(?: 2 0)?", "ecl 2 0"),
    ("elastic-2", "elastic", "elastic license(?: version| v)?(?: 2 0| 2)?", "elastic 2 0"),
    ("epl-1", "eclipse", "eclipse public license(?: version| v)? 1(?: 0)?", "epl 1 0"),
    ("epl-2", "eclipse", "eclipse public license(?: version| v)? 2(?: 0)?", "epl 2 0"),
    ("epl", "eclipse", "eclipse public license", ""),
    ("eupl-1", "european", "european union public licen[cs]e(?: version| v)?(?: 1 [012])?", "eupl 1 [012]"),
    ("gfdl", "documentation", "(?:gnu )?free documentation license(?: version| v)?(?: 1 [123])?", "gfdl 1 [123](?: only| or later)?"),
    ("gpl-1", "general", "(?:gnu )?general public license(?: version| v)? 1(?: 0)?", "gpl 1 0(?: only| or later)?"),
    ("gpl-2", "general", "(?:gnu )?general public license(?: version| v)? 2(?: 0)?", "gpl 2 0(?: only| or later)?"),
    ("gpl-3", "general", "(?:gnu )?general public license(?: version| v)? 3(?: 0)?", "gpl 3 0(?: only| or later)?"),
    ("gpl", "general", "(?:gnu )?general public license", ""),
    ("hpnd", "historical", "historical permission notice and disclaimer", "hpnd"),
    ("ibm-pl-1", "ibm", "ibm public license(?: version| v)?(?: 1 0)?", "ipl 1 0"),
    ("intel", "intel", "intel open source license", "intel"),
    ("isc", "isc", "isc license", "isc"),
    ("isc", "consortium", "internet systems consortium license", ""),
    ("lgpl-2", "lesser", "(?:gnu )?lesser general public license(?: version| v)? 2(?: [01])?", "lgpl 2 [01](?: only| or later)?"),
    ("lgpl-2", "library", "(?:gnu )?library general public license(?: version| v)?(?: 2(?: 0)?)?", ""),
    ("lgpl-3", "lesser", "(?:gnu )?lesser general public license(?: version| v)? 3(?: 0)?", "lgpl 3 0(?: only| or later)?"),
    ("lgpl", "lesser", "(?:gnu )?lesser general public license", ""),
    ("libpng", "libpng", "(?:zlib )?libpng license(?: version| v)?(?: 2)?", "libpng 2 0"),
    ("lppl-1", "latex", "latex project public license(?: version| v)?(?: 1 [123])?", "lppl 1 [0123]c?"),
    ("mit-0", "attribution", "mit no attribution(?: license)?", "mit 0"),
    ("mit", "mit", "mit license", "mit"),
    ("mit", "expat", "expat license", ""),
    ("x11", "x11", "x11 license", ""),
    ("mpl-1", "mozilla", "mozilla public license(?: version| v)? 1(?: [01])?", "mpl 1 [01]"),
    ("mpl-2", "mozilla", "mozilla public license(?: version| v)? 2(?: 0)?", "mpl 2 0"),
    ("mpl", "mozilla", "mozilla public license", ""),
    ("ms-pl", "microsoft", "microsoft public license", "ms pl"),
    ("ms-rl", "microsoft", "microsoft reciprocal license", "ms rl"),
    ("mulan-2", "mulan", "mulan permissive software license(?: version| v)?(?: 2)?", "mulanpsl 2 0"),
    ("ncsa", "illinois", "university of illinois ncsa open source license", "ncsa"),
    ("netscape-1", "netscape", "netscape public license(?: version| v)?(?: 1 [01])?", "npl 1 [01]"),
    ("odbl-1", "odc", "odc open database license(?: version| v)?(?: 1 0)?", "odbl 1 0"),
    ("odbl-1", "database", "open database license(?: version| v)?(?: 1 0)?", ""),
    ("odc-by-1", "open", "open data commons attribution license(?: version| v)?(?: 1 0)?", "odc by 1 0"),
    ("ofl-1", "font", "(?:sil )?open font license(?: version| v)?(?: 1 [01])?", "ofl 1 [01]"),
    ("openldap-2", "openldap", "openldap public license(?: version| v)?(?: 2 8)?", "oldap 2 [0-8]"),
    ("openssl", "openssl", "openssl license", "openssl"),
    ("osl-3", "open", "open software license(?: version| v)?(?: 3(?: 0)?)?", "osl 3 0"),
    ("pddl-1", "dedication", "public domain dedication and license(?: version| v)?(?: 1 0)?", "pddl 1 0"),
    ("php-3", "php", "php license(?: version| v)?(?: 3(?: 0)?1?)?", "php 3 01?"),
    ("postgresql", "postgresql", "postgresql license", "postgresql"),
    ("psf-2", "python", "python software foundation license(?: version| v)?(?: 2)?", "(?:psf|python) 2 0"),
    ("qpl-1", "q", "q public license(?: version| v)?(?: 1 0)?", "qpl 1 0"),
    ("ruby", "ruby", "ruby license", "ruby"),
    ("sleepycat", "sleepycat", "sleepycat license", "sleepycat"),
    ("sspl-1", "server", "server side public license(?: version| v)?(?: 1)?", "sspl 1 0"),
    ("unicode", "unicode", "unicode license(?: agreement)?(?: v3)?", "unicode 3 0"),
    ("unlicense", "unlicense", "(?:the )?unlicense license", "unlicense"),
    ("upl-1", "permissive", "universal permissive license(?: version| v)?(?: 1 0)?", "upl 1 0"),
    ("vim", "vim", "vim license", "vim"),
    ("w3c", "w3c", "w3c software (?:notice and|and document) license", "w3c"),
    ("wtfpl", "want", "do what the fuck you want to public license(?: version| v)?(?: 2)?", "wtfpl"),
    ("x11", "x", "x consortium license", "x11"),
    ("zlib", "zlib", "zlib license", "zlib"),
    ("zpl-2", "zope", "zope public license(?: version| v)?(?: 2 [01])?", "zpl 2 [01]"),
)

#: Label, keyword, words of addresses where licenses are kept.
ADDRESSES = (
    ("apache-2", "apache", "apache org licenses license 2 0"), ("mit", "mit", "opensource org licenses? mit"), ("bsd-3", "bsd", "opensource org licenses? bsd 3 clause"),
    ("bsd-2", "bsd", "opensource org licenses? bsd 2 clause"), ("gpl-2", "gpl", "gnu org licenses (?:old licenses )?gpl 2 0"), ("gpl-3", "gpl", "gnu org licenses gpl 3 0"),
    ("gpl", "gpl", "gnu org licenses gpl"), ("lgpl-2", "lgpl", "gnu org licenses (?:old licenses )?lgpl 2 [01]"), ("lgpl-3", "lgpl", "gnu org licenses lgpl 3 0"),
    ("agpl-3", "agpl", "gnu org licenses agpl 3 0"), ("gfdl", "fdl", "gnu org licenses fdl(?: 1 [123])?"), ("mpl-2", "mozilla", "mozilla org mpl 2 0"),
    ("epl-2", "eclipse", "eclipse org legal epl 2 0"), ("epl-1", "eclipse", "eclipse org legal epl v10"), ("boost-1", "boost", "boost org license 1 0"),
    ("cc0", "creativecommons", "creativecommons org publicdomain zero 1 0"), ("cc-by", "creativecommons", "creativecommons org licenses by [1234] [05]"),
    ("cc-by-sa", "creativecommons", "creativecommons org licenses by sa [1234] [05]"), ("cc-by-nc", "creativecommons", "creativecommons org licenses by nc [1234] [05]"),
    ("cc-by-nd", "creativecommons", "creativecommons org licenses by nd [1234] [05]"), ("cc-by-nc-sa", "creativecommons", "creativecommons org licenses by nc sa [1234] [05]"),
    ("cc-by-nc-nd", "creativecommons", "creativecommons org licenses by nc nd [1234] [05]"), ("unlicense", "unlicense", "unlicense org"), ("wtfpl", "wtfpl", "wtfpl net"),
    ("ofl-1", "ofl", "scripts sil org ofl"), ("odbl-1", "odbl", "opendatacommons org licenses odbl"), ("isc", "isc", "opensource org licenses? isc"),
)

#: Label, keyword, words that open or mark the text of a license.
TEXTS = (
    ("mit", "hereby", "permission is hereby granted free of charge to any person obtaining a copy of this software"),
    ("bsd", "redistribution", "redistribution and use in source and binary forms with or without modification are permitted"),
    ("bsd-3", "endorse", "may be used to endorse or promote products derived from this software without specific prior written permission"),
    ("bsd-4", "advertising", "all advertising materials mentioning features or use of this software must display the following acknowledge?ment"),
    ("isc", "fee", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("unlicense", "unencumbered", "this is free and unencumbered software released into the public domain"),
    ("zlib", "altered", "altered source versions must be plainly marked as such and must not be misrepresented"),
    ("gpl", "redistribute", "you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("lgpl", "redistribute", "you can redistribute it and or modify it under the terms of the gnu lesser general public license"),
    ("agpl", "redistribute", "you can redistribute it and or modify it under the terms of the gnu affero general public license"),
    ("mpl-2", "mpl", "if a copy of the mpl was not distributed with this file you can obtain one at"),
    ("apache-2", "apache", "you may not use this file except in compliance with the license you may obtain a copy of the license at (?:http|https) www apache org"),
    ("boost-1", "boost", "distributed under the boost software license version 1 0"),
    ("beerware", "beer", "you can buy me a beer in return"), ("json", "evil", "the software shall be used for good not evil"),
    ("ofl-1", "font", "this font software is licensed under the sil open font license"),
    ("public-domain", "domain", "(?:is|are) (?:hereby )?(?:placed|released|dedicated) (?:in|into|to) the public domain"),
    ("proprietary", "proprietary", "(?:confidential and proprietary|proprietary and confidential)"), ("proprietary", "prohibited", "unauthorized (?:copying|reproduction|use)(?: of this [a-z]+)?[a-z ]{0,40} is strictly prohibited"),
    ("cc-by-sa", "contributions", "you must distribute your contributions under the same license as the original"),
)


def rules() -> list[tuple[int, str, str, str, str]]:
    """(order, kind, label, keyword, pattern) of all rules, the strongest kinds first.

    Names give a title rule, a notice rule ("licensed under the terms of ..."), and, where they have a short
    identifier, a tag rule; creative commons identifiers also stand alone.
    """
    verb = "(?:licensed|released|distributed|available|provided|published|covered|redistributed|shared) under (?:the )?(?:terms of (?:the )?)?"
    out = [("tag", label, "spdx", f"spdx license identifier {short}") for label, _, _, short in NAMES if short]
    out += [("text", *x) for x in TEXTS]
    out += [("notice", label, key, f"{verb}{name}") for label, key, name, _ in NAMES]
    out += [("notice", label, short.split(" ")[0], f"{verb}{short}(?: license)?") for label, _, _, short in NAMES if re.fullmatch(r"[a-z0-9]+( .*)?", short)]
    out += [("address", *x) for x in ADDRESSES]
    out += [("title", label, key, name) for label, key, name, _ in NAMES]
    out += [("title", label, "cc", short) for label, _, _, short in NAMES if short.startswith("cc ")]
    return [(i, kind, label, f" {key} ", f"(?<= ){pattern}(?= )") for i, (kind, label, key, pattern) in enumerate(out)]


#: A text without any of these holds no match of any rule.
GATES = (" licen", " unlicense ", " under ", " spdx ", " cc ", " cc0 ", " creative ", " bsd ", " mit ", " permission ", " software ", " org ", " wtfpl ", " beer ",
         " domain ", " redistribut", " proprietary ", " prohibited ", " versions ", " mpl ")


def spaces(x: Column) -> Column:
    return F.length(x) - F.length(F.replace(x, F.lit(" "), F.lit("")))


def normal(text: Column) -> Column:
    """The words in lower case with one space before, between and after; one space for a text without words.

    The only characters beyond A-Z that become a-z are the signs for kelvin and I with a dot.
    """
    words = F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), NO_WORD, " "))
    return F.when(words == "", F.lit(" ")).otherwise(F.concat(F.lit(" "), words, F.lit(" ")))


def matches(rows: DataFrame) -> DataFrame:
    """(row, rule, kind, label, start, end) of every match in rows (row, norm); words from start to end - 1.

    A text is cut at a rule's matches.  The spaces of the pieces and of the matches before a match give its place.
    """
    listed = [F.struct(F.lit(i).alias("rule"), F.lit(list(KINDS).index(kind)).alias("kind"), F.lit(label).alias("label"), F.lit(key).alias("keyword"),
                       F.lit(pattern).alias("pattern")) for i, kind, label, key, pattern in rules()]
    tried = F.filter(F.array(*listed), lambda r: F.contains(F.col("norm"), r["keyword"]))
    tried = rows.select("row", "norm", F.inline(tried))
    found = F.regexp_extract_all("norm", F.col("pattern"), F.lit(0))
    pieces = F.split("norm", F.col("pattern"), -1)
    held = tried.filter(F.expr("regexp_like(norm, pattern)")).select("row", "rule", "kind", "label", F.posexplode(F.zip_with(
        F.slice(pieces, F.lit(1), F.size(found)), found, lambda piece, hit: F.struct(spaces(piece).alias("gap"), spaces(hit).alias("inner")))).alias("j", "x"))
    upto = Window.partitionBy("row", "rule").orderBy("j").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    start = (F.sum(F.col("x.gap") + F.col("x.inner")).over(upto) - F.col("x.inner") - 1).cast("long")
    return held.select("row", "rule", "kind", "label", start.alias("start"), (start + F.col("x.inner") + 1).alias("end"))


def detections(found: DataFrame) -> DataFrame:
    """The matches that are not within another one of the same or a stronger kind.

    Ordered by start, longer first, then kind and rule, a match's containers come before it, so the farthest
    end so far for each kind decides.  One window over the matches of a text.
    """
    order = Window.partitionBy("row").orderBy("start", F.col("end").desc(), "kind", "rule").rowsBetween(Window.unboundedPreceding, -1)
    far = [F.max(F.when(F.col("kind") <= k, F.col("end"))).over(order) for k in range(len(KINDS))]
    marked = found.withColumn("far", F.element_at(F.array(*far), F.col("kind") + 1))
    return marked.filter(F.coalesce(F.col("far") < F.col("end"), F.lit(True))).drop("far")


def base_scan(norm: Column) -> dict[str, Column]:
    """n_base, first_word, last_word and base_labels of the base phrases; all places count, whatever the rules find."""
    n, first, last, labels = F.lit(0), [], [], []
    for phrase, label in BASE:
        held = F.contains(norm, F.lit(f" {phrase} "))
        n = n + F.when(held, F.regexp_count(norm, F.lit(f"(?<= ){phrase}(?= )"))).otherwise(0)
        first.append(F.when(held, spaces(F.substring_index(norm, f" {phrase} ", 1))))
        last.append(F.when(held, spaces(norm) - 1 - spaces(F.substring_index(norm, f" {phrase} ", -1)) - len(phrase.split())))
        labels.append(F.when(held, F.lit(label)))
    return {"n_base": n.cast("long"), "first_word": F.least(*first).cast("long"), "last_word": F.greatest(*last).cast("long"),
            "base_labels": F.array_sort(F.array_compact(F.array(*labels)))}


def scan(docs: DataFrame) -> DataFrame:
    """One row for each row of docs (doc_id, text): words, base places and labels, all labels, and a score.

    * Null and empty texts have no words and no labels; their places are null and their score is 0.
    * labels: those of the base phrases and of the detections that stay, distinct, sorted, comma-joined.
    * score: how sure the strongest kind of the text's detections is (base phrases: 0.9), 0 without any.
    * Repeated rows and ids each keep their row.  Whole texts are read; an empty table gives no rows.
    """
    norm = F.col("norm")
    rows = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", normal(F.col("text")).alias("norm"))
    gated = F.lit(False)
    for gate in GATES:
        gated = gated | F.contains(norm, F.lit(gate))
    base = base_scan(norm)
    slim = stored(rows.select("row", "doc_id", (spaces(norm) - 1).cast("long").alias("n_words"), *(c.alias(x) for x, c in base.items()),
                              F.when(gated, norm).alias("norm")), "license-rows")
    kept = detections(matches(slim.filter("norm IS NOT NULL").select("row", "norm")))
    sure = F.element_at(F.array(*(F.lit(x) for x in KINDS.values())), F.col("kind") + 1)
    per = kept.groupBy("row").agg(F.collect_set("label").alias("found"), F.max(sure).alias("sure"))
    out = slim.drop("norm").join(per, "row", "left")
    none = F.array().cast("array<string>")
    labels = F.array_sort(F.array_union("base_labels", F.coalesce("found", none)))
    score = F.greatest(F.coalesce("sure", F.lit(0.0)), F.when(F.col("n_base") > 0, BASE_SCORE).otherwise(0.0))
    return out.select("doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join("base_labels", ",").alias("base_labels"),
                      F.array_join(labels, ",").alias("labels"), score.alias("score"))


def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))
