"""License scan by ordered signature rules, in DataFrame functions only.

A text is read as words. A cheap test for a few stems passes the small part of
the texts that can hold a rule's keyword; in those, every occurrence of a
keyword takes along REACH words on either side and meets only the rules gated by
that keyword. A rule is a regular expression over words with its keyword marked,
so each occurrence gives one detection of a rule at most. Detections that lie
within a detection of higher priority (or of the same priority and greater
length, or the same place and an earlier rule) are suppressed: in the order of
their beginnings, longest first, a detection falls if one before it, of its own
priority or a higher one, ends no earlier. So a running maximum of ends for each
priority decides, in one sorted pass over a text's detections.
"""

from __future__ import annotations

import re
import string

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import common

MARK = "\u0001"

#: Phrases that are always reported, and their labels: fixed values.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

#: Label, keyword, and the license's name as a regular expression over words in
#: lower case. The keyword stands once in the expression.
NAMES = [
    ("apache-2.0", "apache", r"apache (?:software )?(?:license )?(?:version |v ?)?2(?: 0)?"),
    ("apache-1.1", "apache", r"apache (?:software )?(?:license )?(?:version |v ?)?1 1"),
    ("apache-1.0", "apache", r"apache (?:software )?(?:license )?(?:version |v ?)?1 0"),
    ("mit", "mit", r"mit"),
    ("mit-0", "attribution", r"mit no attribution"),
    ("x11", "x11", r"x11"),
    ("bsd-2-clause", "bsd", r"(?:2 clause |two clause |simplified |freebsd )bsd|bsd (?:2|two) clause"),
    ("bsd-3-clause", "bsd", r"(?:3 clause |three clause |new |modified |revised )bsd|bsd (?:3|three) clause"),
    ("bsd-4-clause", "bsd", r"(?:4 clause |four clause |original )bsd|bsd (?:4|four) clause"),
    ("0bsd", "0bsd", r"0bsd"),
    ("isc", "isc", r"isc"),
    ("zlib", "zlib", r"zlib(?: libpng)?"),
    ("gpl-1.0", "gpl", r"gpl ?(?:version |v ?)?1(?: 0)?"),
    ("gpl-2.0", "gpl", r"gpl (?:version |v ?)?2(?: 0)?"),
    ("gpl-2.0", "gplv2", r"gplv2"),
    ("gpl-2.0", "public", r"(?:gnu )?general public license (?:version |v ?)?2(?: 0)?"),
    ("gpl-3.0", "gpl", r"gpl (?:version |v ?)?3(?: 0)?"),
    ("gpl-3.0", "gplv3", r"gplv3"),
    ("gpl-3.0", "public", r"(?:gnu )?general public license (?:version |v ?)?3(?: 0)?"),
    ("lgpl-2.0", "library", r"(?:gnu )?library general public license(?: version 2)?"),
    ("lgpl-2.1", "lgpl", r"lgpl (?:version |v ?)?2(?: 1)?"),
    ("lgpl-2.1", "lesser", r"(?:gnu )?lesser general public license (?:version |v ?)?2 1"),
    ("lgpl-3.0", "lgpl", r"lgpl (?:version |v ?)?3(?: 0)?"),
    ("lgpl-3.0", "lesser", r"(?:gnu )?lesser general public license (?:version |v ?)?3(?: 0)?"),
    ("agpl-3.0", "agpl", r"agpl (?:version |v ?)?3(?: 0)?"),
    ("agpl-3.0", "affero", r"(?:gnu )?affero general public license(?: (?:version |v ?)?3(?: 0)?)?"),
    ("mpl-1.1", "mozilla", r"mozilla public license (?:version |v ?)?1 1"),
    ("mpl-2.0", "mozilla", r"mozilla public license(?: (?:version |v ?)?2(?: 0)?)?"),
    ("mpl-2.0", "mpl", r"mpl (?:version |v ?)?2(?: 0)?"),
    ("epl-1.0", "eclipse", r"eclipse public license (?:version |v ?)?1(?: 0)?"),
    ("epl-2.0", "eclipse", r"eclipse public license(?: (?:version |v ?)?2(?: 0)?)?"),
    ("edl-1.0", "eclipse", r"eclipse distribution license(?: (?:version |v ?)?1(?: 0)?)?"),
    ("cddl-1.0", "cddl", r"cddl(?: (?:version |v ?)?1(?: 0)?)?"),
    ("cddl-1.0", "development", r"common development and distribution license"),
    ("cpl-1.0", "common", r"common public license(?: (?:version |v ?)?1(?: 0)?)?"),
    ("cpal-1.0", "attribution", r"common public attribution license"),
    ("eupl-1.1", "eupl", r"eupl (?:version |v ?)?1 1"),
    ("eupl-1.2", "eupl", r"eupl(?: (?:version |v ?)?1 2)?"),
    ("eupl-1.2", "union", r"european union public licen[cs]e"),
    ("osl-3.0", "open", r"open software license(?: (?:version |v ?)?3(?: 0)?)?"),
    ("afl-3.0", "academic", r"academic free license(?: (?:version |v ?)?3(?: 0)?)?"),
    ("artistic-1.0", "artistic", r"artistic license (?:version )?1(?: 0)?"),
    ("artistic-2.0", "artistic", r"artistic license(?: (?:version )?2(?: 0)?)?"),
    ("bsl-1.0", "boost", r"boost software license(?: (?:version )?1(?: 0)?)?"),
    ("unlicense", "unlicense", r"unlicense"),
    ("wtfpl", "wtfpl", r"wtfpl"),
    ("cc0-1.0", "cc0", r"cc0(?: 1 0)?"),
    ("cc-by-3.0", "cc", r"cc by 3(?: 0)?"),
    ("cc-by-4.0", "cc", r"cc by 4(?: 0)?"),
    ("cc-by-sa-3.0", "cc", r"cc by sa 3(?: 0)?"),
    ("cc-by-sa-4.0", "cc", r"cc by sa 4(?: 0)?"),
    ("cc-by-nc-3.0", "cc", r"cc by nc 3(?: 0)?"),
    ("cc-by-nc-4.0", "cc", r"cc by nc 4(?: 0)?"),
    ("cc-by-nd-4.0", "cc", r"cc by nd 4(?: 0)?"),
    ("cc-by-nc-sa-4.0", "cc", r"cc by nc sa 4(?: 0)?"),
    ("cc-by-nc-nd-4.0", "cc", r"cc by nc nd 4(?: 0)?"),
    ("cc-by", "commons", r"creative commons attribution"),
    ("cc-by-sa", "commons", r"creative commons attribution share ?alike"),
    ("cc-by-nc", "commons", r"creative commons attribution non ?commercial"),
    ("odbl-1.0", "odbl", r"odbl(?: 1 0)?"),
    ("odbl-1.0", "database", r"open (?:data commons open )?database license"),
    ("odc-by-1.0", "commons", r"open data commons attribution"),
    ("ofl-1.1", "font", r"(?:sil )?open font license(?: (?:version )?1 1)?"),
    ("ms-pl", "microsoft", r"microsoft public license"),
    ("ms-rl", "microsoft", r"microsoft reciprocal license"),
    ("postgresql", "postgresql", r"postgresql"),
    ("psf-2.0", "python", r"python software foundation(?: license)?(?: (?:version )?2)?"),
    ("ruby", "ruby", r"ruby"),
    ("php-3.01", "php", r"php license(?: (?:version )?3 0?1)?"),
    ("openssl", "openssl", r"openssl"),
    ("ncsa", "ncsa", r"(?:uiuc )?ncsa(?: open source)?"),
    ("ecl-2.0", "educational", r"educational community license"),
    ("upl-1.0", "universal", r"universal permissive license"),
    ("gfdl-1.3", "documentation", r"(?:gnu )?free documentation license(?: (?:version )?1 3)?"),
    ("sspl-1.0", "sspl", r"sspl"),
    ("sspl-1.0", "server", r"server side public license"),
    ("busl-1.1", "business", r"business source license(?: 1 1)?"),
    ("elastic-2.0", "elastic", r"elastic license(?: 2(?: 0)?)?"),
    ("lppl-1.3c", "latex", r"latex project public license"),
    ("mulan-2.0", "mulan", r"mulan (?:psl|permissive software license)"),
    ("cecill-2.1", "cecill", r"cecill(?: (?:version )?2 1)?"),
    ("w3c", "w3c", r"w3c software(?: notice)?"),
    ("unicode", "unicode", r"unicode (?:inc )?license agreement"),
    ("vim", "vim", r"vim"),
    ("public-domain", "domain", r"public domain"),
]

#: How a name is used: priority and expression; {} is the name.
FRAMES = [
    (90, r"(?:licensed|released|distributed|published|available|provided|offered|covered|governed|redistributed|licenced) (?:only |solely |exclusively )?(?:under|by) (?:the )?(?:terms (?:and conditions )?of )?(?:the |an |a )?(?:gnu )?(?:{})(?: licen[cs]e)?"),
    (70, r"(?:{}) licen[cs]e[ds]?"),
    (60, r"(?:see|under|per|by|subject to|terms of|according to) (?:the |a |an )?(?:{}) licen[cs]e"),
    (50, r"licen[cs]e (?:is |type |name )?(?:{})"),
]

#: Wording that stands for itself: label, keyword, priority, expression.
WORDING = [
    ("mit", "granted", 95, r"permission is hereby granted free of charge to any person obtaining a copy"),
    ("mit", "included", 85, r"the above copyright notice and this permission notice shall be included"),
    ("isc", "granted", 95, r"permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("bsd", "redistribution", 95, r"redistribution and use in source and binary forms with or without modification are permitted"),
    ("bsd-3-clause", "endorse", 92, r"endorse or promote products derived from this software"),
    ("gpl", "redistribute", 95, r"this program is free software you can redistribute it and or modify it"),
    ("lgpl", "redistribute", 96, r"this library is free software you can redistribute it and or modify it"),
    ("apache-2.0", "compliance", 95, r"you may not use this file except in compliance with the license"),
    ("mpl-2.0", "source", 95, r"this source code form is subject to the terms of the mozilla public license"),
    ("unlicense", "unencumbered", 95, r"this is free and unencumbered software released into the public domain"),
    ("zlib", "misrepresented", 95, r"the origin of this software must not be misrepresented"),
    ("public-domain", "dedicated", 80, r"dedicated to the public domain"),
    ("copyright", "copyright", 30, r"copyright (?:c )?(?:19|20)[0-9]{2}"),
    ("copyright", "copyright", 20, r"copyright (?:c )?by"),
    ("proprietary", "proprietary", 60, r"(?:proprietary and confidential|confidential and proprietary)"),
    ("proprietary", "unauthorized", 60, r"unauthorized (?:copying|use|reproduction|distribution) of this software"),
    ("no-commercial", "commercial", 60, r"(?:not for|no|non) commercial (?:use|purposes)"),
    ("eula", "end", 60, r"end user license agreement"),
    ("warranty", "warranty", 20, r"(?:this|the) software is provided as is without (?:any )?warranty of any kind"),
]

#: Every match of a rule holds one of these, and so does every base phrase but "cc by".
STEMS = ("licen", "spdx", "copyright", "reserved", "permission", "distribut", "software", "proprietary", "commercial", "domain", "published", "available", "provided", "offered", "covered", "governed", "released")
_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_ANY_CASE_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def rules() -> list[tuple[int, str, str, int, str]]:
    """(number, label, keyword, priority, expression with the keyword marked), in order."""
    found = []
    for label, keyword, name in NAMES:
        found += [(label, keyword, priority, frame.replace("{}", name)) for priority, frame in FRAMES]
    for label in dict.fromkeys(label for label, _, _ in NAMES):
        spoken = re.sub(r"[^a-z0-9]+", " ", label)
        found.append((label, "spdx", 100, rf"spdx license identifier {spoken}(?: only| or later)?"))
    found += WORDING
    return [(i, label, keyword, priority, rf"(?<![^ ])(?:{re.sub(rf'(?<![a-z0-9]){keyword}(?![a-z0-9])', MARK + keyword, expression)})(?![^ ])") for i, (label, keyword, priority, expression) in enumerate(found)]


def _reach() -> int:
    """Words on either side of a keyword that a rule may reach: no more than it has spaces there."""
    sides = [part for *_, e in rules() for part in (e.rpartition(MARK)[0], e.partition(MARK)[2])]
    return max(side.replace("[^ ]", "").count(" ") for side in sides)


REACH = _reach()


def _places(words: str, phrase: str) -> Column:
    """Where the words of a phrase stand one after another."""
    parts = phrase.split()
    test = " AND ".join([f"w = '{parts[0]}'", *(f"get({words}, i + {k}) = '{p}'" for k, p in enumerate(parts[1:], 1))])
    return F.expr(f"filter(transform({words}, (w, i) -> IF({test}, i, NULL)), p -> p IS NOT NULL)")


def _gate(low: Column) -> Column:
    """Whether a text in lower case (of all letters, which lets no fewer pass) can hold a base phrase or a rule's match."""
    found = F.lit(False)
    for stem in STEMS:
        found = found | low.contains(stem)
    return found | (low.contains("cc") & low.rlike(r"(?:^|[\x00-\x2F\x3A-\x60\x7B-\x7F])cc[\x00-\x2F\x3A-\x60\x7B-\x7F]+by"))


DETECTION = ["label", "rule", "priority", "first", "past"]


def outermost(found: DataFrame) -> DataFrame:
    """Rows of found(row, first, past, priority, rule, ...) that no other of the same `row`
    suppresses; those without a rule stay. A text's rows are sorted once and read once."""
    before = W.partitionBy("row").orderBy("first", F.desc("past"), F.desc("priority"), "rule").rowsBetween(W.unboundedPreceding, -1)
    levels = sorted({priority for *_, priority, _ in rules()})
    ends = [F.max(F.when(F.col("priority") >= level, F.col("past"))).over(before).alias(f"end{level}") for level in levels]
    own = F.coalesce(*[F.when(F.col("priority") == level, F.col(f"end{level}")) for level in levels])
    return found.select("*", *ends).filter(F.col("rule").isNull() | own.isNull() | (own < F.col("past"))).select(*found.columns)


def scan(docs: DataFrame) -> DataFrame:
    """One row for each row of docs(doc_id, text): n_words, n_base, first_word,
    last_word, base_labels, labels, score and detections (label, rule, priority,
    first and past-the-last word of those that were not suppressed).

    score is the highest priority found over 100; base phrases count 50. Null and
    empty texts have no words, no labels and score 0; repeated rows are scanned each.
    """
    spark = docs.sparkSession
    table = F.broadcast(spark.createDataFrame(rules(), "rule int, label string, keyword string, priority int, expression string"))
    keywords = sorted({k for _, _, k, _, _ in rules()})
    text = F.coalesce("text", F.lit(""))
    low = F.translate(text, string.ascii_uppercase, string.ascii_lowercase)
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id"), F.regexp_count(text, F.lit(_ANY_CASE_WORD)).cast("long").alias("n_words"), F.when(_gate(F.lower(text)), F.regexp_extract_all(low, F.lit(_WORD), F.lit(0))).alias("words"))
    for n, phrase in enumerate(BASE):
        rows = rows.withColumn(f"base{n}", _places("words", phrase))
    every = F.coalesce(F.concat(*[F.col(f"base{n}") for n in range(len(BASE))]), F.array().cast("array<int>"))
    named = F.filter(F.array(*[F.when(F.size(f"base{n}") > 0, F.lit(label)) for n, label in enumerate(BASE.values())]), lambda x: x.isNotNull())
    listed = ", ".join(f"'{k}'" for k in keywords)
    marked = F.expr(f"filter(transform(words, (w, i) -> IF(w IN ({listed}), i, NULL)), p -> p IS NOT NULL)")
    rows = rows.select("row", "doc_id", "n_words", every.alias("base"), named.alias("base_labels"), "words", marked.alias("marked"))
    # one row for the document itself, which takes its base places along, and one for each keyword
    about = F.struct("doc_id", "n_words", "base", "base_labels")
    every_place = F.concat(F.array(F.lit(None).cast("int")), F.coalesce("marked", F.array().cast("array<int>")))
    near = rows.select("row", about.alias("about"), "words", F.explode(every_place).alias("at"))
    start = F.greatest(F.col("at") - REACH, F.lit(0))
    window = F.concat_ws(" ", F.slice("words", start + 1, F.col("at") - start), F.concat(F.lit(MARK), F.get("words", F.col("at"))), F.slice("words", F.col("at") + 2, F.lit(REACH)))
    alone = F.col("at").isNull()
    near = near.select("row", F.when(alone, F.col("about")).alias("about"), F.get("words", F.col("at")).alias("keyword"), start.alias("from"), F.when(~alone, window).alias("window"))
    met = near.join(table, "keyword", "left").withColumn("place", F.regexp_instr("window", F.col("expression")))
    match = F.regexp_substr("window", F.col("expression"))
    spaces = lambda c: F.length(c) - F.length(F.replace(c, F.lit(" "), F.lit("")))
    first = F.col("from") + spaces(F.col("window").substr(F.lit(1), F.col("place") - 1))
    met = met.filter("place > 0 OR about IS NOT NULL").select("row", "about", "label", "rule", "priority", first.alias("first"), (first + spaces(match) + 1).alias("past"))
    found = outermost(met).groupBy("row").agg(F.first("about", ignorenulls=True).alias("about"), F.collect_list(F.when(F.col("rule").isNotNull(), F.struct(*DETECTION))).alias("detections"))
    found = found.select("about.*", "detections")
    labels = F.array_sort(F.array_distinct(F.concat("base_labels", F.transform("detections", lambda d: d["label"]))))
    best = F.greatest(F.coalesce(F.array_max(F.transform("detections", lambda d: d["priority"])), F.lit(0)), F.when(F.size("base") > 0, 50).otherwise(0))
    return found.select(
        "doc_id",
        "n_words",
        F.size("base").cast("long").alias("n_base"),
        F.array_min("base").cast("long").alias("first_word"),
        F.array_max("base").cast("long").alias("last_word"),
        F.array_join(F.array_sort("base_labels"), ",").alias("base_labels"),
        F.array_join(labels, ",").alias("labels"),
        (best / 100.0).alias("score"),
        F.array_sort("detections").alias("detections"),
    )


def op7_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(common.table(spark, sf_dir, "documents")).drop("detections")
