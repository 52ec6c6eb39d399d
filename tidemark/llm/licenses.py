"""License scans by ordered signature rules, in DataFrame functions only.

A text is lower-cased (A-Z), reduced to its words joined by single spaces, and scanned by regular expressions over that
form. Each rule has keywords: only rules of which one stands in the text are run, and a text without any stem that
all rules need is not scanned at all. A detection has a rule, a label, a priority (0 exact identifiers, 1 grants and
notices, 2 bare names) and an interval of words. A detection is suppressed if its interval is contained in that of one
of the same or a stronger priority (of equal intervals and priorities, the earlier rule stays), so "gnu lesser
general public license" isn't also a GPL. Detections are resolved in one ordered fold, linear in their number.

Everything is a projection of one row: no shuffle, no join, no Python, whatever the sources or copies.

Defined cases: null text is empty; a text without words has no detection, null places and score 0; repeated rows get
equal results; labels are distinct, sorted and comma-joined; base labels stay even where their places are suppressed;
extra columns are carried along, and the columns made here replace clashing ones.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

# The base phrases and their labels.
BASE_PHRASES = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}

# Signatures: label, keyword, name as a pattern over words, SPDX identifier as words.
NAMES = [
    ("mit", "mit|expat", "mit|expat", "mit"),
    ("mit-0", "mit", "mit no attribution|mit 0", "mit 0"),
    ("apache-1.1", "apache", r"apache(?: software)? license(?: version)? 1 1|apache 1 1", "apache 1 1"),
    ("apache-2", "apache", r"apache(?: software)? license(?: version| v)? ?2(?: 0)?|apache v?2(?: 0)?", "apache 2 0"),
    ("apache", "apache", "apache(?: software)?", "apache"),
    ("bsd-2-clause", "bsd", r"(?:bsd 2 clause|simplified bsd|freebsd|2 clause bsd|two clause bsd)", "bsd 2 clause"),
    ("bsd-3-clause", "bsd", r"(?:bsd 3 clause|new bsd|modified bsd|revised bsd|3 clause bsd|three clause bsd)", "bsd 3 clause"),
    ("bsd-4-clause", "bsd", r"(?:bsd 4 clause|original bsd|4 clause bsd|four clause bsd)", "bsd 4 clause"),
    ("bsd", "bsd", "bsd(?: style)?", "bsd"),
    ("0bsd", "bsd", "zero clause bsd|bsd zero clause|0bsd", "0bsd"),
    ("isc", "isc|internet systems", "isc|internet systems consortium", "isc"),
    ("zlib", "zlib", "zlib(?: libpng)?", "zlib"),
    ("gpl-1", "general public|gpl", r"gnu general public license(?: version| v)? 1|gplv?1|gpl v?1(?: 0)?", "gpl 1 0(?: only| or later)?"),
    ("gpl-2", "general public|gpl", r"gnu general public license(?: version| v)? ?2(?: 0)?|gnu gpl v? ?2|gplv?2|gpl v?2(?: 0)?", "gpl 2 0(?: only| or later)?"),
    ("gpl-3", "general public|gpl", r"gnu general public license(?: version| v)? ?3(?: 0)?|gnu gpl v? ?3|gplv?3|gpl v?3(?: 0)?", "gpl 3 0(?: only| or later)?"),
    ("gpl", "general public|gpl", "gnu general public|gnu gpl|gpl", "gpl"),
    ("lgpl-2", "general public|gpl", r"gnu (?:library|lesser) general public license(?: version| v)? ?2(?: 0)?|lgplv?2|lgpl v?2(?: 0)?", "lgpl 2 0(?: only| or later)?"),
    ("lgpl-2.1", "general public|gpl", r"gnu lesser general public license(?: version| v)? ?2 1|lgplv?2 1|lgpl v?2 1", "lgpl 2 1(?: only| or later)?"),
    ("lgpl-3", "general public|gpl", r"gnu lesser general public license(?: version| v)? ?3(?: 0)?|lgplv?3|lgpl v?3(?: 0)?", "lgpl 3 0(?: only| or later)?"),
    ("lgpl", "general public|gpl", "gnu (?:lesser|library) general public|gnu lgpl|lgpl", "lgpl"),
    ("agpl-3", "affero|agpl", r"gnu affero general public license(?: version| v)? ?3(?: 0)?|agplv?3|agpl v?3(?: 0)?", "agpl 3 0(?: only| or later)?"),
    ("agpl", "affero|agpl", "gnu affero general public|affero general public|agpl", "agpl"),
    ("gfdl", "gnu free|gfdl", r"gnu free documentation(?: license(?: version| v)? 1 [123])?|gfdl", "gfdl 1 [123](?: only| or later)?"),
    ("mpl-1.1", "mozilla|mpl", r"mozilla public license(?: version| v)? ?1 1|mpl v?1 1", "mpl 1 1"),
    ("mpl-2", "mozilla|mpl", r"mozilla public license(?: version| v)? ?2(?: 0)?|mpl v?2(?: 0)?", "mpl 2 0"),
    ("mpl", "mozilla", "mozilla public", "mpl"),
    ("epl-1", "eclipse|epl", r"eclipse public license(?: version| v)? ?1(?: 0)?|epl v?1(?: 0)?", "epl 1 0"),
    ("epl-2", "eclipse|epl", r"eclipse public license(?: version| v)? ?2(?: 0)?|epl v?2(?: 0)?", "epl 2 0"),
    ("epl", "eclipse", "eclipse public", "epl"),
    ("cddl-1.0", "common development|cddl", r"common development and distribution license(?: version)?(?: 1 0)?|cddl(?: v?1 0)?", "cddl 1 0"),
    ("cpl-1.0", "common public|ibm public", r"common public license(?: version| v)?(?: ?1 0)?|ibm public license", "cpl 1 0"),
    ("eupl-1.1", "european union|eupl", r"european union public licence(?: version| v)? ?1 1|eupl v?1 1", "eupl 1 1"),
    ("eupl-1.2", "european union|eupl", r"european union public licence(?: version| v)? ?1 2|eupl v?1 2", "eupl 1 2"),
    ("artistic-1.0", "artistic", r"artistic license(?: version)? 1 0|artistic 1 0", "artistic 1 0"),
    ("artistic-2.0", "artistic", r"artistic license(?: version)? 2 0|artistic 2 0", "artistic 2 0"),
    ("artistic", "artistic", "artistic", "artistic"),
    ("boost-1.0", "boost", r"boost software(?: license(?: version)? 1 0)?", "bsl 1 0"),
    ("busl-1.1", "business source", r"business source(?: license(?: version)? 1 1)?", "busl 1 1"),
    ("unlicense", "unlicense", "unlicense", "unlicense"),
    ("wtfpl", "wtf|what the fuck", "do what the fuck you want to public|wtfpl", "wtfpl"),
    ("psf-2.0", "python", r"python software foundation(?: license(?: version)? 2)?", "psf 2 0"),
    ("python-2.0", "python", r"python license(?: version)? 2 0", "python 2 0"),
    ("php-3.01", "php", r"php license(?: version)?(?: 3 01?)?", "php 3 01"),
    ("ruby", "ruby", "ruby", "ruby"),
    ("perl", "perl", "same terms as perl itself|perl artistic", "perl"),
    ("postgresql", "postgresql", "postgresql", "postgresql"),
    ("openssl", "openssl", "openssl", "openssl"),
    ("ofl-1.1", "open font|ofl", r"sil open font(?: license(?: version)? 1 1)?|ofl 1 1", "ofl 1 1"),
    ("odbl-1.0", "open database|odbl", r"open data commons open database(?: license)?|open database|odbl", "odbl 1 0"),
    ("odc-by", "open data commons|odc", r"open data commons attribution|odc by", "odc by 1 0"),
    ("pddl", "dedication|pddl", r"public domain dedication and|pddl", "pddl 1 0"),
    ("osl-3.0", "open software|osl", r"open software license(?: version| v)? ?3 0|osl v?3 0", "osl 3 0"),
    ("afl-3.0", "academic", r"academic free(?: license(?: version| v)? ?3 0)?", "afl 3 0"),
    ("ms-pl", "microsoft|ms pl", "microsoft public|ms pl", "ms pl"),
    ("ms-rl", "microsoft|ms rl", "microsoft reciprocal|ms rl", "ms rl"),
    ("ncsa", "ncsa", r"university of illinois ncsa(?: open source)?|ncsa", "ncsa"),
    ("upl-1.0", "universal permissive|upl", "universal permissive|upl 1 0", "upl 1 0"),
    ("x11", "x11", "x11|mit x11", "x11"),
    ("zpl-2.1", "zope", "zope public(?: license version 2 1)?", "zpl 2 1"),
    ("sspl-1.0", "server side|sspl", "server side public|sspl", "sspl 1 0"),
    ("elastic-2.0", "elastic", r"elastic license(?: v| version)? ?2(?: 0)?", "elastic 2 0"),
    ("openrail", "rail|responsible ai", r"(?:creativeml |bigscience )?(?:open ?rail(?: m)?|responsible ai)", "openrail"),
    ("llama-community", "llama", r"llama(?: [23](?: [0-9])?)? community", "llama"),
    ("cecill-2.1", "cecill", r"cecill(?: 2 1| v2 1)?", "cecill 2 1"),
    ("json", "json", "json", "json"),
    ("beerware", "beer", "beer ?ware", "beerware"),
    ("hpnd", "historical", "historical permission notice and disclaimer", "hpnd"),
    ("cc0-1.0", "zero|cc0", r"creative commons zero|cc ?zero|cc0(?: 1 0)?", "cc0 1 0"),
]

#: Creative Commons: parts by rule, each in words and in short form, with or without a version.
CC_PARTS = {
    "by": "attribution", "by-sa": "attribution sharealike", "by-nd": "attribution noderiv(?:ative)?s?",
    "by-nc": "attribution non ?commercial", "by-nc-sa": "attribution non ?commercial sharealike",
    "by-nc-nd": "attribution non ?commercial noderiv(?:ative)?s?",
}
CC_VERSIONS = ["1 0", "2 0", "2 5", "3 0", "4 0"]

#: Notices that name no license, by label, keyword and pattern.
NOTICES = [
    ("all-rights-reserved", "reserved", "all rights reserved"),
    ("public-domain", "domain", "(?:released|placed|dedicated) (?:in|into|to) the public domain|public domain dedication"),
    ("proprietary", "confidential", "proprietary and confidential|confidential and proprietary"),
    ("copyright", "copyright", r"copyright(?: c)? (?:19|20)\d\d(?: (?:19|20)\d\d)?(?: by)?"),
    ("no-redistribution", "distribut|reproduction", "(?:redistribution|distribution|reproduction) (?:is )?(?:strictly )?(?:prohibited|forbidden)|do not distribute|not for (?:re)?distribution"),
    ("permissive-grant", "permission", "permission is hereby granted free of charge to any person|permission to use copy modify and(?: or)? distribute this"),
    ("bsd-conditions", "redistribution", "redistribution and use in source and binary forms"),
    ("copyleft-grant", "redistribute", "you can redistribute it and or modify it under the terms of"),
    ("warranty-disclaimer", "warrant", "without warranty of any kind|without any warranty|as is without warranty"),
    ("research-only", "research", "(?:for )?(?:non ?commercial )?research (?:use|purposes) only"),
    ("non-commercial", "commercial", "(?:for )?non ?commercial (?:use|purposes) only|no commercial use|not for commercial use"),
    ("terms-of-use", "terms", "subject to (?:the|our) terms (?:of|and) (?:use|service|conditions)"),
    ("fair-use", "fair", "fair use (?:notice|disclaimer)"),
]


@dataclass(frozen=True)
class Rule:
    label: str
    keyword: str
    pattern: str
    priority: int
    weight: float
    base: bool = False


def build_rules() -> list[Rule]:
    """All rules in order: base phrases, exact identifiers, grants, then names."""
    rules = [Rule(label, phrase.split()[-2], phrase, 1, 0.9, True) for phrase, label in BASE_PHRASES.items()]
    creative = []
    for parts, words in CC_PARTS.items():
        short = "cc " + parts.replace("-", " ")
        for version in [None, *CC_VERSIONS]:
            tail = f" {version}" if version else ""
            label = f"cc-{parts}" + (f"-{version.replace(' ', '.')}" if version else "")
            long = f"creative commons {words}" + (f"(?: license)? {version}" if version else "")
            creative.append((label, "creative commons|cc by", f"{long}(?: international| unported| generic)?|{short}{tail}", short + tail))
    named = NAMES + creative
    rules += [Rule(label, "spdx", f"spdx license identifier (?:{spdx})", 0, 0.98) for label, _, _, spdx in named]
    grant = "(?:licensed|released|distributed|published|available|provided) under (?:the )?(?:terms of (?:the )?)?(?:an? )?"
    rules += [Rule(label, key, f"{grant}(?:{name})(?: licen[cs]e)?", 1, 0.9) for label, key, name, _ in named]
    rules += [Rule(label, key, f"(?:{name}) licen[cs]e", 2, 0.6) for label, key, name, _ in NAMES]
    rules += [Rule(label, key, name, 2, 0.6) for label, key, name, _ in creative]
    rules += [Rule(label, key, pattern, 2, 0.4) for label, key, pattern in NOTICES]
    return rules


#: Every rule's match has one of these in the lower-cased text. One pass of one pattern is the cheapest gate of all.
STEM_PATTERN = (
    "licen|spdx|under|copyright|reserved|domain|confidential|distribut|permission|warrant|research|commercial|fair|reproduction"
    f"|cc{GAP}by|cc ?zero|cc0|creative{GAP}commons|terms{GAP}"
)

DETECTION = "array<struct<start:int,end:int,priority:int,rule:int,label:string,weight:double,base:boolean>>"


def _spaces(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(" ")))


def _rule_table(rules: list[Rule]) -> Column:
    """The rules as one constant array: the plan stays the same size however many they are."""
    rows = ", ".join(
        "named_struct('rule', {}, 'label', '{}', 'keys', array({}), 'pattern', '{}', 'priority', {}, 'weight', {}D, 'base', {})".format(
            k, r.label, ", ".join(f"'{key}'" for key in r.keyword.split("|")), rf"(?<= )(?:{r.pattern})(?= )".replace("\\", "\\\\"), r.priority, r.weight, str(r.base).lower()
        )
        for k, r in enumerate(rules)
    )
    return F.expr(f"array({rows})")


def _hits(words: Column, rule: Column) -> Column:
    """The places of one rule: what stands between matches, and the matches, give their word numbers."""
    pattern = rule["pattern"]
    found = F.regexp_extract_all(words, pattern, F.lit(0))
    between = F.split(words, pattern, -1)
    zero = F.struct(F.lit(0).alias("at"), F.array().cast(DETECTION).alias("out"))

    def step(state: Column, pair: Column) -> Column:
        start = state["at"] + _spaces(pair["gap"]) - 1
        size = _spaces(pair["hit"])
        hit = F.struct(
            start.cast("int").alias("start"), (start + size).cast("int").alias("end"), rule["priority"].alias("priority"), rule["rule"].alias("rule"),
            rule["label"].alias("label"), rule["weight"].alias("weight"), rule["base"].alias("base"),
        )
        return F.struct((start + 1 + size).cast("int").alias("at"), F.concat(state["out"], F.array(hit)).alias("out"))

    pairs = F.zip_with(found, F.slice(between, F.lit(1), F.size(found)), lambda h, g: F.struct(h.alias("hit"), g.alias("gap")))
    return F.aggregate(pairs, zero, step, lambda s: s["out"])


def _resolve(detections: Column) -> Column:
    """Drop what is contained in a detection of the same or a stronger priority: one fold over ordered intervals."""
    ordered = F.array_sort(
        F.transform(detections, lambda d: F.struct(d["start"].alias("start"), (-d["end"]).alias("_end"), d["priority"].alias("priority"), d["rule"].alias("rule"), d.alias("d")))
    )
    low = F.lit(-1)
    zero = F.struct(low.alias("p0"), low.alias("p1"), low.alias("p2"), F.array().cast(DETECTION).alias("kept"))

    def step(s: Column, x: Column) -> Column:
        end, p = -x["_end"], x["priority"]
        reach = F.when(p == 0, s["p0"]).when(p == 1, F.greatest(s["p0"], s["p1"])).otherwise(F.greatest(s["p0"], s["p1"], s["p2"]))
        kept = F.when(reach >= end, s["kept"]).otherwise(F.concat(s["kept"], F.array(x["d"])))
        upto = [F.when(p == k, F.greatest(s[f"p{k}"], end)).otherwise(s[f"p{k}"]).alias(f"p{k}") for k in range(3)]
        return F.struct(*upto, kept.alias("kept"))

    return F.aggregate(ordered, zero, step, lambda s: s["kept"])


def scan_licenses(docs: DataFrame, rules: list[Rule] | None = None) -> DataFrame:
    """``docs`` with n_words, detections (all, with word intervals; ends are inclusive) and kept (after suppression)."""
    made = ["n_words", "detections", "kept"]
    lower = F.translate(F.coalesce(F.col("text"), F.lit("")), UPPER, LOWER)
    gate = F.col("_lower").rlike(STEM_PATTERN)
    empty = F.array().cast(DETECTION)
    words = F.concat(F.lit(" "), F.array_join("_words", " "), F.lit(" "))
    table = _rule_table(rules or build_rules())
    hits = F.flatten(F.transform(F.filter(table, lambda r: F.exists(r["keys"], lambda key: F.contains(F.col("_text"), key))), lambda r: _hits(F.col("_text"), r)))
    return (
        # The row as one column: whatever its columns are called, they clash with none of these.
        docs.select(F.struct(*[c for c in docs.columns if c not in made]).alias("_row"), lower.alias("_lower"))
        .withColumn("_words", F.regexp_extract_all("_lower", F.lit(WORD), F.lit(0)))
        .withColumn("_text", F.when(gate, words))
        .withColumn("n_words", F.size("_words").cast("long"))
        .withColumn("detections", F.when(F.col("_text").isNotNull(), hits).otherwise(empty))
        .withColumn("kept", F.when(F.size("detections") > 0, _resolve(F.col("detections"))).otherwise(empty))
        .select("_row.*", *made)
    )
