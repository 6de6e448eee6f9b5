"""License detection by ordered signature rules, in DataFrame functions alone.

A text is read as its words, A-Z as a-z, with one space between. Rules are regular
expressions over that, each with a keyword and a priority. Keywords decide which texts and
which rules are looked at. Detections are intervals of words; one that lies inside another
is suppressed, and of two that overlap the one of lower priority. Everything happens
within a document's row, so nothing is shuffled.
"""

from __future__ import annotations

import json
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Phrases that are always looked for, and their labels.
BASE = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}

# Families: label, names as regular expressions over words, versions.
FAMILIES = (
    ("gpl", ("gnu general public licen[sc]e", "gnu gpl", "gpl"), ("1", "1 0", "2", "2 0", "3", "3 0")),
    ("lgpl", ("gnu (?:lesser|library) general public licen[sc]e", "gnu lgpl", "lgpl"), ("2", "2 0", "2 1", "3", "3 0")),
    ("agpl", ("gnu affero general public licen[sc]e", "affero gpl", "agpl"), ("1 0", "3", "3 0")),
    ("gfdl", ("gnu free documentation licen[sc]e", "gfdl"), ("1 1", "1 2", "1 3")),
    ("apache", ("apache (?:software )?licen[sc]e", "apache"), ("1 0", "1 1", "2", "2 0")),
    ("mit", ("mit licen[sc]e", "mit licensed"), ()),
    ("expat", ("expat licen[sc]e",), ()),
    ("x11", ("x11 licen[sc]e",), ()),
    ("bsd-2-clause", ("bsd 2 clause(?: licen[sc]e)?", "2 clause bsd", "simplified bsd licen[sc]e"), ()),
    ("bsd-3-clause", ("bsd 3 clause(?: licen[sc]e)?", "3 clause bsd", "(?:new|modified) bsd licen[sc]e"), ()),
    ("bsd-4-clause", ("bsd 4 clause(?: licen[sc]e)?", "4 clause bsd", "original bsd licen[sc]e"), ()),
    ("0bsd", ("0bsd", "zero clause bsd"), ()),
    ("bsd", ("bsd licen[sc]e",), ()),
    ("isc", ("isc licen[sc]e",), ()),
    ("mpl", ("mozilla public licen[sc]e", "mpl"), ("1 0", "1 1", "2", "2 0")),
    ("epl", ("eclipse public licen[sc]e", "epl"), ("1 0", "2", "2 0")),
    ("cpl", ("common public licen[sc]e",), ("1 0",)),
    ("cddl", ("common development and distribution licen[sc]e",), ("1 0", "1 1")),
    ("eupl", ("european union public licen[sc]e",), ("1 0", "1 1", "1 2")),
    ("artistic", ("artistic licen[sc]e",), ("1 0", "2 0")),
    ("ofl", ("(?:sil )?open font licen[sc]e",), ("1 0", "1 1")),
    ("odbl", ("open (?:data commons open )?database licen[sc]e",), ("1 0",)),
    ("odc-by", ("open data commons attribution licen[sc]e",), ("1 0",)),
    ("pddl", ("public domain dedication and licen[sc]e",), ("1 0",)),
    ("cecill", ("cecill(?: licen[sc]e)?",), ("1 0", "2 0", "2 1")),
    ("zlib", ("zlib(?: libpng)? licen[sc]e",), ()),
    ("boost", ("boost software licen[sc]e",), ("1 0",)),
    ("unlicense", ("unlicense",), ()),
    ("wtfpl", ("wtfpl",), ()),
    ("ms-pl", ("microsoft public licen[sc]e", "ms pl"), ()),
    ("ms-rl", ("microsoft reciprocal licen[sc]e", "ms rl"), ()),
    ("ncsa", ("university of illinois ncsa open source licen[sc]e",), ()),
    ("postgresql", ("postgresql licen[sc]e",), ()),
    ("python", ("python software foundation licen[sc]e", "psf licen[sc]e"), ("2", "2 0")),
    ("php", ("php licen[sc]e",), ("3 0", "3 01")),
    ("openssl", ("openssl licen[sc]e",), ()),
    ("cc0", ("cc0", "creative commons zero"), ("1 0",)),
    ("proprietary", ("proprietary(?: and confidential)?",), ()),
)
#: SPDX short ids that are no names above: label, id, versions, and whether the id with a
#: version says enough alone. The others are also words, so they count behind a prefix
#: that speaks of a licence, as all ids without a version do.
SHORT = (
    ("mit", "mit", (), False),
    ("expat", "expat", (), False),
    ("x11", "x11", (), False),
    ("isc", "isc", (), False),
    ("zlib", "zlib", (), False),
    ("ncsa", "ncsa", (), False),
    ("postgresql", "postgresql", (), False),
    ("openssl", "openssl", (), False),
    ("php", "php", ("3 0", "3 01"), False),
    ("python", "python", ("2 0",), False),
    ("python", "psf", ("2 0",), True),
    ("boost", "bsl", ("1 0",), True),
    ("cpl", "cpl", ("1 0",), True),
    ("cddl", "cddl", ("1 0", "1 1"), True),
    ("eupl", "eupl", ("1 0", "1 1", "1 2"), True),
    ("artistic", "artistic", ("1 0", "2 0"), True),
    ("ofl", "ofl", ("1 0", "1 1"), True),
    ("odbl", "odbl", ("1 0",), True),
    ("odc-by", "odc by", ("1 0",), True),
    ("pddl", "pddl", ("1 0",), True),
)
#: What may follow "cc by" or "creative commons attribution", and the versions.
CC_PARTS = {
    "": "",
    "-sa": " (?:sa|sharealike|share alike)",
    "-nd": " (?:nd|noderivatives|no derivatives)",
    "-nc": " (?:nc|noncommercial|non commercial)",
}
CC_KINDS = ((), ("-sa",), ("-nd",), ("-nc",), ("-nc", "-sa"), ("-nc", "-nd"))
CC_VERSIONS = ("1 0", "2 0", "2 5", "3 0", "4 0")
#: What may stand before a name, and the priority that it gives. The first two speak of
#: a licence.
FORMS = (
    ("spdx licen[sc]e identifier ", 90),
    ("licen[sc]ed under (?:the )?(?:terms of (?:the )?)?", 80),
    ("(?:released|distributed|available|published) under (?:the )?(?:terms of (?:the )?)?", 70),
    ("", 50),
)
VERSIONED = 10
#: Rules without a family: label, keyword, regular expression, priority.
SINGLE = (
    ("all-rights-reserved", "rights reserved", "all rights reserved", 30),
    ("public-domain", "public domain", "(?:released into|dedicated to|in) the public domain", 60),
    ("copyright", "copyright", r"copyright (?:c )?(?:19|20)\d\d", 20),
)
#: A text without any of these cannot match a rule; what they are is part of the rules.
#: A space in front is that before a rule's first word.
GATES = (
    "licen", "gpl", "mpl", "epl", "gfdl", "bsd", "apache", "cc by", "cc0", "creative commons",
    "spdx", "public domain", "rights reserved", "copyright", "proprietary", "wtfpl", "cecill",
    " ms pl", " ms rl", " psf", " bsl", " cpl", " cddl", " eupl", " artistic", " ofl", " odbl", " odc by", " pddl",
)

NOT_WORD = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Marks around a match. Words have no control characters, so no prepared text has them.
OPEN, CLOSE = "\x01", "\x02"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _keyword(name: str) -> str:
    """The longest literal that is in all that ``name`` matches: what is left between its
    groups and character classes. Names have no bars or quantifiers outside of groups."""
    return max(re.split(r"\(\?:[^()]*\)\??|\[[^]]*\]", name), key=len)


def _with_version(name: str, version: str) -> str:
    """``name`` with "2", "v2", "v 2", "version 2" or "ver 2" behind it, the "v2" also
    without the space; behind an abbreviation like "gpl" the "2" too."""
    joined = "v?" if name.endswith("pl") else "v"
    return rf"{name}(?: (?:v ?|version |ver )?|{joined}){version}(?: or later| only)?"


def _label(label: str, version: str) -> str:
    return f"{label}-{version.replace(' ', '.')}" if " " in version else f"{label}-{version}.0"


def rules() -> list[tuple[str, str, str, int]]:
    """(label, keyword, regular expression, priority) of every rule, in order.

    An expression begins with the space before its first word and looks ahead to the one
    after its last, so that matches lie on whole words. Each name is a rule of its own,
    and its keyword a literal part of it: what the expression matches has the keyword.
    """
    named = []
    for label, names, versions in FAMILIES:
        for name in names:
            named.append((label, _keyword(name), name, 0))
            named += [(_label(label, v), _keyword(name), _with_version(name, v), VERSIONED) for v in versions]
    for kind in CC_KINDS:
        label = "cc-by" + "".join(kind)
        parts = "".join(CC_PARTS[k] for k in kind)
        for key, start in (("cc by", "cc by"), ("creative commons", "creative commons attribution")):
            named.append((label, key, start + parts, 0))
            for v in CC_VERSIONS:
                name = rf"{start}{parts}(?: licen[sc]e| international| unported)? {v}(?: international| unported)?"
                named.append((f"{label}-{v.replace(' ', '.')}", key, name, VERSIONED))
    guarded = []
    for label, name, versions, alone in SHORT:
        guarded.append((label, name, name, 0))
        (named if alone else guarded).extend((_label(label, v), name, _with_version(name, v), VERSIONED) for v in versions)
    out = [
        (label, key, rf" {before}{name}(?= )", priority + more)
        for i, (before, priority) in enumerate(FORMS)
        for label, key, name, more in (named + guarded if i < 2 else named)
    ]
    return out + [(label, key, rf" {name}(?= )", p) for label, key, name, p in SINGLE]


def _once(value: Column, use) -> Column:
    """``use(value)`` with the value made once: what a lambda function names from outside
    is made again at each of its calls."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _spaces(x: Column) -> Column:
    return F.octet_length(x) - F.octet_length(F.replace(x, F.lit(" "), F.lit("")))


def _intervals(text: Column, pattern: Column) -> Column:
    """[start, end) in words of all matches, in time proportional to the text.

    Matches are marked at both ends with characters that no text has here, and the marks
    found among the words: a match begins behind word ``start - 1`` and ends with word
    ``end - 1``, and the first piece of a text is the empty one before its first space.
    """
    marked = F.split(F.regexp_replace(text, pattern, F.lit(f"{OPEN}$0{CLOSE}")), " ", -1)

    def places(words: Column, mark: str) -> Column:
        return F.array_compact(F.transform(words, lambda w, i: F.when(F.contains(w, F.lit(mark)), i)))

    def paired(words: Column) -> Column:
        begins, ends = places(words, OPEN), places(words, CLOSE)
        return F.zip_with(begins, ends, lambda s, e: F.struct(s.alias("start"), e.alias("end")))

    return _once(marked, paired)


def _base(text: Column) -> Column:
    """(start, label) of all places of the base phrases."""
    def places(phrase: str, label: str) -> Column:
        found = F.transform(
            _intervals(text, F.lit(f" {phrase}(?= )")),
            lambda x: F.struct(x["start"].alias("start"), F.lit(label).alias("label")),
        )
        none = F.array().cast("array<struct<start:int,label:string>>")
        return F.when(F.contains(text, F.lit(f" {phrase} ")), found).otherwise(none)

    each = [places(phrase, label) for phrase, label in BASE.items()]
    return F.array_sort(F.concat(*each))


_ONE = "struct<start:int,end:int,priority:int,label:string>"
_DETECTION = f"array<{_ONE}>"


def _settled(found: Column) -> Column:
    """``found``, sorted so that an interval can only lie inside an earlier one, without
    those inside another and, of two that overlap, the one of lower priority.

    The walk keeps how far intervals reach and the last one kept, which a later one may
    still replace. It goes by blocks of about the root of their number, each with a list
    of its own: one list that grows would be copied for every interval.
    """
    none = F.array().cast(_DETECTION)

    def state(reach: Column, last: Column, out: Column) -> Column:
        return F.struct(reach.alias("reach"), last.alias("last"), out.alias("out"))

    def step(acc: Column, x: Column) -> Column:
        last, out = acc["last"], acc["out"]
        apart = last.isNull() | (x["start"] >= last["end"])
        done = F.when(last.isNull(), out).otherwise(F.concat(out, F.array(last)))
        return (
            F.when(x["end"] <= acc["reach"], acc)
            .when(apart, state(x["end"], x, done))
            .when(x["priority"] > last["priority"], state(x["end"], x, out))
            .otherwise(state(x["end"], last, out))
        )

    size = F.greatest(F.ceil(F.sqrt(F.size(found))), F.lit(64)).cast("int")
    starts = F.sequence(F.lit(1), F.greatest(F.size(found), F.lit(1)), size)

    def block(acc: Column, first: Column) -> Column:
        end = F.aggregate(F.slice(found, first, size), state(acc["reach"], acc["last"], none), step)
        return F.struct(
            end["reach"].alias("reach"), end["last"].alias("last"),
            F.concat(acc["outs"], F.array(end["out"])).alias("outs"),
        )

    zero = F.struct(
        F.lit(0).alias("reach"), F.lit(None).cast(_ONE).alias("last"),
        F.array().cast(f"array<{_DETECTION}>").alias("outs"),
    )
    return F.aggregate(
        starts, zero, block,
        lambda acc: F.concat(F.flatten(acc["outs"]), F.when(acc["last"].isNull(), none).otherwise(F.array(acc["last"]))),
    )


def _detections(text: Column) -> Column:
    """Detections of all rules, those that others suppress left out."""
    # One literal: as thousands of expressions the table would slow down planning. Rules
    # with one keyword stand together, so that a text is searched for it once.
    behind = {}
    for label, key, pattern, priority in rules():
        behind.setdefault(key, []).append({"label": label, "pattern": pattern, "priority": priority})
    made = json.dumps([{"key": key, "rules": each} for key, each in behind.items()])
    table = F.from_json(F.lit(made), "array<struct<key:string,rules:array<struct<label:string,pattern:string,priority:int>>>>")
    gated = F.flatten(F.transform(F.filter(table, lambda k: F.contains(text, k["key"])), lambda k: k["rules"]))
    used = F.filter(gated, lambda r: F.rlike(text, r["pattern"]))
    # In the order in which an interval can only lie inside an earlier one.
    found = F.array_sort(
        F.flatten(
            F.transform(
                used,
                lambda r: F.transform(
                    _intervals(text, r["pattern"]),
                    lambda x: F.struct(
                        x["start"].alias("start"), (-x["end"]).alias("back"),
                        (-r["priority"]).alias("rank"), r["label"].alias("label"),
                    ),
                ),
            )
        )
    )
    found = F.transform(
        found,
        lambda x: F.struct(
            x["start"].alias("start"), (-x["back"]).alias("end"), (-x["rank"]).alias("priority"), x["label"].alias("label")
        ),
    )
    return _once(found, _settled)


def with_licenses(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add n_words, ``base`` (start and label of each base phrase) and ``detections``
    (start, end, priority, label of what the rules find) to each row.

    Words are those of ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after A-Z became a-z. A null
    or empty text has none. Columns of ``docs`` with one of the three names give way to
    the new ones; all others stay, whatever their names.
    """
    words = F.concat(F.lit(" "), F.trim(F.regexp_replace(F.coalesce(F.col(text), F.lit("")), NOT_WORD, " ")), F.lit(" "))
    # The row as one value: its columns cannot clash with those made on the way.
    rows = docs.select(F.struct("*").alias("row"), words.alias("words"))
    low = F.lower("words")
    gate = F.contains(low, F.lit(GATES[0]))
    for key in GATES[1:]:
        gate = gate | F.contains(low, F.lit(key))
    rows = rows.select(
        "row",
        F.when(F.col("words") == "  ", F.lit(0)).otherwise(_spaces(F.col("words")) - 1).cast("long").alias("n_words"),
        F.when(gate, F.translate("words", UPPER, LOWER)).alias("low"),
    )
    found = F.col("low").isNotNull()
    return rows.select(
        *[F.col("row")[c].alias(c) for c in docs.columns if c not in ("n_words", "base", "detections")],
        "n_words",
        F.when(found, _base(F.col("low"))).otherwise(F.array().cast("array<struct<start:int,label:string>>")).alias("base"),
        F.when(found, _detections(F.col("low"))).otherwise(F.array().cast(_DETECTION)).alias("detections"),
    )


def op9_licenses(spark, sf_dir: str) -> DataFrame:
    """Base phrases, labels and a score for every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    starts = F.transform("base", lambda x: x["start"].cast("long"))
    base = F.array_distinct(F.transform("base", lambda x: x["label"]))
    own = F.transform("detections", lambda x: x["label"])
    best = F.array_max(F.transform("detections", lambda x: x["priority"]))
    sure = F.greatest(F.coalesce(best, F.lit(0)), F.when(F.size("base") > 0, 50).otherwise(0))
    return with_licenses(docs).select(
        "doc_id",
        "n_words",
        F.size("base").cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"),
        F.array_join(F.array_sort(base), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_distinct(F.concat(base, own))), ",").alias("labels"),
        (sure / 100).alias("score"),
    )
