"""Operator 3 [native]: licence recognition by sentence rules.

A text is cut into pieces at line feeds and after runs of . ! ? that white space follows. A piece is normalised (lower
case, every run of other characters than a-z and 0-9 becomes one space, trimmed). A sentence of the fixed tables is found
where it fills whole pieces: one, or several when the text is wrapped or has a stop inside ("v. 2.0"); a list number may
stand before it, and a leading phrase such as "this work is". The identifiers, in order, with words of other sentences as
breaks, are matched against licence rules: a rule is an ordered run of identifiers. SENTENCES and RULES are those of the
SQL, which looks single pieces up; TEXTS and MORE_RULES add the real sentences of licence texts, headers and notices.

Null or empty text, and text without a licence sentence, gives zero counts and empty strings. A licence found twice is
named once, at its first place. Every input row gives one output row; repeated rows give equal rows; extra columns come
along, but for those with a result's name. An empty table gives no rows. Plan: one projection over the scan, no shuffle, no Python; the tables are literals.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skarn.llm.common import let, running

#: Normalised licence sentences and their identifiers.
SENTENCES = {
    "released under the mit license": "mit-name",
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction": "mit-grant",
    "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software": "mit-notice",
    "the software is provided as is without warranty of any kind express or implied": "mit-as-is",
    "licensed under the apache license version 2 0": "apache2-name",
    "you may not use this file except in compliance with the license": "apache2-compliance",
    "you may obtain a copy of the license at": "apache2-copy",
    "licensed under the gnu general public license version 3": "gpl3-name",
    "licensed under the gnu general public license version 2": "gpl2-name",
    "licensed under the gnu lesser general public license version 3": "lgpl3-name",
    "licensed under the gnu affero general public license version 3": "agpl3-name",
    "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version": "gpl3-later",
    "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version": "gpl2-later",
    "licensed under cc by 4 0": "cc-by4",
    "licensed under cc by sa 4 0": "cc-by-sa4",
    "licensed under cc by nc 4 0": "cc-by-nc4",
    "licensed under cc by nc sa 4 0": "cc-by-nc-sa4",
    "licensed under cc by nd 4 0": "cc-by-nd4",
    "released under the bsd 3 clause license": "bsd3-name",
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met": "bsd-grant",
    "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer": "bsd-source",
    "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution": "bsd-binary",
    "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission": "bsd-endorse",
    "subject to the terms of the mozilla public license version 2 0": "mpl2-name",
    "all rights reserved": "reserved",
}
#: Licences and the ordered identifiers that show them; the first rule of a licence that matches counts.
RULES = [
    ("MIT", ["mit-name"]),
    ("MIT", ["mit-grant", "mit-notice", "mit-as-is"]),
    ("Apache-2.0", ["apache2-name", "apache2-compliance", "apache2-copy"]),
    ("Apache-2.0", ["apache2-name"]),
    ("GPL-3.0-only", ["gpl3-name"]),
    ("GPL-3.0-or-later", ["gpl3-later"]),
    ("GPL-2.0-only", ["gpl2-name"]),
    ("GPL-2.0-or-later", ["gpl2-later"]),
    ("LGPL-3.0-only", ["lgpl3-name"]),
    ("AGPL-3.0-only", ["agpl3-name"]),
    ("CC-BY-4.0", ["cc-by4"]),
    ("CC-BY-SA-4.0", ["cc-by-sa4"]),
    ("CC-BY-NC-4.0", ["cc-by-nc4"]),
    ("CC-BY-NC-SA-4.0", ["cc-by-nc-sa4"]),
    ("CC-BY-ND-4.0", ["cc-by-nd4"]),
    ("BSD-3-Clause", ["bsd3-name"]),
    ("BSD-3-Clause", ["bsd-grant", "bsd-source", "bsd-binary", "bsd-endorse"]),
    ("BSD-2-Clause", ["bsd-grant", "bsd-source", "bsd-binary", "mit-as-is"]),
    ("MPL-2.0", ["mpl2-name"]),
    ("LicenseRef-Reserved", ["reserved"]),
]
SPLIT = r"\n|[.!?]+[\x20\x09-\x0D]+"
LEAD = r"^((this|the) (work|software|file|program|project|library|code|text|document|source code form) is |it is |is )"
UNDER = r"^(released|available|distributed|published|provided|licensed) under (the terms of )?"


#: Real texts: sentences of the standard licence texts, headers and notices in normal form, besides SENTENCES.
_GNU = "it and or modify it under the terms of the gnu {} as published by the free software foundation {}"
_GENERAL = {"gpl": "general public license", "lgpl": "lesser general public license", "agpl": "affero general public license"}
_CC = {"cc-by4": "attribution", "cc-by-sa4": "attribution sharealike", "cc-by-nc4": "attribution noncommercial", "cc-by-nc-sa4": "attribution noncommercial sharealike", "cc-by-nd4": "attribution noderivatives"}
TEXTS = {
    "licensed under the mit license": "mit-name",
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions": "mit-grant",
    "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement": "mit-as-is",
    "licensed under the apache license version 2 0 the license": "apache2-name",
    "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license": "apache2-name",
    "licensed under the apache license 2 0": "apache2-name",
    "licensed under the bsd 3 clause license": "bsd3-name",
    "licensed under the bsd 2 clause license": "bsd2-name",
    "released under the bsd 2 clause license": "bsd2-name",
    "this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed": "bsd-as-is",
    "subject to the terms of the mozilla public license v 2 0": "mpl2-name",
    **{f"licensed under the gnu {_GENERAL[k]} {v}": f"{k}{n}-name" for k, n in (("gpl", 3), ("gpl", 2), ("lgpl", 3), ("agpl", 3)) for v in (f"v{n}", f"v{n} 0", f"version {n} 0")},
    **{f"{lead}you can redistribute {_GNU.format(_GENERAL[k], v)}": f"{k}{n.replace('.', '')}-{kind}"
       for k, n in (("gpl", "3"), ("gpl", "2"), ("lgpl", "3"), ("lgpl", "2.1"), ("agpl", "3"))
       for lead in ("free software ", "")
       for kind, v in (("later", f"either version {n.replace('.', ' ')} of the license or at your option any later version"), ("name", f"version {n.replace('.', ' ')}"), ("name", f"version {n.replace('.', ' ')} of the license"))},
    **{f"licensed under {a} creative commons {name} 4 0 international{end}": i for i, name in _CC.items() for a in ("a", "the") for end in (" license", "")},
}
#: Rules besides RULES, after them.
MORE_RULES = [
    ("BSD-2-Clause", ["bsd-grant", "bsd-source", "bsd-binary", "bsd-as-is"]),
    ("BSD-2-Clause", ["bsd2-name"]),
    ("LGPL-3.0-or-later", ["lgpl3-later"]),
    ("LGPL-2.1-or-later", ["lgpl21-later"]),
    ("LGPL-2.1-only", ["lgpl21-name"]),
    ("AGPL-3.0-or-later", ["agpl3-later"]),
]
#: The lead of a sentence: LEAD, or the name of a program before "is free software".
ANY_LEAD = f"(?:{LEAD.removeprefix('^')}|(?:[a-z0-9]+ ){{1,6}}is (?=free software ))"
NUMBER = "(?:[0-9]{1,2}|[a-z]) "
#: Ends of sentences before a colon: on one line more words may follow, since no piece ends there.
COLON = ("following conditions", "conditions are met", "copy of the license at")


def normalised(sentence: Column) -> Column:
    """Normal form of a sentence, still with its leading phrase."""
    return F.trim(F.regexp_replace(F.lower(sentence), "[^a-z0-9]+", " "))


def _table() -> dict[str, str]:
    return TEXTS | SENTENCES


def _pattern() -> str:
    """A known sentence between line ends of the joined text, over as many lines as it takes, longest first."""
    verb = UNDER.removeprefix("^")
    tails = sorted({s.removeprefix("licensed under ") for s in _table() if s.startswith("licensed under ")}, key=len, reverse=True)
    whole = sorted((s for s in _table() if not s.startswith("licensed under ")), key=len, reverse=True)
    wrapped = lambda s: s.replace(" ", "[ \n]+")
    ends = "|".join(wrapped(s) + ("(?=[ \n])" if s.endswith(COLON) else "(?=\n)") for s in whole)
    body = f"(?:{ends}|{wrapped(verb)}(?:{wrapped('|'.join(tails))})(?=\n))"
    return f"((?:\n|\\G )(?:{wrapped(NUMBER)})?)((?:{wrapped(ANY_LEAD)})?{body})"


def _identifier(plain: Column) -> Column:
    """The identifier of a matched sentence: as it is, without its lead, or with "released/... under" as "licensed under"."""
    table = F.create_map(*[F.lit(x) for pair in _table().items() for x in pair])
    bare = F.regexp_replace(plain, "^" + ANY_LEAD, "")
    forms = [form for s in (plain, bare) for form in (s, F.regexp_replace(s, UNDER, "licensed under "))]
    return F.coalesce(*[F.try_element_at(table, x) for x in forms])


def license_sentences(text: Column) -> Column:
    """array<struct<at, joins, id>>: the known sentences, the number from 0 of their first piece as SPLIT cuts them, and
    whether no words but a list number stand between the sentence and the known one before it."""
    pieces = F.filter(F.split(F.coalesce(text, F.lit("")), SPLIT), lambda s: F.length(s) > 0)
    joined = F.concat(F.lit("\n"), F.array_join(F.transform(pieces, normalised), "\n"), F.lit("\n"))
    return let(joined, _known)


def _known(joined: Column) -> Column:
    pattern = F.lit(_pattern())
    lines = lambda s: F.length(s) - F.length(F.replace(s, F.lit("\n"), F.lit("")))
    before = F.zip_with(F.split(joined, pattern), F.regexp_extract_all(joined, pattern, F.lit(1)), lambda g, n: F.struct(g.alias("gap"), n.alias("number")))
    parts = F.zip_with(before, F.regexp_extract_all(joined, pattern, F.lit(2)), lambda b, x: F.struct(b["gap"].alias("gap"), b["number"].alias("number"), x.alias("found")))

    def hits(found):
        n = F.transform(found, lambda x: F.struct((lines(x["gap"]) + lines(x["number"])).alias("ahead"), lines(x["found"]).alias("inside")))
        before = let(n, lambda n: F.zip_with(n, running(F.transform(n, lambda x: x["ahead"] + x["inside"])), lambda x, b: b + x["ahead"] - 1))
        hit = lambda x, at: F.struct(at.alias("at"), (~x["gap"].rlike("[a-z0-9]")).alias("joins"), let(F.regexp_replace(x["found"], "[ \n]+", " "), _identifier).alias("id"))
        return F.zip_with(found, before, hit)

    return let(F.filter(parts, lambda x: x["found"].isNotNull()), hits)


def recognise_licenses(docs: DataFrame) -> DataFrame:
    """docs plus n_license_sentences long, license_ids string ("at:id" joined by commas), licenses string. Columns of these
    names in docs are replaced."""
    mine = ["n_license_sentences", "license_ids", "licenses"]
    others = [c for c in docs.columns if c.lower() not in mine]
    with_ids = docs.select(*others).withColumn("__all", license_sentences(F.col("text")))
    with_ids = with_ids.withColumn("__hits", F.when(F.size("__all") > 0, F.col("__all")))
    # unknown sentences break runs: a bar stands between hits that words part
    line = F.concat(F.lit(" "), F.array_join(F.transform("__hits", lambda h: F.concat(F.when(h["joins"], "").otherwise("| "), h["id"], F.lit(" "))), ""))
    with_ids = with_ids.withColumn("__line", line)
    found = F.array(*[F.struct(F.instr("__line", f" {' '.join(ids)} ").alias("p"), F.lit(i).alias("i"), F.lit(name).alias("name")) for i, (name, ids) in enumerate(RULES + MORE_RULES)])
    named = F.array_distinct(F.transform(F.sort_array(F.filter(found, lambda r: r["p"] > 0)), lambda r: r["name"]))
    return with_ids.select(
        *others,
        F.coalesce(F.size("__hits"), F.lit(0)).cast("long").alias("n_license_sentences"),
        F.coalesce(F.array_join(F.transform("__hits", lambda h: F.concat_ws(":", h["at"].cast("string"), h["id"])), ","), F.lit("")).alias("license_ids"),
        F.coalesce(F.array_join(F.when(F.col("__line").isNotNull(), named), ","), F.lit("")).alias("licenses"),
    )
