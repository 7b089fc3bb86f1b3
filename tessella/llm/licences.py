"""Licence scans by sentence rules.

Texts are cut into paragraphs at empty lines and into sentences at full stops; a single line break is a space, so wrapped
notices are whole. Sentences are normalised: lower case, only letters, digits and dots inside numbers, one space.
Known licence sentences are found in them, behind any lead-in and before any rest; a normalised sentence so maps to
one or more identifiers. Ordered rules match sequences of identifiers: the first rule that fits at a place names the
licence and consumes its sentences.
"""

from __future__ import annotations

import re

import ahocorasick
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import table

# Known licence sentences or the parts of them that tell them apart, normalised, with their identifiers.
SENTENCES = {
    "licensed under the apache license version 2.0": "apache2-ref",
    "licensed under the apache license 2.0": "apache2-ref",
    "licensed under apache 2.0": "apache2-ref",
    "released under the apache license version 2.0": "apache2-ref",
    "you may not use this file except in compliance with the license": "apache2-comply",
    "you may obtain a copy of the license at": "apache2-copy",
    "distributed under the license is distributed on an as is basis": "apache2-basis",
    "released under the mit license": "mit-ref",
    "licensed under the mit license": "mit-ref",
    "distributed under the mit license": "mit-ref",
    "available under the mit license": "mit-ref",
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files": "mit-grant",
    "permission is hereby granted free of charge to any person obtaining a copy of this software": "mit-grant",
    "the above copyright notice and this permission notice shall be included in all copies": "mit-notice",
    "the software is provided as is without warranty of any kind": "mit-warranty",
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted": "isc-grant",
    "permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted": "isc-grant",
    "the software is provided as is and the author disclaims all warranties": "isc-warranty",
    "licensed under the isc license": "isc-ref",
    "redistribution and use in source and binary forms with or without modification are permitted": "bsd-grant",
    "redistributions of source code must retain the above copyright notice": "bsd-source",
    "redistributions in binary form must reproduce the above copyright notice": "bsd-binary",
    "neither the name of": "bsd-endorse",
    "licensed under the bsd 2 clause license": "bsd2-ref",
    "licensed under the bsd 3 clause license": "bsd3-ref",
    "under the terms of the gnu general public license as published by the free software foundation": "gpl-grant",
    "under the terms of the gnu general public license version 2 as published by the free software foundation": "gpl2-only",
    "under the terms of the gnu general public license version 3 as published by the free software foundation": "gpl3-only",
    "licensed under the gnu general public license version 2": "gpl2-ref",
    "licensed under the gnu general public license version 3": "gpl3-ref",
    "licensed under the gnu general public license v2.0": "gpl2-ref",
    "licensed under the gnu general public license v3.0": "gpl3-ref",
    "under the terms of the gnu lesser general public license as published by the free software foundation": "lgpl-grant",
    "under the terms of the gnu library general public license as published by the free software foundation": "lgpl-grant",
    "licensed under the gnu lesser general public license version 2.1": "lgpl21-ref",
    "licensed under the gnu lesser general public license version 3": "lgpl3-ref",
    "under the terms of the gnu affero general public license as published by the free software foundation": "agpl-grant",
    "licensed under the gnu affero general public license version 3": "agpl3-ref",
    "either version 2 of the license or at your option any later version": "version2-later",
    "either version 2.1 of the license or at your option any later version": "version21-later",
    "either version 3 of the license or at your option any later version": "version3-later",
    "subject to the terms of the mozilla public license v 2.0": "mpl2-ref",
    "licensed under the mozilla public license version 2.0": "mpl2-ref",
    "under the terms of the eclipse public license 2.0": "epl2-ref",
    "under the terms of the eclipse public license v2.0": "epl2-ref",
    "under the terms of the eclipse public license v 2.0": "epl2-ref",
    "this is free and unencumbered software released into the public domain": "unlicense-ref",
    "permission is granted to anyone to use this software for any purpose including commercial applications": "zlib-grant",
    "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license": "bsl-grant",
    "distributed under the boost software license version 1.0": "bsl-ref",
    "everyone is permitted to copy and distribute verbatim or modified copies of this license document": "wtfpl-copy",
    "do what the fuck you want to public license": "wtfpl-ref",
    "licensed under cc by 4.0": "cc-by-4-ref",
    "licensed under cc by sa 4.0": "cc-by-sa-4-ref",
    "licensed under cc by nc 4.0": "cc-by-nc-4-ref",
    "licensed under cc by nd 4.0": "cc-by-nd-4-ref",
    "licensed under cc by nc sa 4.0": "cc-by-nc-sa-4-ref",
    "licensed under cc by nc nd 4.0": "cc-by-nc-nd-4-ref",
    "creative commons attribution 4.0 international": "cc-by-4-ref",
    "creative commons attribution sharealike 4.0 international": "cc-by-sa-4-ref",
    "creative commons attribution noncommercial 4.0 international": "cc-by-nc-4-ref",
    "creative commons attribution noderivatives 4.0 international": "cc-by-nd-4-ref",
    "creative commons attribution noncommercial sharealike 4.0 international": "cc-by-nc-sa-4-ref",
    "creative commons attribution noncommercial noderivatives 4.0 international": "cc-by-nc-nd-4-ref",
    "cc0 1.0 universal": "cc0-ref",
    "all rights reserved": "all-rights",
}
# Ordered rules, a sequence of identifiers and the licence it stands for; the first fit wins.
RULES = (
    (("mit-grant", "mit-notice", "mit-warranty"), "MIT"),
    (("isc-grant", "isc-warranty"), "ISC"),
    (("gpl-grant", "version3-later"), "GPL-3.0-or-later"),
    (("gpl-grant", "version2-later"), "GPL-2.0-or-later"),
    (("lgpl-grant", "version3-later"), "LGPL-3.0-or-later"),
    (("lgpl-grant", "version21-later"), "LGPL-2.1-or-later"),
    (("lgpl-grant", "version2-later"), "LGPL-2.0-or-later"),
    (("agpl-grant", "version3-later"), "AGPL-3.0-or-later"),
    (("bsd-grant", "bsd-source", "bsd-binary", "bsd-endorse"), "BSD-3-Clause"),
    (("bsd-grant", "bsd-endorse"), "BSD-3-Clause"),
    (("bsd-grant", "bsd-source", "bsd-binary"), "BSD-2-Clause"),
    (("bsd-grant",), "BSD-2-Clause"),
    (("apache2-ref", "apache2-comply", "apache2-copy", "apache2-basis"), "Apache-2.0"),
    (("apache2-ref", "apache2-comply", "apache2-copy"), "Apache-2.0"),
    (("apache2-ref", "apache2-comply"), "Apache-2.0"),
    (("apache2-ref",), "Apache-2.0"),
    (("apache2-comply", "apache2-copy"), "Apache-2.0"),
    (("mit-grant", "mit-notice"), "MIT"),
    (("mit-grant",), "MIT"),
    (("mit-ref",), "MIT"),
    (("isc-grant",), "ISC"),
    (("isc-ref",), "ISC"),
    (("bsd2-ref",), "BSD-2-Clause"),
    (("bsd3-ref",), "BSD-3-Clause"),
    (("gpl2-only",), "GPL-2.0-only"),
    (("gpl3-only",), "GPL-3.0-only"),
    (("gpl2-ref",), "GPL-2.0"),
    (("gpl3-ref",), "GPL-3.0"),
    (("gpl-grant",), "GPL"),
    (("lgpl21-ref",), "LGPL-2.1"),
    (("lgpl3-ref",), "LGPL-3.0"),
    (("lgpl-grant",), "LGPL"),
    (("agpl3-ref",), "AGPL-3.0"),
    (("mpl2-ref",), "MPL-2.0"),
    (("epl2-ref",), "EPL-2.0"),
    (("unlicense-ref",), "Unlicense"),
    (("zlib-grant",), "Zlib"),
    (("bsl-grant",), "BSL-1.0"),
    (("bsl-ref",), "BSL-1.0"),
    (("wtfpl-ref", "wtfpl-copy"), "WTFPL"),
    (("wtfpl-ref",), "WTFPL"),
    (("cc-by-nc-sa-4-ref",), "CC-BY-NC-SA-4.0"),
    (("cc-by-nc-nd-4-ref",), "CC-BY-NC-ND-4.0"),
    (("cc-by-nc-4-ref",), "CC-BY-NC-4.0"),
    (("cc-by-sa-4-ref",), "CC-BY-SA-4.0"),
    (("cc-by-nd-4-ref",), "CC-BY-ND-4.0"),
    (("cc-by-4-ref",), "CC-BY-4.0"),
    (("cc0-ref",), "CC0-1.0"),
    (("all-rights",), "Proprietary"),
)
#: Identified sentences may stand this many other sentences apart within a rule's sequence.
MAX_GAP = 2
#: A notice that stands right before another known sentence belongs to that licence.
NOTICES = {"all-rights"}
#: Every known sentence holds one of these: a text without them is not looked at further.
ANCHORS = ("licen", "permi", "copyright", "redistribution", "name of", "software", "universal", "creative", "rights")

PARAGRAPH = re.compile(r"\n[^\S\n]*(?:[#*/;]+[^\S\n]*)?\n")
END = re.compile(r"(?<=[.!?])[\"')\]]*\s+(?=[^\sa-z0-9])")
DOT = re.compile(r"\.(?![0-9])|(?<![0-9])\.")
OTHER = re.compile(r"[^a-z0-9.]+")


def sentences_of(text: str) -> list[str]:
    """The sentences of a text, in order; a full stop before a small letter or a digit ends none."""
    return [s for p in PARAGRAPH.split(text) for s in END.split(p)]


def normalise(sentence: str) -> str:
    """Lower case; everything but letters, digits and dots inside numbers becomes one space."""
    return OTHER.sub(" ", DOT.sub(" ", sentence.lower())).strip()


class Scanner:
    """Finds the licences of a text."""

    def __init__(self, sentences: dict[str, str] = SENTENCES, rules=RULES):
        self.rules = rules
        self.anchors = ANCHORS if all(any(a in s for a in ANCHORS) for s in sentences) else ("",)
        self.automaton = ahocorasick.Automaton()
        for sentence, name in sentences.items():
            self.automaton.add_word(f" {sentence} ", (len(sentence) + 1, name))
        self.automaton.make_automaton()

    def identify(self, sentence: str) -> list[str]:
        """Identifiers of the known sentences within one sentence, in order; of overlapping ones the longer."""
        low = sentence.lower()
        if not any(a in low for a in self.anchors):
            return []
        found, upto, out = sorted((end - n, -end, name) for end, (n, name) in self.automaton.iter(f" {normalise(low)} ")), 0, []
        for _, end, name in found:
            if -end > upto:
                out.append(name)
                upto = -end
        return out

    def known(self, text: str | None) -> list[tuple[int, str]]:
        """Number of the sentence and identifier of every known sentence of a text."""
        low = (text or "").lower()
        if not any(a in low for a in self.anchors):
            return []
        return [(k, name) for k, s in enumerate(sentences_of(text or "")) for name in self.identify(s)]

    def find(self, text: str | None) -> list[tuple[str, int, int]]:
        """Licence, number of the first sentence and of identified sentences, in the order of the text."""
        known, out, at = self.known(text), [], 0
        near = lambda a, b: b[0] - a[0] <= MAX_GAP + 1
        while at < len(known):
            after = known[at + 1] if at + 1 < len(known) else None
            notice = known[at][1] in NOTICES and after and after[1] not in NOTICES and near(known[at], after)
            for ids, name in () if notice else self.rules:
                run = known[at : at + len(ids)]
                if tuple(i for _, i in run) == ids and all(near(a, b) for a, b in zip(run, run[1:], strict=False)):
                    out.append((name, run[0][0], len(ids)))
                    at += len(ids)
                    break
            else:
                at += 1
        return out


def licences(docs: DataFrame, text: str = "text", out: str = "licences", sentences: dict[str, str] = SENTENCES, rules=RULES) -> DataFrame:
    """`docs` with the column `out`: structs of licence, sentence (number of the first) and sentences, in text order.

    Null and empty texts have none; repeated rows have equal results; an empty table gives an empty result. A column
    that is already named `out` is replaced.
    """
    made: list[Scanner] = []

    @F.pandas_udf("array<struct<licence:string,sentence:int,sentences:int>>")
    def of(texts: pd.Series) -> pd.Series:
        if not made:
            made.append(Scanner(sentences, rules))
        return pd.Series([[{"licence": a, "sentence": b, "sentences": c} for a, b, c in made[0].find(t)] for t in texts])

    return docs.withColumn(out, of(F.col(text)))


def op8(spark, sf_dir: str) -> DataFrame:
    """doc_id, n_licences, licences (names in text order) and places (first sentences) of every document."""
    found = licences(table(spark, sf_dir, "documents").select("doc_id", "text"), out="_found")
    return found.select(
        "doc_id", F.size("_found").cast("long").alias("n_licences"),
        F.array_join(F.transform("_found", lambda x: x["licence"]), ",").alias("licences"),
        F.array_join(F.transform("_found", lambda x: x["sentence"].cast("string")), ",").alias("places"),
    )


QUERIES = {"op8_license_scan": op8}
SQL: dict[str, str] = {}
