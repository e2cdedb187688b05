"""Signature rules of licences: ordered patterns, each behind two keywords.

A rule is a label, a priority (0 goes first), a confidence, two keywords that must begin in a text
before the pattern is tried, and a pattern for texts with letters folded. Both keywords are in
whatever the pattern matches: names of different words are families of their own. Keywords are held
against the words of a text joined by single spaces; a space of a pattern stands for any white
space, with the comment leaders of lines that begin in it. Rules are made from a list
of licence families and a few ways to name a licence, and from phrases of licence texts.
"""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Rule:
    label: str
    priority: int
    confidence: float
    keyword: str
    second: str
    pattern: str


PRIORITIES = 4

# Label, SPDX identifiers, a keyword of the name, the name as a pattern.
FAMILIES = [
    ("mit", ["mit"], "mit", r"(?:the )?mit(?: \(expat\))?"),
    ("mit-0", ["mit-0"], "mit", r"(?:the )?mit no attribution"),
    ("apache-2", ["apache-2\\.0"], "apache", r"(?:the )?apache(?: software)?(?: license)?,? ?(?:version|v)?\.? ?2(?:\.0)?"),
    ("apache-1.1", ["apache-1\\.1"], "apache", r"(?:the )?apache(?: software)?(?: license)?,? ?(?:version|v)?\.? ?1\.1"),
    ("bsd-2-clause", ["bsd-2-clause"], "bsd", r"(?:the )?(?:bsd[ -]2[ -]clause|2[ -]clause bsd|simplified bsd)"),
    ("bsd-2-clause", [], "freebsd", r"(?:the )?freebsd"),
    ("bsd-3-clause", ["bsd-3-clause"], "bsd", r"(?:the )?(?:bsd[ -]3[ -]clause|3[ -]clause bsd|new bsd|modified bsd)"),
    ("bsd-4-clause", ["bsd-4-clause"], "bsd", r"(?:the )?(?:bsd[ -]4[ -]clause|4[ -]clause bsd|original bsd)"),
    ("bsd", ["0bsd"], "bsd", r"(?:the |a )?bsd(?:[ -]style)?"),
    ("gpl-2", ["gpl-2\\.0(?:-only|-or-later|\\+)?"], "gpl", r"(?:the )?(?:gnu )?gpl(?:,? ?(?:version|v))?\.? ?2(?:\.0)?"),
    ("gpl-3", ["gpl-3\\.0(?:-only|-or-later|\\+)?"], "gpl", r"(?:the )?(?:gnu )?gpl(?:,? ?(?:version|v))?\.? ?3(?:\.0)?"),
    ("lgpl-2.1", ["lgpl-2\\.1(?:-only|-or-later|\\+)?"], "lgpl", r"(?:the )?(?:gnu )?lgpl(?:,? ?(?:version|v))?\.? ?2(?:\.[01])?"),
    ("lgpl-3", ["lgpl-3\\.0(?:-only|-or-later|\\+)?"], "lgpl", r"(?:the )?(?:gnu )?lgpl(?:,? ?(?:version|v))?\.? ?3(?:\.0)?"),
    ("agpl-3", ["agpl-3\\.0(?:-only|-or-later)?"], "agpl", r"(?:the )?(?:gnu )?agpl(?:,? ?(?:version|v))?\.? ?3(?:\.0)?"),
    ("gpl-2", [], "general public", r"(?:the )?gnu general public licen[cs]e,? (?:version|v)\.? ?2(?:\.0)?"),
    ("gpl-3", [], "general public", r"(?:the )?gnu general public licen[cs]e,? (?:version|v)\.? ?3(?:\.0)?"),
    ("lgpl-2.1", [], "lesser general", r"(?:the )?gnu lesser general public licen[cs]e,? (?:version|v)\.? ?2(?:\.1)?"),
    ("lgpl-3", [], "lesser general", r"(?:the )?gnu lesser general public licen[cs]e,? (?:version|v)\.? ?3(?:\.0)?"),
    ("agpl-3", [], "affero", r"(?:the )?gnu affero general public licen[cs]e,? (?:version|v)\.? ?3(?:\.0)?"),
    ("mpl-2", ["mpl-2\\.0"], "mozilla", r"(?:the )?mozilla public licen[cs]e,? ?(?:version|v)?\.? ?2(?:\.0)?"),
    ("mpl-1.1", ["mpl-1\\.1"], "mozilla", r"(?:the )?mozilla public licen[cs]e,? ?(?:version|v)?\.? ?1\.1"),
    ("epl-1", ["epl-1\\.0"], "eclipse", r"(?:the )?eclipse public licen[cs]e(?: -)?,? ?(?:version|v)?\.? ?1(?:\.0)?"),
    ("epl-2", ["epl-2\\.0"], "eclipse", r"(?:the )?eclipse public licen[cs]e(?: -)?,? ?(?:version|v)?\.? ?2(?:\.0)?"),
    ("cddl-1", ["cddl-1\\.[01]"], "cddl", r"(?:the )?cddl"),
    ("cddl-1", [], "common development", r"(?:the )?common development and distribution licen[cs]e"),
    ("cpl-1", ["cpl-1\\.0"], "common public", r"(?:the )?common public licen[cs]e"),
    ("artistic-2", ["artistic-2\\.0"], "artistic", r"(?:the )?artistic licen[cs]e,? ?(?:version|v)?\.? ?2(?:\.0)?"),
    ("isc", ["isc"], "isc", r"(?:the )?isc"),
    ("zlib", ["zlib"], "zlib", r"(?:the )?zlib(?:/libpng)?"),
    ("bsl-1", ["bsl-1\\.0"], "boost", r"(?:the )?boost software licen[cs]e"),
    ("busl-1.1", ["busl-1\\.1"], "business source", r"(?:the )?business source licen[cs]e"),
    ("unlicense", ["unlicense"], "unlicense", r"(?:the )?unlicense"),
    ("wtfpl", ["wtfpl"], "wtfpl", r"(?:the )?wtfpl"),
    ("eupl-1.2", ["eupl-1\\.[12]"], "eupl", r"(?:the )?eupl"),
    ("eupl-1.2", [], "european union public", r"(?:the )?european union public licen[cs]e"),
    ("upl-1", ["upl-1\\.0"], "universal permissive", r"(?:the )?universal permissive licen[cs]e"),
    ("ms-pl", ["ms-pl"], "microsoft public", r"(?:the )?microsoft public licen[cs]e"),
    ("ms-rl", ["ms-rl"], "microsoft reciprocal", r"(?:the )?microsoft reciprocal licen[cs]e"),
    ("osl-3", ["osl-3\\.0"], "open software", r"(?:the )?open software licen[cs]e"),
    ("afl-3", ["afl-3\\.0"], "academic free", r"(?:the )?academic free licen[cs]e"),
    ("ofl-1.1", ["ofl-1\\.1"], "open font", r"(?:the )?(?:sil )?open font licen[cs]e"),
    ("odbl-1", ["odbl-1\\.0"], "open database", r"(?:the )?open database licen[cs]e"),
    ("psf-2", ["psf-2\\.0", "python-2\\.0"], "python software", r"(?:the )?python software foundation licen[cs]e"),
    ("php-3", ["php-3\\.01?"], "php", r"(?:the )?php licen[cs]e"),
    ("postgresql", ["postgresql"], "postgresql", r"(?:the )?postgresql"),
    ("sspl-1", ["sspl-1\\.0"], "server side public", r"(?:the )?server side public licen[cs]e"),
    ("elastic-2", ["elastic-2\\.0"], "elastic", r"(?:the )?elastic licen[cs]e"),
    ("cc0", ["cc0-1\\.0"], "cc0", r"(?:the )?(?:creative commons )?cc0(?: 1\.0)?"),
    ("cc-by", ["cc-by-[1-4]\\.[05]"], "cc by", r"(?:the |a )?cc[ -]by(?: ?[1-4]\.[05])?(?![ -](?:nc|sa|nd|non|share|no))"),
    ("cc-by-sa", ["cc-by-sa-[1-4]\\.[05]"], "cc by", r"(?:the |a )?(?:cc[ -]by[ -]sa)(?: ?[1-4]\.[05])?"),
    ("cc-by-nd", ["cc-by-nd-[1-4]\\.[05]"], "cc by", r"(?:the |a )?(?:cc[ -]by[ -]nd)(?: ?[1-4]\.[05])?"),
    ("cc-by-nc", ["cc-by-nc-[1-4]\\.[05]"], "cc by", r"(?:the |a )?(?:cc[ -]by[ -]nc)(?![ -](?:sa|nd))(?: ?[1-4]\.[05])?"),
    ("cc-by-nc-sa", ["cc-by-nc-sa-[1-4]\\.[05]"], "cc by", r"(?:the |a )?(?:cc[ -]by[ -]nc[ -]sa)(?: ?[1-4]\.[05])?"),
    ("cc-by-nc-nd", ["cc-by-nc-nd-[1-4]\\.[05]"], "cc by", r"(?:the |a )?(?:cc[ -]by[ -]nc[ -]nd)(?: ?[1-4]\.[05])?"),
    ("cc-by", [], "creative commons", r"(?:the |a )?creative commons[ -]attribution(?:[ -]international)?(?: ?[1-4]\.[05])?(?![ -](?:non|share|no))"),
    ("cc-by-sa", [], "creative commons", r"(?:the |a )?creative commons[ -]attribution[ -]share[ -]?alike"),
    ("cc-by-nd", [], "creative commons", r"(?:the |a )?creative commons[ -]attribution[ -]no[ -]?deriv(?:s|atives)"),
    ("cc-by-nc", [], "creative commons", r"(?:the |a )?creative commons[ -]attribution[ -]non[ -]?commercial(?![ -](?:share|no))"),
    ("cc-by-nc-sa", [], "creative commons", r"(?:the |a )?creative commons[ -]attribution[ -]non[ -]?commercial[ -]share[ -]?alike"),
    ("cc-by-nc-nd", [], "creative commons", r"(?:the |a )?creative commons[ -]attribution[ -]non[ -]?commercial[ -]no[ -]?deriv(?:s|atives)"),
]

# Ways to name a licence: priority, confidence, second keyword, pattern around the name.
PHRASINGS = [
    (1, 0.95, "licen", r"\blicen[cs]ed under (?:the terms of )?{name}\b"),
    (1, 0.9, "under", r"\b(?:released|distributed|published|provided|available|shared|made available) under (?:the terms of )?{name}\b(?:,? licen[cs]e)?"),
    (1, 0.9, "licen", r"\blicen[cs]e ?: ?{name}\b"),
    (2, 0.8, "licen", r"\b{name} licen[cs]e\b"),
    (2, 0.8, "see", r"\bsee {name}(?: licen[cs]e)? (?:for|in)\b"),
]

# Names that stand for themselves, without a phrase around them.
BARE = {"gpl", "lgpl", "agpl", "general public", "lesser general", "affero", "mozilla", "eclipse", "cddl", "common development", "wtfpl", "eupl", "european union public", "cc by", "cc0", "creative commons"}

# Phrases of licence texts and addresses: label, priority, confidence, keywords, pattern.
PHRASES = [
    ("mit", 1, 0.95, "hereby granted", "free of charge", r"permission is hereby granted, free of charge, to any person obtaining a copy"),
    ("mit", 1, 0.95, "mit", "opensource.org", r"opensource\.org/licenses?/mit"),
    ("mit", 2, 0.8, "under the mit", "licen", r"\bunder the mit licen[cs]e\b"),
    ("apache-2", 0, 1.0, "apache.org", "license-2", r"apache\.org/licenses/license-2\.0"),
    ("apache-2", 2, 0.8, "apache license", "version 2", r"\bapache license,? version 2(?:\.0)?"),
    ("bsd-3-clause", 1, 0.9, "endorse or promote", "neither the name", r"neither the name of [\s\S]{1,120}? may be used to endorse or promote"),
    ("bsd", 2, 0.8, "redistribution and use", "binary", r"redistribution and use in source and binary forms, with or without modification"),
    ("gpl", 2, 0.8, "general public", "licen", r"gnu general public licen[cs]e"),
    ("lgpl", 2, 0.8, "lesser general", "licen", r"gnu lesser general public licen[cs]e"),
    ("lgpl", 2, 0.8, "library general", "licen", r"gnu library general public licen[cs]e"),
    ("agpl", 2, 0.8, "affero", "licen", r"gnu affero general public licen[cs]e"),
    ("gpl", 1, 0.9, "gnu.org", "licenses/gpl", r"gnu\.org/licenses/(?:old-licenses/)?gpl"),
    ("lgpl", 1, 0.9, "gnu.org", "licenses/lgpl", r"gnu\.org/licenses/(?:old-licenses/)?lgpl"),
    ("agpl", 1, 0.9, "gnu.org", "licenses/agpl", r"gnu\.org/licenses/agpl"),
    ("mpl-2", 0, 1.0, "mozilla.org", "mpl/2", r"mozilla\.org/mpl/2\.0"),
    ("epl-1", 1, 0.9, "eclipse.org", "epl-v10", r"eclipse\.org/legal/epl-v10"),
    ("epl-2", 1, 0.9, "eclipse.org", "epl-2", r"eclipse\.org/legal/epl-2\.0"),
    ("bsl-1", 1, 0.9, "boost.org", "license_1_0", r"boost\.org/license_1_0"),
    ("isc", 1, 0.9, "permission to use, copy, modify", "with or without fee", r"permission to use, copy, modify,? and(?:/or)? distribute this software for any purpose with or without fee"),
    ("zlib", 1, 0.9, "altered source versions", "misrepresented", r"altered source versions must be plainly marked as such"),
    ("unlicense", 1, 0.9, "free and unencumbered", "public domain", r"this is free and unencumbered software released into the public domain"),
    ("wtfpl", 1, 0.9, "do what the fuck", "public licen", r"do what the fuck you want to public licen[cs]e"),
    ("public-domain", 2, 0.8, "public domain", "domain", r"\b(?:released|placed|dedicated|published)? ?(?:in|into|to) the public domain\b"),
    ("cc0", 0, 1.0, "creativecommons.org", "zero", r"creativecommons\.org/publicdomain/zero"),
    ("cc-by", 0, 1.0, "creativecommons.org", "licenses/by/", r"creativecommons\.org/licenses/by/"),
    ("cc-by-sa", 0, 1.0, "creativecommons.org", "licenses/by-sa", r"creativecommons\.org/licenses/by-sa"),
    ("cc-by-nd", 0, 1.0, "creativecommons.org", "licenses/by-nd", r"creativecommons\.org/licenses/by-nd"),
    ("cc-by-nc", 0, 1.0, "creativecommons.org", "licenses/by-nc/", r"creativecommons\.org/licenses/by-nc/"),
    ("cc-by-nc-sa", 0, 1.0, "creativecommons.org", "licenses/by-nc-sa", r"creativecommons\.org/licenses/by-nc-sa"),
    ("cc-by-nc-nd", 0, 1.0, "creativecommons.org", "licenses/by-nc-nd", r"creativecommons\.org/licenses/by-nc-nd"),
    ("copyright", 3, 0.5, "all rights reserved", "reserved", r"\ball rights reserved\b"),
    ("copyright", 3, 0.4, "copyright", "copyright", r"\bcopyright (?:\(c\)|©)? ?(?:19|20)[0-9]{2}\b"),
    ("proprietary", 2, 0.7, "confidential", "proprietary", r"\b(?:confidential and proprietary|proprietary and confidential)\b"),
    ("proprietary", 2, 0.6, "prior written", "without the", r"\bwithout the (?:express )?prior written (?:permission|consent)\b"),
]


# White space; where a line begins in it, with what leads comments and quoted text there.
_GAP = r"(?:[ \t\f\r]*+\n\s*+(?:(?://+|/?\*+/?|#+|;+|--+|>+|%+|\|+|dnl|rem)\s++)*+|\s++)"


def _keyword(text: str) -> str:
    """A keyword as words joined by spaces begin with it; common words must be whole."""
    words = " ".join("".join(c if c.isalnum() else " " for c in text).split())
    return f" {words} " if words in ("under", "see") else f" {words}"


def _spaced(pattern: str) -> str:
    """The pattern with any gap where it has a space."""
    return pattern.replace("[ -]", "(?:\0|-)").replace(" ", "\0").replace("\0", _GAP)


def rules() -> list[Rule]:
    """All rules in their order."""
    out = [Rule(label, 0, 1.0, "spdx", "spdx license identifier", rf"spdx-license-identifier: ?\(?{spdx}(?![a-z0-9.+-])")
           for label, ids, _, _ in FAMILIES for spdx in ids]
    for label, _, keyword, name in FAMILIES:
        out += [Rule(label, p, c, keyword, second, pattern.replace("{name}", name)) for p, c, second, pattern in PHRASINGS]
        if keyword in BARE:
            out.append(Rule(label, 3, 0.6, keyword, keyword, rf"\b{name}\b"))
    out += [Rule(*p) for p in PHRASES]
    return [Rule(r.label, r.priority, r.confidence, _keyword(r.keyword), _keyword(r.second), _spaced(r.pattern)) for r in out]
