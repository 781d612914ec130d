"""License scans by ordered signature rules over the normalised words of a text."""

from __future__ import annotations

import re
from bisect import bisect_right
from dataclasses import dataclass
from itertools import accumulate, product

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from assay.llm.common import map_column

#: Lower-cases A-Z and turns every other byte that is no digit, letter or part of a non-ASCII character into a space.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))
#: Phrases of the contract and their labels. Fixed values.
BASE = [("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved")]


@dataclass(frozen=True)
class Rule:
    """priority: lower goes first. keywords: sets of words; the pattern is tried on texts that have all words of one."""

    priority: int
    label: str
    keywords: tuple[frozenset[str], ...]
    pattern: re.Pattern
    confidence: float


def _rule(priority: int, label: str, keywords: str, pattern: str, confidence: float) -> Rule:
    """keywords: sets of words, split by |; every text that the pattern matches must have all words of one set."""
    needs = tuple(frozenset(k.split()) for k in keywords.split("|"))
    return Rule(priority, label, needs, re.compile(rf"(?<= )(?:{pattern})(?= )".encode()), confidence)


#: label, keywords (as in _rule), how texts name the license (words), its identifier (words)
NAMED = [
    ("apache-1.1", "apache", r"apache (?:software )?licen[sc]e (?:version |v ?)?1 1", "apache 1 1"),
    ("apache-2.0", "apache", r"apache (?:public |software )?licen[sc]e (?:version |v ?)?2(?: 0)?", "apache 2 0"),
    ("mit", "mit", r"(?:the )?mit (?:expat )?licen[sc]e", "mit"),
    ("x11", "x11", r"(?:mit )?x11 licen[sc]e", "x11"),
    ("bsd-2-clause", "bsd", r"(?:2|two) clause bsd licen[sc]e|(?:simplified|freebsd) bsd licen[sc]e|bsd 2 clause(?: licen[sc]e)?", "bsd 2 clause"),
    ("bsd-3-clause", "bsd", r"(?:3|three) clause bsd licen[sc]e|(?:new|revised|modified) bsd licen[sc]e|bsd 3 clause(?: licen[sc]e)?", "bsd 3 clause"),
    ("bsd-4-clause", "bsd", r"(?:4|four) clause bsd licen[sc]e|original bsd licen[sc]e|bsd 4 clause(?: licen[sc]e)?", "bsd 4 clause"),
    ("isc", "isc", r"isc licen[sc]e", "isc"),
    ("mpl-1.1", "mozilla", r"mozilla public licen[sc]e (?:version |v ?)?1 1", "mpl 1 1"),
    ("mpl-2.0", "mozilla", r"mozilla public licen[sc]e (?:version |v ?)?2(?: 0)?", "mpl 2 0"),
    ("epl-1.0", "eclipse", r"eclipse public licen[sc]e (?:version |v ?)?1(?: 0)?", "epl 1 0"),
    ("epl-2.0", "eclipse", r"eclipse public licen[sc]e (?:version |v ?)?2(?: 0)?", "epl 2 0"),
    ("cddl-1.0", "development distribution", r"common development and distribution licen[sc]e(?: (?:version |v ?)?1(?: 0)?)?", "cddl 1 0"),
    ("cpl-1.0", "common", r"common public licen[sc]e(?: (?:version |v ?)?1(?: 0)?)?", "cpl 1 0"),
    ("artistic-1.0", "artistic", r"artistic licen[sc]e (?:version |v ?)?1(?: 0)?", "artistic 1 0"),
    ("artistic-2.0", "artistic", r"artistic licen[sc]e (?:version |v ?)?2(?: 0)?", "artistic 2 0"),
    ("zlib", "zlib", r"zlib(?: libpng)? licen[sc]e", "zlib"),
    ("bsl-1.0", "boost", r"boost software licen[sc]e(?: (?:version |v ?)?1 0)?", "bsl 1 0"),
    ("unlicense", "unlicense", r"(?:the )?unlicense", "unlicense"),
    ("wtfpl", "wtfpl", r"wtfpl(?: version 2)?", "wtfpl"),
    ("ofl-1.1", "sil", r"sil open font licen[sc]e(?: (?:version |v ?)?1 1)?", "ofl 1 1"),
    ("psf-2.0", "python", r"python software foundation licen[sc]e(?: version 2)?", "psf 2 0"),
    ("php-3.01", "php", r"php licen[sc]e (?:version |v ?)?3 01", "php 3 01"),
    ("ruby", "ruby", r"ruby licen[sc]e|same terms as ruby", "ruby"),
    ("perl", "perl", r"same terms as perl(?: itself)?", "artistic 1 0 perl"),
    ("eupl-1.2", "eupl|european union public", r"european union public licen[sc]e(?: (?:version |v ?)?1 2)?|eupl(?: v ?1 2)?", "eupl 1 2"),
    ("ms-pl", "microsoft", r"microsoft public licen[sc]e", "ms pl"),
    ("ms-rl", "microsoft", r"microsoft reciprocal licen[sc]e", "ms rl"),
    ("ncsa", "illinois", r"university of illinois ncsa open source licen[sc]e", "ncsa"),
    ("openssl", "openssl", r"openssl licen[sc]e", "openssl"),
    ("odbl-1.0", "database", r"open (?:data commons open )?database licen[sc]e(?: v ?1 0)?", "odbl 1 0"),
    ("odc-by-1.0", "attribution", r"open data commons attribution licen[sc]e", "odc by 1 0"),
    ("pddl-1.0", "dedication", r"public domain dedication and licen[sc]e", "pddl 1 0"),
    ("cc0-1.0", "cc0", r"(?:creative commons )?cc0(?: 1 0)?(?: universal)?", "cc0 1 0"),
    ("postgresql", "postgresql", r"postgresql licen[sc]e", "postgresql"),
    ("ijg", "jpeg", r"independent jpeg group(?: s)? licen[sc]e", "ijg"),
    ("upl-1.0", "universal", r"universal permissive licen[sc]e(?: v ?1 0)?", "upl 1 0"),
    ("osl-3.0", "open", r"open software licen[sc]e (?:version |v ?)?3 0", "osl 3 0"),
    ("afl-3.0", "academic", r"academic free licen[sc]e (?:version |v ?)?3 0", "afl 3 0"),
    ("gfdl", "documentation", r"(?:gnu )?free documentation licen[sc]e(?: (?:version )?1 [123])?", "gfdl 1 3"),
    ("vim", "vim", r"vim licen[sc]e", "vim"),
    ("curl", "curl", r"curl licen[sc]e", "curl"),
    ("beerware", "beer|beerware", r"beer ?ware licen[sc]e", "beerware"),
    ("json", "json", r"json licen[sc]e", "json"),
    ("hpnd", "historical", r"historical permission notice(?: and disclaimer)?", "hpnd"),
    ("sspl-1.0", "server", r"server side public licen[sc]e", "sspl 1 0"),
    ("busl-1.1", "business", r"business source licen[sc]e(?: 1 1)?", "busl 1 1"),
    ("elastic-2.0", "elastic", r"elastic licen[sc]e (?:version |v ?)?2 0", "elastic 2 0"),
    ("mit-0", "attribution", r"mit no attribution(?: licen[sc]e)?", "mit 0"),
    ("0bsd", "zero|0bsd", r"(?:bsd )?zero clause(?: bsd)? licen[sc]e|zero clause bsd", "0bsd"),
    ("bsd-3-clause-clear", "clear", r"(?:the )?clear bsd licen[sc]e", "bsd 3 clause clear"),
    ("edl-1.0", "eclipse", r"eclipse distribution licen[sc]e(?: (?:version |v ?)?1 0)?", "edl 1 0"),
    ("eupl-1.1", "european", r"european union public licen[sc]e (?:version |v ?)?1 1", "eupl 1 1"),
    ("afl-2.1", "academic", r"academic free licen[sc]e (?:version |v ?)?2 1", "afl 2 1"),
    ("apsl-2.0", "apple", r"apple public source licen[sc]e(?: (?:version |v ?)?2 0)?", "apsl 2 0"),
    ("ipl-1.0", "ibm", r"ibm public licen[sc]e(?: (?:version |v ?)?1 0)?", "ipl 1 0"),
    ("cpal-1.0", "attribution", r"common public attribution licen[sc]e(?: (?:version |v ?)?1 0)?", "cpal 1 0"),
    ("cecill-2.1", "cecill", r"cecill (?:free software )?licen[sc]e(?: agreement)? (?:version |v ?)?2 1", "cecill 2 1"),
    ("cecill-b", "cecill", r"cecill b(?: free software)? licen[sc]e", "cecill b"),
    ("cecill-c", "cecill", r"cecill c(?: free software)? licen[sc]e", "cecill c"),
    ("lppl-1.3c", "latex", r"latex project public licen[sc]e(?: (?:version |v ?)?1 3c?)?", "lppl 1 3c"),
    ("mulanpsl-2.0", "mulan", r"mulan permissive software licen[sc]e(?: (?:version |v ?)?2)?|mulan psl v2", "mulanpsl 2 0"),
    ("nasa-1.3", "nasa", r"nasa open source agreement(?: (?:version |v ?)?1 3)?", "nasa 1 3"),
    ("qpl-1.0", "public", r"q public licen[sc]e(?: (?:version |v ?)?1 0)?", "qpl 1 0"),
    ("rpl-1.5", "reciprocal", r"reciprocal public licen[sc]e(?: (?:version |v ?)?1 5)?", "rpl 1 5"),
    ("sleepycat", "sleepycat", r"sleepycat licen[sc]e", "sleepycat"),
    ("tcl", "tcl", r"tcl(?: tk)? licen[sc]e", "tcl"),
    ("unicode-dfs-2016", "unicode", r"unicode (?:inc )?licen[sc]e(?: agreement)?", "unicode dfs 2016"),
    ("w3c", "w3c", r"w3c software(?: notice)?(?: and document)?(?: and)? licen[sc]e", "w3c"),
    ("zpl-2.1", "zope", r"zope public licen[sc]e(?: (?:version |v ?)?2 1)?", "zpl 2 1"),
    ("libpng", "libpng", r"libpng licen[sc]e(?: (?:version |v ?)?2)?", "libpng 2 0"),
    ("bzip2-1.0.6", "bzip2", r"bzip2(?: libbzip2)? licen[sc]e", "bzip2 1 0 6"),
    ("info-zip", "info", r"info zip licen[sc]e", "info zip"),
    ("icu", "icu", r"icu licen[sc]e", "icu"),
    ("ftl", "freetype", r"freetype (?:project )?licen[sc]e", "ftl"),
    ("intel", "intel", r"intel open source licen[sc]e", "intel"),
    ("naist-2003", "nara", r"nara institute of science and technology licen[sc]e", "naist 2003"),
    ("watcom-1.0", "watcom", r"(?:sybase open )?watcom(?: public)? licen[sc]e(?: 1 0)?", "watcom 1 0"),
    ("sissl", "sun", r"sun industry standards source licen[sc]e(?: (?:version |v ?)?1 1)?", "sissl"),
    ("oclc-2.0", "oclc", r"oclc research public licen[sc]e(?: 2 0)?", "oclc 2 0"),
    ("ecl-2.0", "educational", r"educational community licen[sc]e(?: (?:version |v ?)?2 0)?", "ecl 2 0"),
    ("cdla-permissive-2.0", "community", r"community data licen[sc]e agreement permissive(?: (?:version |v ?)?2 0)?", "cdla permissive 2 0"),
    ("cdla-sharing-1.0", "sharing", r"community data licen[sc]e agreement sharing(?: (?:version |v ?)?1 0)?", "cdla sharing 1 0"),
    ("etalab-2.0", "etalab", r"etalab open licen[sc]e(?: (?:version |v ?)?2 0)?|licence ouverte etalab(?: 2 0)?", "etalab 2 0"),
    ("nlod-2.0", "norwegian", r"norwegian licen[sc]e for open government data(?: nlod)?(?: 2 0)?", "nlod 2 0"),
    ("dl-de-by-2.0", "datenlizenz", r"datenlizenz deutschland namensnennung(?: (?:version )?2 0)?", "dl de by 2 0"),
    ("ogl-1.0a", "game|gaming", r"open gam(?:e|ing) licen[sc]e(?: (?:version |v ?)?1 0a)?", "ogl 1 0a"),
    ("polyform-noncommercial-1.0.0", "polyform", r"polyform noncommercial(?: licen[sc]e)?(?: 1 0 0)?", "polyform noncommercial 1 0 0"),
    ("polyform-small-business-1.0.0", "polyform", r"polyform small business(?: licen[sc]e)?(?: 1 0 0)?", "polyform small business 1 0 0"),
    ("hippocratic-2.1", "hippocratic", r"hippocratic licen[sc]e(?: (?:version |v ?)?2 1)?", "hippocratic 2 1"),
    ("parity-7.0.0", "parity", r"parity public licen[sc]e(?: 7 0 0)?", "parity 7 0 0"),
    ("llama-2", "llama", r"llama 2 community licen[sc]e(?: agreement)?", "llama2"),
    ("llama-3", "llama", r"(?:meta )?llama 3(?: [123])? community licen[sc]e(?: agreement)?", "llama3"),
    ("gemma", "gemma", r"gemma terms of use|gemma licen[sc]e", "gemma"),
    ("openrail", "rail|openrail|bigsciencerail|sciencerail|bigcoderail", r"(?:open|big ?science|bigcode) ?rail(?: m)? licen[sc]e", "openrail"),
]

#: Identifiers that name a license beside the word license alone, without being words of their own elsewhere.
BARE = {"mit", "isc", "zlib", "x11", "unlicense", "wtfpl", "ncsa", "0bsd", "beerware", "hpnd", "ijg", "curl", "postgresql", "sleepycat", "ftl", "openrail"}
VERSION = "(?:version |ver |v ?)?"

GNU = {"gpl": ("", ("1", "2", "3")), "lgpl": ("(?:lesser|library) ", ("2", "2 1", "3")), "agpl": ("affero ", ("1", "3"))}
CC = {"by": "attribution", "by-sa": "attribution share ?alike", "by-nc": "attribution non ?commercial", "by-nd": "attribution no ?deriv(?:ative)?s?", "by-nc-sa": "attribution non ?commercial share ?alike", "by-nc-nd": "attribution non ?commercial no ?deriv(?:ative)?s?"}

#: Sentences of license texts and notices.
TEXTS = [
    (3, "bsd", "bsd", r"bsd(?: style| type)? licen[sc]ed?|licensed under(?: the)?(?: an?)? bsd", 0.7),
    (3, "apache", "apache", r"apache (?:software )?licen[sc]ed?|licensed under(?: the)? apache", 0.6),
    (3, "mpl", "mozilla", r"mozilla public licen[sc]ed?", 0.7),
    (3, "epl", "eclipse", r"eclipse public licen[sc]e", 0.7),
    (3, "artistic", "artistic", r"(?:the )?artistic licen[sc]e", 0.7),
    (3, "mit", "mit", r"mit style licen[sc]ed?", 0.7),
    (3, "creative-commons", "creative commons", r"creative commons(?: public)? licen[sc]ed?", 0.7),
    (2, "cc0-1.0", "creativecommons zero", r"creativecommons org publicdomain zero 1 0", 1.0),
    (3, "cc0-1.0", "creative zero", r"creative commons zero(?: licen[sc]e)?(?: 1 0)?", 0.85),
    (2, "public-domain", "creativecommons mark", r"creativecommons org publicdomain mark 1 0", 0.95),
    (3, "public-domain", "public domain", r"public domain (?:mark|dedication|work|book|notice)", 0.6),
    (3, "public-domain", "known copyright restrictions", r"no known copyright restrictions", 0.7),
    (2, "commons-clause", "commons clause", r"commons clause(?: licen[sc]e)? condition|subject to the following condition under the commons clause", 0.85),
    (2, "gnu-all-permissive", "copying distribution permitted", r"copying and distribution of this file with or without modification are permitted in any medium without royalty", 0.95),
    (2, "bsd-source-code", "source retain", r"redistributions? in source form must retain the(?: above)? copyright notice", 0.8),
    (2, "mit-disclaimer", "warranties merchantability noninfringement", r"including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement", 0.6),
    (2, "unlicense", "free copy modify", r"anyone is free to copy modify publish use compile sell or distribute this software", 0.95),
    (2, "wtfpl", "want public", r"do what the (?:fuck|f ?ck|heck) you want to public licen[sc]e", 1.0),
    (2, "apache-2.0", "contributor perpetual", r"each contributor hereby grants to you a perpetual worldwide non exclusive no charge royalty free irrevocable copyright licen[sc]e", 0.95),
    (2, "mpl-2.0", "secondary incompatible", r"this source code form is incompatible with secondary licen[sc]es", 0.9),
    (2, "gpl", "general applies foundation", r"this general public licen[sc]e applies to most of the free software foundation s software", 0.9),
    (2, "lgpl", "lesser applies", r"this licen[sc]e the lesser general public licen[sc]e applies to some", 0.9),
    (2, "agpl", "affero copyleft", r"the gnu affero general public licen[sc]e is a free copyleft licen[sc]e", 0.95),
    (2, "ofl-1.1", "font licensed sil", r"this font software is licensed under the sil open font licen[sc]e", 1.0),
    (2, "openssl", "product includes openssl", r"this product includes software developed by the openssl project", 0.9),
    (2, "bsd-4-clause", "product includes university", r"this product includes software developed by the university of california(?: berkeley)?(?: and its contributors)?", 0.9),
    (2, "apache-1.1", "product includes apache", r"this product includes software developed by the apache software foundation", 0.8),
    (3, "proprietary", "not be without", r"(?:may|must|shall|can) not be (?:reproduced|used|distributed|republished|broadcast|published|transmitted|disclosed|reprinted|rewritten|sold)(?: [^ ]+){0,12} without (?:the )?(?:prior |express |explicit |written |our )*(?:permission|consent|authori[sz]ation)", 0.75),
    (3, "proprietary", "without permission", r"(?:reproduction|redistribution|copying|reuse|use) (?:[^ ]+ ){0,6}without (?:prior |express |written )*permission (?:[^ ]+ ){0,4}is (?:strictly )?(?:prohibited|forbidden)", 0.75),
    (3, "proprietary", "strictly", r"(?:reproduction|redistribution|copying|distribution)(?: [^ ]+){0,6} (?:is|are) strictly (?:prohibited|forbidden)", 0.7),
    (3, "proprietary", "property", r"is the (?:sole|exclusive) property of", 0.5),
    (3, "proprietary", "internal only", r"for internal use only", 0.6),
    (3, "by-permission", "permission", r"(?:with|by) (?:the )?(?:kind |express |written )*permission (?:of|from) the (?:author|authors|publisher|copyright holder|copyright owner)", 0.6),
    (3, "non-commercial", "commercial", r"(?:not for|no) commercial (?:use|purposes|redistribution)|commercial use is (?:not permitted|prohibited|not allowed)", 0.6),
    (3, "no-derivatives", "derivative|derivatives", r"no derivative(?: work)?s (?:are |is )?(?:allowed|permitted)|derivative works are not (?:allowed|permitted)", 0.6),
    (3, "share-alike", "share alike|sharealike", r"share ?alike (?:licen[sc]e|terms|basis)", 0.5),
    (3, "royalty-free", "royalty", r"royalty free licen[sc]e", 0.5),
    (3, "freeware", "freeware", r"(?:is|as) freeware|freeware licen[sc]e", 0.6),
    (3, "shareware", "shareware", r"(?:is|as) shareware|shareware licen[sc]e", 0.6),
    (3, "terms-of-service", "terms", r"(?:subject to|accept|agree to) (?:our|the|these) terms (?:of service|of use|and conditions)", 0.4),
    (3, "third-party-notices", "third party", r"third party (?:software )?(?:notices|licen[sc]es)", 0.4),
    (3, "stock-photo", "getty|shutterstock|pixabay|unsplash", r"getty images|shutterstock(?: com)?|(?:pixabay|unsplash) licen[sc]e", 0.5),
    (3, "youtube-standard", "youtube", r"standard youtube licen[sc]e", 0.8),
    (3, "trademark", "trademark|trademarks", r"(?:is a|are) (?:registered )?trademarks? of", 0.3),
    (4, "copyright", "copyright|copyrights|copyrighted", r"(?:all )?copyrights? (?:reserved|belongs? to|held by)|copyrighted material|protected by copyright", 0.5),
    (4, "some-rights-reserved", "some rights reserved", r"some rights reserved", 0.6),
    (2, "mit", "permission hereby granted charge", r"permission is hereby granted free of charge to any person obtaining a copy", 0.95),
    (2, "isc", "permission fee granted", r"permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", 0.95),
    (2, "bsd", "redistribution binary forms", r"redistribution and use in source and binary forms with or without modification are permitted", 0.9),
    (2, "bsd-3-clause", "neither endorse", r"neither the name of (?:[^ ]+ ){1,12}nor the names of its contributors may be used to endorse", 0.95),
    (2, "apache-2.0", "apache licenses", r"(?:http|https) www apache org licenses license 2 0", 1.0),
    (2, "mpl-2.0", "source mozilla", r"this source code form is subject to the terms of the mozilla public licen[sc]e", 1.0),
    (2, "unlicense", "unencumbered", r"this is free and unencumbered software released into the public domain", 1.0),
    (3, "public-domain", "domain", r"(?:released|placed|dedicated) (?:in|into|to) the public domain|is in the public domain", 0.8),
    (3, "gpl-or-later", "option later version", r"either version [123](?: 1)? of the licen[sc]e or at your option any later version", 0.9),
    (3, "warranty-disclaimer", "warranty", r"(?:is )?(?:provided|distributed) (?:as is )?without (?:any )?warranty(?: of any kind)?", 0.4),
    (3, "proprietary", "confidential", r"confidential and proprietary|proprietary and confidential", 0.8),
    (3, "proprietary", "not without permission", r"(?:may|must|do) not (?:copy|redistribute|reproduce|be copied|be redistributed)(?: [^ ]+){0,6} without (?:prior )?(?:written )?permission", 0.7),
    (4, "copyright", "copyright", r"copyright (?:c )?(?:19|20)[0-9]{2}(?: (?:19|20)[0-9]{2})?", 0.5),
    (5, "licensed", "licensed", r"(?:is |are )?licensed under(?: the)?(?: terms of(?: the)?)?", 0.3),
    (5, "licensed", "license|licence", r"under the terms of the licen[sc]e|see the licen[sc]e(?: file)?", 0.3),
    (2, "mit", "copyright permission included", r"the above copyright notice and this permission notice(?: including the next paragraph)? shall be included in all copies or substantial portions", 0.9),
    (2, "bsd", "redistributions source retain", r"redistributions of source code must retain the(?: above)? copyright notice", 0.85),
    (2, "bsd", "redistributions binary reproduce", r"redistributions in binary form must reproduce the above copyright notice", 0.85),
    (2, "bsd-4-clause", "advertising materials display", r"all advertising materials mentioning features or use of this software must display the following acknowledge?ment", 0.95),
    (2, "apache-2.0", "compliance license", r"you may not use this (?:file|software|work) except in compliance with the license", 0.85),
    (2, "apache-2.0", "language governing limitations", r"see the license for the specific language governing permissions and limitations under the license", 0.9),
    (2, "gpl", "free redistribute gnu", r"this (?:program|library|file|software|package) is free software you can redistribute it and or modify it under the terms of the gnu", 0.9),
    (2, "gpl", "received copy gnu", r"you should have received a copy of the gnu (?:lesser |library |affero )?general public license", 0.9),
    (2, "zlib", "event authors liable", r"in no event will the authors be held liable for any damages arising from the use of this software", 0.9),
    (2, "zlib", "origin misrepresented", r"the origin of this software must not be misrepresented", 0.95),
    (2, "bsl-1.0", "organization accompanying covered", r"to any person or organization obtaining a copy of the software and accompanying documentation covered by this license", 0.95),
    (2, "json", "good evil", r"the software shall be used for good not evil", 1.0),
    (2, "beerware", "buy beer return", r"you can buy me a beer in return", 0.95),
    (2, "ofl-1.1", "reserved font name", r"(?:with )?reserved font name", 0.6),
    (2, "epl", "accompanying materials eclipse", r"this program and the accompanying materials are made available under the terms of the eclipse public licen[sc]e", 0.95),
    (2, "cddl", "subject development distribution", r"subject to the terms of the common development and distribution licen[sc]e", 0.95),
    (2, "mpl", "contents subject mozilla", r"the contents of this file are subject to the mozilla public licen[sc]e", 0.95),
    (2, "psf-2.0", "psf python licensee", r"psf is making python(?: [0-9]+)*(?: software in source or binary form)?(?: and its associated documentation)? available to licensee", 0.95),
    (2, "openssl", "openssl toolkit", r"developed by the openssl project for use in the openssl toolkit", 0.95),
    (2, "cc0-1.0", "copyright related neighboring", r"(?:waived|waives|waiving) all copyright and related (?:or|and) neighboring rights", 0.9),
    (2, "gfdl", "permission document documentation", r"permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation licen[sc]e", 0.95),
    (2, "hpnd", "permission use copy", r"permission to use copy modify(?: sell)? and distribute this software and its documentation for any purpose", 0.85),
    (3, "creative-commons", "creative commons", r"licensed under (?:a|the) creative commons", 0.7),
    (3, "no-rights-reserved", "no rights reserved", r"no rights reserved", 0.6),
    (3, "non-commercial", "commercial|noncommercial", r"for (?:personal )?(?:and )?non ?commercial (?:use|purposes)(?: only)?", 0.6),
    (3, "research-only", "academic|research|scientific|educational", r"for (?:academic|research|scientific|educational)(?: (?:and|or) (?:academic|research|scientific|educational))? (?:use|purposes) only", 0.6),
    (3, "proprietary", "trade secrets", r"contains (?:confidential information and |proprietary information and )?trade secrets", 0.7),
    (3, "proprietary", "unauthorized prohibited", r"unauthorized (?:copying|reproduction|distribution|use)(?: of this (?:file|software|document|material))?(?: via any medium)? is (?:strictly )?prohibited", 0.8),
    (3, "proprietary", "part reproduced", r"no part of this (?:publication|book|document|work|site) may be reproduced", 0.85),
    (3, "eula", "end user agreement", r"end user licen[sc]e agreement", 0.8),
    (3, "eula", "installing agree", r"by (?:installing|downloading or installing|copying or installing) (?:the|this) software you agree", 0.7),
    (3, "by-permission", "permission", r"(?:reproduced|reprinted|republished|used)(?: here)? (?:with|by)(?: kind| the)? permission", 0.6),
    (3, "attribution-required", "attribution required", r"attribution (?:is )?required", 0.5),
    (3, "crown-copyright", "crown copyright", r"crown copyright(?: reserved)?", 0.8),
    (3, "ogl-uk", "open government", r"open government licen[sc]e(?: v(?:ersion )?[123](?: 0)?)?", 0.85),
    (3, "us-government", "work government", r"(?:is )?a work of the (?:united states|u s|us)(?: federal)? government", 0.7),
    (3, "dual", "dual|dually", r"dual(?:ly)? licen[sc]ed(?: under)?", 0.6),
    (4, "fair-use", "fair use", r"(?:under |constitutes )?fair use(?: doctrine| notice)?", 0.3),
]


def build_rules() -> list[Rule]:
    """All rules, in order: identifiers, stated licenses, texts, plain names, hints."""
    rules = []
    for label, keyword, name, ident in NAMED:
        first, dotted = ident.split()[0], " " in ident
        known = rf"{name}|{ident}" if dotted or ident in BARE else name
        rules.append(_rule(0, label, "spdx identifier " + first, f"spdx license identifier {ident}", 1.0))
        needs = f"{keyword}|{first}"
        rules.append(_rule(1, label, needs, rf"(?:licensed|released|distributed|available|published|provided) under (?:the |an? )?(?:terms of (?:the )?)?(?:{known})", 0.95))
        rules.append(_rule(1, label, first, rf"(?:opensource org licenses|spdx org licenses) {ident}", 0.95))
        rules.append(_rule(3, label, keyword, name, 0.8))
        if dotted or ident in BARE:
            rules.append(_rule(2, label, f"license {first}|licence {first}", rf"licen[sc]e(?: type| name| id)?(?: is)?(?: the)? {ident}(?: licen[sc]e)?", 0.9))
            rules.append(_rule(3, label, first, rf"{ident} licen[sc]ed?", 0.8))
        if dotted:
            words = ident.split()
            rules.append(_rule(3, label, first, rf"{words[0]} {VERSION}{' '.join(words[1:])}", 0.75))
    for short, (kind, versions) in GNU.items():
        for v in versions:
            label, dotted = f"{short}-{v.replace(' ', '.')}", v
            number = v if " " in v else rf"{v}(?: 0)?"
            later = "(?: only| or later| or any later version)?"
            rules.append(_rule(0, label, f"spdx identifier {short}", rf"spdx license identifier {short} {number}(?: only| or later)?", 1.0))
            published = "(?:as published by the free software foundation (?:either )?)?"
            rules.append(_rule(2, label, "general public", rf"(?:gnu )?{kind}general public licen[sc]e (?:{short} )?{published}{VERSION}{number}{later}", 0.95))
            rules.append(_rule(2, label, "general public", rf"version {number} of the (?:gnu )?{kind}general public licen[sc]e", 0.95))
            rules.append(_rule(2, label, f"{short}v{dotted.split()[0]}", rf"{short}v{number}", 0.9))
            rules.append(_rule(2, label, f"{short}{dotted.split()[0]}", rf"{short}{number}", 0.8))
            rules.append(_rule(3, label, short, rf"(?:gnu )?{short} (?:licen[sc]e )?{VERSION}{number}{later}", 0.85))
        rules.append(_rule(3, short, "general public", rf"(?:gnu )?{kind}general public licen[sc]e" if kind else "gnu general public licen[sc]e", 0.8))
        rules.append(_rule(4, short, short, rf"(?:gnu )?{short}(?: licen[sc]ed?)?", 0.6))
    for (code, words), v in product(CC.items(), ("1 0", "2 0", "2 5", "3 0", "4 0")):
        label, spaced = f"cc-{code}-{v.replace(' ', '.')}", code.replace("-", " ")
        rules.append(_rule(0, label, "creativecommons licenses", rf"creativecommons org licenses {spaced} {v}", 1.0))
        rules.append(_rule(2, label, "cc by", rf"cc {spaced} {v}", 0.95))
        rules.append(_rule(2, label, "commons attribution", rf"creative commons {words} (?:licen[sc]e )?{VERSION}{v}", 0.95))
        rules.append(_rule(3, label, "attribution international|attribution unported|attribution generic", rf"{words} {v} (?:international|unported|generic)", 0.9))
    for code, words in CC.items():
        rules.append(_rule(4, f"cc-{code}", "cc by", f"cc {code.replace('-', ' ')}", 0.7))
        rules.append(_rule(4, f"cc-{code}", "commons attribution", f"creative commons {words}", 0.7))
    rules += [_rule(*r) for r in TEXTS]
    return sorted(rules, key=lambda r: r.priority)


def suppress(found: list[tuple[int, int, int, int]]) -> list[tuple[int, int, int, int]]:
    """Of (priority, start, end, rule), those that lie inside no detection of an earlier priority, nor inside
    another one of the same priority (of equal intervals the earlier rule stays)."""
    kept: list[tuple[int, int, int, int]] = []
    for priority in sorted({f[0] for f in found}):
        known = sorted((s, e) for _, s, e, _ in kept)
        starts, ends = [s for s, _ in known], list(accumulate((e for _, e in known), max))
        reach = -1
        for f in sorted((f for f in found if f[0] == priority), key=lambda f: (f[1], -f[2], f[3])):
            i = bisect_right(starts, f[1])
            if f[2] <= reach or (i and ends[i - 1] >= f[2]):
                continue
            reach = max(reach, f[2])
            kept.append(f)
    return kept


class Scanner:
    def __init__(self):
        self.rules = build_rules()
        self.needs = [tuple(frozenset(k.encode() for k in n) for n in r.keywords) for r in self.rules]
        self.base = [(f" {p} ".encode(), label, frozenset(p.encode().split())) for p, label in BASE]
        # a set of keywords is looked up by its longest word, which few other texts have
        self.by_word: dict[bytes, list[tuple[int, frozenset[bytes]]]] = {}
        for k, needs in enumerate(self.needs):
            for n in needs:
                self.by_word.setdefault(max(n, key=lambda w: (len(w), w)), []).append((k, n))
        self.watched = frozenset().union(*(n for needs in self.needs for n in needs), *(n for _, _, n in self.base))

    def scan(self, text: str | None) -> tuple:
        words = (text or "").encode("utf-8").translate(FOLD).split()
        present = self.watched.intersection(words)
        if not present:
            return len(words), 0, None, None, "", "", 0.0
        joined = b" " + b" ".join(words) + b" "
        places, base_labels = [], set()
        for phrase, label, needs in self.base:
            at = joined.find(phrase) if needs <= present else -1
            while at >= 0:
                places.append(at)
                base_labels.add(label)
                at = joined.find(phrase, at + 1)
        found = [
            (rule.priority, m.start(), m.end(), k)
            for k in sorted({k for w in present for k, n in self.by_word.get(w, ()) if n <= present})
            for rule in [self.rules[k]]
            for m in rule.pattern.finditer(joined)
        ]
        own = {f[3] for f in suppress(found)}
        labels = base_labels | {self.rules[k].label for k in own}
        score = max([0.5 * bool(base_labels), *(self.rules[k].confidence for k in own)])
        first, last = (joined.count(b" ", 0, f(places)) for f in (min, max)) if places else (None, None)
        return len(words), len(places), first, last, ",".join(sorted(base_labels)), ",".join(sorted(labels)), score


FIELDS = [
    T.StructField("n_words", T.LongType()), T.StructField("n_base", T.LongType()),
    T.StructField("first_word", T.LongType()), T.StructField("last_word", T.LongType()),
    T.StructField("base_labels", T.StringType()), T.StructField("labels", T.StringType()),
    T.StructField("score", T.DoubleType()),
]


def scan_licenses(df: DataFrame, text: str = "text", drop: tuple[str, ...] = ()) -> DataFrame:
    """Add n_words, n_base, first_word, last_word, base_labels, labels and score for each whole text.

    Rules run only where all words of one of their keyword sets occur, as they do in every text that they match; of
    overlapping detections those inside one of an earlier priority go, and of equal ones of one priority the earlier rule
    stays. The labels of the base phrases always stay. score is the highest confidence of what stays.
    A null or empty text has no words, empty labels and score 0. Equal texts get equal results. Columns named like a new
    one are replaced, others stay; an empty table gives an empty one. A text is held in one task with its words.
    """
    kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64()]

    def make():
        scanner = Scanner()

        def kernel(texts):
            rows = [scanner.scan(t) for t in texts.to_pylist()]
            return [pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)]

        return kernel

    return map_column(df, text, make, FIELDS, drop)
