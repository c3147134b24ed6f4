"""The licence catalogue of operator 6: known sentences, names that references use, and ordered rules.

A tuple (SENTENCES, NAMES, RULES) of this form is a parameter of `licences.scanned`, so that a catalogue of one's own,
or this one with additions, serves as well.
"""

from __future__ import annotations

#: Sentences of public licences and notices, normalised (A-Z folded, runs of other than
#: a-z and 0-9 one blank), each with its identifier. A sentence ends at a full stop before a blank, so "v. 2.0" cuts one.
SENTENCES = {
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions": "mit-grant",
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so": "mit-0-grant",
    "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software": "mit-notice",
    "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement": "mit-warranty",
    "in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software": "mit-liability",
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies": "isc-grant",
    "permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies": "isc-grant",
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted": "0bsd-grant",
    "the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness": "isc-warranty",
    "in no event shall the author be liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits whether in an action of contract negligence or other tortious action arising out of or in connection with the use or performance of this software": "isc-liability",
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met": "bsd-grant",
    "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer": "bsd-source",
    "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution": "bsd-binary",
    "all advertising materials mentioning features or use of this software must display the following acknowledgement": "bsd-advertising",
    "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission": "bsd-endorsement",
    "neither the name of the copyright holders nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission": "bsd-endorsement",
    "neither the name of the author nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission": "bsd-endorsement",
    "neither the name of the university nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission": "bsd-endorsement",
    "neither the name of the organization nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission": "bsd-endorsement",
    "the name of the author may not be used to endorse or promote products derived from this software without specific prior written permission": "bsd-endorsement",
    "the names of its contributors may not be used to endorse or promote products derived from this software without specific prior written permission": "bsd-endorsement",
    "this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed": "bsd-warranty",
    "licensed under the apache license version 2 0 the license": "ref-Apache-2.0",
    "you may not use this file except in compliance with the license": "apache-2-compliance",
    "you may obtain a copy of the license at http www apache org licenses license 2 0": "apache-2-copy",
    "you may obtain a copy of the license at https www apache org licenses license 2 0": "apache-2-copy",
    "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied": "apache-2-as-is",
    "apache license version 2 0 january 2004 http www apache org licenses terms and conditions for use reproduction and distribution": "apache-2-title",
    "everyone is permitted to copy and distribute verbatim copies of this license document but changing it is not allowed": "fsf-copies",
    "gnu general public license version 2 june 1991": "gpl-2-title",
    "gnu general public license version 3 29 june 2007": "gpl-3-title",
    "gnu lesser general public license version 2 1 february 1999": "lgpl-2-1-title",
    "gnu lesser general public license version 3 29 june 2007": "lgpl-3-title",
    "gnu affero general public license version 3 19 november 2007": "agpl-3-title",
    "this source code form is subject to the terms of the mozilla public license v 2 0": "mpl-2-subject",
    "this source code form is subject to the terms of the mozilla public license v": "mpl-2-subject",
    "if a copy of the mpl was not distributed with this file you can obtain one at http mozilla org mpl 2 0": "mpl-2-copy",
    "if a copy of the mpl was not distributed with this file you can obtain one at https mozilla org mpl 2 0": "mpl-2-copy",
    "this program and the accompanying materials are made available under the terms of the eclipse public license 2 0 which is available at https www eclipse org legal epl 2 0": "epl-2-notice",
    "this program and the accompanying materials are made available under the terms of the eclipse public license 2 0 which is available at http www eclipse org legal epl 2 0": "epl-2-notice",
    "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work": "cc0-waiver",
    "this is free and unencumbered software released into the public domain": "unlicense-domain",
    "anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means": "unlicense-free",
    "everyone is permitted to copy and distribute verbatim or modified copies of this license document and changing it is allowed as long as the name is changed": "wtfpl-copies",
    "this software is provided as is without any express or implied warranty": "zlib-warranty",
    "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions": "zlib-grant",
    "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license the software to use reproduce display distribute execute and transmit the software and to prepare derivative works of the software and to permit third parties to whom the software is furnished to do so all subject to the following": "bsl-grant",
    "this font software is licensed under the sil open font license version 1 1": "ofl-notice",
    "permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement is hereby granted provided that the above copyright notice and this paragraph and the following two paragraphs appear in all copies": "postgresql-grant",
}
#: The grants of the GNU licences say the same but for the kind of work, the licence's name and its version.
GNU = {"GPL-2.0": ("general", "2"), "GPL-3.0": ("general", "3"), "LGPL-2.1": ("lesser general", "2 1"), "LGPL-3.0": ("lesser general", "3"), "AGPL-3.0": ("affero general", "3")}
for _licence, (_kind, _version) in GNU.items():
    for _what in ("program", "library", "software", "file"):
        _head = f"this {_what} is free software you can redistribute it and or modify it under the terms of the gnu {_kind} public license"
        SENTENCES |= {
            f"{_head} as published by the free software foundation either version {_version} of the license or at your option any later version": f"{_licence}-later",
            f"{_head} version {_version} as published by the free software foundation": f"{_licence}-only",
            f"{_head} as published by the free software foundation version {_version} of the license": f"{_licence}-only",
        }

#: What references call a licence, normalised, without an article. The licence's own identifier
#: (SPDX) stands for it after "SPDX-License-Identifier:" alone.
NAMES = {
    "mit license": "MIT",
    "isc license": "ISC",
    "apache license version 2 0": "Apache-2.0",
    "apache license 2 0": "Apache-2.0",
    "apache 2 0 license": "Apache-2.0",
    "bsd 2 clause license": "BSD-2-Clause",
    "simplified bsd license": "BSD-2-Clause",
    "bsd 3 clause license": "BSD-3-Clause",
    "new bsd license": "BSD-3-Clause",
    "modified bsd license": "BSD-3-Clause",
    "gnu general public license version 2": "GPL-2.0",
    "gnu general public license v2 0": "GPL-2.0",
    "gnu gpl version 2": "GPL-2.0",
    "gpl version 2": "GPL-2.0",
    "gplv2": "GPL-2.0",
    "gnu general public license version 3": "GPL-3.0",
    "gnu general public license v3 0": "GPL-3.0",
    "gnu gpl version 3": "GPL-3.0",
    "gpl version 3": "GPL-3.0",
    "gplv3": "GPL-3.0",
    "gnu lesser general public license version 2 1": "LGPL-2.1",
    "gnu lesser general public license version 3": "LGPL-3.0",
    "gnu affero general public license version 3": "AGPL-3.0",
    "mozilla public license version 2 0": "MPL-2.0",
    "mozilla public license 2 0": "MPL-2.0",
    "eclipse public license version 2 0": "EPL-2.0",
    "eclipse public license 2 0": "EPL-2.0",
    "boost software license version 1 0": "BSL-1.0",
    "boost software license 1 0": "BSL-1.0",
    "zlib license": "Zlib",
    "postgresql license": "PostgreSQL",
    "artistic license 2 0": "Artistic-2.0",
    "european union public license version 1 2": "EUPL-1.2",
    "european union public licence version 1 2": "EUPL-1.2",
    "sil open font license version 1 1": "OFL-1.1",
    "python software foundation license version 2": "PSF-2.0",
    "do what the fuck you want to public license": "WTFPL",
    "unlicense": "Unlicense",
    "creative commons zero v1 0 universal": "CC0-1.0",
    "cc0 1 0": "CC0-1.0",
    "cc0 1 0 universal": "CC0-1.0",
}
#: Creative Commons licences by their parts: short names and full ones, two versions.
PARTS = {"by": "attribution", "nc": "noncommercial", "nd": "noderivatives", "sa": "sharealike"}
for _parts in ("by", "by-sa", "by-nd", "by-nc", "by-nc-sa", "by-nc-nd"):
    for _version in ("3.0", "4.0"):
        _licence, _number = f"CC-{_parts.upper()}-{_version}", _version.replace(".", " ")
        _full = "creative commons " + " ".join(PARTS[p] for p in _parts.split("-")) + f" {_number}"
        NAMES |= {f"{n}{end}": _licence for n in (f"cc {_parts.replace('-', ' ')} {_number}", _full) for end in ("", " license", " international license")}

#: What may come before a name: as a pattern over normalised sentences.
REFERENCE = "(?:(?:this|the) (?:work|project|program|software|library|package|code|file|document|repository) is )?(?:licensed|released|distributed|published|made available|available) under (?:the |a |an )?(?:terms of the )?"
SPDX = "spdx license identifier "


def identifier(licence: str) -> str:
    """The sentence identifier of a reference to a licence."""
    return "ref-" + licence


#: Rules in order: a document has a licence if the identifiers of its known sentences hold the rule's
#: sequence without another between. The first rule of a licence that matches names the kind of match. What a longer
#: rule matches counts for no shorter one that is a part of it.
RULES = (
    ("MIT", "text", ("mit-grant", "mit-notice", "mit-warranty")),
    ("MIT-0", "text", ("mit-0-grant", "mit-warranty")),
    ("ISC", "text", ("isc-grant", "isc-warranty")),
    ("0BSD", "text", ("0bsd-grant", "isc-warranty")),
    ("BSD-4-Clause", "text", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-advertising")),
    ("BSD-3-Clause", "text", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-endorsement")),
    ("BSD-2-Clause", "text", ("bsd-grant", "bsd-source", "bsd-binary")),
    ("Apache-2.0", "text", ("apache-2-title",)),
    ("Apache-2.0", "notice", ("ref-Apache-2.0", "apache-2-compliance", "apache-2-copy")),
    ("GPL-2.0", "text", ("gpl-2-title", "fsf-copies")),
    ("GPL-3.0", "text", ("gpl-3-title", "fsf-copies")),
    ("LGPL-2.1", "text", ("lgpl-2-1-title", "fsf-copies")),
    ("LGPL-3.0", "text", ("lgpl-3-title", "fsf-copies")),
    ("AGPL-3.0", "text", ("agpl-3-title", "fsf-copies")),
    *((f"{x}-or-later", "notice", (f"{x}-later",)) for x in GNU),
    *((f"{x}-only", "notice", (f"{x}-only",)) for x in GNU),
    ("MPL-2.0", "notice", ("mpl-2-subject", "mpl-2-copy")),
    ("EPL-2.0", "notice", ("epl-2-notice",)),
    ("CC0-1.0", "notice", ("cc0-waiver",)),
    ("Unlicense", "text", ("unlicense-domain", "unlicense-free")),
    ("WTFPL", "text", ("wtfpl-copies",)),
    ("Zlib", "text", ("zlib-warranty", "zlib-grant")),
    ("BSL-1.0", "text", ("bsl-grant",)),
    ("OFL-1.1", "notice", ("ofl-notice",)),
    ("PostgreSQL", "text", ("postgresql-grant",)),
)
#: References come last, a rule a licence; GNU identifiers of SPDX say "only" or "or later".
SPDX_IDS = (*dict.fromkeys(NAMES.values()), "0BSD", "MIT-0", *(f"{x}-{end}" for x in GNU for end in ("only", "or-later")))
RULES += tuple((x, "reference", (identifier(x),)) for x in SPDX_IDS)

CATALOGUE = (SENTENCES, NAMES, RULES)
