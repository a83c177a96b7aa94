"""Notices and bodies of common licenses and their versions, which the registered scan looks for.

Bodies of the longer licenses lie beside in ``license_texts``, one file for each, named as the license; they are read on
the driver alone. Notices that differ in a family or version word are all listed: the scan tells them apart by it.
"""

from __future__ import annotations

from importlib.resources import files

_GNU = (
    ("GPL-1.0", "", "1"), ("GPL-2.0", "", "2"), ("GPL-3.0", "", "3"), ("LGPL-2.0", "Library ", "2"),
    ("LGPL-2.0", "Lesser ", "2"), ("LGPL-2.1", "Lesser ", "2.1"), ("LGPL-3.0", "Lesser ", "3"), ("AGPL-3.0", "Affero ", "3"),
)
_GNU_NOTICES = (
    "This work is licensed under the GNU {}General Public License, version {}.",
    "under the terms of the GNU {}General Public License, version {}",
    "it under the terms of the GNU {}General Public License as published by the Free Software Foundation, either version {} "
    "of the License, or (at your option) any later version",
    "it under the terms of the GNU {}General Public License version {} as published by the Free Software Foundation",
    "it under the terms of the GNU {}General Public License as published by the Free Software Foundation, version {} of the "
    "License",
)
_CC = {
    "BY": "Attribution", "BY-SA": "Attribution-ShareAlike", "BY-ND": "Attribution-NoDerivatives",
    "BY-NC": "Attribution-NonCommercial", "BY-NC-SA": "Attribution-NonCommercial-ShareAlike",
    "BY-NC-ND": "Attribution-NonCommercial-NoDerivatives",
}
_CC_VERSIONS = {"2.0": "Generic", "2.5": "Generic", "3.0": "Unported", "4.0": "International"}
_NAMED = {
    "MIT": "MIT", "ISC": "ISC", "Zlib": "zlib", "BSL-1.0": "Boost Software", "BSD-2-Clause": "BSD 2-Clause",
    "BSD-3-Clause": "BSD 3-Clause", "Artistic-2.0": "Artistic 2.0", "Apache-2.0": "Apache 2.0",
}
_GRANT = (
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
    'documentation files (the "Software"), to deal in the Software without restriction, including without limitation the '
    "rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit "
    "persons to whom the Software is furnished to do so"
)
_KEEP = (
    ", subject to the following conditions: The above copyright notice and this permission notice shall be included in all "
    "copies or substantial portions of the Software. "
)
_AS_IS = (
    'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE '
    "WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR "
    "COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR "
    "OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
_BSD = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
    "following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of "
    "conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, "
    "this list of conditions and the following disclaimer in the documentation and/or other materials provided with the "
    "distribution. "
)
_BSD_ADVERTISING = (
    "3. All advertising materials mentioning features or use of this software must display the following acknowledgement: "
    "This product includes software developed by the organization. "
)
_BSD_NAMES = (
    "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products "
    "derived from this software without specific prior written permission. "
)
_BSD_AS_IS = (
    'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, '
    "INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE "
    "DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, "
    "SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR "
    "SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, "
    "WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE "
    "OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
_ISC = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"

NOTICES = (
    *((name, text.format(kind, version)) for name, kind, version in _GNU for text in _GNU_NOTICES),
    *((f"GFDL-{v}", f"under the terms of the GNU Free Documentation License, Version {v}") for v in ("1.1", "1.2", "1.3")),
    *((f"CC-{k}-{v}", f"Licensed under CC {k} {v}.") for k in _CC for v in _CC_VERSIONS),
    *((f"CC-{k}-{v}", f"licensed under a Creative Commons {long} {v} {where} License")
      for k, long in _CC.items() for v, where in _CC_VERSIONS.items()),
    *((name, f"{verb} under the {short} License") for name, short in _NAMED.items()
      for verb in ("Released", "Licensed", "Distributed", "available") if (name, verb) != ("MIT", "Released")),
    *((f"Apache-{v}", f"Licensed under the Apache License, Version {v}{more}") for v in ("1.1", "2.0") for more in (
        ".", ' (the "License"); you may not use this file except in compliance with the License.') if (v, more) != ("2.0", ".")),
    ("ECL-2.0", 'Licensed under the Educational Community License, Version 2.0 (the "License"); you may not use this file '
                "except in compliance with the License."),
    *((f"MPL-{v}", f"the contents of this file are subject to the Mozilla Public License Version {v}") for v in ("1.0", "1.1")),
    *((f"EPL-{v}", f"made available under the terms of the Eclipse Public License {p}{v}") for v in ("1.0", "2.0") for p in ("v", "v. ", "")),
    *((f"EUPL-{v}", f"Licensed under the EUPL, Version {v}") for v in ("1.1", "1.2")),
    *((f"CDDL-{v}", f"under the terms of the Common Development and Distribution License, Version {v}") for v in ("1.0", "1.1")),
    *((f"OFL-{v}", f"This Font Software is licensed under the SIL Open Font License, Version {v}") for v in ("1.0", "1.1")),
    ("MIT", _GRANT + _KEEP + _AS_IS),
    ("MIT-0", _GRANT + ". " + _AS_IS),
    ("JSON", _GRANT + _KEEP + "The Software shall be used for Good, not Evil. " + _AS_IS),
    ("NCSA", _GRANT.replace("deal in", "deal with") + ", subject to the following conditions: Redistributions of source code "
             "must retain the above copyright notice, this list of conditions and the following disclaimers."),
    ("BSL-1.0", "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software "
                "and accompanying documentation covered by this license"),
    ("BSD-2-Clause", _BSD + _BSD_AS_IS),
    ("BSD-3-Clause", _BSD + "3. " + _BSD_NAMES + _BSD_AS_IS),
    ("BSD-4-Clause", _BSD + _BSD_ADVERTISING + "4. " + _BSD_NAMES + _BSD_AS_IS),
    ("ISC", _ISC + ", provided that the above copyright notice and this permission notice appear in all copies."),
    ("0BSD", _ISC + '. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES'),
    ("Zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be "
             "held liable for any damages arising from the use of this software."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work"),
)


def bodies() -> tuple[tuple[str, str], ...]:
    """License and text of each file in ``license_texts``."""
    found = (f for f in (files("warden.llm") / "license_texts").iterdir() if f.name.endswith(".txt"))
    return tuple((f.name[:-4], f.read_text(encoding="utf-8")) for f in sorted(found, key=lambda f: f.name))


def catalogue(first: tuple[tuple[str, str], ...]) -> tuple[tuple[str, str], ...]:
    """Templates: ``first``, the other notices, the bodies.

    The opening words of all BSD licenses name none of them, so alone they are reported as BSD.
    """
    opening = [("BSD" if _BSD.startswith(text) else name, text) for name, text in first]
    known = {text for _, text in first}
    return (*opening, *((n, t) for n, t in NOTICES if t not in known), *bodies())
