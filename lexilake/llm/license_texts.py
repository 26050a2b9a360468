"""Known licence texts and notices, and digests of long licence texts. Fixed values."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

_PERMISSION = """THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_BSD_HEAD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
"""
_BSD_THIRD = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.\n"
_BSD_TAIL = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

"""
_ISC = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"
_ISC_TAIL = """THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""

#: license_id -> text
TEXTS: list[tuple[str, str]] = [
    ("MIT", "MIT License\n\n" + _MIT + _PERMISSION),
    ("MIT", _MIT + _PERMISSION),
    ("BSD-2-Clause", _BSD_HEAD + "\n" + _BSD_TAIL),
    ("BSD-3-Clause", _BSD_HEAD + _BSD_THIRD + "\n" + _BSD_TAIL),
    ("ISC", _ISC + ", provided that the above copyright notice and this permission notice appear in all copies.\n\n" + _ISC_TAIL),
    ("0BSD", _ISC + ".\n\n" + _ISC_TAIL),
    # notices
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("GPL-3.0-only", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0-only", "SPDX-License-Identifier: GPL-3.0-only"),
    ("GPL-2.0-only", "This work is licensed under the GNU General Public License, version 2."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
]

#: license_id -> SHA-256 of the canonical form of the licence's published text
DIGESTS: list[tuple[str, str]] = [
    ("Apache-2.0", "5878e63214154a88e0722ecdc335813201c675b6f5ef45750f2f6657594ce324"),
    ("Artistic-1.0-Perl", "46f5317182e1131513a25fa420936d63fac4a79ffe0d6af0fcf853141b429932"),
    ("CC0-1.0", "400db3ed80e146737970d3ff856f201f0206119c2851164504a236a6893f845a"),
    ("GFDL-1.2", "46d5a7782288fbf723c1904974c25b0674709759ed38dc29432b84dad93a151d"),
    ("GFDL-1.3", "bb3a2b740a89244e2fc074a6825900fcf819281515da0185f72c1ee65a20d6d2"),
    ("GPL-1.0", "aefc687b54b35ed7d3bd7efe67b8c1b22dfc0d8b8d6f13ab8ea10718bb95a6f9"),
    ("GPL-2.0", "99abb8b40c82121806c605d8ea2d70e46bd7188164fc46375c85be4593fa17ac"),
    ("GPL-3.0", "83e8ed5752d3eee6fe8d20871f583b08d02c5933d8b867a802e4a2b77936e99c"),
    ("LGPL-2.0", "a698f98ab5b8f92d45c87de6692427cf716bde12a26e633ee1042c7c1db09dc4"),
    ("LGPL-2.1", "3047a315d37af993bd4a112239a34121df08441cfcfb631312a8c3c599af1ef7"),
    ("LGPL-3.0", "7d6e51c6bb80fc7a025c16e64157adf9c280c58dee4c4b2bf73e596166a2a08f"),
    ("MPL-1.1", "2b7aa7e3e0e67cba27d4266078436cc237d1a7cfc44dde668e222c51d3a79841"),
    ("MPL-2.0", "f1f942860a367df1672cbe3f5888509516378513d789e4a38af6a979118ef07c"),
    ("BSD-3-Clause", "3d151449461c0c776e892a4dc41cac0d251eb00c9fc49d2d48802d9bed818fe9"),
]


#: Each known text and notice holds one of these, lower-cased, in every spelling.
ANCHORS = ("licen", "permission", "redistribution")


def _anchor(text: str) -> str | None:
    return next((a for a in ANCHORS if a in text.lower()), None)


def known_licenses(spark: SparkSession) -> DataFrame:
    """(license_id, text, digest, anchor): a text, or a digest where the text is long; all of the latter call
    themselves licences but for the three clauses on redistribution."""
    rows = [(i, t, None, _anchor(t)) for i, t in TEXTS] + [(i, None, d, "redistribution" if i.startswith("BSD") else "licen") for i, d in DIGESTS]
    return spark.createDataFrame(rows, "license_id string, text string, digest string, anchor string")
