"""Licence scan by canonical digests.

A text is brought to a canonical form (lower case, no copyright lines, equivalent spellings made one, all punctuation and
white space one blank) and its digest joined with those of known licences. Whole texts match or don't.

Known are the short texts of KNOWN, these under the titles that files give them, and the full texts in license_texts/, whole and
up to the end of their terms. The SQL knows KNOWN alone, and takes any line that begins with "copyright" for a holder's.

Cases. Null text: null digest, no licence. Blank text: the digest of the empty text, no licence. Repeated rows: each
gets a row. Very long texts: read whole. Two known licences with one canonical form: the lesser name. Empty table: empty result. Extra columns and
clashing names: only doc_id and text are read.
"""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import broadcast_if_small, table

# Spellings that licence matching treats as one, applied in this order to lower-case text.
SPELLINGS = [
    ("licence", "license"), ("acknowledgement", "acknowledgment"), ("analogue", "analog"), ("analyse", "analyze"),
    ("artefact", "artifact"), ("authoris", "authoriz"), ("calibre", "caliber"), ("cancelled", "canceled"),
    ("capitalis", "capitaliz"), ("catalogue", "catalog"), ("categoris", "categoriz"), ("centre", "center"),
    ("emphasise", "emphasize"), ("favour", "favor"), ("fulfilment", "fulfillment"), ("honour", "honor"),
    ("initialis", "initializ"), ("judgement", "judgment"), ("labour", "labor"), ("merchantibility", "merchantability"),
    ("optimis", "optimiz"), ("organis", "organiz"), ("practise", "practice"), ("programme", "program"),
    ("realis", "realiz"), ("recognis", "recogniz"), ("signalling", "signaling"), ("utilis", "utiliz"),
    ("whilst", "while"), ("wilful", "willful"), ("copyright owner", "copyright holder"), ("per cent", "percent"),
    ("sub-license", "sublicense"), ("non-infringement", "noninfringement"), ("non-commercial", "noncommercial"), ("https://", "http://"),
]
# What follows "copyright" or "(c)" at the start of a line of a licence's own prose, which wrapping may put there.
_PROSE = "notices?|holders?|owners?|laws?|licen[cs]es?|statements?|and|or|on|in|to|of|is|are|as|for|interests?|claims?|protection|disclaimers?|rights?|treaty|treaties|act|permission|status|information|management|infringement|under|with|that|which|may|shall|must|this"
_ITEM = "you|an?|any|if|in|to|under|representations|the[ \\t]+licenses|permission|for|this|that|such|it|each|no"
#: Lines that name a holder or a year, with any comment marks before.
HOLDER_LINE = rf"(?m)^[ \t#*/;%.-]*(?:copyright(?![a-z])(?![ \t]*(?:\r?$|[,;.)](?![ \t]*(?:[0-9©]|\(c\)))|(?:{_PROSE})\b))|\(c\)(?![ \t]*(?:{_ITEM})\b)|©|all rights reserved)[^\n]*$"
#: The same as the SQL has it.
COPYRIGHT_LINE = r"(?m)^[ \t#*/;%.-]*(?:copyright|\(c\)|©|all rights reserved)[^\n]*$"
OTHER = r"[^\p{L}\p{N}]+"

_MIT_GRANT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so"""
_MIT_END = """THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_BSD_HEAD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."""
_BSD_END = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_ISC_END = """THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""

# Public licence texts, without their copyright lines; an Apache notice stands for its licence.
KNOWN = {
    "MIT": f"{_MIT_GRANT}, subject to the following conditions:\n\nThe above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.\n\n{_MIT_END}",
    "MIT-titled": f"MIT License\n\n{_MIT_GRANT}, subject to the following conditions:\n\nThe above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.\n\n{_MIT_END}",
    "MIT-0": f"{_MIT_GRANT}.\n\n{_MIT_END}",
    "BSD-2-Clause": f"{_BSD_HEAD}\n\n{_BSD_END}",
    "BSD-3-Clause": f"{_BSD_HEAD}\n\n3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.\n\n{_BSD_END}",
    "ISC": f"Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.\n\n{_ISC_END}",
    "0BSD": f"Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.\n\n{_ISC_END}",
    "Zlib": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.\n\nPermission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:\n\n1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.\n\n2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.\n\n3. This notice may not be removed or altered from any source distribution.",
    "Apache-2.0-notice": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at\n\nhttp://www.apache.org/licenses/LICENSE-2.0\n\nUnless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    "Apache-2.0-line": "Licensed under the Apache License, Version 2.0.",
    "FSFAP": "Copying and distribution of this file, with or without modification, are permitted in any medium without royalty provided the copyright notice and this notice are preserved. This file is offered as-is, without any warranty.",
}


KNOWN_TITLES = {
    "MIT": ["The MIT License", "The MIT License (MIT)", "MIT License (MIT)"], "MIT-0": ["MIT No Attribution", "MIT No Attribution License", "MIT-0"],
    "BSD-2-Clause": ["BSD 2-Clause License", "The BSD 2-Clause License", "BSD 2-Clause \"Simplified\" License", "BSD License"],
    "BSD-3-Clause": ["BSD 3-Clause License", "The BSD 3-Clause License", "BSD 3-Clause \"New\" or \"Revised\" License", "New BSD License", "BSD License"],
    "ISC": ["ISC License", "The ISC License", "ISC License (ISC)"], "0BSD": ["BSD Zero Clause License", "Zero-Clause BSD", "BSD Zero Clause License (0BSD)"],
    "Zlib": ["zlib License", "The zlib License", "The zlib/libpng License", "zlib/libpng License"],
}
SHORT = {
    "Unlicense": """This is free and unencumbered software released into the public domain.

Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.

In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.

For more information, please refer to <https://unlicense.org>""",
    "BSL-1.0": """Boost Software License - Version 1.0 - August 17th, 2003

Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:

The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE, TITLE AND NON-INFRINGEMENT. IN NO EVENT SHALL THE COPYRIGHT HOLDERS OR ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE FOR ANY DAMAGES OR OTHER LIABILITY, WHETHER IN CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
}
_END = "END OF TERMS AND CONDITIONS"


def all_known() -> list[tuple[str, str]]:
    """(license_id, text) of every known form."""
    out = [*KNOWN.items(), *SHORT.items()]
    out += [(k, f"{title}\n\n{KNOWN[k]}") for k, titles in KNOWN_TITLES.items() for title in titles]
    for f in sorted((Path(__file__).parent / "license_texts").glob("*.txt")):
        text = f.read_text(encoding="utf-8")
        out.append((f.stem, text))
        if _END in text:
            out += [(f.stem, text[: text.index(_END)]), (f.stem, text[: text.index(_END)] + _END)]
    return out


def canonical(text: Column) -> Column:
    c = F.lower(text)
    c = F.regexp_replace(c, HOLDER_LINE, " ")
    for a, b in SPELLINGS:
        c = F.replace(c, F.lit(a), F.lit(b))
    return F.trim(F.regexp_replace(c, OTHER, " "))


def digest(text: Column) -> Column:
    return F.md5(canonical(text).cast("binary"))


def known_licenses(spark: SparkSession, texts: dict[str, str] | None = None) -> DataFrame:
    """digest, license_id."""
    df = spark.createDataFrame(all_known() if texts is None else list(texts.items()), "license_id string, text string")
    return df.groupBy(digest(F.col("text")).alias("digest")).agg(F.min("license_id").alias("license_id"))


def scan(docs: DataFrame, known: DataFrame, known_rows: int) -> DataFrame:
    """doc_id, digest, license_id. The known side is broadcast only if its checked size allows."""
    d = docs.select("doc_id", digest(F.col("text")).alias("digest"))
    return d.join(broadcast_if_small(known.select("digest", "license_id"), known_rows), "digest", "left").select("doc_id", "digest", "license_id")


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"), known_licenses(spark), len(all_known()))


def _sql() -> str:
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    values = ", ".join(f"({quote(k)}, {quote(v)})" for k, v in KNOWN.items())
    c = f"regexp_replace(lower(text), {quote(COPYRIGHT_LINE)}, ' ', 'g')"
    for a, b in SPELLINGS:
        c = f"replace({c}, {quote(a)}, {quote(b)})"
    c = f"md5(trim(regexp_replace({c}, '{OTHER}', ' ', 'g')))"
    return f"""WITH known(license_id, text) AS (VALUES {values}),
k AS (SELECT {c} digest, min(license_id) license_id FROM known GROUP BY 1), d AS (SELECT doc_id, {c} digest FROM documents)
SELECT doc_id, digest, license_id FROM d LEFT JOIN k USING (digest)"""


QUERIES = {"op4_license_scan": op4_license_scan}
SQL = {"op4_license_scan": _sql()}
