"""Licence scan by canonical digests: entire texts, and single licence notices, against known ones.

A text is made canonical (lower case, copyright lines gone, equivalent spellings made one,
punctuation and white space folded) and its SHA-256 hash-joined to the digests of known licences.
Long licences are known by the digest alone. Notices (lines that speak of a licence, however long) are made
canonical and looked up too; they are parts of a row, and a join would have to put rows together again, so their few digests
stand in a constant map. All of it is DataFrame and SQL functions; texts never leave the scan, only
32-byte digests meet in joins, and the digest table is a fixed list of this module.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Equivalent spellings, replaced in this order after lower-casing.
SPELLINGS = [("licence", "license"), ("sub-license", "sublicense"), ("non-infringement", "noninfringement"), ("merchantibility", "merchantability"), ("https://", "http://"), ("&", " and ")]

_WARRANTY = (
    'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, '
    "FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER "
    "LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
_MIT = (
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal "
    "in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell "
    "copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:\n\n"
    "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.\n\n" + _WARRANTY
)
_ISC = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."
_ISC_WARRANTY = (
    'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY '
    "AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM "
    "LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR "
    "PERFORMANCE OF THIS SOFTWARE."
)
_BSD_HEAD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:\n"
_BSD_1 = "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.\n"
_BSD_2 = "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.\n"
_BSD_3 = "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.\n"
_BSD_WARRANTY = (
    'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE '
    "IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE "
    "FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR "
    "SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR "
    "TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
_APACHE_HEADER = (
    'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of '
    "the License at\n\nhttp://www.apache.org/licenses/LICENSE-2.0\n\nUnless required by applicable law or agreed to in writing, software distributed under the "
    'License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific '
    "language governing permissions and limitations under the License."
)
#: Known licences, whole texts. Variants of one licence share its id.
LICENSES = [
    ("MIT", _MIT), ("MIT", "MIT License\n\n" + _MIT), ("MIT", "The MIT License (MIT)\n\n" + _MIT), ("MIT", "The MIT License\n\n" + _MIT), ("MIT", "MIT License (MIT)\n\n" + _MIT), ("MIT-0", _MIT.replace(", subject to the following conditions:\n\nThe above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.", ".")),
    ("ISC", _ISC + "\n\n" + _ISC_WARRANTY), ("ISC", "ISC License\n\n" + _ISC + "\n\n" + _ISC_WARRANTY), ("0BSD", _ISC.replace(", provided that the above copyright notice and this permission notice appear in all copies", "") + "\n\n" + _ISC_WARRANTY),
    ("BSD-2-Clause", _BSD_HEAD + _BSD_1 + _BSD_2 + _BSD_WARRANTY), ("BSD-2-Clause", f"{_BSD_HEAD}1. {_BSD_1}2. {_BSD_2}{_BSD_WARRANTY}"),
    ("BSD-3-Clause", _BSD_HEAD + _BSD_1 + _BSD_2 + _BSD_3 + _BSD_WARRANTY), ("BSD-3-Clause", f"{_BSD_HEAD}1. {_BSD_1}2. {_BSD_2}3. {_BSD_3}{_BSD_WARRANTY}"),
    ("BSD-2-Clause", f"BSD 2-Clause License\n\n{_BSD_HEAD}1. {_BSD_1}2. {_BSD_2}{_BSD_WARRANTY}"), ("BSD-3-Clause", f"BSD 3-Clause License\n\n{_BSD_HEAD}1. {_BSD_1}2. {_BSD_2}3. {_BSD_3}{_BSD_WARRANTY}"),
    ("Apache-2.0", _APACHE_HEADER),
]
#: One-line notices.
NOTICES = [
    ("MIT", "Released under the MIT License."), ("MIT", "Licensed under the MIT License."), ("MIT", "SPDX-License-Identifier: MIT"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."), ("Apache-2.0", "Released under the Apache License, Version 2.0."), ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."), ("CC-BY-4.0", "Licensed under CC BY 4.0."), ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."), ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."), ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0"),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."), ("BSD-2-Clause", "Licensed under the BSD 2-Clause License."), ("MPL-2.0", "Licensed under the Mozilla Public License, version 2.0."),
]
#: SHA-256 digests of the canonical text of longer licences, as published.
DIGESTS = [
    ("Apache-2.0", "f92c423b6d6da66caa78abd6f49f73f5bc8715dca82e1a73f62d1e6eec41986c"),
    ("GPL-1.0", "8f586b09c093668e2db772bdcfc1d5dc0b03e0e862fccbff035e1bf134e9b224"),
    ("GPL-2.0", "efe73660e5476cf0368fc0fc143f624ff9d1b73c4484b14a9969dd20c5786821"),
    ("GPL-3.0", "5fc5b48e8eeed6e5e77c32ad8641a6bc04d25011d6b500aa7dc7f3183ab812ea"),
    ("LGPL-2.0", "61af4dcea4e412e8ccfb8877fd2762bd6d962f8d42a9fa2c06cf7b4613f2c908"),
    ("LGPL-2.1", "4d55922bdeafabde164d75448bbfb0b474bf952bbb541325364010900acd9891"),
    ("LGPL-3.0", "aae2b222477171fb64e298e7965e768a9a6f85320646b266c94399ac029d42be"),
    ("MPL-1.1", "f77c59051c0127d677dcce7ba0d4733294974749a7b4155250912498d92767d6"),
    ("MPL-2.0", "95f6a0d094cf3da6a140310541c7b576789031b600469b70877b34f97918e4c9"),
    ("CC0-1.0", "96bdc7f63190fb4bd1ae584b890300ed7517d858b34c945642a3b9b2f1612a5f"),
    ("GFDL-1.2", "94541e73869af10ab6bd68a29575eede324e54e7d5237e7386d12444f593af60"),
    ("GFDL-1.3", "a92fdbaeafedd9cbeb812ebbded06ee07e3b1427c81cfc333e682109c594d826"),
    ("Artistic-1.0-Perl", "e963bc30f4d3c45f45030c34409ee37315564625649c1394e32bb5ddd99e01b2"),
]
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: ASCII other than letters and digits, the Unicode block of general punctuation (quotes, dashes, spaces), and the no-break and ideographic space.
PUNCTUATION = r"[\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f\x{00a0}\x{2000}-\x{206f}\x{3000}]+"
#: A copyright notice at the start of a line, behind marks of a comment or not, up to the line's end, or to a known opening in texts folded to one line.
COPYRIGHT_LINE = r"(^|\n)[ \t*#;/!%-]*(copyright |portions copyright |\(c\)|©|all rights reserved)[^\n]*?(\n|$|permission is hereby granted|permission to use, copy|redistribution and use in)"
#: Words after "copyright" that make it part of a sentence.
BODY_WORDS = ["notice", "holder", "owner", "license", "law", "statement", "and", "or"]
BODY = "copyright[ \\t\\n]+(" + "|".join(BODY_WORDS) + ")"


def canonical(text: Column) -> Column:
    """Lower case (A-Z), no copyright lines, one spelling, punctuation and white space as single spaces."""
    out = F.replace(F.translate(text, UPPER, UPPER.lower()), F.lit("\n"), F.lit("\n\n"))
    out = F.regexp_replace(out, BODY, "copyright_$1")
    out = F.regexp_replace(out, COPYRIGHT_LINE, " $3")
    for a, b in SPELLINGS:
        out = F.replace(out, F.lit(a), F.lit(b))
    return F.trim(F.regexp_replace(out, PUNCTUATION, " "))


def known(spark: SparkSession, texts: list[tuple[str, str]]) -> DataFrame:
    """``(license, digest)``: one row per digest."""
    listed = F.from_json(F.lit(json.dumps([{"license": a, "body": b} for a, b in texts])), "array<struct<license:string,body:string>>")
    return spark.range(1, numPartitions=1).select(F.inline(listed)).select("license", F.sha2(canonical(F.col("body")), 256).alias("digest")).groupBy("digest").agg(F.min("license").alias("license"))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", licenses: list | None = None, notices: list | None = None) -> DataFrame:
    """``(doc_id, digest, license, notices)`` for every row of ``docs``.

    ``digest``: of the canonical entire text (null text counts as empty). ``license``: the
    known licence with that digest, else null. ``notices``: licence ids of the text's known
    notice lines, sorted, comma-separated, "" if none. Repeated rows come back repeated;
    an empty table gives an empty result. Texts and lines of any length are read whole.
    """
    spark = docs.sparkSession
    whole = known(spark, LICENSES if licenses is None else licenses)
    if licenses is None:
        listed = F.from_json(F.lit(json.dumps([{"digest": d, "license": n} for n, d in DIGESTS])), "array<struct<digest:string,license:string>>")
        whole = whole.union(spark.range(1, numPartitions=1).select(F.inline(listed))).groupBy("digest").agg(F.min("license").alias("license"))
    whole = whole.withColumnRenamed("digest", "__d")
    single = known(spark, NOTICES if notices is None else notices).agg(F.map_from_entries(F.collect_list(F.struct("digest", "license")))).first()[0] or {}
    base = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("__t"))
    lines = F.filter(F.split("__t", "\n"), lambda x: x.rlike("(?i)licen[cs]e"))
    base = base.select("doc_id", F.sha2(canonical(F.col("__t")), 256).alias("digest"), lines.alias("__l"))
    table = F.from_json(F.lit(json.dumps(single)), "map<string,string>")
    digests = F.transform(F.col("__l"), lambda x: F.element_at(table, F.sha2(canonical(x), 256)))
    found = F.array_join(F.array_sort(F.array_distinct(F.filter(digests, lambda x: x.isNotNull()))), ",")
    base = base.select("doc_id", "digest", found.alias("notices"))
    return base.join(F.broadcast(whole), F.col("digest") == F.col("__d"), "left").select("doc_id", "digest", "license", "notices")
