"""Canonical digest lookup: whole texts against known licence texts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vitrine.operators.scale import is_small, skew_join

# Lines that name holders and years, and carry no terms.
HOLDER_LINE = r"^[ \t\r]*(copyright|©|\(c\)|portions copyright|all rights reserved)"
# Spellings that mean the same in a licence, as whole words, after case and punctuation are gone.
EQUIVALENT = {
    "licence": "license", "licences": "licenses", "licenced": "licensed", "sublicence": "sublicense", "sub license": "sublicense",
    "organisation": "organization", "organisations": "organizations", "favour": "favor", "behaviour": "behavior",
    "authorised": "authorized", "recognised": "recognized", "acknowledgement": "acknowledgment", "judgement": "judgment",
    "copyright owner": "copyright holder", "copyright owners": "copyright holders", "per cent": "percent", "fulfil": "fulfill",
    "merchantibility": "merchantability", "whilst": "while", "https": "http", "programme": "program",
}

# Public licence texts.
MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation
files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify,
merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished
to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF
MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE
FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN
CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted,
provided that the above copyright notice and this permission notice appear in all copies."""
AS_IS = """THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL
IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR
CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT,
NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
ZERO_BSD = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted."""
BSD_2 = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following
conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer
in the documentation and/or other materials provided with the distribution.
"""
BSD_THIRD = """
3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived
from this software without specific prior written permission.
"""
BSD_END = """
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT
NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE
COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES
(INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION)
HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE)
ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
# Short notices that stand for a licence when they are a whole text.
NOTICES = {
    "MIT": "Released under the MIT License.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "GPL-3.0-only": "This work is licensed under the GNU General Public License, version 3.",
}
TEXTS = [
    ("MIT", MIT),
    ("MIT", "MIT License\n\n" + MIT),
    ("MIT", "The MIT License (MIT)\n\n" + MIT),
    ("ISC", ISC + "\n\n" + AS_IS),
    ("ISC", "ISC License\n\n" + ISC + "\n\n" + AS_IS),
    ("0BSD", ZERO_BSD + "\n\n" + AS_IS),
    ("0BSD", "BSD Zero Clause License\n\n" + ZERO_BSD + "\n\n" + AS_IS),
    ("BSD-2-Clause", BSD_2 + BSD_END),
    ("BSD-2-Clause", "BSD 2-Clause License\n\n" + BSD_2 + BSD_END),
    ("BSD-3-Clause", BSD_2 + BSD_THIRD + BSD_END),
    ("BSD-3-Clause", "BSD 3-Clause License\n\n" + BSD_2 + BSD_THIRD + BSD_END),
    *NOTICES.items(),
]


def known_licences(spark: SparkSession) -> DataFrame:
    """licence, text of the texts above; a larger list may be any table of these columns."""
    return spark.createDataFrame(TEXTS, "licence string, text string")


def canonical_text(text: Column) -> Column:
    """Lower-cased words without holder lines, punctuation and spelling variants, one space apart."""
    lines = F.filter(F.split(F.lower(text), "\n"), lambda s: ~s.rlike(HOLDER_LINE))
    # two spaces between words, so that neighbours can both be replaced
    spaced = F.concat(F.lit(" "), F.regexp_replace(F.array_join(lines, "\n"), r"[^\p{L}\p{N}]+", "  "), F.lit(" "))
    pair = lambda s: f" {s.replace(' ', '  ')} "
    same = reduce(lambda c, e: F.replace(c, F.lit(pair(e[0])), F.lit(pair(e[1]))), EQUIVALENT.items(), spaced)
    return F.trim(F.regexp_replace(same, " +", " "))


def digest(text: Column) -> Column:
    return F.sha2(canonical_text(text), 256)


def licence_of(texts: DataFrame, licences: DataFrame, text: str = "text", key: str = "item_id") -> DataFrame:
    """The licence each whole text is, by canonical digest: all input columns plus digest, licence.

    The project keeps no licence files or texts among its records, so this works on any table
    with an id (`key`) and a `text` column. `licences` holds licence, text; several texts may
    stand for one licence, and of several licences with equal canonical texts the first in order
    of name is given. A text that only contains a licence is no match.

    Built-in functions only. The digests of the known texts are broadcast when measured small,
    and joined with hot digests salted otherwise.

    A null text has a null digest and no licence; a text without letters or digits has a digest,
    but never a licence. Repeated rows are looked up alone; columns named digest or licence are
    replaced.
    """
    known = licences.where(canonical_text(F.col("text")) != "").groupBy(digest(F.col("text")).alias("digest")).agg(F.min("licence").alias("licence"))
    asked = texts.drop("digest", "licence").withColumn("digest", digest(F.col(text)))
    if is_small(known):
        return asked.join(F.broadcast(known), "digest", "left")
    return skew_join(asked, known, ["digest"], "left", [key])
