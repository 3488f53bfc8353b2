"""Licence scan by canonical digest: a whole text is normalised, hashed and looked up among known licences.

Only DataFrame functions: lower case, no copyright lines, any run of other than letters and digits
one space, equivalent spellings made one, SHA-256 of the rest, then a hash join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: Lines that name a holder: a copyright sign or word that a sign, year, name in brackets or "by" follows; and the reservation that often ends them.
COPYRIGHT = r"(?m)^[^\p{L}\p{N}\n©(]*(?:copyright[ \t]*(?:\(c\)|©|[0-9]{4}|by |<|\[)|\(c\)[ \t]|©)[^\n]*|all rights reserved"
OTHER = r"[^\p{L}\p{N}]+"

#: Spellings and the form they count as, applied in this order to lower-case text without punctuation.
SPELLINGS = [
    ("licence", "license"),
    ("sub license", "sublicense"),
    ("non commercial", "noncommercial"),
    ("per cent", "percent"),
    ("copyright owner", "copyright holder"),
    ("isation", "ization"),
    ("ognise", "ognize"),
    ("orise", "orize"),
    ("judgement", "judgment"),
    ("acknowledgement", "acknowledgment"),
    ("favour", "favor"),
    ("labour", "labor"),
    ("centre", "center"),
    ("programme", "program"),
    ("whilst", "while"),
    ("wilful", "willful"),
    ("fulfill", "fulfil"),
    ("artefact", "artifact"),
]

_PERMIT = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_ENDORSE = " 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_DISCLAIM = ' THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.'
_GRANT = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"
_AS_IS = ' THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.'
#: Texts of well-known licences and notices. More come from a table of (license_id, text).
KNOWN = [
    ("MIT", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.'),
    ("ISC", _GRANT + ", provided that the above copyright notice and this permission notice appear in all copies." + _AS_IS),
    ("0BSD", _GRANT + "." + _AS_IS),
    ("BSD-2-Clause", _PERMIT + _DISCLAIM),
    ("BSD-3-Clause", _PERMIT + _ENDORSE + _DISCLAIM),
    ("Zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution."),
    ("Unlicense", 'This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE. For more information, please refer to <http://unlicense.org/>'),
    ("BSL-1.0", 'Boost Software License - Version 1.0 - August 17th, 2003 Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following: The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE, TITLE AND NON-INFRINGEMENT. IN NO EVENT SHALL THE COPYRIGHT HOLDERS OR ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE FOR ANY DAMAGES OR OTHER LIABILITY, WHETHER IN CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.'),
    ("notice-Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("notice-CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("notice-GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("notice-MIT", "Released under the MIT License."),
]

#: Digests of the canonical whole texts of longer licences; with and without what follows (or is) the line that ends the terms, and with http or https in links.
DIGESTS = [
    ("Apache-2.0", "4580e5390400d27df89edd0617548ac0e66eaa029f6e07cf98aac9cd100b3a37"),
    ("Apache-2.0", "3420cffbc5a189344e1877fb60e7273e53d7e783559abf595c291da52ded4de1"),
    ("Apache-2.0", "0b8c1a9e0ec99ab3b27e123e667fe4843df4dd7e6c667ccdc634dd6878c5dd6c"),
    ("Apache-2.0", "536268a29a0159e67af17c6e67180c66dd3d63b55f1de711e05c122be8002289"),
    ("Apache-2.0", "67e6c9864a42fc797b7f0244a9e5402dbe5d51fd1cbfdbca4f454f8892ab077d"),
    ("Apache-2.0", "e31ac59f164ccf53aa974b50f93c9ea55654552a7beb0de32efa0ddda78b04a9"),
    ("Artistic-1.0-Perl", "08f1dc258c8f9e175155356aa1dd0dead8cfdec586bc1bb4c8b1452699a91702"),
    ("CC0-1.0", "96bdc7f63190fb4bd1ae584b890300ed7517d858b34c945642a3b9b2f1612a5f"),
    ("GFDL-1.2", "1c057ea35084eb195331cec1a49fca335c176422a7726a9a23636906fd4e241f"),
    ("GFDL-1.2", "15f6a8d360ffdecc988c29279c00f23e20de17f14f2a06572ab0d41de6e98b7b"),
    ("GFDL-1.3", "7e8edd3abe6258bb82bb853d91a0c24fcd9976894fd0592747354cffe1cb18e7"),
    ("GFDL-1.3", "2d36daeff2ad303badb6dee8149748be25e22974dd468e1e8a55cf40f16fc01d"),
    ("GPL-1.0", "98db0b473e0a45a62b04a39b6b864b4e079a58d513e2196f94fe7252fa8574a6"),
    ("GPL-1.0", "6375a768fd262bf5281905a9585411d2d0fb4ea15cb08cfcba49f73fedb82abc"),
    ("GPL-1.0", "89f75ffda938e788be38679f9f83e317c2a03398fccf03ee60505d44d1bf9f70"),
    ("GPL-2.0", "e95eb1718f9f373d56cc586a5f7d1bfa11668867f6e85e982d2b6108b97d90a1"),
    ("GPL-2.0", "e1270b653c300290e7c039142bccb8776f9b5d14e8a05bc4e87dc7d1614a3b34"),
    ("GPL-2.0", "6d332dc4c3c5293a73c6c9da402f9bbc970b3bb1eb472f577e00580573469808"),
    ("GPL-3.0", "e45fdf2ecb0f05dd188636cd45a7e9be8d0af6c375e83667e79460782b04dd25"),
    ("GPL-3.0", "0a85ab25a52f42a58c2cc4bf76b4808eb5d0505467f60ad614ac4d676f443478"),
    ("GPL-3.0", "7d75204ed685fd08ff55e7de654cd69da831b4d875c3d2c2e69d04d738cccc3e"),
    ("GPL-3.0", "dd35883083089e6d76ba8a178db431b99ae33b3d2e87dc33fa479fe6aa2ce307"),
    ("LGPL-2.0", "e4deecd0730802431ad09f00ae3793f3703c8e4dba639586545d9f958405614d"),
    ("LGPL-2.0", "504542bce5421b0f5a7e63ddb55443ccb300b27a65ba6bfc1370fed16a3af260"),
    ("LGPL-2.0", "430627da7218a92ab4a6d75d5140cdb70ee750be7a53f913299b37e0d1b0eea2"),
    ("LGPL-2.1", "d3826e4e563a04a354453ff139a32b19d6c3fe283f518eb566107c54e18cd01f"),
    ("LGPL-2.1", "48d2010e70a815a564f914b0c7c1e80d7a6843793348fed3684c957112fe0aa4"),
    ("LGPL-2.1", "bf2f0c6bf1c47b3b1e3cbedeefecddd1e7db21d1919858d45c2f918efaf426df"),
    ("LGPL-3.0", "aae2b222477171fb64e298e7965e768a9a6f85320646b266c94399ac029d42be"),
    ("MPL-1.1", "ec50af2b690eb92871b322c5583363a9966efc8736342d648aeb07bc0930249f"),
    ("MPL-1.1", "7876487994739bcec1a6bdef5f9ac63318e85376d640877f820c2ce33ee2c473"),
    ("MPL-2.0", "9e79a7d513376f6fa1500e4df4f6276c6e7e61c5c3e28dcdb1acee24033acc56"),
    ("MPL-2.0", "8f0473f9c917c507827dca355168119bb065ca1a9dab0e366988bcdba5fa039b"),
]


def canonical(text: Column) -> Column:
    """The text as licences are compared; null counts as empty."""
    x = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), COPYRIGHT, " ")
    x = F.trim(F.regexp_replace(x, OTHER, " "))
    for given, counts_as in SPELLINGS:
        x = F.replace(x, F.lit(given), F.lit(counts_as))
    return x


def digest(text: Column) -> Column:
    return F.sha2(canonical(text), 256)


def _rows(spark: SparkSession, rows: list[tuple[str, str]], value: str) -> DataFrame:
    return spark.range(1).select(F.inline(F.array(*(F.struct(F.lit(k).alias("license_id"), F.lit(t).alias(value)) for k, t in rows))))


def digests(licenses: DataFrame) -> DataFrame:
    """license_id and digest of a table of (license_id, text); texts without words have none."""
    return licenses.select("license_id", canonical(F.col("text")).alias("c")).where("c <> ''").select("license_id", F.sha2("c", 256).alias("digest"))


def known(spark: SparkSession) -> DataFrame:
    """license_id and digest of the licences given here, by text or by digest."""
    return digests(_rows(spark, KNOWN, "text")).unionByName(_rows(spark, DIGESTS, "digest"))


def scan(documents: DataFrame, licenses: DataFrame | None = None) -> DataFrame:
    """One row per input row: doc_id, the digest of the whole text, and the known licence (or that of a table of license_id and text) with that digest, or null.

    Of licences with one digest the least id is given; a licence of no words matches nothing. Null
    ids and repeated rows stay; an empty table gives no rows; other columns are not read. The
    licences are hashed once and joined by hash; Spark broadcasts them only while they are small."""
    found = known(documents.sparkSession) if licenses is None else digests(licenses)
    found = found.groupBy("digest").agg(F.min("license_id").alias("license_id"))
    return documents.select("doc_id", digest(F.col("text")).alias("digest")).join(found, "digest", "left").select("doc_id", "digest", "license_id")


def _sql(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def _canonical_sql(text: str) -> str:
    x = f"trim(regexp_replace(regexp_replace(lower(coalesce({text}, '')), {_sql(COPYRIGHT)}, ' ', 'g'), {_sql(OTHER)}, ' ', 'g'))"
    for given, counts_as in SPELLINGS:
        x = f"replace({x}, {_sql(given)}, {_sql(counts_as)})"
    return x


SCAN_SQL = f"""
WITH known(license_id, text) AS (VALUES {", ".join(f"({_sql(k)}, {_sql(t)})" for k, t in KNOWN)}),
given(license_id, digest) AS (VALUES {", ".join(f"({_sql(k)}, {_sql(d)})" for k, d in DIGESTS)}),
digests AS (SELECT digest, min(license_id) AS license_id FROM (SELECT license_id, sha256({_canonical_sql("text")}) AS digest FROM known UNION ALL SELECT * FROM given) GROUP BY 1)
SELECT d.doc_id, d.digest, k.license_id
FROM (SELECT doc_id, sha256({_canonical_sql("text")}) AS digest FROM documents) d LEFT JOIN digests k ON d.digest = k.digest
"""
