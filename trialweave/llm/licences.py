"""Licence scan by canonical digests: normalised whole texts and lines are hash-joined to known licence texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

# Short public licence texts and notices (SPDX identifier, text).
KNOWN = [
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "This project is licensed under the MIT License."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License");'),
    ("GPL-3.0-only", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-2.0-only", "This work is licensed under the GNU General Public License, version 2."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC0-1.0", "Licensed under CC0 1.0."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("BSL-1.0", "Distributed under the Boost Software License, Version 1.0."),
    ("MIT", """MIT License

Copyright (c) <year> <copyright holders>

Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""),
    ("ISC", """Copyright (c) <year> <owner>

Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""),
    ("0BSD", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""),
]

# British endings and words with one canonical form, as (pattern, replacement) over lower-case words.
SPELLINGS = [
    (r"\b(sub)?licenc(e|es|ed|ing)\b", "$1licens$2"),
    (r"\b([a-z]{3,})is(e|es|ed|er|ing|ation)\b", "$1iz$2"),
    (r"\b(fav|lab|hon|behavi|col)our", "$1or"),
    (r"\b(cent|calib)re\b", "$1er"),
    (r"\bpractise\b|\bpractize\b", "practice"),
    (r"\b(acknowledg|judg)ement", "$1ment"),
    (r"\bcopyright owner", "copyright holder"),
]

COPYRIGHT = r"^[^\p{L}\p{N}©]*(?:copyright\b|\(c\)|©|all rights reserved).*$"


def canonical(line: Column) -> Column:
    """One line in lower case, one space between words, without punctuation, in one spelling; copyright lines are empty.

    A copyright line starts with "Copyright", "(c)", the sign or "All rights reserved". Null stays null.
    """
    out = F.regexp_replace(F.lower(line), COPYRIGHT, "")
    out = F.regexp_replace(out, r"[^\p{L}\p{N}]+", " ")
    for pattern, replacement in SPELLINGS:
        out = F.regexp_replace(out, pattern, replacement)
    return F.trim(out)


def known_licences(spark: SparkSession, entries: list[tuple[str, str]] = KNOWN) -> DataFrame:
    """(license_id, text) as a literal table, whose size the planner knows."""
    rows = F.array(*[F.struct(F.lit(i).alias("license_id"), F.lit(t).alias("text")) for i, t in entries])
    return spark.range(1).select(F.inline(rows))


def _line_forms(text: Column) -> Column:
    return F.transform(F.split(text, r"\r\n|\r|\n"), canonical)


def _whole(forms: Column) -> Column:
    return F.array_join(F.filter(forms, lambda x: x != ""), " ")


def digests(licences: DataFrame) -> DataFrame:
    """(digest, license_id): one row for each distinct canonical text; of several identifiers the smallest."""
    form = _whole(_line_forms(F.col("text")))
    return (
        licences.select(form.alias("form"), "license_id")
        .where("form <> '' AND license_id IS NOT NULL")
        .groupBy(F.sha2("form", 256).alias("digest"))
        .agg(F.min("license_id").alias("license_id"))
    )


def scan(docs: DataFrame, licences: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Every document, and every line of a document, whose whole canonical text is a known licence.

    Columns: key, scope ("document" or "line"), line (number from 1 among all lines; 0 for the document), license_id,
    digest. A document of one line that matches gives both rows. Null and empty texts, and lines that are empty once
    normalised, match nothing; repeated rows each give their rows. Other columns are not read. The join is on the
    digest: the known table is broadcast where the planner finds it small, and a frequent line meets one row only.
    """
    lines = docs.select(F.col(key).alias("_key"), _line_forms(F.col(text)).alias("_forms")).where("_forms IS NOT NULL")
    units = F.concat(
        F.array(F.struct(F.lit(0).alias("line"), _whole(F.col("_forms")).alias("form"))),
        F.transform("_forms", lambda form, i: F.struct((i + 1).alias("line"), form.alias("form"))),
    )
    each = lines.select("_key", F.inline(units)).where("form <> ''").select("_key", "line", F.sha2("form", 256).alias("digest"))
    return each.join(digests(licences), "digest").select(
        F.col("_key").alias(key), F.when(F.col("line") == 0, "document").otherwise("line").alias("scope"), "line", "license_id", "digest",
    )
