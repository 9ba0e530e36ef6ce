"""License scans, in DataFrame functions only: MinHash bands over overlapping windows, then exact shingle containment.

Words are runs of letters and digits in lower case; a shingle is five words. For each template of t shingles the text
is cut into windows of t + step - 1 shingles at every step = ceil(t / 2) shingles, so some window covers any
occurrence. A window that holds `share` = 0.8 of the template has a Jaccard similarity of at least
0.8t / (t + step - 1 + 0.2t), never under 0.47; with 24 bands of one row it meets the template in some band with a
probability of at least 1 - 0.53**24 = 0.9999997. Windows retrieved by a band are verified by exact containment.

A band's value is the least of its hash function over the shingles. A window can only have a template's value if it
holds the template's least shingle of that band, so the text's shingles are looked up in the signatures (bands x
templates values, whatever the length of the templates); the band's least value is computed over the windows around
such a place only, and must equal the template's. Other windows can't collide in any band.

Result: one row per document id, template and best window (the first of equal ones). Null and empty texts and texts
of under five words have none; repeated rows of one id give one row, and so do all rows without an id; an empty table
gives no rows. Texts are scanned whole whatever their length. Templates of under five words are left out.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import let, table

#: Notices as they stand in files.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "MIT": "Released under the MIT License.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-SA-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "Apache-2.0-notice": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at',
    "GPL-3.0-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "MIT-grant": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction',
    "BSD-grant": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "ISC-grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",
}
#: License texts, whole but for the notice of the author and, of BSD, the heading.
TEMPLATES |= {
    "MIT-text": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "ISC-text": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "BSD-2-Clause-text": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
    "BSD-3-Clause-text": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.

3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
    "Zlib-text": """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.

Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.

2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.

3. This notice may not be removed or altered from any source distribution.""",
    "Unlicense-text": """This is free and unencumbered software released into the public domain.

Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.

In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "Apache-2.0-header": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at

http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.""",
}
SHINGLE, BANDS, SHARE = 5, 24, 0.8


def template_words(text: str) -> list[str]:
    return re.findall(r"[a-z0-9]+", text.lower())


def read_templates(spark: SparkSession, path: str) -> dict[str, str]:
    """Further templates: the text files of a folder by their names, whole; a folder of licenses is small."""
    rows = spark.read.option("wholetext", True).text(path).select(F.col("_metadata.file_name").alias("name"), "value").collect()
    return {r["name"].removesuffix(".txt"): r["value"] for r in rows}


def word_array(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0))


def shingle_hashes(words: Column, shingle: int = SHINGLE) -> Column:
    """Hash of each run of so many words."""

    def over(w):
        last = F.size(w) - shingle
        at = F.when(last >= 0, F.sequence(F.lit(0), F.greatest(last, F.lit(0)))).otherwise(F.array().cast("array<int>"))
        return F.transform(at, lambda i: F.xxhash64(*(F.get(w, i + k) for k in range(shingle))))

    return let(words, over)


def least(hashes: Column, band: Column) -> Column:
    """The least value of the band's hash function."""
    return F.array_min(F.transform(hashes, lambda h: F.xxhash64(h, band)))


def step_of(t):
    return math.ceil(t / 2)


def signatures(spark: SparkSession, templates: dict[str, str], shingle: int = SHINGLE, bands: int = BANDS) -> DataFrame:
    """(license, t, shingles, band, least, mark): mark is the shingle that has the band's least value. One row for each template and band."""
    known = {k: v for k, v in ((k, template_words(v)) for k, v in templates.items()) if len(v) >= shingle}
    t = spark.createDataFrame(sorted(known.items()), "license string, words array<string>").withColumn("shingles", F.array_distinct(shingle_hashes(F.col("words"), shingle)))
    t = t.select("license", (F.size("words") - shingle + 1).alias("t"), "shingles", F.explode(F.sequence(F.lit(0), F.lit(bands - 1))).alias("band"))
    best = F.array_min(F.transform("shingles", lambda h: F.struct(F.xxhash64(h, F.col("band")).alias("least"), h.alias("mark"))))
    return t.withColumn("best", best).select("license", "t", "shingles", "band", "best.least", "best.mark")


def scan(docs: DataFrame, templates: dict[str, str] = TEMPLATES, share: float = SHARE, shingle: int = SHINGLE, bands: int = BANDS) -> DataFrame:
    """(doc_id, license, containment, first_word): templates of which a window holds the share of shingles; first_word counts from 0."""
    spark = docs.sparkSession
    signs = signatures(spark, templates, shingle, bands)
    marks = [r[0] for r in signs.select("mark").distinct().collect()]  # bands x templates at most
    reach = signs.agg(F.max(F.col("t") + F.ceil(F.col("t") / 2))).first()[0] or 1
    d = docs.select("doc_id", shingle_hashes(word_array(F.col("text")), shingle).alias("hashes"))
    places = F.array_compact(F.transform("hashes", lambda h, i: F.when(h.isin(marks), F.struct(h.alias("mark"), i.alias("at")))))
    # Outer: for an inner explode Catalyst adds a filter on the array's size and computes the array twice. The row carries the stretch
    # that windows around the place can reach.
    d = d.select("doc_id", "hashes", F.explode_outer(places).alias("p")).where(F.col("p").isNotNull())
    low = F.greatest(F.col("p.at") - reach, F.lit(0))
    d = d.select("doc_id", F.col("p.mark").alias("mark"), F.col("p.at").alias("at"), low.alias("low"), F.slice("hashes", low + 1, F.lit(2 * reach + 1)).alias("near"))
    # The table of signatures is bounded by the templates given.
    d = d.join(F.broadcast(signs), "mark")
    step = F.ceil(F.col("t") / 2).cast("int")
    numbers = F.sequence(F.greatest(F.lit(0), F.ceil((F.col("at") - F.col("t") - step + 2) / step)).cast("int"), F.floor(F.col("at") / step).cast("int"))
    d = d.select("*", F.explode(F.transform(numbers, lambda w: w * step)).alias("first"))
    d = d.withColumn("window", F.slice("near", F.col("first") - F.col("low") + 1, F.col("t") + step - 1))
    d = d.where(least(F.col("window"), F.col("band")) == F.col("least"))
    held = F.size(F.array_intersect("window", "shingles")) / F.size("shingles")
    d = d.select("doc_id", "license", "first", held.alias("containment")).where(F.col("containment") >= share)
    # Windows that several bands retrieve are one from here on: only ids and numbers are shuffled.
    best = d.groupBy("doc_id", "license").agg(F.max("containment").alias("containment"), F.min_by("first", F.struct(-F.col("containment"), "first")).alias("first_word"))
    return best.select("doc_id", "license", "containment", "first_word")


def collision_probability(t: int, share: float = SHARE, n: int = BANDS) -> float:
    """The least probability that a window with the share of a template of t shingles meets it in a band."""
    j = share * t / (t + step_of(t) - 1 + (1 - share) * t)
    return 1 - (1 - j) ** n


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))
