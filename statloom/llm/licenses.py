"""License scans: windows of normalised text against licence templates by the Dice coefficient of word bigrams.

Texts and templates are normalised alike: lower case, all but letters and digits to blanks. A template of L words is
compared with windows of L words of the text, at a stride of L div 20 words (1 at least), so a licence is found wherever
it stands: within a line, over several lines or paragraphs. Sets of b and a bigrams can reach a coefficient t only if
t / (2 - t) <= b / a <= (2 - t) / t, and then share at least a * t / (2 - t) bigrams; so only those templates are
candidates of a text that share as many different bigrams with all of it, and their windows alone are made. The bigrams
of all templates are a table, each bigram of a template once, that is broadcast up to ``BROADCAST_CHARS``. All of it is SQL: no code outside Spark's own
functions.

Defined cases: null, empty and word-less texts and those of one word have no licence; of templates with equal coefficients
the first by name is the best; a very long text is read whole, in one row's work; rows with equal doc_id and text get equal
results, each its own row; an empty table gives none; further columns, whatever their names, are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The notices by which public licences are applied, the short licences themselves, and the openings of
#: long ones. Further templates, such as whole texts of long licences, can be given to ``scan``.
TEMPLATES = {
    "MIT-notice": "Released under the MIT License.",
    "MIT-licensed": "This software is licensed under the MIT License.",
    "MIT": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    "BSD-notice": "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
    "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    "GPL-2.0-notice": "This work is licensed under the GNU General Public License, version 2.",
    "GPL-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0-or-later": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    "LGPL-3.0-notice": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "AGPL-3.0-notice": "This work is licensed under the GNU Affero General Public License, version 3.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "CC-BY-4.0-notice": "Licensed under CC BY 4.0.",
    "CC-BY-NC-4.0-notice": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0-notice": "Licensed under CC BY-SA 4.0.",
    "CC-BY-4.0": "This work is licensed under the Creative Commons Attribution 4.0 International License.",
    "CC-BY-SA-4.0": "This work is licensed under the Creative Commons Attribution-ShareAlike 4.0 International License.",
    "CC-BY-NC-4.0": "This work is licensed under the Creative Commons Attribution-NonCommercial 4.0 International License.",
    "CC0-1.0": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    "Unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    "BSD-2-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    "BSD-3-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    "Zlib": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution.",
    "BSL-1.0": "Distributed under the Boost Software License, Version 1.0.",
    "GPL-2.0-or-later": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    "LGPL-2.1-or-later": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version. This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details.",
    "AGPL-3.0-or-later": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Affero General Public License for more details.",
    "GPL-3.0-opening": "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007 Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed. Preamble The GNU General Public License is a free, copyleft license for software and other kinds of works.",
    "GPL-2.0-opening": "GNU GENERAL PUBLIC LICENSE Version 2, June 1991 Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed. Preamble The licenses for most software are designed to take away your freedom to share and change it.",
    "LGPL-3.0-opening": "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007 Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed. This version of the GNU Lesser General Public License incorporates the terms and conditions of version 3 of the GNU General Public License, supplemented by the additional permissions listed below.",
    "Apache-2.0-opening": "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/ TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION 1. Definitions. \"License\" shall mean the terms and conditions for use, reproduction, and distribution as defined by Sections 1 through 9 of this document.",
    "MPL-2.0-opening": "Mozilla Public License Version 2.0 1. Definitions 1.1. \"Contributor\" means each individual or legal entity that creates, contributes to the creation of, or owns Covered Software.",
    "All-rights-reserved-short": "All rights reserved.",
    "All-rights-reserved": "All rights reserved. No part of this work may be reproduced without permission.",
}


#: Templates of so many characters in all, which have fewer bigrams, are broadcast; beyond that their bigrams are joined.
BROADCAST_CHARS = 1 << 22


def normal(text: str) -> str:
    return rf"trim(regexp_replace(lower({text}), '[^\\p{{L}}\\p{{N}}]+', ' '))"


def words(text: str) -> str:
    return f"split({normal(text)}, ' ')"


def grams(w: str) -> str:
    """SQL for the bigrams of a named array of words, in their order; no repeated ones are left out."""
    return f"CASE WHEN size({w}) > 1 THEN transform(sequence(1, size({w}) - 1), i -> xxhash64({w}[i - 1], {w}[i])) END"


def let(name: str, value: str, body: str) -> str:
    """SQL that names a value, so that it is made once."""
    return f"transform(array({value}), {name} -> {body})[0]"


def template_table(spark: SparkSession, templates: dict[str, str]) -> DataFrame:
    """license, n_words, t_grams: a row for each template of two words or more."""
    known = spark.createDataFrame(list(templates.items()), "license string, notice string")
    parts = known.select("license", F.expr(words("notice")).alias("w"))
    return parts.where("size(w) > 1").select("license", F.size("w").alias("n_words"), F.expr(f"array_distinct({grams('w')})").alias("t_grams"))


def candidates(docs: DataFrame, table: DataFrame, t: float, small: bool) -> DataFrame:
    """h1, h2, license, n_words, t_grams: the templates that share enough different bigrams with a whole text. small: the
    templates may be broadcast."""
    inverted = table.select("license", F.size("t_grams").alias("n"), F.explode("t_grams").alias("gram"))
    inverted = F.broadcast(inverted) if small else inverted
    each = docs.select("h1", "h2", F.explode(F.expr(let("w", words("text"), grams("w")))).alias("gram"))
    shared = each.join(inverted, "gram").groupBy("h1", "h2", "license", "n").agg(F.size(F.collect_set("gram")).alias("both"))
    return shared.where(F.col("both") >= F.col("n") * (t / (2 - t)) - 1e-9).join(table, "license").select("h1", "h2", "license", "n_words", "t_grams")


def matches(docs: DataFrame, t: float = 0.8, templates: dict[str, str] = TEMPLATES) -> DataFrame:
    """h1, h2, license, dice: for docs (h1, h2, text), each template at or above t in its best window."""
    small = sum(map(len, templates.values())) <= BROADCAST_CHARS
    met = docs.join(candidates(docs, template_table(docs.sparkSession, templates), t, small), ["h1", "h2"])
    # A window is at most half a stride from one of the stride, so it shares that many bigrams less or more. Where this may
    # reach t, every offset around is compared.
    near = "(greatest(1, n_words DIV 20) + 1) DIV 2"
    window = lambda at, body: let("x", f"array_distinct(slice(g, {at} + 1, n_words - 1))", body)
    reach = f"2 * (size(array_intersect(x, t_grams)) + {near}) >= {t - 1e-9} * (greatest(size(x) - {near}, 0) + size(t_grams))"
    coarse = f"filter(sequence(0, size(g) - 1, greatest(1, n_words DIV 20)), at -> {window('at', reach)})"
    around = f"array_distinct(flatten(transform({coarse}, at -> sequence(greatest(at - {near}, 0), least(at + {near}, size(g) - 1)))))"
    coefficient = "2 * size(array_intersect(x, t_grams)) / (size(x) + size(t_grams))"
    best = let("g", let("w", words("text"), grams("w")), f"array_max(transform({around}, at -> {window('at', coefficient)}))")
    found = met.select("h1", "h2", "license", F.expr(best).alias("dice")).where(F.col("dice") >= t - 1e-9)
    return found.select("h1", "h2", "license", F.round("dice", 6).alias("dice")).distinct()  # rows of equal doc_id and text


def scan(docs: DataFrame, t: float = 0.8, templates: dict[str, str] = TEMPLATES) -> DataFrame:
    """doc_id, licenses (sorted, null if none), best (license), dice (its coefficient): a row for each document."""
    key = [F.xxhash64("doc_id", "text").alias("h1"), F.xxhash64(F.lit(1), "doc_id", "text").alias("h2")]
    rows = docs.select("doc_id", *key, "text")
    found = matches(rows, t, templates).groupBy("h1", "h2").agg(
        F.array_join(F.sort_array(F.collect_set("license")), ",").alias("licenses"), F.min(F.struct((-F.col("dice")).alias("d"), "license")).alias("top")
    )
    found = found.select("h1", "h2", "licenses", F.col("top.license").alias("best"), (-F.col("top.d")).alias("dice"))
    return rows.select("doc_id", "h1", "h2").join(found, ["h1", "h2"], "left").drop("h1", "h2")
