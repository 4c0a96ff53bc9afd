"""License scans: text units against licence templates by the Dice coefficient of their word bigrams, in DataFrame functions only.

Units are a document's lines, its paragraphs (runs of two or more lines without a blank one, where there is any other line) and, if it has several lines, the
whole text. So a notice is found where it stands by itself on a line, wrapped over the lines of a paragraph, or as all of a text; one inside a longer paragraph
is not. Text is normalised to lower-case words of letters and digits. With A and B the sets of different word bigrams, Dice = 2 |A and B| / (|A| + |B|)
can reach the threshold t only if |A| is between t / (2 - t) |B| and (2 - t) / t |B|; other templates are pruned for a unit, and units that fit no
template are left before their bigrams are made. The templates are short notices, the paragraphs of longer licences that tell them from others, and the whole
texts of the short licences (MIT, ISC, BSD, zlib). Whole texts of the Apache, GPL and MPL licences are not among them; their notices are.

Null and empty texts and units of fewer than two words have no bigrams and no rows. A document has a row for each unit and template
that agree, several where several templates do; repeated rows give repeated rows; a null id stays null.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandloom.llm.common import ids_and_texts

# The wording of public licences, from which templates are put together.
_MIT_GRANT = 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:'
_MIT_NOTICE = "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."
_MIT_DISCLAIMER = 'The software is provided "as is", without warranty of any kind, express or implied, including but not limited to the warranties of merchantability, fitness for a particular purpose and noninfringement. In no event shall the authors or copyright holders be liable for any claim, damages or other liability, whether in an action of contract, tort or otherwise, arising from, out of or in connection with the software or the use or other dealings in the software.'
_ISC_GRANT = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."
_ISC_DISCLAIMER = 'The software is provided "as is" and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness. In no event shall the author be liable for any special, direct, indirect, or consequential damages or any damages whatsoever resulting from loss of use, data or profits, whether in an action of contract, negligence or other tortious action, arising out of or in connection with the use or performance of this software.'
_BSD_GRANT = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"
_BSD_CLAUSES = "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_BSD_THIRD = "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_BSD_DISCLAIMER = 'This software is provided by the copyright holders and contributors "as is" and any express or implied warranties, including, but not limited to, the implied warranties of merchantability and fitness for a particular purpose are disclaimed. In no event shall the copyright holder or contributors be liable for any direct, indirect, incidental, special, exemplary, or consequential damages (including, but not limited to, procurement of substitute goods or services; loss of use, data, or profits; or business interruption) however caused and on any theory of liability, whether in contract, strict liability, or tort (including negligence or otherwise) arising in any way out of the use of this software, even if advised of the possibility of such damage.'
_ZLIB_WARRANTY = 'This software is provided "as-is", without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.'
_ZLIB_GRANT = "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:"
_ZLIB_CLAUSES = "1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution."
_APACHE_NOTICE = 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0'
_APACHE_DISCLAIMER = 'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.'
_GPL = "This program is free software{sep} you can redistribute it and/or modify it under the terms of the GNU {kind} as published by the Free Software Foundation{sep2} either version {version} of the License, or (at your option) any later version."
_MPL = "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."

# Usual notices of public licences, their telling paragraphs and the whole texts of the short ones, by SPDX identifier.
TEMPLATES = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0; you may not use this file except in compliance with the License."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("BSD-3-Clause", _BSD_GRANT),
    ("MPL-2.0", _MPL),
    ("MIT", _MIT_GRANT),
    ("MIT", _MIT_DISCLAIMER),
    ("ISC", _ISC_GRANT),
    ("Apache-2.0", _APACHE_NOTICE),
    ("Apache-2.0", _APACHE_DISCLAIMER),
    ("GPL-3.0", _GPL.format(kind="General Public License", version=3, sep=":", sep2=",")),
    ("GPL-2.0", _GPL.format(kind="General Public License", version=2, sep=";", sep2=";")),
    ("BSD-3-Clause", _BSD_THIRD),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("ISC", _ISC_DISCLAIMER),
    ("BSD-2-Clause", _BSD_CLAUSES),
    ("BSD-2-Clause", _BSD_DISCLAIMER),
    ("Zlib", _ZLIB_WARRANTY),
    ("Zlib", _ZLIB_GRANT),
    ("Zlib", _ZLIB_CLAUSES),
    ("AGPL-3.0", _GPL.format(kind="Affero General Public License", version=3, sep=":", sep2=",")),
    ("LGPL-3.0", _GPL.format(kind="Lesser General Public License", version=3, sep=":", sep2=",")),
    ("LGPL-2.1", _GPL.format(kind="Lesser General Public License", version=2.1, sep=";", sep2=";")),
    ("MPL-2.0", _MPL + " If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("BSL-1.0", "Distributed under the Boost Software License, Version 1.0. (See accompanying file LICENSE_1_0.txt or copy at http://www.boost.org/LICENSE_1_0.txt)"),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("Unlicense", "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
    ("MIT", f"MIT License {_MIT_GRANT} {_MIT_NOTICE} {_MIT_DISCLAIMER}"),
    ("ISC", f"ISC License {_ISC_GRANT} {_ISC_DISCLAIMER}"),
    ("BSD-2-Clause", f"BSD 2-Clause License {_BSD_GRANT} {_BSD_CLAUSES} {_BSD_DISCLAIMER}"),
    ("BSD-3-Clause", f"BSD 3-Clause License {_BSD_GRANT} {_BSD_CLAUSES} 3. {_BSD_THIRD} {_BSD_DISCLAIMER}"),
    ("Zlib", f"{_ZLIB_WARRANTY} {_ZLIB_GRANT} {_ZLIB_CLAUSES}"),
    ("Apache-2.0", f"{_APACHE_NOTICE} {_APACHE_DISCLAIMER}"),
)


def _words(text: Column) -> Column:
    return F.split(F.btrim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " ")), " ")


def _bigrams(words: Column) -> Column:
    pairs = F.zip_with(words, F.slice(words, F.lit(2), F.greatest(F.size(words) - 1, F.lit(0))), lambda a, b: F.when(b.isNotNull(), F.concat_ws(" ", a, b)))
    return F.array_distinct(F.filter(pairs, lambda p: p.isNotNull()))


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of value, which is evaluated once."""
    return F.transform(F.array(value), body).getItem(0)


def _units(text: Column) -> Column:
    """A text's units: line (the first, from 0; -1 for the whole text), n_lines, unit."""

    def units(lines: Column) -> Column:
        n = F.size(lines)
        blank = lambda i: F.length(F.btrim(F.get(lines, i), F.lit(" \t\n\x0b\f\r"))) == 0
        places = F.sequence(F.lit(0), n - 1)
        begins = F.filter(places, lambda i: ~blank(i) & ((i == 0) | blank(i - 1)))
        ends = F.filter(places, lambda i: ~blank(i) & ((i == n - 1) | blank(i + 1)))
        runs = F.filter(F.arrays_zip(begins.alias("b"), ends.alias("e")), lambda r: (r["b"] < r["e"]) & (r["e"] - r["b"] + 1 < n))
        unit = lambda line, count, value: F.struct(line.cast("int").alias("line"), count.cast("int").alias("n_lines"), value.alias("unit"))
        single = F.transform(lines, lambda x, i: unit(i, F.lit(1), x))
        paragraphs = F.transform(runs, lambda r: unit(r["b"], r["e"] - r["b"] + 1, F.array_join(F.slice(lines, r["b"] + 1, r["e"] - r["b"] + 1), "\n")))
        return F.when(n == 1, single).otherwise(F.concat(single, paragraphs, F.array(unit(F.lit(-1), n, text))))

    return _let(F.split(text, "\n"), units)


def scan(docs: DataFrame, templates: Sequence[tuple[str, str]] = TEMPLATES, threshold: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, line (the unit's first, from 0, or -1 for the whole text), n_lines, license, template (its number), dice."""
    if not 0 < threshold <= 1:
        raise ValueError("the threshold is above 0 and at most 1")
    made = docs.sparkSession.createDataFrame([(i, name, text) for i, (name, text) in enumerate(templates)], "template int, license string, notice string")
    made = made.select("template", "license", _bigrams(_words(F.col("notice"))).alias("b")).where("size(b) > 0").collect()
    if not made:
        raise ValueError("no template has two words")
    low, high = threshold / (2 - threshold), (2 - threshold) / threshold
    least, most = min(low * len(r["b"]) for r in made) - 1e-9, max(high * len(r["b"]) for r in made) + 1e-9
    literal = F.array(*[F.struct(F.lit(r["template"]).alias("template"), F.lit(r["license"]).alias("license"), F.lit(r["b"]).alias("b")) for r in made])

    def agree(a: Column) -> Column:
        fitting = F.filter(literal, lambda t: (F.size(a) >= low * F.size(t["b"]) - 1e-9) & (F.size(a) <= high * F.size(t["b"]) + 1e-9))
        scored = F.transform(fitting, lambda t: F.struct(t["license"].alias("license"), t["template"].alias("template"), F.round(2 * F.size(F.array_intersect(a, t["b"])) / (F.size(a) + F.size(t["b"])), 9).alias("dice")))
        return F.filter(scored, lambda s: s["dice"] >= threshold - 1e-9)

    # A unit of n bigrams has more than 2 n characters, and n + 1 or more words, of which at most n + 1 are different.
    fits = lambda w: (F.size(w) - 1 >= least) & (F.size(F.array_distinct(w)) - 1 <= most)
    found = _let(_words(F.col("unit")), lambda w: F.when(fits(w), _let(_bigrams(w), agree)))
    units = ids_and_texts(docs, id_col, text_col).select("doc_id", F.inline(_units(F.col("text")))).where(F.length("unit") >= 2 * least + 1)
    return units.select("doc_id", "line", "n_lines", F.inline(found))
