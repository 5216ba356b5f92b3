"""Licence scans by the Dice coefficient over word bigrams, in DataFrame functions only.

A text is normalised (lower case, every run of other characters than letters and
digits a space) and read in passages: its lines, the text as a whole if it has more
than one line, and windows of words across line breaks. A passage and a template, as
sets of word bigrams of sizes a and b, have the Dice coefficient 2 |both| / (a + b);
it can reach ``least`` only if the smaller size is at least least / (2 - least) times
the larger, so a passage's number of words prunes templates before any bigram is made.

Windows find notices that are wrapped over lines or share their line with other words.
A window of a template begins and ends with one of its bigrams (taking other bigrams
off the ends never lowers the coefficient) and has at most (2 - least) / least times as
many bigrams, counted with repeats. Of the windows that begin at one bigram the best is
kept (then the shortest); of those that share a word, the best, then the shortest, then
the first. A window that shares a word with a line that matches its template is the
same finding and not listed again; nor is any window if the text as a whole matches.

Null and empty texts match nothing; neither do passages of one word. Repeated rows
and ties between templates are all kept: every template that a passage matches is
listed. Columns of the input that clash with the output's are replaced.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Names and texts of licence notices.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    "BSD-3-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "CC-BY-4.0": "Licensed under CC BY 4.0.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "MIT": "Released under the MIT License.",
    "MIT-notice": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
}
#: Whole licence texts, without title and copyright line.
FULL_TEXTS = {
    "0BSD-text": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.
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
    "BSL-1.0-text": """Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:
The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE, TITLE AND NON-INFRINGEMENT. IN NO EVENT SHALL THE COPYRIGHT HOLDERS OR ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE FOR ANY DAMAGES OR OTHER LIABILITY, WHETHER IN CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "ISC-text": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "MIT-text": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "Unlicense-text": """This is free and unencumbered software released into the public domain.
Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.
In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "Zlib-text": """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.
Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:
1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.
2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution.""",
}
_HIT = "array<struct<template:string,dice:double>>"


def template_bigrams(text: str) -> list[str]:
    words = re.findall(r"[^\W_]+", text.lower())
    return sorted({f"{a} {b}" for a, b in zip(words, words[1:], strict=False)})


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), an array, with value computed once."""
    return F.flatten(F.transform(F.array(value), use))


def _bigrams(words: Column) -> Column:
    return F.when(F.size(words) > 1, F.zip_with(F.slice(words, 1, F.size(words) - 1), F.slice(words, 2, F.size(words) - 1), lambda a, b: F.concat(a, F.lit(" "), b))).otherwise(F.array().cast("array<string>"))


def _dice(own: Column, grams: Column) -> Column:
    return 2.0 * F.size(F.array_intersect(own, grams)) / (F.size(own) + F.size(grams))


def _hits(words: Column, stock: Column, least: float) -> Column:
    """(template, dice) of every template that a passage's words match."""

    def judged(own: Column) -> Column:
        ratio = least / (2 - least)
        near = F.filter(stock, lambda t: F.least(F.size(own), F.size(t["grams"])) >= ratio * F.greatest(F.size(own), F.size(t["grams"])) - 1e-9)
        scored = F.transform(near, lambda t: F.struct(t["name"].alias("template"), _dice(own, t["grams"]).alias("dice")))
        return F.filter(scored, lambda x: x["dice"] >= least)

    return _let(F.array_distinct(_bigrams(words)), judged)


def _best_windows(grams: Column, t: Column, least: float) -> Column:
    """(loss, size, start) of the best window at each of the template's bigrams: loss is the negative coefficient, start and size count bigrams."""

    def of_hits(hits: Column) -> Column:
        def at(start: Column, k: Column) -> Column:
            ends = F.filter(F.slice(hits, k + t["fewest"], t["most"]), lambda e: e - start < t["most"])
            own = lambda e: F.array_distinct(F.slice(grams, start + 1, e - start + 1))
            return F.array_min(F.transform(ends, lambda e: F.struct((-_dice(own(e), t["grams"])).alias("loss"), (e - start + 1).alias("size"), start.alias("start"))))

        return F.filter(F.transform(hits, at), lambda w: w["loss"] <= -least)

    return _let(F.array_compact(F.transform(grams, lambda g, i: F.when(F.array_contains(t["grams"], g), i))), of_hits)


def _apart(windows: Column) -> Column:
    """Windows of which no two share a word, the best first."""
    meets = lambda a, b: (a["start"] <= b["start"] + b["size"]) & (b["start"] <= a["start"] + a["size"])
    none = F.array().cast("array<struct<loss:double,size:int,start:int>>")
    return F.aggregate(F.array_sort(windows), none, lambda kept, w: F.when(F.exists(kept, lambda k: meets(k, w)), kept).otherwise(F.concat(kept, F.array(w))))


def _window_hits(lines: Column, words: Column, found: Column, stock: Column, every: list[str], least: float) -> Column:
    """(template, dice) of the windows that neither a line nor the whole text gave."""

    def of_grams(grams: Column) -> Column:
        def of_common(common: Column) -> Column:
            # a template of which too few bigrams are anywhere in the text has no window
            likely = F.filter(stock, lambda t: (F.size(F.array_intersect(common, t["grams"])) >= t["fewest"]) & ~F.exists(found, lambda x: (x["template"] == t["name"]) & (x["line"] < 0)))
            return F.when(F.size(likely) > 0, _let(F.flatten(F.transform(lines, lambda w, i: F.array_repeat(i, F.size(w)))), lambda line_of: F.flatten(F.transform(likely, lambda t: of_template(t, line_of))))).otherwise(F.array().cast(_HIT))

        def of_template(t: Column, line_of: Column) -> Column:
            def of_had(had: Column) -> Column:
                fresh = F.filter(_best_windows(grams, t, least), lambda w: ~F.arrays_overlap(F.slice(line_of, w["start"] + 1, w["size"] + 1), had))
                return F.transform(_apart(fresh), lambda w: F.struct(t["name"].alias("template"), (-w["loss"]).alias("dice")))

            return _let(F.transform(F.filter(found, lambda x: x["template"] == t["name"]), lambda x: x["line"]), of_had)

        return _let(F.array_intersect(grams, F.array(*map(F.lit, every))), of_common)

    return _let(_bigrams(words), of_grams)


def license_matches(docs: DataFrame, *, templates: dict[str, str] | None = None, least: float = 0.8, text_col: str = "text", carry: list[str] | None = None) -> DataFrame:
    """``carry`` (all columns if None) plus matches: array of (template, dice), one for each passage and template that match."""
    kinds = {n: g for n, t in sorted((TEMPLATES if templates is None else templates).items()) if (g := template_bigrams(t))}
    carry = [c for c in (docs.columns if carry is None else carry) if c != "matches"]
    if not kinds:
        return docs.select(*carry, F.array().cast(_HIT).alias("matches"))
    # a passage of w words has at most w - 1 bigrams, but repeats can leave it few: only the lower bound holds for words
    fewest = math.ceil(min(map(len, kinds.values())) * least / (2 - least) - 1e-9) + 1
    most = max(map(len, kinds.values())) * (2 - least) / least
    limits = lambda b: (F.lit(math.ceil(b * least / (2 - least) - 1e-9)).alias("fewest"), F.lit(math.floor(b * (2 - least) / least + 1e-9)).alias("most"))
    stock = F.array(*[F.struct(F.lit(n).alias("name"), F.array(*map(F.lit, b)).alias("grams"), *limits(len(b))) for n, b in kinds.items()])
    plain = F.regexp_replace(F.lower(F.coalesce(F.col(text_col).cast("string"), F.lit(""))), r"[^\p{L}\p{N}\n]+", " ")
    own = docs.select(*[F.col(f"`{c}`") for c in dict.fromkeys(carry)], F.split(plain, "\n", -1).alias("__lines"))
    split = own.withColumn("__lines", F.transform("__lines", lambda line: F.filter(F.split(line, " +"), lambda w: w != ""))).withColumn("__words", F.flatten("__lines"))
    # b bigrams need between 2 and b + 1 different words
    passage = lambda words, line: F.struct(words.alias("words"), line.alias("line"))
    whole = F.when(F.size("__lines") > 1, F.array(passage(F.col("__words"), F.lit(-1)))).otherwise(F.array().cast("array<struct<words:array<string>,line:int>>"))
    passages = F.filter(F.concat(F.transform("__lines", passage), whole), lambda p: (F.size(p["words"]) >= fewest) & (F.size(F.array_distinct(p["words"])) <= most + 1))
    located = lambda p: F.transform(_hits(p["words"], stock, least), lambda x: F.struct(x["template"].alias("template"), x["dice"].alias("dice"), p["line"].alias("line")))
    found = split.withColumn("__found", F.flatten(F.transform(passages, located)))
    windows = F.when(F.size("__words") >= fewest, _window_hits(F.col("__lines"), F.col("__words"), F.col("__found"), stock, sorted({g for b in kinds.values() for g in b}), least)).otherwise(F.array().cast(_HIT))
    hits = F.concat(F.transform("__found", lambda x: F.struct(x["template"].alias("template"), x["dice"].alias("dice"))).cast(_HIT), windows.cast(_HIT))
    return found.select(*carry, hits.alias("matches"))
