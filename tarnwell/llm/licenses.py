"""Licence scan: Dice coefficient over word bigrams against licence templates.

Text is normalised to words of ASCII letters (lower case), digits and other characters; ASCII punctuation
separates words. Every run of neighbouring words of a document, across lines and paragraphs, is a window. A
window with bigrams B matches a template with bigrams A (both with multiplicity) by

    2 |A and B| / (|A| + |B|)

The best window from any start begins and ends with a bigram of the template and has at most |A| (2 - t) / t
bigrams at threshold t, of which at least |A| t / (2 - t) are the template's. Only starts with so many of them
ahead are tried, each with every end; that loses no match.

Of overlapping windows of one template the one with the highest coefficient stays, and of overlapping windows of
different templates the one that shares most bigrams, so that a notice inside a longer one is not told twice.
``licenses`` holds all that stay, by place. The best of them is reported besides: the highest coefficient, then
the longer template, then its name, then the first window.

Null, empty and one-word texts match nothing. Very long texts are scanned whole. Repeated rows are scanned each; null ids
pass through; extra columns pass by unread, those named like the results are replaced. An empty table gives an empty result.
"""

from __future__ import annotations

from bisect import bisect, insort
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import _text as tx
from ._common import by_value, lean, others, table

THRESHOLD, CELLS = 0.85, 1 << 18
for _m in (__name__, tx.__name__):
    by_value(_m)

# Licence notices and short licence texts.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-header": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    "MIT": "Released under the MIT License.",
    "MIT-text": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "ISC-text": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU General Public License along with this program. If not, see https://www.gnu.org/licenses/.",
    "MPL-2.0-header": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-SA-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
    "Unlicense-text": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.",
    "0BSD-text": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    "AGPL-3.0-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Affero General Public License for more details. You should have received a copy of the GNU Affero General Public License along with this program. If not, see https://www.gnu.org/licenses/.",
    "AGPL-3.0": "This work is licensed under the GNU Affero General Public License, version 3.",
    "Apache-2.0-notice": "This project is licensed under the Apache License 2.0 - see the LICENSE file for details.",
    "Artistic-2.0": "This is free software, licensed under the Artistic License 2.0 (GPL Compatible).",
    "Artistic-perl": "This program is free software; you can redistribute it and/or modify it under the same terms as Perl itself.",
    "Beerware": "As long as you retain this notice you can do whatever you want with this stuff. If we meet some day, and you think this stuff is worth it, you can buy me a beer in return.",
    "BSD-2-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    "BSD-3-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    "BSD-4-Clause-terms": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. All advertising materials mentioning features or use of this software must display the following acknowledgement: This product includes software developed by the organization. 4. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "BSD-style": "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
    "BSD-notice": "This software is distributed under the terms of the BSD license.",
    "BSL-1.0-header": "Distributed under the Boost Software License, Version 1.0. (See accompanying file LICENSE_1_0.txt or copy at http://www.boost.org/LICENSE_1_0.txt)",
    "BSL-1.0-text": "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following: The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor.",
    "CC0-1.0": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    "CC0-1.0-header": "To the extent possible under law, the author(s) have dedicated all copyright and related and neighboring rights to this software to the public domain worldwide. This software is distributed without any warranty. You should have received a copy of the CC0 Public Domain Dedication along with this software. If not, see http://creativecommons.org/publicdomain/zero/1.0/.",
    "CC-BY-3.0": "This work is licensed under a Creative Commons Attribution 3.0 Unported License.",
    "CC-BY-SA-3.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 3.0 Unported License.",
    "CC-BY-NC-4.0-notice": "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    "CC-BY-NC-SA-4.0": "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License.",
    "CC-BY-NC-ND-4.0": "This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License.",
    "CC-BY-ND-4.0": "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License.",
    "CC-BY-SA-text-notice": "Text is available under the Creative Commons Attribution-ShareAlike License; additional terms may apply.",
    "CDDL-1.0-header": "The contents of this file are subject to the terms of the Common Development and Distribution License (the License). You may not use this file except in compliance with the License. When distributing the software, include this License Header Notice in each file.",
    "EPL-1.0-header": "All rights reserved. This program and the accompanying materials are made available under the terms of the Eclipse Public License v1.0 which accompanies this distribution, and is available at http://www.eclipse.org/legal/epl-v10.html",
    "EPL-2.0-header": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/",
    "EUPL-1.2-header": "Licensed under the EUPL, Version 1.2 or as soon they will be approved by the European Commission, subsequent versions of the EUPL (the Licence); You may not use this work except in compliance with the Licence.",
    "GFDL-1.3": "Permission is granted to copy, distribute and/or modify this document under the terms of the GNU Free Documentation License, Version 1.3 or any later version published by the Free Software Foundation; with no Invariant Sections, no Front-Cover Texts, and no Back-Cover Texts.",
    "GPL-2.0": "This work is licensed under the GNU General Public License, version 2.",
    "GPL-2.0-header": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU General Public License along with this program; if not, write to the Free Software Foundation, Inc., 51 Franklin Street, Fifth Floor, Boston, MA 02110-1301 USA.",
    "HPND-text": "Permission to use, copy, modify and distribute this software and its documentation for any purpose and without fee is hereby granted, provided that the above copyright notice appear in all copies, and that both that the copyright notice and this permission notice appear in supporting documentation, and that the name of the copyright holder not be used in advertising or publicity pertaining to distribution of the software without specific, written permission.",
    "LGPL-2.1-header": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version. This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details. You should have received a copy of the GNU Lesser General Public License along with this library; if not, write to the Free Software Foundation, Inc., 51 Franklin Street, Fifth Floor, Boston, MA 02110-1301 USA.",
    "LGPL-3.0-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details. You should have received a copy of the GNU Lesser General Public License along with this program. If not, see https://www.gnu.org/licenses/.",
    "MIT-notice": "This project is licensed under the MIT License - see the LICENSE file for details.",
    "MIT-licensed": "Licensed under the MIT license.",
    "MIT-0-text": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "MPL-1.1-header": "The contents of this file are subject to the Mozilla Public License Version 1.1 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.mozilla.org/MPL/ Software distributed under the License is distributed on an AS IS basis, WITHOUT WARRANTY OF ANY KIND, either express or implied. See the License for the specific language governing rights and limitations under the License.",
    "MS-PL": "This source is subject to the Microsoft Public License. All other rights reserved.",
    "NCSA-terms": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal with the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimers. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimers in the documentation and/or other materials provided with the distribution.",
    "OFL-1.1": "This Font Software is licensed under the SIL Open Font License, Version 1.1. This license is also available with a FAQ at https://openfontlicense.org",
    "PostgreSQL-text": "Permission to use, copy, modify, and distribute this software and its documentation for any purpose, without fee, and without a written agreement is hereby granted, provided that the above copyright notice and this paragraph and the following two paragraphs appear in all copies.",
    "PSF-2.0": "Licensed to PSF under a Contributor Agreement.",
    "WTFPL-text": "Everyone is permitted to copy and distribute verbatim or modified copies of this license document, and changing it is allowed as long as the name is changed.",
    "X11-clause": "Except as contained in this notice, the name of the copyright holders shall not be used in advertising or otherwise to promote the sale, use or other dealings in this Software without prior written authorization.",
    "Zlib-text": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution.",
    "SPDX-Apache-2.0": "SPDX-License-Identifier: Apache-2.0",
    "SPDX-MIT": "SPDX-License-Identifier: MIT",
    "SPDX-GPL-2.0-only": "SPDX-License-Identifier: GPL-2.0-only",
    "SPDX-GPL-3.0-or-later": "SPDX-License-Identifier: GPL-3.0-or-later",
    "SPDX-BSD-3-Clause": "SPDX-License-Identifier: BSD-3-Clause",
}

_WORD = np.arange(256, dtype=np.uint8)
_WORD[65:91] += 32
for _b in range(128):
    if not chr(_b).isalnum():
        _WORD[_b] = 10 if _b == 10 else 32


def _bigrams(hashes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bigram hashes of segments of ``counts`` words and their number per segment."""
    number = np.maximum(counts - 1, 0)
    first = np.repeat(np.cumsum(counts) - counts - (np.cumsum(number) - number), number) + np.arange(number.sum())
    return tx.mix(hashes[first] * tx.BASE + hashes[first + 1]), number


class Templates:
    def __init__(self, texts: dict[str, str], threshold: float):
        self.threshold, self.names, self.bags, self.sizes = threshold, [], [], []
        for name, text in sorted(texts.items(), key=lambda x: x[0]):
            part = _WORD[np.frombuffer(text.encode(), np.uint8)]
            s, e, c = tx.words(part, np.array([0, len(part)]))
            grams, _ = _bigrams(tx.span_hash(part, s, e), c)
            self.names.append(name)
            self.bags.append(Counter(grams.tolist()))
            self.sizes.append(len(grams))
        self.all = np.unique(np.array([g for b in self.bags for g in b], np.uint64))

        self.times = [np.array([b[g] for g in self.all.tolist()], np.int64) for b in self.bags]

    def windows(self, k: int, at: np.ndarray, which: np.ndarray, doc: np.ndarray) -> Iterator[tuple[int, float, int, int, int]]:
        """Document, coefficient, shared bigrams, first and last bigram of the best window from each start in template ``k``.

        at, which, doc: ascending places of bigrams that some template has, their numbers in ``all`` and documents.
        """
        a, t, times = self.sizes[k], self.threshold, self.times[k]
        if not a:
            return
        own = times[which] > 0
        at, which, doc = at[own], which[own], doc[own]
        longest = int(a * (2 - t) / t + 1e-9)
        ahead = np.searchsorted(at, at + longest) - np.arange(len(at))
        starts = np.flatnonzero(ahead >= a * t / (2 - t) - 1e-9)
        if not len(starts):
            return
        # A bigram counts unless the window holds as many equal ones before it as the template has in all.
        turn = np.lexsort((at, which, doc))
        back = np.arange(len(at)) - times[which[turn]]
        same = (back >= 0) & (which[turn[back]] == which[turn]) & (doc[turn[back]] == doc[turn])
        before = np.empty(len(at), np.int64)
        before[turn] = np.where(same, at[turn[back]], -1)
        width = min(longest, len(at))
        step = max(1, CELLS // width)
        for i in range(0, len(starts), step):
            s = starts[i : i + step, None]
            e = s + np.arange(width)
            inside = e < len(at)
            e = np.minimum(e, len(at) - 1)
            inside &= (at[e] < at[s] + longest) & (doc[e] == doc[s])
            shared = np.cumsum(inside & (before[e] < at[s]), axis=1)
            dice = np.where(inside, 2 * shared / (a + at[e] - at[s] + 1), 0.0)
            best = np.argmax(dice, axis=1)
            for r in np.flatnonzero(dice[np.arange(len(s)), best] >= t):
                c = best[r]
                yield int(doc[s[r, 0]]), float(dice[r, c]), int(shared[r, c]), int(at[s[r, 0]]), int(at[e[r, c]])


def _apart(windows: list[tuple], first: int) -> list[tuple]:
    """Windows in the given order but those that share a word with an earlier one; [first], [first + 1]: first and last bigram."""
    kept: list[tuple[int, int]] = []
    out = []
    for w in windows:
        i = bisect(kept, (w[first], 1 << 62))
        if not (i and kept[i - 1][1] >= w[first] - 1) and not (i < len(kept) and kept[i][0] <= w[first + 1] + 1):
            insort(kept, (w[first], w[first + 1]))
            out.append(w)
    return out


def _scan(part: np.ndarray, off: np.ndarray, templates: Templates) -> dict[int, list[tuple]]:
    """All (dice, size, name, start, end) by document number of a block, by place."""
    low = _WORD[part]
    starts, ends, counts = tx.words(low, off)
    grams, number = _bigrams(tx.span_hash(low, starts, ends), counts)
    if not len(grams):
        return {}
    spot = np.minimum(np.searchsorted(templates.all, grams), len(templates.all) - 1)
    at = np.flatnonzero(templates.all[spot] == grams)
    doc = np.repeat(np.arange(len(number)), number)[at]
    found = defaultdict(list)
    for k, name in enumerate(templates.names):
        own = defaultdict(list)
        for d, dice, shared, i, j in templates.windows(k, at, spot[at], doc):
            own[d].append((-dice, -shared, i, j))
        for d, ws in own.items():
            found[d] += [(shared, dice, name, i, j, templates.sizes[k]) for dice, shared, i, j in _apart(sorted(ws), 2)]
    out = {}
    for d, ws in found.items():
        word = int(counts[:d].sum() - number[:d].sum())  # from a bigram's place to its first word's
        ws = sorted(_apart(sorted(ws), 3), key=lambda w: w[3])
        out[d] = [(-dice, a, name, int(starts[i + word] - off[d]), int(ends[j + word + 1] - off[d])) for _, dice, name, i, j, a in ws]
    return out


_ALL = pa.list_(pa.struct([("license", pa.string()), ("dice", pa.float64()), ("start_byte", pa.int64()), ("end_byte", pa.int64())]))


def _scanner(names: list[str], texts: dict[str, str], threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        templates = Templates(texts, threshold)
        for batch in batches:
            data, at = tx.text_buffer(batch.column(batch.num_columns - 1))
            for i, j in tx.blocks(at):
                found = _scan(data[at[i] : at[j]], at[i : j + 1] - at[i], templates)
                rows = [found.get(d, []) for d in range(j - i)]
                best = [min(r, key=lambda w: (-w[0], -w[1], *w[2:])) if r else None for r in rows]
                cols = [batch.column(k).slice(i, j - i) for k in range(batch.num_columns - 1)]
                cols += [pa.array([r and r[2] for r in best], pa.string()), pa.array([r and r[0] for r in best], pa.float64())]
                cols += [pa.array([r and r[3] for r in best], pa.int64()), pa.array([r and r[4] for r in best], pa.int64())]
                cols.append(pa.array([[{"license": w[2], "dice": w[0], "start_byte": w[3], "end_byte": w[4]} for w in r] for r in rows], _ALL))
                yield pa.RecordBatch.from_arrays(cols, [*names, "license", "dice", "start_byte", "end_byte", "licenses"])

    return lean(run)


def scan(docs: DataFrame, text: str = "text", templates: dict[str, str] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """Other columns of ``docs`` with license, dice and the bytes of the best window, null where nothing matches, and all ``licenses``."""
    keep = others(docs, text, "license", "dice", "start_byte", "end_byte", "licenses")
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema] + [
        "license string, dice double, start_byte long, end_byte long, licenses array<struct<license: string, dice: double, start_byte: bigint, end_byte: bigint>>"
    ]
    return docs.select(*keep, text).mapInArrow(_scanner(keep, templates or TEMPLATES, threshold), ", ".join(fields))


def op4_license_dice(spark, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
