"""Licence scans with a positional rare-token index.

Every word of every template is posted as word -> (template, position). Of each
file, the words of highest IDF over the templates are looked up, ``RAREST`` for
each template, and those of its key phrases; each of their places and postings
says where the template would start (the place less the position), and the
postings of several words are intersected by that start: a start that ``VOTES``
of the looked-up words agree on is a candidate. There the mandatory key phrases
must stand at their own places, and the share of all the template's words that
agree by position is the score; from ``agree`` on, the label holds. Key phrases
have ``VOTES`` words or more, so no such place is missed. Starts may lie before
the file, so texts cut at either end count.

A base phrase is a template whose words must all agree: the postings of its words
are intersected, rarest first, and every start left is a place. Base phrases do
not depend on the looked-up words, so none is missed.

Templates of the method are notices and the openings and conditions of common
licences, whole sentences as their authors publish them.

Null text counts as empty: no words, no labels, score 0. Repeated rows give
repeated results; columns other than doc_id and text are ignored; an empty table
gives an empty result.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import released, table

SCHEMA = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"
#: Everything ASCII but digits and letters separates words; A-Z become a-z.
WORDS = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))
#: Distinct words of a file that are looked up for a template, besides its key words; how many of all these must agree on a start.
RAREST, VOTES = 8, 3


@dataclass(frozen=True)
class Template:
    label: str
    text: str
    #: Phrases that must stand at their own places in the aligned text.
    keys: tuple[str, ...] = ()
    #: The least share of the template's words that must agree by position.
    agree: float = 0.8
    #: A base template is a phrase whose places count.
    base: bool = False


# Licence texts as published.
MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
BSD2 = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."""
BSD_END = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
APACHE = """you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""
GPL = """you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>."""
ZLIB = """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution."""
UNLICENSE = """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."""
MPL = """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."""

TEMPLATES = (
    Template("mit", "mit license", base=True),
    Template("apache", "apache license", base=True),
    Template("gpl", "general public license", base=True),
    Template("mit-text", MIT, ("permission is hereby granted", "without restriction")),
    Template("isc-text", ISC, ("for any purpose with or without fee",)),
    Template("bsd-conditions", BSD2, ("source and binary forms", "must retain the above copyright notice")),
    Template("bsd-disclaimer", BSD_END, ("procurement of substitute goods",)),
    Template("apache-text", APACHE, ("except in compliance with the license",)),
    Template("gpl-text", GPL, ("redistribute it and or modify it", "gnu general public license")),
    Template("zlib-text", ZLIB, ("must not be misrepresented",)),
    Template("unlicense-text", UNLICENSE, ("free and unencumbered software",)),
    Template("mpl-text", MPL, ("mozilla public license",)),
    Template("mit-grant", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", ("permission is hereby granted",)),
    Template("mit-notice", "released under the mit license", ("under the mit",)),
    Template("apache-notice", "licensed under the apache license", ("under the apache",)),
    Template("apache-grant", "you may not use this file except in compliance with the license", ("except in compliance",)),
    Template("gpl-notice", "licensed under the gnu general public license", ("gnu general public",)),
    Template("gpl-grant", "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation", ("redistribute it and or modify",)),
    Template("bsd-grant", "redistribution and use in source and binary forms with or without modification are permitted", ("source and binary forms",)),
    Template("mpl-notice", "this source code form is subject to the terms of the mozilla public license", ("mozilla public license",)),
    Template("isc-grant", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", ("for any purpose",)),
    Template("cc-notice", "licensed under a creative commons attribution", ("creative commons attribution",)),
)


def split(text: str) -> list[bytes]:
    return text.encode().translate(WORDS).split()


@dataclass
class Index:
    templates: tuple[Template, ...] = TEMPLATES
    words: list[list[bytes]] = field(default_factory=list)
    #: word -> [(template, position)], of all templates' words.
    postings: dict[bytes, list[tuple[int, int]]] = field(default_factory=lambda: defaultdict(list))
    idf: dict[bytes, float] = field(default_factory=dict)
    #: For each template, the places and words of its key phrases.
    keys: list[list[tuple[int, list[bytes]]]] = field(default_factory=list)

    def __post_init__(self):
        self.words = [split(t.text) for t in self.templates]
        for k, x in enumerate(self.words):
            for i, w in enumerate(x):
                self.postings[w].append((k, i))
        self.postings = dict(self.postings)
        self.idf = {w: math.log(len(self.templates) / len({k for k, _ in p})) for w, p in self.postings.items()}
        for t, x in zip(self.templates, self.words):
            own = [split(key) for key in t.keys]
            if not t.base and len({w for key in own for w in key}) < VOTES:
                raise ValueError(f"the key phrases of {t.label} have too few words")
            self.keys.append([(next(i for i in range(len(x)) if x[i : i + len(key)] == key), key) for key in own])
        self.base = [(k, sorted(enumerate(self.words[k]), key=lambda p: (-self.idf[p[1]], p[0]))) for k, t in enumerate(self.templates) if t.base]
        #: A file without one of these holds nothing: each template's rarest key word, or a base phrase's rarest word.
        self.needed = {own[0][1] for _, own in self.base} | {max((w for _, key in keys for w in key), key=lambda w: self.idf[w]) for keys in self.keys if keys}

    def base_places(self, at: dict[bytes, np.ndarray]) -> Iterator[tuple[int, np.ndarray]]:
        """(template, starts): where all the words of a base phrase agree."""
        for k, own in self.base:
            starts = None
            for i, w in own:
                if w not in at:
                    starts = None
                    break
                here = at[w] - i
                starts = here if starts is None else np.intersect1d(starts, here, assume_unique=True)
                if not len(starts):
                    break
            if starts is not None and len(starts):
                yield k, starts

    def candidates(self, at: dict[bytes, np.ndarray]) -> Iterator[tuple[int, int]]:
        """(template, start) that enough of the file's rarest licence words agree on."""
        of: dict[int, dict[bytes, list[int]]] = defaultdict(lambda: defaultdict(list))
        for w in at:
            for k, i in self.postings[w]:
                if not self.templates[k].base:
                    of[k][w].append(i)
        for k, own in of.items():
            must = {w for _, key in self.keys[k] for w in key}
            if not must <= own.keys():
                continue
            rare = sorted(own.keys() - must, key=lambda w: (-self.idf[w], len(at[w]) * len(own[w]), w))[:RAREST]
            # a word has one vote for a start
            starts = [np.unique(np.concatenate([at[w] - i for i in own[w]])) for w in (*must, *rare)]
            start, votes = np.unique(np.concatenate(starts), return_counts=True)
            for s in start[votes >= VOTES].tolist():
                yield k, s

    def scan(self, text: bytes | None) -> tuple:
        words = (text or b"").translate(WORDS).split()
        places: set[int] = set()
        base: set[str] = set()
        labels: set[str] = set()
        score = 0.0
        if not self.needed.isdisjoint(words):
            found: dict[bytes, list[int]] = defaultdict(list)
            for i, w in enumerate(words):
                if w in self.postings:
                    found[w].append(i)
            at = {w: np.array(x) for w, x in found.items()}
            for k, starts in self.base_places(at):
                places.update(starts.tolist())
                base.add(self.templates[k].label)
                score = 1.0
            for k, start in self.candidates(at):
                if any(start + i < 0 or words[start + i : start + i + len(key)] != key for i, key in self.keys[k]):
                    continue
                own = self.words[k]
                low, high = max(0, -start), min(len(own), len(words) - start)
                share = sum(map(bytes.__eq__, own[low:high], words[start + low : start + high])) / len(own)
                if share >= self.templates[k].agree:
                    labels.add(self.templates[k].label)
                    score = max(score, share)
        return len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(base)), ",".join(sorted(base | labels)), score


def scan_licenses(docs: DataFrame, templates: tuple[Template, ...] = TEMPLATES) -> DataFrame:
    """doc_id, counts and places of the base phrases, labels and the best agreement of each text, read whole."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index(templates)
        types = [pa.int64()] * 5 + [pa.string()] * 2 + [pa.float64()]
        for b in batches:
            found = [index.scan(x) for x in b.column(1).cast(pa.binary()).to_pylist()]
            cols = [b.column(0), *zip(*found)] if found else [[]] * 8
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=[f.split()[0] for f in SCHEMA.split(", ")])

    return docs.select(docs["doc_id"].cast("long"), docs["text"]).mapInArrow(lambda batches: released(run(batches)), SCHEMA)


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents"))
