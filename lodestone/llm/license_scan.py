"""License scans by template-markup matching.

A template is a line of licence wording with markup: text between
``<<beginOptional>>`` and ``<<endOptional>>`` may be missing, and
``<<var;name="...";max=N>>`` stands for 0 to N arbitrary words.  A template is
compiled into a token automaton; it accepts a run of words whose mandatory
wording matches exactly, word for word.  Base phrases are templates without
markup whose every place is counted.  Optional regions at a template's edges
would change nothing, since a template may match anywhere.

Rows: one result per input row.  A null text counts as empty: no words, no
labels, score 0.  Very long texts are scanned whole.  Repeated rows give
repeated results; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from lodestone.llm.common import small_batches, table

# Phrases of the contract and their labels.
BASE_PHRASES = {
    "cc by": "cc-by",
    "general public license": "gpl",
    "all rights reserved": "reserved",
}

_NO_WARRANTY = 'this software is provided by <<var;name="by";max=12>> as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed in no event shall <<var;name="who";max=12>> be liable for any direct indirect incidental special exemplary or consequential damages including but not limited to procurement of substitute goods or services loss of use data or profits or business interruption however caused and on any theory of liability whether in contract strict liability or tort including negligence or otherwise arising in any way out of the use of this software even if advised of the possibility of such damage'
_BSD = "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"
_BSD_1_2 = f'{_BSD} <<var;name="item";max=1>> redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer <<var;name="item";max=1>> redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution'
_BSD_NAMES = '<<var;name="item";max=1>> neither the name of <<var;name="holder";max=12>> nor the names of <<var;name="others";max=4>> may be used to endorse or promote products derived from this software without specific prior written permission'
_BSD_AD = '<<var;name="item";max=1>> all advertising materials mentioning features or use of this software must display the following acknowledgement this product includes software developed by <<var;name="holder";max=12>>'
_GNU = 'is free software you can redistribute it and or modify it under the terms of the gnu {} public license as published by the free software foundation either version <<var;name="version";max=2>> of the license or <<beginOptional>> at your option <<endOptional>> any later version'

# Licence wordings with optional and replaceable regions.
TEMPLATES = {
    "0bsd": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted the software is provided as is and the author disclaims all warranties",
    "agpl-notice": _GNU.format("affero general"),
    "apache-2.0": "licensed under the apache license version 2.0",
    "apache-2.0-notice": "licensed under the apache license version 2.0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at <<beginOptional>> https <<endOptional>> <<beginOptional>> http <<endOptional>> <<beginOptional>> www apache org licenses license 2.0 <<endOptional>> unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied see the license for the specific language governing permissions and limitations under the license",
    "bsd": _BSD,
    "bsd-2-clause": f"{_BSD_1_2} {_NO_WARRANTY}",
    "bsd-3-clause": f"{_BSD_1_2} {_BSD_NAMES} {_NO_WARRANTY}",
    "bsd-4-clause": f"{_BSD_1_2} {_BSD_AD} {_BSD_NAMES} {_NO_WARRANTY}",
    "cc-by-nc-4.0": "cc by nc 4.0",
    "cc-by-nc-4.0-notice": 'licensed under <<beginOptional>> a <<endOptional>> creative commons attribution <<beginOptional>> noncommercial <<endOptional>> <<beginOptional>> non commercial <<endOptional>> 4.0 international <<beginOptional>> public <<endOptional>> license',
    "cc-by-sa-4.0": "cc by sa 4.0",
    "copyright-notice": 'copyright <<beginOptional>> c <<endOptional>> <<var;name="holder";max=8>> all rights reserved',
    "gpl-header": _GNU.format("general"),
    "gpl-notice": 'licensed under the <<beginOptional>> gnu <<endOptional>> general public license <<beginOptional>> as published by the free software foundation <<endOptional>> <<beginOptional>> either <<endOptional>> version',
    "isc": "permission to use copy modify <<beginOptional>> and <<endOptional>> <<beginOptional>> or <<endOptional>> distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies the software is provided as is and <<var;name=\"who\";max=6>> disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness in no event shall <<var;name=\"who\";max=6>> be liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits whether in an action of contract negligence or other tortious action arising out of or in connection with the use or performance of this software",
    "lgpl-notice": _GNU.format("lesser general"),
    "mit": "released under the mit license",
    "mit-full": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this permission notice <<beginOptional>> including the next paragraph <<endOptional>> shall be included in all copies or substantial portions of the software the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement in no event shall <<var;name=\"who\";max=8>> be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software",
    "mit-text": 'permission is hereby granted free of charge to any person obtaining a copy of this software <<var;name="files";max=6>> to deal in the software without restriction',
    "mpl-2.0-notice": "this source code form is subject to the terms of the mozilla public license v 2.0 if a copy of the mpl was not distributed with this file you can obtain one at <<beginOptional>> https <<endOptional>> <<beginOptional>> http <<endOptional>> mozilla org mpl 2.0",
    "unlicense": "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means",
    "wtfpl": "everyone is permitted to copy and distribute verbatim or modified copies of this license document and changing it is allowed as long as the name is changed",
    "zlib": "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions",
}

#: Lower-cases A-Z and turns every byte that is in no word into a space.
_WORDS = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256)
)
_MARK = re.compile(r"<<\s*(beginOptional|endOptional|var)([^<>]*)>>|([^<>]+)")


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(_WORDS).split()


class TemplateAutomaton:
    """Nondeterministic token automaton, made deterministic word by word as texts need it."""

    def __init__(self, markup: str):
        #: moves[s]: the word that leads from s to s+1; None: any word; False: no word does.
        self.moves: list[bytes | None | bool] = []
        self.skips: dict[int, list[int]] = {}
        open_at: list[int] = []
        run: list[bytes] = []
        self.literal: list[bytes] = []
        for kind, rest, text in _MARK.findall(markup):
            if text:
                found = words_of(text)
                self.moves += found
                run = run + found if not open_at else run
                self.literal = max(self.literal, run, key=len)
                continue
            if kind == "beginOptional":
                open_at.append(len(self.moves))
            elif kind == "endOptional":
                self.skips.setdefault(open_at.pop(), []).append(len(self.moves))
            else:
                most = re.search(r"max=(\d+)", rest)
                for _ in range(int(most[1]) if most else 1):
                    self.skips.setdefault(len(self.moves), []).append(len(self.moves) + 1)
                    self.moves.append(None)
            run = []
        if open_at or not self.literal:
            raise ValueError(f"template needs mandatory words and closed optional regions: {markup!r}")
        self.end = len(self.moves)
        self.alphabet = {x for x in self.moves if x}
        self.start = self._close({0})
        self.first = {self.moves[s] for s in self.start if s < self.end}
        self.table: dict[tuple[frozenset[int], bytes | None], frozenset[int]] = {}

    def _close(self, states: set[int]) -> frozenset[int]:
        todo, seen = list(states), set(states)
        while todo:
            for s in self.skips.get(todo.pop(), ()):
                if s not in seen:
                    seen.add(s)
                    todo.append(s)
        return frozenset(seen)

    def accepts_at(self, words: list[bytes], at: int) -> bool:
        states = self.start
        while True:
            if self.end in states:
                return True
            if not states or at >= len(words):
                return False
            word = words[at] if words[at] in self.alphabet else None
            key = (states, word)
            if (after := self.table.get(key)) is None:
                after = self.table[key] = self._close({s + 1 for s in states if self.moves[s] is None or self.moves[s] == word})
            states, at = after, at + 1

    def found_in(self, words: list[bytes]) -> bool:
        any_word = None in self.first
        return any(self.accepts_at(words, i) for i, w in enumerate(words) if any_word or w in self.first)


@lru_cache(maxsize=8)
def compiled(templates: tuple[tuple[str, str], ...]) -> list[tuple[str, bytes, TemplateAutomaton]]:
    out = []
    for label, markup in templates:
        automaton = TemplateAutomaton(markup)
        out.append((label, b" " + b" ".join(automaton.literal) + b" ", automaton))
    return out


def scan_text(text: str | None, base: dict[str, str], templates: tuple[tuple[str, str], ...]) -> tuple:
    """n_words, n_base, first_word, last_word, base labels, all labels, score."""
    words = words_of(text)
    line = b" " + b" ".join(words) + b" "
    starts: list[int] = []
    base_labels, labels = set(), set()
    for phrase, label in base.items():
        needle = b" " + phrase.encode() + b" "
        at, blanks, last = line.find(needle), 0, 0
        while at >= 0:
            blanks, last = blanks + line.count(b" ", last, at), at  # each stretch is counted once
            starts.append(blanks)
            base_labels.add(label)
            at = line.find(needle, at + 1)
    for label, literal, automaton in compiled(templates):
        if literal in line and automaton.found_in(words):
            labels.add(label)
    score = 1.0 if labels else 0.5 if base_labels else 0.0
    return (
        len(words), len(starts), min(starts, default=None), max(starts, default=None),
        ",".join(sorted(base_labels)), ",".join(sorted(labels | base_labels)), score,
    )


SCHEMA = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", base: dict[str, str] | None = None, templates: dict[str, str] | None = None) -> DataFrame:
    """Licence labels of every row of docs: one narrow pass, no shuffle.

    score is 1 if a template's mandatory wording is met in full, 0.5 if only
    base phrases occur, else 0.
    """
    base = BASE_PHRASES if base is None else base
    marked = tuple(sorted((TEMPLATES if templates is None else templates).items()))
    small_batches(docs.sparkSession)
    out_schema = pa.schema([
        ("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()),
        ("last_word", pa.int64()), ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64()),
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [scan_text(t, base, marked) for t in batch.column(1).to_pylist()]
            columns = list(zip(*rows, strict=True)) if rows else [[] for _ in range(7)]
            arrays = [batch.column(0)] + [pa.array(c, f.type) for c, f in zip(columns, list(out_schema)[1:], strict=True)]
            yield pa.RecordBatch.from_arrays(arrays, schema=out_schema)

    picked = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"))
    return picked.mapInArrow(run, SCHEMA)


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))


def sql_pattern(markup: str) -> str:
    """A template as a regular expression over words that are each followed by a space."""
    out = [" "]
    for kind, rest, text in _MARK.findall(markup):
        if text:
            out += [w.decode() + " " for w in words_of(text)]
        elif kind == "var":
            most = re.search(r"max=(\d+)", rest)
            out.append("([^ ]+ ){0,%s}" % (most[1] if most else 1))
        else:
            out.append("(" if kind == "beginOptional" else ")?")
    return "".join(out)


_NORMAL = r"regexp_replace(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+', ' ', 'g')"
_TEMPLATE_CASES = ",\n      ".join(f"CASE WHEN regexp_matches(t, '{sql_pattern(m)}') THEN '{label}' END" for label, m in sorted(TEMPLATES.items()))
OP7_SQL = f"""
WITH d AS (
  SELECT doc_id, ' ' || trim({_NORMAL}, ' ') || ' ' AS t FROM documents
), w AS (
  SELECT doc_id, t, list_filter(string_split(t, ' '), lambda x: x <> '') AS w FROM d
), p AS (
  SELECT doc_id, t, len(w) AS n_words,
    list_filter(range(0, len(w)), lambda i: w[i + 1] = 'cc' AND w[i + 2] = 'by') AS cc,
    list_filter(range(0, len(w)), lambda i: w[i + 1] = 'general' AND w[i + 2] = 'public' AND w[i + 3] = 'license') AS gpl,
    list_filter(range(0, len(w)), lambda i: w[i + 1] = 'all' AND w[i + 2] = 'rights' AND w[i + 3] = 'reserved') AS res
  FROM w
), l AS (
  SELECT *, list_concat(cc, list_concat(gpl, res)) AS places,
    list_filter([CASE WHEN len(cc) > 0 THEN 'cc-by' END, CASE WHEN len(gpl) > 0 THEN 'gpl' END, CASE WHEN len(res) > 0 THEN 'reserved' END], lambda x: x IS NOT NULL) AS base,
    list_filter([
      {_TEMPLATE_CASES}
    ], lambda x: x IS NOT NULL) AS found
  FROM p
)
SELECT doc_id, n_words, len(places) AS n_base, list_min(places) AS first_word, list_max(places) AS last_word,
  array_to_string(list_sort(base), ',') AS base_labels,
  array_to_string(list_sort(list_concat(base, found)), ',') AS labels,
  CASE WHEN len(found) > 0 THEN 1.0 WHEN len(base) > 0 THEN 0.5 ELSE 0.0 END::DOUBLE AS score
FROM l
"""
