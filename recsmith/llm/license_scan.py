"""License scans by template-markup matching.

Templates are written with optional regions, ``<<opt>> ... <<end>>``, and
replaceable regions, ``<<any 0..9>>`` (so many free words) or
``<<one a|b|c>>`` (one of these words). A template compiles to an automaton
over words whose states are bits of an integer: a word moves the bits of the
matching states on, optional regions are jumps. A text is accepted where all
mandatory wording stands exactly, word for word, in order; the automaton starts
wherever the first mandatory words of the template occur.

Defined results: a null or empty text has no words, no label and score 0;
repeated rows and null ids are scanned row by row; texts of any length are
scanned whole; all labels that fit are given, so there are no ties; an empty
table gives an empty table; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCHEMA = ("doc_id bigint, n_words bigint, n_base bigint, first_word bigint, last_word bigint, "
          "base_labels string, labels string, score double, matches string")

# fixed values: base phrases and their labels
BASE_PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

# lower-cases A-Z and turns every ASCII character but letters and digits into a space
_NORM = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))

# fixed values: license wording in template markup, by label
TEMPLATES: dict[str, list[str]] = {
    "mit-notice": [
        "<<one released|licensed|distributed|available|published>> under the <<opt>>terms of the<<end>> mit license",
    ],
    "mit-text": [
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated "
        "documentation files the software to deal in the software without restriction including without limitation "
        "the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to "
        "permit persons to whom the software is furnished to do so subject to the following conditions the above "
        "copyright notice and this permission notice <<opt>>including the next paragraph<<end>> shall be included in "
        "all copies or substantial portions of the software",
    ],
    "apache-2.0": [
        "licensed under the apache license version 2 0",
        "licensed under the apache license <<opt>>version<<end>> 2 0 <<opt>>the license<<end>> you may not use this "
        "file except in compliance with the license",
        "apache 2 0 license",
    ],
    "gpl-3.0": [
        "licensed under the <<opt>>terms of the<<end>> gnu general public license <<opt>>gpl<<end>> version 3",
        "you can redistribute it and or modify it under the terms of the gnu general public license as published by "
        "the free software foundation either version 3 <<opt>>of the license<<end>>",
    ],
    "gpl-2.0": [
        "licensed under the <<opt>>terms of the<<end>> gnu general public license <<opt>>gpl<<end>> version 2",
        "you can redistribute it and or modify it under the terms of the gnu general public license as published by "
        "the free software foundation either version 2 <<opt>>of the license<<end>>",
    ],
    "cc-by-4.0": ["<<one licensed|released|available>> under <<opt>>a<<end>> <<one cc|creative>> <<opt>>commons<<end>> by 4 0"],
    "cc-by-nc-4.0": ["<<one licensed|released|available>> under <<opt>>a<<end>> cc by nc 4 0",
                     "creative commons attribution noncommercial 4 0 international <<opt>>public<<end>> license"],
    "cc-by-sa-4.0": ["<<one licensed|released|available>> under <<opt>>a<<end>> cc by sa 4 0",
                     "creative commons attribution sharealike 4 0 international <<opt>>public<<end>> license"],
    "bsd-2-clause": [
        "redistribution and use in source and binary forms with or without modification are permitted provided that "
        "the following conditions are met <<any 0..1>> redistributions of source code must retain the above copyright "
        "notice this list of conditions and the following disclaimer <<any 0..1>> redistributions in binary form must "
        "reproduce the above copyright notice this list of conditions and the following disclaimer in the "
        "documentation and or other materials provided with the distribution",
    ],
    "bsd-3-clause": [
        "redistributions in binary form must reproduce the above copyright notice this list of conditions and the "
        "following disclaimer in the documentation and or other materials provided with the distribution "
        "<<any 0..1>> neither the name of <<any 1..12>> may be used to endorse or promote products derived from this "
        "software without specific prior written permission",
    ],
    "isc": [
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby "
        "granted provided that the above copyright notice and this permission notice appear in all copies",
    ],
    "mpl-2.0": ["subject to the terms of the mozilla public license v 2 0"],
}


def words_of(text: str | None) -> list[bytes]:
    """Words: runs of ASCII letters and digits, lower-cased, and characters beyond ASCII."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_NORM).split()


@dataclass
class Automaton:
    """A compiled template."""
    label: str
    anchor: bytes                       # its first mandatory words, space before and after
    literal: dict[bytes, int]           # word -> states that it moves on
    free: int                           # states that any word moves on
    skips: list[tuple[int, int]]        # jumps from state to state, ascending
    accept: int                         # bit of the accepting state
    mandatory: int                      # words that each accepted text has
    first: dict[bytes, int] = field(default_factory=dict)

    def closure(self, states: int) -> int:
        for i, j in self.skips:
            if states >> i & 1:
                states |= 1 << j
        return states

    def longest(self, words: list[bytes], at: int) -> int | None:
        """End of the longest accepted run of words from ``at``; None if none."""
        states, end = self.closure(1), None
        for k in range(at, len(words)):
            states = self.closure((states & (self.literal.get(words[k], 0) | self.free)) << 1)
            if states & self.accept:
                end = k + 1
            if not states & ~self.accept:
                break
        return end


def compile_template(label: str, markup: str) -> Automaton:
    """Parses the markup and numbers the states; optional regions at either end
    of the template decide nothing and are left out."""
    parts = [x for x in re.split(r"(<<[^>]*>>)|\s+", markup) if x and x.strip()]
    literal: dict[bytes, int] = {}
    free, skips, opens, n, mandatory = 0, [], [], 0, 0
    lead: list[list[bytes]] = []
    leading = True
    for x in parts:
        if x == "<<opt>>":
            opens.append(n)
            leading = leading and not n
        elif x == "<<end>>":
            if not opens:
                raise ValueError(f"{label}: <<end>> without <<opt>>")
            skips.append((opens.pop(), n))
        elif m := re.fullmatch(r"<<any (\d+)\.\.(\d+)>>", x):
            least, most = int(m[1]), int(m[2])
            for i in range(most):
                free |= 1 << n
                if i >= least:
                    skips.append((n, n + most - i))
                n += 1
            leading = False
        else:
            choice = words_of(x[6:-2].replace("|", " ")) if x.startswith("<<one ") else words_of(x)
            if x.startswith("<<") and not x.startswith("<<one ") or not choice:
                raise ValueError(f"{label}: unknown markup {x}")
            for group in [choice] if x.startswith("<<one ") else [[w] for w in choice]:
                for w in group:
                    literal[w] = literal.get(w, 0) | 1 << n
                n += 1
                if not opens:
                    mandatory += 1
                    if leading:
                        lead.append(group)
    if opens:
        raise ValueError(f"{label}: <<opt>> without <<end>>")
    if not lead:
        raise ValueError(f"{label}: a template begins with mandatory words")
    first = next((i for i, g in enumerate(lead) if len(g) == 1), None)
    if first is None:
        raise ValueError(f"{label}: the first words need one that has no choice")
    last = first
    while last < len(lead) and len(lead[last]) == 1:
        last += 1
    anchor = b" " + b" ".join(g[0] for g in lead[first:last]) + b" "
    a = Automaton(label, anchor, literal, free, sorted(skips), 1 << n, mandatory)
    a.first = {b"": first}               # words of the template before the anchor
    return a


def compile_all(templates: dict[str, list[str]]) -> list[Automaton]:
    return [compile_template(k, m) for k, ms in templates.items() for m in ms]


def _places(text: bytes, phrase: bytes) -> list[int]:
    """Word indexes at which the phrase stands; both have single spaces at every word's sides."""
    out, at, seen, before = [], text.find(phrase), 0, 0
    while at >= 0:
        before += text.count(b" ", seen, at)
        seen = at
        out.append(before)
        at = text.find(phrase, at + 1)
    return out


def scan_text(text: str | None, automata: list[Automaton], phrases: dict[bytes, str]) -> tuple:
    """One row of the result without its id."""
    words = words_of(text)
    flat = b" " + b" ".join(words) + b" "
    places, base, labels, found = [], set(), set(), []
    for p, label in phrases.items():
        if at := _places(flat, p):
            places += at
            base.add(label)
    score = 0.5 if base else 0.0
    for a in automata:
        back = a.first[b""]
        for at in _places(flat, a.anchor):
            if at >= back and (end := a.longest(words, at - back)) is not None:
                labels.add(a.label)
                found.append(f"{a.label}@{at - back}-{end}")
                score = 1.0
    return (len(words), len(places), min(places, default=None), max(places, default=None),
            ",".join(sorted(base)), ",".join(sorted(base | labels)), score, " ".join(sorted(set(found))))


def scan(docs: DataFrame, templates: dict[str, list[str]] | None = None, phrases: dict[str, str] | None = None,
         text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """One row per document. score: 1 for a template accepted, 0.5 for a base
    phrase alone, else 0; matches: label@first word-end of each accepted run."""
    templates = TEMPLATES if templates is None else templates
    phrases = BASE_PHRASES if phrases is None else phrases
    compile_all(templates)               # wrong markup fails here

    def run(batches):
        automata = compile_all(templates)
        flat = {b" " + b" ".join(words_of(p)) + b" ": label for p, label in phrases.items()}
        kinds = [pa.int64()] * 4 + [pa.string(), pa.string(), pa.float64(), pa.string()]
        names = [x.split()[0] for x in SCHEMA.split(", ")]
        for batch in batches:
            rows = [scan_text(t, automata, flat) for t in batch.column("text").to_pylist()]
            cols = list(zip(*rows, strict=True)) if rows else [[] for _ in kinds]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], names=names)

    narrow = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    return narrow.mapInArrow(run, SCHEMA)
