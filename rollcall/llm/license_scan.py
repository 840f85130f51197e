"""Fuzzy search for short licence notices.

Texts become lower-case words joined by single blanks. A notice of L characters may differ
in k = L // 10 characters. Cut into k + 1 pieces, at least one piece is unchanged in any such
occurrence, so one automaton over all pieces finds every place worth a look; there the
``regex`` library's bounded-error matching verifies the notice, and tells its span and edits.
Exact phrases are found the same way (k = 0).

Everything happens within a row: one read, no shuffle. Null text counts as empty and gives
zero words, null places, empty labels and score 0. Texts of any length are scanned whole.
Repeated rows give repeated rows, an empty table an empty one; only ``doc_id`` and ``text``
are read, so further columns are left out.
"""

from __future__ import annotations

from collections import defaultdict

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Exact phrases and their labels.
PHRASES = (
    ("gnu general public license", "gpl"),
    ("apache license", "apache"),
    ("cc by", "cc-by"),
    ("mit license", "mit"),
)
# Opening or naming words of common licence notices.
NOTICES = (
    ("gnu general public license", "gpl"),
    ("gnu lesser general public license", "lgpl"),
    ("gnu affero general public license", "agpl"),
    ("gnu free documentation license", "gfdl"),
    ("licensed under the apache license", "apache"),
    ("released under the mit license", "mit"),
    ("licensed under the mit license", "mit"),
    ("permission is hereby granted free of charge to any person obtaining a copy", "mit"),
    ("redistribution and use in source and binary forms", "bsd"),
    ("mozilla public license", "mpl"),
    ("eclipse public license", "epl"),
    ("boost software license", "boost"),
    ("creative commons attribution", "cc-by"),
    ("creative commons zero", "cc0"),
    ("this is free and unencumbered software released into the public domain", "unlicense"),
    ("permission to use copy modify and or distribute this software for any purpose", "isc"),
    ("all rights reserved", "proprietary"),
)
CHARS_PER_EDIT = 10
# Word characters of the contract: digits, letters lower-cased, and every byte beyond ASCII.
WORDS = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
FINDING = "struct<label:string,first_char:long,last_char:long,first_word:long,last_word:long,edits:int,exact:boolean,size:int>"
SCHEMA = f"doc_id long, n_words long, findings array<{FINDING}>"


def pieces(notice: str, edits: int) -> list[tuple[int, str]]:
    """``notice`` cut into edits + 1 pieces of about equal length, each with its offset."""
    cuts = [len(notice) * i // (edits + 1) for i in range(edits + 2)]
    return [(a, notice[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]


class Scanner:
    def __init__(self, phrases=PHRASES, notices=NOTICES, chars_per_edit: int = CHARS_PER_EDIT):
        import ahocorasick
        import regex

        self.searched = []
        seeds = defaultdict(list)
        for exact, listed in ((True, phrases), (False, notices)):
            for words, label in listed:
                edits = 0 if exact else len(words) // chars_per_edit
                bounded = f"(?:{regex.escape(words)}){{e<={edits}}}" if edits else regex.escape(words)
                pattern = regex.compile(rf"(?b)(?<![^ ]){bounded}(?![^ ])")
                for offset, piece in pieces(words, edits):
                    seeds[piece].append((len(self.searched), offset))
                self.searched.append((words, label, edits, exact, pattern))
        self.automaton = ahocorasick.Automaton()
        for piece, uses in seeds.items():
            self.automaton.add_word(piece, (len(piece), uses))
        self.automaton.make_automaton()

    def places(self, text: str) -> list[tuple]:
        """(start, end, edits, index of the notice) of every verified place, in order."""
        windows = defaultdict(list)
        for end, (length, uses) in self.automaton.iter(text):
            for index, offset in uses:
                edits, words = self.searched[index][2], self.searched[index][0]
                start = end + 1 - length - offset
                windows[index].append((max(0, start - edits), min(len(text), start + len(words) + edits)))
        found = []
        for index, spans in windows.items():
            edits, pattern, words = self.searched[index][2], self.searched[index][4], self.searched[index][0]
            if not edits:
                found += [(a, b, 0, index) for a, b in spans if text[a:b] == words and self._whole(text, a, b)]
                continue
            merged = []
            for a, b in sorted(spans):
                if merged and a <= merged[-1][1]:
                    merged[-1][1] = max(b, merged[-1][1])
                else:
                    merged.append([a, b])
            for a, b in merged:
                # the best place first, then what lies before and behind it
                parts = [(a, b)]
                while parts:
                    a, b = parts.pop()
                    if a < b and (m := pattern.search(text, a, b)):
                        first, last = m.span()
                        if self._whole(text, first, last):
                            found.append((first, last, sum(m.fuzzy_counts), index))
                        parts += [(a, first - 1), (max(last, first + 1), b)]
        return sorted(set(found))

    @staticmethod
    def _whole(text: str, a: int, b: int) -> bool:
        """Whether the span starts and ends with whole words."""
        return b > a and (a == 0 or text[a - 1] == " ") and (b == len(text) or text[b] == " ")

    def scan(self, text: str) -> tuple[int, list[dict]]:
        words = text.encode().translate(WORDS).split()
        joined = b" ".join(words).decode()
        found, at, word = [], 0, 0
        for start, end, edits, index in self.places(joined):
            word, at = word + joined.count(" ", at, start), start
            notice, label, _, exact, _ = self.searched[index]
            found.append({
                "label": label, "first_char": start, "last_char": end, "first_word": word, "last_word": word + joined.count(" ", start, end),
                "edits": edits, "exact": exact, "size": len(notice),
            })
        return len(words), found


def scan_documents(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``n_words`` and all findings with spans in the joined words, and edits."""

    def run(batches):
        scanner = Scanner()
        for batch in batches:
            counts, findings = [], []
            for text in batch.column(1).to_pylist():
                n, found = scanner.scan(text or "")
                counts.append(n)
                findings.append(found)
            kind = pa.list_(pa.struct([
                ("label", pa.string()), ("first_char", pa.int64()), ("last_char", pa.int64()), ("first_word", pa.int64()),
                ("last_word", pa.int64()), ("edits", pa.int32()), ("exact", pa.bool_()), ("size", pa.int32()),
            ]))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).cast(pa.int64()), pa.array(counts, pa.int64()), pa.array(findings, kind)], names=["doc_id", "n_words", "findings"]
            )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, SCHEMA)


def license_report(docs: DataFrame) -> DataFrame:
    """Per document the exact places, the labels of exact and of all findings, and a score.

    The score is the best finding's share of unchanged characters, 0 without findings.
    """
    exact = F.filter("findings", lambda f: f["exact"])

    def joined(findings):
        return F.concat_ws(",", F.array_sort(F.array_distinct(F.transform(findings, lambda f: f["label"]))))

    starts = F.transform(exact, lambda f: f["first_word"])
    score = F.array_max(F.transform("findings", lambda f: F.lit(1.0) - f["edits"] / f["size"].cast("double")))
    return scan_documents(docs).select(
        "doc_id",
        "n_words",
        F.size(exact).cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"),
        joined(exact).alias("base_labels"),
        joined(F.col("findings")).alias("labels"),
        F.greatest(F.lit(0.0), F.coalesce(score, F.lit(0.0))).alias("score"),
        "findings",
    )
