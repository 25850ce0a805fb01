"""Licence scan by Dice coefficient over word bigrams, in DataFrame expressions only.

Each line of a text, and the whole text, is lower-cased, stripped of everything but letters and digits, and compared with licence templates as a set of word
bigrams. A coefficient of t needs sizes within t / (2 - t) of each other, so most lines are dropped by their number of words, and templates by theirs.

Notices that are wrapped or stand in a longer line are found in windows of consecutive words over all lines. The best windows begin and end with a bigram
of their template.

Whatever reaches t, a line, a window or a whole text, shares t / (2 - t) of its template's bigrams. So a text is only read closely if it has as many of them,
and the words for that.
"""

from __future__ import annotations

from functools import reduce
from math import ceil, floor
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Licence templates (fixed values).
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("BSD-3-Clause", "Released under the BSD 3-Clause License."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related rights to this work."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("MIT", "Released under the MIT License."),
    ("MIT-notice", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    (
        "Apache-2.0-notice",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at '
        "http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "
        '"AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations '
        "under the License.",
    ),
    (
        "GPL-3.0-notice",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, "
        "either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without "
        "even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a copy of "
        "the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>.",
    ),
    (
        "ISC-text",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this "
        'permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED '
        "WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER "
        "RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR "
        "PERFORMANCE OF THIS SOFTWARE.",
    ),
    (
        "MIT-text",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software "
        "without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit "
        "persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all "
        'copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE '
        "WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR "
        "OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ),
)
THRESHOLD = 0.8


def normalised(text: Column) -> Column:
    """Lower case; everything but a-z, 0-9 and line ends becomes one space."""
    return F.regexp_replace(F.lower(text), "[^a-z0-9\\n]+", " ")


def bigrams_of(text: str) -> list[str]:
    """Distinct word bigrams of a template; a template of one word is one bigram."""
    words = "".join(c if c in "abcdefghijklmnopqrstuvwxyz0123456789" else " " for c in text.lower()).split()
    return sorted({f"{a} {b}" for a, b in zip(words, words[1:], strict=False)} or set(words))


def words_of(text: Column) -> Column:
    """The words of a text over all its lines; the first and the last may be empty."""
    return F.split(F.lower(text), "[^a-z0-9]+")


def least_words(grams: list[str], threshold: float) -> int:
    """How many words of a template stand in whatever has t / (2 - t) of its bigrams, at least: the bigrams link all its words, so each that is missing takes one of them."""
    return len({w for g in grams for w in g.split(" ")}) - (len(grams) - ceil(len(grams) * threshold / (2 - threshold) - 1e-9))


def candidate(text: Column, grams: dict[str, list[str]], threshold: float) -> Column:
    """Whether a text has enough words, and then enough bigrams, of a template; null for a null text."""
    lits = lambda values: F.array(*map(F.lit, sorted(values)))
    words = {name: {w for g in each for w in g.split(" ")} for name, each in grams.items()}
    known, pairs = lits(set().union(*words.values())), lits(set().union(*grams.values()))

    def reach(found: Column, sets: dict, least: dict) -> Column:
        return reduce(or_, (F.size(F.array_intersect(found, lits(sets[name]))) >= least[name] - 1e-9 for name in grams))

    some = {name: least_words(each, threshold) for name, each in grams.items()}
    enough = {name: len(each) * threshold / (2 - threshold) for name, each in grams.items()}
    one = lambda c, test: F.exists(F.array(c), test)

    def may(w: Column) -> Column:
        return one(F.array_intersect(w, known), lambda f: (F.size(f) >= min(some.values())) & reach(f, words, some)) & one(F.array_intersect(_bigrams(w), pairs), lambda f: reach(f, grams, enough))

    return one(words_of(text), may)


def _let(c: Column, f) -> Column:
    """f(c) with c computed once."""
    return F.get(F.transform(F.array(c), f), F.lit(0))


def _bigrams(words: Column) -> Column:
    return F.array_distinct(F.transform(F.slice(words, 1, F.greatest(F.size(words) - 1, F.lit(0))), lambda w, i: F.concat(w, F.lit(" "), F.get(words, i + 1))))


def _hits(words: Column, grams: dict[str, list[str]]) -> Column:
    """array<struct<at, gram>>: the places of all bigrams of templates."""
    known = sorted({g for each in grams.values() for g in each if " " in g})
    first, second = ({g.split(" ")[k] for g in known} for k in (0, 1))
    at = F.filter(F.sequence(F.lit(0), F.greatest(F.size(words) - 2, F.lit(0))), lambda i: F.get(words, i).isin(sorted(first)) & F.get(words, i + 1).isin(sorted(second)))
    return F.filter(F.transform(at, lambda i: F.struct(i.alias("at"), F.concat(F.get(words, i), F.lit(" "), F.get(words, i + 1)).alias("gram"))), lambda h: h["gram"].isin(known))


def _windows(lines: Column, hits: Column, best, grams: dict[str, list[str]], threshold: float) -> Column:
    """array<struct<line_no, license, dice>>: windows, the best first, none of which overlaps a better one or a line that says the same or more."""

    def span(dice: Column, license: Column, size: Column, at: Column, line: Column, whole: bool) -> Column:
        # The order of windows: the best, of equal ones the longest, of these the first by name.
        return F.struct((-dice).alias("d"), (-size).cast("int").alias("shorter"), license.alias("license"), size.cast("int").alias("size"), at.cast("int").alias("at"), line.cast("long").alias("line_no"), F.lit(whole).alias("whole"))

    def found(words: Column, line_of: Column) -> Column:
        def of(name: str) -> Column:
            n, mine = len(grams[name]), F.array(*map(F.lit, grams[name]))
            few, many = ceil(n * threshold / (2 - threshold) - 1e-9), floor(n * (2 - threshold) / threshold + 1e-9)
            places = F.transform(F.filter(hits, lambda h: h["gram"].isin(grams[name])), lambda h: h["at"])

            def ends(at: Column, later: Column) -> Column:
                last = F.filter(later, lambda e, i: (i >= few - 1) & (e < at + many))
                made = F.transform(last, lambda e: _let(_bigrams(F.slice(words, at + 1, e - at + 2)), lambda g: span(2.0 * F.size(F.array_intersect(g, mine)) / (F.size(g) + n), F.lit(name), e - at + 2, at, F.get(line_of, at), False)))
                return F.array_min(F.filter(made, lambda x: x["d"] <= -threshold))

            return F.array_compact(_let(places, lambda p: F.transform(p, lambda at, i: ends(at, F.slice(p, i + 1, many)))))

        names = [name for name in sorted(grams) if " " in grams[name][0]]
        whole = lambda words, at, line: _let(_let(_bigrams(words), best), lambda b: span(b["dice"], b["license"], F.size(words), at, line, True))
        each = F.transform(lines, lambda w, i: F.when(F.size(w) > 1, whole(w, F.array_position(line_of, i) - 1, i)))
        taken = F.filter(F.concat(F.array(whole(words, F.lit(0), F.lit(-1))), F.array_compact(each)), lambda x: x["d"] <= -threshold)

        def add(kept: Column, c: Column) -> Column:
            def bars(x: Column) -> Column:
                meets = (x["at"] < c["at"] + c["size"]) & (c["at"] < x["at"] + x["size"])
                again = (x["license"] == c["license"]) & (meets | (x["line_no"] == c["line_no"]))
                return again | (meets & (~x["whole"] | (x["d"] <= c["d"])))

            return F.when(F.exists(kept, bars), kept).otherwise(F.concat(kept, F.array(c)))

        kept = F.aggregate(F.array_sort(F.concat(*map(of, names))), taken, add)
        return F.transform(F.filter(kept, lambda x: ~x["whole"]), lambda x: F.struct(x["line_no"].alias("line_no"), x["license"].alias("license"), (-x["d"]).alias("dice")))

    line_of = F.flatten(F.transform(lines, lambda w, i: F.transform(w, lambda _: i)))
    return _let(F.flatten(lines), lambda words: _let(line_of, lambda of: found(words, of)))


def scan_licenses(docs: DataFrame, templates=TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, line_no, license, dice): the best template for each line of each text, where its coefficient reaches the threshold.

    line_no counts from 0; -1 is the whole text, for texts of several lines. Further rows are windows of consecutive words, at most (2 - threshold) / threshold bigrams
    for one of the template: line_no is where they begin. A window gives no row where it overlaps a better one (or a longer one that is as good), or a line (or whole text) that has the same licence or no
    smaller coefficient, nor a second row for a line and licence. dice is rounded to 6 places; ties go to the licence that sorts first. Bigrams are
    distinct within a line; a line of one word has none and matches nothing. A null text has no lines; repeated rows give repeated results; very long lines
    are dropped by their size, and searched in windows; an empty table gives no row; other columns are ignored.
    """
    grams = {name: found for name, text in templates if " " in "".join(found := bigrams_of(text))}
    if not grams:
        return docs.sparkSession.createDataFrame([], f"doc_id {dict(docs.dtypes)['doc_id']}, line_no long, license string, dice double")
    docs = docs.where(candidate(F.col("text"), grams, threshold))
    pairs = sorted(set().union(*grams.values()))
    least = min(map(len, grams.values())) * threshold / (2 - threshold)
    most = max(map(len, grams.values())) * (2 - threshold) / threshold
    rows = docs.select("doc_id", F.transform(F.split(normalised(F.coalesce("text", F.lit(""))), "\n"), lambda x: F.filter(F.split(x, " "), lambda w: w != "")).alias("lines"))
    def dice(name: str, mine: Column) -> Column:
        n, m = len(grams[name]), F.size(mine)
        fits = (m >= n * threshold / (2 - threshold) - 1e-9) & (m <= n * (2 - threshold) / threshold + 1e-9)
        both = F.size(F.array_intersect(mine, F.array(*map(F.lit, grams[name]))))
        return F.when(fits, F.struct((2.0 * both / (m + n)).alias("dice"), F.lit(name).alias("license")))

    def best(mine: Column) -> Column:
        """The greatest coefficient; of equal ones the first in order of name."""
        scored = F.array_compact(F.array(*(dice(name, mine) for name in sorted(grams))))
        none = F.expr("named_struct('dice', -1.0D, 'license', '')")
        # Most lines have no bigram of any template.
        return F.when(F.exists(mine, lambda g: g.isin(pairs)), F.aggregate(scored, none, lambda a, x: F.when(x["dice"] > a["dice"], x).otherwise(a))).otherwise(none)

    # Every word but the first that is new to a line makes a new bigram, so many distinct words are too many bigrams.
    numbered = F.transform("lines", lambda w, i: F.struct(i.cast("long").alias("line_no"), w.alias("words")))
    fit = F.filter(numbered, lambda u: (F.size(u["words"]) > least) & (F.size(F.array_distinct(u["words"])) <= most + 1))
    small = F.size(F.filter("lines", lambda w: F.size(w) <= least))
    rows = rows.select("doc_id", "lines", fit.alias("fit"), small.alias("small"), _let(F.flatten("lines"), lambda w: _hits(w, grams)).alias("hits"))
    none = F.expr("cast(array() as array<struct<line_no:bigint,words:array<string>>>)")
    whole = F.when((F.size("lines") > 1) & (F.size("fit") + F.col("small") == F.size("lines")), F.array(F.struct(F.lit(-1).cast("long").alias("line_no"), F.flatten("lines").alias("words")))).otherwise(none)
    seen = F.array_distinct(F.transform("hits", lambda h: h["gram"]))
    enough = lambda g: F.size(F.array_intersect(seen, F.array(*map(F.lit, g)))) >= len(g) * threshold / (2 - threshold) - 1e-9
    may = (F.size("hits") >= least - 1e-9) & reduce(or_, map(enough, grams.values()))
    windows = F.when(may, _windows(F.col("lines"), F.col("hits"), best, grams, threshold)).otherwise(F.expr("cast(array() as array<struct<line_no:bigint,license:string,dice:double>>)"))
    lines = F.transform(F.concat("fit", whole), lambda u: F.struct(u["line_no"].alias("line_no"), u["words"].alias("words"), F.lit(None).cast("string").alias("license"), F.lit(None).cast("double").alias("dice")))
    windows = F.transform(windows, lambda u: F.struct(u["line_no"].alias("line_no"), F.lit(None).cast("array<string>").alias("words"), u["license"].alias("license"), u["dice"].alias("dice")))
    split = rows.select("doc_id", F.inline(F.concat(lines, windows))).where(F.col("dice").isNotNull() | (F.size("words") >= 2))
    split = split.select("doc_id", "line_no", "license", "dice", F.when(F.col("dice").isNull(), _bigrams(F.col("words"))).alias("grams"))
    split = split.where(F.col("dice").isNotNull() | (F.size("grams") >= least - 1e-9) & (F.size("grams") <= most + 1e-9))
    found = F.when(F.col("dice").isNull(), best(F.col("grams"))).otherwise(F.struct("dice", "license"))
    return split.select("doc_id", "line_no", found.alias("b")).where(F.col("b.dice") >= threshold).select("doc_id", "line_no", F.col("b.license").alias("license"), F.round("b.dice", 6).alias("dice"))
