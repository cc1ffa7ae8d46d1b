"""Licence scan against a plain reading of its definition, and the expression parser."""

import re

from quillscan.llm import licenses as L


def brute(text):
    words = re.findall(r"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    places, found = [], set()
    for phrase, label in L.BASE.items():
        p = phrase.split()
        for i in range(len(words) - len(p) + 1):
            if words[i : i + len(p)] == p:
                places.append(i)
                found.add(label)
    return len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(found))


TEXTS = [
    None, "", "   ...", "MIT-License", "the MIT (License). mit license mit  license", "CC-BY 4.0 and cc by", "summit license", "mit licenses", "GNU\nGeneral  Public_License version 3; Apache\tLicense, Version 2.0",
    "GNU Lesser General Public License", "é mit é license É MIT LICENSE İ", "cc cc by by", "x " * 5000 + "mit license", "SPDX-License-Identifier: MIT OR Apache-2.0", "SPDX-License-Identifier: (GPL-2.0-only WITH Classpath-exception-2.0 AND MIT) trailing",
]


def test_base_columns_equal_brute_force(spark):
    rows = [(k, t, "x", 1.0) for k, t in enumerate(TEXTS)]
    got = L.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string, labels string, score double")).collect()
    for r in got:
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == brute(TEXTS[r.doc_id]), TEXTS[r.doc_id]
        assert 0 <= r.score <= 1 and (r.score > 0) == bool(r.labels) and set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(","))


def test_added_labels_and_expressions(spark):
    by = {r.doc_id: r for r in L.scan_licenses(spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")).collect()}
    assert by[8].labels == "apache,apache-2.0,gpl,gpl-3.0" and by[9].labels == "lgpl"
    assert by[13].labels == "apache-2.0,mit" and by[14].labels == "gpl-2.0-only with classpath-exception-2.0,mit"


def test_parser():
    assert L.parse("MIT or (Apache-2.0 and BSD)") == ["mit", "apache-2.0", "bsd", "and", "or"]
    assert L.parse("a or b and c") == ["a", "b", "c", "and", "or"] and L.parse("and") is None and L.parse("(a") is None
    assert L.parse("a or") == ["a"] and L.parse("a b") == ["a"]


def choices(rpn):
    """All alternatives of an expression, each a set of licences that all hold."""
    stack = []
    for t in rpn:
        if t not in ("or", "and", "with"):
            stack.append([{t}])
            continue
        right, left = stack.pop(), stack.pop()
        stack.append(left + right if t == "or" else [a | b for a in left for b in right] if t == "and" else [{f"{min(a)} with {min(b)}"} for a in left for b in right])
    return stack[0]


def test_evaluation_against_all_choices():
    for text in ("a", "a or b", "a and (b or c)", "(a or b) and (a or c)", "(a and b) or (a and c)", "a with x or a with x and b", "(a or a) and (b or (c and b))"):
        rpn = L.parse(text)
        terms, every = L.evaluate(rpn), choices(rpn)
        assert terms.offered == set().union(*every) and terms.required >= set.intersection(*every) - terms.offered | terms.required
        if text != "(a or b) and (a or c)":  # what only together is in every choice isn't told by either side
            assert terms.required == set.intersection(*every)
    many = L.evaluate(L.parse(" or ".join(f"l{k} and m{k}" for k in range(3000))))
    assert len(many.offered) == 6000 and not many.required


def test_a_tag_needs_its_hyphens_and_colon(spark):
    rows = ["SPDX License Identifier: MIT", "SPDX-License-Identifier MIT", "x SPDX-License-Identifier:\tMIT AND (ISC OR Zlib) */\nfoo", "SPDX-License-Identifier: MIT\nSPDX-License-Identifier: 0BSD"]
    got = [(r.labels, r.required, r.expressions) for r in L.scan_licenses(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")).orderBy("doc_id").collect()]
    assert got == [("", "", ""), ("", "", ""), ("isc,mit,zlib", "mit", "mit and (isc or zlib) */"), ("0bsd,mit", "0bsd,mit", "mit\n0bsd")]


def test_empty_table(spark):
    assert L.scan_licenses(spark.createDataFrame([], "doc_id long, text string")).collect() == []
