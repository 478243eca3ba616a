import random
import re

from evalscale.llm import op7_license as L

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(t):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))


def base(d, t):
    w, starts, labels = words(t), [], set()
    for phrase, label in L.PHRASES.items():
        p = phrase.split()
        own = [i for i in range(len(w) - len(p) + 1) if w[i : i + len(p)] == p]
        starts += own
        labels |= {label} if own else set()
    return d, len(w), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(labels))


def run(spark, rows):
    docs = spark.createDataFrame([(d, t, "clash") for d, t in rows], "doc_id long, text string, score string")
    return {r.doc_id: r for r in L.scan_licenses(docs).collect()}


def test_base_places_against_brute_force(spark):
    rng = random.Random(0)
    pool = " ".join(L.PHRASES).split() + ["x", "The", "LICENSE,", "é"]
    rows = [(d, " ".join(rng.choice(pool) for _ in range(rng.randint(0, 120)))) for d in range(60)]
    rows += [(100, None), (101, ""), (102, "cc by"), (103, "MIT-License; mit license"), (104, "GNU General Public\nLicense")]
    got = run(spark, rows)
    assert sorted((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in got.values()) == sorted(base(d, t) for d, t in rows)
    assert all(0 <= r.score <= 1 and set(r.base_labels.split(",")) - {""} <= set(r.labels.split(",")) for r in got.values())


def test_diagonals(spark):
    notice = L.TEMPLATES[5][1]
    edited = notice.replace("free of charge", "totally free of charge").split()
    del edited[14]
    filler = " ".join(f"w{i}" for i in range(40))
    rows = [
        (1, f"{filler} {notice} {filler}"), (2, f"{filler}. {' '.join(edited)}. {filler}"), (3, f"{filler} {' '.join(notice.split()[:6])} {filler}"),
        (4, filler), (5, f"Licensed under CC BY-NC 4.0. {filler} Released under the MIT License."), (6, f"{notice} {filler} {notice}"),
    ]
    got = run(spark, [*rows, rows[0]])
    assert got[1].score == 1.0 and got[1].labels == "mit" and got[1].base_labels == ""
    assert 0.8 < got[2].score < 1 and got[2].labels == "mit"
    assert 0 < got[3].score < L.LEAST_SCORE and got[3].labels == "" and got[4].score == 0.0
    assert got[5].labels == "cc-by,cc-by-nc-4.0,mit" and got[5].base_labels == "cc-by,mit"
    assert [(s.start, s.end) for s in got[1].spans] == [(40, 40 + len(notice.split()))] and len(got[6].spans) == 2


def test_sibling_licenses(spark):
    cc = "This work is licensed under a Creative Commons Attribution"
    free = "is free software: you can redistribute it and/or modify it under the terms of the GNU {}General Public License as published by the Free Software Foundation"
    cases = {
        f"{cc} 4.0 International License": "cc-by-4.0", f"{cc}-ShareAlike 4.0 International License": "cc-by-sa-4.0", f"{cc}-NonCommercial 4.0 International License": "cc-by-nc-4.0",
        f"{cc}-NonCommercial-NoDerivatives 4.0 International License": "cc-by-nc-nd-4.0", f"{cc}-Share Alike 3.0 Unported License": "cc-by-sa-3.0", f"{cc} 2.0 Generic License": "",
        "This work is licensed under the GNU General Public License version 2": "gpl,gpl-2.0", "This work is licensed under the GNU General Public License version 3": "gpl,gpl-3.0",
        "This work is licensed under the GNU Affero General Public License version 3": "agpl-3.0", "Licensed under the Apache License, Version 1.1": "apache,apache-1.1",
        "Licensed under the Apache License, Version 2.0": "apache,apache-2.0", "Licensed under the Apache License, Version 7.1": "apache", "Licensed under CC BY-NC-SA 4.0": "cc-by,cc-by-nc-sa-4.0",
        f"This program {free.format('')}": "gpl", f"This library {free.format('Lesser ')}": "lgpl", f"This program {free.format('Affero ')}": "agpl", "This work is licensed under CC0 1.0 Universal": "cc0-1.0",
    }
    got = run(spark, [(i, f"w1 w2 {t}. w3 w4") for i, t in enumerate(cases)])
    assert {t: got[i].labels for i, t in enumerate(cases)} == cases


def test_whole_license_texts(spark):
    """Each with its own holder and line breaks, inside other text; the siblings of one text are told apart."""
    rows = [(i, f"Copyright 2020 Some One.\n{text}\nFiller behind {i} it.") for i, (_, text) in enumerate(L.LICENSES)]
    mit = dict(L.LICENSES)["mit"]
    rows += [(100, mit.replace("obtaining a copy", "who gets a copy").replace("merge, publish,", "")), (101, " ".join(mit.split()[:60])), (102, f"{mit}\n{dict(L.LICENSES)['isc']}")]
    got = run(spark, rows)
    for i, (label, text) in enumerate(L.LICENSES):
        own = set(got[i].labels.split(","))
        assert label in own and own - {label} <= {"gpl", "apache"} and got[i].score > 0.99
        assert any(s.label == label and s.end - s.start >= len(text.split()) - 5 for s in got[i].spans)
    assert got[100].labels == "mit" and 0.9 < got[100].score < 1 and got[101].labels == "mit" and {"mit", "isc"} <= set(got[102].labels.split(","))


def brute_spans(text, templates, least):
    """Labels of templates that stand word for word, by search."""
    w = words(text)
    return {label for label, t in templates if (x := t.split()) and any(w[i : i + len(x)] == x for i in range(len(w) - len(x) + 1))}


def test_labels_and_score_against_brute_force(spark):
    """Texts put together of whole notices and other words: a template that stands in full is found, one that shares no k-gram is not."""
    rng = random.Random(9)
    rows = []
    for d in range(40):
        parts = [" ".join(f"w{rng.randrange(50)}" for _ in range(rng.randint(3, 30))) for _ in range(3)]
        for _ in range(rng.randint(0, 2)):
            parts.insert(rng.randrange(len(parts) + 1), rng.choice(L.TEMPLATES)[1])
        rows.append((d, " . ".join(parts)))
    got = run(spark, rows)
    for d, t in rows:
        full, labels = brute_spans(t, L.TEMPLATES, 1), set(got[d].labels.split(",")) - {""}
        grams = {tuple(words(t)[i : i + L.K]) for i in range(len(words(t)))}
        sharing = {label for label, x in L.TEMPLATES if any(tuple(x.split()[i : i + L.K]) in grams for i in range(len(x.split()) - L.K + 1))}
        assert labels <= sharing | set(L.PHRASES.values()) and (got[d].score == 1.0) == bool(full) and bool(full) <= bool(labels)
        assert {s.label for s in got[d].spans} & full == {s.label for s in got[d].spans}


def test_inserted_words_are_charged():
    words = L.TEMPLATES[5][1].split()
    assert L.span_score(words, words) == 1 and L.span_score([*words[:5], *["x"] * 10, *words[5:]], words) < L.LEAST_SCORE


def test_no_documents(spark):
    assert run(spark, []) == {}


def test_longest_common_subsequence():
    assert L.in_order(list("abcde"), list("axcye")) == 3 and L.in_order([], list("ab")) == 0 == L.in_order(list("ab"), [])
    rng = random.Random(0)
    for _ in range(300):
        a, b = ([rng.choice("abcd") for _ in range(rng.randint(0, 80))] for _ in range(2))
        best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a, 1):
            for j, y in enumerate(b, 1):
                best[i][j] = best[i - 1][j - 1] + 1 if x == y else max(best[i - 1][j], best[i][j - 1])
        assert L.in_order(a, b) == best[-1][-1]
