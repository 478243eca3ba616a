"""License scan by diagonal voting.

Every rolling word k-gram of a document that a template has is joined by Spark to
the template positions with the same hash; document position minus template
position is the match's diagonal.  Votes are summed by diagonal, diagonals of a
few words' distance (a word more or less) are merged, and the words of each span
so found are compared with the template's: a span's score is the number of
template words that it holds in order, of the template's and the inserted words.
A span that has other deciding words than the template (version numbers, nc, sa,
nd, lesser, affero) is of another license and scores 0.  Of overlapping spans that
score enough, the best is taken.

Base places are exact: where the words of a phrase stand one after another.

Cases: a null or empty text has no words, no places and score 0; one shorter than
k words can have base places only; ties and repeated rows change nothing; columns
beyond doc_id and text are ignored; an empty table gives no rows.

Scale: templates and phrases are parameters of a fixed size, and so is what is
broadcast.  Documents are read once and never shuffled: rows per document with
the k-grams that occur in a template (the join's own filter, applied early) are.
"""

from __future__ import annotations

import re
from bisect import bisect
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evalscale.llm.common import BROADCAST_BYTES, ROW_KEY, cut, join_measured, row_key
from evalscale.llm.licenses import LICENSES
from evalscale.llm.text import ALNUM, Lookup, Words, gram_of, gram_rows, grams, slices

K = 3
MERGE = 3
LEAST_SCORE = 0.75
NEAR = 40

#: Fixed phrases and labels.
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}

#: Fixed short notices of public licenses, in the words that a scan sees; labels are the method's own.  Whole texts follow below.
TEMPLATES = [
    ("gpl-3.0", "this work is licensed under the gnu general public license version 3"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    ("apache-2.0", "licensed under the apache license version 2 0"),
    ("apache-2.0", "you may not use this file except in compliance with the license you may obtain a copy of the license at"),
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("cc-by-nc-4.0", "licensed under cc by nc 4 0"),
    ("cc-by-4.0", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("gpl-2.0", "this work is licensed under the gnu general public license version 2"),
    ("lgpl-2.1", "this work is licensed under the gnu lesser general public license version 2 1"),
    ("lgpl-3.0", "this work is licensed under the gnu lesser general public license version 3"),
    ("agpl-3.0", "this work is licensed under the gnu affero general public license version 3"),
    ("lgpl", "is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation"),
    ("lgpl", "is free software you can redistribute it and or modify it under the terms of the gnu library general public license as published by the free software foundation"),
    ("agpl", "is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation"),
    ("apache-1.1", "licensed under the apache license version 1 1"),
    ("cc0-1.0", "to the extent possible under law the person who associated cc0 with this work has waived all copyright and related or neighboring rights to this work"),
    ("cc0-1.0", "this work is licensed under cc0 1 0 universal"),
]
_CC = {"": "", "-sa": " sharealike", "-nd": " noderivatives", "-nc": " noncommercial", "-nc-sa": " noncommercial sharealike", "-nc-nd": " noncommercial noderivatives"}
for _version, _port in (("4.0", "international"), ("3.0", "unported")):
    for _short, _long in _CC.items():
        _own = [f"this work is licensed under a creative commons attribution{_long} {_version} {_port} license", f"licensed under cc by{_short} {_version}"]
        TEMPLATES += [x for t in _own if (x := (f"cc-by{_short}-{_version}", re.sub("[-.]", " ", t))) not in TEMPLATES]

_WORD = re.compile(r"[0-9a-z\x80-\U0010ffff]+")
TEMPLATES += [(label, " ".join(_WORD.findall(text.lower()))) for label, text in LICENSES]

#: Words that tell a license from its siblings; numbers too, in templates that have any.
DECIDING = {"lesser", "library", "affero", "sharealike", "noncommercial", "noderivatives"}
#: Other ways to write them.
ALIKE = {"sa": "sharealike", "nc": "noncommercial", "nd": "noderivatives", "noderivs": "noderivatives", "v": "version"}
ALIKE_TWO = {("share", "alike"): "sharealike", ("non", "commercial"): "noncommercial", ("no", "derivatives"): "noderivatives", ("no", "derivs"): "noderivatives"}

SCANNED = (
    "key long, key2 long, doc_id long, n_words long, places array<struct<start:long,label:string>>, grams array<struct<at:long,hash:long>>, contexts array<struct<start:long,words:array<string>>>"
)
_SCANNED = pa.schema(
    [
        ("key", pa.int64()), ("key2", pa.int64()), ("doc_id", pa.int64()), ("n_words", pa.int64()), ("places", pa.list_(pa.struct([("start", pa.int64()), ("label", pa.string())]))),
        ("grams", pa.list_(pa.struct([("at", pa.int64()), ("hash", pa.int64())]))), ("contexts", pa.list_(pa.struct([("start", pa.int64()), ("words", pa.list_(pa.string()))]))),
    ]
)


def template_grams(templates: list[tuple[str, str]], k: int) -> list[tuple[int, int, int]]:
    """(hash, template, position) of all rolling k-grams."""
    out = []
    for t, (_, text) in enumerate(templates):
        words = [w.encode() for w in text.split()]
        out += [(gram_of(words[i : i + k]), t, i) for i in range(len(words) - k + 1)]
    return out


def scan(documents: DataFrame, phrases: dict[str, str], templates: list[tuple[str, str]], k: int) -> DataFrame:
    """Per document: words, base places, k-grams that templates have, and the words around them."""
    by_length: dict[int, dict[int, list[tuple[list[bytes], str]]]] = defaultdict(lambda: defaultdict(list))
    for phrase, label in phrases.items():
        words = [w.encode() for w in phrase.split()]
        by_length[len(words)][gram_of(words)].append((words, label))
    exact = {n: (Lookup(np.array(list(v), np.uint64)), dict(v)) for n, v in by_length.items()}
    wanted = Lookup(np.array([h for h, _, _ in template_grams(templates, k)], np.uint64))

    def found(words: Words, n: int, lookup: Lookup):
        hashes = grams(words.hashes, n)
        at, index = lookup.find(hashes)
        if len(at):
            good = gram_rows(words.first, words.counts, n, len(hashes))[at]
            at, index = at[good], index[good]
        rows = np.searchsorted(words.first, at, side="right") - 1
        return zip(at.tolist(), rows.tolist(), lookup.values[index].tolist(), strict=True)

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                words = Words(part.column(1), ALNUM)
                first = words.first.tolist()
                places, hits, contexts = defaultdict(list), defaultdict(list), defaultdict(list)
                for n, (lookup, own) in exact.items():
                    for at, row, h in found(words, n, lookup):
                        here = words.words(at, at + n)
                        places[row] += [{"start": at - first[row], "label": label} for phrase, label in own[h] if phrase == here]
                for at, row, h in found(words, k, wanted):
                    hits[row].append({"at": at - first[row], "hash": h - (1 << 64) if h >> 63 else h})
                for row, own in hits.items():
                    runs: list[list[int]] = []
                    for x in own:
                        if runs and x["at"] <= runs[-1][1] + NEAR:
                            runs[-1][1] = x["at"] + k
                        else:
                            runs.append([x["at"], x["at"] + k])
                    for a, b in runs:
                        contexts[row].append({"start": a, "words": [w.decode() for w in words.words(first[row] + a, first[row] + b)]})
                n = part.num_rows
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(2), part.column(3), part.column(0), pa.array(words.counts.astype(np.int64)), pa.array([places.get(i, []) for i in range(n)], _SCANNED.field(4).type),
                        pa.array([hits.get(i, []) for i in range(n)], _SCANNED.field(5).type), pa.array([contexts.get(i, []) for i in range(n)], _SCANNED.field(6).type),
                    ],
                    schema=_SCANNED,
                )

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *row_key()).mapInArrow(run, SCANNED)


def in_order(a: list[str], b: list[str]) -> int:
    """Length of the longest common subsequence of words, a bit for each word of b: cleared where one more is held."""
    at: dict[str, int] = {}
    for j, y in enumerate(b):
        at[y] = at.get(y, 0) | 1 << j
    every = (1 << len(b)) - 1
    free = every
    for x in a:
        met = free & at.get(x, 0)
        free = (free + met | free - met) & every
    return len(b) - free.bit_count()


def plain(words: list[str]) -> list[str]:
    """The words with one way of writing for those that decide."""
    out: list[str] = []
    for w in words:
        if out and (out[-1], w) in ALIKE_TWO:
            out[-1] = ALIKE_TWO[out[-1], w]
        else:
            out.append(ALIKE.get(w, w))
    return out


def deciding(words: list[str], numbers: bool) -> list[str]:
    return [w for w in words if w in DECIDING or numbers and w.isdigit()]


def span_score(own: list[str], template: list[str]) -> float:
    """Template words held in order, of the template's and the inserted words; 0 if the deciding words differ."""
    own, template = plain(own), plain(template)
    numbers = any(w.isdigit() for w in template)
    if deciding(own, numbers) != deciding(template, numbers):
        return 0.0
    both = in_order(own, template)
    return both / (len(template) + len(own) - both)


def best_spans(spans: list[dict]) -> list[dict]:
    """Of overlapping spans the one with the best score, then the longest."""
    taken: list[tuple[int, int, dict]] = []
    for s in sorted(spans, key=lambda s: (-s["score"], s["start"] - s["end"], s["start"], s["label"])):
        i = bisect(taken, s["start"], key=lambda t: t[0])
        if (i == 0 or taken[i - 1][1] <= s["start"]) and (i == len(taken) or s["end"] <= taken[i][0]):
            taken.insert(i, (s["start"], s["end"], s))
    return [s for _, _, s in taken]


def vote(scanned: DataFrame, templates: list[tuple[str, str]], k: int, apart: int) -> DataFrame:
    """Spans (row key, template, first and past-last word) of merged diagonals, with their votes."""
    spark = scanned.sparkSession
    places = [(h - (1 << 64) if h >> 63 else h, t, i) for h, t, i in template_grams(templates, k)]
    if len(places) * 32 > BROADCAST_BYTES:
        raise ValueError(f"the templates have {len(places)} {k}-grams, more than executors are sent at once; scan with fewer at a time")
    table = F.broadcast(spark.createDataFrame(places, "hash long, template int, place long"))
    hits = scanned.where(F.size("grams") > 0).dropDuplicates(ROW_KEY).select(*ROW_KEY, F.explode("grams").alias("g")).select(*ROW_KEY, "g.at", "g.hash")
    votes = hits.join(table, "hash").groupBy(*ROW_KEY, "template", (F.col("at") - F.col("place")).alias("diagonal")).agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("a"), (F.max("at") + k).alias("b"))
    order = Window.partitionBy(*ROW_KEY, "template").orderBy("diagonal")
    fresh = F.when(F.col("diagonal") - F.lag("diagonal").over(order) <= apart, 0).otherwise(1)
    grouped = votes.withColumn("fresh", fresh).withColumn("group", F.sum("fresh").over(order))
    return grouped.groupBy(*ROW_KEY, "template", "group").agg(F.sum("n").alias("votes"), F.min("a").alias("a"), F.max("b").alias("b"))


def verify(spans: DataFrame, scanned: DataFrame, templates: list[tuple[str, str]]) -> DataFrame:
    """Scores each span against its template."""
    split = [(label, text.split()) for label, text in templates]

    def run(batches):
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                label, words = split[r["template"]]
                own = [w for c in r["contexts"] for i, w in enumerate(c["words"], c["start"]) if r["a"] <= i < r["b"]]
                out.append({**{k: r[k] for k in ROW_KEY}, "label": label, "start": r["a"], "end": r["b"], "score": span_score(own, words)})
            kinds = [*[(k, pa.int64()) for k in ROW_KEY], ("label", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]
            yield pa.RecordBatch.from_pylist(out, schema=pa.schema(kinds))

    around = F.expr("filter(contexts, c -> c.start < b and c.start + size(c.words) > a)")
    near = spans.join(scanned.where(F.size("grams") > 0).dropDuplicates(ROW_KEY).select(*ROW_KEY, "contexts"), ROW_KEY).withColumn("contexts", around)
    return near.select(*ROW_KEY, "template", "a", "b", "contexts").mapInArrow(run, "key long, key2 long, label string, start long, end long, score double")


def scan_licenses(documents: DataFrame, phrases: dict[str, str] | None = None, templates: list[tuple[str, str]] | None = None, k: int = K, apart: int = MERGE, least: float = LEAST_SCORE) -> DataFrame:
    """One row per document: base places and labels, all labels, verified spans and the best score."""
    phrases, templates = PHRASES if phrases is None else phrases, TEMPLATES if templates is None else templates
    scanned = cut(scan(documents, phrases, templates, k), "licenses")
    spans = verify(vote(scanned, templates, k, apart), scanned, templates)
    span = "struct<start:long,end:long,label:string,score:double>"
    listed = F.collect_list(F.when(F.col("score") >= least, F.struct("start", "end", "label", "score")))
    per = spans.groupBy(*ROW_KEY).agg(F.max("score").alias("score"), listed.alias("spans"))

    def choose(batches):
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("label", pa.string()), ("score", pa.float64())]))
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array([best_spans(x) for x in batch.column(3).to_pylist()], kind)], names=[*ROW_KEY, "score", "spans"])

    per = cut(per.mapInArrow(choose, f"key long, key2 long, score double, spans array<{span}>").withColumn("own", F.array_distinct("spans.label")), "spans")
    starts, base = F.col("places.start"), F.array_sort(F.array_distinct(F.col("places.label")))
    joined = join_measured(scanned.drop("grams", "contexts"), per, ROW_KEY, "left", 64 + 48 * F.size("spans") + 24 * F.size("own"))
    return joined.select(
        "doc_id", "n_words", F.size("places").cast("long").alias("n_base"), F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
        F.array_join(base, ",").alias("base_labels"), F.array_join(F.array_sort(F.array_union(base, F.coalesce("own", F.array().cast("array<string>")))), ",").alias("labels"),
        F.coalesce("score", F.lit(0.0)).alias("score"), F.coalesce("spans", F.array().cast(f"array<{span}>")).alias("spans"),
    )
