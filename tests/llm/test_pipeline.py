import random
import sys
import zlib
from pathlib import Path

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline as P
from evalscale.llm.op4_decontaminate import decontaminate as leaks

sys.path.insert(0, str(Path(__file__).parent))
from test_op4_decontaminate import brute_force as brute_leaks  # noqa: E402
from test_op5_jaccard import brute_force as brute_sets  # noqa: E402
from test_op10_lines import brute_force as brute_lines  # noqa: E402


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdeinorst") for _ in range(rng.randint(2, 8)))
    line = lambda n=12: " ".join(word() for _ in range(n))
    item = line(14)
    passage = [line() for _ in range(16)]
    docs = {i: [line() for _ in range(rng.randint(2, 8))] for i in range(150)}
    for i in range(0, 150, 5):
        for _ in range(3):
            docs[i][rng.randrange(len(docs[i]))] += " you worthless idiot scum"
    docs[201] = [line(60)]
    docs[202] = [docs[201][0] + " changed"]  # a near copy
    docs[203] = [line(), f"{line(5)} {item} {line(5)}"]  # a leak
    docs[204], docs[205] = [line(), *passage, line()], [line(), *passage]  # a repeated passage
    docs[206] = [line(12) for _ in range(900)]  # longer than a sequence
    base = tmp_path_factory.mktemp("sf")
    rows = [(i, "\n".join(t), "en", "src", sum(map(len, t)) + len(t) - 1, "extra") for i, t in docs.items()] + [(300, None, "en", "src", 0, "extra"), (301, "", "en", "src", 0, "extra")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, row string").write.parquet(f"{base}/documents.parquet")
    spark.createDataFrame([(i, int(i % 5 == 0), 1) for i in range(150)], "doc_id long, toxic int, quality int").write.parquet(f"{base}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{base}/benchmark.parquet")
    return str(base)


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    kept = {}
    for i, (name, stage) in enumerate(P.STAGES):
        out = stage(spark, docs, folder).cache()
        if i < 4:
            assert out.columns == docs.columns
            kept[name] = {r.doc_id: r for r in out.collect()}
            docs = out
    clean = [i for i in range(150) if i % 5]
    assert all(i in kept["toxicity"] for i in clean) and not any(i in kept["toxicity"] for i in range(0, 150, 5))
    lines = kept["line_dedup"]
    assert len(lines[205].text) < 500 < len(lines[204].text) and lines[205].n_chars == len(lines[205].text) and 300 in lines and 301 in lines
    assert 201 in kept["near_dup"] and 202 not in kept["near_dup"]
    assert 203 in kept["near_dup"] and 203 not in kept["decontaminate"]
    assert all(i in kept["decontaminate"] for i in clean) and leaks(docs, spark.read.parquet(f"{folder}/benchmark.parquet")).where("contaminated").count() == 0
    packed = out.collect()
    assert {r.doc_id for r in packed} == set(kept["decontaminate"]) and max(r.offset + r.length for r in packed) <= 2048
    assert len({r.piece for r in packed if r.doc_id == 206}) > 1


def test_run(spark, folder):
    assert [n for n, _ in P.STAGES] == ["toxicity", "line_dedup", "near_dup", "decontaminate", "pack"] and P.ORACLE_SQL is None
    assert P.run(spark, folder).count() > 100


def test_edge_cases(spark, tmp_path):
    """Nulls, repeated rows, ties, a very long text, clashing names: each stage keeps what its docstring says."""
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdeinorst") for _ in range(rng.randint(2, 8)))
    plain, alone = " ".join(word() for _ in range(40)), " ".join(word() for _ in range(40))
    long = "\n".join(" ".join(word() for _ in range(12)) for _ in range(20_000))
    rows = [(1, plain), (1, plain), (2, plain), (None, plain), (3, None), (3, None), (4, ""), (5, "   "), (6, long), (None, alone), (7, "x" * 200_000), (8, "one"), (9, "ONE")]
    schema = "doc_id long, text string, lang string, source string, n_chars long, key long, key2 long, score double, row string, hits int, gone string"
    spark.createDataFrame([(d, t, None, "s", len(t or ""), 1, None, 0.5, "r", None, "g") for d, t in rows], schema).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, None, 1)], "doc_id long, toxic int, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(None, plain), (1, None), (2, "")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in P.STAGES[:4]:
        out = stage(spark, docs, str(tmp_path)).cache()
        assert out.columns == docs.columns, name
        docs = out
    kept = sorted((r.doc_id if r.doc_id is not None else 99, r.text) for r in docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).collect())
    assert kept == [(1, plain), (3, ""), (3, ""), (4, ""), (5, "   "), (6, long), (7, "x" * 200_000), (8, "one"), (99, alone)]
    packed = P.STAGES[4][1](spark, docs, str(tmp_path)).collect()
    assert sum(r.piece == 0 for r in packed) == len(kept) and sorted(r.length for r in packed if r.doc_id in (3, 4, 5)) == [1, 1, 1, 1]


def test_empty_tables(spark, tmp_path, folder):
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{folder}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert P.run(spark, str(tmp_path)).count() == 0


def test_the_whole_run_against_brute_force(spark, tmp_path):
    """What is packed, by definitions: toxic words, repeated lines, word sets, benchmark windows, and the tokenizer itself."""
    rng = random.Random(12)
    word = lambda: "".join(rng.choice("abcdeinorst") for _ in range(rng.randint(3, 8)))
    line = lambda n=14: " ".join(word() for _ in range(n))
    item, passage = line(12), [line() for _ in range(3)]
    docs = {i: [line() for _ in range(rng.randint(2, 5))] for i in range(160)}
    toxic = {i for i in range(160) if i % 4 == 0}
    for i in toxic:
        docs[i] = [f"{x} you worthless idiot scum" for x in docs[i]]
    leaks = {i for i in range(160) if i % 4 == 1 and i % 3 == 0}
    for i in leaks:
        docs[i].append(f"{line(4)} {item} {line(4)}")
    for i in range(2, 160, 12):
        docs[i] += passage
    copies = {200 + i: docs[i] for i in range(3, 160, 8)}
    docs |= {k: [v[0], *v[1:-1], f"{v[-1]} more"] if len(v) > 2 else v for k, v in copies.items()}
    rows = [(i, "\n".join(t), "en", "s", 0) for i, t in docs.items()]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, int(i in toxic), 1) for i in range(160)], "doc_id long, toxic int, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    left = brute_lines([(i, t) for i, t, *_ in rows if i not in toxic])
    left = {i: t for i, t in left.items() if t.strip()}
    component = {i: c for i, _, c in brute_sets(sorted(left.items()))}
    left = {i: t for i, t in left.items() if component[i] == i}
    left = {i: t for i, t in left.items() if not brute_leaks([(i, t)], [(1, item)])[0][5]}
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = {}
    for i, t in left.items():
        want[i] = zlib.crc32(np.array([*tokenizer.encode(t, add_special_tokens=False).ids, 0], "<u4").tobytes())
    packed = P.run(spark, str(tmp_path)).collect()
    assert {r.doc_id: r.ids_crc32 for r in packed} == want and len(want) > 60 and all(r.piece == 0 for r in packed)
    used = {}
    for r in sorted(packed, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == used.get(r.sequence_id, 0)
        used[r.sequence_id] = r.offset + r.length
    assert max(used.values()) <= 2048 and len(used) == best_fit([r.length for r in packed])


def best_fit(lengths, capacity=2048):
    """Bins that best fit decreasing takes, document by document."""
    rooms = []
    for n in sorted(lengths, reverse=True):
        fitting = [i for i, room in enumerate(rooms) if room >= n]
        if fitting:
            rooms[min(fitting, key=lambda i: rooms[i])] -= n
        else:
            rooms.append(capacity - n)
    return len(rooms)
