import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest

from evalscale.llm.op1_pack import Encoder, Tree, pack, plan

PATH = public_tokenizers.path("word_bpe_49k.json")


def best_fit(lengths, capacity):
    room = []
    for n in sorted(lengths, reverse=True):
        open_ = [i for i, r in enumerate(room) if r >= n]
        if open_:
            room[min(open_, key=lambda i: room[i])] -= n
        else:
            room.append(capacity - n)
    return sorted(room)


@pytest.mark.parametrize("seed", range(40))
def test_plan_is_best_fit_decreasing(seed):
    rng = random.Random(seed)
    capacity = rng.choice([1, 10, 17, 64])
    lengths = [rng.randint(1, capacity) for _ in range(rng.randint(0, 150))]
    counts = {n: lengths.count(n) for n in lengths}
    bins = {}
    segments = plan(counts, capacity)
    for n, total in counts.items():
        own = [s for s in segments if s[0] == n]
        for k in range(total):
            _, at, each, first, offset = [s for s in own if s[1] <= k][-1]
            bins.setdefault(first + (k - at) // each, []).append((offset + (k - at) % each * n, n))
    for held in bins.values():
        end = 0
        for offset, n in sorted(held):
            assert offset == end
            end += n
    assert sorted(capacity - sum(n for _, n in held) for held in bins.values()) == best_fit(lengths, capacity)


def test_tree_finds_the_least_from_a_value_on():
    rng = random.Random(0)
    tree, held = Tree(50), set()
    for _ in range(500):
        i = rng.randint(0, 50)
        held ^= {i}
        tree.put(i, i in held)
        j = rng.randint(0, 50)
        assert tree.least_from(j) == min((x for x in held if x >= j), default=None)


TEXTS = ["", "  ", None, "a<|startoftext|>b <|endoftext|> I'm don't  é é  x y 12 ABC İΣ ΑΣ", "\x1c\x1d a\x85b", "Hello, World!! it's (fine).", "'s... a'b. ₂x² 漢字。", "İ. ſ, ﬁ! ¹;"]


CONTROLS = ["<|ENDOFTEXT|>", "a<|EndOfText|>b <|StartOfText|>.", "<|endoftext|><|ENDOFTEXT|> <|endoftext|>ABC", "É<|ENDOFTEXT|>É, <|ENDOFTEXT|", "<|endoftext|> <|ENDOFTEXT|>"]


@pytest.mark.parametrize("limit", [4, 1000])
def test_added_tokens_in_other_case_are_ordinary_text(limit):
    e = Encoder(PATH, limit)
    flat, bounds = e.encode(pa.array(CONTROLS))
    for i, t in enumerate(CONTROLS):
        assert flat[bounds[i] : bounds[i + 1]].tolist() == e.tokenizer.encode(t, add_special_tokens=False).ids


@pytest.mark.parametrize("limit", [4, 1000])
def test_encoder_equals_the_tokenizer(limit):
    e = Encoder(PATH, limit)
    for _ in range(2):
        flat, bounds = e.encode(pa.array(TEXTS))
        for i, t in enumerate(TEXTS):
            assert flat[bounds[i] : bounds[i + 1]].tolist() == e.tokenizer.encode(t or "", add_special_tokens=False).ids


def test_other_tokenizers_and_long_words():
    """A tokenizer that keeps case and white space encodes texts whole; what is remembered is bounded in bytes."""
    other = public_tokenizers.path("byte_bpe_50k.json")
    for path, folds in ((PATH, True), (other, False)):
        e = Encoder(path)
        assert e.folds is folds
        texts = [*TEXTS, "x" * 300_000, "Ab" * 2000 + " y", "tail  with   gaps\n\n"]
        flat, bounds = e.encode(pa.array(texts))
        for i, t in enumerate(texts):
            assert flat[bounds[i] : bounds[i + 1]].tolist() == e.tokenizer.encode(t or "", add_special_tokens=False).ids
        assert e.held < 1 << 20


def test_words_are_parted_as_their_characters_say():
    """Every letter below the bound, and some beyond, before each closing mark; against plain string methods."""
    e = Encoder(PATH)
    words = [f"{a}{chr(c)}{end}" for c in [*range(0x21, 0x400), 0x3A3, 0x4E00, 0x1F600] if not chr(c).isspace() for a in ("", "Xy", "É") for end in ("", ".", "!?")]
    words += ["...", "", "A<|ENDOFTEXT|>.", "<|endoftext|>É,"]
    rests, at, found = e._parted(pa.array(words))
    ends = dict(zip(at.tolist(), found, strict=True))
    for i, (w, rest) in enumerate(zip(words, rests, strict=True)):
        end = ends.get(i, "")
        own = w.rstrip(".,!?;:*$%&#|()\"")
        if len(own) == len(w) or not own or not own[-1].isalnum() or ord(own[-1]) >= 0x130:
            own = w
        assert end == w[len(own) :]
        low = own.lower() if max(own, default="a") < "\u0130" else own
        assert rest == (own if low.count("<|endoftext|>") != own.count("<|endoftext|>") else low)


class Watched:
    """An encoder's tokenizer, with a list of the texts that it is given."""

    def __init__(self, tokenizer):
        self.own, self.encode, self.given = tokenizer, tokenizer.encode, []

    def encode_batch_fast(self, texts, **options):
        self.given += texts
        return self.own.encode_batch_fast(texts, **options)


def watched(e):
    e.tokenizer = Watched(e.tokenizer)
    return e.tokenizer.given


def right(e, texts):
    flat, bounds = e.encode(pa.array(texts, pa.string()))
    return all(flat[a:b].tolist() == e.tokenizer.encode(t or "", add_special_tokens=False).ids for t, a, b in zip(texts, bounds[:-1], bounds[1:], strict=True))


def letters(n):
    return "".join(chr(ord("a") + int(d)) for d in str(n))


def test_words_go_to_the_tokenizer_joined():
    """A text of its own for each word costs more than its tokens do."""
    e = Encoder(PATH)
    given = watched(e)
    assert right(e, [" ".join(letters(j) + "éÉ"[j % 2] + ".,"[j % 2] for j in range(i, i + 500)) for i in range(0, 3000, 500)])
    assert e.known > 3000 and len(given) <= 3000 // 100 + 2


@pytest.mark.parametrize("odd", ["İstanbul", "a\u0300", "x9", "<|endoftext|>", "<|ENDOFTEXT|>", "don't", "漢字", "ﬁ"])
def test_joined_words_are_parted_rightly_beside_odd_ones(odd):
    e = Encoder(PATH)
    assert right(e, [None, "", " ".join([*map(letters, range(90)), odd, *map(letters, range(90, 150)), odd.upper() + "!?"])])
    assert right(e, [None, ""]) and right(Encoder(PATH), [None])


def test_full_memory_keeps_the_words_at_hand():
    e = Encoder(PATH, 150)
    given = watched(e)
    texts = [" ".join(letters(j) for j in [*range(80), *range(1000 * i, 1000 * i + 40)]) for i in range(1, 9)]
    assert all(right(e, [t]) for t in texts) and e.known <= 250
    words = " ".join(given).split()
    assert len(words) == len(set(words)) == 80 + 8 * 40


def test_packing(spark):
    rng = random.Random(3)
    texts = [" ".join(rng.choice(["alpha", "beta", "gamma", "xyzzy"]) for _ in range(rng.randint(0, 60))) for _ in range(40)] + [None, "", "word " * 200]
    rows = [(i, t, "clash") for i, t in enumerate(texts)] + [(0, texts[0], "again")]
    got = [r.asDict() for r in pack(spark.createDataFrame(rows, "doc_id long, text string, piece string"), PATH, 64).collect()]
    tokenizer = Encoder(PATH).tokenizer
    want = {}
    for i, t in enumerate(texts):
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 0]
        for piece, start in enumerate(range(0, len(ids), 64)):
            own = np.array(ids[start : start + 64], "<u4")
            want[i, piece] = (start, len(own), zlib.crc32(own.tobytes()))
    assert {(r["doc_id"], r["piece"]): (r["start"], r["length"], r["ids_crc32"]) for r in got} == want
    assert len(got) == len(want) + sum(k[0] == 0 for k in want)
    by = {}
    for r in got:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for held in by.values():
        end = 0
        for offset, n in sorted(held):
            assert offset == end
            end += n
        assert end <= 64
    assert len(by) == len(best_fit([r["length"] for r in got], 64))


def test_no_documents(spark):
    assert pack(spark.createDataFrame([], "doc_id long, text string"), PATH).count() == 0
