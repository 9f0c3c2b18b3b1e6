"""Tokenising against whole-text encoding, and packing against its invariants and exact optima."""

import random
import zlib
from itertools import combinations

import numpy as np
import pyarrow as pa
from loomstone.llm import op4_packing as K
from loomstone.llm import textvec as V

ODD = [
    "", None, "a<|endoftext|>b", "a<|ENDOFTEXT|>b", "Don't it's we'll 'S", "J̌ ǰ x́ ABc\u0085d e ́ ΑΣ ΟΔΟΣ İ Ǆ", "123 ４５ a1b2", "\x1c\x1d z​q ﬁ", "word,word.WORD!? (x) [y]'s it 's", "日本語 テスト", "T̈ẗ H̱ẖ", "#$%& --- ___", "naïve café CAFÉ É",
]


def whole(text):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(K.tokenizer_file()).encode(text or "", add_special_tokens=False).ids


def test_ids_are_those_of_whole_texts():
    rng = random.Random(1)
    alphabet = "abcXYZ éÉß'.,-1 2\n\t日́Σ<|>s"
    texts = ODD + ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 60))) for _ in range(400)]
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(K.tokenizer_file())
    for limit in (50, 1 << 20):
        w = K.WordIds(K.tokenizer_file())
        for b in V.blocks(pa.array(texts), limit):
            ids, at = w.encode(b)
            for i in range(b.docs):
                assert ids[at[i] : at[i + 1]].tolist() == t.encode(texts[b.first + i] or "", add_special_tokens=False).ids, texts[b.first + i]


def best(lengths, capacity):
    n, full = len(lengths), (1 << len(lengths)) - 1
    fits = {sum(1 << i for i in c) for k in range(1, n + 1) for c in combinations(range(n), k) if sum(lengths[i] for i in c) <= capacity}
    bins, todo = 0, {0}
    while full not in todo:
        bins += 1
        todo = {x | f for x in todo for f in fits if not x & f}
    return bins


def test_local_search_reaches_optima():
    rng = random.Random(2)
    lost = 0
    for _ in range(40):
        lengths = [rng.randint(15, 60) for _ in range(8)]
        of, _ = K.pack_lengths(lengths, 100)
        lost += max(of) + 1 - best(lengths, 100)
    assert lost <= 1
    lengths = [rng.randint(300, 900) for _ in range(600)]
    plain = K.best_fit(lengths, 2048)
    searched = K.drain(plain, lengths, 2048)
    assert sorted(i for b in searched for i in b) == list(range(600)) and all(sum(lengths[i] for i in b) <= 2048 for b in searched)
    assert len(searched) < len(plain)


def test_query_rows(spark):
    rng = random.Random(3)
    rows = [(i, " ".join(rng.choice(["alpha", "Beta,", "gamma's", "δ", "x1"]) for _ in range(rng.choice([0, 3, 50, 700, 3000])))) for i in range(120)] + [(500, None), (500, None), (3, "other text"), (None, "n")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, length int").repartition(3)
    got = K.pack_documents(df).collect()
    want = []
    for d, t in rows:
        ids = np.array([*whole(t), 0], "<u4")
        want += [(d, p, s, len(ids[s : s + 2048]), zlib.crc32(ids[s : s + 2048].tobytes())) for p, s in enumerate(range(0, len(ids), 2048))]
    assert sorted((tuple(r[:5]) for r in got), key=repr) == sorted(want, key=repr)
    bins = {}
    for r in got:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in bins.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= 2048
    assert len(bins) <= len(K.best_fit([x[3] for x in want], 2048))
    assert K.pack_documents(df.limit(0)).count() == 0
    again = K.pack_documents(df.repartition(5))
    assert sorted(map(str, again.collect())) == sorted(map(str, got))
