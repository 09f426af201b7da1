import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from countweave.llm import packing

TEXTS = ["", None, "  a  b\n\n c's\t'll  ", " x   y\x0b z\x1c q", " lead", "trail  ", "É ü x", "12 345,6 !! <|endoftext|>",
         "the of and " * 900, "x" * 9000, "one", "one"] + [f"word{i} " * (i * 7 % 300) for i in range(120)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, 1, "s") for i, t in enumerate(TEXTS)] + [(None, "one", 1, "s"), (10, "one", 1, "s")],
                                 "doc_id long, text string, piece int, task string")


def expected():
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    return {i: [*t.encode(x or "", add_special_tokens=False).ids, 2] for i, x in enumerate(TEXTS)}


@pytest.mark.parametrize("per_task", [10, 10_000])
def test_pieces_and_places(docs, per_task):
    from countweave.llm.store import keep

    rows = packing.pack(keep(packing.pieces(docs)), per_task=per_task).collect()
    ids = expected()
    own, bins = defaultdict(list), defaultdict(list)
    for r in rows:
        bins[r.sequence_id].append((r.offset, r.length))
        if r.doc_id is not None and r.doc_id != 10:
            own[r.doc_id].append(r)
    assert sorted(own) == [i for i in ids if i != 10]
    assert sum(r.doc_id == 10 for r in rows) == 2 and sum(r.doc_id is None for r in rows) == 1
    for i, parts in own.items():
        parts.sort(key=lambda r: r.piece)
        assert [r.piece for r in parts] == list(range(len(parts)))
        assert [r.start for r in parts] == np.cumsum([0] + [r.length for r in parts])[:-1].tolist()
        assert sum(r.length for r in parts) == len(ids[i])
        assert all(r.length == 1024 for r in parts[1:]) and (len(parts) > 1) == (len(ids[i]) > 1024)
        for r in parts:
            assert r.ids_crc32 == zlib.crc32(np.array(ids[i][r.start:r.start + r.length], "<u4").tobytes())
    for x in bins.values():
        end = 0
        for offset, length in sorted(x):
            assert offset == end
            end += length
        assert end <= 1024
    if per_task > 1000:
        assert len(bins) <= -(-sum(r.length for r in rows) // 1024) * 1.03 + 1


def test_best_fit_matches_a_plain_search():
    rnd = np.random.default_rng(3)
    sizes = rnd.integers(1, 60, 300).tolist()
    bins = []
    for i in sorted(range(300), key=lambda i: -sizes[i]):
        fit = [b for b in bins if sum(sizes[j] for j in b) + sizes[i] <= 60]
        if fit:
            max(fit, key=lambda b: sum(sizes[j] for j in b)).append(i)
        else:
            bins.append([i])
    assert len(packing.best_fit(sizes, 60)) == len(bins)


def test_sequences_hold_the_ids(docs, spark):
    one = docs.where("doc_id < 10 OR doc_id > 11")
    placed = packing.packed(one)
    ids = expected()
    for r in packing.sequences(one, placed).collect():
        assert len(r.ids) <= 1024
    flat = [x for r in packing.sequences(one, placed).collect() for x in r.ids]
    assert sorted(flat) == sorted(x for i, v in ids.items() if i not in (10, 11) for x in v)


def test_empty_table(spark):
    assert packing.packed(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_ids_of_mixed_white_space():
    """Texts are encoded in chunks; runs of unlike spaces, controls and letters must not show it."""
    import pyarrow as pa

    from countweave.llm import arrays

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    rnd = np.random.default_rng(3)
    bits = [" ", "  ", "\n", "\n\n", "\t", "\x0b", "\x0c", "\r", "\u00a0", "\u2003", "\u3000", "\x85", "\x1c", "\x00", "\u200b",
            "a", "be", "12", "é", "!", "--", "'s", "日本", "\U0001f600"]
    texts = ["".join(rnd.choice(bits, rnd.integers(0, 14))) for _ in range(5000)]
    encoder = packing._encoder(None)
    for block in arrays.blocks(pa.array(texts)):
        ids, bound = encoder.encode(block)
        for i, x in enumerate(texts[block.lo:block.hi]):
            assert ids[bound[i]:bound[i + 1]].tolist() == t.encode(x, add_special_tokens=False).ids, repr(x)


def test_ids_of_every_pair_and_triple_of_white_space():
    """All runs of up to three white-space characters of any script, after a letter and before one."""
    import itertools

    import pyarrow as pa

    from countweave.llm import arrays

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    white = [chr(c) for c in (*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029,
                              0x202F, 0x205F, 0x3000)]
    assert all(c.isspace() for c in white) and len(white) == 25
    texts = ["price" + "".join(w) + "10" for n in (1, 2, 3) for w in itertools.product(white, repeat=n)]
    texts += ["price \u00a0 \u00a0 10 EUR", "a\u00a0 ", "\u2003 \u2003", " \u00a0"]
    want = [e.ids for e in t.encode_batch(texts, add_special_tokens=False)]
    encoder = packing._encoder(None, True)
    got = []
    for block in arrays.blocks(pa.array(texts)):
        ids, bound = encoder.encode(block)
        got += [ids[a:b].tolist() for a, b in zip(bound[:-1], bound[1:])]
    assert got == want


def test_equal_hashes_only_for_equal_texts():
    """Words whose sums of powers are equal modulo 2^64 (Thue-Morse and its complement) have hashes of their own."""
    from countweave.llm import arrays

    x = "a"
    for _ in range(11):
        x += x.translate({97: 98, 98: 97})
    y = x.translate({97: 98, 98: 97})
    data = np.frombuffer((x + y + x).encode(), np.uint8)
    h = arrays.range_hashes(data, np.array([0, len(x), 2 * len(x)]), np.array([len(x), 2 * len(x), 3 * len(x)]))
    assert h[0] == h[2] != h[1]


def test_added_token_as_the_library_reads_it(spark, tmp_path):
    """The query's ids are those of the tokenizer as loaded: <|endoftext|> in a text is one id."""
    import pyarrow as pa

    from countweave.llm import arrays

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    assert t.encode("a <|endoftext|> b", add_special_tokens=False).ids == [64, 220, 50256, 275]
    rnd = np.random.default_rng(4)
    bits = ["<|endoftext|>", "<|endof", "text|>", "<|", " ", "  ", "\n", "a", "be", "é", "<|ENDOFTEXT|>", "'s"]
    texts = ["a <|endoftext|> b", "<|endof", "text|> x", "<|endoftext|>", "<|endoftext|>", "", None] + \
        ["".join(rnd.choice(bits, rnd.integers(0, 10))) for _ in range(2000)]
    encoder = packing._encoder(None, added=True)
    for block in arrays.blocks(pa.array(texts)):
        ids, bound = encoder.encode(block)
        for i, x in enumerate(texts[block.lo:block.hi]):
            assert ids[bound[i]:bound[i + 1]].tolist() == t.encode(x or "", add_special_tokens=False).ids, repr(x)
    spark.createDataFrame(list(enumerate(texts[:8])), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r.ids_crc32 for r in packing.op4_best_fit_packing(spark, str(tmp_path)).collect()}
    assert got == {i: zlib.crc32(np.array([*t.encode(x or "", add_special_tokens=False).ids, 2], "<u4").tobytes()) for i, x in enumerate(texts[:8])}
