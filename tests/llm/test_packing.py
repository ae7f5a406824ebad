import zlib
from collections import defaultdict

import numpy as np

from kashf.llm import packing as P
from kashf.llm.common import tokenizer_path

from .cases import documents, prose, rows, table


def brute_pieces(data, capacity):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_path(P.MODEL))
    t.no_truncation()
    t.no_padding()
    out = []
    for i, text, *_ in data:
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 0]
        for p, at in enumerate(range(0, len(ids), capacity)):
            part = ids[at : at + capacity]
            out.append((i, p, at, len(part), zlib.crc32(np.array(part, "<u4").tobytes())))
    return table(out)


def check(out, capacity):
    bins = defaultdict(list)
    for r in out:
        bins[r.sequence_id].append((r.offset, r.length))
    for b in bins.values():
        at = 0
        for offset, length in sorted(b):
            assert offset == at
            at += length
        assert at <= capacity
    return bins


def test_pieces_and_places(spark):
    out = P.pack(documents(spark), tokenizer_path(P.MODEL)).collect()
    assert table((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in out) == brute_pieces(rows(), 2048)
    check(out, 2048)


def test_few_sequences(spark):
    data = [(i, prose(i, 1 + i * 7919 % 150), None, None, 0) for i in range(700)]
    out = P.pack(documents(spark, data), tokenizer_path(P.MODEL)).collect()
    assert table((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in out) == brute_pieces(data, 2048)
    bins = check(out, 2048)
    assert len(bins) <= -(-sum(r.length for r in out) // 2048) + 1


def test_plans_cover_the_histogram_exactly():
    r = np.random.default_rng(4)
    for capacity in (10, 60, 300):
        for _ in range(20):
            counts = {int(l): int(r.integers(1, 40)) for l in r.choice(np.arange(1, capacity + 1), size=min(capacity, 9), replace=False)}
            for plan in (P.best_fit(counts, capacity), P.configuration_plan(counts, capacity)):
                used = defaultdict(int)
                for bins, pattern in plan:
                    assert bins > 0 and sum(l * k for l, k in pattern.items()) <= capacity
                    for l, k in pattern.items():
                        used[l] += bins * k
                assert dict(used) == counts
            total = sum(l * k for l, k in counts.items())
            assert sum(b for b, _ in P.configuration_plan(counts, capacity)) >= total / capacity


def test_pattern_of_most_worth():
    r = np.random.default_rng(5)
    for _ in range(50):
        lengths = np.sort(r.choice(np.arange(1, 12), 4, replace=False))
        worth = r.random(4)
        got = P.best_pattern(lengths, worth, 12)
        best = max((a * worth[0] + b * worth[1] + c * worth[2] + d * worth[3]) for a in range(13) for b in range(13) for c in range(13) for d in range(13) if a * lengths[0] + b * lengths[1] + c * lengths[2] + d * lengths[3] <= 12)
        assert abs(sum(k * worth[i] for i, k in got.items()) - best) < 1e-9 and sum(k * lengths[i] for i, k in got.items()) <= 12


def test_words_from_the_cache_encode_as_texts_do():
    import struct

    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_path(P.MODEL))
    t.no_truncation()
    t.no_padding()
    texts = ["Word, WORD. word; Word?! ... !!! ?x x? A.B. I'll we'll, it's. 'S 's", "İstanbul ΑΣ, ΣΑΣ. ﬁne ſo Éa E\u0301a, e\u0301. Straße! ÜBER, über", "a_b, 12, 3.5. ½! <|endoftext|>, x<|startoftext|>.", "".join(map(chr, range(33, 0x250))), "漢字。 かな, 가나. a\u200b, \u00adb.", ""]
    texts += [prose(i, 40).title() + "," for i in range(5)]
    words = P.WordIds(tokenizer_path(P.MODEL))
    for _ in range(2):
        for text, ids in zip(texts, words.ids(texts)):
            want = t.encode(text, add_special_tokens=False).ids
            assert ids == struct.pack(f"<{len(want)}I", *want), text


def test_empty_table(spark):
    assert P.pack(documents(spark, []), tokenizer_path(P.MODEL)).count() == 0


def test_letters_before_punctuation_encode_as_texts_do():
    import struct
    import unicodedata

    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_path(P.MODEL))
    t.no_truncation()
    t.no_padding()
    # letters whose lower case or composed form has several code points, and all that the fast way takes
    letters = [chr(c) for c in range(0x30000) if chr(c).isalpha() and (len(chr(c).lower()) > 1 or len(unicodedata.normalize("NFC", chr(c))) > 1)]
    letters += [*P.LETTERS, "İ", "a", "Z", "ǅ", "K", "Σ", "क"]
    assert "İ" not in P.LETTERS and len(letters) > 250
    words = P.WordIds(tokenizer_path(P.MODEL))
    for x in letters:
        text = " ".join(w + p for w in (x, "a" + x, x + "b", "STANBUL" + x) for p in ("", ".", "!", ",.", "?!", "'", "$$$", "<|", "_", "-"))
        want = t.encode(text, add_special_tokens=False).ids
        assert words.ids([text])[0] == struct.pack(f"<{len(want)}I", *want), text


def test_full_cache_and_long_words_change_nothing():
    texts = [prose(i, 60) + " " + "x" * (40 + i) + "é" * i + "!" for i in range(60)]
    small, large = P.WordIds(tokenizer_path(P.MODEL)), P.WordIds(tokenizer_path(P.MODEL))
    small.most, small.kept = 50, 20
    got = [ids for some in P.parcels(texts, 900) for ids in small.ids(some)]
    assert got == large.ids(texts) and len(small.known) <= 50
    assert not any(len(w) > P.WordIds.LONGEST + 20 for w in large.known)


def histogram(sf):
    """Lengths of the table's pieces, from its words alone: as many different lengths as real pieces have."""
    import pyarrow.parquet as pq

    counts = defaultdict(int)
    for t in pq.read_table(f"/root/testdata/{sf}/documents.parquet", columns=["text"]).column("text").to_pylist():
        n = 2 * len((t or "").split()) + 1
        counts[2048] += n // 2048
        if n % 2048:
            counts[n % 2048] += 1
    return dict(counts)


def test_the_program_places_most_pieces_and_the_plan_is_near_its_bound():
    import os

    import pytest

    if not os.path.isdir("/root/testdata/sf0.1"):
        pytest.skip("no test data")
    counts = histogram("sf0.1")
    assert len(counts) > 1000
    large = {l: n for l, n in counts.items() if l * P.SMALL > 2048}
    found, rest = P.by_patterns(large)
    assert all(sum(l * k for l, k in p.items()) <= 2048 for _, p in found)
    assert sum(rest.values()) + sum(b * sum(p.values()) for b, p in found) == sum(large.values())
    assert sum(rest.values()) < sum(large.values()) / 4
    for times in (1, 1000):
        many = {l: n * times for l, n in counts.items()}
        bound = -(-sum(l * n for l, n in many.items()) // 2048)
        plain = sum(b for b, _ in P.best_fit(many, 2048))
        assert bound <= sum(b for b, _ in P.configuration_plan(many)) <= min(1.002 * plain, 1.003 * bound + 1)


def test_the_solution_covers_every_group():
    r = np.random.default_rng(6)
    for _ in range(10):
        sizes = np.sort(r.choice(np.arange(1, 65), 12, replace=False))
        demand = r.integers(1, 500, 12).astype(float)
        taken = P.solve(sizes, demand, 64)
        cover = np.zeros(12)
        for key, x in taken.items():
            assert sum(int(sizes[i]) * k for i, k in key) <= 64
            for i, k in key:
                cover[i] += x * k
        assert (cover > 0).all() and abs((cover * sizes).sum() - (demand * sizes).sum()) < 1e-6 * (demand * sizes).sum()
        assert sum(taken.values()) >= (demand * sizes).sum() / 64 - 1e-9
