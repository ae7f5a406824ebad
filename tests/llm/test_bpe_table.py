import hashlib

from kashf.llm import bpe_table as B
from kashf.llm.common import tokenizer_path

from .cases import documents, got, prose, rows, table


def brute(data):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_path(B.MODEL))
    t.no_truncation()
    t.no_padding()
    out = []
    for i, text, *_ in data:
        ids = t.encode(text or "", add_special_tokens=False).ids
        back = t.decode(ids, skip_special_tokens=False)
        out.append((i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(back.encode()).hexdigest()))
    return table(out)


COLUMNS = ("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
ODD = ["it's  we'll\n\n\n x\t\t y", " <|endoftext|>mid<|endoftext|> end ", "a 　b​c\x85d\xa0e", "1234567 3.14 ½ ⅷ ١٢٣", "퟿\U0010ffff", "   ", "\n \n", "don'T CAN'T", "é́ ́", "a\x1cb\x1d c\x00d\x0b\x0ce"]


def test_equals_the_library(spark):
    data = [*rows(), *((5000 + i, t, None, None, 0) for i, t in enumerate(ODD))]
    assert got(B.encode_and_decode(documents(spark, data), tokenizer_path(B.MODEL), block_docs=4), *COLUMNS) == brute(data)


def test_round_trip(spark):
    data = [(i, prose(i, 80), None, None, 0) for i in range(40)]
    out = B.encode_and_decode(documents(spark, data), tokenizer_path(B.MODEL)).collect()
    want = {i: hashlib.sha256(t.encode()).hexdigest() for i, t, *_ in data}
    assert {r.doc_id: r.decoded_sha256 for r in out} == want


def test_empty_table(spark):
    assert B.encode_and_decode(documents(spark, []), tokenizer_path(B.MODEL)).count() == 0


def test_keys_stand_for_words():
    import random

    r = random.Random(7)
    texts = [*ODD, "", " ", "a", " a", "a ", "a b", "a  b", "a\nb c\n\nd", "\na b", "a\n b", "a b\xa0c 　d", "x\n", "\n", " \n ", "one two\nthree four"]
    texts += ["".join(r.choice("ab c  \n\t\x85é.") for _ in range(r.randrange(12))) for _ in range(4000)]
    for t in texts:
        keys = B.split_keys(t)
        assert [B.word_of(k) for k in keys] == B.split_words(t), (t, keys)
        assert [B.key_of(w) for w in B.split_words(t)] == keys, (t, keys)
