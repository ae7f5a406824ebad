from kashf.llm import token_counts as T
from kashf.llm.common import tokenizer_path

from .cases import documents, got, prose, rows, table


def brute(data, limit=4096):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path(T.MODEL))
    n = [len(sp.encode(r[1] or "")) for r in data]
    return table((r[0], len((r[1] or "").encode()), k, k > limit) for r, k in zip(data, n))


COLUMNS = ("doc_id", "n_bytes", "n_tokens", "over_limit")
ODD = [" lead", "trail ", "  two  spaces  ", "▁", "a▁b ▁ c▁", "\t\ttabs\n\nlines\r\n", "<s> </s> <unk> <0x0A>", "\x00\x01", "a　b c", "\U0001f469‍\U0001f4bb", " ", "   ", "ffi ﬃ Å Å"]


def test_equals_the_library(spark):
    data = [*rows(), *((5000 + i, t, None, None, 0) for i, t in enumerate(ODD))]
    assert got(T.token_counts(documents(spark, data), tokenizer_path(T.MODEL)), *COLUMNS) == brute(data)


def test_small_tables_change_no_count(spark):
    data = [(i, prose(i % 9, 300), None, None, 0) for i in range(60)]
    assert got(T.token_counts(documents(spark, data), tokenizer_path(T.MODEL), limit=900, hot_size=3, per_task=2), *COLUMNS) == brute(data, 900)


def test_empty_table(spark):
    assert T.token_counts(documents(spark, []), tokenizer_path(T.MODEL)).count() == 0
