"""Token counts by a map-side two-tier table of pre-token lengths.

The vocabulary joins a space to what follows it and has no piece with a
space after another character, so a merge never crosses the place before a
run of spaces: the text, cut there, gives the same tokens.

Tier one: the lengths of the most frequent pre-tokens of the whole corpus,
broadcast (at most ``hot_size`` entries of at most ``LONGEST`` characters, so
a few MB whatever the corpus). Each task sums up its own pre-tokens in a
bounded table and only its ``per_task`` most frequent leave it; no pre-token
is shuffled by occurrence. Tier two: what the table lacks is encoded by the
worker and kept in its cache, which is emptied when it is full. Both tiers
change speed only, never a count.

Nulls count as empty texts, with 0 tokens. Repeated rows are counted each.
Rows with a null key keep it. Other columns are neither read nor returned.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, table, text_bytes, tokenizer_path, worker_state

LONGEST = 64
MODEL = "piece_bpe_32k.model"


def pre_tokens(text: str) -> list[str]:
    """Pre-tokens without their first space; together they are the text."""
    if not text:
        return []
    if "  " in text or "▁" in text or text[0] == " " or text[-1] == " ":
        return [x[1:] for x in re.findall("[ ▁]+[^ ▁]*", " " + text)]
    return text.split(" ")


class Lengths(dict):
    """Pre-token -> number of tokens; encodes what it lacks."""

    most = 400_000

    def __init__(self, path: str, hot: dict):
        import sentencepiece

        super().__init__(hot)
        self.hot, self.sp = hot, sentencepiece.SentencePieceProcessor(model_file=path)

    def __missing__(self, word):
        n = len(self.sp.encode(word)) if word else 1  # a lone space is one piece
        if len(word) <= LONGEST:
            self[word] = n
        return n

    def count(self, text: str) -> int:
        if len(self) > self.most:
            self.clear()
            self.update(self.hot)
        return sum(map(self.__getitem__, pre_tokens(text)))


def frequent(docs: DataFrame, text: str, hot_size: int, per_task: int) -> DataFrame:
    """The pre-tokens that head the tasks' own tables: (word, n)."""
    from collections import Counter

    def add(state, cols):
        for t in cols["t"]:
            state.update(pre_tokens(t or ""))
        if len(state) > 300_000:  # those seen least go; only speed hangs on them
            for w, n in state.most_common()[100_000:]:
                del state[w]

    def heads(state):
        best = [(w, n) for w, n in state.most_common(per_task) if len(w) <= LONGEST and n > 1]
        return {"word": [w for w, _ in best], "n": [n for _, n in best]}

    found = arrow_map(docs.select(F.col(text).alias("t")), add, "word string, n long", setup=Counter, finish=heads)
    return found.groupBy("word").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "word").limit(hot_size)


def token_counts(docs: DataFrame, model: str, key: str = "doc_id", text: str = "text", limit: int = 4096, hot_size: int = 32_768, per_task: int = 2_048) -> DataFrame:
    """(key, n_bytes, n_tokens, over_limit) of every row."""
    import sentencepiece

    words = [r.word for r in frequent(docs, text, hot_size, per_task).collect()]
    sp = sentencepiece.SentencePieceProcessor(model_file=model)
    hot = {w: (len(ids) if w else 1) for w, ids in zip(words, sp.encode(words))} if words else {}
    shared = docs.sparkSession.sparkContext.broadcast(hot)

    def ready():
        return worker_state().setdefault(("lengths", model, len(shared.value)), None) or _new()

    def _new():
        worker_state()[("lengths", model, len(shared.value))] = got = Lengths(model, shared.value)
        return got

    def fn(lengths, cols):
        n = [lengths.count(t or "") for t in cols["_t"]]
        return {key: cols[key], "n_bytes": [len(text_bytes(t)) for t in cols["_t"]], "n_tokens": n, "over_limit": [x > limit for x in n]}

    kind = dict(docs.dtypes)[key]
    return arrow_map(docs.select(key, F.col(text).alias("_t")), fn, f"`{key}` {kind}, n_bytes long, n_tokens long, over_limit boolean", setup=ready)


def op10_token_counts(spark, sf_dir):
    return token_counts(table(spark, sf_dir, "documents"), tokenizer_path(MODEL))
