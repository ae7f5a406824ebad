"""BPE encoding and decoding through a table of distinct words.

A word is a run of white space with the run of other characters after it.
Neither the pre-tokenizer's patterns nor the added tokens reach over the
end of such a run, so words encode alone as they do inside the text; their
bytes, too, decode alone.

Documents are dealt over blocks by a hash, compressed before they are
shuffled. Each block sends its distinct words, in the order in which its documents (sorted) first hold them, in one packet for each
bucket of a hash of the word. A bucket encodes each of its distinct words
once and answers every packet with ids in the packet's order, so they join
their words by position and no word travels back. A block, which knows its words, decodes each through the
id-to-piece table (as many rows as the vocabulary, so its broadcast is bounded) and puts its texts together. Words that
all decode to themselves make a text that decodes to itself. A block holds about ``block_docs``
documents and a bucket a share of the words of all blocks, both of which shrink with more
partitions; a frequent word comes once from a block.

Nulls are empty texts. Repeated rows are encoded each. A null key stays.
"""

from __future__ import annotations

import hashlib
import os
import re
from itertools import chain
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_type

from .blocks import answered, answers_of, asked, deal, partitions, rows_of
from .common import table, tokenizer_path, worker_state

MODEL = "byte_bpe_50k.json"
WHITE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
WORD = re.compile(f"[{WHITE}]*[^{WHITE}]+|[{WHITE}]+")
OTHER = WHITE.replace(" ", "", 1)  # white space but for the space itself
MIXED = re.compile(f"^[{WHITE}]|[{WHITE}][{WHITE}]|[{WHITE}]$")
BREAK = re.compile(f"[{OTHER}]")
PARTS = re.compile(f" |(?=[{OTHER}])")


def split_words(text: str) -> list[str]:
    return WORD.findall(text)


def key_of(word: str) -> str:
    """A word by another name: a single space before it, which most words have, is left out, and comes to those that have no white space."""
    if WORD.fullmatch(word[1:]) and word[0] == " " and not MIXED.match(word[1:]):
        return word[1:]
    return word if MIXED.match(word) else " " + word


def word_of(key: str) -> str:
    if not MIXED.match(key):
        return " " + key
    return key[1:] if key[0] == " " and len(key) > 1 and not MIXED.match(key[1:]) else key


def split_keys(text: str) -> list[str]:
    """The keys of the text's words; the space between two words is what parts them where nothing else does."""
    if not text:
        return []
    if MIXED.search(text):
        return [key_of(w) for w in split_words(text)]
    keys = PARTS.split(text) if BREAK.search(text) else text.split(" ")
    keys[0] = " " + keys[0]
    return keys


def byte_of_char() -> dict[str, int]:
    """The byte-level alphabet: printable bytes stand for themselves, the others follow from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def id_to_piece(model: str) -> dict[int, bytes]:
    """As many entries as the vocabulary."""
    from tokenizers import Tokenizer

    chars = byte_of_char()
    return {i: bytes(chars[c] for c in piece) if all(c in chars for c in piece) else piece.encode() for piece, i in Tokenizer.from_file(model).get_vocab(with_added_tokens=True).items()}


def _tokenizer(model: str):
    from tokenizers import Tokenizer

    state = worker_state()
    if ("tokenizer", model) not in state:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        t = Tokenizer.from_file(model)
        t.no_truncation()
        t.no_padding()
        state[("tokenizer", model)] = t
    return state[("tokenizer", model)]


def keys_by_bucket(split: list[list[str]], buckets: int) -> dict[int, list[str]]:
    """The distinct keys of texts, as they come, by bucket: the same wherever it is worked out."""
    found: dict[int, list[str]] = {}
    for w in dict.fromkeys(chain.from_iterable(split)):
        found.setdefault(crc32(w.encode("utf-8", "surrogatepass")) % buckets, []).append(w)
    return found


def encode_and_decode(docs: DataFrame, model: str, key: str = "doc_id", text: str = "text", block_docs: int = 4096) -> DataFrame:
    """(key, n_tokens, ids_sha256, decoded_sha256) of every row."""
    dealt, blocks = deal(docs, block_docs, False, key, text)
    pieces = docs.sparkSession.sparkContext.broadcast(id_to_piece(model))
    kind = dict(docs.dtypes)[key]
    key_type = to_arrow_type(docs.schema[key].dataType)

    def ask(group):
        return keys_by_bucket([split_keys(t) for _, t in rows_of(group, True)], blocks)

    def encode(packets):
        distinct = list(set().union(*packets))
        ids: dict = {}
        for p in range(0, len(distinct), 4096):
            part = distinct[p : p + 4096]
            ids.update(zip(part, (np.array(e.ids, np.uint32) for e in _tokenizer(model).encode_batch_fast([word_of(w) for w in part], add_special_tokens=False))))
        answers = []
        for ws in packets:
            got = [ids[w] for w in ws]
            answers.append((np.array([len(x) for x in got], np.uint32), np.concatenate(got)))
        return answers

    def put(left, right):
        rows = rows_of(left, True)
        split = [split_keys(t) for _, t in rows]
        piece, name, ids, odd = pieces.value, {}, {}, {}
        words = keys_by_bucket(split, blocks)
        for bucket, (n, flat) in answers_of(right).items():
            flat, at = flat.tolist(), 0
            name.update((i, str(i)) for i in set(flat).difference(name))
            for w, k in zip(words[bucket], n.tolist()):
                own = flat[at : at + k]
                at += k
                ids[w] = ",".join([name[i] for i in own])
                back = b"".join([piece[i] for i in own])
                if back != word_of(w).encode("utf-8", "surrogatepass"):
                    odd[w] = back
        count, enc, dec = [], [], []
        for (_, t), ws in zip(rows, split):
            joined = ",".join(map(ids.__getitem__, ws))
            count.append(joined.count(",") + 1 if joined else 0)
            enc.append(hashlib.sha256(joined.encode()).hexdigest())
            if odd and not odd.keys().isdisjoint(ws):
                t = b"".join(odd[w] if w in odd else word_of(w).encode("utf-8", "surrogatepass") for w in ws).decode("utf-8", "replace")
            dec.append(hashlib.sha256(t.encode()).hexdigest())
        return pa.table({key: pa.array([k for k, _ in rows], key_type), "n_tokens": pa.array(count, pa.int64()), "ids_sha256": pa.array(enc, pa.string()), "decoded_sha256": pa.array(dec, pa.string())})

    replies = answered(asked(dealt, [], ask, partitions(docs)), encode)
    return dealt.groupBy("_b").cogroup(replies.groupBy("_b")).applyInArrow(put, f"`{key}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op8_bpe_encode_decode(spark, sf_dir):
    return encode_and_decode(table(spark, sf_dir, "documents"), tokenizer_path(MODEL))
