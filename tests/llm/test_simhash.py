import hashlib
import math

import xxhash
from pyspark.sql import functions as F

from kashf.llm import simhash as S

from .cases import documents, got, prose, rows, table


def brute_fingerprint(t):
    words = [w for w in t.lower().translate({c: " " for c in (9, 10, 11, 12, 13)}).split(" ") if w]
    if not words:
        return [0] * S.HALVES
    terms = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    out = []
    for half in range(S.HALVES):
        votes = [0] * (3 * S.FIELD)
        for term in terms:
            first = xxhash.xxh64_intdigest(term.encode(), seed=42)
            h = xxhash.xxh64_intdigest(half.to_bytes(4, "little"), seed=first)
            weight = 1 + (len(term) >= 9) + (len(term) >= 17)
            for b in range(3 * S.FIELD):
                votes[b] += weight if h >> b & 1 else -weight
        out.append(sum(1 << b for b in range(3 * S.FIELD) if votes[b] > 0))
    return out


def brute(data):
    docs = sorted({(r[0], r[1] or "") for r in data if r[0] is not None})
    out, d = [], lambda a, b: sum(bin(x ^ y).count("1") for x, y in zip(a, b))
    like = lambda a, b: round(max(0.0, math.cos(math.pi * d(a, b) / S.BITS)), 9)
    for at, (i, t) in enumerate(docs):
        after = docs[(at + 1) % len(docs)][1]
        half = len(t) // 2
        edited = t[: len(t) - half] + after[:half]
        f, e, n = (brute_fingerprint(x) for x in (t, edited, after))
        text = lambda fp: "".join(f"{x:016x}" for x in fp)
        out.append((i, len(t), hashlib.sha256(edited.encode()).hexdigest(), text(f), text(e), like(f, e), like(f, n)))
    return table(out)


def found(df):
    return got(df.withColumn("near_edited", F.round("near_edited", 9)).withColumn("near_next", F.round("near_next", 9)), "doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next")


def test_equals_brute_force(spark):
    data = [r for r in rows() if "ſ" not in (r[1] or "")]  # letters that lower-case differently in Java and Python
    assert found(S.edited_fingerprints(documents(spark, data))) == brute(data)


def test_a_lone_document_follows_itself(spark):
    data = [(5, "alpha beta gamma delta", None, None, 0)]
    assert found(S.edited_fingerprints(documents(spark, data))) == brute(data)


def test_empty_table(spark):
    assert S.edited_fingerprints(documents(spark, [])).count() == 0


def test_plan_is_native(spark):
    plan = S.edited_fingerprints(documents(spark))._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow", "CartesianProduct"))


def test_counters_of_long_texts_do_not_overflow(spark, monkeypatch):
    text = prose(9, 3000)
    texts = documents(spark, [(1, text, None, None, 0)])
    assert list(S.fingerprints(texts, ["doc_id"]).first().fingerprint) == brute_fingerprint(text)


def test_block_tables_find_every_pair_in_the_radius(spark):
    base = prose(30, 200).split()
    data = [(i, " ".join([*base[: 180 - i], *(f"x{i}y{j}" for j in range(i)), *base[180:]]), None, None, 0) for i in range(0, 40, 2)]
    data += [(100, data[0][1], None, None, 0), (101, prose(31, 200), None, None, 0)]
    fps = S.fingerprints(documents(spark, data), ["doc_id"])
    pairs, members = S.near_fingerprints(fps, 12)
    of = {r.doc_id: r["class"] for r in members.collect()}
    brute_ = {i: brute_fingerprint(t) for i, t, *_ in data}
    d = lambda a, b: sum(bin(x ^ y).count("1") for x, y in zip(a, b))
    classes = {of[i]: fp for i, fp in brute_.items()}
    want = {(a, b, d(x, y)) for a, x in classes.items() for b, y in classes.items() if a < b and d(x, y) <= 12}
    assert {(r.a, r.b, r.distance) for r in pairs.collect()} == want and len(want) > 3
    assert of[0] == of[100] and len(of) == len(data)


def test_query_returns_every_row(spark, tmp_path):
    data = [r for r in rows() if "ſ" not in (r[1] or "") and len(r[1] or "") < 20_000]
    data += [data[0], (5000, "said twice over", None, None, 0), (5000, "said twice over", None, None, 0), (None, "no id here", None, None, 0), (None, "no id here", None, None, 0)]
    documents(spark, data).write.parquet(str(tmp_path / "documents.parquet"))
    out = S.op3_simhash(spark, str(tmp_path))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow", "CartesianProduct"))
    texts = [(r[0], r[1] or "") for r in data]
    of = {(i, "".join(f"{x:016x}" for x in brute_fingerprint(t)), len(t)): texts.count((i, t)) for i, t in set(texts) if i is not None}
    want = [r for r in brute(data) for _ in range(of[r[0], r[3], r[1]])]
    want += [(None, len(t), None, "".join(f"{x:016x}" for x in brute_fingerprint(t)), None, None, None) for i, t in texts if i is None]
    assert found(out) == table(want) and len(want) == len(data)
