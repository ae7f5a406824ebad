import hashlib

from kashf.llm import chunk_dedup as C

from .cases import documents, got, prose, rows, table


def brute_chunks(b, gear):
    ends, h, start = [], 0, 0
    for i, x in enumerate(b):
        h = (2 * h + gear[x]) % 2**64
        if h >> (64 - C.MASK_BITS) == 0 or i + 1 == len(b):
            at = start + C.LONGEST
            while at < i + 1:
                ends.append(at)
                at += C.LONGEST
            ends.append(i + 1)
            start = i + 1
    return ends


def brute(data):
    gear = [int(x) for x in C.gear_table()]
    seen, out = set(), []
    for i, t in sorted(((r[0], r[1] or "") for r in data), key=lambda x: (x[0] is not None, x[0] or 0, x[1])):
        b, start, flags = t.encode(), 0, []
        for e in brute_chunks(b, gear):
            c = b[start:e]
            flags.append((start, e, c in seen))
            seen.add(c)
            start = e
        runs = []
        for s, e, r in flags:
            if r and runs and runs[-1][1] == s:
                runs[-1][1] = e
            elif r:
                runs.append([s, e])
        runs = [x for x in runs if x[1] - x[0] >= C.LEAST]
        kept = bytes(x for k, x in enumerate(b) if not any(s <= k < e for s, e in runs)) if runs else b
        out.append((i, len(b), len(flags), sum(r for *_, r in flags), len(b) - len(kept), len(runs), hashlib.sha256(kept).hexdigest()))
    return table(out)


COLUMNS = ("doc_id", "n_bytes", "n_chunks", "n_repeats", "n_removed", "n_spans", "kept_sha256")


def test_equals_brute_force(spark):
    data = [r for r in rows() if len(r[1] or "") < 20_000]
    data += [(999, prose(2, 2_000), None, None, 0), (1000, "shift " + prose(2, 2_000)[3000:9000] + " end", None, None, 0)]
    assert got(C.chunk_dedup(documents(spark, data), block_docs=3), *COLUMNS) == brute(data)


def test_insertions_shift_nothing(spark):
    passage = prose(7, 120)
    data = [(1, passage, None, None, 0), (2, f"something else before it, {passage} and after", None, None, 0), (3, prose(8, 120), None, None, 0)]
    out = {r.doc_id: r for r in C.chunk_dedup(documents(spark, data), with_text=True).collect()}
    assert out[1].n_removed == 0 and out[3].n_removed == 0
    assert out[2].n_removed > 0.7 * len(passage) and out[2].kept_text.startswith("something else before it")


def test_empty_table(spark):
    assert C.chunk_dedup(documents(spark, [])).count() == 0


def brute_matches(data):
    """{doc_id: bytes removed} under the whole rule, chunk by chunk against every earlier copy; doc_ids are not shared."""
    gear = [int(x) for x in C.gear_table()]
    places, out = {}, {}
    for i, t in sorted((r[0], r[1] or "") for r in data):
        b = t.encode()
        ends = brute_chunks(b, gear)
        cs = list(zip([0, *ends], ends))
        matches, n = [], 0
        for s, e in cs:
            best = 0
            for ob, os_, oe in places.get(b[s:e], []):
                x = y = 0
                while x < min(s, os_) and b[s - x - 1] == ob[os_ - x - 1]:
                    x += 1
                while y < min(len(b) - e, len(ob) - oe) and b[e + y] == ob[oe + y]:
                    y += 1
                best = max(best, x + e - s + y)
            matches.append(best)
            places.setdefault(b[s:e], []).append((b, s, e))
        at = 0
        while at < len(cs):
            to = at
            while to < len(cs) and matches[to]:
                to += 1
            run = cs[to - 1][1] - cs[at][0] if to > at else 0
            n += sum(e - s for (s, e), m in zip(cs[at:to], matches[at:to]) if run >= C.LEAST or m >= C.LEAST or to - at == len(cs))
            at = to + 1
        out[i] = n
    return out


def short_passages():
    data = []
    for i in range(60):  # a shared passage, of 90 to 326 bytes, in two contexts
        passage = prose(1000 + i, 60)[: 90 + 4 * i]
        data += [(2 * i, f"{prose(2000 + i, 30)} {passage} {prose(3000 + i, 30)}", None, None, 0), (2 * i + 1, f"{prose(4000 + i, 25)} {passage} {prose(5000 + i, 35)}", None, None, 0)]
    return data


def test_matches_are_judged_with_the_bytes_around_their_chunks(spark):
    data = short_passages()
    want = brute_matches(data)
    for block_docs in (7, 4096):
        out = C.chunk_dedup(documents(spark, data), block_docs=block_docs, around=True).collect()
        assert {r.doc_id: r.n_removed for r in out} == want
    under = sum(0 < n < C.LEAST for n in want.values())
    assert under > 5 and all(want[2 * i] == 0 for i in range(60))


def test_copies_of_short_texts_go_whole(spark):
    data = [(1, "a short text", None, None, 0), (2, prose(8, 60), None, None, 0), (3, "a short text", None, None, 0), (4, "another one", None, None, 0)]
    out = {r.doc_id: r for r in C.chunk_dedup(documents(spark, data), block_docs=2, with_text=True, around=True).collect()}
    assert [out[i].n_removed for i in (1, 2, 3, 4)] == [0, 0, 12, 0] and out[3].kept_text == "" and out[3].n_spans == 1


def test_query_judges_by_the_whole_rule(spark, tmp_path):
    data = [(1, "a short text", None, None, 0), (2, "a short text", None, None, 0)]
    documents(spark, data).write.parquet(str(tmp_path / "documents.parquet"))
    assert {r.doc_id: r.n_removed for r in C.op5_chunk_dedup(spark, str(tmp_path)).collect()} == {1: 0, 2: 12}


def test_what_is_asked_about_matches_is_no_more_than_the_texts(spark, monkeypatch):
    asked, real = [], C.asked
    monkeypatch.setattr(C, "asked", lambda *x: asked.append(real(*x)) or asked[-1])
    data = short_passages()
    C.chunk_dedup(documents(spark, data), around=True)
    sent = [q.selectExpr("sum(length(packet))").first()[0] for q in asked]
    assert len(sent) == 3 and 0 < sent[2] < sum(len(r[1]) for r in data)


def test_frequent_surroundings_are_asked_for_string_by_string(spark):
    # chunks of even and of odd sizes; a phrase that many texts hold between others, copies, and a text too short for any match
    data = short_passages()[:40] + [(200 + i, f"{prose(6000 + i, 12)} {prose(1, 9)} {prose(7000 + i % 5, 12)}", None, None, 0) for i in range(40)]
    data += [(300, prose(6000, 12), None, None, 0), (301, prose(1, 9)[:80], None, None, 0), (302, "ab" * 200, None, None, 0), (303, f"x{'ab' * 150}y", None, None, 0)]
    want = brute_matches(data)
    assert sum(0 < n < C.LEAST for n in want.values()) > 5
    for hot in (0, 3, C.HOT):
        out = C.chunk_dedup(documents(spark, data), block_docs=9, around=True, hot=hot).collect()
        assert {r.doc_id: r.n_removed for r in out} == want
