"""Small tables with what real ones hold: nulls, blanks, long texts, ties, repeats and columns whose names clash."""

from __future__ import annotations

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Extra columns named like those that the operators use inside.
CLASHING = "_b string, data string, bucket string, answer string, rep string, key string, a string, b string, count string, v string, rank string, size string, length string, _t string, _h string, _r string"
WORDS = "amber birch cedar delta ember fjord grove haven inlet jetty knoll lagoon meadow north ocean prairie quarry ridge summit tundra".split()


def prose(seed: int, n: int) -> str:
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + str(r.randrange(30)) for _ in range(n))


def rows(with_null_id: bool = True) -> list[tuple]:
    passage, long = prose(1, 60), prose(2, 30_000)
    base = prose(3, 120).split()
    near = [" ".join([*base[:k], "changed", *base[k + 1 :]]) for k in (10, 60, 100)]
    texts = [
        None, "", " \t\n", "one", "one two", "One Two", "one two three", passage, f"{prose(4, 40)} {passage} {prose(5, 40)}", f"{prose(6, 10)} {passage}",
        " ".join(base), *near, " ".join(base), long, f"x {long[5000:90000]} y", "ab" * 400, "ab" * 400, "é̂ “quoted” ſtrange ﬁ 漢字かな 　 中文 <|endoftext|> <s></s> \x00 \x1c tail", "▁ ▁▁ x  y   z ", "🙂" * 70, "A\u0085B C\r\n\r\nD",
        *[prose(100 + i, 50) for i in range(12)],
    ]
    out = [(10 * i + 3, t, ("en", "de", None)[i % 3], f"s{i % 4}", len(t or "")) for i, t in enumerate(texts)]
    out += [(7, "ties share an id", "en", "s0", 1), (7, "ties share an id too", "en", "s1", 2), out[8]]
    if with_null_id:
        out += [(None, passage, None, None, None), (None, None, None, None, None)]
    random.Random(5).shuffle(out)
    return out


def documents(spark, data=None, clashing: bool = True):
    df = spark.createDataFrame(rows() if data is None else data, SCHEMA).repartition(5)
    if clashing:
        for c in CLASHING.split(", "):
            df = df.selectExpr("*", f"'clash' AS `{c.split()[0]}`")
    return df


def got(df, *columns) -> list[tuple]:
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=lambda r: tuple((x is not None, x if x is not None else 0) for x in r))


def table(rows_) -> list[tuple]:
    return sorted(rows_, key=lambda r: tuple((x is not None, x if x is not None else 0) for x in r))
