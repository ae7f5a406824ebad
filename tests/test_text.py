"""Golden rows of the text kernel, clock ranges and intents."""

from pyspark.sql import functions as F

from kashf.functions import lexicon as L
from kashf.functions import text as T
from kashf.functions import times as M


def one(spark, value, *columns):
    return spark.createDataFrame([(value,)], "t string").select(*[c.alias(f"c{i}") for i, c in enumerate(columns)]).first()


def test_normalisers(spark):
    r = one(spark, " الأَحَدُ  المدرســـةِ ٢٠٢٤، ۱۲٫۵ uni0041 /uni0042 Éa ى ", T.norm_retrieval("t"), T.norm_eval("t"), T.norm_heading("t"))
    assert r[0] == "الاحد المدرسه 2024, 12.5 / Éa ي"
    assert "المدرسة" in r[1] and "/uni0042" not in r[1] and "uni0041" in r[1]
    assert r[2].startswith("الاحد المدرســـه ٢٠٢٤،") and "éa" in r[2]
    assert list(one(spark, None, T.norm_retrieval("t"), T.norm_eval("t"), T.norm_heading("t"))) == ["", "", ""]


def test_normalisers_are_idempotent(spark):
    d = spark.createDataFrame([("أإآى ةـ ٣ ",), ("‏ab\x1c c",), ("x uni00e9 y",), ("",)], "t string")
    for f in (T.norm_retrieval, T.norm_eval, T.norm_heading):
        assert d.select(f("t").alias("a")).select("a", f("a").alias("b")).where("a != b").isEmpty()


def test_sentences(spark):
    text = "الجملة الأولى هنا. الثانية، بعدها؟ \n\nجميع الحقوق محفوظة للجميع\n\n123 456\nx"
    r = one(spark, text, T.split_sentences("t"), T.clean_sentences("t"))
    assert r[0] == ["الجملة الأولى هنا.", "الثانية،", "بعدها؟", "جميع الحقوق محفوظة للجميع", "123 456\nx"]
    assert r[1] == ["الجملة الأولى هنا.", "الثانية،", "بعدها؟"]
    assert one(spark, " 12 ", T.clean_sentences("t"))[0] == ["12"] and one(spark, "  ", T.clean_sentences("t"))[0] == []


def test_ngrams_of_short_texts(spark):
    r = one(spark, "ab", T.char_ngrams(F.col("t")), T.word_ngrams(T.words(F.col("t"))), T.word_ngrams(T.words(F.lit(""))))
    assert r[0] == ["ab"] and r[1] == ["ab"] and r[2] == []
    assert one(spark, "a😀c", T.char_ngrams(F.col("t")))[0] == ["a😀", "😀c", "a😀c"]
    assert one(spark, "One two, TWO", T.word_ngrams(T.words(F.col("t"))))[0] == ["one", "two", "two", "one two", "two two"]


def test_ranges(spark):
    def pairs(text, hours=False, compat=False):
        return [(x.a, x.b) for x in one(spark, text, M.ranges(T.norm_retrieval("t"), F.lit(hours), compat))[0]]

    assert pairs("من 8:00 - 3:30") == [(480, 930)]
    assert pairs("من 8:00 إلى 15:00") == [(480, 900)] and pairs("من 8:00 إلى 15:00", compat=True) == []
    assert pairs("0830-1530") == [] and pairs("2024-2025", True, True) == []
    assert pairs("1-2-3") == [(60, 120)] and pairs("9. حتى 4") == [(540, 960)]
    assert pairs("10 - 10") == [(600, 1320)] and pairs("10 - 10", True) == []


def test_display_and_pages(spark):
    r = one(spark, "a/uni0041b‏ 12", T.display("t"), T.display("t", "force", "arabic"), T.rtl_unwrap(T.rtl_wrap("t")))
    assert r[0] == "ab 12" and r[1] == "‫ab ١٢‬" and r[2] == "a/uni0041b‏ 12"
    assert one(spark, "x\nSources:\n1. f - page 3\n2. f - page -1\n3. f - page 12", T.pages_of(F.col("t")))[0] == [3, 12]


def test_intents(spark):
    asked = [("ما هي ساعات الدوام الرسمي؟", "work_hours"), ("كم ساعات العمل في رمضان؟", "ramadan_hours"), ("ما أيام الدوام؟", "workdays"), ("إذن مغادرة ساعية", "hourly_leave"), ("الحضور والانصراف", "flex"), ("كم الاستراحة", "break"), ("العمل الإضافي", "overtime"), ("الإجازة", "leave"), ("حدود الهدايا", "procurement"), ("بدل سفر", "per_diem"), ("", "general")]
    d = spark.createDataFrame(asked, "q string, want string").withColumn("got", L.classify("q"))
    assert d.where("got != want").collect() == []
    assert set(L.COARSE.values()) <= {label for label, _ in L.RULES} | {"gifts"}
