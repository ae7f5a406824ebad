"""Small invented inputs for queries whose operators need Arabic policy text, and their form as SQL values."""

from __future__ import annotations

CHUNKS = [
    (0, 5, "ساعات الدوام 8:00 - 15:30 لجميع العاملين.\n\nيلتزم الموظف بالحضور."),
    (1, 5, "تبدأ ساعات العمل من 8:30 إلى 15:30 كل يوم."),
    (2, 6, "مواعيد الدوام كما يلي\n\n9:00 - 16:00 في المقر"),
    (3, 7, "ساعات الدوام في شهر رمضان 9 - 3 للجميع."),
    (4, 8, "تمنح استراحة مدتها 30 دقيقة خلال الدوام اليومي."),
    (5, 9, "للأم المرضع استراحة نصف ساعة يوميا بعد العودة."),
    (6, 10, "العمل الاضافي يحتاج الى موافقة المدير المسبقة. يتم احتساب الاجر بنسبة 125 بالمئة. يعبأ نموذج كشف الساعات شهريا."),
    (7, 11, "الاجازة السنوية حق لكل موظف. مدة الإجازة السنوية 14 يوما في السنة الاولى."),
    (8, 12, "اذن مغادرة ساعية له حد معلوم كل شهر."),
    (9, 13, "يلزم ثلاثة عروض اسعار عند شراء ما يزيد عن 1000 دينار."),
    (10, 14, "بدل سفر يومي ٥٠ دينارا داخل البلاد و ۱۰۰ خارجها."),
    (11, 15, "جميع الحقوق محفوظة للمؤسسة\n\n12345 67890 11"),
    (12, -1, "صفحة بلا رقم تذكر ايام العمل من الاحد الى الخميس."),
    (13, 16, "كتـــاب مُشَكَّل uni0041 مع‌فاصل /uni0042 خفي"),
    (14, 17, "دوام من 0830-1530 او خطة العمل 2024-2025 المعتمدة"),
]
QUESTIONS = [
    (1, "ما هي ساعات الدوام الرسمي؟"), (2, "كم ساعات العمل في رمضان؟"), (3, "ما أيام الدوام؟"), (4, "كيف أطلب إذن مغادرة ساعية؟"),
    (5, "هل هناك مرونة عند الحضور؟"), (6, "كم مدة الاستراحة؟"), (7, "كيف يحسب العمل الإضافي؟"), (8, "كم مدة الإجازة السنوية؟"),
    (9, "ما سقف الشراء؟"), (10, "كم بدل سفر الموظف؟"), (11, "من يستلم العهدة؟"), (12, "هل السبت عطلة؟"),
    (13, "ما رسوم تذاكر السفر والفندق؟"), (14, "what about remote work"), (15, ""), (16, "متى تصرف الرواتب؟"),
]
#: qid -> hits (rk, pos); question 16 has none.
HITS = [(1, 1, 2), (1, 2, 0), (1, 3, 1), (2, 1, 3), (2, 2, 0), (3, 1, 12), (4, 1, 8), (4, 2, 7), (5, 1, 0), (6, 1, 0), (6, 2, 4), (6, 3, 5), (7, 1, 6), (7, 2, 4), (8, 1, 7), (9, 1, 8), (9, 2, 9), (10, 1, 10), (11, 1, 11), (12, 1, 12), (13, 1, 10), (14, 1, 13), (15, 1, 9)]
NOISY = [(1, "الأَحَدُ وإلى المدرســـةِ"), (2, "٢٠٢٤، ۱۲٫۵ uni0041 نص"), (3, "  a\tb\n c  "), (4, "/uni0042 مدينةٌ ‎هنا"), (5, ""), (6, None), (7, "ABC Éa ى آ")]
RANGE_TEXTS = [(1, "من 8:00 - 3:30"), (2, "0830-1530"), (3, "2024-2025"), (4, "1-2-3"), (5, "من 8:00 إلي 15:00"), (6, "9. حتي 4"), (7, "7:30 - 14:00 او 8.15 – 16.5 ثم 10 - 10"), (8, "لا وقت"), (9, ""), (10, "دوام 9 - 3 رمضان"), (11, "العمل 8-4")]
POSTINGS = [("section:ساعات الدوام", "policy.pdf_5_0"), ("section:ساعات الدوام", "policy.pdf_6_2"), ("section:الإجازات", "policy.pdf_11_7"), ("section:مشتريات", "9"), ("section:مشتريات", "x"), ("section:سفر", "a_b_14_10")]
ALIASES = [("ساعات الدوام", "مواعيد العمل"), ("ساعات الدوام", "الدوام"), ("الاجازات", "اجازه"), ("مشتريات", "شراء"), ("سفر", "بدل سفر"), ("سفر", "travel")]
HEADINGS = [(1, "ساعات الدوام الرسمي", 5, 6), (2, "الإجازة السنوية", 11, 12), (3, "دوام رمضان", 7, 7), (4, "شراء ثلاثة عروض أسعار", 13, -1), (5, None, -1, -1), (6, "ساعات من الى حتى", 9, 4), (7, "تعريفات", 1, 2)]
DEVSET = [(8, True, ["يوم"], ["سنوية", "14"]), (7, True, ["بالمئة", "دينار"], ["موافقة", "غياب"]), (3, False, [], ["الاحد"]), (9, True, ["شيكل"], [])]
DOCS_JSON = ['{"source_filename":"solar.txt","doc_title":"Solar","sections":[{"id":"1","level":1,"title":"Intro","path":["Intro"],"content":"Panels."},{"id":"1.1","level":2,"title":"Cost","path":["Intro","Cost"],"page_range":[3,4],"content":"Ten."}]}', '{"source_filename":"empty.txt","doc_title":"Empty","sections":[]}']
LINES = ['{"text":"a","page":"3","id":7}', '{"text":"a","page":"3","id":7},', "", '{"Text":" b "}', '{"lines":["x",2,""]}', '{"page":1}', '"bare string"', "{broken", '{"text":"c","page":"n/a"}', '{"text":5,"lines":["d"]}', '{"text":"  "}', '{"a":1} xyz', '"half "quoted""', '{"body":"e","PageNo":4}']
LOADED = [(0, 7, 3, "a"), (1, 7, 3, "a"), (2, 2, -1, "b"), (3, 3, -1, "x\n2"), (5, 5, -1, "bare string"), (6, 6, -1, "c"), (7, 7, -1, "d"), (9, 9, -1, '"half "quoted""'), (10, 10, 4, "e")]


def literal(x) -> str:
    if x is None:
        return "NULL"
    if isinstance(x, bool):
        return str(x).upper()
    if isinstance(x, list):
        return "[" + ", ".join(map(literal, x)) + "]" + ("::VARCHAR[]" if not x else "")
    if isinstance(x, str):
        return "'" + x.replace("'", "''") + "'"
    return str(x)


def values(rows, columns: str) -> str:
    """A DuckDB relation of these rows."""
    return "(SELECT * FROM (VALUES " + ", ".join("(" + ", ".join(map(literal, r)) + ")" for r in rows) + f") AS t({columns}))"
