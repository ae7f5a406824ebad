"""The fine intents of headings: patterns and words of each, as data.

Patterns are tried, without regard to case, on the raw title and on its heading form; words are
brought to heading form when they are used.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Fixed values: (intent, patterns, words).
FINE_INTENTS: list[tuple[str, list[str], list[str]]] = [
    ("work_hours", [r"\bساعات?\s+(?:ال)?دوام\b", r"\bايام?\s+(?:ال)?دوام\b", r"\bالدوام\s+(?:الرسمي|الرئيسي)\b"], ["دوام", "ساعات", "من", "الى", "حتى", "الأحد", "الخميس"]),
    ("ramadan_hours", [r"\bساعات?\s+العمل\s+(?:في|خلال)\s+رمضان\b", r"\bدوام\s+رمضان\b", r"\bايام\s+الصوم\b"], ["رمضان", "الصوم", "دوام", "ساعات", "من", "الى", "حتى"]),
    ("overtime", [r"\bالعمل\s+الاضافي\b", r"\bساعات?\s+اضافيه\b"], ["موافقه", "اذن", "كتابي", "خطي", "مسبق", "اجر", "تعويض"]),
    ("work_days", [r"\bايام\s+(?:ال)?عمل\b", r"\bنهايه\s+الاسبوع\b"], ["الأحد", "الخميس", "السبت", "عطل"]),
    ("breaks", [r"\bاستراح[هة]\b", r"\bفتر[هة]\s+الراحه\b"], ["مده", "دقائق", "ساعات"]),
    ("annual_leave", [r"\bاجازه\s+سنوي[هة]\b"], ["ايام", "سنه", "ترحيل", "حد", "اقصى", "زياده"]),
    ("sick_leave", [r"\bاجازه\s+مرضيه\b", r"\bتقرير\s+طبي\b"], ["ايام", "اجر", "نصف", "كامل", "تقرير"]),
    ("maternity_leave", [r"\bاجازه\s+اموم[هة]\b"], ["قبل", "بعد", "الولاده", "مده", "ايام"]),
    ("bereavement_leave", [r"\bاجازه\s+حداد\b", r"\bوفاه\b"], ["مدفوعه", "الاجر", "مده", "ايام"]),
    ("payroll_date", [r"\bصرف\s+الرواتب\b", r"\bتاريخ\s+الراتب\b"], ["الشهر", "اليوم", "الخامس"]),
    ("transport_allowance", [r"\bبدل\s+المواصلات\b", r"\bنقل\b"], ["منزل", "العمل", "يصرف", "نموذج"]),
    ("salary_advance", [r"\bسلف[هة]?\s+على\s+الراتب\b"], ["شروط", "سقف", "موافقه"]),
    ("petty_cash", [r"\bنثريات\b", r"\bمياومات\b", r"\bبدل\s+سفر\b"], ["حد", "اقصى", "تسويه", "مستندات"]),
    ("three_quotes", [r"\bثلاث[هة]?\s+عروض\s+اسعار\b"], ["سقف", "شراء", "حد", "اقصى"]),
    ("conflict_of_interest", [r"\bتضارب\s+المصالح\b"], ["مشتريات", "ابلاغ", "افصاح"]),
    ("gifts_hospitality", [r"\bالهدايا\b", r"\bالضيافه\b"], ["قبول", "ابلاغ", "حد", "سقف"]),
    ("asset_checkin", [r"\bاستلام\s+عهد[هة]\b", r"\bعهد[هة]\b"], ["نموذج", "استلام"]),
    ("asset_checkout", [r"\bتسليم\s+العهد[هة]\b", r"\bاعاده\s+العهد[هة]\b"], ["استقاله", "انتقال", "براءه", "نموذج"]),
    ("remote_work", [r"\bالعمل\s+عن\s+بعد\b", r"\bمن\s+المنزل\b"], ["سياسه", "اعتماد", "موافقه", "شروط"]),
    ("hourly_exit", [r"\bاذن\s+مغادر[هة]\s+ساعيه\b"], ["حد", "اقصى", "شهري", "ساعات", "اشعار"]),
    ("performance_review", [r"\bتقييم\s+الاداء\b"], ["سنويا", "معايير", "مؤشرات"]),
    ("discipline", [r"\bانذار\b", r"\bتدرج\s+تاديبي\b", r"\bجزاءات\b"], ["مخالفات", "عقوبات", "اجراءات"]),
    ("confidentiality", [r"\bسياس[هة]\s+(?:ال)?سري[هة]\b", r"\bحمايه\s+المعلومات\b"], ["سري", "افشاء", "وصول", "تداول"]),
    ("conduct_harassment", [r"\bالسلوك\s+المهني\b", r"\bمكافحه\s+التحرش\b"], ["سلوك", "تحرش", "بيئه", "كرامه", "شكاوى"]),
]


def fine_intents(spark: SparkSession) -> DataFrame:
    """(intent, patterns, words), one row an intent: a dimension that may be broadcast."""
    return spark.createDataFrame(FINE_INTENTS, "intent string, patterns array<string>, words array<string>")
