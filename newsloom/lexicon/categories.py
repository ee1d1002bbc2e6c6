"""Category cascade. They decide which category a message gets
and which source, kind or title is read from it, so they are stated as they
are. Markers are in the form produced by ``norm_match`` and lower-cased."""

STATEMENT_MARKERS = (
    "بيان صادر عن المقاومة الاسلامية",
    "بيان صادر عن غرفة عمليات المقاومة",
    "بيان صادر عن غرفة العمليات",
    "بيان صادر عن حزب الله",
    "بيان صادر عن الاعلام الحربي",
    "صادر عن الاعلام الحربي في المقاومة",
)
ALERT_MARKERS = ("صفارات الانذار", "صفارات انذار", "صفاره انذار")
ALLY_MARKERS = {
    "فلسطين": (
        "حركة حماس", "كتاييب القسام", "سرايا القدس",
        "جهاد الاسلامي في فلسطين", "جبهة الشعبية",
        "#فلسطين_المحتلة", "مقاومة الفلسطينية",
        "صادر عن حركة حماس", "مكتب الاعلامي لحركة حماس",
        "مكتب الاعلامي لحركة المجاهدين الفلسطينية",
        "حركة المجاهدين الفلسطينية", "الناطق العسكري باسم كتاييب القسام",
        "ابو عبيدة",
    ),
    "اليمن": (
        "قوات المسلحة اليمنية", "انصار الله", "حركة انصار الله",
        "يحيي سريع", "عميد سريع", "عميد يحيي سريع",
        "صنعاء", "حوثي", "حوثيين", "جيش اليمني",
    ),
    "العراق": (
        "مقاومة الاسلامية في العراق", "كتاييب سيد الشهداء",
        "حركة النجباء", "اكرم الكعبي", "#العراق",
        "كتاييب حزب الله العراقي", "عصايب اهل الحق",
    ),
}
STATE_MARKERS = (
    "جمهورية الاسلامية", "حرس الثورة", "حرس الثوري",
    "جيش الايراني", "خاتم الانبياء", "#الجمهورية_الاسلامية",
    "#ايران", "وعد الصادق", "صاروخ ايراني", "صواريخ ايرانية",
    "طهران", "قاآني", "قاانی", "بزشكيان", "پزشكيان",
    "قوة الجوفضاية", "قوة البحرية الايرانية",
)
STATE_SOURCES = (
    "حرس الثورة الاسلامية", "حرس الثوري", "جيش الايراني",
    "خاتم الانبياء", "قوة البحرية", "قوة الجوفضاية",
)
STATE_DEFAULT_SOURCE = "إيران"
DIGEST_MARKERS = (
    "حصاد اليومي لعمليات المقاومة",
    "حصاد الاسبوعي لعمليات المقاومة",
    "حصاد العام للعمليات",
    "وضعية عمليات المقاومة",
    "اصدرت المقاومة الاسلامية بتاريخ",
    "اصدرت المقاومة الاسلامية خلال",
)
DIGEST_KINDS = (("weekly", "اسبوعي"), ("general", "عام"))
MEDIA_MARKERS = (
    "#اعلام_العدو", "اعلام العدو", "اعلام اسراييلي", "اعلام اسرائيلي",
    "وسايل اعلام اسراييلية", "وسايل اعلام اسرائيلية",
    "وسائل اعلام اسرائيلية", "وسائل الاعلام الاسرائيلية",
    "متحدث باسم جيش العدو", "اذاعة جيش العدو",
    "القناة 12", "القناة 14", "القناة 13", "القناة 15",
    "مراسل القناة", "هآرتس", "يديعوت احرونوت", "يسرائيل هيوم",
    "الهيئة البحرية البريطانية", "UKMTO",
)
VIDEO_MARKERS = ("بالفيديو", "#فيديو")
VIDEO_QUALITY = r"\s*جودة\s+(?:عالية|متوسطة|منخفضة|مرتفعة|عاديّة)\s*"
VIDEO_SYMBOL = "⭕️?"
ALERT_PREFIX = r"^.*?صفّ?ارات\s*(?:الإنذار|إنذار)?\s*(?:تدوي\s*)?"

STATEMENT_NUMBER = r"بيان صادر عن المقاومة الاسلامية\s*\((\d+)\)"
GENERAL_STATEMENT = "بيان صادر عن حزب الله"
GENERAL_TITLES = (
    ("بيان حول مجازر العدو بحق المدنيين", ("مجازر", "مجزرة", "المدنيين")),
    ("بيان إلى أهالي الجنوب والبقاع والضاحية", ("وقف اطلاق النار", "القري والبلدات")),
)
GENERAL_DEFAULT_TITLE = "بيان عام لحزب الله"
GENERAL_TAG = "بيان عام"
OPERATION_TIME = r"(?:عند|في|وعند|وفي|في\s+تمام)\s+الساعة\s*(\d{1,2}:\d{2})"

# Badge, tag and type keywords (tested on the raw text unless noted).
BADGES = (
    ("tank", ("ميركافا", "دبابة", "دبّابة")),
    ("settlement", ("مستوطنة", "مستوطنتي", "مستوطنتَي", "إطار التحذير", "إطار ‏التحذير")),
    ("deep", ("قاعدة", "ثكنة", "منظومة الدفاعات")),
)
TAGS = (
    ("في إطار التحذير", ("إطار التحذير", "إطار ‏التحذير")),
    ("إصابة مباشرة", ("إصابة مباشرة", "إصابة دقيقة")),
)
DEEP_TAG = ("ضربة عمق", ("قاعدة", "ثكنة", "منظومة"))
# On the normalised text:
NUMBERED_HEADER = "بيان صادر عن المقاومة الاسلامية"
STATEMENT_TYPE_MARKERS = (
    "بيان صادر عن حزب الله", "بيان عام لحزب الله", "بيان الي اهالي", "حول انتخاب", "حول استشهاد",
)
RECAP_MARKERS = ("غرفة عمليات المقاومة", "غرفة العمليات")
DEFENSIVE = r"اشتبك|تصدي|تصدت|تصدوا|كمين|تسلل|محاولة التقدم|محاولة التسلل"
LIST_TYPE = r"علي النحو الاتي|علي الشكل الاتي|علي النحو التالي|كالاتي\s*:|كالتالي\s*:"
