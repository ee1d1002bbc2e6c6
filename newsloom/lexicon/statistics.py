"""Bucket and keyword values of the statistics, facets and dashboards. Fixed
values: the published buckets follow from these patterns and their order."""

INSTALLATION_RULES = (
    ("بارجة_حربية", r"بارجة|سفينة حربيّ?ة|سفينة العدو"),
    ("قواعد_عسكرية", r"قاعدة\s+(?!جوّ|أرض)|قواعد عسكري"),
    ("ثكنات_عسكرية", r"ثكنة|ثكنات|معسكر(?!\s*المستوطن)"),
    ("طائرات_ومسيّرات", r"طائرة\s+(?:حربي|مسي)|مُسيّرة\s+(?:من\s+نوع|تابعة)|مروحيّ?ة|هرمز|هيرمس"),
)
SETTLEMENT_RULE = ("مدن_ومستوطنات", r"مستوطنة|مستعمرة|مدينة|حيّ\s|حي\s|حارة")
POSITION_RULE = ("مواقع_حدودية_ومستحدثة", r"موقع|تلّة|تلة|مرتفع|خلّة|خلة|وادي|ادي|حدود|مستحدث")
COUNTER_ADVANCE_TYPE = "تصدي_لعملية_تقدم"
AIRCRAFT_TYPE = "طائرات_ومسيّرات"
AIR_DEFENCE = "الدفاع_الجوي"
OTHER = "أخرى"
WEAPON_FAMILIES = (
    ("سلاح_البحرية", r"بحريّ?ة|بحر\s"),
    ("الدفاع_الجوي", r"دفاع\s+جوّ?يّ?|أرض[\s\-‑–]*جو"),
    ("سلاح_الهندسة", r"عبوة|عبوات|شواظ|هندس(?:ة|ي)|تشريك(?:ة|ات)|لغم|ألغام"),
    ("مسيّرات_ومحلقات", r"مُ?سيّرة|مسيّرات|مسيرة|مسيرات|محلّق|محلقة|كواد"),
    ("الصواريخ_الموجهة", r"موجّ?ه"),
    ("الصواريخ_النوعية", r"نوعي"),
    ("القذائف_المدفعية", r"مدفعيّ?ة|قذائف|قذيفة"),
    ("الصواريخ_المباشرة", r"مباشر"),
    ("الأسلحة_المناسبة", r"الأسلحة\s+المناسبة|أسلحة\s+مناسبة"),
    ("الخفيفة_والمتوسطة", r"خفيف|متوسط|رشّ?اش"),
    ("الأسلحة_الصاروخية", r"صلي|صلية|صاروخ|صواريخ|كاتيوشا"),
)
LOSS_RULES = (
    ("مروحيّة", r"مروحيّ?ة"),
    ("دبابات", r"(?:دبّ?ابة|ميركافا)"),
    ("هامر", r"هامر|هامفي|Hummer"),
    ("ناقلة_جند", r"ناقل(?:ة|تي)\s+جنود?"),
    ("جرافة", r"جرّ?افة|جرافات|D9"),
    ("هرمز", r"هرمز|هيرمس|Hermes"),
    ("كواد_كوبتر", r"(?i)كواد\s*كوبتر|quadcopter"),
    ("آلية_لوجستية", r"آليّ?ة\s+لوجستيّ?ة"),
)
CASUALTY_KEY = "قتيل_وجريح"
CASUALTY_NUMBER = r"(\d+)\s*(?:جندي|جنود|قتيل|قتلى|جريح|جرحى|إصاب|عسكري)"
COUNTER_LANDING = r"إنزال|عمليّ?ة إنزال"
COUNTER_ADVANCE = r"تقدّ?م|محاولة التقدّ?م|تسلّل|محاولة التسلّل"

# Facets
BADGE_LABELS = {
    "communique": "بيان عام", "deep": "ضربة عمق", "tank": "آلية / دبابة",
    "settlement": "مستوطنة", "multi": "متعدد الأهداف",
}
CANONICAL_WEAPONS = (
    ("صلية صاروخية", ("صلية صاروخ", "صليات صاروخ", "بصلية صاروخ", "صلية صاروخية كبيرة", "صلياتٍ صاروخ")),
    ("صاروخ موجه", ("صواريخ موجه", "صاروخ موجه", "بصاروخ موجه")),
    ("قذائف مدفعية", ("قذائف مدفع", "بقذائف المدفع")),
    (
        "مسيّرة انقضاضية",
        (
            "مسيرات انقضاض", "مسيرة انقضاض", "محلقات انقضاض", "محلقة انقضاض", "سرب مسيرات انقضاض",
            "سرب من المسيرات الانقضاض", "بسرب من المسيرات الانقضاض", "بمحلقة انقضاض",
        ),
    ),
    ("صواريخ نوعية", ("صواريخ نوعي", "صاروخ نوعي", "صلية من الصواريخ النوعي", "صليات من الصواريخ النوعي")),
    ("صاروخ أرض-جو", ("صاروخ أرض جو", "صاروخ أرض-جو", "صواريخ أرض جو")),
)
WEAPON_DROPS = ("الأسلحة المناسبة", "عملية قنص", "قنص", "بصلية من")
TARGET_DROPS = ("الساعة",)
TARGET_LABEL_PREFIX = "بيان "
TAG_DROPS = ("بيان عام",)
FACET_CAP = 300

# Day keywords
MEDIA_TERMS = (
    "يديعوت", "هآرتس", "معاريف", "القناة 12", "القناة 14", "كان", "القناة 13", "غلوبز", "كمين", "ميركافا",
)
STATE_TERMS = ("الوعد الصادق", "حرس الثورة", "هرمز")
STATEMENT_TERMS = (
    "ميركافا", "دبابة", "جرافة", "مروحية", "طائرة", "FPV", "كمين", "نار صديقة",
    "مسيّرة", "صلية صاروخية", "مدفعية", "صاروخ", "قذائف", "عبوة",
)

# Dashboards
TANK_WORD, HIT_WORD = "ميركافا", "إصابة"
BASE_WORDS, AIRCRAFT_WORDS = ("قاعدة", "ثكنة"), ("طائرة", "مروحيّة")
DRONE_ALERT_WORDS = ("مسيّرة", "تسلل")
ALERT_REGIONS = (
    ("تل أبيب", ("تل أبيب",)), ("كريات شمونه", ("كريات شمونه", "كريات شمونة")), ("نهاريا", ("نهاريا",)),
    ("المطلة", ("المطلة",)), ("إصبع الجليل", ("إصبع الجليل",)), ("الجليل الغربي", ("الجليل الغربي",)),
    ("الجليل الأعلى", ("الجليل الأعلى",)), ("الجولان", ("الجولان",)), ("طبريا", ("طبريا",)),
    ("أسدود", ("أسدود",)), ("القدس", ("القدس",)), ("حيفا", ("حيفا",)), ("صفد", ("صفد",)),
    ("بئر السبع", ("بئر السبع",)), ("ديمونا", ("ديمونا",)), ("إيلات", ("إيلات",)), ("عكا", ("عكا",)),
)
MEDIA_OUTLETS = (
    ("القناة 12", ("القناة 12",)), ("القناة 13", ("القناة 13",)), ("القناة 14", ("القناة 14",)),
    ("القناة 15", ("القناة 15",)), ("كان", ("قناة كان",)), ("يديعوت", ("يديعوت",)), ("غلوبز", ("غلوبز",)),
    ("الجبهة الداخلية", ("الجبهة الداخلية",)), ("إذاعة الجيش", ("إذاعة جيش",)),
    ("جيش العدو", ("جيش العدو",)), ("وسائل إعلام", ("وسائل إعلام",)),
)
MEDIA_TOPICS = (
    ("missiles", ("صاروخ", "مقذوف", "سقوط", "انفجار")),
    ("casualties", ("قتل", "جرح", "إصاب", "قتيل")),
    ("clashes", ("قتال", "اشتباك", "كمين", "عملية")),
    ("political", ("نتنياهو", "رئيس الأركان", "كابينيت", "سكان")),
)
STATE_EXCLUSIVE = (("irgc", ("حرس الثورة", "الحرس")), ("army", ("الجيش الإيراني", "القوات المسلحة")))
STATE_LABELS = (
    ("drones_down", ("إسقاط", "أسقط")),
    ("warnings", ("صواريخ من إيران", "رصد إطلاق", "الملاجئ")),
    ("missiles", ("الوعد الصادق", "الموجة", "موجة")),
    ("statements", ("بيان", "قائد الثورة", "خامنئي")),
)

# Month texts (plain, no markup)
MONTH_RISE = "شهد هذا الشهر تصعيداً ملحوظاً مقارنة بسابقه. "
MONTH_FALL = "شهد هذا الشهر تراجعاً في وتيرة العمليات مقارنة بسابقه. "
TREND_LIMIT = 30
POINT_LABELS = ("الأولى", "الثانية", "الثالثة", "الرابعة", "الخامسة")
POINT_FALLBACK = "رقم "
