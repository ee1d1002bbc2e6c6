"""Target, weapon and list patterns. Extraction gives the
expected fields only with exactly these phrases and their order. ``{END}``
stands for the common end of a captured place."""

WEAPON_LEADS = (
    "بصلي|بسرب|بقذائف|بقذيفة|بالقذائف|بمحلق|بمحلقات|بالمحلقات|"
    "بصاروخ|بالصاروخ|بالصواريخ|بصواريخ|بصلية|بصلياتٍ|بصليات|بالصليات|"
    "بالأسلحة|بأسلحة|بسلاح|بعبوة|بعبوات|بالعبوة|"
    "بمسيرة|بمسيرات|بالمسيرات|بسربٍ|بسربِ|بالسرب|"
    "برشقة|برشقات|بالرشاشات|برشاش|بالرشقات|"
    "بالمدفعية|بمدفعية|بقصف|بالقصف|"
    "بكمية|بكميات|بالكميات|بتفجير|بالاشتباك|بهدف|بالكاتيوشا|"
    "ببركان|بصاروخي|بكنعان|بفلق|بشاهد|بكروز|بحزمة|بالحزمة"
)
OUTCOME_LEADS = (
    r"و(?:حقق|أجبر|تدمير|شوهد|تم|ما\s+زال|أسفر|هدف|توقف|تمكن|"
    r"أوقع|أوقعوا|ألحقوا|ألحق|أدى|اندلع|اشتعل)"
)
END = r"(?=[،,.؛۔؟!:\n(]|\s+(?:" + WEAPON_LEADS + r")|\s+" + OUTCOME_LEADS + r"|\s+[-•]\s|$)"
VERBS = (
    r"(?:استهدف|استهدفت|استهدفوا|استهدفا|هاجم|هاجمت|هاجموا|"
    r"قصف|قصفت|قصفوا|دك|دكت|دكوا|فجر|فجرت|فجروا|"
    r"تصد|تصدت|تصدوا|أسقط|أسقطت|أسقطوا|رصد|رصدت|رصدوا|"
    r"اشتبك|اشتبكت|اشتبكوا|شن|شنت|شنوا|نفذ|نفذت|نفذوا)"
    r"[هاهمكنتما]*"
)
PLACE_NOUNS = (
    "مستوطنة|مستوطنتي|مستوطنتَي|مستوطنات|مستعمرة|مستعمرات|"
    "مدينة|بلدة|بلدات|قرية|قرى|منطقة|حي|حيّ|حارة|"
    "تلة|تلّة|تلال|مرتفع|خلة|خلّة|وادي|ادي|جبل|مزرعة|مزارع|"
    "موقع|مواقع|قاعدة|قواعد|ثكنة|ثكنات|معسكر|معسكرات|"
    "معتقل|مركز|مشفى|مقر|مجمع|مجمّع|مصفاة|مصنع|مصانع|"
    "مرفأ|ميناء|مطار|مطارات|محطة|محطّة|معبر|معابر|"
    "حقل|حقول|جسر|جسور|نفق|أنفاق|مفرق|مفارق|"
    "مدخل|مداخل|بوابة|منظومة|منظومات|شركة|شركات"
)
BORDER_WARNING = (r"المستوطنات\s+التي\s+سبق\s+التحذير", r"المستوطنات\s+الّ?تي\s+حُذّرت")
BORDER_WARNING_TARGET = "المستوطنات الحدودية"
TARGET_PATTERNS = (
    r"(?:في|على)\s*:\s*([^.؛\n]+?){END}",
    r"في\s+أجواء\s+(?:مدينة|بلدة|قرية|منطقة)?\s*([^،,.؛\n]+?){END}",
    r"فوق\s+(?:بلدة|مدينة|قرية|منطقة|سماء)\s+([^،,.؛\n]+?){END}",
    r"في\s+(?:محيط|جوار)\s+(?:مدينة|بلدة|قرية|مستوطنة)?\s*([^،,.؛\n]+?){END}",
    r"عند\s+أطراف\s+(?:بلدة|مدينة|قرية|مستوطنة)\s+([^،,.؛\n]+?){END}",
    r"عند\s+أطراف\s+([^،,.؛\n]+?){END}",
    r"في\s+الأطراف\s+(?:الجنوبيّ?ة|الشماليّ?ة|الشرقيّ?ة|الغربيّ?ة)\s+ل?(?:بلدة|مدينة|قرية|مستوطنة)\s+([^،,.؛\n]+?){END}",
    r"عند\s+تقاطع\s+([^،,.؛\n]+?){END}",
    r"عند\s+مثلّث\s+([^،,.؛\n]+?){END}",
    r"باتّ?جاه\s+(?:الحارة\s+(?:الجنوبيّ?ة|الشماليّ?ة|الشرقيّ?ة|الغربيّ?ة)\s+ل)?(?:مدينة|بلدة|قرية|مستوطنة|موقع|تلّة|تلة)?\s*([^،,.؛\n]+?){END}",
    r"نحو\s+(?:مدينة|بلدة|قرية|مستوطنة)?\s*([^،,.؛\n]+?){END}",
    r"في\s+مشروع\s+([^،,.؛\n]+?){END}",
    r"على\s+طريق\s+([^،,.؛\n]+?){END}",
    r"في\s+الحارة\s+(?:الجنوبيّ?ة|الشماليّ?ة|الشرقيّ?ة|الغربيّ?ة)\s+ل?(?:مدينة|بلدة|قرية)?\s*([^،,.؛\n]+?){END}",
    r"على\s+(قاعدة\s+[^،,.؛\n(]+?){END}",
    r"على\s+(ثكنت?[َي]?ي?\s+[^،,.؛\n(]+?){END}",
    r"على\s+موقع\s+([^،,.؛\n(]+?){END}",
    r"على\s+(?:مواقع|تجمّعات)\s+[^،,.؛\n]{0,60}?في\s+([^،,.؛\n]+?){END}",
    r"قرب\s+(?:حسينيّ?ة|معتقل|موقع|قاعدة|ثكنة|مستوطنة|مدينة|بلدة|قرية|مركز|مشفى)\s+(?:بلدة|مدينة)?\s*([^،,.؛\n]+?){END}",
    r"محيط\s+(?:معتقل|موقع|قاعدة|ثكنة|مستوطنة|مدينة|بلدة|قرية|مركز|مشفى)\s+([^،,.؛\n]+?){END}",
    r"(?:عند\s+)?مدخل\s+(?:بلدة|مدينة|قرية|مستوطنة)?\s*([^،,.؛\n]+?){END}",
    r"بين\s+بلدت[َي]?ي\s+([^.؛\n]+?){END}",
    r"بين\s+(?:مرتفع|تلّة|تلة|تلال|موقع|جبل|مزرعة|وادي)\s+([^.؛\n]+?)\s+و",
    r"في\s+سماء\s+([^،,.؛\n]+?){END}",
    r"(?:جنوب|شمال)\s+(?:شرق|غرب)\s+([^،,.؛\n]+?){END}",
    r"ل(?:مستوطنة|مستوطنتي|مستوطنتَي|مستوطنتين|مدينة|بلدة|قرية|موقع|قاعدة|ثكنة)\s+([^.؛\n]+?){END}",
    r"(?:شرق|شمال|غرب|جنوب|شماليّ?|جنوبيّ?|شرقيّ?|غربيّ?)\s+(?:معتقل|مشروع|موقع|مدينة|بلدة|قرية|مستوطنة|قاعدة|ثكنة|معسكر)\s+([^،,.؛\n]+?){END}",
    r"إلى\s+(?:بلدة|مدينة|قرية|مستوطنة|موقع|قاعدة)\s+([^،,.؛\n]+?){END}",
    r"(?:استهدف|دكّ|قصف|قصفت|دكّت)[هاهمكنت]*\s+(?:[^.؛\n]{0,120}?\s+)?(قاعدة\s+[^،,.؛\n(]+?){END}",
    r"(?:استهدف|دكّ|قصف)[هاهمكنت]*\s+(?:[^.؛\n]{0,120}?\s+)?(ثكنة\s+[^،,.؛\n(]+?){END}",
    r"(?:استهدف|دكّ|قصف|قصفت|دكّت)[هاهمكنت]*\s+(?:[^.؛\n]{0,120}?\s+)?(موقع\s+[^،,.؛\n(]+?){END}",
    r"(?:استهدف|قصف|قصفت|دكّ)[هاهمكنت]*\s+(?:[^.؛\n]{0,120}?\s+)?(مستوطنة\s+[^،,.؛\n(]+?){END}",
    r"(?:استهدف|دكّ|قصف)[هاهمكنت]*\s+(?:[^.؛\n]{0,120}?\s+)?(مقرّ\s+[^،,.؛\n(]+?){END}",
    r"(?:استهدف|دكّ|قصف)[هاهمكنت]*\s+(?:[^.؛\n]{0,120}?\s+)?(مصفاة\s+[^،,.؛\n(]+?){END}",
    r"(?:استهدف|دكّ|قصف)[هاهمكنت]*\s+(?:[^.؛\n]{0,120}?\s+)?(مجمّع\s+[^،,.؛\n(]+?){END}",
    r"مستوطنات\s*:\s*([^.؛\n]+?){END}",
    r"(?:استهدف|قصف|دكّ)[هاهمكنت]*\s+(?:[^.؛\n]{0,120}?\s+)?(مستوطنتي?\s+[^.؛\n(]+?){END}",
    r"(?:استهدف|قصف|دكّ)[هاهمكنت]*\s+(?:[^.؛\n]{0,120}?\s+)?(مستوطنات\s+[^.؛\n(]+?){END}",
    r"(?:استهدف|قصف|دكّ)[هاهمكنت]*\s+(?:[^.؛\n]{0,120}?\s+)?(معسكر\s+[^،,.؛\n(]+?){END}",
    r"(?:استهدف|قصف|دكّ)[هاهمكنت]*\s+(?:[^.؛\n]{0,120}?\s+)?(منظومة\s+[^.؛\n(]+?){END}",
    r"(?:استهدف|قصف|دكّ)[هاهمكنت]*\s+(?:[^.؛\n]{0,120}?\s+)?(شركة\s+[^،,.؛\n(]+?){END}",
    r"(?:استهدف|قصف|دكّ)[هاهمكنت]*\s+(?:[^.؛\n]{0,120}?\s+)?(مصنع\s+[^،,.؛\n(]+?){END}",
    r"في\s+بلدت[َي]?ي\s+([^.؛\n]+?){END}",
    r"في\s+(?:{NOUNS})\s+([^،,.؛\n]+?){END}",
    r"{VERBS}\s+(?:[^.؛\n]{0,120}?\s+)?(?:في|عند|على|باتجاه|نحو|قرب|قبالة|فوق|داخل)\s+([^،,.؛\n]+?){END}",
    r"((?:{NOUNS})\s+[^.؛\n]{2,80}?)\s+(?:استهدفها|هاجمها|قصفها|دكها|استهدفه|هاجمه|قصفه|دكه|اشتبك\s+معها|تصدى\s+لها)",
    r"{VERBS}\s+(?:[^.؛\n]{0,120}?\s+)?((?:مرفأ|ميناء|مطار|محطة|معبر|حقل|جسر|نفق|مفرق|مدخل|بوابة)\s+[^،,.؛\n(]+?){END}",
    r"(?:جنوب|شمال|شرق|غرب|جنوبي|شمالي|شرقي|غربي)\s+(?:مدينة|بلدة|قرية|مستوطنة)\s+([^،,.؛\n]+?){END}",
)
# Words of which a text holds one if the pattern matches, by pattern; where none
# occurs the pattern need not run. Patterns that are not listed always run.
_SIDES = ("شرق", "شمال", "غرب", "جنوب")
_NEEDS = (
    (":",), ("أجواء",), ("فوق",), ("محيط", "جوار"), ("أطراف",), ("أطراف",), ("الأطراف",), ("تقاطع",), ("مثل",), ("جاه",), ("نحو",),
    ("مشروع",), ("طريق",), ("الحارة",), ("قاعدة",), ("ثكن",), ("موقع",), ("مواقع", "تجم"), ("قرب",), ("محيط",), ("مدخل",),
    ("بلدت",), ("بين",), ("سماء",), ("جنوب", "شمال"), ("لمستوطن", "لمدينة", "لبلدة", "لقرية", "لموقع", "لقاعدة", "لثكنة"), _SIDES,
    ("إلى",), ("قاعدة",), ("ثكنة",), ("موقع",), ("مستوطنة",), ("مقر",), ("مصفاة",), ("مجم",), ("مستوطنات",), ("مستوطنت",),
    ("مستوطنات",), ("معسكر",), ("منظومة",), ("شركة",), ("مصنع",), ("بلدت",), ("في",),
    ("في", "عند", "على", "باتجاه", "نحو", "قرب", "قبالة", "فوق", "داخل"),
    ("هدفه", "هاجمه", "قصفه", "دكه", "معها", "لها"),
    ("مرفأ", "ميناء", "مطار", "محطة", "معبر", "حقل", "جسر", "نفق", "مفرق", "مدخل", "بوابة"), _SIDES,
)
PATTERN_WORDS = dict(zip(TARGET_PATTERNS, _NEEDS, strict=True))
TARGET_OBJECT_PREFIX = r"^(?:مستوطنة|مستوطنتي|مستوطنتَي|مستوطنات|مدينة|بلدة|قرية)\s+"
AIRCRAFT_PATTERN = r"تصدّ[ىا].*?لطائرة\s+حربيّ?ة"
AIRCRAFT_TARGET = "طائرة حربية إسرائيلية"

# Ordered removals before target patterns run (pattern, replacement).
LIST_TAIL = r"على\s+النحو\s+الآتي|على\s+الشكل\s+الآتي|على\s+النحو\s+التالي|كالآتي\s*:|كالتالي\s*:|وفق\s+الآتي"
BODY_REMOVALS = (
    r"﴿[^﴾]*﴾",
    r"صَدَقَ اللهُ[^\n]*",
    r"بِسْمِ اللَّـهِ[^\n]*",
    r"{LUNAR}",
    r"\d{1,2}[-/]\d{1,2}[-/]\d{4}",
    r"(?:عند\s+)?الس[ّ]?اعة\s*\d{1,2}:\d{2}",
    r"الواقع\s+فيه",
    r"رد[ًّا]*\s+على\s+العدوان\s+الإسرائيل[يّ]{0,3}\s+المجرم[^،]*?ضاحية\s+بيروت\s+الجنوبي[ّة]{0,3}[،,]?",
    r"دفاع[اً]+\s+عن\s+لبنان\s+وشعبه[،,]?",
    r"من\s+(?:بعد\s+)?(?:ظهر|فجر|صباح|عصر|ليل|مساء)\s+(?:اليوم|أمس)?\s*",
    r"من\s+(?:بعد\s+)?(?:ظهر|فجر|صباح|عصر|ليل|مساء)",
    r"(?:الإثنين|الاثنين|الثلاثاء|الأربعاء|الخميس|الجمعة|السبت|الأحد)\s*",
    r"(?:\bأمس\b|\bاليوم\b|\bغد[اًّ]?\b|\bمساء\b|\bصباح\b|\bظهر\b|\bفجر\b|\bليل\b|\bعصر\b)",
)
_PARTS = ("ظهر", "فجر", "صباح", "عصر", "ليل", "مساء")
PATTERN_WORDS.update(zip(BODY_REMOVALS, (
    ("﴿",), *((p.removesuffix(r"[^\n]*"),) for p in BODY_REMOVALS[1:3]), ("\u0647\u0640",), ("-", "/"), (":",), ("الواقع",), ("العدوان",), ("لبنان",), _PARTS, _PARTS,
    ("الإثنين", "الاثنين", "الثلاثاء", "الأربعاء", "الخميس", "الجمعة", "السبت", "الأحد"), ("أمس", "اليوم", "غد", *_PARTS)), strict=True))
PATTERN_WORDS[LIST_TAIL] = ("النحو", "الشكل", "كالآتي", "كالتالي", "وفق")
# Ordered removals inside a captured place.
LOCATION_LEADS = r"^(?:[\s،,]+|و\s+)+"
LOCATION_TAILS = r"(?:[\s،,]+|\sو)+$"
LOCATION_SOURCE = r"^(?:من|مِن)\s+"
LOCATION_CLAUSES = (
    r"\s+(?:و?اشتبك|و?اشتبكوا|و?استهدفوا|و?تصدّ[ىوا]|و?تصدى|محاول)\s*.*$",
    r"\s+(?:المحتلّ?ة|المُحتلّ?ة|والتي|التي|وما|وقد|حيث|بعد|باتجاه)\s*.*$",
)
PATTERN_WORDS.update(zip(LOCATION_CLAUSES, (
    ("شتبك", "ستهدفوا", "تصد", "محاول"), ("محتل", "مُحتل", "التي", "وما", "وقد", "حيث", "بعد", "باتجاه")), strict=True))
PATTERN_WORDS[LOCATION_SOURCE] = ("م",)
LOCATION_ENDS = "،,و"  # besides white space, what leads and tails begin or end with
LOCATION_LENGTH = 80

# Phrase in the normalised text → label.
WEAPON_LABELS = (
    ("سرب من المسيرات الانقضاضية", "مسيّرات انقضاضية"),
    ("سربا من المسيرات الانقضاضية", "مسيّرات انقضاضية"),
    ("اسراب من المسيرات الانقضاضية", "مسيّرات انقضاضية"),
    ("اسراب من المحلقات الانقضاضية", "محلّقات انقضاضية"),
    ("محلقات انقضاضية", "محلّقات انقضاضية"),
    ("محلقة انقضاضية", "محلّقة انقضاضية"),
    ("مسيرة انقضاضية", "مسيّرة انقضاضية"),
    ("مسيرات انقضاضية", "مسيّرات انقضاضية"),
    ("قذائف المدفعية", "قذائف مدفعية"),
    ("قذائف مدفعية", "قذائف مدفعية"),
    ("قذائف الهاون", "قذائف هاون"),
    ("قذيفة هاون", "قذائف هاون"),
    ("هاون", "قذائف هاون"),
    ("صلية صاروخية كبيرة", "صليات صاروخية"),
    ("صليات صاروخية كبيرة", "صليات صاروخية"),
    ("صليات صاروخية", "صليات صاروخية"),
    ("صلية صاروخية", "صلية صاروخية"),
    ("الصواريخ الموجهة", "صواريخ موجّهة"),
    ("صواريخ موجهة", "صواريخ موجّهة"),
    ("صاروخ موجه", "صاروخ موجّه"),
    ("صاروخ نوعي", "صاروخ نوعيّ"),
    ("صواريخ نوعية", "صواريخ نوعية"),
    ("الصواريخ النوعية", "صواريخ نوعية"),
    ("صاروخ ارض جو", "صاروخ أرض جوّ"),
    ("صواريخ ارض جو", "صواريخ أرض جوّ"),
    ("الرشاشات الثقيلة", "رشّاشات ثقيلة"),
    ("رشاشات ثقيلة", "رشّاشات ثقيلة"),
    ("الاسلحة الصاروخية وقذائف المدفعية", "صواريخ + مدفعية"),
    ("الاسلحة الصاروخية", "أسلحة صاروخية"),
    ("اسلحة صاروخية", "أسلحة صاروخية"),
    ("الاسلحة المناسبة", "الأسلحة المناسبة"),
    ("اسلحة مناسبة", "الأسلحة المناسبة"),
    ("كمية من الصواريخ", "كمية من الصواريخ"),
    ("عبوة شواظ", "عبوة شواظ"),
    ("عبوات ناسفة", "عبوات ناسفة"),
    ("عبوة ناسفة", "عبوة ناسفة"),
    ("تشريكة ميكانيكية", "تشريكة ميكانيكية"),
    ("كاتيوشا", "صواريخ كاتيوشا"),
    ("صاروخ بركان", "صاروخ بركان"),
    ("صواريخ بركان", "صواريخ بركان"),
    ("صاروخ فلق", "صاروخ فلق"),
    ("صاروخ كنعان", "صاروخ كنعان"),
    ("صاروخ شاهد", "صاروخ شاهد"),
    ("صاروخ كروز", "صاروخ كروز"),
    ("سلاح الهندسة", "سلاح الهندسة"),
    ("بدر", "صاروخ بدر"),
)
# Every phrase and the fallback hold one of these.
WEAPON_WORDS = ("مسير", "محلق", "قذ", "هاون", "صار", "صوار", "صلي", "رشاش", "سلح", "سلاح", "عبو", "تشريك", "كاتيوشا", "بدر")
WEAPON_FALLBACK = r"ب(?:ال)?(?:صاروخ|صواريخ|قذائف|قذيفة|سلاح|اسلحة)\s+(\S{2,20})"
WEAPON_FALLBACK_NOT = ("و", "ف", "ال")

# Nested list items.
LIST_MARKER = r"على\s+النحو\s+الآتي|على\s+الشكل\s+الآتي|على\s+النحو\s+التالي|كالآتي\s*:|كالتّالي\s*:|وفق\s+الآتي"
PATTERN_WORDS[LIST_MARKER] = ("النحو", "الشكل", "كالآتي", "كالتّالي", "وفق")
LIST_STOP = r"﴿وَمَا النَّصْرُ|#[ء-ي_]+|\d+\s+(?:شوال|رمضان|شعبان)"
PATTERN_WORDS[LIST_STOP] = ("﴿", "#", "شوال", "رمضان", "شعبان")
ITEM_WEAPON = (
    r"ب[ِ]?(?:صلي|سرب|قذائف|قذيفة|محلّق|صاروخ|صاروخاً|الصواريخ|صواريخ|"
    r"الأسلحة|أسلحة|سلاح|عبوة|عبوات|مسيّرة|مسيّرات|مسيرة|مسيرات|"
    r"رشقة|رشقات|الرشّاشات|الرشاشات|رشّاش|المدفعيّة|المدفعية|مدفعية|"
    r"كمية|كميات|الكميات|تفجير|هدف)"
    r"|بالأسلحة|بالصاروخ|بالصواريخ|بالرشّاشات|بالرشاشات|بالمدفعيّة|بالمدفعية|بالاشتباك"
)
# A timed item is its time and then the rest of the line or sentence.
ITEM_BULLET_TIME = r"[-•‐–—]\s*(?:الس[ّ]?اعة\s*)?(\d{1,2})[:.](\d{2})\s+"
ITEM_INLINE_TIME = r"(?:عند|في|وعند|وفي|ثمّ\s+عند|ثم\s+عند|في\s+تمام)\s+(?:الس[ّ]?اعة)\s*(\d{1,2})[:.](\d{2})\s+"
ITEM_REST = r"([^\n]+?)(?:\s*\.|$)"
ITEM_SHARED_TIME = r"(?:عند|في)\s+(?:الس[ّ]?اعة)\s*(\d{1,2})[:.](\d{2})"
ITEM_SHARED_BULLET = r"[-•‐–—]\s*([^\n]+?)\s*\."
