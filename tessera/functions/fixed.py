"""Word lists, tables and patterns that results depend on."""

# Arabic relationship types and their English form.
ARABIC_RELATIONS = {
    "يرأس": "leads", "يدير": "manages", "يشرف_على": "supervises", "يقود": "leads", "رئيس": "leads", "مدير": "manages",
    "أسس": "founded", "أطلق": "launched", "أنشأ": "created", "طور": "developed", "صمم": "designed", "بنى": "built",
    "يعمل_في": "works_at", "يعمل_لدى": "works_for", "عمل_في": "worked_at", "موظف_في": "employed_by", "عضو_في": "member_of", "ينتمي_إلى": "belongs_to",
    "يقع_في": "located_in", "مقره_في": "headquartered_in", "عُقد_في": "held_in", "استضاف": "hosted", "في": "in",
    "شارك_في": "participated_in", "حضر": "attended", "نظم": "organized", "أقام": "hosted", "دعم": "supported", "رعى": "sponsored",
    "حصل_على": "received", "فاز_بـ": "won", "نال": "received", "منح": "awarded",
    "أعلن_عن": "announced", "أعلن": "announced", "تحدث_عن": "spoke_about", "صرح_عن": "stated", "نشر": "published",
    "يملك": "owns", "يمتلك": "owns", "يسيطر_على": "controls", "يتحكم_في": "controls",
    "يتعاون_مع": "collaborates_with", "شريك": "partner_of", "تعاون_مع": "collaborated_with",
    "يستخدم": "uses", "تستخدم": "uses", "يطبق": "applies", "يوظف": "employs",
    "درس_في": "studied_at", "تخرج_من": "graduated_from", "حاصل_على": "holds_degree_from",
    "استثمر_في": "invested_in", "مول": "funded", "دعم_ماليا": "financially_supported", "يمثل": "represents", "ممثل": "represents", "سفير": "ambassador_for",
}

# English variants and the relationship type that stands for them.
ENGLISH_RELATIONS = {
    "works_for": "works_at", "employed_by": "works_at", "employed_at": "works_at", "working_at": "works_at",
    "leads": "leads", "leading": "leads", "led": "leads", "head_of": "leads", "heads": "leads",
    "manages": "manages", "managing": "manages", "managed": "manages", "manager_of": "manages",
    "founded": "founded", "founder_of": "founded", "co-founded": "founded", "co_founded": "founded",
    "launched": "launched", "launching": "launched", "launches": "launched", "created": "created", "creates": "created", "creating": "created",
    "developed": "developed", "develops": "developed", "developing": "developed",
    "located_in": "located_in", "based_in": "located_in", "headquartered_in": "located_in", "situated_in": "located_in",
    "held_in": "held_in", "held_at": "held_in", "took_place_in": "held_in",
    "participated_in": "participated_in", "participated": "participated_in", "participates_in": "participated_in",
    "organized": "organized", "organizes": "organized", "organizing": "organized", "organizer_of": "organized",
    "received": "received", "receives": "received", "receiving": "received", "won": "won", "wins": "won", "winning": "won", "winner_of": "won",
    "announced": "announced", "announces": "announced", "announcing": "announced", "owns": "owns", "owned": "owns", "owner_of": "owns",
    "uses": "uses", "used": "uses", "using": "uses", "utilizes": "uses",
    "collaborates_with": "collaborates_with", "collaborated_with": "collaborates_with", "collaboration_with": "collaborates_with", "partner_of": "collaborates_with", "partners_with": "collaborates_with",
    "member_of": "member_of", "belongs_to": "member_of", "part_of": "member_of",
    "invested_in": "invested_in", "invests_in": "invested_in", "investor_in": "invested_in", "funded": "funded", "funds": "funded", "funding": "funded", "funder_of": "funded",
    "represents": "represents", "representing": "represents", "represented": "represents", "spoke_about": "spoke_about", "speaks_about": "spoke_about", "discussed": "spoke_about",
    "hosted": "hosted", "hosts": "hosted", "hosting": "hosted", "sponsored": "sponsored", "sponsors": "sponsored", "sponsoring": "sponsored", "sponsor_of": "sponsored",
    "supported": "supported", "supports": "supported", "supporting": "supported",
    "studied_at": "studied_at", "studied_in": "studied_at", "studies_at": "studied_at", "graduated_from": "graduated_from", "graduates_from": "graduated_from", "alumnus_of": "graduated_from",
}

# Categories of relationship types.
RELATION_CATEGORIES = {
    "leadership": ["leads", "manages", "supervises", "heads"],
    "creation": ["founded", "launched", "created", "developed", "designed", "built"],
    "employment": ["works_at", "employed_by", "member_of", "belongs_to"],
    "location": ["located_in", "headquartered_in", "held_in", "hosted", "in"],
    "participation": ["participated_in", "attended", "organized", "supported", "sponsored"],
    "recognition": ["received", "won", "awarded"],
    "communication": ["announced", "spoke_about", "stated", "published"],
    "ownership": ["owns", "controls"],
    "collaboration": ["collaborates_with", "partner_of"],
    "usage": ["uses", "applies", "employs"],
    "education": ["studied_at", "graduated_from", "holds_degree_from"],
    "investment": ["invested_in", "funded", "financially_supported"],
    "representation": ["represents", "ambassador_for"],
}

# Relationship types that hold both ways, and confidence by type.
BOTH_WAYS = ["collaborates_with", "partner_of", "related_to", "similar_to", "cooccurs_with"]
RELATION_CONFIDENCE = {
    "founded": 1.0, "leads": 0.95, "manages": 0.95, "works_at": 0.9, "located_in": 0.9, "won": 0.95, "graduated_from": 0.95, "participated_in": 0.8,
    "organized": 0.85, "announced": 0.85, "developed": 0.85, "uses": 0.8, "collaborates_with": 0.7, "supported": 0.7, "member_of": 0.75,
}
OTHER_RELATION_CONFIDENCE = 0.6

# Noise in transcripts.
NOISE = [
    r"\[موسيقى\]", r"\[تصفيق\]", r"\[ضحك\]", r"\[صمت\]", r"\[صوت\]",
    r"\[Music\]", r"\[Applause\]", r"\[Laughter\]", r"\[Silence\]", r"\[Sound\]", r"\[music\]", r"\[applause\]",
    "[\u0e00-\u0e7f]+", "[\u0400-\u04ff]+", r"\bKom\b", r"\s{3,}", r"[.]{3,}", r"[!]{2,}", r"[?]{2,}",
]

# Query patterns by class, tried in this order.
QUERY_CLASSES = {
    "holistic": ["ما هي الموضوعات الرئيسية", "الموضوعات الرئيسية", "المواضيع الرئيسية", "لخص|تلخيص|ملخص", "ما الأنماط", "الاتجاهات العامة", "بشكل عام|إجمالاً", "عبر جميع|عبر كل", "في قاعدة البيانات", "ما هي أبرز", "ما هي أهم النقاط", "استعرض", "what are the main themes", "what are the key topics", "summarize (?:the|all|everything)", "summary of (?:the|all)", "what patterns", "what trends", "across all (?:documents|data)", "in general", "overall", "key takeaways", "main insights", "what can you tell me about"],
    "comparative": ["مقارنة بين|مقارنة ب", "الفرق بين", "تقارن|يقارن", "compare", "difference between", r"vs\.?|versus", "how does .+ differ"],
    "relationship": ["العلاقة بين", "كيف يرتبط|كيف ترتبط", "ما العلاقة", "الارتباط بين", "relationship between", "how (?:is|are) .+ related", "connection between", "linked to"],
    "exploratory": ["أهم", "الإنجازات", "النتائج المحققة", "overview of", "achievements"],
    "explanatory": ["لماذا", "كيف ساهم|كيف ساهمت", "كيف يعمل|كيف تعمل", "why did|why does|why is", "how did|how does|how is", "how contributed", "explain", "اشرح"],
    "entity": ["من هو|من هي|من هم", "ما هو|ما هي|ما هم", "المرشح|المرشحون", "الفائز|الفائزون", "who is|who are|who were", "what is|what are", "tell me about", "أخبرني عن", "معلومات عن"],
}
CLASS_MODES = {"holistic": "global_search", "comparative": "mix", "relationship": "global", "exploratory": "global", "explanatory": "hybrid", "entity": "local", "factual": "hybrid"}

# English words that carry no topic.
STOP_WORDS = ["the", "a", "an", "is", "are", "was", "were", "in", "on", "at", "to", "for", "of", "and", "or", "what", "who", "how", "why", "when", "where", "which", "that", "this", "with", "from", "by", "as", "it", "be"]
# Arabic words that carry no topic.
ARABIC_STOP_WORDS = ["في", "من", "على", "إلى", "عن", "مع", "هذا", "هذه", "التي", "الذي", "ما", "هو", "هي", "أن", "كان", "كيف", "لماذا", "متى", "أين"]
# Class and id fragments of page furniture.
PAGE_NOISE = ["nav", "menu", "sidebar", "footer", "header", "ad", "advertisement", "banner", "popup", "cookie", "social", "share"]
# Class and id fragments of elements that are no content.
ELEMENT_NOISE = ["nav", "navigation", "menu", "sidebar", "ad", "advertisement", "footer", "header", "cookie", "popup", "modal", "banner"]
# Key fragments that a JSON field is left out for.
JSON_SKIP = ["id", "uuid", "created", "updated", "timestamp", "count", "url", "link", "token", "hash", "version"]

#: Fixed values of the answer score: words that tell nothing of a question, and marks of a specific answer.
QUESTION_STOP_WORDS = ["ما", "هي", "هو", "من", "في", "على", "إلى", "عن", "مع", "أو", "و", "what", "is", "the", "are", "how", "does", "do", "a", "an", "of", "to", "in"]
SPECIFIC_MARKS = ["2030", "2024", "2025", "%", "٪", "مليون", "مليار", "million", "billion"]
#: The Unicode blocks of Arabic letters, as a regular expression's class.
ARABIC_BLOCKS = r"[\x{0600}-\x{06FF}\x{0750}-\x{077F}\x{08A0}-\x{08FF}\x{FB50}-\x{FDFF}\x{FE70}-\x{FEFF}]"

# Typed patterns of entities, by language and type; matched without regard to case. An Arabic head is followed by a run of
# Arabic words (OPEN), by one word (ONE) or by two.
OPEN, ONE = r"\s+[\x{0600}-\x{06FF}\s]+", r"\s+[\x{0600}-\x{06FF}]+"
ARABIC_HEADS = {
    "Organization": ["وزارة", "هيئة", "مؤسسة", "شركة", "جامعة", "بنك", "مركز", "معهد"],
    "Program": ["برنامج", "مبادرة", "مشروع", "خطة", "استراتيجية"],
    "Award": ["جائزة", "وسام", "تكريم"],
    "Event": ["مؤتمر", "قمة", "منتدى", "ملتقى", "معرض"],
    "Person": ["الأمير", "الشيخ", "الدكتور", "المهندس", "الأستاذ", "سمو", "معالي"],
}
ARABIC_PLACES = ["مدينة", "منطقة", "محافظة"]
ARABIC_TECHNOLOGY = [r"الذكاء\s+الاصطناعي", r"التعلم\s+الآلي", r"البيانات\s+الضخمة", r"الحوسبة\s+السحابية", r"سلسلة\s+الكتل", r"إنترنت\s+الأشياء"]
ENTITY_PATTERNS = {
    "ar": {kind: [head + OPEN for head in heads] for kind, heads in ARABIC_HEADS.items()} | {"Location": [head + ONE for head in ARABIC_PLACES], "Technology": ARABIC_TECHNOLOGY},
    "en": {
        "Organization": [r"Ministry of \w+", r"Department of \w+", r"\w+ Authority", r"\w+ Corporation", r"\w+ Foundation", r"\w+ Institute", r"\w+ University", r"\w+ Center", r"\w+ Bank"],
        "Program": [r"\w+ Program", r"\w+ Initiative", r"\w+ Project", r"\w+ Strategy", r"Vision \d{4}"],
        "Event": [r"\w+ Conference", r"\w+ Summit", r"\w+ Forum", r"\w+ Exhibition"],
        "Technology": ["Artificial Intelligence|AI", "Machine Learning|ML", "Big Data", "Cloud Computing", "Blockchain", "Internet of Things|IoT", "Digital Transformation"],
    },
}
ENTITY_PATTERNS["ar"]["Organization"] += ["المركز" + ONE + ONE, "الهيئة" + ONE + ONE]
ENTITY_PATTERNS["ar"]["Program"] += [r"رؤية\s+\d{4}"]

# Patterns of queries that are asked in parts, by kind, tried in this order; conjunctions that part them; the sides of a comparison.
COMPLEX_QUERIES = {
    "multi_hop": ["علاقة.*ب", r"كيف\s+(?:يرتبط|ترتبط)", "من خلال", "عبر"],
    "comparison": [r"مقارنة\s+بين", r"الفرق\s+بين", "أفضل", "مقابل"],
    "aggregation": ["جميع", "كل", r"كم\s+عدد", "اذكر", "ما هي"],
    "conditional": ["إذا", r"في\s+حالة", "عندما", "لو"],
    "temporal": ["متى", "قبل", "بعد", "خلال", "منذ"],
    "causal": ["لماذا", "بسبب", "نتيجة", "سبب"],
}
CONJUNCTIONS = r"\s+و\s+|\s+وكذلك\s+|\s+وأيضاً\s+"
