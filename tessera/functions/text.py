"""Scalar functions on texts: normalising, counting, splitting, judging."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions import fixed

ARABIC = "\u0600-\u06ff"


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def words(x: Column | str) -> Column:
    """What white space separates, as an array without empty strings."""
    return F.filter(F.split(F.trim(_c(x)), r"\s+"), lambda w: w != "")


def key_terms(x: Column | str, longer_than: int = 3, stop: list[str] = fixed.STOP_WORDS) -> Column:
    """Distinct lower-case words of letters and digits that are long enough and carry a topic, sorted."""
    found = F.regexp_extract_all(F.lower(_c(x)), F.lit(r"([\p{L}\p{N}_]+)"), F.lit(1))
    return F.array_sort(F.array_distinct(F.filter(found, lambda w: (F.length(w) > longer_than) & ~w.isin(*stop))))


def overlap(a: Column, b: Column) -> Column:
    """Size of the intersection of two arrays."""
    return F.size(F.array_intersect(a, b))


def share(part: Column, whole: Column) -> Column:
    """part / whole, 0 where whole is 0."""
    return F.coalesce(part / F.nullif(whole, F.lit(0)), F.lit(0.0))


def jaccard(a: Column, b: Column) -> Column:
    return share(overlap(a, b), F.size(F.array_union(a, b)))


def arabic_normalized(x: Column | str) -> Column:
    """Diacritics and tatweel gone; forms of alef, yaa and taa marbuta made one."""
    return F.translate(F.regexp_replace(_c(x), "[\u064b-\u0670\u065f\u0640]", ""), "ةأإآى", "هاااي")


def arabic_configured(x: Column | str, taa_marbuta: bool = False, only_arabic: bool = True) -> Column:
    out = F.translate(F.regexp_replace(_c(x), "[\u064b-\u0652\u0670\u0640]", ""), "أإآٱى", "ااااي")
    if taa_marbuta:
        out = F.translate(out, "ة", "ه")
    if only_arabic:
        out = F.regexp_replace(out, "[^\u0600-\u06ff\u0750-\u077f\u08a0-\u08ff\ufb50-\ufdff\ufe70-\ufeff\\s]", "")
    return F.trim(F.regexp_replace(out, r"\s+", " "))


def arabic_variants(x: Column | str) -> Column:
    """Spellings to search for, sorted: as is, normalised, and with the other form of a closing haa or taa marbuta."""
    a = _c(x)
    other = F.when(a.endswith("ة"), F.regexp_replace(a, "ة$", "ه")).when(a.endswith("ه"), F.regexp_replace(a, "ه$", "ة")).otherwise(a)
    return F.array_sort(F.array_distinct(F.array(a, arabic_normalized(a), other)))


def arabic_keywords(x: Column | str) -> Column:
    """Words of three letters or more that carry a topic, punctuation stripped, without a short article."""
    bare = F.transform(words(x), lambda w: F.regexp_replace(w, "^[؟?!.,،؛:\"'()]+|[؟?!.,،؛:\"'()]+$", ""))
    kept = F.filter(bare, lambda w: (F.length(w) >= 3) & ~w.isin(*fixed.ARABIC_STOP_WORDS))
    return F.transform(kept, lambda w: F.when(w.startswith("ال") & (F.length(w) > 4), F.substring(w, F.lit(3), F.length(w))).otherwise(w))


def counted(x: Column | str, characters: str) -> Column:
    return F.length(F.regexp_replace(_c(x), f"[^{characters}]", ""))


def languages(x: Column | str) -> list[Column]:
    """Four rules for the language: by more letters, by over 0.3 Arabic, by three bands, and by half of the characters."""
    ar, latin, all_ = counted(x, ARABIC), counted(x, "A-Za-z"), F.length(_c(x))
    ratio = share(ar, ar + latin)
    return [
        F.when(ar > latin, "ar").otherwise("en").alias("by_letters"),
        F.when(share(ar, all_) > 0.3, "ar").otherwise("en").alias("by_ratio"),
        F.when(ratio > 0.8, "ar").when(ratio < 0.2, "en").otherwise("mixed").alias("by_bands"),
        (ratio > 0.5).alias("is_arabic"),
    ]


def cleaned(x: Column | str, noise: list[str] = fixed.NOISE) -> Column:
    """Noise replaced by blanks, white space made single."""
    out = _c(x)
    for p in noise:
        out = F.regexp_replace(out, p, " ")
    return F.trim(F.regexp_replace(out, r"\s+", " "))


def punctuation_density(x: Column | str) -> Column:
    a = _c(x)
    return share(F.length(a) - F.length(F.translate(a, ".,!?;:،؛؟", "")), F.length(a))


def entity_name(x: Column | str) -> Column:
    """White space made single, edge punctuation and titles gone, "Last, First" turned, words capitalised."""
    a = F.trim(F.regexp_replace(_c(x), r"\s+", " "))
    a = F.regexp_replace(a, r"^[.,;:!?\"'()\[\]-]+|[.,;:!?\"'()\[\]-]+$", "")
    a = F.regexp_replace(a, r"(?i)^(dr|mr|mrs|ms|prof|eng)\.? +", "")
    a = F.regexp_replace(a, r"(?i) +(inc|ltd|llc|corp|co)\.?$", "")
    a = F.regexp_replace(a, r"^([^,]+), ([^,]+)$", "$2 $1")
    return F.array_join(F.transform(F.split(a, " "), lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.lower(F.substring(w, F.lit(2), F.length(w))))), " ")


def ensemble_key(x: Column | str) -> Column:
    return F.trim(F.regexp_replace(F.lower(_c(x)), r"[^\p{L}\p{N}]+", " "))


def _map(values: dict[str, object]) -> Column:
    return F.create_map(*(F.lit(v) for pair in values.items() for v in pair))


def relation(x: Column | str) -> list[Column]:
    """Normalised type, category, confidence, whether it holds both ways, and a label of A-Z, 0-9 and _."""
    original = F.trim(_c(x))
    clean = F.regexp_replace(F.lower(original), "[ -]", "_")
    english, arabic = _map(fixed.ENGLISH_RELATIONS), _map(fixed.ARABIC_RELATIONS)
    first = F.when(original.rlike(f"[{ARABIC}]"), F.coalesce(F.element_at(arabic, clean), clean)).otherwise(F.coalesce(F.element_at(english, clean), clean))
    kind = F.coalesce(F.element_at(english, first), first)
    category = F.coalesce(F.element_at(_map({t: c for c, types in fixed.RELATION_CATEGORIES.items() for t in types}), kind), F.lit("other"))
    label = F.regexp_replace(F.regexp_replace(F.upper(kind), "[^A-Z0-9_]+", "_"), "_+", "_")
    label = F.regexp_replace(label, "^_|_$", "")
    return [
        kind.alias("kind"),
        category.alias("category"),
        F.coalesce(F.element_at(_map(fixed.RELATION_CONFIDENCE), kind), F.lit(fixed.OTHER_RELATION_CONFIDENCE)).alias("confidence"),
        kind.isin(*fixed.BOTH_WAYS).alias("both_ways"),
        F.when(label == "", "RELATED_TO").otherwise(label).alias("label"),
    ]


def character_similarity(a: Column | str, b: Column | str) -> Column:
    """Jaccard of the character sets, 0.3 more if one holds the other, at most 1."""
    x, y = (F.array_distinct(F.filter(F.split(F.lower(_c(s)), ""), lambda c: c != "")) for s in (a, b))
    inside = F.contains(F.lower(_c(a)), F.lower(_c(b))) | F.contains(F.lower(_c(b)), F.lower(_c(a)))
    return F.least(F.lit(1.0), jaccard(x, y) + F.when(inside, 0.3).otherwise(0.0))


def sentences(x: Column | str) -> Column:
    """Sentences end at . ! ? or the Arabic question mark before white space."""
    return F.filter(F.split(_c(x), r"(?<=[.!?؟])\s+"), lambda s: F.trim(s) != "")


def query_class(x: Column | str) -> Column:
    """The first class with a pattern in the lower-cased query; else factual."""
    low, out = F.lower(_c(x)), None
    for name, patterns in fixed.QUERY_CLASSES.items():
        hit = low.rlike("|".join(f"(?:{p})" for p in patterns))
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out.otherwise("factual")


def retrieval_mode(x: Column | str) -> Column:
    """Two words or fewer go to vector search, other queries by their class."""
    return F.when(F.size(words(x)) <= 2, "vector").otherwise(F.element_at(_map(fixed.CLASS_MODES), query_class(x)))


def query_kind(x: Column | str) -> Column:
    """How a query is to be asked in parts: the first kind with a pattern in it; else multi_hop for more than twelve words with a conjunction; else simple."""
    c = _c(x)
    out = F.when((F.size(words(c)) > 12) & F.contains(c, F.lit(" و ")), "multi_hop").otherwise("simple")
    for kind, patterns in reversed(fixed.COMPLEX_QUERIES.items()):
        out = F.when(c.rlike("|".join(f"(?:{p})" for p in patterns)), kind).otherwise(out)
    return out


def query_parts(x: Column | str) -> Column:
    """The parts of a query of ten characters or more that isn't simple: between conjunctions, each of more than five characters, if there is a conjunction; else none."""
    c = _c(x)
    parts = F.filter(F.transform(F.split(c, fixed.CONJUNCTIONS), lambda p: F.trim(p)), lambda p: F.length(p) > 5)
    asked = (query_kind(c) != "simple") & (F.length(c) >= 10) & c.rlike(fixed.CONJUNCTIONS)
    return F.when(asked, parts).otherwise(F.array().cast("array<string>"))
