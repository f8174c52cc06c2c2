"""Column functions on labels, terms, tags and texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that end in s but are singular, corporate suffixes, modifiers, their
# unhyphenated variants, and occasions.
SINGULAR = ("molasses", "brussels", "swiss", "bolognese", "caprese", "anise")
SUFFIXES = ("co", "co.", "company", "inc", "inc.", "llc", "ltd", "ltd.", "corp", "corp.")
MODIFIERS = (
    "non-alcoholic", "nonalcoholic", "alcohol-free", "sugar-free", "sugarfree", "gluten-free", "glutenfree", "dairy-free", "fat-free", "low-carb",
    "low-fat", "high-protein", "handmade", "handcrafted", "homemade", "artisanal", "organic", "vegan", "vegetarian", "natural", "premium", "authentic",
)
VARIANTS = ("nonalcoholic", "sugarfree", "glutenfree")
OCCASIONS = (
    "brunch", "breakfast", "lunch", "dinner", "snack", "dessert", "graduation", "birthday", "wedding", "christmas", "easter",
    "halloween", "thanksgiving", "party", "picnic", "holiday",
)
LANGUAGE_ALIASES = {
    "spanish": "es", "español": "es", "castellano": "es", "portuguese": "pt", "português": "pt", "english": "en", "french": "fr", "français": "fr",
    "italian": "it", "italiano": "it", "german": "de", "deutsch": "de", "chinese": "zh-cn", "mandarin": "zh-cn",
}
ACCENTED, PLAIN = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿ", "aaaaaaceeeeiiiinooooouuuuyy"


def singularize(word: Column) -> Column:
    """Singular of one lower-case word."""
    n = F.length(word)
    short = lambda k: F.substring(word, F.lit(1), n - k)
    return (
        F.when(word.isin(*SINGULAR) | word.rlike("(us|is|ss)$"), word)
        .when((n > 3) & word.endswith("ies"), F.concat(short(3), F.lit("y")))
        .when((n > 4) & word.rlike("(ss|ch|sh|x|z)es$"), short(2))
        .when((n > 3) & word.endswith("s"), short(1))
        .otherwise(word)
    )


def canonical_label(label: Column) -> Column:
    """Trimmed, spaces collapsed, lower case; one word in the singular, several without corporate suffixes."""
    clean = F.lower(F.regexp_replace(F.trim(label), r"\s+", " "))
    suffix = "|".join(s.replace(".", r"\.") for s in SUFFIXES)
    return F.when(clean.contains(" "), F.regexp_replace(clean, rf"(?<=\S)(\s({suffix}))+$", "")).otherwise(singularize(clean))


def normalize_term(term: Column) -> Column:
    """Accents off, lower, leading # off, trimmed. Latin letters are mapped by a table, so no Python runs."""
    return F.trim(F.regexp_replace(F.translate(F.lower(term), ACCENTED, PLAIN), "^#", ""))


def hashtag_variants(tag: Column) -> Column:
    """Array of the tag and its plural or singular forms."""
    base = F.lower(F.regexp_replace(F.regexp_replace(tag, "^#+", ""), r"[\s_-]+", ""))
    n = F.length(base)
    cut = lambda k, add="": F.concat(F.substring(base, F.lit(1), n - k), F.lit(add))
    forms = (
        F.when(base == "", F.array().cast("array<string>"))
        .when(base.endswith("ies"), F.array(base, cut(3, "y")))
        .when(base.endswith("s"), F.array(base, cut(1)))
        .when(base.endswith("y"), F.array(base, F.concat(base, F.lit("s")), cut(1, "ies")))
        .otherwise(F.array(base, F.concat(base, F.lit("s"))))
    )
    return F.array_distinct(forms)


def search_key(term: Column) -> Column:
    """Accents and punctuation off, each word crudely singular, whisky as whiskey."""
    plain = F.translate(F.lower(F.regexp_replace(F.trim(term), "^#", "")), ACCENTED, PLAIN)
    words = F.filter(F.split(F.regexp_replace(plain, r"[^a-z0-9\s]", " "), r"\s+"), lambda w: w != "")

    def one(w: Column) -> Column:
        n = F.length(w)
        s = F.when((n > 4) & w.endswith("es") & ~w.endswith("ses"), F.substring(w, F.lit(1), n - 2))
        s = s.when((n > 3) & w.endswith("s") & ~w.endswith("ss"), F.substring(w, F.lit(1), n - 1)).otherwise(w)
        return F.when(s == "whisky", F.lit("whiskey")).otherwise(s)

    return F.array_join(F.transform(words, one), " ")


def topic_key(title: Column) -> Column:
    """A trailing "(X)" as " X", spaces collapsed, lower case."""
    return F.lower(F.trim(F.regexp_replace(F.regexp_replace(title, r"\(([^)]*)\)\s*$", " $1"), r"\s+", " ")))


def geo_code(value: Column) -> Column:
    """Two capitals pass, anything else is empty."""
    return F.when(value.rlike("^[A-Z]{2}$"), value).otherwise("")


def tag_text(text: Column, hashtags: Column, most: int = 500) -> Column:
    return F.substring(F.concat_ws(" ", text, F.array_join(hashtags, " ")), 1, most)


def excerpt(text: Column, most: int = 300) -> Column:
    return F.substring(text, 1, most)


def well_formed(label: Column) -> Column:
    """struct(ok, reason): a modifier or an occasion alone is no trend."""
    norm = F.lower(F.trim(label))
    reason = (
        F.when(norm == "", "empty").when(norm.contains(" "), "compound").when(norm.isin(*MODIFIERS), "modifier").when(norm.isin(*OCCASIONS), "occasion").otherwise("word")
    )
    return F.struct(reason.isin("compound", "word").alias("ok"), reason.alias("reason"))


def is_dangling(label: Column) -> Column:
    norm = F.lower(F.trim(label))
    return norm.isin(*[m for m in MODIFIERS if m not in VARIANTS])
